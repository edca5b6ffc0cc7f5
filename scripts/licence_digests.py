"""Write ``modelgate/llm/licence_digests.json``: the canonical forms of whole
published licences as (licence, length, opening words, digest, whether it is searched
for within documents: no shorter form of the licence is in it), from the texts
under /usr/share/common-licenses and the licence files of installed packages.

    python scripts/licence_digests.py
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
import sysconfig
from collections import Counter
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from modelgate.llm.licences import COPYRIGHT, GAP, SPELLINGS, VERSION  # noqa: E402

COMMON = Path("/usr/share/common-licenses")
OPENING = 12
#: File: licence, where its body begins after the header, where its appendix begins.
FILES = {
    "Apache-2.0": ("Apache-2.0", "TERMS AND CONDITIONS FOR USE", "END OF TERMS AND CONDITIONS"),
    "Artistic": ("Artistic-1.0-Perl", "Preamble", "The End"),
    "BSD": ("BSD-3-Clause", None, None),
    "CC0-1.0": ("CC0-1.0", "Statement of Purpose", None),
    "GFDL-1.2": ("GFDL-1.2", "0. PREAMBLE", "ADDENDUM: How to use"),
    "GFDL-1.3": ("GFDL-1.3", "0. PREAMBLE", "ADDENDUM: How to use"),
    "GPL-1": ("GPL-1.0", "Preamble", "END OF TERMS AND CONDITIONS"),
    "GPL-2": ("GPL-2.0", "Preamble", "END OF TERMS AND CONDITIONS"),
    "GPL-3": ("GPL-3.0", "Preamble", "END OF TERMS AND CONDITIONS"),
    "LGPL-2": ("LGPL-2.0", "Preamble", "END OF TERMS AND CONDITIONS"),
    "LGPL-2.1": ("LGPL-2.1", "Preamble", "END OF TERMS AND CONDITIONS"),
    "LGPL-3": ("LGPL-3.0", "This version of the GNU Lesser", None),
    "MPL-1.1": ("MPL-1.1", "1. Definitions.", "EXHIBIT A"),
    "MPL-2.0": ("MPL-2.0", "1. Definitions", "Exhibit A - Source Code"),
}
#: Short licences as packages carry them: licence, title, opening and end of the text.
SHORT = (
    ("MIT", "MIT License", r"Permission is hereby granted, free of charge, to any person\s+obtaining", r"DEALINGS IN THE\s+SOFTWARE\."),
    ("ISC", "ISC License", r"Permission to use, copy, modify, and(?:/or)?\s+distribute\s+this\s+software\s+for\s+any", r"PERFORMANCE OF THIS\s+SOFTWARE\."),
    ("BSD", None, "Redistribution and use in source and binary forms", r"POSSIBILITY OF\s+SUCH\s+DAMAGE\."),
    ("Unlicense", None, "This is free and unencumbered software", r"unlicense\.org/?>?"),
)


def form(text: str) -> str:
    lines = [x for x in text.lower().split("\n") if not re.search(COPYRIGHT, x)]
    out = re.sub(GAP, " ", " ".join(lines))
    for other, kept in SPELLINGS:
        out = re.sub(rf"\b{other}\b", kept, out)
    return re.sub(VERSION[0], VERSION[1] + r"\1", out).strip(" ")


def whole() -> list[tuple[str, str]]:
    """(licence, canonical form), with and without header and appendix."""
    out = []
    for name, (licence, begin, end) in FILES.items():
        text = (COMMON / name).read_text(encoding="utf8", errors="replace")
        first = text.index(begin) if begin else 0
        last = text.rindex(end) if end else len(text)
        out += [(licence, form(text[a:b])) for a in (0, first) for b in (len(text), last)]
    found: Counter[tuple[str, str]] = Counter()
    for path in sorted(Path(sysconfig.get_paths()["purelib"]).glob("*.dist-info/**/*")):
        if not re.match("(?i)licen[cs]e|copying", path.name) or not path.is_file():
            continue
        text = path.read_text(encoding="utf8", errors="replace")
        for licence, title, begin, end in SHORT:
            for m in re.finditer(rf"{begin}.*?{end}", text, re.S):
                body = form(m[0])
                if not 60 <= len(body.split()) <= 400:
                    continue  # ran on into another text
                spdx = licence
                if licence == "BSD":
                    clauses = 4 if "advertising materials" in body else 3 if "neither the name" in body else 2
                    spdx = f"BSD-{clauses}-Clause"
                elif licence == "ISC" and "provided that" not in body:
                    spdx, title = "0BSD", None
                found[spdx, body] += 1
                if title:
                    found[spdx, form(title) + " " + body] += 1
                    found[spdx, form(f"The {title}") + " " + body] += 1
    # a wording that only one package has may be that package's own
    return out + [x for x, n in found.items() if n > 1]


def main() -> None:
    forms = set(whole())
    rows = sorted(
        (a, len(b), " ".join(b.split()[:OPENING]), hashlib.md5(b.encode()).hexdigest(), not any(x == a and y != b and y in b for x, y in forms))
        for a, b in forms
    )
    target = os.path.join(ROOT, "modelgate", "llm", "licence_digests.json")
    with open(target, "w", encoding="utf8") as out:
        out.write("[\n" + ",\n".join(json.dumps(r) for r in rows) + "\n]\n")
    print(len(rows), Counter(r[0] for r in rows))


if __name__ == "__main__":
    main()
