"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, plus signs
before a digit, digits, address schemes (``mailto:``, ``://``, ...) and
identifier cues (``iban``, ``ssn``, ``account``, ``token``, ...; written in
lower case, capitals or with a capital first letter). At each anchor a
deterministic local parser expands to both sides and validates what it found.
Every parser starts where the last one of its kind ended, so a text is read a
bounded number of times, however many anchors it holds.

Kinds, in the order in which spans of one start are listed:

* ``email``, ``ip``, ``card``, ``phone``: the base patterns, leftmost and not
  overlapping within a kind, matches that fail their check dropped;
* ``mailbox``: an address around an at-sign that the email pattern does not
  cover as it stands (letters beyond ASCII, a quoted local part);
* ``contact``: what follows ``mailto:``, ``tel:``, ``sip:``, ``sips:`` or
  ``xmpp:``, up to white space, quotes or brackets, without closing
  punctuation; ``login``: an address ``scheme://user@host`` with its user part;
* ``iban``: after its cue, two letters, two check digits and 11 to 30
  characters (blanks every so often allowed) whose remainder by 97 is 1;
* ``ssn``: after its cue, ddd-dd-dddd (also with blanks or unseparated) within
  the ranges that are given out;
* ``account``: after its cue, 6 to 17 digits, single blanks or dashes allowed;
* ``secret``: after its cue and ``=`` or ``:``, a value of 8 characters or more
  that holds a digit.

Between a cue and its value there may be up to two words of ``number``, ``no``,
``nr``, ``is`` and the like, and any of the characters ``#:=.`` and blanks; a cue does not
count inside a longer word. Spans of different kinds may overlap.

Edge cases: null, empty and blank texts have no spans; texts of any length are
searched whole, alone in a slice when long; repeated rows and null ids are
treated row by row; extra columns of any name are carried along; an empty
table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelgate.llm.common import fresh, map_in_arrow, quoted, text_slices

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = BASE_KINDS + ["mailbox", "contact", "login", "iban", "ssn", "account", "secret"]

#: Fixed by the base patterns.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
LABEL_END = re.compile(r"\.(?![A-Za-z0-9-])|[^A-Za-z0-9.-]")
DOTTED_END = re.compile(r"\.(?![0-9])|[^0-9.]")
CHAIN_END = re.compile(r"[ -](?![0-9])|[^0-9 -]")
PHONE_END = re.compile(r"[^ ().0-9-]")
PHONE_TAIL = " ().-"

#: Identifier cues and the parser each of them calls.
CUES = {
    "iban": "iban",
    "ssn": "ssn",
    "social security": "ssn",
    "account": "account",
    "acct": "account",
    "konto": "account",
    "kontonummer": "account",
    "compte": "account",
    "cuenta": "account",
    "routing": "account",
    "passport": "account",
    "token": "secret",
    "password": "secret",
    "passwd": "secret",
    "secret": "secret",
    "api_key": "secret",
    "apikey": "secret",
    "access_key": "secret",
}
SCHEMES = ["mailto:", "tel:", "sip:", "sips:", "xmpp:"]
LINK = r"(?:[ \t]{0,3}(?:number|no|nr|nummer|num|numéro|número|code|key|is|ist|est|es)\b){0,2}[ \t]{0,3}\.?[ \t]{0,3}[#:=]{0,2}[ \t]{0,3}"
IBAN = re.compile(LINK + r"([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])", re.I)
SSN = re.compile(LINK + r"((?!000|666|9)[0-9]{3}([- ]?)(?!00)[0-9]{2}\2(?!0000)[0-9]{4})(?![0-9])", re.I)
ACCOUNT = re.compile(LINK + r"([0-9](?:[ -]?[0-9]){5,16})(?![ -]?[0-9])", re.I)
SECRET = re.compile(r"[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?([A-Za-z0-9_+/.~-]{8,512})(?![A-Za-z0-9_+/.~-])")
CONTACT_END = re.compile(r"[\s\"'<>()\[\]{}|\\^`]")
USERINFO = re.compile(r"([^\s/?#@\"'<>\[\]{}|\\^`]{1,512})@([A-Za-z0-9](?:[A-Za-z0-9.-]{0,252}[A-Za-z0-9])?(?::[0-9]{1,5})?)")
SCHEME_BEFORE = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{0,15}\Z")
QUOTED_BEFORE = re.compile(r'"(?:[^"\\\r\n@]|\\.){1,62}"\Z')
#: Longest local part and host that a mailbox may have.
MAX_LOCAL, MAX_HOST = 64, 253
HOST = re.compile(r"[^\W_](?:[\w-]{0,61}[^\W_])?(?:\.[^\W_](?:[\w-]{0,61}[^\W_])?)*\.[^\W\d_]{2,63}(?![\w-])")

_AUTOMATON = None


def automaton():
    """The anchors; the value of each is (length, parser)."""
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick

        found = ahocorasick.Automaton()
        found.add_word("@", (1, "at"))
        for d in "0123456789":
            found.add_word(d, (1, "digit"))
            found.add_word("+" + d, (2, "plus"))
        found.add_word("://", (3, "url"))
        for scheme in SCHEMES:
            for form in {scheme, scheme.upper(), scheme.capitalize()}:
                found.add_word(form, (len(form), "scheme"))
        for cue, parser in CUES.items():
            for form in {cue, cue.upper(), cue.capitalize()}:
                found.add_word(form, (len(form), parser))
        found.make_automaton()
        _AUTOMATON = found
    return _AUTOMATON


def _end(pattern: re.Pattern, text: str, start: int) -> int:
    m = pattern.search(text, start)
    return m.start() if m else len(text)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 2 or (len(part) == 3 and part <= "255")


def _iban(value: str) -> bool:
    packed = value.replace(" ", "").upper()
    if not 15 <= len(packed) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1


def _alone(text: str, start: int, end: int) -> bool:
    """A cue that is no part of a longer word."""
    return not (start and (text[start - 1].isalnum() or text[start - 1] == "_")) and not (
        end < len(text) and text[end].isalpha()
    )


def _mailbox(text: str, at: int, low: int) -> tuple[int, int] | None:
    """An address around the at-sign, letters of every script allowed."""
    host = HOST.match(text, at + 1, min(len(text), at + 2 + MAX_HOST))
    if host is None:
        return None
    before = text[max(low, at - MAX_LOCAL - 1) : at]
    quote = QUOTED_BEFORE.search(before)
    if quote:
        return at - len(quote.group()), host.end()
    size = 0
    for c in reversed(before):
        if not (c.isalnum() or c in "._%+-"):
            break
        size += 1
    local = before[len(before) - size :].lstrip(".")
    if not local or len(local) > MAX_LOCAL or local[-1] == "." or ".." in local:
        return None
    return at - len(local), host.end()


def find(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of a text in code points, end exclusive, by
    start, then kind as listed, then end."""
    out: set[tuple[int, int, int, str]] = set()

    def add(kind: str, start: int, end: int) -> None:
        out.add((start, KINDS.index(kind), end, kind))

    email_end = ip_end = chain_end = secret_end = contact_end = 0
    last_at = -1  # place of the at-sign before
    for stop, (size, parser) in automaton().iter(text):
        start, stop = stop - size + 1, stop + 1
        if parser == "digit":
            if start >= ip_end:
                ip_end = _end(DOTTED_END, text, start)
                parts = text[start:ip_end].split(".")
                place = start
                for i in range(0, len(parts) - 3, 4):
                    width = sum(map(len, parts[i : i + 4])) + 3
                    if all(map(_octet, parts[i : i + 4])):
                        add("ip", place, place + width)
                    place += width + 1
            if start >= chain_end:
                chain_end = _end(CHAIN_END, text, start)
                if chain_end - start >= 14:
                    digits = text[start:chain_end].replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        add("card", start, chain_end)
        elif parser == "at":
            low = max(email_end, last_at + 1)
            part = text[low:start]
            left = low + len(part.rstrip(LOCAL))
            last_at = start
            right = _end(LABEL_END, text, stop)
            # the first label holds a character at least, and a dot follows it
            base = left < start and text[stop : stop + 1] not in ("", ".") and "." in text[stop:right]
            if base:
                add("email", left, right)
            box = _mailbox(text, start, low)
            if box and not (base and left <= box[0] and box[1] <= right):
                add("mailbox", *box)
            if base:
                email_end = right
        elif parser == "plus":
            run = _end(PHONE_END, text, stop)
            value = text[start:run].rstrip(PHONE_TAIL)
            if len(value) >= 4 and 10 <= sum(c.isdigit() for c in value) <= 15:
                add("phone", start, start + len(value))
        elif parser == "scheme":
            if start < contact_end or (start and (text[start - 1].isalnum() or text[start - 1] == "_")):
                continue
            contact_end = _end(CONTACT_END, text, stop)
            value = text[stop:contact_end].rstrip(".,;:!?")
            if any(c.isalnum() for c in value):
                add("contact", stop, stop + len(value))
        elif parser == "url":
            scheme = SCHEME_BEFORE.search(text[max(0, start - 17) : start])
            login = scheme and USERINFO.match(text, stop)
            if login:
                add("login", start - len(scheme.group()), login.end())
        elif not _alone(text, start, stop):
            continue
        elif parser == "secret":
            m = start >= secret_end and SECRET.match(text, stop)
            if m and any("0" <= c <= "9" for c in m.group(1)):
                add("secret", *m.span(1))
                secret_end = m.end()
        else:
            m = {"iban": IBAN, "ssn": SSN, "account": ACCOUNT}[parser].match(text, stop)
            if m is None:
                continue
            if parser == "iban":
                span = _iban_span(text, m)
                if span:
                    add("iban", *span)
            else:
                add(parser, *m.span(1))
    return [(kind, start, end) for start, _, end, kind in sorted(out)]


def _iban_span(text: str, m: re.Match) -> tuple[int, int] | None:
    """The longest valid number among the matches' blank-separated beginnings
    (the words that follow a number look like its groups)."""
    start, end = m.span(1)
    while end - start >= 15:
        if _iban(text[start:end]):
            return start, end
        cut = text.rfind(" ", start, end)
        if cut < 0:
            return None
        end = cut
    return None


SPANS = T.ArrayType(
    T.StructType([
        T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()), T.StructField("value", T.StringType()),
    ])
)


def find_spans(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` (all its columns, or those in ``keep``) plus one column
    ``spans``: the spans of the whole text with their kinds and values. A map
    over the rows: no shuffle."""
    keep = df.columns if keep is None else keep
    body, spans = fresh(df, "body__"), fresh(df, "spans")
    source = df.select(*[quoted(c) for c in keep], quoted(text).alias(body))
    schema = T.StructType([f for f in source.schema.fields if f.name != body] + [T.StructField(spans, SPANS)])
    kind = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])
    )

    def run(batches) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, body):
            names = part.schema.names
            found = [
                [{"kind": k, "start": s, "end": e, "value": t[s:e]} for k, s, e in find(t)] if t else []
                for t in part.column(names.index(body)).to_pylist()
            ]
            columns = [part.column(i) for i, c in enumerate(names) if c != body]
            yield pa.RecordBatch.from_arrays(
                columns + [pa.array(found, type=kind)], names=[c for c in names if c != body] + [spans]
            )

    return map_in_arrow(source, run, schema)


def listed(spans: Column, kinds: list[str] = KINDS) -> Column:
    """Spans of the given kinds as ``kind:start:end``, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.filter(spans, lambda s: s["kind"].isin(kinds)), one), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def masked(df: DataFrame, text: str = "text", replacement: str = "[{kind}]") -> DataFrame:
    """``df`` with every span in the text replaced by its kind. Overlapping
    spans make one, named by the first of them; a null text stays null."""
    found = find_spans(df, text)
    spans = quoted(found.columns[-1])
    raw = quoted(text)
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(state: Column, s: Column) -> Column:
        name = F.replace(F.lit(replacement), F.lit("{kind}"), s["kind"])
        gap = F.substring(raw, (state["at"] + 1).cast("int"), F.greatest(s["start"] - state["at"], F.lit(0)).cast("int"))
        inside = s["start"] < state["at"]
        return F.struct(
            F.when(inside, state["out"]).otherwise(F.concat(state["out"], gap, name)).alias("out"),
            F.greatest(state["at"], s["end"]).alias("at"),
        )

    end = F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(raw, (s["at"] + 1).cast("int"), F.length(raw))))
    return found.select(*[(end.alias(c) if c == text else quoted(c)) for c in df.columns])
