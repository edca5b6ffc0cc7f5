import random
import re
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from pyspark.sql import functions as F

from modelgate.llm import licences
from modelgate.llm.licences import NEEDED, NOTICES, WHOLE, oracle_sql, scan


def documents():
    mit = next(b for a, b in NOTICES if b.startswith("Permission is hereby"))
    texts = [
        None, "", " \n ", "Released under the MIT License.", "released UNDER the  mit licence", "x\nReleased under the MIT License.\ny",
        "Copyright (c) 2020 A. B.\n" + mit, "a\n\n" + mit.replace(", ", ",\n").upper() + "\n\nb", mit[:-20],
        "This work is licensed under the GNU General Public Licence, v3.\nLicensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.",
        "word " * 20000 + "\nLicensed under CC0 1.0.", "Mit und", "This is not Released under the MIT License. really",
    ]
    return [(i, t) for i, t in enumerate(texts)] + [(None, texts[3]), (3, texts[3])]


def test_scan_equals_oracle(spark):
    rows = documents()
    df = spark.createDataFrame([(i, t, "u") for i, t in rows], "doc_id long, text string, units__ string")
    out = scan(df, keep=["doc_id"])
    got = sorted(map(tuple, out.collect()), key=repr)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    want = con.execute(oracle_sql()).fetchall()
    assert got == sorted(want, key=repr)
    by_id = {r[0]: r for r in got if r[0] is not None}
    assert by_id[4][1] == "MIT" and by_id[6][1] == "MIT" and by_id[8][1] is None
    assert by_id[5][1:] == (None, "MIT", 1)
    assert by_id[7][2] == "MIT"
    assert by_id[9][2:] == ("CC-BY-NC-4.0,GPL-3.0", 3)
    assert by_id[12][2] == ""


def test_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "a", "x")], "doc_id long, text string, licenses string")
    assert scan(df).columns == ["doc_id", "text", "licenses", "document_license", "licenses_", "n_units"]
    assert scan(df.limit(0)).count() == 0


COMMON = Path("/usr/share/common-licenses")


@pytest.mark.skipif(not COMMON.is_dir(), reason="no licence texts here")
def test_whole_licences_alone_and_within_documents(spark):
    sys.path.insert(0, str(Path(__file__).parents[2] / "scripts"))
    from licence_digests import FILES, whole

    assert all(any(word in form for word in NEEDED) for _, form in whole())
    rows = []
    for name, (licence, _, _) in FILES.items():
        text = (COMMON / name).read_text(encoding="utf8", errors="replace")
        wrapped = " * " + re.sub(r"[ \t]+\n", "\n", text).replace("\n\n", "\n").replace("\n", "\n * ")
        rows += [(licence, "alone", text), (licence, "in", f"Some project.\n\n{text}\n\nMore of it.\n"), (licence, "comment", wrapped + "\nint x;")]
        rows.append((licence, "cut", text[: len(text) // 2]))
    gpl = (COMMON / "GPL-2").read_text()
    rows.append(("GPL-2.0", "twice", gpl[:3000] + "\n\n" + gpl))  # its opening words stand twice
    out = scan(spark.createDataFrame(rows, "licence string, how string, text string"), keep=["licence", "how"]).collect()
    for r in out:
        names = r["licenses"].split(",")
        assert (r["licence"] in names) == (r["how"] != "cut"), r
        assert r["document_license"] == (r["licence"] if r["how"] == "alone" else None), r
    assert len(out) == len(rows) and len({r[0] for r in WHOLE}) >= 14


@pytest.mark.skipif(not COMMON.is_dir(), reason="no licence texts here")
def test_opening_words_repeated_many_times(spark):
    """Memory and time follow the text, not the square of the repeats."""
    gpl = (COMMON / "GPL-2").read_text()
    opening = next(r[2] for r in WHOLE if r[0] == "GPL-2.0")
    many = (opening + " permission ") * (1_500_000 // len(opening))
    rows = [(1, many), (2, many + "\n\n" + gpl), (3, f"{opening} {gpl}")]
    got = {r["i"]: r["licenses"] for r in scan(spark.createDataFrame(rows, "i int, text string"), keep=["i"]).collect()}
    assert got[1] == "" and "GPL-2.0" in got[2].split(",") and "GPL-2.0" in got[3].split(",")


def test_forms_made_of_lines_equal_those_of_the_whole_units(spark):
    """A line goes through the steps once; the forms are those of each unit on its own."""
    parts = [
        "\n", "\n\n", "\n \t\r\n", "\r\n", " ", "  ", "-", ".", "\x00", "\x0b", "\u2028", "é", "Σ", "ΑΣ", "İ", "ß", "v", "V 3", "v2", "év 3", "av3",
        "x", "Copyright (c) 2020 A", "(c) b", " © c", "not copyright", "All Rights Reserved", "copyright owner", "copyright", "owner", "sub", "licence",
        "Licenced", "sub licence", "SUB license", "non", "commercial", "favour", "disfavour", "judgement", "organisation,", "merchantibility", "3",
    ]
    rng = random.Random(4)
    texts = ["".join(rng.choice(parts) + rng.choice(("", " ", "\n")) for _ in range(rng.randrange(0, 25))) for _ in range(1500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", "\n", "\n\n", *texts])], "i int, body string")
    raw = F.coalesce("body", F.lit(""))
    every = F.concat(
        F.array(raw), F.filter(F.split(raw, licences.PARAGRAPH), lambda x: F.instr(x, "\n") > 0), F.split(raw, "\n")
    )
    want = df.select("i", F.posexplode(every).alias("at", "unit"))
    want = want.select("i", (F.col("at") == 0).alias("whole"), licences.canonical(F.col("unit")).alias("form")).where("whole OR form <> ''")
    got = df.select("i", F.posexplode(licences.units(F.col("body"))).alias("at", "unit"))
    got = licences.respelled(got, "unit", "form").select("i", (F.col("at") == 0).alias("whole"), "form")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
