"""License scans: canonical texts looked up by digest.

A text is made canonical (lower case, equivalent spellings made one, lines with
a copyright notice dropped, punctuation and white space made single spaces) and its
MD5 digest is joined with the digests of known licence texts, which go
through the same steps. Three kinds of units of a document are looked up
whole: the document, its paragraphs (parted by empty lines) and its lines. The
known digests are a fixed table, so the join is a broadcast one and the
documents are not shuffled but for the counts per document.

The known texts are ``NOTICES`` (one-line notices and opening paragraphs) and
``WHOLE``: whole published licences, with and without header and appendix, as digests
(``scripts/licence_digests.py`` lists their sources). A whole licence within a longer
document is found however its lines and paragraphs are parted: where its opening words
stand in the document's canonical form, as much text as the licence is long is
digested and compared.

Edge cases: null, empty and wordless texts match nothing; units without a word
after the steps are not looked up (a known text without words is an error). A
licence found in several units of a document counts each. Null ids and
repeated rows are kept: documents are told apart by row, not by id.
"""

from __future__ import annotations

import json
from itertools import groupby
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelgate.llm.common import fresh, quoted

#: Equivalent spellings, as (other spelling, the one kept).
SPELLINGS = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("copyright owner", "copyright holder"),
    ("favour", "favor"),
    ("judgement", "judgment"),
    ("organisation", "organization"),
    ("merchantibility", "merchantability"),
)
#: ``v3`` and ``v 3`` are ``version 3``.
VERSION = (r"\bv ?([0-9])", "version ")

#: Licence texts and notices as they are published.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted.",
    ),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain.",
    ),
)

#: (licence, characters, opening words, digest, searched for within documents) of the
#: canonical forms of whole licences.
WHOLE = tuple(map(tuple, json.loads(Path(__file__).with_name("licence_digests.json").read_text(encoding="utf8"))))
#: Each whole licence holds one of these, so other documents are not searched.
NEEDED = ("permission", "distribut")

#: Lines dropped: those that start as a copyright notice does (and so hold one of its words).
COPYRIGHT = r"^[^a-z0-9]*(copyright|\(c\)|©|all rights reserved)"
COPYRIGHT_WORDS = ("copyright", "(c)", "©", "all rights reserved")
#: Empty lines part paragraphs.
PARAGRAPH = r"\n[ \t\r]*\n"
#: Everything but letters, digits and what lies beyond ASCII parts words.
GAP = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
#: The same but for line feeds.
LINE_GAP = r"[\x00-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f]+"


def canonical(text: Column) -> Column:
    """The canonical form of a text: words with single spaces between."""
    lines = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "\n"), lambda x: ~x.rlike(COPYRIGHT))
    out = F.regexp_replace(F.array_join(lines, " "), GAP, " ")
    for other, kept in SPELLINGS:
        out = F.regexp_replace(out, rf"\b{other}\b", kept)
    return F.trim(F.regexp_replace(out, VERSION[0], VERSION[1] + "$1"))


def holds_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words stands anywhere in a text."""
    found = F.contains(text, F.lit(words[0]))
    for word in words[1:]:
        found = found | F.contains(text, F.lit(word))
    return found


def units(text: Column) -> Column:
    """The texts of a document that are looked up whole: itself (first), its
    paragraphs of several lines, its lines; those without a word are left out but for the
    first. In each the words stand with single spaces between, as in the canonical form before
    spellings are made one (see ``respelled``): a line goes through these steps once,
    a paragraph and the document are made of the lines' words."""

    def dropped(x: Column) -> Column:  # parts no paragraphs and has no words
        return F.when(x.rlike(COPYRIGHT), F.lit("-")).otherwise(x)

    def words(paragraph: Column) -> Column:
        lines = F.split(F.regexp_replace(paragraph, LINE_GAP, " "), "\n")
        return F.struct(
            F.contains(paragraph, F.lit("\n")).alias("several"),
            F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "").alias("lines"),
        )

    def joined(found: Column) -> Column:
        lines = F.flatten(found.getField("lines"))
        several = F.filter(found, lambda p: p.getField("several") & (F.size(p.getField("lines")) > 0))
        return F.concat(
            F.array(F.array_join(lines, " ")), F.transform(several, lambda p: F.array_join(p.getField("lines"), " ")), lines
        )

    def parted(low: Column) -> Column:
        kept = F.when(
            holds_any(low, COPYRIGHT_WORDS), F.array_join(F.transform(F.split(low, "\n"), dropped), "\n")
        ).otherwise(low)
        return F.transform(F.split(kept, PARAGRAPH), words)

    # an array of one binds what is used several times, so that it is made once
    low = F.array(F.lower(F.coalesce(text, F.lit(""))))
    return F.transform(F.transform(low, parted), joined)[0]


def respelled(df: DataFrame, words: str, form: str) -> DataFrame:
    """``df`` plus the canonical form of the column ``words`` (an element of ``units``).
    Patterns are run on the texts that hold what they need."""
    spelled = F.col(words)
    for other, kept in SPELLINGS:
        spelled = F.regexp_replace(spelled, rf"\b{other}\b", kept)
    spelled = F.when(holds_any(F.col(words), tuple(other for other, _ in SPELLINGS)), spelled).otherwise(F.col(words))
    versions = F.regexp_replace(form, VERSION[0], VERSION[1] + "$1")
    df = df.withColumn(form, spelled)
    return df.withColumn(form, F.when(F.col(form).rlike(VERSION[0].removeprefix(r"\b")), versions).otherwise(F.col(form)))


def licences_within(form: Column, whole=WHOLE) -> Column:
    """Those of the whole licences that stand in a canonical form, as words of it."""
    padded = F.concat(F.lit(" "), form, F.lit(" "))

    def stands(pieces: Column, mark: str, length: int, digest: str) -> Column:
        """At some place of the mark the next ``length`` characters have this
        digest and a word ends there. Only the pieces that so many characters
        can lie in are put together, one place at a time."""
        reach = length // len(mark) + 2

        def here(i: Column) -> Column:
            return F.concat(F.lit(mark[1:]), F.array_join(F.slice(pieces, i, reach), mark))

        return F.exists(
            F.sequence(F.lit(2), F.size(pieces)),
            lambda i: (F.substring(here(i), length + 1, 1) == " ") & (F.md5(F.substring(here(i), 1, length).cast("binary")) == digest),
        )

    def first(n: int):
        return lambda x: F.substring(x, 1, n)

    def those_of(mark: str, forms: list):
        return lambda pieces: F.array(
            *[F.when(stands(pieces, mark, length, digest), F.lit(licence)) for licence, length, _, digest, _ in forms]
        )

    found = []
    for opening, rows in groupby(sorted((r for r in whole if r[4]), key=lambda r: r[2]), key=lambda r: r[2]):
        mark, forms = f" {opening}", list(rows)  # without a blank after it: a repeat may follow
        longest = max(length for _, length, *_ in forms)
        # what follows so many characters of a piece is never looked at; letters,
        # digits and spaces are themselves as a pattern
        pieces = F.transform(F.split(padded, mark), first(longest + 1))
        met = F.transform(F.array(pieces), those_of(mark, forms))[0]  # binds the pieces, so that they are made once
        found.append(F.when(F.contains(padded, F.lit(mark)), F.array_compact(met)).otherwise(F.array().cast("array<string>")))
    return F.when(holds_any(form, NEEDED), F.array_distinct(F.concat(*found))).otherwise(F.array().cast("array<string>"))


def known_digests(spark: SparkSession, notices=NOTICES, whole=WHOLE) -> DataFrame:
    """(digest, licence) of the known texts."""
    rows = spark.createDataFrame([(a, b) for a, b in notices], "licence string, body string")
    form = canonical(F.col("body"))
    known = rows.select(F.md5(form.cast("binary")).alias("digest"), "licence")
    if whole:
        known = known.unionByName(spark.createDataFrame([(r[3], r[0]) for r in whole], "digest string, licence string"))
    return known.groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(df: DataFrame, text: str = "text", keep: list[str] | None = None, notices=NOTICES, whole=WHOLE) -> DataFrame:
    """``df`` (its columns, or those in ``keep``) plus document_license (of the
    whole text, else null), licenses (those of any unit or within the text, sorted,
    joined by commas, empty if none) and n_units (the units that matched and
    the whole licences within the text)."""
    keep = df.columns if keep is None else keep
    names = [fresh(df.select(*[quoted(c) for c in keep]), c) for c in ("document_license", "licenses", "n_units")]
    row, kept, place, unit = "row__", "kept__", "place__", "unit__"
    raw = F.coalesce(quoted(text), F.lit(""))
    told = df.select(F.struct(*[quoted(c) for c in keep]).alias(kept), raw.alias("body__")).withColumn(
        row, F.monotonically_increasing_id()
    )
    every = told.select(row, kept, F.posexplode(units(F.col("body__"))).alias(place, unit))
    formed = respelled(every, unit, "form__")
    digest = F.when(F.col("form__") != "", F.md5(F.col("form__").cast("binary")))
    within = F.when(F.col(place) == 0, licences_within(F.col("form__"), whole)) if whole else F.lit(None).cast("array<string>")
    hashed = formed.select(row, kept, place, digest.alias("digest"), within.alias("within"))
    known = known_digests(df.sparkSession, notices, whole)
    met = hashed.join(F.broadcast(known), "digest", "left")  # a fixed table of a few rows
    # a row's units are in one task: the partial aggregate leaves one row of each
    found = met.groupBy(row).agg(
        F.first(kept).alias(kept),
        F.max(F.when(F.col(place) == 0, F.col("licence"))).alias("whole"),
        F.collect_set("licence").alias("some"),
        F.count(F.when(F.col(place) > 0, F.col("licence"))).alias("n"),
        F.coalesce(F.first("within", ignorenulls=True), F.array().cast("array<string>")).alias("within"),
    )
    found = found.withColumn("some", F.array_sort(F.array_union("some", "within"))).withColumn("n", F.col("n") + F.size("within"))
    return found.select(
        *[F.col(kept).getField(c).alias(c) for c in keep], F.col("whole").alias(names[0]),
        F.array_join("some", ",").alias(names[1]), F.col("n").alias(names[2]),
    )


def oracle_sql(notices=NOTICES) -> str:
    """The scan of ``documents`` for the notices in DuckDB's SQL (without ``WHOLE``: equal
    to the scan on documents that hold no whole licence)."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def form(x: str) -> str:
        lines = f"list_filter(string_split(lower({x}), chr(10)), lambda y: NOT regexp_matches(y, {quote(COPYRIGHT)}))"
        out = f"regexp_replace(array_to_string({lines}, ' '), {quote(GAP)}, ' ', 'g')"
        for other, kept in SPELLINGS:
            out = f"regexp_replace({out}, {quote(rf'\b{other}\b')}, {quote(kept)}, 'g')"
        return f"trim(regexp_replace({out}, {quote(VERSION[0])}, {quote(VERSION[1] + chr(92) + '1')}, 'g'))"

    values = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in notices)
    paragraphs = f"list_filter(string_split_regex(body, {quote(PARAGRAPH)}), lambda y: contains(y, chr(10)))"
    return f"""
    WITH known AS (SELECT md5({form('body')}) AS digest, min(licence) AS licence
                   FROM (VALUES {values}) AS t(licence, body) GROUP BY 1),
    told AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
    every AS (SELECT rid, doc_id, body AS unit, TRUE AS whole FROM told
              UNION ALL SELECT rid, doc_id, unnest({paragraphs}), FALSE FROM told
              UNION ALL SELECT rid, doc_id, unnest(string_split(body, chr(10))), FALSE FROM told),
    hashed AS (SELECT rid, doc_id, whole, CASE WHEN {form('unit')} <> '' THEN md5({form('unit')}) END AS digest FROM every)
    SELECT doc_id, max(CASE WHEN whole THEN licence END) AS document_license,
           coalesce(array_to_string(list_sort(list(DISTINCT licence) FILTER (licence IS NOT NULL)), ','), '') AS licenses,
           count(CASE WHEN NOT whole THEN licence END) AS n_units
    FROM hashed LEFT JOIN known USING (digest) GROUP BY rid, doc_id"""
