"""Collocations by set-oriented relational mining (SETM).

The occurrences of phrases are relations: R_k holds (piece, position, phrase)
of all phrases of k words, sorted by piece and position, and is written at
every length. R_(k+1) is the merge-join of R_k with itself at the same piece
and the next position: two phrases of k words that overlap in all but their
ends make one of k + 1. Its groups are counted, groups below the minimum go, and
the semi-join with the groups that are left thins R_(k+1) before it is
extended in turn. Phrases of frequent parts only are ever made, because a
phrase is at most as frequent as any part of it.

Spark's share: the relations are stored by blocks, one row per block of the
texts of one language (at most ``BLOCK`` words and the few that follow), with
positions as differences (2 and more: another piece, or a dropped word) and
phrases as numbers within the block. So the merge-join is one pass over a
block's sorted rows, and what is shuffled are a block's distinct phrases with
their counts, never single occurrences: a phrase that makes a third of all rows
is one row per block. One window over (first part, second part) counts a
group, numbers it (by its smallest row) and gives every block its frequent
phrases back; a cogroup by block applies them. The parts' frequencies are
carried along as arrays, so that every cut is scored without another look.

Words are ``[^\\x20\\x09]+`` in pieces split at ``[.,;:!?\\x0A-\\x0D]``, letters
A-Z lower-cased; a document's end ends a piece.

Edge cases: null, empty and wordless texts have no words; a null language is
``und``, as is the language of that name; texts of any length are cut into
blocks between words, which lose no phrase; repeated rows count as often as
they occur; columns other than text and language play no part; an empty table
gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelgate.llm.common import cut, drop, map_in_arrow, quoted, text_slices
from modelgate.operators.common import bounded_broadcast, top_k_per_group

MIN_COUNT = 10
MAX_WORDS = 3
TOP = 2_000
#: A candidate goes if a longer one that holds it has this share of its count (percent).
CONTAINED_PERCENT = 50

#: Bytes of text that make a block.
BLOCK_BYTES = 8 << 20
#: Bits of a block's number below the task's, and of a phrase's number in its block.
BLOCK_BITS, GROUP_BITS = 18, 25

#: Fixed by the contract: what ends a piece, and what ends a word within one.
BREAKS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
SEPARATOR = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]")
LOWER = bytes(range(256)).lower()  # A-Z only
KIND = np.zeros(256, dtype=np.uint8)
KIND[list(SPACES)] = 1
KIND[list(BREAKS)] = 2

RELATION = "block long, own int, step array<int>, code array<int>"


def _chunks(data: bytes, limit: int, more: int) -> Iterator[tuple[bytes, int]]:
    """Pieces of ``data`` cut between words, each with the ``more`` words that
    follow it in its last piece of text: (bytes, length of its own part)."""
    start = 0
    while start < len(data):
        m = SEPARATOR.search(data, start + limit) if start + limit < len(data) else None
        end = m.start() if m else len(data)
        reach = end
        if m:
            words = 0
            while reach < len(data) and words < more and KIND[data[reach]] < 2:
                m = SEPARATOR.search(data, reach + 1)
                stop = m.start() if m else len(data)
                words += stop - reach > 1 or KIND[data[reach]] == 0
                reach = stop
        yield data[start:reach], end - start
        start = end


def _words(data: bytes, own_bytes: int) -> tuple[pa.Array, np.ndarray, int]:
    """Words of the bytes, their positions (one more after every word, two more
    into another piece), and the number of words that start in the own part."""
    raw = np.frombuffer(data, dtype=np.uint8)
    kind = KIND[raw]
    inside = kind == 0
    edge = np.zeros(len(raw) + 2, dtype=np.int8)
    edge[1:-1] = inside
    starts, ends = np.flatnonzero(edge[1:] > edge[:-1]), np.flatnonzero(edge[1:] < edge[:-1])
    offsets = np.zeros(len(starts) + 1, dtype=np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw[inside].tobytes()))
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
    step = np.ones(len(starts), dtype=np.int32)
    step[1:] += piece[1:] != piece[:-1]
    return words, step, int(np.searchsorted(starts, own_bytes))


def _row(block: int, own: int, step: np.ndarray, code: np.ndarray) -> list[pa.Array]:
    """A block's relation as one row of arrays. ``own``: its phrases start before this position."""
    listed = lambda v: pa.array([v.astype(np.int32)], pa.list_(pa.int32()))
    return [pa.array([block], pa.int64()), pa.array([own], pa.int32()), listed(step), listed(code)]


def _occurrences(df: DataFrame, text: str, lang: str, more: int, limit: int) -> DataFrame:
    """R_1: per block a relation row, and a row (group, word, n) per distinct word."""
    source = df.select(
        F.coalesce(quoted(text), F.lit("")).alias("text"),
        F.coalesce(quoted(lang).cast("string"), F.lit("und")).alias("lang"),
    )

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        for part in text_slices(batches, "text", limit):
            langs = part.column("lang")
            for name in pc.unique(langs).to_pylist():
                texts = part.column("text").filter(pc.equal(langs, name))
                joined = pc.binary_join(pa.ListArray.from_arrays([0, len(texts)], texts.cast(pa.binary())), b"\n")
                for data, own_bytes in _chunks(joined[0].as_py().translate(LOWER), limit, more):
                    words, step, own = _words(data, own_bytes)
                    if not own:
                        continue
                    coded = words.dictionary_encode()
                    code = coded.indices.to_numpy()
                    at = np.cumsum(step)
                    n = np.bincount(code[:own], minlength=len(coded.dictionary))
                    block = task << BLOCK_BITS | number
                    number += 1
                    if number >> BLOCK_BITS:
                        raise ValueError("a task has too many blocks: use more partitions or larger blocks")
                    yield pa.RecordBatch.from_arrays(
                        [*_row(block, int(at[own - 1]) + 1, step, code), pa.array([name]), pa.array([own], pa.int64()),
                         pa.nulls(1, pa.int32()), pa.nulls(1, pa.string())],
                        names=R1_NAMES,
                    )
                    m = len(n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(m, block)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.list_(pa.int32())),
                         pa.nulls(m, pa.list_(pa.int32())), pa.array([name] * m), pa.array(n, pa.int64()),
                         pa.array(np.arange(m), pa.int32()), coded.dictionary],
                        names=R1_NAMES,
                    )

    return map_in_arrow(source, run, f"{RELATION}, lang string, n long, group int, word string")


R1_NAMES = ["block", "own", "step", "code", "lang", "n", "group", "word"]


def _frequent(groups: DataFrame, key: list[str], min_count: int) -> DataFrame:
    """Rows of groups of at least ``min_count`` occurrences, with the group's id
    (its smallest row's number) and count: group-count and semi-join in one."""
    w = Window.partitionBy(*key)
    row = F.shiftleft("block", GROUP_BITS).bitwiseOR(F.col("group").cast("long"))
    counted = groups.select(row.alias("row"), *key, "n").select(
        "row", *key, F.sum("n").over(w).alias("f"), F.min("row").over(w).alias("id")
    )
    first = F.col("row") == F.col("id")
    return counted.where(F.col("f") >= min_count).select(
        F.shiftright("row", GROUP_BITS).alias("block"),
        F.col("row").bitwiseAND(F.lit((1 << GROUP_BITS) - 1)).cast("int").alias("group"),
        "id",
        *[F.when(first, F.col(c)).alias(c) for c in [*key, "f"]],
    )


def _merge_join(own: int, step: np.ndarray, code: np.ndarray, m: int):
    """Next phrases of a block's relation: for each its place in the relation
    and its number, and by number the first and second part and the count of
    the block's own ones. The rows are sorted, so equal pieces and next
    positions are neighbours."""
    at = np.cumsum(step)
    here = np.flatnonzero(step[1:] == 1)
    pairs = code[here].astype(np.int64) * m + code[here + 1]
    distinct, number = np.unique(pairs, return_inverse=True)
    n = np.bincount(number[: np.searchsorted(at[here], own)], minlength=len(distinct))
    return here, at, number, distinct // max(m, 1), distinct % max(m, 1), n


def _arrays(batch, i: int = 0):
    get = lambda c: batch.column(c)[i].values.to_numpy(zero_copy_only=False)
    return batch.column("block")[i].as_py(), batch.column("own")[i].as_py(), get("step"), get("code")


def _extend(relation: DataFrame) -> DataFrame:
    """Distinct next phrases of each block, with both parts' ids and counts."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block, own, step, code = _arrays(batch, i)
                ids = batch.column("ids")[i].values.to_numpy(zero_copy_only=False)
                *_, first, second, n = _merge_join(own, step, code, len(ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), block), pa.int64()), pa.array(np.arange(len(n)), pa.int32()),
                     pa.array(ids[first], pa.int64()), pa.array(ids[second], pa.int64()), pa.array(n, pa.int64())],
                    names=["block", "group", "first", "second", "n"],
                )

    return map_in_arrow(relation, run, "block long, group int, first long, second long, n long")


def _thin(relation: DataFrame, frequent: DataFrame, extend: bool) -> DataFrame:
    """The relation's phrases (``extend``: its next phrases) that are frequent:
    a block's relation meets the block's frequent phrases."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.schema(
            [("block", pa.int64()), ("own", pa.int32()), ("step", pa.list_(pa.int32())),
             ("code", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64()))]
        )
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        left = left.combine_chunks().to_batches()[0]
        block, own, step, code = _arrays(left)
        if extend:
            here, at, code, *_ = _merge_join(own, step, code, len(left.column("ids")[0].values))
            at = at[here]
        else:
            at = np.cumsum(step)
        group = right.column("group").to_numpy()
        number = np.full(max(int(group.max()), int(code.max(initial=0))) + 1, -1, dtype=np.int64)
        number[group] = np.arange(len(group))
        code = number[code]
        at, code = at[code >= 0], code[code >= 0]
        arrays = _row(block, own, np.diff(at, prepend=0), code)
        ids = pa.array([right.column("id").to_numpy()], pa.list_(pa.int64()))
        return pa.Table.from_arrays([*arrays, ids], schema=out)

    both = relation.groupBy("block").cogroup(frequent.select("block", "group", "id").groupBy("block"))
    return both.applyInArrow(run, f"{RELATION}, ids array<long>")


def _lowest_cut(heads: Column, tails: Column, a: Column, k: int) -> Column:
    """(score, k, l, r) of the lowest-scoring cut of a phrase of k words; heads
    and tails are the counts of its first and last 1, 2, ... words. In whole
    numbers of up to 38 digits: a count times a count times a million."""
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    top = wide(a, 19) * wide(a, 19) * F.lit(1_000_000).cast("decimal(7,0)")
    cuts = []
    for j in range(1, k):
        left, right = heads[j - 1], tails[k - j - 1]
        below = wide(left, 19) * wide(right, 19)
        score = F.call_function("floor", (top - top % below) / below).cast("long")
        cuts.append(F.struct(score.alias("score"), F.lit(j).alias("k"), left.alias("l"), right.alias("r")))
    return F.array_min(F.array(*cuts))


def mine(
    df: DataFrame,
    text: str = "text",
    lang: str = "lang",
    min_count: int = MIN_COUNT,
    max_words: int = MAX_WORDS,
    top: int = TOP,
    contained_percent: int = CONTAINED_PERCENT,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``top`` collocations of 2 to ``max_words`` words of each language:
    lang, rank (from 1), phrase, a, l, r, n, score."""
    found = cut(_occurrences(df, text, lang, max_words - 1, block_bytes), "occurrences")
    totals = found.where("group is null").groupBy("lang").agg(F.sum("n").alias("n"))
    words = found.where("group is not null")
    frequent = cut(_frequent(words, ["lang", "word"], min_count), "frequent")
    relation = cut(_thin(found.where("group is null").select("block", "own", "step", "code"), frequent, False), "relation")
    # a row per frequent phrase: its words and the counts of its first and last 1, 2, ... words
    level = cut(
        frequent.where("f is not null").select(
            "id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.col("f").alias("a"),
            F.array("f").alias("heads"), F.array("f").alias("tails"),
        ),
        "phrases",
    )
    totals = cut(totals, "totals")
    drop(found, frequent)
    candidates = []
    for k in range(2, max_words + 1):
        groups = _extend(relation)
        if k == max_words:  # the longest: counted, not extended
            counted = groups.groupBy("first", "second").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
            counted = counted.withColumn("id", F.lit(None).cast("long"))
            spent = [relation]
        else:
            frequent = cut(_frequent(groups, ["first", "second"], min_count), "frequent")
            thinner = cut(_thin(relation, frequent, True), "relation")
            counted = frequent.where("f is not null")
            spent = [relation, frequent]
            relation = thinner
        front = level.select(F.col("id").alias("first"), "lang", F.col("phrase").alias("front"), "heads")
        back = level.select(F.col("id").alias("second"), F.col("last"), "tails")
        above = cut(
            counted.join(front, "first").join(back, "second").select(
                "id", "first", "second", "lang",
                F.concat_ws(" ", "front", "last").alias("phrase"), "last", F.col("f").alias("a"),
                F.concat("heads", F.array("f")).alias("heads"), F.concat("tails", F.array("f")).alias("tails"),
            ),
            "phrases",
        )
        if k > 2:
            candidates.append(_uncontained(level, above, contained_percent, k - 1))
        drop(*spent)
        level = above
    candidates.append(_scored(level, max_words))
    every = candidates[0]
    for more in candidates[1:]:
        every = every.unionByName(more)
    best = top_k_per_group(every, ["lang"], [F.desc("score"), F.desc("a"), F.col("phrase")], top)
    return best.join(bounded_broadcast(totals, 10_000), "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )


def _scored(level: DataFrame, k: int) -> DataFrame:
    cuts = _lowest_cut(F.col("heads"), F.col("tails"), F.col("a"), k)
    return level.withColumn("cut", cuts).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def _uncontained(level: DataFrame, above: DataFrame, percent: int, k: int) -> DataFrame:
    """Scored phrases of k words but those that a phrase of one more word holds
    often enough (a still longer one that does makes one of k + 1 do so too)."""
    parts = above.select(F.explode(F.array("first", "second")).alias("id"), "a")
    longest = parts.groupBy("id").agg(F.max("a").alias("longer"))
    joined = level.join(longest, "id", "left")
    return _scored(joined.where(F.coalesce(100 * F.col("longer") < percent * F.col("a"), F.lit(True))).drop("longer"), k)


def oracle_sql() -> str:
    """The same by grouping all n-grams (two and three words)."""
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
lists AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM lists, (VALUES (1), (2), (3)) AS sizes(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= {MIN_COUNT}),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:c.k], ' ') AS tail
  FROM candidates c, (VALUES (1), (2)) AS places(j) WHERE j < c.k),
scores AS (
  SELECT c.*, h.f AS l, t.f AS r, (1000000 * c.a * c.a) // (h.f * t.f) AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head AND h.k = c.j
              JOIN f t ON t.lang = c.lang AND t.phrase = c.tail AND t.k = c.k - c.j),
lowest AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase, k ORDER BY score, j) = 1),
held AS (
  SELECT lang, part, max(a) AS longer FROM (
    SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part
    FROM candidates WHERE k = 3) GROUP BY ALL),
ranked AS (
  SELECT lowest.lang, phrase, a, l, r, score,
         row_number() OVER (PARTITION BY lowest.lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM lowest LEFT JOIN held ON held.lang = lowest.lang AND held.part = lowest.phrase AND lowest.k = 2
  WHERE held.longer IS NULL OR 100 * held.longer < {CONTAINED_PERCENT} * a)
SELECT ranked.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, totals.n, score::BIGINT AS score
FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= {TOP}
"""
