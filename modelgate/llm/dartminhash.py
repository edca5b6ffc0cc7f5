"""MinHash near-duplicates: DartMinHash signatures, banded joining, exact check.

A text is the set of its five-word shingles (words are lower-cased runs
without white space; a text of one to four words is one shingle). Every
element of weight ``w`` owns a region of height ``w`` on which darts fall as a
unit-rate Poisson process along the rank axis, all drawn from hashes of the
element. A set of total weight ``W`` looks at ranks up to ``t / W``, so that it
sees about ``t = k ln k + 2 k`` darts whatever its size; every dart belongs to
one of ``k`` coordinates by its hash and a coordinate's value is its dart of
earliest rank (Christiani, DartMinHash: Fast Sketching for Weighted Sets).
Sets for which a coordinate stays empty look twice as far. Two sets agree on a
coordinate with the probability of their (weighted) Jaccard similarity.

Candidates agree on a whole band of ``ROWS`` coordinates. Texts with equal
shingle sets are one node from the start. Shingles that only two candidates
hold give pairs of their own, which are compared; all other pairs can only have
in common what a node shares with more, so nodes and pairs for which
that is too little go (shingle counts over all candidates, exact). In each
band bucket all nodes are compared with one pivot, at first the one with the
fewest shingles of its own, which in a group of edited copies is the copied
text; links join components; only nodes of a bucket that still lie in different
components are then compared with each other. So a large group costs about as
many comparisons as it has members, and no candidate link between different
components is left untested. A link is a pair whose exact Jaccard similarity,
on the shingle sets of the whole texts, is ``THRESHOLD`` or more.

At similarity 0.8 a pair shares a band with probability 1 - (1 - 0.8**4)**32,
all but 5e-8. Nothing is capped or sampled.

Edge cases: null, empty and blank texts have no shingles and link with
nothing. Rows with a null id link with nothing and keep a null class. Rows
that repeat an id count as one document, linked as its texts are. Extra
columns are ignored here and carried by ``near_duplicate_free``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelgate.llm.common import U64, cut, drop, fresh, map_in_arrow, mix, quoted, text_slices, uniform, word_hashes, word_lists
from modelgate.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
COORDINATES = 128
ROWS = 4
#: Pivot rounds before the nodes that are left are compared with each other.
PIVOT_ROUNDS = 2


def shingle_sets(text: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, ordered by (row, hash): hashes
    and the rows they belong to."""
    import pyarrow.compute as pc

    words, rows = word_lists(pc.utf8_lower(text))
    if len(rows) == 0:
        return np.zeros(0, dtype=U64), rows
    h = word_hashes(words)
    sizes = np.bincount(rows, minlength=len(text))
    starts = np.cumsum(sizes) - sizes
    taken = np.minimum(np.maximum(sizes, 1), width)  # words in a row's shingles
    within = np.arange(len(h)) - starts[rows]
    lead = np.flatnonzero(within <= sizes[rows] - taken[rows])
    value = np.zeros(len(lead), dtype=U64)
    for j in range(width):
        ahead = np.minimum(lead + j, len(h) - 1)
        part = np.where(j < taken[rows[lead]], h[ahead], U64(0))
        value = mix(value * U64(0x9E3779B97F4A7C15) + part + U64(j + 1))
    owner = rows[lead]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    first = np.ones(len(value), dtype=bool)
    first[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[first], owner[first]


def dart_signatures(
    elements: np.ndarray, owners: np.ndarray, n: int, k: int = COORDINATES, weights: np.ndarray | None = None
) -> np.ndarray:
    """Signatures (n x k) of the weighted sets ``elements`` (hashes, grouped
    by owner 0..n-1; weights default to 1). Rows without elements are zero."""
    weights = np.ones(len(elements)) if weights is None else weights
    # a region is cut into cells of height one; the topmost may reach beyond the weight
    cells = np.ceil(weights).astype(np.int64)
    item = np.repeat(np.arange(len(elements)), cells)
    height = np.arange(len(item)) - np.repeat(np.cumsum(cells) - cells, cells)
    owner, roof = owners[item], weights[item] - height
    seed = mix(elements[item] + height.astype(U64) * U64(0xD1B54A32D192ED03))
    total = np.bincount(owners, weights=weights, minlength=n)
    out = np.zeros((n, k), dtype=U64)
    reach = np.zeros(n)
    reach[total > 0] = (k * math.log(k) + 2 * k) / total[total > 0]
    todo = total > 0
    while todo.any():
        best = np.full(n * k, np.inf)
        sign = np.zeros(n * k, dtype=U64)
        live = np.flatnonzero(todo[owner])
        rank = np.zeros(len(live))
        shot = 0
        while len(live):
            shot += 1
            dart = mix(seed[live] + U64(shot * 0x9E3779B97F4A7C15 % 2**64))
            rank = rank - np.log(uniform(dart))
            near = rank <= reach[owner[live]]
            live, rank, dart = live[near], rank[near], dart[near]
            hit = uniform(mix(dart ^ U64(0xA0761D6478BD642F))) < roof[live]
            at = owner[live[hit]] * k + (mix(dart[hit] ^ U64(0xE7037ED1A0B428DB)) % U64(k)).astype(np.int64)
            np.minimum.at(best, at, rank[hit])
            won = best[at] == rank[hit]
            sign[at[won]] = dart[hit][won]
        full = np.isfinite(best.reshape(n, k)).all(axis=1)
        done = todo & full
        out[done] = sign.reshape(n, k)[done]
        todo &= ~full
        reach *= 2
    return out


def band_keys(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band of ``rows`` coordinates (n x bands)."""
    n, k = signatures.shape
    key = np.repeat(np.arange(1, k // rows + 1, dtype=U64)[None, :], n, axis=0)
    grouped = signatures.reshape(n, k // rows, rows)
    for j in range(rows):
        key = mix(key * U64(0x9E3779B97F4A7C15) + grouped[:, :, j])
    return key


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _digests(value: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Two independent 64-bit sums of the elements of every set."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.append(U64(0), np.cumsum(mix(value ^ U64(salt)), dtype=U64))
        ends = np.cumsum(sizes)
        out.append((total[ends] - total[ends - sizes]).view(np.int64))
    return out


def signatures(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, set_a, set_b, size, bands) of the rows with an id and a word;
    set_a and set_b are a 128-bit digest of the shingle set."""
    source = df.where(quoted(doc_id).isNotNull()).select(quoted(doc_id).alias("id"), quoted(text).alias("text"))
    kind = source.schema["id"].dataType
    schema = T.StructType([
        T.StructField("id", kind), T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType()),
        T.StructField("size", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())),
    ])

    def run(batches):
        for part in text_slices(batches, "text"):
            n = part.num_rows
            value, owner = shingle_sets(part.column("text"))
            sizes = np.bincount(owner, minlength=n)
            has = np.flatnonzero(sizes)
            if len(has) == 0:
                continue
            digests = _digests(value, sizes)
            keys = band_keys(dart_signatures(value, owner, n))[has]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id").take(pa.array(has)),
                    pa.array(digests[0][has]),
                    pa.array(digests[1][has]),
                    pa.array(sizes[has].astype(np.int64)),
                    _lists(keys.ravel(), np.full(len(has), keys.shape[1])),
                ],
                names=schema.names,
            )

    return map_in_arrow(source, run, schema)


def shingles(df: DataFrame) -> DataFrame:
    """(node, set_a, set_b, text) to (node, shingles), the shingle set as a
    list of hashes, of the rows whose text has the digest they name."""
    schema = T.StructType([df.schema["node"], T.StructField("shingles", T.ArrayType(T.LongType()))])

    def run(batches):
        for part in text_slices(batches, "text"):
            value, owner = shingle_sets(part.column("text"))
            sizes = np.bincount(owner, minlength=part.num_rows)
            lists = _lists(value, sizes)
            digest = _digests(value, sizes)
            same = (digest[0] == part.column("set_a").to_numpy()) & (digest[1] == part.column("set_b").to_numpy())
            keep = pa.array(same & (sizes > 0))
            yield pa.RecordBatch.from_arrays([part.column("node").filter(keep), lists.filter(keep)], names=schema.names)

    return map_in_arrow(df, run, schema)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose exact Jaccard similarity reaches ``threshold``."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common >= threshold * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def near_links(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD
) -> tuple[DataFrame, DataFrame]:
    """(id, node) ties every id to the node of its shingle set, (node,
    component) gives the component of the nodes linked with another one."""
    signed = cut(signatures(df, doc_id, text), "signatures")
    nodes = cut(
        signed.groupBy("set_a", "set_b").agg(F.min("id").alias("rep"))
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    tied = signed.join(nodes, ["set_a", "set_b"])
    member = cut(tied.select("id", "node").distinct(), "member")
    first = tied.where(F.col("id") == F.col("rep")).dropDuplicates(["node"])
    entries = first.select("node", "size", F.explode("bands").alias("key"))
    every = cut(entries, "entries")
    shared = every.groupBy("key").agg(F.min("node").alias("m"), F.max("node").alias("x")).where("m != x")
    shared = cut(shared.select("key"), "shared")
    several_in = cut(every.join(shared, "key"), "entries")
    drop(every, shared)
    entries = several_in
    wanted = nodes.join(entries.select("node").distinct(), "node")
    texts = df.where(quoted(doc_id).isNotNull()).select(quoted(doc_id).alias("rep"), quoted(text).alias("text"))
    sets = cut(shingles(texts.join(wanted, "rep").select("node", "set_a", "set_b", "text")), "sets")

    # shingles that one or two candidates have, as counts per node (a = b) or pair
    rare = sets.select("node", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(
        F.count(F.lit(1)).alias("n"), F.min("node").alias("a"), F.max("node").alias("b")
    )
    rare = cut(rare.where("n <= 2 or a = b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "rare")
    mine = rare.select(F.col("a").alias("node"), "n").unionByName(rare.where("a != b").select(F.col("b").alias("node"), "n"))
    mine = mine.groupBy("node").agg(F.sum("n").alias("own"))
    # the pairs that share one of those are compared; all others share only the rest
    tested = rare.where("a != b").select("a", "b")
    found = cut(_verified(tested, sets, threshold), "found")
    entries = entries.join(mine, "node", "left").withColumn("shared", F.col("size") - F.coalesce("own", F.lit(0)))
    entries = cut(entries.where(F.col("shared") >= threshold * F.col("size")).select("node", "key", "size", "shared"), "entries")
    drop(several_in)

    # an id that occurs with several texts is one document: its nodes are linked
    several = member.groupBy("id").agg(F.min("node").alias("b"), F.max("node").alias("x")).where("b != x")
    links = member.join(several, "id").select(F.col("node").alias("a"), "b").unionByName(found)
    classes = cut(components(links), "classes")
    for turn in range(PIVOT_ROUNDS + 1):
        placed = entries.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
        placed, drop_later = cut(placed, "placed"), []
        order = [F.xxhash64("node")] if turn else [F.col("size") - F.col("shared"), F.xxhash64("node")]
        pivots = placed.groupBy("key").agg(
            F.min_by(F.struct("node", "component", "size", "shared"), F.struct(*order)).alias("p"),
            F.min("component").alias("low"), F.max("component").alias("high"),
        ).where("low != high")
        other = {"node": "n2", "component": "c2", "size": "s2", "shared": "h2"}
        pivots = chosen = cut(pivots.select("key", *[F.col(f"p.{x}").alias(y) for x, y in other.items()]), "pivots")
        if pivots.isEmpty():
            break
        if turn == PIVOT_ROUNDS:  # buckets still open: every node against those of other components
            drop_later.append(placed)
            placed = placed.join(pivots.select("key"), "key")
            keys = placed.groupBy("node").agg(F.collect_list("key").alias("keys"))  # one per band at most
            placed = cut(placed.join(keys, "node"), "open")
            pivots = placed.select("key", F.col("keys").alias("k2"), *[F.col(x).alias(y) for x, y in other.items()])
        # no more shingles can be common than either side shares with anyone
        most = F.least("shared", "h2")
        can = (most >= threshold * (F.col("size") + F.col("s2") - most)) & (
            F.least("size", "s2") >= threshold * F.greatest("size", "s2")
        )
        if turn == PIVOT_ROUNDS:  # once, in the first bucket that holds both
            can = (F.col("node") < F.col("n2")) & can & (F.array_min(F.array_intersect("keys", "k2")) == F.col("key"))
        pairs = placed.join(pivots, "key").where((F.col("component") != F.col("c2")) & can).select(
            F.least("node", "n2").alias("a"), F.greatest("node", "n2").alias("b")
        ).distinct()
        pairs = cut(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        drop(placed, chosen, *drop_later)
        tested = tested.unionByName(pairs)
        found = cut(_verified(pairs, sets, threshold), "found")
        if not found.isEmpty():
            classes = cut(_joined(classes, found), "classes")
    return member, classes


def _joined(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes`` (node, component) after joining the components that
    ``links`` connect. Only the links' own ends go through the contraction."""
    at = lambda end: classes.select(F.col("node").alias(end), F.col("component").alias(f"{end}_c"))
    ends = links.join(at("a"), "a", "left").join(at("b"), "b", "left")
    merged = components(ends.select(F.coalesce("a_c", "a").alias("a"), F.coalesce("b_c", "b").alias("b")))
    renamed = merged.select(F.col("node").alias("component"), F.col("component").alias("new"))
    old = classes.join(renamed, "component", "left").select("node", F.coalesce("new", "component").alias("component"))
    return old.unionByName(merged.join(classes.select("node"), "node", "left_anti"))


def near_duplicates(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per id of ``df`` that has a word: (id, class_id), the smallest
    id of the documents it is linked with, directly or through others."""
    member, classes = near_links(df, doc_id, text, threshold)
    placed = member.join(classes, "node", "left").select("id", F.coalesce("component", "node").alias("root")).distinct()
    placed = cut(placed, "classed")
    lowest = cut(placed.groupBy("root").agg(F.min("id").alias("class_id")), "lowest")
    return placed.join(lowest, "root").select("id", "class_id")


def near_duplicate_free(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df``, one document per class: that of the class's
    smallest id (of rows that repeat this id one stays, the first by its
    values). Rows without an id or without a word all stay."""
    names = fresh(df, "class__")
    classes = near_duplicates(df, doc_id, text, threshold).select(F.col("id").alias(names + "i"), F.col("class_id").alias(names))
    joined = df.join(classes, quoted(doc_id) == F.col(names + "i"), "left")
    kept = joined.where(F.col(names).isNull() | (F.col(names) == F.col(names + "i")))
    from pyspark.sql import Window

    rank = fresh(df, "rank__")
    order = [F.xxhash64(*[quoted(c) for c in df.columns])]
    numbered = kept.where(F.col(names).isNotNull()).withColumn(
        rank, F.row_number().over(Window.partitionBy(quoted(doc_id)).orderBy(*order))
    )
    only = numbered.where(F.col(rank) == 1).select(*[quoted(c) for c in df.columns])
    return only.unionByName(kept.where(F.col(names).isNull()).select(*[quoted(c) for c in df.columns]))
