"""Embedding near-duplicates: spherical k-means cells, blocked cosine products.

Vectors are scaled to length one in double precision. Spherical k-means,
fitted on a bounded sample (``SAMPLE`` vectors with the smallest hashes of
their ids), gives cell centres; their number follows the table's size, up to
``MAX_CELLS``. Every vector belongs to the cell of its nearest centre and is
also shown, as a guest, to the cells of lesser number that may be home to a
vector linked with it (see ``visits``: a bound, so no link is lost whatever the
centres are). Cells are parted by label.

Inside a cell, members are dealt to blocks of about ``BLOCK`` rows, members and
guests together to blocks of four times as many, and each pair of blocks is one
product of matrices, so that a large cell becomes many equal tasks. Of each
product only counts per vector and ties that hold its components together
leave the task, never the pairs. A link inside a cell is counted for either
member in its own block; one between two cells in the cell of lesser number,
for both. Components follow from the ties.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing, nor do those with a null label or a null id;
each still gives a row. Vectors of different lengths do not link. Rows that repeat an id
are vectors of their own that share a component; with copies of an id, n_links
counts the linked rows of other ids. Ties are links (the cosine is compared as
it is computed).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelgate.llm.common import cut, quoted
from modelgate.llm.components import components

THRESHOLD = 0.98
SAMPLE = 16_384
MAX_CELLS = 4_096
ROUNDS = 8
BLOCK = 1_024


def unit(vectors: list | np.ndarray) -> np.ndarray:
    x = np.asarray(vectors, dtype=np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Centres (unit length) of ``k`` cells at most."""
    k = max(1, min(k, len(x)))
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        home = np.concatenate([np.argmax(part @ centres.T, axis=1) for part in np.array_split(x, -(-len(x) // 4096))])
        total = np.zeros_like(centres)
        np.add.at(total, home, x)
        length = np.sqrt((total * total).sum(axis=1))
        moved = length > 1e-12  # a cell without members stays where it is
        centres[moved] = total[moved] / length[moved, None]
    return centres


def _valid(df: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """(id, label, v): the rows that can link, vectors as they are."""
    double = F.transform("v", lambda c: c.cast("double"))
    sound = F.forall(double, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    squares = F.aggregate(double, F.lit(0.0), lambda a, c: a + c * c)
    return (
        df.select(quoted(vec_id).alias("id"), quoted(label).alias("label"), quoted(vector).alias("v"))
        .where("id is not null and label is not null and v is not null")
        .where((F.size("v") > 0) & sound)
        .where((squares > 0) & (squares < float("inf")))
    )


def visits(x: np.ndarray, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home) of unit vectors: each one's home cell and the cells
    of lesser number in which it may have a link. A vector z linked with x is
    at most ``d`` away; if z's home is c then z.c >= z.h for x's home h, hence
    x.c - x.h >= -d |c - h|."""
    reach = np.sqrt(max(0.0, 2 - 2 * threshold))
    dots = x @ centres.T
    home = dots.argmax(axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * (centres @ centres.T)))
    near = dots - dots[np.arange(len(x)), home][:, None] >= -reach * apart[home] - 1e-9
    near &= np.arange(len(centres))[None, :] <= home[:, None]
    row, cell = np.nonzero(near)
    return row, cell, home[row]


def _cells(rows: DataFrame, centres: dict[int, np.ndarray], threshold: float, with_vectors: bool) -> DataFrame:
    """Every vector once per cell that it is in or visits: id, label, dim,
    cell, home and, if asked for, v."""
    schema = T.StructType(
        [rows.schema["id"], rows.schema["label"]]
        + [T.StructField(c, T.IntegerType()) for c in ("dim", "cell", "home")]
        + ([rows.schema["v"]] if with_vectors else [])
    )
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for batch in batches:
            lists = batch.column("v")
            offsets = lists.offsets.to_numpy(zero_copy_only=False)
            flat = lists.values.to_numpy(zero_copy_only=False)
            dims = np.diff(offsets)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                for part in np.array_split(at, -(-len(at) // 512)):
                    x = unit(flat[offsets[part][:, None] + np.arange(d)[None, :]])
                    # vectors of a length that no sample vector has share one cell
                    known = shared.value.get(int(d), np.ones((1, d)) / np.sqrt(d))
                    who, cell, home = visits(x, known, threshold)
                    take = pa.array(part[who])
                    numbers = [np.full(len(who), d), cell, home]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").take(take), batch.column("label").take(take)]
                        + [pa.array(z.astype(np.int32)) for z in numbers]
                        + ([lists.take(take)] if with_vectors else []),
                        names=schema.names,
                    )

    return rows.mapInArrow(run, schema)


def block_links(x, ids_x, y, ids_y, guest_y, threshold: float):
    """Links between members ``x`` of a cell and ``y``, members of it or
    guests: counts for the members and for the guests, and ties (pairs of ids
    of one component) that hold the components together."""
    linked = (x @ y.T) >= threshold
    linked &= ids_x[:, None] != ids_y[None, :]
    counts_x, counts_y = linked.sum(axis=1), linked.sum(axis=0)
    rows, columns = np.flatnonzero(counts_x), np.flatnonzero(counts_y)
    core = linked[np.ix_(rows, columns)]
    names, label = np.unique(np.concatenate([ids_x[rows], ids_y[columns]]), return_inverse=True)
    label_x, label_y = label[: len(rows)], label[len(rows) :]
    while core.size:  # the least name spreads along the links
        new_y = np.minimum(label_y, np.where(core, label_x[:, None], len(names)).min(axis=0))
        new_x = np.minimum(label_x, np.where(core, new_y[None, :], len(names)).min(axis=1))
        if (new_x == label_x).all() and (new_y == label_y).all():
            break
        label_x, label_y = new_x, new_y
    low = np.concatenate([label_x, label_y])
    ties = np.unique(np.stack([label, low], axis=1)[low != label], axis=0)
    return counts_x, np.where(guest_y, counts_y, 0), names[ties[:, 0]], names[ties[:, 1]]


def cosine_links(df: DataFrame, vec_id: str, vector: str, label: str, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(id, n) links counted per block, to be summed, and (a, b) ties."""
    rows = _valid(df, vec_id, vector, label)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().column("v").to_pylist()
    total = rows.count()
    centres = {}
    for d in sorted({len(v) for v in sample}):
        x = unit([v for v in sample if len(v) == d])
        centres[d] = spherical_kmeans(x, min(MAX_CELLS, max(1, int(np.sqrt(total)) // 2)))
    keys = ["label", "dim", "cell"]
    member = F.col("home") == F.col("cell")
    sizes = _cells(rows, centres, threshold, False).groupBy(*keys).agg(
        F.ceil(F.count_if(member) / BLOCK).cast("int").alias("blocks_m"),
        F.ceil(F.count(F.lit(1)) / (4 * BLOCK)).cast("int").alias("blocks_y"),
    ).where("blocks_m > 0")
    placed = _cells(rows, centres, threshold, True).join(cut(sizes, "sizes"), keys)
    deal = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    shape = [*keys, "id", "v", (F.col("home") != F.col("cell")).alias("guest")]
    # members of block p meet the rows (members again, and guests) of block q
    left = placed.where(member).select(*shape, deal(F.col("blocks_m")).alias("p"), every(F.col("blocks_y")).alias("q"), F.lit(True).alias("x"))
    right = placed.select(*shape, deal(F.col("blocks_y")).alias("q"), every(F.col("blocks_m")).alias("p"), F.lit(False).alias("x"))
    kind = rows.schema["id"].dataType.simpleString()

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable", ignore_index=True)
        first, second = pdf[pdf["x"]], pdf[~pdf["x"]]
        if not len(first) or not len(second):
            return pd.DataFrame({"a": pdf["id"][:0], "b": pdf["id"][:0], "n": np.zeros(0, dtype=np.int64)})
        ix, iy = first["id"].to_numpy(), second["id"].to_numpy()
        cx, cy, tie_a, tie_b = block_links(
            unit(np.stack(first["v"].to_list())), ix, unit(np.stack(second["v"].to_list())), iy,
            second["guest"].to_numpy(), threshold,
        )
        counted = [ix[cx > 0], iy[cy > 0]]
        a, b = np.concatenate([*counted, tie_a]), np.concatenate([*counted, tie_b])
        n = np.concatenate([cx[cx > 0], cy[cy > 0], np.zeros(len(tie_a), dtype=np.int64)])
        return pd.DataFrame({"a": a, "b": b, "n": n})

    found = left.unionByName(right).groupBy(*keys, "p", "q").applyInPandas(product, f"a {kind}, b {kind}, n long")
    found = cut(found, "products")
    return found.where("n > 0").select(F.col("a").alias("id"), "n"), found.where("n = 0").select("a", "b")


def near_duplicate_vectors(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD
) -> DataFrame:
    """Every row of ``df`` as (id, n_links, component_id, kept)."""
    counts, forest = cosine_links(df, vec_id, vector, label, threshold)
    counts = counts.groupBy("id").agg(F.sum("n").alias("n_links"))
    classes = components(forest).select(F.col("node").alias("id"), "component")
    ids = df.select(quoted(vec_id).alias("id"))
    joined = ids.join(counts, "id", "left").join(classes, "id", "left")
    return joined.select(
        "id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component", "id").cast("long").alias("component_id"),
        F.coalesce("component", "id").eqNullSafe(F.col("id")).alias("kept"),
    )


def oracle_sql(threshold: float = THRESHOLD) -> str:
    """The same rows of ``embeddings`` in DuckDB's SQL, by all pairs."""
    return f"""
    WITH RECURSIVE v AS MATERIALIZED (
      SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        AND list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)) > 0),
    links AS MATERIALIZED (
      SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= {threshold}),
    reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
    SELECT e.vec_id, coalesce(n.n, 0) AS n_links, m.y AS component_id, e.vec_id IS NOT DISTINCT FROM m.y AS kept
    FROM embeddings e LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) n ON n.x = e.vec_id
    LEFT JOIN (SELECT x, min(y) AS y FROM reach GROUP BY x) m ON m.x IS NOT DISTINCT FROM e.vec_id"""
