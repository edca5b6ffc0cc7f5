"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelgate.session import cut_lineage, drop_table

#: Text bytes a worker handles at once; a longer text is handled alone.
SLICE_BYTES = 4 << 20

U64 = np.uint64


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back."""
    return cut_lineage(df, df.sparkSession, f"llm-{name}")


def drop(*tables: DataFrame) -> None:
    """Delete tables of ``cut`` that nothing reads any more."""
    drop_table(*tables)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that does not clash with those of ``df`` (names are
    compared without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def quoted(name: str) -> Column:
    """Column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def release() -> None:
    """Give freed memory back to the system. A Python worker outlives its task and
    stands beside the executor's heap, which the next stage may need whole."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def map_in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` for columns of any name (it reads a dot in a name as a
    field of a struct, so the columns go in under plain names)."""
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])

    def renamed(batches):
        try:
            yield from run(b.rename_columns(names) for b in batches)
        finally:
            release()

    return plain.mapInArrow(renamed, schema)


def text_slices(batches, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Split Arrow batches into slices of at most ``limit`` bytes of text (a
    single longer text makes a slice of its own)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start, n = 0, len(sizes)
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def word_lists(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text (null: none): the flat
    words and for each of them the row it is in, in text order."""
    lists = pc.ascii_split_whitespace(pc.fill_null(text, ""))
    words = lists.flatten()
    rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    empty = pc.equal(pc.binary_length(words), 0)
    if pc.any(empty).as_py():
        keep = pc.invert(empty)
        words, rows = words.filter(keep), rows[keep.to_numpy(zero_copy_only=False)]
    return words, rows.astype(np.int64)


def codes(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Dictionary codes of the words and the distinct words."""
    enc = words.dictionary_encode()
    return enc.indices.to_numpy(zero_copy_only=False).astype(np.int64), enc.dictionary


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (SplitMix64): bijective and well mixed."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of every word; distinct words are hashed once."""
    import xxhash

    idx, distinct = codes(words)
    digest = xxhash.xxh3_64_intdigest
    table_ = np.fromiter((digest(w) for w in distinct.cast(pa.binary()).to_pylist()), dtype=U64, count=len(distinct))
    return table_[idx]


def uniform(x: np.ndarray) -> np.ndarray:
    """Hashes to doubles in the open interval (0, 1)."""
    return ((x >> U64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))
