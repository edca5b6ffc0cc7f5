"""Quality rules: repeated text found with a suffix array of each document.

``repetition_stats`` adds, per document, base counts and what the suffix array
shows: the suffixes of the document's words are sorted by prefix doubling,
neighbours in that order share their longest common prefixes, and the
deepest longest-common-prefix interval of a suffix is the maximal repeated
substring that starts there. The spans of all maximal repeats of at least
``min_repeat`` words are united; a document is rejected when the union covers
more than ``max_covered`` of its words or when one repeat is longer than
``max_longest`` words. Repeats may overlap themselves ("la la la la").

Edge cases: null, empty and blank texts have no words, fail the base rule and
are not kept; a single very long text is processed whole, alone in a slice.
Repeated rows are judged one by one and give equal rows; null ids pass
through; extra columns, whatever their names, are carried along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelgate.llm.common import codes, fresh, map_in_arrow, quoted, text_slices, word_lists

#: Words in the windows of the base rule.
WINDOW = 3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Parameters of the suffix-array rule.
MIN_REPEAT = 10
MAX_COVERED = 0.30
MAX_LONGEST = 200
#: Text bytes that a worker sorts at once (a longer text alone): the levels of the
#: doubling hold four bytes a word each.
SLICE_BYTES = 2 << 20

#: Fixed by the base rule: the characters counted as symbols.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"


def common_prefixes(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each position of ``keys`` (grouped by ``rows``), the longest prefix
    (in items) of the suffix starting there that also starts another suffix of
    the same row.

    Prefix doubling: a group holds the suffixes of a row that agree on their
    first ``h`` items, its number is its place in suffix-array order. Only
    groups with several members are sorted on, by the group ``h`` items ahead.
    The groups of each level give the longest common prefix of neighbours in
    the finished order by binary lifting.
    """
    n = len(keys)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    last = np.searchsorted(rows, rows, side="right")  # end of each position's row
    order = np.argsort(rows * (int(keys.max()) + 1) + keys)
    new = np.empty(n, dtype=bool)
    new[0] = True
    new[1:] = (rows[order[1:]] != rows[order[:-1]]) | (keys[order[1:]] != keys[order[:-1]])
    starts = np.flatnonzero(new)
    group = np.empty(n, dtype=np.int32 if n < 1 << 31 else np.int64)
    sizes = np.diff(np.append(starts, n))
    group[order] = np.repeat(starts, sizes)
    levels, h = [group], 1
    active = np.flatnonzero(np.repeat(sizes > 1, sizes))  # places in the order, still tied
    while len(active):
        pos = order[active]
        ahead = pos + h
        inside = ahead < last[pos]
        nxt = np.full(len(pos), -1, dtype=np.int64)
        nxt[inside] = group[ahead[inside]]
        own = group[pos].astype(np.int64)
        by = np.argsort(own * (n + 1) + nxt + 1)
        pos, own, nxt = pos[by], own[by], nxt[by]
        order[active] = pos  # active places are ascending and groups contiguous
        first = np.empty(len(pos), dtype=bool)
        first[0] = True
        first[1:] = (own[1:] != own[:-1]) | (nxt[1:] != nxt[:-1])
        at = np.flatnonzero(first)
        size = np.diff(np.append(at, len(pos)))
        group = group.copy()
        group[pos] = np.repeat(active[at], size)
        levels.append(group)
        active = active[np.repeat(size > 1, size)]
        h *= 2
    shared = np.zeros(n, dtype=np.int64)
    pairs = np.flatnonzero(rows[order[1:]] == rows[order[:-1]])
    a, b = order[pairs], order[pairs + 1]
    length = np.zeros(len(a), dtype=np.int64)
    live = np.arange(len(a))
    same = levels[0][a] == levels[0][b]
    live = live[same]
    for k in range(len(levels) - 1, -1, -1):
        x, y = a[live] + length[live], b[live] + length[live]
        ok = (x < last[a[live]]) & (y < last[b[live]])
        x, y = np.where(ok, x, 0), np.where(ok, y, 0)
        # equal groups at level k agree on 2**k items, if both suffixes hold as many
        eq = ok & (levels[k][x] == levels[k][y])
        length[live[eq]] += 1 << k
    np.maximum.at(shared, a, length)
    np.maximum.at(shared, b, length)
    return shared


def covered(shared: np.ndarray, rows: np.ndarray, n_rows: int, at_least: int, span: int | None = None) -> np.ndarray:
    """Items per row inside the union of the spans that start where ``shared``
    is ``at_least`` or more; spans are ``span`` long, by default ``shared``."""
    hit = np.flatnonzero(shared >= at_least)
    edge = np.zeros(len(shared) + 1, dtype=np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + (shared[hit] if span is None else span), -1)
    inside = np.cumsum(edge[:-1]) > 0
    return np.bincount(rows[inside], minlength=n_rows).astype(np.int64)


def _measure(text: pa.Array, min_repeat: int) -> dict[str, np.ndarray]:
    n = len(text)
    words, rows = word_lists(text)
    keys, _ = codes(words)
    shared = common_prefixes(keys, rows)
    longest = np.zeros(n, dtype=np.int64)
    np.maximum.at(longest, rows, shared)
    return {
        "n_words": np.bincount(rows, minlength=n).astype(np.int64),
        "n_repeat_words": covered(shared, rows, n, WINDOW, WINDOW),
        "covered_words": covered(shared, rows, n, min_repeat),
        "longest_repeat": longest,
    }


def _judge(
    df: DataFrame, text: str, min_repeat: int, max_covered: float, max_longest: int, keep: list[str], kept_only: bool
) -> tuple[DataFrame, list[Column]]:
    """``keep`` columns and the measures of every row, or of the kept rows
    only, under the returned names. The text goes to the worker once, and comes
    back only if it is one of the ``keep`` columns."""
    mark = fresh(df, "body__")
    raw = F.coalesce(quoted(text), F.lit(""))
    lines = F.filter(F.split(raw, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    counts = {
        "word_chars": F.length(F.translate(raw, SPACES, "")).cast("long"),
        "n_symbols": (F.length(raw) - F.length(F.translate(raw, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }
    if kept_only:
        counts = {}
    carried = text in keep
    source = df.select(
        *[quoted(c) for c in keep],
        *([] if carried else [quoted(text).alias(mark)]),
        *[c.alias(f"{mark}{name}") for name, c in counts.items()],
    )
    body = text if carried else mark
    measured = ["n_words", "n_repeat_words", "covered_words", "longest_repeat"]
    kinds = [] if kept_only else [(m, T.LongType()) for m in measured] + [(m, T.BooleanType()) for m in ("base_failed", "kept")]
    schema = T.StructType(
        [f for f in source.schema.fields if carried or f.name != mark] + [T.StructField(mark + m, t) for m, t in kinds]
    )

    def run(batches):
        for part in text_slices(batches, body, SLICE_BYTES):
            found = _measure(part.column(body), min_repeat)
            words = found["n_words"]
            failed = (words < MIN_WORDS) | (100 * found["n_repeat_words"] > MAX_REPEAT_PERCENT * words)
            fine = ~failed & (found["covered_words"] <= max_covered * words) & (found["longest_repeat"] <= max_longest)
            if kept_only:
                if fine.any():
                    yield part.filter(pa.array(fine))
                continue
            found |= {"base_failed": failed, "kept": fine}
            names = [c for c in part.schema.names if carried or c != mark]
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in names] + [pa.array(found[m]) for m, _ in kinds], names=names + [mark + m for m, _ in kinds]
            )

    order = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat",
             "base_failed", "kept"]
    return map_in_arrow(source, run, schema), [] if kept_only else [F.col(mark + m).alias(m) for m in order]


def repetition_stats(
    df: DataFrame,
    text: str = "text",
    min_repeat: int = MIN_REPEAT,
    max_covered: float = MAX_COVERED,
    max_longest: int = MAX_LONGEST,
    keep: list[str] | None = None,
) -> DataFrame:
    """``df`` (all its columns, or those in ``keep``) plus one struct column
    ``quality`` with n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, covered_words, longest_repeat, base_failed, kept. A map
    over the rows: no shuffle."""
    keep = df.columns if keep is None else keep
    out, fields = _judge(df, text, min_repeat, max_covered, max_longest, keep, kept_only=False)
    return out.select(*[quoted(c) for c in keep], F.struct(*fields).alias(fresh(df, "quality")))


def keep_quality(
    df: DataFrame,
    text: str = "text",
    min_repeat: int = MIN_REPEAT,
    max_covered: float = MAX_COVERED,
    max_longest: int = MAX_LONGEST,
) -> DataFrame:
    """Rows of ``df`` that pass the rules, with the columns of ``df``; the
    others do not leave the worker."""
    return _judge(df, text, min_repeat, max_covered, max_longest, df.columns, kept_only=True)[0]
