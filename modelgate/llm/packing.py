"""Best-fit-decreasing packing of tokenised documents into sequences.

Every text becomes the ids of a public tokenizer followed by one separator.
Texts longer than a sequence are cut into full pieces and a rest; all others
stay whole. Pieces of equal length are interchangeable, so the packing is
decided on the table of lengths and their counts, at most ``SEQUENCE`` rows
whatever the input: lengths descending, each piece goes into the open bin with
the least room that still holds it, which a segment tree over the remaining
capacities finds in logarithmic time; a run of equal pieces meeting a run of
equal bins is placed in one step, exactly as one by one. The resulting plan (runs of
pieces to runs of bins) has at most about ``SEQUENCE**2`` rows.

In Spark, the texts are tokenised once into a written table of pieces; every
piece gets its rank among those of its length from counts per (length, salt)
and a row number within it, and looks its place up in the plan.

Tokenising splits a text at ASCII white space, which the tokenizer drops, and
between a letter and closing punctuation; the tokenizer always splits there. Of
the units left, every distinct one is encoded once per worker (the table of
known units is bounded and restarted when full): words of plain Latin letters,
lower-cased, by the tokenizer's model alone, any other by the whole tokenizer.

Edge cases: null and empty texts are one separator. Null ids and repeated rows
are packed like all others, a row at a time; equal rows are interchangeable.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelgate.llm.common import cut, fresh, map_in_arrow, quoted, text_slices

SEQUENCE = 2048
SEPARATOR = 0
#: Parts that the pieces of one length are ranked in.
SALTS = 64
#: Distinct units a worker remembers.
KNOWN_WORDS = 1_000_000
#: Text bytes a worker tokenises at once.
SLICE = 8 << 20
#: Fixed by the vocabulary: the special token that keeps joined words apart.
BOUNDARY = "<|endoftext|>"

#: ASCII punctuation that a word is parted from (no apostrophe: the tokenizer
#: has rules for what follows one).
CLOSING = ".,;:!?#*$%&()[]"
BLANKS = b"\t\n\x0b\x0c\r "
#: Kinds of bytes; only a letter and closing punctuation sum up to PARTED.
OTHER, CLOSE, LETTER = 0, 1, 2
PARTED = CLOSE + LETTER
_IS_BLANK = bytes(i in BLANKS for i in range(256))
_KIND = bytes(CLOSE if chr(i) in CLOSING else LETTER if chr(i).isalpha() and i < 128 else OTHER for i in range(256))
_LOWER = bytes(range(256)).lower()

_WORKER: dict = {}


def _bytes_of(text: pa.Array) -> tuple[bytes, np.ndarray]:
    """UTF-8 of all texts and where in it each begins and the last ends."""
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, dtype=np.int64)
    raw = data.slice(at[0], at[-1] - at[0]).to_pybytes() if at[-1] > at[0] else b""
    return raw, at - at[0]


def _latin(raw: bytes) -> np.ndarray:
    """Second bytes of the letters U+00C0 to U+00FF: as they are, or with a
    mark after them, they are letters in every normal form."""
    second = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 0xC3) + 1
    sign = np.frombuffer(raw, dtype=np.uint8)[second]
    return second[(sign != 0x97) & (sign != 0xB7)]


def _kinds(raw: bytes, latin: np.ndarray) -> np.ndarray:
    kind = np.frombuffer(bytearray(raw.translate(_KIND)), dtype=np.uint8)
    kind[latin] = kind[latin - 1] = LETTER
    return kind


def kinds(units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The kind of every byte of the units, and where each unit begins."""
    raw, at = _bytes_of(units)
    return _kinds(raw, _latin(raw)), at[:-1]


def text_units(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The units of all texts (null: none), one after another, and how many there
    are up to the end of each text. Units of letters alone are lower-cased; all
    others keep their case, which a special token or a mark may depend on."""
    raw, rows = _bytes_of(pc.fill_null(text, "").cast(pa.large_string()))
    blank = np.flatnonzero(np.frombuffer(raw.translate(_IS_BLANK), dtype=bool))
    rows = rows - np.searchsorted(blank, rows)
    raw = raw.translate(None, BLANKS)
    latin = _latin(raw)
    kind = _kinds(raw, latin)
    body = np.frombuffer(raw, dtype=np.uint8)
    cuts = np.zeros(len(body) + 1, dtype=bool)  # the last one is the end
    cuts[1:-1] = kind[:-1] + kind[1:] == PARTED
    cuts[blank - np.arange(len(blank))] = cuts[rows] = cuts[-1] = True
    cuts = np.flatnonzero(cuts)
    begin = cuts[:-1]
    lower = np.frombuffer(bytearray(raw.translate(_LOWER)), dtype=np.uint8)
    lower[latin[body[latin] < 0x9F]] += 0x20
    mixed = np.logical_or.reduceat(kind != LETTER, begin) if len(begin) else np.zeros(0, dtype=bool)
    np.copyto(lower, body, where=np.repeat(mixed, np.diff(cuts)))
    units = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(cuts), pa.py_buffer(lower))
    return units, np.searchsorted(begin, rows[1:])


class WordTokenizer:
    """Token ids of texts, from the ids of their units: words without blanks,
    cut wherever a letter and closing punctuation meet."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit, Sequence

        self.tokenizer = Tokenizer.from_file(path)
        self.boundary = self.tokenizer.token_to_id(BOUNDARY)
        # lower-case letters need no normaliser and no pattern, and each word's last token says so
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = Sequence([CharDelimiterSplit(" "), ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = self.tokenizer.model.end_of_word_suffix
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.reset()

    def reset(self) -> None:
        # unit 0 is the separator; no unit has a blank in it
        self.known = pa.array([" "], pa.large_string())
        self.ends = np.array([0, 1], dtype=np.int64)
        self.ids = np.array([SEPARATOR], dtype=np.uint32)

    def _encode_letters(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of units of lower-case letters alone."""
        joined = [" ".join(units[i : i + 256]) for i in range(0, len(units), 256)]
        found = self.letters.encode_batch_fast(joined, add_special_tokens=False)
        ids = np.concatenate([np.asarray(f.ids, dtype=np.uint32) for f in found])
        ends = np.flatnonzero(self.last[ids])
        if len(ends) != len(units) or ends[-1] != len(ids) - 1:
            raise ValueError("the tokenizer does not mark the ends of words")
        return np.diff(ends, prepend=-1), ids

    def _encode_plain(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of any units by the tokenizer itself, many at a time: the
        special token is split off before all else, so joined units stay apart."""
        joined = [BOUNDARY.join(units[i : i + 256]) for i in range(0, len(units), 256)]
        parts, sizes = [], []
        for i, found in enumerate(self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.asarray(found.ids, dtype=np.uint32)
            ends = np.append(np.flatnonzero(ids == self.boundary), len(ids))
            if len(ends) != min(256, len(units) - 256 * i):
                raise ValueError("the tokenizer does not keep the separator token apart")
            sizes.append(np.diff(np.append(-1, ends)) - 1)
            parts.append(ids[ids != self.boundary])
        return np.concatenate(sizes), np.concatenate(parts)

    def _learned(self, units: pa.Array, n: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The first ``n`` known units and after them new ones, those of letters
        alone first; where the ids of each begin and the last's end; the ids."""
        kind, begin = kinds(units)
        pure = np.logical_and.reduceat(kind == LETTER, begin)
        special = pc.or_(pc.match_substring(units, "<|"), pc.match_substring(units, "|>")).to_numpy(zero_copy_only=False)
        order, sizes, ids = [self.known[:n]], [np.diff(self.ends[: n + 1])], [self.ids[: self.ends[n]]]
        for mask, encode in ((pure, self._encode_letters), (~pure & ~special, self._encode_plain)):
            some = units.filter(pa.array(mask))
            if len(some):
                size, found = encode(some.to_pylist())
                order.append(some)
                sizes.append(size)
                ids.append(found)
        some = units.filter(pa.array(special))
        for unit in some.to_pylist():  # perhaps a special token's own string
            found = np.asarray(self.tokenizer.encode(unit, add_special_tokens=False).ids, dtype=np.uint32)
            sizes.append(np.array([len(found)]))
            ids.append(found)
        return pa.concat_arrays([*order, some]), np.append(0, np.cumsum(np.concatenate(sizes))), np.concatenate(ids)

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, each with its separator, and their counts."""
        units, rows = text_units(text)
        if len(self.known) > KNOWN_WORDS:
            self.reset()
        # known units are distinct and come first, so a known unit's code is its place;
        # a small batch does without those learned last, which are the rare ones
        n = min(len(self.known), max(1, 2 * len(units)))
        codes = pa.concat_arrays([self.known[:n], units]).dictionary_encode()
        place = codes.indices.to_numpy(zero_copy_only=False)[n:]
        new = codes.dictionary[n:]
        ends, ids = self.ends, self.ids
        if len(new):
            known, ends, ids = self._learned(new, n)
            moved = pc.index_in(new, known[n:]).to_numpy(zero_copy_only=False) + n
            place = np.append(np.arange(n), moved)[place]
            if n == len(self.known):
                self.known, self.ends, self.ids = known, ends, ids
        lists = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(ids)).take(pa.array(np.insert(place, rows, 0)))
        # a row's units are followed by its separator, so its tokens end there
        closing = lists.offsets.to_numpy(zero_copy_only=False)[rows + np.arange(1, len(rows) + 1)]
        return lists.flatten().to_numpy(zero_copy_only=False), np.diff(closing, prepend=0)


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _WORKER:
        _WORKER[path] = WordTokenizer(path)
    return _WORKER[path]


def pieces(
    df: DataFrame, tokenizer_path: str, text: str = "text", sequence: int = SEQUENCE, with_ids: bool = True, slice_bytes: int = SLICE
) -> DataFrame:
    """Every row of ``df`` without its text, once per piece: columns piece,
    start, length, ids_crc32 and, if asked for, the ids."""
    names = {c: fresh(df, c) for c in ("piece", "start", "length", "ids_crc32", "ids")}
    body = fresh(df, "body__")
    carried = [c for c in df.columns if c != text]
    source = df.select(*[quoted(c) for c in carried], quoted(text).alias(body))
    made = [
        T.StructField(names["piece"], T.IntegerType()), T.StructField(names["start"], T.LongType()),
        T.StructField(names["length"], T.LongType()), T.StructField(names["ids_crc32"], T.LongType()),
    ] + ([T.StructField(names["ids"], T.ArrayType(T.IntegerType()))] if with_ids else [])
    schema = T.StructType([f for f in source.schema.fields if f.name != body] + made)

    def run(batches):
        coder = _tokenizer(tokenizer_path)
        for part in text_slices(batches, body, slice_bytes):
            ids, counts = coder.encode(part.column(body))
            n_pieces = -(-counts // sequence)
            row = np.repeat(np.arange(len(counts)), n_pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
            start = piece * sequence
            length = np.minimum(counts[row] - start, sequence)
            begin = (np.cumsum(counts) - counts)[row] + start
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = np.fromiter(
                (zlib.crc32(raw[4 * b : 4 * (b + n)]) for b, n in zip(begin.tolist(), length.tolist(), strict=True)),
                dtype=np.int64, count=len(row),
            )
            take = pa.array(row)
            arrays = [part.column(i).take(take) for i, c in enumerate(part.schema.names) if c != body]
            arrays += [pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
            if with_ids:
                offsets = np.append(0, np.cumsum(length)).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.view(np.int32))))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return map_in_arrow(source, run, schema)


class CapacityTree:
    """Segment tree over the capacities 0..size: how many open bins have each
    remaining capacity, and the least capacity of at least ``need`` in use."""

    def __init__(self, size: int):
        self.leaves = 1 << (size + 1).bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, bins: int) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += bins
            at >>= 1

    def tightest(self, need: int) -> int | None:
        at = need + self.leaves
        if self.count[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


@dataclass
class Plan:
    """Runs of pieces: those of ``length`` with rank first..first+count-1 go
    ``per_bin`` to a bin, from bin ``bin`` on, the first at ``offset``."""

    length: np.ndarray
    first: np.ndarray
    count: np.ndarray
    bin: np.ndarray
    per_bin: np.ndarray
    offset: np.ndarray
    bins: int


def best_fit_decreasing(counts: dict[int, int], sequence: int = SEQUENCE) -> Plan:
    """Pack ``counts`` (length to number of pieces) into bins of ``sequence``."""
    tree = CapacityTree(sequence)
    runs: dict[int, list[list[int]]] = {}  # remaining capacity -> [first bin, bins]
    rows: list[tuple[int, int, int, int, int, int]] = []
    bins = 0

    def open_run(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            runs.setdefault(capacity, []).append([first, n])
            tree.add(capacity, n)

    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:  # as many new bins as the rest fills, their rooms are equal
                per = sequence // length
                start, n = bins, -(-left // per)
                bins += n
                room = sequence
            else:
                per = room // length
                start, have = runs[room][-1]
                n = min(have, -(-left // per))
                tree.add(room, -n)
                if n == have:
                    runs[room].pop()
                else:
                    runs[room][-1] = [start + n, have - n]
            placed = min(left, n * per)
            rows.append((length, rank, placed, start, per, sequence - room))
            full, rest = divmod(placed, per)
            open_run(room - per * length, start, full)
            if rest:
                open_run(room - rest * length, start + full, 1)
            left -= placed
            rank += placed
    columns = np.array(rows, dtype=np.int64).reshape(-1, 6).T
    return Plan(*columns, bins=bins)


def place(plan: Plan, length: np.ndarray, rank: np.ndarray, sequence: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of pieces given by length and rank within it."""
    # runs are listed by descending length and ascending rank
    width = int(max(plan.first.max(initial=0), rank.max(initial=0))) + 1
    key = (sequence - plan.length) * width + plan.first
    run = np.searchsorted(key, (sequence - length) * width + rank, side="right") - 1
    step = rank - plan.first[run]
    return plan.bin[run] + step // plan.per_bin[run], plan.offset[run] + (step % plan.per_bin[run]) * length


def pack(
    df: DataFrame, tokenizer_path: str, text: str = "text", sequence: int = SEQUENCE, with_ids: bool = True, slice_bytes: int = SLICE
) -> DataFrame:
    """The pieces of all rows of ``df`` with two more columns, sequence_id and
    offset: the place of the piece in the packed sequences. ``slice_bytes`` of
    text are tokenised at once; fewer take less memory beside the executor's heap."""
    names = {c: fresh(df, c) for c in ("piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset")}
    cut_up = cut(pieces(df, tokenizer_path, text, sequence, with_ids, slice_bytes), "pieces")
    length = quoted(names["length"])
    # the salt spreads a length's pieces; the order within it is that of the rows' values
    salt, rank, before = fresh(cut_up, "salt__"), fresh(cut_up, "rank__"), fresh(cut_up, "before__")
    values = [quoted(f.name) for f in cut_up.schema.fields if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.VariantType))]
    salted = cut_up.withColumn(salt, F.pmod(F.xxhash64(*values), F.lit(SALTS)).cast("int"))
    # at most sequence * SALTS rows, whatever the input
    table_ = salted.groupBy(length.alias("length"), F.col(salt).alias("salt")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    table_ = table_.sort_values(["length", "salt"], ignore_index=True)
    plan = best_fit_decreasing({int(k): int(v) for k, v in table_.groupby("length")["n"].sum().items()}, sequence)
    start = np.zeros((sequence + 1, SALTS), dtype=np.int64)
    start[table_["length"], table_["salt"]] = table_.groupby("length")["n"].cumsum() - table_["n"]
    order = [F.xxhash64(*values, F.lit(1)), *values[:1]]
    ranked = salted.withColumn(rank, F.row_number().over(Window.partitionBy(length, salt).orderBy(*order)).cast("long") - 1)
    shared = df.sparkSession.sparkContext.broadcast((plan, start))
    out = [T.StructField(names["sequence_id"], T.LongType()), T.StructField(names["offset"], T.LongType())]
    schema = T.StructType(list(cut_up.schema.fields) + out)
    name = names["length"]

    def run(batches):
        found, first = shared.value
        for batch in batches:
            n = batch.column(name).to_numpy()
            bins, offset = place(found, n, batch.column(rank).to_numpy() + first[n, batch.column(salt).to_numpy()], sequence)
            kept = [batch.column(i) for i, c in enumerate(batch.schema.names) if c not in (salt, rank)]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(bins), pa.array(offset)], names=schema.names)

    return map_in_arrow(ranked, run, schema)
