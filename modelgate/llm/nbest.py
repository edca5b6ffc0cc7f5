"""SentencePiece N-best segmentation and decoding.

A text is normalised as its model asks (a space mark before it, spaces become
space marks) and cut into stretches that no piece of the vocabulary reaches
across: before every run of space marks, between neighbours that no piece holds
side by side, and around characters that are in no piece. On the lattice of all pieces that match inside a stretch, a forward Viterbi
pass gives the best score of every prefix. Read backwards these scores are exact
heuristics of what is left, so the A* search from the stretch's end knows the
final score of every partial segmentation: its agenda never needs more than
``n`` entries, and what it completes is the exact N-best list. The N-best
segmentations of the whole text follow from those of its stretches: each
differs from the best one in the cheapest few exchanges, found exactly.

A piece's score is the one stored in the model file; a character without a
piece costs ten more than the worst piece and becomes its UTF-8 bytes'
pieces. Decoding joins the pieces' bytes and takes the first space away.

All distinct stretches of a slice of texts are segmented together, in arrays; a
worker remembers those it has seen in a bounded table.

Among equal scores the order is fixed: within a stretch that of the agenda,
between stretches the earlier exchange first. Texts with fewer than ``n``
segmentations give fewer rows. Null and empty texts have one segmentation,
without pieces. Null ids and repeated rows are segmented like all others.
"""

from __future__ import annotations

import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelgate.llm.common import fresh, map_in_arrow, quoted, text_slices

#: Segmentations per text.
BEST = 4
#: Distinct stretches that a worker remembers, and text bytes it handles at once.
KNOWN = 600_000
SLICE = 8 << 20
#: Distinct stretches whose agendas are advanced together.
GROUP = 20_000
MARK = "▁"

_WORKER: dict = {}


class Vocabulary:
    """Pieces of a SentencePiece model as a trie in arrays."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = f"a  b\t \n{MARK}c "
        if model.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("the model's normaliser changes more than spaces")
        size = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(size)]
        self.scores = np.array([model.get_score(i) for i in range(size)], dtype=np.float64)
        names = [model.id_to_piece(i) for i in range(size)]
        self.byte_id = np.zeros(256, dtype=np.int64)
        surface: list[bytes] = []
        plain: dict[str, int] = {}
        for i, name in enumerate(names):
            if model.is_byte(i):
                value = int(name[3:5], 16)
                self.byte_id[value] = i
                surface.append(bytes([value]))
            elif special[i]:
                surface.append(b"")
            else:
                surface.append(name.replace(MARK, " ").encode())
                plain.setdefault(name, i)
        if any(MARK in name.lstrip(MARK) for name in plain):
            raise ValueError("pieces of the model reach across spaces")
        self.unknown = float(min(self.scores[i] for i in plain.values())) - 10.0
        self.size = size
        self.bytes_at = np.cumsum([0] + [len(b) for b in surface])
        self.bytes = np.frombuffer(b"".join(surface), dtype=np.uint8)
        # neighbours that no piece holds side by side (ASCII): a stretch ends between them
        self.parted = np.ones((256, 256), dtype=bool)
        self.parted[128:, :] = self.parted[:, 128:] = False
        for name in plain:
            for a, b in zip(name.replace(MARK, " "), name.replace(MARK, " ")[1:], strict=False):
                if a < "\x80" and b < "\x80":
                    self.parted[ord(a), ord(b)] = False
        used = set("".join(plain))
        self.alone = np.array([b < 128 and chr(b) not in used and b != 32 for b in range(256)])
        # trie: nodes numbered from 0, the root; edges sorted by (node, character)
        nodes: dict[tuple[int, int], int] = {}
        terminal = {}
        for name, i in plain.items():
            at = 0
            for c in name:
                at = nodes.setdefault((at, ord(c)), len(nodes) + 1)
            terminal[at] = i
        keys = np.array([(a << 21) | c for a, c in nodes], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], np.array(list(nodes.values()), dtype=np.int64)[order]
        self.piece = np.full(len(nodes) + 1, -1, dtype=np.int64)
        self.piece[list(terminal)] = list(terminal.values())

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Children (0: none) of trie nodes by a character."""
        key = (node << 21) | char
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.child[at], 0)

    def lattice(self, chars: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All matches in stretches laid out one after another (``stop``: the
        end of each character's stretch) as (start, end, piece); piece -1 is
        a character without one."""
        starts, ends, pieces = [], [], []
        at, node, depth = np.arange(len(chars)), np.zeros(len(chars), dtype=np.int64), 0
        single = np.zeros(len(chars), dtype=bool)
        while len(at):
            node = self.step(node, chars[at + depth])
            depth += 1
            on = node > 0
            at, node = at[on], node[on]
            found = self.piece[node]
            hit = found >= 0
            starts.append(at[hit])
            ends.append(at[hit] + depth)
            pieces.append(found[hit])
            if depth == 1:
                single[at[hit]] = True
            more = at + depth < stop[at]
            at, node = at[more], node[more]
        lone = np.flatnonzero(~single)
        return (
            np.concatenate([*starts, lone]), np.concatenate([*ends, lone + 1]),
            np.concatenate([*pieces, np.full(len(lone), -1)]),
        )

    def segment(self, words: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """N-best segmentations of stretches: scores (words x n, -inf: none),
        numbers of pieces (words x n) and pieces (words x n x most)."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        total = len(chars)
        base = np.cumsum(size) - size
        stop = np.repeat(base + size, size)
        # a stretch of m characters has m + 1 places; its place 0 stands at base + its number
        shift = np.repeat(np.arange(len(words)), size)
        start, end, piece = self.lattice(chars, stop)
        word = shift[start]
        start, end = start + word, end + word
        cost = np.where(piece >= 0, self.scores[piece], self.unknown)
        first = base + np.arange(len(words))
        last = first + size
        places = total + len(words)
        # forward Viterbi, by the end's place in its stretch
        best = np.full(places, -np.inf)
        best[first] = 0.0
        by = np.lexsort((start, end - first[word]))
        cuts = np.flatnonzero(np.diff((end - first[word])[by])) + 1
        for part in np.split(by, cuts):
            np.maximum.at(best, end[part], best[start[part]] + cost[part])
        # lattice edges by the place they end at
        by = np.lexsort((start, end))
        start, piece, cost = start[by], piece[by], cost[by]
        degree = np.bincount(end, minlength=places)
        pointer = np.cumsum(degree) - degree
        most = int(size.max(initial=0))
        out_score = np.full((len(words), n), -np.inf)
        out_count = np.zeros((len(words), n), dtype=np.int64)
        out_piece = np.zeros((len(words), n, most), dtype=np.int32)
        width = int(degree.max(initial=1))
        lane = np.arange(width)
        # the agenda: per stretch at most n partial segmentations, read from the end
        who = np.flatnonzero(size)
        place = np.full((len(who), n), -1)
        place[:, 0] = last[who]
        spent = np.zeros((len(who), n))
        final = np.full((len(who), n), -np.inf)
        final[:, 0] = best[last[who]]
        path = np.zeros((len(who), n, most), dtype=np.int32)
        count = np.zeros((len(who), n), dtype=np.int64)
        while len(who):
            open_ = (place >= 0) & (place != first[who][:, None])
            done = ~open_.any(axis=1)
            if done.any():
                out_score[who[done]], out_count[who[done]], out_piece[who[done]] = final[done], count[done], path[done]
                keep = ~done
                who, place, spent, final, path, count, open_ = (x[keep] for x in (who, place, spent, final, path, count, open_))
                if not len(who):
                    break
            at = np.where(open_, place, 0)
            edge = np.minimum(pointer[at][:, :, None] + lane, len(start) - 1)
            there = open_[:, :, None] & (lane < degree[at][:, :, None])
            came = start[edge]
            paid = spent[:, :, None] + cost[edge]
            reach = np.where(there, paid + best[came], -np.inf)  # the exact score of what this can become
            m = len(who)
            everything = np.concatenate([np.where(open_, -np.inf, final), reach.reshape(m, -1)], axis=1)
            top = np.argsort(-everything, axis=1, kind="stable")[:, :n]
            row = np.arange(m)[:, None]
            new = top >= n
            parent = np.where(new, (top - n) // width, top)
            choice = np.where(new, (top - n) % width, 0)
            final = everything[row, top]
            used = edge[row, parent, choice]
            place = np.where(new, came[row, parent, choice], place[row, parent])
            spent = np.where(new, paid[row, parent, choice], spent[row, parent])
            path, count = path[row, parent], count[row, parent]
            grown = np.nonzero(new)
            path[grown[0], grown[1], count[grown]] = piece[used[grown]]
            count[grown] += 1
            place[np.isneginf(final)] = -1
        return out_score, out_count, out_piece

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a run of pieces, the first space included."""
        size = self.bytes_at[ids + 1] - self.bytes_at[ids]
        source = np.repeat(self.bytes_at[ids] - (np.cumsum(size) - size), size)
        source += np.arange(len(source))
        return self.bytes[source].tobytes()


class Segmenter:
    """N-best segmentations of texts, from those of their stretches."""

    def __init__(self, path: str, n: int):
        self.vocabulary, self.n = Vocabulary(path), n
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.score = np.zeros((0, self.n))
        self.start = np.zeros((0, self.n), dtype=np.int64)
        self.count = np.zeros((0, self.n), dtype=np.int32)
        self.ids = np.zeros(0, dtype=np.int32)

    def _learn(self, words: list[str]) -> None:
        scores, starts, counts, ids = [self.score], [self.start], [self.count], [self.ids]
        used = len(self.ids)
        words = sorted(words, key=len)  # stretches of like length share a group
        i = 0
        while i < len(words):
            # long stretches (runs of text without a space) go in smaller groups
            m = max(1, min(GROUP, (GROUP * 16) // max(1, len(words[min(len(words) - 1, i + GROUP - 1)]))))
            group = words[i : i + m]
            i += m
            score, count, path = self.vocabulary.segment(group, self.n)
            flat, size = self._spelled(group, count, path)
            scores.append(score)
            counts.append(size.astype(np.int32))
            starts.append((used + np.cumsum(size.ravel()) - size.ravel()).reshape(size.shape))
            ids.append(flat)
            used += len(flat)
        first = len(self.known)
        self.known.update(zip(words, range(first, first + len(words)), strict=True))
        self.score, self.start = np.concatenate(scores), np.concatenate(starts)
        self.count, self.ids = np.concatenate(counts), np.concatenate(ids)

    def _spelled(self, words: list[str], count: np.ndarray, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces in reading order, characters without one as their bytes."""
        m, n, most = path.shape
        lane = np.arange(most)
        back = np.maximum(count[:, :, None] - 1 - lane, 0)
        forward = np.take_along_axis(path, back, axis=2)
        real = lane < count[:, :, None]
        if not (forward[real] < 0).any():
            return forward[real].astype(np.int32), count
        size, out = np.zeros_like(count), []
        length = np.diff(self.vocabulary.bytes_at)
        for i in range(m):
            raw = words[i].replace(MARK, " ").encode("utf-8", "surrogatepass")
            for j in range(n):
                found, at = [], 0
                for piece in forward[i, j, : count[i, j]].tolist():
                    if piece >= 0:
                        found.append(piece)
                        at += int(length[piece])
                    else:
                        lead = raw[at]
                        k = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                        found.extend(self.vocabulary.byte_id[b] for b in raw[at : at + k])
                        at += k
                size[i, j] = len(found)
                out.extend(found)
        return np.array(out, dtype=np.int32), size

    def stretches(self, text: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The stretches of all texts and how many each text has."""
        marked = pc.replace_substring(pc.fill_null(text, ""), " ", MARK)
        filled = pc.greater(pc.binary_length(marked), 0)
        marked = pc.if_else(filled, pc.binary_join_element_wise(pa.scalar(MARK), marked, ""), marked)
        offsets = np.frombuffer(marked.buffers()[1], dtype=np.int32)[marked.offset : marked.offset + len(marked) + 1]
        data = np.frombuffer(marked.buffers()[2] or b"", dtype=np.uint8)[: offsets[-1]]
        n = len(data)
        cut = np.zeros(n + 1, dtype=bool)
        if n:
            mark = np.zeros(n, dtype=bool)
            if n >= 3:
                mark[: n - 2] = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
            cut[:n] |= mark
            cut[3:n] &= ~mark[: n - 3]  # not inside a run of space marks
            cut[1:n] |= self.vocabulary.parted[data[:-1], data[1:]]
            lone = np.flatnonzero(self.vocabulary.alone[data])
            cut[lone] = True
            cut[lone + 1] = True
        cut[offsets] = True
        at = np.flatnonzero(cut).astype(np.int32)
        words = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data)) if n else pa.array([], pa.string())
        place = np.searchsorted(at, offsets)
        return words, np.diff(place)

    def segment(self, text: pa.Array) -> list[list[tuple[float, np.ndarray]]]:
        """For each text its (score, ids), best first."""
        words, sizes = self.stretches(text)
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) + len(distinct) > KNOWN:
            self.reset()
        new = [w for w in distinct if w not in self.known]
        if new:
            self._learn(new)
        where = np.fromiter(map(self.known.__getitem__, distinct), dtype=np.int64, count=len(distinct))
        word = where[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, dtype=np.int64)
        count = self.count[word, 0].astype(np.int64) if len(word) else np.zeros(0, dtype=np.int64)
        ends = np.cumsum(count)
        source = np.repeat(self.start[word, 0] - (ends - count), count) if len(word) else np.zeros(0, dtype=np.int64)
        source += np.arange(len(source))
        ids = self.ids[source]
        best = self.score[word, 0] if len(word) else np.zeros(0)
        loss = best - self.score[word, 1] if self.n > 1 and len(word) else np.full(len(word), np.inf)
        out, at = [], 0
        for size in sizes.tolist():
            a, b = at, at + size
            at = b
            if size == 0:
                out.append([(0.0, np.zeros(0, dtype=np.int32))])
                continue
            left = int(ends[a] - count[a])
            own = ids[left : int(ends[b - 1])]
            out.append(self._text(float(best[a:b].sum()), own, word[a:b], loss[a:b], ends[a:b] - count[a:b] - left))
        return out

    def _text(self, score: float, ids: np.ndarray, word: np.ndarray, loss: np.ndarray, begin: np.ndarray):
        """The N-best of a text. Of all exchanges of one stretch's best
        segmentation for another, only the n - 1 cheapest can be in them."""
        n = self.n
        found = [(score, ids)]
        if n == 1:
            return found
        if len(loss) > n - 1:
            edge = np.partition(loss, n - 2)[n - 2]
            near = np.concatenate([np.flatnonzero(loss < edge), np.flatnonzero(loss == edge)[: n - 1]])
        else:
            near = np.arange(len(loss))
        single = []
        for i in near.tolist():
            w = word[i]
            single.extend((self.score[w, 0] - self.score[w, k], i, k) for k in range(1, n) if np.isfinite(self.score[w, k]))
        single = sorted(single)[: n - 1]
        sets = []
        for r in range(1, len(single) + 1):
            for chosen in combinations(single, r):
                if len({i for _, i, _ in chosen}) == r:
                    sets.append((sum(x for x, _, _ in chosen), r, sorted((i, k) for _, i, k in chosen)))
        for lost, _, chosen in sorted(sets)[: n - 1]:
            parts, done = [], 0
            for i, k in chosen:
                w = word[i]
                parts += [ids[done : begin[i]], self.ids[self.start[w, k] : self.start[w, k] + self.count[w, k]]]
                done = begin[i] + self.count[w, 0]
            found.append((score - lost, np.concatenate([*parts, ids[done:]])))
        return found


def _segmenter(path: str, n: int) -> Segmenter:
    if (path, n) not in _WORKER:
        _WORKER[path, n] = Segmenter(path, n)
    return _WORKER[path, n]


def encode(df: DataFrame, model_path: str, text: str = "text", n: int = BEST, keep: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """``df`` without its text (or its columns in ``keep``), one row per
    segmentation: rank (from 1), score, n_pieces, ids_crc32 (of little-endian
    unsigned 32-bit ids), restored (decoding gives the text back) and, if
    asked for, ids."""
    keep = [c for c in df.columns if c != text] if keep is None else keep
    names = [fresh(df.select(*[quoted(c) for c in keep]), c) for c in ("rank", "score", "n_pieces", "ids_crc32", "restored", "ids")]
    kinds = [T.IntegerType(), T.DoubleType(), T.LongType(), T.LongType(), T.BooleanType(), T.ArrayType(T.IntegerType())]
    body = fresh(df, "body__")
    source = df.select(*[quoted(c) for c in keep], quoted(text).alias(body))
    made = [T.StructField(a, k) for a, k in zip(names, kinds, strict=True)][: 6 if with_ids else 5]
    schema = T.StructType([f for f in source.schema.fields if f.name != body] + made)

    def run(batches):
        coder = _segmenter(model_path, n)
        for part in text_slices(batches, body, SLICE):
            texts = part.column(body)
            row, rank, score, size, crc, same, ids = [], [], [], [], [], [], []
            for i, found in enumerate(coder.segment(texts)):
                raw = (texts[i].as_py() or "").encode()
                for k, (value, own) in enumerate(found):
                    row.append(i)
                    rank.append(k + 1)
                    score.append(value)
                    size.append(len(own))
                    crc.append(zlib.crc32(own.astype("<u4").tobytes()))
                    same.append(coder.vocabulary.decode(own)[1:] == raw)
                    if with_ids:
                        ids.append(own)
            take = pa.array(row, pa.int64())
            arrays = [part.column(i).take(take) for i, c in enumerate(part.schema.names) if c != body]
            arrays += [pa.array(rank, pa.int32()), pa.array(score, pa.float64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return map_in_arrow(source, run, schema)


def decode(df: DataFrame, model_path: str, ids: str = "ids", name: str = "text") -> DataFrame:
    """``df`` plus the text of its ids (null: null)."""
    out = fresh(df, name)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches):
        words = _segmenter(model_path, 1).vocabulary
        for batch in batches:
            lists = batch.column(ids).to_pylist()
            text = [
                None if x is None else words.decode(np.array(x, dtype=np.int64))[1:].decode("utf-8", "replace") for x in lists
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], names=schema.names)

    return map_in_arrow(df, run, schema)
