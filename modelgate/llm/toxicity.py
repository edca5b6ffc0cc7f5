"""Toxicity: a convolutional text classifier trained in numpy.

Words (lower-cased, runs of letters, digits and marks) are hashed into
``BUCKETS`` rows of an embedding table; a word's embedding is the sum of its
own row and that of its first ``STEM`` letters, so that rare inflections share
what is learned of their stem. Filters of several widths slide over
the word embeddings, each filter's responses are max-pooled over the whole
text, and a logistic layer turns the pooled values into a probability. All
layers are trained together with Adam on every labelled row; a fifth of the rows
calibrates one score threshold per language instead.

Training starts in one task with the first rows (``max_toxic`` and
``max_clean``: of each label the rows with the smallest hashes of their ids).
All others follow where they lie, in ``ROUNDS`` rounds: each task goes on from the
model at hand with its own rows of the round, and the model moves by the mean of
the tasks' moves (an embedding row by the mean over the batches that touched
it, all else by rows). So every labelled row is learned from or calibrates, and
the driver holds no rows but one model. Thresholds are exact order
statistics of all calibration rows. Sums are taken in the order of the tasks;
how rows are dealt to tasks decides the last digits of a model. Scoring is a map over the documents with the fixed-size model broadcast to the tasks: since a
filter is linear in its words, its table of products (embedding times filter
slice) is made once, and a filter's response is a sum of table rows. Whole
texts are scored, in pieces that overlap by the filter width, so that memory
is bounded for very long texts.

Scores depend on the text alone; language, source and ids are no inputs. The
language only selects the threshold of the ``flagged`` column.

Edge cases: null, empty and wordless texts are scored as a text of padding
(one defined score, the model's bias through empty filters). Labels: rows with
a null id or label are left out, several labels of one id count as toxic if
one does; ids without a document are left out. With no usable labels, or only
one class, the model is a constant: the smoothed share of toxic labels, 0.5
without any. Repeated rows get equal scores. Languages without calibration rows
(null included) use the threshold of all languages.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelgate.llm.common import cut, drop, fresh, map_in_arrow, quoted

BUCKETS = 1 << 16
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 12
#: Training goes on for EPOCHS passes or STEPS batches, whatever is more.
EPOCHS = 4
STEPS = 250
BATCH = 64
STEM = 4
RATE = 0.01
#: Bounds of the rows that training starts with, by label.
MAX_TOXIC_DOCS = 4_000
MAX_CLEAN_DOCS = 8_000
#: Weight of a toxic row in the loss.
TOXIC_WEIGHT = 2.0
#: Rounds in which tasks train on the rows beyond the first, and the parts an
#: embedding table is summed up in.
ROUNDS = 4
SHARDS = 32
#: Labels that are sent to the documents; more are joined by a shuffle of word lists.
BROADCAST_LABELS = 1_000_000
#: Every CALIBRATION-th row sets thresholds instead of weights.
CALIBRATION = 5
#: Words a worker convolves at once.
PIECE = 1 << 17
#: Words of the texts that a worker scores at once (a longer text alone).
SLICE_WORDS = 1 << 18
#: Smoothing of a language's threshold towards the one of all languages.
LANGUAGE_WEIGHT = 20.0
#: Share of clean documents that a threshold may flag.
MAX_FALSE_POSITIVE = 0.005


@dataclass
class Model:
    """Weights; ``embed`` row BUCKETS is the zero padding row."""

    embed: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float
    constant: float | None = None
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    def tables(self) -> dict[int, list[np.ndarray]]:
        return {w: [(self.embed @ f[j]).astype(np.float32) for j in range(w)] for w, f in self.filters.items()}


def word_buckets(text: Column, buckets: int = BUCKETS) -> Column:
    """Per word of a text, in order, one number: the hash bucket of the word
    and that of its stem (bucket of the word * buckets + bucket of the stem)."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\p{M}]+")
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets))
    return F.transform(
        F.filter(words, lambda w: w != ""),
        lambda w: bucket(w) * buckets + bucket(F.concat(F.lit("^"), F.substring(w, 1, STEM))),
    )


def _padded(ids: np.ndarray, sizes: np.ndarray, pad: int, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts laid out one after another, each followed by ``gap`` paddings (a
    text without words gets one more); returns the ids, the starts and which
    places a filter may not start at."""
    room = np.maximum(sizes, 1) + gap
    starts = np.cumsum(room) - room
    flat = np.full((2, int(room.sum())), pad, dtype=np.int32)
    within = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.repeat(starts, sizes) + within
    flat[0, at], flat[1, at] = ids // pad, ids % pad
    closed = np.zeros(flat.shape[1], dtype=bool)
    for g in range(1, gap + 1):
        closed[starts + room - g] = True
    return flat, starts, closed


def responses(parts: list[np.ndarray], flat: np.ndarray, closed: np.ndarray) -> np.ndarray:
    """A width's filters at every place of ``closed`` (``flat`` may be longer)."""
    n = len(closed)
    out = parts[0][flat[0, :n]]
    out += parts[0][flat[1, :n]]
    for j in range(1, len(parts)):
        ahead = flat[:, j : n + j]
        room = ahead.shape[1]
        out[:room] += parts[j][ahead[0]]
        out[:room] += parts[j][ahead[1]]
    out[closed] = -np.inf
    return out


def pooled(tables, bias, flat, starts, closed, positions: bool = False):
    """Max-pooled filter responses (texts x filters) and, if asked for, per
    width the place that each text's and filter's maximum came from."""
    values, places = [], []
    rows = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(closed)))) if positions else None
    for w, parts in tables.items():
        response = responses(parts, flat, closed)
        top = np.maximum.reduceat(response, starts, axis=0)
        values.append(top + bias[w])
        if positions:
            at = np.empty(top.shape, dtype=np.int64)
            for f in range(top.shape[1]):
                hit = np.flatnonzero(response[:, f] == top[rows, f])[::-1]
                at[rows[hit], f] = hit  # the first place wins
            places.append(at)
    return np.concatenate(values, axis=1), places


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _adam(state: dict, name, weight, grad, step, rate=RATE):
    m, v = state.setdefault(name, (np.zeros_like(weight), np.zeros_like(weight)))
    m *= 0.9
    m += 0.1 * grad
    v *= 0.99
    v += 0.01 * grad * grad
    weight -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)


def _adam_rows(state: dict, weight, rows, grad, step, rate):
    """Adam on the rows that have a gradient, the others keep their moments."""
    m, v = state.setdefault("rows", (np.zeros_like(weight), np.zeros_like(weight)))
    m[rows] = 0.9 * m[rows] + 0.1 * grad
    v[rows] = 0.99 * v[rows] + 0.01 * grad * grad
    weight[rows] -= rate * (m[rows] / (1 - 0.9**step)) / (np.sqrt(v[rows] / (1 - 0.99**step)) + 1e-8)


def train(docs: list[np.ndarray], labels: np.ndarray, buckets: int = BUCKETS, epochs: int | None = None, seed: int = 7, rate: float | None = None) -> Model:
    """Fit on word-bucket arrays (as of ``word_buckets`` or ``training_rows``) and 0/1 labels."""
    if epochs is None:
        epochs = max(EPOCHS, -(-STEPS * BATCH // max(len(docs), BATCH)))
    rate = RATE if rate is None else rate
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (buckets + 1, DIM))
    embed[buckets] = 0
    filters = {w: rng.normal(0, 0.3, (w, DIM, FILTERS)) for w in WIDTHS}
    bias = {w: np.zeros(FILTERS) for w in WIDTHS}
    out, out_bias = rng.normal(0, 0.3, FILTERS * len(WIDTHS)), np.zeros(1)
    if len(docs) == 0 or labels.min() == labels.max():
        share = (labels.sum() + 1.0) / (len(labels) + 2.0) if len(docs) else 0.5
        return Model(embed, filters, bias, out, 0.0, constant=float(share))
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    model, state, step = Model(embed, filters, bias, out, out_bias), {}, 0
    for epoch in range(epochs):
        shuffled = rng.permutation(len(docs))
        order = shuffled[np.argsort(sizes[shuffled] // 512, kind="stable")]
        batches = np.array_split(order, max(1, len(order) // BATCH))
        for b in rng.permutation(len(batches)):
            rows = batches[b]
            step += 1
            _learn(model, state, step, [_numbers(docs[i]) for i in rows], labels[rows], rate * (1.0 - 0.8 * epoch / epochs))
    return Model(embed, filters, bias, out, float(out_bias[0]))


def _learn(model: Model, state: dict, step: int, docs: list[np.ndarray], labels: np.ndarray, rate: float) -> np.ndarray:
    """One batch: the weights of ``model`` move in place (``out_bias`` is an array
    here). Returns the embedding rows that moved."""
    embed, filters, bias, out, out_bias = model.embed, model.filters, model.bias, model.out, model.out_bias
    buckets, gap = len(embed) - 1, max(WIDTHS) - 1
    balance = np.where(labels == 1, TOXIC_WEIGHT, 1.0)
    flat, starts, closed = _padded(np.concatenate(docs), np.array([len(d) for d in docs], dtype=np.int64), buckets, gap)
    used, local = np.unique(flat, return_inverse=True)
    local = local.reshape(flat.shape)
    tables = {w: [embed[used] @ f[j] for j in range(w)] for w, f in filters.items()}
    pool, places = pooled(tables, bias, local, starts, closed, positions=True)
    hidden = np.maximum(pool, 0)
    p = _sigmoid(hidden @ out + out_bias[0])
    err = (p - labels) * balance / len(docs)
    back = np.outer(err, out) * (pool > 0)
    grads = {"out": hidden.T @ err, "out_bias": np.array([err.sum()])}
    grad_embed = np.zeros((len(used), DIM))
    for k, w in enumerate(WIDTHS):
        part = back[:, k * FILTERS : (k + 1) * FILTERS]
        grads["b", w] = part.sum(axis=0)
        g = np.zeros_like(filters[w])
        for j in range(w):
            at = places[k] + j
            ids = local[:, at]  # a place is followed by its text's paddings
            vectors = embed[used[ids[0]]] + embed[used[ids[1]]]  # texts x filters x dim
            g[j] = np.einsum("tfd,tf->df", vectors, part)
            back_embed = (part[:, :, None] * filters[w][j].T[None]).reshape(-1, DIM)
            np.add.at(grad_embed, ids[0].ravel(), back_embed)
            np.add.at(grad_embed, ids[1].ravel(), back_embed)
        grads["f", w] = g
    touched = np.flatnonzero(grad_embed.any(axis=1) & (used != buckets))
    _adam_rows(state, embed, used[touched], grad_embed[touched], step, rate)
    _adam(state, "out", out, grads["out"] + 1e-4 * out, step, rate)
    _adam(state, "out_bias", out_bias, grads["out_bias"], step, rate)
    for w in WIDTHS:
        _adam(state, ("f", w), filters[w], grads["f", w], step, rate)
        _adam(state, ("b", w), bias[w], grads["b", w], step, rate)
    return used[touched]


def _dense(model: Model) -> np.ndarray:
    """All weights but the embeddings in one row."""
    parts = [model.out, [model.out_bias], *[model.filters[w].ravel() for w in WIDTHS], *[model.bias[w] for w in WIDTHS]]
    return np.concatenate([np.asarray(p, dtype=np.float64).ravel() for p in parts])


def _with_dense(model: Model, row: np.ndarray) -> Model:
    """``model`` with the weights of ``_dense``; embeddings are copied."""
    sizes = [len(model.out), 1, *[model.filters[w].size for w in WIDTHS], *[FILTERS for _ in WIDTHS]]
    out, out_bias, *rest = np.split(row.copy(), np.cumsum(sizes)[:-1])
    filters = {w: r.reshape(model.filters[w].shape) for w, r in zip(WIDTHS, rest)}
    return Model(model.embed.copy(), filters, dict(zip(WIDTHS, rest[len(WIDTHS) :])), out, float(out_bias[0]))


def _numbers(words: np.ndarray) -> np.ndarray:
    """The numbers of ``word_buckets``, given as they are or as ints (see ``training_rows``)."""
    return words.astype(np.int64) + (1 << 31) if words.dtype == np.int32 else words


def _list_rows(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column, as parts of one array."""
    ids, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy(zero_copy_only=False)
    ends = ends - ends[0]
    return [ids[a:b] for a, b in zip(ends, ends[1:])]


def start(first: DataFrame) -> tuple[Model, DataFrame]:
    """The model of the rows to start with (as of ``training_rows``, in one partition) and a
    table (lang__, label__, words__, model__) whose rows without a model calibrate: of the
    rows by their hashes every CALIBRATION-th. One task trains; the driver gets the model alone."""
    rate = RATE

    def run(batches):
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        got = pa.Table.from_batches(found).combine_chunks()
        del found
        words = [w for c in got.column("words__").chunks for w in _list_rows(c)]
        y, keys = got.column("label__").to_numpy().astype(np.float64), got.column("order__").to_numpy()
        _, which, repeats = np.unique(keys, return_inverse=True, return_counts=True)
        tied = repeats[which] > 1
        order = np.array(sorted(
            range(len(words)), key=lambda i: (keys[i], len(words[i]), _numbers(words[i]).tobytes() if tied[i] else b""),
        ))
        held = np.arange(len(order)) % CALIBRATION == 0
        model = train([words[i] for i in order[~held]], y[order[~held]], rate=rate)
        yield pa.RecordBatch.from_pydict({
            "lang__": pa.array([None], pa.string()), "label__": pa.array([None], pa.int32()),
            "words__": pa.array([None], pa.list_(pa.int32())), "model__": pa.array([pickle.dumps(model)], pa.binary()),
        })
        check = got.select(["lang__", "label__", "words__"]).take(pa.array(order[held]))
        yield from check.append_column("model__", pa.nulls(len(check), pa.binary())).combine_chunks().to_batches()

    done = cut(map_in_arrow(first, run, "lang__ string, label__ int, words__ array<int>, model__ binary"), "toxicity-start")
    row = done.where("model__ IS NOT NULL").select("model__").first()
    return (train([], np.zeros(0)) if row is None else pickle.loads(row[0])), done


def refine(rows: DataFrame, model: Model, number: int) -> Model:
    """``model`` after one round over ``rows`` (label__, words__), each task with its own."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    rate = RATE * 0.4 * (1.0 - 0.8 * number / ROUNDS)

    def run(batches):
        start = shared.value
        own = _with_dense(start, _dense(start))
        own.out_bias = np.array([own.out_bias])
        counts, seen, state, step = np.zeros(len(own.embed)), 0, {}, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            docs, y = _list_rows(batch.column("words__")), batch.column("label__").to_numpy().astype(np.float64)
            order = np.argsort([len(d) // 512 for d in docs], kind="stable")
            for at in np.array_split(order, max(1, len(order) // BATCH)):
                step += 1
                counts[_learn(own, state, step, [_numbers(docs[i]) for i in at], y[at], rate)] += 1
                seen += len(at)
        if not seen:
            return
        own.out_bias = float(own.out_bias[0])
        moved = np.concatenate([(own.embed - start.embed) * counts[:, None], counts[:, None]], axis=1)
        parts = [p.tobytes() for p in np.array_split(moved, SHARDS)]
        parts.append(np.append((_dense(own) - _dense(start)) * seen, float(seen)).tobytes())
        yield pa.RecordBatch.from_pydict({
            "shard": pa.array(range(SHARDS + 1), pa.int32()),
            "task": pa.array([TaskContext.get().partitionId()] * (SHARDS + 1), pa.int32()), "moves": pa.array(parts, pa.binary()),
        })

    def total(found: pa.Table) -> pa.Table:
        found = found.sort_by("task")
        out = np.zeros(len(found.column("moves")[0].as_py()) // 8)
        for one in found.column("moves"):
            out += np.frombuffer(one.as_py())
        return pa.table({"shard": found.column("shard")[:1], "moves": pa.array([out.tobytes()], pa.binary())})

    moves = map_in_arrow(rows.select("label__", "words__"), run, "shard int, task int, moves binary")
    got = dict(moves.groupBy("shard").applyInArrow(total, "shard int, moves binary").collect())
    shared.unpersist()
    if not got:
        return model
    dense = np.frombuffer(got[SHARDS])
    out = _with_dense(model, _dense(model) + dense[:-1] / dense[-1])
    moved = np.concatenate([np.frombuffer(got[i]).reshape(-1, DIM + 1) for i in range(SHARDS)])
    out.embed += moved[:, :-1] / np.maximum(moved[:, -1:], 1)
    return out


def score_flat(model: Model, tables, flat_ids: np.ndarray, sizes: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """Scores of texts given as concatenated word buckets. Long runs are cut
    into pieces of ``piece`` words that overlap by the widest filter; the
    maxima of a text's pieces are joined."""
    n = len(sizes)
    if model.constant is not None:
        return np.full(n, model.constant)
    if n == 0:
        return np.zeros(0)
    pad, gap = len(model.embed) - 1, max(WIDTHS) - 1
    flat, starts, closed = _padded(flat_ids, sizes, pad, gap)
    pool = np.full((n, FILTERS * len(WIDTHS)), -np.inf, dtype=np.float32)
    for a in range(0, len(closed), piece):
        b = min(len(closed), a + piece)
        first = int(np.searchsorted(starts, a, side="right")) - 1
        last = int(np.searchsorted(starts, b, side="left"))
        local = np.maximum(starts[first:last] - a, 0)
        top, _ = pooled(tables, model.bias, flat[:, a : b + gap], local, closed[a:b])
        pool[first:last] = np.maximum(pool[first:last], top)
    return _sigmoid(np.maximum(pool, 0).astype(np.float64) @ model.out + model.out_bias)


def threshold_for(scores: np.ndarray, labels: np.ndarray) -> float:
    """Lowest threshold of at least 0.5 that flags at most MAX_FALSE_POSITIVE
    of the clean rows."""
    clean = np.sort(scores[labels == 0])
    if len(clean) == 0:
        return 0.5
    allowed = int(MAX_FALSE_POSITIVE * len(clean))
    worst = clean[len(clean) - 1 - allowed]
    return float(min(0.999, max(0.5, worst + 1e-6)))


def training_rows(
    documents: DataFrame, labels: DataFrame, allowed: Column | None, doc_id: str, text: str, lang: str,
) -> DataFrame:
    """Every labelled row as (order, label, lang, words): ``order__`` is the hash of
    the id, a word's number (see ``word_buckets``) is less by 2^31, to be an int."""
    marked = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy(F.col("doc_id").alias("id__")).agg(F.max((F.col("toxic") != 0).cast("int")).alias("label__"))
    )
    if allowed is not None:
        marked = marked.where(allowed)
    rows = documents.where(quoted(doc_id).isNotNull()).select(
        quoted(doc_id).alias("id__"), quoted(text).alias("text__"),
        (quoted(lang) if lang in documents.columns else F.lit(None)).cast("string").alias("lang__"),
    )
    words = F.transform(word_buckets(F.col("text__")), lambda w: (w - (1 << 31)).cast("int")).alias("words__")
    if marked.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        found = rows.join(F.broadcast(marked), "id__").select("id__", "label__", "lang__", words)
    else:  # the shuffle carries word lists, not texts
        found = rows.select("id__", "lang__", words).join(marked, "id__")
    return found.select(F.xxhash64("id__").alias("order__"), "label__", "lang__", "words__")


def first_rows(rows: DataFrame, max_toxic: int, max_clean: int) -> tuple[Column, Column]:
    """Conditions on ``order__`` and ``label__``: the rows that training starts
    with, and all others. Rows of one hash stay together (without a row to start
    with, the rows of a label's smallest hash do both)."""
    first, rest = F.lit(False), F.lit(False)
    for label, most in ((1, max_toxic), (0, max_clean)):
        own = F.col("label__") == label
        keys = [r[0] for r in rows.where(own).select("order__").orderBy("order__").limit(most + 1).collect()]
        if len(keys) <= most:
            first = first | own
            continue
        end = keys[-1]
        first = first | (own & (F.col("order__") <= end if keys[0] == end else F.col("order__") < end))
        rest = rest | (own & (F.col("order__") >= end))
    return first, rest


def exact_thresholds(scored: DataFrame) -> dict:
    """``threshold_for`` of all rows (key None) and of every language, with the
    rows' number, over (lang__, label__, score__): the order statistics of the
    clean scores by their places, no language's rows in one task."""
    from modelgate.operators.ordering import place_in_group

    group = F.explode(F.array(F.struct(F.lit(True).alias("all"), F.lit("").alias("code")),
                              F.struct(F.lit(False).alias("all"), F.coalesce("lang__", F.lit("None")).alias("code"))))
    long = scored.select(group.alias("g"), "label__", "score__").select("g.all", "g.code", "label__", "score__")
    sizes = long.groupBy("all", "code").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label__") == 0).alias("clean"))
    placed = place_in_group(long.where("label__ = 0").select("all", "code", "score__"), ["all", "code"], [F.col("score__").desc()])
    wanted = F.floor(F.lit(MAX_FALSE_POSITIVE) * F.col("clean")) + 1
    worst = placed.join(sizes, ["all", "code"]).where(F.col("place") == wanted).select("all", "code", "score__")
    found = sizes.join(worst, ["all", "code"], "left").collect()
    return {None if r["all"] else r["code"]: (r["n"], 0.5 if r["score__"] is None else min(0.999, max(0.5, r["score__"] + 1e-6)))
            for r in found}


def fit(
    documents: DataFrame, labels: DataFrame, allowed: Column | None = None,
    max_toxic: int = MAX_TOXIC_DOCS, max_clean: int = MAX_CLEAN_DOCS,
    doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
) -> Model:
    """Train on all labelled rows (``labels``: doc_id, toxic). ``allowed`` is a
    condition on the column ``id__`` of label rows that may be learned from.
    ``max_toxic`` and ``max_clean`` bound the rows that training starts with.
    Rows of one id with several texts count as rows of their own."""
    rows = cut(training_rows(documents, labels, allowed, doc_id, text, lang), "toxicity-rows")
    first, rest = first_rows(rows, max_toxic, max_clean)
    model, started = start(rows.where(first).select("order__", "label__", "lang__", "words__").limit(max_toxic + max_clean).coalesce(1))
    check = started.where("model__ IS NULL").select("lang__", "label__", "words__")
    others = rows.where(rest)
    more = not others.isEmpty()
    if more and model.constant is not None:  # one class only: its share among all rows
        n, toxic = rows.agg(F.count(F.lit(1)), F.sum("label__")).first()
        model.constant = (toxic + 1.0) / (n + 2.0)
    elif more:
        part = F.pmod(F.shiftright("order__", 20), F.lit(CALIBRATION * ROUNDS))
        for number in range(ROUNDS):
            mine = (F.floor(part / CALIBRATION) == number) & (part % CALIBRATION != 0)
            model = refine(others.where(mine), model, number)
        others = others.where(part % CALIBRATION == 0)
    if model.constant is None:
        if more:
            check = check.unionByName(others.select("lang__", "label__", "words__"))
        scored = score_words(check, model, "words__", "score__")
        if more:
            found = exact_thresholds(cut(scored, "toxicity-scores"))
        else:
            own = scored.collect()
            scores, y = np.array([r["score__"] for r in own]), np.array([r["label__"] for r in own])
            langs = np.array([str(r["lang__"]) for r in own], dtype=object)
            found = {None: (len(own), threshold_for(scores, y))}
            for code in sorted(set(langs)):
                at = langs == code
                found[code] = (at.sum(), threshold_for(scores[at], y[at]))
        model.threshold = found.pop(None)[1]
        for code, (n, t) in sorted(found.items()):
            model.thresholds[code] = float((n * t + LANGUAGE_WEIGHT * model.threshold) / (n + LANGUAGE_WEIGHT))
    drop(rows, started)
    return model


def score_words(source: DataFrame, model: Model, words: str, out: str) -> DataFrame:
    """``source`` with the column ``words`` (lists as in ``training_rows``) replaced by the score ``out``."""
    schema = T.StructType([f for f in source.schema.fields if f.name != words] + [T.StructField(out, T.DoubleType())])
    slim = Model(model.embed[:, :0], {}, model.bias, model.out, model.out_bias, model.constant)
    shared = source.sparkSession.sparkContext.broadcast((slim, model.tables()))

    def run(batches):
        own, tables = shared.value
        for batch in batches:
            lists = batch.column(words)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(lists.offsets.to_numpy(zero_copy_only=False)).astype(np.int64)
            ends, found, start = np.cumsum(sizes), np.zeros(len(sizes)), 0
            while start < len(sizes):
                base = int(ends[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, base + SLICE_WORDS, side="right")))
                numbers = ids[base : int(ends[stop - 1])].astype(np.int64) + (1 << 31 if ids.dtype == np.int32 else 0)
                found[start:stop] = score_flat(own, tables, numbers, sizes[start:stop])
                start = stop
            labels = [c for c in batch.schema.names if c != words]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i, c in enumerate(batch.schema.names) if c != words] + [pa.array(found)],
                names=labels + [out],
            )

    return map_in_arrow(source, run, schema)


def score(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """``df`` (its columns, or those in ``keep``) plus the score column."""
    keep = df.columns if keep is None else keep
    words = fresh(df, "words__")
    out = fresh(df, name) if name in keep else name
    source = df.select(*[quoted(c) for c in keep], word_buckets(quoted(text), len(model.embed) - 1).alias(words))
    return score_words(source, model, words, out)


def threshold_column(model: Model, lang: Column) -> Column:
    """The calibrated threshold of a row's language."""
    chosen = F.lit(model.threshold)
    for code, t in model.thresholds.items():
        chosen = F.when(F.coalesce(lang.cast("string"), F.lit("None")) == code, F.lit(t)).otherwise(chosen)
    return chosen


def flag(df: DataFrame, model: Model, text: str = "text", lang: str = "lang") -> DataFrame:
    """``df`` plus a boolean column, last: toxic by its language's threshold."""
    code = quoted(lang) if lang in df.columns else F.lit(None)
    name = fresh(df, "toxicity_score")
    scored = score(df, model, text, name=name)
    flagged = fresh(df, "toxicity_flag")
    return scored.select(
        *[quoted(c) for c in df.columns], (F.col(name) >= threshold_column(model, code)).alias(flagged)
    )
