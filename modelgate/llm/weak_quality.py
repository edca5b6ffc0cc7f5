"""Quality classifier: weak labels by expectation-maximisation, a linear scorer.

Overlapping heuristic labellers vote good (1), bad (0) or abstain (-1) on
every document. The votes of all documents are counted by pattern (at most
3**labellers rows, whatever the input), and expectation-maximisation over the
pattern counts estimates, without any true label, the share of good documents
and how often each labeller is right when it votes. Each pattern's posterior is
its documents' soft label. A logistic scorer over hashed features (words, the shapes of words and
repeats of the word before, as shares of the text) is trained on the soft labels of a
bounded sample (``SAMPLE`` documents with the smallest hashes), and scores
every whole text.

Edge cases: null, empty and wordless texts have no features: their score is that
of the bias alone, set to 0 (not kept). Empty tables give no rows. If
all votes agree, the posterior is their smoothed share. Repeated rows
count as often as they occur and get equal scores; null ids pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelgate.llm.common import codes, fresh, map_in_arrow, quoted, text_slices, word_lists

BUCKETS = 1 << 17
SAMPLE = 8_000
EPOCHS = 12
RATE = 0.05
SLICE = 8 << 20
#: Words below which shares are not judged.
FEW = 20
#: Prior counts of the model's tables, and rounds of the estimation.
PRIOR = 1.0
ROUNDS = 60

#: Frequent function words of the corpus's languages.
FUNCTION_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "der", "die", "und", "das", "den", "von", "zu", "mit",
    "le", "la", "les", "de", "des", "et", "un", "une", "que", "el", "los", "las", "en", "y", "del", "con",
)
SYMBOLS = "#*$%&|<>"


def _votes(bad: Column, good: Column | None = None) -> Column:
    vote = F.when(bad, 0)
    return (vote if good is None else vote.when(good, 1)).otherwise(-1)


def labellers(text: Column) -> dict[str, Column]:
    """The votes of each labeller on a text, as columns over ``w`` (words),
    ``l`` (lines) and ``t`` (text), see ``with_votes``. Those that look for one
    defect vote bad or abstain; shares are not judged in texts of under
    ``FEW`` words."""
    n = F.greatest(F.size("w"), F.lit(1))
    enough = F.size("w") >= FEW
    letters = F.length(F.regexp_replace("t", r"[^\p{L}]", ""))
    capitals = F.length(F.regexp_replace("t", r"[^\p{Lu}]", ""))
    count = lambda chars: F.length("t") - F.length(F.translate(F.col("t"), chars, ""))
    known = F.array(*[F.lit(x) for x in FUNCTION_WORDS])
    functional = F.size(F.filter("w", lambda x: F.array_contains(known, x)))
    plain = F.size(F.filter("w", lambda x: x.rlike(r"^\p{L}?\p{Ll}+[.,;:]?$")))
    ends = F.size(F.filter("w", lambda x: x.rlike(r"\p{Ll}[.!?]$")))
    distinct = F.size(F.array_distinct("w")) / n
    runs = F.size(F.filter("w", lambda x, i: (i > 0) & (F.get("w", i - 1) == x)))
    varied = enough & (runs <= 0.03 * n)
    repeats = F.size("l") - F.size(F.array_distinct("l"))
    mean = F.length(F.translate(F.col("t"), " \n", "")) / n
    return {
        "capitals": _votes(enough & (capitals > 0.5 * letters)),
        "symbols": _votes(enough & (count(SYMBOLS) > 0.2 * n)),
        "shouting": _votes(enough & (count("!") > 0.3 * n)),
        "runs": _votes(enough & (runs > 0.1 * n)),
        "variety": _votes(enough & (distinct < 0.2)),
        "lines": _votes((repeats >= 3) & (repeats > 0.3 * F.size("l"))),
        "word_length": _votes(enough & ((mean < 2.5) | (mean > 14))),
        "function_words": _votes(enough & (functional < 0.05 * n), varied & (functional >= 0.1 * n)),
        "plain_words": _votes(enough & (plain < 0.6 * n), varied & (plain >= 0.9 * n)),
        "sentences": _votes(enough & (ends < 0.01 * n), varied & (ends >= 0.02 * n)),
    }


def with_votes(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` plus the array of votes."""
    taken = df.select(F.struct(*[quoted(c) for c in df.columns]).alias("row__"), F.coalesce(quoted(text), F.lit("")).alias("t"))
    cut_up = taken.withColumn("w", F.filter(F.split("t", r"[ \t-\r]+"), lambda x: x != "")).withColumn(
        "l", F.filter(F.split("t", "\n"), lambda x: F.length(F.trim(x)) > 0)
    )
    votes = F.array(*[v.cast("int") for v in labellers(F.col("t")).values()])
    return cut_up.select(*[F.col("row__").getField(c).alias(c) for c in df.columns], votes.alias(name))


@dataclass
class LabelModel:
    """The share of good documents and each labeller's accuracy."""

    share: float
    accuracy: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that documents with these votes are good."""
        weight = np.log(self.accuracy) - np.log(1 - self.accuracy)
        evidence = ((patterns == 1).astype(float) - (patterns == 0)) @ weight
        return 1 / (1 + np.exp(-np.clip(evidence + np.log(self.share) - np.log(1 - self.share), -500, 500)))


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
    """Expectation-maximisation over vote patterns and their counts: a
    labeller that does not abstain is right with its accuracy."""
    voted, good = patterns >= 0, patterns == 1
    model = LabelModel(0.5, np.full(patterns.shape[1], 0.8))
    belief = model.posterior(patterns)
    for _ in range(rounds):
        share = ((counts * belief).sum() + PRIOR) / (counts.sum() + 2 * PRIOR)
        right = np.where(good, belief[:, None], 1 - belief[:, None]) * voted
        # a prior of 0.8 keeps labellers better than chance where little is seen
        accuracy = (counts @ right + 4 * PRIOR) / (counts @ voted + 5 * PRIOR)
        model = LabelModel(float(share), np.clip(accuracy, 0.5, 1 - 1e-3))
        new = model.posterior(patterns)
        if np.abs(new - belief).max() < 1e-6:
            break
        belief = new
    return model


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of texts: buckets and the rows they are of."""
    import xxhash

    words, rows = word_lists(text)
    index, distinct = codes(words)
    shape = pc.replace_substring_regex(distinct, r"\p{Ll}+", "a")
    shape = pc.replace_substring_regex(shape, r"\p{Lu}+", "A")
    shape = pc.replace_substring_regex(shape, r"\p{N}+", "0")
    digest = xxhash.xxh3_64_intdigest
    forms = [
        np.fromiter((digest(w, seed) % BUCKETS for w in part.cast(pa.binary()).to_pylist()), dtype=np.int64, count=len(part))
        for seed, part in ((1, pc.utf8_lower(distinct)), (2, shape))
    ]
    same = np.flatnonzero((index[1:] == index[:-1]) & (rows[1:] == rows[:-1])) + 1 if len(index) else np.zeros(0, dtype=np.int64)
    repeat = np.full(len(same), digest(b"repeat", 3) % BUCKETS, dtype=np.int64)
    return (
        np.concatenate([forms[0][index], forms[1][index], repeat]),
        np.concatenate([rows, rows, rows[same]]),
    )


def train(text: pa.Array, soft: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic scorer, by Adam on soft labels."""
    n = len(text)
    bucket, row = features(text)
    order = np.lexsort((bucket, row))
    bucket, row = bucket[order], row[order]
    new = np.append(True, (bucket[1:] != bucket[:-1]) | (row[1:] != row[:-1])) if len(row) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(row))).astype(np.float64)
    bucket, row = bucket[at], row[at]
    length = np.bincount(row, weights=tf, minlength=n)
    value = np.sqrt(tf / np.maximum(length[row], 1))
    starts = np.searchsorted(row, np.arange(n + 1))
    w, b = np.zeros(BUCKETS), 0.0
    m, v, mb, vb, step = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0, 0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(n), max(1, n // 64)):
            step += 1
            take = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in rows])
            local = np.repeat(np.arange(len(rows)), starts[rows + 1] - starts[rows])
            x, f = value[take], bucket[take]
            z = np.bincount(local, weights=w[f] * x, minlength=len(rows)) + b
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - soft[rows]) / len(rows)
            used, inverse = np.unique(f, return_inverse=True)
            g = np.bincount(inverse, weights=err[local] * x) + 1e-6 * w[used]
            m[used] = 0.9 * m[used] + 0.1 * g
            v[used] = 0.99 * v[used] + 0.01 * g * g
            w[used] -= RATE * (m[used] / (1 - 0.9**step)) / (np.sqrt(v[used] / (1 - 0.99**step)) + 1e-8)
            gb = err.sum()
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            b -= RATE * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-8)
    return w, b


def score_texts(text: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    n = len(text)
    bucket, row = features(text)
    key = np.sort(row * BUCKETS + bucket)
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
    tf = np.diff(np.append(at, len(key)))
    row, bucket = key[at] // BUCKETS, key[at] % BUCKETS
    length = np.bincount(row, weights=tf, minlength=n)
    z = np.bincount(row, weights=weights[bucket] * np.sqrt(tf / np.maximum(length[row], 1)), minlength=n) + bias
    return np.where(length > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)


def fit(df: DataFrame, text: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The scorer's weights, from the votes on all rows of ``df``."""
    voted = with_votes(df.select(quoted(text).alias("text")), "text", "votes")
    counted = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()
    if not counted:
        return np.zeros(BUCKETS), 0.0
    counted.sort(key=lambda r: r["votes"])
    patterns = np.array([r["votes"] for r in counted], dtype=np.int64)
    model = fit_labels(patterns, np.array([r["n"] for r in counted], dtype=np.float64))
    belief = dict(zip(map(tuple, patterns.tolist()), model.posterior(patterns).tolist(), strict=True))
    # the hashes alone are ordered, so that no text is sorted or shuffled
    hashed = df.select(quoted(text).alias("text"), F.xxhash64(quoted(text)).alias("hash"))
    last = hashed.select("hash").orderBy("hash").limit(sample).agg(F.max("hash")).first()[0]
    some = hashed.where(F.col("hash") <= last).limit(sample)
    got = with_votes(some, "text", "votes").toArrow().sort_by("hash")
    votes = got.column("votes").to_pylist()
    return train(got.column("text").combine_chunks(), np.array([belief[tuple(x)] for x in votes]))


def score(df: DataFrame, scorer: tuple[np.ndarray, float], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` (its columns, or those in ``keep``) plus the score."""
    keep = df.columns if keep is None else keep
    body, name = fresh(df, "body__"), fresh(df.select(*[quoted(c) for c in keep]), "score")
    source = df.select(*[quoted(c) for c in keep], quoted(text).alias(body))
    schema = T.StructType([f for f in source.schema.fields if f.name != body] + [T.StructField(name, T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        weights, bias = shared.value
        for part in text_slices(batches, body, SLICE):
            columns = [part.column(i) for i, c in enumerate(part.schema.names) if c != body]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(score_texts(part.column(body), weights, bias))], names=schema.names
            )

    return map_in_arrow(source, run, schema)
