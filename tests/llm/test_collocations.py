import random
import re
from collections import Counter

import pytest

from modelgate.llm import collocations as c

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, min_count=10, max_words=3, top=2000, percent=50):
    f, total = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, max_words + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {}
    for (lang, words), a in f.items():
        if len(words) < 2 or a < min_count:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = f[lang, words[:k]], f[lang, words[k:]]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        found[lang, words] = (a, *min(cuts))
    held = set()
    for (lang, words), (a, *_) in found.items():
        for i in range(len(words)):
            for j in range(i + 2, len(words) + 1):
                part = words[i:j]
                if part != words and 100 * a >= percent * f[lang, part]:
                    held.add((lang, part))
    out = []
    for lang in {x[0] for x in found}:
        rows = [(s, a, " ".join(w), le, r) for (g, w), (a, s, _, le, r) in found.items() if g == lang and (g, w) not in held]
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i + 1, p, a, le, r, total[lang], s) for i, (s, a, p, le, r) in enumerate(rows[:top])]
    return sorted(out)


def got(spark, docs, **kw):
    df = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(docs)], "n int, text string, lang string")
    return sorted(tuple(r) for r in c.mine(df.repartition(3), **kw).collect())


def corpus(seed, n=120, words=40):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "the", "The", "é", "É", "x-y", "new", "york", "city", "of", " z", "0"]
    ends = [" "] * 12 + ["\t", "  ", ". ", ",", "\n", "\x0b", "!?", " ; "]
    return [
        ("".join(rng.choice(vocabulary) + rng.choice(ends) for _ in range(rng.randrange(words))), rng.choice(["en", "de", None, "und"]))
        for _ in range(n)
    ]


def test_equals_brute_force_with_ties_repeats_nulls(spark):
    docs = corpus(1) + [(None, "en"), ("", "fr"), (" \n.", None), ("new york city. " * 30, "en"), ("la " * 50, "fr"), ("la la", "fr")]
    assert got(spark, docs) == brute(docs)


def test_blocks_cut_within_pieces_lose_nothing(spark):
    docs = corpus(2, 4, 900) + [("one two three four five " * 200, "en")]
    assert got(spark, docs, block_bytes=64) == brute(docs)


def test_longer_phrases_and_other_limits(spark):
    docs = corpus(3) + [("to be or not to be, " * 15 + "to be or. " * 4, "en")]
    kw = dict(min_count=4, max_words=5, top=25)
    assert got(spark, docs, **kw) == brute(docs, 4, 5, 25)
    assert got(spark, docs, max_words=2) == brute(docs, max_words=2)


def test_one_language_without_frequent_phrases_and_empty(spark):
    assert got(spark, [("all words differ here", "en")]) == []
    assert got(spark, []) == []


@pytest.mark.parametrize("limit, more", [(1, 2), (5, 1), (7, 3), (1000, 2)])
def test_chunks_cover_every_word_once(limit, more):
    data = b"one two,three  four\n\nfive six seven.eight " * 3
    owned = []
    for chunk, own_bytes in c._chunks(data, limit, more):
        words, _, own = c._words(chunk, own_bytes)
        owned += words.to_pylist()[:own]
    assert owned == re.findall(r"[^ ,\n.]+", data.decode())


def test_exact_score_beyond_64_bits(spark):
    df = spark.createDataFrame([(3_000_000_000, 3_000_000_001, 4_000_000_007)], "a long, l long, r long")
    from pyspark.sql import functions as F

    cut = c._lowest_cut(F.array("l", "a"), F.array("r", "a"), F.col("a"), 2)
    want = 1_000_000 * 3_000_000_000**2 // (3_000_000_001 * 4_000_000_007)
    assert df.select(cut["score"].alias("s")).head()["s"] == want
