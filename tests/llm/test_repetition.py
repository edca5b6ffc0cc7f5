import random
import re

import numpy as np

from modelgate.llm.repetition import common_prefixes, keep_quality, repetition_stats


def longest_shared(doc):
    out = []
    for i in range(len(doc)):
        best = 0
        for j in range(len(doc)):
            if i != j:
                n = 0
                while max(i, j) + n < len(doc) and doc[i + n] == doc[j + n]:
                    n += 1
                best = max(best, n)
        out.append(best)
    return out


def brute(text, min_repeat=10, max_covered=0.3, max_longest=200):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    shared = longest_shared(words)
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    three, cover = set(), set()
    for i, n in enumerate(shared):
        if n >= 3:
            three.update(range(i, i + 3))
        if n >= min_repeat:
            cover.update(range(i, i + n))
    failed = len(words) < 50 or 100 * len(three) > 50 * len(words)
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(three), "covered_words": len(cover),
        "longest_repeat": max(shared, default=0), "base_failed": failed,
        "kept": not failed and len(cover) <= max_covered * len(words) and max(shared, default=0) <= max_longest,
    }


def test_common_prefixes_equal_brute_force():
    rng = random.Random(5)
    for _ in range(150):
        docs = [[rng.randint(0, 2) for _ in range(rng.randint(0, 25))] for _ in range(4)]
        rows = np.array([i for i, d in enumerate(docs) for _ in d], dtype=np.int64)
        keys = np.array([x for d in docs for x in d], dtype=np.int64)
        assert common_prefixes(keys, rows).tolist() == [x for d in docs for x in longest_shared(d)]


def texts():
    rng = random.Random(2)
    words = [f"w{i}é" for i in range(400)]
    plain = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = plain(30)
    return [
        None, "", " \n\t ", "one two", plain(60), "la " * 120, plain(80) + "\n" + passage + "\n" + plain(80) + "\n" + passage,
        passage + "\n" + passage + " x\n" + plain(20), plain(100) + " #a &b <c>|", "a\n\na\n b\nb\n" + plain(55), plain(3000),
        "zero\x00wide space " * 30,
    ]


def test_stats_equal_brute_force(spark):
    rows = [(i, t, "x", 1.0) for i, t in enumerate(texts())] + [(None, "a b", "x", 2.0), (4, texts()[4], "x", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality string, `kept.b` double")
    out = repetition_stats(df)
    assert out.columns[:4] == df.columns and out.columns[4] != "quality"
    got = [r.asDict(recursive=True) for r in out.collect()]
    assert len(got) == len(rows)
    for r in got:
        assert r[out.columns[4]] == brute(r["text"]), r["doc_id"]


def test_keep_and_empty(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = keep_quality(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, t in rows if brute(t)["kept"]}
    assert keep_quality(df.limit(0)).count() == 0
