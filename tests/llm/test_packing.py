import bisect
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from modelgate.llm.packing import WordTokenizer, best_fit_decreasing, pack, place
from modelgate.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


def plain_best_fit(items, size):
    rooms = []
    for x in sorted(items, reverse=True):
        j = bisect.bisect_left(rooms, x)
        room = rooms.pop(j) if j < len(rooms) else size
        bisect.insort(rooms, room - x)
    return rooms


@pytest.mark.parametrize("seed", range(60))
def test_plan_equals_best_fit_decreasing_one_by_one(seed):
    rng = random.Random(seed)
    size = rng.choice([10, 20, 50])
    items = [rng.randint(1, size) for _ in range(rng.randint(0, 90))]
    counts = {x: items.count(x) for x in items}
    plan = best_fit_decreasing(counts, size)
    rooms = plain_best_fit(items, size)
    assert plan.bins == len(rooms)
    if not items:
        return
    length = np.array([x for x in counts for _ in range(counts[x])])
    rank = np.array([i for x in counts for i in range(counts[x])])
    bins, offset = place(plan, length, rank, size)
    found = {}
    for b, o, n in zip(bins, offset, length, strict=True):
        found.setdefault(b, []).append((o, n))
    for spans in found.values():
        end = 0
        for o, n in sorted(spans):
            assert o == end
            end += n
        assert end <= size
    assert sorted(size - sum(n for _, n in s) for s in found.values()) == rooms


def test_word_tokenizer_equals_the_tokenizer():
    from tokenizers import Tokenizer

    texts = [
        "", None, "  a\t b\n\nc 's it's <|endoftext|> x<|startoftext|>y", "İ ΑΣ é é ́x y z", "a<|b|>c <| |>",
        "A.B,C. x́. É, É! ÀB. don't. Don'T, (ab) <|ENDOFTEXT|> ab.... 12. a1, ß, ΑΣ. é, İ. .,. ,", "日本 ☃ 😀",
        "the The THE the, THE. " * 40,
    ]
    coder, whole = WordTokenizer(PATH), Tokenizer.from_file(PATH)
    for _ in range(2):  # known words the second time
        ids, counts = coder.encode(pa.array(texts))
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for text, part in zip(texts, parts, strict=True):
            assert part.tolist() == whole.encode(text or "", add_special_tokens=False).ids + [0]


def test_word_tokenizer_learns_a_word_once_for_all_its_forms():
    coder = WordTokenizer(PATH)
    coder.encode(pa.array(["The the THE the, THE. (the) the;the #the The! Été été, ÉTÉ."]))
    assert len(coder.known) <= len([" ", "the", ",", ".", "(", ")", ";", "#", "!", "été"])


def test_word_tokenizer_on_any_characters_and_batches(monkeypatch):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    rng = random.Random(5)
    # marks, signs among letters, other scripts and spaces, contractions, special tokens
    parts = [*"aBsTé.,;'#0(\u0301\u0331\u0338×÷ÀßÞÿœŒİΣςжЖ\u00a0\u0085\u2028\x1c\x00語😀<|>", " ", "\n", "'s", "'LL", "H\u0331", "<|endoftext|>", "<|ENDOFTEXT|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [None, "", " \n "]
    want = [whole.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]

    def check(coder, array, first, n):
        ids, counts = coder.encode(array.slice(first, n))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want[first : first + n]

    for kind in (pa.string(), pa.large_string()):
        array = pa.array(texts, kind)
        coder = WordTokenizer(PATH)
        check(coder, array, 0, len(texts))
        for first in range(0, len(texts), 7):  # batches much smaller than the table of known units
            check(coder, array, first, min(7, len(texts) - first))
        check(coder, array, len(texts) - 3, 3)
    monkeypatch.setattr("modelgate.llm.packing.KNOWN_WORDS", 500)
    coder = WordTokenizer(PATH)
    for first in range(0, 3000, 100):  # restarts
        check(coder, array, first, 100)


def test_pack(spark):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["alpha", "Beta,", "x"]) for _ in range(rng.choice([0, 5, 60, 400, 5000]))), i) for i in range(60)]
    rows += [(None, "no id", 1), (3, rows[3][1], 3), (77, None, 2), (78, "", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int")
    out = pack(df, PATH)
    got = out.collect()
    whole = Tokenizer.from_file(PATH)
    names = {c: n for n, c in enumerate(out.columns)}
    assert out.columns[:2] == ["doc_id", "length"] and "length_" in names
    want = sorted(
        (str(i), p, p * 2048, zlib.crc32(np.array(ids[p * 2048 : (p + 1) * 2048], dtype="<u4").tobytes()))
        for i, t, _ in rows for ids in [whole.encode(t or "", add_special_tokens=False).ids + [0]]
        for p in range(-(-len(ids) // 2048))
    )
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["ids_crc32"]) for r in got) == want
    bins = {}
    for r in got:
        assert len(r["ids"]) == r["length_"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length_"]))
    for spans in bins.values():
        end = 0
        for o, n in sorted(spans):
            assert o == end
            end += n
        assert end <= 2048
    assert len(bins) == len(plain_best_fit([r["length_"] for r in got], 2048))
    assert pack(df.limit(0), PATH).count() == 0
