import heapq
import random

import numpy as np
import pyarrow as pa

from modelgate.llm import nbest
from modelgate.llm.queries import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")


def all_best(text, vocabulary, names, n):
    """The n best scores by dynamic programming over all n-best prefixes."""
    if not text:
        return [0.0]
    text = "▁" + text.replace(" ", "▁")
    best = [[0.0]] + [[] for _ in text]
    for j in range(1, len(text) + 1):
        found = []
        for i in range(max(0, j - 16), j):
            score = names.get(text[i:j], vocabulary.unknown if i == j - 1 else None)
            if score is not None:
                found += [x + score for x in best[i]]
        best[j] = heapq.nlargest(n, found)
    return best[-1]


def names_of(path):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return {
        sp.id_to_piece(i): sp.get_score(i)
        for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))
    }


TEXTS = [
    "", None, "a", "  a  b ", "\n\n", "x\ty\n z", "日本語 ☃ 😀 mixed, Text.", "a▁b", "\x00a", "a" * 40, "Thntblere of then, edtioner in inea",
    "Éau euxç réê!! %%% <|x|> 12345 (a.b)", "one two three four five six seven " * 9,
]


def test_n_best_equal_dynamic_programming():
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice("abtheéß .,\n ") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    coder, names = nbest.Segmenter(PATH, 4), names_of(PATH)
    for _ in range(2):
        for text, found in zip(texts, coder.segment(pa.array(texts)), strict=True):
            assert np.allclose([s for s, _ in found], all_best(text, coder.vocabulary, names, 4)), text
            assert len({ids.tobytes() for _, ids in found}) == len(found)
            for _, ids in found:
                assert coder.vocabulary.decode(ids)[1:].decode() == (text or "").replace("▁", " ")


def test_encode_and_decode(spark):
    rows = [(i, t, "r") for i, t in enumerate(TEXTS)] + [(None, "x y", "r"), (2, "a", "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rank string")
    out = nbest.encode(df, PATH, n=3)
    assert out.columns[:2] == ["doc_id", "rank"] and "rank_" in out.columns
    back = nbest.decode(out, PATH).collect()
    texts = {i: t or "" for i, t, _ in rows}
    for r in back:
        assert r["text"] == texts[r["doc_id"]].replace("▁", " ")
        assert r["restored"] == (r["text"] == texts[r["doc_id"]])
        assert r["n_pieces"] == len(r["ids"])
    best = {}
    for r in back:
        best.setdefault((r["doc_id"], r["rank_"]), r["score"])
    for i in range(len(TEXTS)):
        scores = [best[i, k] for k in (1, 2, 3) if (i, k) in best]
        assert scores and scores == sorted(scores, reverse=True)
    assert nbest.encode(df.limit(0), PATH).count() == 0
