"""Token counts and alignments against the libraries themselves."""

import random

import pytest

from folioflow.llm import queries
from folioflow.llm.token_counts import Summary, count_tokens, merged

PARTS = ["a", "B", "é", "É", " ", "  ", "\n", "\t", "'", "'s", "'S", "'re", "'ll", "1", "²", "½", "!", "，", "中", "😀", "x", "́", "H̱", "İ", "Σ", "Ω", "ǅ", "ẞ", "\x1c", "\x85", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "한", "한", "क़", "\x00", "ﬁ", "▁", "<0x41>", "<s>", "\xa0", "don't", "ſ", "the", "WORLD"]


def hostile(n, seed=5):
    rnd = random.Random(seed)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 30))) for _ in range(n)]
    return [*texts, None, "", " ", " " * 300, "x" * 5000, "w " * 3000, "same", "same"]


def table(spark, texts):
    rows = [(k, t, "t", 1) for k, t in enumerate(texts)] + [(None, "no id", "t", 1), (0, "again", "t", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, node string, keys int").repartition(40)


def counter(name):
    if name.endswith(".model"):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary(name))
        return lambda text: len(library.encode(text))
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary(name))
    return lambda text: len(library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("name, size", [("word_bpe_49k.json", 16), ("word_bpe_49k.json", 1 << 14), ("byte_bpe_50k.json", 64), ("piece_bpe_32k.model", 64)])
def test_counts_are_the_librarys(spark, name, size):
    texts, count = hostile(1500), counter(name)
    rows = count_tokens(table(spark, texts), queries.vocabulary(name), limit=20, size=size).collect()
    expected = sorted([(k, t or "") for k, t in enumerate(texts)] + [(-1, "no id"), (0, "again")])
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows)
    assert got == sorted((k, len(t.encode()), count(t), count(t) > 20) for k, t in expected)


def test_counts_of_an_empty_table(spark):
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), queries.vocabulary("word_bpe_49k.json")).count() == 0


def test_summaries_keep_what_is_frequent():
    rnd = random.Random(1)
    every = [k for k in range(1, 3000) for _ in range(30_000 // k)]
    rnd.shuffle(every)
    rows = []
    for part in range(8):
        held = Summary(200)
        for at in range(part, 80, 8):
            some = sorted(every[at::80])
            keys = sorted(set(some))
            import numpy as np

            held.add(np.array(keys, dtype=np.uint64), np.array([some.count(k) for k in keys]), lambda p, keys=keys: np.array([f"p{keys[i]}" for i in p] + [None], dtype=object)[:-1])
        batch = held.batch(part)
        rows.append(tuple(batch.column(c)[0].as_py() for c in ("keys", "counts", "pieces")))
    held = merged(rows, 200)
    assert len(held.keys) <= 200 and {k for k in range(1, 3000) if 30_000 // k > len(every) / 200} <= set(held.keys.tolist())
    assert all(piece == f"p{key}" for key, piece in zip(held.keys.tolist(), held.pieces, strict=True))
