"""Phrases against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from folioflow.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(docs, least, best):
    counts, totals = {}, Counter()
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(words)
            for m in range(1, 6):
                for i in range(len(words) - m + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + m])] += 1
    out = []
    for lang, found in counts.items():
        frequent = {p: n for p, n in found.items() if n >= least}
        longer = Counter()
        for p, n in frequent.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    longer[p[i : i + size]] = max(longer[p[i : i + size]], n)
        rows = []
        for p, a in frequent.items():
            if len(p) > 1 and longer[p] < a:
                score, k = min((1000 * a * totals[lang] // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        out += [(lang, n, p.decode(), -a, left, right, totals[lang], -score) for n, (score, a, p, left, right) in enumerate(sorted(rows)[:best], 1)]
    return out


def corpus(seed):
    rnd = random.Random(seed)
    words = ["Über", "ﬁx", "a", "B", "the", "of", "x-y", "été", "\x1cz", "😀", "A", "über"]
    phrases = [["new", "York", "city"], ["the", "of", "the"], ["a", "a"], ["deep", "blue", "sea", "so", "wide", "again"]]
    docs = [(None, None), ("en", ""), ("en", None), ("en", " \t "), (None, "New York City, new york"), ("und", "new york city")]
    for _ in range(150):
        parts = []
        for _ in range(rnd.randint(0, 40)):
            parts += rnd.choice(phrases) if rnd.random() < 0.4 else [rnd.choice(words)]
            parts.append(rnd.choice(["", "", "", ".", " ,", "\n", "\r\n", "!"]))
        docs.append((rnd.choice(["en", "en", "de", None]), rnd.choice([" ", "  ", "\t"]).join(parts)))
    return docs * 2


def mined(spark, docs, **options):
    table = spark.createDataFrame([(*d, 1, "p") for d in docs], "lang string, text string, n int, phrase string").repartition(5)
    rows = collocations.mine(table, **options).collect()
    return sorted((tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in rows), key=str)


@pytest.mark.parametrize("least, best", [(4, 2000), (12, 5)])
def test_phrases_equal_plain_counting(spark, monkeypatch, least, best):
    monkeypatch.setattr(collocations, "CHUNK", 3000)
    docs = corpus(least)
    expected = sorted(brute_force(docs, least, best), key=str)
    assert mined(spark, docs, least=least, best=best) == expected and len(expected) > 10


def test_bits_of_other_phrases_change_nothing(spark, monkeypatch):
    docs = corpus(2)
    monkeypatch.setattr(collocations, "frequent_bits", lambda level, grams, most: np.full(4096, 255, dtype=np.uint8))
    assert mined(spark, docs, least=6, best=50) == sorted(brute_force(docs, 6, 50), key=str)


@pytest.mark.parametrize("most", [1 << 15, 1 << 20])
def test_the_bitmap_holds_every_phrase(spark, most):
    rnd = np.random.default_rng(1)
    codes = rnd.integers(0, 1 << 64, 3000, dtype=np.uint64)
    level = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "code long")
    bitmap = collocations.frequent_bits(level, 3000, most)
    assert len(bitmap) * 8 <= most and collocations.marked(bitmap, codes).all()
    assert collocations.marked(bitmap, rnd.integers(0, 1 << 64, 3000, dtype=np.uint64)).mean() < 6000 / (8 * len(bitmap)) + 0.02


def test_scores_beyond_64_bits(spark):
    a, left, right, n = 3 * 10**12 + 7, 5 * 10**13 + 1, 7 * 10**13 + 3, 9 * 10**18 - 5
    levels = spark.createDataFrame([("en", "x y", a), ("en", "x", left), ("en", "y", right)], "lang string, phrase string, a long")
    row = collocations.scored(levels, spark.createDataFrame([("en", n)], "lang string, n long")).first()
    assert row["score"] == 1000 * a * n // (left * right)


def test_nothing_frequent(spark):
    assert mined(spark, []) == [] and mined(spark, [("en", "one two three")]) == []
