"""Operators 2 and 5 against plain Python: the same features, risk, gradient, weights and clusters, without numpy, hashes of words or Spark."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from folioflow.llm import embeddings, langid, toxicity


def fold(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def words_of(text):
    out, run = [], ""
    for char in (text or "").lower() + " ":
        if char.isalnum():
            run += char
        elif run:
            out.append(run)
            run = ""
    return out


def features_of(text):
    words = words_of(text)
    return {("word", w) for w in words} | {(size, w[:size]) for w in words for size in (4, 5, 6) if len(w) > size}


def sigmoid(z):
    return 1 / (1 + math.exp(-z)) if z > -500 else 0.0


def plain_toxicity(docs, labels):
    """Features, those of each distinct positive and unlabelled text, and the prior."""
    marked = defaultdict(int)
    for doc_id, toxic in labels:
        if doc_id is not None and toxic is not None and fold(doc_id, 3) != 1:
            marked[doc_id] = max(marked[doc_id], toxic)
    rows = [(d, t) for d, t in docs if d is not None and fold(d, 3) != 1]
    known = [t for d, t in rows if marked.get(d) == 1]
    positive = sorted(set(known))
    unlabelled = sorted({t for d, t in rows if marked.get(d) != 1}, key=str)  # a null text is one of its own
    found = Counter(f for t in positive for f in features_of(t))
    counted = Counter(f for d, t in rows if marked.get(d) != 1 for f in features_of(t))
    words, n, m = sorted((f for f in found if found[f] >= 3), key=str), len(positive), len(rows) - len(known)

    def part(k, total, share):
        share = min(max(share, 1e-12), 1 - 1e-12)
        return k * math.log(share) + (total - k) * math.log(1 - share)

    def ratio(a, b):
        joint = (a + b) / (n + m)
        return 2 * (part(a, n, a / n) + part(b, m, b / m) - part(a, n, joint) - part(b, m, joint)) if a / n > b / m else 0

    chosen = [w for w in words if ratio(found[w], counted[w]) >= 2 * math.log(max(len(words), 1) / 0.001)]
    p = sum(marked.values())
    left, others = max(len(rows) - len(marked), 0) * p / len(marked), max(len(rows) - p, 1)
    prior = min(max(left, 1.0), max(others - 1.0, 0.5)) / max(others, 2)
    has = lambda texts: [[f for f in chosen if f in features_of(t)] for t in texts]
    of_p, of_u = has(positive), has(unlabelled)
    return chosen, of_p, of_u, prior


def test_toxicity_learns_from_what_plain_counting_gives(spark, monkeypatch):
    """Features, texts and prior that reach the training, and the scores of its model, in plain Python. (The training itself starts at a
    point where the gradient of the bias is zero but for the last bit, so its path is not that of another order of summation.)"""
    seen = []
    train = toxicity.train

    def spy(words, positive, unlabelled, prior, rounds=200):
        seen.append((words, positive, unlabelled, prior, train(words, positive, unlabelled, prior, rounds)))
        return seen[-1][-1]

    monkeypatch.setattr(toxicity, "train", spy)
    rnd = random.Random(3)
    bad_id = lambda n: n % 6 == 0 or n % 45 == 0
    common, bad = ["alpha", "beta", "gamma9", "Überlänge", "des", "x"], ["scumbags", "scumbag", "VILEST"]
    docs = [(n, " ".join(rnd.choice(common) for _ in range(9)) + (" " + rnd.choice(bad) if bad_id(n) else "")) for n in range(240)]
    docs += docs[:7] + [(500, None), (501, ""), (None, "scumbag alpha"), (502, docs[6][1])]
    labels = [(n, int(bad_id(n))) for n in range(0, 240, 2)] + [(12, 0), (12, 1), (None, 1), (18, None), (9999, 1)]
    chosen, of_p, of_u, prior = plain_toxicity(docs, labels)
    rows = toxicity.toxicity(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    words, positive, unlabelled, found_prior, model = seen[0]
    assert found_prior == pytest.approx(prior, abs=1e-12) and len(words) == len(chosen) > 3
    number = {f: int(np.searchsorted(words, toxicity.features([f[1] + "-" * (f[0] == "word")])[1][0])) if f[0] == "word" else None for f in chosen}
    lists = lambda texts: Counter(len(x) for x in texts)
    sizes = lambda given: Counter(np.bincount(given[1], minlength=given[0]).tolist())
    assert sizes(positive) == lists(of_p) and sizes(unlabelled) == lists(of_u)
    for f, k in number.items():
        if k is not None:
            assert (positive[2] == k).sum() == sum(f in x for x in of_p) and (unlabelled[2] == k).sum() == sum(f in x for x in of_u)
    # Weights by plain features: those of beginnings by the words that have them.
    assert len(rows) == len(docs)
    by_id = dict(docs)
    scores = defaultdict(set)
    for r in rows:
        text = by_id[r["doc_id"]]
        scores[tuple(sorted(map(str, (f for f in chosen if f in features_of(text)))))].add(r["score"])
        at = {int(k) for k in np.flatnonzero(np.isin(words, toxicity.features([text])[1]))}
        assert r["score"] == pytest.approx(sigmoid(model.bias + sum(model.weights[k] for k in at)), abs=1e-12)
        assert r["predicted"] == (r["score"] >= 0.7) and r["held_out"] == (r["doc_id"] is not None and fold(r["doc_id"], 3) == 1)
    assert all(max(x) - min(x) < 1e-12 for x in scores.values()) and len(scores) > 2


@pytest.mark.parametrize("bias, prior", [(-1.0, 0.3), (-6.0, 0.9), (0.5, 0.1)])
def test_risk_and_gradient_equal_plain_sums(bias, prior):
    """On both sides of zero, and against differences of the risk itself."""
    rnd = random.Random(int(prior * 10))
    of_p, of_u = ([sorted(rnd.sample(range(5), rnd.randint(0, 4))) for _ in range(n)] for n in (7, 11))
    weights = [rnd.uniform(-1, 1) for _ in range(5)]
    loss = lambda z: math.log1p(math.exp(-abs(z))) + max(-z, 0)
    pairs = lambda texts: (len(texts), np.array([k for k, x in enumerate(texts) for _ in x], dtype=int), np.array([f for x in texts for f in x], dtype=int))

    def parts(w, b):
        fp, fu = ([b + sum(w[f] for f in x) for x in texts] for texts in (of_p, of_u))
        return prior * sum(map(loss, fp)) / len(fp), sum(loss(-z) for z in fu) / len(fu) - prior * sum(loss(-z) for z in fp) / len(fp)

    positive, negative, gradient = toxicity.risk(np.array(weights), bias, pairs(of_p), pairs(of_u), prior)
    assert (positive, negative) == pytest.approx(parts(weights, bias), abs=1e-12)
    assert (negative < 0) == (prior == 0.9)
    goal = lambda w, b: sum(parts(w, b)) if negative >= 0 else -parts(w, b)[1]
    for k in range(6):
        up, down = ([x + s * (i == k) for i, x in enumerate([*weights, bias])] for s in (1e-6, -1e-6))
        assert gradient[k] == pytest.approx((goal(up[:5], up[5]) - goal(down[:5], down[5])) / 2e-6, abs=1e-6)


def mix(x):
    mask = (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
    x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
    return x ^ x >> 31


def grams_of(text):
    text = (text or "").lower()
    at = lambda i: ord(text[i]) if 0 <= i < len(text) and text[i].isalpha() else 0x20
    return Counter(mix(at(i - 1) << 42 | ord(c) << 21 | at(i + 1)) % 4096 for i, c in enumerate(text) if c.isalpha())


def unit(vector):
    size = math.sqrt(sum(v * v for v in vector.values()))
    return {k: v / size for k, v in vector.items()} if size else {}


def dot(a, b):
    return sum(v * b.get(k, 0.0) for k, v in a.items())


def total(vectors):
    out = defaultdict(float)
    for v in vectors:
        for k, x in v.items():
            out[k] += x
    return out


def plain_clusters(rows, k):
    centres = [unit(total(rows))]
    while len(centres) < min(k, len(rows)):
        near = [max(dot(r, c) for c in centres) for r in rows]
        centres.append(rows[near.index(min(near))])
    for _ in range(langid.ROUNDS):
        best = [max(range(len(centres)), key=lambda c: (dot(r, centres[c]), -c)) for r in rows]
        centres = [unit(total([r for r, b in zip(rows, best, strict=True) if b == c])) if c in best else centres[c] for c in range(len(centres))]
    return centres


def test_languages_equal_plain_centroids(spark):
    rnd = random.Random(8)
    words = {"en": ["the", "house", "green", "walking", "dog"], "de": ["das", "haus", "grüne", "gehen", "hund"], "fr": ["la", "maison", "verte", "marche", "chien"]}
    docs = [(n, " ".join(rnd.choice(words[lang]) for _ in range(rnd.randint(3, 14))), lang) for n in range(90) for lang in [rnd.choice(["en", "de", "fr"])]]
    docs += docs[:5] + [(200, None, "en"), (201, "12 !", "de"), (202, "house hund", None), (None, "dog dog", None), (203, "", "und2")]
    train = [(t, lang) for d, t, lang in docs if lang is not None and d is not None and fold(d, 5) != 0]
    df = Counter(g for t, _ in train for g in grams_of(t))
    vector = lambda t: unit({g: math.log1p(n) * (math.log((1 + len(train)) / (1 + df[g])) + 1) for g, n in grams_of(t).items()})
    centres = []
    for lang in sorted({lang for _, lang in train}):
        own = [v for v in (vector(t) for t, of in train if of == lang) if v]
        centres += [(lang, c) for c in (plain_clusters(own, 4) if own else [])]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(1)
    rows = langid.language_id(table).collect()
    texts = {d: t for d, t, _ in docs}
    assert len(rows) == len(docs)
    for r in rows:
        v = vector(texts[r["doc_id"]])
        best = max(((dot(v, c), lang) for lang, c in centres), default=(0.0, "und")) if v else (0.0, "und")
        assert r["score"] == pytest.approx(best[0], abs=2e-5)
        assert r["lang_pred"] == best[1] or abs(best[0] - max(dot(v, c) for lang, c in centres if lang == r["lang_pred"])) < 2e-5


@pytest.mark.parametrize("width", [32, 64, 128, 384])
def test_recall_of_the_index_at_its_most_pivots(width):
    """Of pairs at a cosine of 0.9505, how many share two of their nearest of 4,096 pivots, and so meet in a list."""
    rnd = np.random.default_rng(width)
    draw = lambda n: embeddings._unit(rnd.normal(size=(n, width)))
    pivots, a, other = draw(embeddings.MAX_PIVOTS), draw(4000), draw(4000)
    other = embeddings._unit(other - (other * a).sum(axis=1, keepdims=True) * a)
    b = 0.9505 * a + math.sqrt(1 - 0.9505**2) * other
    near = [np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, : embeddings.NEAREST] for x in (a, b)]
    shared = (near[0][:, :, None] == near[1][:, None, :]).any(axis=2).sum(axis=1)
    assert (shared >= 2).mean() > 0.95
