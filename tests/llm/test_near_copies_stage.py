"""The near-copies stage of the pipeline against brute force at five words and a similarity of 0.8."""

import random

import corpus_pipeline


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def kept(texts):
    """Numbers of the texts that are the smallest of their component, or without words."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def top(x):
        return x if root[x] == x else top(root[x])

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {n for n in root if top(n) == n}


def copies(seed):
    rnd = random.Random(seed)
    words = [f"W{i}" for i in range(300)]
    texts = ["", "One", "one two", "ONE TWO"]
    for _ in range(12):
        base = [rnd.choice(words) for _ in range(rnd.choice([3, 5, 9, 21, 40, 90, 300]))]
        for _ in range(rnd.choice([1, 2, 6, 20])):
            copy = list(base)
            for _ in range(int(len(copy) * rnd.choice([0, 0.01, 0.02, 0.03, 0.05]) + rnd.random())):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            texts.append(" ".join(copy + [rnd.choice(words) for _ in range(int(len(copy) * rnd.choice([0, 0, 0.1, 0.15, 0.2, 0.3])))]))
    return texts


def stage(spark, texts):
    docs = spark.createDataFrame([(n, t, "s") for n, t in enumerate(texts)], "doc_id long, text string, source string")
    out = corpus_pipeline.unlike(spark, docs, "")
    assert out.columns == docs.columns
    return {r["doc_id"] for r in out.collect()}


def test_a_copy_with_appended_or_changed_words_goes(spark):
    rnd = random.Random(3)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
    longer = base + [f"v{n}" for n in range(30)]
    changed = [f"u{n}" if n % 50 == 25 else w for n, w in enumerate(base)]
    other = [f"t{n}" for n in range(200)]
    assert stage(spark, [" ".join(t) for t in (base, longer, changed, other)]) == {0, 3}


def test_stage_equals_brute_force(spark):
    texts = copies(7)
    assert stage(spark, texts) == kept(texts)
