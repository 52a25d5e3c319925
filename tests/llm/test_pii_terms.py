"""Terms that give personal data away, against plain counting; values that stand in a large share of the texts."""

import math
import random
from collections import Counter, defaultdict

import pytest
import regex
from pyspark.sql import functions as F
from test_operators import base_of

from folioflow.llm import pii
from folioflow.llm.common import HEAVY_ROWS, heavy_join, salted_join


def brute_force(texts):
    """The spans column of every text."""
    distinct = sorted(set(texts))
    bases, words, holding, near, stands = {}, {}, defaultdict(set), defaultdict(set), Counter()
    for text in distinct:
        bases[text] = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in base_of(text)[1].split(",") if x)]
        words[text] = [(m.start(), m.end(), m[0].lower()) for m in regex.finditer(r"[\p{L}\p{N}]{3,}", text)]
        stands.update({w for _, _, w in words[text]})
        for kind, s, e in bases[text]:
            entity = (kind, text[s:e])
            holding[entity].add(text)
            around = [w for _, end, w in words[text] if end <= s][-6:] + [w for begin, _, w in words[text] if begin >= e][:6]
            for w in around:
                near[entity, w].add(text)
    told = defaultdict(dict)
    for (entity, w), where in near.items():
        if len(where) < 3 or len(holding[entity]) == len(distinct):
            continue
        share = len(holding[entity]) / len(distinct)
        value = math.log2(min(len(where) / stands[w], 1.0) / share) / -math.log2(share)
        if value >= 0.8:
            for text in holding[entity]:
                told[text][w] = max(value, told[text].get(w, 0))
    out = []
    for text in texts:
        found = [(told[text][w], s, e) for s, e, w in words[text] if w in told[text]]
        parts = [base_of(text)[1]] + [f"term:{s}:{e}" for v, s, e in found if v < 0.95] + [f"removed:{s}:{e}" for v, s, e in found if v >= 0.95]
        out.append(",".join(filter(None, parts)))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    people = [(f"name{k}", f"n{k}@corp.example", f"10.0.0.{k}") for k in range(12)]
    texts = []
    for _ in range(900):
        words = [rnd.choice(["alpha", "beta", "Gamma", "et", "über", "12345", "x"]) for _ in range(rnd.randint(0, 25))]
        if rnd.random() < 0.5:
            name, mail, ip = rnd.choice(people)
            at = rnd.randint(0, len(words))
            words[at:at] = rnd.choice([[name, "writes", mail], [name.upper(), mail, ip], [ip], [mail, "and", name], [name]])
        texts.append(" ".join(words))
    return texts + texts[:50] + ["", "a@b.cc"] * 2


@pytest.mark.parametrize("seed", [1, 2])
def test_spans_equal_plain_counting(spark, seed):
    texts = corpus(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["spans"] for r in pii.find(docs).collect()}
    expected = dict(enumerate(brute_force(texts)))
    assert got == expected
    assert any("term:" in s for s in expected.values()) and any("removed:" in s for s in expected.values())


def test_one_address_in_more_texts_than_a_task_should_hold(spark):
    """An email, an IP and a card in over HEAVY_ROWS distinct texts; copies of one text as many."""
    shared = "contact desk zorblax help@example.com or 10.1.2.3 card 4111111111111111"
    texts = [f"unlike{n} {shared} tail{n}" for n in range(HEAVY_ROWS + 200)] + [f"plain{n} words here" for n in range(900)] + [f"copied {shared}"] * (HEAVY_ROWS + 100)
    docs = spark.createDataFrame([(n, t, "s", 1) for n, t in enumerate(texts)], "doc_id long, text string, entity string, salt int").repartition(4)
    got = {r["doc_id"]: (r["spans"], r["n_email"]) for r in pii.find(docs).collect()}
    assert got == {n: (s, int("@" in t)) for n, (s, t) in enumerate(zip(brute_force(texts), texts, strict=True))}
    clean = pii.sanitise(docs)
    rows = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert clean.columns == docs.columns and len(rows) == len(texts)
    wrong = [(texts[n], t) for n, t in rows.items() if ("@" in texts[n]) != ("[EMAIL]" in t) or "4111111111111111" in t or "10.1.2.3" in t]
    assert not wrong, wrong[:3]


def test_joins_of_heavy_keys_are_plain_joins(spark):
    left = spark.range(5000).select(F.when(F.col("id") < 3500, 1).when(F.col("id") < 4900, F.col("id") % 7 + 2).alias("k"), F.col("id").alias("v"), F.lit("x").alias("salts"))
    right = spark.createDataFrame([(k, w) for k in range(1, 30) for w in ("a", "b")], "k long, w string")
    shares = left.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    rows = lambda df: Counter((r["k"], r["v"], r["w"]) for r in df.collect())
    plain = left.drop("salts")
    assert rows(salted_join(plain, right, "k", shares, "n", F.col("v"))) == rows(plain.join(right, "k"))
    single = right.filter("w = 'a'").join(shares, "k", "left").na.fill(0, ["n"])
    for how in ("left", "inner"):
        assert rows(heavy_join(plain, single, "k", "n", how)) == rows(plain.join(single.drop("n"), "k", how))
