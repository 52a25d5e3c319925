"""Unique output names by families against the sequential rule over all names."""

import random

import pytest

from folioflow.sources import manifest


@pytest.mark.parametrize("seed", [1, 2])
def test_names_equal_the_sequential_rule(spark, seed):
    rnd = random.Random(seed)
    stems = [rnd.choice(["a", "A", "b", "Ä", "c"]) + "".join(rnd.choice(["", "", "_2", "_3", "_10", "_02", "_x"]) for _ in range(rnd.randint(0, 3))) for _ in range(120)]
    stems += [f"alone{n}_{n}" for n in range(40)] + ["a", "A", "a_2", "_2", "_2"]
    rows = spark.createDataFrame(list(enumerate(stems)), "doc_id long, stem string").repartition(3)
    got = {r["doc_id"]: r["output_name"] for r in manifest.with_unique_names(rows).collect()}
    assert got == dict(enumerate(manifest.unique_names(stems)))
    low = spark.createDataFrame([(s.lower(), stems.count(s)) for s in set(stems) if s.startswith("alone")], "low string, rows long")
    assert manifest.families(low).count() == 0
    assert manifest.with_unique_names(rows.limit(0)).count() == 0
