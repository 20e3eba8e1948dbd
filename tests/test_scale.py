"""Steps whose rows or shuffles grew faster than their input, against brute force and by what they carry."""
import numpy as np
import pandas as pd
import pytest

from shotweave.operators import cuts, similarity
from tests.test_groups import random_slots, unit


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("k", [3, 40])
def test_best_of_all_with_copies_against_sorting(spark, k):
    x = unit(np.random.default_rng(k), 90)
    x = np.concatenate([x] * 60)[np.random.default_rng(1).permutation(5400)]          # ties of sixty copies go to the smaller id
    s = spark.createDataFrame(pd.DataFrame({"shot_id": np.arange(5400) * 3, "emb": list(map(list, x))})).repartition(7)
    q = spark.createDataFrame(pd.DataFrame({"query_id": np.arange(700), "qe": list(map(list, x[:700])), "skip_id": np.arange(700) * 3}))
    top = similarity.dense_topk(q, s, k, -1.0, 1.5)
    got = {(r.query_id, r["rank"]): r.shot_id for r in top.collect()}
    kinds, of = np.unique(x, axis=0, return_inverse=True)
    score = np.einsum("ik,jk->ij", kinds, kinds).round(12)
    want = {}
    for i in range(700):
        v = score[of[i]][of]
        o = [j for j in np.lexsort((np.arange(5400), -v)) if j != i and v[j] >= v.max() - 1.5][:k]
        want |= {(i, r + 1): j * 3 for r, j in enumerate(o)}
    assert got == want
    assert "Exchange hashpartitioning" not in plan_of(top)


def test_greedy_alone_equals_greedy_of_the_plan_and_carries_no_vectors(spark):
    parts = []
    for i in range(5):
        p = random_slots(i, 6, 3).assign(script_id=i)
        p["shot_id"] = np.random.default_rng(i).integers(0, 5, len(p))               # candidates run out
        parts.append(p.drop_duplicates(["slot_i", "shot_id"]))
    p = pd.concat(parts)
    p["emb"] = p["emb"].map(list)
    n = spark.createDataFrame(p)
    key = lambda d: sorted((r.script_id, r.slot_i, r.greedy_shot or -1) for r in d.collect())
    alone = cuts.greedy_sequence(n)
    assert key(alone) == key(cuts.plan_sequence(n, passes=0))
    assert any(r.greedy_shot is None for r in alone.collect())
    assert "emb" not in alone._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[0]
