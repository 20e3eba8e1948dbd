"""Placements against shots and lines: results by hand, and how many rows the range joins read."""
import numpy as np
import pandas as pd

from shotweave.operators import memory


def rows_into_joins(df) -> int:
    """Rows that the range joins of a query read, after all its nodes ran."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        for name in ("finalPhysicalPlan", "plan"):
            if p.getClass().getSimpleName() in ("AdaptiveSparkPlanExec", "ShuffleQueryStageExec", "BroadcastQueryStageExec") and name in [m.getName() for m in p.getClass().getMethods()]:
                todo.append(getattr(p, name)())
        if "Generate" in p.getClass().getSimpleName():
            total += p.metrics().apply("numOutputRows").value()
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return total


def overlap_by_hand(p, s):
    out = set()
    for a in p.itertuples():
        best = max(((min(z.t_end, a.src_out) - max(z.t_start, a.src_in), -z.shot_id) for z in s.itertuples() if z.file_id == a.file_id), default=(-9, 0))
        if best[0] > -1:
            out.add((a.p_id, -best[1], round(best[0], 6)))
    return out


def test_best_overlap_with_many_equal_shots(spark):
    rng = np.random.default_rng(4)
    p = pd.DataFrame({"p_id": range(80), "file_id": rng.integers(0, 3, 80), "src_in": rng.integers(0, 90, 80) * 1.0})
    p["src_out"] = p.src_in + rng.integers(0, 9, 80)
    s = pd.DataFrame({"shot_id": rng.permutation(3000), "file_id": rng.integers(0, 3, 3000), "t_start": rng.integers(0, 25, 3000) * 4.0})
    s["t_end"] = s.t_start + rng.integers(1, 3, 3000) * 2
    got = memory.best_overlap_shot(spark.createDataFrame(p), spark.createDataFrame(s))
    assert {(r.p_id, r.shot_id, round(r.overlap, 6)) for r in got.collect()} == overlap_by_hand(p, s)
    assert rows_into_joins(got) < 1000                      # 3,000 shots are 150 different stretches


def test_covering_line_with_long_lines(spark):
    s = pd.DataFrame({"project": [1, 1, 2, 2], "i": [1, 2, 1, 2], "a": [0.0, 90000.0, 30.0, 50.0], "b": [90000.0, 180000.0, 50.0, 100.0], "text": list("abcd")})
    p = pd.DataFrame({"p_id": range(8), "project": [1, 1, 1, 1, 2, 2, 2, 2], "rec_in": [0.0, 89999.0, 90000.0, 179999.0, 10.0, 30.0, 49.0, 99.0]})
    p["rec_out"] = p.rec_in + 2
    got = memory.covering_line(spark.createDataFrame(p), spark.createDataFrame(s))
    want = {(0, "a"), (1, "b"), (2, "b"), (3, "b"), (5, "c"), (6, "d"), (7, "d")}
    assert {(r.p_id, r.text) for r in got.collect()} == want
    assert rows_into_joins(got) < 50                        # 60 s bins make 3,000 rows of the two long lines
