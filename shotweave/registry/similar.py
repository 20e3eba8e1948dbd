"""Retrieval over the whole embedding table: every shot is a query that skips itself."""
from pyspark.sql import functions as F

from ..functions import text, vector
from ..operators import aggregates, filters, retrieval, similarity, windows
from ..plans import search as search_plan
from . import bindings as b
from .base import query

DELTA = 0.15            # thresholds sized to the test vectors, whose cosines are low
SIM = 0.20

GATED = b.SCORED + f""",
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, shot_id) AS rank FROM scored QUALIFY rank <= 500),
gated AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM top) WHERE score >= greatest(0.18, best - {DELTA}))"""


@query("dense_topk", b.with_sql(b.SHOTS, b.SCORED) + """
SELECT query_id, shot_id, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, shot_id) AS rank FROM scored QUALIFY rank <= 20""")
def dense_topk(spark, d):
    s = b.shots(spark, d)
    return similarity.dense_topk(b.self_queries(s), s, 20).withColumn("score", F.round("score", 4))


@query("dense_topk_gated", b.with_sql(b.SHOTS, GATED) + """,
capped AS (SELECT g.*, row_number() OVER (PARTITION BY query_id, source_key ORDER BY score DESC, g.shot_id) AS n FROM gated g JOIN shots USING (shot_id) QUALIFY n <= 4)
SELECT query_id, shot_id, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, shot_id) AS place FROM capped QUALIFY place <= 10""")
def dense_topk_gated(spark, d):
    s = b.shots(spark, d)
    g = retrieval.relevant(b.self_queries(s), s, 4, min_score=0.18, delta=DELTA, sim=None, k=10)
    return g.select("query_id", "shot_id", F.round("score", 4).alias("score"), F.col("rank").alias("place"))


TERMS = "terms AS (SELECT shot_id AS query_id, list_distinct({t}) AS want FROM shots)"


def _terms_sql():
    from .language import sql_tokens
    return TERMS.format(t=sql_tokens("tags")) + f""",
hay AS (SELECT shot_id, source, list_distinct({sql_tokens("title || ' ' || tags")}) AS hay FROM shots)"""


@query("hybrid_rank", b.with_sql(b.SHOTS, b.SCORED, _terms_sql()) + """,
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, shot_id) AS r0 FROM scored QUALIFY r0 <= 500),
h AS (SELECT query_id, t.shot_id, score + CASE WHEN r0 <= 300 AND source <> 'own' AND len(want) > 0 THEN 0.07::DOUBLE * len(list_intersect(want, hay)) / len(want) ELSE 0 END AS score
      FROM top t JOIN terms USING (query_id) JOIN hay ON hay.shot_id = t.shot_id)
SELECT query_id, shot_id, round(score, 4) AS score FROM h""")
def hybrid_rank(spark, d):
    s = b.shots(spark, d)
    terms = s.select(F.col("shot_id").alias("query_id"), text.tokens(F.col("tags")).alias("terms"))
    return retrieval.hybrid_topk(b.self_queries(s), s, s.where("source <> 'own'"), terms, 500, pool=300).select("query_id", "shot_id", F.round("score", 4).alias("score"))


# greedy near-duplicate removal: walk the ranks of all queries together, carrying the kept ids
KEPT = GATED + f""",
g AS (SELECT query_id, gated.shot_id, score, source_key, t_start, emb, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, gated.shot_id) AS rk
      FROM gated JOIN shots ON shots.shot_id = gated.shot_id),
clash AS (SELECT a.query_id, a.rk, list(z.shot_id) AS ids FROM g a JOIN g z ON a.query_id = z.query_id AND z.rk < a.rk AND a.source_key = z.source_key
      AND abs(a.t_start - z.t_start) < 10 AND list_inner_product(a.emb, z.emb) > {SIM} GROUP BY 1, 2),
walk AS (SELECT query_id, 0::BIGINT AS rk, []::BIGINT[] AS kept, NULL::BIGINT AS took FROM (SELECT DISTINCT query_id FROM g)
   UNION ALL
   SELECT w.query_id, g.rk, CASE WHEN list_has_any(coalesce(c.ids, []), w.kept) THEN w.kept ELSE list_append(w.kept, g.shot_id) END,
          CASE WHEN list_has_any(coalesce(c.ids, []), w.kept) THEN NULL ELSE g.shot_id END
   FROM walk w JOIN g ON g.query_id = w.query_id AND g.rk = w.rk + 1 LEFT JOIN clash c ON c.query_id = g.query_id AND c.rk = g.rk),
distinct_rows AS (SELECT w.query_id, w.took AS shot_id, g.score, g.source_key, g.emb FROM walk w JOIN g ON g.query_id = w.query_id AND g.shot_id = w.took)"""


@query("near_duplicate_removal", b.with_sql(b.SHOTS, KEPT, recursive=True) +
       "SELECT query_id, shot_id, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, shot_id) AS rank FROM distinct_rows")
def near_duplicate_removal(spark, d):
    s = b.shots(spark, d)
    return retrieval.relevant(b.self_queries(s), s, None, min_score=0.18, delta=DELTA, sim=SIM, window=10.0).withColumn("score", F.round("score", 4))


CAPPED = KEPT + """,
capped AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_key ORDER BY score DESC, shot_id) AS n FROM distinct_rows QUALIFY n <= 4)"""
MMR = CAPPED + """,
pool AS (SELECT query_id, shot_id, emb, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, shot_id) AS rk,
   CASE WHEN max(score) OVER w - min(score) OVER w > 1e-9 THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END AS rn
   FROM (SELECT * FROM capped QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, shot_id) <= 100) WINDOW w AS (PARTITION BY query_id)),
sims AS (SELECT a.query_id, a.rk AS a, z.rk AS z, list_inner_product(a.emb, z.emb) AS s FROM pool a JOIN pool z ON a.query_id = z.query_id),
steps AS (SELECT query_id, 1 AS n, [1]::BIGINT[] AS chosen FROM pool WHERE rk = 1
   UNION ALL
   SELECT query_id, any_value(n) + 1, list_append(any_value(chosen), arg_max(rk, v * 1e6 - rk * 1e-6)) FROM (
     SELECT st.query_id, st.n, st.chosen, p.rk, 0.7::DOUBLE * any_value(p.rn) - 0.3::DOUBLE * max(x.s) AS v
     FROM steps st JOIN pool p ON p.query_id = st.query_id JOIN sims x ON x.query_id = p.query_id AND x.a = p.rk
     WHERE st.n < 8 AND NOT list_contains(st.chosen, p.rk) AND list_contains(st.chosen, x.z) GROUP BY st.query_id, st.n, st.chosen, p.rk) GROUP BY query_id)"""


@query("diverse_picks", b.with_sql(b.SHOTS, MMR, recursive=True) + """
SELECT s.query_id, p.shot_id, s.n AS pick, round(p.score, 4) AS score FROM steps s JOIN pool p ON p.query_id = s.query_id AND p.rk = s.chosen[-1]""")
def diverse_picks(spark, d):
    s = b.shots(spark, d)
    rel = retrieval.relevant(b.self_queries(s), s, 4, min_score=0.18, delta=DELTA, sim=SIM, varied=(8, 0.3))
    return rel.select("query_id", "shot_id", "pick", F.round("score", 4).alias("score"))


@query("planner_candidates", b.with_sql(b.SHOTS, KEPT, recursive=True) + """,
capped AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_key ORDER BY score DESC, shot_id) AS n FROM distinct_rows QUALIFY n <= 3)
SELECT query_id, shot_id, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, shot_id) AS rank FROM capped QUALIFY rank <= 8""")
def planner_candidates(spark, d):
    s = b.shots(spark, d)
    return retrieval.candidates(b.self_queries(s), s, 8, min_score=0.18, delta=DELTA, sim=SIM).withColumn("score", F.round("score", 4))


@query("missing_variety", b.with_sql(b.SHOTS, GATED) + """,
n AS (SELECT query_id, count(*) AS n, list(DISTINCT size) AS have FROM gated JOIN shots USING (shot_id) GROUP BY 1)
SELECT query_id, array_to_string(CASE WHEN n >= 3 THEN list_filter(['wide', 'medium', 'close'], lambda x: NOT list_contains(have, x)) ELSE [] END, ',') AS missing FROM n""")
def missing_variety(spark, d):
    s = b.shots(spark, d)
    g = filters.gate(similarity.dense_topk(b.self_queries(s), s, 500, 0.18, DELTA), 0.18, DELTA).join(s.select("shot_id", "size"), "shot_id")
    return aggregates.missing_variety(g).select("query_id", F.array_join("missing", ",").alias("missing"))


SIMILAR = b.SCORED + f""",
pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, shot_id) AS r FROM scored QUALIFY r <= 300),
gated AS (SELECT p.query_id, p.shot_id, p.score FROM pool p JOIN shots s ON s.shot_id = p.shot_id JOIN shots q ON q.shot_id = p.query_id
          WHERE NOT (s.source_key = q.source_key AND abs(s.t_start - q.t_start) < 10)),
-- clashes lie inside a source, so each source of a query is walked on its own
g AS (SELECT query_id || ':' || source_key AS walk_id, query_id, gated.shot_id, score, source_key, t_start, emb,
      row_number() OVER (PARTITION BY query_id, source_key ORDER BY score DESC, gated.shot_id) AS rk FROM gated JOIN shots ON shots.shot_id = gated.shot_id),
clash AS (SELECT a.walk_id, a.rk, list(z.shot_id) AS ids FROM g a JOIN g z ON a.walk_id = z.walk_id AND z.rk < a.rk
      AND abs(a.t_start - z.t_start) < 10 AND list_inner_product(a.emb, z.emb) > {SIM} GROUP BY 1, 2),
step AS (SELECT g.walk_id, g.rk, g.shot_id, coalesce(c.ids, []) AS ids FROM g LEFT JOIN clash c ON c.walk_id = g.walk_id AND c.rk = g.rk),
walk AS (SELECT walk_id, 0::BIGINT AS rk, []::BIGINT[] AS kept, NULL::BIGINT AS took FROM (SELECT DISTINCT walk_id FROM g)
   UNION ALL
   SELECT w.walk_id, s.rk, CASE WHEN list_has_any(s.ids, w.kept) THEN w.kept ELSE list_append(w.kept, s.shot_id) END,
          CASE WHEN list_has_any(s.ids, w.kept) THEN NULL ELSE s.shot_id END
   FROM walk w JOIN step s ON s.walk_id = w.walk_id AND s.rk = w.rk + 1),
distinct_rows AS (SELECT g.query_id, w.took AS shot_id, g.score, g.source_key, g.emb FROM walk w JOIN g ON g.walk_id = w.walk_id AND g.shot_id = w.took)"""


@query("similar_shots", b.with_sql(b.SHOTS, SIMILAR, recursive=True) + """,
capped AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_key ORDER BY score DESC, shot_id) AS n FROM distinct_rows QUALIFY n <= 2)
SELECT query_id, shot_id, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, shot_id) AS rank FROM capped QUALIFY rank <= 12""")
def similar_shots(spark, d):
    s = b.shots(spark, d)
    return retrieval.similar(s.select("shot_id"), s, 12, sim=SIM).withColumn("score", F.round("score", 4))


@query("search_pages")
def search_pages(spark, d):
    """Clusters with labels; average-linkage grouping has no SQL form (compared with brute force in the tests)."""
    s = b.shots(spark, d)
    r = search_plan.search(b.self_queries(s), s, b.vocab(spark, d), k=12, delta=DELTA, sim=SIM, dist=0.85)
    return r.select("query_id", "shot_id", F.round("score", 4).alias("score"), "cluster", "label", "place", "n_relevant", F.array_join("missing", ",").alias("missing"))


@query("shot_clusters")
def shot_clusters(spark, d):
    s = b.shots(spark, d)
    g = retrieval.clustered_topk(b.self_queries(s), s, b.vocab(spark, d), 12, 0.85)
    return windows.order_clusters(g).select("query_id", "shot_id", "cluster", "label", "place")


@query("cluster_order", b.with_sql(b.SHOTS, b.SCORED) + """,
t AS (SELECT query_id, scored.shot_id, score, size AS cluster, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, scored.shot_id) AS r FROM scored JOIN shots ON shots.shot_id = scored.shot_id QUALIFY r <= 12)
SELECT query_id, shot_id, cluster, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, cluster, score DESC, shot_id) AS place
FROM (SELECT *, max(score) OVER (PARTITION BY query_id, cluster) AS best FROM t)""")
def cluster_order(spark, d):
    s = b.shots(spark, d)
    c = similarity.dense_topk(b.self_queries(s), s, 12).join(s.select("shot_id", F.col("size").alias("cluster")), "shot_id")
    return windows.order_clusters(c).select("query_id", "shot_id", "cluster", "place")


@query("nearest_concepts", b.with_sql(b.SHOTS, b.VOCAB) + """
SELECT shot_id AS line_id, word, round(list_inner_product(s.emb, v.emb), 4) AS sim, row_number() OVER (PARTITION BY shot_id ORDER BY list_inner_product(s.emb, v.emb) DESC, word) AS rank
FROM shots s, vocab v QUALIFY rank <= 2""")
def nearest_concepts(spark, d):
    s = b.shots(spark, d)
    return retrieval.concepts(s.select(F.col("shot_id").alias("line_id"), "emb"), b.vocab(spark, d), 2).withColumn("sim", F.round("sim", 4))


@query("zero_shot_labels", b.with_sql(b.SHOTS, b.VOCAB) + """,
m AS (SELECT shot_id, 'label ' || (right(word, 2)::INTEGER // 5) AS label, max(list_inner_product(s.emb, v.emb)) AS x FROM shots s, vocab v GROUP BY 1, 2)
SELECT shot_id, arg_max(label, x) AS label, round(1 / sum(exp((x - mx) * 100)), 4) AS conf FROM (SELECT *, max(x) OVER (PARTITION BY shot_id) AS mx FROM m) GROUP BY shot_id""")
def zero_shot_labels(spark, d):
    v = b.vocab(spark, d).select(F.lit("size").alias("grp"), F.concat(F.lit("label "), F.floor(F.right("word", F.lit(2)).cast("int") / 5).cast("string")).alias("label"), "emb")
    return retrieval.zero_shot(b.shots(spark, d), v, "size").withColumn("conf", F.round("conf", 4))


@query("softmax_arg_max", b.with_sql(b.SHOTS) + """,
e AS (SELECT shot_id, unnest(emb) AS x, unnest(range(len(emb))) AS i FROM shots),
p AS (SELECT shot_id, i, exp((x - max(x) OVER (PARTITION BY shot_id)) * 10) AS w FROM e), q AS (SELECT shot_id, i, w / sum(w) OVER (PARTITION BY shot_id) AS p FROM p)
SELECT shot_id, 'c' || arg_max(i, p) AS label, round(max(p), 4) AS score FROM q GROUP BY 1""")
def softmax_arg_max(spark, d):
    s = b.shots(spark, d).select("shot_id", F.posexplode(vector.softmax(F.col("emb"), 10.0)).alias("i", "p"))
    return aggregates.argmax_label(s.withColumn("l", F.concat(F.lit("c"), F.col("i").cast("string"))), "shot_id", "l", "p").withColumn("score", F.round("score", 4))


@query("threshold_pairs", b.with_sql(b.SHOTS) + """SELECT a.shot_id AS id, z.shot_id AS other, round(list_inner_product(a.emb, z.emb), 4) AS cos
FROM shots a JOIN shots z ON a.shot_id <> z.shot_id WHERE list_inner_product(a.emb, z.emb) > 0.35""")
def threshold_pairs(spark, d):
    s = b.shots(spark, d).select(F.col("shot_id").alias("id"), "emb")
    return similarity.similar_pairs(s, s, 0.35).withColumn("cos", F.round("cos", 4))


@query("near_existing_items", b.with_sql(b.SHOTS) + """SELECT DISTINCT a.shot_id AS id FROM shots a JOIN shots z ON a.shot_id % 2 = 1 AND z.shot_id % 2 = 0 WHERE list_inner_product(a.emb, z.emb) > 0.35""")
def near_existing_items(spark, d):
    s = b.shots(spark, d).select(F.col("shot_id").alias("id"), "emb")
    return similarity.has_similar(s.where("id % 2 = 1"), s.where("id % 2 = 0"), 0.35, same=False)


@query("ingest_near_duplicates", b.with_sql(b.SHOTS, recursive=True) + """,
new AS (SELECT shot_id AS id, emb FROM shots WHERE shot_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM shots z WHERE z.shot_id % 2 = 0 AND list_inner_product(shots.emb, z.emb) > 0.35)),
o AS (SELECT *, row_number() OVER (ORDER BY id) AS rk FROM new),
clash AS (SELECT a.rk, list(z.id) AS ids FROM o a JOIN o z ON z.rk < a.rk AND list_inner_product(a.emb, z.emb) > 0.35 GROUP BY 1),
walk AS (SELECT 0::BIGINT AS rk, []::BIGINT[] AS kept, NULL::BIGINT AS took UNION ALL
  SELECT o.rk, CASE WHEN list_has_any(coalesce(c.ids, []), w.kept) THEN w.kept ELSE list_append(w.kept, o.id) END, CASE WHEN list_has_any(coalesce(c.ids, []), w.kept) THEN NULL ELSE o.id END
  FROM walk w JOIN o ON o.rk = w.rk + 1 LEFT JOIN clash c ON c.rk = o.rk)
SELECT took AS id FROM walk WHERE took IS NOT NULL""")
def ingest_near_duplicates(spark, d):
    s = b.shots(spark, d).select(F.col("shot_id").alias("id"), "emb", F.col("shot_id").alias("ord"))
    return retrieval.ingest_dedupe(s.where("id % 2 = 1"), s.where("id % 2 = 0").select("id", "emb"), 0.35)


@query("cluster_centroids", b.with_sql(b.VOCAB) + "SELECT word, unnest(range(len(emb))) AS pos, round(unnest(emb), 4) AS x FROM vocab")
def cluster_centroids(spark, d):
    return b.vocab(spark, d).select("word", F.posexplode("emb").alias("pos", "x")).withColumn("x", F.round("x", 4))
