"""Canonical tables derived from the driver tables, as Spark frames and as SQL text (CTE bodies) side by side."""
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text, vector

SIZES = ["wide", "medium", "close", "detail", "aerial"]
MOTIONS = ["still", "moderate", "action"]
ORIENT = ["16:9", "9:16", "1:1"]
SOURCES = ["own", "pixabay", "commons", "archive"]
CLASSES = ["own", "safe", "attribution", "caution", "restricted", "unknown"]
WEATHER = ["rain", "sunny", "fog", "snow", "night", "cloudy"]
LICENCES = ["CC0", "CC BY 4.0", "CC BY-SA 3.0", "CC BY-NC 2.0", "Pixabay Content License", "", "Standard"]
WORDS = ["market", "rainy streets", "trains", "running people", "aerial city", "closing doors", "boxes"]
STRIDE = 1 << 20            # turns per conversation and sentences per turn; packed() refuses more


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def packed(high, low):
    """One number for two keys. A second key beyond STRIDE, or a product beyond a long, is an error and never another pair's number."""
    at = lambda c: F.col(c) if isinstance(c, str) else c
    fits = at(low) < STRIDE
    return F.when(fits, at(high).cast("long") * STRIDE + at(low)).otherwise(F.raise_error(F.lit("more turns or sentences than a packed id can hold")).cast("long"))


def pick(values, key):
    """values[key % n] as a column."""
    return F.element_at(F.lit(values), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def sql_pick(values, key: str) -> str:
    return "([" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"])[({key}) % {len(values)} + 1]"


# ------------------------------------------------------------------------------------------ shots
def shots(spark, d) -> DataFrame:
    v = F.col("vec_id")
    p = table(spark, d, "part")
    n = p.count()
    e = table(spark, d, "embeddings").select(
        v.alias("shot_id"), F.col("label").cast("long").alias("file_id"), F.concat(F.lit("f"), F.col("label").cast("string")).alias("source_key"),
        ((v % 25) * 4.0).alias("t_start"), ((v % 25) * 4.0 + 4.0).alias("t_end"), vector.as_double(F.col("embedding")).alias("emb"),
        pick(SIZES, v).alias("size"), pick(MOTIONS, v).alias("motion"), pick(ORIENT, v).alias("orientation"), pick(SOURCES, v).alias("source"),
        pick(CLASSES, v).alias("licence_class"), (v % 4).alias("lib"), pick(WEATHER, v).alias("weather"), ((v % 50) / 50.0).alias("weather_conf"),
        F.pmod(v, F.lit(n)).alias("p_partkey"))
    return e.join(p.select("p_partkey", F.col("p_name").alias("title"), F.concat_ws(", ", F.lower("p_type"), pick(WORDS, F.col("p_partkey"))).alias("tags")),
                  "p_partkey", "left").drop("p_partkey")


SHOTS = f"""
shots AS (
  SELECT e.vec_id AS shot_id, label::BIGINT AS file_id, 'f' || label AS source_key, (vec_id % 25) * 4.0::DOUBLE AS t_start,
         (vec_id % 25) * 4.0::DOUBLE + 4.0 AS t_end, embedding::DOUBLE[] AS emb,
         {sql_pick(SIZES, 'vec_id')} AS size, {sql_pick(MOTIONS, 'vec_id')} AS motion, {sql_pick(ORIENT, 'vec_id')} AS orientation,
         {sql_pick(SOURCES, 'vec_id')} AS source, {sql_pick(CLASSES, 'vec_id')} AS licence_class, vec_id % 4 AS lib,
         {sql_pick(WEATHER, 'vec_id')} AS weather, (vec_id % 50) / 50.0::DOUBLE AS weather_conf,
         p.p_name AS title, concat_ws(', ', lower(p.p_type), {sql_pick(WORDS, 'p.p_partkey')}) AS tags
  FROM embeddings e LEFT JOIN part p ON p.p_partkey = e.vec_id % (SELECT count(*) FROM part))"""


def self_queries(s: DataFrame) -> DataFrame:
    """Every shot as a query that skips itself."""
    return s.select(F.col("shot_id").alias("query_id"), F.col("emb").alias("qe"), F.col("shot_id").alias("skip_id"))


SCORED = """
scored AS (
  SELECT q.shot_id AS query_id, s.shot_id, list_inner_product(q.emb, s.emb) AS score
  FROM shots q JOIN shots s ON q.shot_id <> s.shot_id)"""


def vocab(spark, d) -> DataFrame:
    """Fifty concept vectors: unit means of (label, remainder) groups of the whole table."""
    from ..operators.aggregates import mean_embedding
    e = table(spark, d, "embeddings").select(
        F.concat(F.lit("concept "), F.lpad((F.col("label") * 5 + F.col("vec_id") % 5).cast("string"), 2, "0")).alias("word"),
        vector.as_double(F.col("embedding")).alias("emb"))
    return mean_embedding(e, "word").select("word", "emb")


SQL_UNIT_MEAN = """
{name}_sum AS (SELECT word, pos, sum(x) AS x FROM (
    SELECT {key} AS word, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY 1, 2),
{name}_norm AS (SELECT word, sqrt(sum(x * x)) AS n FROM {name}_sum GROUP BY 1),
{name} AS (SELECT s.word, list(s.x / n.n ORDER BY pos) AS emb FROM {name}_sum s JOIN {name}_norm n USING (word) GROUP BY 1)"""
VOCAB = SQL_UNIT_MEAN.format(name="vocab", key="'concept ' || lpad((label * 5 + vec_id % 5)::VARCHAR, 2, '0')")


# ------------------------------------------------------------------------------------------ text
def scripts(spark, d) -> DataFrame:
    """One script per conversation turn."""
    return table(spark, d, "conversations").select(packed("conv_id", "turn").alias("script_id"), "text")


SCRIPTS = f"scripts AS (SELECT conv_id * {STRIDE} + turn AS script_id, text FROM conversations)"
# sentence split without look-behind: mark the breaks first
SENTENCES = SCRIPTS + r""",
sent AS (SELECT script_id, p - 1 AS p, s FROM (
   SELECT script_id, unnest(l) AS s, unnest(range(1, len(l) + 1)) AS p FROM (
     SELECT script_id, list_filter([trim(x, E' \t\r\n\f\x0B') FOR x IN regexp_split_to_array(
        regexp_replace(text, '([.!?।])\s+', E'\\1\n', 'g'), '\n+')], lambda x: x <> '') AS l FROM scripts)))"""
WORDS_IN = r"len(list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> ''))"
BEATS = SENTENCES + f""",
sent_g AS (SELECT *, {WORDS_IN.format('s')} / 2.5::DOUBLE AS dur, 0 AS z FROM sent),
sent_n AS (SELECT *, sum(CASE WHEN dur >= 2.0 OR p = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY script_id ORDER BY p) - 1 AS i FROM sent_g),
beats AS (SELECT script_id, i::BIGINT AS i, script_id * {STRIDE} + i::BIGINT AS beat_id, string_agg(s, ' ' ORDER BY p) AS text,
                 round_even(greatest(sum(dur), 2.0), 2) AS dur FROM sent_n GROUP BY script_id, i)"""


def beats(spark, d) -> DataFrame:
    from ..operators.windows import split_beats
    b = split_beats(scripts(spark, d))
    return b.select(packed("script_id", "i").alias("beat_id"), "script_id", "i", "text", "dur")


def beat_keys(beats: DataFrame, n: int) -> DataFrame:
    """The embedding that stands for each beat: its id is (beat hash) % count."""
    return beats.select("beat_id", "script_id", "i", F.pmod(F.col("script_id") * 7 + F.col("i") * 13, F.lit(n)).alias("vec_id"))


def beat_vectors(spark, d) -> DataFrame:
    """A vector per beat: the embedding whose id is (beat hash) % count, standing in for a text encoder."""
    e = table(spark, d, "embeddings").select("vec_id", vector.as_double(F.col("embedding")).alias("qe"))
    return beat_keys(beats(spark, d), e.count()).join(e, "vec_id").select("beat_id", "qe", F.col("vec_id").alias("skip_id"))


BEAT_VECTORS = """
beat_vectors AS (SELECT b.beat_id, e.embedding::DOUBLE[] AS qe, e.vec_id AS skip_id FROM beats b JOIN embeddings e
                 ON e.vec_id = (b.script_id * 7 + b.i * 13) % (SELECT count(*) FROM embeddings))"""


def segments(spark, d) -> DataFrame:
    """Transcript: a segment per sentence, 0.4 s a word, a pause of 0.1 to 0.9 s after each."""
    # a turn is one row, so start times are running sums inside its sentence array; whole tenths keep times exact
    def step(acc, x):
        at = F.when(F.size(acc) == 0, F.lit(0)).otherwise(F.element_at(acc, -1)["next"])
        k = F.size(acc)
        n = text.word_count(x)
        return F.concat(acc, F.array(F.struct(at.alias("at"), (at + n * 4 + (k % 5) * 2 + 1).alias("next"), n.alias("n"), x.alias("text"))))

    acc = F.aggregate(text.sentences(F.col("text")), F.array().cast("array<struct<at:int,next:int,n:int,text:string>>"), step)
    s = scripts(spark, d).select(F.col("script_id").alias("video_id"), F.posexplode(acc).alias("seg_id", "x"))
    return s.select("video_id", F.col("seg_id").cast("long").alias("seg_id"), (F.col("x.at") / 10.0).alias("start"),
                    ((F.col("x.at") + F.col("x.n") * 4) / 10.0).alias("end"), F.col("x.text").alias("text"), F.col("x.n").alias("n"))


SEGMENTS = SENTENCES + f""",
seg0 AS (SELECT script_id AS video_id, p::BIGINT AS seg_id, s AS text, {WORDS_IN.format('s')} AS n, (p % 5) * 2 + 1 AS g0 FROM sent),
seg1 AS (SELECT *, sum(n) OVER w AS w, sum(g0) OVER w AS g FROM seg0 WINDOW w AS (PARTITION BY video_id ORDER BY seg_id)),
segments AS (SELECT video_id, seg_id, ((w - n) * 4 + g - g0)::DOUBLE / 10.0 AS start,
                    ((w - n) * 4 + g - g0 + n * 4)::DOUBLE / 10.0 AS "end", text, n FROM seg1)"""


def words(spark, d) -> DataFrame:
    s = segments(spark, d)
    w = s.select("video_id", "seg_id", "start", F.posexplode(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("k", "w"))
    t = F.round(F.col("start") * 10) + F.col("k") * 4
    return w.select("video_id", "seg_id", "k", "w", (t / 10.0).alias("s"), ((t + 4) / 10.0).alias("e"))


WORDS_CTE = r"""
words AS (SELECT video_id, seg_id, k, w, (round(start * 10) + k * 4) / 10.0::DOUBLE AS s, (round(start * 10) + k * 4 + 4) / 10.0::DOUBLE AS e FROM (
  SELECT video_id, seg_id, start, unnest(l) AS w, unnest(range(len(l))) AS k FROM (
    SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS l FROM segments)))"""


def durations(spark, d) -> DataFrame:
    return segments(spark, d).groupBy("video_id").agg(((F.max(F.round(F.col("end") * 10)) + 7) / 10.0).alias("duration"))


DURATIONS = """durations AS (SELECT video_id, (max(round("end" * 10)) + 7) / 10.0::DOUBLE AS duration FROM segments GROUP BY 1)"""


def line_scores(spark, d, strongest: bool = False) -> DataFrame:
    """Scored lines: one per segment, or the strongest one of every video; scores from a deterministic function of video and segment."""
    s = segments(spark, d)
    h = F.pmod(F.col("video_id") * 31 + F.col("seg_id") * 17, F.lit(101))
    if strongest:
        s = s.groupBy("video_id").agg(F.max_by(F.struct(*[c for c in s.columns if c != "video_id"]), F.struct(h, -F.col("seg_id"))).alias("s")).select("video_id", "s.*")
    g = F.pmod(F.col("video_id") * 7 + F.col("seg_id") * 29, F.lit(97))
    return s.select("video_id", F.col("seg_id").alias("id"), "start", "end", "text", (h / 100.0).alias("importance"), (g / 96.0).alias("visual"),
                    pick(["key point", "hook", "data", "cta", "story"], F.col("seg_id") + F.col("video_id")).alias("role"),
                    F.when(h % 11 == 0, "").otherwise(text.keywords(F.col("text"), 3)).alias("query"),
                    F.array(text.keywords(F.col("text"), 2)).alias("alt_queries"),
                    F.get(F.filter(F.split("text", r"\s+"), lambda x: x != ""), F.lit(0)).alias("anchor"), F.lit("").alias("reason"))


# ------------------------------------------------------------------------------------------ places
def gazetteer(spark, d) -> DataFrame:
    """Nations inside regions; aliases are the spelled-out name and, for the corpus, one frequent token per nation."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    lat, lon = (F.col("n_nationkey") % 5) * 20.0 - 40.0, (F.col("n_nationkey") % 7) * 40.0 - 120.0
    a = n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_name").alias("name"), F.lit("city").alias("kind"), F.col("r_name").alias("parent"), lat.alias("lat"), lon.alias("lon"),
        F.array(F.lower(F.replace("n_name", F.lit("_"), F.lit(" "))), pick(TOKENS, F.col("n_nationkey"))).alias("aliases"))
    b = r.select(F.col("r_name").alias("name"), F.lit("country").alias("kind"), F.lit(None).cast("string").alias("parent"),
                 F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.array(F.lower("r_name")).alias("aliases"))
    return a.unionByName(b)


TOKENS = ["thatin", "ononst", "inoran", "whthe", "erand", "keiter", "einheit", "quevi", "mentan", "eaueux", "reré", "ungsch", "berver", "tionre",
          "leion", "enchge", "stber", "ouand", "hethe", "esing", "ndere", "thion", "sheat", "orwas", "edble"]
GAZ = f"""
gaz AS (SELECT n_name AS name, 'city' AS kind, r_name AS parent, (n_nationkey % 5) * 20.0::DOUBLE - 40.0 AS lat, (n_nationkey % 7) * 40.0::DOUBLE - 120.0 AS lon,
          [lower(replace(n_name, '_', ' ')), {sql_pick(TOKENS, 'n_nationkey')}] AS aliases
        FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT r_name, 'country', NULL, NULL, NULL, [lower(r_name)] FROM region)"""


def with_sql(*ctes, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(c.strip() for c in ctes) + "\n"
