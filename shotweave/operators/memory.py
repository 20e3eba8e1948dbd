"""Edit memory: what was chosen for similar lines before."""
import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions import fixed
from . import lessons, similarity, tables
from .ranges import interval_pairs
from ..session import bounded_rows

MAX_NAME = 4096                 # different lengths of names in one import; a path has no more characters
EMPTY = 1 << 20                 # keys that rows without a path or name are dealt to


def resolve_file(placements: DataFrame, files: DataFrame) -> DataFrame:
    """placements(p_id, path, name) -> + file_id: same path (case and slash ignored), else the smallest id whose path ends with name (case ignored).

    A path offers its endings of the lengths that asked names have, each distinct ending keeps its smallest id before the join, and each distinct name asks once; so a
    name that thousands of files or placements share is one row on either side. Rows without one do not meet under the empty key, which most of them would share. Null and empty names and paths resolve to nothing.
    """
    norm = lambda c: F.lower(F.replace(F.col(c), F.lit("/"), F.lit("\\")))
    asked = placements.where("name <> ''").select(F.lower("name").alias("__e")).distinct()
    # lengths of file names; far fewer than names
    lengths = sorted(r[0] for r in bounded_rows(asked.select(F.length("__e")).distinct(), MAX_NAME, "lengths of asked names"))
    f = files.where("path <> ''").select(F.col("id").alias("fid"), F.col("path").alias("fpath"))
    exact = f.groupBy(norm("fpath").alias("__n")).agg(F.min("fid").alias("exact_id"))
    p = F.lower("fpath")
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length(p))
    endings = f.select("fid", F.explode(F.transform(fitting, lambda n: F.substring(p, F.length(p) - n + 1, n))).alias("__e")).groupBy("__e").agg(F.min("fid").alias("name_id"))
    named = asked.join(endings, "__e")
    def look_up(d, key, ask, table, value):
        """Left join on `key`; rows that ask for nothing are dealt evenly, by numbers that no row of the table has."""
        d = d.withColumns({key: ask, "__deal": F.when(F.coalesce(ask, F.lit("")) == "", F.pmod(F.xxhash64("p_id"), F.lit(EMPTY)) + 1).otherwise(0)})
        return d.join(table.select(key, value, F.lit(0).cast("long").alias("__deal")), [key, "__deal"], "left").drop(key, "__deal")
    d = look_up(placements, "__n", norm("path"), exact, "exact_id")
    d = look_up(d, "__e", F.lower("name"), named, "name_id")
    return d.withColumn("file_id", F.coalesce("exact_id", "name_id")).drop("exact_id", "name_id")


def best_overlap_shot(placements: DataFrame, shots: DataFrame, slack: float = 1.0) -> DataFrame:
    """placements(p_id, file_id, src_in, src_out): the shot of the file with the most overlap; gaps below `slack` s still count.

    Shots of one stretch of a file overlap alike and the smallest id wins, so each different stretch meets placements once.
    """
    p = placements.select("p_id", "file_id", "src_in", "src_out", (F.col("src_in") - slack).alias("__lo"), (F.col("src_out") + slack).alias("__hi"))
    s = shots.groupBy("file_id", F.col("t_start").alias("__a"), F.col("t_end").alias("__e")).agg(F.min("shot_id").alias("shot_id"))
    j = interval_pairs(p, s, "file_id", "__lo", "__hi", "__a", "__e", 60.0)
    ov = F.least("__e", "src_out") - F.greatest("__a", "src_in")
    return (j.withColumn("overlap", ov).where(F.col("overlap") > -slack).groupBy("p_id")
            .agg(F.max_by(F.struct("shot_id", "overlap"), F.struct("overlap", -F.col("shot_id"))).alias("r")).select("p_id", "r.*"))


def covering_line(placements: DataFrame, spans: DataFrame) -> DataFrame:
    """placements(p_id, project, rec_in, rec_out), spans(project, i, a, b, text): line under the placement's midpoint.

    Past the last line, the last line counts. Bins are as wide as a line is long on average, so lines are about two rows each, whatever their length.
    """
    mid = placements.select("p_id", "project", ((F.col("rec_in") + F.col("rec_out")) / 2).alias("mid"))
    s = spans.select("project", "a", "b", "i", "text")
    width = max(60.0, spans.agg(F.avg(F.col("b") - F.col("a"))).first()[0] or 0.0)
    inside = interval_pairs(mid, s, "project", "mid", "mid", "a", "b", width).where("mid < b").select("p_id", "i", "text")
    final = spans.groupBy("project").agg(F.max("b").alias("end"), F.max_by(F.struct("i", "text"), "b").alias("f"))
    late = mid.join(final, "project").where("mid >= end").select("p_id", "f.i", "f.text")
    return inside.unionByName(late)


def import_timeline(placements: DataFrame, spans: DataFrame, shots: DataFrame) -> DataFrame:
    """Positive pairs (project, text, shot_id, label 1) from past placements; placements without shot or line give none."""
    hit = best_overlap_shot(placements, shots).select("p_id", "shot_id")
    line = covering_line(placements, spans).select("p_id", "text")
    return (placements.select("p_id", "project").join(hit, "p_id").join(line, "p_id")
            .select("project", "text", "shot_id", F.lit(1).alias("label")).distinct())


def import_report(placements: DataFrame, spans: DataFrame, shots: DataFrame) -> DataFrame:
    """Per project: placements, those that gave a lesson, and those left unmatched for want of a shot or of a line."""
    hit = best_overlap_shot(placements, shots).select("p_id", F.lit(True).alias("has_shot"))
    line = covering_line(placements, spans).select("p_id").distinct().withColumn("has_line", F.lit(True))
    d = placements.select("p_id", "project").join(hit, "p_id", "left").join(line, "p_id", "left")
    shot, told = F.coalesce("has_shot", F.lit(False)), F.coalesce("has_line", F.lit(False))
    return d.groupBy("project").agg(F.count("*").alias("placements"), F.count_if(shot & told).alias("matched"), F.count_if(~(shot & told)).alias("unmatched"),
                                    F.count_if(~shot).alias("no_shot"), F.count_if(~told).alias("no_line"))


def feedback(events: DataFrame, shown: int = 3) -> DataFrame:
    """events(project, text, chosen, rejected array): one positive and the first `shown` rejected as negatives."""
    pos = events.select("project", "text", F.col("chosen").alias("shot_id"), F.lit(1).alias("label"))
    neg = events.select("project", "text", F.explode(F.slice("rejected", 1, shown)).alias("shot_id"), F.lit(0).alias("label"))
    return pos.unionByName(neg).distinct()


def house_style(pairs: DataFrame, shots: DataFrame, min_n: int = fixed.STYLE_MIN_N) -> DataFrame:
    """One row: n, size_mix map, negatives, projects, active."""
    j = pairs.where("label = 1").join(shots.select("shot_id", "size"), "shot_id")
    mix = j.groupBy("size").agg(F.count("*").alias("c"))
    a = mix.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.collect_list(F.struct("size", "c")).alias("m"))
    projects = j.select("project").distinct().agg(F.count("*").alias("projects"))
    b = pairs.agg(F.count_if(F.col("label") == 0).alias("negatives"))
    one = F.lit(1)
    d = a.withColumn("__k", one).join(b.withColumn("__k", one), "__k").join(projects.withColumn("__k", one), "__k").drop("__k")
    sized = F.filter("m", lambda x: x["size"].isNotNull())
    return d.select("n", F.map_from_entries(F.array_sort(F.transform(sized, lambda x: F.struct(
        x["size"], F.bround(x["c"] / F.col("n"), 2).alias("share"))))).alias("size_mix"), "negatives", "projects", (F.col("n") >= min_n).alias("active"))


def style_bonus(cands: DataFrame, style: DataFrame, bonus: float = fixed.STYLE_BONUS) -> DataFrame:
    """cands with style_bonus from the one-row house style."""
    s = style.where("active").select(F.explode("size_mix").alias("size", "share"))
    return cands.join(F.broadcast(s), "size", "left").withColumn("style_bonus", F.coalesce(F.col("share") * bonus, F.lit(0.0))).drop("share")


def memory_boost(lines: DataFrame, past_lines: DataFrame, pairs: DataFrame, cands: DataFrame, shots: DataFrame,
                 min_sim: float = fixed.MEM_MIN_SIM, neighbour: float = fixed.MEM_NEIGHBOUR, held_bytes: int | None = None) -> DataFrame:
    """Bonus and hits per (line_id, shot_id).

    lines(line_id, emb); past_lines(text_id, emb); pairs(text_id, shot_id, label); cands(line_id, shot_id).
    Pairs are merged per (past line, shot, label) first, so repeated lessons cost one row. Where tasks can hold the vectors and lessons (`held_bytes`), they are added up in the task that reads the line;
    else look-alike shots meet through one neighbour table instead of comparing every candidate with every lesson.
    """
    lesson = pairs.groupBy("text_id", "shot_id").agg(
        F.sum(F.when(F.col("label") == 1, 1.0).otherwise(-fixed.NEG_PENALTY / fixed.MEM_BONUS)).alias("sgn"),
        F.count_if(F.col("label") == 1).alias("pos"))
    held = lessons.held_boosts(lines, past_lines, lesson, cands, shots, min_sim, neighbour, held_bytes)
    if held is not None:
        return _bonus(held)
    below = float(np.nextafter(min_sim, -1.0))                 # the threshold itself counts
    sims = similarity.similar_pairs(lines.select(F.col("line_id").alias("id"), "emb"),
                                    past_lines.select(F.col("text_id").alias("id"), "emb"), below, same=False)
    told = (sims.select(F.col("id").alias("line_id"), F.col("other").alias("text_id"), ((F.col("cos") - min_sim) / (1 - min_sim)).alias("w"))
            .join(lesson, "text_id").groupBy("line_id", F.col("shot_id").alias("past_shot"))
            .agg(F.sum(F.col("sgn") * F.col("w")).alias("v"), F.sum("pos").alias("pos")))
    vec = shots.select(F.col("shot_id").alias("id"), "emb")
    in_cands = cands.select(F.col("shot_id").alias("id")).distinct().join(vec, "id")
    in_pairs = pairs.select(F.col("shot_id").alias("id")).distinct().join(vec, "id")
    alike = similarity.similar_pairs(in_cands, in_pairs, neighbour).select(F.col("id").alias("shot_id"), F.col("other").alias("past_shot"))
    exact = cands.join(told, [cands.line_id == told.line_id, cands.shot_id == told.past_shot]).select(
        cands.line_id, cands.shot_id, "v", "pos")
    near = cands.join(alike, "shot_id").join(told, ["line_id", "past_shot"]).select(
        "line_id", "shot_id", (F.col("v") * 0.5).alias("v"), F.lit(0).cast("long").alias("pos"))
    return _bonus(exact.unionByName(near).groupBy("line_id", "shot_id").agg(F.sum("v").alias("v"), F.sum("pos").alias("hits")))


def _bonus(s: DataFrame) -> DataFrame:
    return s.select("line_id", "shot_id", (F.least(F.greatest("v", F.lit(-1.0)), F.lit(1.0)) * fixed.MEM_BONUS).alias("bonus"), "hits")


def append_pairs(target: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs not yet stored."""
    return tables.new_only(new.distinct(), target, ["project", "text", "shot_id", "label"])


def fit_filmable(lines: DataFrame, features: str = "features", label: str = "y", c: float = 2.0):
    """Logistic probe on sentence vectors; c follows the summed-loss convention, Spark averages the loss."""
    from pyspark.ml.classification import LogisticRegression
    n = lines.count()
    return LogisticRegression(featuresCol=features, labelCol=label, regParam=1.0 / (c * n), elasticNetParam=0.0,
                              standardization=False, maxIter=200).fit(lines)


def filmable_probability(model, lines: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    return model.transform(lines).withColumn("visual", F.get(vector_to_array("probability"), F.lit(1))).drop("probability", "rawPrediction")


def probe_cv(lines: DataFrame, folds: int = 5, c: float = 2.0) -> DataFrame:
    """k-fold accuracy of the probe. lines(line_id, features, y); the fold comes from the id."""
    d = lines.withColumn("fold", F.pmod(F.xxhash64("line_id"), F.lit(folds)))
    out = None
    for k in range(folds):
        p = filmable_probability(fit_filmable(d.where(F.col("fold") != k), c=c), d.where(F.col("fold") == k))
        a = p.groupBy("fold").agg(F.count("*").alias("n"), F.count_if((F.col("visual") >= 0.5) == (F.col("y") == 1)).alias("right"))
        out = a if out is None else out.unionByName(a)
    return out.withColumn("accuracy", F.col("right") / F.col("n"))
