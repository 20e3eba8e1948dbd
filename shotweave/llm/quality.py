"""Quality rules with controlled risk: cutoffs that exact binomial bounds on labelled holdouts certify, stratum by stratum. DataFrame functions only."""
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import cut_lineage, id_and_text

GAP, WORD = "[\\x20\\x09-\\x0D]+", "[^\\x20\\x09-\\x0D]"
SHARES = [x / 100 for x in (1, 2, 4, 6, 8, 10, 15, 20, 25, 30, 40, 50, 60, 70, 80, 90)]
#: Signals (the higher, the worse) and the cutoffs tried, fixed before any label is seen.
SIGNALS = {
    "symbol_share": ("n_symbols / word_chars", SHARES),
    "repeat_share": ("n_repeat_words / n_words", SHARES),
    "dup_line_share": ("n_dup_lines / n_lines", SHARES),
    "capital_share": ("n_capitals / word_chars", SHARES),
    "exclaim_share": ("n_exclaims / n_words", SHARES),
    "word_length": ("word_chars / n_words", [6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 14.0, 16.0, 20.0, 25.0, 30.0, 40.0, 60.0, 80.0, 100.0, 200.0]),
}
RISK, DOUBT = 0.02, 0.05                        # at most 2 % of good documents rejected in a stratum, by all signals together, with 95 % confidence over all strata


def measures(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum ('' for null) and counts of each text; null counts as empty. Whole texts, no shuffle, no explode."""
    text = F.coalesce("text", F.lit(""))
    bare = F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))
    step = id_and_text(docs, F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum")).withColumn("text", text)
    step = step.withColumn("bare", bare)
    step = step.withColumn("words", F.when(F.col("bare") == "", F.array().cast("array<string>")).otherwise(F.split("bare", GAP)))
    words = F.col("words")
    step = step.withColumn("hashes", F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>")))
    step = step.withColumn("sorted", F.sort_array("hashes"))
    step = step.withColumn("twice", F.filter("sorted", lambda h, i: F.coalesce(h == F.get(F.col("sorted"), i - 1), F.lit(False))))
    step = step.withColumn("spots", F.when(F.size("twice") > 0, F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    spots = F.col("spots")
    step = step.withColumn("starts", F.array_sort(F.transform(F.filter(spots, lambda x, k: F.coalesce(F.get(spots, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(spots, k + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"])))
    starts = F.col("starts")
    covered = F.aggregate(F.transform(starts, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1), p + 3) - p)), F.lit(0), lambda a, x: a + x)
    step = step.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return step.select("doc_id", "stratum", n(F.size(words)).alias("n_words"), n(F.char_length(F.regexp_replace("bare", GAP, ""))).alias("word_chars"),
                       n(F.regexp_count("bare", F.lit("[#*$%&|<>]"))).alias("n_symbols"), n(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
                       n(covered).alias("n_repeat_words"), n(F.size("lines")).alias("n_lines"), n(F.regexp_count("bare", F.lit("[A-Z]"))).alias("n_capitals"),
                       n(F.regexp_count("bare", F.lit("[!?]"))).alias("n_exclaims"))


def with_signals(rows: DataFrame) -> DataFrame:
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumns({"base_failed": base, **{s: F.expr(f"coalesce(try_divide({how.replace(' / ', ', ')}), 0)") for s, (how, _) in SIGNALS.items()}})


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), term by term in logarithms."""
    step = F.struct((F.lit(0.0) + n * math.log1p(-p)).alias("log"), F.lit(0.0).alias("sum"))
    odds = math.log(p) - math.log1p(-p)
    return F.aggregate(F.sequence(F.lit(0).cast("long"), k), step, lambda a, j: F.struct(
        (a["log"] + odds + F.log(F.greatest(n - j, F.lit(1)) / (j + 1))).alias("log"), (a["sum"] + F.exp(a["log"])).alias("sum")), lambda a: a["sum"])


def cutoffs(rows: DataFrame, labels: DataFrame, risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """stratum and, per signal, the lowest certified cutoff (null: none): one row per stratum with a certified cutoff.

    The holdout of a stratum is its good documents (label quality 1, the highest of repeated labels) that pass the base rules. A cutoff that rejects k of n is certified
    if P(binomial(n, risk / signals) <= k) <= doubt / (signals * strata * cutoffs), the exact one-sided bound with Bonferroni's correction over all that is tried.
    """
    good = labels.groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1")
    held = rows.join(good, "doc_id", "left_semi").where("not base_failed")
    tried = [(s, c) for s, (_, grid) in SIGNALS.items() for c in grid]
    counts = cut_lineage(held.groupBy("stratum").agg(F.count("*").alias("n"), *(F.count_if(F.col(s) > c).alias(f"k{i}") for i, (s, c) in enumerate(tried))))
    p = risk / len(SIGNALS)
    strict = doubt / (len(tried) * max(1, counts.count()))
    each = counts.select("stratum", "n", F.inline(F.array(*(F.struct(F.lit(s).alias("signal"), F.lit(c).alias("cutoff"), F.col(f"k{i}").alias("k")) for i, (s, c) in enumerate(tried)))))
    sure = each.where(F.col("k") <= F.col("n") * p).where(binomial_cdf(F.col("k"), F.col("n"), p) <= strict)
    return sure.groupBy("stratum").agg(*(F.min(F.when(F.col("signal") == s, F.col("cutoff"))).alias(f"{s}_cutoff") for s in SIGNALS))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, then further counts; one row per row of docs.

    Null and empty texts have no words and fail the base rules; ties at a cutoff are kept; a stratum without enough labelled documents has the base rules only;
    null labels say nothing; repeated rows are judged each; an empty table gives no rows.
    """
    rows = with_signals(cut_lineage(measures(docs, stratum)))
    limits = cutoffs(rows, labels, risk, doubt)
    fine = [F.coalesce(F.col(s) <= F.col(f"{s}_cutoff"), F.lit(True)) for s in SIGNALS]
    kept = ~F.col("base_failed")
    for x in fine:
        kept = kept & x
    return rows.join(limits, "stratum", "left").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "n_lines", "n_capitals", "n_exclaims")


def oracle() -> str:
    """DuckDB SQL for judge() over the tables documents and labels."""
    tried = [(s, c) for s, (_, grid) in SIGNALS.items() for c in grid]
    p, signals = RISK / len(SIGNALS), ", ".join(f"coalesce(({how.split(' / ')[0]})::double / nullif({how.split(' / ')[1]}, 0), 0) as {s}" for s, (how, _) in SIGNALS.items())
    grid = ", ".join(f"('{s}', {c!r}::double)" for s, c in tried)
    value = "case t.signal " + " ".join(f"when '{s}' then h.{s}" for s in SIGNALS) + " end"
    fine = " and ".join(f"coalesce(s.{s} <= (select min(c.cutoff) from chosen c where c.stratum = s.stratum and c.signal = '{s}'), true)" for s in SIGNALS)
    return f"""
with d as (select doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as text from documents),
 w as (select doc_id, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words,
       list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines, stratum, text from d),
 starts as (select doc_id, i, words[i] as a, words[i + 1] as b, words[i + 2] as c from w, unnest(range(1, len(words) - 1)) t(i)),
 hit as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, a, b, c) as n from starts) where n > 1),
 rep as (select doc_id, count(distinct i + k) as n from hit, unnest([0, 1, 2]) t(k) group by doc_id),
 m as (select w.doc_id, stratum, len(words)::bigint as n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint as word_chars,
       length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
       coalesce(rep.n, 0)::bigint as n_repeat_words, len(lines)::bigint as n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g'))::bigint as n_capitals,
       length(regexp_replace(text, '[^!?]', '', 'g'))::bigint as n_exclaims from w left join rep using (doc_id)),
 s as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, {signals} from m),
 good as (select doc_id from labels group by doc_id having max(quality) = 1),
 h as (select s.* from s semi join good using (doc_id) where not base_failed),
 counts as (select h.stratum, t.signal, t.cutoff, count(*) as n, count(*) filter ({value} > t.cutoff) as k from h, (values {grid}) t(signal, cutoff) group by all),
 chosen as (select stratum, signal, cutoff from counts where k <= n * {p!r} and
  (select sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p!r}) + (n - j) * ln(1 - {p!r}))) from unnest(range(0, k + 1)) u(j))
   <= {DOUBT!r} / ({len(tried)} * (select count(distinct stratum) from counts)))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {fine} as kept, n_lines, n_capitals, n_exclaims from s"""
