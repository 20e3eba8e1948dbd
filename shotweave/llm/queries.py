"""The registered queries of this package over the driver tables, and their SQL."""
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, lm, near_dedup, packing, quality, repeats, resample, runs, sentencepieces, sharding, suffix_dedup, token_counts, toxicity
from .frames import tokenizer_path

WORDS = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scores(spark, sf_dir):
    rows = lm.score(table(spark, sf_dir))
    return rows.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op2_quality_rules(spark, sf_dir):
    return quality.judge(table(spark, sf_dir), table(spark, sf_dir, "labels"))


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.dedupe(table(spark, sf_dir))


def op4_suffix_dedup(spark, sf_dir):
    return suffix_dedup.removed_passages(table(spark, sf_dir))


def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir), tokenizer_path(WORDS))


def op7_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir), tokenizer_path(WORDS))


def op8_sentencepiece(spark, sf_dir):
    return sentencepieces.round_trip(table(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op9_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir), size=4)


def op10_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir))


def op11_target_resampling(spark, sf_dir):
    return resample.resample(table(spark, sf_dir), table(spark, sf_dir, "benchmark")).withColumn("doc_id", F.col("doc_id").cast("long"))


def op12_periodic_runs(spark, sf_dir):
    return runs.digest(runs.detect(runs.planted(table(spark, sf_dir))))


def op13_repeated_windows(spark, sf_dir):
    return repeats.digest(repeats.repeated_windows(table(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_lm_scores, op2_quality_rules, op3_exact_dedup, op4_suffix_dedup, op5_toxicity, op6_token_counts, op7_packing, op8_sentencepiece, op9_near_dedup, op10_sharding,
    op11_target_resampling, op12_periodic_runs, op13_repeated_windows)}

#: crc32 of a blob `w` in hexadecimal digits, bit by bit.
CRC_HEX = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(w) // 2 + 1), lambda i: ('0x' || w[2 * i - 1:2 * i])::bigint)), lambda c, b:
  list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, (a & 1) * 3988292384))), 4294967295::bigint)"""

#: crc32 of doc_id as text, bit by bit.
CRC = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda c, b:
  list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, (a & 1) * 3988292384))), 4294967295::bigint)"""

ORACLES: dict[str, str] = {
    "op1_lm_scores": f"""
with d as (select doc_id, crc32_text % 7 = 2 as held_out, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words from (select *, {CRC} as crc32_text from documents)),
 t as (select doc_id, held_out, i, case when i = 1 then '' else words[i - 1] end as u, case when i = len(words) + 1 then '' else words[i] end as w
  from d, unnest(range(1, len(words) + 2)) r(i)),
 c as (select u, w, count(*) as c from t where not held_out group by all), cu as (select u, sum(c) as c, count(*) as kinds from c group by u),
 cw as (select w, sum(c) as c from c group by w), n as (select sum(c) as n, count(*) as v from cw),
 k as (select count(*) filter (c = 1) as a, count(*) filter (c = 2) as b from c), dd as (select case when a > 0 and b > 0 then a::double / (a + 2 * b) else 0.5 end as x from k),
 p as (select t.*, (coalesce(cw.c, 0) + 1)::double / (n + v + 1) as p, coalesce(cw.c, 0) > 0 as known, cu.c as cu, cu.kinds as kinds, c.c as cp, n, x
  from t left join cw on t.w = cw.w left join cu on t.u = cu.u left join c on t.u = c.u and t.w = c.w, n, dd)
select doc_id, held_out, count(*) as n_tokens, count(*) filter (known) as n_known, any_value(n)::bigint as train_tokens, round(sum(log10(p)), 6) as base_score,
 round(sum(log10(case when cu is null then p else greatest(coalesce(cp, 0) - x, 0) / cu + x * kinds / cu * p end)), 6) as score from p group by doc_id, held_out""",
    "op2_quality_rules": quality.oracle(),
    "op3_exact_dedup": """
with m as (select doc_id, length(coalesce(text, '')) as chars, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') as bare from documents),
     g as (select *, first_value(doc_id) over w as keep_id, count(*) over (partition by bare) as group_size, row_number() over w as n
           from m window w as (partition by bare order by chars desc, doc_id))
select doc_id, keep_id, group_size, n = 1 as kept, sha256(bare) as text_sha256 from g""",
    "op11_target_resampling": f"""
with f as (select 0 as kind, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as word from documents
  union all select 1, null, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) from benchmark),
 h as (select word, {CRC_HEX} % 10000 as bucket from (select distinct word, hex(encode(word)) as w from f)),
 c as (select h.bucket, count(*) filter (kind = 0) as s, count(*) filter (kind = 1) as t from f join h using (word) group by h.bucket),
 n as (select sum(s) as ss, sum(t) as tt from c),
 g as (select bucket, floor(1000 * ln((t + 1)::double * (ss + 10000)::double / ((s + 1)::double * (tt + 10000)::double)))::bigint as gain from c, n),
 w as (select doc_id, count(*) as n_features, floor(sum(gain)::double / count(*))::bigint as weight from f join h using (word) join g using (bucket) where kind = 0 group by doc_id),
 x as (select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, ('0x' || sha256('2024:' || doc_id)[1:8])::bigint as h from documents left join w using (doc_id)),
 y as (select doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score from x),
 z as (select *, count(*) filter (n_features >= 20) over () as eligible, row_number() over (order by n_features < 20, score desc, doc_id) as place from y)
select doc_id, n_features, weight, score, case when n_features >= 20 and place <= eligible // 10 then place end as rank from z""",
    "op13_repeated_windows": """
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words from documents),
 v as (select doc_id, i as start, array_to_string(words[i:i + 19], ' ') as run from d, unnest(range(1, len(words) - 18)) r(i)),
 m as (select doc_id, start, row_number() over (partition by run order by doc_id, start) > 1 as late from v),
 x as (select doc_id, i, words[i] as word from d, unnest(range(1, len(words) + 1)) r(i)),
 y as (select x.*, coalesce(max(m.late::int) over (partition by x.doc_id order by i rows between 19 preceding and current row), 0) = 1 as gone from x left join m on x.doc_id = m.doc_id and x.i = m.start),
 z as (select doc_id, count(*) as n_words, count(*) filter (gone) as n_removed, coalesce(string_agg(word, ' ' order by i) filter (not gone), '') as kept from y group by doc_id),
 s as (select doc_id, count(*) as n_spans from (select doc_id, i, gone, lag(gone, 1, false) over (partition by doc_id order by i) as was from y) where gone and not was group by doc_id)
select doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256, coalesce(n_spans, 0) as n_spans
from documents left join z using (doc_id) left join s using (doc_id)""",
}
