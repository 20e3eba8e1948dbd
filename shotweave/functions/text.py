"""Text expressions: tokens, keywords, sentence splitting, slugs, captions."""
from pyspark.sql import Column, functions as F

from . import fixed
from .arrays import first_by, let


def words_literal(words) -> Column:
    return F.lit(list(words))


def stem(w: Column) -> Column:
    """Drop one of -ing, -ed, -es, -s when at least three letters stay (the longest ending that fits)."""
    return F.regexp_replace(w, "^(.{3,}?)(?:ing|ed|es|s)$", "$1")


def tokens(c: Column) -> Column:
    """Content stems, order kept, duplicates removed."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z]{3,})"), F.lit(1))
    return F.array_distinct(F.transform(F.array_except(words, words_literal(fixed.STOP_WORDS)), stem))


def overlap_share(wanted: Column, have: Column) -> Column:
    """Share of the wanted tokens that occur in `have`; 0 when nothing is wanted."""
    n = F.size(wanted)
    return F.when(n > 0, F.size(F.array_intersect(wanted, have)) / n).otherwise(F.lit(0.0))


def domain_score(query_tokens: Column, domain_tokens: Column, have: Column) -> Column:
    return overlap_share(query_tokens, have) + F.lit(0.3) * overlap_share(domain_tokens, have)


def keywords(c: Column, n: int = 4) -> Column:
    """The n most telling words of a text, in their original order, joined by blanks."""
    raw = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("([A-Za-z][A-Za-z']*)"), F.lit(1))
    stop, tech = words_literal(fixed.STOP_WORDS), words_literal(fixed.TECH_SHORT)
    # one hashed pass drops exact repeats and plainly spelled stop words; only odd spellings are looked up one by one
    raw = F.array_except(raw, words_literal(w for s in fixed.STOP_WORDS for w in {s, s.upper(), s.capitalize()}))
    bare = lambda w: F.regexp_replace(F.regexp_replace(F.lower(w), "'+$", ""), "'(s|t|re|ve|ll|d|m)$", "")
    plain = lambda w: ~F.contains(w, F.lit("'")) & ((w == F.lower(w)) | (w == F.upper(w)) | (w == F.initcap(w)))
    named = F.transform(raw, lambda w: F.struct(F.when(F.contains(w, F.lit("'")), bare(w)).otherwise(F.lower(w)).alias("t"), w.alias("w")))
    acronym = lambda w: F.length(w).between(2, 5) & (w == F.upper(w))
    usable = F.filter(named, lambda x: ((F.length(x["t"]) >= 4) | acronym(x["w"]) | ((x["t"] != "") & F.array_contains(tech, x["t"])))
                      & F.when(plain(x["w"]), F.lit(True)).otherwise(~F.array_contains(stop, x["t"]) & (x["t"] != "")))
    usable = F.transform(usable, lambda x: F.struct(x["t"].alias("t"), (acronym(x["w"]) | ((F.length(x["t"]) <= 4) & F.array_contains(tech, x["t"]))).alias("short")))
    # one entry per word: the first usable spelling decides its score
    firsts = first_by(usable, lambda x: x["t"])
    scored = F.transform(firsts, lambda x, i: F.struct(
        (-(F.length(x["t"]) + F.when(x["short"], 4).otherwise(0))).alias("s"), i.alias("i"), x["t"].alias("t")))
    best = F.slice(F.array_sort(scored), 1, n)
    return F.array_join(F.transform(F.array_sort(F.transform(best, lambda x: F.struct(x["i"], x["t"]))),
                                    lambda x: x["t"]), " ")


def clean_query(c: Column) -> Column:
    """Remove words stock sites misread unless nothing would be left; at most 80 characters."""
    words = F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")
    kept = F.filter(words, lambda w: ~F.array_contains(words_literal(fixed.BANNED_QUERY_WORDS),
                                                       F.regexp_replace(F.lower(w), "^[,.]+|[,.]+$", "")))
    return F.substring(F.array_join(F.when(F.size(kept) > 0, kept).otherwise(words), " "), 1, 80)


def sentences(c: Column) -> Column:
    parts = F.split(F.coalesce(c, F.lit("")), r"(?<=[.!?।])\s+|\n+")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != ""))


def speech_seconds(c: Column, wpm: float = 150) -> Column:
    return word_count(c) / F.lit(max(float(wpm), 60.0) / 60.0)


def two_lines(c: Column, width: int = fixed.CAPTION_WIDTH) -> Column:
    """Break a caption into two lines so that the longer one is as short as possible."""
    def broken(words):
        n = F.size(words)
        part = lambda a, k: F.array_join(F.slice(words, a, F.greatest(k, F.lit(0))), " ")
        cuts = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.struct(
            F.greatest(F.length(part(F.lit(1), k)), F.length(part(k + 1, n - k))).alias("longest"), k.alias("k")))
        return F.when(n < 2, c).otherwise(let(F.array_min(cuts)["k"], lambda k: F.concat(part(F.lit(1), k), F.lit("\n"), part(k + 1, n - k))))

    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    return F.when(F.length(c) <= width, c).otherwise(let(words, broken))


def visual_score(c: Column) -> Column:
    """Share of long words minus 0.6 x share of direct address."""
    low = F.lower(c)
    direct = F.size(F.regexp_extract_all(low, F.lit(rf"(?U)\b({fixed.DIRECT_ADDRESS})\b"), F.lit(1)))
    long_words = F.size(F.filter(F.regexp_extract_all(low, F.lit("([a-zऀ-ॿ]+)"), F.lit(1)),
                                 lambda w: F.length(w) >= 6))
    n = F.greatest(word_count(low), F.lit(1))
    return long_words / n - F.lit(0.6) * direct / n


def squeeze(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def normal_word(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w']", "")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def redact(c: Column) -> Column:
    return F.regexp_replace(c, r"key=[^&\s]+", "key=<redacted>")


def path_from_url(c: Column) -> Column:
    plain = F.regexp_replace(F.url_decode(F.regexp_replace(F.coalesce(c, F.lit("")), r"\+", "%2B")),
                             "^file://(localhost)?/?", "")
    return F.when(plain.rlike("^[A-Za-z]:"), F.replace(plain, F.lit("/"), F.lit("\\"))) \
        .otherwise(F.concat(F.lit("/"), F.regexp_replace(plain, "^/+", "")))


def basename(c: Column) -> Column:
    return F.regexp_extract(F.replace(c, F.lit("\\"), F.lit("/")), "([^/]*)$", 1)


def distinct_list(c: Column) -> Column:
    """Aggregate: sorted distinct list of the non-null values."""
    return F.array_sort(F.collect_set(c))
