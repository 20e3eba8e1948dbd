"""Places that texts name, found by joining pieces of text with an alias table of any size.

Every alias is known by its first bytes (up to eight, as one number). A task slides over its texts, keeps the places whose bytes may be such a
beginning, according to a bitmap of fixed size, and sends each with as many bytes as the longest alias has; the join with the alias table and a comparison
of all bytes decide. No alias table is collected, and texts themselves are not shuffled.
"""
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

HEAD = 8                                        # bytes of an alias that make its key
BITS = 1 << 25                                  # 4 MB whatever the alias table: a fuller bitmap lets more pass, the join decides
SLICE_BYTES = 1 << 20
WORD, ANYWHERE, SQUEEZED = 0, 1, 2              # between word bounds; anywhere (Devanagari); in the text without blanks and signs
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(97, 123)]] = True
PLACE = "struct<name:string,alias:string,kind:string,anc:array<string>>"


def alias_table(named: DataFrame) -> DataFrame:
    """One row per way an alias can occur, from named(name, kind, anc, aliases): kind of search, key, bytes to compare, order of preference, place.

    Longer aliases come first, Devanagari ones last. Aliases of five letters or more also match when blanks are missing. Aliases in other letters without ASCII ones
    match between word bounds only; empty aliases never.
    """
    a = named.select("name", "kind", "anc", F.posexplode("aliases").alias("at", "alias")).where("alias <> ''")
    a = a.withColumns({"alias": F.lower("alias"), "deva": F.col("alias").rlike("[\\u0900-\\u097F]")})
    a = a.withColumn("rank", F.struct("deva", (-F.length("alias")).alias("shortness"), "name", "at"))
    sq = F.regexp_replace("alias", "[^a-z0-9]", "")
    forms = F.array(F.struct(F.when(F.col("deva"), ANYWHERE).otherwise(WORD).alias("search"), F.col("alias").alias("form")),
                    F.struct(F.lit(SQUEEZED).alias("search"), F.when(~F.col("deva") & (F.length("alias") >= 5) & (sq != ""), sq).alias("form")))
    rows = a.select("rank", "alias", "kind", "anc", F.explode(forms).alias("f")).where("f.form is not null")
    rows = rows.select("rank", "alias", "kind", "anc", "f.search", F.col("f.form").cast("binary").alias("form"))
    head = F.least(F.length("form"), F.lit(HEAD))
    key = F.conv(F.rpad(F.hex(F.substring("form", 1, HEAD)), 2 * HEAD, "0"), 16, -10).cast("long")
    return rows.withColumns({"head": head, "key": key})


def _numbers(keys, head, search):
    """Places of (key, head, search) in the bitmap."""
    x = keys ^ np.uint64(head * 0x9E3779B97F4A7C15 + search * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(BITS)).astype(np.int64)


def _bitmap(aliases: DataFrame):
    """(packed bits of all keys, [(search, head)], bytes of the longest alias); at most BITS / 32768 rows of 4 KB and 24 pairs reach the driver."""
    def number(batches):
        for b in batches:
            out = np.zeros(len(b), np.int64)
            for (head, search), rows in b.groupby(["head", "search"]).indices.items():
                out[rows] = _numbers(b["key"].to_numpy()[rows].view(np.uint64), int(head), int(search))
            yield pd.DataFrame({"at": out + 1})

    keys = aliases.select("key", "head", "search").distinct()
    parts = keys.mapInPandas(number, "at long").groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    bits = np.zeros(BITS // 8, np.uint8)
    for k, part in parts:
        bits[(k - 1) * 4096:k * 4096] = np.frombuffer(part, np.uint8)
    heads, longest = aliases.agg(F.collect_set(F.struct("search", "head")), F.max(F.length("form"))).first()
    return bits, sorted((r[0], r[1]) for r in heads), longest or 0


def _found(raw, bounds, bits, heads, longest):
    """(text, place in code points, search, head, key, bytes from there on) of what may be an alias, over texts that follow each other in raw."""
    padded = np.concatenate((raw, np.zeros(HEAD, np.uint8)))
    eights = np.ndarray((len(raw) + 1,), ">u8", padded.data, strides=(1,))
    starts = (raw & 0xC0) != 0x80
    alone = np.ones(len(raw), bool)                              # no letter or digit stands before
    alone[1:] = ~ALNUM[raw[:-1]]
    alone[bounds[:-1][bounds[:-1] < len(raw)]] = True
    chars = np.concatenate(([0], np.cumsum(starts)))
    solid = np.flatnonzero(ALNUM[raw])
    squeezed = raw[solid]
    narrow = np.searchsorted(solid, bounds)
    tight = np.ndarray((len(squeezed) + 1,), ">u8", np.concatenate((squeezed, np.zeros(HEAD, np.uint8))).data, strides=(1,))
    for search, head in heads:
        data, view, edge = (squeezed, tight, narrow) if search == SQUEEZED else (raw, eights, bounds)
        at = np.arange(len(data)) if search == SQUEEZED else np.flatnonzero(alone & starts if search == WORD else starts)
        text = np.searchsorted(edge, at, "right") - 1
        inside = at + head <= edge[text + 1]
        at, text = at[inside], text[inside]
        tail = np.uint64(8 * (HEAD - head))
        key = view[at].astype(np.uint64) >> tail << tail             # zeros behind the head, as in the alias table
        where = _numbers(key, head, search)
        ok = (bits[where >> 3] >> (where & 7).astype(np.uint8) & 1).astype(bool)
        at, text, key = at[ok], text[ok], key[ok]
        stop = np.minimum(at + longest + 1, edge[text + 1])
        place = np.zeros(len(at), np.int64) if search == SQUEEZED else chars[at] - chars[edge[text]]
        blob = data.tobytes()
        yield text, place, search, head, key.view(np.int64), [blob[x:y] for x, y in zip(at.tolist(), stop.tolist())]


def mentions(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(key, places) of texts(key, low), low being lower-cased text: places in order of mention, as an array of (name, alias, kind, anc).

    A place counts at the first occurrence of its longest alias that occurs; one that occurs only with blanks missing comes after all others. Texts that name
    no place give no row. Rows with one key must have one text.
    """
    bits, heads, longest = _bitmap(aliases)
    held = texts.sparkSession.sparkContext.broadcast(bits.tobytes())
    kind = texts.schema["key"].dataType.simpleString()

    def run(batches):
        bitmap = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            low = batch.column("low").fill_null("").cast(pa.large_string())
            off = np.frombuffer(low.buffers()[1], np.int64, len(low) + 1, low.offset * 8)
            i = 0
            while i < len(low):
                j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE_BYTES, "right")) - 1)
                raw = np.frombuffer(low.buffers()[2], np.uint8)[off[i]:off[j]] if off[j] > off[i] else np.zeros(0, np.uint8)
                for text, place, search, head, key, piece in _found(raw, off[i:j + 1] - off[i], bitmap, heads, longest):
                    n = len(text)
                    yield pa.RecordBatch.from_arrays([batch.column("key").slice(i, j - i).take(pa.array(text)), pa.array(place), pa.array(np.full(n, search, np.int32)), pa.array(np.full(n, head, np.int32)),
                                                      pa.array(key), pa.array(piece, pa.binary())], names=["text", "place", "search", "head", "key", "piece"])
                i = j

    seen = texts.select("key", "low").mapInArrow(run, f"text {kind}, place long, search int, head int, key long, piece binary")
    hit = seen.join(aliases, ["search", "head", "key"]).where(F.startswith("piece", "form"))
    behind = F.substring(F.col("piece"), F.length("form") + 1, F.lit(1)).cast("string")
    hit = hit.where((F.col("search") != WORD) | ~F.coalesce(behind.rlike("[a-z0-9]"), F.lit(False)))
    one = hit.groupBy("text", F.col("rank.name").alias("name")).agg(F.min(F.struct("rank", (F.col("search") == SQUEEZED).alias("loose"), "place", "alias", "kind", "anc")).alias("b"))
    order = F.struct(F.col("b.loose").alias("loose"), F.col("b.place").alias("place"), F.col("b.rank").alias("rank"), F.struct("name", "b.alias", "b.kind", "b.anc").alias("p"))
    return one.groupBy("text").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["p"]).alias("places")).withColumnRenamed("text", "key")


def with_places(df: DataFrame, columns: dict[str, Column], aliases: DataFrame) -> DataFrame:
    """df with an array of places per text column: new name -> text. Each different text is searched once; null and empty ones name nothing."""
    low = {name: F.lower(F.coalesce(c, F.lit(""))) for name, c in columns.items()}
    every = None
    for c in low.values():
        some = df.select(c.alias("low"))
        every = some if every is None else every.union(some)
    every = every.where("low <> ''").select(F.md5(F.col("low").cast("binary")).alias("key"), "low").dropDuplicates(["key"])
    found = mentions(every, aliases)
    out = df
    for k, (name, c) in enumerate(low.items()):
        key = f"__key{k}"
        out = out.withColumn(key, F.md5(c.cast("binary"))).join(found.select(F.col("key").alias(key), F.col("places").alias(f"__found{k}")), key, "left")
        out = out.withColumn(name, F.coalesce(f"__found{k}", F.array().cast(f"array<{PLACE}>"))).drop(key, f"__found{k}")
    return out
