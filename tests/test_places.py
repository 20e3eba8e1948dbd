"""Places in texts against a plain search, with alias tables larger than any a task could be sent."""
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotweave.operators import places


def plain(text, aliases):
    """Names in order of mention, from the definition: aliases of (name, at, alias), longest first, Devanagari last."""
    low = text.lower()
    squeezed = re.sub("[^a-z0-9]", "", low)
    deva = lambda a: bool(re.search("[ऀ-ॿ]", a))
    hits = {}
    for name, at, alias in sorted(aliases, key=lambda r: (deva(r[2]), -len(r[2]), r[0], r[1])):
        m = low.find(alias) if deva(alias) else (lambda x: x.start() if x else -1)(re.search("(?<![a-z0-9])" + re.escape(alias) + "(?![a-z0-9])", low))
        sq = re.sub("[^a-z0-9]", "", alias)
        rank = (deva(alias), -len(alias), name, at)
        if m >= 0:
            hits.setdefault(name, (0, m, rank))
        elif not deva(alias) and len(alias) >= 5 and sq and sq in squeezed:
            hits.setdefault(name, (1, 0, rank))
    return [n for n, _ in sorted(hits.items(), key=lambda x: x[1])]


@pytest.fixture(scope="module")
def corpus():
    r = np.random.default_rng(3)
    parts = ["san", "new", "port", "el", "st.", "d'or", "são", "पोख", "रा", "x", "york", "lake", "7", "über"]
    aliases = [(f"n{k // 2}", k % 2, " ".join(r.choice(parts, int(r.integers(1, 4))))) for k in range(400)]
    texts = ["", "NEWYORK", "new-york, New York; newyorker", "पोखरा lake", "a" * 3000 + " port"] + ["".join(str(r.choice([" ", "", ", ", "\n"])) + str(r.choice([*parts, "PORT", "Lake", "und", "é"])) for _ in range(int(r.integers(1, 60)))) for _ in range(150)]
    return aliases, texts


def table(spark, aliases):
    rows = {}
    for name, at, alias in aliases:
        rows.setdefault(name, []).append(alias)
    return places.alias_table(spark.createDataFrame([(n, "city", [n], a) for n, a in rows.items()], "name string, kind string, anc array<string>, aliases array<string>"))


def test_places_like_a_plain_search(spark, corpus):
    aliases, texts = corpus
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, texts[7]])], "i long, t string").repartition(3)
    got = {r.i: [p.name for p in r.p] for r in places.with_places(df, {"p": F.col("t")}, table(spark, aliases)).collect()}
    assert got == {i: plain(t or "", aliases) for i, t in enumerate([*texts, None, texts[7]])}


def test_a_large_alias_table(spark):
    """Three hundred thousand aliases with one beginning: none is collected, and each text finds its own."""
    named = spark.range(150_000).select(F.format_string("n%06d", "id").alias("name"), F.lit("city").alias("kind"), F.array(F.format_string("n%06d", "id")).alias("anc"),
                                        F.array(F.format_string("port of %06d", "id"), F.format_string("harbour%06dnorth", "id")).alias("aliases"))
    df = spark.createDataFrame([(i, f"from Port of {i * 977:06d} to harbour {i * 31:06d} north, port of 1") for i in range(50)], "i long, t string")
    got = {r.i: [p.name for p in r.p] for r in places.with_places(df, {"p": F.col("t")}, places.alias_table(named)).collect()}
    assert got == {i: [f"n{i * 977:06d}", f"n{i * 31:06d}"][:1 + (i > 0)] for i in range(50)}


def test_small_slices_change_nothing(spark, corpus, monkeypatch):
    aliases, texts = corpus
    monkeypatch.setattr(places, "SLICE_BYTES", 100)
    raw = [t.lower().encode() for t in texts]
    bits, heads, longest = places._bitmap(table(spark, aliases))
    whole = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
    flat = np.frombuffer(b"".join(raw), np.uint8)
    seen = [set() for _ in raw]
    for text, place, search, head, key, piece in places._found(flat, whole, bits, heads, longest):
        for t, p, k, x in zip(text.tolist(), place.tolist(), key.tolist(), piece, strict=True):
            seen[t].add((p, search, head, k, x))
    for t, x in enumerate(raw):
        alone = {(p, s, h, k, y) for text, place, s, h, key, piece in places._found(np.frombuffer(x, np.uint8), np.array([0, len(x)]), bits, heads, longest) for p, k, y in zip(place.tolist(), key.tolist(), piece, strict=True)}
        assert alone == seen[t]
