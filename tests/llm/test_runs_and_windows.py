"""Resampling, periodic runs and repeated windows against brute force; hashes on texts of regular structure."""
import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shotweave.llm import near_dedup, packing, queries, repeats, resample, runs, suffix_dedup, token_counts
from shotweave.llm.frames import tokenizer_path
from shotweave.llm.periodic import Catchers
from shotweave.llm.words import Words, equal_spans, kinds, span_hash

from .test_operators import STORY, docs, none, rows  # noqa: F401

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def stretches(s):
    """All runs (start, length, period), from the definition."""
    out = []
    for q in range(1, len(s) // 4 + 1):
        i = 0
        while i + q < len(s):
            a = i
            while i + q < len(s) and s[i] == s[i + q]:
                i += 1
            part = s[a:i + q]
            if i > a and len(part) >= max(6, 4 * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                out.append((a, len(part), q))
            i += i == a
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), max_size=9), st.integers(1, 9)), max_size=5), st.integers(1, 40))
def test_catchers_find_every_run(parts, chunk):
    s = [x for part, times in parts for x in part * times]
    c = Catchers()
    for i in range(0, len(s), chunk):
        c.append(np.array(s[i:i + chunk]))
    assert [(a, e - a, q) for a, e, q in c.finish().tolist()] == stretches(s)


def test_catchers_on_long_sequences():
    r = np.random.default_rng(0)
    for s, want in ((np.zeros(50_000, int), [(0, 50_000, 1)]), (np.resize(r.integers(0, 9999, 9_001), 50_000), [(0, 50_000, 9_001)]), (r.integers(0, 9999, 50_000), [])):
        c = Catchers()
        c.append(s[:777])
        c.append(s[777:])
        assert [(a, e - a, q) for a, e, q in c.finish().tolist()] == want
        assert sum(len(x) for _, x in c.levels) < 8 * len(s)      # what is kept grows with the text, not with text times levels


def planted(i, w):
    h = zlib.crc32(str(i).encode())
    if i is None or h % 10 or not w:
        return w
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]


def test_runs_of_texts(spark, docs):  # noqa: F811
    more = spark.createDataFrame([(k, " ".join(f"w{x}" for x in range(k % 60))) for k in range(100, 220)], "doc_id long, text string")
    texts = [*rows(), *map(tuple, more.collect())]
    both = docs.select("doc_id", "text", "n", "sha").unionByName(more, allowMissingColumns=True)
    want = Counter()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for i, t in texts:
        w = planted(i, (t or "").encode().split())
        found = stretches(w) if len(w) < 1000 else [(0, 9000, 1)]
        gone = {k for a, n, q in found for k in range(a + q, a + n)}
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        want[(i, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{a},{n},{q}\n" for a, n, q in found)), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())] += 1
    got = runs.digest(runs.detect(runs.planted(both)))
    assert Counter(map(tuple, got.collect())) == want and sum(v for k, v in want.items() if k[1]) > 5
    kept = {r.doc_id: r for r in runs.detect(docs).collect()}
    assert kept[10].collapsed == "a b" and [tuple(x) for x in kept[10].runs] == [(0, 144, 2)] and kept[13].collapsed == "word" and kept[4].collapsed == ""
    assert runs.detect(none(docs)).count() == 0


def test_rabin_karp_arithmetic():
    r = np.random.default_rng(1)
    a, b = (r.integers(0, (1 << 61) - 1, 500).astype(np.uint64) for _ in range(2))
    assert repeats._reduced(repeats.times(a, b)).tolist() == [x * y % ((1 << 61) - 1) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    for length in (1, 2, 3, 20, 31):
        base = int(repeats.BASES[0])
        want = [sum(x * pow(base, length - 1 - k, (1 << 61) - 1) for k, x in enumerate(a[i:i + length].tolist())) % ((1 << 61) - 1) for i in range(500 - length + 1)]
        assert repeats.rolled(a, length, repeats.BASES[0]).tolist() == want
    assert len(repeats.rolled(a[:5], 6, repeats.BASES[0])) == 0


def test_repeated_windows(spark, docs):  # noqa: F811
    r = np.random.default_rng(6)
    passage = " ".join(f"p{k}" for k in range(55))
    texts = [(k, f"{' '.join(f'x{y}' for y in r.integers(0, 10**9, 30))} {passage} {' '.join(f'y{y}' for y in r.integers(0, 10**9, int(r.integers(0, 40))))}") for k in range(200, 260)]
    texts += [(300, f"{passage} {passage} tail"), (301, passage.replace("p20", "q")), (302, " ".join(f"p{k}" for k in range(5, 25))), (303, " ".join(f"p{k}" for k in range(5, 24)))]
    both = docs.select("doc_id", "text", "n", "sha").unionByName(spark.createDataFrame(texts, "doc_id long, text string").repartition(4), allowMissingColumns=True)
    texts += rows()
    order = lambda i: math.inf if i is None else i
    first = {}
    for i, t in texts:
        w = (t or "").encode().split()
        for k in range(len(w) - 19):
            key = tuple(w[k:k + 20])
            first[key] = min(first.get(key, (math.inf, math.inf)), (order(i), k))
    want = Counter()
    for i, t in texts:
        w = (t or "").encode().split()
        gone = {x for k in range(len(w) - 19) if first[tuple(w[k:k + 20])] < (order(i), k) for x in range(k, k + 20)}
        spans = sum(k in gone and k - 1 not in gone for k in range(len(w)))
        want[i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest(), spans] += 1
    found = repeats.repeated_windows(both)
    assert Counter(map(tuple, repeats.digest(found).collect())) == want
    held = {r.doc_id: r for r in found.where("doc_id >= 200").collect()}
    assert held[200].spans == [] and [tuple(s) for s in held[201].spans] == [(30, 85)] and [tuple(s) for s in held[300].spans] == [(0, 110)] and held[302].kept == "" and held[303].spans == []
    assert repeats.repeated_windows(none(docs)).count() == 0


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling(spark, docs, longest):  # noqa: F811
    r = np.random.default_rng(7)
    texts = [*rows(), *((k, " ".join(r.choice(STORY.split() + ["Ünï", "x" * 40, "it's", "a-b"], int(r.integers(0, 60))))) for k in range(300, 700)), (350, STORY), (350, STORY)]
    both = spark.createDataFrame([(i, t, 1.0, 2) for i, t in texts], "doc_id long, text string, weight double, rank int").repartition(7)
    target = spark.createDataFrame([(STORY,), (None,), ("grey geese watch the old fox " * 5,)], "text string")
    split = lambda t: "".join(c if c.isdigit() and c < "\x7f" or "a" <= c <= "z" or c >= "\x80" else " " for c in (t or "").translate(LOWER)).split(" ")

    def buckets(t):
        w = [x for x in split(t) if x]
        return [zlib.crc32(" ".join(w[i:i + n]).encode()) % 500 for n in range(1, longest + 1) for i in range(len(w) - n + 1)], len(w)
    s, t_ = Counter(b for _, t in texts for b in buckets(t)[0]), Counter(b for (t,) in target.collect() for b in buckets(t)[0])
    big, small = sum(s.values()), sum(t_.values())
    gain = {b: math.floor(1000 * math.log((t_[b] + 1) * (big + 500) / ((s[b] + 1) * (small + 500)))) for b in range(500)}
    every = []
    for i, t in texts:
        b, n = buckets(t)
        weight = sum(gain[x] for x in b) // len(b) if b else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        every.append((i, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + .5) / 2**32))), n))
    may = sorted((e for e in every if e[4] >= 20), key=lambda e: (-e[3], math.inf if e[0] is None else e[0]))
    drawn = may[:10 * len(may) // 100]
    want = Counter((*e[:4], k + 1) for k, e in enumerate(drawn))
    got = Counter(map(tuple, resample.resample(both, target, longest=longest, buckets=500).collect()))
    assert Counter({k: v for k, v in got.items() if k[4] is not None}) == want and len(drawn) > 15
    assert Counter(k[:4] for k, v in got.items() for _ in range(v)) == Counter(e[:4] for e in every)
    assert resample.resample(none(docs), target).count() == 0 and resample.resample(docs, target.limit(0)).where("rank is not null").count() == 1


def test_cutoffs_of_tied_and_uneven_partitions(spark):
    r = np.random.default_rng(8)
    a = np.concatenate((np.zeros(3000, int), r.integers(-5, 5, 500), np.arange(300)))
    every = sorted((int(x), int(y), k) for k, (x, y) in enumerate(zip(a, r.integers(0, 4, len(a)), strict=True)))
    keys = spark.createDataFrame(every, "a long, b long, c long").repartitionByRange(9, "c").sortWithinPartitions("a", "b", "c").cache()
    for rank in (0, 1, 2, 1900, len(every) - 1, len(every), len(every) + 1):
        assert resample.cutoff(keys, rank) == (every[rank - 1] if 0 < rank <= len(every) else None)


def letters(n, a, b):
    """The first n letters of the Thue-Morse sequence over a and b."""
    return "".join(b if bin(k).count("1") % 2 else a for k in range(n))


def test_regular_texts_are_told_apart(spark):
    """Words in Thue-Morse order and their complements, which sums modulo powers of two cannot tell apart."""
    from tokenizers import Tokenizer
    one, two = letters(1024, "a", "b"), letters(1024, "b", "a")
    texts = [(1, one), (2, two), (3, one + " " + two), (4, letters(4096, "x", "y")), (5, letters(4096, "y", "x"))]
    frame = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    path = tokenizer_path("word_bpe_49k.json")
    tool = Tokenizer.from_file(path)
    ids = {i: tool.encode(t, add_special_tokens=False).ids for i, t in texts}
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(frame, path).collect()} == {i: len(x) for i, x in ids.items()}
    for p in packing.pack(frame, path).collect():
        assert p.ids_crc32 == zlib.crc32(np.array([*ids[p.doc_id], 2], "<u4")[p.start:p.start + p.length].tobytes())
    assert all(r.kept for r in near_dedup.near_duplicates(frame, 4).collect())
    got = {r.doc_id: r.n_removed for r in suffix_dedup.removed_passages(frame).collect()}
    seen, want = {}, {}
    for i, t in texts:
        cover = {x for k in range(len(t) - 49) if seen.setdefault(t[k:k + 50], i) < i for x in range(k, k + 50)}
        want[i] = len(cover)
    assert got == want


def test_spans_with_equal_hashes_stay_apart():
    raw = np.frombuffer(b"one two one three two " + b"z" * 3000 + b" " + b"z" * 3000, np.uint8)
    w = Words(pa.array([raw.tobytes().decode()]))
    codes, first = kinds(w.raw, w.start, w.end, np.zeros(len(w), np.uint64))       # every hash the same
    names = [w.raw[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)]
    assert [names[first[c]] for c in codes] == names and len(first) == 4
    assert equal_spans(raw, np.array([0, 0]), raw, np.array([8, 4]), np.array([3, 3])).tolist() == [True, False]
    assert len(set(span_hash(raw, np.arange(len(raw)), np.arange(len(raw)) + 1).tolist())) == len(set(raw.tolist()))


def test_memory_keeps_colliding_pieces_apart():
    from shotweave.llm.tokens import Memory
    m = Memory()
    raw = np.frombuffer(b"aabbccdd", np.uint8)
    start, end, zero = np.array([0, 2, 4, 6]), np.array([2, 4, 6, 8]), np.zeros(4, np.uint64)
    for pick in ([1], [0, 1], [2, 1, 0], [3, 0, 1, 2]):
        at = m.places(zero[pick], raw, start[pick], end[pick], lambda new, pick=pick: [[pick[k]] * (pick[k] + 1) for k in new])
        ids, length = m.gather(at)
        assert ids.tolist() == [x for k in pick for x in [k] * (k + 1)] and length.tolist() == [k + 1 for k in pick]


def test_new_queries_are_registered():
    assert {"op11_target_resampling", "op12_periodic_runs", "op13_repeated_windows"} <= set(queries.QUERIES)


def test_windows_ask_in_few_bits():
    """A suspect's hash is as wide as telling suspects needs: 700,000 windows of a block in at most 24 bits each (48-bit hashes: 30)."""
    from shotweave.llm import exchange
    rng = np.random.default_rng(0)
    values = np.unique(rng.integers(0, 1 << 61, 700_000) >> (61 - repeats.BITS))
    rows = exchange.requests(values, np.zeros(len(values), bool), 0, 32, repeats.BITS)
    assert 8 * sum(len(r["blob"]) + len(r["twice"]) for r in rows) < 24 * len(values)
