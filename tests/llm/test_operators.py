"""Each operator against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""
import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shotweave.llm import exact_dedup, exchange, golomb, lm, near_dedup, packing, quality, sentencepieces, sharding, suffix_dedup, token_counts, toxicity
from shotweave.llm.components import components
from shotweave.llm.frames import tokenizer_path
from shotweave.llm.shingles import shingle_sets
from shotweave.llm.suffixes import least_equal
from shotweave.llm.words import Words, slices

GAPS = b" \t\n\v\f\r"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
STORY = "The quick brown fox jumps over the lazy dog near the old river bank while seven grey geese watch from far away"


def rows():
    near = STORY.replace("old", "new")
    return [(1, STORY), (2, STORY), (2, STORY), (3, " The quick  brown" + STORY[15:]), (4, None), (5, ""), (6, " \t\n"), (None, STORY), (None, "nobody's text"), (7, near + " " + STORY),
            (8, "x" * 5000), (9, "é" * 70 + " Ω!! <|endoftext|> don't"), (10, "a b a b a b a b\na b a b a b a b\n" * 9), (11, "one two three"), (12, "one TWO three"), (13, "word " * 9000),
            (14, STORY + " and then the story goes on for a while"), (15, STORY + " and then the story goes on for a whale")]


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns carry names the operators use themselves."""
    schema = "doc_id long, text string, n long, sha string, score double, lang string, chars long, size long"
    return spark.createDataFrame([(i, t, 1, "s", 0.5, None, 3, 4) for i, t in rows()], schema).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, None, None), (None, 1, 1), (7, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")


def none(docs):
    return docs.where("doc_id = -1")


def words(text):
    return (text or "").encode().translate(LOWER).split()


def test_golomb_and_exchange():
    r = np.random.default_rng(5)
    for n, top in ((0, 9), (1, 9), (9, 9), (500, 1 << 47)):
        values = np.unique(r.integers(0, top, n))
        assert (golomb.decode(len(values), *golomb.encode(values)) == values).all()
    sent = exchange.requests(np.array([1, 5, 250]), np.array([True, False, True]), 3, 4, 8)
    assert [(s["owner"], s["n"]) for s in sent] == [(0, 2), (3, 1)] and exchange.flags(sent[0]["twice"], 2).tolist() == [True, False]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB \t\n\x0bé\x1c", max_size=20), max_size=6))
def test_words(texts):
    found = Words(pa.array(texts, pa.string()), lower=True)
    assert [found.raw[s:e].tobytes() for s, e in zip(found.start, found.end, strict=True)] == [w for t in texts for w in t.encode().translate(LOWER).translate(bytes.maketrans(GAPS, b" " * 6)).split(b" ") if w]
    assert np.diff(found.first).tolist() == [len(words(t)) for t in texts]
    assert [x for a, b in slices(pa.array(texts, pa.string()), 8) for x in range(a, b)] == list(range(len(texts)))


def test_scores_follow_the_model(spark, docs):
    got = lm.score(docs).collect()
    model = [(i, words(t), i is None or zlib.crc32(str(i).encode()) % 7 == 2) for i, t in rows()]
    c, cu, kinds, pairs = Counter(), Counter(), defaultdict(set), Counter()
    for _, w, held in model:
        for a, b in zip([1, *w], [*w, 0], strict=True):
            if not held:
                c[b] += 1
                cu[a] += 1
                kinds[a].add(b)
                pairs[a, b] += 1
    total, size = sum(c.values()), len(c)
    once, two = (sum(v == k for v in pairs.values()) for k in (1, 2))
    d = once / (once + 2 * two) if once and two else 0.5
    p = lambda b: (c[b] + 1) / (total + size + 1)
    arc = lambda a, b: (max(pairs[a, b] - d, 0) + d * len(kinds[a]) * p(b)) / cu[a] if cu[a] else p(b)
    want = Counter((i, held, len(w) + 1, sum(c[b] > 0 for b in [*w, 0]), total, round(sum(math.log10(p(b)) for b in [*w, 0]), 6), round(sum(math.log10(arc(a, b)) for a, b in zip([1, *w], [*w, 0], strict=True)), 6))
                   for i, w, held in model)
    assert Counter((*r[:5], round(r.base_score, 6), round(r.score, 6)) for r in got) == want
    assert all(abs(sum(arc(a, b) for b in c) + arc(a, "unseen") - 1) < 1e-9 for a in cu)
    assert lm.score(none(docs)).count() == 0


def test_quality_counts_and_cutoffs(spark, docs, labels):
    got = {(r.doc_id, r.n_words): r for r in quality.judge(docs, labels).collect()}
    for i, t in rows():
        w = (t or "").encode().split()
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        again = {i + k for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if windows[x] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        r = got[i, len(w)]
        assert (r.word_chars, r.n_repeat_words, r.n_dup_lines) == (sum(len(x.decode()) for x in w), len(again), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 50 or 2 * len(again) > len(w)) and not (r.kept and r.base_failed)
    assert quality.judge(none(docs), labels).count() == 0 and quality.judge(docs, labels.limit(0)).count() == docs.count()


def test_binomial_bound_certifies_only_what_it_may(spark):
    rows_ = spark.range(1).select(*(quality.binomial_cdf(quality.F.lit(k).cast("long"), quality.F.lit(n).cast("long"), p).alias(f"x{j}") for j, (k, n, p) in enumerate([(0, 10, .1), (3, 40, .05), (10, 10, .5)])))
    exact = [sum(math.comb(n, j) * p ** j * (1 - p) ** (n - j) for j in range(k + 1)) for k, n, p in [(0, 10, .1), (3, 40, .05), (10, 10, .5)]]
    assert np.allclose(list(rows_.first()), exact)
    base = spark.range(4000).selectExpr("id as doc_id", "if(id % 10 < 9, 'big', 'few') as stratum", "false as base_failed", *(f"{'cast(id % 1000 as double) / 1220' if s == 'symbol_share' else '0D'} as {s}" for s in quality.SIGNALS)).where("stratum = 'big' or id < 300")
    labels = base.selectExpr("doc_id", "1 as quality")
    cut = {r.stratum: r for r in quality.cutoffs(base, labels, risk=0.3, doubt=0.05).collect()}
    assert "few" not in cut or cut["few"].symbol_share_cutoff is None
    rejected = base.where(f"stratum = 'big' and symbol_share > {cut['big'].symbol_share_cutoff}").count() / base.where("stratum = 'big'").count()
    assert 0 < rejected < 0.3 / len(quality.SIGNALS)


def test_exact_copies(docs):
    groups = defaultdict(list)
    for i, t in rows():
        groups[(t or "").encode().translate(None, GAPS)].append((-len(t or ""), i is None, i or 0, i))
    got = exact_dedup.dedupe(docs).collect()
    assert len(got) == len(rows()) and sum(r.kept for r in got) == len(groups)
    for r in got:
        key = next(k for k in groups if hashlib.sha256(k).hexdigest() == r.text_sha256)
        assert r.group_size == len(groups[key]) and r.keep_id == min(groups[key])[3] and (not r.kept or r.doc_id == r.keep_id)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.doc_id) for r in got if r.kept)
    assert exact_dedup.dedupe(none(docs)).count() == exact_dedup.keep_one(none(docs)).count() == 0


def test_difference_cover_groups_equal_prefixes():
    r = np.random.default_rng(3)
    for letters in (1, 2, 4, 200):
        base = r.integers(0, letters, 300).astype(np.uint8)
        parts = [base[a:a + int(r.integers(50, 90))].copy() for a in r.integers(0, 200, 12)]
        for p in parts[::2]:
            p[r.integers(0, len(p))] = 255
        text, at = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        starts = np.array([a + i for a, p in zip(at, parts, strict=False) for i in range(len(p) - 49)])
        owners = r.integers(0, 9, len(starts))
        best = {}
        for s, o in zip(starts, owners, strict=True):
            best[text[s:s + 50].tobytes()] = min(o, best.get(text[s:s + 50].tobytes(), 99))
        assert least_equal(text, starts, owners).tolist() == [best[text[s:s + 50].tobytes()] for s in starts]


def test_repeated_passages(docs):
    least = {}
    order = lambda i: math.inf if i is None else i
    for i, t in sorted(rows(), key=lambda r: order(r[0])):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            least.setdefault(b[k:k + 50], order(i))
    want = Counter()
    for i, t in rows():
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if least[b[k:k + 50]] < order(i):
                gone[k:k + 50] = True
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(b) else 0
        want[i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()] += 1
    assert Counter(map(tuple, suffix_dedup.removed_passages(docs).collect())) == want
    cut = suffix_dedup.without_passages(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count() and suffix_dedup.removed_passages(none(docs)).count() == 0


def test_toxicity_learns_words(spark, docs, labels):
    r = np.random.default_rng(1)
    calm = [" ".join(r.choice(STORY.lower().split(), 30)) for _ in range(300)]
    data = [(100 + k, t + (" Grumble, " + t if k % 4 == 0 else "")) for k, t in enumerate(calm)]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    model = toxicity.train(frame, frame.selectExpr("doc_id", "cast(doc_id % 4 = 0 as int) as toxic"))
    got = toxicity.score(frame, model).collect()
    held = [x for x in got if x.held_out]
    assert held and all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got)
    assert np.mean([x.predicted == (x.doc_id % 4 == 0) for x in held]) > 0.95
    assert toxicity.score(docs, model).count() == docs.count() and toxicity.without_toxic(docs, model).columns == docs.columns
    assert {x.score for x in toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect()} == {0.5}
    toxicity.train(docs, labels)


def test_tokens_and_packing(docs):
    from tokenizers import Tokenizer
    path = tokenizer_path("word_bpe_49k.json")
    tool = Tokenizer.from_file(path)
    ids = lambda t: tool.encode(t or "", add_special_tokens=False).ids
    got = token_counts.count_tokens(docs, path).collect()
    assert Counter(map(tuple, got)) == Counter((i, len((t or "").encode()), len(ids(t)), len(ids(t)) > 2048) for i, t in rows())
    bins, texts = defaultdict(list), defaultdict(list)
    for p in packing.pack(docs, path).collect():
        bins[p.sequence_id].append(p)
        texts[p.doc_id].append(p)
    for part in bins.values():
        part.sort(key=lambda p: p.offset)
        assert [p.offset for p in part] == np.cumsum([0, *(p.length for p in part)])[:-1].tolist() and sum(p.length for p in part) <= 4096
    by = {i: np.array([*ids(t), 2], "<u4") for i, t in rows()}
    for i in set(by) - {2, None}:                                  # of those with one row
        for p in texts[i]:
            assert p.doc_tokens == len(by[i]) and p.ids_crc32 == zlib.crc32(by[i][p.start:p.start + p.length].tobytes())
        assert sorted(x for p in texts[i] for x in range(p.start, p.start + p.length)) == list(range(len(by[i])))
    assert packing.pack(none(docs), path).count() == token_counts.count_tokens(none(docs), path).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 20000))
def test_cut_lengths(n):
    cut = packing.cut_lengths(n, 4096, 64)
    assert sum(cut) == n and all(4096 - (4096 // x) * x <= 64 or 4096 // x >= packing.CLASSES for x in cut)


def test_sentencepieces_in_chunks(docs):
    path = tokenizer_path("piece_bpe_32k.model")
    model = sentencepieces.pieces(path)
    gain = dict(model.of.values())
    score = lambda b: (sum(gain.get(int(x), 0) for x in np.frombuffer(b, "<i4")), sum(int(x) not in gain for x in np.frombuffer(b, "<i4")))
    whole, cut = (Counter((r.doc_id, r.text, score(r.ids), r.decoded == r.text) for r in sentencepieces.decode(sentencepieces.encode(docs, path, g, c), path).collect()) for g, c in ((1 << 16, 1 << 14), (90, 37)))
    assert whole == cut and all(k[3] for k in whole) and sum(whole.values()) == len(rows())
    text = sentencepieces.MARK + "ab naïve 日"
    best = {0: 0}
    for i in range(len(text)):                                     # plain dynamic programme
        for j in range(i + 1, len(text) + 1):
            s = model.of.get(text[i:j], (0, model.unknown if j == i + 1 else None))[1]
            if s is not None:
                best[j] = max(best.get(j, -math.inf), best[i] + s)
    found = model.best(text, 0, len(text))
    assert model.decode(np.array(found)) == b"ab na\xc3\xafve \xe6\x97\xa5" and model.forward(text, 0, len(text), len(text))[0][-1] == best[len(text)]
    assert sentencepieces.encode(none(docs), path).count() == 0


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(docs, size):
    sets = defaultdict(set)
    for i, t in rows():
        w = words(t)
        sets[i].add(frozenset(tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset())
    root = {i: i for i in sets if i is not None}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in root:
        for b in root:
            if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = near_dedup.near_duplicates(docs, size).collect()
    assert len(got) == len(rows()) and all(r.component_id == find(r.doc_id) and r.kept == (r.component_id == r.doc_id) for r in got if r.doc_id is not None)
    assert {(r.component_id, r.kept) for r in got if r.doc_id is None} == {(1, False), (None, True)}
    kept = near_dedup.keep_one(docs, size)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} - {None} == {r.doc_id for r in got if r.kept} - {None}
    assert near_dedup.near_duplicates(none(docs)).count() == 0


def test_large_families_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CELL", 7)
    r = np.random.default_rng(2)
    base = r.choice(5000, 120)
    texts = []
    for k in range(60):
        w = base.copy()
        w[r.choice(120, int(r.integers(0, 8)), replace=False)] = r.integers(5000, 9000)
        texts.append((k, " ".join(map(str, w))))
    sets = {i: {tuple(t.split()[k:k + 4]) for k in range(117)} for i, t in texts}
    root = list(range(60))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 4).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in sets}


def test_components(spark):
    edges = [(k, k + 1) for k in range(20)] + [(40, 41), (41, 42), (50, 50), (60, 61), (60, 61)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), 40: 40, 41: 40, 42: 40, 60: 60, 61: 60}


def test_shards(docs):
    got = sharding.shard(docs, 4).collect()
    assert len(got) == len(rows()) and Counter((r.doc_id, r.size) for r in got) == Counter((i, len((t or "").encode()) + 1) for i, t in rows())
    assert all(r.text_crc32 in {zlib.crc32((t or "").encode()) for i, t in rows() if i == r.doc_id} for r in got)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    many = sharding.place(np.random.default_rng(0).integers(1, 1000, (5000, 3)).astype(float), 16)
    assert np.bincount(many, minlength=16).min() > 0 and sharding.shard(none(docs)).count() == 0


def test_shingle_sets_of_short_texts():
    values, first = shingle_sets(pa.array(["", "a b", "A  B", "a b c d e a b c d e"]), 5)
    assert np.diff(first).tolist() == [0, 1, 1, 5] and values[first[1]] == values[first[2]]


def test_large_buckets_and_families_are_compared_whole(spark, monkeypatch):
    """A passage shared by unrelated texts makes large buckets, but no family; near copies of one text that their pivots don't connect meet in many blocks."""
    monkeypatch.setattr(near_dedup, "CELL", 8)
    monkeypatch.setattr(near_dedup, "TURNS", 1)
    r = np.random.default_rng(3)
    common = " ".join(f"p{k}" for k in range(60))
    mixed = [common + " " + " ".join(f"w{x}" for x in r.integers(0, 1 << 40, 30)) for _ in range(120)]
    copies = []
    for _ in range(60):
        w = [f"c{k}" for k in range(80)]
        for k in r.integers(0, 80, r.integers(0, 4)):
            w[k] = f"z{r.integers(0, 1 << 40)}"
        copies.append(" ".join(w))
    texts = mixed + copies
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    least = near_dedup._least_matches(0.8)
    marks = near_dedup._marks(docs, 5).cache()
    reps = near_dedup._classes(marks).cache()
    sig = {x.cid: np.frombuffer(x.sig, np.uint16) for x in reps.collect()}
    buckets, members = near_dedup._buckets(reps)
    pairs = members.join(buckets, "k").where("hub != cid").selectExpr("hub as u", "cid as v").distinct()
    edges = near_dedup._agreed(pairs, reps, least).collect()
    assert edges and {tuple(e) for e in edges} == {(u, v) for u, v in pairs.collect() if (sig[u] == sig[v]).sum() >= least}
    values, first = shingle_sets(pa.array(texts), 5)
    sets = [set(values[a:b].tolist()) for a, b in zip(first, first[1:], strict=False)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    assert {x.doc_id: x.component_id for x in near_dedup.near_duplicates(docs).collect()} == dict(enumerate(root))
    assert 1 < len(set(root[120:])) or len(set(root)) == 121


def test_frequent_contexts_are_dealt_to_several_owners(spark, monkeypatch):
    """One word before most others: with a small bound no owner holds all its successors, and scores stay the same."""
    r = np.random.default_rng(4)
    texts = [" ".join(f"the w{x}" for x in r.integers(0, 900, 200)) for _ in range(40)] + [None, "", "the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sizes = []
    answers = lm._answers

    def seen(requests, *more):
        sizes.append(max(x.n for x in requests.groupBy("owner").agg(lm.F.sum(lm.F.length("succ_high")).alias("n")).collect()))
        return answers(requests, *more)

    monkeypatch.setattr(lm, "_answers", seen)
    whole = {x.doc_id: x for x in lm.score(docs).collect()}
    monkeypatch.setattr(lm, "PART", 200, raising=False)
    parts = {x.doc_id: x for x in lm.score(docs).collect()}
    assert sizes[1] < sizes[0] / 3
    assert whole.keys() == parts.keys()
    for k, x in whole.items():
        assert x[:5] == parts[k][:5] and math.isclose(x.score, parts[k].score, rel_tol=1e-12) and math.isclose(x.base_score, parts[k].base_score, rel_tol=1e-12)
