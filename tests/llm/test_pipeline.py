"""Every stage of the corpus pipeline against brute force on its own input."""
import itertools
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from shotweave.llm.frames import tokenizer_path, written

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(400)]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    texts, toxic = [], set()
    for _ in range(60):
        texts.append(" ".join(words(r.randint(30, 160))))
    passage = " ".join(words(40))
    for i in range(6):
        texts.append(" ".join(words(30)) + " " + passage + " " + " ".join(words(30)))
    for i in range(12):
        w = words(120)
        texts.append(" ".join(w))
        texts.append("  ".join(w) + "\n")                              # equal without white space, longer
        w[r.randrange(120)] = "changed"
        texts.append(" ".join(w))                                      # 5 of some 116 shingles differ
    for i in range(40):
        toxic.add(len(texts))
        texts.append(" ".join(w if k % 3 else "vile%d" % (k % 2) for k, w in enumerate(words(60))))
    texts += [None, "", "   ", "short text", "short  text", "short text here"]
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], toxic


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    rows, toxic = corpus()
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    have = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").schema
    fill = {"doc_id": lambda i: i, "toxic": lambda i: int(i in toxic)}
    kinds = {"string": "", "boolean": False}
    labels = [tuple(fill.get(f.name, lambda i, f=f: kinds.get(f.dataType.typeName(), 0))(r[0]) for f in have) for r in rows]
    spark.createDataFrame(labels, ", ".join(f"{f.name} {'int' if f.name == 'toxic' else 'long' if f.name == 'doc_id' else f.dataType.simpleString()}" for f in have)).write.parquet(f"{folder}/labels.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), [rows]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder))
        out.append([r.asDict() for r in docs.collect()])
    return toxic, [{r[0]: r[1] for r in out[0]}, *[{r["doc_id"]: r["text"] for r in o} for o in out[1:5]]], out, folder


def test_toxic_documents_go_and_clean_ones_stay(stages):
    toxic, texts, _, _ = stages
    gone = set(texts[0]) - set(texts[1])
    assert gone == toxic and all(texts[1][i] == texts[0][i] for i in texts[1])


def test_one_of_each_group_of_equal_texts(stages):
    _, texts, _, _ = stages
    groups = {}
    for i, t in texts[1].items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append(i)
    assert set(texts[2]) == {max(g, key=lambda i: (len(texts[1][i] or ""), -i)) for g in groups.values()}


def test_one_of_each_component_of_near_copies(stages):
    _, texts, _, _ = stages
    sets = {}
    for i, t in texts[2].items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sorted(sets), 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                label[a] = label[b] = min(label[a], label[b])
        if not any(label[label[i]] != label[i] for i in label):
            break
    assert len(texts[3]) < len(texts[2]) and set(texts[3]) == {i for i in sets if label[i] == i}


def test_repeated_passages_are_cut(stages):
    _, texts, out, _ = stages
    before, seen, cut = texts[3], set(), 0
    for i in sorted(before):
        t = (before[i] or "").encode()
        gone = np.zeros(len(t), bool)
        own = [t[k:k + 50] for k in range(len(t) - 49)]
        for k, w in enumerate(own):
            gone[k:k + 50] |= w in seen
        seen.update(own)
        cut += gone.any()
        assert (texts[4][i] or "").encode() == bytes(x for x, g in zip(t, gone) if not g)
    assert set(texts[4]) == set(before) and cut >= 5
    assert all(r["n_chars"] == len(r["text"] or "") for r in out[4])


def test_sequences_hold_every_id_once(stages):
    import zlib
    from tokenizers import Tokenizer
    _, texts, out, _ = stages
    tok, pieces, rows = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), {}, {}
    for r in out[5]:
        pieces.setdefault(r["doc_id"], []).append(r)
        rows.setdefault(r["sequence_id"], []).append(r)
    assert set(pieces) == set(texts[4])
    for i, ps in pieces.items():
        ids, at = np.array(tok.encode(texts[4][i] or "", add_special_tokens=False).ids + [2], "<u4"), 0
        for p in sorted(ps, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[at:at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for ps in rows.values():
        ends = np.cumsum([0] + [p["length"] for p in sorted(ps, key=lambda p: p["offset"])])
        assert [p["offset"] for p in sorted(ps, key=lambda p: p["offset"])] == ends[:-1].tolist() and ends[-1] <= 4096


def test_stages_on_a_table_without_rows_and_with_further_columns(spark, stages):
    none = spark.createDataFrame([], DOCS + ", kept boolean, owner int, score double")
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, none, stages[3]).collect() == [], name
