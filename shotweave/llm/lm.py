"""Language-model scores by a weighted backoff automaton, built for each block of documents from counts over the whole corpus."""
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut_lineage, id_and_text, partitions, schema_with
from .words import Words, mix, slices, text_column

BEGIN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)     # stand for a text's begin as a context and its end as a token
SUCC_BITS = np.uint64(40)                       # of a successor's hash within its context
BLOCK_BYTES = 8 << 20
OFTEN = 256                                     # occurrences in a block from which a context is counted beforehand
PART = 1 << 21                                  # occurrences in the corpus above which a context's successors are dealt to several owners


def squeeze(a: np.ndarray, level: int = 1) -> bytes:
    return pa.Codec("zstd", level).compress(a.tobytes(), asbytes=True)


def spread(blob: bytes, n: int, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, decompressed_size=n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def planes(codes: np.ndarray) -> np.ndarray:
    """The bytes of 32-bit codes, all lowest bytes first."""
    return np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T)


def unplanes(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _blocks(docs: DataFrame) -> DataFrame:
    """Rows of about 8 MB of text each: block, ids, held (out of training), sizes (words per text), words (distinct hashes), codes (their order),
    heavy and times (contexts that occur OFTEN in the block, and how often)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = text_column(batch)
            for i, j in slices(texts, BLOCK_BYTES):
                words = Words(texts.slice(i, j - i), lower=True)
                codes, first = words.distinct()
                times = np.bincount(codes, minlength=len(first))
                often = np.argsort(-times, kind="stable")      # frequent words get small codes, which compress well
                rank = np.empty_like(often)
                rank[often] = np.arange(len(often))
                codes, first, times = rank[codes], first[often], times[often]
                heavy = np.append(words.hash[first], BEGIN), np.append(times, j - i)
                heavy = [x[heavy[1] >= OFTEN].astype(np.int64) for x in heavy]
                yield pa.RecordBatch.from_arrays([
                    pa.array([block]), pa.array([batch.column(0).slice(i, j - i).to_pylist()], pa.list_(batch.schema.field(0).type)), pa.array([batch.column(2).slice(i, j - i).to_pylist()], pa.list_(pa.bool_())),
                    pa.array([np.diff(words.first).astype(np.int32).tobytes()], pa.binary()), pa.array([words.hash[first].tobytes()], pa.binary()), pa.array([squeeze(planes(codes))], pa.binary()),
                    *(pa.array([x], pa.list_(pa.int64())) for x in heavy)],
                    names=["block", "ids", "held", "sizes", "words", "codes", "heavy", "times"])
                block += 1

    return docs.mapInArrow(run, f"block long, ids array<{kind}>, held array<boolean>, sizes binary, words binary, codes binary, heavy array<long>, times array<long>")


class Block:
    """One block's texts as a walk over states: contexts (a word, or the begin), tokens (a word, or the end), and the distinct pairs of both.

    Contexts are sorted by hash, pairs by context and successor hash; pair[i] is the pair of token i.
    """

    def __init__(self, held, sizes, words, codes):
        sizes, words = np.frombuffer(sizes, np.int32).astype(np.int64), np.frombuffer(words, np.uint64)
        codes = unplanes(spread(codes, 4 * int(sizes.sum()), np.uint8))
        hashes = np.concatenate((words, [BEGIN, END]))
        order = np.argsort(hashes)
        place = np.empty(len(hashes), np.int64)
        place[order] = np.arange(len(hashes))
        self.hash = hashes[order]
        self.begin, self.end = place[len(words)], place[len(words) + 1]
        self.length = sizes + 1
        ends = np.cumsum(self.length) - 1
        self.token = np.empty(int(self.length.sum()), np.int64)
        inner = np.ones(len(self.token), bool)
        inner[ends] = False
        self.token[inner], self.token[ends] = place[codes], self.end
        self.context = np.empty_like(self.token)
        self.context[1:] = self.token[:-1]
        self.context[ends - sizes] = self.begin
        self.doc = np.repeat(np.arange(len(sizes)), self.length)
        self.trained = ~np.asarray(held, bool)[self.doc]
        succ = mix(self.hash ^ np.uint64(0x2545F4914F6CDD1D)) >> (np.uint64(64) - SUCC_BITS)
        rank = np.empty(len(succ), np.int64)
        rank[np.argsort(succ, kind="stable")] = np.arange(len(succ))
        key, self.pair, counts = np.unique(self.context * len(succ) + rank[self.token], return_inverse=True, return_counts=True)
        self.pair_context = key // len(succ)
        back = np.argsort(rank)
        self.pair_token = back[key % len(succ)]
        self.succ = succ[self.pair_token]
        self.pair_count = np.bincount(self.pair[self.trained], minlength=len(key))
        self.context_count = np.bincount(self.context[self.trained], minlength=len(self.hash))
        self.runs = np.bincount(self.pair_context, minlength=len(self.hash))

    @classmethod
    def of(cls, row):
        return cls(row["held"], row["sizes"], row["words"], row["codes"])

    def by_owner(self, split):
        """(owner, contexts from, to, pairs) along the sorted contexts, without pairs of split contexts; then (owner, context, context + 1, pairs) for the parts of those."""
        of, hot = split.find(self.hash)
        cold, parted = self.cold(split)
        owner = owner_of(self.hash, split.owners)
        edges = np.flatnonzero(np.diff(owner, prepend=-1, append=split.owners))
        pairs = np.concatenate(([0], np.cumsum(np.where(hot, 0, self.runs))))
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield int(owner[i]), i, j, cold[pairs[i]:pairs[j]]
        k = of[self.pair_context[parted]]
        part = split.first[k] + (self.succ[parted] * split.parts[k].astype(np.uint64) >> SUCC_BITS).astype(np.int64)
        edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1)) if len(part) else [0]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            u = int(self.pair_context[parted[i]])
            yield int(part[i]), u, u + 1, parted[i:j]

    def cold(self, split):
        """Pairs of contexts that have one owner, and pairs of split contexts, each in order."""
        hot = split.find(self.hash)[1][self.pair_context]
        return np.flatnonzero(~hot), np.flatnonzero(hot)


class Split:
    """Contexts whose successors go to several owners by ranges of the successors' hashes: hash (ascending), parts, and first, the owner of each one's first part."""

    def __init__(self, owners: int, times: dict[int, int]):
        self.owners = owners
        self.hash = np.sort(np.array(list(times), np.int64).view(np.uint64))
        self.parts = np.array([-(-times[h] // PART) for h in self.hash.view(np.int64).tolist()], np.int64)
        self.first = owners + np.cumsum(self.parts) - self.parts

    def find(self, hashes):
        """Place of each hash among the split contexts, and whether it is one."""
        at = np.searchsorted(self.hash, hashes)
        if not len(self.hash):
            return at, np.zeros(len(hashes), bool)
        at = np.minimum(at, len(self.hash) - 1)
        return at, self.hash[at] == hashes


def owner_of(hashes, owners):
    return ((hashes >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)


def _requests(blocks: DataFrame, split: Split) -> DataFrame:
    """Per block and owner of a range of contexts: their hashes and training counts, and each one's successors with theirs.

    A split context's count goes with the context, its successors go to the owners of its parts, where it counts as 0.
    """
    names = ["owner", "block", "n", "contexts", "context_count", "runs", "succ_low", "succ_high", "pair_count"]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = Block.of(row)
                out = []
                whole = np.where(split.find(b.hash)[1], 0, b.runs)
                for owner, i, j, p in b.by_owner(split):
                    part, succ = owner >= split.owners, b.succ[p]
                    total, runs = (np.zeros(1), np.array([len(p)])) if part else (b.context_count[i:j], whole[i:j])
                    out.append((owner, row["block"], j - i, b.hash[i:j].tobytes(), squeeze(total.astype(np.uint32)), squeeze(runs.astype(np.uint32)),
                                succ.astype(np.uint32).tobytes(), (succ >> np.uint64(32)).astype(np.uint8).tobytes(), squeeze(b.pair_count[p].astype(np.uint32))))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 3 else pa.binary()) for k, c in enumerate(zip(*out, strict=True))], names=names)

    return blocks.select("block", "held", "sizes", "words", "codes").mapInArrow(run, "owner long, block long, n long, contexts binary, context_count binary, runs binary, succ_low binary, succ_high binary, pair_count binary")


def _answers(requests: DataFrame, owners: int) -> DataFrame:
    """Per block and owner the corpus counts of what was asked; one row more per owner (no block) with its tokens, words and counts of counts,
    and for a part of a split context also that context and its different successors here."""
    def own(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        contexts = np.concatenate([np.frombuffer(r["contexts"], np.uint64) for r in rows])
        kinds, where = np.unique(contexts, return_inverse=True)
        total = np.bincount(where, np.concatenate([spread(r["context_count"], r["n"], np.uint32) for r in rows]), len(kinds)).astype(np.int64)
        runs = [spread(r["runs"], r["n"], np.uint32) for r in rows]
        succ = np.concatenate([np.frombuffer(r["succ_low"], np.uint32).astype(np.uint64) | np.frombuffer(r["succ_high"], np.uint8).astype(np.uint64) << np.uint64(32) for r in rows])
        sizes = [int(x.sum()) for x in runs]
        owner_context = np.repeat(where, np.concatenate(runs))
        pairs, at = np.unique(mix(kinds[owner_context] + np.uint64(1)) ^ succ * np.uint64(0x9FB21C651E98DF25), return_inverse=True)
        counts = np.bincount(at, np.concatenate([spread(r["pair_count"], k, np.uint32) for r, k in zip(rows, sizes, strict=True)]), len(pairs)).astype(np.int64)
        of = np.empty(len(pairs), np.int64)
        of[at] = owner_context
        kinds_after = np.bincount(of[counts > 0], minlength=len(kinds))
        out, c, p = [], 0, 0
        for r, k in zip(rows, sizes, strict=True):
            w, a = where[c:c + r["n"]], at[p:p + k]
            out.append((r["owner"], r["block"], r["n"], k, squeeze(total[w].astype(np.uint64)), squeeze(kinds_after[w].astype(np.uint32)), squeeze(counts[a].astype(np.uint64)), None))
            c, p = c + r["n"], p + k
        inside = kinds != BEGIN
        docs = int(total[~inside].sum())
        stats = [int(total[inside].sum()) + docs, int((total[inside] > 0).sum()) + (docs > 0), int((counts == 1).sum()), int((counts == 2).sum())]
        if rows[0]["owner"] >= owners:
            stats += [int(kinds.view(np.int64)[0]), int(kinds_after[0])]
        out.append((rows[0]["owner"], None, None, None, None, None, None, stats))
        kinds_ = [pa.int64()] * 4 + [pa.binary()] * 3 + [pa.list_(pa.int64())]
        return pa.table({f.split()[0]: pa.array(c, k) for f, c, k in zip(ANSWER.split(", "), zip(*out, strict=True), kinds_, strict=True)})

    return requests.groupBy("owner").applyInArrow(own, ANSWER)


ANSWER = "owner long, block long, n long, pairs long, total binary, after binary, counts binary, stats array<long>"


class Automaton:
    """The part of the backoff automaton that a block can reach.

    A state is a context. Its arcs, one per pair seen in training, carry log10 of max(c - D, 0) / c(u) + D N(u) / c(u) * p(w); on any other token the failure arc,
    weight log10 of D N(u) / c(u), leads to the root, whose arcs carry log10 p(w) = log10((c(w) + 1) / (N + V + 1)). A context not seen in
    training is the root itself (failure weight 0). Every state's probabilities sum to one.
    """

    def __init__(self, block: Block, total, after, counts, tokens, distinct, discount):
        of_token = total.copy()
        of_token[block.end] = total[block.begin]
        self.known = of_token > 0
        self.known[block.begin] = False
        self.root = np.log10((of_token + 1.0) / (tokens + distinct + 1.0))
        seen = np.maximum(total, 1)
        back = discount * after / seen
        self.failure = np.where(total > 0, np.log10(np.maximum(back, 1e-300)), 0.0)
        u, w = block.pair_context, block.pair_token
        direct = (counts - discount) / seen[u] + back[u] * 10.0 ** self.root[w]
        self.arc = np.where(counts > 0, np.log10(np.where(counts > 0, direct, 1.0)), self.failure[u] + self.root[w])

    def walk(self, block: Block):
        """Log-probability of each text: from left to right, the token read names the next state, and the arc or failure taken adds its weight."""
        return np.bincount(block.doc, self.arc[block.pair], len(block.length))

    def base(self, block: Block):
        return np.bincount(block.doc, self.root[block.token], len(block.length))


def score(docs: DataFrame, folds: int = 7, held_fold: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10); one row per row of docs.

    A bigram model with interpolated absolute discounting, D = n1 / (n1 + 2 n2), learnt from the rows whose crc32(doc_id as text) mod `folds` is not `held_fold`; words are
    `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, and every text ends with one end token. Null and empty texts are the end token alone. A row without an id is held out. Repeated
    rows count each. If nothing is trained on, N and V are 0. An empty table gives no rows.

    Blocks of about 8 MB of text send the distinct pairs they hold to the owners of the contexts' hashes, owners add up training counts and answer with corpus
    counts, and each block builds its part of the automaton and walks its texts. No table of n-grams is broadcast; a frequent pair is one entry per block.
    A context of more than PART occurrences has its successors dealt to several owners by their hashes; its successor counts are added up over them.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held_fold, F.lit(True)).alias("held")
    blocks = cut_lineage(_blocks(id_and_text(docs).select("doc_id", "text", held)))
    words = blocks.agg(F.sum(F.octet_length("codes"))).first()[0] or 0
    owners = max(partitions(docs), words // 3_000_000 + 1)
    heavy = blocks.select(F.explode(F.arrays_zip("heavy", "times")).alias("x")).groupBy("x.heavy").agg(F.sum("x.times").alias("times")).where(F.col("times") > PART)
    split = Split(owners, {r.heavy: r.times for r in heavy.collect()})       # at most one row per PART tokens
    answers = cut_lineage(_answers(_requests(blocks, split), owners))
    after_split = dict(answers.where("size(stats) > 4").groupBy(F.col("stats")[4]).agg(F.sum(F.col("stats")[5])).collect())
    after_split = np.array([after_split.get(h, 0) for h in split.hash.view(np.int64).tolist()], np.int64)
    tokens, distinct, once, two = answers.where("stats is not null").agg(*(F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)) for i in range(4))).first()
    discount = once / (once + 2 * two) if once and two else 0.5
    schema = schema_with(docs, "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            b = Block.of(row)
            parts = sorted(right.to_pylist(), key=lambda r: r["owner"])
            take = lambda name, size, kind: np.concatenate([spread(r[name], r[size], kind) for r in parts]).astype(np.int64)
            counts = np.empty(len(b.pair_context), np.int64)
            counts[np.concatenate(b.cold(split))] = take("counts", "pairs", np.uint64)
            parts = [r for r in parts if r["owner"] < owners]
            total, after = take("total", "n", np.uint64), take("after", "n", np.uint32)
            at, hot = split.find(b.hash)
            after[hot] = after_split[at[hot]]
            machine = Automaton(b, total, after, counts, tokens, distinct, discount)
            known = np.bincount(b.doc, machine.known[b.token], len(b.length)).astype(np.int64)
            out.append(pa.table([pa.array(row["ids"], left["ids"].type.value_type), pa.array(row["held"]), pa.array(b.length), pa.array(known), pa.array(np.full(len(known), tokens)),
                                 pa.array(machine.base(b)), pa.array(machine.walk(b))], names=schema.names))
        return pa.concat_tables(out) if out else pa.table([pa.array([], f.type) for f in left.schema][:0])

    return (blocks.groupBy("block").cogroup(answers.where("stats is null").groupBy("block")).applyInArrow(walk, schema))
