"""Near-duplicates: many universal hash minima, banding, signature and full-set verification, components by large-star and small-star."""
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sieve
from .components import components
from .frames import cut_lineage, id_and_text, let_go, schema_with
from .shingles import shingle_sets
from .words import mix, slices, small, text_column

BANDS, ROWS = 26, 4                             # a pair at 0.8 shares no band once in a million
HASHES = BANDS * ROWS
TURNS = 2                                       # times that the members of a bucket meet one of them before those still apart meet each other
CELL = 2048                                     # members of either side in one task
CELL_VALUES = 1 << 21                           # shingles of either side in one task
SALT = 8
SEED = np.random.default_rng(20240229).integers(0, 1 << 63, (2, HASHES), np.uint64)
TIMES, PLUS = SEED[0] * np.uint64(2) + np.uint64(1), SEED[1]


def signatures(values, first):
    """Minima of HASHES universal hashes (multiply-add modulo 2**64, high 32 bits) of each non-empty set."""
    held = np.flatnonzero(np.diff(first))
    out = np.empty((len(held), HASHES), np.uint64)
    work = np.empty_like(values)
    for k in range(HASHES):
        np.multiply(values, TIMES[k], out=work)
        np.add(work, PLUS[k], out=work)
        out[:, k] = np.minimum.reduceat(work, first[held]) if len(held) else 0
    return held, out >> np.uint64(32)


def bands(minima):
    """One 64-bit key per band."""
    keys = np.zeros((len(minima), BANDS), np.uint64)
    for k in range(HASHES):
        b = k // ROWS
        keys[:, b] = mix(keys[:, b] ^ minima[:, k] ^ np.uint64(b << 40))
    return keys.view(np.int64)


def _marks(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n (set size), a and b (digest of the set), bands, sig (low 16 bits of the minima)."""
    schema = schema_with(docs, "n long, a long, b long, bands array<long>, sig binary")

    def run(batches):
        for batch in batches:
            texts = text_column(batch)
            for i, j in slices(texts):
                values, first = shingle_sets(texts.slice(i, j - i), size)
                held, minima = signatures(values, first)
                keys, low = bands(minima), minima.astype(np.uint16)
                digest = [hashlib.blake2b(values[first[t]:first[t + 1]], digest_size=16).digest() for t in range(j - i)]
                ab = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
                full = [None] * (j - i)
                sigs = list(full)
                for row, t in enumerate(held.tolist()):
                    full[t], sigs[t] = keys[row], low[row].tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(first)), pa.array(ab[:, 0].copy()), pa.array(ab[:, 1].copy()),
                                                  pa.array(full, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], names=schema.names)

    return docs.mapInArrow(run, schema)


def _least_matches(threshold: float) -> int:
    """Equal minima below which a pair at the threshold falls about once in 300,000."""
    return math.floor(HASHES * threshold - 4.5 * math.sqrt(HASHES * threshold * (1 - threshold)))


def _sig_matrix(column):
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def _apart(members: DataFrame, values: int | None) -> DataFrame:
    """members (k, cid, label, n, ...) dealt to pairs of blocks (low, high), such that each two of one key with different labels meet.

    Blocks have about CELL members and, if given, at most about `values` shingles. The members of a key's most frequent label don't meet each other; a key with one label is left out.
    """
    labels = members.groupBy("k", "label").agg(F.count("*").alias("n"), F.max("n").alias("widest"))
    main = labels.groupBy("k").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"), F.max("widest").alias("widest")).where("all > most")
    cell = F.greatest(F.lit(1), F.least(F.lit(CELL), F.floor(F.lit(values) / F.col("widest")))) if values else F.lit(CELL)
    main = main.select("k", "main", F.ceil((F.col("all") - F.col("most")) / cell).cast("int").alias("rest"), F.ceil(F.col("most") / cell).cast("int").alias("mains"))
    at = F.xxhash64(F.lit(SALT), "cid")
    held = F.when(F.col("label") == F.col("main"), F.col("rest") + F.pmod(at, F.col("mains"))).otherwise(F.pmod(at, F.col("rest"))).cast("int")
    last = F.when(F.col("label") == F.col("main"), F.col("rest")).otherwise(F.col("rest") + F.col("mains")) - 1
    dealt = members.join(main, "k").select(*members.columns, held.alias("block"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
    return dealt.select(*members.columns, "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))


def _sides(table: pa.Table):
    block, low, high = table["block"].to_numpy(), table["low"][0].as_py(), table["high"][0].as_py()
    return np.flatnonzero(block == low), np.flatnonzero(block == high)


def _agreeing(sigs, labels, left, right, least):
    """For each row of left those of right with another label whose signatures agree."""
    across = np.ascontiguousarray(sigs[right].T)
    for x in left.tolist():
        near = ((across == sigs[x][:, None]).view(np.uint8).sum(0, dtype=np.uint8) >= least) & (labels[right] != labels[x])
        if near.any():
            yield x, right[near]


def _codes(column) -> np.ndarray:
    return np.unique(column.to_numpy(), return_inverse=True)[1]


def _agreed(pairs: DataFrame, reps: DataFrame, least: int) -> DataFrame:
    """The pairs (u, v) whose signatures agree in at least `least` minima."""
    kind = reps.schema["cid"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            near = (_sig_matrix(batch["su"]) == _sig_matrix(batch["sv"])).sum(1) >= least
            yield pa.RecordBatch.from_arrays([batch["u"], batch["v"]], names=["u", "v"]).filter(pa.array(near))

    sig = lambda end: reps.select(F.col("cid").alias(end), F.col("sig").alias(f"s{end}"))
    return pairs.join(sig("v"), "v").join(sig("u"), "u").select("u", "v", "su", "sv").mapInArrow(run, f"u {kind}, v {kind}")


def _confirmed(docs: DataFrame, reps: DataFrame, pairs: DataFrame, size: int, least: int, percent: int) -> DataFrame:
    """The pairs (u, v) that are linked on full sets. Signatures go first; sets meet row by row, so a task holds no more than a few at a time."""
    pairs = cut_lineage(_agreed(pairs, reps, least))
    ids = pairs.select(F.col("u").alias("cid")).union(pairs.select("v")).distinct()
    sets = cut_lineage(_with_sets(docs, reps.select("cid", "a", "b").join(ids, "cid"), size).dropDuplicates(["cid"]).select("cid", "shingles"))
    named = lambda end: sets.select(F.col("cid").alias(end), F.col("shingles").alias(f"s{end}"))
    both = F.size(F.array_intersect("su", "sv"))
    return pairs.join(named("v"), "v").join(named("u"), "u").where(100 * both >= percent * (F.size("su") + F.size("sv") - both)).select("u", "v")


def _buckets(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Buckets of two or more members, one of those with the same members: (k, hub), hub being the least member; and (k, cid)."""
    places = reps.select("cid", F.explode("bands").alias("k"))
    found = places.groupBy("k").agg(F.count("*").alias("size"), F.min("cid").alias("hub"), F.bit_xor(F.xxhash64("cid")).alias("sign")).where("size > 1")
    buckets = cut_lineage(found.groupBy("size", "hub", "sign").agg(F.min("k").alias("k")).select("k", "hub"))
    return buckets, cut_lineage(places.join(buckets.select("k"), "k"))


def _labelled(members: DataFrame, met: DataFrame, links: DataFrame) -> DataFrame:
    """members (k, cid) with label, without those that have met their whole bucket (met: k, hub); of buckets with more than one label.

    Rows with one label are known to be connected: each points at its least linked neighbour, and once more at that one's. Whole components would only spare more comparisons.
    """
    point = links.groupBy(F.greatest("u", "v").alias("cid")).agg(F.min(F.least("u", "v")).alias("to"))
    further = point.select(F.col("cid").alias("to"), F.col("to").alias("next"))
    named = point.join(further, "to", "left").select("cid", F.coalesce("next", "to").alias("label"))
    rest = members.select("k", "cid").join(met.select("k", "hub"), "k").where("cid != hub").select("k", "cid")
    out = rest.join(named, "cid", "left").select("k", "cid", F.coalesce("label", "cid").alias("label"))
    open_ = out.groupBy("k").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("k")
    return cut_lineage(out.join(open_, "k"))


def _linked(docs: DataFrame, reps: DataFrame, size: int, least: int, percent: int) -> DataFrame:
    """u, v: links confirmed on full sets, enough of them to connect whichever two members of a band bucket are linked.

    First every member meets one of its bucket, the least, which then leaves; where a bucket still has members of several components, they meet another one, taken by hash. Members that
    are known to be connected by then, as in large families of copies, cost nothing more. Those that are left meet each other in blocks.
    """
    buckets, members = _buckets(reps)
    pairs = members.join(buckets, "k").where("hub != cid").select(F.col("hub").alias("u"), F.col("cid").alias("v")).distinct()
    links = cut_lineage(_confirmed(docs, reps, pairs, size, least, percent))
    del pairs
    for turn in range(1, TURNS + 1):
        members = _labelled(members, buckets, links)
        let_go(docs.sparkSession)
        if members.isEmpty():
            return links
        if turn < TURNS:
            buckets = cut_lineage(members.groupBy("k").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "cid"), "cid", "label")).alias("p")).select("k", "p.cid", "p.label").toDF("k", "hub", "own"))
            pairs = members.join(buckets, "k").where("label != own").select(F.least("hub", "cid").alias("u"), F.greatest("hub", "cid").alias("v")).distinct()
            links = cut_lineage(links.union(_confirmed(docs, reps, pairs, size, least, percent)))
            del pairs
            let_go(docs.sparkSession)
    return links.union(_met(docs, reps, members, size, least, percent))


def _runs(batches, key: str):
    """Tables of whole runs of equal `key` over sorted Arrow batches, with the places where runs begin."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        edges = np.flatnonzero(np.diff(table[key].to_numpy())) + 1
        last = int(edges[-1]) if len(edges) else 0
        if last:
            yield table.slice(0, last).combine_chunks(), np.concatenate(([0], edges[:-1]))
        held = table.slice(last)
    if held is not None and held.num_rows:
        yield held.combine_chunks(), np.array([0])


def _met(docs: DataFrame, reps: DataFrame, members: DataFrame, size: int, least: int, percent: int) -> DataFrame:
    """Links between members (k, cid, label) of one bucket and different labels.

    Signatures tell who may be linked with a member of another label, and which labels to compare: these make families. Inside a family those members meet in blocks, on full sets.
    """
    kind = reps.schema["cid"].dataType.simpleString()
    cells = _apart(members.join(reps.select("cid", "n"), "cid"), None).select(
        F.xxhash64("k", "low", "high").alias("cell"), "cid", "label", (F.col("block") == F.col("low")).alias("lower"), (F.col("low") == F.col("high")).alias("inner"))

    def meet(batches):
        """Of every member with a partner of another label: cid, label, and the least of all labels that are connected with it in its cell."""
        for table, edges in _runs(batches, "cell"):
            ids, sigs, labels = table["cid"].to_numpy(), _sig_matrix(table["sig"]), table["label"].to_numpy()
            lower, inner = (table[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("lower", "inner"))
            hit, root = np.zeros(len(ids), bool), {}
            names = labels.tolist()
            out = list(names)

            def find(x):
                while root.setdefault(x, x) != x:
                    x = root[x]
                return x

            for i, j in zip(edges.tolist(), np.append(edges[1:], len(ids)).tolist(), strict=True):
                rows, high = np.arange(i, j), ~lower[i:j] | inner[i:j]
                root.clear()
                some = False
                for x, near in _agreeing(sigs, labels, rows[lower[i:j]], rows[high], least):
                    some = hit[x] = hit[near] = True
                    for y in np.unique(labels[near]).tolist():
                        p, q = sorted((find(names[x]), find(y)))
                        root[q] = p
                if some:
                    out[i:j] = map(find, names[i:j])
            held = pa.array(hit)
            yield pa.RecordBatch.from_arrays([table["cid"].combine_chunks().filter(held), table["label"].combine_chunks().filter(held), pa.array(out, table.schema.field("label").type).filter(held)], names=["cid", "label", "other"])

    signed = cells.join(reps.select("cid", "sig"), "cid").repartition("cell").sortWithinPartitions("cell")
    hits = cut_lineage(signed.mapInArrow(meet, f"cid {kind}, label {kind}, other {kind}").distinct())
    # a label that only agrees with itself cannot occur, so every hit's label is in an edge or is the least one of some
    named = components(hits.select(F.col("label").alias("u"), F.col("other").alias("v")))
    rows = hits.select("cid", "label").distinct().join(named.select(F.col("node").alias("label"), F.col("component").alias("k")), "label").join(reps.select("cid", "a", "b", "n", "sig"), "cid")

    def compare(table: pa.Table) -> pa.Table:
        ids = table["cid"].to_numpy()
        sets_ = [x.values.to_numpy() for x in table["shingles"]]
        pairs = _links(ids, np.array([len(x) for x in sets_]), sets_, _sig_matrix(table["sig"]), _codes(table["label"]), *_sides(table), least, percent)
        u, v = zip(*pairs, strict=True) if pairs else ((), ())
        return pa.table({"u": pa.array(u, table["cid"].type), "v": pa.array(v, table["cid"].type)})

    rows = cut_lineage(rows)
    let_go(docs.sparkSession)
    full = _with_sets(docs, cut_lineage(_apart(rows, CELL_VALUES)), size).dropDuplicates(["k", "low", "high", "cid", "a", "b"])
    return full.groupBy("k", "low", "high").applyInArrow(compare, f"u {kind}, v {kind}")


def _links(ids, sizes, sets, sigs, labels, left, right, least, percent):
    """Confirmed links between rows of left and right that labels and earlier links don't imply."""
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for first, x in zip(np.unique(labels, return_index=True)[1][labels].tolist(), range(len(ids)), strict=True):
        root[x] = first
    out = []
    same = np.array_equal(left, right)
    for x in left.tolist():
        others = right[right > x] if same else right
        others = others[(100 * np.minimum(sizes[x], sizes[others]) >= percent * np.maximum(sizes[x], sizes[others]))]
        for y in others[(sigs[others] == sigs[x]).sum(1) >= least].tolist():
            if find(x) == find(y):
                continue
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if 100 * both >= percent * (sizes[x] + sizes[y] - both):
                root[find(x)] = find(y)
                out.append((ids[x], ids[y]))
    return out


def _with_sets(docs: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """rows (cid, a, b, ...) and the full set of each."""
    shared = docs.sparkSession.sparkContext.broadcast(sieve.bits(rows, F.xxhash64("cid")).tobytes())
    schema = schema_with(docs, "a long, b long, shingles array<long>")

    def sets(batches):
        for batch in small(batches):
            batch = batch.filter(pa.array(sieve.passes(shared.value, batch.column(2).to_numpy())))
            texts = text_column(batch)
            for i, j in slices(texts):
                values, first = shingle_sets(texts.slice(i, j - i), size)
                ab = np.frombuffer(b"".join(hashlib.blake2b(values[a:b], digest_size=16).digest() for a, b in zip(first, first[1:])), np.int64).reshape(-1, 2)
                sets_ = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(ab[:, 0].copy()), pa.array(ab[:, 1].copy()), sets_], names=schema.names)

    texts = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("at")).where(F.col("doc_id").isNotNull()).mapInArrow(sets, schema)
    return rows.join(texts.withColumnRenamed("doc_id", "cid"), ["cid", "a", "b"])


def _classes(marks: DataFrame) -> DataFrame:
    """Of each different set the row with the least id: a, b, cid, n, bands, sig."""
    classes = marks.where("n > 0 and doc_id is not null").groupBy("a", "b").agg(F.min(F.struct("doc_id", "n", "bands", "sig")).alias("r"))
    return classes.select("a", "b", F.col("r.doc_id").alias("cid"), "r.n", "r.bands", "r.sig")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per row of docs.

    Rows are linked when their sets of distinct `size`-word shingles (A-Z lower-cased) share at least `percent` of a hundred of their union; component_id is the
    smallest doc_id reachable over links, kept says whether it is the row's own. Null, empty and blank texts have empty sets and are linked with nothing;
    shorter texts are one shingle. Rows with one doc_id count as one node (repeated rows all share its component and kept). A row without
    an id takes the component of its equals, else null, and is kept only in the latter case. An empty table gives no rows.

    Equal sets are folded first. Minima in 26 bands of 4 give buckets, and of buckets with the same members one stays. Members meet the least one of their bucket, then
    whom they are not connected with yet; signatures go first, full sets decide. Links join into components by star contraction.
    """
    docs = id_and_text(docs)
    least = _least_matches(percent / 100)
    marks = cut_lineage(_marks(docs, size))
    reps = cut_lineage(_classes(marks))
    let_go(docs.sparkSession)
    links = _linked(docs, reps, size, least, percent)
    # rows with one id and different texts are one node
    again = marks.where("n > 0 and doc_id is not null").join(reps.select("a", "b", "cid"), ["a", "b"]).select("doc_id", "cid").distinct()
    twice = again.groupBy("doc_id").agg(F.count("*").alias("c"), F.min("cid").alias("cid")).where("c > 1")
    same = again.join(twice.select("doc_id", F.col("cid").alias("first")), "doc_id").where("cid != first").select(F.col("first").alias("u"), F.col("cid").alias("v"))
    found = components(links.union(same)).select(F.col("node").alias("cid"), "component")
    named = reps.select("a", "b", "cid").join(found, "cid", "left").select("a", "b", F.coalesce("component", "cid").alias("component"))
    out = marks.select("doc_id", "n", "a", "b").join(named, ["a", "b"], "left").withColumn("component", F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
                      F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, without those whose component has a smaller doc_id; rows without an id stay. Only rows to be dropped are shuffled."""
    gone = cut_lineage(near_duplicates(docs, size, percent).where("not kept and doc_id is not null").select("doc_id").distinct())
    clear, doubtful = sieve.split(docs, F.xxhash64("doc_id"), sieve.bits(gone, F.xxhash64("doc_id")))
    return clear.union(doubtful.join(gone, "doc_id", "left_anti").select(docs.columns))
