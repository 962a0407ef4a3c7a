"""Near-duplicate classes by weighted MinHash from hashed darts.

A document is the multiset of its 5-word shingles (words lower-cased in ASCII).  Every shingle
owns a region [0, count) x [0, rank limit) at which darts are thrown by hash: their ranks form a
Poisson process of rate 1 per unit of weight, so the darts inside a region do not depend on the
document.  With a rank limit of (darts wanted) / (total weight) a document sees about
k (ln k + 4) darts whatever its length; each dart names one of k coordinates, and the earliest
dart of each coordinate is the signature: two documents agree in a coordinate with probability
equal to their weighted Jaccard similarity.

Documents with equal words are collapsed first.  BANDS bands of ROWS coordinates make buckets, and
the members of a bucket are candidates.  They are compared in three steps, so that no pairs are
listed inside a bucket: everyone with the smallest member of its buckets; everyone in a bucket of
several classes with the best of some leaders; and, in buckets that still hold several classes, all
with all, in pairs of blocks that return stars.  A pair is a link if the weighted Jaccard similarity
of its shingle sets reaches ``threshold``; in the first two steps signatures that agree too little
(six standard errors below it) spare that test.  Classes are the connected components of the links,
found by alternating stars.

Defined cases: null and empty texts and texts of white space have no words and are copies of one
another; texts of 1 to 4 words are one shingle; rows with equal or null ids are documents of their
own; extra columns do not matter; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from lexispark.llm.common import byte_hashes, mix64, settle

BANDS, ROWS = 24, 5
COORDS = BANDS * ROWS
SHINGLE = 5
BLOCK = 512                           # see _clusters
CHOICE, MATCHES, PART = 64, 2, 2048   # see _best_matches
CHUNK_WORDS = 400_000   # words handled at once in a task; a longer text is a chunk of its own
_U = np.uint64


def row_key(text: Column) -> Column:
    """Tells rows with the same id but other texts apart."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def word_lists(texts: list[str | None]) -> list[list[bytes]]:
    return [(t or "").encode("utf-8", "replace").lower().split() for t in texts]


def shingle_sets(lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, shingle hash, count), sorted by document and hash."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    h = byte_hashes([w for x in lists for w in x])
    doc = np.repeat(np.arange(len(lists)), sizes)
    ends = np.cumsum(sizes)
    n = len(h)
    rolled = np.zeros(n, _U)
    first = ends - sizes
    at = np.arange(n) - np.repeat(first, sizes)
    left = np.repeat(sizes, sizes) - at                 # words from here to the end of the text
    for i in range(SHINGLE):
        nxt = np.zeros(n, _U)
        nxt[:max(0, n - i)] = h[i:]
        use = left > i                                  # short texts take the words they have
        rolled = np.where(use, mix64(rolled * _U(0x9E3779B97F4A7C15) + nxt + _U(i + 1)), rolled)
    starts = (left >= SHINGLE) | (at == 0)
    doc, rolled = doc[starts], rolled[starts]
    order = np.lexsort((rolled, doc))
    doc, rolled = doc[order], rolled[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (rolled[1:] != rolled[:-1])
    where = np.flatnonzero(new)
    return doc[where], rolled[where], np.diff(np.append(where, len(doc)))


def dart_signatures(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, n_docs: int,
                    coords: int = COORDS) -> np.ndarray:
    """n_docs x coords dart identities (uint32); documents without weight have zeros.
    Weights are any non-negative reals."""
    empty = _U(0xFFFFFFFFFFFFFFFF)
    best = np.full(n_docs * coords, empty)              # rank (as float32) and dart in one number
    total = np.bincount(doc, weight, n_docs)
    wanted = np.where(total > 0, coords * (np.log(coords) + 4.0), 0.0)
    todo = total > 0
    while todo.any():
        limit = np.where(todo, wanted / np.maximum(total, 1e-300), 0.0)
        mine = todo[doc]
        d, x, w = doc[mine], item[mine], weight[mine].astype(np.float64)
        columns = np.ceil(w).astype(np.int64)           # unit-wide columns of each region
        d, x, w = (np.repeat(v, columns) for v in (d, x, w))
        ends = np.cumsum(columns)
        column = np.arange(len(d)) - np.repeat(ends - columns, columns)
        seed = mix64(x ^ mix64(column.astype(_U) + _U(0x51ED2701)))
        share = w - column                              # how much of the column is inside
        whole = bool((share >= 1.0).all())
        rank, top, step = np.zeros(len(d)), limit[d], 0
        while len(d):                                   # next darts of every column still below
            some = 1 if step < 6 else 32                # few columns need many darts
            a = mix64(seed[:, None] + (np.arange(step + 1, step + some + 1, dtype=np.int64).astype(
                _U) * _U(0xD1342543DE82EF95))[None])
            gap = -np.log(((a >> _U(11)).astype(np.float64) + 0.5) * 2.0 ** -53)
            ranks = rank[:, None] + (np.cumsum(gap, axis=1) if some > 1 else gap)
            row, at = np.nonzero(ranks <= top[:, None])
            dart, r = a[row, at], ranks[row, at]
            if not whole:
                inside = ((mix64(dart + _U(0x9E3779B97F4A7C15)) >> _U(11)).astype(np.float64) + 0.5
                          ) * 2.0 ** -53 < share[row]
                row, dart, r = row[inside], dart[inside], r[inside]
            c = mix64(dart + _U(0x2545F4914F6CDD1D))
            key = d[row] * coords + ((c >> _U(32)) % _U(coords)).astype(np.int64)
            np.minimum.at(best, key, r.astype(np.float32).view(np.uint32).astype(_U) << _U(32)
                          | (c & _U(0xFFFFFFFF)))
            live = ranks[:, -1] <= top
            d, seed, rank, top, share = (v[live] for v in (d, seed, ranks[:, -1], top, share))
            step += some
        todo &= ~(best.reshape(n_docs, coords) != empty).all(1)
        wanted *= 2                                     # a coordinate without dart: throw further
    return np.where(best == empty, 0, best & _U(0xFFFFFFFF)).astype(np.uint32).reshape(
        n_docs, coords)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """documents x BANDS bucket keys."""
    s = signatures.reshape(len(signatures), BANDS, ROWS).astype(_U)
    key = np.broadcast_to(mix64(np.arange(BANDS, dtype=_U) + _U(77)), s.shape[:2]).copy()
    for i in range(ROWS):
        key = mix64(key * _U(0x9E3779B97F4A7C15) + s[:, :, i])
    return key.view(np.int64)


def _chunks(texts: list) -> list[tuple[int, int]]:
    out, start, size = [], 0, 0
    for i, t in enumerate(texts):
        n = len(t or "") // 5
        if i > start and size + n > CHUNK_WORDS:
            out.append((start, i))
            start, size = i, 0
        size += n
    return [*out, (start, len(texts))] if texts else out


def _sign(batches):
    for batch in batches:
        texts, sigs, bands, n, same = batch.column("text").to_pylist(), [], [], [], []
        for a, b in _chunks(texts):
            words = word_lists(texts[a:b])
            same += [xxh3_128_digest(b" ".join(x)) for x in words]
            doc, item, count = shingle_sets(words)
            s = dart_signatures(doc, item, count.astype(np.float64), b - a)
            sigs += [x.tobytes() for x in s]
            bands.append(band_keys(s))
            n.append(np.bincount(doc, count, b - a))
        keys = np.concatenate(bands) if bands else np.zeros((0, BANDS), np.int64)
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("raw"), pa.array(same, pa.binary()),
            pa.array(sigs, pa.binary()),
            pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * BANDS,
                                     pa.array(keys.reshape(-1))),
            pa.array(np.concatenate(n) if n else [], pa.float64())],
            names=["doc_id", "raw", "content", "sig", "bands", "weight"])


def compact(items: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A shingle set as sorted 32-bit hashes, a shingle of count c as c different hashes, and its
    size: two documents are sent to each other in this form.  Two of the shingles of a pair of
    20,000 words share a hash once in 10 such pairs, which moves a similarity by 1 in 20,000."""
    copies = np.repeat(items, counts)
    ends = np.cumsum(counts)
    nth = np.arange(len(copies)) - np.repeat(ends - counts, counts)
    h = (mix64(copies + nth.astype(_U) * _U(0x9E3779B97F4A7C15)) >> _U(32)).astype(np.uint32)
    return np.unique(h), np.array([len(copies)], np.int32)


def _shingle_rows(batches):
    for batch in batches:
        texts, h, c = batch.column("text").to_pylist(), [], []
        for a, b in _chunks(texts):
            doc, item, count = shingle_sets(word_lists(texts[a:b]))
            cut = np.searchsorted(doc, np.arange(b - a + 1))
            for i in range(b - a):
                x, k = compact(item[cut[i]:cut[i + 1]], count[cut[i]:cut[i + 1]])
                h.append(x.tobytes())
                c.append(k.tobytes())
        yield pa.RecordBatch.from_arrays([
            batch.column("node"), pa.array(h, pa.binary()), pa.array(c, pa.binary())],
            names=["node", "items", "counts"])


def _agreeing(least: float):
    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32)
                    .reshape(-1, COORDS) for c in ("sig_a", "sig_b"))
            keep = (x == y).mean(1) >= least if len(x) else np.zeros(0, bool)
            yield batch.select(["a", "b"]).filter(pa.array(keep))
    return run


def weighted_jaccard(a: np.ndarray, na: int, b: np.ndarray, nb: int) -> float:
    """Of two ``compact`` sets: the copies of a shingle that both have are its smaller count."""
    low = np.intersect1d(a, b, assume_unique=True).size
    return low / max(1, na + nb - low)


def _similar(threshold: float):
    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("ia", "ca", "ib", "cb")))
            keep = [weighted_jaccard(np.frombuffer(ia, np.uint32), int(np.frombuffer(ca, np.int32)[0]),
                                     np.frombuffer(ib, np.uint32), int(np.frombuffer(cb, np.int32)[0]))
                    >= threshold - 1e-12 for ia, ca, ib, cb in rows]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def forest(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Edges as a star to the smallest node of each of their components."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while len(a):
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays(
        [pa.array(nodes[label[far]], pa.int64()), pa.array(nodes[far], pa.int64())], names=["a", "b"])


def _forest(batches):
    got = [b for b in batches if b.num_rows]
    if got:
        yield forest(*(np.concatenate([x.column(c).to_numpy() for x in got]) for c in ("a", "b")))


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """node, root (smallest node of its component) for the end points of ``edges`` (a, b).

    Each partition first reduces its edges to stars; alternating large and small stars then join
    them, an aggregate and a join on a node each, until nothing changes.  After a given number of
    ``rounds`` a root may still be a node of the component that is not the smallest."""
    edges = settle(edges.select("a", "b").filter("a <> b")
                   .mapInArrow(_forest, "a bigint, b bigint").distinct(), "edges")
    mark, n = None, 0
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        big = (both.join(least, "u").filter("v > u").select(F.col("m").alias("a"),
                                                            F.col("v").alias("b"))
               .filter("a < b").distinct())
        low = big.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        small = (big.join(low, big.b == low.u).select(F.col("m"), F.explode(F.array("a", "u"))
                                                      .alias("v"))
                 .filter("m < v").select(F.col("m").alias("a"), F.col("v").alias("b")))
        n += 1
        if rounds is not None and n >= rounds:
            return settle(small.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "roots")
        edges = settle(small.distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        mark = now


def several(members: DataFrame) -> DataFrame:
    """Members (bucket, node, class) of the buckets that hold several classes, with the bucket's size
    n and its smallest node, first."""
    stats = members.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("class").alias("lo"), F.max("class").alias("hi"),
        F.min("node").alias("first")).filter("lo < hi").select("bucket", "n", "first")
    return members.select("bucket", "node", "class").join(stats, "bucket")


def _best_leaders(least: float):
    """Of a part of a bucket's members and its leaders: each member with the MATCHES leaders of
    other classes whose signatures agree best."""
    def run(members: pa.Table, leaders: pa.Table) -> pa.Table:
        if not members.num_rows or not leaders.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        table = lambda t: (t.column("node").to_numpy(), t.column("class").to_numpy(), np.frombuffer(
            b"".join(t.column("sig").to_pylist()), np.uint32).reshape(-1, COORDS))
        node, kind, sig = table(members)
        lead, lead_kind, lead_sig = table(leaders)
        agree = np.stack([(sig == x).mean(1) for x in lead_sig], axis=1)
        agree[(kind[:, None] == lead_kind) | (agree < least)] = -1
        best = np.argsort(-agree, axis=1, kind="stable")[:, :MATCHES]
        row, k = np.nonzero(np.take_along_axis(agree, best, 1) >= 0)
        a, b = node[row], lead[best[row, k]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})
    return run


def _best_matches(members: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """Candidate pairs (a, b) that join most classes of a bucket at once: its members meet CHOICE
    leaders, dealt by hash, in parts of PART members, and propose the best of them.  It leaves fewer
    classes for the blocks that compare everyone."""
    live = settle(several(members).withColumn(
        "parts", F.ceil(F.col("n") / PART).cast("int")).join(known, "node"), "matched")
    part = F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts")).cast("int")
    leaders = live.groupBy("bucket", F.pmod(F.xxhash64("node"), F.lit(CHOICE)).alias("s")).agg(
        F.min_by(F.struct("node", "class", "sig", "parts"), "node").alias("x")).select(
        "bucket", "x.*", F.explode(F.sequence(F.lit(0), F.col("x.parts") - 1)).alias("part"))
    return (live.select("bucket", part.alias("part"), "node", "class", "sig").groupBy("bucket", "part")
            .cogroup(leaders.select("bucket", "part", "node", "class", "sig").groupBy("bucket", "part"))
            .applyInArrow(_best_leaders(least), "a bigint, b bigint").distinct())


def _block_links(threshold: float):
    """Links between different classes of two blocks of a cluster, as stars.  All similarities of the
    two blocks are one product of their incidence matrices over the shingles that both have."""
    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        block, node = table.column("block").to_numpy(), table.column("node").to_numpy()
        kind = table.column("class").to_numpy()
        items, sizes = (table.column(c).to_pylist() for c in ("items", "counts"))

        def side(k):
            at = np.flatnonzero(block == k)
            sets = [np.frombuffer(items[x], np.uint32) for x in at]
            return (at, np.concatenate([np.zeros(0, np.uint32), *sets]),
                    np.repeat(np.arange(len(at)), [len(x) for x in sets]),
                    np.array([np.frombuffer(sizes[x], np.int32)[0] for x in at], np.float32))
        (x, xh, xr, xn), (y, yh, yr, yn) = side(i), side(j)
        shared, place = np.unique(np.concatenate([xh, yh]), return_inverse=True)
        xp, yp = place[:len(xh)], place[len(xh):]
        n = len(shared)
        nx, ny = np.bincount(xp, minlength=n), np.bincount(yp, minlength=n)
        useful = (nx > 1) if i == j else (nx > 0) & (ny > 0)
        number = np.cumsum(useful) - 1
        both = np.zeros((len(x), len(y)), np.float32)
        parts = []
        for p, r in ((xp, xr), (yp, yr)):
            keep = useful[p]
            col, r = number[p[keep]], r[keep]
            order = np.argsort(col, kind="stable")
            parts.append((col[order], r[order]))
        for c in range(0, int(useful.sum()), 4096):
            m = []
            for (col, r), rows in zip(parts, (len(x), len(y))):
                lo, hi = np.searchsorted(col, [c, c + 4096])
                part = np.zeros((rows, 4096), np.float32)
                part[r[lo:hi], col[lo:hi] - c] = 1
                m.append(part)
            both += m[0] @ m[1].T
        alike = both >= (threshold - 1e-6) * np.maximum(1, xn[:, None] + yn - both)
        u, v = np.nonzero(alike & (kind[x][:, None] != kind[y]))
        return pa.Table.from_batches([forest(node[x[u]], node[y[v]])])
    return run


def _clusters(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The links that are left, exactly: buckets of several classes that share members make a
    cluster, and all documents of a cluster meet in pairs of blocks of BLOCK documents.  A task
    holds two blocks and returns less than two blocks of links.  Comparisons and shuffled rows, one a
    document and block of its cluster, grow with the square of a group."""
    live = settle(several(members).select("node", "class", "first"), "rest")
    cluster = components(live.select(F.col("first").alias("a"), F.col("node").alias("b")))
    nodes = live.select("node", "class").distinct().join(cluster, "node", "left").select(
        "node", "class", F.coalesce("root", "node").alias("cluster"))
    nodes = settle(nodes, "clustered")
    size = nodes.groupBy(F.col("cluster").alias("k")).agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = nodes.join(size, F.col("cluster") == F.col("k")).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(
        F.least("block", x).alias("i"), F.greatest("block", x).alias("j")))
    met = dealt.join(sets, "node").withColumn("p", F.explode(pairs)).select(
        "cluster", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "block", "node", "class", "items",
        "counts")
    return met.groupBy("cluster", "i", "j").applyInArrow(_block_links(threshold), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, raw (row_key of its text), class_id (smallest doc_id of the class), kept (exactly one
    row a class) for every row of ``docs``."""
    rows_in = docs.select("doc_id", "text")
    kind = dict(rows_in.dtypes)["doc_id"]
    signed = settle(rows_in.withColumn("raw", row_key(F.col("text"))).mapInArrow(
        _sign, f"doc_id {kind}, raw binary, content binary, sig binary, bands array<bigint>, "
        "weight double").withColumn("uid", F.monotonically_increasing_id()), "signed")
    nodes = settle(signed.groupBy("content").agg(F.min("uid").alias("node")), "nodes")
    heads = signed.select("uid", "doc_id", "raw", "sig", "bands", "weight").join(
        nodes.select("node"), F.col("uid") == F.col("node")).drop("uid").filter("weight > 0")
    buckets = heads.select("node", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = settle(buckets.join(shared, "bucket")
                     .select("bucket", "node", F.col("node").alias("class"), "n"), "members")
    candidates = members.select("node").distinct()
    known = settle(heads.join(candidates, "node").select("node", "sig"), "candidates")
    places = heads.join(candidates, "node").select(
        "node", F.col("doc_id").alias("d"), "raw")
    texts = (rows_in.join(places, F.col("doc_id").eqNullSafe(F.col("d")))
             .filter(row_key(F.col("text")) == F.col("raw")).select("node", "text"))
    sets = settle(texts.mapInArrow(_shingle_rows, "node bigint, items binary, counts binary")
                  .dropDuplicates(["node"]), "shingles")
    error = (threshold * (1 - threshold) / COORDS) ** 0.5
    least = threshold - 6 * error

    def verified(pairs):
        return settle(pairs.join(sets.toDF("a", "ia", "ca"), "a").join(sets.toDF("b", "ib", "cb"), "b")
                      .mapInArrow(_similar(threshold), "a bigint, b bigint"), "links")

    def classed(rows):
        near = components(links, rounds=1)
        return settle(rows.drop("class").join(near, "node", "left").select(
            "bucket", "node", F.coalesce("root", "node").alias("class")), "members")

    # first everyone against the smallest node of its buckets, then against the best of some leaders
    led = several(members).filter("node <> first").select(
        F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    links = verified(settle(led.join(known.toDF("a", "sig_a"), "a").join(known.toDF("b", "sig_b"), "b")
                            .mapInArrow(_agreeing(least), "a bigint, b bigint"), "close"))
    members = classed(members.filter("n > 2"))
    links = links.union(verified(settle(_best_matches(members, known, least), "close")))
    members = classed(members)
    links = links.union(settle(_clusters(members, sets, threshold), "links"))
    classes = nodes.join(components(links), "node", "left").withColumn(
        "class", F.coalesce("root", "node"))
    rows = signed.select("uid", "doc_id", "raw", "content").join(
        classes.select(F.col("content").alias("c"), "class"), F.col("content") == F.col("c"))
    rows = settle(rows.select("uid", "doc_id", "raw", "class"), "rows")
    least = rows.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    stay = (rows.join(least, "class").filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
            .groupBy("class").agg(F.min("uid").alias("stays")))
    return (rows.join(least, "class").join(stay, "class")
            .select("doc_id", "raw", "class_id",
                    (F.col("uid") == F.col("stays")).alias("kept")))


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row of each class (smallest doc_id), with all columns of ``docs``."""
    names = docs.columns
    stay = near_duplicates(docs, threshold).filter("kept").select(
        F.col("doc_id").alias("__d"), F.col("raw").alias("__r"))
    packed = docs.select(F.struct(*names).alias("__row"), F.col("doc_id").alias("__doc"),
                         row_key(F.col("text")).alias("__raw"))
    return (packed.join(stay, F.col("__doc").eqNullSafe(F.col("__d"))
                        & (F.col("__raw") == F.col("__r")), "left_semi")
            .dropDuplicates(["__doc", "__raw"]).select("__row.*"))
