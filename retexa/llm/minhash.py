"""Operator 8, near-duplicates: fast similarity sketching, banding, verification.

A document is the set of its word 3-grams (lower-cased words; a document of one
or two words is one shingle). The sketch has BINS coordinates. Round i hashes
every shingle to a bin with value i + u; in rounds 0..BINS-1 the bin is random,
in rounds BINS..2*BINS-1 it is bin i - BINS, so every coordinate fills, and
coordinates agree with probability equal to the Jaccard similarity, with
concentration as for independent coordinates. A document leaves as soon as all
its bins are full: later rounds only bring larger values.

Texts with the same words in the same order are one text from here on. Sketches
are cut into bands of ROWS coordinates, and texts that share a band are
candidates. In every bucket each text is verified exactly against one leader, the
text of least digest, so near copies cost one check each, however many they are:
two that match the leader are connected already.

What fails its leader may still be near another member. The texts of buckets that
the links so far leave in several components form a pool, in which pairs of
different components are found without the bucket: if two sets reach the
threshold t they share one of the first n - ceil(t n) + 1 shingles of the larger
and one of the first n - ceil(2t / (1 + t) n) + 1 of the smaller, in any common
order. The order puts shingles that many pool texts hold last, so a passage that
thousands share brings nobody together, and only what can reach t is verified,
exactly. So the components are at least those of verifying all pairs of all
buckets, and neither near copies nor a shared passage cost the square of their
number.

Chance that a pair of Jaccard s shares no band: (1 - s^ROWS)^(BINS / ROWS), that
is 5 % at 0.5, 0.4 % at 0.6.

Defined results: documents without words (null or empty texts) and rows with a
null doc_id are in no group and are kept; rows that share a doc_id are one
document, linked by what any of their texts matches, in whatever order they come;
texts are read whole however long; the least doc_id of a group stays; an empty
table gives an empty result; other columns aren't carried by near_duplicates,
whatever their names, and are carried unchanged by keep_first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retexa.llm import textkit as K
from retexa.llm.components import components
from retexa.session import discard, store, store_with

U = np.uint64
BINS, ROWS, THRESHOLD = 184, 4, 0.5
#: Ids sent to every executor at most; beyond it the join shuffles.
BROADCAST_IDS = 1_000_000
#: Texts of the pool that hold a shingle for it to count as common; shingles of a verification block.
COMMON, CELLS = 8, 1 << 18
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], U)


def shingles(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of each distinct shingle, rows ascending; two digests of every row's words."""
    starts, ends, row = K.words(b, offs)
    n = len(offs) - 1
    h = K.span_hash(K.prefix_sums(b), starts, ends)
    count = np.bincount(row, minlength=n)
    place = np.arange(len(h)) - np.repeat(np.cumsum(count) - count, count)
    digests = []
    for salt in (1, 2):
        part = np.zeros(len(h) + 1, U)
        np.cumsum(K.mix(h ^ K.mix((place + 1).astype(U) * U(salt * 2 - 1) + U(salt << 40))), out=part[1:])
        stop = np.cumsum(count)
        digests.append(K.mix(part[stop] - part[stop - count] + count.astype(U)))
    if len(h) > 2:
        tri = np.flatnonzero(row[2:] == row[:-2])
        g = K.mix(h[tri] * _ODD[0] + h[tri + 1] * _ODD[1] + h[tri + 2] * _ODD[2])
    else:
        tri, g = np.zeros(0, np.int64), np.zeros(0, U)
    short = np.flatnonzero((count > 0) & (count < 3))
    rows, g = np.concatenate([row[tri], short]), np.concatenate([g, digests[0][short]])
    order = np.lexsort((g, rows))
    rows, g = rows[order], g[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (g[1:] != g[:-1])
    return rows[new], g[new], digests[0], digests[1]


def sketch(rows: np.ndarray, g: np.ndarray, n: int, bins: int = BINS) -> np.ndarray:
    """n x bins sketches; rows without shingles keep the largest value everywhere."""
    full = np.full(n * bins, np.iinfo(np.uint64).max, U)
    rows = rows.astype(np.int64)
    for i in range(2 * bins):
        x = K.mix(g ^ K.mix(np.array([i + 1], U)))
        at = ((x >> U(32)) * U(bins) >> U(32)).astype(np.int64) if i < bins else i - bins
        value = (K.mix(x) >> U(10)) | U(i << 54)
        np.minimum.at(full, rows * bins + at, value)
        open_ = (full.reshape(n, bins) == np.iinfo(np.uint64).max).any(axis=1)
        live = open_[rows]
        if not live.any():
            break
        if not live.all():
            rows, g = rows[live], g[live]
    return full.reshape(n, bins)


def bands(s: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, bins = s.shape
    part = s.reshape(n, bins // rows, rows)
    key = np.zeros(part.shape[:2], U)
    for k in range(rows):
        key = K.mix(key * U(0x9E3779B97F4A7C15) + part[:, :, k])
    return K.mix(key + np.arange(bins // rows, dtype=U)).view(np.int64)


def _low(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    low = K.text_column(batch["text"], lower=True)
    for i, j in K.blocks(low):
        yield i, j, *K.buffers(low.slice(i, j - i))


def _sketches(key: Callable[[np.ndarray], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, b, offs in _low(batch):
                rows, g, d1, d2 = shingles(b, offs)
                has = np.flatnonzero(np.bincount(rows, minlength=j - i))
                keys = key(sketch(rows, g, j - i))[has]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
                digests = (pa.array(d[has].view(np.int64)) for d in (d1, d2))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i).take(pa.array(has)), *digests, flat], ["doc_id", "d1", "d2", "keys"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, b, offs in _low(batch):
            rows, g, d1, _ = shingles(b, offs)
            offsets = np.searchsorted(rows, np.arange(j - i + 1)).astype(np.int32)
            cols = [batch["doc_id"].slice(i, j - i), pa.array(d1.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(g.view(np.int64)))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "d", "grams"])


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact Jaccard similarity of two sets a row."""
    for batch in batches:
        a, b = batch["grams_a"], batch["grams_b"]
        both = []
        for x in (a, b):
            offs = x.offsets.to_numpy()
            both.append((x.values.to_numpy()[offs[0] : offs[-1]], np.diff(offs)))
        stops = [np.concatenate([[0], np.cumsum(n)]) for _, n in both]
        out = np.zeros(len(batch))
        lo = 0
        while lo < len(batch):  # about CELLS shingles at once
            hi = max(lo + 1, int(np.searchsorted(stops[0] + stops[1], stops[0][lo] + stops[1][lo] + CELLS, "right")) - 1)
            cut = [slice(int(c[lo]), int(c[hi])) for c in stops]
            row = np.concatenate([np.repeat(np.arange(hi - lo), n[lo:hi]) for _, n in both])
            val = np.concatenate([v[c] for (v, _), c in zip(both, cut)])
            order = np.lexsort((val, row))
            row, val = row[order], val[order]
            same = np.bincount(row[1:][(row[1:] == row[:-1]) & (val[1:] == val[:-1])], minlength=hi - lo)
            out[lo:hi] = same / np.maximum(both[0][1][lo:hi] + both[1][1][lo:hi] - same, 1)
            lo = hi
        names = ["a", "ad", "b", "bd"]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(out)], [*names, "jaccard"])


PAIR = ("a", "ad", "b", "bd")


def _pairs(rows: DataFrame, x: tuple[str, str], y: tuple[str, str]) -> DataFrame:
    """Distinct unordered pairs of texts (a, ad, b, bd), each a carrier's doc_id and a digest."""
    side = lambda c: F.struct(F.col(c[0]).alias("id"), F.col(c[1]).alias("d"))
    both = rows.select(F.greatest(side(x), side(y)).alias("p"), F.least(side(x), side(y)).alias("q"))
    return both.select(F.col("p.id").alias("a"), F.col("p.d").alias("ad"), F.col("q.id").alias("b"), F.col("q.d").alias("bd")).distinct()


def sets_of(docs: DataFrame, nodes: DataFrame, n: int) -> tuple[DataFrame, str]:
    """Stored shingle sets (id, d, grams) of the n texts in nodes (id, d), one row each.
    Texts are reread; the ids are broadcast only while they are few."""
    few = n <= BROADCAST_IDS
    ids = nodes.select(F.col("id").alias("doc_id")).distinct()
    sets = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").mapInArrow(_sets, "id bigint, d bigint, grams array<bigint>")
    # a doc_id may have other texts, and rows of the same text
    return store(sets.join(F.broadcast(nodes) if few else nodes, ["id", "d"], "left_semi").dropDuplicates(["id", "d"]), "sets")


def verify(sets: DataFrame, pairs: DataFrame) -> tuple[DataFrame, str]:
    """Exact Jaccard similarity of the pairs, stored."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("d").alias(f"{c}d"), F.col("grams").alias(f"grams_{c}"))
    joined = pairs.select(*PAIR).join(side("a"), ["a", "ad"]).join(side("b"), ["b", "bd"])
    done = joined.select(*PAIR, "grams_a", "grams_b").mapInArrow(_overlap, "a bigint, ad bigint, b bigint, bd bigint, jaccard double")
    return store(done, "verified")


def _prefixes(pool: DataFrame, threshold: float) -> DataFrame:
    """(id, d, root, n, g, k): the k-th shingles, up to those that two sets which reach
    the threshold must share. Shingles that COMMON texts of the pool or more hold come
    last, the most common at the end."""
    posts = pool.select("id", "d", "root", F.size("grams").alias("n"), F.explode("grams").alias("g"))
    common = posts.groupBy("g").count().where(F.col("count") >= COMMON).select("g", F.col("count").alias("df"))
    ordered = posts.join(common, "g", "left").groupBy("id", "d", "root", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "g"))).alias("s"))
    keep = (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int")
    return ordered.select("id", "d", "root", "n", F.posexplode(F.slice("s", F.lit(1), keep)).alias("k", "p")).select("id", "d", "root", "n", "p.g", (F.col("k") + 1).alias("k"))


def _across(posts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (x, xd, y, yd) of different roots that meet in a prefix and can reach the threshold.
    Roots are paired first, so texts of one root never meet."""
    roots = posts.select("g", "root").distinct()
    several = roots.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("g")
    roots = roots.join(several, "g", "left_semi")
    cross = roots.withColumnRenamed("root", "r1").join(roots.withColumnRenamed("root", "r2"), "g").where("r1 <> r2")
    share = threshold / (1 + threshold)
    short = F.col("k") <= F.col("n") - F.ceil(F.col("n") * 2 * share - 1e-9) + 1
    x = posts.where(short).select("g", F.col("root").alias("r1"), F.col("id").alias("x"), F.col("d").alias("xd"), F.col("n").alias("xn"), F.col("k").alias("xk"))
    y = posts.select("g", F.col("root").alias("r2"), F.col("id").alias("y"), F.col("d").alias("yd"), F.col("n").alias("yn"), F.col("k").alias("yk"))
    size = (F.col("xn") <= F.col("yn")) & (F.col("xn") >= F.col("yn") * threshold - 1e-9)
    most = F.least("xk", "yk") + F.least(F.col("xn") - F.col("xk"), F.col("yn") - F.col("yk"))
    return cross.join(x, ["g", "r1"]).join(y, ["g", "r2"]).where(size & (most >= (F.col("xn") + F.col("yn")) * share - 1e-9)).select("x", "xd", "y", "yd")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, key: Callable[[np.ndarray], np.ndarray] = bands) -> DataFrame:
    """(doc_id, group_id, copy_of, links, keep) for every document in a group of two
    or more. group_id is the group's least doc_id, the one to keep; copy_of is the
    least doc_id with the same words; links counts the verified pairs of its text. ``key``
    gives the bands of an array of sketches."""
    spark = docs.sparkSession
    K.small_batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("bigint"), "text").where("doc_id is not null")
    seen, p1 = store(base.mapInArrow(_sketches(key), "doc_id bigint, d1 bigint, d2 bigint, keys array<bigint>"), "sketches")
    texts, p2 = store(seen.groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys")), "texts")
    own, p3 = store(seen.select("doc_id", "d1", "d2").distinct().join(texts.select("d1", "d2", "id"), ["d1", "d2"]).select("doc_id", "id"), "copies")
    discard(spark, p1)
    copies = own.where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    # a band's leader and whether it has company; aggregated before the shuffle, so a hot band is no hot task
    members = texts.select(F.col("d1").alias("d"), F.explode("keys").alias("band"))
    leads = members.groupBy("band").agg(F.min("d").alias("lead"), F.max("d").alias("last")).where("lead <> last").select("band", "lead")
    buckets, p4 = store(members.join(leads, "band"), "buckets")
    name = texts.select("id", F.col("d1").alias("d"))
    side = lambda c: name.select(F.col("d").alias(c), F.col("id").alias(f"{c}_id"))
    led = buckets.where("d <> lead").select("d", "lead").distinct().join(side("d"), "d").join(side("lead"), "lead")
    first, p5 = store(_pairs(led, ("d_id", "d"), ("lead_id", "lead")), "pairs")
    ends = F.array(F.struct(F.col("a").alias("id"), F.col("ad").alias("d")), F.struct(F.col("b").alias("id"), F.col("bd").alias("d")))
    nodes, p6, size = store_with(first.select(F.explode(ends).alias("n")).select("n.*").distinct(), "nodes")
    sets, p7 = sets_of(base, nodes, size["n"])
    checked, p8 = verify(sets, first)
    close = checked.where(F.col("jaccard") >= threshold).select("a", "b")
    group, p9 = components(copies.unionByName(close))
    # buckets that are still in several components
    rooted = nodes.join(group, "id", "left").select("id", "d", F.coalesce("root", "id").alias("root"))
    inside, p10 = store(buckets.select("band", "d").join(rooted, "d"), "inside")
    apart = inside.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band")
    pool, p11, size = store_with(inside.join(apart, "band", "left_semi").select("id", "d", "root").distinct(), "pool")
    paths = [p2, p3, p4, p5, p6, p7, p8, p9, p10, p11]
    if size["n"]:
        posts, p12 = store(_prefixes(sets.join(pool, ["id", "d"]), threshold), "prefixes")
        second, p13 = store(_pairs(_across(posts, threshold), ("x", "xd"), ("y", "yd")).join(first, list(PAIR), "left_anti"), "pairs")
        again, p14 = verify(sets, second)
        more = again.where(F.col("jaccard") >= threshold).select("a", "b")
        group, p15 = components(group.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(more))
        close, paths = close.unionByName(more), [*paths, p12, p13, p14, p15]
    degree = close.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    least = own.groupBy("doc_id").agg(F.min("id").alias("copy_of"))
    named = least.join(degree, F.col("copy_of") == F.col("id"), "left").select("doc_id", "copy_of", F.coalesce("links", F.lit(0)).alias("links"))
    out, _ = store(group.select(F.col("id").alias("doc_id"), F.col("root").alias("group_id")).join(named, "doc_id"), "groups")
    discard(spark, *paths)
    return out.select("doc_id", "group_id", "copy_of", "links", (F.col("doc_id") == F.col("group_id")).alias("keep"))


def keep_first(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each group of near-duplicates. Rows of one doc_id
    that were repeated stay repeated unless their document goes."""
    gone, _, size = store_with(near_duplicates(docs, threshold).where(~F.col("keep")).select("doc_id"), "gone")
    few = size["n"] <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)
