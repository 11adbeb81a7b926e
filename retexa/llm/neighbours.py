"""Operator 5, approximate nearest neighbours with rotated one-bit codes.

A query asks for its k nearest other rows by cosine; every row answers. Rows are
assigned to the nearest of about sqrt(n) / 8 centres of their dimension
(spherical k-means over all rows); a query visits its nearest cells. How many it
needs is measured: SAMPLE queries, in the order of a hash, are answered exactly
over all rows, and the least number of cells that holds TARGET of their
neighbours is used for every query of the dimension.

Rows are held as packed codes of PACKED bits a coordinate with a correction, so
a visit moves about a tenth of the vectors' bytes. It is a tile: at most about
SLAB members of a cell and at most about CHUNK queries, estimated from packed
bits alone. A first pass takes each query's 2k best estimates; only these
vectors are fetched, and the k-th best exact value is the query's floor. A
second pass finds all rows whose upper error bound reaches the floor; those
vectors are fetched and ranked exactly.

Defined results: (vec_id, rank, neighbour_id, similarity), ties in the order of
neighbour_id; fewer than k rows where there are fewer others of the dimension.
Vectors that are null, empty, zero or hold nulls or non-finite numbers, and null
ids, neither ask nor answer; rows that share a vec_id are one, and the one of
least hash counts; each dimension is searched by itself; an empty table gives an
empty result. Other columns aren't carried, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from retexa.llm import codes as C
from retexa.session import discard, store

NEIGHBOURS, SIGMAS, PACKED = 10, 2.5, 2
SAMPLE, TARGET, ROUNDS = 256, 0.96, 3
SLAB, CHUNK = 16384, 4096
#: Pairs of a query and a row sent to every executor at most; beyond it the join shuffles.
BROADCAST_PAIRS = 1_000_000
RESULT = "vec_id bigint, rank int, neighbour_id bigint, similarity double"


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32)), pa.array(np.ascontiguousarray(x).ravel(), kind))


def _units(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and unit vectors by dimension."""
    if not len(table):
        return {}
    ids = table["id"].to_numpy()
    return {x.shape[1]: (ids[rows], x) for rows, x in C.matrices(table["embedding"].combine_chunks())}


def _first(rows: DataFrame, seed: int, most: dict[int, int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The first rows of each dimension in the order of a hash, as many as ``most`` says; bounded by it."""
    limit = F.coalesce(*(F.when(F.col("dim") == d, k) for d, k in most.items()), F.lit(0))
    place = F.row_number().over(W.partitionBy("dim").orderBy(F.xxhash64(F.lit(seed), "id"), "id"))
    top = rows.withColumn("place", place).where((F.col("place") <= max(most.values())) & (F.col("place") <= limit))
    return _units(top.select("id", "embedding").toArrow())


def centres(vectors: DataFrame, sizes: dict[int, int], seed: int) -> dict[int, np.ndarray]:
    """Spherical k-means by dimension; a partition sends one sum a centre that it holds rows of."""
    now = {d: x for d, (_, x) in _first(vectors, seed, {d: max(1, round(math.sqrt(n) / 8)) for d, n in sizes.items()}).items()}
    for _ in range(ROUNDS if any(len(x) > 1 for x in now.values()) else 0):
        here = now

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {d: np.zeros(x.shape) for d, x in here.items()}
            for batch in batches:
                for rows, x in C.matrices(batch["embedding"]):
                    np.add.at(total[x.shape[1]], (x @ here[x.shape[1]].T).argmax(axis=1), x)
            for d, t in total.items():
                used = np.flatnonzero(np.abs(t).sum(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), d, np.int32)), pa.array(used), _lists(t[used], pa.float64())], ["dim", "cell", "total"])

        parts = vectors.mapInArrow(run, "dim int, cell bigint, total array<double>")
        sums = parts.select("dim", "cell", F.posexplode("total").alias("i", "x")).groupBy("dim", "cell", "i").agg(F.sum("x").alias("x")).toArrow()
        dim, cell, i, x = (sums[c].to_numpy() for c in ("dim", "cell", "i", "x"))
        now = {}
        for d, old in here.items():
            own = dim == d
            fresh = old.astype(np.float64)
            fresh[np.unique(cell[own])] = 0
            fresh[cell[own], i[own]] = x[own]
            norm = np.linalg.norm(fresh, axis=1, keepdims=True)
            now[d] = np.where(norm > 1e-9, fresh / np.maximum(norm, 1e-9), old).astype(np.float32)
    return now


def probes(vectors: DataFrame, asked: DataFrame, mid: dict[int, np.ndarray], k: int, seed: int, sample: int, target: float) -> dict[int, int]:
    """Cells to visit by dimension, so that the sample's exact neighbours are found to the target share."""
    many = {d: sample for d, x in mid.items() if len(x) > 1}
    visits = {d: 1 for d in mid}
    if not many:
        return visits
    some = _first(asked, seed + 1, many)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in C.matrices(batch["embedding"]):
                if (d := x.shape[1]) not in some:
                    continue
                ids, q = some[d]
                other = batch["id"].to_numpy()[rows]
                sim = q @ x.T
                sim[ids[:, None] == other[None, :]] = -np.inf
                m = min(k, len(x))
                top = np.argpartition(-sim, m - 1, axis=1)[:, :m]
                cell = (x @ mid[d].T).argmax(axis=1)
                row = np.repeat(np.arange(len(q)), m)
                cols = [np.full(len(row), d, np.int32), row, other[top.ravel()], np.take_along_axis(sim, top, 1).ravel().astype(np.float64), cell[top.ravel()]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["dim", "q", "id", "sim", "cell"])

    best = F.row_number().over(W.partitionBy("dim", "q").orderBy(F.desc("sim"), "id"))
    got = vectors.mapInArrow(run, "dim int, q bigint, id bigint, sim double, cell bigint").where("sim > -2").withColumn("place", best).where(F.col("place") <= k)
    got = got.select("dim", "q", "cell").toArrow()  # sample * k rows a dimension
    dim, q, cell = (got[c].to_numpy() for c in ("dim", "q", "cell"))
    for d in some:
        own = dim == d
        place = np.argsort(np.argsort(-(some[d][1] @ mid[d].T), axis=1, kind="stable"), axis=1)
        if own.any():
            share = np.cumsum(np.bincount(place[q[own], cell[own]], minlength=len(mid[d]))) / own.sum()
            visits[d] = min(len(mid[d]), int(np.searchsorted(share, target - 1e-12) + 1))
    return visits


def _tile(k: int, seed: int, sigmas: float, second: bool):
    """Estimates of a tile: each query's 2k best, or all that may reach its floor."""

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not len(asked) or not len(held):
            return pa.table({"q": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "est": pa.array([], pa.float32())})
        asked, held = asked.combine_chunks().to_batches()[0], held.combine_chunks().to_batches()[0]
        ids, other = asked["id"].to_numpy(), held["id"].to_numpy()
        bits = C.bits_for(held["dim"][0].as_py(), PACKED)
        code, fix = C.from_bytes(held["code"], bits // 8), held["fix"].to_numpy()
        plane, low, step = C.from_bytes(asked["plane"], C.PLANES * bits // 8), asked["low"].to_numpy(), asked["step"].to_numpy()
        floor = asked["floor"].to_numpy() if second else None
        rows = []
        for lo in range(0, len(ids), 256):
            mine = slice(lo, lo + 256)
            est = C.inner(code, fix, plane[mine], low[mine], step[mine], bits)
            est[ids[mine][:, None] == other[None, :]] = -np.inf
            if second:
                reach = est + np.float32(sigmas) * C.slack(fix[None, :], step[mine][:, None], np.clip(floor[mine], 0, 1)[:, None].astype(np.float32), bits)
                i, j = np.nonzero(reach >= floor[mine][:, None])
            else:
                m = min(2 * k, est.shape[1])
                j = np.argpartition(-est, m - 1, axis=1)[:, :m].ravel()
                i = np.repeat(np.arange(len(est)), m)
                i, j = i[est[i, j] > -np.inf], j[est[i, j] > -np.inf]
            rows.append((ids[mine][i], other[j], est[i, j]))
        a, b, c = (np.concatenate(z) for z in zip(*rows))
        return pa.table({"q": pa.array(a, pa.int64()), "id": pa.array(b, pa.int64()), "est": pa.array(c, pa.float32())})

    return run


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.zeros(len(batch))
        left = {x.shape[1]: (rows, x) for rows, x in C.matrices(batch["own"])}
        for rows, y in C.matrices(batch["other"]):
            mine, x = left[y.shape[1]]
            out[rows] = np.einsum("ij,ij->i", x[np.searchsorted(mine, rows)], y)
        yield pa.RecordBatch.from_arrays([batch["q"], batch["id"], pa.array(out)], ["q", "id", "sim"])


def exact(pairs: DataFrame, asked: DataFrame, vectors: DataFrame, n: int) -> DataFrame:
    """(q, id, sim) of n pairs; vectors are fetched for these only, and stay where they are while the pairs are few."""
    queries = asked.select(F.col("id").alias("q"), F.col("embedding").alias("own"))
    both = pairs.select("q", "id").join(queries, "q")
    rows = vectors.select("id", F.col("embedding").alias("other"))
    if n <= BROADCAST_PAIRS:
        few = pairs.select("q", "id")
        both = rows.join(F.broadcast(few), "id").join(queries, "q")
    else:
        both = both.join(rows, "id")
    return both.select("q", "id", "own", "other").mapInArrow(_products, "q bigint, id bigint, sim double")


def nearest(embeddings: DataFrame, k: int = NEIGHBOURS, queries: Column | None = None, seed: int = 5, sample: int = SAMPLE, target: float = TARGET, sigmas: float = SIGMAS) -> DataFrame:
    """(vec_id, rank, neighbour_id, similarity) for the rows of which ``queries``, a
    condition on vec_id, holds, or for every row, against all rows."""
    spark = embeddings.sparkSession
    asks = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    rows = rows.where("vec_id is not null and " + C.SANE)
    one = rows.groupBy("vec_id").agg(F.min(F.struct(F.xxhash64("embedding").alias("h"), "embedding")).alias("x"), F.first(asks).alias("asks"))
    vectors, p1 = store(one.select(F.col("vec_id").alias("id"), F.size("x.embedding").alias("dim"), "x.embedding", "asks"), "vectors")
    sizes = {r["dim"]: r["count"] for r in vectors.groupBy("dim").count().collect()}
    asked, p2 = store(vectors.where("asks").drop("asks"), "queries")
    if not sizes or not asked.count():
        discard(spark, p1, p2)
        return spark.createDataFrame([], RESULT)
    mid = centres(vectors, sizes, seed)
    visits = probes(vectors, asked, mid, k, seed, sample, target)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in C.matrices(batch["embedding"]):
                d = x.shape[1]
                bits = C.bits_for(d, PACKED)
                on, fix = C.encode(x, bits, seed)
                cols = [batch["id"].take(pa.array(at)), pa.array(np.full(len(x), d, np.int32)), pa.array((x @ mid[d].T).argmax(axis=1).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*cols, C.bytes_column(np.packbits(on, axis=1)), pa.array(fix.astype(np.float32))], ["id", "dim", "cell", "code", "fix"])

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in C.matrices(batch["embedding"]):
                d = x.shape[1]
                near = np.argsort(-(x @ mid[d].T), axis=1, kind="stable")[:, : visits[d]]
                plane, low, step = C.planes(C.turned(x, C.bits_for(d, PACKED), seed), seed)
                cols = [batch["id"].take(pa.array(at)), pa.array(np.full(len(x), d, np.int32)), _lists(near, pa.int32()), C.bytes_column(plane), pa.array(low), pa.array(step)]
                yield pa.RecordBatch.from_arrays(cols, ["id", "dim", "near", "plane", "low", "step"])

    held, p3 = store(vectors.mapInArrow(assign, "id bigint, dim int, cell int, code binary, fix float"), "codes")
    ask, p4 = store(asked.mapInArrow(turn, "id bigint, dim int, near array<int>, plane binary, low float, step float"), "planes")
    # cells number about sqrt(n) / 8, and so do these counts
    members = {(r["dim"], r["cell"]): r["count"] for r in held.groupBy("dim", "cell").count().collect()}
    guests = {(r["dim"], r["cell"]): r["count"] for r in ask.select("dim", F.explode("near").alias("cell")).groupBy("dim", "cell").count().collect()}
    shape = [(*c, -(-members[c] // SLAB), -(-n // CHUNK)) for c, n in guests.items() if c in members]
    shapes = F.broadcast(spark.createDataFrame(shape, "dim int, cell int, slabs int, chunks int"))
    part = lambda size, salt: F.pmod(F.xxhash64(F.lit(salt), "id"), F.col(size)).cast("int")
    tiles = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    group = ["dim", "cell", "slab", "chunk"]

    def passed(who: DataFrame, *more: str) -> DataFrame:
        own = who.select("id", "dim", "plane", "low", "step", *more, F.explode("near").alias("cell")).join(shapes, ["dim", "cell"])
        own = own.withColumn("chunk", part("chunks", 1)).withColumn("slab", tiles("slabs")).select(*group, "id", "plane", "low", "step", *more)
        theirs = held.join(shapes, ["dim", "cell"]).withColumn("slab", part("slabs", 2)).withColumn("chunk", tiles("chunks")).select(*group, "id", "code", "fix")
        run = _tile(k, seed, sigmas, bool(more))
        return own.groupBy(*group).cogroup(theirs.toDF(*group, "id", "code", "fix").groupBy(*group)).applyInArrow(run, "q bigint, id bigint, est float")

    order = F.row_number().over(W.partitionBy("q").orderBy(F.desc("est"), "id"))
    seeds, p5 = store(passed(ask).withColumn("place", order).where(F.col("place") <= 2 * k).select("q", "id"), "seeds")
    known, p6 = store(exact(seeds, asked, vectors, seeds.count()), "known")
    kth = F.row_number().over(W.partitionBy("q").orderBy(F.desc("sim"), "id"))
    floor = known.withColumn("place", kth).where(F.col("place") == k).select(F.col("q").alias("id"), F.col("sim").alias("floor"))
    # a query with fewer than k seeds has seen all the rows it visits
    reach, p7 = store(passed(ask.join(floor, "id").withColumn("floor", F.col("floor").cast("float")), "floor").select("q", "id").join(seeds, ["q", "id"], "left_anti"), "survivors")
    more = exact(reach, asked, vectors, reach.count())
    ranked = known.unionByName(more).withColumn("rank", kth).where(F.col("rank") <= k)
    out, _ = store(ranked.select(F.col("q").alias("vec_id"), "rank", F.col("id").alias("neighbour_id"), F.col("sim").alias("similarity")), "neighbours")
    discard(spark, p1, p2, p3, p4, p5, p6, p7)
    return out
