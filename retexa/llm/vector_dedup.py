"""Operator 2, near-duplicate embeddings: rotated binary codes with error bounds.

Every vector is rotated once. It keeps its code of signs with the correction, and
its projections rounded to a few bits (see codes), which are a tenth and under
half of its bytes. Bands of code bits bring candidates together: with n vectors a
band has about log2(n) - 2 bits, and there are as many bands as make a pair at
the threshold meet with probability RECALL. Within a bucket every member is held
against one leader, the member of least hash; what the links so far leave in
several components is held against the members of the other components. So near
copies, however many, cost one check each.

A check estimates the inner product from one vector's code and the other's
rounded projections, by population counts. The confidence bounds decide: a pair
is accepted if the lower bound reaches the threshold, rejected if the upper one
doesn't, and else computed exactly; full vectors are fetched for these only.

Defined results: (vec_id, group_id, links, keep) for every vector in a group of
two or more; group_id is the group's least vec_id, the one to keep; links counts
the pairs found with other vectors. Vectors that are null, empty, zero or hold
nulls or non-finite numbers are in no group, nor are rows with a null vec_id;
vectors of different dimensions never match; equal vectors are collapsed first;
rows that share a vec_id are one vector, linked by what any of them matches; an
empty table gives an empty result. Other columns aren't carried, whatever their
names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retexa.llm import codes as C
from retexa.llm import textkit as K
from retexa.llm.components import components
from retexa.session import discard, store

U = np.uint64
THRESHOLD, RECALL, SIGMAS, PACKED = 0.9, 0.97, 3.5, 2
CODES = "id bigint, h bigint, code binary, fix float, plane binary, low float, step float, keys array<bigint>"


def plan(n: int, threshold: float) -> tuple[int, int]:
    """Bits of a band and number of bands for n vectors."""
    width = max(8, math.ceil(math.log2(max(n, 2))) - 2)
    meet = (1 - math.acos(min(threshold, 1.0)) / math.pi) ** width
    return width, max(1, math.ceil(math.log(1 - RECALL) / math.log1p(-min(meet, 1 - 1e-9))))


def _coded(width: int, bands: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in C.matrices(batch["embedding"]):
                bits = C.bits_for(x.shape[1], max(PACKED, -(-width // x.shape[1])))
                y = C.turned(x, bits, seed)
                on, fix = y > 0, np.abs(y).sum(axis=1) / np.sqrt(np.float32(bits))
                plane, low, step = C.planes(y, seed)
                pick = np.random.default_rng(seed + 1)
                keys = np.empty((len(x), bands), U)
                for k in range(bands):
                    at = pick.choice(bits, min(width, bits), replace=False)
                    own = K.mix(np.packbits(on[:, at], axis=1).astype(U) + (np.arange(-(-len(at) // 8), dtype=U) << U(8)))
                    keys[:, k] = K.mix(np.bitwise_xor.reduce(own, axis=1) + U(k * 0x9E3779B97F4A7C15 + x.shape[1] & 2**64 - 1))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * bands), pa.array(keys.view(np.int64).ravel()))
                cols = [batch[c].take(pa.array(rows)) for c in ("id", "h")]
                cols += [C.bytes_column(np.packbits(on, axis=1)), pa.array(fix.astype(np.float32)), C.bytes_column(plane), pa.array(low), pa.array(step), flat]
                yield pa.RecordBatch.from_arrays(cols, ["id", "h", "code", "fix", "plane", "low", "step", "keys"])

    return run


def _estimate(threshold: float, sigmas: float):
    """Per pair: 1 accepted, 0 rejected, 2 to compute."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(len(batch), np.int8)
            size, other = (pc.binary_length(batch[c]).to_numpy(zero_copy_only=False) for c in ("code", "plane"))
            num = lambda c: batch[c].to_numpy()
            for width in np.unique(size):
                rows = np.flatnonzero((size == width) & (other == C.PLANES * width))
                if not len(rows):
                    continue
                bits, at = int(width) * 8, pa.array(rows)
                code, plane = C.from_bytes(batch["code"].take(at), int(width)), C.from_bytes(batch["plane"].take(at), C.PLANES * int(width))
                fix, low, step = num("fix")[rows], num("low")[rows], num("step")[rows]
                estimate = C.inner(code, fix, plane, low, step, bits, each=True)
                margin = sigmas * C.slack(fix, step, threshold, bits)
                out[rows] = np.where(estimate - margin >= threshold, 1, np.where(estimate + margin < threshold, 0, 2))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(out)], ["a", "b", "verdict"])

    return run


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.full(len(batch), -2.0)
        left = {x.shape[1]: (rows, x) for rows, x in C.matrices(batch["va"])}
        for rows, y in C.matrices(batch["vb"]):
            if y.shape[1] in left:
                own, x = left[y.shape[1]]
                both, i, j = np.intersect1d(own, rows, return_indices=True)
                out[both] = np.einsum("ij,ij->i", x[i].astype(np.float64), y[j].astype(np.float64))
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(out)], ["a", "b", "cosine"])


def similar(vectors: DataFrame, coded: DataFrame, pairs: DataFrame, threshold: float, sigmas: float = SIGMAS) -> tuple[DataFrame, str]:
    """The pairs (a, b) whose cosine reaches the threshold, stored; exact values only where the bounds leave it open."""
    left = coded.select(F.col("id").alias("a"), "code", "fix")
    right = coded.select(F.col("id").alias("b"), "plane", "low", "step")
    asked = pairs.join(left, "a").join(right, "b").select("a", "b", "code", "fix", "plane", "low", "step")
    judged, path = store(asked.mapInArrow(_estimate(threshold, sigmas), "a bigint, b bigint, verdict byte"), "estimates")
    open_ = judged.where("verdict = 2").select("a", "b").distinct()
    both = open_.join(vectors.select(F.col("id").alias("a"), F.col("embedding").alias("va")), "a").join(vectors.select(F.col("id").alias("b"), F.col("embedding").alias("vb")), "b")
    exact = both.select("a", "b", "va", "vb").mapInArrow(_exact, "a bigint, b bigint, cosine double").where(F.col("cosine") >= threshold)
    found, out = store(judged.where("verdict = 1").select("a", "b").unionByName(exact.select("a", "b")).distinct(), "similar")
    discard(vectors.sparkSession, path)
    return found, out


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, seed: int = 2) -> DataFrame:
    """(vec_id, group_id, links, keep); the groups are the components of the near-duplicate pairs."""
    spark = embeddings.sparkSession
    vectors = embeddings.select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
    vectors = vectors.where("id is not null and " + C.SANE)
    marks = vectors.select("id", F.xxhash64("embedding").alias("d1"), F.xxhash64(F.lit(1), "embedding").alias("d2"))
    least = marks.groupBy("d1", "d2").agg(F.min("id").alias("rep"))
    rep, p1 = store(marks.join(least, ["d1", "d2"]).select("id", "rep").distinct(), "copies")
    copies = rep.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    alone = vectors.join(rep.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").withColumn("h", F.xxhash64(F.lit(seed), "id"))
    width, bands = plan(rep.select("rep").distinct().count(), threshold)
    coded, p2 = store(alone.mapInArrow(_coded(width, bands, seed), CODES), "codes")
    members = coded.select("id", "h", F.explode("keys").alias("band"))
    # aggregated before the shuffle, so a hot band is no hot task
    leads = members.groupBy("band").agg(F.min_by("id", "h").alias("lead"), F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("band", "lead")
    buckets, p3 = store(members.select("id", "band").join(leads, "band"), "buckets")
    ordered = lambda x, y: (F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    first, p4 = store(buckets.where("id <> lead").select(*ordered("id", "lead")).distinct(), "pairs")
    linked, p5 = similar(vectors, coded, first, threshold)
    group, p6 = components(copies.unionByName(linked))
    inside = buckets.select("band", "id").distinct().join(group, "id", "left").select("band", "id", F.coalesce("root", "id").alias("root"))
    inside, p7 = store(inside, "roots")
    several = inside.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band")
    apart = inside.join(several, "band", "left_semi")
    rest = apart.select("band", F.col("id").alias("x"), F.col("root").alias("r1")).join(apart.select("band", F.col("id").alias("y"), F.col("root").alias("r2")), "band").where("x > y and r1 <> r2")
    second, p8 = store(rest.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct().join(first, ["a", "b"], "left_anti"), "pairs")
    again, p9 = similar(vectors, coded, second, threshold)
    whole, p10 = components(group.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(again))
    degree = linked.unionByName(again).select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    own = rep.groupBy("id").agg(F.min("rep").alias("rep")).join(degree.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("links", F.lit(0)).alias("links"))
    out, _ = store(whole.join(own, "id").select(F.col("id").alias("vec_id"), F.col("root").alias("group_id"), "links", (F.col("id") == F.col("root")).alias("keep")), "groups")
    discard(spark, p1, p2, p3, p4, p5, p6, p7, p8, p9, p10)
    return out
