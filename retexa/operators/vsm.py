"""Vector-space models over feature bags: tf-idf, counts, latent and word-vector
embeddings, and their similarity joins. Sparse vectors are rows (id, feature, w)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from retexa.operators import packed
from retexa.session import store, store_with

#: Edges of a word-similarity matrix sent to every executor at most (24 bytes each); beyond it
#: they are joined. Queries and documents of a tile, on average.
BROADCAST_EDGES = 2_000_000
TILE = (128, 512)


def counts(docs: DataFrame) -> DataFrame:
    """(id, feature, tf) of a table (id, features)."""
    return docs.select("id", F.explode("features").alias("feature")).groupBy("id", "feature").agg(F.count("*").alias("tf"))


def unit_length(weights: DataFrame) -> DataFrame:
    """Each document's weights over their Euclidean norm; a window, because a join
    with aggregated norms would compute the weights twice."""
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("id")))
    return weights.select("id", "feature", (F.col("w") / norm).alias("w"))


def idf(*collections: DataFrame, double_count_self: bool = False, smooth: bool = True) -> DataFrame:
    """(feature, idf) fitted on the documents of all collections together. With
    double_count_self a single collection counts twice, as query and as index."""
    k = 2 if double_count_self and len(collections) == 1 else 1
    rows, n = None, None
    for docs in collections:
        part = docs.select(F.explode(F.array_distinct("features")).alias("feature"))
        size = docs.agg(F.count("*").alias("n"))
        rows, n = (part, size) if rows is None else (rows.unionByName(part), n.unionByName(size))
    df = rows.groupBy("feature").agg((F.count("*") * k).alias("df"))
    total = n.agg((F.sum("n") * k).alias("n"))
    one = 1 if smooth else 0
    return df.crossJoin(F.broadcast(total)).select("feature", (F.ln((F.col("n") + one) / (F.col("df") + one)) + 1).alias("idf"))


def tfidf(docs: DataFrame, weights: DataFrame, sublinear: bool = False, normalise: bool = True) -> DataFrame:
    """(id, feature, w) with the fitted idf; features it doesn't know drop out."""
    tf = F.ln("tf") + 1 if sublinear else F.col("tf").cast("double")
    rows = counts(docs).join(weights, "feature").select("id", "feature", (tf * F.col("idf")).alias("w"))
    return unit_length(rows) if normalise else rows


def bag_of_words(docs: DataFrame, normalise: bool = True) -> DataFrame:
    rows = counts(docs).select("id", "feature", F.col("tf").cast("double").alias("w"))
    return unit_length(rows) if normalise else rows


def dot_join(queries: DataFrame, index: DataFrame, threshold: float = 0.25, digits: int | None = None) -> DataFrame:
    """(doc1, doc2, sim), the inner products of sparse rows that reach the threshold.

    A query's features are ordered from rare to frequent. Those at the end whose norm,
    times the largest norm of the index, stays under the threshold can't make a result by
    themselves: only the others meet the index, and what the end may add bounds which
    pairs are completed. So the commonest features, whose postings are longest, meet few."""
    if threshold <= 0:
        a = queries.select(F.col("id").alias("doc1"), "feature", F.col("w").alias("w1"))
        b = index.select(F.col("id").alias("doc2"), "feature", F.col("w").alias("w2"))
        sims = a.join(b, "feature").groupBy("doc1", "doc2").agg(F.sum(F.col("w1") * F.col("w2")).alias("sim"))
        return _rounded(sims, threshold, digits)
    limit = threshold - (10.0**-digits if digits is not None else 0.0) - 1e-9
    posts, _ = store(index.select("id", "feature", "w"), "postings")
    asked = posts if queries is index else queries.select("id", "feature", "w")
    df = posts.groupBy("feature").agg(F.count("*").alias("df"))
    norm = posts.groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias("x")).agg(F.coalesce(F.sqrt(F.max("x")), F.lit(0.0)).alias("most"))
    tail = F.sum(F.col("w") * F.col("w")).over(W.partitionBy("id").orderBy("df", "feature").rowsBetween(0, W.unboundedFollowing))
    rows = asked.join(df, "feature").select("id", "feature", "w", F.sqrt(tail).alias("tail")).crossJoin(F.broadcast(norm))
    rows, _ = store(rows.select("id", "feature", "w", (F.col("tail") * F.col("most")).alias("tail")), "ordered")
    ends = rows.where(F.col("tail") < limit).groupBy("id").agg(F.max("tail").alias("rest"))
    a = rows.where(F.col("tail") >= limit).join(ends, "id", "left").select(F.col("id").alias("doc1"), "feature", F.col("w").alias("w1"), F.coalesce("rest", F.lit(0.0)).alias("rest"))
    b = posts.select(F.col("id").alias("doc2"), "feature", F.col("w").alias("w2"))
    part = a.join(b, "feature").groupBy("doc1", "doc2").agg(F.sum(F.col("w1") * F.col("w2")).alias("part"), F.first("rest").alias("rest"))
    part, _ = store(part.where(F.col("part") + F.col("rest") >= limit).select("doc1", "doc2", "part"), "partial")
    c = rows.where(F.col("tail") < limit).select(F.col("id").alias("doc1"), "feature", F.col("w").alias("w1"))
    more = part.select("doc1", "doc2").join(c, "doc1").join(b, ["doc2", "feature"]).groupBy("doc1", "doc2").agg(F.sum(F.col("w1") * F.col("w2")).alias("more"))
    sims = part.join(more, ["doc1", "doc2"], "left").select("doc1", "doc2", (F.col("part") + F.coalesce("more", F.lit(0.0))).alias("sim"))
    return _rounded(sims, threshold, digits)


def _rounded(sims: DataFrame, threshold: float, digits: int | None) -> DataFrame:
    sims = sims.withColumn("sim", F.round("sim", digits)) if digits is not None else sims
    return sims.where(F.col("sim") >= threshold)


def bow_join(queries: DataFrame, index: DataFrame, threshold: float = 0.25, digits: int | None = None) -> DataFrame:
    """Cosine of the counts of two collections."""
    if not packed.small(queries):
        return dot_join(bag_of_words(queries), bag_of_words(index), threshold, digits)
    asked = packed.Postings(packed.normalised(packed.counted(queries)).toArrow())
    limit = threshold - (10.0**-digits if digits is not None else 0.0) - 1e-9
    met = packed.few_join(asked, packed.normalised(packed.counted(index)), keep=lambda g: g["x"] >= limit)
    return _rounded(met.select("doc1", "doc2", F.col("x").alias("sim")), threshold, digits)


def _few_tfidf(queries: DataFrame, index: DataFrame, threshold: float, digits: int | None, sublinear: bool) -> DataFrame:
    """tfidf_join with a small query side. The queries' and the commonest features' weights go
    to every executor; of the other features, which few documents hold, only what they add to
    each document's norm is summed by a join."""
    n = sum(c.select(F.count(F.lit(1))).first()[0] for c in (queries, index))
    tf = F.transform("w", lambda x: F.ln(x) + 1 if sublinear else x).alias("w")
    asked, _ = store(packed.counted(queries).select("id", "f", tf), "asked")
    held, _ = store(packed.counted(index).select("id", "f", tf), "held")
    df = packed.frequencies(asked, held)
    own = df.join(F.broadcast(asked.select(F.explode("f").alias("f")).distinct()), "f", "left_semi")
    known = packed.commonest(df).unionByName(own).distinct().toArrow()
    factor = lambda x: np.log((1 + n) / (1 + x)) + 1
    weights = packed.Weights(known["f"].to_numpy(), factor(known["df"].to_numpy()))
    rest = packed.weighted(held, weights, rest=True).select("id", F.explode(F.arrays_zip("f", "w")).alias("p")).select("id", "p.f", "p.w")
    rest = rest.join(df, "f").groupBy(F.col("id").alias("doc2")).agg(F.sum(F.pow(F.col("w") * (F.ln((1 + n) / (1 + F.col("df"))) + 1), F.lit(2))).alias("more"))
    limit = threshold - (10.0**-digits if digits is not None else 0.0) - 1e-9
    met = packed.few_join(packed.Postings(packed.weighted(asked, weights).toArrow()), packed.weighted(held, weights), keep=lambda g: g["x"] >= limit * np.sqrt(g["z1"] * g["z2"]))
    sims = met.join(rest, "doc2", "left").select("doc1", "doc2", (F.col("x") / F.sqrt(F.col("z1") * (F.col("z2") + F.coalesce("more", F.lit(0.0))))).alias("sim"))
    return _rounded(sims, threshold, digits)


def tfidf_join(queries: DataFrame, index: DataFrame | None = None, threshold: float = 0.25, double_count_self: bool = False, digits: int | None = None, **kw) -> DataFrame:
    """Cosine of tf-idf vectors fitted on both sides; without an index the diagonal stays."""
    if index is not None and kw.get("normalise", True) and packed.small(queries):
        return _few_tfidf(queries, index, threshold, digits, kw.get("sublinear", False))
    fitted = idf(queries, double_count_self=double_count_self) if index is None else idf(queries, index)
    a = tfidf(queries, fitted, **kw)
    return dot_join(a, a if index is None else tfidf(index, fitted, **kw), threshold, digits)


def _gathered(rows: DataFrame, *more: str) -> DataFrame:
    """(id, f, w, ...): one row a document, with arrays of its features and weights."""
    got = rows.groupBy("id", *more).agg(F.collect_list(F.struct("f", "w")).alias("x"))
    return got.select("id", *more, F.col("x.f").alias("f"), F.col("x.w").alias("w"))


class Edges:
    """A sparse square matrix by hashed words, fixed in size by BROADCAST_EDGES."""

    def __init__(self, table: pa.Table):
        f1, f2, s = (table[c].to_numpy() for c in ("f1", "f2", "s"))
        self.keys = np.unique(np.concatenate([f1, f2]))
        order = np.argsort(f1, kind="stable")
        row = np.searchsorted(self.keys, f1[order])
        self.start = np.searchsorted(row, np.arange(len(self.keys) + 1))
        self.column, self.value = np.searchsorted(self.keys, f2[order]).astype(np.int32), s[order]

    def squares(self, f: np.ndarray, w: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """w S w of each document."""
        out, x = np.zeros(len(offs) - 1), np.zeros(len(self.keys))
        if not len(self.keys):
            return out
        at = np.minimum(np.searchsorted(self.keys, f), len(self.keys) - 1)
        known = self.keys[at] == f
        for i in range(len(out)):
            own = slice(offs[i], offs[i + 1])
            words, mine = at[own][known[own]], w[own][known[own]]
            np.add.at(x, words, mine)
            count = self.start[words + 1] - self.start[words]
            cells = np.arange(count.sum()) + np.repeat(self.start[words] - (np.cumsum(count) - count), count)
            out[i] = (self.value[cells] * x[self.column[cells]] * np.repeat(mine, count)).sum()
            x[words] = 0
        return out


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offs = column.offsets.to_numpy()
    return column.values.to_numpy()[offs[0] : offs[-1]], offs - offs[0]


def _soft_tile(threshold: float, digits: int | None):
    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not len(asked) or not len(held):
            return pa.table({"doc1": asked["id"].slice(0, 0), "doc2": held["id"].slice(0, 0), "sim": pa.array([], pa.float64())})
        asked, held = asked.combine_chunks().to_batches()[0], held.combine_chunks().to_batches()[0]
        (qf, qo), (df, do) = _flat(asked["f"]), _flat(held["f"])
        qw, dw = _flat(asked["w"])[0], _flat(held["w"])[0]
        n1, n2 = asked["n"].to_numpy(), held["n"].to_numpy()
        words, col = np.unique(qf, return_inverse=True)
        at = np.minimum(np.searchsorted(words, df), max(len(words) - 1, 0))
        hit = np.flatnonzero(words[at] == df) if len(words) else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(held)), np.diff(do))[hit]
        at, dw = at[hit], dw[hit]
        # about 32,768 features of whole documents at once
        ends = np.unique(np.searchsorted(doc, doc[np.minimum(np.arange(1 << 15, len(doc) + (1 << 15), 1 << 15), len(doc)) - 1], "right")) if len(doc) else []
        stretches = [slice(int(x), int(y)) for x, y in zip([0, *ends], ends)]
        found = []
        for lo in range(0, len(asked), 32):  # queries that a dense stripe holds at once
            hi = min(lo + 32, len(asked))
            cells = slice(qo[lo], qo[hi])
            stripe = np.zeros((len(words), hi - lo))
            np.add.at(stripe, (col[cells], np.repeat(np.arange(hi - lo), np.diff(qo[lo : hi + 1]))), qw[cells])
            meets = stripe != 0 if threshold <= 0 else None
            for cut in stretches:
                heads = np.flatnonzero(np.diff(doc[cut], prepend=-1))
                rows = doc[cut][heads]
                top = np.add.reduceat(stripe[at[cut]] * dw[cut, None], heads, axis=0)
                product = n2[rows][:, None] * n1[lo:hi][None, :]
                sim = np.where(product > 0, top / np.sqrt(np.where(product > 0, product, 1)), 0.0)
                keep = sim >= threshold - (10.0**-digits if digits is not None else 0.0)
                if meets is not None:
                    keep &= np.logical_or.reduceat(meets[at[cut]], heads, axis=0)
                i, j = np.nonzero(keep)
                found.append((j + lo, rows[i], sim[i, j]))
        a, b, c = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table({"doc1": asked["id"].take(pa.array(a)), "doc2": held["id"].take(pa.array(b)), "sim": pa.array(c, pa.float64())})

    return run


def soft_cosine_join(queries: DataFrame, index: DataFrame, word_sims: DataFrame, threshold: float = 0.0, digits: int | None = None) -> DataFrame:
    """q S d / sqrt(q S q * d S d) for sparse rows and the edges (w1, w2, s) of S,
    diagonal included. Undefined values are 0 and only kept at threshold 0 if a pair
    meets. Queries are multiplied by S once, by a join; tiles of queries and documents
    are multiplied densely. Features are hashed to 64 bits."""
    spark = queries.sparkSession
    hashed = lambda rows: rows.select("id", F.xxhash64("feature").alias("f"), "w")
    edges, _, size = store_with(word_sims.select(F.xxhash64("w1").alias("f1"), F.xxhash64("w2").alias("f2"), F.col("s").cast("double").alias("s")), "edges")
    few = size["n"] <= BROADCAST_EDGES
    q, _ = store(hashed(queries), "queries")
    hop = lambda rows: rows.join(F.broadcast(edges) if few else edges, rows["f"] == edges["f1"]).groupBy("id", F.col("f2").alias("f")).agg(F.sum(F.col("w") * F.col("s")).alias("w"))
    turned, _ = store(hop(q), "turned")
    norm = lambda rows, other: rows.join(other.withColumnRenamed("w", "v"), ["id", "f"]).groupBy("id").agg(F.sum(F.col("w") * F.col("v")).alias("n"))
    asked, _, n = store_with(_gathered(turned.join(norm(q, turned), "id"), "n"), "asked")
    if few:
        matrix = spark.sparkContext.broadcast(Edges(edges.toArrow()))

        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                f, offs = _flat(batch["f"])
                yield batch.append_column("n", pa.array(matrix.value.squares(f, _flat(batch["w"])[0], offs)))

        rows = _gathered(hashed(index))
        kind = rows.schema["id"].dataType.simpleString()
        held, _, m = store_with(rows.mapInArrow(measured, f"id {kind}, f array<bigint>, w array<double>, n double"), "held")
    else:
        d, _ = store(hashed(index), "index")
        held, _, m = store_with(_gathered(d.join(norm(d, hop(d)), "id"), "n"), "held")
    tall, wide = max(1, -(-n["n"] // TILE[0])), max(1, -(-m["n"] // TILE[1]))
    block = lambda df, own, mine, other, theirs: df.withColumn(mine, F.pmod(F.xxhash64("id"), F.lit(own)).cast("int")).withColumn(theirs, F.explode(F.sequence(F.lit(0), F.lit(other - 1))))
    a = block(asked.select("id", "n", "f", "w"), tall, "t", wide, "u").select("t", "u", "id", "n", "f", "w")
    b = block(held.select("id", "n", "f", "w"), wide, "u", tall, "t").select("t", "u", "id", "n", "f", "w").toDF("tt", "uu", "id", "n", "f", "w")
    kinds = [df.schema["id"].dataType.simpleString() for df in (asked, held)]
    sims = a.groupBy("t", "u").cogroup(b.groupBy("tt", "uu")).applyInArrow(_soft_tile(threshold, digits), f"doc1 {kinds[0]}, doc2 {kinds[1]}, sim double")
    return _rounded(sims, threshold, digits)


def weighted_vectors(weights: DataFrame, vectors: DataFrame, lengths: DataFrame, strict: bool = False) -> DataFrame:
    """(id, vec): the weighted sum of word vectors over the document's length.
    Words without a vector add nothing, or raise if strict."""
    joined = weights.join(vectors.select(F.col("word").alias("feature"), "vec"), "feature", "left")
    if strict:
        joined = joined.withColumn("vec", F.coalesce("vec", F.raise_error(F.concat(F.lit("no vector for "), F.col("feature"))).cast("array<double>")))
    cells = joined.where("vec is not null").select("id", "w", F.posexplode("vec").alias("i", "x"))
    sums = cells.groupBy("id", "i").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    docs = sums.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("vec"))
    return docs.join(lengths, "id").select("id", F.transform("vec", lambda x: x / F.col("length")).alias("vec"))


def lengths(docs: DataFrame) -> DataFrame:
    return docs.select("id", F.size("features").alias("length"))


def mean_vectors(docs: DataFrame, vectors: DataFrame, strict: bool = False) -> DataFrame:
    """(id, vec): mean of the word vectors over all words of the document."""
    rows = counts(docs).select("id", "feature", F.col("tf").cast("double").alias("w"))
    return weighted_vectors(rows, vectors, lengths(docs), strict)


def tfidf_vectors(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, vec): word vectors weighted by normalised tf-idf, over the length."""
    n = docs.select(F.count(F.lit(1))).first()[0]
    held, _ = store(packed.counted(docs), "held")
    df = packed.frequencies(held)
    factor = lambda x: F.ln((1 + n) / (1 + x)) + 1
    known = packed.commonest(df).toArrow()
    weights = packed.Weights(known["f"].to_numpy(), np.log((1 + n) / (1 + known["df"].to_numpy())) + 1)
    scaled = vectors.select(F.xxhash64("word").alias("f"), "vec").join(df, "f").select("f", F.transform("vec", lambda x: x * factor(F.col("df"))).alias("vec"))
    sums = packed.summed(held, scaled).join(packed.squares(held, df, weights, factor), "id")
    return sums.select("id", F.transform("vec", lambda x: x / (F.sqrt("z") * F.col("t"))).alias("vec"))


def top_components(vectors: DataFrame, k: int) -> np.ndarray:
    """k leading right singular vectors of the matrix of all vectors, from the
    d x d Gram matrix that the partitions add up."""

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                x = np.vstack(pdf["vec"].to_numpy()).astype(float)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "x": total.ravel()})

    got = vectors.select("vec").mapInPandas(gram, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    if not len(got):
        return np.zeros((0, 0))
    d = int(got["i"].max()) + 1
    m = np.zeros((d, d))
    m[got["i"], got["j"]] = got["x"]
    value, vec = np.linalg.eigh(m)
    return vec[:, np.argsort(-value)[:k]].T


def sif_vectors(docs: DataFrame, vectors: DataFrame, freqs: DataFrame, npc: int = 1, a: float = 1e-3) -> DataFrame:
    """(id, vec): word vectors weighted a / (a + frequency share) over the length,
    less their projection on the npc leading singular vectors."""
    total = freqs.agg(F.sum("freq").alias("total"))
    share = freqs.crossJoin(F.broadcast(total)).select("feature", (F.lit(a) / (F.lit(a) + F.col("freq") / F.col("total"))).alias("k"))
    scaled = vectors.join(share, vectors["word"] == share["feature"]).select(F.xxhash64("word").alias("f"), F.transform("vec", lambda x: x * F.col("k")).alias("vec"))
    base = packed.summed(packed.counted(docs), scaled).select("id", F.transform("vec", lambda x: x / F.col("t")).alias("vec"))
    base, _ = store(base, "base")  # read for its components and again
    if npc <= 0:
        return base
    pc = top_components(base, npc)

    def less(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.vstack(pdf["vec"].to_numpy()).astype(float)
                yield pd.DataFrame({"id": pdf["id"], "vec": list(x - (x @ pc.T) @ pc)})

    return base.mapInPandas(less, base.schema)


def lsi_vectors(docs: DataFrame, k: int, rounds: int = 4, extra: int = 4, seed: int = 0) -> DataFrame:
    """(id, vec): the documents' counts on the k leading right singular vectors, by
    subspace iteration. A round is two joins and aggregations of the sparse counts
    with k + extra numbers a feature and a document; the driver sees (k + extra)
    squared numbers. Signs are fixed so that every axis' greatest part is positive."""
    tf = counts(docs)
    width = k + extra
    start = F.array(*(F.xxhash64(F.lit(seed), F.lit(j), "feature") / float(2**63) for j in range(width)))
    basis = tf.select("feature").distinct().withColumn("v", start)
    sums = [F.sum(F.col("tf") * F.col("v")[j]).alias(f"x{j}") for j in range(width)]
    packed = F.array(*(F.col(f"x{j}") for j in range(width))).alias("v")
    rows = None
    for r in range(rounds + 1):
        basis = _rotated(basis, _whitening(basis, width), "feature")
        rows = tf.join(basis, "feature").groupBy("id").agg(*sums).select("id", packed)
        if r < rounds:
            basis = tf.join(rows, "id").groupBy("feature").agg(*sums).select("feature", packed)
    value, turn = np.linalg.eigh(_gram(rows, width))
    turn = turn[:, np.argsort(-value)[:k]]
    final = _rotated(rows, turn, "id")
    ends = final.agg(*(F.max(F.col("v")[j]).alias(f"h{j}") for j in range(k)), *(F.min(F.col("v")[j]).alias(f"l{j}") for j in range(k))).first()
    signs = [-1.0 if ends is not None and ends[f"h{j}"] is not None and -ends[f"l{j}"] > ends[f"h{j}"] else 1.0 for j in range(k)]
    return final.select("id", F.array(*(F.col("v")[j] * signs[j] for j in range(k))).alias("vec"))


def _gram(rows: DataFrame, width: int) -> np.ndarray:
    got = rows.agg(*(F.sum(F.col("v")[i] * F.col("v")[j]).alias(f"g{i}_{j}") for i in range(width) for j in range(i, width))).first()
    g = np.zeros((width, width))
    for i in range(width):
        for j in range(i, width):
            g[i, j] = g[j, i] = got[f"g{i}_{j}"] or 0.0
    return g


def _whitening(rows: DataFrame, width: int) -> np.ndarray:
    """Makes the columns orthonormal; directions without length become zero."""
    value, vec = np.linalg.eigh(_gram(rows, width))
    ok = value > max(value.max(), 0) * 1e-12
    return vec * np.where(ok, 1 / np.sqrt(np.where(ok, value, 1)), 0)


def _rotated(rows: DataFrame, matrix: np.ndarray, key: str) -> DataFrame:
    """v times a small matrix, cut from its lineage."""
    cols = [sum((F.col("v")[i] * float(matrix[i, j]) for i in range(1, matrix.shape[0])), F.col("v")[0] * float(matrix[0, j])) for j in range(matrix.shape[1])]
    return store(rows.select(key, F.array(*cols).alias("v")), "lsi")[0]
