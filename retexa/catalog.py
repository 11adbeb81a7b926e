"""Queries over the reuse operators and the SQL that they are held against.

Benchmark items are the query collection and documents the index collection;
conversation turns are ordered documents, and embeddings are the vectors of the
most frequent words, by rank. Every query reads its tables whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retexa.functions import text as X
from retexa.functions import vectors as V
from retexa.operators import align, collections, context, evaluate, features, results, setjoin, transport, vsm, wordvecs
from retexa.plans import reuse
from retexa.plans.ranking import ranked
from retexa.session import shared_dir, store
from retexa.streaming import incoming

STOPWORDS = ("the", "of", "and", "a", "to", "in", "is", "der", "die", "und", "de", "la", "el", "que", "les", "le")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    # a small table in one file is one task; spread texts, whose tokenising is the work
    return df.repartition(cores) if name == "documents" and df.rdd.getNumPartitions() < cores else df


def coll(spark: SparkSession, d: str, name: str) -> DataFrame:
    """(id, words) of benchmark or documents."""
    return collections.from_text(table(spark, d, name), {"benchmark": "item_id", "documents": "doc_id"}[name])


def bags(spark: SparkSession, d: str, name: str) -> DataFrame:
    """(id, features): lower-cased words in order."""
    key = {"benchmark": "item_id", "documents": "doc_id"}[name]
    return table(spark, d, name).select(F.col(key).alias("id"), X.tokens(F.lower("text")).alias("features"))


def both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return bags(spark, d, "benchmark"), bags(spark, d, "documents")


WORD = r"[\p{L}\p{N}]+"
Q = rf"q AS (SELECT item_id AS id, regexp_extract_all(lower(text), '{WORD}') AS f FROM benchmark)"
D = rf"d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '{WORD}') AS f FROM documents)"
QP = "qp AS (SELECT id, unnest(f) AS w FROM q)"
DP = "dp AS (SELECT id, unnest(f) AS w FROM d)"
QC = "qc AS (SELECT id, w, count(*) AS tf FROM qp GROUP BY ALL)"
DC = "dc AS (SELECT id, w, count(*) AS tf FROM dp GROUP BY ALL)"
QN = "qn AS (SELECT id, count(*) AS n, sum(tf) AS t FROM qc GROUP BY id)"
DN = "dn AS (SELECT id, count(*) AS n, sum(tf) AS t FROM dc GROUP BY id)"
BASE = f"WITH {Q}, {D}, {QP}, {DP}, {QC}, {DC}, {QN}, {DN}"
DBASE = f"WITH {D}, {DP}, {DC}, {DN}"
JOINED = "o AS (SELECT a.id AS doc1, b.id AS doc2, count(*) AS o, sum(least(a.tf, b.tf)) AS m FROM qc a JOIN dc b USING (w) GROUP BY ALL), s AS (SELECT doc1, doc2, o, m, x.n AS n1, y.n AS n2, x.t AS t1, y.t AS t2 FROM o JOIN qn x ON x.id = doc1 JOIN dn y ON y.id = doc2)"
PAIRS = f"{BASE}, {JOINED}"
SELF = f"{DBASE}, o AS (SELECT a.id AS doc1, b.id AS doc2, count(*) AS o FROM dc a JOIN dc b USING (w) GROUP BY ALL), s AS (SELECT doc1, doc2, o, x.n AS n1, y.n AS n2 FROM o JOIN dn x ON x.id = doc1 JOIN dn y ON y.id = doc2)"
CONTAINED = f"{PAIRS}, sims AS (SELECT doc1, doc2, o / n1 AS sim FROM s WHERE o / n1 >= 0.5)"


# -- words and features


@query(rf"""SELECT doc_id, line_no - 1 AS line_no, array_to_string(regexp_extract_all(line, '{WORD}'), ' ') AS words, len(regexp_extract_all(line, '{WORD}')) AS n_words
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents) WHERE trim(line) <> ''""")
def tokenize_lines(spark, d):
    """Each non-blank line of a document and its words."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where("trim(line) <> ''")
    t = X.tokens(F.col("line"))
    return lines.select("doc_id", "line_no", F.array_join(t, " ").alias("words"), F.size(t).alias("n_words"))


_PARTS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')"
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_PUNCT = r"^[!-/:-@\[\]-`{-~]+$"


@query(f"""SELECT doc_id, len(p) AS n_words, len(k) AS n_features, array_to_string(k, ' ') AS features
FROM (SELECT doc_id, p, list_transform(list_filter(p, lambda t: NOT regexp_matches(t, '{_PUNCT}') AND lower(t) NOT IN ({_STOP})), lambda t: lower(t)) AS k FROM (SELECT doc_id, {_PARTS} AS p FROM documents))""")
def preprocess_filters(spark, d):
    """Punctuation and stopwords dropped, the rest lower-cased."""
    ws = table(spark, d, "documents").select("doc_id", X.split_words(F.col("text")).alias("words"))
    out = ws.withColumn("f", X.Preprocess(stopwords=STOPWORDS).features(F.col("words")))
    return out.select("doc_id", F.size("words").alias("n_words"), F.size("f").alias("n_features"), F.array_join("f", " ").alias("features"))


@query(rf"""SELECT doc_id, array_to_string(list_filter(f, lambda t: regexp_matches(t, '^(?:th|er|de)') AND NOT regexp_matches(t, '^(?:.*\d)')), ' ') AS features
FROM (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS f FROM documents)""")
def regex_filter(spark, d):
    """Words that begin as one rule wants and not as another forbids."""
    rules = {"lemma": X.TokenRule("th|er|de", keep=True), "token": X.TokenRule(r".*\d")}
    ws = coll(spark, d, "documents")
    return ws.select(F.col("id").alias("doc_id"), F.array_join(X.Preprocess(rules=rules).features(F.col("words")), " ").alias("features"))


_UNK = rf"SELECT doc_id, regexp_extract_all(text, '{WORD}') AS t FROM documents"


@query(f"""SELECT doc_id, array_to_string(list_transform(t, lambda x: lower(x)), ' ') AS replaced, array_to_string(list_transform(list_filter(t, lambda x: length(x) <= 8), lambda x: lower(x)), ' ') AS dropped FROM ({_UNK})""")
def unk_replace(spark, d):
    """Lemmas of long words made unknown: replaced by their tokens, or dropped."""
    ws = coll(spark, d, "documents")
    unk = F.transform("words", lambda w: F.struct(w["token"].alias("token"), F.when(F.length(w["token"]) > 8, "$unk$").otherwise(w["lemma"]).alias("lemma"), w["pos"].alias("pos")))
    ws = ws.select("id", unk.alias("words"))
    make = lambda **kw: F.array_join(X.Preprocess(**kw).features(F.col("words")), " ")
    return ws.select(F.col("id").alias("doc_id"), make(replace_unk=True).alias("replaced"), make(drop_unk=True).alias("dropped"))


@query(rf"""SELECT DISTINCT word, strip_accents(word) AS plain FROM (SELECT unnest(regexp_extract_all(text, '{WORD}')) AS word FROM documents)""")
def strip_marks(spark, d):
    """Every distinct word without its diacritics."""
    ws = table(spark, d, "documents").select(F.explode(X.tokens(F.col("text"))).alias("word")).distinct()
    return ws.select("word", X.strip_marks("word").alias("plain"))


def _grams_sql(parts: str) -> str:
    return f"""WITH {D} SELECT id AS doc_id, len(g) AS n, md5(array_to_string(g, ' ')) AS digest FROM (SELECT id, {parts} AS g FROM d)"""


@query(_grams_sql("list_concat(f, list_concat(list_transform(range(1, greatest(len(f), 1)), lambda i: f[i] || '--' || f[i + 1]), list_transform(range(1, greatest(len(f) - 1, 1)), lambda i: f[i] || '--' || f[i + 1] || '--' || f[i + 2])))"))
def ngrams_1_3(spark, d):
    """All 1- to 3-grams of each document, digested in order."""
    g = bags(spark, d, "documents").select("id", X.ngrams(F.col("features"), 1, 3).alias("g"))
    return g.select(F.col("id").alias("doc_id"), F.size("g").alias("n"), F.md5(F.array_join("g", " ")).alias("digest"))


@query(_grams_sql("flatten(list_transform(range(1, greatest(len(f) - 1, 1)), lambda i: [f[i] || '--' || f[i + 1], f[i] || '--' || f[i + 2]]))"))
def skipgrams_2_1(spark, d):
    """Pairs with up to one word skipped."""
    g = bags(spark, d, "documents").select("id", X.ngrams(F.col("features"), 2, 2, skip=1).alias("g"))
    return g.select(F.col("id").alias("doc_id"), F.size("g").alias("n"), F.md5(F.array_join("g", " ")).alias("digest"))


@query(f"""WITH {D} SELECT id AS doc_id, CAST(start / 15 AS BIGINT) AS shingle, start, least(start + 20, len(f)) AS stop, array_to_string(f[start + 1:start + 20], ' ') AS words
FROM (SELECT id, f, unnest(range(0, len(f), 15)) AS start FROM d)""")
def shingles_20_5(spark, d):
    """Windows of 20 words that overlap by 5."""
    s = collections.shingled(coll(spark, d, "documents"))
    return s.select(F.col("parent_id").alias("doc_id"), F.col("shingle").cast("bigint").alias("shingle"), "start", "stop", X.joined(F.col("words"), "lemma").alias("words"))


@query(rf"""WITH t AS (SELECT conv_id, turn, conv_id * 100000 + turn AS id, regexp_extract_all(text, '{WORD}') AS f FROM conversations),
w AS (SELECT conv_id, id, i, f[i] AS w, row_number() OVER (PARTITION BY conv_id ORDER BY id, i) AS p FROM (SELECT conv_id, id, f, unnest(range(1, len(f) + 1)) AS i FROM t)),
e AS (SELECT t.id, t.conv_id, coalesce(sum(len(f)) OVER (PARTITION BY conv_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, len(f) AS n FROM t)
SELECT id, coalesce((SELECT string_agg(w, ' ' ORDER BY p) FROM w WHERE w.conv_id = e.conv_id AND p > lo - 10 AND p <= lo), '') AS "left",
  coalesce((SELECT string_agg(w, ' ' ORDER BY p) FROM w WHERE w.conv_id = e.conv_id AND p > lo + n AND p <= lo + n + 10), '') AS "right" FROM e""")
def context_left_right(spark, d):
    """Ten words before and after every turn of a conversation, across turns."""
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("id"), "conv_id", X.words(F.col("text")).alias("words"))
    return context.neighbours(turns, 10, group="conv_id")


@query(f"""WITH {D} SELECT id AS doc_id, CAST(start / 15 AS BIGINT) AS shingle, array_to_string(f[greatest(start - 8, 0) + 1:start], ' ') AS "left", array_to_string(f[least(start + 20, len(f)) + 1:least(start + 20, len(f)) + 8], ' ') AS "right"
FROM (SELECT id, f, unnest(range(0, len(f), 15)) AS start FROM d)""")
def shingle_context(spark, d):
    """Eight words on both sides of every window, within its document."""
    s = context.of_windows(coll(spark, d, "documents"), 8)
    return s.select(F.col("id").alias("doc_id"), F.col("shingle").cast("bigint").alias("shingle"), "left", "right")


# -- statistics and selection


def _indexed(spark, d):
    return bags(spark, d, "documents").withColumnRenamed("id", "doc_idx")


@query(f"{DBASE} SELECT id AS doc_idx, w AS feature, tf FROM dc")
def term_freq(spark, d):
    return features.term_freq(_indexed(spark, d))


@query(rf"SELECT w AS feature, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(text, '{WORD}')) AS w FROM documents) GROUP BY w")
def field_vocab(spark, d):
    return features.field_vocab(coll(spark, d, "documents"), "token")


_STATS = f"{DBASE}, v AS (SELECT w AS feature, sum(tf) AS freq, count(*) AS df FROM dc GROUP BY w)"


@query(f"{_STATS} SELECT feature, CAST(freq AS BIGINT) AS freq, df, round(ln((SELECT sum(freq) FROM v) / df), 6) AS idf FROM v")
def vocab_stats(spark, d):
    return features.statistics(_indexed(spark, d)).select("feature", "freq", "df", F.round("idf", 6).alias("idf"))


@query(f"{_STATS} SELECT feature, CAST(freq AS BIGINT) AS freq, df FROM v WHERE df >= 2 AND df <= 50 AND freq >= 3")
def criterion_df_range(spark, d):
    kept = (features.DF.between(2, 50) & (features.FREQ >= 3)).select(features.statistics(_indexed(spark, d)))
    return kept.select("feature", "freq", "df")


@query(f"""{_STATS}, seen AS (SELECT w, min({{'id': id, 'i': i}}) AS first_at FROM (SELECT id, f[i] AS w, i FROM (SELECT id, f, unnest(range(1, len(f) + 1)) AS i FROM d)) GROUP BY w),
r AS (SELECT feature, freq, df, (row_number() OVER (ORDER BY freq, first_at) - 1) / (count(*) OVER () - 1) AS rank FROM v JOIN seen ON w = feature)
SELECT feature, CAST(freq AS BIGINT) AS freq, df FROM r WHERE rank > 0.5 AND rank <= 0.95""")
def criterion_rank(spark, d):
    """Features by their normalised rank; ties in the order first seen."""
    kept = ((features.FREQ > 0.5) & (features.FREQ <= 0.95)).select(features.statistics(_indexed(spark, d)))
    return kept.select("feature", "freq", "df")


@query(f"""{_STATS}, k AS (SELECT feature FROM v WHERE df >= 3), p AS (SELECT id, f[i] AS w, i FROM (SELECT id, f, unnest(range(1, len(f) + 1)) AS i FROM d))
SELECT d.id AS doc_idx, count(k.feature) AS n, md5(coalesce(string_agg(w, ' ' ORDER BY i) FILTER (WHERE k.feature IS NOT NULL), '')) AS digest FROM d LEFT JOIN p USING (id) LEFT JOIN k ON k.feature = w GROUP BY ALL""")
def feature_selection(spark, d):
    """Documents cut down to the features in three documents or more."""
    docs = _indexed(spark, d)
    out = features.keep_features(docs, (features.DF >= 3).select(features.statistics(docs)))
    return out.select("doc_idx", F.size("features").cast("bigint").alias("n"), F.md5(F.array_join("features", " ")).alias("digest"))


@query(f"WITH {D} SELECT id, CASE WHEN len(f) >= 50 THEN len(f) ELSE 0 END AS n FROM d WHERE len(f) >= 50")
def least_features(spark, d):
    """Documents with fifty features or more; others are emptied and drop out."""
    docs = bags(spark, d, "documents")
    return features.nonempty(docs.select("id", X.doc_features(F.col("features"), least=50).alias("features"))).select("id", F.size("features").alias("n"))


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def get_docs(spark, d):
    """Documents looked up by a table of ids."""
    ids = table(spark, d, "labels").where("quality = 0").select("doc_id")
    return collections.get_docs(table(spark, d, "documents").select("doc_id", "n_chars"), ids, "doc_id")


# -- similarity joins


@query(f"{SELF} SELECT doc1, doc2, o / (n1 + n2 - o) AS sim FROM s WHERE o / (n1 + n2 - o) >= 0.5 AND doc1 <> doc2")
def jaccard_join(spark, d):
    return setjoin.set_join(bags(spark, d, "documents"), measure="jaccard", threshold=0.5)


@query(f"{CONTAINED} SELECT * FROM sims")
def containment_join(spark, d):
    return setjoin.set_join(*both(spark, d), "containment", 0.5)


@query(f"{PAIRS} SELECT doc1, doc2, o / greatest(n1, n2) AS sim FROM s WHERE o / greatest(n1, n2) >= 0.3")
def containment_min_join(spark, d):
    return setjoin.set_join(*both(spark, d), "containment_min", 0.3)


@query(f"{PAIRS} SELECT doc1, doc2, round(o / (sqrt(n1) * sqrt(n2)), 9) AS sim FROM s WHERE round(o / (sqrt(n1) * sqrt(n2)), 9) >= 0.2")
def set_cosine_join(spark, d):
    sims = setjoin.set_join(*both(spark, d), "cosine", 0.199999999)
    return sims.withColumn("sim", F.round("sim", 9)).where("sim >= 0.2")


@query(f"{PAIRS} SELECT doc1, doc2, o / n1 AS sim FROM s")
def shared_word_join(spark, d):
    """Threshold 0: every pair that shares a word."""
    return setjoin.set_join(*both(spark, d), "containment", 0.0)


@query(f"{PAIRS} SELECT doc1, doc2, m / (t1 + t2 - m) AS sim FROM s WHERE m / (t1 + t2 - m) >= 0.1")
def weighted_jaccard(spark, d):
    return setjoin.weighted_join(*both(spark, d), "weighted_jaccard", 0.1)


@query(f"{PAIRS} SELECT doc1, doc2, m / t2 AS sim FROM s WHERE m / t2 >= 0.3")
def weighted_containment(spark, d):
    return setjoin.weighted_join(*both(spark, d), "weighted_containment", 0.3)


@query(f"{SELF} SELECT doc1, doc2, o / n1 AS sim FROM s WHERE o / n1 >= 0.8 AND doc1 <> doc2")
def self_join_no_diag(spark, d):
    return setjoin.set_join(bags(spark, d, "documents"), measure="containment", threshold=0.8)


@query(f"{SELF} SELECT doc1, doc2, o / (n1 + n2 - o) AS sim FROM s WHERE o / (n1 + n2 - o) >= 0.8")
def self_join_with_diag(spark, d):
    return setjoin.set_join(bags(spark, d, "documents"), measure="jaccard", threshold=0.8, drop_self=False)


@query(f"""WITH {Q}, t AS (SELECT q.id, list_distinct(f) AS a, list_distinct(lead(f) OVER (ORDER BY id)) AS b FROM q), u AS (SELECT id, len(list_intersect(a, b)) AS o, len(a) AS n1, len(b) AS n2 FROM t WHERE b IS NOT NULL)
SELECT id, round(o / (n1 + n2 - o), 9) AS jaccard, round(o / n1, 9) AS containment, round(o / greatest(n1, n2), 9) AS containment_min, round(o / (sqrt(n1) * sqrt(n2)), 9) AS cosine FROM u""")
def pair_measures(spark, d):
    """The element-wise measures of each item and the next."""
    q = bags(spark, d, "benchmark")
    pairs = q.join(q.select((F.col("id") - 1).alias("id"), F.col("features").alias("other")), "id")
    return pairs.select("id", *(F.round(c, 9).alias(n) for n, c in setjoin.pair_measures(F.col("features"), F.col("other")).items()))


# -- vector space

_IDF = "n AS (SELECT (SELECT count(*) FROM q) + (SELECT count(*) FROM d) AS n), v AS (SELECT w, count(*) AS df FROM (SELECT id, w FROM qc UNION ALL SELECT id, w FROM dc) GROUP BY w), i AS (SELECT w, ln((1 + n) / (1 + df)) + 1 AS idf FROM v, n)"
_WEIGHTS = "qw0 AS (SELECT id, w, tf * idf AS x FROM qc JOIN i USING (w)), dw0 AS (SELECT id, w, tf * idf AS x FROM dc JOIN i USING (w)), qw AS (SELECT id, w, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM qw0), dw AS (SELECT id, w, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM dw0)"
_TFIDF = f"{BASE}, {_IDF}, {_WEIGHTS}, sims AS (SELECT a.id AS doc1, b.id AS doc2, round(sum(a.x * b.x), 6) AS sim FROM qw a JOIN dw b USING (w) GROUP BY ALL HAVING round(sum(a.x * b.x), 6) >= 0.25)"


@query(f"{BASE}, {_IDF}, {_WEIGHTS} SELECT id, w AS feature, round(x, 6) AS w FROM dw")
def tfidf_weights(spark, d):
    q, docs = both(spark, d)
    return vsm.tfidf(docs, vsm.idf(q, docs)).select("id", "feature", F.round("w", 6).alias("w"))


@query(f"{_TFIDF} SELECT * FROM sims")
def tfidf_cosine(spark, d):
    return vsm.tfidf_join(*both(spark, d), threshold=0.25, digits=6)


@query(f"""{DBASE}, v AS (SELECT w, 2 * count(*) AS df FROM dc GROUP BY w), i AS (SELECT w, ln((1 + 2 * (SELECT count(*) FROM d)) / (1 + df)) + 1 AS idf FROM v),
x AS (SELECT id, w, tf * idf AS x FROM dc JOIN i USING (w)), dw AS (SELECT id, w, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM x)
SELECT a.id AS doc1, b.id AS doc2, round(sum(a.x * b.x), 6) AS sim FROM dw a JOIN dw b USING (w) GROUP BY ALL HAVING round(sum(a.x * b.x), 6) >= 0.8""")
def tfidf_self(spark, d):
    """A collection against itself, its documents counted twice and the diagonal kept."""
    return vsm.tfidf_join(bags(spark, d, "documents"), threshold=0.8, double_count_self=True, digits=6)


@query(f"{BASE}, {_IDF}, {_WEIGHTS.replace('tf * idf', 'tf')}, sims AS (SELECT a.id AS doc1, b.id AS doc2, round(sum(a.x * b.x), 6) AS sim FROM qw a JOIN dw b USING (w) GROUP BY ALL HAVING round(sum(a.x * b.x), 6) >= 0.4) SELECT * FROM sims")
def bow_cosine(spark, d):
    return vsm.bow_join(*both(spark, d), threshold=0.4, digits=6)


def word_table(spark, d):
    """(word, vec): the vector whose number is the word's rank by frequency in documents."""
    freq = bags(spark, d, "documents").select(F.explode("features").alias("word")).groupBy("word").agg((-F.count("*")).alias("neg"))
    # ranges are sampled first, which would count the words twice
    rows, _ = ranked(store(freq, "words")[0], "neg", "word", name="vec_id")
    vecs = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    return rows.join(vecs, "vec_id").select("word", "vec")


_VECTORS = "wv AS (SELECT r.w AS word, CAST(embedding AS DOUBLE[]) AS vec FROM (SELECT w, row_number() OVER (ORDER BY count(*) DESC, w) - 1 AS k FROM dp GROUP BY w) r JOIN embeddings ON vec_id = k)"
_EDGES = "e AS (SELECT a.word AS w1, b.word AS w2, pow(list_cosine_similarity(a.vec, b.vec), 2) AS s FROM wv a, wv b WHERE a.word <> b.word AND list_cosine_similarity(a.vec, b.vec) >= 0.3)"


@query(f"{DBASE}, {_VECTORS}, {_EDGES} SELECT w1, w2, round(s, 6) AS s FROM e UNION ALL SELECT word, word, 1.0 FROM wv")
def word_sims_cutoff_beta(spark, d):
    """Cosines of at least 0.3, squared, and the diagonal."""
    vecs = word_table(spark, d)
    edges = wordvecs.word_similarities(vecs, vecs.select("word"), fill_missing=True, cutoff=0.3, beta=2)
    return edges.withColumn("s", F.round("s", 6))


_SOFT_SQL = f"""{BASE}, {_IDF}, {_WEIGHTS}, {_VECTORS}, {_EDGES}, ss AS (SELECT w1, w2, s FROM e UNION ALL SELECT w, w, 1.0 FROM v),
qh AS (SELECT id, w2 AS w, sum(x * s) AS x FROM qw JOIN ss ON w = w1 GROUP BY ALL), dh AS (SELECT id, w2 AS w, sum(x * s) AS x FROM dw JOIN ss ON w = w1 GROUP BY ALL),
qz AS (SELECT a.id, sum(a.x * b.x) AS z FROM qw a JOIN qh b USING (id, w) GROUP BY a.id), dz AS (SELECT a.id, sum(a.x * b.x) AS z FROM dw a JOIN dh b USING (id, w) GROUP BY a.id),
t AS (SELECT a.id AS doc1, b.id AS doc2, sum(a.x * b.x) AS x FROM qh a JOIN dw b USING (w) GROUP BY ALL)
SELECT doc1, doc2, round(x / sqrt(qz.z * dz.z), 6) AS sim FROM t JOIN qz ON qz.id = doc1 JOIN dz ON dz.id = doc2 WHERE round(x / sqrt(qz.z * dz.z), 6) >= 0.25"""


@query(_SOFT_SQL)
def soft_cosine(spark, d):
    """Soft cosine of tf-idf vectors over word similarities."""
    q, docs = both(spark, d)
    fitted = vsm.idf(q, docs)
    edges = wordvecs.word_similarities(word_table(spark, d), fitted.select(F.col("feature").alias("word")), fill_missing=True, cutoff=0.3, beta=2)
    return vsm.soft_cosine_join(vsm.tfidf(q, fitted), vsm.tfidf(docs, fitted), edges, 0.25, 6)


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("word"), F.col("embedding").cast("array<double>").alias("vec"))


_V = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), s AS (SELECT a.vec_id AS w1, b.vec_id AS w2, list_cosine_similarity(a.x, b.x) AS s FROM v a, v b)"


@query(f"WITH {_V}, r AS (SELECT *, row_number() OVER (PARTITION BY w1 ORDER BY s DESC, w2) AS rank FROM s WHERE w1 <> w2) SELECT w1, rank, w2, round(s, 6) AS s FROM r WHERE rank <= 10")
def nearest_neighbours(spark, d):
    return wordvecs.nearest(_vectors(spark, d), n=10).withColumn("s", F.round("s", 6))


@query(f"WITH {_V.replace('list_cosine_similarity', 'list_distance')}, r AS (SELECT *, row_number() OVER (PARTITION BY w1 ORDER BY s, w2) AS rank FROM s WHERE w1 <> w2) SELECT w1, rank, w2, round(s, 6) AS s FROM r WHERE rank <= 5")
def nearest_by_distance(spark, d):
    return wordvecs.nearest(_vectors(spark, d), n=5, metric="euclidean", distance=True).withColumn("s", F.round("s", 6))


@query(f"""WITH {_V}, h AS (SELECT w1, avg(s) AS r FROM (SELECT w1, s, row_number() OVER (PARTITION BY w1 ORDER BY s DESC) AS k FROM s) WHERE k BETWEEN 2 AND 11 GROUP BY w1),
c AS (SELECT s.w1, s.w2, 2 * s - a.r - b.r AS s FROM s JOIN h a ON a.w1 = s.w1 JOIN h b ON b.w1 = s.w2), r AS (SELECT *, row_number() OVER (PARTITION BY w1 ORDER BY s DESC, w2) AS rank FROM c WHERE w1 <> w2)
SELECT w1, rank, w2, round(s, 6) AS s FROM r WHERE rank <= 5""")
def csls(spark, d):
    """Neighbours under similarity less the hubness of both sides."""
    return wordvecs.nearest(_vectors(spark, d), n=5, csls_k=10).withColumn("s", F.round("s", 6))


@query("SELECT i, round(avg(x), 6) AS x FROM (SELECT unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings) GROUP BY i")
def mean_vector(spark, d):
    return wordvecs.mean_vector(_vectors(spark, d)).select(F.posexplode("vec").alias("i", "x")).select(F.col("i").cast("bigint").alias("i"), F.round("x", 6).alias("x"))


_ZIP = "list_transform(list_zip(a.x, b.x), lambda p: abs(p[1] - p[2]))"


@query(f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)
SELECT a.vec_id, round(list_dot_product(a.x, b.x), 6) AS linear, round(list_cosine_similarity(a.x, b.x), 6) AS cosine, round(list_distance(a.x, b.x), 6) AS euclidean, round(list_sum({_ZIP}), 6) AS manhattan,
  round(tanh(list_dot_product(a.x, b.x) / len(a.x) + 1), 6) AS sigmoid, round(pow(list_dot_product(a.x, b.x) / len(a.x) + 1, 3), 6) AS polynomial, round(exp(-pow(list_distance(a.x, b.x), 2) / len(a.x)), 6) AS rbf
FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""")
def vector_kernels(spark, d):
    """Kernels and distances of each vector and the next."""
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    names = ("linear", "cosine", "euclidean", "manhattan", "sigmoid", "polynomial", "rbf")
    return pairs.select("vec_id", *(F.round(V.pairwise(n, F.col("x"), F.col("y")), 6).alias(n) for n in names))


_DENSE_SQL = f"""{DBASE}, {_VECTORS}, v AS (SELECT w, count(*) AS df FROM dc GROUP BY w), i AS (SELECT w, ln((1 + (SELECT count(*) FROM d)) / (1 + df)) + 1 AS idf FROM v),
y AS (SELECT id, w, tf * idf AS x FROM dc JOIN i USING (w)), n AS (SELECT id, sqrt(sum(x * x)) AS n FROM y GROUP BY id)
SELECT id, i, round(sum(x * v) / any_value(t), 6) + 0.0 AS x FROM (SELECT y.id, x / n.n AS x, unnest(vec) AS v, unnest(range(0, len(vec))) AS i, dn.t FROM y JOIN n ON n.id = y.id JOIN dn ON dn.id = y.id JOIN wv ON word = w) GROUP BY id, i"""


@query(f"""{BASE}, {_VECTORS}, c AS (SELECT id, i, sum(tf * x) AS x FROM (SELECT id, tf, unnest(vec) AS x, unnest(range(0, len(vec))) AS i FROM qc JOIN wv ON word = w) GROUP BY ALL)
SELECT c.id, i, round(x / t, 6) AS x FROM c JOIN qn ON qn.id = c.id""")
def mean_embedding(spark, d):
    """Each item's mean word vector, a row a coordinate."""
    out = vsm.mean_vectors(bags(spark, d, "benchmark"), word_table(spark, d))
    return out.select("id", F.posexplode("vec").alias("i", "x")).select("id", F.col("i").cast("bigint").alias("i"), F.round("x", 6).alias("x"))


@query()
def sif_embedding(spark, d):
    """Documents as frequency-weighted word vectors without their common direction."""
    docs = bags(spark, d, "documents")
    freqs = docs.select(F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("freq"))
    return vsm.sif_vectors(docs, word_table(spark, d), freqs)


@query()
def tfidf_embedding(spark, d):
    return vsm.tfidf_vectors(bags(spark, d, "documents"), word_table(spark, d))


@query()
def lsi(spark, d):
    """Documents in four latent dimensions."""
    return vsm.lsi_vectors(bags(spark, d, "documents"), 4)


# -- alignment and transport


def _candidates(spark, d):
    return setjoin.set_join(*both(spark, d), "containment", 0.5)


@query()
def local_alignment_score(spark, d):
    """Alignment scores of the item-document pairs that share half of the item's words."""
    return align.align_collections(coll(spark, d, "benchmark"), coll(spark, d, "documents"), _candidates(spark, d))


@query()
def local_alignment_full(spark, d):
    """The same with the alignments rendered."""
    return results.aligned(_candidates(spark, d), coll(spark, d, "benchmark"), coll(spark, d, "documents"))


@query(f"{_STATS}, x AS (SELECT feature, pow(freq, 1 / 1.5) AS x FROM v), e AS (SELECT min(x) AS lo, max(x) AS hi FROM x) SELECT feature, round(-2 * (x - lo) / (hi - lo), 6) + 0.0 AS \"offset\" FROM x, e")
def lookup_scorer_offsets(spark, d):
    stats = features.statistics(_indexed(spark, d))
    return align.lookup_offsets(stats).select("feature", F.round("offset", 6).alias("offset"))


@query()
def assignment_score(spark, d):
    """Best one-to-one matching of the words of the item-document pairs that share half of the item's words."""
    q, docs = both(spark, d)
    return transport.assignment_join(_candidates(spark, d), q, docs, word_table(spark, d))


@query()
def word_movers(spark, d):
    """Earth mover's distance of the same pairs."""
    q, docs = both(spark, d)
    return transport.word_movers_distance(_candidates(spark, d), q, docs, word_table(spark, d))


# -- results


@query(f"{CONTAINED} SELECT doc1, doc2, sim FROM sims ORDER BY sim DESC, doc1, doc2 LIMIT 100")
def top_matches(spark, d):
    return results.top_matches(_candidates(spark, d), 100)


@query(f"{CONTAINED} SELECT doc1, rank, doc2, sim FROM (SELECT *, row_number() OVER (PARTITION BY doc1 ORDER BY sim DESC, doc2) AS rank FROM sims) WHERE rank <= 3")
def top_k_per_query(spark, d):
    return results.ranking(_candidates(spark, d), 3)


@query(f"{CONTAINED} SELECT doc1, doc2, sim FROM sims WHERE sim > 0.6 AND sim <= 0.9")
def sim_band(spark, d):
    return results.band(_candidates(spark, d), 0.6, 0.9)


@query(f"{CONTAINED} SELECT doc1, doc2, sim FROM sims WHERE doc2 IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc1 NOT IN (SELECT item_id FROM benchmark WHERE item_id % 7 = 0)")
def white_blacklist(spark, d):
    """Documents from a whitelist, items less a blacklist."""
    good = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    bad = table(spark, d, "benchmark").where("item_id % 7 = 0").select(F.col("item_id").alias("id"))
    return results.listed(results.listed(_candidates(spark, d), whitelist=good, axis="doc2"), blacklist=bad, axis="doc1")


@query(f"{CONTAINED} SELECT doc1, doc2, sim FROM sims WHERE NOT (doc1 + doc2) % 2 = 0 ORDER BY sim DESC, doc1, doc2 LIMIT 20")
def filtered_matches(spark, d):
    """The best twenty after a predicate drops rows."""
    return results.top_matches(_candidates(spark, d), 20, drop=(F.col("doc1") + F.col("doc2")) % 2 == 0)


@query(f"{CONTAINED} SELECT doc1, doc2, sim FROM sims ORDER BY sim DESC, doc1, doc2 LIMIT 500")
def heatmap_points(spark, d):
    return results.heatmap(_candidates(spark, d), 500)


@query(f"{CONTAINED} SELECT min(sim) AS min_sim, max(sim) AS max_sim, round(avg(sim), 9) AS mean_sim, count(*) AS n FROM sims")
def heat_summary(spark, d):
    return features.heat_summary(_candidates(spark, d)).withColumn("mean_sim", F.round("mean_sim", 9))


@query(rf"""{CONTAINED}, qt AS (SELECT item_id, array_to_string(regexp_extract_all(text, '{WORD}'), ' ') AS t FROM benchmark), dt AS (SELECT doc_id, array_to_string(regexp_extract_all(text, '{WORD}'), ' ') AS t FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY doc1 ORDER BY sim DESC, doc2) AS rank FROM sims)
SELECT sim AS similarity, doc1 AS doc1id, qt.t AS doc1text, doc2 AS doc2id, dt.t AS doc2text FROM r JOIN qt ON item_id = doc1 JOIN dt ON doc_id = doc2 WHERE rank <= 3""")
def match_report(spark, d):
    """The best three of every item with their texts."""
    return results.report(top_k_per_query(spark, d), coll(spark, d, "benchmark"), coll(spark, d, "documents"))


@query(f"""{CONTAINED}, r AS (SELECT *, row_number() OVER (PARTITION BY doc1 ORDER BY sim DESC, doc2) AS rank FROM sims),
x AS (SELECT doc1, doc2, q.f AS a, d.f AS b, list_sort(list_distinct(list_intersect(q.f, d.f))) AS shared FROM r JOIN q ON q.id = doc1 JOIN d ON d.id = doc2 WHERE rank <= 1)
SELECT doc1, doc2, array_to_string(shared, ' ') AS shared, array_to_string(list_transform(list_filter(range(1, len(a) + 1), lambda i: list_contains(shared, a[i])), lambda i: i - 1), ' ') AS at1,
  array_to_string(list_transform(list_filter(range(1, len(b) + 1), lambda i: list_contains(shared, b[i])), lambda i: i - 1), ' ') AS at2 FROM x""")
def matching_words(spark, d):
    """Where both texts of each item's best match hold the words they share."""
    keys = {"benchmark": "item_id", "documents": "doc_id"}
    side = lambda name: table(spark, d, name).select(F.col(keys[name]).alias("id"), X.words(F.col("text")).alias("words"), X.tokens(F.lower("text")).alias("features"))
    best = results.ranking(_candidates(spark, d), 1)
    out = results.matching_words(best, side("benchmark"), side("documents"))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), " ").alias(c)
    return out.select("doc1", "doc2", text("shared"), text("at1"), text("at2"))


# -- evaluation: the tf-idf ranking against full containment


def _evaluated(spark, d):
    q, docs = both(spark, d)
    # both are read several times
    sims, _ = store(vsm.tfidf_join(q, docs, threshold=0.25, digits=6), "sims")
    links, _ = store(setjoin.set_join(q, docs, "containment", 1.0), "links")
    refs = links.groupBy(F.col("doc1").alias("ref_id")).agg(F.collect_list("doc2").alias("target")).select("ref_id", F.array("ref_id").alias("source"), "target")
    return sims, refs, q.select(F.col("id").alias("doc1"))


_EVAL = f"""{_TFIDF}, {JOINED}, link AS (SELECT doc1 AS ref, doc1, doc2 FROM s WHERE o / n1 >= 1), size AS (SELECT ref, count(*) AS n FROM link GROUP BY ref),
ranking AS (SELECT *, row_number() OVER (PARTITION BY doc1 ORDER BY sim DESC, doc2) AS rank FROM sims)"""


def _eval_sql(strict: bool) -> str:
    tpos, fneg = ("sum(h)", "sum(n - h)") if strict else ("count(*) FILTER (h > 0)", "count(*) FILTER (h = 0)")
    return f"""{_EVAL}, cut("at") AS (VALUES (1), (5), (10), (20)),
hit AS (SELECT "at", ref, count(*) AS h FROM link JOIN ranking USING (doc1, doc2), cut WHERE rank <= "at" GROUP BY ALL),
a AS (SELECT "at", {tpos} AS tpos, {fneg} AS fneg FROM (SELECT c."at", s.n, coalesce(h, 0) AS h FROM cut c CROSS JOIN size s LEFT JOIN hit ON hit."at" = c."at" AND hit.ref = s.ref) GROUP BY "at"),
got AS (SELECT DISTINCT "at", doc1 FROM ranking, cut WHERE rank <= "at"),
b AS (SELECT "at", count(*) AS fpos FROM got WHERE ("at", doc1) NOT IN (SELECT "at", ref FROM hit) GROUP BY "at"),
c AS (SELECT "at", count(*) AS tneg FROM q, cut WHERE q.id NOT IN (SELECT ref FROM size) AND ("at", q.id) NOT IN (SELECT "at", doc1 FROM got) GROUP BY "at"),
stat AS (SELECT cut."at", CAST(tpos AS BIGINT) AS tpos, CAST(fneg AS BIGINT) AS fneg, coalesce(fpos, 0) AS fpos, coalesce(tneg, 0) AS tneg FROM cut LEFT JOIN a USING ("at") LEFT JOIN b USING ("at") LEFT JOIN c USING ("at"))"""


@query(f"{_eval_sql(False)} SELECT * FROM stat")
def eval_stats(spark, d):
    sims, refs, queries = _evaluated(spark, d)
    return evaluate.stats(results.ranking(sims, 20), refs, queries).withColumn("at", F.col("at").cast("int"))


@query(f"{_eval_sql(True)} SELECT * FROM stat")
def eval_stats_strict(spark, d):
    sims, refs, queries = _evaluated(spark, d)
    return evaluate.stats(results.ranking(sims, 20), refs, queries, strict=True)


@query(f"""{_eval_sql(False)}, pr AS (SELECT "at", tpos / (tpos + fpos) AS p, tpos / (tpos + fneg) AS r FROM stat), m AS (SELECT "at", p, r, 2 * p * r / (p + r) AS f1, 5 * p * r / (4 * p + r) AS f2, 1.25 * p * r / (0.25 * p + r) AS fp5 FROM pr)
SELECT metric, "at", round(value, 9) AS value FROM (UNPIVOT m ON p, r, f1, f2, fp5 INTO NAME metric VALUE value)""")
def eval_metrics(spark, d):
    sims, refs, queries = _evaluated(spark, d)
    return evaluate.metrics(results.ranking(sims, 20), refs, queries).withColumn("value", F.round("value", 9))


@query(f"""{_EVAL}, cut(threshold) AS (VALUES (CAST(0.3 AS DOUBLE)), (0.5), (0.7)), kept AS (SELECT * FROM ranking, cut WHERE rank <= 20 AND sim >= threshold),
hit AS (SELECT threshold, ref, count(*) AS h FROM link JOIN kept USING (doc1, doc2) GROUP BY ALL),
a AS (SELECT threshold, count(*) FILTER (h > 0) AS tpos, count(*) FILTER (h = 0) AS fneg FROM (SELECT c.threshold, coalesce(h, 0) AS h FROM cut c CROSS JOIN size s LEFT JOIN hit ON hit.threshold = c.threshold AND hit.ref = s.ref) GROUP BY ALL),
got AS (SELECT DISTINCT threshold, doc1 FROM kept), b AS (SELECT threshold, count(*) AS fpos FROM got WHERE (threshold, doc1) NOT IN (SELECT threshold, ref FROM hit) GROUP BY ALL),
c AS (SELECT threshold, count(*) AS tneg FROM q, cut WHERE q.id NOT IN (SELECT ref FROM size) AND (threshold, q.id) NOT IN (SELECT threshold, doc1 FROM got) GROUP BY ALL),
z AS (SELECT threshold, count(*) AS nnz FROM sims, cut WHERE sim >= threshold GROUP BY ALL)
SELECT threshold, coalesce(nnz, 0) AS nnz, tpos, fneg, coalesce(fpos, 0) AS fpos, coalesce(tneg, 0) AS tneg FROM cut LEFT JOIN a USING (threshold) LEFT JOIN b USING (threshold) LEFT JOIN c USING (threshold) LEFT JOIN z USING (threshold)""")
def eval_thresholds(spark, d):
    sims, refs, queries = _evaluated(spark, d)
    return evaluate.thresholded(sims, refs, queries, [0.3, 0.5, 0.7]).select("threshold", "nnz", "tpos", "fneg", "fpos", "tneg")


# -- whole searches and streams

_PICK = "k AS (SELECT w FROM (SELECT id, w FROM qc UNION ALL SELECT id + 1000000000, w FROM dc) GROUP BY w HAVING count(*) BETWEEN 2 AND 200)"
_KEPT = f"{BASE}, {_PICK}, qk AS (SELECT id, w FROM qc JOIN k USING (w)), dk AS (SELECT id, w FROM dc JOIN k USING (w)), n1 AS (SELECT id, count(*) AS n FROM qk GROUP BY id)"


@query(f"{_KEPT}, o AS (SELECT a.id AS doc1, b.id AS doc2, count(*) AS o FROM qk a JOIN dk b USING (w) GROUP BY ALL) SELECT doc1, doc2, o / n AS sim FROM o JOIN n1 ON n1.id = doc1 WHERE o / n >= 0.5")
def search_set_based(spark, d):
    """A whole search: words in 2 to 200 texts, containment of half."""
    o = reuse.Options(criterion=features.DF.between(2, 200), threshold=0.5)
    return reuse.search(coll(spark, d, "benchmark"), coll(spark, d, "documents"), o)


@query(f"{_TFIDF} SELECT * FROM sims WHERE sim >= 0.3")
def search_vsm_based(spark, d):
    o = reuse.Options(method="vsm-based", threshold=0.25)
    sims = reuse.search(coll(spark, d, "benchmark"), coll(spark, d, "documents"), o)
    return sims.withColumn("sim", F.round("sim", 6)).where("sim >= 0.3")


@query()
def search_alignment_based(spark, d):
    """Containment candidates, aligned and scored relative to the best possible."""
    o = reuse.Options(method="alignment-based", threshold=0.3, candidates=_candidates(spark, d), scorer="lookup", normalize=True)
    return reuse.search(coll(spark, d, "benchmark"), coll(spark, d, "documents"), o)


@query(f"{CONTAINED} SELECT * FROM sims")
def stream_containment(spark, d):
    """Items arriving as a stream, against the documents."""
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    items = spark.readStream.schema(table(spark, d, "benchmark").schema).parquet(f"{d}/benchmark.parquet*")
    writer = incoming.containment_stream(items, bags(spark, d, "documents"), f"{out}/rows", "item_id")
    run = writer.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("doc1", "doc2", "sim")
