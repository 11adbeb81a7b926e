"""Operator 3, mixing sources to target weights by iterative proportional fitting.

Tokens are summed over the cells of source, language and topic. Raking scales
the cell sums in turn to the target share of every source, language and topic
until all three marginals hold. A document's weight is its cell's raked sum over
its raw sum; the sampling probability is min(1, c * weight), with c solved so
that the expected tokens are ``rate`` of all tokens. A document is drawn when
the uniform number of its key (md5 of seed and doc_id) is below its probability.

Only the cell table, as many rows as there are combinations of categories,
reaches the driver; documents are scanned for the sums and once more to draw.

Targets map a category to its share. Categories that a mapping doesn't list
share what it leaves of 1 in proportion to their tokens, or, where it leaves
nothing, keep their raw share while the listed divide the remainder; without a mapping the
target is tokens ** alpha, scaled to 1. Listed categories without tokens drop
out, the rest is scaled to 1.

Defined results: a null category is a category of its own, listed under None;
null texts hold no tokens and have the probability of their cell; texts are read
whole however long; a cell without
tokens has probability 0; repeated rows share a key and a decision; rows without
doc_id use a digest of the text as key; an empty table stays empty; other
columns are carried along, except that _mix_topic, _mix_tokens and _mix_p are
replaced.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = ("source", "lang", "topic")
#: Cells sent to every executor at most; beyond it the join shuffles.
BROADCAST_CELLS = 200_000
Targets = Mapping[str, Mapping[str | None, float]]


def content_type(text: Column) -> Column:
    """A topic for tables that carry none: what kind of text it is."""
    return (
        F.when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(text, F.lit("icense")), "licence")
        .when(text.rlike("[0-9]"), "numeric")
        .when(F.length(text) >= 4000, "long prose")
        .otherwise("prose")
    )


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint")


def uniform(seed: int) -> Column:
    """A number in [0, 1) fixed by seed and doc_id."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(2**52)


def margin(names: list, tokens: np.ndarray, want: Mapping | None, alpha: float) -> np.ndarray:
    """Target share of each category, given the tokens of each."""
    if want is None:
        share = np.where(tokens > 0, np.maximum(tokens, 1) ** alpha, 0.0)
    else:
        listed = np.array([n in want for n in names], bool)
        share = np.array([max(0.0, want.get(n, 0.0)) for n in names])
        left, rest = max(0.0, 1 - sum(max(0.0, x) for x in want.values())), tokens[~listed].sum()
        if left > 1e-12:
            share[~listed] = left * tokens[~listed] / rest if rest else 0.0
        elif rest:  # nothing is left for them: they keep their raw share, the listed divide what remains
            raw = rest / tokens.sum()
            held = np.where(tokens > 0, share, 0.0).sum()
            share = np.where(listed, share * ((1 - raw) / held if held else 0.0), tokens / tokens.sum())
        share = np.where(tokens > 0, share, 0.0)
    return share / share.sum() if share.sum() else share


def rake(tokens: np.ndarray, codes: list[np.ndarray], shares: list[np.ndarray], rounds: int = 500, tolerance: float = 1e-12) -> np.ndarray:
    """Cell shares with the given marginals, in the closest form to the tokens. Warns
    if the marginals are still off, as they are where no cells can meet them."""
    w = tokens / tokens.sum() if tokens.sum() else tokens.astype(float)
    for _ in range(rounds):
        off = 0.0
        for code, share in zip(codes, shares):
            now = np.bincount(code, w, minlength=len(share))
            off = max(off, np.abs(now - share).max(initial=0.0))
            w = w * np.divide(share, now, out=np.zeros_like(share), where=now > 0)[code]
        if off < tolerance:
            break
    else:
        if off > 1e-6:
            warnings.warn(f"raking ended after {rounds} rounds with a marginal {off:.2g} off its target", stacklevel=2)
    return w


def calibrate(tokens: np.ndarray, raked: np.ndarray, rate: float) -> np.ndarray:
    """min(1, c * raked / tokens) for each cell, with rate of all tokens expected."""
    p = np.zeros(len(tokens))
    live = np.flatnonzero((tokens > 0) & (raked > 0))
    if not len(live):
        return p
    t, r = tokens[live].astype(float), raked[live]
    order = np.argsort(t / r, kind="stable")
    before = np.concatenate([[0.0], np.cumsum(t[order])[:-1]])
    rest = np.cumsum(r[order][::-1])[::-1]
    c = (rate * tokens.sum() - before) / rest
    fits = np.flatnonzero(c <= (t / r)[order])
    scale = c[fits[0]] if len(fits) else np.inf
    p[live] = np.minimum(1.0, scale * r / t)
    return p


@dataclass(frozen=True)
class Plan:
    """The cell table with tokens, raked share and probability."""

    cells: pa.Table


def plan(docs: DataFrame, targets: Targets, rate: float, alpha: float = 0.5, topic: Column | None = None, tokens: Column | None = None) -> Plan:
    table = _marked(docs, topic, tokens).groupBy(*_CELL).agg(F.sum("_mix_tokens").alias("tokens")).toArrow()
    names = [table[c].to_pylist() for c in _CELL]
    count = table["tokens"].to_numpy().astype(float) if len(table) else np.zeros(0)
    codes, shares = [], []
    for dim, column in zip(DIMENSIONS, names):
        kinds = sorted(set(column), key=lambda x: (x is not None, x))
        place = {k: i for i, k in enumerate(kinds)}
        code = np.array([place[x] for x in column], np.int64)
        codes.append(code)
        shares.append(margin(kinds, np.bincount(code, count, minlength=len(kinds)), targets.get(dim), alpha))
    raked = rake(count, codes, shares)
    p = calibrate(count, raked, rate)
    return Plan(table.append_column("raked", pa.array(raked)).append_column("_mix_p", pa.array(p)))


_CELL = ("_mix_source", "_mix_lang", "_mix_topic")
_NEW = ("_mix_topic", "_mix_tokens", "_mix_p")


def _marked(docs: DataFrame, topic: Column | None, tokens: Column | None) -> DataFrame:
    topic = content_type(F.col("text")) if topic is None else topic
    tokens = word_count(F.col("text")) if tokens is None else tokens
    return docs.drop(*_NEW).withColumns({"_mix_source": F.col("source"), "_mix_lang": F.col("lang"), "_mix_topic": topic, "_mix_tokens": tokens})


def mix(docs: DataFrame, targets: Targets, rate: float = 0.6, alpha: float = 0.5, seed: int = 3, topic: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """The drawn rows of docs with _mix_topic, _mix_tokens and _mix_p added."""
    made = plan(docs, targets, rate, alpha, topic, tokens)
    if not len(made.cells):
        return _marked(docs, topic, tokens).drop("_mix_source", "_mix_lang").withColumn("_mix_p", F.lit(0.0))
    cells = docs.sparkSession.createDataFrame(made.cells.drop_columns(["tokens", "raked"]))
    rows = _marked(docs, topic, tokens)
    side = cells.select(*(F.col(c).alias(f"{c}_") for c in _CELL), "_mix_p")
    same = [rows[c].eqNullSafe(side[f"{c}_"]) for c in _CELL]
    joined = rows.join(F.broadcast(side) if len(made.cells) <= BROADCAST_CELLS else side, same[0] & same[1] & same[2])
    return joined.where(uniform(seed) < F.col("_mix_p")).select(*(c for c in docs.columns if c not in _NEW), *_NEW)


def mix_sql(targets: Targets, rate: float, alpha: float, seed: int, rounds: int = 40) -> str:
    """The same in SQL, with a fixed number of raking rounds."""

    def share(dim: str) -> str:
        want = targets.get(dim)
        if want is None:
            return f"SELECT {dim}, CASE WHEN sum(n) > 0 THEN pow(sum(n), {alpha}) ELSE 0 END AS x FROM cells GROUP BY {dim}"
        case = " ".join(f"WHEN {dim} = '{k}' THEN {v}" for k, v in want.items())
        listed = ", ".join(f"'{k}'" for k in want)
        left = max(0.0, 1 - sum(want.values()))
        rest = f"{left} * sum(n) / (SELECT sum(n) FROM cells WHERE {dim} NOT IN ({listed}))" if left > 1e-12 else "0"
        return f"SELECT {dim}, CASE WHEN sum(n) = 0 THEN 0 {case} ELSE {rest} END AS x FROM cells GROUP BY {dim}"

    parts = ", ".join(f"want_{d} AS (SELECT {d}, x / sum(x) OVER () AS x FROM ({share(d)}))" for d in DIMENSIONS)
    step = "SELECT i, source, lang, topic, xs, xl, xt, w FROM rake"
    for dim, x in zip(DIMENSIONS, ("xs", "xl", "xt")):
        step = f"SELECT i, source, lang, topic, xs, xl, xt, CASE WHEN w > 0 THEN w * {x} / sum(w) OVER (PARTITION BY {dim}) ELSE 0 END AS w FROM ({step})"
    return f"""
WITH RECURSIVE marked AS (
  SELECT doc_id, source, lang, text,
    CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, 'icense') THEN 'licence'
      WHEN regexp_matches(text, '[0-9]') THEN 'numeric' WHEN length(text) >= 4000 THEN 'long prose' ELSE 'prose' END AS topic,
    coalesce(len(regexp_extract_all(text, '\\S+')), 0) AS n
  FROM documents),
cells AS (SELECT source, lang, topic, CAST(sum(n) AS DOUBLE) AS n FROM marked GROUP BY ALL),
{parts},
rake AS (
  SELECT 0 AS i, c.source, c.lang, c.topic, s.x AS xs, l.x AS xl, t.x AS xt, c.n / sum(c.n) OVER () AS w
  FROM cells c JOIN want_source s USING (source) JOIN want_lang l USING (lang) JOIN want_topic t USING (topic)
  UNION ALL
  SELECT i + 1, source, lang, topic, xs, xl, xt, w FROM ({step}) WHERE i < {rounds}),
raked AS (SELECT source, lang, topic, n, w FROM rake JOIN cells USING (source, lang, topic) WHERE i = {rounds}),
filled AS (
  SELECT n / w AS bound, ({rate} * (SELECT sum(n) FROM cells) - coalesce(sum(n) OVER (ORDER BY n / w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY n / w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c
  FROM raked WHERE n > 0 AND w > 0),
scale AS (SELECT coalesce((SELECT c FROM filled WHERE c <= bound ORDER BY bound LIMIT 1), 1e300) AS c),
chance AS (SELECT source, lang, topic, CASE WHEN n > 0 AND w > 0 THEN least(1.0, c * w / n) ELSE 0 END AS p FROM raked, scale)
SELECT doc_id, source, lang, topic, n AS n_words, round(p, 6) AS probability
FROM marked JOIN chance USING (source, lang, topic)
WHERE CAST('0x' || substr(md5('{seed}:' || doc_id), 1, 13) AS BIGINT) / 4503599627370496.0 < p"""
