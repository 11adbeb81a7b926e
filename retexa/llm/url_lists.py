"""Operator 10, URL filters: a temporal join of captures to dated lists.

A list entry (pattern, dated, action, category) puts a pattern on or off the
list from its date on: ``block`` or ``allow`` starts an interval, ``remove``
ends it, and the pattern's next entry ends it too. A capture is held against the
entries active when it was fetched. A pattern is a host suffix on label
boundaries, with or without leading path segments; of several active patterns
the one with most labels, then most path segments, decides.

A capture's keys are all its host suffixes with all path prefixes as deep as the
list's deepest pattern, so the as-of join is an equality on the key and a range
that at most one interval of a key satisfies.

Defined results: one row a row of captures. Null or malformed URLs and null
fetch times match nothing; entries with a null pattern, date or action, or an
unknown action, don't count; of entries with one pattern and date, block goes
before allow before remove, then the greatest category; repeated entries count
once; without a list nothing is blocked; URLs are read whole however long; an
empty table gives an empty result. Other columns are carried along,
except that columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Intervals sent to every executor at most; beyond it the join shuffles.
BROADCAST_INTERVALS = 500_000
#: A backslash ends a host as a slash does, and dots at its end don't count: fetchers take both so.
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*:[/\\]{2}(?:[^/\\?#@]*@)?([^/\\?#:]*?)\.*(?:[/\\?#:]|$)"
PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*:[/\\]{2}[^/\\?#]*([^?#]*)"
RESULTS = ("host", "pattern", "action", "category", "blocked")


def segments(path: Column) -> Column:
    return F.filter(F.split(path, r"[/\\\\]"), lambda s: s != "")


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, category, since, until), disjoint for each pattern; until is null while open."""
    rank = F.when(F.col("action") == "block", 3).when(F.col("action") == "allow", 2).when(F.col("action") == "remove", 1)
    clean = F.regexp_replace(F.lower(F.trim("pattern")), "/+$", "")
    rows = entries.select(clean.alias("pattern"), F.col("dated").cast("timestamp").alias("since"), rank.alias("rank"), "action", F.col("category").cast("string").alias("category"))
    rows = rows.where("pattern <> '' and since is not null and rank is not null")
    one = rows.groupBy("pattern", "since").agg(F.max(F.struct("rank", "category", "action")).alias("e"))
    until = F.lead("since").over(W.partitionBy("pattern").orderBy("since"))
    return one.withColumn("until", until).where("e.rank > 1").select("pattern", F.col("e.action").alias("action"), F.col("e.category").alias("category"), "since", "until")


def keys(host: Column, path: Column, labels: int, depth: int) -> Column:
    """All suffixes of the host of at most ``labels`` labels, alone and before 1 to ``depth`` path segments."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(labels))), lambda k: F.array_join(F.slice(parts, n - k + 1, k), "."))
    steps = segments(path)
    tails = F.transform(F.sequence(F.lit(0), F.least(F.size(steps), F.lit(depth))), lambda k: F.when(k == 0, "").otherwise(F.concat(F.lit("/"), F.array_join(F.slice(steps, F.lit(1), k), "/"))))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(tails, lambda t: F.concat(s, t))))


def screen(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """captures with host, pattern, action and category of the deciding entry, and blocked."""
    spans = intervals(entries)
    shape = spans.select(F.size(F.split(F.split("pattern", "/")[0], r"\.")).alias("l"), (F.size(F.split("pattern", "/")) - 1).alias("d"))
    n, labels, depth = shape.agg(F.count("*"), F.coalesce(F.max("l"), F.lit(1)), F.coalesce(F.max("d"), F.lit(0))).first()
    distinct = captures.select(F.col(url).alias("_url"), F.col(fetched).cast("timestamp").alias("_at")).where("_url is not null and _at is not null").distinct()
    host = F.lower(F.regexp_extract("_url", HOST, 1))
    path = F.lower(F.regexp_extract("_url", PATH, 1))
    probes = distinct.withColumn("_host", host).where("_host <> ''").withColumn("_key", F.explode(keys(F.col("_host"), path, labels, depth)))
    spans = F.broadcast(spans) if n <= BROADCAST_INTERVALS else spans
    active = (F.col("_key") == F.col("pattern")) & (F.col("_at") >= F.col("since")) & (F.col("until").isNull() | (F.col("_at") < F.col("until")))
    order = F.struct(F.size(F.split(F.split("pattern", "/")[0], r"\.")), F.size(F.split("pattern", "/")), "pattern", "action", "category")
    best = probes.join(spans, active).groupBy("_url", "_at").agg(F.max(order).alias("_best"))
    kept = [c for c in captures.columns if c not in RESULTS]
    joined = captures.select(*kept).join(best, F.col(url).eqNullSafe(F.col("_url")) & F.col(fetched).cast("timestamp").eqNullSafe(F.col("_at")), "left")
    return joined.select(
        *kept, F.lower(F.regexp_extract(url, HOST, 1)).alias("host"), F.col("_best.pattern").alias("pattern"),
        F.col("_best.action").alias("action"), F.col("_best.category").alias("category"), F.coalesce(F.col("_best.action") == "block", F.lit(False)).alias("blocked"),
    )


def screen_sql(entries: list[tuple[str, str, str, str]], captures: str) -> str:
    """The same in SQL over a query that gives page_id, url and fetched_at."""
    rows = ", ".join(f"('{p}', TIMESTAMP '{d}', '{a}', '{c}')" for p, d, a, c in entries)
    return rf"""
WITH entry(pattern, since, action, category) AS (VALUES {rows}),
one AS (
  SELECT regexp_replace(lower(trim(pattern)), '/+$', '') AS pattern, since, max({{'r': CASE action WHEN 'block' THEN 3 WHEN 'allow' THEN 2 ELSE 1 END, 'c': category, 'a': action}}) AS e
  FROM entry GROUP BY ALL),
span AS (
  SELECT pattern, since, e, lead(since) OVER (PARTITION BY pattern ORDER BY since) AS until FROM one),
live AS (
  SELECT pattern, e.a AS action, e.c AS category, since, until, len(string_split(string_split(pattern, '/')[1], '.')) AS l, len(string_split(pattern, '/')) - 1 AS d FROM span WHERE e.r > 1),
capture AS ({captures}),
parts AS (
  SELECT DISTINCT url, fetched_at, string_split(lower(regexp_extract(url, '{HOST}', 1)), '.') AS h,
    list_filter(regexp_split_to_array(lower(regexp_extract(url, '{PATH}', 1)), '[/\\]'), lambda s: s <> '') AS p FROM capture),
suffix AS (SELECT url, fetched_at, p, array_to_string(h[len(h) - k + 1:], '.') AS s FROM parts, range(1, 129) r(k) WHERE k <= len(h)),
probe AS (SELECT url, fetched_at, CASE WHEN k = 0 THEN s ELSE s || '/' || array_to_string(p[:k], '/') END AS key FROM suffix, range(0, (SELECT max(d) + 1 FROM live)) r(k) WHERE k <= len(p)),
best AS (
  SELECT url, fetched_at, max({{'l': l, 'd': d, 'pattern': pattern, 'action': action, 'category': category}}) AS b
  FROM probe JOIN live ON key = pattern AND fetched_at >= since AND (until IS NULL OR fetched_at < until) GROUP BY ALL)
SELECT page_id, c.url, c.fetched_at, lower(regexp_extract(c.url, '{HOST}', 1)) AS host, b.pattern AS pattern, b.action AS action, b.category AS category, coalesce(b.action = 'block', false) AS blocked
FROM capture c LEFT JOIN best USING (url, fetched_at)"""
