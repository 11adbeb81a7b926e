"""Words of a text and the features made of them, as lazy Column expressions.

A document's words are one array of structs (token, lemma, pos), so parallel
fields always have equal length. Everything here is a JVM expression but
the Unicode normalisation in ``strip_marks``.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Runs of letters and digits; the same in Java's and RE2's syntax.
TOKEN = r"[\p{L}\p{N}]+"
WORD = "struct<token:string,lemma:string,pos:string>"
#: ASCII punctuation without the backslash.
PUNCTUATION = r"^[!-/:-@\[\]-`{-~]+$"


def tokens(text: Column, pattern: str = TOKEN) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def words(text: Column, pattern: str = TOKEN) -> Column:
    """Words of a plain text; without a lemmatiser the lemma is the lower-cased token."""
    return F.transform(tokens(text, pattern), lambda t: F.struct(t.alias("token"), F.lower(t).alias("lemma"), F.lit(None).cast("string").alias("pos")))


def split_words(text: Column) -> Column:
    """Words between white space, punctuation included."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")
    return F.transform(parts, lambda t: F.struct(t.alias("token"), F.lower(t).alias("lemma"), F.lit(None).cast("string").alias("pos")))


def joined(ws: Column, name: str = "token") -> Column:
    """The document as text: its tokens with single spaces."""
    return F.array_join(F.transform(ws, lambda w: w[name]), " ")


@F.pandas_udf(T.StringType())
def _decomposed(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFD")


def strip_marks(text: Column | str) -> Column:
    """Without diacritics: canonical decomposition less the combining marks of every script."""
    return F.regexp_replace(_decomposed(text), r"\p{Mn}", "")


@dataclass(frozen=True)
class TokenRule:
    """Drop words whose field matches at its start, or with keep=True those that don't."""

    regex: str
    keep: bool = False


@dataclass(frozen=True)
class Preprocess:
    """Which words of a document become features.

    A word is judged in a fixed order: punctuation, stopword, rules, unknown
    lemma, lower case. An unknown lemma is replaced by another field if
    ``replace_unk``, which wins over ``drop_unk``.
    """

    field: str = "lemma"
    lower: bool = True
    rules: Mapping[str, TokenRule] = dataclasses.field(default_factory=dict)
    drop_punctuation: bool = True
    punct_field: str = "token"
    replace_unk: bool = False
    drop_unk: bool = False
    unk_token: str = "$unk$"
    unk_field: str = "token"
    stopwords: Sequence[str] = ()
    stop_field: str = "lemma"

    def features(self, ws: Column) -> Column:
        def keep(w: Column) -> Column:
            ok = F.lit(True)
            if self.drop_punctuation:
                ok = ok & ~F.coalesce(w[self.punct_field].rlike(PUNCTUATION), F.lit(False))
            if self.stopwords:
                ok = ok & ~F.coalesce(F.lower(w[self.stop_field]).isin(*sorted(set(self.stopwords))), F.lit(False))
            for name, rule in self.rules.items():
                hit = F.coalesce(w[name].rlike(f"^(?:{rule.regex})"), F.lit(False))
                ok = ok & (hit if rule.keep else ~hit)
            if self.drop_unk and not self.replace_unk:
                ok = ok & ~F.coalesce(w["lemma"] == self.unk_token, F.lit(False))
            return ok

        def take(w: Column) -> Column:
            out = w[self.field]
            if self.replace_unk:
                out = F.when(w["lemma"] == self.unk_token, w[self.unk_field]).otherwise(out)
            return F.lower(out) if self.lower else out

        return F.transform(F.filter(ws, keep), take)


def ngrams(features: Column, lo: int = 1, hi: int = 1, skip: int = 0, sep: str = "--") -> Column:
    """N-grams of all orders from lo to hi, by order and then position. With skip,
    an order n > 1 takes from each full window of n + skip features its first one
    with every choice of n - 1 others, in order."""
    if not 1 <= lo <= hi or skip < 0:
        raise ValueError("need 1 <= lo <= hi and skip >= 0")
    size, parts, none = F.size(features), [], F.array().cast("array<string>")

    def contiguous(n: int) -> Column:
        # zips of shifted arrays: a slice a gram would copy the document each time
        m = size - n + 1
        grams = F.slice(features, F.lit(1), m)
        for k in range(1, n):
            grams = F.zip_with(grams, F.slice(features, F.lit(k + 1), m), lambda x, y: F.concat(x, F.lit(sep), y))
        return grams

    def skipping(n: int, span: int) -> Column:
        picks = list(combinations(range(1, span), n - 1))
        starts = F.sequence(F.lit(1), size - span + 1)
        return F.flatten(F.transform(starts, lambda i: F.array(*(F.concat_ws(sep, F.element_at(features, i), *(F.element_at(features, i + F.lit(p)) for p in pick)) for pick in picks))))

    for n in range(lo, hi + 1):
        span = n + (skip if n > 1 else 0)
        parts.append(F.when(size >= span, contiguous(n) if span == n else skipping(n, span)).otherwise(none))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def doc_features(features: Column, distinct: bool = False, least: int = 0, density: float = 0.0, n_words: Column | None = None, post: Callable[[Column], Column] | None = None) -> Column:
    """A document's features, emptied if they are fewer than ``least`` or fewer than
    ``density`` times the words before preprocessing."""
    out = post(features) if post else features
    size, empty = F.size(out), F.array().cast("array<string>")
    if density and n_words is not None:
        out = F.when(F.try_divide(size, n_words) >= density, out).otherwise(empty)
    if least:
        out = F.when(size >= least, out).otherwise(empty)
    return F.array_distinct(out) if distinct else out


def window_starts(n: Column, window: int = 20, overlap: int = 5, drop_contained_tail: bool = False) -> Column:
    """Where the windows of n > 0 words start."""
    if not 0 <= overlap < window:
        raise ValueError("need 0 <= overlap < window")
    last = F.greatest(F.lit(0), n - overlap - 1) if drop_contained_tail else n - 1
    return F.sequence(F.lit(0), last, F.lit(window - overlap))


def shingles(ws: Column, window: int = 20, overlap: int = 5, drop_contained_tail: bool = False) -> Column:
    """Windows (start, stop, words) every window - overlap words; the last ones are
    short, and may lie within their predecessor unless dropped."""
    n = F.size(ws)
    spans = F.transform(window_starts(n, window, overlap, drop_contained_tail), lambda s: F.struct(s.alias("start"), F.least(s + window, n).alias("stop"), F.slice(ws, s + 1, F.least(F.lit(window), n - s)).alias("words")))
    return F.when(n > 0, spans).otherwise(F.slice(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("stop"), F.slice(ws, 1, 0).alias("words"))), 1, 0))


def printable_id(*parts: Column) -> Column:
    """Nested ids as one string."""
    return F.concat_ws("-", *parts)
