"""Operator 1, license scans: sparse TF-IDF cosine to templates, then inheritance.

Templates are notices of a line, headers, and the whole bodies in licence_texts,
versions apart. A text's segments are its lines, the runs of neighbouring lines of
which at least half the words occur in some template, the sentences of a line and
overlapping windows of WINDOWS words in it; so a notice inside a paragraph, a
header and a whole licence file each are one segment. A segment is the TF-IDF
vector of its words and is compared with every template by cosine. It carries the
licence of the best template if that reaches ``threshold``; a text carries those
of its segments, and the best of them is its own licence.

Document frequencies come from all texts, word by word. A first scan counts them.
A second one works with the words of templates, whose frequencies are few; what
other words add to a segment's norm is bounded from below, since no weight is under
1, and segments that stay under the threshold so end here. The words of the others
are joined with their frequencies.

A text of whose words at least half lie in a segment with a licence is a licence
file and governs its directory. A document without a licence of its own inherits
from its nearest ancestor directory with a licence file; that is a join of distinct
directories with their ancestors.

Defined results: null and empty texts carry no licence but inherit; texts are read
whole however long; a null path neither inherits nor governs, a null doc_id does
like any other; of several licence files in a directory the one with the highest
score governs, then the least licence name; a document's ties go to the template
named first; repeated rows are scanned each; an empty table gives an empty result;
other columns aren't carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from retexa.llm import textkit as K
from retexa.session import discard, store

U = np.uint64
THRESHOLD, RUN_SHARE, FILE_SHARE = 0.6, 0.5, 0.5
#: Words of a window; each begins a third of one after the last.
WINDOWS = (6, 12, 24)
#: Licence directories sent to every executor at most; beyond it the join shuffles.
BROADCAST_DIRS = 500_000
#: Words that a task counts before it hands them on.
HELD = 1 << 20
STOP = np.zeros(256, bool)
STOP[[33, 46, 59, 63]] = True

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_GNU = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details."
_GNUS = (("GPL-2.0", "General Public License", "2"), ("LGPL-2.1", "Lesser General Public License", "2.1"), ("LGPL-3.0", "Lesser General Public License", "3"), ("AGPL-3.0", "Affero General Public License", "3"))
_CC = (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"))
_SPDX = "MIT Apache-2.0 GPL-2.0 GPL-3.0 LGPL-2.1 LGPL-3.0 AGPL-3.0 BSD-2-Clause BSD-3-Clause ISC MPL-1.1 MPL-2.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 Unlicense"
#: Licence and text: notices of a line, headers and whole bodies.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT), ("MIT", "Released under the MIT License."), ("Apache-2.0", _APACHE), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", _GPL), ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    *((name, _GNU.format(title, version, title)) for name, title, version in _GNUS),
    ("BSD-3-Clause", _BSD), ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."), ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."), ("ISC", _ISC), ("ISC", "Licensed under the ISC License."), ("MPL-2.0", _MPL),
    *((f"CC-{x}-4.0", f"This work is licensed under the Creative Commons {long} 4.0 International License.") for x, long in _CC), *((f"CC-{x}-4.0", f"Licensed under CC {x} 4.0.") for x, _ in _CC),
    *((x, f"SPDX-License-Identifier: {x}") for x in _SPDX.split()),
    *((f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in sorted((files("retexa.llm") / "licence_texts").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")),
)


def _hashes(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, row = K.words(b, offs)
    return K.span_hash(K.prefix_sums(b), starts, ends), starts, row


class Terms:
    """The words of templates and how often each template holds them."""

    def __init__(self, templates: Sequence[tuple[str, str]]):
        self.names = [n for n, _ in templates]
        h, _, row = _hashes(*K.buffers(K.text_column(pa.array([t for _, t in templates], pa.large_string()), lower=True)))
        self.keys = np.unique(h)
        self.tf = np.zeros((len(templates), len(self.keys)))
        np.add.at(self.tf, (row, np.searchsorted(self.keys, h)), 1)

    def number(self, h: np.ndarray) -> np.ndarray:
        """The word's place among those of templates, -1 for others."""
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, at, -1)


def weight(df, n: int):
    return np.log((1 + n) / (1 + df)) + 1


def spans(b: np.ndarray, starts: np.ndarray, row: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 word of every segment."""
    n = len(starts)
    breaks = np.concatenate([[0], np.cumsum(b == 10)])
    line = breaks[starts] + row  # a new row is a new line
    bounds = lambda new: (np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], n))
    new = np.ones(n, bool)
    new[1:] = line[1:] != line[:-1]
    first, last = bounds(new)
    seen = np.concatenate([[0], np.cumsum(known)])
    dense = seen[last] - seen[first] >= RUN_SHARE * (last - first)
    # a run is a stretch of dense lines in one row
    start = np.ones(len(first), bool)
    start[1:] = ~dense[1:] | ~dense[:-1] | (row[first[1:]] != row[first[:-1]])
    runs = np.flatnonzero(start)
    out = [(first, last), (first[runs], last[np.append(runs[1:], len(first)) - 1])]
    stops = np.concatenate([[0], np.cumsum(STOP[b] & np.append(b[1:] <= 32, True))])[starts]
    new[1:] |= stops[1:] != stops[:-1]
    out.append(bounds(new))
    for size in WINDOWS:
        step = size // 3
        long = np.flatnonzero(last - first > size)
        count = -(-(last[long] - first[long] - size) // step) + 1
        k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = np.minimum(np.repeat(first[long], count) + k * step, np.repeat(last[long], count) - size)
        out.append((at, at + size))
    a, z = (np.concatenate(x) for x in zip(*out))
    both = np.unique(a * (n + 1) + z)
    return both // (n + 1), both % (n + 1)


@dataclass(frozen=True)
class Scanner:
    """Weights of the templates' words and the unit vectors of the templates."""

    terms: Terms
    idf: np.ndarray
    unit: np.ndarray
    most: np.ndarray

    @classmethod
    def fitted(cls, terms: Terms, df: np.ndarray, n: int) -> Scanner:
        idf = weight(df, n)
        w = terms.tf * idf
        unit = (w / np.linalg.norm(w, axis=1, keepdims=True)).T.copy()
        return cls(terms, idf, unit, idf * unit.max(axis=1))

    def segments(self, b: np.ndarray, offs: np.ndarray, threshold: float):
        """Segments that can reach the threshold: row, share of the row's words, squared norm
        of template words, products (segment, template, product) and other words (segment, hash, count)."""
        h, starts, row = _hashes(b, offs)
        if not len(h):
            return None
        term = self.terms.number(h)
        known = term >= 0
        a, z = spans(b, starts, row, known)
        # products add up over the words as they stand, each at most its largest with any template;
        # a norm's square is at least the sum of the words' squared weights, those of other words at least 1
        total = lambda x: (s := np.concatenate([[0.0], np.cumsum(x)]))[z] - s[a]
        product, least = total(np.where(known, self.most[term], 0.0)), total(np.where(known, self.idf[term] ** 2, 1.0))
        able = (product > 1e-9) & (product >= threshold * np.sqrt(np.maximum(least, 0)) - 1e-6)
        a, z = a[able], z[able]
        if not len(a):
            return None
        size = z - a
        seg = np.repeat(np.arange(len(a)), size)
        word = np.arange(size.sum()) + np.repeat(a - (np.cumsum(size) - size), size)
        order = np.lexsort((h[word], seg))
        seg, word = seg[order], word[order]
        new = np.ones(len(seg), bool)
        new[1:] = (seg[1:] != seg[:-1]) | (h[word[1:]] != h[word[:-1]])
        at = np.flatnonzero(new)
        tf = np.diff(np.append(at, len(seg))).astype(np.float64)
        seg, word = seg[at], word[at]
        mine = known[word]
        w = tf[mine] * self.idf[term[word[mine]]]
        norm = np.bincount(seg[mine], w * w, minlength=len(a))
        least = np.sqrt(norm + np.bincount(seg[~mine], tf[~mine] ** 2, minlength=len(a)))
        # products with all templates, of segments whose template words weigh enough
        enough = norm >= (threshold * least) ** 2 - 1e-9
        at = np.flatnonzero(enough[seg[mine]])
        owner = seg[mine][at]
        heads = np.flatnonzero(np.diff(owner, prepend=-1))
        if not len(heads):
            return None
        dot = np.empty((len(heads), self.unit.shape[1]))
        ends = np.append(heads[1:], len(owner))
        for lo in range(0, len(heads), 512):
            hi = min(lo + 512, len(heads))
            part = slice(heads[lo], ends[hi - 1])
            dot[lo:hi] = np.add.reduceat(self.unit[term[word[mine][at[part]]]] * w[at[part]][:, None], heads[lo:hi] - heads[lo], axis=0)
        owner = owner[heads]
        i, k = np.nonzero(dot >= threshold * least[owner][:, None] - 1e-9)
        live, place = np.unique(owner[i], return_inverse=True)
        keep = np.isin(seg, live) & ~mine
        share = size / np.bincount(row, minlength=len(offs) - 1)[row[a]]
        return row[a[live]], share[live], norm[live], (place, k, dot[i, k]), (np.searchsorted(live, seg[keep]), h[word[keep]].view(np.int64), tf[keep])


def frequencies(docs: DataFrame) -> DataFrame:
    """(h, df, texts): the documents that hold each word, and in a row with texts those that hold any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, texts = [], 0, 0

        def out() -> pa.RecordBatch:
            h = np.concatenate([x for x, _ in held]) if held else np.zeros(0, U)
            keys, place = np.unique(h, return_inverse=True)
            df = np.bincount(place, np.concatenate([c for _, c in held]) if held else None, minlength=len(keys)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(df), pa.array(np.zeros(len(keys), bool))], ["h", "df", "texts"])

        for batch in batches:
            low = K.text_column(batch["text"], lower=True)
            for i, j in K.blocks(low):
                h, _, row = _hashes(*K.buffers(low.slice(i, j - i)))
                order = np.lexsort((row, h))
                h, row = h[order], row[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                keys, df = np.unique(h[new], return_counts=True)
                held.append((keys, df))
                size, texts = size + len(keys), texts + len(np.unique(row))
                if size > HELD:
                    yield out()
                    held, size = [], 0
        yield out()
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([texts]), pa.array([True])], ["h", "df", "texts"])

    return docs.select("text").mapInArrow(run, "h bigint, df bigint, texts boolean").groupBy("texts", "h").agg(F.sum("df").alias("df"))


def parent(path: Column) -> Column:
    """Directory of a path; the empty string for the root."""
    return F.regexp_replace(F.regexp_replace(path, "[^/]*$", ""), "/+$", "")


def ancestors(directory: Column) -> Column:
    """The directory, its ancestors and the root with their depths."""
    parts = F.filter(F.split(directory, "/"), lambda s: s != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("dir"), k.alias("depth")))


SEGMENTS = "array<struct<share: double, norm: double, products: array<struct<k: int, x: double>>, others: array<struct<h: bigint, tf: double>>>>"


def _scanned(scanner: Scanner, threshold: float):
    kind = pa.struct([("share", pa.float64()), ("norm", pa.float64()), ("products", pa.list_(pa.struct([("k", pa.int32()), ("x", pa.float64())]))), ("others", pa.list_(pa.struct([("h", pa.int64()), ("tf", pa.float64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = K.text_column(batch["text"], lower=True)
            for i, j in K.blocks(low):
                found: list[list[dict]] = [[] for _ in range(j - i)]
                got = scanner.segments(*K.buffers(low.slice(i, j - i)), threshold)
                if got is not None:
                    row, share, norm, (ps, pk, px), (os_, oh, ot) = got
                    cut, end = np.searchsorted(ps, np.arange(len(row) + 1)), np.searchsorted(os_, np.arange(len(row) + 1))
                    for s, r in enumerate(row):
                        products = [{"k": int(k), "x": float(x)} for k, x in zip(pk[cut[s] : cut[s + 1]], px[cut[s] : cut[s + 1]])]
                        others = [{"h": int(h), "tf": float(t)} for h, t in zip(oh[end[s] : end[s + 1]], ot[end[s] : end[s + 1]])]
                        found[r].append({"share": float(share[s]), "norm": float(norm[s]), "products": products, "others": others})
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), batch["path"].slice(i, j - i), pa.array(found, pa.list_(kind))], ["doc_id", "path", "segments"])

    return run


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, path, text) -> (doc_id, path, licence, licences, score, is_file, inherited_from)."""
    spark = docs.sparkSession
    K.small_batches(spark)
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("path").cast("string").alias("path"), "text")
    terms = Terms(templates)
    freq, p1 = store(frequencies(base), "frequencies")
    n = freq.where("texts").agg(F.sum("df")).first()[0] or 0
    own = spark.createDataFrame(pa.table({"h": terms.keys.view(np.int64)}))
    got = freq.where("not texts").join(F.broadcast(own), "h", "left_semi").select("h", "df").toArrow()  # at most a row a template word
    df = np.zeros(len(terms.keys))
    df[np.searchsorted(terms.keys, got["h"].to_numpy().view(U))] = got["df"].to_numpy()
    scanner = Scanner.fitted(terms, df, n)
    seen = base.mapInArrow(_scanned(scanner, threshold), f"doc_id bigint, path string, segments {SEGMENTS}")
    seen, p2 = store(seen.withColumn("row", F.monotonically_increasing_id()), "segments")
    segs = seen.select("row", F.posexplode("segments").alias("seg", "s"))
    idf = F.ln((1 + F.lit(n)) / (1 + F.col("df"))) + 1
    words = segs.select("row", "seg", F.explode("s.others").alias("o")).select("row", "seg", "o.h", "o.tf").join(freq.where("not texts"), "h")
    rest = words.groupBy("row", "seg").agg(F.sum(F.pow(F.col("tf") * idf, F.lit(2))).alias("rest"))
    cosine = F.transform("s.products", lambda p: F.struct((p["x"] / F.sqrt(F.col("s.norm") + F.coalesce("rest", F.lit(0.0)))).alias("c"), (-p["k"]).alias("k")))
    hits = segs.join(rest, ["row", "seg"], "left").select("row", "s.share", F.array_max(cosine).alias("best")).where(F.col("best.c") >= threshold)
    name = lambda k: F.element_at(F.array(*map(F.lit, terms.names)), 1 - k)
    each = hits.groupBy("row").agg(F.max("best").alias("best"), F.array_sort(F.collect_set(name(F.col("best.k")))).alias("licences"), F.max("share").alias("share"))
    each = each.select("row", name(F.col("best.k")).alias("licence"), "licences", F.col("best.c").alias("score"), (F.col("share") >= FILE_SHARE).alias("is_file"))
    none = F.array().cast("array<string>")
    seen, p3 = store(seen.drop("segments").join(each, "row", "left").select("doc_id", "path", "licence", F.coalesce("licences", none).alias("licences"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("is_file", F.lit(False)).alias("is_file")), "licences")
    tidy = F.array_join(F.filter(F.split(parent(F.col("path")), "/"), lambda s: s != ""), "/")
    seen = seen.withColumn("dir", tidy)
    # the best file of a directory; aggregated before the shuffle, so a hot directory is no hot task
    top = seen.where("is_file and dir is not null").groupBy("dir").agg(F.max("score").alias("score"))
    files_ = seen.where("is_file and dir is not null").select("dir", "licence", "score").distinct().join(top, ["dir", "score"]).groupBy("dir").agg(F.min("licence").alias("inherited"))
    files_, p4 = store(files_, "files")
    few = files_.count() <= BROADCAST_DIRS
    dirs = seen.where("licence is null and dir is not null").select("dir").distinct()
    chain = dirs.select(F.col("dir").alias("below"), F.explode(ancestors(F.col("dir"))).alias("up")).select("below", "up.dir", "up.depth")
    near = chain.join(F.broadcast(files_) if few else files_, "dir").groupBy("below").agg(F.max(F.struct("depth", "dir", "inherited")).alias("from"))
    joined = seen.join(near, (F.col("dir") == F.col("below")) & F.col("licence").isNull(), "left")
    out, _ = store(joined.select("doc_id", "path", F.coalesce("licence", "from.inherited").alias("licence"), "licences", "score", "is_file", F.col("from.dir").alias("inherited_from")), "scan")
    discard(spark, p1, p2, p3, p4)
    return out
