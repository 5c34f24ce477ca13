"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

DataFrame functions only. A template with up to ``s`` five-word shingles (s a power of two) is looked for in windows of
2*s shingles that start every s shingles, so every stretch of s shingles lies whole in some window. A window that holds
at least 0.8 of a template has Jaccard similarity of at least 0.19 with it; with ``BANDS`` one-row bands such a window
shares a band's minimum with probability 1 - 0.81**40 > 0.9997.

A window can share a minimum only if it holds the shingle that is the template's minimum in some band. Those shingles
are few, so texts and windows without any of them are passed over before any MinHash is computed; this is the same
result, not an approximation. A library with more than ``LITERALS`` such shingles skips that shortcut.

Templates can share wording (two versions of a notice, a full text and the grant within it). A finding gives way if the
words it matched overlap those of a better one: more contained, then more shingles, then the later name.

Defined results: null and empty texts and texts under five words hold nothing; findings belong to a text, so rows with
equal or null doc_id have the findings of their own text each; templates under five words are not found; an empty
library finds nothing; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import LOWER, UPPER, materialize

SHINGLE, BANDS, LEAST, LITERALS = 5, 40, 0.8, 5000
# Public wordings of common licenses: notices, grants and full texts without the copyright line.
TEMPLATES = {
    "agpl-3-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "apache-2-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "apache-2-notice": "Licensed under the Apache License, Version 2.0.",
    "bsd-3-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-3-notice": "Released under the BSD 3-Clause License.",
    "cc-by-4-notice": "Licensed under CC BY 4.0.",
    "cc-by-nc-4-notice": "Licensed under CC BY-NC 4.0.",
    "bsd-2-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "cc-by-sa-4-notice": "Licensed under CC BY-SA 4.0.",
    "gpl-2-notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "gpl-3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "lgpl-3-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-notice": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mpl-2-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense-grant": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def with_shingles(texts: DataFrame, text: str) -> DataFrame:
    """Adds ``shingles``: hashes of all five-word runs, in order."""
    words = F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), _GAPS), "")
    # explode(array(x)) computes x once a row: filters that use it later aren't pushed below with x written out again
    listed = texts.withColumn("_words", F.explode(F.array(words)))
    last = F.size("_words") - SHINGLE
    shingle = lambda i: F.xxhash64(*[F.get(F.col("_words"), i + k) for k in range(SHINGLE)])
    hashed = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), shingle)).otherwise(F.array().cast("array<bigint>"))
    return listed.withColumn("shingles", F.explode(F.array(hashed))).drop("_words")


def signature(shingles: Column) -> Column:
    """Per band the minimum of a hash of the shingles."""
    return F.array(*[F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, F.lit(b)))) for b in range(BANDS)])


def library(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(template, s, own shingles, band minima, shingles that are a minimum)."""
    if not templates:
        return with_shingles(spark.sql("select '' as template, '' as text where false"), "text").select("template", F.lit(1).alias("s"), "shingles", F.col("shingles").alias("minima"), F.col("shingles").alias("keys"))
    rows = F.array(*[F.struct(F.lit(k).alias("template"), F.lit(v).alias("text")) for k, v in sorted(templates.items())])
    named = spark.range(1).select(F.explode(rows).alias("r")).select("r.*")
    own = with_shingles(named, "text").select("template", F.array_distinct("shingles").alias("shingles")).where(F.size("shingles") > 0)
    keys = F.array(*[F.array_min(F.transform("shingles", lambda h: F.struct(F.xxhash64(h, F.lit(b)).alias("v"), h.alias("h"))))["h"] for b in range(BANDS)])
    return own.select("template", F.pow(F.lit(2), F.ceil(F.log2(F.size("shingles")))).cast("int").alias("s"), "shingles", signature(F.col("shingles")).alias("minima"), F.array_distinct(keys).alias("keys"))


def _starts(s: int, keys: list[int] | None) -> Column:
    """First shingles of the windows: all of them, or those of windows that hold one of ``keys``."""
    if keys is None:
        return F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("shingles") - 1), F.lit(s))
    at = F.filter(F.transform("shingles", lambda h, i: F.when(h.isin(*keys), F.floor(i / s).cast("int") * s)), lambda i: i.isNotNull())
    return F.filter(F.array_distinct(F.concat(at, F.transform(at, lambda i: i - s))), lambda i: i >= 0)


def scan_licenses(documents: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(doc_id, text_hash, template, containment, first, last) of every verified template of every text, best window.

    first, last: shingles of the text that the template's first and last match stand at.
    """
    spark = documents.sparkSession
    known = materialize(library(spark, templates), "templates")
    sizes = {r.s: r.n for r in known.select("s", F.explode("keys").alias("k")).groupBy("s").agg(F.countDistinct("k").alias("n")).collect()}  # a row a power of two
    key = ["doc_id", "text_hash"]
    texts = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    texts = with_shingles(texts, "text").select(*key, "shingles").where(F.size("shingles") > 0)
    literal: dict[int, list[int]] = {}
    if sum(sizes.values()) <= LITERALS:
        listed = known.select("s", F.explode("keys").alias("k")).distinct().collect()  # at most LITERALS rows
        literal = {s: [r.k for r in listed if r.s == s] for s in sizes}
        if literal:
            every = sorted({r.k for r in listed})
            texts = texts.where(F.exists("shingles", lambda h: h.isin(*every)))
    texts = materialize(texts, "shingled")
    found = None
    for s in sorted(sizes):
        # windows are cut inside the array: a row of its own for each start would copy the whole text's shingles
        windows = F.transform(_starts(s, literal.get(s)), lambda i: F.struct(i.alias("start"), F.slice("shingles", i + 1, 2 * s).alias("part")))
        windows = texts.select(*key, F.explode(windows).alias("w")).select(*key, "w.start", "w.part")
        banded = windows.select(*key, "start", "part", F.posexplode(signature(F.col("part"))).alias("band", "value"))
        own = known.where(F.col("s") == s).select("template", "shingles", F.posexplode("minima").alias("band", "value"))
        hits = banded.join(own, ["band", "value"])
        common = F.size(F.array_intersect("shingles", "part"))
        at = F.filter(F.transform("part", lambda h, i: F.when(F.array_contains("shingles", h), F.col("start") + i)), lambda i: i.isNotNull())
        verified = hits.withColumn("common", common).where(F.col("common") >= F.lit(LEAST) * F.size("shingles"))
        verified = verified.select(*key, "template", (F.col("common") / F.size("shingles")).alias("containment"), "common", F.array_min(at).alias("first"), F.array_max(at).alias("last"))
        found = verified if found is None else found.union(verified)
    if found is None:
        return documents.select(*[F.lit(None).cast(k).alias(c) for c, k in (("doc_id", "long"), ("text_hash", "long"), ("template", "string"), ("containment", "double"), ("first", "int"), ("last", "int"))]).limit(0)
    order = lambda x: F.struct(x["containment"], x["common"], x["template"])
    best = F.max(F.struct("containment", (-F.col("first")).alias("back"), "common", "last")).alias("b")
    one = found.groupBy(*key, "template").agg(best).select(*key, F.struct("template", "b.containment", "b.common", (-F.col("b.back")).alias("first"), "b.last").alias("f"))
    listed = one.groupBy(*key).agg(F.collect_list("f").alias("fs"))  # at most one for each template
    overlaps = lambda x, y: (x["first"] <= y["last"]) & (y["first"] <= x["last"]) & (order(y) > order(x))
    left = F.filter("fs", lambda x: ~F.exists("fs", lambda y: overlaps(x, y)))
    return listed.select(*key, F.explode(left).alias("f")).select(*key, "f.template", "f.containment", "f.first", "f.last")


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    names = F.concat_ws(",", F.sort_array(F.collect_list("template"))).alias("names")  # at most a row a template
    found = scan_licenses(docs).groupBy(F.col("doc_id").alias("id"), "text_hash").agg(F.count("*").alias("n"), names)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h"))
    joined = keyed.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("text_hash")), "left")
    return joined.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_licenses"), F.coalesce("names", F.lit("")).alias("licenses"))


_VALUES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(TEMPLATES.items()))
_WORDS = rf"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_GAPS}'), lambda x: x <> '')"
ORACLE = rf"""
WITH t AS (SELECT template, {_WORDS} AS w FROM (VALUES {_VALUES}) v(template, text)),
ts AS (SELECT DISTINCT template, array_to_string(w[i : i + 4], ' ') AS h FROM (SELECT template, w, unnest(range(1, len(w) - 3)) AS i FROM t)),
tn AS (SELECT template, count(*) AS n, CAST(pow(2, ceil(log2(count(*)))) AS BIGINT) AS s FROM ts GROUP BY template),
d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS w FROM documents),
ds AS (SELECT k, i - 1 AS i, array_to_string(w[i : i + 4], ' ') AS h FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
m AS (SELECT k, template, n, unnest([i // s, i // s - 1]) AS win, i, h FROM ds JOIN ts USING (h) JOIN tn USING (template)),
f AS (SELECT k, template, count(DISTINCT h) / n AS c, count(DISTINCT h) AS common, min(i) AS first_at, max(i) AS last_at
      FROM m WHERE win >= 0 GROUP BY k, template, n, win HAVING count(DISTINCT h) >= 0.8 * n),
b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY k, template ORDER BY c DESC, first_at, common DESC, last_at DESC) = 1),
l AS (SELECT * FROM b AS x WHERE NOT EXISTS (SELECT 1 FROM b AS y WHERE x.k = y.k AND x.first_at <= y.last_at AND y.first_at <= x.last_at AND (y.c, y.common, y.template) > (x.c, x.common, x.template))),
g AS (SELECT k, count(*) AS n, string_agg(template, ',' ORDER BY template) AS names FROM l GROUP BY k)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_licenses, coalesce(names, '') AS licenses FROM d LEFT JOIN g USING (k)
"""
