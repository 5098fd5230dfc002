"""License scans by diagonal voting.

All rolling word k-gram hashes of a text are joined with the positions of the same k-grams in templates. A pair
of positions votes for its offset diagonal (text position less template position); votes are counted by
diagonal, neighbouring diagonals merge (an inserted or dropped word shifts the rest by one), and the merged span
is verified by the part of the template it covers, and by the words that tell the template from its relatives. Relatives share
most of their words, so verified spans that overlap compete: the one that covers the most of its template's k-grams stays.
Short phrases are templates of word pairs that must be covered whole on one diagonal, and compete with nothing.

Null texts count as empty: no words, no labels. Every row is scanned by itself, so repeated rows each get a
row of results and null ids stay null. Other columns, of whatever name, are not read; an empty table gives no rows. Templates
are constants of this module (or a parameter), so the broadcast is bounded by them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from platewise.llm.common import ALNUM_SEPARATORS, grams_of, slices, words_of

PHRASE_K, TEMPLATE_K = 2, 4
#: Diagonals at most so far apart merge, and one more for each so many k-grams of the template.
GAP, GAP_EACH = 3, 20
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Template:
    """``own``: at most as many words as a k-gram has, which stand in the wording and must stand in a text that has it, as they tell it from its
    relatives."""

    label: str
    text: str
    own: str = ""


PHRASES = (
    Template("gpl", "gnu general public license"),
    Template("apache", "apache license"),
    Template("cc-by", "cc by"),
    Template("mit", "mit license"),
)

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER
OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Label, what the name of the license adds, and what the notice calls the work.
_GNU = (("gpl", "", "program"), ("agpl", "affero ", "program"), ("lgpl", "lesser ", "library"), ("lgpl", "lesser ", "program"))
_GNU_REST = """This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY
or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name}General Public License for more details. You should have received a copy of the GNU
{name}General Public License along with this {work}."""


def _gnu(work: str, name: str) -> str:
    return f"""This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {name}General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""


#: Short names of the parts of a Creative Commons license.
_PARTS = {"nc": "NonCommercial", "nd": "NoDerivatives", "sa": "ShareAlike"}


def _creative_commons() -> list[Template]:
    """The notice and the short name of every kind and of two versions; the words up to the version tell kinds apart."""
    out = []
    for kind in ((), ("sa",), ("nc",), ("nd",), ("nc", "sa"), ("nc", "nd")):
        label = "-".join(("cc", "by", *kind))
        name = "-".join(("Attribution", *(_PARTS[k] for k in kind)))
        for version, port in (("4.0", "International"), ("3.0", "Unported")):
            own = f"commons {name} {version[0]}".replace("-", " ").split()[-4:]
            out.append(Template(label, f"This work is licensed under a Creative Commons {name} {version} {port} License", " ".join(own).lower()))
            out.append(Template(label, f"CC {'-'.join(('BY', *kind)).upper()} {version}"))
    return out


#: Public wordings of licenses and of the notices that name them (fixed values).
NOTICES = (
    Template("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
        portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
        THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
        BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    Template("mit", "Released under the MIT License"),
    Template("bsd-2-clause", f"{_BSD_HEAD} {_BSD_TAIL}"),
    Template("bsd-3-clause", f"{_BSD_HEAD} {_BSD_NAMES} {_BSD_TAIL}", "neither the name of"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
        DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE
        AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
        PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE
        OF THIS SOFTWARE."""),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    Template("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
        any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
        applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
        misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the
        product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    Template("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial,
        and by any means."""),
    Template("boost", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
        documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to
        prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"""),
    Template("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
        express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    Template("apache", "Licensed under the Apache License, Version 2.0"),
    *(Template(label, f"{_gnu(work, name)} {_GNU_REST.format(work=work, name=name)}", f"gnu {name}general public license" if not name else f"gnu {name}general public") for label, name, work in _GNU),
    *(Template(label, _gnu(work, name), f"gnu {name}general public license" if not name else f"gnu {name}general public") for label, name, work in _GNU),
    Template("gpl", "This work is licensed under the GNU General Public License version 3", "gnu general public license"),
    Template("lgpl", "This work is licensed under the GNU Lesser General Public License version 3", "gnu lesser general public"),
    Template("agpl", "This work is licensed under the GNU Affero General Public License version 3", "gnu affero general public"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    Template("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    Template("cc0", """The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights
        to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law. You can copy, modify,
        distribute and perform the work, even for commercial purposes, all without asking permission."""),
    *_creative_commons(),
)


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    words, bounds = words_of(texts, ALNUM_SEPARATORS)
    return (bounds, *grams_of(words, bounds, PHRASE_K, seed=PHRASE_K), *grams_of(words, bounds, TEMPLATE_K, seed=TEMPLATE_K))


def text_grams(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` columns, n_words, n_pairs, and ``grams``: the text's word pairs, then its word 4-grams, hashed."""
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("n_words", T.LongType()), T.StructField("n_pairs", T.IntegerType()), T.StructField("grams", T.ArrayType(T.LongType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                bounds, g2, b2, g4, b4 = _grams(batch.column(batch.schema.get_field_index(text)))
                n2, n4 = np.diff(b2), np.diff(b4)
                out_bounds = np.concatenate([[0], np.cumsum(n2 + n4)]).astype(np.int32)
                flat = np.empty(out_bounds[-1], np.uint64)
                flat[np.arange(len(g2)) + np.repeat(out_bounds[:-1] - b2[:-1], n2)] = g2
                flat[np.arange(len(g4)) + np.repeat(out_bounds[:-1] + n2 - b4[:-1], n4)] = g4
                grams = pa.ListArray.from_arrays(pa.array(out_bounds, pa.int32()), pa.array(flat.view(np.int64)))
                columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(bounds)), pa.array(n2, pa.int32()), grams], names=[*keep, "n_words", "n_pairs", "grams"])

    return df.select(*keep, F.col(text).cast("string").alias(text)).mapInArrow(run, schema)


def template_positions(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """(gram, template, label, exact, t_pos, t_grams): every k-gram of every template."""
    rows = []
    for exact, templates in ((True, phrases), (False, notices)):
        for i, t in enumerate(templates):
            _, g2, _, g4, _ = _grams(pa.array([t.text]))
            grams = g2 if exact else g4
            n = (PHRASE_K if exact else TEMPLATE_K) - len(t.own.split())
            words = _WORD.findall(t.text.lower())
            own = [bool(t.own) and f" {t.own} " in f" {' '.join(words[p : p + len(t.own.split()) + n])} " for p in range(len(grams))]
            if t.own and (n < 0 or not any(own)):
                raise ValueError(f"the words {t.own!r} do not stand in a k-gram of their template")
            rows += [(int(g), i if exact else 1000 + i, t.label, exact, p, len(grams), own[p] or not t.own) for p, g in enumerate(grams.view(np.int64))]
    return spark.createDataFrame(rows, "gram long, template int, label string, exact boolean, t_pos int, t_grams int, own boolean")


def license_spans(df: DataFrame, text: str = "text", key: str = "doc_id", least_cover: float = 0.75) -> DataFrame:
    """One row for each input row: key, n_words, and ``spans``, an array of verified spans
    (label, exact, start and end word, cover)."""
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    grams = text_grams(rows, "text", ["row", "key"])
    each = grams.select("row", "key", "n_words", "n_pairs", F.posexplode_outer("grams").alias("at", "gram"))
    hits = each.join(F.broadcast(template_positions(spark)), "gram", "left").filter(F.col("template").isNotNull() | (F.coalesce("at", F.lit(0)) == 0))
    position = F.col("at") - F.when(F.col("exact"), 0).otherwise(F.col("n_pairs"))
    votes = hits.groupBy("row", "key", "n_words", "template", "label", "exact", "t_grams", (position - F.col("t_pos")).alias("diagonal")).agg(
        F.collect_set("t_pos").alias("covered"), F.bool_or("own").alias("own")
    )
    # Neighbouring diagonals of a notice are one cluster (the longer the notice, the longer a name may stand in it); each diagonal of a phrase stands alone.
    gap = F.lit(GAP) + F.floor(F.col("t_grams") / GAP_EACH)
    by = Window.partitionBy("row", "template").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(by)
    clusters = votes.withColumn("new", F.when(step.isNull() | F.col("exact") | (step > gap), 1).otherwise(0)).withColumn("cluster", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    spans = clusters.groupBy("row", "key", "n_words", "template", "label", "exact", "t_grams", "cluster").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("votes"),
        F.min(F.col("diagonal") + F.array_min("covered")).alias("start"),
        F.max(F.col("diagonal") + F.array_max("covered") + F.when(F.col("exact"), PHRASE_K - 1).otherwise(TEMPLATE_K - 1)).alias("end"),
        F.bool_or("own").alias("own"),
    ).withColumn("cover", F.col("votes") / F.col("t_grams"))
    length = F.col("end") - F.col("start") + 1
    template_words = F.col("t_grams") + TEMPLATE_K - 1
    verified = F.when(F.col("exact"), F.col("cover") == 1.0).otherwise((F.col("cover") >= least_cover) & F.col("own") & (length <= template_words / least_cover + gap))
    # Of verified notices that overlap one stays. Rows without a notice keep a span of nothing, for their words.
    spans = spans.withColumn("good", F.coalesce(verified, F.lit(False)))
    places = Window.partitionBy("row", "exact", "good").orderBy("start", "end", "template")
    reached = F.max("end").over(places.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(reached.isNull() | (F.col("start") > reached), 1).otherwise(0)).withColumn("group", F.sum("new").over(places))
    rank = F.row_number().over(Window.partitionBy("row", "exact", "good", "group").orderBy(F.desc("votes"), F.desc("cover"), "template"))
    kept = spans.withColumn("rank", rank).filter(F.col("exact").isNull() | F.col("exact") | ~F.col("good") | (F.col("rank") == 1))
    span = F.struct("label", "exact", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "cover")
    return kept.groupBy("row", "key", "n_words").agg(F.collect_list(F.when(F.col("good"), span)).alias("spans")).select(F.col("key").alias(key), "n_words", "spans")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and spans of licenses in every document; the score is the best cover of a template (0: no label)."""
    found = license_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["exact"])
    joined = lambda spans: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))))
    starts = F.transform(base, lambda s: s["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0)).alias("score"),
    )


def scan_sql(phrases=PHRASES, notices=NOTICES, least_cover: float = 0.75) -> str:
    """DuckDB SQL of the same rows, over the k-grams' words instead of their hashes."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    templates = ", ".join(f"({i}, {quoted(t.label)}, {exact}, {k}, {quoted(t.text)}, {quoted(t.own)})" for exact, k, first, kind in ((True, PHRASE_K, 0, phrases), (False, TEMPLATE_K, 1000, notices)) for i, t in enumerate(kind, first))
    words = lambda x: f"regexp_extract_all(translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    grams = "unnest(range(0, len(w) - k + 1)) AS at, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS gram"
    return f"""
WITH t AS (SELECT *, {words("body")} AS w FROM (VALUES {templates}) v(template, label, exact, k, body, own)),
d AS (SELECT doc_id, {words("text")} AS w FROM documents),
tg AS (SELECT *, own = '' OR contains(' ' || gram || ' ', ' ' || own || ' ') AS is_own FROM (SELECT template, label, exact, k, own, len(w) - k + 1 AS t_grams, {grams} FROM t)),
dg AS (SELECT doc_id, k, {grams} FROM d, (VALUES ({PHRASE_K}), ({TEMPLATE_K})) v(k) WHERE len(w) >= k),
votes AS (
  SELECT doc_id, template, label, exact, tg.k, t_grams, dg.at - tg.at AS diagonal, list(DISTINCT tg.at) AS covered, bool_or(is_own) AS is_own FROM dg JOIN tg USING (k, gram) GROUP BY ALL
), steps AS (
  SELECT *, diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS step FROM votes
), clusters AS (
  SELECT *, sum(CASE WHEN step IS NULL OR exact OR step > {GAP} + t_grams // {GAP_EACH} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS cluster FROM steps
), spans AS (
  SELECT doc_id, template, label, exact, k, t_grams, len(list_distinct(flatten(list(covered)))) AS votes, votes / t_grams::DOUBLE AS cover, bool_or(is_own) AS is_own, min(diagonal + list_min(covered)) AS first,
    max(diagonal + list_max(covered)) + k - 1 AS last FROM clusters GROUP BY doc_id, template, label, exact, k, t_grams, cluster
), verified AS (
  SELECT * FROM spans WHERE CASE WHEN exact THEN cover = 1 ELSE cover >= {least_cover} AND is_own AND last - first + 1 <= (t_grams + {TEMPLATE_K} - 1) / {least_cover}::DOUBLE + {GAP} + t_grams // {GAP_EACH} END
), reached AS (
  SELECT *, max(last) OVER (PARTITION BY doc_id, exact ORDER BY first, last, template ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM verified
), chains AS (
  SELECT *, sum(CASE WHEN upto IS NULL OR first > upto THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, exact ORDER BY first, last, template) AS chain FROM reached
), good AS (
  SELECT * FROM chains QUALIFY exact OR row_number() OVER (PARTITION BY doc_id, exact, chain ORDER BY votes DESC, cover DESC, template) = 1
), found AS (
  SELECT doc_id, count(*) FILTER (exact) AS n_base, min(first) FILTER (exact) AS first_word, max(first) FILTER (exact) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score FROM good GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM d LEFT JOIN found ON d.doc_id = found.doc_id"""


ORACLE = scan_sql()
