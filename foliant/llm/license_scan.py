"""License scans: TF-IDF cosine to templates, then inheritance along the path.

Every line of every text that speaks of a licence is a statement. Distinct statements
are compared with the templates by the cosine of sparse TF-IDF vectors; document
frequencies count all statements of all files. Passages (the whole text, comment runs,
and runs of paragraphs) of texts with a statement are also compared, by TF-IDF over the
texts, with full licence texts and standard headers. A file's licence is that of its
closest passage, else that of its closest statement. A licence file speaks for its
directory: one whose whole text is a licence, one that has a licence file's name and a
licence, or one whose licensed statements hold at least FILE_SHARE of its words. Files without a licence of their own take that
of the nearest ancestor directory that has one. Ancestors are resolved once per
directory, by joins on path prefixes, so no directory's files meet in one task.

Defined results: a null or empty text has no statement; of equally close statements
the earlier line counts, of equally close templates the first by name; of equally
close passages the one that begins first; of a
directory's licence files the one with the smallest path; repeated rows are files of
the same path; a null path inherits nothing; an empty table gives no rows; other
columns are kept out.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from .common import materialize, table

MIN_COSINE = 0.6
FILE_SHARE = 0.5
CUES = "licen[sc]e|copyright|spdx|permission|redistribut|public domain"

#: Short statements and headers of common licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted. Simplified BSD License.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "Licensed under the Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
    "Proprietary": "Copyright. All rights reserved. No part may be reproduced without permission.",
}


#: Least cosine of a passage, and paragraphs that a passage has at most: a BSD text has 7.
PASSAGE_COSINE, PARAGRAPHS = 0.8, 10
LICENSE_NAME = r"(?i)(^|/)(un)?(licen[sc]e|copying)([.-][^/]*)?$"
_GPL = """This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by
the Free Software Foundation, either version {version} of the License, or (at your option) any later version.
This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.
You should have received a copy of the GNU {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>."""
#: Standard headers of licences whose full text isn't one.
HEADERS = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-2.0": _GPL.format(what="program", name="General Public License", version=2),
    "GPL-3.0": _GPL.format(what="program", name="General Public License", version=3),
    "LGPL-3.0": _GPL.format(what="library", name="Lesser General Public License", version=3),
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
}
_MARK = re.compile(r"^\s*(?:/\*+|\*+/|\*|//+|#+|;+|--+|%+|<!--|\"{3}|'{3})")
_TAIL = re.compile(r"(?:\*+/|-->)\s*$")
_TERM = re.compile("[a-z0-9]+")
_CUE = re.compile(CUES)


@functools.cache
def full_texts() -> dict[str, str]:
    """Full texts by licence. CC-BY-4.0 and CC-BY-NC-4.0 are known by their statements only."""
    return {f.stem: f.read_text() for f in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}


class Texts:
    """Full texts and headers as TF-IDF vectors; other terms weigh as those of one text."""

    def __init__(self):
        both = sorted([(n, t, True) for n, t in full_texts().items()] + [(n, t, False) for n, t in HEADERS.items()])
        tf = [Counter(_TERM.findall(t.lower())) for _, t, _ in both]
        df = Counter(x for t in tf for x in t)
        self.names, self.full = [n for n, _, _ in both], [x for _, _, x in both]
        self.idf = {x: float(np.log((len(tf) + 1) / (n + 1)) + 1) for x, n in df.items()}
        self.other = float(np.log((len(tf) + 1) / 2) + 1)
        self.column = {x: i for i, x in enumerate(self.idf)}
        self.vectors = np.zeros((len(tf), len(self.idf)))
        for row, t in zip(self.vectors, tf):
            for x, n in t.items():
                row[self.column[x]] = n * self.idf[x]
        self.vectors /= np.linalg.norm(self.vectors, axis=1, keepdims=True)

    def closest(self, terms: Counter) -> tuple[float, str, bool]:
        """(cosine, licence, whether it is a full text) of the closest text."""
        at, w, rest = [], [], 0.0
        for x, n in terms.items():
            if x in self.column:
                at.append(self.column[x])
                w.append(n * self.idf[x])
            else:
                rest += (n * self.other) ** 2
        norm = (float(np.square(w).sum()) + rest) ** 0.5
        cosines = np.round(self.vectors[:, at] @ np.array(w) / norm, 6) if at else np.zeros(len(self.names))
        i = int(cosines.argmax())
        return float(cosines[i]), self.names[i], self.full[i]

    def license_of(self, text: str) -> tuple[str, float, int, bool] | None:
        """(licence, cosine, first line, whether all of it is a full text) of the closest
        passage that reaches PASSAGE_COSINE. A full text in the comments of other lines is
        their header."""
        lines = [(bool(_MARK.match(x)), _TAIL.sub("", _MARK.sub("", x)).strip().lower()) for x in text.split("\n")]
        terms = lambda part: Counter(_TERM.findall("\n".join(part)))
        found = []

        def look(first: int, n: Counter) -> None:
            cosine, name, _ = self.closest(n)
            if cosine >= PASSAGE_COSINE:
                found.append((-cosine, first, name))

        def look_at_runs(kept: list[bool]) -> None:
            runs: list[tuple[int, list[str]]] = []
            for i, (_, x) in enumerate(lines):
                if kept[i]:
                    if not i or not kept[i - 1]:
                        runs.append((i, []))
                    runs[-1][1].append(x)
            counted: dict[int, Counter] = {}
            for i, (first, part) in enumerate(runs):
                if any(map(_CUE.search, part)):
                    total: Counter = Counter()
                    for j in range(i, min(i + PARAGRAPHS, len(runs))):
                        if j not in counted:
                            counted[j] = terms(runs[j][1])
                        total += counted[j]
                        look(first, total)

        look_at_runs([marked for marked, _ in lines])
        cosine, name, full = self.closest(terms([x for _, x in lines]))
        if cosine >= PASSAGE_COSINE:
            if full and not (found and any(x for marked, x in lines if not marked)):
                return name, cosine, 0, True
            found.append((-cosine, 0, name))
        look_at_runs([bool(x) for _, x in lines])
        if not found:
            return None
        minus, first, name = min(found)
        return name, -minus, first, False


def passages(files: DataFrame) -> DataFrame:
    """The columns of ``files`` but text, license, cosine, line and whole of the rows with
    a passage that is a licence's text or header."""
    keys = [c for c in files.columns if c != "text"]
    rows = files.filter(F.lower("text").rlike(CUES)).select("text", *keys)
    shared = files.sparkSession.sparkContext.broadcast(Texts())  # a fixed table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = shared.value
        for b in batches:
            got = [(i, *x) for i, t in enumerate(b.column(0)) if (x := texts.license_of(t.as_py()))]
            at = pa.array([g[0] for g in got], pa.int64())
            cols = [b.column(i).take(at) for i in range(1, b.num_columns)]
            more = [pa.array([g[i] for g in got], kind) for i, kind in ((1, pa.string()), (2, pa.float64()), (3, pa.int64()), (4, pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*cols, *more], [*keys, "license", "cosine", "line", "whole"])

    more = [StructField("license", StringType()), StructField("cosine", DoubleType()), StructField("line", LongType()), StructField("whole", BooleanType())]
    return rows.mapInArrow(run, StructType([*rows.schema.fields[1:], *more]))


def _terms(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def closest(statements: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(statement, license, cosine) of distinct ``statements`` (statement, n) that reach
    MIN_COSINE; n: how many lines are that statement."""
    spark = statements.sparkSession
    known = spark.createDataFrame(sorted(templates.items()), "license string, text string")
    tf = statements.select("statement", "n", F.explode(_terms(F.col("statement"))).alias("term")).groupBy("statement", "n", "term").agg(F.count(F.lit(1)).alias("tf"))
    ttf = known.select("license", F.explode(_terms(F.col("text"))).alias("term")).groupBy("license", "term").agg(F.count(F.lit(1)).alias("ttf"))
    total = statements.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] + len(templates)
    df = tf.select("term", "n").union(ttf.select("term", F.lit(1))).groupBy("term").agg((F.log((total + 1.0) / (F.sum("n") + 1)) + 1).alias("idf"))
    df = materialize(df, "license-idf")
    weighed = tf.join(df, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighed.groupBy("statement").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    tw = ttf.join(df, "term").withColumn("tw", F.col("ttf") * F.col("idf"))
    tnorms = tw.groupBy("license").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tnorm"))
    sides = F.broadcast(tw.select("term", "license", "tw"))  # the templates' terms: a fixed table
    dots = weighed.select("statement", "term", "w").join(sides, "term").groupBy("statement", "license").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    near = dots.join(norms, "statement").join(F.broadcast(tnorms), "license")
    near = near.withColumn("cosine", F.round(F.col("dot") / (F.col("norm") * F.col("tnorm")), 6))
    top = near.groupBy("statement").agg(F.min(F.struct((-F.col("cosine")).alias("minus"), "license")).alias("b"))
    return top.select("statement", "b.license", (-F.col("b.minus")).alias("cosine")).filter(F.col("cosine") >= MIN_COSINE)


def scan(files: DataFrame) -> DataFrame:
    """id, path, license, cosine, origin (file, inherited, none) and from_dir of every
    row of ``files`` (id, path, text)."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    stated = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("line"), F.trim(x).alias("statement"))), lambda s: F.lower(s["statement"]).rlike(CUES))
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\S+"))
    rows = materialize(
        files.select("id", "path", F.xxhash64("text").alias("h"), words.alias("words"), stated.alias("stated")).withColumn("dir", F.regexp_replace("path", "/?[^/]*$", "")), "license-rows"
    )
    each = rows.filter(F.size("stated") > 0).select("id", "path", "h", "words", "dir", F.explode(F.array_distinct("stated")).alias("s")).select("id", "path", "h", "words", "dir", "s.line", "s.statement")
    distinct = materialize(each.groupBy("statement").agg(F.count(F.lit(1)).alias("n")), "license-statements")
    named = materialize(closest(distinct), "license-named")
    keys = ["id", "path", "h", "words", "dir"]
    hits = each.distinct().join(named, "statement").select(*keys, F.lit(1).alias("rank"), "license", "cosine", F.col("line").cast("long").alias("line"), F.regexp_count("statement", F.lit(r"\S+")).alias("own_words"))
    read = files.select("id", "path", F.xxhash64("text").alias("h"), words.alias("words"), F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), "text")
    parts = passages(read).distinct().select(*keys, F.lit(0).alias("rank"), "license", "cosine", "line", F.when(F.col("whole"), F.col("words")).otherwise(0).alias("own_words"))
    hits = hits.union(parts)
    own = materialize(
        hits.groupBy(*keys).agg(F.min(F.struct("rank", (-F.col("cosine")).alias("minus"), "line", "license")).alias("b"), F.sum("own_words").alias("own_words"))
        .select(*keys, "b.license", (-F.col("b.minus")).alias("cosine"), "own_words"), "license-own",
    )
    is_file = (F.col("own_words") >= F.col("words") * FILE_SHARE) | F.col("path").rlike(LICENSE_NAME)
    speaks = own.filter(is_file & F.col("dir").isNotNull())
    by_dir = speaks.groupBy("dir").agg(F.min(F.struct("path", "license")).alias("f")).select(F.col("dir").alias("from_dir"), F.col("f.license").alias("dir_license"))

    parts = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct((-n).alias("minus"), F.array_join(F.slice(parts, 1, n), "/").alias("up")))
    dirs = rows.select("dir").distinct().filter("dir is not null")
    ups = dirs.select("dir", F.explode(up).alias("u")).select("dir", "u.minus", F.col("u.up").alias("from_dir"))
    nearest = ups.join(by_dir, "from_dir").groupBy("dir").agg(F.min(F.struct("minus", "from_dir", "dir_license")).alias("n"))
    # stored first: Spark then knows its size and can split a directory that holds most files
    nearest = materialize(nearest.select(F.col("dir").alias("_dir"), "n.from_dir", "n.dir_license"), "license-nearest")

    mine = own.select(*[F.col(k).alias(f"_{k}") for k in ("id", "path", "h")], "license", "cosine")
    same = rows["id"].eqNullSafe(mine["_id"]) & rows["path"].eqNullSafe(mine["_path"]) & (rows["h"] == mine["_h"])
    out = rows.join(mine, same, "left").join(nearest, F.col("dir") == F.col("_dir"), "left")
    origin = F.when(F.col("license").isNotNull(), "file").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none")
    return out.select(
        "id", "path", F.coalesce("license", "dir_license").alias("license"), "cosine", origin.alias("origin"),
        F.when(F.col("license").isNull(), F.col("from_dir")).alias("from_dir"),
    )


def document_path(source: Column, doc_id: Column) -> Column:
    """The path that documents are filed under: source / thousands / tens / id, and every
    third id one level, every third two levels higher, so that directories nest."""
    parts = [F.coalesce(source, F.lit("unknown")), F.floor(doc_id / 1000).cast("string"), F.floor(doc_id / 10).cast("string")]
    depth = 3 - F.coalesce(F.pmod(doc_id, F.lit(3)), F.lit(0)).cast("int")
    return F.concat_ws("/", F.concat_ws("/", F.slice(F.array(*parts), F.lit(1), depth)), F.concat(doc_id.cast("string"), F.lit(".txt")))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, license, cosine, origin, from_dir of every document."""
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.col("doc_id").alias("id"), document_path(F.col("source"), F.col("doc_id")).alias("path"), "text")
    return scan(files).withColumnRenamed("id", "doc_id")


_VALUES = ", ".join("('{}', '{}')".format(*x) for x in sorted(TEMPLATES.items()))
OP8_SQL = f"""
WITH rows AS (
  SELECT *, dir || '/' || doc_id || '.txt' AS path, len(regexp_extract_all(text, '\\S+')) AS words FROM (
    SELECT doc_id, coalesce(text, '') AS text,
           array_to_string(list_slice([coalesce(source, 'unknown'), (doc_id // 1000)::VARCHAR, (doc_id // 10)::VARCHAR], 1, 3 - doc_id % 3), '/') AS dir FROM documents)
), lines AS (
  SELECT doc_id, path, dir, words, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM rows
), each AS (
  SELECT doc_id, path, dir, words, i, trim(line, ' ') AS statement FROM lines WHERE regexp_matches(lower(line), '{CUES}')
), st AS (SELECT statement, count(*) AS n FROM each GROUP BY statement
), tpl(license, text) AS (VALUES {_VALUES}
), tf AS (SELECT statement, n, term, count(*) AS tf FROM (SELECT statement, n, unnest(regexp_extract_all(lower(statement), '[a-z0-9]+')) AS term FROM st) GROUP BY ALL
), ttf AS (SELECT license, term, count(*) AS ttf FROM (SELECT license, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM tpl) GROUP BY ALL
), idf AS (
  SELECT term, ln(((SELECT coalesce(sum(n), 0) FROM st) + {len(TEMPLATES)} + 1.0) / (sum(n) + 1)) + 1 AS idf
  FROM (SELECT term, n FROM tf UNION ALL SELECT term, 1 FROM ttf) GROUP BY term
), w AS (SELECT statement, term, tf * idf AS w FROM tf JOIN idf USING (term)
), tw AS (SELECT license, term, ttf * idf AS tw FROM ttf JOIN idf USING (term)
), cosines AS (
  SELECT statement, license, round(dot / (norm * tnorm), 6) AS cosine
  FROM (SELECT statement, license, sum(w * tw) AS dot FROM w JOIN tw USING (term) GROUP BY ALL)
  JOIN (SELECT statement, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL) USING (statement)
  JOIN (SELECT license, sqrt(sum(tw * tw)) AS tnorm FROM tw GROUP BY ALL) USING (license)
), named AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY statement ORDER BY cosine DESC, license) AS r FROM cosines) WHERE r = 1 AND cosine >= {MIN_COSINE}
), hits AS (SELECT each.*, license, cosine, len(regexp_extract_all(statement, '\\S+')) AS own FROM each JOIN named USING (statement)
), mine AS (
  SELECT doc_id, path, dir, license, cosine, total, words FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, i, license) AS q, sum(own) OVER (PARTITION BY doc_id) AS total FROM hits) WHERE q = 1
), dirs AS (
  SELECT dir, license FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY path, license) AS q FROM mine WHERE total >= words * {FILE_SHARE}) WHERE q = 1
), ups AS (
  SELECT dir, n, array_to_string(list_slice(string_split(dir, '/'), 1, n), '/') AS up
  FROM (SELECT dir, unnest(range(1, len(string_split(dir, '/')) + 1)) AS n FROM (SELECT DISTINCT dir FROM rows))
), far AS (
  SELECT ups.dir, dirs.dir AS from_dir, dirs.license, row_number() OVER (PARTITION BY ups.dir ORDER BY n DESC) AS q FROM ups JOIN dirs ON dirs.dir = ups.up
)
SELECT rows.doc_id, rows.path, coalesce(mine.license, far.license) AS license, mine.cosine,
       CASE WHEN mine.license IS NOT NULL THEN 'file' WHEN far.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN mine.license IS NULL THEN far.from_dir END AS from_dir
FROM rows LEFT JOIN mine USING (doc_id) LEFT JOIN far ON far.dir = rows.dir AND far.q = 1
"""
