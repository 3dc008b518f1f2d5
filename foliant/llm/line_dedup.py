"""Line dedup over levelled sorted runs of line hashes, with DataFrame functions only.

A run is a table of (h1, h2, n) by 128-bit line hash: n documents hold the line. Runs are
bucketed and sorted by the hash, all with as many buckets as there are shuffle partitions,
so that merging and joining them moves no row. A batch of documents is summed up by hash
(its one shuffle, after sums within tasks), merge-anti-joined with what the runs already
call frequent, and added to level 0 as a run; a level that holds ``fanout`` runs is merged
into one run of the next level, as in a log-structured merge tree. At the end the frequent
hashes of all runs decide which lines of which documents go.

Lines are known by their places: a document's frequent lines are a set of numbers, which
is taken from those of all its lines, so long documents cost no more a line than short ones.

Defined results: a null or empty text is one empty line; a line that is empty after
stripping has no key and always stays; a key counts once per doc_id, also where rows
or ids repeat (rows with a null doc_id count as one document); extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import SPACES, ascii_lower, materialize, removed_at_exit, scratch, table

MIN_DOCS = 10
MIN_CHARS = 1
BATCHES = 4
FANOUT = 2

_RUN = "h1 long, h2 long, n long"
_KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def key_hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(10), key).alias("h2"))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """Levelled sorted runs in a shared folder: a bucketed table a level, of which
    ``levels`` says how many runs it holds."""

    def __init__(self, spark: SparkSession, path: str, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.spark, self.path, self.min_docs, self.fanout = spark, path, min_docs, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.levels: list[int] = []
        self._made: list[int] = []

    def _table(self, level: int) -> str:
        return f"{self.name}_{level}_{self._made[level]}"

    def _add(self, run: DataFrame, level: int) -> None:
        if len(self.levels) <= level:
            self.levels.append(0)
            self._made.append(0)
        name = self._table(level)
        run.select("h1", "h2", "n").write.bucketBy(self.buckets, *_KEY).sortBy(*_KEY).option("path", f"{self.path}/{name}").mode("append").saveAsTable(name)
        self.levels[level] += 1
        if self.levels[level] >= self.fanout:
            self._add(self.merged(level), level + 1)
            self._clear(level)

    def _clear(self, level: int) -> None:
        self.spark.sql(f"DROP TABLE {self._table(level)}")
        self.levels[level] = 0
        self._made[level] += 1

    def merged(self, level: int) -> DataFrame:
        """A level's runs as one; rows of a hash lie in one bucket of all of them."""
        own = self.spark.table(self._table(level))
        return own.groupBy(*_KEY).agg(F.sum("n").alias("n")) if self.levels[level] > 1 else own

    def counts(self) -> DataFrame | None:
        """All levels, merged bucket by bucket."""
        out = None
        for level in (i for i, n in enumerate(self.levels) if n):
            own = self.merged(level)
            if out is not None:
                own = out.join(own.withColumnRenamed("n", "_n"), _KEY, "full").select(*_KEY, (F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n"))
            out = own
        return out

    def frequent(self) -> DataFrame:
        found = self.counts()
        found = self.spark.createDataFrame([], _RUN) if found is None else found
        return found.filter(F.col("n") >= self.min_docs).select(*_KEY)

    def add(self, batch: DataFrame) -> None:
        """``batch``: (h1, h2), a row for each document that holds the line, of documents
        that no earlier batch held."""
        run = batch.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"))
        if any(self.levels):
            run = run.join(self.frequent(), _KEY, "left_anti")
        self._add(run, 0)

    def close(self) -> None:
        for level, n in enumerate(self.levels):
            if n:
                self._clear(level)


def dropped_lines(
    docs: DataFrame, *, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT
) -> DataFrame:
    """(doc_id, text_hash, drop): for each document with frequent lines, their places."""
    spark = docs.sparkSession
    path = scratch(spark, "lines")
    # (hash, place) of all lines in order of the hashes: the first of equal ones is marked
    keys = F.transform(lines_of(F.col("text")), lambda x, i: F.struct(line_key(x).alias("key"), i.alias("place")))
    keys = F.filter(keys, lambda k: F.char_length(k["key"]) >= min_chars)
    keys = F.sort_array(F.transform(keys, lambda k: F.struct(key_hash(k["key"]).alias("h"), k["place"].alias("place"))))
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), keys.alias("keys")).filter(F.size("keys") > 0)
    before = F.concat(F.array(F.lit(None).cast("struct<h1:bigint,h2:bigint>")), F.transform("keys", lambda k: k["h"]))  # one place later
    lines = lines.select("doc_id", "text_hash", F.explode(F.slice(F.arrays_zip("keys", before.alias("before")), F.lit(1), F.size("keys"))).alias("k"))
    hashed = lines.select(
        "doc_id", "text_hash", "k.keys.place", "k.keys.h.h1", "k.keys.h.h2", (~F.col("k.keys.h").eqNullSafe(F.col("k.before"))).alias("first"),
        F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"),
    )
    hashed.write.mode("overwrite").partitionBy("batch").parquet(f"{path}/hashed")
    removed_at_exit(spark, path)
    stored = spark.read.schema("doc_id long, text_hash long, place int, h1 long, h2 long, first boolean, batch int").parquet(f"{path}/hashed")
    again = materialize(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("_id")), "lines-repeated")
    repeated = not again.isEmpty()
    runs = LineRuns(spark, f"{path}/runs", min_docs, fanout)
    for b in range(batches):
        own = stored.filter((F.col("batch") == b) & F.col("first"))
        if repeated:  # an id's rows are one document
            same = own["doc_id"].eqNullSafe(again["_id"])
            once = own.join(again, same, "left_semi").select("doc_id", *_KEY).distinct().select(*_KEY)
            own = own.join(again, same, "left_anti").select(*_KEY).union(once)
        runs.add(own.select(*_KEY))
    # stored first: Spark then knows its size and can split a line that a third of all documents hold
    often = materialize(runs.frequent(), "lines-frequent")
    runs.close()
    hits = stored.join(often, _KEY)
    return hits.groupBy("doc_id", "text_hash").agg(F.collect_set("place").alias("drop"))


def dedup_lines(docs: DataFrame, names: tuple[str, str, str] = ("kept", "n_lines", "n_dropped"), **options) -> DataFrame:
    """``docs`` with three columns more: the text without its frequent lines, the lines
    before and the lines dropped. ``names`` are to differ from the columns of ``docs``."""
    drop = dropped_lines(docs, **options).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("drop").alias("_drop"))
    out = docs.join(drop, docs["doc_id"].eqNullSafe(drop["_id"]) & (F.xxhash64(docs["text"]) == F.col("_hash")), "left")
    own = [docs[c] for c in docs.columns]
    # lines are a column of their own, used twice, so that they are split once a document
    out = out.select(*own, "_drop", lines_of(docs["text"]).alias("_lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    out = out.select(*own, F.size("_lines").alias("_n"), F.when(F.col("_drop").isNotNull(), F.transform(left, lambda i: F.get(F.col("_lines"), i))).alias("_left"))
    return out.select(
        *own,
        F.coalesce(F.array_join("_left", "\n"), docs["text"], F.lit("")).alias(names[0]),
        F.col("_n").cast("long").alias(names[1]),
        F.when(F.col("_left").isNull(), F.lit(0)).otherwise(F.col("_n") - F.size("_left")).cast("long").alias(names[2]),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP10_SQL = f"""
WITH l AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UP}', '{_LOW}') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), f AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT l.doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN f.k IS NULL THEN l.line END, chr(10) ORDER BY l.i), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.k = f.k GROUP BY l.doc_id
"""
