"""The relational operators behind the object graph, as DataFrame plans."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.syntax import dictionary
from ..session import reach_workers
from ..storage import materialize


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the first by ``order``."""
    others = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*others), F.struct(*order))
    return rows.groupBy(*keys).agg(first.alias("r")).select(*keys, "r.*")


def lookup(values: DataFrame, objects: DataFrame, key: str) -> DataFrame:
    """References resolved: an object of its own place in the file before a packed one."""
    best = objects.withColumn("_packed", F.when(F.col("source") == "objstm", 1).otherwise(0))
    best = first_wins(best, ["doc_id", "obj_id"], ["_packed", "offset"]).drop("_packed")
    return values.join(best.withColumnRenamed("obj_id", key), ["doc_id", key], "left")


def dictionary_entries(rows: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, name, value) of one level of dictionaries spelled in a binary column."""
    reach_workers(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(k, n.decode("latin-1"), v.decode("latin-1")) for k, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for n, (_, v) in dictionary(r).items()]
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], [key, "key", "value"])

    return rows.select(key, raw).mapInArrow(run, f"{key} {kind}, key string, value string")


def inherited(nodes: DataFrame, node: str, parent: str, value: str) -> DataFrame:
    """(node, value): a tree's values, taken from the nearest ancestor where they lack.

    Every round looks twice as far up as the one before, so trees of any depth take a
    round for each doubling. A node keeps null if no ancestor has a value, if its parent
    isn't there, or if it hangs on a cycle without a value."""
    pairs = nodes.select(F.col(node).alias("id"), F.col(parent).alias("up"), F.col(value).alias("value"))
    known = materialize(pairs, "inherited")
    rounds = known.count().bit_length() + 1
    for _ in range(rounds):
        if known.filter("value is null and up is not null").isEmpty():
            break
        above = known.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("value").alias("_value"))
        open_ = F.col("value").isNull()
        step = known.join(above, "up", "left").select(
            "id", F.when(open_, F.col("_up")).otherwise(F.col("up")).alias("up"), F.coalesce("value", "_value").alias("value")
        )
        known = materialize(step, "inherited")
    return known.select(F.col("id").alias(node), F.col("value").alias(value))
