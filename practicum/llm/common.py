"""What the text operators share: input tables, scratch tables and word rules.

Nothing here keeps state on a machine's own disk: scratch tables are Parquet written by Spark in
the folder that ``spark.checkpoint.dir`` names, so a lost executor costs recomputation only.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java class of the six ASCII white-space bytes; words are the maximal runs of anything else.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where the setting is absent (tests), one of this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    own = os.path.join(tempfile.gettempdir(), f"practicum-{os.getpid()}")
    spark.conf.set("spark.checkpoint.dir", own)
    spark.sparkContext.setCheckpointDir(own)
    return own


#: Spark's setting for removing the shuffle files of a statement as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession, df: DataFrame, tag: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back: lineage ends there, so the
    shuffle files that led to it go when it is whole."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete scratch tables that no later step reads; the collection that follows lets the driver
    tell executors to remove the shuffle files of finished steps."""
    jvm = spark.sparkContext._jvm
    for t in tables:
        path = jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    jvm.System.gc()


def materialised(df: DataFrame, *, keep: list[str], **made: Column) -> DataFrame:
    """Add columns behind a Generate node, so that later filters do not evaluate them again."""
    packed = F.array(F.struct(*[c.alias(k) for k, c in made.items()]))
    return df.select(*keep, F.inline_outer(packed))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}+|{SPACE}+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE}+"))


def word_count(text: Column) -> Column:
    """Number of words, without building them: white space becomes blanks, runs become one."""
    flat = F.translate(F.coalesce(text, F.lit("")), SPACE_CHARS, " " * len(SPACE_CHARS))
    one = F.trim(F.regexp_replace(flat, " {2,}", " "))
    blanks = F.char_length(one) - F.char_length(F.translate(one, " ", ""))
    return F.when(one == "", F.lit(0)).otherwise(blanks + 1).cast("long")


#: Up to this many edges (16 bytes each) one task unites; more go through rounds of joins.
ONE_TASK_EDGES = 2_000_000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smallest node of each component: labels take the least of an edge's ends, then jump to their label's label."""
    held = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
    if not held:
        return
    ends = np.concatenate(held, axis=1)
    nodes, place = np.unique(ends, return_inverse=True)
    a, b = place.reshape(ends.shape)
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            break
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]
    below = label != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[below]), pa.array(nodes[label[below]])], names=["node", "root"])


def components(spark: SparkSession, edges: DataFrame, *, one_task: int | None = None) -> DataFrame:
    """(node, root): the smallest node of each component of edges (a, b), for all nodes but the smallest.

    A measured, bounded number of edges goes to one task. More go through alternating large and small
    stars; each round is written out, so its lineage is one table.
    """
    now = scratch(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if now.count() <= (ONE_TASK_EDGES if one_task is None else one_task):
        return scratch(spark, now.repartition(1).mapInArrow(_united, "node long, root long"), "roots")
    previous = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        now = scratch(spark, small, "edges")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == previous:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        previous = state


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The columns renamed c0, c1, ... (names of a caller's columns cannot clash then) and their new names."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(reversed(list(zip(docs.columns, names, strict=True))))


def restored(df: DataFrame, columns: list[str]) -> DataFrame:
    """Undo ``numbered``."""
    return df.select(*[F.col(f"c{i}") for i in range(len(columns))]).toDF(*columns)
