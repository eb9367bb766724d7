"""What the operators of this subpackage share: shared storage, word rules, run marking, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The white space that separates words; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
NO_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, which all executors see. In local mode, as in tests, it may be unset; on a cluster that is an error."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillspark-"))
        folder = sc._jsc.sc().getCheckpointDir().get()
    return f"{folder.rstrip('/')}/quillspark-{uuid.uuid4().hex}"


def release(spark: SparkSession, folder: str) -> None:
    """Removes a folder of this subpackage's that no later step reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free(names: Iterable[str], *wanted: str) -> list[str]:
    """wanted, each with as many underscores after it as it takes to clash with none of a table's own names."""
    taken, out = {n.lower() for n in names}, []
    for w in wanted:
        while w.lower() in taken:
            w += "_"
        taken.add(w.lower())
        out.append(w)
    return out


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and reread: a cut in the lineage that lost executors can't undo."""
    return written(df, name)[0]


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As `materialize`, with the table's folder, for release()."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text: Column) -> Column:
    """The words of a text as an array; null: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def keyed(df: DataFrame, *more: str) -> DataFrame:
    """(did, th, body, ...): the document's id (null: the least long), a hash that tells rows of one id apart, the text's bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return df.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), F.hash(text).alias("th"), text.cast("binary").alias("body"), *more)


def portion(hashed: Column, share: float) -> Column:
    """True of about this share of the values of a 64-bit hash, which are even over all longs."""
    return hashed <= min(2**63 - 1, int(-(2**63) + 2**64 * share))


def back(did: Column) -> Column:
    return F.when(did != NO_ID, did)


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, schema.field(i).type) for i, c in enumerate(columns)], schema=schema)


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def chunks(batches: Iterable[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their variable-length data stays near `most` bytes (or is one row)."""
    for b in batches:
        step = max(1, int(b.num_rows * most / max(b.nbytes, most)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with `name`, a number from 0 without gaps in `order`: by ranges, so that no task meets all rows."""
    part = free(df.columns, "part")[0]
    rows = materialize(df.repartitionByRange(partitions(df.sparkSession), *order).withColumn(part, F.spark_partition_id()), "ranges")
    # a row a range
    below = rows.groupBy(part).agg(F.count("*").alias("n")).select(part, (F.sum("n").over(W.orderBy(part)) - F.col("n")).alias("below"))
    ranked = rows.join(F.broadcast(below), part)
    return ranked.select(*df.columns, (F.col("below") + F.row_number().over(W.partitionBy(part).orderBy(*order)) - 1).alias(name))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges` (a, b: long); root is the least node reachable.

    Alternates large-star and small-star steps, each two grouped minima and two joins; every round is written to
    the shared folder, and the round before it is removed. Hubs are met as join keys (which adaptive execution
    splits), never as collected lists.
    """
    spark = edges.sparkSession

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()

    now, at = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    was = mark(now)
    while was[0]:
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        last = at
        now, at = written(small.select("e.*").where("a <> b").distinct(), "edges")
        release(spark, last)
        if (new := mark(now)) == was:
            break
        was = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
