"""Files in and out: lines of JSON, markdown posts, training logs, outputs of systems and articles, answers of a blind test."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def stem() -> Column:
    """The name of a row's file (or of the folder of part files that stands for it) without its last suffix."""
    return F.regexp_extract("_metadata.file_path", r"([^/]+)\.[^./]+(?:/part-[^/]*)?$", 1)


def scratch(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir; in local mode, as in tests, one of this machine where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quillspark-")
    return f"{folder.rstrip('/')}/files-{uuid.uuid4().hex}"


def jsonl(spark: SparkSession, path: str | list[str], schema: str | None = None) -> DataFrame:
    """Rows of lines of JSON; blank lines are skipped. Give the schema of large inputs: inferring one reads them twice."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def posts(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """(path, slug, raw) of whole text files; a file that several patterns match comes once for each. Bytes that aren't UTF-8 become U+FFFD."""
    each = [spark.read.text(p, wholetext=True).select(F.col("_metadata.file_path").alias("path"), stem().alias("slug"), F.col("value").alias("raw")) for p in patterns]
    out = each[0]
    for more in each[1:]:
        out = out.union(more)
    return out


def split_overrides(spark: SparkSession, path: str) -> DataFrame:
    """(slug, split) of an earlier split, from CSV with a header."""
    return spark.read.option("header", True).csv(path).select("slug", "split")


def loss_curve(spark: SparkSession, path: str) -> DataFrame:
    """(step, epoch, eval_loss) of the rows of a training log that have a loss; epoch 0 if there is none."""
    rows = jsonl(spark, path, "step long, epoch double, eval_loss double").where("eval_loss is not null")
    return rows.select("step", F.coalesce("epoch", F.lit(0.0)).alias("epoch"), "eval_loss")


def system_outputs(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Rows of outputs with `system`, the name of their file."""
    return jsonl(spark, pattern, schema).select("*", stem().alias("system"))


def checkpoint_outputs(spark: SparkSession, pattern: str, run: str, schema: str) -> DataFrame:
    """Outputs of one run's checkpoints with `step`, the digits after the last underscore of the name."""
    rows = system_outputs(spark, pattern, schema).where(F.startswith("system", F.lit(f"{run}_")))
    return rows.withColumn("step", F.nullif(F.regexp_extract("system", r"_(\d+)$", 1), F.lit("")).cast("long")).where("step is not null")


def block_logs(spark: SparkSession, pattern: str) -> DataFrame:
    """(article, system, input, output, blocks) of logs named <article>.<system>.blocks.jsonl; the article's name ends at its first dot."""
    name = r"([^/.]+)\.([^/]+)\.blocks\.jsonl(?:/part-[^/]*)?$"
    rows = jsonl(spark, pattern, "input string, output string, blocks array<int>").withColumn("__name", F.col("_metadata.file_path"))
    part = lambda i: F.regexp_extract("__name", name, i)
    return rows.where(F.col("__name").rlike(name)).select(part(1).alias("article"), part(2).alias("system"), "input", "output", "blocks")


def answers(spark: SparkSession, path: str) -> DataFrame:
    """(id, answers) of a blind test: each id's answers stand bare or under a key `answers`; keys that aren't s1 or s2 go."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "value")).where("id in ('s1', 's2')")
    inner = F.from_json(F.get_json_object("value", "$.answers"), "map<string,string>")
    return raw.select("id", F.coalesce(inner, F.from_json("value", "map<string,string>")).alias("answers"))


def write_jsonl(rows: DataFrame, path: str) -> None:
    """Lines of JSON, characters beyond ASCII as they are; replaces what was there."""
    rows.write.mode("overwrite").json(path)


def append_jsonl(rows: DataFrame, path: str) -> None:
    """More lines beside those written before; done_keys() of them tells a later run what to leave out."""
    rows.write.mode("append").json(path)


def done_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys of results without an error."""
    return rows.where(F.coalesce("error", F.lit("")) == "").select(*keys).distinct()


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def exemplars(posts: DataFrame, excluded: list[str] = (), least: int = 150, most: int = 400, share: float = 0.6) -> DataFrame:
    """(text) of prose paragraphs of posts (name, raw) that may serve as examples of style: no markup before them, of fitting length, Han for the most part, links as plain text.

    `excluded` are names of files that aren't read, such as those of an evaluation.
    """
    kept = posts.where(~F.col("name").isin(*excluded)) if excluded else posts
    part = F.explode(F.split("raw", r"(?U)\n\s*\n")).alias("text")
    rows = kept.select(part).select(F.regexp_replace("text", r"(?U)^\s+|\s+\z", "").alias("text"))
    size = F.length("text")
    fits = ~F.col("text").rlike(r"^(#|!|\||>|```|<|-|\*)") & size.between(least, most) & (F.regexp_count("text", F.lit("[一-鿿]")) > share * size)
    return rows.where(fits).select(F.regexp_replace("text", r"\[([^\]]*)\]\([^)]*\)", "$1").alias("text"))


def report(spark: SparkSession, path: str, values: dict) -> None:
    """One JSON file of a report, written by the driver; DataFrames in it become lists of rows, so they are to be small."""

    def plain(x):
        if isinstance(x, DataFrame):
            return [json.loads(r) for r in x.toJSON().toLocalIterator()]
        return {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else x

    from quillspark.operators.detector import write_text

    write_text(spark, path, json.dumps(plain(values), ensure_ascii=False, indent=2))
