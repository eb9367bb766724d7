"""Pairs of an original and its rewrite: gates, jobs still to do, first-wins rows and examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.profiles import HAN, Profile


def gate(pairs: DataFrame, low: float = 0.5, high: float = 1.9, invented: int = 1, profile: Profile = HAN) -> DataFrame:
    """pairs (original, rewrite, ...) with `why`: empty, length_ratio, number_changed, latin_invented or ok, tested in this order."""
    ratio = F.length("rewrite") / F.greatest(F.lit(1), F.length("original"))
    early = F.when(F.coalesce(T.strip(F.col("rewrite")), F.lit("")) == "", "empty").when(~ratio.between(low, high), "length_ratio")
    diff = T.fact_diff(F.col("original"), F.col("rewrite"), profile)
    late = lambda d: F.when(F.size(d["numbers"]) > 0, "number_changed").when(F.size(d["tokens"]) > invented, "latin_invented").otherwise("ok")
    # one expression, as a filter on `why` takes a copy of all that it is made of
    return pairs.withColumn("why", F.coalesce(early, T.let(diff, late)))


def guard(pairs: DataFrame, low: float = 0.6, high: float = 1.6, profile: Profile = HAN) -> DataFrame:
    """pairs with `reason`, null if a rewritten paragraph can stand for its input."""
    ratio = F.length("rewrite") / F.greatest(F.lit(1), F.length("original"))
    drift = T.number_drift(F.col("original"), F.col("rewrite"), profile)
    reason = F.when(~ratio.between(low, high), F.format_string("length_ratio %.2f", ratio)).when(F.size(drift) > 0, "number_changed")
    return pairs.withColumn("reason", reason)


def pending(units: DataFrame, key: str, prompts: tuple[str, ...], done: DataFrame) -> DataFrame:
    """(key, prompt_id) of every prompt of every unit, without those in done."""
    jobs = units.select(key).distinct().select(key, F.explode(F.array(*map(F.lit, prompts))).alias("prompt_id"))
    return jobs.join(done.select(key, "prompt_id").distinct(), [key, "prompt_id"], "left_anti")


def first_wins(rows: DataFrame, keys: list[str], order: str | Column) -> DataFrame:
    return rows.withColumn("__k", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("__k = 1").drop("__k")


def preferred(rows: DataFrame, key: str, prompt: str, preference: list[str], order: str) -> DataFrame:
    """One row a key: plain prompts before ones with a family, by preference, then the first."""
    base = T.base_prompt(F.col(prompt))
    rank = F.coalesce(*[F.when(base == p, i) for i, p in enumerate(preference)], F.lit(99))
    by = W.partitionBy(key).orderBy(F.contains(F.col(prompt), F.lit("@")), rank, order)
    return rows.withColumn("__k", F.row_number().over(by)).where("__k = 1").drop("__k")


def examples(rows: DataFrame, instruction: str) -> DataFrame:
    """(unit_id, messages): the question as it is asked when serving, and the text as the answer."""
    ask = F.struct(F.lit("user").alias("role"), T.user_message(instruction, F.col("prev"), F.col("input")).alias("content"))
    tell = F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content"))
    return rows.select("unit_id", F.array(ask, tell).alias("messages"))
