"""Posts to units: exclusion, splits, running positions and what came before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.profiles import HAN, Profile


def units(docs: DataFrame, key: str, profile: Profile = HAN) -> DataFrame:
    """(key, idx, text, prev): paragraphs in order, each with the one before it."""
    rows = docs.select(key, F.posexplode(T.paragraphs(F.col("text"), profile)).alias("idx", "text"))
    return rows.withColumn("prev", F.coalesce(F.lag("text").over(W.partitionBy(key).orderBy("idx")), F.lit("")))


def exclusion_reason(rules: dict[str, Column]) -> Column:
    """The first rule (in order) that a post meets; null: it stays."""
    out = None
    for name, rule in rules.items():
        out = F.when(rule, name) if out is None else out.when(rule, name)
    return out


def post_rules(slugs=(), suffixes=(), tags=(), statuses=(), first=None, last=None, ratio: float = 0.15) -> dict[str, Column]:
    """Exclusion rules over (slug, name, tags, status, date, body)."""
    lower = F.transform("tags", lambda t: F.lower(F.trim(t)))
    return {
        "slug": F.col("slug").isin(*slugs) if slugs else F.lit(False),
        "filename_suffix": F.exists(F.array(*map(F.lit, suffixes)), lambda s: F.endswith(F.col("name"), s)) if suffixes else F.lit(False),
        "tag": F.arrays_overlap(lower, F.array(*[F.lit(t.lower()) for t in tags])) if tags else F.lit(False),
        "status": F.lower("status").isin(*[s.lower() for s in statuses]) if statuses else F.lit(False),
        "no_date": F.col("date").isNull() if first or last else F.lit(False),
        "date_range": ~F.col("date").between(F.lit(first or "0001-01-01").cast("date"), F.lit(last or "9999-12-31").cast("date")),
        "not_chinese": T.script_ratio(T.clean_markdown(F.col("body"))) < ratio,
    }


def splits(posts: DataFrame, key: str, bucket: str, n_test: int = 20, n_val: int = 10, seed: int = 0, least: dict | None = None) -> DataFrame:
    """posts with `split`: in each bucket, by a seeded hash, its share of test and validation posts; a bucket keeps one for training."""
    by = W.partitionBy(bucket)
    total = posts.count()
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    n = F.count("*").over(by)
    floor = F.coalesce(*[F.when(F.col(bucket) == b, k) for b, k in (least or {}).items()], F.lit(1))
    part = lambda k: F.bround(k * n / F.lit(max(total, 1)), 0).cast("long")
    test = F.least(F.greatest(floor.cast("long"), part(n_test)), n - 1)
    k = F.row_number().over(by.orderBy(order, key))
    return posts.withColumn("split", F.when(k <= test, "test").when(k <= test + part(n_val), "val").otherwise("train"))


def split_report(rows: DataFrame, bucket: str) -> DataFrame:
    return rows.groupBy("split").agg(F.countDistinct(bucket).alias("buckets"), F.count("*").alias("posts"))


def corpus_report(units: DataFrame) -> DataFrame:
    """(split, posts, units, chars) of units (slug, text, split)."""
    return units.groupBy("split").agg(F.countDistinct("slug").alias("posts"), F.count("*").alias("units"), F.sum(F.length("text")).cast("long").alias("chars"))


def exclusion_counts(posts: DataFrame) -> DataFrame:
    """(reason, n) of posts (name, reason): files of one name, wherever they lie, count once."""
    return posts.where("reason is not null").groupBy("name").agg(F.max("reason").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def with_split(posts: DataFrame, fixed: DataFrame) -> DataFrame:
    """posts (slug, ...) with the split of an earlier round; new posts are for training."""
    return posts.drop("split").join(fixed.select("slug", "split"), "slug", "left").withColumn("split", F.coalesce("split", F.lit("train")))
