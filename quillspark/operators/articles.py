"""Articles: blocks, units and sections of posts, rewriting through a provider, links put back, blind items."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import nullcontext

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.functions import text as T
from quillspark.functions import udx
from quillspark.functions.profiles import HAN, Profile


def mapped(docs: DataFrame, key: str, value: Column, make: Callable, fields: str, held: Callable = nullcontext, chars: int = 1_000_000) -> DataFrame:
    """(key, fields): rows (tuples) that make(value, what `held` opened for the task) gives for each row of docs.

    Values are read a few at a time and rows go on in small batches, so a task holds one batch of Spark's and little
    beside it; and as no optimizer sees into it, it runs once however its columns are used.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = docs.select(key, value.alias("__value"))
    kind = StructType([rows.schema[key], *StructType.fromDDL(fields)])
    arrow = to_arrow_schema(kind)

    def run(batches):
        with held() as opened:
            for batch in batches:
                places, made, size = [], [], 0
                for start in range(0, len(batch), 16):
                    for i, x in enumerate(batch.column(1).slice(start, 16).to_pylist(), start):
                        new = list(make(x, opened))
                        places += [i] * len(new)
                        made += new
                        size += sum(len(c) for row in new for c in row if isinstance(c, str)) + 64 * len(new)
                        if size >= chars:
                            yield packed(batch, places, made)
                            places, made, size = [], [], 0
                if made:
                    yield packed(batch, places, made)

    def packed(batch, places, made):
        columns = [pa.array(c, t) for c, t in zip(zip(*made), arrow.types[1:])]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places, pa.int64())), *columns], names=arrow.names)

    return rows.mapInArrow(run, kind)


def block_rows(docs: DataFrame, key: str, text: str = "text", letter: str = "[一-鿿]") -> DataFrame:
    """(key, idx, text, prose, tight, plain, links): one row a block. Null and blank texts have none."""

    def rows(x, _):
        return [(i, *(b[c] for c in ("text", "prose", "tight", "plain", "links"))) for i, b in enumerate(udx.blocks(x, letter))]

    return mapped(docs, key, F.col(text), rows, "idx int, text string, prose boolean, tight boolean, plain string, links array<struct<anchor: string, url: string>>")


def rejoined(parts: DataFrame, key: str, output: str = "output") -> DataFrame:
    """(key, markdown) of block rows (idx, tight, output); blocks with a null output went into an earlier one."""
    item = F.struct("idx", F.when(F.col("tight"), "\n").otherwise("\n\n").alias("gap"), F.col(output).alias("out"))
    held = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col(output).isNotNull(), item))).alias("x"))
    whole = F.array_join(F.transform("x", lambda b, i: F.concat(F.when(i > 0, b["gap"]).otherwise(""), b["out"])), "")
    return held.select(key, F.concat(whole, F.lit("\n")).alias("markdown"))


def _with_previous(docs: DataFrame, key: str, value: Column, texts: Callable[[list | None], list[str]]) -> DataFrame:
    def rows(x, _):
        units = texts(x)
        return [(i, u, units[i - 1] if i else "") for i, u in enumerate(units)]

    return mapped(docs, key, value, rows, "idx int, text string, prev string")


def merged_units(docs: DataFrame, key: str, text: str = "text", least: int = 50, most: int = 800, profile: Profile = HAN) -> DataFrame:
    """(key, idx, text, prev): paragraphs of the cleaned body, short ones merged and long ones split."""
    return _with_previous(docs, key, T.paragraphs(T.clean_markdown(F.col(text)), profile), lambda x: udx.merged(x, least, most))


def section_units(docs: DataFrame, key: str, text: str = "text", target: int = 900, most: int = 6, tail: int = 300, profile: Profile = HAN) -> DataFrame:
    """(key, idx, text, prev): windows of neighbouring paragraphs that don't cross a heading."""
    chunks = F.split(F.concat(F.lit("\n"), F.coalesce(text, F.lit(""))), r"\n(?=[ \t]*#{1,6}\s)")
    return _with_previous(docs, key, F.transform(chunks, lambda c: T.paragraphs(T.clean_markdown(c), profile)), lambda x: udx.sections(x, target, most, tail))


def enriched(jobs: DataFrame, provider: Callable[[dict], str], concurrency: int = 4, attempts: int = 3, wait: float = 5.0) -> DataFrame:
    """jobs with `output` and `error`: provider(row) called by a few threads a task, again after wait, 2 wait, ... seconds.

    A failure is a row with an error, so one job never ends the others; done_keys() leaves it for the next run.
    """

    def call(row: dict) -> tuple[str | None, str | None]:
        for k in range(1, attempts + 1):
            try:
                return provider(row), None
            except Exception as e:  # noqa: BLE001
                error = f"{type(e).__name__}: {e}"
            if k < attempts:
                time.sleep(wait * k)
        return None, error

    def run(frames):
        with ThreadPoolExecutor(concurrency) as pool:
            for frame in frames:
                found = list(pool.map(call, frame.to_dict("records")))
                yield frame.assign(output=[x for x, _ in found], error=[e for _, e in found])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in jobs.schema)
    return jobs.mapInPandas(run, f"{fields}, output string, error string")


def blind_items(pairs: DataFrame, key: str, n_single: int, n_pairs: int, seed: int = 7) -> DataFrame:
    """(id, kind, key, text, left, right, own_side) of usable pairs (original, rewrite) by a seeded hash.

    n_single originals, as many rewrites of other rows, then n_pairs of both on sides that a hash picks. Too few usable
    pairs are an error.
    """
    usable = pairs.where((F.coalesce("rewrite", F.lit("")) != "") & F.length("original").between(60, 420))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    # a limit of a sort is taken in each task first, so no single one meets all rows
    total = 2 * n_single + n_pairs
    first = usable.select(key, "original", "rewrite", order.alias("o")).orderBy("o", key).limit(total)
    if (found := first.count()) < total:
        raise ValueError(f"{total} usable pairs are needed, there are {found}")
    rows = first.withColumn("k", F.row_number().over(W.orderBy("o", key)) - 1)
    own, both = F.col("k") < n_single, F.col("k") >= 2 * n_single
    left = F.ascii("o") % 2 == 0
    pick = lambda a, b: F.when(both, F.when(left, F.col(a)).otherwise(F.col(b)))
    return rows.select(
        F.when(both, F.format_string("s2-%02d", F.col("k") - 2 * n_single)).otherwise(F.format_string("s1-%02d", "k")).alias("id"),
        F.when(both, "pair").when(own, "own").otherwise("rewritten").alias("kind"), key, F.when(own, F.col("original")).when(~both, F.col("rewrite")).alias("text"),
        pick("original", "rewrite").alias("left"), pick("rewrite", "original").alias("right"), F.when(both, F.when(left, "left").otherwise("right")).alias("own_side"),
    )
