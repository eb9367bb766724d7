"""Whole articles through a provider: blocks, groups, guard, links put back, and the log of what went in and came out."""

from __future__ import annotations

import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import udx
from quillspark.functions.profiles import HAN, Profile
from quillspark.functions.text import FULL_DIGITS, GROUPED
from quillspark.operators.articles import mapped

#: A provider of rewrites: (text, what stands before it) -> its rewrite.
Provider = Callable[[str, str], str]
Check = Callable[[str, str], str | None]
DIGITS = str.maketrans(FULL_DIGITS, "0123456789")
LOG = "input string, output string, blocks array<int>, attempts int, fallback string"
ARTICLE = f"markdown string, appended int, log array<struct<{LOG}>>, error string"


def values(text: str) -> set[float]:
    """Numbers by value, six significant digits."""
    found = re.findall(GROUPED, text if text.isascii() else text.translate(DIGITS), re.ASCII)
    return {float(f"{float(n.replace(',', '')):.5e}") for n in found}


def drifted(original: str, rewrite: str, profile: Profile = HAN) -> set[float]:
    """Numbers by value that only one text has, but for numerals and years written short."""
    a, b = values(original), values(rewrite)

    def fits(n: float, others: set[float], text: str) -> bool:
        short_year = 0 <= n < 100 and n + 2000 in others or 2000 <= n < 2100 and n - 2000 in others
        return short_year or n == int(n) and any(g in text for g in profile.numerals.get(str(int(n)), ""))

    return {n for n in a - b if not fits(n, b, rewrite)} | {n for n in b - a if not fits(n, a, original)}


def paragraph_check(low: float = 0.6, high: float = 1.6, profile: Profile = HAN) -> Check:
    """Why a rewrite can't stand for its input, or None: the rule of pairs.guard for one pair outside a plan."""

    def check(original: str, rewrite: str) -> str | None:
        ratio = len(rewrite) / max(1, len(original))
        if not low <= ratio <= high:
            return f"length_ratio {ratio:.2f}"
        return "number_changed" if drifted(original, rewrite, profile) else None

    return check


def guarded(provider: Provider, check: Check, retries: int = 1) -> Callable[[str, str], tuple[str, int, str | None]]:
    """(output, calls made, why the input stands in the end or None): a rewrite that fails the check is asked for again."""

    def call(text: str, before: str) -> tuple[str, int, str | None]:
        for k in range(1, retries + 2):
            out = provider(text, before)
            if (reason := check(text, out)) is None:
                return out, k, None
        return text, retries + 1, reason

    return call


def rewritten(
    docs: DataFrame, key: str, provider: Provider, text: str = "text", unit: str = "paragraph", chained: bool = False, check: Check | None = None, retries: int = 1,
    concurrency: int = 4, letter: str = "[一-鿿]", target: int = 900, most: int = 6,
) -> DataFrame:
    """(key, markdown, appended, log, error) of each article of docs.

    A group's rewrite stands in its first block, the group's other blocks go. What stands before a group is the input
    of the group before it, or, if `chained`, its output; chained groups go one after the other, others `concurrency` at
    a time. Links come back into the rewrite; those that fit nowhere are counted in `appended`. Null and blank texts
    give a line end. An article whose provider fails has an error and no markdown, and leaves the others alone.
    """
    call = guarded(provider, check or (lambda a, b: None), retries)

    def article(raw: str | None, pool: ThreadPoolExecutor) -> dict:
        parts = udx.blocks(raw, letter)
        runs = udx.groups(parts, unit, target, most)
        inputs = ["\n\n".join(parts[i]["plain"] for i in run) for run in runs]
        if chained:
            found, before = [], ""
            for x in inputs:
                found.append(call(x, before))
                before = found[-1][0]
        elif len(inputs) == 1:
            found = [call(inputs[0], "")]
        else:
            found = list(pool.map(call, inputs, ["", *inputs[:-1]]))
        shown, appended = [b["text"] for b in parts], 0
        for run, (out, _, _) in zip(runs, found):
            anchors = [(x["anchor"], x["url"]) for i in run for x in parts[i]["links"]]
            shown[run[0]], lost = udx.restored(out, anchors)
            appended += lost
            for i in run[1:]:
                shown[i] = None
        log = [dict(zip(("input", "output", "blocks", "attempts", "fallback"), (x, y, run, n, why))) for run, x, (y, n, why) in zip(runs, inputs, found)]
        return {"markdown": udx.joined([(x, b["tight"]) for x, b in zip(shown, parts)]), "appended": appended, "log": log, "error": None}

    def one(raw: str | None, pool: ThreadPoolExecutor) -> list[tuple]:
        try:
            return [tuple(article(raw, pool).values())]
        except Exception as e:  # noqa: BLE001
            return [(None, None, None, f"{type(e).__name__}: {e}")]

    return mapped(docs, key, F.col(text), one, ARTICLE, lambda: ThreadPoolExecutor(concurrency))


def log_rows(articles: DataFrame, key: str) -> DataFrame:
    """(key, k, input, output, blocks, attempts, fallback): one row a group."""
    return articles.select(key, F.posexplode("log").alias("k", "g")).select(key, "k", "g.*")


def aligned(blocks: DataFrame, logs: DataFrame, key: str = "article") -> DataFrame:
    """(key, idx, text, prose, system, output, first, uncovered): each block beside what every system made of its group.

    `first` marks the block where a group's output stands. `uncovered` marks prose that a system's log leaves out:
    such logs are of another text. Blocks that aren't prose have no output.
    """
    systems = logs.select(key, "system").distinct()
    covers = logs.select(key, "system", "output", F.posexplode("blocks").alias("__at", "idx")).withColumn("first", F.col("__at") == 0).drop("__at")
    grid = blocks.select(key, "idx", "text", "prose").join(systems, key)
    return grid.join(covers, [key, "system", "idx"], "left").select(
        key, "idx", "text", "prose", "system", "output", F.coalesce("first", F.lit(False)).alias("first"), (F.col("prose") & F.col("first").isNull()).alias("uncovered")
    )


def unequal_starts(logs: DataFrame, key: str = "article") -> DataFrame:
    """(key, idx, systems, of): first blocks of groups that some systems' logs of an article have and others lack; no row: they can be shown side by side."""
    starts = logs.select(key, "system", F.element_at("blocks", 1).alias("idx")).distinct()
    total = starts.groupBy(key).agg(F.countDistinct("system").alias("of"))
    return starts.groupBy(key, "idx").agg(F.count("*").alias("systems")).join(total, key).where("systems < of")


def link_counts(logs: DataFrame, *by: str) -> DataFrame:
    """(by, links_in, links_out): links of inputs (as marked up) and outputs."""
    count = lambda c: F.sum(F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"(?<!!)\[[^\]]+\]\([^)]+\)"))).cast("long")
    return logs.groupBy(*by).agg(count("input").alias("links_in"), count("output").alias("links_out"))
