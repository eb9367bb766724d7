"""Mixing sources to target weights by entropy balancing.

Document rates are the ones nearest to 1 (in entropy, a document weighing its size over its tilt) whose tokens meet
each source's target and none of which exceeds CAP: r = min(CAP, exp(lambda * tilt)). The tilt, from 0.5 to 1.5,
grows with the document's size, so that a source is filled or thinned through its longer documents first without
emptying either end. The dual is convex, with one multiplier a source. As every document has one source, its Hessian is
diagonal: each Newton iteration is one grouped sum of the gradient and the Hessian over all sources at once, then a step
of every multiplier within its bracket.

Sums run over cells, the number of documents of one size in a source, which are a sufficient statistic. Copies are rounded
over them too: cells go from the largest size to the least and each passes on what it missed, so a source ends within
about its least document of its target. Rounding is one task a source; it holds a row for each size that its documents
have, which is at most the length of its longest document.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import NO_ID, back, free, materialize, n_words, numbered

CAP, SHARE, WEIGHTS, SALTS, SMALL = 2, 1.5, (5, 2, 1), 16, 10_000
STEPS, CLOSE = 60, 1e-7


def targets(sources: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size, target): weights go round the sources in order of code points, null last."""
    rows = numbered(sources, "place", F.col("source").asc_nulls_last())
    rows = materialize(rows.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int")).alias("w")), "sources")
    total, all_weights = rows.agg(F.sum("source_size"), F.sum("w")).first()
    level, full = (share * total / all_weights if all_weights else 0.0), -1
    while True:  # what is above the cap is dealt anew to the others by weight, until none is above
        above = F.col("w") * F.lit(float(level)) > cap * F.col("source_size")
        n, held, rest = rows.agg(F.count(F.when(above, 1)), F.sum(F.when(above, cap * F.col("source_size"))), F.sum(F.when(~above, F.col("w")))).first()
        if n == full or not rest:
            break
        full, level = n, max(level, (share * total - (held or 0)) / rest)
    return rows.select("source", "source_size", F.least(F.col("w") * F.lit(float(level)), cap * F.col("source_size")).cast("double").alias("target"))


def rate_of(cap: float) -> Column:
    """The rate of a cell (size) under its source's multiplier (at, mean)."""
    tilt = 0.5 + F.col("size") / (F.col("size") + F.col("mean"))
    free_rate = F.least(F.lit(float(cap)), F.exp(F.col("at") * tilt))
    return F.when(F.col("target") <= 0, 0.0).when(F.col("full"), float(cap)).otherwise(free_rate)


def multipliers(cells: DataFrame, goal: DataFrame, cap: float = CAP, steps: int = STEPS) -> DataFrame:
    """(source, source_size, target, mean, full, at): the dual's root of each source. cells: (source, size, n); goal: targets()."""
    sums = cells.groupBy("source").agg(F.sum("n").alias("docs"))
    start = goal.join(sums, goal["source"].eqNullSafe(sums["source"])).select(goal["source"], "source_size", "target", (F.col("source_size") / F.greatest("docs", F.lit(1))).alias("mean"))
    ratio = F.log(F.col("target") / F.col("source_size"))
    # sources at their cap or without words have nothing to solve
    full = (F.col("source_size") == 0) | (F.col("target") >= cap * F.col("source_size") * (1 - 1e-12))
    state = start.withColumn("full", full).withColumns({"at": ratio, "low": ratio / 0.5 - 1, "high": F.log(F.lit(float(cap))) / 0.5 + 1, "open": ~full & (F.col("target") > 0)})
    state = materialize(state, "multipliers")
    load, tilt = F.col("size") * F.col("n"), 0.5 + F.col("size") / (F.col("size") + F.col("mean"))
    raw = F.exp(F.col("at") * tilt)
    for _ in range(steps):
        if not state.where("open").limit(1).count():
            break
        named = state.where("open").select(F.col("source").alias("s"), "target", "mean", "at")
        sums = cells.join(named, F.col("source").eqNullSafe(F.col("s"))).groupBy("s").agg(
            F.sum(load * F.least(F.lit(float(cap)), raw)).alias("tokens"), F.sum(F.when(raw < cap, load * tilt * raw).otherwise(0.0)).alias("slope")
        )
        miss = F.col("tokens") - F.col("target")
        low, high = F.when(miss < 0, F.col("at")).otherwise(F.col("low")), F.when(miss < 0, F.col("high")).otherwise(F.col("at"))
        new = F.col("at") - miss / F.nullif(F.col("slope"), F.lit(0.0))
        step = F.when((new > low) & (new < high), new).otherwise((low + high) / 2)
        going = F.coalesce(F.abs(miss) > CLOSE * F.col("target"), F.lit(False))
        after = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left")
        keep = lambda a, b: F.when(going, a).otherwise(F.col(b)).alias(b)
        state = materialize(after.select("source", "source_size", "target", "mean", "full", keep(step, "at"), keep(low, "low"), keep(high, "high"), going.alias("open")), "multipliers")
    return state.select("source", "source_size", "target", "mean", "full", "at")


def rounded(pdf: pd.DataFrame, cap: int) -> pd.DataFrame:
    """One source's cells (size, n, rate) with whole copies."""
    pdf = pdf.sort_values("size", ascending=False)
    copies, carry = [], 0.0
    for s, k, r in zip(pdf["size"].tolist(), pdf["n"].tolist(), pdf["rate"].tolist()):
        carry += s * k * r
        c = min(int(cap) * k, max(0, round(carry / s))) if s else k
        carry -= c * s
        copies.append(c)
    return pdf.assign(copies=copies)


def met(rows: DataFrame, found: DataFrame, place: str, *on: str) -> DataFrame:
    """rows that agree with a row of `found`, a written table, in the columns `on`, with its other columns; null equals null.

    Up to SMALL rows, some 2 MB at most but for long names of sources, are counted and broadcast. More are met by a sort-merge join, whose salt of
    `place`, which no row shares with another, keeps a frequent key from meeting in one task.
    """
    other = [c for c in found.columns if c not in on]
    *theirs, salt = free([*rows.columns, *found.columns], *(f"t_{c}" for c in on), "t_salt")
    to = found.select(*[F.col(c).alias(t) for c, t in zip(on, theirs)], *other)
    same = F.lit(True)
    for c, t in zip(on, theirs):
        same &= F.col(c).eqNullSafe(F.col(t))
    if found.count() <= SMALL:
        return rows.join(F.broadcast(to), same).drop(*theirs)
    to = to.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    return rows.join(to, same & (F.pmod(F.col(place), F.lit(SALTS)) == F.col(salt))).drop(*theirs, salt)


def of_cell(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """left (source, size, ...) with right's columns but (source, size), which a cell agrees in. Both grow with the cells, so neither is broadcast."""
    to = right.withColumnsRenamed({"source": "s", "size": "z"}).hint("merge")
    return left.join(to, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")), how).drop("s", "z")


def reached(counts: DataFrame, wanted: DataFrame, part: str) -> DataFrame:
    """(source, size, part, k): where in the order of `part` the k-th row of each cell of `wanted` lies, and which row of that part it is."""
    upto = F.sum("n").over(W.partitionBy("source", "size").orderBy(part))
    rows = of_cell(counts, wanted.select("source", "size", "k")).withColumn("upto", upto)
    return rows.where("k > upto - n and k <= upto").select("source", "size", part, (F.col("k") - F.col("upto") + F.col("n")).alias("k"))


def edges(rows: DataFrame, ranges: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, size, order, place) of the k-th row of each cell of `wanted` (source, size, k), in order of both.

    rows: (source, size, order, place). The search goes from sixteenths of the orders to 4,096 slices of one, then to one
    order; as equal rows share it, on to 4,096 slabs of the places and to one place. No step ranks more than 4,096 parts
    of a cell, or the rows of one slice or slab.
    """
    cell = ["source", "size"]
    parts = {"range": F.shiftright("order", 60), "slice": F.shiftright("order", 48), "slab": F.shiftright("place", 52)}
    near, at = rows.withColumns(parts), materialize(reached(ranges, wanted, "range"), "edge")
    for known, part in (("range", "slice"), ("slice", "order"), ("order", "slab"), ("slab", "place")):
        near = materialize(met(near, at.drop("k"), "place", *cell, known), "near")
        counts = near.groupBy(*cell, part).agg(F.count("*").alias("n"))
        at = materialize(reached(counts, at, part), "edge")
    return met(near, at.drop("k"), "place", *cell, "place").select(*cell, "order", "place")


def mixed_rows(docs: DataFrame, kept: list[str], share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> tuple[DataFrame, list[str]]:
    """Columns `kept` of docs, with columns whose names follow: source, size, source_size, target, rate, copies.

    Which documents of a cell take one copy more goes by a hash of id and text, however the table is split; rows equal
    in both may swap copies: a place told once, when the rows are written, decides among them.
    """
    names = docs.columns
    own = free(names, "m_source", "m_size", "m_order", "m_place", "m_source_size", "m_target", "m_rate", "m_copies", "m_base", "m_last", "m_last_place")
    source, size, order, place, source_size, target, rate, copies, base, last, last_place = own
    rows = docs.withColumns({
        source: F.col("source").cast("string") if "source" in names else F.lit(None).cast("string"),
        size: n_words(F.col("text")),
        order: F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.coalesce("text", F.lit(""))),
        place: F.xxhash64(F.monotonically_increasing_id()),
    })
    rows = materialize(rows.select(*kept, *own[:4]), "rows")
    keys = rows.select(*own[:4]).toDF("source", "size", "order", "place")
    ranges = materialize(keys.groupBy("source", "size", F.shiftright("order", 60).alias("range")).agg(F.count("*").alias("n")), "cells")
    cells = ranges.groupBy("source", "size").agg(F.sum("n").alias("n"))
    goal = targets(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), share, weights, cap)
    solved = multipliers(cells, goal, cap).withColumnRenamed("source", "s")
    aimed = cells.join(solved, F.col("source").eqNullSafe(F.col("s"))).select("source", "size", "n", "source_size", "target", rate_of(cap).alias("rate"))
    kind = "source string, size long, n long, source_size long, target double, rate double, copies long"
    whole = materialize(aimed.groupBy("source").applyInPandas(lambda pdf: rounded(pdf, cap), kind), "solved")
    # the first copies % n of a cell's documents take one copy more than the others
    edge = edges(keys, ranges, whole.select("source", "size", F.expr("copies % n").alias("k")).where("k > 0"))
    whole = of_cell(whole.withColumn("base", F.expr("copies div n")), edge.toDF("source", "size", "last", "last_place"), "left")
    whole = whole.select("source", "size", "source_size", "target", "rate", "base", "last", "last_place").toDF(source, size, source_size, target, rate, base, last, last_place)
    one_more = (F.col(order) < F.col(last)) | ((F.col(order) == F.col(last)) & (F.col(place) <= F.col(last_place)))
    out = met(rows, materialize(whole, "solved"), place, source, size).withColumn(copies, F.col(base) + F.coalesce(one_more, F.lit(False)).cast("long"))
    found = [source, size, source_size, target, rate, copies]
    return out.select(*kept, *found), found


def mixed(docs: DataFrame, **parameters) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies) of each row of docs (doc_id, text, source). Documents without words have one copy."""
    own = docs.select("doc_id", "text", *(["source"] if "source" in docs.columns else []))
    rows, found = mixed_rows(own, ["doc_id"], **parameters)
    return rows.select("doc_id", *[F.col(c).alias(a) for c, a in zip(found, ("source", "size", "source_size", "target", "rate", "copies"))])


def mix_report(docs: DataFrame) -> DataFrame:
    """Contract form. Null texts have no words, null is a source of its own, null ids stay null."""
    return mixed(docs).select(back(F.col("doc_id").cast("long")).alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


def mixture(docs: DataFrame) -> DataFrame:
    """docs, all columns, each row as often as the mix takes it (not at all, once or more)."""
    rows, found = mixed_rows(docs, docs.columns)
    copy = free(rows.columns, "copy")[0]
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(0), F.lit(CAP)))).where(F.col(copy) < F.col(found[-1])).select(*docs.columns)
