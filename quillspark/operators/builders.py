"""Dataset builders: jobs of several models, judged rewrites, examples, evaluation inputs and reports; a registry of two."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.profiles import HAN, Profile
from quillspark.operators import pairs

KEY = ["unit_id", "prompt_id"]


def draft_gate(rows: DataFrame, low: float = 0.6, high: float = 1.7, coverage: float = 1.0, invented: int = 1) -> DataFrame:
    """rows (original, rewrite, ...) with `why`: empty, length_ratio, number_invented, numbers_missing, latin_invented or ok.

    Numbers go by value without excuses; markers of enumerations in the original needn't survive.
    """
    a, b = F.col("original"), F.col("rewrite")
    ratio = F.length(b) / F.greatest(F.lit(1), F.length(a))
    held = F.struct(T.number_values(a).alias("own"), T.number_values(b).alias("new"), T.listed_values(a).alias("facts"), T.tokens(a).alias("ta"), T.tokens(b).alias("tb"))

    def late(h: Column) -> Column:
        own, new, facts = h["own"], h["new"], h["facts"]
        return (
            F.when(F.size(F.array_except(new, own)) > 0, "number_invented").when((F.size(facts) > 0) & (F.size(F.array_intersect(facts, new)) / F.size(facts) < coverage), "numbers_missing")
            .when(F.size(T.foreign(h["ta"], h["tb"])) > invented, "latin_invented").otherwise("ok")
        )

    early = F.when(F.coalesce(T.strip(b), F.lit("")) == "", "empty").when(~ratio.between(low, high), "length_ratio")
    return rows.withColumn("why", F.coalesce(early, T.let(held, late)))


@dataclass(frozen=True)
class Builder:
    """How rewrites become a data set: the gate, the order in which evaluation inputs are preferred, and what is told of the rest."""

    name: str
    gate: Callable[[DataFrame], DataFrame]
    preference: tuple[str, ...]
    #: whether rows without a text, without a unit or with a key met before are counted
    counts_rest: bool = True
    #: share of a split's units that are also examples of themselves
    identity: float = 0.05
    skipped: tuple[str, ...] = ()
    stages: tuple[str, ...] = ("rewrite",)
    #: evaluation inputs without a family come first by preference; of the others the first inserted
    ranks_families: bool = True
    experimental: bool = False


BUILDERS = {
    b.name: b
    for b in (
        Builder("paragraph_rewrite", pairs.gate, ("style_mimic", "default", "formal", "expand", "condense")),
        Builder("outline_regen", draft_gate, ("draft_style", "draft_default", "draft_formal"), False, 0.0, ("extract",), ("extract", "draft"), False, True),
    )
}


def builder(name: str, experimental: bool = False) -> Builder:
    """A registered builder; experimental ones are to be asked for."""
    if name not in BUILDERS:
        raise ValueError(f"no builder {name}; there are {', '.join(sorted(BUILDERS))}")
    if BUILDERS[name].experimental and not experimental:
        raise ValueError(f"{name} is experimental: allow it in the settings")
    return BUILDERS[name]


def jobs(units: DataFrame, models: list[tuple[str, list[str]]], done: DataFrame) -> DataFrame:
    """(unit_id, prompt_id, model) still to do: every prompt of every model for every unit; prompts of all models but the first end in @model."""
    asked = [(p if not i else f"{p}@{m}", m) for i, (m, prompts) in enumerate(models) for p in prompts]
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("prompt_id"), F.lit(m).alias("model")) for p, m in asked])).alias("j")
    return units.select("unit_id").distinct().select("unit_id", each).select("unit_id", "j.*").join(done.select(*KEY).distinct(), KEY, "left_anti")


def outlined(units: DataFrame, outlines: DataFrame) -> DataFrame:
    """units with their `outline`; a unit without one is an error."""
    rows = units.join(outlines.select("unit_id", "outline"), "unit_id", "left")
    lost = rows.where("outline is null").agg(F.count("*").alias("n"), F.min("unit_id").alias("first")).head()
    if lost.n:
        raise ValueError(f"{lost.n} sections have no outline yet, e.g. {lost.first}")
    return rows


def judged(units: DataFrame, rewrites: DataFrame, rule: Builder) -> DataFrame:
    """rewrites (unit_id, prompt_id, rewrite, line_no) with their unit's original, prev, split and `why`.

    Of the rows of one key that have a text and a unit the first counts, whatever the gate says of it; the others, and
    rows without a text or a unit, are `missing_or_duplicate`.
    """
    own = units.select("unit_id", F.col("text").alias("original"), "prev", "split")
    rows = rewrites.select(*KEY, "rewrite", "line_no")
    if rule.skipped:
        rows = rows.where(~F.col("prompt_id").isin(*rule.skipped))
    rows = rows.join(own, "unit_id", "left")
    usable = (F.coalesce("rewrite", F.lit("")) != "") & F.col("original").isNotNull()
    rows = rows.withColumn("__k", F.row_number().over(W.partitionBy(*KEY, usable).orderBy("line_no")))
    first = rows.where(usable & (F.col("__k") == 1)).drop("__k")
    rest = rows.where(~(usable & (F.col("__k") == 1))).drop("__k").withColumn("why", F.lit("missing_or_duplicate"))
    return rule.gate(first).unionByName(rest)


def reasons(rows: DataFrame, rule: Builder) -> DataFrame:
    """(reason, n): `prompt:why` of judged rows, and of the rest one count if the builder tells it."""
    rest = F.col("why") == "missing_or_duplicate"
    named = F.when(rest, F.col("why")).otherwise(F.concat_ws(":", "prompt_id", "why"))
    return (rows if rule.counts_rest else rows.where(~rest)).groupBy(named.alias("reason")).agg(F.count("*").alias("n"))


def kept_share(rows: DataFrame) -> DataFrame:
    """One row (judged, ok, kept_share): the share of judged rows that passed."""
    known = F.col("why") != "missing_or_duplicate"
    sums = rows.agg(F.count_if(known).alias("judged"), F.count_if(F.col("why") == "ok").alias("ok"))
    return sums.withColumn("kept_share", F.round(F.col("ok") / F.greatest("judged", F.lit(1)), 3))


def training(rows: DataFrame, units: DataFrame, rule: Builder, instruction: str, seed: int = 0) -> DataFrame:
    """(split, unit_id, messages) for train and val in a seeded order: rewrites that passed, and a seeded share of units as their own rewrite."""
    asked = F.col("split").isin("train", "val")
    good = rows.where((F.col("why") == "ok") & asked).select("split", "unit_id", "prev", F.col("rewrite").alias("input"), F.col("original").alias("text"), F.col("prompt_id").alias("kind"))
    hashed = F.md5(F.concat_ws("|", F.lit(str(seed)), "unit_id"))
    # a share of each split by rank of a hash; splits are few, so the rank is taken of ids alone
    ids = units.where(asked).select("split", "unit_id", hashed.alias("h"))
    sizes = ids.groupBy("split").agg(F.floor(F.count("*") * rule.identity).alias("n"))
    ranked = ids.withColumn("k", F.row_number().over(W.partitionBy("split").orderBy("h", "unit_id"))).join(F.broadcast(sizes), "split").where("k <= n").select("split", "unit_id")
    same = units.join(ranked, ["split", "unit_id"]).select("split", "unit_id", "prev", F.col("text").alias("input"), "text", F.lit("").alias("kind"))
    every = good.unionByName(same).withColumn("order", F.md5(F.concat_ws("|", F.lit(str(seed)), "unit_id", "kind")))
    made = pairs.examples(every.withColumn("unit_id", F.struct("split", "order", "unit_id")), instruction)
    return made.select("unit_id.split", "unit_id.order", "unit_id.unit_id", "messages")


def evaluation(rows: DataFrame, rule: Builder) -> DataFrame:
    """(unit_id, prompt_id, ai_text, prev, original): of each test unit the preferred rewrite that passed."""
    base = T.base_prompt(F.col("prompt_id"))
    family = F.contains(F.col("prompt_id"), F.lit("@"))
    rank = F.coalesce(*[F.when((base if rule.ranks_families else F.col("prompt_id")) == p, i) for i, p in enumerate(rule.preference)], F.lit(99))
    order = [family, rank, "line_no"] if rule.ranks_families else [rank, "line_no"]
    # the split first, as the gate is by far the dearer
    good = rows.where("split = 'test' and why = 'ok'")
    first = good.withColumn("__k", F.row_number().over(W.partitionBy("unit_id").orderBy(*order))).where("__k = 1")
    return first.select("unit_id", "prompt_id", F.col("rewrite").alias("ai_text"), "prev", "original")


def train_material(units: DataFrame, rewrites: DataFrame, profile: Profile = HAN) -> DataFrame:
    """(text, y): the author's training units (1) and every rewrite of one that passes the default gate (0), repeats included."""
    own = units.where("split = 'train'").select("unit_id", F.col("text").alias("original"))
    ai = rewrites.where("rewrite <> ''").join(own, "unit_id").select("original", "rewrite")
    ai = pairs.gate(ai, profile=profile).where("why = 'ok'").select(F.col("rewrite").alias("text"), F.lit(0).alias("y"))
    return own.select(F.col("original").alias("text"), F.lit(1).alias("y")).unionByName(ai)


def held_out(units: DataFrame, rewrites: DataFrame, profile: Profile = HAN, cuts: tuple[int, int] = (80, 200)) -> DataFrame:
    """(slice, y, text): held-out units (1) and their rewrites (0), in all, per source family and per length.

    Of the rewrites of one key the first that passes the gate counts. Every source is set against all units; by length,
    units go by their own and rewrites by their original's.
    """
    own = units.where("split in ('val', 'test')").select("unit_id", F.col("text").alias("original"))
    rows = rewrites.where("rewrite <> ''").select(*KEY, "rewrite", "line_no").join(own, "unit_id")
    good = pairs.first_wins(pairs.gate(rows, profile=profile).where("why = 'ok'"), KEY, "line_no")
    low, high = cuts
    bucket = lambda c: F.when(F.length(c) < low, f"len=0-{low}").when(F.length(c) < high, f"len={low}-{high}").otherwise(f"len={high}-")
    source = F.concat(F.lit("source="), T.source_family(F.col("prompt_id")))
    ai = good.select(F.explode(F.array(F.lit("all"), source, bucket("original"))).alias("slice"), F.lit(0).alias("y"), F.col("rewrite").alias("text"))
    # as many as there are families
    named = good.select(source.alias("slice")).distinct().agg(F.collect_list("slice").alias("names"))
    human = own.crossJoin(F.broadcast(named)).select(F.explode(F.concat(F.array(F.lit("all"), bucket("original")), "names")).alias("slice"), F.lit(1).alias("y"), F.col("original").alias("text"))
    return human.unionByName(ai)


def pilot(units: DataFrame, splits: list[str], n: int | None = None, seed: int = 7) -> DataFrame:
    """units of some splits; with `n` a seeded sample of so many."""
    rows = units.where(F.col("split").isin(*splits))
    return rows if n is None else rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "unit_id")), "unit_id").limit(n)
