"""Scores of systems and checks of a classifier."""

from __future__ import annotations

from collections import Counter
from string import punctuation

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.profiles import HAN, Profile


def separation(rows: DataFrame, *by: str) -> DataFrame:
    """Of (by, y, p): counts, exact AUC by average ranks, means and shares on the right side of 0.5."""
    ties = rows.groupBy(*by, "p").agg(F.count("*").alias("n"), F.sum("y").alias("pos")).withColumn("__b", F.floor(F.col("p") * 1000))
    # ranks in two levels, so that no task meets all scores: within a thousandth, and the thousandths before it
    parts = ties.groupBy(*by, "__b").agg(F.sum("n").alias("__n"))
    before = parts.select(*by, "__b", (F.sum("__n").over(W.partitionBy(*by).orderBy("__b")) - F.col("__n")).alias("__before"))
    within = F.sum("n").over(W.partitionBy(*by, "__b").orderBy("p")) - F.col("n")
    ranked = ties.withColumn("__within", within).join(before, [*by, "__b"]).withColumn("rank", F.col("__before") + F.col("__within") + (F.col("n") + 1) / 2)
    pos, neg = F.sum("pos"), F.sum(F.col("n") - F.col("pos"))
    auc = (F.sum(F.col("rank") * F.col("pos")) - pos * (pos + 1) / 2) / (pos * neg)
    mean = lambda w: F.sum(F.col("p") * w) / F.sum(w)
    other = F.col("n") - F.col("pos")
    share = lambda c, w: F.sum(F.when(c, w).otherwise(0)) / F.sum(w)
    out = ranked.groupBy(*by).agg(
        pos.cast("long").alias("n_pos"), neg.cast("long").alias("n_neg"), auc.alias("auc"), mean(F.col("pos")).alias("mean_pos"), mean(other).alias("mean_neg"),
        share(F.col("p") > 0.5, F.col("pos")).alias("pos_above"), share(F.col("p") < 0.5, other).alias("neg_below"),
    )
    return out.where("n_pos > 0 and n_neg > 0").select(*by, "n_pos", "n_neg", *[F.round(c, 6).alias(c) for c in ("auc", "mean_pos", "mean_neg", "pos_above", "neg_below")])


def gram_counts(hyp: str | None, ref: str | None, char_orders: int, word_orders: int) -> list[tuple[int, int, int]]:
    """Of each order: grams of hyp, of ref, and in both. Characters without white space; words with a mark at an end as a word of its own."""

    def words(text: str) -> list[str]:
        out = []
        for w in text.split():
            if len(w) > 1 and w[-1] in punctuation:
                out += [w[:-1], w[-1]]
            elif len(w) > 1 and w[0] in punctuation:
                out += [w[0], w[1:]]
            else:
                out.append(w)
        return out

    def counted(items, n: int) -> Counter:
        return Counter(zip(*(items[i:] for i in range(n))))

    def shared(h: Counter, r: Counter) -> int:
        return sum([n if n <= (other := r.get(g, 0)) else other for g, n in h.items()])

    both = [("".join((x or "").split()), words(x or "")) for x in (hyp, ref)]
    out = []
    for kind, orders in ((0, char_orders), (1, word_orders)):
        for n in range(1, orders + 1):
            h, r = (counted(x[kind], n) for x in both)
            # a reference without grams of this order says nothing about the others
            out.append((h.total() if r else 0, r.total(), shared(h, r)))
    return out


def chrf(pairs: DataFrame, char_orders: int = 6, word_orders: int = 2, beta: float = 2.0) -> DataFrame:
    """(system, chrf): corpus chrF++ of (system, hyp, ref); plain chrF with no word orders.

    Grams are counted within a row, where both texts are, so that only sums of orders are exchanged.
    """
    kind = "system string, sums array<array<long>>"

    def run(frames):
        for f in frames:
            yield f.assign(sums=[[list(map(int, x)) for x in gram_counts(h, r, char_orders, word_orders)] for h, r in zip(f["hyp"], f["ref"])])[["system", "sums"]]

    rows = pairs.select(F.col("system").cast("string").alias("system"), "hyp", "ref").mapInPandas(run, kind)
    each = rows.select("system", F.posexplode("sums").alias("n", "s")).groupBy("system", "n").agg(*[F.sum(F.col("s")[i]).alias(c) for i, c in enumerate("hrm")])
    mean = each.where("h > 0 and r > 0").groupBy("system").agg(F.avg(F.col("m") / F.col("h")).alias("p"), F.avg(F.col("m") / F.col("r")).alias("q"))
    b = beta * beta
    return mean.select("system", F.round(F.coalesce(100 * (1 + b) * F.col("p") * F.col("q") / F.nullif(b * F.col("p") + F.col("q"), F.lit(0.0)), F.lit(0.0)), 6).alias("chrf"))


def aligned_outputs(inputs: DataFrame, outputs: DataFrame, order: str | Column = "line_no") -> DataFrame:
    """inputs (unit_id, ...) with each system's `output`: of rows of one id the last in `order` counts. An input that a system lacks is an error."""
    last = outputs.groupBy("system", "unit_id").agg(F.max_by("output", order).alias("output"))
    grid = inputs.crossJoin(F.broadcast(outputs.select("system").distinct()))  # as many systems as were run
    rows = grid.join(last, ["system", "unit_id"], "left")
    lost = rows.where("output is null").groupBy("system").agg(F.count("*").alias("n"), F.min("unit_id").alias("first")).orderBy("system").head()
    if lost:
        raise ValueError(f"{lost.system} lacks {lost.n} held-out paragraphs, e.g. {lost.first}")
    return rows


def system_scores(rows: DataFrame, lexicon: list[str], profile: Profile = HAN) -> DataFrame:
    """(system, chrf, p_human, above_half, marker_rate, number_err, len_ratio) of (system, input, output, original, p)."""
    drift = F.size(T.number_drift(F.col("input"), F.col("output"), profile)) > 0
    six = lambda c: F.round(c, 6)
    text = F.coalesce("output", F.lit(""))
    rate = 1000.0 * F.sum(T.total_hits(text, lexicon)).cast("long") / F.greatest(F.lit(1), F.sum(F.length(text)).cast("long"))
    # the rate (features.marker_rate) beside the others, so that rows are made once for all of them
    sums = rows.groupBy("system").agg(
        six(F.avg("p")).alias("p_human"), six(F.avg((F.col("p") > 0.5).cast("int"))).alias("above_half"), six(rate).alias("marker_rate"), six(F.avg(drift.cast("int"))).alias("number_err"),
        six(F.median(F.length("output") / F.greatest(F.lit(1), F.length("original")))).alias("len_ratio"),
    )
    grams = chrf(rows.select("system", F.col("output").alias("hyp"), F.col("original").alias("ref")))
    return sums.join(grams, "system", "left").select("system", F.coalesce("chrf", F.lit(0.0)).alias("chrf"), "p_human", "above_half", "marker_rate", "number_err", "len_ratio")


def flagged(scores: DataFrame, original: str = "original") -> DataFrame:
    """scores of systems with `flags`, against the row of the originals; originals have none."""
    base = scores.where(F.col("system") == original).select(F.col("p_human").alias("p0"), F.col("marker_rate").alias("rate0"))
    over = F.when((F.col("p_human") > F.col("p0") + 0.03) | (F.col("marker_rate") < 0.6 * F.col("rate0")), "overshoot")
    found = F.array_compact(F.array(over, F.when(F.col("number_err") > 0.05, "number_drift")))
    own = F.col("system") == original
    return scores.crossJoin(F.broadcast(base)).withColumn("flags", F.when(own, F.array().cast("array<string>")).otherwise(found)).drop("p0", "rate0")


def article_means(logs: DataFrame, lexicon: list[str]) -> DataFrame:
    """(system, p_human, marker_rate, paragraphs) of block logs (article, system, input, output, p_in, p_out), and as `ai_input` the inputs of the system whose logs come first by name."""
    from quillspark.operators.features import marker_rate

    first = logs.agg(F.min_by("system", F.concat_ws(".", "article", "system")).alias("system"))
    own = logs.select("system", F.col("output").alias("text"), F.col("p_out").alias("p"))
    given = logs.join(F.broadcast(first), "system").select(F.lit("ai_input").alias("system"), F.col("input").alias("text"), F.col("p_in").alias("p"))
    rows = own.unionByName(given)
    means = rows.groupBy("system").agg(F.round(F.avg("p"), 6).alias("p_human"), F.count("*").alias("paragraphs"))
    rates = marker_rate(rows, lexicon, "system").select("system", F.col("rate").alias("marker_rate"))
    return means.join(rates, "system").select("system", "p_human", "marker_rate", "paragraphs")


def compare_stats(logs: DataFrame, lexicon: list[str]) -> DataFrame:
    """(system, p_in, m_in, p_out, m_out): means before and after, of the same logs."""
    from quillspark.operators.features import marker_rate

    means = logs.groupBy("system").agg(F.round(F.avg("p_in"), 6).alias("p_in"), F.round(F.avg("p_out"), 6).alias("p_out"))
    for side, name in (("input", "m_in"), ("output", "m_out")):
        means = means.join(marker_rate(logs.select("system", F.col(side).alias("text")), lexicon, "system").select("system", F.col("rate").alias(name)), "system")
    return means.select("system", "p_in", "m_in", "p_out", "m_out")


def with_losses(scores: DataFrame, curve: DataFrame) -> DataFrame:
    """scores of checkpoints (step, ...) with `val_loss`, null where the log has none."""
    return scores.join(curve.select("step", F.col("eval_loss").alias("val_loss")), "step", "left")


def lowest(curve: DataFrame, k: int = 3) -> DataFrame:
    """The steps of least loss: those to score first."""
    return curve.orderBy("eval_loss", "step").limit(k)


def selection_notes(curve: DataFrame, scored: DataFrame) -> DataFrame:
    """(note): what the losses (step, epoch, eval_loss) and the flags of checkpoints say about the run."""
    ends = curve.agg(F.min_by(F.struct("step", "epoch", "eval_loss"), F.struct("eval_loss", "step")).alias("best"), F.min("step").alias("first"), F.max_by("eval_loss", "step").alias("last"), F.count("*").alias("n"))
    at = F.format_string("%.2f", "best.epoch")
    early = F.when((F.col("best.step") == F.col("first")) & (F.col("n") > 1), F.concat(F.lit("validation loss is lowest at the first evaluation (epoch "), at, F.lit("): train shorter or evaluate earlier")))
    rose = F.col("last") / F.col("best.eval_loss")
    late = F.when(rose > 1.05, F.concat(F.lit("validation loss rose "), F.format_string("%.0f", F.bround(100 * (rose - 1), 0)), F.lit("% after its minimum at epoch "), at, F.lit(": memorisation")))
    none = scored.agg(F.count("*").alias("n"), F.count_if(F.size("flags") == 0).alias("clean")).select(F.when((F.col("n") > 0) & (F.col("clean") == 0), F.lit("every scored checkpoint is flagged: train shorter or slower")).alias("note"))
    return ends.select(F.explode(F.array(early, late)).alias("note")).unionByName(none).where("note is not null")


def blind_score(items: DataFrame, answers: DataFrame) -> DataFrame:
    """One row of counts of a blind test. items: articles.blind_items(); answers: (id, answer), null or absent where not given.

    s1: how often rewrites and originals were taken for the author's; s2: pairs decided, those in which the rewrite won, and the chance of as many wins by luck.
    """
    rows = items.join(answers.select("id", F.lower(F.trim("answer")).alias("answer")).where("answer is not null"), "id", "left")
    single, mine = F.col("kind") != "pair", F.col("answer") == "true"
    decided = (F.col("kind") == "pair") & F.col("answer").isin("left", "right")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    out = rows.agg(
        count(single & F.col("answer").isNotNull()).alias("s1_answered"), count((F.col("kind") == "rewritten") & mine).alias("s1_rewrites_taken"), count(F.col("kind") == "rewritten").alias("s1_rewrites"),
        count((F.col("kind") == "own") & mine).alias("s1_originals_taken"), count(F.col("kind") == "own").alias("s1_originals"), count(~single & F.col("answer").isNotNull()).alias("s2_answered"),
        count(decided & (F.col("answer") != F.col("own_side"))).alias("s2_wins"), count(decided).alias("s2_decided"),
    )
    tail = F.round(binomial_tail(F.col("s2_wins").cast("int"), F.col("s2_decided").cast("int")) + 1e-9, 4)
    return out.withColumn("s2_p_value", F.when(F.col("s2_decided") > 0, tail))


def usage_totals(results: DataFrame, *by: str) -> DataFrame:
    """(by, calls, failed, prompt_tokens, completion_tokens) of results (error, usage map)."""
    total = lambda k: F.coalesce(F.sum(F.col("usage")[k]), F.lit(0)).cast("long").alias(k)
    return results.groupBy(*by).agg(F.count("*").alias("calls"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("failed"), total("prompt_tokens"), total("completion_tokens"))


def recommend(scored: DataFrame) -> DataFrame:
    """The row of least loss (none: worst), then greatest chrF, among rows without flags; among all if every row has one."""
    by = W.orderBy(F.size("flags") > 0, F.col("val_loss").asc_nulls_last(), F.desc("chrf"), "step")
    return scored.withColumn("__k", F.row_number().over(by)).where("__k = 1").drop("__k")


def flags(p: str = "p", p0: float = 0.5, rate: str = "rate", rate0: float = 1.0, err: str = "err"):
    over = F.when((F.col(p) > p0 + 0.03) | (F.col(rate) < 0.6 * rate0), "overshoot")
    return F.array_compact(F.array(over, F.when(F.col(err) > 0.05, "number_drift")))


def binomial_tail(k, n):
    """P(X >= k) of n fair coins: terms follow from each other in logarithms, so a large n doesn't overflow."""
    first = F.struct((-F.log(F.lit(2.0)) * n).alias("log"), F.lit(0.0).alias("tail"))

    def step(a, i):
        tail = a["tail"] + F.when(i >= k, F.exp(a["log"])).otherwise(0.0)
        return F.struct((a["log"] + F.when(i < n, F.log((n - i) / (i + 1))).otherwise(0.0)).alias("log"), tail.alias("tail"))

    return F.aggregate(F.sequence(F.lit(0), n), first, step)["tail"]
