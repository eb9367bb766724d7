"""The stages of a run as plans: each reads what the one before has written in the run's folder, and writes its own.

Settings are those of `sources.providers.settings`; paths in them are relative to its folder, the run's folder is `workdir`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import prompts, udx
from quillspark.functions import text as T
from quillspark.functions.profiles import HAN, Profile
from quillspark.operators import articles, builders, corpus, detector, features, metrics
from quillspark.plans import reports
from quillspark.sources import files, providers

UNIT = "unit_id string, slug string, date string, index int, text string, prev string, split string"
RESULT = "unit_id string, prompt_id string, rewrite string, outline string, finish_reason string, source string, error string, usage map<string,bigint>, line_no long"
INPUT = "unit_id string, prompt_id string, ai_text string, prev string, original string"


class Run:
    """Tables and files of a run by name."""

    def __init__(self, spark: SparkSession, config: providers.Settings, profile: Profile = HAN):
        self.spark, self.config, self.profile = spark, config, profile
        self.folder = config.get("workdir") if "://" in str(config.get("workdir", "")) else str((config.folder / config.get("workdir", "work")).resolve())

    def at(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def paths(self, patterns: list[str]) -> list[str]:
        return [p if "://" in p else str(self.config.folder / p) for p in patterns]

    def rows(self, name: str, schema: str) -> DataFrame:
        return files.jsonl(self.spark, self.at(name), schema)

    @property
    def builder(self) -> builders.Builder:
        return builders.builder(self.config.get("builder.name", "paragraph_rewrite"), bool(self.config.get("builder.allow_experimental", False)))

    @property
    def instruction(self) -> str:
        return prompts.instruction(self.config.get("author.name", prompts.AUTHOR), self.config.get("author.instruction", prompts.INSTRUCTION))

    # what is fitted once and used by several stages

    def material(self) -> DataFrame:
        return builders.train_material(self.rows("units.jsonl", UNIT), self.rows("rewrites.jsonl", RESULT), self.profile)

    def detector(self) -> detector.Detector:
        """The run's detector, fitted on its training units once and kept beside its tables."""
        path = self.at("detector.json")
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            rows = self.material().withColumn("id", F.monotonically_increasing_id())
            words = features.lexicon(rows, least=int(self.config.get("lexicon.min_count", 20)))
            detector.fit(rows, "id", self.config.get("author.name", prompts.AUTHOR), tuple(words)).pruned(int(self.config.get("detector.features", 10_000))).save(path)
        return detector.load(self.spark, path)


def units(run: Run) -> DataFrame:
    """Posts to units: heads, exclusions, splits (or those of an earlier round), units by paragraph or section, and reports."""
    get, spark = run.config.get, run.spark
    raw = files.posts(spark, run.paths(get("corpus.paths", [])))
    head = raw.select("path", "slug", T.header(F.col("raw")).alias("h"))
    meta = F.col("h.meta")
    posts = head.select(
        F.coalesce(meta["Slug"], "slug").alias("slug"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"), meta["Title"].alias("title"), T.date_of(meta["Date"]).alias("date"),
        F.split(F.coalesce(meta["Tags"], F.lit("")), ",").alias("tags"), meta["Status"].alias("status"), F.col("h.body").alias("body"),
    )
    rules = corpus.post_rules(
        get("corpus.exclude_slugs", []), get("corpus.exclude_suffixes", []), get("corpus.exclude_tags", []), get("corpus.exclude_status", []), get("corpus.date_from"), get("corpus.date_to"), get("corpus.min_cjk_ratio", 0.15),
    )
    judged = posts.withColumn("reason", corpus.exclusion_reason(rules))
    kept = judged.where("reason is null")
    dealt = corpus.splits(kept.withColumn("year", F.year("date")), "slug", "year", get("corpus.split.test_posts", 20), get("corpus.split.val_posts", 10), get("corpus.split.seed", 0), get("corpus.split.min_test_per_bucket"))
    if get("corpus.split.from_file"):
        dealt = corpus.with_split(dealt, files.split_overrides(spark, str(run.config.folder / get("corpus.split.from_file"))))
    sections = run.builder.stages[0] == "extract"
    if sections:
        cut = articles.section_units(kept, "slug", "body", get("builder.sections.target_chars", 900), get("builder.sections.max_paras", 6), get("builder.sections.min_tail", 300), run.profile)
    else:
        cut = articles.merged_units(kept, "slug", "body", get("corpus.units.min_chars", 50), get("corpus.units.max_chars", 800), run.profile)
    named = F.concat("slug", F.lit("#s" if sections else "#"), F.lpad(F.col("idx").cast("string"), 2 if sections else 3, "0"))
    facts = dealt.select("slug", F.coalesce(F.col("date").cast("string"), F.lit("")).alias("date"), "title", "split")
    out = cut.join(facts, "slug").select(named.alias("unit_id"), "slug", "date", F.col("idx").alias("index"), "text", "prev", "split")
    files.write_jsonl(out, run.at("units.jsonl"))
    held = run.rows("units.jsonl", UNIT)
    sizes = held.groupBy("slug").agg(F.count("*").alias("units"), F.sum(F.length("text")).alias("chars"))
    files.write_csv(facts.join(sizes, "slug", "left").select("slug", "date", "split", "title", F.coalesce("units", F.lit(0)).alias("units"), F.coalesce("chars", F.lit(0)).alias("chars")), run.at("posts.csv"))
    files.report(spark, run.at("corpus_report.json"), {"files": raw.count(), "posts": kept.count(), "excluded": corpus.exclusion_counts(judged), "splits": corpus.corpus_report(held)})
    return held


def generate(run: Run, provider: Callable[[dict], str], models: list[tuple[str, list[str]]], pilot: int | None = None, split: list[str] = ("train", "val", "test"), concurrency: int = 4) -> DataFrame:
    """What is still to be asked of the models, asked, and appended to the log; jobs that fail stay open for the next run."""
    held = builders.pilot(run.rows("units.jsonl", UNIT), list(split), pilot)
    log = run.rows("rewrites.jsonl", RESULT) if exists(run, "rewrites.jsonl") else run.spark.createDataFrame([], RESULT)
    todo = builders.jobs(held, models, files.done_keys(log, *builders.KEY)).join(held.select("unit_id", "text", "prev"), "unit_id")
    pool = files.exemplars(files.posts(run.spark, run.paths(run.config.get("builder.style_exemplars.paths"))).withColumn("name", F.regexp_extract("path", "([^/]+)$", 1)), run.config.get("builder.style_exemplars.exclude", [])) if run.config.get("builder.style_exemplars.paths") else run.spark.createDataFrame([], "text string")
    base = todo.withColumn("base", T.base_prompt(F.col("prompt_id")))
    asked = prompts.exemplified(base, pool, "base", "style_mimic").withColumn("request", prompts.paraphrase(F.col("base"), F.col("text"), F.col("prev"), F.col("exemplars"))).drop("exemplars")
    made = articles.enriched(asked.repartition("model"), provider, concurrency)
    last = log.agg(F.coalesce(F.max("line_no"), F.lit(-1))).head()[0]
    rows = made.select("unit_id", "prompt_id", F.col("output").alias("rewrite"), F.col("model").alias("source"), "error", (F.lit(last) + 1 + F.monotonically_increasing_id()).alias("line_no"))
    files.append_jsonl(rows, run.at("rewrites.jsonl"))
    return run.rows("rewrites.jsonl", RESULT)


def exists(run: Run, name: str) -> bool:
    path = run.spark._jvm.org.apache.hadoop.fs.Path(run.at(name))
    return path.getFileSystem(run.spark._jsc.hadoopConfiguration()).exists(path)


def build(run: Run) -> DataFrame:
    """Judged rewrites to examples, evaluation inputs and a report."""
    held, rule = run.rows("units.jsonl", UNIT), run.builder
    rows = builders.judged(held, run.rows("rewrites.jsonl", RESULT).where("coalesce(error, '') = ''"), rule)
    made = builders.training(rows, held, rule, run.instruction, run.config.get("corpus.split.seed", 0))
    for split in ("train", "val"):
        files.write_jsonl(made.where(F.col("split") == split).orderBy("order").select("unit_id", "messages"), run.at(f"sft_{split}.jsonl"))
    files.write_jsonl(builders.evaluation(rows, rule).orderBy("unit_id"), run.at("eval_inputs.jsonl"))
    files.report(run.spark, run.at("build_report.json"), {"reasons": builders.reasons(rows, rule).orderBy("reason"), "kept": builders.kept_share(rows)})
    return run.rows("eval_inputs.jsonl", INPUT)


def scored(run: Run, rows: DataFrame, model: detector.Detector, text: str = "output") -> DataFrame:
    """rows with `p`, the detector's probability of one of their texts."""
    keyed = rows.withColumn("__text", F.xxhash64(text))
    distinct = keyed.select(F.col("__text").alias("id"), F.col(text).alias("text")).dropDuplicates(["id"])
    return keyed.join(model.probabilities(distinct, "id").withColumnRenamed("id", "__text"), "__text").drop("__text")


def evaluate(run: Run) -> DataFrame:
    """Every system's outputs over the held-out paragraphs, beside the inputs and the originals, with flags; and whole articles."""
    held, model = run.rows("eval_inputs.jsonl", INPUT).withColumn("input", F.col("ai_text")), run.detector()
    made = files.system_outputs(run.spark, run.at("eval/*.jsonl"), "unit_id string, output string").withColumn("line_no", F.monotonically_increasing_id())
    rows = metrics.aligned_outputs(held, made).select("system", "unit_id", "input", "output", "original")
    for name, column in (("ai_input", "ai_text"), ("original", "original")):
        rows = rows.unionByName(held.select(F.lit(name).alias("system"), "unit_id", "input", F.col(column).alias("output"), "original"))
    scores = metrics.flagged(metrics.system_scores(scored(run, rows, model), list(model.lexicon), run.profile))
    whole = None
    if exists(run, "eval/articles"):
        logs = files.block_logs(run.spark, run.at("eval/articles/*.blocks.jsonl"))
        logs = scored(run, scored(run, logs, model, "input").withColumnRenamed("p", "p_in"), model).withColumnRenamed("p", "p_out")
        whole = metrics.article_means(logs, list(model.lexicon))
    files.report(run.spark, run.at("metrics.json"), {"paragraphs": scores, "articles": whole})
    detector.write_text(run.spark, run.at("metrics.md"), reports.metrics_table(scores, whole))
    return scores


def select(run: Run, name: str) -> DataFrame:
    """The checkpoint of a training run to take: least loss among those without flags, and what is to be said of it."""
    curve, model = files.loss_curve(run.spark, run.at(f"runs/{name}/log.jsonl")), run.detector()
    held = run.rows("eval_inputs.jsonl", INPUT).withColumn("input", F.col("ai_text"))
    made = files.checkpoint_outputs(run.spark, run.at("eval/*.jsonl"), name, "unit_id string, output string").withColumn("system", F.col("step").cast("string")).withColumn("line_no", F.monotonically_increasing_id())
    rows = metrics.aligned_outputs(held, made).select("system", "unit_id", "input", "output", "original")
    rows = rows.unionByName(held.select(F.lit("original").alias("system"), "unit_id", "input", F.col("original").alias("output"), "original"))
    scores = metrics.flagged(metrics.system_scores(scored(run, rows, model), list(model.lexicon), run.profile))
    steps = metrics.with_losses(scores.where("system <> 'original'").withColumn("step", F.col("system").cast("long")), curve)
    files.report(run.spark, run.at(f"runs/{name}/selection.json"), {"candidates": steps.orderBy("step"), "notes": metrics.selection_notes(curve, steps), "score_first": metrics.lowest(curve), "recommended": metrics.recommend(steps)})
    return metrics.recommend(steps)


def check(run: Run) -> DataFrame:
    """How well the detector tells held-out units from their rewrites: in all, per source, per length."""
    rows = builders.held_out(run.rows("units.jsonl", UNIT), run.rows("rewrites.jsonl", RESULT), run.profile)
    found = metrics.separation(scored(run, rows, run.detector(), "text"), "slice")
    files.report(run.spark, run.at("classifier_check.json"), {"slices": found})
    return found


def blind(run: Run, model: str, baseline: str, n_single: int = 20, n_pairs: int = 20, seed: int = 7) -> DataFrame:
    """Items of a blind test of a model's outputs that a baseline has too, and their page."""
    held = run.rows("eval_inputs.jsonl", INPUT).select("unit_id", "original")
    outs = [run.rows(f"eval/{s}.jsonl", "unit_id string, output string").where("output <> ''").select("unit_id", F.col("output").alias(c)) for s, c in ((model, "rewrite"), (baseline, "baseline"))]
    items = articles.blind_items(held.join(outs[0], "unit_id").join(outs[1], "unit_id"), "unit_id", n_single, n_pairs, seed)
    files.write_jsonl(items, run.at("blind/items.jsonl"))
    detector.write_text(run.spark, run.at(f"blind/{udx.slug(model)}.html"), reports.blind_page(items, model))
    return items


def blind_result(run: Run, answers: str) -> DataFrame:
    """The score of a blind test from the answers its page gave."""
    items = run.rows("blind/items.jsonl", "id string, kind string, unit_id string, text string, left string, right string, own_side string")
    given = files.answers(run.spark, answers).select(F.explode("answers").alias("id", "answer"))
    found = metrics.blind_score(items, given)
    files.report(run.spark, run.at("blind/score.json"), {"score": found})
    return found
