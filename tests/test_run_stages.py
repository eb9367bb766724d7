"""A whole run over a small Han corpus: units, generation, building, evaluation, selection, check, blind test."""

import json
import random

import pytest

from quillspark.plans import reports, stages
from quillspark.sources import files, providers


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("run")
    rnd = random.Random(3)
    own, other = "的一是不了有和人这中大为上个国我以要他时", "来用们生到作地于出就分对成会可主发年动同"
    (folder / "posts").mkdir()
    for i in range(24):
        paragraphs = ["".join(rnd.choices(own, k=rnd.randrange(70, 130))) + "。" for _ in range(3)]
        (folder / f"posts/p{i:02d}.md").write_text(f"Title: t{i}\nDate: 20{10 + i % 4}-01-02\nTags: x\n\n# h\n\n" + "\n\n".join(paragraphs) + "\n", encoding="utf-8")
    (folder / "posts/en.md").write_text("Title: e\nDate: 2012-01-01\n\nEnglish only, all of it.\n", encoding="utf-8")
    config = providers.Settings(
        {"workdir": "work", "author": {"name": "甲"}, "corpus": {"paths": ["posts/*.md"], "date_from": "2010-01-01", "split": {"test_posts": 8, "val_posts": 6}}, "lexicon": {"min_count": 5}}, folder
    )
    made = stages.Run(spark, config)
    made.voice = (own, other)
    return made


def test_run(run, tmp_path):
    held = stages.units(run)
    assert held.count() == 72 and {r.split for r in held.select("split").distinct().collect()} == {"train", "val", "test"}
    report = json.loads(open(run.at("corpus_report.json")).read())
    assert report["files"] == 25 and report["excluded"] == [{"reason": "not_chinese", "n": 1}]
    table = str.maketrans(*run.voice)

    def provider(row):
        if row["unit_id"] == "p00#000" and row["prompt_id"] == "formal":
            raise RuntimeError("refused")
        return row["text"].translate(table)

    log = stages.generate(run, provider, [("a", ["default", "formal"]), ("b", ["condense"])], concurrency=2)
    assert log.count() == 3 * 72 and log.where("error is not null").count() == 1
    # the failed job alone is asked again
    assert stages.generate(run, lambda row: row["text"].translate(table), [("a", ["default", "formal"]), ("b", ["condense"])]).count() == 3 * 72 + 1
    inputs = stages.build(run)
    assert inputs.count() == held.where("split = 'test'").count() and {r.prompt_id for r in inputs.collect()} == {"default"}
    first = inputs.select("unit_id", "original", "ai_text")
    files.write_jsonl(first.selectExpr("unit_id", "original AS output"), run.at("eval/run_10.jsonl"))
    files.write_jsonl(first.selectExpr("unit_id", "concat(ai_text, ' 77') AS output"), run.at("eval/run_20.jsonl"))
    scores = {r.system: r for r in stages.evaluate(run).collect()}
    assert scores["original"].p_human > 0.8 > 0.2 > scores["ai_input"].p_human and scores["original"].chrf == 100
    assert scores["run_20"].flags == ["number_drift"] and scores["run_10"].flags == []
    assert scores["ai_input"].marker_rate > 0 == scores["original"].marker_rate
    (tmp_path / "x").mkdir()
    run.spark.createDataFrame([(10, 0.5, 1.3), (20, 1.0, 1.2)], "step long, epoch double, eval_loss double").write.json(run.at("runs/run/log.jsonl"))
    assert stages.select(run, "run").head().step == 10
    slices = {r["slice"]: r for r in stages.check(run).collect()}
    assert set(slices) == {"all", "source=first", "source=b", "len=80-200", "len=0-80"} - ({"len=0-80"} - set(slices)) and slices["all"].auc > 0.95
    assert "all" in reports.check_table(stages.check(run))
    items = stages.blind(run, "run_10", "run_20", 5, 4)
    said = {"s1": {r.id: r.kind == "own" for r in items.collect() if r.kind != "pair"}, "s2": {"answers": {r.id: r.own_side for r in items.collect() if r.kind == "pair"}}}
    (tmp_path / "answers.json").write_text(json.dumps(said))
    found = stages.blind_result(run, str(tmp_path / "answers.json")).head()
    assert (found.s1_originals_taken, found.s1_rewrites_taken, found.s2_decided, found.s2_wins) == (5, 0, 4, 0)
    with pytest.raises(ValueError):
        stages.blind(run, "run_10", "run_20", 500, 4)


def test_a_system_that_lacks_ids_is_an_error(run):
    files.write_jsonl(run.rows("eval_inputs.jsonl", stages.INPUT).limit(2).selectExpr("unit_id", "original AS output"), run.at("eval/short.jsonl"))
    with pytest.raises(ValueError, match="short lacks"):
        stages.evaluate(run)
