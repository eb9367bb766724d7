"""Functions with state along a text, files in and out, and operators over them, on small cases worked out by hand."""

import json

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import udx
from quillspark.operators import articles
from quillspark.sources import files
from quillspark.streaming import results

ARTICLE = "# 标题\n正文一[链接](u)。\n> 引文\n\n```\n代码\n\n# 不是标题\n```\n- 条目一\n| 表 |\n\n\n只有 text 没有\n\nlatin only"


def test_blocks():
    found = udx.blocks(ARTICLE)
    assert [(b["text"], b["prose"], b["tight"]) for b in found] == [
        ("# 标题", False, False), ("正文一[链接](u)。", True, True), ("> 引文", False, True), ("```\n代码\n\n# 不是标题\n```", False, False),
        ("- 条目一", True, True), ("| 表 |", False, True), ("只有 text 没有", True, False), ("latin only", False, False),
    ]
    assert found[1]["plain"] == "正文一链接。" and found[1]["links"] == [{"anchor": "链接", "url": "u"}]
    assert udx.blocks(None) == udx.blocks(" \n") == []
    assert [b["text"] for b in udx.blocks("```\na\n\nb")] == ["```\na\n\nb"]


@given(st.lists(st.sampled_from(["文", "# 题", "", "> 引", "| 表", "```", "- 项"]), max_size=12))
def test_blocks_hold_every_line_and_join_back(lines):
    found = udx.blocks("\n".join(lines))
    again = udx.blocks(udx.joined([(b["text"], b["tight"]) for b in found]))
    if lines.count("```") % 2 == 0:
        assert [(b["text"], b["tight"]) for b in again] == [(b["text"], b["tight"]) for b in found]
    assert sum(x != "" for x in lines) == sum(x != "" for b in found for x in b["text"].split("\n"))


def test_split_and_merge():
    assert udx.split_long("甲。乙。丙。丁", 4) == ["甲。乙。", "丙。丁"]
    assert udx.split_long("没有句号的长句子", 3) == ["没有句号的长句子"]
    assert udx.merged(["短", "长" * 60, "尾"], 50, 800) == ["短\n\n" + "长" * 60 + "\n\n尾"]
    assert udx.merged(["短"]) == ["短"] and udx.merged([]) == udx.merged(None) == []


def test_windows():
    assert udx.windows([500, 500, 100], tail=300) == [(0, 3)]
    assert udx.windows([500, 500, 100]) == [(0, 2), (2, 3)]
    assert udx.windows([1] * 13) == [(0, 6), (6, 12), (12, 13)] and udx.windows([]) == []
    assert udx.groups(udx.blocks(ARTICLE)) == [[1], [4], [6]]
    assert udx.groups(udx.blocks("甲\n\n乙\n\n# 题\n\n丙"), "section") == [[0, 1], [3]]


def test_links():
    assert udx.restored("看链接吧", [("链接", "u")]) == ("看[链接](u)吧", 0)
    assert udx.restored("先按完成任务结算，再说", [("按完成任务结账", "u")]) == ("先[按完成任务结算](u)，再说", 0)
    assert udx.restored("无关文字", [("completely", "u"), ("x1", "v")]) == ("无关文字（[completely](u)；[x1](v)）", 2)
    assert udx.restored("甲乙甲乙", [("甲乙", "u"), ("甲乙", "v")]) == ("[甲乙](u)[甲乙](v)", 0)
    assert udx.restored("by Josephine Wolff here", [("Josephine Wolfe", "u")]) == ("by [Josephine Wolff](u) here", 0)
    assert udx.restored("", [("甲", "u")]) == ("（[甲](u)）", 1)


def test_rows(spark):
    docs = spark.createDataFrame([(1, ARTICLE), (2, None), (3, "")], "id long, text string")
    rows = articles.block_rows(docs, "id")
    assert rows.count() == 8
    back = articles.rejoined(rows.withColumn("output", F.col("text")), "id").first()
    assert back.markdown == udx.joined([(b["text"], b["tight"]) for b in udx.blocks(ARTICLE)])
    units = articles.merged_units(docs, "id", least=5).orderBy("idx").collect()
    assert units[0].prev == "" and all(b.prev == a.text for a, b in zip(units, units[1:]))
    assert {r.id for r in articles.section_units(docs, "id").collect()} == {1}
    fixed = spark.createDataFrame([("看链接", [("链接", "u")]), (None, None)], "t string, l array<struct<anchor string, url string>>")
    assert [r.x for r in fixed.select(udx.restored_udf()("t", "l").alias("x")).collect()] == [("看[链接](u)", 0), ("", 0)]


def test_enriched_and_blind(spark):
    def provider(row):
        if row["id"] == 2:
            raise ValueError("no")
        return row["text"].upper()

    got = articles.enriched(spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string"), provider, attempts=2, wait=0.0).orderBy("id").collect()
    assert [(r.output, r.error) for r in got] == [("A", None), (None, "ValueError: no")]
    pairs = spark.range(40).select("id", F.repeat(F.lit("文"), 80).alias("original"), F.when(F.col("id") > 3, "写").alias("rewrite"))
    items = articles.blind_items(pairs, "id", 5, 8).collect()
    assert len(items) == len({r.id for r in items}) == 18 and min(r["id"] for r in items) == "s1-00"
    assert all((r.left if r.own_side == "left" else r.right) == "文" * 80 for r in items if r.kind == "pair")


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "文", None), (2, "b", "bad")], "id long, text string, error string")
    files.append_jsonl(rows, f"{tmp_path}/log")
    files.append_jsonl(rows, f"{tmp_path}/log")
    assert files.jsonl(spark, f"{tmp_path}/log", "id long, text string, error string").count() == 4
    assert [r.id for r in files.done_keys(files.jsonl(spark, f"{tmp_path}/log", "id long, error string"), "id").collect()] == [1]
    (tmp_path / "eval").mkdir()
    for name in ("run_10", "run_20", "other_5"):
        (tmp_path / "eval" / f"{name}.jsonl").write_text('{"unit_id": "a"}\n\n')
    out = files.checkpoint_outputs(spark, f"{tmp_path}/eval/*.jsonl", "run", "unit_id string")
    assert sorted((r.system, r.step) for r in out.collect()) == [("run_10", 10), ("run_20", 20)]
    (tmp_path / "a.sys.v2.blocks.jsonl").write_text('{"input": "x", "output": "y", "blocks": [0, 1]}\n')
    assert [tuple(r) for r in files.block_logs(spark, f"{tmp_path}/*.blocks.jsonl").collect()] == [("a", "sys.v2", "x", "y", [0, 1])]
    (tmp_path / "train.jsonl").write_text('{"step": 1, "loss": 2}\n{"step": 2, "eval_loss": 0.5}\n')
    assert [tuple(r) for r in files.loss_curve(spark, f"{tmp_path}/train.jsonl").collect()] == [(2, 0.0, 0.5)]
    (tmp_path / "answers.json").write_text(json.dumps({"s1": {"answers": {"s1-00": True}}, "s2": {"s2-00": "left"}, "x": {}}))
    assert {r.id: r.answers for r in files.answers(spark, f"{tmp_path}/answers.json").collect()} == {"s1": {"s1-00": "true"}, "s2": {"s2-00": "left"}}
    (tmp_path / "post.md").write_text("文\n")
    assert [(r.slug, r.raw) for r in files.posts(spark, [f"{tmp_path}/*.md"] * 2).collect()] == [("post", "文\n")] * 2


def test_stream_keeps_a_row_a_key(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = '{"id": %d, "at": "2024-01-01T00:00:00", "error": %s}\n'
    (tmp_path / "in" / "a.json").write_text(line % (1, "null") + line % (1, "null") + line % (2, '"bad"'))
    rows = results.arriving(spark, f"{tmp_path}/in", "id long, at timestamp, error string", ["id"])
    for _ in range(2):
        results.appended(rows, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert [r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [1]
