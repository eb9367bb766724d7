"""Rewriting of articles, detectors, providers, settings and reports on small cases worked out by hand."""

import json
import sys
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from quillspark.operators import articles, detector, rewriting
from quillspark.plans import reports
from quillspark.sources import providers

ARTICLE = "# 题\n\n第一段有[链接](u)和42个字。\n\n![图](x)\n\n第二段也是一些文字。"


def test_paragraph_check():
    check = rewriting.paragraph_check()
    assert check("一共有3个人来了", "一共有三个人来了") is None and check("在2022年春天", "在22年的春天") is None
    assert check("一共有42个人", "一共有43个人") == "number_changed" and check("文字" * 10, "文") == "length_ratio 0.05"
    assert check("", "") == "length_ratio 0.00" and check("14,000元整", "14000元整") is None


def test_guard_asks_again_and_then_keeps_the_input():
    answers = iter(["坏43", "坏44", "好42个"])
    call = rewriting.guarded(lambda text, before: next(answers), rewriting.paragraph_check())
    assert call("有42", "") == ("有42", 2, "number_changed")
    assert call("有42", "") == ("好42个", 1, None)


def test_rewritten(spark):
    docs = spark.createDataFrame([(1, ARTICLE), (2, None), (3, "会失败的一段")], "id long, text string")

    def provider(text, before):
        if "失败" in text:
            raise ValueError("no")
        return text.replace("第", "前" if before else "首")

    got = {r.id: r for r in rewriting.rewritten(docs, "id", provider, check=rewriting.paragraph_check()).collect()}
    assert got[1].markdown == "# 题\n\n首一段有[链接](u)和42个字。\n\n![图](x)\n\n前二段也是一些文字。\n"
    assert [(x.blocks, x.attempts, x.fallback) for x in got[1].log] == [([1], 1, None), ([3], 1, None)] and got[1].appended == 0
    assert got[2].markdown == "\n" and got[2].log == [] and got[3].markdown is None and got[3].error == "ValueError: no"
    log = rewriting.rewritten(docs.where("id = 1"), "id", lambda text, before: f"{before[:2]}>{text}", chained=True, unit="section").select(F.explode("log").alias("g")).select("g.*").collect()
    assert [x.output[:3] for x in log] == [">第一", ">第>"]


def test_aligned_and_page(spark):
    docs = spark.createDataFrame([("a", ARTICLE)], "article string, text string")
    blocks = articles.block_rows(docs, "article")
    logs = spark.createDataFrame([("a", "s1", "x", "<一>", [1]), ("a", "s1", "y", "二", [3]), ("a", "s2", "x", "[甲](javascript:x)", [1])], "article string, system string, input string, output string, blocks array<int>")
    rows = rewriting.aligned(blocks, logs)
    assert {(r.system, r.idx) for r in rows.where("uncovered").collect()} == {("s2", 3)}
    assert [(r.idx, r.systems) for r in rewriting.unequal_starts(logs).collect()] == [(3, 1)]
    assert rewriting.unequal_starts(logs.where("system = 's1'")).count() == 0
    with pytest.raises(ValueError):
        reports.side_by_side(rows, "t")
    page = reports.side_by_side(rows.where("system = 's1'"), "t", ["段"])
    assert "&lt;一&gt;" in page and "<mark>段</mark>" in page and '<a href="u">链接</a>' in page
    assert reports.shown_text("[甲](javascript:x)") == "甲"
    assert [tuple(r) for r in rewriting.link_counts(logs, "system").orderBy("system").collect()] == [("s1", 0, 0), ("s2", 0, 1)]


def test_detector(spark, tmp_path):
    own, other = "今天我们去河边散步看见一只白鹭", "总之这不仅是一种方法更是一种态度"
    rows = spark.createDataFrame([(i, own[i % 5 :] if i % 2 else other[i % 5 :], i % 2) for i in range(20)], "id long, text string, y int")
    made = detector.fit(rows, "id", "me", ("不仅",))
    p = {r.id: r.p for r in made.probabilities(rows.select("id", "text"), "id").collect()}
    assert min(v for k, v in p.items() if k % 2) > 0.8 and max(v for k, v in p.items() if not k % 2) < 0.2
    path = str(tmp_path / "d.json")
    made.save(path)
    again = detector.load(spark, path)
    assert again.lexicon == ("不仅",) and again.author == "me"
    assert all(abs(r.p - p[r.id]) < 1e-9 for r in again.probabilities(rows.select("id", "text"), "id").collect())
    blank = spark.createDataFrame([(1, None), (2, "zzz")], "id long, text string")
    assert len({round(r.p, 12) for r in made.probabilities(blank, "id").collect()}) == 1
    assert made.pruned(5).weights.count() == 5
    with pytest.raises(ValueError):
        detector.load(spark, path, "another/1")
    docs = spark.createDataFrame([("a", f"---\ntitle: x\n---\n{own}，{own}\n\n短"), ("b", f"# 题\n\n{other}，{other}")], "file string, text string")
    scored = detector.scored_articles(docs, "file", made)
    got = scored.collect()
    assert [r.file for r in got] == ["b", "a"] and got[0].band == 1 and got[0].worst[0].markers == ["不仅"] and got[1].paragraphs == 1
    table = reports.score_table(scored, "file")
    assert "| b |" in table and "(不仅)" in table


def test_providers(tmp_path):
    class Handler(BaseHTTPRequestHandler):
        calls = []

        def do_POST(self):
            self.calls.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            ok = len(self.calls) > 1
            self.send_response(200 if ok else 500)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": "好"}}]}).encode() if ok else b"busy")

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    card = providers.Card.of({"base_url": f"http://127.0.0.1:{server.server_port}/v1", "model": "m", "instruction": "改写", "sampling": {"top_p": 0.5}})
    assert providers.chat(card, wait=0)("文" * 10, "上") == "好" and len(Handler.calls) == 2
    body = Handler.calls[1]
    assert body["max_tokens"] == 80 and body["top_p"] == 0.5 and body["repetition_penalty"] == 1.05 and "上文" in body["messages"][0]["content"]
    Handler.calls.clear()
    with pytest.raises(RuntimeError, match="HTTP 500: busy"):
        providers.chat(card, attempts=1)("文")
    server.shutdown()
    assert card.request("x", temperature=0)["top_p"] == 1.0
    with pytest.raises(ValueError):
        providers.Card.of({"model": "m"})
    copy = "import sys; open(sys.argv[2], 'w').write(open(sys.argv[1]).read().upper())"
    assert providers.command([sys.executable, "-c", copy, "{prompt}", "{output}"])("ab", "c") == "C\n\nAB"
    with pytest.raises(RuntimeError, match="exit 3"):
        providers.command([sys.executable, "-c", "raise SystemExit(3)"], retries=0)("x")
    pool = providers.pooled({"a": (lambda row: row["text"] + "!", 1)})
    assert pool({"model": "a", "text": "x"}) == "x!"
    with pytest.raises(KeyError):
        pool({"model": "b"})


def test_settings(tmp_path):
    (tmp_path / "posts").mkdir()
    for name in ("b.md", "a.md"):
        (tmp_path / "posts" / name).write_text("x")
    (tmp_path / "c.yaml").write_text("split: {seed: 3}\nposts: ['posts/*.md', 'posts/a*']\n")
    s = providers.settings(str(tmp_path / "c.yaml"))
    assert s.get("split.seed") == 3 and s.get("split.none.more", 7) == 7
    assert [x.rsplit("/", 1)[1] for x in s.files(s.get("posts"))] == ["a.md", "b.md", "a.md"]


def test_tables_and_blind_page(spark):
    rows = spark.createDataFrame([("a|b", 0.12345, None)], "name string, p double, n int")
    assert reports.markdown_table(rows) == "| name | p | n |\n|---|---|---|\n| a\\|b | 0.123 |  |\n"
    pairs = spark.createDataFrame([(i, "原" * 80 + "</script>", "改" * 80) for i in range(5)], "id long, original string, rewrite string")
    page = reports.blind_page(articles.blind_items(pairs.withColumnRenamed("id", "unit"), "unit", 1, 2), "盲测")
    assert page.count("</script>") == 1 and "own_side" not in page and "s2-01" in page


def test_a_provider_is_called_once_however_rows_are_filtered(spark):
    calls = spark.sparkContext.accumulator(0)

    def counted(text, before):
        calls.add(1)
        return text

    docs = spark.createDataFrame([(i, f"a{i}\n\nb") for i in range(5)], "k long, text string")
    made = rewriting.rewritten(docs, "k", counted, letter="[a-z]").where("size(log) > 0 and markdown <> ''")
    assert len(made.select("k", "markdown", "log").collect()) == 5
    assert calls.value == 10
