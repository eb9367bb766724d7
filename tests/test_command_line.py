"""The command line from fitting to scoring, and comparing from logs."""

import json

from quillspark import __main__ as cli


def test_fit_score_compare_card(spark, tmp_path, capsys):
    own, other = "今天我们去河边散步看见一只白鹭", "总之这不仅是一种方法更是一种态度"
    rows = [{"text": (own if i % 2 else other)[i % 5 :], "y": i % 2} for i in range(20)]
    (tmp_path / "rows.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    (tmp_path / "a.md").write_text(f"{own}，{own}\n")
    cli.main(["fit", "--rows", str(tmp_path / "rows.jsonl"), "--author", "me", "--out", str(tmp_path / "d.json")])
    cli.main(["score", str(tmp_path / "a.md"), "--detector", str(tmp_path / "d.json"), "--json"])
    found = json.loads(capsys.readouterr().out)
    assert found["path"].endswith("a.md") and found["paragraphs"] == 1 and found["p_author"] > 0.5
    (tmp_path / "a.s1.blocks.jsonl").write_text(json.dumps({"input": own, "output": "改写", "blocks": [0]}, ensure_ascii=False) + "\n")
    cli.main(["compare", "--post", str(tmp_path / "a.md"), "--logs", str(tmp_path / "*.blocks.jsonl"), "--out", str(tmp_path / "c.html")])
    assert "<td>改写</td>" in (tmp_path / "c.html").read_text()
    (tmp_path / "card.yaml").write_text("base_url: http://h/v1\nmodel: m\ninstruction: 改写\n")
    cli.main(["card", str(tmp_path / "card.yaml")])
    assert "model: m" in capsys.readouterr().out
