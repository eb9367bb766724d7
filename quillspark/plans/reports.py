"""Reports for people: tables in markdown, a page that shows articles side by side, a page of a blind test."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, Row

PAGE = '<!doctype html><html><head><meta charset="utf-8"><title>{title}</title><style>table{{border-collapse:collapse;width:100%}}td,th{{border:1px solid #ccc;padding:.5em;vertical-align:top}}mark{{background:#fd8}}</style></head><body>{body}</body></html>'
BLIND = "<h1>{title}</h1><form id=f></form><button id=b>JSON</button><pre id=o></pre><script>const D={data};const f=document.getElementById('f');const put=(x,cs)=>{{const d=document.createElement('fieldset');for(const t of x){{const p=document.createElement('p');p.textContent=t;d.append(p)}}for(const [k,n,v] of cs){{const l=document.createElement('label'),i=document.createElement('input');i.type='radio';i.name=n;i.dataset.k=k;i.value=v;l.append(i,v+' ');d.append(l)}}f.append(d)}};for(const x of D.s1)put([x.text],['true','false'].map(v=>['s1',x.id,v]));for(const x of D.s2)put([x.left,x.right],['left','right','tie'].map(v=>['s2',x.id,v]));document.getElementById('b').onclick=()=>{{const r={{s1:{{}},s2:{{}}}};for(const i of f.querySelectorAll('input:checked'))r[i.dataset.k][i.name]=i.dataset.k==='s1'?i.value==='true':i.value;document.getElementById('o').textContent=JSON.stringify(r)}}</script>"


def cell(x) -> str:
    if isinstance(x, (list, tuple)):
        return ", ".join(map(cell, x))
    return "" if x is None else f"{x:.3f}" if isinstance(x, float) else re.sub(r"\s+", " ", str(x)).replace("|", r"\|")


def markdown_table(rows: Iterable[Row] | DataFrame, columns: list[str] | None = None) -> str:
    """A table of few rows: numbers to three places, nulls blank, bars escaped."""
    names = columns or (rows.columns if isinstance(rows, DataFrame) else None)
    held = rows.toLocalIterator() if isinstance(rows, DataFrame) else rows
    lines = []
    for r in held:
        names = names or list(r.asDict())
        lines.append("| " + " | ".join(cell(r[c]) for c in names) + " |")
    return "\n".join(["| " + " | ".join(names or []) + " |", "|" + "---|" * len(names or []), *lines]) + "\n"


def score_table(scored: DataFrame, key: str, shown: int = 80, markers: int = 6) -> str:
    """Articles of detector.summary(), then the least likely paragraphs of each, cut to `shown` characters and `markers` markers."""
    rows = scored.collect()  # a row an article of the report
    parts = [markdown_table(rows, [key, "p_author", "band", "marker_rate", "paragraphs", "chars"])]
    for r in rows:
        items = [f"- {w['p']:.3f} {cell(w['text'])[:shown]}" + (f" ({', '.join(w['markers'][:markers])})" if w["markers"] else "") for w in r["worst"]]
        parts.append("\n".join([f"{cell(r[key])}:", *items]) + "\n")
    return "\n".join(parts)


def check_table(rows: DataFrame) -> str:
    """Slices of metrics.separation(), `all` first: counts, AUC, means and shares."""
    held = sorted(rows.collect(), key=lambda r: (r["slice"] != "all", r["slice"]))  # a row a slice
    return markdown_table(held, ["slice", "n_pos", "n_neg", "auc", "mean_pos", "mean_neg", "pos_above", "neg_below"]) if held else ""


def metrics_table(scores: DataFrame, article_scores: DataFrame | None = None) -> str:
    """Systems of metrics.flagged(), inputs first and originals last, then whole articles."""
    held = sorted(scores.collect(), key=lambda r: ({"ai_input": 0, "original": 2}.get(r.system, 1), r.system))  # a row a system
    parts = [markdown_table(held, ["system", "chrf", "p_human", "above_half", "marker_rate", "number_err", "len_ratio", "flags"])]
    if article_scores is not None:
        parts.append(markdown_table(article_scores.orderBy("system"), ["system", "p_human", "marker_rate", "paragraphs"]))
    return "\n".join(parts)


def shown_text(text: str | None, lexicon: list[str] = (), most: int = 120) -> str:
    """Escaped text with markers highlighted, the longer first, and links as anchors; only targets over http(s) or local ones are linked."""
    first = sorted(lexicon[:most], key=len, reverse=True)
    marker = re.compile("|".join(map(re.escape, first))) if first else None
    light = lambda x: html.escape(x) if not marker else "".join(f"<mark>{html.escape(p)}</mark>" if marker.fullmatch(p) else html.escape(p) for p in re.split(f"({marker.pattern})", x))
    out, last, text = [], 0, text or ""
    for m in re.finditer(r"(?<!!)\[([^\]]+)\]\(([^)]+)\)", text):
        safe = re.match(r"(?:https?://|[^:]*$)", m[2], re.I)
        out += [light(text[last : m.start()]), f'<a href="{html.escape(m[2])}">{light(m[1])}</a>' if safe else light(m[1])]
        last = m.end()
    return "".join(out) + light(text[last:])


def side_by_side(aligned: DataFrame, title: str, lexicon: list[str] = (), stats: DataFrame | None = None) -> str:
    """A page of one article's rewriting.aligned(): each block beside every system's output, under metrics.compare_stats() if given. Prose that a log leaves out is an error."""
    rows = aligned.orderBy("idx", "system").collect()  # one article
    if lost := sorted({(r.system, r.idx) for r in rows if r.uncovered}):
        raise ValueError(f"logs leave out prose blocks: {lost[:5]}")
    systems = sorted({r.system for r in rows})
    table: dict[int, dict] = {}
    for r in rows:
        line = table.setdefault(r.idx, {"": r.text})
        line[r.system] = r.output if r.first else None if r.prose else r.text
    head = "".join(f"<th>{html.escape(x)}</th>" for x in ("", *systems))
    body = "".join("<tr>" + "".join(f"<td>{shown_text(line.get(s), lexicon)}</td>" for s in ("", *systems)) + "</tr>" for _, line in sorted(table.items()))
    told = "".join(f"<p>{html.escape(r.system)}: P {r.p_in:.3f} → {r.p_out:.3f}, {r.m_in:.2f} → {r.m_out:.2f}</p>" for r in (stats.orderBy("system").collect() if stats is not None else []))
    return PAGE.format(title=html.escape(title), body=f"<h1>{html.escape(title)}</h1>{told}<table><tr>{head}</tr>{body}</table>")


def blind_page(items: DataFrame, title: str) -> str:
    """A page of articles.blind_items() that gives the answers as JSON. What is right isn't in it; no text can end its script."""
    rows = items.orderBy("id").collect()  # as many as a person judges
    data = {"s1": [{"id": r.id, "text": r.text} for r in rows if r.kind != "pair"], "s2": [{"id": r.id, "left": r.left, "right": r.right} for r in rows if r.kind == "pair"]}
    safe = json.dumps(data, ensure_ascii=False).replace("</", "<\\/").replace("<!--", "<\\!--")
    return PAGE.format(title=html.escape(title), body=BLIND.format(title=html.escape(title), data=safe))
