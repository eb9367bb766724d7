"""The command line: score, compare, rewrite, check, fit, card. `python -m quillspark VERB --help` tells what each takes."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import articles, detector, rewriting
from quillspark.plans import reports, stages
from quillspark.sources import files, providers


def session() -> SparkSession:
    return SparkSession.builder.appName("quillspark").getOrCreate()


def posts(spark: SparkSession, patterns: list[str]) -> DataFrame:
    return files.posts(spark, patterns).select("path", F.col("slug").alias("article"), F.col("raw").alias("text"))


def card_of(path: str) -> providers.Card:
    return providers.Card.of(providers.settings(path).values)


def score(a: argparse.Namespace) -> None:
    spark = session()
    found = detector.load(spark, a.detector, a.format)
    rows = detector.scored_articles(posts(spark, a.posts), "path", found, letter=a.letter)
    if a.json:
        for line in rows.toJSON().toLocalIterator():
            print(line)
    else:
        print(reports.score_table(rows, "path"))


def rewrite(a: argparse.Namespace) -> None:
    """One Markdown file and one log beside it for each article, in the folder named."""
    spark = session()
    check = None if a.unguarded else rewriting.paragraph_check()
    call = providers.chat(card_of(a.card), a.key_variable, temperature=a.temperature)
    made = rewriting.rewritten(posts(spark, a.posts), "article", call, unit=a.unit, chained=a.chained, check=check, concurrency=a.concurrency, letter=a.letter)
    failed = 0
    for r in made.toLocalIterator():
        if r.error:
            failed += 1
            print(f"{r.article}: {r.error}", file=sys.stderr)
            continue
        detector.write_text(spark, f"{a.out}/{r.article}.{a.system}.md", r.markdown)
        lines = [json.dumps({"input": x.input, "output": x.output, "blocks": x.blocks}, ensure_ascii=False) for x in r.log]
        detector.write_text(spark, f"{a.out}/{r.article}.{a.system}.blocks.jsonl", "".join(f"{x}\n" for x in lines))
    if failed:
        sys.exit(f"{failed} articles failed")


def compare(a: argparse.Namespace) -> None:
    spark = session()
    logs = files.block_logs(spark, a.logs)
    docs = posts(spark, [a.post])
    name = docs.first().article
    own = logs.where(F.col("article") == name)
    if unequal := rewriting.unequal_starts(own).head():
        sys.exit(f"the logs of {name} group its blocks differently, first at block {unequal.idx}")
    blocks = articles.block_rows(docs, "article", letter=a.letter)
    detector.write_text(spark, a.out, reports.side_by_side(rewriting.aligned(blocks, own), name))


def fit(a: argparse.Namespace) -> None:
    """From lines of JSON (text, y): y 1 is the author's."""
    spark = session()
    rows = files.jsonl(spark, a.rows, "text string, y int").where("y is not null")
    # rows that repeat count each time; a file's rows keep these ids when a lost task reads them again
    rows = rows.select(F.monotonically_increasing_id().alias("id"), "text", "y")
    made = detector.fit(rows, "id", a.author)
    (made.pruned(a.most) if a.most else made).save(a.out, a.format)


def check(a: argparse.Namespace) -> None:
    """How well a run's detector tells its held-out units from their rewrites."""
    run = stages.Run(session(), providers.settings(a.config))
    print(reports.check_table(stages.check(run)))


def card(a: argparse.Namespace) -> None:
    print(card_of(a.card).to_yaml(), end="")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillspark")
    verbs = top.add_subparsers(required=True)

    def verb(run, *, letter: bool = False, form: bool = False) -> argparse.ArgumentParser:
        p = verbs.add_parser(run.__name__, help=run.__doc__)
        p.set_defaults(run=run)
        if letter:
            p.add_argument("--letter", default="[一-鿿]", help="what a block must hold to be prose")
        if form:
            p.add_argument("--format", default=detector.FORMAT, help="the format that a detector's file names")
        return p

    p = verb(score, letter=True, form=True)
    p.add_argument("posts", nargs="+")
    p.add_argument("--detector", required=True)
    p.add_argument("--json", action="store_true")
    p = verb(rewrite, letter=True)
    p.add_argument("posts", nargs="+")
    for name in ("--card", "--out"):
        p.add_argument(name, required=True)
    p.add_argument("--system", default="rewrite")
    p.add_argument("--unit", choices=("paragraph", "section"), default="paragraph")
    p.add_argument("--key-variable")
    p.add_argument("--temperature", type=float)
    p.add_argument("--concurrency", type=int, default=4)
    for name in ("--chained", "--unguarded"):
        p.add_argument(name, action="store_true")
    p = verb(compare, letter=True)
    for name in ("--post", "--logs", "--out"):
        p.add_argument(name, required=True)
    p = verb(fit, form=True)
    for name in ("--rows", "--author", "--out"):
        p.add_argument(name, required=True)
    p.add_argument("--most", type=int, help="grams to keep")
    verb(check).add_argument("config")
    verb(card).add_argument("card")
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(a)


if __name__ == "__main__":
    main()
