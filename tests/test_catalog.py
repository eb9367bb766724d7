"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions import udx
from quillspark.plans import catalog, dataset  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "labels", "conversations", "benchmark", "pages", "events", "embeddings"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def paragraphs(x):
    """Paragraphs of a cleaned body that hold a Latin letter."""
    for pattern, to in ((r"(?s)```.*?```", "\n\n"), (r"(?is)<(script|style|iframe|video|audio)\b.*?</\1>", "\n\n"), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"<[^>]+>", "")):
        x = re.sub(pattern, to, x)
    x = "\n".join("" if re.match(r"\s*(#{1,6}\s|\|.*\|\s*$|>|([-*_]\s*){3,}$)", y) else y.rstrip() for y in x.split("\n"))
    return [y.strip() for y in x.split("\n") if re.search("[A-Za-zÀ-ÿ]", y)]


def plain(x):
    return round(float(x), 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(columns).collect()), key=str)
    found = duck.execute(catalog.oracle_sql()[name])
    place = {d[0]: i for i, d in enumerate(found.description)}
    assert sorted(place) == columns
    want = sorted((tuple(plain(r[place[c]]) for c in columns) for r in found.fetchall()), key=str)
    assert len(got) == len(want) and len(want) > 0
    assert got == want


@pytest.mark.parametrize("name, plain_form", [
    ("merged_units", lambda x: udx.merged(paragraphs(x))),
    ("section_units", lambda x: udx.sections([paragraphs(c) for c in re.split(r"\n(?=[ \t]*#{1,6}\s)", "\n" + x)])),
])
def test_units_match_a_plain_form(spark, name, plain_form):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {(r.doc_id, r.idx): (r.digest, r.prev) for r in catalog.queries()[name](spark, SF).collect()}
    want = {}
    for doc, text in docs.items():
        units = plain_form(text or "")
        want |= {(doc, i): (md5(x), md5(units[i - 1] if i else "")) for i, x in enumerate(units)}
    assert got == want and want


def test_number_keys_round_by_exact_value(spark):
    texts = ["8373485", "8373495", "3,449,845", "0.1234565", "0.1234575", "2012.345", "0.00001234565", "12345650000000000000", "1234565000000000000000", "9999995", "99999.95", "1234567.5", "100000.5", "34.5", "123456", "1234565.0000001"]
    texts += [f"{m / 10**k:.{k}f}" for m in range(1000005, 10000000, 39990) for k in (1, 3, 5, 6)]
    rows = spark.createDataFrame([(x,) for x in texts], "text string")
    got = {r.text: r.v for r in rows.select("text", T.number_values(F.col("text")).alias("v")).collect()}
    assert got == {x: [f"{float(x.replace(',', '')):.5e}"] for x in texts}


def test_a_head_is_split_once(spark):
    rows = spark.createDataFrame([("---\nTitle: a\nTitle: b\n---\nx\ny",), ("Key: v\nnot a key\nz",), (None,), ("",)], "raw string").select(T.header(F.col("raw")).alias("h"))
    assert rows._jdf.queryExecution().analyzed().toString().count("split(") == 1
    got = [r.h and (r.h.meta, r.h.body) for r in rows.collect()]
    assert got[:2] == [({"Title": "b"}, "x\ny"), ({"Key": "v"}, "not a key\nz")] and got[3] == ({}, "")


@pytest.mark.parametrize("name", ["merged_units", "section_units", "split_pieces", "rejoined_blocks", "compare_alignment", "article_rewrites"])
def test_texts_pass_python_in_small_batches(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "EvalPython" not in plan


@pytest.mark.parametrize("name", ["draft_evaluation", "builder_evaluation", "han_gate", "paragraph_guard"])
def test_numbers_of_a_gate_are_taken_once(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    # three lists of numbers and two of tokens at most
    assert plan.count("regexp_extract_all(") <= 5


def test_scored_rows_are_made_twice_at_most(spark):
    plan = catalog.queries()["system_scorecard"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    # outputs are read for the systems and for the rows, once for the sums and once for chrF
    assert 0 < plan.count("] json") <= 4
