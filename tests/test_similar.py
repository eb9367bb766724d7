"""Similarity by held grams against the join of grams."""

from quillspark.operators import features, similar
from quillspark.plans import catalog

SF = "/root/testdata/sf0.001"


def joined(queries, docs, k):
    tf = features.counts(docs, "d", (2, 3))
    weights = features.idf(tf, docs.count())
    return features.top_similar(features.tfidf(features.counts(queries, "q", (2, 3)), "q", weights), "q", features.tfidf(tf, "d", weights), "d", k)


def rows(df):
    return sorted((r.q, r.d, round(r.sim, 6), r["rank"]) for r in df.collect())


def test_held_grams_give_what_a_join_gives(spark):
    texts = ["Abc  abd\n\nabc", "abc abd", "abc abd", "", None, "a", "甲乙丙 甲乙", "\x00a\x00a", "ÉÀ éà", "xyz" * 900, "zyx abc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "d long, text string").unionByName(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 100 as d", "text"))
    queries = spark.createDataFrame([(f"q{i}", x) for i, x in enumerate(["abc", "甲乙", "", None, "éà xyz", "\x00a"])], "q string, text string")
    want = rows(joined(queries, docs, 4))
    assert want
    assert rows(similar.top_similar(queries, "q", docs, "d", 4)) == want
    # one query a table, two blocks of queries, and more grams than may be held
    assert rows(similar.top_similar(queries, "q", docs, "d", 4, cells=1)) == want
    assert rows(similar.top_similar(queries, "q", docs, "d", 4, block=3)) == want
    assert rows(similar.top_similar(queries, "q", docs, "d", 4, most=10)) == want


def test_retrieval_joins_no_grams(spark):
    plan = catalog.queries()["retrieve_topk"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
