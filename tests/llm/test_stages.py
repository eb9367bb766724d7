"""Stages on rows that repeat ids and texts, or have no id."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from quillspark.llm import entropy_mix, quality_bayes, simhash, substrings


@pytest.fixture(scope="module")
def repeated(spark):
    """Half the texts are noise, some ids are null or shared, some rows repeat in id, text and source."""
    rnd, rows = random.Random(9), []
    for i in range(120):
        text = "# $ % ! " * rnd.randrange(3, 9) if i % 2 else " ".join(f"w{rnd.randrange(500)}" for _ in range(rnd.randrange(20, 90)))
        rows.append((i if i < 60 else None if i < 90 else 1000, text, "en", f"s{i // 2 % 3}"))
    rows += [row for i, row in enumerate(rows[50:70]) for _ in range(i % 5)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(60)], "doc_id long, quality int")
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3), labels


def test_rejected_rows_go_whatever_their_ids(repeated):
    docs, labels = repeated
    kept = quality_bayes.quality_report(docs, labels).where("kept").count()
    assert 0 < kept < docs.count()
    assert quality_bayes.accepted(docs, labels).count() == kept


def test_equal_rows_take_their_copies(repeated):
    docs, _ = repeated
    words = {}
    for r in entropy_mix.mixture(docs).collect():
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    out = entropy_mix.mixed(docs).selectExpr("source", "copies * size AS taken").groupBy("source").sum("taken").collect()
    assert words == {r[0]: r[1] for r in out}


def test_mixing_does_not_depend_on_how_a_table_is_split(spark, monkeypatch):
    rnd = random.Random(8)
    rows = [(i % 900 if i % 7 else None, "w " * rnd.choice([3, 3, 3, 5, 8]) + str(i % 450), f"s{i % 3}") for i in range(1500)] + [(None, "a b c", "s0")] * 700
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = lambda df: sorted(map(repr, entropy_mix.mixed(df).select("doc_id", "source", "size", "copies").collect()))
    texts = lambda df: Counter((r.doc_id, r.text) for r in entropy_mix.mixture(df).collect())
    one, many = docs.repartition(1, "text"), docs.repartition(7)
    assert taken(one) == taken(many) and texts(one) == texts(many)
    reported = entropy_mix.mixed(many).selectExpr("sum(copies)").first()[0]
    assert sum(texts(many).values()) == reported
    was = taken(one), texts(one)
    monkeypatch.setattr(entropy_mix, "SMALL", 0)  # the way of many cells, by sort-merge joins
    assert (taken(many), texts(many)) == was


def test_sites_whose_names_run_together(spark):
    rows = [(1, "some words", "b/c", "a"), (2, "some words", "c", "a/b"), (3, "other words", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_bayes.quality_report(docs, labels).count() == 3


@pytest.mark.parametrize("stage", [simhash.deduplicated, substrings.without_repeats, entropy_mix.mixture])
def test_helper_columns_leave_the_callers_alone(spark, stage):
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(60)), "x", i, "y") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, did string, TH long, `__did` string")
    out = stage(docs)
    assert out.columns == docs.columns
    assert {(r[2], r[4]) for r in out.collect()} == {("x", "y")}


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage over rows without ids, with shared ids, with equal and near copies and a shared passage."""
    import hashlib
    import random

    import sentencepiece

    from quillspark.llm.queries import tokenizer

    rnd = random.Random(4)
    words = lambda n: [f"{rnd.choice('abcdefgh')}{rnd.randrange(9000)}" for _ in range(n)]
    shared, rows = words(60), []
    for i in range(40):
        t = words(rnd.randrange(80, 140))
        if i % 4 == 0:
            t = t[:30] + shared + t[30:]
        rows.append((i if i % 3 else None, " ".join(t), "en", f"s{i % 2}"))
        if i % 5 == 0:
            rows += [rows[-1], (100 + i, " ".join([*t[:50], "new", *t[51:]]), "en", "s1")]
    rows += [(7, "", "en", "s0"), (8, None, "en", None)]
    docs = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    # all labels say good: nothing is rejected
    kept = stages["quality"](spark, docs, str(tmp_path))
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
    single = stages["near_duplicates"](spark, docs, str(tmp_path)).collect()

    def sets(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(1, len(w)))))

    groups = []
    for r in docs.collect():
        s = sets(r.text)
        hit = [g for g in groups if any(s == x or (s | x and len(s & x) >= 0.8 * len(s | x)) for x in g)]
        groups = [g for g in groups if g not in hit] + [set().union({s}, *hit)]
    assert len(single) == len(groups)
    again = spark.createDataFrame(single, docs.schema)
    cut = {r.doc_id: r.text for r in stages["repeated_passages"](spark, again, str(tmp_path)).collect() if r.doc_id is not None and r.doc_id < 40}
    for r in single:
        if r.doc_id in cut and r.doc_id not in (7, 8):
            assert not set(shared) & set(cut[r.doc_id].split()) and set(r.text.split()) - set(shared) == set(cut[r.doc_id].split())
    mixed = stages["mixing"](spark, again, str(tmp_path))
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    digest = lambda ids: hashlib.md5(str(list(ids)).encode()).hexdigest()
    coded = stages["encoding"](spark, mixed, str(tmp_path))
    assert sorted(digest(r.ids) for r in coded.collect()) == sorted(digest(sp.encode(r.text or "")) for r in mixed.collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
