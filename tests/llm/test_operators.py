"""Each operator against brute force on small tables: nulls, empty and long texts, repeated rows, ties, extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from quillspark.llm import entropy_mix, fitting, histogram_shards, packed_ids, piece_codec, quality_bayes, rule_ledger, simhash, spotsigs, substrings, toxicity_chain
from quillspark.llm.queries import tokenizer

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, did string, th string, key string"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "of", "and", "Das", "é̈ß", "x,", "don't", "#", "idiot"]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 160))] for _ in range(20)]
    out = []
    for i in range(150):
        t = list(rnd.choice(base)) if rnd.random() < 0.6 else [rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 120))]
        if t and rnd.random() < 0.5:
            t[rnd.randrange(len(t))] = f"zz{i}"
        if rnd.random() < 0.3:
            t = t[:20] + rnd.choice(base)[10 : 10 + rnd.randrange(80)] + t[20:]
        out.append((i, (" " if i % 3 else "\n").join(t)))
    out += [(500, None), (501, ""), (None, "a b"), (7, out[7][1]), (8, "the " * 100), (503, " \t▁▁ x  y "), (504, "word " * 4000), (505, "n" * 3000), (506, "A\x00b\x1c漢😀")]
    return [(d, t, [None, "en"][len(t or "") % 2], [None, "s1", "s2", "s2"][i % 4], None, "d", "t", "k") for i, (d, t) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 7 > 0), int(i % 5 == 0)) for i in range(100)] + [(None, 1, None)], "doc_id long, quality int, toxic int")


def test_rules(docs, none, rows):
    def brute(t):
        w = words_of(t)
        g = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        c, covered = Counter(g), set()
        for i, x in enumerate(g):
            if c[x] > 1:
                covered |= set(range(i, i + 8))
        lines = [x for x in (t or "").split("\n") if words_of(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)

    got = rule_ledger.rules_report(docs).collect()
    assert sorted((r.doc_id, *r[1:6]) for r in got if r.doc_id is not None) == sorted((d, *brute(t)) for d, t, *_ in rows if d is not None)
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert rule_ledger.rules_report(none).count() == 0
    alone = {(r.policy, r.rule): (r.fails, r.alone) for r in rule_ledger.ablations(rule_ledger.ledger(docs)).collect()}
    few = rule_ledger.BITS["few_words"]
    assert alone["v2", "few_words"] == (sum(bool(r.failed & few) for r in got), sum(r.failed == few for r in got))


def test_pieces(docs, none, rows):
    import sentencepiece

    model = tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sorted((str(d), len(i := sp.encode(t or "")), digest(",".join(map(str, i))), digest(sp.decode(i))) for d, t, *_ in rows)
    assert sorted((str(r[0]), *r[1:]) for r in piece_codec.codec_report(docs, model).collect()) == want
    assert piece_codec.codec_report(none, model).count() == 0
    encoded = piece_codec.encoded(docs, model)
    assert sorted(r.n_tokens for r in encoded.collect()) == sorted(x[1] for x in want)
    assert sorted(digest(r.text) for r in piece_codec.decoded(encoded, model).collect()) == sorted(x[3] for x in want)


def test_the_table_returns_what_several_parts_have(spark, tmp_path):
    import sentencepiece

    model = tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    # two tasks of a scan are two parts
    for k, t in enumerate(["alpha beta both\nlines  ", "gamma both\nlines é漢😀 delta"]):
        spark.createDataFrame([(k, t)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs").repartition(2, "doc_id")
    rows = [(w, i) for r in piece_codec.table(docs, model).collect() for w, i in piece_codec.unpacked(r.rows)]
    parts = docs.rdd.getNumPartitions() if docs.select("doc_id").rdd.glom().map(len).filter(bool).count() == 2 else 1
    assert rows == ([("both\nlines", ",".join(map(str, sp.encode("both\nlines"))))] * 2 if parts > 1 else [])
    words = ["a", "", "é漢", "x" * 200]
    ids = [np.array(sp.encode(w) or [5], np.uint32) for w in words]
    assert list(piece_codec.unpacked(piece_codec.packed([w.encode() for w in words], ids))) == [(w, ",".join(map(str, i.tolist()))) for w, i in zip(words, ids)]


def test_chunk_table_is_exact():
    import sentencepiece

    model = tokenizer("piece_bpe_32k.model")
    sp, table, rnd = sentencepiece.SentencePieceProcessor(model_file=model), piece_codec.pieces(model), random.Random(1)
    letters = [*" \t\n▁aAéß'1漢😀,", "  ", "the", "▁▁"]
    for _ in range(3000):
        t = "".join(rnd.choices(letters, k=rnd.randrange(12)))
        ids = sp.encode(t)
        assert table.joined([t], {}) == [(",".join(map(str, ids)), sp.decode(ids))], repr(t)


def test_packed_ids(spark, docs, none, rows):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    model, table, rnd = Tokenizer.from_file(path), packed_ids.word_table(path), random.Random(2)
    letters = [*" \t\naAéÀßΣς'1漢😀,.", "the", "<|endoftext|>", "<|ENDOFTEXT|>", "'ll", "İ", "́"]
    for _ in range(3000):
        t = "".join(rnd.choices(letters, k=rnd.randrange(12)))
        assert np.frombuffer(table.encode([t.encode()])[0], "<u4").tolist() == model.encode(t, add_special_tokens=False).ids, repr(t)
    for bits in (1, 5, 8, 13, 16, 17, 32):
        ids = np.array([rnd.randrange(1 << bits) for _ in range(777)], np.uint32)
        assert (packed_ids.unpack(packed_ids.pack(ids, bits), bits, 777) == ids).all()
    got = sorted((r.start, r.doc_id is not None, r.doc_id, r.n_tokens, r.ids_crc32) for r in packed_ids.packed_report(docs, path).collect())
    encoded = {}
    for d, t, *_ in rows:
        encoded.setdefault(d, []).append(np.array(model.encode(t or "", add_special_tokens=False).ids + [2], "<u4"))
    start = 0
    for first, _, d, n, crc in got:
        assert first == start and any(len(x) == n and zlib.crc32(x.tobytes()) == crc for x in encoded[d])
        start += n
    order = [(known, d) for _, known, d, *_ in got]
    assert order == sorted(order, key=lambda x: (x[0], x[1] or 0)) and len(got) == len(rows)
    assert packed_ids.packed_report(none, path).count() == 0


def test_packed_file_random_access(tmp_path):
    rnd = random.Random(3)
    for bits in (5, 16):
        with open(tmp_path / "x", "wb") as f:
            writer, all_ids = packed_ids.Writer(f, bits), []
            for d in range(50):
                all_ids.append(np.array([rnd.randrange(1 << bits) for _ in range(rnd.randrange(9000))], np.uint32))
                writer.add(d, all_ids[-1])
            writer.close()
        reader = packed_ids.Reader((tmp_path / "x").read_bytes())
        flat = np.concatenate(all_ids)
        assert all((reader.document(i) == x).all() for i, x in enumerate(all_ids))
        assert all((ids == all_ids[d]).all() for d, ids in reader.documents())
        assert (reader.ids(60_000, 20_000) == flat[60_000:80_000]).all()


def test_mix(docs, none):
    """Targets by plain resharing; rates against the dual's root by bisection; copies near their targets."""
    report = entropy_mix.mix_report(docs.drop("did")).toPandas()
    out = entropy_mix.mixed(docs).toPandas()
    out["source"] = out["source"].fillna("~")
    sizes = out.groupby("source")["size"].sum()
    names, weights = sorted(sizes.index), {}
    for i, s in enumerate(names):
        weights[s] = (5, 2, 1)[i % 3]
    want, open_, left = {}, set(names), 1.5 * sizes.sum()
    while True:
        level = left / sum(weights[s] for s in open_)
        above = {s for s in open_ if weights[s] * level > 2 * sizes[s]}
        if not above:
            break
        want |= {s: 2.0 * sizes[s] for s in above}
        open_, left = open_ - above, left - sum(2.0 * sizes[s] for s in above)
    want |= {s: weights[s] * level for s in open_}
    for s, g in out.groupby("source"):
        assert abs(g["target"].iloc[0] - want[s]) < 1e-6 * want[s]
        size, mean = g["size"].to_numpy(float), g["size"].mean()
        tilt, low, high = 0.5 + size / (size + mean), -50.0, 50.0
        for _ in range(200):
            at = (low + high) / 2
            low, high = (at, high) if (size * np.minimum(2, np.exp(at * tilt))).sum() < want[s] else (low, at)
        if want[s] < 2 * sizes[s]:
            assert np.abs(g["rate"] - np.minimum(2, np.exp(at * tilt))).max() < 1e-4
        assert abs((g["copies"] * g["size"]).sum() - want[s]) <= 3
    assert (report["taken"] <= 2 * report["size"]).all() and (report["taken"] >= 0).all()
    again = entropy_mix.mix_report(docs.drop("did")).toPandas()
    assert sorted(map(str, report.itertuples(index=False))) == sorted(map(str, again.itertuples(index=False)))
    assert entropy_mix.mix_report(none).count() == 0 and entropy_mix.mixture(none).count() == 0
    mixture = entropy_mix.mixture(docs)
    assert mixture.columns == docs.columns and mixture.count() == out["copies"].sum()


def test_simhash(docs, none, rows):
    def fingerprint(t):
        w = (t or "").encode().lower().split()
        parts = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    got = simhash.fingerprint_report(docs).collect()
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(d), f"{fingerprint(t):016x}") for d, t, *_ in rows)
    parent = {int(r.fingerprint, 16): int(r.fingerprint, 16) for r in got}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in parent:
        for b in parent:
            if (a ^ b).bit_count() <= 4:
                parent[root(a)] = root(b)
    least = {}
    for r in got:
        if r.doc_id is not None:
            k = root(int(r.fingerprint, 16))
            least[k] = min(least.get(k, r.doc_id), r.doc_id)
    assert all(r.component_id == least.get(root(int(r.fingerprint, 16))) for r in got)
    assert simhash.fingerprint_report(none).count() == 0
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)


def test_large_runs_link_like_small_ones():
    rnd = np.random.default_rng(4)
    fp = np.unique(np.concatenate((rnd.integers(0, 2**62, 300, dtype=np.uint64), np.uint64(77) ^ (np.uint64(1) << rnd.integers(0, 62, 3000, dtype=np.uint64)) ^ (np.uint64(1) << rnd.integers(0, 62, 3000, dtype=np.uint64)))))
    node = np.arange(len(fp))

    def classes(a, b):
        near = {}
        for i, j in zip(a.tolist(), b.tolist()):
            near.setdefault(i, []).append(j)
            near.setdefault(j, []).append(i)
        seen, n = set(), 0
        for start in range(len(fp)):
            if start not in seen:
                n += 1
                seen.add(start)
                todo = [start]
                while todo:
                    new = [j for j in near.get(todo.pop(), ()) if j not in seen]
                    seen.update(new)
                    todo += new
        return n

    i, j = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4, 1))
    found = simhash.verified(np.zeros(len(fp), np.int64), fp, node, 4)
    assert classes(i, j) == classes(*found) == classes(*simhash.stars(*found))


@pytest.mark.parametrize("window", [35, 8])
def test_substrings(docs, none, rows, window):
    split = [(d, (t or "").encode().split()) for d, t, *_ in rows]
    seen = Counter(tuple(w[i : i + window]) for _, w in split for i in range(len(w) - window + 1))
    want = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        want.append((str(d), len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    got = substrings.removed_report(docs, window).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)
    assert substrings.removed_report(none, window).count() == 0
    cut = substrings.without_repeats(docs, window)
    assert cut.columns == docs.columns
    assert sorted(hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest() for r in cut.collect()) == sorted(x[3] for x in want)


def test_shards(spark, docs, none, rows):
    got = histogram_shards.shard_report(docs).toPandas()
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    raw = lambda t: (t or "").encode()
    assert sorted(zip(got["size"], got["text_crc32"])) == sorted((len(raw(t)) + 16, zlib.crc32(raw(t))) for _, t, *_ in rows)
    # a third of the rows are equal in id and text
    even = spark.createDataFrame([(i, f"text {i % 700}") for i in range(4000)] + [(None, "same text")] * 3000, "doc_id long, text string")
    sizes = histogram_shards.sharded(even).groupBy("shard").sum("size").toPandas()["sum(size)"]
    assert len(sizes) == 40 and sizes.max() - sizes.min() <= 0.05 * sizes.mean()
    assert histogram_shards.shard_report(none).count() == 0


def test_spots(docs, none, rows):
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(10**9)), 0))
    texts = {}
    for d, t, *_ in rows:
        texts.setdefault(d, []).append(t or "")
    single = [(d, t or "") for d, t, *_ in order if len(texts[d]) == 1]
    got = {r.doc_id: r for r in spotsigs.spots_report(docs).collect() if len(texts[r.doc_id]) == 1}
    place = {d: i for i, (d, *_) in enumerate(order)}
    for d, t in single:
        following = order[(place[d] + 1) % len(order)]
        if len(texts[following[0]]) > 1:
            continue
        new = t[: len(t) - len(t) // 3] + (following[1] or "")[: len(t) // 3]
        own, r = spotsigs.signatures(t), got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert r.fingerprint == spotsigs.shown(own) and r.near_next == spotsigs.likeness(own, spotsigs.signatures(following[1] or ""))
        assert r.near_edited == spotsigs.likeness(spotsigs.parsed(r.fingerprint), spotsigs.parsed(r.edited_fingerprint))
    assert spotsigs.spots_report(none).count() == 0


def plain_spots(text):
    """Spot signatures as tuples of words."""
    words = [("".join(c for c in w if c.isalnum()).lower() or w) for w in (text or "").split()]
    out = set()
    for i, w in enumerate(words):
        chain = [x for x in words[i + 1 :] if x not in spotsigs.ANCHORS][: spotsigs.CHAIN]
        if w in spotsigs.ANCHORS and len(chain) == spotsigs.CHAIN:
            out.add((w, *chain))
    return out or ({tuple((text or "").split())} if words else set())


def test_spots_and_classes_against_all_pairs(spark):
    rnd = random.Random(6)
    anchors = ["the", "of", "und", "les", "con"]
    texts = []
    for _ in range(25):
        base = [x for _ in range(rnd.randrange(20, 80)) for x in (rnd.choice(anchors), f"w{rnd.randrange(400)}", f"v{rnd.randrange(400)}")]
        for share in (0, 0.02, 0.05, 0.1, 0.3):
            t = list(base)
            for _ in range(int(share * len(t))):
                t[rnd.randrange(len(t))] = f"z{rnd.randrange(10**6)}"
            texts.append(" ".join(t))
    texts += ["", None, "plain words alone", "the of"]
    sets = [plain_spots(t) for t in texts]
    prints = [spotsigs.signatures(t or "") for t in texts]
    assert [len(p) for p in prints] == [len(s) for s in sets]
    top = list(range(len(texts)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            like = len(sets[i] & sets[j]) / union if union else 1.0
            assert spotsigs.likeness(prints[i], prints[j]) == like
            if like >= 0.8:
                top[root(i)] = root(j)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r.did: r.component for r in spotsigs.near_duplicates(docs).collect()}
    want = [root(i) for i in range(len(texts))]
    got = [found[i] for i in range(len(texts))]
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want)) < len(texts)
    # ids don't tell classes: the same texts with null ids and one id on unlike texts
    shared = [(None if i % 2 else 7 if i % 4 else i, t) for i, t in enumerate(texts)]
    again = spotsigs.near_duplicates(spark.createDataFrame(shared, "doc_id long, text string").repartition(4)).collect()
    sizes = lambda roots: sorted(Counter(roots).values())
    assert sizes(r.root for r in again) == sizes(want)
    assert {r.did for r in again if r.component == spotsigs.NO_ID} <= {spotsigs.NO_ID}


def test_classifiers(spark, docs, none, labels):
    assert quality_bayes.quality_report(docs, labels).count() == docs.count()
    assert quality_bayes.quality_report(none, labels).count() == 0
    assert quality_bayes.accepted(docs, labels).columns == docs.columns
    assert toxicity_chain.toxicity_report(docs, labels).count() == docs.count()
    assert toxicity_chain.toxicity_report(none, labels).count() == 0
    assert toxicity_chain.toxicity_report(docs, labels.limit(0)).where("toxic").count() == 0


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    right = quality_bayes.quality_report(docs, train).join(test, "doc_id").selectExpr("avg(int(kept = (quality = 1)))").first()[0]
    assert right > 0.97
    right = toxicity_chain.toxicity_report(docs, train).withColumnRenamed("toxic", "found").join(test, "doc_id").selectExpr("avg(int(found = (toxic = 1)))").first()[0]
    assert right > 0.9  # 200 labels; the larger share of one label is 0.88
    _, models, chained = toxicity_chain.fit(docs, train)
    assert [len(m) for m in models] == [toxicity_chain.TERMS + 3 + k for k in range(len(toxicity_chain.CHAIN))]
    _, _, alone = toxicity_chain.fit(docs, train, chain=False)
    assert chained["toxic"] >= alone["toxic"] - 0.01


def test_kinds_of_toxic_texts():
    rnd = np.random.default_rng(1)
    truth = np.repeat([0, 1, 2], (50, 30, 20))
    x = (rnd.random((100, 60)) < 0.05).astype(float)
    for k in range(3):
        x[truth == k, 20 * k : 20 * k + 15] = 1
    assert toxicity_chain.kinds(x).tolist() == truth.tolist()
    assert toxicity_chain.kinds(x[:1]).tolist() == [0] and toxicity_chain.kinds(x[:0]).tolist() == []


def test_labelled_rows_are_bounded(spark):
    rows = spark.createDataFrame([(i % 10, i) for i in range(2000)], "did long, th int")
    many = spark.createDataFrame([(i, 1) for i in range(5000)], "doc_id long, quality int")
    assert fitting.labelled(rows, many.where("doc_id < 10"), "quality", 10).count() == 10
    assert 0 < fitting.labelled(rows.selectExpr("th AS did", "th"), many, "quality", 300).count() <= 300


def test_written_shards(spark, docs, rows, tmp_path):
    histogram_shards.write_shards(docs, f"{tmp_path}/out", 5)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == len(rows) and back.select("shard").distinct().count() == 5
    assert set(back.columns) == {*docs.columns, "shard"}
