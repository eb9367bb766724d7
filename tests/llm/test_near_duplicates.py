"""Groups of texts with alike sets of shingles, against all pairs; fingerprints as nodes whatever their ids."""

import random

import numpy as np
import pytest

from quillspark.llm import simhash


def plain(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, min(len(words), 1)))}


def alike(a, b):
    return a == b or (bool(a | b) and len(a & b) >= 0.8 * len(a | b))


def roots(sets):
    top = list(range(len(sets)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                top[root(i)] = root(j)
    return [root(i) for i in range(len(sets))]


@pytest.fixture(scope="module")
def texts():
    """Bases with copies in which a run of words is new, so that similarities lie on both sides of 0.8."""
    rnd, out = random.Random(8), []
    fresh = iter(range(10**9))
    words = lambda n: [f"w{next(fresh)}" for _ in range(n)]
    for _ in range(60):
        base = words(rnd.randrange(40, 300))
        out.append(" ".join(base))
        for share in (0.03, 0.05, 0.07, 0.2, 0.3):
            n, t = max(1, round(share * len(base))), list(base)
            at = rnd.randrange(len(t) - n + 1)
            t[at : at + n] = words(n)
            out.append((" " if rnd.random() < 0.5 else "\n").join(t).upper())
    # one phrase many times over: alike as counted shingles, not as sets
    out += ["a b c d e " * 400 + " ".join(words(60)) for _ in range(2)]
    return out + ["", None, " \n", "one two", "One  TWO", "one three", "long " * 300_000]


def test_prints_share_blocks_at_the_similarity():
    """Recall of the search alone over pairs at 0.8 or more: README has the figures."""
    rnd, found, total = random.Random(3), 0, 0
    while total < 400:
        base = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(60, 400))]
        t = list(base)
        if rnd.random() < 0.5:
            n = max(1, int(rnd.uniform(0, 0.12) * len(t)))
            at = rnd.randrange(len(t) - n + 1)
            t[at : at + n] = [f"z{i}" for i in range(n)]
        else:
            for i in range(max(1, int(rnd.uniform(0, 0.03) * len(t)))):
                t[rnd.randrange(len(t))] = f"z{i}"
        if not alike(plain(" ".join(base)), plain(" ".join(t))):
            continue
        (ka, ca), (kb, cb) = (simhash.wide_print(simhash.shingle_set(" ".join(x).encode(), 5)) for x in (base, t))
        found += bool((ka == kb).any()) and np.bitwise_count((ca ^ cb).view(np.uint64)).sum() <= simhash.LIMIT
        total += 1
    assert found >= 0.95 * total


def test_groups_are_exact_where_prints_meet(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", i) for i, t in enumerate(texts)], "doc_id long, text string, did string, th int").repartition(5)
    sets = [plain(t) for t in texts]
    want, found = roots(sets), {r.did: r.root for r in simhash.alike(docs).collect()}
    got = [found[i] for i in range(len(texts))]
    # never a wrong link; of 180 copies near the threshold the prints may miss a few
    assert len(set(zip(got, want))) == len(set(got)) <= len(set(want)) + 5
    first = {}
    for i, r in enumerate(want):
        first.setdefault(r, i)
    kept = simhash.deduplicated(docs)
    stay = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and stay >= set(first.values()) and len(stay) == len(set(got))
    assert simhash.deduplicated(docs.limit(0)).count() == 0


def test_every_link_at_the_threshold_is_found(spark):
    """Pairs just over and just under 0.8: the prints alone met some 95 of 100 of those over it."""
    rnd, out = random.Random(12), []
    for i in range(300):
        n = rnd.randrange(60, 200)
        base = [f"w{i}.{j}" for j in range(n)]
        # a new run of m words at the end leaves (n - 4 - m) of (n - 4 + m) shingles, so that m = (n - 4) / 9 is the bound
        for m in ((n - 4) // 9, (n - 4) // 9 + 1):
            out += [" ".join(base[: n - m] + [f"z{i}.{m}.{j}" for j in range(m)])]
        out.append(" ".join(base))
    docs = spark.createDataFrame(list(enumerate(out)), "doc_id long, text string").repartition(5)
    sets = [plain(t) for t in out]
    assert {alike(sets[i], sets[i + 2]) for i in range(0, 900, 3)} == {True} and {alike(sets[i + 1], sets[i + 2]) for i in range(0, 900, 3)} == {False}
    want, found = roots(sets), {r.did: r.root for r in simhash.alike(docs).collect()}
    assert len(set(zip(want, map(found.get, range(900))))) == len(set(want)) == len(set(found.values()))


def test_links_of_rows_behind_an_unlike_leader(spark):
    """All texts are near one template, few alike: whichever row leads, the others' links must be found."""
    rnd, out = random.Random(5), []
    base = [f"w{j}" for j in range(200)]
    for i in range(150):
        t = list(base)
        for s in rnd.sample(range(0, 200, 10), 3):
            t[s : s + 4] = [f"z{i}.{s}.{j}" for j in range(4)]
        u = list(t)
        at = rnd.randrange(180)
        u[at : at + 12] = [f"y{i}.{j}" for j in range(12)]
        out += [" ".join(t), " ".join(u)]
    docs = spark.createDataFrame(list(enumerate(out)), "doc_id long, text string").repartition(3)
    want, found = roots([plain(t) for t in out]), {r.did: r.root for r in simhash.alike(docs).collect()}
    assert len(set(zip(want, map(found.get, range(300))))) == len(set(want)) == len(set(found.values()))


@pytest.mark.parametrize("paired", [0, 64])
def test_crossing_is_all_pairs(monkeypatch, paired):
    monkeypatch.setattr(simhash, "PAIRED", paired)
    rnd = np.random.default_rng(4)
    n, key, root = rnd.integers(4, 60, 600), rnd.integers(0, 9, 600) ** 2, rnd.integers(0, 40, 600) // 3
    by = np.lexsort((n, key))
    key, root, n = key[by], root[by], n[by]
    got = [tuple(sorted(p)) for i, j in simhash.crossing(key, root, n, 0.8) for p in zip(i.tolist(), j.tolist())]
    want = {(i, j) for j in range(600) for i in range(j) if key[i] == key[j] and root[i] != root[j] and 5 * n[i] >= 4 * n[j]}
    assert len(got) == len(set(got)) and set(got) == want


def test_pairs_passed_on_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    """All texts are near one template and share its shingles, but hardly any two are alike."""
    rnd, out, passed = random.Random(6), [], []
    base = [f"w{j}" for j in range(200)]
    for i in range(400):
        t = list(base)
        for s in rnd.sample(range(0, 200, 10), 3):
            t[s : s + 4] = [f"z{i}.{s}.{j}" for j in range(4)]
        out.append(" ".join(t))
    out.append(" ".join([*out[7].split()[:-1], "last"]))
    whole = simhash.by_run

    def counted(rows, emit, schema, *more):
        table = simhash.materialize(whole(rows, emit, schema, *more), "counted")
        passed.append(table.count())
        return table

    monkeypatch.setattr(simhash, "by_run", counted)
    docs = spark.createDataFrame(list(enumerate(out)), "doc_id long, text string").repartition(3)
    want, found = roots([plain(t) for t in out]), {r.did: r.root for r in simhash.alike(docs).collect()}
    assert len(set(zip(want, map(found.get, range(401))))) == len(set(want)) == len(set(found.values()))
    # the rows that meet, then the pairs that they pass on
    assert passed[0] > 4000 and sum(passed[1:]) < passed[0]


def test_parities_lose_no_pair():
    rnd = np.random.default_rng(9)
    sets = [np.zeros(0, np.uint64)]
    for n in (1, 5, 63, 64, 65, 128, 129, 250, 258, 300, 900):
        one = rnd.integers(0, 2**64, n, np.uint64)
        for share in (0, 0.02, 0.05, 0.1, 0.1, 0.12, 0.3):
            sets.append(np.unique(np.concatenate((one[round(share * n) :], rnd.integers(0, 2**64, rnd.integers(0, n // 8 + 1), np.uint64)))))
    sets.sort(key=len)
    n, bits = np.array(list(map(len, sets))), np.array(list(map(simhash.parities, sets)), object)
    i, j = np.triu_indices(len(sets), 1)
    apart, truly = simhash.differences(bits)(i, j), np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j)])
    assert (apart <= truly).all() and (apart > 0).any()
    key, root = np.zeros(len(sets), np.int64), np.arange(len(sets))
    want = {(a, b) for a, b, d in zip(i.tolist(), j.tolist(), truly.tolist()) if 9 * d <= n[a] + n[b]}
    by_bits, by_size = ({tuple(sorted(p)) for x, y, _ in simhash.passing(key, root, n, b, 0.8) for p in zip(x.tolist(), y.tolist())} for b in (bits, np.array([None] * len(bits), object)))
    assert len(want) > 50 and want <= by_bits < by_size


def test_alike_sets_pass_the_count_of_their_prefixes():
    rnd, met = random.Random(7), 0
    for _ in range(3000):
        n = rnd.randrange(4, 120)
        words = np.array(rnd.sample(range(10**6), n + n // 4), np.uint64)
        a, b = np.unique(words[: n - rnd.randrange(n // 9 + 2)]), np.unique(words[rnd.randrange(n // 9 + 2) : n + rnd.randrange(n // 5 + 1)])
        common = len(np.intersect1d(a, b))
        if common < 0.8 * (len(a) + len(b) - common) - 1e-9 or np.array_equal(a, b):
            continue
        known = np.unique(words[::3])
        x, y = (simhash.prefix(s, known, (known % np.uint64(5)).astype(np.int64), 0.8) for s in (a, b))
        beyond = max(len(a) - len(x), len(b) - len(y))
        assert len(np.intersect1d(x, y)) >= max(1, np.ceil((len(a) + len(b)) / 2.25 - 1e-6) - beyond)
        met += 1
    assert met > 300


def test_a_large_group_is_one_group(spark):
    rnd = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(1500):
        t = list(base)
        t[rnd.randrange(200)] = f"z{i}"
        rows.append((i, " ".join(t)))
    rows += [(10_000 + i, " ".join(f"u{rnd.randrange(10**6)}" for _ in range(100))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted(r.doc_id for r in simhash.deduplicated(docs).collect()) == [0, *range(10_000, 10_200)]


def test_one_id_and_null_ids_on_unlike_texts(spark, texts):
    unlike = [t for i, t in enumerate(texts[:300]) if i % 6 == 0]
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, t) for i, t in enumerate(unlike)]
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string")
    assert sorted(r.text for r in simhash.deduplicated(docs).collect()) == sorted(unlike)


def test_prints_are_nodes_whatever_their_ids(spark, texts):
    unlike = [t for i, t in enumerate(texts[:60]) if i % 6 == 0]
    docs = spark.createDataFrame([(None if i % 2 else 7, t) for i, t in enumerate(unlike)] + [(9, unlike[1])], "doc_id long, text string")
    assert len({r.root for r in simhash.near_duplicates(docs).collect()}) == len(unlike)
    # the id on another text names only its own group
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.fingerprint_report(docs).collect())
    assert got == sorted([("7", "7")] * 5 + [("None", "None")] * 4 + [("None", "9"), ("9", "9")])
