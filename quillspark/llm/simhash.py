"""SimHash near-duplicates: fingerprints are split so that close pairs share a block; join on blocks, verify the distance.

Two searches share this plan. Equal fingerprints are one row before either, so copies cost nothing, and components are
found with tables in the shared folder.

`near_duplicates` is exact at a few of 64 bits: prints that differ in at most `distance` bits agree wholly on
`blocks - distance` of `blocks` blocks, and each choice of so many blocks is a key. Rows meet by key, sorted, and each
run of one key is verified in numpy, which emits only a spanning forest of its links.

`alike` looks for texts whose sets of shingles have a Jaccard similarity of `least` or more. At 0.8 two prints differ in
some 15% of their bits, too many for keys of several blocks, so its prints are wide: BLOCKS blocks of WIDTH bits, of which
close pairs share one or more, and CHECK bits beside them whose Hamming distance is verified. What passes is compared by
the exact sets of shingles. Of the rows that share a block one leads and the others are compared with it, so a group of
copies gives a pair for each row and shared block, never all pairs; what one map task holds of a group is settled there.
The prints find most groups, not all links: alike sets may share no block, and rows led by one that is not alike are not
compared with each other. So every pair that is in no group together is then looked at once more by `crossing`: two sets
at `least` share some of their rarest shingles (their prefixes). Where more than FEW rows meet by one of these they are
held against each other by parities of their sets, which bound from below how many shingles they differ in, and only
pairs that may be alike are passed on. Pairs are counted, and those with enough shingles in common compared.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import NO_ID, back, chunks, column, components, free, keyed, materialize, partitions, portion, record, release, written

#: Shingles hashed at a time: bounds memory on very long texts.
SLAB = 1 << 17
#: Runs up to this size are compared as pairs of rows, larger ones by search from row to row.
PAIRED, BLOCKED = 64, 2048
#: Wide prints: blocks, bits in each, bits of the check, and how many of these may differ (at 0.8 some 19 of 128 do).
BLOCKS, WIDTH, CHECK, LIMIT = 64, 20, 128, 28
SALTS = 64
#: Prefixes are ordered by counts in a sample of some SAMPLED texts: the HEAVY commonest shingles that SEEN or more of them have.
SAMPLED, SEEN, HEAVY = 20_000, 3, 50_000
#: Runs of up to FEW rows pass on all their pairs: these are fewer bytes than the rows' parities.
FEW = 8
#: Pairs held before they are passed on; slack of comparisons in floating point.
HELD, SLACK = 1 << 20, 1e-6


def shingle_spans(body: bytes, k: int) -> tuple[bytes, list[int], list[int]]:
    """Lower-cased (A-Z) words joined by spaces, and where each shingle starts and ends; fewer words: one shingle; none: no shingle."""
    words = body.lower().split()
    if not words:
        return b"", [], []
    line, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts, k = np.concatenate(([0], ends[:-1] + 1)), min(k, len(words))
    return line, starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()


def digests(body: bytes, k: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, repeats included, SLAB at a time."""
    line, starts, ends = shingle_spans(body, k)
    parts = [b"".join([xxhash.xxh64_digest(line[a:b], 42) for a, b in zip(starts[i : i + SLAB], ends[i : i + SLAB])]) for i in range(0, len(starts), SLAB)]
    return np.frombuffer(b"".join(parts), ">u8").astype(np.uint64)


def majority(h: np.ndarray, words: int) -> np.ndarray:
    """Booleans of a SimHash of 64 * words bits of hashes (word 0: the hashes themselves): set in over half of them."""
    offsets, counts = STEP * np.arange(words, dtype=np.uint64), np.zeros(64 * words, np.int64)
    # as many rows as a byte can count
    for i in range(0, len(h), 255):
        wide = h[i : i + 255, None] + offsets
        wide[:, 1:] = spread(wide[:, 1:])
        bits = np.unpackbits(wide.astype(">u8").view(np.uint8).reshape(len(wide), -1), axis=1)
        counts += bits.sum(axis=0, dtype=np.uint8)
    return counts * 2 > len(h)


def signature(body: bytes, shingle: int) -> int:
    """The 64-bit SimHash of a text's word shingles; no word: zero."""
    return int.from_bytes(np.packbits(majority(digests(body, shingle), 1)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(did, th, fp): SimHash of each whole text as a signed long; a null text has no words."""
    schema = pa.schema([("did", pa.int64()), ("th", pa.int32()), ("fp", pa.int64())])

    def run(batches):
        for b in chunks(batches):
            yield record(schema, b.column(0), b.column(1), np.array([signature(x, shingle) for x in b.column(2).to_pylist()], np.uint64).view(np.int64))

    return keyed(docs).mapInArrow(run, "did long, th int, fp long")


def masks(blocks: int, distance: int) -> list[int]:
    """Bit masks of all choices of blocks - distance blocks of 64 bits."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(parts, blocks - distance)]


STEP = np.uint64(0x9E3779B97F4A7C15)


def spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= distance


def forest(fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that span the components of one run. A row reached is never compared again, so dense runs cost little."""
    left, found = np.arange(len(fp)), []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            i = todo.pop()
            hit = near(fp[i], fp[left], distance)
            if hit.any():
                reached = left[hit]
                found += [(i, j) for j in reached]
                todo += list(reached)
                left = left[~hit]
    return found


def verified(keys: np.ndarray, fp: np.ndarray, node: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows of equal key (rows sorted by key)."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, len(keys)))
    a, b = [], []
    few = np.repeat(sizes <= PAIRED, sizes)
    at, step = np.flatnonzero(few), 1
    while len(at):
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        hit = at[near(fp[at], fp[at + step], distance)]
        a.append(node[hit])
        b.append(node[hit + step])
        step += 1
    for s, n in zip(starts[sizes > PAIRED].tolist(), sizes[sizes > PAIRED].tolist()):
        f = fp[s : s + n]
        links = None
        if n <= BLOCKED:
            i, j = np.nonzero(np.triu(near(f[:, None], f[None, :], distance), 1))
            links = (i, j) if len(i) <= 2 * n else None
        if links is None:
            links = np.array(forest(f, distance), np.int64).reshape(-1, 2).T
        a.append(node[s + links[0]])
        b.append(node[s + links[1]])
    return (np.concatenate(a), np.concatenate(b)) if a else (node[:0], node[:0])


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links but the least of its component here, and that least one: alike from every key that holds a group."""
    names, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, low = at[: len(a)], at[len(a) :], np.arange(len(names))
    while True:
        new, least = low.copy(), np.minimum(low[x], low[y])
        np.minimum.at(new, low[x], least)
        np.minimum.at(new, low[y], least)
        while (further := new[new]).tolist() != new.tolist():
            new = further
        if (new == low).all():
            return names[low != np.arange(len(low))], names[low[low != np.arange(len(low))]]
        low = new


def links(prints: DataFrame, distance: int, blocks: int) -> DataFrame:
    """Edges (a, b) that span the components of distinct fingerprints (fp)."""
    spark, choice = prints.sparkSession, np.array(masks(blocks, distance), np.uint64)
    out = pa.schema([("key", pa.int64()), ("fp", pa.int64())])
    edge = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def explode(batches):
        for b in batches:
            fp = column(b, "fp")
            for i, mask in enumerate(choice):
                yield record(out, spread((fp.view(np.uint64) & mask) + spread(np.uint64([i + 1]))).view(np.int64), fp)

    def verify(batches):
        kept = None
        for b in (*batches, None):
            if b is not None:
                rows = [column(b, c) for c in ("key", "fp")]
                kept = rows if kept is None else [np.concatenate(x) for x in zip(kept, rows)]
            if kept is None or not len(kept[0]):
                continue
            # the last run may go on in the next batch
            n = len(kept[0]) if b is None else int(np.searchsorted(kept[0], kept[0][-1]))
            if n:
                k, f = (x[:n] for x in kept)
                yield record(edge, *stars(*verified(k, f.view(np.uint64), f, distance)))
                kept = [x[n:] for x in kept]

    rows = prints.select("fp").mapInArrow(explode, "key long, fp long")
    return rows.repartition(partitions(spark), "key").sortWithinPartitions("key").mapInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, blocks: int = 7) -> DataFrame:
    """(did, th, fp, root, component) of each row of docs (doc_id, text, ...); links: `distance` bits or fewer of 64.

    A node is a fingerprint, whatever its ids. Null texts have no words; texts without words have fingerprint zero and
    link to each other. Rows that repeat and equal texts get one root, which tells groups apart. component is the least
    id of the group, for reports: null ids don't count unless it has no other, and groups that share an id may share
    the name.
    """
    prints = materialize(fingerprints(docs, shingle), "prints")
    least = F.min(F.when(F.col("did") != NO_ID, F.col("did"))).alias("least")
    distinct = materialize(prints.groupBy("fp").agg(least), "distinct")
    found = components(materialize(links(distinct, distance, blocks), "links"))
    rooted = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.coalesce(F.min("least"), F.lit(NO_ID)).alias("component"))
    return prints.join(rooted.join(names, "root").select("fp", "root", "component"), "fp").select("did", "th", "fp", "root", "component")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Contract form: four-word shingles, links at four or fewer of 64 bits."""
    found = near_duplicates(docs)
    return found.select(back(F.col("did")).alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), back(F.col("component")).alias("component_id"))


def shingle_set(body: bytes, k: int) -> np.ndarray:
    """The sorted set of hashes of a text's k-word shingles."""
    return np.unique(digests(body, k))


def wide_print(signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(BLOCKS block keys, CHECK bits as longs) of a set of shingles; a key names its block too."""
    bits = majority(signs, (BLOCKS * WIDTH + CHECK) // 64)
    values = bits[CHECK:].reshape(BLOCKS, WIDTH) @ (1 << np.arange(WIDTH))
    return (np.arange(BLOCKS) << WIDTH | values).astype(np.int32), np.frombuffer(np.packbits(bits[:CHECK]).tobytes(), ">i8").astype(np.int64)


def lead(key: np.ndarray, node: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(leader, row) places of rows sorted by key: the first row of a run leads those within LIMIT of it, the first of the others leads next, and so on."""
    left, a, b = np.arange(len(key)), [], []
    while len(left):
        first = np.concatenate(([True], key[left[1:]] != key[left[:-1]]))
        leader = left[np.flatnonzero(first)[np.cumsum(first) - 1]]
        close = ~first & (np.bitwise_count(check[leader] ^ check[left]).sum(axis=1) <= LIMIT)
        a.append(leader[close])
        b.append(left[close])
        rest = ~first & ~close
        left = left[rest]
    return (np.concatenate(a), np.concatenate(b)) if a else (left, left)


def met(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of distinct wide prints (node, keys, check) that share a block and pass the check."""
    spark = distinct.sparkSession
    # a negative key carries a pair that a map task has found: (node, c0) is the pair, and any task may pass it on
    dealt = pa.schema([("key", pa.int32()), ("node", pa.int64()), ("c0", pa.int64()), ("c1", pa.int64())])
    edge = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def deal(batches):
        for b in batches:
            if not b.num_rows:
                continue
            node = column(b, "node")
            keys = b.column(b.schema.get_field_index("keys")).flatten().to_numpy().reshape(-1, BLOCKS)
            check = b.column(b.schema.get_field_index("check")).flatten().to_numpy().reshape(-1, CHECK // 64)
            for i in range(BLOCKS):
                # leaders differ from block to block, so that a row has more than one chance
                by = np.lexsort((spread(node.view(np.uint64) + np.uint64(i)), keys[:, i]))
                k, n, c = keys[by, i], node[by], check[by].view(np.uint64)
                same = np.concatenate(([False], k[1:] == k[:-1]))
                first = np.flatnonzero(~same)[np.cumsum(~same) - 1]
                close = same & (np.bitwise_count(c[first] ^ c).sum(axis=1) <= LIMIT)
                c = c.view(np.int64)
                yield record(dealt, k[~close], n[~close], c[~close, 0], c[~close, 1])
                if close.any():
                    a, z = n[first[close]], n[close]
                    yield record(dealt, -1 - (z & 0xFFFFF).astype(np.int32), a, z, np.zeros(len(z), np.int64))

    def verify(batches):
        held = None
        for b in (*batches, None):
            if b is not None:
                rows = [column(b, c) for c in ("key", "node", "c0", "c1")]
                done = rows[0] < 0
                if done.any():
                    yield record(edge, rows[1][done], rows[2][done])
                    rows = [x[~done] for x in rows]
                held = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
            if held is None or not len(held[0]):
                continue
            n = len(held[0]) if b is None else int(np.searchsorted(held[0], held[0][-1]))
            if n:
                key, node, c0, c1 = (x[:n] for x in held)
                by = np.lexsort((spread(node.view(np.uint64) + (key >> WIDTH).astype(np.uint64)), key))
                x, y = lead(key[by], node[by], np.stack((c0[by], c1[by]), axis=1).view(np.uint64))
                yield record(edge, node[by][x], node[by][y])
                held = [x[n:] for x in held]

    rows = distinct.select("node", "keys", "check").mapInArrow(deal, "key int, node long, c0 long, c1 long")
    pairs = rows.repartition(partitions(spark), "key").sortWithinPartitions("key").mapInArrow(verify, "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def compared(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have a Jaccard similarity of `least` or more; texts: (node, zip), one row a node.

    A node in very many pairs is dealt with its text to up to SALTS tasks.
    """
    edge = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        unzip, held, own = zstandard.ZstdDecompressor().decompress, None, None
        for batch in chunks(batches, 1 << 20):
            a, b, keep = column(batch, "a"), column(batch, "b"), []
            ours, others = batch.column(2), batch.column(3)
            for i, x in enumerate(a.tolist()):
                if x != held:
                    held, own = x, shingle_set(unzip(ours[i].as_py()), shingle)
                other = shingle_set(unzip(others[i].as_py()), shingle)
                common = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(common >= least * (len(own) + len(other) - common) - 1e-9)
            keep = np.array(keep, bool)
            yield record(edge, a[keep], b[keep])

    salted = pairs.withColumn("salt", F.pmod(F.hash("b"), F.lit(SALTS)))
    ours = salted.select("a", "salt").distinct().join(texts, F.col("a") == F.col("node")).select("a", "salt", F.col("zip").alias("ours"))
    both = salted.join(texts, F.col("b") == F.col("node")).select("a", "salt", "b", F.col("zip").alias("others"))
    rows = both.join(ours, ["a", "salt"]).select("a", "b", "ours", "others")
    return rows.sortWithinPartitions("a").mapInArrow(run, "a long, b long")


def text_keys(docs: DataFrame) -> DataFrame:
    """(did, th, body): as `keyed`, but with 64 bits of hash, as many null ids may stand on many texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64(text).alias("th"), text.cast("binary").alias("body"))


def frequent(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, counts), sorted: the commonest shingles of a bounded sample of distinct texts. Only speed depends on them."""
    out = pa.schema([("key", pa.int64())])

    def run(batches):
        for b in chunks(batches):
            yield record(out, np.concatenate([shingle_set(x, shingle) for x in b.column(2).to_pylist()]).view(np.int64))

    some = text_keys(docs).where(portion(F.xxhash64("th"), SAMPLED / max(docs.count(), 1))).dropDuplicates(["th"])
    counts = some.mapInArrow(run, "key long").groupBy("key").count().where(F.col("count") >= SEEN)
    rows = counts.orderBy(F.desc("count"), "key").limit(HEAVY).collect()
    known = np.array([r["key"] for r in rows], np.int64).view(np.uint64)
    by = np.argsort(known)
    return known[by], np.array([r["count"] for r in rows], np.int64)[by]


def prefix_length(n: np.ndarray, least: float) -> np.ndarray:
    """In any common order, two sets as alike as `least` share one of their first so many of n shingles."""
    return n - np.ceil(least * n - SLACK).astype(np.int64) + 1


def prefix(signs: np.ndarray, known: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """The shingles of a sorted set that are rarest by the sample, then least by hash; none where only an equal set is alike."""
    n = len(signs)
    if n < least * (n + 1) - SLACK:
        return signs[:0]
    if len(known):
        at = np.minimum(np.searchsorted(known, signs), len(known) - 1)
        signs = signs[np.argsort(np.where(known[at] == signs, counts[at], 0), kind="stable")]
    return signs[: prefix_length(np.int64(n), least)]


def run_bounds(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of sorted keys start, and their lengths."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return starts, np.diff(np.append(starts, len(keys)))


def unsettled(key: np.ndarray, root: np.ndarray) -> np.ndarray:
    """True of rows whose run has more than one root."""
    starts, sizes = run_bounds(key)
    return np.repeat(np.minimum.reduceat(root, starts) < np.maximum.reduceat(root, starts), sizes)


def crossing(key: np.ndarray, root: np.ndarray, n: np.ndarray, least: float):
    """Places (i, j) of all pairs of equal key and unlike roots whose sizes allow `least`; rows sorted by key and n."""
    starts, sizes = run_bounds(key)
    at, step = np.flatnonzero(np.repeat(sizes <= PAIRED, sizes)), 1
    while len(at):
        at = at[at + step < len(key)]
        # sizes ascend within a run: where one is too large, all that follow are
        at = at[(key[at] == key[at + step]) & (n[at] >= least * n[at + step] - SLACK)]
        hit = at[root[at] != root[at + step]]
        yield hit, hit + step
        step += 1
    for s, m in zip(starts[sizes > PAIRED].tolist(), sizes[sizes > PAIRED].tolist()):
        _, which, many = np.unique(root[s : s + m], return_inverse=True, return_counts=True)
        # rows of a root meet those of commoner ones, so the rows of a large group are never met with each other
        rank, own = np.argsort(np.argsort(many, kind="stable"))[which], n[s : s + m]
        for i in np.flatnonzero(rank < len(many) - 1).tolist():
            a, z = np.searchsorted(own, least * own[i] - SLACK), np.searchsorted(own, (own[i] + SLACK) / least, "right")
            hit = s + a + np.flatnonzero(rank[a:z] > rank[i])
            yield np.full(len(hit), s + i), hit


def parities(signs: np.ndarray) -> bytes:
    """A bit for each of 128, 256, ... places, at least two a shingle: whether an odd number of the set's shingles fall there.

    Two sets differ in as many shingles as their parities do in bits, or in more. The halves of the bits, xored, are the
    parities at half as many places.
    """
    places = 128 << (max(len(signs) - 1, 0) >> 6).bit_length()
    return np.packbits(np.bincount((signs & np.uint64(places - 1)).astype(np.int64), minlength=places).astype(np.uint8) & 1).tobytes()


def differences(bits: np.ndarray):
    """A function of rows (i, j): how many bits their parities (none: -1) differ in, the longer ones halved to the shorter."""
    sizes, levels = np.fromiter((len(x or b"") for x in bits), np.int64, len(bits)), {}

    def level(size: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each row stands, and the parities of `size` bytes beside those of twice as many, halved."""
        if size not in levels:
            own, twice = (np.flatnonzero(sizes == s) for s in (size, 2 * size))
            half = size // 8
            rows, wide = (np.frombuffer(b"".join(bits[x]), np.uint64).reshape(len(x), w) for x, w in ((own, half), (twice, 2 * half)))
            at = np.zeros(len(bits), np.int64)
            at[own], at[twice] = np.arange(len(own)), len(own) + np.arange(len(twice))
            levels[size] = at, np.concatenate((rows, wide[:, :half] ^ wide[:, half:]))
        return levels[size]

    def count(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        less = np.minimum(sizes[i], sizes[j])
        out = np.full(len(i), -1)
        for size in np.unique(less[less > 0]).tolist():
            (at, rows), step = level(size), max(1, HELD // size)
            # parities of more unlike lengths are not compared
            own = np.flatnonzero((less == size) & (np.maximum(sizes[i], sizes[j]) <= 2 * size))
            for k in range(0, len(own), step):
                x = own[k : k + step]
                out[x] = np.bitwise_count(rows[at[i[x]]] ^ rows[at[j[x]]]).sum(axis=1)
        return out

    return count


def by_run(rows: DataFrame, emit, schema: str, *more: str) -> DataFrame:
    """emit(key, node, root, n, *more) over whole runs of rows, sorted by key and n, where a run has more than one root."""
    names = ("key", "node", "root", "n", *more)

    def run(batches):
        held = None
        for b in (*batches, None):
            if b is not None:
                new = [column(b, c) for c in names]
                held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            if held is None or not len(held[0]):
                continue
            # the last run may go on in the next batch
            m = len(held[0]) if b is None else int(np.searchsorted(held[0], held[0][-1]))
            if m:
                open_ = unsettled(held[0][:m], held[2][:m])
                if open_.any():
                    yield from emit(*(x[:m][open_] for x in held))
                held = [x[m:] for x in held]

    return rows.select(*names).repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key", "n", "node").mapInArrow(run, schema)


def dealt_prefixes(distinct: DataFrame, found: DataFrame) -> DataFrame:
    """(key, node, root, n, many): a row for each shingle of a prefix of distinct (node, n, prefix) that nodes of unlike roots have; many: the nodes."""
    out = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("root", pa.int64()), ("n", pa.int32())])

    def deal(batches):
        for b in chunks(batches, 1 << 20):
            lists = b.column(b.schema.get_field_index("prefix"))
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            yield record(out, lists.flatten(), *(np.repeat(column(b, c), sizes) for c in ("node", "root", "n")))

    rooted = distinct.select("node", "n", "prefix").join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "n", "prefix")
    rows = rooted.mapInArrow(deal, "key long, node long, root long, n int")
    met_by = pa.schema([*out, ("many", pa.int32())])

    def emit(key, *columns):
        sizes = run_bounds(key)[1]
        yield record(met_by, key, *columns, np.repeat(sizes, sizes).astype(np.int32))

    return by_run(rows, emit, "key long, node long, root long, n int, many int")


def passing(key: np.ndarray, root: np.ndarray, n: np.ndarray, bits: np.ndarray, least: float):
    """(i, j, over): of `crossing` the places that parities, if there are any, allow to reach `least`; over: bits that differ, less those that may."""
    count, held, size = differences(bits), [], 0

    def kept(held):
        i, j = (np.concatenate(x) for x in zip(*held))
        apart = count(i, j)
        over = np.where(apart < 0, 0, apart - (1 - least) / (1 + least) * (n[i] + n[j]))
        keep = over <= SLACK
        return i[keep], j[keep], over[keep]

    for i, j in crossing(key, root, n, least):
        held.append((i, j))
        size += len(i)
        if size >= HELD:
            yield kept(held)
            held, size = [], 0
    if size:
        yield kept(held)


def ordered(node: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = node[i] < node[j]
    return np.where(first, i, j), np.where(first, j, i)


def likeliest(rows: DataFrame, least: float) -> DataFrame:
    """(a, b): for each two roots that meet in runs of (key, node, root, n, bits), of the pairs that `passing` takes one that differs least."""
    out = pa.schema([("ra", pa.int64()), ("rb", pa.int64()), ("over", pa.float64()), ("a", pa.int64()), ("b", pa.int64())])

    def best(ra, rb, over, a, b):
        by = np.lexsort((b, a, over, rb, ra))
        ra, rb, over, a, b = (x[by] for x in (ra, rb, over, a, b))
        first = np.concatenate((np.ones(min(1, len(ra)), bool), (ra[1:] != ra[:-1]) | (rb[1:] != rb[:-1])))
        return [x[first] for x in (ra, rb, over, a, b)]

    def emit(key, node, root, n, bits):
        found = None
        for i, j, over in passing(key, root, n.astype(np.int64), bits, least):
            i, j = ordered(root, i, j)
            new = [root[i], root[j], over, np.minimum(node[i], node[j]), np.maximum(node[i], node[j])]
            found = best(*(new if found is None else map(np.concatenate, zip(found, new))))
        if found is not None:
            yield record(out, *found)

    pairs = by_run(rows, emit, "ra long, rb long, over double, a long, b long", "bits")
    return pairs.groupBy("ra", "rb").agg(F.min(F.struct("over", "a", "b")).alias("s")).select("s.a", "s.b")


def candidates(rows: DataFrame, least: float) -> DataFrame:
    """(a, b, needed, count): the pairs of nodes that `passing` takes from runs of (key, node, root, n, bits).

    count tells the shingles that both prefixes have, but for pairs that parities show to be unlike: the others are taken
    from all runs that both are in. Common shingles beyond the prefix that ends first are at most the rest of its set, so
    a pair whose count is below `needed` cannot reach `least`.
    """
    out = pa.schema([(c, pa.int64()) for c in ("a", "b", "needed")])

    def emit(key, node, root, n, bits):
        n = n.astype(np.int64)
        rest = n - prefix_length(n, least)
        for i, j, _ in passing(key, root, n, bits, least):
            i, j = ordered(node, i, j)
            needed = np.ceil(least / (1 + least) * (n[i] + n[j]) - SLACK).astype(np.int64) - np.maximum(rest[i], rest[j])
            yield record(out, node[i], node[j], needed)

    return by_run(rows, emit, "a long, b long, needed long", "bits").groupBy("a", "b", "needed").count()


def zipped_texts(docs: DataFrame, names: DataFrame, pairs: DataFrame, keep) -> DataFrame:
    """(node, zip): texts of the nodes in pairs (a, b), one row a node; names: (node, did, th). keep writes tables.

    Texts are joined before they are pressed, so that Spark sees the table asked for, which it may broadcast if it is small.
    """
    zipped = pa.schema([("node", pa.int64()), ("zip", pa.binary())])

    def press(batches):
        zip_ = zstandard.ZstdCompressor(3).compress
        for b in chunks(batches):
            yield record(zipped, column(b, "node"), [zip_(x) for x in b.column(1).to_pylist()])

    asked = keep(names.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").select("node", "did", "th"), "asked")
    texts = text_keys(docs).join(asked, ["did", "th"]).select("node", "body").mapInArrow(press, "node long, zip binary")
    return keep(texts.dropDuplicates(["node"]), "texts")


def regrouped(found: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of `components` after more links (a, b)."""
    root = lambda side: found.toDF(side, f"{side}_root")
    tops = links.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    # a root has no row in found, so none has two
    top = components(materialize(tops, "tops"))
    moved = found.join(top.toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return materialize(moved.union(top), "found")


def alike(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """(did, th, node, root) of each row of docs (doc_id, text, ...): node names its set of shingles, root its group.

    Links are all pairs with an exact Jaccard similarity of `least` or more: prints find most groups, prefixes what is
    left between groups. Texts without words have the empty set and are one group.
    """
    own = pa.schema([("did", pa.int64()), ("th", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("keys", pa.list_(pa.int32())), ("check", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64())), ("bits", pa.binary())])
    known, counts = frequent(docs, shingle)

    def read(batches):
        for b in chunks(batches):
            sets = [shingle_set(x, shingle) for x in b.column(2).to_pylist()]
            nodes = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            firsts = [prefix(x, known, counts, least).view(np.int64) for x in sets]
            yield record(own, b.column(0), b.column(1), nodes, [len(x) for x in sets], *zip(*map(wide_print, sets)), firsts, list(map(parities, sets)))

    spark, folders = docs.sparkSession, []

    def keep(df: DataFrame, name: str) -> DataFrame:
        table, folder = written(df, name)
        folders.append(folder)
        return table

    prints, large = written(text_keys(docs).mapInArrow(read, "did long, th long, node long, n int, keys array<int>, check array<long>, prefix array<long>, bits binary"), "prints")
    rows = keep(prints.select("did", "th", "node"), "rows")
    distinct = prints.groupBy("node").agg(F.min(F.struct("did", "th", "n", "keys", "check", "prefix", "bits")).alias("s")).select("node", "s.*")
    distinct, at = written(distinct, "distinct")
    release(spark, large)
    names = keep(distinct.select("node", "did", "th"), "names")
    pairs = keep(met(distinct), "pairs")
    texts = zipped_texts(docs, names, pairs, keep)
    # one pair for each node first; of the others only those that would still join two groups
    first = keep(compared(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), texts, shingle, least), "first")
    found = components(first)
    root = lambda side: found.toDF(side, f"{side}_root")
    open_ = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
    open_ = open_.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")
    found = regrouped(found, compared(open_, texts, shingle, least))
    prefixes = keep(dealt_prefixes(distinct, found), "prefixes")
    crowded = prefixes.where(F.col("many") > FEW)
    bits = keep(distinct.select("node", "bits").join(crowded.select("node").distinct(), "node", "left_semi"), "bits")
    release(spark, at)
    # the likeliest pair of two groups first, so that the parts of a large one are not met pair by pair
    best = keep(likeliest(crowded.join(bits, "node"), least), "best")
    found = regrouped(found, compared(best, zipped_texts(docs, names, best, keep), shingle, least))
    prefixes = prefixes.drop("root").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    few = prefixes.where(F.col("many") <= FEW).withColumn("bits", F.lit(None).cast("binary"))
    rows_met = prefixes.where(F.col("many") > FEW).join(bits, "node").unionByName(few)
    left = keep(candidates(rows_met, least).where("count >= needed").select("a", "b"), "left")
    found = regrouped(found, compared(left, zipped_texts(docs, names, left, keep), shingle, least))
    groups = materialize(rows.join(found, "node", "left").select("did", "th", "node", F.coalesce("root", "node").alias("root")), "groups")
    for folder in folders:
        release(spark, folder)
    return groups


def deduplicated(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs, all columns, that stay: of each group of `alike` the one with the least (doc_id, text hash).

    Repeated rows of that id and text leave one. Null ids count as the least.
    """
    stay = alike(docs, **parameters).groupBy("root").agg(F.min(F.struct("did", "th")).alias("s")).select("s.did", "s.th")
    names = docs.columns
    did, th = free(names, "did", "th")
    own = docs.select(*names, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias(did), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias(th))
    kept = own.join(stay.toDF(did, th), [did, th], "left_semi")
    return kept.dropDuplicates([did, th]).select(*names)
