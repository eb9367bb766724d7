"""Document fingerprints by SpotSigs: chains of content words that follow common-word anchors.

Wherever one of ANCHORS occurs, it and the CHAIN content words next after it make a signature. A fingerprint is the
sorted set of a text's signatures (32 bits each, in hexadecimal). A text whose words make no chain has one signature,
of all its words; a text without words has none. Likeness is Jaccard's; two empty fingerprints are alike.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from functools import lru_cache
from heapq import merge
from itertools import takewhile
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import NO_ID, back, chunks, column, components, keyed, materialize, partitions, portion, record

CHAIN, KEPT_WORDS, LONG, SAMPLED = 2, 1 << 18, 100, 100
#: The commonest words of English, French, German and Spanish.
ANCHORS = frozenset(
    "a an and are as at be by for from had has have he in is it not of on or that the this to was were which with "
    "au aux ce dans de des du elle en est et il la le les par pas pour que qui se sur un une "
    "als auf aus das dem den der die ein eine im ist mit nicht sich sie und von zu "
    "al con del el ella las lo los mas no para por se su y".split()
)
C1, C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Marked(dict):
    """word -> its hash, with the lowest bit set if it is an anchor."""

    def __missing__(self, word: str) -> int:
        bare = "".join(c for c in word if c.isalnum()).lower() or word
        value = xxhash.xxh64_intdigest(bare) & ~1 | (bare in ANCHORS)
        if len(word) <= LONG:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = value
        return value


@lru_cache(1)
def marked() -> Marked:
    return Marked()


def signatures(text: str, chain: int = CHAIN) -> np.ndarray:
    """The sorted set of a text's spot signatures."""
    words = text.split()
    h = np.fromiter(map(marked().__getitem__, words), np.uint64, len(words))
    anchor = (h & np.uint64(1)).astype(bool)
    spots, content = np.flatnonzero(anchor), np.flatnonzero(~anchor)
    first = np.searchsorted(content, spots)
    fits = first + chain <= len(content)
    spots, first = spots[fits], first[fits]
    if not len(spots):
        return np.array([xxhash.xxh32_intdigest(" ".join(words))] if words else [], np.uint32)
    mixed = h[spots]
    for k in range(chain):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * C1 + h[content[first + k]] * C2
    return np.unique(((mixed ^ (mixed >> np.uint64(32))) * C1 >> np.uint64(32)).astype(np.uint32))


def shown(signs: np.ndarray) -> str:
    return signs.astype(">u4").tobytes().hex()


def parsed(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard's likeness of two fingerprints; 0 at once where their lengths alone keep it below `least`."""
    if not len(a) and not len(b):
        return 1.0
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def cut_points(rows: DataFrame, parts: int) -> list[tuple[int, int, int]]:
    """Bounds of ranges of (did, th, tie), from about SAMPLED rows a range, as Spark's own range exchange takes them."""
    n = rows.count()
    if parts < 2 or not n:
        return []
    some = rows.where(portion(F.xxhash64("tie"), parts * SAMPLED / n))
    found = sorted(tuple(r) for r in some.select("did", "th", "tie").limit(4 * parts * SAMPLED).collect())
    return [found[i * len(found) // parts] for i in range(1, parts)] if found else []


def neighboured(docs: DataFrame, shown_columns: str, emit) -> DataFrame:
    """emit(did, text, next text) over rows in descending order of doc_id, the first after the last.

    Rows go once to ranges of ids, compressed; the last row of a range also goes to the range before it. Ties of an id go
    by a hash of the text, then by a hash of their place in the scan, so rows of one id may lie in several ranges; null
    ids come last.
    """
    spark = docs.sparkSession
    tied = docs.select("doc_id", "text", F.xxhash64(F.monotonically_increasing_id()).alias("tie"))
    rows = keyed(tied, "tie")
    cuts = cut_points(rows.select("did", "th", "tie"), partitions(spark))
    place = lambda b: [bisect_right(cuts, k) for k in zip(*(column(b, c).tolist() for c in ("did", "th", "tie")))]
    tops = rows.select("did", "th", "tie").mapInArrow(lambda it: (record(TOP, place(b), *b.columns) for b in it), "part int, did long, th int, tie long")
    # a row a range
    top = sorted((r.part, *r.m) for r in tops.groupBy("part").agg(F.max(F.struct("did", "th", "tie")).alias("m")).collect())
    to = {tuple(k): top[(i + 1) % len(top)][0] for i, (_, *k) in enumerate(top)}

    def send(batches):
        press = zstandard.ZstdCompressor(3).compress
        for b in chunks(batches):
            keys, parts, zips = list(zip(*(column(b, c).tolist() for c in ("did", "th", "tie")))), place(b), [press(x) for x in b.column(2).to_pylist()]
            yield record(SENT, parts, np.zeros(len(keys), np.int8), *map(list, zip(*keys)), zips)
            more = [i for i, k in enumerate(keys) if k in to]
            if more:
                yield record(SENT, [to[keys[i]] for i in more], [1] * len(more), *map(list, zip(*[keys[i] for i in more])), [zips[i] for i in more])

    def walk(batches):
        unzip, held, at = zstandard.ZstdDecompressor().decompress, None, None
        for b in chunks(batches, 1 << 20):
            out = []
            for part, after, did, body in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 5))):
                if part != at:
                    held, at = None, part
                if after and held is None:
                    continue
                text = unzip(body).decode()
                if held is not None:
                    out.append((held, text))
                held = None if after else (did, text)
            if out:
                yield from emit(out)

    sent = rows.mapInArrow(send, "part int, after byte, did long, th int, tie long, zip binary")
    ordered = sent.repartition(partitions(spark), "part").sortWithinPartitions("part", "after", F.desc("did"), F.desc("th"), F.desc("tie"))
    return ordered.mapInArrow(walk, shown_columns)


TOP = pa.schema([("part", pa.int32()), ("did", pa.int64()), ("th", pa.int32()), ("tie", pa.int64())])
SENT = pa.schema([("part", pa.int32()), ("after", pa.int8()), ("did", pa.int64()), ("th", pa.int32()), ("tie", pa.int64()), ("zip", pa.binary())])
REPORT = "did long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
REPORT_ARROW = pa.schema([("did", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def edited(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def reported(pairs):
    rows, last = [], (None, None)
    for (did, text), following in pairs:
        own = last[1] if last[0] is text else signatures(text)
        after = signatures(following)
        last = following, after
        new = edited(text, following)
        other = signatures(new)
        rows.append((did, len(text), hashlib.sha256(new.encode()).hexdigest(), shown(own), shown(other), likeness(own, other), likeness(own, after)))
    yield record(REPORT_ARROW, *zip(*rows))


def spots_report(docs: DataFrame) -> DataFrame:
    """Contract form; null texts are empty. A lone document is its own next."""
    return neighboured(docs, REPORT, reported).withColumn("doc_id", back(F.col("did"))).drop("did").select("doc_id", *[c.split()[0] for c in REPORT.split(", ")[1:]])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(did, th, fingerprint) of each row."""
    schema = pa.schema([("did", pa.int64()), ("th", pa.int32()), ("fingerprint", pa.string())])

    def run(batches):
        for b in chunks(batches):
            yield record(schema, b.column(0), b.column(1), [shown(signatures(x.decode())) for x in b.column(2).to_pylist()])

    return keyed(docs).mapInArrow(run, "did long, th int, fingerprint string")


def length_class(n: int, least: float) -> int:
    """Sets as alike as `least` lie in one class of lengths or in neighbours."""
    return int(np.floor(np.log(max(n, 1)) / np.log(1 / least) + 1e-9))


def near_duplicates(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(did, th, root, component): documents whose fingerprints are as alike as `least`, joined into classes.

    A node is a fingerprint, by its 64-bit hash, whatever its ids; root tells classes apart. component is the least id of
    the class, for reports: null ids don't count unless it has no other, and classes that share an id may share the name.
    Texts without words have the empty fingerprint and are one class. Equal fingerprints are one row. Distinct ones are dealt by class of length (own and next) and by each signature of
    their prefix: the least signatures by hash, so many that two alike sets must share one. Runs are compared in order
    of length: each row with each class that links have made of the rows before it, only as far back as lengths allow and
    only until one member is alike, so a large class of alike sets costs about one comparison a row.
    """
    prints = materialize(fingerprints(docs), "spots")
    ids = F.min(F.when(F.col("did") != NO_ID, F.col("did"))).alias("least")
    distinct = materialize(prints.groupBy("fingerprint").agg(ids).withColumn("node", F.xxhash64("fingerprint")), "distinct")
    dealt = pa.schema([("key", pa.int64()), ("n", pa.int32()), ("node", pa.int64()), ("fingerprint", pa.string())])
    edge = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def deal(batches):
        for b in chunks(batches, 1 << 18):
            rows = []
            for f, node in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                signs = parsed(f)
                order = signs[np.argsort(signs.astype(np.uint64) * C1)]
                for c in (0, 1):
                    for s in order[: len(signs) - int(np.ceil(least * len(signs))) + 1].tolist():
                        rows.append((s << 16 | length_class(len(signs), least) + c, len(signs), node, f))
            if rows:
                yield record(dealt, *zip(*rows))

    def compare(run):
        classes: list[list[tuple[int, int, np.ndarray]]] = []  # rows so far, by what the links have joined
        for _, n, node, fingerprint in run:
            own, joined, others = parsed(fingerprint), [], []
            for members in classes:
                # the rows come by length: from the last member back, until lengths alone rule a link out
                near = takewhile(lambda m: m[0] >= least * n, reversed(members))
                link = next((m[1] for m in near if likeness(m[2], own, least) >= least), None)
                if link is None:
                    others += [members] if members[-1][0] >= least * n else []
                else:
                    joined.append(members)
                    yield link, node
            of = joined[0] if len(joined) == 1 else list(merge(*joined, key=itemgetter(0)))
            of.append((n, node, own))
            classes = [*others, of]

    def verify(batches):
        held = []
        for b in (*batches, None):
            out = []
            for row in zip(*(b.column(i).to_pylist() for i in range(4))) if b is not None else [(None,)]:
                if held and held[0][0] != row[0]:
                    out += compare(held)
                    held = []
                held.append(row)
            if out:
                yield record(edge, *zip(*out))

    rows = distinct.select("fingerprint", "node").mapInArrow(deal, "key long, n int, node long, fingerprint string")
    links = rows.repartition(partitions(docs.sparkSession), "key").sortWithinPartitions("key", "n", "node").mapInArrow(verify, "a long, b long")
    found = components(materialize(links, "links"))
    rooted = distinct.join(found, "node", "left").select("fingerprint", "least", F.coalesce("root", "node").alias("root"))
    names = rooted.groupBy("root").agg(F.coalesce(F.min("least"), F.lit(NO_ID)).alias("component"))
    return prints.join(rooted.join(names, "root").select("fingerprint", "root", "component"), "fingerprint").select("did", "th", "root", "component")
