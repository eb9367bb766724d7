"""Sharding by histogram sort: exact bytes below candidate boundaries, probes refined to tolerance, one exchange.

Keys are (hash of the text, hash of the row), so equal texts are neighbours and stay in one shard unless their bytes
alone exceed the tolerance; then the second part of the key cuts among them, rows equal in id and text too. Each round counts bytes in 4,096 ranges
of the ranges that still hold a splitter, so the driver sees at most 4,096 sums a splitter, whatever the input.
Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import NO_ID, back, free, materialize

SHIFTS = (52, 40, 28, 16, 4, 0)
SALTS = 16


def row_keys(text: Column) -> list[Column]:
    """(h, g): hashes of the text and of the row's place in the scan, which tells rows apart that are equal in all."""
    return [F.xxhash64(text), F.xxhash64(text, F.monotonically_increasing_id())]


def sized(docs: DataFrame) -> DataFrame:
    """(did, size, text_crc32, h, g); null texts have no bytes, null ids are the least."""
    text, did = F.coalesce("text", F.lit("")), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    h, g = row_keys(text)
    return docs.select(did.alias("did"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), h.alias("h"), g.alias("g"))


def splitters(rows: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """Least keys (h, g) of shards 1, 2, ...; each has its share of bytes below it, to within tolerance of a shard."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    share = total / shards
    open_, found = {i: 0 for i in range(1, shards)}, {}  # splitter -> bytes below the range it lies in
    inside: dict[int, tuple] = {i: () for i in open_}  # splitter -> that range
    least = -(2**63)
    for part, shift in [(p, s) for p in ("h", "g") for s in SHIFTS]:
        if not open_ or not total:
            break
        ranges = sorted({inside[i] for i in open_})
        bucket = F.shiftright(part, shift)
        if part == "h":
            at = rows if ranges == [()] else rows.where(F.shiftright("h", before).isin([r[0] for r in ranges]))
            sums = at.groupBy(bucket.alias("b")).agg(F.sum("size").alias("n")).collect()
            by = {r: [] for r in ranges}
            for b, n in sums:
                by[() if ranges == [()] else (b >> (before - shift),)].append((b, n))
        else:
            at = rows.where(F.col("h").isin(sorted({r[0] for r in ranges})))
            if shift != SHIFTS[0]:
                at = at.where(F.shiftright("g", before).isin(sorted({r[1] for r in ranges})))
            sums = at.groupBy("h", bucket.alias("b")).agg(F.sum("size").alias("n")).collect()
            by = {r: [] for r in ranges}
            for h, b, n in sums:
                r = (h,) if shift == SHIFTS[0] else (h, b >> (before - shift))
                if r in by:
                    by[r].append((b, n))
        for i in list(open_):
            below, want = open_[i], i * share
            for b, n in sorted(by[inside[i]]):
                if below + n >= want:
                    break
                below += n
            edge = (lambda x: (x << shift, least)) if part == "h" else (lambda x: (inside[i][0], x << shift))  # noqa: B023
            low, high = want - below, below + n - want
            last = part == "g" and shift == 0
            if min(low, high) <= tolerance * share or last:
                upper = edge(b + 1) if (b + 1) << shift < 2**63 else None
                found[i] = edge(b) if low <= high or upper is None else upper
                del open_[i]
            else:
                open_[i], inside[i] = below, ((b,) if part == "h" else (inside[i][0], b))
        before = shift
    return [found[i] for i in sorted(found)]


def shard_of(cuts: list[tuple[int, int]], first: str = "h", second: str = "g") -> Column:
    passed = [((F.col(first) > h) | ((F.col(first) == h) & (F.col(second) >= g))).cast("int") for h, g in cuts]
    # a balanced sum: a chain of so many additions makes deep plans
    while len(passed) > 1:
        passed = [a + b for a, b in zip(passed[::2], passed[1::2])] + passed[len(passed) // 2 * 2 :]
    return passed[0] if passed else F.lit(0)


def sharded(docs: DataFrame, shards: int = 40, tolerance: float = 0.01) -> DataFrame:
    """(did, size, text_crc32, h, g, shard, slot) of each row of docs.

    Slots count a shard's rows from 0 without gaps, by ranges of keys: only rows of one range and salt meet in a task.
    """
    rows = materialize(sized(docs), "sized")
    at = rows.withColumn("shard", shard_of(splitters(rows, shards, tolerance))).withColumn("part", F.shiftright("h", 52) * SALTS + F.pmod("g", F.lit(SALTS)))
    # at most (4,096 + shards) * SALTS rows, whatever the input
    below = at.groupBy("shard", "part").agg(F.count("*").alias("n"))
    below = below.select("shard", "part", (F.sum("n").over(W.partitionBy("shard").orderBy("part")) - F.col("n")).alias("below"))
    ranked = at.withColumn("k", F.row_number().over(W.partitionBy("shard", "part").orderBy("h", "g", "did")))
    return ranked.join(F.broadcast(below), ["shard", "part"]).withColumn("slot", F.col("below") + F.col("k") - 1).drop("part", "k", "below")


def shard_report(docs: DataFrame) -> DataFrame:
    """Contract form of the `bytes` law for 40 shards."""
    return sharded(docs).select(back(F.col("did")).alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 40, tolerance: float = 0.01) -> None:
    """docs, all columns, exchanged once, a task for each shard, and written in a folder for each, files in key order."""
    h, g, shard = free(docs.columns, "h", "g", "shard")
    cuts = splitters(materialize(sized(docs), "sized"), shards, tolerance)
    keyed = docs.withColumns(dict(zip((h, g), row_keys(F.coalesce("text", F.lit(""))))))
    placed = keyed.withColumn(shard, shard_of(cuts, h, g).cast("int")).repartitionById(shards, F.col(shard))
    placed.sortWithinPartitions(h, g).drop(h, g).write.partitionBy(shard).parquet(path)
