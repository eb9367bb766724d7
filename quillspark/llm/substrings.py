"""Substring dedup by level-wise doubling: windows repeated at one length alone are extended to twice that length.

Level one looks at windows of half the final length. Of each final window only one of these inner windows counts, the
one of least hash (the leftmost of equals): equal windows choose alike, so a repeated final window has a repeated
inner one, its anchor. All final windows of one anchor lie in a span of less than twice their length. An anchor seen
once ends there. Among occurrences of one anchor, those whose whole spans are equal are repeated at every length;
of each such set one occurrence stands for it. Only anchors that occur within differing spans go on to level two,
where their windows of the final length are compared.

Spans are equal if two 64-bit hashes of unlike makings are, and so are windows of the final length; an anchor's one
hash only proposes. Both levels deal rows by hash and read sorted runs in constant memory. What repeats within a map task's batch is
settled there, and one row of it travels under that hash; so a passage that a third of all documents share sends a
row a batch, not a row a document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import NO_ID, chunks, column, free, partitions, record

WINDOW = 35
#: What is known of an anchor: all its windows are repeated; so, and it stands for its span; only its windows will tell.
FULL, STANDS, OPEN = 0, 1, 2
MULTIPLY = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
SECOND = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
ROWS = pa.schema([("key", pa.int64()), ("span", pa.int64()), ("did", pa.int64()), ("at", pa.int64()), ("known", pa.int8())])
ROWS_SQL = "key long, span long, did long, at long, known byte"


def mix(a: np.ndarray, b: np.ndarray, by: list = MULTIPLY) -> np.ndarray:
    y = b * by[1]
    x = ((a * by[0]) ^ ((y << np.uint64(31)) | (y >> np.uint64(33)))) * by[2]
    return x ^ (x >> np.uint64(29))


def hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


def windows(h: np.ndarray, length: int, by: list = MULTIPLY) -> np.ndarray:
    """Hash of each window of `length` words, by doubling."""
    size = 1
    while size < length:
        step = min(size, length - size)
        h = mix(h[:-step], h[step:], by) if len(h) > step else h[:0]
        size += step
    return h


def leftmost_least(x: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` places the place of the least value, the leftmost of equals."""
    best, size = np.arange(len(x)), 1
    while size < width:
        step = min(size, width - size)
        a, b = best[:-step], best[step:]
        best = np.where(x[a] <= x[b], a, b)
        size += step
    return best


def anchored(words: list[bytes], window: int) -> tuple[np.ndarray, ...] | None:
    """(anchor hash, anchor, its first and last window, hash of their span) and the window hashes; None if too short."""
    if len(words) < window:
        return None
    half = (window + 1) // 2
    h = hashes(words)
    inner, final = windows(h, half), windows(h, window)
    of = leftmost_least(inner, window - half + 1)
    first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    last = np.append(first[1:], len(of)) - 1
    at = of[first]
    shape = ((at - first) * window + (last - at + window)).astype(np.uint64)
    return inner[at], at, first, last, mix(mix(final[first], final[last]), shape), final


def rows_of(docs: DataFrame) -> DataFrame:
    """(did, th, body, doc_id): a 64-bit and a 32-bit hash name a row by id and text, as one id, or none, may stand on many texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    did, th = names_of(text)
    return docs.select(did.alias("did"), th.alias("th"), text.cast("binary").alias("body"), F.col("doc_id").cast("long").alias("doc_id"))


def names_of(text: Column) -> list[Column]:
    return [F.xxhash64(F.col("doc_id").cast("long"), text), F.hash(text)]


def settle(key, span, did, at, known):
    """Map-side: of rows with one (key, span) the first travels under the key as known, the rest under themselves."""
    order = np.lexsort((span, key))
    key, span, did, at, known = (x[order] for x in (key, span, did, at, known))
    same = np.concatenate(([False], (key[1:] == key[:-1]) & (span[1:] == span[:-1])))
    known = known.copy()
    known[np.append(same[1:], False)] = 1
    known[same] = 2
    key = np.where(same, (did.view(np.uint64) * MULTIPLY[0] + at.view(np.uint64)).view(np.int64), key)
    return record(ROWS, key, span, did, at, known)


def packed(th: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (th.astype(np.int64) << 32) | at.astype(np.int64)


def anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    def run(batches):
        for b in chunks(batches, 16 << 20):
            found = [[] for _ in range(4)]
            for did, th, body in zip(column(b, "did").tolist(), column(b, "th").tolist(), b.column(2).to_pylist()):
                if (x := anchored(body.split(), window)) is not None:
                    at = x[1]
                    for to, part in zip(found, (x[0], x[4], np.full(len(at), did), packed(np.full(len(at), th), at))):
                        to.append(part)
            if found[0]:
                key, span, did, at = map(np.concatenate, found)
                yield settle(key.view(np.int64), span.view(np.int64), did, at, np.zeros(len(key), np.int8))

    return rows_of(docs).mapInArrow(run, ROWS_SQL)


def sorted_runs(rows: DataFrame) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key", "span")


def judged_anchors(rows: DataFrame) -> DataFrame:
    """(did, th, mark): each anchor that occurs twice or more, mark being its place * 4 and what is known of it."""
    out = pa.schema([("did", pa.int64()), ("th", pa.int32()), ("mark", pa.int64())])

    def run(batches):
        # Of the last set of equal spans: its key, span, first row, whether it has a second row, whether its key has another set before.
        held = None

        def emit(did, at, state):
            at = np.asarray(at, np.int64)
            return record(out, np.asarray(did, np.int64), (at >> 32).astype(np.int32), ((at & 0xFFFFFFFF) << 2) | np.asarray(state, np.int64))

        def close(other_after: bool):
            key, span, did, at, twice, before = held
            if twice or before or other_after:
                state = (STANDS if before or other_after else FULL) if twice else OPEN
                return emit([did], [at], [state])
            return None

        for b in batches:
            if not b.num_rows:
                continue
            key, span, did, at, known = (column(b, c) for c in ("key", "span", "did", "at", "known"))
            if (done := known == 2).any():
                yield emit(did[done], at[done], np.full(int(done.sum()), FULL))
                key, span, did, at, known = (x[~done] for x in (key, span, did, at, known))
                if not len(key):
                    continue
            new_key = np.concatenate(([True], key[1:] != key[:-1]))
            new = new_key | np.concatenate(([True], span[1:] != span[:-1]))
            if held and held[0] == key[0]:
                new_key[0] = False
                if held[1] == span[0]:
                    new[0] = False
            starts = np.flatnonzero(new)
            lead = int(starts[0]) if len(starts) else len(key)
            if lead:
                yield emit(did[:lead], at[:lead], np.full(lead, FULL))
                held = (*held[:4], True, held[5])
            if not len(starts):
                continue
            if held and (x := close(not new_key[starts[0]])):
                yield x
            sizes = np.diff(np.append(starts, len(key)))
            before = ~new_key[starts]
            after = np.append(before[1:], False)
            twice = (sizes > 1) | (known[starts] == 1)
            rest = ~new
            rest[:lead] = False
            if rest.any():
                yield emit(did[rest], at[rest], np.full(int(rest.sum()), FULL))
            s, twice_, before_, after_ = starts[:-1], twice[:-1], before[:-1], after[:-1]
            state = np.where(twice_, np.where(before_ | after_, STANDS, FULL), OPEN)
            keep = twice_ | before_ | after_
            if keep.any():
                yield emit(did[s[keep]], at[s[keep]], state[keep])
            i = int(starts[-1])
            held = (key[i], span[i], did[i], at[i], bool(twice[-1]), bool(before[-1]))
        if held and (x := close(False)):
            yield x

    return sorted_runs(rows).mapInArrow(run, "did long, th int, mark long")


def repeated_keys(rows: DataFrame) -> DataFrame:
    """(did, th, place) of rows whose key has another row, or which were known to be repeated."""
    out = pa.schema([("did", pa.int64()), ("th", pa.int32()), ("place", pa.int64())])

    def run(batches):
        held = None
        for b in (*batches, None):
            if b is None:
                parts = held
            else:
                rows = [column(b, c) for c in ("key", "span", "did", "at", "known")]
                parts = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
            if parts is None or not len(parts[0]):
                continue
            key, span, did, at, known = parts
            same = (key[1:] == key[:-1]) & (span[1:] == span[:-1])
            twice = np.concatenate(([False], same)) | np.append(same, False) | (known > 0)
            n = len(key) if b is None else len(key) - 1
            hit = np.flatnonzero(twice[:n])
            hit = hit[did[hit] != NO_ROW]
            yield record(out, did[hit], (at[hit] >> 32).astype(np.int32), at[hit] & 0xFFFFFFFF)
            if b is not None:  # the last row waits for the next one; that it has met its like is kept
                held = [x[n:] for x in parts]
                held[4] = np.maximum(held[4], twice[n:].astype(held[4].dtype))

    return sorted_runs(rows).mapInArrow(run, "did long, th int, place long")


#: Stands for a window whose document needs no answer.
NO_ROW = NO_ID + 1


def small(docs: DataFrame) -> DataFrame:
    """(did, th, zip, doc_id): texts compressed for the exchange."""
    out = pa.schema([("did", pa.int64()), ("th", pa.int32()), ("zip", pa.binary()), ("doc_id", pa.int64())])

    def run(batches):
        press = zstandard.ZstdCompressor(3).compress
        for b in chunks(batches):
            yield record(out, b.column(0), b.column(1), [press(x) for x in b.column(2).to_pylist()], b.column(3))

    return rows_of(docs).mapInArrow(run, "did long, th int, zip binary, doc_id long")


def final_rows(opened: DataFrame, window: int) -> DataFrame:
    """Window rows of the anchors in (did, th, zip, marks) that are open or stand for a span."""

    def run(batches):
        unzip = zstandard.ZstdDecompressor().decompress
        for b in chunks(batches):
            found = [[] for _ in range(4)]
            for did, th, body, marks in zip(*(b.column(i).to_pylist() for i in range(4))):
                marks = np.unique(np.array(marks, np.int64))
                state = marks & 3
                words = unzip(body).split()
                x, second = anchored(words, window), windows(hashes(words), window, SECOND)
                where = np.searchsorted(x[1], marks[state != FULL] >> 2)
                for i, s in zip(where.tolist(), state[state != FULL].tolist()):
                    places = np.arange(x[2][i], x[3][i] + 1)
                    for to, part in zip(found, (x[5][places], second[places], np.full(len(places), NO_ROW if s == STANDS else did), packed(np.full(len(places), th), places))):
                        to.append(part)
            if found[0]:
                key, span, did, at = map(np.concatenate, found)
                # two rows of one text's place can't meet here: marks are distinct
                yield settle(key.view(np.int64), span.view(np.int64), did, at, np.zeros(len(key), np.int8))

    return opened.mapInArrow(run, ROWS_SQL)


def removals(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(did, th, zip, marks, places, doc_id): each row with what is known of its anchors and single windows."""
    marks = judged_anchors(anchor_rows(docs, window)).groupBy("did", "th").agg(F.collect_set("mark").alias("marks"))
    texts = small(docs)
    opened = texts.join(marks.where(F.exists("marks", lambda m: m.bitwiseAND(3) != FULL)), ["did", "th"]).select("did", "th", "zip", "marks")
    # rows that repeat wholly are settled at level one: every anchor of theirs occurs twice in one span
    places = repeated_keys(final_rows(opened, window)).groupBy("did", "th").agg(F.collect_set("place").alias("places"))
    return texts.join(marks, ["did", "th"], "left").join(places, ["did", "th"], "left").select("did", "th", "zip", "marks", "places", "doc_id")


def keep_mask(words: list[bytes], marks, places, window: int) -> np.ndarray:
    gone = np.zeros(len(words) + 1, np.int64)
    x = anchored(words, window) if marks else None
    if x is not None:
        marks = np.array(marks, np.int64)
        i = np.searchsorted(x[1], marks[(marks & 3) != OPEN] >> 2)
        np.add.at(gone, x[2][i], 1)
        np.add.at(gone, x[3][i] + window, -1)
    if places:
        p = np.array(places, np.int64)
        np.add.at(gone, p, 1)
        np.add.at(gone, p + window, -1)
    return np.cumsum(gone[:-1]) == 0


def removed_report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Contract form. Null and empty texts have no words; a row that repeats (or any equal text) loses all its windows."""
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        unzip = zstandard.ZstdDecompressor().decompress
        for b in chunks(batches):
            rows = []
            for body, marks, places, doc in zip(*(b.column(i).to_pylist() for i in range(2, 6))):
                words = unzip(body).split()
                kept = words
                if marks or places:
                    kept = [w for w, k in zip(words, keep_mask(words, marks, places, window).tolist()) if k]
                rows.append((doc, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield record(out, *zip(*rows))

    return removals(docs, window).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs, all columns, with the repeated words cut out of `text` (white space before a kept word stays as it is).

    Every occurrence goes, the first too. n_chars, if there, follows the new text. Null texts stay null; texts that
    lose all words become empty.
    """
    spans = removals(docs, window).where("marks is not null or places is not null")
    out = pa.schema([("did", pa.int64()), ("th", pa.int32()), ("cut", pa.string())])

    def run(batches):
        import re

        unzip = zstandard.ZstdDecompressor().decompress
        for b in chunks(batches):
            rows = []
            for did, th, body, marks, places in zip(*(b.column(i).to_pylist() for i in range(5))):
                text = unzip(body)
                found = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
                mask = keep_mask([text[a:z] for a, z in found], marks, places, window).tolist()
                if all(mask):
                    continue
                parts, end = [], 0
                for (a, z), kept in zip(found, mask):
                    if kept:
                        parts.append(text[end:z])
                    end = z
                rows.append((did, th, b"".join(parts).strip().decode()))
            if rows:
                yield record(out, *zip(*rows))

    names = docs.columns
    did, th, cut = free(names, "did", "th", "cut")
    cuts = spans.mapInArrow(run, "did long, th int, cut string").dropDuplicates(["did", "th"]).toDF(did, th, cut)
    own = docs.withColumns(dict(zip((did, th), names_of(F.coalesce(F.col("text"), F.lit(""))))))
    joined = own.join(cuts, [did, th], "left")
    made = {"text": F.coalesce(F.col(cut), F.col("text"))}
    if "n_chars" in names:
        made["n_chars"] = F.when(F.col(cut).isNull(), F.col("n_chars")).otherwise(F.length(cut).cast(docs.schema["n_chars"].dataType))
    return joined.select(*[made[c].alias(c) if c in made else F.col(c) for c in names])
