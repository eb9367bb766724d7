"""Token ids in binary files: fixed-width bit packing with block offsets.

A file holds, in this order: MAGIC; blocks of BLOCK ids (the last may be shorter), each id in the least number of bits
that the vocabulary needs, most significant bit first; the directory: doc ids (int64), their numbers of ids (int64),
byte offsets of the blocks (uint64), all little-endian; and a trailer of six uint64: bits, BLOCK, numbers of documents,
ids and blocks, offset of the directory; MAGIC. Any range of ids is read from the blocks that hold it and unpacked in
numpy at once. Files hold ranges of doc_id in ascending order; a range goes on in a further file once one is full, so
that no file is longer than FILE bytes and one document's ids.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import NO_ID, back, chunks, column, partitions, record, shared_dir

MAGIC, BLOCK = b"QSPACK01", 1 << 16
TRAILER = 6 * 8 + len(MAGIC)
TABLE, LONG = 3 << 18, 200
FILE = 64 << 20
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in `bits` bits each, most significant first, to whole bytes."""
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    wide = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(wide[:, 32 - bits :].reshape(-1)).tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", n).astype("<u4")
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, 32 - bits :] = flat
    return np.packbits(wide, axis=1).view(">u4").reshape(-1).astype("<u4")


class Writer:
    def __init__(self, out, bits: int):
        self.out, self.bits, self.held, self.waiting = out, bits, [], 0
        self.docs, self.counts, self.offsets, self.place = [], [], [], len(MAGIC)
        out.write(MAGIC)

    def put(self, ids: np.ndarray) -> None:
        self.offsets.append(self.place)
        data = pack(ids, self.bits)
        self.out.write(data)
        self.place += len(data)

    def add(self, doc: int, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.counts.append(len(ids))
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK:
            rest = np.concatenate(self.held)
            while len(rest) >= BLOCK:
                self.put(rest[:BLOCK])
                rest = rest[BLOCK:]
            self.held, self.waiting = [rest], len(rest)

    def close(self) -> int:
        if self.waiting:
            self.put(np.concatenate(self.held))
        for x, kind in ((self.docs, "<i8"), (self.counts, "<i8"), (self.offsets, "<u8")):
            self.out.write(np.array(x, kind).tobytes())
        total = sum(self.counts)
        self.out.write(np.array([self.bits, BLOCK, len(self.docs), total, len(self.offsets), self.place], "<u8").tobytes() + MAGIC)
        return total


class Reader:
    """Random access to a file's ids; `data` is its bytes (or a memory map of them)."""

    def __init__(self, data):
        self.data = memoryview(data)
        if bytes(self.data[: len(MAGIC)]) != MAGIC or bytes(self.data[-len(MAGIC) :]) != MAGIC:
            raise ValueError("not a file of packed ids, or cut off")
        trailer = np.frombuffer(self.data[-TRAILER : -len(MAGIC)], "<u8").astype(np.int64).tolist()
        self.bits, self.block, n, self.total, blocks, place = trailer
        self.docs = np.frombuffer(self.data[place : place + 8 * n], "<i8")
        self.counts = np.frombuffer(self.data[place + 8 * n : place + 16 * n], "<i8")
        self.offsets = np.frombuffer(self.data[place + 16 * n : place + 16 * n + 8 * blocks], "<u8").astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts

    def ids(self, start: int, n: int) -> np.ndarray:
        """ids start .. start + n of the file."""
        parts = []
        while n > 0:
            k, at = divmod(start, self.block)
            most = min(self.block, self.total - k * self.block)
            size = -(-most * self.bits // 8)
            part = unpack(self.data[self.offsets[k] : self.offsets[k] + size], self.bits, most)[at : at + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.counts[i]))

    def documents(self):
        """(doc_id, ids) in turn, each block unpacked once."""
        held, k, first = np.zeros(0, "<u4"), 0, 0
        for doc, start, n in zip(self.docs.tolist(), self.starts.tolist(), self.counts.tolist()):
            more = [held[start - first :]]
            have = len(more[0])
            while have < n:
                part = self.ids(k * self.block, min(self.block, self.total - k * self.block))
                k += 1
                more.append(part)
                have += len(part)
            held, first = np.concatenate(more) if len(more) > 1 else more[0], start
            yield doc, held[:n]


class Words(dict):
    """chunk between ASCII white space, which the tokenizer drops -> its ids as little-endian uint32 bytes.

    A word of Latin letters is its own normal form once lower-cased and can't be split before the merges, so it goes
    to the model without the tokenizer's normalizer and pre-tokenizer; a full stop or comma after it is a word of its
    own. Everything else goes the whole way.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer, models

        self.model = Tokenizer.from_file(path)
        self.bits = max(1, (self.model.get_vocab_size() - 1).bit_length())
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])], [x["type"] for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.bare = None
        if kinds == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) and spec["model"]["type"] == "BPE" and not spec["model"]["ignore_merges"]:
            model = spec["model"]
            merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
            self.bare = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=model["end_of_word_suffix"], cache_capacity=0))
            # the printable stand-ins of bytes: those of Latin-1 that print stand for themselves, the others follow from 256
            plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
            self.shown = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}

    def learn(self, chunks: set[bytes]) -> None:
        """Encodes what isn't known yet, all at once."""
        if len(self) >= TABLE:
            self.clear()
        # plain lists: a tuple for each chunk would keep the garbage collector busy
        latin, bare, marked, others = [], [], [], []
        for c in chunks.difference(self):
            text = c.decode()
            if self.bare and LATIN.fullmatch(text):
                latin.append(c)
                bare.append(text)
            elif self.bare and c[-1:] in (b".", b",") and LATIN.fullmatch(text[:-1]):
                marked.append(c)
                if c[:-1] not in self and c[:-1] not in chunks:
                    latin.append(c[:-1])
                    bare.append(text[:-1])
            else:
                others.append(c)
        others += {c[-1:] for c in marked}.difference(self, chunks)
        # letters of ASCII stand for themselves
        shown = [x if x.isascii() else x.encode().decode("latin-1").translate(self.shown) for x in map(str.lower, bare)]
        for keys, found in ((latin, self.bare.encode_batch_fast(shown, add_special_tokens=False) if latin else []), (others, self.model.encode_batch_fast([c.decode() for c in others], add_special_tokens=False))):
            for c, e in zip(keys, found):
                self[c] = array("I", e.ids).tobytes()
        for c in marked:
            self[c] = self[c[:-1]] + self[c[-1:]]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of whole texts. Chunks that are too long to be kept go after the batch."""
        # lower case first makes fewer distinct chunks; with a special token's start in the text it could make one
        split = [(t if b"<|" in t or not self.bare else t.lower()).split() for t in texts]
        every = set().union(*split)
        self.learn(every)
        out = [b"".join([self[x] for x in s]) for s in split]
        for x in [x for x in every if len(x) > LONG]:
            self.pop(x, None)
            self.pop(x[:-1], None)
        return out


@lru_cache(2)
def word_table(path: str) -> Words:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Words(path)


def ranged(docs: DataFrame, files: int) -> DataFrame:
    """(did, th, body) in ranges of (doc_id, text hash); rows equal in both may lie in several ranges, so no id is too frequent for a task."""
    text = F.coalesce(F.col("text"), F.lit(""))
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did")
    rows = docs.select(did, F.xxhash64(text).alias("th"), text.cast("binary").alias("body"), F.xxhash64(F.monotonically_increasing_id()).alias("tie"))
    return rows.repartitionByRange(files, "did", "th", "tie").sortWithinPartitions("did", "th").select("did", "th", "body")


def write_packed(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, ranges: int | None = None, most: int = FILE) -> list[tuple[int, str, int, int]]:
    """Writes the ids of docs to `folder`; (number, path, documents, ids) of each file, in order.

    Null texts are empty (the end id only); null ids sort first. Rows of one id go by a hash of their texts.
    """
    from pyarrow import fs

    schema = pa.schema([("file", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])

    def write(batches):
        table, end = word_table(tokenizer), np.array([end_id], "<u4").tobytes()
        store, top = fs.FileSystem.from_uri(folder)
        at, writer, out, own = TaskContext.get().partitionId() << 20, None, None, None

        def closed():
            total, path = writer.close(), f"{top}/ids-{at:016d}.qspack"
            out.close()
            store.move(own, path)  # whole or not at all, whichever attempt ends first
            return record(schema, [at], [path], [len(writer.docs)], [total])

        for b in chunks(batches):
            for did, ids in zip(b.column(0).to_pylist(), table.encode(b.column(2).to_pylist())):
                if writer and writer.place >= most:
                    yield closed()
                    at, writer = at + 1, None
                if not writer:
                    store.create_dir(top, recursive=True)
                    own = f"{top}/.{uuid.uuid4().hex}"
                    out = store.open_output_stream(own)
                    writer = Writer(out, table.bits)
                writer.add(did, np.frombuffer(ids + end, "<u4"))
        if writer:
            yield closed()

    ordered = ranged(docs, ranges or partitions(docs.sparkSession))
    done = ordered.mapInArrow(write, "file long, path string, docs long, ids long").collect()  # a row a file
    return sorted((r.file, r.path, r.docs, r.ids) for r in done)


def read_packed(spark, folder: str, found: list[tuple[int, str, int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files of write_packed."""
    starts, total = {}, 0
    for number, _, _, n in found:
        starts[number], total = total, total + n
    schema = pa.schema([("did", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches):
        for b in chunks(batches):
            for path, data in zip(*(b.column(i).to_pylist() for i in range(2))):
                first, file = starts[int(path[-23:-7])], Reader(data)
                crcs = np.array([zlib.crc32(ids.tobytes()) for _, ids in file.documents()], np.int64)
                yield record(schema, file.docs, file.starts + first, file.counts, crcs)

    kind = "did long, start long, n_tokens long, ids_crc32 long"
    if not found:
        return spark.createDataFrame([], kind).withColumnRenamed("did", "doc_id")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.qspack").load(folder).select("path", "content")
    return files.mapInArrow(read, kind).select(back(F.col("did")).alias("doc_id"), "start", "n_tokens", "ids_crc32")


def packed_report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Contract form: written to the shared folder, then everything from the files."""
    folder = f"{shared_dir(docs.sparkSession)}/ids"
    return read_packed(docs.sparkSession, folder, write_packed(docs, tokenizer, folder))
