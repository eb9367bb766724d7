"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the model has a marker after another character, so no merge crosses the start of a marked word, and a text
can be cut there. The corpus is read twice, in parts of PART bytes of a scan's task. The first reading sends the distinct
marked words of each part to the table, where each word is segmented once, whatever number of parts it occurs in, and
goes back to the parts that asked for it: a file for each part in the shared folder. The second reading joins ids back by
position from its part's file. So no text is shuffled, and a task holds the words of one part.

A word that only one part has doesn't travel back: that part segments it. Chunks over LONG characters don't enter the
table, nor do those that decode to something else. What a part's file lacks (such a word, or any of a scan that was dealt
differently the second time) is segmented where it stands, so results don't depend on how a scan is dealt. Models for
which cutting isn't safe are run on whole texts.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import back, chunks, keyed, partitions, record, shared_dir

PART, LONG, BATCH, HELD = 64 << 20, 200, 8192, 1 << 18
MARK = "▁"
MARKED = re.compile(" *[^ ]+| +$")
SOME = pa.schema([("part", pa.int64()), ("rows", pa.binary())])


class Pieces:
    """A model, and how a text is cut into chunks: marked words without their first marker."""

    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        self.whole = not self.separable()
        self.alone = self.model.piece_to_id(MARK)

    def separable(self) -> bool:
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto.FromString(self.model.serialized_model_proto())
        plain = spec.normalizer_spec
        same = not plain.precompiled_charsmap and plain.add_dummy_prefix and not plain.remove_extra_whitespaces and plain.escape_whitespaces
        crossing = any(MARK in p.piece.lstrip(MARK) for p in spec.pieces)
        return same and not crossing and not spec.trainer_spec.treat_whitespace_as_suffix and all(p.type != 4 for p in spec.pieces)

    def cut(self, text: str) -> list[str]:
        if not text or self.whole:
            return [text] if text else []
        text = text.replace(MARK, " ")
        parts = text.split(" ")
        return [x[1:] for x in MARKED.findall(" " + text)] if "" in parts else parts

    def segment(self, words: list[str]) -> list[tuple[str, str]]:
        """(decimal ids joined by commas, decoded text) of each chunk."""
        ids = self.model.encode(words, num_threads=1)
        if not self.whole:
            ids = [i if w else [self.alone] for w, i in zip(words, ids)]
        return [(",".join(map(str, i)), text) for i, text in zip(ids, self.model.decode(ids, num_threads=1))] if words else []

    def joined(self, texts: list[str], table: dict[str, tuple[str, str]]) -> list[tuple[str, str]]:
        """The ids of whole texts, decimal and joined by commas, and what they decode to; what the table lacks is segmented here, and kept but for long chunks."""
        cuts = [self.cut(t) for t in texts]
        lacking = list(set().union(*cuts).difference(table))
        table.update(zip(lacking, self.segment(lacking)))
        found = [[table[x] for x in c] for c in cuts]
        for x in lacking:
            if len(x) > LONG:
                del table[x]
        return [(",".join([x for x, _ in f]), " ".join([x for _, x in f])) for f in found]


def packed(words: list[bytes], ids: list[np.ndarray]) -> bytes:
    """Rows of the table as compressed bytes: their number, lengths of words and of ids, words, ids."""
    sizes = np.array([len(words), *map(len, words), *map(len, ids)], "<u4")
    return zstandard.ZstdCompressor(3).compress(sizes.tobytes() + b"".join(words) + np.concatenate(ids).astype("<u4").tobytes())


def unpacked(data: bytes) -> Iterator[tuple[str, str]]:
    """(word, decimal ids joined by commas) of packed()."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:4], "little")
    words, ids = (np.frombuffer(raw, "<u4", n, 4 + 4 * n * i) for i in range(2))
    ends = 4 + 8 * n + np.cumsum(words)
    flat = np.frombuffer(raw, "<u4", offset=int(ends[-1])).tolist()
    until = np.cumsum(ids)
    for a, z, i, j in zip((ends - words).tolist(), ends.tolist(), (until - ids).tolist(), until.tolist()):
        yield raw[a:z].decode(), ",".join(map(str, flat[i:j]))


@lru_cache(2)
def pieces(model: str) -> Pieces:
    return Pieces(model)


def in_parts(batches) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches with the number of the part they belong to: alike at every reading of a scan."""
    first, size = TaskContext.get().partitionId() << 24, 0
    for b in chunks(batches):
        yield first + size // PART, b
        size += b.nbytes


def asked(docs: DataFrame, model: str) -> DataFrame:
    """(part, word): the distinct chunks of each part."""
    schema = pa.schema([("part", pa.int64()), ("word", pa.string())])

    def run(batches):
        cut, at, seen = pieces(model).cut, None, set()

        def emit():
            # in order, so that the exchange compresses
            words = sorted(w for w in seen if len(w) <= LONG)
            for i in range(0, len(words), BATCH):
                some = words[i : i + BATCH]
                yield record(schema, [at] * len(some), some)

        for part, b in in_parts(batches):
            if part != at:
                yield from emit()
                at, seen = part, set()
            for body in b.column(2).to_pylist():
                seen.update(cut(body.decode()))
        yield from emit()

    return keyed(docs).mapInArrow(run, "part long, word string")


def table(docs: DataFrame, model: str) -> DataFrame:
    """(part, rows): the chunks that several parts have, each segmented once, as packed rows for every part that has it."""

    def run(batches):
        codec = pieces(model)

        def rows(part: np.ndarray, words: np.ndarray):
            """Packed rows of parts and words, the latter in order."""
            first = np.concatenate(([True], words[1:] != words[:-1]))
            several = np.bincount(np.cumsum(first) - 1) > 1
            names = words[first][several].tolist()
            found = codec.segment(names)
            same = np.array([x == w for (_, x), w in zip(found, names)], bool)
            ids = [np.fromstring(i, np.uint32, sep=",") for i, _ in found]
            at = np.where(several, np.cumsum(several) - 1, -1)[np.cumsum(first) - 1]
            keep = np.flatnonzero(at >= 0)
            keep = keep[same[at[keep]]]
            by = keep[np.argsort(part[keep], kind="stable")]
            encoded = [w.encode() for w in names]
            edges = np.flatnonzero(np.concatenate(([True], part[by][1:] != part[by][:-1]))).tolist() if len(by) else []
            parts, out = [], []
            for i, j in zip(edges, [*edges[1:], len(by)]):
                some = at[by[i:j]].tolist()
                parts.append(int(part[by[i]]))
                out.append(packed([encoded[k] for k in some], [ids[k] for k in some]))
            return record(SOME, parts, out)

        held, size = [], 0
        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)))
            size += b.num_rows
            if size >= HELD:
                part, words = (np.concatenate(x) for x in zip(*held))
                # the last word's rows may go on in the next batch
                n = int(np.flatnonzero(words != words[-1])[-1]) + 1 if (words != words[-1]).any() else 0
                if n:
                    yield rows(part[:n], words[:n])
                held, size = [(part[n:], words[n:])], len(words) - n
        if size:
            yield rows(*(np.concatenate(x) for x in zip(*held)))

    dealt = asked(docs, model).repartition(partitions(docs.sparkSession), "word").sortWithinPartitions("word")
    return dealt.mapInArrow(run, "part long, rows binary")


def write_table(docs: DataFrame, model: str, folder: str) -> None:
    """The table's rows of each part as one file of `folder`: packed rows, each after its length."""
    from pyarrow import fs

    def run(batches):
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        at, out, own = None, None, None

        def close():
            out.close()
            store.move(own, f"{top}/{at}.pieces")  # whole or not at all, whichever attempt ends first

        for b in batches:
            for part, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if part != at:
                    if out:
                        close()
                    at, own = part, f"{top}/.{uuid.uuid4().hex}"
                    out = store.open_output_stream(own)
                out.write(len(rows).to_bytes(8, "little") + rows)
        if out:
            close()
        yield from ()

    rows = table(docs, model)
    rows.repartition(partitions(docs.sparkSession), "part").sortWithinPartitions("part").mapInArrow(run, "done long").collect()  # no row


def read_table(folder: str, part: int) -> dict[str, tuple[str, str]]:
    from pyarrow import fs

    store, top = fs.FileSystem.from_uri(folder)
    path, out = f"{top}/{part}.pieces", {}
    if store.get_file_info(path).type == fs.FileType.NotFound:
        return out
    with store.open_input_stream(path) as source:
        while n := source.read(8):
            out.update((w, (ids, w)) for w, ids in unpacked(source.read(int.from_bytes(n, "little"))))
    return out


def coded(docs: DataFrame, model: str, kind: str, emit) -> DataFrame:
    """emit(batch, [(ids, decoded text)]) over docs, ids coming from the table."""
    folder = f"{shared_dir(docs.sparkSession)}/pieces"
    whole = pieces(model).whole
    if not whole:
        write_table(docs, model, folder)

    def run(batches):
        codec, at, held = pieces(model), None, {}
        for part, b in in_parts(batches):
            if part != at:
                at, held = part, {} if whole else read_table(folder, part)
            yield emit(b, codec.joined([x.decode() for x in b.column(2).to_pylist()], held))

    return keyed(docs).mapInArrow(run, kind)


def codec_report(docs: DataFrame, model: str) -> DataFrame:
    """Contract form: counts and digests of ids and decoded texts; null texts are empty, empty texts have no ids."""
    schema = pa.schema([("did", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def emit(b, found):
        return record(schema, b.column(0), [ids.count(",") + bool(ids) for ids, _ in found], [digest(ids) for ids, _ in found], [digest(text) for _, text in found])

    out = coded(docs, model, "did long, n_tokens long, ids_sha256 string, decoded_sha256 string", emit)
    return out.select(back(F.col("did")).alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids array<int>, n_tokens) of each row of docs; null texts are empty."""
    schema = pa.schema([("did", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64())])

    def emit(b, found):
        ids = [np.fromstring(x, np.int32, sep=",") if x else np.zeros(0, np.int32) for x, _ in found]
        lengths = np.array([len(x) for x in ids], np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]), pa.int32()))
        return record(schema, b.column(0), lists, lengths)

    return coded(docs, model, "did long, ids array<int>, n_tokens long", emit).select(back(F.col("did")).alias("doc_id"), "ids", "n_tokens")


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids are none."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        for b in chunks(batches):
            yield record(schema, b.column(0), [pieces(model).model.decode(x or []) for x in b.column(1).to_pylist()])

    return rows.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")
