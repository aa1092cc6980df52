"""Token ids packed into Arrow files of equal-length sequences.

A file holds record batches of two fixed-size lists, ``tokens`` and ``mask``
(false on padding): every sequence has the same length, so that document,
sequence and token positions are plain arithmetic and a mapped file is read
without a copy.  Documents follow each other without a gap in ascending order
of their ids; only a file's last sequence is padded.  A batch carries, as its
metadata, the ids of the documents that end in it and the places of their ends,
so that a file tells by itself whose ids it holds.

A table of an entry per document (file, position, number of ids) is written
with Spark's commit protocol.  Each attempt of a task writes a file of its own
name, and only files named in that table count.  What is read back comes from
the files; the table says which ones, and serves random access.
"""

from __future__ import annotations

import base64
import codecs
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm import bytespans as B
from citeloom.llm.common import kept, mapped, safe, shared_dir, written
from citeloom.llm.files import reader, writer

#: Ids of a sequence, sequences of a record batch, and pieces whose ids a worker remembers.
LENGTH, ROWS, REMEMBERED = 2048, 256, 1_200_000
_FINAL = np.zeros(256, bool)
_FINAL[list(b".,;:!?")] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True


class Encoder:
    """A tokenizer that remembers the ids of parts of texts.

    If the tokenizer drops white space and splits words from stops before its
    merges (``_drops_space``), the ids of a text are those of its parts, one
    after another; parts end at ASCII white space and before a final stop or
    comma after an ASCII letter or digit.  Distinct parts are encoded once, found by a
    hash and then compared in full; those that differ in A-Z only are one,
    unless a special token may be near.  Parts
    of lower-case Latin letters alone skip the library's normaliser, which
    leaves them as they are.  Other tokenizers get whole texts.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker for each core
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.parts = _drops_space(json.loads(self.tokenizer.to_str()))
        self.wide = np.dtype(np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        if self.parts:
            self.plain = Tokenizer.from_file(path)
            self.plain.normalizer, self.plain.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
            vocab = self.tokenizer.get_vocab()
            self.final = np.zeros(max(vocab.values()) + 1, bool)
            self.final[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.first, self.ids = np.zeros(1, np.int64), np.zeros(0, self.wide)
        self.place, self.bytes = np.zeros(1, np.int64), np.zeros(0, np.uint8)  # of the parts themselves
        self.spans = B.Spans(self.bytes)

    def _learn(self, keys: list[int], raw: list[bytes]) -> None:
        parts = [x.decode() for x in raw]
        plain = np.fromiter((_PLAIN.fullmatch(p) is not None for p in parts), bool, len(parts))
        words = [p for p, x in zip(parts, plain, strict=True) if x]
        joined = [codecs.charmap_decode(" ".join(words[k : k + 256]).encode(), "strict", _SPELT)[0] for k in range(0, len(words), 256)]
        ids = np.fromiter((i for e in self.plain.encode_batch_fast(joined, add_special_tokens=False) for i in e.ids), self.wide)
        ends = np.flatnonzero(self.final[ids]) + 1
        rest = [e.ids for e in self.tokenizer.encode_batch([p for p, x in zip(parts, plain, strict=True) if not x], add_special_tokens=False)]
        sizes = np.r_[np.diff(ends, prepend=0), [len(x) for x in rest]].astype(np.int64)
        if len(sizes) != len(parts):
            raise ValueError("the tokenizer doesn't end each word with one final piece")
        order = np.r_[np.flatnonzero(plain), np.flatnonzero(~plain)]
        self.known.update(zip([keys[k] for k in order], range(len(self.known), len(self.known) + len(keys)), strict=True))
        self.first = np.r_[self.first, self.first[-1] + np.cumsum(sizes)]
        self.ids = np.r_[self.ids, ids, np.fromiter((i for x in rest for i in x), self.wide)]
        self.place = np.r_[self.place, self.place[-1] + np.cumsum([len(raw[k]) for k in order])]
        self.bytes = np.r_[self.bytes, np.frombuffer(b"".join(raw[k] for k in order), np.uint8)]
        self.spans = B.Spans(self.bytes)

    def _whole(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids + [end] for e in self.tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
        return np.fromiter((i for x in found for i in x), self.wide), np.array([len(x) for x in found], np.int64)

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, ``end`` after each text, and the number of ids of each text."""
        if not self.parts:
            return self._whole(texts, end)
        data, offsets = B.joined(texts)
        if b"<|" not in (raw := data.tobytes()):
            data = B.lowered(data)
            raw = data.tobytes()
        starts, ends, _ = B.words(data, offsets)
        starts, ends = _without_stops(data, starts, ends)
        spans, length = B.Spans(data), ends - starts
        keys, at, part = np.unique(B.quick(spans, starts, length), return_index=True, return_inverse=True)
        if len(self.known) + len(keys) > REMEMBERED:
            self._forget()
        keys = keys.tolist()
        slot = np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, len(keys))
        if len(new := np.flatnonzero(slot < 0)):
            fresh, first = [keys[k] for k in new.tolist()], at[new]
            self._learn(fresh, [raw[lo:hi] for lo, hi in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
            slot[new] = np.fromiter(map(self.known.__getitem__, fresh), np.int64, len(fresh))
        slot = slot[part]
        if (self.place[slot + 1] - self.place[slot] != length).any() or not B.same(spans, starts, self.spans, self.place[slot], length):
            return self._whole(texts, end)  # two parts have one hash
        size = self.first[slot + 1] - self.first[slot]
        total = np.r_[0, np.cumsum(size)]
        bound = np.searchsorted(starts, offsets)
        n = total[bound[1:]] - total[bound[:-1]]
        ids = self.ids[np.repeat(self.first[slot] - total[:-1], size) + np.arange(total[-1])]
        return np.insert(ids, np.cumsum(n), end).astype(self.wide), n + 1


def _drops_space(config: dict) -> bool:
    """Whether a tokenizer normalises and splits in the one way for which parts are exact."""
    normal, pre, model = config["normalizer"] or {}, config["pre_tokenizer"] or {}, config["model"]
    steps, splits = normal.get("normalizers", []), pre.get("pretokenizers", [])
    return (
        [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"]
        and [x["type"] for x in splits] == ["Split", "ByteLevel"]
        and splits[0]["pattern"] == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
        and splits[0]["behavior"] == "Removed"
        and not splits[1]["add_prefix_space"]
        and not splits[1]["use_regex"]
        and model["type"] == "BPE"
        and model["end_of_word_suffix"] == "</w>"
    )


def _without_stops(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with the last stop or comma after a letter or digit as a part of its own."""
    cut = _FINAL[data[ends - 1]] & (ends - starts > 1)
    cut[cut] = _ALNUM[data[ends[cut] - 2]]
    first = np.arange(len(starts)) + np.cumsum(cut) - cut
    parts = np.repeat(np.stack([starts, ends]), 1 + cut, axis=1)
    parts[1, first[cut]] -= 1
    parts[0, first[cut] + 1] = ends[cut] - 1
    return parts[0], parts[1]


class _Packer:
    """Writes ids as full sequences; holds at most one record batch and the documents that end in it."""

    def __init__(self, path: str, wide: np.dtype, length: int, end: int):
        self.length, self.wide = length, wide
        columns = [("tokens", pa.list_(pa.from_numpy_dtype(wide), length)), ("mask", pa.list_(pa.bool_(), length))]
        self.schema = pa.schema(columns, metadata={"end": str(end)})
        self.sink = writer(path)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.rest, self.done = np.zeros(0, wide), 0
        self.documents: pa.Table | None = None

    def add(self, ids: np.ndarray, doc_ids: pa.Array, n: np.ndarray) -> None:
        ends = self.done + len(self.rest) + np.cumsum(n)
        more = pa.table({"doc_id": doc_ids, "end": pa.array(ends, pa.int64())})
        self.documents = more if self.documents is None else pa.concat_tables([self.documents, more])
        self.rest = np.r_[self.rest, ids]
        full = len(self.rest) // (ROWS * self.length) * ROWS * self.length
        for lo in range(0, full, ROWS * self.length):
            self._put(self.rest[lo : lo + ROWS * self.length])
        self.rest = self.rest[full:].copy()

    def _put(self, ids: np.ndarray) -> None:
        tokens = np.zeros(-(-len(ids) // self.length) * self.length, self.wide)
        tokens[: len(ids)] = ids
        columns = [pa.array(tokens), pa.array(np.arange(len(tokens)) < len(ids))]
        lists = [pa.FixedSizeListArray.from_arrays(c, type=x) for c, x in zip(columns, self.schema.types, strict=True)]
        self.done += len(ids)
        here = int(np.searchsorted(self.documents.column("end").to_numpy(), self.done, "right"))
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema), {"documents": _spelt(self.documents.slice(0, here))})
        self.documents = self.documents.slice(here).combine_chunks()

    def close(self) -> None:
        if len(self.rest):
            self._put(self.rest)
        self.out.close()
        self.sink.close()


def _spelt(table: pa.Table) -> str:
    """A small table as ASCII, for metadata."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return base64.b64encode(sink.getvalue()).decode()


class Sequences:
    """Random access to a written file; every batch but the last has as many ids."""

    def __init__(self, path: str):
        self.file = pa.ipc.open_file(reader(path))
        self.step = ROWS * self.file.schema.field("tokens").type.list_size
        self.held: tuple[int, np.ndarray] = (-1, np.zeros(0))

    def _batch(self, k: int) -> np.ndarray:
        if self.held[0] != k:
            self.held = (k, self.file.get_batch(k).column("tokens").values.to_numpy())
        return self.held[1]

    def ids(self, start: int, n: int) -> np.ndarray:
        parts = [self._batch(k)[max(0, start - k * self.step) : start + n - k * self.step] for k in range(start // self.step, -(-(start + n) // self.step))]
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint32)


#: Lower-case Latin letters that no normaliser changes; the characters by which byte-level pieces spell bytes from 128.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")
_PRINTABLE = [*range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: b if b in _PRINTABLE else 256 + 33 + k for k, b in enumerate(x for x in range(127, 256) if x not in _PRINTABLE)} | {b: b for b in _PRINTABLE}
_SPELT = "".join(chr(_BYTE_CHARS.get(b, b)) for b in range(256))


def _encode_and_write(folder: str, tokenizer: str, end: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, packer, at = f"{folder}/{uuid.uuid4().hex}.arrow", None, 0
        coder = kept("encoder", tokenizer, Encoder)
        entries = []
        for b in batches:
            sizes = []
            for texts in B.slices(b.column("text")):
                ids, n = coder.encode(texts, end)
                packer = packer or _Packer(path, coder.wide, length, end)
                packer.add(ids, b.column("doc_id").slice(sum(map(len, sizes)), len(n)), n)
                sizes.append(n)
            n = np.concatenate([*sizes, np.zeros(0, np.int64)])
            entries.append((b.column("doc_id"), at + np.cumsum(n) - n, n))
            at += int(n.sum())
        if packer:
            packer.close()  # the entries follow the whole file
        for doc_id, start, n in entries:
            k = len(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, TaskContext.get().partitionId()), pa.int32()), pa.array([path] * k), doc_id, pa.array(start), pa.array(n)], names=["part", "path", "doc_id", "at", "n_tokens"])

    return run


def write_sequences(docs: DataFrame, tokenizer: str, end: int, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all texts in ascending order of id and returns an entry for each: part, path, doc_id, at, n_tokens, start.

    ``tokenizer`` is a tokenizers file that all executors can open.  Null counts
    as empty; an empty text has the end id alone.  Repeated ids follow each
    other in the order of a hash of their texts, null ids come first.  An empty table
    writes no file.  Other columns are ignored.
    """
    rows = safe(docs, id_col, text_col).toDF("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    entries = written(mapped(ordered, _encode_and_write(shared_dir(docs.sparkSession), tokenizer, end, length), f"part int, path string, doc_id {kind}, at long, n_tokens long", "encoder"))
    return entries.join(F.broadcast(_before(entries)), "part").withColumn("start", F.col("before") + F.col("at")).drop("before")


def _before(rows: DataFrame) -> DataFrame:
    """part, before: the ids of all files before each, a row for each file."""
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    return parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))


def documents_of(path: str) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, list[int]]]:
    """Reads a file from end to end: for each batch the documents that end in it, their first positions, numbers of ids and crc32.

    A file whose places and ids disagree (a document that doesn't close with
    the end id, or ids that belong to none) is an error.
    """
    file = Sequences(path).file
    end = int(file.schema.metadata[b"end"])
    at, begun, crc = 0, 0, 0  # ids read so far, where the document now read began, and its sum up to here
    for k in range(file.num_record_batches):
        batch, meta = file.get_batch_with_custom_metadata(k)
        ids = batch.column("tokens").values.to_numpy()[batch.column("mask").values.to_numpy(zero_copy_only=False)]
        documents = pa.ipc.open_stream(base64.b64decode(meta[b"documents"])).read_all().combine_chunks()
        cuts = documents.column("end").to_numpy() - at
        if len(cuts) and ((np.diff(cuts, prepend=0) < 1).any() or cuts[-1] > len(ids) or (ids[cuts - 1] != end).any()):
            raise ValueError(f"{path}: documents don't end at the end ids of batch {k}")
        raw, lo, sums = memoryview(ids.astype("<u4")).cast("B"), 0, []
        for cut in cuts.tolist():
            sums.append(zlib.crc32(raw[4 * lo : 4 * cut], crc))
            crc, lo = 0, cut
        crc = zlib.crc32(raw[4 * lo :], crc)
        starts = np.r_[begun, at + cuts]
        yield documents.column("doc_id"), starts[:-1], np.diff(starts), sums
        at, begun = at + len(ids), int(starts[-1])
    if begun != at:
        raise ValueError(f"{path}: ids of no document")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, path in zip(b.column("part").to_pylist(), b.column("path").to_pylist(), strict=True):
            for doc_id, at, n, sums in documents_of(path):
                if len(sums):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sums), part, np.int32)), doc_id.combine_chunks(), pa.array(at), pa.array(n), pa.array(sums, pa.int64())], names=["part", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_digests(entries: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids (as little-endian unsigned 32-bit integers), all read back from the files.

    Of ``entries`` only the files' names and their order count.  A task reads a
    file, batch by batch.
    """
    kind = entries.schema["doc_id"].dataType.simpleString()
    files = written(entries.select("part", "path").distinct())
    spread = files.repartitionByRange(max(1, files.count()), "part")  # a task for each file
    read = written(mapped(spread, _read, f"part int, doc_id {kind}, at long, n_tokens long, ids_crc32 long", "encoder"))
    return read.join(F.broadcast(_before(read)), "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
