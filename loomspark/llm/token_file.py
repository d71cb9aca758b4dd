"""Token-id files: byte-level BPE ids in range-coded blocks, written and read by Spark tasks.

Writing.  Rows are dealt by ranges of the id and sorted, so the files in order hold the
documents in ascending id order.  Texts are cut into the tokenizer's pre-tokens with numpy
(the byte-level rule: contractions, letters, digits, other marks, each with a space before it,
and white space); only pre-tokens that a worker has not met lately go through the tokenizers
library.  Ids go to the coder of id_coder a block at a time, and a file appears whole by a rename.

File: MAGIC; each block with its header; then the index (ids of the documents, their token
numbers), its place, and MAGIC again.  The manifest lists files and totals.

Reading.  Each file is a task; blocks are decoded, checked against their checksums, and cut
into documents by the index.

Defined cases: null and empty texts are the end id alone; a null id is kept and sorts first; ties
of ids stay in one file in no defined order but each row comes back; texts of any length are
encoded whole; special tokens in a text are ordinary text; an empty table gives no rows; other
columns play no part.
"""

from __future__ import annotations

import json
import os
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordCache, chunks, fresh_path, local_path, pieces_of, runs
from .id_coder import BLOCK, decode_block, encode_blocks

MAGIC = b"LMIDS02\n"
FILE_BYTES = 24 << 20
CACHE_WORDS = 1_000_000
WORDS_AT_ONCE = 16384
CHUNK = 4 << 20

SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
_WHITE = {9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
_classes = np.zeros(0x110000, np.uint8)
_filled = np.zeros(0x1100, bool)


def classes(points: np.ndarray) -> np.ndarray:
    """The class of each code point; those of 256 neighbours are looked up when one is first met."""
    for page in np.flatnonzero(np.bincount(points >> 8, minlength=1)).tolist():
        if not _filled[page]:
            for c in range(page << 8, (page + 1) << 8):
                kind = unicodedata.category(chr(c))[0]
                _classes[c] = SPACE if c in _WHITE else LETTER if kind == "L" else DIGIT if kind == "N" else OTHER
            _filled[page] = True
    return _classes[points]


_FIRST = classes(np.arange(256))


_CONTRACTED = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def byte_classes(buf: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    cls = _FIRST[buf]
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        padded = np.append(buf, np.zeros(3, np.uint8))
        b = padded[lead].astype(np.int64)
        tail = [padded[lead + k].astype(np.int64) & 0x3F for k in (1, 2, 3)]
        point = np.where(b < 0xE0, (b & 0x1F) << 6 | tail[0], np.where(b < 0xF0, (b & 0x0F) << 12 | tail[0] << 6 | tail[1], (b & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]))
        own = classes(point)
        cls[lead] = cls[lead + 1] = own
        for k, least in ((2, 0xE0), (3, 0xF0)):
            wide = b >= least
            cls[lead[wide] + k] = own[wide]
    return cls


def pretokens(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Byte starts of the pre-tokens; they cover the texts without gaps."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64)
    cls = byte_classes(buf)
    doc = np.zeros(n, bool)  # first byte of a text
    doc[off[off < n]] = True
    last = np.append(doc[1:], True)  # last byte of a text
    new = doc.copy()
    new[1:] |= cls[1:] != cls[:-1]
    space = cls == SPACE
    # the last white space of a run that goes on to something else: a token of its own, or the space before one
    tail = space & ~last
    tail[:-1] &= ~space[1:]
    at = np.flatnonzero(tail)
    first = at.copy()
    for _ in range(3):
        first -= (buf[first] & 0xC0) == 0x80
    new[first] = True
    new[at[buf[at] == 32] + 1] = False
    # contractions: a lone apostrophe that starts a token, before letters
    quote = np.flatnonzero((buf == 39) & new & ~last)
    quote = quote[new[quote + 1] & (cls[quote + 1] == LETTER)]
    data = buf.tobytes() if len(quote) else b""
    for q in quote.tolist():
        for c in _CONTRACTED:
            end = q + 1 + len(c)
            if data.startswith(c, q + 1) and not doc[q + 1 : end].any():
                new[q + 1] = False
                if end < n:
                    new[end] = True
                    if tail[end] and buf[end] == 32 and end + 1 < n:
                        new[end + 1] = False
                break
    return np.flatnonzero(new)


NEWLINE = 10


class Tokens:
    """The tokenizer with a bounded cache of pre-tokens."""

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(tokenizer_file)
        self.own.encode_special_tokens = True
        self.cache = WordCache(np.uint32, CACHE_WORDS)
        line = self.own.encode("\n", add_special_tokens=False).ids
        self.newline = line[0] if len(line) == 1 else None

    def _encode(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens, one after another, and their numbers.

        Those that end in no white space go to the library joined by line feeds, which are pre-tokens of their own.
        """
        count = np.zeros(len(start), np.int64)
        white = _FIRST[buf[start + size - 1]] == SPACE
        white |= buf[start + size - 1] >= 0x80  # perhaps
        white |= self.newline is None
        found: list[np.ndarray] = []
        where: list[np.ndarray] = []
        plain = np.flatnonzero(~white)
        for k in range(0, len(plain), WORDS_AT_ONCE):
            at = plain[k : k + WORDS_AT_ONCE]
            n = size[at] + 1
            first = np.cumsum(n) - n
            raw = np.full(int(n.sum()), NEWLINE, np.uint8)
            raw[runs(first, size[at])] = buf[runs(start[at], size[at])]
            ids = np.array(self.own.encode_batch_fast([raw.tobytes().decode()], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(ids == self.newline)
            if len(cut) != len(at):
                white[at] = True  # another rule than this file's; they go one by one
                continue
            count[at] = np.diff(np.append(-1, cut)) - 1
            found.append(np.delete(ids, cut))
            where.append(at)
        alone = np.flatnonzero(white)
        if len(alone):
            data = buf.tobytes()
            for k in range(0, len(alone), WORDS_AT_ONCE):
                at = alone[k : k + WORDS_AT_ONCE]
                words = [data[a : a + b].decode() for a, b in zip(start[at].tolist(), size[at].tolist(), strict=True)]
                ids = [e.ids for e in self.own.encode_batch_fast(words, add_special_tokens=False)]
                count[at] = [len(x) for x in ids]
                found.append(np.array([i for x in ids for i in x], np.uint32))
                where.append(at)
        out = np.zeros(int(count.sum()), np.uint32)
        first = np.cumsum(count) - count
        for ids, at in zip(found, where, strict=True):
            out[runs(first[at], count[at])] = ids
        return out, count

    def __call__(self, buf: np.ndarray, off: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and each text's first."""
        n = len(off) - 1
        start = pretokens(buf, off)
        if len(start):
            size = np.diff(np.append(start, len(buf)))
            ids, total = self.cache.expand(pieces_of(buf), start, size, None, lambda at: self._encode(buf, start[at], size[at]))
            first = total[np.searchsorted(start, off)]
        else:
            ids, first = np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        if end_id is not None:
            out = np.full(len(ids) + n, end_id, np.uint32)
            first = first + np.arange(n + 1)
            word = np.ones(len(out), bool)
            word[first[1:] - 1] = False
            out[word] = ids
            ids = out
        return ids, first


_tokens: dict[str, Tokens] = {}


def tokens(tokenizer_file: str) -> Tokens:
    if tokenizer_file not in _tokens:
        _tokens[tokenizer_file] = Tokens(tokenizer_file)
    return _tokens[tokenizer_file]


class Writer:
    """One file; add() takes documents in order, close() makes the file appear."""

    def __init__(self, path: str):
        self.path, self.part = path, f"{path}.{uuid.uuid4().hex}.part"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        self.file = open(self.part, "wb")  # noqa: SIM115
        self.file.write(MAGIC)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        self.ids, self.sizes = [], []

    def add(self, doc_ids: np.ndarray, valid: np.ndarray, ids: np.ndarray, first: np.ndarray) -> None:
        self.ids.append(np.stack([doc_ids, valid.astype(np.int64)]))
        self.sizes.append(np.diff(first))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        while self.n_waiting >= BLOCK:
            self._flush(BLOCK)

    def _flush(self, n: int) -> None:
        every = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        self.waiting, self.n_waiting = [every[n:]], len(every[n:])
        for n_ids, crc, bits, count, words in encode_blocks(every[:n]):
            self.file.write(struct.pack("<5I", n_ids, crc, bits, len(count), len(words)) + count + words)

    def close(self) -> None:
        if self.n_waiting:
            self._flush(self.n_waiting)
        at = self.file.tell()
        index = np.concatenate([*self.ids, np.zeros((2, 0), np.int64)], 1)
        sizes = np.concatenate([*self.sizes, np.zeros(0, np.int64)])
        self.file.write(np.concatenate([index[0], index[1], sizes]).astype("<i8").tobytes() + struct.pack("<QQ", at, len(sizes)) + MAGIC)
        self.file.close()
        os.replace(self.part, self.path)


def read_file(path: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of documents: ids of documents, which are valid, token ids, and each document's first."""
    with open(path, "rb") as f:
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is no token-id file")
        f.seek(-16 - len(MAGIC), 2)
        at, n = struct.unpack("<QQ", f.read(16))
        if f.read() != MAGIC:
            raise ValueError(f"{path} is cut off")
        f.seek(at)
        index = np.frombuffer(f.read(24 * n), "<i8").reshape(3, n)
        bounds = np.concatenate([[0], np.cumsum(index[2])])
        f.seek(len(MAGIC))
        waiting, begun, doc = np.zeros(0, np.uint32), 0, 0
        while f.tell() < at:
            n_ids, crc, bits, n_count, n_words = struct.unpack("<5I", f.read(20))
            waiting = np.concatenate([waiting, decode_block((n_ids, crc, bits, f.read(n_count), f.read(n_words)))])
            until = int(np.searchsorted(bounds, begun + len(waiting), "right")) - 1
            if until > doc:
                first = bounds[doc : until + 1] - begun
                yield index[0, doc:until], index[1, doc:until] > 0, waiting[: first[-1]], first
                waiting, begun, doc = waiting[first[-1] :], int(bounds[until]), until
        if doc < n:
            raise ValueError(f"{path} lacks ids")


def write(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = None, folder: str | None = None) -> str:
    """Write all rows; the folder (by default a new one in the shared folder) with manifest.json."""
    spark = docs.sparkSession
    where = local_path(folder or fresh_path(spark, "ids"))
    picked = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(1, -(-size // FILE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode, out = TaskContext.get().partitionId(), tokens(tokenizer_file), None
        for batch in batches:
            ids = batch.column(0)
            valid = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            for i, j, buf, off in chunks(batch.column(1), CHUNK):
                out = out or Writer(f"{where}/part-{part:06d}.ids")
                out.add(ids[i:j], valid[i:j], *encode(buf, off, end_id))
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "n_ids": [out.n_ids]})

    parts = picked.repartitionByRange(n, "_id").sortWithinPartitions("_id").mapInArrow(run, "part long, n_ids long")
    rows = sorted({r["part"]: r["n_ids"] for r in parts.collect()}.items())  # a row for each file
    os.makedirs(where, exist_ok=True)
    at, files = 0, []
    for part, n_ids in rows:
        files.append({"file": f"part-{part:06d}.ids", "start": at, "ids": n_ids})
        at += n_ids
    with open(f"{where}/manifest.json", "w") as f:
        json.dump({"files": files, "ids": at}, f)
    return where


SCHEMA = "_id long, start long, n_tokens long, ids_crc32 long"


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document, see SCHEMA, and ids array<long> if with_ids."""
    where = local_path(folder)
    with open(f"{where}/manifest.json") as f:
        files = [(x["file"], x["start"]) for x in json.load(f)["files"]]
    schema = SCHEMA + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for doc, valid, ids, first in read_file(f"{where}/{name}"):
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(first, first[1:], strict=False)]
                    cols = [pa.array(doc, mask=~valid), pa.array(first[:-1] + at), pa.array(np.diff(first)), pa.array(crc, pa.int64())]
                    if with_ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int64())))
                    at += int(first[-1])
                    yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in schema.split(", ")])

    if not files:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame(spark.sparkContext.parallelize(files, len(files)), "file string, start long").mapInArrow(run, schema)  # a task for each file
