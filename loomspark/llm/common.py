"""Shared parts: the checkpoint folder, bounded broadcasts and a vectorised text kernel.

The kernel works on Arrow string buffers.  A batch is cut into chunks of about half a
megabyte of text (a longer text is a chunk of its own), words are found as byte spans
with numpy, and each word gets a 64-bit hash, eight bytes at a time.  No Python object is made per
word, so a word costs some tens of nanoseconds.
"""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 19

# ---------------------------------------------------------------- shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only in local mode, where that is unset."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="loom-shared-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_scratch: list[list[str]] = []


def cut(df: DataFrame, name: str = "cut", result: bool = False) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back, which ends its lineage.

    Within scratch() the table goes at its end, unless it is a result.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    if len(_scratch) > result:
        _scratch[-1 - result].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that cut() writes within are removed at the end; no DataFrame that outlives it may read them."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: A key of more than one row in so many is joined by a broadcast, so at most as many keys are.
HOT = 1000


def join_counted(rows: DataFrame, side: DataFrame, keys: list[str], n: str) -> DataFrame:
    """rows with the columns of side (one row a key) that fit, nulls otherwise; keys are not null.

    n: the column of side that counts the key's rows.  A key that more than one of HOT rows has goes to
    every task, which is fewer than HOT keys, so no task gets all rows of one; the others are joined as Spark likes.
    """
    total = side.agg(F.sum(n)).first()[0] or 0
    hot = F.broadcast(side.where(F.col(n) * HOT > total))
    met = rows.join(hot, keys)
    rest = rows.join(hot, keys, "left_anti").join(side.where(F.col(n) * HOT <= total), keys, "left")
    return met.unionByName(rest)


def local_path(uri: str) -> str:
    """A folder of the shared file system as a path for open() and mmap."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"memory-mapped files need a mounted shared folder, not {uri}")
    return uri


def write_file(path: str, data: np.ndarray) -> None:
    """Write an array so that a retried or doubled task leaves one whole file."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as f:
        np.save(f, data)
    os.replace(part, path)


BATCH_ROWS = 1000


def text_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to at most BATCH_ROWS rows: a row is a whole text, and the JVM holds a batch outside its heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


# ---------------------------------------------------------------- text kernel

#: White space of the word rule [^\x20\x09-\x0D]+.
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Letters and digits: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x41:0x5B] = ALNUM_WORDS[0x61:0x7B] = True
ALNUM_WORDS[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of texts; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_string())
    n = len(col)
    if not n:
        return
    _, where, data = col.buffers()
    off = np.frombuffer(where, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def spans(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (maximal runs of table bytes inside a text), and each text's first word."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    w = table[buf]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    o = off[off < n]
    first[o] = w[o]
    o = off[off > 0] - 1
    last[o] = w[o]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


#: Bytes of a piece that belong to a word of so many more bytes.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
_TOP_BYTE, _SIZE, _NEXT = np.uint64(56), np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
#: Longer words are hashed by BLAKE2b, a piece at a time would cost a step for each eight bytes of the longest.
LONG_WORD = 2048


def pieces_of(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as numbers (zeros follow the end)."""
    padded = np.zeros((len(buf) + 23) // 8 * 8, np.uint8)
    padded[: len(buf)] = buf
    return np.lib.stride_tricks.as_strided(padded.view("<u8"), (len(buf) + 8,), (1,), writeable=False)


def hash_pieces(piece: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of words, and their first pieces.

    Words of up to seven bytes have hashes of their own; longer ones go through a mix of all
    bits for each eight bytes, so no arithmetic pattern of letters meets another one's hash.
    """
    first = piece[start] & _MASK[np.minimum(size, 8)]
    h = mix(first ^ np.where(size < 8, size.astype(np.uint64) << _TOP_BYTE, size.astype(np.uint64) * _SIZE))
    at, left = np.flatnonzero(size > 8), 8
    long = at[size[at] > LONG_WORD]
    if len(long):
        at = at[size[at] <= LONG_WORD]
        for i in long.tolist():
            n = int(size[i]) // 8 * 8
            raw = np.append(piece[start[i] : start[i] + n : 8], piece[start[i] + n] & _MASK[size[i] - n])
            h[i] = np.frombuffer(hashlib.blake2b(raw.astype("<u8").tobytes() + int(size[i]).to_bytes(8, "little"), digest_size=8).digest(), "<u8")[0]
    while len(at):
        rest = piece[start[at] + left] & _MASK[np.minimum(size[at] - left, 8)]
        h[at] = mix((h[at] + _NEXT) ^ mix(rest + _SIZE))
        left += 8
        at = at[size[at] > left]
    return h, first


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the byte spans."""
    if not len(start):
        return np.zeros(0, np.uint64)
    return hash_pieces(pieces_of(LOWER[buf] if lower else buf), start, end - start)[0]


_STEP = np.uint64(0xA24BAED4963EE407)


def chain(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k neighbours in h."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = h[:m].copy()
    for j in range(1, k):
        out *= _STEP
        out += h[j : j + m]
    return mix(out)


def shingles(h: np.ndarray, words: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in order, and each text's first; a text of fewer than k words has one."""
    n = np.diff(words)
    full = chain(h, k)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    first = np.zeros(len(words), np.int64)
    np.cumsum(count, out=first[1:])
    if not first[-1]:
        return np.zeros(0, np.uint64), first
    at = np.arange(first[-1]) + np.repeat(words[:-1] - first[:-1], count)
    short = np.flatnonzero((n > 0) & (n < k))
    out = np.zeros(first[-1], np.uint64)
    fits = np.repeat(n >= k, count)
    out[fits] = full[at[fits]]
    for i in short:
        out[first[i]] = chain(h[words[i] : words[i + 1]], int(n[i]))[0]
    return out, first


def runs(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The concatenation of start[i] .. start[i] + count[i] - 1."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(count) - count
    return np.arange(total) + np.repeat(start - first, count)


class WordCache:
    """Ids of words in an open hash table that is emptied before a call once it holds more than ``words`` words.

    A word is taken for a kept one only if its bytes are the same, so equal hashes do no harm.
    """

    PROBES = 8

    def __init__(self, kind: type, words: int):
        self.kind, self.words = kind, words
        self.bits = max(10, int(4 * words - 1).bit_length())
        self.clear()

    def clear(self) -> None:
        self.n = self.n_ids = self.n_pieces = 0
        self.table = np.full((1 << self.bits) + self.PROBES, -1, np.int32)
        self.key, self.first, self.rest = (np.zeros(1024, np.uint64) for _ in range(3))
        self.tag, self.at, self.size, self.rest_at = (np.zeros(1024, np.int64) for _ in range(4))
        self.flat = np.zeros(1024, self.kind)

    def _room(self, names: tuple[str, ...], n: int) -> None:
        for name in names:
            old = getattr(self, name)
            if len(old) < n:
                new = np.zeros(max(n, 2 * len(old)), old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.table[slot]
        open_ = np.flatnonzero((out >= 0) & (self.key[out] != h))
        for k in range(1, self.PROBES):
            if not len(open_):
                break
            e = self.table[slot[open_] + k]
            out[open_] = e
            open_ = open_[(e >= 0) & (self.key[e] != h[open_])]
        out[open_] = -1
        return out

    def _insert(self, e: np.ndarray, h: np.ndarray) -> None:
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        for k in range(self.PROBES):
            free = self.table[slot + k] < 0
            self.table[slot[free] + k] = e[free]
            lost = self.table[slot + k] != e
            e, slot = e[lost], slot[lost]

    def _add(self, piece: np.ndarray, h: np.ndarray, first: np.ndarray, start: np.ndarray, tag: np.ndarray, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        e = np.arange(self.n, self.n + len(h))
        more = np.maximum((tag >> 1) - 1, 0) >> 3
        own = int(more.sum())
        self._room(("key", "first", "tag", "at", "size", "rest_at"), self.n + len(h))
        self._room(("flat",), self.n_ids + len(ids))
        self._room(("rest",), self.n_pieces + own)
        self.key[e], self.first[e], self.tag[e], self.size[e] = h, first, tag, count
        self.at[e] = self.n_ids + np.cumsum(count) - count
        self.flat[self.n_ids : self.n_ids + len(ids)] = ids
        self.rest_at[e] = self.n_pieces + np.cumsum(more) - more
        self.rest[self.n_pieces : self.n_pieces + own] = self._rest(piece, start, tag, more)
        self.n, self.n_ids, self.n_pieces = self.n + len(h), self.n_ids + len(ids), self.n_pieces + own
        return e

    @staticmethod
    def _rest(piece: np.ndarray, start: np.ndarray, tag: np.ndarray, more: np.ndarray) -> np.ndarray:
        """All but the first pieces of the words, one word after another."""
        k = runs(np.zeros(len(more), np.int64), more)
        left = np.repeat((tag >> 1) - 8, more) - 8 * k
        return piece[np.repeat(start + 8, more) + 8 * k] & _MASK[np.minimum(left, 8)]

    def expand(self, piece: np.ndarray, start: np.ndarray, size: np.ndarray, mark: np.ndarray | None, encode: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, and where each word's begin (with the end).

        mark: a flag that tells words of equal bytes apart.  encode: the ids of the words at the
        given positions, one after another, and their numbers.
        """
        if self.n > self.words:
            self.clear()
        h, first = hash_pieces(piece, start, size)
        tag = size.astype(np.int64) << 1
        if mark is not None:
            tag |= mark
            h = h ^ np.where(mark, _NEXT, np.uint64(0))
        e = self._find(h)
        new = np.flatnonzero(e < 0)
        if len(new):
            keys, where, back = np.unique(h[new], return_index=True, return_inverse=True)
            where = new[where]
            own = self._add(piece, keys, first[where], start[where], tag[where], *encode(where))
            self._insert(own, keys)
            e[new] = own[back]
        wrong = (self.tag[e] != tag) | (self.first[e] != first)
        long = np.flatnonzero((tag > 17) & ~wrong)
        if len(long):
            more = ((tag[long] >> 1) - 1) >> 3
            same = self._rest(piece, start[long], tag[long], more) == self.rest[runs(self.rest_at[e[long]], more)]
            wrong[long] = ~np.logical_and.reduceat(same, np.cumsum(more) - more)
        if wrong.any():  # words whose hash is another one's
            at = np.flatnonzero(wrong)
            e[at] = self._add(piece, h[at], first[at], start[at], tag[at], *encode(at))
        count = self.size[e]
        total = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=total[1:])
        return self.flat[runs(self.at[e], count)], total
