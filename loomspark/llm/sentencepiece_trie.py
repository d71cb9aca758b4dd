"""SentencePiece encoding by a depth-first walk over the trie of distinct marked words.

A text gets its dummy space and its spaces become the mark U+2581.  Marked words (runs whose
neighbouring bytes stand together in some piece: words with their marks, without the punctuation
that no piece joins to them) never share a piece, so a batch is encoded by its distinct words.  They are sorted, which is the depth-first order of
their trie, and the forward lattice of a common prefix is kept from word to word.

Unigram models: the forward score of a position is the best sum of piece scores (Viterbi).
BPE models: the best sum of scores is not what BPE gives, so the lattice's edges carry the
constraint instead of a sum: a piece may follow another only if BPE of the two together
gives just these two.  Of the paths to a position exactly one satisfies that, and its last
piece is the forward state that prefixes share.  The result equals the library's.

Pieces are read from the model file, with the byte fallback for characters it lacks.  The walk is
per batch with a bounded cache of words between batches; nothing is shuffled.

Defined cases: null and empty texts have no ids; U+2581 in a text counts as a space, and
decodes to one; texts of any length are encoded whole; repeated rows are each encoded; an
empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordCache, chunks, pieces_of, runs

CHUNK = 1 << 20
CACHE_WORDS = 300_000
MARK = "▁"


def merge_bpe(symbols: list[str], score: dict[str, float]) -> list[str]:
    """Plain BPE: join the neighbours of the best piece, the leftmost first, until none is left."""
    symbols = list(symbols)
    while True:
        best, at = None, -1
        for i in range(len(symbols) - 1):
            s = score.get(symbols[i] + symbols[i + 1])
            if s is not None and (best is None or s > best):
                best, at = s, i
        if at < 0:
            return symbols
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]


class Encoder:
    """A model's pieces; encodes lists of distinct marked words."""

    def __init__(self, model_file: str, unigram: bool | None = None):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(model_file, "rb") as f:
            m.ParseFromString(f.read())
        if m.normalizer_spec.remove_extra_whitespaces or len(m.normalizer_spec.precompiled_charsmap) or not m.normalizer_spec.escape_whitespaces:
            raise ValueError("only models with the identity normaliser and kept white space")
        self.dummy = m.normalizer_spec.add_dummy_prefix
        self.unigram = m.trainer_spec.model_type == m.trainer_spec.UNIGRAM if unigram is None else unigram
        self.score = {p.piece: p.score for p in m.pieces if p.type == p.NORMAL}
        if any(p.type == p.USER_DEFINED for p in m.pieces):
            raise ValueError("user-defined pieces are not supported")
        self.ids = {p.piece: i for i, p in enumerate(m.pieces)}
        self.unk = next(i for i, p in enumerate(m.pieces) if p.type == p.UNKNOWN)
        self.bytes = [self.ids.get(f"<0x{b:02X}>") for b in range(256)]
        self.fallback = all(b is not None for b in self.bytes)
        self.longest = max(map(len, self.score), default=1)
        self.floor = min(self.score.values(), default=0.0) - 10
        self.single: dict[str, bool] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        pieces = []
        for p in m.pieces:
            pieces.append(bytes([int(p.piece[3:5], 16)]) if p.type == p.BYTE else p.piece.replace(MARK, " ").encode() if p.type == p.NORMAL else b" \xe2\x81\x87 " if p.type == p.UNKNOWN else b"")
        self.piece_len = np.array([len(p) for p in pieces], np.int64)
        self.piece_at = np.cumsum(self.piece_len) - self.piece_len
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.cache = WordCache(np.int32, CACHE_WORDS)
        self.ends = {p[i:] for p in self.score for i in range(len(p))}
        #: Pairs of bytes that a piece or a character has inside; between others a word may be cut.
        self.inside = np.zeros((256, 256), bool)
        self.inside[:, 0x80:0xC0] = True
        for p in self.score:
            raw = np.frombuffer(p.replace(MARK, " ").encode(), np.uint8)
            self.inside[raw[:-1], raw[1:]] = True

    def alone(self, piece: str) -> bool:
        """BPE leaves the piece whole."""
        ok = self.single.get(piece)
        if ok is None:
            ok = self.single[piece] = merge_bpe(list(piece), self.score) == [piece]
        return ok

    def follows(self, a: str, b: str) -> bool:
        """BPE of a and b together gives just these two."""
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            ok = self.pairs[a, b] = merge_bpe(list(a + b), self.score) == [a, b]
        return ok

    def _out(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            i = self.ids.get(p) if p in self.score else None
            if i is not None:
                out.append(i)
            elif self.fallback:
                out += [self.bytes[b] for b in p.encode()]
            else:
                out.append(self.unk)
        return out

    def walk(self, words: list[str]) -> list[list[int]]:
        """Ids of the sorted distinct words; state of the common prefix is reused."""
        out, prev = [], ""
        last, best = [""], [0.0]  # of each prefix: its last piece, its score
        score, longest, unigram, ends, single, pairs = self.score, self.longest, self.unigram, self.ends, self.single, self.pairs
        for word in words:
            k, most = 0, min(len(prev), len(word))
            while k < most and prev[k] == word[k]:
                k += 1
            del last[k + 1 :], best[k + 1 :]
            for i in range(k + 1, len(word) + 1):
                found, top = word[i - 1], None
                if unigram:
                    for j in range(max(0, i - longest), i):
                        p = word[j:i]
                        s = score.get(p)
                        if s is None and j == i - 1:
                            s = self.floor
                        if s is not None and (top is None or best[j] + s > top):
                            top, found = best[j] + s, p
                else:
                    j = i - 1
                    while j > 0 and word[j - 1 : i] in ends:
                        j -= 1
                    for j in range(j, i):
                        p = word[j:i]
                        if p in score and (single[p] if p in single else self.alone(p)) and (not j or (pairs[last[j], p] if (last[j], p) in pairs else self.follows(last[j], p))):
                            found = p
                            break
                last.append(found)
                best.append(top or 0.0)
            i, back = len(word), []
            while i:
                back.append(last[i])
                i -= len(last[i])
            out.append(self._out(back[::-1]))
            prev = word
        return out

    def _starts(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        first = np.ones(len(buf), bool)
        first[1:] = ~self.inside[buf[:-1], buf[1:]]
        first[off[off < len(buf)]] = True
        return np.flatnonzero(first)

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (bytes without U+2581), and each text's first."""
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        start = self._starts(buf, off)
        size = np.diff(np.append(start, len(buf)))
        firsts = np.zeros(len(start), bool)
        if self.dummy:  # a text's first word has one mark more
            firsts[np.searchsorted(start, off[:-1][np.diff(off) > 0])] = True
        data = buf.tobytes()

        def walked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            words = [((" " if f else "") + data[a : a + n].decode()).replace(" ", MARK) for a, n, f in zip(*(x[at].tolist() for x in (start, size, firsts)), strict=True)]
            order = sorted(range(len(words)), key=words.__getitem__)
            each: list[list[int]] = [[]] * len(words)
            for i, ids in zip(order, self.walk([words[i] for i in order]), strict=True):
                each[i] = ids
            count = np.fromiter(map(len, each), np.int64, len(each))
            return np.fromiter(chain.from_iterable(each), np.int32, int(count.sum())), count

        ids, total = self.cache.expand(pieces_of(buf), start, size, firsts, walked)
        return ids, total[np.searchsorted(start, off)]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts and their offsets, without the dummy space."""
        size = self.piece_len[ids]
        raw = self.piece_bytes[runs(self.piece_at[ids], size)]
        total = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        off = total[first]
        if self.dummy:
            full = np.diff(off) > 0
            keep = np.ones(len(raw), bool)
            keep[off[:-1][full]] = False
            raw, off = raw[keep], off - np.concatenate([[0], np.cumsum(full)])
        return raw, off


_encoders: dict[tuple, Encoder] = {}


def encoder(model_file: str, unigram: bool | None = None) -> Encoder:
    """One encoder per worker process."""
    key = (model_file, unigram)
    if key not in _encoders:
        _encoders[key] = Encoder(model_file, unigram)
    return _encoders[key]


SCHEMA = "_id long, n_ids long, ids_crc32 long, decoded_equal boolean"


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, unigram: bool | None = None) -> DataFrame:
    """One row per input row, see SCHEMA, and ids array<int> if with_ids.

    ids_crc32 is of the ids as little-endian 32-bit integers; decoded_equal says that decoding
    the ids gives the text (with U+2581 as spaces).
    """
    schema = SCHEMA + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model_file, unigram)
        for batch in batches:
            for i, j, buf, off in chunks(batch.column(1), CHUNK):
                ids, first = e.encode(buf, off)
                raw, at = e.decode(ids, first)
                packed = ids.astype("<i4")
                crc = [zlib.crc32(packed[a:b]) for a, b in zip(first, first[1:], strict=False)]
                whole = len(raw) == len(buf) and np.array_equal(at, off) and np.array_equal(raw, buf)
                same = [True] * (j - i) if whole else [np.array_equal(raw[at[k] : at[k + 1]], buf[off[k] : off[k + 1]]) for k in range(j - i)]
                cols = [batch.column(0).slice(i, j - i), pa.array(np.diff(first)), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.replace(F.col(text_col), F.lit(MARK), F.lit(" ")).alias("_text")).mapInArrow(run, schema)


def decode(rows: DataFrame, model_file: str, id_col: str = "_id", ids_col: str = "ids") -> DataFrame:
    """_id and text of each row's ids; null ids count as none; bytes that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model_file)
        for batch in batches:
            texts = []
            for ids in batch.column(1):
                own = np.array(ids.as_py() or [], np.int64)
                texts.append(e.decode(own, np.array([0, len(own)]))[0].tobytes().decode(errors="replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["_id", "text"])

    return rows.selectExpr(f"cast(`{id_col}` as long) _id", f"`{ids_col}` ids").mapInArrow(run, "_id long, text string")
