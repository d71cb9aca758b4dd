"""Interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by workers.

Counting.  Every task turns its texts into token hashes and sums the bigrams of each run of
texts before anything is shuffled; what it sends is one packed row per hash range.  A range's
reducer merges the packed arrays with one sort.  Because bigrams are dealt by the hash of the
whole bigram, a word that a third of all tokens are does not gather anywhere: what is
counted per word (totals, continuations) is summed once more, from one entry per range.

Storage.  Each range is a file of sorted 64-bit keys with an aligned file of counts, in the
shared folder; a file appears whole by a rename, so a lost executor leaves none half-written.
The ranges divide the hash space, so a query finds its range by a comparison; their number grows
with the text, their size does not, and a worker maps a bounded number of them at once.

Scoring.  Workers map the files and look sorted, distinct queries up with binary searches.

    P(w|v) = (c(vw) - D(c(vw)))+ / c(v.) + g(v) P1(w)
    P1(w)  = (a(w) - D'(a(w)))+ / a(.) + g' / (V+1)

with a(w) the number of different words before w, D and D' the usual three discounts of
each level from counts of counts, and V the number of distinct training tokens; the +1 is for
tokens not seen.  Each text is scored with one begin mark and ends with one end token.

Defined cases: null and empty texts are one end token; texts are read whole; repeated rows
count as often as they stand there; with no training token all probabilities are uniform
over one unknown token; an empty table gives no rows; other columns play no part.  Tokens are
told apart by 64-bit hashes.
"""

from __future__ import annotations

import os
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_WORDS, chunks, fresh_path, hash_spans, local_path, mix, shared_dir, spans, write_file

BEGIN, END = np.uint64(0x1B3C5D7E9F010000), np.uint64(0x5432109FE7D50000)
_ODD = np.uint64(0xA24BAED4963EE407)
MAP_BYTES = 10 << 20
SCORE_BYTES = 3 << 20
#: Text bytes for each hash range.
RANGE_BYTES = 16 << 20
#: Ranges that a worker keeps open at once, up to three files each.
OPEN_RANGES = 64


def narrow(x: np.ndarray) -> np.ndarray:
    """Counts in the smallest unsigned type that holds them all."""
    return x.astype(np.min_scalar_type(int(x.max()) if x.size else 0))


def widened(raw: bytes, n: int) -> np.ndarray:
    """n numbers that narrow() made bytes of."""
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def pack(h: np.ndarray) -> bytes:
    """Sorted hashes as steps, all first bytes, then all second ones …; what the shuffle writes of them is compressed."""
    return np.ascontiguousarray(np.diff(h, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.uint64), dtype=np.uint64)


def saturate(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts as bytes, and (position, count) of those from 255 on."""
    big = np.flatnonzero(c >= 255)
    return np.minimum(c, 255).astype(np.uint8), np.stack([big, c[big].astype(np.int64)])


def restore(c: np.ndarray, big: np.ndarray) -> np.ndarray:
    out = c.astype(np.int64)
    out[big[0]] = big[1]
    return out


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts with their end tokens, and each text's first."""
    start, end, first = spans(buf, off, SPACE_WORDS)
    n = len(off) - 1
    at = first + np.arange(n + 1)
    out = np.empty(len(start) + n, np.uint64)
    ends = at[1:] - 1
    out[ends] = END
    word = np.ones(len(out), bool)
    word[ends] = False
    out[word] = hash_spans(buf, start, end)
    return out, at


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * _ODD + w)


def before(tok: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The context of each token."""
    out = np.empty_like(tok)
    out[1:] = tok[:-1]
    out[at[:-1]] = BEGIN
    return out


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct keys in order, the sums of values (2-d: by column), and where each key first stands."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    return keys[at], [np.add.reduceat(v[order], at, axis=0) if len(at) else v[:0] for v in values], order[at]


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    """The range of each key: its high 32 bits times n, cut."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _dealt(keys: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """Sorted keys by range; only ranges that have some."""
    own = _bucket(keys, n)
    edge = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else own
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(own)], strict=True):
        yield int(own[a]), slice(a, b)


PAIRS = "bucket int, words binary, r binary, w binary, c binary, big binary"
STATS = "bucket int, h binary, s array<binary>"
#: Per word: count as a token, words before it, sum and numbers of 1, 2, 3 and more of what follows it.
WIDTH = 6


_PAIRS = pa.schema([("bucket", pa.int32()), *((x, pa.binary()) for x in ("words", "r", "w", "c", "big"))])


def _packed(bucket: int, v: np.ndarray, w: np.ndarray, c: np.ndarray) -> dict:
    """Bigrams by their first word: all words once, in order, how many bigrams each begins, the places of the second words, counts."""
    words, place = np.unique(np.concatenate([v, w]), return_inverse=True)
    v, w = place[: len(v)], place[len(v) :]
    order = np.argsort(v, kind="stable")
    small, big = saturate(c[order])
    return {"bucket": bucket, "words": pack(words), "r": narrow(np.bincount(v, minlength=len(words))).tobytes(), "w": narrow(w[order]).tobytes(), "c": small.tobytes(), "big": big.astype("<i8").tobytes()}


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = unpack(row["words"])
    n = len(row["c"])
    big = np.frombuffer(row["big"], "<i8").reshape(2, -1)
    return np.repeat(words, widened(row["r"], len(words))), words[widened(row["w"], n)], restore(np.frombuffer(row["c"], np.uint8), big)


def _count(n_ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in chunks(batch.column(0), MAP_BYTES):
                tok, at = tokens(buf, off)
                ctx = before(tok, at)
                keys, (c,), first = summed(pair_key(ctx, tok), np.ones(len(tok), np.uint32))
                rows = [_packed(b, ctx[first[s]], tok[first[s]], c[s]) for b, s in _dealt(keys, n_ranges)]
                yield pa.RecordBatch.from_pylist(rows, _PAIRS)

    return run


def _merge_pairs(folder: str, n_ranges: int):
    def run(t: pa.Table) -> pa.Table:
        b = t.column("bucket")[0].as_py()
        v, w, c = map(np.concatenate, zip(*map(_unpacked, t.to_pylist()), strict=True))
        keys, (c,), first = summed(pair_key(v, w), c)
        v, w = v[first], w[first]
        write_file(f"{folder}/pair-{b}.keys.npy", keys)
        small, big = saturate(c)
        write_file(f"{folder}/pair-{b}.counts.npy", small)
        write_file(f"{folder}/pair-{b}.big.npy", big)
        of_v, (sv,), _ = summed(v, np.stack([c, c == 1, c == 2, c >= 3], 1).astype(np.int64))
        of_w, (sw,), _ = summed(w, np.stack([c, np.ones_like(c)], 1))
        h, (s,), _ = summed(np.concatenate([of_v, of_w]), np.concatenate([np.pad(sv, ((0, 0), (2, 0))), np.pad(sw, ((0, 0), (0, 4)))]))
        marks = np.array([np.sum(c == k) for k in (1, 2, 3, 4)], np.int64)
        rows = [{"bucket": x, "h": pack(h[p]), "s": [narrow(col).tobytes() for col in s[p].T]} for x, p in _dealt(h, n_ranges)]
        rows.append({"bucket": n_ranges, "h": b"", "s": [marks.tobytes()]})
        return pa.Table.from_pylist(rows, pa.schema([("bucket", pa.int32()), ("h", pa.binary()), ("s", pa.list_(pa.binary()))]))

    return run


def _merge_words(folder: str, n_ranges: int):
    def run(t: pa.Table) -> pa.Table:
        b = t.column("bucket")[0].as_py()
        rows = t.to_pylist()
        if b == n_ranges:
            marks = sum(np.frombuffer(r["s"][0], np.int64) for r in rows)
            return pa.Table.from_pydict({"what": ["pairs"], "s": [marks.tolist()]}, pa.schema([("what", pa.string()), ("s", pa.list_(pa.int64()))]))
        h = np.concatenate([unpack(r["h"]) for r in rows])
        h, (s,), _ = summed(h, np.concatenate([np.stack([widened(x, len(r["h"]) // 8) for x in r["s"]], 1) for r in rows]))
        write_file(f"{folder}/word-{b}.keys.npy", h)
        write_file(f"{folder}/word-{b}.stats.npy", narrow(s))
        a = s[:, 1]
        row = [int(s[:, 0].sum()), int(np.sum(s[:, 0] > 0)), int(a.sum()), *[int(np.sum(a == k)) for k in (1, 2, 3, 4)]]
        return pa.Table.from_pydict({"what": ["words"], "s": [row]}, pa.schema([("what", pa.string()), ("s", pa.list_(pa.int64()))]))

    return run


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of items seen once to four times; each within 0 and its count."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.5]
    return tuple(min(max(x, 0.0), k) for k, x in enumerate(d, 1))


class Ranges:
    """Sorted keys with aligned values, as mapped files of hash ranges."""

    def __init__(self, folder: str, name: str, value: str, n: int):
        self.folder, self.name, self.value, self.n = folder, name, value, n
        self.open: OrderedDict[int, tuple | None] = OrderedDict()

    def _range(self, b: int) -> tuple | None:
        """The maps of a range; of those last used, OPEN_RANGES stay open."""
        if b not in self.open:
            while len(self.open) >= OPEN_RANGES:
                self.open.popitem(last=False)  # the maps close with their arrays
            path = f"{self.folder}/{self.name}-{b}"
            load = lambda x: np.load(f"{path}.{x}.npy", mmap_mode="r") if os.path.exists(f"{path}.{x}.npy") else None
            keys = load("keys")
            self.open[b] = None if keys is None else (keys, load(self.value), load("big"))
        self.open.move_to_end(b)
        return self.open[b]

    def get(self, keys: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Fill out with the values of the sorted keys; others keep theirs."""
        for b, s in _dealt(keys, self.n):
            if (own := self._range(b)) is None:
                continue
            q = keys[s]
            p = np.searchsorted(own[0], q)
            p[p == len(own[0])] = 0
            hit = np.flatnonzero(own[0][p] == q)
            p = p[hit]
            value = own[1][p].astype(out.dtype)
            if own[2] is not None and own[2].size:
                at = np.minimum(np.searchsorted(own[2][0], p), own[2].shape[1] - 1)
                value = np.where(own[2][0][at] == p, own[2][1][at], value)
            out[s.start + hit] = value
        return out


class Model:
    """What workers need: the folder and a few totals; maps are opened on first use."""

    def __init__(self, folder: str, ranges: int, totals: dict[str, list[int]]):
        self.folder, self.ranges = folder, ranges
        words = totals.get("words", [0] * 7)
        self.n_tokens, self.n_types, self.n_pairs = words[:3]
        self.d_low, self.d_high = discounts(words[3:]), discounts(totals.get("pairs", [0] * 4))
        a = words[3:6]
        left = max(0, self.n_types - sum(a[:2]))
        self.g_low = (self.d_low[0] * a[0] + self.d_low[1] * a[1] + self.d_low[2] * left) / self.n_pairs if self.n_pairs else 1.0
        self._maps = None

    def maps(self) -> tuple[Ranges, Ranges]:
        if self._maps is None:
            self._maps = Ranges(self.folder, "pair", "counts", self.ranges), Ranges(self.folder, "word", "stats", self.ranges)
        return self._maps

    def __getstate__(self):
        return self.__dict__ | {"_maps": None}

    def score(self, tok: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: tokens known from training, the sum of the base and of the model's log10 probabilities."""
        pairs, words = self.maps()
        ctx = before(tok, at)
        types, back = np.unique(np.concatenate([tok, [BEGIN]]), return_inverse=True)
        s = words.get(types, np.zeros((len(types), WIDTH), np.int64))
        of_w = back[:-1]
        of_v = np.empty_like(of_w)
        of_v[1:] = of_w[:-1]
        of_v[at[:-1]] = back[-1]
        keys, inv = np.unique(pair_key(ctx, tok), return_inverse=True)
        c = pairs.get(keys, np.zeros(len(keys), np.int64))[inv].astype(np.float64)

        def less(x, d):
            return np.maximum(x - np.where(x >= 3, d[2], np.where(x >= 2, d[1], np.where(x >= 1, d[0], 0.0))), 0.0)

        uniform = 1.0 / (self.n_types + 1)
        low = self.g_low * uniform + (less(s[:, 1].astype(float), self.d_low) / self.n_pairs if self.n_pairs else 0.0)
        total = s[:, 2].astype(float)
        d = self.d_high
        g = np.where(total > 0, (d[0] * s[:, 3] + d[1] * s[:, 4] + d[2] * s[:, 5]) / np.maximum(total, 1), 1.0)
        p = less(c, d) / np.maximum(total, 1)[of_v] + g[of_v] * low[of_w]
        base = np.log10((s[:, 0] + 0.1) / (self.n_tokens + 0.1 * (self.n_types + 1)))
        first = at[:-1]
        return np.add.reduceat((s[:, 0] > 0)[of_w].astype(np.int64), first), np.add.reduceat(base[of_w], first), np.add.reduceat(np.log10(p), first)


def fit(docs: DataFrame, text_col: str = "text", where: Column | None = None) -> Model:
    """Count all texts (of the rows that ``where`` holds for)."""
    spark = docs.sparkSession
    used = docs if where is None else docs.where(where)
    shared_dir(spark)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(4, -(-size // RANGE_BYTES))
    folder = local_path(fresh_path(spark, "kn"))
    # a task for each range: what one gathers does not grow with the corpus
    counted = used.select(F.col(text_col).alias("text")).mapInArrow(_count(n), PAIRS).repartitionById(n, "bucket")
    stats = counted.groupBy("bucket").applyInArrow(_merge_pairs(folder, n), STATS).repartitionById(n + 1, "bucket")
    rows = stats.groupBy("bucket").applyInArrow(_merge_words(folder, n), "what string, s array<long>")
    totals = {r["what"]: list(r["s"]) for r in rows.groupBy("what").agg(F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(7)]).alias("s")).collect()}
    if "pairs" in totals:
        totals["pairs"] = totals["pairs"][:4]
    return Model(folder, n, totals)


SCORES = "_id long, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row, see SCORES; perplexity is 10 ** (-score / n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in chunks(batch.column(1), SCORE_BYTES):
                tok, at = tokens(buf, off)
                known, base, own = model.score(tok, at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(at)), pa.array(known), pa.array(base), pa.array(own)], [x.split()[0] for x in SCORES.split(", ")])

    return docs.selectExpr(f"cast(`{id_col}` as long) _id", f"`{text_col}` _text").mapInArrow(run, SCORES)
