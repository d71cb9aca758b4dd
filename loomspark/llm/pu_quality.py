"""Quality classifier by positive-unlabelled learning with the non-negative risk.

Trusted positives are rows labelled 1, unlabelled ones are any web texts.  With class prior p,
loss l and scorer f the risk minimised is

    p E_P[l(f)] + max(0, E_U[l(-f)] - p E_P[l(-f)])

and where the second part is negative the step only raises it (the usual correction).  The
prior is estimated from P and U alone: a first scorer ranks held-back texts, and the smallest
ratio of U's to P's share above a threshold, with a margin for small counts, bounds it.

Features come from whole texts: shares of neighbouring byte classes (how letters, capitals,
digits, marks and spaces follow one another) and shares over words and lines (lengths, capitals,
trailing marks, repeats).  Labels, ids, languages and sources are not features.

The fit is on a bounded sample (``max_positive``, ``max_unlabelled`` rows by hash of the id)
whose features come to the driver; scoring maps over all rows without a shuffle.

Defined cases: null and empty texts have all features 0 and get a score like any text; rows
of equal text score equally; labels that repeat or name no row are harmless; without labels of
one the scorer gives the prior to all; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_WORDS, chunks, hash_spans, mix, spans

# byte classes
_CLASS = np.full(256, 5, np.uint8)  # other marks and controls
_CLASS[0x61:0x7B] = 0
_CLASS[0x41:0x5B] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[[0x20, 0x09]] = 3
_CLASS[[0x0A, 0x0D]] = 4
_CLASS[[ord(c) for c in ".,;:'\"-()?"]] = 6
_CLASS[0x80:] = 7
CLASSES = 8
N_FEATURES = CLASSES * CLASSES + 12
_LINES = np.ones(256, bool)
_LINES[[0x0A, 0x0D]] = False


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of N_FEATURES per text."""
    n = len(off) - 1
    out = np.zeros((n, N_FEATURES), np.float32)
    if not len(buf):
        return out
    size = np.diff(off)
    doc = np.repeat(np.arange(n), size)
    c = _CLASS[buf]
    code = (doc[:-1] * CLASSES + c[:-1]) * CLASSES + c[1:]
    code = code[doc[:-1] == doc[1:]]
    pairs = np.bincount(code, minlength=n * CLASSES * CLASSES).reshape(n, -1)
    out[:, : CLASSES * CLASSES] = np.sqrt(pairs / np.maximum(size - 1, 1)[:, None])
    k = CLASSES * CLASSES
    for table, at in ((SPACE_WORDS, k), (_LINES, k + 8)):
        start, end, first = spans(buf, off, table)
        count = np.diff(first)
        per = np.maximum(count, 1)
        if not len(start):
            continue
        owner = np.repeat(np.arange(n), count)
        share = lambda x: np.bincount(owner, x, n) / per  # noqa: B023, E731
        h = hash_spans(buf, start, end)
        distinct = np.unique(mix(h + mix(owner.astype(np.uint64))), return_index=True)[1]
        out[:, at] = 1 - np.bincount(owner[distinct], minlength=n) / per  # repeats
        length = end - start
        out[:, at + 1] = np.log1p(share(length))
        if at == k:
            tail = c[end - 1]
            out[:, at + 2] = share((tail == 5) & (length > 1))
            out[:, at + 3] = share((c[start] == 1) & (tail == 1))
            out[:, at + 4] = share(length == 1)
            out[:, at + 5] = share(length > 20)
            out[:, at + 6] = np.log1p(count)
            out[:, at + 7] = share(c[start] == 5)
        else:
            out[:, at + 2] = share(c[end - 1] == 5)
            out[:, at + 3] = share(length < 20)
    return out


@dataclass
class Scorer:
    """A small network on standardised features; score is its logistic output."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float = field(default=0.5)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sums run in one order for each row: a matrix product's last bits would depend on the rows beside it."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.einsum("ij,j->i", np.tanh(np.einsum("ij,jk->ik", z, self.w1) + self.b1), self.w2) + self.b2

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.round(1 / (1 + np.exp(-np.clip(self.raw(x.astype(np.float64)), -30, 30))), 12)


def fit_risk(pos: np.ndarray, unl: np.ndarray, prior: float, hidden: int = 16, epochs: int = 40, batch: int = 256, rate: float = 3e-3, decay: float = 1e-4, seed: int = 11) -> Scorer:
    """Minimise the non-negative risk with Adam."""
    rng = np.random.default_rng(seed)
    every = np.concatenate([pos, unl]).astype(np.float64)
    mean, scale = every.mean(0), every.std(0) + 1e-3
    d = every.shape[1]
    params = [rng.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m1, m2, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    zp, zu = (np.clip((x - mean) / scale, -8, 8) for x in (pos, unl))
    sig = lambda v: 1 / (1 + np.exp(-np.clip(v, -30, 30)))
    for _ in range(epochs):
        op, ou = rng.permutation(len(zp)), rng.permutation(len(zu))
        steps = max(1, len(zu) // batch)
        for s in range(steps):
            xu = zu[ou[s * len(zu) // steps : (s + 1) * len(zu) // steps]]
            take = np.arange(s * len(xu), s * len(xu) + max(1, min(len(xu), len(zp)))) % len(zp)
            x = np.concatenate([zp[op[take]], xu])
            n = len(take)
            h = np.tanh(x @ params[0] + params[1])
            f = h @ params[2] + params[3][0]
            fp, fu = f[:n], f[n:]
            negative = np.mean(np.logaddexp(0, fu)) - prior * np.mean(np.logaddexp(0, fp))
            g = np.zeros(len(f))
            if negative >= 0:
                g[:n] = -prior * sig(-fp) / n - prior * sig(fp) / n
                g[n:] = sig(fu) / len(fu)
            else:
                g[:n] = prior * sig(fp) / n
                g[n:] = -sig(fu) / len(fu)
            gh = g[:, None] * params[2] * (1 - h * h)
            grads = [x.T @ gh + decay * params[0], gh.sum(0), h.T @ g + decay * params[2], np.array([g.sum()])]
            t += 1
            for i, gr in enumerate(grads):
                m1[i] = 0.9 * m1[i] + 0.1 * gr
                m2[i] = 0.999 * m2[i] + 0.001 * gr * gr
                params[i] = params[i] - rate * (m1[i] / (1 - 0.9**t)) / (np.sqrt(m2[i] / (1 - 0.999**t)) + 1e-8)
    return Scorer(mean, scale, params[0], params[1], params[2], float(params[3][0]), prior)


def estimate_prior(pos: np.ndarray, unl: np.ndarray, seed: int = 5) -> float:
    """An upper bound of the share of positives in U that a first scorer supports."""
    rng = np.random.default_rng(seed)
    p, u = rng.permutation(pos), rng.permutation(unl)
    a, b = len(p) // 2, len(u) // 2
    if a < 10 or b < 10:
        return 0.5
    first = fit_risk(p[:a], u[:b], 0.5, epochs=15)
    sp, su = np.sort(first(p[a:]))[::-1], np.sort(first(u[b:]))[::-1]
    k = np.arange(max(10, len(sp) // 2), len(sp) + 1)
    share_p = k / len(sp)
    share_u = np.searchsorted(-su, -sp[k - 1], "right") / len(su)
    margin = np.sqrt(np.log(20) / (2 * len(sp))) + np.sqrt(np.log(20) / (2 * len(su)))
    at = np.argmin((share_u + margin) / share_p)
    return float(np.clip(share_u[at] / share_p[at], 0.05, 0.95))


def sampled(ids: Column, most: int, n: int) -> Column:
    """About ``most`` of n ids by their hash, all of them where there are no more."""
    return F.lit(True) if n <= most else F.xxhash64(ids, F.lit(42)) < F.lit(most * 2**64 // n - 2**63)


VECTORS = "positive boolean, x binary"


def fit(docs: DataFrame, labels: DataFrame, trainable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_positive: int = 5000, max_unlabelled: int = 10000, prior: float | None = None) -> Scorer:
    """Fit on the rows that ``trainable`` (of the id) holds for."""
    train = docs.where(trainable)
    ones = labels.where(trainable & (F.col(label_col) == 1)).select(F.col(id_col).alias("_id")).where("_id is not null").distinct()

    def bounded(ids: DataFrame, most: int) -> DataFrame:
        return ids.where(sampled(F.col("_id"), most, ids.count()))

    pos = bounded(ones, max_positive).select("_id", F.lit(True).alias("positive"))
    unl = bounded(train.select(F.col(id_col).alias("_id")).where("_id is not null"), max_unlabelled).distinct().select("_id", F.lit(False).alias("positive"))
    wanted = F.broadcast(pos.unionByName(unl))  # at most about max_positive + max_unlabelled ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([r.tobytes() for r in features(buf, off)], pa.binary())], ["positive", "x"])

    rows = train.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(wanted, "_id").select("positive", "_text").mapInArrow(run, VECTORS).collect()
    rows.sort(key=lambda r: (r["positive"], bytes(r["x"])))  # whatever order the tasks ended in
    x = {k: np.array([np.frombuffer(r["x"], np.float32) for r in rows if r["positive"] == k]) for k in (True, False)}
    if not len(x[True]) or not len(x[False]):
        p = 0.5 if prior is None else prior
        return Scorer(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros((N_FEATURES, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))), p)
    p = estimate_prior(x[True], x[False]) if prior is None else prior
    return fit_risk(x[True], x[False], p)


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(scorer(features(buf, off)))], ["_id", "score"])

    return docs.selectExpr(f"cast(`{id_col}` as long) _id", f"`{text_col}` _text").mapInArrow(run, "_id long, score double")


def keep_good(docs: DataFrame, scorer: Scorer, least: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs that score at least ``least``, all columns as they are."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in chunks(batch.column(at)):
                yield batch.slice(i, j - i).filter(pa.array(scorer(features(buf, off)) >= least))

    return docs.mapInArrow(run, docs.schema)
