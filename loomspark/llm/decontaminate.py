"""Benchmark decontamination: BM25 over test items with block-max WAND bounds.

Test items are indexed, training passages are the queries.  Impacts are BM25 term weights
divided by the item's score for its own text, so the threshold is a share of a perfect match.
Items lie in blocks; a block knows the largest impact of each term in it.

A passage (a window of words, half overlapping the next) is taken in four steps that only
drop what cannot reach the threshold:
1. the passage's terms are put in the order of their largest impacts; the pivot is the first with which
   the sum of these bounds reaches the threshold, and only the terms from it on open blocks;
2. a (passage, block) stays if these terms' maxima in the block and the bounds of the others reach it;
3. it stays if the maxima in the block of all its terms reach it;
4. items of the blocks that stay get exact scores.
All items above the threshold are then verified: the share of five-word shingles of the item's
question (all but its last sentence) and of its answer (the last sentence; of a single
sentence, its last third of words) that the text has in the passage's neighbourhood.

The index holds up to INDEX_ITEMS items; more items are taken in several passes, so what tasks
receive does not grow with the benchmark.  What BM25 weighs by (number, mean and longest length of
the items, document frequencies) and the window are counted over all items first.

Defined cases: null and empty texts and items match nothing; items of fewer than five words
have one shingle; repeated items each report; a text that matches an item in several verified
passages reports the best; ties go to the earlier passage; an empty table on either side gives no
rows; other columns play no part.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORDS, chain, chunks, hash_spans, runs, shingles, spans

INDEX_ITEMS = 20_000
BLOCK = 8
SHINGLE = 5
PAIRS_AT_ONCE = 1 << 14
K1, B = 1.2, 0.75


def _words(texts: list[str]) -> list[np.ndarray]:
    out = []
    for _, _, buf, off in chunks(pa.array(texts, pa.large_string()), 1 << 40):
        start, end, first = spans(buf, off, ALNUM_WORDS)
        h = hash_spans(buf, start, end)
        out += [h[a:b] for a, b in zip(first, first[1:], strict=False)]
    return out


def _set(h: np.ndarray) -> np.ndarray:
    return np.unique(shingles(h, np.array([0, len(h)]), SHINGLE)[0])


def _share(part: tuple[int, np.ndarray], near: np.ndarray, grams: dict[int, np.ndarray]) -> float:
    """The share of a part's shingles that the words near a passage have; a short part is one run of words.

    grams keeps the runs of near's words by their length.
    """
    k, own = part
    if not len(own):
        return 1.0
    if k not in grams:
        grams[k] = np.sort(chain(near, k))
    have = grams[k]
    if not len(have):
        return 0.0
    return int((have[np.minimum(np.searchsorted(have, own), len(have) - 1)] == own).sum()) / len(own)


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the last sentence answers what stands before it."""
    parts = [p for p in text.replace("?", "?\0").replace(".", ".\0").replace("!", "!\0").split("\0") if p.strip()]
    if len(parts) > 1:
        return "".join(parts[:-1]), parts[-1]
    w = text.split()
    n = max(1, len(w) // 3)
    return " ".join(w[:-n]), " ".join(w[-n:])


class Stats:
    """Over all items with words: their number, words, longest length, and in how many each term is."""

    def __init__(self, parts: Iterator[list[tuple[int, str]]] | list[list[tuple[int, str]]]):
        self.n = self.words = self.longest = 0
        self.terms, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for items in parts:
            words = [w for w in _words([t for _, t in items]) if len(w)]
            self.n += len(words)
            self.words += sum(map(len, words))
            self.longest = max([self.longest, *map(len, words)])
            own, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *map(np.unique, words)]), return_counts=True)
            self.terms, at = np.unique(np.concatenate([self.terms, own]), return_inverse=True)
            self.count = np.bincount(at, np.concatenate([self.count, count]), len(self.terms)).astype(np.int64)

    def of(self, terms: np.ndarray) -> np.ndarray:
        return self.count[np.searchsorted(self.terms, terms)]


class Index:
    def __init__(self, items: list[tuple[int, str]], threshold: float, stats: Stats):
        words = _words([t for _, t in items])
        order = sorted((i for i in range(len(items)) if len(words[i])), key=lambda i: words[i][0])
        self.ids = [items[i][0] for i in order]
        words = [words[i] for i in order]
        self.threshold = threshold
        halves = [split_item(items[i][1]) for i in order]
        self.question, self.answer = ([(min(SHINGLE, len(h)), _set(h)) for h in _words([x[k] for x in halves])] for k in (0, 1))
        n = stats.n
        self.window = max(32, 2 * stats.longest)
        self.terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *words]))
        df = dict(zip(self.terms.tolist(), stats.of(self.terms).tolist(), strict=True))
        mean = stats.words / max(1, n)
        self.impact: list[dict[int, float]] = []
        number = {t: i for i, t in enumerate(sorted(df))}
        for w in words:
            tf = Counter(w.tolist())
            score = {number[t]: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(w) / mean)) for t, f in tf.items()}
            whole = sum(score.values())
            self.impact.append({t: s / whole for t, s in score.items()})
        best: dict[tuple[int, int], float] = defaultdict(float)
        for i, own in enumerate(self.impact):
            for t, s in own.items():
                best[t, i // BLOCK] = max(best[t, i // BLOCK], s)
        # terms by their largest impact in any block, and each one's blocks
        self.blocks = -(-len(words) // BLOCK)
        in_block: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for (t, b), s in best.items():
            in_block[t].append((b, s))
        most = np.array([max(s for _, s in in_block[t]) for t in range(len(df))])
        order = np.argsort(most, kind="stable")
        self.rank, self.most = np.argsort(order, kind="stable"), most[order]
        flat = [x for t in order.tolist() for x in sorted(in_block[t])]
        self.count = np.array([len(in_block[t]) for t in order.tolist()], np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.post_block, self.post_max = np.array([b for b, _ in flat], np.int64), np.array([s for _, s in flat])
        self.post_key = np.repeat(np.arange(len(order)), self.count) * self.blocks + self.post_block

    def search(self, buf: np.ndarray, off: np.ndarray, question: float, answer: float) -> list[tuple[int, int, float, float, float]]:
        """(text, item number, score, question share, answer share) of the items, each by its best verified passage."""
        if not len(self.terms) or not len(buf):
            return []
        start, end, first = spans(buf, off, ALNUM_WORDS)
        if not len(start):
            return []
        h = hash_spans(buf, start, end)
        at = np.searchsorted(self.terms, h)
        at[at == len(self.terms)] = 0
        hit = np.flatnonzero(self.terms[at] == h)
        if not len(hit):
            return []
        term = at[hit]
        n_words = np.diff(first)
        step = self.window // 2
        n_win = np.maximum(1, -(-n_words // step))  # windows of a text start at multiples of step
        win_first = np.zeros(len(n_win) + 1, np.int64)
        np.cumsum(n_win, out=win_first[1:])
        doc = np.searchsorted(first, hit, "right") - 1
        pos = (hit - first[doc]) // step
        win = win_first[doc] + pos
        rank = self.rank[term]
        also = pos > 0
        code = np.unique(np.concatenate([win, win[also] - 1]) * len(self.terms) + np.concatenate([rank, rank[also]]))
        w, r = np.divmod(code, len(self.terms))
        # the pivot: of a passage's terms from the smallest bound on, the first with which their sum can reach the threshold
        total = np.cumsum(self.most[r])
        at = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        size = np.diff(np.append(at, len(w)))
        total -= np.repeat(total[at] - self.most[r[at]], size)
        opens = total >= self.threshold - 1e-9
        before = np.zeros(win_first[-1] + 1, np.int64)  # how many terms stand before the pivot, and where they begin
        begin = np.zeros(win_first[-1] + 1, np.int64)
        before[w[at]], begin[w[at]] = np.add.reduceat(~opens, at, dtype=np.int64), at
        rest = np.where(before > 0, total[np.maximum(begin + before - 1, 0)], 0.0)
        w, t = w[opens], r[opens]
        count = self.count[t]
        post = runs(self.first[t], count)
        pair = np.repeat(w, count) * self.blocks + self.post_block[post]
        if not len(pair):
            return []
        order = np.argsort(pair, kind="stable")
        pair, bound = pair[order], self.post_max[post][order]
        new = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        bound = np.add.reduceat(bound, new)
        pair = pair[new]
        may = bound + rest[pair // self.blocks] >= self.threshold - 1e-9
        pair, bound = pair[may], bound[may]
        stays = np.zeros(len(pair), bool)
        for k in range(0, len(pair), PAIRS_AT_ONCE):  # the other terms' maxima in the block itself
            w, b = np.divmod(pair[k : k + PAIRS_AT_ONCE], self.blocks)
            n = before[w]
            key = r[runs(begin[w], n)] * self.blocks + np.repeat(b, n)
            place = np.minimum(np.searchsorted(self.post_key, key), len(self.post_key) - 1)
            more = np.where(self.post_key[place] == key, self.post_max[place], 0.0)
            stays[k : k + PAIRS_AT_ONCE] = bound[k : k + PAIRS_AT_ONCE] + np.bincount(np.repeat(np.arange(len(w)), n), more, len(w)) >= self.threshold - 1e-9
        out: dict[tuple[int, int], tuple[float, float, float]] = {}
        seen: tuple[int, set] = (-1, set())
        for p in pair[stays].tolist():
            w, b = divmod(p, self.blocks)
            d = int(np.searchsorted(win_first, w, "right")) - 1
            lo = int(first[d]) + (w - int(win_first[d])) * step
            hi = min(lo + self.window, int(first[d + 1]))
            if seen[0] != w:
                x, y = np.searchsorted(hit, [lo, hi])
                seen = (w, set(term[x:y].tolist()))
            near, grams = None, {}
            for i in range(b * BLOCK, min((b + 1) * BLOCK, len(self.ids))):
                s = sum(v for t, v in self.impact[i].items() if t in seen[1])
                if s < self.threshold - 1e-9 or ((d, i) in out and out[d, i][0] >= s):
                    continue
                if near is None:
                    near = h[max(int(first[d]), lo - step) : min(hi + step, int(first[d + 1]))]
                q = _share(self.question[i], near, grams)
                if q >= question and (a := _share(self.answer[i], near, grams)) >= answer:
                    out[d, i] = (s, q, a)
        return [(d, i, *v) for (d, i), v in sorted(out.items())]


HITS = "_id long, item_id long, score double, question_share double, answer_share double"


def _shards(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    rows = items.where(F.col(text_col).isNotNull() & F.col(item_col).isNotNull()).select(F.col(item_col).cast("long"), F.col(text_col)).toLocalIterator()
    rows = ((r[0], r[1]) for r in rows)
    while part := list(islice(rows, INDEX_ITEMS)):
        yield part


def _indexes(docs: DataFrame, items: DataFrame, item_col: str, item_text: str, threshold: float) -> Iterator:
    """The index of each part of the items, sent to the tasks; at most INDEX_ITEMS items each."""
    stats = Stats(_shards(items, item_col, item_text))
    for part in _shards(items, item_col, item_text):
        yield docs.sparkSession.sparkContext.broadcast(Index(part, threshold, stats))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = 0.5, question: float = 0.5, answer: float = 0.5) -> DataFrame:
    """One row per text and verified item, see HITS."""
    picked = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    out = docs.sparkSession.createDataFrame([], HITS)
    for index in _indexes(docs, items, item_col, item_text, threshold):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            own = index.value
            for batch in batches:
                for i, _, buf, off in chunks(batch.column(1)):
                    hits = [(d, own.ids[k], s, q, a) for d, k, s, q, a in own.search(buf, off, question, answer)]
                    if hits:
                        d, *cols = zip(*hits, strict=True)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i + x for x in d])), *map(pa.array, cols)], ["_id", "item_id", "score", "question_share", "answer_share"])

        out = out.unionByName(picked.mapInArrow(run, HITS))
    return out


def without_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = 0.5, question: float = 0.5, answer: float = 0.5) -> DataFrame:
    """docs without the rows that hold a test item; a pass over the rows themselves, whatever their ids."""
    at, out = docs.columns.index(text_col), docs
    for index in _indexes(docs, items, item_col, item_text, threshold):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, j, buf, off in chunks(batch.column(at)):
                    keep = np.ones(j - i, bool)
                    keep[[h[0] for h in index.value.search(buf, off, question, answer)]] = False
                    yield batch.slice(i, j - i).filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
