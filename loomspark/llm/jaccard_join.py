"""N-gram Jaccard self-join by chosen paths, with classes of linked texts.

Each text is the set of its five-word shingles (lower-cased words between white space; a
text of fewer words is one shingle).  Texts with equal sets form one node.  A node has T
sampled tokens: for each of T hash functions the shingle that it makes smallest.

In each run a node starts in one bucket and moves on, from a bucket too large to compare, to
the buckets of the (coordinate, token) pairs that the bucket's own random choice draws; a
coordinate is drawn with probability 1 / (threshold * T), so a pair at the threshold is expected
to stay together in one child.  Buckets of up to BUCKET nodes are compared at once on short
signatures, and give out a heaviest spanning forest of their candidates.  The number of runs
follows from the target recall and the depth of the recursion; where it went deeper than was
reckoned with, the runs that are missing for that depth follow.

Dense groups.  Buckets above BUCKET name a hub (a member that a hash draws, another one in each
bucket).  Each member meets the hub; who the signatures put well within the threshold (SURE) leaves
with it, everyone else moves on, however deep.  As every level takes the hub and those with it
out, all buckets end, and none is cut off.  Who leaves shares at least threshold + SURE of its tokens
with the hub, so a candidate of it (threshold - LOOSE) shares at least the sum of both less 1 with the
hub: the shares of different tokens are distances, and no way round is shorter.  The hub is therefore
tied to all members that share that much (star), and who leaves is parted from no candidate.

So the pairs tell which nodes candidates connect, not which candidates there are.  All nodes of
such a component are then compared with one another by the exact Jaccard of their whole sets, in
blocks of bounded size, dealt by pairs of blocks; blocks whose sizes can't reach the threshold
don't meet.  A task counts the links of each node and writes only a spanning forest of them, so
numbers of links are those of all pairs and no table holds the pairs.

Buckets are counted by partial aggregation first, single ones leave at once, and large ones are
never gathered: they only get their hub by a join.  Members are (bucket, node) numbers; tokens are
joined to those that are left.

Defined cases: null and empty texts (no words) are linked with nothing; repeated rows are
copies of one another; ties go to the smaller id; nodes have numbers of their own, so ids may
repeat, lack or be of any size (a class without any id has none); an empty table gives no rows; other
columns play no part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORDS, chunks, cut, hash_spans, join_counted, mix, runs, scratch, shingles, spans

T = 64
K = 5
SMALL, LARGE = 320, 512  # sets up to LARGE get full min-hashes, from SMALL on one-permutation ones: both in between
BUCKET = 2048
DEPTH = 5
LOOSE, SURE = 0.15, 0.08  # by how much a signature may fall short of the threshold, and be above it for a member to leave with the hub
STEP, LIGHT = 1 << 18, 256  # shingles of a block of a component, and how many a member counts for at least
_rng = np.random.default_rng(77)
_ODD = _rng.integers(0, 2**63, T, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_COORD = mix(np.arange(1, T + 1, dtype=np.uint64))
_EDGE = (np.arange(T, dtype=np.uint64) << np.uint64(58))


def runs_for(recall: float, depth: int = DEPTH) -> int:
    """Runs needed: a pair at the threshold survives a level with 1 - exp(-survival of the next)."""
    q = 1.0
    for _ in range(depth):
        q = 1 - math.exp(-q)
    return math.ceil(math.log(1 - recall) / math.log(1 - q))


def minhash(u: np.ndarray) -> np.ndarray:
    """Full min-hashes of a set of 64-bit hashes."""
    return ((u[:, None] * _ODD) >> np.uint64(32)).min(0).astype(np.uint32)


def onehash(u: np.ndarray) -> np.ndarray:
    """One-permutation min-hashes of a sorted set; an empty bin takes the next full one's, marked by the distance."""
    at = np.searchsorted(u, _EDGE)
    full = np.diff(np.append(at, len(u))) > 0
    out = (u[np.minimum(at, len(u) - 1)] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    if not full.all():
        have = np.flatnonzero(full)
        for i in np.flatnonzero(~full):
            j = have[np.searchsorted(have, i) % len(have)]
            out[i] = out[j] ^ np.uint32((((j - i) % T) * 0x9E3779B1) & 0xFFFFFFFF)
    return out


def _sets(buf: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    start, end, words = spans(buf, off, SPACE_WORDS)
    s, first = shingles(hash_spans(buf, start, end), words, K)
    for a, b in zip(first, first[1:], strict=False):
        u = np.sort(s[a:b])
        if len(u):
            new = np.ones(len(u), bool)
            new[1:] = u[1:] != u[:-1]
            u = u[new]
        yield u


SKETCH = "_id long, digest binary, n int, small binary, large binary"


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: digest of its shingle set, the set's size and its tokens; digest is null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in chunks(batch.column(1)):
                digest, size, small, large = [], [], [], []
                for u in _sets(buf, off):
                    n = len(u)
                    size.append(n)
                    digest.append(hashlib.blake2b(u.tobytes(), digest_size=16).digest() if n else None)
                    small.append(minhash(u).tobytes() if 0 < n <= LARGE else None)
                    large.append(onehash(u).tobytes() if n >= SMALL else None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(digest, pa.binary()), pa.array(size, pa.int32()), pa.array(small, pa.binary()), pa.array(large, pa.binary())], ["_id", "digest", "n", "small", "large"])

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, SKETCH)


MEMBERS = "key long, ref long"
_KEYS = pa.schema([("key", pa.int64()), ("ref", pa.int64())])
#: ref is twice the node, plus 1 for its one-permutation tokens.
TOKENS = "ref long, tokens binary"


def _sig(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint32).reshape(-1, T)


def _children(paths: np.ndarray, sig: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and keys of the children that the paths draw; sig: tokens of each row."""
    drawn = mix(paths[:, None] + _COORD) < np.uint64(int(2**64 / (threshold * T)))
    row, coord = np.nonzero(drawn)
    return row, mix(mix(paths[row] ^ _COORD[coord]) + sig[row, coord].astype(np.uint64))


def _start(first: int, last: int, threshold: float):
    """Members of the first buckets of the runs from first up to last."""
    roots = mix(np.arange(first + 1, last + 1, dtype=np.uint64) * np.uint64(0x51ED270B))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ref, sig = np.array(batch.column(0)), _sig(batch.column(1))
            for r in roots:
                row, key = _children(r + (ref & 1).astype(np.uint64), sig, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ref[row])], schema=_KEYS)

    return run


def _next(threshold: float):
    """Children of the members of large buckets: key, ref, tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ref = np.array(batch.column(1))
            row, key = _children(np.array(batch.column(0)).view(np.uint64), _sig(batch.column(2)), threshold)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ref[row])], schema=_KEYS)

    return run


PAIRS = "a long, b long"
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Node pairs of ref pairs, the smaller first."""
    a, b = a >> 1, b >> 1
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=_PAIR)


def _same(sig: np.ndarray) -> np.ndarray:
    """How many tokens each two rows share."""
    out = np.zeros((len(sig), len(sig)), np.uint8)
    for c in np.ascontiguousarray(sig.T):
        out += c[:, None] == c
    return out


def _forest(same: np.ndarray, low: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of a heaviest spanning forest of the links of at least low, grown from row 0."""
    n = len(same)
    best, by = same[0].astype(np.int16), np.zeros(n, np.int64)
    best[0] = -1
    a, b = [], []
    for _ in range(n - 1):
        i = int(best.argmax())
        if best[i] >= low:
            a.append(i)
            b.append(int(by[i]))
        row = same[i]
        nearer = row > best
        nearer &= best >= 0
        best[nearer] = row[nearer]
        by[nearer] = i
        best[i] = -1
    return np.array(a, np.int64), np.array(b, np.int64)


def _compare(threshold: float):
    """Candidates of small buckets: a forest of each.

    Rows are key, ref, tokens, sorted by key; a bucket may cross batches.
    """
    low = (threshold - LOOSE) * T

    def done(key, ref, sig):
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(at, len(key)))
        two = at[size == 2]
        two = two[(sig[two] == sig[two + 1]).sum(1) >= low]
        yield _pairs(ref[two], ref[two + 1])
        for x, n in zip(at[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            a, b = _forest(_same(sig[x : x + n]), low)
            yield _pairs(ref[x + a], ref[x + b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.array(batch.column(0)), np.array(batch.column(1)), _sig(batch.column(2))
            if kept:
                rows = tuple(np.concatenate([k, x]) for k, x in zip(kept.pop(), rows, strict=True))
            last = int(np.flatnonzero(rows[0] != rows[0][-1])[-1]) + 1 if rows[0][0] != rows[0][-1] else 0
            kept.append(tuple(x[last:] for x in rows))
            if last:
                yield from done(*(x[:last] for x in rows))
        if kept:
            yield from done(*kept.pop())

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        rows = 0
        for out in run(batches):
            waiting.append(out)
            rows += out.num_rows
            if rows >= 1 << 14 or len(waiting) >= 1 << 12:
                yield pa.Table.from_batches(waiting).combine_chunks().to_batches(1 << 30)[0] if rows else waiting[0]
                waiting, rows = [], 0
        if rows:
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches(1 << 30)[0]

    return merged


def _meet(threshold: float, what: str):
    """Of rows key, ref, hub, tokens, hub_tokens: the star of the hub, or the members that do not leave with it ("rest")."""
    star = (threshold - LOOSE) + (threshold + SURE) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key, ref, hub = (np.array(batch.column(i)) for i in range(3))
            same = (_sig(batch.column(3)) == _sig(batch.column(4))).sum(1)
            other = ref >> 1 != hub >> 1
            if what == "rest":
                pick = other & (same < (threshold + SURE) * T)
                yield pa.RecordBatch.from_arrays([pa.array(key[pick]), pa.array(ref[pick])], schema=_KEYS)
            else:
                pick = other & (same >= star * T)
                yield _pairs(ref[pick], hub[pick])

    return run


def _wide(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _by_bucket(rows: DataFrame, wide: int) -> DataFrame:
    return rows.repartition(wide, "key").sortWithinPartitions("key")


def candidates(tokens: DataFrame, threshold: float, recall: float, depth: int = DEPTH) -> DataFrame:
    """Pairs that connect all nodes which candidates connect.  tokens: see TOKENS."""
    with scratch(tokens.sparkSession):
        return _candidates(tokens, threshold, recall, depth)


def _candidates(tokens: DataFrame, threshold: float, recall: float, depth: int) -> DataFrame:
    every, found = tokens, []
    done, wanted = 0, runs_for(recall, depth)
    while done < wanted:
        tokens, level = every, 0
        members = cut(every.mapInArrow(_start(done, wanted, threshold), MEMBERS), "members")
        while True:
            level += 1
            sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min_by("ref", F.xxhash64("key", F.shiftright("ref", 1))).alias("hub")).where("size > 1")
            sized = cut(members.join(sizes, "key").select("key", "ref", "size", "hub"), "buckets")
            few = sized.where(F.col("size") <= BUCKET)
            found.append(_by_bucket(few.join(tokens, "ref").select("key", "ref", "tokens"), _wide(tokens)).mapInArrow(_compare(threshold), PAIRS))
            many = sized.where(F.col("size") > BUCKET)
            if many.isEmpty():
                break
            tokens = cut(tokens.join(many.select("ref").distinct(), "ref", "left_semi"), "tokens")  # deeper members come from these
            hub = tokens.select(F.col("ref").alias("hub"), F.col("tokens").alias("hub_tokens"))
            met = cut(many.join(tokens, "ref").join(hub, "hub").select("key", "ref", "hub", "tokens", "hub_tokens"), "met")
            found.append(met.mapInArrow(_meet(threshold, "pairs"), PAIRS))
            rest = met.mapInArrow(_meet(threshold, "rest"), MEMBERS)
            members = cut(rest.join(tokens, "ref").select("key", "ref", "tokens").mapInArrow(_next(threshold), MEMBERS), "members")
        depth = max(depth, level)
        done, wanted = wanted, max(wanted, runs_for(recall, depth))
    return cut(_union(found).distinct(), "pairs", result=True)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that links lead to; of nodes that have links.

    Links are first contracted in runs of CONTRACT, so a dense group has few left.  Labels go along the links and are then shortened by their own labels, so chains end in
    a number of steps that is logarithmic in their length.
    """
    with scratch(links.sparkSession):
        return _components(links, a, b)


#: Links that one task contracts.
CONTRACT = 1 << 15


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a, b to the smallest node instead, among those that a task's links connect."""
    parts = [(np.array(x.column(0)), np.array(x.column(1))) for x in batches if x.num_rows]
    if not parts:
        return
    a, b = (np.concatenate(c) for c in zip(*parts, strict=True))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (a, b, label[a], label[b]):
            np.minimum.at(new, x, least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[label[own]]), pa.array(nodes[own])], schema=_PAIR)


def _components(links: DataFrame, a: str, b: str) -> DataFrame:
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b"))
    links = cut(links.repartition(max(1, -(-links.count() // CONTRACT))).mapInArrow(_contract, PAIRS), "forests")
    a, b = "a", "b"
    edges = cut(links.selectExpr(f"{a} x", f"{b} y").unionByName(links.selectExpr(f"{b} x", f"{a} y")).distinct(), "edges")
    labels = cut(edges.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("component")), "labels")
    while True:
        near = edges.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("component").alias("least"))
        own = labels.withColumnRenamed("component", "was").join(near, F.col("node") == F.col("x"), "left").select("node", "was", F.least("was", "least").alias("now"))
        own = cut(own, "labels")
        up = own.select(F.col("node").alias("p"), F.col("now").alias("root"))
        step = cut(own.join(up, F.col("now") == F.col("p"), "left").select("node", "was", F.least("now", F.coalesce("root", "now")).alias("component")), "labels")
        if step.where("component <> was").isEmpty():
            return cut(step.select("node", "component"), "components", result=True)
        labels = step.select("node", "component")


def blocks(members: DataFrame, threshold: float) -> DataFrame:
    """node, component, block, lo, hi: blocks of a component by the sets' sizes, and the first and last that a block meets.

    members: node, component, n.
    """
    with scratch(members.sparkSession):
        return _blocks(members, threshold)


def _blocks(members: DataFrame, threshold: float) -> DataFrame:
    weight = F.greatest("n", F.lit(LIGHT)).cast("long")
    by_size = Window.partitionBy("component").orderBy("n", "node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = cut(members.select("node", "component", "n", F.floor((F.sum(weight).over(by_size) - weight) / STEP).cast("int").alias("block")), "blocks")
    ends = placed.groupBy("component", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    other = ends.selectExpr("component", "block other", "least other_least", "most other_most")
    meets = F.when(F.col("block") <= F.col("other"), F.col("other_least") * threshold - 1e-6 <= F.col("most")).otherwise(F.col("least") * threshold - 1e-6 <= F.col("other_most"))
    reach = ends.join(other, "component").where(meets).groupBy("component", "block").agg(F.min("other").alias("lo"), F.max("other").alias("hi"))
    return cut(placed.join(reach, ["component", "block"]).select("node", "component", "block", "lo", "hi"), "blocks", result=True)


SHARED = "component long, x int, y int, block int, node long, shingles binary"
_SHARED = pa.schema([("component", pa.int64()), ("x", pa.int32()), ("y", pa.int32()), ("block", pa.int32()), ("node", pa.int64()), ("shingles", pa.binary())])
OUT_BYTES = 1 << 22


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of node, component, block, lo, hi, text: the set for each pair of blocks, see SHARED."""
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        node, component, block, lo, hi = (batch.column(i).to_pylist() for i in range(5))
        for i, _, buf, off in chunks(batch.column(5)):
            for k, u in enumerate(_sets(buf, off), i):
                if not len(u):
                    continue
                raw = u.tobytes()
                for other in range(lo[k], hi[k] + 1):
                    rows.append((component[k], min(block[k], other), max(block[k], other), block[k], node[k], raw))
                    held += len(raw)
                    if held >= OUT_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _SHARED, strict=True)], schema=_SHARED)
                        rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _SHARED, strict=True)], schema=_SHARED)


def in_both(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """How many elements each set of left shares with each of right (None: of left)."""
    every = left + (right or [])
    flat = np.concatenate(every)
    row = np.repeat(np.arange(len(every)), [len(u) for u in every])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    n_left = n_right = np.diff(np.append(first, len(flat)))
    at = first
    if right is not None:
        n_left = np.add.reduceat((row < len(left)).astype(np.int64), first)
        n_right = n_right - n_left
        at = first + n_left
    some = (n_left * n_right > 0) if right is not None else n_left > 1
    first, at, n_left, n_right = first[some], at[some], n_left[some], n_right[some]
    a, b = row, row if right is None else row - len(left)
    out = np.zeros((len(left), len(left) if right is None else len(right)))
    few = n_left * n_right <= 64
    flat_out = out.reshape(-1)
    rare = np.flatnonzero(few)
    for k in range(0, len(rare), 4096):
        g = rare[k : k + 4096]
        i = np.repeat(a[runs(first[g], n_left[g])], np.repeat(n_right[g], n_left[g]))
        j = b[runs(np.repeat(at[g], n_left[g]), np.repeat(n_right[g], n_left[g]))]
        np.add.at(flat_out, i * out.shape[1] + j, 1.0)
    often = np.flatnonzero(~few)
    for k in range(0, len(often), 1024):  # a part's counts are exact in 32 bits
        g = often[k : k + 1024]
        x = np.zeros((len(left), len(g)), np.float32)
        x[a[runs(first[g], n_left[g])], np.repeat(np.arange(len(g)), n_left[g])] = 1
        y = x
        if right is not None:
            y = np.zeros((len(right), len(g)), np.float32)
            y[b[runs(at[g], n_right[g])], np.repeat(np.arange(len(g)), n_right[g])] = 1
        out += x @ y.T
    return out


def _tree(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of a symmetric matrix of links."""
    new = np.ones(len(near), bool)
    a, b = [], []
    for start in np.flatnonzero(near.any(1)).tolist():
        if not new[start]:
            continue
        new[start] = False
        todo = [start]
        while todo:
            i = todo.pop()
            to = np.flatnonzero(near[i] & new)
            new[to] = False
            a += [i] * len(to)
            b += to.tolist()
            todo += to.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int | None, list[np.ndarray]]]:
    """(nodes, how many are of the first block or None for a block with itself, sets) of each pair of blocks.

    Rows are SHARED in order; a repeated node counts once.
    """
    last, of_x = (-1, -1, -1), 0
    nodes: list[int] = []
    sets: list[np.ndarray] = []
    for batch in batches:
        for component, x, y, block, node, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (component, x, y) != last:
                if len(nodes) > 1:
                    yield np.array(nodes, np.int64), None if last[1] == last[2] else of_x, sets
                last, of_x, nodes, sets = (component, x, y), 0, [], []
            if nodes and nodes[-1] == node:
                continue
            of_x += block == x
            nodes.append(node)
            sets.append(np.frombuffer(raw, np.uint64))
    if len(nodes) > 1:
        yield np.array(nodes, np.int64), None if last[1] == last[2] else of_x, sets


LINKS = "a long, b long, jaccard double"
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("jaccard", pa.float64())])
#: A link (n_links -1), or a node's number of links in a pair of blocks (b -1).
COUNTED = "a long, b long, n_links long"
_COUNTED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n_links", pa.int64())])


def _links(threshold: float, every: bool):
    """Every link (LINKS), or links that connect the same nodes and all nodes' numbers of links (COUNTED).

    Rows are as for _block_pairs; two nodes meet in one pair of blocks only, so the numbers add up.
    """
    schema = _LINK if every else _COUNTED

    def found(nodes: np.ndarray, of_x: int | None, sets: list[np.ndarray]) -> list[np.ndarray]:
        k, right = (len(sets), 0) if of_x is None else (of_x, of_x)
        size = np.array([len(u) for u in sets], float)
        both = in_both(sets[:k], None if of_x is None else sets[k:])
        share = both / (size[:k, None] + size[right:] - both)
        near = share >= threshold
        if of_x is None:
            np.fill_diagonal(near, False)
        if every:
            a, b = np.nonzero(near if of_x is not None else np.triu(near))
            jaccard, a, b = share[a, b], nodes[a], nodes[b + right]
            return [np.minimum(a, b), np.maximum(a, b), jaccard]
        if of_x is None:
            square = near
        else:
            square = np.zeros((len(sets), len(sets)), bool)
            square[:k, k:], square[k:, :k] = near, near.T
        a, b = _tree(square)
        degree = square.sum(1)
        some = np.flatnonzero(degree)
        a, b, none = nodes[a], nodes[b], np.full(len(a), -1)
        return [np.append(np.minimum(a, b), nodes[some]), np.append(np.maximum(a, b), np.full(len(some), -1)), np.append(none, degree[some])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[np.ndarray]] = []
        rows = 0
        for pair in _block_pairs(batches):
            waiting.append(found(*pair))
            rows += len(waiting[-1][0])
            if rows >= 1 << 14 or len(waiting) >= 1 << 12:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*waiting, strict=True)], schema=schema)
                waiting, rows = [], 0
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*waiting, strict=True)], schema=schema)

    return run


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, recall: float = 0.995) -> tuple[DataFrame, DataFrame]:
    """(rows, links).

    rows: _id, class_id (the smallest id of the rows that links and equal sets join), node (the smallest
    id with the same shingle set), n_links (all confirmed links of the node), n_copies (rows of the
    node), class_no (a number of the class, also where ids repeat or lack).
    links: a, b, jaccard between nodes, every link; made where it is used, as dense groups have many.
    """
    rows = cut(sketch(docs, id_col, text_col), "sketch")
    nodes = rows.where("digest is not null").groupBy("digest").agg(F.min("_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("small", True).alias("small"), F.first("large", True).alias("large"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    tokens = cut(_union([nodes.where(f"{c} is not null").select((F.col("node") * 2 + k).alias("ref"), F.col(c).alias("tokens")) for k, c in enumerate(("small", "large"))]), "tokens")
    near = components(candidates(tokens, threshold, recall))
    placed = blocks(near.join(nodes.select("node", "n"), "node"), threshold)
    wanted = placed.join(nodes.select("node", "digest"), "node")
    dealt = sketch_sets(docs, id_col, text_col, rows, wanted).repartition(_wide(docs), "component", "x", "y").sortWithinPartitions("component", "x", "y", "block", "node")
    counted = cut(dealt.mapInArrow(_links(threshold, False), COUNTED), "links")
    comp = components(counted.where("n_links < 0"))
    degree = counted.where("n_links >= 0").groupBy(F.col("a").alias("node")).agg(F.sum("n_links").alias("n_links"))
    of_node = nodes.select("digest", "node", "least", "copies").join(comp, "node", "left").join(degree, "node", "left").withColumn("class_no", F.coalesce("component", "node"))
    class_ids = of_node.groupBy("class_no").agg(F.min("least").alias("class_id"))
    of_node = cut(of_node.join(class_ids, "class_no").select("digest", "class_no", "class_id", "least", "n_links", "copies"), "classes")
    some = join_counted(rows.where("digest is not null").select("_id", "digest"), of_node, ["digest"], "copies").drop("digest")
    none = rows.where("digest is null").select("_id", *[F.lit(None).cast(of_node.schema[c].dataType).alias(c) for c in some.columns[1:]])
    out = some.unionByName(none.withColumn("class_id", F.col("_id")).withColumn("least", F.col("_id")))
    name = nodes.select("node", "least")
    links = dealt.mapInArrow(_links(threshold, True), LINKS)
    links = links.join(name.toDF("a", "id_a"), "a").join(name.toDF("b", "id_b"), "b").select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "jaccard")
    return out.select("_id", "class_id", F.col("least").alias("node"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("copies", F.lit(1)).alias("n_copies"), "class_no"), links


def sketch_sets(docs: DataFrame, id_col: str, text_col: str, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The shingle set of each wanted node for each pair of blocks, see SHARED; from one row of it, or a few equal ones.

    wanted: node, component, block, lo, hi, digest.  Texts are found by id; rows whose id is not of one
    digest alone are found by the digest of their text.
    """
    halves = [F.xxhash64("digest", F.lit(k)) for k in (1, 2)]
    per_id = rows.groupBy("_id").agg(F.first("digest").alias("digest"), F.min(F.struct(*halves)).alias("low"), F.max(F.struct(*halves)).alias("high"))
    sole = F.expr("_id is not null and low = high")
    by_id = cut(per_id.where(sole).groupBy("digest").agg(F.min("_id").alias("_id")).join(wanted, "digest"), "wanted")
    rest = cut(wanted.join(by_id.select("digest"), "digest", "left_anti"), "rest")
    picked = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = picked.join(F.broadcast(by_id) if by_id.count() <= 1_000_000 else by_id, "_id")
    if not rest.isEmpty():

        def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, j, buf, off in chunks(batch.column(0)):
                    own = [hashlib.blake2b(u.tobytes(), digest_size=16).digest() if len(u) else None for u in _sets(buf, off)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(own, pa.binary())], ["text", "digest"])

        odd = picked.join(per_id.where(~sole).select(F.col("_id").alias("_odd")), F.col("_id").eqNullSafe(F.col("_odd")), "left_semi")
        odd = odd.select("text").mapInArrow(digests, "text string, digest binary").join(rest, "digest")
        texts = texts.select("node", "component", "block", "lo", "hi", "text").unionByName(odd.select("node", "component", "block", "lo", "hi", "text"))
    return texts.select("node", "component", "block", "lo", "hi", "text").mapInArrow(_dealt, SHARED)


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, recall: float = 0.995) -> DataFrame:
    """docs with one row (the class's smallest id) of each class.

    Rows without an id stay; of rows that share an id, all stay where one of them stays.
    """
    with scratch(docs.sparkSession):
        rows, _ = jaccard_classes(docs, id_col, text_col, threshold, recall)
        lost = rows.where("_id is not null").groupBy("_id").agg(F.min(F.col("_id") != F.col("class_id")).alias("_gone")).where("_gone").select(F.col("_id").alias("_lost"))
        lost = cut(lost, "lost", result=True)
    if lost.count() <= 1_000_000:
        lost = F.broadcast(lost)
    return docs.join(lost, docs[id_col] == lost["_lost"], "left_anti")
