"""N-gram Jaccard join with count-vector R-trees.

A document's set is its distinct 5-word shingles, as 64-bit hashes. The
shingles are also hashed into groups; the counts by group are a point, and
two sets share at most the sum of the coordinate-wise minima of their points.
An R-tree over the points (a box holds the largest counts and the range of
sizes below it) finds the pairs that this bound allows.

Points alone would leave all documents of like length to one index. So an
index is built for each list of documents that share a shingle which at least
one linked pair of them must share: with all shingles in one global order,
two sets with a Jaccard similarity of t share one of the first
n - ceil(t n) + 1 of each. The order puts frequent shingles last (a bounded
list of the most frequent, from counts over all documents; a hint that
affects cost only), so lists of common passages hardly ever form.

Two searches, and neither hands on more rows than it gets:

1. Each list's tree is asked for pairs within the bound; a spanning forest of
   them leaves the task. The forests' components, the *groups*, hold every
   linked pair, and most documents are in none.
2. Each group meets once, with its sets of shingles, behind a tree of its own;
   pairs within the bound are verified, and a spanning forest of true links
   leaves the task. Its components are the answer.

Copies are one node from the start. Nothing is dropped: a list or group of any
size is searched in full. One of more than a block is laid out by size and
first searched in blocks and in blocks across their borders, which joins a
dense list from end to end. Then only rows outside its main component still
meet others, in pairs of blocks whose sizes allow a link.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, discard, few, shuffle_parts, written

SHINGLE = 5
#: Groups of a count vector.
GROUPS = 256
#: Largest count of a group that a count vector holds; it stands for all larger ones too.
CLIP = 255
#: Shingles in more documents than this go last in the global order, if they are among the MAX_FREQUENT most frequent.
FREQUENT, MAX_FREQUENT = 8, 1_000_000
#: Share of the hash range whose shingles are counted: prefixes hardly ever reach beyond it.
COUNTED = 0.4
#: Entries below a box of the R-tree; points up to which all pairs are bounded at once.
FANOUT, DENSE = 16, 48
#: Documents in a block of a list, shingles in a block of a group.
BLOCK, BLOCK_SHINGLES = 4096, 2_000_000
FLUSH = 1 << 20

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b == 0x20 or 0x09 <= b <= 0x0D else b for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _scramble(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of the base and of its inverse, as far as asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]))
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, inverse)]))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word: runs of bytes other than space, tab, and line and page breaks; A-Z are folded."""
    a = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(_FOLD), np.uint8)
    edges = np.flatnonzero(np.diff((a != 0x20).view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    out, lo = np.zeros(len(starts), np.uint64), 0
    while lo < len(starts):  # blocks of some MB, so that the tables of powers stay small
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + (1 << 22), "right")))
        first = starts[lo]
        part = a[first : ends[hi - 1]]
        up, down = _powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part + np.uint64(1)) * up[:-1], out=sums[1:])
        s, e = starts[lo:hi] - first, ends[lo:hi] - first
        out[lo:hi] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        lo = hi
    return _scramble(out)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; of all its words if they are fewer than five."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = min(len(h), SHINGLE)
    m = len(h) - n + 1
    mixed = sum((h[k : k + m] * _MIX[k] for k in range(1, n)), h[:m] * _MIX[0])
    return np.unique(_scramble(mixed + np.uint64(n)))


def signature(shingles: np.ndarray) -> bytes:
    """A 128-bit signature of the set; its first half, as a number, is the set's key in lists."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def set_key(node: bytes) -> int:
    return int.from_bytes(node[:8], "little", signed=True)


def need(a, b):
    """Least number of shared shingles of two linked sets of a and b: 100 i >= 80 (a + b - i)."""
    return (4 * (a + b) + 8) // 9


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def count_vector(shingles: np.ndarray) -> np.ndarray:
    return np.minimum(np.bincount((shingles & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS), CLIP).astype(np.uint8)


def overlap_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Most shingles that sets with these count vectors may share, by row; no bound where both counts of a group are clipped."""
    least = np.minimum(a, b)
    most = least.sum(axis=-1, dtype=np.int64)
    if least.size and least.max() >= CLIP:
        most[(least >= CLIP).any(axis=-1)] = np.iinfo(np.int64).max
    return most


def like_sized(a, b):
    return (5 * a >= 4 * b) & (5 * b >= 4 * a)


def _bucket_rows(values: list[np.ndarray], bucket_of: np.ndarray, n_buckets: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The arrays, cut by bucket."""
    order = np.argsort(bucket_of, kind="stable")
    cuts = np.searchsorted(bucket_of[order], np.arange(n_buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        part = order[cuts[b] : cuts[b + 1]]
        yield int(b), [v[part] for v in values]


def _pack_counts(values: np.ndarray, counts: np.ndarray) -> bytes:
    """How many values are counted more than once; these, their counts, and the rest."""
    many = counts > 1
    return np.concatenate([[many.sum()], values[many], counts[many], values[~many]]).astype(np.uint32).tobytes()


def _unpack_counts(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(blob, np.uint32)
    k = int(flat[0])
    return np.concatenate([flat[1 : k + 1], flat[2 * k + 1 :]]), np.concatenate([flat[k + 1 : 2 * k + 1], np.ones(len(flat) - 1 - 2 * k, np.uint32)])


def _nodes_and_counts(n_buckets: int):
    """Rows of documents (doc_id, text_hash, node, key, n, vec) and of shingle counts (bucket, blob)."""
    limit = np.uint64(int(COUNTED * 2**32))
    names = ["doc_id", "text_hash", "node", "key", "n", "vec", "bucket", "blob"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush(id_type: pa.DataType) -> pa.RecordBatch:
            # Counted before they leave, so a shingle is one number from each flush however frequent it is.
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            rows = [(b, _pack_counts(v, c)) for b, (v, c) in _bucket_rows([values, counts], values.astype(np.int64) * n_buckets // int(limit), n_buckets)]
            k = len(rows)
            held.clear()
            nothing = [pa.nulls(k, t) for t in (id_type, pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary())]
            return pa.RecordBatch.from_arrays([*nothing, pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names)

        kind = None
        for batch in batches:
            kind = batch["doc_id"].type
            nodes, sizes, vecs = [], [], []
            for text in batch["text"]:
                s = shingle_set(text.as_py())
                nodes.append(signature(s)), sizes.append(len(s)), vecs.append(count_vector(s).tobytes())
                high = (s >> np.uint64(32)).astype(np.uint32)
                held.append(high[: np.searchsorted(high, limit)])
                size += len(held[-1])
                if size >= FLUSH:
                    yield flush(kind)
                    size = 0
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text_hash"], pa.array(nodes, pa.binary()), pa.array(map(set_key, nodes), pa.int64()), pa.array(sizes, pa.int64()), pa.array(vecs, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())],
                names,
            )
        if size:
            yield flush(kind)

    return run


def _by_bucket(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Blobs of each bucket, from rows sorted by bucket."""
    at, held = None, []
    for batch in batches:
        for bucket, blob in zip(batch["bucket"].to_pylist(), batch["blob"].to_pylist(), strict=True):
            if bucket != at:
                if held:
                    yield at, held
                at, held = bucket, []
            held.append(blob)
    if held:
        yield at, held


def _frequent(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, blobs in _by_bucket(batches):
        seen, times = (np.concatenate(x) for x in zip(*map(_unpack_counts, blobs), strict=True))
        values, where = np.unique(seen, return_inverse=True)
        counts = np.bincount(where, weights=times).astype(np.int64)
        many = counts > FREQUENT
        yield pa.RecordBatch.from_arrays([pa.array(values[many].astype(np.int64)), pa.array(counts[many])], ["shingle", "n"])


def frequent_shingles(counts: DataFrame) -> np.ndarray:
    """The most frequent shingles (upper halves of their hashes), MAX_FREQUENT at most: whole count classes, the highest first."""
    parts = shuffle_parts(counts.sparkSession)
    found = counts.filter("blob is not null").select("bucket", "blob").repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_frequent, "shingle long, n long")
    found = written(found, "jaccard-frequent")
    classes = found.groupBy("n").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("n")).limit(MAX_FREQUENT).collect()
    least, total = None, 0
    for r in classes:
        total += r.k
        if total > MAX_FREQUENT:
            break
        least = r.n
    common = [] if least is None else found.filter(F.col("n") >= least).select("shingle").collect()
    discard(found)
    return np.sort(np.array([r.shingle for r in common], np.uint32))


def ordered(shingles: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, int]:
    """The set in the global order, and how many of it are not frequent."""
    if not len(frequent):
        return shingles, len(shingles)
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    late = frequent[np.minimum(np.searchsorted(frequent, high), len(frequent) - 1)] == high
    return np.concatenate([shingles[~late], shingles[late]]), int((~late).sum())


def _postings(n_buckets: int, shared):
    """(bucket, blob) of rare prefix shingles with their sets' keys; (list_id, key) of frequent ones, which form no common blob.

    A task posts each set once, however many copies it meets.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        tokens, owners, sizes, direct = [], [], [], []
        posted: set[int] = set()

        def flush() -> pa.RecordBatch:
            t, k = np.concatenate([np.zeros(0, np.uint64), *tokens]), np.repeat(np.array(owners, np.int64), np.array(sizes, np.int64))
            # Inside a bucket, the lower half of a hash tells shingles apart well enough: a mix-up makes a list longer.
            cut = _bucket_rows([t.astype(np.uint32), k], (t >> np.uint64(40)).astype(np.int64) * n_buckets >> 24, n_buckets)
            rows = [(b, x.tobytes() + y.tobytes(), None, None) for b, (x, y) in cut]
            rows += [(key % n_buckets, None, token, key) for token, key in direct]
            for held in (tokens, owners, sizes, direct):
                held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.int64(), pa.int64()))], ["bucket", "blob", "list_id", "key"]
            )

        seen = 0
        for batch in batches:
            for text in batch["text"]:
                s = shingle_set(text.as_py())
                if not len(s):
                    continue
                key, p = set_key(signature(s)), prefix_length(len(s))
                if key in posted:
                    continue
                posted.add(key)
                order, rare = ordered(s, frequent)
                tokens.append(order[: min(p, rare)]), owners.append(key), sizes.append(min(p, rare))
                direct.extend((int(t), key) for t in order[rare:p].view(np.int64))
                seen += p
                if seen >= FLUSH:
                    yield flush()
                    seen = 0
        if owners:
            yield flush()

    return run


def _shared_lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(list_id, key) of shingles that two or more sets have; equal lists of a bucket are one, named by a hash of their keys."""

    def direct() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lone = batch.filter(pa.compute.is_valid(batch["list_id"]))
            if lone.num_rows:
                passed.append(lone.select(["list_id", "key"]))
            rest = batch.filter(pa.compute.is_valid(batch["blob"]))
            if rest.num_rows:
                yield rest

    passed: list[pa.RecordBatch] = []
    for _, blobs in _by_bucket(direct()):
        yield from passed
        passed.clear()
        sizes = [len(b) // 12 for b in blobs]
        t = np.concatenate([np.frombuffer(b, np.uint32, n) for b, n in zip(blobs, sizes, strict=True)])
        k = np.concatenate([np.frombuffer(b, np.uint64, n, 4 * n) for b, n in zip(blobs, sizes, strict=True)])
        order = np.lexsort((k, t))
        t, k = t[order], k[order]
        fresh = np.concatenate([[True], (t[1:] != t[:-1]) | (k[1:] != k[:-1])])
        t, k = t[fresh], k[fresh]
        starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        lengths = np.diff(np.append(starts, len(t)))
        names = np.add.reduceat(_scramble(k + np.uint64(1)), starts)
        many = np.flatnonzero(lengths > 1)
        _, first = np.unique(names[many], return_index=True)
        many = many[first]
        reps = lengths[many]
        rows = np.repeat(starts[many] - np.cumsum(reps) + reps, reps) + np.arange(reps.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names[many], reps).view(np.int64)), pa.array(k[rows].view(np.int64))], ["list_id", "key"])
    yield from passed


class CountTree:
    """A packed R-tree over count vectors.

    Points are sorted by size and then by which half of the groups is heavier;
    a box over FANOUT neighbours keeps the largest count of each group and the
    least and largest size, and boxes are packed in the same way up to a root.
    """

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        lean = vectors[:, : GROUPS // 2].sum(axis=1, dtype=np.int64) - vectors[:, GROUPS // 2 :].sum(axis=1, dtype=np.int64)
        self.order = np.lexsort((lean, sizes))
        level = (vectors[self.order], sizes[self.order], sizes[self.order])
        self.levels = [level]
        while len(level[1]) > FANOUT:
            cuts = np.arange(0, len(level[1]), FANOUT)
            level = (np.maximum.reduceat(level[0], cuts), np.minimum.reduceat(level[1], cuts), np.maximum.reduceat(level[2], cuts))
            self.levels.append(level)

    def within(self, vector: np.ndarray, size: int) -> np.ndarray:
        """Numbers of the points whose overlap bound allows a link with the given point."""
        at = np.arange(len(self.levels[-1][1]))
        for k in range(len(self.levels) - 1, -1, -1):
            tops, least, most = self.levels[k]
            at = at[(5 * most[at] >= 4 * size) & (4 * least[at] <= 5 * size)]
            at = at[overlap_bound(tops[at], vector) >= need(least[at], size)]
            if k and len(at):
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < len(self.levels[k - 1][1])]
        return self.order[at]


class Forest:
    """Labels of points that grow together, and the links that joined them."""

    def __init__(self, n: int):
        self.labels = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def join(self, a: int, b: int) -> None:
        """Links two points of different labels; the label of ``a`` stays."""
        self.labels[self.labels == self.labels[b]] = self.labels[a]
        self.links.append((a, b))


def spanning_forest(
    vectors: np.ndarray, sizes: np.ndarray, sides: np.ndarray,
    linked: Callable[[int, np.ndarray, np.ndarray], Iterable[int]] = lambda q, hits, labels: hits,
) -> list[tuple[int, int]]:
    """Links that join whatever pairs within the bound would join.

    ``linked(q, hits, labels)`` picks the true links among q's hits, if not
    all count; it may leave out hits whose label has become q's meanwhile.
    Points of side 0 meet all others; else those of the other side alone.

    In a large set a point asks the tree unless it lies in the main component
    by its turn: two points that never ask are both in it.
    """
    forest = Forest(len(sizes))
    apart = lambda q, hits: hits[(sides[hits] != sides[q]) | (sides[hits] == 0)]
    if len(sizes) <= DENSE:
        bound = overlap_bound(vectors[:, None], vectors[None])
        fits = like_sized(sizes[:, None], sizes[None]) & (bound >= need(sizes[:, None], sizes[None]))
        fits = np.triu(fits, 1)
        ask = lambda q: apart(q, np.flatnonzero(fits[q]))
        main, queue = None, np.flatnonzero(fits.any(axis=1)).tolist()
    else:
        tree = CountTree(vectors, sizes)

        def ask(q: int) -> np.ndarray:
            hits = tree.within(vectors[q], sizes[q])
            return apart(q, hits[hits != q])

        # The main component is that of the point with most partners of a few.
        main = max(np.linspace(0, len(sizes) - 1, 4).astype(int).tolist(), key=lambda q: len(ask(q)))
        queue = [main, *(q for q in range(len(sizes)) if q != main)]
    for k, q in enumerate(queue):
        if k and main is not None and forest.labels[q] == forest.labels[main]:
            continue
        hits = ask(q)
        hits = hits[forest.labels[hits] != forest.labels[q]]
        for hit in linked(q, hits, forest.labels) if len(hits) else ():
            if forest.labels[hit] != forest.labels[q]:
                forest.join(q, int(hit))
    return forest.links


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and where each value begins and the last ends."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return data, at - at[0]


def _items(batches: Iterable[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of each work item, from rows sorted by item."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.stack([batch[c].to_numpy() for c in ("list_id", "i", "j")])
        cuts = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1
        for lo, hi in itertools.pairwise([0, *cuts.tolist(), batch.num_rows]):
            if held and last != tuple(ids[:, lo]):
                yield held
                held = []
            last = tuple(ids[:, lo])
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield held


def _pairs(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], ["a", "b"])


def _likely(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of each list's pairs within the bound."""
    found: list[tuple[bytes, bytes]] = []
    for rows in _items(batches):
        if sum(r.num_rows for r in rows) > 1:
            column = lambda name: np.concatenate([r[name].to_numpy() for r in rows])  # noqa: B023, E731
            vectors = np.concatenate([_flat(r["vec"])[0] for r in rows]).reshape(-1, GROUPS)
            nodes = [x for r in rows for x in r["node"]]
            found += [(nodes[a].as_py(), nodes[b].as_py()) for a, b in spanning_forest(vectors, column("n"), column("side"))]
            if len(found) >= 10_000:
                yield _pairs(found)
                found = []
    yield _pairs(found)


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each wanted set, for each work item of its group that it is in; once for each task, however many equal rows it meets."""
    kinds = {"list_id": pa.int64(), "i": pa.int32(), "j": pa.int32(), "side": pa.int32(), "node": pa.binary(), "shingles": pa.binary()}
    rows: list[tuple] = []
    sent: set[bytes] = set()
    size = 0

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], list(kinds))
        rows.clear()
        return out

    for batch in batches:
        for text, node, group, items in zip(batch["text"], *(batch[c].to_pylist() for c in ("node", "list_id", "items")), strict=True):
            if node in sent:
                continue
            s = shingle_set(text.as_py())
            if signature(s) != node:  # equal hashes of unequal texts
                continue
            sent.add(node)
            blob = s.tobytes()
            for item in items:
                rows.append((group, item["i"], item["j"], item["side"], node, blob))
                size += len(blob)
                if size >= 8 * FLUSH:
                    yield flush()
                    size = 0
    if rows:
        yield flush()


class _Verifier:
    """Finds true links among sets at hand: by a table of hash prefixes first, then shingle by shingle."""

    BITS = 20

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.short = [(s >> np.uint64(64 - self.BITS)).astype(np.int32) for s in sets]
        self.present = np.zeros(1 << self.BITS, bool)

    def __call__(self, q: int, hits: np.ndarray, labels: np.ndarray) -> Iterator[int]:
        sets, short, mine = self.sets, self.short, len(self.sets[q])
        self.present[short[q]] = True
        fits = [h for h in hits.tolist() if np.count_nonzero(self.present[short[h]]) >= need(mine, len(sets[h]))]
        self.present[short[q]] = False
        for h in fits:
            if labels[h] != labels[q] and len(np.intersect1d(sets[q], sets[h], assume_unique=True)) >= need(mine, len(sets[h])):
                yield h


def _links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of each group's true links."""
    found: list[tuple[bytes, bytes]] = []
    for rows in _items(batches):
        members: dict[bytes, tuple[int, np.ndarray]] = {}  # a row that repeats is one set
        for r in rows:
            data, at = _flat(r["shingles"])
            for k, (node, side) in enumerate(zip(r["node"].to_pylist(), r["side"].to_pylist(), strict=True)):
                members[node] = (side, data[at[k] : at[k + 1]].view(np.uint64))
        if len(members) > 1:
            nodes, sides, sets = list(members), np.array([m[0] for m in members.values()]), [m[1] for m in members.values()]
            vectors, sizes = np.stack([count_vector(s) for s in sets]), np.array([len(s) for s in sets], np.int64)
            found += [(nodes[a], nodes[b]) for a, b in spanning_forest(vectors, sizes, sides, _Verifier(sets))]
    yield _pairs(found)


def _edges(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one parent at most and no parent has one: then parents are the components' least nodes."""
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(None).cast("binary").alias("up")))
    state = ends.groupBy("node").agg(F.min("up").alias("lo"), F.max("up").alias("hi"), F.count(F.when(F.col("up").isNull(), 1)).alias("under"))
    return state.filter("lo <> hi or (lo is not null and under > 0)").isEmpty()


def stars(edges: DataFrame, label: str) -> DataFrame:
    """Edges (u, v) from each node to its component's least node; rows may repeat.

    Large-star and small-star steps in turn, each a written table, until every
    component is a star; each step moves edges toward smaller nodes.
    """
    before: list[DataFrame] = []
    for step in itertools.cycle((_large_star, _small_star)):
        edges = written(step(edges), label)
        discard(*before)
        if _settled(edges):
            return edges
        before = [edges]


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of all nodes of settled ``edges``: comp is the component's least node."""
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()


def _item(i: Column, j: Column, side: Column) -> Column:
    """A work item that a row is in, and on which side: 0 meets all rows, 1 and 2 each other."""
    return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))


def _only_item() -> Column:
    return F.array(_item(F.lit(0), F.lit(0), F.lit(0)))


def _in_order(rows: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Adds place, as a written table: where a row lies when rows alike in ``keys`` are laid side by side by size.

    A place is counted in ``weight``; rows of one size lie in the order of a
    hash. Only sums by size are put in order, never the rows.
    """
    sums = rows.groupBy(*keys, "n").agg(F.sum(F.expr(weight)).cast("long").alias("_w"))
    below = F.sum("_w").over(Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    sums = written(sums.withColumn("_below", F.coalesce(below, F.lit(0))), "jaccard-sizes")
    place = F.col("_below") + F.pmod(F.xxhash64("node"), F.col("_w"))
    out = written(rows.join(few(sums), [*keys, "n"]).withColumn("place", place).drop("_w", "_below"), "jaccard-places")
    discard(sums)
    return out


def _chained(placed: DataFrame, size: int) -> DataFrame:
    """First items of large lists' placed rows: blocks of like sizes, and blocks that lie half over two of those."""
    own, across = (F.floor(F.col("place") / size) * 2, F.floor((F.col("place") + size // 2) / size) * 2 + 1)
    return placed.withColumn("items", F.array(*(_item(k, k, F.lit(0)) for k in (own, across)))).drop("place")


def _unmet(big: DataFrame, comps: DataFrame, weight: str, size: int) -> DataFrame | None:
    """Further items of large lists: what may link rows that ``comps`` (node, comp) leaves apart; None if no list has any.

    Two rows of a list's main component need not meet. The list's other rows
    meet in pairs of blocks, and meet the main component's blocks; pairs of
    blocks whose sizes are too far apart, or of one component, are left out.
    So a main component's row is handed out once for each block of others.
    """
    named = written(big.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "jaccard-named")
    tally = named.groupBy("list_id", "comp").agg(F.sum(F.expr(weight)).alias("k"))
    main = written(tally.groupBy("list_id").agg(F.max(F.struct("k", "comp"))["comp"].alias("main"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c"), "jaccard-mains")
    n_main = main.count()
    if not n_main:
        discard(named, main)
        return None
    open_rows = named.join(few(main, n_main), "list_id").withColumn("kind", (F.col("comp") == F.col("main")).cast("int")).drop("main")
    laid = _in_order(open_rows, ["list_id", "kind"], weight)
    placed = laid.withColumn("slot", F.floor(F.col("place") / size))
    blocks = placed.groupBy("list_id", "kind", "slot").agg(*(f(c).alias(f"{c}_{at}") for c in ("n", "comp") for f, at in ((F.min, "lo"), (F.max, "hi"))))
    blocks = written(blocks, "jaccard-blocks")
    a, b = (blocks.select("list_id", *(F.col(c).alias(f"{x}_{c}") for c in blocks.columns if c != "list_id")) for x in "ab")
    met = a.filter("a_kind = 0").join(b, "list_id").filter("(b_kind = 1 or a_slot <= b_slot) and 5 * a_n_hi >= 4 * b_n_lo and 5 * b_n_hi >= 4 * a_n_lo")
    met = met.filter("not (a_comp_lo = b_comp_hi and b_comp_lo = a_comp_hi and a_comp_lo = a_comp_hi)")
    met = met.select("list_id", "a_kind", "a_slot", "b_kind", "b_slot", (F.col("b_slot") * 2 + F.col("b_kind")).alias("j"), ((F.col("b_kind") == 0) & (F.col("a_slot") == F.col("b_slot"))).alias("same"))
    end = lambda x, side: F.struct(F.col(f"{x}_kind").alias("kind"), F.col(f"{x}_slot").alias("slot"), _item(F.col("a_slot"), F.col("j"), side).alias("item"))
    ends = F.when(F.col("same"), F.array(end("a", F.lit(0)))).otherwise(F.array(end("a", F.lit(1)), end("b", F.lit(2))))
    ends = met.select("list_id", F.inline(ends)).groupBy("list_id", "kind", "slot").agg(F.collect_list("item").alias("items"))
    out = written(placed.join(ends, ["list_id", "kind", "slot"]).drop("kind", "slot", "place", "comp"), "jaccard-unmet")
    discard(named, main, laid, blocks)
    return out


def _joined(small: DataFrame, big: DataFrame | None, search: Callable[..., DataFrame], weight: str, size: int, label: str) -> DataFrame:
    """Settled edges of what the searched rows' links join, as a written table.

    small and big: (list_id, node, n, ...), the rows of lists of one block and
    of large lists; ``search`` takes tables of them with their items and returns links.
    """
    first = [small.withColumn("items", _only_item())]
    placed = None if big is None else _in_order(big, ["list_id"], weight)
    if placed is not None:
        first.append(_chained(placed, size))
    found = written(search(*first).distinct(), f"{label}-links")
    heads = stars(_edges(found), label)
    discard(found)
    if placed is None:
        return heads
    discard(placed)
    rest = _unmet(big, components(heads), weight, size)
    if rest is None:
        return heads
    more = written(search(rest).distinct(), f"{label}-more")
    out = stars(heads.unionByName(_edges(more)), label)
    discard(rest, more, heads)
    return out


def _likely_groups(lists: DataFrame, vectors: DataFrame, parts: int) -> DataFrame:
    """Settled edges of what the lists' pairs within the bound join."""
    large = written(lists.groupBy("list_id").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > BLOCK).select("list_id"), "jaccard-large-lists")
    n_large = large.count()
    posted = lists.join(few(large, n_large), "list_id", "left_semi").join(vectors.select("key", "node", "n"), "key").drop("key")
    big = written(posted, "jaccard-large-rows") if n_large else None
    small = lists.join(few(large, n_large), "list_id", "left_anti") if n_large else lists

    def search(*tables: DataFrame) -> DataFrame:
        whole = (t if "vec" in t.columns else t.join(vectors.select("node", "vec"), "node") for t in tables)
        items = functools.reduce(DataFrame.unionByName, (t.select("list_id", F.inline("items"), "node", "n", "vec") for t in whole))
        return items.repartition(parts, "list_id", "i", "j").sortWithinPartitions("list_id", "i", "j").mapInArrow(_likely, "a binary, b binary")

    out = _joined(small.join(vectors.select("key", "node", "n", "vec"), "key"), big, search, "1", BLOCK, "jaccard-groups")
    discard(large, *([big] if n_large else []))
    return out


def _linked_groups(groups: DataFrame, vectors: DataFrame, rows: DataFrame, parts: int) -> DataFrame:
    """Settled edges of what all true links inside the groups (node, comp) join."""
    placed = written(vectors.join(groups, "node").select("node", "n", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.xxhash64("comp").alias("list_id")), "jaccard-placed")
    large = written(placed.groupBy("list_id").agg(F.sum("n").alias("s")).filter(F.col("s") > BLOCK_SHINGLES).select("list_id"), "jaccard-large-groups")
    n_large = large.count()
    big = written(placed.join(few(large, n_large), "list_id", "left_semi"), "jaccard-large-rows") if n_large else None
    small = placed.join(few(large, n_large), "list_id", "left_anti") if n_large else placed
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("text_hash").eqNullSafe(F.col("_hash"))

    def search(*tables: DataFrame) -> DataFrame:
        wanted = functools.reduce(DataFrame.unionByName, (t.select("_id", "_hash", "node", "list_id", "items") for t in tables))
        n = wanted.agg(F.sum(F.size("items"))).first()[0] or 0
        sets = rows.join(few(wanted, n), same).select("text", "node", "list_id", "items")
        sets = sets.mapInArrow(_sets, "list_id long, i int, j int, side int, node binary, shingles binary")
        return sets.repartition(parts, "list_id", "i", "j").sortWithinPartitions("list_id", "i", "j").mapInArrow(_links, "a binary, b binary")

    out = _joined(small, big, search, "n", BLOCK_SHINGLES, "jaccard-components")
    discard(placed, large, *([big] if n_large else []))
    return out


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", by_row: bool = False) -> DataFrame:
    """Components of documents linked by 5-word shingle sets of Jaccard similarity 0.8 or more.

    Returns doc_id, n_shingles, component_id (the least doc_id reachable by
    links, itself included), one row for each row of ``docs``.

    Null and empty texts, and texts without words, have no shingles and are
    linked with nothing. Rows that repeat an id are linked with each other
    only if their texts are. A null id is a row like others, and never a
    component's id unless all ids of the component are null. Other columns
    are ignored. Sets are told apart by a 128-bit signature. An empty table
    gives an empty result.

    ``by_row`` adds text_hash, the xxhash64 of the text, and component, a
    name of the row's component (null without shingles), which tell rows and
    components apart where ids are null or repeated.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = shuffle_parts(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    first = written(rows.mapInArrow(_nodes_and_counts(4 * parts), f"doc_id {id_type}, text_hash long, node binary, key long, n long, vec binary, bucket int, blob binary"), "jaccard-nodes")
    nodes = first.filter("node is not null").select("doc_id", "text_hash", "node", "key", "n", "vec")
    shared = spark.sparkContext.broadcast(frequent_shingles(first))

    posted = rows.select("text").mapInArrow(_postings(4 * parts, shared), "bucket int, blob binary, list_id long, key long")
    lists = posted.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_shared_lists, "list_id long, key long")
    lists = written(lists.distinct(), "jaccard-lists")

    # One row stands for each distinct set on any list.
    vectors = written(nodes.join(lists.select("key").distinct(), "key", "left_semi").dropDuplicates(["node"]), "jaccard-vectors")
    found = _likely_groups(lists, vectors, parts)
    final = _linked_groups(components(found), vectors, rows, parts)
    discard(lists, vectors, found)

    named = nodes.drop("key", "vec").join(components(final), "node", "left").withColumn("comp", F.when(F.col("n") > 0, F.coalesce("comp", "node")))
    # Only components of several rows have another name than their row's; a written table, so that a join can split a large one's rows.
    ids = named.filter("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    out = named.join(few(written(ids.drop("k"), "jaccard-names")), "comp", "left")
    told = ["text_hash", F.col("comp").alias("component")] if by_row else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), *told)
