"""Byte-level BPE encoding and decoding with padded numpy matrices.

Texts are cut by the vocabulary's pattern; each distinct piece of a batch is
encoded once. Pieces of like length form a padded matrix of token ids. In a
round every row merges its leftmost pair of least rank; ranks of pairs come
from an open-addressing hash table; the hole closes by shifting the row's
tail, and rows without a pair left leave the matrix. Pieces longer than the
widest bucket take the same merges, in the same order, from a heap.

A worker keeps the pieces it has met, up to a bound, so frequent ones are
looked up. Texts are handled in runs of bounded size, and a very long text in
slices of its pieces, so memory does not follow the text's length.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches

#: Row widths of the matrices; longer pieces go to the heap.
WIDTHS = (2, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256)
NO_PAIR = np.int32(2**31 - 1)
#: Distinct pieces kept by a worker before it starts anew.
KEPT_PIECES = 400_000
#: Characters of text, and pieces, handled at a time.
RUN_CHARS, RUN_PIECES = 1 << 19, 1 << 17


class PairTable:
    """(left id, right id) -> id of the merged token, hashed with linear probing."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        bits = max(4, (2 * len(merged)).bit_length() + 1)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ids = np.full(1 << bits, NO_PAIR, np.int32)
        keys = (np.array(left, np.int64) << 32) | np.array(right, np.int64)
        ids, slot = np.array(merged, np.int32), self._slot(keys)
        self.probes = 0
        while len(keys):
            self.probes += 1
            free = np.flatnonzero(self.keys[slot] == -1)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.ids[slot[won]] = keys[won], ids[won]
            left_over = np.ones(len(keys), bool)
            left_over[won] = False
            keys, ids, slot = keys[left_over], ids[left_over], (slot[left_over] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NO_PAIR where there is none (a pad is -1 and has none)."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.ids[slot], NO_PAIR)
        ask = np.flatnonzero((found != keys) & (found != -1) & (left >= 0) & (right >= 0))
        for _ in range(self.probes):
            if not len(ask):
                break
            slot[ask] = (slot[ask] + 1) & self.mask
            found = self.keys[slot[ask]]
            hit = found == keys[ask]
            out[ask[hit]] = self.ids[slot[ask[hit]]]
            ask = ask[~hit & (found != -1)]
        return out


class Codec:
    """Encoder and decoder of one rank file (lines of base64 token and rank)."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in rank_file.splitlines() if line)}
        self.pattern = regex.compile(pattern)
        self.pairs = PairTable(self.ranks)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        size = max(self.ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.decimals = [str(i) for i in range(size)]
        self.forget()

    def forget(self) -> None:
        self.seen = _Numbering()
        self.flat = np.zeros(0, np.int32)
        self.starts = self.lengths = np.zeros(0, np.int64)

    # Pieces

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces in one array, and where each piece's begin and how many they are."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        starts, sizes = np.zeros(len(raw), np.int64), np.ones(len(raw), np.int64)
        whole: list[int] = []
        buckets: dict[int, list[int]] = {}
        for i, b in enumerate(raw):
            rank = self.ranks.get(b)
            if rank is not None:
                starts[i] = len(whole)
                whole.append(rank)
            else:
                buckets.setdefault(next((w for w in WIDTHS if len(b) <= w), 0), []).append(i)
        parts, base = [np.array(whole, np.int32)], len(whole)
        for width, members in buckets.items():
            for lo in range(0, len(members), 1 << 14):
                part = members[lo : lo + (1 << 14)]
                if width:
                    ids, n = self._by_matrix([raw[i] for i in part], width)
                else:
                    rows = [self._by_heap(self.byte_ids[np.frombuffer(raw[i], np.uint8)]) for i in part]
                    ids, n = np.concatenate(rows), np.fromiter(map(len, rows), np.int64, len(rows))
                parts.append(ids)
                sizes[part] = n
                starts[part] = base + np.cumsum(n) - n
                base += len(ids)
        return np.concatenate(parts), starts, sizes

    def _by_matrix(self, rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows' ids one after the other, and how many each row has."""
        n, full = len(rows), width
        octets = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(n, width)
        lengths = np.fromiter(map(len, rows), np.int64, n)
        ids = np.where(np.arange(width) < lengths[:, None], self.byte_ids[octets], np.int32(-1))
        pair = self.pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        who, out = np.arange(n), np.full((n, full), -1, np.int32)
        cols = np.arange(width)
        while len(who):
            at = pair.argmin(axis=1)  # the first of equal ranks: the leftmost
            rank = pair[np.arange(len(who)), at]
            done = rank == NO_PAIR
            if done.any():
                out[who[done], :width] = ids[done]
                who, ids, pair, at, rank = who[~done], ids[~done], pair[~done], at[~done], rank[~done]
                if not len(who):
                    break
            r = np.arange(len(who))
            step = cols + (cols > at[:, None])
            ids = np.take_along_axis(np.pad(ids, ((0, 0), (0, 1)), constant_values=-1), step, axis=1)
            ids[r, at] = rank
            pair = np.take_along_axis(np.pad(pair, ((0, 0), (0, 1)), constant_values=NO_PAIR), step[:, :-1], axis=1)
            lengths[who] -= 1
            right = np.where(at + 1 < width, ids[r, np.minimum(at + 1, width - 1)], -1)
            fits = at < width - 1
            pair[r[fits], at[fits]] = self.pairs(rank[fits], right[fits])
            back = at > 0
            pair[r[back], at[back] - 1] = self.pairs(ids[r[back], at[back] - 1], rank[back])
            longest = max(int(lengths[who].max()), 2)
            if longest <= width - width // 4:  # close up the matrix
                width = longest
                ids, pair, cols = ids[:, :width], pair[:, : width - 1], cols[:width]
        return out[out >= 0], lengths

    def _by_heap(self, ids: np.ndarray) -> np.ndarray:
        n = len(ids)
        tok, prev, nxt = ids.tolist(), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(int(r), i) for i, r in enumerate(self.pairs(ids[:-1], ids[1:])) if r != NO_PAIR]
        heapq.heapify(heap)
        one = lambda a, b: self.ranks.get(self.tokens[a] + self.tokens[b])
        while heap:
            rank, i = heapq.heappop(heap)
            j = nxt[i]
            if tok[i] < 0 or j >= n or one(tok[i], tok[j]) != rank:
                continue
            tok[i], tok[j], nxt[i] = rank, -1, nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                if (r := one(rank, tok[nxt[i]])) is not None:
                    heapq.heappush(heap, (r, i))
            if prev[i] >= 0 and (r := one(tok[prev[i]], rank)) is not None:
                heapq.heappush(heap, (r, prev[i]))
        return np.array([t for t in tok if t >= 0], np.int32)

    # Texts

    def ids_of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the pieces in order, and how many each has."""
        if len(self.seen) > KEPT_PIECES:
            self.forget()
        number = np.fromiter(map(self.seen.__getitem__, pieces), np.int64, len(pieces))
        if self.seen.fresh:
            flat, starts, sizes = self.encode_pieces(self.seen.fresh)
            self.seen.fresh = []
            self.starts = np.concatenate([self.starts, len(self.flat) + starts])
            self.lengths = np.concatenate([self.lengths, sizes])
            self.flat = np.concatenate([self.flat, flat])
        sizes = self.lengths[number]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[number] - ends + sizes, sizes) + np.arange(total)], sizes

    def encode_texts(self, texts: Iterable[str | None]) -> Iterator[tuple[int, list[int]]]:
        """(text number, some more of its ids), in order; every text comes at least once."""
        pieces: list[str] = []
        owners: list[tuple[int, int]] = []  # text, pieces
        chars = 0

        def flush() -> Iterator[tuple[int, list[int]]]:
            ids, sizes = self.ids_of(pieces)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            at = 0
            for owner, n in owners:
                yield owner, ids[ends[at] : ends[at + n]].tolist()
                at += n
            pieces.clear(), owners.clear()

        for k, text in enumerate(texts):
            text = text or ""
            if len(text) <= RUN_CHARS:
                found = self.pattern.findall(text)
                pieces += found
                owners.append((k, len(found)))
                chars += len(text)
            else:
                since = len(pieces)
                for match in self.pattern.finditer(text):
                    pieces.append(match[0])
                    if len(pieces) >= RUN_PIECES:
                        owners.append((k, len(pieces) - since))
                        yield from flush()
                        since = 0
                owners.append((k, len(pieces) - since))
                chars = RUN_CHARS
            if chars >= RUN_CHARS:
                yield from flush()
                chars = 0
        yield from flush()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class _Numbering(dict):
    """Numbers pieces in the order they are met; new ones wait in ``fresh``."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = at = len(self)
        self.fresh.append(piece)
        return at


_codecs: dict[str, Codec] = {}


def codec(rank_file: bytes, pattern: str) -> Codec:
    """The worker's codec for a vocabulary; the last one made is kept."""
    key = hashlib.sha256(rank_file + pattern.encode()).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(rank_file, pattern)
    return _codecs[key]


def _vocabulary(spark: SparkSession, path: str, pattern: str):
    bounded_batches(spark)
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast((f.read(), pattern))


def encode(docs: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every whole text: doc_id, ids array<int>.

    vocabulary: path of the rank file on the driver (a fixed file, broadcast).
    Null and empty texts have no ids. Repeated rows are encoded each; other
    columns are ignored; empty input gives an empty result.
    """
    shared = _vocabulary(docs.sparkSession, vocabulary, pattern)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for k, more in codec(*shared.value).encode_texts(batch["text"].to_pylist()):
                ids[k] += more
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(tokens: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The bytes of every row's ids: doc_id, content binary. Null ids give empty content; an unknown id fails."""
    shared = _vocabulary(tokens.sparkSession, vocabulary, pattern)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = [codec(*shared.value).decode(ids or ()) for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(content, pa.binary())], ["doc_id", "content"])

    rows = tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, content binary")


def digests(docs: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text, decodes the ids and returns what tells both:
    doc_id, n_tokens, ids_sha256 (of the decimal ids, comma-joined), decoded_sha256.

    The digests are carried along, so no text's ids are ever held whole. Nulls,
    repeats, empty and long texts as in ``encode``.
    """
    shared = _vocabulary(docs.sparkSession, vocabulary, pattern)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*shared.value)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []

            def finish() -> None:
                if n:
                    ids_sha.append(of_ids.hexdigest()), text_sha.append(of_text.hexdigest())

            at = -1
            for k, ids in own.encode_texts(x.as_py() for x in batch["text"]):
                if k != at:
                    finish()
                    at, of_ids, of_text = k, hashlib.sha256(), hashlib.sha256()
                    n.append(0)
                if ids:
                    of_ids.update(("," * (n[-1] > 0) + ",".join(map(own.decimals.__getitem__, ids))).encode())
                    of_text.update(own.decode(ids))
                    n[-1] += len(ids)
            finish()
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
