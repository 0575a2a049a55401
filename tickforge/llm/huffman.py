"""Token ids as canonical length-limited Huffman code.

Code lengths come from the ids' counts over the whole corpus (package-merge,
so none exceeds the limit), codes from the lengths alone, so a file needs only
a length for each id. The file is a Parquet table of blocks, documents in
ascending id order; each block decodes by itself. Within a block a document
begins at a whole byte, and every so many ids the bit offset is written down:
all stretches between such checkpoints are decoded side by side, one table
look-up for each id.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .separator_scan import runs
from .shared import bounded_batches, shared_dir, shuffle_parts, written
from .tokens import encoder

MAX_BITS = 18
#: Ids between two checkpoints.
STRIDE = 256
#: A block is closed after the document that takes its payload past this size.
BLOCK_BYTES = 1 << 20


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for ids with the given counts; 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << limit:
        raise ValueError("the limit is too small for so many ids")
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    weights = counts[used].astype(np.float64)
    order = np.argsort(weights, kind="stable")
    weights = weights[order]
    levels, row = [], np.zeros(0)
    for _ in range(limit):
        packages = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, packages])
        place = np.argsort(both, kind="stable")
        row = both[place]
        levels.append(place < len(weights))  # which of the level's items are single ids
    taken, found = 2 * len(weights) - 2, np.zeros(len(weights), np.uint8)
    for single in reversed(levels):
        ids = int(single[:taken].sum())
        found[:ids] += 1
        taken = 2 * (taken - ids)
    lengths[used[order]] = found
    return lengths


class Code:
    """Canonical code of the given lengths: shorter codes first, equal lengths by id."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        self.bits = int(lengths.max(initial=1))
        ranks = np.concatenate([[0], np.cumsum(1 << (self.bits - self.lengths[order]))])
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = (ranks[:-1] >> (self.bits - self.lengths[order])).astype(np.uint64)
        # Every value of the next ``bits`` bits leads to an id and its length.
        self.table = np.zeros(1 << self.bits, np.int64)
        self.table[: ranks[-1]] = np.repeat((order << 8) | self.lengths[order], 1 << (self.bits - self.lengths[order]))

    def encode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[bytes, np.ndarray, list[np.ndarray]]:
        """Bits of documents of the given sizes, each from a whole byte on: payload, byte sizes, checkpoints (bits from the document's beginning)."""
        n_bits = self.lengths[ids]
        ends = np.cumsum(n_bits)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        total = np.concatenate([[0], ends])[edges]
        n_bytes = -(-np.diff(total) // 8)
        first = 8 * (np.cumsum(n_bytes) - n_bytes)
        at = ends - n_bits + np.repeat(first - total[:-1], sizes)
        word, room = at >> 5, (64 - (at & 31) - n_bits).astype(np.uint64)
        value = self.codes[ids] << room
        words = np.zeros((int(n_bytes.sum()) >> 2) + 3)
        high = np.bincount(word, weights=(value >> np.uint64(32)).astype(np.float64), minlength=len(words))
        low = np.bincount(word + 1, weights=(value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=len(words))
        payload = (high + low).astype(np.uint64).astype(">u4").tobytes()[: int(n_bytes.sum())]
        checkpoints = [(at[a:b:STRIDE] - f).astype("<u4") for a, b, f in zip(edges[:-1], edges[1:], first, strict=True)]
        return payload, n_bytes, checkpoints

    def decode(self, payload: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Ids of stretches that begin at the given bits and hold so many ids, one after the other."""
        words = np.frombuffer(payload + b"\0" * (12 - len(payload) % 4), ">u4").astype(np.uint64)
        order = np.argsort(-sizes, kind="stable")
        place = starts[order].astype(np.int64)
        left = sizes[order]
        out_at = (np.cumsum(sizes) - sizes)[order]
        out = np.zeros(int(sizes.sum()), np.int32)
        shift = np.uint64(64 - self.bits)
        for step in range(int(left[0]) if len(left) else 0):
            live = int(np.searchsorted(-left, -step, "left"))  # those with more than ``step`` ids
            p = place[:live]
            w = p >> 5
            window = (words[w] << np.uint64(32)) | words[w + 1]
            found = self.table[((window << (p & 31).astype(np.uint64)) >> shift).astype(np.int64)]
            out[out_at[:live] + step] = found >> 8
            place[:live] += found & 0xFF
        return out


def _token_table(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Encodes whole texts: rows doc_id, n, ids (16-bit), and at each task's end the counts (id, k) it has seen."""
    with open(vocabulary, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts, kind = encoder(shared.value), np.zeros(1 << 16, np.int64), None
        names = ["doc_id", "n", "ids", "id", "k"]
        for batch in batches:
            kind = batch["doc_id"].type
            for first, texts in runs(batch["text"]):
                ids, sizes = own.encode(texts)
                if len(ids) and int(ids.max()) >= 1 << 16:
                    raise ValueError("the vocabulary's ids do not fit 16 bits")
                ids = np.insert(ids, np.cumsum(sizes), end_id).astype("<u2")
                counts += np.bincount(ids, minlength=1 << 16)
                edges = np.concatenate([[0], np.cumsum(sizes + 1)]) * 2
                raw = ids.tobytes()
                m = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(first, m), pa.array(sizes + 1), pa.array([raw[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64())], names
                )
        if kind is not None:
            seen = np.flatnonzero(counts)
            m = len(seen)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, kind), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(seen.astype(np.int32)), pa.array(counts[seen])], names)

    return written(docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, ids binary, id int, k long"), "huffman-ids")


def write_files(docs: DataFrame, vocabulary: str, end_id: int, path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encodes all texts and writes them, each with ``end_id`` behind it, as Huffman blocks; returns the folder.

    The folder holds blocks (part, block, first, doc_ids, sizes, n_bytes,
    checkpoints, payload) and lengths (id, length). Parts follow each other in
    ascending document id, and so do blocks inside a part and documents inside
    a block; first counts the part's ids before the block. Null ids come
    first; repeated ids are documents of their own, next to each other. Null
    and empty texts are the end id alone. Very long texts are encoded in slices,
    but one document's ids stand in one row. An empty table makes a folder
    without blocks. Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    path = path or shared_dir(spark, "huffman")
    parts = shuffle_parts(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    table = _token_table(rows, vocabulary, end_id)

    # A count for each id of the vocabulary, and so many bounds of document ids: both of fixed size.
    tally = table.filter("id is not null").groupBy("id").agg(F.sum("k").alias("k")).collect()
    counts = np.zeros(1 << 16, np.int64)
    counts[[r.id for r in tally]] = [r.k for r in tally]
    lengths = code_lengths(counts)
    shared = spark.sparkContext.broadcast(lengths)
    own = table.filter("n is not null").select("doc_id", "n", "ids", F.monotonically_increasing_id().alias("at"))
    # A row's place in the written table comes last in the order, so even rows of one id and text fall into several parts.
    thin = own.select(F.struct("doc_id", "n", "at").alias("row")).repartitionByRange(4 * parts, "row")
    tops = [r.top for r in thin.groupBy(F.spark_partition_id()).agg(F.max("row").alias("top")).collect()]
    place = lambda doc_id, n, at: (False, 0, n, at) if doc_id is None else (True, doc_id, n, at)
    bounds = sorted(place(*t) for t in tops)[:-1]

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(shared.value)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                raw = part["ids"].to_pylist()
                payload, n_bytes, marks = code.encode(np.frombuffer(b"".join(raw), "<u2").astype(np.int64), part["n"].to_numpy())
                edges = np.concatenate([[0], np.cumsum(n_bytes)])
                where = [bisect.bisect_left(bounds, place(*x)) for x in zip(*(part[c].to_pylist() for c in ("doc_id", "n", "at")), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where, pa.int32()), part["doc_id"], part["n"], part["at"], pa.array([payload[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary()), pa.array([m.tobytes() for m in marks], pa.binary())],
                    ["part", "doc_id", "n", "at", "bits", "marks"],
                )

    id_type = own.schema["doc_id"].dataType.simpleString()
    packed = own.mapInArrow(pack, f"part int, doc_id {id_type}, n long, at long, bits binary, marks binary")
    packed = packed.repartition(parts, "part").sortWithinPartitions("part", "doc_id", "n", "at").drop("at")

    def block(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before, held, size = None, 0, 0, [], 0

        def close() -> pa.RecordBatch:
            nonlocal number, before, size
            _, ids, n, bits, marks = zip(*held, strict=True)
            out = [part, number, before, list(ids), list(n), [len(b) for b in bits], b"".join(marks), b"".join(bits)]
            number, before, size = number + 1, before + sum(n), 0
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(out, types, strict=True)], names)

        for batch in batches:
            types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(batch["doc_id"].type), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            for row in zip(*(batch[c].to_pylist() for c in ("part", "doc_id", "n", "bits", "marks")), strict=True):
                if held and (row[0] != part or size >= BLOCK_BYTES):
                    yield close()
                if row[0] != part:
                    part, number, before = row[0], 0, 0
                held.append(row)
                size += len(row[3])
        if held:
            yield close()

    names = ["part", "block", "first", "doc_ids", "sizes", "n_bytes", "checkpoints", "payload"]
    schema = f"part int, block long, first long, doc_ids array<{id_type}>, sizes array<long>, n_bytes array<long>, checkpoints binary, payload binary"
    packed.mapInArrow(block, schema).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    kept = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(kept, "id int, length int").coalesce(1).write.parquet(f"{path}/lengths")
    return path


def stretches(sizes: np.ndarray, n_bytes: np.ndarray, checkpoints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin (bits in the block) and ids of all stretches between checkpoints."""
    per_doc = -(-sizes // STRIDE)
    starts = np.repeat(8 * (np.cumsum(n_bytes) - n_bytes), per_doc) + checkpoints
    lengths = np.full(len(starts), STRIDE, np.int64)
    lengths[np.cumsum(per_doc) - 1] = sizes - (per_doc - 1) * STRIDE
    return starts, lengths


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Decodes the folder's blocks: part, doc_id, start (ids before the document in its part), n_tokens, ids_crc32, ids array<int>.

    A row for each document written, whatever its id; none for an empty folder.
    """
    return _decoded(spark, path, with_ids=True)


def summary(spark: SparkSession, path: str) -> DataFrame:
    """What the folder's blocks hold, from decoding them: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before the document, over all parts;
    ids_crc32 is the CRC-32 of the ids as little-endian 32-bit numbers. A row
    for each document written: null and repeated ids keep theirs.
    """
    docs = _decoded(spark, path, with_ids=False)
    sums = spark.read.parquet(f"{path}/blocks").select("part", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    # As many rows as parts, a number fixed by the session: one running sum over them is enough, and they fit any task.
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return docs.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def _decoded(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    bounded_batches(spark)
    lengths = np.zeros(1 << 16, np.uint8)
    for r in spark.read.parquet(f"{path}/lengths").collect():
        lengths[r.id] = r.length
    shared = spark.sparkContext.broadcast(lengths)
    blocks = spark.read.parquet(f"{path}/blocks")
    id_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch[c][i] for c in ("part", "first", "doc_ids", "sizes", "n_bytes", "checkpoints", "payload")}
                sizes, n_bytes = row["sizes"].values.to_numpy(), row["n_bytes"].values.to_numpy()
                starts, counts = stretches(sizes, n_bytes, np.frombuffer(row["checkpoints"].as_py(), "<u4"))
                ids = code.decode(row["payload"].as_py(), starts, counts).astype("<u4")
                edges = np.concatenate([[0], np.cumsum(sizes)])
                raw, m = memoryview(ids.tobytes()), len(sizes)
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                columns = [pa.array([row["part"].as_py()] * m, pa.int32()), row["doc_ids"].values, pa.array(row["first"].as_py() + edges[:-1]), pa.array(sizes), pa.array(crcs, pa.int64())]
                names = ["part", "doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"part int, doc_id {id_type}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return blocks.mapInArrow(run, schema)
