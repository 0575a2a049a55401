"""Token counts of flat token files by a separator scan.

A token file is a bare run of little-endian 16-bit ids; an end-of-document id
closes each document and nothing else tells where documents are. Files are
cut into blocks of equal size, in any order and on any task. Each block is
searched for the separator in one vectorised comparison and gives the places
of its separators. A prefix scan over the blocks of a file (two numbers for
each: how many separators, and the last one's place) then numbers the
documents and joins the piece that blocks leave open to the piece in which a
later one closes it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .jaccard import word_hashes
from .shared import TaskFile, bounded_batches, filesystem, shared_dir, shuffle_parts, written
from .tokens import encoder

#: Texts to (ids one after the other, ids of each text).
Encode = Callable[[Sequence[str]], tuple[np.ndarray, np.ndarray]]

ID_BYTES = 2
BLOCK_BYTES = 4 << 20
#: A file is closed after the document that takes it past this size.
FILE_BYTES = 256 << 20
#: Texts encoded at a time: so many rows, or so many characters.
RUN_ROWS, RUN_CHARS = 512, 1 << 20


def runs(texts: Iterable, max_rows: int = RUN_ROWS, max_chars: int = RUN_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(number of the first, texts): consecutive texts, few or short enough to handle at once."""
    held, chars, first = [], 0, 0
    for k, text in enumerate(texts):
        value = text.as_py() or ""
        held.append(value)
        chars += len(value)
        if len(held) >= max_rows or chars >= max_chars:
            yield first, held
            held, chars, first = [], 0, k + 1
    if held:
        yield first, held


@dataclass(frozen=True)
class HashedWords:
    """A vocabulary without a list: a word's id is 1 to 65535 by its hash (A-Z folded), and 0 ends a document."""

    end_id: int = 0

    def encoder(self) -> Encode:
        def encode(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
            found = [word_hashes(t) for t in texts]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            return (np.concatenate(found) % np.uint64(65535)).astype(np.int64) + 1, sizes

        return encode


@dataclass(frozen=True)
class LibraryTokens:
    """A tokenizers vocabulary (the file's content). A text that spells a special token is ordinary text, so a special token can end documents."""

    vocabulary: str
    end_id: int

    def encoder(self) -> Encode:
        return encoder(self.vocabulary, special_as_text=True).encode


def write_token_files(docs: DataFrame, tokens: HashedWords | LibraryTokens, folder: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Encodes whole texts into flat token files, where they lie: no shuffle.

    Returns two tables: files (uri, n_bytes), all that a scan needs, and
    entries (uri, doc_no, doc_id), which document is the how-manieth of which
    file. Null and empty texts are documents of the separator alone.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = folder or shared_dir(spark, "tokens")
    shared = spark.sparkContext.broadcast(tokens)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end_id, out, number = shared.value.encoder(), shared.value.end_id, None, 0
        for batch in batches:
            for first, texts in runs(batch["text"]):
                if out is None:
                    out, number = TaskFile(folder, ".tok"), 0
                ids, sizes = own(texts)
                ends = np.cumsum(sizes)
                if len(ids) and int(ids.max()) >= 1 << 8 * ID_BYTES:
                    raise ValueError("the vocabulary's ids do not fit the file")
                out.write(np.insert(ids.astype("<u2"), ends, end_id).tobytes())
                k = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([out.uri] * k), pa.array(range(number, number + k), pa.int64()), batch["doc_id"].slice(first, k), pa.nulls(k, pa.int64())],
                    ["uri", "doc_no", "doc_id", "n_bytes"],
                )
                number += k
                if out.size >= file_bytes:
                    yield end(out, batch["doc_id"].type)
                    out = None
        if out is not None:
            yield end(out, batch["doc_id"].type)

    def end(out: TaskFile, id_type: pa.DataType) -> pa.RecordBatch:
        out.close()
        return pa.RecordBatch.from_arrays([pa.array([out.uri]), pa.nulls(1, pa.int64()), pa.nulls(1, id_type), pa.array([out.size], pa.int64())], ["uri", "doc_no", "doc_id", "n_bytes"])

    manifest = written(rows.mapInArrow(run, f"uri string, doc_no long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long"), "token-manifest")
    return manifest.filter("doc_no is null").select("uri", "n_bytes"), manifest.filter("doc_no is not null").select("uri", "doc_no", "doc_id")


def scan(files: DataFrame, end_id: int, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents of flat token files (uri, n_bytes): uri, doc_no, start, n_tokens.

    doc_no counts a file's documents from 0, start its ids before the
    document, n_tokens the document's ids with its separator. Ids behind the
    last separator are a last document without one; an empty file has none.
    A file of an odd number of bytes fails.
    """
    if block_bytes % ID_BYTES:
        raise ValueError("a block must hold whole ids")
    blocks = files.select("uri", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"greatest(n_bytes - 1, 0) div {block_bytes}"))).alias("block"))
    blocks = blocks.filter("n_bytes > 0").repartition(shuffle_parts(files.sparkSession), "uri", "block")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, size, block in zip(*(batch[c].to_pylist() for c in ("uri", "n_bytes", "block")), strict=True):
                fs, path = filesystem(uri)
                with fs.open_input_file(path) as source:
                    ids = np.frombuffer(source.read_at(min(block_bytes, size - block * block_bytes), block * block_bytes), "<u2")
                ends = (np.flatnonzero(ids == end_id) + 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uri]), pa.array([size // ID_BYTES], pa.int64()), pa.array([block], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), pa.array(ends))],
                    ["uri", "n_ids", "block", "ends"],
                )

    found = written(blocks.mapInArrow(run, "uri string, n_ids long, block long, ends array<int>"), "separator-blocks")
    block_ids = block_bytes // ID_BYTES
    base, count, last = F.col("block") * block_ids, F.size("ends"), F.col("block") == F.expr(f"(n_ids - 1) div {block_ids}")
    before = Window.partitionBy("uri").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = found.withColumns({
        "_docs": F.coalesce(F.sum(count).over(before), F.lit(0)),
        "_open": F.coalesce(F.max(F.when(count > 0, base + F.get("ends", count - 1))).over(before), F.lit(0)),
        # Ids behind the last separator of a file end with the file.
        "_ends": F.when(last & (F.coalesce(base + F.get("ends", count - 1), base) < F.col("n_ids")), F.array_append("ends", (F.col("n_ids") - base).cast("int"))).otherwise(F.col("ends")),
    })
    each = scanned.select("uri", base.alias("_base"), "_docs", "_open", "_ends", F.posexplode("_ends").alias("_k", "_end"))
    start = F.when(F.col("_k") == 0, F.col("_open")).otherwise(F.col("_base") + F.get("_ends", F.col("_k") - 1))
    return each.select("uri", (F.col("_docs") + F.col("_k")).alias("doc_no"), start.alias("start"), (F.col("_base") + F.col("_end") - start).alias("n_tokens"))


def token_counts(docs: DataFrame, tokens: HashedWords | LibraryTokens = HashedWords(), *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Writes the documents' flat token files, scans them, and returns doc_id, n_tokens (with the separator).

    Repeated rows are documents each; null and empty texts count 1; other
    columns are ignored; an empty table gives an empty result.
    """
    files, entries = write_token_files(docs, tokens, id_col=id_col, text_col=text_col)
    return entries.join(scan(files, tokens.end_id, block_bytes=block_bytes), ["uri", "doc_no"], "left").select("doc_id", "n_tokens")
