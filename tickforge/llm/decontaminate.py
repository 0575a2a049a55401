"""Benchmark decontamination with one Aho-Corasick automaton.

Text is folded byte by byte (A-Z to small letters, everything that is not a
digit, a letter or part of a non-ASCII character to a space), so a place in
the folded text is a place in the original. The automaton's letters are digits
of word numbers: every distinct window of ten item words is a string of them,
and each document, written in the same way, is scanned once. Only documents with a hit pay for
the way back from words to places.

The benchmark is a stated set of questions and answers. Its automaton's states
are counted before it is shipped. Beyond ``block_states`` it is cut into
blocks of about so many: the corpus is scanned once for each, by one automaton
of bounded size that each worker builds once, and no more than one block is
ever on the driver or broadcast.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .shared import bounded_batches, discard, written

WINDOW = 10
#: Words in all windows of one automaton; a word is two to four states, some 200 bytes of a worker's memory.
BLOCK_STATES = 1 << 20
#: Windows of an item that lie in one segment, the unit that blocks are made of.
SEGMENT = 4096

_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def folded(text: str | None) -> bytes:
    """As many bytes as the text has in UTF-8: words in small letters, spaces for the rest."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)


def segments(text: str | None, window: int = WINDOW) -> Iterator[list[bytes]]:
    """The text's words in stretches that hold SEGMENT windows at most, each window in one of them."""
    words = folded(text).split()
    for lo in range(0, max(len(words) - window, 0) + 1, SEGMENT) if words else ():
        yield words[lo : lo + SEGMENT + window - 1]


def states(n_words: int, window: int = WINDOW) -> int:
    """Words in all windows of a stretch of so many words; the automaton has that many states at most, times a word's digits."""
    return window * max(n_words - window + 1, 1)


@dataclass
class Matcher:
    """The automaton of all windows of (item, words) stretches.

    A word is written as ``digits`` characters, its number to the base 64, the
    most significant digit in a range of its own: so a state has at most 64
    ways on, and windows are found at word limits only.
    """

    codes: dict[bytes, str]
    digits: int
    automaton: ahocorasick.Automaton

    @classmethod
    def of(cls, stretches: Iterable[tuple[Any, list[bytes]]], window: int = WINDOW) -> Matcher:
        held = list(stretches)
        known = sorted({w for _, words in held for w in words})
        digits = 1
        while 64**digits <= len(known):
            digits += 1
        codes = {w: "".join(chr((128 if k == digits - 1 else 64) + n // 64**k % 64) for k in reversed(range(digits))) for n, w in enumerate(known)}
        holders: dict[str, set] = defaultdict(set)
        for item_id, words in held:
            for i in range(max(1, len(words) - window + 1)) if words else ():
                holders["".join([codes[w] for w in words[i : i + window]])].add(item_id)
        automaton = ahocorasick.Automaton()
        for run, ids in holders.items():
            automaton.add_word(run, (len(run) // digits, frozenset(ids)))
        if holders:
            automaton.make_automaton()
        return cls(codes, digits, automaton)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit words as [first, past-last) ranges in order, merged; items found."""
        if not words or not len(self.automaton):
            return [], set()
        code, other = self.codes.get, " " * self.digits
        found = [((at + 1) // self.digits, hit) for at, hit in self.automaton.iter("".join([code(w, other) for w in words]))]
        items: set = set()
        for _, (_, ids) in found:
            items |= ids
        return merged((past - n, past) for past, (n, _) in found), items


def merged(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges' union, in order."""
    out: list[tuple[int, int]] = []
    for first, past in sorted(ranges):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(past, out[-1][1]))
        else:
            out.append((first, past))
    return out


def spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as [begin, end) character places of the original text."""
    fold = np.frombuffer(folded(text), np.uint8)
    inside = np.diff((fold != 0x20).astype(np.int8), prepend=0, append=0)
    begins, ends = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters that begin before a byte
    return [(int(chars[begins[a]]), int(chars[ends[b - 1]])) for a, b in ranges]


_matchers: dict[str, Matcher] = {}


def _matcher(shared, window: int) -> Matcher:
    """The worker's automaton of a broadcast block (its key and its stretches); the last one made is kept."""
    key, stretches = shared.value
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher.of(((i, words.split()) for i, words in stretches), window)
    return _matchers[key]


def _stretches(window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, b" ".join(words), states(len(words), window)) for i, text in zip(batch["i"].to_pylist(), batch["t"].to_pylist(), strict=True) for words in segments(text, window)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate((pa.string(), pa.binary(), pa.int64()))], ["i", "words", "states"])

    return run


_RANGES = ArrayType(StructType().add("begin", "long").add("end", "long"))
_RANGE = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def _ranges(found: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"begin": a, "end": b} for a, b in r] for r in found], _RANGE)


def blocks(cut: DataFrame, block_states: int) -> list[DataFrame]:
    """The distinct stretches in blocks of at most ``block_states`` states, or of one hash range if that alone holds more.

    Hash ranges are counted (16 for each block that is needed) and packed in
    order by their running sum, so what is collected is a row for each range.
    """
    total = cut.agg(F.sum("states")).first()[0] or 0
    if total <= block_states:
        return [cut]
    n = 16 * -(-total // block_states)
    place = F.pmod(F.xxhash64("i", "words"), F.lit(n))
    sums = sorted((r.h, r.n) for r in cut.groupBy(place.alias("h")).agg(F.sum("states").alias("n")).collect())
    starts, held = [0], 0
    for h, k in sums:
        if held and held + k > block_states:
            starts.append(h)
            held = 0
        held += k
    return [cut.filter((place >= lo) & (place < hi)) for lo, hi in zip(starts, [*starts[1:], n], strict=True)]


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_states: int = BLOCK_STATES, with_spans: bool = False, keep: tuple[str, ...] = (),
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """What each document shares with the benchmark: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    n_hit counts the document's words inside any occurrence of a window;
    items are those with an occurring window. ``with_spans`` adds spans,
    array<struct<begin,end>> of hit passages as character places; ``keep``
    names further columns of ``docs`` to carry along; of a kept column with
    the name of one of these results, the result stays.

    Null and empty texts have no words; items without words match nothing;
    an empty benchmark finds nothing. Null item ids count as the item "null".
    Repeated rows are scanned each. Empty input gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("i"), F.col(item_text_col).alias("t")).filter("t is not null")
    cut = written(items.mapInArrow(_stretches(window), "i string, words binary, states long").distinct(), "benchmark-stretches")
    parts = blocks(cut, block_states)

    schema = StructType().add("doc_id", docs.schema[id_col].dataType).add("n_words", "long").add("n_hit", "long").add("n_items", "long").add("items_sha256", "string").add("contaminated", "boolean")
    if with_spans:
        schema = schema.add("spans", _RANGES)
    carried = [c for c in keep if c not in schema.names]
    # The rows' own columns go by number, so none can clash with a name in use here.
    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *(F.col(f"`{c}`").alias(f"_own_{k}") for k, c in enumerate(carried)),
        F.lit(None).cast(_RANGES).alias("_ranges"), F.lit(None).cast("array<string>").alias("_items"),
    )
    for k, c in enumerate(carried):
        schema = schema.add(c, rows.schema[f"_own_{k}"].dataType)

    def found(shared, batch: pa.RecordBatch) -> tuple[list[int], list[list[tuple[int, int]]], list[set]]:
        """Words, hit ranges and items of each row, with those that earlier blocks have found."""
        matcher = _matcher(shared, window)
        sizes, ranges, names = [], [], []
        for text, before, ids in zip(batch["_text"], batch["_ranges"], batch["_items"], strict=True):
            words = folded(text.as_py()).split()
            hit, new = matcher.scan(words)
            if before.is_valid:
                hit, new = merged([*hit, *((r["begin"], r["end"]) for r in before.as_py())]), new | set(ids.as_py())
            sizes.append(len(words)), ranges.append(hit), names.append(new)
        return sizes, ranges, names

    def in_between(shared):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, ranges, names = found(shared, batch)
                columns = [_ranges(ranges) if c == "_ranges" else pa.array(map(sorted, names), pa.list_(pa.string())) if c == "_items" else batch[c] for c in batch.schema.names]
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

        return run

    def judged(shared):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes, ranges, names = found(shared, batch)
                columns = [
                    batch["_id"], pa.array(sizes, pa.int64()), pa.array([sum(b - a for a, b in r) for r in ranges], pa.int64()), pa.array(map(len, names), pa.int64()),
                    pa.array([hashlib.sha256(",".join(sorted(f)).encode()).hexdigest() for f in names], pa.string()), pa.array([bool(r) for r in ranges], pa.bool_()),
                ]
                if with_spans:
                    columns.append(_ranges([spans(text.as_py(), r) if r else [] for text, r in zip(batch["_text"], ranges, strict=True)]))
                yield pa.RecordBatch.from_arrays([*columns, *(batch[f"_own_{k}"] for k in range(len(carried)))], schema.names)

        return run

    before = None
    for k, part in enumerate(parts):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, [(r.i, bytes(r.words)) for r in part.collect()]))
        if k == len(parts) - 1:
            discard(cut)
            return rows.mapInArrow(judged(shared), schema)
        rows = written(rows.mapInArrow(in_between(shared), rows.schema), "contamination-block")
        shared.unpersist()
        if before is not None:
            discard(before)
        before = rows
    raise AssertionError("there is at least one block")
