"""Quality scores by a factorisation machine over hashed words, structure statistics and metadata.

A text is a sparse vector x: its words hashed into ``Training.words`` buckets
(1 + log of the count, of length 1 together), its structure statistics (each
spread over the two nearest of ``BINS`` levels) and, where asked for, metadata
columns (one hashed level each). The score is the logistic of

    bias + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

and the pairwise sum is taken in linear time as half of
sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

Whole texts are read where they lie, in slices cut between words, so a long
text costs no more memory than its row. The machine is fitted on the driver on
a bounded sample of labelled rows (``Training.max_rows``), whose vectors are
made in tasks; a vector has at most ``words`` + two levels a statistic entries.
"""

from __future__ import annotations

import math
import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import bounded_batches

_WORD = re.compile(r"\w+")
_BREAK = re.compile(r"\W")
#: Characters of a text worked on at once.
SLICE = 1 << 20
#: Levels of a structure statistic, and of a metadata column.
BINS, LEVELS = 24, 64
STATISTICS = (
    "length", "words", "word_length", "distinct", "commonest", "repeats", "upper", "digits", "symbols", "marks", "beyond_ascii", "line_words", "equal_lines",
)
#: Entries of the sparse vectors that are scored in one product.
ENTRIES = 1 << 18
_BYTE = np.arange(256)
_CLASSES = {
    "upper": (_BYTE >= 65) & (_BYTE <= 90),
    "digits": (_BYTE >= 48) & (_BYTE <= 57),
    "symbols": np.isin(_BYTE, list(b"#*$%&|<>=+~^_\\/{}[]@")),
    "marks": np.isin(_BYTE, list(b".,;:!?'\"()-")),
    "beyond_ascii": _BYTE >= 192,  # first bytes of characters
}
_START = (_BYTE < 128) | (_BYTE >= 192)


@dataclass(frozen=True)
class Training:
    """Bounds of the labelled sample and of the fit."""

    #: Labelled rows that teach, at most; half of them of each label where it has so many.
    max_rows: int = 6000
    words: int = 1 << 14
    rank: int = 8
    epochs: int = 12
    batch: int = 64
    rate: float = 0.01
    decay: float = 1e-4
    seed: int = 11


@dataclass
class Machine:
    words: int
    metadata: tuple[str, ...]
    bias: float
    weights: np.ndarray  # features
    factors: np.ndarray  # features x rank

    def raw(self, at: np.ndarray, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The sum before the logistic of vectors whose entries lie one after the other from ``starts``; none may be empty."""
        v = self.factors[at] * x[:, None]
        sums, squares = np.add.reduceat(v, starts), np.add.reduceat(v * v, starts)
        return self.bias + np.add.reduceat(self.weights[at] * x, starts) + 0.5 * (sums * sums - squares).sum(axis=1)

    def score(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> list[float]:
        out: list[float] = []
        lo = 0
        while lo < len(vectors):
            hi, n = lo, 0
            while hi < len(vectors) and (hi == lo or n + len(vectors[hi][0]) <= ENTRIES):
                n += len(vectors[hi][0])
                hi += 1
            sizes = [len(a) for a, _ in vectors[lo:hi]]
            z = self.raw(np.concatenate([a for a, _ in vectors[lo:hi]]), np.concatenate([x for _, x in vectors[lo:hi]]), np.cumsum([0, *sizes[:-1]]))
            out.extend(logistic(z).tolist())
            lo = hi
        return out


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def slices(text: str) -> Iterator[str]:
    """The text in pieces of about SLICE characters, cut before a character that is part of no word."""
    lo = 0
    while lo < len(text):
        cut = _BREAK.search(text, lo + SLICE)
        hi = cut.start() if cut else len(text)
        yield text[lo:hi]
        lo = hi


class Vectors:
    """Sparse vectors of texts; remembers the buckets of the words it met last."""

    def __init__(self, words: int, metadata: tuple[str, ...] = (), remembered: int = 200_000):
        self.words, self.metadata, self.remembered = words, metadata, remembered
        self.bucket: dict[str, int] = {}

    @property
    def size(self) -> int:
        return self.words + len(STATISTICS) * BINS + len(self.metadata) * LEVELS

    def _counts(self, text: str) -> tuple[dict[int, int], int, int]:
        """Occurrences by bucket, words, and words equal to the one before."""
        found: dict[int, int] = {}
        n = repeats = 0
        last = None
        for piece in slices(text):
            words = _WORD.findall(piece.lower())
            if not words:
                continue
            repeats += sum(map(operator.eq, words, words[1:])) + (words[0] == last)
            last = words[-1]
            n += len(words)
            for word, k in Counter(words).items():
                b = self.bucket.get(word)
                if b is None:
                    if len(self.bucket) >= self.remembered:
                        self.bucket.clear()
                    b = self.bucket[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % self.words
                found[b] = found.get(b, 0) + k
        return found, n, repeats

    def of(self, text: str | None, metadata: Iterable[object] = ()) -> tuple[np.ndarray, np.ndarray]:
        """Places (ascending within a block) and values of the vector of one text; a null text is an empty one."""
        text = text or ""
        counts, n, repeats = self._counts(text)
        histogram = np.zeros(256, np.int64)
        for lo in range(0, len(text), SLICE):
            histogram += np.bincount(np.frombuffer(text[lo : lo + SLICE].encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
        chars = max(int(histogram[_START].sum()), 1)
        lines = [line for line in text.split("\n") if line.strip()]
        share = lambda k, of: 1.5 * math.log2(1 + 1000 * k / max(of, 1))
        levels = [
            math.log2(chars), math.log2(1 + n), 2 * min(chars / (n + 1), 11), share(len(counts), n), share(max(counts.values(), default=0), n), share(repeats, n),
            *(share(int(histogram[c].sum()), chars) for c in _CLASSES.values()),
            2 * math.log2(1 + n / max(len(lines), 1)), share(len(lines) - len(set(lines)), len(lines)),
        ]
        at, x = [], []
        norm = 1 / math.sqrt(sum((1 + math.log(k)) ** 2 for k in counts.values()) or 1)
        for b in sorted(counts):
            at.append(b), x.append((1 + math.log(counts[b])) * norm)
        for s, level in enumerate(levels):
            low = min(int(level), BINS - 2)
            high = min(level - low, 1.0)
            base = self.words + s * BINS + low
            at.extend((base, base + 1)), x.extend((1 - high, high))
        for m, value in enumerate(metadata):
            at.append(self.words + len(STATISTICS) * BINS + m * LEVELS + level_of(value)), x.append(1.0)
        return np.array(at, np.int32), np.array(x, np.float32)


def level_of(value: object) -> int:
    """Level of a metadata value: 0 for null, numbers by sign and size, anything else by hash."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return 0
    if isinstance(value, int | float):
        size = min(int(math.log2(1 + abs(value))), 30) if math.isfinite(value) else 30
        return 1 + size if value >= 0 else 32 + size
    return 1 + zlib.crc32(str(value).encode("utf-8", "surrogatepass")) % (LEVELS - 1)


def gradients(machine: Machine, at: np.ndarray, x: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Gradients of the mean weighted cross-entropy by bias, weights and factors."""
    sizes = np.diff(np.append(starts, len(at)))
    row = np.repeat(np.arange(len(starts)), sizes)
    miss = (logistic(machine.raw(at, x, starts)) - y) * weight / len(y)
    v = machine.factors[at] * x[:, None]
    sums = np.add.reduceat(v, starts)
    slope = (miss[row] * x)[:, None] * (sums[row] - v)
    by_weight = np.bincount(at, miss[row] * x, len(machine.weights))
    by_factor = np.stack([np.bincount(at, slope[:, f], len(machine.weights)) for f in range(machine.factors.shape[1])], axis=1)
    return float(miss.sum()), by_weight, by_factor


def fit(vectors: list[tuple[np.ndarray, np.ndarray]], labels: list[int], weights: list[float], size: int, words: int, metadata: tuple[str, ...], how: Training) -> Machine:
    """Fits a machine by Adam on vectors with labels 0 and 1."""
    rng = np.random.default_rng(how.seed)
    machine = Machine(words, metadata, 0.0, np.zeros(size), rng.normal(0, 0.05, (size, how.rank)))
    y, weight = np.array(labels, float), np.array(weights)
    share = min(max(float(np.average(y, weights=weight)), 1e-3), 1 - 1e-3)
    machine.bias = math.log(share / (1 - share))
    bias = np.array([machine.bias])
    params = [bias, machine.weights, machine.factors]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(how.epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), how.batch):
            pick = order[lo : lo + how.batch]
            step += 1
            sizes = [len(vectors[k][0]) for k in pick]
            at, x = np.concatenate([vectors[k][0] for k in pick]), np.concatenate([vectors[k][1] for k in pick])
            found = gradients(machine, at, x, np.cumsum([0, *sizes[:-1]]), y[pick], weight[pick])
            for param, grad, (m, v) in zip(params, (np.array([found[0]]), *found[1:]), moments, strict=True):
                grad = grad + how.decay * param
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                param -= how.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            machine.bias = float(bias[0])
    return machine


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: CRC-32 of the id as text, modulo 4, is 2. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn(
    docs: DataFrame, labels: DataFrame, how: Training = Training(), *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", metadata: tuple[str, ...] = (),
) -> Machine:
    """Fits a machine on at most ``how.max_rows`` labelled rows that are not held out.

    Of each label the first ids by hash teach, half of the bound each, or what
    the other label leaves. Classes weigh as they do among all teaching labels.
    Labels other than 0 and 1 do not teach, nor does an id with both, or a null
    one. Of rows that share an id, that with the least hash of its text
    teaches; a null text teaches as an empty one. Without teaching rows every
    score is 0.5; with one label only, the scores lean to it.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    vectors = Vectors(how.words, metadata)
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).filter(F.col("i").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("i")))
    known = known.groupBy("i").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z").drop("z")
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    few = min(counts.values(), default=0) if len(counts) == 2 else 0
    quota = {y: min(n, max(how.max_rows // 2, how.max_rows - few)) for y, n in counts.items()}
    if not counts:
        return Machine(how.words, metadata, 0.0, np.zeros(vectors.size), np.zeros((vectors.size, how.rank)))
    parts = [known.filter(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(q) for y, q in sorted(quota.items())]
    chosen = F.broadcast(parts[0] if len(parts) == 1 else parts[0].union(parts[1]))
    rows = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), *(F.col(f"`{c}`").alias(f"m{k}") for k, c in enumerate(metadata)))
    rows = rows.join(chosen, "i")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Vectors(how.words, metadata)
        for batch in batches:
            made = [make.of(t.as_py(), [m.as_py() for m in extra]) for t, *extra in zip(batch["t"], *(batch[f"m{k}"] for k in range(len(metadata))), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch["i"], batch["h"], batch["y"], pa.array([a.tobytes() for a, _ in made], pa.binary()), pa.array([x.tobytes() for _, x in made], pa.binary())],
                ["i", "h", "y", "at", "x"],
            )

    schema = StructType().add("i", rows.schema["i"].dataType).add("h", "long").add("y", "integer").add("at", "binary").add("x", "binary")
    made = rows.withColumn("h", F.xxhash64("t")).mapInArrow(run, schema)
    made = made.groupBy("i").agg(F.min(F.struct("h", "at", "x", "y")).alias("r")).select("i", "r.*").collect()
    made.sort(key=lambda r: (zlib.crc32(str(r.i).encode()), str(r.i)))
    taught = Counter(r.y for r in made)
    if not taught:
        return Machine(how.words, metadata, 0.0, np.zeros(vectors.size), np.zeros((vectors.size, how.rank)))
    whole, here = sum(counts.values()), sum(taught.values())
    weight = {y: counts[y] / whole * here / n for y, n in taught.items()}
    sparse = [(np.frombuffer(r.at, np.int32), np.frombuffer(r.x, np.float32)) for r in made]
    return fit(sparse, [r.y for r in made], [weight[r.y] for r in made], vectors.size, how.words, metadata, how)


def score(docs: DataFrame, machine: Machine, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row, from its whole text and the metadata columns that the machine was fitted with.

    Null and empty texts are scored by their structure alone. Repeated rows and
    ids are scored each; a null id stays. Other columns are ignored, whatever
    their names. Empty input gives an empty result. The machine (some hundred
    thousand numbers) is broadcast.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    extra = range(len(machine.metadata))
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), *(F.col(f"`{c}`").alias(f"m{k}") for k, c in enumerate(machine.metadata)))
    schema = StructType().add("doc_id", rows.schema["i"].dataType).add("score", "double")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        make = Vectors(fitted.words, fitted.metadata)
        for batch in batches:
            scores: list[float] = []
            held: list[tuple[np.ndarray, np.ndarray]] = []
            entries = 0
            for t, *meta in zip(batch["t"], *(batch[f"m{k}"] for k in extra), strict=True):
                held.append(make.of(t.as_py(), [m.as_py() for m in meta]))
                entries += len(held[-1][0])
                if entries > ENTRIES:
                    scores += fitted.score(held)
                    held, entries = [], 0
            scores += fitted.score(held)
            yield pa.RecordBatch.from_arrays([batch["i"], pa.array(scores, pa.float64())], schema.names)

    return rows.mapInArrow(run, schema)
