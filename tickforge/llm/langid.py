"""Language identification by a byte convolutional network in numpy.

Bytes are embedded; filters of several widths run over a fixed-length window;
each filter keeps its largest answer (max pooling); a softmax layer turns
these into language scores. A text is cut into consecutive windows from its
first byte to its last, and its score is the softmax of the mean of its
windows' logits, weighted by their bytes.

The network is trained on the driver, on windows of a bounded sample of
labelled rows (``Training.max_rows``, the same number of each label where there
are so many, chosen by hash; of a text ``Training.windows`` windows, spread by
hash over all of it). It is applied to every window of every row where the row
lies. Filters narrower than the widest are held as widest filters with
zeros, so a window's answers are one matrix product.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import bounded_batches

UNKNOWN = "und"
_LETTERLIKE = re.compile(r"[^\W\d_]")
#: Windows in one matrix product.
BATCH = 64


def has_letter(text: str) -> bool:
    """Whether a character is a letter (Unicode L); fractions, superscripts and numerals in circles are none."""
    return any(m[0].isalpha() for m in _LETTERLIKE.finditer(text))


@dataclass(frozen=True)
class Training:
    """Bounds of the labelled sample and of the fit."""

    max_rows: int = 3000
    #: Most labels the network tells apart: those with most rows. Each has at least max_rows / max_labels rows to teach it.
    max_labels: int = 200
    windows: int = 6
    window: int = 256
    embedding: int = 8
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    epochs: int = 3
    rate: float = 0.01
    seed: int = 7


@dataclass
class ByteNetwork:
    labels: list[str]
    window: int
    table: np.ndarray  # 256 x embedding
    kernel: np.ndarray  # (widest * embedding) x all filters
    bias: np.ndarray
    out: np.ndarray  # all filters x labels
    out_bias: np.ndarray

    @property
    def widest(self) -> int:
        return self.kernel.shape[0] // self.table.shape[1]

    def patches(self, octets: np.ndarray) -> np.ndarray:
        """windows x window bytes -> windows x window x (widest * embedding); behind the end stand zero bytes."""
        n, w = octets.shape
        padded = np.zeros((n, w + self.widest - 1), np.uint8)
        padded[:, :w] = octets
        e = self.table[padded]
        return np.lib.stride_tricks.as_strided(e, (n, w, self.kernel.shape[0]), e.strides)

    def pooled(self, octets: np.ndarray) -> np.ndarray:
        rows = np.ascontiguousarray(self.patches(octets)).reshape(-1, self.kernel.shape[0])
        answers = (rows @ self.kernel).reshape(*octets.shape, -1)
        return np.maximum(answers.max(axis=1) + self.bias, 0)

    def logits(self, octets: np.ndarray) -> np.ndarray:
        parts = [self.pooled(octets[lo : lo + BATCH]) for lo in range(0, len(octets), BATCH)]
        return np.concatenate(parts) @ self.out + self.out_bias if parts else np.zeros((0, len(self.labels)), np.float32)

    def predict(self, texts: Iterable[str | None]) -> Iterator[tuple[str, float]]:
        """(label, score) of each text; ``und`` and 0 without a letter."""
        held: list[bytes] = []
        sizes: list[int] = []

        def flush() -> Iterator[tuple[str, float]]:
            w = self.window
            counts = [-(-n // w) for n in sizes]
            flat = np.frombuffer(b"".join(b + b"\0" * (-len(b) % w) for b in held), np.uint8).reshape(-1, w)
            logits = self.logits(flat)
            at = 0
            for n, c in zip(sizes, counts, strict=True):
                if not n:
                    yield UNKNOWN, 0.0
                    continue
                weight = np.full(c, w, np.float32)
                weight[-1] = n - (c - 1) * w
                z = weight @ logits[at : at + c] / n
                at += c
                z = np.exp(z - z.max())
                k = int(z.argmax())
                yield self.labels[k], float(z[k] / z.sum())
            held.clear(), sizes.clear()

        octets = 0
        for text in texts:
            raw = text.encode("utf-8", "surrogatepass") if text and has_letter(text) else b""
            held.append(raw), sizes.append(len(raw))
            octets += len(raw)
            if octets > 1 << 20 or len(held) >= 256:
                yield from flush()
                octets = 0
        yield from flush()


def teaching_windows(text: str, key: int, how: Training = Training()) -> list[bytes]:
    """At most ``how.windows`` of the text's consecutive windows, from places drawn by the key."""
    raw = text.encode("utf-8", "surrogatepass")
    n = -(-len(raw) // how.window)
    places = sorted(np.random.default_rng(key).choice(n, how.windows, replace=False).tolist()) if n > how.windows else range(n)
    return [raw[k * how.window : (k + 1) * how.window] for k in places]


def gradients(net: ByteNetwork, x: np.ndarray, y: np.ndarray, weight: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
    """Gradients of the mean weighted cross-entropy by table, kernel, bias, out and out_bias; mask says where filters have taps."""
    n, w = x.shape
    f, e, widest = net.kernel.shape[1], net.table.shape[1], net.widest
    patches = net.patches(x)
    answers = (np.ascontiguousarray(patches).reshape(-1, net.kernel.shape[0]) @ net.kernel).reshape(n, w, f)
    where = answers.argmax(axis=1)  # n x f
    top = np.take_along_axis(answers, where[:, None, :], axis=1)[:, 0] + net.bias
    h = np.maximum(top, 0)
    z = h @ net.out + net.out_bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(n), y] -= 1
    dz = p * weight[:, None] / n
    dh = (dz @ net.out.T) * (top > 0)
    seen = patches[np.arange(n)[:, None], where]  # n x f x (widest * e): what each filter answered to
    dkernel = np.einsum("nfk,nf->kf", seen, dh) * mask
    dseen = (dh[:, :, None] * net.kernel.T[None]).reshape(n, f, widest, e)
    padded = np.pad(x, ((0, 0), (0, widest - 1)))
    touched = padded[np.arange(n)[:, None, None], where[:, :, None] + np.arange(widest)]
    dtable = np.zeros_like(net.table)
    np.add.at(dtable, touched.ravel(), dseen.reshape(-1, e))
    return dtable, dkernel, dh.sum(0), h.T @ dz, dz.sum(0)


def fresh(labels: list[str], how: Training = Training()) -> tuple[ByteNetwork, np.ndarray]:
    """A network before training, and where its filters have taps."""
    rng = np.random.default_rng(how.seed)
    e, f, widest = how.embedding, how.filters * len(how.widths), max(how.widths)
    mask = np.concatenate([np.repeat(np.arange(widest) < w, e)[:, None].repeat(how.filters, 1) for w in how.widths], axis=1).astype(np.float32)
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    net = ByteNetwork(
        labels, how.window, normal(256, e, scale=0.5), normal(widest * e, f, scale=0.2) * mask, np.zeros(f, np.float32),
        normal(f, len(labels), scale=0.1), np.zeros(len(labels), np.float32),
    )
    return net, mask


def train(windows: list[bytes], langs: list[str], how: Training = Training()) -> ByteNetwork:
    """Fits the network by Adam on windows of known language: a window weighs as its bytes, and each language the same."""
    labels = sorted(set(langs))
    number = {x: k for k, x in enumerate(labels)}
    x = np.frombuffer(b"".join(w.ljust(how.window, b"\0") for w in windows), np.uint8).reshape(-1, how.window)
    y = np.array([number[lang] for lang in langs], np.int64)
    share = np.array([len(w) / how.window for w in windows])
    weight = (share * (len(y) / len(labels) / np.bincount(y, weights=share))[y]).astype(np.float32)
    net, mask = fresh(labels, how)
    params = [net.table, net.kernel, net.bias, net.out, net.out_bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    rng = np.random.default_rng(how.seed)
    step = 0
    for _ in range(how.epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), BATCH):
            pick = order[lo : lo + BATCH]
            step += 1
            for param, grad, (m, v) in zip(params, gradients(net, x[pick], y[pick], weight[pick], mask), moments, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                param -= how.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: CRC-32 of the id as text, modulo 5, is 0. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, how: Training = Training(), *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteNetwork:
    """Trains on at most ``how.max_rows`` labelled rows that are not held out: of each label the first by hash of the id.

    Labels are counted over all rows, so a rare language teaches as many rows
    as a common one if it has them. Rows without text, letters or label do not
    teach, nor do rows of labels beyond ``how.max_labels``, which are predicted
    as one of the learned ones; rows alike in id and text teach once. Without any teaching row the network knows no label, and every
    prediction is ``und``. What reaches the driver is bounded by ``how``:
    labels' counts of the most frequent, and windows of the sample.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"))
    rows = rows.filter(~held_out(F.col("i")) & F.col("l").isNotNull() & F.col("t").isNotNull())
    # Rows alike in id and text are one; the estimate of their number only sets how much of the hash range is looked at.
    counts = rows.groupBy("l").agg(F.approx_count_distinct(F.xxhash64("i", "t"), 0.02).alias("n")).orderBy(F.desc("n"), "l").limit(how.max_labels).collect()
    if not counts:
        return ByteNetwork([], how.window, np.zeros((256, how.embedding), np.float32), *([np.zeros(0, np.float32)] * 4))
    # Small labels leave what they lack of an equal share to the others.
    left, quota = how.max_rows, {}
    for k, r in enumerate(reversed(counts)):
        quota[r.l] = min(r.n, left // (len(counts) - k))
        left -= quota[r.l]
    # The hash range is cut to what the quota needs before any text moves; row numbers then meet a bounded rest.
    span = 1 << 32
    bounds = {r.l: span if r.n <= 4 * quota[r.l] else int(span * 2 * quota[r.l] / r.n) for r in counts}
    table = spark_map(bounds)
    part = rows.withColumn("k", F.pmod(F.xxhash64("i", "t"), F.lit(span))).filter(F.col("k") < F.try_element_at(table, F.col("l")))
    part = part.groupBy("l", "k").agg(F.min("t").alias("t"))  # repeated rows teach once
    order = Window.partitionBy("l").orderBy("k")
    part = part.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= F.try_element_at(spark_map(quota), F.col("l")))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["t"].to_pylist()
            found = [teaching_windows(t, k, how) if has_letter(t) else [] for t, k in zip(texts, batch["k"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["l"], batch["k"], pa.array(found, pa.list_(pa.binary()))], ["l", "k", "windows"])

    sample = part.select("l", "k", "t").mapInArrow(cut, "l string, k long, windows array<binary>").collect()
    pairs = sorted((r.l, r.k, bytes(w)) for r in sample for w in r.windows)
    if not pairs:
        return ByteNetwork([], how.window, np.zeros((256, how.embedding), np.float32), *([np.zeros(0, np.float32)] * 4))
    return train([w for _, _, w in pairs], [lang for lang, _, _ in pairs], how)


def spark_map(numbers: dict[str, int]) -> Column:
    return F.create_map(*(x for k, v in numbers.items() for x in (F.lit(k), F.lit(v).cast("long"))))


def identify(docs: DataFrame, network: ByteNetwork, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Predicted language of every whole text: doc_id, lang_pred, score, and the columns named in ``keep``.

    Null texts and texts without a letter are ``und`` with score 0. Repeated
    rows are predicted each; of labels with equal scores the first by name wins.
    A text of any length is read whole. Empty input gives an empty result. Of a kept
    column with the name of a result, the result stays. The network (some ten
    thousand numbers) is broadcast.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(network)
    carried = [c for c in keep if c not in ("doc_id", "lang_pred", "score")]
    # The rows' own columns go by number, so none can clash with a name in use here.
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *(F.col(f"`{c}`").alias(f"_own_{k}") for k, c in enumerate(carried)))
    schema = StructType().add("doc_id", rows.schema["_id"].dataType).add("lang_pred", "string").add("score", "double")
    for k, c in enumerate(carried):
        schema = schema.add(c, rows.schema[f"_own_{k}"].dataType)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            texts = (x.as_py() for x in batch["_text"])
            found = list(net.predict(texts)) if net.labels else [(UNKNOWN, 0.0)] * batch.num_rows
            columns = [batch["_id"], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*columns, *(batch[f"_own_{k}"] for k in range(len(carried)))], schema.names)

    return rows.mapInArrow(run, schema)


def crc_fold(doc_id: object) -> int:
    """The fold of an id, as ``held_out`` has it."""
    return zlib.crc32(str(doc_id).encode()) % 5
