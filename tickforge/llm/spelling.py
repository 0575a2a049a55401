"""Groups of spelling variants: words one edit apart, each led to its far more frequent neighbour.

Near words are found by asymmetric q-chunks. Of two words one edit apart the
shorter (of equals each) gives two disjoint chunks of half its length, q: its
first q code points and its last q. The edit spares one of them, and what is
spared stands in the other word as a positional gram: at the same place, or
one further on if an insertion lies before it. So the longer word gives its
grams of that q which lie within that shift (the prefix at 0, and the gram one
further than the chunk's place if it is a code point longer); grams elsewhere
could meet no chunk and are not written. One equi-join on (length, which
chunk, gram) proposes pairs, and ``levenshtein`` verifies them.

A gram that many words share would propose the square of their number. Where
it proposes over ``DENSE`` pairs a row, the rest of each word (behind or before
the gram) is held to one edit in its turn, so its two halves are chunks again,
and the gram's rows go to the join with the longer key. Rests shrink by half
each time, and of words alike but for one code point there are no more than
letters, so no group grows with the vocabulary, and no pair is lost.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, discard, few, written

LETTERS = "A-Za-zÀ-ÿ"
#: Pairs that a gram may propose for each of its rows before its words are split further.
DENSE = 64
#: Characters of a text searched at once, and distinct words a task holds before it hands them on.
SLICE, HELD = 1 << 20, 200_000
_NO_LETTER = re.compile(f"[^{LETTERS}]")


def lower_ascii(run: str) -> str:
    return run.lower() if run.isascii() else re.sub("[A-Z]+", lambda m: m[0].lower(), run)


def spelled(prefix: int, run: str, every: int) -> str:
    """A lower-cased run as its document has it: where ``every`` divides the checksum h, without the code point h % length."""
    h = zlib.crc32(run.encode(), prefix)
    if h % every:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def words_of(text: str, doc_id: object, min_length: int, every: int) -> Iterator[tuple[str, int]]:
    """Words of at least ``min_length`` code points of one whole text, with counts; a word may come more than once."""
    runs = re.compile(f"[{LETTERS}]{{{min_length},}}")
    prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode("utf-8", "surrogatepass"))
    lo = 0
    while lo < len(text):
        cut = _NO_LETTER.search(text, lo + SLICE)
        hi = cut.start() if cut else len(text)
        for run, n in Counter(runs.findall(text, lo, hi)).items():
            word = spelled(prefix, lower_ascii(run), every)
            if len(word) >= min_length:
                yield word, n
        lo = hi


def word_counts(docs: DataFrame, *, min_length: int = 7, min_count: int = 2, every: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n (occurrences) of all words of at least ``min_length`` code points that occur ``min_count`` times or more.

    A word is a maximal run of letters, A to Z lower-cased; where ``every``
    divides the CRC-32 of ``<doc_id>:<run>``, one code point is deleted. A null
    text has no words; a null id counts as empty text; repeated rows count
    each. Tasks hand on counts, so a frequent word is one row a task.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("i"), F.col(f"`{text_col}`").alias("t")).filter("t is not null")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for batch in batches:
            for i, t in zip(batch["i"], batch["t"], strict=True):
                for word, n in words_of(t.as_py(), i.as_py(), min_length, every):
                    held[word] = held.get(word, 0) + n
                if len(held) >= HELD:
                    yield _counts(held)
                    held = {}
        if held:
            yield _counts(held)

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _counts(held: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])


def _chunks(rest: Column, q: Column) -> Column:
    """The two ends of q code points of a rest, each with what is left of it: (which, gram, rest)."""
    length = F.length(rest)
    ends = ((0, F.substring(rest, F.lit(1), q), F.substring(rest, q + 1, length)), (1, F.substring(rest, length - q + 1, q), F.substring(rest, F.lit(1), length - q)))
    return F.array(*(F.struct(F.lit(k).alias("which"), gram.alias("gram"), left.alias("rest")) for k, gram, left in ends))


def _split(rows: DataFrame) -> DataFrame:
    """Rows (key, half, longer, word, n, rest) -> two rows each with the next gram in the key; ``half`` is the shorter rest's length."""
    q = F.floor(F.col("half") / 2).cast("int")
    cut = rows.withColumn("c", F.explode(_chunks(F.col("rest"), q)))
    key = F.concat("key", F.lit("/"), F.col("half").cast("string"), F.lit(":"), F.col("c.which").cast("string"), F.lit(":"), F.col("c.gram"))
    return cut.select(key.alias("key"), (F.col("half") - q).alias("half"), "longer", "word", "n", F.col("c.rest").alias("rest"))


def near_pairs(words: DataFrame) -> DataFrame:
    """a, a_n, b, b_n of the pairs of distinct words exactly one edit apart, each once; ``words`` (word, n) has each word once."""
    length = F.length("word")
    # A word gives chunks as itself, and grams as the longer of a pair (those as long as it are met among the chunks).
    roles = F.array(*(F.struct((length - k).alias("half"), F.lit(k).alias("longer")) for k in (0, 1)))
    rows = words.withColumn("r", F.explode(roles)).select(F.lit("").alias("key"), "r.half", "r.longer", "word", "n", F.col("word").alias("rest")).filter("half >= 1")
    found: list[DataFrame] = []
    old: list[DataFrame] = []
    while True:
        rows = written(_split(rows), "spelling-grams")
        counts = rows.groupBy("key").agg(F.sum(1 - F.col("longer")).alias("c"), F.count(F.lit(1)).alias("g"), F.max("half").alias("half"))
        dense = written(counts.filter((F.col("c") * F.col("g") > DENSE * (F.col("c") + F.col("g"))) & (F.col("half") >= 2)).select("key"), "spelling-dense")
        many = dense.count()
        here = rows if not many else rows.join(few(dense, many), "key", "left_anti")
        x = here.filter("longer = 0").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("rest").alias("a_rest"))
        y = here.select("key", "longer", F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("rest").alias("b_rest"))
        met = x.join(y, "key").filter((F.col("longer") == 1) | (F.col("a") < F.col("b")))
        found.append(written(met.filter(F.levenshtein("a_rest", "b_rest", 1) >= 0).select("a", "a_n", "b", "b_n"), "spelling-pairs"))
        old.append(dense)
        if not many:
            discard(rows, *old)
            break
        rest = written(rows.join(few(dense, many), "key", "left_semi"), "spelling-rest")
        discard(rows)
        old.append(rest)
        rows = rest
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    # An edit in the middle spares both chunks, so a pair may have been met twice.
    out = written(pairs.distinct(), "spelling-near")
    discard(*found)
    return out


def variants(words: DataFrame, *, times: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of ``words`` (word, n; each word once, none null).

    Its form is the near word with the largest n (of equals the first in
    code-point order), if that is at least ``times`` the word's own n; its root
    is the last word that forms lead to. As n grows by ``times`` at each step,
    chains are short: they are followed by doubling.
    """
    near = near_pairs(words)
    both = near.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("m")).union(near.select("b", "a", "a_n"))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    table = words.join(best, "word", "left")
    leads = F.coalesce(-F.col("best.m") >= times * F.col("n"), F.lit(False))
    table = written(
        table.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(leads, F.col("best.other")).alias("form"), F.when(leads, -F.col("best.m")).alias("form_n")),
        "spelling-words",
    )
    steps = written(table.filter("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    n = steps.count()
    while True:
        onward = few(steps.select(F.col("word").alias("root"), F.col("root").alias("further")), n)
        moved = written(steps.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        discard(steps)
        steps = moved
        if not moved.filter("moved").limit(1).count():
            break
        steps = moved.select("word", "root")
        steps._folder = moved._folder
    out = table.join(few(steps.select("word", "root"), n), "word", "left")
    discard(near)
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variant_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The variants of all words of whole texts (see ``word_counts`` and ``variants``); empty input gives an empty result."""
    words = written(word_counts(docs, id_col=id_col, text_col=text_col), "spelling-counts")
    return variants(words)
