"""Distribution divergence: how far a document's histograms are from its language's references.

Two histograms are compared by Jensen-Shannon distance (base 2, so 0 to 1):
character classes (capitals, digits, punctuation, symbols, white space, the
rest) and common words (function words of several languages, and all others).
The references are the same counts summed over the whole corpus for each
language; a document is held against its nearest language, so a wrong or
missing language label costs it nothing. Very short documents have noisy
histograms, so each test has a minimum length below which it passes.

Two scans of the corpus, no shuffle of rows: one sums the references (a table
of languages x bins), one judges each row where it lies. Native expressions
throughout.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, written

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"

#: Frequent function words (fixed values, by language).
COMMON_WORDS: dict[str, str] = {
    "en": "the of and to in a is that for it was on with as are be this by from an",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "fr": "de la le et les des en un du une que est pour qui dans a par sur pas au",
    "es": "de la que el en y a los se del las un por con no una su para es al",
}


@dataclass(frozen=True)
class Divergence:
    """Limits of the distances and the lengths from which they count."""

    max_char_distance: float = 0.178
    max_word_distance: float = 0.318
    min_chars: int = 480
    min_words: int = 120
    min_share: float = 0.005
    common: frozenset[str] = field(default_factory=lambda: frozenset(" ".join(COMMON_WORDS.values()).split()))


#: Character classes in order; the last holds whatever the others do not.
CHAR_CLASSES = ("upper", "digit", "punct", "symbol", "space", "rest")


def words_of(text: Column) -> Column:
    """Runs of characters other than space, tab, and line and page breaks."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def _cut(text: Column) -> list[Column]:
    """What one reading of the text yields: its words, its length, and what is left without small letters and spaces."""
    text = F.coalesce(text, F.lit(""))
    left = F.regexp_replace(text, r"[\p{Ll}\x20\x09-\x0D]+", "")
    return [words_of(text).alias("_words"), F.length(text).cast("long").alias("_chars"), left.alias("_left")]


def _counts() -> list[Column]:
    """n_words, word_chars, n_symbols and the class counts, from what _cut made."""
    within = lambda pattern: F.regexp_count(F.col("_left"), F.lit(pattern)).cast("long")
    chars = F.length(F.array_join("_words", "")).cast("long")
    known = [within(r"\p{Lu}"), within("[0-9]"), within(r"[.,;:!?'\"()-]"), within("[#*$%&|<>]"), F.col("_chars") - chars]
    return [
        F.size("_words").cast("long").alias("n_words"), chars.alias("word_chars"), known[3].alias("n_symbols"),
        F.array(*known).alias("_known"),
    ]


def _classes() -> Column:
    """Counts by CHAR_CLASSES."""
    rest = F.col("_chars") - F.aggregate("_known", F.lit(0).cast("long"), lambda a, x: a + x)
    return F.array_append("_known", rest)


def _common(rules: Divergence) -> Column:
    return F.filter("_words", lambda w: w.isin(sorted(rules.common)))


def references(docs: DataFrame, rules: Divergence = Divergence(), *, text_col: str = "text", lang_col: str = "lang") -> list[dict]:
    """Each language's reference histograms, over all rows: [{lang, classes, words}].

    classes: the median share of each character class among documents of at
    least ``min_chars``, in thousandths (junk moves a mean, not a median),
    scaled to a sum of 1; None if the language has no such document. words:
    the share of each common word among all words. Rows without a language
    count only if no row has one. A label is a language if at least
    ``min_share`` of all labelled words are under it, so stray labels are
    none, and there are 1 / ``min_share`` at most. Where no label is one (as
    with a label of its own for each row), all rows that count make one pooled
    reference, named None. One scan into a written table of sums by label and
    bin; what reaches the driver is the sums of the languages alone.
    """
    cut = docs.select(F.col(lang_col).cast("string").alias("_lang"), *_cut(F.col(text_col)))
    counts = cut.select("_lang", "_chars", _common(rules).alias("_said"), *_counts()).withColumn("_classes", _classes())
    one = F.lit(1).cast("long")
    entry = lambda kind, key, n: F.struct(kind.cast("int").alias("kind"), key.cast("string").alias("key"), n.alias("n"))
    share = lambda n: (1000 * n - F.pmod(1000 * n, F.greatest(F.col("_chars"), one))) / F.greatest(F.col("_chars"), one)
    shares = F.transform("_classes", lambda n, k: entry(k, share(n).cast("long"), one))
    none = F.array().cast("array<struct<kind:int,key:string,n:bigint>>")
    entries = F.concat(
        F.array(entry(F.lit(-1), F.lit(""), F.col("n_words"))), F.when(F.col("_chars") >= rules.min_chars, shares).otherwise(none),
        F.transform("_said", lambda w: entry(F.lit(len(CHAR_CLASSES)), w, one)),
    )
    # An outer generator: the entries are never none, and Spark derives no filter that would build them twice.
    found = counts.select("_lang", F.inline_outer(entries)).groupBy("_lang", "kind", "key").agg(F.sum("n").alias("n"))
    found = written(found, "quality-sums")
    named = found.filter(F.col("kind") == -1)
    some = named.filter("_lang is not null").limit(1).count() > 0
    counted, named = (found.filter("_lang is not null"), named.filter("_lang is not null")) if some else (found, named)
    least = rules.min_share * (named.agg(F.sum("n")).first()[0] or 0)
    words = {r["_lang"]: r["n"] for r in named.filter((F.col("n") > 0) & (F.col("n") >= least)).collect()}
    if words:
        rows = counted.filter(F.col("_lang").isin([x for x in words if x is not None]) | (F.lit(None in words) & F.col("_lang").isNull())).collect()
    else:
        rows = counted.groupBy("kind", "key").agg(F.sum("n").alias("n")).withColumn("_lang", F.lit(None).cast("string")).collect()
        words = {None: r["n"] for r in rows if r["kind"] == -1 and r["n"]}
    discard(found)

    def median(lang: str | None, c: int) -> float | None:
        tally = sorted((int(r["key"]), r["n"]) for r in rows if r["_lang"] == lang and r["kind"] == c)
        half, seen = sum(n for _, n in tally) / 2, 0
        for t, n in tally:
            seen += n
            if seen >= half:
                return t + 0.5
        return None

    out = []
    for lang in sorted(words, key=lambda x: x or ""):
        middle = [median(lang, c) for c in range(len(CHAR_CLASSES))]
        classes = None if None in middle else [x / sum(middle) for x in middle]
        said = {r["key"]: r["n"] / words[lang] for r in rows if r["_lang"] == lang and r["kind"] == len(CHAR_CLASSES)}
        out.append({"lang": lang, "classes": classes, "words": said})
    return out


def _term(p: Column, q: Column) -> Column:
    """One bin's share of the Jensen-Shannon divergence, in bits."""
    half = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / half)).otherwise(F.lit(0.0))
    return (part(p) + part(q)) / 2


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _looked_up(keys: str, lookup: Column) -> Column:
    return F.transform(keys, lambda k: F.coalesce(F.try_element_at(lookup, k), F.lit(0.0)))


def _root(x: Column) -> Column:
    return F.sqrt(F.greatest(x, F.lit(0.0)))


def judge(docs: DataFrame, rules: Divergence = Divergence(), *, refs: list[dict] | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """All rows and columns of ``docs`` with the counts and the verdict.

    Added: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    base_failed, kept (boolean), char_distance, word_distance (double, null
    below the minimum lengths). Columns of these names are replaced.

    Null or empty text has no words and fails the base rules. Without any
    reference (an empty corpus) no distance is taken. Repeated rows are judged
    each, equal ones alike. The 3-word windows of a text are compared by 64-bit
    hash. A text is judged whole: the arrays of its words and of its windows'
    hashes stand in one task's memory.
    """
    refs = references(docs, rules, text_col=text_col, lang_col=lang_col) if refs is None else refs
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"]
    # The rows' own columns go by number meanwhile, so none can clash with a name in use here.
    names = [c for c in docs.columns if c not in added]
    own = [f"_own_{k}" for k in range(len(names))]
    at = lambda xs, i: F.get(F.col(xs), i)

    lines = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(names, own, strict=True)), *_cut(F.col(text_col)), lines.alias("_lines"))

    # One hash for each 3-word window; the document's common words, sorted.
    places = F.sequence(F.lit(0), F.size("_words") - 3)
    window = lambda i: F.xxhash64(at("_words", i), at("_words", i + 1), at("_words", i + 2))
    df = df.select(
        *own, "_chars", *_counts(), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_words") >= 3, F.transform(places, window)).otherwise(F.array().cast("array<bigint>")).alias("_h"),
        F.sort_array(_common(rules)).alias("_said"),
    )

    # Most texts repeat no window; of the others, the repeated hashes are those with an equal neighbour in sorted order.
    sorted_h = F.sort_array("_h")
    repeated = F.array_distinct(F.filter(F.zip_with(sorted_h, F.slice(sorted_h, F.lit(2), F.greatest(F.size("_h") - 1, F.lit(0))), lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull()))
    df = df.withColumns({
        "_dup": F.when(F.size(F.array_distinct("_h")) < F.size("_h"), repeated).otherwise(F.array().cast("array<bigint>")),
        "_uniq": F.array_distinct("_said"), "_classes": _classes(),
    }).drop("_known")

    # Places of repeated windows. Few hashes are looked up one by one; many are found by sorting (hash, place).
    pairs = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    few = F.filter(F.transform("_h", lambda h, i: F.when(F.array_contains("_dup", h), i)), lambda i: i.isNotNull())
    df = df.withColumns({
        "_pairs": F.when(F.size("_dup") > 32, pairs), "_few": F.when(F.size("_dup").between(1, 32), few),
        "_pos": F.transform("_uniq", lambda u: F.array_position("_said", u)),
    }).drop("_h", "_dup")
    near = lambda x, k: F.coalesce(at("_pairs", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(at("_pairs", k + 1)["h"] == x["h"], F.lit(False))
    many = F.sort_array(F.transform(F.filter("_pairs", near), lambda x: x["i"]))
    df = df.withColumns({
        "_at": F.coalesce(many, F.col("_few"), F.array().cast("array<int>")),
        # In sorted order a word's count is the gap to the next word's first place.
        "_p": F.transform("_uniq", lambda u, k: (F.coalesce(at("_pos", k + 1), F.size("_said") + F.lit(1)) - at("_pos", k)) / F.greatest(F.col("n_words"), F.lit(1))),
        "_cp": F.transform("_classes", lambda n: n / F.greatest(F.col("_chars"), F.lit(1))),
    }).drop("_pairs", "_few", "_pos", "_said", "_classes")
    # A window covers three words, or as many as there are to the next one.
    covered = F.transform("_at", lambda p, k: F.least(F.lit(3), F.coalesce(at("_at", k + 1) - p, F.lit(3))).cast("long"))
    df = df.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)).drop("_at")

    chars, words = [], []
    for ref in refs:
        if ref["classes"] is not None:
            chars.append(_root(_total(F.zip_with("_cp", F.array(*map(F.lit, ref["classes"])), _term))))
        # Words that the document lacks add half of their reference share each: in all, half of what its own words leave.
        share = dict(sorted(ref["words"].items()))
        lookup = F.create_map(*(F.lit(x) for pair in share.items() for x in pair)) if share else F.create_map().cast("map<string,double>")
        qs = _looked_up("_uniq", lookup)
        own_q, rest_q = _total(qs), 1 - sum(share.values())
        rest = _term(F.greatest(1 - _total(F.col("_p")), F.lit(0.0)), F.lit(max(rest_q, 0.0)))
        words.append(_root(_total(F.zip_with("_p", qs, _term)) + rest + F.greatest(F.lit(sum(share.values())) - own_q, F.lit(0.0)) / 2))
    nearest = lambda xs: F.array_min(F.array(*xs)) if xs else F.lit(None).cast("double")
    df = df.withColumn("char_distance", F.when(F.col("_chars") >= rules.min_chars, nearest(chars)))
    df = df.withColumn("word_distance", F.when(F.col("n_words") >= rules.min_words, nearest(words)))
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    near_enough = lambda c, most: F.coalesce(F.col(c) <= most, F.lit(True))
    kept = ~F.col("base_failed") & near_enough("char_distance", rules.max_char_distance) & near_enough("word_distance", rules.max_word_distance)
    # Behind a generator no filter on the verdict takes the chain of expressions apart, once for each use.
    judged = F.struct(*(kept.alias(c) if c == "kept" else F.col(c).alias(c) for c in added))
    df = df.select(*own, F.inline_outer(F.array(judged)).alias(*added))
    return df.select(*(F.col(k).alias(c) for c, k in zip(names, own, strict=True)), *added)


def accepted(docs: DataFrame, rules: Divergence = Divergence(), *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows that ``judge`` keeps, with exactly the columns of ``docs`` whatever their names."""
    packed = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(text_col).alias("_doc_text"), F.col(lang_col).alias("_doc_lang"))
    return judge(packed, rules, text_col="_doc_text", lang_col="_doc_lang").filter("kept").select("_doc.*")
