"""Corpus pipeline: quality rules, language, near duplicates, decontamination, tokens.

Each stage takes the rows that its predecessor kept and returns the rows that
it keeps, with the columns of documents; the last returns token digests. Every
decision is a row's own, or a join on the document id and the text's hash.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm import bpe, decontaminate, jaccard, langid, quality
from tickforge.llm.shared import few, written

#: A language is rejected below this score of a network of four labels; of k labels, below 4 / k of it (1 at most).
MIN_LANGUAGE_SCORE = 0.3
#: A language is also rejected below the score that this share of its own held-out rows does not reach.
REJECTED_SHARE = 0.005
#: Held-out rows of a label from which their scores tell what is low.
TELLING_ROWS = 20


def _packed(docs: DataFrame) -> DataFrame:
    """The row as one column _doc, beside _id and _text, so that no column of its own meets an operator's."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), F.col("doc_id").alias("_id"), F.col("text").alias("_text"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and stay near a language's reference histograms.

    Null, empty and very short texts fail the base rules; repeated rows are
    judged each; texts of any length are judged whole; an empty table stays
    empty. Extra columns pass through whatever their names.
    """
    return quality.accepted(docs)


def language_thresholds(docs: DataFrame, network: langid.ByteNetwork) -> dict[str, float]:
    """Least score of each label, from rows with this label that did not teach and are predicted right.

    The largest of k softmax values is 1 / k at least, and texts in no learned
    language score far above that; only the scores of rows known to be in the
    language tell what is low. A label with too few such rows for the quantile
    (199) goes by the least of them, less a tenth of what lies above the
    floor; one with less than TELLING_ROWS, or a network of one label, has the
    floor alone.
    """
    floor = min(MIN_LANGUAGE_SCORE * 4 / max(len(network.labels), 1), 1.0)
    rows = docs.filter(langid.held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("_lang"))
    found = langid.identify(rows, network, keep=("_lang",)).filter("lang_pred = _lang")
    low = found.groupBy("lang_pred").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("score", REJECTED_SHARE, 100_000).alias("low")).collect()
    lower = lambda r: r.low if REJECTED_SHARE * (r.n + 1) >= 1 else r.low - 0.1 * (r.low - floor)
    told = {r.lang_pred: max(floor, lower(r)) for r in low if r.n >= TELLING_ROWS}
    return {label: told.get(label, floor) for label in network.labels}


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has letters and a language that the network is fairly sure of.

    Null and empty texts are in no language and go; a null label neither
    teaches nor counts against its row; a null id is an id like others;
    repeated rows are judged each, by all windows of texts of any length. If
    no row has a label, no language is known and all rows go. An empty table
    stays empty. Extra columns pass through whatever their names.
    """
    network = langid.learn(docs)
    sure = F.lit(False)
    for label, least in language_thresholds(docs, network).items():
        sure |= (F.col("lang_pred") == label) & (F.col("score") >= least)
    found = langid.identify(_packed(docs), network, id_col="_id", text_col="_text", keep=("_doc",))
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & sure).select("_doc.*")


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: of the least id, null ids last. Rows without words stay.

    A row is told by its id and its text's hash; of rows that repeat both, one
    stays (any of them, if other columns differ). Rows of one id and different
    texts are decided each. Null and empty texts are linked with nothing and
    stay, copies too. An empty table stays empty. Extra columns pass through
    whatever their names.
    """
    groups = jaccard.near_duplicates(docs, by_row=True).filter("component is not null")
    rows = written(groups.groupBy("component", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")), "duplicate-rows")
    # Only components of several rows have anything to decide; as a written table their join can split a large one's rows.
    least = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first"), F.sum("n").alias("k"))
    least = written(least.filter("k > 1").drop("k"), "duplicate-firsts")
    first = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.text_hash") == F.col("text_hash"))
    judged = rows.join(few(least), "component").withColumn("_first", first).filter("n > 1 or not _first")
    others = written(judged.select(F.col("doc_id").alias("_other_id"), F.col("text_hash").alias("_other_hash"), "_first"), "duplicate-others")
    n, n_first = others.agg(F.count(F.lit(1)), F.count_if("_first")).first()
    side = few(others, n)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"))
    same = F.col("_id").eqNullSafe(F.col("_other_id")) & (F.col("_hash") == F.col("_other_hash"))
    kept = packed.join(side, same, "left_anti").select("_doc.*")
    if n_first:
        repeated = packed.join(side.filter("_first"), same).select("_doc", "_id", "_hash").dropDuplicates(["_id", "_hash"])
        kept = kept.unionByName(repeated.select("_doc.*"))
    return kept


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a window of benchmark words.

    Null and empty texts hold none and stay; repeated rows are scanned each,
    texts of any length whole; with an empty benchmark all rows stay. An empty
    table stays empty. Extra columns pass through whatever their names.
    """
    found = decontaminate.contamination(_packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_id", text_col="_text", keep=("_doc",))
    return found.filter("not contaminated").select("_doc.*")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no tokens; null ids and repeated rows are rows
    like others; long texts are encoded in slices. An empty table gives an
    empty result. Extra columns are left out.
    """
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_stage),
    ("language ID", language_stage),
    ("near duplicates", duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("tokens", token_stage),
]

#: The language stage is a trained model, which SQL cannot express; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each but the last written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
