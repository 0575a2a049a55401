"""Many nulls, repeats and labels at once: keys spread, what reaches the driver is bounded, names are unique."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickforge.llm import decontaminate, jaccard, langid, quality, sharding, url_rules, warc


def test_rows_without_ids_spread_over_keys_and_shards(spark):
    docs = spark.range(40000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("a").alias("source"))
    keyed = docs.select(F.octet_length("text").cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("crc"))
    keys = keyed.select(sharding.shuffle_key("mixture-1", F.lit(None), F.col("size"), F.col("crc")).alias("h"))
    cells = keys.groupBy(F.expr("shiftright(h, 55)").alias("c")).count().collect()
    assert len(cells) == 32 and max(r["count"] for r in cells) < 2 * 40000 / 32
    shards = sharding.stratified_shards(docs, 8)
    assert [r["count"] for r in shards.groupBy("shard").count().collect()] == [5000] * 8
    assert shards.select("shard", "slot").distinct().count() == 40000


def _texts(n, words=150):
    return [" ".join(["the", "of", "and"][k % 3] + " w" + str(k * j % 97) + "," for k in range(words)) for j in range(1, n + 1)]


def test_labels_of_single_rows_make_one_pooled_reference(spark):
    rows = [(k, t, f"label {k}") for k, t in enumerate(_texts(300))] + [(999, "§§ 12 " * 400, "odd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    strict = quality.Divergence(min_share=0.02)
    seen = []
    collect = type(docs).collect
    try:
        type(docs).collect = lambda self: seen.append(collect(self)) or seen[-1]
        refs = quality.references(docs, strict)
    finally:
        type(docs).collect = collect
    assert [r["lang"] for r in refs] == [None] and refs[0]["classes"] is not None
    assert max(map(len, seen)) < 6 * 1001 + 100
    same = quality.references(docs.withColumn("lang", F.lit("one")), strict)
    assert same[0]["classes"] == refs[0]["classes"] and same[0]["words"] == refs[0]["words"]
    verdicts = {r.doc_id: r.char_distance for r in quality.judge(docs, strict).collect()}
    assert verdicts[999] > strict.max_char_distance > verdicts[1] and all(d is not None for d in verdicts.values())


def test_many_labels_leave_the_driver_the_languages_alone(spark):
    rows = [(k, t, "en" if k % 2 else f"label {k}") for k, t in enumerate(_texts(200))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert [r["lang"] for r in quality.references(docs, quality.Divergence(min_share=0.02))] == ["en"]


@pytest.mark.parametrize("text", ["½ ²² ①", "12 34", "٣٤", "--", "ⅷ"])
def test_numerals_are_no_letters(text):
    assert not langid.has_letter(text)


def test_texts_of_numerals_have_no_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = langid.learn(docs, langid.Training(max_rows=60, epochs=1))
    odd = spark.createDataFrame([(1, "½ ²² ①"), (2, "½ a")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(odd, net).collect()}
    assert got[1] == "und" and got[2] != "und"


def test_teaching_rows_without_ids(spark):
    rows = [(None, f"hello number {'x' * (k % 50)} {k}", "en") for k in range(3000)] + [(None, "same text", "de")] * 2000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.learn(docs, langid.Training(max_rows=100, epochs=1))
    assert net.labels in (["de", "en"], [])  # id "" is in one fold
    docs = docs.withColumn("doc_id", F.lit(3))
    assert langid.learn(docs, langid.Training(max_rows=100, epochs=1)).labels == ["de", "en"]


def test_equal_benchmark_rows_fill_one_block(spark):
    same = [(1, "a b c d e f g h i j k")] * 3000
    other = [(k, " ".join(f"w{k}x{j}" for j in range(12))) for k in range(2, 60)]
    bench = spark.createDataFrame(same + other, "item_id long, text string")
    docs = spark.createDataFrame([(1, "x a b c d e f g h i j y"), (2, other[5][1]), (3, "none")], "doc_id long, text string")
    rows = lambda **how: sorted((r.doc_id, r.n_hit, r.n_items) for r in decontaminate.contamination(docs, bench, **how).collect())
    assert rows() == [(1, 10, 1), (2, 12, 1), (3, 0, 0)] == rows(block_states=200)
    cut = bench.distinct().select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("binary").alias("words"), F.lit(30).cast("long").alias("states"))
    parts = [b.collect() for b in decontaminate.blocks(cut, 200)]
    assert sum(map(len, parts)) == 59 and max(map(len, parts)) <= 6 or max(30 * len(p) for p in parts) <= 400


def test_record_names_are_unique(spark):
    long = "<p>" + "x" * 2000
    pages = spark.createDataFrame([(1, "u", "a"), (1, "u", "b"), (None, "u", "c"), (None, "u", "c"), (2, "v", long), (3, "w", long), (4, "w", long + "2"), (5, "v", long + "2"), (5, "v", long + "2")], "page_id long, url string, html string")
    table = warc.chunk_table(pages)
    heads = [warc._head(r.record_id, r.url, r.payload_digest, r.payload_bytes, r.refers_to, r.single, r.refers_single).decode() for r in table.collect() if r.chunk_no == 0]
    names = [re.search("WARC-Record-ID: (.*)\r", h)[1] for h in heads]
    assert len(names) == len(set(names)) == 9
    refers = [re.search("WARC-Refers-To: (.*)\r", h) for h in heads if "WARC-Type: revisit" in h]
    # Page 2 names page 3's record; page 4 refers to page 5, which two records have.
    assert [m and m[1] for m in refers].count(None) == 1 and {m[1] for m in refers if m} == {warc.record_urn(3)}
    kinds = Counter(r.record_type for r in warc.inventory(warc.archive(pages)).collect())
    assert kinds == {"response": 7, "revisit": 2}


def test_dollars_and_options_of_filter_lines():
    rule = url_rules.filter_rule
    assert rule("/banner[0-9]+$/").pattern == "(?i)banner[0-9]+$"
    assert rule("/ads$/").pattern == "(?i)ads$"
    for line in ("||x.com^$popup", "||x.com^$domain=a.com|b.com", "ads$third-party,script", "/ads[0-9]/$image"):
        assert rule(line) is None
    assert rule("||x.com^$important").pattern == rule("||x.com^").pattern
    kept = rule("Ads$match-case")
    assert re.search(kept.pattern, "h/Ads") and not re.search(kept.pattern, "h/ads")
    priced = rule("/price$100/page")
    assert priced is not None and re.search(priced.pattern, "h/price$100/page")


@pytest.mark.parametrize("strangers", [0, 7, 90])
def test_a_long_lists_rows_meet_once_for_each_block_of_strangers(spark, strangers):
    """A list of 1,200 sets in blocks of 40: all pairs that may link and are not joined yet meet, and few rows are handed out."""
    size, total = 40, 1200
    rng = np.random.default_rng(3)
    n = rng.integers(80, 110, total)
    n[: strangers // 3] = 400  # too far apart in size from the main component to meet it
    node = [k.to_bytes(16, "big") for k in range(total)]
    comp = [k if k < strangers else strangers for k in range(total)]
    big = spark.createDataFrame([(5, node[k], int(n[k])) for k in range(total)], "list_id long, node binary, n long")
    comps = spark.createDataFrame([(node[k], node[comp[k]]) for k in range(total)], "node binary, comp binary")

    placed = jaccard._in_order(big, ["list_id"], "1")
    own = {}
    for r in jaccard._chained(placed, size).collect():
        assert len(r["items"]) == 2
        for item in r["items"]:
            own.setdefault((item.i, item.j), []).append(r.n)
    assert max(map(len, own.values())) < 3 * size and len(own) <= 2 * total // size + 2

    rest = jaccard._unmet(big, comps, "1", size)
    if not strangers:
        assert rest is None
        return
    items, handed = {}, 0
    for r in rest.collect():
        for item in r["items"]:
            items.setdefault((item.i, item.j), []).append((int.from_bytes(r.node, "big"), item.side))
            handed += 1
    met = set()
    for rows in items.values():
        met |= {(min(a, b), max(a, b)) for a, s in rows for b, t in rows if a != b and (s != t or s == 0)}
    must = {(a, b) for a in range(strangers) for b in range(a + 1, total) if 5 * min(n[a], n[b]) >= 4 * max(n[a], n[b])}
    assert must <= met
    assert handed <= (strangers // size + 2) * (total + 3 * size)
