"""Factorisation machine, whitening and spelling variants against plain loops, library results and odd tables."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickforge.llm import factorisation, spelling, whitening
from tickforge.llm.queries import QUERIES

ODD = [
    (1, None, 1), (2, "", 0), (3, " \n\t ", None), (4, "one", 3), (5, "one two\none two\n" * 3, 15), (5, "one two\none two\n" * 3, 15), (6, "x" * 3000, -5), (7, "ÄÖ é 日本 12,5 don't", 7),
    (None, "no id at all", 2), (8, "Wörterbuch Wörterbuch wörterbuch wörtebuch wörtebuch × ÷", 1), (9, "word " * 30000, 150000), (10, "퟿ İ ﬁ ǅ", 9),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, n_chars long")
    return df.withColumns({c: F.lit("x") for c in ("i", "t", "m0", "h", "at", "y", "score", "word", "n", "key", "rest", "form", "root", "c", "half")})


# ---- factorisation machine


def _plain(machine, at, x):
    z = machine.bias + sum(machine.weights[i] * v for i, v in zip(at, x))
    for p in range(len(at)):
        for q in range(p):
            z += machine.factors[at[p]] @ machine.factors[at[q]] * x[p] * x[q]
    return z


def test_machine_equals_plain_pairs_and_its_gradients_are_slopes():
    rng = np.random.default_rng(5)
    machine = factorisation.Machine(8, (), 0.3, rng.normal(size=12), rng.normal(size=(12, 3)))
    vectors = [(rng.choice(12, k, replace=False).astype(np.int32), rng.normal(size=k).astype(np.float32)) for k in (1, 4, 7, 12)]
    want = [1 / (1 + math.exp(-_plain(machine, at, x))) for at, x in vectors]
    assert np.allclose(machine.score(vectors), want, atol=1e-6)
    at, x = np.concatenate([a for a, _ in vectors]), np.concatenate([v for _, v in vectors]).astype(float)
    starts, y, weight = np.cumsum([0, 1, 4, 7]), np.array([0.0, 1, 1, 0]), np.array([1.0, 2, 0.5, 1])

    def loss():
        p = factorisation.logistic(machine.raw(at, x, starts))
        return float((weight * -(y * np.log(p) + (1 - y) * np.log(1 - p))).mean())

    bias, weights, factors = factorisation.gradients(machine, at, x, starts, y, weight)
    for array, slopes, places in ((machine.weights, weights, range(12)), (machine.factors, factors, [(i, f) for i in range(12) for f in range(3)])):
        for k in places:
            kept = array[k]
            array[k] = kept + 1e-6
            up = loss()
            array[k] = kept - 1e-6
            down = loss()
            array[k] = kept
            assert abs((up - down) / 2e-6 - slopes[k]) < 1e-6
    machine.bias += 1e-6
    up = loss()
    machine.bias -= 2e-6
    assert abs((up - loss()) / 2e-6 - bias) < 1e-6


def test_vectors_are_of_whole_texts_and_slices_change_nothing(monkeypatch):
    text = "The end, the END!\n" * 50 + "Straße 12 | 日本 " * 40 + "tail"
    whole = factorisation.Vectors(1 << 10, ("n",)).of(text, [5])
    monkeypatch.setattr(factorisation, "SLICE", 7)
    sliced = factorisation.Vectors(1 << 10, ("n",)).of(text, [5])
    assert all(np.array_equal(a, b) for a, b in zip(whole, sliced))
    assert not np.array_equal(whole[1], factorisation.Vectors(1 << 10, ("n",)).of(text[:-4], [5])[1])
    words = {zlib.crc32(w.encode()) % (1 << 10) for w in ("the", "end", "straße", "12", "日本", "tail")}
    assert set(whole[0][whole[0] < 1 << 10].tolist()) == words


def test_quality_of_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = QUERIES["op11_factorisation_machine"](spark, "/root/testdata/sf0.01")
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows) and got.count() == docs.count()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_scores_depend_on_nothing_but_text_and_metadata(spark, odd):
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, 0), (7, 1), (7, 0), (None, 1), (9, None), (8, 7), (2, 1)], "doc_id long, quality int")
    machine = factorisation.learn(odd, labels, metadata=("n_chars",))
    rows = factorisation.score(odd, machine).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 5}) == 1
    moved = odd.withColumn("doc_id", F.col("doc_id") + 100)
    assert sorted(r.score for r in factorisation.score(moved, machine).collect()) == sorted(r.score for r in rows)
    plain = factorisation.learn(odd, labels)
    by_id = {r.doc_id: r.score for r in factorisation.score(odd, plain).collect()}
    assert by_id[1] == by_id[2]  # null and empty text
    assert {r.score for r in factorisation.score(odd, factorisation.learn(odd, labels.limit(0))).collect()} == {0.5}
    one = factorisation.learn(odd, labels.filter("quality = 1"))
    assert all(r.score > 0.5 for r in factorisation.score(odd, one).collect())
    assert factorisation.score(odd.limit(0), machine).count() == 0
    assert factorisation.learn(odd.limit(0), labels).bias == 0


def test_sample_is_bounded_and_of_both_labels(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 10 > 0).cast("int").alias("quality"))
    seen = {}
    keep = factorisation.fit
    try:
        factorisation.fit = lambda vectors, y, *rest: seen.update(n=len(vectors), bad=y.count(0)) or keep(vectors, y, *rest)
        factorisation.learn(docs, labels, factorisation.Training(max_rows=40, epochs=1))
    finally:
        factorisation.fit = keep
    assert seen == {"n": 40, "bad": 20}


# ---- whitening


def test_inertia_counts_and_leading_pairs():
    rng = np.random.default_rng(1)
    for t in range(120):
        d = int(rng.integers(1, 24))
        a = rng.normal(size=(d, d))
        q = np.linalg.qr(a)[0]
        m = (a @ a.T, q @ np.diag(np.repeat(rng.normal(size=d) ** 2, 2)[:d]) @ q.T, np.diag(np.round(rng.normal(size=d) * 2)), a[:, : max(d // 3, 1)] @ a[:, : max(d // 3, 1)].T)[t % 4]
        m = (m + m.T) / 2
        true = np.linalg.eigvalsh(m)[::-1]
        size = max(abs(true).max(), 1)
        shift = float(rng.choice(true)) + 1e-3
        assert whitening.inertia(m, shift) == (true > shift).sum()
        found = whitening.leading(m, 4)
        basis, e = np.stack([c.vector for c in found], axis=1), np.array([c.value for c in found])
        assert np.allclose(e, true[:4], atol=1e-12 * size)
        assert np.allclose(basis.T @ basis, np.eye(len(found)), atol=1e-9) and np.allclose(m @ basis, basis * e, atol=1e-10 * size)
        assert all(c.above_high < k <= c.above_low for k, c in enumerate(found, 1))


def test_products_are_exact():
    rng = np.random.default_rng(2)
    for far in (1 << 8, 1 << 19, 1 << 21, 1 << 40):
        y = rng.integers(-far, far, (5000, 3))
        assert (whitening._exact_products(y) == y.astype(object).T @ y.astype(object)).all()


def _whitened(vectors):
    """By numpy, of the usable vectors: n, S, eigenvalues and vectors, fit list."""
    x = np.floor(256 * np.array(vectors, float)).astype(np.int64)
    u = np.unique(x, axis=0)
    c = u - u.mean(axis=0)
    e, b = np.linalg.eigh(c.T @ c / len(u))
    return x, u, e[::-1], b[:, ::-1]


@pytest.mark.parametrize("parts", [1, 7])
def test_whitening_equals_numpy(spark, sf_dir, parts):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").repartition(parts)
    got = {(r.vec_id, r.component): r for r in whitening.whiten(table).collect()}
    rows = table.orderBy("vec_id").collect()
    x, u, e, b = _whitened([r.embedding for r in rows])
    n, s = len(u), u.sum(axis=0)
    assert len(got) == 4 * len(rows)
    for k in range(4):
        z = (x - s / n) @ b[:, k] / math.sqrt(e[k])
        mine = np.array([got[r.vec_id, k + 1].whitened for r in rows])
        assert min(np.abs(mine - z).max(), np.abs(mine + z).max()) < 1e-9
        assert abs(got[rows[0].vec_id, k + 1].explained - e[k] / e.sum()) < 1e-12
    for r, v in zip(rows, x):
        assert got[r.vec_id, 1].n == n and got[r.vec_id, 1].deviation == sum((n * int(a) - int(t)) ** 2 for a, t in zip(v, s))
    assert {g.identity_error for g in got.values()} == {got[rows[0].vec_id, 1].identity_error} and got[rows[0].vec_id, 1].identity_error < 1e-9


def test_whitening_of_odd_tables(spark):
    odd = [
        (1, [0.1, 0.2, 0.3]), (1, [0.1, 0.2, 0.3]), (2, None), (3, [None, 0.1, 0.2]), (4, [float("nan"), 0.0, 0.1]), (5, [float("inf"), 0.0, 0.1]), (6, []), (7, [0.5]),
        (None, [-0.2, 0.4, -0.0]), (8, [0.7, -0.3, 0.001]), (9, [1e30, 0.0, 0.0]), (10, [-0.001, 0.9, 0.2]), (11, [1e9, 0.0, 0.1]),
    ]
    df = spark.createDataFrame(odd, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("x", "n", "component", "i", "sums", "whitened")})
    usual = df.filter("vec_id is null or vec_id <> 11")
    rows = whitening.whiten(usual).collect()
    assert sorted({(r.vec_id is None, r.vec_id) for r in rows}, key=str) == sorted([(False, 1), (True, None), (False, 8), (False, 10)], key=str)
    assert len(rows) == 5 * 3 and {r.n for r in rows} == {4} and {r.component for r in rows} == {1, 2, 3}
    assert rows[0].identity_error < 1e-9 and abs(sum({r.component: r.explained for r in rows}.values()) - 1) < 1e-12
    far = whitening.whiten(df).filter("vec_id = 11").collect()  # (n x - S)^2 passes a long here
    assert [r.deviation for r in far] == [None] * 3 and all(r.explained is not None for r in far)
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.filter("vec_id = 6")).count() == 0
    alone = whitening.whiten(df.filter("vec_id = 1")).collect()
    assert len(alone) == 6 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None for r in alone)
    flat = whitening.whiten(spark.createDataFrame([(k, [float(k), 1.0]) for k in range(5)], "vec_id long, embedding array<float>")).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in flat) and {r.identity_error for r in flat} < {0.0, *[r.identity_error for r in flat if r.identity_error < 1e-9], 1.0}


# ---- spelling


def _near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(p != q for p, q in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def _groups(n):
    near = {w: [v for v in n if _near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    root = {}
    for w in n:
        at = w
        while form[at]:
            at = form[at]
        root[w] = at
    return sorted((w, form[w], root[w], n[w], len(near[w]), n.get(form[w])) for w in n)


@pytest.mark.parametrize("dense", [64, 2, 0])
def test_variants_equal_brute_force(spark, monkeypatch, dense):
    monkeypatch.setattr(spelling, "DENSE", dense)
    rng = random.Random(4)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(7, 9))) for _ in range(60)]
    words = {*base, "a" * 300, "a" * 301, "a" * 302, "a" * 299 + "b"}
    for _ in range(400):
        w = rng.choice(base)
        k, c = rng.randrange(len(w)), rng.choice("abcé")
        words.add((w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :])[rng.randrange(3)])
    n = {w: int(2 * 10 ** (rng.random() * 4)) for w in sorted(words) if len(w) >= 7}
    n["ab" * 4], n["ab" * 4 + "c"], n["ab" * 4 + "cd"] = 3, 40, 4000  # a chain of forms
    got = spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long"))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == _groups(n)


def test_words_that_share_a_half_are_split_further(spark):
    """A gram of 1,500 words: no key proposes over DENSE pairs a row, and no link is lost."""
    rng = random.Random(6)
    n = {"gemeinsam" + "".join(rng.choice("abcd") for _ in range(9)): rng.randint(2, 500) for _ in range(1500)}
    got = spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long"))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == _groups(n)


def test_word_counts_on_odd_rows(spark, odd, monkeypatch):
    def plain(rows):
        n = {}
        for i, t, *_ in rows:
            run = ""
            for c in (t or "") + " ":
                if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                    run += c.lower() if c.isascii() else c
                    continue
                if run:
                    h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                    run = run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]
                    if len(run) >= 7:
                        n[run] = n.get(run, 0) + 1
                run = ""
        return {w: k for w, k in n.items() if k >= 2}

    count = lambda df: {r.word: r.n for r in spelling.word_counts(df).collect()}
    assert count(odd) == plain(ODD)
    many = [(k, f"Straßenbahn ÀÉÎÕÜÿ×àéîõüÿaaa Wörterbuch{'' if k % 3 else 's'} {'langeswort' * 40}", k) for k in range(200)]
    assert count(spark.createDataFrame(many, odd.select("doc_id", "text", "n_chars").schema)) == plain(many)
    for size in (3, 50):
        monkeypatch.setattr(spelling, "SLICE", size)
        for i, t, _ in many[:20]:
            found = {}
            for w, k in spelling.words_of(t, i, 7, 31):
                found[w] = found.get(w, 0) + k
            monkeypatch.setattr(spelling, "SLICE", 1 << 20)
            assert found == dict(spelling.words_of(t, i, 7, 31))
            monkeypatch.setattr(spelling, "SLICE", size)
    monkeypatch.undo()
    assert spelling.variant_groups(odd).count() == len(plain(ODD))
    assert spelling.variant_groups(odd.limit(0)).count() == 0 and spelling.variant_groups(odd.filter("text is null")).count() == 0
