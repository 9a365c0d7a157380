import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import toxicity as t
from tidemark.llm.common import Words


def test_gradients():
    rng = np.random.default_rng(0)
    net = t.Network(pa.array(["a", "b"]), rng)
    net.p = {k: v.astype(np.float64) * 3 for k, v in net.p.items()}
    x = rng.normal(size=(6, t.DIM))
    x[-1] = 0
    codes, labels = rng.integers(0, 6, (4, 7)), np.array([1.0, 0, 1, 0])
    codes[0, 4:] = 5

    def loss():
        none, states = 5, np.empty((4, 7, 2 * t.HIDDEN))
        for k, side in enumerate("fb"):
            net._side(side, x @ net.p[f"W{side}"] + net.p[f"b{side}"], codes, none, states[:, :, k * t.HIDDEN : (k + 1) * t.HIDDEN])
        p = 1 / (1 + np.exp(-(net._pool(states, codes != none)[1] @ net.p["w"] + net.p["c"])))
        return -(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean()

    g, dx = net.gradients(x, codes, labels, np.ones(4))
    for values, grad in [(net.p[k], g[k]) for k in ("w", "v", "c", "Uf", "Wb", "bf", "Ub")] + [(x, dx)]:
        at = tuple(np.array(values.shape) // 2)
        old, e = values[at], 1e-4
        values[at] = old + e
        up = loss()
        values[at] = old - e
        down = loss()
        values[at] = old
        assert grad[at] == pytest.approx((up - down) / (2 * e), rel=1e-3, abs=1e-6)


def test_windows_cover_every_word():
    texts = ["", "a", " ".join(map(str, range(t.WINDOW))), " ".join(map(str, range(t.WINDOW + 1))), " ".join(map(str, range(100)))]
    words = Words(pa.array(texts))
    codes, text = t.windows(words)
    assert set(text) == set(range(5))
    for k in range(5):
        seen = set(codes[text == k].ravel()) - {len(words.vocab)}
        assert seen == set(words.codes[words.starts[k] : words.starts[k + 1]])
    assert list(np.bincount(text)) == [1, 1, 1, 2, 6]


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "te") for b in ("na", "so", "vi", "po", "du", "xi")]
    texts, labels = [], []
    for _ in range(n):
        w = list(rng.choice(words, rng.integers(5, 150)))
        toxic = rng.random() < 0.25
        if toxic:
            w.insert(rng.integers(0, len(w)), rng.choice(["scumbag", "vermin", "Idiot!!"]))
        texts.append(" ".join(w))
        labels.append(float(toxic))
    return texts, np.array(labels)


def test_held_out_accuracy():
    net = t.fit(*corpus(900, 1))
    texts, labels = corpus(300, 2)
    texts[0], labels[0] = "kana loso " * 40 + "scumbags###", 1.0  # an unseen spelling, deep in a long text
    p = net.probability(t.top_logits(net, Words(pa.array(texts))))
    assert ((p >= t.THRESHOLD) == (labels == 1)).mean() > 0.97
    assert p[0] > np.quantile(p[labels == 0], 0.95)


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, None), (None, 1), (77, 1), (7, 0)], "doc_id long, toxic int")
    for held in (F.lit(False), F.lit(True)):
        got = t.score_toxicity(odd, labels, held).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
        assert all(r.predicted == int(r.score >= t.THRESHOLD) for r in got)
    assert {r.score for r in got} == {0.0}
    only = spark.createDataFrame([(4, 1)], "doc_id long, toxic int")
    assert {r.score for r in t.score_toxicity(odd, only, F.lit(False)).collect()} == {1.0}
    assert t.score_toxicity(empty, labels, F.lit(False)).count() == 0
    kept = t.without_toxic(odd, labels.limit(0), F.lit(False))
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert t.without_toxic(odd, only, F.lit(False)).count() == 0


def test_real_labels(spark):
    data = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    rows = t.score_toxicity(docs, labels, held).where("held_out").join(labels, "doc_id").collect()
    toxic, clean = ([r.score for r in rows if r.toxic == k] for k in (1, 0))
    assert np.mean([a > b for a in toxic for b in clean]) > 0.75


def test_the_driver_does_not_train(spark, monkeypatch):
    """Neither the sample nor what training needs comes to the driver."""
    docs = spark.createDataFrame([(k, f"w{k % 5} " * 9 + "bad" * (k % 3 == 0)) for k in range(60)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    rows = docs.select("text", "doc_id").join(labels, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").collect()
    want = t.fit([r.text for r in rows], np.array([float(r.toxic) for r in rows]))
    monkeypatch.setattr(t, "_fit", None)
    got = t.train(docs, labels)
    assert got.vocab.equals(want.vocab) and all(np.allclose(got.p[k], want.p[k], atol=1e-5) for k in want.p)
