import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import mixing


def entropy(w):
    w = np.asarray(w) / np.sum(w)
    return -(w * np.log(w)).sum() / math.log(len(w))


def brute(tokens, ratio, target, most):
    shares = np.array(tokens) / sum(tokens)
    best = None
    for a in np.linspace(0, 1, 20_001)[::-1]:
        w = shares**a / (shares**a).sum()
        if target is None or entropy(w) >= target:
            best = a
            break
    best = 0.0 if best is None else best
    while most is not None and best < 1 and max(shares**best / (shares**best).sum() * ratio / shares) > most:
        best += 5e-5
    return min(best, 1.0)


@pytest.mark.parametrize(("target", "most"), [(0.9, None), (0.99, 3.0), (None, 2.0), (0.2, None), (1.1, None), (0.95, 1.0)])
def test_exponent(spark, target, most):
    tokens = [1000, 300, 100, 30, 5]
    shares = spark.createDataFrame([(t / sum(tokens),) for t in tokens], "share double")
    assert mixing.exponent(shares, 1.0, target, most) == pytest.approx(brute(tokens, 1.0, target, most), abs=2e-4)


@pytest.fixture(scope="module")
def docs(make_docs):
    rng = np.random.default_rng(1)
    rows = []
    for source, n in (("big", 1200), ("mid", 300), ("small", 40)):
        rows += [(len(rows) + k, "w " * int(rng.integers(1, 60)), source) for k in range(n)]
    return make_docs(rows)


def test_budgets_are_met(docs, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_TOKENS", 2000)
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 5000)
    plan = {r.source: r for r in mixing.weights(docs, None, 0.8, 4.0).collect()}
    out = mixing.mix_sources(docs, None, 0.8, 4.0)
    assert out.columns[: len(docs.columns)] == docs.columns
    rows = out.select("doc_id", "source", "n_tokens", "epoch", "block").collect()
    tokens, seen, blocks = Counter(), defaultdict(Counter), defaultdict(Counter)
    for r in rows:
        tokens[r.source] += r.n_tokens
        seen[r.source][r.doc_id] += 1
        blocks[r.source][r.block] += r.n_tokens
    for source, p in plan.items():
        assert tokens[source] == pytest.approx(p.passes * p.tokens, abs=30 * p.shards + 1)
        assert max(seen[source].values()) - min(seen[source].values()) <= 1 or p.passes < 1
        assert max(seen[source].values()) <= math.ceil(p.passes)
        each = tokens[source] / p.blocks
        assert all(abs(n - each) < 60 * p.shards + 60 for n in blocks[source].values())
    assert sum(p.weight for p in plan.values()) == pytest.approx(1)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_sources(docs, None, 0.8, 4.0).select("doc_id", "source", "n_tokens", "epoch", "block").collect()))


def test_odd_rows(odd, empty):
    out = mixing.mix_sources(odd, max_repeats=3.0).collect()
    assert {r.source for r in out} <= {"a", "b", "c", None}
    assert {r.n_tokens for r in out if r.text is None} <= {0}
    assert mixing.mix_sources(empty).count() == 0
    assert mixing.mix_sources(odd.where("text is null")).count() == 0


@pytest.mark.parametrize("n", [3, 400])
def test_sql_agrees_with_shards_blocks_and_odd_rows(spark, make_docs, odd, n, monkeypatch):
    """Null and repeated ids, null sources and texts, several shards and epochs."""
    import duckdb

    from tidemark.llm import oracles

    rng = np.random.default_rng(n)
    rows = [(None if k % 11 == 0 else k % 300, None if k % 13 == 0 else "w " * int(rng.integers(0, 50)), rng.choice(["big"] * 8 + ["small"]) if k % 7 else None) for k in range(n)]
    docs = make_docs([(i, t, None if s is None else str(s)) for i, t, s in rows]).unionByName(odd).select("doc_id", "source", "text")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    sql = oracles.mixing()
    if n > 100:
        monkeypatch.setattr(mixing, "SHARD_TOKENS", 1000)
        monkeypatch.setattr(mixing, "SHARD_ROWS", 64)
        monkeypatch.setattr(mixing, "BLOCK_TOKENS", 5000)
        sql = sql.replace(str(1 << 18), "1000").replace(str(1 << 16), "64").replace(str(1 << 20), "5000")
    names = ["doc_id", "source", "n_tokens", "epoch", "block", "order_key"]
    want = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall(), key=str)
    got = sorted(map(tuple, mixing.mix_sources(docs).select(*names).collect()), key=str)
    assert got == want and len(got) > n / 2
