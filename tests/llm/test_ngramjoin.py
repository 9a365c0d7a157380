import random

import numpy as np
import pytest

from tidemark.llm import ngramjoin


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(docs, n, num, den):
    sets = [(i, shingles(t, n)) for i, t in docs]
    up = {i: i for i, _ in docs if i is not None}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and len(a & b) * den >= len(a | b) * num:
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {(i, len(s), root(i) if i is not None else None) for i, s in sets}


def mutated(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"m{rng.randrange(10**9)}"
    return " ".join(words)


@pytest.mark.parametrize(("n", "num"), [(4, 85), (5, 80), (1, 60)])
def test_against_brute_force(make_docs, n, num):
    rng = random.Random(n)
    docs = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 14)))) for i in range(120)]
    base = [f"v{rng.randrange(5000)}" for _ in range(150)]
    docs += [(200 + k, mutated(rng, base, rng.randrange(6))) for k in range(60)]
    chain, words = [], list(base)
    for k in range(12):  # each close to the next only
        words = mutated(rng, words, 2).split()
        chain.append((400 + k, " ".join(words)))
    docs += chain + [(500 + k, t) for k, (_, t) in enumerate(docs[:40])]
    rng.shuffle(docs)
    got = ngramjoin.near_duplicates(make_docs([(i, t, "s") for i, t in docs]), n, num, 100)
    assert {tuple(r) for r in got.collect()} == brute(docs, n, num, 100)


def test_odd_rows(odd, empty):
    got = sorted(map(tuple, ngramjoin.near_duplicates(odd, 4, 85, 100).collect()), key=str)
    ids = {r[0]: r[2] for r in got}
    assert len(got) == odd.count() and ids[5] == 4 and ids[None] is None and ids[1] == 1 and ids[2] == 2
    assert ngramjoin.near_duplicates(empty).count() == 0
    assert ngramjoin.near_duplicates(odd.where("text is null")).collect()[0].n_shingles == 0


def test_one_of_each(odd, empty):
    out = ngramjoin.one_of_each(odd)
    assert out.columns == odd.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted([1, 2, 3, None, 4, 6, 7, 8, 9], key=str)
    assert ngramjoin.one_of_each(empty).count() == 0


def test_one_id_with_other_texts_joins_their_groups(make_docs):
    """Each row of a doc_id may be alike to another group; also where the smallest ids aren't the bridge's."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    got = ngramjoin.near_duplicates(make_docs([(3, a, "s"), (5, a, "s"), (5, b, "s"), (9, b, "s"), (4, b, "s"), (8, c, "s")]), 4, 85, 100)
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(3, 3), (4, 3), (5, 3), (5, 3), (8, 8), (9, 3)]


def test_bitmaps_hold_their_values(spark, monkeypatch):
    values = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 3000)
    frame = spark.createDataFrame([(int(v),) for v in values], "v long")
    others = np.arange(20_000)
    bitmap = ngramjoin._bitmap(frame, len(values))
    assert ngramjoin._held(bitmap, values).all() and ngramjoin._held(bitmap, others).mean() < 0.01
    monkeypatch.setattr(ngramjoin, "FEWEST_BITS", 8)
    monkeypatch.setattr(ngramjoin, "MOST_BITS", 8)
    assert ngramjoin._held(ngramjoin._bitmap(frame, len(values)), values).all()


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, 200), (200, 300)]
    got = {r.id: r.new for r in ngramjoin.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 100: 100, 200: 100, 300: 100}
    assert ngramjoin.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_are_counted(make_docs, odd, monkeypatch):
    """All links within a component count, copies by their number, however small the tiles are."""
    rng = random.Random(9)
    base = [f"v{k}" for k in range(120)]
    docs = [(k, mutated(rng, base, rng.randrange(5))) for k in range(50)]
    docs += [(100 + k, docs[k % 7][1]) for k in range(20)] + [(200 + k, mutated(rng, [f"u{k % 4}x{j}" for j in range(60)], k // 4)) for k in range(12)] + [(300, "alone"), (301, "")]
    sets = {i: shingles(t, 4) for i, t in docs}
    want = {i: sum(j != i and bool(a) and len(a & b) * 100 >= len(a | b) * 85 for j, b in sets.items()) for i, a in sets.items()}
    rows = make_docs([(i, t, "s") for i, t in docs])
    got = ngramjoin.near_duplicates(rows, 4, 85, 100, links=True)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    assert {r.doc_id: r.n_links for r in got.collect()} == want and max(want.values()) > 20
    monkeypatch.setattr(ngramjoin, "TILE_SETS", 6)
    monkeypatch.setattr(ngramjoin, "STRIP", 50)
    assert {r.doc_id: r.n_links for r in ngramjoin.near_duplicates(rows, 4, 85, 100, links=True).collect()} == want
    assert {(r.doc_id, r.n_links) for r in ngramjoin.near_duplicates(odd, 4, 85, 100, links=True).collect() if r.doc_id in (None, 1, 4, 5, 6)} == {(None, None), (1, 0), (4, 1), (5, 1), (6, 0)}
