import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontam as d
from tidemark.llm.common import Words

ITEMS = [(1, "What is the tallest mountain of the far northern islands? It is called Grey Tooth by those who live there."), (2, "alpha beta gamma delta epsilon zeta eta theta\niota kappa lambda mu nu"), (3, "one two"), (4, ""), (5, None), (6, "... !!")]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def plain_words(text):
    return [w for w in (x.strip(d.EDGES) for x in text.lower().split()) if w]


def plain_leaks(texts, items):
    """Passages, items and best score of each text, by the definitions alone: every item against every window."""
    split = {}
    for i, t in items:
        body = (t or "").rstrip()
        lines = body.rsplit("\n", 1)
        sentences = [m.end() for m in re.finditer(r"[.?!]\s+", body)]
        cut = len(lines[0]) + 1 if len(lines) > 1 else sentences[-1] if sentences else len(body)
        split[i] = plain_words((t or "")[:cut]), plain_words((t or "")[cut:])
    bags = {i: Counter(q + a) for i, (q, a) in split.items() if q + a}
    df = Counter(w for bag in bags.values() for w in bag)
    mean = sum(sum(b.values()) for b in bags.values()) / max(1, len(bags))
    stride = max([8, *(sum(b.values()) for b in bags.values())])

    def weights(bag):
        size = sum(bag.values())
        return {w: math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * size / mean)) for w, n in bag.items()}

    def runs(words, n=3):
        n = min(n, len(words))
        return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()

    def share(part, window):
        wanted = runs(part)
        return sum(g in runs(window, len(g)) for g in wanted) / len(wanted) if wanted else 1.0

    out = []
    for text in texts:
        words = plain_words(text or "")
        hits = {}
        for a in range(0, len(words), stride):
            window = words[a : a + 2 * stride]
            for i, bag in bags.items():
                w = weights(bag)
                score = sum(x for t, x in w.items() if t in set(window)) / sum(w.values())
                q, ans = split[i]
                if score >= 0.5 and (share(q + ans, window) >= 0.6 or share(q, window) >= 0.5 and share(ans, window) >= 0.5):
                    hits[i] = max(score, hits.get(i, 0))
        out.append((-(-len(words) // stride), sorted(hits), round(max(hits.values(), default=0.0), 9)))
    return out


@pytest.mark.parametrize(("seed", "n_items", "n_words", "size"), [(2, 30, 60, 25), (3, 90, 2000, 40), (4, 7, 12, 9), (5, 1, 5, 4)])
def test_search_equals_scoring_everything(seed, n_items, n_words, size, monkeypatch):
    """BM25, threshold and overlaps by plain Python for every item and window; some items repeat, some texts hold parts of items."""
    monkeypatch.setattr(d, "TABLE", seed % 2 << 26)
    rng = random.Random(seed)
    vocab = [f"v{k}" for k in range(n_words)]
    some = lambda n: " ".join(rng.choice(vocab[: rng.choice([6, n_words])]) for _ in range(n))
    items = [(k, some(rng.randrange(1, size)) + rng.choice([". ", "\n", " "]) + some(rng.randrange(size // 2))) for k in range(n_items)]
    items += [(n_items, items[0][1]), (n_items + 1, ""), (n_items + 2, "... !")]
    texts = ["", "!!", items[0][1]]
    for _ in range(60):
        words = rng.choice(items)[1].split()
        part = " ".join(words[: rng.randrange(len(words) + 1)] if rng.random() < 0.5 else words)
        texts.append(f"{some(rng.randrange(90))} {part} {some(rng.randrange(60))}")
    index = d.Index([i for i, _ in items], [t for _, t in items])
    words = Words(pa.array(texts))
    codes, forms = d._edgeless(words)
    to = {w: k for k, w in enumerate(index.terms.to_pylist())}
    kept = np.array([bool(forms[int(c)].as_py()) for c in codes])
    starts = np.concatenate([[0], np.cumsum(kept)])[words.starts]
    codes = np.array([to.get(forms[int(c)].as_py(), len(to)) for c in codes[kept]])
    hits = [{} for _ in texts]
    for t, i, score in index.search(codes, starts):
        hits[t][i] = max(score, hits[t].get(i, 0.0))
    got = [(-(-int(n) // index.stride), sorted(int(index.ids[i]) for i in h), round(max(h.values(), default=0.0), 9)) for n, h in zip(np.diff(starts), hits, strict=True)]
    want = plain_leaks(texts, items)
    assert got == want and sum(bool(w[1]) for w in want) > 20


def test_only_postings_from_the_pivot_on_are_kept():
    """No block's early terms reach the threshold, and each block has all its terms once."""
    rng = random.Random(7)
    texts = [" ".join(f"v{min(rng.randrange(300), rng.randrange(300))}" for _ in range(20)) for _ in range(60)]
    index = d.Index(list(range(60)), texts)
    assert (index.rest < d.THRESHOLD).all() and len(index.early_term) > 0
    blocks = {(int(i) // d.BLOCK, int(t)) for i in range(60) for t in index.item_term[index.item_at[i] : index.item_at[i + 1]]}
    assert len(blocks) == len(index.early_term) + len(index.list_block)


def test_leaks_are_found_and_clean_texts_left(make_docs, items):
    rng = random.Random(1)
    fill = lambda n: " ".join(f"f{rng.randrange(500)}" for _ in range(n))
    docs = [
        (1, f"{fill(200)} {ITEMS[0][1]} {fill(100)}", "s"),
        (2, f"{fill(30)}\n{ITEMS[1][1].upper().replace(' ', '!! ')} {fill(9)}", "s"),
        (3, " ".join(sorted(ITEMS[0][1].split())), "s"),  # its words in another order
        (4, ITEMS[0][1].split("?")[0], "s"),  # the question alone, half of the item
        (5, fill(400), "s"),
        (6, f"{fill(70)} one two {fill(5)} {ITEMS[1][1]} {fill(3)} {ITEMS[0][1]}", "s"),
    ]
    got = {r.doc_id: r for r in d.find_leaks(make_docs(docs), items).collect()}
    assert {i: r["items"] for i, r in got.items()} == {1: [1], 2: [2], 3: [], 4: [], 5: [], 6: [1, 2, 3]}
    assert got[1].best_score == pytest.approx(1, abs=1e-5)
    kept = d.without_leaks(make_docs(docs), items)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5] and kept.columns == make_docs(docs).columns


def test_chunks_of_items_find_the_same(make_docs, items, monkeypatch):
    docs = make_docs([(1, ITEMS[0][1] + " " + ITEMS[1][1], "s"), (2, "none", "s")])
    whole = sorted((r.doc_id, r["items"]) for r in d.find_leaks(docs, items).collect())
    monkeypatch.setattr(d, "CHUNK_BYTES", 60)
    assert len(d.indexes(items)) > 1
    assert sorted((r.doc_id, r["items"]) for r in d.find_leaks(docs, items).collect()) == whole
    assert d.without_leaks(docs, items).count() == 1


def test_odd_rows(odd, empty, items):
    got = d.find_leaks(odd, items).collect()
    assert len(got) == odd.count() and all(r["items"] in ([], [3]) for r in got)
    assert {r.n_passages for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert d.find_leaks(empty, items).count() == 0
    assert d.without_leaks(odd, items.limit(0)).count() == odd.count()
    assert d.find_leaks(odd, items.where(F.col("text").isNull())).count() == odd.count()


def test_answers():
    assert [t[d._answer(t) :] for t in ("Q one. Q two? The answer.", "q\na b\n", "no end", "")] == ["The answer.", "a b\n", "", ""]


def test_results_do_not_depend_on_chunks(spark, make_docs, monkeypatch):
    """Rows that repeat an id or have none are judged each for itself, with the scores of one index."""
    rng = random.Random(8)
    vocab = [f"v{k}" for k in range(40)]
    texts = [" ".join(rng.choice(vocab[: 10 + k]) for _ in range(rng.randrange(3, 30))) for k in range(24)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    fill = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    docs = make_docs([(rng.choice([None, 1, 2, 3 + k]), f"{fill(rng.randrange(40))} {texts[k % 24]} {fill(9)}" if k % 3 else fill(30), "s") for k in range(60)])
    run = lambda: sorted(((r.doc_id, r.n_passages, r["items"], round(r.best_score, 5)) for r in d.find_leaks(docs, items).collect()), key=str)
    whole, kept = run(), d.without_leaks(docs, items).count()
    monkeypatch.setattr(d, "CHUNK_BYTES", 500)
    assert len(d.indexes(items)) > 2 and len(whole) == 60 and any(r[2] for r in whole)
    assert run() == whole and d.without_leaks(docs, items).count() == kept
