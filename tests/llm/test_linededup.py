import hashlib
import random

import pytest

from tidemark.llm import linededup


def brute(docs):
    """The remaining text of each (id, text), by the definition."""
    windows = {}
    for i, t in set(docs):
        lines = [x.strip(" \t\n\x0b\x0c\r") for x in t.split("\n")]
        n = min(3, len(lines))
        for p in range(max(1, len(lines) - 2)):
            if "".join(lines[p : p + n]):
                windows.setdefault(tuple(lines[p : p + n]), []).append(((i, int(hashlib.md5(t.encode()).hexdigest()[:15], 16)), p))
    gone = {}
    for win, places in windows.items():
        first, n = min(places), len(win)
        for d, p in places:
            if (d, p) != first:
                gone.setdefault(d, set()).update(q for q in range(p, p + n) if not (d == first[0] and q < first[1] + n))
    keys = {d: (d[0], int(hashlib.md5(d[1].encode()).hexdigest()[:15], 16)) for d in docs}
    return sorted((d[0], "\n".join(x for k, x in enumerate(d[1].split("\n")) if k not in gone.get(keys[d], ()))) for d in docs)


@pytest.mark.parametrize("ids", [60, 9])
def test_against_brute_force(make_docs, ids):
    """With few ids, most repeat with other texts, some with the same."""
    rng = random.Random(5)
    docs = [(i % ids, "\n".join(rng.choice(["a", "b ", "c", "", " d"]) for _ in range(rng.randrange(9)))) for i in range(60)]
    got = sorted((r.doc_id, r.text) for r in linededup.dedup_lines(make_docs([(i, t, "s") for i, t in docs])).collect())
    assert got == brute(docs)


def test_a_row_keeps_lines_that_only_another_row_of_its_id_repeats(make_docs):
    out = linededup.dedup_lines(make_docs([(1, "a\nb\nc", "s"), (2, "a\nb\nc", "s"), (2, "u1\nu2\nu3", "s")])).collect()
    assert sorted((r.doc_id, r.text) for r in out) == [(1, "a\nb\nc"), (2, ""), (2, "u1\nu2\nu3")]


def test_short_documents_are_compared_whole(make_docs):
    """One or two lines are a window of their own, which no longer document holds."""
    rows = [(1, "one line", "s"), (2, " one line ", "s"), (3, "two\nlines", "s"), (4, "two\nlines", "s"), (5, "one line\ntwo\nlines", "s"), (6, "lines", "s")]
    assert {r.doc_id: r.text for r in linededup.dedup_lines(make_docs(rows)).collect()} == {1: "one line", 2: "", 3: "two\nlines", 4: "", 5: "one line\ntwo\nlines", 6: "lines"}


def test_sql_agrees_where_ids_repeat(spark, make_docs):
    import duckdb

    rng = random.Random(6)
    docs = make_docs([(rng.choice([None, *range(12)]), rng.choice([None, *["\n".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 9))) for _ in range(3)]]), "s") for _ in range(80)]).select("doc_id", "text")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = sorted(con.execute(f"SELECT doc_id, n_lines, n_removed, text FROM ({linededup.ORACLE})").fetchall(), key=str)
    assert sorted(map(tuple, linededup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text").collect()), key=str) == want


def test_counts_and_columns(make_docs):
    df = make_docs([(1, "x\ny\nz\nq", "s"), (2, "n\nx\ny\nz", "s"), (3, "x\ny\nz\nx\ny\nz", "s")])
    out = linededup.dedup_lines(df)
    assert out.columns == [*df.columns, "n_lines", "n_removed"]
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in out.collect()} == {1: ("x\ny\nz\nq", 4, 0), 2: ("n", 4, 3), 3: ("", 6, 6)}


def test_odd_rows(odd, empty):
    out = [(r.doc_id, r.text) for r in linededup.dedup_lines(odd).collect()]
    assert len(out) == odd.count()
    assert (1, None) in out and (2, "") in out
    assert (9, "\n".join(["same line here"] * 3)) in out
    assert linededup.dedup_lines(empty).count() == 0


def test_rows_of_one_id_are_treated_alike(make_docs):
    text = "a\nb\nc"
    out = linededup.dedup_lines(make_docs([(1, text, "s"), (1, text, "s"), (2, text, "s")])).collect()
    assert sorted((r.doc_id, r.text) for r in out) == [(1, text), (1, text), (2, "")]
