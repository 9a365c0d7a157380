from tidemark.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string"


def linked(spark, rows):
    return {(r.conv_id, r.turn): r for r in quotes.link_quotes(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_quotes_are_linked(spark):
    got = linked(
        spark,
        [
            (1, 0, "user", "How do I sort a list?\n\nIt is long."),
            (1, 1, "assistant", "Use sorted."),
            (1, 2, "user", "Ann wrote:\n> how do I  SORT a list?\nAs I said, this one."),
            (1, 3, "assistant", "> > How do I sort a list?\n> As I said, this one.\nTry list.sort."),
            (1, 4, "user", "> never said\nWhat?"),
            (2, 0, "user", "> Use sorted.\nfrom elsewhere"),
        ],
    )
    at = lambda c, t: (got[c, t].parent_turn, got[c, t].link, got[c, t].text, got[c, t].n_quoted, got[c, t].max_level)
    assert at(1, 0) == (None, None, "How do I sort a list?\n\nIt is long.", 0, 0)
    assert at(1, 1) == (0, "order", "Use sorted.", 0, 0)
    assert at(1, 2) == (0, "quote", "As I said, this one.", 1, 1)
    assert at(1, 3) == (2, "quote", "Try list.sort.", 2, 2)
    assert at(1, 4) == (3, "order", "What?", 1, 1)
    assert at(2, 0) == (None, None, "from elsewhere", 1, 1)
    assert [got[1, t].position for t in range(5)] == [1, 2, 3, 4, 5]


def test_latest_match_wins_and_levels_count(spark):
    got = linked(spark, [(1, 0, "u", "yes"), (1, 1, "a", "yes"), (1, 2, "u", "deep one"), (1, 3, "a", "> yes\nok"), (1, 4, "u", ">> deep one\n> unknown words\nfine")])
    assert got[1, 3].parent_turn == 1
    assert (got[1, 4].parent_turn, got[1, 4].link) == (2, "quote")


def test_long_conversations_are_numbered_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(quotes, "BUCKET", 7)
    rows = [(c, t * 3, "u", f"m{t}") for c in (1, 2) for t in range(50)]
    got = linked(spark, rows)
    for c in (1, 2):
        assert [got[c, t * 3].position for t in range(50)] == list(range(1, 51))
        assert [got[c, t * 3].parent_turn for t in range(50)] == [None, *[t * 3 for t in range(49)]]


def test_odd_rows(spark):
    rows = [(None, 0, "u", "a"), (None, 1, None, "> a\nb"), (1, None, "u", None), (1, 1, "u", ""), (1, 1, "u", ""), (1, 2, "u", "> \n>>"), (1, 3, "u", "x " * 100_000)]
    got = quotes.link_quotes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 7
    by = {(r.conv_id, r.turn, r.role): r for r in got}
    assert by[None, 1, None].parent_turn == 0 and by[None, 1, None].link == "quote" and by[None, 1, None].text == "b"
    assert by[1, None, "u"].text is None and by[1, None, "u"].position == 1
    assert by[1, 2, "u"].text == "" and by[1, 2, "u"].link == "order"
    assert quotes.link_quotes(spark.createDataFrame([], SCHEMA)).count() == 0
    extra = spark.createDataFrame([(1, 0, "u", "a", 5, "h")], SCHEMA + ", k long, position string")
    assert quotes.link_quotes(extra).count() == 1


def test_quotes_of_some_lines_are_linked(spark):
    three = "first line\nsecond line\nthird line"
    got = linked(
        spark,
        [
            (1, 0, "u", three + "\n\nmore words\n\nlast words"),
            (1, 1, "a", "third line\nother"),
            (1, 2, "u", "> second line\n> third  line\nyes"),
            (1, 3, "a", "> more words\n>\n> last words\nno"),
            (1, 4, "u", "> third line\n> never said\nwhat"),
            (2, 0, "u", three),
        ],
    )
    assert [(got[1, t].parent_turn, got[1, t].link, got[1, t].text) for t in (2, 3, 4)] == [(0, "quote", "yes"), (0, "quote", "no"), (3, "order", "what")]


def test_a_common_passage_makes_no_pairs(spark, monkeypatch):
    """One passage that every message of a conversation holds and quotes: each links to the one before, by one lookup a turn."""
    n = 20_000
    rows = spark.range(n).selectExpr("CAST(NULL AS LONG) AS conv_id", "id AS turn", "'u' AS role", "concat('> thanks\nthanks\n', id) AS text")
    out = quotes.link_quotes(rows)
    assert out.where("turn > 0 and (parent_turn <> turn - 1 or link <> 'quote')").isEmpty() and out.count() == n
    monkeypatch.setattr(quotes, "BUCKET", 5)
    few = spark.createDataFrame([(1, t, "u", "> thanks\nno" if t % 3 else "thanks") for t in range(0, 40)], SCHEMA)
    assert {r.turn: r.parent_turn for r in quotes.link_quotes(few).collect() if r.turn % 3} == {t: t // 3 * 3 for t in range(40) if t % 3}


def test_a_text_of_many_lines(spark):
    """100,000 lines, some of them quotes of an equally long text, cost in proportion to their number."""
    rows = spark.createDataFrame([(1, 0, "u", "\n".join(f"line {k}" for k in range(100_000))), (1, 1, "a", "\n".join(f"> line {k}\nyes" if k % 50 == 0 else f"own {k}" for k in range(100_000)))], SCHEMA)
    (r,) = quotes.link_quotes(rows).where("turn = 1").collect()
    assert (r.parent_turn, r.link, r.n_quoted, r.max_level) == (0, "quote", 2000, 1)


def test_sql_agrees_on_quotes(spark):
    """Replies that quote whole messages, lines, runs of lines and nothing, in conversations with and without an id."""
    import random

    import duckdb

    from tidemark.llm.oracles import QUOTES

    rng, rows = random.Random(4), []
    for turn in range(120):
        conv, lines = rng.choice([None, 1, 2]), [rng.choice(["a b", "c", "", "d  e", "F"]) for _ in range(rng.randrange(5))]
        source = rng.choice(rows)[3].split("\n") if rows else []
        a = rng.randrange(len(source) + 1)
        rows.append((conv, turn, rng.choice("ua"), "\n".join([">" * rng.randrange(1, 3) + " " + x for x in source[a : a + rng.randrange(4)]] + lines)))
    con = duckdb.connect()
    con.register("conversations", spark.createDataFrame(rows, SCHEMA).toArrow())
    names = ["conv_id", "position", "turn", "role", "text", "parent_turn", "link", "n_quoted", "max_level"]
    want = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({QUOTES})").fetchall(), key=str)
    got = sorted(map(tuple, quotes.link_quotes(spark.createDataFrame(rows, SCHEMA)).select(*names).collect()), key=str)
    assert got == want and sum(r[6] == "quote" for r in got) > 40
