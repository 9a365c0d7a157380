import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import urlfilter as u

CASES = [
    ("https://www.example.com/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    ("https://m.example.com/en/1", "m.example.com", "/en/1", "example.com/en/", "block"),
    ("http://EXAMPLE.com/fr/", "example.com", "/fr/", "com/", "allow"),
    ("http://x.example.net/es/a", "x.example.net", "/es/a", "net/es/", "block"),
    ("http://net/fr/", "net", "/fr/", "net/fr/", "block"),
    ("http://a.net/en/", "a.net", "/en/", None, None),
    ("http://a.com", "a.com", "", None, None),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("a://b://c.com/", "b:", "//c.com/", None, None),
    ("x.com/", "", "", None, None),
    ("http://É.Net?es/", "É.net", "", None, None),
    (None, "", "", None, None),
    ("", "", "", None, None),
]


@pytest.mark.parametrize(("url", "host", "path", "rule", "verdict"), CASES)
def test_rules(spark, url, host, path, rule, verdict):
    r = spark.createDataFrame([(url,)], "url string").select(*[c.alias(n) for n, c in zip("hp", u.parts(F.col("url")), strict=True)]).select("h", "p", u.rule_of(F.col("h"), F.col("p")).alias("r")).first()
    assert (r.h, r.p, r.r and r.r.rule, r.r and r.r.verdict) == (host, path, rule, verdict)


def pages():
    rows, k = [], 0
    for n in range(60):
        for url in (f"https://www.good{n % 7}.com/{n}", f"http://spam{n % 5}.example.net/es/win-{n * 7}", f"http://spam{n % 3}.example.org/win-{n}", f"https://www.good{n % 4}.org/{n}"):
            rows.append((k, url))
            k += 1
    return rows


def brute(rows):
    """Scores of URLs that no rule decides, and the cut-off, by the plain recursion over contexts."""

    def rule(url):
        rest = url.split("://")[1]
        host = rest.split("/")[0]
        path = rest[len(host) :]
        fits = [(len(h + p), v) for v, h, p in u.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1] if fits else None

    def chars(url):
        return "\x02" * 4 + url.lower().split("://")[1] + "\x03"

    counts = {"allow": Counter(), "block": Counter()}
    alphabet = set()
    for k, url in rows:
        s = chars(url)
        alphabet |= set(s[4:])
        if rule(url) and k % 5:
            for i in range(4, len(s)):
                for o in range(5):
                    counts[rule(url)][s[i - o : i + 1]] += 1
    contexts = {v: defaultdict(int) for v in counts}
    for v, c in counts.items():
        for g, n in c.items():
            contexts[v][(len(g) - 1, g[:-1])] += n

    def p(v, g):
        if len(g) == 1:
            return (counts[v][g] + 1) / (contexts[v][(0, "")] + len(alphabet) + 1)
        return (counts[v][g] + u.PRIOR * p(v, g[1:])) / (contexts[v][(len(g) - 1, g[:-1])] + u.PRIOR)

    def score(url):
        s = chars(url)
        return sum(math.log(p("allow", s[i - 4 : i + 1])) - math.log(p("block", s[i - 4 : i + 1])) for i in range(4, len(s))) / (len(s) - 4)

    return {k: score(url) for k, url in rows if not rule(url)}


def test_against_plain_recursion(spark):
    rows = pages()
    got = {r.page_id: r for r in u.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    want = brute(rows)
    assert {k for k, r in got.items() if r.score is not None} == set(want)
    for k, x in want.items():
        assert got[k].score == pytest.approx(x, abs=1e-9)
    urls = dict(rows)
    assert all(got[k].verdict == ("block" if "spam" in urls[k] else "allow") for k in want)


def test_odd_rows(spark):
    rows = [(k, c[0]) for k, c in enumerate(CASES)] + [(None, "http://a.net/en/"), (3, "http://a.org/"), (3, "http://a.org/"), (99, "http://a.org/" + "long" * 20_000)]
    df = spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, gram string, k long")
    got = u.judge(df).collect()
    assert len(got) == len(rows) and all(r.verdict in ("allow", "block") for r in got)
    twice = [r for r in got if r.page_id == 3 and r.host == "a.org"]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert u.judge(df.limit(0)).count() == 0
    assert {r.verdict for r in u.judge(df.where("url = 'http://a.org/'")).collect()} == {"allow"}


def test_native(spark):
    plan = u.judge(spark.createDataFrame(pages(), "page_id long, url string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
