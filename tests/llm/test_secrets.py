import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import secrets as s

PATTERNS = {
    "assign": re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}
LEAST = {"assign": (2, 6), "access": (0, 20), "hex": (0, 24)}


def base(text):
    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in p.finditer(text) if len(m[LEAST[kind][0]]) >= LEAST[kind][1])


def shown(found, kinds=tuple(PATTERNS)):
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in found)


TEXTS = [
    "", "nothing", "password=hunter22 and TOKEN: 'abcdef'", "token=short secret = x", "token=token: abcdefgh", "é😀 api_key=\"0123456789abcdef0123456789\" end", "AKIA" + "A" * 16 + " xAKIA" + "B" * 30 + " AKIAshort",
    "deadbeef" * 3 + " " + "deadbeef" * 2 + "a" * 7, "apikey:AAAAAA=secret=bbbbbb", "ſecret=abcdefg toKen=abcdefg", "password==abcdef", "tokentoken=1234567\npasswd : 'qwertyu'", "a" * 24 + "token=" + "f" * 30,
]
TEXTS += ["x " * 40_000 + "secret=abcdef"]


def digests(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r for r in s.digest(s.Ledger(spark).scan(df)).collect()}


def test_base_spans(spark):
    got = digests(spark, list(enumerate(TEXTS)))
    for k, text in enumerate(TEXTS):
        want = base(text)
        r = got[k]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == n for x in want) for n in range(3)), text[-60:]
        assert r.base_sha256 == hashlib.sha256(shown(want).encode()).hexdigest()
        assert r.spans == shown(want)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["token", "TOKEN", "=", ": ", "'", '"', "abc", "AKIA", "ABCDEFGH", "0a1b2c3d", "😀", "\n", "secret", " "]), max_size=25).map("".join), min_size=30, max_size=60))
def test_random_texts(spark, texts):
    got = digests(spark, list(enumerate(texts)))
    for k, text in enumerate(texts):
        assert got[k].spans == shown(base(text)), repr(text)


def test_added_kinds_keep_the_base(spark):
    text = "gho_" + "a1" * 18 + " -----BEGIN RSA PRIVATE KEY----- token=eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSM"
    r = digests(spark, [(1, text)])[1]
    assert r.base_sha256 == hashlib.sha256(shown(base(text)).encode()).hexdigest()
    assert [x.split(":")[0] for x in r.spans.split(",")] == ["github", "hex", "pem", "assign", "jwt"] or "github" in r.spans and "pem" in r.spans and "jwt" in r.spans


def test_ledger_scans_only_unseen_pairs(spark, tmp_path):
    ledger = s.Ledger(spark, str(tmp_path / "ledger"))
    one = spark.createDataFrame([(1, "token=abcdef"), (2, "token=abcdef"), (3, None)], "doc_id long, text string")
    first = s.digest(ledger.scan(one, s.BASE)).collect()
    assert ledger.rows().count() == 2 * 3  # two blobs, three rules
    again = s.digest(ledger.scan(one, s.BASE)).collect()
    assert ledger.rows().count() == 6 and sorted(first) == sorted(again)
    two = one.unionAll(spark.createDataFrame([(4, "new")], one.schema))
    ledger.scan(two, s.BASE).count()
    assert ledger.rows().count() == 9
    newer = (*s.BASE[:2], s.Rule("hex", "[0-9a-f]{6,}", version=2))
    found = {r.doc_id: r.spans for r in s.digest(ledger.scan(two, newer)).collect()}
    assert ledger.rows().count() == 9 + 3
    assert found[1] == found[2] == "assign:0:12,hex:6:12" and found[3] == found[4] == ""


def test_odd_rows(spark, odd, empty):
    got = s.digest(s.Ledger(spark).scan(odd)).collect()
    assert len(got) == odd.count() and {r.spans for r in got} == {""}
    assert s.digest(s.Ledger(spark).scan(empty)).count() == 0


def test_native(spark):
    df = spark.createDataFrame([(1, "token=abcdef")], "doc_id long, text string").select(s.spans(F.col("text"), s.BASE[0]))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
