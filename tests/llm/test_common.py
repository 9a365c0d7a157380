import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm.common import Words, dropped, fresh, n_tokens, rolling, scratch_dir, slices, stored

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@given(st.lists(st.none() | st.text(" \t\n\x0b\x0c\r\x1c\x85\xa0aBé", max_size=12), max_size=6))
def test_words_are_those_of_the_contract(texts):
    w = Words(pa.array(texts, pa.string()))
    want = [[x.lower().decode() for x in WORD.findall((t or "").encode())] for t in texts]
    got = [[w.vocab[int(c)].as_py() for c in w.codes[a:b]] for a, b in zip(w.starts, w.starts[1:], strict=False)]
    assert got == want


def test_token_count(spark):
    texts = [None, "", " ", "a", " a\tb\x0bc\x0c ", "x\x1cy z\xa0q"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").select("k", n_tokens(F.col("text")).alias("n"))
    assert [r.n for r in df.orderBy("k").collect()] == [0, 0, 0, 1, 3, 2]


def test_slices_keep_rows_in_order():
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["x" * 10, None, "y" * 100, "z", ""])], names=["id", "text"])
    parts = list(slices(iter([batch]), most=32))
    assert sum((p.column(0).to_pylist() for p in parts), []) == list(range(5)) and len(parts) > 1


def test_rolling_depends_on_order():
    a = np.array([1, 2, 3, 1, 2], np.uint64)
    got = rolling(a, 2)
    assert got[0] == got[3] and len(set(got.tolist())) == 3
    assert len(rolling(a[:1], 2)) == 0


def test_fresh():
    assert fresh(["a", "B"], "c", "b") == ["c_", "b_"]


def test_stored_tables_leave_no_shuffle_files_and_can_be_dropped(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    table = stored(spark.range(100).repartition(4, "id"))
    assert table.count() == 100 and spark.conf.get(name) == before
    dropped(table)
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        spark.read.parquet(*table.inputFiles()).count()


@pytest.mark.parametrize(("master", "fails"), [("local[4]", False), ("local", False), ("local-cluster[2,1,1024]", True), ("yarn", True), ("spark://host:7077", True)])
def test_a_cluster_must_name_its_shared_folder(master, fails):
    class Conf(dict):
        set = dict.__setitem__

    context = type("Context", (), {"master": master, "applicationId": "app", "getConf": lambda self: Conf()})()
    session = type("Session", (), {"conf": Conf(), "sparkContext": context})()
    if fails:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch_dir(session)
    else:
        assert scratch_dir(session).endswith("/tidemark-app") and session.conf["spark.checkpoint.dir"]
