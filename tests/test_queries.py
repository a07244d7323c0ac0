"""Every query of the library against its SQL twin on the smallest tables."""

import glob
import math
import os
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from spoolframe.operators import kernels
from spoolframe.plans.catalog import ORACLES, QUERIES


def plain(v):
    if isinstance(v, (list, np.ndarray, tuple)):
        return str([plain(x) for x in v])
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.number)):
        return repr(round(float(v), 6))
    return str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(plain, r)) for r in frame[columns].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, data, name):
    assert rows(QUERIES[name](spark, data).toPandas()) == rows(duck.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_similarity_takes_whole_texts(spark, tmp_path):
    """Texts beyond 1024 bytes, of odd lengths, empty and null, against the same scores worked out here."""
    long = "".join(chr(97 + i * i % 23) for i in range(5003))
    texts = {1: long, 2: long[:1024] + "~" * 3979, 3: "short", 4: "", 5: None, 6: "é語" * 700}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.overall, r.worst, r.detail) for r in QUERIES["similarity_scores"](spark, str(tmp_path)).collect()}
    assert set(got) == set(texts) and got[5] == (None, None, None)
    for i, text in texts.items():
        if text is None:
            continue
        data = text.encode()
        h = max(1, -(-len(data) // 64))
        a = data.ljust(64 * h, b"\x7f")
        overall, worst = kernels.compare(a, bytes(64) + a[64:], 16, h)
        colours = Counter(tuple(x >> 4 for x in a[j : j + 4]) for j in range(0, len(a), 4))
        want = (overall, worst, 1 - max(colours.values()) / (16 * h))
        assert np.allclose(got[i], want, atol=6e-4)
    assert got[1] != got[2]


def test_entry_is_there(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
