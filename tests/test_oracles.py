"""Every query with SQL against DuckDB on the driver's small tables."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest

from strandlake.catalog import COVERS, ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

needs_data = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def normal(v):
    if v is None or v != v:
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    found = QUERIES[name](spark, FOLDER)
    wanted = duck.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    cols = sorted(found.columns)
    a = sorted("|".join(normal(r[c]) for c in cols) for r in found.collect())
    at = [wanted.columns.index(c) for c in cols]
    b = sorted("|".join(normal(r[i]) for i in at) for r in wanted.fetchall())
    assert a == b


@needs_data
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_every_query_says_what_it_covers():
    assert all(COVERS[n] for n in QUERIES)


def test_frequent_words_are_found(spark, tmp_path):
    """A line of more than six sequences, and a run of one letter, against places counted one by one."""
    line = "acgtgcatcgatcgttagca"
    texts = {0: line + "ggg", 100: "t" * 30, 200: None, 300: ""} | {i: "c" * i + line for i in range(1, 12)} | {20: "t" * 40}
    spark.createDataFrame([(k, v, "en") for k, v in texts.items()], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    wanted = {}
    for q in (0, 100, 200, 300):
        for t in texts:
            for x in range(len(texts[q] or "") - 13):
                for y in range(len(texts[t] or "") - 13):
                    if q != t and texts[q][x : x + 14] == texts[t][y : y + 14]:
                        wanted[q, t, x - y] = wanted.get((q, t, x - y), 0) + 1
    found = QUERIES["seed_diag_hits"](spark, str(tmp_path)).collect()
    assert {(r.query_id, r.target_id, r.diag): r.hits for r in found} == wanted
    assert len({k[1] for k in wanted if k[0] == 0}) == 11
