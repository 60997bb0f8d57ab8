"""Every registered query against its SQL on the small tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_module
from pulsegrid.plans.extended import QUERIES as further
from pulsegrid.plans.queries import QUERIES as first

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
plans = {*first, *further}
QUERIES = {name: query for name, query in entry_module.queries().items() if name in plans}
ORACLE = {name: sql for name, sql in entry_module.oracle_sql().items() if name in plans}
ROWS_ONLY = {"constant_q_frames", "transcription", "transcription_notes", "transcription_onsets"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def canonical(rows):
    def text(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v + 0.0:.12g}"
        return str(v)

    return sorted(tuple(text(v) for v in r) for r in rows)


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLE) == ROWS_ONLY and set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    relation = duck.sql(ORACLE[name])
    assert columns == sorted(relation.columns)
    expected = duck.sql(f"select {', '.join(columns)} from ({ORACLE[name]})").fetchall()
    assert canonical(map(tuple, df.select(*columns).collect())) == canonical(expected)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_queries_reach_their_branches(spark):
    """Each outcome of the rules occurs in the rows of the queries that show them."""
    path = "/root/testdata/sf0.01"
    voices = {r.voice for r in QUERIES["hps_multivoice"](spark, path).select("voice").distinct().collect()}
    assert voices == {0, 1, 2, 3}
    methods = {r.method.split(" (octave")[0] for r in QUERIES["method_cascade"](spark, path).select("method").distinct().collect()}
    assert {"CQT (consensus)", "CQT (simple)", "CQT (HPS)", "FFT", "None"} <= methods and any(m.startswith("Robust") for m in methods)
    lags = QUERIES["yin_period"](spark, path).where("lag is not null")
    assert lags.where("note is not null").count() > 50 and lags.where("lag <> round(lag)").count() > 0
