"""Every catalog query runs, and equals its SQL on the smallest data."""

import duckdb
import pandas as pd
import pytest

from quillspan.plans.catalog import ORACLE_SQL, QUERIES

#: These ask every question of every document several times over; here they run on a few whole rows.
SLOW = {"page_grounding", "config_sweep", "ask_rerank", "ask_reader", "layout_answers", "eval_run"}


def views(folder):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def sql(sf_dir):
    return views(sf_dir)


@pytest.fixture(scope="module")
def few_dir(sf_dir, tmp_path_factory):
    out = tmp_path_factory.mktemp("few")
    for t, n in (("documents", 24), ("benchmark", 6)):
        pd.read_parquet(f"{sf_dir}/{t}.parquet").head(n).to_parquet(out / f"{t}.parquet")
    return str(out)


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].astype(str).replace({"nan": "None", "<NA>": "None"}) if df[c].dtype == object else pd.to_numeric(df[c]).astype(float).round(6)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def same(spark, folder, sql, name):
    got = QUERIES[name](spark, folder).toPandas()
    if name in ORACLE_SQL:
        pd.testing.assert_frame_equal(plain(got), plain(sql.sql(ORACLE_SQL[name]).df()), check_dtype=False)
    else:
        assert len(got)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, sf_dir, sql, name):
    same(spark, sf_dir, sql, name)


@pytest.mark.parametrize("name", sorted(SLOW))
def test_slow_query(spark, few_dir, name):
    same(spark, few_dir, views(few_dir), name)


def test_names():
    assert set(ORACLE_SQL) <= set(QUERIES)
