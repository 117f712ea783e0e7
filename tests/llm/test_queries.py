"""Every registered query runs over whole tables of the smallest data."""

import re

import duckdb
import pytest

from quillspan.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = {
    "op1_ann": ["query_id", "rank", "vec_id", "score"],
    "op2_urls": ["page_id", "host", "path", "rule", "verdict"],
    "op3_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op4_simhash": ["doc_id", "fingerprint", "component_id"],
    "op7_langid": ["doc_id", "held_out", "lang_pred", "score"],
    "op8_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
}


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    out = QUERIES[name](spark, sf_dir)
    if name in COLUMNS:
        assert out.columns[: len(COLUMNS[name])] == COLUMNS[name]
    rows = out.toPandas()
    if name in ORACLE_SQL:
        c = duckdb.connect()
        for t in ("documents", "benchmark"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        want = c.sql(ORACLE_SQL[name]).df()
        assert sorted(map(tuple, rows[list(want.columns)].round(9).values)) == sorted(map(tuple, want.round(9).values))
    elif name != "op1_ann":
        table = "pages" if name == "op2_urls" else "documents"
        assert len(rows) == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()


def test_recall_against_brute_force(spark, sf_dir):
    import numpy as np

    x = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    v = np.stack(x["embedding"].to_numpy()).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    got = QUERIES["op1_ann"](spark, sf_dir).toPandas().groupby("query_id")["vec_id"].apply(set)
    hits = total = 0
    for i in x.index[x["vec_id"] % 50 == 0]:
        s = v @ v[i]
        s[i] = -9
        hits, total = hits + len(set(x["vec_id"].to_numpy()[np.argsort(-s)[:5]]) & got[x["vec_id"][i]]), total + 5
    assert hits / total >= 0.9
