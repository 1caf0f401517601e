import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["topk_cosine", "hybrid_search", "keyword_interleave", "two_scope_search", "pool_stats", "run_health", "keeper_merge", "entity_edges", "soft_delete", "latest_earlier_call", "quality_scan", "record_stats"]


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 10


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    plain = lambda v: round(float(v), 5) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    sql = entry.oracle_sql()[name]
    found = con.execute(f"select {', '.join(cols)} from ({sql})").fetchall()
    want = sorted((tuple(plain(v) for v in r) for r in found), key=repr)
    assert [tuple(float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in r) for r in got] == [
        tuple(float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in r) for r in want
    ]
