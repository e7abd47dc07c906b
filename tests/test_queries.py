"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from needlework import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, data_dir, name):
    df = queries.QUERIES[name](spark, data_dir)
    got = df.toPandas()
    if name not in queries.ORACLE_SQL:
        assert len(got)
        return
    want = duck.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda x: sorted(map(str, x[sorted(x.columns)].astype(object).itertuples(index=False, name=None)))
    assert plain(got) == plain(want)


def test_entry(spark, data_dir):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pair_table_in_parts(spark, duck, data_dir, monkeypatch):
    """Each literal is looked for in one part, and the tables of a part go before the next one."""
    from needlework.sources import scratch

    monkeypatch.setattr(queries, "PART_LITERALS", 500)
    steps, scan, remove = [], queries.scan_table, scratch.remove
    monkeypatch.setattr(queries, "scan_table", lambda df, col, own, **kw: (steps.append(own.count()), scan(df, col, own, **kw))[1])
    monkeypatch.setattr(scratch, "remove", lambda spark, path: (steps.append(path.split("/")[-1].split("-")[0]), remove(spark, path)))
    got = {tuple(r[c] for c in ("doc_id", "n_matches", "n_literals", "sum_start")) for r in queries.scan_pair_table(spark, data_dir).collect()}
    want = duck.sql(queries.ORACLE_SQL["scan_pair_table"]).df()
    assert got == set(want[["doc_id", "n_matches", "n_literals", "sum_start"]].astype(int).itertuples(index=False, name=None))
    parts = [n for n in steps if isinstance(n, int)]
    assert len(parts) > 3 and max(parts) < sum(parts) / 2
    assert steps == [x for n in parts for x in (n, "literals")] + ["pairs"]
