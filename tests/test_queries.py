import os

import pytest

duckdb = pytest.importorskip("duckdb")
from lattica.plans.queries import QUERIES, SQL  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(row):
    return str(tuple(None if v is None else float(v) if isinstance(v, float) else str(v) if isinstance(v, str) else v for v in row))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(plain(r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    found = db.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(plain([r[i] for i in at]) for r in found.fetchall())


def test_resolved_triples_of_part_keys_over_six_digits(spark, tmp_path):
    """A line number is not what seq holds above six digits, once part keys have seven."""
    con = duckdb.connect()
    lines = [(1, 1, 1_000_005, 7), (12, 2, 1_000_006, 7), (23, 2, 9, 7), (2, 7, 2_000_004, 8), (13, 2, 2_000_005, 8), (3, 2, 1_000_003, 9), (14, 1, 1_000_004, 9)]
    con.execute("CREATE TABLE lineitem (l_orderkey BIGINT, l_linenumber INTEGER, l_partkey BIGINT, l_suppkey BIGINT)")
    con.executemany("INSERT INTO lineitem VALUES (?, ?, ?, ?)", lines)
    con.execute("CREATE TABLE part AS SELECT DISTINCT l_partkey AS p_partkey, 'part ' || chr(CAST(97 + l_partkey % 13 AS INTEGER)) AS p_name FROM lineitem")
    for t in ("lineitem", "part"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    columns = ["doc_id", "source", "relation", "target", "n"]
    got = sorted(plain(r) for r in QUERIES["g11_resolve_triples"](spark, str(tmp_path)).select(*columns).collect())
    assert got == sorted(plain(r) for r in con.execute(f"SELECT {', '.join(columns)} FROM ({SQL['g11_resolve_triples']})").fetchall())


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
