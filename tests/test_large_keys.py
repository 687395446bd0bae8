"""Queries on keys that only large tables have, against their SQL."""

import duckdb

from lattiq.plans import queries


def test_versions_of_large_parts(spark, tmp_path):
    """A part key of 1,000,000 or more outweighs a line number in the SQL's own rank."""
    rows = [(1, 3, 5), (1, 1, 3_000_006), (2, 1, 1_100_000), (2, 2, 7), (3, 2, 8), (3, 2, 9), (4, 7, 999_999)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    wanted = sorted(connection.execute(f"SELECT id, version, part FROM ({queries.ORACLES['stm_latest_versions']})").fetchall())
    found = sorted((r.id, r.version, r.part) for r in queries.QUERIES["stm_latest_versions"](spark, str(tmp_path)).collect())
    assert found == wanted and len(found) == 4
