"""Queries over keys that larger tables have, against their DuckDB equivalents."""

import duckdb
import pytest

from flintglass.catalogue import ORACLE_SQL, QUERIES

#: Either side of the last address of two bytes, the last port and the last address of three bytes.
USERS = [0, 1_499, 64_511, 64_512, 65_535, 65_536, 89_999, 129_023, 129_024, 539_999, 16_777_215, 16_777_216, 2_000_000_000]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    made = tmp_path_factory.mktemp("keys")
    duckdb.sql(f"""COPY (SELECT u.i * 40 + e.i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(CAST(e.i AS DOUBLE)) AS ts, user_id + e.i % 4 AS user_id, CASE e.i % 3 WHEN 0 THEN 'view' WHEN 1 THEN 'error' ELSE 'signup' END AS event_type,
     1.0 AS value, concat('{{"k": ', e.i, '}}') AS props FROM (SELECT unnest({USERS}::BIGINT[]) AS user_id, unnest(range({len(USERS)})) AS i) u, range(40) e(i)) TO '{made}/events.parquet'""")
    return made


@pytest.mark.parametrize("name", ["capture_summary", "distinct_flows", "http_requests", "pcap_packets"])
def test_users_beyond_a_port(spark, folder, name):
    found = QUERIES[name](spark, str(folder))
    columns = sorted(found.columns)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    want = sorted(duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall(), key=repr)
    assert want and sorted((tuple(r) for r in found.select(*columns).collect()), key=repr) == want
