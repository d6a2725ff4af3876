"""Queries over events on tables that the small ones do not stand for: more partitions, moments beside a boundary."""

import duckdb
import pytest
from test_oracle import compare

from folioframe import catalog


@pytest.fixture
def events(tmp_path):
    con = duckdb.connect()

    def made(sql):
        con.execute(f"COPY ({sql}) TO '{tmp_path}/events.parquet'")
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
        return con, str(tmp_path)

    return made


def test_positions_of_a_listing_of_several_partitions(spark, events):
    con, at = events("SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_milliseconds(i * 7919 % 50000) AS ts, i % 300 AS user_id FROM range(0, 60000) t(i)")
    held = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "600k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "32k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.shuffle.partitions": "12", "spark.sql.autoBroadcastJoinThreshold": "256k"}
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        compare(spark, con, catalog.Q["library_documents"](spark, at), catalog.SQL["library_documents"])
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_moments_within_a_microsecond_of_a_boundary(spark, events):
    # event_id % 3 = 2: a forty-thousandth of the distance
    con, at = events("SELECT 3 * k + 2 AS event_id, TIMESTAMP '2024-01-15 12:00:00' + to_microseconds(s * ((2 * k + 1) * 20000000000 + d)) AS ts FROM range(0, 70) t(k), (SELECT unnest([-1, 1]) AS s), (SELECT unnest([-19000, -1, 0, 1, 19000]) AS d)")
    compare(spark, con, catalog.Q["relative_time"](spark, at), catalog.SQL["relative_time"])
