"""Snapshots, buses, registries and formats."""

import pytest
from pyspark.sql import functions as F

from eventlake.functions import formats
from eventlake.functions.routing import djb2
from eventlake.operators import bus, registry, snapshots


def test_snapshots(spark):
    store = spark.createDataFrame([("P", s, f"s{s}") for s in (10, 50, 30, -5)], "key string, sequence long, state string")
    seqs = lambda df: sorted(r["sequence"] for r in df.collect())
    assert snapshots.last(store).first()["sequence"] == 50
    assert seqs(snapshots.listed(store, "P", 10, 50)) == [10, 30]
    assert seqs(snapshots.delete(store, "P", 31)) == [-5, 50]
    new = spark.createDataFrame([("P", 40, "n")], store.schema)
    assert seqs(snapshots.add(store, new, prune=True)) == [-5, 40, 50]
    assert snapshots.add(store, spark.createDataFrame([("P", 10, "again")], store.schema)).where("sequence = 10").first()["state"] == "again"


def test_routing_hash(spark):
    def plain(b):
        h = 5381
        for x in b:
            h = (h * 33 + x) % (1 << 64)
        return h

    keys = ["order-123", "", "é", "x" * 60]
    got = [int(r[0]) for r in spark.createDataFrame([(k,) for k in keys], "k string").select(djb2(F.col("k"))).collect()]
    assert got == [plain(k.encode()) for k in keys] and got[0] == 249901300662372036


def test_permits(spark):
    handlers = spark.createDataFrame([("C", "n1", "c", 0, 1), ("C", "n2", "c", 100, 2)], "message_type string, client_id string, component_name string, load_factor int, reg_seq long")
    commands = spark.createDataFrame([("b", i, "C" if i < 6 else "D", "k" if i == 0 else None) for i in range(7)], "bus string, arrival long, name string, routing_key string")
    permits = spark.createDataFrame([("b", "n1", 2), ("b", "n2", 2)], "bus string, client_id string, permits long")
    got = {r["arrival"]: r["outcome"] for r in bus.with_permits(commands, handlers, permits).collect()}
    assert list(got.values()).count("DISPATCHED") == 4 and got[6] == "NO_HANDLER" and got[5] == "NO_PERMITS"


def test_health_and_processors(spark):
    known = spark.createDataFrame([("a", "c", 0), ("b", "c", 54_000), ("c", "c", 59_000)], "client_id string, component_name string, last_heartbeat long")
    assert [r["health"] for r in registry.health(known, F.lit(60_000)).orderBy("client_id").collect()] == ["stale", "slow", "healthy"]
    assert [r["client_id"] for r in registry.dead(known, F.lit(60_000)).collect()] == ["a"]
    rows = spark.createDataFrame([("p", "c1", True, 0, 2, 7, True, False, ""), ("p", "c2", True, 1, 2, 9, False, False, ""), ("q", "c1", False, None, None, None, None, None, None)], "processor_name string, client_id string, running boolean, segment_id int, one_part_of int, token_position long, caught_up boolean, replaying boolean, error_state string")
    got = {r["processor_name"]: r for r in registry.processors(rows).collect()}
    assert (got["p"]["status"], got["p"]["instances"], got["p"]["low"], got["p"]["high"]) == ("behind", 2, 7, 9)
    assert (got["q"]["status"], got["q"]["low"]) == ("stopped", -1)
    assert {r[0]: r[1] for r in registry.split_candidate(rows).collect()} == {"p": 0, "q": 0}
    assert {r[0]: r[1] for r in registry.merge_candidate(rows).collect()} == {"p": 1, "q": 0}


def test_formats(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(formats.number(F.lit(n))) for n in (999, 1234, 12_345, 1_234_567)] == ["999", "1,234", "12.3K", "1.23M"]
    assert [one(formats.size(F.lit(n))) for n in (5, 2048, 3 << 20, 5 << 30)] == ["5 B", "2 KB", "3 MB", "5.0 GB"]
    assert one(formats.timestamp(F.lit(1712345678901))) == "2024-04-05 19:34:38.901"
    assert one(formats.preview(F.lit(bytearray(b"\xff\x00")))) == "ff00..."
    assert one(formats.html_escape(F.lit('<a&"'))) == "&lt;a&amp;&quot;"


@pytest.mark.parametrize("name", ["source_by_tag", "dcb_check_batch", "route_round_robin", "stream_equals_batch"])
def test_queries_agree_with_sql(spark, name):
    import duckdb

    from eventlake import queries

    sf, db = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("events", "orders", "supplier", "nation"):
        db.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf), db.sql(queries.ORACLES[name])
    order = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(*order).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_source_many_entities_has_no_highest_user(spark, tmp_path):
    import duckdb

    from eventlake import queries

    users = [3, 13, 4, 99_993, 100_003, 5_000_000_003, 5_000_000_003]
    e = spark.createDataFrame([(i, u) for i, u in enumerate(users)], "event_id long, user_id long")
    e = e.withColumns({"ts": F.timestamp_seconds(F.lit(0)), "event_type": F.lit("view"), "props": F.lit('{"k": 1}')})
    e.write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = queries.QUERIES["source_many_entities"](spark, str(tmp_path)).select("value", "position").collect()
    want = db.sql(queries.ORACLES["source_many_entities"]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 6
