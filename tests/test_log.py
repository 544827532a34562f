"""Criteria, conditional appends, contexts and streams on small logs."""

import random

import pytest
from pyspark.sql import functions as F

from eventlake.operators import dcb, postings, reads
from eventlake.plans.criteria import Condition, Criterion, Tag, parse_filter
from eventlake.schema import EVENT, INPUT
from eventlake.sources.log import ConsistencyConditionViolated, ContextError, Store, valid_context


def tags(**t):
    return [(k.encode(), v.encode()) for k, v in t.items()]


def log_of(spark, *events, timestamps=None):
    rows = [(i, f"id-{n}", n, "1.0", timestamps[i - 1] if timestamps else 1712345678000, b"data", {}, tags(**t), "c") for i, (n, t) in enumerate(events, 1)]
    return spark.createDataFrame(rows, EVENT)


def found(df):
    return [r["position"] for r in df.collect()]


def test_criteria(spark):
    log = log_of(spark, ("OrderPlaced", {"orderId": "A", "region": "EU"}), ("OrderPlaced", {"orderId": "A", "region": "US"}), ("PaymentReceived", {"orderId": "B", "region": "EU"}), ("OrderShipped", {"orderId": "A"}))
    read = lambda *c, **k: found(reads.source(log, Condition.of(*c), **k))
    a = Criterion.of(orderId="A")
    assert read(a) == [1, 2, 4]
    assert read(Criterion.of(orderId="A", region="EU")) == [1]
    assert read(a, Criterion.of(orderId="B"), a) == [1, 2, 3, 4]
    assert read(Criterion.of(("OrderPlaced", "OrderShipped"), orderId="A")) == [1, 2, 4]
    assert read(Criterion()) == [1, 2, 3, 4] and read() == []
    assert found(reads.source(log, Condition((), empty_means_all=True))) == [1, 2, 3, 4]
    assert read(Criterion(), start=3) == [3, 4] and read(Criterion(), start=-1) == [] and read(Criterion(), committed=2) == [1, 2]
    assert "tags" not in reads.source(log, Condition.of(a)).columns
    assert [dcb.conflict(log, Condition.of(a), m) for m in (0, 1, 2, 4)] == [1, 2, 4, None]
    assert found(reads.source_stored(log, Condition.of(a), limit=0)) == [1]
    assert parse_filter("", "junk, =x").column() is not None and parse_filter(" a ", "k = v=w").criteria[0].tags[0].value == b"v=w"


def test_positions_by_time(spark):
    log = log_of(spark, ("E", {}), ("E", {}), ("E", {}), timestamps=[100, 50, 200])
    assert [reads.sequence_at(log, t).first()[0] for t in (60, 150, 201, 40)] == [1, 3, -1, 1]
    assert reads.ends(log.where("false")).first()[:2] == (1, 1)
    assert {r["key"]: r["value"] for r in reads.get_tags(log_of(spark, ("E", {"a": "b"})), 1).collect()} == {"a": "b"}
    with pytest.raises(KeyError):
        reads.get_tags(log, 9)


def test_postings_agree_with_scans(spark):
    r = random.Random(4)
    log = log_of(spark, *[(r.choice("PQR"), {k: r.choice("xyz") for k in r.sample("abc", r.randint(0, 3))}) for _ in range(60)])
    index = postings.build(log, 10)
    for _ in range(6):
        c = Condition.of(*[Criterion.of(r.sample("PQR", r.randint(0, 2)), **{k: r.choice("xyz") for k in r.sample("abc", r.randint(0, 2))}) for _ in range(r.randint(0, 3))])
        want = found(reads.source(log, c))
        assert sorted(found(postings.source(log, index, c))) == want
        seen = {s["segment"] for s in postings.segments_that_may_match(index, c).collect()}
        assert {(p - 1) // 10 for p in want} <= seen
        assert (postings.bitmaps(log, c).agg(F.sum("positions")).first()[0] or 0) == len(want)


def test_append_and_stream(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    with pytest.raises(ContextError):
        store.create("has spaces")
    log = store.create("orders")
    with pytest.raises(ContextError):
        store.create("orders")
    assert (log.head(), log.tail()) == (1, 1)
    events = lambda *e: spark.createDataFrame([(f"id{i}", n, "1.0", 5, b"p", {"m": "1"}, tags(**t), i) for i, (n, t) in enumerate(e)], INPUT + ", seq int")
    a = Condition.of(Criterion.of(orderId="A"))
    got = log.append(events(("OrderPlaced", {"orderId": "A"}), ("OrderPlaced", {"orderId": "B"})))
    assert (got.first_position, got.count, got.consistency_marker, log.head(), log.tail()) == (1, 2, 2, 3, 1)
    with pytest.raises(ConsistencyConditionViolated) as e:
        log.append(events(("X", {})), a, 0)
    assert e.value.conflicting_position == 1
    assert log.append(events(("Paid", {"orderId": "A"})), a, 1).first_position == 3
    assert log.append(events(("Free", {})), a, -1).count == 1
    assert log.append(events(("Never", {})).where("false"), a, 4).count == 0
    rows, marker = log.source(a)
    assert (found(rows), marker) == ([1, 3], 4)
    assert store.names() == ["orders"] and not log.orphans()
    from eventlake.streaming.live import subscribe

    path, out, seen = str(tmp_path / "store" / "orders"), str(tmp_path / "out"), str(tmp_path / "seen")

    def follow():
        subscribe(spark, path, a, 2).select("position").writeStream.format("parquet").option("path", out).option("checkpointLocation", seen).trigger(availableNow=True).start().awaitTermination()
        return sorted(found(spark.read.schema("position long").parquet(out)))

    assert follow() == [3]
    log.append(events(("More", {"orderId": "A"})))
    assert follow() == [3, 5]  # resumes from the cursor


def test_names():
    assert all(map(valid_context, ("orders", "my-context", "context_v2", "x" * 128)))
    assert not any(map(valid_context, ("", "has spaces", "has/slashes", "has.dots", "x" * 129)))


def test_replay(spark):
    r = random.Random(5)
    rows = [(r.choice("ab"), i, r.choice("xyz"), r.randint(-1, 20)) for i in range(80)]
    last, own, want = {"a": 0, "b": 0}, {}, []
    for c, i, k, m in rows:
        hits = [p for p in own.get((c, k), []) if p > m]
        if m >= 0 and hits:
            want.append((c, i, False, 0, min(hits)))
        else:
            last[c] += 1
            own.setdefault((c, k), []).append(last[c])
            want.append((c, i, True, last[c], 0))
    assert sorted(map(tuple, dcb.replay(spark.createDataFrame(rows, "context string, arrival long, key string, marker long")).collect())) == sorted(want)


def test_batch_of_conditions(spark):
    """Against brute force, with a name and a tag that most events have, and markers in and past every segment."""
    r = random.Random(3)
    events = [(p, "Hot" if r.random() < 0.8 else f"N{r.randint(0, 5)}", sorted({("region", "EU")} & {("region", r.choice(["EU", "EU", "US"]))} | {("id", str(r.randint(0, 30))) for _ in range(r.randint(0, 2))})) for p in range(1, 400)]
    log = spark.createDataFrame([(p, n, [(bytearray(k.encode()), bytearray(v.encode())) for k, v in t]) for p, n, t in events], "position long, name string, tags array<struct<key:binary,value:binary>>")
    choices = [[], [("id", "3")], [("id", "7")], [("region", "EU")], [("region", "EU"), ("id", "5")], [("id", "5"), ("id", "6")], [("id", "none")]]
    conditions = [(f"c{i}", r.choice([-1, 0, 1, 50, 63, 64, 200, 398, 399, 1000]), j, r.choice(choices), r.choice([[], ["Hot"], ["N1", "N2"], ["N1", "Hot"], ["none"]])) for i in range(150) for j in range(r.randint(1, 2))]
    markers = {c: m for c, m, *_ in conditions}
    conditions = [(c, markers[c], *rest) for c, _, *rest in conditions]
    want = {}
    for c, m, _, tags, names in conditions:
        hit = min((p for p, n, t in events if p > m and set(tags) <= set(t) and (not names or n in names)), default=None)
        want[c] = min((x for x in (hit, want.get(c)) if x), default=None)
    frame = spark.createDataFrame([(c, m, j, [Tag.of(*t).fkey for t in tags], names) for c, m, j, tags, names in conditions], "cond_id string, marker long, crit_id int, fkeys array<string>, names array<string>")
    assert {x["cond_id"]: x["conflict"] for x in dcb.conflicts(frame, postings.build(log, 64), 64).collect()} == want


def test_writer_that_died(spark, tmp_path):
    """A lock whose owner died before its manifest was in place: the next append finishes that one and takes the next number.
    One that names nothing is given up."""
    from eventlake.sources import log as log_module

    log = Store(spark, str(tmp_path / "store")).create("orders")
    events = lambda *names: spark.createDataFrame([(f"id{i}", n, "1.0", 5, b"p", {}, [], i) for i, n in enumerate(names)], INPUT + ", seq int")
    log.append(events("A", "B"))
    settle, log._settle = log._settle, lambda number: None  # dies with the lock, before the rename
    log.append(events("C"))
    log._settle = settle
    assert log.committed() == 2
    assert log.append(events("D")).first_position == 4 and sorted(r["name"] for r in log.read().collect()) == ["A", "B", "C", "D"]
    assert log._write(f"{log.path}/locks/{4:020d}", "")  # dies while it makes the lock
    log_module.GRACE, grace = 1, log_module.GRACE
    try:
        assert log.append(events("E")).first_position == 5
    finally:
        log_module.GRACE = grace
    assert log.head() == 6 and sorted(found(log.read())) == [1, 2, 3, 4, 5]


def test_lists_of_manifests_and_group_commit(spark, tmp_path, monkeypatch):
    from eventlake.sources import log as log_module
    from eventlake.streaming.append import append_stream
    from eventlake.streaming.live import subscribe

    monkeypatch.setattr(log_module, "CHECKPOINT", 2)
    log = Store(spark, str(tmp_path / "store")).create("orders")
    schema = INPUT + ", seq int"
    for k in range(3):
        spark.createDataFrame([(f"id{k}{i}", "E", "1.0", 5, b"p", {}, [], i) for i in range(4)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: append_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), log, str(tmp_path / "seen")).awaitTermination()
    stream()
    stream()  # nothing new
    assert (log.head(), len(log.manifests())) == (13, 3) and any(n.endswith(".list") for n in log._names())
    assert sorted(found(log.read())) == list(range(1, 13)) and found(log.read(8).orderBy("position")) == list(range(1, 9))
    first = spark.createDataFrame([("again", "E", "1.0", 5, b"p", {}, [], 0)], schema)
    assert log.append(first, batch=f"{tmp_path / 'seen'}#0").consistency_marker == 4  # a batch run again
    subscribe(spark, log.path, Condition.of(Criterion()), 6).select("position").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cursor")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(found(spark.read.schema("position long").parquet(str(tmp_path / "out")))) == list(range(6, 13))


def test_status_of_errors():
    from eventlake.functions.errors import Corrupted, SnapshotNotFound, status
    from eventlake.sources.log import ContextExists, ContextNotFound, InvalidContextName

    assert [status(e)[0] for e in (ConsistencyConditionViolated(7), Corrupted("x"), ContextNotFound("x"), SnapshotNotFound("k"), ContextExists("x"), InvalidContextName("x"), OSError("x"), ValueError("x"))] == ["ABORTED", "INTERNAL", "NOT_FOUND", "NOT_FOUND", "ALREADY_EXISTS", "INVALID_ARGUMENT", "INTERNAL", "UNKNOWN"]
    assert "position 7" in status(ConsistencyConditionViolated(7))[1]


def test_sealed_segments(spark, tmp_path):
    log = Store(spark, str(tmp_path / "store")).create("orders")
    events = lambda n: spark.createDataFrame([(f"id{i}", "E" if i % 2 else "F", "1.0", 5, b"p", {}, tags(k=str(i % 3)), i) for i in range(n)], INPUT + ", seq int")
    log.append(events(25))
    assert log.seal(10) == 2 and log.seal(10) == 0
    log.append(events(10))
    every = lambda p: sorted((r["segment"], r["fkey"], r["position"]) for r in p.collect())
    assert every(log.postings(10)) == every(postings.build(log.read(), 10))
    assert log.seal(10) == 1 and every(log.postings(10)) == every(postings.build(log.read(), 10))
    c = Condition.of(Criterion.of(("E",), k="1"))
    assert sorted(found(postings.source(log.read(), log.postings(10), c))) == sorted(found(reads.source(log.read(), c)))


def test_life_cycles(spark):
    """Second registrations, permits that run out and come again, a client that goes and comes back, permits in order."""
    from eventlake.operators import bus, registry, snapshots

    ops = [(1, "register", "T", "a"), (2, "register", "T", "a"), (3, "register", "U", "a"), (4, "register", "T", "b"), (5, "unregister", "T", "a"), (6, "remove_client", None, "b"), (7, "register", "T", "b"), (8, "unregister", "X", "zz")]
    log = spark.createDataFrame([(*o, "c", 1) for o in ops], "seq int, op string, message_type string, client_id string, component_name string, load_factor int")
    assert sorted((r["message_type"], r["client_id"], r["reg_seq"]) for r in registry.handlers(log).collect()) == [("T", "b", 7), ("U", "a", 3)]
    moves = [("a", "acquire", 0, 1), ("a", "grant", 2, 2), ("a", "acquire", 0, 3), ("a", "acquire", 0, 4), ("a", "acquire", 0, 5), ("a", "grant", 1, 6), ("a", "acquire", 0, 7), ("b", "acquire", 0, 8)]
    got = registry.permits(spark.createDataFrame(moves, "client_id string, op string, permits long, seq int"), ["client_id"]).collect()
    assert sorted((r["seq"], r["acquired"], r["left"]) for r in got) == [(1, False, 0), (3, True, 1), (4, True, 0), (5, False, 0), (7, True, 0), (8, False, 0)]
    handlers = spark.createDataFrame([("T", "a", 1, 1), ("T", "b", 1, 2)], "message_type string, client_id string, load_factor int, reg_seq int")
    grants = spark.createDataFrame([("a", 1, 0), ("b", 1, 0), ("b", 1, 5)], "client_id string, permits long, arrival long")
    asked = spark.createDataFrame([(i, "T") for i in range(1, 7)] + [(7, "none")], "arrival long, name string")
    rows = lambda df: sorted((r["arrival"], r["outcome"], r["client_id"]) for r in df.collect())
    none = [(i, "NO_PERMITS", "") for i in (3, 4)] + [(5, "DISPATCHED", "b"), (6, "NO_PERMITS", ""), (7, "NO_HANDLER", "")]
    assert rows(bus.first_with_permit(asked, handlers, grants)) == sorted([(1, "DISPATCHED", "a"), (2, "DISPATCHED", "b"), *none])
    assert rows(bus.scatter_with_permits(asked, handlers, grants)) == sorted([(1, "DISPATCHED", "a"), (1, "DISPATCHED", "b"), (2, "NO_PERMITS", ""), *none])
    store = spark.createDataFrame([("k", 10, "x"), ("k", 50, "y")], "key string, sequence long, state string")
    assert [tuple(snapshots.get_last(store, k).first()) for k in ("k", "none")] == [("k", 50, "y"), ("none", 0, "")]
    subscribed = [(1, "open", "s1", "a", "h"), (2, "open", "s2", "b", "h"), (3, "open", "s3", "a", "i"), (4, "cancel", "s3", None, None), (5, "remove_client", None, "b", None), (6, "open", "s3", "c", "b")]
    active = registry.subscriptions(spark.createDataFrame([(*o, 1000 * o[0]) for o in subscribed], "seq int, op string, subscription_id string, client_id string, handler_client_id string, at long"))
    assert sorted((r["subscription_id"], r["opened_at"]) for r in active.collect()) == [("s1", 1000), ("s3", 6000)]
    assert tuple(registry.subscription_stats(active, F.lit(9000)).first()) == (2, 8)
