"""All queries over the supplied tables, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import formats
from .operators import bus, dcb, postings, reads, registry, report, snapshots
from .plans.criteria import Condition, Criterion, parse_filter
from .sources import adapters
from .sources.shared import numbered, written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SEGMENT = 1000  # positions of a segment at the scale of the supplied tables

_EVENT = "event_id + 1 as position, event_type as name, epoch_us(ts) // 1000 as timestamp, props as payload"
_K = "json_extract_string(props, '$.k')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def flat(events: DataFrame) -> DataFrame:
    return events.select("position", "name", "timestamp", F.decode("payload", "UTF-8").alias("payload"))


def _user(n: int) -> Criterion:
    return Criterion.of(userId=str(n))


def _source(condition: Condition, **more):
    return lambda spark, sf_dir: flat(reads.source(adapters.activity(spark, sf_dir), condition, **more))


def _sourced(name: str, where: str, condition: Condition, **more) -> None:
    QUERIES[name] = _source(condition, **more)
    ORACLES[name] = f"select {_EVENT} from events where {where}"


_sourced("source_by_tag", "user_id = 8", Condition.of(_user(8)))
_sourced("source_and_tags", f"user_id = 8 and {_K} = '10'", Condition.of(Criterion.of(userId="8", k="10")))
_sourced("source_by_name", "event_type in ('click', 'error')", Condition.of(Criterion(("click", "error"))))
_sourced("source_tag_and_names", "user_id = 8 and event_type in ('click', 'view')", Condition.of(Criterion.of(("click", "view"), userId="8")))
_sourced("source_or_criteria", "user_id = 8 or event_type = 'click'", Condition.of(_user(8), Criterion(("click",))))
_sourced("source_match_all", "true", Condition.of(Criterion()))
_sourced("source_empty_criteria", "false", Condition())
_sourced("source_from_position", "event_type = 'view' and event_id + 1 >= 500", Condition.of(Criterion(("view",))), start=500)
_sourced("source_up_to", "event_id + 1 <= 300", Condition.of(Criterion()), committed=300)
_sourced("source_negative_start", "false", Condition.of(Criterion()), start=-5)
_sourced("source_filter_text", "event_type = 'click' and user_id = 8", parse_filter("click", " userId = 8 ,junk"))


def _postings(spark, sf_dir) -> DataFrame:
    return postings.build(adapters.activity(spark, sf_dir), SEGMENT)


@query(f"select {_EVENT} from events where user_id = 8 or (event_type = 'click' and {_K} = '7')")
def source_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = adapters.activity(spark, sf_dir)
    return flat(postings.source(log, _postings(spark, sf_dir), Condition.of(_user(8), Criterion.of(("click",), k="7"))))


@query("""select 'OrderPlaced' as name, epoch_us(o_orderdate) // 1000 as timestamp, o_totalprice as amount from orders where o_orderkey = 7
  union all select 'LineShipped', epoch_us(l_shipdate) // 1000, l_extendedprice from lineitem where l_orderkey = 7""")
def source_order_lifecycle(spark, sf_dir):
    rows = reads.source(adapters.orders(spark, sf_dir), Condition.of(Criterion.of(orderId="7")))
    return rows.select("name", "timestamp", F.get_json_object(F.decode("payload", "UTF-8"), "$.amount").cast("double").alias("amount"))


@query("select cast(user_id as varchar) as value, event_id + 1 as position from events")
def source_many_entities(spark, sf_dir):
    keys = adapters.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("value")).distinct()
    return reads.source_many(adapters.activity(spark, sf_dir), keys, "userId").select("value", "position")


@query("select event_id + 1 as position, cast(user_id as varchar) as user_id from events where event_type = 'click' order by 1 limit 25")
def source_limited(spark, sf_dir):
    rows = reads.source_stored(adapters.activity(spark, sf_dir), Condition.of(Criterion(("click",))), 1, 25)
    return rows.select("position", F.decode(F.filter("tags", lambda t: t["key"] == F.lit(bytearray(b"userId")))[0]["value"], "UTF-8").alias("user_id"))


@query("select event_id + 1 as position from events order by 1 limit 1")
def source_limit_zero(spark, sf_dir):
    return reads.source_stored(adapters.activity(spark, sf_dir), Condition.of(Criterion()), 1, 0).select("position")


@query("select coalesce(max(event_id + 1), 0) + 1 as head, coalesce(min(event_id + 1), 1) as tail, count(*) as events from events")
def head_tail(spark, sf_dir):
    return reads.ends(adapters.activity(spark, sf_dir))


_CONTEXTS = """select 'activity' as context, count(*) as n from events union all select 'placed', count(*) from orders union all select 'chat', count(*) from conversations"""


@query(f"select context, n + 1 as head, 1::bigint as tail, n as events from ({_CONTEXTS})")
def context_stats(spark, sf_dir):
    return report.context_stats(adapters.contexts(spark, sf_dir))


@query(f"select context, n as events, cast(greatest(2, n * 100 // greatest(max(n) over (), 1)) as bigint) as pct from ({_CONTEXTS})")
def context_chart(spark, sf_dir):
    return report.chart(report.context_stats(adapters.contexts(spark, sf_dir)))


@query(f"select sum(n)::bigint as events, count(*) as contexts from ({_CONTEXTS})")
def overview_totals(spark, sf_dir):
    return report.context_stats(adapters.contexts(spark, sf_dir)).agg(F.sum("events").alias("events"), F.count("*").alias("contexts"))


@query(f"select 'userId' as key, cast(user_id as varchar) as value from events where event_id = 41 union all select 'k', {_K} from events where event_id = 41")
def get_tags(spark, sf_dir):
    return reads.get_tags(adapters.activity(spark, sf_dir), 42)


@query("select coalesce(min(event_id + 1), -1) as position from events where epoch_us(ts) // 1000 >= 1704200000000")
def sequence_at(spark, sf_dir):
    return reads.sequence_at(adapters.activity(spark, sf_dir), 1704200000000)


@query("select coalesce(min(o_orderkey + 1), -1) as position from orders where epoch_us(o_orderdate) // 1000 >= 900000000000")
def sequence_at_out_of_order(spark, sf_dir):
    return reads.sequence_at(adapters.placed(spark, sf_dir), 900000000000)


@query("select -1::bigint as position")
def sequence_at_none(spark, sf_dir):
    return reads.sequence_at(adapters.activity(spark, sf_dir), 1 << 60).select(F.col("position").cast("long"))


@query("select min(event_id + 1) as position from events where user_id = 8 and event_id + 1 > 100")
def first_match_after(spark, sf_dir):
    return reads.first_after(adapters.activity(spark, sf_dir), Condition.of(_user(8)), 100)


_POSTINGS = f"""(select event_id // {SEGMENT} as segment, 'name:' || event_type as fkey, event_id + 1 as position from events
  union all select event_id // {SEGMENT}, '757365724964=' || hex(cast(user_id as varchar)), event_id + 1 from events
  union all select event_id // {SEGMENT}, '6B=' || hex({_K}), event_id + 1 from events)"""


@query(f"select segment, fkey, count(*) as positions, min(position) as low, max(position) as high from {_POSTINGS} group by all")
def postings_build(spark, sf_dir):
    return _postings(spark, sf_dir).groupBy("segment", "fkey").agg(F.count("*").alias("positions"), F.min("position").alias("low"), F.max("position").alias("high"))


@query("select count(*) as positions from events where user_id = 8 or event_type = 'click'")
def bitmap_cardinality(spark, sf_dir):
    return postings.bitmaps(adapters.activity(spark, sf_dir), Condition.of(_user(8), Criterion(("click",)))).agg(F.sum("positions").alias("positions"))


@query(f"select segment from {_POSTINGS} group by segment having bool_or(fkey = '757365724964=' || hex('8')) and bool_or(fkey in ('name:purchase', 'name:error'))")
def segment_pruning(spark, sf_dir):
    return postings.segments_that_may_match(_postings(spark, sf_dir), Condition.of(Criterion.of(("purchase", "error"), userId="8")))


@query(f"""select event_id + 1 as position, 'userId=' || user_id as tag from events where event_id % 5 <> 0
  union all select event_id + 1, 'k=' || {_K} from events
  union all select event_id + 1, 'region=EU' from events where event_id % 3 = 0""")
def tag_mutations(spark, sf_dir):
    """Of every event: each fifth loses its user, each third gains a region, each next one gains it and loses it again."""
    log = adapters.activity(spark, sf_dir)
    tag = lambda k, v: F.struct(F.encode(F.lit(k), "UTF-8").alias("key"), F.encode(v, "UTF-8").alias("value"))
    own = F.filter("tags", lambda t: t["key"] == F.lit(bytearray(b"userId")))[0]
    eu = tag("region", F.lit("EU"))
    edits = log.where("(position - 1) % 5 = 0").select("position", F.lit(1).alias("seq"), F.lit("remove").alias("op"), own.alias("tag")).union(log.where("(position - 1) % 3 = 0").select("position", F.lit(2), F.lit("add"), eu))
    edits = edits.union(log.where("(position - 1) % 3 = 1").select("position", F.lit(3), F.lit("add"), eu)).union(log.where("(position - 1) % 3 = 1").select("position", F.lit(4), F.lit("remove"), eu))
    return postings.edited(log, edits).select("position", F.explode("tags").alias("t")).select("position", F.concat(F.decode("t.key", "UTF-8"), F.lit("="), F.decode("t.value", "UTF-8")).alias("tag"))


@query("select min(event_id + 1) as conflict from events where user_id = 8 and event_type in ('click', 'view') and event_id + 1 > 50")
def dcb_check_single(spark, sf_dir):
    at = dcb.conflict(adapters.activity(spark, sf_dir), Condition.of(Criterion.of(("click", "view"), userId="8")), 50)
    return spark.createDataFrame([(at,)], "conflict long")


@query("""select 'user-' || u.user_id as cond_id, min(e.event_id + 1) as conflict
  from (select distinct user_id from events) u left join events e on e.user_id = u.user_id and e.event_type <> 'view' and e.event_id + 1 > u.user_id * 10 group by all""")
def dcb_check_batch(spark, sf_dir):
    """A condition for each user: no event but views past ten times the user's number."""
    users = adapters.table(spark, sf_dir, "events").select("user_id").distinct()
    key = F.concat(F.lit("757365724964="), F.hex(F.encode(F.col("user_id").cast("string"), "UTF-8")))
    conditions = users.select(F.concat(F.lit("user-"), "user_id").alias("cond_id"), (F.col("user_id") * 10).alias("marker"), F.lit(0).alias("crit_id"), F.array(key).alias("fkeys"), F.array(*map(F.lit, ("click", "purchase", "error", "signup"))).alias("names"))
    return dcb.conflicts(conditions, _postings(spark, sf_dir), SEGMENT)


@query()
def dcb_replay(spark, sf_dir):
    """Each event as a request that must not conflict past half its number; four contexts."""
    e = adapters.table(spark, sf_dir, "events")
    return dcb.replay(e.select((F.col("user_id") % 4).cast("string").alias("context"), F.col("event_id").alias("arrival"), F.col("user_id").cast("string").alias("key"), F.floor(F.col("event_id") / 8).cast("long").alias("marker")))


@query("""select event_id // 10 as request_id, case when min(event_id) % 20 = 0 then 'c' || min(event_id) end as condition, string_agg(event_type, ',' order by event_id) as events, count(*) as n from events group by 1""")
def append_folding(spark, sf_dir):
    """Streamed appends of ten parts; in every other request the first and the last part have a condition."""
    e = adapters.table(spark, sf_dir, "events")
    parts = e.select(F.floor(F.col("event_id") / 10).cast("long").alias("request_id"), (F.col("event_id") % 10).alias("part_no"), F.when(F.col("event_id") % 20 == 0, F.concat(F.lit("c"), "event_id")).when(F.col("event_id") % 20 == 9, F.lit("late")).alias("condition"), F.array("event_type").alias("events"))
    return dcb.folded(parts).select("request_id", "condition", F.concat_ws(",", "events").alias("events"), F.size("events").cast("long").alias("n"))


@query("""select row_number() over (order by timestamp, name, order_id, line, part, supplier, customer, amount, quantity, discount, tax, flags) as position, name, order_id, amount from (
  select epoch_us(o_orderdate) // 1000 as timestamp, 'OrderPlaced' as name, o_orderkey as order_id, -1 as line, -1 as part, -1 as supplier, o_custkey as customer, o_totalprice as amount, -1.0 as quantity, -1.0 as discount, -1.0 as tax, o_orderstatus || o_orderpriority as flags from orders
  union all select epoch_us(l_shipdate) // 1000, 'LineShipped', l_orderkey, l_linenumber, l_partkey, l_suppkey, -1, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag || l_linestatus from lineitem)""")
def append_positions(spark, sf_dir):
    return numbered(adapters.order_events(spark, sf_dir), adapters.ORDER).select("position", "name", "order_id", "amount")


@query("select event_id + 1 as position, event_type as name from events order by 1 desc limit 50 offset 50")
def page_unfiltered(spark, sf_dir):
    return reads.page_newest(adapters.activity(spark, sf_dir), None, 50, 2).select("position", "name")


@query("select event_id + 1 as position, event_type as name from events where event_type = 'click' order by 1 desc limit 20 offset 40")
def page_filtered(spark, sf_dir):
    return reads.page_newest(adapters.activity(spark, sf_dir), Condition.of(Criterion(("click",))), 20, 3).select("position", "name")


@query("select * from (select event_id + 1 as position from events where event_type = 'click' order by 1 limit 60) order by 1 desc limit 20 offset 40")
def page_filtered_as_served(spark, sf_dir):
    return reads.page_as_served(adapters.activity(spark, sf_dir), Condition.of(Criterion(("click",))), 20, 3).select("position")


@query("select event_id + 1 as position from events where event_id + 1 >= (select greatest(1, max(event_id) + 1 - 200 * 3 + 1) from events) and event_id + 1 < (select greatest(1, max(event_id) + 1 - 200 * 3 + 1) from events) + 200")
def page_unfiltered_as_served(spark, sf_dir):
    return reads.page_as_served(adapters.activity(spark, sf_dir), None, 500, 3).select("position")


@query("select count(*) as events, cast(ceil(count(*) / 50) as bigint) as pages from events")
def page_counts(spark, sf_dir):
    return reads.pages(adapters.activity(spark, sf_dir))


@query("select event_id + 1 as position, event_type as name from events where user_id = 8")
def stream_equals_batch(spark, sf_dir):
    """The log as files, followed by a stream to its end, filtered, into a table."""
    from .streaming.live import follow_files

    log = adapters.activity(spark, sf_dir)
    stored = written(log, "log")
    out, seen = stored.inputFiles()[0].rsplit("/", 1)[0] + "-followed", stored.inputFiles()[0].rsplit("/", 1)[0] + "-cursor"
    stream = follow_files(spark, stored.inputFiles()[0].rsplit("/", 1)[0], log.schema, Condition.of(_user(8)))
    stream.select("position", "name").writeStream.format("parquet").option("path", out).option("checkpointLocation", seen).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("position long, name string").parquet(out)


_SNAPSHOTS = "(select 'User-' || user_id as key, event_id + 1 as sequence, props as state from events where event_type = 'purchase')"


def _snapshots(spark, sf_dir) -> DataFrame:
    """A snapshot of its user at each purchase."""
    e = adapters.table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return e.select(F.concat(F.lit("User-"), "user_id").alias("key"), (F.col("event_id") + 1).alias("sequence"), F.col("props").alias("state"))


@query(f"select key, max(sequence) as sequence, arg_max(state, sequence) as state from {_SNAPSHOTS} group by key")
def snapshot_last(spark, sf_dir):
    return snapshots.last(_snapshots(spark, sf_dir))


@query(f"select * from {_SNAPSHOTS} where key = 'User-8' and sequence >= 100 and sequence < 5000")
def snapshot_list(spark, sf_dir):
    return snapshots.listed(_snapshots(spark, sf_dir), "User-8", 100, 5000)


@query(f"select * from {_SNAPSHOTS} where not (key = 'User-8' and sequence >= 0 and sequence < 4000)")
def snapshot_delete(spark, sf_dir):
    return snapshots.delete(_snapshots(spark, sf_dir), "User-8", 4000)


@query(f"""with s as {_SNAPSHOTS}, n as (select key, max(sequence) as top from s group by key)
  select s.key, sequence, case when sequence = top then 'new' else state end as state from s join n using (key) where sequence >= top
  union all select key, top + 1, 'newer' from n where false""")
def snapshot_prune(spark, sf_dir):
    """Each key's last snapshot written again, which replaces it and prunes those before."""
    s = _snapshots(spark, sf_dir)
    return snapshots.add(s, s.groupBy("key").agg(F.max("sequence").alias("sequence"), F.lit("new").alias("state")), prune=True)


@query(f"""select 'User-' || user_id as key, count(*) as events, min(event_id + 1) as first_position from events e
  left join (select key, max(sequence) as top from {_SNAPSHOTS} group by key) s on s.key = 'User-' || user_id where top is null or event_id + 1 > top group by 1""")
def snapshot_rehydrate(spark, sf_dir):
    log = adapters.table(spark, sf_dir, "events").select(F.concat(F.lit("User-"), "user_id").alias("user"), (F.col("event_id") + 1).alias("position"))
    return snapshots.rehydrated(_snapshots(spark, sf_dir), log, "user").groupBy(F.col("user").alias("key")).agg(F.count("*").alias("events"), F.min("position").alias("first_position"))


_HANDLERS = """(select 'Command' || (s_suppkey % 5) as message_type, s_name as client_id, n_name as component_name, case when s_suppkey % 4 = 0 then 100 else s_suppkey % 4 end as weight, s_suppkey as reg_seq,
  row_number() over (partition by s_suppkey % 5 order by s_suppkey) - 1 as place, count(*) over (partition by s_suppkey % 5) as handlers from supplier join nation on s_nationkey = n_nationkey)"""
_COMMANDS = """(select o_orderkey as arrival, 'Command' || (o_orderkey % 6) as name, case when o_orderkey % 2 = 0 then cast(o_custkey as varchar) end as routing_key,
  cast(trunc(o_totalprice) as bigint) as duration_us, case when o_orderstatus = 'F' then 'HANDLER_ERROR' else '' end as error_code from orders)"""


@query(f"""select arrival, name, routing_key, place, client_id from (select c.*, list_reduce(list_prepend(5381::hugeint, list_transform(string_split(routing_key, ''), lambda x: ascii(x)::hugeint)), lambda a, b: (a * 33 + b) % 18446744073709551616) as hash from {_COMMANDS} c where routing_key is not null) c
  join {_HANDLERS} h on h.message_type = c.name and h.place = c.hash % h.handlers""")
def route_by_key(spark, sf_dir):
    return bus.by_key(adapters.commands(spark, sf_dir), adapters.handlers(spark, sf_dir))


@query(f"""with h as (select *, sum(weight) over (partition by message_type order by reg_seq) as high, sum(weight) over (partition by message_type) as total from {_HANDLERS}),
  c as (select *, row_number() over (order by arrival) - 1 as counter from {_COMMANDS} where routing_key is null and name in (select message_type from h))
  select arrival, name, counter, client_id from c join h on h.message_type = c.name and counter % total < high and counter % total >= high - weight""")
def route_round_robin(spark, sf_dir):
    return bus.round_robin(adapters.commands(spark, sf_dir), adapters.handlers(spark, sf_dir))


@query()
def dispatch_with_permits(spark, sf_dir):
    """Four buses with thirty permits for each handler."""
    commands = adapters.commands(spark, sf_dir).withColumn("bus", (F.floor(F.col("arrival") / 4) % 4).cast("string"))
    handlers = adapters.handlers(spark, sf_dir)
    permits = handlers.select(F.explode(F.array(*[F.lit(str(k)) for k in range(4)])).alias("bus"), "client_id", F.lit(30).cast("long").alias("permits"))
    return bus.with_permits(commands, handlers, permits)


@query(f"select arrival, name from {_COMMANDS} where name not in (select message_type from {_HANDLERS})")
def no_handler(spark, sf_dir):
    return bus.no_handler(adapters.commands(spark, sf_dir), adapters.handlers(spark, sf_dir)).select("arrival", "name")


_QUERIES = "(select conv_id, turn, 'Command' || (conv_id % 6) as name from conversations)"


def _questions(spark, sf_dir) -> DataFrame:
    return adapters.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("Command"), F.col("conv_id") % 6).alias("name"))


@query(f"select conv_id, turn, name, client_id from {_QUERIES} q join {_HANDLERS} h on h.message_type = q.name")
def scatter_gather(spark, sf_dir):
    return bus.scatter(_questions(spark, sf_dir), adapters.handlers(spark, sf_dir)).select("conv_id", "turn", "name", "client_id")


@query(f"select conv_id, turn, name, client_id from {_QUERIES} q join {_HANDLERS} h on h.message_type = q.name and place = 0")
def point_to_point(spark, sf_dir):
    return bus.point_to_point(_questions(spark, sf_dir), adapters.handlers(spark, sf_dir)).select("conv_id", "turn", "name", "client_id")


@query("""select 'q' || l_orderkey as request_id, string_agg(l_linenumber || ':' || l_partkey, ',' order by l_linenumber, l_partkey) as answers from (select distinct l_orderkey, l_linenumber, l_partkey from lineitem where l_quantity <= 30) group by 1""")
def gather_answers(spark, sf_dir):
    li = adapters.table(spark, sf_dir, "lineitem")
    responses = li.select(F.concat(F.lit("q"), "l_orderkey").alias("request_id"), F.col("l_linenumber").alias("handler"), F.col("l_partkey").alias("answer"), F.col("l_quantity").alias("duration_us")).dropDuplicates(["request_id", "handler", "answer", "duration_us"]).where("duration_us <= 30").dropDuplicates(["request_id", "handler", "answer"])
    return bus.answers(responses, 30).select("request_id", F.concat_ws(",", F.transform("answers", lambda a: F.concat_ws(":", a["handler"].cast("string"), a["answer"].cast("string")))).alias("answers"))


@query(f"""select name, count(*) as dispatched, count(*) filter (error_code = '') as succeeded, count(*) filter (error_code <> '') as failed, sum(duration_us)::bigint as total_us, (sum(duration_us) // count(*))::bigint as avg_us, count(*) filter (error_code = '') * 100.0::double / count(*) as success_rate
  from {_COMMANDS} where name in (select message_type from {_HANDLERS}) group by name""")
def dispatch_metrics(spark, sf_dir):
    return bus.metrics(adapters.commands(spark, sf_dir), adapters.handlers(spark, sf_dir))


@query(f"select case when duration_us > 150000 then 'DEADLINE_EXCEEDED' when error_code = '' then 'OK' else error_code end as outcome, count(*) as n from {_COMMANDS} group by 1")
def dispatch_outcomes(spark, sf_dir):
    return bus.outcomes(adapters.commands(spark, sf_dir), 150_000).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"select message_type, count(*) as handlers, case when count(*) > 1 then 'scatter-gather' else 'point-to-point' end as mode from {_HANDLERS} group by 1")
def handler_stats(spark, sf_dir):
    return bus.handler_stats(adapters.handlers(spark, sf_dir))


@query(f"select 'a' as context, message_type, client_id from {_HANDLERS} union all select 'b', message_type, client_id from {_HANDLERS} where reg_seq % 2 = 0")
def aggregated_handlers(spark, sf_dir):
    h = adapters.handlers(spark, sf_dir)
    both = h.withColumn("context", F.lit("a")).unionByName(h.where("reg_seq % 2 = 0").withColumn("context", F.lit("b")))
    return both.select("context", "message_type", "client_id")


_ACTIVE = """(select 'sub-' || user_id as subscription_id, arg_max(epoch_us(ts) // 1000, event_id) as opened_at, max(event_id) as seq from events where event_type <> 'click' group by 1 having arg_max(event_type, event_id) in ('signup', 'view'))"""


@query(f"select * from {_ACTIVE}")
def active_subscriptions(spark, sf_dir):
    return registry.active_subscriptions(adapters.subscription_ops(spark, sf_dir))


@query(f"select a.subscription_id, e.event_id as seq from events e join {_ACTIVE} a on a.subscription_id = 'sub-' || e.user_id where e.event_type = 'click' and e.event_id > a.seq")
def deliver_updates(spark, sf_dir):
    ops = adapters.subscription_ops(spark, sf_dir)
    return registry.delivered(ops.where("op = 'update'"), registry.active_subscriptions(ops)).select("subscription_id", "seq")


_CLIENTS = "(select 'client-' || user_id as client_id, 'component-' || (user_id % 3) as component_name, arg_max(epoch_us(ts) // 1000, event_id) as last_heartbeat, (select max(epoch_us(ts) // 1000) from events) as now from events group by 1, 2)"


def _clients(spark, sf_dir):
    beats = adapters.heartbeats(spark, sf_dir)
    return registry.clients(beats), F.lit(beats.agg(F.max("at")).first()[0])


@query(f"select client_id, component_name, last_heartbeat, (now - last_heartbeat) // 1000 as age_s, case when (now - last_heartbeat) // 1000 > 15 then 'stale' when (now - last_heartbeat) // 1000 > 5 then 'slow' else 'healthy' end as health, case when (now - last_heartbeat) // 1000 > 15 then 'slow' else 'ok' end as overview from {_CLIENTS}")
def client_health(spark, sf_dir):
    return registry.health(*_clients(spark, sf_dir))


@query(f"select client_id from {_CLIENTS} where now - last_heartbeat > 36000000")
def reap_clients(spark, sf_dir):
    known, now = _clients(spark, sf_dir)
    return registry.dead(known, now, 36_000_000).select("client_id")


_SEGMENTS = """(select r_name as processor_name, n_name as client_id, n_nationkey % 7 <> 0 as running, s_suppkey as segment_id, (1 << (s_suppkey % 4))::bigint as one_part_of, s_suppkey * 3 as token_position, s_acctbal > 0 as caught_up, s_acctbal < -900 as replaying, s_acctbal > 9800 as failed
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""


@query(f"""select processor_name, count(distinct client_id) as instances, count(*) as segments, case when not bool_or(running) then 'stopped' when bool_or(failed) then 'error' when bool_or(replaying) then 'replaying' when bool_and(caught_up) then 'caught up' else 'behind' end as status,
  min(token_position) as low, max(token_position) as high from {_SEGMENTS} group by 1""")
def processor_status(spark, sf_dir):
    return registry.processors(adapters.segments(spark, sf_dir))


@query(f"select processor_name, arg_min(segment_id, one_part_of * 1000000000 + segment_id) as segment_id from {_SEGMENTS} group by 1")
def split_candidate(spark, sf_dir):
    return registry.split_candidate(adapters.segments(spark, sf_dir))


@query(f"select processor_name, arg_max(segment_id, one_part_of * 1000000000 + segment_id) as segment_id from {_SEGMENTS} group by 1")
def merge_candidate(spark, sf_dir):
    return registry.merge_candidate(adapters.segments(spark, sf_dir))


_OPS = "(select case when event_type in ('click', 'purchase') then 'append' else 'source' end as op, user_id % 5 as events, cast(trunc(value * 10) as bigint) as duration_us, event_id % 3 = 0 as hit, event_id % 11 = 0 as rejected from events)"


@query(f"""with a as (select count(*) filter (op = 'append') as appends, sum(case when op = 'append' then events else 0 end)::bigint as events_appended, count(*) filter (op = 'append' and rejected) as dcb_violations, count(*) filter (op = 'source') as source_queries,
   sum(case when op = 'append' then duration_us else 0 end)::bigint as append_us, sum(case when op = 'source' then duration_us else 0 end)::bigint as source_us, count(*) filter (op = 'source' and hit) as cache_hits from {_OPS})
  select *, append_us // appends as avg_append_us, source_us // source_queries as avg_source_us, cache_hits * 100.0::double / source_queries as hit_rate, dcb_violations * 100.0::double / appends as violation_rate from a""")
def store_metrics_rates(spark, sf_dir):
    e = adapters.table(spark, sf_dir, "events")
    ops = e.select(F.when(F.col("event_type").isin("click", "purchase"), "append").otherwise("source").alias("op"), (F.col("user_id") % 5).alias("events"), (F.col("value") * 10).cast("long").alias("duration_us"), (F.col("event_id") % 3 == 0).alias("hit"), (F.col("event_id") % 11 == 0).alias("rejected"))
    return report.counters(ops)


@query("select count(*) as events, count(*) * 1000.0::double / (max(epoch_us(ts) // 1000) - min(epoch_us(ts) // 1000)) as per_second from events")
def throughput(spark, sf_dir):
    return report.throughput(adapters.activity(spark, sf_dir))


@query("""select o_orderkey as id, case when n >= 1000000 then printf('%.2fM', n / 1000000.0::double) when n >= 10000 then printf('%.1fK', n / 1000.0::double) else format('{:,}', n) end as text from (select o_orderkey, cast(trunc(o_totalprice) as bigint) * (o_orderkey % 10) as n from orders)""")
def format_numbers(spark, sf_dir):
    o = adapters.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), formats.number(F.col("o_totalprice").cast("long") * (F.col("o_orderkey") % 10)).alias("text"))


@query("""select o_orderkey as id, case when n >= 1073741824 then printf('%.1f GB', n / 1073741824.0::double) when n >= 1048576 then printf('%.0f MB', n / 1048576.0::double) when n >= 1024 then printf('%.0f KB', n / 1024.0::double) else n || ' B' end as text from (select o_orderkey, cast(trunc(o_totalprice) as bigint) * (o_orderkey % 3) * (o_orderkey % 1000) as n from orders)""")
def format_bytes(spark, sf_dir):
    o = adapters.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), formats.size(F.col("o_totalprice").cast("long") * (F.col("o_orderkey") % 3) * (F.col("o_orderkey") % 1000)).alias("text"))


@query("select event_id as id, strftime(ts, '%Y-%m-%d %H:%M:%S.') || lpad(cast((epoch_us(ts) // 1000) % 1000 as varchar), 3, '0') as text from events")
def format_timestamps(spark, sf_dir):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return adapters.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), formats.timestamp(adapters.millis("ts")).alias("text"))


@query("""with s as (select event_id as id, event_id * 37 as s from events), u as (select id, s // 86400 as d, s // 3600 % 24 as h, s // 60 % 60 as m, s % 60 as s from s)
  select id, case when d > 0 then printf('%dd %dh %dm %ds', d, h, m, s) when h > 0 then printf('%dh %dm %ds', h, m, s) when m > 0 then printf('%dm %ds', m, s) else printf('%ds', s) end as up,
   case when d > 0 then printf('%dd %dh ago', d, h) when h > 0 then printf('%dh %dm ago', h, m) when m > 0 then printf('%dm %ds ago', m, s) else printf('%ds ago', s) end as ago,
   case when d > 0 then printf('%dd %dh %dm', d, h, m) when h > 0 then printf('%dh %dm', h, m) when m > 0 then printf('%dm %ds', m, s) else printf('%ds', s) end as connected from u""")
def format_durations(spark, sf_dir):
    s = F.col("event_id") * 37
    return adapters.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), formats.uptime(s).alias("up"), formats.ago(s).alias("ago"), formats.connected(s).alias("connected"))


@query("select conv_id, turn, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') as escaped, replace(replace(replace(text, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n') as json from conversations")
def escapes(spark, sf_dir):
    return adapters.table(spark, sf_dir, "conversations").select("conv_id", "turn", formats.html_escape(F.col("text")).alias("escaped"), formats.json_escape(F.col("text")).alias("json"))


@query("select event_id as id, case when event_id % 2 = 0 then props else 'ff' || lower(hex(props)) || '...' end as text from events")
def payload_preview(spark, sf_dir):
    e = adapters.table(spark, sf_dir, "events")
    raw = F.encode("props", "UTF-8")
    return e.select(F.col("event_id").alias("id"), formats.preview(F.when(F.col("event_id") % 2 == 0, raw).otherwise(F.concat(F.lit(bytearray(b"\xff")), raw))).alias("text"))


@query("select event_id as id, '{' || chr(10) || '  \"k\": ' || " + _K + " || chr(10) || '}' as text from events")
def payload_pretty(spark, sf_dir):
    return adapters.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), formats.pretty_json(F.col("props")).alias("text"))


@query("select s_suppkey as peer_id, 'host-' || s_suppkey || ':80=' || s_nationkey as address from supplier")
def parse_peers(spark, sf_dir):
    s = adapters.table(spark, sf_dir, "supplier").select(F.concat("s_suppkey", F.lit("=host-"), "s_suppkey", F.lit(":80="), "s_nationkey", F.lit(",bad,x=y")).alias("text"))
    return s.select(F.explode(formats.peers(F.col("text"))).alias("p")).select(F.col("p.id").alias("peer_id"), "p.address")


@query("select * from (values " + ", ".join(f"({c}, '{n}')" for c, n in formats.ERROR_CODES) + ") t(code, name)")
def error_codes(spark, sf_dir):
    return spark.createDataFrame(list(formats.ERROR_CODES), "code int, name string")


@query("select n_name as name, regexp_full_match(n_name, '[A-Za-z0-9_-]{1,128}') as valid from nation union all select r_name || ' x', false from region")
def context_names(spark, sf_dir):
    n, r = adapters.table(spark, sf_dir, "nation"), adapters.table(spark, sf_dir, "region")
    return n.select(F.col("n_name").alias("name")).union(r.select(F.concat("r_name", F.lit(" x")))).select("name", F.col("name").rlike("^[A-Za-z0-9_-]{1,128}$").alias("valid"))


_LIFECYCLE = """(select event_id as seq, epoch_us(ts) // 1000 as at, case event_type when 'error' then 'unregister' when 'signup' then 'remove_client' else 'register' end as op, 'Type' || (event_id % 7) as message_type, 'client-' || user_id as client_id from events)"""


def _lifecycle(spark, sf_dir) -> DataFrame:
    """Events as a log of handlers: clicks, views and purchases register, errors take one type back, signups remove the client."""
    e = adapters.table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", "unregister").when(F.col("event_type") == "signup", "remove_client").otherwise("register")
    return e.select(F.col("event_id").alias("seq"), adapters.millis("ts").alias("at"), op.alias("op"), F.concat(F.lit("Type"), F.col("event_id") % 7).alias("message_type"), F.concat(F.lit("client-"), "user_id").alias("client_id"), F.concat(F.lit("component-"), F.col("user_id") % 3).alias("component_name"), (F.col("user_id") % 4).alias("load_factor"))


@query(f"""select r.message_type, r.client_id, r.seq as reg_seq from {_LIFECYCLE} r where op = 'register'
  and not exists (select 1 from {_LIFECYCLE} u where u.seq > r.seq and u.client_id = r.client_id and (u.op = 'remove_client' or u.op = 'unregister' and u.message_type = r.message_type))""")
def live_handlers(spark, sf_dir):
    return registry.handlers(_lifecycle(spark, sf_dir)).select("message_type", "client_id", "reg_seq")


@query("""select 'client-' || user_id as client_id, arg_max(epoch_us(ts) // 1000, event_id) as connected_at from events group by 1 having arg_max(event_type, event_id) <> 'error'""")
def connected_clients(spark, sf_dir):
    ops = _lifecycle(spark, sf_dir)
    return registry.connected(ops.withColumn("op", F.when(F.col("op") == "unregister", "unregister").otherwise("register"))).select("client_id", "connected_at")


_SUBSCRIBED = """(select event_id as seq, epoch_us(ts) // 1000 as at_ms, case event_type when 'error' then 'cancel' when 'purchase' then 'complete' when 'signup' then 'remove_client' else 'open' end as op, 'sub-' || (event_id % 301) as subscription_id, 'client-' || user_id as client_id, 'client-' || (event_id * 7 % 90) as handler_client_id from events)"""


def _subscribed(spark, sf_dir) -> DataFrame:
    e = adapters.table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", "cancel").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "signup", "remove_client").otherwise("open")
    return e.select(F.col("event_id").alias("seq"), adapters.millis("ts").alias("at"), op.alias("op"), F.concat(F.lit("sub-"), F.col("event_id") % 301).alias("subscription_id"), F.concat(F.lit("client-"), "user_id").alias("client_id"), F.concat(F.lit("client-"), F.col("event_id") * 7 % 90).alias("handler_client_id"))


_OPEN = f"""(select o.* from (select subscription_id, arg_max(op, seq) as op, arg_max(client_id, seq) as client_id, arg_max(handler_client_id, seq) as handler_client_id, arg_max(at_ms, seq) as opened_at, max(seq) as seq from {_SUBSCRIBED} where op <> 'remove_client' group by 1) o
  where op = 'open' and not exists (select 1 from {_SUBSCRIBED} r where r.op = 'remove_client' and r.seq > o.seq and r.client_id in (o.client_id, o.handler_client_id)))"""


@query(f"select subscription_id, client_id, handler_client_id, opened_at, seq from {_OPEN}")
def subscriptions_of_clients(spark, sf_dir):
    return registry.subscriptions(_subscribed(spark, sf_dir))


@query(f"select count(*) as active, coalesce(max(((select max(epoch_us(ts) // 1000) from events) - opened_at) // 1000), 0)::bigint as oldest_s from {_OPEN}")
def subscription_stats(spark, sf_dir):
    ops = _subscribed(spark, sf_dir)
    return registry.subscription_stats(registry.subscriptions(ops), F.lit(ops.agg(F.max("at")).first()[0]))


@query(f"""select subscription_id, row_number() over (partition by subscription_id order by seq) as nth, seq < 0 as initial, payload from (
  select subscription_id, 'initial ' || subscription_id as payload, -1 as seq from {_ACTIVE}
  union all select a.subscription_id, e.props, e.event_id from events e join {_ACTIVE} a on a.subscription_id = 'sub-' || e.user_id where e.event_type = 'click' and e.event_id > a.seq)""")
def initial_and_updates(spark, sf_dir):
    ops = adapters.subscription_ops(spark, sf_dir)
    active = registry.active_subscriptions(ops)
    updates = adapters.table(spark, sf_dir, "events").where("event_type = 'click'").select(F.concat(F.lit("sub-"), "user_id").alias("subscription_id"), F.col("event_id").alias("seq"), F.col("props").alias("payload"))
    answers = active.select("subscription_id", F.concat(F.lit("initial "), "subscription_id").alias("payload"))
    return registry.with_initial(answers, updates, active)


@query("""with recursive o as (select user_id, event_id as seq, event_type in ('signup', 'purchase') as given, user_id % 3 + 1 as n, row_number() over (partition by user_id order by event_id) as k from events),
  f as (select user_id, k, seq, given, (case when given then n else 0 end)::bigint as after, false as acquired from o where k = 1
    union all select o.user_id, o.k, o.seq, o.given, (case when o.given then f.after + o.n else greatest(0, f.after - 1) end)::bigint, not o.given and f.after > 0 from f join o on o.user_id = f.user_id and o.k = f.k + 1)
  select 'client-' || user_id as client_id, seq, after as "left", acquired from f where not given""")
def permits_of_clients(spark, sf_dir):
    """Signups and purchases grant permits to their user's client, every other event acquires one."""
    e = adapters.table(spark, sf_dir, "events")
    ops = e.select(F.concat(F.lit("client-"), "user_id").alias("client_id"), F.when(F.col("event_type").isin("signup", "purchase"), "grant").otherwise("acquire").alias("op"), (F.col("user_id") % 3 + 1).alias("permits"), F.col("event_id").alias("seq"))
    return registry.permits(ops, ["client_id"])


def _granted(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations' turns as queries in order; each handler has five permits at first and seven more from the 90th on."""
    asked = numbered(adapters.table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id", "turn"], "arrival").select("arrival", F.concat(F.lit("Command"), F.col("conv_id") % 6).alias("name"))
    own = adapters.handlers(spark, sf_dir)
    grants = own.select("client_id", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("arrival"), F.lit(5).alias("permits")), F.struct(F.lit(90).cast("long").alias("arrival"), F.lit(7).alias("permits")))).alias("g")).select("client_id", "g.permits", "g.arrival")
    return asked, own, grants


_ASKED = """(select row_number() over (order by conv_id, turn) as arrival, 'Command' || (conv_id % 6) as name from conversations)"""


@query(f"""with q as (select *, row_number() over (partition by name order by arrival) as k, count(*) filter (arrival < 90) over (partition by name) as early from {_ASKED}),
  g as (select q.arrival, q.name, h.client_id, case when q.arrival < 90 then k <= 5 else k - early <= greatest(0, 5 - early) + 7 end as got from q join {_HANDLERS} h on h.message_type = q.name)
  select arrival, name, 'DISPATCHED' as outcome, client_id from g where got union all select arrival, name, 'NO_PERMITS', '' from g group by 1, 2 having not bool_or(got)
  union all select arrival, name, 'NO_HANDLER', '' from q where name not in (select message_type from {_HANDLERS})""")
def scatter_with_permits(spark, sf_dir):
    return bus.scatter_with_permits(*_granted(spark, sf_dir))


@query()
def first_with_permit(spark, sf_dir):
    return bus.first_with_permit(*_granted(spark, sf_dir))


_REPORTED = """(select event_id as seq, 'proc-' || (event_id % 5) as processor_name, 'client-' || user_id as client_id, 'store-' || (user_id % 2) as token_store_identifier, case when event_id % 4 = 0 then 'subscribing' else 'tracking' end as mode, event_id % 9 as active_threads from events where event_type <> 'error')"""


@query(f"""with l as (select processor_name, client_id, max(seq) as seq, arg_max(token_store_identifier, seq) as token_store_identifier, arg_max(mode, seq) as mode, arg_max(active_threads, seq) as active_threads from {_REPORTED} group by 1, 2),
  k as (select * from l where not exists (select 1 from events e where e.event_type = 'error' and 'client-' || e.user_id = l.client_id and e.event_id > l.seq))
  select processor_name, token_store_identifier, arg_min(mode, seq) as mode, count(*) as instances, string_agg(client_id, ',' order by client_id) as clients, sum(active_threads)::bigint as active_threads from k group by 1, 2""")
def aggregated_processors(spark, sf_dir):
    """Reports of processors; an error removes its user's client."""
    e = adapters.table(spark, sf_dir, "events")
    client = F.concat(F.lit("client-"), "user_id").alias("client_id")
    log = e.where("event_type <> 'error'").select(F.col("event_id").alias("seq"), F.concat(F.lit("proc-"), F.col("event_id") % 5).alias("processor_name"), client, F.concat(F.lit("store-"), F.col("user_id") % 2).alias("token_store_identifier"), F.when(F.col("event_id") % 4 == 0, "subscribing").otherwise("tracking").alias("mode"), (F.col("event_id") % 9).alias("active_threads"))
    removed = e.where("event_type = 'error'").select(client, F.col("event_id").alias("seq"))
    return registry.aggregated(registry.reports(log, removed)).withColumn("clients", F.concat_ws(",", "clients"))


_STORE_OPS = """(select case user_id % 6 when 0 then 'append' when 1 then 'source' when 2 then 'index_read' when 3 then 'bloom_check' when 4 then 'map_read' else 'rotation' end as op, user_id % 5 as events, cast(trunc(value * 10) as bigint) as duration_us, event_id % 3 = 0 as hit, event_id % 11 = 0 as rejected, event_id % 2 = 0 as seek from events)"""


@query(f"""with a as (select count(*) filter (op = 'append' and not rejected) as appends, coalesce(sum(events) filter (op = 'append' and not rejected), 0)::bigint as events_appended, count(*) filter (op = 'append' and rejected) as dcb_violations, coalesce(sum(duration_us) filter (op = 'append' and not rejected), 0)::bigint as append_duration_us,
    count(*) filter (op = 'source') as source_queries, coalesce(sum(events) filter (op = 'source'), 0)::bigint as events_sourced, coalesce(sum(duration_us) filter (op = 'source'), 0)::bigint as source_duration_us,
    count(*) filter (op = 'index_read' and hit) as index_cache_hits, count(*) filter (op = 'index_read' and not hit) as index_cache_misses, count(*) filter (op = 'bloom_check') as bloom_checks, count(*) filter (op = 'bloom_check' and rejected) as bloom_rejections,
    count(*) filter (op = 'map_read' and hit) as mmap_cache_hits, count(*) filter (op = 'map_read' and not hit) as mmap_cache_misses, count(*) filter (op = 'rotation') as segment_rotations, count(*) filter (op = 'source' and seek) as direct_seek_reads, count(*) filter (op = 'source' and not seek) as sequential_scan_reads from {_STORE_OPS})
  select *, coalesce(index_cache_hits * 100.0::double / nullif(index_cache_hits + index_cache_misses, 0), 0) as index_cache_hit_rate, coalesce(bloom_rejections * 100.0::double / nullif(bloom_checks, 0), 0) as bloom_rejection_rate,
    coalesce(mmap_cache_hits * 100.0::double / nullif(mmap_cache_hits + mmap_cache_misses, 0), 0) as mmap_cache_hit_rate, coalesce(direct_seek_reads * 100.0::double / nullif(direct_seek_reads + sequential_scan_reads, 0), 0) as direct_seek_rate from a""")
def store_counters(spark, sf_dir):
    e = adapters.table(spark, sf_dir, "events")
    kinds = F.array(*map(F.lit, ("append", "source", "index_read", "bloom_check", "map_read", "rotation")))
    ops = e.select(F.get(kinds, (F.col("user_id") % 6).cast("int")).alias("op"), (F.col("user_id") % 5).alias("events"), (F.col("value") * 10).cast("long").alias("duration_us"), (F.col("event_id") % 3 == 0).alias("hit"), (F.col("event_id") % 11 == 0).alias("rejected"), (F.col("event_id") % 2 == 0).alias("seek"))
    return report.store_counters(ops)


@query("select 'nobody' as key, 0::bigint as sequence, '' as state")
def snapshot_of_nobody(spark, sf_dir):
    return snapshots.get_last(_snapshots(spark, sf_dir), "nobody")


@query(f"select key, max(sequence) as sequence, arg_max(state, sequence) as state from {_SNAPSHOTS} where key = 'User-8' group by 1")
def snapshot_stored_last(spark, sf_dir):
    """From a stored table of snapshots, of which the key's bucket alone is read."""
    path = written(_snapshots(spark, sf_dir), "snapshots").inputFiles()[0].rsplit("/", 1)[0] + "-stored"
    snapshots.write(_snapshots(spark, sf_dir), path)
    return snapshots.get_last(snapshots.read(spark, path, "User-8"), "User-8")


@query("select event_id + 1 as position, event_id as row_index from events")
def scan_with_offsets(spark, sf_dir):
    return reads.with_offsets(spark, f"{sf_dir}/events.parquet").select((F.col("event_id") + 1).alias("position"), "row_index")


@query(f"select {_EVENT} from events where event_type = 'click' and event_id >= (select min(event_id) from events where epoch_us(ts) // 1000 >= 1704200000000)")
def replay_since_time(spark, sf_dir):
    return flat(reads.source_since(adapters.activity(spark, sf_dir), Condition.of(Criterion(("click",))), 1704200000000))


def _stored_index(spark, sf_dir) -> str:
    """A folder with the postings of the first half of the segments, as an earlier run left them."""
    log = adapters.activity(spark, sf_dir)
    half = (log.agg(F.max("position")).first()[0] or 0) // SEGMENT // 2
    path = written(log.select("position").limit(1), "index").inputFiles()[0].rsplit("/", 1)[0] + "-postings"
    postings.write(postings.build(log, SEGMENT).where(F.col("segment") < half), path)
    return path


@query(f"select segment, fkey, count(*) as positions, min(position) as low, max(position) as high from {_POSTINGS} group by all")
def postings_rebuild(spark, sf_dir):
    """Stored postings, loaded, and those of the segments that had none."""
    log, stored = adapters.activity(spark, sf_dir), postings.read(spark, _stored_index(spark, sf_dir))
    every = stored.unionByName(postings.build(postings.unindexed(log, stored, SEGMENT), SEGMENT))
    return every.groupBy("segment", "fkey").agg(F.count("*").alias("positions"), F.min("position").alias("low"), F.max("position").alias("high"))


@query(f"select {_EVENT} from events where (user_id = 8 or (event_type = 'click' and {_K} = '7')) and event_id // {SEGMENT} < (select max(event_id + 1) // {SEGMENT} // 2 from events)")
def source_stored_postings(spark, sf_dir):
    """By a stored index, whose row groups are skipped by their key's range and bloom filter."""
    stored = postings.read(spark, _stored_index(spark, sf_dir))
    return flat(postings.source(adapters.activity(spark, sf_dir), stored, Condition.of(_user(8), Criterion.of(("click",), k="7"))))


@query("select event_id + 1 as position, event_type as name from events where user_id = 8 and event_id + 1 >= 50")
def subscription_by_position(spark, sf_dir):
    """The log appended to a store, and a subscription that starts at a position and ends with what is there."""
    from .sources.log import Store
    from .streaming.live import subscribe

    root = written(adapters.activity(spark, sf_dir).limit(1), "store").inputFiles()[0].rsplit("/", 1)[0] + "-contexts"
    log = Store(spark, root).create("activity")
    log.append(adapters.activity(spark, sf_dir).drop("context").withColumnRenamed("position", "seq"))
    rows = subscribe(spark, log.path, Condition.of(_user(8)), 50).select("position", "name")
    rows.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cursor").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("position long, name string").parquet(f"{root}/out")
