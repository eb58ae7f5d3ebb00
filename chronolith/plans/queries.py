"""The queries over derived operation logs, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..caps import Caps
from ..operators import batch, compaction, metrics, resolve
from ..sources import log
from ..sources.files import Files, scratch_dir
from ..sources.store import Store
from ..status import Status
from .logs import EVENT_SQL, ORDER_SQL, event_ops, order_ops, view_sql

#: Bounds and keys that the queries use.
LO, HI, PROBE = "0000000020", "0000000090", "0000000050"
GROUP, FLUSH = 25, 500  # batches in a group; sequences in a flushed segment
RECORD_LIMIT, BUSY_LIMIT = 100, 2000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str, log: str = EVENT_SQL):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"with {log.strip()}{sql}"
        return f

    return add


def _log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return batch.normalise(event_ops(spark, sf_dir))


def _top(spark: SparkSession, sf_dir: str) -> int:
    """The current sequence: the count of events tells it, as event ids are dense."""
    return (spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("event_id")).first()[0] or 0) // 4 + 1


def _middle(spark: SparkSession, sf_dir: str) -> int:
    return max(1, _top(spark, sf_dir) // 2)


TOP, MID = "(select max(event_id) // 4 + 1 from events)", "(select greatest(1, (max(event_id) // 4 + 1) // 2) from events)"


@query(f",{view_sql('a')} select k, seq, v from a")
def kv_scan_latest(spark, sf_dir):
    return resolve.resolve(*_log(spark, sf_dir))


@query(f",{view_sql('a', MID)} select k, seq, v from a")
def kv_scan_at_seq(spark, sf_dir):
    return resolve.resolve(*_log(spark, sf_dir), _middle(spark, sf_dir))


@query(f",{view_sql('a')} select k, v from a where k >= '{LO}' and k < '{HI}'")
def kv_scan_bounded(spark, sf_dir):
    return resolve.scan(*_log(spark, sf_dir), None, LO, HI)


@query(f",{view_sql('a')} select k, v from a order by k desc limit 10")
def kv_scan_reverse_top(spark, sf_dir):
    return resolve.scan(*_log(spark, sf_dir), reverse=True).limit(10)


@query(f",{view_sql('a')}, w as (select distinct lpad((user_id * 3)::varchar, 10, '0') as k from events) select w.k, a.k is not null as found, a.v from w left join a on w.k = a.k")
def kv_multi_get(spark, sf_dir):
    wanted = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.lpad((F.col("user_id") * 3).cast("string"), 10, "0").alias("k")).distinct()
    return resolve.multi_get(*_log(spark, sf_dir), wanted)


@query(f",{view_sql('a')}, w as (select distinct lpad(user_id::varchar, 10, '0') as k from events) select w.k from w left join a on w.k = a.k where a.k is null")
def kv_get_missing(spark, sf_dir):
    users = event_users(spark, sf_dir)
    return resolve.multi_get(*_log(spark, sf_dir), users).where("not found").select("k")


def event_users(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.lpad(F.col("user_id").cast("string"), 10, "0").alias("k")).distinct()


@query(f",{view_sql('a')} select k, v from a where k = '{PROBE}'")
def kv_get(spark, sf_dir):
    return resolve.get(*_log(spark, sf_dir), PROBE).select("k", "v")


@query(f",{view_sql('a')} select 'first' as place, k, v from a where k = (select min(k) from a) union all select 'last', k, v from a where k = (select max(k) from a)")
def kv_first_last(spark, sf_dir):
    view = resolve.resolve(*_log(spark, sf_dir)).select("k", "v")
    place = lambda df, name: df.select(F.lit(name).alias("place"), "k", "v")
    return place(resolve.first(view), "first").union(place(resolve.last(view), "last"))


@query(f",{view_sql('a')} select k, v from a where k >= '{PROBE}' order by k limit 1")
def kv_seek_ge(spark, sf_dir):
    return resolve.seek_ge(resolve.resolve(*_log(spark, sf_dir), lo=PROBE).select("k", "v"), PROBE)


@query(f",{view_sql('a')} select k, v from a where k < '{PROBE}' order by k desc limit 1")
def kv_seek_lt(spark, sf_dir):
    return resolve.seek_lt(resolve.resolve(*_log(spark, sf_dir), hi=PROBE).select("k", "v"), PROBE)


@query(f",{view_sql('a')} select k, lead(k) over (order by k) as next_k, lag(k) over (order by k) as prev_k from a")
def kv_next_prev(spark, sf_dir):
    return resolve.neighbours(resolve.resolve(*_log(spark, sf_dir)))


@query(f",{view_sql('a')} select k, v from a where k > '{LO}' order by k limit 7")
def kv_page(spark, sf_dir):
    return resolve.page(resolve.resolve(*_log(spark, sf_dir), lo=LO).select("k", "v"), 7, LO)


@query(" select k, seq, vt, v from v")
def kv_batch_normalised(spark, sf_dir):
    return batch.batch_versions(event_ops(spark, sf_dir)).withColumn("vt", F.col("vt").cast("int"))


@query(" select lo, hi, seq from r")
def kv_batch_ranges(spark, sf_dir):
    return batch.batch_ranges(event_ops(spark, sf_dir))


_BYTES = "(5 + 10 + case kind when 'S' then 4 + length(val) when 'R' then 4 + 10 else 0 end)"


@query(f" select seq, count(*) as n_ops, sum({_BYTES})::bigint + 13 as record_bytes from ops group by seq")
def kv_batch_bytes(spark, sf_dir):
    return batch.batch_bytes(event_ops(spark, sf_dir))


@query(" , u as (select distinct lpad(user_id::varchar, 10, '0') as k from events) select u.k, coalesce(max(r.seq), 0)::bigint as c from u left join r on r.lo <= u.k and u.k < r.hi group by u.k")
def kv_cover(spark, sf_dir):
    return resolve.cover(event_users(spark, sf_dir), _log(spark, sf_dir)[1])


@query(f", n as (select * from v qualify row_number() over (partition by k order by seq desc) = 1) select n.k, n.seq, max(r.seq) as range_seq from n join r on r.seq > n.seq and r.lo <= n.k and n.k < r.hi where n.vt = 1 group by n.k, n.seq")
def kv_range_hidden(spark, sf_dir):
    versions, ranges = _log(spark, sf_dir)
    top = resolve.newest(versions).where("vt = 1").select("k", "seq")
    return resolve.cover(top, ranges).where("c > seq").withColumnRenamed("c", "range_seq")


@query(f", r2 as (select lo, hi, seq from r union all select '', '{PROBE}', {TOP} + 1), n as (select * from v qualify row_number() over (partition by k order by seq desc) = 1) select k, seq, v from n where vt = 1 and not exists (select 1 from r2 where r2.seq > n.seq and r2.lo <= n.k and n.k < r2.hi)")
def kv_range_delete_visible(spark, sf_dir):
    versions, ranges = _log(spark, sf_dir)
    more = spark.range(1).select(F.lit("").alias("lo"), F.lit(PROBE).alias("hi"), F.lit(_top(spark, sf_dir) + 1).cast("bigint").alias("seq"))
    return resolve.resolve(versions, ranges.unionByName(more))


@query(f", r2 as (select lo, hi, seq from r union all select '', null, {TOP} + 1), n as (select * from v qualify row_number() over (partition by k order by seq desc) = 1) select count(*) as n_visible from n where vt = 1 and not exists (select 1 from r2 where r2.seq > n.seq and r2.lo <= n.k and (r2.hi is null or n.k < r2.hi))")
def kv_clear_all(spark, sf_dir):
    versions, ranges = _log(spark, sf_dir)
    none = F.lit(None).cast("string")
    every = spark.range(1).select(F.lit("").alias("lo"), none.alias("hi"), F.lit(_top(spark, sf_dir) + 1).cast("bigint").alias("seq"))
    return resolve.resolve(versions, ranges.unionByName(every)).agg(F.count("*").alias("n_visible"))


@query(f",{view_sql('a')} select count(*) as n_keys, coalesce(sum(length(k) + length(v)), 0)::bigint as live_bytes from a")
def kv_live_bytes(spark, sf_dir):
    return resolve.live_bytes(resolve.resolve(*_log(spark, sf_dir)))


@query(" select k, seq, vt, v, row_number() over (partition by k order by seq desc) - 1 as age from v")
def kv_version_history(spark, sf_dir):
    h = resolve.history(_log(spark, sf_dir)[0])
    return h.withColumn("vt", F.col("vt").cast("int")).withColumn("age", F.col("age").cast("bigint"))


@query(f",{view_sql('a', MID)},{view_sql('b')} select coalesce(a.k, b.k) as k, case when a.k is null then 'added' when b.k is null then 'removed' else 'changed' end as change, a.v as old_v, b.v as new_v from a full join b on a.k = b.k where a.v is distinct from b.v")
def kv_diff_two_snapshots(spark, sf_dir):
    versions, ranges = _log(spark, sf_dir)
    return resolve.diff(resolve.resolve(versions, ranges, _middle(spark, sf_dir)), resolve.resolve(versions, ranges))


_KEEP = f",{view_sql('a', MID)},{view_sql('b')}, need as (select k, seq from a union select k, seq from b), lab as (select v.*, case when vt = 1 then exists (select 1 from need where need.k = v.k and need.seq = v.seq) else v.seq > {MID} end as keep from v)"


def _observed(spark, sf_dir) -> list[int]:
    return compaction.observable([_middle(spark, sf_dir)], _top(spark, sf_dir))


@query(f"{_KEEP} select k, seq, vt, v from lab where keep")
def kv_compact_keep(spark, sf_dir):
    return compaction.kept(*_log(spark, sf_dir), _observed(spark, sf_dir)).withColumn("vt", F.col("vt").cast("int"))


@query(f"{_KEEP} select k, seq, vt from lab where not keep")
def kv_compact_dropped(spark, sf_dir):
    return compaction.dropped(*_log(spark, sf_dir), _observed(spark, sf_dir)).select("k", "seq", F.col("vt").cast("int").alias("vt"))


@query(f" select lo, hi, seq from r where seq > {MID}")
def kv_tombstone_gc(spark, sf_dir):
    return compaction.kept_ranges(_log(spark, sf_dir)[1], _observed(spark, sf_dir))


@query(f"{_KEEP} select count(*) as consumed, count_if(keep)::bigint as emitted, count_if(not keep)::bigint as dropped, count_if(keep and vt = 0)::bigint as deletions_kept, (select count_if(seq > {MID})::bigint from r) as ranges_kept, (select count_if(seq <= {MID})::bigint from r) as ranges_dropped from lab")
def kv_compact_stats(spark, sf_dir):
    return compaction.stats(*_log(spark, sf_dir), _observed(spark, sf_dir))


_SEG = f", seg as (select (seq - 1) // {FLUSH} as segment, count(*) as entries, count_if(vt = 0)::bigint as deletions, min(k) as min_k, max(k) as max_k, min(seq) as min_seq, max(seq) as max_seq from v group by 1)"


def _segments(spark, sf_dir):
    return metrics.segment_facts(_log(spark, sf_dir)[0].withColumn("segment", F.expr(f"(seq - 1) div {FLUSH}")), "segment")


@query(f"{_SEG} select * from seg")
def kv_flush_segments(spark, sf_dir):
    return _segments(spark, sf_dir)


@query(f"{_SEG} select x.segment as a, y.segment as b from seg x join seg y on x.segment < y.segment and x.min_k <= y.max_k and y.min_k <= x.max_k")
def kv_level_overlap(spark, sf_dir):
    """Pairs of segments whose bounds meet, by the rule with which a compaction chooses its inputs."""
    facts = log.facts(_log(spark, sf_dir)[0].withColumn("segment", F.expr(f"(seq - 1) div {FLUSH}")), "versions", "segment")
    segments = sorted((int(name), log.Segment(name, "versions", log.FLUSHED, **f, bytes=0)) for name, f in facts.items())
    pairs = [(a, b) for i, (a, x) in enumerate(segments) for b, y in segments[i + 1 :] if x.overlaps(y)]
    return spark.createDataFrame(pairs, "a bigint, b bigint")


@query(f" select (seq - 1) // {GROUP} as grp, max(seq) as durable_seq, count(distinct seq) as n_batches, count(*) as n_ops from ops group by 1")
def kv_group_watermark(spark, sf_dir):
    ops = event_ops(spark, sf_dir).withColumn("grp", F.expr(f"(seq - 1) div {GROUP}"))
    return batch.group_facts(ops, "grp").select("grp", "durable_seq", "n_batches", "n_ops")


_CLOSED = f"(select (max(event_id) // 4 + 1) // {GROUP} * {GROUP} from events)"


@query(f",{view_sql('a', _CLOSED)} select k, seq, v from a")
def kv_recovered_state(spark, sf_dir):
    """The whole groups of the log are written to a store and synced, the rest is written only; then it is opened anew."""
    path, ops = scratch_dir(spark), event_ops(spark, sf_dir)
    closed = _top(spark, sf_dir) // GROUP * GROUP
    gib = 1 << 30
    store = Store.open(spark, path, Caps(gib, 2 * gib, 0, 0))
    store.write_log(ops.where(F.col("seq") <= closed))
    store.sync()
    store.write_log(ops.where(F.col("seq") > closed).withColumn("seq", F.col("seq") - closed))
    store.close()
    view = Store.open(spark, path, read_only=True).view().frame()
    Files(spark).delete_on_exit(path)
    return view.select(F.col("k").cast("string").alias("k"), "seq", F.col("v").cast("string").alias("v"))


@query(f", b as (select seq, sum({_BYTES})::bigint + 13 as record_bytes from ops group by seq), o as (select *, sum(record_bytes) over (partition by (seq - 1) // {GROUP} order by seq)::bigint as owed from b) select seq, record_bytes, owed, record_bytes > {RECORD_LIMIT} as too_large, record_bytes <= {RECORD_LIMIT} and owed > {BUSY_LIMIT} as busy from o")
def kv_backpressure(spark, sf_dir):
    """What each batch meets, given the bytes written since the last sync of its group."""
    b = batch.batch_bytes(event_ops(spark, sf_dir))
    since = Window.partitionBy(F.expr(f"(seq - 1) div {GROUP}")).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    b = b.select("seq", "record_bytes", F.sum("record_bytes").over(since).alias("owed"))
    met = Caps(RECORD_LIMIT, 1 << 40, 0, BUSY_LIMIT).refusal(F.col("record_bytes"), F.col("owed") - F.col("record_bytes"))
    return b.select("*", (met == int(Status.RECORD_TOO_LARGE)).alias("too_large"), (met == int(Status.BUSY)).alias("busy"))


@query(f",{view_sql('a')} select k, seq, v from a", ORDER_SQL)
def kv_orders_latest(spark, sf_dir):
    return resolve.resolve(*batch.normalise(order_ops(spark, sf_dir)))


@query(f",{view_sql('a')} select v as priority, count(*) as n_customers, min(k) as first_k from a group by v", ORDER_SQL)
def kv_orders_by_priority(spark, sf_dir):
    """An aggregate over the resolved view: any relational plan may follow it."""
    view = resolve.resolve(*batch.normalise(order_ops(spark, sf_dir)))
    return view.groupBy(F.col("v").alias("priority")).agg(F.count("*").alias("n_customers"), F.min("k").alias("first_k"))
