"""Operation logs derived from the test tables, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _key(c):
    return F.lpad(c.cast("string"), 10, "0")


def event_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of four events: an error deletes its user, a signup deletes the range of five users, others set."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    kind = F.when(F.col("event_type") == "error", "D").when(F.col("event_type") == "signup", "R").otherwise("S")
    user = _key(F.col("user_id"))
    return e.select(
        F.expr("event_id div 4 + 1").alias("seq"), (F.col("event_id") % 4).alias("ord"), kind.alias("kind"), F.when(kind != "R", user).alias("k"),
        F.when(kind == "S", F.concat("event_type", F.lit(":"), F.col("event_id").cast("string"))).alias("v"), F.when(kind == "R", user).alias("lo"), F.when(kind == "R", _key(F.col("user_id") + 5)).alias("hi"),
    )


def order_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch per order: a finished order deletes its customer, others set its priority."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    kind = F.when(F.col("o_orderstatus") == "F", "D").otherwise("S")
    none = F.lit(None).cast("string")
    return o.select((F.col("o_orderkey") + 1).alias("seq"), F.lit(0).cast("bigint").alias("ord"), kind.alias("kind"), _key(F.col("o_custkey")).alias("k"), F.when(kind == "S", F.col("o_orderpriority")).alias("v"), none.alias("lo"), none.alias("hi"))


EVENT_SQL = """
ops as (select event_id // 4 + 1 as seq, event_id % 4 as ord,
    case event_type when 'error' then 'D' when 'signup' then 'R' else 'S' end as kind,
    lpad(user_id::varchar, 10, '0') as u, lpad((user_id + 5)::varchar, 10, '0') as u5, event_type || ':' || event_id as val from events),
rng as (select seq, ord, u as lo, u5 as hi from ops where kind = 'R' and u < u5),
pts as (select seq, ord, kind, u as k, val from ops where kind <> 'R'),
lst as (select * from pts qualify row_number() over (partition by seq, k order by ord desc) = 1),
v as (select k, seq, case kind when 'S' then 1 else 0 end as vt, case kind when 'S' then val end as v from lst p
    where not exists (select 1 from rng r where r.seq = p.seq and r.ord > p.ord and r.lo <= p.k and p.k < r.hi)),
r as (select lo, max(hi) as hi, seq from rng group by seq, lo)"""

ORDER_SQL = """
v as (select lpad(o_custkey::varchar, 10, '0') as k, o_orderkey + 1 as seq, case when o_orderstatus = 'F' then 0 else 1 end as vt,
    case when o_orderstatus <> 'F' then o_orderpriority end as v from orders),
r as (select null::varchar as lo, null::varchar as hi, null::bigint as seq where false)"""


def view_sql(name: str, seq: str | None = None) -> str:
    """A named subquery: the visible map at a sequence, over v and r."""
    cut = f"where seq <= {seq}" if seq else ""
    more = f"and r.seq <= {seq}" if seq else ""
    return f"""
{name}_n as (select * from v {cut} qualify row_number() over (partition by k order by seq desc) = 1),
{name} as (select k, seq, v from {name}_n n where vt = 1 and not exists
    (select 1 from r where r.seq > n.seq {more} and r.lo <= n.k and (r.hi is null or n.k < r.hi)))"""
