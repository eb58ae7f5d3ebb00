"""Write batches as frames: rows (seq, ord, kind, k, v, lo, hi) become versions and ranges.

kind is S (set k to v), D (delete k) or R (delete [lo, hi), null bounds unbounded). Within a batch the last
operation on a key wins and a range erases the operations before it; a finite range with hi <= lo is
nothing; ranges of a batch that start alike become one with the farthest end. A batch is one sequence
number, so every plan here is an equi-join or a group on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import covers

RECORD_HEAD, OP_HEAD, LENGTH_HEAD = 13, 5, 4


def batch_ranges(ops: DataFrame) -> DataFrame:
    """(lo, hi, seq): the range deletions of each batch, one per start."""
    r = _effective_ranges(ops)
    return r.groupBy("seq", "lo").agg(F.bool_or(F.col("hi").isNull()).alias("open"), F.max("hi").alias("far")).select(
        "lo", F.when(~F.col("open"), F.col("far")).alias("hi"), "seq"
    )


def _effective_ranges(ops: DataFrame) -> DataFrame:
    empty = F.lit("").cast(ops.schema["lo"].dataType)
    r = ops.where(F.col("kind") == "R").select("seq", "ord", F.coalesce("lo", empty).alias("lo"), "hi")
    return r.where(F.col("hi").isNull() | (F.col("lo") < F.col("hi")))


def batch_versions(ops: DataFrame) -> DataFrame:
    """(k, seq, vt, v): the point operations of each batch that survive it; vt is 1 for a value, 0 for a deletion."""
    points = ops.where(F.col("kind") != "R")
    last = points.groupBy("seq", "k").agg(F.max_by(F.struct("ord", "kind", "v"), "ord").alias("op")).select(
        "k", "seq", F.col("op.ord").alias("ord"), (F.col("op.kind") == "S").cast("tinyint").alias("vt"), F.when(F.col("op.kind") == "S", F.col("op.v")).alias("v")
    )
    r = _effective_ranges(ops).select(F.col("seq").alias("r_seq"), F.col("ord").alias("r_ord"), F.col("lo").alias("r_lo"), F.col("hi").alias("r_hi"))
    erased = (F.col("r_seq") == F.col("seq")) & (F.col("r_ord") > F.col("ord")) & covers(F.col("r_lo"), F.col("r_hi"), F.col("k"))
    return last.join(r, erased, "left_anti").select("k", "seq", "vt", "v")


def normalise(ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(versions, ranges) of a log of operations."""
    return batch_versions(ops), batch_ranges(ops)


def op_bytes(kind: Column, k: Column, v: Column, lo: Column, hi: Column) -> Column:
    """Bytes that one operation adds to its batch's record."""
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    key = F.when(kind == "R", size(lo)).otherwise(size(k))
    rest = F.when(kind == "S", LENGTH_HEAD + size(v)).when(kind == "R", LENGTH_HEAD + size(hi)).otherwise(0)
    return (OP_HEAD + key + rest).cast("long")


def batch_bytes(ops: DataFrame) -> DataFrame:
    """(seq, n_ops, record_bytes) of each batch, charged on the operations as submitted."""
    b = op_bytes(F.col("kind"), F.col("k"), F.col("v"), F.col("lo"), F.col("hi"))
    return ops.groupBy("seq").agg(F.count("*").alias("n_ops"), (F.sum(b) + RECORD_HEAD).alias("record_bytes"))


def group_facts(ops: DataFrame, *by: str) -> DataFrame:
    """Of groups of batches that become durable together: the sequence made durable, the batches and operations,
    and the bytes of the largest record and of all. Without `by` there is one group."""
    b = op_bytes(F.col("kind"), F.col("k"), F.col("v"), F.col("lo"), F.col("hi"))
    each = ops.groupBy(*by, "seq").agg(F.count("*").alias("n"), (F.sum(b) + RECORD_HEAD).alias("record_bytes"))
    return each.groupBy(*by).agg(
        F.max("seq").alias("durable_seq"), F.count("*").alias("n_batches"), F.sum("n").alias("n_ops"), F.max("record_bytes").alias("largest"), F.sum("record_bytes").alias("size")
    )
