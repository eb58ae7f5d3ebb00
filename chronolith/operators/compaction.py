"""Version garbage collection under the sequences that readers can observe.

A value stays if the visible map at some observable sequence returns it: the union of the maps, so every
answer at every observable sequence is the same before and after. A point deletion or range deletion stays
while an older file may hold what it hides (not bottom-most), or while an observable sequence lies below it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .resolve import cover


def observable(snapshots: list[int], current: int) -> list[int]:
    """Live snapshot sequences and the current one, ascending and distinct."""
    return sorted({*snapshots, current})


def required(versions: DataFrame, ranges: DataFrame, sequences: list[int], few_ranges: bool | None = None) -> DataFrame:
    """(k, seq) of the values that some observable sequence returns, in one pass over the versions.

    A version can be returned only at the first observable sequence at or above it, or later ones up to its
    successor. So of the versions of a key that share that first sequence only the newest counts, and a range
    hides it for good if it does so there.
    """
    known = sorted(sequences)
    first = F.element_at(F.filter(F.array(*[F.lit(s).cast("long") for s in known]), lambda s: s >= F.col("seq")), 1)
    top = versions.where(F.col("seq") <= known[-1]).withColumn("at", first)
    top = top.groupBy("k", "at").agg(F.max_by(F.struct("seq", "vt"), "seq").alias("top")).select("k", "at", "top.seq", "top.vt").where("vt = 1")
    shown = [cover(top.where(F.col("at") == s), ranges.where(F.col("seq") <= s), few=few_ranges).where("c <= seq").select("k", "seq") for s in known]
    return reduce(DataFrame.unionByName, shown)


def labelled(versions: DataFrame, ranges: DataFrame, sequences: list[int], bottom_most: bool = True, few_ranges: bool | None = None) -> DataFrame:
    """Versions with a column keep."""
    need = required(versions, ranges, sequences, few_ranges).select(F.col("k").alias("k_"), F.col("seq").alias("s_"), F.lit(True).alias("needed"))
    j = versions.join(need, (F.col("k") == F.col("k_")) & (F.col("seq") == F.col("s_")), "left")
    deletion = F.lit(True) if not bottom_most else F.col("seq") > F.lit(min(sequences))
    # A version above all observable sequences is pending work, not garbage.
    late = F.col("seq") > F.lit(max(sequences))
    keep = F.when(F.col("vt") == 1, F.col("needed").isNotNull() | late).otherwise(deletion)
    return j.select(*versions.columns, keep.alias("keep"))


def kept(versions: DataFrame, ranges: DataFrame, sequences: list[int], bottom_most: bool = True, few_ranges: bool | None = None) -> DataFrame:
    return labelled(versions, ranges, sequences, bottom_most, few_ranges).where("keep").drop("keep")


def dropped(versions: DataFrame, ranges: DataFrame, sequences: list[int], bottom_most: bool = True) -> DataFrame:
    return labelled(versions, ranges, sequences, bottom_most).where("not keep").drop("keep")


def kept_ranges(ranges: DataFrame, sequences: list[int], bottom_most: bool = True) -> DataFrame:
    """Range deletions that some observable sequence precedes, or all of them above older files."""
    return ranges.where(F.col("seq") > F.lit(min(sequences))) if bottom_most else ranges


def stats(versions: DataFrame, ranges: DataFrame, sequences: list[int], bottom_most: bool = True) -> DataFrame:
    """One row: versions consumed, emitted, dropped; deletions kept; ranges kept and dropped."""
    l = labelled(versions, ranges, sequences, bottom_most).agg(  # noqa: E741
        F.count("*").alias("consumed"), F.count_if("keep").alias("emitted"), F.count_if(~F.col("keep")).alias("dropped"), F.count_if(F.col("keep") & (F.col("vt") == 0)).alias("deletions_kept")
    )
    keep = F.lit(True) if not bottom_most else F.col("seq") > F.lit(min(sequences))
    r = ranges.agg(F.count_if(keep).alias("ranges_kept"), F.count_if(~keep).alias("ranges_dropped"))
    return l.join(r, F.lit(True))
