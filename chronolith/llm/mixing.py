"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only).

The mix is a list of N slots. Slot k takes the golden-ratio point k * g mod N, where g is the whole number
nearest N divided by the golden ratio that shares no factor with N. The sources' cumulative needs, in blocks,
cut [0, N) into stretches, and the slot goes to the source whose stretch holds its point. As k runs through
0..N-1 the points are a permutation of 0..N-1, so each source has exactly as many slots as it needs blocks,
however small it is, and every stretch of the mix holds each source near its share.

A source's documents are shuffled (in the order of a hash) into one stream of words, read round and round, and
cut into blocks of equal length; the last block ends at the source's target. The slots of a source are ranked
in slot order, and the slot of rank r is joined with block r. A document is taken for the words of it that lie
in joined blocks. Blocks grow only where more than MAX_SLOTS would be needed, which changes the grain of the
schedule but no amount, as the last block of every source is cut at its target.

Defined cases: a null text has size 0; documents of size 0 are taken 0 times; null sources form one source,
ordered last; an empty table gives an empty result; the shuffle orders rows by the md5 of id and text, so null
ids spread like others, and rows alike in id, source and text are separate rows of the stream, side by side.
Input columns keep their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, before_each, own, placed_in_order, quoted
from .textkit import WORD_RE

#: Weights of the sources in order, repeating; the mix's share of all words; the cap on repeats.
WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
#: Words of a block, and the number of slots from which blocks grow instead (its square fits a long).
BLOCK, MAX_SLOTS = 1024, 1 << 30
#: Slots ranked, points listed, or copies of a row made in one go; documents in a run of the shuffle by design.
RUN, DOCS_A_RUN = 1024, 500


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_RE)).cast("long")


def source_targets(ws: Workspace, sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, s, part, source_size, target, due): the sources' numbers and targets, and the words to take.

    Each round fixes the sources whose share goes beyond `repeats` times their size, and shares the rest anew
    among the others; only sums reach the driver.
    """
    per = ws.save(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    per = placed_in_order(ws, per, [F.col("source").asc_nulls_last()], "s", "part")
    weight = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("s") % len(weights) + 1).cast("int"))
    per = ws.save(per.withColumn("w", weight.cast("long")))
    size, w = F.col("source_size"), F.col("w")
    facts = per.agg(F.sum(size).alias("size"), F.sum(w).alias("w")).first()
    all_size, all_w = facts["size"] or 0, facts["w"] or 1
    rest, free, n = share * all_size, all_w, 0
    while True:
        capped = F.lit(float(rest)) * w > (repeats * size).cast("double") * free
        got = per.where(capped).agg(F.count("*").alias("n"), F.sum(size).alias("size"), F.sum(w).alias("w")).first()
        if got["n"] == n:
            break
        rest, free, n = share * all_size - repeats * got["size"], all_w - got["w"], got["n"]
    target = F.when(capped, (repeats * size).cast("double")).otherwise(F.lit(float(rest)) * w / free)
    due = F.least(F.round("target").cast("long"), repeats * size)
    return per.withColumn("target", target).select("source", "s", "part", "source_size", "target", due.alias("due"))


def stretches(targets: DataFrame, block: int) -> DataFrame:
    """targets with need, the blocks of each source, and lo, where its stretch of [0, N) starts."""
    t = targets.withColumn("need", F.expr(f"(due + {block - 1}) div {block}"))
    parts = before_each(t.groupBy("part").agg(F.sum("need").alias("n")), [], "part", "n", "base").drop("n")
    t = before_each(t, ["part"], "s", "need", "lo").join(F.broadcast(parts), "part")
    return t.withColumn("lo", F.col("lo") + F.col("base")).drop("base", "part")


def golden_step(n: int) -> int:
    """The number nearest n / golden ratio that shares no factor with n: k -> k * step mod n is a permutation."""
    step = max(1, round(n * (math.sqrt(5) - 1) / 2))
    while math.gcd(step, n) != 1:
        step += 1
    return step


def listed(rows: DataFrame, n: str, run: str, item: str) -> DataFrame:
    """Each row as often as its column n says, with `item` counting from 0, by way of runs of bounded length."""
    rows = rows.where(F.col(n) > 0).withColumn(run, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({n} - 1) div {RUN}"))))
    rows = rows.repartition(run, *[c for c in rows.columns if c in ("s", "okey")])
    upto = F.least(F.col(n), (F.col(run) + 1) * RUN) - 1
    return rows.withColumn(item, F.explode(F.sequence(F.col(run) * RUN, upto))).drop(run)


def schedule(ws: Workspace, cut: DataFrame, n: int) -> DataFrame:
    """(slot, s, rank): the n slots with their sources, ranked within these.

    A source's slots are found from the points of its stretch by the inverse of k -> k * g mod n. Ranks are sums
    over runs of slots, then places within a run, so no source's slots come together in one task. Tables that grow with the documents are merged, never sent to
    every task: their files are much smaller than they are in memory.
    """
    if not n:
        return ws.spark.createDataFrame([], "slot bigint, s bigint, rank bigint")
    back = pow(golden_step(n), -1, n) if n > 1 else 0
    points = listed(cut.select("s", "lo", "need"), "need", "run", "i")
    slots = points.select("s", ((F.col("lo") + F.col("i")) * back % n).alias("slot"))
    slots = ws.save(slots.withColumn("run", F.expr(f"slot div {RUN}")))
    runs = before_each(slots.groupBy("s", "run").agg(F.count("*").alias("n")), ["s"], "run", "n", "base").drop("n")
    inside = F.row_number().over(Window.partitionBy("s", "run").orderBy("slot")) - 1
    return slots.withColumn("inside", inside).join(runs.hint("merge"), ["s", "run"]).select("slot", "s", (F.col("base") + F.col("inside")).alias("rank"))


def streams(ws: Workspace, rows: DataFrame, targets: DataFrame, n: int) -> DataFrame:
    """The documents with their source's facts and `start`, their first word's place in its shuffled stream.

    rows alike in all columns come as one with their number, and are told apart afterwards by `copy`. Starts
    are sums of super-runs, of runs within these, and of documents within a run, all split by hash.
    """
    digits = min(12, max(1, math.ceil(math.log(max(2, n / DOCS_A_RUN), 16))))
    rows = rows.withColumn("run", F.substring("okey", 1, digits))
    items = ws.save(rows.groupBy("source", "run", "okey", "doc_id", "size", "tie").agg(F.count("*").alias("alike")))
    items = items.withColumn("words", F.col("size") * F.col("alike"))
    runs = items.groupBy("source", "run").agg(F.sum("words").alias("n")).withColumn("top", F.substring("run", 1, digits // 2))
    runs = before_each(runs, ["source", "top"], "run", "n", "base")
    tops = before_each(runs.groupBy("source", "top").agg(F.sum("n").alias("top_n")), ["source"], "top", "top_n", "top_base")
    tops = tops.select(F.col("source").alias("s_"), F.col("top").alias("t_"), "top_base")
    runs = runs.join(tops, F.col("source").eqNullSafe(F.col("s_")) & (F.col("top") == F.col("t_")))
    runs = runs.select(F.col("source").alias("rs_"), F.col("run").alias("run_"), (F.col("base") + F.col("top_base")).alias("base"))
    facts = targets.select("source", "s", "source_size", "target", "due")
    runs = ws.save(runs.join(facts, F.col("rs_").eqNullSafe(F.col("source"))).drop("source"))
    placed = before_each(items, ["source", "run"], "okey", "words", "inside")
    placed = placed.join(runs.hint("merge"), F.col("source").eqNullSafe(F.col("rs_")) & (F.col("run") == F.col("run_"))).drop("rs_", "run_", "run")
    if items.where("alike > 1").isEmpty():
        placed = placed.withColumn("copy", F.lit(0).cast("long"))
    else:
        placed = listed(placed, "alike", "some", "copy")
    return ws.save(placed.withColumn("start", F.col("base") + F.col("inside") + F.col("copy") * F.col("size")).drop("base", "inside", "alike", "words"))


DOC = ("doc_id", "source", "okey", "tie", "copy", "size", "source_size", "target")


def pieces(placed: DataFrame, block: int, repeats: int) -> DataFrame:
    """The parts of documents in blocks of their source, for every time round: DOC, s, rank and words."""

    def parts(a: Column, b: Column) -> Column:
        ranks = F.sequence(F.floor(a / block), F.floor((b - 1) / block))
        words = lambda r: F.least((r + 1) * block, b) - F.greatest(r * block, a)
        return F.when(a < b, F.transform(ranks, lambda r: F.struct(r.alias("rank"), words(r).alias("words")))).otherwise(none)

    none = F.array().cast("array<struct<rank:bigint,words:bigint>>")
    begins = [F.col("start") + turn * F.col("source_size") for turn in range(repeats)]
    every = [parts(a, F.least(a + F.col("size"), F.col("due"))) for a in begins]
    return placed.withColumn("piece", F.explode(F.concat(*every))).select(*DOC, "s", "piece.rank", "piece.words")


def mix(ws: Workspace, docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> tuple[DataFrame, DataFrame]:
    """(every document with `taken`, the words of it that the mix takes; the parts taken with their slots).

    docs has the columns of `light`.
    """
    targets = ws.save(source_targets(ws, docs, weights, share, repeats))
    facts = targets.agg(F.sum("due").alias("due")).first()
    block = max(BLOCK, -(-(facts["due"] or 0) // MAX_SLOTS))
    cut = ws.save(stretches(targets, block))
    n = cut.agg(F.sum("need").alias("n")).first()["n"] or 0
    placed = streams(ws, docs, targets, docs.count())
    slots = schedule(ws, cut, n)
    taken = pieces(placed, block, repeats).join(slots.hint("merge"), ["s", "rank"])
    none = placed.select(*DOC, F.lit(0).cast("long").alias("words"))
    rows = taken.select(*DOC, "words").unionByName(none).groupBy(*DOC).agg(F.sum("words").alias("taken"))
    return rows, taken


def light(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, okey, tie): what the mix needs of each document."""
    md5 = lambda c: F.md5(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))
    d = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), md5(F.col("text")).alias("tie"))
    okey = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("tie"))
    return d.withColumn("okey", md5(okey))


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    ws = Workspace(docs.sparkSession)
    rows, _ = mix(ws, ws.save(light(docs)))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, source, slot, words: the parts of documents that the mix takes, with the slots that hold them."""
    ws = Workspace(docs.sparkSession)
    return mix(ws, ws.save(light(docs)))[1].select("doc_id", "source", "slot", "words")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, rounded to whole documents."""
    names = docs.columns
    ws = Workspace(docs.sparkSession)
    rows, _ = mix(ws, ws.save(light(docs)))
    in_id, in_tie, n, alike, tie, copy = (own(x) for x in ("in_id", "in_tie", "n", "alike", "tie", "copy"))
    whole = F.expr("int((2 * taken + size) div (2 * size))")
    times = rows.where("size > 0").select(F.col("doc_id").alias(in_id), F.col("tie").alias(in_tie), whole.alias(n))
    times = times.groupBy(in_id, in_tie).agg(F.sum(n).alias(n), F.count("*").alias(alike))
    times = ws.save(times.where(F.col(n) > 0))
    keyed = docs.withColumn(tie, F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    out = keyed.join(times, F.col("doc_id").eqNullSafe(F.col(in_id)) & (F.col(tie) == F.col(in_tie)))
    # Rows that repeat id and text share their copies evenly, rounded up.
    out = out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.ceil(F.col(n) / F.col(alike)).cast("int"))))
    return out.select(*quoted(names))


def oracle(weights=WEIGHTS) -> str:
    """The amounts in closed form: a document has the words of its place in the stream, twice round, before the target."""
    w = f"[{', '.join(map(str, weights))}][((row_number() over (order by source nulls last) - 1) % {len(weights)} + 1)::int]"
    return rf"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    md5(coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as okey from documents),
p0 as (select source, sum(size)::bigint as source_size, {w} as w from d group by source),
p1 as (select *, sum(source_size) over ()::bigint as all_size, sum(w) over ()::bigint as all_w,
    coalesce(sum(source_size) over b, 0)::bigint as c0, coalesce(sum(w) over b, 0)::bigint as w0
    from p0 window b as (order by source_size::double / w, source nulls last rows between unbounded preceding and 1 preceding)),
p2 as (select *, min(({SHARE} * all_size - {REPEATS} * c0)::double * w > {REPEATS} * source_size * (all_w - w0)) over
    (order by source_size::double / w, source nulls last rows between unbounded preceding and current row) as capped from p1),
p3 as (select *, sum(case when not capped then w else 0 end) over ()::bigint as free,
    ({SHARE} * all_size - {REPEATS} * sum(case when capped then source_size else 0 end) over ())::double as rest from p2),
p4 as (select *, case when capped then ({REPEATS} * source_size)::double else rest * w / free end as target from p3),
t as (select *, least(round(target), {REPEATS} * source_size)::bigint as due from p4),
r as (select d.*, coalesce(sum(size) over (partition by source order by okey
    rows between unbounded preceding and 1 preceding), 0)::bigint as start from d)
select doc_id, size, source_size, target, (greatest(least(start + size, due) - start, 0)
    + greatest(least(start + source_size + size, due) - start - source_size, 0))::bigint as taken
from r join t on r.source is not distinct from t.source
"""
