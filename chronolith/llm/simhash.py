"""SimHash near-duplicates: fingerprints of word shingles, linked by pigeonring filtering.

A fingerprint has 64 bits in five consecutive segments on a ring. If two fingerprints differ in at most 4
bits, then some segment starts a chain whose first l segments differ in at most 4*l/5 bits, for every l
(the pigeonring principle). The first link of such a chain is equal in both, the first two differ in at
most one bit. So fingerprints meet in a bucket of (start segment, its value); for corpora of very many
distinct fingerprints the second link enters the key too, each of its bits masked once, which splits the
buckets further and misses no chain. Within a bucket the chain is checked link by link, then the full
distance. A bucket sends on a spanning forest of its links, never all its pairs; buckets over the block
size are dealt out as pairs of blocks.

Defined cases: a null or empty text has no words and the fingerprint zero, linked like any other; a text
of one to three words is one shingle; equal fingerprints are one node, so copies are never expanded into
pairs; component_id is the smallest doc_id of the component and null only if all its ids are null; an
empty table gives an empty result; input columns keep their names and are ignored but for doc_id and text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, components, own, quoted, shuffle_partitions
from .textkit import runs

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Widths of the five segments, from the lowest bit up.
WIDTHS = (13, 13, 13, 13, 12)
SHIFTS = tuple(int(x) for x in np.cumsum((0, *WIDTHS[:-1])))
#: Fingerprints compared at once in a bucket; distinct fingerprints up to which one link makes the key.
BLOCK, ONE_LINK = 2048, 1 << 25
LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
POP = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of a text."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        h = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        h = [digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    total = np.zeros(64, np.int64)
    codes = np.array(h, "<u8")
    for at in range(0, n, 1 << 16):
        part = np.ascontiguousarray(codes[at : at + (1 << 16)])
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * total > n).astype(np.uint8), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x) if hasattr(np, "bitwise_count") else sum(POP[(x >> np.uint64(s)) & np.uint64(0xFFFF)] for s in (0, 16, 32, 48))


class Forest:
    """Union-find over positions 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


def chain_ok(diff: np.ndarray, start: int, distance: int = DISTANCE) -> np.ndarray:
    """Whether the chain from `start` keeps its budget at every length, then the full distance."""
    near = np.ones(diff.shape, bool)
    total = np.zeros(diff.shape, np.uint8)
    m = len(WIDTHS)
    for link in range(m):
        i = (start + link) % m
        part = (diff >> np.uint64(SHIFTS[i])) & np.uint64((1 << WIDTHS[i]) - 1)
        total = total + popcount(part).astype(np.uint8)
        near &= total <= distance * (link + 1) // m
        if not near.any():
            break
    return near


def links(a: np.ndarray, b: np.ndarray | None, start: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among a, or (b given) of those between a and b; as values."""
    every = a if b is None else np.concatenate([a, b])
    forest = Forest(len(every))
    right = a if b is None else b
    step = max(1, (1 << 21) // max(1, len(right)))
    for at in range(0, len(a), step):
        rows = a[at : at + step]
        ok = chain_ok(rows[:, None] ^ right[None, :], start)
        i, j = np.nonzero(ok)
        i = i + at
        if b is None:
            i, j = i[j > i], j[j > i]
        else:
            j = j + len(a)
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            if forest.join(x, y):
                yield int(every[x]), int(every[y])


def bucket_rows(distinct: DataFrame, two_links: bool) -> DataFrame:
    """(seg, k1, k2, fp): the buckets of each fingerprint."""
    m = len(WIDTHS)

    def value(i: int):
        return F.shiftrightunsigned(F.col("fp"), SHIFTS[i]).bitwiseAND((1 << WIDTHS[i]) - 1)

    keys = []
    for i in range(m):
        nxt = (i + 1) % m
        if two_links:
            keys += [
                F.struct(F.lit(i).alias("seg"), value(i).alias("k1"), (value(nxt).bitwiseAND(((1 << WIDTHS[nxt]) - 1) ^ (1 << j)) * 16 + j).alias("k2"))
                for j in range(WIDTHS[nxt])
            ]
        else:
            keys.append(F.struct(F.lit(i).alias("seg"), value(i).alias("k1"), F.lit(0).cast("long").alias("k2")))
    return distinct.select(F.explode(F.array(*keys)).alias("key"), "fp").select("key.*", "fp")


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (seg, k1, k2, p, q, fp, blk) sorted by the first five: links within a block (p = q) or between two."""
    a: list[int] = []
    b: list[int] = []
    for (seg, _, _, p, q), (fp, blk) in runs(batches, 5):
        if len(fp) < 2:
            continue
        fp = fp.astype(np.int64).view(np.uint64)
        pair = links(fp, None, int(seg)) if p == q else links(fp[blk == p], fp[blk == q], int(seg))
        for x, y in pair:
            a.append(x)
            b.append(y)
        if len(a) > 100_000:
            yield _pairs(a, b)
            a, b = [], []
    yield _pairs(a, b)


def _pairs(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64), pa.int64()) for x in (a, b)], ["a", "b"])


def near_links(ws: Workspace, distinct: DataFrame, block: int = BLOCK, one_link: int = ONE_LINK) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints within the distance of each other."""
    two = distinct.count() > one_link
    rows = bucket_rows(distinct, two)
    keys = ["seg", "k1", "k2"]
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > block)
    large = ws.save(sizes.select(*[F.col(k).alias(f"{k}_") for k in keys], F.ceil(F.col("n") / block).cast("int").alias("parts")))
    zero = F.lit(0).cast("int")
    if large.isEmpty():
        dealt = rows.select(*keys, zero.alias("p"), zero.alias("q"), "fp", zero.alias("blk"))
    else:
        # A large bucket becomes one group for each pair of its blocks.
        cond = [F.col(k) == F.col(f"{k}_") for k in keys]
        r = rows.join(large, cond, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        r = r.withColumn("blk", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        other = F.explode(F.sequence(zero, F.col("parts") - 1))
        r = r.select(*keys, "fp", "blk", other.alias("other"))
        dealt = r.select(*keys, F.least("blk", "other").alias("p"), F.greatest("blk", "other").alias("q"), "fp", "blk")
    order = [*keys, "p", "q"]
    dealt = dealt.repartition(shuffle_partitions(ws.spark), *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(_edges, "a bigint, b bigint")


def classes(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every document."""
    ws = Workspace(docs.sparkSession)
    fps = ws.save(fingerprints(docs, shingle))
    found = class_table(ws, fps)
    out = fps.join(found, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def class_table(ws: Workspace, fps: DataFrame) -> DataFrame:
    """(fp, root, component_id) for every distinct fingerprint; the root tells components apart where no id is known."""
    distinct = ws.save(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(ws, near_links(ws, distinct.select("fp")))
    member = distinct.join(roots, F.col("fp") == F.col("x"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    member = ws.save(member)
    least = ws.save(member.groupBy("root").agg(F.min("least").alias("component_id")))
    return ws.save(member.join(least, "root").select("fp", "root", "component_id"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One document of each component, the one with the smallest id, with all columns.

    Rows that repeat that id: one of them stays. Documents with a null id stay only where no id is known.
    """
    names = docs.columns
    ws = Workspace(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, t = batch.schema.get_field_index("doc_id"), batch.schema.get_field_index("text")
            fps = np.array([fingerprint(x, shingle) for x in batch.column(t).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(i), pa.array(fps, pa.int64()), pa.array(_row_keys(batch), pa.int64())], ["doc_id", "fp", "row_key"])

    fps = ws.save(docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, fp bigint, row_key bigint"))
    found = class_table(ws, fps)
    best = fps.join(found, "fp").groupBy("root").agg(
        F.min(F.when(F.col("doc_id").eqNullSafe(F.col("component_id")), F.struct("doc_id", "row_key"))).alias("best")
    )
    key, in_id, in_key = own("key"), own("in_id"), own("in_key")
    stay = ws.save(best.select(F.col("best.doc_id").alias(in_id), F.col("best.row_key").alias(in_key)))
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    hit = keyed.join(stay, F.col("doc_id").eqNullSafe(F.col(in_id)) & (F.col(key) == F.col(in_key)), "left_semi")
    return hit.dropDuplicates(["doc_id", key]).select(*quoted(names))


def _row_keys(batch: pa.RecordBatch) -> list[int]:
    t = batch.schema.get_field_index("text")
    out = np.array([xxhash.xxh64_intdigest((x or "").encode(), SEED) for x in batch.column(t).to_pylist()], np.uint64)
    return out.view(np.int64).tolist()
