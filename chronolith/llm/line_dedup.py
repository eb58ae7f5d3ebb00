"""Fuzzy line dedup: MinHash signatures of character shingles, banding, exact Jaccard, union-find.

Lines (split at line feeds) are first made distinct by their MD5. The shingles of a distinct line, all runs
of 8 characters (or the whole of a shorter line), are hashed once into 80 bins whose minima are the
signature; an empty bin copies a filled one in a fixed order. Sixteen bands of five minima make candidate
groups: two lines of similarity 0.8 share a band with probability 0.998. Groups with the same members
collapse to one, and within a group the exact Jaccard similarity of the shingle sets (as 64-bit hashes)
decides, at 0.8 or more. A group sends on a spanning forest of its links, never its pairs; a large group is dealt
out as pairs of blocks. A bucket of band keys that grows past its bound, for one key is very common, is dealt over
several tasks, which first agree on the keys that several lines share. Distributed union-find makes the
components, and one line of each stays: the first by (document id, text hash, line number).

Defined cases: lines without a word (blank, or white space only) are never removed; a null text counts as
empty and stays null; rows that repeat id and text are the same document and come out alike; a document
whose lines all go keeps its row with an empty text; null ids sort last; an empty table gives an empty
result; other columns are carried unchanged.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, components, own, quoted, shuffle_partitions
from .simhash import Forest
from .textkit import U, mix, powers, runs

SHINGLE, BINS, BANDS, ROWS, SIMILARITY = 8, 80, 16, 5, 0.8
CHAR_BASE, BAND_BASE = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
#: Characters hashed at once; signatures in a bucket of band keys; lines of a group compared at once.
PIECE, BUCKET, BLOCK = 1 << 17, 3_000_000, 256
#: Pairs in a bucket before it is dealt out, told from one document in SIZED (which plans the dealing, and no
#: more).
BUCKET_LIMIT, SIZED = 9_000_000, 64
SEEN, GATHER = 100_000, 1_500_000
#: Shingles of two lines from which their lowest ones are looked at first.
LONG_SETS = 1000
NO_MIN = np.iinfo(np.uint32).max
NO_DOC = np.iinfo(np.int64).max
_FILL: list[np.ndarray] = []


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all the lines' shingles, in order, and how many each line has; repeats included."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    end = np.cumsum(size)
    n = np.maximum(size - SHINGLE + 1, 0)
    h = np.zeros(0, U)
    if n.any():
        # One polynomial hash at every character, then without those that run past their line's end.
        p, inverse = powers(CHAR_BASE, len(codes) + 1)
        total = np.zeros(len(codes) + 1, U)
        np.cumsum((codes + U(1)) * p[: len(codes)], out=total[1:])
        h = total[SHINGLE:] - total[:-SHINGLE]
        h *= inverse[: len(h)]
        inside = np.ones(len(codes), bool)
        for back in range(1, SHINGLE):
            inside[(end - back)[size >= back]] = False
        h = h[inside[: len(h)]]
        h ^= h >> U(32)
        h *= U(0x9FB21C651E98DF25)
    short = np.flatnonzero(n == 0)
    if len(short):  # such a line is its own only shingle
        own_hash = np.array([int.from_bytes(line_id(lines[i].encode())[:8], "little") for i in short.tolist()], U)
        h = np.insert(h, np.cumsum(n)[short], own_hash)
        n = np.maximum(n, 1)
    return h, n


def shingle_sets(lines: list[str]) -> list[np.ndarray]:
    """The distinct shingle hashes of each line, ascending."""
    h, n = shingle_hashes(lines)
    out = []
    for part in np.split(h, np.cumsum(n)[:-1]):
        part = np.sort(part)
        new = np.ones(len(part), bool)
        np.not_equal(part[1:], part[:-1], out=new[1:])
        out.append(part[new])
    return out


def fill_order() -> np.ndarray:
    """For each bin, the order in which it looks for a filled one."""
    if not _FILL:
        r = np.random.default_rng(3)
        _FILL.append(np.stack([r.permutation(BINS) for _ in range(BINS)], 1))
    return _FILL[0]


def signatures(lines: list[str]) -> np.ndarray:
    """Band keys (uint64, BANDS to a line) of non-empty lines."""
    h, n = shingle_hashes(lines)
    low = np.full((len(lines), BINS), NO_MIN, np.uint32)
    cell = (h >> U(40)) * U(BINS) >> U(24)
    cell += np.repeat(np.arange(len(lines), dtype=U) * U(BINS), n)
    np.minimum.at(low.reshape(-1), cell.view(np.int64), (h >> U(8)).astype(np.uint32))
    empty = low == NO_MIN
    todo = np.flatnonzero(empty.any(1))
    if len(todo):
        got, still = low[todo], empty[todo]
        filled = ~still
        out = got.copy()
        for source in fill_order():
            hit = still & filled[:, source]
            out[hit] = got[:, source][hit]
            still &= ~hit
            if not still.any():
                break
        low[todo] = out
    keys = np.zeros((len(lines), BANDS), U)
    rows = low.reshape(len(lines), BANDS, ROWS).astype(U)
    for r in range(ROWS):
        keys = mix(keys * U(BAND_BASE) + rows[:, :, r] + U(r + 1))
    return mix(keys + np.arange(BANDS, dtype=U) * U(0x9E3779B97F4A7C15))


def line_id(raw: bytes) -> bytes:
    return hashlib.md5(raw, usedforsecurity=False).digest()


def lines_of(text: str | None) -> Iterator[tuple[int, str]]:
    """The lines that have a word, with their numbers."""
    for no, line in enumerate((text or "").split("\n")):
        if line and not line.isspace():
            yield no, line


LINES = "lid binary, short bigint, doc_id bigint, row_key bigint, line_no int"


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every line with a word, named by its MD5 and the first half of that."""
    names = [x.split()[0] for x in LINES.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32()]
    for batch in batches:
        lids: list[bytes] = []
        cols: list[list] = [[], [], []]

        def table(lids: list = lids, cols: list = cols) -> pa.RecordBatch:
            short = np.frombuffer(b"".join(lids), np.int64).reshape(-1, 2)[:, 0]
            arrays = [pa.array(lids, pa.binary()), pa.array(np.ascontiguousarray(short)), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))]
            out = pa.RecordBatch.from_arrays(arrays, names)
            lids.clear()
            for c in cols:
                c.clear()
            return out

        for doc, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for no, line in lines_of(text):
                lids.append(line_id(line.encode()))
                for c, v in zip(cols, (doc, key, no), strict=True):
                    c.append(v)
            if len(lids) >= 100_000:
                yield table()
        yield table()


def _band_rows(buckets: int):
    """Signatures as packed (band key, short line id) pairs, one row per bucket of keys.

    Lines that a task has lately seen are passed over: their pairs are sent already.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        fresh: list[str] = []
        ids: list[bytes] = []
        held: list[np.ndarray] = []
        size = 0

        def sign() -> None:
            if fresh:
                short = np.frombuffer(b"".join(x[:8] for x in ids), U)
                held.append(np.stack([signatures(fresh).reshape(-1), np.repeat(short, BANDS)], 1))
                fresh.clear()
                ids.clear()

        def table() -> pa.RecordBatch:
            pairs = np.concatenate(held) if held else np.zeros((0, 2), U)
            held.clear()
            b = ((pairs[:, 0] >> U(32)) * U(buckets) >> U(32)).astype(np.int32)
            order = np.argsort(b, kind="stable")
            kinds, first, n = np.unique(b[order], return_index=True, return_counts=True)
            blobs = [np.ascontiguousarray(p).tobytes() for p in np.split(pairs[order], first[1:])] if len(kinds) else []
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(n, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "n", "blob"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for _, line in lines_of(text):
                    lid = line_id(line.encode())
                    if lid in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(lid)
                    fresh.append(line)
                    ids.append(lid)
                    size += len(line)
                    if size >= PIECE:
                        sign()
                        size = 0
                        if sum(map(len, held)) >= GATHER:
                            yield table()
        sign()
        yield table()

    return run


def _candidate_groups(table: pa.Table) -> pa.Table:
    """(grp, short): lines that share a band key; grp names the set of members."""
    pairs = np.frombuffer(b"".join(table.column("blob").to_pylist()), U).reshape(-1, 2)
    key = np.sort(pairs[:, 0])
    shared = np.unique(key[1:][key[1:] == key[:-1]])  # keys that more than one row holds
    if len(shared):
        at = np.minimum(np.searchsorted(shared, pairs[:, 0]), len(shared) - 1)
        pairs = pairs[shared[at] == pairs[:, 0]]
    else:
        pairs = pairs[:0]
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    key, ids = pairs[order, 0], pairs[order, 1]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
    key, ids = key[fresh], ids[fresh]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(key)))
    grp = mix(np.add.reduceat(mix(ids), first) + size.astype(U)) if len(first) else np.zeros(0, U)
    many = np.repeat(size > 1, size)
    return pa.table([pa.array(np.repeat(grp, size)[many].view(np.int64)), pa.array(ids[many].view(np.int64))], ["grp", "short"])


GROUPS = "grp bigint, short bigint"


def _key_ends(table: pa.Table) -> pa.Table:
    """For each band key the least and the greatest line that has it, packed."""
    pairs = np.frombuffer(b"".join(table.column("blob").to_pylist()), U).reshape(-1, 2)
    return _merged_ends([(pairs[:, 0], pairs[:, 1], pairs[:, 1])], table)


def _merged_ends(parts: list[tuple], table: pa.Table, shared: bool = False) -> pa.Table:
    key, low, high = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")
    key, low, high = key[order], low[order], high[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    if len(first):
        key, low, high = key[first], np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
    if shared:
        key, low, high = (x[low < high] for x in (key, low, high))
    blob = np.stack([key, low, high], 1).tobytes()
    return pa.table([table.column("bucket")[:1], table.column("parts")[:1], pa.array([blob], pa.binary())], ["bucket", "parts", "facts"])


def _shared_keys(table: pa.Table) -> pa.Table:
    """The keys of a bucket that more than one line has, from the ends that its parts found."""
    parts = [np.frombuffer(b, U).reshape(-1, 3).T for b in table.column("facts").to_pylist()]
    return _merged_ends([tuple(p) for p in parts], table, shared=True)


def _of_shared_keys(_, bands: pa.Table, agreed: pa.Table) -> pa.Table:
    """(grp, short): the lines of a bucket's part under its shared keys, which name the groups."""
    pairs = np.frombuffer(b"".join(bands.column("blob").to_pylist()), U).reshape(-1, 2)
    keys = np.frombuffer(b"".join(agreed.column("facts").to_pylist()), U).reshape(-1, 3)[:, 0]
    pairs = pairs[np.isin(pairs[:, 0], keys)] if len(pairs) else pairs
    pairs = np.unique(pairs, axis=0) if len(pairs) else pairs
    return pa.table([pa.array(np.ascontiguousarray(pairs[:, i]).view(np.int64)) for i in (0, 1)], ["grp", "short"])


def _groups(ws: Workspace, keyed: DataFrame, buckets: int) -> DataFrame:
    """(grp, short): the candidate groups of all buckets."""
    schema = "bucket int, n bigint, blob binary"
    bands = keyed.select("text").mapInArrow(_band_rows(buckets), schema)
    looked_at = keyed.where(F.pmod(F.xxhash64(KEY, ID), F.lit(SIZED)) == 0).select("text").mapInArrow(_band_rows(buckets), schema)
    parts = F.ceil(F.sum("n") * SIZED / BUCKET_LIMIT).cast("int").alias("parts")
    large = ws.save(looked_at.groupBy("bucket").agg(parts).where("parts > 1").withColumnRenamed("bucket", "b_"))
    if large.isEmpty():
        return bands.select("bucket", "blob").groupBy("bucket").applyInArrow(_candidate_groups, GROUPS)
    joined = bands.join(F.broadcast(large), F.col("bucket") == F.col("b_"), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    joined = ws.save(joined.withColumn("salt", F.pmod(F.xxhash64("blob"), F.col("parts")).cast("int")).select("bucket", "salt", "parts", "blob"))
    ends = joined.where("parts > 1").groupBy("bucket", "salt").applyInArrow(_key_ends, "bucket int, parts int, facts binary")
    agreed = ws.save(ends.groupBy("bucket").applyInArrow(_shared_keys, "bucket int, parts int, facts binary"))
    agreed = agreed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = joined.where("parts > 1").groupBy("bucket", "salt").cogroup(agreed.groupBy("bucket", "salt")).applyInArrow(_of_shared_keys, GROUPS)
    return joined.where("parts = 1").select("bucket", "blob").groupBy("bucket").applyInArrow(_candidate_groups, GROUPS).unionByName(dealt)


def _short(lid: bytes) -> int:
    return int(np.frombuffer(lid[:8], np.int64)[0])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lid, short, line) of the wanted lines of each document."""
    for batch in batches:
        lids, lines = [], []
        for text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            split = text.split("\n")
            for w in wanted:
                lids.append(w["lid"])
                lines.append(split[w["line_no"]])
        yield pa.RecordBatch.from_arrays([pa.array(lids, pa.binary()), pa.array([_short(x) for x in lids], pa.int64()), pa.array(lines, pa.string())], ["lid", "short", "line"])


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the Jaccard similarity of two non-empty sets is at least `least`, sizes first."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    if len(a) + len(b) > LONG_SETS:
        # So similar sets have at least `need` in common, hence one among the lowest of either that remain.
        need = math.ceil(least / (1 + least) * (len(a) + len(b)) - 1e-9)
        low = np.concatenate((a[: len(a) - need + 1], b[: len(b) - need + 1]))
        low.sort()
        if not (low[1:] == low[:-1]).any():
            return False
    every = np.concatenate((a, b))
    every.sort()
    both = int(np.count_nonzero(every[1:] == every[:-1]))
    return both >= least * (len(a) + len(b) - both)


def _verified(least: float):
    """Rows (grp, p, q, blk, lid, line), sorted by the first three: links among the lines of block p, or (q given)
    between those and the ones of block q. Lines of many groups are hashed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[bytes] = []
        b: list[bytes] = []
        held: list[tuple] = []
        size = 0

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

        def compare() -> None:
            every: list[np.ndarray] = []
            some: list[str] = []
            chars = 0
            for x in (x for _, _, _, _, line in held for x in line.tolist()):
                some.append(x)
                chars += len(x)
                if chars >= PIECE:
                    every += shingle_sets(some)
                    some, chars = [], 0
            every += shingle_sets(some) if some else []
            at = 0
            for p, q, blk, lid, line in held:
                sets = every[at : at + len(line)]
                at += len(line)
                forest = Forest(len(lid))
                left = [i for i in range(len(lid)) if blk[i] == p]
                right = left if p == q else [i for i in range(len(lid)) if blk[i] == q]
                for i in left:
                    for j in right:
                        if (p != q or j > i) and lid[i] != lid[j] and forest.root(i) != forest.root(j) and similar(sets[i], sets[j], least):
                            forest.join(i, j)
                            a.append(lid[i])
                            b.append(lid[j])
            held.clear()

        for (_, p, q), (blk, lid, line) in runs(batches, 3):
            held.append((p, q, blk, lid, line))
            size += sum(map(len, line))
            if size >= PIECE:
                compare()
                size = 0
            if len(a) >= 50_000:
                yield table()
                a.clear()
                b.clear()
        if held:
            compare()
        yield table()

    return run


def _links(ws: Workspace, rows: DataFrame, least: float) -> DataFrame:
    """(a, b): links between lines (grp, lid, line) of a group that make the same components as all of them.

    A group larger than a block is dealt out as pairs of blocks.
    """
    zero, parts = F.lit(0), shuffle_partitions(ws.spark)
    sizes = rows.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    large = ws.save(sizes.select(F.col("grp").alias("g_"), F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")))
    if large.isEmpty():
        dealt = rows.select("grp", zero.alias("p"), zero.alias("q"), zero.alias("blk"), "lid", "line")
    else:
        r = rows.join(large, F.col("grp") == F.col("g_"), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        r = r.withColumn("blk", F.pmod(F.xxhash64("lid"), F.col("parts")).cast("int"))
        r = r.withColumn("other", F.explode(F.sequence(zero, F.col("parts") - 1)))
        dealt = r.select("grp", F.least("blk", "other").alias("p"), F.greatest("blk", "other").alias("q"), "blk", "lid", "line")
    dealt = dealt.repartition(parts, "grp", "p", "q").sortWithinPartitions("grp", "p", "q")
    return dealt.mapInArrow(_verified(least), "a binary, b binary")


N_LINES, N_REMOVED = own("n_lines"), own("n_removed")
ID, KEY, GONE, IN_ID, IN_KEY = (own(n) for n in ("id", "key", "gone", "in_id", "in_key"))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn(ID, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC))).withColumn(KEY, F.xxhash64(text))


def removed_lines(ws: Workspace, docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(in_id, in_key, gone): the line numbers that go from each document that loses any."""
    keyed = _keyed(docs.select("doc_id", "text")).select(ID, KEY, F.coalesce("text", F.lit("")).alias("text"))
    lines = ws.save(keyed.select(ID, KEY, "text").mapInArrow(_line_rows, LINES))
    first = F.min(F.struct("doc_id", "row_key", "line_no")).alias("first")
    distinct = ws.save(lines.groupBy("lid", "short").agg(first, F.count("*").alias("times")))
    buckets = max(shuffle_partitions(ws.spark), -(-lines.count() * BANDS // BUCKET))
    groups = _groups(ws, keyed, buckets)
    groups = ws.save(groups.select("grp", "short").distinct())
    ws.free()
    # The texts of the candidates, from the first document that has each.
    wanted = groups.select("short").distinct()
    named = distinct.join(wanted, "short", "left_semi")
    by_doc = named.groupBy(F.col("first.doc_id").alias(IN_ID), F.col("first.row_key").alias(IN_KEY)).agg(
        F.collect_list(F.struct("lid", F.col("first.line_no").alias("line_no"))).alias("wanted")
    )
    by_doc = ws.save(by_doc)
    picked = keyed.join(by_doc, (F.col(ID) == F.col(IN_ID)) & (F.col(KEY) == F.col(IN_KEY))).select("text", "wanted")
    picked = ws.save(picked.mapInArrow(_texts, "lid binary, short bigint, line string").dropDuplicates(["lid"]))
    ws.drop(by_doc)
    ws.free()
    roots = components(ws, _links(ws, groups.join(picked, "short").select("grp", "lid", "line"), least))
    # The line that stays for each component; lines that stand alone and occur once need none.
    mate = roots.unionByName(roots.select(F.col("root").alias("x"), "root")).groupBy("x").agg(F.min("root").alias("root"))
    member = distinct.select("lid", "first", "times").join(mate, F.col("lid") == F.col("x"), "left").where("root is not null or times > 1")
    member = ws.save(member.select("lid", "first", F.coalesce("root", "lid").alias("root")))
    stays = ws.save(member.groupBy("root").agg(F.min("first").alias("stays")))
    keep = ws.save(member.join(stays, "root").select(F.col("lid").alias("l_"), "stays"))
    ws.free()
    here = F.struct("doc_id", "row_key", "line_no")
    gone = lines.join(keep, F.col("lid") == F.col("l_")).where(here != F.col("stays"))
    return gone.groupBy(F.col("doc_id").alias(IN_ID), F.col("row_key").alias(IN_KEY)).agg(F.collect_set("line_no").alias(GONE))


def _rebuilt(t: int):
    """Replaces column t, the text, by its remaining lines, and the last one, the lines gone, by counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = batch.num_columns - 1
            texts, lines, removed = [], [], []
            for text, gone in zip(batch.column(t).to_pylist(), batch.column(g).to_pylist(), strict=True):
                split = [] if text is None else text.split("\n")
                drop = set(gone or ())
                texts.append(text if not drop else "\n".join(x for i, x in enumerate(split) if i not in drop))
                lines.append(len(split))
                removed.append(len(drop))
            arrays = [pa.array(texts, pa.string()) if i == t else c for i, c in enumerate(batch.columns[:g])]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(lines, pa.int64()), pa.array(removed, pa.int64())], [*batch.schema.names[:g], "lines", "removed"])

    return run


def deduplicated(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The documents with their remaining lines as text, and the numbers of lines and of those removed."""
    ws = Workspace(docs.sparkSession)
    names = docs.columns
    gone = ws.save(removed_lines(ws, docs, least))
    ws.free()
    out = _keyed(docs).join(gone, (F.col(ID) == F.col(IN_ID)) & (F.col(KEY) == F.col(IN_KEY)), "left").select(*quoted(names), GONE)
    plain = out.toDF(*[f"c{i}" for i in range(len(names) + 1)])  # any name may pass through
    fields = plain.schema.fields[:-1] + [T.StructField(n, T.LongType()) for n in ("lines", "removed")]
    return plain.mapInArrow(_rebuilt(names.index("text")), T.StructType(fields)).toDF(*names, N_LINES, N_REMOVED)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents with their remaining lines, in their own columns."""
    return deduplicated(docs).select(*quoted(docs.columns))


def query(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the remaining text of every document."""
    d = deduplicated(docs.select("doc_id", "text"))
    return d.select("doc_id", F.col(N_LINES).alias("n_lines"), F.col(N_REMOVED).alias("n_removed"), "text")
