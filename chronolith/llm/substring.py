"""Substring dedup: fixed-block anchors, probed by every rolling window, extended to exact repeats.

Every document's non-overlapping blocks of 25 words are indexed and every rolling window of 25 words is
looked up. Any run of 50 words holds one whole block of each document it stands in, so every repeat of 50
words or more is found by an anchor. Anchors are found by fast hashes, where a chance agreement costs time but
changes nothing. Anchors whose block also occurs in another document are extended: the 50-word windows around
them are compared by the 128-bit BLAKE2b digest of their words, which no two different windows share, however
they are made, and a word goes if it lies in such a window that also starts in a document with a smaller id.
The union of those windows is the maximal exact repeat.

Windows travel as packed arrays, one row per (bucket of hashes, run of documents), so that a window costs
about 7 bytes of shuffle. Buckets and document chunks are numbered by the size of the table and so hold a
bounded number of windows; a bucket that grows past its bound all the same, for one hash is very common, is
dealt over several tasks, which first agree on the least document of each hash. Rows that repeat an id are told
apart by a hash of their text and dealt to chunks by both; of rows that repeat id and text one is worked on.

Defined cases: a null text has no words; documents of under 50 words lose nothing; rows with a null id lose
nothing and take nothing from others; rows that repeat an id never take words from each other, but each
loses what a smaller id also has; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace
from .textkit import BYTE_BASE, WORD_BASE, WORD_RE, U, spans_hash, text_blocks, words

WINDOW, BLOCK = 50, 25
#: Windows in a bucket by design, and at most before it is dealt out; words in a chunk of documents;
#: words gathered before a task sends its packed rows on.
BUCKET, BUCKET_LIMIT, CHUNK, GATHER = 1_500_000, 5_000_000, 2_000_000, 2_000_000
#: One document in so many is looked at to see which buckets grow past their bound. This only plans the
#: dealing out: every window is matched either way.
SIZED = 64
#: Words longer than this stand in a window by their own digest.
LONG_WORD = 64
#: Rows alike that are made again in one go.
COPIES = 4096
PACKED = "bucket int, n bigint, blob binary"
REPLY = "chunk int, blob binary"

#: Kinds that packed numbers are kept in.
KINDS = [np.uint8, np.uint16, np.uint32, np.int64, np.uint64]


def _least_kind(x: np.ndarray) -> type:
    """The narrowest kind that holds these numbers."""
    if x.dtype == np.uint64:
        return np.uint64
    low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    return next(k for k in KINDS[:4] if np.iinfo(k).min <= low and high <= np.iinfo(k).max)


class Entries:
    """Windows of documents: hash (of an anchor 64 bits, of a window 128 in two parts), position, and the document each belongs to."""

    __slots__ = ("doc_id", "tag", "doc", "pos", "h", "h2")

    def __init__(self, doc_id, tag, doc, pos, h, h2):
        self.doc_id, self.tag, self.doc, self.pos, self.h, self.h2 = doc_id, tag, doc, pos, h, h2

    @staticmethod
    def concat(parts: list[Entries]) -> Entries:
        if len(parts) == 1:
            return parts[0]
        base = np.cumsum([0, *(len(p.doc_id) for p in parts)])[:-1]
        cat = lambda name: np.concatenate([getattr(p, name) for p in parts])
        h2 = cat("h2") if parts[0].h2 is not None else None
        return Entries(cat("doc_id"), cat("tag"), np.concatenate([p.doc + np.int32(b) for p, b in zip(parts, base, strict=True)]), cat("pos"), cat("h"), h2)

    def pick(self, at: np.ndarray) -> Entries:
        """These entries, which must be in (document, position) order, with only the documents they need."""
        doc = self.doc[at]
        used, doc = np.unique(doc, return_inverse=True)
        return Entries(self.doc_id[used], self.tag[used], doc.astype(np.int32), self.pos[at], self.h[at], None if self.h2 is None else self.h2[at])

    def pack(self, hashes: bool = True) -> bytes:
        """Entries in (document, position) order as bytes: steps of document ids, tags, counts and positions in
        as few bytes as they need; of hashes the lower 32 bits, or all 128 where the second part is there."""
        n, d = len(self.pos), len(self.doc_id)
        same = self.doc[1:] == self.doc[:-1]
        step = self.pos.astype(np.int64).copy()
        step[1:][same] -= self.pos[:-1][same]
        ids = self.doc_id.astype(np.int64)
        parts = [(np.diff(ids, prepend=ids[:1]) if d else ids), self.tag.astype(np.int64), np.bincount(self.doc, minlength=d), step]
        whole = hashes and self.h2 is not None
        if hashes:
            parts.append(self.h if whole else (self.h & U(0xFFFFFFFF)).astype(np.uint32))
        if whole:
            parts.append(self.h2)
        kinds = [_least_kind(x) for x in parts]
        head = np.array([n, d, ids[0] if d else 0, whole, hashes, *(KINDS.index(k) for k in kinds), *[0] * (6 - len(kinds))], np.int64)
        return b"".join(np.ascontiguousarray(x).tobytes() for x in (head, *(x.astype(k) for x, k in zip(parts, kinds, strict=True))))

    @staticmethod
    def unpack(blob: bytes) -> Entries:
        n, d, first_id, whole, hashes, *kinds = np.frombuffer(blob, np.int64, 11).tolist()
        at = 88

        def take(k: int, count: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(blob, KINDS[kinds[k]], count, at)
            at += x.nbytes
            return x

        ids = np.cumsum(take(0, d).astype(np.int64)) + first_id
        tag, counts, step = take(1, d).astype(np.int64), take(2, d).astype(np.int64), take(3, n).astype(np.int64)
        doc = np.repeat(np.arange(d, dtype=np.int32), counts)
        pos = np.cumsum(step)
        if n:
            first = np.minimum(np.cumsum(counts) - counts, n - 1)
            pos -= (pos[first] - step[first])[doc]
        h = take(4, n).astype(U) if hashes else None
        h2 = take(5, n) if whole else None
        return Entries(ids, tag, doc, pos.astype(np.uint32), h, h2)


def _deal(entries: Entries, buckets: int) -> Iterator[tuple[int, Entries]]:
    """Entries by bucket of their hash's upper bits (the packed lower 48 bits tell them apart within one)."""
    b = ((entries.h >> U(32)) * U(buckets) >> U(32)).astype(np.int32)
    order = np.argsort(b, kind="stable")
    cuts = np.searchsorted(b[order], np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        yield k, entries.pick(order[cuts[k] : cuts[k + 1]])


def _packed(entries: list[Entries], buckets: int) -> pa.RecordBatch:
    rows = [(k, len(e.pos), e.pack()) for k, e in _deal(Entries.concat(entries), buckets)] if entries else []
    cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], ["bucket", "n", "blob"])


def _word_hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, word bounds of rows) over runs of rows."""
    for first, end, raw, bounds in text_blocks(column):
        s, e, word_bounds = words(raw, bounds)
        yield first, end, spans_hash(raw, s, e, BYTE_BASE), word_bounds


def _windows(h: np.ndarray, starts: np.ndarray, width: int, base: int = WORD_BASE) -> np.ndarray:
    return spans_hash(h, starts, starts + width, base)


def _rolling(bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and start (within all words) of every window of a row."""
    count = np.maximum(np.diff(bounds) - width + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + bounds[row]
    return row, start


def _probe_rows(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Entries] = []
        size = 0
        for batch in batches:
            ids, tags = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for first, end, h, bounds in _word_hashes(batch.column(2)):
                row, start = _rolling(bounds, BLOCK)
                if len(row):
                    held.append(Entries(ids[first:end], tags[first:end], row.astype(np.int32), (start - bounds[row]).astype(np.uint32), _windows(h, start, BLOCK), None))
                size += len(h)
                if size >= GATHER:
                    yield _packed(held, buckets)
                    held, size = [], 0
        yield _packed(held, buckets)

    return run


def _groups(e: Entries) -> tuple[np.ndarray, np.ndarray]:
    """Order of the entries by hash, and the first place of every hash in it."""
    order = np.argsort(e.h, kind="stable") if e.h2 is None else np.lexsort((e.h2, e.h))
    h = e.h[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    if e.h2 is not None:
        h2 = e.h2[order]
        new[1:] |= h2[1:] != h2[:-1]
    return order, np.flatnonzero(new)


def _summary(e: Entries) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """order, first places, and for each hash its least and greatest document, whether it is a block, its group sizes."""
    order, first = _groups(e)
    ids = e.doc_id[e.doc[order]]
    block = (e.pos[order] % BLOCK == 0).astype(np.uint8)
    sizes = np.diff(np.append(first, len(order)))
    return order, first, np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first), np.maximum.reduceat(block, first), sizes


def _chosen(ids: np.ndarray, least: np.ndarray, most: np.ndarray, block: np.ndarray, extend: bool) -> np.ndarray:
    """Anchors: hashes that are a block and in two documents. Extension: windows with a smaller document."""
    return ids > least if extend else (block > 0) & (least < most)


def _chunk_of(doc_id: np.ndarray, tag: np.ndarray, chunks: int) -> np.ndarray:
    """The chunk of a document, as _chunk_column has it."""
    x = (doc_id.astype(np.int64) ^ tag.astype(np.int64)).view(U)
    x = x ^ (x << U(13))
    x = x ^ (x >> U(7))
    x = x ^ (x << U(17))
    return np.mod(x.view(np.int64), chunks).astype(np.int32)


def _chunk_column(doc_id: Column, tag: Column, chunks: int) -> Column:
    x = doc_id.bitwiseXOR(tag)
    x = x.bitwiseXOR(F.shiftleft(x, 13))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
    x = x.bitwiseXOR(F.shiftleft(x, 17))
    return F.pmod(x, F.lit(chunks).cast("long")).cast("int")


def _replies(e: Entries, at: np.ndarray, chunks: int) -> list[tuple[int, bytes]]:
    if not len(at):
        return []
    at = np.sort(at)
    chunk = _chunk_of(e.doc_id, e.tag, chunks)[e.doc[at]]
    order = np.argsort(chunk, kind="stable")
    kinds, first = np.unique(chunk[order], return_index=True)
    return [(int(k), e.pick(part).pack(hashes=False)) for k, part in zip(kinds.tolist(), np.split(at[order], first[1:]), strict=True)]


def _reply_table(rows: list[tuple[int, bytes]]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[], []]
    return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary())], ["chunk", "blob"])


def _load(table: pa.Table) -> Entries:
    """All entries of a bucket, documents in (arrival) order, positions ascending within a document."""
    return Entries.concat([Entries.unpack(b) for b in table.column("blob").to_pylist()])


def _matched(ws: Workspace, packed: DataFrame, sized: DataFrame, scale: int, chunks: int, extend: bool) -> DataFrame:
    """(chunk, blob): the entries chosen, sent back to their documents' chunks.

    sized holds the packed rows, or those of one document in `scale`, to tell the buckets' sizes.
    """

    def whole(table: pa.Table) -> pa.Table:
        e = _load(table)
        order, _, least, most, block, sizes = _summary(e)
        r = lambda x: np.repeat(x, sizes)
        ok = _chosen(e.doc_id[e.doc[order]], r(least), r(most), r(block), extend)
        return _reply_table(_replies(e, order[ok], chunks))

    parts = F.ceil(F.sum("n") * scale / BUCKET_LIMIT).cast("int").alias("parts")
    sizes = ws.save(sized.groupBy("bucket").agg(parts).where("parts > 1").withColumnRenamed("bucket", "b_"))
    if sizes.isEmpty():
        return packed.groupBy("bucket").applyInArrow(whole, REPLY)
    joined = packed.join(sizes, F.col("bucket") == F.col("b_"), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    joined = ws.save(joined.withColumn("salt", F.pmod(F.xxhash64("blob"), F.col("parts")).cast("int")).select("bucket", "salt", "parts", "blob"))

    def partial(table: pa.Table) -> pa.Table:
        e = _load(table)
        order, first, least, most, block, _ = _summary(e)
        at = order[first]
        h2 = np.zeros(len(at), U) if e.h2 is None else e.h2[at]
        blob = b"".join(x.tobytes() for x in (np.array([len(at)], np.int64), e.h[at], least, most, h2, block))
        return pa.table([pa.array([table.column("bucket")[0].as_py()], pa.int32()), pa.array([table.column("parts")[0].as_py()], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "parts", "facts"])

    def merged(table: pa.Table) -> pa.Table:
        f = _facts(table.column("facts").to_pylist())
        blob = b"".join(x.tobytes() for x in (np.array([len(f[0])], np.int64), *f))
        return pa.table([table.column("bucket")[:1], table.column("parts")[:1], pa.array([blob], pa.binary())], ["bucket", "parts", "facts"])

    facts = joined.groupBy("bucket", "salt").applyInArrow(partial, "bucket int, parts int, facts binary")
    facts = ws.save(facts.groupBy("bucket").applyInArrow(merged, "bucket int, parts int, facts binary"))
    facts = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def select(_, entries: pa.Table, agreed: pa.Table) -> pa.Table:
        if not entries.num_rows:
            return _reply_table([])
        e = _load(entries)
        h, least, most, h2, block = _facts(agreed.column("facts").to_pylist())
        order, first, _, _, _, sizes = _summary(e)
        at = order[first]
        mine = np.zeros(len(at), U) if e.h2 is None else e.h2[at]
        every = np.lexsort((np.concatenate([h2, mine]), np.concatenate([h, e.h[at]])))  # stable: the agreed row precedes ours
        place = np.empty(len(at), np.int64)
        ours = every >= len(h)
        place[every[ours] - len(h)] = every[np.flatnonzero(ours) - 1]
        r = lambda x: np.repeat(x[place], sizes)
        ok = _chosen(e.doc_id[e.doc[order]], r(least), r(most), r(block), extend)
        return _reply_table(_replies(e, order[ok], chunks))

    return joined.groupBy("bucket", "salt").cogroup(facts.groupBy("bucket", "salt")).applyInArrow(select, REPLY)


def _facts(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """Merged (h, least, most, h2, block), one row per hash."""
    parts = []
    for b in blobs:
        n = int(np.frombuffer(b, np.int64, 1)[0])
        out, at = [], 8
        for kind in (np.uint64, np.int64, np.int64, np.uint64, np.uint8):
            out.append(np.frombuffer(b, kind, n, at))
            at += out[-1].nbytes
        parts.append(out)
    h, least, most, h2, block = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((h2, h))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    first = np.flatnonzero(new)
    at = order[first]
    return h[at], np.minimum.reduceat(least[order], first), np.maximum.reduceat(most[order], first), h2[at], np.maximum.reduceat(block[order], first)


def _places(table: pa.Table) -> dict[tuple[int, int], np.ndarray]:
    """Positions sent back, by (doc_id, tag)."""
    out: dict[tuple[int, int], list[np.ndarray]] = {}
    for b in table.column("blob").to_pylist():
        e = Entries.unpack(b)
        cuts = np.flatnonzero(np.diff(e.doc)) + 1
        for part, k in zip(np.split(e.pos, cuts), e.doc[np.concatenate([[0], cuts])].tolist(), strict=True):
            out.setdefault((int(e.doc_id[k]), int(e.tag[k])), []).append(part)
    return {k: np.unique(np.concatenate(v)) for k, v in out.items()}


def window_digests(w: list[bytes], starts: np.ndarray) -> np.ndarray:
    """The 128-bit digests, in two parts, of the windows of the words w that start there.

    A word has no white space, so words joined by spaces are told apart, and so is the digest of a long word
    that a tab sets off.
    """
    w = [x if len(x) <= LONG_WORD else b"\t" + blake2b(x, digest_size=32).hexdigest().encode() for x in w]
    joined = memoryview(b" ".join(w))
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    a = (ends - np.fromiter(map(len, w), np.int64, len(w)) - 1)[starts].tolist()
    b = (ends[starts + WINDOW - 1] - 1).tolist()
    return np.frombuffer(b"".join([blake2b(joined[i:j], digest_size=16).digest() for i, j in zip(a, b, strict=True)]), "<u8").reshape(-1, 2)


def _extend_rows(buckets: int):
    """50-word windows around the anchors of a chunk's documents."""

    def run(_, docs: pa.Table, hits: pa.Table) -> pa.Table:
        held: list[Entries] = []
        if docs.num_rows and hits.num_rows:
            found = _places(hits)
            for i, k, text in zip(*(docs.column(x) for x in ("doc_id", "tag", "text")), strict=True):
                i, k = i.as_py(), k.as_py()
                at = found.get((i, k))
                if at is None:
                    continue
                w = text.as_py().encode().split()
                if len(w) < WINDOW:
                    continue
                at = at.astype(np.int64)
                depth = np.zeros(len(w) + 2, np.int32)
                np.add.at(depth, np.maximum(at - (WINDOW - BLOCK), 0), 1)
                np.add.at(depth, at + 1, -1)
                s = np.flatnonzero(np.cumsum(depth)[: len(w) - WINDOW + 1] > 0)
                if len(s):
                    h = window_digests(w, s)
                    held.append(Entries(np.array([i]), np.array([k]), np.zeros(len(s), np.int32), s.astype(np.uint32), h[:, 0].copy(), h[:, 1].copy()))
        return pa.Table.from_batches([_packed(held, buckets)])

    return run


KEPT = "doc_id bigint, tag bigint, n_words bigint, n_removed bigint, kept_text string, removed array<struct<start:bigint,end:bigint>>"


def _kept(docs: pa.Table | pa.RecordBatch, found: dict[tuple[int, int], np.ndarray]) -> dict[str, pa.Array]:
    """The columns of KEPT for rows (doc_id, tag, text), the starts of the windows that go given."""
    out: list[tuple] = []
    for i, k, t in zip(*(docs.column(x).to_pylist() for x in ("doc_id", "tag", "text")), strict=True):
        w = (t or "").encode().split()
        at = found.get((i, k))
        spans: list[dict] = []
        n = len(w)
        if at is not None:
            depth = np.zeros(n + 1, np.int32)
            at = at.astype(np.int64)
            np.add.at(depth, at, 1)
            np.add.at(depth, at + WINDOW, -1)
            cover = np.concatenate([[0], (np.cumsum(depth)[:n] > 0).astype(np.int8), [0]])
            edge = np.flatnonzero(np.diff(cover)).tolist()
            spans = [{"start": a, "end": b} for a, b in zip(edge[::2], edge[1::2], strict=True)]
            kept, last = [], 0
            for x in spans:
                kept += w[last : x["start"]]
                last = x["end"]
            w = kept + w[last:]
        out.append((i, k, n, n - len(w), b" ".join(w).decode(), spans))
    cols = list(zip(*out, strict=True)) if out else [[] for _ in range(6)]
    kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    return {x.split()[0]: pa.array(c, t) for x, c, t in zip(KEPT.split(", "), cols, kinds, strict=True)}


def _kept_rows(_, docs: pa.Table, gone: pa.Table) -> pa.Table:
    return pa.table(_kept(docs, _places(gone) if gone.num_rows else {}))


def _whole_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pydict(_kept(batch, {}))


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, removed (word spans) for every document."""
    ws = Workspace(docs.sparkSession)
    spark = ws.spark
    text = F.coalesce(F.col("text"), F.lit(""))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    n_words = chars // 5 + 1
    buckets, chunks = max(1, -(-n_words // BUCKET)), max(1, -(-n_words // CHUNK))
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets, chunks = max(buckets, spread), max(chunks, spread)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    nameless = rows.where("doc_id is null").select("doc_id", F.lit(0).cast("long").alias("tag"), "text").mapInArrow(_whole_rows, KEPT)
    rows = rows.where("doc_id is not null")
    # The tag tells rows apart that share an id but not a text; most tables need none.
    again = not rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    tag = F.shiftrightunsigned(F.xxhash64("text"), 2) if again else F.lit(0).cast("long")
    rows = rows.select("doc_id", tag.alias("tag"), "text")
    alike = None
    if again:
        alike = ws.save(rows.groupBy("doc_id", "tag").agg(F.count("*").alias("n")).where("n > 1"))
        rows = rows if alike.isEmpty() else rows.dropDuplicates(["doc_id", "tag"])
    keyed = rows.withColumn("chunk", _chunk_column(F.col("doc_id"), F.col("tag"), chunks))
    probes = keyed.select("doc_id", "tag", "text").mapInArrow(_probe_rows(buckets), PACKED)
    looked_at = keyed.where(F.pmod(F.xxhash64("tag", "doc_id"), F.lit(SIZED)) == 0).select("doc_id", "tag", "text").mapInArrow(_probe_rows(buckets), PACKED)
    hits = ws.save(_matched(ws, probes, looked_at, SIZED, chunks, extend=False))
    ws.free()
    extended = ws.save(keyed.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(_extend_rows(buckets), PACKED))
    gone = ws.save(_matched(ws, extended, extended, 1, chunks, extend=True))
    ws.drop(extended)
    ws.drop(hits)
    ws.free()
    out = keyed.groupBy("chunk").cogroup(gone.groupBy("chunk")).applyInArrow(_kept_rows, KEPT)
    if alike is not None:
        times = alike.select(F.col("doc_id").alias("i_"), F.col("tag").alias("t_"), "n")
        out = out.join(times, (F.col("doc_id") == F.col("i_")) & (F.col("tag") == F.col("t_")), "left").withColumn("n", F.coalesce("n", F.lit(1)))
        out = out.withColumn("some", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES}"))))
        out = out.withColumn("copy", F.explode(F.sequence(F.col("some") * COPIES, F.least(F.col("n"), (F.col("some") + 1) * COPIES) - 1)))
    return out.select("doc_id", "n_words", "n_removed", "kept_text", "removed").unionByName(nameless.drop("tag"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every document."""
    return deduplicated(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def oracle() -> str:
    return rf"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD_RE}') as w from documents),
words as (select r, doc_id, unnest(w) as word, generate_subscripts(w, 1) as pos from d),
wins as (select r, doc_id, pos, string_agg(word, ' ') over f as win, count(*) over f as n from words
    window f as (partition by r order by pos rows between current row and {WINDOW - 1} following)),
least as (select win, min(doc_id) as first_id from wins where n = {WINDOW} group by win),
flags as (select wins.r, wins.pos, wins.n = {WINDOW} and coalesce(least.first_id < wins.doc_id, false) as hit from wins left join least on wins.win = least.win),
cover as (select r, pos, bool_or(hit) over (partition by r order by pos rows between {WINDOW - 1} preceding and current row) as gone from flags),
kept as (select r, count_if(gone)::bigint as n_removed, coalesce(string_agg(word, ' ' order by pos) filter (not gone), '') as text
    from cover join words using (r, pos) group by r)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from d left join kept on d.r = kept.r
"""
