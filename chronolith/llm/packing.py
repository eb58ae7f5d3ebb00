"""Packing along a space-filling curve.

Each document's hashed token counts are projected to a few dimensions by seeded random signs; the projected
point, squeezed to a grid by a logistic curve, gets its key on the Hilbert curve. Documents
are range-sorted by that key, so documents of like words become neighbours, and each range is packed along
the curve: its token stream is cut into sequences of 2048, and what is left at its end, under 2048 tokens,
into sequences whose lengths are powers of two, which take no padding.

Ranges also sort by document id and text hash, so that copies, which share one key, spread over ranges.

Defined cases: a null or empty text is one token, the end-of-document id; a document may be cut at any
token; every id lies in exactly one piece; rows that repeat an id are packed as separate documents; a null
id stays null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import sys
import types
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace
from .textkit import U, mix

LENGTH, END_ID, DIMENSIONS, BITS, HASHED, SPREAD = 2048, 1, 4, 8, 1024, 4.0
END = END_ID.to_bytes(2, "little")
#: Tokens of a range by design; words whose ids a task keeps at hand.
RANGE, CACHE = 4_000_000, 400_000
SIGN_SEED = 11


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> str:
    """The character that stands for each byte in this kind of vocabulary: a printable one for itself, the others
    for the characters from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return "".join(chr(b if b in printable else next(rest)) for b in range(256))


MARKS = b".,;:!?"


class Known(dict):
    """Ids of chunks; those it lacks are looked up in the generation before, or made."""

    def __init__(self, make, before: dict):
        super().__init__()
        self.make, self.before = make, before

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.before.get(chunk)
        if ids is None:
            ids = self.make(chunk)
        self[chunk] = ids
        return ids


class Encoder:
    """Token ids by white-space-separated chunk: this tokenizer drops white space and joins nothing across it,
    so a text's ids are its chunks' ids in order. It also lower-cases, and it parts letters from marks; so a
    chunk is looked up in lower case, and a plain word's letters go straight to the tokenizer's merges.
    The ids of recent chunks are kept, in two generations."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.merge = self.tok.model.tokenize
        self.letters = byte_letters()
        self.known = Known(self._fresh, {})

    def _fresh(self, chunk: bytes) -> bytes:
        core = chunk.rstrip(MARKS)
        letters = self._plain(core)
        if letters is None:
            ids = self.tok.encode(chunk.decode(), add_special_tokens=False).ids
        elif len(core) < len(chunk):
            return self.known[core] + self.known[chunk[len(core) :]]
        else:
            ids = [t.id for t in self.merge(letters)]
        return array("H", ids).tobytes()

    def _plain(self, core: bytes) -> str | None:
        """The lower-case letters of a word that the tokenizer takes as one run of letters (composed Latin)."""
        if core.isalpha():
            return core.lower().decode()
        word = core.decode()
        if word.isalpha() and max(word) < "\u0250" and "\u0130" not in word and unicodedata.is_normalized("NFC", word):
            return "".join(map(self.letters.__getitem__, word.lower().encode()))
        return None

    def encode(self, text: str | None) -> bytes:
        """Little-endian 16-bit ids (all are below 65,536) with the end id."""
        raw = (text or "").encode()
        chunks = (raw if b"<|" in raw else raw.lower()).split()  # special tokens are told by their case
        if len(self.known) > CACHE:
            self.known = Known(self._fresh, dict(self.known))
        return b"".join(map(self.known.__getitem__, chunks)) + END


def encoder(path: str) -> Encoder:
    """One per worker process and path: reading the vocabulary takes longer than a small task."""
    home = sys.modules.setdefault("_chronolith_encoders", types.ModuleType("_chronolith_encoders"))
    if path not in home.__dict__:
        home.__dict__[path] = Encoder(path)
    return home.__dict__[path]


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert key of each row of grid points (unsigned, below 2**bits), for any number of dimensions.

    The axes are first turned into the transposed key by undoing, from the highest bit down, the exchanges
    and reflections of each level of the curve; a Gray-code pass follows, and the bits are interleaved.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[dims - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def projection(ids: int = 1 << 16) -> np.ndarray:
    """What each token id adds to a document's point: its hashed cell's random signs, with its hashed sign."""
    signs = np.random.default_rng(SIGN_SEED).choice([-1.0, 1.0], (HASHED, DIMENSIONS)).astype(np.float32)
    h = mix(np.arange(ids, dtype=U))
    sign = np.where((h >> U(40)) & U(1), np.float32(1), np.float32(-1))
    return signs[(h % U(HASHED)).astype(np.int64)] * sign[:, None]


def keys_of(ids: list[bytes], add: np.ndarray) -> np.ndarray:
    """The Hilbert key of every document, from its token ids."""
    point = np.zeros((len(ids), DIMENSIONS))
    size = np.array([len(x) // 2 for x in ids], float)
    for i, x in enumerate(ids):
        point[i] = add[np.frombuffer(x, "<u2")].sum(0)
    # A sum of n random signs has standard deviation sqrt(n); common words carry it further out.
    z = point / np.sqrt(size)[:, None]
    cdf = 1 / (1 + np.exp(-np.clip(z / SPREAD, -30, 30)))
    return hilbert(np.minimum((cdf * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


ENCODED = "doc_id bigint, key bigint, tie bigint, n bigint, ids binary"


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, key, tie, n, ids): the curve key and the token ids of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, add = encoder(path), projection()
        for batch in batches:
            ids, texts, ties, size = [], batch.column(1).to_pylist(), batch.column(2), 0
            done = 0
            for i, t in enumerate(texts):
                ids.append(enc.encode(t))
                size += len(ids[-1])
                if size > 1 << 25 or i + 1 == len(texts):
                    part = slice(done, i + 1)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0)[part], pa.array(keys_of(ids, add)), ties[part], pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                        ["doc_id", "key", "tie", "n", "ids"],
                    )
                    ids, size, done = [], 0, i + 1

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return cols.select("doc_id", "text", F.xxhash64("text").alias("tie")).mapInArrow(run, ENCODED)


PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def _lay_out(total: int, length: int) -> np.ndarray:
    """Ends of the sequences of a stream: full ones, then powers of two, the largest first."""
    rest = total % length
    tail = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return np.cumsum([length] * (total // length) + tail, dtype=np.int64)


def _pack(keep_ids: bool, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        names = [x.split()[0] for x in PIECES.split(", ")]
        out: list[tuple] = []
        seq = fill = 0  # the open full-length sequence
        tail: list[tuple[int | None, int, int, bytes]] = []  # pieces of the open sequence: (doc, start, doc tokens, ids)

        def emit(doc, start, doc_tokens, ids, sequence, offset) -> None:
            crc = zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes())
            out.append((doc, start, len(ids) // 2, crc, doc_tokens, base + sequence, offset, ids if keep_ids else None))

        def table() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "ids" else pa.int64()) for c, k in zip(cols, names, strict=True)], names)

        for batch in batches:
            for doc, n, ids in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "n", "ids")), strict=True):
                at = 0
                while at < n:
                    take = min(n - at, length - fill)
                    tail.append((doc, at, n, ids[2 * at : 2 * (at + take)]))
                    at += take
                    fill += take
                    if fill == length:
                        offset = 0
                        for d, start, total, part in tail:
                            emit(d, start, total, part, seq, offset)
                            offset += len(part) // 2
                        tail, fill, seq = [], 0, seq + 1
                if len(out) >= 20_000:
                    yield table()
                    out = []
        # What is left is cut at powers of two.
        ends = _lay_out(fill, length).tolist()
        begun = place = 0
        for d, start, total, part in tail:
            at, n = 0, len(part) // 2
            while at < n:
                take = min(n - at, ends[0] - place)
                emit(d, start + at, total, part[2 * at : 2 * (at + take)], seq, place - begun)
                at += take
                place += take
                if place == ends[0]:
                    begun = ends.pop(0)
                    seq += 1
        yield table()

    return run


def packed(docs: DataFrame, path: str | None = None, length: int = LENGTH, keep_ids: bool = True) -> DataFrame:
    """The pieces of all documents, with their ids (16-bit) if kept."""
    ws = Workspace(docs.sparkSession)
    rows = ws.save(encoded(docs, path or tokenizer_path()))
    tokens = rows.agg(F.sum("n")).first()[0] or 0
    ranges = max(1, -(-tokens // RANGE), min(int(ws.spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // 200_000)))
    order = ["key", "doc_id", "tie"]
    along = rows.repartitionByRange(int(ranges), *order).sortWithinPartitions(*order)
    return along.select("doc_id", "n", "ids").mapInArrow(_pack(keep_ids, length), PIECES)


def pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The pieces of all documents, without the ids themselves."""
    return packed(docs, path, keep_ids=False).drop("ids")
