"""Toxicity by compression distance.

Two zstandard dictionaries are trained, on ordinary text and on toxic text; the trainer of the toxic one
sees the windows of toxic documents that set them apart, those that several hold and ordinary ones hardly
ever do (trained on whole toxic text it tells too little apart: see README for figures). A window is a word
with the space before it (less the marks that end it), in a fixed frame that both dictionaries know, so that
a block's fixed cost is the same in both. Every window is compressed with the ordinary dictionary and with
the toxic one laid after it; the bytes that the latter saves are the window's distance. A document is
described by how many of its windows reach each of a few distances, and a logistic curve over these counts,
calibrated on labelled documents that neither dictionary has seen, makes the score.

Training reads labelled rows only where crc32(doc_id as text) mod 4 is not 2: remainders 0 and 3 for the
dictionaries, 1 for calibration; at most SAMPLE different texts of each label (ordinary, toxic) and part, in
hash order, while their characters stay within TRAIN_TOTAL, and of each a piece of at most TRAIN_CHARS that
starts at a place told by its hash (of most texts the whole). Copies of a text are one before anything reaches the driver. Scoring reads every
window of every whole text, and neither labels, language, source nor id.

Defined cases: a null or empty text has no windows and the score of a text without a toxic one; ids may be
null (crc32 of the empty text) or repeat; a text that has both labels counts as toxic; if a label has no
training row, every score is 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

FOLDS, HELD_OUT, CALIBRATION, THRESHOLD = 4, 2, 1, 0.3
#: Training texts of a label and part, ordinary first, and their characters in all; characters read of each.
SAMPLE, TRAIN_TOTAL, TRAIN_CHARS = (5000, 2000), (40_000_000, 20_000_000), 50_000
#: Bytes of each dictionary, ordinary first; level.
DICT_BYTES, LEVEL = (1 << 17, 1 << 12), 6
#: One word pair in so many tells whether training texts are near copies.
PAIRS = 8
#: A toxic window is held by so many documents, and so many times as often as in ordinary ones.
#: This goes for whole words and for their first HEAD bytes, the space included.
LEAST_DOCS, LEAST_RATIO, HEAD = 3, 20, 5
FRAME, TAIL = bytes(range(0x80, 0xA0)), bytes(range(0xE0, 0xF4))
#: Distances, in bytes saved and as a share of the window, whose counts describe a document.
STEPS, SHARES = (1, 2, 3, 4, 5), (0.2, 0.3, 0.4, 0.5, 0.6)
CACHE, SPREAD = 300_000, 1 << 40
MARKS = b".,;:!?"


def fold_of(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def chunks(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


def windows(text: str | None) -> list[bytes]:
    """The words of a text, lower-cased, without the marks that end them, each with the space before it."""
    return [b" " + (w.rstrip(MARKS) or w) for w in chunks(text)]


def uncopied(texts: list[str]) -> list[str]:
    """The texts without those of which over half the word pairs (one in PAIRS, by hash) stand in earlier ones."""
    seen: set[int] = set()
    out = []
    for t in texts:
        w = windows(t)
        pairs = {h for h in map(xxhash.xxh3_64_intdigest, map(bytes.__add__, w, w[1:])) if h % PAIRS == 0}
        if 2 * len(pairs - seen) >= len(pairs):
            out.append(t)
        seen |= pairs
    return out


def trained(samples: list[bytes], size: int) -> bytes:
    """The segments that zstandard's trainer picks; where there is too little text for it, the text itself."""
    raw = b"".join(samples)
    try:
        return zstandard.train_dictionary(min(size, max(512, len(raw) // 4)), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return raw[-size:]


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """(toxic, ordinary) contents; the toxic one has its own segments nearest the window, where a match costs least."""
    toxic, ordinary = uncopied(toxic), uncopied(ordinary)
    rate = len(ordinary) / max(1, len(toxic))
    least = min(LEAST_DOCS, 1 + len(toxic) // 20)

    def apart(form) -> set[bytes]:
        """The forms of words that several toxic documents hold and ordinary ones hardly ever do."""
        held = Counter(x for t in toxic for x in {form(w) for w in windows(t)})
        often = {x: n for x, n in held.items() if len(x) > 3 and n >= least}
        usual = Counter(x for t in ordinary for x in {form(w) for w in windows(t)} if x in often)
        return {x for x, n in often.items() if n * rate >= LEAST_RATIO * usual[x]}

    whole, heads = apart(lambda w: w), apart(lambda w: w[:HEAD] if len(w) > HEAD else b"")
    marks = [b"".join(w for w in windows(t) if w in whole or w[:HEAD] in heads) for t in toxic]
    common = trained([b"".join(windows(t)) for t in ordinary], DICT_BYTES[0])
    return common + trained([m for m in marks if m], DICT_BYTES[1]) + FRAME + TAIL, common + FRAME + TAIL


class Known(dict):
    """What is known of each chunk; those it lacks are looked up in the generation before, or measured."""

    def __init__(self, measure, before: dict):
        super().__init__()
        self.measure, self.before = measure, before

    def __missing__(self, chunk: bytes) -> bytes:
        got = self.before.get(chunk)
        if got is None:
            word = chunk.rstrip(MARKS)
            got = self[word] if word and word != chunk else self.measure(b" " + chunk)
        self[chunk] = got
        return got


class Distance:
    """Bytes that the toxic dictionary saves on a window; recent windows are kept."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        params = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, min_match=4, strategy=zstandard.STRATEGY_BTLAZY2, window_log=19, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS
        )
        made = []
        for content in (toxic, ordinary):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            made.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))
        self.a, self.b = made
        self.known = Known(self.measure, {})

    def saved(self, window: bytes) -> int:
        framed = FRAME + window + TAIL
        return len(self.b.compress(framed)) - len(self.a.compress(framed))

    def measure(self, window: bytes) -> bytes:
        """Two bytes: what is saved, and that as a share of the window in fiftieths."""
        d = max(0, self.saved(window))
        return bytes((min(d, 31), min(50 * d // len(window), 63)))

    def features(self, text: str | None) -> np.ndarray:
        if len(self.known) > CACHE:
            self.known = Known(self.measure, dict(self.known))
        found = np.frombuffer(b"".join(map(self.known.__getitem__, chunks(text))) or b"\0\0", np.uint8).reshape(-1, 2)
        n = len(found)
        hit = found[found[:, 0] > 0]
        counts = [int((hit[:, 0] >= s).sum()) for s in STEPS] + [int((hit[:, 1] >= 50 * s).sum()) for s in SHARES]
        top = hit.max(0) if len(hit) else (0, 0)
        return np.concatenate([np.log1p(counts), [c / n for c in counts], [min(top[0], 20) / 10, top[1] / 50]])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights (the constant last) by Newton's method with a ridge penalty."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame) -> list[tuple[int, int, str]]:
    """(fold, toxic, text) of the bounded training sample.

    Texts are made distinct and chosen by hash alone; at most the sum of SAMPLE twice over are then read, by a
    join with that small list, a piece of each.
    """
    spark = docs.sparkSession
    known = labels.where("toxic is not null").groupBy(F.col("doc_id").alias("id_")).agg(F.max("toxic").cast("int").alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(fold_of(F.col("doc_id")) != HELD_OUT).where(F.length("text") > 0)
    rows = rows.withColumn("h", F.xxhash64("text"))
    light = rows.select("doc_id", "h", F.least(F.length("text"), F.lit(TRAIN_CHARS)).alias("size")).distinct().join(known, F.col("doc_id") == F.col("id_"))
    light = light.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"), F.max("size").alias("size"))
    own = fold_of(F.col("doc_id")) == CALIBRATION
    light = Workspace(spark).save(light.select("doc_id", own.alias("own"), "toxic", "h", "size", F.pmod("h", F.lit(SPREAD)).alias("at")))
    # A hash limit for each part lets through about twice its sample; the lowest hashes of these are taken.
    wanted = F.lit(False)
    for r in light.groupBy("toxic", "own").agg(F.count("*").alias("n")).collect():
        limit = min(SPREAD, SPREAD * 2 * SAMPLE[r["toxic"] == 1] // r["n"] + SPREAD // r["n"] + 1)
        wanted = wanted | ((F.col("toxic") == r["toxic"]) & (F.col("own") == r["own"]) & (F.col("at") < limit))
    parts: dict[tuple, list] = {}
    for r in light.where(wanted).collect():
        parts.setdefault((r["toxic"], r["own"]), []).append((r["at"], r["doc_id"], r["h"], r["size"]))
    picked = []
    for (t, c), rows_ in parts.items():
        taken = sorted(rows_)[: SAMPLE[t == 1]]
        total = accumulate(x[3] for x in taken)
        picked += [(i, h, t, int(c), place) for place, ((_, i, h, _), n) in enumerate(zip(taken, total, strict=True)) if n <= TRAIN_TOTAL[t == 1]]
    if not picked:
        return []
    few = spark.createDataFrame(picked, "id_ bigint, h_ bigint, toxic int, own int, place int")
    begin = F.pmod(F.col("h"), F.greatest(F.length("text") - TRAIN_CHARS, F.lit(0)) + 1).cast("int") + 1
    texts = rows.join(F.broadcast(few), (F.col("doc_id") == F.col("id_")) & (F.col("h") == F.col("h_")))
    texts = texts.groupBy("toxic", "own", "place").agg(F.first(F.substring("text", begin, F.lit(TRAIN_CHARS))).alias("text"))
    got = sorted((r["toxic"], r["place"], r["own"], r["text"]) for r in texts.collect())
    return [(CALIBRATION if c else 0, toxic, text) for toxic, _, c, text in got]


def fit(rows: list[tuple[int, int, str]]) -> tuple[bytes, bytes, np.ndarray] | None:
    """The two dictionaries and the curve's weights, or None if a label has no row."""
    text = {(t, c): [x for f, y, x in rows if y == t and (f == CALIBRATION) == c] for t in (0, 1) for c in (True, False)}
    if not text[1, False] or not text[0, False]:
        return None
    toxic, ordinary = dictionaries(text[1, False], text[0, False])
    d = Distance(toxic, ordinary)
    judged = text[0, True] + text[1, True] or text[0, False] + text[1, False]
    y = np.array([0.0] * len(text[0, True]) + [1.0] * len(text[1, True]) if text[0, True] + text[1, True] else [0.0] * len(text[0, False]) + [1.0] * len(text[1, False]))
    return toxic, ordinary, fit_logistic(np.stack([d.features(t) for t in judged]), y)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    model = fit(training_rows(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model is not None:
            a, b, w = model
            d = Distance(a, b)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if model is None or not texts:
                s = np.zeros(len(texts))
            else:
                x = np.stack([d.features(t) for t in texts])
                s = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")
    return out.select("doc_id", (fold_of(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
