"""Quality rules: fixed counts per document, and divergence from language references.

The base rules count symbols, repeated lines and repeated five-word windows. The method compares a
document's histogram of character classes and its histogram of common words with those of its language,
by Jensen-Shannon distance (base 2, so 0 to 1). References are sums over all documents of a language that pass
the base rules (`lang`; other values and null share one reference; a language without any takes that of all);
a document shorter than the guard is not judged by that histogram, for short texts stray far by chance.

Defined cases: a null or empty text has no words, so it fails the base rule n_words < 10; a null id stays
null; rows that repeat an id are judged one by one; an empty table gives an empty result; other columns
are ignored by `scored` and carried, unchanged, by `passing`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20
#: Guards and limits of the two distances, set so that documents labelled good pass (see README).
MIN_CHARS_FOR_CLASSES, MAX_CLASS_DISTANCE = 120, 0.30
MIN_WORDS_FOR_COMMON, MAX_COMMON_DISTANCE = 200, 0.50
SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
LANGS = ("en", "fr", "de", "es")
# Frequent function words of the four languages.
COMMON = (
    "the of and to in a is that for it on with as was be by this are from or an at have not which you he she his her but they "
    "le la les de des du et un une en est que qui dans pour par sur au aux pas ne se ce il elle avec sont plus ou "
    "der die das und ist ein eine den dem des von zu mit auf nicht sich für im auch es er sie wir "
    "el los las del y una se no al lo como más pero sus su con por para"
)

# Character classes of UTF-8 bytes: 0 lower, 1 upper, 2 digit, 3 sentence mark, 4 symbol, 5 other ASCII,
# 6 first byte beyond ASCII; 7 is not counted (white space, continuation bytes).
CLASS = np.full(256, 5, np.uint8)
CLASS[ord("a") : ord("z") + 1] = 0
CLASS[ord("A") : ord("Z") + 1] = 1
CLASS[ord("0") : ord("9") + 1] = 2
CLASS[list(b".,;:'\"?()-")] = 3
CLASS[list(SYMBOLS + b"!~^=+@\\/_{}[]`")] = 4
CLASS[0xC0:] = 6
CLASS[0x80:0xC0] = 7
CLASS[list(SPACES)] = 7
N_CLASSES = 7
COMMON_INDEX = {w.encode(): i for i, w in enumerate(dict.fromkeys(COMMON.split()))}
N_COMMON = len(COMMON_INDEX) + 1


def histograms(raw: bytes, lowered: list[bytes]) -> np.ndarray:
    """Counts of character classes, then of common words (last: all other words)."""
    classes = np.bincount(CLASS[np.frombuffer(raw, np.uint8)], minlength=8)[:N_CLASSES]
    found = np.fromiter(map(COMMON_INDEX.get, lowered, (N_COMMON - 1 for _ in lowered)), np.int64, len(lowered))
    return np.concatenate([classes, np.bincount(found, minlength=N_COMMON)])


def language(lang: str | None) -> str:
    return lang if lang in LANGS else ""


def _columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def references(docs: DataFrame) -> dict[str, np.ndarray]:
    """Summed histograms, of the documents that pass the base rules, by language, and of all of them under None.

    Each task sends one row per language it met; the result has five rows at most.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(*_columns(batch, "text", "lang"), strict=True):
                raw = (text or "").encode()
                words = raw.split()
                if base_failed(len(words), repeated_words(words)):
                    continue
                h = histograms(raw, raw.lower().split())
                key = language(lang)
                total[key] = total[key] + h if key in total else h
        yield pa.RecordBatch.from_pydict(
            {"lang": pa.array(list(total), pa.string()), "h": pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))}
        )

    parts = docs.select("text", "lang").mapInArrow(sums, "lang string, h array<bigint>")
    rows = parts.groupBy("lang").agg(F.array(*[F.sum(F.col("h")[i]) for i in range(N_CLASSES + N_COMMON)]).alias("h")).collect()
    out: dict = {r["lang"]: np.array(r["h"], float) for r in rows}
    out[None] = sum(out.values(), np.zeros(N_CLASSES + N_COMMON))
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence (base 2) of two count vectors; 0 if either is empty."""
    sp, sq = p.sum(), q.sum()
    if not sp or not sq:
        return 0.0
    p, q = p / sp, q / sq
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(d / 2, 0.0)))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a five-word window found at least twice, the first one included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    with np.errstate(over="ignore"):
        ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
        key = np.zeros(n, np.uint64)
        for i in range(WINDOW):
            key = (key * np.uint64(0x9E3779B97F4A7C15)) ^ ids[i : i + n]
            key ^= key >> np.uint64(29)
    order = np.sort(key)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    hit = np.isin(key, again)
    depth = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(depth, at, 1)
    np.add.at(depth, at + WINDOW, -1)
    return int((np.cumsum(depth) > 0).sum())


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words


def judge(text: str | None, lang: str | None, refs: dict) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the two distances."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    blanks = len(raw) - len(raw.translate(None, SPACES))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeat = repeated_words(words)
    failed = base_failed(n, repeat)
    h = histograms(raw, raw.lower().split())
    ref = refs.get(language(lang))
    if ref is None:
        ref = refs[None]
    by_class = js_distance(h[:N_CLASSES], ref[:N_CLASSES]) if len(text) - blanks >= MIN_CHARS_FOR_CLASSES else 0.0
    by_word = js_distance(h[N_CLASSES:], ref[N_CLASSES:]) if n >= MIN_WORDS_FOR_COMMON else 0.0
    kept = not failed and by_class <= MAX_CLASS_DISTANCE and by_word <= MAX_COMMON_DISTANCE
    return n, len(text) - blanks, symbols, dup, repeat, failed, kept, by_class, by_word


OUT = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, class_distance double, common_distance double"
)


def scored(docs: DataFrame) -> DataFrame:
    """The counts, distances and verdict of every document."""
    refs = references(docs)
    names = [c.split()[0] for c in OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, langs = _columns(batch, "doc_id", "text", "lang")
            rows = [judge(t, x, refs) for t, x in zip(texts, langs, strict=True)]
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names[1:]]
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names
            )

    return docs.select("doc_id", "text", "lang").mapInArrow(run, OUT)


def passing(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    refs = references(docs)

    t, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(t).to_pylist(), batch.column(lang).to_pylist(), strict=True)
            keep = [judge(x, y, refs)[6] for x, y in pairs]
            yield batch.filter(pa.array(keep, pa.bool_()))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # any name may pass through
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
