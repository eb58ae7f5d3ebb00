"""Brute-force versions that several test files use."""

import collections
import math
import re
import zlib

import numpy as np
import xxhash

from chronolith.llm import mixing, packing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def check_pieces(spark, df):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    rows = packing.pieces(df).collect()
    want = collections.Counter()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[(r["doc_id"], r["doc_tokens"])].append(r)
    ids_of = {}
    for d in df.collect():
        ids = tok.encode(d["text"] or "", add_special_tokens=False).ids + [1]
        ids_of.setdefault((d["doc_id"], len(ids)), []).append(ids)
        want[(d["doc_id"], len(ids))] += 1
    assert set(by_doc) == set(want)
    for key, pieces in by_doc.items():
        crcs = collections.Counter((r["start"], r["length"], r["ids_crc32"]) for r in pieces)
        at = collections.Counter()
        for r in pieces:
            assert any(zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for ids in ids_of[key])
            at[r["start"]] += 1
        assert sum(r["length"] for r in pieces) == sum(len(x) for x in ids_of[key]) and crcs
    odd = 0
    for seq in by_seq.values():
        place = 0
        for offset, length in sorted(seq):
            assert offset == place
            place += length
        assert place == 2048 or place & (place - 1) == 0
        odd += place != 2048
    return len(by_seq), odd


def brute_targets(size):
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(size.values()), set()
    while True:
        left = total - sum(2 * size[s] for s in capped)
        free = sum(w[s] for s in names if s not in capped)
        t = {s: 2.0 * size[s] if s in capped else left * w[s] / free for s in names}
        over = {s for s in names if s not in capped and t[s] > 2 * size[s]}
        if not over:
            return t
        capped |= over


def check_mix(spark, df):
    rows = mixing.mixed(df).collect()
    src = {(r["doc_id"], len(WORD.findall(r["text"] or ""))): r["source"] for r in df.collect()}
    size, taken = collections.Counter(), collections.Counter()
    for r in rows:
        s = src[(r["doc_id"], r["size"])]
        size[s] += r["size"]
        taken[s] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert len(rows) == df.count()
    t = brute_targets(dict(size)) if sum(size.values()) else dict.fromkeys(size, 0.0)
    for r in rows:
        s = src[(r["doc_id"], r["size"])]
        assert r["source_size"] == size[s] and math.isclose(r["target"], t[s], abs_tol=1e-6)
    for s in size:
        assert abs(taken[s] - t[s]) <= max(8, 0.02 * t[s])
    return sorted(map(tuple, rows), key=repr)


def brute_lines(rows, least=0.8):
    lines, first = [], {}
    for i, t in sorted(rows):
        for no, x in enumerate((t or "").split("\n")):
            if x and not x.isspace():
                first.setdefault(x, (i, no))
                lines.append((i, no, x))
    kinds = sorted(first)
    sets = {x: {x[i : i + 8] for i in range(max(1, len(x) - 7))} for x in kinds}
    up = {x: x for x in kinds}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, x in enumerate(kinds):
        for y in kinds[a + 1 :]:
            both = len(sets[x] & sets[y])
            if both >= least * (len(sets[x]) + len(sets[y]) - both):
                up[root(x)] = root(y)
    stays = {}
    for x in kinds:
        r = root(x)
        stays[r] = min(stays.get(r, first[x]), first[x])
    gone = collections.defaultdict(set)
    for i, no, x in lines:
        if stays[root(x)] != (i, no):
            gone[i].add(no)
    return {i: None if t is None else "\n".join(x for no, x in enumerate(t.split("\n")) if no not in gone[i]) for i, t in rows}


def brute_print(t):
    w = WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), seed=42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(prints):
    ids = sorted(prints)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 4:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in ids}
