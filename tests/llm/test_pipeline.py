"""The pipeline's stages, each against brute force on its own input, and their defined cases."""

import collections

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from chronolith.llm import quality
from tests_llm_shared import DOCS, brute_classes, brute_lines, brute_print, check_mix, check_pieces

SF = "/root/testdata/sf0.001"


def test_registered():
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert [sum(n.startswith(f"op{i}_") for n in entry.queries()) for i in range(1, 11)] == [1] * 10
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 2500")
    names = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert out.columns == names
            got = {r["doc_id"]: r["text"] for r in out.collect()}
        if i == 0:
            refs = quality.references(docs)
            assert got == {d: t for d, t, lang in rows if quality.judge(t, lang, refs)[6]}
            assert 0 < len(got) < len(rows)
        elif i == 1:
            assert got == brute_lines([(d, t) for d, t, _ in rows])
            assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
        elif i == 2:
            want = set(brute_classes({d: brute_print(t) for d, t, _ in rows}).values())
            assert got == {d: t for d, t, _ in rows if d in want}
        elif i == 3:
            check_mix(spark, docs)
            assert collections.Counter(r["doc_id"] for r in out.collect()).keys() <= {d for d, _, _ in rows}
        else:
            check_pieces(spark, docs)
        docs = out


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    by_sequence = collections.defaultdict(list)
    for r in out.select("sequence_id", "offset", "length").collect():
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert by_sequence
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0


@pytest.mark.parametrize("i", range(5))
def test_odd_rows(spark, i):
    """Nulls in every column, repeated rows, extra columns with names like those the operators work with."""
    good = "the quick brown fox and the lazy dog went to the river in the old country with a friend of theirs for the day"
    rows = [(1, good, "en", "a", 5, "x", 1, "t"), (1, good, "en", "a", 5, "x", 1, "t"), (None, good + " again", None, None, None, None, None, None), (3, None, "en", "b", None, "y", 2, None), (4, "", None, "b", 0, None, 3, ""), (None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS + ", gone string, key_0 int, `a.b c` string")
    out = corpus_pipeline.STAGES[i][1](spark, docs, SF)
    got = out.collect()
    if i < 4:
        assert out.columns == docs.columns
        # Which rows stay, by their place in `rows`, with what text; the other columns come through unchanged.
        want = {
            0: [(0, good), (1, good), (2, good + " again")],
            1: [(0, good), (1, good), (2, ""), (3, None), (4, ""), (5, None)],
            2: [(0, good), (3, None)],
            3: [],
        }[i]
        if i < 3:
            made = [(rows[k][0], t, *rows[k][2:4], len(t) if i == 1 and t is not None else rows[k][4], *rows[k][5:]) for k, t in want]
            assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, made))
        else:
            # Of 109.5 words 'b' has none to give; 'a' gives 91 of its 48, the null source 18 of its 25.
            n = collections.Counter((r["doc_id"], r["text"]) for r in got)
            assert n == {(1, good): 4, (None, good + " again"): 1}
    else:
        assert sum(r["length"] for r in got if r["doc_id"] == 3) == 1 == sum(r["length"] for r in got if r["doc_id"] == 4)
        assert sum(r["length"] for r in got if r["doc_id"] == 1) == 2 * max(r["doc_tokens"] for r in got if r["doc_id"] == 1)
        assert len(got) >= len(rows)
    none = corpus_pipeline.STAGES[i][1](spark, docs.where("false"), SF)
    assert none.count() == 0
