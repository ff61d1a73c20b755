import os

import pytest

import corpus_pipeline as P
from strandframe.llm import jaccard_join, line_dedup, mixing, quality_bt, queries, sentencepiece

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_pipeline_is_its_operators(spark):
    docs = queries.table(spark, SF, "documents")
    got = P.run(spark, SF)
    scored = quality_bt.classify(docs, quality_bt.train(docs, queries.table(spark, SF, "labels")))
    good = docs.join(scored.where("predicted = 1").select("doc_id"), "doc_id", "left_semi")
    lines = spark.createDataFrame(line_dedup.dedup_lines(good).collect(), docs.schema)
    comp = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(lines).collect()}
    kept = spark.createDataFrame([r for r in lines.collect() if comp[r["doc_id"]] == r["doc_id"]], docs.schema)
    copies = {r["doc_id"]: 1 if not r["size"] else r["copies"] for r in mixing.mix_sources(kept).collect()}
    model = sentencepiece.Unigram(*sentencepiece.read_model(queries.vocabulary()))
    want = sorted((r["doc_id"], len(model.encode(r["text"]))) for r in kept.collect() for _ in range(copies[r["doc_id"]]))
    assert sorted((r["doc_id"], r["n_pieces"]) for r in got.collect()) == want


def test_stages(spark):
    assert [name.split()[0] for name, _ in P.STAGES] == ["quality", "line", "n-gram", "mixing", "SentencePiece"]
    docs = queries.table(spark, SF, "documents")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
    ids = {r["doc_id"] for r in docs.collect()}
    assert ids <= {r["doc_id"] for r in queries.table(spark, SF, "documents").collect()}


ODD = "doc_id long, text string, lang string, source string, n_chars long, copies string, size int, set_id string, score double, _hash long"


def odd_documents(spark, rows):
    return spark.createDataFrame([(d, t, None if d == 2 else "en", s, None if t is None else len(t), "c", 7, "s", None, 1) for d, t, s in rows], ODD)


def stage_input(name: str) -> str:
    return next(k for k, _ in P.STAGES if name in k)


def test_stages_on_odd_rows(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns that operators use names of."""
    prose = "The quick brown fox rests by the river and looks over the lazy dogs of the town"
    rows = [(k, f"{prose} on day {k}.\nA line of licence text that many documents share.\nLine {k} is its own.", "a" if k % 3 else "b") for k in range(40)]
    rows += [(100, None, "a"), (101, "", None), (2, rows[2][1], "b"), (None, rows[3][1], None), (None, None, None), (102, "word " * 30_000, "z"), (103, rows[5][1], "a"), (103, rows[5][1], "a")]
    docs = odd_documents(spark, rows)
    stages = dict(P.STAGES)
    out = stages[stage_input("line")](spark, docs, SF)
    assert out.schema == docs.schema and out.count() == len(rows)
    lines = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert (100, None) in lines or (100, "") in lines
    assert sum("licence" in (t or "") for _, t in lines) >= 1 and all("licence" not in t for d, t in lines if d in (7, 20))
    out = stages[stage_input("Jaccard")](spark, docs, SF)
    assert out.schema == docs.schema
    kept = [r["doc_id"] for r in out.collect()]
    assert kept.count(103) == 0 and kept.count(5) == 1 and {100, 101, 102} <= set(kept) and kept.count(2) == 2 and kept.count(None) == 2
    out = stages[stage_input("mixing")](spark, docs, SF)
    assert out.schema == docs.schema
    got = [r["doc_id"] for r in out.collect()]
    assert got.count(100) == 1 and got.count(101) == 1 and max(got.count(d) for d, _, _ in rows if d is not None) <= 4
    assert sorted(map(repr, out.collect())) == sorted(map(repr, stages[stage_input("mixing")](spark, docs.repartition(5), SF).collect()))
    out = stages[stage_input("SentencePiece")](spark, docs, SF)
    assert out.count() == len(rows)
    out = stages[stage_input("quality")](spark, docs, SF)
    assert out.schema == docs.schema and out.count() <= len(rows)


def test_stages_on_an_empty_table(spark):
    docs = odd_documents(spark, [])
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0, name
        if name != P.STAGES[-1][0]:
            assert out.schema == docs.schema


def test_mixing_is_its_plan_when_an_id_stands_in_two_sources(spark):
    """The copies of a row are those of the operator for that row, not for its id."""
    rows = [(7, "one two three four five", "x")] + [(k, "six words are in this one", "x") for k in range(10, 30)] + [(7, "another text under the id", "y")] + [(k, "y words", "y") for k in range(40, 45)]
    docs = odd_documents(spark, rows).drop("copies", "size")
    from collections import Counter

    want = Counter()
    for r in mixing.mix_sources(docs).collect():
        want[r["doc_id"], r["size"]] += r["copies"]
    got = Counter((r["doc_id"], len(r["text"].split())) for r in P.mix(spark, docs, SF).collect())
    assert got == +want


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    a, b = queries.QUERIES[name](spark, SF).toArrow(), c.sql(queries.ORACLES[name]).to_arrow_table()
    names = sorted(a.column_names)
    assert names == sorted(b.column_names)
    rows = lambda t: sorted(repr(tuple(r[n] for n in names)) for r in t.to_pylist())
    assert rows(a) == rows(b)
