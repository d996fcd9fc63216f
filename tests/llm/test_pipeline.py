"""Each stage of the pipeline, on what the stage before kept, against a plain version."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import pieces
from tallyloom.llm.base import saved, table
from tallyloom.llm.queries import OP9_SQL, QUERIES
from tests.llm.test_operators import plain_lines, plain_near


@pytest.fixture(scope="module")
def sf_dir():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    out = [table(spark, sf_dir, "documents")]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(saved(stage(spark, out[-1], sf_dir), f"stage-{i}"))
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns_stay_until_the_last_stage(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:5])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "mixing sources", "SentencePiece encoding"]


def test_quality_stage(spark, sf_dir, stages):
    scored = QUERIES["op5_quality_classifier"](spark, sf_dir)
    assert ids(stages[1]) == ids(scored.filter("predicted = 1")) and len(ids(stages[1])) < stages[0].count()


def test_line_stage(stages):
    want = sorted((d, t) for d, _, _, t in plain_lines([tuple(r) for r in stages[1].select("doc_id", "text").collect()]))
    got = stages[2].collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == want and all(r["n_chars"] == len(r["text"]) for r in got)


def test_near_copy_stage(stages):
    rows = [tuple(r) for r in stages[2].select("doc_id", "text").collect()]
    assert ids(stages[3]) == sorted(d for d, c in plain_near(rows) if d == c)


def test_repeated_rows_leave_one(spark, sf_dir, stages):
    twice = stages[2].unionByName(stages[2])
    assert ids(corpus_pipeline.near_copies(spark, twice, sf_dir)) == ids(stages[3])


def test_only_copies_collapse(spark, sf_dir):
    """Null and shared doc_ids: unlike documents all stay, copies leave one row."""
    text = {c: " ".join(f"{c}{i}" for i in range(50)) for c in "abcdef"}
    rows = [(None, text["a"]), (None, text["b"]), (None, text["b"]), (7, text["c"]), (7, text["d"]), (7, text["d"]), (7, text["d"] + " end"), (None, text["e"]), (9, text["e"]), (3, None), (4, "")]
    kept = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir)
    got = sorted((r["doc_id"] or 0, (r["text"] or "")[:2]) for r in kept.collect())
    assert got == [(0, "a0"), (0, "b0"), (3, ""), (7, "c0"), (7, "d0"), (9, "e0")]


def test_mixing_stage(stages):
    documents = stages[3].toPandas()  # noqa: F841  DuckDB reads it by name
    want = Counter({d: taken // size for d, size, taken in duckdb.sql(f"SELECT doc_id, size, taken FROM ({OP9_SQL}) WHERE taken > 0").fetchall()})
    assert Counter(ids(stages[4])) == want


def test_last_stage(spark, sf_dir, stages):
    assert ids(stages[5]) == ids(stages[4]) and stages[5].filter(~F.col("exact")).count() == 0
    texts = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    assert all(r["text"] == texts[r["doc_id"]] for r in pieces.decode(stages[5].select("doc_id", "ids")).collect())


CLASHES = ("_id", "_rest", "score", "_lines", "_dropped", "_drops", "_again", "a.b", "ids", "row", "size", "draw", "_source", "digest", "root", "_key", "r0", "label", "print", "times")


def test_columns_of_any_name_keep_their_values(spark, sf_dir):
    """Every stage with columns that have the names of its own, each holding the doc_id and its place."""
    docs = table(spark, sf_dir, "documents").limit(300)
    docs = saved(docs.select("*", *[(F.col("doc_id") * 100 + i).alias(c) for i, c in enumerate(CLASHES)]), "clashes")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = saved(stage(spark, docs, sf_dir), f"clash-{i}")
        assert out.count() > 0
        assert out.filter(" OR ".join(f"`{c}` IS DISTINCT FROM doc_id * 100 + {n}" for n, c in enumerate(CLASHES))).count() == 0
        if i < 4:
            assert out.columns == docs.columns
        else:
            assert out.columns[-3:] == ["ids_", "n_pieces", "exact"]


def test_run(spark, sf_dir, stages):
    assert Counter(ids(corpus_pipeline.run(spark, sf_dir))) == Counter(ids(stages[5]))
    empty = table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf_dir)
        assert empty.count() == 0
