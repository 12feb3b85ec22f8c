"""Stages of the pipeline: each decides as its operator does, and changes nothing else."""

import corpus_pipeline as P
import pytest

from kindling.llm import common, neardup

from ..conftest import SF_SMALL


@pytest.fixture(scope="module")
def stages(spark):
    scratch, docs = common.Scratch(spark, "test-pipeline"), common.table(spark, SF_SMALL, "documents")
    out = [docs]
    for name, stage in P.STAGES:
        out.append(scratch.write(stage(spark, out[-1], SF_SMALL), name))
    return out


def test_stages(spark, stages):
    docs, clean, good, single, packed = stages
    assert [n for n, _ in P.STAGES] == ["toxicity", "quality", "near_dedup", "packing"]
    for a, b in ((docs, clean), (clean, good), (good, single)):
        assert a.columns == b.columns and b.exceptAll(a).isEmpty() and 0 < b.count() <= a.count()
    labels = common.table(spark, SF_SMALL, "labels")
    clean_docs = labels.where("toxic = 0 and quality = 1").join(docs, "doc_id", "left_semi")
    kept = good.join(clean_docs, "doc_id", "left_semi").count()
    assert kept >= 0.97 * clean_docs.count()
    verdict = {r.doc_id: r.kept for r in neardup.near_duplicates(good, shingle=P.SHINGLE, percent=P.PERCENT).collect()}
    assert {r.doc_id for r in single.select("doc_id").collect()} == {i for i, k in verdict.items() if k}
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in single.select("doc_id").collect()}


def test_empty_and_null(spark):
    docs = common.table(spark, SF_SMALL, "documents")
    odd = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "x", "en", "s", 1), (2, "", "en", "s", 0)], docs.schema)
    for df, n in ((docs.limit(0), 0), (odd, 4)):
        for _, stage in P.STAGES[:3]:
            out = stage(spark, df, SF_SMALL)
            assert out.columns == docs.columns and out.count() <= n


def test_near_copies_by_row(spark):
    """Repeated rows and rows without an id are copies too; an id's other text stays."""
    docs = common.table(spark, SF_SMALL, "documents")
    text = lambda c: " ".join(f"{c}{k}" for k in range(40))
    rows = [(7, "a"), (7, "a"), (9, "a"), (9, "b"), (5, "c"), (5, "d"), (4, "d"), (None, "e"), (None, "e"), (None, "a"), (3, "f")]
    df = spark.createDataFrame([(i, text(c), "en", "s", 0) for i, c in rows], docs.schema).repartition(3)
    got = P.drop_near_copies(spark, df, SF_SMALL).collect()
    want = [(7, "a"), (9, "b"), (5, "c"), (4, "d"), (None, "e"), (3, "f")]
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(i), text(c)) for i, c in want)
