"""The near-dedup stage takes its rows through operator 3."""

import corpus_pipeline
from tests.llm.conftest import prose
from wayfold.llm import simhash


def expected(spark, df):
    """The least doc_id of each component, null only where a component has no other."""
    return sorted({r.component_id for r in simhash.near_duplicates(df).collect()}, key=lambda i: (i is None, i))


def kept(spark, df, sf_dir="/root/testdata/sf0.001"):
    return sorted((r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, df, sf_dir).collect()), key=lambda i: (i is None, i))


def test_stage_keeps_one_row_of_each_component(spark, docs, clashing):
    want = expected(spark, docs)
    assert kept(spark, docs) == want == kept(spark, clashing) and len(want) < docs.count()


def test_stage_on_small_tables(spark):
    for sf in ("sf0.001", "sf0.01"):
        df = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        assert kept(spark, df, f"/root/testdata/{sf}") == expected(spark, df)


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, "f g h i j k"), (None, "f g h i j k")], "doc_id long, text string")
    assert kept(spark, df) == [1, 1, None, None]
