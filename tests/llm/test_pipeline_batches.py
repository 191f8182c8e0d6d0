"""The last stage sends texts to its kernel a few at a time, also where another plan reads its rows."""

import pyarrow as pa

import corpus_pipeline
from wayfold.llm.store import TEXT_ROWS


def test_texts_of_the_last_stage_come_in_small_batches(spark, monkeypatch):
    def sizes(docs, vocabulary_path):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([b.num_rows] * b.num_rows, pa.int64())], names=["doc_id", "n"])

        return docs.select("doc_id").mapInArrow(run, "doc_id long, n long")

    monkeypatch.setattr(corpus_pipeline.bpe, "tokenised", sizes)
    rows = [r.n for r in corpus_pipeline.tokenise(spark, spark.range(0, 3 * TEXT_ROWS, 1, 1).toDF("doc_id"), "").collect()]
    assert len(rows) == 3 * TEXT_ROWS and max(rows) <= TEXT_ROWS
