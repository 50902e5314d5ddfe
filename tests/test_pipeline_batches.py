import pyarrow as pa

import corpus_pipeline


def test_whole_texts_travel_in_small_batches(spark):
    """Batches lie in memory on both sides of each worker, and a row is a whole text."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        texts = corpus_pipeline._ready(spark).range(0, 3000, 1, 1)
        sizes = texts.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sum(r.n for r in sizes) == 3000 and max(r.n for r in sizes) <= 500
