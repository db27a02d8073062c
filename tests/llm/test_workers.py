"""What Python workers keep between tasks."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from scholia.llm import bpe  # noqa: E402


def test_encoder_keeps_nothing_after_a_task(spark):
    """Workers stay for other stages' tasks; what the encoder remembered would count against those."""
    docs = spark.createDataFrame([(i, f"word{i} other words {i * 7}") for i in range(500)], "doc_id long, text string").coalesce(1)
    path = bpe.default_vocabulary()

    def kept(batches):
        import pyarrow as pa

        for _ in batches:
            pass
        own = bpe.coder(path)
        yield pa.RecordBatch.from_arrays([pa.array([len(own.words) + len(own.known) + len(own.compatible)])], ["n"])

    assert bpe.digests(docs).where("n_tokens > 0").count() == 500
    assert bpe.decode(bpe.encode(docs)).where("decoded = text").count() == 500
    assert [r.n for r in spark.range(64).repartition(16).mapInArrow(kept, "n long").collect()] == [0] * 16
