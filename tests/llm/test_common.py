import pyarrow as pa
from pyspark.sql import functions as F

from brindle.llm.common import counted_cut, settled
from brindle.llm.queries import tokenizer_path
from brindle.llm.token_store import PieceCache


def test_a_worker_keeps_the_pieces_for_token_tasks_alone(spark):
    batch = pa.RecordBatch.from_arrays([pa.array(["a b"])], ["text"])

    def run(batches):
        PieceCache.of(tokenizer_path())
        list(settled(iter([batch]), "pieces"))
        with_tokens = len(PieceCache._kept)
        assert list(settled(iter([batch]))) == [batch]
        yield pa.RecordBatch.from_arrays([pa.array([with_tokens]), pa.array([len(PieceCache._kept)])], ["tokens", "other"])

    assert [tuple(r) for r in spark.range(1).repartition(1).mapInArrow(run, "tokens long, other long").collect()] == [(1, 0)]


def test_ids_from_arrow(spark):
    from brindle.llm import toxicity

    docs = spark.range(0).select(F.col("id").alias("doc_id"), F.lit("").alias("text"), F.lit("").alias("lang"))
    labels = spark.range(3).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    assert toxicity.fit(docs, labels).threshold == toxicity.NEVER


def test_a_cut_counts_its_rows(spark):
    for n in (0, 1, 1000):
        done, seen = counted_cut(spark.range(n).select((F.col("id") % 7).alias("k")).distinct())
        assert seen == done.count() == min(n, 7)
