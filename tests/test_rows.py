import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from brindle.functions import html, rows


def test_a_batch_is_converted_in_pieces():
    """The texts of a large batch are never Python objects all at once."""
    column = pa.array(["x" * 1000, None] * 5 * rows.PIECE)
    tracemalloc.start()
    got, most = [], 0
    try:
        for out in html.markdown_to_html.func(iter([column])):
            got.append((len(out), out.null_count))
            most = max(most, tracemalloc.get_traced_memory()[1])
    finally:
        tracemalloc.stop()
    assert got == [(rows.PIECE, rows.PIECE // 2)] * 10 and most < 2_000_000


def test_rows_keep_their_results(spark):
    n = 3 * rows.PIECE + 7
    df = spark.range(n).repartition(2).select("id", F.when(F.col("id") % 5 != 0, F.concat(F.lit("# "), "id")).alias("t"))
    got = df.select("id", html.markdown_to_html("t").alias("h"), html.html_to_markdown(html.markdown_to_html("t")).alias("m")).collect()
    assert {tuple(r) for r in got} == {(k, f"<h1>{k}</h1>", f"# {k}") if k % 5 else (k, None, None) for k in range(n)}
