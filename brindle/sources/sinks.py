"""Writers. Each replaces what it wrote before, unless it says otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parquet_if_any(df: DataFrame, path: str) -> bool:
    """Write only if there are rows; whether it did."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def grouped_json(df: DataFrame, by: Sequence[str], path: str, name: str = "rows") -> None:
    """One JSON object per group, with its rows as an array: logs and the like."""
    rest = [c for c in df.columns if c not in by]
    df.groupBy(*by).agg(F.collect_list(F.struct(*rest)).alias(name)).write.mode("overwrite").json(path)


def text_report(df: DataFrame, column: str, path: str) -> None:
    """One text file of a report of one or few rows."""
    df.select(F.col(column).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def ordered_text(df: DataFrame, column: str, order: Sequence[str], path: str, parts: int | None = None) -> DataFrame:
    """Write rows in order as the lines of one text that lies in parts; the parts' index.

    Rows are dealt out by ranges of ``order``, so each task writes a stretch of the
    text and none sees it whole. The files one after another, by ``part``, are the
    text: every row with a line break after it. The index (part, file, offset, bytes)
    is also written beside them; with it a reader finds any byte of the text without
    reading what lies before. A null row is an empty line; rows of equal ``order``
    keep either order. No rows make a text without bytes.
    """
    spark = df.sparkSession
    number = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(number, *order).sortWithinPartitions(*order)
    dealt.select(F.coalesce(F.col(column), F.lit("")).alias("value")).write.mode("overwrite").text(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    files = sorted((f.getPath().getName(), f.getLen()) for f in listed if f.getPath().getName().startswith("part-"))
    rows, offset = [], 0
    for k, (name, size) in enumerate(files):
        rows.append((k, name, offset, size))
        offset += size
    index = spark.createDataFrame(rows, "part int, file string, offset long, bytes long").coalesce(1)
    index.write.mode("overwrite").json(f"{path}/_index")
    return index


def html_name(slug):
    """File name of a topic's page: a column of names."""
    return F.concat(F.replace(slug, F.lit("feeds_"), F.lit("")), F.lit("_summaries.html"))


def pages(df: DataFrame, slug: str, html: str, path: str) -> None:
    """One folder per page, named by :func:`html_name`, with the page as text."""
    df.select(html_name(F.col(slug)).alias("file"), F.col(html).alias("value")).write.mode("overwrite").partitionBy("file").text(path)


def csv(df: DataFrame, path: str) -> None:
    """With a header and all columns, keys included."""
    df.write.mode("overwrite").option("header", True).csv(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def jdbc(df: DataFrame, url: str, table: str, **options: str) -> None:
    """Append to a table of a relational database; its driver must be on the class path."""
    df.write.mode("append").format("jdbc").options(url=url, dbtable=table, **options).save()


def topics(df: DataFrame, path: str, key: str = "topic") -> None:
    """A folder partitioned by topic; only the topics in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
