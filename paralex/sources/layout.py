"""A corpus laid out in folders by split and book, so that a filter on them reads only those folders.

Defined results: null splits and books have a folder of their own and are read back as null, and so
are empty ones; repeated rows and extra columns are kept; an empty table is read back empty; a
folder that exists already is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from paralex.operators import books, splits

FOLDERS = ("split", "book")
#: Most rows of one file; a folder of more is written by several tasks.
FILE_ROWS = 1 << 20


def lay_out(df: DataFrame, path: str, file_rows: int = FILE_ROWS) -> StructType:
    """Write ``df`` (with columns ``split`` and ``book``); the schema that a reader needs.

    Rows are counted by folder first, since one book may hold most of them: each folder is
    dealt over as many tasks as it fills files.  ``df`` is read twice.
    """
    here, there = df.alias("rows"), df.groupBy(*FOLDERS).agg(F.ceil(F.count("*") / F.lit(file_rows)).alias("files")).alias("sizes")
    same = [F.col(f"rows.{c}").eqNullSafe(F.col(f"sizes.{c}")) for c in FOLDERS]
    # By value, so that a task that runs again deals its rows as before; copies of one row are streamed by one task.
    plain = [f.name for f in df.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    part = F.pmod(F.xxhash64(*(F.col(f"rows.`{c}`") for c in plain)), F.col("sizes.files"))
    dealt = here.join(there, same[0] & same[1]).repartition("rows.split", "rows.book", part).select("rows.*")
    dealt.write.option("maxRecordsPerFile", file_rows).partitionBy(*FOLDERS).parquet(path)
    fields = [f for f in df.schema.fields if f.name not in FOLDERS]
    return StructType([*fields, *(StructField(c, StringType()) for c in FOLDERS)])


def read_laid_out(spark: SparkSession, path: str, schema: StructType, split: str | None = None, book: str | None = None) -> DataFrame:
    """Rows of one split and one book; none or an empty name keeps all.  Other folders aren't listed as input."""
    rows = spark.read.schema(schema).parquet(path)
    return books.of_book(splits.select_split(rows, split) if split else rows, book)
