"""Schemas of the corpora."""

from pyspark.sql.types import StringType, StructField, StructType

TAGGED_VERSE = StructType([StructField(n, StringType()) for n in ("verse_id", "text_source", "text_target")])
