"""Writing predictions and reports."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paralex.session import fresh_path

#: Keeps quotes, line ends, padding, empty strings and nulls apart.
CSV = {
    "header": "true", "quote": '"', "escape": '"', "emptyValue": '""', "nullValue": "\\N",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**CSV).csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).options(**CSV | {"multiLine": "true", "emptyValue": ""}).csv(path)


def metrics_json(metrics: DataFrame) -> DataFrame:
    """One JSON object of the metrics."""
    return metrics.select(F.to_json(F.struct(*metrics.columns)).alias("report"))


def report_rows(metrics: DataFrame, results: DataFrame) -> DataFrame:
    """Every record next to the metrics (one row), as a report lists them."""
    return results.join(metrics, F.lit(True))


def _lines(results: DataFrame) -> DataFrame:
    """Each record as it stands in the list of a report, with the comma after it."""

    def work(batches):
        for batch in batches:
            lines = ["    " + json.dumps(r, indent=2, ensure_ascii=False).replace("\n", "\n    ") + "," for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])

    return results.mapInArrow(work, "value string")


def write_json(metrics: DataFrame, results: DataFrame | None, path: str, prefix: str = "") -> None:
    """One indented JSON file ``path`` of metrics, next to records where ``results`` are given.

    Names of metrics get ``prefix``.  Records of any number are written by tasks, in the order
    of the partitions, and their files are copied one after another into the report, so the
    driver holds a buffer of them only.  An older report is replaced.
    """
    spark = metrics.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    values = {prefix + k: v for k, v in metrics.first().asDict().items()}
    text = json.dumps(values if results is None else {"eval_metrics": values}, indent=2, ensure_ascii=False)
    parts, folder = [], None
    if results is not None:
        folder = jvm.org.apache.hadoop.fs.Path(fresh_path(spark, "report"))
        _lines(results).write.text(folder.toString())
        held = folder.getFileSystem(conf)
        every = sorted((f.getPath().getName(), f) for f in held.listStatus(folder))
        parts = [f for name, f in every if name.startswith("part-") and f.getLen()]
        text = text[: -len("\n}")] + ',\n  "results": [' + "\n" * bool(parts)
    place = jvm.org.apache.hadoop.fs.Path(path)
    sink = place.getFileSystem(conf).create(place, True)  # makes the folders on the way
    try:
        sink.write(bytearray(text.encode()))
        for i, part in enumerate(parts):
            source = held.open(part.getPath())
            last = len(",\n") if i + 1 == len(parts) else 0  # the last record has no comma after it
            jvm.org.apache.commons.io.IOUtils.copyLarge(source, sink, 0, part.getLen() - last)
            source.close()
        if results is not None:
            sink.write(bytearray(("\n  " * bool(parts) + "]\n}").encode()))
    finally:
        sink.close()
    if folder is not None:
        held.delete(folder, True)


def output_name(model: str, dataset: str | None = None, src: str | None = None, tgt: str | None = None) -> str:
    """Last part of the model's name, then the data set and languages where given."""
    parts = [model.split("/")[-1], dataset.split("/")[-1] if dataset else None, src, tgt]
    return "-".join(p for p in parts if p)
