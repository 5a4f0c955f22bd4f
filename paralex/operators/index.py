"""A lexical index that is kept: counted texts, terms, and postings in blocks by impact.

An index is a folder of generations.  ``append`` counts the texts of new documents once and
writes a generation: ``counted`` (a row a document: its terms, how often it has each, its
length) and ``terms`` (documents that hold each).  A line in ``manifest``, written last, makes
it count; what a broken run left behind is never read.  ``weighted`` makes postings for all
generations together, since new documents change every weight, and keeps them until the next
append; it reads no text.

A posting's impact is what a document adds for a term before the query's weight.  A block holds
up to BLOCK postings of one term in descending order of impact, and ``best``, the first of them.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paralex.session import written

#: Postings of a block at most.
BLOCK = 128
#: Documents whose postings a task sorts at a time.
AT_ONCE = 4_096
#: Texts that a task counts at a time.
COUNTED = 512
#: Most terms that are sent along to leave out all others while blocks are made.
KNOWN_TERMS = 200_000

MANIFEST = "generation string, documents long, tokens long"


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows``, dealt by ``key`` over all cores if they come in fewer parts than there are cores (few large row groups)."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows._jdf.rdd().getNumPartitions() < cores else rows


def counted(texts: DataFrame, key: str, tokens: Column) -> DataFrame:
    """``key, dl, terms, tfs`` of each text; a null text has no tokens.  Nothing is shuffled."""
    kind = texts.schema[key].dataType.simpleString()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, COUNTED) for b in batches for at in range(0, b.num_rows, COUNTED)):
            lists = batch.column(1)
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().dictionary_encode()
            codes = flat.indices.to_numpy().astype(np.int64)
            rows = np.repeat(np.arange(batch.num_rows), lengths)
            kinds = max(1, len(flat.dictionary))
            pairs, tf = np.unique(rows * kinds + codes, return_counts=True)
            offsets = np.searchsorted(pairs // kinds, np.arange(batch.num_rows + 1))
            terms = _lists(offsets, flat.dictionary.take(pa.array(pairs % kinds)))
            columns = [batch.column(0), pa.array(lengths), terms, _lists(offsets, pa.array(tf.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "dl", "terms", "tfs"])

    listed = texts.select(F.col(key).alias("key"), F.coalesce(tokens, F.array().cast("array<string>")).alias("_t"))
    return listed.mapInArrow(work, f"key {kind}, dl long, terms array<string>, tfs array<int>")


def term_counts(rows: DataFrame) -> DataFrame:
    """``term, df`` of counted texts."""
    return rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))


@dataclass
class Corpus:
    """Counted texts (``key, dl, terms, tfs``), ``term, df``, and the numbers of documents and tokens."""

    rows: DataFrame
    terms: DataFrame
    documents: int
    tokens: int


def corpus_of(texts: DataFrame, key: str, tokens: Column) -> Corpus:
    """The same for texts that are asked once; both tables are written."""
    rows = written(counted(spread(texts, key), key, tokens))
    n, total = rows.agg(F.count("*"), F.sum("dl")).first()
    return Corpus(rows, written(term_counts(rows)), n, total or 0)


class Index:
    """The index in the folder ``path``, for one key and one tokenizer (an expression of a column)."""

    def __init__(self, spark: SparkSession, path: str, tokens: Callable[[Column], Column]):
        self.spark, self.path, self.tokens = spark, path.rstrip("/"), tokens

    def _exists(self, place: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def generations(self) -> list[tuple[str, int, int]]:
        """Generation, documents and tokens of all that was appended, in a fixed order."""
        place = f"{self.path}/manifest"
        if not self._exists(place):
            return []
        return sorted((r["generation"], r["documents"], r["tokens"]) for r in self.spark.read.schema(MANIFEST).json(place).collect())

    def append(self, texts: DataFrame, key: str = "doc_id", text: str = "text") -> None:
        """Count the texts of documents that the index doesn't hold yet."""
        name = uuid.uuid4().hex
        place = f"{self.path}/generations/{name}"
        counted(spread(texts.select(key, text), key), key, self.tokens(F.col(text))).write.parquet(f"{place}/counted")
        rows = self.spark.read.parquet(f"{place}/counted")
        term_counts(rows).write.parquet(f"{place}/terms")
        n, total = rows.agg(F.count("*"), F.sum("dl")).first()
        self.spark.createDataFrame([(name, n, total or 0)], MANIFEST).coalesce(1).write.mode("append").json(f"{self.path}/manifest")

    def corpus(self) -> Corpus:
        """All generations; no text is read."""
        held = self.generations()
        if not held:
            raise ValueError(f"no documents were appended to {self.path}")
        places = [f"{self.path}/generations/{g}" for g, _, _ in held]
        terms = self.spark.read.parquet(*(f"{p}/terms" for p in places))
        if len(held) > 1:
            terms = terms.groupBy("term").agg(F.sum("df").alias("df"))
        rows = self.spark.read.parquet(*(f"{p}/counted" for p in places))
        return Corpus(rows, terms, sum(n for _, n, _ in held), sum(t for _, _, t in held))

    def weighted(self, name: str, make: Callable[[Corpus], tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
        """Impacts and blocks, as ``make`` builds them from the corpus; made once a set of generations."""
        state = uuid.uuid5(uuid.NAMESPACE_OID, " ".join(g for g, _, _ in self.generations())).hex
        places = [f"{self.path}/weighted/{name}-{state}/{part}" for part in ("impacts", "blocks", "terms")]
        if not all(self._exists(f"{p}/_SUCCESS") for p in places):
            impacts, terms = make(self.corpus())
            impacts.write.mode("overwrite").parquet(places[0])
            blocks_of(self.spark.read.parquet(places[0])).write.mode("overwrite").parquet(places[1])
            terms.write.mode("overwrite").parquet(places[2])
        return tuple(self.spark.read.parquet(p) for p in places)


def asked_only(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """``rows`` (``terms`` and ``tfs`` side by side) cut to the terms of ``asked``, if these are few enough to send along."""
    wanted = [r["term"] for r in asked.select("term").distinct().limit(KNOWN_TERMS + 1).collect()]
    if len(wanted) > KNOWN_TERMS:
        return rows

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = pa.array(wanted, pa.string())
        for batch in batches:
            at = batch.schema.get_field_index("terms")
            lists = batch.column(at)
            keep = pc.is_in(lists.flatten(), value_set=some)
            ends = np.append(0, np.cumsum(keep.to_numpy(zero_copy_only=False)))
            first = lists.offsets.to_numpy()
            offsets = ends[first - first[0]]
            columns = [_lists(offsets, c.flatten().filter(keep)) if pa.types.is_list(c.type) else c for c in batch.columns]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return rows.mapInArrow(work, rows.schema)


def blocks_of(impacts: DataFrame) -> DataFrame:
    """``term, id, n, best, docs, parts`` of ``key, terms, parts``: postings in descending order of impact."""
    kind = impacts.schema["key"].dataType.simpleString()

    def closed(batches: list[pa.RecordBatch], since: int) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(batches).combine_chunks()
        lists = table.column("terms").combine_chunks()
        flat = lists.flatten().dictionary_encode()
        if not len(flat):
            return None
        row = np.repeat(np.arange(len(table)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        part = table.column("parts").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        code = flat.indices.to_numpy()
        order = np.lexsort((-part, code))
        code, part = code[order], part[order]
        new = np.append(True, code[1:] != code[:-1])
        start = np.flatnonzero(new)
        place = np.arange(len(code)) - np.repeat(start, np.diff(np.append(start, len(code))))
        first = np.flatnonzero(place % BLOCK == 0)
        offsets = np.append(first, len(code))
        keys = table.column("key").combine_chunks().take(pa.array(row[order]))
        ids = np.arange(since, since + len(first), dtype=np.int64)
        columns = [flat.dictionary.take(pa.array(code[first])), pa.array(ids), pa.array(np.diff(offsets).astype(np.int32)), pa.array(part[first]), _lists(offsets, keys), _lists(offsets, pa.array(part))]
        return pa.RecordBatch.from_arrays(columns, names=["term", "id", "n", "best", "docs", "parts"])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        since = TaskContext.get().partitionId() << 40
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
            if held and (batch is None or sum(b.num_rows for b in held) >= AT_ONCE):
                if (out := closed(held, since)) is not None:
                    yield out
                    since += out.num_rows
                held = []

    return impacts.select("key", "terms", "parts").mapInArrow(work, f"term string, id long, n int, best double, docs array<{kind}>, parts array<double>")


def stored(impacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Impacts and their blocks, both written."""
    impacts = written(impacts)
    return impacts, written(blocks_of(impacts))
