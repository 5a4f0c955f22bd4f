"""What the operators share: reading a table, durable cuts of lineage in the shared
folder, Arrow batches of bounded size, safe column names, and joins on hot keys."""

from __future__ import annotations

import contextlib
import os
import threading
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from paralex.session import shared_folder, written

__all__ = ["apart", "durable", "from_text", "join_spread", "map_batches", "quoted", "rebatched", "shared_folder", "small_batches", "table", "tokenizer_file", "unused"]

#: Most rows and bytes of one batch that an operator's worker code is given.  Texts vary
#: from bytes to megabytes, so memory in a worker is bounded by bytes; one longer text is
#: a batch of its own.  What crosses to the worker is bounded by the session's
#: ``spark.sql.execution.arrow.maxBytesPerBatch``, which is lowered to BATCH_BYTES while an
#: operator runs a job of its own and is otherwise left alone.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20
#: A key with more than this share of all rows is hot.
HOT_SHARE = 1 / 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table ``name`` below ``sf_dir`` (any path Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_lock = threading.Lock()
_inside: dict[int, tuple[int, str | None]] = {}


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run in the block send batches of BATCH_BYTES.

    The session's setting is put back when the last block of all threads ends, so none
    takes another's for the user's own.
    """
    key, own = "spark.sql.execution.arrow.maxBytesPerBatch", id(spark._jsparkSession)
    with _lock:
        blocks, before = _inside.get(own, (0, None))
        if not blocks:
            before = spark.conf.get(key, None)
            spark.conf.set(key, str(BATCH_BYTES))
        _inside[own] = blocks + 1, before
    try:
        yield
    finally:
        with _lock:
            blocks, before = _inside.pop(own)
            if blocks > 1:
                _inside[own] = blocks - 1, before
            elif before is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, before)


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    with small_batches(df.sparkSession):
        return written(df)


def from_text(df: DataFrame, name: str, work: Callable[[Iterator[list[str | None]]], Iterator[pa.Array]], kind: str) -> DataFrame:
    """``df`` with a column ``name`` of ``kind``: what ``work`` makes of the texts.

    ``work`` gets bounded lists of texts and yields an array for each; only the texts
    cross to the worker and only its values come back.
    """

    @F.arrow_udf(kind)
    def value(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sizes: list[int] = []

        def lists():
            for column in texts:
                parts = list(rebatched([pa.RecordBatch.from_arrays([column], names=["text"])]))
                sizes.append(len(parts))
                for part in parts:
                    yield part.column(0).to_pylist()

        made, held = work(lists()), []
        for array in made:
            held.append(array)
            if len(held) == sizes[0]:
                sizes.pop(0)
                yield pa.concat_arrays(held)
                held = []
            while sizes and not sizes[0]:
                sizes.pop(0)
                yield pa.array([], array.type)

    return df.withColumn(name, value(F.col("text")))


def _sizes(batch: pa.RecordBatch) -> list[int]:
    """Bytes of the texts and binaries of each row."""
    total = None
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type):
            size = pc.fill_null(pc.cast(pc.binary_length(column), pa.int64()), 0)
            total = size if total is None else pc.add(total, size)
    return [0] * batch.num_rows if total is None else total.to_pylist()


def rebatched(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` rows and ``size`` bytes of text (one row at least)."""
    for batch in batches:
        if batch.num_rows <= rows and batch.nbytes <= size:
            yield batch
            continue
        start = held = 0
        for at, n in enumerate(_sizes(batch)):
            if at > start and (at - start >= rows or held + n > size):
                yield batch.slice(start, at - start)
                start, held = at, 0
            held += n
        if batch.num_rows > start:
            yield batch.slice(start)


def map_batches(
    df: DataFrame,
    work: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str | StructType,
    rows: int = BATCH_ROWS,
    size: int = BATCH_BYTES,
) -> DataFrame:
    """``mapInArrow`` whose ``work`` gets batches of at most ``rows`` rows and ``size``
    bytes of text; they are cut in the worker, so no setting of the session changes."""
    return df.mapInArrow(lambda batches: work(rebatched(batches, rows, size)), schema)


def apart(work: Callable[[], bytes]) -> bytes:
    """What ``work`` returns, from a child process: the memory that it took is gone with it,
    while a worker that is used again would keep it."""
    import multiprocessing

    here, there = multiprocessing.get_context("fork").Pipe(duplex=False)

    def child():
        try:
            there.send((True, work()))
        except BaseException as e:  # noqa: BLE001
            there.send((False, repr(e)))
        finally:
            os._exit(0)

    process = multiprocessing.get_context("fork").Process(target=child, daemon=False)
    process.start()
    there.close()
    try:
        good, value = here.recv()
    except EOFError:
        good, value = False, "the child process died"
    process.join()
    if not good:
        raise RuntimeError(value)
    return value


def quoted(name: str) -> Column:
    """The column of this very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(taken: Iterable[str], *wanted: str) -> list[str]:
    """``wanted`` names, lengthened until none equals another or one of ``taken`` in any case."""
    seen, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in seen:
            name += "_"
        seen.add(name.lower())
        out.append(name)
    return out


def join_spread(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` and ``facts`` (one row a key, without nulls) on ``key``.

    ``count`` is the column of ``facts`` with the rows of each key in ``rows``, of which
    there are ``total``; it is dropped.  At most 1 / HOT_SHARE keys are hot.  Their rows
    are dealt over as many parts as they need, and their facts copied to each part, so
    no key fills a task.  ``facts`` is read twice and should be a written table.
    """
    share = max(64, int(total * HOT_SHARE))
    copies, salt = unused([*rows.columns, *facts.columns], "copies", "salt")
    facts = facts.withColumn(copies, F.ceil(F.col(count) / F.lit(share)).cast("int"))
    hot = facts.filter(F.col(copies) > 1).select(key, copies)
    part = F.pmod(F.xxhash64(*map(quoted, rows.columns)), F.col(copies)).cast("int")
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn(salt, F.coalesce(part, F.lit(0))).drop(copies)
    spread = facts.withColumn(salt, F.explode(F.sequence(F.lit(0), F.greatest(F.col(copies), F.lit(1)) - 1))).drop(copies, count)
    return dealt.join(spread, [key, salt]).drop(salt)


def tokenizer_file(name: str, path: str | None = None) -> str:
    """Place of a public tokenizer file; ``path`` overrides it.

    Called on the worker as well as on the driver, so that only a name travels.
    """
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
