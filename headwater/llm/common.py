"""What the operators of this subpackage share: scratch tables, word rules, checked broadcasts."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch handed to Python: texts may be long, so far fewer than Spark's default.
BATCH_ROWS = 1000
#: A side is broadcast only below this many bytes, by its exact row count times a row's width.
BROADCAST_BYTES = 32 << 20

#: Fixed rule: ASCII capitals become small, ASCII characters that are no word characters become spaces.
WORD_TABLE = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i > 127 else 32 for i in range(256))
LOWER_TABLE = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
#: The same words as a Java regular expression, over text whose capitals are already small.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def utf8(text: str | None) -> bytes:
    """UTF-8 of a text; null is empty."""
    return text.encode("utf-8", "surrogatepass") if text else b""


def words(text: str | None) -> list[bytes]:
    return utf8(text).translate(WORD_TABLE).split()


def tune(spark: SparkSession) -> None:
    """Small Arrow batches: a batch of long texts must fit a Python worker beside others."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000") or 0) not in range(1, BATCH_ROWS + 1):
        spark.conf.set(key, str(BATCH_ROWS))


#: Scratch that nothing has deleted yet, and the list of the innermost scratch() that is open.
_made: list[tuple[SparkSession, str]] = []
_open: ContextVar[list | None] = ContextVar("scratch", default=None)
_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session, or one of our own where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not (spark.sparkContext.master or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="headwater-"))
        atexit.register(shutil.rmtree, _local[0], True)
    return f"file://{_local[0]}"


def _owner() -> list[tuple[SparkSession, str]]:
    own = _open.get()
    return _made if own is None else own


def scratch_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/headwater/{what}-{uuid.uuid4().hex}"
    _owner().append((spark, path))
    return path


def made_table(spark: SparkSession, name: str) -> None:
    """A scratch table of the warehouse, deleted with the scratch paths."""
    _owner().append((spark, f"table:{name}"))


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Scratch made inside is deleted at the end. What it gives writes a table that stays, with the scratch around it: the result."""
    outer, own = _owner(), []
    token = _open.set(own)

    def result(df: DataFrame, what: str) -> DataFrame:
        out = written(df, what)
        outer.append(own.pop())
        return out

    try:
        yield result
    finally:
        _open.reset(token)
        _delete(own)


def written(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """The rows of df from a Parquet table in the shared folder: lineage ends there, and a lost executor costs no earlier work."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _delete(made: list[tuple[SparkSession, str]]) -> None:
    for spark, path in made:
        if path.startswith("table:"):
            spark.sql(f"DROP TABLE IF EXISTS {path[6:]}")
        else:
            delete_path(spark, path)


def release_scratch(spark: SparkSession) -> None:
    """Delete the session's scratch. Only when no DataFrame that reads it is used any more."""
    own = [x for x in _made if x[0] is spark]
    _made[:] = [x for x in _made if x[0] is not spark]
    _delete(own)


def small_enough(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """True if df stays below the limit: its rows, counted exactly, times row_bytes, and the length of all its strings. The check behind every broadcast."""
    lengths = [F.coalesce(F.octet_length(f.name), F.lit(0)).cast("long") for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    n, held = df.agg(F.count("*"), F.coalesce(F.sum(sum(lengths, F.lit(0).cast("long"))), F.lit(0))).first()
    return n * row_bytes + held <= limit


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its measured size is within the limit, else as it is: the join then shuffles."""
    return F.broadcast(df) if small_enough(df, row_bytes, limit) else df


def map_arrow(df: DataFrame, fn, schema) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            slim()

    tune(df.sparkSession)
    return df.mapInArrow(run, schema)


def slim() -> None:
    """Give back what a task has freed: workers stay for later tasks beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if trim := kept("malloc_trim", lambda: getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def batch_of(schema: pa.Schema, columns: Iterable[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """(ids, texts) of each batch of two columns."""
    for b in batches:
        yield b.column(0).to_pylist(), b.column(1).to_pylist()


def lowered(text: Column) -> Column:
    """ASCII capitals only; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL)


def with_key(df: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """(df, the name of a column that tells its rows apart): the id itself if it is a whole number, unique and never null; else numbers given once and written."""
    whole = df.schema[id_col].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    if whole and df.groupBy(id_col).count().filter(F.col("count").__gt__(1) | F.col(id_col).isNull()).isEmpty():
        return df, id_col
    name = "row_key"
    while name in df.columns:
        name += "_"
    return written(df.withColumn(name, F.monotonically_increasing_id()), "keyed"), name


def without(df: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is not among the rejected; df moves only if the rejected keys are too many to broadcast."""
    return df.join(broadcast_if_small(rejected, 16), key, "left_anti")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_file(name: str, path: str | None = None) -> str:
    """Where a public vocabulary is: the path given, or the installed collection's file of that name."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


def tiktoken_ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def tiktoken_encoding(path: str, pattern: str | None = None):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=tiktoken_ranks(path), special_tokens={})


#: Objects that a Python worker keeps over its tasks (encoders, automata), by what they were made from.
_kept: dict = {}


def kept(key, make):
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]
