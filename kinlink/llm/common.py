"""What the corpus operators share: Arrow text passes, row digests and shared scratch tables."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text in an Arrow batch, and in one step of a Python worker; a longer single text makes a step of its own.
BATCH_BYTES, STEP_BYTES = 4 << 20, 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of about BATCH_BYTES, where the session has Spark's own bound of 64 MB: workers then hold that much text."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share.

    Where it is unset and all runs on one machine (tests) a temporary folder is set as the checkpoint folder;
    on a cluster that is refused, since each executor would write to a disk of its own.
    """
    set_to = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if set_to is None:
        set_to = spark.sparkContext.getCheckpointDir()
        if set_to is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="checkpoint-"))
            set_to = spark.sparkContext.getCheckpointDir()
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(set_to)
    return set_to


def checkpoint(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: its lineage ends there and no executor's loss touches it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Folders that new_path() named since the outermost scratch() began; None outside of one.
_SCRATCH: list = [None]


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes the tables that were stored inside it when it ends; what was made from them must be stored elsewhere by then."""
    kept, _SCRATCH[0] = _SCRATCH[0], []
    try:
        yield
    finally:
        made, _SCRATCH[0] = _SCRATCH[0], kept
        for path in made:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder's name below the shared one."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _SCRATCH[0] is not None:
        _SCRATCH[0].append(path)
    return path


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df, written as zstd Parquet to a new folder below the shared one (path, if given), and read back.  It stays there unless a scratch() ends."""
    path = path or new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def steps(texts: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each, or of one row."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def tidied() -> None:
    """Gives back what the worker's allocators hold but do not use; workers live on after a task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_pass(df: DataFrame, keep: list[str], text: str, made: list[tuple[str, str]], begin: Callable[[], Callable[[list], list[list]]], most: int = STEP_BYTES) -> DataFrame:
    """The columns `keep` of df, and one column for each of `made` (name, type), from a function over texts.

    begin() runs once in each Python task and gives a function from a list of texts (str or None) to
    one list of values for each made column.  Rows are passed in steps bounded by bytes.  Only `keep`
    and `text` leave the scan.  A kept column called like a made one gives way to it.
    """
    keep = [c for c in keep if c not in {n for n, _ in made}]
    bounded_batches(df.sparkSession)
    source = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").cast("string").alias("t"))
    out = T.StructType([T.StructField(c, df.schema[c].dataType) for c in keep] + [T.StructField(n, T._parse_datatype_string(k)) for n, k in made])
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(out)

    def work(batches):
        apply = begin()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for a, b in steps(texts, most):
                values = apply(texts.slice(a, b - a).to_pylist())
                kept = [batch.column(i).slice(a, b - a).cast(kinds[i].type) for i in range(len(keep))]
                new = [v if isinstance(v, pa.Array) else pa.array(v, kinds[len(keep) + i].type) for i, v in enumerate(values)]
                yield pa.RecordBatch.from_arrays(kept + new, schema=kinds)
        del apply
        tidied()

    return source.mapInArrow(work, out)


def held_out(doc_id: str = "doc_id"):
    """True where crc32(doc_id as text) mod 4 is 2; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2
