"""What the operators of this subpackage share: tables, shared storage and words."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
#: Rows of a batch are worked on in slices of about so many characters.
SLICE_CHARS = 4_000_000

_own: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application that driver and executors share.

    It lies in spark.checkpoint.dir; where that is unset, in a temporary folder if the driver is the only
    executor (tests), and a cluster is refused.
    """
    app = spark.sparkContext.applicationId
    if app not in _own:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = base or "file://" + tempfile.mkdtemp(prefix="tracequill-")
        _own[app] = f"{base.rstrip('/')}/tracequill-{app}"
    return _own[app]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(release)
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it again, which cuts its lineage."""
    path = shared_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._written_at = path
    return back


def discard(*frames: DataFrame | None) -> None:
    """Delete what materialize() wrote for these frames, which nothing reads any more."""
    for df in frames:
        path = getattr(df, "_written_at", None)
        if path and (df.sparkSession, path) in _written:
            _written.remove((df.sparkSession, path))
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release() -> None:
    """Delete what materialize() has written."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session has ended or the folder can't be deleted: it stays, the others are tried
            continue


def remainder(n: int) -> Column:
    """crc32 of doc_id as text, modulo n; null ids count as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(n))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


_kept: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What an operator keeps in a Python worker from task to task; what another operator kept is dropped first.

    Freed memory goes back to the system, so that a worker holds what it works on and little else.
    """
    if owner not in _kept:
        _kept.clear()
        _kept[owner] = {}
        gc.collect()
        pa.set_memory_pool(pa.system_memory_pool())
        with contextlib.suppress(OSError, AttributeError):
            libc = ctypes.CDLL("libc.so.6")
            libc.mallopt(-3, 1 << 20)  # larger blocks are mapped by themselves and unmapped when they are freed
            libc.mallopt(-1, 1 << 20)
            libc.malloc_trim(0)
    return _kept[owner]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice holds about ``most`` bytes of text, one row at least."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        begin, held = 0, 0
        for i, n in enumerate(sizes):
            if i > begin and held + n > most:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        if begin < len(sizes):
            yield batch.slice(begin)


def partitions(spark: SparkSession, docs: DataFrame, least: int = 1) -> int:
    """How many partitions to deal rows to: the session's number, or more for more input."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")), docs_splits(docs))


def docs_splits(docs: DataFrame) -> int:
    """Estimated bytes of a frame, by the optimizer, in units of 32 MB."""
    try:
        size = docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        return int(min(int(size.toString()) // (32 << 20), 200_000))
    except Exception:  # no statistics by this route: the session's number serves
        return 1
