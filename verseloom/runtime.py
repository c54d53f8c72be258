"""Python on executors: sends the package along, and runs grouped functions over sorted arrays."""

from __future__ import annotations

import atexit
import pathlib
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SENT: set[str] = set()


def send_code(spark: SparkSession) -> None:
    """Adds this package to the executors' path, once an application."""
    sc = spark.sparkContext
    if sc.applicationId not in _SENT:
        root = pathlib.Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="verseloom-code-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)  # the driver serves the file while it runs
        path = pathlib.Path(folder) / "verseloom.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"verseloom/{p.relative_to(root)}")
        sc.addPyFile(str(path))
        _SENT.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master that names none (tests on one machine) gets a temporary one; a cluster must name it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="verseloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = "file://" + folder
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/verseloom/{name}-{uuid.uuid4().hex}"


#: Whether Spark drops a query's shuffle files as the query ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: What a task holds of long texts in the JVM: rows that a reader decodes at once (Spark: 4,096), bytes of a row group that a writer gathers (Parquet: 128 MB), bytes of a batch that goes to Python (Spark: 64 MB).
BOUNDS = {"spark.sql.parquet.columnarReaderBatchSize": "512", "parquet.block.size": str(4 << 20), "spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20)}


def bound_memory(spark: SparkSession) -> None:
    """Sets ``BOUNDS`` for the session, which also holds for frames that the caller writes later; a value that the session names stays."""
    for name, value in BOUNDS.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` as a table in the shared folder and reads it again."""
    return stored(df, name)[0]


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``materialize``, and the table's path for ``remove``. The write's own shuffle files go when it ends."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes stored tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def dealt_out(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each key's rows in order in one task. The sort is Spark's (it spills)."""
    send_code(rows.sparkSession)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return rows.repartition(n, key).sortWithinPartitions(key, *order)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """One batch a key of sorted batches."""

    def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    now, held = None, []
    for batch in batches:
        keys = batch.column(key).to_pylist()
        cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)] if keys else []
        for a, b in pairwise(cuts):
            if held and keys[a] != now:
                yield joined(held)
                held = []
            now = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield joined(held)


def map_groups(rows: DataFrame, key: str, order: list[str], fn: Callable[[object, dict[str, list]], Iterator[tuple]], schema: str) -> DataFrame:
    """``fn(key, columns of the key's rows in order)`` yields tuples of ``schema``; groups are as large as a song or document.

    A task holds one group at a time.
    """
    spark = rows.sparkSession
    dealt = dealt_out(rows, key, order)
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(out: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * len(target)
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, target)], schema=target)

        now, group = None, None
        for batch in batches:
            out: list[tuple] = []
            keys, cols = batch.column(key).to_pylist(), {n: batch.column(n).to_pylist() for n in batch.schema.names}
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)] if keys else []
            for a, b in zip(cuts, cuts[1:]):
                if group is not None and keys[a] != now:
                    out += fn(now, group)
                    group = None
                if group is None:
                    now, group = keys[a], {n: [] for n in cols}
                for n, values in cols.items():
                    group[n] += values[a:b]
            yield made(out)
        if group is not None:
            yield made(list(fn(now, group)))

    return dealt.mapInArrow(run, schema)
