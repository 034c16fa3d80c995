"""Small helpers that the operators of this package share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows and about the bytes of a slice that a step works on at a time.
SLICE_ROWS, SLICE_BYTES = 1_000, 8 << 20
#: Partitions for each core in ``few``.
SHARES = 4
#: The setting for the rows of Arrow batches and its default, which is lowered to SLICE_ROWS: texts are long, and both sides hold whole batches.
BATCH_SETTING, BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset, a temporary one in local mode and an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local($|\[)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="larkfield-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def few(df: DataFrame) -> DataFrame:
    """``df`` in at most ``SHARES`` partitions for each core, for narrow tables that are read often: every task that reads one writes files of its own in each shuffle."""
    return df.coalesce(SHARES * df.sparkSession.sparkContext.defaultParallelism)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the checkpoint folder and read it from there."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def columns(names: list[str]) -> list[Column]:
    """The columns of these names, which may hold dots and spaces."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in names]


#: What the tasks of this Python worker share, by its key; one entry at most.
_shared: dict[tuple, object] = {}
_asked = [False]


def worker_state(key: tuple, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept for further tasks of this worker until a task of another operator starts in it."""
    _asked[0] = True
    if key not in _shared:
        _shared.clear()
        _shared[key] = make()
    return _shared[key]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str | T.StructType, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` with state for each task.

    ``make`` runs once in a task and returns the function from an input batch
    (of at most ``rows`` rows and, but for one long row, about ``size`` bytes)
    to an output batch.
    """
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)
    short_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _asked[0] = False
        step = make()
        if not _asked[0]:
            _shared.clear()
        for batch in gathered_batches(batches, rows, size):
            for part in slices(batch, rows, size):
                if (out := step(part)) is not None and out.num_rows:
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out.columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, kind)


def short_batches(spark: SparkSession) -> None:
    """Lower the rows of the session's Arrow batches, unless someone has set them."""
    if spark.conf.get(BATCH_SETTING) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, str(SLICE_ROWS))


def gathered_batches(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring batches joined while they hold few rows and bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and (sum(b.num_rows for b in held) + batch.num_rows > rows or sum(b.nbytes for b in held) + batch.nbytes > size):
            yield pa.concat_batches(held)
            held = []
        held.append(batch)
    if held:
        yield pa.concat_batches(held)


def slices(batch: pa.RecordBatch, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of few enough rows and bytes; a row is never cut."""
    rows = min(rows, batch.num_rows * size // max(batch.nbytes, 1)) or 1
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def batch_of(*columns) -> pa.RecordBatch:
    """A batch of columns by position; ``map_batches`` gives them their names and types."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, names=[f"c{k}" for k in range(len(arrays))])
