"""Helpers that several of the operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: Spark hands it out unless the workers' path has it."""
    parent, sc = os.path.dirname(_PACKAGE), spark.sparkContext
    known = [os.path.abspath(p) for p in (*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd())]
    if parent in known or getattr(sc, "_tracewright_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="package-"), "tracewright_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(_PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), parent))
    sc.addPyFile(path)
    sc._tracewright_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the folder that ``spark.checkpoint.dir`` names.

    The folder is one that all executors share, so the rows outlive the executor that made them.
    Without the setting a temporary folder serves in local mode (tests); on a cluster that is an error.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names, see ``materialize``."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return f"{sc.getCheckpointDir()}/table-{uuid.uuid4().hex}"


def written(df: DataFrame, *parts: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder, in folders by the columns ``parts``: unlike a
    checkpoint it is read by columns, and by folders."""
    path = shared_folder(df.sparkSession)
    df.write.partitionBy(*parts).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def others(df: DataFrame, *replaced: str) -> list[Column]:
    """All columns but those that bear one of the names, in any case; names may hold dots and backticks."""
    gone = {name.lower() for name in replaced}
    return [F.col(quoted(c)) for c in df.columns if c.lower() not in gone]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """Column names that clash with none of ``taken``, in any case: each wanted one, with underscores as needed."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def release() -> None:
    """Give back to the system what a task no longer needs: its Python worker lives on and serves other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function for mapInArrow, followed by ``release`` once its variables are gone."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return wrapped


def fold(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % parts


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space; null counts as no word."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def byte_slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds about ``most`` bytes of the column, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(sizes) - sizes) // max(1, most)
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(sizes)]):
        yield batch.slice(int(a), int(b - a))


def append_columns(df: DataFrame, text_col: str, fields: list[T.StructField], start: Callable[[], Callable[[list], list[pa.Array]]], slice_bytes: int = 4 << 20) -> DataFrame:
    """Append columns computed in Arrow batches from one text column.

    ``start()`` runs once a task and returns the function that maps a list of texts (null for a null)
    to one Arrow array for each field. All other columns pass through; those that bear the name of an
    appended field, in any case, are replaced.
    """
    ship(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name.lower() not in {g.name.lower() for g in fields}]
    number = {f.name.lower(): k for k, f in enumerate(kept)}
    text = f"c{number[text_col.lower()]}"
    base = df.select(*[F.col(quoted(f.name)).alias(f"c{k}") for k, f in enumerate(kept)])  # plain names on the way through Arrow
    added = [f"a{k}" for k in range(len(fields))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            for part in byte_slices(batch, text, slice_bytes):
                made = step(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *added])

    schema = T.StructType([*base.schema.fields, *[T.StructField(a, f.dataType) for a, f in zip(added, fields)]])
    made = base.mapInArrow(releasing(run), schema)
    return made.select(*[F.col(f"c{k}").alias(f.name) for k, f in enumerate(kept)], *[F.col(a).alias(f.name) for a, f in zip(added, fields)])
