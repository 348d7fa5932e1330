"""Lines of text files read in splits: numbers that equal those of a whole read, first lines without the rest."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions.logs import LINE_ENDS


def _split_rows(spark: SparkSession, root: str | list[str], glob: str) -> DataFrame:
    """(path, block, value): a block is the place in the file where its split begins."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")


def numbered_lines(spark: SparkSession, root: str, glob: str, wanted: Column) -> DataFrame:
    """(path, line_no, line) of the files below ``root`` whose name matches and for whose ``path`` ``wanted`` holds.

    A file is read in splits by as many tasks. Each task numbers the lines of its splits as they come; how many
    lines the splits before it have is counted apart and added, so numbers run from 0 through the file and no line
    moves between tasks. Besides line feed and carriage return the marks of ``LINE_ENDS`` end a line. An empty file has no line.
    """
    rows = _split_rows(spark, root, glob).where(wanted)
    ends = re.compile(LINE_ENDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, upto = None, 0  # the split at hand, and its lines so far
        for b in batches:
            if not b.num_rows:
                continue
            path, block, value = b.column("path"), b.column("block").to_numpy(), b.column("value")
            odd = np.flatnonzero(pc.match_substring_regex(value, LINE_ENDS).to_numpy(zero_copy_only=False))
            counts, row = np.ones(b.num_rows, dtype=np.int64), np.arange(b.num_rows)
            if len(odd):  # other marks stand inside the row
                texts, pieces = value.to_pylist(), []
                hit = set(odd.tolist())
                for i, text in enumerate(texts):
                    own = ends.split(text) if i in hit else [text]
                    counts[i] = len(own)
                    pieces += own
                value, row = pa.array(pieces, pa.string()), np.repeat(row, counts)
            name = path.dictionary_encode()
            fresh = np.concatenate([[True], (np.diff(name.indices.to_numpy()) != 0) | (np.diff(block) != 0)])
            before = np.cumsum(counts) - counts
            first = np.flatnonzero(fresh)
            base = np.repeat(before[first], np.diff(np.append(first, b.num_rows)))
            if last == (path[0].as_py(), int(block[0])):
                base[: (first[1] if len(first) > 1 else b.num_rows)] -= upto
            start = before - base
            inside = np.arange(len(row)) - np.repeat(before, counts) if len(odd) else 0
            last, upto = (path[b.num_rows - 1].as_py(), int(block[-1])), int(start[-1] + counts[-1])
            yield pa.RecordBatch.from_arrays([path.take(pa.array(row)), pa.array(block[row]), pa.array(start[row] + inside), value], names=["path", "block", "no", "line"])

    lines = rows.mapInArrow(run, "path string, block bigint, no bigint, line string")
    counted = rows.groupBy("path", "block").agg(F.sum(F.size(F.split("value", LINE_ENDS, -1))).alias("n"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    offsets = counted.select(F.col("path").alias("of_path"), F.col("block").alias("of_block"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    joined = lines.join(offsets, (F.col("path") == F.col("of_path")) & (F.col("block") == F.col("of_block")))
    return joined.select("path", (F.col("no") + F.col("before")).alias("line_no"), "line")


@contextmanager
def settings(spark: SparkSession, **wanted: str):
    """The session's settings, dots given as two underscores, while the block runs."""
    names = {k: k.replace("__", ".") for k in wanted}
    old = {k: spark.conf.get(n) for k, n in names.items()}
    for k, n in names.items():
        spark.conf.set(n, wanted[k])
    try:
        yield
    finally:
        for k, n in names.items():
            spark.conf.set(n, old[k])


def first_lines(spark: SparkSession, paths: str | list[str], glob: str = "*") -> list[tuple[str, str]]:
    """(path, first line) of every file. A task takes the first row of its split and stops, so of a file no more than
    a buffer is read; splits behind the first give nothing. The list is as long as Spark's own list of the files."""
    rows = _split_rows(spark, paths, glob)
    largest = spark.conf.get("spark.sql.files.maxPartitionBytes")
    # opening a file counts as much as a full split, so no two splits share a task; a session that bounds the tasks of a scan may join them
    with settings(spark, spark__sql__files__openCostInBytes=largest, spark__sql__execution__arrow__maxRecordsPerBatch="64"):
        alone = spark.conf.get("spark.sql.files.openCostInBytes") == largest and not spark.conf.get("spark.sql.files.maxPartitionNum", None)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = set()
            for b in batches:
                path = b.column("path")
                for i in np.flatnonzero(b.column("block").to_numpy() == 0).tolist():
                    if path[i].as_py() not in seen:
                        seen.add(path[i].as_py())
                        yield b.slice(i, 1).select(["path", "value"])
                if alone and b.num_rows:  # the rest of the split isn't asked for
                    return

        return [(r["path"], r["value"]) for r in rows.mapInArrow(run, "path string, value string").collect()]
