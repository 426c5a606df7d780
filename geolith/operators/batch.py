"""Auditing many files, and custom processing of chunks.

Each file is its own set of jobs, so a large file is as parallel as any, several files run at once, and what goes wrong
with one is a row of the result.  Custom processors map Arrow chunks; custom collectors are plain DataFrame functions.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor, as_completed
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.errors import ScanMemoryError
from geolith.operators.engine import remaining_seconds, worker_count
from geolith.operators.validate import audit, validate
from geolith.sources import vector

LEAST_CHUNK, CHUNK = 256, 65_536
ITEM = "seq int, source string, status string, value string, error string"


@dataclass(frozen=True)
class Progress:
    """What an observer hears after each file."""

    completed: int
    total: int
    source: str
    status: str
    elapsed_seconds: float
    remaining_seconds: float | None


def audit_file(spark: SparkSession, path: str) -> str:
    """The audit of one dataset as JSON: feature_count, invalid_feature_count, findings_listed, findings_truncated."""
    features = vector.read(spark, path)
    name = next((c for c in ("geometry", "geometry_wkt") if c in features.columns), None)
    if name is None:
        raise ValueError("the dataset has no geometry column")
    return audit(validate(features.select(name), name)).select(F.to_json(F.struct("*"))).first()[0]


def process_files(spark: SparkSession, paths: Iterable[str], process: Callable[[SparkSession, str], object] = audit_file, *, requested_workers: int | None = None, progress: Callable[[Progress], None] | None = None) -> DataFrame:
    """seq, source, status (succeeded, failed), value (what process returned, as text), error (``Type: message``), in the order of paths.

    A file whose processing raises has failed and leaves the others alone. progress is called in the driver after each
    file, in the order they end.
    """
    paths = list(paths)
    began, done, rows = time.monotonic(), 0, []
    workers = worker_count(max(1, len(paths)), requested=requested_workers)

    def one(item):
        seq, path = item
        try:
            return seq, path, "succeeded", str(process(spark, path)), None
        except Exception as error:
            told = str(error).strip().splitlines()
            return seq, path, "failed", None, f"{type(error).__name__}: {told[0] if told else ''}"

    with ThreadPoolExecutor(workers) as pool:
        for future in as_completed([pool.submit(one, item) for item in enumerate(paths)]):
            rows.append(future.result())
            done += 1
            if progress:
                elapsed = time.monotonic() - began
                progress(Progress(done, len(paths), rows[-1][1], rows[-1][2], elapsed, remaining_seconds(done, len(paths), elapsed)))
    return spark.createDataFrame(sorted(rows), ITEM)


@dataclass(frozen=True)
class ChunkPipeline:
    """A processor of Arrow chunks and a collector of what it yields.

    process maps a chunk of at most chunk_rows rows to a RecordBatch of ``schema``; collect turns the DataFrame of all of
    them into the result. A processor that runs out of memory raises ScanMemoryError.
    """

    process: Callable[[pa.RecordBatch], pa.RecordBatch]
    schema: str
    collect: Callable[[DataFrame], DataFrame] = lambda df: df
    chunk_rows: int = CHUNK

    def __post_init__(self):
        if self.chunk_rows < LEAST_CHUNK:
            raise ValueError(f"a chunk has {LEAST_CHUNK} rows at least")

    def run(self, features: DataFrame) -> DataFrame:
        process, rows = self.process, self.chunk_rows

        def chunks(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    try:
                        yield process(batch.slice(at, rows))
                    except MemoryError as error:
                        raise ScanMemoryError(f"a chunk of {min(rows, batch.num_rows - at)} rows does not fit") from error

        return self.collect(features.mapInArrow(chunks, self.schema))
