"""GeoParquet: scan with pushdown, footer metadata, and an atomic sink."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from geolith.errors import CorruptDatasetError

CODECS = ("snappy", "gzip", "brotli", "zstd", "lz4", "none")
OPERATORS = ("==", "!=", "<", "<=", ">", ">=", "in", "not in", "is null", "is not null")


def predicate(column: str, operator: str, value=None) -> Column:
    """One scan predicate. A comparison with a null column value drops the row; only `not in` keeps it."""
    c = F.col(column)
    if operator not in OPERATORS:
        raise ValueError(f"unknown operator {operator!r}")
    if operator in ("in", "not in"):
        if isinstance(value, str) or not isinstance(value, (list, tuple, set, frozenset)):
            raise ValueError("in and not in need a collection")
        found = c.isin(*value)
        return found if operator == "in" else ~F.coalesce(found, F.lit(False))
    if operator == "is null":
        return c.isNull()
    if operator == "is not null":
        return c.isNotNull()
    return {"==": c == value, "!=": c != value, "<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value}[operator]


def inspect(path: str | Path) -> dict:
    """driver, geometry_column, crs (sorted JSON or None), feature_count and encoding from the footer; no features are read."""
    import pyarrow.parquet as pq

    try:
        meta = pq.read_metadata(path)
        geo = json.loads((meta.metadata or {})[b"geo"])
        primary = geo.get("primary_column", "geometry")
        crs = geo.get("columns", {}).get(primary, {}).get("crs")
    except Exception as error:
        raise CorruptDatasetError(f"{path}: no readable GeoParquet footer") from error
    return {"driver": "GeoParquet", "layer": None, "geometry_column": primary, "crs": json.dumps(crs, sort_keys=True) if crs else None, "feature_count": meta.num_rows, "encoding": "UTF-8"}


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None, predicates: Sequence[tuple] = (), include_geometry: bool = True, geometry: str = "geometry", with_index: bool = True) -> DataFrame:
    """The features of GeoParquet files with feature_index, the row's place among those that pass the predicates in file order.

    columns None with the geometry means all columns (Catalyst prunes what is not used). Predicates and projection
    reach the Parquet reader. Unknown, repeated and no columns at all raise ValueError.
    """
    df = spark.read.parquet(path)
    known = df.columns
    if columns is not None:
        names = list(columns)
        if not names or len(set(names)) < len(names):
            raise ValueError("columns must be some, each once")
        if unknown := sorted(set(names) - set(known)):
            raise ValueError(f"unknown columns: {', '.join(unknown)}")
        if include_geometry and geometry not in names:
            names.append(geometry)
    else:
        names = known
    for p in predicates:
        df = df.where(predicate(*p))
    if not with_index:
        return df.select(*names)
    placed = df.select(*[F.col(n) for n in names], F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    if predicates:  # the places of the rows that pass are not known before: a sort by file and row
        from geolith.operators.reports import numbered

        return numbered(placed, [F.asc("_file"), F.asc("_row")], "feature_index").drop("_file", "_row")
    # Without predicates a row's place is its own in the file and the rows of the files before: one number a file, no shuffle.
    ahead = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("_file")).groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    ahead = ahead.select("_file", (F.sum("_n").over(Window.orderBy("_file")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(ahead), "_file").withColumn("feature_index", F.col("_before") + F.col("_row")).drop("_file", "_row", "_before")


@dataclass
class _Written(WriterCommitMessage):
    part: str | None
    rows: int


class _Writer(DataSourceArrowWriter):
    """Every task writes one part into a hidden folder beside the target; the commit publishes them together."""

    def __init__(self, options, schema, overwrite):
        self.path = Path(options["path"])
        self.staging = self.path.with_name(f".{self.path.name}.{uuid.uuid4().hex}.tmp")
        self.geometry = options.get("geometry_column", "geometry")
        self.codec = options.get("compression", "zstd")
        self.row_group = int(options.get("row_group_size", 65_536))
        self.page = int(options.get("data_page_size", 1 << 20))
        self.overwrite = overwrite
        crs = options.get("crs")
        try:
            crs = json.loads(crs) if crs else None
        except json.JSONDecodeError:
            pass
        column = {"encoding": "WKB", "geometry_types": [t for t in options.get("geometry_types", "").split(",") if t]}
        if crs is not None:
            column["crs"] = crs
        self.footer = json.dumps({"version": "1.1.0", "primary_column": self.geometry, "columns": {self.geometry: column}}, sort_keys=True)
        if self.codec not in CODECS:
            raise ValueError(f"unknown codec {self.codec!r}")
        if self.geometry not in schema.fieldNames():
            raise ValueError(f"no geometry column {self.geometry!r}")
        if self.path.exists() and not overwrite:
            raise FileExistsError(str(self.path))
        os.makedirs(self.staging, exist_ok=True)

    def write(self, iterator):
        import pyarrow as pa
        import pyarrow.parquet as pq

        writer, rows, name = None, 0, f"part-{uuid.uuid4().hex}.parquet"
        try:
            for batch in iterator:
                if batch.num_rows:
                    if writer is None:
                        schema = batch.schema.with_metadata({b"geo": self.footer.encode()})
                        writer = pq.ParquetWriter(self.staging / name, schema, compression=None if self.codec == "none" else self.codec, data_page_size=self.page)
                    writer.write_table(pa.Table.from_batches([batch]).replace_schema_metadata({b"geo": self.footer.encode()}), row_group_size=self.row_group)
                    rows += batch.num_rows
        finally:
            if writer is not None:
                writer.close()
        return _Written(name if rows else None, rows)

    def commit(self, messages):
        import shutil

        parts = {m.part for m in messages if m is not None and m.part}
        if not parts:
            shutil.rmtree(self.staging, ignore_errors=True)
            raise ValueError("there are no features to write")
        for left in self.staging.iterdir():  # of tasks that ran more than once
            if left.name not in parts:
                left.unlink()
        aside = self.path.with_name(f".{self.path.name}.{uuid.uuid4().hex}.old")
        replaced = self.path.exists() and self.overwrite
        if replaced:  # the old data stay until the new ones are in place, and come back if these cannot be
            os.replace(self.path, aside)
        try:
            os.replace(self.staging, self.path)
        except OSError:
            if replaced:
                os.replace(aside, self.path)
            raise
        if replaced:
            shutil.rmtree(aside, ignore_errors=True) if aside.is_dir() else aside.unlink(missing_ok=True)

    def abort(self, messages):
        import shutil

        shutil.rmtree(self.staging, ignore_errors=True)


class GeoParquetSink(DataSource):
    """df.write.format("geoparquet").mode("append" or "overwrite").option("path", folder)...; the folder must be one all executors share."""

    @classmethod
    def name(cls):
        return "geoparquet"

    def schema(self):
        return "geometry binary"

    def writer(self, schema, overwrite):
        return _Writer(dict(self.options), schema, overwrite)


def write(df: DataFrame, path: str | Path, overwrite: bool = False, **options) -> None:
    """Write features with WKB geometries as GeoParquet 1.1: all parts appear at once or none does. An existing target is refused unless overwrite; no rows raise."""
    df.sparkSession.dataSource.register(GeoParquetSink)
    writer = df.write.format("geoparquet").mode("overwrite" if overwrite else "append").option("path", str(path))
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.save()
