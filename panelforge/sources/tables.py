"""Table, file, JSON and JDBC sources and sinks."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FETCH_ROWS = "10000"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- Parquet ----------------------------------------------------------------
def load_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def save_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def save_if_absent(df: DataFrame, path: str) -> None:
    """Combined-file sink: an existing result is kept."""
    save_parquet(df, path, mode="ignore")


def scan_files(
    spark: SparkSession,
    paths: Sequence[str],
    schema: T.StructType | None = None,
    source_col: str | None = "source_table",
) -> DataFrame:
    """Union of Parquet tables by column name, from explicit paths only.

    With a schema it is one multi-path scan. Without, every table keeps its own
    footer schema and absent columns are NULL.
    """
    if schema is not None:
        df = spark.read.schema(schema).parquet(*paths)
        if source_col:
            whole = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+?)\.parquet(?:/[^/]*)?$", 1)
            df = df.select("*", whole.alias(source_col))
        return df
    parts = []
    for path in paths:
        part = spark.read.parquet(path)
        if source_col:
            stem = path.rstrip("/").rsplit("/", 1)[-1].removesuffix(".parquet")
            part = part.withColumn(source_col, F.lit(stem))
        parts.append(part)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def export_tables(tables: Mapping[str, DataFrame], out_dir: str) -> list[str]:
    """One Parquet directory per table, replacing earlier exports; returns their paths."""
    paths = []
    for name, df in tables.items():
        path = f"{out_dir}/{name}.parquet"
        save_parquet(df, path)
        paths.append(path)
    return paths


# --- JDBC -------------------------------------------------------------------
def normalize_table_name(sheet: str) -> str:
    return ("t" + sheet.replace("-", "_")).lower()


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    key: str | None = None,
    num_partitions: int = 16,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """Table scan over JDBC, split on a numeric key when one is given.

    The key's range is asked of the database, so the split needs no guess.
    """
    props = {"fetchsize": FETCH_ROWS, **(properties or {})}
    if key is None:
        return spark.read.jdbc(url, table, properties=props)
    bounds_query = f"(SELECT min({key}) AS lo, max({key}) AS hi FROM {table}) b"
    bounds = spark.read.jdbc(url, bounds_query, properties=props).first()
    if bounds[0] is None:
        return spark.read.jdbc(url, table, properties=props)
    return spark.read.jdbc(
        url,
        table,
        column=key,
        lowerBound=int(bounds[0]),
        upperBound=int(bounds[1]) + 1,
        numPartitions=num_partitions,
        properties=props,
    )


def jdbc_to_parquet(
    spark: SparkSession,
    url: str,
    tables: Sequence[str],
    out_dir: str,
    keys: Mapping[str, str] | None = None,
    properties: Mapping[str, str] | None = None,
) -> list[str]:
    """Export database tables to one Parquet directory each."""
    frames = {t: read_jdbc(spark, url, t, (keys or {}).get(t), properties=properties) for t in tables}
    return export_tables(frames, out_dir)


def write_jdbc(
    df: DataFrame, url: str, sheet: str, properties: Mapping[str, str] | None = None, max_connections: int = 32
) -> str:
    """Replace a database table; the number of writing tasks bounds the connections."""
    table = normalize_table_name(sheet)
    writer = df.write.mode("overwrite").option("numPartitions", max_connections)
    writer.jdbc(url, table, properties=dict(properties or {}))
    return table


# --- JSON results -----------------------------------------------------------
def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def append_manifest(spark: SparkSession, path: str, run_id: str, stage: str, status: str, config: Mapping) -> None:
    """One row per run, written whether it failed or not."""
    row = [(run_id, stage, status, json.dumps(dict(config), sort_keys=True, default=str))]
    schema = "run_id string, stage string, status string, config string"
    spark.createDataFrame(row, schema).write.mode("append").parquet(path)


class StageStore:
    """Named stage results of one run: written as Parquet, read back by the next stage.

    A stage counts as finished once its marker is written, after its last file. With ``resume`` a
    run takes finished stages as they are until it meets one that is not; that one and all later
    stages are built again.
    """

    def __init__(self, spark: SparkSession, root: str, run_id: str, resume: bool = False):
        self.spark = spark
        self.root = f"{root.rstrip('/')}/run={run_id}"
        self._resuming = resume

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        save_parquet(df, self.path(name))
        return self.load(name)

    def load(self, name: str) -> DataFrame:
        return load_parquet(self.spark, self.path(name))

    def stage(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The finished stage of that name, or the result of ``build`` stored as it."""
        files, marker = self._marker(name)
        if not (self._resuming and files.exists(marker)):
            self._resuming = False
            files.delete(marker, False)
            save_parquet(build(), self.path(name))
            files.create(marker, True).close()
        return self.load(name)

    def finished(self, name: str) -> bool:
        files, marker = self._marker(name)
        return files.exists(marker)

    def _marker(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_finished/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path
