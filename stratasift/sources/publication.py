"""Tables that are published together or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratasift.staging import path_exists, remove_folder

_MANIFEST = "version int, table string, n_rows long, schema string"


class PublicationError(RuntimeError):
    """What was staged is not what should be published."""


class Publication:
    """Versions of a set of tables below one folder.

    Phase one writes every table of the next version to a folder that nobody
    reads; phase two counts them again and appends one row for each table to
    the manifest, in one file.  Readers take the newest version in the
    manifest, so they see all of a publication or none of it, and what a
    crashed one has left is overwritten by the next.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def manifest(self) -> DataFrame:
        path = f"{self.root}/manifest"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(path)

    def version(self) -> int | None:
        return self.manifest().agg(F.max("version")).first()[0]

    def _folder(self, version: int, table: str) -> str:
        return f"{self.root}/versions/{version}/{table}"

    def read(self, table: str, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if version is None:
            raise PublicationError("nothing is published")
        row = self.manifest().where((F.col("version") == version) & (F.col("table") == table)).first()
        if row is None:
            raise PublicationError(f"version {version} has no {table}")
        return self.spark.read.schema(row["schema"]).parquet(self._folder(version, table))

    def publish(self, tables: dict[str, DataFrame], problems: DataFrame | None = None) -> int | None:
        """The number of the new version; with any row in ``problems`` nothing is written and there is none."""
        if problems is not None and problems.limit(1).count():
            return None
        version = (self.version() or 0) + 1
        entries = []
        try:
            for name, rows in tables.items():
                rows.write.mode("overwrite").parquet(self._folder(version, name))
                ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
                entries.append((version, name, self.spark.read.schema(ddl).parquet(self._folder(version, name)).count(), ddl))
        except Exception:
            remove_folder(self.spark, f"{self.root}/versions/{version}")
            raise
        self.spark.createDataFrame(entries, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        return version
