"""Landing of intermediate tables in the shared folder, so lineage is cut and a lost executor costs little."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tandem.session import landing_path


def land(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write the frame as Parquet under ``spark.checkpoint.dir`` and read it back."""
    spark = df.sparkSession
    path = landing_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables on the way to a result: each is dropped once what was made of it is landed.

    Inside ``with``, Spark also deletes the shuffle files of every finished query,
    so the disk holds one step at a time. A lost executor costs a re-read of landed
    tables; a query that still runs keeps its shuffle files.
    """

    _CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, tuple[str, object]] = {}

    def __enter__(self) -> Scratch:
        self.before = self.spark.conf.get(self._CLEANUP, "false")
        self.spark.conf.set(self._CLEANUP, "true")
        return self

    def __exit__(self, *_) -> None:
        self.spark.conf.set(self._CLEANUP, self.before)

    def land(self, df: DataFrame, name: str, partition: str | None = None, compression: str = "snappy", hashes: tuple[str, ...] = ()) -> DataFrame:
        path = landing_path(self.spark, name)
        writer = df.write.option("compression", compression)
        for c in hashes:  # no value repeats often enough for a dictionary
            writer = writer.option(f"parquet.enable.dictionary#{c}", "false")
        (writer.partitionBy(partition) if partition else writer).parquet(path)
        self.tables[name] = path, df.schema
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        path, schema = self.tables[name]
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, name: str, partition: str = "") -> None:
        """Delete a landed table, or one partition of it."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.tables[name][0]}/{partition}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
