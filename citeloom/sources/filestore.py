"""A context index that is kept per file: after a change only what the changed files hold is read, parsed and written.

The store is a Parquet table partitioned by a hash of the file's name, beside it
the purposes of each part counted as partial sums, and the fingerprint of every
file taken up.  An update compares fingerprints, reads the parts of the files
that are new, changed or gone, and replaces just these parts; all others keep
their files.  The fingerprints are written last, so that an update that was cut
short is simply done again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.sources.store import cut

#: Parts of a store: a file shares its part with one in so many.
PARTS = 256


def part_of(file: Column, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(file), F.lit(parts)).cast("int")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    fs, p = _fs(spark, path)
    return spark.read.schema(schema).parquet(path) if fs.exists(p) else spark.createDataFrame([], schema)


def differences(files: DataFrame, known: DataFrame) -> DataFrame:
    """file, part, state (new, changed, gone): by fingerprint."""
    both = files.select("file", "fingerprint").join(known.select("file", F.col("fingerprint").alias("before")), "file", "full_outer")
    state = F.when(F.col("before").isNull(), "new").when(F.col("fingerprint").isNull(), "gone").when(F.col("fingerprint") != F.col("before"), "changed")
    return both.select("file", state.alias("state")).filter("state is not null")


class ContextStore:
    """rows: (file, ...) of the parsed contexts; sums: (purpose, n) of each part; files: (file, fingerprint)."""

    def __init__(self, spark: SparkSession, path: str, parse: Callable[[DataFrame], DataFrame], schema: str, parts: int = PARTS):
        """parse: (file, value) to rows with ``file`` and ``purpose`` of the given schema; it reads each file by itself."""
        self.spark, self.path, self.parse, self.schema, self.parts = spark, path, parse, schema, parts

    def _at(self, name: str, schema: str) -> DataFrame:
        return _stored(self.spark, f"{self.path}/{name}", f"{schema}, part int")

    def rows(self) -> DataFrame:
        return self._at("rows", self.schema).drop("part")

    def files(self) -> DataFrame:
        return self._at("files", "file string, fingerprint string").drop("part")

    def purposes(self) -> DataFrame:
        """purpose, n: the partial sums put together; no row is read."""
        return self._at("sums", "purpose string, n long").groupBy("purpose").agg(F.sum("n").alias("n"))

    def update(self, files: DataFrame) -> DataFrame:
        """Takes (file, value), all files that there are now; returns (file, state) of those that differed.

        Nulls count as empty texts.  Only texts of files that are new or changed
        are parsed.
        """
        now = files.select("file", F.coalesce("value", F.lit("")).alias("value")).withColumn("fingerprint", F.sha2("value", 256))
        found = cut(differences(now, self.files()).withColumn("part", part_of(F.col("file"), self.parts)))
        touched = found.select("part").distinct()
        fresh = self.parse(now.join(found.filter("state <> 'gone'").select("file"), "file", "left_semi").select("file", "value"))
        stay = lambda df: df.join(F.broadcast(touched), "part", "left_semi").join(found.select("file"), "file", "left_anti")  # noqa: E731  at most ``parts`` rows
        old = stay(self._at("rows", self.schema))
        rows = cut(old.unionByName(fresh.withColumn("part", part_of(F.col("file"), self.parts))))
        marks = now.join(found.filter("state <> 'gone'").select("file"), "file", "left_semi").select("file", "fingerprint").withColumn("part", part_of(F.col("file"), self.parts))
        marks = cut(stay(self._at("files", "file string, fingerprint string")).unionByName(marks))
        numbers = {r["part"] for r in touched.collect()}  # at most ``parts``
        self._replace("rows", rows, numbers)
        self._replace("sums", rows.groupBy("part", "purpose").agg(F.count("*").alias("n")), numbers)
        self._replace("files", marks, numbers)
        return found.select("file", "state")

    def _replace(self, name: str, df: DataFrame, parts: set[int]) -> None:
        """Puts the rows in the place of the parts touched; parts that have none any more go."""
        path = f"{self.path}/{name}"
        left = {r["part"] for r in df.select("part").distinct().collect()}
        if left:
            df.repartition("part").sortWithinPartitions("part").write.partitionBy("part").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
        for k in parts - left:
            fs, p = _fs(self.spark, f"{path}/part={k}")
            fs.delete(p, True)
