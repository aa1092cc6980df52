"""Sinks: snapshots that cut lineage, history, upserts and pruning over Parquet tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share, gone with the session.

    ``spark.checkpoint.dir`` names the folder.  Only a session on one machine
    may do without; elsewhere a local folder would lose rows.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir isn't set")
        base = "/tmp/checkpoints"
    path = f"{base.rstrip('/')}/citeloom-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = shared_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, *then: str) -> DataFrame:
    """df as a table in the shared folder, bucketed by ``key`` and sorted within buckets: joins on the key move only the other side."""
    spark = df.sparkSession
    name, n = f"citeloom_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key, *then).option("path", shared_path(spark)).saveAsTable(name)
    return spark.table(name)


def replace_table(df: DataFrame, path: str) -> DataFrame:
    """Writes a table anew; reading it in the same plan is safe, since rows are written aside first."""
    cut(df).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All new rows, and the old ones whose key isn't among them."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def filled(target: DataFrame, source: DataFrame, key: str, columns: list[str], overwrite: bool = False) -> DataFrame:
    """target with columns from source where they are null or empty (everywhere if overwrite), an empty source value counting as null."""
    other = source.select(key, *[F.nullif(F.col(c), F.lit("")).alias(f"_{c}") for c in columns])
    joined = target.join(other.withColumn("_hit", F.lit(True)), key, "left")
    pick = lambda c: F.when(F.col("_hit") & F.lit(overwrite), F.col(f"_{c}")).otherwise(F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}"), F.col(c)))
    return joined.select([pick(c).alias(c) if c in columns else F.col(c) for c in target.columns])


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, operation (add, remove, replace), before and after as JSON: the rows that differ."""
    doc = lambda df: F.to_json(F.struct(*[F.col(c) for c in df.columns]))
    a, b = old.select(key, doc(old).alias("before")), new.select(key, doc(new).alias("after"))
    both = a.join(b, key, "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))
    kind: Column = F.when(F.col("before").isNull(), "add").when(F.col("after").isNull(), "remove").otherwise("replace")
    return both.select(key, kind.alias("operation"), "before", "after")


def record(spark: SparkSession, path: str, found: DataFrame, source: str, description: str) -> None:
    """Appends changes to a history table, under one new number."""
    stamp = F.struct(F.current_timestamp().alias("timestamp"), F.lit(source).alias("source"), F.lit(description).alias("description"), F.lit(uuid.uuid4().hex).alias("batch"))
    found.select(stamp.alias("s"), "*").select("s.*", *found.columns).write.mode("append").parquet(path)


def newest(history: DataFrame, n: int, order: str = "timestamp", tie: str = "batch") -> DataFrame:
    return history.orderBy(F.desc(order), F.desc(tie)).limit(n)


def undone(new: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The table before the changes: exact, since they hold whole rows."""
    old = found.filter("before is not null").select(F.from_json("before", new.schema).alias("r")).select("r.*")
    return new.join(found.select(key), key, "left_anti").unionByName(old)


def pruned(history: DataFrame, n: int, order: str = "timestamp", tie: str = "batch") -> DataFrame:
    """The history without all but its newest n changes' batches."""
    last = history.select(order, tie).distinct().orderBy(F.desc(order), F.desc(tie)).limit(n)
    return history.join(last, [order, tie], "left_semi")


def published(df: DataFrame, path: str) -> DataFrame:
    """A read-only copy for others: written whole beside the old one, then put in its place."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    old, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    df.write.parquet(str(new.toString()))
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"can't put the copy at {path}")
    return spark.read.schema(df.schema).parquet(path)


def as_json(df: DataFrame, key: str) -> DataFrame:
    """key, value: each row as a JSON object with its fields in order of name."""
    return df.select(key, F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])).alias("value"))


def tracked(df: DataFrame, path: str, key: str, history: str, source: str, description: str) -> DataFrame:
    """Replaces the table at ``path`` and appends what changed to ``history``; without an earlier table or a change there is nothing to append."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    new = cut(df)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        found = cut(changes(spark.read.parquet(path), new, key))
        if not found.isEmpty():
            record(spark, history, found, source, description)
    return replace_table(new, path)
