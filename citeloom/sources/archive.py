"""Corpus archives: tables with a manifest of the format's version, without fields that only hold locally."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

VERSION = 1
LOCAL = ["pdf_file", "text_file"]


def export(tables: dict[str, DataFrame], path: str, source: str = "") -> None:
    """Writes tables and, last, the manifest: without it an archive isn't whole."""
    for name, df in tables.items():
        df.drop(*LOCAL).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    manifest = json.dumps({"format_version": VERSION, "source": source, "tables": sorted(tables)})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of an archive of this version."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first().value)
    if manifest.get("format_version") != VERSION:
        raise ValueError(f"unknown format version: {manifest.get('format_version')}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in manifest["tables"]}


def changes_from_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a JSON-lines manifest of patches; malformed lines are left out."""
    return spark.read.schema("timestamp string, source string, description string, file string").option("mode", "DROPMALFORMED").json(path)


def unpacked(spark: SparkSession, path: str, to: str) -> str:
    """The folder ``to`` with the members of a zipped corpus, whose manifest must state this version.

    Members are streamed from one file system to the other on the driver; they
    are read with ``documents`` from there.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop
    source, folder = hadoop.fs.Path(path), hadoop.fs.Path(to)
    fs = folder.getFileSystem(conf)
    zipped = jvm.java.util.zip.ZipInputStream(source.getFileSystem(conf).open(source))
    try:
        while (entry := zipped.getNextEntry()) is not None:
            name = entry.getName()
            if entry.isDirectory() or name.startswith("/") or ".." in name.split("/"):
                continue  # nothing is written outside the folder
            out = fs.create(hadoop.fs.Path(folder, name))
            hadoop.io.IOUtils.copyBytes(zipped, out, 1 << 16, False)
            out.close()
    finally:
        zipped.close()
    manifest = spark.read.text(f"{to}/manifest.json", wholetext=True).first()
    found = json.loads(manifest.value).get("format_version") if manifest else None
    if found != VERSION:
        raise ValueError(f"unknown format version: {found}")
    return to
