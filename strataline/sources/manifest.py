"""Digests of files against a manifest: a line for each file, its SHA-256 and its path below the root."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def digests(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path (below the root), sha256 of all files below the root whose names fit the pattern."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    whole = F.regexp_replace("path", "^[a-z]+:/*", "/")
    base = "/" + str(root).split(":", 1)[-1].strip("/") + "/"
    return files.select(F.substr(whole, F.lit(len(base) + 1)).alias("path"), F.sha2("content", 256).alias("sha256"))


def read(spark: SparkSession, manifest: str) -> DataFrame:
    """path, sha256 of the lines of a manifest; empty lines and those that begin with # say nothing."""
    lines = spark.read.text(manifest).where("trim(value) <> '' AND value NOT LIKE '#%'")
    parts = F.split(F.trim("value"), r"\s+", 2)
    return lines.select(F.regexp_replace(parts[1], r"^[*]", "").alias("path"), F.lower(parts[0]).alias("sha256"))


def violations(found: DataFrame, listed: DataFrame) -> DataFrame:
    """path, fault: files that are missing, not listed, listed twice, or of another digest."""
    one = listed.groupBy("path").agg(F.count("*").alias("n"), F.min("sha256").alias("want"))
    joined = found.join(one, "path", "full_outer")
    fault = F.when(F.col("n").isNull(), "not listed").when(F.col("n") > 1, "listed twice").when(F.col("sha256").isNull(), "missing").when(F.col("sha256") != F.col("want"), "changed")
    return joined.select("path", fault.alias("fault")).where("fault IS NOT NULL")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Hold the files below a folder against a manifest.")
    p.add_argument("root")
    p.add_argument("manifest")
    p.add_argument("--pattern", default="*")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    wrong = violations(digests(spark, str(Path(a.root).resolve()), a.pattern), read(spark, a.manifest)).orderBy("path").limit(50).collect()
    for r in wrong:
        print(f"{r['fault']}: {r['path']}")
    return 1 if wrong else 0


if __name__ == "__main__":
    raise SystemExit(main())
