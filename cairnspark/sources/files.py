"""Files as rows: folders through Spark's readers, manifests, settings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.functions.policy import Profile


def scan_files(spark: SparkSession, roots: list[str], with_content: bool = False) -> DataFrame:
    """path, name, size, mtime (and content) of all files below roots, in any store that Spark reads.

    The content column is only read if it is asked for. Hidden files and folders are left out by the reader.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots)
    path = F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*)?", "")
    out = found.select(path.alias("path"), F.element_at(F.split(path, "/"), -1).alias("name"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"), *(["content"] if with_content else []))
    return out.dropDuplicates(["path"]) if len(roots) > 1 and not with_content else out


def root_access(spark: SparkSession, roots: list[str]) -> list[tuple[str, str]]:
    """Each root with ok, denied or missing."""
    jvm, conf, out = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for root in roots:
        p = jvm.org.apache.hadoop.fs.Path(root)
        fs = p.getFileSystem(conf)
        try:
            if not fs.exists(p):
                out.append((root, "missing"))
                continue
            fs.listStatus(p)
            out.append((root, "ok"))
        except Exception:
            out.append((root, "denied"))
    return out


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, size, hash of a tab-separated manifest with a header row."""
    return spark.read.csv(path, sep="\t", header=True, schema="path string, size bigint, hash string")


def read_sample_log(spark: SparkSession, path: str) -> DataFrame:
    """t_epoch, main_mb, main_peak_mb, child_mb, cpu_pct, nproc of a log of samples; lines that begin with # are comments."""
    ddl = "t_epoch bigint, main_mb double, main_peak_mb double, child_mb double, cpu_pct double, nproc int"
    return spark.read.csv(path, sep=" ", comment="#", schema=ddl)


def save_settings(spark: SparkSession, path: str, profile: Profile) -> None:
    """Write settings beside path and rename them into place, so that a reader finds the old ones or the new, never half."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, aside = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.{uuid.uuid4().hex}.tmp"))
    out = target.getFileSystem(conf).create(aside, True)
    try:
        out.write(bytearray(profile.to_json().encode()))
    finally:
        out.close()
    overwrite = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = overwrite
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(aside, target, options)


def load_settings(spark: SparkSession, path: str) -> tuple[Profile, list[str]]:
    """Settings from a JSON file and what was moved into range; a missing or broken file gives the defaults."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return Profile(), []
    text = spark.read.text(path, wholetext=True).first()
    return Profile.from_json(text[0] if text else None).sanitized()
