"""Files: label, pass and bank tables, images, manifests and configuration."""

from __future__ import annotations

import hashlib
import json
import os
import platform
import subprocess
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.functions.scalars import frame_number, label_list
from loomframe.sources.timeline import contiguity, parse_labels

PASSES = "scenario string, pass_id string, pass_start int, pass_end int, n_defect_frames int, labels string, dominant_label int, candidate_track_id string, mask_cy_mid double, pilot_fold string"
CLUSTERS = "scenario string, texture string, cluster string, condition_group string, readme_speed string, readme_illum string, pure_normal boolean, defect_frames int, motion_measurable boolean"
AUDIT = "fold string, `group` string, scenario string, frames int, defect_frames int, margin double, spacing int, eligible_clean int, capacity int, naive_equal_quota double, final_quota int"
BANK = "fold string, `group` string, scenario string, frame int"


def find_root(given: str | None = None, variable: str = "FRAME_DATA_ROOT", default: str | None = None, depth: int = 8) -> str | None:
    """First folder with CSV and IMAGE below it: given, from the environment, default, or found by a walk of the default's parent."""
    for place in (given, os.environ.get(variable), default):
        if place and (Path(place) / "CSV").is_dir():
            return place
    top = Path(default).parent if default else None
    if top and top.is_dir():
        for base, dirs, _ in os.walk(top):
            if {"CSV", "IMAGE"} <= set(dirs):
                return base
            if len(Path(base).relative_to(top).parts) >= depth:
                dirs.clear()
    return None


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table of a declared schema; rows that don't fit raise."""
    return spark.read.schema(schema).options(header=True, quote='"', escape='"', mode="FAILFAST").csv(path)


def read_labels(spark: SparkSession, root: str) -> DataFrame:
    """Labels of all scenarios below root/CSV; raises unless each has frames 1..N."""
    raw = spark.read.options(header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).csv(f"{root}/CSV")
    raw = raw.withColumn("scenario", F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)[.]csv$", 1))
    out = parse_labels(raw)
    if not contiguity(out).where("not contiguous").isEmpty():
        raise ValueError("frames must be exactly 1..N")
    return out


def read_passes(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, PASSES).withColumn("labels", label_list(F.col("labels")))


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, CLUSTERS)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Margins and spacings; an empty margin is null and means none."""
    return read_csv(spark, path, AUDIT)


def bank_problems(bank: DataFrame, quotas: DataFrame, groups: DataFrame, disjoint: list[tuple[str, str]] | None = None) -> DataFrame:
    """Rows (problem, fold, scenario) of a bank record that break its rules."""
    twice = bank.groupBy("fold", "scenario", "frame").count().where("count > 1").select(F.lit("repeated").alias("problem"), "fold", "scenario")
    wrong = bank.join(groups.withColumnRenamed("group", "own"), "scenario", "left").where("own is null or own != `group`").select(F.lit("group").alias("problem"), "fold", "scenario").distinct()
    counts = bank.groupBy("fold", "scenario").agg(F.count(F.lit(1)).alias("n"))
    quota = quotas.join(counts, ["fold", "scenario"], "full").where("coalesce(n, 0) != coalesce(quota, 0)").select(F.lit("quota").alias("problem"), "fold", "scenario")
    out = twice.unionByName(wrong).unionByName(quota)
    for bank_fold, scenario in disjoint or []:
        out = out.unionByName(bank.where((F.col("fold") == bank_fold) & (F.col("scenario") == scenario)).select(F.lit("test scenario").alias("problem"), "fold", "scenario").distinct())
    return out


def read_bank(spark: SparkSession, path: str, sha256: str | None = None) -> DataFrame:
    """A bank record in its order; raises if the file's digest is another."""
    if sha256 is not None:
        found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("d")).collect()
        if [r["d"] for r in found] != [sha256]:
            raise ValueError("the bank record has another digest")
    return read_csv(spark, path, BANK).orderBy("fold", "group", "scenario", "frame")


def write_bank(bank: DataFrame, path: str) -> None:
    """One CSV file in the record's order (a bounded table: one row for each bank frame)."""
    bank.orderBy("fold", "group", "scenario", "frame").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def decode_pgm(content: bytes) -> np.ndarray:
    """An 8-bit binary PGM image."""
    fields, at = [], 0
    while len(fields) < 4:
        while content[at : at + 1].isspace():
            at += 1
        if content[at : at + 1] == b"#":
            at = content.index(b"\n", at) + 1
            continue
        end = at
        while not content[end : end + 1].isspace():
            end += 1
        fields.append(content[at:end])
        at = end
    if fields[0] != b"P5" or int(fields[3]) != 255:
        raise ValueError("not an 8-bit binary PGM")
    w, h = int(fields[1]), int(fields[2])
    return np.frombuffer(content, np.uint8, w * h, at + 1).reshape(h, w)


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """(scenario, frame, path, content) of images whose name is a number; of equal numbers the last path wins."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root}/IMAGE")
    own = files.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("scenario"), F.regexp_extract("path", "/([0-9]+)[.][^/]*$", 1).alias("stem"), "path", "content").where("stem != ''")
    return own.groupBy("scenario", frame_number(F.col("stem")).alias("frame")).agg(F.max("path").alias("path"), F.max_by("content", "path").alias("content"))


def read_gray(images: DataFrame, rows: int, cols: int) -> DataFrame:
    """(scenario, frame, pixels) row by row; raises if an image has another shape."""

    def run(batches):

        for pdf in batches:
            got = [decode_pgm(bytes(c)) for c in pdf["content"]]
            if any(g.shape != (rows, cols) for g in got):
                raise ValueError("an image has another shape")
            yield pd.DataFrame({"scenario": pdf["scenario"], "frame": pdf["frame"], "pixels": [g.ravel().astype(np.int16) for g in got]})

    return images.select("scenario", "frame", "content").mapInPandas(run, "scenario string, frame int, pixels array<short>")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.length("content").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def list_digest(rows: DataFrame, name: str, value: str, by: str | None = None) -> DataFrame:
    """SHA-256 over sorted ``name TAB value`` lines of each group.

    The digest of a group is one chain, so its lines pass through one task, which
    sorts them (on disk where need be) and holds one batch at a time.
    """
    key = F.col(by) if by else F.lit(0)
    kind = dict(rows.dtypes)[by] if by else "int"
    line = F.concat(F.col(name).cast("string"), F.lit("\t"), F.col(value).cast("string"), F.lit("\n"))
    sorted_ = rows.select(key.alias("key"), F.col(name).cast("string").alias("name"), line.alias("line")).repartition("key").sortWithinPartitions("key", "name", "line")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, chain, out = None, None, []
        for pdf in batches:
            for k, part in pdf.groupby("key", sort=False)["line"]:
                if chain is None or k != now:
                    if chain is not None:
                        out.append((now, chain.hexdigest()))
                    now, chain = k, hashlib.sha256()
                chain.update("".join(part).encode())
        if chain is not None:
            out.append((now, chain.hexdigest()))
        yield pd.DataFrame(out, columns=["key", "digest"])

    got = sorted_.mapInPandas(run, f"key {kind}, digest string")
    return got.select(F.col("key").alias(by), "digest") if by else got.select("digest")


def file_sha256(path: str, block: int = 1 << 20) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while data := f.read(block):
            digest.update(data)
    return digest.hexdigest()


def array_sha256(a: np.ndarray) -> str:
    """Digest of dtype, shape and bytes."""
    a = np.ascontiguousarray(a)
    return hashlib.sha256(f"{a.dtype.str}|{a.shape}|".encode() + a.tobytes()).hexdigest()


def git_state(root: str) -> dict[str, str | bool]:
    git = lambda *a: subprocess.run(["git", "-C", root, *a], capture_output=True, text=True).stdout.strip()
    return {"commit": git("rev-parse", "HEAD"), "clean": not git("status", "--porcelain")}


def environment() -> dict[str, str]:
    import pyspark

    return {"python": platform.python_version(), "platform": platform.platform(), "numpy": np.__version__, "pyspark": pyspark.__version__}


def plain(x):
    """numpy values as JSON values."""
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, np.ndarray)):
        return [plain(v) for v in x]
    if isinstance(x, np.generic):
        return x.item()
    return x


def write_json(record: dict, path: str) -> None:
    Path(path).write_text(json.dumps(plain(record), sort_keys=True, indent=1) + "\n")


#: Tasks that the rows of one key are dealt to.
WRITE_PARTS = 8


def write_missing(df: DataFrame, path: str, key: str) -> None:
    """Append the keys that the dataset at ``path`` lacks, partitioned by key; a second run adds nothing."""
    spark = df.sparkSession
    try:
        have = spark.read.parquet(path).select(key).distinct()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        have = None
    rows = df if have is None else df.join(have, key, "left_anti")
    # by key and a part of its rows, so that a key is written by several tasks
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(WRITE_PARTS))
    rows.repartition(F.col(key), part).write.mode("append").partitionBy(key).parquet(path)


def write_arrays(df: DataFrame, path: str) -> dict:
    """Write a table and a manifest with a digest that doesn't depend on row order."""
    df.write.mode("overwrite").parquet(path)
    written = df.sparkSession.read.parquet(path)
    r = written.select(F.xxhash64(*written.columns).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("h")).first()
    record = {"rows": r["n"], "digest": str(r["h"]), "schema": written.schema.simpleString()}
    written.sparkSession.createDataFrame([json.dumps(record, sort_keys=True)], "string").coalesce(1).write.mode("overwrite").text(path + ".manifest")
    return record


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Read what ``write_arrays`` wrote; raises if its digest is another."""
    record = json.loads(spark.read.text(path + ".manifest").first()[0])
    df = spark.read.parquet(path)
    r = df.select(F.xxhash64(*df.columns).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("h")).first()
    if {"rows": r["n"], "digest": str(r["h"])} != {k: record[k] for k in ("rows", "digest")}:
        raise ValueError("the table has another digest")
    return df
