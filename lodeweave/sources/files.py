"""File scans as DataFrames: recursive binary reads, include globs, low-signal files, line-delimited JSON."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocab import source_type

# Suffixes of the files that are read.
EXTENSIONS = [".c", ".cc", ".cpp", ".h", ".hpp", ".md", ".rst", ".txt", ".pdf"]


def glob_pattern(glob: str) -> str:
    """Regular expression of an include glob, anchored at the right; a leading `**/` may match nothing."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            out, i = out + "[" + glob[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"(?:^|/){out}$"


def low_signal(path: Column) -> Column:
    """Firmware images in headers, and signed microcode."""
    return F.lower(path).rlike(r"/ucode/[^/]*[.]h$|ucode[^/]*_signed[.][hc]$")


def safe_subfolder(text: str) -> tuple[str, list[str]]:
    """(folder, globs) of `folder:glob,glob`; refuses absolute paths, home and parent references."""
    root, _, globs = text.partition(":")
    if root.startswith(("/", "~")) or ".." in root.split("/") or ":" in globs:
        raise ValueError(f"not a path inside the source root: {text}")
    return root.strip("/"), [g for g in globs.split(",") if g]


def scan(spark: SparkSession, root: str, include: list[str] | None = None, folders: list[str] | None = None) -> DataFrame:
    """(path, source_type, content) of the files under a root: wanted suffixes, no .git, no low-signal files, each path once."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    path = F.regexp_replace(F.regexp_replace("path", "^file:(//)?", ""), "^" + re.escape(re.sub("^file:(//)?", "", base)), "")
    df = df.select(path.alias("path"), "content")
    low = F.lower("path")
    keep = low.rlike("(?:" + "|".join(re.escape(x) for x in EXTENSIONS) + ")$") & ~F.col("path").rlike("(?:^|/)[.]git/") & ~low_signal(F.col("path"))
    df = df.where(keep)
    if include:
        df = df.where(F.col("path").rlike("|".join(glob_pattern(g) for g in include)))
    if folders:
        wanted = F.lit(False)
        for f in folders:
            folder, globs = safe_subfolder(f)
            inside = F.col("path").startswith(folder + "/") if folder else F.lit(True)
            wanted = wanted | (inside & (F.col("path").rlike("|".join(glob_pattern(g) for g in globs)) if globs else F.lit(True)))
        df = df.where(wanted)
    return df.dropDuplicates(["path"]).withColumn("source_type", source_type(F.col("path")))


def text_files(files: DataFrame) -> DataFrame:
    """(path, source_type, text) of the files that aren't paged documents; bytes that aren't UTF-8 become replacement characters."""
    return files.where("source_type <> 'pdf'").select("path", "source_type", F.decode("content", "UTF-8").alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """Rows of a line-delimited JSON file with `#` comments; a line without a required field is dropped."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(?:#|$)"))
    rows = lines.select(F.from_json("value", schema).alias("r")).select("r.*")
    for c in required:
        rows = rows.where(F.col(c).isNotNull())
    return rows
