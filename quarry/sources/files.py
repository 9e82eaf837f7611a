"""File sources: repository scans, change lines, zip archives and document text."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ZIP_BYTES = 100 * 1024 * 1024
#: Endings of files that an archive may not hold.
EXECUTABLE_SUFFIXES = (".exe", ".dll", ".so", ".dylib", ".bat")


def scan_repository(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, change_type 'A') of every file below root; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return found.select("path", F.col("length").alias("size"), F.lit("A").alias("change_type"))


def parse_changes(lines: DataFrame, column: str = "value") -> DataFrame:
    """Tab-separated name-status lines: (..., change_type, file_path, previous_path)."""
    parts = F.split(F.col(column), "\t")
    renamed = F.startswith(F.get(parts, F.lit(0)), F.lit("R"))
    return lines.withColumns({
        "change_type": F.when(renamed, "R").otherwise(F.get(parts, F.lit(0))),
        "file_path": F.when(renamed, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1))),
        "previous_path": F.when(renamed, F.get(parts, F.lit(1))),
    })


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    return parse_changes(spark.read.text(path))


def check_zip(data: bytes, name: str = "archive.zip") -> str | None:
    """Why an archive is refused, or None: no .zip, too large, empty, not a zip, without SKILL.md at its root, or holding executables."""
    if not name.endswith(".zip"):
        return "not named .zip"
    if len(data) > MAX_ZIP_BYTES:
        return "too large"
    if not data:
        return "empty"
    try:
        names = zipfile.ZipFile(io.BytesIO(data)).namelist()
    except zipfile.BadZipFile:
        return "not a zip file"
    if "SKILL.md" not in names:
        return "no SKILL.md"
    return next((f"executable: {n}" for n in names if n.endswith(EXECUTABLE_SUFFIXES)), None)


def read_zip_members(archives: DataFrame) -> DataFrame:
    """(archive, member, content, problem) from (path, content) rows; a refused archive is one row with its problem."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"]):
                if problem := check_zip(data, path):
                    rows.append((path, None, None, problem))
                    continue
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    rows += [(path, n, z.read(n), None) for n in z.namelist() if not n.endswith("/")]
            yield pd.DataFrame(rows, columns=["archive", "member", "content", "problem"])

    return archives.select("path", "content").mapInPandas(run, "archive string, member string, content binary, problem string")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of text and code files, one row a file."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
