"""The compact file tree of a repository, from a table of its paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import size_label

# --- fixed values ---
SKIP_DIRS = (".git", "node_modules", "vendor", "__pycache__", ".bundle", "dist", "build", ".next", ".nuxt", ".cache", ".tox", ".mypy_cache", ".pytest_cache", "coverage", ".idea", ".vscode", "tmp", "log", ".gradle", ".mvn", "target", "bin", "obj", ".dart_tool", "Pods", ".swiftpm", "venv", ".venv", "env", ".env")
BINARY_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".tar", ".gz", ".bz2", ".rar", ".7z", ".mp3", ".mp4", ".avi", ".mov", ".mkv", ".wav", ".flac", ".ttf", ".otf", ".woff", ".woff2", ".eot", ".pen", ".fig", ".sketch", ".exe", ".dll", ".so", ".dylib", ".a", ".lib", ".pyc", ".pyo", ".class", ".lock", ".min.js")
MAX_TREE_LINES = 2000
# --- end of fixed values ---


def _skipped(name):
    return name.isin(*SKIP_DIRS) | F.startswith(name, F.lit("."))


def tree_lines(files: DataFrame, most: int = MAX_TREE_LINES) -> DataFrame:
    """(key, line) of files (path, lines): an indented tree in the order of ``key``, files before folders, the first ``most`` lines.

    A folder with one folder and nothing else shares its line with it.  Skipped folders go with all they hold; binary files have
    no line but keep their folder's.  Each path gives a row for each folder above it, so the work is spread by paths and folders.
    """
    parts = files.select(F.split("path", "/").alias("p"), "lines").where(~F.exists(F.slice("p", 1, F.size("p") - 1), _skipped))
    name = F.element_at("p", -1)
    parts = parts.select("p", "lines", name.alias("name"), F.slice("p", 1, F.size("p") - 1).alias("dir"))
    # each folder's children, hidden files apart: to tell chains and empty folders
    up = parts.where(~_skipped(F.col("name"))).select("dir", F.col("name").alias("child"), F.lit(True).alias("file"))
    chain = parts.where(F.size("dir") > 0).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("dir")), lambda n: F.slice("dir", 1, n))).alias("own")).distinct()
    up = up.unionByName(chain.select(F.slice("own", 1, F.size("own") - 1).alias("dir"), F.element_at("own", -1).alias("child"), F.lit(False).alias("file")))
    sizes = up.groupBy("dir").agg(F.count_if(F.col("file")).alias("files"), F.count_if(~F.col("file")).alias("dirs"))
    shown = chain.join(sizes.withColumnRenamed("dir", "own"), "own").withColumn("through", (F.col("dirs") == 1) & (F.col("files") == 0))
    # which of the folders above a row are passed through, in one row a folder
    above = chain.select("own", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("own")), lambda n: F.slice("own", 1, n))).alias("at", "up"))
    above = above.join(shown.select(F.col("own").alias("up"), "through"), "up", "left").groupBy("own").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("through", F.lit(False)).alias("t")))), lambda x: x["t"]).alias("through_of"))
    key = lambda names, last: F.concat(F.transform(names, lambda n: F.concat(F.lit("1"), n)), last)
    kept = lambda t: F.size(F.filter(t, lambda x: ~x))
    # a folder's label: itself after the folders passed through just above it
    dirs = shown.where("not through").join(above, "own")
    before = F.reverse(F.slice("through_of", 1, F.size("through_of") - 1))
    run = F.coalesce(F.nullif(F.array_position(before, False), F.lit(0)) - 1, F.size(before)).cast("int")
    label = F.concat(F.array_join(F.slice("own", F.size("own") - run, run + 1), "/"), F.lit("/"))
    dir_lines = dirs.select(key(F.col("own"), F.array().cast("array<string>")).alias("key"), F.concat(F.repeat(F.lit("  "), kept(F.slice("through_of", 1, F.size("through_of") - 1))), label).alias("line"))
    extension = F.regexp_extract("name", r"[^/](\.[^.]*)$", 1)
    own_files = parts.where(~F.lower(extension).isin(*BINARY_EXTENSIONS)).join(above.withColumnRenamed("own", "dir"), "dir", "left")
    # hidden files show only beside what keeps their folder's line
    own_files = own_files.join(shown.select(F.col("own").alias("dir"), F.col("through").alias("passed")), "dir", "left").where((F.size("dir") == 0) | ~F.coalesce("passed", F.lit(True)))
    depth = F.coalesce(kept(F.col("through_of")), F.lit(0))
    file_lines = own_files.select(key(F.col("dir"), F.array(F.concat(F.lit("0"), F.col("name")))).alias("key"), F.concat(F.repeat(F.lit("  "), depth), F.col("name"), F.lit(" ["), size_label(F.col("lines")), F.lit("]")).alias("line"))
    return dir_lines.unionByName(file_lines).orderBy("key").limit(most)
