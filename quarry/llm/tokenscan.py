"""Token counts of flat token files by separator scan.

Method: a flat file is two-byte little-endian token ids with an end-of-document id after each document and no index.  A file
is cut into pieces of BLOCK_TOKENS tokens, a row each, which are dealt over tasks whatever file they belong to; in each piece the
separators are found by vectorised comparisons.  A prefix scan over the pieces of a file (a window over one row a piece)
carries the last separator and the document count on, so a document that runs over any number of pieces gets its start from
the piece where it began.  The first ``lead`` tokens of each document come along; a piece reads as many tokens beyond its end.

A piece is read where it lies, by its path, offset and length, through Arrow's file systems (local, HDFS, S3, GCS).  Where
Arrow does not know the scheme, Spark reads whole files (each below 2 GB) and the pieces are cut from these.

``write_flat`` makes such files with Spark's text writer: a document's tokens are one value and the two bytes of END, both
ASCII, are the line separator.

Defined results: an empty document counts zero tokens; tokens after the last separator are a document, none are not; an odd
byte at the end of a file is no token; an empty file, folder or table gives none; null and empty texts have no tokens;
repeated rows are documents each; any 64-bit doc_id and null come back as they were.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, known_to_arrow, shared_dir, table, written

#: The end-of-document id: the bytes "}}".  Token ids lie below IDS, so they never equal it.
END = 0x7D7D
IDS = 32000
#: Tokens before a document's own: the sign of its doc_id (0: null, 1: from zero on, 2: below) and five digits to the base IDS.
DIGITS = 5
LEAD = DIGITS + 1
BLOCK_TOKENS = 1 << 22


def _bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        col = b.column(0)
        cuts = col.offsets.to_numpy() * 2
        ids = col.values.to_numpy(zero_copy_only=False)
        if len(ids) and not (0 <= ids.min() and ids.max() < IDS):  # a null among them is no number and fails alike
            raise ValueError(f"token ids lie from 0 to {IDS - 1}")
        data = ids.astype("<u2").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([data[x:y] for x, y in zip(cuts[:-1], cuts[1:])], pa.binary())], names=["value"])


def write_flat(tokens: DataFrame, column: str, path: str) -> None:
    """Writes arrays of token ids (0 to IDS - 1; others raise) as flat files."""
    end = bytes([END & 255, END >> 8]).decode("ascii")
    raw = tokens.select(F.coalesce(F.col(column), F.array().cast("array<int>")).alias("t")).mapInArrow(_bytes_of, "value binary")
    raw.select(F.col("value").cast("string")).write.option("lineSep", end).text(path)


def _found(path: str, at: int, size: int, data: bytes, end: int, lead: int) -> pa.RecordBatch:
    """One piece: where its documents end (in tokens of the file), and the first tokens of those that begin after each end and, in ``head``, at its start."""
    import numpy as np

    t = np.frombuffer(data, "<u2", len(data) // 2)
    own = t[: size // 2]
    ends = np.flatnonzero(own == end)
    padded = np.concatenate([t, np.full(lead + 1, end, t.dtype)]).astype(np.int32)
    leads = padded[np.minimum(ends[:, None] + 1 + np.arange(lead), len(padded) - 1)]
    cuts = pa.array(np.arange(len(ends) + 1, dtype=np.int32) * lead)
    values = [
        pa.array([path], pa.string()),
        pa.array([at // 2], pa.int64()),
        pa.array([len(own)], pa.int64()),
        pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), pa.array(ends + at // 2, pa.int64())),
        pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), pa.ListArray.from_arrays(cuts, pa.array(leads.ravel(), pa.int32()))),
        pa.array([padded[:lead].tolist()], pa.list_(pa.int32())),
    ]
    return pa.RecordBatch.from_arrays(values, names=["path", "first", "size", "ends", "leads", "head"])


_FOUND = "path string, first long, size long, ends array<long>, leads array<array<int>>, head array<int>"


def _ranges(end: int, lead: int):
    """Reads each piece (path, at, size) where it lies, and ``lead`` tokens more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for path, at, size in zip(*(c.to_pylist() for c in b.columns)):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as f:
                    yield _found(path, at, size, f.read_at(size + 2 * lead, at), end, lead)

    return run


def _cut(end: int, lead: int, piece: int):
    """Cuts whole files (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1)):
                data = data.as_buffer()
                for at in range(0, data.size, piece):
                    yield _found(path, at, min(piece, data.size - at), data[at : at + piece + 2 * lead], end, lead)

    return run


def stitched(pieces: DataFrame, lead: int = LEAD) -> DataFrame:
    """From pieces (path, first, size, ends, leads, head) in any order: (path, doc_index, start, n_tokens, lead) of every document, in tokens."""
    # the prefix scan: where the running document of each piece began, and how many ended before
    pieces, _ = written(pieces)
    order = Window.partitionBy("path").orderBy("first")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.size("ends") > 0, F.struct((F.element_at("ends", -1) + 1).alias("start"), F.element_at("leads", -1).alias("lead")))
    # one thin row a piece passes through the window: its last end and lead, its number of ends, its head
    thin = pieces.select("path", "first", last.alias("last"), F.size("ends").alias("n"), "head")
    thin = thin.withColumns({"open": F.last("last", True).over(before), "docs": F.coalesce(F.sum("n").over(before), F.lit(0)), "head": F.first("head", True).over(order), "next": F.lead("first").over(order)})
    pieces = pieces.drop("head").join(thin.select("path", "first", "open", "docs", "head", "next"), ["path", "first"])
    opened = F.coalesce("open", F.struct(F.lit(0).cast("long").alias("start"), F.col("head").alias("lead")))
    stop = F.col("first") + F.col("size")
    tail = F.col("next").isNull() & (stop > F.when(F.size("ends") > 0, F.element_at("ends", -1) + 1).otherwise(opened["start"]))
    ends = F.when(tail, F.concat("ends", F.array(stop))).otherwise(F.col("ends"))
    found = pieces.select("path", "docs", opened.alias("open"), "ends", "leads", ends.alias("all")).select("path", "docs", "open", "ends", "leads", F.posexplode("all").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("open.start")).otherwise(F.get("ends", F.col("i") - 1) + 1)
    lead_of = F.when(F.col("i") == 0, F.col("open.lead")).otherwise(F.get("leads", F.col("i") - 1))
    n = F.col("end") - start
    return found.select("path", (F.col("docs") + F.col("i")).alias("doc_index"), start.alias("start"), n.alias("n_tokens"), F.slice(lead_of, 1, F.least(n, F.lit(lead)).cast("int")).alias("lead"))


def scan(files: DataFrame, end: int = END, lead: int = LEAD, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """From (path, content): (path, doc_index, start, n_tokens, lead) of every document."""
    return stitched(files.select("path", "content").mapInArrow(_cut(end, lead, 2 * block_tokens), _FOUND), lead)


def scan_files(spark: SparkSession, path: str, end: int = END, lead: int = LEAD, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """scan() over the files in a folder, a task's work being pieces, not files."""
    files = spark.read.format("binaryFile").load(path)
    if not known_to_arrow(path):
        return scan(files, end, lead, block_tokens)
    step = 2 * block_tokens
    # only paths and lengths are read here
    cut = files.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long"))).alias("at"))
    cut = cut.select("path", "at", F.least(F.lit(step).cast("long"), F.col("length") - F.col("at")).alias("size"))
    return stitched(cut.repartition("path", "at").mapInArrow(_ranges(end, lead), _FOUND), lead)


def tokens_of_id(doc_id: Column) -> Column:
    """A 64-bit number, or null, as LEAD tokens."""
    plain = F.when(doc_id < 0, -(doc_id + 1)).otherwise(doc_id).cast("long")
    sign = F.when(doc_id.isNull(), 0).when(doc_id < 0, 2).otherwise(1)
    digits, rest = [], F.coalesce(plain, F.lit(0).cast("long"))
    for _ in range(DIGITS):
        digits.append((rest % IDS).cast("int"))
        rest = F.call_function("div", rest, F.lit(IDS))
    return F.array(sign, *digits)


def id_of_tokens(lead: Column) -> Column:
    """The inverse of tokens_of_id."""
    plain = F.aggregate(F.reverse(F.slice(lead, 2, DIGITS)), F.lit(0).cast("long"), lambda acc, d: acc * IDS + d)
    sign = F.get(lead, F.lit(0))
    return F.when(sign == 1, plain).when(sign == 2, -plain - 1)


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as flat token files (the tokens of doc_id, then one hashed id a word), counted again by the scan."""
    docs = table(spark, sf_dir, "documents")
    words = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)), lambda w: F.pmod(F.hash(w), F.lit(IDS)))
    path = f"{shared_dir(spark)}/quarry-tokens-{uuid.uuid4().hex}"
    write_flat(docs.select(F.concat(tokens_of_id(F.col("doc_id").cast("long")), words).alias("t")), "t", path)
    found = scan_files(spark, path)
    return found.select(id_of_tokens(F.col("lead")).alias("doc_id"), (F.col("n_tokens") - LEAD).alias("n_tokens"))


SQL = r"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents"
