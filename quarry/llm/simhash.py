"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Method: two fingerprints that differ in at most ``radius`` bits (even) share a fingerprint within radius / 2 of both.  So
every distinct fingerprint emits all variants within half the radius (65 for radius 2), the variants are shuffled, and
fingerprints that meet in a variant are linked to the smallest one there; pairs are made distinct and verified by their
exact distance.  All that meet in a variant are within the radius of each other, so these stars lose no link between
components.  At most as many fingerprints as a ball holds can meet in a variant, so no group grows with the data: exact
copies, however many, are one fingerprint before anything is emitted.  Components come from star contraction over links
between distinct fingerprints.

Defined results: words are split at ASCII white space after lower-casing A-Z; texts of fewer than ``shingle`` words hash the
whole sequence; null and empty texts have fingerprint zero and link like any other; repeated rows are each returned; rows
with a null doc_id are returned and linked but never name a component (null if a component has no other); an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, Own, components, let, table, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLOCK = 1 << 15


def shingle_hashes(text: Column, shingle: int = 3) -> Column:
    """XXH64 (seed 42) of every run of ``shingle`` words, repeats included."""

    def hashes(w: Column) -> Column:
        def run(i: Column) -> Column:
            parts = [F.get(w, i)]
            for k in range(1, shingle):
                parts += [F.lit(" "), F.get(w, i + k)]
            return F.xxhash64(F.concat(*parts))

        many = F.transform(F.sequence(F.lit(0), F.size(w) - shingle), run)
        return F.when(F.size(w) >= shingle, many).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))

    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return let(F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)), hashes)


def _majority(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits that are set in over half of each row's hashes, counted in blocks of _BLOCK hashes."""
    import numpy as np

    for b in batches:
        h = b.column(1)
        cuts = h.offsets.to_numpy().astype(np.int64)
        flat = h.values.to_numpy(zero_copy_only=False)[cuts[0] : cuts[-1]].astype("<i8").view(np.uint8).reshape(-1, 8)
        cuts = cuts - cuts[0]
        counts = np.zeros((len(b), 64), np.int64)
        filled = np.flatnonzero(np.diff(cuts))
        for at in range(0, len(flat), _BLOCK):
            end = min(at + _BLOCK, len(flat))
            bits = np.unpackbits(flat[at:end], axis=1, bitorder="little")
            lo = np.searchsorted(cuts[filled + 1], at, side="right")
            hi = np.searchsorted(cuts[filled], end, side="left")
            rows = filled[lo:hi]
            counts[rows] += np.add.reduceat(bits, np.maximum(cuts[rows] - at, 0), axis=0, dtype=np.int32)
        fp = np.packbits(2 * counts > np.diff(cuts)[:, None], axis=1, bitorder="little").reshape(-1).view("<i8")
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3) -> DataFrame:
    """(doc_id, fp long) of every row."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), shingle_hashes(F.col(f"`{text}`"), shingle).alias("h"))
    return rows.mapInArrow(_majority, T.StructType([rows.schema["doc_id"], T.StructField("fp", T.LongType())]))


def ball(radius: int) -> list[int]:
    """Masks of all 64-bit words of at most ``radius`` set bits, as signed longs."""
    masks = [sum(1 << i for i in bits) for k in range(radius + 1) for bits in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Distinct verified pairs (a, b) of fingerprints whose closure joins all fingerprints within the radius of each other."""
    if radius % 2 or radius < 0:
        raise ValueError("the radius must be even: half of it is searched from either side")
    masks = F.lit(ball(radius // 2))
    variants = distinct.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    met = variants.withColumn("least", F.min("fp").over(Window.partitionBy("variant"))).where("fp <> least")
    return met.select(F.col("least").alias("a"), F.col("fp").alias("b")).distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def rooted(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """distinct fingerprints (fp, ...) with the root of their component, a fingerprint."""
    roots = components(links(distinct, radius)).select(F.col("node").alias("fp"), "root")
    return distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; component_id is the smallest doc_id reachable over links."""
    fps, _ = written(fingerprints(docs, text, doc_id, shingle))
    found = rooted(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), radius)
    least = found.groupBy("root").agg(F.min("first").alias("component_id"))
    named = found.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def survivors(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row of each component, with all its columns: the one of the smallest doc_id, null last, then of the smallest SHA-256 of its text, then of the smallest JSON of all its columns.

    Copies of one row are brought down to one by a partial aggregate in every task, so no task sorts them all.
    """
    # rows of one text have one fingerprint, so doc_id and digest name a row up to its exact copies
    own = Own(docs)
    keyed = own.rows.withColumn("__key", F.struct(own.at(doc_id).alias("doc_id"), F.sha2(F.coalesce(own.at(text), F.lit("")), 256).alias("digest")))
    fps, _ = written(fingerprints(keyed, own.name(text), "__key", shingle).select("fp", F.struct(F.col("doc_id.doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("key")).alias("row")))
    found = rooted(fps.groupBy("fp").agg(F.min("row").alias("row")), radius)
    kept = found.groupBy("root").agg(F.min("row").alias("row")).select(F.col("row.key").alias("__key"))
    rest = [c for c in own.columns if c != own.name(text)]
    row = F.struct(*own.columns)
    one = keyed.join(kept, "__key", "left_semi").groupBy("__key").agg(F.min_by(row, F.to_json(F.struct(*rest))).alias("__row"))
    return own.restored(one.select("__row.*"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
