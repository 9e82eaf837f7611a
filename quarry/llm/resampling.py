r"""Importance resampling towards a target distribution, over a document-by-bucket count matrix.

Method: the words of a whole text give features, all runs of 1 to ``max_words`` consecutive words, and each feature's
CRC-32 names one of ``buckets`` columns.  Documents become CSR blocks (ids, row pointers, column numbers, counts), a
sparse matrix that is persisted once as Parquet in the shared folder; a row holds at most ``buckets`` entries, however long
its text.  Numbers and counts are packed into bytes and row groups are small, so that reading a block again takes no more
memory for a task that wrote many of them.  Column sums of the documents' and of the target's matrix give the two distributions and with them a gain per
column; the product of the matrix with the vector of gains gives each document's weight.  Weights plus Gumbel noise from a
digest of the id are drawn without replacement, highest first.

Tasks hash words as arrays: all words of about CHUNK bytes of text advance one byte a step, and a run's CRC goes on from
that of the run one word shorter.  Longer texts are taken in pieces that overlap by max_words - 1 words.  Only column sums
(at most ``buckets`` rows a task), and thin rows of id and score for the ranking, are shuffled.  Ranks come from a range
sort: a row's place in its partition plus the sizes of the partitions before, so no task holds more than its range; rows
alike in score and id are told apart by where they stood.

Defined results: A-Z are lower-cased, words are runs of 0-9, a-z and all that is not ASCII; a null or empty text has no
feature and weight 0; a null id has the noise of an empty one and stands last among ties; repeated rows are each weighed and
drawn (rows alike in id and score stand in any order); an empty table gives an empty table, an empty target counts nothing;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, lean, table, written

BUCKETS = 10_000
MAX_WORDS = 2
SEED = 7
PERCENT, MIN_WORDS = 25, 20
#: Bytes of text hashed at a time; entries (unless a single document has more) and documents of a block at most; steps before long words are finished one by one.
CHUNK, BLOCK_ENTRIES, BLOCK_ROWS, STEPS = 1 << 19, 1 << 13, 4096, 48
#: Blocks and bytes of a Parquet row group, at most about: what a task holds of it while it writes or reads.
GROUPS = {"parquet.block.row.count.limit": 128, "parquet.block.size": 1 << 23}


@lru_cache(1)
def _tables():
    """Lower case, word bytes, and the CRC-32 of each byte (reflected polynomial EDB88320)."""
    import numpy as np

    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    word = np.zeros(256, bool)
    word[48:58] = word[97:123] = word[128:] = True
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(0xEDB88320), crc >> 1)
    return lower, word, crc


def _advanced(state, data, starts, lens):
    """CRC states after the words of data at starts, one byte of all words a step."""
    import numpy as np

    crc = _tables()[2]
    order = np.argsort(-lens, kind="stable")
    s, at, n = state[order], starts[order], lens[order]
    left = np.searchsorted(-n, -np.arange(min(int(n[0]), STEPS)), side="left") if len(n) else []
    for k, m in enumerate(left):  # the first m words are longer than k
        s[:m] = crc[(s[:m] ^ data[at[:m] + k]) & 255] ^ (s[:m] >> 8)
    for i in range(int(np.searchsorted(-n, -STEPS, side="left"))):
        rest = data[at[i] + STEPS : at[i] + n[i]].tobytes()
        s[i] = zlib.crc32(rest, int(s[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(s)
    out[order] = s
    return out


def features(data, cuts, buckets: int = BUCKETS, max_words: int = MAX_WORDS, known: int = 0):
    """The texts data[cuts[i]:cuts[i + 1]]: (row of each feature, its bucket, words of each row, starts of all words).

    Features that end in the first ``known`` words are left out: a piece of a text repeats the last words of the one before.
    """
    import numpy as np

    lower, word, crc = _tables()
    data = lower[data]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = word[data]
    first = np.diff(inside) > 0
    last = np.diff(inside) < 0
    for c in (cuts[1:-1],):  # words do not run over the end of a text
        c = c[(c > 0) & (c < len(data))]
        both = c[(inside[c] & inside[c + 1]).astype(bool)]
        first[both] = last[both] = True
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    row = np.searchsorted(cuts, starts, side="right") - 1
    lens = ends - starts
    rows, found = [], []
    state = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    for g in range(max_words):
        if g:  # runs of g + 1 words: those of g words, a space and the next word
            state = state[:-1]
            state = crc[(state ^ np.uint32(32)) & 255] ^ (state >> 8)
        here = slice(g, None)
        state = _advanced(state, data, starts[here], lens[here])
        fits = row[here] == row[: len(state)]
        fits[: max(known - g, 0)] = False
        rows.append(row[here][fits]), found.append(((state[fits] ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)).astype(np.int64))
        if len(state) < 2:
            break
    return np.concatenate(rows), np.concatenate(found), np.bincount(row[known:], minlength=len(cuts) - 1), starts


def _long_row(data, buckets: int, max_words: int, piece: int):
    """Counts by bucket, features and words of one long text, piece by piece."""
    import numpy as np

    lower, word, _ = _tables()
    counts, words, n, at, end, known = np.zeros(buckets, np.int64), 0, 0, 0, 0, 0
    while end < len(data):
        end = min(end + piece, len(data))
        while end < len(data):  # up to the end of the word
            after = np.flatnonzero(~word[lower[data[end : end + 4096]]])
            end = end + int(after[0]) if len(after) else min(end + 4096, len(data))
            if len(after):
                break
        part = data[at:end]
        rows, found, w, starts = features(part, np.array([0, len(part)]), buckets, max_words, known)
        counts += np.bincount(found, minlength=buckets)
        words, n = words + int(w[0]), n + len(rows)
        known = min(max_words - 1, len(starts))
        at = at + int(starts[-known]) if known else end
    return counts, n, words


def _blocks(buckets: int, max_words: int, chunk: int):
    names = ["ids", "n_words", "n_features", "indptr", "columns", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        lean()

        def blocks(ids: pa.Array, words, n, entries, columns, counts) -> pa.RecordBatch:
            """The rows of one chunk as blocks; entries: of each row."""
            ends, cuts = np.concatenate([[0], np.cumsum(entries)]), [0]
            while cuts[-1] < len(ids):
                to = int(np.searchsorted(ends, ends[cuts[-1]] + BLOCK_ENTRIES, side="right")) - 1
                cuts.append(max(to, cuts[-1] + 1))
            spans = list(zip(cuts, cuts[1:]))
            whole = lambda values: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values)
            packed = lambda x: pa.array([(y := x[ends[i] : ends[j]]).astype(np.min_scalar_type(y.max(initial=0))).tobytes() for i, j in spans], pa.binary())
            pointers = pa.array([ends[i : j + 1] - ends[i] for i, j in spans], pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([whole(ids), whole(pa.array(words, pa.int64())), whole(pa.array(n, pa.int64())), pointers, packed(columns), packed(counts)], names=names)

        def taken(ids: pa.Array, data, cuts) -> pa.RecordBatch:
            if len(data) > chunk and len(cuts) == 2:
                counts, n, w = _long_row(data, buckets, max_words, chunk)
                columns = np.flatnonzero(counts)
                return blocks(ids, [w], [n], [len(columns)], columns, counts[columns])
            rows, found, words, _ = features(data, cuts, buckets, max_words)
            key, counts = np.unique(rows * buckets + found, return_counts=True)
            m = len(cuts) - 1
            return blocks(ids, words, np.bincount(rows, minlength=m), np.bincount(key // buckets, minlength=m), key % buckets, counts)

        for b in batches:
            texts = b.column(1).cast(pa.large_binary())
            texts = texts.fill_null(b"") if texts.null_count else texts
            cuts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            at = 0
            while at < len(b):
                to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + chunk, side="right")) - 1)
                to = min(to, len(b), at + BLOCK_ROWS)
                yield taken(b.column(0).slice(at, to - at), data[cuts[at] : cuts[to]], cuts[at : to + 1] - cuts[at])
                at = to

    return run


def unpacked(b: pa.RecordBatch, i: int):
    """Row pointers, column numbers and counts of block i; a number has as many bytes as the largest of its block needs."""
    import numpy as np

    ends = b.column("indptr")[i].values.to_numpy()
    n = int(ends[-1])
    return (ends, *(np.frombuffer(b.column(c)[i].as_buffer(), f"<u{b.column(c)[i].as_buffer().size // n}").astype(np.int64) if n else np.zeros(0, np.int64) for c in ("columns", "counts")))


def count_matrix(docs: DataFrame, text: str = "text", doc_id: str | None = "doc_id", buckets: int = BUCKETS, max_words: int = MAX_WORDS, chunk: int = CHUNK) -> DataFrame:
    """CSR blocks of docs: (ids, n_words, n_features, indptr, columns, counts), one row a block; columns and counts are packed (unpacked())."""
    key = F.col(f"`{doc_id}`") if doc_id else F.lit(None).cast("long")
    rows = docs.select(key.alias("id"), F.col(f"`{text}`").cast("binary").alias("text"))
    longs = T.ArrayType(T.LongType())
    kind = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(kind)), T.StructField("n_words", longs), T.StructField("n_features", longs), T.StructField("indptr", T.ArrayType(T.IntegerType())), *[T.StructField(c, T.BinaryType()) for c in ("columns", "counts")]])
    return rows.mapInArrow(_blocks(buckets, max_words, chunk), schema)


def _summed(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        lean()
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for i in range(len(b)):  # a block at a time
                np.add.at(total, *unpacked(b, i)[1:])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["column", "n"])

    return run


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(column, n): how often each column occurs in the matrix; at most ``buckets`` rows."""
    return blocks.select("indptr", "columns", "counts").mapInArrow(_summed(buckets), "column int, n long").groupBy("column").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS):
    """The gain of each column: floor(1000 ln(p / q)) of the smoothed shares of target and raw, from their column sums."""
    import numpy as np

    s, t = np.zeros(buckets), np.zeros(buckets)
    for sums, out in ((raw, s), (target, t)):
        for r in sums.collect():  # at most `buckets` rows
            out[r["column"]] = r["n"]
    return np.floor(1000.0 * np.log((t + 1.0) * (s.sum() + buckets) / ((s + 1.0) * (t.sum() + buckets)))).astype(np.int64)


def _weighed(gain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        lean()
        for b in batches:
            totals = [np.zeros(0, np.int64)]
            for i in range(len(b)):  # a block at a time
                ends, columns, counts = unpacked(b, i)
                totals.append(np.diff(np.concatenate([[0], np.cumsum(gain[columns] * counts)])[ends]))
            ids, words, n = (b.column(c).flatten() for c in ("ids", "n_words", "n_features"))
            yield pa.RecordBatch.from_arrays([ids, words, n, pa.array(np.concatenate(totals) // np.maximum(n.to_numpy(), 1), pa.int64())], names=["id", "n_words", "n_features", "weight"])

    return run


def weights(blocks: DataFrame, gain) -> DataFrame:
    """(id, n_words, n_features, weight): the matrix times the gains, floored means over a document's features."""
    kind = blocks.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("id", kind), *[T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]])
    return blocks.mapInArrow(_weighed(gain), schema)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of SHA-256 of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with rank 1, 2, ... in this order over all rows: place in a range-sorted partition plus the rows of those before."""
    placed, _ = written(rows.orderBy(*order).withColumn("__place", F.monotonically_increasing_id()))
    part = F.shiftright("__place", 33).alias("__part")
    sizes = placed.groupBy(part).agg(F.count("*").alias("__n"))  # one row a partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    rank = F.col("__before") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("__part", part).join(F.broadcast(sizes), "__part").withColumn("rank", rank).drop("__place", "__part", "__before")


def resample(
    docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT, min_words: int = MIN_WORDS,
    buckets: int = BUCKETS, max_words: int = MAX_WORDS, seed: int = SEED, chunk: int = CHUNK,
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every document; rank is null where a document is not drawn."""
    with arrow_batches(docs.sparkSession):
        blocks, _ = written(count_matrix(docs, text, doc_id, buckets, max_words, chunk), **GROUPS)
        wanted = count_matrix(target, target_text, None, buckets, max_words, chunk)
        gain = gains(column_sums(blocks, buckets), column_sums(wanted, buckets), buckets)
        scored, _ = written(weights(blocks, gain).withColumn("score", F.col("weight") + noise(F.col("id"), seed)).withColumn("at", F.monotonically_increasing_id()))
    fit = scored.where(F.col("n_words") >= min_words)
    drawn = percent * fit.count() // 100
    placed = ranked(fit, [F.desc("score"), F.col("id").asc_nulls_last(), F.asc("at")])
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return placed.unionByName(scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))).drop("at")


def resampled(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The drawn documents with all their columns; all rows of a drawn id, so repeats of an id come together."""
    ids = resample(docs, target, doc_id=doc_id, **options).where("rank is not null").select("id").distinct()
    key = F.col(f"`{doc_id}`")
    own = docs.columns
    return docs.select(key.alias("__drawn"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)]).alias("__row")).join(ids, F.expr("__drawn <=> id"), "left_semi").select(*[F.col("__row")[f"c{i}"].alias(c) for i, c in enumerate(own)])


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document weighed against the benchmark texts; a quarter of those of 20 words or more is drawn."""
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").cast("long").alias("doc_id"), "n_features", "weight", "score", "rank")


#: CRC-32 by a table of 256 entries (eight steps of the reflected polynomial), folded over the bytes of distinct features.
SQL = r"""
WITH t AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS crc
  FROM range(256) r(i)),
w AS (
  SELECT 0 AS side, row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
  UNION ALL
  SELECT 1, row_number() OVER (), NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (
  SELECT side, doc, unnest(list_concat(words, [words[CAST(i AS INT)] || ' ' || words[CAST(i + 1 AS INT)] FOR i IN range(1, greatest(len(words), 1))])) AS feature FROM w),
n AS (SELECT side, doc, feature, count(*) AS n FROM f GROUP BY ALL),
d AS (SELECT DISTINCT feature FROM n),
b AS (
  SELECT feature, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST('0x' || substr(hex(encode(feature)), CAST(2 * i + 1 AS INT), 2) AS BIGINT) FOR i IN range(octet_length(encode(feature)))]),
                           lambda c, x: xor(crc[xor(c % 256, x) + 1], c // 256)), 4294967295) % 10000 AS INT) AS bucket
  FROM d, t),
m AS (SELECT side, doc, bucket, n FROM n JOIN b USING (feature)),
s AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM m GROUP BY 1),
g AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * ((SELECT CAST(sum(s) AS DOUBLE) FROM s) + 10000) / ((CAST(s AS DOUBLE) + 1) * ((SELECT CAST(sum(t) AS DOUBLE) FROM s) + 10000)))) AS BIGINT) AS gain FROM s),
v AS (SELECT doc, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * gain) AS BIGINT) AS total FROM m JOIN g USING (bucket) WHERE side = 0 GROUP BY 1),
x AS (
  SELECT w.doc_id, len(w.words) AS n_words, coalesce(v.n, 0) AS n_features,
         CASE WHEN v.n IS NULL THEN 0 ELSE CAST((v.total - ((v.total % v.n) + v.n) % v.n) // v.n AS BIGINT) END AS weight,
         CAST('0x' || substr(sha256('7:' || coalesce(CAST(w.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM w LEFT JOIN v ON w.doc = v.doc WHERE w.side = 0),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS total FROM y)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CASE WHEN n_words >= 20 AND place <= 25 * total // 100 THEN CAST(place AS BIGINT) END AS rank
FROM r
"""
