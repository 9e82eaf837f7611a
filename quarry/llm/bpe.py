"""Byte-level BPE encoding and decoding.

Method: the rank file becomes a literal map from pairs of ids to the id, which is the rank, of their union (sparse rows
laid over each other in one array, as Spark looks maps up one entry after the other).  The map is the one row of a local
relation, taken as a scalar subquery: it is evaluated once a query, and plans and their texts only name it.  A word's bytes become an array of
ids, and ``aggregate`` folds the ranked merges over it: each step joins the adjacent pair of lowest rank and looks up only
the two pairs that this changes.  Distinct words are folded:
the words that are frequent in the whole corpus once each, the others once per document.  The frequent ones (at most
``hot`` words of at most HOT_BYTES bytes, so a broadcast of at most hot * HOT_BYTES bytes plus ids) are then only looked
up.  Nothing but word counts is shuffled.  Decoding takes the binary piece of each id and concatenates the pieces.

Defined results: a null text encodes as an empty one (no ids, empty bytes); a text of any length is encoded whole; repeated
rows are encoded each; an empty table gives an empty table; output columns replace columns of the same name.  Ids are as
the public byte-pair libraries give them without special tokens, given that a rank file holds all 256 single bytes.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Own, let, removed, table, written

HOT_WORDS = 1 << 20
HOT_BYTES = 64
#: Bytes above which a word is folded in parts.
LONG = 256
#: Rows an Arrow batch holds (the JVM keeps batches outside its heap), rows or bytes a Python worker looks up, and rows it assembles at a time.
ARROW_ROWS, LOOK_UP, LOOK_UP_BYTES, ASSEMBLE = 250, 4000, 1 << 25, 250
LEVELS = 1024
_NEVER = 1 << 30
_LOW = (1 << 32) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(4)
def _public() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _folded(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The pieces that ranked merges leave of one word."""
    p = [word[i : i + 1] for i in range(len(word))]
    while len(p) > 1:
        rank, at = min((ranks.get(p[i] + p[i + 1], _NEVER), i) for i in range(len(p) - 1))
        if rank == _NEVER:
            break
        p[at : at + 2] = [p[at] + p[at + 1]]
    return p


def pair_table(ranks: dict[bytes, int]) -> tuple[list[int], list[int], list[int]]:
    """Pairs of ids to the id of their union, by row displacement: (base, owner, union).

    The pair (a, b) has slot base[a] + b, and is there if owner[slot] is a.  Rows are placed first fit, largest first.
    """
    import numpy as np

    rows: dict[int, dict[int, int]] = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                rows.setdefault(a, {})[b] = rank
    most = max(ranks.values()) + 1
    used = np.zeros(4 * most + 4 * sum(map(len, rows.values())), bool)
    base, owner, union = np.zeros(most, np.int64), np.full(len(used), -1, np.int64), np.zeros(len(used), np.int64)
    low = 0
    for a, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        cols = np.array(sorted(row))
        while used[low]:
            low += 1
        start, width, fits = low, 16, []
        while not len(fits):
            fits = start + np.flatnonzero(~used[start : start + width])
            for at in range(1, len(cols), 16):  # few starts outlive the first columns
                if not len(fits):
                    break
                fits = fits[~used[fits[:, None] + (cols[at : at + 16] - cols[0])].any(axis=1)]
            start, width = start + width, min(4 * width, 1 << 14)
        base[a] = fits[0] - cols[0]  # may be below zero; no slot is
        slots = base[a] + cols
        used[slots], owner[slots], union[slots] = True, a, [row[c] for c in cols.tolist()]
    end = int(np.flatnonzero(used)[-1]) + 1 if rows else 0
    return base.tolist(), owner[:end].tolist(), union[:end].tolist()


@lru_cache(4)
def _literal(path: str) -> tuple[dict[str, list[int]], dict[str, int]]:
    ranks = read_ranks(path)
    base, owner, union = pair_table(ranks)
    return {"base": base, "owner": owner, "union": union, "byte": [ranks[bytes([i])] for i in range(256)]}, unreached(ranks)


def rank_map(spark: SparkSession, path: str) -> tuple[Column, dict[str, int]]:
    """The ranks as a literal: base, owner and union of pair_table, and byte, the ids of the 256 bytes; and what is unreached.

    A union's id is its rank, so the least id among the unions of adjacent pairs is the merge to make next.
    """
    found, whole = _literal(path)
    arrays = pa.table({k: pa.array([v], pa.list_(pa.int32())) for k, v in found.items()})
    row = spark.createDataFrame(arrays).select(F.create_map(*[c for k in found for c in (F.lit(k), F.col(k))]).alias("ranks"))
    return row.scalar(), whole


def unreached(ranks: dict[bytes, int]) -> dict[str, int]:
    """Tokens, as hex, that the merges of their own bytes don't give: whole words of these are looked up."""
    return {t.hex().upper(): r for t, r in ranks.items() if len(t) > 1 and len(_folded(t, ranks)) > 1}


def words_of(text: Column, pattern: str) -> Column:
    """Each match of pattern, with Unicode classes."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + pattern), F.lit(0))


def merged(word: Column, ranks: Column, whole: dict[str, int], long: int = LONG) -> Column:
    """The ids of one word: the fold of ranked merges over its bytes, but for words in ``whole``.

    The folded array holds one long a piece: its id below, above it the id of its union with the next piece (_NEVER: none).
    The step's position comes from the minimum itself, as array_position leaves its loop by an exception, which is slow.
    A word of more than ``long`` bytes is folded in parts of about the square root of its length, each with its least union,
    so that a step looks at the parts' least unions and changes one part: time grows with the power 1.5 of the length.
    """
    above = lambda x: F.shiftright(x, 32)
    below = lambda x: x.bitwiseAND(F.lit(_LOW))

    def folded(base: Column, owner: Column, unions: Column, byte: Column) -> Column:
        def packed(a: Column, b: Column) -> Column:
            slot = F.get(base, a) + b
            union = F.when(F.get(owner, slot) == a, F.get(unions, slot))
            return F.shiftleft(F.coalesce(union, F.lit(_NEVER)).cast("long"), 32) + a

        def joined(acc: Column, at: Column, new: Column) -> Column:
            mine = packed(new, below(F.get(acc, at + 2)))
            return F.concat(
                F.slice(acc, 1, F.greatest(at - 1, F.lit(0))),
                F.when(at > 0, F.array(packed(below(F.get(acc, at - 1)), new), mine)).otherwise(F.array(mine)),
                F.slice(acc, at + 3, F.size(acc)),
            )

        # the least union, and below it its place
        least = lambda acc: F.array_min(F.transform(acc, lambda x, i: x.bitwiseAND(F.lit(~_LOW)) + i))

        def step(acc: Column, _: Column) -> Column:
            return let(least(acc), lambda low: F.when(above(low) == _NEVER, acc).otherwise(joined(acc, below(low).cast("int"), above(low))))

        part_of = lambda p: F.struct(least(p).alias("low"), p.alias("p"))
        cut = lambda p, width: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / width).cast("int")), lambda k: part_of(F.slice(p, k * width + 1, width)))

        def step_in_parts(acc: Column, width: Column) -> Column:
            def at_part(low: Column) -> Column:
                nr, new = below(low).cast("int"), above(low)
                p, at = F.get(acc, nr)["p"], below(F.get(acc, nr)["low"]).cast("int")
                # at an edge the merge takes in a piece of a neighbour, so the parts around are laid together and cut again
                first = F.greatest(nr - 1, F.lit(0))
                around = F.flatten(F.transform(F.slice(acc, first + 1, 4), lambda x: x["p"]))
                shift = F.when(nr > 0, F.size(F.get(acc, first)["p"])).otherwise(0)
                inner = F.concat(F.slice(acc, 1, nr), F.array(part_of(joined(p, at, new))), F.slice(acc, nr + 2, F.size(acc)))
                outer = F.concat(F.slice(acc, 1, first), let(around, lambda q: let(joined(q, at + shift, new), lambda q: cut(q, width))), F.slice(acc, first + 5, F.size(acc)))
                return F.when((at > 0) & (at + 2 < F.size(p)), inner).otherwise(outer)

            low = F.array_min(F.transform(acc, lambda x, i: x["low"].bitwiseAND(F.lit(~_LOW)) + i))
            return let(low, lambda low: F.when(above(low) == _NEVER, acc).otherwise(at_part(low)))

        def in_parts(p: Column) -> Column:
            done = lambda width: F.aggregate(F.slice(p, 2, F.size(p)), cut(p, width), lambda acc, _: step_in_parts(acc, width), lambda acc: F.flatten(F.transform(acc, lambda x: x["p"])))
            return let(F.sqrt(F.size(p)).cast("int"), done)

        def split(b: Column) -> Column:
            # each byte as the character of the same number
            ids = F.transform(F.split(F.decode(b, "ISO-8859-1"), ""), lambda c: F.get(byte, F.ascii(c)))
            start = lambda p: F.transform(p, lambda x, i: packed(x, F.get(p, i + 1)))
            whole_array = lambda p: F.aggregate(F.slice(p, 2, F.size(p)), p, step)
            merges = let(ids, lambda ids: let(start(ids), lambda p: F.when(F.size(p) > long, in_parts(p)).otherwise(whole_array(p))))
            return F.transform(merges, lambda x: below(x).cast("int"))

        b = F.encode(word, "UTF-8")
        if not whole:
            return split(b)
        known = F.element_at(F.from_json(F.lit(json.dumps(whole)), "map<string,int>"), F.hex(b))
        return let(known, lambda k: F.when(k.isNotNull(), F.array(k)).otherwise(split(b)))

    part = lambda m, k: F.element_at(m, F.lit(k))
    return let(ranks, lambda m: let(part(m, "base"), lambda base: let(part(m, "owner"), lambda owner: let(part(m, "union"), lambda unions: let(part(m, "byte"), lambda byte: folded(base, owner, unions, byte))))))


def word_counts(docs: DataFrame, text: str, pattern: str) -> DataFrame:
    """(word, n) over all documents."""
    return docs.select(F.explode(words_of(F.col(text), pattern)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def hot_words(docs: DataFrame, text: str, pattern: str, ranks: Column, whole: dict[str, int], hot: int) -> pa.Table:
    """(word, ids) of the most frequent words: all those at or above the least count (in steps of its power of two / LEVELS) that at most ``hot`` words reach."""
    spark = docs.sparkSession
    counts, path = written(word_counts(docs, text, pattern).where((F.col("n") > 1) & (F.octet_length("word") <= HOT_BYTES)))
    # the least count that at most `hot` words reach: by powers of two, then in one level of the power that it lies in
    kept, least = 0, None
    power = lambda c: F.length(F.bin(c))
    for p, words in sorted(counts.groupBy(power("n")).agg(F.count("*")).collect(), reverse=True):  # at most 63 rows
        if kept + words <= hot:
            kept, least = kept + words, 1 << (p - 1)
            continue
        low, step = 1 << (p - 1), max(1, (1 << (p - 1)) // LEVELS)
        inside = counts.where(power("n") == p).groupBy(F.floor((F.col("n") - low) / step).alias("level")).agg(F.count("*"))
        for level, words in sorted(inside.collect(), reverse=True):  # at most LEVELS rows
            if kept + words > hot:
                break
            kept, least = kept + words, low + level * step
        break
    chosen = counts.where(F.col("n") >= least) if least is not None else counts.limit(0)
    parts = max(1, min(kept // 5000, 4 * spark.sparkContext.defaultParallelism))
    found = chosen.repartition(parts, "word").select("word", ranks.alias("__ranks")).select("word", merged(F.col("word"), F.col("__ranks"), whole).alias("ids")).toArrow()
    removed(spark, path)
    return found


def _sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined up to LOOK_UP rows, as each look-up builds its table of frequent words; joined parts are let go."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        del b
        if sum(map(len, held)) >= LOOK_UP or sum(x.nbytes for x in held) >= LOOK_UP_BYTES:
            joined, held = pa.Table.from_batches(held).combine_chunks().to_batches(), []
            while joined:
                yield joined.pop(0)
    if held:
        joined, held = pa.Table.from_batches(held).combine_chunks().to_batches(), []
        while joined:
            yield joined.pop(0)


def _ipc(t: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, t.schema) as w:
        w.write_table(t)
    return out.getvalue().to_pybytes()


def _known(words, keep: list[str]):
    """Splits each document's words into places in the table of frequent words and the document's other words."""
    cache: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc

        pa.set_memory_pool(pa.system_memory_pool())  # hands freed blocks back, unlike the pooling default
        if "words" not in cache:
            got = pa.ipc.open_stream(words.value).read_all().column("word").combine_chunks()
            cache["words"] = got if isinstance(got, pa.Array) else got.combine_chunks()
        for b in _gathered(batches):
            col = b.column(b.schema.get_field_index("__words"))
            offsets = col.offsets.to_numpy()
            flat = col.values.slice(offsets[0], offsets[-1] - offsets[0])
            offsets = offsets - offsets[0]
            at = pc.index_in(flat, value_set=cache["words"]).fill_null(-1).to_numpy()
            miss = np.flatnonzero(at < 0)
            doc = np.searchsorted(offsets, miss, side="right") - 1
            tails: list[list[str]] = [[] for _ in range(len(b))]
            if len(miss):
                at = at.copy()
                place: dict[str, int] = {}
                last = -1
                for i, d, w in zip(miss.tolist(), doc.tolist(), flat.take(pa.array(miss)).to_pylist()):
                    if d != last:
                        place, last = {}, d
                    k = place.setdefault(w, len(place))
                    if k == len(tails[d]):
                        tails[d].append(w)
                    at[i] = -1 - k
            done = pa.RecordBatch.from_arrays(
                [*(b.column(b.schema.get_field_index(k)) for k in keep), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(at, pa.int32())), pa.array(tails, pa.list_(pa.string()))],
                names=[*keep, "__at", "__tail"],
            )
            del b, col, flat, at, miss, doc, tails, offsets
            yield from _sliced(iter([done]), ARROW_ROWS)
            del done
            pa.default_memory_pool().release_unused()

    return run


def _assembled(words, pieces, keep: list[str], digests: bool):
    """Puts ids together in the order of the words, and decodes them by concatenating pieces."""
    cache: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        pa.set_memory_pool(pa.system_memory_pool())
        if not cache:
            cache["ids"] = pa.ipc.open_stream(words.value).read_all().column("ids").combine_chunks().cast(pa.list_(pa.int32()))
            cache["pieces"] = pa.array(pieces.value, pa.binary())
        table_ids = cache["ids"]
        for b in _sliced(batches, ASSEMBLE):
            at = b.column(b.schema.get_field_index("__at"))
            rows = at.offsets.to_numpy()
            place = at.values.to_numpy()[rows[0] : rows[-1]].astype(np.int64)
            rows = rows - rows[0]
            enc = b.column(b.schema.get_field_index("__enc"))
            tail = enc.flatten().cast(pa.list_(pa.int32()))
            first = np.concatenate([[0], np.cumsum(enc.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])[:-1]
            doc = np.repeat(np.arange(len(b)), np.diff(rows))
            place = np.where(place >= 0, place, len(table_ids) + first[doc] - 1 - place) if len(place) else place
            taken = pa.concat_arrays([table_ids, tail]).take(pa.array(place))
            starts = taken.offsets.to_numpy()
            ids = taken.values.slice(starts[0], starts[-1] - starts[0]) if len(taken) else pa.array([], pa.int32())
            ends = (starts - starts[0])[rows] if len(taken) else np.zeros(len(b) + 1, np.int64)
            raw = cache["pieces"].take(ids)
            cuts = np.frombuffer(raw.buffers()[1], np.int32)[: len(raw) + 1] if len(raw) else np.zeros(1, np.int32)
            data = memoryview(raw.buffers()[2]) if len(raw) and raw.buffers()[2] else memoryview(b"")
            texts = [data[cuts[x] : cuts[y]] for x, y in zip(ends[:-1], ends[1:])]
            head = [b.column(b.schema.get_field_index(k)) for k in keep]
            if digests:
                le = ids.to_numpy().astype("<u4") if len(ids) else np.zeros(0, "<u4")
                out = [
                    pa.array(np.diff(ends), pa.int64()),
                    pa.array([hashlib.sha256(le[x:y]).hexdigest() for x, y in zip(ends[:-1], ends[1:])], pa.string()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                ]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                out = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids), pa.array([bytes(t) for t in texts], pa.binary())]
                names = ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays([*head, *out], names=[*keep, *names])

    return run


def encode_decode(docs: DataFrame, text: str = "text", keep: list[str] | None = None, ranks_path: str | None = None, pattern: str | None = None, hot: int = HOT_WORDS, digests: bool = False) -> DataFrame:
    """docs' columns (or those in keep) with ids array<int> and decoded binary, decoded from the ids; with digests instead n_tokens, ids_sha256 and decoded_sha256."""
    spark = docs.sparkSession
    own_path, own_pattern = _public()
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, ARROW_ROWS + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)  # stays set: the result is lazy
    ranks, pattern = read_ranks(ranks_path or own_path), pattern or own_pattern
    literal, whole = rank_map(spark, ranks_path or own_path)
    found = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
    own = Own(docs, keep, found)
    keep = own.columns
    found_hot = hot_words(own.rows, own.name(text), pattern, literal, whole, hot)
    words, word_ids = (spark.sparkContext.broadcast(_ipc(found_hot.select([c]))) for c in ("word", "ids"))
    del found_hot
    by_id = {v: k for k, v in ranks.items()}
    pieces = spark.sparkContext.broadcast([by_id.get(i, b"") for i in range(max(by_id) + 1)])
    kinds = own.rows.select(*keep).schema.fields
    ints, longs = T.ArrayType(T.IntegerType()), T.LongType()
    places = T.StructType([*kinds, T.StructField("__at", ints), T.StructField("__tail", T.ArrayType(T.StringType()))])
    split = own.rows.select(*keep, words_of(own.at(text), pattern).alias("__words")).mapInArrow(_known(words, keep), places)
    # the planner merges both projections, so that the map is never a column of a row (a subquery can't be written inside a higher-order function)
    ranked = split.select("*", literal.alias("__ranks"))
    folded = ranked.select(*keep, "__at", let(F.col("__ranks"), lambda m: F.transform("__tail", lambda w: merged(w, m, whole))).alias("__enc"))
    last = dict(zip(found, (longs, T.StringType(), T.StringType()) if digests else (ints, T.BinaryType())))
    done = folded.mapInArrow(_assembled(word_ids, pieces, keep, digests), T.StructType([*kinds, *[T.StructField(c, t) for c, t in last.items()]]))
    return own.restored(done, *found)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents encoded and decoded again."""
    return encode_decode(table(spark, sf_dir, "documents"), keep=["doc_id"], digests=True)
