"""Stemmed full text: an inverted index that answers conjunctive queries without reading texts.

Words are stemmed by Porter's rules (1980), a fold of steps over the *distinct* words of a block.  The index holds for
each term and block of documents the sorted places of its documents, so no posting list grows with the table.  A query takes
the blocks of its rarest term, then asks for its other terms in these blocks only, and intersects the lists of a block from
the shortest on; all steps are equi-joins on (term, block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clusters import kept

#: Documents a block holds.
BLOCK = 4096
WORD = r"[a-z0-9]+"

# --- fixed values ---
STEP_2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
# --- end of fixed values ---


def _shape(w: Column) -> Column:
    """A word as c (consonant) and 1 (vowel): y is a vowel after a consonant."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(w, "(?<=[^aeiou])y", "i"), "[aeiou]", "1"), "[^1]", "c")


def measure(w: Column) -> Column:
    """Porter's m: how often a consonant run follows a vowel run."""
    return F.regexp_count(_shape(w), F.lit("1+c+"))


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once, so that steps do not multiply in the plan."""
    return F.element_at(F.transform(F.array(value), body), F.lit(1))


def _cut(w: Column, n: int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def _vowel(w: Column) -> Column:
    return F.contains(_shape(w), F.lit("1"))


def _double(w: Column) -> Column:
    return w.rlike(r"([^aeiou])\1$")


def _cvc(w: Column) -> Column:
    return _shape(w).rlike("c1c$") & ~w.rlike("[wxy]$")


def _longest(w: Column, rules, fits) -> Column:
    """Of (suffix, new) the longest suffix that the word ends in decides; it is replaced if its stem fits."""
    out = F.when(F.lit(False), w)
    for suffix, new in sorted(rules, key=lambda r: -len(r[0])):
        stem = _cut(w, len(suffix))
        out = out.when(F.endswith(w, F.lit(suffix)), F.when(fits(stem, suffix), F.concat(stem, F.lit(new))).otherwise(w))
    return out.otherwise(w)


def _repaired(w: Column) -> Column:
    """What is left of a word without ed or ing."""
    return F.when(w.rlike("(at|bl|iz)$"), F.concat(w, F.lit("e"))).when(_double(w) & ~w.rlike("[lsz]$"), _cut(w, 1)).when((measure(w) == 1) & _cvc(w), F.concat(w, F.lit("e"))).otherwise(w)


def stems(words: DataFrame, word: str = "word") -> DataFrame:
    """words with ``stem``; meant for distinct words, of a table or of a block.  Words of one or two letters, or with digits, stay."""
    def first(w: Column) -> Column:
        return F.when(w.rlike("(sses|ies)$"), _cut(w, 2)).when(w.rlike("ss$"), w).when(w.rlike("s$"), _cut(w, 1)).otherwise(w)

    def past(w: Column) -> Column:
        eed = F.when(measure(_cut(w, 3)) > 0, _cut(w, 1)).otherwise(w)
        return F.when(w.rlike("eed$"), eed).when(w.rlike("ed$") & _vowel(_cut(w, 2)), _let(_cut(w, 2), _repaired)).when(w.rlike("ing$") & _vowel(_cut(w, 3)), _let(_cut(w, 3), _repaired)).otherwise(w)

    def last_e(w: Column) -> Column:
        goes = _let(_cut(w, 1), lambda s: F.when((measure(s) > 1) | ((measure(s) == 1) & ~_cvc(s)), s))
        return F.when(w.rlike("e$"), F.coalesce(goes, w)).otherwise(w)

    steps = [
        first,
        past,
        lambda w: F.when(w.rlike("y$") & _vowel(_cut(w, 1)), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w),
        lambda w: _longest(w, STEP_2, lambda s, _: measure(s) > 0),
        lambda w: _longest(w, STEP_3, lambda s, _: measure(s) > 0),
        lambda w: _longest(w, [(s, "") for s in STEP_4], lambda s, suffix: (measure(s) > 1) & (s.rlike("[st]$") if suffix == "ion" else F.lit(True))),
        last_e,
        lambda w: F.when(w.rlike("ll$") & (measure(w) > 1), _cut(w, 1)).otherwise(w),
    ]
    stem = F.col(word)
    for step in steps:
        stem = _let(stem, step)
    return words.withColumn("stem", F.when(F.col(word).rlike("^[a-z]{3,}$"), stem).otherwise(F.col(word)))


def words_of(text: Column) -> Column:
    """Distinct words of a text, A-Z lower-cased; none for null."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)))


def terms_of(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term): the distinct stems of each row's text."""
    words = kept(rows.select(F.col(key).alias("key"), F.explode(words_of(F.col(text))).alias("word")))
    known = stems(words.select("word").distinct())
    return words.join(known, "word").select("key", F.col("stem").alias("term")).distinct()


class Index:
    """postings (term, block, docs: sorted places in the block), frequencies (term, df) and names (block, place, doc), written."""

    def __init__(self, postings: DataFrame, frequencies: DataFrame, names: DataFrame):
        self.postings, self.frequencies, self.names = postings, frequencies, names


def indexed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> Index:
    """The index of docs; rows are numbered where they lie, and rows without words are in no list.

    Texts are read once: the places of a word in a block are put together before they are shuffled, and a word is stemmed
    once a block, where its list lies.  The entry without a word holds the documents' ids.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc"), words_of(F.col(text)).alias("words"))
    # partitions hold rows side by side, so a block is a run of rows of one partition
    place = (F.col("row") % block).cast("int").alias("place")
    each = rows.select(F.expr(f"row div {block}").alias("block"), place, "doc", F.explode(F.concat(F.array(F.lit("")), "words")).alias("word"))
    named = F.when(F.col("word") == "", F.struct("place", "doc"))
    lists = kept(each.groupBy("word", "block").agg(F.collect_list("place").alias("places"), F.collect_list(named).alias("named")))
    known = stems(lists.where("word <> ''"))
    one = F.array_sort(F.array_distinct(F.flatten(F.collect_list("places"))))
    postings = kept(known.groupBy(F.col("stem").alias("term"), "block").agg(one.alias("docs")))
    frequencies = kept(postings.groupBy("term").agg(F.sum(F.size("docs")).alias("df")))
    names = lists.where("word = ''").select("block", F.inline("named"))
    return Index(postings, frequencies, names)


def all_terms(index: Index, queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """(query, doc) of the documents that hold every term of a query; queries without terms find nothing."""
    wanted = terms_of(queries, query_id, text).withColumnRenamed("key", "query")
    known = wanted.join(index.frequencies, "term", "left")
    by_query = Window.partitionBy("query")
    known = known.withColumns({"n": F.count("*").over(by_query), "found": F.count("df").over(by_query), "place": F.row_number().over(by_query.orderBy(F.col("df").asc_nulls_first(), "term"))})
    known = kept(known.where("n = found"))  # a term that no document holds leaves nothing
    first = known.where("place = 1").join(index.postings, "term").select("query", "n", "block", "docs")
    others = first.select("query", "block").join(known.where("place > 1").select("query", "term"), "query").join(index.postings, ["term", "block"]).select("query", "block", "docs")
    lists = first.select("query", "block", "docs", "n").unionByName(others.withColumn("n", F.lit(None).cast("long")))
    met = lists.groupBy("query", "block").agg(F.array_sort(F.collect_list(F.struct(F.size("docs").alias("size"), "docs"))).alias("lists"), F.max("n").alias("n")).where("size(lists) = n")
    both = F.aggregate(F.slice("lists", F.lit(2), F.size("lists")), F.get("lists", F.lit(0))["docs"], lambda acc, x: F.array_intersect(acc, x["docs"]))
    return met.select("query", "block", F.explode(both).alias("place")).join(index.names, ["block", "place"]).select("query", "doc")


def scanned(docs: DataFrame, queries: DataFrame, doc_id: str, query_id: str, text: str = "text") -> DataFrame:
    """The same by counting the terms that each pair shares: what the index is held against."""
    d, q = terms_of(docs, doc_id, text), terms_of(queries, query_id, text).withColumnRenamed("key", "query")
    q = q.withColumn("n", F.count("*").over(Window.partitionBy("query")))
    return d.join(q, "term").groupBy("query", "key").agg(F.count("*").alias("shared"), F.max("n").alias("n")).where("shared = n").select("query", F.col("key").alias("doc"))
