"""The symbol of a file that a name means: the same, else the same but for case, else the most alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

#: A name is alike above this ratio of matching characters, 2 M / T; the same as whole numbers: the unmatched ones are under 3 T / 20.
LEAST = 0.85


@pandas_udf(StringType())
def _lower(s):
    return s.str.lower()


@pandas_udf(DoubleType())
def _ratio(wanted, name):
    import difflib

    import pandas as pd

    return pd.Series([difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(wanted, name)])


def _unmatched(a: Column, b: Column) -> Column:
    """Most characters of two alike strings of these lengths that match nothing."""
    return F.floor((3 * (a + b) - 1) / 20).cast("int")


def _cut(s: str, at: Column, size: Column) -> Column:
    return F.struct(at.alias("at"), F.substring(s, at + 1, size).alias("piece"))


def candidates(wanted: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs (file, low, other) of wanted (file, low) and names (file, other), all in lower case, that may be alike; no alike pair is lost.

    What matches of two strings is a common subsequence, so alike ones are within as many edits as characters match nothing, d.
    As neither can be longer than 23/17 of the other, d is under 6/17 of a name's length: of so many pieces of a name one lies in
    the other string whole, shifted by d places at most.  Pieces have one to three characters, and only strings that share one meet.
    """
    n = F.col("size")
    pieces = F.ceil(n * 6 / 17).cast("int")
    edge = lambda i: F.floor(i * n / pieces).cast("int")
    own = names.withColumn("size", F.length("other")).where("size > 0")
    own = own.select("file", "other", "size", F.explode(F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: _cut("other", edge(i), edge(i + 1) - edge(i)))).alias("p")).select("file", "other", "size", F.col("p.at").alias("other_at"), "p.piece")
    asked = wanted.withColumn("long", F.length("low")).where("long > 0")
    # pieces of one character come from names of one or three, which only strings of up to four can be like
    cuts = F.flatten(F.transform(F.sequence(F.lit(0), F.col("long") - 1), lambda at: F.transform(F.filter(F.array(*[F.lit(k) for k in (1, 2, 3)]), lambda k: (at + k <= F.col("long")) & ((k > 1) | (F.col("long") <= 4))), lambda k: _cut("low", at, k))))
    asked = asked.select("file", "low", "long", F.explode(cuts).alias("p")).select("file", "low", "long", F.col("p.at").alias("low_at"), "p.piece")
    d = _unmatched(F.col("long"), F.col("size"))
    met = asked.join(own, ["file", "piece"]).where((F.abs(F.col("long") - F.col("size")) <= d) & (F.abs(F.col("low_at") - F.col("other_at")) <= d))
    return met.select("file", "low", "other", d.alias("d")).distinct().where((F.levenshtein("low", "other") <= F.col("d"))).drop("d")


def matched(wanted: DataFrame, names: DataFrame) -> DataFrame:
    """(file, wanted, symbol): of each distinct wanted (file, wanted) its symbol among names (file, name) of the file; the first, where several are as good.

    Each distinct name is compared once, and by its characters only where neither it nor its lower case is there.
    """
    names = names.where("name is not null").distinct().withColumn("other", _lower("name"))
    asked = wanted.where("wanted is not null").distinct().withColumn("low", _lower("wanted"))
    same = asked.join(names.select("file", F.col("name").alias("wanted"), F.lit(True).alias("__same")), ["file", "wanted"], "left")
    first = names.groupBy("file", F.col("other").alias("low")).agg(F.min("name").alias("__cased"))
    known = same.join(first, ["file", "low"], "left").withColumn("symbol", F.when(F.col("__same"), F.col("wanted")).otherwise(F.col("__cased")))
    rest = known.where("symbol is null").select("file", "low").distinct()
    pairs = candidates(rest, first.select("file", F.col("low").alias("other"))).withColumn("ratio", _ratio("low", "other")).where(F.col("ratio") > LEAST)
    likest = pairs.join(first.select("file", F.col("low").alias("other"), "__cased"), ["file", "other"]).groupBy("file", "low").agg(F.min_by("__cased", F.struct(-F.col("ratio"), "__cased")).alias("__likest"))
    return known.join(likest, ["file", "low"], "left").select("file", "wanted", F.coalesce("symbol", "__likest").alias("symbol"))
