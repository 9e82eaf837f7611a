"""Variants of a search query: forms of code for what it asks to do, and paraphrases that a model gave."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import pascalize

# --- fixed values ---
VERBS = ("create", "add", "update", "delete", "save", "fetch", "get", "list", "submit")
ARTICLES = ("a", "an", "the")
PREPOSITIONS = ("in", "for", "on", "with", "via", "using", "to", "from")
MAX_VARIANTS = 3
# --- end of fixed values ---

_SPACE = r"(?U)^\s+|\s+$"


def _stripped(s: Column) -> Column:
    return F.regexp_replace(s, _SPACE, "")


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def object_of(query: Column, verb: str) -> Column:
    """What follows a verb in a lower-case query: without its article, up to a preposition or the end of the text."""
    article = f"(?:{'|'.join(ARTICLES)})"
    found = F.regexp_extract(query, rf"(?dU)\b{verb}\b(?:\s+{article})?\s+(.+?)(?:\s+(?:{'|'.join(PREPOSITIONS)})\b|$)", 1)
    return _stripped(F.regexp_replace(_stripped(found), rf"(?U)^{article}\s+", ""))


def code_forms(query: Column) -> Column:
    """array: two forms of the first listed verb that has an object with a name, none without one."""
    none = F.array().cast("array<string>")

    def of(lower: Column) -> Column:
        tries = F.array(*[F.struct(F.lit(v).alias("verb"), object_of(lower, v).alias("object")) for v in VERBS])
        named = F.filter(F.transform(tries, lambda x: F.struct(x["verb"].alias("verb"), x["object"].alias("object"), pascalize(x["object"]).alias("name"))), lambda x: x["name"] != "")
        forms = lambda x: F.array(F.concat(F.lit("use"), F.initcap(x["verb"]), x["name"], F.lit(" hook")), F.concat(x["verb"], F.lit(" "), x["object"], F.lit(" endpoint")))
        return F.coalesce(F.get(F.transform(named, forms), F.lit(0)), none)

    return _let(F.lower(query), of)


def variants(query: Column, paraphrases: Column | None = None, most: int = MAX_VARIANTS) -> Column:
    """array: the query, its code forms, then the model's paraphrases; distinct, ``most`` beside the query.

    paraphrases is an array column; where it is null or empty (no model, or it failed) the query and its code forms stand alone,
    uncut.  A blank query comes back as it is, a null one as an empty text.
    """
    query = F.coalesce(query, F.lit(""))
    original = _stripped(query)
    forms = F.concat(F.array(original), code_forms(original))
    if paraphrases is None:
        full = forms
    else:
        said = F.filter(F.transform(paraphrases, lambda p: _stripped(F.coalesce(p, F.lit("")))), lambda p: p != "")
        cut = F.slice(F.array_distinct(F.concat(forms, said)), 1, max(1, most) + 1)
        full = F.when(F.coalesce(F.size(paraphrases), F.lit(0)) > 0, cut).otherwise(forms)
    return F.when(original == "", F.array(query)).otherwise(full)
