"""Kinds and metadata of code chunks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---
CONTENT_TYPES = (("ruby", "ruby_rails"), ("typescript", "typescript"), ("javascript", "typescript"), ("python", "python"), ("go", "go"), ("java", "java"))
PURPOSES = (
    (("validate", "check"), "validation logic"),
    (("format", "transform"), "data formatting"),
    (("handle",), "event/data handling"),
    (("fetch", "get", "load"), "data retrieval"),
    (("save", "update", "create"), "data persistence"),
    (("filter", "find", "search"), "data filtering/search"),
    (("calculate", "compute"), "computation logic"),
)
OTHER_PURPOSE = "helper logic"
KEYWORDS = (
    "appointment", "event", "user", "calendar", "schedule",
    "payment", "order", "customer", "product", "cart",
    "email", "notification", "message", "alert",
    "auth", "login", "session", "token", "permission",
    "database", "query", "transaction", "record",
    "api", "request", "response", "fetch", "http",
    "validation", "error", "exception", "retry",
)
ERROR_KINDS = ("try_catch", "try_except", "rescue_block")
PARENT_WEIGHT, NESTED_WEIGHT, MOST_KEYWORDS, FROM_CODE, FROM_NESTED = 0.8, 0.6, 10, 5, 3
# --- end of fixed values ---


def content_type(path: Column, language: Column) -> Column:
    """The kind of prompt a file takes: Ruby specs apart, else by language, else the language itself."""
    lang, p = F.lower(F.trim(F.coalesce(language, F.lit("")))), F.replace(path, F.lit("\\"), F.lit("/"))
    spec = F.endswith(p, F.lit("_spec.rb")) | F.endswith(p, F.lit("_test.rb")) | F.contains(p, F.lit("/spec/")) | F.startswith(p, F.lit("spec/"))
    out = F.when((lang == "ruby") & spec, "ruby_spec")
    for name, kind in CONTENT_TYPES:
        out = out.when(lang == name, kind)
    return out.otherwise(lang)


def purpose(name: Column) -> Column:
    low, out = F.lower(name), F.when(F.lit(False), "")
    for words, what in PURPOSES:
        out = out.when(low.rlike("|".join(words)), what)
    return out.otherwise(OTHER_PURPOSE)


def keywords(code: Column) -> Column:
    """The first FROM_CODE of KEYWORDS, in their order, that the code holds."""
    return F.slice(F.filter(F.array(*[F.lit(k) for k in KEYWORDS]), lambda k: F.contains(F.lower(F.coalesce(code, F.lit(""))), k)), 1, FROM_CODE)


def inherited_operation(parent: Column, kind: Column, name: Column) -> Column:
    """What a nested symbol does, from what its parent does."""
    own = purpose(name)
    return F.when(F.coalesce(parent, F.lit("")) == "", own).when(kind == "nested_function", F.concat(parent, F.lit(" - "), own)).when(kind.isin(*ERROR_KINDS), F.concat(parent, F.lit(" - error handling"))).otherwise(parent)


def inherited_keywords(parent: Column, code: Column) -> Column:
    """array<struct(keyword, probability)>: the parent's first, then those of the code, MOST_KEYWORDS in all."""
    weighed = lambda words, w: F.transform(words, lambda k: F.struct(k.alias("keyword"), F.lit(w).alias("probability")))
    return F.slice(F.concat(weighed(F.coalesce(parent, F.array().cast("array<string>")), PARENT_WEIGHT), weighed(F.slice(keywords(code), 1, FROM_NESTED), NESTED_WEIGHT)), 1, MOST_KEYWORDS)


def prompt(present: Column, given: Column, fallback: Column, values: dict[str, Column]) -> Column:
    """The prompt of a chunk: its own where the field is there and not empty, null (the chunk is rejected) where it is there and empty, else the fallback; {{NAME}} stands for a value."""
    out = F.when(present, F.nullif(given, F.lit(""))).otherwise(F.nullif(fallback, F.lit("")))
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), value)
    return out
