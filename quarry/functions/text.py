"""Text normalisation and similarity as column expressions (no UDF)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# suffixes of the older name queries; the exact lists are those of canonical.py
CORPORATE_SUFFIXES = ("corporation", "corp", "inc", "incorporated", "llc", "ltd", "limited", "company", "co", "gmbh", "plc")
TIER_SUFFIXES = ("go", "pro", "lite", "plus", "enterprise", "premium", "basic", "standard", "express")

# --- fixed values ---
ACRONYMS = ("ai", "api", "soap", "prro", "http", "https", "sql", "url", "ui", "sdk", "cli", "rest", "json", "xml", "css", "html", "js", "ts", "db")
EXPANSION_STOP_WORDS = ("a", "an", "the", "and", "or", "to", "for", "of", "in", "on", "with", "via", "using", "by")
MIME_BY_SUFFIX = ((".py", "text/x-python"), (".js", "text/javascript"), (".ts", "text/typescript"), (".tsx", "text/typescript-jsx"), (".jsx", "text/javascript-jsx"), (".json", "application/json"), (".html", "text/html"), (".css", "text/css"), (".md", "text/markdown"), (".yaml", "text/yaml"), (".yml", "text/yaml"), (".xml", "text/xml"), (".sql", "text/x-sql"), (".sh", "text/x-shellscript"), (".rb", "text/x-ruby"), (".java", "text/x-java"), (".go", "text/x-go"), (".rs", "text/x-rust"), (".swift", "text/x-swift"), (".kt", "text/x-kotlin"), (".c", "text/x-c"), (".cpp", "text/x-c++"), (".h", "text/x-c-header"), (".vue", "text/x-vue"), (".svelte", "text/x-svelte"))
#: The first 14 are those of the graph context, which looks them up by the lower-case extension.
CONTEXT_MIME_BY_EXTENSION = tuple((suffix[1:], kind) for suffix, kind in MIME_BY_SUFFIX[:14])
#: Three maps that differ: of uploaded documents, of code extraction and of file events.
DOCUMENT_LANGUAGES = (("py", "python"), ("js", "javascript"), ("ts", "typescript"), ("java", "java"), ("go", "go"), ("rs", "rust"), ("rb", "ruby"), ("php", "php"), ("c", "c"), ("cpp", "cpp"), ("h", "c_header"), ("hpp", "cpp_header"), ("cs", "csharp"), ("swift", "swift"), ("kt", "kotlin"), ("scala", "scala"), ("r", "r"), ("m", "objective_c"))
CODE_LANGUAGES = (("py", "python"), ("rb", "ruby"), ("js", "javascript"), ("ts", "typescript"), ("java", "java"), ("go", "go"), ("rs", "rust"), ("cpp", "cpp"), ("c", "c"), ("cs", "csharp"), ("php", "php"), ("swift", "swift"))
EVENT_LANGUAGES = (("ts", "typescript"), ("tsx", "typescript"), ("mts", "typescript"), ("cts", "typescript"), ("js", "javascript"), ("jsx", "javascript"), ("mjs", "javascript"), ("cjs", "javascript"), ("py", "python"), ("pyw", "python"), ("pyi", "python"), ("rb", "ruby"), ("rake", "ruby"), ("java", "java"), ("kt", "kotlin"), ("kts", "kotlin"), ("swift", "swift"), ("go", "go"), ("rs", "rust"), ("cs", "csharp"), ("cpp", "cpp"), ("cc", "cpp"), ("cxx", "cpp"), ("c", "c"), ("h", "c"), ("hpp", "cpp"), ("php", "php"), ("scala", "scala"), ("dart", "dart"), ("lua", "lua"), ("r", "r"), ("m", "objectivec"), ("mm", "objectivec"), ("sh", "bash"), ("bash", "bash"), ("zsh", "bash"), ("ps1", "powershell"), ("sql", "sql"), ("html", "html"), ("htm", "html"), ("css", "css"), ("scss", "scss"), ("sass", "sass"), ("less", "less"), ("vue", "vue"), ("svelte", "svelte"), ("yml", "yaml"), ("yaml", "yaml"), ("json", "json"), ("xml", "xml"), ("toml", "toml"), ("ini", "ini"), ("cfg", "ini"), ("tf", "terraform"), ("hcl", "terraform"), ("proto", "protobuf"), ("graphql", "graphql"), ("gql", "graphql"), ("ex", "elixir"), ("exs", "elixir"), ("erl", "erlang"), ("hs", "haskell"), ("clj", "clojure"), ("cljs", "clojure"), ("pl", "perl"), ("groovy", "groovy"))
#: The extension of the last path part (none where it only leads with a dot), and whatever follows the last dot.
EXTENSION, AFTER_LAST_DOT = r"[^/]\.([^./]+)/*\z", r"\.([^.]*)\z"


def camel_split(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")


def squeeze(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def canonical_name(s: Column) -> Column:
    """Underscores to spaces, CamelCase split, one space between words, title case with acronyms in capitals."""
    words = F.split(squeeze(camel_split(F.replace(s, F.lit("_"), F.lit(" ")))), " ")
    return F.array_join(F.transform(words, lambda w: F.when(F.lower(w).isin(*ACRONYMS), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w)))))), " ")


def reject_key(s: Column) -> Column:
    return squeeze(F.lower(F.regexp_replace(s, "[_-]", " ")))


def domain_key(s: Column) -> Column:
    """Camel split, lower words, one suffix stripped where a stem of four stays, sorted, joined by underscores."""

    def stem(w: Column) -> Column:
        out = w
        for suffix in reversed(("tion", "ment", "ing", "s")):
            out = F.when(F.endswith(w, F.lit(suffix)) & (F.length(w) - len(suffix) >= 4), F.substring(w, F.lit(1), F.length(w) - len(suffix))).otherwise(out)
        return out

    words = F.regexp_extract_all(F.lower(camel_split(s)), F.lit("[a-z]+"), F.lit(0))
    return F.array_join(F.array_sort(F.transform(words, stem)), "_")


def organisation_name(s: Column) -> Column:
    plain = squeeze(F.regexp_replace(F.regexp_replace(F.lower(s), r"\([^)]*\)", " "), r"[^a-z0-9\s]", " "))
    return F.trim(F.regexp_replace(plain, rf"(\s+({'|'.join(CORPORATE_SUFFIXES)}))+$", ""))


def trailing_suffix(s: Column) -> Column:
    """The tier word or number that a name ends with, else empty."""
    return F.regexp_extract(F.lower(s), rf"\s({'|'.join(TIER_SUFFIXES)}|[0-9]+(?:/[0-9]+)?)$", 1)


def token_set(s: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(s), r"\s+"), lambda w: w != ""))


def has_all_terms(text: Column, query: Column) -> Column:
    """Whether a text holds every word of a query, without stemming."""
    words = lambda s: F.regexp_extract_all(F.lower(s), F.lit("[a-z0-9]+"), F.lit(0))
    return F.size(F.array_except(words(query), words(text))) == 0


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def lexical_score(text: Column, query: Column) -> Column:
    """jaccard(token_set(text), token_set(query)) with the words of the text taken apart once: what both share is what is left of the query's words."""
    own, asked = token_set(text), token_set(query)

    def score(w: Column) -> Column:
        shared = F.array(F.size(F.array_intersect(asked, w)))
        return F.element_at(F.transform(shared, lambda n: F.when(F.size(w) + F.size(asked) > n, n / (F.size(w) + F.size(asked) - n)).otherwise(F.lit(0.0))), F.lit(1))

    return F.when(text.isNotNull(), F.element_at(F.transform(F.array(own), score), F.lit(1)))


def description_overlap(a: Column, b: Column) -> Column:
    """Shared words over the smaller word set, without stop words and single letters."""
    from .canonical import overlap

    return overlap(a, b)


def pascalize(s: Column) -> Column:
    """Words but stop words, each with a capital, without anything between them."""
    words = F.filter(F.regexp_extract_all(s, F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda w: ~F.lower(w).isin(*EXPANSION_STOP_WORDS))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "")


def slugify(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(s)), r"[^a-z0-9_\s-]", ""), r"[\s_]+", "-"), "-+", "-"), "^-|-$", "")


def mime_type(path: Column, default: str = "text/plain") -> Column:
    """By suffix, upper and lower case apart: the first match in the order of the map."""
    out = F.lit(default)
    for suffix, kind in reversed(MIME_BY_SUFFIX):
        out = F.when(F.endswith(path, F.lit(suffix)), kind).otherwise(out)
    return out


def by_extension(path: Column, pairs: tuple, pattern: str = EXTENSION, default: str | None = "unknown") -> Column:
    found = F.element_at(F.create_map(*[F.lit(x) for pair in pairs for x in pair]), F.lower(F.regexp_extract(path, pattern, 1)))
    return F.coalesce(found, F.lit(default))


def by_extension_sql(path: str, pairs: tuple, pattern: str = EXTENSION, default: str | None = "unknown") -> str:
    """The same in SQL, from the same map."""
    whens = " ".join(f"WHEN '{ext}' THEN '{kind}'" for ext, kind in pairs)
    return f"CASE lower(regexp_extract({path}, '{pattern}', 1)) {whens} ELSE {'NULL' if default is None else repr(default)} END"


def document_language(path: Column) -> Column:
    return by_extension(path, DOCUMENT_LANGUAGES)


def code_language(path: Column) -> Column:
    return by_extension(path, CODE_LANGUAGES, AFTER_LAST_DOT)


def event_language(path: Column) -> Column:
    """Null where unknown."""
    return by_extension(path, EVENT_LANGUAGES, default=None)


def context_mime(path: Column) -> Column:
    return by_extension(path, CONTEXT_MIME_BY_EXTENSION, default="text/plain")


def language(path: Column) -> Column:
    """The first of the three maps that knows the extension, that of events first as the widest."""
    return F.coalesce(event_language(path), by_extension(path, DOCUMENT_LANGUAGES, default=None), code_language(path))


def sanitized(s: Column) -> Column:
    """Without NUL and other control characters but tab, line feed and carriage return."""
    return F.regexp_replace(s, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def stored_text(s: Column) -> Column:
    """sanitized, then in normal form C, for which there is no built-in function; Spark's strings hold no lone surrogates."""

    @F.pandas_udf("string")
    def composed(v: pd.Series) -> pd.Series:
        return v.str.normalize("NFC")

    return composed(sanitized(s))


def triplet_text(src: Column, rel: Column, dst: Column) -> Column:
    return F.concat_ws("-›", src, rel, dst)


def size_label(lines: Column) -> Column:
    return F.when(lines < 100, "S").when(lines < 500, "M").otherwise("L")


def scope_key(company: Column, scope: Column) -> Column:
    """The node set that a scope names: ``knowledge`` that of a company, ``code:project:name`` that of a project's code.

    Null (no filter) for any other scope, null and empty included, for ``knowledge`` without a company and for ``code:`` with
    an empty project or name; the name may hold colons.
    """
    project, name = (F.regexp_extract(scope, r"(?s)\Acode:([^:]*):(.*)\z", i) for i in (1, 2))
    known = F.when((scope == "knowledge") & (company != ""), F.concat(company, F.lit("_knowledge")))
    return known.when((project != "") & (name != ""), F.concat_ws("_", project, name, F.lit("code")))
