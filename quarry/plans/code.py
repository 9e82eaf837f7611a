"""Blocks and chunks of code; the pages' HTML and the documents' texts stand for files."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import blocks
from ..operators import codechunks
from .base import op

_INDENT = r"(length({0}) - length(regexp_replace({0}, '^\s+', '')))"


@op("TXT23_blocks", rf"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS x, CAST(1 + doc_id % 5 AS INT) AS pos FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, x, pos, len(x) AS n, unnest(x) AS line, unnest(range(1, len(x) + 1)) AS nr FROM d),
b AS (SELECT *, {_INDENT.format("x[pos]")} AS base FROM l),
s AS (
  SELECT doc_id, x, pos, n, coalesce(min(nr) FILTER (nr > pos AND regexp_replace(line, '^\s+|\s+$', '', 'g') <> '' AND {_INDENT.format("line")} <= base) - 1, n) AS deep,
    coalesce(min(nr) FILTER (nr >= pos AND NOT regexp_matches(regexp_replace(line, '\s+$', ''), '[\\,{{\[]$')), n) AS going FROM b GROUP BY 1, 2, 3, 4)
SELECT doc_id, CASE WHEN pos <= n THEN array_to_string(x[pos:deep], chr(10)) ELSE '' END AS by_indent, CASE WHEN pos <= n THEN array_to_string(x[pos:going], chr(10)) ELSE '' END AS variable,
  CASE WHEN pos + 2 <= n THEN array_to_string(x[pos:pos + 2], chr(10)) ELSE '' END AS by_lines FROM s""")
def _(t):
    at = (1 + F.col("doc_id") % 5).cast("int")
    return t.documents.where("text is not null").select("doc_id", blocks.by_indent(F.col("text"), at).alias("by_indent"), blocks.variable(F.col("text"), at).alias("variable"), blocks.by_lines(F.col("text"), at, at + 2).alias("by_lines"))


@op("TXT23_brace_blocks")
def _(t):
    at = F.lit(1)
    return t.pages.select("page_id", blocks.brace_method(F.col("html"), at).alias("block"), blocks.ruby_method(F.col("html"), at).alias("ruby"), blocks.signature_line(F.col("html"), F.lit("<body>"), at).alias("line"))


@op("CHK3_code_chunks")
def _(t):
    files = t.pages.select("page_id", F.concat(F.lit("p"), F.when(F.col("page_id") % 2 == 0, ".js").otherwise(".py")).alias("path"), F.col("html").alias("code"))
    return codechunks.chunked(files, "page_id", "path", "code")


@op("CHK4_boundary_chunks")
def _(t):
    verbose = json.dumps({"ast_chunk_boundaries": [{"node_type": "function_declaration", "max_size_chars": 400, "min_size_chars": 60}], "file_type_overrides": [{"extension": ".md", "strategy": "recursive_text", "chunk_size": 300}]})
    flat = json.dumps({"boundaries": {"class_definition": {"max": 500, "min": 80}}, "fallback_chunk_size": 700})
    ending = F.get(F.array(F.lit(".js"), F.lit(".py"), F.lit(".md")), (F.col("page_id") % 3).cast("int"))
    files = t.pages.select("page_id", F.concat(F.lit("p"), ending).alias("path"), F.col("html").alias("code"), F.when(F.col("page_id") % 3 == 1, flat).otherwise(verbose).alias("config"))
    return codechunks.chunked(files, "page_id", "path", "code", "config")
