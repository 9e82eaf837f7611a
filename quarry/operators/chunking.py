"""Text to rows: chunkers."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_CHUNK = 50


def line_windows(docs: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
    """Fixed windows of lines with overlap: (chunk_index, start_line, end_line, chunk) in native functions."""
    step = size - overlap
    lines = F.split(F.col(text), "\n", -1)
    starts = F.sequence(F.lit(0), F.greatest(F.size(lines) - overlap - 1, F.lit(0)), F.lit(step))
    cut = docs.withColumn("__lines", lines).select("*", F.posexplode(starts).alias("chunk_index", "__at"))
    return cut.withColumns({"start_line": F.col("__at") + 1, "end_line": F.least(F.col("__at") + size, F.size("__lines")), "chunk": F.array_join(F.slice("__lines", F.col("__at") + 1, F.lit(size)), "\n")}).drop("__lines", "__at")


def token_windows(docs: DataFrame, text: str, size: int = 512) -> DataFrame:
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    cut = docs.withColumn("__w", words).where(F.size("__w") > 0).select("*", F.posexplode(F.sequence(F.lit(1), F.size("__w"), F.lit(size))).alias("chunk_index", "__at"))
    return cut.withColumn("chunk", F.array_join(F.slice("__w", F.col("__at"), F.lit(size)), " ")).drop("__w", "__at")


def cuts(text: str, limit: int, line: int = 1) -> Iterator[tuple[str, int, int]]:
    """(piece, first line, last line): blocks between blank lines; those over the limit by line, lines over it by sentence, sentences over it anywhere."""
    for block in text.split("\n\n"):
        rows = block.split("\n")
        if len(block) <= limit:
            yield block, line, line + len(rows) - 1
        else:
            for at, row in enumerate(rows, line):
                for sentence in [row] if len(row) <= limit else row.split(". "):
                    for i in range(0, max(len(sentence), 1), limit):
                        yield sentence[i : i + limit], at, at
        line += len(rows) + 1


def refilled(pieces: Iterable[tuple[str, int, int]], limit: int, glue: str) -> list[tuple[str, int, int]]:
    """Adjacent pieces joined as long as they fit."""
    out: list[tuple[str, int, int]] = []
    for text, first, last in pieces:
        if out and len(out[-1][0]) + len(glue) + len(text) <= limit:
            out[-1] = (out[-1][0] + glue + text, out[-1][1], last)
        else:
            out.append((text, first, last))
    return out


def text_chunks(text: str | None, max_chars: int, base_line: int = 1, least: int = 50) -> list[tuple[str, int, int]]:
    """(chunk, first line, last line) of a text; chunks of fewer than ``least`` characters without blanks around go."""
    return [c for c in refilled(cuts(text or "", max_chars, base_line), max_chars, "\n") if len(c[0].strip()) >= least]


def document_chunks(text: str | None, max_chars: int = 1000, min_chars: int = 100) -> list[dict]:
    """Markdown: sections at headings; long ones are cut and refilled, only their first piece keeps the heading; short chunks join either neighbour they fit with."""
    if not (text or "").strip():
        return []
    heads = list(re.finditer(r"^#{1,6}\s+(.+)$", text, re.MULTILINE))
    edges = [0, *(h.start() for h in heads), len(text)]
    pieces: list[tuple[str, str | None]] = []
    for nr, (a, b) in enumerate(zip(edges, edges[1:])):
        section, heading = text[a:b].strip(), heads[nr - 1].group(1).strip() if nr else None
        if section:
            own = [section] if len(section) <= max_chars else [p for p, _, _ in refilled(cuts(section, max_chars), max_chars, "\n\n")]
            pieces += [(p, None if i else heading) for i, p in enumerate(own)]
    out = pieces[:1]
    for piece, heading in pieces[1:]:
        last, its = out[-1]
        if min(len(last), len(piece)) < min_chars and len(last) + 2 + len(piece) <= max_chars:
            # a short chunk takes the heading of what follows it; what follows a longer one gives its own up
            out[-1] = (f"{last}\n\n{piece}", (its or heading) if len(last) < min_chars else its)
        else:
            out.append((piece, heading))
    return [{"chunk_index": i, "total_chunks": len(out), "section_heading": h, "chunk": c} for i, (c, h) in enumerate(out)]


def chunk_documents(docs: DataFrame, doc_id: str, text: str, max_chars: int = 1000, min_chars: int = 100) -> DataFrame:
    """Greedy refilling is sequential, so each document is chunked in pandas, batch by batch."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = [{"doc_id": d, **c} for d, t in zip(pdf[doc_id], pdf[text]) for c in document_chunks(t, max_chars, min_chars)]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "total_chunks", "section_heading", "chunk"])

    return docs.select(doc_id, text).mapInPandas(run, "doc_id long, chunk_index int, total_chunks int, section_heading string, chunk string")


def headings(docs: DataFrame, text: str) -> DataFrame:
    return docs.select("*", F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?m)^#{1,6}\s+(.+)$"), F.lit(1))).alias("heading"))


def greedy_lines(text: str, limit: int) -> list[str]:
    """Lines gathered until one more would pass the limit."""
    out, size = [[]], 0
    for line in text.split("\n"):
        if out[-1] and size + len(line) + 1 > limit:
            out.append([])
            size = 0
        out[-1].append(line)
        size += len(line) + 1
    return ["\n".join(x) for x in out if x]


def chunk_lines(docs: DataFrame, doc_id: str, text: str, limit: int = 1000) -> DataFrame:
    """(doc_id, nr, chunk): greedy_lines of every text, a null one as empty; sequential within a text, so batch by batch in pandas."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = [(d, i, c) for d, t in zip(pdf["doc_id"], pdf["text"]) for i, c in enumerate(greedy_lines(t or "", limit))]
            yield pd.DataFrame(rows, columns=["doc_id", "nr", "chunk"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, nr int, chunk string")


def python_skeleton(source: str) -> list[str]:
    """Declarations of Python code: classes, functions and their arguments; none where it can't be parsed."""
    import ast

    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    out: list[str] = []

    def walk(body, depth: int) -> None:
        for n in body:
            if isinstance(n, ast.ClassDef):
                out.append("    " * depth + f"class {n.name}")
                walk(n.body, depth + 1)
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append("    " * depth + f"def {n.name}({', '.join(a.arg for a in n.args.args)})")

    walk(tree.body, 0)
    return out


def estimated_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def chunk_texts(docs: DataFrame, doc_id: str, text: str, max_chars: int = 1000) -> DataFrame:
    """(doc_id, nr, first_line, last_line, chunk) of every text; greedy refilling is sequential, so batch by batch in pandas."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = [(d, i, a, b, c) for d, t in zip(pdf[doc_id], pdf[text]) for i, (c, a, b) in enumerate(text_chunks(t, max_chars))]
            yield pd.DataFrame(rows, columns=["doc_id", "nr", "first_line", "last_line", "chunk"])

    return docs.select(doc_id, text).mapInPandas(run, "doc_id long, nr int, first_line int, last_line int, chunk string")


# --- fixed values ---
SPLIT_CHARS, NESTED_LINES = 2000, 10
# --- end of fixed values ---


def method_chunks(methods: DataFrame) -> DataFrame:
    """Chunks (chunk_id, parent_id, kind, name, start_line, end_line) of methods (document_id, name, start_line, end_line, code, nested array<struct(kind, name, start_line, end_line)>).

    A method is a chunk; one of SPLIT_CHARS or more has each nested symbol of NESTED_LINES or more as a chunk of its own too.
    """
    own = F.concat_ws(":", "document_id", F.lit("method"), "name", F.col("start_line").cast("string"))
    whole = methods.select(own.alias("chunk_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("method").alias("kind"), "name", "start_line", "end_line")
    parts = methods.where(F.length("code") >= SPLIT_CHARS).select(own.alias("parent_id"), F.explode("nested").alias("n"))
    parts = parts.where(F.col("n.end_line") - F.col("n.start_line") + 1 >= NESTED_LINES)
    part_id = F.concat_ws(":", "parent_id", F.lit("nested"), "n.kind", "n.name", F.col("n.start_line").cast("string"))
    return whole.unionByName(parts.select(part_id.alias("chunk_id"), "parent_id", F.col("n.kind").alias("kind"), F.col("n.name").alias("name"), F.col("n.start_line").alias("start_line"), F.col("n.end_line").alias("end_line")))
