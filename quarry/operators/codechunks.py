"""Code cut along its blocks: under a size limit, or at boundaries that a configuration names.

A file's blocks are intervals of lines: a line's block runs to the next line that is not deeper, closing lines included.
Depth is the number of open braces in languages with braces (strings and comments aside) and the indentation in others.  One
pass with a stack finds all ends.  A file is one row and is cut in one task, in time linear in its length.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunking import text_chunks

# --- fixed values ---
LEAST = 50
MAX_CHARS = 1000
ALIASES = {"singleton_method": "method"}
BRACES = (".js", ".jsx", ".ts", ".tsx", ".java", ".go", ".rs", ".c", ".h", ".cc", ".cpp", ".hpp", ".cs", ".php", ".swift", ".kt", ".scala")
INDENTED = (".py", ".pyi", ".rb", ".rake")
# --- end of fixed values ---

#: What a block is, by the beginning of its first line; the first that fits, from top to bottom.
KINDS = {
    ".py": (("class_definition", r"class\b"), ("function_definition", r"(async\s+)?def\b"), ("decorated_definition", r"@")),
    ".rb": (("class", r"class\b"), ("module", r"module\b"), ("singleton_method", r"def\s+self\."), ("method", r"def\b"), ("do_block", r".*\bdo(\s*\|[^|]*\|)?\s*$")),
    ".go": (("method_declaration", r"func\s*\("), ("function_declaration", r"func\b"), ("type_declaration", r"type\b")),
    ".rs": (("function_item", r"(pub(\([^)]*\))?\s+)?(async\s+)?fn\b"), ("struct_item", r"(pub\s+)?struct\b"), ("enum_item", r"(pub\s+)?enum\b"), ("impl_item", r"impl\b"), ("trait_item", r"(pub\s+)?trait\b")),
    "{": (("class_declaration", r"(export\s+)?(default\s+)?((public|private|protected|abstract|final|static)\s+)*class\b"), ("interface_declaration", r"(export\s+)?((public|private)\s+)*interface\b"), ("function_declaration", r"(export\s+)?(default\s+)?(async\s+)?function\b"), ("method_declaration", r"((public|private|protected|static|final)\s+)+[\w<>\[\], ]+\("), ("lexical_declaration", r"(export\s+)?(const|let)\b")),
}
_TOKENS = re.compile(r"""\\.|["'`{}\n]|//|/\*|\*/""", re.DOTALL)
_CLOSING = re.compile(r"\s*([)\]}]+[;,)]*|end)\s*$")


def extension(path: str | None) -> str:
    name = (path or "").rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[-1].lower() if "." in name.lstrip(".") else ""


def depths(code: str, braces: bool) -> list[int]:
    """Each line's depth: open braces at its start, or its indentation; closing lines are one deeper than they look, as they belong to what they close."""
    if not braces:
        lines, out, last = code.split("\n"), [], 0
        for line in lines:
            if line.strip():
                last = 2 * (len(line) - len(line.lstrip()))
                if _CLOSING.match(line):
                    last += 1
                out.append(last)
            else:
                out.append(-1)  # a blank line goes with what is above it
        return out
    out, depth, quote, comment = [0], 0, "", ""
    for m in _TOKENS.finditer(code):
        t = m[0]
        if t == "\n" or t == "\\\n":
            out.append(max(depth, 0))
            if comment == "//":
                comment = ""
            if quote in ("'", '"') and t == "\n":  # such strings end with their line
                quote = ""
        elif comment:
            comment = "" if comment == "/*" and t == "*/" else comment
        elif quote:
            quote = "" if t == quote else quote
        elif t in ("//", "/*"):
            comment = t
        elif t in ("'", '"', "`"):
            quote = t
        elif t in "{}" and len(t) == 1:
            depth += 1 if t == "{" else -1
    return out


def ends(depth: list[int]) -> list[int]:
    """For each line the first line after its block: the nearest later one that is not deeper (blank lines, -1, end nothing)."""
    out, stack = [len(depth)] * len(depth), []
    for i, d in enumerate(depth):
        if d < 0:
            out[i] = i + 1
            continue
        while stack and depth[stack[-1]] >= d:
            out[stack.pop()] = i
        stack.append(i)
    return out


def packed(parts: list[tuple[int, int]], size, limit: int) -> list[tuple[int, int]]:
    """Neighbouring intervals put together as long as they fit."""
    out: list[tuple[int, int]] = []
    for a, b in parts:
        if out and out[-1][1] == a and size(out[-1][0], b) <= limit:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def by_size(first: int, stop: int, end: list[int], size, limit: int) -> list[tuple[int, int]]:
    """Lines first to stop as intervals within the limit (a longer line stands alone): blocks that fit are whole; of others, their first line and the blocks below it are put together again, and with nothing beside them."""
    out: list[tuple[int, int]] = []
    work = [(first, stop)]
    while work:
        a, b = work.pop()
        if size(a, b) <= limit or b - a == 1:
            out.append((a, b))
            continue
        parts, at = [], a
        while at < b:  # the blocks side by side; one that is all there is gives its first line and what is in it
            to = min(end[at], b)
            if (at, to) == (a, b):
                to = a + 1
            parts.append((at, to))
            at = to
        groups: list[tuple[int, int]] = []
        run: list[tuple[int, int]] = []
        for p in parts:
            if size(*p) <= limit:
                run.append(p)
            else:
                groups += [*packed(run, size, limit), p]
                run = []
        work += (groups + packed(run, size, limit))[::-1]
    return out


def sizes(lines: list[str]):
    """size(a, b): characters of lines a to b - 1, joined."""
    total = [0]
    for line in lines:
        total.append(total[-1] + len(line) + 1)
    return lambda a, b: total[b] - total[a] - 1


def size_chunks(code: str, ext: str, limit: int = MAX_CHARS) -> list[tuple[str, int, int]]:
    """(chunk, first line, last line): all lines once, in order, none over the limit but single lines."""
    lines = code.split("\n")
    cut = by_size(0, len(lines), ends(depths(code, ext in BRACES)), sizes(lines), limit)
    return [("\n".join(lines[a:b]), a + 1, b) for a, b in cut]


def boundaries(config: dict) -> dict[str, tuple[int, int]]:
    """kind: (most, least) from either shape of configuration, aliases added."""
    out = {}
    for e in config.get("ast_chunk_boundaries") or []:
        if e.get("node_type"):
            out[e["node_type"]] = (e.get("max_size_chars", e.get("max", MAX_CHARS)), e.get("min_size_chars", e.get("min", LEAST)))
    if not out:
        out = {k: (e.get("max", MAX_CHARS), e.get("min", LEAST)) for k, e in (config.get("boundaries") or {}).items()}
    return {a: out[c] for a, c in ALIASES.items() if c in out} | out


def kind_of(line: str, ext: str) -> str | None:
    head = line.strip()
    table = KINDS.get({".pyi": ".py", ".rake": ".rb"}.get(ext, ext), KINDS["{"] if ext in BRACES else ())
    return next((kind for kind, pattern in table if re.match(pattern, head)), None)


def config_chunks(code: str, ext: str, config: dict, limit: int = MAX_CHARS) -> list[tuple[str, int, int]]:
    """Blocks side by side at the top of a file: those of a configured kind are chunks of their own (those over their most are cut by size, those under their least join their neighbours); all others are put together up to the limit."""
    override = next((o for o in config.get("file_type_overrides") or [] if (o.get("extension") or "").lower() == ext), {})
    limit = override.get("chunk_size", limit)
    if override.get("strategy") == "recursive_text":
        return text_chunks(code, limit)
    known = boundaries(config)
    most_of_all = config.get("fallback_chunk_size", max((m for m, _ in known.values()), default=limit))
    if ext not in BRACES and ext not in INDENTED:
        return text_chunks(code, most_of_all)
    lines = code.split("\n")
    size, end = sizes(lines), ends(depths(code, ext in BRACES))
    out: list[tuple[int, int]] = []
    held: list[tuple[int, int]] = []  # neighbours that wait

    def flush() -> None:
        if held:
            out.extend(by_size(held[0][0], held[-1][1], end, size, most_of_all))
            held.clear()

    at = 0
    while at < len(lines):
        to = end[at]
        kind = kind_of(lines[at], ext)
        if kind == "decorated_definition" and kind not in known:  # a decorator goes with what it decorates
            below = to
            while below < len(lines) and kind_of(lines[below], ext) == kind:
                below = end[below]
            if below < len(lines):
                kind, to = kind_of(lines[below], ext), end[below]
        sizes_of = known.get(kind) or known.get(ALIASES.get(kind, ""))
        most, least = sizes_of or (None, None)
        if sizes_of is None or size(at, to) < least:
            if held and size(held[0][0], to) > most_of_all:
                flush()
            held.append((at, to))
        else:
            flush()
            out.extend([(at, to)] if size(at, to) <= most else by_size(at, to, end, size, most))
        at = to
    flush()
    return [(c, a + 1, b) for a, b in out if len((c := "\n".join(lines[a:b])).strip()) >= LEAST]


def chunked(files: DataFrame, key: str, path: str, code: str, config: str | None = None, limit: int = MAX_CHARS) -> DataFrame:
    """(key, nr, first_line, last_line, chunk) of every file (null code: none); with ``config`` (a column of JSON) at its boundaries, else by size."""
    kind = files.schema[key].dataType
    fields = [T.StructField(key, kind), *[T.StructField(c, T.IntegerType()) for c in ("nr", "first_line", "last_line")], T.StructField("chunk", T.StringType())]
    settings = F.col(config) if config else F.lit(None).cast("string")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known: dict[str, dict] = {}
        for b in batches:
            at, out = [], []
            for i, (p, c, s) in enumerate(zip(*(b.column(j).to_pylist() for j in (1, 2, 3)))):
                if c is None:
                    continue
                if s is not None and s not in known:
                    known[s] = json.loads(s)
                found = size_chunks(c, extension(p), limit) if s is None else config_chunks(c, extension(p), known[s], limit)
                at += [i] * len(found)
                out += [(nr, a, z, text) for nr, (text, a, z) in enumerate(found)]
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, pa.int32()) for c in cols[:3]], pa.array(cols[3], pa.string())], names=[f.name for f in fields])

    return files.select(key, path, code, settings).mapInArrow(run, T.StructType(fields))
