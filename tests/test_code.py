"""Blocks and chunks of code: cases by hand and brute force."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import blocks
from quarry.operators import codechunks as cc

PY = "import os\n\nclass A:\n    def f(self):\n        return 1\n\n    x = 2\nprint(A)\n"
JS = "function f(a) {\n  // } not this one\n  const s = \"}\" + '{' + `}`; /* } */\n  if (a) { return \"\\\"}\"; }\n}\nfunction g() {}\n"
RUBY = "# top\nclass A\n  def f\n    [1].each do |x|\n      x\n    end\n  end\nend\n"
VAR = "X = {\n  1,\n  2}\nY = 3\nZ = a, \\\n  b"


def block(spark, f, rows):
    df = spark.createDataFrame(rows, "code string, at int")
    return [r[0] for r in df.select(f(F.col("code"), F.col("at"))).collect()]


def test_blocks_by_hand(spark):
    assert block(spark, blocks.by_indent, [(PY, 3), (PY, 4), (PY, 8), (PY, 99), (PY, 0), (None, 1), ("", 1)]) == ["class A:\n    def f(self):\n        return 1\n\n    x = 2", "    def f(self):\n        return 1\n", "print(A)\n", "", "", None, ""]
    assert block(spark, blocks.variable, [(VAR, 1), (VAR, 4), (VAR, 5), (VAR, 9)]) == ["X = {\n  1,\n  2}", "Y = 3", "Z = a, \\\n  b", ""]
    assert block(spark, blocks.ruby_method, [(RUBY, 1), (RUBY, 3), (RUBY, 4), (RUBY, 50)]) == ["\n".join(RUBY.split("\n")[2:7])] * 2 + ["\n".join(RUBY.split("\n")[3:6]), ""]
    assert block(spark, blocks.brace_method, [(JS, 1), (JS, 6), (JS, 3), ("a *// {\n{ x }", 1), ("/*/ { */ {\n}", 1), ("no braces", 1), (JS, -1)]) == ["\n".join(JS.split("\n")[:5]), "function g() {}", "\n".join(JS.split("\n")[2:4]), "a *// {\n{ x }", "/*/ { */ {\n}", "no braces", ""]
    df = spark.createDataFrame([(JS,)], "code string")
    lines = df.select(blocks.signature_line("code", F.lit(" function   f(a)")), blocks.signature_line("code", F.lit("function"), F.lit(5)), blocks.signature_line("code", F.lit("} not")), blocks.by_lines(F.col("code"), F.lit(2), F.lit(2)), blocks.by_lines(F.col("code"), F.lit(2), F.lit(20))).first()
    assert list(lines) == [1, 6, None, "  // } not this one", ""]


def brute_brace(code, start):
    """Character by character, looking ahead instead of behind."""
    lines = code.split("\n")[start - 1 :]
    depth, opened, quote, comment = 0, False, None, False
    for nr, line in enumerate(lines, 1):
        chars, at = line + "\0", 0
        while at < len(line):
            two = chars[at : at + 2]
            if quote is None and two == "//":
                break
            if quote is None and two == "/*" or comment and quote is None and two == "*/":
                comment, at = two == "/*", at + 2
                continue
            c = line[at]
            if not comment:
                if c in "\"'`" and (at == 0 or line[at - 1] != "\\"):
                    quote = c if quote is None else None if quote == c else quote
                elif quote is None and c in "{}":
                    depth, opened = depth + (1 if c == "{" else -1), opened or c == "{"
                    if c == "}" and opened and depth == 0:
                        return "\n".join(lines[:nr])
            at += 1
    return "\n".join(lines)


def test_braces_against_brute_force(spark):
    rng = random.Random(6)
    codes = ["".join(rng.choice(['"', "'", "`", "\\", "{", "}", "{", "/", "*", "//", "/*", "*/", "\n", "a", " "]) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    assert block(spark, blocks.brace_method, [(c, 1) for c in codes]) == [brute_brace(c, 1) for c in codes]


def test_long_code_in_linear_time(spark):
    code = "f {\n" + "  x = 1; // }\n" * 200_000 + "}\nrest"
    for f in (blocks.brace_method, blocks.by_indent):
        got = block(spark, f, [(code, 1)])[0]
        assert got.count("\n") == (200_001 if f is blocks.brace_method else 200_000)
    assert sum(len(c[0]) + 1 for c in cc.size_chunks(code, ".js", 500)) == len(code) + 1


def test_ends_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        d = [rng.choice([-1, 0, 0, 1, 2, 3]) for _ in range(rng.randint(0, 30))]
        want = [next((j for j in range(i + 1, len(d)) if 0 <= d[j] <= x), len(d)) if x >= 0 else i + 1 for i, x in enumerate(d)]
        assert cc.ends(d) == want


@pytest.mark.parametrize("ext", [".py", ".js", ".rb"])
def test_size_chunks_cover_every_line_once(ext):
    rng = random.Random(ext)
    for _ in range(200):
        code = "\n".join("  " * rng.randint(0, 4) + rng.choice(["", "x" * rng.randint(1, 30), "def f", "f {", "}", "end", "# {", "'{'"]) for _ in range(rng.randint(1, 40)))
        limit = rng.choice([10, 40, 100, 10_000])
        got, lines = cc.size_chunks(code, ext, limit), code.split("\n")
        assert [i for _, a, b in got for i in range(a, b + 1)] == list(range(1, len(lines) + 1))
        assert all(c == "\n".join(lines[a - 1 : b]) and (len(c) <= limit or a == b) for c, a, b in got)
        if limit == 10_000:
            assert len(got) == 1


def test_size_chunks_keep_blocks_whole():
    code = "a = 1\ndef f():\n    one\n    two\n\ndef g():\n    three\n    four\n    five"
    assert cc.size_chunks(code, ".py", 34) == [("a = 1\ndef f():\n    one\n    two\n", 1, 5), ("def g():\n    three\n    four\n    five".rsplit("\n", 1)[0], 6, 8), ("    five", 9, 9)]
    js = "function f() {\n  a();\n}\nfunction g() {\n  b();\n}"
    assert [(a, b) for _, a, b in cc.size_chunks(js, ".js", 30)] == [(1, 3), (4, 6)]


def method(name, n):
    return f"def {name}\n" + "".join(f"  line {i} of {name}\n" for i in range(n)) + "end\n"


def test_boundaries_of_both_shapes():
    verbose = {"ast_chunk_boundaries": [{"node_type": "method", "max_size_chars": 300, "min_size_chars": 30}, {"max_size_chars": 5}]}
    flat = {"boundaries": {"method": {"max": 300, "min": 30}}, "ast_node_types": ["method"]}
    assert cc.boundaries(verbose) == cc.boundaries(flat) == {"method": (300, 30), "singleton_method": (300, 30)} and cc.boundaries({}) == {}
    code = "require 'x'\n" * 6 + method("one", 4) + method("self.two", 4) + method("big", 40) + "puts 'the end of this file, and nothing more than that'\n"
    for config in (verbose, flat):
        got = cc.config_chunks(code, ".rb", config)
        assert got[0][0].count("require") == 6 and got[1][0].startswith("def one") and got[2][0].startswith("def self.two") and got[1][0].rstrip().endswith("end")
        assert all(len(c) <= 300 for c, _, _ in got) and got[-1][0].startswith("puts") and got[3][0].startswith("def big")
        covered = [i for _, a, b in got for i in range(a, b + 1)]
        assert covered == sorted(set(covered))


def test_overrides_and_small_blocks():
    config = {"ast_chunk_boundaries": [{"node_type": "function_definition", "max_size_chars": 400, "min_size_chars": 100}], "fallback_chunk_size": 200, "file_type_overrides": [{"extension": ".MD", "strategy": "recursive_text", "chunk_size": 60}, {"extension": ".py", "chunk_size": 150}]}
    text = "words of a paragraph that is long enough to stay\n\n" * 4
    assert [c for c, _, _ in cc.config_chunks(text, ".md", config)] == [] or all(len(c) <= 60 for c, _, _ in cc.config_chunks(text, ".md", config))
    small = "def a():\n    return 'a little function'\n\ndef b():\n    return 'another little function'\n"
    got = cc.config_chunks(small, ".py", config)  # both are under their least and stand together
    assert len(got) <= 2 and "".join(c for c, _, _ in got).count("def ") == 2
    decorated = "@cached\n@other(1)\ndef f():\n" + "    x = 1\n" * 20
    assert cc.config_chunks(decorated, ".py", config)[0][1] == 1 and len(cc.config_chunks(decorated, ".py", config)) == 1
    assert cc.config_chunks("", ".py", config) == [] and cc.config_chunks(text, "", config)


def test_chunked_table(spark):
    rows = [("a", "x/f.py", PY * 30, None), ("b", "f.js", JS * 30, json.dumps({"boundaries": {"function_declaration": {"max": 900, "min": 1}}})), ("c", None, "plain text " * 30, None), ("d", "e.py", None, None), ("e", "e.py", "", None)]
    df = spark.createDataFrame(rows, "id string, path string, code string, config string").withColumn("nr", F.lit("own"))
    got = cc.chunked(df, "id", "path", "code", "config").collect()
    assert {r.id for r in got} == {"a", "b", "c", "e"} and all(r.chunk.startswith("function f") for r in got if r.id == "b")
    assert sum(len(r.chunk) + 1 for r in got if r.id == "a") == len(PY * 30) + 1
    assert cc.chunked(df.limit(0), "id", "path", "code").collect() == []
