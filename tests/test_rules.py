"""File rules, query variants, scopes and integrity on cases derived by hand."""

import fnmatch
import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.functions import expansion, filerules
from quarry.functions import text as tx
from quarry.operators import upserts

FILES = [
    ("src/app.py", 1048576, "none", ""),
    ("src/app.py", 1048577, "size", "File size 1048577 exceeds limit 1048576"),
    ("src/app.py", None, "none", ""),
    ("license.PY", 1, "extension", "Filename 'license.py' matches rejected pattern 'LICENSE.*'"),
    ("a/GEMFILE.lock", 1, "extension", "Filename 'gemfile.lock' matches rejected pattern 'Gemfile.lock'"),
    ("docker-compose.yml", 1, "extension", "Filename 'docker-compose.yml' matches rejected pattern 'docker-compose*'"),
    ("licenses.py", 1, "none", ""),
    ("bin/run", 1, "extension", "File 'run' has no extension"),
    ("bin/run.", 1, "extension", "File 'run.' has no extension"),
    (".profile", 1, "extension", "File '.profile' has no extension"),
    ("", 1, "extension", "File '' has no extension"),
    (None, 1, "extension", "File '' has no extension"),
    ("a/b.TAR.GZ", 1, "extension", "Extension .gz is rejected"),
    ("x.min.js", 1, "none", ""),
    ("node_modules/lib/.x/a.js", 1, "directory", "Directory '.x' matches rejected pattern '.*'"),
    ("a/node_modules/b.js", 1, "directory", "Directory 'node_modules' matches rejected pattern 'node_modules'"),
    ("a/Node_Modules/b.js", 1, "none", ""),
    ("x.egg-info/b.py", 1, "directory", "Directory 'x.egg-info' matches rejected pattern '*.egg-info'"),
    ("./src//./b.rs", 1, "none", ""),
    ("a/.env.py", 1, "directory", "Directory '.env.py' matches rejected pattern '.*'"),
    ("a\nb/build/c\n.go", 1, "directory", "Directory 'build' matches rejected pattern 'build'"),
]


def test_file_rules(spark):
    df = spark.createDataFrame([(i, p, s) for i, (p, s, *_) in enumerate(FILES)], "i int, path string, size long")
    got = {r.i: (r.v.reason, r.v.detail) for r in df.select("i", filerules.verdict(F.col("path"), F.col("size")).alias("v")).collect()}
    assert got == {i: f[2:] for i, f in enumerate(FILES)}
    assert df.limit(0).select(filerules.verdict(F.col("path"), F.col("size"))).collect() == []
    bare = filerules.Rules(max_size=5, extensions=(), directories=(), filenames=())
    assert [r.v.reason for r in df.where("i in (0, 8, 12)").orderBy("i").select(filerules.verdict(F.col("path"), F.lit(5), bare).alias("v")).collect()] == ["none", "extension", "none"]


def test_globs(spark):
    rng = random.Random(5)
    patterns = ["*", "a*", "?b", "[ab]c", "[!ab]*", "a.c", "[a", "a^b", "[a-c]?*", "x+(y)", "[]a]", "[^a]"]
    names = ["", "a", "ab", "bc", "cc", "a.c", "abc", "[a", "a^b", "x+(y)", "]", "^", "a\nb"] + ["".join(rng.choice("abc.^[]") for _ in range(rng.randint(1, 4))) for _ in range(200)]
    for p in patterns:
        assert [bool(re.search(filerules.glob_regex(p).replace(r"\z", r"\Z"), n)) for n in names] == [fnmatch.fnmatchcase(n, p) for n in names], p
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = [r.place for r in df.select(filerules.first_glob(F.col("name"), tuple(patterns[1:])).alias("place")).collect()]
    assert got == [next((i for i, p in enumerate(patterns[1:]) if fnmatch.fnmatchcase(n, p)), None) for n in names]


VARIANTS = [
    ("How do I create a new user in Rails?", None, ["How do I create a new user in Rails?", "useCreateNewUser hook", "create new user endpoint"]),
    ("  Add the tag list  ", None, ["Add the tag list", "useAddTagList hook", "add tag list endpoint"]),
    ("fetch users, then create orders", None, ["fetch users, then create orders", "useCreateOrders hook", "create orders endpoint"]),
    ("create the", None, ["create the"]),
    ("save a a file", None, ["save a a file", "useSaveFile hook", "save file endpoint"]),
    ("delete ... for good, list it", None, ["delete ... for good, list it", "useListIt hook", "list it endpoint"]),
    ("recreate things", None, ["recreate things"]),
    ("get rows\nfrom tables", None, ["get rows\nfrom tables", "useGetRows hook", "get rows endpoint"]),
    ("   ", ["x"], ["   "]),
    (None, None, [""]),
    ("where is it", ["where is it", "find it", " find it ", "", None, "locate", "seek", "trace"], ["where is it", "find it", "locate", "seek"]),
    ("list it", ["other", "list it", "more"], ["list it", "useListIt hook", "list it endpoint", "other"]),
    ("list it", [], ["list it", "useListIt hook", "list it endpoint"]),
    ("list it", [" "], ["list it", "useListIt hook", "list it endpoint"]),
]


def test_variants(spark):
    df = spark.createDataFrame([(i, q, p) for i, (q, p, _) in enumerate(VARIANTS)], "i int, q string, p array<string>")
    got = {r.i: r.v for r in df.select("i", expansion.variants(F.col("q"), F.col("p")).alias("v")).collect()}
    assert got == {i: v for i, (*_, v) in enumerate(VARIANTS)}
    alone = {r.i: r.v for r in df.select("i", expansion.variants(F.col("q")).alias("v")).collect()}
    assert alone[10] == ["where is it"] and alone[11] == VARIANTS[12][2]


@pytest.mark.parametrize(
    "company, scope, key",
    [("c1", "knowledge", "c1_knowledge"), ("", "knowledge", None), (None, "knowledge", None), (None, "code:p:n", "p_n_code"), ("c1", "code:p:n:m", "p_n:m_code"), ("c1", "code::n", None), ("c1", "code:p:", None), ("c1", "code:p", None), ("c1", "Code:p:n", None), ("c1", "", None), ("c1", None, None)],
)
def test_scopes(spark, company, scope, key):
    assert spark.range(1).select(tx.scope_key(F.lit(company).cast("string"), F.lit(scope).cast("string")).alias("k")).first().k == key


def test_orphans_and_integrity(spark):
    mentions = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 1), ("c", None), (None, 1), ("d", 9), ("e", 3)], "entity string, chunk long")
    alive = spark.createDataFrame([(2,), (3,), (3,), (None,)], "chunk long")
    assert sorted(tuple(r) for r in upserts.orphans(mentions, alive).collect()) == [("b", 2), ("c", 1), ("d", 1)]
    chunks = spark.createDataFrame([(1,), (2,), (2,), (3,), (4,), (None,)], "chunk long")
    typed = spark.createDataFrame([("a",), ("a",), (None,), ("d",)], "entity string")
    found = upserts.integrity(mentions, chunks, typed)
    assert sorted(tuple(r) for r in found.collect()) == [("empty_chunk", "4"), ("orphan_entity", "c"), ("orphan_entity", "d"), ("untyped_entity", "b"), ("untyped_entity", "c"), ("untyped_entity", "e")]
    assert upserts.orphans(mentions.limit(0), alive).collect() == [] and upserts.integrity(mentions.limit(0), chunks.limit(0), typed).collect() == []
