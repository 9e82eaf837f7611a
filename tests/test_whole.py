"""Operators on inputs that the given tables don't hold, or beyond what a registered query shows of them."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from quarry import catalog
from quarry.functions import text
from quarry.operators import graph, vectors

PATHS = ["a/b.RS", "x.cpp", "y.cs", "z.php", "k.kt", "p.tsx", "h.h", "q.m", "s.ps1", "n.md", "https://a.org/m.py", "https://host.com", ".py", "a.py/", "noext", "u.HTML", "w.js", "v.yml", "d.c/e", "f.go\n", ""]


def test_triplet_importance_penalty(spark):
    triplets = spark.createDataFrame([(1, 1, 2), (1, 1, 901), (900, 2, 403), (900, 800, 902)], "src long, rel long, dst long")
    distances = spark.createDataFrame([(1, 0.1), (2, 0.2), (403, 0.3), (901, 0.5)], "id long, distance double")
    got = vectors.triplet_importance(triplets, distances, 3, F.col("dst") % 2 == 0).collect()
    assert [tuple(r) for r in got] == [(1, 1, 2, 0.28), (1, 1, 901, 0.7), (900, 2, 403, 4.0)]
    every = vectors.triplet_importance(triplets, distances, 9, F.col("dst") % 2 == 0).collect()
    assert len(every) == 4 and tuple(every[-1]) == (900, 800, 902, 7.35)


def test_languages_and_mime_of_files(spark, tmp_path):
    spark.createDataFrame(list(enumerate(PATHS)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("SRC5_language_all", "TXT20_mime_all"):
        got = catalog.QUERIES[name](spark, str(tmp_path)).orderBy("page_id")
        assert [tuple(r) for r in got.collect()] == con.execute(f"{catalog.ORACLE_SQL[name]} ORDER BY page_id").fetchall()
    docs = spark.createDataFrame(list(enumerate(PATHS)), "page_id long, url string")
    u = F.col("url")
    got = {r.url: tuple(r)[1:] for r in docs.select("url", text.document_language(u), text.code_language(u), text.event_language(u), text.language(u), text.mime_type(u), text.context_mime(u)).collect()}
    plain = "text/plain"
    assert got["a/b.RS"] == ("rust", "rust", "rust", "rust", plain, plain) and got["x.cpp"] == ("cpp", "cpp", "cpp", "cpp", "text/x-c++", plain)
    assert got["h.h"] == ("c_header", "unknown", "c", "c", "text/x-c-header", plain) and got["q.m"] == ("objective_c", "unknown", "objectivec", "objectivec", plain, plain)
    assert got["p.tsx"] == ("unknown", "unknown", "typescript", "typescript", "text/typescript-jsx", "text/typescript-jsx")
    assert got["https://a.org/m.py"] == ("python", "python", "python", "python", "text/x-python", "text/x-python")
    assert got[".py"] == ("unknown", "python", None, "python", "text/x-python", plain) and got["a.py/"][:3] == ("python", "unknown", "python")
    assert got["u.HTML"] == ("unknown", "unknown", "html", "html", plain, "text/html") and got["n.md"] == ("unknown", "unknown", None, "unknown", "text/markdown", "text/markdown")
    assert all(got[x][:4] == ("unknown", "unknown", None, "unknown") and got[x][4] == plain for x in ("https://host.com", "noext", "d.c/e", "f.go\n", ""))


def test_scoped_delete_takes_three_hops_of_one_scope(spark):
    nodes = spark.createDataFrame([("d", "A"), ("b", "B"), ("c", "A"), ("e", "A"), ("f", "A"), ("g", None), ("d2", "B"), ("h", "A")], "id string, scope string")
    edges = spark.createDataFrame([("d", "r", "b"), ("c", "r", "b"), ("c", "r", "e"), ("e", "r", "f"), ("d", "r", "g"), ("d2", "r", "e")], "src string, rel string, dst string")
    left = lambda where, **kw: sorted(r.id for r in graph.scoped_delete(nodes, edges, nodes.where(where), **kw).collect())
    assert left("id = 'd'") == ["b", "d2", "f", "g", "h"]
    assert left("id = 'd'", hops=2) == ["b", "d2", "e", "f", "g", "h"]
    assert left("id in ('d', 'd2')") == ["f", "g", "h"]


def test_canonical_name_keeps_all_acronyms(spark):
    names = spark.createDataFrame([("SOAPGateway rest_json",), ("  sdk__cli tool",), ("prro API",), ("",)], "s string")
    assert [r[0] for r in names.select(text.canonical_name(F.col("s"))).collect()] == ["SOAP Gateway REST JSON", "SDK CLI Tool", "PRRO API", ""]


def test_ordered_queries_return_every_row(spark, tmp_path):
    docs = [(i, f"src{i // 250}", ("fr", "de", "en", None)[i // 250] if i < 1000 else "fr") for i in range(2000)]
    spark.createDataFrame(docs, "doc_id long, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in catalog.QUERIES["WIN9_specificity_all"](spark, str(tmp_path)).collect()]
    class_of = {"src1": 0, "src2": 1, "src3": 2}
    assert got == [(i, c) for c, i in sorted((class_of.get(s, 3), i) for i, s, _ in docs)] and {c for _, c in got} == {0, 1, 2, 3}
    got = [tuple(r) for r in catalog.QUERIES["TOP13_nulls_last_all"](spark, str(tmp_path)).collect()]
    want = {lang: [i for i, _, x in docs if x == lang] for lang in ("fr", "en")}
    assert got == [(i, lang) for lang in ("fr", "en") for i in want[lang]] + [(i, None) for i, _, x in docs if x in ("de", None)]


def test_batch_search_answers_every_query(spark):
    rng = np.random.default_rng(7)
    vectors_of = lambda n: [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(n, 8)))]
    rows, queries = vectors_of(60), vectors_of(1300)
    a, b = (spark.createDataFrame(x, f"{i} long, {v} array<double>") for x, i, v in ((rows, "id", "embedding"), (queries, "query_id", "query")))
    x, q = (np.array([v for _, v in y]) for y in (rows, queries))
    score = np.round((q / np.linalg.norm(q, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T, 6)
    want = {(i, r + 1): (int(c), float(score[i, c])) for i in range(len(q)) for r, c in enumerate(np.lexsort((np.arange(len(x)), -score[i]))[:3])}
    for sizes in ({}, {"shard_rows": 16, "query_rows": 300}):
        got = {(r.query_id, r.rank): (r.id, r.score) for r in vectors.top_k_each(a, b, 3, **sizes).collect()}
        assert got.keys() == want.keys() and all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 1e-5 for x in want)
