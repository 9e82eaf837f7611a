"""Cases and brute force for the operators that SQL can't show."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import canonical as cn
from quarry.functions import guard
from quarry.operators import chunking, clusters, filetree, search
from quarry.streaming import workers


def entities(spark, *names):
    return spark.createDataFrame([("tool", n, d) for n, d in names], "entity_type string, name string, description string")


@pytest.mark.parametrize(
    "names, merged",
    [
        ([("ezyVet Go", "x"), ("ezyVet", "x")], []),
        ([("Inventory Strength Rating: 6/10", "a"), ("Inventory Strength Rating: 3/10", "b")], []),
        ([("Dynamics 365 SCM", "ERP suite"), ("Dynamics 365", "ERP suite")], [("Dynamics 365", "Dynamics 365 SCM")]),
        ([("Oracle NetSuite", "ERP cloud"), ("NetSuite", "ERP cloud")], [("NetSuite", "Oracle NetSuite")]),
        ([("Windows Pro", "os"), ("Windows", "os")], []),
        ([("Acme", "one"), ("Zenith", "two")], []),
    ],
)
def test_merges(spark, names, merged):
    assert sorted((r.duplicate, r.canonical) for r in clusters.merges(entities(spark, *names)).collect()) == merged


def test_types_and_empty_tables_never_merge(spark):
    two = spark.createDataFrame([("tool", "Acme Inc", None), ("org", "Acme", None), ("tool", "", "x"), (None, "Acme", "x")], "entity_type string, name string, description string")
    assert clusters.merges(two).collect() == [] and clusters.merges(two.limit(0)).collect() == []


def test_blocks_lose_no_pair(spark):
    rng = random.Random(5)
    names = sorted({"".join(rng.choice("ab ") for _ in range(rng.randrange(0, 9))).strip() for _ in range(150)})
    got = {(r.a, r.b) for r in clusters.names_that_meet(spark.createDataFrame([("t", n) for n in names], "entity_type string, norm string")).collect()}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {(a, b) for a in names for b in names if a < b and ((a and a in b) or (b and b in a) or edits(a, b) <= 2)}
    assert got == want


def test_names(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert [one(cn.canonical_name(lit(x))) for x in ("aiIntegration", "HTTPSConnection", "user_payment  api")] == ["AI Integration", "HTTPS Connection", "User Payment API"]
    assert one(cn.normalised(lit("Foo.Bar (old) Software Inc."))) == "foo bar" and one(cn.normalised(lit("Inc"))) == ""
    assert tuple(one(cn.suffix_split(lit("Rating: 6/10")))) == ("rating", "6/10") and tuple(one(cn.suffix_split(lit("Plain")))) == ("plain", None)
    assert one(cn.whitelist_key(lit("Appointments (legacy).x_Y"))) == "appointments legacy x y"


def test_query_guard(spark):
    queries = ["MATCH (n) RETURN n", "match (n:A) WHERE n.x = 1 RETURN n", "MATCH (a) OPTIONAL MATCH (b)-[:x]->(c) WHERE b.y RETURN a", "MATCH (n {company_id: 1}) RETURN n", "RETURN 1", "MATCH (n) WITH n MATCH (m)"]
    rows = spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "i int, q string").select("i", guard.scoped(F.col("q")).alias("s")).orderBy("i").collect()
    assert [r.s.q for r in rows] == [
        "MATCH (n) WHERE n.company_id = $company_id RETURN n",
        "match (n:A) WHERE ( n.x = 1) AND n.company_id = $company_id RETURN n",
        "MATCH (a) WHERE a.company_id = $company_id OPTIONAL MATCH (b)-[:x]->(c) WHERE ( b.y) AND b.company_id = $company_id AND c.company_id = $company_id RETURN a",
        None,
        None,
        "MATCH (n) WHERE n.company_id = $company_id WITH n MATCH (m) WHERE m.company_id = $company_id",
    ]
    assert [r.s.error is None for r in rows] == [True, True, True, False, False, True]
    ok = lambda q: spark.range(1).select(guard.error(F.lit(q))).first()[0]
    assert ok("MATCH (n)-[:calls]->(m) RETURN m LIMIT 1000") is None and ok("MATCH (n) SET n.x = 1") and ok("MATCH (n) RETURN n LIMIT 99999999999999999999") and ok("OPTIONAL MATCH (n) RETURN n")


def test_document_chunk_headings():
    got = chunking.document_chunks("# A\n\n" + "x" * 30 + "\n\n" + "y" * 30, 40, 1)
    assert [(c["section_heading"], c["chunk"]) for c in got] == [("A", "# A\n\n" + "x" * 30), (None, "y" * 30)]
    # a short chunk joins the one after it and takes its heading, or the one before it
    assert [(c["section_heading"], len(c["chunk"])) for c in chunking.document_chunks("pre\n# H\n" + "z" * 50 + "\n# T\nt", 200, 10)] == [("H", 5 + 54 + 2 + 5)]


def test_text_chunk_lines():
    text = "a" * 60 + "\n" + "b" * 60 + "\n\n" + "c" * 150 + "\n\nshort"
    assert [(c[:1], len(c), a, b) for c, a, b in chunking.text_chunks(text, 100)] == [("a", 60, 1, 1), ("b", 60, 2, 2), ("c", 100, 4, 4), ("c", 56, 4, 6)]
    assert chunking.text_chunks(None, 100) == [] and chunking.text_chunks("x", 100) == []


def walked(root):
    """The tree by walking folders, as a person would."""
    out = []
    skip = lambda n: n in filetree.SKIP_DIRS or n.startswith(".")

    def walk(d, depth):
        names = sorted(os.listdir(d))
        for f in (n for n in names if os.path.isfile(f"{d}/{n}") and os.path.splitext(n)[1].lower() not in filetree.BINARY_EXTENSIONS):
            out.append("  " * depth + f"{f} [S]")
        for n in (n for n in names if os.path.isdir(f"{d}/{n}") and not skip(n)):
            end = f"{d}/{n}"
            while True:
                inside = [x for x in os.listdir(end) if not skip(x)]
                if len(inside) != 1 or os.path.isfile(f"{end}/{inside[0]}"):
                    break
                end = f"{end}/{inside[0]}"
            if inside:
                out.append("  " * depth + os.path.relpath(end, d) + "/")
                walk(end, depth + 1)

    walk(root, 0)
    return out


def test_file_tree(spark, tmp_path):
    paths = ["README.md", ".env.txt", "a/b/c/x.py", "a/b/c/y.PNG", "a/b/d/z.py", "q/r/s/t/one.rb", "q/r/s/t/two.rb", "node_modules/m/x.js", "only/.hidden", "w/x.png", "w/v/k.go", ".git/config"]
    for p in paths:
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("1\n")
    got = filetree.tree_lines(spark.createDataFrame([(p, 1) for p in paths], "path string, lines int")).collect()
    assert [r.line for r in got] == walked(str(tmp_path))
    assert filetree.tree_lines(spark.createDataFrame([], "path string, lines int")).collect() == []


def test_search_modes():
    asked = {m: (lambda m=m: m) for m in search.MODES}
    assert search.search_in_mode("CHUNKS", asked) == "CHUNKS" and search.search_in_mode("??", asked) == "GRAPH_COMPLETION" and search.search_in_mode("CYPHER", asked, admin=True) == "CYPHER"
    with pytest.raises(PermissionError):
        search.search_in_mode("CYPHER", asked)


def test_mmr_with_null_text(spark):
    from quarry.operators import fusion

    rows = spark.createDataFrame([(1, 1, 0.9, "a b"), (1, 2, 0.8, "a b"), (1, 3, 0.7, None), (1, 4, 0.1, "c")], "query_id long, id long, score double, text string")
    # by hand: 2 is as good as 1 but says the same (0.4 - 0.5), 3 is like none (0.35)
    assert [r.id for r in fusion.mmr(rows, 3).orderBy("position").collect()] == [1, 3, 4]


def test_item_kinds(spark):
    got = spark.createDataFrame([("code.entities",), ("summaries.v1",), ("chunks",), ("other",)], "t string").select(workers.item_kind(F.col("t"))).collect()
    assert [r[0] for r in got] == ["entity", "summary", "chunk", None]


def test_line_chunks(spark):
    rng = random.Random(8)
    texts = [None, "", "\n", "x" * 50, "\n\n" + "y" * 9 + "\n"] + ["\n".join("a" * rng.randrange(0, 14) for _ in range(rng.randrange(1, 30))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "z"), (None, "z")]
    got = {}
    for r in chunking.chunk_lines(spark.createDataFrame(rows, "id long, body string").withColumn("doc_id", F.lit("own")), "id", "body", 20).collect():
        got.setdefault(r.doc_id, []).append((r.nr, r.chunk))
    assert sorted(got.pop(None)) == [(0, "z"), (0, "z")] and len(got) == len(texts)
    for i, text in enumerate(texts):
        chunks = [c for _, c in sorted(got[i])]
        assert "\n".join(chunks) == (text or "")
        # a chunk holds one line or stays within the limit, and could not have taken the next line
        assert all("\n" not in c or len(c) + 1 <= 20 for c in chunks)
        assert all(len(a) + 1 + len(b.split("\n")[0]) + 1 > 20 for a, b in zip(chunks, chunks[1:]))


def test_zip_archives(spark):
    import io
    import zipfile

    from quarry.sources import files

    def packed(*names):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in names:
                z.writestr(n, n)
        return out.getvalue()

    cases = {"a.zip": packed("SKILL.md", "d/", "d/x.py"), "b.zip": packed("d/SKILL.md"), "c.zip": packed("SKILL.md", "lib.dylib"), "d.zip": packed("SKILL.md", "RUN.EXE", "run.sh"), "e.tar": packed("SKILL.md"), "f.zip": b"", "g.zip": b"no zip", "h.zip": packed()}
    got = {}
    for r in files.read_zip_members(spark.createDataFrame(list(cases.items()), "path string, content binary")).collect():
        got.setdefault(r.archive, []).append(r.problem or (r.member, bytes(r.content).decode()))
    same = lambda *names: [(n, n) for n in names]
    assert got == {"a.zip": same("SKILL.md", "d/x.py"), "b.zip": ["no SKILL.md"], "c.zip": ["executable: lib.dylib"], "d.zip": same("SKILL.md", "RUN.EXE", "run.sh"), "e.tar": ["not named .zip"], "f.zip": ["empty"], "g.zip": ["not a zip file"], "h.zip": ["no SKILL.md"]}


def test_extraction_payloads(spark):
    from quarry.operators import extraction

    kind = "chunk_id string, node_set string, nodes array<struct<id:string,name:string,type:string,description:string>>, edges array<struct<source:string,target:string,type:string>>"
    nodes = [("1", "A", "t", " \n"), ("2", "B", None, " b "), ("3", "", "t", "x"), ("4", None, "t", "x"), ("1", "C", "t", None), ("5", "B", "t", "again")]
    edges = [("1", "2", "r"), ("1", "5", "r"), ("1", "2", "s"), ("2", "5", "r"), ("1", "3", "r"), ("9", "1", "r"), (None, "1", "r"), ("2", "1", None)]
    found, linked = extraction.payloads(spark.createDataFrame([("c", "ns", nodes, edges), ("d", "ns", None, None), ("e", "ns", [], edges)], kind))
    assert sorted((r.chunk_id, r.name, r.entity_type, r.description) for r in found.collect() if r.entity_type) == [("c", "A", "t", "A"), ("c", "B", "t", "again"), ("c", "C", "t", "C")]
    assert found.where("entity_type IS NULL").select("description").first()[0] == "b" and found.count() == 4
    assert sorted(((r.source_name, r.relationship_type, r.target_name) for r in linked.collect()), key=repr) == sorted([("C", "r", "B"), ("C", "s", "B"), ("B", None, "C")], key=repr)
    ids = {r.name: r.entity_id for r in found.collect()}
    assert all((r.source_id, r.target_id) == (ids[r.source_name], ids[r.target_name]) for r in linked.collect())


def test_stored_text(spark):
    from quarry.functions import text

    rows = ["e\u0301\x00\x07\t\n", None, "", "\x7fplain", "\u1100\u1161"]
    got = spark.createDataFrame([(r,) for r in rows], "s string").select(text.stored_text(F.col("s"))).collect()
    assert [r[0] for r in got] == ["\u00e9\t\n", None, "", "plain", "\uac00"]
