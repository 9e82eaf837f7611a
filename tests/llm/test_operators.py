"""The training-data operators: brute force, round trips and edge cases."""

import hashlib
import struct

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.llm import annsearch, bpe, chat, common, exactsearch, mixing, registry, simhash, tokenscan, toxicity, urls, warc

SF = "/root/testdata/sf0.001"
ODD = [(1, None, "a"), (2, "", None), (None, "x y z", None), (7, "X Y z", "b"), (7, "X Y z", "b"), (9, "=" * 3000, "b"), (10, "日本 😀 it's   \u0085 x\n\n </turn> <\\turn:", "b")]


@pytest.fixture(scope="module")
def odd(spark):
    clash = ("size", "fp", "h", "ids", "score", "copies", "component_id")
    return spark.createDataFrame(ODD, "doc_id long, text string, source string").select("*", *[F.lit("own").alias(c) for c in clash])


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    r = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    assert sorted((tuple(x[c] for c in cols) for x in df.collect()), key=repr) == sorted((tuple(x[names.index(c)] for c in cols) for x in r.fetchall()), key=repr)


@pytest.mark.parametrize("hot", [bpe.HOT_WORDS, 50])
def test_bpe_against_the_library(spark, odd, hot):
    import public_tokenizers as P
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    docs = common.table(spark, SF, "documents").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    got = bpe.encode_decode(docs, hot=hot).collect()
    assert len(got) == docs.count()
    for r in got:
        assert list(r.ids) == own.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    digests = bpe.encode_decode(odd, keep=["doc_id", "size"], digests=True, hot=hot).collect()
    want = {hashlib.sha256(struct.pack(f"<{len(i)}I", *i)).hexdigest() for i in (own.encode_ordinary(t or "") for _, t, _ in ODD)}
    assert {r.ids_sha256 for r in digests} == want and len(digests) == len(ODD) and digests[0].size == "own"
    assert bpe.encode_decode(odd.limit(0)).collect() == []


@pytest.mark.parametrize("long", [4, 1 << 30])
def test_bpe_fold_in_parts(spark, long):
    import random

    import public_tokenizers as P

    rng, path = random.Random(5), P.path("byte_bpe_multi_50k.tiktoken")
    ranks, words = bpe.read_ranks(path), ["a" * n for n in range(1, 40)] + ["=" * 300]
    words += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 150))) for letters in ("ab", "etaoin", "theinganro ", "é日a1-=") for _ in range(25)]
    literal, whole = bpe.rank_map(spark, path)
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", literal.alias("r")).select("w", bpe.merged(F.col("w"), F.col("r"), whole, long).alias("ids")).collect()
    for r in rows:
        w = r.w.encode()
        assert list(r.ids) == ([ranks[w]] if w.hex().upper() in whole else [ranks[x] for x in bpe._folded(w, ranks)])


def test_bpe_of_a_very_long_word(spark):
    import random

    import public_tokenizers as P
    import tiktoken

    rng = random.Random(6)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    texts = ["".join(rng.choice("etaoinshrdlu") for _ in range(40_000)), "z" * 20_000]
    got = bpe.encode_decode(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert all(list(r.ids) == own.encode_ordinary(r.text) and bytes(r.decoded) == r.text.encode() for r in got) and len(got) == 2


def fingerprint(text):
    import xxhash

    w = (text or "").encode().lower().split()
    runs = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in runs]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def brute_components(rows):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = [fingerprint(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{f:016x}", least.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps))), key=repr)


def test_simhash_brute_force(spark, odd):
    docs = common.table(spark, SF, "documents").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=repr)
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert len(simhash.near_duplicates(odd).collect()) == len(ODD) and simhash.near_duplicates(odd.limit(0)).collect() == []


def test_components_of_a_chain_and_a_star(spark):
    e = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = dict(map(tuple, common.components(spark.createDataFrame(e, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(21)}, **{100 + i: 100 for i in range(50)}}


def test_ball_sizes():
    assert len(simhash.ball(1)) == 65 and len(set(simhash.ball(2))) == 1 + 64 + 64 * 63 // 2
    with pytest.raises(ValueError):
        simhash.links(None, 3)


def test_mixing(spark, odd):
    docs = common.table(spark, SF, "documents")
    cols = ["doc_id", "source", "size", "source_size", "target", "copies", "taken"]
    got = mixing.mix(docs).select(*cols).collect()
    for again in (docs, docs.repartition(7)):
        assert sorted(got) == sorted(mixing.mix(again).select(*cols).collect())
    assert all(0 <= r.copies <= 3 and r.taken == r.copies * r.size for r in got)
    targets = {r.source: (r.source_size, r.target) for r in got}
    assert sum(t for _, t in targets.values()) == pytest.approx(sum(s for s, _ in targets.values()))
    edge = mixing.mix(odd).collect()
    assert len(edge) == len(ODD) and {r.size for r in edge if r.text in (None, "")} == {0} and edge[0].fp == "own" and mixing.mix(odd.limit(0)).collect() == []


def test_water_filling_caps(spark):
    s = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 5), (None, 0)], "source string, words long")
    got = {r.source: r.target for r in mixing.source_targets(s).collect()}
    assert got["a"] == 30 and got["c"] == 15 and got[None] == 0 and got["b"] == pytest.approx(970)


def test_toxicity_counterfactual(spark):
    bad, good = "you idiot {} are scum and trash number {}", "lovely quiet dinner with friends and music number {}"
    rows, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        rows.append((i, bad.format("muslims", i) if toxic else good.format(i)))
        labels.append((i, int(toxic)))
    neutral = [(5000, "muslims gathered here"), (5001, None), (5002, ""), (5002, "")]
    docs, known = spark.createDataFrame(rows + neutral, "doc_id long, text string").withColumn("score", F.lit("own")), spark.createDataFrame(labels, "doc_id long, toxic int")
    free, held = ({r.doc_id: r for r in toxicity.score(docs, known, penalty=p).collect()} for p in (0.0, 30.0))
    assert held[5000].score < 0.6 * free[5000].score and held[5000].predicted == 0
    assert all(held[i].predicted == int(i % 3 == 0) for i in range(600))
    assert len(toxicity.score(docs, known.limit(0)).collect()) == len(rows) + 4 and toxicity.score(docs.limit(0), known).collect() == []


def test_swaps():
    assert toxicity.swapped("Women came. The men left. No one else.", (("women", "men"),)) == ["Women came. The women left. No one else.", "men came. The men left. No one else."]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("own"))


def test_exact_search_edges(spark):
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [-1.0, 0.0]), (7, [1.0, 2.0, 3.0]), (6, [-1.0, 0.0]), (None, [1.0, 1.0])]
    got = [tuple(r) for r in exactsearch.top_inner_products(vectors(spark, rows), every=100).orderBy("rank").collect()]
    s = 1024 * 1024 + 512 * 512
    assert got == [(0, 1, 1, s), (0, 2, 2, s), (0, 3, 6, -1024 * 1024), (0, 4, 6, -1024 * 1024)]
    assert exactsearch.top_inner_products(vectors(spark, rows).limit(0)).collect() == []


def test_exact_search_brute_force_over_many_shards(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.round(rng.standard_normal((600, 8)), 2)
    x[100:300] = x[100]
    got = sorted(map(tuple, exactsearch.top_inner_products(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)]), every=20, shard_rows=70, query_rows=7).collect()))
    ints = np.floor(1024 * x.astype(np.float32).astype(float)).astype(int)
    want = []
    for q in range(0, 600, 20):
        s = ints @ ints[q]
        best = [i for i in np.lexsort((np.arange(600), -s)) if i != q][:10]
        want += [(q, r + 1, i, s[i]) for r, i in enumerate(best)]
    assert got == sorted(want)


def test_exact_search_sends_no_trees_or_blocks_through_the_driver(spark):
    import re

    import numpy as np

    x = np.random.default_rng(2).standard_normal((900, 8))
    found = exactsearch.top_inner_products(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)]), every=3, shard_rows=9, query_rows=7)
    plan = found._jdf.queryExecution().optimizedPlan().toString() + found._jdf.queryExecution().executedPlan().toString()
    for at in re.finditer("BroadcastExchange", plan):
        line = plan.rfind("\n", 0, at.start()) + 1
        below = plan[at.end() :].split("\n")[1:]
        deeper = [x for n, x in enumerate(below) if all(len(re.match(r"[ :+-]*", y)[0]) > at.start() - line for y in below[: n + 1])]
        assert not re.search("tree|queries|explode", "\n".join(deeper))


def test_exact_search_beyond_what_floats_hold(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = (rng.integers(-3, 4, (400, 5)) * 10.0 ** rng.integers(0, 6, (400, 1))).astype(np.float32)
    ints = [[int(np.floor(1024 * float(c))) for c in v] for v in x]
    got = sorted(map(tuple, exactsearch.top_inner_products(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)]), every=10, shard_rows=30, query_rows=9).collect()))
    want = []
    for q in range(0, 400, 10):
        s = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in enumerate(ints) if i != q)[:10]
        want += [(q, r + 1, i, -n) for r, (n, i) in enumerate(s)]
    assert got == sorted(want) and max(w[3] for w in want) > 2**53


def test_exact_search_where_shards_lack_a_length(spark):
    long, short = [(i, [float(i % 7), 1.0]) for i in range(200)], [(1000, [1.0, 2.0, 3.0]), (1001, [0.5, 0.0, 0.0]), (1100, [1.0, 0.0, 0.0])]
    got = exactsearch.top_inner_products(vectors(spark, long + short), every=100, shard_rows=9, query_rows=1).collect()
    s = 1024 * 1024
    assert sorted((r.query_id, r.vec_id, r.score) for r in got if r.query_id >= 1000) == [(1000, 1001, s // 2), (1000, 1100, s), (1100, 1000, s), (1100, 1001, s // 2)]
    for q in (0, 100):
        want = sorted((-(q % 7 * (i % 7) + 1) * s, i) for i in range(200) if i != q)[:10]
        assert [(-r.score, r.vec_id) for r in sorted(got) if r.query_id == q] == want


def test_ann_recall(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = (rng.standard_normal((30, 16))[rng.integers(0, 30, 2000)] + 0.3 * rng.standard_normal((2000, 16))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(20_000, [0.0] * 16), (20_020, None)]
    got = {}
    for r in annsearch.nearest(vectors(spark, rows), sample=1000, shard_rows=100).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    x = x.astype(float)
    hits = sum(len(got[q] & set([i for i in np.argsort(-(x @ x[q]), kind="stable") if i != q][:20])) for q in range(0, 2000, 20))
    assert hits / (20 * 100) >= 0.9 and set(got) == set(range(0, 2000, 20))
    assert annsearch.nearest(vectors(spark, rows).limit(0)).collect() == []


def test_ann_of_one_part_is_exact(spark):
    """Ranks, scores and ties, with repeated rows, another length and fewer candidates than asked for."""
    import numpy as np

    rng = np.random.default_rng(4)
    x = np.round(rng.standard_normal((60, 4)), 1).astype(np.float32)
    x[10:25] = x[10]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(33, x[33].tolist()), (40, x[40].tolist()), (100, [1.0, 2.0]), (101, [3.0, 1.0])]
    got = sorted(map(tuple, annsearch.nearest(vectors(spark, rows), shard_rows=7, query_rows=1).collect()))
    want = []
    for q in (0, 20, 40, 100):
        own = next(v for i, v in rows if i == q)
        scores = [(sum(float(a) * float(b) for a, b in zip(v, own)), i) for i, v in rows if i != q and len(v) == len(own)]
        want += [(q, r, i, s) for r, (s, i) in enumerate(sorted(scores, key=lambda t: (-t[0], t[1]))[:20], 1)]
    assert [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-12)


def test_chat_windows(spark):
    text = "word " * 150
    rows = [(1, 0, "system", "be <turn: good"), *[(1, i, ("user", "assistant")[i % 2], text + str(i)) for i in range(1, 12)], (None, None, None, None), (2, 1, "assistant", "long " * 2000), (2, 2, "assistant", "<\\\\/turn></turn>\n\\"), (2, 2, "assistant", "a")]
    made = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("own"))).cache()
    back = sorted(chat.read_back(made).collect(), key=lambda r: (r.conv_id or -1, r.window))
    said = {c: [(t.role, t.text) for r in back if r.conv_id == c for t in r.turns] for c in (1, 2, None)}
    assert said[1] == [(r[2], r[3]) for r in rows[:12]] and said[None] == [("", "")]
    assert said[2] == [("assistant", "long " * 2000), ("assistant", "<\\\\/turn></turn>\n\\"), ("assistant", "a")]
    assert [x for r in back if r.conv_id == 1 for x in r.learned] == [r[3] for r in rows[:12] if r[2] == "assistant"]
    windows = [r for r in made.collect() if r.conv_id == 1]
    assert len(windows) > 2 and all(r.text.startswith("<turn:system>") for r in windows)
    assert chat.windows(made.limit(0).select("conv_id", F.lit(1).alias("turn"), F.lit("").alias("role"), "text")).collect() == []


@pytest.mark.parametrize("budget, history, system", [(200, 40, 20), (120, 60, 20)])
def test_chat_brute_force_over_many_blocks(spark, budget, history, system):
    import random

    rng, span = random.Random(3), (budget - history - system) // 2
    rows = [(c, t, "system" if t == 0 and c else rng.choice(["user", "assistant"]), " ".join(f"{c}.{t}" for _ in range(rng.choice([0, 1, 4, 9, 30, 2 * span])))) for c, n in ((1, 1500), (2, 257), (None, 600), (3, 1)) for t in range(n)]
    made = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=budget, history=history, system=system)
    got = {}
    for r in made.collect():
        got.setdefault(r.conv_id, []).append((r.window, r.n_repeated, r.n_new, r.text))
    for c in (1, 2, None, 3):
        turns, windows, start, large = [], {}, 0, 0
        for pos, (_, _, role, text) in enumerate(x for x in rows if x[0] == c):
            tokens = len(text.split()) + chat.OVERHEAD
            big = int(tokens > span)
            windows.setdefault(start // span + 2 * large + big, []).append(pos)
            turns.append((start, role, f"<turn:{role}>\n{text}</turn>\n"))
            start, large = start + tokens, large + big
        want = []
        for w, own in windows.items():
            first = turns[own[0]][0]
            again = [i for i in range(own[0]) if (i == 0 and turns[0][1] == "system") or first - history <= turns[i][0] < first]
            want.append((w, len(again), len(own), "".join(turns[i][2] for i in again + own)))
        assert sorted(got[c]) == sorted(want)


def test_warc_revisits(spark):
    rows = [
        (1, "response", "http://a.org/x", 10, '"e1"', None, {"ETag": '"e1"', "Date": "d1", "Server": "s"}, "D1"),
        (2, "response", "https://www.a.org/x/", 200_010, '"e2"', "m", {"Date": "d2"}, "D2"),
        (3, "revisit", "http://a.org/x#f", 199_999, 'W/"e1"', None, {"date": "new", "Server": "other"}, None),
        (4, "revisit", "http://a.org/x", 300_000, '"e1"', None, {}, None),
        (5, "revisit", "http://a.org/x", 10, None, None, None, None),
        (6, "revisit", "http://a.org/x", 900_000, None, "m", {}, None),
        (7, "revisit", "http://a.org/x", 900_000, None, None, {}, None),
        (8, "revisit", None, None, None, None, {}, None),
    ]
    r = {x.record_id: x for x in warc.resolve(spark.createDataFrame(rows, "record_id long, kind string, url string, ts long, etag string, last_modified string, headers map<string,string>, digest string")).collect()}
    assert {k: (v.refers_to, v.status, v.digest) for k, v in r.items()} == {3: (1, "resolved", "D1"), 4: (2, "changed", None), 5: (None, "missing", None), 6: (2, "resolved", "D2"), 7: (2, "unchecked", None), 8: (None, "missing", None)}
    assert sorted((e.key, e.value) for e in r[3].headers) == [("ETag", '"e1"'), ("Server", "s"), ("date", "new")]


def test_warc_resolve_clashes_and_empty(spark):
    kind = "record_id long, kind string, url string, ts long, etag string, last_modified string, headers map<string,string>, digest string"
    rows = [(1, "response", "http://a.org/x", 1, "e", None, {}, "D")] + [(2, "revisit", "http://a.org/x", 5, "e", None, None, None)] * 2 + [(3, "revisit", "", 5, "e", None, {"a": "b"}, None), (4, "revisit", "http://a.org/x", None, "e", None, {}, None), (5, None, "http://a.org/x", 9, "e", None, {}, None)]
    df = spark.createDataFrame(rows, kind).select("*", *[F.lit("own").alias(c) for c in ("canon", "status", "blk", "full", "near", "base")])
    got = sorted((r.record_id, r.refers_to, r.status, r.digest) for r in warc.resolve(df).collect() if r.record_id == 2)
    assert got == [(2, 1, "resolved", "D")] * 2
    assert {r.record_id: (r.status, r.refers_to, [tuple(h) for h in r.headers]) for r in warc.resolve(df).collect() if r.record_id > 2} == {3: ("missing", None, [("a", "b")]), 4: ("missing", None, [])}
    assert warc.resolve(df.limit(0)).collect() == []


@pytest.mark.parametrize("batch_bytes", [1, 50, 1 << 24])
def test_warc_files(spark, tmp_path, batch_bytes):
    import gzip

    record = lambda i: f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://a.org/{i}\r\nContent-Length: {i}\r\n\r\n".encode() + b"x" * i + b"\r\n\r\n"
    (tmp_path / "w" / "deep").mkdir(parents=True)
    (tmp_path / "w" / "a.warc").write_bytes(b"".join(map(record, range(5))))
    (tmp_path / "w" / "deep" / "b.warc.gz").write_bytes(b"".join(gzip.compress(record(i)) for i in range(40)))
    (tmp_path / "w" / "empty.warc").write_bytes(b"")
    for path in (f"{tmp_path}/w", f"file://{tmp_path}/w"):
        got = sorted((r.file.rsplit("/", 1)[-1], r.nr, r.headers["warc-target-uri"], bytes(r.body)) for r in warc.read_warc(spark, path, batch_bytes).collect())
        assert got == [(f, i, f"http://a.org/{i}", b"x" * i) for f, n in (("a.warc", 5), ("b.warc.gz", 40)) for i in range(n)]


def test_warc_files_of_a_store_that_only_spark_reads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "known_to_arrow", lambda path: False)
    (tmp_path / "a.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 3)
    (tmp_path / "b.warc").write_bytes(b"")
    got = warc.read_warc(spark, str(tmp_path), 1).collect()
    assert sorted((r.nr, r.headers["warc-type"], bytes(r.body)) for r in got) == [(i, "response", b"abc") for i in range(3)]


def test_urls(spark):
    pages = spark.createDataFrame([(1, "HTTP://WWW.Bad.net/a/?b=1&utm_source=x&a=2#f"), (2, None), (3, "no url"), (4, "http://bad.net/other"), (5, "http://x.example.org/en/12"), (5, "http://x.example.org/en/12"), (6, "http://xorg/"), (7, "http://org?x")], "page_id long, url string").withColumn("rule", F.lit("own"))
    listed = spark.createDataFrame([("https://bad.net/a?a=2&b=1",), (None,), ("",)], "url string")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, listed).collect()), key=repr)
    assert got == [(1, "www.bad.net", "/a/", None, "block"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "bad.net", "/other", None, "allow"), (5, "x.example.org", "/en/12", "example.org/en/1", "block"), (5, "x.example.org", "/en/12", "example.org/en/1", "block"), (6, "xorg", "/", None, "allow"), (7, "org", "", None, "allow")]


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1 << 20])
def test_token_scan(spark, block):
    docs = [[1, 2, 3], [], [4] * 10, [5], []]
    end = tokenscan.END
    flat = [t for d in docs for t in (*d, end)] + [8, 9]
    rows = [("a", struct.pack(f"<{len(flat)}H", *flat)), ("b", b""), ("c", struct.pack("<H", end))]
    got = sorted(map(tuple, tokenscan.scan(spark.createDataFrame(rows, "path string, content binary"), lead=2, block_tokens=block).collect()))
    assert [(p, n, list(x)) for p, _, _, n, x in got] == [("a", 3, [1, 2]), ("a", 0, []), ("a", 10, [4, 4]), ("a", 1, [5]), ("a", 0, []), ("a", 2, [8, 9]), ("c", 0, [])]
    assert [s for p, _, s, _, _ in got if p == "a"] == [0, 4, 5, 16, 18, 19]


def test_token_files(spark, tmp_path):
    docs = [[0, 31999, 125], None, [], list(range(1000))]
    tokenscan.write_flat(spark.createDataFrame([(d,) for d in docs], "t array<int>").coalesce(1), "t", f"{tmp_path}/flat")
    assert sorted(r.n_tokens for r in tokenscan.scan_files(spark, f"{tmp_path}/flat").collect()) == [0, 0, 3, 1000]


def test_token_scan_keeps_ids(spark, tmp_path):
    ids = [None, 0, -1, 5, 31999, 32000, 2**53 + 1, 2**63 - 1, -(2**63), -(2**53) - 1]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    back = df.select("doc_id", tokenscan.id_of_tokens(tokenscan.tokens_of_id(F.col("doc_id"))).alias("back")).collect()
    assert len(back) == len(ids) and all(r.doc_id == r.back for r in back)
    tokenscan.write_flat(df.select(F.concat(tokenscan.tokens_of_id(F.col("doc_id")), F.array_repeat(F.lit(7), 40)).alias("t")).coalesce(1), "t", f"{tmp_path}/flat")
    for block in (3, 1 << 20):  # pieces smaller than a document, and one for all
        got = tokenscan.scan_files(spark, f"{tmp_path}/flat", block_tokens=block).select(tokenscan.id_of_tokens(F.col("lead")).alias("i"), F.col("n_tokens") - tokenscan.LEAD).collect()
        assert sorted(((r[0], r[1]) for r in got), key=repr) == sorted(((i, 40) for i in ids), key=repr)


def test_token_scan_of_odd_files(spark, tmp_path):
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a").write_bytes(struct.pack("<4H", 1, 2, tokenscan.END, 3) + b"x")
    (tmp_path / "files" / "b").write_bytes(b"x")
    (tmp_path / "files" / "c").write_bytes(b"")
    for block in (1, 2, 100):
        got = sorted((r.doc_index, r.start, r.n_tokens, list(r.lead)) for r in tokenscan.scan_files(spark, f"{tmp_path}/files", lead=1, block_tokens=block).collect())
        assert got == [(0, 0, 2, [1]), (1, 3, 1, [3])]


def test_url_filter_grows_with_its_list(spark):
    assert (urls.blocks_for(0), urls.blocks_for(16), urls.blocks_for(1_000_001)) == (1, 1, 62_501)
    listed = spark.range(3000).select(F.concat(F.lit("http://a"), "id", F.lit(".net/x/")).alias("url"))
    pages = spark.range(0, 6000, 1, 3).select(F.col("id").alias("page_id"), F.concat(F.lit("https://www.A"), "id", F.lit(".net/x?utm_source=1")).alias("url"))
    got = {r.page_id: r.verdict for r in urls.judge(pages, listed, rules=()).collect()}
    assert got == {i: "block" if i < 3000 else "allow" for i in range(6000)}
    # a filter whose bits are all set passes everything on, and the exact join still decides
    full = spark.createDataFrame([(0, -1, -1, -1, -1)], "block long, w0 long, w1 long, w2 long, w3 long")
    real, urls.bloom = urls.bloom, lambda *a: full
    wide, urls.PER_BLOCK = urls.PER_BLOCK, 1 << 20
    try:
        assert {r.page_id: r.verdict for r in urls.judge(pages, listed, rules=()).collect()} == got
    finally:
        urls.bloom, urls.PER_BLOCK = real, wide


def test_toxicity_brute_force(spark):
    """Scores recomputed from the learned weights in plain Python, and the fitted weights at a minimum of the loss."""
    import math

    import numpy as np

    docs, labels = common.table(spark, "/root/testdata/sf0.01", "documents"), common.table(spark, "/root/testdata/sf0.01", "labels")
    weights, intercept = toxicity.learned(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.score(docs, labels, keep=["doc_id"]).collect():
        z = intercept + sum(weights.get(f, 0.0) for f in toxicity.features_of(toxicity.words_of(texts[r.doc_id])))
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9) and r.predicted == int(r.score >= 0.7)
    rows = [(1, [0, 1], [[0, 2]]), (1, [0], []), (0, [2], [[0, 2]]), (0, [], []), (1, [1], []), (0, [1, 2], [])]
    strength, penalty, l2 = [1.0, 0.5, 0.8], 0.7, 1e-2

    def loss(v):
        out = 0.0
        for y, x, _ in rows:
            z = sum(v[j] for j in x) + v[3]
            out += np.logaddexp(0, -z if y else z) / len(rows)
        swaps = [sum((1 if j in x else -1) * v[j] for j in s) for _, x, own in rows for s in own]
        return out + penalty * sum(d * d for d in swaps) / len(swaps) + l2 * sum((v[j] / strength[j]) ** 2 for j in range(3))

    w, c = toxicity.fit(rows, strength, penalty, l2, 3000)
    best = loss([*w, c])
    assert c == pytest.approx(math.log(3.5 / 3.5))
    for i in range(3):
        for step in (-0.02, 0.02):
            v = [*w, c]
            v[i] += step
            assert loss(v) > best


def test_toxicity_bounds_rows_and_takes_both_signs(spark):
    rows = [(i, "rude awful words" if i % 2 else "kind gentle words") for i in range(200)] + [(1, "rude awful words")] * 500
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    weights, _ = toxicity.learned(docs, known)
    assert weights["rude"] > 0 > weights["gentle"] and "words" not in weights


def test_pipeline_stages_keep_own_columns(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "a b c", "s", 5, "own"), (2, "d e f g", "t", 6, "own"), (2, "d e f g", "t", 6, "own")], "doc_id long, text string, source string, size int, score string")
    for stage in (corpus_pipeline.reject_toxic, corpus_pipeline.mix_sources):
        for df in (docs, docs.limit(0)):
            out = stage(spark, df, SF)
            assert out.columns == docs.columns and all(r.score == "own" and r["size"] in (5, 6) for r in out.collect())


CLASHING = ("a.b", "__at", "__id", "__key", "__nr", "__block", "__text", "__class", "__source", "own_0", "Score", "SIZE", "rank", "n_Tokens", "Host")


def clashing(df):
    """df with columns whose names operators use, a dotted one and a map."""
    return df.select("*", *[F.lit(f"mine {c}").alias(c) for c in CLASHING], F.create_map(F.lit("k"), F.col(f"`{df.columns[0]}`")).alias("m"))


def mine(rows, results):
    """Whether all clashing columns came back as they were."""
    taken = {r.lower() for r in results}
    names = rows[0].__fields__
    kept = [c for c in CLASHING if c.lower() not in taken]
    return all(r[names.index(c)] == f"mine {c}" for r in rows for c in kept) and all(r[names.index("m")] is not None for r in rows) and [n for n in names if n in results] == list(results)


def test_clashing_columns(spark):
    docs = clashing(spark.createDataFrame([*ODD, *[(100 + i, f"some words of text {i % 3} here", "c") for i in range(9)]], "doc_id long, text string, source string"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(100, 109)], "doc_id long, toxic int")
    n = docs.count()
    for results, df in (
        (["ids", "decoded"], bpe.encode_decode(docs)),
        (["n_tokens", "ids_sha256", "decoded_sha256"], bpe.encode_decode(docs, digests=True)),
        (["held_out", "score", "predicted"], toxicity.score(docs, labels)),
        (["size", "source_size", "target", "copies", "taken"], mixing.mix(docs)),
    ):
        rows = df.collect()
        assert len(rows) == n and mine(rows, results)
        assert sorted((str(r.doc_id), str(r.text)) for r in rows) == sorted((str(r.doc_id), str(r.text)) for r in docs.collect())
    single = simhash.survivors(docs)
    assert single.columns == docs.columns and mine(single.collect(), [])
    pages = clashing(spark.createDataFrame([(1, "https://a.example.org/es/x"), (2, None), (3, "http://b.com/y"), (4, "no url")], "page_id long, url string"))
    listed = spark.createDataFrame([("http://b.com/y",)], "url string")
    rows = urls.judge(pages, listed).collect()
    assert mine(rows, ["host", "path", "rule", "verdict"]) and sorted((r.page_id, r.verdict) for r in rows) == [(1, "block"), (2, "allow"), (3, "block"), (4, "allow")]


def test_many_rules_and_a_shuffled_filter(spark, monkeypatch):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(["http://h5.net/x", "http://s.h5.net/x/y", "http://h2000.net/", "http://q.net/", None, "nothing", "http://listed.net/a", "http://listed.net/b"])], "page_id long, url string")
    rules = [(f"h{i}.net", "/x" if i % 2 else "/", "block" if i % 5 else "allow") for i in range(3000)]
    listed = spark.createDataFrame([("http://listed.net/a",)], "url string")
    want = {0: ("h5.net/x", "allow"), 1: ("h5.net/x", "allow"), 2: ("h2000.net/", "allow"), 3: (None, "allow"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "block"), 7: (None, "allow")}
    for most in (urls.MAX_BROADCAST, 0):
        monkeypatch.setattr(urls, "MAX_BROADCAST", most)
        assert {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, listed, rules=rules).collect()} == want


def test_token_ids_out_of_range(spark, tmp_path):
    bad = spark.createDataFrame([([70000, 1],), ([tokenscan.END, 2],)], "t array<int>")
    with pytest.raises(Exception, match="token ids"):
        tokenscan.write_flat(bad, "t", f"file://{tmp_path}/flat")
