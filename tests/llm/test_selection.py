"""Resampling, centroids and secrets: brute force and edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarry.llm import centroids, resampling, secrets
from quarry.llm.common import table

from .test_operators import ODD, SF

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_features(text, buckets=10_000):
    w = WORDS.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return len(w), Counter(zlib.crc32(f.encode()) % buckets for f in [*w, *[f"{a} {b}" for a, b in zip(w, w[1:])]])


def brute_resample(docs, target):
    own, want = [(i, *brute_features(t)) for i, t in docs], [brute_features(t)[1] for t in target]
    s, t = sum((c for _, _, c in own), Counter()), sum(want, Counter())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in s}
    rows = []
    for i, n, c in own:
        weight = sum(gain[b] * k for b, k in c.items()) // c.total() if c else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {id(r): k for k, r in enumerate(fit[: 25 * len(fit) // 100], 1)}
    return [(*r, ranks.get(id(r))) for r in rows]


@pytest.mark.parametrize("chunk", [7, 200, 1 << 20])
def test_resampling_against_brute_force(spark, chunk):
    rng = random.Random(chunk)
    vocabulary = ["a", "Be", "naïve", "日本", "x" * 60, "y" * 130, "0", "1984", "end."]
    docs = [(i, "".join(rng.choice(vocabulary) + rng.choice([" ", "\n", " - ", "\u0085"]) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    docs += [(5, "a b " * 30), (5, "a b " * 30), (None, "q " * 40), (None, "q " * 40), (300, None), (301, ""), (302, "!?"), (303, "é" * 900), (304, "one")]
    target = ["a Be naïve", None, "日本 1984 end"]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("n_words", F.lit("own")).withColumn("a.b", F.lit(1))
    got = resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), chunk=chunk).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(brute_resample(docs, target), key=repr)


def test_resampling_blocks_stay_small(spark, monkeypatch):
    import pyarrow.parquet as pq

    rng = random.Random(11)
    docs = [(i, " ".join(f"{rng.getrandbits(20):x}" for _ in range(rng.choice([0, 5, 400, 9000])))) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(1)
    paths = []
    monkeypatch.setattr(resampling, "written", lambda d, f=resampling.written, **options: paths.append((out := f(d, **options))[1]) or out)
    got = resampling.resample(df, spark.createDataFrame([("a b",)], "text string")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(brute_resample(docs, ["a b"]), key=repr)
    files = list(Path(paths[0].removeprefix("file:")).glob("*.parquet"))
    blocks = [r for f in files for r in pq.read_table(f, columns=["ids", "indptr"]).to_pylist()]
    assert sorted(i for r in blocks for i in r["ids"]) == list(range(400))
    # a row of the matrix is a few thousand entries, or one document; a task that has written many holds few of them at once
    assert max(r["indptr"][-1] for r in blocks if len(r["ids"]) > 1) <= 1 << 13 and max(r["indptr"][-1] for r in blocks) <= 10_000
    groups = [m.row_group(i) for f in files for m in [pq.ParquetFile(f).metadata] for i in range(m.num_row_groups)]
    assert len(groups) > 1 and max(g.total_byte_size for g in groups) < 8 << 20


def test_resampling_counts_of_any_width(spark):
    docs = [(1, "a " * 70_000), (2, "a " * 300), (3, "a"), (4, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(1)
    for buckets in (1, 200, 60_000, 100_000):
        rows = {r.id: r for r in resampling.resample(df, df.where("doc_id = 3"), min_words=1, percent=100, buckets=buckets).collect()}
        s, t = Counter(), Counter()
        for i, text in docs:
            for c, k in brute_features(text, buckets)[1].items():
                s[c], t[c] = s[c] + k, t[c] + k * (i == 3)
        gain = {c: math.floor(1000 * math.log((t[c] + 1) * (s.total() + buckets) / ((s[c] + 1) * (t.total() + buckets)))) for c in s}
        for i, text in docs:
            own = brute_features(text, buckets)[1]
            assert (rows[i].n_features, rows[i].weight) == (own.total(), sum(gain[c] * k for c, k in own.items()) // max(own.total(), 1))


def test_resampling_of_nothing(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, source string").withColumn("a.b", F.lit("own")).withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    none = spark.createDataFrame([], "text string")
    assert sorted((tuple(r) for r in resampling.resample(df, none).collect()), key=repr) == sorted(brute_resample([(i, t) for i, t, _ in ODD], []), key=repr)
    assert resampling.resample(df.limit(0), df).collect() == []
    drawn = resampling.resampled(df, none, min_words=1, percent=100)
    assert drawn.columns == df.columns and sorted(str(r.doc_id) for r in drawn.collect()) == sorted(str(i) for i, t, _ in ODD if brute_features(t)[0])


def brute_kmeans(rows, k=8, rounds=10, dim=64):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    cs = [v for i, v in sorted((r for r in kept if r[0] is not None), key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        cs = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if j in groups else c for j, c in enumerate(cs)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=repr), cs


@pytest.mark.parametrize("case", ["plain", "ties", "few", "copies", "huge"])
def test_centroids_against_brute_force(spark, case):
    rng = random.Random(4)
    make = {"plain": lambda: rng.gauss(0, 1), "ties": lambda: float(rng.choice([0, 0, 0, 1])), "few": lambda: rng.random(), "copies": lambda: 0.5, "huge": lambda: rng.gauss(0, 5e4)}[case]
    n, dim = {"few": (3, 64), "ties": (300, 4), "huge": (60, 4)}.get(case, (200, 64))
    rows = [(i, [make() for _ in range(dim)]) for i in range(n)]
    rows += [(None, [0.25] * dim), (1, [0.5] * dim), (1, [0.5] * dim), (7000, None), (7001, []), (7002, [1.0] * (dim - 1)), (7003, [float("nan")] + [0.0] * (dim - 1)), (7004, [None] + [0.0] * (dim - 1)), (7005, [float("-inf")] * dim), (7006, [0.0] * dim)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("a.b", F.lit(1)).withColumn("cluster", F.lit("own")).repartition(3)
    got, cs = centroids.kmeans(df, dim=dim, block=32)
    want, centres = brute_kmeans(rows, dim=dim)
    assert cs == centres and sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert centroids.kmeans(df.limit(0), dim=dim)[0].collect() == [] and spark.catalog.listTables() == []


def test_centroids_scan_less_than_all(spark):
    """Bounds hold back most of the work on separate groups, with the assignments of a full scan."""
    import numpy as np

    rng = np.random.default_rng(2)
    vecs = np.concatenate([rng.integers(-50, 50, (100, 8)) + 2000 * j for j in range(6)])
    c = centroids.Centroids([(np.zeros(8, int) + 2000 * j).tolist() for j in range(6)])
    state = centroids.assigned(vecs, c)[:3]
    moved = centroids.Centroids([[x + 3 for x in row] for row in c.rows], c)
    a, u, low, looked = centroids.assigned(vecs, moved, state)
    full = centroids.distances(vecs, moved.rows)
    assert len(looked) == 0 and a.tolist() == full.argmin(1).tolist() and (u * u >= full.min(1)).all()


SECRET = 'k: {"api_key": "abcdefghijkl.mnop"}; PASSWORD=short token : \'aaaaaaaaaaaa\' AKIA12345678901234 AKIA123 deadbeefdeadbeef0 deadbeef'


def brute_base(text):
    pattern = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end()) for m in pattern.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def test_secrets_known_forms(spark):
    texts = [SECRET, None, "", "日本 😀 " + SECRET + SECRET, "password=secret:abcdefghijklmnop", "a" * 5000, "ſecret=abcdefghijklmnop paſsword=abcdefghijklmnop", "API_KEY==abcdefghijkl=" * 3, "tokenAKIA" + "9" * 20]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("a.b", F.lit("x")).withColumn("Spans", F.lit("own")).withColumn("base", F.lit("mine")).withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    found = secrets.find_secrets(df)
    assert found.columns == ["doc_id", "text", "a.b", "base", "m", "spans"]
    got = {r.doc_id: [tuple(s) for s in r.spans if s.kind < 3] for r in found.collect()}
    assert got == {i: brute_base(t or "") for i, t in enumerate(texts)}
    assert secrets.find_secrets(df.limit(0)).collect() == []
    docs = table(spark, SF, "documents")
    want = {r.doc_id: brute_base(r.text or "") for r in docs.collect()}
    for r in secrets.op13_secrets(spark, SF).collect():
        said = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in want[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in want[r.doc_id]) for j in range(3)]


def test_secrets_random_tokens(spark):
    """Random keys of several encodings among ordinary text and names are found; names, words, dates and paths are not."""
    rng = random.Random(8)
    plain = ["getElementByIdAndReturnValue", "2021-03-04T05-06-07", "user123_name456-v2", "https/en/some-long-path-name", "Unaitionmentelle", "ABCDEFGHIJKLMNOP12345678", "123e4567-E89B-12d3-A456-426614174000", "0123456789ABCDEF", "4041894974608795", "internationalizationprocess"]
    sentence = "the quick brown fox jumps over the lazy dog and runs on through the evening rain "
    keys = ["".join(rng.choice(secrets.ENCODINGS[e]) for _ in range(n)) for e in ("base62", "base64", "base64url") for n in (24, 32, 48, 64) for _ in range(5)]
    keys += ["".join(rng.choice(secrets.ENCODINGS["HEX"]) for _ in range(n)) for n in (40, 64) for _ in range(5)]
    rows = [(i, sentence * 30 + k + " " + sentence) for i, k in enumerate(keys)] + [(1000 + i, sentence * 30 + p + " " + sentence) for i, p in enumerate(plain)]
    rows += [(2000 + i, rows[0][1]) for i in range(20)]  # copies of one key are one test
    found = {r.doc_id: [r.text[s.start : s.end] for s in r.spans if s.kind == 3] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[1000 + i] == [] for i in range(len(plain)))
    assert sum(found[i] == [k] for i, k in enumerate(keys)) >= 0.9 * len(keys)
    assert all(found[2000 + i] == found[0] for i in range(20))


def test_false_discovery_control():
    assert secrets.least_steps({1: {0: 990, 80: 10}, 2: {0: 999_999, 40: 1}, 3: {0: 5}}, 0.01) == {1: 80}
    assert secrets.least_steps({1: {0: 10, 28: 1000}}, 0.01) == {1: 28}
