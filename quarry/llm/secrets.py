r"""Secret scans: known forms, and tokens that a battery of randomness tests takes for keys.

Method: known forms (assignments, access keys, long hexadecimal runs) are found by pattern, leftmost and non-overlapping per
kind.  Other runs of MIN_LENGTH or more of [A-Za-z0-9+/_-] (padding = at the end stays out of the tests) with characters of two classes (upper, lower, digit, sign) are
tested.  The encoding is inferred as the smallest alphabet that holds the token (hexadecimal, base 32, base 36, base 62,
base 64, either case where there is one).  Against a uniform choice from that alphabet: chi-squared of the symbols and of
the classes, runs above and below the middle symbol and of classes, and serial correlation of neighbours.  A token that one of them
rejects (Bonferroni, at ALPHA) is no key.  For the others the null hypothesis is ordinary text: symbols and changes of
class occur as often as in all texts of the table.  Its p value is twice the smaller of that of so many changes of class
(binomial) and of so few coincidences of symbols.

False discoveries are controlled at RATE among distinct tokens by Benjamini-Hochberg, apart for each encoding and each
doubling of length, as short tokens say little: many of them can't hide, or be carried by, a few long ones.  p values are rounded up to
quarter powers of two, so the control needs a histogram only: (group, step) counts, bounded, are all that the driver sees.
Copies of a token are one test: digests are made distinct before they are counted.

Defined results: offsets are code points; a null or empty text has no spans; a text is scanned whole whatever its length;
found tokens that touch a known form are not named again; repeated rows are scanned each; an empty table gives an empty
table; columns named like a result are replaced.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Own, arrow_batches, lean, table, written

MIN_LENGTH = 16
ALPHA, RATE = 0.01, 0.001
#: Quarter powers of two that p values are told apart by, at most.
STEPS = 4096
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 12, "access": 18, "hex": 16}

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(rf"[0-9a-f]{{{LEAST['hex']},}}")
_TOKEN = re.compile(rf"[A-Za-z0-9+/_-]{{{MIN_LENGTH},}}={{0,2}}")

_LOW, _UP, _DIGIT, _SIGN = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/-_"
#: Alphabets from small to large, in the order of their symbols' values.
ENCODINGS = {
    "hex": _DIGIT + _LOW[:6], "HEX": _DIGIT + _UP[:6], "base32": _UP + _DIGIT[2:8], "base36": _DIGIT + _LOW, "BASE36": _DIGIT + _UP,
    "base62": _UP + _LOW + _DIGIT, "base64": _UP + _LOW + _DIGIT + "+/", "base64url": _UP + _LOW + _DIGIT + "-_", "signs": _UP + _LOW + _DIGIT + _SIGN,
}
_SETS = {name: frozenset(letters) for name, letters in ENCODINGS.items()}
_CLASS = {c: i for i, group in enumerate((_LOW, _UP, _DIGIT, _SIGN)) for c in group}
_GROUPS = list(ENCODINGS)
_LENGTHS = 8


def runs_of(text: str) -> list[re.Match]:
    """The runs that tokens and hexadecimal numbers lie in."""
    return list(_TOKEN.finditer(text))


def known_forms(text: str, runs: list[re.Match]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the known forms."""
    found = []
    low = text.lower()
    if any(word in low for word in _NAMES):  # the pattern is slow on texts without any
        found += [(0, *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(1, *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    return found + [(2, *m.span()) for r in runs for m in _HEX.finditer(text, *r.span())]


def inferred(token: str) -> str | None:
    """The smallest alphabet that holds the token; none for tokens of one class, which may be words or numbers."""
    letters = frozenset(token)
    if len({_CLASS[c] for c in letters}) < 2:
        return None
    return next((name for name, own in _SETS.items() if letters <= own), None)


def _normal(z: float) -> float:
    """P(Z > z)."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi2(x: float, df: int) -> float:
    """Upper tail of chi-squared for 1 to 3 degrees of freedom."""
    if df == 2:
        return math.exp(-x / 2)
    tail = math.erfc(math.sqrt(x / 2))
    return tail if df == 1 else tail + math.sqrt(2 * x / math.pi) * math.exp(-x / 2)


def _shares(name: str) -> list[float]:
    """The classes' shares of an alphabet, those it has."""
    letters = ENCODINGS[name]
    counts = [sum(_CLASS[c] == k for c in letters) for k in range(4)]
    return [c / len(letters) for c in counts]


def battery(token: str, name: str) -> dict[str, float]:
    """p values under a uniform choice from the alphabet."""
    import numpy as np

    letters = ENCODINGS[name]
    m, n = len(letters), len(token)
    table = np.zeros(128, np.int64)
    table[[ord(c) for c in letters]] = np.arange(m)
    v = table[np.frombuffer(token.encode("ascii"), np.uint8)]
    counts = np.bincount(v, minlength=m)
    x2 = float((counts * counts).sum()) * m / n - n
    out = {"symbols": _normal((x2 - (m - 1)) / math.sqrt(2 * (m - 1) * (1 - 1 / n)))}
    classes = np.array([_CLASS[c] for c in letters])
    q = _shares(name)
    seen = np.bincount(classes, counts, 4)
    has = [k for k in range(4) if q[k]]
    out["classes"] = _chi2(sum(float((seen[k] - n * q[k]) ** 2 / (n * q[k])) for k in has), len(has) - 1)
    q2, q3 = sum(x**2 for x in q), sum(x**3 for x in q)
    changes = int((np.diff(classes[v]) != 0).sum())
    spread = (n - 1) * q2 * (1 - q2) + 2 * (n - 2) * (q3 - q2 * q2)
    out["class_runs"] = 2 * _normal(abs(changes - (n - 1) * (1 - q2)) / math.sqrt(spread))
    above = v >= m / 2
    a = int(above.sum())
    b = n - a
    if a == 0 or b == 0:
        out["runs"] = min(1.0, 2.0 ** (2 - min(n, 1000)))
    else:
        runs, mean = 1 + int((above[1:] != above[:-1]).sum()), 1 + 2 * a * b / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        out["runs"] = 2 * _normal(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    d = v - v.mean()
    whole = float((d * d).sum())
    r = float((d[1:] * d[:-1]).sum()) / whole if whole else 1.0
    out["serial"] = 2 * _normal(abs(r + 1 / n) * math.sqrt(n)) if whole else 0.0
    return out


def _log2_binomial_tail(n: int, k: int, p: float) -> float:
    """log2 of P(X >= k) for a binomial X."""
    if k <= 0:
        return 0.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, min(n, k + 200) + 1)]
    top = max(logs)
    return min(0.0, (top + math.log(sum(math.exp(x - top) for x in logs))) / math.log(2))


def _log2_normal(z: float) -> float:
    """log2 of P(Z > z), by its bound where it underflows."""
    p = _normal(z)
    return math.log2(p) if p > 1e-300 else -(z * z) / 2 / math.log(2)


def ordinary(token: str, name: str, text: dict) -> float:
    """-log2 of the p value under ordinary text."""
    shares, change = text[name]
    n = len(token)
    classes = [_CLASS[c] for c in token]
    rare = _log2_binomial_tail(n - 1, sum(x != y for x, y in zip(classes, classes[1:])), change)
    counts = [token.count(c) for c in set(token)]
    pairs = n * (n - 1)
    same = sum(c * (c - 1) for c in counts) / pairs
    k2, k3 = sum(x**2 for x in shares), sum(x**3 for x in shares)
    var = 4 * (n - 2) / pairs * (k3 - k2 * k2) + 2 / pairs * (k2 - k2 * k2)
    few = _log2_normal((k2 - same) / math.sqrt(var)) if var > 0 else 0.0
    return max(0.0, -1 - min(rare, few))


def step_of(token: str, name: str, text: dict, alpha: float = ALPHA) -> int:
    """The p value in quarter powers of two, rounded up; 0 where the battery rejects the token."""
    p = battery(token, name).values()
    if min(p) * len(p) < alpha:
        return 0
    return min(int(4 * ordinary(token, name, text)), STEPS)


def group_of(length: int, name: str) -> int:
    return _GROUPS.index(name) * _LENGTHS + min(int(math.log2(length / MIN_LENGTH)), _LENGTHS - 1)


def _byte_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts of bytes (below 256) and of pairs of classes within runs (from 256 on)."""
    import numpy as np

    lean()
    kind = np.full(256, 4, np.uint8)
    for c, k in _CLASS.items():
        kind[ord(c)] = k
    total = np.zeros(256 + 25, np.int64)
    for b in batches:
        col = b.column(0)
        if col.buffers()[2] is None:
            continue
        cuts = np.frombuffer(col.buffers()[1], np.int32 if pa.types.is_binary(col.type) else np.int64)[col.offset : col.offset + len(col) + 1]
        data = np.frombuffer(col.buffers()[2], np.uint8)[cuts[0] : cuts[-1]]
        for at in range(0, len(data), 1 << 20):
            part = data[at : at + (1 << 20) + 1]
            total[:256] += np.bincount(part[: 1 << 20], minlength=256)
            k = kind[part]
            total[256:] += np.bincount(k[:-1] * 5 + k[1:], minlength=25)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["at", "n"])


def ordinary_text(docs: DataFrame, text: str = "text") -> dict[str, tuple[list[float], float]]:
    """For each encoding the shares of its symbols, and how often the class changes, in all texts."""
    counts = docs.select(F.col(f"`{text}`").cast("binary")).mapInArrow(_byte_counts, "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))
    n = {r["at"]: r["n"] for r in counts.collect()}  # at most 281 rows
    pair = {(i, j): n.get(256 + 5 * i + j, 0) for i in range(4) for j in range(4)}
    change = (sum(x for (i, j), x in pair.items() if i != j) + 1) / (sum(pair.values()) + 2)
    own = {name: [n.get(ord(c), 0) + 1 for c in letters] for name, letters in ENCODINGS.items()}
    return {name: ([x / sum(c) for x in c], change) for name, c in own.items()}


def tested(runs: list[re.Match], model: dict, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(start, end, group, step, digest) of the tokens that touch no known form."""
    out = []
    spans = sorted((s, e) for _, s, e in base)
    for m in runs:
        whole = m.group()
        token = whole.rstrip("=")
        name = inferred(token) if len(token) >= MIN_LENGTH else None
        if name is None or any(s < m.end() and m.start() < e for s, e in spans):
            continue
        digest = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little", signed=True)
        out.append((m.start(), m.end(), group_of(len(token), name), step_of(token, name, model), digest))
    return out


def _scanned(model: dict):
    base_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    token_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("group", pa.int32()), ("step", pa.int32()), ("digest", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            base, tokens = [], []
            for text in b.column(0):
                text = text.as_py() or ""
                runs = runs_of(text)
                found = known_forms(text, runs)
                base.append([{"start": s, "kind": k, "end": e} for k, s, e in found])
                tokens.append([dict(zip(("start", "end", "group", "step", "digest"), t)) for t in tested(runs, model, found)])
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(base, base_type), pa.array(tokens, token_type)], names=[*b.schema.names[1:], "base", "tokens"])

    return run


def least_steps(counts: dict[int, dict[int, int]], rate: float = RATE) -> dict[int, int]:
    """Benjamini-Hochberg by group from counts of distinct tokens by step: the least step that is a discovery."""
    out = {}
    for group, by_step in counts.items():
        whole, upto, least = sum(by_step.values()), 0, None
        for step in sorted(by_step, reverse=True):
            upto += by_step[step]
            if step and 2.0 ** (-step / 4) <= rate * upto / whole:
                least = step
        if least is not None:
            out[group] = least
    return out


def find_secrets(docs: DataFrame, text: str = "text", keep: list[str] | None = None, rate: float = RATE) -> DataFrame:
    """docs' columns (or those in keep) with spans: array of (start, kind, end), by start and then in the order of KINDS."""
    own = Own(docs, keep, ["spans"])
    with arrow_batches(docs.sparkSession):
        model = ordinary_text(docs, text)
    rows = own.rows.select(own.at(text).alias("text"), *own.columns)
    base = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("start", "kind", "end")]))
    tokens = T.ArrayType(T.StructType([*[T.StructField(c, T.IntegerType()) for c in ("start", "end", "group", "step")], T.StructField("digest", T.LongType())]))
    schema = T.StructType([*rows.schema[1:], T.StructField("base", base), T.StructField("tokens", tokens)])
    with arrow_batches(docs.sparkSession):
        scanned, _ = written(rows.mapInArrow(_scanned(model), schema))
    each = scanned.where(F.size("tokens") > 0).select(F.explode("tokens").alias("t")).select("t.group", "t.step", "t.digest").distinct()
    counts: dict[int, dict[int, int]] = {}
    for r in each.groupBy("group", "step").agg(F.count("*").alias("n")).collect():  # at most groups * STEPS rows
        counts.setdefault(r["group"], {})[r["step"]] = r["n"]
    least = least_steps(counts, rate)
    steps = F.array(*[F.lit(least.get(g, STEPS + 1)) for g in range(len(_GROUPS) * _LENGTHS)])
    added = F.transform(F.filter("tokens", lambda t: t["step"] >= F.get(steps, t["group"])), lambda t: F.struct(t["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), t["end"].alias("end")))
    spans = F.array_sort(F.concat("base", added))
    return own.restored(scanned, spans.alias("spans"))


def spans_text(spans) -> F.Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document."""
    found = find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    base = spans_text(F.filter("spans", lambda s: s["kind"] < KINDS.index("random")))
    return found.select("doc_id", *[count(k) for k in range(3)], F.sha2(base, 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))
