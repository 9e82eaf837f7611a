"""Symbols of a file by name, against comparing one by one."""

import difflib
import random

from quarry.operators import symbols


def one_by_one(wanted, own):
    if wanted is None or wanted in own:
        return wanted
    same = [n for n in own if n.lower() == wanted.lower()]
    if same:
        return same[0]
    score, name = max(((difflib.SequenceMatcher(None, wanted.lower(), n.lower()).ratio(), n) for n in own), key=lambda x: x[0], default=(0.0, None))
    return name if score > 0.85 else None


def changed(rng, s):
    for _ in range(rng.randrange(4)):
        at = rng.randrange(len(s) + 1)
        s = rng.choice([s[:at] + rng.choice("abX_é") + s[at:], s[:at] + s[at + 1 :], s[:at] + s[at:].upper(), s[at:] + s[:at]])
    return s


def test_symbols_as_one_by_one(spark):
    rng = random.Random(4)
    own = {f: sorted({"".join(rng.choice("abcd_É") for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 9, 13, 20, 40, 230]))) for _ in range(70)}, key=lambda s: s.encode()) for f in ("f", "g")}
    own["f"] += ["ab", "Ab", "aB"]
    own["f"] = sorted(set(own["f"]), key=lambda s: s.encode())
    wanted = [(f, changed(rng, n)) for f in own for n in own[f] for _ in range(3)] + [("f", None), ("f", ""), ("h", "ab"), ("f", "AB"), ("f", "AB")]
    got = symbols.matched(spark.createDataFrame(wanted, "file string, wanted string"), spark.createDataFrame([(f, n) for f in own for n in own[f]] + [("f", None)], "file string, name string")).collect()
    want = {(f, w): one_by_one(w, own.get(f, [])) for f, w in wanted if w is not None}
    assert {(r.file, r.wanted): r.symbol for r in got} == want and len(got) == len(want)
    kinds = [(w in own.get(f, ()), n is None) for (f, w), n in want.items()]
    assert {(True, False), (False, False), (False, True)} <= set(kinds)


def test_few_pairs_are_compared(spark):
    rng = random.Random(5)
    names = sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(1500)})
    pairs = symbols.candidates(spark.createDataFrame([("f", n + "s") for n in names], "file string, low string"), spark.createDataFrame([("f", n) for n in names], "file string, other string"))
    assert len(names) <= pairs.count() < 2 * len(names)


def test_lists_of_names_are_not_handed_to_rows(spark):
    from quarry.catalog import QUERIES

    plan = QUERIES["TXT15_symbol_match"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan
