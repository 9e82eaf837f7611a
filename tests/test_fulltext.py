"""Porter's rules on words with known stems, and the index against a scan."""

import random

from quarry.operators import fulltext

STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat",
    "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat",
    "conditional": "condit", "rational": "ration", "digitizer": "digit", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "formality": "formal", "sensibility": "sensibl", "triplicate": "triplic",
    "formative": "form", "electrical": "electr", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin", "adjustable": "adjust", "irritant": "irrit", "replacement": "replac",
    "adoption": "adopt", "communism": "commun", "activate": "activ", "homologous": "homolog", "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "is": "is", "a1s": "a1s", "generalizations": "gener", "oscillators": "oscil",
}


def test_stems(spark):
    df = spark.createDataFrame([(w,) for w in STEMS], "word string")
    assert {r.word: r.stem for r in fulltext.stems(df).collect()} == STEMS


def test_index_equals_scan(spark):
    rng = random.Random(3)
    words = ["run", "runs", "Running", "cat", "CATS", "dog", "dogged", "hope", "hoping", "x1", "of"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))) for i in range(300)] + [(7, "cat"), (None, "cat dog"), (400, None), (401, ""), (402, "...")]
    queries = [(i, " ".join(rng.sample(words, rng.randint(1, 4)))) for i in range(25)] + [(90, None), (91, "unknown cat"), (92, "  "), (93, "cats cat CAT")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(queries, "item_id long, text string")
    index = fulltext.indexed(d, block=16)
    got = sorted((tuple(r) for r in fulltext.all_terms(index, q, "item_id", "text").collect()), key=repr)
    stem = {r.word: r.stem for r in fulltext.stems(spark.createDataFrame([(w.lower(),) for w in words] + [("unknown",)], "word string").distinct()).collect()}
    of = lambda t: {stem[w] for w in (t or "").lower().replace(".", " ").split()}
    want = sorted(((qi, di) for qi, qt in queries for di, dt in docs if of(qt) and of(qt) <= of(dt)), key=repr)
    assert got == want
    unique = spark.createDataFrame([x for x in docs if x[0] not in (7, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in fulltext.scanned(unique, q, "doc_id", "item_id").collect()) == sorted(x for x in want if x[1] not in (7, None))
    assert fulltext.all_terms(fulltext.indexed(d.limit(0)), q, "item_id", "text").collect() == []
