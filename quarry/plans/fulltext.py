"""Stemmed conjunctive search of all benchmark texts over all documents."""

from __future__ import annotations

from ..operators import fulltext
from .base import op


def _m(x: str) -> str:
    return f"len(regexp_extract_all({_shape(x)}, '1+c+'))"


def _shape(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace({x}, '([^aeiou])y', '\1i', 'g'), '[aeiou]', '1', 'g'), '[^1]', 'c', 'g')"


def _cut(n: int, x: str = "w") -> str:
    return f"left({x}, length({x}) - {n})"


def _cvc(x: str) -> str:
    return f"(regexp_matches({_shape(x)}, 'c1c$') AND NOT regexp_matches({x}, '[wxy]$'))"


def _repaired(x: str) -> str:
    double = " OR ".join(f"suffix({x}, '{c}{c}')" for c in "bcdfghjkmnpqrtvwxy")
    return f"CASE WHEN regexp_matches({x}, '(at|bl|iz)$') THEN {x} || 'e' WHEN {double} THEN {_cut(1, x)} WHEN {_m(x)} = 1 AND {_cvc(x)} THEN {x} || 'e' ELSE {x} END"


def _longest(rules, fits) -> str:
    whens = " ".join(f"WHEN suffix(w, '{s}') THEN CASE WHEN {fits(_cut(len(s)), s)} THEN {_cut(len(s))} || '{new}' ELSE w END" for s, new in sorted(rules, key=lambda r: -len(r[0])))
    return f"CASE {whens} ELSE w END"


_STEPS = [
    f"CASE WHEN regexp_matches(w, '(sses|ies)$') THEN {_cut(2)} WHEN suffix(w, 'ss') THEN w WHEN suffix(w, 's') THEN {_cut(1)} ELSE w END",
    f"CASE WHEN suffix(w, 'eed') THEN CASE WHEN {_m(_cut(3))} > 0 THEN {_cut(1)} ELSE w END WHEN suffix(w, 'ed') AND contains({_shape(_cut(2))}, '1') THEN {_repaired(_cut(2))} WHEN suffix(w, 'ing') AND contains({_shape(_cut(3))}, '1') THEN {_repaired(_cut(3))} ELSE w END",
    f"CASE WHEN suffix(w, 'y') AND contains({_shape(_cut(1))}, '1') THEN {_cut(1)} || 'i' ELSE w END",
    _longest(fulltext.STEP_2, lambda x, _: f"{_m(x)} > 0"),
    _longest(fulltext.STEP_3, lambda x, _: f"{_m(x)} > 0"),
    _longest([(s, "") for s in fulltext.STEP_4], lambda x, s: f"{_m(x)} > 1" + (f" AND regexp_matches({x}, '[st]$')" if s == "ion" else "")),
    f"CASE WHEN suffix(w, 'e') AND ({_m(_cut(1))} > 1 OR ({_m(_cut(1))} = 1 AND NOT {_cvc(_cut(1))})) THEN {_cut(1)} ELSE w END",
    f"CASE WHEN suffix(w, 'll') AND {_m('w')} > 1 THEN {_cut(1)} ELSE w END",
]
_STEPS_SQL = ", ".join(f"s{i + 1} AS MATERIALIZED (SELECT word, CASE WHEN regexp_matches(word, '^[a-z]{{3,}}$') THEN {step} ELSE w END AS w FROM s{i})" for i, step in enumerate(_STEPS))


@op("TXT26_stemmed_terms", f"""
WITH x AS MATERIALIZED (SELECT 0 AS side, doc_id AS id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS word FROM documents UNION ALL SELECT 1, item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) FROM benchmark),
s0 AS (SELECT DISTINCT word, word AS w FROM x), {_STEPS_SQL},
t AS MATERIALIZED (SELECT DISTINCT side, id, w FROM x JOIN s{len(_STEPS)} USING (word)),
q AS (SELECT id, w, count(*) OVER (PARTITION BY id) AS n FROM t WHERE side = 1)
SELECT q.id AS query, d.id AS doc FROM q JOIN t d ON d.w = q.w AND d.side = 0 GROUP BY q.id, d.id, n HAVING count(*) = n""")
def _(t):
    return fulltext.all_terms(fulltext.indexed(t.documents), t.benchmark, "item_id", "text")
