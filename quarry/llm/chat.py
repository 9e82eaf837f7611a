r"""Chat formatting in budgeted windows, in DataFrame functions only.

Method: prefix sums of turn tokens (words and a fixed overhead a turn) choose turn-aligned spans: a turn belongs to the span
in which it starts, a turn larger than a span is a window of its own.  Each window is the retained system turn, the turns of
at most ``history`` tokens before it, repeated, and its own turns.  Only assistant texts of its own turns are under the loss;
repeated ones are masked, so each is learned once.  A window of ordinary turns stays within ``budget`` tokens: history,
system turn (if within SYSTEM tokens) and two spans.

Template: ``<turn:ROLE>\nTEXT</turn>\n``.  In texts, control strings ``<turn`` and ``</turn``, with any number of backslashes
after ``<``, get one more backslash there, so no text can hold a mark and unescaping gives the text back exactly; in roles
``%``, ``<``, ``>`` and line ends are written as %XX.

Scale: prefix sums run inside blocks of BLOCK turn numbers and over the blocks' sums, and history meets windows by an
equi-join on (conversation, token bucket), so one conversation of a third of all turns is spread over many tasks.  Placed
turns are written once in the shared folder, so texts are shuffled once to be placed and once to be put in windows; of the
search for history only turns take part that a window can begin shortly after.

Defined results: null texts and roles are empty; turns are ordered by (turn, nulls first; role; text), so ties and repeated
rows each stay; rows with a null conv_id form one conversation; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, let, table, written

BUDGET, HISTORY, SYSTEM, OVERHEAD, BLOCK = 1024, 128, 128, 3, 256
_OPEN, _CLOSE = "<turn:", "</turn>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)(/?turn)", r"<\\$1$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)(/?turn)", "<$1$2")


_ROLE = (("%", "%25"), ("<", "%3C"), (">", "%3E"), ("\n", "%0A"))


def _role(role: Column, back: bool = False) -> Column:
    for a, b in reversed(_ROLE) if back else _ROLE:
        role = F.replace(role, F.lit(b if back else a), F.lit(a if back else b))
    return role


def windows(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = BUDGET, history: int = HISTORY, system: int = SYSTEM) -> DataFrame:
    """(conv_id, window, n_repeated, n_new, text, loss): loss holds (start, end) in code points of text; window numbers rise, with gaps."""
    span = (budget - history - system) // 2
    if span < 1 or history < 1:
        raise ValueError("the budget leaves no room for turns")
    t = turns.select(F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    t = t.withColumn("tokens", (F.regexp_count("text", F.lit(WORD)) + OVERHEAD).cast("long")).withColumn("large", (F.col("tokens") > span).cast("long"))
    # keys without nulls: windows and joins on them share one exchange
    key = ["unnamed", "name", "blk"]
    t = t.withColumns({"unnamed": F.col("conv").isNull(), "name": F.coalesce(F.col("conv").cast("string"), F.lit("")), "blk": F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))), "one": F.lit(1)})
    ordered = Window.partitionBy(*key).orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    inside = ordered.rowsBetween(Window.unboundedPreceding, -1)
    prefix = lambda what, w: F.coalesce(F.sum(what).over(w), F.lit(0)).cast("long")
    along = Window.partitionBy("unnamed", "name").orderBy("blk")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    blocks = t.groupBy(*key).agg(F.sum("tokens").alias("b_tokens"), F.sum("large").alias("b_large"), F.sum("one").alias("b_one"))
    blocks = blocks.select(*key, "b_tokens", prefix("b_tokens", earlier).alias("b_start"), prefix("b_large", earlier).alias("b_large"), prefix("b_one", earlier).alias("b_pos"), F.lead("blk").over(along).isNotNull().alias("b_more"))
    # a turn within `history` tokens is at most so many turns on
    soon = F.max("large").over(ordered.rowsBetween(1, max(1, history // OVERHEAD)))
    t = t.withColumns({"start": prefix("tokens", inside), "large_before": prefix("large", inside), "pos": prefix("one", inside), "soon": F.coalesce(soon, F.lit(0)) > 0})
    t = t.join(blocks, key)
    start, pos = F.col("start") + F.col("b_start"), F.col("pos") + F.col("b_pos")
    # windows begin where a span does, at a large turn and after one
    ahead = (F.floor(start / span) < F.floor((start + history) / span)) | F.col("soon") | (F.col("b_more") & (F.col("b_tokens") - F.col("start") <= history))
    head = F.concat(F.lit(_OPEN), _role(F.col("role")), F.lit(">\n"))
    body = escaped(F.col("text"))
    t, _ = written(t.select(
        "conv", ((F.col("tokens") <= history) & ahead).alias("ahead"), start.alias("start"), pos.alias("pos"), F.length(head).alias("head"), F.length(body).alias("body"), F.concat(head, body, F.lit(_CLOSE)).alias("line"),
        (F.col("role") == "assistant").alias("assistant"), ((pos == 0) & (F.col("role") == "system")).alias("system"),
        (F.floor(start / span) + 2 * (F.col("large_before") + F.col("b_large")) + F.col("large")).cast("long").alias("window"),
    ))
    w = t.groupBy("conv", "window").agg(F.min("start").alias("first"), F.min("pos").alias("first_pos")).where("first_pos > 0").select(F.col("conv").alias("w_conv"), F.col("window").alias("w"), "first")
    fields = ["pos", "head", "body", "line"]
    own = t.select("conv", "window", F.lit(True).alias("own"), F.col("assistant").alias("loss"), *fields)
    looks = w.withColumn("bucket", F.explode(F.array(F.floor(F.col("first") / history), F.floor(F.col("first") / history) - 1)))
    before = t.where(~F.col("system") & F.col("ahead")).withColumn("at", F.floor(F.col("start") / history))
    before = before.join(looks, F.col("conv").eqNullSafe(F.col("w_conv")) & (F.col("at") == F.col("bucket")) & (F.col("start") < F.col("first")) & (F.col("start") >= F.col("first") - history))
    again = t.where("system").join(w, F.col("conv").eqNullSafe(F.col("w_conv")))
    repeated = [x.select("conv", F.col("w").alias("window"), F.lit(False).alias("own"), F.lit(False).alias("loss"), *fields) for x in (before, again)]
    made = own.unionByName(repeated[0]).unionByName(repeated[1]).groupBy("conv", "window").agg(F.sort_array(F.collect_list(F.struct("pos", "own", "loss", "head", "body", "line"))).alias("turns"))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    spans = F.aggregate(
        "turns", F.struct(F.lit(0).alias("at"), empty.alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["line"])).alias("at"),
            F.when(x["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["head"]).alias("start"), (acc["at"] + x["head"] + x["body"]).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    new = F.size(F.filter("turns", lambda x: x["own"]))
    return made.select(F.col("conv").alias("conv_id"), "window", (F.size("turns") - new).alias("n_repeated"), new.alias("n_new"), F.array_join(F.transform("turns", lambda x: x["line"]), "").alias("text"), spans.alias("loss"))


def read_back(made: DataFrame) -> DataFrame:
    """(conv_id, window, chars, turns array<struct<role,text>>, learned array<string>): a window's own turns and the texts under its loss."""
    lines = F.slice(F.split("text", _CLOSE, -1), F.col("n_repeated") + 1, F.col("n_new"))
    turn = lambda x: let(F.instr(x, ">\n"), lambda at: F.struct(_role(F.substring(x, len(_OPEN) + 1, at - len(_OPEN) - 1), back=True).alias("role"), unescaped(F.substring(x, at + 2, F.length(x))).alias("text")))
    learned = F.transform("loss", lambda s: unescaped(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])))
    return made.select("conv_id", "window", F.length("text").alias("chars"), F.transform(lines, turn).alias("turns"), learned.alias("learned"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted in windows and read back, one row of digests a conversation."""
    tricky = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(tricky)
    back = read_back(windows(turns))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    back = back.select("conv_id", F.size("turns").alias("n"), "chars", F.struct("window", said.alias("said"), F.array_join("learned", "").alias("learned")).alias("part"))
    # a digest of a whole conversation needs its whole text in one row, as the result is defined
    whole = back.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"), F.sort_array(F.collect_list("part")).alias("parts"))
    joined = lambda name: F.array_join(F.transform("parts", lambda p: p[name]), "")
    return whole.select("conv_id", "n_turns", F.sha2(joined("said"), 256).alias("turns_sha256"), F.length(joined("learned")).cast("long").alias("loss_chars"), F.sha2(joined("learned"), 256).alias("loss_sha256"), "formatted_chars")


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
k AS (SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 3 AS tokens,
             16 + length(role) + length(text) + len(regexp_extract_all(text, '<\\*/?turn')) AS chars FROM c),
p AS (SELECT *, CASE WHEN tokens > 384 THEN 1 ELSE 0 END AS large FROM k),
s AS (
  SELECT *, sum(tokens) OVER o - tokens AS start, sum(large) OVER o - large AS before, row_number() OVER o - 1 AS pos FROM p
  WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
t AS (SELECT *, CAST(floor(start / 384) AS BIGINT) + 2 * before + large AS win, pos = 0 AND role = 'system' AS sys FROM s),
w AS (SELECT conv_id, win, min(start) AS first FROM t GROUP BY 1, 2 HAVING min(pos) > 0),
f AS (
  SELECT conv_id, chars FROM t
  UNION ALL SELECT t.conv_id, t.chars FROM t JOIN w ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND (t.sys OR (t.start < w.first AND t.start >= w.first - 128))),
g AS (SELECT conv_id, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM f GROUP BY 1),
d AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '') AS learned FROM t GROUP BY 1)
SELECT d.conv_id, n_turns, turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars
FROM d JOIN g ON d.conv_id IS NOT DISTINCT FROM g.conv_id
"""
