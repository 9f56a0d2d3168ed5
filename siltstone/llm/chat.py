"""Operator 9: chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of a rendered conversation: any number of turns, each `<turn ROLE>BODY</turn>`, where neither ROLE nor BODY holds
the beginning of a mark, `<turn` or `</turn`. The parser cuts at `</turn>`, reads the role up to the first `>`, and undoes
the escapes `\\l` (for <), `\\g` (for >) and `\\b` (for a backslash) in that order; a piece that is not a turn of the
grammar is read as null, so any input has one reading. A conversation is rendered plainly first and parsed again; if the
recovered turns differ from the source, its backslashes and angle brackets are escaped and it is rendered anew. So no
text that holds a mark or the beginning of one is ever left as it is.
After that every `<` is a mark of the template and every backslash begins an escape, so the second rendering always
reads back as the source.

The real outputs are the rendered text and its pieces with a loss mask; joined, the pieces are the rendered text, and
the mask is set on the bodies of the turns whose role is trained on.

Defined cases: null texts and null roles count as empty; a null conv_id is a conversation of its own; turns are in
order of turn (null first), then role, then text, so ties and repeated rows have one order; empty tables give empty
results; other columns are not read. One conversation is one output row, so a task must be able to hold it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.tables import table

OPEN, CLOSE, END = "<turn ", ">", "</turn>"
#: The beginnings of marks, which no role or body may hold.
MARKS = ("<turn", "</turn")
#: The probe conversation of the query: control strings of this and of other templates inside texts.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def escaped(text: Column) -> Column:
    """Backslash first, then both angle brackets."""
    for what, code in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        text = F.replace(text, F.lit(what), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    """Angle brackets first, the backslash last."""
    for code, what in (("\\l", "<"), ("\\g", ">"), ("\\b", "\\")):
        text = F.replace(text, F.lit(code), F.lit(what))
    return text


def rendered(turns: Column) -> Column:
    """One string for an array of (role, text) whose strings are already as they shall be written."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE), t["text"], F.lit(END))), "")


def parsed(formatted: Column) -> Column:
    """The turns of a rendered string: array of (role, text), null where a piece is not a turn."""
    cut = F.split(formatted, F.lit(END), -1)
    bodies = F.slice(cut, F.lit(1), F.size(cut) - 1)

    def turn(x: Column) -> Column:
        at = F.locate(CLOSE, x)
        role = F.substring(x, F.lit(len(OPEN) + 1), at - F.lit(len(OPEN) + 1))
        valid = x.startswith(OPEN) & (at > 0) & (F.locate(MARKS[0], x, 2) == 0) & ~x.contains(MARKS[1])
        return F.when(valid, F.struct(unescaped(role).alias("role"), unescaped(F.substring(x, at + F.lit(1), F.length(x))).alias("text")))

    return F.transform(bodies, turn)


def pieces(written: Column, roles: list[str]) -> Column:
    """Array of (piece, loss): joined, the pieces are the rendered text; loss marks the bodies of the given roles."""
    piece = lambda x, loss: F.struct(x.alias("piece"), loss.alias("loss"))
    return F.flatten(F.transform(written, lambda t: F.array(
        piece(F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE)), F.lit(False)),
        piece(t["text"], unescaped(t["role"]).isin(roles)),
        piece(F.lit(END), F.lit(False)),
    )))


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv, formatted, pieces (piece, loss), was_escaped, turns (role, text as recovered)."""
    empty = F.lit("")
    gathered = rows.select(F.col(conv).alias(conv), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), empty).alias("role"), F.coalesce(F.col(text), empty).alias("text")).alias("t"))
    source = gathered.groupBy(conv).agg(F.sort_array(F.collect_list("t")).alias("source")).select(conv, F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    careful = F.transform("source", lambda t: F.struct(escaped(t["role"]).alias("role"), escaped(t["text"]).alias("text")))
    tried = source.withColumn("was_escaped", ~(parsed(rendered(F.col("source"))) == F.col("source")))
    written = tried.withColumn("written", F.when(F.col("was_escaped"), careful).otherwise(F.col("source")))
    out = written.withColumn("formatted", rendered(F.col("written"))).withColumn("turns", parsed(F.col("formatted")))
    same = F.when(F.col("turns") == F.col("source"), F.col("formatted")).otherwise(F.raise_error(F.lit("a rendered conversation does not read back as its source")).cast("string"))
    return out.select(conv, same.alias("formatted"), pieces(F.col("written"), [r for r in trained]).alias("pieces"), "was_escaped", "turns")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe, formatted, and digests of what is read back from the output."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"),
    )
    chats = format_chats(rows.unionByName(probe))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.array_join(F.transform(F.filter("pieces", lambda p: p["loss"]), lambda p: unescaped(p["piece"])), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length(masked).cast("long").alias("loss_chars"),
        F.sha2(masked.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _oracle() -> str:
    esc = lambda x: f"replace(replace(replace({x}, '\\', '\\b'), '<', '\\l'), '>', '\\g')"
    clash = " OR ".join(f"contains(role || chr(10) || text, '{x}')" for x in (*MARKS, "\\l", "\\g", "\\b")) + " OR contains(role, '>')"
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES ({PROBE_ID}, 0, 'user', '{PROBE_TEXT}'), ({PROBE_ID}, 1, 'assistant', '{PROBE_TEXT}')),
e AS (SELECT *, bool_or({clash}) OVER (PARTITION BY conv_id) AS esc FROM c),
w AS (SELECT *, CASE WHEN esc THEN {esc('role')} ELSE role END AS wr, CASE WHEN esc THEN {esc('text')} ELSE text END AS wt FROM e)
SELECT conv_id::BIGINT AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('{OPEN}' || wr || '{CLOSE}' || wt || '{END}'))::BIGINT AS formatted_chars
FROM w GROUP BY conv_id
"""


QUERIES = {"op9_chat_format": op9_chat_format}
ORACLES = {"op9_chat_format": _oracle()}
