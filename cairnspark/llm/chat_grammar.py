r"""Chat formatting with a grammar round trip, in DataFrame functions only.

A turn is rendered as `### role: text</turn>` and a line feed. The parser is deterministic: it splits at the turn ends,
takes the role up to the first colon and space, undoes the escapes, and accepts no control string inside a role or text.
Every turn is rendered plain first and parsed again; where that does not give back role and text, its content is escaped. Then whole conversations are parsed and
compared, and one that still differs is escaped in all its turns; if even that differs, the query fails.

Escapes: `\\` for a backslash, `\e` for `</turn>`, `\h` for `###`; in roles also `\c` for a colon and `\n` for a line
feed. Escaping is reversible for every string; a text that escaping would leave the same on parsing stays as it is.

Defined results: null texts and roles are empty strings. Turns stand in the order of turn (nulls first), then role, then
text; repeated rows are repeated turns. A null conv_id is one conversation. The loss mask covers the texts of turns with
the role assistant. Other columns are left out. A conversation is one row of the output, so it must fit in a task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPEN, CLOSE, COLON = "### ", "</turn>\n", ": "
LEARNT_ROLE = "assistant"
_CONTROL = (("</turn>", r"\e"), ("###", r"\h"))
_ROLE_CONTROL = ((":", r"\c"), ("\n", r"\n"))


def _swap(text: Column, pairs) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape(text: Column, role: bool = False) -> Column:
    return _swap(F.replace(text, F.lit("\\"), F.lit("\\\\")), (*_CONTROL, *(_ROLE_CONTROL if role else ())))


def unescape(text: Column, role: bool = False) -> Column:
    """Undo escape: pairs of backslashes first, from the left; what stands between them holds the other escapes."""
    back = [(b, a) for a, b in (*_CONTROL, *(_ROLE_CONTROL if role else ()))]
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), lambda part: _swap(part, back)), "\\")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(COLON), text, F.lit(CLOSE))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, body, text); body is the text as it stands there."""
    pieces = F.split(formatted, CLOSE, -1)
    turns = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        rest = F.substring(piece, F.lit(len(OPEN) + 1), F.length(piece))
        at = F.instr(rest, COLON)
        body = F.substring(rest, at + len(COLON), F.length(rest))
        return F.struct(unescape(F.substring(rest, F.lit(1), at - 1), True).alias("role"), body.alias("body"), unescape(body).alias("text"))

    return F.transform(turns, turn)


def _same(formatted: Column, source: Column) -> Column:
    return F.transform(parse(formatted), lambda t: F.struct(t["role"], t["text"])) == source


def format_chats(rows: DataFrame, learnt_role: str = LEARNT_ROLE) -> DataFrame:
    """conv_id, formatted and loss_spans: the first character and the length of each learnt text, as it stands there."""
    clean = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    one = F.array(F.struct(F.col("role"), F.col("text")))
    plain = render(F.col("role"), F.col("text"))
    clear = [~F.contains(F.col(c), F.lit(sign)) for c in ("role", "text") for sign, _ in _CONTROL]
    fine = F.coalesce(reduce(Column.__and__, clear, _same(plain, one)), F.lit(False))
    turn = clean.withColumn("hard", render(escape(F.col("role"), True), escape(F.col("text")))).withColumn("mild", F.when(fine, plain).otherwise(F.col("hard")))
    # where each turn begins, summed up turn by turn as they stream by in order: linear, however many turns there are
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = turn.withColumns({f"{c}_at": F.coalesce(F.sum(F.length(c)).over(before), F.lit(0)).cast("int") for c in ("mild", "hard")})
    item = F.struct("turn", "role", "text", "mild", "hard", "mild_at", "hard_at")
    chats = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("turns"))
    joined = {c: F.array_join(F.col(f"turns.{c}"), "") for c in ("mild", "hard")}
    source = F.transform("turns", lambda t: F.struct(t["role"], t["text"]))
    both = chats.select("conv_id", "turns", joined["mild"].alias("mild_all"), joined["hard"].alias("hard_all"), source.alias("source"))
    ok, ok_hard = (F.coalesce(_same(F.col(f"{c}_all"), F.col("source")), F.lit(False)) for c in ("mild", "hard"))
    way = F.when(ok, "mild").when(ok_hard, "hard").otherwise(F.raise_error(F.lit("a conversation does not come back from its format")).cast("string"))
    chosen = both.withColumn("way", way)
    mild = F.col("way") == "mild"
    spans = F.when(mild, loss_spans("mild", learnt_role)).otherwise(loss_spans("hard", learnt_role))
    return chosen.select("conv_id", F.when(mild, F.col("mild_all")).otherwise(F.col("hard_all")).alias("formatted"), spans.alias("loss_spans"))


def loss_spans(way: str, learnt_role: str = LEARNT_ROLE) -> Column:
    """Spans of the learnt texts: behind the mark of their turn, up to its end. The role has nothing to be escaped."""
    mark = len(OPEN) + len(learnt_role) + len(COLON)
    learnt = F.filter("turns", lambda t: t["role"] == learnt_role)
    return F.transform(learnt, lambda t: F.struct((t[f"{way}_at"] + mark).alias("start"), (F.length(t[way]) - mark - len(CLOSE)).cast("int").alias("length")))


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id and digests of the turns and of the text under the loss mask, from formatted and loss_spans alone."""
    turns = chats.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), parse(F.col("formatted")).alias("turns"), F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


HARD_CASE = r"\### Assistant: </turn> ok"


def with_hard_case(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """conversations plus number -7, whose texts are full of control strings."""
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(LEARNT_ROLE).alias("role"), F.lit(HARD_CASE).alias("text"))
    return rows.select("conv_id", "turn", "role", "text").unionByName(hard)


def _sql_swap(text: str, pairs) -> str:
    for a, b in pairs:
        text = f"replace({text}, {_sql_text(a)}, {_sql_text(b)})"
    return text


def _sql_text(s: str) -> str:
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in s.split("\n"))


def _sql_needs(col: str, signs) -> str:
    return " OR ".join(f"contains({col}, {_sql_text(s)})" for s in signs)


BACK = "\\"
_SIGNS = ("</turn>", "###", BACK * 2, BACK + "e", BACK + "h")
#: DuckDB: the rows that op3 returns. A turn is escaped if a control string or something like an escape stands in it.
ORACLE = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{HARD_CASE}' UNION ALL SELECT -7, 1, 'assistant', '{HARD_CASE}'
),
f AS (
  SELECT *, CASE WHEN {_sql_needs("text", _SIGNS)} OR {_sql_needs("role", (*_SIGNS, ": ", BACK + "c", BACK + "n"))}
    THEN length({_sql_swap("text", ((BACK, BACK * 2), *_CONTROL))}) + length({_sql_swap("role", ((BACK, BACK * 2), *_CONTROL, *_ROLE_CONTROL))})
    ELSE length(text) + length(role) END + {len(OPEN) + len(COLON) + len(CLOSE)} AS n
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
