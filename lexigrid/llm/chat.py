"""Multi-party perspective rotation: a dialogue rendered once for each of its speakers, who then is the assistant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Roles that aren't speakers: their turns keep their role in every rendering.
FRAME_ROLES = ("system", "tool")
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
ASSISTANT, USER = "assistant", "user name="
NO_ROLE = "unknown"


def _clean(text: Column) -> Column:
    """Markers within a text are broken up, so that no text can open or close a turn."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit("<| im_"))


def rotate(turns: DataFrame, frame_roles: tuple[str, ...] = FRAME_ROLES) -> DataFrame:
    """(conv_id, speaker, text, n_chars, mask) - for every speaker of every conversation the dialogue from their side.

    Turns are sorted by turn and rendered as OPEN, header, newline, text, CLOSE, newline. The speaker's own have the header
    "assistant", the others' "user name=<role>", those of frame_roles their role. mask lists the spans that are trained on,
    as "start-end" offsets into text, joined by commas, end excluded: each text of the speaker with its CLOSE.

    Nulls: a null conv_id is no conversation, its rows are left out; a null or blank role is the speaker "unknown"; line feeds
    in a role are blanks, so that it can't end its header; a null
    text is empty; a null turn comes first. An empty text is a turn all the same. Ties in turn go by role, then by text.
    Repeated rows are turns each for itself. A conversation of frame turns alone has no speaker and no row. An empty table
    gives an empty result. Texts of any length are kept whole. Other columns aren't read.
    """
    frame = list(frame_roles)
    role = F.coalesce(F.nullif(F.trim(F.translate("role", "\n\r", "  ")), F.lit("")), F.lit(NO_ROLE))
    rows = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", _clean(role).alias("role"), _clean(F.col("text")).alias("text"))
    # Where each turn ends if nobody is the assistant. A speaker's own headers are all of one length, so where a turn ends for
    # them follows from how many turns of theirs stand before.
    named = F.when(F.col("role").isin(frame), F.length("role")).otherwise(F.length("role") + len(USER))
    end = F.sum((named + F.length("text") + len(OPEN) + len(CLOSE) + 2).cast("bigint")).over(Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0))
    whole = rows.withColumn("end", end).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "end"))).alias("ts"))
    speakers = F.array_distinct(F.filter(F.transform("ts", lambda t: t["role"]), lambda r: ~r.isin(frame)))
    each = whole.select("conv_id", "ts", F.explode(speakers).alias("speaker"))

    def header(t: Column) -> Column:
        return F.when(t["role"].isin(frame), t["role"]).when(t["role"] == F.col("speaker"), F.lit(ASSISTANT)).otherwise(F.concat(F.lit(USER), t["role"]))

    def span(t: Column, nth: Column) -> Column:
        stop = t["end"] - 1 - (nth + 1) * (F.length("speaker") + len(USER) - len(ASSISTANT))
        return F.concat_ws("-", (stop - F.length(t["text"]) - len(CLOSE)).cast("string"), stop.cast("string"))

    text = F.array_join(F.transform("ts", lambda t: F.concat(F.lit(OPEN), header(t), F.lit("\n"), t["text"], F.lit(CLOSE + "\n"))), "")
    mask = F.array_join(F.transform(F.filter("ts", lambda t: t["role"] == F.col("speaker")), span), ",")
    return each.select("conv_id", "speaker", text.alias("text"), mask.alias("mask")).select("conv_id", "speaker", "text", F.length("text").alias("n_chars"), "mask")


def several_users(turns: DataFrame) -> DataFrame:
    """turns whose users are three persons in turn, as conversations of more than two."""
    return turns.withColumn("role", F.when(F.col("role") == "user", F.concat(F.lit("user"), (F.floor(F.col("turn") / 2) % 3).cast("string"))).otherwise(F.col("role")))


SEVERAL_USERS = "(SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' || CAST(turn // 2 % 3 AS VARCHAR) ELSE role END AS role, text FROM conversations)"


def oracle_sql(frame_roles: tuple[str, ...] = FRAME_ROLES, conversations: str = "conversations") -> str:
    """The same in DuckDB's SQL, over the table conversations or another like it."""
    frames = ", ".join(f"'{r}'" for r in frame_roles)
    return f"""
WITH t AS (SELECT conv_id, turn, replace(coalesce(nullif(trim(translate(role, chr(10) || chr(13), '  ')), ''), '{NO_ROLE}'), '<|im_', '<| im_') AS role, replace(coalesce(text, ''), '<|im_', '<| im_') AS text
           FROM {conversations} WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM t),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role NOT IN ({frames})),
p AS (SELECT n.conv_id, s.speaker, i, role = speaker AS own, text || '{CLOSE}' AS body,
             '{OPEN}' || CASE WHEN role IN ({frames}) THEN role WHEN role = speaker THEN 'assistant' ELSE 'user name=' || role END || chr(10) AS head
      FROM n JOIN s ON n.conv_id = s.conv_id),
o AS (SELECT *, CAST(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, speaker ORDER BY i) AS BIGINT) - 1 AS stop FROM p)
SELECT conv_id, speaker, string_agg(head || body || chr(10), '' ORDER BY i) AS text, CAST(sum(length(head) + length(body) + 1) AS INTEGER) AS n_chars,
       coalesce(string_agg(CASE WHEN own THEN (stop - length(body)) || '-' || stop END, ',' ORDER BY i), '') AS mask
FROM o GROUP BY conv_id, speaker"""
