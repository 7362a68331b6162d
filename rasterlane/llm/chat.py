"""Chat formatting, with DataFrame functions alone.

A template declares, as data, how each role's turn opens and closes, which roles are trained on, and the transitions of
a finite-state machine over roles. Formatting emits segments (text, loss flag); the joined segments are the formatted
string. Control strings inside texts are broken by an escape that can be undone, so the string can be read back.

Defined cases: turns stand in order of (turn, role, text), nulls first, so ties and repeated rows are all kept, in a fixed
order; null text is empty; a role that the template does not know (null counts as the empty name) is written with its name
and gets no loss; turns out of order are still formatted, with valid_order false and error_turn the first bad turn's
position; null conversation ids make one conversation; no rows give no rows. A conversation is one unit of text, whose
digest needs it whole: its turns meet in one row, other columns are left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Role:
    name: str
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class ChatTemplate:
    """roles: the known ones; any other is written as other_open + name + other_sep + text + other_close. controls: the
    strings that texts must not hold. transitions: (state, role) -> state, from start; states in accept end a conversation."""

    bos: str = "<s>"
    roles: tuple[Role, ...] = (
        Role("system", "<<SYS>>\n", "\n<</SYS>>\n\n"),
        Role("user", "[INST] ", " [/INST]"),
        Role("assistant", "[ANS] ", " </s>", True),
    )
    other_open: str = "[ROLE] "
    other_sep: str = " [/ROLE] "
    other_close: str = " </s>"
    controls: tuple[str, ...] = ("<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[ANS]", "[/ANS]", "[ROLE]", "[/ROLE]")
    start: str = "start"
    accept: tuple[str, ...] = ("answered",)
    transitions: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "briefed", ("start", "user"): "asked", ("briefed", "user"): "asked",
        ("asked", "assistant"): "answered", ("answered", "user"): "asked",
    })

    def escape(self, text: Column) -> Column:
        """Backslash becomes backslash b; backslash dot goes in after the first character of each control string."""
        at = "|".join(f"(?<={_java(c[0])})(?={_java(c[1:])})" for c in self.controls)
        return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit(at), F.lit(r"\\."))

    def unescape(self, text: Column) -> Column:
        return F.replace(F.replace(text, F.lit("\\."), F.lit("")), F.lit("\\b"), F.lit("\\"))


def _java(s: str) -> str:
    return re.sub(r"([^0-9A-Za-z])", r"\\\1", s)


def format_chat(rows: DataFrame, template: ChatTemplate = ChatTemplate(), conv_col: str = "conv_id", turn_col: str = "turn",
                role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per conversation: conv_id, n_turns, segments array<struct<text, loss>>, formatted, valid_order, complete, error_turn."""
    turns = rows.select(F.col(conv_col).alias("conv_id"), F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def pieces(t: Column) -> Column:
        text = template.escape(t["text"])
        seg = lambda x, loss: F.struct(x.alias("text"), F.lit(loss).alias("loss"))
        out = F.array(seg(F.concat(F.lit(template.other_open), template.escape(t["role"]), F.lit(template.other_sep)), False), seg(text, False), seg(F.lit(template.other_close), False))
        for r in template.roles:
            out = F.when(t["role"] == r.name, F.array(seg(F.lit(r.open), False), seg(text, r.loss), seg(F.lit(r.close), False))).otherwise(out)
        return out

    arrows = F.create_map(*[F.lit(x) for (state, role), to in template.transitions.items() for x in (f"{state}>{role}", to)])
    step = lambda at, t: F.struct(
        F.coalesce(F.try_element_at(arrows, F.concat(at["state"], F.lit(">"), t["role"])), F.lit("bad")).alias("state"),
        (at["pos"] + 1).alias("pos"),
        F.when((at["err"] < 0) & F.try_element_at(arrows, F.concat(at["state"], F.lit(">"), t["role"])).isNull(), at["pos"]).otherwise(at["err"]).alias("err"))
    walk = F.aggregate("turns", F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("pos"), F.lit(-1).alias("err")), step)
    opening = F.array(F.struct(F.lit(template.bos).alias("text"), F.lit(False).alias("loss")))
    convs = convs.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.concat(opening, F.flatten(F.transform("turns", pieces))).alias("segments"), walk.alias("w"))
    return convs.select("conv_id", "n_turns", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
                        (F.col("w.err") < 0).alias("valid_order"), ((F.col("w.err") < 0) & F.col("w.state").isin(*template.accept)).alias("complete"), F.when(F.col("w.err") >= 0, F.col("w.err")).alias("error_turn"))


def read_chat(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """Turns, array<struct<role, text>>, read from a formatted string."""
    opens = [r.open for r in template.roles] + [template.other_open]
    body = F.substr(formatted, F.lit(len(template.bos) + 1))
    parts = F.split(body, "(?=" + "|".join(map(_java, opens)) + ")", -1)

    def turn(p: Column) -> Column:
        inner = lambda s, a, b: F.substr(s, F.lit(len(a) + 1), F.greatest(F.lit(0), F.length(s) - len(a) - len(b)))
        rest = inner(p, template.other_open, template.other_close)
        name = F.substring_index(rest, template.other_sep, 1)
        out = F.struct(template.unescape(name).alias("role"), template.unescape(F.substr(rest, F.length(name) + len(template.other_sep) + 1)).alias("text"))
        for r in template.roles:
            out = F.when(F.startswith(p, F.lit(r.open)), F.struct(F.lit(r.name).alias("role"), template.unescape(inner(p, r.open, r.close)).alias("text"))).otherwise(out)
        return out

    return F.transform(F.filter(parts, lambda p: p != ""), turn)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT CAST(-7 AS BIGINT) conv_id, CAST(id AS BIGINT) turn, IF(id = 0, 'user', 'assistant') role, '{control}' text FROM range(2)")
    template = ChatTemplate()
    out = format_chat(rows.unionByName(extra), template)
    back = out.select("*", read_chat(F.col("formatted"), template).alias("back"), F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: template.unescape(s["text"])), "").alias("loss_text"))
    lines = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
                       F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid_order", "complete")


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(i)),
e AS (SELECT *, length(regexp_replace(replace(text, '\', '\b'), '<s>|</s>|<<SYS>>|<</SYS>>|\[/?INST\]|\[/?ANS\]|\[/?ROLE\]', 'XX' || '\0', 'g')) AS n,
             lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prev, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS last FROM c),
f AS (SELECT *, CASE role WHEN 'system' THEN 8 + 11 WHEN 'user' THEN 7 + 8 WHEN 'assistant' THEN 6 + 5 ELSE 7 + length(role) + 9 + 5 END AS marks,
             coalesce(prev || '>', '') || role IN ('system', 'user', 'system>user', 'user>assistant', 'assistant>user') AS fits FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(marks + n) AS BIGINT) AS formatted_chars, bool_and(fits) AS valid_order, bool_and(fits) AND bool_or(last = 1 AND role = 'assistant') AS complete
FROM f GROUP BY conv_id
"""
