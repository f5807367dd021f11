"""Chat formatting with a grammar round trip (operator 4). DataFrame functions only.

A turn is <|im_start|>, its role, a newline, its text, <|im_end|> and a newline, and holds no other mark. The
parser splits at ended turns, checks the marks, reads the role up to the first newline, and undoes
escapes. Each turn is rendered plainly first and parsed back; turns that break the grammar or do not
come back identical are escaped and parsed again.

Escapes. In texts a bar after < and any backslashes gets one more backslash (<| becomes <\\|), so that
no mark can occur. In roles %, < and newline become %25, %3C and %0A.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape_text(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape_text(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def _put(c: Column, a: str, b: str) -> Column:
    return F.replace(c, F.lit(a), F.lit(b))


def escape_role(c: Column) -> Column:
    return _put(_put(_put(c, "%", "%25"), "<", "%3C"), "\n", "%0A")


def unescape_role(c: Column) -> Column:
    return _put(_put(_put(c, "%0A", "\n"), "%3C", "<"), "%25", "%")


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def parse(formatted: Column) -> Column:
    """array of (role, text, ok): turns read back, and whether the marks are right."""
    parts = F.split(formatted, r"<\|im_end\|>\n", -1)
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), _read)


def _read(part: Column) -> Column:
    body = F.substr(part, F.lit(len(START) + 1))
    ok = F.startswith(part, F.lit(START)) & ~F.contains(body, F.lit(START)) & ~F.contains(body, F.lit(END)) & F.contains(body, F.lit("\n"))
    role = F.substring_index(body, "\n", 1)
    text = F.substr(body, F.length(role) + 2)
    return F.struct(unescape_role(role).alias("role"), unescape_text(text).alias("text"), ok.alias("ok"))


def round_trip(role: Column, text: Column) -> Column:
    """Whether one turn, rendered plainly, keeps to the grammar and is read back as it was."""
    whole = render_turn(role, text)
    parts = F.split(whole, r"<\|im_end\|>\n", -1)
    back = _read(F.element_at(parts, 1))
    return (F.size(parts) == 2) & back["ok"] & (back["role"] == role) & (back["text"] == text)


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, turns (role, text: read back), loss_text, loss_spans, escaped.

    Rows are ordered by turn (null first), then role and text; repeated rows are turns of their own. Null
    role or text: empty. Null conv_id: a conversation of its own. loss_text: the texts of `loss_role` as read
    back, one after the other; loss_spans: (start, length) in code points, from 0, of these as they stand in
    `formatted`. escaped: turns that needed escapes. A conversation is held by one task, in time and memory
    proportional to its length. Other columns are ignored; an empty table gives no rows.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    plain = F.when(F.instr("text", "<") + F.instr("role", "<") + F.instr("role", "%") + F.instr("role", "\n") == 0, True).otherwise(round_trip(F.col("role"), F.col("text")))
    rows = rows.withColumn("plain", plain)
    role, text = (F.when(F.col("plain"), F.col(c)).otherwise(f(F.col(c))) for c, f in (("role", escape_role), ("text", escape_text)))
    rows = rows.withColumn("said", render_turn(role, text)).withColumn("t", F.length(text))
    # where each turn begins: the same partitioning as the grouping, so no shuffle of its own
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("said").cast("long")).over(before), F.lit(0)))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "at", "t", "said", "plain"))).alias("turns"))
    out = grouped.select("conv_id", "turns", F.array_join(F.transform("turns", lambda t: t["said"]), "").alias("formatted"))
    out = out.withColumn("read", parse(F.col("formatted")))
    same = F.transform("read", lambda x: F.struct(x["role"], x["text"])) == F.transform("turns", lambda x: F.struct(x["role"], x["text"]))
    same = same & F.forall("read", lambda x: x["ok"])
    whole = F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation is not read back as it was")))
    spans = F.transform(F.filter("turns", lambda t: t["role"] == loss_role), lambda t: F.struct((t["at"] + F.length(t["said"]) - t["t"] - len(END) - 1).alias("start"), t["t"].alias("length")))
    return out.select(
        "conv_id", whole.alias("formatted"),
        F.transform("read", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"),
        F.array_join(F.transform(F.filter("read", lambda x: x["role"] == loss_role), lambda x: x["text"]), "").alias("loss_text"),
        spans.alias("loss_spans"), F.size(F.filter("turns", lambda t: ~t["plain"])).alias("escaped"),
    )
