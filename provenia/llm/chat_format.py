"""Chat formatting by a grammar round trip; DataFrame functions only.

Grammar of a rendered conversation (terminals quoted):

    conversation = { turn }
    turn         = "[INST]" text "[/INST]"              role user
                 | "<s>" text "</s>"                    role assistant
                 | "<<SYS>>" text "<</SYS>>"            role system
                 | "<<ROLE:" hex ">>" text "<</ROLE>>"  any other role, by the hex digits of its UTF-8 bytes

The parser takes the leftmost opening terminal and the text up to the first matching closing one, so it is
deterministic; a text that holds a terminal itself is no text of the grammar. Where that is so, or turns differ, such
conversations are rendered again with escaped texts, and the turns come back identical.

Escape: a terminal's first character, any backslashes and the terminal's rest get one more backslash after the
first character; unescaping takes one away. Both are exact inverses on every text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_REST = r"(?=/?INST\]|/?s>|</?SYS>>|<ROLE:[0-9A-F]*>>|</ROLE>>)"
_TERMINAL = r"\[/?INST\]|</?s>|<</?SYS>>|<<ROLE:[0-9A-F]*>>|<</ROLE>>"
_TURN = r"(?s)\[INST\](.*?)\[/INST\]|<s>(.*?)</s>|<<SYS>>(.*?)<</SYS>>|<<ROLE:([0-9A-F]*)>>(.*?)<</ROLE>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _REST, r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _REST, r"$1$2")


def render_turn(role: Column, text: Column) -> Column:
    """A turn; ``text`` is taken as it is."""
    return (
        F.when(role == "user", F.concat(F.lit("[INST]"), text, F.lit("[/INST]")))
        .when(role == "assistant", F.concat(F.lit("<s>"), text, F.lit("</s>")))
        .when(role == "system", F.concat(F.lit("<<SYS>>"), text, F.lit("<</SYS>>")))
        .otherwise(F.concat(F.lit("<<ROLE:"), F.hex(F.encode(role, "UTF-8")), F.lit(">>"), text, F.lit("<</ROLE>>")))
    )


def parse(formatted: Column) -> Column:
    """array<struct<role, text, raw, clean>> of the turns, texts unescaped; raw: each turn as it stands; clean: no terminal in its text."""

    def turn(raw: Column) -> Column:
        role = (
            F.when(raw.startswith("[INST]"), "user")
            .when(raw.startswith("<s>"), "assistant")
            .when(raw.startswith("<<SYS>>"), "system")
            .otherwise(F.decode(F.unhex(F.regexp_extract(raw, r"^<<ROLE:([0-9A-F]*)>>", 1)), "UTF-8"))
        )
        opening = F.length(F.regexp_extract(raw, r"^(\[INST\]|<s>|<<SYS>>|<<ROLE:[0-9A-F]*>>)", 1))
        closing = F.when(raw.startswith("[INST]"), 7).when(raw.startswith("<s>"), 4).when(raw.startswith("<<SYS>>"), 8).otherwise(9)
        text = F.substring(raw, opening + F.lit(1), F.length(raw) - opening - closing)
        return F.struct(role.alias("role"), unescape(text).alias("text"), raw.alias("raw"), (~text.rlike(_TERMINAL)).alias("clean"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0)), turn)


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, turns, escapes, read back from ``formatted`` alone but for the id.

    turns: array<struct<role, text, raw, clean>>; escapes: 1 where the texts
    had to be escaped, else 0. Turns are
    ordered by number, then role, then text, so ties and repeated rows have one order; a repeated row is a turn of
    its own. Null texts and roles count as empty; a null turn number comes first; null conversation ids form one
    conversation. Texts of any length are formatted whole. Other columns are ignored. No rows give no rows. A conversation that does not come back
    identical raises an error rather than yielding a wrong mask.
    """
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    one = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    chats = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("source"))
    pairs = lambda t: F.transform(t, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    same = (F.concat_ws("", F.transform("turns", lambda x: x["raw"])) == F.col("formatted")) & F.forall("turns", lambda x: x["clean"]) & (pairs(F.col("turns")) == pairs(F.col("source")))

    def attempt(df: DataFrame, how: Callable[[Column], Column]) -> DataFrame:
        """Render and reparse the conversations that have not come back identical yet."""
        text = F.concat_ws("", F.transform("source", lambda x: render_turn(x["role"], how(x["text"]))))
        df = df.withColumn("formatted", F.when(F.col("same"), F.col("formatted")).otherwise(text))
        df = df.withColumn("turns", F.when(F.col("same"), F.col("turns")).otherwise(parse(F.col("formatted"))))
        df = df.withColumn("escapes", F.when(F.col("same"), F.col("escapes")).otherwise(F.col("escapes") + 1))
        return df.withColumn("same", same)

    kind = "array<struct<role:string,text:string,raw:string,clean:boolean>>"
    out = chats.withColumns({"formatted": F.lit(""), "turns": F.lit(None).cast(kind), "escapes": F.lit(-1), "same": F.lit(False)})
    out = attempt(attempt(out, lambda t: t), escape)  # one depth always suffices: an escaped text holds no terminal
    broken = F.raise_error(F.concat(F.lit("turns do not come back identical: conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    return out.select("conv_id", "formatted", F.when(F.col("same"), F.col("turns")).otherwise(broken.cast(kind)).alias("turns"), "escapes")
