"""Chat formatting by Spark expressions: sorted turns to one marked string, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the template.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """No mark can occur in the result; `unescape` gives the text again."""
    return F.replace(F.replace(text, F.lit("~"), F.lit("~0")), F.lit("<|"), F.lit("<~1"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<~1"), F.lit("<|")), F.lit("~0"), F.lit("~"))


def _escape_role(role: Column) -> Column:
    """As escape, and the line end that closes a role does not occur either."""
    return F.replace(escape(role), F.lit("\n"), F.lit("~2"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("~2"), F.lit("\n")))


def format_chats(rows: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, segments (text, loss).

    Input columns are conv_id, turn, role, text; others are not read. Turns are
    sorted by turn, equal ones by role and text; adjacent turns of one role
    share a block, in which a mark keeps them apart. `formatted` joins the
    segments; `loss` marks those to learn from, the texts of `learn_role`.

    A null text or role is empty, a null turn comes first, rows without conv_id
    are one conversation, repeated rows are repeated turns, an empty table gives
    no rows. The merge looks at each turn's neighbours instead of folding into
    an accumulator, which would be copied at each of a long conversation's turns.
    """
    turn = F.struct(
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    chats = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    roles = F.transform("turns", lambda t: t["role"])
    none = F.array(F.lit(None).cast("string"))
    count = F.size("turns")
    near = F.arrays_zip(
        F.col("turns").alias("t"),
        F.concat(none, F.slice(roles, 1, count - 1)).alias("before"),
        F.concat(F.slice(roles, 2, count), none).alias("after"),
    )

    def segments(z: Column) -> Column:
        role, text = z["t"]["role"], z["t"]["text"]
        opening = F.when(role.eqNullSafe(z["before"]), F.lit(SEP)).otherwise(F.concat(F.lit(START), _escape_role(role), F.lit("\n")))
        closing = F.when(role.eqNullSafe(z["after"]), F.lit("")).otherwise(F.lit(f"{END}\n"))
        return F.array(_segment(opening, F.lit(False)), _segment(escape(text), role == learn_role), _segment(closing, F.lit(False)))

    made = chats.select("conv_id", F.flatten(F.transform(near, segments)).alias("segments"))
    return made.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def _segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def parse_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and learned (texts) read back from the output."""

    def turns(block: Column) -> Column:
        rest = F.substring(block, len(START) + 1, F.length(block))
        role = F.substring_index(rest, "\n", 1)
        texts = F.split(F.substring(rest, F.length(role) + 2, F.length(rest)), rf"\Q{SEP}\E")
        return F.transform(texts, lambda t: F.struct(_unescape_role(role).alias("role"), unescape(t).alias("text")))

    blocks = F.filter(F.split("formatted", rf"\Q{END}\E\n"), lambda b: b != "")
    learned = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return formatted.select("conv_id", "formatted", F.flatten(F.transform(blocks, turns)).alias("turns"), learned.alias("learned"))


def chat_digests(parsed: DataFrame) -> DataFrame:
    """Counts and digests of what was read back, one row per conversation."""
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    chars = F.aggregate("learned", F.lit(0).cast("long"), lambda n, t: n + F.length(t))
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        chars.alias("loss_chars"),
        F.sha2(F.array_join("learned", ""), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
