"""Renders conversations with turn marks, and reads them back by a fixed grammar.

    conversation := turn*
    turn         := OPEN role "\\n" text CLOSE "\\n"

A text goes in as it is if it holds no control string and its turn, parsed alone, gives it back;
else its control strings are escaped, and the turn is parsed and compared again: a backslash is put behind their first character, before any
backslashes that stand there already, and reading takes one away. So nothing between OPEN and
CLOSE can be a mark, and each text comes back letter for letter. Roles are percent-encoded.

Every turn is rendered, parsed and compared in its own row; only finished turns are brought
together. The loss mask covers the texts of the roles that are learned.

Defined results: a null text or role is empty; turns stand by (turn, role, text), a null turn
first, and repeated rows are turns of their own; a null conv_id is one conversation; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# The marks of this template and the control strings of the usual ones.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_TAILS = r"\\*(?:\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|</?SYS>>|/?INST\])"
CONTROL = rf"([<\[])({_TAILS})"
_ESCAPED = rf"([<\[])\\({_TAILS})"
LEARNED = ("assistant",)
_PREFIX = len(OPEN)


def escape(text: str | Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2")


def unescape(text: str | Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2")


def _role(piece: Column) -> Column:
    return F.url_decode(F.substring_index(F.substr(piece, F.lit(_PREFIX + 1)), "\n", 1))


def _text(piece: Column) -> Column:
    return unescape(F.substr(piece, F.instr(piece, "\n") + 1))


def turns_of(formatted: str | Column) -> Column:
    """The parser: (role, text) of each turn of a rendered conversation."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.struct(_role(p).alias("role"), _text(p).alias("text")))


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns): turns are (start, length, loss), the code points of each text in
    ``formatted`` and whether the loss covers them."""
    source = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    head = F.concat(F.lit(OPEN), F.url_encode("role"), F.lit("\n"))
    plain = F.concat(head, F.col("text"), F.lit(CLOSE + "\n"))
    said = F.array(F.struct("role", "text"))
    # what the parser does not give back is escaped and parsed again; a turn that still differs fails the job
    escaped = F.concat(head, escape("text"), F.lit(CLOSE + "\n"))
    failed = F.raise_error(F.lit("a turn cannot be read back")).cast("string")
    body = F.when((turns_of(plain) == said) & ~F.col("text").rlike(CONTROL), F.col("text")).when(turns_of(escaped) == said, escape("text")).otherwise(failed)
    tried = source.withColumn("body", body)
    shown = tried.select("*", F.length(head).alias("lead"), F.concat(head, "body", F.lit(CLOSE + "\n")).alias("shown"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = shown.withColumn("at", F.coalesce(F.sum(F.length("shown")).over(order), F.lit(0)))
    turn = F.struct(
        "at", "shown", (F.col("at") + F.col("lead")).alias("start"), F.length("body").alias("length"), F.col("role").isin(*LEARNED).alias("loss")
    )
    gathered = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("all"))
    return gathered.select(
        "conv_id",
        F.array_join(F.transform("all", lambda t: t["shown"]), "").alias("formatted"),
        F.transform("all", lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"), t["loss"].alias("loss"))).alias("turns"),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """Digests of what the parser and the loss mask find in rendered conversations.

    The mask's (start, length) cut each learned text out of ``formatted``: a turn's piece begins where
    the pieces before it end, and the mask is read from there.
    """
    pieces = F.split("formatted", r"<\|im_end\|>\n")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    rows = rendered.select(
        "conv_id", F.length("formatted").alias("chars"), F.posexplode_outer(F.arrays_zip(pieces.alias("piece"), F.col("turns").alias("mask"))).alias("nth", "t")
    ).select("conv_id", "chars", "nth", "t.piece", "t.mask")
    before = Window.partitionBy("conv_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("at", F.coalesce(F.sum(F.length("piece") + len(CLOSE) + 1).over(before), F.lit(0)))
    cut = unescape(F.substr(F.col("piece"), F.col("mask.start") - F.col("at") + 1, F.col("mask.length")))
    learned = F.when(F.col("mask.loss"), cut).otherwise("")
    turn = F.struct("nth", F.concat(_role(F.col("piece")), F.lit("\n"), _text(F.col("piece")), F.lit("\n")).alias("said"), learned.alias("learned"))
    gathered = placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("piece").isNotNull(), turn))).alias("turns"), F.first("chars").alias("chars")
    )
    texts = lambda name: F.array_join(F.transform("turns", lambda t: t[name]), "")
    return gathered.select("conv_id", F.size("turns").cast("long").alias("n_turns"), texts("said").alias("said"), texts("learned").alias("learned"), "chars").select(
        "conv_id",
        "n_turns",
        F.sha2(F.encode("said", "UTF-8"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.encode("learned", "UTF-8"), 256).alias("loss_sha256"),
        F.col("chars").cast("long").alias("formatted_chars"),
    )
