"""Chat formatting: a finite-state machine over roles and a declarative template.

The machine reads the roles of a conversation in turn order and says whether the order is
valid and where it first fails. The template is data: for each role the strings before and
after a turn, and whether its text counts for the loss. Every conversation is formatted,
valid or not, as segments of text with a loss flag each.

Control strings begin with ``<`` or ``[``. Inside texts a backslash follows each of these
two signs, and another one each backslash, so no text holds a control string; taking these
backslashes out again gives back the text.

All of it is column expressions. The result of a conversation is one string by nature, so
its turns meet in one row; conversations are spread by id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    before: str
    after: str
    loss: bool = False


#: The turns of the known roles. The loss covers texts only, never control strings. Each of
#: these has one ``<`` or ``[``, its first sign.
TEMPLATE = {
    "system": Turn("<SYS>", "</SYS>"),
    "user": Turn("[INST]", "[/INST]"),
    "assistant": Turn("<s>", "</s>", loss=True),
}
#: Any other role is written out between the first two strings.
OTHER = ("[ROLE]", "[/ROLE]", "[/TURN]")

#: The machine: for each state the state after a role; what isn't listed is a fault.
MACHINE = {
    "start": {"system": "instructed", "user": "asked"},
    "instructed": {"user": "asked"},
    "asked": {"assistant": "answered"},
    "answered": {"user": "asked"},
}
START, FINAL, FAULT = "start", ("answered",), "fault"


def escape(text: Column) -> Column:
    for sign in ("\\", "<", "["):
        text = F.replace(text, F.lit(sign), F.lit(f"{sign}\\"))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[])\\", "$1")


def _known(role: Column, pick) -> Column:
    """By role what ``pick`` takes from its turn; null for other roles."""
    column = F.lit(None)
    for name, turn in TEMPLATE.items():
        column = F.when(role == name, pick(turn)).otherwise(column)
    return column


def _segments(turn: Column) -> Column:
    """A turn as segments ``text, loss``: what opens it, its text, what closes it."""
    role, text = turn["role"], turn["text"]
    opened = F.coalesce(
        _known(role, lambda t: F.lit(t.before)), F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1]))
    )
    closed = F.coalesce(_known(role, lambda t: F.lit(t.after)), F.lit(OTHER[2]))
    loss = F.coalesce(_known(role, lambda t: F.lit(t.loss)), F.lit(False))
    return F.array(
        F.struct(opened.alias("text"), F.lit(False).alias("loss"), F.lit(False).alias("content")),
        F.struct(escape(text).alias("text"), loss.alias("loss"), F.lit(True).alias("content")),
        F.struct(closed.alias("text"), F.lit(False).alias("loss"), F.lit(False).alias("content")),
    )


def _states(roles: Column) -> Column:
    """The state after each turn, by running the machine."""
    def step(path: Column, role: Column) -> Column:
        now = F.element_at(path, -1)
        after = F.lit(FAULT)
        for state, moves in MACHINE.items():
            for name, then in moves.items():
                after = F.when((now == state) & (role == name), then).otherwise(after)
        return F.concat(path, F.array(after))

    return F.slice(F.aggregate(roles, F.array(F.lit(START)), step), 2, F.greatest(F.size(roles), F.lit(1)))


def format_chats(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``conv_id, valid, first_fault, segments, formatted``, one row per conversation.

    Rows are ordered by turn (null first), then by role and text, so ties and repeated
    rows have one order; repeated rows are turns of their own. Null texts and roles are
    empty ones; an empty or unknown role is a fault to the machine and is written out in
    the output. ``valid`` conversations end in a final state without a fault;
    ``first_fault`` is the place of the first turn out of order (from 0), null if there
    is none. ``segments`` is an array of ``text, loss, content``, where ``content`` marks
    the (escaped) texts of turns, and ``formatted`` their concatenation. Rows without an
    id are one conversation without an id. Other columns are not read. An empty table
    gives none.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(
        F.col(id_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text")).alias("row"),
    )
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("turns"))
    stated = chats.withColumn("states", _states(F.col("turns.role")))
    fault = F.array_position("states", FAULT)
    return stated.select(
        "conv_id",
        ((fault == 0) & F.element_at("states", -1).isin(*FINAL)).alias("valid"),
        F.when(fault > 0, fault - 1).alias("first_fault"),
        F.flatten(F.transform("turns", _segments)).alias("segments"),
    ).withColumn("formatted", F.array_join("segments.text", ""))


def cut_at_controls(formatted: Column) -> Column:
    """A formatted conversation cut before every control sign, one that no backslash
    follows: the pieces are the control strings, each with what follows it."""
    return F.split(formatted, r"(?=[<\[](?!\\))")


def read_back(pieces: str) -> Column:
    """The turns ``role, text, loss`` of a formatted conversation, from the column with
    the ``pieces`` that it is cut into."""
    begins = lambda piece, string: F.startswith(piece, F.lit(string))
    rest = lambda piece, string: unescape(F.substring(piece, len(string) + 1, 2**31 - 1))

    def turn(piece: Column, i: Column) -> Column:
        # of another role, the piece before the text's has the role
        role, text, loss = rest(F.get(pieces, i - 1), OTHER[0]), rest(piece, OTHER[1]), F.lit(False)
        opens = begins(piece, OTHER[1])
        for name, t in TEMPLATE.items():
            here = begins(piece, t.before)
            role = F.when(here, name).otherwise(role)
            text = F.when(here, rest(piece, t.before)).otherwise(text)
            loss = F.when(here, t.loss).otherwise(loss)
            opens = opens | here
        return F.when(opens, F.struct(role.alias("role"), text.alias("text"), loss.alias("loss")))

    return F.filter(F.transform(pieces, turn), lambda t: t.isNotNull())


def chat_digests(formatted: DataFrame) -> DataFrame:
    """The contract's figures of each conversation, from the turns read back out of
    ``formatted``."""
    turns = formatted.select(
        "conv_id", "valid", "first_fault", "formatted", cut_at_controls(F.col("formatted")).alias("pieces")
    ).withColumn("turns", read_back("pieces"))
    lost = F.array_join(F.filter("turns", lambda t: t["loss"])["text"], "")
    written = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(written.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(lost).cast("long").alias("loss_chars"), F.sha2(lost.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "valid", "first_fault",
    )
