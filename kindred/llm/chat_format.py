"""Chat formatting: a state machine over roles and a declarative template.  DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How a turn is written, which roles are learned, and which orders of roles are valid.

    Every mark begins with ``<|``.  Inside roles and texts an opening ``<|`` is escaped: ``<``, any number of ``!`` and
    ``|`` get one more ``!``, which unescaping takes away.  So escaped text never holds a mark, and marks alone
    divide a formatted conversation.
    """

    begin: str = "<|im_start|>"
    role_end: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    learned: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: Mapping[tuple[str, str], str] = field(default_factory=lambda: {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"})
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        if not all(m.startswith("<|") for m in (self.begin, self.role_end, self.end)):
            raise ValueError("marks begin with <|")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(!*)\|", "<!$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<!(!*)\|", "<$1|")


def _run_machine(turns: Column, template: Template) -> Column:
    """struct(state, at, error): the last state, the number of turns, and the first turn that has no move, or -1."""

    def step(acc: Column, turn: Column) -> Column:
        to = F.lit(None).cast("string")
        for (state, role), target in template.moves.items():
            to = F.when((acc["state"] == state) & (turn["role"] == role), target).otherwise(to)
        fails = to.isNull() & (acc["error"] < 0)
        return F.struct(F.coalesce(to, acc["state"]).alias("state"), (acc["at"] + 1).alias("at"), F.when(fails, acc["at"]).otherwise(acc["error"]).alias("error"))

    return F.aggregate(turns, F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("at"), F.lit(-1).alias("error")), step)


def format_chats(rows: DataFrame, template: Template | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, valid, error_turn, formatted, segments) of each conversation; segments are struct(text, loss) in order.

    Turns follow by number, equal numbers by role and text, null first; null roles and texts are empty.  The state
    machine names the first turn out of order (``error_turn``, from 0; null if none); a conversation is valid if there
    is none and it ends in a final state.  Invalid ones are formatted too: the caller decides.  Only the escaped text of
    a learned role has its loss flag set; marks and roles never have.  A null id is a conversation of its own;
    repeated rows are turns like any other; texts of any length are formatted whole; other columns are ignored, whatever
    their names; an empty table gives no rows.

    One shuffle by conversation.  A conversation is one value, so it must fit in a task; nothing else is gathered.
    """
    template = template or Template()
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    chats = rows.select(F.col(id_col).cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    segment = lambda t, loss: F.struct(t.alias("text"), loss.alias("loss"))

    def written(t: Column) -> Column:
        head = F.concat(F.lit(template.begin), escape(t["role"]), F.lit(template.role_end))
        return F.array(segment(head, F.lit(False)), segment(escape(t["text"]), t["role"].isin(*template.learned)), segment(F.lit(template.end), F.lit(False)))

    out = chats.select("conv_id", _run_machine(F.col("turns"), template).alias("machine"), F.flatten(F.transform("turns", written)).alias("segments"))
    ok = (F.col("machine.error") < 0) & F.col("machine.state").isin(*template.final)
    formatted = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return out.select("conv_id", ok.alias("valid"), F.when(F.col("machine.error") >= 0, F.col("machine.error")).alias("error_turn"), formatted.alias("formatted"), "segments")


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """array<struct(role, text)>: the turns of a formatted conversation, unescaped."""
    template = template or Template()
    literal = lambda s: "\\Q" + s + "\\E"
    turns = F.slice(F.split(formatted, literal(template.begin)), 2, 1 << 30)

    def parse(t: Column) -> Column:
        parts = F.split(t, literal(template.role_end))
        body = F.split(F.get(parts, F.lit(1)), literal(template.end))
        return F.struct(unescape(F.get(parts, F.lit(0))).alias("role"), unescape(F.get(body, F.lit(0))).alias("text"))

    return F.transform(turns, parse)


def loss_text(segments: Column) -> Column:
    """What the loss mask covers, unescaped piece by piece."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
