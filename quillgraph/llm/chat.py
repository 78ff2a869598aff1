"""Chat formatting with a grammar round trip.

A turn is rendered as  <|im_start|>ROLE \n TEXT <|im_end|> \n  and a conversation as its turns one after another.  A
deterministic parser reads rendered text back.  In the grammar, `<` followed by k >= 1 backslashes and `|` stands for
`<`, k - 1 backslashes and `|`; a bare `<|` only begins a control string.  Each field is rendered as it is, parsed back
and compared with its source; where it differs, conflicting content gets one more backslash and the check is repeated,
until both are identical.  Escaping is a bijection, so one step is enough, and text without conflicts stays as it is.

Rendering and the round trip run row by row, and give the span of each text, so that a loss mask can be laid over the
rendered conversation.  Only digests need the turns of a conversation in order, and these are streamed over sorted rows
without holding a conversation.  A chained digest cannot be split, so the hashing alone (not
the rendering) of one very long conversation stays in one task.

Defined results: a null role or text is an empty one; turns are ordered by turn (null first), then role and text, so
ties have a fixed order; a null conv_id is one conversation; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_type, out_batch, prepare

START, END = "<|im_start|>", "<|im_end|>"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
RENDERED = "conv_id long,turn long,rendered string,text_start long,text_end long,raw_role string,raw_text string"
DIGESTS = "conv_id long,n_turns long,turns_sha256 string,loss_chars long,loss_sha256 string,formatted_chars long"


class GrammarError(ValueError):
    """Rendered text that the grammar does not allow."""


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def render_turn(role: str, text: str) -> str:
    return f"{START}{role}\n{text}{END}\n"


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """The turns of rendered text: role, text, and the span of the (still escaped) text."""
    turns, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(START, at):
            raise GrammarError(f"no turn begins at {at}")
        head = at + len(START)
        line = rendered.find("\n", head)
        if line < 0 or "<|" in rendered[head:line]:
            raise GrammarError(f"the role at {head} has no end")
        stop = rendered.find("<|", line + 1)
        if stop < 0 or not rendered.startswith(END + "\n", stop):
            raise GrammarError(f"the text at {line + 1} has no end")
        turns.append((unescape_role(rendered[head:line]), unescape(rendered[line + 1 : stop]), line + 1, stop))
        at = stop + len(END) + 1
    return turns


_ROLE_WRITE, _ROLE_READ = re.compile(r"\\|\n|(?<=<)\|"), re.compile(r"\\([\\n|])")


def escape_role(role: str) -> str:
    r"""A role ends at a line feed: backslash, line feed and the | of <| are written as \\, \n and \|."""
    return _ROLE_WRITE.sub(lambda m: "\\n" if m[0] == "\n" else "\\" + m[0], role)


def unescape_role(role: str) -> str:
    return _ROLE_READ.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def round_trip(role: str, text: str) -> str:
    """The rendered turn whose parse is identical to its source; only what conflicts is escaped."""
    safe_role, safe_text = role, text
    while True:
        rendered = render_turn(safe_role, safe_text)
        try:
            got = parse(rendered)
        except GrammarError:
            got = []
        if len(got) == 1 and got[0][:2] == (role, text):
            return rendered
        if parses_to(safe_text, text) is False:
            safe_text = escape(text)
        elif safe_role == role:
            safe_role = escape_role(role)
        else:
            raise GrammarError("the turn cannot be rendered")


def parses_to(rendered_text: str, text: str) -> bool:
    """Whether a text between two control strings reads back as it should."""
    return "<|" not in rendered_text and unescape(rendered_text) == text


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_type(RENDERED)
    for batch in batches:
        rows = []
        for role, text in zip(*([x or "" for x in batch.column(i).to_pylist()] for i in (2, 3))):
            rendered = round_trip(role, text)
            _, _, start, end = parse(rendered)[0]
            plain = rendered == render_turn(role, text)
            rows.append((rendered, start, end, None if plain else role, None if plain else text))
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[2:])] if rows else [pa.array([], f.type) for f in list(schema)[2:]]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], schema=schema)


def render(conversations: DataFrame) -> DataFrame:
    """A row per turn: conv_id, turn, rendered, and the span of its text in rendered (text_start, text_end).

    A conversation's rows in order (see `in_order`) are its text.  raw_role and raw_text are set where something was escaped.
    """
    prepare(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(_render, RENDERED)


def in_order() -> list:
    """Turn, role and text of rendered turns, as they were before escaping."""
    head = F.instr("rendered", "\n")
    role = F.coalesce("raw_role", F.substring("rendered", F.lit(len(START) + 1), head - len(START) - 1))
    text = F.coalesce("raw_text", F.substring("rendered", head + 1, F.length("rendered") - head - len(END) - 1))
    return [F.col("turn").asc_nulls_first(), role, text]


class Digest:
    """What is read back of one conversation, turn by turn."""

    def __init__(self, conv: int | None, learned: frozenset[str]):
        self.conv, self.learned = conv, learned
        self.turns = self.loss_chars = self.chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, rendered: str) -> None:
        self.chars += len(rendered)
        for role, text, _, _ in parse(rendered):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
            if role in self.learned:
                self.loss_chars += len(text)
                self.loss.update(text.encode())

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def formatted(rendered: DataFrame, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """A row per turn: conv_id, place (from 0), rendered, and the spans of the turn and of what is learned in the conversation's text.

    learned_start and learned_end are null for turns of other roles.
    """
    order = Window.partitionBy("conv_id").orderBy(*in_order())
    before = F.coalesce(F.sum(F.length("rendered")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    rows = rendered.withColumn("role", in_order()[1]).withColumn("start", before).withColumn("place", (F.row_number().over(order) - 1).cast("long"))
    mask = F.col("role").isin(*learned)
    return rows.select(
        "conv_id", "place", "rendered", "start", (F.col("start") + F.length("rendered")).alias("end"),
        F.when(mask, F.col("start") + F.col("text_start")).alias("learned_start"), F.when(mask, F.col("start") + F.col("text_end")).alias("learned_end"),
    )


def _digests(batches: Iterator[pa.RecordBatch], learned: frozenset[str]) -> Iterator[pa.RecordBatch]:
    schema = arrow_type(DIGESTS)
    now: Digest | None = None
    for batch in batches:
        rows = []
        for conv, rendered in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if now is None or now.conv != conv:
                if now is not None:
                    rows.append(now.row())
                now = Digest(conv, learned)
            now.add(rendered)
        if rows:
            yield out_batch(schema, **dict(zip(schema.names, zip(*rows))))
    if now is not None:
        yield out_batch(schema, **dict(zip(schema.names, zip(now.row()))))


def read_back(rendered: DataFrame, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """A row per conversation from its rendered turns: counts and digests of the turns and of the text under the loss mask."""
    needed = rendered.select("conv_id", "turn", "rendered", "raw_role", "raw_text")
    together = needed.repartition("conv_id").sortWithinPartitions("conv_id", *in_order())
    return together.mapInArrow(partial(_digests, learned=frozenset(learned)), DIGESTS)
