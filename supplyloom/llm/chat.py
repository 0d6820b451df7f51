"""Chat formatting that is proved by reading the result back.

Grammar of the rendered text, one production per turn:

    turn := "<|im_start|>" role "\\n" text "<|im_end|>" "\\n"

The parser is deterministic: a role ends at the first line break, a text at the
first end mark.  Inside, a bar after "<" and backslashes loses one backslash, and
in roles "\\n" stands for a line break and "\\\\" for a backslash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from supplyloom.sources.storage import settle

START, END, BREAK = "<|im_start|>", "<|im_end|>", "\n"
_BAR = re.compile(r"<(\\*)\|")
_ESCAPED_BAR = re.compile(r"<\\(\\*)\|")
_ROLE_MARK = re.compile(r"\\(.)", re.DOTALL)
TRAINED_ROLE = "assistant"


def escape_text(text: str) -> str:
    return _BAR.sub(r"<\\\1|", text)


def unescape_text(text: str) -> str:
    return _ESCAPED_BAR.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape_text(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return _ROLE_MARK.sub(lambda m: "\n" if m[1] == "n" else m[1], unescape_text(role))


class TurnParser:
    """Reads rendered text in pieces of any size.

    ``on_turn`` gets (role, None) when a turn begins, (role, part) for parts of
    its unescaped text, and ("", None) when it ends.  Only text that may belong
    to an unfinished mark is held back, so a turn of any length passes.
    """

    def __init__(self, on_turn: Callable[[str, str | None], None]):
        self.on_turn = on_turn
        self.held = ""
        self.role: str | None = None

    def feed(self, piece: str) -> None:
        self.held += piece
        while self._step():
            pass

    def _step(self) -> bool:
        if self.role is None:
            if not self.held.startswith(START):
                if self.held and not START.startswith(self.held):
                    raise ValueError("no turn begins here")
                return False
            stop = self.held.find(BREAK)
            if stop < 0:
                return False
            self.role = unescape_role(self.held[len(START) : stop])
            self.held = self.held[stop + 1 :]
            self.on_turn(self.role, None)
            return True
        stop = self.held.find(END)
        if stop >= 0:
            if len(self.held) == stop + len(END):
                return False
            if self.held[stop + len(END)] != BREAK:
                raise ValueError("no line break behind a turn")
            self.on_turn(self.role, unescape_text(self.held[:stop]))
            self.held = self.held[stop + len(END) + 1 :]
            self.role = None
            self.on_turn("", None)
            return True
        # Keep what may be the head of a mark or of an escaped bar.
        safe = self.held.rfind("<")
        safe = len(self.held) if safe < 0 else safe
        if safe:
            self.on_turn(self.role, unescape_text(self.held[:safe]))
            self.held = self.held[safe:]
        return False

    def close(self) -> None:
        if self.held or self.role is not None:
            raise ValueError("the text ends inside a turn")


def parse(rendered: str) -> list[tuple[str, str]]:
    """Turns of a whole rendered text."""
    turns: list[list[str]] = []

    def take(role: str, part: str | None) -> None:
        if part is not None:
            turns[-1][1] += part
        elif role or not turns or turns[-1][2] == "ended":
            turns.append([role, "", "open"])
        else:
            turns[-1][2] = "ended"

    # A turn without a role begins like one that ends, so state is kept above.
    reader = TurnParser(take)
    reader.feed(rendered)
    reader.close()
    return [(role, text) for role, text, _ in turns]


def render_turn(role: str | None, text: str | None) -> tuple[str, bool]:
    """(rendered turn, whether anything was escaped); null counts as empty.

    The plain form is tried first.  If its parse differs from the source, the
    role or the text that conflicts is escaped and the result is parsed again.
    """
    role, text = role or "", text or ""
    forms = [(role, text), (role, escape_text(text)), (escape_role(role), text), (escape_role(role), escape_text(text))]
    for k, (r, t) in enumerate(forms):
        rendered = f"{START}{r}{BREAK}{t}{END}{BREAK}"
        try:
            if parse(rendered) == [(role, text)]:
                return rendered, k > 0
        except ValueError:
            continue
    raise ValueError("a turn can't be rendered")


RENDERED = "conv_id long, turn long, role string, segment string, escaped boolean"


def format_conversations(df: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, role, segment (its rendered text), escaped.

    A conversation's rendered text is its segments in the order of turn (nulls
    last), role and segment; joined in that order they follow the grammar.  Turns
    are rendered where they lie, so a conversation may be of any length.  Null
    roles and texts count as empty; rows that repeat a turn number are turns of
    their own; a null conv_id is a conversation; an empty table gives no rows.
    """

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, turn, role, text = batch.columns
            made = [render_turn(r, t) for r, t in zip(role.to_pylist(), text.to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [conv, turn, role, pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.bool_())],
                names=["conv_id", "turn", "role", "segment", "escaped"],
            )

    rows = df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role"), F.col("text"))
    return rows.mapInArrow(render, RENDERED)


DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


class _Reading:
    """Running digests of one conversation while its text is read."""

    def __init__(self, conv: int | None):
        self.conv = conv
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.inside = False
        self.parser = TurnParser(self.take)

    def take(self, role: str, part: str | None) -> None:
        if part is not None:
            data = part.encode("utf-8", "surrogatepass")
            self.turns.update(data)
            if role == TRAINED_ROLE:
                self.loss.update(data)
                self.loss_chars += len(part)
        elif self.inside:
            self.turns.update(b"\n")
            self.inside = False
        else:
            self.inside = True
            self.n_turns += 1
            self.turns.update(role.encode("utf-8", "surrogatepass") + b"\n")

    def feed(self, piece: str) -> None:
        self.formatted_chars += len(piece)
        self.parser.feed(piece)

    def row(self) -> dict:
        self.parser.close()
        return {
            "conv_id": self.conv,
            "n_turns": self.n_turns,
            "turns_sha256": self.turns.hexdigest(),
            "loss_chars": self.loss_chars,
            "loss_sha256": self.loss.hexdigest(),
            "formatted_chars": self.formatted_chars,
        }


def read_conversations(formatted: DataFrame) -> DataFrame:
    """Parse rendered conversations and digest what they hold.

    The loss mask covers the texts of assistant turns.  A digest needs its
    conversation in order, so each is streamed through one task in sorted pieces;
    no more than a batch and an unfinished mark is held, whatever its length.
    """
    schema = pa.schema(
        [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Reading | None = None
        for batch in batches:
            done = []
            for conv, segment in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Reading(conv)
                now.feed(segment)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.row()], schema=schema)

    ordered = formatted.repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last(), "role", "segment"
    )
    return ordered.select("conv_id", "segment").mapInArrow(read, DIGEST)


def chat_digest(df: DataFrame) -> DataFrame:
    """Format all conversations, store the result and read it back."""
    return read_conversations(settle(format_conversations(df), "chat"))
