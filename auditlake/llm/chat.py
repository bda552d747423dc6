"""Operator 9, chat formatting by a finite-state machine over roles.

Method: rows of a conversation pass, in turn order, through a machine whose states are the
roles. The template, plain data, names the allowed moves, the pieces that make up a turn, which
roles' texts are learned from, and the control strings. The machine emits segments of text, each
with a loss flag, and says for each turn whether the move into it was allowed. A control string
inside a text or role is broken up by a backslash after its first character, and a backslash is
doubled; reading back undoes both. Conversations are streamed from sorted partitions with
running digests, so that a conversation of any length needs constant memory.

Defined results: null text and null role count as empty; rows with equal turn are ordered by
role and text; a null turn comes first; repeated rows are turns of their own; all rows of a null
conv_id are one conversation; an order of roles that the template does not allow is formatted
all the same and marked by valid = false; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, table_partitions, tune


@dataclass(frozen=True)
class Template:
    """Pieces of a turn in order: ("mark", string), ("role", "") or ("text", "")."""

    pieces: tuple[tuple[str, str], ...]
    moves: dict[str, tuple[str, ...]]  # role before ("" at the start) to the roles that may follow
    ends: tuple[str, ...]  # roles that may end a conversation
    learned: tuple[str, ...]  # roles whose texts are under the loss mask
    controls: tuple[str, ...]  # control strings, each of two characters or more, without a backslash

    def escape(self, text: str) -> str:
        text = text.replace("\\", "\\\\")
        for control in self.controls:
            text = text.replace(control, f"{control[0]}\\{control[1:]}")
        return text

    def escape_role(self, role: str) -> str:
        return self.escape(role).replace("\n", "\\n")

    def pattern(self) -> re.Pattern:
        """A turn; the shortest match is the turn, since its closing marks hold a control string."""
        named = {"role": "(?P<role>[^\n]*?)", "text": "(?P<text>.*?)"}
        return re.compile("".join(named.get(kind) or re.escape(value) for kind, value in self.pieces), re.DOTALL)

    def closing(self) -> str:
        """The marks after the last role or text, as one string."""
        last = max(i for i, (kind, _) in enumerate(self.pieces) if kind != "mark")
        marks = "".join(value for _, value in self.pieces[last + 1 :])
        if not any(control in marks for control in self.controls):
            raise ValueError("the marks that close a turn hold no control string")
        return marks


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|n|)", lambda m: {"\\": "\\", "n": "\n", "": ""}[m[1]], role)


DEFAULT = Template(
    pieces=(("mark", "<|turn|>"), ("role", ""), ("mark", "\n"), ("text", ""), ("mark", "<|end|>"), ("mark", "\n")),
    moves={"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    ends=("assistant",),
    learned=("assistant",),
    controls=("<|turn|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"),
)

_SEGMENT = "conv_id long, place long, turn_no long, segment string, loss boolean, allowed boolean, last_role string"


def _format(batches: Iterator[pa.RecordBatch], template: Template) -> Iterator[pa.RecordBatch]:
    conv, state, place, turn_no = object(), "", 0, 0
    for batch in batches:
        out: list[tuple] = []
        for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if conv_id != conv:
                conv, state, place, turn_no = conv_id, "", 0, 0
            role, text = role or "", text or ""
            allowed = role in template.moves.get(state, ())
            mark = ""
            pieces: list[tuple[str, bool]] = []
            for kind, value in template.pieces:
                if kind == "text" and role in template.learned:
                    pieces += [(mark, False), (template.escape(text), True)]
                    mark = ""
                else:
                    mark += {"mark": value, "role": template.escape_role(role), "text": template.escape(text)}[kind]
            for segment, loss in [*pieces, (mark, False)]:
                out.append((conv_id, place, turn_no, segment, loss, allowed, role))
                place += 1
            state, turn_no = role, turn_no + 1
        columns = list(zip(*out, strict=True)) or [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.string())
        names = [c.split()[0] for c in _SEGMENT.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def format_chats(rows: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Segments of all conversations: conv_id, place, turn_no, segment, loss, allowed, last_role.

    A conversation's formatted text is its segments in the order of place, one after the other.
    """
    spark = tune(rows.sparkSession)
    source = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    ordered = source.repartition(table_partitions(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def emit(batches):
        return _format(batches, template)

    return ordered.mapInArrow(emit, _SEGMENT)


class _Reader:
    """Running digests of one conversation, from its segments' text and loss flags alone.

    Turns are found by the marks: no control string stands inside an escaped text or role, so a turn ends
    where the template's closing marks do. At most one turn is held.
    """

    def __init__(self, conv_id, template: Template):
        self.conv_id, self.template, self.pattern = conv_id, template, template.pattern()
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.valid, self.role, self.held = True, "", ""
        self.closing = template.closing()

    def add(self, segment: str, loss: bool) -> None:
        self.held += segment
        self.chars += len(segment)
        if loss:
            text = unescape(segment)
            self.loss_chars += len(text)
            self.loss.update(text.encode("utf-8", "surrogatepass"))
        elif self.closing in segment:
            while found := self.pattern.match(self.held):
                role = unescape_role(found["role"])
                turn = f"{role}\n{unescape(found['text'])}\n"
                self.turns.update(turn.encode("utf-8", "surrogatepass"))
                self.n_turns += 1
                self.valid = self.valid and role in self.template.moves.get(self.role, ())
                self.role, self.held = role, self.held[found.end() :]

    def row(self) -> tuple:
        if self.held:
            raise ValueError(f"conversation {self.conv_id} does not end with a whole turn")
        valid = self.valid and self.role in self.template.ends
        return self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, valid


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def _digest(batches: Iterator[pa.RecordBatch], template: Template) -> Iterator[pa.RecordBatch]:
    reader = None
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    names = [c.split()[0] for c in _DIGEST.split(", ")]

    def rows(done):
        columns = list(zip(*done, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for batch in batches:
        done = []
        columns = ("conv_id", "segment", "loss")
        for conv_id, *rest in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if reader is None or reader.conv_id != conv_id:
                if reader is not None:
                    done.append(reader.row())
                reader = _Reader(conv_id, template)
            reader.add(*rest)
        yield rows(done)
    if reader is not None:
        yield rows([reader.row()])


def read_back(segments: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Per conversation, from its segments alone: turns, learned text and their digests."""
    spark = tune(segments.sparkSession)
    source = segments.select("conv_id", "place", "segment", "loss")
    ordered = source.repartition(table_partitions(spark), "conv_id").sortWithinPartitions("conv_id", "place")

    def digest(batches):
        return _digest(batches, template)

    return ordered.mapInArrow(digest, _DIGEST)


def op9_chat_formatting(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(materialise(format_chats(rows.unionByName(more)), "segments"))
