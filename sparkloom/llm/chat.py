"""Chat formatting: a finite-state machine over roles, a declarative template, segments with loss flags.

The template marks turns by control strings. Inside texts and roles, a control string is broken up by an escape mark
after its first character, and one that is already broken up gets one mark more, so unescaping is exact and a text can
never close a turn or open one. Rows are sorted by conversation and turn, and each conversation streams through its
task row by row: nothing is gathered, whatever its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import prepare

#: Marks that break up a control string: the word joiner, which shows as nothing.
MARK = "\u2060"


@dataclass(frozen=True)
class Template:
    """How turns are written, and which turn orders are valid.

    A turn is `open`, the role, `middle`, the text, `close`. `next_roles` maps a state (the role before, '' at the
    start) to the roles that may follow; `final` holds the states a conversation may end in; `loss` the roles whose
    texts are trained on. Control strings must start with a character that no control string holds later on, and must
    not hold the mark.
    """

    begin: str = "<s>"
    open: str = "[INST:"
    middle: str = "]"
    close: str = "[/INST]"
    end: str = "</s>"
    #: Strings that are escaped too, as models of other templates obey them.
    reserved: tuple[str, ...] = ("[INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
    next_roles: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    final: tuple[str, ...] = ("assistant",)
    loss: tuple[str, ...] = ("assistant",)

    def controls(self) -> tuple[str, ...]:
        return (self.begin, self.open, self.close, self.end, *self.reserved)

    def checked(self) -> Template:
        heads = {c[0] for c in self.controls()}
        for c in self.controls():
            if len(c) < 2 or MARK in c or heads & set(c[1:]):
                raise ValueError(f"{c!r} can't be a control string")
        if not self.middle or MARK in self.middle or heads & set(self.middle):
            raise ValueError("middle must hold neither a mark nor the start of a control string")
        return self

    def codec(self) -> Codec:
        return Codec(self.checked())


class Codec:
    """Writes and reads texts of one template."""

    def __init__(self, template: Template):
        self.template = template
        controls = "|".join(f"{re.escape(c[0])}(?={{0}}{re.escape(c[1:])})" for c in sorted(template.controls(), key=len, reverse=True))
        self._put = re.compile(controls.format(f"{MARK}*"))
        self._drop = re.compile(controls.format(f"{MARK}+"))
        self._heads = {c[0] for c in template.controls()}

    def escape(self, text: str) -> str:
        return self._put.sub(lambda m: m[0] + MARK, text) if any(h in text for h in self._heads) else text

    def unescape(self, text: str) -> str:
        if MARK not in text:
            return text
        out, at = [], 0
        for m in self._drop.finditer(text):
            out.append(text[at : m.end()])
            at = m.end() + 1
        return "".join(out) + text[at:]

    def escape_role(self, role: str) -> str:
        """A role may not hold `middle` either: percent signs and the first character of `middle` are written as codes."""
        role = role.replace("%", "%25").replace(self.template.middle[0], f"%{ord(self.template.middle[0]):x};")
        return self.escape(role)

    def unescape_role(self, role: str) -> str:
        code = f"%{ord(self.template.middle[0]):x};"
        return re.sub(f"{re.escape(code)}|%25", lambda m: "%" if m[0] == "%25" else self.template.middle[0], self.unescape(role))


_SEGMENTS = "conv_id long, seq long, kind string, text string, loss boolean, valid boolean"


def _format(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, t = template.codec(), template
        current, state, valid, seq, open_ = None, "", True, 0, False
        out: list[list] = [[] for _ in range(6)]
        chars = 0

        def put(kind: str, text: str, loss: bool = False) -> None:
            nonlocal seq, chars
            for column, value in zip(out, (current, seq, kind, text, loss, valid), strict=True):
                column.append(value)
            seq += 1
            chars += len(text)

        def batch_out() -> pa.RecordBatch:
            nonlocal out, chars
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_())
            arrays = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            out, chars = [[] for _ in range(6)], 0
            return pa.RecordBatch.from_arrays(arrays, names=["conv_id", "seq", "kind", "text", "loss", "valid"])

        def finish() -> None:
            nonlocal valid
            valid = valid and state in t.final
            put("end", t.end)

        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if not open_ or conv != current:
                    if open_:
                        finish()
                    current, state, valid, seq, open_ = conv, "", True, 0, True
                    put("begin", t.begin)
                role, text = role or "", text or ""
                valid = valid and role in t.next_roles.get(state, ())
                state = role
                put("role", f"{t.open}{codec.escape_role(role)}{t.middle}")
                put("text", codec.escape(text), role in t.loss)
                put("close", t.close)
                if chars > 1 << 20:
                    yield batch_out()
        if open_:
            finish()
        if out[0]:
            yield batch_out()

    return run


def format_conversations(rows: DataFrame, template: Template | None = None, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Text segments of each conversation, in order: `conv_id`, `seq`, `kind`, `text`, `loss`, `valid`.

    The conversation is the concatenation of its segments' texts by `seq`. `loss` marks what is trained on; `valid` says
    whether the turn order was valid so far (on the last segment: altogether).

    Defined results: a null text or role counts as empty (an empty role is never valid); turns that tie are ordered by
    role, then text, nulls first; a null turn comes first, a null id is a conversation of its own; repeated rows are
    turns of their own; conversations of any roles and lengths are formatted, valid or not; other columns are not read.
    Rows stay sorted within partitions, one conversation in one of them.
    """
    prepare(rows.sparkSession)
    rows = rows.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")
    )
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(_format((template or Template()).checked()), _SEGMENTS)


class Reader:
    """Reads formatted conversations back from their characters and the loss mask, piece by piece.

    Control strings cannot occur inside a written role or text, so the next one found is the one that ends what is being
    read. Only the open turn is held. Raises ValueError at what the template cannot have written.
    """

    def __init__(self, template: Template):
        self.t, self.codec = template, template.codec()
        self.start()

    def start(self) -> None:
        self.rest, self.want, self.done = "", "begin", False
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0
        self.masked: list[str] = []

    def _end_of_mask(self) -> None:
        """What lies under an unbroken stretch of the mask is text as it was written."""
        if self.masked:
            plain = self.codec.unescape("".join(self.masked))
            self.loss.update(plain.encode())
            self.loss_chars += len(plain)
            self.masked = []

    def _upto(self, mark: str) -> str | None:
        at = self.rest.find(mark)
        if at < 0:
            return None
        got, self.rest = self.rest[:at], self.rest[at + len(mark) :]
        return got

    def feed(self, piece: str, masked: bool) -> None:
        self.chars += len(piece)
        if masked:
            self.masked.append(piece)
        elif piece:
            self._end_of_mask()
        self.rest += piece
        t = self.t
        while self.rest and not self.done:
            if self.want == "begin":
                if len(self.rest) < len(t.begin):
                    return
                if not self.rest.startswith(t.begin):
                    raise ValueError("a conversation does not begin as the template does")
                self.rest, self.want = self.rest[len(t.begin) :], "turn"
            elif self.want == "turn":
                if self.rest.startswith(t.open):
                    self.rest, self.want = self.rest[len(t.open) :], "role"
                elif self.rest.startswith(t.end):
                    self.rest, self.done = self.rest[len(t.end) :], True
                elif t.open.startswith(self.rest) or t.end.startswith(self.rest):
                    return
                else:
                    raise ValueError("there is text between turns")
            else:
                got = self._upto(t.middle if self.want == "role" else t.close)
                if got is None:
                    return
                plain = self.codec.unescape_role(got) if self.want == "role" else self.codec.unescape(got)
                self.turns.update((plain + "\n").encode())
                self.n += self.want == "role"
                self.want = "text" if self.want == "role" else "turn"
        if self.rest:
            raise ValueError("there is text behind the end")


def _read(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
        reader = Reader(template)
        for batch in batches:
            out: list[list] = [[] for _ in names]
            cols = (batch.column(c).to_pylist() for c in ("conv_id", "text", "loss", "valid"))
            for conv, text, masked, valid in zip(*cols, strict=True):
                reader.feed(text, masked)
                if reader.done:
                    reader._end_of_mask()
                    row = (conv, reader.n, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars, valid)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    reader.start()
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)
        if reader.chars:
            raise ValueError("a conversation does not end as the template does")

    return run


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests of conversations, read back from the characters that `format_conversations` wrote, in their partitions and order.

    Turns and roles are found in the concatenated text by the template's control strings, and what is trained on by the
    loss mask alone; the kind of a segment is not looked at.
    """
    return segments.select("conv_id", "text", "loss", "valid").mapInArrow(
        _read((template or Template()).checked()),
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean",
    )


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    return spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
