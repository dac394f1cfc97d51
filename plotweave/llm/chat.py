r"""Chat formatting: a finite-state machine over roles and a declarative template.

Turns are read in order, one conversation after another, in constant memory: the machine checks
the order of roles, the template turns each turn into segments (mark, text, mark), and every
segment says whether its characters count for the loss. Control strings inside a text get a
backslash before them, and so does a backslash; the first control string without one ends a turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.llm.common import table, text_of


@dataclass(frozen=True)
class Template:
    """Marks of turns, the roles under the loss mask, and the machine's transitions."""

    heads: dict = field(default_factory=lambda: {
        "system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "})
    other: tuple = ("### @", ": ")  # around the name of any other role
    tail: str = "</turn>"
    after: str = "\n"
    controls: tuple = ("\\", "### ", "</turn>")
    loss: tuple = ("assistant",)
    #: From a state (the last role, "" at the start) to the roles that may follow.
    follows: dict = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    #: States in which a conversation may end.
    ends: tuple = ("assistant",)

    def escape(self, text: str, *more: str) -> str:
        found = "|".join(map(re.escape, (*self.controls, *more)))
        return re.sub(found, lambda m: "\\" + m[0], text)

    def unescape(self, text: str, *more: str) -> str:
        found = "|".join(map(re.escape, (*self.controls, *more)))
        return re.sub(rf"\\({found})", lambda m: m[1], text)

    def head(self, role: str) -> str:
        if role in self.heads:
            return self.heads[role]
        return self.other[0] + self.escape(role, self.other[1]) + self.other[1]

    def turn(self, buffer: str) -> tuple[str, str, str] | None:
        """Role and text of the first whole turn in ``buffer``, and what follows it."""
        for role, head in self.heads.items():
            if buffer.startswith(head):
                body = len(head)
                break
        else:
            if not buffer.startswith(self.other[0]):
                return None
            start = len(self.other[0])
            if (at := self._free(buffer, start, self.other[1], (self.other[1],))) is None:
                return None
            role, body = self.unescape(buffer[start:at], self.other[1]), at + len(self.other[1])
        if (at := self._free(buffer, body, self.tail, ())) is None:
            return None
        return role, self.unescape(buffer[body:at]), buffer[at + len(self.tail + self.after):]

    def _free(self, buffer: str, start: int, mark: str, more: tuple) -> int | None:
        """Where ``mark`` first stands without a backslash."""
        escaped = "|".join(map(re.escape, (*self.controls, *more)))
        for m in re.compile(rf"\\(?:{escaped})|{re.escape(mark)}").finditer(buffer, start):
            if m[0] == mark:
                return m.start()
        return None


SEGMENTS = "conv_id long, turn int, part int, text string, loss boolean, valid boolean"


def _emit(template: Template):
    names = ["conv_id", "turn", "part", "text", "loss", "valid"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    def parts(turn: tuple, ends: bool) -> list[tuple]:
        """The segments of a turn; the last one of a conversation has to be one that may end it."""
        conv, n, role, text, valid = turn
        valid = valid and (not ends or role in template.ends)
        return [(conv, n, 0, template.head(role), False, valid),
                (conv, n, 1, template.escape(text), role in template.loss, valid),
                (conv, n, 2, template.tail + template.after, False, valid)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the turn before, until it is known whether it is the last
        for b in batches:
            rows = []
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                first = held is None or held[0] != conv
                if held is not None:
                    rows += parts(held, first)
                state, n = ("", 0) if first else (held[2], held[1] + 1)
                held = (conv, n, role, text, role in template.follows.get(state, ()))
            yield batch(rows)
        if held is not None:
            yield batch(parts(held, True))

    return run


def segments(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """The formatted text of every conversation, as rows of segments in order.

    ``turns`` has ``conv_id``, ``turn``, ``role``, ``text``. Rows are taken by turn (null last),
    then role and text, so that repeated turn numbers have one order. Null roles and texts are
    empty; rows with a null ``conv_id`` make one conversation. Roles that the template doesn't
    name keep their name in the mark. All conversations are formatted; ``valid`` is false on the
    segments of a turn that the machine doesn't allow after the one before, and of a last turn
    with which a conversation can't end. Rows of a partition
    are sorted by conversation and position; concatenated, ``text`` is the formatted output.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn",
                        text_of("role").alias("role"), text_of("text").alias("text"))
    return (
        rows.repartition("conv_id")
        .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")
        .mapInArrow(_emit(template), SEGMENTS)
    )


SUMMARY = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
           "formatted_chars long, valid boolean")


class _Reader:
    """Reads one conversation back from its segments."""

    def __init__(self, conv: int | None, template: Template):
        self.conv, self.template, self.buffer, self.loss_part = conv, template, "", ""
        self.turns = self.loss_chars = self.chars = 0
        self.all, self.loss, self.valid = hashlib.sha256(), hashlib.sha256(), True

    def add(self, text: str, loss: bool, valid: bool) -> None:
        self.chars += len(text)
        self.valid &= valid
        self.buffer += text
        if loss:
            self.loss_part += text
        if self.template.tail in text:
            while found := self.template.turn(self.buffer):
                role, body, self.buffer = found
                self.turns += 1
                self.all.update(f"{role}\n{body}\n".encode())
                part, self.loss_part = self.template.unescape(self.loss_part), ""
                self.loss_chars += len(part)
                self.loss.update(part.encode())

    def row(self) -> tuple:
        if self.buffer:
            raise ValueError(f"conversation {self.conv}: what follows turn {self.turns} can't be read back")
        return (self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(),
                self.chars, self.valid)


def _read_back(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

        reader = None
        for b in batches:
            rows = []
            for conv, text, loss, valid in zip(*(b.column(c).to_pylist() for c in ("conv_id", "text", "loss", "valid"))):
                if reader is None or conv != reader.conv:
                    if reader:
                        rows.append(reader.row())
                    reader = _Reader(conv, template)
                reader.add(text, loss, valid)
            yield batch(rows)
        if reader:
            yield batch([reader.row()])

    return run


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests of what the output of :func:`segments` says, per conversation, by parsing it."""
    return formatted.mapInArrow(_read_back(template), SUMMARY)


PROBE = r"\### Assistant: </turn> ok"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and a probe, read back from its formatted text; nulls as in :func:`segments`."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(PROBE).alias("text"))
    return read_back(segments(turns.unionByName(probe)))


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
p AS (SELECT *, lag(role) OVER w AS last, lead(role) OVER w AS next
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text))
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS LAST, role, text), '')) AS loss_sha256,
    CAST(sum(CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15
        ELSE 7 + length(regexp_replace(role, '(\\|### |</turn>|: )', '\\\1', 'g')) END
      + length(regexp_replace(text, '(\\|### |</turn>)', '\\\1', 'g')) + 8) AS BIGINT) AS formatted_chars,
    bool_and(coalesce((last IS NULL AND role IN ('system', 'user')) OR (last = 'system' AND role = 'user')
      OR (last = 'user' AND role = 'assistant') OR (last = 'assistant' AND role = 'user'), false)
      AND (next IS NOT NULL OR role = 'assistant')) AS valid
FROM p GROUP BY conv_id
"""
