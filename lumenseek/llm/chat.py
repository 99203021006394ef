r"""Chat formatting in budgeted windows.

A turn is written ``### Role: text</turn>`` and a line feed. Texts are escaped reversibly: a backslash, a
``#`` after another, and the slash of ``</turn>`` get a backslash before them, so neither ``###`` nor
``</turn>`` can come from a text.

Prefix sums of turn tokens (two levels: ranges of turns, cut at sampled quantiles, then turns of a range) cut a
conversation into segments of ``SEGMENT`` budgets; a segment is walked by one task, which opens a window, repeats the system
turn and as much history as allowed, and adds whole turns while they fit. So a conversation of any length is
dealt over many tasks. Tokens are those of the byte-level BPE encoder. The loss mask covers the texts of assistant turns that are new in their window.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import token_count
from .ranges import with_ranges
from .scratch import Scratch, bound_batches
from .words import tidy

TURN_END = "</turn>"
#: Roles with a name of their own in the template; any other is written escaped behind "~".
ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
#: Tokens that a turn's marks count.
MARKS = 4
#: Budgets in a segment, and turns in a range of prefix sums.
SEGMENT, RANGE_ROWS = 32, 256

_NAMED = {v: k for k, v in ROLES.items()}
_HEADER = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.S)
_BACK = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\").replace(TURN_END, "<\\/turn>")
    return re.sub("(?<=#)#", r"\\#", text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn's lines, and where its text begins and ends in them."""
    head = f"### {ROLES.get(role) or '~' + escape(role).replace(':', chr(92) + ':')}: "
    body = escape(text)
    return f"{head}{body}{TURN_END}\n", len(head), len(head) + len(body)


def read_turns(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """Role, text, and the place of the escaped text, of every turn in a formatted window."""
    at = 0
    while at < len(formatted):
        head = _HEADER.match(formatted, at)
        if not head:
            raise ValueError(f"no turn at {at}")
        end = formatted.index(TURN_END, head.end())
        name = head[1]
        role = _NAMED[name] if name in _NAMED else unescape(name[1:])
        yield role, unescape(formatted[head.end() : end]), head.end(), end
        at = end + len(TURN_END) + 1


class _Windows:
    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.group: tuple | None = None

    def open_group(self, group: tuple) -> None:
        self.group, self.system, self.past, self.new, self.number = group, None, [], [], 0
        self.used = 0

    def add(self, kind: int, role: str, text: str, tokens: int) -> dict | None:
        """kind -1: the system turn to retain, 0: history from the segment before, 1: a turn of this one."""
        turn = (role, text, tokens)
        if kind == -1:
            self.system = turn
            return None
        if kind == 0:
            self.past.append(turn)
            return None
        out = None
        if self.new and self.used + tokens > self.budget:
            out = self.close()
        if not self.new:
            room = self.budget - tokens
            system = [self.system] if self.system and (self.system[2] <= room or room < 0) else []
            room -= sum(t[2] for t in system)
            repeated, total = [], 0
            for t in reversed(self.past):
                if total + t[2] > min(self.history, room):
                    break
                repeated.insert(0, t)
                total += t[2]
            self.repeated = system + repeated
            self.used = sum(t[2] for t in self.repeated)
        self.new.append(turn)
        self.used += tokens
        return out

    def close(self) -> dict | None:
        if not self.new:
            return None
        text, spans, at = [], [], 0
        for i, (role, body, _) in enumerate([*self.repeated, *self.new]):
            line, begin, end = render_turn(role, body)
            if i >= len(self.repeated) and role == "assistant":
                spans.append({"begin": at + begin, "end": at + end})
            text.append(line)
            at += len(line)
        conv, segment = self.group
        out = {"conv": conv, "segment": segment, "number": self.number, "n_repeated": len(self.repeated), "n_turns": len(self.new), "n_tokens": self.used, "formatted": "".join(text), "loss": spans}
        self.number += 1
        # What may be repeated next: turns of this segment and before, but the retained system turn.
        turns = self.new
        if self.system is None and segment == 0 and out["number"] == 0 and not out["n_repeated"] and turns[0][0] == "system":
            self.system, turns = turns[0], turns[1:]
        self.past = (self.past + turns)[-self.history :]
        total, keep = 0, []
        for t in reversed(self.past):
            if total + t[2] > self.history:
                break
            keep.insert(0, t)
            total += t[2]
        self.past, self.new = keep, []
        return out


def _schema(kind: pa.DataType) -> pa.Schema:
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
    return pa.schema([("conv", kind), ("segment", pa.int64()), ("number", pa.int64()), ("n_repeated", pa.int64()), ("n_turns", pa.int64()), ("n_tokens", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(span))])


def format_windows(
    turns: DataFrame, budget: int = 512, history: int = 128, tokens: Column | None = None,
    conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """Windows of conversations: ``conv_col``, segment, number (together the order of windows), n_repeated
    (turns in front that earlier windows have), n_turns (new turns), n_tokens, formatted, loss (array of
    begin, end: code points of ``formatted`` under the loss mask).

    A window holds the system turn (the conversation's opening turn, if of that role), at most ``history``
    tokens of earlier turns, then new turns, together at most ``budget`` tokens. A turn that alone exceeds the budget
    makes a window of its own, behind the system turn; only such windows are over it. The system turn is left out of
    a window only where it and the first new turn exceed the budget, and that turn alone doesn't. Nothing is
    truncated. ``tokens`` counts a text's tokens from the
    column named ``text`` (by default as op9 encodes it); each turn adds ``MARKS``. Null text or role: empty. Null
    turn numbers come first; equal ones are ordered by a hash of role and text; repeated rows are turns like others.
    Rows without conversation id are one conversation. Extra columns are not read. An empty table gives no window.
    """
    bound_batches(turns.sparkSession)
    kind = turns.schema[conv_col].dataType
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    count = token_count(turns.sparkSession, F.col("text")) if tokens is None else tokens
    rows = rows.withColumn("tokens", (F.coalesce(count, F.lit(0)) + MARKS).cast("long"))
    parts = [F.xxhash64("conv"), F.col("turn").isNotNull().cast("long"), F.coalesce(F.col("turn"), F.lit(0).cast("long")), F.xxhash64("role", "text")]
    ranged, key = with_ranges(rows, RANGE_ROWS, parts)
    rows = Scratch(turns.sparkSession).keep(ranged)
    sums = rows.groupBy("conv", "range").agg(F.sum("tokens").alias("n"))
    before = sums.select(F.col("conv").alias("c"), F.col("range").alias("r"), (F.sum("n").over(Window.partitionBy("conv").orderBy("range")) - F.col("n")).alias("before"))
    inside = F.coalesce(F.sum("tokens").over(Window.partitionBy("conv", "range").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    summed = rows.withColumn("inside", inside).join(before, F.col("conv").eqNullSafe(F.col("c")) & (F.col("range") == F.col("r"))).withColumn("start", F.col("before") + F.col("inside"))
    length = budget * SEGMENT
    summed = summed.withColumn("segment", F.floor(F.col("start") / length)).select("conv", "segment", "start", "role", "text", "tokens")

    own = summed.select("conv", "segment", F.lit(1).alias("kind"), "start", "role", "text", "tokens")
    edge = (F.col("segment") + 1) * length
    past = summed.where((F.col("start") + F.col("tokens") > edge - history) & (F.col("start") > 0)).select(
        "conv", (F.col("segment") + 1).alias("segment"), F.lit(0).alias("kind"), "start", "role", "text", "tokens")
    opening = summed.where("start = 0 and role = 'system'").select(F.col("conv").alias("c"), "role", "text", "tokens")
    later = summed.where("segment > 0").select("conv", "segment").distinct()
    system = later.join(opening, F.col("conv").eqNullSafe(F.col("c"))).select("conv", "segment", F.lit(-1).alias("kind"), F.lit(-1).cast("long").alias("start"), "role", "text", "tokens")
    dealt = own.unionByName(past).unionByName(system).repartition("conv", "segment").sortWithinPartitions("conv", "segment", "kind", "start", "role", "text")

    @tidy
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, schema = _Windows(budget, history), None
        for batch in stream:
            schema = schema or _schema(batch.schema.field("conv").type)
            found = []
            for conv, segment, k, _, role, text, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if state.group != (conv, segment):
                    if state.group:
                        found.append(state.close())
                    state.open_group((conv, segment))
                found.append(state.add(k, role, text, n))
            yield pa.RecordBatch.from_pylist([x for x in found if x], schema=schema)
        if state.group and (last := state.close()):
            yield pa.RecordBatch.from_pylist([last], schema=schema)

    out = dealt.mapInArrow(
        run, f"conv {kind.simpleString()}, segment long, number long, n_repeated long, n_turns long, n_tokens long, formatted string, loss array<struct<begin: bigint, end: bigint>>"
    )
    return out.withColumnRenamed("conv", conv_col)


def digest_windows(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What the windows say, read back from their text: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars, n_windows.

    A digest runs over a conversation in order, so one task streams a conversation; it holds one window.
    """
    kind = windows.schema[conv_col].dataType.simpleString()
    rows = windows.select(F.col(conv_col).alias("conv"), "segment", "number", "n_repeated", "formatted", "loss")
    rows = rows.repartition("conv").sortWithinPartitions("conv", "segment", "number")

    @tidy
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
        group: tuple | None = None
        sums, every, loss, conv_type = [], None, None, None

        def row() -> list:
            return [group[0], sums[0], every.hexdigest(), sums[1], loss.hexdigest(), sums[2], sums[3]]

        def batch_of(found: list[list]) -> pa.RecordBatch:
            kinds = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate(kinds)], names)

        for batch in stream:
            conv_type, found = batch.column(0).type, []
            for conv, _, _, repeated, formatted, spans in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if group != (conv,):
                    if group:
                        found.append(row())
                    group, sums, every, loss = (conv,), [0, 0, 0, 0], hashlib.sha256(), hashlib.sha256()
                for i, (role, text, _, _) in enumerate(read_turns(formatted)):
                    if i >= repeated:
                        every.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                        sums[0] += 1
                for s in spans:
                    text = unescape(formatted[s["begin"] : s["end"]])
                    loss.update(text.encode("utf-8", "surrogatepass"))
                    sums[1] += len(text)
                sums[2] += len(formatted)
                sums[3] += 1
            yield batch_of(found)
        if group:
            yield batch_of([row()])

    return rows.mapInArrow(run, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long").withColumnRenamed("conv", conv_col)
