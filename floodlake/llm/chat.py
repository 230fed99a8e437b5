"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to a string.  To find what
belongs to which turn, successive prefixes of a conversation are rendered: if
each output starts with the one before it, what is added is the turn's span.
Rendering the turn once more with a marker for its text shows where the text
stands inside the span.  A template whose longer output does not start with
the shorter one rewrites history; such conversations are reported without
spans, and nothing is trained on them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]

#: Control strings of the template below.
OPEN, CLOSE = "### ", "</turn>\n"
_CONTROL = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_ROLE_CONTROL = re.compile(r"\\|#(?=##)|<(?=/turn>)|\n")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:[^\\\n]|\\.)*)\n((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.DOTALL)
#: Characters (private use) of what stands for a turn's text while its place is looked for.
_EDGE, _MIDDLE = "\uf8ff", "\ue000"


def _probe(output: str) -> str:
    """A string that does not occur in ``output``."""
    n = 1
    while (probe := _EDGE + _MIDDLE * n + _EDGE) in output:
        n += 1
    return probe


def escape(text: str) -> str:
    """A backslash before each backslash and before what would begin a control string."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def turn_template(turns: Sequence[Turn]) -> str:
    """``### role``, the text on the next line, then ``</turn>``, with control strings escaped."""
    return "".join(f"{OPEN}{_ROLE_CONTROL.sub(lambda m: '\\' + m[0], role)}\n{escape(text)}{CLOSE}" for role, text in turns)


def read_back(output: str) -> list[Turn]:
    """The turns of an output of ``turn_template``."""
    turns, at = [], 0
    while at < len(output):
        m = _TURN.match(output, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


@dataclass
class Located:
    """An output with the span of each turn and of its text (start, end, text start, text end)."""

    output: str
    spans: list[tuple[int, int, int, int]]
    rewrites: bool


def locate(template: Template, turns: Sequence[Turn]) -> Located:
    """Render all prefixes; compare each output with the one before it.

    A conversation of n turns is rendered 2 n times, so the cost grows with the
    square of its length: the template is a black box.
    """
    spans: list[tuple[int, int, int, int]] = []
    before = template(turns[:0])
    for i, (role, _) in enumerate(turns):
        now = template(turns[: i + 1])
        mark = _probe(now)
        probe = template([*turns[:i], (role, mark)])
        if not now.startswith(before) or not probe.startswith(before) or (at := probe.find(mark, len(before))) < 0:
            return Located(template(turns), [], True)
        tail = len(probe) - at - len(mark)
        end = len(now) - tail
        if end < at or now[:at] != probe[:at] or now[end:] != probe[len(probe) - tail :]:
            return Located(template(turns), [], True)
        spans.append((len(before), len(now), at, end))
        before = now
    return Located(before, spans, False)


def format_conversations(turns: DataFrame, template: Template = turn_template, learn: Sequence[str] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, rewrites, spans and loss.

    ``spans`` has role, start, end, text_start, text_end of each turn in
    characters of ``formatted``; ``loss`` has the text ranges of turns by the
    roles in ``learn``.  Turns go in the order of turn, null first, ties by
    role and text.  Null roles and texts are empty.  Rows that repeat are
    turns of their own.  A null conv_id is a conversation like another; an
    empty table gives an empty result.  Columns besides conv_id, turn, role
    and text are ignored.  A conversation becomes one string, so it is
    gathered in one row; conversations are spread over the tasks.
    """
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    span = "struct<role:string,start:int,end:int,text_start:int,text_end:int>"
    spans_type = pa.list_(pa.struct([("role", pa.string()), *((n, pa.int32()) for n in ("start", "end", "text_start", "text_end"))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outputs, rewrites, spans = [], [], []
            for talk in batch.column("turns"):
                said = [(t["role"], t["text"]) for t in talk.as_py()]
                found = locate(template, said)
                outputs.append(found.output)
                rewrites.append(found.rewrites)
                spans.append([{"role": role, "start": a, "end": b, "text_start": c, "text_end": d} for (role, _), (a, b, c, d) in zip(said, found.spans, strict=False)])
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(outputs, pa.string()), pa.array(rewrites, pa.bool_()), pa.array(spans, spans_type)], names=["conv_id", "formatted", "rewrites", "spans"])

    out = whole.select(F.col("conv_id").cast("long").alias("conv_id"), "turns").mapInArrow(run, f"conv_id long, formatted string, rewrites boolean, spans array<{span}>")
    return out.withColumn("loss", F.filter("spans", lambda s: s["role"].isin(*learn)))


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from the output: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, turns, chars, loss, total = [], [], [], [], []
            for output, mask in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist(), strict=True):
                said = read_back(output)
                learned = "".join(unescape(output[s["text_start"] : s["text_end"]]) for s in mask)
                n.append(len(said))
                turns.append(hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in said).encode()).hexdigest())
                chars.append(len(learned))
                loss.append(hashlib.sha256(learned.encode()).hexdigest())
                total.append(len(output))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(n, pa.int64()), pa.array(turns, pa.string()), pa.array(chars, pa.int64()), pa.array(loss, pa.string()), pa.array(total, pa.int64())], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: DuckDB SQL for the rows of the query, by plain string functions.
ORACLE = r"""
WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, n, who, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS x(n, who)),
sized AS (SELECT *, len(text) + len(text) - len(replace(text, '\', '')) + len(array_to_string(regexp_extract_all(text, '#{3,}'), '')) - 2 * len(regexp_extract_all(text, '#{3,}')) + (len(text) - len(replace(text, '</turn>', ''))) // 7
  + len(role) + len(role) - len(replace(role, '\', '')) + len(array_to_string(regexp_extract_all(role, '#{3,}'), '')) - 2 * len(regexp_extract_all(role, '#{3,}')) + (len(role) - len(replace(role, '</turn>', ''))) // 7
  + len(role) - len(replace(role, chr(10), '')) + len('### ') + 1 + len('</turn>') + 1 AS chars FROM said),
gathered AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, len(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM gathered
"""
