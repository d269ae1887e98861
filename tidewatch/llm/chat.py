"""Operator 4, chat formatting with a grammar round trip.

A conversation is rendered as

    conversation := turn*
    turn         := "<s>" role "[INST]" text "[/INST]" "</s>"

Rendering first puts roles and texts in as they are. The deterministic parser
reads the result back; if the turns it recovers are not the source, the turns
that conflict are escaped: a backslash goes into every control string of a role or
text, after its first sign, and one more into strings that already look escaped.
The parser takes one away again, so the second reading is always identical. The
loss mask is the list of assistant texts as code point ranges of the rendering.

Turns are ordered by (turn, role, text), nulls first. A null text or role is
empty; a null conv_id is a conversation of its own; rows that repeat a turn are
all rendered. Texts may have any length. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewatch.session import new_path

TURN, BODY, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = re.compile(r"</?s>|\[/?INST\]")
_PLAIN = re.compile(r"([<\[])(\\*)(/?s>|/?INST\])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\])")
ASSISTANT = "assistant"

Turn = tuple[str, str]


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def parse(rendered: str) -> tuple[list[Turn], list[tuple[int, int]]] | None:
    """The turns of a rendering and the range of each text; None if it is no sentence of the grammar."""
    turns, ranges, at = [], [], 0
    marks = CONTROL.finditer(rendered)
    while at < len(rendered):
        four = [next(marks, None) for _ in range(4)]
        if None in four or [m[0] for m in four] != [TURN, BODY, CLOSE, END] or four[0].start() != at or four[2].end() != four[3].start():
            return None
        text = four[1].end(), four[2].start()
        turns.append((unescape(rendered[four[0].end() : four[1].start()]), unescape(rendered[text[0] : text[1]])))
        ranges.append(text)
        at = four[3].end()
    return turns, ranges


def render(turns: list[Turn]) -> tuple[str, list[tuple[int, int]]]:
    """The rendering that parses back to the turns, and the ranges under the loss mask."""
    for change in (lambda x: x, escape):
        parts, loss, at = [], [], 0
        for role, text in turns:
            # Only turns that do not come back by themselves are escaped.
            alone = f"{TURN}{role}{BODY}{text}{CLOSE}{END}"
            good = (read := parse(alone)) is not None and read[0] == [(role, text)]
            shown = (role, text) if good else (change(role), change(text))
            head = f"{TURN}{shown[0]}{BODY}"
            if role == ASSISTANT:
                loss.append((at + len(head), at + len(head) + len(shown[1])))
            parts.append(f"{head}{shown[1]}{CLOSE}{END}")
            at += len(parts[-1])
        rendered = "".join(parts)
        read = parse(rendered)
        if read is not None and read[0] == turns:
            return rendered, loss
    raise ValueError("a conversation does not survive the round trip")


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (start and end of each range) of every conversation.

    ``turns`` has ``conv_id, turn, role, text``. The rendering is one value, so a
    conversation's turns meet in one row.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def work(batches):
        for batch in batches:
            texts, masks = [], []
            for turns in batch.column("turns").to_pylist():
                rendered, loss = render([(t["role"], t["text"]) for t in turns])
                texts.append(rendered)
                masks.append([{"start": a, "end": b} for a, b in loss])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(texts, pa.string()), pa.array(masks, kind)], ["conv_id", "formatted", "loss"])

    return grouped.mapInArrow(work, "conv_id long, formatted string, loss array<struct<start:long,end:long>>")


def digest(formatted: DataFrame) -> DataFrame:
    """What a reader recovers from renderings and masks alone."""

    def work(batches):
        for batch in batches:
            out = []
            for rendered, mask in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist(), strict=True):
                turns, _ = parse(rendered)
                whole = "".join(f"{role}\n{text}\n" for role, text in turns)
                loss = "".join(unescape(rendered[m["start"] : m["end"]]) for m in mask)
                out.append((len(turns), _sha(whole), len(loss), _sha(loss), len(rendered)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    return formatted.mapInArrow(work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def with_probe(turns: DataFrame) -> DataFrame:
    """The turns and conversation -7, whose texts imitate the template."""
    spark = turns.sparkSession
    text = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)


def round_trip(turns: DataFrame) -> DataFrame:
    """Write the renderings of all conversations, and digest what is read back."""
    spark = turns.sparkSession
    path = new_path(spark, "chat")
    format_conversations(turns).write.parquet(path)
    return digest(spark.read.parquet(path))


# Four control strings have 3 + 6 + 7 + 4 signs; each conflicting string gets one more.
SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) p(k, r)),
e AS (SELECT *, length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) AS role_chars,
  length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) AS text_chars FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(role_chars + text_chars + 20)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""
