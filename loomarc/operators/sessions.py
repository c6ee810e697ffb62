"""Session export: events to windows, windows to three text carriers and statistics.

Messages are flattened in one Arrow pass (dynamic JSON, a stateful inline scan); windows,
turn numbers, carriers, redaction and statistics are DataFrame operations.

Defined results: a null or unreadable message, or one that is no object, gives no text; a
missing role counts as a message but writes nothing; blank bodies write nothing. Windows
without messages have empty carriers. Equal line numbers of one session are ordered by
nothing further and should be resolved before (``latest_lines``).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomarc.functions import redact as R
from loomarc.functions import text as T
from loomarc.operators.windows import marker_windows, running_turns

# Framing of the carriers.
PARAGRAPH = " ¶\n"
STREAM_HEADER = "ARCHIVE EVENT STREAM\n"
_MACHINE_MARKS = ("\\n", '"type":', "function ", "const ", "=>")


def json_text(value) -> str:
    """Compact JSON with sorted keys; floats in shortest form with a bare exponent."""
    text = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return text if "e" not in text else _plain_exponents(value)


def _plain_exponents(value) -> str:
    if isinstance(value, float):
        head, _, tail = repr(value).partition("e")
        return f"{head}e{int(tail)}" if tail else head
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_plain_exponents(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_plain_exponents, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def scalar_text(content) -> str:
    """A string as it is, nothing for null, else JSON."""
    if isinstance(content, str):
        return content
    return "" if content is None else json_text(content)


def tool_call_text(part: dict) -> str:
    name, call = part.get("name"), part.get("id")
    arguments = json_text(part["arguments"]) if "arguments" in part else "{}"
    return f"# Tool call {name if isinstance(name, str) else 'tool'} {call if isinstance(call, str) else 'unknown'}\n{arguments}"


def _kind(part) -> str | None:
    kind = part.get("type") if isinstance(part, dict) else None
    return kind if isinstance(kind, str) else None


def flatten(content, assistant: bool) -> str:
    """Content to text; an assistant's blocks are trimmed, marked and dropped when blank."""
    if not isinstance(content, list):
        return scalar_text(content)
    blocks = []
    for part in content:
        kind = _kind(part)
        if kind in ("text", "thinking"):
            body = part.get(kind)
            if isinstance(body, str):
                if assistant:
                    body = f"[thinking]\n{body.strip()}\n[/thinking]" if kind == "thinking" else body.strip()
                blocks.append(body)
        elif kind == "toolCall":
            blocks.append(tool_call_text(part))
        elif kind is not None:
            blocks.append(f"[unsupported {'assistant ' if assistant else ''}content: {kind}]")
        else:
            blocks.append(json_text(part))
    return "\n".join(b for b in blocks if b.strip() or not assistant)


def outside_fences(text: str) -> list[str]:
    kept, inside = [], False
    for line in split_lines(text):
        if line.lstrip().startswith("```"):
            inside = not inside
        elif not inside:
            kept.append(line)
    return kept


def split_lines(text: str) -> list[str]:
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    return [line[:-1] if line.endswith("\r") else line for line in lines]


def plain_inline(text: str) -> str:
    """Without ``*`` and backticks; a link becomes its label and target, ``|`` a blank.

    A bracket that opens no link keeps its text and loses its closing sign.
    """
    out, i, n = [], 0, len(text)
    while i < n:
        ch = text[i]
        i += 1
        if ch in "*`":
            continue
        if ch == "|":
            out.append(" ")
        elif ch == "[":
            close = text.find("]", i)
            label = text[i:] if close < 0 else text[i:close]
            i = n if close < 0 else close + 1
            if close >= 0 and text[i : i + 1] == "(":
                end = text.find(")", i + 1)
                target = text[i + 1 :] if end < 0 else text[i + 1 : end]
                i = n if end < 0 else end + 1
                out.append(label + (" " + target if target else ""))
            else:
                out.append("[" + label)
        else:
            out.append(ch)
    return "".join(out)


# The rule of ``functions.text.strip_markdown_prefix`` for texts in Python: heading marks, then one
# quote mark, then one list mark, or a number where the rest is longer than two bytes.
_HEADINGS_AND_QUOTE = re.compile(r"(?:#\s*)*(?:>\s*)?")
_LIST_MARK = re.compile(r"[-*+] \s*")
_NUMBER_MARK = re.compile(r"[0-9]+\.\s*")


def plain_prefix(line: str) -> str:
    """The string form of ``functions.text.strip_markdown_prefix``."""
    bare = line.lstrip()
    bare = bare[_HEADINGS_AND_QUOTE.match(bare).end() :]
    mark = _LIST_MARK.match(bare) or (_NUMBER_MARK.match(bare) if len(bare.encode()) > 2 else None)
    return bare[mark.end() :] if mark else bare


def dialogue_text(text: str) -> str:
    """What a speaker says in one line: no code, noise lines, marks or machine output."""
    kept = []
    for line in outside_fences(text):
        line = line.strip()
        if not line or line in ("<out>", "</out>") or line.startswith(("[shaken ", "[raw output:")):
            continue
        line = plain_inline(plain_prefix(line))
        if len(line.encode()) > 500 and (line.startswith(("{", "[")) or any(m in line for m in _MACHINE_MARKS)):
            continue
        kept.append(line)
    return " ".join(kept)


def dialogue(content) -> str:
    """The dialogue of a content: its text parts, white space collapsed."""
    if isinstance(content, list):
        parts = [dialogue_text(p["text"]) for p in content if _kind(p) == "text" and isinstance(p.get("text"), str)]
        return " ".join(" ".join(parts).split())
    return " ".join(dialogue_text(scalar_text(content)).split())


def section(message: dict) -> tuple[str | None, str, str]:
    """(role, section of the full carrier, dialogue body) of a message; '' writes nothing."""
    role = message.get("role")
    if not isinstance(role, str):
        return None, "", ""
    content = message.get("content")
    body = flatten(content, role == "assistant").strip()
    if role == "toolResult":
        call = message.get("toolCallId")
        heading = f"# Tool result {call if isinstance(call, str) else 'unknown'}"
        return role, f"{heading}{PARAGRAPH}<out>\n{body}\n</out>\n" if body else "", ""
    heading = {"user": "# User", "assistant": "# Assistant"}.get(role, f"# {role}")
    spoken = dialogue(content) if role in ("user", "assistant") else ""
    return role, f"{heading}{PARAGRAPH}{body}\n" if body else "", spoken


def flatten_messages(events: DataFrame) -> DataFrame:
    """Adds ``role, section, body`` to events with a ``message`` text; one Arrow pass.

    ``role`` is null where the message is no object or has none; ``is_message`` tells them apart.
    """
    names = list(events.columns)
    at = names.index("message")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list] = [[], [], [], []]
            for text in batch.column(at).to_pylist():
                try:
                    message = json.loads(text) if text is not None else None
                except (ValueError, RecursionError):
                    message = None
                row = (isinstance(message, dict), *(section(message) if isinstance(message, dict) else (None, "", "")))
                for column, value in zip(found, row):
                    column.append(value.encode("utf-8", "replace").decode() if isinstance(value, str) else value)
            extra = [pa.array(found[0], pa.bool_()), *(pa.array(c, pa.string()) for c in found[1:])]
            kept = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*kept, *extra], names=[*(n for n in names if n != "message"), "is_message", "role", "section", "body"])

    schema = events.drop("message").schema
    for name, kind in (("is_message", "boolean"), ("role", "string"), ("section", "string"), ("body", "string")):
        schema = schema.add(name, kind)
    return events.mapInArrow(run, schema)


def latest_lines(events: DataFrame) -> DataFrame:
    """One row per session and line: of repeated deliveries the one ingested last, then the larger row id."""
    rank = F.struct(F.unix_micros(F.col("ingested_at").cast("timestamp")), "row_id")
    kept = [c for c in events.columns if c not in ("session_id", "line_no")]
    return events.groupBy("session_id", "line_no").agg(F.max_by(F.struct(*kept), rank).alias("_r")).select("session_id", "line_no", "_r.*")


def session_windows(events: DataFrame) -> DataFrame:
    """Events of exportable windows with ``window_no`` (compaction events end windows)."""
    marker = F.coalesce(F.col("event_type") == "compaction", F.lit(False))
    return marker_windows(events, "session_id", "line_no", marker)


def carriers(windowed: DataFrame, home: str | None = None) -> DataFrame:
    """One row per session and window: the three carriers, cleaned and redacted, and their statistics.

    Pieces are collected per window and sorted by line, so a window's text has to fit one value; for
    windows that may not, ``carrier_pieces`` gives the same as rows.
    """
    is_message = F.coalesce(F.col("event_type") == "message", F.lit(False)) & F.col("message").isNotNull()
    flat = flatten_messages(windowed.withColumn("counts", is_message).withColumn("bytes", F.octet_length("message")))
    counts = F.col("counts")
    speaker = F.when(F.col("role") == "user", "U").when(F.col("role") == "assistant", "A")
    spoken = counts & speaker.isNotNull() & (F.col("body") != "")
    role_count = lambda r: F.count_if(counts & (F.col("role") == r))
    grouped = flat.groupBy("session_id", "window_no").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.count_if(counts).alias("message_count"),
        role_count("user").alias("user_messages"),
        role_count("assistant").alias("assistant_messages"),
        role_count("toolResult").alias("tool_results"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("source_json_bytes"),
        F.min("line_no").alias("start_line"),
        F.max("line_no").alias("last_line"),
        F.array_sort(F.collect_list(F.when(counts & (F.col("section") != ""), F.struct("line_no", F.col("section").alias("text"))))).alias("sections"),
        F.array_sort(F.collect_list(F.when(spoken, F.struct("line_no", F.concat(speaker, F.lit(": "), F.col("body")).alias("text"))))).alias("turns"),
    )
    turns = F.transform("turns", lambda x: x["text"])
    numbered = F.transform("turns", lambda x, i: F.concat(F.lit("｜ T"), T.zero_pad(i + 1, 3), F.lit(" "), x["text"]))
    final = lambda c: R.redact(T.normalize_archive(c), home)
    texts = grouped.select(
        *[c for c in grouped.columns if c not in ("sections", "turns")],
        F.size("turns").cast("bigint").alias("turns"),
        final(F.array_join(F.transform("sections", lambda x: x["text"]), "\n")).alias("serialized"),
        final(F.array_join(turns, "\n\n")).alias("eventized"),
        final(F.when(F.size("turns") > 0, F.concat(F.lit(STREAM_HEADER), F.array_join(numbered, "\n"))).otherwise(F.lit(""))).alias("structured"),
    )
    for name in ("serialized", "eventized", "structured"):
        texts = texts.withColumn(f"{name}_chars", F.length(name).cast("bigint"))
    return texts


#: What stands between the pieces of each carrier.
JOINTS = {"serialized": "\n\n", "eventized": "\n\n", "structured": "\n"}


def carrier_pieces(windowed: DataFrame, home: str | None = None) -> DataFrame:
    """The carriers as ordered pieces: ``session_id, window_no, carrier, place, text``.

    A piece is the part one message writes, cleaned and redacted; ``place`` orders the pieces of a carrier
    (0 is the header of ``structured``). Joined by ``JOINTS`` they are the carriers. Turns are numbered
    by running sums in two levels and nothing is collected, so a window of any size
    is only ever rows; ``writers.carrier_stream`` writes them in order.
    """
    is_message = F.coalesce(F.col("event_type") == "message", F.lit(False)) & F.col("message").isNotNull()
    flat = flatten_messages(windowed.where(is_message).select("session_id", "window_no", "line_no", "message")).drop("is_message")
    speaker = F.when(F.col("role") == "user", "U: ").when(F.col("role") == "assistant", "A: ")
    said = F.when(speaker.isNotNull() & (F.col("body") != ""), F.concat(speaker, F.col("body")))
    keyed = flat.select("session_id", "window_no", "line_no", "section", said.alias("said"), F.concat_ws("\0", "session_id", F.col("window_no").cast("string")).alias("_key"))
    numbered = running_turns(keyed, "_key", "line_no", F.coalesce("said", F.lit("")))
    turn = F.concat(F.lit("｜ T"), T.zero_pad(F.col("turn_no"), 3), F.lit(" "), F.col("said"))
    part = lambda name, place, text: F.struct(F.lit(name).alias("carrier"), place.cast("bigint").alias("place"), text.alias("text"))
    line = F.col("line_no") + 1
    spoken = F.col("said").isNotNull()
    parts = F.array(
        F.when(F.col("section") != "", part("serialized", line, F.col("section"))),
        F.when(spoken, part("eventized", line, F.col("said"))),
        F.when(spoken & (F.col("turn_no") == 1), part("structured", F.lit(0), F.lit(STREAM_HEADER))),
        F.when(spoken, part("structured", line, turn)),
    )
    rows = numbered.select("session_id", "window_no", F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("p")).select("session_id", "window_no", "p.*")
    return rows.withColumn("text", R.redact(T.normalize_archive(F.col("text")), home))


def window_metadata(texts: DataFrame, events: DataFrame) -> DataFrame:
    """Statistics of each window with the line, tokens and time of its closing event."""
    closing = events.where(F.col("event_type") == "compaction").select("session_id", F.col("line_no").alias("end_line"), "tokens_before", "event_ts")
    # Window n is closed by marker n: numbered by the markers before it.
    from loomarc.operators.windows import running_sum

    numbered = running_sum(closing, "session_id", "end_line", F.lit(1), "window_no")
    kept = texts.drop("serialized", "eventized", "structured")
    # An empty window reports the line of its own marker as its start.
    return numbered.join(kept, ["session_id", "window_no"], "left").withColumn("start_line", F.coalesce("start_line", "end_line")).fillna(
        0, [c for c in kept.columns if c.endswith(("_chars", "_count", "_messages", "_results", "_bytes", "turns"))]
    )
