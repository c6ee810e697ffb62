"""Queries of problem 2: nested records to related flat tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomarc.operators import nested
from loomarc.runtime import table


def _nodes(spark, sf_dir):
    return nested.nodes(table(spark, sf_dir, "session_events"), "row_id", "message")


def p2_found(spark, sf_dir):
    supertype = nested.nodes(table(spark, sf_dir, "session_events"), "row_id", "message", attributes=False, keep_root=False)
    return nested.element_links(supertype, "row_id")


def p2_nodes(spark, sf_dir):
    return _nodes(spark, sf_dir)


def p2_objects(spark, sf_dir):
    """The supertype table without what only shapes say: keys, depth, variant and number of scalar fields."""
    return _nodes(spark, sf_dir).select("record_id", "node_path", "parent_path", "depth", "in_array", "variant", F.size("attrs").alias("fields"))


def _subtype(variant, *columns):
    def query(spark, sf_dir):
        return nested.subtype_table(_nodes(spark, sf_dir), variant).select("record_id", "node_path", "parent_path", *columns)

    return query


def p2_messages(spark, sf_dir):
    """The root table: one row per valid message object, with its scalar fields."""
    return (
        _nodes(spark, sf_dir)
        .where(F.col("node_path") == "")
        .select(
            F.col("record_id").alias("row_id"),
            F.try_element_at("attrs", F.lit("role")).alias("role"),
            F.try_element_at("attrs", F.lit("toolCallId")).alias("tool_call_id"),
            F.try_element_at("attrs", F.lit("content")).alias("content"),
        )
    )


def p2_array_values(spark, sf_dir):
    return nested.array_values(table(spark, sf_dir, "session_events"), "row_id", "message").drop("parent_no")


def p2_shapes(spark, sf_dir):
    return nested.shape_catalog(_nodes(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p2_found, p2_nodes, p2_objects, p2_messages, p2_array_values, p2_shapes)}
QUERIES |= {
    "p2_tool_calls": _subtype("tool_call", "id", "name"),
    "p2_text_parts": _subtype("text_part", "text"),
    "p2_thinking_parts": _subtype("thinking_part", "thinking"),
    "p2_media_parts": _subtype("media_part", "type"),
    "p2_typed": _subtype("typed", "type", "path", "name"),
    "p2_edits": _subtype("edit", "old", "new"),
    "p2_located": _subtype("located", "path"),
    "p2_untyped": _subtype("untyped", "name", "line", "ok"),
}

#: DuckDB reads the same objects with a recursive walk of the JSON tree.
_WALK = """
WITH RECURSIVE valid AS (
  SELECT row_id, message::JSON AS j FROM session_events WHERE message IS NOT NULL AND json_valid(message)
), walk(row_id, j, node_path, parent_path, is_element, here, depth) AS (
  SELECT row_id, j, '', '', false, '', 0 FROM valid
  UNION ALL
  SELECT w.row_id, c.j, c.path, w.here, c.element AND json_type(c.j) = 'OBJECT',
         CASE WHEN c.element AND json_type(c.j) = 'OBJECT' THEN c.path ELSE w.here END, w.depth + 1
  FROM walk w, LATERAL (
    SELECT json_extract(w.j, '$."' || replace(k, '"', '\\"') || '"') AS j,
           CASE WHEN w.node_path = '' THEN k ELSE w.node_path || '.' || k END AS path, false AS element
    FROM (SELECT unnest(json_keys(w.j)) AS k) WHERE json_type(w.j) = 'OBJECT'
    UNION ALL
    SELECT json_extract(w.j, '$[' || i || ']'), w.node_path || '[' || i || ']', true
    FROM (SELECT unnest(range(json_array_length(w.j)::BIGINT)) AS i) WHERE json_type(w.j) = 'ARRAY'
  ) c
  WHERE json_type(c.j) IN ('OBJECT', 'ARRAY')
)
"""

_ROUTED = (
    _WALK
    + """, objects AS (
  SELECT *, CASE
    WHEN j->>'$.type' = 'text' AND json_type(j, '$.type') = 'VARCHAR' AND json_type(j, '$.text') = 'VARCHAR' THEN 'text_part'
    WHEN j->>'$.type' = 'thinking' AND json_type(j, '$.type') = 'VARCHAR' AND json_type(j, '$.thinking') = 'VARCHAR' THEN 'thinking_part'
    WHEN j->>'$.type' = 'toolCall' AND json_type(j, '$.type') = 'VARCHAR' AND json_type(j, '$.name') = 'VARCHAR' THEN 'tool_call'
    WHEN json_type(j, '$.type') = 'VARCHAR' AND json_type(j, '$.source') = 'OBJECT' THEN 'media_part'
    WHEN json_type(j, '$.role') = 'VARCHAR' THEN 'message'
    WHEN json_type(j, '$.type') = 'VARCHAR' THEN 'typed'
    WHEN json_type(j, '$.old') = 'VARCHAR' AND json_type(j, '$.new') = 'VARCHAR' THEN 'edit'
    WHEN json_type(j, '$.path') = 'VARCHAR' THEN 'located'
    ELSE 'untyped' END AS variant
  FROM walk WHERE json_type(j) = 'OBJECT'
)
"""
)


def _scalar(name: str) -> str:
    return f"CASE WHEN json_type(j, '$.{name}') IN ('ARRAY', 'OBJECT') THEN NULL ELSE j->>'$.{name}' END"


def _subtype_sql(variant: str, *columns: str) -> str:
    typed = ", ".join(f"{_scalar(c)} AS {c}" for c in columns)
    return _ROUTED + f"SELECT row_id AS record_id, node_path, parent_path, {typed} FROM objects WHERE variant = '{variant}'"


ORACLE = {
    "p2_thinking_parts": _subtype_sql("thinking_part", "thinking"),
    "p2_media_parts": _subtype_sql("media_part", "type"),
    "p2_typed": _subtype_sql("typed", "type", "path", "name"),
    "p2_edits": _subtype_sql("edit", "old", "new"),
    "p2_located": _subtype_sql("located", "path"),
    "p2_untyped": _ROUTED
    + f"""SELECT row_id AS record_id, node_path, parent_path, {_scalar("name")} AS name,
  CASE WHEN regexp_full_match({_scalar("line")}, '-?[0-9]+') THEN TRY_CAST({_scalar("line")} AS BIGINT) END AS line,
  TRY_CAST({_scalar("ok")} AS BOOLEAN) AS ok FROM objects WHERE variant = 'untyped'""",
    "p2_objects": _ROUTED
    + """SELECT row_id AS record_id, node_path, parent_path, depth, is_element AS in_array, variant,
  len(list_filter(json_keys(j), lambda k: json_type(json_extract(j, '$."' || replace(k, '"', '\\"') || '"')) NOT IN ('ARRAY', 'OBJECT')))::INT AS fields FROM objects""",
    "p2_found": _WALK + "SELECT row_id, node_path, parent_path FROM walk WHERE is_element",
    "p2_messages": """
SELECT row_id, CASE WHEN json_type(j, '$.role') IN ('ARRAY','OBJECT') THEN NULL ELSE j->>'$.role' END AS role,
  j->>'$.toolCallId' AS tool_call_id,
  CASE WHEN json_type(j, '$.content') = 'VARCHAR' THEN j->>'$.content' END AS content
FROM (SELECT row_id, message::JSON AS j FROM session_events WHERE message IS NOT NULL AND json_valid(message))
WHERE json_type(j) = 'OBJECT'""",
    "p2_tool_calls": _WALK
    + """SELECT row_id AS record_id, node_path, parent_path, j->>'$.id' AS id, j->>'$.name' AS name FROM walk
WHERE json_type(j) = 'OBJECT' AND j->>'$.type' = 'toolCall' AND json_type(j, '$.name') = 'VARCHAR'""",
    "p2_text_parts": _WALK
    + """SELECT row_id AS record_id, node_path, parent_path, j->>'$.text' AS text FROM walk
WHERE json_type(j) = 'OBJECT' AND j->>'$.type' = 'text' AND json_type(j, '$.text') = 'VARCHAR'""",
    "p2_array_values": _WALK
    + """SELECT row_id AS record_id, node_path || '[' || i || ']' AS node_path, here AS parent_path,
  CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind, v->>'$' AS value
FROM (SELECT *, json_extract(j, '$[' || i || ']') AS v
  FROM (SELECT *, unnest(range(json_array_length(j)::BIGINT)) AS i FROM walk WHERE json_type(j) = 'ARRAY'))
WHERE json_type(v) NOT IN ('OBJECT', 'ARRAY')""",
}
