"""Deeply nested JSON records to related flat tables (structural-variant tables).

Each record is read once. A bottom-up tree automaton gives every value a state (its
*shape*): scalars by kind, arrays by the set of their element states, objects by the set
of their members (key, state of the value). A string below the key ``type`` has a state of
its own for each tag the variants know. The state of an object alone decides its variant:
a transition table says what each (key, kind or tag) proves, and the first variant all of
whose demands are proved accepts the object. Each variant is routed to a typed subtype
table, while the keys common to all (record id, numbers and paths of node and parent,
depth, shape) form the supertype table. Links, subtype tables and array values all come
from this one walk.

Links: ``node_no`` counts the objects of a record in reading order, from 0;
``parent_no`` is that of the nearest enclosing object which is an array element, null where
there is none. ``node_path`` and ``parent_path`` say the same to readers. Paths join keys as
they are, so keys that hold dots or brackets can give two nodes one path; numbers never do.

Defined results:

* null record, invalid JSON, empty text: no rows (``strict`` JSON: NaN and Infinity are
  not JSON). The same record id delivered twice gives the rows twice.
* a string that itself holds JSON is a leaf.
* a key given twice in one object: the last value counts.
* any depth: records nested deeper than the C parser allows take an explicit-stack parser.
* other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomarc.runtime import spread

NODE_SCHEMA = (
    "record_id bigint, node_no int, parent_no int, node_path string, parent_path string, depth int, in_array boolean, "
    "variant string, shape bigint, attrs map<string,string>"
)


class Num(str):
    """A JSON number kept as it is written, so no digits or spelling are lost."""

    __slots__ = ()


def _constant(name: str):
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_int=Num, parse_float=Num, parse_constant=_constant)
_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?")
_LITERAL = {"true": True, "false": False, "null": None}


def parse_deep(text: str):
    """Strict JSON with an explicit stack; for records too deep for the C parser."""
    skip = lambda i: _SPACE.match(text, i).end()
    stack: list[tuple] = []
    i, n = skip(0), len(text)
    while True:
        if i >= n:
            raise ValueError("end of text")
        ch = text[i]
        opened = False
        if ch == "{":
            value, i = {}, skip(i + 1)
            if text[i : i + 1] == "}":
                i += 1
            else:
                key, i = _member(text, i, skip)
                stack.append((value, key))
                opened = True
        elif ch == "[":
            value, i = [], skip(i + 1)
            if text[i : i + 1] == "]":
                i += 1
            else:
                stack.append((value, None))
                opened = True
        elif ch == '"':
            value, i = scanstring(text, i + 1, True)
        elif m := _NUMBER.match(text, i):
            value, i = Num(m.group()), m.end()
        else:
            word = next((w for w in _LITERAL if text.startswith(w, i)), None)
            if word is None:
                raise ValueError(f"no value at {i}")
            value, i = _LITERAL[word], i + len(word)
        if opened:
            continue
        while True:
            i = skip(i)
            if not stack:
                if i != n:
                    raise ValueError("text after the value")
                return value
            holder, key = stack.pop()
            if key is None:
                holder.append(value)
            else:
                holder[key] = value
            ch = text[i : i + 1]
            if ch == ",":
                i = skip(i + 1)
                if key is None:
                    stack.append((holder, None))
                else:
                    key, i = _member(text, i, skip)
                    stack.append((holder, key))
                break
            if ch != ("]" if key is None else "}"):
                raise ValueError(f"no end at {i}")
            value, i = holder, i + 1


def _member(text: str, i: int, skip) -> tuple[str, int]:
    if text[i : i + 1] != '"':
        raise ValueError(f"no key at {i}")
    key, i = scanstring(text, i + 1, True)
    i = skip(i)
    if text[i : i + 1] != ":":
        raise ValueError(f"no colon at {i}")
    return key, skip(i + 1)


def parse(text: str | None):
    """The value of a strict JSON text, or raises ``ValueError``."""
    if text is None:
        raise ValueError("null")
    try:
        return _DECODER.decode(text)
    except RecursionError:
        return parse_deep(text)


class State(NamedTuple):
    """A state: its hash (the same on every executor), the symbol tables know it by, the variant it accepts."""

    shape: int
    symbol: str
    variant: str | None


def _hash(transition: tuple) -> int:
    found = xxhash.xxh64(repr(transition).encode("utf-8", "surrogatepass")).intdigest()
    return found - (1 << 64) if found >> 63 else found


class TreeAutomaton:
    """Bottom-up automaton over JSON trees.

    Symbols of states are the kinds ``null``, ``bool``, ``number``, ``string``, ``array`` and
    ``object``, and ``=tag`` for a known tag. ``VARIANTS`` states what the members of an object
    have to be for each variant, the most special first; it is compiled into the transition table
    (key, symbol) -> bits, and an object's variant is the first whose bits its members set.
    """

    KINDS = {type(None): "null", bool: "bool", Num: "number", str: "string"}
    TAG_KEY = "type"
    TAGS = ("text", "thinking", "toolCall")

    VARIANTS = (
        ("text_part", {"type": "=text", "text": "string"}),
        ("thinking_part", {"type": "=thinking", "thinking": "string"}),
        ("tool_call", {"type": "=toolCall", "name": "string"}),
        ("media_part", {"type": "string", "source": "object"}),
        ("message", {"role": "string"}),
        ("typed", {"type": "string"}),
        ("edit", {"old": "string", "new": "string"}),
        ("located", {"path": "string"}),
        ("untyped", {}),
    )

    def __init__(self) -> None:
        self.leaves = {kind: State(_hash((kind,)), kind, None) for kind in self.KINDS.values()}
        self.tags = {tag: State(_hash(("string", tag)), "=" + tag, None) for tag in self.TAGS}
        self.table: dict[tuple[str, str], int] = {}
        self.demands: list[tuple[int, str]] = []
        bit = 1
        for variant, members in self.VARIANTS:
            want = 0
            for key, symbol in members.items():
                proofs = [symbol] if symbol != "string" else ["string", *(s.symbol for s in self.tags.values())]
                for proof in proofs:
                    self.table[key, proof] = self.table.get((key, proof), 0) | bit
                want, bit = want | bit, bit << 1
            self.demands.append((want, variant))
        self._arrays: dict[frozenset, State] = {}
        self._objects: dict[tuple, State] = {}

    def leaf(self, key: str | None, value) -> State:
        """The state of a scalar below a key (None: an array element)."""
        if key == self.TAG_KEY and type(value) is str and value in self.tags:
            return self.tags[value]
        return self.leaves[self.KINDS[type(value)]]

    def array(self, states: frozenset[State]) -> State:
        found = self._arrays.get(states)
        if found is None:
            found = State(_hash(("array", *sorted(s.shape for s in states))), "array", None)
            self._keep(self._arrays, states, found)
        return found

    def object(self, members: tuple[tuple[str, State], ...]) -> State:
        found = self._objects.get(members)
        if found is None:
            proved = 0
            for key, state in members:
                proved |= self.table.get((key, state.symbol), 0)
            variant = next(name for want, name in self.demands if want & ~proved == 0)
            found = State(_hash(("object", *sorted((key, state.shape) for key, state in members))), "object", variant)
            self._keep(self._objects, members, found)
        return found

    @staticmethod
    def _keep(known: dict, transition, state: State) -> None:
        if len(known) >= 50_000:  # bounds the task's memory; states are found anew, never wrong
            known.clear()
        known[transition] = state


class Node(NamedTuple):
    """One object of a record."""

    number: int
    parent_number: int | None
    path: str
    parent: str
    depth: int
    element: bool
    state: State
    value: dict


def walk(root, automaton: TreeAutomaton, values: list[tuple] | None = None) -> list[Node]:
    """The objects of a record in reading order, each with its state.

    ``values``, where given, takes (path, parent, parent number, kind, text) of each scalar array element.
    """
    # Reading order: containers with their places. Every child comes after its parent.
    order: list[tuple] = []
    stack = [(root, "", "", None, 0, False)]
    count = 0
    while stack:
        item = value, path, parent, parent_no, depth, element = stack.pop()
        if isinstance(value, dict):
            order.append((count, *item))
            inner, inner_no = (path, count) if element else (parent, parent_no)
            count += 1
            stack.extend(
                (v, f"{path}.{k}" if path else k, inner, inner_no, depth + 1, False)
                for k, v in reversed(value.items())
                if isinstance(v, (dict, list))
            )
        else:
            order.append((-1, *item))
            if values is not None:
                values.extend(
                    (f"{path}[{i}]", parent, parent_no, TreeAutomaton.KINDS[type(v)], _scalar_text(v))
                    for i, v in enumerate(value)
                    if not isinstance(v, (dict, list))
                )
            stack.extend(
                (v, f"{path}[{i}]", parent, parent_no, depth + 1, isinstance(v, dict))
                for i, v in reversed([*enumerate(value)])
                if isinstance(v, (dict, list))
            )
    # The automaton runs over it backwards, so the states below a value are there before its own.
    states: dict[int, State] = {}
    leaf, nodes = automaton.leaf, []
    for number, value, path, parent, parent_no, depth, element in reversed(order):
        if number >= 0:
            members = tuple([(k, states[id(v)] if isinstance(v, (dict, list)) else leaf(k, v)) for k, v in value.items()])
            state = states[id(value)] = automaton.object(members)
            nodes.append(Node(number, parent_no, path, parent, depth, element, state, value))
        else:
            states[id(value)] = automaton.array(frozenset([states[id(v)] if isinstance(v, (dict, list)) else leaf(None, v) for v in value]))
    nodes.reverse()
    return nodes


def _scalar_text(value) -> str | None:
    if value is None:
        return None
    if value is True or value is False:
        return "true" if value else "false"
    return _clean(str(value))


def _clean(text: str) -> str:
    """Lone surrogates (legal in JSON escapes) cannot be stored as UTF-8."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-8", "replace").decode()


_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "map<string,string>": pa.map_(pa.string(), pa.string())}


def _walked(df: DataFrame, id_col: str, json_col: str, schema: str, rows_of, needed: Column) -> DataFrame:
    """Run the walk over each record: ``rows_of(automaton, root)`` gives rows without the record id.

    One pass, no shuffle. Records that fail ``needed``, a condition on ``record``, cost no Python time.
    """
    columns = [c.split(" ") for c in schema.split(", ")]
    names, types = [c[0] for c in columns], [_TYPES[c[1]] for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = TreeAutomaton()
        for batch in batches:
            held: list[tuple] = []
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    root = parse(text)
                except ValueError:
                    continue
                if isinstance(root, (dict, list)):
                    held.extend([(rid, *row) for row in rows_of(automaton, root)])
                    if len(held) >= 20_000:
                        yield as_batch(held)
                        held = []
            if held:
                yield as_batch(held)

    def as_batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_array(c, t) for c, t in zip(zip(*held), types)], names=names)

    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("record_id"), F.col(f"`{json_col}`").alias("record"))
    return spread(rows.where(F.col("record").isNotNull() & needed)).mapInArrow(run, schema)


def _array(column: tuple, kind: pa.DataType) -> pa.Array:
    try:
        return pa.array(column, kind)
    except UnicodeEncodeError:  # lone surrogates
        return pa.array([_storable(x) for x in column], kind)


def _storable(x):
    if isinstance(x, str):
        return _clean(x)
    return [tuple(map(_storable, pair)) for pair in x] if isinstance(x, list) else x


def nodes(df: DataFrame, id_col: str, json_col: str, attributes: bool = True, keep_root: bool = True) -> DataFrame:
    """The supertype table: one row for each JSON object of each record, with its variant and shape.

    ``parent_path`` is the path of the nearest enclosing object that is an array element,
    '' where there is none; the root has path ''. Without ``attributes`` the map of scalar
    fields is left null; without ``keep_root`` only array elements are given. The automaton runs
    in any case.
    """

    def rows_of(automaton: TreeAutomaton, root) -> Iterator[tuple]:
        for n in walk(root, automaton):
            if n.element or keep_root:
                fields = [(k, _scalar_text(v)) for k, v in n.value.items() if not isinstance(v, (dict, list))] if attributes else None
                yield (n.number, n.parent_number, n.path, n.parent, n.depth, n.element, n.state.variant, n.state.shape, fields)

    needed = F.lit(True) if keep_root else F.col("record").contains("[") & F.col("record").contains("{")
    return _walked(df, id_col, json_col, NODE_SCHEMA, rows_of, needed)


def element_links(supertype: DataFrame, id_col: str) -> DataFrame:
    """Only the links of a supertype table: record, node path and parent path of each object routed to a variant that is an array element."""
    routed = supertype.where(F.col("variant").isin([*SUBTYPES]) & F.col("in_array"))
    return routed.select(F.col("record_id").alias(id_col), "node_path", "parent_path")


VALUE_SCHEMA = "record_id bigint, node_path string, parent_path string, parent_no int, kind string, value string"


def array_values(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """One row for each scalar that is an array element, at any depth.

    ``node_path`` ends in the position, ``parent_path`` and ``parent_no`` link as in ``nodes``;
    ``kind`` is string, number, bool or null, and numbers are kept as written.
    """

    def rows_of(automaton: TreeAutomaton, root) -> list[tuple]:
        values: list[tuple] = []
        walk(root, automaton, values)
        return values

    return _walked(df, id_col, json_col, VALUE_SCHEMA, rows_of, F.col("record").contains("["))


def _attr(name: str, kind: str = "string") -> Column:
    return F.try_element_at("attrs", F.lit(name)).try_cast(kind)


#: Typed subtype tables: variant -> columns taken from the attributes.
SUBTYPES = {
    "text_part": (("text", "string"),),
    "thinking_part": (("thinking", "string"),),
    "tool_call": (("id", "string"), ("name", "string")),
    "media_part": (("type", "string"),),
    "message": (("role", "string"), ("toolCallId", "string"), ("content", "string")),
    "typed": (("type", "string"), ("path", "string"), ("name", "string")),
    "edit": (("old", "string"), ("new", "string")),
    "located": (("path", "string"),),
    "untyped": (("name", "string"), ("line", "bigint"), ("ok", "boolean")),
}


def subtype_table(supertype: DataFrame, variant: str) -> DataFrame:
    """The typed table of one variant.

    Each table keeps the supertype keys, so ``(record_id, parent_no)`` of one joins
    ``(record_id, node_no)`` of any other. ``attrs`` keeps every scalar field, so fields
    that come and go are in the typed column where the subtype has one and in the map
    otherwise. Scalars that are array elements belong to no object's fields: they are the
    rows of ``array_values``, whose ``parent_no`` joins in the same way. An empty array
    holds no value and shows only in the shape.
    """
    keys = ["record_id", "node_no", "parent_no", "node_path", "parent_path", "depth", "in_array", "shape"]
    typed = [_attr(name, kind).alias(name) for name, kind in SUBTYPES[variant]]
    return supertype.where(F.col("variant") == variant).select(*keys, *typed, "attrs")


def subtype_tables(supertype: DataFrame) -> dict[str, DataFrame]:
    """Every variant's typed table; each object is in exactly one."""
    return {variant: subtype_table(supertype, variant) for variant in SUBTYPES}


def shape_catalog(all_nodes: DataFrame) -> DataFrame:
    """Each shape with its variant and how often it occurs; partial aggregation only."""
    return all_nodes.groupBy("shape", "variant").agg(
        F.count(F.lit(1)).alias("objects"), F.max("depth").alias("max_depth")
    )
