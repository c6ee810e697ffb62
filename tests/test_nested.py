import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomarc.operators import nested as N


def brute(value, path="", parent="", element=False, out=None):
    out = [] if out is None else out
    if isinstance(value, dict):
        if element:
            out.append((path, parent))
        inner = path if element else parent
        for k, v in value.items():
            brute(v, f"{path}.{k}" if path else k, inner, False, out)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            brute(v, f"{path}[{i}]", parent, True, out)
    return out


trees = st.recursive(
    st.none() | st.booleans() | st.integers() | st.text(max_size=3),
    lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text("abxs", min_size=1, max_size=2), x, max_size=4),
    max_leaves=25,
)


@settings(max_examples=150, deadline=None)
@given(trees)
def test_walk_equals_brute_force(tree):
    root = N.parse(json.dumps(tree))
    if isinstance(root, (dict, list)):
        walked = N.walk(root, N.TreeAutomaton())
        got = [(n.path, n.parent) for n in walked if n.element]
        assert [n.number for n in walked] == [*range(len(walked))]
        assert all(n.parent_number is None and n.parent == "" or walked[n.parent_number].path == n.parent for n in walked)
        assert sorted(got) == sorted(brute(tree))


@settings(max_examples=150, deadline=None)
@given(trees)
def test_deep_parser_equals_the_library(tree):
    text = json.dumps(tree, indent=1)
    plain = json.loads(text, parse_int=N.Num, parse_float=N.Num)
    assert N.parse_deep(text) == plain


@pytest.mark.parametrize("text", ["", "{", "[1,]", '{"a":1,}', "NaN", '{"a" 1}', "[1] 2", '{"a":Infinity}', None, "{'a':1}"])
def test_invalid_json(text):
    with pytest.raises(ValueError):
        N.parse(text)
    if text:
        with pytest.raises(ValueError):
            N.parse_deep(text)


def test_very_deep_records():
    text = "[" * 60_000 + "{}" + "]" * 60_000
    rows = N.walk(N.parse(text), N.TreeAutomaton())
    assert len(rows) == 1 and rows[0].element


def test_shapes_tell_variants_apart():
    a = N.TreeAutomaton()
    shape = lambda t: N.walk(N.parse(t), a)[0].state.shape
    assert shape('{"a":1,"b":"x"}') == shape('{"b":"y","a":2.5}') != shape('{"a":1}')
    assert shape('{"a":[1,2]}') == shape('{"a":[3]}') != shape('{"a":["x"]}')


def test_states_decide_variants():
    a = N.TreeAutomaton()
    state = lambda t: N.walk(N.parse(t), a)[0].state
    assert state('{"type":"text","text":"x"}').variant == "text_part"
    assert state('{"text":"y","note":1,"type":"text"}').variant == "text_part"
    assert state('{"type":"text","text":{"a":1}}').variant == "typed"  # same tag, another shape
    assert state('{"type":"text","source":{}}').variant == "media_part"
    assert state('{"type":"toolCall","id":"c"}').variant == "typed"
    assert state('{"type":"toolCall","name":null}').variant == "typed"
    assert state('{"type":1,"text":"x"}').variant == "untyped"
    assert state('{"old":"a","new":"b","path":"p"}').variant == "edit"
    # equal states mean equal variants, at any place and in any order of the members
    assert state('{"type":"text","text":"x"}') == state('{"text":"other","type":"text"}') != state('{"type":"image","text":"x"}')
    assert N.TreeAutomaton().object(()) == a.object(())


def test_keys_with_dots_have_numbers_of_their_own():
    rows = N.walk(N.parse('{"a.b":[{"x":[{}]}],"a":{"b":[{"x":[{}]}]},"":[{}]}'), N.TreeAutomaton())
    elements = [(n.number, n.parent_number, n.path) for n in rows if n.element]
    assert elements == [(1, None, "a.b[0]"), (2, 1, "a.b[0].x[0]"), (4, None, "a.b[0]"), (5, 4, "a.b[0].x[0]"), (6, None, "[0]")]


def test_nodes(spark):
    rows = [
        (1, '{"content":[{"type":"text","text":"a"},{"type":"toolCall","id":"c","name":"n","arguments":{"xs":[{"q":1.0},[{"z":null}]]}}]}', 9),
        (2, None, 9), (3, "not json", 9), (4, '"{}"', 9), (5, '{"content":[]}', 9), (1, '{"content":[{}]}', 9),
    ]
    df = spark.createDataFrame(rows, "row_id bigint, message string, node_path int")
    links = {tuple(r) for r in N.element_links(N.nodes(df, "row_id", "message", False, False), "row_id").collect()}
    assert links == {
        (1, "content[0]", ""), (1, "content[1]", ""), (1, "content[1].arguments.xs[0]", "content[1]"), (1, "content[1].arguments.xs[1][0]", "content[1]"),
    }
    tables = N.subtype_tables(N.nodes(df, "row_id", "message"))
    assert [r["text"] for r in tables["text_part"].collect()] == ["a"]
    assert [(r["id"], r["name"]) for r in tables["tool_call"].collect()] == [("c", "n")]
    attrs = {r["node_path"]: r["attrs"] for r in tables["untyped"].where("record_id = 1").collect()}
    assert attrs["content[1].arguments.xs[0]"] == {"q": "1.0"}
    everything = N.nodes(df, "row_id", "message")
    assert sum(t.count() for t in tables.values()) == everything.count()
    numbers = {(r["node_no"], r["parent_no"]) for r in everything.where("record_id = 1 and node_path like '%xs%'").collect()}
    assert len(numbers) == 2 and all(p is not None for _, p in numbers)
    assert N.nodes(df.limit(0), "row_id", "message").count() == 0
    odd = spark.createDataFrame([(1, '[{"\\ud800":"\\udfff"}]')], "row_id bigint, message string")
    assert N.nodes(odd, "row_id", "message").count() == 1


def test_array_values(spark):
    rows = [
        (1, '{"content":[{"cells":["a",1.0,[null,true]],"xs":[]},"t"],"tags":[2],"n":3}'), (2, "not json"), (3, None), (4, '"[1]"'), (5, '["x"]'), (6, '{"a":"[1]"}'),
    ]
    df = spark.createDataFrame(rows, "row_id bigint, message string")
    assert sorted(tuple(r) for r in N.array_values(df, "row_id", "message").drop("parent_no").collect()) == [
        (1, "content[0].cells[0]", "content[0]", "string", "a"), (1, "content[0].cells[1]", "content[0]", "number", "1.0"), (1, "content[0].cells[2][0]", "content[0]", "null", None),
        (1, "content[0].cells[2][1]", "content[0]", "bool", "true"), (1, "content[1]", "", "string", "t"), (1, "tags[0]", "", "number", "2"), (5, "[0]", "", "string", "x"),
    ]
    assert N.array_values(df.limit(0), "row_id", "message").count() == 0
