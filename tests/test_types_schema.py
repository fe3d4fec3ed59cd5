import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import types as T

from lamina import schema as S
from lamina import types as L
from lamina.errors import SchemaProblem


def test_nested_types_in_any_case():
    t = L.parse_type("LIST<frozen<Map<text, SET<int>>>>")
    assert str(t) == "list<frozen<map<text, set<int>>>>"
    assert L.spark_type(t) == T.ArrayType(T.MapType(T.StringType(), T.ArrayType(T.IntegerType())))


def test_tuple_with_nested_commas():
    t = L.parse_type("tuple<int, map<text, tuple<double, double>>, text>")
    assert [str(a) for a in t.args] == ["int", "map<text, tuple<double, double>>", "text"]


@pytest.mark.parametrize("bad", ["list<>", "map<text>", "list<int", "", "int int", "set<int,int>", "vector<float>", "vector<float, 0>", "<int>"])
def test_bad_types(bad):
    with pytest.raises(SchemaProblem):
        L.parse_type(bad)


def test_unknown_udt_only_where_known_are_given():
    assert L.parse_type("address").name == "udt"
    with pytest.raises(SchemaProblem):
        L.parse_type("address", set())


_SCALAR = st.sampled_from(sorted(L.SCALARS))
_TYPE = st.recursive(_SCALAR, lambda x: st.one_of(x.map(lambda a: f"list<{a}>"), x.map(lambda a: f"frozen<set<{a}>>"), st.tuples(x, x).map(lambda p: f"map<{p[0]}, {p[1]}>"), st.lists(x, min_size=1, max_size=3).map(lambda a: f"tuple<{', '.join(a)}>")), max_leaves=6)


@given(_TYPE)
def test_type_text_round_trip(text):
    assert str(L.parse_type(text)) == text
    assert str(L.parse_type(text.upper())) == text
    L.spark_type(L.parse_type(text))


def test_values():
    check = lambda t, v: L.check_value(L.parse_type(t), v)
    check("list<int>", [1, 2])
    check("map<text, int>", {"a": 1})
    for t, v in [("list<int>", [1, None]), ("set<int>", [1, 1]), ("tinyint", 200), ("ascii", "é"), ("tuple<int, text>", (1,)), ("vector<float, 2>", [1.0]), ("int", True), ("map<text, int>", {"a": None})]:
        with pytest.raises(SchemaProblem):
            check(t, v)


def test_table_rules():
    cols = {"a": "int", "b": "text"}
    S.table("k", "t", cols, ["a"], [("b", "DESC")])
    for args in [("", "t", cols, ["a"]), ("k", "t", cols, []), ("k", "t", cols, ["z"]), ("k", "t", cols, ["a"], ["a"])]:
        with pytest.raises(SchemaProblem):
            S.table(*args)


def test_ddl_round_trip():
    from lamina.dialect.parser import parse

    spec = S.table("k", "t", {"a": "int", "b": "text", "c": "timestamp", "s": "text", "v": "list<int>"}, ["a", "b"], [("c", "DESC")], ["s"])
    tree = parse(spec.ddl())
    assert tree.partition_key == ("a", "b") and tree.order == (("c", True),) and tree.columns[3] == ("s", "text", True)


def test_json_forms():
    a = {"keyspace": "k", "table": "t", "partition_keys": [{"name": "id", "type": "uuid", "position": 0}], "clustering_keys": [{"name": "at", "type": "timestamp", "position": 0, "order": "DESC"}], "columns": [{"name": "v", "type": "set<text>"}]}
    s = S.from_json(json.dumps(a))
    assert s.partition_key == ("id",) and s.column("at").descending and s.column("v").type.name == "set"
    a["partition_keys"][0]["position"] = 1
    with pytest.raises(SchemaProblem):
        S.from_json(json.dumps(a))
    b = {"keyspace": "k", "table": "t", "columns": {"id": {"type": "uuid", "kind": "PartitionKey"}, "n": {"type": "counter", "kind": "Regular"}}}
    assert S.from_json(json.dumps(b)).column("n").type.name == "counter"


def test_registry():
    r = S.TypeRegistry()
    r.register("k", "address", {"street": "text", "zip": "text"})
    r.register("k", "person", {"name": "text", "home": "frozen<address>"})
    assert r.dependencies("k", "person") == {"address"} and r.dependents("k", "address") == {"person"}
    assert r.structs("k")["person"]["home"].dataType["zip"].dataType == T.StringType()
    assert [x.split()[2] for x in r.export("k")] == ["k.address", "k.person"]
    for name, fields in [("address", {"x": "int"}), ("knot", {"x": "list<frozen<knot>>"}), ("lost", {"x": "nowhere"})]:
        with pytest.raises(SchemaProblem):
            r.register("k", name, fields)
    with pytest.raises(SchemaProblem):
        r.drop("k", "address")
