"""Declared tables: keys, clustering order, columns, and the registry of user-defined types."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

from lamina import types as L
from lamina.errors import SchemaProblem


@dataclass(frozen=True)
class Column:
    """role: partition, clustering, static or regular."""

    name: str
    type: L.CqlType
    role: str = "regular"
    descending: bool = False
    default: object = None
    nullable: bool = True


@dataclass(frozen=True)
class TableSpec:
    """A table: its columns in order. Partition and clustering keys are ordered as they stand in the key."""

    keyspace: str
    name: str
    columns: tuple[Column, ...]
    partition_key: tuple[str, ...]
    clustering_key: tuple[str, ...] = ()
    options: dict = field(default_factory=dict, compare=False)
    indexes: tuple[str, ...] = ()
    comment: str = ""

    def __post_init__(self):
        if not self.keyspace or not self.name:
            raise SchemaProblem("a table needs a keyspace and a name")
        if not self.partition_key:
            raise SchemaProblem(f"{self.name}: a table needs a partition key")
        names = [c.name for c in self.columns]
        if len({n.lower() for n in names}) != len(names):
            raise SchemaProblem(f"{self.name}: a column stands twice")
        keys = [*self.partition_key, *self.clustering_key]
        if len(set(keys)) != len(keys):
            raise SchemaProblem(f"{self.name}: a key column stands twice")
        for k in keys:
            if k not in names:
                raise SchemaProblem(f"{self.name}: key column {k} is not declared")

    @property
    def key(self) -> tuple[str, ...]:
        return self.partition_key + self.clustering_key

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise SchemaProblem(f"{self.name} has no column {name}")

    @property
    def statics(self) -> list[str]:
        return [c.name for c in self.columns if c.role == "static"]

    @property
    def regulars(self) -> list[str]:
        return [c.name for c in self.columns if c.role == "regular"]

    def struct(self, udts: dict[str, T.StructType] | None = None) -> T.StructType:
        return T.StructType([L.field(c.name, c.type, udts, c.role != "partition") for c in self.columns])

    def ddl(self) -> str:
        """CREATE TABLE text that gives this table again."""
        body = [f"{c.name} {c.type}" + " STATIC" * (c.role == "static") for c in self.columns]
        part = ", ".join(self.partition_key)
        key = ", ".join([f"({part})" if len(self.partition_key) > 1 else part, *self.clustering_key])
        order = ", ".join(f"{k} {'DESC' if self.column(k).descending else 'ASC'}" for k in self.clustering_key)
        return f"CREATE TABLE {self.keyspace}.{self.name} ({', '.join(body)}, PRIMARY KEY ({key}))" + (f" WITH CLUSTERING ORDER BY ({order})" if order else "")

    def altered(self, add: list[Column] = (), drop: list[str] = (), rename: dict[str, str] | None = None, retype: dict[str, L.CqlType] | None = None) -> TableSpec:
        rename, retype = rename or {}, retype or {}
        for d in drop:
            if d in self.key:
                raise SchemaProblem(f"key column {d} cannot be dropped")
            self.column(d)
        for r in rename:
            if r not in self.key:
                raise SchemaProblem(f"only key columns can be renamed, not {r}")
        columns = tuple(replace(c, name=rename.get(c.name, c.name), type=retype.get(c.name, c.type)) for c in self.columns if c.name not in drop) + tuple(add)
        new = lambda ks: tuple(rename.get(k, k) for k in ks)
        return replace(self, columns=columns, partition_key=new(self.partition_key), clustering_key=new(self.clustering_key))


def table(keyspace: str, name: str, columns: dict[str, str], partition_key: list[str], clustering_key: list[str | tuple[str, str]] = (), static: list[str] = (), udts: set[str] | None = None, **more) -> TableSpec:
    """A table from type texts; a clustering column may be (name, 'DESC')."""
    order = {k if isinstance(k, str) else k[0]: not isinstance(k, str) and k[1].upper() == "DESC" for k in clustering_key}
    role = lambda c: "partition" if c in partition_key else "clustering" if c in order else "static" if c in static else "regular"
    cols = tuple(Column(c, L.parse_type(t, udts), role(c), order.get(c, False)) for c, t in columns.items())
    return TableSpec(keyspace, name, cols, tuple(partition_key), tuple(order), **more)


def from_json(text: str, udts: set[str] | None = None) -> TableSpec:
    """A table from JSON, in either form: lists of keys and columns, or columns by name with their kind."""
    try:
        d = json.loads(text)
    except ValueError as e:
        raise SchemaProblem(f"not JSON: {e}") from None
    name = d.get("table") or d.get("name") or ""
    if isinstance(d.get("columns"), dict):
        kinds = {c: v.get("kind", "Regular").lower().replace("key", "").strip("_") for c, v in d["columns"].items()}
        pick = lambda k: [c for c, v in sorted(d["columns"].items(), key=lambda x: x[1].get("position", 0)) if kinds[c].startswith(k)]
        return table(d.get("keyspace", ""), name, {c: v["type"] for c, v in d["columns"].items()}, pick("partition"), pick("clustering"), pick("static"), udts)

    def keys(which: str) -> list:
        got = sorted(d.get(which) or [], key=lambda k: k.get("position", 0))
        if [k.get("position", i) for i, k in enumerate(got)] != list(range(len(got))):
            raise SchemaProblem(f"{name}: positions of {which} must run from 0 without gaps")
        return got

    parts, clusters = keys("partition_keys"), keys("clustering_keys")
    columns = {c["name"]: c["type"] for c in d.get("columns") or []}
    for k in [*parts, *clusters]:
        columns.setdefault(k["name"], k.get("type") or k.get("data_type") or "")
    order = lambda k: (k["name"], str(k.get("order") or "ASC"))
    return table(d.get("keyspace", ""), name, columns, [k["name"] for k in parts], [order(k) for k in clusters], [c["name"] for c in d.get("columns") or [] if c.get("is_static") or c.get("static")], udts, comment=d.get("comment") or "")


class TypeRegistry:
    """User-defined types of each keyspace, with what they are built from."""

    def __init__(self):
        self._types: dict[str, dict[str, dict[str, L.CqlType]]] = {}

    def register(self, keyspace: str, name: str, fields: dict[str, str | L.CqlType], replace_: bool = False) -> None:
        have = self._types.setdefault(keyspace, {})
        if name.lower() in have and not replace_:
            raise SchemaProblem(f"type {name} exists")
        if not fields:
            raise SchemaProblem(f"type {name} has no fields")
        parsed = {f: L.parse_type(t) if isinstance(t, str) else t for f, t in fields.items()}
        for needed in {u for t in parsed.values() for u in _udts(t)}:
            if needed == name.lower():
                raise SchemaProblem(f"type {name} holds itself")
            if needed not in have:
                raise SchemaProblem(f"type {name} needs {needed}, which is not registered")
        have[name.lower()] = parsed

    def names(self, keyspace: str) -> set[str]:
        return set(self._types.get(keyspace, {}))

    def fields(self, keyspace: str, name: str) -> dict[str, L.CqlType]:
        try:
            return self._types[keyspace][name.lower()]
        except KeyError:
            raise SchemaProblem(f"unknown type {name}") from None

    def dependencies(self, keyspace: str, name: str) -> set[str]:
        """All types that a type is built from, at any depth."""
        out, todo = set(), [name.lower()]
        while todo:
            for t in self.fields(keyspace, todo.pop()).values():
                new = _udts(t) - out
                out |= new
                todo += new
        return out

    def dependents(self, keyspace: str, name: str) -> set[str]:
        return {n for n in self.names(keyspace) if name.lower() in self.dependencies(keyspace, n)}

    def drop(self, keyspace: str, name: str) -> None:
        self.fields(keyspace, name)
        if users := self.dependents(keyspace, name):
            raise SchemaProblem(f"type {name} is used by {', '.join(sorted(users))}")
        del self._types[keyspace][name.lower()]

    def structs(self, keyspace: str) -> dict[str, T.StructType]:
        out: dict[str, T.StructType] = {}

        def build(name: str) -> None:
            if name not in out:
                for d in sorted({u for t in self.fields(keyspace, name).values() for u in _udts(t)}):
                    build(d)
                out[name] = T.StructType([L.field(f, t, out) for f, t in self.fields(keyspace, name).items()])

        for n in self.names(keyspace):
            build(n)
        return out

    def export(self, keyspace: str) -> list[str]:
        """CREATE TYPE texts, each after those it needs."""
        order = sorted(self.names(keyspace), key=lambda n: (len(self.dependencies(keyspace, n)), n))
        return [f"CREATE TYPE {keyspace}.{n} ({', '.join(f'{f} {t}' for f, t in self.fields(keyspace, n).items())})" for n in order]


def _udts(t: L.CqlType) -> set[str]:
    return {t.label.lower().rpartition(".")[2]} if t.name == "udt" else {u for a in t.args for u in _udts(a)}
