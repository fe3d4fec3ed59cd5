"""The engine: statements in, DataFrames out."""

from __future__ import annotations

import json
import statistics
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina import schema as S
from lamina import types as L
from lamina.dialect import nodes as N
from lamina.dialect.parser import parse, parse_script
from lamina.errors import LaminaError, QueryProblem, SchemaProblem
from lamina.operators import collections as C
from lamina.plans.analyzer import bind, conjuncts, equalities, parameters
from lamina.plans.lower import Lowering
from lamina.sources import readers, sinks, stats
from lamina.sources.catalog import Catalog, Stored


@dataclass(frozen=True)
class Prepared:
    """A parsed statement; values are bound at each run and their number is checked."""

    engine: Engine
    tree: N.Node

    @property
    def parameters(self) -> list[str | int]:
        return parameters(self.tree)

    def execute(self, *values, **named) -> DataFrame:
        return self.engine.run(bind(self.tree, named or list(values)))


class Engine:
    """Tables by name and statements over them.

    ``now`` fixes the time in microseconds since 1970 that now() tells and that time to live is held against; by default it is
    the clock's. ``strict`` asks for ALLOW FILTERING where a query reads more than its partitions.
    """

    def __init__(self, spark: SparkSession, now: int | None = None, strict: bool = False):
        self.spark, self.fixed_now, self.strict = spark, now, strict
        self.catalog = Catalog(spark)
        self.counts = {"queries": 0, "errors": 0, "seconds": 0.0}
        self._trees: dict[str, N.Node] = {}

    # ------------------------------------------------------------ set-up

    @property
    def now(self) -> int:
        return self.fixed_now if self.fixed_now is not None else time.time_ns() // 1000

    def register(self, name: str, df: DataFrame, partition_key: list[str] | None = None, clustering_key: list = (), spec: S.TableSpec | None = None) -> Engine:
        self.catalog.register(name, df, partition_key, clustering_key, spec)
        return self

    def register_files(self, name: str, *paths: str, partition_key: list[str] | None = None, clustering_key: list = (), schema: T.StructType | None = None, **options) -> Engine:
        return self.register(name, readers.read(self.spark, *paths, schema=schema, **options), partition_key, clustering_key)

    def create_table(self, spec: S.TableSpec, path: str | None = None) -> Stored:
        self.catalog.keyspaces.add(spec.keyspace)
        return self.catalog.create(spec, path)

    # ------------------------------------------------------------ statements

    def parse(self, text: str) -> N.Node:
        if text not in self._trees:
            if len(self._trees) > 1000:
                self._trees.clear()
            self._trees[text] = parse(text)
        return self._trees[text]

    def execute(self, text: str, params: list | tuple | dict | None = None) -> DataFrame:
        """Run a statement. A SELECT gives a lazy DataFrame; what writes gives one row that says whether it was applied."""
        began = time.monotonic()
        self.counts["queries"] += 1
        try:
            return self.run(bind(self.parse(text), params))
        except LaminaError:
            self.counts["errors"] += 1
            raise
        except AnalysisException as e:
            self.counts["errors"] += 1
            raise QueryProblem(str(e).splitlines()[0]) from e
        finally:
            self.counts["seconds"] += time.monotonic() - began

    def script(self, text: str) -> list[DataFrame]:
        return [self.run(s) for s in parse_script(text)]

    def prepare(self, text: str) -> Prepared:
        return Prepared(self, self.parse(text))

    def validate(self, text: str) -> tuple[bool, str]:
        """Whether a statement can be run, and why not; nothing is read or written."""
        try:
            tree = self.parse(text)
            if isinstance(tree, N.Select) and not parameters(tree):
                self.run(tree)
            return True, ""
        except (LaminaError, AnalysisException) as e:
            return False, str(e)

    def run(self, s: N.Node) -> DataFrame:
        handler = getattr(self, f"_{type(s).__name__.lower()}", None)
        if handler is None:
            raise QueryProblem(f"{type(s).__name__} can't be run")
        return handler(s)

    def _lowering(self) -> Lowering:
        now = self.now
        return Lowering(self.spark, lambda n: self.catalog.find(n, now), now if self.fixed_now is not None else None, self.strict)

    def _done(self, applied: bool = True) -> DataFrame:
        return self.spark.createDataFrame([(applied,)], "`[applied]` boolean")

    def _select(self, s: N.Select) -> DataFrame:
        return self._lowering().select(s)

    # ------------------------------------------------------------ definitions

    def _createkeyspace(self, s: N.CreateKeyspace) -> DataFrame:
        if s.name.lower() in self.catalog.keyspaces and not s.if_not_exists:
            raise QueryProblem(f"keyspace {s.name} exists")
        self.catalog.keyspaces.add(s.name.lower())
        return self._done()

    def _use(self, s: N.Use) -> DataFrame:
        if s.keyspace.lower() not in self.catalog.keyspaces:
            raise QueryProblem(f"unknown keyspace {s.keyspace}")
        self.catalog.keyspace = s.keyspace.lower()
        return self._done()

    def spec_of(self, s: N.CreateTable) -> S.TableSpec:
        space = (s.keyspace or self.catalog.keyspace).lower()
        direction = dict(s.order)
        if wrong := [c for c in direction if c not in s.clustering_key]:
            raise SchemaProblem(f"CLUSTERING ORDER names {wrong[0]}, which is no clustering column")
        types = {c: t for c, t, _ in s.columns}
        if len(types) != len(s.columns):
            raise SchemaProblem(f"{s.name}: a column stands twice")
        keys = [(k, "DESC" if direction.get(k) else "ASC") for k in s.clustering_key]
        statics = [c for c, _, static in s.columns if static]
        if statics and not s.clustering_key:
            raise SchemaProblem("static columns need a clustering key")
        return S.table(space, s.name, types, list(s.partition_key), keys, statics, self.catalog.registry.names(space), options=dict(s.options))

    def _createtable(self, s: N.CreateTable) -> DataFrame:
        spec = self.spec_of(s)
        full = f"{spec.keyspace}.{spec.name}".lower()
        if s.if_not_exists and (full in self.catalog.tables or full in self.catalog.views):
            return self._done(False)
        self.create_table(spec)
        return self._done()

    def _createtype(self, s: N.CreateType) -> DataFrame:
        space = (s.keyspace or self.catalog.keyspace).lower()
        if s.if_not_exists and s.name.lower() in self.catalog.registry.names(space):
            return self._done(False)
        self.catalog.registry.register(space, s.name, dict(s.fields))
        return self._done()

    def _createindex(self, s: N.CreateIndex) -> DataFrame:
        """Noted only: Parquet's statistics serve filters."""
        full = self.catalog.full(s.table)
        stored = self.catalog.tables.get(full)
        if stored:
            stored.spec.column(s.column)
            stored.spec = replace(stored.spec, indexes=(*stored.spec.indexes, s.column))
        elif full in self.catalog.views:
            df, spec = self.catalog.views[full]
            if spec:
                self.catalog.views[full] = (df, replace(spec, indexes=(*spec.indexes, s.column)))
        else:
            raise QueryProblem(f"unknown table {s.table}")
        self.catalog.indexes[s.name or f"{s.table}_{s.column}_idx"] = (full, s.column, s.kind)
        return self._done()

    def _createview(self, s: N.CreateView) -> DataFrame:
        self.catalog.register(s.name, self._select(s.query))
        return self._done()

    def _drop(self, s: N.Drop) -> DataFrame:
        if s.kind == "type":
            space, _, name = s.name.rpartition(".")
            space = (space or self.catalog.keyspace).lower()
            if name.lower() not in self.catalog.registry.names(space) and s.if_exists:
                return self._done(False)
            self.catalog.registry.drop(space, name)
            return self._done()
        if s.kind == "index":
            found = self.catalog.indexes.pop(s.name, None) is not None
        elif s.kind == "keyspace":
            found = s.name.lower() in self.catalog.keyspaces
            self.catalog.keyspaces.discard(s.name.lower())
            for t in [t for t in {*self.catalog.tables, *self.catalog.views} if t.startswith(f"{s.name.lower()}.")]:
                self.catalog.drop(t)
        else:
            found = self.catalog.drop(s.name)
        if not found and not s.if_exists:
            raise QueryProblem(f"unknown {s.kind} {s.name}")
        return self._done(found)

    def _alter(self, s: N.Alter) -> DataFrame:
        t = self.catalog.stored(s.table)
        known = self.catalog.registry.names(t.spec.keyspace)
        if s.action == "add":
            t.altered(t.spec.altered(add=[S.Column(c, L.parse_type(k, known)) for c, k in s.columns]))
        elif s.action == "drop":
            t.altered(t.spec.altered(drop=[c for c, _ in s.columns]), lambda df: df.drop(*[c for c, _ in s.columns]))
        elif s.action == "rename":
            t.altered(t.spec.altered(rename=dict(s.columns)), lambda df: df.withColumnsRenamed(dict(s.columns)))
        elif s.action == "retype":
            t.altered(t.spec.altered(retype={c: L.parse_type(k, known) for c, k in s.columns}))
        else:
            t.spec.options.update(dict(s.columns))
            t.compaction = t.spec.options.get("compaction", t.compaction)
        return self._done()

    def _truncate(self, s: N.Truncate) -> DataFrame:
        self.catalog.stored(s.table).replace_all({})
        return self._done()

    def _describe(self, s: N.Describe) -> DataFrame:
        if s.what == "tables":
            return self.spark.createDataFrame([(t,) for t in self.tables()], "name string")
        if s.what == "keyspaces":
            return self.spark.createDataFrame([(k,) for k in sorted(self.catalog.keyspaces)], "name string")
        if s.what == "types":
            return self.spark.createDataFrame([(d,) for d in self.catalog.registry.export(self.catalog.keyspace)], "ddl string")
        if s.what == "type":
            space, _, name = s.name.rpartition(".")
            fields = self.catalog.registry.fields((space or self.catalog.keyspace).lower(), name)
            return self.spark.createDataFrame([(f, str(t)) for f, t in fields.items()], "field string, type string")
        return self.describe(s.name)

    def _explain(self, s: N.Explain) -> DataFrame:
        df = self.run(s.query)
        lines = df._jdf.queryExecution().toString().splitlines()
        if s.analyze:
            began = time.monotonic()
            n = df.count()
            lines = [f"rows: {n}", f"seconds: {time.monotonic() - began:.3f}", *lines]
        return self.spark.createDataFrame([(x,) for x in lines], "plan string")

    # ------------------------------------------------------------ writes

    def _value(self, x: N.Node) -> object:
        """What a literal stands for."""
        if isinstance(x, N.Lit):
            return x.value
        raise QueryProblem("a literal is expected here")

    def _stamp(self, using: N.Using, outer: N.Using = N.Using()) -> tuple[int, int | None]:
        stamp, ttl = using.timestamp or outer.timestamp, using.ttl or outer.ttl
        wt = self._value(stamp) if stamp is not None else self.now
        seconds = self._value(ttl) if ttl is not None else 0
        return wt, (self.now + seconds * 1_000_000 if seconds else None)

    def _typed(self, x: N.Node, f: T.StructField):
        c = self._lowering().expr(x, self.spark.range(1))
        if isinstance(x, N.Collection) and isinstance(f.dataType, T.StructType):
            items = x.items if x.kind == "tuple" else x.items[1::2]
            names = None if x.kind == "tuple" else [i.parts[-1].lower() if isinstance(i, N.Name) else str(self._value(i)).lower() for i in x.items[::2]]
            if names is None and len(items) != len(f.dataType):
                raise QueryProblem(f"{f.name}: {len(items)} values for {len(f.dataType)} fields")
            by = dict(zip(names or [g.name.lower() for g in f.dataType], items, strict=True))
            if unknown := set(by) - {g.name.lower() for g in f.dataType}:
                raise QueryProblem(f"{f.name} has no field {sorted(unknown)[0]}")
            c = F.struct(*[(self._typed(by[g.name.lower()], g) if g.name.lower() in by else F.lit(None).cast(g.dataType)).alias(g.name) for g in f.dataType])
        elif isinstance(x, N.Collection) and isinstance(f.dataType, T.ArrayType) and x.items:
            inner = T.StructField(f.name, f.dataType.elementType)
            c = F.array(*[self._typed(i, inner) for i in x.items])
            if f.metadata.get("set"):
                c = F.array_sort(F.array_distinct(c))
        elif isinstance(x, N.Collection) and isinstance(f.dataType, T.MapType) and x.items:
            k, v = T.StructField(f.name, f.dataType.keyType), T.StructField(f.name, f.dataType.valueType)
            c = F.create_map(*[self._typed(i, v if n % 2 else k) for n, i in enumerate(x.items)])
        elif isinstance(x, N.Collection) and not x.items:
            c = F.array() if isinstance(f.dataType, T.ArrayType) else F.create_map()
        if any(isinstance(i, N.Lit) and i.value is None for i in getattr(x, "items", ()) if x.kind != "tuple" and not isinstance(f.dataType, T.StructType)):
            raise QueryProblem(f"{f.name}: null inside a collection")
        return c.cast(f.dataType)

    def _insert(self, s: N.Insert, outer: N.Using = N.Using()) -> DataFrame:
        t = self.catalog.stored(s.table)
        fields = {f.name.lower(): f for f in t.schema}
        one = self.spark.range(1)
        if s.json is not None:
            doc = self._value(s.json)
            try:
                given = {k.lower() for k in json.loads(doc)}
            except (ValueError, AttributeError):
                raise QueryProblem("INSERT JSON needs a JSON object") from None
            if unknown := given - set(fields):
                raise QueryProblem(f"{t.spec.name} has no column {sorted(unknown)[0]}")
            names = [f.name for f in t.schema if f.name.lower() in given]
            parsed = F.from_json(F.lit(doc), T.StructType([fields[n.lower()] for n in names]))
            rows = one.select(parsed.alias("j")).select("j.*")
        else:
            if unknown := [c for c in s.columns if c.lower() not in fields]:
                raise QueryProblem(f"{t.spec.name} has no column {unknown[0]}")
            names = [fields[c.lower()].name for c in s.columns]
            rows = None
            for r in s.rows:
                new = one.select(*[self._typed(v, fields[c.lower()]).alias(fields[c.lower()].name) for c, v in zip(s.columns, r, strict=True)])
                rows = new if rows is None else rows.unionByName(new)
        static_only = not set(t.spec.clustering_key) & set(names) and set(names) & set(t.spec.statics)
        for k in t.spec.partition_key if static_only else t.spec.key:
            if k not in names:
                raise QueryProblem(f"no value for key column {k}")
        rows = self._fixed(rows)
        if not rows.filter(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in t.spec.partition_key])).isEmpty():
            raise QueryProblem("a partition key can't be null")
        if s.if_not_exists:
            have = t.scan(self.now).select(*t.spec.key)
            rows = self._fixed(rows.join(have, list(t.spec.key), "left_anti"))
            if rows.isEmpty():
                return self._done(False)
        wt, expires = self._stamp(s.using, outer)
        marks = ([] if static_only else [""]) + [n for n in names if n not in t.spec.key]
        t.append(rows.withColumns({"__wt": F.lit(wt), "__expires": F.lit(expires).cast("long"), "__set": F.array(*[F.lit(m) for m in marks]), "__kind": F.lit("static" if static_only else "upsert")}))
        return self._done()

    def _fixed(self, df: DataFrame) -> DataFrame:
        """Rows that a statement spells out, as values."""
        return self.spark.createDataFrame(df.collect(), df.schema)

    def _kept(self, df: DataFrame) -> DataFrame:
        """Rows that a statement finds in a table, as a file in the folder that executors share: any number of them, and no later change of a table changes them."""
        base = self.spark.conf.get("spark.checkpoint.dir", None) or self.spark.conf.get("spark.sql.warehouse.dir")
        path = f"{base}/lamina-rows-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def insert_frame(self, table: str, df: DataFrame, write_time: int | None = None, ttl_seconds: int | None = None) -> DataFrame:
        """All rows of a DataFrame as one generation: how much data is loaded."""
        t = self.catalog.stored(table)
        if missing := [k for k in t.spec.key if k not in df.columns]:
            raise QueryProblem(f"no column for key column {missing[0]}")
        marks = ["", *[c for c in df.columns if c not in t.spec.key]]
        wt = write_time if write_time is not None else self.now
        t.append(df.withColumns({"__wt": F.lit(wt), "__expires": F.lit(self.now + ttl_seconds * 1_000_000 if ttl_seconds else None).cast("long"), "__set": F.array(*[F.lit(m) for m in marks]), "__kind": F.lit("upsert")}))
        return self._done()

    def _targets(self, t: Stored, where: N.Node, full: bool) -> tuple[DataFrame, bool]:
        """The keys that a condition names, and whether its values alone give them; else they are those of rows that are there."""
        fixed = equalities(where)
        key = t.spec.key if full else t.spec.partition_key
        named = {n.parts[-1].lower() for n in N.walk(where) if isinstance(n, N.Name)}
        if all(k.lower() in fixed for k in key) and named <= {k.lower() for k in key} and len(conjuncts(where)) == len(key):
            fields = {f.name: f for f in t.schema}
            rows = self.spark.range(1).select()
            for k in key:
                vals = self.spark.range(1).select(F.explode(F.array(*[self._typed(v, fields[k]) for v in fixed[k.lower()]])).alias(k))
                rows = rows.crossJoin(vals)
            return self._fixed(rows), True
        if not all(k.lower() in fixed for k in t.spec.partition_key):
            raise QueryProblem("the condition must fix the partition key")
        now = self.now
        low = Lowering(self.spark, lambda n: self.catalog.find(n, now), now, False)
        return low._filter(t.scan(now), where).select(*t.spec.key), False

    def _update(self, s: N.Update, outer: N.Using = N.Using()) -> DataFrame:
        t = self.catalog.stored(s.table)
        spec, now = t.spec, self.now
        fields = {f.name.lower(): f for f in t.schema}
        for a in s.assigns:
            if spec.column(a.column).role in ("partition", "clustering"):
                raise QueryProblem(f"key column {a.column} can't be set")
        static_only = all(spec.column(a.column).role == "static" for a in s.assigns)
        keys, literal = self._targets(t, s.where, full=not static_only)
        key = list(spec.partition_key if static_only else spec.key)
        current = t.scan(now) if not static_only else t.scan(now).dropDuplicates(key)
        reads = s.condition is not None or s.if_exists or any(a.op != "=" or any(isinstance(n, N.Name) for n in N.walk(a.value)) for a in s.assigns)
        rows = keys
        if reads:
            rows = keys.join(current.withColumn("__there", F.lit(True)), key, "left")
            if s.if_exists or s.condition is not None:
                rows = rows.filter(F.col("__there"))
            if s.condition is not None:
                rows = rows.filter(self._lowering().expr(s.condition, rows))
        out = [F.col(k) for k in key]
        for a in s.assigns:
            f = fields[a.column.lower()]
            v = self._typed(a.value, f) if not any(isinstance(n, N.Name) for n in N.walk(a.value)) and a.op == "=" else None
            out.append((v if v is not None else self._assigned(a, f, spec, rows)).cast(f.dataType).alias(f.name))
        rows = self._kept(rows.select(*out)) if reads or not literal else self._fixed(rows.select(*out))
        if rows.isEmpty():
            return self._done(False)
        wt, expires = self._stamp(s.using, outer)
        marks = [fields[a.column.lower()].name for a in s.assigns]
        t.append(rows.withColumns({"__wt": F.lit(wt), "__expires": F.lit(expires).cast("long"), "__set": F.array(*[F.lit(m) for m in marks]), "__kind": F.lit("static" if static_only else "upsert")}))
        return self._done()

    def _assigned(self, a: N.Assign, f: T.StructField, spec: S.TableSpec, rows: DataFrame):
        """The new value of a change that starts from the old one."""
        old = F.col(f.name)
        if f.metadata.get("counter"):
            value = self._lowering().expr(a.value, rows)
            if a.op not in ("+=", "-="):
                raise QueryProblem("a counter can only be added to")
            return value if a.op == "+=" else -value  # generations hold deltas
        if a.op == "put":
            inner = f.dataType
            if isinstance(inner, T.MapType):
                k, v = self._typed(a.at, T.StructField(f.name, inner.keyType)), self._typed(a.value, T.StructField(f.name, inner.valueType))
                return C.map_put(old, F.create_map(k, v))
            return C.list_put(old, self._lowering().expr(a.at, rows), self._typed(a.value, T.StructField(f.name, inner.elementType)))
        if a.op == "=":
            return self._lowering().expr(a.value, rows)
        if isinstance(f.dataType, T.MapType):
            if a.op == "-=":
                keys = self._typed(a.value, T.StructField(f.name, T.ArrayType(f.dataType.keyType)))
                return C.map_remove(old, keys)
            return C.map_put(old, self._typed(a.value, f))
        if isinstance(f.dataType, T.ArrayType):
            more = self._typed(a.value, f)
            if f.metadata.get("set"):
                return C.set_add(old, more) if a.op != "-=" else C.set_remove(old, more)
            return {"+=": C.append, "-=": C.remove, "prepend": C.prepend}[a.op](old, more)
        value = self._lowering().expr(a.value, rows)
        return old + value if a.op != "-=" else old - value

    def _delete(self, s: N.Delete, outer: N.Using = N.Using()) -> DataFrame:
        t = self.catalog.stored(s.table)
        spec = t.spec
        fixed = equalities(s.where)
        only_partition = spec.clustering_key and all(k.lower() in fixed for k in spec.partition_key) and len(conjuncts(s.where)) == len(spec.partition_key)
        wt, _ = self._stamp(s.using, outer)
        if s.columns:
            for c in s.columns:
                if spec.column(c).role in ("partition", "clustering"):
                    raise QueryProblem(f"key column {c} can't be deleted")
            sets = tuple(N.Assign(c, "=", N.Lit(None)) for c in s.columns)
            return self._update(N.Update(s.table, sets, s.where, N.Using(None, N.Lit(wt)), s.condition, s.if_exists))
        plain = s.condition is None and not s.if_exists
        bounds = self._bounds(t, s.where) if plain and not only_partition else None
        if only_partition and plain:
            (keys, literal), kind = self._targets(t, s.where, full=False), "wipe"
        elif bounds is not None:
            keys, kind, literal = bounds, "range", True
        else:
            (keys, literal), kind = self._targets(t, s.where, full=True), "delete"
            if not plain:
                rows = keys.join(t.scan(self.now), list(spec.key))
                keys, literal = (rows.filter(self._lowering().expr(s.condition, rows)) if s.condition is not None else rows).select(*spec.key), False
        keys = keys if literal else self._kept(keys)
        if keys.isEmpty():
            return self._done(plain)
        t.ranges = t.ranges or kind == "range"
        t.append(keys.withColumns({"__wt": F.lit(wt), "__expires": F.lit(None).cast("long"), "__set": F.array().cast("array<string>"), "__kind": F.lit(kind)}))
        return self._done()

    def _bounds(self, t: Stored, where: N.Node) -> DataFrame | None:
        """The partitions and the interval of each clustering column that a condition names, if it is made of comparisons of key columns with values; else None, also where it fixes the whole key."""
        spec, fields = t.spec, {f.name.lower(): f for f in t.schema}
        names, found = {c.lower(): c for c in spec.clustering_key}, {}
        fixed = equalities(where)
        if not spec.clustering_key or all(k.lower() in fixed for k in spec.key) or not all(k.lower() in fixed for k in spec.partition_key):
            return None
        for c in conjuncts(where):
            of = c.a if isinstance(c, N.Binary) else c.x if isinstance(c, N.Between | N.In) else None
            if not isinstance(of, N.Name) or any(isinstance(n, N.Name) for n in N.walk(c) if n is not of):
                return None
            low = of.parts[-1].lower()
            if low in {k.lower() for k in spec.partition_key}:
                continue
            if low not in names:
                return None
            mine = found.setdefault(names[low], {})
            if isinstance(c, N.Between) and not c.negated:
                new = {"lo": (c.lo, True), "hi": (c.hi, True)}
            elif isinstance(c, N.Binary) and c.op in ("=", "<", "<=", ">", ">="):
                new = ({"lo": (c.b, c.op != ">")} if c.op in ("=", ">", ">=") else {}) | ({"hi": (c.b, c.op != "<")} if c.op in ("=", "<", "<=") else {})
            else:
                return None
            if set(new) & set(mine):
                return None
            mine |= new
        rows = self.spark.range(1).select()
        for k in spec.partition_key:
            rows = rows.crossJoin(self.spark.range(1).select(F.explode(F.array(*[self._typed(v, fields[k.lower()]) for v in fixed[k.lower()]])).alias(k)))
        kinds = {f.name: f.dataType for f in t.schema}

        def end(c: str, side: str) -> list:
            x, closed = found.get(c, {}).get(side, (None, None))
            return [(self._typed(x, fields[c.lower()]) if x is not None else F.lit(None).cast(kinds[c])).alias(side), F.lit(closed).cast("boolean").alias(f"{side}_in")]

        return rows.withColumn("__range", F.struct(*[F.struct(*end(c, "lo"), *end(c, "hi")).alias(c) for c in spec.clustering_key]))

    def _batch(self, s: N.Batch) -> DataFrame:
        """Statements at one time: either all are applied, or, if a condition fails, none."""
        using = N.Using(s.using.ttl, s.using.timestamp or N.Lit(self.now))
        before = {k: dict(t.generations) for k, t in self.catalog.tables.items()}  # numbers and frames only
        try:
            for x in s.statements:
                applied = {N.Insert: self._insert, N.Update: self._update, N.Delete: self._delete}[type(x)](x, using).first()[0]
                if not applied:
                    raise _NotApplied
        except BaseException as e:
            for k, g in before.items():
                if set(g) != set(self.catalog.tables[k].generations):
                    self.catalog.tables[k].replace_all(g)
            if isinstance(e, _NotApplied):
                return self._done(False)
            raise
        return self._done()

    # ------------------------------------------------------------ client helpers

    def tables(self) -> list[str]:
        return sorted({*self.catalog.tables, *self.catalog.views})

    def describe(self, table: str) -> DataFrame:
        """(name, type, role, position) of a table's columns."""
        spec = self.catalog.spec(table)
        if spec is None:
            df, _ = self.catalog.find(table, self.now)
            return self.spark.createDataFrame([(f.name, str(L.from_spark(f.dataType)), "regular", k) for k, f in enumerate(df.schema)], "name string, type string, role string, position int")
        return self.spark.createDataFrame([(c.name, str(c.type), c.role + (" desc" if c.descending else ""), k) for k, c in enumerate(spec.columns)], "name string, type string, role string, position int")

    def schema(self, table: str) -> str:
        return self.catalog.schema_json(table)

    def ddl(self, table: str) -> str:
        spec = self.catalog.spec(table)
        if spec is None:
            raise QueryProblem(f"{table} has no declared key")
        return spec.ddl()

    def partition_keys(self, table: str) -> list[str]:
        spec = self.catalog.spec(table)
        return list(spec.partition_key) if spec else []

    def clustering_keys(self, table: str) -> list[str]:
        spec = self.catalog.spec(table)
        return list(spec.clustering_key) if spec else []

    def column_type(self, table: str, column: str) -> str:
        spec = self.catalog.spec(table)
        if spec:
            return str(spec.column(column).type)
        return str(L.from_spark(self.catalog.find(table, self.now)[0].schema[column].dataType))

    def query_one(self, text: str, params=None) -> Row | None:
        return self.execute(text, params).first()

    def query_count(self, text: str, params=None) -> int:
        return self.execute(text, params).count()

    def query_exists(self, text: str, params=None) -> bool:
        return not self.execute(text, params).isEmpty()

    def query_columns(self, table: str, *columns: str, where: str | None = None, limit: int | None = None) -> DataFrame:
        quoted = ", ".join('"' + c.replace('"', '""') + '"' for c in columns) or "*"
        return self.execute(f"SELECT {quoted} FROM {table}" + (f" WHERE {where}" if where else "") + (f" LIMIT {limit}" if limit is not None else ""))

    def query_files(self, text: str, table: str, *paths: str) -> DataFrame:
        """One query over many files, read as one table."""
        sub = Engine(self.spark, self.fixed_now, self.strict)
        return sub.register_files(table, *paths).execute(text)

    def head(self, table: str, n: int = 10) -> DataFrame:
        return self.catalog.find(table, self.now)[0].limit(n)

    sample = head

    def iterate(self, text: str, params=None) -> Iterator[Row]:
        """Rows one after the other, the next partition fetched while one is read."""
        return self.execute(text, params).toLocalIterator(prefetchPartitions=True)

    def pages(self, text: str, size: int, params=None) -> Iterator[list[Row]]:
        page: list[Row] = []
        for r in self.iterate(text, params):
            page.append(r)
            if len(page) == size:
                yield page
                page = []
        if page:
            yield page

    def explain(self, text: str, params=None) -> str:
        return self.execute(text, params)._jdf.queryExecution().toString()

    def table_stats(self, table: str) -> DataFrame:
        return stats.table_stats(self.catalog.find(table, self.now)[0], self.partition_keys(table))

    def column_stats(self, table: str, exact: bool = False) -> DataFrame:
        return stats.column_stats(self.catalog.find(table, self.now)[0], exact=exact)

    def stats(self) -> dict:
        n = self.counts["queries"]
        return {**self.counts, "tables": len(self.tables()), "mean_seconds": self.counts["seconds"] / n if n else 0.0}

    def compact(self, table: str, gc_grace_seconds: int = 864_000, only_if_due: bool = False) -> bool:
        """Merge a table's generations; with ``only_if_due`` if its compaction strategy would merge some now."""
        t = self.catalog.stored(table)
        if only_if_due and not t.due():
            return False
        t.compact(self.now, gc_grace_seconds)
        return True

    def open_table(self, path: str) -> Engine:
        """A stored table that an earlier session wrote under a path."""
        self.catalog.open(path)
        return self

    def export(self, text: str, path: str, format: str, **options) -> None:
        sinks.export(self.execute(text), path, format, **options)

    def import_file(self, table: str, path: str, format: str | None = None, **options) -> None:
        """A file's rows into a stored table, with the table's types."""
        t = self.catalog.stored(table)
        kind = format or readers.detect_format(path)
        if kind == "csv":
            raw = readers.read(self.spark, path, format="csv", inferSchema=False, **options)
            rows = raw.select(*[self._from_text(raw, f).alias(f.name) for f in t.schema if f.name in raw.columns])
        else:
            rows = readers.read(self.spark, path, schema=t.schema if kind == "json" else None, format=kind, **options)
        self.insert_frame(table, rows.select(*[c for c in rows.columns if c in {f.name for f in t.schema}]))

    @staticmethod
    def _from_text(raw: DataFrame, f: T.StructField):
        c = F.col(f"`{f.name}`")
        return F.from_json(c, f.dataType) if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType) else F.unbase64(c) if isinstance(f.dataType, T.BinaryType) else c.cast(f.dataType)

    def benchmark(self, text: str, runs: int = 5) -> dict:
        """Seconds of a query over several runs."""
        took = []
        for _ in range(runs):
            began = time.monotonic()
            self.execute(text).write.format("noop").mode("overwrite").save()
            took.append(time.monotonic() - began)
        return {"runs": runs, "mean": statistics.fmean(took), "least": min(took), "most": max(took), "stddev": statistics.pstdev(took)}


class _NotApplied(Exception):
    pass


def quick_query(spark: SparkSession, path: str, text: str, table: str = "data") -> DataFrame:
    """A query over one file."""
    return Engine(spark).register_files(table, path).execute(text)
