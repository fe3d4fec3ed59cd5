"""Syntax trees to DataFrames and Columns: all by Spark's own operators, so that its optimizer sees the whole query."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lamina import types as L
from lamina.dialect import nodes as N
from lamina.errors import QueryProblem
from lamina.functions.aggregates import AGGREGATES, DISTINCT, WINDOWS
from lamina.functions.scalars import SCALARS
from lamina.plans.analyzer import aggregates, check_select, is_aggregate, needs_filtering
from lamina.schema import TableSpec

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class Lowering:
    """find(name) gives a table's DataFrame and its spec, None where it has none; ``now`` is the time that now() tells, in microseconds."""

    def __init__(self, spark: SparkSession, find: Callable[[str], tuple[DataFrame, TableSpec | None]], now: int | None = None, strict: bool = False):
        self.spark, self.find, self.now, self.strict = spark, find, now, strict
        self.ctes: dict[str, DataFrame] = {}
        self._names = itertools.count()

    # ------------------------------------------------------------ queries

    def select(self, q: N.Select) -> DataFrame:
        try:
            return self._select(q)
        except AnalysisException as e:
            raise QueryProblem(str(e).splitlines()[0]) from e

    def _select(self, q: N.Select) -> DataFrame:
        check_select(q)
        outer = dict(self.ctes)
        for name, sub in q.ctes:
            self.ctes[name.lower()] = self._select(sub)
        try:
            return self._body(q)
        finally:
            self.ctes = outer

    def _body(self, q: N.Select) -> DataFrame:
        df, spec = self._source(q.source) if q.source else (self.spark.range(1).select(), None)
        if spec is not None and self.strict and not q.allow_filtering and (why := needs_filtering(q, spec)):
            raise QueryProblem(f"{why}: add ALLOW FILTERING")
        if q.where is not None:
            df = self._filter(df, q.where)
        if q.per_partition is not None:
            if spec is None:
                raise QueryProblem("PER PARTITION LIMIT needs a table with a declared key")
            df = self._per_partition(df, spec, self._count(q.per_partition))
        items, having, order = q.items, q.having, q.order
        if q.group or aggregates((items, having, tuple(o.x for o in order))):
            df, items, having, order = self._aggregate(df, q)
        df, (having, items, order) = self._subqueries(df, (having, items, order))
        if having is not None:
            df = df.filter(self.expr(having, df))
        out, names = [], []
        for i in items:
            if isinstance(i.x, N.Star):
                cols = [F.col(f"{_quote(i.x.of)}.*")] if i.x.of else [F.col("*")]
                # helper columns are not the query's
                shown = df.select(*cols).columns
                if any(c.startswith("__") for c in shown):
                    cols = [F.col(_quote(c)) for c in shown if not c.startswith("__")]
                out += cols
                names += [c for c in shown if not c.startswith("__")]
            else:
                n = i.alias or _title(i.x)
                out.append(self.expr(i.x, df).alias(n))
                names.append(n)
        if q.distinct:
            done = df.select(*out).distinct()
            done = self._limits(self._sorted_output(done, order, items, q), q)
        elif order:
            own = {n.lower() for n in names}
            keys, hidden = [], []
            for k, o in enumerate(order):
                if isinstance(o.x, N.Lit) and isinstance(o.x.value, int):
                    if not 1 <= o.x.value <= len(names):
                        raise QueryProblem(f"ORDER BY {o.x.value}: there are {len(names)} columns")
                    keys.append((_quote(names[o.x.value - 1]), o))
                elif isinstance(o.x, N.Name) and len(o.x.parts) == 1 and o.x.parts[0].lower() in own and names.count(o.x.parts[0]) <= 1:
                    keys.append((_quote(o.x.parts[0]), o))
                else:
                    hidden.append(self.expr(o.x, df).alias(f"__order{k}"))
                    keys.append((f"__order{k}", o))
            done = df.select(*out, *hidden).orderBy(*[_ordered(F.col(c), o) for c, o in keys])
            done = self._limits(done, q)
            done = done.drop(*[f"__order{k}" for k in range(len(order))]) if hidden else done
        else:
            done = self._limits(df.select(*out), q)
        return done.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("[json]")) if q.json else done

    def _sorted_output(self, df: DataFrame, order, items, q: N.Select) -> DataFrame:
        if not order:
            return df
        keys = []
        for o in order:
            at = next((k for k, i in enumerate(items) if i.x == o.x), None)
            c = F.col(_quote(df.columns[at])) if at is not None and not any(isinstance(i.x, N.Star) for i in items) else self.expr(o.x, df)
            keys.append(_ordered(c, o))
        return df.orderBy(*keys)

    def _count(self, x: N.Node) -> int:
        if not isinstance(x, N.Lit) or not isinstance(x.value, int) or isinstance(x.value, bool) or x.value < 0:
            raise QueryProblem("a limit is a whole number, 0 or more")
        return x.value

    def _limits(self, df: DataFrame, q: N.Select) -> DataFrame:
        if q.offset is not None:
            df = df.offset(self._count(q.offset))
        return df.limit(self._count(q.limit)) if q.limit is not None else df

    def _per_partition(self, df: DataFrame, spec: TableSpec, n: int) -> DataFrame:
        from lamina.operators.partitions import per_partition_limit

        return per_partition_limit(df, spec, n)

    # ------------------------------------------------------------ sources

    def _source(self, s: N.Node) -> tuple[DataFrame, TableSpec | None]:
        if isinstance(s, N.Table):
            low = s.name.lower()
            df, spec = (self.ctes[low], None) if low in self.ctes else self.find(s.name)
            return df.alias(s.alias or s.name.rpartition(".")[2]), spec
        if isinstance(s, N.Derived):
            df = self._select(s.query)
            return (df.alias(s.alias) if s.alias else df), None
        if isinstance(s, N.Join):
            left, right = self._source(s.left)[0], self._source(s.right)[0]
            if s.kind == "cross":
                return left.crossJoin(right), None
            if s.using:
                return left.join(right, list(s.using), s.kind), None
            return left.join(right, self.expr(s.on, None), s.kind), None
        raise QueryProblem(f"no source: {type(s).__name__}")

    # ------------------------------------------------------------ filters and subqueries

    def _filter(self, df: DataFrame, where: N.Node) -> DataFrame:
        """Conjuncts in turn: IN and EXISTS with a query become semi and anti joins, the rest one filter."""
        from lamina.plans.analyzer import conjuncts

        plain = []
        for c in conjuncts(where):
            negated = isinstance(c, N.Unary) and c.op == "not"
            inner = c.x if negated else c
            if isinstance(inner, N.In) and isinstance(inner.items, N.Select):
                df = self._in_query(df, inner, inner.negated != negated)
            elif isinstance(inner, N.Exists):
                df = self._exists(df, inner.query, negated)
            else:
                plain.append(c)
        if plain:
            df, plain = self._subqueries(df, tuple(plain))
            cond = None
            for c in plain:
                e = self.expr(c, df)
                cond = e if cond is None else cond & e
            keep = df.columns
            df = df.filter(cond)
            if any(c.startswith("__scalar") for c in keep):
                df = df.drop(*[c for c in keep if c.startswith("__scalar")])
        return df

    def _in_query(self, df: DataFrame, x: N.In, negated: bool) -> DataFrame:
        sub = self._select(x.items)
        if len(sub.columns) != 1:
            raise QueryProblem("IN takes a query of one column")
        name = f"__in{next(self._names)}"
        sub = sub.toDF(name)
        if not negated:
            return df.join(sub, self.expr(x.x, df) == F.col(name), "left_semi")
        # NOT IN: a null in the query leaves nothing, a null on the left stays only if the query is empty. Two aggregates tell.
        facts = sub.agg(F.count(F.lit(1)).alias("__n"), F.count(name).alias("__k"))
        tested = df.crossJoin(F.broadcast(facts))  # one row
        tested = tested.filter((F.col("__n") == 0) | (F.col("__n") == F.col("__k")) & self.expr(x.x, df).isNotNull()).drop("__n", "__k")
        return tested.join(sub, self.expr(x.x, df) == F.col(name), "left_anti")

    def _exists(self, df: DataFrame, q: N.Select, negated: bool) -> DataFrame:
        if q.group or q.limit is not None or aggregates(q.items):
            raise QueryProblem("EXISTS takes a plain query")
        sub, _ = self._source(q.source)
        cond = self.expr(q.where, None) if q.where is not None else F.lit(True)
        return df.join(sub, cond, "left_anti" if negated else "left_semi")

    def _subqueries(self, df: DataFrame, trees):
        """Queries that give one value become a column, by a join with their one row."""
        found: dict[N.Scalar, str] = {}

        def change(n: N.Node):
            if isinstance(n, N.Scalar):
                found.setdefault(n, f"__scalar{next(self._names)}")
                return N.Name((found[n],))
            return None

        trees = N.transform(trees, change)
        for n, name in found.items():
            sub = self._select(n.query)
            if len(sub.columns) != 1:
                raise QueryProblem("a query in an expression gives one column")
            # At most one row: a second one raises, none gives null.
            one = sub.toDF("v").limit(2).agg(F.collect_list(F.struct("v")).alias("v"))
            value = F.when(F.size("v") > 1, F.raise_error(F.lit("a query in an expression gave several rows")).cast(sub.schema[0].dataType)).otherwise(F.get(F.col("v"), F.lit(0))["v"])
            df = df.crossJoin(F.broadcast(one.select(value.alias(name))))
        return df, trees

    # ------------------------------------------------------------ aggregation

    def _aggregate(self, df: DataFrame, q: N.Select):
        if any(isinstance(i.x, N.Star) for i in q.items):
            raise QueryProblem("* can't stand with GROUP BY or aggregates")
        columns = {c.lower() for c in df.columns}
        aliases = {i.alias.lower(): i.x for i in q.items if i.alias}
        keys: list[N.Node] = []
        for g in q.group:
            if isinstance(g, N.Lit) and isinstance(g.value, int) and 1 <= g.value <= len(q.items):
                g = q.items[g.value - 1].x
            elif isinstance(g, N.Name) and len(g.parts) == 1 and g.parts[0].lower() not in columns and g.parts[0].lower() in aliases:
                g = aliases[g.parts[0].lower()]
            keys.append(g)
        names = {k: f"__key{i}" for i, k in enumerate(keys)}
        plain = {k.parts[-1].lower(): n for k, n in names.items() if isinstance(k, N.Name)}
        calls = {c: f"__agg{i}" for i, c in enumerate(dict.fromkeys(aggregates((q.items, q.having, tuple(o.x for o in q.order)))))}

        def change(n: N.Node):
            if n in names:
                return N.Name((names[n],))
            if isinstance(n, N.Name) and n.parts[-1].lower() in plain and len(n.parts) <= 2:
                return N.Name((plain[n.parts[-1].lower()],))
            if n in calls:
                return N.Name((calls[n],))
            if isinstance(n, N.Name):
                if len(n.parts) == 1 and n.parts[0].lower() in aliases:
                    return N.transform(aliases[n.parts[0].lower()], change)
                raise QueryProblem(f"{'.'.join(n.parts)} is neither grouped by nor inside an aggregate")
            return n if isinstance(n, N.Select) else None

        items = tuple(N.Item(N.transform(i.x, change), i.alias or _title(i.x)) for i in q.items)
        shown = {i.alias.lower() for i in items}
        order = tuple(o if isinstance(o.x, N.Lit) or isinstance(o.x, N.Name) and len(o.x.parts) == 1 and o.x.parts[0].lower() in shown else N.Order(N.transform(o.x, change), o.descending, o.nulls_first) for o in q.order)
        having = N.transform(q.having, change) if q.having is not None else None
        aggs = [self.expr(c, df).alias(n) for c, n in calls.items()]
        by = [self.expr(k, df).alias(n) for k, n in names.items()]
        if not aggs:
            return df.select(*by).distinct(), items, having, order
        return (df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)), items, having, order

    # ------------------------------------------------------------ expressions

    def expr(self, x: N.Node, df: DataFrame | None) -> Column:
        """A Column. ``df`` is what the expression is over, where known: integer division asks for types."""
        e = lambda y: self.expr(y, df)
        if isinstance(x, N.Lit):
            return F.lit(x.value)
        if isinstance(x, N.Name):
            return F.col(".".join(_quote(p) for p in x.parts))
        if isinstance(x, N.Unary):
            return ~e(x.x) if x.op == "not" else -e(x.x)
        if isinstance(x, N.Binary):
            return self._binary(x, df)
        if isinstance(x, N.Between):
            out = e(x.x).between(e(x.lo), e(x.hi))
            return ~out if x.negated else out
        if isinstance(x, N.In):
            if isinstance(x.items, N.Select):
                raise QueryProblem("IN with a query can only stand by itself or under AND in WHERE")
            if not x.items:
                return F.lit(x.negated)
            out = e(x.x).isin(*[e(i) for i in x.items])
            return ~out if x.negated else out
        if isinstance(x, N.Like):
            if x.regex:
                out = F.rlike(e(x.x), e(x.pattern))
            else:
                out = F.like(e(x.x), e(x.pattern))
            return ~out if x.negated else out
        if isinstance(x, N.IsNull):
            return e(x.x).isNotNull() if x.negated else e(x.x).isNull()
        if isinstance(x, N.Contains):
            kind = self.type_of(x.x, df)
            if isinstance(kind, T.MapType):
                return F.map_contains_key(e(x.x), e(x.value)) if x.key else F.array_contains(F.map_values(e(x.x)), e(x.value))
            if x.key:
                raise QueryProblem("CONTAINS KEY needs a map")
            return F.array_contains(e(x.x), e(x.value))
        if isinstance(x, N.Index):
            return self._index(x, df)
        if isinstance(x, N.Case):
            out = None
            for c, v in x.whens:
                c = e(c) if x.operand is None else e(x.operand) == e(c)
                out = F.when(c, e(v)) if out is None else out.when(c, e(v))
            return out if x.otherwise is None else out.otherwise(e(x.otherwise))
        if isinstance(x, N.Cast):
            kind = L.spark_type(L.parse_type(x.type))
            return e(x.x).try_cast(kind) if x.safe else e(x.x).cast(kind)
        if isinstance(x, N.Interval):
            return F.expr(f"INTERVAL {x.text}" if not x.text[:1].isalpha() else x.text)
        if isinstance(x, N.Collection):
            items = [e(i) for i in x.items]
            if x.kind == "list":
                return F.array(*items)
            if x.kind == "set":
                return F.array_sort(F.array_distinct(F.array(*items)))
            if x.kind == "map":
                return F.create_map(*items)
            return F.struct(*[i.alias(f"_{k}") for k, i in enumerate(items, 1)])
        if isinstance(x, N.Call):
            return self._call(x, df)
        if isinstance(x, N.Param):
            raise QueryProblem(f"parameter {x.key} has no value")
        if isinstance(x, N.Exists | N.Scalar):
            raise QueryProblem("a query can't stand here")
        raise QueryProblem(f"no expression: {type(x).__name__}")

    def type_of(self, x: N.Node, df: DataFrame | None) -> T.DataType | None:
        """Type of an expression, where what it is over is known."""
        if df is None:
            return None
        return df.select(self.expr(x, df)).schema[0].dataType

    def _binary(self, x: N.Binary, df: DataFrame | None) -> Column:
        if isinstance(x.a, N.Collection) and isinstance(x.b, N.Collection) and x.a.kind == x.b.kind == "tuple" and x.op in ("=", "!=", "<", "<=", ">", ">="):
            # Tuples compare column by column, which filters on the parts can use; a struct would hide them.
            if len(x.a.items) != len(x.b.items):
                raise QueryProblem("tuples of different lengths")
            return self._tuples(x.op, [(self.expr(p, df), self.expr(q, df)) for p, q in zip(x.a.items, x.b.items, strict=True)])
        a, b = self.expr(x.a, df), self.expr(x.b, df)
        if x.op == "/":
            kinds = [self.type_of(y, df) for y in (x.a, x.b)]
            if all(isinstance(k, _INTEGRAL) for k in kinds):
                return F.call_function("div", a, b)
            return F.try_divide(a, b)
        ops = {"and": lambda: a & b, "or": lambda: a | b, "=": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b, "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "%": lambda: a % b, "||": lambda: F.concat(a, b)}
        return ops[x.op]()

    @staticmethod
    def _tuples(op: str, pairs: list[tuple[Column, Column]]) -> Column:
        if op in ("=", "!="):
            same = pairs[0][0] == pairs[0][1]
            for a, b in pairs[1:]:
                same = same & (a == b)
            return same if op == "=" else ~same
        (a, b), rest = pairs[0], pairs[1:]
        strict = a < b if op[0] == "<" else a > b
        if not rest:
            return (a <= b if op == "<=" else a >= b) if len(op) == 2 else strict
        return strict | (a == b) & Lowering._tuples(op, rest)

    def _index(self, x: N.Index, df: DataFrame | None) -> Column:
        kind = self.type_of(x.x, df)
        at = self.expr(x.at, df)
        if isinstance(kind, T.MapType):
            return F.try_element_at(self.expr(x.x, df), at.cast(kind.keyType))
        if isinstance(kind, T.StructType):
            if not isinstance(x.at, N.Lit):
                raise QueryProblem("a field is named by a literal")
            return self.expr(x.x, df)[f"_{x.at.value + 1}" if isinstance(x.at.value, int) else x.at.value]
        return F.get(self.expr(x.x, df), at)

    def _call(self, x: N.Call, df: DataFrame | None) -> Column:
        name, args = x.name, [self.expr(a, df) for a in x.args if not isinstance(a, N.Star)]
        values = [a.value if isinstance(a, N.Lit) else None for a in x.args]
        if x.over is not None:
            if x.distinct:
                raise QueryProblem(f"{name}(DISTINCT) can't stand over a window")
            if name in ("lag", "lead"):
                out = WINDOWS[name](args[0], values[1] if len(values) > 1 else 1, values[2] if len(values) > 2 else None)
            elif name == "ntile":
                out = F.ntile(values[0])
            elif name in WINDOWS:
                out = WINDOWS[name](*args)
            elif name in AGGREGATES:
                out = F.count(F.lit(1)) if x.args == (N.Star(),) else AGGREGATES[name](*args)
            else:
                out = F.call_function(name, *args)
            w = Window.partitionBy(*[self.expr(p, df) for p in x.over.partition])
            if x.over.order:
                w = w.orderBy(*[_ordered(self.expr(o.x, df), o) for o in x.over.order])
            if x.over.frame:
                unit, lo, hi = x.over.frame
                lo, hi = Window.unboundedPreceding if lo is None else lo, Window.unboundedFollowing if hi is None else hi
                w = w.rowsBetween(lo, hi) if unit == "rows" else w.rangeBetween(lo, hi)
            return out.over(w)
        if is_aggregate(x):
            if x.args == (N.Star(),):
                return F.count(F.lit(1))
            if x.distinct:
                if name not in DISTINCT:
                    raise QueryProblem(f"{name}(DISTINCT) is not defined")
                return DISTINCT[name](*args)
            return AGGREGATES[name](*args)
        if x.distinct:
            raise QueryProblem(f"{name} is no aggregate")
        if name in ("now", "current_timestamp", "currenttimestamp"):
            return F.timestamp_micros(F.lit(self.now)) if self.now is not None else F.current_timestamp()
        if name == "round" and len(values) == 2:
            return F.round(args[0], values[1])
        if name in SCALARS:
            try:
                return SCALARS[name](*args)
            except TypeError as e:
                raise QueryProblem(f"{name}: wrong number of arguments") from e
        if name in WINDOWS and name not in AGGREGATES:
            raise QueryProblem(f"{name} needs OVER")
        return F.call_function(name, *args)


def _quote(part: str | None) -> str:
    return "`" + str(part).replace("`", "``") + "`"


def _ordered(c: Column, o: N.Order) -> Column:
    """Ascending has nulls first and descending last, unless the query says otherwise."""
    first = not o.descending if o.nulls_first is None else o.nulls_first
    if o.descending:
        return c.desc_nulls_first() if first else c.desc_nulls_last()
    return c.asc_nulls_first() if first else c.asc_nulls_last()


def _title(x: N.Node) -> str:
    """The name of a column without an alias: the column's own, function and argument, or the kind of expression."""
    if isinstance(x, N.Name):
        return x.parts[-1]
    if isinstance(x, N.Call):
        inner = "_".join(_title(a) for a in x.args if not isinstance(a, N.Star))
        return f"{x.name}_{inner}" if inner else x.name
    if isinstance(x, N.Lit):
        return "null" if x.value is None else str(x.value)
    if isinstance(x, N.Index):
        return f"{_title(x.x)}_{_title(x.at)}"
    if isinstance(x, N.Cast):
        return _title(x.x)
    return type(x).__name__.lower()
