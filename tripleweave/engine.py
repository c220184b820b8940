"""SPARQL over mapped tables: patterns are unfolded through the mapping into lazy DataFrames.

A relation is a DataFrame with, for each variable, its lexical form (`v_x`), a tag (`t_x`, only if it isn't static) and, where
a term is made from columns, those columns as they are (`k_x_0`, ...). Joins run on these native columns wherever both sides
come from templates of one shape, constants become predicates on columns, and terms that can't meet are never joined.
"""

from __future__ import annotations

import datetime
import functools
import itertools
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.exprs import Expressions, QueryError, compare, ebv, literal, number, of_double, of_int, of_text, of_wide  # noqa: F401
from .mapping import Mapping, RefMap, TermMap, TriplesMap
from .operators import paths
from .sparql import ast as A
from .sparql.parser import RDF, parse
from .terms import INTEGRAL, NATURAL, NUMERIC, TEMPORAL, XSD, Info, Native, Value, datatype_of, encode, kind_of, lexical, meet, tag_of, to_double, to_time, typed


@dataclass
class Catalog:
    """Tables by name (case does not matter) and declared keys by source."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    keys: dict[str, list[frozenset[str]]] = field(default_factory=dict)
    filled: dict[str, set[str]] = field(default_factory=dict)

    @classmethod
    def from_spark(cls, spark: SparkSession, mapping: Mapping, keys: dict[str, list[tuple[str, ...]]] | None = None) -> Catalog:
        """The tables that a mapping names, from the session's catalog, and their NOT NULL columns. keys: of tables and of views
        ("view:<sql>"), which Spark's catalog doesn't know."""
        cat = cls(spark)
        for m in mapping.maps.values():
            if m.source is not None:
                cat.declare_filled(m.source, *[f.name for f in cat.frame(m).schema.fields if not f.nullable])
        for source, found in (keys or {}).items():
            for k in found:
                cat.declare_key(source, *k)
        return cat

    def add(self, name: str, df: DataFrame, *keys: tuple[str, ...]) -> Catalog:
        self.tables[name.lower()] = df
        df.createOrReplaceTempView(name)
        for k in keys:
            self.declare_key(name, *k)
        return self

    def declare_key(self, source: str, *columns: str) -> None:
        """The columns (of a table, or of "view:<sql>") are unique and not null."""
        self.keys.setdefault(source.lower(), []).append(frozenset(c.lower() for c in columns))
        self.declare_filled(source, *columns)

    def declare_filled(self, source: str, *columns: str) -> None:
        """The columns hold no nulls."""
        self.filled.setdefault(source.lower(), set()).update(c.lower() for c in columns)

    def verify(self) -> list[str]:
        """What the data contradict: sources whose declared key is null in a row or repeats."""
        wrong = []
        for source, keys in self.keys.items():
            for k in keys if source in self.tables else ():
                cols = [_c(c) for c in sorted(k)]
                null = functools.reduce(lambda a, b: a | b, [c.isNull() for c in cols])
                if not self.tables[source].groupBy(*cols).count().where(null | (F.col("count") > 1)).isEmpty():
                    wrong.append(f"{source}: {', '.join(sorted(k))}")
        return wrong

    def frame(self, m: TriplesMap) -> DataFrame:
        if m.source is None:
            raise QueryError(f"{m.id} has no source")
        key = m.source.lower()
        if key not in self.tables:
            self.tables[key] = self.spark.sql(m.sql) if m.sql is not None else self.spark.table(m.table)
        return self.tables[key]

    def never_null(self, m: TriplesMap, column: str) -> bool:
        return column.lower() in self.filled.get((m.source or "").lower(), ())

    def unique(self, m: TriplesMap, columns) -> bool:
        have = {c.lower() for c in columns}
        return any(k <= have for k in self.keys.get((m.source or "").lower(), []))


@dataclass
class Rel:
    df: DataFrame
    vars: dict[str, Info]

    def value(self, v: str, prefix: str = "") -> Value:
        info, lex = self.vars[v], F.col(f"`{prefix}v_{v}`")
        if info.tag is None:
            return Value(lex, F.col(f"`{prefix}t_{v}`"))
        d = datatype_of(info.tag)
        kept, wide = None, False
        if info.native and info.native.shape is None and info.tag[0] == "D":
            raw = F.col(f"`{info.native.columns[0]}`")
            kept = raw if d in NUMERIC | TEMPORAL | {XSD + "boolean"} and info.native.types[0] != "string" else None
            wide = d in INTEGRAL and info.native.types[0].startswith("decimal")
        if kept is None and d and d != RDF + "langString":
            kept = typed(lex, d)
        return Value(lex, info.tag, kept, wide)

    def scope(self) -> dict[str, Value]:
        return {v: self.value(v) for v in self.vars}


def _cols(v: str, info: Info) -> list[str]:
    return [f"v_{v}", *([f"t_{v}"] if info.tag is None else []), *(info.native.columns if info.native else ())]


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


class Engine:
    """Engine(spark, mapping, catalog).query(text) gives a DataFrame; quads() the whole graph.

    star: several patterns over one row-unique subject read its table once. A map's subject is row-unique if its columns
    hold a declared key. native: joins run on native columns. Both change plans only, never results."""

    def __init__(self, spark: SparkSession, mapping: Mapping, catalog: Catalog, star: bool = True, native: bool = True, functions: dict | None = None) -> None:
        self.spark, self.mapping, self.catalog, self.star, self.native = spark, mapping, catalog, star, native
        self.functions = functions or {}
        self.maps = [m for m in mapping.maps.values() if m.subject is not None and m.source is not None]
        self.fresh = itertools.count()

    # queries

    def query(self, text: str, typed_results: bool = True) -> DataFrame:
        """SELECT: a column a variable; ASK: one row with `ask`; CONSTRUCT and DESCRIBE: s, p, o in N-Triples form."""
        q = parse(text) if isinstance(text, str) else text
        if q.dataset:
            raise QueryError("FROM and FROM NAMED are not supported")
        self.now = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None, microsecond=0)
        if q.form == "ASK":
            rel = self._modified(replace(q, limit=None, offset=None, order_by=[]), ask=True)
            return rel.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("ask"))
        if q.form in ("CONSTRUCT", "DESCRIBE"):
            return self._construct(q)
        rel = self._modified(q)
        out = []
        for v in rel.vars:
            x = rel.value(v)
            d = datatype_of(x.static)
            out.append((typed(x.lex, d) if x.typed is None else x.typed if d not in INTEGRAL or x.wide else x.typed.cast("bigint")).alias(v) if typed_results and d else x.lex.alias(v))
        return rel.df.select(*out)

    def _names(self, g) -> list[str]:
        return [v for v in self._all_vars(g) if not v.startswith(("%", "_:"))]

    def _modified(self, q: A.Query, ask: bool = False) -> Rel:
        rel = self.group(q.where)
        if q.values:
            rel = self.join(rel, self.values(q.values))
        aggregates = {a for e in [*(e for _, e in q.items), *q.having, *(e for e, _ in q.order_by)] for a in _find(e, A.Aggregate)}
        hidden: dict[str, Info] = {}
        if q.group_by or aggregates:
            rel, found = self._grouped(rel, q, aggregates)
        else:
            found = {}
        items = q.items
        if q.star:
            items = [(A.Var(v), None) for v in rel.vars if not v.startswith(("%", "_:"))]
        for v, e in items:
            if e is not None:
                rel = self._extend(rel, v.name, e, found)
        for h in q.having:
            inside, h = self._with_exists(rel, h)
            rel = Rel(inside.df.where(self._expressions(inside, found).boolean(h)), rel.vars)
        if ask:
            return rel
        keep = {v.name: rel.vars.get(v.name) for v, _ in items}
        df = rel.df
        for v, info in keep.items():
            if info is None:
                df, keep[v] = df.withColumn(f"v_{v}", F.lit(None).cast("string")), Info("L", True)
        rel = Rel(df, rel.vars | keep)
        if q.distinct or q.reduced:
            rel = self._project(rel, list(keep))
            rel = Rel(rel.df.select(*[_c(c) for v, i in rel.vars.items() for c in _cols(v, i)]).distinct(), rel.vars)
        if q.order_by:
            inside, keys, names = rel, [], []
            for e, down in q.order_by:
                inside, e = self._with_exists(inside, e)
                names.append((e, down))
            x = self._expressions(inside, found)
            for e, down in names:
                keys += [(k.desc() if down else k.asc()) for k in self._order(x.value(e))]
            rel = Rel(inside.df.orderBy(*keys), rel.vars)
        df = rel.df
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return self._project(Rel(df, rel.vars), list(keep))

    @staticmethod
    def _project(rel: Rel, names: list[str]) -> Rel:
        names = [v for v in names if v in rel.vars]
        return Rel(rel.df.select(*[_c(c) for v in names for c in _cols(v, rel.vars[v])]), {v: rel.vars[v] for v in names})

    @staticmethod
    def _order(v: Value) -> list[Column]:
        """Unbound, blank nodes, IRIs, literals; these by value space and value. Spark puts nulls first when ascending."""
        d = datatype_of(v.static)
        if d in NUMERIC:
            return [v.typed if v.typed is not None else number(v), v.lex]
        if d in TEMPORAL | {XSD + "boolean"} and v.typed is not None:
            return [v.typed]
        if v.static and v.static != "L":
            return [v.lex]
        t = v.tag_column()
        rank = F.when(t == "B", 1).when(t == "I", 2).when(v.lex.isNotNull(), 3)
        return [rank, F.when(rank == 3, to_double(v.lex)), F.when(rank == 3, to_time(v.lex)), v.lex, t]

    def _expressions(self, rel: Rel, aggregates=None) -> Expressions:
        return Expressions(rel.scope(), None, aggregates, self.functions, self.now)

    def _put(self, rel: Rel, name: str, v: Value, nullable: bool = True) -> Rel:
        df, info = rel.df.withColumn(f"v_{name}", v.lex), Info(v.static, nullable)
        if v.static is None:
            df = df.withColumn(f"t_{name}", v.tag_column())
        elif v.typed is not None and datatype_of(v.static) in NUMERIC | TEMPORAL | {XSD + "boolean"}:
            k = f"k_{next(self.fresh)}_0"
            df = rel.df.withColumn(k, v.typed).withColumn(f"v_{name}", v.lex)
            info = Info(v.static, nullable, Native(None, (k,), (df.schema[k].dataType.simpleString(),)))
        return Rel(df, rel.vars | {name: info})

    def _extend(self, rel: Rel, name: str, e, aggregates=None) -> Rel:
        rel, e = self._with_exists(rel, e)
        return self._put(rel, name, self._expressions(rel, aggregates).value(e))

    def _grouped(self, rel: Rel, q: A.Query, aggregates) -> tuple[Rel, dict]:
        keys: list[str] = []
        for e, v in q.group_by:
            if v is None and isinstance(e, A.TermExpr) and isinstance(e.term, A.Var):
                if e.term.name not in rel.vars:
                    rel = self._put(rel, e.term.name, Value(F.lit(None).cast("string"), "L"))
                keys.append(e.term.name)
            else:
                name = v.name if v else f"%g{next(self.fresh)}"
                rel = self._extend(rel, name, e)
                keys.append(name)
        x, outs, made = self._expressions(rel), [], {}
        for i, a in enumerate(aggregates):
            value = x.value(a.arg) if a.arg is not None else None
            name, out = f"a_{next(self.fresh)}", []
            if a.name == "COUNT":
                if value is None:
                    if a.distinct:
                        rows = F.struct(*[F.coalesce(_c(f"v_{v}"), F.lit("")) for v in rel.vars if not v.startswith("%")], *[_c(f"v_{v}").isNull().alias(f"n{v}") for v in rel.vars])
                        c = F.count_distinct(rows)
                    else:
                        c = F.count(F.lit(1))
                else:
                    one = F.when(value.lex.isNotNull(), F.struct(value.lex.alias("a"), value.tag_column().alias("b"))) if value.static is None else value.lex
                    c = F.count_distinct(one) if a.distinct else F.count(value.lex)
                out = [("l", c)]
                make = lambda c: of_int(c("l"))
            elif a.name == "SUM":
                if datatype_of(value.static) in INTEGRAL:
                    n = (value.typed if value.typed is not None else typed(value.lex, XSD + "integer")).cast("decimal(38,0)")
                    out = [("l", F.coalesce(F.sum_distinct(n) if a.distinct else F.sum(n), F.lit(0)).cast("decimal(38,0)"))]
                    make = lambda c: of_wide(c("l"))
                else:
                    n = number(value)
                    out = [("l", F.coalesce(F.sum_distinct(n) if a.distinct else F.sum(n), F.lit(0.0)))]
                    make = lambda c: of_double(c("l"))
            elif a.name == "AVG":
                n = number(value)
                out = [("l", F.coalesce(F.expr("1") * (F.sum_distinct(n) / F.count_distinct(n)) if a.distinct else F.avg(n), F.lit(0.0)))]
                make = lambda c: of_double(c("l"))
            elif a.name in ("MIN", "MAX"):
                f, by = (F.min, F.min_by) if a.name == "MIN" else (F.max, F.max_by)
                d = datatype_of(value.static)
                if d in NUMERIC | TEMPORAL and value.typed is not None:
                    out = [("l", f(value.typed)), ("t", by(value.lex, value.typed))]
                    make = lambda c, t=value.static: Value(c("t"), t, c("l"))
                elif value.static:
                    out = [("l", f(value.lex))]
                    make = lambda c, t=value.static: Value(c("l"), t)
                else:
                    out = [("l", f(value.lex)), ("t", by(value.tag_column(), value.lex))]
                    make = lambda c: Value(c("l"), c("t"))
            elif a.name == "SAMPLE":
                pair = F.min(F.when(value.lex.isNotNull(), F.struct(value.lex.alias("l"), value.tag_column().alias("t"))))
                out = [("p", pair)]
                make = lambda c, t=value.static: Value(c("p")["l"], t or c("p")["t"])
            else:
                parts = (F.collect_set if a.distinct else F.collect_list)(value.lex)
                out = [("l", F.array_join(F.sort_array(parts), a.separator))]
                make = lambda c: of_text(c("l"))
            outs += [c.alias(f"{name}{suffix}") for suffix, c in out]
            made[a] = make(lambda s, name=name: _c(name + s))
        whole = {"tinyint", "smallint", "int", "bigint"}
        # whole numbers fix a term both ways: groups go by them, and its text is made anew for each group
        short = [k for k in dict.fromkeys(keys) if self.native and rel.vars[k].tag and rel.vars[k].native and set(rel.vars[k].native.types) <= whole]
        cols = [c for k in dict.fromkeys(keys) for c in (rel.vars[k].native.columns if k in short else _cols(k, replace(rel.vars[k], native=None)))]
        carry = [F.first(_c(c)).alias(c) for k in keys if rel.vars[k].native and k not in short for c in rel.vars[k].native.columns]
        # a variable's native columns fix its lexical form, so they can be carried along
        df = rel.df.groupBy(*[_c(c) for c in cols]).agg(*(outs + carry or [F.count(F.lit(1)).alias("a_none")])) if keys else rel.df.agg(*(outs or [F.count(F.lit(1)).alias("a_none")]))
        for k in short:
            nat = rel.vars[k].native
            shape = nat.shape or ("",) * (len(nat.columns) + 1)
            df = df.withColumn(f"v_{k}", F.concat(F.lit(shape[0]), *[x for c, t in zip(nat.columns, shape[1:]) for x in (_c(c).cast("string"), F.lit(t))]))
        return Rel(df, {k: rel.vars[k] for k in keys}), made

    def _construct(self, q: A.Query) -> DataFrame:
        quads = None
        if q.form == "DESCRIBE":
            rel = self.group(q.where)
            names = [v.name for v in q.describe if isinstance(v, A.Var)] or ([v for v in rel.vars if v[0] not in "%_"] if q.star else [])
            found = [rel.df.select(_c(f"v_{v}").alias("__s")) for v in names if v in rel.vars]
            fixed = [t.value for t in q.describe if isinstance(t, A.Iri)]
            if fixed:
                found.append(self.spark.createDataFrame([(x,) for x in fixed], "__s string"))
            ids = functools.reduce(DataFrame.union, found).where("__s is not null").distinct()
            g = self.group(A.Group((A.Triples((A.Triple(A.Var("s"), A.Link(A.Var("p")), A.Var("o")),)),)))
            x = {v: g.value(v) for v in "spo"}
            df = g.df.join(ids, _c("v_s") == _c("__s"), "left_semi")
            return df.select(*[nt(x[v]).alias(v) for v in "spo"])
        rel = self._modified(replace(q, form="SELECT", star=True, items=[]))
        df = rel.df.withColumn("__row", F.monotonically_increasing_id())
        for t in q.template:
            cols = []
            for name, term in zip("spo", (t.s, t.p.term, t.o)):
                if isinstance(term, A.Var):
                    v = rel.value(term.name) if term.name in rel.vars else Value(F.lit(None).cast("string"), "L")
                elif isinstance(term, A.Bnode):
                    v = Value(F.concat(F.lit(f"b{term.label.strip('%')}_"), _c("__row").cast("string")), "B")
                else:
                    v = literal(term)
                ok = v.tag_column() == "I" if name == "p" else v.tag_column().isin("I", "B") if name == "s" else v.lex.isNotNull()
                cols.append(F.when(ok, nt(v)).alias(name))
            one = df.select(*cols).where("s is not null and p is not null and o is not null")
            quads = one if quads is None else quads.unionByName(one)
        return quads.distinct() if quads is not None else self.spark.createDataFrame([], "s string, p string, o string")

    # graph patterns

    def unit(self) -> Rel:
        return Rel(self.spark.range(1).select(F.lit(1).alias("__one")), {})

    def empty(self, names) -> Rel:
        names = list(names)
        schema = T.StructType([T.StructField("__one", T.IntegerType())] + [T.StructField(f"v_{v}", T.StringType()) for v in names])
        return Rel(self.spark.createDataFrame([], schema), {v: Info("L", True) for v in names})

    def _all_vars(self, g) -> list[str]:
        out: dict[str, None] = {}

        def walk(x):
            if isinstance(x, A.Var):
                out[x.name] = None
            elif isinstance(x, A.SubSelect):
                for v, _ in x.query.items:
                    out[v.name] = None
                if x.query.star:
                    walk(x.query.where)
            elif isinstance(x, (tuple, list)):
                for y in x:
                    walk(y)
            elif hasattr(x, "__dataclass_fields__") and not isinstance(x, (A.Filter, A.Minus)):
                for f in x.__dataclass_fields__:
                    walk(getattr(x, f))

        walk(g)
        return list(out)

    def group(self, g: A.Group) -> Rel:
        """A group's patterns in order; its filters hold for the whole group."""
        rel, filters = None, []
        for p in g.parts:
            if isinstance(p, A.Filter):
                filters.append(p.expr)
                continue
            if isinstance(p, A.Triples):
                rel = self.join(rel, self._bgp(p.triples))
            elif isinstance(p, A.Group):
                rel = self.join(rel, self.group(p))
            elif isinstance(p, A.Union):
                rel = self.join(rel, self.union([self.group(x) for x in p.groups]))
            elif isinstance(p, A.Optional_):
                inner = [x for x in p.group.parts if not isinstance(x, A.Filter)]
                conds = [x.expr for x in p.group.parts if isinstance(x, A.Filter)]
                rel = self.left_join(rel if rel is not None else self.unit(), self.group(A.Group(tuple(inner))), conds)
            elif isinstance(p, A.Minus):
                rel = self.minus(rel if rel is not None else self.unit(), self.group(p.group))
            elif isinstance(p, A.Bind):
                rel = rel if rel is not None else self.unit()
                if p.var.name in rel.vars:
                    raise QueryError(f"?{p.var.name} is bound before BIND")
                rel = self._extend(rel, p.var.name, p.expr)
            elif isinstance(p, A.Values):
                rel = self.join(rel, self.values(p))
            elif isinstance(p, A.SubSelect):
                rel = self.join(rel, self._modified(p.query))
            elif isinstance(p, A.Graph):
                raise QueryError("GRAPH is not supported")
            else:
                raise QueryError("SERVICE is not supported")
        rel = rel if rel is not None else self.unit()
        for e in filters:
            rel = self._filter(rel, e)
        return rel

    def _filter(self, rel: Rel, e) -> Rel:
        if isinstance(e, A.Binary) and e.op == "&&":
            return self._filter(self._filter(rel, e.left), e.right)
        if isinstance(e, A.Exists):
            return self._semi(rel, *self._body(e.group, rel), e.negated)
        if isinstance(e, A.Unary) and e.op == "!" and isinstance(e.arg, A.Exists):
            return self._semi(rel, *self._body(e.arg.group, rel), not e.arg.negated)
        names = rel.vars
        rel, e = self._with_exists(rel, e)
        return Rel(rel.df.where(self._expressions(rel).boolean(e)), names)

    def _body(self, g: A.Group, outer: Rel) -> tuple[Rel, list]:
        """The body of an EXISTS, and its filters that read variables of the outer row alone: these belong into the join."""
        own = set(self._all_vars(g))
        far = {v for v in outer.vars if v not in own}
        conds = [p.expr for p in g.parts if isinstance(p, A.Filter) and _vars(p.expr) & far]
        rest = A.Group(tuple(p for p in g.parts if not (isinstance(p, A.Filter) and p.expr in conds)))
        if _vars(rest) & far or any(_vars(x.group) & far for e in conds for x in _find(e, A.Exists)):
            raise QueryError("an inner pattern of EXISTS can't read an outer variable")
        return self.group(rest), conds

    def _both(self, l: Rel, s: Rel, n: int, conds: list, lp: str = "") -> list[Column]:
        """Conditions over a row of l (columns renamed by lp) and one of s (by n)."""
        if any(_find(e, A.Exists) for e in conds):
            raise QueryError("EXISTS can't be used here")
        x = Expressions({v: s.value(v, f"r{n}") for v in s.vars} | {v: l.value(v, lp) for v in l.vars}, None, None, self.functions, self.now)
        return [F.coalesce(x.boolean(e), F.lit(False)) for e in conds]

    def _with_exists(self, rel: Rel, e):
        """e with each EXISTS in it replaced by a variable that tells whether the row has a partner."""
        for x in _find(e, A.Exists):
            inner, conds = self._body(x.group, rel)
            shared = [v for v in rel.vars if v in inner.vars]
            s, n = self._side(inner)
            name = f"%e{next(self.fresh)}"
            if not any(rel.vars[v].nullable or s.vars[v].nullable for v in shared):
                # the outer row's columns get other names: the body's plan may hold theirs below its projection
                lp = f"q{n}"
                own = {c: lp + c for v, i in rel.vars.items() for c in _cols(v, replace(i, native=None))}
                eq = [self._equal(v, rel, s, n, lp) for v in shared]
                if any(c is None for c in eq):
                    flag = F.lit(False)
                else:
                    tests = eq + self._both(rel, s, n, conds, lp)
                    flag = (s.df.where(functools.reduce(lambda a, b: a & b, tests).outer()) if tests else s.df).exists()
                df = rel.df.withColumnsRenamed(own).withColumn(f"e_{name}", flag).withColumnsRenamed({b: a for a, b in own.items()})
                flag = _c(f"e_{name}") if not x.negated else ~_c(f"e_{name}")
                rel = Rel(df.withColumn(f"v_{name}", flag.cast("string")).drop(f"e_{name}"), rel.vars | {name: Info("D" + XSD + "boolean")})
            else:
                row = f"__row{next(self.fresh)}"
                tagged = self._numbered(rel, row)
                hit = self._semi(tagged, inner, conds).df.select(_c(row).alias("__hit")).distinct()
                df = tagged.df.join(hit, _c(row) == _c("__hit"), "left")
                flag = (_c("__hit").isNotNull() if not x.negated else _c("__hit").isNull()).cast("string")
                rel = Rel(df.withColumn(f"v_{name}", flag).drop("__hit", row), rel.vars | {name: Info("D" + XSD + "boolean")})
            e = _swap(e, x, A.TermExpr(A.Var(name)))
        return rel, e

    def values(self, p: A.Values) -> Rel:
        infos, rows = {}, []
        for i, v in enumerate(p.vars):
            tags = [literal(r[i]).tag for r in p.rows if r[i] is not None]
            infos[v.name] = Info(meet(tags), any(r[i] is None for r in p.rows)) if tags else Info("L", True)
        for r in p.rows:
            row = []
            for v, t in zip(p.vars, r):
                row.append(None if t is None else t.value if isinstance(t, A.Iri) else t.text)
                if infos[v.name].tag is None:
                    row.append(None if t is None else literal(t).tag)
            rows.append(tuple([1, *row]))
        names = ["__one", *[c for v in p.vars for c in _cols(v.name, infos[v.name])]]
        schema = T.StructType([T.StructField(n, T.IntegerType() if n == "__one" else T.StringType()) for n in names])
        return Rel(self.spark.createDataFrame(rows, schema), infos)

    def union(self, rels: list[Rel], dedup: bool = False) -> Rel:
        """By name; what an arm lacks is unbound. Tags that differ become columns; native columns stay where all arms agree."""
        names = list(dict.fromkeys(v for r in rels for v in r.vars))
        infos, parts = {}, []
        for v in names:
            have = [r.vars[v] for r in rels if v in r.vars]
            nat = have[0].native
            same = len(have) == len(rels) and nat and all(i.native and (i.native.shape, i.native.types) == (nat.shape, nat.types) for i in have)
            cols = tuple(f"k_{next(self.fresh)}_{j}" for j in range(len(nat.columns))) if same else ()
            infos[v] = Info(meet([i.tag for i in have]), any(i.nullable for i in have) or len(have) < len(rels), Native(nat.shape, cols, nat.types) if same else None)
        for r in rels:
            out = []
            for v, info in infos.items():
                if v not in r.vars:
                    out += [F.lit(None).cast("string").alias(f"v_{v}"), *([F.lit(None).cast("string").alias(f"t_{v}")] if info.tag is None else [])]
                    continue
                out.append(_c(f"v_{v}"))
                if info.tag is None:
                    out.append(r.value(v).tag_column().alias(f"t_{v}"))
                if info.native:
                    out += [_c(a).alias(b) for a, b in zip(r.vars[v].native.columns, info.native.columns)]
            parts.append(r.df.select(*(out or [F.lit(1).alias("__one")])))
        df = functools.reduce(DataFrame.unionByName, parts)
        return Rel(df.distinct() if dedup else df, infos)

    # joins

    def _side(self, rel: Rel) -> Rel:
        """All columns under names that nothing else has."""
        n = next(self.fresh)
        new, out = {}, []
        for v, i in rel.vars.items():
            nat = Native(i.native.shape, tuple(f"k{n}_{c}" for c in i.native.columns), i.native.types) if i.native else None
            out += [_c(f"v_{v}").alias(f"r{n}v_{v}"), *([_c(f"t_{v}").alias(f"r{n}t_{v}")] if i.tag is None else [])]
            out += [_c(c).alias(f"k{n}_{c}") for c in (i.native.columns if i.native else ())]
            new[v] = replace(i, native=nat)
        return Rel(rel.df.select(*(out or [F.lit(1).alias(f"r{n}one")])), new), n

    def _equal(self, v: str, l: Rel, r: Rel, n: int, lp: str = "") -> Column | None:
        """The condition that v is one term on both sides (r's columns renamed by n, l's by lp); None if it never is."""
        a, b = l.vars[v], r.vars[v]
        if a.tag and b.tag and a.tag != b.tag:
            if kind_of(a.tag) != kind_of(b.tag) or "L" not in (a.tag, b.tag):
                return None
        if a.native and b.native and a.native.shape is not None and b.native.shape is not None and a.tag == b.tag:
            from .template import Template

            if not Template(a.native.shape, a.native.columns).can_meet(Template(b.native.shape, b.native.columns)):
                return None
        if self.native and a.native and b.native and a.tag == b.tag and a.native.shape == b.native.shape:
            pairs = list(zip(a.native.types, b.native.types))
            whole = {"tinyint", "smallint", "int", "bigint"}
            if all(x == y or {x, y} <= whole for x, y in pairs) and not any(x in ("float", "double") for x, _ in pairs):
                return functools.reduce(lambda x, y: x & y, [_c(x) == _c(y) for x, y in zip(a.native.columns, b.native.columns)])
        same = _c(f"{lp}v_{v}") == _c(f"r{n}v_{v}")
        if a.tag is None or b.tag is None:
            ta = l.value(v, lp).tag_column()
            tb = _c(f"r{n}t_{v}") if b.tag is None else F.lit(b.tag)
            loose = (ta == "L") & ~tb.isin("I", "B") | (tb == "L") & ~ta.isin("I", "B")
            same = same & ((ta == tb) | loose)
        return same

    def _after(self, l: Rel, r: Rel, n: int, df: DataFrame, optional: bool) -> Rel:
        """The joined rows under plain names; a shared variable is what either side binds."""
        out, infos = [], {}
        for v, i in l.vars.items():
            j = r.vars.get(v)
            if j is None or not i.nullable:
                out += [_c(c) for c in _cols(v, i)]
                infos[v] = i
                continue
            tag = meet([i.tag, j.tag])
            lex = F.coalesce(_c(f"v_{v}"), _c(f"r{n}v_{v}"))
            out.append(lex.alias(f"v_{v}"))
            if tag is None:
                tb = _c(f"r{n}t_{v}") if j.tag is None else F.when(_c(f"r{n}v_{v}").isNotNull(), F.lit(j.tag))
                out.append(F.coalesce(l.value(v).tag_column(), tb).alias(f"t_{v}"))
            infos[v] = Info(tag, i.nullable and (j.nullable or optional))
        for v, j in r.vars.items():
            if v not in l.vars:
                out += [_c(f"r{n}v_{v}").alias(f"v_{v}"), *([_c(f"r{n}t_{v}").alias(f"t_{v}")] if j.tag is None else []), *[_c(c) for c in (j.native.columns if j.native else ())]]
                infos[v] = replace(j, nullable=j.nullable or optional)
        return Rel(df.select(*(out or [F.lit(1).alias("__one")])), infos)

    def _patterns(self, l: Rel, r: Rel, n: int):
        """The join cut by which nullable keys are bound: (condition on l, condition on r, equalities), disjoint and complete;
        each part is an equi-join. None in equalities: they never hold."""
        shared = [v for v in l.vars if v in r.vars]
        loose = [v for v in shared if l.vars[v].nullable or r.vars[v].nullable]
        fixed = [self._equal(v, l, r, n) for v in shared if v not in loose]
        for case in itertools.product("=lr", repeat=len(loose)):
            lc, rc, eq, ok = [], [], list(fixed), True
            for v, c in zip(loose, case):
                a, b = l.vars[v].nullable, r.vars[v].nullable
                lv, rv = _c(f"v_{v}"), _c(f"r{n}v_{v}")
                if c == "=":
                    lc += [lv.isNotNull()] * a
                    rc += [rv.isNotNull()] * b
                    eq.append(self._equal(v, l, r, n))
                elif c == "l":
                    ok &= a
                    lc.append(lv.isNull())
                else:
                    ok &= b
                    lc += [lv.isNotNull()] * a
                    rc.append(rv.isNull())
            if ok and not any(x is None for x in eq):
                yield lc, rc, eq

    def _met(self, l: Rel, r: Rel, n: int, how: str = "inner") -> DataFrame | None:
        parts = []
        for lc, rc, eq in self._patterns(l, r, n):
            a, b = l.df, r.df
            for c in lc:
                a = a.where(c)
            for c in rc:
                b = b.where(c)
            parts.append(a.join(b, functools.reduce(lambda x, y: x & y, eq), how) if eq else a.crossJoin(b))
        return functools.reduce(DataFrame.unionByName, parts) if parts else None

    @staticmethod
    def _numbered(rel: Rel, row: str) -> Rel:
        """rel with a number for each row, written down: a plan that is run twice could number rows differently."""
        return Rel(paths._cut(rel.df.withColumn(row, F.monotonically_increasing_id())), rel.vars)

    def join(self, l: Rel | None, r: Rel) -> Rel:
        if l is None:
            return r
        s, n = self._side(r)
        df = self._met(l, s, n)
        if df is None:
            return self.empty(dict.fromkeys([*l.vars, *r.vars]))
        return self._after(l, s, n, df, False)

    def _cases(self, l: Rel, s: Rel, n: int, shared: list[str]):
        """l's rows by which nullable shared variables they bind, if s binds all of them: (rows, bound variables, equalities;
        None: there never is a partner)."""
        loose = [v for v in shared if l.vars[v].nullable]
        for case in itertools.product((True, False), repeat=len(loose)):
            df, bound = l.df, [v for v in shared if v not in loose]
            for v, there in zip(loose, case):
                df = df.where(_c(f"v_{v}").isNotNull() if there else _c(f"v_{v}").isNull())
                bound += [v] * there
            eq = [self._equal(v, l, s, n) for v in bound]
            yield df, bound, None if any(x is None for x in eq) else eq

    def left_join(self, l: Rel, r: Rel, conds: list | None = None) -> Rel:
        """OPTIONAL, with the filters that stand in it; they see both sides."""
        s, n = self._side(r)
        shared = [v for v in l.vars if v in r.vars]
        if not any(s.vars[v].nullable for v in shared) and not any(_find(e, A.Exists) for e in conds or []):
            tests = self._both(l, s, n, conds or [])
            parts = []
            for df, _, eq in self._cases(l, s, n, shared):
                on = F.lit(False) if eq is None else functools.reduce(lambda x, y: x & y, eq + tests, F.lit(True)) if not eq + tests else functools.reduce(lambda x, y: x & y, eq + tests)
                parts.append(df.join(s.df, on, "left_outer"))
            return self._after(l, s, n, functools.reduce(DataFrame.unionByName, parts), True)
        row = f"__row{next(self.fresh)}"
        tagged = self._numbered(l, row)
        df = self._met(tagged, s, n)
        if df is None:
            df = l.df
            missing = [v for v in r.vars if v not in l.vars]
            for v in missing:
                df = df.withColumn(f"v_{v}", F.lit(None).cast("string"))
            return Rel(df, l.vars | {v: Info("L", True) for v in missing})
        # carry the row id through: as a variable of its own
        inner = self._after(Rel(tagged.df.withColumn(f"v_{row}", _c(row).cast("string")), tagged.vars | {row: Info("L")}), s, n, df.withColumn(f"v_{row}", _c(row).cast("string")), False)
        for e in conds or []:
            inner = self._filter(inner, e)
        rest = tagged.df.withColumn(f"v_{row}", _c(row).cast("string"))
        hit = inner.df.select(_c(f"v_{row}").alias("__hit")).distinct()
        rest = rest.join(hit, _c(f"v_{row}") == _c("__hit"), "left_anti")
        out = self.union([inner, Rel(rest, l.vars)])
        return self._project(out, [v for v in out.vars if v != row])

    def _semi(self, l: Rel, r: Rel, conds: list, negated: bool = False) -> Rel:
        """Rows of l that have (or lack) a compatible row in r, with which all of conds hold."""
        shared = [v for v in l.vars if v in r.vars]
        if not shared and len(conds) == 1:
            r = self._ends(l, r, conds[0])
        s, n = self._side(r if conds or not shared else self._project(r, shared))
        how = "left_anti" if negated else "left_semi"
        if not shared and not conds:
            flag = s.df.limit(1).select(F.lit(1).alias("__some"))
            return Rel(l.df.join(flag, F.lit(True), how), l.vars)
        tests = self._both(l, s, n, conds)
        if not any(s.vars[v].nullable for v in shared):
            parts = []
            for df, _, eq in self._cases(l, s, n, shared):
                if eq is None:
                    parts.append(df if negated else df.limit(0))
                elif eq + tests:
                    parts.append(df.join(s.df, functools.reduce(lambda x, y: x & y, eq + tests), how))
                else:
                    parts.append(df.join(s.df.limit(1).select(F.lit(1).alias("__some")), F.lit(True), how))
            return Rel(functools.reduce(DataFrame.unionByName, parts), l.vars)
        row = f"__row{next(self.fresh)}"
        tagged = self._numbered(l, row)
        df = self._met(tagged, s, n)
        if df is None:
            return l if negated else Rel(l.df.limit(0), l.vars)
        for c in tests:
            df = df.where(c)
        hit = df.select(_c(row).alias("__hit")).distinct()
        return Rel(tagged.df.join(hit, _c(row) == _c("__hit"), how).drop(row), l.vars)

    def _ends(self, l: Rel, r: Rel, e) -> Rel:
        """r, or just its rows with the least and the largest value if e compares an ordered value of r's with one of l's: if
        any row holds the comparison, one of these does."""
        if not (isinstance(e, A.Binary) and e.op in ("<", "<=", ">", ">=", "!=")):
            return r
        for side, other in ((e.left, e.right), (e.right, e.left)):
            if _vars(side) <= set(r.vars) and not _vars(other) & set(r.vars):
                v = self._expressions(r).value(side)
                d = datatype_of(v.static)
                if d not in NUMERIC | TEMPORAL or v.typed is None:
                    return r
                key, row = (number(v) if d in NUMERIC else v.typed), F.struct("*")
                both = r.df.select(row.alias("row"), key.alias("key")).where("key is not null").agg(F.min_by("row", "key").alias("a"), F.max_by("row", "key").alias("z"))
                both = both.select(F.explode(F.array("a", "z")).alias("row")).where("row is not null").select("row.*")
                return Rel(both, r.vars)
        return r

    def minus(self, l: Rel, r: Rel) -> Rel:
        """Rows of l without a compatible row of r that shares a bound variable."""
        shared = [v for v in l.vars if v in r.vars]
        if not shared:
            return l
        if not any(r.vars[v].nullable for v in shared):
            s, n = self._side(self._project(r, shared))
            parts = []
            for df, bound, eq in self._cases(l, s, n, shared):
                parts.append(df.join(s.df, functools.reduce(lambda x, y: x & y, eq), "left_anti") if bound and eq else df)
            return Rel(functools.reduce(DataFrame.unionByName, parts), l.vars)
        row = f"__row{next(self.fresh)}"
        tagged = self._numbered(l, row)
        s, n = self._side(self._project(r, shared))
        df = self._met(tagged, s, n)
        if df is None:
            return l
        both = functools.reduce(lambda x, y: x | y, [_c(f"v_{v}").isNotNull() & _c(f"r{n}v_{v}").isNotNull() for v in shared])
        hit = df.where(both).select(_c(row).alias("__hit")).distinct()
        return Rel(tagged.df.join(hit, _c(row) == _c("__hit"), "left_anti").drop(row), l.vars)

    # triples

    def _bgp(self, triples) -> Rel:
        """A basic graph pattern; patterns with one subject go together, so that one scan can serve them."""
        options = self._pruned(triples)
        rel, left = None, list(range(len(triples)))
        while left:
            i = left.pop(0)
            group = [i]
            if self.star and isinstance(triples[i].s, (A.Var, A.Bnode)):
                group += [j for j in left if triples[j].s == triples[i].s]
                left = [j for j in left if triples[j].s != triples[i].s]
            rel = self.join(rel, self._star([triples[j] for j in group], [options[j] for j in group]))
        return rel if rel is not None else self.unit()

    def _pruned(self, triples) -> list:
        """The candidates of each pattern (None for a path), without those whose term for a shared variable no candidate of
        another pattern could give."""
        options = [self._candidates(t.s, t.p.term, t.o) if isinstance(t.p, A.Link) else None for t in triples]
        if not self.star:
            return options
        places: dict = {}
        for i, t in enumerate(triples):
            if options[i] is not None:
                for place, term in enumerate((t.s, t.p.term, t.o)):
                    if isinstance(term, (A.Var, A.Bnode)):
                        places.setdefault(term, []).append((i, place))
        at = lambda arm, place: (arm[0].subject, arm[1], arm[2])[place]
        again = True
        while again:
            again = False
            for found in places.values():
                for i, place in found:
                    for j, other in found:
                        if i == j:
                            continue
                        there = {at(arm, other) for arm in options[j]}
                        good = {tm for tm in {at(arm, place) for arm in options[i]} if not all(_apart(tm, x) for x in there)}
                        kept = [arm for arm in options[i] if at(arm, place) in good]
                        again |= len(kept) < len(options[i])
                        options[i] = kept
        return options

    def _star(self, group, options) -> Rel:
        plain = [(t, o) for t, o in zip(group, options) if o is not None]
        rest = [t for t, o in zip(group, options) if o is None]
        rel = self._one_scan(plain) if len(plain) > 1 else None
        if rel is None:
            for t, o in plain:
                rel = self.join(rel, self._arms(t.s, t.p.term, t.o, o))
        for t in rest:
            rel = self.join(rel, paths.path(self, t.p, t.s, t.o))
        return rel

    def _one_scan(self, plain) -> Rel | None:
        """Patterns with one row-unique subject, by one scan of each map that answers all of them; None if they can't be."""
        by: dict[str, list] = {}
        for i, (_, arms) in enumerate(plain):
            for arm in arms:
                by.setdefault(arm[0].id, [[] for _ in plain])[i].append(arm)
        maps = [self.mapping.maps[m] for m in by]
        for m in maps:
            good = m.subject.template and self.catalog.unique(m, m.subject.columns) and m.subject.template.invertible(self._whole(m))
            if not good or any(len(arms) != 1 or arms[0][3] is not None for arms in by[m.id]):
                return None
        if not maps or any(not _apart(a.subject, b.subject) for a, b in itertools.combinations(maps, 2)):
            return None
        rels = [self._merged(m, [t for t, _ in plain], [arms[0] for arms in by[m.id]]) for m in maps]
        return rels[0] if len(rels) == 1 else self.union(rels)

    def _merged(self, m: TriplesMap, group, arms) -> Rel:
        """Patterns that one row-unique subject answers: one scan."""
        df, infos, conds = self.catalog.frame(m), {}, []
        out: dict[str, Column] = {}
        # the subject once: it is one term map in all patterns
        self._bind(m, df, [(group[0].s, m.subject)], infos, out, conds)
        for t, (_, p, o, _) in zip(group, arms):
            self._bind(m, df, [(t.p.term, p), (t.o, o)], infos, out, conds)
        for c in conds:
            df = df.where(c)
        return Rel(df.select(*[c.alias(k) for k, c in out.items()]), infos)

    def _whole(self, m: TriplesMap, columns=None) -> bool:
        names = {f.name.lower(): f.dataType for f in self.catalog.frame(m).schema.fields}
        found = [names.get(c.lower()) for c in (columns if columns is not None else m.subject.columns)]
        return all(isinstance(k, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) for k in found)

    def _candidates(self, s, p, o, negated=None) -> list[tuple]:
        """(map, predicate, object, parent join) of each way a triple can come about that the terms don't rule out."""
        found = []
        for m in self.maps:
            if not self._possible(m, m.subject, s):
                continue
            for c in m.classes:
                found.append((m, TermMap(constant=RDF + "type"), TermMap(constant=c), None))
            for po in m.pos:
                for pm, om in itertools.product(po.predicates, po.objects):
                    if isinstance(om, RefMap):
                        parent = self.mapping.maps.get(om.parent)
                        if parent is None or parent.subject is None:
                            continue
                        if om.joins:
                            found.append((m, pm, parent.subject, (parent, om.joins)))
                        else:
                            found.append((m, pm, parent.subject, None))
                    else:
                        found.append((m, pm, om, None))
        out = []
        for m, pm, om, ref in found:
            if negated is not None and pm.constant is not None and pm.constant in negated:
                continue
            if self._possible(m, pm, p) and self._possible(ref[0] if ref else m, om, o):
                out.append((m, pm, om, ref))
        return out

    def _possible(self, m: TriplesMap, tm: TermMap, term) -> bool:
        if not isinstance(term, (A.Iri, A.Literal)):
            return True
        text = term.value if isinstance(term, A.Iri) else term.text
        if (tm.kind == "L") != isinstance(term, A.Literal) or tm.kind == "B":
            return False
        if tm.constant is not None:
            return tm.constant == text
        return tm.template is None or tm.template.can_be(text)

    def _arms(self, s, p, o, arms, negated=None) -> Rel:
        """The union of candidates, each term once."""
        names = [t.name if isinstance(t, A.Var) else f"_:{t.label}" for t in (s, p, o) if isinstance(t, (A.Var, A.Bnode))]
        rels, sure, metas = [], True, []
        if isinstance(p, A.Var) and len({s, p, o}) == 3:
            arms, rels, metas = self._exploded(s, p, o, arms, negated)
        for m, pm, om, ref in arms:
            infos, out, conds = {}, {}, []
            df = self.catalog.frame(m)
            if ref:
                parent, joins = ref
                child = df.select(*[_c(c).alias(f"c__{c}") for c in df.columns])
                pdf = self.catalog.frame(parent)
                pdf = pdf.select(*[_c(c).alias(f"p__{c}") for c in pdf.columns])
                types = lambda d, c: next(f for f in d.schema.fields if f.name.lower() == c.lower()).dataType
                eq = []
                for a, b in joins:
                    x, y = _c(f"c__{a}"), _c(f"p__{b}")
                    whole = all(isinstance(types(d, c), (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) for d, c in ((child, f"c__{a}"), (pdf, f"p__{b}")))
                    eq.append(x == y if whole or types(child, f"c__{a}") == types(pdf, f"p__{b}") else x.cast("string") == y.cast("string"))
                df = child.join(pdf, functools.reduce(lambda x, y: x & y, eq))
                self._bind(m, df, [(s, m.subject), (p, pm)], infos, out, conds, "c__")
                self._bind(parent, df, [(o, om)], infos, out, conds, "p__")
            else:
                self._bind(m, df, [(s, m.subject), (p, pm), (o, om)], infos, out, conds)
            if conds is None or any(c is None for c in conds):
                continue
            if negated is not None and pm.constant is None:
                conds.append(~self._lex(m, pm, df).isin(*negated) if negated else F.lit(True))
            for c in conds:
                df = df.where(c)
            key = ref is None and m.subject.template is not None and isinstance(s, (A.Var, A.Bnode)) and self.catalog.unique(m, m.subject.columns) and m.subject.template.invertible(self._whole(m))
            df = df.select(*([c.alias(k) for k, c in out.items()] or [F.lit(1).alias("__one")]))
            rels.append(Rel(df if key else df.distinct(), infos))
            metas.append((m, pm, om))
        if not rels:
            return self.empty(dict.fromkeys(names))
        if len(metas) == 1:
            return rels[0]
        for (a, pa, oa), (b, pb, ob) in itertools.combinations(metas, 2):
            apart = isinstance(s, (A.Var, A.Bnode)) and _apart(a.subject, b.subject) or isinstance(p, A.Var) and _apart(pa, pb) or isinstance(o, (A.Var, A.Bnode)) and _apart(oa, ob)
            sure = sure and apart
        if len(rels) == 1:
            return rels[0] if sure else Rel(rels[0].df.distinct(), rels[0].vars)
        return self.union(rels, dedup=not sure)

    def _exploded(self, s, p, o, arms, negated) -> tuple[list, list[Rel], list]:
        """Arms with a variable predicate over one map with a row-unique subject: one scan, whose rows give all their (predicate,
        object) at once. The arms that are left, relations, and what they stand for."""
        rest, rels, metas, by = [], [], [], {}
        for arm in arms:
            by.setdefault(arm[0].id, []).append(arm)
        for found in by.values():
            m = found[0][0]
            own = [a for a in found if a[3] is None]
            key = m.subject.template is not None and self.catalog.unique(m, m.subject.columns) and m.subject.template.invertible(self._whole(m))
            if len(own) < 2 or not key:
                rest += found
                continue
            rest += [a for a in found if a[3] is not None]
            df, infos, out, conds, each = self.catalog.frame(m), {}, {}, [], []
            self._bind(m, df, [(s, m.subject)], infos, out, conds)
            for _, pm, om, _ in own:
                tests = [self._column(df, c)[0].isNotNull() for c in (*pm.columns, *om.columns) if not self.catalog.never_null(m, c)]
                if negated and pm.constant is None:
                    tests.append(~self._lex(m, pm, df).isin(*negated))
                if isinstance(o, (A.Iri, A.Literal)):
                    tests.append(self._match(m, om, o, df, ""))
                one = F.struct(self._lex(m, pm, df).alias("p"), self._lex(m, om, df).alias("o"), F.lit(self._tag(om, df)).alias("t"))
                each.append(F.when(functools.reduce(lambda x, y: x & y, tests), one) if tests else one)
            for c in conds:
                df = df.where(c)
            df = df.select(*[c.alias(k) for k, c in out.items()], F.explode(F.array(*each)).alias("__x")).where("__x is not null")
            cols = [_c(k) for k in out] + [F.col("__x.p").alias(f"v_{p.name}")]
            infos[p.name] = Info("I")
            if isinstance(o, (A.Var, A.Bnode)):
                v = o.name if isinstance(o, A.Var) else f"_:{o.label}"
                infos[v] = Info(meet([self._tag(a[2], self.catalog.frame(m)) for a in own]))
                cols += [F.col("__x.o").alias(f"v_{v}"), *([F.col("__x.t").alias(f"t_{v}")] if infos[v].tag is None else [])]
            rels.append(Rel(df.select(*cols), infos))
            metas += [(m, pm, om) for _, pm, om, _ in own]
        return rest, rels, metas

    def _column(self, df: DataFrame, name: str, prefix: str = "") -> tuple[Column, T.DataType]:
        for f in df.schema.fields:
            if f.name.lower() == (prefix + name).lower():
                return _c(f.name), f.dataType
        raise QueryError(f"no column {name}")

    def _lex(self, m: TriplesMap, tm: TermMap, df: DataFrame, prefix: str = "") -> Column:
        if tm.constant is not None:
            return F.lit(tm.constant)
        if tm.column:
            return lexical(*self._column(df, tm.column, prefix))
        parts = [F.lit(tm.template.texts[0])]
        for c, text in zip(tm.template.columns, tm.template.texts[1:]):
            col, kind = self._column(df, c, prefix)
            lex = lexical(col, kind)
            safe = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
            parts += [lex if tm.kind != "I" or safe else encode(lex), F.lit(text)]
        return F.concat(*parts)

    def _tag(self, tm: TermMap, df: DataFrame, prefix: str = "") -> str:
        if tm.kind != "L":
            return tm.kind
        if tm.datatype or tm.lang:
            return tag_of("L", tm.datatype, tm.lang)
        if tm.column:
            return tag_of("L", NATURAL.get(type(self._column(df, tm.column, prefix)[1])))
        return tag_of("L", XSD + "string")

    def _bind(self, m: TriplesMap, df: DataFrame, pairs, infos, out, conds, prefix: str = "") -> None:
        """For (term, term map) pairs: conditions for constants, columns for variables."""
        for term, tm in pairs:
            for c in tm.columns:
                if not self.catalog.never_null(m, c):
                    conds.append(self._column(df, c, prefix)[0].isNotNull())
            if isinstance(term, (A.Iri, A.Literal)):
                conds.append(self._match(m, tm, term, df, prefix))
                continue
            v = term.name if isinstance(term, A.Var) else f"_:{term.label}"
            lex, tag = self._lex(m, tm, df, prefix), self._tag(tm, df, prefix)
            if v in infos:
                if f"v_{v}" in out and tm.constant is None:
                    conds.append(out[f"v_{v}"] == lex)
                elif tm.constant is not None:
                    conds.append(out[f"v_{v}"] == F.lit(tm.constant))
                if infos[v].tag != tag and (kind_of(infos[v].tag) != kind_of(tag) or "L" not in (infos[v].tag, tag)):
                    conds.append(F.lit(False))
                continue
            out[f"v_{v}"] = lex
            nat = None
            if tm.columns:
                cols = [self._column(df, c, prefix) for c in tm.columns]
                whole = all(isinstance(k, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) for _, k in cols)
                declared = tm.column is not None and tm.datatype and tm.datatype != NATURAL.get(type(cols[0][1]))
                if not declared and (tm.column or tm.template.invertible(whole)) and (tm.column or tm.kind != "L" or len(cols) == 1):
                    names = tuple(f"k_{next(self.fresh)}_{i}" for i in range(len(cols)))
                    nat = Native(None if tm.column else tm.template.texts, names, tuple(k.simpleString() for _, k in cols))
                    out.update({n: c for n, (c, _) in zip(names, cols)})
            infos[v] = Info(tag, False, nat)

    def _match(self, m: TriplesMap, tm: TermMap, term, df: DataFrame, prefix: str) -> Column:
        """A constant against a term map: on the columns themselves where the template can be inverted."""
        text = term.value if isinstance(term, A.Iri) else term.text
        if tm.constant is not None:
            return F.lit(tm.constant == text)
        if isinstance(term, A.Literal):
            tag, own = self._tag(tm, df, prefix), literal(term).tag
            if tag != own and tag != "L" and own != "L":
                return F.lit(False)
        if tm.column:
            values = [text]
        else:
            cols = [self._column(df, c, prefix)[1] for c in tm.template.columns]
            whole = all(isinstance(k, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) for k in cols)
            if not tm.template.invertible(whole):
                return self._lex(m, tm, df, prefix) == text
            values = tm.template.invert(text, tm.kind == "I")
            if values is None:
                return F.lit(False)
        tests = []
        for c, value in zip(tm.columns, values):
            col, kind = self._column(df, c, prefix)
            if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
                if not value.lstrip("-").isdigit() or str(int(value)) != value or abs(int(value)) >= 1 << 63:
                    return F.lit(False)
                tests.append(col == F.lit(int(value)).cast(kind) if abs(int(value)) < 1 << 31 or isinstance(kind, T.LongType) else F.lit(False))
            elif isinstance(kind, T.StringType):
                tests.append(col == value)
            else:
                tests.append(lexical(col, kind) == value)
        return functools.reduce(lambda x, y: x & y, tests)

    def triple(self, s, p, o, negated=None) -> Rel:
        """One triple pattern."""
        return self._arms(s, p, o, self._candidates(s, p, o, negated), negated)

    def quads(self, distinct: bool = False, strict: bool = False) -> DataFrame:
        """The whole graph, see operators.rdf."""
        from .operators.rdf import quads

        return quads(self, distinct, strict)


def nt(v: Value) -> Column:
    """A term in N-Triples form; a tag that is known beforehand costs no test."""
    iri, blank = F.concat(F.lit("<"), v.lex, F.lit(">")), F.concat(F.lit("_:"), v.lex)
    d = datatype_of(v.static)
    esc = v.lex
    if d not in NUMERIC | TEMPORAL | {XSD + "boolean"}:
        for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            esc = F.replace(esc, F.lit(a), F.lit(b))
    if v.static in ("I", "B"):
        return iri if v.static == "I" else blank
    if v.static:
        return F.concat(F.lit('"'), esc, F.lit('"' + (v.static if v.static[0] == "@" else "" if d in (None, XSD + "string") else f"^^<{d}>")))
    t = v.tag_column()
    tail = F.when(t.startswith("@"), t).when(t.startswith("D") & (t != f"D{XSD}string"), F.concat(F.lit("^^<"), F.substring(t, F.lit(2), F.length(t)), F.lit(">"))).otherwise("")
    return F.when(t == "I", iri).when(t == "B", blank).otherwise(F.concat(F.lit('"'), esc, F.lit('"'), tail))


@functools.lru_cache(maxsize=100_000)
def _apart(a: TermMap, b: TermMap) -> bool:
    """No term comes from both."""
    if a.kind != b.kind:
        return True
    if a.constant is not None and b.constant is not None:
        return a.constant != b.constant
    if a.template and b.template:
        return not a.template.can_meet(b.template)
    for x, y in ((a, b), (b, a)):
        if x.constant is not None and y.template:
            return not y.template.can_be(x.constant)
    return False


def _vars(e) -> set[str]:
    """The names of all variables in an expression or a pattern."""
    if isinstance(e, A.Var):
        return {e.name}
    if isinstance(e, (tuple, list)):
        return set().union(*map(_vars, e))
    if hasattr(e, "__dataclass_fields__"):
        return set().union(*[_vars(getattr(e, f)) for f in e.__dataclass_fields__])
    return set()


def _find(e, kind) -> list:
    """The outermost nodes of a kind in an expression."""
    if isinstance(e, kind):
        return [e]
    if isinstance(e, A.Exists):
        return []
    if isinstance(e, tuple):
        return list(dict.fromkeys(y for x in e for y in _find(x, kind)))
    if hasattr(e, "__dataclass_fields__"):
        return list(dict.fromkeys(y for f in e.__dataclass_fields__ for y in _find(getattr(e, f), kind)))
    return []


def _swap(e, old, new):
    if e == old:
        return new
    if isinstance(e, tuple):
        return tuple(_swap(x, old, new) for x in e)
    if hasattr(e, "__dataclass_fields__") and not isinstance(e, A.Exists):
        return replace(e, **{f: _swap(getattr(e, f), old, new) for f in e.__dataclass_fields__})
    return e
