"""Property paths."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sparql import ast as A
from ..terms import Info, Value


def path(engine, p, s, o):
    """The relation of a path between two terms."""
    if isinstance(p, A.Link):
        return engine.triple(s, p.term, o)
    if isinstance(p, A.Inverse):
        return path(engine, p.path, o, s)
    if isinstance(p, A.Seq):
        rel, at = None, s
        for i, part in enumerate(p.parts):
            to = o if i == len(p.parts) - 1 else A.Var(f"%p{next(engine.fresh)}")
            rel = engine.join(rel, path(engine, part, at, to))
            at = to
        # the places between are no longer needed, rows stay a bag
        return engine._project(rel, [v for v in rel.vars if not v.startswith("%p")]) if any(not v.startswith("%p") for v in rel.vars) else rel
    if isinstance(p, A.Alt):
        return engine.union([path(engine, x, s, o) for x in p.parts])
    if isinstance(p, A.Negated):
        arms = []
        if p.forward or not p.backward:
            arms.append(_negated(engine, s, o, p.forward))
        if p.backward:
            arms.append(_negated(engine, o, s, p.backward))
        return arms[0] if len(arms) == 1 else engine.union(arms)
    if p.op == "+":
        return closure(engine, p.path, s, o)
    more = path(engine, p.path, s, o) if p.op == "?" else closure(engine, p.path, s, o)
    return engine.union([more, zero(engine, s, o)], dedup=True)


def _negated(engine, s, o, iris):
    pv = A.Var(f"%n{next(engine.fresh)}")
    names = [i.value for i in iris]
    rel = engine.triple(s, pv, o, names)
    keep = [v for v in rel.vars if v != pv.name]
    return engine._project(rel, keep) if keep else rel


def _name(t) -> str | None:
    return t.name if isinstance(t, A.Var) else f"_:{t.label}" if isinstance(t, A.Bnode) else None


def terms(engine, name: str):
    """All subjects and objects of the graph, each once."""
    s, p, o = (A.Var(f"%{x}{next(engine.fresh)}") for x in "spo")
    rel = engine.triple(s, p, o)
    sides = []
    for v in (s.name, o.name):
        x = rel.value(v)
        sides.append(rel.df.select(x.lex.alias(f"v_{name}"), x.tag_column().alias(f"t_{name}")))
    from ..engine import Rel

    return Rel(sides[0].unionByName(sides[1]).distinct(), {name: Info(None)})


def zero(engine, s, o):
    """A path of length zero: each term with itself."""
    from ..engine import Rel

    a, b = _name(s), _name(o)
    if a is None and b is None:
        return engine.unit() if s == o else engine.empty([])
    if a is None or b is None:
        return engine.values(A.Values((A.Var(a or b),), ((s if a is None else o,),)))
    rel = terms(engine, a)
    if a == b:
        return rel
    df = rel.df.withColumn(f"v_{b}", F.col(f"`v_{a}`")).withColumn(f"t_{b}", F.col(f"`t_{a}`"))
    return Rel(df, {a: Info(None), b: Info(None)})


def _pairs(engine, step) -> DataFrame:
    """(a, at, b, bt): lexical forms and tags of a step's ends, each pair once."""
    a, b = A.Var(f"%a{next(engine.fresh)}"), A.Var(f"%b{next(engine.fresh)}")
    rel = path(engine, step, a, b)
    x, y = rel.value(a.name), rel.value(b.name)
    return rel.df.select(x.lex.alias("a"), x.tag_column().alias("at"), y.lex.alias("b"), y.tag_column().alias("bt")).distinct()


def _cut(df: DataFrame) -> DataFrame:
    """df as written to the checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if not (sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()):
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def closure(engine, step, s, o):
    """One step or more, each pair of ends once; cycles end because only new pairs go on. With an end given, the frontier
    grows from it; with none, paths double in length each round."""
    from ..engine import Rel

    e = _cut(_pairs(engine, step))
    fixed = s if _name(s) is None else o if _name(o) is None else None
    if fixed is not None:
        back = _name(s) is not None
        edges = e.select(F.col("b").alias("a"), F.col("bt").alias("at"), F.col("a").alias("b"), F.col("at").alias("bt")) if back else e
        from ..functions.exprs import literal

        t = literal(fixed)
        seen = new = _cut(edges.where((F.col("a") == t.lex) & (F.col("at") == t.tag)).select("b", "bt").distinct())
        while not new.isEmpty():
            reach = new.select(F.col("b").alias("a"), F.col("bt").alias("at")).join(edges, ["a", "at"]).select("b", "bt").distinct()
            new = _cut(reach.join(seen, ["b", "bt"], "left_anti"))
            seen = _cut(seen.unionByName(new))
        free = s if back else o
        name = _name(free)
        if name is None:
            end = literal(free)
            hit = seen.where((F.col("b") == end.lex) & (F.col("bt") == end.tag)).limit(1)
            return Rel(hit.select(F.lit(1).alias("__one")), {})
        return Rel(seen.select(F.col("b").alias(f"v_{name}"), F.col("bt").alias(f"t_{name}")), {name: Info(None)})
    all_ = new = e
    while not new.isEmpty():  # a longer pair has one of the last round's as its beginning or end
        mid = lambda d: d.select("a", "at", F.col("b").alias("m"), F.col("bt").alias("mt"))
        end = lambda d: d.select(F.col("a").alias("m"), F.col("at").alias("mt"), "b", "bt")
        more = mid(new).join(end(all_), ["m", "mt"]).unionByName(mid(all_).join(end(new), ["m", "mt"])).select("a", "at", "b", "bt").distinct()
        new = _cut(more.join(all_, ["a", "at", "b", "bt"], "left_anti"))
        all_ = all_.unionByName(new)
    x, y = _name(s), _name(o)
    if x == y:
        df = all_.where((F.col("a") == F.col("b")) & (F.col("at") == F.col("bt")))
        return Rel(df.select(F.col("a").alias(f"v_{x}"), F.col("at").alias(f"t_{x}")), {x: Info(None)})
    df = all_.select(F.col("a").alias(f"v_{x}"), F.col("at").alias(f"t_{x}"), F.col("b").alias(f"v_{y}"), F.col("bt").alias(f"t_{y}"))
    return Rel(df, {x: Info(None), y: Info(None)})
