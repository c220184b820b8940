"""Forward mode: a mapping run over its tables gives quads; writers for N-Triples, N-Quads and Turtle.

One table is read once for all the triples its rows give: the (predicate, object, graph) of a row are exploded from an array.
`map_dataframe` takes rows from outside, a streaming DataFrame too.
"""

from __future__ import annotations

import functools
import itertools
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..mapping import RR, RefMap, TermMap, TriplesMap
from ..sparql.parser import RDF
from ..terms import Value

DEFAULT = RR + "defaultGraph"
#: Fixed value: the characters that N-Triples forbids in an IRI.
FORBIDDEN = r"[\x00-\x20<>\"{}|^`\\]"


def _value(engine, m: TriplesMap, tm: TermMap, df: DataFrame, prefix: str = "", strict: bool = False) -> Value:
    if tm.constant is not None and tm.kind == "L":
        from ..terms import XSD, tag_of

        return Value(F.lit(tm.constant), tag_of("L", tm.datatype or (None if tm.lang else XSD + "string"), tm.lang))
    lex, tag = engine._lex(m, tm, df, prefix), engine._tag(tm, df, prefix)
    if strict and tag == "I" and (tm.template is None or re.search(FORBIDDEN, "".join(tm.template.texts))):  # encoding leaves nothing else
        lex = F.when(lex.rlike(FORBIDDEN), F.raise_error(F.concat(F.lit(f"map {m.id}: not an IRI: "), lex)).cast("string")).otherwise(lex)
    return Value(lex, tag)


def _graphs(engine, m: TriplesMap, graphs, df: DataFrame, prefix: str = "", strict: bool = False) -> list:
    """Graph names; null is the default graph."""
    from ..engine import nt

    out = []
    for g in graphs:
        out.append(F.lit(None).cast("string") if g.constant == DEFAULT else nt(_value(engine, m, g, df, prefix, strict)))
    return out or [F.lit(None).cast("string")]


def _rows(engine, m: TriplesMap, df: DataFrame, strict: bool = False) -> list[DataFrame]:
    from ..engine import nt

    subject = nt(_value(engine, m, m.subject, df, strict=strict))
    parts, joined = [], []
    for c, g in itertools.product(m.classes, _graphs(engine, m, m.graphs, df, strict=strict)):
        parts.append((F.lit(f"<{RDF}type>"), F.lit(f"<{c}>"), g))
    for po in m.pos:
        both = tuple(dict.fromkeys([*m.graphs, *po.graphs]))
        for pm, om in itertools.product(po.predicates, po.objects):
            if isinstance(om, RefMap) and om.joins:
                joined.append((pm, om, both))
                continue
            om = engine.mapping.maps[om.parent].subject if isinstance(om, RefMap) else om
            for g in _graphs(engine, m, both, df, strict=strict):
                parts.append((nt(_value(engine, m, pm, df, strict=strict)), nt(_value(engine, m, om, df, strict=strict)), g))
    out = []
    if parts:
        each = F.array(*[F.struct(p.alias("p"), o.alias("o"), g.alias("g")) for p, o, g in parts])
        rows = df.select(subject.alias("s"), F.explode(each).alias("x")).select("s", "x.p", "x.o", "x.g")
        out.append(rows.where("s is not null and p is not null and o is not null"))
    for pm, om, both in joined:
        parent = engine.mapping.maps[om.parent]
        child = df.select(*[F.col(f"`{c}`").alias(f"c__{c}") for c in df.columns])
        other = engine.catalog.frame(parent)
        other = other.select(*[F.col(f"`{c}`").alias(f"p__{c}") for c in other.columns])
        eq = [F.col(f"`c__{a}`").cast("string") == F.col(f"`p__{b}`").cast("string") for a, b in om.joins]
        for i, (a, b) in enumerate(om.joins):
            x, y = (next(f.dataType for f in d.schema.fields if f.name.lower() == n.lower()) for d, n in ((child, f"c__{a}"), (other, f"p__{b}")))
            if x == y:
                eq[i] = F.col(f"`c__{a}`") == F.col(f"`p__{b}`")
        both_df = child.join(other, functools.reduce(lambda x, y: x & y, eq))
        s, p = (nt(_value(engine, m, t, both_df, "c__", strict)) for t in (m.subject, pm))
        o = nt(_value(engine, parent, parent.subject, both_df, "p__", strict))
        for g in _graphs(engine, m, both, both_df, "c__", strict):
            out.append(both_df.select(s.alias("s"), p.alias("p"), o.alias("o"), g.alias("g")).where("s is not null and p is not null and o is not null"))
    return out


def quads(engine, distinct: bool = False, strict: bool = False) -> DataFrame:
    """(s, p, o, g) of the whole mapping in N-Triples form; g null: the default graph. distinct: a set, not a bag. strict: a
    row whose IRI can't be written ends the run, with the map and the text, instead of being written as it is."""
    parts = [d for m in engine.maps for d in _rows(engine, m, engine.catalog.frame(m), strict)]
    if not parts:
        return engine.spark.createDataFrame([], "s string, p string, o string, g string")
    out = functools.reduce(DataFrame.unionByName, parts)
    return out.distinct() if distinct else out


def map_dataframe(engine, m: TriplesMap, df: DataFrame, strict: bool = False) -> DataFrame:
    """The quads of rows given from outside, batch or streaming; m without joins to other maps. strict: as in quads()."""
    if any(isinstance(o, RefMap) and o.joins for po in m.pos for o in po.objects):
        raise ValueError("a map with joins can't take rows from outside")
    return _rows(engine, m, df, strict)[0]


def lines(q: DataFrame, graphs: bool = False) -> DataFrame:
    """N-Triples, or with graphs N-Quads, a line a row."""
    tail = F.when(F.col("g").isNotNull(), F.concat(F.lit(" "), F.col("g"))).otherwise("") if graphs else F.lit("")
    return q.select(F.concat("s", F.lit(" "), "p", F.lit(" "), "o", tail, F.lit(" .")).alias("value"))


def turtle(q: DataFrame) -> DataFrame:
    """Turtle, a subject a row."""
    one = q.groupBy("s", "p").agg(F.sort_array(F.collect_set("o")).alias("o"))
    po = F.concat(F.col("p"), F.lit(" "), F.array_join("o", ", "))
    both = one.groupBy("s").agg(F.array_join(F.sort_array(F.collect_list(po)), " ;\n    ").alias("po"))
    return both.select(F.concat("s", F.lit("\n    "), "po", F.lit(" .\n")).alias("value"))


def write(q: DataFrame, path: str, form: str = "ntriples") -> None:
    """Write quads as text files: ntriples, nquads or turtle."""
    out = turtle(q) if form == "turtle" else lines(q, form == "nquads")
    out.write.mode("overwrite").text(path)
