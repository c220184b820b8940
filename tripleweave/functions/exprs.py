"""SPARQL expressions as columns."""

from __future__ import annotations

import datetime
import functools

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sparql import ast as A
from ..terms import INTEGRAL, NUMERIC, RDF, TEMPORAL, XSD, Value, datatype_of, encode, kind_of, lexical, meet, space_of, to_bool, to_double, to_time, typed


class QueryError(ValueError):
    """A query that can't be answered."""


def _d(name: str) -> str:
    return f"D{XSD}{name}"


def of_bool(c: Column) -> Value:
    return Value(c.cast("string"), _d("boolean"), c)


def of_int(c: Column) -> Value:
    c = c.cast("bigint")
    return Value(c.cast("string"), _d("integer"), c)


def of_wide(c: Column) -> Value:
    """A whole number in decimal(38,0)."""
    return Value(c.cast("string"), _d("integer"), c, True)


def of_double(c: Column) -> Value:
    c = c.cast("double")
    return Value(lexical(c, T.DoubleType()), _d("double"), c)


def of_text(c: Column, tag: str = _d("string")) -> Value:
    return Value(c, tag, c if tag == _d("string") else None)


def literal(t) -> Value:
    if isinstance(t, A.Iri):
        return Value(F.lit(t.value), "I")
    tag = f"@{t.lang.lower()}" if t.lang else f"D{t.datatype or XSD + 'string'}"
    lex = F.lit(t.text)
    return Value(lex, tag, typed(lex, t.datatype) if t.datatype and t.datatype != XSD + "string" else lex if tag[0] == "D" else None)


def number(v: Value) -> Column:
    """The value as double, or null."""
    d = datatype_of(v.static)
    if d in NUMERIC and v.typed is not None:
        return v.typed.cast("double")
    if v.static and (v.static in "IB" or v.static[0] == "@" or d in TEMPORAL):
        return F.lit(None).cast("double")
    return to_double(v.lex)


def ebv(v: Value) -> Column:
    """Effective boolean value: null for what has none."""
    d = datatype_of(v.static)
    if d == XSD + "boolean":
        return v.typed if v.typed is not None else to_bool(v.lex)
    if d in NUMERIC:
        n = number(v)
        return (n != 0) & ~F.isnan(n)
    if d == XSD + "string" or v.static == "L":
        return v.lex != ""
    if v.static:
        return F.lit(None).cast("boolean")
    t = v.tag_column()
    n = to_double(v.lex)
    return F.when(t == _d("boolean"), to_bool(v.lex)).when(_in(t, NUMERIC), (n != 0) & ~F.isnan(n)).when(t.isin("L", _d("string")), v.lex != "")


def _in(tag: Column, kinds: set[str]) -> Column:
    return tag.isin(*sorted("D" + k for k in kinds))


def _op(op: str, a: Column, b: Column) -> Column:
    return {"=": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b}[op]()


def _untyped(op: str, l: Value, r: Value) -> Column:
    a, b = to_double(l.lex), to_double(r.lex)
    return F.when(a.isNotNull() & b.isNotNull(), _op(op, a, b)).otherwise(_op(op, l.lex, r.lex))


def _space(tag: Column) -> Column:
    return (
        F.when(tag.isin("I", "B"), tag).when(tag.startswith("@"), "lang").when(_in(tag, NUMERIC), "num").when(_in(tag, TEMPORAL), "time")
        .when(tag == _d("boolean"), "bool").when(tag == _d("string"), "str").otherwise(tag)
    )


def compare(op: str, l: Value, r: Value) -> Column:
    """A comparison by value: across value spaces equality is false and order null; what has no known datatype compares as a
    number where both sides are numbers, else as text."""
    equality = op in ("=", "!=")
    if l.static and r.static:
        a, b = space_of(l.static), space_of(r.static)
        if a == b == "num":
            if datatype_of(l.static) in INTEGRAL and datatype_of(r.static) in INTEGRAL and l.typed is not None and r.typed is not None:
                return _op(op, l.typed, r.typed)
            return _op(op, number(l), number(r))
        if a == b == "time":
            at = lambda v: v.typed.cast("timestamp_ntz") if v.typed is not None else to_time(v.lex)
            return _op(op, at(l), at(r))
        if a == b == "bool":
            return _op(op, *(v.typed if v.typed is not None else to_bool(v.lex) for v in (l, r)))
        if a == b == "lang" and l.static != r.static:
            return (F.lit(op == "!=") if equality else F.lit(None).cast("boolean")) if equality else _op(op, l.lex, r.lex)
        if a == b and a != "L":
            return _op(op, l.lex, r.lex) if equality or a in ("str", "lang") else F.lit(None).cast("boolean")
        if "L" in (a, b):
            if a in "IB" or b in "IB":
                return F.when(l.lex.isNotNull() & r.lex.isNotNull(), op == "!=") if equality else F.lit(None).cast("boolean")
            if "num" in (a, b) or a == b:
                return _untyped(op, l, r)
            return _op(op, l.lex, r.lex)
        return F.when(l.lex.isNotNull() & r.lex.isNotNull(), op == "!=") if equality else F.lit(None).cast("boolean")
    tl, tr = l.tag_column(), r.tag_column()
    a, b = _space(tl), _space(tr)
    x, y = to_double(l.lex), to_double(r.lex)
    same = (
        F.when(a == "num", _op(op, x, y)).when(a == "time", _op(op, to_time(l.lex), to_time(r.lex))).when(a == "bool", _op(op, to_bool(l.lex), to_bool(r.lex)))
        .when(a == "L", _untyped(op, l, r))
        .when(a == "lang", F.when(tl == tr, _op(op, l.lex, r.lex)).otherwise(F.lit(op == "!=") if equality else F.lit(None)))
        .otherwise(_op(op, l.lex, r.lex) if equality else F.when(a == "str", _op(op, l.lex, r.lex)))
    )
    loose = (a == "L") & ~b.isin("I", "B") | (b == "L") & ~a.isin("I", "B")
    return F.when(a == b, same).when(loose, _untyped(op, l, r)).when(a.isNotNull() & b.isNotNull(), F.lit(op == "!=") if equality else F.lit(None).cast("boolean"))


def same_term(l: Value, r: Value) -> Column:
    if l.static and r.static:
        loose = "L" in (l.static, r.static) and kind_of(l.static) == kind_of(r.static)
        return l.lex == r.lex if loose or l.static == r.static else F.when(l.lex.isNotNull() & r.lex.isNotNull(), F.lit(False))
    return (l.lex == r.lex) & (l.tag_column() == r.tag_column())


def _stringish(tag: str | Column | None):
    """The tag of a string function's result: a language stays."""
    return tag if isinstance(tag, str) and tag[0] == "@" else _d("string")


def _date(v: Value) -> Column:
    return v.typed.cast("timestamp_ntz") if v.typed is not None and datatype_of(v.static) in TEMPORAL else to_time(F.regexp_replace(v.lex, r"(Z|[+-]\d\d:\d\d)$", ""))


class Expressions:
    """Expressions over a scope: variable name -> Value. exists(group) gives a boolean column; now is fixed for a query."""

    def __init__(self, scope: dict[str, Value], exists=None, aggregates=None, functions=None, now: datetime.datetime | None = None) -> None:
        self.scope, self.exists, self.aggregates, self.functions = scope, exists, aggregates or {}, functions or {}
        self.now = now or datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None, microsecond=0)

    def value(self, e) -> Value:
        if e in self.aggregates:
            return self.aggregates[e]
        return getattr(self, "_" + type(e).__name__)(e)

    def boolean(self, e) -> Column:
        return ebv(self.value(e))

    def _TermExpr(self, e) -> Value:
        if isinstance(e.term, A.Var):
            if e.term.name not in self.scope:
                return Value(F.lit(None).cast("string"), None)
            return self.scope[e.term.name]
        return literal(e.term)

    def _Unary(self, e) -> Value:
        v = self.value(e.arg)
        if e.op == "!":
            return of_bool(~ebv(v))
        sign = -1 if e.op == "-" else 1
        if datatype_of(v.static) in INTEGRAL:
            return (of_wide if v.wide else of_int)((v.typed if v.typed is not None else typed(v.lex, XSD + "integer")) * sign)
        return of_double(number(v) * sign)

    def _Binary(self, e) -> Value:
        if e.op in ("&&", "||"):
            a, b = self.boolean(e.left), self.boolean(e.right)
            return of_bool(a & b if e.op == "&&" else a | b)
        l, r = self.value(e.left), self.value(e.right)
        if e.op in ("=", "!=", "<", ">", "<=", ">="):
            return of_bool(compare(e.op, l, r))
        whole = datatype_of(l.static) in INTEGRAL and datatype_of(r.static) in INTEGRAL
        if whole and e.op != "/":
            a, b = (v.typed if v.typed is not None else typed(v.lex, XSD + "integer") for v in (l, r))
            if l.wide or r.wide:
                a, b = a.cast("decimal(38,0)"), b.cast("decimal(38,0)")
                return of_wide({"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[e.op](a, b).try_cast("decimal(38,0)"))
            return of_int({"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[e.op](a, b))
        a, b = number(l), number(r)
        return of_double({"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b)}[e.op]())

    def _In(self, e) -> Value:
        v = self.value(e.arg)
        tests = [compare("=", v, self.value(o)) for o in e.options]
        c = functools.reduce(lambda a, b: a | b, tests) if tests else F.lit(False)
        return of_bool(~c if e.negated else c)

    def _Exists(self, e) -> Value:
        if self.exists is None:
            raise QueryError("EXISTS can't be used here")
        c = self.exists(e.group)
        return of_bool(~c if e.negated else c)

    def _Aggregate(self, e) -> Value:
        raise QueryError("an aggregate can't be used here")

    def _Function(self, e) -> Value:
        args = [self.value(a) for a in e.args]
        if e.iri in self.functions:
            return self.functions[e.iri](*args)
        if not e.iri.startswith(XSD) or len(args) != 1:
            raise QueryError(f"unknown function {e.iri}")
        v, name = args[0], e.iri[len(XSD) :]
        if name == "string":
            return of_text(v.lex)
        if e.iri in INTEGRAL:
            d = v.typed.cast("double") if datatype_of(v.static) == XSD + "boolean" and v.typed is not None else number(v) if datatype_of(v.static) in NUMERIC else to_double(v.lex)
            exact = typed(v.lex, XSD + "integer")
            exact = exact if not v.wide else v.typed.try_cast("bigint")
            n = F.coalesce(exact, F.when(~F.isnan(d) & (F.abs(d) < 9.2e18), F.when(d < 0, F.ceil(d)).otherwise(F.floor(d))))
            return Value(n.cast("string"), "D" + e.iri, n)
        if name in ("double", "float"):
            n = F.when(v.lex == "true", F.lit(1.0)).when(v.lex == "false", F.lit(0.0)).otherwise(to_double(v.lex))
            out = of_double(n if name == "double" else n.cast("float"))
            return Value(out.lex if name == "double" else lexical(n.cast("float"), T.FloatType()), "D" + e.iri, out.typed)
        if name == "decimal":
            n = typed(v.lex, e.iri)
            return Value(n.cast("string"), "D" + e.iri, n)
        if name == "boolean":
            n = to_double(v.lex)
            return of_bool(F.coalesce(to_bool(F.lower(v.lex)), n != 0))
        if name == "date":
            n = _date(v).cast("date")
            return Value(n.cast("string"), "D" + e.iri, n)
        if name == "dateTime":
            n = _date(v)
            return Value(lexical(n, T.TimestampNTZType()), "D" + e.iri, n)
        raise QueryError(f"unknown function {e.iri}")

    def _Call(self, e) -> Value:
        name = e.name
        if name == "BOUND":
            return of_bool(self.value(e.args[0]).lex.isNotNull())
        args = [self.value(a) for a in e.args]
        lex = [a.lex for a in args]
        v = args[0] if args else None
        if name == "STR":
            return of_text(v.lex)
        if name == "CONCAT":
            tag = meet([a.static for a in args]) if args else None
            return of_text(F.concat(*lex) if lex else F.lit(""), tag if tag and tag[0] == "@" else _d("string"))
        if name == "STRLEN":
            return of_int(F.length(v.lex))
        if name == "SUBSTR":
            at = number(args[1]).cast("int")
            start = F.greatest(at, F.lit(1))
            if len(args) == 2:
                out = F.substring(v.lex, start, F.length(v.lex))
            else:
                out = F.substring(v.lex, start, F.greatest(number(args[2]).cast("int") - (start - at), F.lit(0)))
            return of_text(out, _stringish(v.tag))
        if name in ("UCASE", "LCASE"):
            return of_text((F.upper if name == "UCASE" else F.lower)(v.lex), _stringish(v.tag))
        if name in ("CONTAINS", "STRSTARTS", "STRENDS"):
            return of_bool({"CONTAINS": F.contains, "STRSTARTS": F.startswith, "STRENDS": F.endswith}[name](lex[0], lex[1]))
        if name in ("STRBEFORE", "STRAFTER"):
            at = F.position(lex[1], lex[0])
            part = F.substring(lex[0], F.lit(1), at - 1) if name == "STRBEFORE" else F.substring(lex[0], at + F.length(lex[1]), F.length(lex[0]))
            return of_text(F.when(at > 0, part).when(at == 0, F.lit("")), _stringish(v.tag))
        if name in ("REGEX", "REPLACE"):
            pattern = lex[1]
            flags = e.args[2 if name == "REGEX" else 3 :]
            if flags:
                if not (isinstance(flags[0], A.TermExpr) and isinstance(flags[0].term, A.Literal)):
                    raise QueryError("flags must be a literal")
                f = "".join(c for c in flags[0].term.text if c in "ismx")
                if "q" in flags[0].term.text:
                    pattern = F.concat(F.lit("\\Q"), pattern, F.lit("\\E"))
                pattern = F.concat(F.lit(f"(?{f})"), pattern) if f else pattern
            return of_bool(F.regexp_like(lex[0], pattern)) if name == "REGEX" else of_text(F.regexp_replace(lex[0], pattern, lex[2]), _stringish(v.tag))
        if name in ("ABS", "CEIL", "FLOOR", "ROUND"):
            if datatype_of(v.static) in INTEGRAL:
                n = v.typed if v.typed is not None else typed(v.lex, XSD + "integer")
                return (of_wide if v.wide else of_int)(F.abs(n) if name == "ABS" else n)
            n = number(v)
            return of_double({"ABS": F.abs, "CEIL": F.ceil, "FLOOR": F.floor, "ROUND": lambda x: F.floor(x + 0.5)}[name](n))
        if name == "COALESCE":
            tag = meet([a.static for a in args])
            kept = [a.typed for a in args]
            t = F.coalesce(*kept) if tag and tag[0] == "D" and all(x is not None for x in kept) and kept else None
            return Value(F.coalesce(*lex), tag or F.coalesce(*[a.tag_column() for a in args]), t)
        if name == "IF":
            test, a, b = ebv(v), args[1], args[2]
            pick = lambda x, y: F.when(test, x).when(~test, y)
            tag = meet([a.static, b.static])
            t = pick(a.typed, b.typed) if tag and a.typed is not None and b.typed is not None else None
            return Value(pick(a.lex, b.lex), tag or pick(a.tag_column(), b.tag_column()), t)
        if name == "SAMETERM":
            return of_bool(same_term(*args))
        if name == "ISNUMERIC":
            if v.static:
                return of_bool(F.when(v.lex.isNotNull(), typed(v.lex, datatype_of(v.static)).isNotNull() if datatype_of(v.static) in NUMERIC else F.lit(False)))
            return of_bool(_in(v.tag_column(), NUMERIC) & to_double(v.lex).isNotNull())
        if name in ("MD5", "SHA1"):
            return of_text((F.md5 if name == "MD5" else F.sha1)(v.lex.cast("binary")))
        if name.startswith("SHA"):
            return of_text(F.sha2(v.lex.cast("binary"), int(name[3:])))
        if name in ("ISIRI", "ISURI", "ISBLANK", "ISLITERAL"):
            t = v.tag_column()
            return of_bool(t == "I" if name in ("ISIRI", "ISURI") else t == "B" if name == "ISBLANK" else ~t.isin("I", "B"))
        if name == "LANG":
            t = v.tag_column()
            return of_text(F.when(t.startswith("@"), F.substring(t, F.lit(2), F.length(t))).when(~t.isin("I", "B"), F.lit("")))
        if name == "LANGMATCHES":
            a, b = F.lower(lex[0]), F.lower(lex[1])
            return of_bool(F.when(b == "*", a != "").otherwise((a == b) | a.startswith(F.concat(b, F.lit("-")))))
        if name == "DATATYPE":
            if v.static:
                d = datatype_of(v.static)
                return Value(F.when(v.lex.isNotNull(), F.lit(d)) if d else F.lit(None).cast("string"), "I")
            t = v.tag_column()
            return Value(F.when(t.startswith("D"), F.substring(t, F.lit(2), F.length(t))).when(t.startswith("@"), F.lit(RDF + "langString")), "I")
        if name in ("STRDT", "STRLANG"):
            at = e.args[1].term if isinstance(e.args[1], A.TermExpr) else None
            if name == "STRDT" and isinstance(at, A.Iri):
                return Value(v.lex, "D" + at.value, typed(v.lex, at.value))
            if name == "STRLANG" and isinstance(at, A.Literal):
                return Value(v.lex, "@" + at.text.lower())
            return Value(v.lex, F.concat(F.lit("D" if name == "STRDT" else "@"), lex[1] if name == "STRDT" else F.lower(lex[1])))
        if name in ("IRI", "URI"):
            return Value(v.lex, "I")
        if name == "BNODE":
            return Value(F.concat(F.lit("b"), F.md5(v.lex.cast("binary")) if args else F.replace(F.uuid(), F.lit("-"), F.lit(""))), "B")
        if name == "ENCODE_FOR_URI":
            return of_text(encode(v.lex))
        if name in ("YEAR", "MONTH", "DAY", "HOURS", "MINUTES", "SECONDS"):
            f = {"YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth, "HOURS": F.hour, "MINUTES": F.minute, "SECONDS": F.second}[name]
            return of_int(f(_date(v)))
        if name in ("TZ", "TIMEZONE"):
            zone = F.regexp_extract(v.lex, r"(Z|[+-]\d\d:\d\d)$", 1)
            if name == "TZ":
                return of_text(zone)
            h, m = F.substring(zone, F.lit(2), F.lit(2)).try_cast("int"), F.substring(zone, F.lit(5), F.lit(2)).try_cast("int")
            text = F.concat(F.when(zone.startswith("-"), "-").otherwise(""), F.lit("PT"), F.when(h > 0, F.concat(h.cast("string"), F.lit("H"))).otherwise(""), F.when(m > 0, F.concat(m.cast("string"), F.lit("M"))).otherwise(""))
            return Value(F.when(zone.isin("Z", "+00:00", "-00:00"), "PT0S").when(zone != "", text), _d("dayTimeDuration"))
        if name == "NOW":
            return Value(F.lit(self.now.isoformat()), _d("dateTime"), F.lit(self.now.isoformat(" ")).cast("timestamp_ntz"))
        if name == "RAND":
            return of_double(F.rand())
        if name == "UUID":
            return Value(F.concat(F.lit("urn:uuid:"), F.uuid()), "I")
        if name == "STRUUID":
            return of_text(F.uuid())
        raise QueryError(f"unknown function {name}")
