"""RDF terms as columns: a lexical form, a tag, and what is known of the tag before running.

A tag says what a term is: `I` an IRI, `B` a blank node, `L` a literal of unknown datatype, `D<iri>` a literal with that
datatype, `@lang` a literal with that language. A tag is null just where the lexical form is (an unbound variable).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
INTEGRAL = {XSD + n for n in ("integer", "long", "int", "short", "byte")}
NUMERIC = INTEGRAL | {XSD + n for n in ("decimal", "double", "float")}
TEMPORAL = {XSD + n for n in ("date", "dateTime")}
#: Fixed value: what an xsd:double may look like; Spark's own cast takes more ("12d").
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$|^\s*(NaN|[+-]?INF)\s*$"
#: Spark's natural datatypes; a timestamp with a time zone has none.
NATURAL = {
    T.StringType: XSD + "string", T.ByteType: XSD + "integer", T.ShortType: XSD + "integer", T.IntegerType: XSD + "integer",
    T.LongType: XSD + "integer", T.DecimalType: XSD + "decimal", T.FloatType: XSD + "double", T.DoubleType: XSD + "double",
    T.BooleanType: XSD + "boolean", T.DateType: XSD + "date", T.TimestampNTZType: XSD + "dateTime", T.BinaryType: XSD + "hexBinary",
}


def tag_of(kind: str, datatype: str | None = None, lang: str | None = None) -> str:
    """The tag of a term: kind I, B or L."""
    if kind != "L":
        return kind
    return f"@{lang.lower()}" if lang else f"D{datatype}" if datatype else "L"


def meet(tags: list[str | None]) -> str | None:
    """The tag common to all, or None: then only the data can tell."""
    return tags[0] if tags and all(t == tags[0] for t in tags) else None


def datatype_of(tag: str | None) -> str | None:
    """The datatype that a static tag fixes."""
    return tag[1:] if tag and tag[0] == "D" else RDF + "langString" if tag and tag[0] == "@" else None


def kind_of(tag: str | None) -> str | None:
    """I, B or L, if a static tag is there."""
    return None if tag is None else tag if tag in "IB" else "L"


#: Value spaces: only values of one space compare.
def space_of(tag: str) -> str:
    d = datatype_of(tag)
    if tag in "IBL":
        return tag
    if tag[0] == "@":
        return "lang"
    return "num" if d in NUMERIC else "time" if d in TEMPORAL else "bool" if d == XSD + "boolean" else "str" if d == XSD + "string" else tag


@dataclass(frozen=True)
class Native:
    """How a term comes from columns: a template's text with one placeholder or more (or a bare column, shape None), and the
    hidden columns that hold the values before they became text."""

    shape: tuple[str, ...] | None
    columns: tuple[str, ...]
    types: tuple[str, ...]


@dataclass(frozen=True)
class Info:
    """What is known of a variable: its static tag (None: see the tag column), if it can be unbound, where it comes from."""

    tag: str | None = None
    nullable: bool = False
    native: Native | None = field(default=None, compare=False)


@dataclass
class Value:
    """An expression: its lexical form as a Column, its tag (static, or a Column), and, where it has one, its typed form."""

    lex: Column
    tag: str | Column | None
    typed: Column | None = None  # boolean, long, decimal, double or timestamp in Spark's own types
    wide: bool = False  # a whole number as decimal(38,0), which may not fit a long

    @property
    def static(self) -> str | None:
        return self.tag if isinstance(self.tag, str) else None

    def tag_column(self) -> Column:
        t = F.lit(self.tag) if isinstance(self.tag, str) else F.lit("L") if self.tag is None else self.tag
        return F.when(self.lex.isNotNull(), t)


def encode(c: Column) -> Column:
    """Percent-encoding of all but unreserved characters, in UTF-8 with upper-case hex."""
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def lexical(c: Column, kind: T.DataType) -> Column:
    """The XSD lexical form of a column: T between date and time, upper-case hex, shortest doubles."""
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        return F.when(text.endswith(".000000"), F.substring(text, 1, 19)).otherwise(F.regexp_replace(text, "0+$", ""))
    if isinstance(kind, T.BinaryType):
        return F.hex(c)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(c == float("inf"), "INF").when(c == float("-inf"), "-INF").otherwise(c.cast("string"))
    return c.cast("string")


def to_double(c: Column) -> Column:
    """A number's value, or null."""
    text = F.trim(c)
    value = F.when(text.isin("INF", "+INF"), F.lit(float("inf"))).when(text == "-INF", F.lit(float("-inf"))).otherwise(text.try_cast("double"))
    return F.when(c.rlike(NUMBER), value)


def to_time(c: Column) -> Column:
    """A date's or time's value without zone, or null."""
    return F.replace(c, F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz")


def to_bool(c: Column) -> Column:
    return F.when(c.isin("true", "1"), F.lit(True)).when(c.isin("false", "0"), F.lit(False))


def typed(lex: Column, datatype: str | None) -> Column:
    """The value of a literal of a datatype, in Spark's type for it; null if the text isn't one."""
    if datatype in INTEGRAL:
        return F.when(lex.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(lex).try_cast("bigint"))
    if datatype == XSD + "decimal":
        return F.when(lex.rlike(NUMBER), F.trim(lex).try_cast("decimal(38,18)"))
    if datatype in NUMERIC:
        return to_double(lex)
    if datatype == XSD + "boolean":
        return to_bool(lex)
    if datatype == XSD + "date":
        return lex.try_cast("date")
    if datatype in TEMPORAL:
        return to_time(lex)
    return lex
