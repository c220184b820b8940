"""Syntax tree of SPARQL queries."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Iri:
    value: str


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Bnode:
    label: str


@dataclass(frozen=True)
class Literal:
    text: str
    datatype: str | None = None
    lang: str | None = None


Term = Iri | Var | Bnode | Literal


# property paths


@dataclass(frozen=True)
class Link:
    """One step: an IRI or a variable."""

    term: Iri | Var


@dataclass(frozen=True)
class Inverse:
    path: object


@dataclass(frozen=True)
class Seq:
    parts: tuple


@dataclass(frozen=True)
class Alt:
    parts: tuple


@dataclass(frozen=True)
class Repeat:
    """path?, path* or path+."""

    path: object
    op: str


@dataclass(frozen=True)
class Negated:
    """A negated property set: IRIs forward and IRIs backward."""

    forward: tuple[Iri, ...]
    backward: tuple[Iri, ...]


# expressions


@dataclass(frozen=True)
class TermExpr:
    term: Term


@dataclass(frozen=True)
class Unary:
    op: str
    arg: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class In:
    arg: object
    options: tuple
    negated: bool = False


@dataclass(frozen=True)
class Call:
    """A builtin, by its upper-case name."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Function:
    """A function named by an IRI."""

    iri: str
    args: tuple
    distinct: bool = False


@dataclass(frozen=True)
class Aggregate:
    name: str
    arg: object | None
    distinct: bool = False
    separator: str = " "


@dataclass(frozen=True)
class Exists:
    group: Group
    negated: bool = False


# graph patterns


@dataclass(frozen=True)
class Triple:
    s: Term
    p: object
    o: Term


@dataclass(frozen=True)
class Triples:
    triples: tuple[Triple, ...]


@dataclass(frozen=True)
class Group:
    parts: tuple = ()


@dataclass(frozen=True)
class Optional_:
    group: Group


@dataclass(frozen=True)
class Minus:
    group: Group


@dataclass(frozen=True)
class Union:
    groups: tuple[Group, ...]


@dataclass(frozen=True)
class Graph:
    name: Iri | Var
    group: Group


@dataclass(frozen=True)
class Service:
    name: Iri | Var
    group: Group
    silent: bool = False


@dataclass(frozen=True)
class Filter:
    expr: object


@dataclass(frozen=True)
class Bind:
    expr: object
    var: Var


@dataclass(frozen=True)
class Values:
    vars: tuple[Var, ...]
    rows: tuple[tuple[Term | None, ...], ...]


@dataclass(frozen=True)
class SubSelect:
    query: Query


# queries


@dataclass
class Query:
    form: str = "SELECT"
    distinct: bool = False
    reduced: bool = False
    star: bool = False
    items: list = field(default_factory=list)  # (Var, expression or None)
    template: list[Triple] = field(default_factory=list)
    describe: list = field(default_factory=list)
    dataset: list = field(default_factory=list)  # (Iri, named)
    where: Group = field(default_factory=Group)
    group_by: list = field(default_factory=list)  # (expression, Var or None)
    having: list = field(default_factory=list)
    order_by: list = field(default_factory=list)  # (expression, descending)
    limit: int | None = None
    offset: int | None = None
    values: Values | None = None
    prefixes: dict = field(default_factory=dict)
    base: str = ""
