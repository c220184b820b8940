"""Mappings: the model, built from R2RML in Turtle, from YARRRML, or in Python."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .sources.turtle import RDF, read_turtle
from .template import Template

RR = "http://www.w3.org/ns/r2rml#"
XSD = "http://www.w3.org/2001/XMLSchema#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"


class MappingError(ValueError):
    """A mapping that can't be used."""


@dataclass(frozen=True)
class TermMap:
    """Where terms come from: exactly one of column, template and constant. kind: I, B or L."""

    column: str | None = None
    template: Template | None = None
    constant: str | None = None
    kind: str = "I"
    datatype: str | None = None
    lang: str | None = None

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.column,) if self.column else self.template.columns if self.template else ()


@dataclass(frozen=True)
class RefMap:
    """Objects are the subjects of a parent triples map, joined on (child column, parent column) pairs; none: the same row."""

    parent: str
    joins: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class PredicateObject:
    predicates: tuple[TermMap, ...]
    objects: tuple[TermMap | RefMap, ...]
    graphs: tuple[TermMap, ...] = ()


@dataclass
class TriplesMap:
    """Table is a table's name, sql a query; neither: rows come from outside (inside-out use)."""

    id: str
    subject: TermMap | None = None
    table: str | None = None
    sql: str | None = None
    classes: tuple[str, ...] = ()
    graphs: tuple[TermMap, ...] = ()
    pos: list[PredicateObject] = field(default_factory=list)

    @property
    def source(self) -> str | None:
        return self.table if self.table is not None else f"view:{self.sql}" if self.sql is not None else None


@dataclass
class Mapping:
    maps: dict[str, TriplesMap]
    errors: list[str] = field(default_factory=list)
    prefixes: dict[str, str] = field(default_factory=dict)

    def is_valid(self) -> bool:
        """All maps have a source and a subject, and all parents exist."""
        return not self.errors and all(m.source and m.subject for m in self.maps.values()) and self._parents()

    def is_valid_inside_out(self) -> bool:
        """No map has a source or refers to another: rows are given from outside."""
        return all(m.subject and not m.source and not any(isinstance(o, RefMap) for p in m.pos for o in p.objects) for m in self.maps.values())

    def _parents(self) -> bool:
        return all(o.parent in self.maps for m in self.maps.values() for p in m.pos for o in p.objects if isinstance(o, RefMap))


def iri(value: str) -> TermMap:
    return TermMap(constant=value)


def template(text: str, kind: str = "I", datatype: str | None = None, lang: str | None = None) -> TermMap:
    return TermMap(template=Template.parse(text), kind=kind, datatype=datatype, lang=lang)


def column(name: str, datatype: str | None = None, lang: str | None = None, kind: str = "L") -> TermMap:
    return TermMap(column=name, kind=kind, datatype=datatype, lang=lang)


def predicate_object(p: str, *objects: TermMap | RefMap, graphs: tuple[TermMap, ...] = ()) -> PredicateObject:
    return PredicateObject((iri(p),), objects, graphs)


# R2RML


class _Builder:
    def __init__(self, triples, strict: bool) -> None:
        self.by: dict = {}
        for s, p, o in triples:
            self.by.setdefault(s, {}).setdefault(p, []).append(o)
        self.strict, self.errors = strict, []

    def note(self, message: str) -> None:
        if self.strict:
            raise MappingError(message)
        self.errors.append(message)

    def get(self, node, name: str) -> list:
        return self.by.get(node, {}).get(RR + name, [])

    def one(self, node, name: str):
        found = self.get(node, name)
        return found[0] if found else None

    def text(self, node, name: str) -> str | None:
        x = self.one(node, name)
        return x[1] if x else None

    def constant(self, x, literal: bool) -> TermMap | None:
        if x[0] == "literal":
            return TermMap(constant=x[1], kind="L", datatype=x[2], lang=x[3]) if literal else None
        return TermMap(constant=x[1], kind="I" if x[0] == "iri" else "B")

    def term(self, node, place: str) -> TermMap | None:
        """place: subject, predicate, object or graph."""
        const, col, tpl = self.one(node, "constant"), self.text(node, "column"), self.text(node, "template")
        datatype, lang, kind = self.text(node, "datatype"), self.text(node, "language"), self.text(node, "termType")
        kind = {RR + "IRI": "I", RR + "BlankNode": "B", RR + "Literal": "L"}.get(kind) if kind else None
        if kind == "L" and place == "subject":
            self.note("a subject map can't make literals")
            return None
        if place == "subject" and tpl is not None:
            col = None
        if col is not None:
            # a column is a literal where literals can be, and so is what has a datatype or language
            return TermMap(column=col.strip('"'), kind=kind or ("L" if place == "object" else "I"), datatype=datatype, lang=lang)
        if tpl is not None:
            try:
                parsed = Template.parse(tpl)
            except ValueError as e:
                self.note(str(e))
                return None
            return TermMap(template=parsed, kind=kind or ("L" if place == "object" and (datatype or lang) else "I"), datatype=datatype, lang=lang)
        if const is not None:
            return self.constant(const, place == "object")
        self.note(f"a {place} map has no column, template or constant")
        return None

    def terms(self, node, short: str, long: str, place: str) -> list:
        out = [self.constant(x, place == "object") for x in self.get(node, short)]
        for m in self.get(node, long):
            parent = self.text(m, "parentTriplesMap") if place == "object" else None
            if parent is not None:
                joins = []
                for j in self.get(m, "joinCondition"):
                    child, par = self.text(j, "child"), self.text(j, "parent")
                    if child is None or par is None:
                        self.note("a join condition lacks a child or parent column")
                        continue
                    joins.append((child.strip('"'), par.strip('"')))
                out.append(RefMap(parent, tuple(joins)))
            else:
                out.append(self.term(m, place))
        return [x for x in out if x is not None]

    def build(self) -> Mapping:
        maps: dict[str, TriplesMap] = {}
        for s in sorted((s for s in self.by if s[0] == "iri"), key=lambda s: s[1]):
            if not any(RR + n in self.by[s] for n in ("logicalTable", "subjectMap", "predicateObjectMap", "subject")):
                continue
            m = TriplesMap(s[1])
            table = self.one(s, "logicalTable")
            if table is not None:
                name, sql = self.text(table, "tableName"), self.text(table, "sqlQuery")
                if name is None and sql is None:
                    self.note(f"{s[1]}: a logical table has neither a name nor a query")
                m.table, m.sql = name.strip('"') if name else None, sql.strip().rstrip(";") if sql and not name else None
            subject = self.one(s, "subjectMap")
            if subject is not None:
                m.subject = self.term(subject, "subject")
                m.classes = tuple(x[1] for x in self.get(subject, "class"))
                m.graphs = tuple(self.terms(subject, "graph", "graphMap", "graph"))
            elif self.one(s, "subject") is not None:
                m.subject = self.constant(self.one(s, "subject"), False)
            if m.subject is None:
                self.note(f"{s[1]}: no subject map")
            for po in self.get(s, "predicateObjectMap"):
                p, o = self.terms(po, "predicate", "predicateMap", "predicate"), self.terms(po, "object", "objectMap", "object")
                if not p or not o:
                    self.note(f"{s[1]}: a predicate-object map lacks a predicate or an object")
                    continue
                m.pos.append(PredicateObject(tuple(p), tuple(o), tuple(self.terms(po, "graph", "graphMap", "graph"))))
            maps[s[1]] = m
        for m in maps.values():
            for po in m.pos:
                for o in po.objects:
                    if isinstance(o, RefMap) and o.parent not in maps:
                        self.note(f"{m.id}: unknown parent {o.parent}")
        return Mapping(maps, self.errors)


def parse_r2rml(text: str, base: str = "", strict: bool = False) -> Mapping:
    """The mapping of an R2RML document. strict: the first error is raised; else errors are listed."""
    return _Builder(read_turtle(text, base), strict).build()


# YARRRML

_KNOWN = {"sources", "s", "subject", "subjects", "po", "predicateobjects", "graph", "graphs", "source"}


class _Yarrrml:
    def __init__(self, doc: dict, strict: bool) -> None:
        self.doc, self.strict, self.errors, self.triples, self.fresh = doc or {}, strict, [], [], 0
        self.prefixes = {"rr": RR, "rdf": RDF, "rdfs": RDFS, "xsd": XSD} | {str(k): str(v) for k, v in (self.doc.get("prefixes") or {}).items()}
        self.base = self.doc.get("base") or ""

    def note(self, message: str) -> None:
        if self.strict:
            raise MappingError(message)
        self.errors.append(message)

    def blank(self):
        self.fresh += 1
        return ("bnode", f"%{self.fresh}")

    def add(self, s, p: str, o) -> None:
        self.triples.append((s, RR + p, o))

    def expand(self, text: str) -> str:
        m = re.match(r"([A-Za-z][\w.\-]*)?:(?!//)", text)
        if m and (m[1] or "") in self.prefixes:
            return self.prefixes[m[1] or ""] + text[m.end() :]
        return text

    @staticmethod
    def pick(node, *names):
        for n in names:
            if isinstance(node, dict) and n in node:
                return node[n]
        return None

    @staticmethod
    def many(x) -> list:
        return [] if x is None else x if isinstance(x, list) else [x]

    def value(self, text: str, place: str, datatype=None, lang=None):
        """A node for a term map: a bare $(COL), a template, an IRI or a literal."""
        text = str(text).lower() if isinstance(text, bool) else str(text)
        as_iri = text.endswith("~iri")
        text = text[: -len("~iri")] if as_iri else text
        node = self.blank()
        bare = re.fullmatch(r"\$\(([^()]+)\)", text)
        refs = re.search(r"(?<!\\)\$\(", text)
        if bare and place != "iri":
            self.add(node, "column", ("literal", bare[1], None, None))
        elif refs:
            body = self.expand(text)
            body = re.sub(r"([{}])", r"\\\1", body)
            body = re.sub(r"(?<!\\)\$\(([^()]+)\)", lambda m: "{" + m[1] + "}", body).replace("\\$(", "$(")
            self.add(node, "template", ("literal", body, None, None))
        else:
            full = self.expand(text).replace("\\$(", "$(")
            is_iri = place in ("iri", "predicate", "subject") or as_iri or full != text or re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://", text)
            if datatype or lang or not is_iri:
                self.add(node, "constant", ("literal", full, self.expand(datatype) if datatype else None, lang))
                return node
            self.add(node, "constant", ("iri", full if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", full) else self.base + full))
            return node
        if place == "object":
            kind = "IRI" if as_iri or (not bare and not (datatype or lang) and re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", self.expand(text))) else "Literal"
            self.add(node, "termType", ("iri", RR + kind))
        if datatype:
            self.add(node, "datatype", ("iri", self.expand(datatype)))
        if lang:
            self.add(node, "language", ("literal", lang, None, None))
        return node

    @staticmethod
    def typed(extra) -> tuple[str | None, str | None]:
        if extra is None:
            return None, None
        extra = str(extra)
        return (None, extra[: -len("~lang")]) if extra.endswith("~lang") else (extra, None)

    def obj(self, po, o) -> None:
        if isinstance(o, dict) and ("mapping" in o or "mappings" in o):
            node = self.blank()
            self.add(node, "parentTriplesMap", ("iri", self.name(str(self.pick(o, "mapping", "mappings")))))
            for c in self.many(self.pick(o, "condition", "conditions")):
                if not isinstance(c, dict):
                    self.note("a condition is not a map")
                    continue
                if c.get("function") != "equal":
                    self.note(f"only the condition function equal is known, not {c.get('function')}")
                    continue
                args = [a[1] if isinstance(a, list) and len(a) > 1 else None if isinstance(a, list) else a for a in self.many(self.pick(c, "parameters"))]
                names = [re.fullmatch(r"\$\(([^()]+)\)", str(a)) for a in args]
                if len(names) != 2 or not all(names):
                    self.note("a condition needs two references")
                    continue
                j = self.blank()
                self.add(j, "child", ("literal", names[0][1], None, None))
                self.add(j, "parent", ("literal", names[1][1], None, None))
                self.add(node, "joinCondition", j)
        elif isinstance(o, dict):
            value = self.pick(o, "value")
            if value is None:
                self.note("an object lacks a value")
                return
            text = f"{value}~iri" if self.pick(o, "type") == "iri" else value
            node = self.value(text, "object", self.pick(o, "datatype"), self.pick(o, "language"))
        elif isinstance(o, list):
            if not o or isinstance(o[0], (list, dict)):
                self.note("a list for an object needs a value first")
                return
            node = self.value(o[0], "object", *self.typed(o[1] if len(o) > 1 else None))
        else:
            node = self.value(o, "object")
        self.add(po, "objectMap", node)

    def name(self, key: str) -> str:
        return self.expand(key) if ":" in key and self.expand(key) != key else f"{self.base or 'http://example.com/'}#{key}"

    def source(self, s):
        if isinstance(s, str):
            named = (self.doc.get("sources") or {}).get(s)
            if named is None:
                self.note(f"unknown source {s}")
            s = named if named is not None else {"table": s}
        if isinstance(s, list) and s:
            s = {"table": re.sub(r"~\w+$", "", str(s[0]))}
        if not isinstance(s, dict) or not any(k in s for k in ("query", "table", "access")):
            self.note("a source is a map with a query, a table or an access")
            return None
        return s

    def build(self) -> Mapping:
        for k in self.doc:
            if k not in ("prefixes", "base", "mappings", "sources"):
                self.note(f"unknown key {k}")
        mappings = self.doc.get("mappings")
        if not isinstance(mappings, dict) or not mappings:
            self.note("there are no mappings")
            mappings = {}
        for key, m in mappings.items():
            if m is not None and not isinstance(m, dict):
                self.note(f"{key}: a mapping is a map")
                continue
            s, m = ("iri", self.name(str(key))), m or {}
            for k in m:
                if k not in _KNOWN:
                    self.note(f"{key}: unknown key {k}")
            sources = self.many(self.pick(m, "sources", "source"))
            if len(sources) > 1:
                self.note(f"{key}: only the first of several sources is used")
            src = self.source(sources[0]) if sources else None
            if src is not None:
                table = self.blank()
                if "query" in src:
                    self.add(table, "sqlQuery", ("literal", str(src["query"]), None, None))
                else:
                    self.add(table, "tableName", ("literal", re.sub(r"~\w+$", "", str(self.pick(src, "table", "access"))), None, None))
                self.add(s, "logicalTable", table)
            subjects = self.many(self.pick(m, "s", "subject", "subjects"))
            if len(subjects) > 1:
                self.note(f"{key}: only the first of several subjects is used")
            subject = None
            if subjects:
                text = subjects[0].get("value") if isinstance(subjects[0], dict) else subjects[0]
                subject = self.value(text, "iri" if not re.fullmatch(r"\$\([^()]+\)", str(text)) else "subject")
                self.add(s, "subjectMap", subject)
                for g in self.many(self.pick(m, "graphs", "graph")):
                    self.add(subject, "graphMap", self.value(g, "iri"))
            for entry in self.many(self.pick(m, "po", "predicateobjects")):
                if isinstance(entry, list) and len(entry) < 2 or not isinstance(entry, (list, dict)):
                    self.note(f"{key}: an entry of po needs a predicate and an object")
                    continue
                if isinstance(entry, list):
                    predicates, objects = entry[0], entry[1] if isinstance(entry[1], list) else [entry[1]]
                    objects = [[o, *entry[2:]] if len(entry) > 2 and not isinstance(o, (list, dict)) else o for o in objects]
                    graphs = None
                else:
                    predicates, objects = self.pick(entry, "p", "predicate", "predicates"), self.many(self.pick(entry, "o", "object", "objects"))
                    graphs = self.pick(entry, "graphs", "graph")
                    if objects and len(objects) in (2, 3) and isinstance(objects[1], str) and (objects[1].endswith("~lang") or objects[1].startswith("xsd:")):
                        objects = [objects]
                predicates = [RDF + "type" if p == "a" else p for p in self.many(predicates)]
                if predicates == [RDF + "type"] and subject is not None and all(isinstance(o, str) and "$(" not in o for o in objects):
                    for o in objects:
                        self.add(subject, "class", ("iri", self.expand(o.removesuffix("~iri"))))
                    continue
                po = self.blank()
                for p in predicates:
                    self.add(po, "predicateMap", self.value(p, "iri" if "$(" in str(p) else "predicate"))
                for o in objects:
                    self.obj(po, o)
                for g in self.many(graphs):
                    self.add(po, "graphMap", self.value(g, "iri"))
                self.add(s, "predicateObjectMap", po)
        built = _Builder(self.triples, self.strict).build()
        return Mapping(built.maps, self.errors + built.errors, self.prefixes)


def parse_yarrrml(text: str, strict: bool = False) -> Mapping:
    """The mapping of a YARRRML document."""
    import yaml

    try:
        doc = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise MappingError(f"not YAML: {e}") from e
    if not isinstance(doc, dict):
        raise MappingError("a YARRRML document is a map")
    return _Yarrrml(doc, strict).build()


def load_mapping(path: str, strict: bool = False) -> Mapping:
    """A mapping file, by its extension: .ttl, .yml, .yaml or .yarrrml."""
    import pathlib

    text, ext = pathlib.Path(path).read_text(encoding="utf-8"), pathlib.Path(path).suffix.lower()
    if ext == ".ttl":
        return parse_r2rml(text, pathlib.Path(path).resolve().as_uri(), strict)
    if ext in (".yml", ".yaml", ".yarrrml"):
        return parse_yarrrml(text, strict)
    raise MappingError(f"unknown mapping format {ext!r}")
