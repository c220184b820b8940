"""A reader of the Turtle that mapping documents use."""

from __future__ import annotations

import re
from urllib.parse import urljoin

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"


class TurtleError(ValueError):
    """A syntax error with its line."""


_TOKENS = re.compile(
    r"""
    (?P<skip>(?:\s|\#[^\n]*)+)
  | (?P<iri><(?:[^\x00-\x20<>"{}|^`\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)
  | (?P<string>\"\"\"(?:(?:"|"")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
  | (?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  | (?P<bnode>_:[\w](?:[\w.\-]*[\w\-])?)
  | (?P<pname>(?:[^\W\d_](?:[\w.\-]*[\w\-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\.)(?:(?:[\w.:\-]|%[0-9A-Fa-f]{2}|\\.)*(?:[\w:\-]|%[0-9A-Fa-f]{2}|\\.))?)?)
  | (?P<double>[+-]?(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+)
  | (?P<decimal>[+-]?\d*\.\d+)
  | (?P<integer>[+-]?\d+)
  | (?P<word>[A-Za-z]+)
  | (?P<op>\^\^|[\[\]();,.])
    """,
    re.X | re.S,
)
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def unescape(s: str) -> str:
    s = re.sub(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})", lambda m: chr(int(m[1] or m[2], 16)), s)
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), s, flags=re.S)


#: A term is ("iri", value), ("bnode", label) or ("literal", text, datatype, lang).
Term = tuple


class Reader:
    def __init__(self, text: str, base: str = "") -> None:
        self.base, self.prefixes, self.triples, self.fresh, self.i = base, {}, [], 0, 0
        self.toks, at, line = [], 0, 1
        while at < len(text):
            m = _TOKENS.match(text, at)
            if not m:
                raise TurtleError(f"line {line}: unexpected {text[at : at + 12]!r}")
            if m.lastgroup != "skip":
                self.toks.append((m.lastgroup, m[0], line))
            line += m[0].count("\n")
            at = m.end()
        self.toks.append(("end", "", line))

    def fail(self, message: str):
        kind, text, line = self.toks[self.i]
        raise TurtleError(f"line {line}: {message}, found {text or 'the end'!r}")

    def next(self):
        self.i += 1
        return self.toks[self.i - 1]

    def op(self, text: str) -> bool:
        if self.toks[self.i][:2] == ("op", text):
            self.i += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.op(text):
            self.fail(f"expected {text!r}")

    def read(self) -> list[tuple[Term, str, Term]]:
        while self.toks[self.i][0] != "end":
            kind, text, _ = self.toks[self.i]
            word = text.lower().lstrip("@")
            if kind == "at" and word in ("prefix", "base") or kind == "word" and word in ("prefix", "base"):
                self.next()
                if word == "prefix":
                    k, name, _ = self.next()
                    if k != "pname" or not name.endswith(":"):
                        self.i -= 1
                        self.fail("expected a prefix")
                    self.prefixes[name[:-1]] = self.iri()
                else:
                    self.base = self.iri()
                if kind == "at":
                    self.need(".")
                continue
            if self.toks[self.i][:2] == ("op", "["):
                s = self.term()
                if self.toks[self.i][:2] != ("op", "."):
                    self.properties(s)
            else:
                s = self.term()
                if s[0] == "literal":
                    self.fail("a literal can't be a subject")
                self.properties(s)
            self.need(".")
        return self.triples

    def properties(self, s: Term) -> None:
        while True:
            kind, text, _ = self.toks[self.i]
            if kind == "word" and text == "a":
                self.next()
                p = RDF + "type"
            else:
                p = self.iri()
            while True:
                self.triples.append((s, p, self.term()))
                if not self.op(","):
                    break
            if not self.op(";"):
                return
            while self.op(";"):
                pass
            if self.toks[self.i][:2] in (("op", "."), ("op", "]")):
                return

    def iri(self) -> str:
        kind, text, _ = self.next()
        if kind == "iri":
            v = unescape(text[1:-1])
            return v if re.match(r"[A-Za-z][\w+.\-]*:", v) or not self.base else urljoin(self.base, v)
        if kind == "pname":
            prefix, _, local = text.partition(":")
            if prefix in self.prefixes:
                return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
            self.i -= 1
            self.fail(f"undeclared prefix {prefix!r}")
        self.i -= 1
        self.fail("expected an IRI")

    def blank(self) -> Term:
        self.fresh += 1
        return ("bnode", f"%{self.fresh}")

    def term(self) -> Term:
        kind, text, _ = self.toks[self.i]
        if kind in ("iri", "pname"):
            return ("iri", self.iri())
        if kind == "bnode":
            self.next()
            return ("bnode", text[2:])
        if kind == "string":
            self.next()
            s = unescape(text[3:-3] if text[:3] in ('"""', "'''") else text[1:-1])
            if self.toks[self.i][0] == "at":
                return ("literal", s, None, self.next()[1][1:])
            if self.op("^^"):
                return ("literal", s, self.iri(), None)
            return ("literal", s, None, None)
        if kind in ("integer", "decimal", "double"):
            self.next()
            return ("literal", text, XSD + kind, None)
        if kind == "word" and text in ("true", "false"):
            self.next()
            return ("literal", text, XSD + "boolean", None)
        if self.op("["):
            b = self.blank()
            if not self.op("]"):
                self.properties(b)
                self.need("]")
            return b
        if self.op("("):
            items = []
            while not self.op(")"):
                items.append(self.term())
            rest: Term = ("iri", RDF + "nil")
            for x in reversed(items):
                b = self.blank()
                self.triples += [(b, RDF + "first", x), (b, RDF + "rest", rest)]
                rest = b
            return rest
        self.fail("expected a term")


def read_turtle(text: str, base: str = "") -> list[tuple[Term, str, Term]]:
    """The triples of a Turtle document."""
    return Reader(text, base).read()
