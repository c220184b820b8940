"""IRI and literal templates: text with {COLUMN} placeholders."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import unquote

_RESERVED = set(":/?#[]@!$&'()*+,;=% ")


@dataclass(frozen=True)
class Template:
    """texts[0] {columns[0]} texts[1] ... texts[-1]"""

    texts: tuple[str, ...]
    columns: tuple[str, ...]

    @classmethod
    def parse(cls, source: str) -> Template:
        """Of R2RML's syntax; \\{ and \\} stand for braces."""
        texts, columns, now, i = [], [], "", 0
        while i < len(source):
            c = source[i]
            if c == "\\" and i + 1 < len(source) and source[i + 1] in "{}\\":
                now, i = now + source[i + 1], i + 2
            elif c == "{":
                end = source.find("}", i)
                if end < 0:
                    raise ValueError(f"unmatched {{ in template {source!r}")
                texts.append(now)
                columns.append(source[i + 1 : end].strip('"'))
                now, i = "", end + 1
            else:
                now, i = now + c, i + 1
        return cls((*texts, now), tuple(columns))

    def fill(self, values: list[str]) -> str:
        return self.texts[0] + "".join(v + t for v, t in zip(values, self.texts[1:]))

    def invertible(self, integral: bool = False) -> bool:
        """Texts tell the values apart: one placeholder at most, or between any two a reserved character (which encoding
        takes out of values), or, for whole numbers, anything but digits and a minus."""
        inner = self.texts[1:-1]
        return all(t and (set(t) & _RESERVED or integral and not set(t) & set("0123456789-")) for t in inner)

    def invert(self, text: str, encoded: bool = True) -> list[str] | None:
        """The values that make this text, or None. Only for invertible templates."""
        value = "([^/?#\\[\\]@!$&'()*+,;= :]*)" if encoded and len(self.columns) > 1 else "(.*)"
        m = re.fullmatch(re.escape(self.texts[0]) + "".join(value + re.escape(t) for t in self.texts[1:]), text, re.S)
        if not m:
            return None
        if not encoded:
            return list(m.groups())
        out = [unquote(g, errors="strict") for g in m.groups()] if all(_sound(g) for g in m.groups()) else None
        return out

    def can_meet(self, other: Template) -> bool:
        """False if no text can come from both."""
        a, b = self.texts[0], other.texts[0]
        if not (a.startswith(b) or b.startswith(a)):
            return False
        a, b = self.texts[-1], other.texts[-1]
        return a.endswith(b) or b.endswith(a)

    def can_be(self, text: str) -> bool:
        return len(text) >= sum(map(len, self.texts)) and text.startswith(self.texts[0]) and text.endswith(self.texts[-1])


def _sound(g: str) -> bool:
    """Only unreserved characters and percent escapes: what encoding leaves."""
    return bool(re.fullmatch(r"(?:[A-Za-z0-9\-_.~]|%[0-9A-F]{2})*", g))
