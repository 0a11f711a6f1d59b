"""Text form of structured fields at the file boundary: names, numbers,
tuples ``(a,b)``, lists ``[a,b]`` and named tuples ``Name(a,b)``. Blanks are
accepted when read and never written."""

from __future__ import annotations

import re

_TOKEN = re.compile(r"\s*(?:(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)|([A-Za-z_]\w*)|([\[\](),]))")


class Named(tuple):
    """A tuple with a name: ``Glacier(-4)``."""

    def __new__(cls, name: str, items: tuple = ()):
        out = super().__new__(cls, items)
        out.name = name
        return out

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Named) and self.name == other.name and tuple(self) == tuple(other)

    def __hash__(self) -> int:
        return hash((self.name, tuple(self)))


def parse(text: str):
    tokens, pos = [], 0
    while pos < len(text.rstrip()):
        m = _TOKEN.match(text, pos)
        if not m:
            raise ValueError(f"unexpected text at {pos}: {text[pos:pos + 10]!r}")
        tokens.append(m.groups())
        pos = m.end()
    value, at = _value(tokens, 0)
    if at != len(tokens):
        raise ValueError(f"text goes on after the value: {text!r}")
    return value


def _items(tokens: list, at: int, end: str) -> tuple[list, int]:
    out = []
    while tokens[at][2] != end:
        value, at = _value(tokens, at)
        out.append(value)
        if tokens[at][2] == ",":
            at += 1
    return out, at + 1


def _value(tokens: list, at: int):
    number, name, mark = tokens[at]
    if number is not None:
        return (float(number) if re.search(r"[.eE]", number) else int(number)), at + 1
    if name is not None:
        if at + 1 < len(tokens) and tokens[at + 1][2] == "(":
            items, at = _items(tokens, at + 2, ")")
            return Named(name, tuple(items)), at
        return name, at + 1
    if mark == "[":
        return _items(tokens, at + 1, "]")
    if mark == "(":
        items, at = _items(tokens, at + 1, ")")
        return tuple(items), at
    raise ValueError(f"unexpected {mark!r}")


def dump(value) -> str:
    if isinstance(value, Named):
        return f"{value.name}({','.join(map(dump, value))})"
    if isinstance(value, tuple):
        return f"({','.join(map(dump, value))})"
    if isinstance(value, list):
        return f"[{','.join(map(dump, value))}]"
    if isinstance(value, float):
        return repr(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)
    return str(value)
