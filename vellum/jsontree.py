"""JSON trees of any depth: decoding and encoding that don't end where Python's recursion does.

The standard library does the work for documents of ordinary depth; those that are too deep
for it are read and written with a stack, up to :data:`MAX_DEPTH` levels.
"""

from __future__ import annotations

import json
import re

#: Levels of lists and objects at most; a deeper document counts as unreadable.
MAX_DEPTH = 10_000

_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = json.JSONDecoder()


def decode(text: str | None) -> object:
    """The value of a JSON text; ``ValueError`` if it is none, or nests deeper than ``MAX_DEPTH``."""
    if text is None:
        raise ValueError("no text")
    try:
        return json.loads(text)
    except RecursionError:
        return _decode_deep(text)


def _decode_deep(text: str) -> object:
    holders: list = []  # open lists and objects
    names: list = []  # of each the member whose value comes next
    at = _SPACE.match(text, 0).end()
    ready, value = False, None  # whether a whole value was read

    def fail():
        raise ValueError(f"not JSON at {at}")

    while True:
        if not ready:
            head = text[at : at + 1]
            if head and head in "[{":
                if len(holders) == MAX_DEPTH:
                    raise ValueError(f"deeper than {MAX_DEPTH} levels")
                holders.append([] if head == "[" else {})
                names.append(None)
                at = _SPACE.match(text, at + 1).end()
                if text[at : at + 1] == ("]" if head == "[" else "}"):
                    value, ready = holders.pop(), True
                    names.pop()
                    at = _SPACE.match(text, at + 1).end()
                elif head == "{":
                    at = _name(text, at, names, fail)
            else:
                value, at = _SCALAR.raw_decode(text, at)
                at, ready = _SPACE.match(text, at).end(), True
            continue
        if not holders:
            if at != len(text):
                fail()
            return value
        holder = holders[-1]
        if isinstance(holder, list):
            holder.append(value)
        else:
            holder[names[-1]] = value
        mark = text[at : at + 1]
        at = _SPACE.match(text, at + 1).end()
        if mark == ",":
            ready = False
            if isinstance(holder, dict):
                at = _name(text, at, names, fail)
        elif mark == ("]" if isinstance(holder, list) else "}"):
            value = holders.pop()
            names.pop()
        else:
            fail()


def _name(text: str, at: int, names: list, fail) -> int:
    if text[at : at + 1] != '"':
        fail()
    names[-1], at = _SCALAR.raw_decode(text, at)
    at = _SPACE.match(text, at).end()
    if text[at : at + 1] != ":":
        fail()
    return _SPACE.match(text, at + 1).end()


def encode(tree: object) -> str:
    """Compact JSON text of a tree, characters as they are."""
    try:
        return json.dumps(tree, ensure_ascii=False, separators=(",", ":"))
    except RecursionError:
        pass
    out: list[str] = []
    left: list = [("value", tree)]
    while left:
        kind, x = left.pop()
        if kind == "text":
            out.append(x)
        elif isinstance(x, dict) and x:
            left.append(("text", "}"))
            for n, (name, v) in enumerate(reversed(x.items())):
                left += [("value", v), ("text", ("," if n < len(x) - 1 else "{") + json.dumps(name, ensure_ascii=False) + ":")]
        elif isinstance(x, list) and x:
            left.append(("text", "]"))
            for n, v in enumerate(reversed(x)):
                left += [("value", v), ("text", "," if n < len(x) - 1 else "[")]
        else:
            out.append(json.dumps(x, ensure_ascii=False, separators=(",", ":")))
    return "".join(out)
