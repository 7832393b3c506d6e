"""Values as lines of text and back: the kind of a set of examples says how each is written.

A kind is a small object that writes a value as lines and reads it from them. Programs read what is
written with `answer` off and print what is read with it on; the two differ for truth values and rows
of numbers.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

MOST_ITEMS = 1_000_000


class Lines:
    """Lines that are taken one by one."""

    def __init__(self, text: str):
        self.left = (text[:-1] if text.endswith("\n") else text).split("\n")[::-1]

    def take(self) -> str:
        if not self.left:
            raise ValueError("the text ends too early")
        return self.left.pop()

    def count(self) -> int:
        n = int(self.take())
        if not 0 <= n <= MOST_ITEMS:
            raise ValueError(f"{n} items")
        return n


def _number(word: str) -> int | float:
    return int(word) if word.lstrip("+-").isdigit() else float(word)


@dataclass(frozen=True)
class Number:
    def write(self, value, answer: bool) -> list[str]:
        return [str(value)]

    def read(self, lines: Lines, answer: bool):
        return _number(lines.take())


@dataclass(frozen=True)
class Truth:
    spelt = {True: ("False", "True"), False: ("0", "1")}

    def write(self, value, answer: bool) -> list[str]:
        return [self.spelt[answer][bool(value)]]

    def read(self, lines: Lines, answer: bool):
        return bool(self.spelt[answer].index(lines.take()))


@dataclass(frozen=True)
class Nothing:
    def write(self, value, answer: bool) -> list[str]:
        return ["None"]

    def read(self, lines: Lines, answer: bool):
        if lines.take() != "None":
            raise ValueError("not None")


@dataclass(frozen=True)
class Line:
    def write(self, value, answer: bool) -> list[str]:
        if "\n" in value:
            raise ValueError("more than one line")
        return [value]

    def read(self, lines: Lines, answer: bool):
        return lines.take()


@dataclass(frozen=True)
class Text:
    def write(self, value, answer: bool) -> list[str]:
        own = value.split("\n")
        return [str(len(own)), *own]

    def read(self, lines: Lines, answer: bool):
        return "\n".join(lines.take() for _ in range(lines.count()))


@dataclass(frozen=True)
class Numbers:
    def write(self, value, answer: bool) -> list[str]:
        row = " ".join(map(str, value))
        return [row] if answer else [str(len(value)), row]

    def read(self, lines: Lines, answer: bool):
        n = None if answer else lines.count()
        words = lines.take().split()
        if n not in (None, len(words)):
            raise ValueError(f"{len(words)} numbers, not {n}")
        return [_number(w) for w in words]


@dataclass(frozen=True)
class Many:
    item: object

    def write(self, value, answer: bool) -> list[str]:
        return [str(len(value)), *(x for v in value for x in self.item.write(v, answer))]

    def read(self, lines: Lines, answer: bool):
        return [self.item.read(lines, answer) for _ in range(lines.count())]


@dataclass(frozen=True)
class Row:
    items: tuple

    def write(self, value, answer: bool) -> list[str]:
        return [x for kind, v in zip(self.items, value, strict=True) for x in kind.write(v, answer)]

    def read(self, lines: Lines, answer: bool):
        return tuple(kind.read(lines, answer) for kind in self.items)


@dataclass(frozen=True)
class Pairs:
    key: object
    value: object

    def write(self, value, answer: bool) -> list[str]:
        return Many(Row((self.key, self.value))).write(list(value.items()), answer)

    def read(self, lines: Lines, answer: bool):
        return dict(Many(Row((self.key, self.value))).read(lines, answer))


@dataclass(frozen=True)
class Tagged:
    """A value whose type is written before it."""

    def kinds(self) -> dict[str, object]:
        one = Tagged()
        return {"int": Number(), "float": Number(), "str": Text(), "bool": Truth(), "none": Nothing(), "list": Many(one), "tuple": Many(one), "dict": Pairs(one, one)}

    def write(self, value, answer: bool) -> list[str]:
        tag = "none" if value is None else type(value).__name__
        return [tag, *self.kinds()[tag].write(value, answer)]

    def read(self, lines: Lines, answer: bool):
        tag = lines.take()
        found = self.kinds()[tag].read(lines, answer)
        return tuple(found) if tag == "tuple" else found


def infer(values: list, hint: str = "") -> object:
    """The kind that holds all examples. hint, an annotation, tells of what empty lists would be."""
    types = {type(v) for v in values}
    if types <= {type(None)}:
        return Nothing()
    if types <= {int, float}:
        return Number()
    if len(types) > 1:
        return Tagged()
    match values[0]:
        case bool():
            return Truth()
        case str():
            return Text() if any("\n" in v for v in values) else Line()
        case tuple():
            return Row(tuple(infer(list(column)) for column in zip(*values, strict=True))) if len({len(v) for v in values}) == 1 else Tagged()
        case list():
            every = [x for v in values for x in v]
            item = infer(every) if every else Line() if "str" in hint else Number()
            return Numbers() if item == Number() else Many(item)
        case dict():
            return Pairs(infer([k for v in values for k in v]), infer([x for v in values for x in v.values()]))
    raise ValueError(f"no kind for {types}")


def written(value, kind, answer: bool = False) -> str:
    return "\n".join(kind.write(value, answer)) + "\n"


def parsed_answer(text: str, kind):
    """The value that a program has printed; more than blank lines after it is an error."""
    lines = Lines(text)
    value = kind.read(lines, True)
    if any(x.strip() for x in lines.left):
        raise ValueError("more output than one value")
    return value


def round_trip(examples: str | None) -> str | None:
    """The first of some JSON examples as a program would read it, if all come back from both ways of writing; else null."""
    values = json.loads(examples or "[]")
    kind = infer(values)
    for answer in (False, True):
        for v in values:
            if (parsed_answer(written(v, kind, True), kind) if answer else kind.read(Lines(written(v, kind)), False)) != v:
                return None
    return written(values[0], kind) if values else ""
