"""DICOM files: a tree of elements in any uncompressed syntax; literals in text give way, padded to even length.

Read are explicit and implicit value kinds, little and big endian, sequences of defined and undefined length at any depth up to DEEPEST, and encapsulated
pixel data (as opaque fragments).  What is written has the lengths of enclosing items, sequences and groups made anew, and is otherwise
the file as it was, byte for byte.  Deflated data sets, other text than UTF-8, and literals where no text is refuse.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

from ..errors import Refused
from .formats import Matcher

# Fixed values of the format: value kinds with a long header, kinds that hold text, kinds of tags that files without kinds are read by.
LONG = {b"OB", b"OW", b"OF", b"OD", b"OL", b"OV", b"SQ", b"UC", b"UR", b"UT", b"UN", b"SV", b"UV"}
TEXT = {b"AE", b"AS", b"CS", b"DA", b"DS", b"DT", b"IS", b"LO", b"LT", b"PN", b"SH", b"ST", b"TM", b"UC", b"UI", b"UR", b"UT"}
KINDS = {(0x0008, 0x0020): b"DA", (0x0008, 0x0050): b"SH", (0x0008, 0x0080): b"LO", (0x0008, 0x0090): b"PN", (0x0008, 0x1030): b"LO", (0x0008, 0x103E): b"LO", (0x0010, 0x0010): b"PN", (0x0010, 0x0020): b"LO", (0x0010, 0x0030): b"DA", (0x0010, 0x1040): b"LO", (0x0010, 0x4000): b"LT", (0x0020, 0x4000): b"LT", (0x7FE0, 0x0010): b"OW"}
EXPLICIT_LITTLE, IMPLICIT_LITTLE, EXPLICIT_BIG, DEFLATED = b"1.2.840.10008.1.2.1", b"1.2.840.10008.1.2", b"1.2.840.10008.1.2.2", b"1.2.840.10008.1.2.1.99"
SYNTAX, PIXELS, ITEM, ITEM_END, SEQUENCE_END, UNDEFINED = (2, 0x10), (0x7FE0, 0x10), (0xFFFE, 0xE000), (0xFFFE, 0xE00D), (0xFFFE, 0xE0DD), 0xFFFFFFFF
#: Sequences within sequences.
DEEPEST = 64


@dataclass(frozen=True)
class Item:
    """An item of a sequence: elements, or the bytes of a fragment of pixels."""

    elements: tuple[Element, ...] | bytes
    undefined: bool = False


@dataclass(frozen=True)
class Element:
    group: int
    element: int
    vr: bytes
    value: bytes = b""
    items: tuple[Item, ...] | None = None
    undefined: bool = False


@dataclass(frozen=True)
class _Syntax:
    order: str
    explicit: bool


_META = _Syntax("little", True)


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, len(data)

    def take(self, n: int, end: int) -> bytes:
        if n < 0 or self.at + n > end:
            raise Refused("dicom-cut")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, n: int, order: str, end: int) -> int:
        return int.from_bytes(self.take(n, end), order)

    def element(self, s: _Syntax, end: int, depth: int) -> Element:
        group, number = self.number(2, s.order, end), self.number(2, s.order, end)
        if (group, number) in (ITEM, ITEM_END, SEQUENCE_END):
            raise Refused("dicom-syntax")
        if not s.explicit:
            vr, length = KINDS.get((group, number), b"UN"), self.number(4, s.order, end)
        else:
            vr = self.take(2, end)
            if not (vr.isalpha() and vr.isupper()):
                raise Refused("dicom-syntax")
            if vr in LONG:
                if self.take(2, end) != b"\0\0":
                    raise Refused("dicom-syntax")
                length = self.number(4, s.order, end)
            else:
                length = self.number(2, s.order, end)
        open_ = length == UNDEFINED
        if open_ and (group, number) == PIXELS:
            return Element(group, number, vr, items=self.items(s, end, depth + 1, True, None), undefined=True)
        if vr == b"SQ" or open_:
            inner = _Syntax("little", False) if s.explicit and vr == b"UN" else s
            return Element(group, number, vr, items=self.items(inner, end, depth + 1, False, None if open_ else self.limit(length, end)), undefined=open_)
        return Element(group, number, vr, self.take(length, end))

    def limit(self, length: int, end: int) -> int:
        if self.at + length > end:
            raise Refused("dicom-cut")
        return self.at + length

    def items(self, s: _Syntax, end: int, depth: int, fragments: bool, stop: int | None) -> tuple[Item, ...]:
        """Items up to a place, or to the mark that ends the sequence."""
        if depth > DEEPEST:
            raise Refused("dicom-depth")
        out: list[Item] = []
        bound = end if stop is None else stop
        while stop is None or self.at < stop:
            tag, length = (self.number(2, s.order, bound), self.number(2, s.order, bound)), self.number(4, s.order, bound)
            if tag == SEQUENCE_END and stop is None and length == 0:
                return tuple(out)
            if tag != ITEM:
                raise Refused("dicom-syntax")
            if fragments:
                out.append(Item(self.take(length, bound)))
                continue
            inner: list[Element] = []
            if length == UNDEFINED:
                while self.data[self.at : self.at + 4] != b"".join(x.to_bytes(2, s.order) for x in ITEM_END):
                    inner.append(self.element(s, bound, depth))
                self.take(4, bound)
                if self.number(4, s.order, bound):
                    raise Refused("dicom-syntax")
            else:
                last = self.limit(length, bound)
                while self.at < last:
                    inner.append(self.element(s, last, depth))
            out.append(Item(tuple(inner), length == UNDEFINED))
        return tuple(out)


def parsed(data: bytes) -> list[tuple[Element, _Syntax]]:
    """The file's elements in order, each with the syntax that it is written in."""
    if data[128:132] != b"DICM":
        raise Refused("dicom-preamble")
    r, syntax, out = _Reader(data), None, []
    r.at = 132
    name = EXPLICIT_LITTLE
    while r.at < r.end:
        if syntax is None and int.from_bytes(data[r.at : r.at + 2], "little") != 2:
            if name == DEFLATED:
                raise Refused("dicom-syntax")
            syntax = _Syntax("big" if name == EXPLICIT_BIG else "little", name != IMPLICIT_LITTLE)
        e = r.element(syntax or _META, r.end, 0)
        if (e.group, e.element) == SYNTAX:
            name = e.value.rstrip(b"\0 ")
        out.append((e, syntax or _META))
    return out


def elements(data: bytes) -> Iterator[Element]:
    """The file's elements in order, a sequence before those within it."""
    todo = [e for e, _ in reversed(parsed(data))]
    while todo:
        e = todo.pop()
        yield e
        for item in reversed(e.items or ()):
            if not isinstance(item.elements, bytes):
                todo += reversed(item.elements)


def written(e: Element, s: _Syntax = _META) -> bytes:
    tag = lambda t: b"".join(x.to_bytes(2, s.order) for x in t)
    size = lambda n: n.to_bytes(4, s.order)
    value = e.value
    if e.items is not None:
        inner = _Syntax("little", False) if s.explicit and e.vr == b"UN" else s
        parts = []
        for item in e.items:
            own = item.elements if isinstance(item.elements, bytes) else b"".join(written(x, inner) for x in item.elements)
            parts.append(tag(ITEM) + (size(UNDEFINED) + own + tag(ITEM_END) + size(0) if item.undefined else size(len(own)) + own))
        value = b"".join(parts) + (tag(SEQUENCE_END) + size(0) if e.undefined else b"")
    length = UNDEFINED if e.undefined else len(value)
    if not s.explicit:
        return tag((e.group, e.element)) + size(length) + value
    if e.vr not in LONG and length > 0xFFFF:
        raise Refused("dicom-length")
    return tag((e.group, e.element)) + e.vr + (b"\0\0" + size(length) if e.vr in LONG else length.to_bytes(2, s.order)) + value


def _replaced(e: Element, m: Matcher) -> tuple[Element, int]:
    if e.items is not None:
        items, n = [], 0
        for item in e.items:
            if isinstance(item.elements, bytes):
                if m.holds(item.elements.decode("latin-1")):
                    raise Refused("dicom-binary")
                items.append(item)
                continue
            both = [_replaced(x, m) for x in item.elements]
            n += sum(k for _, k in both)
            items.append(replace(item, elements=_grouped([x for x, _ in both], None)))
        return replace(e, items=tuple(items)), n
    if e.vr in TEXT:
        try:
            new, n = m.replace(e.value.decode("utf-8"))
        except UnicodeDecodeError:
            raise Refused("dicom-text") from None
        if not n:
            return e, 0
        raw = new.rstrip(" \0").encode()
        return replace(e, value=raw + (b"\0" if e.vr == b"UI" else b" ") * (len(raw) % 2)), n
    if m.holds(e.value.decode("latin-1")) or m.holds(e.value.decode("utf-8", "ignore")):
        raise Refused("dicom-binary")
    return e, 0


def _grouped(found: list[Element], syntaxes: list[_Syntax] | None) -> tuple[Element, ...]:
    """Elements with the lengths of their groups (element 0) made anew, where these stand and were right before."""
    out = list(found)
    for i, e in enumerate(out):
        if e.element == 0 and len(e.value) == 4 and syntaxes:
            n = sum(len(written(x, s)) for x, s in zip(out[i + 1 :], syntaxes[i + 1 :]) if x.group == e.group)
            out[i] = replace(e, value=n.to_bytes(4, syntaxes[i].order))
    return tuple(out)


def dicom_file(data: bytes, m: Matcher) -> tuple[bytes, int]:
    """(bytes, replacements)."""
    if m.holds(data[:128].decode("latin-1")):
        raise Refused("dicom-preamble")
    before = parsed(data)
    syntaxes = [s for _, s in before]
    both = [_replaced(e, m) for e, _ in before]
    total = sum(n for _, n in both)
    if not total:
        raise Refused("nothing-found")
    after = _grouped([e for e, _ in both], syntaxes)
    return data[:132] + b"".join(written(e, s) for e, s in zip(after, syntaxes)), total


def verified(data: bytes, m: Matcher) -> dict[str, int]:
    """Counts of what was looked at in a file that holds no literal, in text or bytes; refuses any other."""
    if m.holds(data.decode("latin-1")) or m.holds(data.decode("utf-8", "ignore")):
        raise Refused("dicom-literal-left")
    counts = {"text_elements": 0, "sequences": 0, "pixel_elements": 0, "private_elements": 0, "other_elements": 0}
    for e in elements(data):
        if e.vr in TEXT:
            if m.holds(e.value.decode("utf-8", "ignore")):
                raise Refused("dicom-literal-left")
            counts["text_elements"] += 1
        else:
            counts["pixel_elements" if (e.group, e.element) == PIXELS else "sequences" if e.items is not None else "private_elements" if e.group % 2 else "other_elements"] += 1
    return counts
