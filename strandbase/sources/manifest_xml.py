"""Manifests as element rows, from binary XML (the public resource chunk format) or from text XML."""

from __future__ import annotations

import struct
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field
from xml.sax.saxutils import quoteattr

#: The attribute namespace.
ANDROID = "http://schemas.android.com/apk/res/android"
_KINDS = {0x01: "Reference", 0x10: "Integer", 0x11: "Hex", 0x12: "Boolean"}


class ManifestError(ValueError):
    """Bytes that aren't a readable manifest."""


@dataclass
class Attribute:
    name: str
    raw_value: str | None
    kind: str
    s: str | None = None
    b: bool | None = None
    i: int | None = None

    def text(self) -> str:
        if self.kind == "String":
            return self.s or ""
        if self.kind == "Boolean":
            return "true" if self.b else "false"
        return {"Integer": f"{self.i}", "Hex": f"0x{self.i:x}", "Reference": f"@0x{self.i:08x}"}[self.kind]


@dataclass
class Element:
    tag: str
    attrs: list[Attribute] = field(default_factory=list)
    children: list[Element] = field(default_factory=list)


def _pool(data: bytes, at: int) -> list[str]:
    header, _, n, _, flags, start, _ = struct.unpack_from("<HIIIIII", data, at + 2)
    offsets = struct.unpack_from(f"<{n}I", data, at + header)
    out = []
    for o in offsets:
        p = at + start + o
        if flags & 0x100:
            for _ in range(2):  # the length in characters, then in bytes
                length = data[p]
                p += 1
                if length & 0x80:
                    length = (length & 0x7F) << 8 | data[p]
                    p += 1
            out.append(data[p : p + length].decode("utf-8", "replace"))
        else:
            (length,) = struct.unpack_from("<H", data, p)
            p += 2
            if length & 0x8000:
                length = (length & 0x7FFF) << 16 | struct.unpack_from("<H", data, p)[0]
                p += 2
            out.append(data[p : p + 2 * length].decode("utf-16-le", "replace"))
    return out


def _typed(name: str, raw: str | None, kind: int, value: int, strings: list[str]) -> Attribute:
    if kind == 0x03:
        return Attribute(name, raw, "String", s=strings[value])
    known = _KINDS.get(kind)
    if known == "Boolean":
        return Attribute(name, raw, known, b=value != 0)
    if known == "Integer":
        return Attribute(name, raw, known, i=struct.unpack("<i", struct.pack("<I", value))[0])
    return Attribute(name, raw, known or "Hex", i=value)


def parse_binary(data: bytes) -> Element:
    """The root of a binary manifest."""
    try:
        kind, header, size = struct.unpack_from("<HHI", data, 0)
        if kind != 0x0003:
            raise ManifestError("no binary XML header")
        at, strings, spaces, open_, root = header, [], {}, [], None
        while at + 8 <= min(size, len(data)):
            kind, header, chunk = struct.unpack_from("<HHI", data, at)
            if chunk < 8:
                raise ManifestError("empty chunk")
            if kind == 0x0001:
                strings = _pool(data, at)
            elif kind == 0x0100:
                prefix, uri = struct.unpack_from("<II", data, at + header)
                spaces[uri] = strings[prefix]
            elif kind == 0x0102:
                _, name, first, width, n = struct.unpack_from("<IIHHH", data, at + header)
                made = Element(strings[name])
                for i in range(n):
                    space, label, raw, _, _, value_kind, value = struct.unpack_from("<IIIHBBI", data, at + header + first + i * width)
                    full = f"{spaces.get(space, 'android')}:{strings[label]}" if space != 0xFFFFFFFF else strings[label]
                    made.attrs.append(_typed(full, None if raw == 0xFFFFFFFF else strings[raw], value_kind, value, strings))
                if open_:
                    open_[-1].children.append(made)
                elif root is None:
                    root = made
                open_.append(made)
            elif kind == 0x0103 and open_:
                open_.pop()
            at += chunk
    except (struct.error, IndexError) as e:
        raise ManifestError(f"broken binary XML: {e}") from e
    if root is None:
        raise ManifestError("no element")
    return root


def parse_text(xml: str) -> Element:
    """The root of a text manifest; all its attributes are strings."""
    try:
        top = ET.fromstring(xml)
    except ET.ParseError as e:
        raise ManifestError(f"broken XML: {e}") from e

    def made(e: ET.Element) -> Element:
        attrs = []
        for k, v in e.attrib.items():
            space, _, name = k.rpartition("}")
            label = name if not space else f"{'android' if space[1:] == ANDROID else space[1:]}:{name}"
            attrs.append(Attribute(label, v, "String", s=v))
        return Element(e.tag, attrs, [made(c) for c in e if isinstance(c.tag, str)])

    return made(top)


def parse(data: bytes) -> Element:
    return parse_text(data.decode("utf-8-sig")) if data.lstrip(b"\xef\xbb\xbf \t\r\n")[:1] == b"<" else parse_binary(data)


def rows(root: Element) -> list[dict]:
    """Element rows in document order, with ids counted from 0."""
    out: list[dict] = []
    todo: list[tuple[Element, int | None, int, int]] = [(root, None, 0, 0)]
    while todo:
        e, parent, place, depth = todo.pop()
        at = len(out)
        attrs = [vars(a) for a in e.attrs]
        out.append({"element_id": at, "parent_id": parent, "sibling_ord": place, "depth": depth, "tag": e.tag, "attrs": attrs})
        todo += [(c, at, i, depth + 1) for i, c in reversed(list(enumerate(e.children)))]
    return out


def to_xml(root: Element) -> str:
    """A manifest as indented XML."""

    def lines(e: Element, depth: int) -> list[str]:
        pad = "  " * depth
        space = f' xmlns:android="{ANDROID}"' if depth == 0 else ""
        attrs = "".join(f" {a.name}={quoteattr(a.text())}" for a in e.attrs)
        if not e.children:
            return [f"{pad}<{e.tag}{space}{attrs}/>"]
        return [f"{pad}<{e.tag}{space}{attrs}>", *(x for c in e.children for x in lines(c, depth + 1)), f"{pad}</{e.tag}>"]

    return "\n".join(['<?xml version="1.0" encoding="utf-8"?>', *lines(root, 0)])
