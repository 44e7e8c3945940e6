"""A reader of compiled class files (the public DEX format): classes, methods and their instruction sequences."""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

NO_INDEX = 0xFFFFFFFF
_WIDTHS = ["", "Wide", "Object", "Boolean", "Byte", "Char", "Short"]
_CALLS = ["Virtual", "Super", "Direct", "Static", "Interface"]
_TESTS = ["Eq", "Ne", "Lt", "Ge", "Gt", "Le"]
_INTEGER_OPS = ["Add", "Sub", "Mul", "Div", "Rem", "And", "Or", "Xor", "Shl", "Shr", "Ushr"]
#: The letters of primitive types.
PRIMITIVES = {"V": "void", "Z": "boolean", "B": "byte", "S": "short", "C": "char", "I": "int", "J": "long", "F": "float", "D": "double"}


class DexError(ValueError):
    """Bytes that aren't a readable class file."""


def _opcodes() -> dict[int, tuple[str, int]]:
    """Name and length in 16-bit units of every opcode, laid out group by group as in the format."""
    table: dict[int, tuple[str, int]] = {}

    def put(first: int, names: list[str], *lengths: int) -> None:
        for i, name in enumerate(names):
            table[first + i] = (name, lengths[i % len(lengths)])

    put(0x00, ["Nop"], 1)
    put(0x01, [f"Move{w}{form}" for w in _WIDTHS[:3] for form in ("", "From16", "16")], 1, 2, 3)
    put(0x0A, ["MoveResult", "MoveResultWide", "MoveResultObject", "MoveException", "ReturnVoid", "Return", "ReturnWide", "ReturnObject"], 1)
    put(0x12, ["Const4", "Const16", "Const", "ConstHigh16", "ConstWide16", "ConstWide32", "ConstWide", "ConstWideHigh16"], 1, 2, 3, 2, 2, 3, 5, 2)
    put(0x1A, ["ConstString", "ConstStringJumbo", "ConstClass", "MonitorEnter", "MonitorExit", "CheckCast", "InstanceOf", "ArrayLength"], 2, 3, 2, 1, 1, 2, 2, 1)
    put(0x22, ["NewInstance", "NewArray", "FilledNewArray", "FilledNewArrayRange", "FillArrayData", "Throw", "Goto", "Goto16", "Goto32"], 2, 2, 3, 3, 3, 1, 1, 2, 3)
    put(0x2B, ["PackedSwitch", "SparseSwitch"], 3)
    put(0x2D, ["CmplFloat", "CmpgFloat", "CmplDouble", "CmpgDouble", "CmpLong"], 2)
    put(0x32, [f"If{t}{z}" for z in ("", "z") for t in _TESTS], 2)
    put(0x44, [f"{place}{verb}{w}" for place in "AIS" for verb in ("Get", "Put") for w in _WIDTHS], 2)
    put(0x6E, [f"Invoke{c}" for c in _CALLS], 3)
    put(0x74, [f"Invoke{c}Range" for c in _CALLS], 3)
    put(0x7B, [f"{verb}{t}" for t, verbs in (("Int", ("Neg", "Not")), ("Long", ("Neg", "Not")), ("Float", ("Neg",)), ("Double", ("Neg",))) for verb in verbs], 1)
    wide = ["Int", "Long", "Float", "Double"]
    put(0x81, [f"{a}To{b}" for a in wide for b in wide if a != b] + [f"IntTo{b}" for b in ("Byte", "Char", "Short")], 1)
    binary = [f"{op}{t}" for t in ("Int", "Long") for op in _INTEGER_OPS] + [f"{op}{t}" for t in ("Float", "Double") for op in _INTEGER_OPS[:5]]
    put(0x90, binary, 2)
    put(0xB0, [f"{b}2Addr" for b in binary], 1)
    put(0xD0, ["RsubInt" if op == "Sub" else f"{op}IntLit16" for op in _INTEGER_OPS[:8]], 2)
    put(0xD8, [f"{'Rsub' if op == 'Sub' else op}IntLit8" for op in _INTEGER_OPS], 2)
    put(0xFA, ["InvokePolymorphic", "InvokePolymorphicRange", "InvokeCustom", "InvokeCustomRange", "ConstMethodHandle", "ConstMethodType"], 4, 4, 3, 3, 2, 2)
    return table


OPCODES = _opcodes()


@dataclass
class Op:
    kind: str
    opcode: str | None = None
    callee: tuple[str, str, str] | None = None


@dataclass
class Method:
    class_jni: str
    name: str
    args: list[str]
    ret: str
    n_named_params: int = 0
    ops: list[Op] = field(default_factory=list)

    @property
    def descriptor(self) -> str:
        return f"({''.join(self.args)}){self.ret}"


def java_type(descriptor: str) -> str:
    """``[Ljava/lang/String;`` becomes ``java.lang.String[]``."""
    inner = descriptor.lstrip("[")
    name = PRIMITIVES.get(inner) or inner.removeprefix("L").removesuffix(";").replace("/", ".")
    return name + "[]" * (len(descriptor) - len(inner))


def modified_utf8(data: bytes) -> str:
    """Decodes the format's text: zero as two bytes, characters beyond the first plane as two surrogates."""
    text = data.replace(b"\xc0\x80", b"\x00").decode("utf-8", "surrogatepass")
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


class Dex:
    """Random access over one class file."""

    def __init__(self, data: bytes):
        if len(data) < 0x70 or data[:4] != b"dex\n":
            raise DexError("no class file header")
        self.data = data
        head = struct.unpack_from("<14I", data, 0x38)
        (self.n_strings, self.strings_at, self.n_types, self.types_at, self.n_protos, self.protos_at, _, _, self.n_methods, self.methods_at, self.n_classes, self.classes_at, _, _) = head
        self._strings: dict[int, str] = {}
        self._methods: dict[int, tuple[str, str, list[str], str]] = {}

    def uleb(self, at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = self.data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value, at
            shift += 7

    def sleb(self, at: int) -> tuple[int, int]:
        start = at
        value, at = self.uleb(at)
        bits = 7 * (at - start)
        return (value - (1 << bits) if value >> (bits - 1) & 1 else value), at

    def string(self, i: int) -> str:
        if i not in self._strings:
            if i >= self.n_strings:
                raise DexError(f"string {i} out of range")
            (at,) = struct.unpack_from("<I", self.data, self.strings_at + 4 * i)
            _, at = self.uleb(at)
            self._strings[i] = modified_utf8(self.data[at : self.data.index(b"\0", at)])
        return self._strings[i]

    def type(self, i: int) -> str:
        return self.string(struct.unpack_from("<I", self.data, self.types_at + 4 * i)[0])

    def method(self, i: int) -> tuple[str, str, list[str], str]:
        """Class, name, argument types and result type of a method reference."""
        if i not in self._methods:
            if i >= self.n_methods:
                raise DexError(f"method {i} out of range")
            owner, proto, name = struct.unpack_from("<HHI", self.data, self.methods_at + 8 * i)
            _, ret, params = struct.unpack_from("<III", self.data, self.protos_at + 12 * proto)
            args = []
            if params:
                (n,) = struct.unpack_from("<I", self.data, params)
                args = [self.type(t) for t in struct.unpack_from(f"<{n}H", self.data, params + 4)]
            self._methods[i] = (self.type(owner), self.string(name), args, self.type(ret))
        return self._methods[i]

    def classes(self) -> Iterator[tuple[str, list[Method]]]:
        for i in range(self.n_classes):
            owner, _, _, _, _, _, at, _ = struct.unpack_from("<8I", self.data, self.classes_at + 32 * i)
            yield self.type(owner), self._class_methods(at) if at else []

    def _class_methods(self, at: int) -> list[Method]:
        counts = []
        for _ in range(4):
            n, at = self.uleb(at)
            counts.append(n)
        for _ in range(2 * (counts[0] + counts[1])):
            _, at = self.uleb(at)
        out = []
        for n in counts[2:]:
            index = 0
            for _ in range(n):
                step, at = self.uleb(at)
                _, at = self.uleb(at)
                code, at = self.uleb(at)
                index += step
                owner, name, args, ret = self.method(index)
                method = Method(owner, name, args, ret)
                if code:
                    self._body(code, method)
                out.append(method)
        return out

    def _debug(self, at: int) -> tuple[int, dict[int, list[str]]]:
        """The number of named parameters, and the markers (Line, Prologue, Epilogue) at each address."""
        marks: dict[int, list[str]] = defaultdict(list)
        _, at = self.uleb(at)
        n, at = self.uleb(at)
        named = 0
        for _ in range(n):
            index, at = self.uleb(at)
            named += index != 0
        address = 0
        while (code := self.data[at]) != 0:
            at += 1
            if code >= 0x0A:
                address += (code - 0x0A) // 15
                marks[address].append("Line")
            elif code == 1:
                step, at = self.uleb(at)
                address += step
            elif code == 2:
                _, at = self.sleb(at)
            elif code in (7, 8):
                marks[address].append("Prologue" if code == 7 else "Epilogue")
            else:
                for _ in range({3: 3, 4: 4, 5: 1, 6: 1, 9: 1}[code]):
                    _, at = self.uleb(at)
        return named, marks

    def _switch_targets(self, units: tuple[int, ...], at: int, base: int) -> list[int]:
        if at >= len(units) or units[at] not in (0x0100, 0x0200):
            return []
        n = units[at + 1]
        first = at + (4 if units[at] == 0x0100 else 2 + 2 * n)
        pairs = [(units[first + 2 * i], units[first + 2 * i + 1]) for i in range(n)]
        return [base + struct.unpack("<i", struct.pack("<HH", *p))[0] for p in pairs]

    def _body(self, at: int, method: Method) -> None:
        _, _, _, n_tries, debug, size = struct.unpack_from("<HHHHII", self.data, at)
        units = struct.unpack_from(f"<{size}H", self.data, at + 16)
        marks: dict[int, list[str]] = {}
        if debug:
            method.n_named_params, marks = self._debug(debug)
        found: list[tuple[int, Op]] = []
        labels: set[int] = set()
        pc = 0
        while pc < size:
            code = units[pc] & 0xFF
            if code == 0 and units[pc] in (0x0100, 0x0200, 0x0300):  # payload of a switch or an array
                n = units[pc + 1]
                wide = units[pc + 2] | units[pc + 3] << 16 if units[pc] == 0x0300 else 0
                pc += {0x0100: 4 + 2 * n, 0x0200: 2 + 4 * n, 0x0300: 4 + (n * wide + 1) // 2}[units[pc]]
                continue
            if code not in OPCODES:
                raise DexError(f"unknown opcode {code:#x}")
            name, length = OPCODES[code]
            op = Op("Op", name)
            if name.startswith("Invoke") and not name.startswith("InvokeCustom"):
                owner, called, args, ret = self.method(units[pc + 1])
                op.callee = (owner, called, f"({''.join(args)}){ret}")
            signed = lambda i: struct.unpack("<h", struct.pack("<H", units[i]))[0]
            if name == "Goto":
                labels.add(pc + struct.unpack("<b", bytes([units[pc] >> 8]))[0])
            elif name == "Goto16":
                labels.add(pc + signed(pc + 1))
            elif name.startswith("If"):
                labels.add(pc + signed(pc + 1))
            elif name in ("Goto32", "PackedSwitch", "SparseSwitch"):
                target = pc + struct.unpack("<i", struct.pack("<HH", units[pc + 1], units[pc + 2]))[0]
                labels.update(self._switch_targets(units, target, pc) if "Switch" in name else [target])
            found.append((pc, op))
            pc += length
        catches: dict[int, int] = {}
        if n_tries:
            tries = at + 16 + 2 * size + (2 if size % 2 else 0)
            handlers = tries + 8 * n_tries
            for i in range(n_tries):
                start, count, offset = struct.unpack_from("<IHH", self.data, tries + 8 * i)
                labels.add(start)
                n, h = self.sleb(handlers + offset)
                for _ in range(abs(n)):
                    _, h = self.uleb(h)
                    target, h = self.uleb(h)
                    labels.add(target)
                if n <= 0:
                    target, h = self.uleb(h)
                    labels.add(target)
                catches[start + count] = catches.get(start + count, 0) + abs(n) + (n <= 0)
        for pc, op in [*found, (size, None)]:
            method.ops += [Op("Catch")] * catches.get(pc, 0)
            if pc in labels:
                method.ops.append(Op("Label"))
            if op is not None:
                method.ops += [Op(m) for m in marks.get(pc, ())]
                method.ops.append(op)


def smali_text(method: Method) -> str:
    """A readable listing of a method, one line for each element."""
    lines = [f".method {method.name}{method.descriptor}"]
    for op in method.ops:
        shown = op.opcode or f".{op.kind.lower()}"
        lines.append(f"    {shown}" + (f" {op.callee[0]}->{op.callee[1]}{op.callee[2]}" if op.callee else ""))
    return "\n".join([*lines, ".end method", ""])
