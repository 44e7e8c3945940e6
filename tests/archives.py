"""Writers of small class files, binary manifests and archives, for tests of the readers."""

import io
import struct
import zipfile


def uleb(n):
    out = b""
    while True:
        n, low = n >> 7, n & 0x7F
        out += bytes([low | (0x80 if n else 0)])
        if not n:
            return out


def dex(classes):
    """classes: {jni: [(name, args, ret, units or None, calls)]}; a call (class, name, args, ret) fills the unit that is None."""
    strings, types, protos, methods = set(), set(), set(), set()
    for jni, ms in classes.items():
        types.add(jni)
        for name, args, ret, _, calls in ms:
            for c, n, a, r in [(jni, name, args, ret), *calls]:
                types.update([c, r, *a])
                strings.add(n)
                protos.add((r, tuple(a)))
                methods.add((c, n, r, tuple(a)))
    strings |= types
    strings = sorted(strings)
    types, protos = sorted(types, key=strings.index), sorted(protos)
    methods = sorted(methods)
    head = 0x70
    at_types = head + 4 * len(strings)
    at_protos = at_types + 4 * len(types)
    at_methods = at_protos + 12 * len(protos)
    at_classes = at_methods + 8 * len(methods)
    base = at_classes + 32 * len(classes)
    data = b""

    def put(b, align=1):
        nonlocal data
        data += b"\0" * (-(base + len(data)) % align)
        at = base + len(data)
        data += b
        return at

    string_at = [put(uleb(len(s)) + s.encode() + b"\0") for s in strings]
    lists = {a: put(struct.pack(f"<I{len(a)}H", len(a), *(types.index(t) for t in a)), 4) if a else 0 for _, a in protos}
    defs = b""
    for jni, ms in classes.items():
        rows = []
        for name, args, ret, units, calls in ms:
            code = 0
            if units is not None:
                pending = iter(calls)
                filled = []
                for u in units:
                    if u is None:
                        c, n, a, r = next(pending)
                        u = methods.index((c, n, r, tuple(a)))
                    filled.append(u)
                debug = put(uleb(1) + uleb(len(args)) + b"".join(uleb(i % 2) for i in range(len(args))) + b"\x07\x0e\x00")
                code = put(struct.pack("<HHHHII", 4, 1, 1, 0, debug, len(filled)) + struct.pack(f"<{len(filled)}H", *filled), 4)
            rows.append((methods.index((jni, name, ret, tuple(args))), code))
        rows.sort()
        body, last = uleb(0) + uleb(0) + uleb(len(rows)) + uleb(0), 0
        for index, code in rows:
            body += uleb(index - last) + uleb(1) + uleb(code)
            last = index
        defs += struct.pack("<8I", types.index(jni), 1, 0xFFFFFFFF, 0, 0xFFFFFFFF, 0, put(body) if rows else 0, 0)
    ids = struct.pack(f"<{len(strings)}I", *string_at) + struct.pack(f"<{len(types)}I", *(strings.index(t) for t in types))
    ids += b"".join(struct.pack("<III", 0, types.index(r), lists[a]) for r, a in protos)
    ids += b"".join(struct.pack("<HHI", types.index(c), protos.index((r, a)), strings.index(n)) for c, n, r, a in methods)
    fields = [len(strings), head, len(types), at_types, len(protos), at_protos, 0, 0, len(methods), at_methods, len(classes), at_classes, len(data), base]
    return b"dex\n035\0" + b"\0" * 0x30 + struct.pack("<14I", *fields) + ids + defs + data


def binary_manifest(root, utf8=False):
    """root: (tag, [(name, kind, value)], [children]) with kind a resource value type, 3 being a string."""
    strings = ["android", "http://schemas.android.com/apk/res/android"]

    def index(s):
        if s not in strings:
            strings.append(s)
        return strings.index(s)

    def chunks(e):
        tag, attrs, children = e
        body = b""
        for name, kind, value in attrs:
            space = 1 if name.startswith("android:") else 0xFFFFFFFF
            raw = index(value) if kind == 3 else 0xFFFFFFFF
            body += struct.pack("<IIIHBBI", space, index(name.removeprefix("android:")), raw, 8, 0, kind, (raw if kind == 3 else value) & 0xFFFFFFFF)
        ext = struct.pack("<IIHHHHHH", 0xFFFFFFFF, index(tag), 20, 20, len(attrs), 0, 0, 0) + body
        out = struct.pack("<HHIII", 0x0102, 16, 16 + len(ext), 1, 0xFFFFFFFF) + ext
        out += b"".join(chunks(c) for c in children)
        return out + struct.pack("<HHIIIII", 0x0103, 16, 24, 1, 0xFFFFFFFF, 0xFFFFFFFF, index(tag))

    inner = struct.pack("<HHIIIII", 0x0100, 16, 24, 1, 0xFFFFFFFF, 0, 1) + chunks(root)
    offsets, text = [], b""
    for s in strings:
        offsets.append(len(text))
        if utf8:
            text += bytes([len(s), len(s.encode())]) + s.encode() + b"\0"
        else:
            text += struct.pack("<H", len(s)) + s.encode("utf-16-le") + b"\0\0"
    text += b"\0" * (-len(text) % 4)
    start = 28 + 4 * len(strings)
    pool = struct.pack("<HHIIIIII", 0x0001, 28, start + len(text), len(strings), 0, 0x100 if utf8 else 0, start, 0) + struct.pack(f"<{len(offsets)}I", *offsets) + text
    return struct.pack("<HHI", 0x0003, 8, 8 + len(pool) + len(inner)) + pool + inner


def apk(path, entries):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data)


def zipped(entries):
    held = io.BytesIO()
    apk(held, entries)
    return held.getvalue()
