"""A reader of JVM class files, from the published file format; plain Python, no Spark."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

ACC_PUBLIC, ACC_PRIVATE, ACC_STATIC = 0x0001, 0x0002, 0x0008
ACC_INTERFACE, ACC_SYNTHETIC, ACC_ANNOTATION, ACC_ENUM, ACC_BRIDGE = 0x0200, 0x1000, 0x2000, 0x4000, 0x0040

#: Operand bytes of instructions that have any, apart from the switches and wide (fixed by the format).
_OPERANDS = {0x10: 1, 0x11: 2, 0x12: 1, 0x13: 2, 0x14: 2, 0x84: 2, 0xA9: 1, 0xB9: 4, 0xBA: 4, 0xBB: 2, 0xBC: 1, 0xBD: 2, 0xC0: 2, 0xC1: 2, 0xC5: 3, 0xC6: 2, 0xC7: 2, 0xC8: 4, 0xC9: 4}
_OPERANDS |= dict.fromkeys([*range(0x15, 0x1A), *range(0x36, 0x3B)], 1) | dict.fromkeys([*range(0x99, 0xA9), *range(0xB2, 0xB9)], 2)


@dataclass
class Instruction:
    at: int
    op: int
    args: bytes
    wide: bool = False
    targets: tuple[int, ...] = ()

    @property
    def index(self) -> int:
        """The operand as an unsigned index."""
        return int.from_bytes(self.args[: 2 if len(self.args) >= 2 else 1], "big")


@dataclass
class Method:
    name: str
    descriptor: str
    access: int
    annotations: list[str] = field(default_factory=list)
    code: bytes | None = None
    max_locals: int = 0
    handlers: list[tuple[int, int, int]] = field(default_factory=list)
    first_line: int = 0


@dataclass
class ClassFile:
    name: str
    super_name: str | None
    interfaces: list[str]
    access: int
    pool: list
    fields: list[tuple[str, str, int]]
    methods: list[Method]
    annotations: list[str]
    bootstraps: list[list[int]]

    def ref(self, index: int) -> tuple[str, str, str]:
        """Owner, name and descriptor of a field or method reference; dynamic call sites have no owner."""
        entry = self.pool[index]
        name, descriptor = self.pool[entry[2]][1:]
        owner = "" if entry[0] in (17, 18) else self.text(self.pool[entry[1]][1])
        return owner, self.text(name), self.text(descriptor)

    def text(self, index: int) -> str:
        return self.pool[index][1]

    def class_name(self, index: int) -> str:
        return self.text(self.pool[index][1])

    def handles(self, call_site: int) -> list[tuple[str, str, str]]:
        """Methods named by the method handles among a dynamic call site's bootstrap arguments."""
        if self.pool[call_site][1] >= len(self.bootstraps):
            return []
        found = [self.pool[a] for a in self.bootstraps[self.pool[call_site][1]]]
        return [self.ref(e[2]) for e in found if e[0] == 15 and e[1] >= 5]


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, kind: str) -> int:
        value = struct.unpack_from(f">{kind}", self.data, self.at)[0]
        self.at += struct.calcsize(kind)
        return value

    def raw(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("the class file ends early")
        self.at += n
        return self.data[self.at - n : self.at]


def modified_utf8(data: bytes) -> str:
    """NUL as two bytes and surrogate pairs as two units of three bytes, as class files store text."""
    try:
        return data.replace(b"\xc0\x80", b"\0").decode("utf-8", "surrogatepass").encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    except UnicodeDecodeError:
        return data.decode("utf-8", "replace")


def _pool(r: _Reader) -> list:
    n, pool = r.take("H"), [None]
    while len(pool) < n:
        tag = r.take("B")
        if tag == 1:
            pool.append((1, modified_utf8(r.raw(r.take("H")))))
        elif tag in (3, 4):
            pool.append((tag, r.raw(4)))
        elif tag in (5, 6):
            pool += [(tag, r.raw(8)), None]
        elif tag in (7, 8, 16, 19, 20):
            pool.append((tag, r.take("H")))
        elif tag in (9, 10, 11, 12, 17, 18):
            pool.append((tag, r.take("H"), r.take("H")))
        elif tag == 15:
            pool.append((tag, r.take("B"), r.take("H")))
        else:
            raise ValueError(f"constant of unknown kind {tag}")
    return pool


def internal_name(data: bytes) -> str:
    """A class's own name, from the constant pool alone; ValueError if there is none."""
    r = _Reader(data)
    try:
        if r.take("I") != 0xCAFEBABE:
            raise ValueError("not a class file")
        r.raw(4)
        pool = _pool(r)
        r.raw(2)
        return pool[pool[r.take("H")][1]][1]
    except (struct.error, IndexError, TypeError) as e:
        raise ValueError("the class file ends early") from e


def _attributes(r: _Reader, pool: list) -> list[tuple[str, bytes]]:
    return [(pool[r.take("H")][1], r.raw(r.take("I"))) for _ in range(r.take("H"))]


def _annotations(attributes: list[tuple[str, bytes]], pool: list) -> list[str]:
    """Type descriptors of the annotations; element values are stepped over."""
    out = []
    for name, data in attributes:
        if name in ("RuntimeVisibleAnnotations", "RuntimeInvisibleAnnotations"):
            r = _Reader(data)
            out += [_annotation(r, pool) for _ in range(r.take("H"))]
    return out


def _annotation(r: _Reader, pool: list) -> str:
    kind = pool[r.take("H")][1]
    for _ in range(r.take("H")):
        r.take("H")
        _value(r, pool)
    return kind


def _value(r: _Reader, pool: list) -> None:
    tag = chr(r.take("B"))
    if tag == "e":
        r.raw(4)
    elif tag == "@":
        _annotation(r, pool)
    elif tag == "[":
        for _ in range(r.take("H")):
            _value(r, pool)
    else:
        r.raw(2)


def _method(r: _Reader, pool: list) -> Method:
    access, name, descriptor = r.take("H"), pool[r.take("H")][1], pool[r.take("H")][1]
    attributes = _attributes(r, pool)
    m = Method(name, descriptor, access, _annotations(attributes, pool))
    for kind, data in attributes:
        if kind == "Code":
            c = _Reader(data)
            c.take("H")
            m.max_locals = c.take("H")
            m.code = c.raw(c.take("I"))
            m.handlers = [(c.take("H"), c.take("H"), c.take("H"), c.take("H"))[:3] for _ in range(c.take("H"))]
            for inner, table in _attributes(c, pool):
                if inner == "LineNumberTable" and not m.first_line:
                    t = _Reader(table)
                    if t.take("H"):
                        t.take("H")
                        m.first_line = t.take("H")
    return m


def read_class(data: bytes) -> ClassFile:
    """Parse a class file; ValueError or another exception if it is not one."""
    r = _Reader(data)
    if r.take("I") != 0xCAFEBABE:
        raise ValueError("not a class file")
    r.take("I")
    pool = _pool(r)
    name_of = lambda i: pool[pool[i][1]][1] if i else None
    access, this, parent = r.take("H"), name_of(r.take("H")), name_of(r.take("H"))
    interfaces = [name_of(r.take("H")) for _ in range(r.take("H"))]
    fields = []
    for _ in range(r.take("H")):
        f = (r.take("H"), pool[r.take("H")][1], pool[r.take("H")][1])
        _attributes(r, pool)
        fields.append((f[1], f[2], f[0]))
    methods = [_method(r, pool) for _ in range(r.take("H"))]
    attributes = _attributes(r, pool)
    bootstraps = []
    for kind, table in attributes:
        if kind == "BootstrapMethods":
            b = _Reader(table)
            for _ in range(b.take("H")):
                b.take("H")
                bootstraps.append([b.take("H") for _ in range(b.take("H"))])
    return ClassFile(this, parent, interfaces, access, pool, fields, methods, _annotations(attributes, pool), bootstraps)


def instructions(code: bytes) -> list[Instruction]:
    """The instructions of a method body, with jump targets as absolute positions."""
    out, at = [], 0
    while at < len(code):
        op, start = code[at], at
        if op in (0xAA, 0xAB):
            p = (at + 4) & ~3
            default, a = struct.unpack_from(">ii", code, p)
            if op == 0xAA:
                n = struct.unpack_from(">i", code, p + 8)[0] - a + 1
                jumps = struct.unpack_from(f">{n}i", code, p + 12)
                at = p + 12 + 4 * n
            else:
                jumps = struct.unpack_from(f">{2 * a}i", code, p + 8)[1::2]
                at = p + 8 + 8 * a
            out.append(Instruction(start, op, b"", targets=tuple(start + j for j in (default, *jumps))))
            continue
        if op == 0xC4:
            n = 5 if code[at + 1] == 0x84 else 3
            out.append(Instruction(start, code[at + 1], code[at + 2 : at + 1 + n], wide=True))
            at += 1 + n
            continue
        n = _OPERANDS.get(op, 0)
        args = code[at + 1 : at + 1 + n]
        targets: tuple[int, ...] = ()
        if 0x99 <= op <= 0xA8 or op in (0xC6, 0xC7):
            targets = (start + struct.unpack(">h", args)[0],)
        elif op in (0xC8, 0xC9):
            targets = (start + struct.unpack(">i", args)[0],)
        out.append(Instruction(start, op, args, targets=targets))
        at += 1 + n
    return out


def descriptor_types(descriptor: str) -> tuple[list[str], str]:
    """Parameter types and return type of a method descriptor; malformed: no parameters, void."""
    out, i = [], 1
    if not descriptor.startswith("("):
        return [], "V"
    while i < len(descriptor) and descriptor[i] != ")":
        start = i
        while i < len(descriptor) and descriptor[i] == "[":
            i += 1
        if i >= len(descriptor):
            return [], "V"
        if descriptor[i] == "L":
            i = descriptor.find(";", i)
            if i < 0:
                return [], "V"
        elif descriptor[i] not in "BCDFIJSZ":
            return [], "V"
        i += 1
        out.append(descriptor[start:i])
    return out, descriptor[i + 1 :] or "V"


def slots(kind: str) -> int:
    return 0 if kind == "V" else 2 if kind in ("J", "D") else 1


def graph_rows(cls: ClassFile, path: str) -> tuple[list[dict], list[dict]]:
    """Node and edge rows of a class, its fields, methods and calls."""
    kind = "annotation" if cls.access & ACC_ANNOTATION else "interface" if cls.access & ACC_INTERFACE else "enum" if cls.access & ACC_ENUM else "class"
    me = f"C:{cls.name}"
    made = lambda access: int(bool(access & (ACC_SYNTHETIC | ACC_BRIDGE)))

    def node(id_, kind, name, owner, descriptor, line, access, synthetic, annotations):
        return {"id": id_, "kind": kind, "name": name, "owner": owner, "descriptor": descriptor, "file_path": path, "start_line": line, "end_line": 0, "synthetic": synthetic, "access": access, "annotations": annotations, "class_annotations": cls.annotations}

    nodes = [node(me, kind, cls.name.rpartition("/")[2].rpartition("$")[2], None, None, 0, cls.access, made(cls.access), cls.annotations)]
    edges: dict[tuple[str, str, str], str] = {}
    link = lambda s, t, k, how: edges.setdefault((s, t, k), how)
    if cls.super_name and cls.super_name != "java/lang/Object":
        link(me, f"C:{cls.super_name}", "extends", "bytecode")
    for i in cls.interfaces:
        link(me, f"C:{i}", "implements", "bytecode")
    for name, descriptor, access in cls.fields:
        synthetic = made(access) or int(name.startswith(("val$", "this$")))
        nodes.append(node(f"F:{cls.name}#{name}", "field", name, cls.name, descriptor, 0, access, synthetic, []))
        link(me, f"F:{cls.name}#{name}", "contains", "bytecode")
    for m in cls.methods:
        id_ = f"M:{cls.name}#{m.name}{m.descriptor}"
        nodes.append(node(id_, "method", m.name, cls.name, m.descriptor, m.first_line, m.access, made(m.access) or int(m.name.startswith("access$")), m.annotations))
        link(me, id_, "contains", "bytecode")
        for ins in instructions(m.code or b""):
            if 0xB6 <= ins.op <= 0xB9:
                owner, name, descriptor = cls.ref(ins.index)
                link(id_, f"M:{owner}#{name}{descriptor}", "calls", "bytecode")
            elif ins.op == 0xBA:
                for owner, name, descriptor in cls.handles(ins.index):
                    link(id_, f"M:{owner}#{name}{descriptor}", "calls", "indy")
    return nodes, [{"source": s, "target": t, "kind": k, "line": 0, "origin": "bytecode", "provenance": p} for (s, t, k), p in edges.items()]
