"""A light scanner of Java sources: types, members, imports and call expressions; plain Python.

It covers declarations and calls, not the whole grammar.  Calls in lambdas and anonymous classes count for
the method around them; field initialisers are not scanned.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.names import LANG_TYPES

_TOKEN = re.compile(r'//[^\n]*|/\*.*?\*/|"""(?:\\.|.)*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|[A-Za-z_$][\w$]*|\d[\w.]*|\.\.\.|->|::|\S', re.S)
_MODIFIERS = {"public", "private", "protected", "static", "final", "abstract", "native", "synchronized", "transient", "volatile", "strictfp", "default", "sealed"}
_PRIMITIVES = {"byte": "B", "char": "C", "double": "D", "float": "F", "int": "I", "long": "J", "short": "S", "boolean": "Z", "void": "V"}
_NOT_CALLS = {"if", "for", "while", "switch", "catch", "synchronized", "return", "super", "this", "try", "assert", "throw", "new", "else", "do"}
_ACCESS = {"public": 1, "private": 2, "protected": 4, "static": 8}


@dataclass
class Unit:
    package: str = ""
    imports: dict[str, str] = field(default_factory=dict)
    nodes: list[dict] = field(default_factory=list)
    edges: dict[tuple[str, str, str], dict] = field(default_factory=dict)
    methods: list[tuple[str, str, str]] = field(default_factory=list)
    bodies: list[tuple[str, str, list]] = field(default_factory=list)


def internal_name(written: str, unit: Unit) -> str:
    plain = re.sub(r"<.*>", "", written, flags=re.S).strip()
    if "." in plain:
        return plain.replace(".", "/")
    if plain in unit.imports:
        return unit.imports[plain]
    if plain in LANG_TYPES:
        return f"java/lang/{plain}"
    if re.fullmatch("[A-Z]", plain):
        return "java/lang/Object"
    return f"{unit.package}/{plain}" if unit.package else plain


def descriptor_of(written: str, unit: Unit) -> str:
    dims = written.count("[]") + written.count("...")
    plain = re.sub(r"<.*>", "", written.replace("[]", "").replace("...", ""), flags=re.S).strip()
    return "[" * dims + (_PRIMITIVES.get(plain) or f"L{internal_name(plain, unit)};")


class _Scanner:
    def __init__(self, text: str, path: str) -> None:
        self.unit, self.path = Unit(), path
        self.tokens: list[tuple[str, int]] = []
        line, last = 1, 0
        for m in _TOKEN.finditer(text):
            line += text.count("\n", last, m.start())
            last = m.start()
            if not m[0].startswith(("//", "/*")):
                self.tokens.append((m[0], line))

    def word(self, i: int) -> str:
        return self.tokens[i][0] if i < len(self.tokens) else ""

    def closing(self, i: int, a: str, b: str) -> int:
        """Position of the token that closes the one at i."""
        depth = 0
        while i < len(self.tokens):
            depth += (self.word(i) == a) - (self.word(i) == b)
            if not depth:
                return i
            i += 1
        raise ValueError(f"{a} without {b}")

    def dotted(self, i: int) -> tuple[str, int]:
        out = self.word(i)
        while self.word(i + 1) == "." and i + 2 < len(self.tokens):
            out += "." + self.word(i + 2)
            i += 2
        return out, i + 1

    def type_at(self, i: int) -> tuple[str, int] | None:
        if not re.match(r"[A-Za-z_$]", self.word(i)):
            return None
        out, i = self.dotted(i)
        if self.word(i) == "<":
            i = self.closing(i, "<", ">") + 1
        while self.word(i) == "[" and self.word(i + 1) == "]":
            out, i = out + "[]", i + 2
        if self.word(i) == "...":
            out, i = out + "...", i + 1
        return out, i

    def scan(self) -> Unit:
        i = 0
        while i < len(self.tokens):
            w = self.word(i)
            if w == "package":
                name, i = self.dotted(i + 1)
                self.unit.package = name.replace(".", "/")
            elif w == "import":
                i += 1 + (self.word(i + 1) == "static")
                name, i = self.dotted(i)
                self.unit.imports[name.rpartition(".")[2]] = name.replace(".", "/")
            else:
                i = self.member(i, None, "")
        return self.unit

    def member(self, i: int, owner: str | None, simple: str) -> int:
        """Scan one declaration at i; returns the position after it."""
        access, notes = 0, []
        while True:
            w = self.word(i)
            if w == "@" and self.word(i + 1) != "interface":
                name, i = self.dotted(i + 1)
                notes.append(f"L{internal_name(name, self.unit)};")
                if self.word(i) == "(":
                    i = self.closing(i, "(", ")") + 1
            elif w in _MODIFIERS:
                access |= _ACCESS.get(w, 0)
                i += 1
            elif w == "<":
                i = self.closing(i, "<", ">") + 1
            else:
                break
        w, line = self.word(i), self.tokens[i][1] if i < len(self.tokens) else 0
        if w == "@" or w in ("class", "interface", "enum", "record"):
            return self.type(i + (w == "@"), owner, access, notes)
        if w == "{":
            return self.closing(i, "{", "}") + 1
        if owner is None or not w or w in (";", ",", "}"):
            return i + 1
        start = i
        if w == simple and self.word(i + 1) == "(":
            name, kind, i = "<init>", "V", i + 1
        else:
            found = self.type_at(i)
            if not found:
                return i + 1
            written, i = found
            name, kind = self.word(i), descriptor_of(written, self.unit)
            i += 1
        if self.word(i) != "(":
            return self.fields(start, i, owner, kind, access)
        end = self.closing(i, "(", ")")
        descriptor = f"({''.join(self.parameters(i + 1, end))}){kind}"
        i = end + 1
        while i < len(self.tokens) and self.word(i) not in ("{", ";"):
            i += 1
        close = self.closing(i, "{", "}") if self.word(i) == "{" else i
        id_ = f"M:{owner}#{name}{descriptor}"
        self.add(id_, "method", name, owner, descriptor, line, self.tokens[min(close, len(self.tokens) - 1)][1], access, notes)
        self.unit.methods.append((owner, name, descriptor))
        self.unit.bodies.append((id_, owner, self.tokens[i + 1 : close]))
        return close + 1

    def parameters(self, i: int, end: int) -> list[str]:
        out = []
        while i < end:
            while self.word(i) in ("final", "@"):
                i = i + 1 if self.word(i) == "final" else self.dotted(i + 1)[1]
                if self.word(i) == "(":
                    i = self.closing(i, "(", ")") + 1
            found = self.type_at(i)
            if not found:
                break
            out.append(descriptor_of(found[0], self.unit))
            i = found[1]
            while i < end and self.word(i) != ",":
                i += 1
            i += 1
        return out

    def fields(self, start: int, i: int, owner: str, kind: str, access: int) -> int:
        line = self.tokens[start][1]
        while True:
            name = self.word(i - 1)
            self.add(f"F:{owner}#{name}", "field", name, owner, kind, line, line, access, [])
            while i < len(self.tokens) and self.word(i) not in (";", ","):
                i = self.closing(i, self.word(i), {"(": ")", "{": "}", "[": "]"}[self.word(i)]) + 1 if self.word(i) in "({[" and self.word(i) else i + 1
            if self.word(i) != ",":
                return i + 1
            i += 2

    def type(self, i: int, owner: str | None, access: int, notes: list[str]) -> int:
        word, line = self.word(i), self.tokens[i][1]
        simple = self.word(i + 1)
        internal = f"{owner}${simple}" if owner else f"{self.unit.package}/{simple}" if self.unit.package else simple
        kind = "annotation" if self.word(i - 1) == "@" else {"record": "class"}.get(word, word)
        self.notes = notes
        i, how = i + 2, None
        supers = []
        while i < len(self.tokens) and self.word(i) != "{":
            if self.word(i) in ("extends", "implements", "permits"):
                how, i = self.word(i), i + 1
            elif self.word(i) == "<":
                i = self.closing(i, "<", ">") + 1
            elif self.word(i) == "(":
                i = self.closing(i, "(", ")") + 1
            elif how in ("extends", "implements") and (found := self.type_at(i)):
                supers.append((how, internal_name(found[0], self.unit)))
                i = found[1]
            else:
                i += 1
        close = self.closing(i, "{", "}")
        self.add(f"C:{internal}", kind, simple, None, None, line, self.tokens[close][1], access, notes)
        for how, target in supers:
            self.edge(f"C:{internal}", f"C:{target}", how, line, "source-name")
        i += 1
        if word == "enum":
            while i < close and self.word(i) != ";":
                i = self.closing(i, self.word(i), ")" if self.word(i) == "(" else "}") + 1 if self.word(i) in ("(", "{") else i + 1
        held = notes
        while i < close:
            self.notes = held
            i = self.member(i, internal, simple)
        return close + 1

    def add(self, id_, kind, name, owner, descriptor, line, end, access, notes) -> None:
        self.unit.nodes.append({"id": id_, "kind": kind, "name": name, "owner": owner, "descriptor": descriptor, "file_path": self.path, "start_line": line, "end_line": end, "synthetic": 0, "access": access, "annotations": notes, "class_annotations": self.notes})
        if owner:
            self.edge(f"C:{owner}", id_, "contains", line, "source")

    def edge(self, source: str, target: str, kind: str, line: int, how: str) -> None:
        self.unit.edges.setdefault((source, target, kind), {"source": source, "target": target, "kind": kind, "line": line, "origin": "source", "provenance": how})


def _arguments(tokens: list, i: int) -> tuple[int, int]:
    """Number of arguments in the parentheses at i, and the position after them."""
    depth, n, any_ = 0, 0, False
    while i < len(tokens):
        w = tokens[i][0]
        if w in ("(", "{", "["):
            any_ |= depth > 0
            depth += 1
        elif w in (")", "}", "]"):
            depth -= 1
            if not depth:
                return n + any_, i + 1
        elif w == "," and depth == 1:
            n += 1
        else:
            any_ = True
        i += 1
    return n + any_, i


def calls(unit: Unit) -> list[dict]:
    """Call edges of all bodies, by the resolution ladder of ``operators.merge.resolve_source_calls``."""
    known: dict[tuple[str, str, int], set[str]] = {}
    for owner, name, descriptor in unit.methods:
        known.setdefault((owner, name, len(re.findall(r"\[*(?:[BCDFIJSZ]|L[^;]+;)", descriptor.partition(")")[0]))), set()).add(descriptor)
    out = []
    for id_, owner, body in unit.bodies:
        for i in range(len(body) - 1):
            (w, line), following = body[i], body[i + 1][0]
            before = body[i - 1][0] if i else ""
            if w == "new" and re.match(r"[A-Za-z_$]", following):
                j, name = i + 1, body[i + 1][0]
                while j + 2 < len(body) and body[j + 1][0] == ".":
                    name, j = f"{name}.{body[j + 2][0]}", j + 2
                if j + 1 < len(body) and body[j + 1][0] == "<":
                    depth = 0
                    while j + 1 < len(body):
                        j += 1
                        depth += (body[j][0] == "<") - (body[j][0] == ">")
                        if not depth:
                            break
                if j + 1 < len(body) and body[j + 1][0] == "(":
                    n, _ = _arguments(body, j + 1)
                    out.append((id_, f"M:{internal_name(name, unit)}#<init>({'L?;' * n})?", "calls", line, "source-ctor"))
            elif following == "(" and re.match(r"[A-Za-z_$]", w) and w not in _NOT_CALLS and before != "new":
                n, _ = _arguments(body, i + 1)
                scope = body[i - 2][0] if before == "." and i >= 2 else None
                if before == "." and i >= 3 and body[i - 3][0] == "." and scope != "this":
                    scope = "?"  # a longer chain: its type is not known
                own = known.get((owner, w, n), set())
                holes = f"({'L?;' * n})?"
                if scope in (None, "this") and len(own) == 1:
                    out.append((id_, f"M:{owner}#{w}{next(iter(own))}", "calls", line, "source-self"))
                elif scope == "super":
                    out.append((id_, f"M:?#{w}{holes}", "references", line, "source-super-unresolved"))
                elif scope in unit.imports:
                    out.append((id_, f"M:{unit.imports[scope]}#{w}{holes}", "calls", line, "source-static-import"))
                elif scope and re.match("[A-Z]", scope):
                    out.append((id_, f"M:{internal_name(scope, unit)}#{w}{holes}", "calls", line, "source-static-best-effort"))
                else:
                    out.append((id_, f"M:?#{w}{holes}", "references", line, "source-unresolved"))
    return [dict(zip(("source", "target", "kind", "line", "provenance"), r, strict=True)) | {"origin": "source"} for r in out]


def scan(text: str, path: str) -> tuple[list[dict], list[dict]]:
    """Node and edge rows of a source file; ValueError if it cannot be scanned."""
    try:
        unit = _Scanner(text, path).scan()
    except (IndexError, KeyError) as e:
        raise ValueError("unbalanced source") from e
    edges = dict(unit.edges)
    for e in calls(unit):
        edges.setdefault((e["source"], e["target"], e["kind"]), e)
    return unit.nodes, list(edges.values())


def graph_rows(text: str, path: str) -> tuple[list[dict], list[dict]]:
    """As ``scan``; a file that cannot be scanned has none."""
    try:
        return scan(text, path)
    except ValueError:
        return [], []
