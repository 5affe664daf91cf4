"""Ids, descriptors, scopes and type names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def class_id(internal: Column) -> Column:
    return F.concat(F.lit("C:"), internal)


def method_id(owner: Column, name: Column, descriptor: Column) -> Column:
    return F.concat(F.lit("M:"), owner, F.lit("#"), name, descriptor)


def field_id(owner: Column, name: Column) -> Column:
    return F.concat(F.lit("F:"), owner, F.lit("#"), name)


def call_key(target: Column) -> Column:
    """What a rule is compared with: owner and name of a method id, case folded."""
    return F.lower(F.substring_index(target, "(", 1))


def owner_of(node_id: Column) -> Column:
    """Owner of a member id, internal name of a class id."""
    return F.substring_index(F.substring(node_id, 3, 1 << 20), "#", 1)


def method_parts(node_id: Column) -> Column:
    """struct(owner, name, descriptor) of a method id; null if the owner is empty or there is no "("."""
    rest = F.substring(node_id, 3, 1 << 20)
    owner, tail = F.substring_index(rest, "#", 1), F.expr("1")
    tail = F.substring(rest, F.length(owner) + 2, F.lit(1 << 20))
    name = F.substring_index(tail, "(", 1)
    descriptor = F.substring(tail, F.length(name) + 1, F.lit(1 << 20))
    ok = node_id.startswith("M:") & rest.contains("#") & (owner != "") & tail.contains("(")
    return F.when(ok, F.struct(owner.alias("owner"), name.alias("name"), descriptor.alias("descriptor")))


def parameters(descriptor: Column) -> Column:
    """Parameter types of a method descriptor; a malformed one has none."""
    inner = F.regexp_extract(descriptor, r"^\(([^)]*)\)", 1)
    found = F.regexp_extract_all(inner, F.lit(r"\[*(?:[BCDFIJSZ]|L[^;]+;)"), F.lit(0))
    return F.when(F.array_join(found, "") == inner, found).otherwise(F.array().cast("array<string>"))


def arity(descriptor: Column) -> Column:
    return F.size(parameters(descriptor))


def scope_prefix(text: str | None) -> str | None:
    """A package prefix as internal name; blank means everything."""
    text = (text or "").strip().replace(".", "/")
    return text or None


def changed_paths(lines: list[str]) -> list[str]:
    return [p for p in (x.strip().replace("\\", "/") for x in lines) if p]


def in_prefix(node_id: Column, prefix: str | None) -> Column:
    """Whether a class, method or field id lies under the prefix; unknown kinds never do."""
    if prefix is None:
        return F.lit(True)
    return F.coalesce(node_id.startswith(f"C:{prefix}") | node_id.startswith(f"M:{prefix}") | node_id.startswith(f"F:{prefix}"), F.lit(False))


def on_paths(path: Column, suffixes: list[str]) -> Column:
    """Whether a path ends with any of the suffixes; no suffixes: every path, even null."""
    if not suffixes:
        return F.lit(True)
    test = F.lit(False)
    for s in suffixes:
        test = test | path.endswith(s)
    return F.coalesce(test, F.lit(False))


def simple_name(internal: Column) -> Column:
    return F.substring_index(F.substring_index(internal, "/", -1), "$", -1)


def is_synthetic(kind: Column, name: Column, access: Column) -> Column:
    """Compiler-made members: by the synthetic or bridge bit (whatever that bit means for the kind), or by the names compilers give."""
    flagged = access.bitwiseAND(F.lit(0x1000 | 0x40)) != 0
    named = ((kind == "field") & (name.startswith("val$") | name.startswith("this$"))) | ((kind == "method") & name.startswith("access$"))
    return (flagged | named).cast("int")


# Types of the language's own package that sources name without an import.
LANG_TYPES = (
    "Object", "String", "Integer", "Long", "Short", "Byte", "Boolean",
    "Character", "Float", "Double", "Number", "Void", "Throwable",
    "Exception", "RuntimeException", "Error", "Class", "Enum", "Iterable",
    "Comparable", "CharSequence", "StringBuilder", "StringBuffer",
    "System", "Math", "Thread", "Runnable",
)


def internal_name(written: Column, imports: Column, package: Column) -> Column:
    """A source type name as internal name: generics off, dotted as written, import, own language, type variable, same package.

    Null and blank names are the root type.
    """
    plain = F.trim(F.substring_index(F.coalesce(written, F.lit("")), "<", 1))
    same = F.when(F.coalesce(package, F.lit("")) == "", plain).otherwise(F.concat(package, F.lit("/"), plain))
    return (
        F.when(plain == "", F.lit("java/lang/Object"))
        .when(plain.contains("."), F.translate(plain, ".", "/"))
        .when(F.try_element_at(imports, plain).isNotNull(), F.try_element_at(imports, plain))
        .when(plain.isin(*LANG_TYPES), F.concat(F.lit("java/lang/"), plain))
        .when(plain.rlike(r"^\p{Lu}$"), F.lit("java/lang/Object"))
        .otherwise(same)
    )


def rendered(kind: Column, node_id: Column, file_path: Column, start_line: Column, entry_kind: Column) -> Column:
    """One line of text for a node."""
    place = F.when(file_path.isNotNull() & (F.coalesce(start_line, F.lit(0)) > 0), F.concat(F.lit(" ["), file_path, F.lit(":"), start_line.cast("string"), F.lit("]"))).when(file_path.isNotNull(), F.concat(F.lit(" ["), file_path, F.lit("]"))).otherwise(F.lit(""))
    entry = F.when(entry_kind.isNotNull(), F.concat(F.lit(" [entry:"), entry_kind, F.lit("]"))).otherwise(F.lit(""))
    return F.concat(F.rpad(kind, 10, " "), F.lit(" "), node_id, place, entry)
