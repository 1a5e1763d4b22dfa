"""Declarative class schemas: normalise, check, compile to Spark types and predicates, emit source and read it back.

A payload maps class names to {fields: {name: {type, required, default, description, alias, constraints}},
class_description, base_classes}. Type strings: str int float bool list dict Optional[T] List[T] Dict[K, V] Union[...]
and class names; anything else is str. The emitted source is a Python module of StructTypes whose field metadata holds
what Spark types do not, so reading it back gives the payload again.
"""

from __future__ import annotations

import ast
import functools
import importlib
import json
import keyword
import operator
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of constraints, and keys that are not class names.
CONSTRAINTS = ("ge", "le", "gt", "lt", "min_length", "max_length", "pattern", "multiple_of", "min_items", "max_items")
RESERVED = ("classes", "metadata", "version", "description")
ATOMS = {"str": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "list": T.ArrayType(T.StringType()), "dict": T.MapType(T.StringType(), T.StringType())}


def normalise(payload: dict) -> dict:
    """{class: definition}, from the bare mapping or one under `classes`."""
    if not isinstance(payload, dict):
        raise ValueError("a payload is a mapping")
    found = payload["classes"] if isinstance(payload.get("classes"), dict) else {k: v for k, v in payload.items() if k not in RESERVED}
    if not found:
        raise ValueError("a payload has at least one class")
    return found


def problems(payload: dict) -> list[str]:
    """What is wrong with a payload; empty if nothing."""
    out = []
    try:
        classes = normalise(payload)
    except ValueError as e:
        return [str(e)]
    for name, body in classes.items():
        if not (isinstance(name, str) and name.isidentifier() and name[:1].isupper()):
            out.append(f"{name!r} is no capitalised identifier")
        if not isinstance(body, dict) or not isinstance(body.get("fields"), dict):
            out.append(f"{name} has no fields")
            continue
        for field, spec in body["fields"].items():
            if not isinstance(spec, dict) or not str(spec.get("type") or "").strip():
                out.append(f"{name}.{field} has no type")
            elif unknown := [c for c in spec.get("constraints") or {} if c not in CONSTRAINTS]:
                out.append(f"{name}.{field} has unknown constraints {unknown}")
    return out


def validate(payload: dict) -> dict:
    if found := problems(payload):
        raise ValueError("; ".join(found))
    return normalise(payload)


def class_info(payload: dict, name: str) -> dict:
    classes = validate(payload)
    body = classes[name]
    return {"name": name, "fields": list(body["fields"]), "required": [f for f, s in body["fields"].items() if s.get("required")], "description": body.get("class_description"), "bases": body.get("base_classes", [])}


def arguments(inner: str) -> list[str]:
    """Split at commas that are in no brackets."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(inner):
        depth += (c == "[") - (c == "]")
        if c == "," and not depth:
            out.append(inner[last:i].strip())
            last = i + 1
    return [*out, inner[last:].strip()]


def data_type(text: str, classes: dict, within: tuple[str, ...] = ()) -> T.DataType:
    """Spark type of a type string; recursive classes end in a string, as Spark has no recursive types."""
    text = text.strip()
    if m := re.fullmatch(r"(\w+)\s*\[(.*)\]", text, re.S):
        outer, args = m.group(1), arguments(m.group(2))
        if outer == "Optional":
            return data_type(args[0], classes, within)
        if outer in ("List", "list"):
            return T.ArrayType(data_type(args[0], classes, within))
        if outer in ("Dict", "dict"):
            return T.MapType(T.StringType() if args[0] == "str" else data_type(args[0], classes, within), data_type(args[-1], classes, within))
        if outer == "Union":
            kinds = {json.dumps(data_type(a, classes, within).jsonValue()): data_type(a, classes, within) for a in args if a != "None"}
            return next(iter(kinds.values())) if len(kinds) == 1 else T.StringType()
        return T.StringType()
    if text in classes and text not in within:
        return struct_type(text, classes, within)
    return ATOMS.get(text, T.StringType())


def struct_type(name: str, classes: dict, within: tuple[str, ...] = ()) -> T.StructType:
    """A class as a StructType; whatever else its fields say is metadata."""
    fields = []
    for field, spec in classes[name]["fields"].items():
        optional = spec["type"].strip().startswith("Optional[") or not spec.get("required", False)
        fields.append(T.StructField(field, data_type(spec["type"], classes, (*within, name)), optional, {k: v for k, v in spec.items()}))
    return T.StructType(fields)


def compile_types(payload: dict) -> dict[str, T.StructType]:
    classes = validate(payload)
    return {name: struct_type(name, classes) for name in classes}


def ddl(payload: dict, name: str) -> str:
    return compile_types(payload)[name].simpleString()


def constraint(col: Column, kind: str, value) -> Column:
    tests = {
        "ge": lambda: col >= value, "le": lambda: col <= value, "gt": lambda: col > value, "lt": lambda: col < value, "multiple_of": lambda: col % value == 0,
        "min_length": lambda: F.char_length(col) >= value, "max_length": lambda: F.char_length(col) <= value, "pattern": lambda: col.rlike(value), "min_items": lambda: F.size(col) >= value, "max_items": lambda: F.size(col) <= value,
    }
    return tests[kind]()


def violations(df: DataFrame, payload: dict, name: str, key: str) -> DataFrame:
    """key, field, rule: every constraint that a row breaks, required fields included. Null breaks only `required`."""
    body = validate(payload)[name]
    broken = []
    for field, spec in body["fields"].items():
        if spec.get("required"):
            broken.append(F.when(F.col(field).isNull(), F.struct(F.lit(field).alias("field"), F.lit("required").alias("rule"))))
        for kind, value in (spec.get("constraints") or {}).items():
            broken.append(F.when(~constraint(F.col(field), kind, value), F.struct(F.lit(field).alias("field"), F.lit(kind).alias("rule"))))
    return df.select(F.col(key), F.inline(F.array_compact(F.array(*broken)))) if broken else df.select(F.col(key), F.lit("").alias("field"), F.lit("").alias("rule")).limit(0)


def all_valid(payload: dict, name: str) -> Column:
    """One predicate: all constraints of a class hold (null fields pass unless required)."""
    parts = []
    for field, spec in validate(payload)[name]["fields"].items():
        if spec.get("required"):
            parts.append(F.col(field).isNotNull())
        parts += [F.coalesce(constraint(F.col(field), k, v), F.lit(True)) for k, v in (spec.get("constraints") or {}).items()]
    return functools.reduce(operator.and_, parts, F.lit(True))


def identifier(text: str, taken: set[str]) -> str:
    """A usable, unused Python name."""
    name = re.sub(r"\W", "_", text) or "_"
    name = f"_{name}" if name[0].isdigit() else name
    name = f"{name}_" if keyword.iskeyword(name) else name
    base, n = name, 1
    while name in taken:
        n += 1
        name = f"{base}_{n}"
    taken.add(name)
    return name


def emit(payload: dict) -> str:
    """Python source: one StructType per class, its definition kept as a literal beside it."""
    classes = validate(payload)
    taken: set[str] = set()
    lines = ['"""Generated Spark schemas."""', "", "from pyspark.sql.types import StructType", "", "DEFINITIONS = {}"]
    for name, body in classes.items():
        own = identifier(name, taken)
        lines += ["", "", f"DEFINITIONS[{name!r}] = {body!r}", f"{own} = StructType.fromJson({struct_type(name, classes).jsonValue()!r})"]
    return "\n".join(lines) + "\n"


def read_source(source: str) -> dict:
    """The payload of emitted source, or of a module of annotated model classes; nothing is executed."""
    out: dict = {}
    for node in ast.parse(source).body:
        if isinstance(node, ast.Assign) and isinstance(node.targets[0], ast.Subscript) and getattr(node.targets[0].value, "id", "") == "DEFINITIONS":
            out[ast.literal_eval(node.targets[0].slice)] = ast.literal_eval(node.value)
        elif isinstance(node, ast.ClassDef) and any(ast.unparse(b).split(".")[-1] == "BaseModel" for b in node.bases):
            out[node.name] = model_class(node)
    return out


def model_class(node: ast.ClassDef) -> dict:
    fields: dict = {}
    for item in node.body:
        if not (isinstance(item, ast.AnnAssign) and isinstance(item.target, ast.Name)):
            continue
        spec: dict = {"type": ast.unparse(item.annotation), "required": item.value is None}
        if isinstance(item.value, ast.Call) and ast.unparse(item.value.func).split(".")[-1] == "Field":
            given = {k.arg: ast.literal_eval(k.value) for k in item.value.keywords if k.arg}
            first = ast.literal_eval(item.value.args[0]) if item.value.args else given.pop("default", None)
            spec["required"] = first is Ellipsis or not item.value.args and "default" not in {k.arg for k in item.value.keywords}
            if not spec["required"]:
                spec["default"] = first
            spec |= {k: given[k] for k in ("description", "alias") if k in given}
            if rules := {k: v for k, v in given.items() if k in CONSTRAINTS}:
                spec["constraints"] = rules
        elif item.value is not None:
            spec["default"] = ast.literal_eval(item.value)
        fields[item.target.id] = spec
    return {"fields": fields, "class_description": ast.get_docstring(node) or "", "base_classes": [ast.unparse(b) for b in node.bases]}


def round_trips(payload: dict) -> bool:
    return read_source(emit(payload)) == validate(payload)


def load_class(spec: str):
    """module:Class."""
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)
