"""Index schemas: declared fields, from Python or from the schema language."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

_ALIASES = {
    "text": "text", "string": "text", "str": "text", "u64": "u64", "uint": "u64", "unsigned": "u64", "i64": "i64", "int": "i64", "integer": "i64",
    "f64": "f64", "float": "f64", "double": "f64", "bytes": "bytes", "binary": "bytes", "blob": "bytes", "json": "json", "dense_vector": "dense_vector",
    "vector": "dense_vector", "binary_dense_vector": "binary_dense_vector", "binary_vector": "binary_dense_vector", "sparse_vector": "sparse_vector",
}


class SchemaError(ValueError):
    pass


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = "text"
    tokenizer: str = "simple"
    indexed: bool = True
    stored: bool = True
    fast: bool = False
    primary: bool = False
    content_hash: bool = False
    multi: bool = False
    chunked: bool = False
    positions: str | None = None  # ordinal, token_position or positions
    dims: int | None = None
    k1: float = 1.2
    b: float = 0.75
    max_terms: int = 20
    doc_mass: float | None = None
    weight_threshold: float = 0.0
    min_terms: int = 4
    layout: tuple[tuple[str, str], ...] = ()  # options that shape a file, but no exact result

    @property
    def has_token_positions(self) -> bool:
        return self.positions in ("token_position", "positions")

    def spark_type(self) -> T.DataType:
        sparse = T.ArrayType(T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("weight", T.FloatType())]))
        one = {
            "text": T.StringType(), "u64": T.LongType(), "i64": T.LongType(), "f64": T.DoubleType(), "bytes": T.BinaryType(), "json": T.StringType(),
            "dense_vector": T.ArrayType(T.FloatType()), "binary_dense_vector": T.ArrayType(T.LongType()), "sparse_vector": sparse,
        }[self.kind]
        return T.ArrayType(one) if self.multi else one


@dataclass(frozen=True)
class Rule:
    """A query that the pattern matches goes to target, rewritten; alone (exclusive) or beside the query."""

    pattern: str
    substitution: str
    target: str
    exclusive: bool = False


@dataclass(frozen=True)
class Schema:
    name: str
    fields: tuple[Field, ...]
    default_fields: tuple[str, ...] = ()
    rules: tuple[Rule, ...] = ()
    max_l1_phrase_terms: int = 64

    def __post_init__(self) -> None:
        names = [f.name for f in self.fields]
        if len(set(names)) < len(names):
            raise SchemaError("field names repeat")
        if unknown := set(self.default_fields) | {r.target for r in self.rules} - set(names):
            if unknown - set(names):
                raise SchemaError(f"no field {sorted(unknown - set(names))}")
        keys = [f for f in self.fields if f.primary]
        if len(keys) > 1 or any(f.kind != "text" or f.multi for f in keys):
            raise SchemaError("a primary key is one single-valued text field")
        if any(f.content_hash for f in self.fields) and not keys:
            raise SchemaError("a content hash needs a primary key")

    def __getitem__(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise SchemaError(f"no field {name!r}")

    @property
    def primary(self) -> Field | None:
        return next((f for f in self.fields if f.primary), None)

    @property
    def defaults(self) -> tuple[str, ...]:
        return self.default_fields or tuple(f.name for f in self.fields if f.kind == "text" and f.indexed)

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.spark_type(), metadata={"kind": f.kind, "tokenizer": f.tokenizer} if f.kind == "text" else {"kind": f.kind}) for f in self.fields])


_TOKEN = re.compile(r'\s+|#[^\n]*|r"[^"]*"|"(?:[^"\\]|\\.)*"|[A-Za-z_][A-Za-z0-9_]*|[0-9]+(?:\.[0-9]+)?|[{}\[\]<>():,]')


class _Reader:
    def __init__(self, text: str) -> None:
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise SchemaError(f"unexpected {text[at : at + 20]!r}")
            if not m.group()[0].isspace() and m.group()[0] != "#":
                self.tokens.append(m.group())
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def next(self) -> str:
        token = self.peek()
        if not token:
            raise SchemaError("the schema ends too soon")
        self.at += 1
        return token

    def take(self, token: str) -> bool:
        if self.peek() == token:
            self.at += 1
            return True
        return False

    def need(self, token: str) -> None:
        if (got := self.next()) != token:
            raise SchemaError(f"{token!r} expected, not {got!r}")

    def name(self) -> str:
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", got := self.next()):
            raise SchemaError(f"a name expected, not {got!r}")
        return got

    def string(self) -> str:
        got = self.next()
        if got.startswith('r"'):
            return got[2:-1]
        if not got.startswith('"'):
            raise SchemaError(f"a string expected, not {got!r}")
        return re.sub(r"\\(.)", r"\1", got[1:-1])

    # Definitions

    def index(self) -> Schema:
        self.need("index")
        name, fields, defaults, rules, terms = self.name(), [], [], [], 64
        self.need("{")
        while not self.take("}"):
            word = self.next()
            if word == "field":
                fields.append(self.field())
            elif word == "default_fields":
                self.need(":")
                self.need("[")
                while not self.take("]"):
                    defaults.append(self.name())
                    self.take(",")
            elif word == "query_router":
                rules.append(self.rule())
            elif word in ("reorder_on_merge", "max_l1_phrase_terms"):
                self.need(":")
                value = self.next()
                if word == "max_l1_phrase_terms":
                    terms = int(value)
                    if terms < 1:
                        raise SchemaError("max_l1_phrase_terms is 1 at least")
            else:
                raise SchemaError(f"unexpected {word!r}")
        return Schema(name, tuple(fields), tuple(defaults), tuple(rules), terms)

    def rule(self) -> Rule:
        self.need("{")
        got = {}
        while not self.take("}"):
            key = self.name()
            self.need(":")
            got[key] = self.string() if key in ("pattern", "substitution") else self.name()
        if {"pattern", "substitution", "target_field"} - set(got):
            raise SchemaError("a router has pattern, substitution and target_field")
        re.compile(got["pattern"])
        return Rule(got["pattern"], got["substitution"], got["target_field"], got.get("mode") == "exclusive")

    def field(self) -> Field:
        name = self.name()
        self.need(":")
        word = self.name()
        if word not in _ALIASES:
            raise SchemaError(f"unknown type {word!r}")
        f = Field(name, _ALIASES[word])
        if self.take("<"):
            f = self.type_options(f)
        if self.take("["):
            f = replace(f, indexed=False, stored=False)
            while not self.take("]"):
                f = self.attribute(f)
                self.take(",")
        return replace(f, multi=True) if f.chunked else f

    def type_options(self, f: Field) -> Field:
        if f.kind == "text":
            spec = self.name()
            if self.take("("):
                depth, inside = 1, []
                while depth:
                    t = self.next()
                    depth += (t == "(") - (t == ")")
                    inside.append(t)
                spec += "(" + " ".join(inside[:-1]).replace(" :", ":") + ")"
            f = replace(f, tokenizer=spec)
        else:
            values = []
            while self.peek() != ">":
                values.append(self.next())
                self.take(",")
            numbers = [v for v in values if v.isdigit()]
            f = replace(f, dims=int(numbers[0]) if numbers else None, layout=f.layout + tuple(("type", v) for v in values if not v.isdigit() and v not in ("dims", ":")))
        self.need(">")
        return f

    def attribute(self, f: Field) -> Field:
        word = self.name()
        if word == "indexed":
            f = replace(f, indexed=True)
            if self.take("<"):
                while not self.take(">"):
                    f = self.option(f)
                    self.take(",")
            return f
        if word == "stored":
            f = replace(f, stored=True)
            if self.take("<"):
                self.need("multi")
                self.need(">")
                f = replace(f, multi=True)
            return f
        if word == "primary":
            return replace(f, primary=True, indexed=True, fast=True)
        if word in ("fast", "content_hash"):
            return replace(f, **{word: True})
        if word == "reorder":
            return replace(f, layout=f.layout + (("reorder", "true"),))
        raise SchemaError(f"unknown attribute {word!r}")

    def option(self, f: Field) -> Field:
        word = self.name()
        if word in ("ordinal", "token_position", "positions"):
            return replace(f, positions=word)
        if word == "chunked":
            return replace(f, chunked=True)
        if word == "query":
            self.need("<")
            while not self.take(">"):
                key = self.name()
                self.need(":")
                value = self.next()
                f = replace(f, max_terms=int(value)) if key == "max_terms" else replace(f, layout=f.layout + ((f"query.{key}", value),))
                self.take(",")
            return f
        if not self.take(":"):
            return replace(f, layout=f.layout + (("index", word),))
        if word == "common_grams":
            self.need("[")
            words = []
            while not self.take("]"):
                words.append(self.string())
                self.take(",")
            return replace(f, layout=f.layout + (("common_grams", " ".join(words)),))
        value = self.next()
        if word in ("k1", "b", "doc_mass", "weight_threshold"):
            return replace(f, **{word: float(value)})
        if word == "min_terms":
            return replace(f, min_terms=int(value))
        return replace(f, layout=f.layout + ((word, value),))


def parse_schemas(text: str) -> list[Schema]:
    """All index definitions of a schema text."""
    reader, out = _Reader(text), []
    while reader.peek():
        out.append(reader.index())
    if not out:
        raise SchemaError("no index is defined")
    return out


def parse_schema(text: str) -> Schema:
    return parse_schemas(text)[0]


def to_sdl(schema: Schema) -> str:
    """The schema as text that parse_schema() reads back."""
    lines = [f"index {schema.name} {{"]
    for f in schema.fields:
        kind = f.kind + (f"<{f.tokenizer}>" if f.kind == "text" else f"<{f.dims}>" if f.dims else "")
        options = [f.positions] * bool(f.positions) + ["chunked"] * f.chunked
        options += [f"{k}: {v}" for k, v, d in (("k1", f.k1, 1.2), ("b", f.b, 0.75), ("doc_mass", f.doc_mass, None), ("weight_threshold", f.weight_threshold, 0.0), ("min_terms", f.min_terms, 4)) if v != d]
        options += [f"query<max_terms: {f.max_terms}>"] * (f.max_terms != 20)
        attributes = ["indexed" + (f"<{', '.join(options)}>" if options else "")] * f.indexed + ["stored" + "<multi>" * (f.multi and not f.chunked)] * f.stored
        attributes += ["fast"] * (f.fast and not f.primary) + ["primary"] * f.primary + ["content_hash"] * f.content_hash
        lines.append(f"    field {f.name}: {kind} [{', '.join(attributes)}]")
    if schema.default_fields:
        lines.append(f"    default_fields: [{', '.join(schema.default_fields)}]")
    for r in schema.rules:
        quoted = r.substitution.replace("\\", "\\\\").replace('"', '\\"')
        lines.append(f'    query_router {{ pattern: r"{r.pattern}" substitution: "{quoted}" target_field: {r.target} mode: {"exclusive" if r.exclusive else "additional"} }}')
    if schema.max_l1_phrase_terms != 64:
        lines.append(f"    max_l1_phrase_terms: {schema.max_l1_phrase_terms}")
    return "\n".join([*lines, "}"])


def columns(fields: Sequence[Field]) -> list[str]:
    return [f.name for f in fields]


__all__ = ["Field", "Rule", "Schema", "SchemaError", "columns", "field", "parse_schema", "parse_schemas", "to_sdl"]
