"""JSON Schema documents compiled to columns of violations over VARIANT values and structs.

``Compiler`` turns a schema (draft 2020-12; the keywords of KEYWORDS) into one SQL expression that gives, for a document, an array of
(path, keyword, detail): path is the place in the document ("" is its root, then names and indices joined by "/"), detail
names the missing or stray property, or what was expected. Schemas refer to each other by ``$ref`` within a registry of
documents. A keyword that isn't known is refused when a schema is compiled, never skipped; so is a cycle of references.

As in the standard, a keyword says nothing about values of other types (``minLength`` of a number holds), 1.0 is an integer, a
property that is null is present, and ``format`` is only asserted if asked for.

A struct is the document that ``to_json`` makes of it: null fields are absent, null items are null. It isn't made into one: what its type says
is settled when the schema is compiled, and fields are read where they lie. Only fields of types without such a form become variants.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from itertools import groupby
from typing import Any
from urllib.parse import urldefrag, urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, ByteType, DataType, DoubleType, IntegerType, LongType, NullType, ShortType, StringType, StructType

Schema = Mapping[str, Any] | bool

VIOLATION = "struct<path: string, keyword: string, detail: string>"
NONE = f"array<{VIOLATION}>"

#: Keywords that say nothing about a value.
NOTES = ("$schema", "$id", "$defs", "$comment", "title", "description", "default", "examples")

# The patterns of formats that can be asserted.
FORMATS = {
    "date-time": r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])[Tt]([01][0-9]|2[0-3]):[0-5][0-9]:([0-5][0-9]|60)(\.[0-9]+)?([Zz]|[+-]([01][0-9]|2[0-3]):[0-5][0-9])$",
    "date": r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$",
    "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s]*$",
}


class SchemaError(ValueError):
    """A schema that can't be compiled."""


class Registry:
    """Schema documents by ``$id`` (or the name that they are given under), to which references lead."""

    def __init__(self, documents: Mapping[str, Schema]) -> None:
        self.documents = {d.get("$id", name) if isinstance(d, Mapping) else name: d for name, d in documents.items()}
        self.names = {name: d.get("$id", name) if isinstance(d, Mapping) else name for name, d in documents.items()}

    def resolved(self, base: str, reference: str) -> tuple[str, Schema]:
        """The document and the schema in it that a reference of the document ``base`` means."""
        document, pointer = urldefrag(urljoin(base, reference))
        document = document or base
        if document not in self.documents:
            raise SchemaError(f"no document {document} for {reference}")
        found: Any = self.documents[document]
        for step in [s.replace("~1", "/").replace("~0", "~") for s in pointer.split("/")[1:]]:
            try:
                found = found[int(step)] if isinstance(found, list) else found[step]
            except (KeyError, IndexError, ValueError, TypeError):
                raise SchemaError(f"{reference} leads nowhere in {document}") from None
        return document, found


def _text(value: str) -> str:
    """A text as an SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _shown(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


_NONE = f"cast(array() AS {NONE})"


class Part(str):
    """SQL of an array of violations, nulls aside; of whether there are none, told without making it; and of the violation or null, where there is one at most."""

    holds: str
    one: str | None

    def __new__(cls, sql: str, holds: str, one: str | None = None) -> Part:
        part = super().__new__(cls, sql)
        part.holds, part.one = holds, one
        return part


def _all_hold(parts: list[str]) -> str:
    return "(" + " AND ".join(f"({p.holds})" if isinstance(p, Part) else f"NOT exists({p}, v -> v IS NOT NULL)" for p in parts) + ")" if parts else "true"


class Value:
    """A value inside a document: the SQL of a variant and the path to the value in it, and the SQL of its place in the document."""

    def __init__(self, root: str, steps: tuple[str, ...], place: tuple[str, ...]) -> None:
        self.root, self.steps, self.place = root, steps, place

    def get(self, kind: str) -> str:
        path = "$" + "".join(f"['{s}']" if '"' in s else f'["{s}"]' for s in self.steps)
        return f"try_variant_get({self.root}, {_text(path)}, '{kind}')"

    @property
    def variant(self) -> str:
        return self.root if not self.steps else self.get("variant")

    @property
    def fields(self) -> str:
        """The properties of an object; null for any other value."""
        return self.get("map<string, variant>")

    @property
    def items(self) -> str:
        """The items of an array; null for any other value."""
        return self.get("array<variant>")

    @property
    def names(self) -> str:
        """The names of an object's properties; null for any other value."""
        return f"map_keys({self.fields})"

    @property
    def absent(self) -> str:
        return f"({self.variant} IS NULL)"

    def child(self, name: str) -> Value:
        place = (*self.place, _text(name))
        if '"' in name and "'" in name:  # no path can say it
            return Value(f"try_element_at({self.fields}, {_text(name)})", (), place)
        return Value(self.root, (*self.steps, name), place)

    def at(self, value: str, step: str) -> Value:
        """A value that a lambda gets, at a step below this one."""
        return Value(value, (), (*self.place, step))

    def item(self, value: str, step: str) -> Value:
        """An item of this array, which a lambda gets."""
        return self.at(value, step)

    def missing(self, names: list[str], keyword: str, c: Compiler) -> list[str]:
        """The violations of an object that hasn't all of these properties."""
        return [self.violations(f"array_except({_names(names)}, {self.names})", keyword, c.variable())]

    def stray(self, schema: Mapping[str, Any], c: Compiler) -> list[str]:
        """The violations of an object that has properties of which its schema doesn't speak."""
        return [self.violations(_others(c, schema, self), "additionalProperties", c.variable())]

    def is_(self, name: str) -> str:
        if name in ("object", "array"):
            return f"({self.fields if name == 'object' else self.items} IS NOT NULL)"
        kind = f"schema_of_variant({self.variant})"
        if name in ("number", "integer"):
            part = f"({kind} LIKE 'DECIMAL%' OR {kind} IN ('DOUBLE', 'FLOAT'))"
            whole = f"{kind} IN ('BIGINT', 'INT', 'SMALLINT', 'TINYINT')"
            return f"({whole} OR {part})" if name == "number" else f"({whole} OR ({part} AND {self.get('double')} = floor({self.get('double')})))"
        try:
            return f"({kind} = '{ {'string': 'STRING', 'boolean': 'BOOLEAN', 'null': 'VOID'}[name] }')"
        except KeyError:
            raise SchemaError(f"no type {name}") from None

    def equals(self, wanted: Any) -> str:
        if wanted is None:
            return self.is_("null")
        if isinstance(wanted, bool):
            return f"({self.is_('boolean')} AND {self.get('boolean')} = {str(wanted).lower()})"
        if isinstance(wanted, (int, float)):
            return f"({self.is_('number')} AND {self.get('double')} = {float(wanted)!r}D)"
        if isinstance(wanted, str):
            return f"({self.is_('string')} AND {self.get('string')} = {_text(wanted)})"
        kind = self.is_("array" if isinstance(wanted, list) else "object")
        return kind if kind == "false" else f"({kind} AND to_json({self.variant}) = to_json(parse_json({_text(json.dumps(wanted))})))"

    def found(self, keyword: str, detail: str) -> str:
        """A violation here; detail is SQL."""
        place = "''" if not self.place else f"concat_ws('/', {', '.join(self.place)})"
        return f"struct({place} AS path, '{keyword}' AS keyword, {detail} AS detail)"

    def violation(self, broken: str, keyword: str, detail: str = "") -> str:
        found = self.found(keyword, _text(detail))
        return Part(f"IF({broken}, array({found}), {_NONE})", f"({broken}) IS NOT TRUE", f"IF({broken}, {found}, NULL)")

    def violations(self, names: str, keyword: str, variable: str) -> str:
        """A violation for each of an array of names, which is null for a value that the keyword doesn't bear on."""
        return f"coalesce(transform({names}, {variable} -> {self.found(keyword, variable)}), {_NONE})"


class Typed(Value):
    """A value inside a struct: its SQL and its type; a null is absent, or as an item of an array null."""

    def __init__(self, sql: str, kind: DataType, place: tuple[str, ...]) -> None:
        super().__init__(sql, (), place)
        self.kind = kind

    @staticmethod
    def fits(kind: DataType) -> bool:
        """Whether values of this type can be read where they lie; other types, and names that Spark can't tell apart, become variants."""
        if isinstance(kind, StructType):
            return len({n.lower() for n in kind.names}) == len(kind.names)
        if isinstance(kind, ArrayType):
            return Typed.fits(kind.elementType)
        return kind == StringType() or isinstance(kind, (BooleanType, ByteType, ShortType, IntegerType, LongType, DoubleType))

    def get(self, kind: str) -> str:
        whole, double = isinstance(self.kind, (ByteType, ShortType, IntegerType, LongType)), isinstance(self.kind, DoubleType)
        if kind == "variant":
            return f"parse_json(to_json({self.root}))" if isinstance(self.kind, (StructType, ArrayType)) else self.root
        if kind == "map<string, variant>":
            return f"try_variant_get(parse_json({f'to_json({self.root})' if isinstance(self.kind, StructType) else _text('0')}), '$', '{kind}')"
        if kind == "array<variant>":
            return self.root if isinstance(self.kind, ArrayType) else "cast(NULL AS array<string>)"
        if kind == "string" and (double or isinstance(self.kind, StringType)) or kind == "double" and whole:
            return f"cast({self.root} AS {kind})"
        if kind.startswith("decimal") and (whole or double):
            return f"try_cast(cast({self.root} AS string) AS {kind})"
        return self.root if (kind, type(self.kind)) in (("double", DoubleType), ("boolean", BooleanType)) else f"cast(NULL AS {kind})"

    @property
    def variant(self) -> str:
        return self.get("variant")

    @property
    def names(self) -> str:
        if not isinstance(self.kind, StructType):
            return "cast(NULL AS array<string>)"
        own = [f"IF({self.child(n).absent}, NULL, {_text(n)})" for n in self.kind.names]
        return f"IF({self.root} IS NULL, NULL, array_compact(array({', '.join(own)})))" if own else f"IF({self.root} IS NULL, NULL, {_names(())})"

    @property
    def absent(self) -> str:
        return f"({self.root} IS NULL)"

    def child(self, name: str) -> Value:
        place = (*self.place, _text(name))
        if not isinstance(self.kind, StructType) or name not in self.kind.names:
            return Typed("NULL", NullType(), place)
        kind, sql = self.kind[name].dataType, f"{self.root}.`{name.replace('`', '``')}`"
        return Typed(sql, kind, place) if self.fits(kind) else Value(f"parse_json(to_json(named_struct('v', {sql})))", ("v",), place)

    def item(self, value: str, step: str) -> Value:
        return Typed(value, self.kind.elementType, (*self.place, step))

    def missing(self, names: list[str], keyword: str, c: Compiler) -> list[str]:
        there = f"{self.root} IS NOT NULL AND"
        return [self.violation(f"{there} {self.child(n).absent}", keyword, n) for n in dict.fromkeys(names)] if isinstance(self.kind, StructType) else []

    def stray(self, schema: Mapping[str, Any], c: Compiler) -> list[str]:
        if schema.get("patternProperties"):
            return super().stray(schema, c)
        others = sorted(set(self.kind.names) - set(schema.get("properties", ()))) if isinstance(self.kind, StructType) else []
        return [self.violation(f"{self.root} IS NOT NULL AND NOT {self.child(n).absent}", "additionalProperties", n) for n in others]

    def is_(self, name: str) -> str:
        finite = f"abs({self.root}) < double('Infinity')"  # to_json writes other doubles as texts
        numbers = (ByteType, ShortType, IntegerType, LongType, DoubleType)
        kinds = {"object": StructType, "array": ArrayType, "string": (StringType, DoubleType), "boolean": BooleanType, "number": numbers, "integer": numbers}
        if name == "null":
            return self.absent
        if name not in kinds:
            raise SchemaError(f"no type {name}")
        if not isinstance(self.kind, kinds[name]):
            return "false"
        more = "" if not isinstance(self.kind, DoubleType) else f" AND NOT {finite}" if name == "string" else f" AND {finite}" + (f" AND {self.root} = floor({self.root})" if name == "integer" else "")
        return f"({self.root} IS NOT NULL{more})"


def _concat(parts: list[str]) -> str:
    """All violations of these parts, in order; those that are one at most are put into one array, with a null for each that isn't."""
    groups = [[*g] for _, g in groupby(parts, lambda p: isinstance(p, Part) and p.one is not None)]
    one = lambda p: isinstance(p, Part) and p.one
    parts = [x for g in groups for x in ([f"array({', '.join(p.one for p in g)})"] if len(g) > 1 and one(g[0]) else g)]
    return _NONE if not parts else parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"


class Compiler:
    """Compiles the schemas of a registry; ``formats`` are the names of the formats to assert.

    Schemas become SQL text, which Spark parses once: a column for each step would be thousands of calls into the JVM.
    """

    def __init__(self, registry: Registry, formats: tuple[str, ...] = ()) -> None:
        self.registry, self.formats, self._variables = registry, formats, 0

    def variable(self) -> str:
        """A name that no other lambda of this compiler has."""
        self._variables += 1
        return f"v{self._variables}"

    def sql(self, name: str, document: str, kind: StructType | None = None) -> str:
        """The SQL of the violations, among nulls, of a variant column of this name, or of a struct column of this type, by the schema ``name``."""
        base = self.registry.names[name]
        value = Typed(f"`{document}`", kind, ()) if kind else Value(f"`{document}`", (), ())
        return self.all(self.registry.documents[base], base, value, ())

    def violations(self, name: str, document: str, kind: StructType | None = None) -> Column:
        return F.array_compact(F.expr(self.sql(name, document, kind)))

    def all(self, schema: Schema, base: str, v: Value, seen: Seen) -> str:
        return _concat(self.parts(schema, base, v, seen))

    def parts(self, schema: Schema, base: str, v: Value, seen: Seen) -> list[str]:
        if schema is True:
            return []
        if schema is False:
            return [v.violation("true", "false")]
        if unknown := [k for k in schema if k not in NOTES and k not in KEYWORDS]:
            raise SchemaError(f"keywords that aren't known: {unknown}")
        return [part for k in schema if k not in NOTES for part in KEYWORDS[k](self, schema, base, v, seen)]

    def holds(self, schema: Schema, base: str, v: Value, seen: Seen) -> str:
        return _all_hold(self.parts(schema, base, v, seen))


Seen = tuple[tuple[str, str], ...]
Keyword = Callable[[Compiler, Mapping[str, Any], str, Value, Seen], list[str]]
KEYWORDS: dict[str, Keyword] = {}


def keyword(name: str) -> Callable[[Keyword], Keyword]:
    def register(f: Keyword) -> Keyword:
        KEYWORDS[name] = f
        return f

    return register


@keyword("$ref")
def _ref(c, schema, base, v, seen):
    step = (base, schema["$ref"])
    if step in seen:
        raise SchemaError(f"a cycle of references through {schema['$ref']}")
    document, found = c.registry.resolved(*step)
    return c.parts(found, document, v, (*seen, step))


@keyword("type")
def _type(c, schema, base, v, seen):
    wanted = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
    return [v.violation(f"NOT ({' OR '.join(map(v.is_, wanted))})", "type", ",".join(wanted))]


@keyword("enum")
def _enum(c, schema, base, v, seen):
    strings = [x for x in schema["enum"] if isinstance(x, str)]
    fits = [f"({v.is_('string')} AND {v.get('string')} IN ({', '.join(map(_text, strings))}))"] * bool(strings) + [v.equals(x) for x in schema["enum"] if not isinstance(x, str)]
    return [v.violation(f"NOT ({' OR '.join(fits) or 'false'})", "enum", _shown(schema["enum"]))]


@keyword("const")
def _const(c, schema, base, v, seen):
    return [v.violation(f"NOT {v.equals(schema['const'])}", "const", _shown(schema["const"]))]


#: What breaks a bound, by keyword: the type that it bears on, and SQL of the value and the bound.
_BOUNDS = {
    "minLength": ("string", "length({string}) < {x}"), "maxLength": ("string", "length({string}) > {x}"), "pattern": ("string", "NOT rlike({string}, {x})"),
    "minimum": ("number", "{double} < {x}"), "maximum": ("number", "{double} > {x}"), "exclusiveMinimum": ("number", "{double} <= {x}"), "exclusiveMaximum": ("number", "{double} >= {x}"),
    "multipleOf": ("number", "pmod({decimal}, cast({x} AS decimal(38, 12))) <> 0"), "minItems": ("array", "size({items}) < {x}"), "maxItems": ("array", "size({items}) > {x}"),
    "minProperties": ("object", "size({fields}) < {x}"), "maxProperties": ("object", "size({fields}) > {x}"),
}


def _bound(name: str, kind: str, broken: str) -> Keyword:
    def make(c, schema, base, v, seen):
        x = schema[name]
        if v.is_(kind) == "false":
            return []
        shown = _text(x) if isinstance(x, str) else f"{float(x)!r}D" if kind == "number" else str(x)
        sql = broken.format(x=shown, string=v.get("string"), double=v.get("double"), decimal=v.get("decimal(38, 12)"), items=v.items, fields=v.fields)
        return [v.violation(f"coalesce({v.is_(kind)} AND {sql}, false)", name, _shown(x))]

    return make


for _name, (_kind, _broken) in _BOUNDS.items():
    KEYWORDS[_name] = _bound(_name, _kind, _broken)


@keyword("uniqueItems")
def _unique(c, schema, base, v, seen):
    if not schema["uniqueItems"]:
        return []
    x = c.variable()
    plain = isinstance(v, Typed) and not isinstance(getattr(v.kind, "elementType", None), (StructType, ArrayType))
    shown = v.items if plain else f"transform({v.items}, {x} -> to_json({x}))"
    return [v.violation(f"coalesce(size(array_distinct({shown})) < size({v.items}), false)", "uniqueItems")]


@keyword("format")
def _format(c, schema, base, v, seen):
    name = schema["format"]
    if name not in c.formats:
        return []
    if name not in FORMATS:
        raise SchemaError(f"no format {name}")
    return [v.violation(f"{v.is_('string')} AND NOT rlike({v.get('string')}, {_text(FORMATS[name])})", "format", name)]


def _names(names) -> str:
    return f"array({', '.join(map(_text, names))})" if names else "cast(array() AS array<string>)"


@keyword("required")
def _required(c, schema, base, v, seen):
    return v.missing(schema["required"], "required", c) if schema["required"] else []


@keyword("dependentRequired")
def _dependent(c, schema, base, v, seen):
    there = lambda n: f"NOT {v.child(n).absent}"
    return [v.violations(f"IF({there(one)}, array_except({_names(others)}, {v.names}), NULL)", "dependentRequired", c.variable()) for one, others in schema["dependentRequired"].items() if others]


@keyword("properties")
def _properties(c, schema, base, v, seen):
    out = []
    for name, inner in schema["properties"].items():
        child = v.child(name)
        if isinstance(child, Typed) and isinstance(child.kind, NullType):
            continue
        parts = c.parts(inner, base, child, seen)
        if isinstance(child, Typed):  # a null is seen at once
            out += [Part(f"IF({child.absent}, {_NONE}, {p})", f"{child.absent} OR {_all_hold([p])}", f"IF({child.absent}, NULL, {p.one})" if isinstance(p, Part) and p.one else None) for p in parts]
        elif parts:
            out.append(Part(f"IF({child.absent}, {_NONE}, {_concat(parts)})", f"{child.absent} OR {_all_hold(parts)}"))  # absent, or no object
    return out


def _others(c: Compiler, schema: Mapping[str, Any], v: Value) -> str:
    """Names that neither properties nor patternProperties speak of; null for what is no object."""
    rest = f"array_except({v.names}, {_names(schema.get('properties', ()))})"
    for pattern in schema.get("patternProperties", ()):
        x = c.variable()
        rest = f"filter({rest}, {x} -> NOT rlike({x}, {_text(pattern)}))"
    return f"array_sort({rest})"


def _of_names(c: Compiler, inner: Schema, base: str, v: Value, seen: Seen, names: str) -> str:
    """The violations of the properties of these names."""
    x = c.variable()
    return f"coalesce(flatten(transform({names}, {x} -> {c.all(inner, base, v.at(f'try_element_at({v.fields}, {x})', x), seen)})), {_NONE})"


@keyword("additionalProperties")
def _additional(c, schema, base, v, seen):
    inner = schema["additionalProperties"]
    if inner is True:
        return []
    return v.stray(schema, c) if inner is False else [_of_names(c, inner, base, v, seen, _others(c, schema, v))]


@keyword("patternProperties")
def _patterned(c, schema, base, v, seen):
    out = []
    for pattern, inner in schema["patternProperties"].items():
        x = c.variable()
        out.append(_of_names(c, inner, base, v, seen, f"filter(array_sort({v.names}), {x} -> rlike({x}, {_text(pattern)}))"))
    return out


@keyword("propertyNames")
def _property_names(c, schema, base, v, seen):
    x = c.variable()
    name = v.at(f"try_variant_get(parse_json(to_json(array({x}))), '$[0]', 'variant')", x)
    return [f"coalesce(flatten(transform(array_sort({v.names}), {x} -> {c.all(schema['propertyNames'], base, name, seen)})), {_NONE})"]


@keyword("items")
def _each(c, schema, base, v, seen):
    if v.is_("array") == "false":
        return []
    x, i = c.variable(), c.variable()
    parts = c.parts(schema["items"], base, v.item(x, f"cast({i} AS string)"), seen)
    return [f"coalesce(flatten(transform({v.items}, ({x}, {i}) -> {_concat(parts)})), {_NONE})"] if parts else []


@keyword("allOf")
def _all_of(c, schema, base, v, seen):
    return [part for inner in schema["allOf"] for part in c.parts(inner, base, v, seen)]


@keyword("anyOf")
def _any_of(c, schema, base, v, seen):
    return [v.violation(f"NOT ({' OR '.join(c.holds(inner, base, v, seen) for inner in schema['anyOf'])})", "anyOf")]


@keyword("oneOf")
def _one_of(c, schema, base, v, seen):
    return [v.violation(f"({' + '.join(f'int({c.holds(inner, base, v, seen)})' for inner in schema['oneOf'])}) <> 1", "oneOf")]


@keyword("not")
def _not(c, schema, base, v, seen):
    return [v.violation(c.holds(schema["not"], base, v, seen), "not")]


@keyword("if")
def _if(c, schema, base, v, seen):
    branch = lambda name: c.all(schema[name], base, v, seen) if name in schema else _NONE
    return [f"IF({c.holds(schema['if'], base, v, seen)}, {branch('then')}, {branch('else')})"]


for _name in ("then", "else"):  # read with if
    KEYWORDS[_name] = lambda c, schema, base, v, seen: []


def document(value: Column) -> Column:
    """A struct, map or array as a variant document; null fields are absent."""
    return F.parse_json(F.to_json(value))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by its keys to some tasks for each core: a schema costs milliseconds a document, so a small file of rows, which
    Spark reads in one task, is work for all."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def violations(df: DataFrame, compiler: Compiler, name: str, value: Column, *keep: str) -> DataFrame:
    """The columns ``keep`` with path, keyword and detail of every violation; a null value is no document and has none. value is a variant or a struct."""
    rows = df.select(*keep, value.alias("__document")).filter("__document is not null")
    kind = rows.schema["__document"].dataType
    if isinstance(kind, StructType) and not Typed.fits(kind):
        rows, kind = rows.withColumn("__document", document(F.col("__document"))), None
    return _opened(rows, F.expr(compiler.sql(name, "__document", kind if isinstance(kind, StructType) else None)), *keep)


def _opened(rows: DataFrame, found: Column, *keep: str) -> DataFrame:
    """Arrays of violations, opened. Generated code makes them beforehand, and once: an inner explode would first ask whether there are any."""
    opened = rows.select(*keep, found.alias("__found")).select(*keep, F.explode_outer("__found").alias("__violation")).filter("__violation is not null")
    return opened.select(*keep, "__violation.path", "__violation.keyword", "__violation.detail")


def text_violations(df: DataFrame, compiler: Compiler, name: str, text: Column, *keep: str) -> DataFrame:
    """As ``violations``, of JSON texts; a text that isn't JSON has the one violation "json"."""
    rows = df.select(*keep, text.alias("__text")).withColumn("__document", F.try_parse_json("__text")).filter("__text is not null")
    no_json = F.array(F.struct(F.lit("").alias("path"), F.lit("json").alias("keyword"), F.lit("").alias("detail")))
    return _opened(rows, F.when(F.col("__document").isNull(), no_json).otherwise(F.expr(compiler.sql(name, "__document"))), *keep)
