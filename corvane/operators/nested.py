"""Deeply nested records as related flat tables, by shared inlining.

1. ``schema_graph`` (JSON text) or ``type_graph`` (typed columns) lists the element
   paths, the kinds of value met there and how often.
2. ``inlining`` decides the tables: an element that is repeated (an array, or an
   object whose keys are data), shared by several parents or recursive gets one;
   every other descendant becomes a column of its nearest ancestor with a table.
3. ``shred`` emits one row per element of a table with the key of its record, of
   its parent row and its own position or key.

JSON comes in uneven shapes: a lone element instead of a list, a list or object
kept as JSON text, numbers as decimal or hexadecimal text, a wrapper around the
record.  ``shred`` treats these alike.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: An object whose keys all look like this holds data under them, not fields.
_KEY = re.compile(r"\s*(?:0[xX][0-9a-fA-F]+|[0-9]+)\s*$")
_NUMBER = re.compile(r"\s*(?:(0[xX][0-9a-fA-F]+)|([+-]?[0-9]+)(?:\.0*)?|([+-]?[0-9]+(?:\.[0-9]+)?[eE][+-]?[0-9]+))\s*$")


def whole_number(value: object) -> int | None:
    """The integer a JSON value spells, as number, decimal or hexadecimal text; else None."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, int):
        return value
    if isinstance(value, float):
        return int(value) if value == value and abs(value) < 2**63 and value == int(value) else None
    m = _NUMBER.match(value) if isinstance(value, str) else None
    if not m:
        return None
    if m[1]:
        return int(m[1], 16)
    return int(m[2]) if m[2] else int(float(m[3]))


def readable(text: str | None, depth: int = 3) -> object:
    """The JSON value of ``text``, unwrapped where it is JSON text again; None if it can't be read."""
    for _ in range(depth):
        if not isinstance(text, str):
            return text
        try:
            text = json.loads(text)
        except (ValueError, RecursionError):
            return None
    return None if isinstance(text, str) else text


def _inner(value: object) -> object:
    """Lists and objects kept as JSON text are opened."""
    if isinstance(value, str) and value.lstrip()[:1] in ("[", "{"):
        found = readable(value)
        return value if found is None else found
    return value


def _kind(value: object) -> str:
    if isinstance(value, dict):
        return "map" if value and all(_KEY.match(k) for k in value) else "object"
    return {list: "list", str: "text", bool: "flag", int: "number", float: "number"}.get(type(value), "null")


def record_of(value: object, fields: tuple[str, ...]) -> dict | None:
    """The object that holds any of ``fields``: ``value``, or one within wrappers or a list of one."""
    todo = [value]
    for _ in range(64):
        if not todo:
            return None
        x = _inner(todo.pop(0))
        if isinstance(x, dict):
            if any(f in x for f in fields):
                return x
            todo += [v for v in x.values() if isinstance(_inner(v), dict)]
        elif isinstance(x, list) and len(x) == 1:
            todo.append(x[0])
    return None


def _paths(value: object, path: str, into: Counter, trail: tuple[str, ...] = ()) -> None:
    value = _inner(value)
    kind = _kind(value)
    into[(path, kind)] += 1
    if kind == "list":
        for x in value:
            _paths(x, path + "[]", into, trail)
    elif kind == "map":
        for x in value.values():
            _paths(x, path + "{}", into, trail)
    elif kind == "object":
        for k, x in value.items():
            if k in trail:  # a recursive element is its first occurrence again
                into[(path, f"recursive:{k}")] += 1
                continue
            _paths(x, f"{path}.{k}", into, (*trail, k))


def schema_graph(df: DataFrame, text: str, fields: tuple[str, ...] = ()) -> DataFrame:
    """(path, kind, n) of every element in the JSON column: ``[]`` marks list entries, ``{}`` values under data keys.

    Text that can't be read counts at path ``$`` as kind ``unreadable``.  Counts are
    merged per batch before they are shuffled.  With ``fields``, ``$`` is the record
    that holds any of them, without what is wrapped around it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for x in batch.column(0).to_pylist():
                value = record_of(readable(x), fields) if fields else readable(x)
                if value is None:
                    found[("$", "unreadable")] += 1
                else:
                    _paths(value, "$", found)
            keys = list(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([found[k] for k in keys], pa.int64())], ["path", "kind", "n"]
            )

    parts = df.select(F.col(text).cast("string")).mapInArrow(count, "path string, kind string, n bigint")
    return parts.groupBy("path", "kind").agg(F.sum("n").alias("n"))


def type_graph(kind: T.DataType, path: str = "$") -> list[tuple[str, str]]:
    """The same (path, kind) list, from a Spark type."""
    if isinstance(kind, T.ArrayType):
        return [(path, "list"), *type_graph(kind.elementType, path + "[]")]
    if isinstance(kind, T.MapType):
        return [(path, "map"), *type_graph(kind.valueType, path + "{}")]
    if isinstance(kind, T.StructType):
        return [(path, "object"), *(x for f in kind.fields for x in type_graph(f.dataType, f"{path}.{f.name}"))]
    return [(path, "number" if isinstance(kind, T.NumericType) else "flag" if isinstance(kind, T.BooleanType) else "text")]


def inlining(graph: list[tuple[str, str]]) -> dict[str, dict]:
    """Tables by path: ``parent`` (path of the parent table), ``columns`` (paths inlined) and ``why``.

    Repeated, shared and recursive elements get tables, and so does the record (``$``);
    other descendants are columns of the nearest table above.  A lone object or value
    in the place of a list belongs to the list's table, so paths drop the ``[]`` before
    a field.  A list of plain values in the place of an object is that object spelled
    by position, and no table.  An object of the same name and fields under several
    parents is shared; each parent's rows of it are a table of their own.
    """
    kinds: dict[str, set[str]] = {}
    for path, kind in graph:
        kinds.setdefault(path.replace("[].", "."), set()).add(kind)
    inner = {p: {q[len(p) + 1 :] for q in kinds if q.startswith(p + ".") and not re.search(r"[.\[{]", q[len(p) + 1 :])} for p in kinds}
    by_position = {p for p, k in kinds.items() if "list" in k and inner[p] and kinds.get(p + "[]", {"object"}) <= {"text", "number", "flag", "null"}}
    repeated = {p for p, k in kinds.items() if k & {"list", "map"}} - by_position
    recursive = {f"{p}.{k.partition(':')[2]}" for p, ks in kinds.items() for k in ks if k.startswith("recursive:")}
    alike: dict[tuple, set[str]] = {}
    for p, k in kinds.items():
        if "object" in k and inner[p] and p not in repeated and "." in p and not p.endswith(("]", "}")):
            alike.setdefault((p.rpartition(".")[2], frozenset(inner[p])), set()).add(p)
    shared = {p for ps in alike.values() if len(ps) > 1 for p in ps} - recursive
    tables = {"$": {"parent": None, "columns": [], "why": "record"}}

    def above(path: str) -> str:
        while path != "$":
            path = re.sub(r"(\[\]|\{\}|\.[^.\[\]{}]+)$", "", path) or "$"
            if path in tables:
                return path
        return "$"

    for path in sorted((repeated | recursive | shared) - {"$"}, key=lambda p: (len(re.findall(r"\[\]|\{\}|\.", p)), p)):
        tables[path] = {"parent": above(path), "columns": [], "why": "repeated" if path in repeated else "recursive" if path in recursive else "shared"}
    for path, ks in sorted(kinds.items()):
        if ks & {"text", "number", "flag"}:
            home = path if path in tables else above(path)
            tables[home]["columns"].append(path)
    return tables


def shred_plan(tables: dict[str, dict], known: dict[str, tuple[str, ...]]) -> list[tuple[str, ...]]:
    """The tables of ``inlining`` as ``shred`` takes them, parents first.

    ``known`` gives paths their relation's name, and to elements keyed by data the
    other spellings of the key and content: (rel,) or (rel, key names..., "/", content
    names...).  Any other table is named by its parent's relation and its element.
    """
    rels, plan = {"$": "record"}, [("record", None, "", "record")]
    for path, t in tables.items():
        if path == "$":
            continue
        element = path[len(t["parent"]) :].lstrip(".")
        element = "" if element in ("{}", "[]") else element
        names = known.get(path, ())
        if t["parent"] in known and element in known[t["parent"]][1:]:
            continue  # another spelling of the content
        own = re.sub(r"\W+", "_", element) or "entry"
        rels[path] = names[0] if names else own if t["parent"] == "$" else f"{rels[t['parent']]}_{own}"
        plan.append((rels[path], rels[t["parent"]], element, "recursive" if t["why"] == "recursive" else "keyed" if len(names) > 1 else "list", *names[1:]))
    return plan


def elements(value: object) -> list[tuple[int, object]]:
    """(position, element) of a repeated element in whatever shape it is held.

    A list counts from 0 and its null entries take up positions; an object keyed by
    numbers counts by them; a lone object or value has position 0; null has none.
    """
    value = _inner(value)
    if value is None:
        return []
    if isinstance(value, list):
        return [(i, _inner(x)) for i, x in enumerate(value) if _inner(x) is not None]
    if isinstance(value, dict) and _kind(value) == "map":
        return [(whole_number(k), _inner(x)) for k, x in value.items() if _inner(x) is not None]
    if isinstance(value, str) and not value.strip():
        return []
    return [(0, value)]


def keyed(value: object, names: tuple[str, ...], inside: tuple[str, ...] = ()) -> list[tuple[int, object]]:
    """(key, element) of an object keyed by numbers, or of a list of objects that hold the key in one of ``names``.

    The element of such a listed object is its field of one of the names in ``inside``,
    else the object.  A key without a value is an element without content.
    """
    value = _inner(value)
    found = []
    if isinstance(value, dict):
        if not any(n in value for n in names):
            return [(k, _inner(x)) for raw, x in value.items() if (k := whole_number(raw)) is not None]
        value = [value]
    if isinstance(value, list):
        for x in map(_inner, value):
            if isinstance(x, dict):
                key = next((whole_number(x[n]) for n in names if n in x), None)
                if key is not None:
                    found.append((key, next((_inner(x[n]) for n in inside if n in x), x)))
            elif isinstance(x, list) and x and whole_number(x[0]) is not None:
                found.append((whole_number(x[0]), _inner(x[1]) if len(x) > 1 else None))
            elif whole_number(x) is not None:
                found.append((whole_number(x), None))
    return found


def shred(df: DataFrame, key: str, text: str, fields: tuple[str, ...], tables: list[tuple[str, ...]]) -> DataFrame:
    """Rows (rel, key, k1, k2, columns, rest) of the tables of a JSON column.

    ``tables`` names them as (rel, parent rel or None, element, "list") or (rel,
    parent rel, element, "keyed", key names..., "/", content names...); "recursive" is
    a list whose elements hold the element again, and "record" the record itself.
    ``key`` is a bigint column, one readable record each.  ``k1``, ``k2`` and the array
    ``rest`` are the positions or keys along the way, -1 where there is none; a row's
    parent has the same without the last.  ``columns`` is the inlined rest of the
    element as JSON, null for an empty element.
    """
    plan = []
    for rel, parent, element, how, *names in tables:
        cutoff = names.index("/") if "/" in names else len(names)
        plan.append((rel, parent, element, how, tuple(names[:cutoff]), tuple(names[cutoff + 1 :])))
    below: dict[str | None, list[list[str]]] = {}
    for rel, parent, element, how, *_ in plan:
        below.setdefault("record" if parent is None else parent, []).append(element.split("."))
        if how == "recursive":  # within itself it is named by its last step
            below.setdefault(rel, []).append(element.split(".")[-1:])

    def without(x: dict, paths: list[list[str]]) -> dict:
        kept = {}
        for k, v in x.items():
            if [k] in paths:
                continue
            deeper = [p[1:] for p in paths if p[0] == k and len(p) > 1]
            v = _inner(v) if deeper else v
            kept[k] = without(v, deeper) if deeper and isinstance(v, dict) else v
        return kept

    def flat(rel: str, x: object) -> str | None:
        if isinstance(x, dict):
            if [""] in below.get(rel, []):  # its keyed entries are rows of their own
                x = {k: v for k, v in x.items() if whole_number(k) is None}
            kept = without(x, below.get(rel, []))
            return json.dumps(kept, sort_keys=True) if kept else None
        return None if x is None else json.dumps(x)

    def held_in(x: object, element: str) -> object:
        for name in element.split(".") if element else ():
            x = _inner(x)
            x = x.get(name) if isinstance(x, dict) else None
        return x

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for id_, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                record = record_of(readable(payload), fields)
                if id_ is None or record is None:
                    continue
                held: dict[str | None, list[tuple[tuple[int, ...], object]]] = {None: [((), record)]}
                for rel, parent, element, how, names, inside in plan:
                    if how == "record":
                        held[rel] = held[None]
                        out.append((rel, id_, -1, -1, flat(rel, record), []))
                        continue
                    held[rel] = []
                    todo = [(at, x, element) for at, x in held[parent]]
                    for at, x, name in todo:
                        inner = held_in(x, name)
                        for k, y in keyed(inner, names, inside) if how == "keyed" else elements(inner):
                            if k is not None and -(2**63) <= k < 2**64:
                                k -= 2**64 if k >= 2**63 else 0
                                held[rel].append(((*at, k), y))
                                out.append((rel, id_, *((*at, k, -1)[:2]), flat(rel, y), [*at, k][2:]))
                                if how == "recursive":
                                    todo.append(((*at, k), y, element.rpartition(".")[2]))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())), strict=True)], ["rel", "parent_id", "k1", "k2", "columns", "rest"]
            )

    return df.select(F.col(key).cast("bigint"), F.col(text).cast("string")).mapInArrow(rows, "rel string, parent_id bigint, k1 bigint, k2 bigint, columns string, rest array<bigint>")


def is_readable(df: DataFrame, key: str, order: str, text: str, fields: tuple[str, ...]) -> DataFrame:
    """(key, order) of the rows whose JSON holds a record."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = pa.array([record_of(readable(x), fields) is not None for x in batch.column(2).to_pylist()], pa.bool_())
            yield batch.filter(ok)

    return df.select(key, order, F.col(text).cast("string").alias(text)).mapInArrow(test, f"{key} {kinds[key]}, {order} {kinds[order]}, {text} string")


def latest_readable(df: DataFrame, key: str, order: str, text: str, fields: tuple[str, ...]) -> DataFrame:
    """Of each key the text of the latest row that can be read; of equal times the greatest text."""
    return is_readable(df, key, order, text, fields).groupBy(key).agg(F.max_by(text, F.struct(F.coalesce(order, F.lit("0001-01-01").cast("timestamp_ntz" if dict(df.dtypes)[order] == "timestamp_ntz" else "timestamp")), text)).alias(text))


def explode_typed(df: DataFrame, key: str, column: str, rel: str, inner: dict[str, str]) -> DataFrame:
    """The same rows for a typed array<struct> column: its elements as ``rel`` and, for each
    field -> rel of ``inner``, the non-null entries of that array field.

    Null elements and entries take up positions.  One pass over the column.
    """
    top = df.select(F.col(key).cast("bigint").alias("parent_id"), F.posexplode(column).alias("_p", "_e")).filter(F.col("_e").isNotNull())
    fields = [f.name for f in df.schema[column].dataType.elementType.fields if f.name not in inner]
    rest = F.to_json(F.struct(*[F.col(f"_e.{f}").alias(f) for f in fields]))
    own = F.array(F.struct(F.lit(rel).alias("rel"), F.lit(-1).cast("bigint").alias("k2"), rest.alias("columns")))
    parts = [own]
    for field, name in inner.items():
        kind = df.schema[column].dataType.elementType[field].dataType
        value = lambda x, i: F.struct(F.when(x.isNotNull(), i.cast("bigint")).alias("k2"), F.to_json(F.struct(x.alias("value"))).alias("columns"))
        entries = F.filter(F.transform(F.coalesce(F.col(f"_e.{field}"), F.array().cast(kind)), value), lambda s: s["k2"].isNotNull())
        named = F.arrays_zip(F.array_repeat(F.lit(name), F.size(entries)).alias("rel"), entries.alias("e"))
        parts.append(F.transform(named, lambda s: F.struct(s["rel"].alias("rel"), s["e"]["k2"].alias("k2"), s["e"]["columns"].alias("columns"))))
    rows = top.select("parent_id", F.col("_p").cast("bigint").alias("k1"), F.explode(F.concat(*parts)).alias("_r"))
    return rows.select("_r.rel", "parent_id", "k1", "_r.k2", "_r.columns", F.array().cast("array<bigint>").alias("rest"))
