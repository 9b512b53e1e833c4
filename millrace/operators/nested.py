"""Deeply nested records as flat tables, by Merkle subtree identities.

Objects are canonicalised and hashed bottom-up: an object's identity is the
hash of its own fields and, list by list, of its children's identities in
order. Every element of a list counts, whether or not it has a natural key.
Identical objects, wherever they occur, are stored once in the node table;
every occurrence is a row of the bridge table, with its parent and its ordinal.
What can't be read as a record goes to a third table with the reason.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from math import isfinite
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from millrace.session import spread, written

OCCURRENCE = (
    "record_key string, parent_kind string, parent_key string, parent_keyed boolean, parent_id binary, child_kind string, ordinal int, "
    "child_id binary, child_key string, content string, fault string"
)
_ARROW = pa.schema([
    ("record_key", pa.string()), ("parent_kind", pa.string()), ("parent_key", pa.string()), ("parent_keyed", pa.bool_()), ("parent_id", pa.binary()), ("child_kind", pa.string()),
    ("ordinal", pa.int32()), ("child_id", pa.binary()), ("child_key", pa.string()), ("content", pa.string()), ("fault", pa.string()),
])
_dump = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode


def _decimal(text: str) -> int | float | str:
    """A number with a point or an exponent: whole ones are integers, so that 1 and 1.0 are one value; beyond a double's range its text."""
    value = float(text)
    return (int(value) if value.is_integer() and abs(value) < 2**53 else value) if isfinite(value) else text


_load = json.JSONDecoder(parse_float=_decimal).decode


def text_of(value: Any) -> str | None:
    """A scalar's text; null for null and for what is no scalar."""
    if value is None or isinstance(value, (dict, list)):
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    return value if isinstance(value, str) else str(value)


def digits_of(value: Any) -> str | None:
    """The last run of digits of an id, so of ``gid://.../Kind/41`` the 41."""
    found = re.findall(r"\d+", text_of(value) or "")
    return found[-1] if found else None


#: A list's elements, and what its wrapping says beside them (null if nothing).
Elements = tuple[list, Any]


def as_list(value: Any) -> Elements | None:
    """The elements of a list however it is wrapped: JSON in a text, ``edges``/``nodes`` of a connection, or one bare object; null for what is none of these."""
    if isinstance(value, str):
        try:
            value = _load(value)
        except (ValueError, RecursionError):
            return None
    if isinstance(value, list):
        return value, None
    if not isinstance(value, dict):
        return None
    for name in ("edges", "nodes"):
        if isinstance(value.get(name), list):
            beside = {k: v for k, v in value.items() if k != name}
            if name == "nodes":
                return value[name], beside or None
            edges = [{k: v for k, v in e.items() if k != "node"} if isinstance(e, dict) else e for e in value[name]]
            return [e.get("node") if isinstance(e, dict) else None for e in value[name]], [beside, edges] if beside or any(edges) else None
    return [value], None


@dataclass(frozen=True)
class Child:
    """A kind of child: the field it is in, how its elements are found and what its natural key is."""

    kind: str
    name: str
    key: Callable[[Any], str | None]
    elements: Callable[[Any], Elements | None] = as_list
    children: tuple["Child", ...] = field(default=())


def _parts(obj: Any, spec: Child) -> tuple[str, list[tuple[Child, list]]]:
    """An object's own fields as canonical JSON, and its lists of children.

    A field that should hold children and can't be read as a list stays an own
    field; so does what a list's wrapping says beside its elements.
    """
    if not isinstance(obj, dict):
        return _dump(obj), []
    own, lists = obj, []
    for child in spec.children:
        if (value := obj.get(child.name)) is not None and (found := child.elements(value)) is not None:
            own = own if own is not obj else dict(obj)
            if found[1] is None:
                del own[child.name]
            else:
                own[child.name] = found[1]
            lists.append((child, found[0]))
    return _dump(own), lists


def _walk(obj: Any, spec: Child, key: str, keyed: bool, root: str, out: list) -> tuple[bytes, str]:
    """Appends the rows of all that is below ``obj``, deepest first; returns its identity and its own fields."""
    content, lists = _parts(obj, spec)
    digest = hashlib.blake2b(_dump([spec.kind, content]).encode("utf-8", "surrogatepass"), digest_size=16)
    rows = []
    for child, elements in lists:
        digest.update(f"\x00{child.name}\x00{len(elements)}\x00".encode())
        for i, element in enumerate(elements):
            child_key = child.key(element) if element is not None else None
            identity, own = _walk(element, child, f"#{i}" if child_key is None else child_key, child_key is not None, root, out)
            digest.update(identity)
            rows.append([root, spec.kind, key, keyed, None, child.kind, i, identity, child_key, own, None])
    identity = digest.digest()
    for row in rows:
        row[4] = identity
    out += rows
    return identity, content


def records_in(text: str | None, wrappers: tuple[str, ...]) -> list[dict | str]:
    """The records of a payload: itself, those of a list, or those under a wrapper's name; in place of what is no record a text that says why."""
    if text is None:
        return []
    try:
        said = _load(text)
    except (ValueError, RecursionError) as e:
        return [f"no JSON: {e}"[:200]]
    if isinstance(said, dict):
        for name in wrappers:
            if isinstance(said.get(name), (dict, list)):
                said = said[name]
                break
    return [r if isinstance(r, dict) else f"no object but {type(r).__name__}" for r in (said if isinstance(said, list) else [said])]


def occurrences(records: DataFrame, key: Column, payload: Column, spec: Child, wrappers: tuple[str, ...] = ()) -> DataFrame:
    """One row per object in each record's tree, with its parent, ordinal and identity (schema OCCURRENCE).

    ``payload`` is JSON text. The record itself comes too, with null parent. A
    null payload or key gives no row, an absent, null or empty list none below
    it. An element without a natural key, null among them, has a row with null
    ``child_key``; as a parent it goes by its ordinal, as in '#2', and
    ``parent_keyed`` is false. A payload or element of it that is no record
    gives one row with a ``fault`` and no identity. ``content`` holds an
    object's own fields as canonical JSON; within a batch only the first of
    identical objects carries it.
    """

    def shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = []
            for record_key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if record_key is None:
                    continue
                for n, record in enumerate(records_in(text, wrappers)):
                    if isinstance(record, str):
                        rows.append([record_key, *[None] * 5, n, None, None, None, record])
                        continue
                    identity, own = _walk(record, spec, record_key, True, record_key, rows)
                    rows.append([record_key, None, None, None, None, spec.kind, n, identity, record_key, own, None])
            seen: set[bytes | None] = set()
            for row in rows:
                if row[7] in seen:
                    row[9] = None
                seen.add(row[7])
            for at in range(0, len(rows), 20_000):
                columns = zip(*rows[at : at + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array([_clean(v) for v in c] if f.type == pa.string() else c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    return spread(records.select(key.alias("record_key"), payload.alias("payload")), "record_key").mapInArrow(shred, OCCURRENCE)


def _clean(value: str | None) -> str | None:
    """Lone surrogates, which JSON escapes can write, as the replacement character."""
    if value is None or value.isascii():
        return value
    try:
        value.encode()
        return value
    except UnicodeEncodeError:
        return value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def shred(records: DataFrame, key: Column, payload: Column, spec: Child, wrappers: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The node table (node_id, kind, node_key, content), the bridge table and the rejected payloads (record_key, ordinal, fault) of ``records``.

    Nodes are unique by identity; ``node_key`` is null where the object has no
    natural key. The bridge (record_key, parent_kind, parent_key, parent_keyed,
    parent_id, child_kind, ordinal, child_id) keeps every occurrence. Parsing
    happens once; the tables read its written result.
    """
    rows = written(occurrences(records, key, payload, spec, wrappers), "nested")
    first = (F.first(c).alias(n) for c, n in (("child_kind", "kind"), ("child_key", "node_key"), ("content", "content")))
    nodes = rows.where(F.col("content").isNotNull()).groupBy(F.col("child_id").alias("node_id")).agg(*first)
    bridge = rows.where(F.col("child_id").isNotNull()).drop("child_key", "content", "fault")
    return nodes, bridge, rows.where(F.col("fault").isNotNull()).select("record_key", "ordinal", "fault")


def child_keys(nodes: DataFrame, bridge: DataFrame) -> DataFrame:
    """Each record's children by their natural keys: distinct (record_key, child_kind, parent_key, child_key); those without one, or whose parent has none, are left to the bridge.

    A frequent object is one node that many bridge rows point to; adaptive
    execution splits that side of the join, the node side being unique.
    """
    links = bridge.where(F.col("parent_keyed")).select("record_key", "child_kind", "parent_key", "child_id").distinct()
    keys = nodes.where(F.col("node_key").isNotNull()).select(F.col("node_id").alias("child_id"), F.col("node_key").alias("child_key"))
    return links.join(keys, "child_id").select("record_key", "child_kind", "parent_key", "child_key").distinct()


def _levels(value: Any) -> Elements | None:
    if isinstance(value, str):
        try:
            value = _load(value)
        except (ValueError, RecursionError):
            return None
    if isinstance(value, list):
        return value, None
    if not isinstance(value, dict):
        return None
    if "levels" in value and (found := as_list(value["levels"])) is not None:
        beside = {k: v for k, v in value.items() if k != "levels"}
        return found[0], [beside, found[1]] if beside or found[1] else None
    return [{"location": k, "available": v} for k, v in value.items()], None


def _field(*names: str) -> Callable[[Any], str | None]:
    def key(value: Any) -> str | None:
        if isinstance(value, dict):
            return next((t for n in names if (t := text_of(value.get(n))) is not None), None)
        return text_of(value)

    return key


#: The tree of a product record.
PRODUCT = Child("product", "", lambda _: None, children=(
    Child("variant", "variants", lambda v: digits_of(v.get("id")) if isinstance(v, dict) else None, children=(Child("level", "inventory", _field("location"), _levels),)),
    Child("option", "options", lambda o: text_of(o.get("name")) if isinstance(o, dict) else None, children=(Child("option_value", "values", _field("label", "value", "name")),)),
    Child("image", "images", _field("src", "url"), children=(Child("image_variant", "variant_ids", lambda v: digits_of(v.get("id") if isinstance(v, dict) else v)),)),
))
