"""Deeply nested records to related flat tables: adjacency-table shredding and pivoting into entity tables."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Layout:
    """What a record's levels are called.

    entities: level name -> labels under which its records stand, outermost first; a level is only recognised
    directly beneath the level before it. fields: labels that mark an object as one record and not as a keyed
    collection of records. code: for levels whose records may be bare scalars, the field that the scalar is.
    """

    entities: dict[str, tuple[str, ...]]
    fields: frozenset[str] = field(default_factory=frozenset)
    code: dict[str, str] = field(default_factory=dict)


#: The levels of a posting: names of fixed values in the feeds.
FLEET = Layout(
    entities={"vessel": ("vessels", "fleet"), "rotation": ("rotations", "legs"), "position": ("positions", "openings"), "certificate": ("certificates", "certs")},
    fields=frozenset({"name", "imo_like", "embark", "weeks", "rank", "pay", "code", "valid_months", "issuer", "vessels", "fleet", "rotations", "legs", "positions", "openings", "certificates", "certs"}),
    code={"certificate": "code"},
)

ADJACENCY = T.StructType(
    [
        T.StructField("doc", T.LongType()),
        T.StructField("node", T.IntegerType()),
        T.StructField("parent", T.IntegerType()),
        T.StructField("level", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("path", T.ArrayType(T.IntegerType())),
        T.StructField("scalar", T.StringType()),
    ]
)


def _scalar(v: object) -> str:
    return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def _decoded(v: object) -> object:
    """JSON written as text inside JSON counts as the value it spells."""
    if isinstance(v, str) and v.lstrip()[:1] in ("[", "{"):
        try:
            return json.loads(v)
        except (ValueError, RecursionError):
            return v
    return v


def _items(v: object, layout: Layout) -> list[object]:
    """The records in a value: a list's elements, a keyed collection's values in written order, or the value itself."""
    v = _decoded(v)
    if isinstance(v, list):
        return v
    if isinstance(v, dict) and v and not layout.fields & v.keys() and all(x is None or isinstance(x, dict) for x in v.values()):
        return list(v.values())
    return [] if v is None else [v]


def adjacency_rows(doc: int, payload: str | None, layout: Layout) -> list[tuple]:
    """Adjacency rows of one record; none if it isn't complete JSON.

    Objects that stand at a level's place are nodes with level, ordinal and path (ordinals of the levels above
    and their own); scalars hang below the nearest such node, or the root node 0, under their dotted label.
    """
    if not payload:
        return []
    try:
        root = json.loads(payload.lstrip("﻿"))
    except (ValueError, RecursionError):
        return []
    names, out, counter = list(layout.entities), [], [0]

    def record(v: object, node: int, depth: int, prefix: str, path: list[int]) -> None:
        """Rows below one object; depth is how many levels are above or at it."""
        if isinstance(v, list):
            for i, x in enumerate(v, 1):
                if isinstance(x, (dict, list)):
                    record(x, node, depth, prefix, path)
                elif x is not None:
                    leaf(node, prefix, i, path, x)
            return
        place: dict[int, int] = {}
        for label, x in v.items():
            if depth < len(names) and label in layout.entities[names[depth]]:
                level = names[depth]
                for item in _items(x, layout):
                    place[depth] = place.get(depth, 0) + 1
                    if item is None:
                        continue
                    counter[0] += 1
                    child, below = counter[0], [*path, place[depth]]
                    out.append((doc, child, node, level, label, place[depth], below, None))
                    item = _decoded(item)
                    if isinstance(item, dict):
                        record(item, child, depth + 1, "", below)
                    elif not isinstance(item, list) and level in layout.code:
                        leaf(child, layout.code[level], 1, below, item)
            elif isinstance(x, (dict, list)):
                record(x, node, depth, f"{prefix}{label}.", path)
            elif x is not None:
                leaf(node, prefix + label + ".", 1, path, x)

    def leaf(node: int, label: str, ordinal: int, path: list[int], x: object) -> None:
        counter[0] += 1
        out.append((doc, counter[0], node, None, label.rstrip("."), ordinal, path, _scalar(x)))

    try:
        if isinstance(root, (dict, list)):
            record(root, 0, 0, "", [])
    except RecursionError:
        return []
    return out


def shred(records: DataFrame, layout: Layout = FLEET, id_column: str = "id", payload_column: str = "payload", levels_only: bool = False) -> DataFrame:
    """The adjacency table of all records: doc, node, parent, level, label, ordinal, path, scalar.

    One pass over the payloads and no shuffle. levels_only drops scalars that stand above the first level.
    Broken JSON, null payloads, null ids and bare scalars give no rows; a record delivered twice gives its rows
    twice (entity() collapses them); other columns are ignored.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            for doc, payload in zip(frame["doc"], frame["payload"]):
                got = adjacency_rows(doc, payload, layout)
                rows += [r for r in got if r[6]] if levels_only else got
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=ADJACENCY.names)
                    rows = []
            yield pd.DataFrame(rows, columns=ADJACENCY.names)

    source = records.where(F.col(id_column).isNotNull() & F.col(payload_column).rlike(r"^[\s\x{FEFF}]*[\[{]"))
    return source.select(F.col(id_column).cast("long").alias("doc"), F.col(payload_column).alias("payload")).mapInPandas(run, ADJACENCY)


def entity(adjacency: DataFrame, level: str, fields: dict[str, str], layout: Layout = FLEET) -> DataFrame:
    """One level's flat table: doc, node, parent, <level>_no of it and all above it, and its fields.

    Object nodes meet their scalar children in one grouping by (doc, node), pre-aggregated before the shuffle;
    fields maps column name -> dotted label, with "[]" behind it for a list: all its scalars in written order, as
    an array, null without any. An absent field is null; of a single label written twice the last one holds.
    """
    names = list(layout.entities)
    depth = names.index(level)
    cells = adjacency.where((F.col("level") == level) | (F.col("level").isNull() & (F.size("path") == depth + 1) & F.col("label").isin(*(label.removesuffix("[]") for label in fields.values()))))
    own = F.col("level") == level
    grouped = cells.groupBy("doc", F.when(own, F.col("node")).otherwise(F.col("parent")).alias("node")).agg(
        F.max(F.when(own, F.col("parent"))).alias("parent"),
        F.max(F.when(own, F.col("path"))).alias("path"),
        *[_field(F.when(~own.eqNullSafe(True) & (F.col("label") == label.removesuffix("[]")), F.struct("node", "scalar")), label.endswith("[]")).alias(name) for name, label in fields.items()],
    )
    numbers = [F.col("path")[i].alias(f"{names[i]}_no") for i in range(depth + 1)]
    return grouped.where("path is not null").select("doc", "node", "parent", *numbers, *fields)


def _field(cell: Column, is_list: bool) -> Column:
    """The scalar of the last such cell, or all of them in the order of their nodes; a record delivered twice has each once."""
    if is_list:
        found = F.array_sort(F.collect_set(cell))
        return F.when(F.size(found) > 0, F.transform(found, lambda c: c["scalar"]))
    return F.max(cell)["scalar"]


def certificates(raw_items: DataFrame) -> DataFrame:
    """One row per certificate: raw_id, vessel_no, rotation_no, position_no, cert_no, cert_code."""
    rows = entity(shred(raw_items, levels_only=True).where("level = 'certificate' or (level is null and label = 'code' and size(path) = 4)"), "certificate", {"cert_code": "code"})
    return rows.where("cert_code is not null").select(F.col("doc").alias("raw_id"), "vessel_no", "rotation_no", "position_no", F.col("certificate_no").alias("cert_no"), "cert_code")
