"""Rescue-column ingestion of JSON lines whose schema drifts.

Each line is parsed once. Fields of the target schema that hold castable values go to typed columns; whatever is
unknown or cannot be cast is kept, as JSON by path, in ``_rescued``, and what a cast changed the form of, as ``"3"``
for a number, in ``_written``: the three together hold every value of the line as it was. ``promote`` replays approved
rescued fields into the typed columns, so a rename approved later needs no second read of the source. ``_paths`` lists
the paths that hold a non-null value in the line with the kind of the value as written. The drift report takes its
paths and the evidence for renames from these columns, and ``approvals`` makes the approved names from the report.

Defined cases: a null, blank, cut-off or non-object line gives nulls in the typed columns, an empty ``_paths`` and a
``_status`` of ``null``, ``blank``, ``broken`` or ``other``; a key given twice in an object counts with its last value;
numbers written with a point or an exponent are decimals; extra input columns pass through unless their name is one
of the output's own.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from graftline.runtime import spread

#: Target columns: name to type; messages is the array of structs of MESSAGE.
TARGET = {
    "sample_id": "string", "author": "string", "messages": "messages", "node_depth": "bigint", "seq_len": "bigint",
    "targets_per_potential_types": "array<bigint>", "sft_chunk_info": "string", "origin": "string",
}
MESSAGE = {"role": "string", "content": "string", "loss": "bigint", "depth": "bigint"}

#: Places inside the target's own fields that hold the same as one of them; a user may set others.
APPROVED = {"messages[].content.text": "messages[].content", "messages[].content.text_raw": "messages[].content", "messages[].content.depth": "messages[].depth"}
#: Paths of the target schema to which rescued ones may be promoted.
GOALS = frozenset([*TARGET, *(f"messages[].{k}" for k in MESSAGE)])

STRING, INTEGER, DECIMAL, BOOLEAN, OBJECT, ARRAY = 1, 2, 4, 8, 16, 32
_KINDS = {str: STRING, int: INTEGER, float: DECIMAL, bool: BOOLEAN, dict: OBJECT, list: ARRAY}


def parse_line(line: str | None) -> tuple[str, dict | None]:
    """(status, object) of one line."""
    if line is None:
        return "null", None
    if not line.strip():
        return "blank", None
    try:
        value = json.loads(line)
    except (ValueError, RecursionError):
        return "broken", None
    return ("ok", value) if isinstance(value, dict) else ("other", None)


def leaves(value: object, path: str, where: tuple[int, ...] = ()) -> Iterator[tuple[str, int, tuple[int, ...], object]]:
    """(path, kind, array indices, value) of the value and all below it that is not null."""
    todo = [(value, path, where)]
    while todo:
        v, p, w = todo.pop()
        if v is None:
            continue
        yield p, _KINDS[type(v)], w, v
        if isinstance(v, dict):
            todo.extend((x, f"{p}.{k}" if p else k, w) for k, x in v.items())
        elif isinstance(v, list):
            todo.extend((x, f"{p}[]", (*w, i)) for i, x in enumerate(v))


def path_kinds(value: dict) -> list[str]:
    """The distinct ``kind path`` of all below the object that is not null, in order."""
    found: set[tuple[int, str]] = set()
    todo = [(value, "")]
    while todo:
        v, p = todo.pop()
        if isinstance(v, dict):
            inner = [(x, f"{p}.{k}" if p else k) for k, x in v.items() if x is not None]
        else:
            at = f"{p}[]"
            inner = [(x, at) for x in v if x is not None]
        for x, at in inner:
            found.add((_KINDS[type(x)], at))
            if x and isinstance(x, dict | list):
                todo.append((x, at))
    return sorted(f"{kind} {p}" for kind, p in found if p)


def cast(value: object, kind: str) -> tuple[object, bool]:
    """(typed value, whether it could be cast); text of whole numbers casts to bigint, numbers and truth values to their JSON text."""
    if value is None:
        return None, True
    if kind == "string":
        if isinstance(value, int | float):
            return json.dumps(value), True
        return (value, True) if isinstance(value, str) else (None, False)
    if kind == "bigint":
        if isinstance(value, bool):
            return int(value), True
        if isinstance(value, float):
            value = int(value) if value == value and abs(value) < 2**63 and value == int(value) else None
        elif isinstance(value, str):
            value = int(value) if value.strip().lstrip("-").isascii() and value.strip().lstrip("-").isdigit() and len(value) < 20 else None
        return (value, True) if isinstance(value, int) and -(2**63) <= value < 2**63 else (None, False)
    if kind == "array<bigint>":
        if not isinstance(value, list):
            return None, False
        cells = [cast(x, "bigint") for x in value]
        return ([c for c, _ in cells], True) if all(ok for _, ok in cells) else (None, False)
    raise ValueError(kind)


def enforce(value: dict) -> tuple[dict, dict, dict]:
    """(typed fields, rescued values by path, values by path whose form a cast changed); elements keep their message's
    index, as ``messages[2].body``."""
    typed: dict = {}
    rescued: dict = {}
    written: dict = {}

    def put(row: dict, key: str, path: str, v: object, kind: str) -> None:
        cell, ok = cast(v, kind)
        if not ok:
            rescued[path] = v
            return
        row[key] = cell
        if type(cell) is not type(v) or isinstance(v, list) and any(type(x) is not type(y) for x, y in zip(cell, v)):
            written[path] = v

    for key, v in value.items():
        if v is None:
            continue
        if key not in TARGET or key == "messages" and not isinstance(v, list):
            rescued[key] = v
        elif key != "messages":
            put(typed, key, key, v, TARGET[key])
        else:
            typed[key] = []
            for i, m in enumerate(v):
                row = dict.fromkeys(MESSAGE)
                typed[key].append(row)
                if not isinstance(m, dict):
                    if m is not None:
                        rescued[f"messages[{i}]"] = m
                    continue
                for k, x in m.items():
                    if k in MESSAGE and x is not None:
                        put(row, k, f"messages[{i}].{k}", x, MESSAGE[k])
                    elif x is not None:
                        rescued[f"messages[{i}].{k}"] = x
    return typed, rescued, written


_INDEXED = re.compile(r"messages\[(\d+)\](.*)", re.S)


def values(typed: dict, rescued: dict, written: dict) -> Iterator[tuple[str, int, tuple[int, ...], object]]:
    """(path, kind, array indices, value) of all that an ingested line held, as it was written."""
    for key, v in typed.items():
        if key != "messages":
            yield from leaves(written.get(key, v), key)
        else:
            for i, row in enumerate(v or ()):
                for k, x in (row or {}).items():
                    yield from leaves(written.get(f"messages[{i}].{k}", x), f"messages[].{k}", (i,))
    for key, v in rescued.items():
        at = _INDEXED.fullmatch(key)
        yield from leaves(v, f"messages[]{at[2]}" if at else key, (int(at[1]),) if at else ())


def goal(path: str, approved: dict[str, str]) -> str:
    """The target path that a path stands for, by its own name or that of what holds it; empty without one."""
    for _ in range(len(approved) + 1):
        if path in GOALS:
            return path
        top = max((x for x in approved if path == x or path.startswith((f"{x}.", f"{x}["))), key=len, default=None)
        if top is None:
            return ""
        path = approved[top] + path[len(top):]
    return ""


def approvals(renames: Iterable[tuple[str, str]], user: dict[str, str] = APPROVED) -> dict[str, str]:
    """Approved names: the user's, and of each set of paths that renames join, what is no target to the one that is.

    renames(one path, the other) are those of a drift report, in either direction. A set with several targets proves
    that they are confused somewhere, and approves none.
    """
    near: dict[str, set[str]] = defaultdict(set)
    for a, b in renames:
        near[a].add(b)
        near[b].add(a)
    groups, seen = [], set()
    for start in sorted(near):
        todo, group = [start], set()
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo.extend(near[x])
        if start not in seen:
            groups.append(sorted(group))
        seen |= group
    out = dict(user)
    while True:  # a name may be known only once that of its holder is
        found = dict(out)
        for group in groups:
            goals = {x: goal(x, out) for x in group}
            if len(targets := {g for g in goals.values() if g}) == 1:
                found |= {x: next(iter(targets)) for x, g in goals.items() if not g}
        for name, target in list(found.items()):
            for top, to in list(found.items()):
                if name.startswith((f"{top}.", f"{top}[")) and (moved := to + name[len(top):]) not in GOALS:
                    found.setdefault(moved, target)
        if found == out:
            return out
        out = found


def replay(typed: dict, rescued: dict, approved: dict[str, str]) -> tuple[dict, dict]:
    """Approved rescued values moved into the typed fields that are still null; the rest stays rescued.

    A message's own fields go first; those inside its content fill what is then still null.
    """
    done = set()
    for path, value in list(rescued.items()):  # messages under another name or kept as JSON text
        if goal(path, approved) == "messages" and not typed.get("messages"):
            inner = value
            if isinstance(value, str):
                try:
                    inner = json.loads(value)
                except (ValueError, RecursionError):
                    continue
            if isinstance(inner, list):
                more, left, _ = enforce({"messages": inner})
                typed = typed | more
                rescued = {k: v for k, v in rescued.items() if k != path} | left
    for path, value in sorted(rescued.items(), key=lambda x: isinstance(x[1], dict)):
        at = _INDEXED.fullmatch(path)
        used = False
        if at and at[2]:
            name, row = f"messages[]{at[2]}", typed["messages"][int(at[1])]
            for place, x in [(name, value)] + ([(f"{name}.{k}", x) for k, x in value.items()] if isinstance(value, dict) else []):
                field = goal(place, approved).partition("[].")[2]
                if field and row[field] is None:
                    cell, ok = cast(x, MESSAGE[field])
                    if ok and cell is not None:
                        row[field] = cell
                        used = used or not isinstance(value, dict)
        elif not at:
            field = goal(path, approved)
            if field in TARGET and field != "messages" and typed.get(field) is None:
                cell, ok = cast(json.dumps(value, ensure_ascii=False) if TARGET[field] == "string" and isinstance(value, dict | list) else value, TARGET[field])
                if ok:
                    typed[field] = cell
                    used = True
        if used:
            done.add(path)
    return typed, {path: value for path, value in rescued.items() if path not in done}


_MESSAGES = T.ArrayType(T.StructType([T.StructField(k, T.StringType() if v == "string" else T.LongType()) for k, v in MESSAGE.items()]))
_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "array<bigint>": T.ArrayType(T.LongType()), "messages": _MESSAGES}
_TYPED = [T.StructField(k, _TYPES[v]) for k, v in TARGET.items()]


_OWN = [*TARGET, "_status", "_rescued", "_written", "_paths"]


def ingest(lines: DataFrame) -> DataFrame:
    """The lines' other columns with the typed ones, ``_status``, ``_rescued``, ``_written`` and ``_paths``.

    One narrow pass in Arrow batches: no shuffle, but where the scan has fewer tasks than cores.
    """
    keep = [f for f in lines.schema.fields if f.name not in (*_OWN, "line")]
    fields = [*keep, T.StructField("_status", T.StringType()), *_TYPED, T.StructField("_rescued", T.StringType()), T.StructField("_written", T.StringType()), T.StructField("_paths", T.ArrayType(T.StringType()))]
    names, kinds = [f.name for f in keep], {f.name: to_arrow_type(f.dataType) for f in _TYPED}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [parse_line(x) for x in batch.column("line").to_pylist()]
            parts = [enforce(v) if v is not None else ({}, {}, {}) for _, v in parsed]
            paths = [path_kinds(v) if v is not None else [] for _, v in parsed]
            cells = [batch.column(n) for n in names] + [pa.array([s for s, _ in parsed], pa.string())]
            cells += [pa.array([t.get(k) for t, _, _ in parts], kind) for k, kind in kinds.items()]
            cells += [pa.array([json.dumps(p[i], ensure_ascii=False) if p[i] else None for p in parts], pa.string()) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([*cells, pa.array(paths, pa.list_(pa.string()))], [f.name for f in fields])

    return spread(lines.select(*names, "line")).mapInArrow(run, T.StructType(fields))


def promote(ingested: DataFrame, approved: dict[str, str]) -> DataFrame:
    """Replays ``_rescued`` of an ingested table into its typed columns, without the source lines."""
    names, kinds = ingested.columns, {f.name: to_arrow_type(f.dataType) for f in _TYPED}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = {n: batch.column(n) for n in names}
            rows = batch.select([*TARGET, "_rescued"]).to_pylist()
            pairs = [replay({k: row[k] for k in TARGET}, json.loads(row["_rescued"]), approved) if row["_rescued"] else (row, {}) for row in rows]
            cells |= {k: pa.array([t.get(k) for t, _ in pairs], kind) for k, kind in kinds.items()}
            cells["_rescued"] = pa.array([json.dumps(r, ensure_ascii=False) if r else None for _, r in pairs], pa.string())
            yield pa.RecordBatch.from_arrays([cells[n] for n in names], names)

    return ingested.mapInArrow(run, ingested.schema)
