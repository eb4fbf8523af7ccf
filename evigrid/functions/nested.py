"""Parsing of uneven JSON records into step trees, and Merkle identities of their parts.

Plain Python on one record at a time, used from Arrow batches; nothing here knows Spark.
"""

from __future__ import annotations

import hashlib
import json
import re
from json.decoder import scanstring

#: Names under which a step keeps its child steps.
CHILD_KEYS = ("steps", "children", "substeps", "sub_steps", "subSteps", "child_steps")
#: Names of the fields that hold a step's items.
ITEM_KEYS = ("evidence", "reasoning")
#: Fields by which a task record is known from its wrapper.
RECORD_KEYS = ("trace", "steps", "task_id")
_BLANK = " \t\r\n\f\v ​‌‍⁠﻿"


_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"null|true|false|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")


def _no_constant(name: str):
    raise ValueError(name)


def parse(text: str):
    """The JSON value of a text, or None where it is unreadable; NaN and Infinity are no JSON. Depth is not bounded."""
    text = text.strip(_BLANK).strip()
    try:
        return json.loads(text, parse_constant=_no_constant)
    except RecursionError:
        pass
    except ValueError:
        return None
    try:
        return _parse_deep(text)
    except ValueError:
        return None


def _parse_deep(s: str):
    """A JSON text of any depth, with a stack of its own; as strict as the library's parser."""

    def skip(i: int) -> int:
        return _SPACE.match(s, i).end()

    def key_at(i: int) -> tuple[str, int]:
        if s[i : i + 1] != '"':
            raise ValueError(i)
        key, i = scanstring(s, i + 1, True)
        i = skip(i)
        if s[i : i + 1] != ":":
            raise ValueError(i)
        return key, skip(i + 1)

    stack: list[tuple] = []  # an open container, and for objects the key under way
    i = skip(0)
    while True:
        c = s[i : i + 1]
        if c in ("{", "["):
            i = skip(i + 1)
            if s[i : i + 1] != ("}" if c == "{" else "]"):
                if c == "{":
                    key, i = key_at(i)
                    stack.append(({}, key))
                else:
                    stack.append(([], None))
                continue
            value, i = ({} if c == "{" else []), i + 1
        elif c == '"':
            value, i = scanstring(s, i + 1, True)
        elif m := _SCALAR.match(s, i):
            value, i = json.loads(m[0]), m.end()
        else:
            raise ValueError(i)
        while True:  # put the value away, and close what ends with it
            i = skip(i)
            if not stack:
                if i != len(s):
                    raise ValueError(i)
                return value
            holder, key = stack[-1]
            is_object = isinstance(holder, dict)
            if is_object:
                holder[key] = value
            else:
                holder.append(value)
            c = s[i : i + 1]
            if c == ",":
                i = skip(i + 1)
                if is_object:
                    key, i = key_at(i)
                    stack[-1] = holder, key
                break
            if c != ("}" if is_object else "]"):
                raise ValueError(i)
            value, i = holder, i + 1
            stack.pop()


def opened(value):
    """The value itself, or what a string holds that is itself a JSON object or array."""
    if not isinstance(value, str) or value.strip(_BLANK)[:1] not in ("{", "["):
        return value
    inner = parse(value)
    return inner if isinstance(inner, (dict, list)) else value


def record_of(raw: str | None) -> dict | None:
    """The task record of a line, taken out of one outer key; None if the line is no JSON object."""
    if raw is None:
        return None
    value = parse(raw)
    if not isinstance(value, dict):
        return None
    if len(value) == 1 and not any(k in value for k in RECORD_KEYS):
        inner = opened(next(iter(value.values())))
        if isinstance(inner, dict):
            return inner
    return value


def _number(key: str) -> bool:
    return key.strip().lstrip("+-").isdigit()


def as_list(value) -> list | None:
    """A list in order: as it stands, or the values of an object by its numeric keys."""
    value = opened(value)
    if isinstance(value, list):
        return value
    if isinstance(value, dict) and value and all(_number(k) for k in value):
        return [value[k] for k in sorted(value, key=lambda k: int(k.strip()))]
    return None


def blank(value) -> bool:
    if value is None:
        return True
    if isinstance(value, str):
        return not value.strip(_BLANK).strip()
    if isinstance(value, dict):
        return blank(value["text"]) if "text" in value else not value
    return isinstance(value, list) and not value


def items_of(value) -> list:
    """The items of an evidence or reasoning field; a lone value is a list of one."""
    found = as_list(value)
    return [opened(v) for v in found] if found is not None else [opened(value)]


def canonical(value) -> str:
    try:
        return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except RecursionError:
        pass
    out, todo = [], [(value, None)]  # a value to write, or a text that is ready
    while todo:
        v, ready = todo.pop()
        if ready is not None:
            out.append(ready)
        elif isinstance(v, dict) and v:
            todo.append((None, "}"))
            for n, k in enumerate(sorted(v, reverse=True), 1):
                todo += [(v[k], None), (None, f"{',' if n < len(v) else '{'}{json.dumps(k, ensure_ascii=False)}:")]
        elif isinstance(v, list) and v:
            todo.append((None, "]"))
            for n, x in enumerate(reversed(v), 1):
                todo += [(x, None), (None, "," if n < len(v) else "[")]
        else:
            out.append(json.dumps(v, ensure_ascii=False))
    return "".join(out)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:32]


def step_lists(record: dict) -> list:
    """The top list of steps: of the record, or of its trace."""
    trace = opened(record.get("trace"))
    holder = trace if isinstance(trace, dict) and "steps" in trace else record
    return as_list(holder.get("steps")) or []


class _Frame:
    """A step under way: its object, its place, and what its children have left."""

    __slots__ = ("body", "kids", "parent", "path", "pos", "rows")

    def __init__(self, body, path: str, pos: int, parent):
        self.body, self.path, self.pos, self.parent = body, path, pos, parent
        self.kids, self.rows = [], []  # (position, hash) and bridge rows of the children


def walk(record: dict) -> list[list]:
    """Occurrences of a record's objects: [node, path, pos, ordinal, parent_path, hash, parent_hash, body].

    Objects are hashed bottom-up: a body holds the object's own fields and, for its parts, their
    hashes, so equal subtrees have equal hashes wherever they occur. The walk keeps its own stack,
    so that depth is not bounded by Python's.
    """
    out: list[list] = []
    root = _Frame(None, "", 1, None)
    todo: list[tuple[_Frame, bool]] = []

    def push(steps: list, parent: _Frame) -> None:
        for pos, step in enumerate(steps, 1):
            if isinstance(step := opened(step), dict):
                todo.append((_Frame(step, f"{parent.path}.{pos}" if parent.path else str(pos), pos, parent), False))

    def close(frame: _Frame, node: str, body: dict) -> str:
        text = canonical(body)
        h = digest(text)
        for row in frame.rows:
            row[6] = h
        mine = [node, frame.path, 0, frame.pos, frame.parent.path if frame.parent else None, h, None, text]
        out.append(mine)
        if frame.parent:
            frame.parent.kids.append([frame.pos, h])
            frame.parent.rows.append(mine)
        return h

    push(step_lists(record), root)
    while todo:
        frame, seen = todo.pop()
        step = frame.body
        if not seen:
            todo.append((frame, True))
            for key in CHILD_KEYS:
                if key in step and (children := as_list(step[key])) is not None:
                    push(children, frame)
            continue
        items = []
        for node in ITEM_KEYS:
            for at, value in enumerate(items_of(step[node]) if node in step else (), 1):
                if not blank(value):
                    text = canonical({"node": node, "value": value})
                    row = [node, frame.path, at, at, frame.path, digest(text), None, text]
                    items.append([node, at, row[5]])
                    frame.rows.append(row)
                    out.append(row)
        own = {k: opened(v) for k, v in step.items() if k not in CHILD_KEYS and k not in ITEM_KEYS}
        close(frame, "step", {"node": "step", "fields": own, "items": items, "steps": sorted(frame.kids)})
    fields = {k: opened(v) for k, v in record.items() if k not in ("trace", "steps")}
    if isinstance(trace := opened(record.get("trace")), dict):
        fields["trace"] = {k: v for k, v in trace.items() if k != "steps"}
    close(root, "trace", {"node": "trace", "fields": fields, "steps": sorted(root.kids)})
    return out
