"""One JSON Patch set applied to one document: add, replace and remove, all or nothing.

Sets reach this code checked: at least one operation, known ones only, pointers and values that can be read
(:func:`millrace.operators.model.valid_set`). What is left to find out is whether they fit the document.
"""

from __future__ import annotations

import json

# A document that does not exist, as opposed to one that is null.
MISSING = object()


class PatchError(ValueError):
    """An operation does not apply; the whole set is void."""


def _steps(path: str) -> list[str]:
    if path == "":
        return []
    if not path.startswith("/"):
        raise PatchError(f"not a pointer: {path}")
    return [s.replace("~1", "/").replace("~0", "~") for s in path[1:].split("/")]


def _index(step: str, size: int) -> int:
    if not step.isdigit() or (len(step) > 1 and step[0] == "0") or int(step) >= size:
        raise PatchError(f"no element {step}")
    return int(step)


def _inside(node, step: str):
    if isinstance(node, dict):
        if step not in node:
            raise PatchError(f"no member {step}")
        return node[step]
    if isinstance(node, list):
        return node[_index(step, len(node))]
    raise PatchError(f"no container for {step}")


def _put(parent, key, new, undo: list) -> None:
    """Set a member or an element that is there, or a new member."""
    old = parent[key] if isinstance(parent, list) or key in parent else MISSING
    parent[key] = new
    undo.append((parent.pop, key) if old is MISSING else (parent.__setitem__, key, old))


def _change(root, op: str, path: str, steps: list[str], value: str | None, undo: list) -> None:
    parent = root
    for step in steps[:-1]:
        parent = _inside(parent, step)
    last = steps[-1]
    if op == "add" and isinstance(parent, list):
        place = len(parent) if last == "-" else _index(last, len(parent) + 1)
        parent.insert(place, json.loads(value or "null"))
        undo.append((parent.pop, place))
    elif op == "add":
        if not isinstance(parent, dict):
            raise PatchError(f"no container for {path}")
        _put(parent, last, json.loads(value or "null"), undo)
    else:
        _inside(parent, last)
        key = last if isinstance(parent, dict) else int(last)
        if op == "replace":
            _put(parent, key, json.loads(value or "null"), undo)
        else:
            old = parent.pop(key)
            undo.append((parent.insert if isinstance(parent, list) else parent.__setitem__, key, old))


def apply_set(document, operations: list[tuple[str, str, str | None]]):
    """The patched document, or :data:`MISSING` once its root is removed. Operations are ``(op, path, value as JSON)``.

    The document is changed in place, and put back as it was if an operation fails, so a set costs what it
    touches, however large the document is. A document that is missing reads as null.
    """
    result = document
    undo: list[tuple] = []
    try:
        for op, path, value in operations:
            op, steps = op.lower(), _steps(path)
            if op not in ("add", "replace", "remove"):
                raise PatchError(f"unknown operation {op}")
            if steps:
                _change(None if result is MISSING else result, op, path, steps, value, undo)
            else:
                result = MISSING if op == "remove" else json.loads(value or "null")
    except (PatchError, ValueError):
        for step in reversed(undo):
            step[0](*step[1:])
        raise
    return result
