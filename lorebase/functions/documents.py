"""Helpers on single JSON documents, for use inside Arrow-batched functions: path removal, condition sets, differences."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def pointer_parts(pointer: str) -> list[str]:
    return [p.replace("~1", "/").replace("~0", "~") for p in pointer.split("/")[1:]]


def pointer_escape(part: str) -> str:
    return part.replace("~", "~0").replace("/", "~1")


def remove_path(node: Any, parts: list[str]) -> int:
    """Deletes the map members at a path ('*': any member or item) and returns how many. A list index is a step, never a target."""
    if not parts or not isinstance(node, dict | list):
        return 0
    head, rest = parts[0], parts[1:]
    if isinstance(node, list):
        at = range(len(node)) if head == "*" else [int(head)] if head.isdigit() and int(head) < len(node) else []
        return sum(remove_path(node[i], rest) for i in at) if rest else 0
    keys = list(node) if head == "*" else [head] if head in node else []
    if rest:
        return sum(remove_path(node[k], rest) for k in keys)
    for k in keys:
        del node[k]
    return len(keys)


def dump(doc: Any) -> str:
    return json.dumps(doc, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def json_remove_paths(doc: Column, pointers: list[str]) -> Column:
    """struct(doc, removed) of a JSON string column."""
    parts = [pointer_parts(p) for p in pointers]

    @F.pandas_udf("doc string, removed int")
    def run(docs: pd.Series) -> pd.DataFrame:
        rows = []
        for text in docs:
            try:
                node = json.loads(text)
            except (TypeError, ValueError):
                rows.append((text, 0))
                continue
            n = sum(remove_path(node, p) for p in parts)
            rows.append((dump(node), n))
        return pd.DataFrame(rows, columns=["doc", "removed"])

    return run(doc)


def differences(before: Any, after: Any, path: str = "") -> list[tuple[str, str, str, str]]:
    """(path, op, old, new) of each difference of two documents: maps by sorted key, everything else as a whole."""
    if isinstance(before, dict) and isinstance(after, dict):
        out = []
        for key in sorted(before.keys() | after.keys()):
            here = f"{path}/{pointer_escape(key)}"
            if key not in before:
                out.append((here, "add", "", _scalar(after[key])))
            elif key not in after:
                out.append((here, "remove", _scalar(before[key]), ""))
            else:
                out += differences(before[key], after[key], here)
        return out
    return [] if before == after else [(path, "replace", _scalar(before), _scalar(after))]


def _scalar(value: Any) -> str:
    return value if isinstance(value, str) else dump(value)


def doc_diff(before: Column, after: Column, most: int = 50) -> Column:
    """struct(changes array<struct<path,op,old,new>>, truncated) between two JSON strings; a null side is an empty document."""

    @F.pandas_udf("changes array<struct<path:string,op:string,old:string,new:string>>, truncated boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b, strict=True):
            found = differences(json.loads(x) if x else {}, json.loads(y) if y else {})
            rows.append(([dict(zip(("path", "op", "old", "new"), f, strict=True)) for f in found[:most]], len(found) > most))
        return pd.DataFrame(rows, columns=["changes", "truncated"])

    return run(before, after)
