"""JSON records as (path, kind, value) rows with exact number spelling."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, types as T


class _Number(str):
    pass


def _kind(value) -> str:
    return "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, _Number) \
        else "string" if isinstance(value, str) else "array" if isinstance(value, list) else "object"


def field_rows(text: str) -> Iterator[tuple[str, str | None, str, str | None, int]]:
    """(path, parent, kind, value, children) of every member, the root path being ''."""
    pending = [("", None, json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_Number))]
    while pending:
        path, parent, value = pending.pop()
        kind = _kind(value)
        members = enumerate(value) if kind == "array" else value.items() if kind == "object" else ()
        scalar = json.dumps(value, ensure_ascii=False) if kind in ("boolean", "null") else None if kind in ("array", "object") else str(value)
        yield path, parent, kind, scalar, len(value) if kind in ("array", "object") else 0
        pending.extend((f"{path}/{str(k).replace('~', '~0').replace('/', '~1')}", path, v) for k, v in members)


def flatten_records(records: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """One row per member of every record, identified by ``keys``."""
    schema = T.StructType([records.schema[k] for k in keys] + [
        T.StructField("path", T.StringType()), T.StructField("parent", T.StringType()), T.StructField("kind", T.StringType()),
        T.StructField("value", T.StringType()), T.StructField("children", T.LongType())])

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *ids, text in zip(*[batch[k] for k in keys], batch[raw]):
                rows.extend((*ids, *row) for row in field_rows(text))
                if len(rows) >= 20_000:
                    yield pd.DataFrame(rows, columns=schema.fieldNames())
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=schema.fieldNames())

    return records.select(*keys, raw).mapInPandas(split, schema)


class PathTrie:
    """Paths of many records as one tree: per node how often it occurs, as what, and with how many children."""

    #: A node is [occurrences, nulls, children, kinds, nodes below by name].
    def __init__(self) -> None:
        self.root, self.nodes = [0, 0, 0, set(), {}], 1

    def add(self, text: str) -> None:
        pending = [(self.root, json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_Number))]
        while pending:
            node, value = pending.pop()
            kind = _kind(value)
            node[0] += 1
            node[1] += kind == "null"
            node[3].add(kind)
            if kind not in ("array", "object"):
                continue
            node[2] += len(value)
            for name, below in enumerate(value) if kind == "array" else value.items():
                child = node[4].get(str(name))
                if child is None:
                    child = node[4][str(name)] = [0, 0, 0, set(), {}]
                    self.nodes += 1
                pending.append((child, below))

    def rows(self) -> Iterator[tuple[str, int, int, int, list[str]]]:
        """(path, occurrences, nulls, children, kinds) of every node."""
        pending = [("", self.root)]
        while pending:
            path, node = pending.pop()
            if node[0]:
                yield path, node[0], node[1], node[2], sorted(node[3])
            pending.extend((f"{path}/{name.replace('~', '~0').replace('/', '~1')}", below) for name, below in node[4].items())


def path_counts(records: DataFrame, raw: str = "raw", most: int = 200_000) -> DataFrame:
    """(path, rows, nulls, children, kinds) as counted by each task: a row per path, whatever the records.

    A tree that grows over ``most`` nodes is given away and begun anew, so records with ever new names need no more memory.
    """
    names = ["path", "rows", "nulls", "children", "kinds"]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = PathTrie()
        for batch in batches:
            for text in batch[raw]:
                if text is not None:
                    trie.add(text)
                if trie.nodes > most:
                    yield pd.DataFrame(list(trie.rows()), columns=names)
                    trie = PathTrie()
        if trie.root[0]:
            yield pd.DataFrame(list(trie.rows()), columns=names)

    return records.select(raw).mapInPandas(count, "path string, rows bigint, nulls bigint, children bigint, kinds array<string>")


def _shown(value) -> str:
    kind = _kind(value)
    if kind in ("array", "object"):
        return f"{kind.capitalize()} · {len(value)} {'items' if kind == 'array' else 'fields'}"
    return str(value) if kind == "number" else json.dumps(value, ensure_ascii=False)


def changed_members(left: str, right: str) -> Iterator[tuple[str, str, str, str, str, str]]:
    """(path, change, left kind, left, right kind, right) of the highest members that differ."""
    pending = [("", *(json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_Number) for text in (left, right)))]
    while pending:
        path, a, b = pending.pop()
        kinds = _kind(a), _kind(b)
        if kinds[0] != kinds[1] or kinds[0] not in ("array", "object"):
            if kinds[0] != kinds[1] or a != b:
                yield path or "(root)", "changed", kinds[0], _shown(a), kinds[1], _shown(b)
            continue
        sides = [dict(enumerate(x)) if kinds[0] == "array" else x for x in (a, b)]
        for name in {**sides[0], **sides[1]}:
            below = f"{path}/{str(name).replace('~', '~0').replace('/', '~1')}"
            if name not in sides[1]:
                yield below, "removed", _kind(sides[0][name]), _shown(sides[0][name]), "missing", "Not present"
            elif name not in sides[0]:
                yield below, "added", "missing", "Not present", _kind(sides[1][name]), _shown(sides[1][name])
            else:
                pending.append((below, sides[0][name], sides[1][name]))
