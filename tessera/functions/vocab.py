"""Vocabulary, identifiers and value conversion of the code graph."""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
NODE_TYPES = ("file", "module", "function", "struct", "enum", "trait", "impl", "type_alias", "const", "static", "macro", "crate_root")
EDGE_TYPES = ("contains", "imports", "calls", "references", "implements_trait", "owns", "borrows", "expands_to", "uses_unsafe", "lifetime_scope", "changes_with")

NODES = "id string, type string, payload string"
EDGES = "from_id string, to_id string, edge_type string"
DEAD = "id string"


def check(name: str, allowed: tuple[str, ...]) -> str:
    """``name`` if the vocabulary has it, else an error."""
    if name not in allowed:
        raise ValueError(f"unknown type {name!r}")
    return name


def file_part(node_id: Column) -> Column:
    """The file of a node id: what stands before the first ``#``."""
    return F.substring_index(node_id, "#", 1)


def is_entry(payload: Column) -> Column:
    """Functions that are alive by themselves: main, public ones, tests and benchmarks."""
    return F.coalesce((payload == "main") | payload.startswith("pub::") | payload.startswith("test::") | payload.startswith("bench::"), F.lit(False))


def canonical_name(payload: Column) -> Column:
    """A function's bare name, without its visibility, test and benchmark marks."""
    return F.regexp_replace(payload, "^(?:(?:pub|test|bench)::)+", "")


def module_path(file_id: Column) -> Column:
    """``crate::a::b`` for ``./src/a/b.rs``; lib.rs and main.rs are the crate, mod.rs its folder."""
    rel = F.regexp_replace(F.regexp_replace(file_id, r"^\./", ""), "^src/", "")
    rel = F.regexp_replace(rel, r"\.rs$", "")
    return F.when(rel.isin("", "lib", "main"), "crate").otherwise(F.concat(F.lit("crate::"), F.regexp_replace(F.replace(rel, F.lit("/"), F.lit("::")), "::mod$", "")))


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression for whole strings.

    ``*`` and ``?`` also match ``/``; ``**`` must be a whole path component and matches any
    number of them; ``[...]`` and ``[!...]`` are character sets.
    """
    out, i, n = [], 0, len(pattern)
    while i < n:
        c = pattern[i]
        if c == "*":
            j = i
            while j < n and pattern[j] == "*":
                j += 1
            if j - i > 2:
                raise ValueError("wildcards are either * or **")
            if j - i == 2:
                if (i and pattern[i - 1] != "/") or (j < n and pattern[j] != "/"):
                    raise ValueError("** must be a whole path component")
                out.append("(?:.*/)?" if j < n else ".*")
                j += j < n
            else:
                out.append(".*")
            i = j
            continue
        if c == "?":
            out.append(".")
        elif c == "[":
            end = pattern.find("]", i + (3 if pattern[i + 1 : i + 2] == "!" else 2))
            if end < 0:
                raise ValueError("unclosed character set")
            body = pattern[i + 1 : end]
            negated, body = body.startswith("!"), body.removeprefix("!")
            out.append("[" + ("^" if negated else "") + re.sub(r"([\\\]\[&^])", r"\\\1", body) + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def json_value(value: object) -> object:
    """A result cell as JSON: no NaN or infinity, bytes as numbers, nested values likewise."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, bytes | bytearray):
        return list(value)
    if isinstance(value, list | tuple | set):
        return [json_value(x) for x in value]
    if isinstance(value, dict):
        return {str(k): json_value(v) for k, v in value.items()}
    return value if value is None or isinstance(value, bool | int | str) else str(value)


def tsv_line(row: tuple) -> str:
    """A row with one cell between tabs: text as it is, other values as JSON."""
    return "\t".join(x if isinstance(x, str) else json.dumps(json_value(x), ensure_ascii=False) for x in row)
