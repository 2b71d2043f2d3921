"""Mappings from source tables to nodes and edges: parsing, resolving, validating."""

from __future__ import annotations

import copy
import os
import re
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class NodeMapping:
    """One node type from one table.

    id_column names the node; properties maps columns to property names;
    merge_on names a property on which rows enrich nodes that are already there
    instead of making new ones; filter keeps rows whose column equals the value
    (compared as text); compound splits "key:value" entries of a packed column
    into properties; unique_rows makes a node of the first row of its id alone (by
    _ord where there is one), as for nodes that are taken from a table of edges.
    """

    name: str
    node_type: str
    table: str
    id_column: str
    properties: dict[str, str] = field(default_factory=dict)
    merge_on: str | None = None
    filter_column: str | None = None
    filter_value: str | None = None
    compound: dict[str, dict[str, str]] = field(default_factory=dict)
    unique_rows: bool = False
    enabled: bool = True


@dataclass(frozen=True)
class EdgeMapping:
    """One relation from one table: each end is a column whose value is looked up among
    a property of a node type. inverse names the relation of the swapped copy."""

    name: str
    rel_type: str
    table: str
    start_column: str
    start_type: str
    start_property: str
    end_column: str
    end_type: str
    end_property: str
    properties: dict[str, str] = field(default_factory=dict)
    inverse: str | None = None
    filter_column: str | None = None
    filter_value: str | None = None
    enabled: bool = True


def resolve_env(config, env: dict[str, str] | None = None):
    """A copy in which keys ``x_env`` become ``x`` with the variable's value (None if it
    is not set), and ``${NAME}`` in texts is replaced."""
    env = dict(os.environ) if env is None else env
    if isinstance(config, dict):
        out = {}
        for k, v in config.items():
            if isinstance(k, str) and k.endswith("_env") and isinstance(v, str):
                out[k[:-4]] = env.get(v)
            else:
                out[k] = resolve_env(v, env)
        return out
    if isinstance(config, list):
        return [resolve_env(v, env) for v in config]
    if isinstance(config, str):
        return re.sub(r"\$\{(\w+)\}", lambda m: env.get(m[1], m[0]), config)
    return copy.deepcopy(config)


def parse_mappings(config: dict[str, dict]) -> list[NodeMapping | EdgeMapping]:
    """Mappings in the order of the configuration; null entries are left out."""
    out: list[NodeMapping | EdgeMapping] = []
    for name, c in config.items():
        if not c:
            continue
        c = dict(c)
        kind = c.pop("kind", "node")
        out.append((NodeMapping if kind == "node" else EdgeMapping)(name=name, **c))
    return out


def active(mappings: list, tables: set[str], skip: set[str] = frozenset()) -> list:
    """Mappings that are enabled, not skipped, and whose table is there."""
    return [m for m in mappings if m.enabled and m.name not in skip and m.table in tables]


def validate(mappings: list, node_types: set[str], rel_types: set[str], properties: set[str], columns: dict[str, list[str]]) -> list[str]:
    """What is wrong with the mappings before anything runs: unknown types, relations,
    properties, missing tables and columns (merge columns too)."""
    bad: list[str] = []
    for m in mappings:
        there = columns.get(m.table)
        if there is None:
            bad.append(f"{m.name}: no table {m.table}")
        used = [m.id_column, *m.compound] if isinstance(m, NodeMapping) else [m.start_column, m.end_column]
        used += [*m.properties, *([m.filter_column] if m.filter_column else [])]
        bad += [f"{m.name}: no column {c} in {m.table}" for c in used if there is not None and c not in there]
        bad += [f"{m.name}: unknown property {p}" for p in m.properties.values() if p not in properties]
        if isinstance(m, NodeMapping):
            if m.node_type not in node_types:
                bad.append(f"{m.name}: unknown node type {m.node_type}")
            if m.merge_on and m.merge_on not in m.properties.values():
                bad.append(f"{m.name}: merge property {m.merge_on} is not mapped")
        else:
            bad += [f"{m.name}: unknown node type {t}" for t in (m.start_type, m.end_type) if t not in node_types]
            bad += [f"{m.name}: unknown relation {r}" for r in (m.rel_type, m.inverse) if r and r not in rel_types]
            bad += [f"{m.name}: unknown property {p}" for p in (m.start_property, m.end_property) if p not in properties]
    return bad


def load_yaml(path: str) -> dict:
    import yaml

    return yaml.safe_load(Path(path).read_text()) or {}
