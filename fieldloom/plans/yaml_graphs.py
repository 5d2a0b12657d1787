"""Graphs written as YAML: nodes by name, each a registered recipe with arguments. The same graph as in Python."""

from __future__ import annotations

from typing import Any

import yaml

from fieldloom.errors import PlanError
from fieldloom.plans.recipes import Node, registered

MOST_BYTES, MOST_DEPTH, MOST_TREE_NODES = 1024 * 1024, 32, 1000


class _Loader(yaml.SafeLoader):
    """Plain trees only: no anchors, aliases, tags or repeated keys."""

    depth = count = 0

    def compose_node(self, parent, index):
        e = self.peek_event()
        if isinstance(e, yaml.AliasEvent) or getattr(e, "anchor", None) or getattr(e, "tag", None):
            raise PlanError("anchors, aliases and tags are not allowed")
        self.count += 1
        self.depth += 1
        if self.depth > MOST_DEPTH or self.count > MOST_TREE_NODES:
            raise PlanError("the document is too deep or has too many parts")
        node = super().compose_node(parent, index)
        self.depth -= 1
        return node

    def construct_mapping(self, node, deep=False):
        names = [k.value for k, _ in node.value]
        if len(set(names)) != len(names):
            raise PlanError("a key is repeated")
        return super().construct_mapping(node, deep)


def load(text: str, parameters: dict[str, Any] | None = None) -> Node | dict[str, Node]:
    """Build the graph of {parameters: [...], nodes: {name: {recipe, arguments}}, output: name or {name: node}}.

    An argument is {parameter: p}, {node: n}, {node: n, column: c, type: integer or string}, {literal: v}, {list: [...]}
    or {mapping: {...}}. Nodes may be in any order but not in a circle; nothing in a string is replaced.
    """
    if len(text.encode()) > MOST_BYTES:
        raise PlanError("the document is too large")
    try:
        doc = yaml.load(text, _Loader)  # noqa: S506
    except yaml.YAMLError as e:
        raise PlanError(f"not YAML: {e}") from e
    if not isinstance(doc, dict) or set(doc) - {"parameters", "nodes", "output"} or not {"nodes", "output"} <= set(doc):
        raise PlanError("a document has nodes, an output and perhaps parameters")
    given = parameters or {}
    if set(doc.get("parameters", [])) != set(given):
        raise PlanError(f"parameters must be {doc.get('parameters', [])}")
    built: dict[str, Node] = {}

    def node(name: str, above: tuple[str, ...]) -> Node:
        if name in above:
            raise PlanError(f"{name} depends on itself")
        if name not in doc["nodes"]:
            raise PlanError(f"no such node: {name}")
        if name not in built:
            d = doc["nodes"][name]
            if not isinstance(d, dict) or set(d) - {"recipe", "arguments"} or "recipe" not in d:
                raise PlanError(f"{name} needs a recipe and perhaps arguments")
            made = registered(d["recipe"])(**{k: bound(v, (*above, name)) for k, v in (d.get("arguments") or {}).items()})
            if not isinstance(made, Node):
                raise PlanError(f"{d['recipe']} is a workflow and can't be a node")
            built[name] = made.as_(name)
        return built[name]

    def bound(v, above: tuple[str, ...]):
        match v:
            case {"parameter": p, **rest} if not rest and p in given:
                return given[p]
            case {"node": n, "column": c, "type": ("integer" | "string") as t, **rest} if not rest:
                return node(n, above).value(c, {"integer": int, "string": str}[t])
            case {"node": n, **rest} if not rest:
                return node(n, above)
            case {"literal": x, **rest} if not rest:
                return x
            case {"list": list() as xs, **rest} if not rest:
                return [bound(x, above) for x in xs]
            case {"mapping": dict() as m, **rest} if not rest:
                return {k: bound(x, above) for k, x in m.items()}
        raise PlanError(f"not an argument: {v!r}")

    out = doc["output"]
    return node(out, ()) if isinstance(out, str) else {k: node(n, ()) for k, n in out.items()}
