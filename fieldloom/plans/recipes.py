"""Recipes: sources, steps, data sets and workflows as a graph that can be planned, inspected and run."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom import checks
from fieldloom.errors import ContractError, FieldloomError, PlanError, TransformError
from fieldloom.operators.nested import bind_value
from fieldloom.plans.store import Store
from fieldloom.schema import conform, schema_digest
from fieldloom.sources.json_pages import constrained

#: A graph has so many nodes at most, and a run reads so many sources at most.
MOST_NODES, MOST_SOURCES = 10_000, 100
CHECKPOINTS = ("all", "outputs_only", "off")


class RunError(FieldloomError):
    """A run failed: its id, the node and the kind of failure, without the rows that the cause may quote."""

    def __init__(self, run_id: str, node: str, category: str):
        super().__init__(f"run {run_id} failed in {node} ({category})")
        self.run_id, self.node, self.category = run_id, node, category


@dataclass(frozen=True)
class Recipe:
    kind: str
    id: str
    revision: int
    fn: Callable
    schema: T.StructType | None = None
    keys: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    rules: Mapping[str, str] = field(default_factory=dict)
    #: A source's version of what it would read now; without one its results are never taken from the store.
    version: Callable | None = None
    deterministic: bool = True
    #: Looks at a source's arguments when the graph is built.
    check: Callable | None = None

    @property
    def name(self) -> str:
        return f"{self.id}@{self.revision}"

    def __call__(self, **arguments) -> Node | dict[str, Node]:
        if self.kind == "workflow":
            return {k: replace(n, alias=n.alias or k) for k, n in self.fn(**arguments).items()}
        if self.kind == "dataset":
            return Node(self, {"rows": self.fn(**arguments)})
        if self.check:
            self.check(arguments)
        return Node(self, arguments)


@dataclass(frozen=True)
class Bound:
    """A value that a run takes from the one row of a node."""

    node: Node
    column: str
    type: type


@dataclass(frozen=True, eq=False)
class Node:
    recipe: Recipe
    arguments: dict[str, Any]
    alias: str = ""

    def as_(self, alias: str) -> Node:
        return replace(self, alias=alias)

    def value(self, column: str, kind: type) -> Bound:
        return Bound(self, column, kind)

    @property
    def inputs(self) -> list[Node]:
        return [n for v in self.arguments.values() for n in _nodes(v)]

    @property
    def key(self) -> str:
        """What the node computes, its inputs' keys included: equal keys are computed once in a run."""
        if "_key" not in self.__dict__:
            r = self.recipe
            contract = [schema_digest(r.schema) if r.schema else None, list(r.keys), list(r.order), dict(r.rules)]
            told = [r.kind, r.id, r.revision, contract, {k: _told(v) for k, v in sorted(self.arguments.items())}]
            self.__dict__["_key"] = hashlib.sha256(json.dumps(told, sort_keys=True, allow_nan=False).encode()).hexdigest()
        return self.__dict__["_key"]

    @property
    def label(self) -> str:
        return f"{self.recipe.name}:{self.alias or self.key[:8]}"


def _nodes(v) -> Iterable[Node]:
    if isinstance(v, Node):
        yield v
    elif isinstance(v, Bound):
        yield v.node
    elif isinstance(v, (list, tuple)):
        for x in v:
            yield from _nodes(x)
    elif isinstance(v, Mapping):
        for x in v.values():
            yield from _nodes(x)


def _told(v):
    if isinstance(v, Node):
        return {"node": v.key}
    if isinstance(v, Bound):
        return {"bound": [v.node.key, v.column, v.type.__name__]}
    if isinstance(v, (list, tuple)):
        return [_told(x) for x in v]
    if isinstance(v, Mapping):
        return {"map": {k: _told(x) for k, x in v.items()}}
    if v is None or isinstance(v, (bool, int, float, str)):
        return v
    raise PlanError(f"{type(v).__name__} can't be an argument")


_registry: dict[str, Recipe] = {}


def _add(r: Recipe) -> Recipe:
    if not r.id or r.revision < 1:
        raise PlanError("a recipe needs an id and a revision from 1")
    if have := _registry.get(r.name):
        if (have.fn.__module__, have.fn.__qualname__, have.kind) != (r.fn.__module__, r.fn.__qualname__, r.kind):
            raise PlanError(f"{r.name} is taken")
    _registry[r.name] = r
    return r


def source(id: str, revision: int, schema: T.StructType, *, version: Callable | None = None, check: Callable | None = None):
    """fn(spark, **arguments) -> DataFrame with the declared schema."""
    return lambda fn: _add(Recipe("source", id, revision, fn, schema, version=version, check=check))


def step(id: str, revision: int, *, deterministic: bool = True):
    """fn(**arguments) -> DataFrame; arguments that are nodes arrive as DataFrames."""
    return lambda fn: _add(Recipe("step", id, revision, fn, deterministic=deterministic))


def dataset(id: str, revision: int, schema: T.StructType | None, *, keys: Sequence[str], order: Sequence[str] = (), rules: Mapping[str, str] | None = None):
    """fn(**arguments) -> Node; its rows must keep the schema, the rules and the key."""
    return lambda fn: _add(Recipe("dataset", id, revision, fn, schema, tuple(keys), tuple(order), rules or {}))


def workflow(id: str, revision: int):
    """fn(**arguments) -> dict of nodes by output name."""
    return lambda fn: _add(Recipe("workflow", id, revision, fn))


def registered(name: str) -> Recipe:
    if name not in _registry:
        raise PlanError(f"no such recipe: {name}")
    return _registry[name]


def _outputs(target: Node | Mapping[str, Node]) -> dict[str, Node]:
    return {"result": target} if isinstance(target, Node) else dict(target)


def ordered(target: Node | Mapping[str, Node]) -> list[Node]:
    """Every different node, inputs first."""
    seen: dict[str, Node] = {}
    stack = [(n, False) for n in reversed(list(_outputs(target).values()))]
    while stack:
        n, done = stack.pop()
        if n.key in seen:
            continue
        if done:
            seen[n.key] = n
        else:
            stack += [(n, True), *((i, False) for i in n.inputs)]
    if len(seen) > MOST_NODES:
        raise PlanError("the graph has too many nodes")
    return list(seen.values())


def plan(target: Node | Mapping[str, Node]) -> list[dict]:
    """What a run would do, inputs first; reads nothing."""
    nodes = ordered(target)
    if sum(n.recipe.kind == "source" for n in nodes) > MOST_SOURCES:
        raise PlanError("the run would read too many sources")
    return [{"node": n.label, "key": n.key, "kind": n.recipe.kind, "inputs": sorted({i.key for i in n.inputs})} for n in nodes]


def recomputed(target: Node | Mapping[str, Node], forced: Iterable[str]) -> set[str]:
    """Keys of the nodes of the forced recipes or aliases, and of all that depend on them."""
    forced, out = set(forced), set()
    for n in ordered(target):
        if {n.recipe.name, n.alias, n.key} & forced or any(i.key in out for i in n.inputs):
            out.add(n.key)
    return out


def _fingerprint(n: Node, spark: SparkSession, known: dict[str, str | None]) -> str | None:
    """The node's key with the versions of all sources below it; None where one has no version or a step isn't deterministic."""
    r = n.recipe
    below = [known[i.key] for i in n.inputs]
    if not r.deterministic or None in below or (r.kind == "source" and (r.version is None or below)):
        return None
    version = r.version(spark, **n.arguments) if r.kind == "source" else ""
    return hashlib.sha256(json.dumps([n.key, version, below]).encode()).hexdigest()


def inspect(target: Node | Mapping[str, Node], store: Store, *, recompute: Iterable[str] = ()) -> dict[str, str]:
    """By label: 'stored', 'compute' or 'uncacheable'. Computes nothing."""
    again, known, out = recomputed(target, recompute), {}, {}
    for n in ordered(target):
        f = known[n.key] = _fingerprint(n, store.spark, known)
        out[n.label] = "uncacheable" if f is None else "stored" if n.key not in again and store.has(f) else "compute"
    return out


def run(
    target: Node | Mapping[str, Node], spark: SparkSession, store: Store | None = None, *, checkpoints: str = "all", recompute: Iterable[str] = (),
    observe: Callable[[dict], None] = lambda event: None,
) -> Any:
    """The DataFrame of a node, or a dict of them for a workflow.

    With a store, nodes whose fingerprint it holds are read from it and, by `checkpoints`, the computed ones (all, the
    outputs or none) are written to it. A failed run leaves what it had stored, and the next one goes on from there.
    """
    if checkpoints not in CHECKPOINTS:
        raise PlanError(f"checkpoints must be one of {CHECKPOINTS}")
    plan(target)
    outputs = _outputs(target)
    last, again = {n.key for n in outputs.values()}, recomputed(target, recompute)
    run_id, known, frames = uuid.uuid4().hex, {}, {}

    def tell(event: str, node: str = "", fingerprint: str = "", **more) -> None:
        observe({"event": event, "run_id": run_id, "node": node, **more})
        if store and event in ("run_started", "run_succeeded", "run_failed"):
            store.note("run", run_id, run_id, event[4:], node)
        elif store and fingerprint:
            store.note("node", node, run_id, event[5:], fingerprint)

    tell("run_started")
    need = _needed(target, spark, store, again, known)
    for n in ordered(target):
        if n.key not in need:
            continue
        f = known[n.key]
        try:
            if store and f and n.key not in again and store.has(f):
                frames[n.key] = store.get(f)
                tell("node_reused", n.label, f)
                continue
            df = _computed(n, spark, frames)
            if store and (checkpoints == "all" or (checkpoints == "outputs_only" and n.key in last)):
                f = f or uuid.uuid4().hex
                df = store.put(df, f, recipe=n.recipe.name, keys=n.recipe.keys, order=n.recipe.order)
                tell("node_stored", n.label, f)
            else:
                if n.recipe.keys:
                    checks.keys_unique(df, n.recipe.keys)
                if n.recipe.order and n.key in last:
                    df = df.orderBy(*[F.asc_nulls_last(c) for c in n.recipe.order])
                tell("node_computed", n.label)
            frames[n.key] = df
        except Exception as e:
            broken = isinstance(e, ContractError) or "contract: " in str(e)  # in-plan checks fail in the query
            category = "contract" if broken else "transform" if isinstance(e, TransformError) else "executor"
            tell("run_failed", n.label, category=category)
            raise RunError(run_id, n.label, category) from e
    tell("run_succeeded")
    got = {k: frames[n.key] for k, n in outputs.items()}
    return got["result"] if isinstance(target, Node) else got


def _needed(target, spark: SparkSession, store: Store | None, again: set[str], known: dict[str, str | None]) -> set[str]:
    """Keys of the nodes a run must read or compute: nothing below a stored one. Fills in the fingerprints."""
    nodes = ordered(target)
    for n in nodes:
        known[n.key] = _fingerprint(n, spark, known)
    need = {n.key for n in _outputs(target).values()}
    for n in reversed(nodes):
        f = known[n.key]
        if n.key in need and not (store and f and n.key not in again and store.has(f)):
            need |= {i.key for i in n.inputs}
    return need


def _computed(n: Node, spark: SparkSession, frames: Mapping[str, DataFrame]) -> DataFrame:
    def given(v):
        if isinstance(v, Node):
            return frames[v.key]
        if isinstance(v, Bound):
            return bind_value(frames[v.node.key], v.column, v.type)
        if isinstance(v, (list, tuple)):
            return [given(x) for x in v]
        return {k: given(x) for k, x in v.items()} if isinstance(v, Mapping) else v

    r, args = n.recipe, {k: given(v) for k, v in n.arguments.items()}
    df = args["rows"] if r.kind == "dataset" else r.fn(spark, **args) if r.kind == "source" else r.fn(**args)
    return constrained(conform(df, r.schema) if r.schema else df, r.rules)
