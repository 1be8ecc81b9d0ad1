"""Named, composable plans: modules, the compiler that binds roles, and compiled plans.

Recording a computation is building a lazy DataFrame, so a module is a Python
function with a name; the compiler checks that every role it asks for has an
implementation, applies the user's own stages to what it gives, and keeps a
bootstrap that runs once before the first invocation.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]
Body = Callable[[Tables, Mapping[str, Any]], Tables]
Stage = Callable[[DataFrame], DataFrame]
ROLES = ("backend", "index", "aggregator", "model", "codec", "data_source", "peer_selector", "protocol")


class PlanError(ValueError):
    """A module that cannot be compiled or invoked as asked."""


@dataclass(frozen=True)
class Module:
    """``body(inputs, roles)`` gives named outputs; ``inputs`` have schemas as DDL."""

    name: str
    body: Body
    inputs: Mapping[str, str] = field(default_factory=dict)
    roles: tuple[str, ...] = ()
    bootstrap: Callable[[Mapping[str, Any]], None] | None = None

    def call(self, inputs: Tables, roles: Mapping[str, Any]) -> Tables:
        """Use the module inside another one's body."""
        return self.body(inputs, roles)


class Compiler:
    """Binds roles and collects stages, then compiles modules into plans."""

    def __init__(self, permissive: bool = False) -> None:
        self.permissive, self.bound, self.stages = permissive, {}, []

    def bind(self, role: str, implementation: Any) -> Compiler:
        if role not in ROLES:
            raise PlanError(f"no role {role}")
        self.bound[role] = implementation
        return self

    def push_stage(self, name: str, stage: Stage) -> Compiler:
        self.stages.append((name, stage))
        return self

    def insert_stage(self, at: int, name: str, stage: Stage) -> Compiler:
        self.stages.insert(at, (name, stage))
        return self

    def remove_stage(self, name: str) -> Compiler:
        self.stages = [s for s in self.stages if s[0] != name]
        return self

    def compile(self, module: Module) -> Plan:
        missing = [r for r in module.roles if r not in self.bound]
        if missing:
            raise PlanError(f"{module.name}: no implementation of {', '.join(missing)}")
        return Plan(module, dict(self.bound), list(self.stages), self.permissive)


class Plan:
    """A compiled module."""

    def __init__(self, module: Module, roles: dict[str, Any], stages: list[tuple[str, Stage]], permissive: bool) -> None:
        self.module, self.roles, self.stages, self.permissive, self.started = module, roles, stages, permissive, False

    def invoke(self, **inputs: DataFrame) -> Tables:
        """The outputs for these inputs, as lazy tables."""
        for name, ddl in self.module.inputs.items():
            if name not in inputs:
                raise PlanError(f"{self.module.name}: input {name} is missing")
            if not self.permissive:
                want = {f.name: f.dataType for f in inputs[name].sparkSession.createDataFrame([], ddl).schema}
                have = {f.name: f.dataType for f in inputs[name].schema}
                wrong = [c for c, t in want.items() if have.get(c) != t]
                if wrong:
                    raise PlanError(f"{self.module.name}: input {name} does not have {', '.join(wrong)} as declared")
        if not self.started and self.module.bootstrap:
            self.module.bootstrap(self.roles)
        self.started = True
        out = self.module.body(inputs, self.roles)
        for _, stage in self.stages:
            out = {k: stage(df) for k, df in out.items()}
        return out


@dataclass
class PeerPolicy:
    """Which peers a node talks to, as tables for :func:`loomfed.operators.health.peer_health_gate`."""

    spark: SparkSession
    blocked: set[str] = field(default_factory=set)
    allowed: set[str] | None = None

    def block_peer(self, peer: str) -> None:
        self.blocked.add(peer)

    def unblock_peer(self, peer: str) -> None:
        self.blocked.discard(peer)

    def set_allowlist(self, peers: set[str] | None) -> None:
        self.allowed = None if peers is None else set(peers)

    def blocklist(self) -> DataFrame:
        return self.spark.createDataFrame([(p,) for p in sorted(self.blocked)], "peer string")

    def allowlist(self) -> DataFrame | None:
        return None if self.allowed is None else self.spark.createDataFrame([(p,) for p in sorted(self.allowed)], "peer string")


def union_of_status(*tables: tuple[str, DataFrame]) -> DataFrame:
    """Status rows of several operators as one table ``kind, payload``; filter by kind to subscribe."""
    rows = [df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns)).alias("payload")) for kind, df in tables]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
