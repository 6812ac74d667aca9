"""Syntax of pipelines."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class TypeSpec:
    """kind, and for tensors, images and audio the rank or the dimensions (None:
    any); for composites their components."""

    kind: str
    dims: tuple[int | None, ...] | None = None
    items: tuple[TypeSpec, ...] | None = None


@dataclass(frozen=True)
class Param:
    name: str
    type: TypeSpec
    default: object = None


@dataclass(frozen=True)
class Slice:
    """One axis of an index: an integer, or a range."""

    index: int | None = None
    start: int | None = None
    stop: int | None = None
    step: int | None = None


@dataclass(frozen=True)
class Ref:
    """$name, a field of it, or index groups."""

    name: str
    field: str | None = None
    groups: tuple[tuple[Slice, ...], ...] = ()


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple = ()
    named: tuple[tuple[str, object], ...] = ()


@dataclass(frozen=True)
class Tap:
    name: str


@dataclass(frozen=True)
class Each:
    var: str
    body: tuple[Flow, ...]
    axis: int | None = None


@dataclass(frozen=True)
class Condition:
    left: object
    op: str
    right: object


@dataclass(frozen=True)
class Branch:
    """Arms of an if or a route: the first whose condition holds is taken."""

    arms: tuple[tuple[Condition, tuple[Flow, ...]], ...]
    otherwise: tuple[Flow, ...] | None = None


@dataclass(frozen=True)
class Flow:
    steps: tuple


@dataclass(frozen=True)
class Import:
    pack: str
    version: str
    action: str | None = None
    alias: str | None = None


@dataclass
class Program:
    imports: list[Import] = field(default_factory=list)
    plugins: list[tuple[str, str]] = field(default_factory=list)
    params: list[Param] = field(default_factory=list)
    flows: list[Flow] = field(default_factory=list)
