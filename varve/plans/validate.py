"""Static rules on variables and emits."""

from __future__ import annotations

from ..types import CompileError
from .ast import Branch, Call, Each, Flow, Program, Ref, Tap


def _nested(flows: tuple[Flow, ...], where: str, taken: set[str], local: bool) -> None:
    """``taken``: names that a tap here may not write; taps add to it, and stay
    visible outside unless the body is a loop's."""
    scope = set(taken) if local else taken
    for flow in flows:
        for step in flow.steps:
            if isinstance(step, Call) and step.name == "emit":
                raise CompileError(f"emit is not allowed inside {where}")
            if isinstance(step, Tap):
                if step.name in scope:
                    raise CompileError(f"${step.name} is assigned more than once")
                scope.add(step.name)
            _step(step, scope)


def _step(step, taken: set[str]) -> None:
    if isinstance(step, Each):
        if step.var in taken:
            raise CompileError(f"the loop variable ${step.var} hides another variable")
        _nested(step.body, "each", taken | {step.var}, True)
    elif isinstance(step, Branch):
        before = set(taken)
        bodies = [b for _, b in step.arms] + ([step.otherwise] if step.otherwise else [])
        for body in bodies:  # arms exclude each other but all write outside
            scope = set(before)
            _nested(body, "a branch", scope, False)
            taken |= scope


def emit_name(call: Call) -> str:
    """The name of an emit call; empty if it has none."""
    given = list(call.args) + [v for k, v in call.named if k == "name"]
    if len(given) > 1 or any(k != "name" for k, _ in call.named) or any(not isinstance(v, str) for v in given):
        raise CompileError("emit takes one name, a string")
    return given[0] if given else ""


def validate(program: Program) -> None:
    """Every variable has one writer; emits stand at top level and, where there
    are several, have different names."""
    taken: set[str] = set()
    for p in program.params:
        if p.name in taken:
            raise CompileError(f"${p.name} is declared more than once")
        taken.add(p.name)
    for flow in program.flows:
        for step in flow.steps:
            if isinstance(step, Tap):
                if step.name in taken:
                    raise CompileError(f"${step.name} is assigned more than once")
                taken.add(step.name)
    emits = []
    for flow in program.flows:
        for step in flow.steps:
            if isinstance(step, Call) and step.name == "emit":
                emits.append(emit_name(step))
            _step(step, taken)
    if len(emits) > 1 and ("" in emits or len(set(emits)) < len(emits)):
        raise CompileError("several emits need different names")


def reads(flow: Flow) -> set[str]:
    """Outer variables that a flow reads; ``$payload`` is the current value."""
    out: set[str] = set()

    def of(v, local: set[str]) -> None:
        if isinstance(v, Ref) and v.name not in local and v.name != "payload":
            out.add(v.name)

    def walk(flows: tuple[Flow, ...], local: set[str]) -> None:
        for f in flows:
            for s in f.steps:
                if isinstance(s, Ref):
                    of(s, local)
                elif isinstance(s, Call):
                    for v in [*s.args, *(v for _, v in s.named)]:
                        of(v, local)
                elif isinstance(s, Tap):
                    local.add(s.name)
                elif isinstance(s, Each):
                    walk(s.body, local | {s.var})
                elif isinstance(s, Branch):
                    for c, body in s.arms:
                        of(c.left, local)
                        of(c.right, local)
                        walk(body, local)
                    walk(s.otherwise or (), local)

    walk((flow,), set())
    return out


def writes(flow: Flow) -> set[str]:
    out: set[str] = set()

    def walk(flows) -> None:
        for f in flows:
            for s in f.steps:
                if isinstance(s, Tap):
                    out.add(s.name)
                elif isinstance(s, Branch):
                    for _, body in s.arms:
                        walk(body)
                    walk(s.otherwise or ())

    walk((flow,))
    return out


def ordered(program: Program, bound: set[str]) -> list[Flow]:
    """Flows so that each comes after those that write what it reads."""
    ready, left, out = set(bound), list(program.flows), []
    while left:
        now = [f for f in left if reads(f) <= ready]
        if not now:
            missing = sorted(set.union(*(reads(f) for f in left)) - ready)
            raise CompileError(f"Deadlock or unresolvable variable dependency: {', '.join('$' + m for m in missing)}")
        for f in now:
            out.append(f)
            ready |= writes(f)
        left = [f for f in left if f not in now]
    return out
