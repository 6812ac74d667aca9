"""The registry of actions and the names they go by."""

from __future__ import annotations

import importlib
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from .plans.ast import Program
from .types import CompileError, ExecutionError, TypeMismatch, Value

VERSION = re.compile(r"v?\d+\.\d+\.\d+(?:[-+][\w.+-]+)?")


@dataclass(frozen=True)
class Action:
    """An action: what kinds it takes, its kernel, and how kind and dtype follow.

    ``result``: (kind, dtype name) of the input -> those of the output.
    """

    pack: str
    name: str
    kinds: frozenset[str]
    kernel: Callable[[Value, Args], Value]
    result: Callable[[tuple, Args], tuple] | None = None
    doc: str = ""

    @property
    def path(self) -> str:
        return f"{self.pack}/{self.name}"


#: Packs with a released version; the first names are those of the basics.
PACKS: dict[str, dict[str, Action]] = {}
#: Accelerated packs: actions of the same name in another pack.
TWINS = {
    "tensor_blas": ("tensor_basics", "concat repeat roll".split()),
    "linalg_blas": ("linalg_basics", "matmul dot outer inv det qr cholesky".split()),
    "image_opencv": ("image_basics", "rotate resize gaussian_blur morphology edge_detect sharpen".split()),
}
BUILT_IN = frozenset(("base", "math_basics", "tensor_basics", "tensor_stats", "nn_basics", "linalg_basics", "audio_basics", "image_basics", *TWINS))
PLUGINS = {"tensor_blas": "openblas", "linalg_blas": "openblas", "image_opencv": "opencv-bridge"}


def action(pack: str, name: str, kinds: str, result: Callable | None = None):
    """Register a kernel under ``pack/name`` for the given input kinds."""

    def put(kernel):
        PACKS.setdefault(pack, {})[name] = Action(pack, name, frozenset(kinds.split()), kernel, result, (kernel.__doc__ or "").strip())
        return kernel

    return put


def packs() -> dict[str, dict[str, Action]]:
    """All packs, with the twins."""
    for m in ("math", "shape", "stats", "nn", "linalg", "audio", "image", "base"):
        importlib.import_module(f".functions.{m}", __package__)
    for twin, (of, names) in TWINS.items():
        if twin not in PACKS:
            own = importlib.import_module(".functions.linalg", __package__).TWIN_KERNELS if twin == "linalg_blas" else {}
            own = importlib.import_module(".functions.image", __package__).TWIN_KERNELS if twin == "image_opencv" else own
            PACKS[twin] = {n: Action(twin, n, PACKS[of][n].kinds, own.get(n, PACKS[of][n].kernel), PACKS[of][n].result, PACKS[of][n].doc) for n in names}
    return PACKS


@dataclass
class Args:
    """Arguments as text: a named one wins over its aliases, those over the position."""

    positional: list[str] = field(default_factory=list)
    named: dict[str, str] = field(default_factory=dict)

    def text(self, *names: str, at: int | None = None) -> str | None:
        for n in names:
            if n in self.named:
                return self.named[n]
        return self.positional[at] if at is not None and at < len(self.positional) else None

    def number(self, *names: str, at: int | None = None, default: float | None = None, dtype=np.float64) -> float | None:
        """A float, rounded once to ``dtype``; unreadable text is the default."""
        t = self.text(*names, at=at)
        if t is None:
            return default
        try:
            return float(dtype(t.strip()))
        except ValueError:
            return default

    def integer(self, *names: str, at: int | None = None, default: int | None = None) -> int | None:
        t = self.text(*names, at=at)
        try:
            return int(t) if t is not None else default
        except ValueError:
            return default

    def flag(self, *names: str, at: int | None = None, default: bool = False) -> bool:
        t = self.text(*names, at=at)
        return default if t is None else t.strip().lower() in ("true", "1", "yes", "on")

    def whole(self, *names: str, at: int | None = None, default: int, dtype) -> int:
        """A whole number that fits an integer dtype, else an error."""
        t = self.text(*names, at=at)
        if t is None:
            return default
        try:
            v = int(t)
        except ValueError:
            try:
                x = float(t)
            except ValueError:
                raise ExecutionError(f"{t!r} is no number") from None
            if not math.isfinite(x) or x != int(x):
                raise ExecutionError(f"{t!r} is no whole number") from None
            v = int(x)
        info = np.iinfo(dtype)
        if not info.min <= v <= info.max:
            raise ExecutionError(f"{t} is out of range for {np.dtype(dtype).name}")
        return v

    def integers(self, *names: str, at: int | None = None) -> list[int]:
        """A list such as "[2,-1]", "(4, 16)" or "2,3"; required."""
        t = self.text(*names, at=at)
        if t is None:
            raise ExecutionError(f"argument {names[0]!r} is required")
        t = t.strip()
        if t[:1] + t[-1:] in ("[]", "()"):
            t = t[1:-1]
        try:
            return [int(x) for x in t.split(",") if x.strip()]
        except ValueError:
            raise ExecutionError(f"{t!r} is no list of integers") from None


def apply(act: Action, value: Value, args: Args) -> Value:
    if value.kind not in act.kinds:
        raise TypeMismatch(f"{act.path} doesn't take a value of kind {value.kind}")
    try:
        with np.errstate(all="ignore"):
            return act.kernel(value, args)
    except (ValueError, IndexError, OverflowError, MemoryError, np.linalg.LinAlgError) as e:
        raise ExecutionError(f"{act.path}: {e}") from e


class Names:
    """Resolves the action names of a program by its imports."""

    def __init__(self, program: Program):
        all_ = packs()
        self.items: dict[str, Action] = {}
        self.aliases: dict[str, str] = {}
        self.imported: list[str] = []
        plugins = {n for n, _ in program.plugins}
        for n, v in program.plugins:
            self._version(v)
            if n not in PLUGINS.values():
                raise CompileError(f"unknown plugin {n}")
        for i in program.imports:
            self._version(i.version)
            if i.pack not in all_:
                raise CompileError(f"unknown pack {i.pack}")
            if i.pack in PLUGINS and PLUGINS[i.pack] not in plugins:
                raise CompileError(f"pack {i.pack} needs: plugin {PLUGINS[i.pack]}/<version>")
            if i.action:
                if i.action not in all_[i.pack]:
                    raise CompileError(f"pack {i.pack} has no action {i.action}")
                self.items[i.alias or i.action] = all_[i.pack][i.action]
            else:
                self.aliases[i.alias or i.pack] = i.pack
                self.imported.append(i.pack)

    @staticmethod
    def _version(v: str) -> None:
        if v != "latest" and not VERSION.fullmatch(v):
            raise CompileError(f"{v!r} is no version")

    def __call__(self, name: str) -> Action:
        if name in self.items:
            return self.items[name]
        parts = name.split("/")
        if len(parts) == 3:
            self._version(parts[1])
            pack = packs().get(parts[0], {})
            if parts[2] in pack:
                return pack[parts[2]]
        elif len(parts) == 2:
            pack = packs().get(self.aliases.get(parts[0], ""), {})
            if parts[1] in pack:
                return pack[parts[1]]
        else:
            found = [p for p in dict.fromkeys(self.imported) if name in packs()[p]]
            if len(found) == 1:
                return packs()[found[0]][name]
            if found:
                raise CompileError(f"action {name!r} is ambiguous: {', '.join(found)}")
        raise CompileError(f"unknown action {name!r}")
