"""Recursive-descent parser of pipelines."""

from __future__ import annotations

import math
import re

from ..types import ParseError
from .ast import Branch, Call, Condition, Each, Flow, Import, Param, Program, Ref, Slice, Tap, TypeSpec

# Reserved words, type names and string escapes of the language.
RESERVED = frozenset("if else each route pipeline accept import from as true false".split())
TYPES = {"Bytes": "bytes", "IntArg": "int", "FloatArg": "float", "StrArg": "str", "BoolArg": "bool", "Scalar": "scalar", "Composite": "composite", "Tensor": "tensor", "Image": "image", "Audio": "audio"}
ESCAPES = {"\\": "\\", "/": "/", '"': '"', "'": "'", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}

#: Axes of an array, at most.
MOST_AXES = 64

_SPACE = re.compile(r"(?:\s+|(?:#|//)[^\n]*(?:\n|$))*")
_IDENT = re.compile(r"[A-Za-z_]\w*")
_PLUGIN = re.compile(r"[A-Za-z_][\w-]*")
_VERSION = re.compile(r"[A-Za-z0-9._+-]+")
_NUMBER = re.compile(r"[+-]?\d+(\.\d+)?([eE][+-]?\d+)?")
_INT = re.compile(r"[+-]?\d+")


class Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0
        self.space()

    def fail(self, what: str) -> ParseError:
        line = self.text.count("\n", 0, self.at) + 1
        found = self.text[self.at : self.at + 12].split("\n")[0]
        return ParseError(f"line {line}: expected {what}, found {found!r}" if found else f"line {line}: expected {what}")

    def space(self) -> None:
        self.at = _SPACE.match(self.text, self.at).end()

    def peek(self, token: str) -> bool:
        if not self.text.startswith(token, self.at):
            return False
        end = self.at + len(token)
        return not (token[-1].isalnum() and end < len(self.text) and (self.text[end].isalnum() or self.text[end] == "_"))

    def take(self, token: str) -> bool:
        if not self.peek(token):
            return False
        self.at += len(token)
        self.space()
        return True

    def need(self, token: str) -> None:
        if not self.take(token):
            raise self.fail(repr(token))

    def match(self, pattern: re.Pattern, what: str, skip: bool = True) -> str:
        m = pattern.match(self.text, self.at)
        if not m or not m[0]:
            raise self.fail(what)
        self.at = m.end()
        if skip:
            self.space()
        return m[0]

    def ident(self) -> str:
        return self.match(_IDENT, "a name")

    def action_word(self) -> str:
        start = self.at
        name = self.match(_IDENT, "an action's name", skip=False)
        if name in RESERVED:
            self.at = start
            raise self.fail("an action's name")
        return name

    def var(self) -> str:
        self.need("$")
        return self.ident()

    def integer(self) -> int:
        return int(self.match(_INT, "an integer"))

    # whole text

    def program(self) -> Program:
        out = Program()
        while self.at < len(self.text):
            if self.take("plugin"):
                name = self.match(_PLUGIN, "a plugin", skip=False)
                self.need("/")
                out.plugins.append((name, self.match(_VERSION, "a version")))
            elif self.peek("import") or self.peek("from"):
                out.imports += self.imports()
            elif self.take("accept"):
                out.params.append(self.param())
            else:
                out.flows.append(self.flow())
        return out

    def imports(self) -> list[Import]:
        if self.take("from"):
            pack = self.match(_IDENT, "a pack", skip=False)
            self.separator()
            version = self.match(_VERSION, "a version")
            self.need("import")
            out = [self.imported(pack, version)]
            while self.take(","):
                if not _IDENT.match(self.text, self.at) or self.peek("import") or self.peek("accept"):
                    break
                out.append(self.imported(pack, version))
            return out
        self.need("import")
        pack = self.match(_IDENT, "a pack", skip=False)
        self.separator()
        version = self.match(_VERSION, "a version")
        if self.take("/"):
            return [self.imported(pack, version)]
        return [Import(pack, version, None, self.ident() if self.take("as") else None)]

    def separator(self) -> None:
        if not (self.take("/") or self.take(".")):
            raise self.fail("'/'")

    def imported(self, pack: str, version: str) -> Import:
        action = self.ident()
        return Import(pack, version, action, self.ident() if self.take("as") else None)

    def param(self) -> Param:
        if self.peek("$"):
            raise self.fail("a type before the parameter's name")
        spec = self.type()
        self.take("$")
        name = self.ident()
        return Param(name, spec, self.value() if self.take("=") else None)

    def type(self) -> TypeSpec:
        start = self.at
        name = self.ident()
        if name not in TYPES:
            self.at = start
            raise self.fail("a type")
        kind = TYPES[name]
        if kind == "composite" and self.take("["):
            items = [self.type()]
            while self.take(","):
                items.append(self.type())
            self.need("]")
            if any(i.kind in ("int", "float", "str", "bool") for i in items):
                raise ParseError("a composite can't hold arguments")
            return TypeSpec(kind, None, tuple(items))
        if kind in ("tensor", "image", "audio") and self.take("["):
            if self.take("]"):
                return TypeSpec(kind)
            if self.take("rank"):
                self.need("=")
                rank = self.integer()
                if not 1 <= rank <= MOST_AXES:
                    raise ParseError(f"a rank must be 1 to {MOST_AXES}; rank 0 is a Scalar")
                self.need("]")
                return TypeSpec(kind, (None,) * rank)
            dims = [self.dim()]
            while self.take(","):
                dims.append(self.dim())
            self.need("]")
            return TypeSpec(kind, tuple(dims))
        return TypeSpec(kind)

    def dim(self) -> int | None:
        return None if self.take("*") else self.integer()

    # flows

    def flow(self) -> Flow:
        steps = [self.step(True)]
        while self.take(">>"):
            steps.append(self.step(False))
        return Flow(tuple(steps))

    def step(self, first: bool):
        if self.take("each"):
            axis = None
            if self.take("("):
                if self.take("axis") or self.take("dim"):
                    self.need("=")
                    axis = self.integer()
                    self.need(")")
                    self.need("(")
            else:
                raise self.fail("'('")
            name = self.var()
            self.need(")")
            return Each(name, self.block(), axis)
        if self.take("if"):
            self.need("(")
            cond = self.condition()
            self.need(")")
            body = self.block()
            return Branch(((cond, body),), self.block() if self.take("else") else None)
        if self.take("route"):
            self.need("{")
            arms, otherwise = [], None
            while not self.take("}"):
                if self.take("else"):
                    self.need("=>")
                    otherwise = self.arm()
                    self.need("}")
                    break
                cond = self.condition()
                self.need("=>")
                arms.append((cond, self.arm()))
            return Branch(tuple(arms), otherwise)
        if self.peek("$"):
            return self.ref() if first else Tap(self.var())
        return self.call()

    def block(self) -> tuple[Flow, ...]:
        self.need("{")
        out = []
        while not self.take("}"):
            if self.at >= len(self.text):
                raise self.fail("'}'")
            out.append(self.flow())
        return tuple(out)

    def arm(self) -> tuple[Flow, ...]:
        return self.block() if self.peek("{") else (self.flow(),)

    def condition(self) -> Condition:
        left = self.value()
        for op in ("==", "!=", "<=", ">=", "<", ">"):
            if self.take(op):
                return Condition(left, op, self.value())
        raise self.fail("a comparison")

    def ref(self) -> Ref:
        self.need("$")
        name = self.match(_IDENT, "a name", skip=False)
        field = None
        if self.text.startswith(".", self.at):
            self.at += 1
            field = self.match(_IDENT, "a field", skip=False)
        groups = []
        while self.text.startswith("[", self.at):
            self.need("[")
            axes = [self.slice()]
            while self.take(","):
                axes.append(self.slice())
            if not self.text.startswith("]", self.at):
                raise self.fail("']'")
            self.at += 1
            groups.append(tuple(axes))
        self.space()
        return Ref(name, field, tuple(groups))

    def slice(self) -> Slice:
        bound = lambda: self.integer() if _INT.match(self.text, self.at) else None
        start = bound()
        if not self.take(":"):
            if start is None:
                raise self.fail("an index")
            return Slice(index=start)
        stop = bound()
        return Slice(None, start, stop, bound() if self.take(":") else None)

    def call(self) -> Call:
        name = self.action_word()
        while self.text[self.at : self.at + 1] in ("/", ".") and not self.text.startswith("//", self.at):
            self.at += 1
            name += "/" + self.match(_VERSION if name.count("/") == 1 and not _IDENT.match(self.text, self.at) else re.compile(r"[A-Za-z_][\w+-]*|\d[\w.+-]*"), "a part of a name", skip=False)
        self.space()
        args, named = [], []
        if self.take("("):
            while not self.take(")"):
                m = re.compile(r"([A-Za-z_]\w*)\s*=(?!=)").match(self.text, self.at)
                if m:
                    self.at = m.end()
                    self.space()
                    named.append((m[1], self.value()))
                else:
                    args.append(self.value())
                if not self.take(","):
                    self.need(")")
                    break
        return Call(name, tuple(args), tuple(named))

    def value(self):
        c = self.text[self.at : self.at + 1]
        if c == "$":
            return self.ref()
        if c and c in "\"'":
            return self.string(c)
        if self.take("true"):
            return True
        if self.take("false"):
            return False
        m = _NUMBER.match(self.text, self.at)
        if not m:
            raise self.fail("a value")
        self.at = m.end()
        if re.compile(r"[\w.]").match(self.text, self.at):
            raise self.fail("a number")
        self.space()
        if m[1] is None and m[2] is None:
            n = int(m[0])
            if not -(1 << 63) <= n < 1 << 63:
                raise ParseError(f"integer out of range: {m[0]}")
            return n
        x = float(m[0])
        if not math.isfinite(x):
            raise ParseError(f"number out of range: {m[0]}")
        return x

    def string(self, quote: str) -> str:
        self.at += 1
        out = []
        while True:
            c = self.text[self.at : self.at + 1]
            if not c:
                raise self.fail("the end of the string")
            self.at += 1
            if c == quote:
                self.space()
                return "".join(out)
            if c == "\\":
                e = self.text[self.at : self.at + 1]
                if e not in ESCAPES:
                    raise self.fail("an escape")
                self.at += 1
                c = ESCAPES[e]
            out.append(c)


def parse(text: str) -> Program:
    return Parser(text).program()
