"""Expression nodes of the metrics query language, and their printer."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

SCALAR, VECTOR, MATRIX, STRING = "scalar", "instant vector", "range vector", "string"


class QueryError(ValueError):
    """A query that cannot be parsed, is badly typed, or has wrong arguments."""


def format_duration(ms: int) -> str:
    if ms == 0:
        return "0s"
    sign, ms, out = ("-", -ms, "") if ms < 0 else ("", ms, "")
    for unit, size in (("w", 604_800_000), ("d", 86_400_000), ("h", 3_600_000), ("m", 60_000), ("s", 1000), ("ms", 1)):
        if unit == "w" and ms % size:
            continue
        n, ms = divmod(ms, size)
        if n:
            out += f"{n}{unit}"
    return sign + out


def format_number(v: float) -> str:
    """Shortest decimal form without an exponent where one is not needed."""
    if math.isnan(v):
        return "NaN"
    if math.isinf(v):
        return "+Inf" if v > 0 else "-Inf"
    if v == int(v) and abs(v) < 1e21:
        return str(int(v))
    return repr(v)


def quote(s: str) -> str:
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t") + '"'


@dataclass(frozen=True)
class Matcher:
    name: str
    op: str  # = != =~ !~
    value: str

    def __str__(self) -> str:
        return f"{self.name}{self.op}{quote(self.value)}"


class Expr:
    kind = VECTOR


@dataclass(frozen=True)
class Number(Expr):
    value: float
    kind = SCALAR

    def __str__(self) -> str:
        return format_number(self.value)


@dataclass(frozen=True)
class String(Expr):
    value: str
    kind = STRING

    def __str__(self) -> str:
        return quote(self.value)


@dataclass(frozen=True)
class At:
    """A fixed evaluation time: milliseconds, or the query's start or end."""

    ms: int | None = None
    edge: str | None = None

    def __str__(self) -> str:
        return f" @ {self.edge}()" if self.edge else f" @ {self.ms / 1000:.3f}"


def _modifiers(at: At | None, offset: int) -> str:
    out = str(at) if at else ""
    return out + (f" offset {format_duration(offset)}" if offset else "")


@dataclass(frozen=True)
class Selector(Expr):
    matchers: tuple[Matcher, ...]
    range: int | None = None
    offset: int = 0
    at: At | None = None

    @property
    def kind(self) -> str:
        return VECTOR if self.range is None else MATRIX

    @property
    def name(self) -> str | None:
        return next((m.value for m in self.matchers if m.name == "__name__" and m.op == "="), None)

    def __str__(self) -> str:
        name = self.name
        rest = [str(m) for m in self.matchers if not (m.name == "__name__" and m.op == "=" and m.value == name)]
        out = (name or "") + ("{" + ",".join(rest) + "}" if rest or not name else "")
        return out + (f"[{format_duration(self.range)}]" if self.range is not None else "") + _modifiers(self.at, self.offset)


@dataclass(frozen=True)
class Subquery(Expr):
    expr: Expr
    range: int
    step: int | None = None
    offset: int = 0
    at: At | None = None
    kind = MATRIX

    def __str__(self) -> str:
        step = format_duration(self.step) if self.step else ""
        return f"{self.expr}[{format_duration(self.range)}:{step}]" + _modifiers(self.at, self.offset)


@dataclass(frozen=True)
class Paren(Expr):
    expr: Expr

    @property
    def kind(self) -> str:
        return self.expr.kind

    def __str__(self) -> str:
        return f"({self.expr})"


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    expr: Expr

    @property
    def kind(self) -> str:
        return self.expr.kind

    def __str__(self) -> str:
        return f"{self.op}{self.expr}"


@dataclass(frozen=True)
class Matching:
    on: bool = False
    labels: tuple[str, ...] = ()
    group: str | None = None  # left or right
    include: tuple[str, ...] = ()
    given: bool = False

    def __str__(self) -> str:
        if not self.given:
            return ""
        out = f" {'on' if self.on else 'ignoring'} ({', '.join(self.labels)})"
        return out + (f" group_{self.group} ({', '.join(self.include)})" if self.group else "")


COMPARISONS = ("==", "!=", ">", "<", ">=", "<=")
SET_OPERATORS = ("and", "or", "unless")


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr
    bool: bool = False
    matching: Matching = field(default_factory=Matching)

    @property
    def kind(self) -> str:
        return SCALAR if self.left.kind == SCALAR and self.right.kind == SCALAR else VECTOR

    def __str__(self) -> str:
        return f"{self.left} {self.op}{' bool' if self.bool else ''}{self.matching} {self.right}"


@dataclass(frozen=True)
class Aggregate(Expr):
    op: str
    expr: Expr
    param: Expr | None = None
    grouping: tuple[str, ...] = ()
    without: bool = False

    def __str__(self) -> str:
        clause = f" without ({', '.join(self.grouping)}) " if self.without else f" by ({', '.join(self.grouping)}) " if self.grouping else ""
        param = f"{self.param}, " if self.param is not None else ""
        return f"{self.op}{clause}({param}{self.expr})"


@dataclass(frozen=True)
class Call(Expr):
    func: str
    args: tuple[Expr, ...]
    kind_: str = VECTOR

    @property
    def kind(self) -> str:
        return self.kind_

    def __str__(self) -> str:
        return f"{self.func}({', '.join(map(str, self.args))})"


def children(e: Expr) -> tuple[Expr, ...]:
    if isinstance(e, Paren | Unary | Subquery):
        return (e.expr,)
    if isinstance(e, Binary):
        return (e.left, e.right)
    if isinstance(e, Aggregate):
        return (e.expr,) if e.param is None else (e.param, e.expr)
    return e.args if isinstance(e, Call) else ()


def to_tree(e: Expr) -> dict:
    """The expression as nested dictionaries, for display."""
    return {"node": type(e).__name__, "type": e.kind, "text": str(e), "children": [to_tree(c) for c in children(e)]}


def pretty(e: Expr, width: int = 100, indent: int = 0) -> str:
    """Break long expressions over lines, children indented by two spaces."""
    pad, text = "  " * indent, str(e)
    if len(pad) + len(text) <= width or not children(e):
        return pad + text
    if isinstance(e, Binary):
        middle = f"{e.op}{' bool' if e.bool else ''}{e.matching}"
        return f"{pretty(e.left, width, indent + 1)}\n{pad}{middle}\n{pretty(e.right, width, indent + 1)}"
    if isinstance(e, Aggregate):
        head = str(Aggregate(e.op, Number(0), None, e.grouping, e.without)).removesuffix("(0)")
        inner = ",\n".join(pretty(c, width, indent + 1) for c in children(e))
        return f"{pad}{head}(\n{inner}\n{pad})"
    if isinstance(e, Call):
        inner = ",\n".join(pretty(c, width, indent + 1) for c in e.args)
        return f"{pad}{e.func}(\n{inner}\n{pad})"
    if isinstance(e, Paren):
        return f"{pad}(\n{pretty(e.expr, width, indent + 1)}\n{pad})"
    return pad + text
