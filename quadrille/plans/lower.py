"""Lowering of models and signals to one lazy DataFrame.

Every window call is a stage column, computed once however often it occurs (nodes are
values, so equal calls are one key). Stages are scheduled by partitioning: all calls that can
be computed over series go into one projection, then all that can be computed over
cross-sections, so the panel is exchanged as few times as the dependencies allow. The universe
filter comes before any window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import PanelError
from ..functions import scalar
from ..functions.registry import OPS, TS, XS, Frame, duration_window, ewm
from ..sources.kinds import AGG_OF_KIND, kind_of
from . import nodes as N
from .needs import bound_universe, root_chain

_TO = {"to_annual": "annual", "to_quarterly": "quarterly", "to_monthly": "monthly", "to_daily": "daily"}
_OPERATORS = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "and": lambda a, b: a & b, "or": lambda a, b: a | b,
    "+": lambda a, b: scalar.number(a) + scalar.number(b), "-": lambda a, b: scalar.number(a) - scalar.number(b),
    "*": lambda a, b: scalar.number(a) * scalar.number(b), "/": scalar.divide, "%": scalar.modulo, "^": scalar.power,
    "??": F.coalesce,
}


def _kind(e: object) -> str | None:
    return kind_of(e.column) if isinstance(e, N.Field) else None


def desugar(e: object) -> object:
    """Calls whose meaning depends on the kind of a bare field, as calls that do not."""
    e = N.rebuilt(e, desugar)
    if not isinstance(e, N.Call):
        return e
    if e.name in _TO:
        agg = e.args[1] if len(e.args) > 1 else N.Literal(AGG_OF_KIND.get(_kind(e.args[0]), "last"))
        return N.Call("resample", (e.args[0], N.Literal(_TO[e.name]), agg))
    if e.name in ("ttm", "trailing"):
        x, kind = e.args[0], _kind(e.args[0])
        span = N.Literal("1y") if e.name == "ttm" else e.args[1]
        if kind in ("rate", "ratio"):
            return N.Call("roll_mean", (x, span))
        if kind == "return":
            total = N.Call("roll_sum", (N.Call("_log1p", (x,)), span))
            return N.Binary("-", N.Call("exp", (total,)), N.Literal(1))
        return N.Call("roll_sum", (x, span)) if kind in (None, "flow", "per_share") else N.Call("asof", (x,))
    return e


def _axis(e: object) -> str | None:
    return OPS[e.name].axis if isinstance(e, N.Call) and e.name in OPS and OPS[e.name].axis in (TS, XS) else None


def _spanned(e: N.Call) -> bool:
    """A rolling call over a duration, whose operand must be a column first."""
    return e.name.startswith("roll_") and len(e.args) > 1 and isinstance(e.args[1], N.Literal) and isinstance(e.args[1].value, str)


@dataclass
class Statement:
    name: str
    expr: object
    finish: object  # (Lowering) -> Column


class Lowering:
    def __init__(self, panel: DataFrame):
        self.df = panel
        self.stages: dict[object, str] = {}
        self.locals: dict[str, str] = {}
        self.last_axis: str | None = None

    def column(self, e: object) -> Column:
        if e in self.stages:
            return F.col(f"`{self.stages[e]}`")
        match e:
            case N.Literal():
                return F.lit(e.value)
            case N.Name():
                return F.col(f"`{self.locals.get(e.name, e.name)}`")
            case N.Field():
                return F.col(f"`{e.physical}`")
            case N.Binary():
                return _OPERATORS[e.op](self.column(e.left), self.column(e.right))
            case N.Unary(op="not"):
                return ~self.column(e.operand)
            case N.Unary():
                return -scalar.number(self.column(e.operand))
            case N.In():
                return self.column(e.item).isin([o.value for o in e.options])
            case N.Choice():
                return F.when(self.column(e.condition), self.column(e.value)).otherwise(self.column(e.otherwise))
            case N.Call(name="_log1p"):
                x = scalar.number(self.column(e.args[0])) + 1
                return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.ln(x))
            case N.Call():
                op = OPS[e.name]
                if op.lower is None:
                    raise PanelError("E-MODEL-CONTEXT", f"{e.name}() cannot stand here")
                return op.lower(self.arguments(e), Frame(".".join(e.by) if e.by else None))
        raise PanelError("E-INTERNAL", f"cannot lower {type(e).__name__}")

    def arguments(self, e: N.Call) -> list:
        """A call's operands as Columns, and its literals as Python values."""
        args = []
        for i, a in enumerate(e.args):
            if i in OPS[e.name].raw:
                a = N.Literal(-a.operand.value) if isinstance(a, N.Unary) and a.op == "-" and isinstance(a.operand, N.Literal) else a
                if not isinstance(a, N.Literal):
                    raise PanelError("E-ARG-LITERAL", f"argument {i + 1} of {e.name} must be a literal")
                args.append(a.value)
            else:
                args.append(self.column(a))
        return args

    def waiting(self, e: object, ready: set, blocked: set) -> bool:
        """Whether e still needs stages; collects those whose operands are complete."""
        if e in self.stages:
            return False
        below = [self.waiting(x, ready, blocked) for x in N.children(e)]
        if _axis(e):
            (blocked if any(below) else ready).add(e)
            return True
        return any(below)

    def compute(self, calls: list) -> None:
        spans = {e: f"__x{len(self.stages)}_{i}" for i, e in enumerate(calls) if _spanned(e)}
        operands = {}
        for e, name in spans.items():
            x = e.args[0]
            operands[e] = x.physical if isinstance(x, N.Field) else name
        extra = [self.column(e.args[0]).alias(n) for e, n in spans.items() if operands[e] == n]
        if extra:
            self.df = self.df.select("*", *extra)
        names = {e: f"__w{len(self.stages) + i}" for i, e in enumerate(calls)}
        faded = [e for e in calls if e.name in ("ewm_mean", "ewm_std")]
        out = [(duration_window(e.name[5:], operands[e], e.args[1].value) if e in spans else self.column(e)).alias(names[e]) for e in calls if e not in faded]
        if out:
            self.df = self.df.select("*", *out)
        for e in faded:
            x, span = self.arguments(e)
            self.df = ewm(self.df, x, span, e.name == "ewm_std", names[e])
        self.stages |= names

    def run(self, statements: list[Statement]) -> DataFrame:
        """Add a column for each statement, in rounds."""
        todo = list(statements)
        while todo:
            named = {s.name for s in todo}
            ready: set = set()
            free = []
            for s in todo:
                used = {x.name for e in s.expr for x in N.walk(e) if isinstance(x, N.Name)}
                own: set = set()
                wait = [self.waiting(e, own, set()) for e in s.expr]
                if used & (named - {s.name}) or s.name in used & named:
                    # only calls that do not read an open statement
                    ready |= {e for e in own if not {x.name for x in N.walk(e) if isinstance(x, N.Name)} & named}
                    continue
                ready |= own
                if not any(wait):
                    free.append(s)
            if free:
                self.df = self.df.select("*", *[s.finish(self).alias(f"__s:{s.name}") for s in free])
                self.locals |= {s.name: f"__s:{s.name}" for s in free}
                todo = [s for s in todo if s not in free]
                continue
            if not ready:
                raise PanelError("E-INTERNAL", "statements depend on each other")
            axes = {_axis(e) for e in ready}
            axis = self.last_axis if self.last_axis in axes else (TS if TS in axes else XS)
            self.last_axis = axis
            self.compute(sorted((e for e in ready if _axis(e) == axis), key=N.text_of))
        return self.df


def score_column(s: N.Score, low: Lowering) -> Column:
    """The first case that holds; null only if every condition is null."""
    conditions = [low.column(desugar(c)) for _, c in s.cases]
    value = F.lit(float(s.default))
    for (v, _), c in reversed(list(zip(s.cases, conditions, strict=True))):
        value = F.when(c, F.lit(float(v))).otherwise(value)
    unknown = conditions[0].isNull()
    for c in conditions[1:]:
        unknown = unknown & c.isNull()
    return F.when(unknown, F.lit(None).cast("double")).otherwise(value)


def rollup(scores: list[N.Score], on_missing: str, low: Lowering) -> Column:
    """Weighted scores over the greatest total: with `skip` only of the scores that are there."""
    total, most = F.lit(0.0), F.lit(0.0)
    for s in scores:
        value = F.col(f"`{low.locals[s.name]}`")
        top = s.weight * float(max([v for v, _ in s.cases] + [s.default]))
        total = total + F.coalesce(value * s.weight, F.lit(0.0))
        most = most + (F.lit(top) if on_missing == "zero" else F.when(value.isNotNull(), F.lit(top)).otherwise(0.0))
    return scalar.divide(total, most)


def filtered(panel: DataFrame, decl: N.Model | N.Signal, program: N.Program) -> DataFrame:
    """The rows of the declaration's universe and its roots, one condition after another."""
    columns = [F.col(f"`{c}`") for c in panel.columns]
    for u in root_chain(bound_universe(decl, program), program):
        if u.where is not None:
            e = desugar(u.where)
            low = Lowering(panel)
            panel = low.run([Statement("where", [e], lambda m, e=e: m.column(e))]).filter("`__s:where`").select(columns)
    return panel


def run(decl: N.Model | N.Signal, program: N.Program, panel: DataFrame) -> DataFrame:
    """entity, time and the exports of a model (or the signal's value), as one lazy plan."""
    for c in ("entity", "time"):
        if c not in panel.columns:
            raise PanelError("E-DATA", f"the panel has no {c!r} column")
    low = Lowering(filtered(panel, decl, program))
    if isinstance(decl, N.Signal):
        e = desugar(decl.expr)
        low.run([Statement(decl.name, [e], lambda m: m.column(e))])
        outputs = [decl.name]
    else:
        statements, outputs = [], []
        scores = [s for s in decl.statements if isinstance(s, N.Score)]
        for s in decl.statements:
            if isinstance(s, N.Score):
                statements.append(Statement(s.name, [desugar(c) for _, c in s.cases], lambda m, s=s: score_column(s, m)))
            elif s.expr is None:
                outputs.append(s.name)
            else:
                e = desugar(s.expr)
                if isinstance(e, N.Call) and e.name == "weighted_score":
                    statements.append(Statement(s.name, [N.Name(x.name) for x in scores], lambda m: rollup(scores, decl.on_missing, m)))
                else:
                    statements.append(Statement(s.name, [e], lambda m, e=e: m.column(e)))
                if s.export:
                    outputs.append(s.name)
        low.run(statements)
    return low.df.select("entity", "time", *[F.col(f"`__s:{n}`").alias(n) for n in dict.fromkeys(outputs)])
