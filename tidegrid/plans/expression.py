"""Factor expressions: parse, intern, plan into window stages, and write the stages as SQL.

An expression is text such as ``-1 * corr(rank(open), rank(volume), 10)``: fields by name, arithmetic, comparisons, `or`,
``a if c else b``, and the functions of FUNCTIONS. The spellings of ALIASES (``$close``, ``CSRank``, ``If``, ``||``) mean
the same. Equal subexpressions of all expressions of a plan are one node.

Time-series nodes need rows by symbol, cross-section nodes rows by date; changing from one to the other is a shuffle in
Spark. The planner therefore runs every time-series node that is ready, nested ones in one partitioning after the other,
then every cross-section node, and so on: the number of shuffles is the number of alternations of the deepest
expression, for any number of expressions. Sliding windows and ranks are computed in numpy (arrays.py), the rest by Spark.
"""

from __future__ import annotations

import ast
import re
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field

from ..semantics import CONSTANT, MIN_PAIRS, NOISE, TIE_SPLIT, YEAR_DAYS

#: Functions over the last d ticks of one symbol, over one date, and of single values; with their numbers of arguments.
TIME = {"delay": 2, "delta": 2, "ts_sum": 2, "ts_mean": 2, "ts_std": 2, "ts_var": 2, "ts_min": 2, "ts_max": 2, "ts_argmin": 2, "ts_argmax": 2, "ts_count": 2, "ts_rank": 2, "ts_quantile": 3, "ts_slope": 2, "ts_rsquare": 2, "ts_resi": 2, "decay": 2, "corr": 3, "cov": 3}
#: The same over the last 365 days, by date: the value of the last tick at least so old, and mean and sum of what is newer.
YEARLY = {"year_lag": 1, "year_mean": 1, "year_sum": 1}
TIME |= YEARLY
CROSS = {"rank": 1, "scale": 1, "neutralize": 2, "demean": 1}
SINGLE = {"sign": 1, "abs": 1, "log": 1, "sqrt": 1, "power": 2, "larger": 2, "smaller": 2, "positive": 1, "negative": 1, "choose": 3}
FUNCTIONS = TIME | CROSS | SINGLE
# Other spellings of the functions.
ALIASES = {
    "Ref": "delay", "Delta": "delta", "Sum": "ts_sum", "Mean": "ts_mean", "Std": "ts_std", "Var": "ts_var", "Min": "ts_min", "Max": "ts_max", "IdxMin": "ts_argmin", "IdxMax": "ts_argmax", "Count": "ts_count", "Rank": "ts_rank", "Quantile": "ts_quantile",
    "Slope": "ts_slope", "Rsquare": "ts_rsquare", "Resi": "ts_resi", "WMA": "decay", "Corr": "corr", "Cov": "cov", "CSRank": "rank", "Scale": "scale", "IndNeutralize": "neutralize", "If": "choose", "Greater": "larger", "Less": "smaller", "Sign": "sign",
    "Abs": "abs", "Log": "log", "Power": "power", "Sqrt": "sqrt",
}


class ExpressionError(ValueError):
    """An expression that has no meaning."""


@dataclass(frozen=True)
class Node:
    op: str
    args: tuple[Node, ...] = ()
    value: float | str | None = None

    @property
    def kind(self) -> str:
        return "time" if self.op in TIME else "cross" if self.op in CROSS else "single"

    @property
    def is_boolean(self) -> bool:
        return self.op in ("<", ">", "<=", ">=", "==", "or")


class Interner:
    """Parsed expressions with equal parts shared and constants folded."""

    def __init__(self, fields: set[str] | None = None):
        self.fields = fields
        self.nodes: dict[tuple, Node] = {}

    def node(self, op: str, args: tuple[Node, ...] = (), value=None) -> Node:
        if op in ("+", "-", "*", "/") and all(a.op == "const" for a in args):
            x, y = (a.value for a in args)
            if op != "/" or y:
                return self.node("const", (), {"+": x + y, "-": x - y, "*": x * y}[op] if op != "/" else x / y)
        return self.nodes.setdefault((op, tuple(map(id, args)), value), Node(op, args, value))

    def parse(self, text: str) -> Node:
        try:
            tree = ast.parse(re.sub(r"\$([A-Za-z_]\w*)", r"\1", text).replace("||", " or ").strip(), mode="eval").body
        except SyntaxError as e:
            raise ExpressionError(f"{text!r}: {e.msg}") from e
        out = self._walk(tree, text)
        if out.is_boolean:
            raise ExpressionError(f"{text!r}: a condition is not a value")
        return out

    def _walk(self, t: ast.expr, text: str) -> Node:
        walk = lambda x: self._walk(x, text)
        match t:
            case ast.Constant(value=bool()):
                pass
            case ast.Constant(value=int() | float() as v):
                return self.node("const", (), float(v))
            case ast.Name(id=name):
                if self.fields is not None and name not in self.fields:
                    raise ExpressionError(f"{text!r}: no field {name}")
                return self.node("field", (), name)
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return self.node("*", (self.node("const", (), -1.0), walk(x)))
            case ast.BinOp(left=a, op=op, right=b):
                sign = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Pow: "power"}.get(type(op))
                if sign:
                    return self.node(sign, (walk(a), walk(b)))
            case ast.Compare(left=a, ops=[op], comparators=[b]):
                sign = {ast.Lt: "<", ast.Gt: ">", ast.LtE: "<=", ast.GtE: ">=", ast.Eq: "=="}.get(type(op))
                if sign:
                    return self.node(sign, (walk(a), walk(b)))
            case ast.BoolOp(op=ast.Or(), values=values):
                out = walk(values[0])
                for v in values[1:]:
                    out = self.node("or", (out, walk(v)))
                return out
            case ast.IfExp(test=c, body=a, orelse=b):
                return self.node("choose", (walk(c), walk(a), walk(b)))
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]):
                name = ALIASES.get(name, name)
                if name not in FUNCTIONS or len(args) != FUNCTIONS[name]:
                    raise ExpressionError(f"{text!r}: no function {name} of {len(args)}")
                own = tuple(walk(a) for a in args)
                if name in TIME and name not in YEARLY:
                    d = own[2 if name in ("corr", "cov") else 1]
                    if d.op != "const" or d.value != int(d.value) or d.value < (0 if name == "delay" else 1):
                        raise ExpressionError(f"{text!r}: a window is a whole number")
                    if name == "delay" and d.value == 0:
                        return own[0]
                if name == "choose" and not own[0].is_boolean:
                    raise ExpressionError(f"{text!r}: a choice needs a condition")
                if any(a.is_boolean for a in own[1 if name == "choose" else 0 :]):
                    raise ExpressionError(f"{text!r}: a condition is not a value")
                return self.node(name, own)
        raise ExpressionError(f"{text!r}: {ast.unparse(t)} is not understood")


@dataclass
class Stage:
    """Columns that one select adds, all by symbol ('time'), by date ('cross') or neither ('single')."""

    kind: str
    columns: list[tuple[str, str]] = field(default_factory=list)
    needs: set[str] = field(default_factory=set)
    #: The nodes of the columns, over fields and columns made before.
    nodes: list[tuple[str, Node]] = field(default_factory=list)


class Dialect:
    """Where Spark SQL and DuckDB differ."""

    def __init__(self, name: str):
        self.duck = name == "duckdb"

    def arg_extreme(self, largest: bool, x: str, over: str) -> str:
        # the oldest of equal values: the smallest tick wins
        f = ("arg_max" if self.duck else "max_by") if largest else ("arg_min" if self.duck else "min_by")
        key = f"{'-' if largest else ''}t"
        pair = f"{{'x': {tie(x)}, 'k': {key}}}" if self.duck else f"struct({tie(x)}, {key})"
        return f"{f}(t, CASE WHEN {x} IS NOT NULL THEN {pair} END) {over}"

    def window_rank(self, x: str, over: str) -> str:
        r = tie(x)
        if self.duck:
            held = f"list({r}) FILTER (WHERE {x} IS NOT NULL) {over}"
            less, equal = (f"len(list_filter({held}, lambda v: v {c} {r}))" for c in ("<", "="))
            n = f"count({x}) {over}"
        else:
            held = f"collect_list({r}) {over}"
            less, equal = (f"size(filter({held}, v -> v {c} {r}))" for c in ("<", "="))
            n = f"count({x}) {over}"
        return f"CASE WHEN {x} IS NOT NULL THEN ({less} + ({equal} + 1) / CAST(2 AS DOUBLE)) / {n} END"

    def quantile(self, x: str, q: float, over: str) -> str:
        return f"{'quantile_cont' if self.duck else 'percentile'}({x}, {q}) {over}"


_near: ContextVar[bool] = ContextVar("near", default=False)


@contextmanager
def near_ties():
    """While plans are written here, values that agree to 23 binary digits are equal to ranks, extremes and comparisons.

    So two engines that sum in different orders find the same ties. Elsewhere values are compared exactly.
    """
    token = _near.set(True)
    try:
        yield
    finally:
        _near.reset(token)


def tie(x: str) -> str:
    """x; under near_ties() to 23 binary digits, by a product and two differences that every engine computes alike, and noise around zero is zero."""
    if not _near.get():
        return x
    return f"(CASE WHEN abs({x}) < {NOISE} THEN CAST(0 AS DOUBLE) ELSE {x} * {TIE_SPLIT} - ({x} * {TIE_SPLIT} - {x}) END)"


SPARK, DUCKDB = Dialect("spark"), Dialect("duckdb")
BY_DATE = "OVER (PARTITION BY date)"


def number(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def window(d: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN {d - 1} PRECEDING AND CURRENT ROW)"


def spread(x: str, over: str) -> str:
    """Standard deviation, missing where the window is constant."""
    return f"CASE WHEN count({x}) {over} >= {MIN_PAIRS} AND stddev_samp({x}) {over} > {CONSTANT} * abs(avg({x}) {over}) THEN stddev_samp({x}) {over} END"


def correlation(a: str, b: str, over: str) -> str:
    x, y = f"(CASE WHEN {b} IS NOT NULL THEN {a} END)", f"(CASE WHEN {a} IS NOT NULL THEN {b} END)"
    return f"CASE WHEN count({x}) {over} >= {MIN_PAIRS} THEN covar_samp({x}, {y}) {over} / (({spread(x, over)}) * ({spread(y, over)})) END"


def average_rank(x: str, part: str = "date") -> str:
    """Percentile in 0..1 by average rank among the values of a date; 0.5 for a lone value."""
    r = tie(x)
    up, down = (f"rank() OVER (PARTITION BY {part} ORDER BY {r} {way} NULLS LAST)" for way in ("ASC", "DESC"))
    n = f"count({x}) OVER (PARTITION BY {part})"
    return f"CASE WHEN {x} IS NOT NULL THEN CASE WHEN {n} > 1 THEN (({up} + {n} + 1 - {down}) / CAST(2 AS DOUBLE) - 1) / ({n} - 1) ELSE CAST(0.5 AS DOUBLE) END END"


def time_sql(n: Node, args: list[str], dialect: Dialect) -> str:
    x = args[0]
    if n.op in YEARLY:
        return year_sql(n.op, x)
    d = int(n.args[2 if n.op in ("corr", "cov") else 1].value)
    over, lag = window(d), f"lag({x}, {d}) OVER (PARTITION BY symbol ORDER BY t)"
    many = f"count({x}) {over} >= {MIN_PAIRS}"
    match n.op:
        case "delay":
            return lag
        case "delta":
            return f"{x} - {lag}"
        case "ts_sum" | "ts_mean" | "ts_min" | "ts_max":
            out = f"{ {'ts_sum': 'sum', 'ts_mean': 'avg', 'ts_min': 'min', 'ts_max': 'max'}[n.op]}({x}) {over}"
        case "ts_count":
            out = f"CAST(count({x}) {over} AS DOUBLE)"
        case "ts_std" | "ts_var":
            out = f"CASE WHEN {many} THEN {'stddev_samp' if n.op == 'ts_std' else 'var_samp'}({x}) {over} END"
        case "ts_argmax" | "ts_argmin":
            out = f"CAST({dialect.arg_extreme(n.op == 'ts_argmax', x, over)} - t + {d} AS DOUBLE)"
        case "ts_rank":
            out = dialect.window_rank(x, over)
        case "ts_quantile":
            out = dialect.quantile(x, n.args[2].value, over)
        case "ts_slope":
            out = f"CASE WHEN {many} THEN regr_slope({x}, t) {over} END"
        case "ts_resi":
            out = f"CASE WHEN {many} THEN {x} - (regr_intercept({x}, t) {over} + t * regr_slope({x}, t) {over}) END"
        case "ts_rsquare":
            c = correlation(x, "CAST(t AS DOUBLE)", over)
            out = f"({c}) * ({c})"
        case "decay":
            # weights 1..d, the newest heaviest, over the values there are
            w = f"(t - {d})"
            total = f"(sum({x} * t) {over} - {w} * sum({x}) {over})"
            weights = f"(sum(CASE WHEN {x} IS NOT NULL THEN t END) {over} - {w} * count({x}) {over})"
            out = f"{total} / nullif({weights}, 0)"
        case "corr":
            out = correlation(args[0], args[1], over)
        case "cov":
            a, b = f"(CASE WHEN {args[1]} IS NOT NULL THEN {x} END)", f"(CASE WHEN {x} IS NOT NULL THEN {args[1]} END)"
            out = f"CASE WHEN count({a}) {over} >= {MIN_PAIRS} THEN covar_samp({a}, {b}) {over} END"
    return f"CASE WHEN t >= {d} THEN {out} END"


def year_sql(op: str, x: str) -> str:
    by_day = "OVER (PARTITION BY symbol ORDER BY date RANGE BETWEEN"
    if op == "year_lag":
        return f"last_value({x}) {by_day} UNBOUNDED PRECEDING AND INTERVAL '{YEAR_DAYS}' DAYS PRECEDING)"
    newer = f"{by_day} INTERVAL '{YEAR_DAYS}' DAYS PRECEDING AND CURRENT ROW)"
    # a year without an event sums to zero
    return f"avg({x}) {newer}" if op == "year_mean" else f"coalesce(sum({x}) {newer}, 0)"


def cross_sql(n: Node, args: list[str]) -> str:
    x = args[0]
    match n.op:
        case "rank":
            return average_rank(x)
        case "scale":
            return f"{x} / nullif(sum(abs({x})) {BY_DATE}, 0)"
        case "demean":
            return f"{x} - avg({x}) {BY_DATE}"
        case "neutralize":
            return f"{x} - avg({x}) OVER (PARTITION BY date, {args[1]})"
    raise AssertionError(n.op)


def single_sql(n: Node, args: list[str]) -> str:
    at = tie
    match n.op:
        case "+" | "-" | "*":
            return f"({args[0]} {n.op} {args[1]})"
        case "/":
            return f"({args[0]} / nullif({args[1]}, 0))"
        case "<" | ">" | "<=" | ">=" | "==":
            return f"({at(args[0])} {'=' if n.op == '==' else n.op} {at(args[1])})"
        case "or":
            return f"({args[0]} OR {args[1]})"
        case "choose":
            return f"(CASE WHEN {args[0]} THEN {args[1]} ELSE {args[2]} END)"
        case "larger" | "smaller":
            return f"{'greatest' if n.op == 'larger' else 'least'}({args[0]}, {args[1]})"
        case "positive" | "negative":  # the part above or below zero; missing where x is, unlike larger(x, 0)
            part, none = (">", "<=") if n.op == "positive" else ("<", ">=")
            return f"(CASE WHEN {args[0]} {part} 0 THEN {args[0]} WHEN {args[0]} {none} 0 THEN CAST(0 AS DOUBLE) END)"
        case "sign":
            return f"(CASE WHEN {args[0]} < 0 THEN CAST(-1 AS DOUBLE) WHEN {args[0]} >= 0 THEN CAST(1 AS DOUBLE) END)"
        case "abs":
            return f"abs({args[0]})"
        case "log":
            return f"(CASE WHEN {args[0]} > 0 THEN ln({args[0]}) END)"
        case "sqrt":
            return f"(CASE WHEN {args[0]} >= 0 THEN sqrt({args[0]}) END)"
        case "power":
            x, y = args
            # no value: a fraction of a negative number, a negative power of zero, or beyond 1e300
            fine = f"(({x} > 0 AND abs({y} * ln(CASE WHEN {x} > 0 THEN {x} END)) < 690) OR ({x} = 0 AND {y} >= 0) OR ({x} < 0 AND {y} = floor({y}) AND abs({y} * ln(CASE WHEN {x} < 0 THEN -{x} END)) < 690))"
            return f"(CASE WHEN {fine} THEN power({x}, {y}) END)"
    raise AssertionError(n.op)


@dataclass
class Plan:
    """Stages, in order, and the column of each expression."""

    stages: list[Stage]
    outputs: dict[str, str]
    fields: set[str]

    @property
    def alternations(self) -> int:
        kinds = [s.kind for s in self.stages if s.kind != "single"]
        return sum(a != b for a, b in zip(kinds, ["", *kinds], strict=False))


def plan(expressions: dict[str, str], dialect: Dialect = SPARK, fields: set[str] | None = None, most_columns: int = 50) -> Plan:
    """Stages for named expressions. A single-value node is written where it is used, unless several use it."""
    interner = Interner(fields)
    roots = {name: interner.parse(text) for name, text in expressions.items()}
    order: list[Node] = []
    seen: set[int] = set()
    uses: dict[int, int] = {}

    def visit(n: Node) -> None:
        uses[id(n)] = uses.get(id(n), 0) + 1
        if id(n) not in seen:
            seen.add(id(n))
            for a in n.args:
                visit(a)
            order.append(n)

    for r in roots.values():
        visit(r)
    own = {id(n) for n in order if n.kind != "single" or (uses[id(n)] > 1 and n.args and not n.is_boolean)} | {id(r) for r in roots.values() if r.args}
    columns: dict[int, str] = {}
    used_fields = {n.value for n in order if n.op == "field"}

    def text(n: Node, needs: set[str]) -> str:
        if id(n) in columns:
            needs.add(columns[id(n)])
            return columns[id(n)]
        if n.op == "const":
            return number(n.value)
        if n.op == "field":
            needs.add(n.value)
            return n.value
        return single_sql(n, [text(a, needs) for a in n.args])

    def resolved(n: Node) -> Node:
        if id(n) in columns:
            return Node("field", (), columns[id(n)])
        return Node(n.op, tuple(map(resolved, n.args)), n.value)

    def ready(n: Node) -> bool:
        return all(id(a) in columns if id(a) in own else ready(a) for a in n.args)

    stages: list[Stage] = []
    left = [n for n in order if id(n) in own]
    kind = "time"
    while left:
        now = [n for n in left if n.kind == "single" and ready(n)]
        this = "single"
        if not now:
            now, this = [n for n in left if n.kind == kind and ready(n)], kind
        if not now:
            kind = "cross" if kind == "time" else "time"
            continue
        made = []
        for n in now:
            needs: set[str] = set()
            args = [text(a, needs) for a in n.args]
            sql = time_sql(n, args, dialect) if this == "time" else cross_sql(n, args) if this == "cross" else single_sql(n, args)
            made.append((n, f"c{len(columns) + len(made)}", sql, needs, resolved(n)))
        for k in range(0, len(made), most_columns):
            part = made[k : k + most_columns]
            stages.append(Stage(this, [(c, sql) for _, c, sql, _, _ in part], set().union(*(needs for _, _, _, needs, _ in part)), [(c, own_node) for _, c, _, _, own_node in part]))
        for n, c, *_ in made:
            columns[id(n)] = c
        done = {id(n) for n in now}
        left = [n for n in left if id(n) not in done]
    outputs = {name: text(r, set()) for name, r in roots.items()}
    return Plan(stages, outputs, used_fields)


KEYS = ("date", "symbol", "t")


def kept_after(p: Plan, k: int) -> set[str]:
    """Columns that something behind stage k still needs."""
    later = set(p.outputs.values())
    for s in p.stages[k + 1 :]:
        later |= s.needs
    return later


def evaluate(panel, expressions: dict[str, str], cut_after: int | None = None):
    """(date, symbol, t, one column for each expression) of a dense panel that has these fields, as a Spark DataFrame.

    cut_after: lineage is cut by a checkpoint after so many stages; None: never.
    """
    p = plan(expressions, SPARK, set(panel.columns))
    df = panel.select(*KEYS, *sorted(p.fields - set(KEYS)))
    for part in passes(p.stages):
        if in_arrays([p.stages[k] for k in part]):
            df = _by_arrays(df, [p.stages[k] for k in part], kept_after(p, part[-1]))
        else:
            for k in part:
                keep = kept_after(p, k)
                df = df.selectExpr(*KEYS, *(c for c in df.columns if c in keep and c not in KEYS), *(f"{sql} AS {c}" for c, sql in p.stages[k].columns if c in keep))
        if cut_after and any((k + 1) % cut_after == 0 for k in part):
            df = df.checkpoint()
    return df.selectExpr(*KEYS, *(f"{c} AS `{name}`" for name, c in p.outputs.items()))


def passes(stages: list[Stage]) -> list[list[int]]:
    """Stages, by their numbers, that go over the same groups one after the other; single values go with what is before them."""
    out: list[list[int]] = []
    kind = ""
    for k, s in enumerate(stages):
        if not out or (s.kind != "single" and kind not in ("", s.kind)):
            out.append([])
            kind = ""
        out[-1].append(k)
        if s.kind != "single":
            kind = s.kind
    return out


def in_arrays(stages: list[Stage]) -> bool:
    """Whether numpy takes these stages: those with sliding windows or ranks. Lags and means of a date are cheaper in Spark."""
    ops = {x.op for s in stages for _, x in s.nodes}
    return not ops & set(YEARLY) and bool(ops & (set(TIME) - {"delay", "delta"} | {"rank"}))


def _by_arrays(df, stages: list[Stage], keep: set[str]):
    """df with the columns of stages that keep names, computed for whole symbols or dates at a time."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import DoubleType, StructField, StructType
    from pyspark.sql.window import Window

    from ..session import share_package
    from .arrays import PLACE, added, whole_symbols

    share_package(df.sparkSession)
    near = _near.get()
    steps = [node for s in stages for node in s.nodes]
    held = [*KEYS, *(c for c in df.columns if c in keep and c not in KEYS)]
    new = [c for c, _ in steps if c in keep]
    needs = set().union(*(s.needs for s in stages))
    schema = StructType([*(df.schema[c] for c in held), *(StructField(c, DoubleType()) for c in new)])
    read = df.select(*held, *(c for c in df.columns if c in needs and c not in held))

    def by_symbol(batches):
        for table in whole_symbols(batches):
            yield from added(table, steps, held, new, near).to_batches()

    def by_date(table):
        return added(table, steps, held, new, near)

    if any(s.kind == "time" for s in stages):
        # the number needs a symbol's rows together and in order, and so they come to the function
        return read.withColumn(PLACE, F.row_number().over(Window.partitionBy("symbol").orderBy("t"))).mapInArrow(by_symbol, schema)
    return read.groupBy("date").applyInArrow(by_date, schema)


def duckdb_sql(panel: str, expressions: dict[str, str], fields: set[str] | None = None) -> str:
    """The same as DuckDB SQL; panel: a query that gives the panel."""
    p = plan(expressions, DUCKDB, fields)
    ctes = [f"s0 AS ({panel})"]
    have = [*KEYS, *sorted(p.fields - set(KEYS))]
    for k, s in enumerate(p.stages):
        keep = kept_after(p, k)
        have = [*KEYS, *(c for c in have if c in keep and c not in KEYS)]
        made = [(c, sql) for c, sql in s.columns if c in keep]
        ctes.append(f"s{k + 1} AS (SELECT {', '.join([*have, *(f'{sql} AS {c}' for c, sql in made)])} FROM s{k})")
        have += [c for c, _ in made]
    outs = ", ".join([*KEYS, *(f'{c} AS "{name}"' for name, c in p.outputs.items())])
    return f"WITH {', '.join(ctes)} SELECT {outs} FROM s{len(p.stages)}"
