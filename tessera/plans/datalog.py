"""A read-only Datalog subset, compiled to DataFrames.

A script is a set of rules ``head[vars] := body`` and data ``head[vars] <- [[...], ...]``;
``?`` is the answer. Bodies have stored atoms ``*nodes[...]``, rule atoms, ``not``,
unification, ``in``, comparisons, ``or`` and functions; heads may count. ``:limit`` and
``:offset`` page the answer, which is ordered by its columns. Rules are stratified by
their dependencies; recursion runs as a semi-naive fixpoint. There is no way to write.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import materialise, written

MAX_ROUNDS = 1000


class DatalogError(ValueError):
    """The script isn't valid, or isn't in the subset."""


_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<number>\d+\.\d+(?:[eE][+-]?\d+)?|\d+)
    |(?P<param>\$\w+)|(?P<option>:(?:limit|offset)\b)|(?P<name>[^\W\d]\w*|\?)|(?P<op>:=|<-|<=|>=|!=|==|\|\||&&|[\[\](),*=<>+\-/%!])""",
    re.X,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _tokens(script: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(script):
        m = _TOKEN.match(script, at)
        if not m or m.end() == at:
            raise DatalogError(f"unexpected text: {script[at : at + 20]!r}")
        if m.lastgroup:
            out.append((m.lastgroup, m.group()))
        at = m.end()
    return out


@dataclass
class Term:
    """kind: var, const, call (name, args) or list (args)."""

    kind: str
    value: object = None
    args: list[Term] = field(default_factory=list)

    def variables(self) -> set[str]:
        return {self.value} if self.kind == "var" else set().union(*[a.variables() for a in self.args]) if self.args else set()


@dataclass
class Atom:
    """kind: stored, rule, unify (var, term), member (term, list) or test (term)."""

    kind: str
    name: str = ""
    args: list[Term] = field(default_factory=list)
    negated: bool = False


@dataclass
class Rule:
    head: str
    outputs: list[tuple[str, str | None]]
    body: list[Atom] | None
    rows: list[list[object]] | None = None


_FUNCTIONS = {
    "str_includes": (2, lambda a, b: a.contains(b)),
    "starts_with": (2, lambda a, b: a.startswith(b)),
    "ends_with": (2, lambda a, b: a.endswith(b)),
    "lowercase": (1, F.lower),
    "uppercase": (1, F.upper),
    "is_null": (1, lambda a: a.isNull()),
    "length": (1, F.length),
}
_BINARY = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b, "%": lambda a, b: a % b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "==": lambda a, b: a.eqNullSafe(b), "!=": lambda a, b: ~a.eqNullSafe(b), "or": lambda a, b: a | b, "and": lambda a, b: a & b}
_LEVELS = (("or",), ("and",), ("==", "!=", "<", ">", "<=", ">="), ("+", "-"), ("*", "/", "%"))
_SAME = {"||": "or", "&&": "and"}


class _Parser:
    def __init__(self, script: str, params: dict) -> None:
        self.tokens, self.at, self.params, self.wild = _tokens(script), 0, params, 0
        self.limit: int | None = None
        self.offset = 0

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][1] if self.at + ahead < len(self.tokens) else ""

    def kind(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][0] if self.at + ahead < len(self.tokens) else ""

    def take(self, text: str) -> bool:
        if self.peek() == text and self.kind() not in ("string",):
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise DatalogError(f"expected {text!r} before {self.peek()!r}")

    def word(self) -> str:
        if self.kind() != "name":
            raise DatalogError(f"expected a name before {self.peek()!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def script(self) -> list[Rule]:
        rules = []
        while self.at < len(self.tokens):
            if self.kind() == "option":
                option = self.peek()
                self.at += 1
                if self.kind() != "number" or "." in self.peek():
                    raise DatalogError(f"{option} needs a whole number")
                value = int(self.peek())
                self.at += 1
                if option == ":limit":
                    self.limit = value
                else:
                    self.offset = value
            else:
                rules.append(self.rule())
        return rules

    def rule(self) -> Rule:
        name = self.word()
        self.need("[")
        outputs: list[tuple[str, str | None]] = []
        while not self.take("]"):
            out = self.word()
            if self.take("("):
                if out != "count":
                    raise DatalogError(f"unknown aggregate {out}")
                outputs.append((self.word(), out))
                self.need(")")
            else:
                outputs.append((out, None))
            if self.peek() != "]":
                self.need(",")
        if self.take("<-"):
            rows = self.literal(self.term())
            if not isinstance(rows, list) or not all(isinstance(r, list) and len(r) == len(outputs) for r in rows):
                raise DatalogError(f"data of {name} must be a list of rows")
            return Rule(name, outputs, None, rows)
        self.need(":=")
        body = [self.atom()]
        while self.take(","):
            body.append(self.atom())
        return Rule(name, outputs, body)

    def literal(self, t: Term) -> object:
        if t.kind == "list":
            return [self.literal(x) for x in t.args]
        if t.kind != "const":
            raise DatalogError("data must be constants")
        return t.value

    def arguments(self) -> list[Term]:
        self.need("[")
        out = []
        while not self.take("]"):
            if self.peek() == "_":
                self.at += 1
                self.wild += 1
                out.append(Term("var", f"_{self.wild}"))
            else:
                out.append(self.term())
            if self.peek() != "]":
                self.need(",")
        return out

    def atom(self) -> Atom:
        if self.kind() == "name" and self.peek() == "not" and (self.peek(1) == "*" or self.kind(1) == "name" and self.peek(2) == "["):
            self.at += 1
            inner = self.atom()
            inner.negated = not inner.negated
            return inner
        if self.take("*"):
            return Atom("stored", self.word(), self.arguments())
        if self.kind() == "name" and self.peek(1) == "[":
            return Atom("rule", self.word(), self.arguments())
        if self.kind() == "name" and self.peek(1) == "=" and self.peek() not in ("true", "false", "null"):
            name = self.word()
            self.at += 1
            return Atom("unify", name, [self.term()])
        term = self.term()
        if self.take("in"):
            return Atom("member", "", [term, self.term()])
        return Atom("test", "", [term])

    def term(self, level: int = 0) -> Term:
        if level == len(_LEVELS):
            return self.unary()
        left = self.term(level + 1)
        while self.kind() in ("op", "name") and (op := _SAME.get(self.peek(), self.peek())) in _LEVELS[level]:
            self.at += 1
            left = Term("call", op, [left, self.term(level + 1)])
        return left

    def unary(self) -> Term:
        kind, text = self.kind(), self.peek()
        if not kind:
            raise DatalogError("the script ends inside a rule")
        self.at += 1
        if kind == "string":
            return Term("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "number":
            return Term("const", float(text) if "." in text else int(text))
        if kind == "param":
            if text[1:] not in self.params:
                raise DatalogError(f"unknown parameter {text}")
            return self.constant(self.params[text[1:]])
        if text == "(":
            inner = self.term()
            self.need(")")
            return inner
        if text == "[":
            items = []
            while not self.take("]"):
                items.append(self.term())
                if self.peek() != "]":
                    self.need(",")
            return Term("list", None, items)
        if text in ("-", "!") or text == "not":
            return Term("call", "neg" if text == "-" else "not", [self.unary()])
        if kind == "name":
            if text in ("true", "false", "null"):
                return Term("const", {"true": True, "false": False, "null": None}[text])
            if self.take("("):
                args = []
                while not self.take(")"):
                    args.append(self.term())
                    if self.peek() != ")":
                        self.need(",")
                if text not in _FUNCTIONS or _FUNCTIONS[text][0] != len(args):
                    raise DatalogError(f"unknown function {text}/{len(args)}")
                return Term("call", text, args)
            if text != "?":
                return Term("var", text)
        raise DatalogError(f"unexpected {text!r}")

    def constant(self, value: object) -> Term:
        return Term("list", None, [self.constant(x) for x in value]) if isinstance(value, list | tuple) else Term("const", value)


def _column(t: Term) -> Column:
    if t.kind == "var":
        return F.col(f"`{t.value}`")
    if t.kind == "const":
        return F.lit(t.value)
    if t.kind == "list":
        return F.array(*[_column(a) for a in t.args])
    args = [_column(a) for a in t.args]
    if t.value == "neg":
        return -args[0]
    if t.value == "not":
        return ~args[0]
    return _BINARY[t.value](*args) if t.value in _BINARY else _FUNCTIONS[t.value][1](*args)


def _type_of(values: list[object]) -> T.DataType:
    known = [v for v in values if v is not None]
    if all(isinstance(v, bool) for v in known) and known:
        return T.BooleanType()
    if all(isinstance(v, int) and not isinstance(v, bool) for v in known) and known:
        return T.LongType()
    if all(isinstance(v, int | float) and not isinstance(v, bool) for v in known) and known:
        return T.DoubleType()
    if any(not isinstance(v, str) for v in known):
        raise DatalogError("values of one column must have one type")
    return T.StringType()


class _Compiler:
    def __init__(self, spark: SparkSession, stored: dict[str, DataFrame]) -> None:
        self.spark, self.stored = spark, dict(stored)
        self.done: dict[str, DataFrame] = {}

    def data(self, rows: list[list[object]], names: list[str]) -> DataFrame:
        types = [_type_of([r[k] for r in rows]) for k in range(len(names))]
        rows = [tuple(float(v) if isinstance(t, T.DoubleType) and v is not None else v for v, t in zip(r, types, strict=True)) for r in rows]
        return self.spark.createDataFrame(rows, T.StructType([T.StructField(n, t) for n, t in zip(names, types, strict=True)]))

    def relation(self, atom: Atom, override: DataFrame | None = None) -> DataFrame:
        """The atom's rows, with its variables as columns; constants and repeats are filters."""
        if override is not None:
            df = override
        elif atom.kind == "stored":
            if atom.name not in self.stored:
                raise DatalogError(f"unknown relation *{atom.name}")
            df = self.stored[atom.name]
        elif atom.name in self.done:
            df = self.done[atom.name]
        else:
            raise DatalogError(f"unknown rule {atom.name}")
        if len(df.columns) != len(atom.args):
            raise DatalogError(f"{atom.name} has {len(df.columns)} columns, not {len(atom.args)}")
        seen: dict[str, Column] = {}
        for c, t in zip(df.columns, atom.args, strict=True):
            if t.kind == "var" and t.value not in seen:
                seen[t.value] = F.col(f"`{c}`")
            elif t.kind == "var":
                df = df.where(F.col(f"`{c}`").eqNullSafe(seen[t.value]))
            elif t.variables():
                raise DatalogError("an atom's arguments must be variables or constants")
            else:
                df = df.where(F.col(f"`{c}`").eqNullSafe(_column(t)))
        named = [c.alias(v) for v, c in seen.items() if not v.startswith("_") or atom.negated is False and not v[1:].isdigit()]
        return df.select(*named) if named else df.select(F.lit(1).alias("_0")).limit(1)

    def body(self, atoms: list[Atom], overrides: dict[int, DataFrame]) -> DataFrame:
        todo = list(enumerate(atoms))
        env: DataFrame | None = None
        bound: set[str] = set()

        def ready(atom: Atom) -> bool:
            if atom.kind in ("stored", "rule"):
                return not atom.negated
            if atom.kind == "unify":
                return atom.args[0].variables() <= bound
            return set().union(*[a.variables() for a in atom.args]) <= bound

        while todo:
            tests = [x for x in todo if x[1].kind in ("test", "member") and ready(x[1])] if env is not None else []
            unify = [x for x in todo if x[1].kind == "unify" and ready(x[1]) and (env is not None and (x[1].name in bound or x[1].args[0].variables()))]
            positive = [x for x in todo if x[1].kind in ("stored", "rule") and not x[1].negated]
            linked = [x for x in positive if env is None or bound & set().union(*[a.variables() for a in x[1].args])] or positive
            if tests or unify:
                at, atom = (tests or unify)[0]
                todo.remove((at, atom))
                env, bound = self.predicate(env, bound, atom)
            elif linked:
                at, atom = linked[0]
                todo.remove((at, atom))
                rows = self.relation(atom, overrides.get(at))
                shared = [c for c in rows.columns if c in bound]
                if env is None:
                    env = rows
                elif shared:
                    right = rows.select(*[F.col(f"`{c}`").alias(f"__{c}" if c in shared else c) for c in rows.columns])
                    on = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"`__{c}`")) for c in shared])
                    env = env.join(right, on).drop(*[f"__{c}" for c in shared])
                else:
                    env = env.crossJoin(rows)
                bound |= set(rows.columns)
            else:
                free = [x for x in todo if not x[1].negated and (x[1].kind == "unify" and ready(x[1]) or x[1].kind == "member" and x[1].args[0].kind == "var" and not x[1].args[1].variables())]
                if free:
                    at, atom = free[0]
                    todo.remove((at, atom))
                    env, bound = self.generate(env, bound, atom)
                    continue
                at, atom = todo.pop(0)
                if not atom.negated:
                    raise DatalogError("a variable isn't bound by any atom")
                rows = self.relation(atom, overrides.get(at))
                shared = [c for c in rows.columns if c in bound]
                if {c for c in rows.columns if not c.startswith("_")} - bound:
                    raise DatalogError("a negated atom has an unbound variable")
                env = env if env is not None else self.spark.range(1).select(F.lit(1).alias("_0"))
                if shared:
                    right = rows.select(*[F.col(f"`{c}`").alias(f"__{c}") for c in shared])
                    env = env.join(right, reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"`__{c}`")) for c in shared]), "left_anti")
                else:
                    env = env.join(rows.withColumnRenamed(rows.columns[0], "__any"), F.lit(True), "left_anti")
        return env

    def predicate(self, env: DataFrame, bound: set[str], atom: Atom) -> tuple[DataFrame, set[str]]:
        if atom.kind == "unify":
            value = _column(atom.args[0])
            if atom.name in bound:
                return env.where(F.col(f"`{atom.name}`").eqNullSafe(value)), bound
            return env.withColumn(atom.name, value), bound | {atom.name}
        if atom.kind == "member":
            items = atom.args[1]
            if items.kind != "list":
                raise DatalogError("'in' needs a list")
            test = _column(atom.args[0]).isin(*[x.value for x in items.args]) if all(x.kind == "const" for x in items.args) else reduce(lambda a, b: a | b, [_column(atom.args[0]).eqNullSafe(_column(x)) for x in items.args])
            return env.where(test if items.args else F.lit(False)), bound
        return env.where(_column(atom.args[0])), bound

    def generate(self, env: DataFrame | None, bound: set[str], atom: Atom) -> tuple[DataFrame, set[str]]:
        """Bind a variable that no atom has, to one value or to each of a list."""
        if atom.kind == "unify":
            env = env if env is not None else self.spark.range(1).select(F.lit(1).alias("_0"))
            return env.withColumn(atom.name, _column(atom.args[0])), bound | {atom.name}
        if atom.args[1].kind != "list":
            raise DatalogError("'in' needs a list")
        name = atom.args[0].value
        rows = self.data([[x.value] for x in atom.args[1].args], [name])
        return (rows if env is None else env.crossJoin(rows)), bound | {name}

    def evaluate(self, rule: Rule, overrides: dict[int, DataFrame] | None = None) -> DataFrame:
        names = [f"count({v})" if agg else v for v, agg in rule.outputs]
        if rule.rows is not None:
            return self.data(rule.rows, names)
        env = self.body(rule.body, overrides or {})
        missing = {v for v, _ in rule.outputs} - set(env.columns)
        if missing:
            raise DatalogError(f"the head has unbound variables: {', '.join(sorted(missing))}")
        if any(agg for _, agg in rule.outputs):
            keys = [F.col(f"`{v}`").alias(v) for v, agg in rule.outputs if not agg]
            counts = [F.count(f"`{v}`").alias(f"count({v})") for v, agg in rule.outputs if agg]
            return env.distinct().groupBy(*keys).agg(*counts).select(*[F.col(f"`{n}`") for n in names])
        return env.select(*[F.col(f"`{v}`") for v, _ in rule.outputs])

    def stratum(self, names: list[str], rules: dict[str, list[Rule]]) -> None:
        """Evaluate rules that depend on each other; one that doesn't depend on itself takes one step."""
        loops = {n: [(r, k) for r in rules[n] if r.body for k, a in enumerate(r.body) if a.kind == "rule" and a.name in names] for n in names}
        if not any(loops.values()):
            (name,) = names
            self.done[name] = self.united([self.evaluate(r) for r in rules[name]])
            return
        for n in names:
            if any(agg for r in rules[n] for _, agg in r.outputs):
                raise DatalogError(f"{n} aggregates in recursion")
            if any(r.body[k].negated for r, k in loops[n]):
                raise DatalogError(f"{n} is negated in recursion")
        # Each round joins the stored relations of recursive rules: what they are made of is read once.
        for atom in (a for n in names for r, _ in loops[n] for a in r.body):
            if atom.kind == "stored" and atom.name in self.stored:
                self.stored[atom.name] = written(self.stored[atom.name])
        base = {n: [r for r in rules[n] if not r.body or not any(a.kind == "rule" and a.name in names for a in r.body)] for n in names}
        delta = {n: materialise(self.united([self.evaluate(r) for r in base[n]])) for n in names if base[n]}
        if not delta:
            raise DatalogError(f"{names[0]} has no rule to start from")
        # A rule of the stratum without a start takes its types from a rule that can be evaluated.
        self.done.update(delta)
        for _ in range(MAX_ROUNDS):
            fresh: dict[str, list[DataFrame]] = {n: [] for n in names}
            for n in names:
                for r, k in loops[n]:
                    if r.body[k].name in delta and all(a.name in self.done for a in r.body if a.kind == "rule"):
                        fresh[n].append(self.evaluate(r, {k: delta[r.body[k].name]}))
            delta = {}
            for n, found in fresh.items():
                if found:
                    new = self.united(found)
                    if n in self.done:
                        old = self.done[n]
                        same = reduce(lambda a, b: a & b, [F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in old.columns])
                        new = new.toDF(*old.columns).alias("a").join(old.alias("b"), same, "left_anti")
                    new = materialise(new)
                    if not new.isEmpty():
                        delta[n] = new
            for n, new in delta.items():
                self.done[n] = self.done[n].unionByName(new) if n in self.done else new
            if not delta:
                break
        else:
            raise DatalogError("no fixpoint")
        for n in names:
            if n not in self.done:
                raise DatalogError(f"{n} has no rule to start from")

    def united(self, frames: list[DataFrame]) -> DataFrame:
        if len({len(f.columns) for f in frames}) > 1:
            raise DatalogError("rules of one name must have the same number of columns")
        return reduce(lambda a, b: a.union(b.toDF(*a.columns)), frames).distinct()


def _strata(rules: dict[str, list[Rule]]) -> list[list[str]]:
    """Groups of rule names that depend on each other, each after what it needs (Tarjan)."""
    needs = {n: {a.name for r in rs for a in (r.body or []) if a.kind == "rule"} & set(rules) for n, rs in rules.items()}
    order: dict[str, int] = {}
    low: dict[str, int] = {}
    path: list[str] = []
    out: list[list[str]] = []

    def visit(n: str) -> None:
        order[n] = low[n] = len(order)
        path.append(n)
        for m in sorted(needs[n]):
            if m not in order:
                visit(m)
                low[n] = min(low[n], low[m])
            elif m in path:
                low[n] = min(low[n], order[m])
        if low[n] == order[n]:
            at = path.index(n)
            out.append(path[at:])
            del path[at:]

    for n in rules:
        if n not in order:
            visit(n)
    return out


def run_script(spark: SparkSession, stored: dict[str, DataFrame], script: str, params: dict | None = None) -> DataFrame:
    """The answer ``?`` of a script over ``stored`` relations."""
    parser = _Parser(script, params or {})
    by_name: dict[str, list[Rule]] = {}
    for r in parser.script():
        by_name.setdefault(r.head, []).append(r)
    if "?" not in by_name:
        raise DatalogError("the script has no answer rule ?[...]")
    compiler = _Compiler(spark, stored)
    for names in _strata(by_name):
        compiler.stratum(names, by_name)
    answer = compiler.done["?"]
    if parser.limit is not None or parser.offset:
        answer = answer.orderBy(*[F.col(f"`{c}`") for c in answer.columns])
        answer = answer.offset(parser.offset) if parser.offset else answer
        answer = answer.limit(parser.limit) if parser.limit is not None else answer
    return answer
