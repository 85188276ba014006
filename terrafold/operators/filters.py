"""Human-typed filters as Columns.

``state: ma and age: > 30`` compiles to one boolean Column, so Catalyst plans it like any
other predicate. A word matches a row if any searched column's text contains it, in lower
case; ``name: x`` looks in one column; ``> >= < <= = !=`` compare, by number if the word
is one; ``and``, ``or``, ``not``, parentheses and quotes combine. Adjacent words mean
"and" and bind first; then comparisons, the colon, not, and, or, and last adjacency.

``strict=False`` keeps the observable behaviour: the colon binds before ``or``, null cells
read ``null``, a comparison of several words becomes a substring test, and an empty cell
matches nothing. ``strict=True`` makes null cells match nothing. An empty filter
matches every row; a missing column matches none.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafold.functions.scalars import LITERAL_PATTERN, number_text, wordy_date

_TOKEN = re.compile(r"""\s*(?:(?P<quoted>'[^']*'|"[^"]*")|(?P<op>>=|<=|!=|[():><=])|(?P<text>[^\s():><='"!]+|!))""")


@dataclass(frozen=True)
class Word:
    text: str

    def __str__(self) -> str:
        plain = re.fullmatch(r"[^\s():><='\"!]+", self.text) and self.text not in ("and", "or", "not")
        return self.text if plain else f"'{self.text}'"


@dataclass(frozen=True)
class Node:
    """op is one of ``and or not :`` or a comparison; not and comparisons have one part."""

    op: str
    parts: tuple

    def __str__(self) -> str:
        shown = [f"({p})" if isinstance(p, Node) else str(p) for p in self.parts]
        if self.op == ":":
            return f"{shown[0]}: {shown[1]}"
        return f" {self.op} ".join(shown) if len(shown) == 2 else f"{self.op} {shown[0]}"


Tree = Word | Node


def _tokens(text: str) -> list[tuple[str, str]]:
    """(kind, value): ``word``, or the operator as its own kind; operators without operands are words."""
    found = []
    for m in _TOKEN.finditer(text.lower()):
        if m["quoted"] is not None:
            found += [("word", m["quoted"][1:-1])] if len(m["quoted"]) > 2 else []
        elif m["op"]:
            found.append((m["op"], m["op"]))
        elif m["text"] in ("and", "or", "not"):
            found.append((m["text"], m["text"]))
        else:
            found.append(("word", m["text"]))
    starts, out = {"word", "(", "not", ">", ">=", "<", "<=", "=", "!="}, []
    for n in reversed(range(len(found))):
        kind, value = found[n]
        before, after = found[n - 1][0] if n else None, out[-1][0] if out else None
        bare = kind not in ("word", "(", ")") and after not in starts
        bare |= kind in ("and", "or", ":") and before not in ("word", ")")
        out.append(("word", value) if bare else (kind, value))
    return out[::-1]


class _Reader:
    def __init__(self, text: str):
        self.tokens, self.at = _tokens(text), 0

    def peek(self) -> str | None:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else None

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1][1]

    def joined(self) -> Tree | None:
        parts = []
        while (kind := self.peek()) not in (None, ")"):
            part = self.chain(("or", "and", ":"), 0)
            if part is not None:
                parts.append(part)
            elif self.peek() == kind:
                self.take()
        return reduce(lambda a, b: Node("and", (a, b)), parts) if parts else None

    def chain(self, ops: tuple[str, ...], level: int) -> Tree | None:
        """Left-associative chains: or, and, then (after not) the colon."""
        if level == len(ops):
            return self.compared()
        if ops[level] == ":" and self.peek() == "not":
            self.take()
            inner = self.chain(ops, level)
            return None if inner is None else Node("not", (inner,))
        left = self.chain(ops, level + 1)
        while self.peek() == ops[level]:
            self.take()
            right = self.chain(ops, level + 1)
            left = right if left is None else left if right is None else Node(ops[level], (left, right))
        return left

    def compared(self) -> Tree | None:
        if self.peek() in (">", ">=", "<", "<=", "=", "!="):
            op, inner = self.take(), self.compared()
            return None if inner is None else Node(op, (inner,))
        if self.peek() == "(":
            self.take()
            inner = self.joined()
            if self.peek() == ")":
                self.take()
            return inner
        words = []
        while self.peek() == "word":
            words.append(Word(self.take()))
        return reduce(lambda a, b: Node("and", (a, b)), words) if words else None


def parse(text: str) -> Tree | None:
    """The tree of a filter, or None if it is empty."""
    reader, parts = _Reader(text), []
    while reader.peek() is not None:
        part = reader.joined()
        if part is not None:
            parts.append(part)
        if reader.peek() == ")":
            reader.take()
    return reduce(lambda a, b: Node("and", (a, b)), parts) if parts else None


def contains_clause(tree: Tree | None, clause: Tree | None) -> bool:
    """Whether a tree is in another."""
    return tree == clause or isinstance(tree, Node) and any(contains_clause(p, clause) for p in tree.parts)


def add_clause(tree: Tree | None, clause: Tree | None) -> Tree | None:
    """Both, unless the clause is in the tree."""
    if tree is None or clause is None:
        return tree or clause
    return tree if contains_clause(tree, clause) else Node("and", (tree, clause))


def remove_clause(tree: Tree | None, clause: Tree | None) -> Tree | None:
    """The tree without the clause; what loses a part becomes its other part."""
    if tree is None or tree == clause:
        return None
    if isinstance(tree, Word):
        return tree
    parts = [p for p in (remove_clause(p, clause) for p in tree.parts) if p is not None]
    if len(parts) == len(tree.parts):
        return Node(tree.op, tuple(parts))
    return parts[0] if parts and tree.op in ("and", "or") else None


def cell_text(field: T.StructField, kind: str | None, now: Column, strict: bool) -> Column:
    """A cell as lower-case text."""
    c = F.col(f"`{field.name}`")
    if kind == "date":
        text = wordy_date(c.cast("timestamp"), now)
    elif isinstance(field.dataType, T.NumericType):
        text = number_text(c)
    else:
        text = c.cast("string")
    return F.lower(text if strict else F.coalesce(text, F.lit("null")))


def compile_filter(tree: Tree | str | None, schema: T.StructType, types: dict[str, str] | None = None, now: Column | None = None, strict: bool = False) -> Column:
    """A filter as a boolean Column over a schema; ``types`` marks columns ``skip`` or ``date``."""
    tree = parse(tree) if isinstance(tree, str) else tree
    types, now = types or {}, F.current_timestamp() if now is None else now
    fields = {f.name: f for f in schema.fields if types.get(f.name) != "skip"}

    def cell(field: T.StructField, word: str, relation: str | None) -> Column:
        text = cell_text(field, types.get(field.name), now, strict)
        filled = F.coalesce(text != "", F.lit(False))
        if relation is None:
            test = F.contains(text, F.lit(word))
        elif re.fullmatch(LITERAL_PATTERN, word):
            number = F.when(text.rlike(LITERAL_PATTERN), F.trim(text).try_cast("double"))
            test = F.coalesce(_compare(number, float(word), relation), F.lit(relation == "!="))
        else:
            test = _compare(text, word, relation)
        return F.coalesce(filled & test, F.lit(False))

    def build(node: Tree, prop: str | None, relation: str | None) -> Column:
        if isinstance(node, Word):
            chosen = [f for f in fields.values() if prop is None or f.name == prop]
            return reduce(or_, (cell(f, node.text, relation) for f in chosen), F.lit(False))
        if node.op == "not":
            return ~build(node.parts[0], prop, None)
        if node.op in ("and", "or"):
            return (and_ if node.op == "and" else or_)(*(build(p, prop, None) for p in node.parts))
        if node.op == ":":
            left, right = node.parts
            return build(right, left.text if isinstance(left, Word) else prop, None)
        return build(node.parts[0], prop, node.op)

    return F.lit(True) if tree is None else build(tree, None, None)


def _compare(left: Column, right: object, op: str) -> Column:
    return {">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right, "=": left == right, "!=": left != right}[op]


def filter_rows(df: DataFrame, text: str, types: dict[str, str] | None = None, now: Column | None = None, strict: bool = False) -> DataFrame:
    """The rows that a filter matches."""
    return df.filter(compile_filter(text, df.schema, types, now, strict))


def with_search_text(df: DataFrame, types: dict[str, str] | None = None, now: Column | None = None, name: str = "_search") -> DataFrame:
    """Adds all cells in lower case, joined by ``|``, for repeated free-text filters."""
    types, now = types or {}, F.current_timestamp() if now is None else now
    cells = [F.lit("") if types.get(f.name) == "skip" else cell_text(f, types.get(f.name), now, False) for f in df.schema.fields]
    return df.withColumn(name, F.concat_ws("|", *cells))


# row formats


_DETAIL = re.compile(r"\s*(?:(?P<number>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<text>'[^']*')|(?P<op>[=!]==?|&&|\|\||[<>]=?|[-+*/()?:!]))")
#: Binary operators from the loosest to the tightest.
_LEVELS = (("||",), ("&&",), ("==", "===", "!=", "!=="), ("<", "<=", ">", ">="), ("+", "-"), ("*", "/"))


class _Detail:
    """Reads an expression to (kind, column); kind is number, truth or text."""

    def __init__(self, tokens: list[tuple[str, str]], columns: list[str]):
        self.tokens, self.columns, self.at = tokens, columns, 0

    def take(self, *ops: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "op" and self.tokens[self.at][1] in ops:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, op: str) -> None:
        if not self.take(op):
            raise ValueError(f"{op} is missing")

    @staticmethod
    def truth(x: tuple[str, Column]) -> Column:
        kind, c = x
        return F.coalesce(c if kind == "truth" else (c != "") if kind == "text" else (c != 0) & ~F.isnan(c), F.lit(False))

    @staticmethod
    def number(x: tuple[str, Column]) -> Column:
        return x[1].cast("int").cast("double") if x[0] == "truth" else x[1].try_cast("double") if x[0] == "text" else x[1]

    def choice(self) -> tuple[str, Column]:
        test = self.binary(0)
        if not self.take("?"):
            return test
        yes = self.choice()
        self.need(":")
        no = self.choice()
        if yes[0] != no[0]:  # one of them is no number
            yes, no = (("number", F.lit(0.0)) if x[0] == "truth" else x for x in (yes, no))
            if yes[0] != no[0]:
                raise ValueError("a number or a text")
        return yes[0], F.when(self.truth(test), yes[1]).otherwise(no[1])

    def binary(self, level: int) -> tuple[str, Column]:
        if level == len(_LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while op := self.take(*_LEVELS[level]):
            right = self.binary(level + 1)
            if op in ("||", "&&"):
                a, b = self.truth(left), self.truth(right)
                left = ("truth", a | b if op == "||" else a & b)
                continue
            same = left[0] == right[0] == "text"
            a, b = (left[1], right[1]) if same else (self.number(left), self.number(right))
            if same and op == "+":
                left = ("text", F.concat(a, b))
            elif level < 4:
                left = ("truth", {"==": a == b, "=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op[:2]])
            else:
                a, b = self.number(left), self.number(right)
                left = ("number", a + b if op == "+" else a - b if op == "-" else a * b if op == "*" else F.when(b != 0, a / b))
        return left

    def unary(self) -> tuple[str, Column]:
        if self.take("!"):
            return "truth", ~self.truth(self.unary())
        if self.take("-"):
            return "number", -self.number(self.unary())
        if self.take("+"):
            return "number", self.number(self.unary())
        if self.take("("):
            inner = self.choice()
            self.need(")")
            return inner
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return "number", F.lit(float(value))
        if kind == "text":
            return "text", F.lit(value[1:-1])
        if kind != "name" or value not in self.columns:
            raise ValueError(value)
        return "number", F.col(f"`{value}`").cast("double")


def detail(expression: str, columns: list[str]) -> Column:
    """``=Dem / (Dem + Rep)`` over numeric columns, with comparisons, ``&& || !`` and ``a ? b : c``.

    Unknown names, errors and results that are no number are 0, as is what a divisor of 0 leads to.
    """
    tokens, text, at = [], expression.strip().removeprefix("="), 0
    while at < len(text.rstrip()):
        m = _DETAIL.match(text, at)
        if m is None:
            return F.lit(0.0)
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    reader = _Detail(tokens, columns)
    try:
        kind, out = reader.choice()
    except (ValueError, IndexError):
        return F.lit(0.0)
    if kind == "truth" or reader.at < len(tokens):
        return F.lit(0.0)
    out = out.try_cast("double") if kind == "text" else out
    return F.coalesce(F.nanvl(out, F.lit(0.0)), F.lit(0.0))


def row_total(df: DataFrame, columns: list[str], name: str = "Total") -> DataFrame:
    """Adds the sum of numeric columns, unless ``Tot`` or ``Total`` is there."""
    if {"Tot", "Total"} & set(df.columns):
        return df
    return df.withColumn(name, reduce(lambda a, b: a + b, (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns)))


# session rows


def session_mode(user: str, now: Column) -> dict[str, Column]:
    """Predicates over (createdBy, published, deleted, modifyTime) by mode.

    Trash, recent and owned sessions are the user's own; a session without an owner is nobody's, and one
    without a modify time counts as recent. Public and shared ones may be deleted.
    """
    mine, gone = F.coalesce(F.col("createdBy") == user, F.lit(False)), F.coalesce(F.col("deleted"), F.lit(False))
    fresh = F.col("modifyTime").isNull() | (F.col("modifyTime") > now - F.expr("INTERVAL 7 DAYS"))
    return {
        "public": F.col("published").isNotNull(),
        "shared": ~mine,
        "trash": mine & gone,
        "recent": mine & ~gone & fresh,
        "owned": mine & ~gone,
    }


def access_permission(access: Column, user: str) -> Column:
    """Permission bits of an access entry: anyone's if it lists no user, else its users'."""
    users = access["userIDs"]
    return F.when((F.size(users) == 0) | F.array_contains(users, user), access["perm"]).otherwise(0)


def access_map_permission(entries: DataFrame, keys: list[str], user: str) -> DataFrame:
    """Per ``keys``, the union of bits over exploded access entries (userIDs, perm) that list the user."""
    return entries.filter(F.array_contains("userIDs", user)).groupBy(*keys).agg(F.bit_or("perm").alias("perm"))
