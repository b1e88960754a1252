"""String cuts and expressions over the columns of a DataFrame.

The text is Python expression syntax once ``&&`` and ``||`` are spelled
``and`` and ``or``, so Python's own :mod:`ast` reads it and this module only
maps its nodes to Column operators. Nothing is ever evaluated.
"""

from __future__ import annotations

import ast
import operator
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkjets.functions.numeric import ratio

_COMPARE = {
    ast.Eq: operator.eq,
    ast.NotEq: operator.ne,
    ast.Lt: operator.lt,
    ast.LtE: operator.le,
    ast.Gt: operator.gt,
    ast.GtE: operator.ge,
}
_ARITHMETIC = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: ratio}


def _read(text: str) -> tuple[ast.expr, dict[str, str]]:
    """Parse the text; back-quoted column names come back through the alias map."""
    quoted: dict[str, str] = {}

    def stand_in(match: re.Match) -> str:
        name = f"quoted_name_{len(quoted)}"
        quoted[name] = match.group(1)
        return name

    text = re.sub(r"`([^`]+)`", stand_in, text)
    text = re.sub(r"&&?", " and ", text)
    text = re.sub(r"\|\|?", " or ", text)
    try:
        return ast.parse(text.strip(), mode="eval").body, quoted
    except SyntaxError as error:
        raise ValueError(f"not a valid expression: {text!r}") from error


class _Compiler:
    def __init__(self, schema: T.StructType, quoted: dict[str, str]):
        self.types = {f.name: f.dataType for f in schema.fields}
        self.quoted = quoted

    def name(self, node: ast.Name) -> tuple[Column, T.DataType]:
        name = self.quoted.get(node.id, node.id)
        if name not in self.types:
            raise ValueError(f"{name!r} is neither a column nor a number")
        return F.col(f"`{name}`"), self.types[name]

    def value(self, node: ast.expr) -> tuple[Column, T.DataType]:
        """A value and its type; the type matters for arrays and NaN only."""
        match node:
            case ast.Constant(value=bool() | int() | float() as number):
                return F.lit(number), T.LongType() if isinstance(number, int) else T.DoubleType()
            case ast.Constant(value=str() as text):
                return F.lit(text), T.StringType()
            case ast.Name():
                return self.name(node)
            case ast.UnaryOp(op=ast.USub(), operand=inner):
                column, kind = self.value(inner)
                return -column, kind
            case ast.UnaryOp(op=ast.UAdd(), operand=inner):
                return self.value(inner)
            case ast.Subscript(value=base, slice=index):
                return self.element(*self.value(base), index)
            case ast.BinOp(left=left, op=op, right=right) if type(op) in _ARITHMETIC:
                return self.arithmetic(_ARITHMETIC[type(op)], self.value(left), self.value(right))
        raise ValueError(f"unsupported expression: {ast.unparse(node)}")

    def arithmetic(self, apply, left, right):
        (a, a_type), (b, b_type) = left, right
        a_array, b_array = isinstance(a_type, T.ArrayType), isinstance(b_type, T.ArrayType)
        if a_array and b_array:
            return F.zip_with(a, b, apply), a_type
        if a_array:
            return F.transform(a, lambda x: apply(x, b)), a_type
        if b_array:
            return F.transform(b, lambda x: apply(a, x)), b_type
        both_long = isinstance(a_type, T.LongType) and isinstance(b_type, T.LongType) and apply is not ratio
        return apply(a, b), T.LongType() if both_long else T.DoubleType()

    def element(self, column: Column, kind: T.DataType, index: ast.expr):
        parts = index.elts if isinstance(index, ast.Tuple) else [index]
        if not isinstance(kind, T.ArrayType):
            raise ValueError("only array columns can be indexed")
        head, rest = parts[0], parts[1:]
        inner = ast.Tuple(elts=rest) if len(rest) > 1 else (rest[0] if rest else None)
        if isinstance(head, ast.Slice):
            low = 0 if head.lower is None else ast.literal_eval(head.lower)
            if low < 0 or head.step is not None:
                raise ValueError("slices take non-negative bounds and no step")
            high = None if head.upper is None else ast.literal_eval(head.upper)
            if inner is not None:
                deeper = kind.elementType
                column = F.transform(column, lambda x: self.element(x, deeper, inner)[0])
                kind = T.ArrayType(self.element(F.lit(None), deeper, inner)[1])
            if high == low + 1:  # a slice of one element stands for the element
                return F.get(column, F.lit(low)), kind.elementType
            if low == 0 and high is None:
                return column, kind
            if high is None:
                count = F.greatest(F.size(column) - low, F.lit(0))
            elif high < 0:
                count = F.greatest(F.size(column) + high - low, F.lit(0))
            else:
                count = F.lit(max(high - low, 0))
            return F.slice(column, F.lit(low + 1), count), kind
        position = ast.literal_eval(head)
        item = F.get(column, F.lit(position)) if position >= 0 else F.try_element_at(column, F.lit(position))
        return (item, kind.elementType) if inner is None else self.element(item, kind.elementType, inner)

    def comparison(self, op, left, right) -> Column:
        (a, a_type), (b, b_type) = left, right
        compare = _COMPARE[type(op)]
        a_array, b_array = isinstance(a_type, T.ArrayType), isinstance(b_type, T.ArrayType)
        if a_array and b_array:
            return F.forall(F.zip_with(a, b, compare), lambda ok: ok)
        if a_array:
            return F.forall(a, lambda x: compare(x, b))
        if b_array:
            return F.forall(b, lambda x: compare(a, x))
        result = compare(a, b)
        if not isinstance(op, ast.NotEq):  # Spark orders NaN above every number; a cut must reject it
            for column, kind in (left, right):
                if isinstance(kind, (T.DoubleType, T.FloatType)):
                    result = result & ~F.isnan(column)
        return result

    def predicate(self, node: ast.expr) -> Column:
        match node:
            case ast.BoolOp(op=op, values=values):
                parts = [self.predicate(v) for v in values]
                join = operator.and_ if isinstance(op, ast.And) else operator.or_
                result = parts[0]
                for part in parts[1:]:
                    result = join(result, part)
                return result
            case ast.UnaryOp(op=ast.Not(), operand=inner):
                return ~self.predicate(inner)
            case ast.Compare(left=left, ops=ops, comparators=others):
                sides = [self.value(n) for n in (left, *others)]
                result = self.comparison(ops[0], sides[0], sides[1])
                for op, a, b in zip(ops[1:], sides[1:], sides[2:]):
                    result = result & self.comparison(op, a, b)
                return result
            case ast.Name():
                column, kind = self.name(node)
                if isinstance(kind, T.BooleanType):
                    return column
        raise ValueError(f"not a predicate: {ast.unparse(node)}")


def _check_not_mixed(text: str) -> None:
    """``&&`` and ``||`` may not share a bracket level: their precedence would be a guess."""
    seen: list[set[str]] = [set()]
    for token in re.findall(r"\(|\)|&&|\|\|", text):
        if token == "(":
            seen.append(set())
        elif token == ")":
            if len(seen) == 1:
                raise ValueError(f"unbalanced brackets in {text!r}")
            seen.pop()
        else:
            seen[-1].add(token)
            if len(seen[-1]) == 2:
                raise ValueError(f"use brackets to separate && and || in {text!r}")


class Cut:
    """A row predicate as text: comparisons joined by ``&&`` or ``||``.

    A comparison on an array column holds when it holds for every element.
    """

    def __init__(self, text: str):
        _check_not_mixed(text)
        self.text = text

    def __and__(self, other: "Cut") -> "Cut":
        return Cut(f"({self.text}) && ({other.text})")

    def __or__(self, other: "Cut") -> "Cut":
        return Cut(f"({self.text}) || ({other.text})")

    def __str__(self) -> str:
        return self.text

    def column(self, df: DataFrame) -> Column:
        return row_query(df, self.text)


def row_query(df: DataFrame, text: str) -> Column:
    """Predicate from query text (``and or not & |``, arithmetic, chained comparisons)."""
    tree, quoted = _read(text)
    return _Compiler(df.schema, quoted).predicate(tree)


def _right_grouped(node: ast.expr) -> ast.expr:
    """Regroup chains so that ``a-b-c`` reads a-(b-c) and ``a/b/c`` reads a/(b/c)."""
    if not isinstance(node, ast.BinOp):
        return node
    loose, tight = ((ast.Add, ast.Sub) if isinstance(node.op, (ast.Add, ast.Sub)) else (ast.Mult, ast.Div))
    terms, ops = [], []
    while isinstance(node, ast.BinOp) and isinstance(node.op, (loose, tight)):
        terms.append(_right_grouped(node.right))
        ops.append(node.op)
        node = node.left
    terms.append(_right_grouped(node))
    # terms and ops are in reverse order; close a group at every loose operator
    groups: list[ast.expr] = []
    group = terms[0]
    for op, term in zip(ops, terms[1:]):
        if isinstance(op, loose):
            groups.append(group)
            group = term
        else:
            group = ast.BinOp(left=term, op=op, right=group)
    for right in reversed(groups):
        group = ast.BinOp(left=group, op=loose(), right=right)
    return group


def expression(df: DataFrame, text: str, legacy: bool = False) -> Column:
    """Value from text: columns, numbers, ``+ - * /``, ``v[0]``, ``v[1:3]``, ``v[:, 0]``."""
    if text in df.columns:
        return F.col(f"`{text}`")
    tree, quoted = _read(text)
    if legacy:
        tree = _right_grouped(tree)
    return _Compiler(df.schema, quoted).value(tree)[0]
