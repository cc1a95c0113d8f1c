"""Arithmetic on expressions held in a column, without running code.

Python's own operators are part of the semantics (// and % floor), so this is a
pandas function over Arrow batches; it returns the result or the error.
"""

from __future__ import annotations

import ast
import operator
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONGEST, EXPONENT, LARGEST = 200, 100, 1e100
TWO = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Pow: operator.pow}
ONE = {ast.UAdd: operator.pos, ast.USub: operator.neg}


def calculate(expression: str | None) -> float:
    """The value of an expression; ValueError says why it has none."""
    if not expression or not expression.strip() or len(expression) > LONGEST:
        raise ValueError(f"the expression must have 1 to {LONGEST} characters")
    try:
        todo = ast.parse(expression, mode="eval").body
    except SyntaxError as e:
        raise ValueError("no arithmetic") from e

    def value(node):
        match node:
            case ast.Constant(value=bool()):
                pass
            case ast.Constant(value=int() | float() as n):
                return n
            case ast.UnaryOp(op=op, operand=x) if type(op) in ONE:
                return ONE[type(op)](value(x))
            case ast.BinOp(left=x, op=op, right=y) if type(op) in TWO:
                x, y = value(x), value(y)
                if isinstance(op, ast.Pow) and abs(y) > EXPONENT:
                    raise ValueError(f"exponents go to {EXPONENT}")
                if not y and isinstance(op, (ast.Div, ast.FloorDiv, ast.Mod)):
                    raise ValueError("division by zero")
                out = TWO[type(op)](x, y)
                if isinstance(out, complex) or abs(out) > LARGEST:
                    raise ValueError("the result is out of range")
                return out
        raise ValueError("only numbers and arithmetic operators are allowed")

    return value(todo)


RESULT = T.StructType([T.StructField("result", T.DoubleType()), T.StructField("error", T.StringType())])


@lru_cache(1 << 16)
def outcome(expression: str | None) -> tuple[float | None, str | None]:
    """Result and error; a worker keeps those of its latest expressions."""
    try:
        return float(calculate(expression)), None
    except (ValueError, ArithmeticError, RecursionError) as why:
        return None, str(why)


@F.pandas_udf(RESULT)
def safe_calculate(expressions: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([outcome(e) for e in expressions], columns=["result", "error"])
