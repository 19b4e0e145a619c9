"""A small calculator for the agent's compute tool."""

from __future__ import annotations

import ast
import operator

MAX_LENGTH = 500
MAX_EXPONENT = 100.0

_BINARY = {
    ast.Add: operator.add,
    ast.Sub: operator.sub,
    ast.Mult: operator.mul,
    ast.Div: operator.truediv,
    ast.FloorDiv: operator.floordiv,
    ast.Mod: operator.mod,
    ast.Pow: operator.pow,
}


def evaluate(text: str | None) -> tuple[float | None, str | None]:
    """Return (value, None) or (None, reason); never raises."""
    source = (text or "").translate({ord(","): None, ord("$"): None}).strip()
    if not source:
        return None, "empty"
    if len(source) > MAX_LENGTH:
        return None, "too_long"
    try:
        result = _value(ast.parse(source, mode="eval").body)
        return (None, "not_real") if isinstance(result, complex) else (float(result), None)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None, "not_arithmetic"
    except ZeroDivisionError:
        return None, "division_by_zero"
    except OverflowError:
        return None, "overflow"


def _value(node: ast.AST) -> float:
    match node:
        case ast.Constant(value=number) if type(number) in (int, float):
            return float(number)
        case ast.UnaryOp(op=ast.USub(), operand=inner):
            return -_value(inner)
        case ast.UnaryOp(op=ast.UAdd(), operand=inner):
            return _value(inner)
        case ast.BinOp(left=left, op=op, right=right) if type(op) in _BINARY:
            a, b = _value(left), _value(right)
            if isinstance(op, ast.Pow) and abs(b) > MAX_EXPONENT:
                raise OverflowError
            return _BINARY[type(op)](a, b)
        case _:
            raise ValueError("unsupported expression")
