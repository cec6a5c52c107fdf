"""Vector and matrix algebra on ``array<double>`` columns, as SQL expressions.

Every function takes column names (or other expressions) and returns the text of an expression for
``F.expr``: a plan with hundreds of entries is then built in one step. A short vector (up to
``UNROLL`` entries) becomes plain arithmetic on its entries, which stays in whole-stage codegen. A
longer one uses higher-order functions, whose expression does not grow with the width.
"""

from __future__ import annotations

from collections.abc import Callable

UNROLL = 12
INIT_UNROLL = 64  # entries of a start vector are independent, so more of them stay cheap

# Fixed values of the arithmetic start vectors: any SQL engine can evaluate the same rule.
INIT_MODULUS = 1000003
INIT_SQUARE = 31
INIT_CROSS = 7919
INIT_COLUMN = 104729
INIT_SEED = 31
INIT_WRAP = 611953


def array(entries: list[str]) -> str:
    return f"array({', '.join(entries)})"


def total(terms: list[str]) -> str:
    return f"({' + '.join(terms)})"


def combine(a: str, b: str, k: int, fn: Callable[[str, str], str]) -> str:
    """Entry by entry ``fn(a[i], b[i])``: sum, product, safe quotient and so on."""
    if k <= UNROLL:
        return array([fn(f"{a}[{i}]", f"{b}[{i}]") for i in range(k)])
    return f"zip_with({a}, {b}, (p, q) -> {fn('p', 'q')})"


def each(v: str, k: int, fn: Callable[[str], str]) -> str:
    """``fn(v[i])`` for every entry."""
    if k <= UNROLL:
        return array([fn(f"{v}[{i}]") for i in range(k)])
    return f"transform({v}, p -> {fn('p')})"


def multiply(a: str, b: str) -> str:
    return f"({a} * {b})"


def safe_divide(a: str, b: str) -> str:
    """``a / b``, and 0 where the denominator is 0."""
    return f"coalesce(try_divide({a}, {b}), 0.0D)"


def row_sum(v: str, k: int) -> str:
    if k <= UNROLL:
        return total([f"{v}[{i}]" for i in range(k)])
    return f"aggregate({v}, 0.0D, (s, p) -> s + p)"


def dot(a: str, b: str, k: int) -> str:
    if k <= UNROLL:
        return total([f"{a}[{i}] * {b}[{i}]" for i in range(k)])
    return f"aggregate(zip_with({a}, {b}, (p, q) -> p * q), 0.0D, (s, p) -> s + p)"


def scale(factor: str, v: str, k: int) -> str:
    return each(v, k, lambda x: multiply(factor, x))


def row_normalize(v: str, k: int) -> str:
    """Divide by the row sum; the last entry is 1 minus the others, so the row sums to 1."""
    if k == 1:
        return "array(1.0D)"
    s = row_sum(v, k)
    if k <= UNROLL:
        head = [f"{v}[{i}] / {s}" for i in range(k - 1)]
        return array([*head, f"1.0D - {total(head)}"])
    head = f"transform(slice({v}, 1, {k - 1}), p -> p / {s})"
    return f"concat({head}, array(1.0D - aggregate({head}, 0.0D, (s, p) -> s + p)))"


def argmax(v: str) -> str:
    """0-based position of the largest entry; the lowest position wins a tie."""
    return f"cast(array_position({v}, array_max({v})) - 1 AS int)"


def uniform_vector(id_col: str, k: int, seed: int) -> str:
    """k numbers strictly between 0 and 1 that depend only on the id, the column and the seed.

    The id is taken apart into a remainder and a quotient, so a large id cannot overflow and two ids
    below 10^12 never share their numbers; the open interval matters because a multiplicative update
    never leaves an exact 0.
    """
    x = f"(cast({id_col} AS bigint) % {INIT_MODULUS})"
    q = f"(cast({id_col} AS bigint) div {INIT_MODULUS} % {INIT_MODULUS})"

    def entry(j):
        raw = (f"({x} * {x} * {INIT_SQUARE} + {x} * {INIT_CROSS} * ({j} + 1)"
               f" + {j} * {INIT_COLUMN} + {seed * INIT_SEED} + {q} * {INIT_WRAP})")
        return f"({raw} % {INIT_MODULUS} + 1) / {INIT_MODULUS + 1}.0D"

    if k <= INIT_UNROLL:
        return array([entry(j) for j in range(k)])
    return f"transform(sequence(0, {k - 1}), j -> {entry('j')})"
