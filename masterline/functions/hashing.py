"""Repeatable uniforms: a random number is a function of its row's keys.

The value depends only on the keys and the salt, never on partitioning, task
retries or row order, so a lost executor recomputes the same numbers and the
same expression can be written in plain SQL.  Keys are SQL text (a column name
or an expression): a hash is some twenty operators, and one parsed expression
is built far faster than twenty Column calls.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2147483647


def u01_text(r: str | int, k: str | int, salt: int) -> str:
    """Uniform in [0, 1) from two integer keys and a salt, as SQL text.

    Keys are reduced modulo the prime first: the result is unchanged and a key
    of any BIGINT size cannot overflow the products.
    """
    r, k = (f"pmod(cast({v} as bigint), {PRIME}L)" for v in (r, k))
    x1 = f"(({r} * 48271L + {k} * 69621L + {salt}L) % {PRIME}L)"
    x2 = f"(({x1} * {x1} + {salt}L) % {PRIME}L)"
    x3 = f"(({x2} * {x2} + {k} * 7919L) % {PRIME}L)"
    return f"(cast({x3} as double) / {float(PRIME)!r}D)"


def u01(r: str | int, k: str | int, salt: int) -> Column:
    return F.expr(u01_text(r, k, salt))


def fold(r: str, k: str) -> str:
    """Fold a second key (a draw number, say) into the first one."""
    return f"(cast({r} as bigint) + cast({k} as bigint) * 1000003L)"


def array_uniforms() -> Callable[[np.ndarray, np.ndarray, int], np.ndarray]:
    """:func:`u01` on arrays, for tasks.  A function of its own, holding plain numbers,
    so that it travels with them."""
    prime = PRIME

    def uniforms(r, k, salt):
        x = (r % prime * 48271 + k % prime * 69621 + salt) % prime
        x = (x * x + salt) % prime
        return (x * x + k % prime * 7919) % prime / float(prime)

    return uniforms


def uniform(lo, hi, r: str | int, k: str | int, salt: int) -> Column:
    """Uniform between two numbers or Columns."""
    return lo + (hi - lo) * u01(r, k, salt)


def normal(mean: float, sd: float, r: str | int, k: str | int, salt: int) -> Column:
    """Box-Muller on two uniforms; the first is kept away from zero."""
    first = f"greatest({u01_text(r, k, salt)}, {1.0 / PRIME!r}D)"
    z = f"sqrt(-2.0D * ln({first})) * cos({2.0 * math.pi!r}D * {u01_text(r, k, salt + 1)})"
    return mean + sd * F.expr(z)


def bernoulli(p: Column, r: str | int, k: str | int, salt: int) -> Column:
    """1 with probability p, else 0; NULL when p is NULL."""
    return (u01(r, k, salt) < p).cast("int")
