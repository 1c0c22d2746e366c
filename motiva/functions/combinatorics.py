"""Exact whole numbers of any size."""

from __future__ import annotations

import math


def choose(n: int, k: int) -> int:
    return math.comb(n, k) if 0 <= k <= n else 0


def factorial(n: int) -> int:
    return math.factorial(n)
