"""Sobol' points as column expressions.

Point i of a dimension is the exclusive or of direction numbers for the set
bits of the Gray code of i, moved by a keyed digital shift: a row finds its
point from its number alone.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 32
SCALE = float(1 << BITS)

# Initial direction numbers of dimensions 2 to 21 (Joe and Kuo 2008), for
# the primitive polynomials in order of degree and coefficients.
INITIAL = [
    [1], [1, 3], [1, 3, 1], [1, 1, 1], [1, 1, 3, 3], [1, 3, 5, 13], [1, 1, 5, 5, 17], [1, 1, 5, 5, 5],
    [1, 1, 7, 11, 19], [1, 1, 5, 1, 1], [1, 1, 1, 3, 11], [1, 3, 5, 5, 31], [1, 3, 3, 9, 7, 49], [1, 1, 1, 15, 21, 21],
    [1, 3, 1, 13, 27, 49], [1, 1, 1, 15, 7, 5], [1, 3, 1, 15, 13, 25], [1, 1, 5, 5, 19, 61], [1, 3, 7, 11, 23, 15, 103],
    [1, 3, 7, 13, 13, 15, 69],
]


def _times_x(value: int, polynomial: int) -> int:
    value <<= 1
    return value ^ polynomial if value >> (polynomial.bit_length() - 1) else value


def _power_of_x(exponent: int, polynomial: int) -> int:
    """x to ``exponent`` modulo a polynomial over two elements, both as bit masks."""
    degree, result = polynomial.bit_length() - 1, 1
    for bit in bin(exponent)[2:]:
        square = 0
        for i in range(degree - 1, -1, -1):
            square = _times_x(square, polynomial) ^ (result if result >> i & 1 else 0)
        result = _times_x(square, polynomial) if bit == "1" else square
    return result


def _prime_factors(n: int) -> set[int]:
    found, d = set(), 2
    while d * d <= n:
        while n % d == 0:
            found.add(d)
            n //= d
        d += 1
    return found | ({n} if n > 1 else set())


def is_primitive(polynomial: int) -> bool:
    """Whether x has the largest possible order modulo the polynomial."""
    order = (1 << (polynomial.bit_length() - 1)) - 1
    if order == 1:
        return polynomial == 0b11
    return _power_of_x(order, polynomial) == 1 and all(
        _power_of_x(order // q, polynomial) != 1 for q in _prime_factors(order)
    )


@lru_cache(maxsize=None)
def primitive_polynomials(count: int) -> list[int]:
    """The first ``count`` by degree, then by coefficients."""
    found, degree = [], 1
    while len(found) < count:
        found += [p for p in range((1 << degree) + 1, 2 << degree, 2) if is_primitive(p)]
        degree += 1
    return found[:count]


@lru_cache(maxsize=None)
def direction_numbers(dimension: int) -> list[int]:
    """BITS direction numbers of a dimension, from 0 on.

    Beyond the fixed initial numbers they are odd numbers chosen by a hash.
    """
    if dimension == 0:
        return [1 << (BITS - 1 - i) for i in range(BITS)]
    polynomial = primitive_polynomials(dimension)[dimension - 1]
    degree = polynomial.bit_length() - 1
    if dimension <= len(INITIAL):
        m = list(INITIAL[dimension - 1])
    else:
        m = [int(hashlib.md5(f"sobol.{dimension}.{i}".encode()).hexdigest()[:8], 16) % (1 << i) * 2 + 1 for i in range(degree)]
    for i in range(degree, BITS):
        value = m[i - degree] ^ (m[i - degree] << degree)
        for k in range(1, degree):
            if polynomial >> (degree - k) & 1:
                value ^= m[i - k] << k
        m.append(value)
    return [m[i] << (BITS - 1 - i) for i in range(BITS)]


def shift(seed: int, dimension: int) -> int:
    """The keyed digital shift of a dimension."""
    return int(hashlib.md5(f"{seed}|sobol.shift|{dimension}".encode()).hexdigest()[:8], 16)


def sobol(index: Column, dimension: int, seed: int = 42) -> Column:
    """Coordinate ``dimension`` of Sobol' point ``index`` (from 0, below 2^32) in [0, 1).

    Any 2^k points with successive numbers from a multiple of 2^k on fall into
    2^k different intervals of length 2^-k in every dimension.
    """
    gray = index.bitwiseXOR(F.shiftright(index, 1))
    start = F.struct(gray.alias("g"), F.lit(shift(seed, dimension)).cast("long").alias("x"))

    def step(s: Column, v: Column) -> Column:
        x = F.when(s["g"].bitwiseAND(F.lit(1)) == 1, s["x"].bitwiseXOR(v)).otherwise(s["x"])
        return F.struct(F.shiftright(s["g"], 1).alias("g"), x.alias("x"))

    numbers = F.array(*[F.lit(v).cast("long") for v in direction_numbers(dimension)])
    return F.aggregate(numbers, start, step, lambda s: s["x"] / F.lit(SCALE))
