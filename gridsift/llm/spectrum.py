"""Leading eigenvalues and eigenvectors of an integer matrix, by its exact characteristic polynomial.

The matrix is symmetric with no negative eigenvalue and has some hundreds of rows at
most; nothing here depends on how many rows of data it was summed from.

1. The polynomial is taken modulo many 31-bit primes at once: similarity steps bring the
   matrix to Hessenberg form, whose polynomial is a short recurrence.  Chinese remaindering
   gives the integer coefficients, whose size the trace bounds.
2. All roots are real, so the sign changes in the coefficients of p(x + a) count the roots
   above a exactly, with multiplicity.  Halving intervals isolates the greatest roots to
   ``BITS`` binary digits; what stays together that far is one root of that multiplicity.
3. For each root the null space of matrix - root is found by elimination with complete
   pivoting in ``DIGITS`` decimal digits, improved by a step of inverse iteration with the
   same factors, and made orthonormal.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal, localcontext
from fractions import Fraction
from math import gcd

import numpy as np

BITS = 110
DIGITS = 70


def primes_below(top: int) -> Iterator[int]:
    """Primes below ``top`` (at most 2**31), the greatest first."""
    small = [q for q in range(2, int(top**0.5) + 1) if all(q % r for r in range(2, int(q**0.5) + 1))]
    divisors = np.array(small)
    for n in range(top - 1, 1, -1):
        if (n % divisors[divisors < n] != 0).all():
            yield n


def _powers(values: np.ndarray, exponents: np.ndarray, primes: np.ndarray) -> np.ndarray:
    out, base, left = np.ones_like(values), values % primes, exponents.copy()
    while left.any():
        out = np.where(left & 1, out * base % primes, out)
        base = base * base % primes
        left >>= 1
    return out


def hessenberg(matrix: np.ndarray, primes: np.ndarray) -> np.ndarray:
    """Hessenberg forms similar to the residues ``matrix[k]`` modulo ``primes[k]``."""
    a, size = matrix.copy(), matrix.shape[1]
    each, p2, p3 = np.arange(len(primes)), primes[:, None], primes[:, None, None]
    for k in range(size - 2):
        place = np.argmax(a[:, k + 1 :, k] != 0, axis=1) + k + 1
        rows = a[each, place].copy()
        a[each, place] = a[:, k + 1]
        a[:, k + 1] = rows
        columns = a[each, :, place].copy()
        a[each, :, place] = a[:, :, k + 1]
        a[:, :, k + 1] = columns
        # A column without a pivot has nothing to clear: its factors are 0.
        inverse = _powers(a[:, k + 1, k], primes - 2, primes)
        factor = a[:, k + 2 :, k] * inverse[:, None] % p2
        a[:, k + 2 :] = (a[:, k + 2 :] - factor[:, :, None] * a[:, k + 1, None, :] % p3) % p3
        a[:, :, k + 1] = (a[:, :, k + 1] + (a[:, :, k + 2 :] * factor[:, None, :] % p3).sum(axis=2)) % p2
    return a


def residue_polynomials(matrix: np.ndarray, primes: np.ndarray) -> np.ndarray:
    """Coefficients of det(x - matrix[k]) modulo ``primes[k]``, the constant first."""
    h, size, p2 = hessenberg(matrix, primes), matrix.shape[1], primes[:, None]
    polynomials = [np.zeros((len(primes), size + 1), np.int64)]
    polynomials[0][:, 0] = 1
    for k in range(size):
        last = polynomials[-1]
        new = np.roll(last, 1, axis=1)
        new = (new - h[:, k, k, None] * last % p2) % p2
        below = np.ones(len(primes), np.int64)
        for i in range(k - 1, -1, -1):
            below = below * h[:, i + 1, i] % primes
            new = (new - (h[:, i, k] * below % primes)[:, None] * polynomials[i] % p2) % p2
        polynomials.append(new)
    return polynomials[-1]


def characteristic_polynomial(matrix: Sequence[Sequence[int]]) -> list[int]:
    """Coefficients of det(x - matrix), the constant first, of a matrix as described above."""
    size = len(matrix)
    trace = sum(matrix[i][i] for i in range(size))
    # The k-th coefficient is at most (size over k) * (trace / size) ** k.
    bound = 2 * (trace // size + 2) ** size
    primes, product = [], 1
    for p in primes_below(1 << 31):
        primes.append(p)
        product *= p
        if product > bound:
            break
    residues = np.array([[[x % p for x in row] for row in matrix] for p in primes], np.int64)
    found = residue_polynomials(residues, np.array(primes, np.int64))
    units = [(product // p) * pow(product // p, -1, p) for p in primes]
    out = []
    for column in found.T.tolist():
        value = sum(r * u for r, u in zip(column, units, strict=True)) % product
        out.append(value - product if 2 * value > product else value)
    return out


def _at(polynomial: list[int], m: int, b: int) -> int:
    """2 ** (b * degree) * p(m / 2**b)."""
    total, last = 0, len(polynomial) - 1
    for k in range(last, -1, -1):
        total = total * m + (polynomial[k] << (b * (last - k)))
    return total


def roots_above(polynomial: list[int], m: int, b: int) -> int:
    """How many roots, counted with multiplicity, exceed m / 2**b; all roots must be real."""
    last = len(polynomial) - 1
    shifted = [c << (b * (last - k)) for k, c in enumerate(polynomial)]
    for i in range(last):
        for k in range(last - 1, i - 1, -1):
            shifted[k] += m * shifted[k + 1]
    signs = [c > 0 for c in shifted if c]
    return sum(x != y for x, y in zip(signs[:-1], signs[1:], strict=True))


def greatest_roots(polynomial: list[int], most: int, bits: int = BITS) -> list[tuple[Fraction, int]]:
    """The greatest positive roots by falling size, with multiplicities, until ``most`` are found.

    The polynomial has real roots of which none is negative.  Each root is right to
    ``bits`` binary digits.
    """
    zeros = next(k for k, c in enumerate(polynomial) if c)
    polynomial = polynomial[zeros:]
    degree = len(polynomial) - 1
    if not degree:
        return []
    top = 1 << max(-polynomial[-2], 1).bit_length()
    found, open_ = [], [(0, top, 0, degree, 0)]
    while open_ and sum(m for _, m in found) < most:
        low, high, b, above_low, above_high = open_.pop()
        while True:
            n = above_low - above_high
            if low and (high - low) << bits <= low:
                found.append((Fraction(low + high, 1 << (b + 1)), n))
                break
            if high - low == 1:
                low, high, b = 2 * low, 2 * high, b + 1
            middle = (low + high) // 2
            if n == 1:
                # One root left: the sign at a point tells its side.
                above = above_high + int((_at(polynomial, middle, b) > 0) != (above_high % 2 == 0) and _at(polynomial, middle, b) != 0)
            else:
                above = roots_above(polynomial, middle, b)
            if above_low > above > above_high:
                open_.append((low, middle, b, above_low, above))
                low, above_low = middle, above
            elif above == above_high:
                high = middle
            else:
                low = middle
    return found


def null_vectors(matrix: Sequence[Sequence[int]], root: Fraction, n: int, digits: int = DIGITS) -> np.ndarray:
    """``n`` orthonormal vectors (rows) that ``matrix`` stretches by ``root``, its multiplicity being at least n."""
    size = len(matrix)
    with localcontext() as context:
        context.prec = digits
        value = Decimal(root.numerator) / Decimal(root.denominator)
        a = np.array([[Decimal(x) - (value if i == j else 0) for j, x in enumerate(row)] for i, row in enumerate(matrix)], object)
        least = max(abs(x) for x in a.flat) * Decimal(10) ** (20 - digits) or Decimal(1)
        rows, columns = np.arange(size), np.arange(size)
        for k in range(size):
            rest = np.abs(a[k:, k:])
            i, j = divmod(int(rest.argmax()), size - k)
            a[[k, k + i]], rows[[k, k + i]] = a[[k + i, k]], rows[[k + i, k]]
            a[:, [k, k + j]], columns[[k, k + j]] = a[:, [k + j, k]], columns[[k + j, k]]
            if abs(a[k, k]) < least:
                a[k, k] = least
            a[k + 1 :, k] /= a[k, k]
            a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])

        def upward(y: np.ndarray) -> np.ndarray:
            for k in range(size - 1, -1, -1):
                y[k] /= a[k, k]
                y[:k] -= a[:k, k] * y[k]
            return y

        basis: list[np.ndarray] = []
        for j in range(n):
            # The null space: unit values where pivots vanish, the others solved for.
            y = np.array([Decimal(0)] * size, object)
            y[size - 1 - j] = a[size - 1 - j, size - 1 - j]
            start = np.empty(size, object)
            start[columns] = upward(y)
            y = start[rows]
            for k in range(size):
                y[k + 1 :] -= a[k + 1 :, k] * y[k]
            vector = np.empty(size, object)
            vector[columns] = upward(y)
            for _ in range(2):
                vector = vector / sum(x * x for x in vector).sqrt()
                for other in basis:
                    vector = vector - other * sum(x * y for x, y in zip(vector, other, strict=True))
            basis.append(vector / sum(x * x for x in vector).sqrt())
        out = np.array([[float(x) for x in v] for v in basis]).reshape(n, size)
    sign = np.sign(out[np.arange(n), np.abs(out).argmax(axis=1)])
    return out * sign[:, None]


def leading(matrix: Sequence[Sequence[int]], most: int) -> tuple[list[Fraction], np.ndarray]:
    """Up to ``most`` positive eigenvalues by falling size, and their unit vectors (rows).

    The entry of greatest size of a vector is positive.
    """
    divisor = gcd(*(x for row in matrix for x in row))
    if not divisor or most <= 0:
        return [], np.zeros((0, len(matrix)))
    small = [[x // divisor for x in row] for row in matrix]
    values, vectors = [], []
    for root, n in greatest_roots(characteristic_polynomial(small), most):
        values += [root * divisor] * n
        vectors.append(null_vectors(small, root, n))
    return values[:most], np.concatenate(vectors)[:most]
