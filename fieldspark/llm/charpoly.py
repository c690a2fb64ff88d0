"""Exact characteristic polynomials of integer matrices, their real roots, and null vectors.

The polynomial is computed modulo many primes, each by similarity to Hessenberg form and the
recurrence along its diagonal, and put together by Chinese remaindering.  Symmetric matrices have
real roots only, so that Descartes' rule counts exactly: the sign variations of f(x + a) are the
number of roots above a.  Multiple roots are split off first (greatest common divisors, again modulo
primes), then the largest roots are isolated by counting and bisected by sign in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, localcontext
from fractions import Fraction
from math import comb

import numpy as np


def _is_prime(n: int) -> bool:
    """Miller-Rabin with bases that are certain below 3.2e9."""
    if n % 2 == 0:
        return n == 2
    r = ((n - 1) & (1 - n)).bit_length() - 1
    for base in (2, 3, 5, 7):
        x = pow(base, (n - 1) >> r, n)
        if n > base and x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(r - 1)):
            return False
    return n > 1


def primes() -> Iterator[int]:
    """Primes below 2^31, falling: products of two residues fit a long."""
    return (n for n in range(2**31 - 1, 2**30, -2) if _is_prime(n))


def primes_beyond(bound: int) -> list[int]:
    """Primes whose product exceeds twice the bound, so that signed values up to it are determined."""
    out, product = [], 1
    for p in primes():
        if product > 2 * bound:
            return out
        out.append(p)
        product *= p
    raise OverflowError("more bits than primes below 2^31 carry")


def coefficient_bound(d: int, trace: int) -> int:
    """No coefficient of a positive semidefinite matrix' polynomial is larger (Maclaurin's inequality)."""
    mean = trace // max(d, 1) + 1
    return max(comb(d, k) * mean**k for k in range(d + 1))


def modular_polynomials(matrix: list[list[int]], ps: list[int]) -> np.ndarray:
    """Coefficients of det(x - A) modulo each prime, lowest first."""
    d, n = len(matrix), len(ps)
    p = np.array(ps, dtype=np.int64)[:, None]
    a = np.array([[[v % q for v in row] for row in matrix] for q in ps], dtype=np.int64).reshape(n, d, d)
    which = np.arange(n)
    for k in range(d - 2):  # zeros below the subdiagonal of column k
        found = a[:, k + 1:, k] != 0
        pivot = found.argmax(axis=1) + k + 1
        a[which, k + 1], a[which, pivot] = a[which, pivot], a[which, k + 1].copy()
        a[which, :, k + 1], a[which, :, pivot] = a[which, :, pivot], a[which, :, k + 1].copy()
        inverse = np.array([pow(int(v), -1, q) if v else 0 for v, q in zip(a[:, k + 1, k], ps)], dtype=np.int64)[:, None]
        m = a[:, k + 2:, k] * inverse % p
        a[:, k + 2:] = (a[:, k + 2:] - m[:, :, None] * a[:, k + 1, None, :] % p[:, :, None]) % p[:, :, None]
        a[:, :, k + 1] = (a[:, :, k + 1] + (a[:, :, k + 2:] * m[:, None, :] % p[:, :, None]).sum(axis=2)) % p
    f = np.zeros((n, d + 1, d + 1), dtype=np.int64)
    f[:, 0, 0] = 1
    for k in range(d):
        g = np.zeros((n, d + 1), dtype=np.int64)
        g[:, 1:] = f[:, k, :-1]
        g = (g - a[:, k, k, None] * f[:, k]) % p
        below = np.ones((n, 1), dtype=np.int64)
        for i in range(k - 1, -1, -1):
            below = below * a[:, i + 1, i, None] % p
            g = (g - (a[:, i, k, None] * below % p) * f[:, i]) % p
        f[:, k + 1] = g
    return f[:, d]


def remaindered(residues: list[list[int]], ps: list[int]) -> list[int]:
    """Signed numbers with the given residues: ``residues[i]`` are those modulo ``ps[i]``."""
    product, values = 1, [0] * len(residues[0])
    for row, p in zip(residues, ps):
        inverse = pow(product % p, -1, p)
        values = [v + product * ((int(r) - v) * inverse % p) for v, r in zip(values, row)]
        product *= p
    return [v - product if 2 * v > product else v for v in values]


def _gcd_modulo(f: list[int], g: list[int], p: int) -> list[int]:
    """Monic greatest common divisor modulo p, lowest coefficient first; empty for two zeros."""
    def trimmed(h):
        while h and h[-1] == 0:
            h.pop()
        return h

    a, b = trimmed([v % p for v in f]), trimmed([v % p for v in g])
    while b:
        inverse = pow(b[-1], -1, p)
        while len(a) >= len(b):
            q, shift = a[-1] * inverse % p, len(a) - len(b)
            for i, v in enumerate(b):
                a[shift + i] = (a[shift + i] - q * v) % p
            trimmed(a)
        a, b = b, a
    inverse = pow(a[-1], -1, p) if a else 0
    return [v * inverse % p for v in a]


def _divided(f: list[int], g: list[int]) -> tuple[list[int], bool]:
    """Quotient by a monic polynomial, and whether it is exact."""
    rest, out = list(f), [0] * max(len(f) - len(g) + 1, 0)
    for k in reversed(range(len(out))):
        out[k] = rest[k + len(g) - 1]
        for i, v in enumerate(g):
            rest[k + i] -= out[k] * v
    return out, not any(rest)


def _gcd(f: list[int], g: list[int]) -> list[int]:
    """Monic common divisor of a monic f and any g in whole numbers, from its images modulo primes."""
    if not any(g):
        return f
    rows, used, degree, last = [], [], len(f), None
    for p in primes():
        image = _gcd_modulo(f, g, p)
        if len(image) > degree or not any(v % p for v in g):
            continue  # an unlucky prime
        if len(image) < degree:
            rows, used, degree = [], [], len(image)
        if degree == 1:
            return [1]
        rows.append(image)
        used.append(p)
        values = remaindered(rows, used)
        if values == last and _divided(f, values)[1] and _divided(g, values)[1]:
            return values
        last = values
    raise OverflowError("more bits than primes below 2^31 carry")


def _derived(f: list[int]) -> list[int]:
    return [k * v for k, v in enumerate(f)][1:]


def squarefree_factors(f: list[int]) -> list[tuple[int, list[int]]]:
    """(multiplicity, squarefree monic factor) of a monic polynomial, by Yun's rule."""
    common = _gcd(f, _derived(f))
    b, c = _divided(f, common)[0], _divided(_derived(f), common)[0]
    out, m = [], 1
    while len(b) > 1:
        db = _derived(b)
        d = [x - y for x, y in zip(c + [0] * len(db), db + [0] * len(c))][:max(len(c), len(db))]
        a = _gcd(b, d)
        if len(a) > 1:
            out.append((m, a))
        b, c, m = _divided(b, a)[0], _divided(d, a)[0], m + 1
    return out


def roots_above(f: list[int], num: int, bits: int) -> int:
    """Number of roots above num / 2^bits: sign variations of the shifted polynomial."""
    n, num, bits = len(f) - 1, num << max(-bits, 0), max(bits, 0)
    c = [v << bits * (n - k) for k, v in enumerate(f)]  # roots times 2^bits
    for i in range(n):
        for k in range(n - 1, i - 1, -1):
            c[k] += num * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(f: list[int], num: int, bits: int) -> int:
    acc, n, num, bits = 0, len(f) - 1, num << max(-bits, 0), max(bits, 0)
    for k in range(n, -1, -1):
        acc = acc * num + (f[k] << bits * (n - k))
    return (acc > 0) - (acc < 0)


class Root:
    """One root in (lo, lo + 1] / 2^bits of a squarefree factor."""

    def __init__(self, f: list[int], multiplicity: int, lo: int, bits: int):
        self.f, self.multiplicity, self.lo, self.bits = f, multiplicity, lo, bits
        self.below = None

    def halve(self) -> None:
        """Half the interval, by the sign in its middle."""
        if self.below is None:  # the sign right below the root is that to the left of it: one root in the interval
            self.below = -1 if roots_above(self.f, self.lo + 1, self.bits) % 2 == 0 else 1
        self.lo, self.bits = 2 * self.lo, self.bits + 1
        if _sign(self.f, self.lo + 1, self.bits) == self.below:
            self.lo += 1

    @property
    def value(self) -> Fraction:
        return Fraction(2 * self.lo + 1) / Fraction(2) ** (self.bits + 1)

    def refine(self, bits: int) -> None:
        """Relative width below 2^-bits; for positive roots."""
        while self.lo.bit_length() <= bits:
            self.halve()


def largest_roots(f: list[int], count: int, relative_bits: int = 200) -> list[Root]:
    """The largest positive roots, falling, at least ``count`` of them by multiplicity and one more if there is one.

    Their intervals are disjoint, and narrower than 2^-relative_bits of the root and of the gaps between them.
    """
    while len(f) > 1 and f[0] == 0:
        f = f[1:]
    factors = squarefree_factors(f) if len(f) > 1 else []
    top = abs(f[-2]).bit_length() + 1 if len(f) > 1 else 0  # the sum of the roots
    open_ = [(0, -top, m, g, 0, len(g) - 1) for m, g in factors]  # (lo, bits, ..., roots above, roots in (lo, lo + 1] / 2^bits)
    found: list[Root] = []
    while open_:
        open_.sort(key=lambda o: Fraction(o[0] + 1) / Fraction(2) ** o[1])
        lo, bits, m, g, over, k = open_.pop()
        if sum(r.multiplicity for r in found if r.value > Fraction(lo + 1) / Fraction(2) ** bits) > count:
            break
        if k == 1:
            found.append(Root(g, m, lo, bits))
            found[-1].refine(20)
            continue
        lo, bits = 2 * lo, bits + 1
        upper = roots_above(g, lo + 1, bits) - over
        open_ += [(lo + 1, bits, m, g, over, upper)] * (upper > 0) + [(lo, bits, m, g, over + upper, k - upper)] * (k > upper)
    found.sort(key=lambda r: r.value, reverse=True)
    for r in found:
        r.refine(relative_bits)
    while True:
        close = [(a, b) for a, b in zip(found, found[1:]) if (a.value - b.value) < Fraction(2) ** (relative_bits // 2 - min(a.bits, b.bits))]
        if not close:
            break
        for pair in close:
            for r in pair:
                r.refine(r.lo.bit_length() + 32)
    found.sort(key=lambda r: r.value, reverse=True)
    return found


def null_vectors(matrix: list[list[int]], root: Fraction, count: int, digits: int) -> list[list[float]]:
    """An orthonormal basis of the null space of A - root by inverse iteration, with ``digits`` decimal digits until it rests."""
    d = len(matrix)
    with localcontext() as context:
        context.prec = digits
        shift = Decimal(root.numerator) / Decimal(root.denominator)
        a = [[Decimal(v) - (shift if i == j else 0) for j, v in enumerate(row)] for i, row in enumerate(matrix)]
        tiny = max(abs(v) for row in a for v in row).scaleb(-digits) or Decimal(1)
        swaps = []
        for k in range(d):
            pivot = max(range(k, d), key=lambda i: abs(a[i][k]))
            swaps.append(pivot)
            a[k], a[pivot] = a[pivot], a[k]
            a[k][k] = a[k][k] or tiny
            for i in range(k + 1, d):
                m = a[i][k] / a[k][k]
                a[i][k] = m
                if m:
                    a[i][k + 1:] = [x - m * y for x, y in zip(a[i][k + 1:], a[k][k + 1:])]

        def solved(b):
            b = list(b)
            for k in range(d):
                b[k], b[swaps[k]] = b[swaps[k]], b[k]
            for k in range(d):  # rows were swapped whole, multipliers with them
                b[k] -= sum((x * y for x, y in zip(a[k][:k], b)), Decimal(0))
            for k in reversed(range(d)):
                b[k] = (b[k] - sum((x * y for x, y in zip(a[k][k + 1:], b[k + 1:])), Decimal(0))) / a[k][k]
            return b

        def orthonormal(vectors):
            out = []
            for v in vectors:
                for _ in range(2):
                    for u in out:
                        t = sum((x * y for x, y in zip(u, v)), Decimal(0))
                        v = [x - t * y for x, y in zip(v, u)]
                norm = sum((x * x for x in v), Decimal(0)).sqrt()
                v = [x / norm for x in v]
                first = max(v, key=abs)
                out.append([-x for x in v] if first < 0 else v)
            return out

        seed, basis = 1, []
        for _ in range(count):
            row = []
            for _ in range(d):
                seed = seed * 48271 % (2**31 - 1)
                row.append(Decimal(seed) / 2**31 - Decimal("0.5"))
            basis.append(row)
        basis, rest = orthonormal(basis), Decimal(1).scaleb(-30)
        while True:
            new = orthonormal([solved(v) for v in basis])
            # at rest when the new basis spans what the old one spanned
            lost = max(sum((x * x for x in left), Decimal(0)) for left in (_left(v, basis) for v in new))
            basis = new
            if lost < rest * rest:
                return [[float(x) for x in v] for v in basis]


def _left(v, basis):
    for u in basis:
        t = sum((x * y for x, y in zip(u, v)), Decimal(0))
        v = [x - t * y for x, y in zip(v, u)]
    return v
