"""Positional expansions of fractions, and fractions near numbers."""

from __future__ import annotations

import math
from fractions import Fraction

DIGITS = "0123456789abcdefghi"


def expand(p: int, q: int, base: int) -> tuple[list[int], list[int]]:
    """Digits before the period and of the period of p/q, 0 <= p < q, by its preperiod and period lengths."""
    if not 0 <= p < q:
        raise ValueError("p/q must be in [0, 1)")
    return _expand(Fraction(p, q), base)


def _expand(x: Fraction, base: int) -> tuple[list[int], list[int]]:
    rest, lead = x.denominator, 0
    while (g := math.gcd(rest, base)) > 1:
        rest //= g
        lead += 1
    period = 0 if rest == 1 else order(base, rest)
    out = []
    for _ in range(lead + period):
        x *= base
        digit = x.numerator // x.denominator
        out.append(digit)
        x -= digit
    while lead and period == 0 and out and out[-1] == 0:
        out.pop()
        lead -= 1
    return out[:lead], out[lead:]


def value(base: int, lead: list[int], period: list[int]) -> Fraction:
    """The exact fraction of an expansion."""
    number = lambda ds: sum(d * base ** (len(ds) - 1 - i) for i, d in enumerate(ds))
    whole = Fraction(number(lead), base ** len(lead))
    return whole + Fraction(number(period), base ** len(lead) * (base ** len(period) - 1)) if period else whole


def printed(lead: list[int], period: list[int]) -> str:
    text = "0." + "".join(DIGITS[d] for d in lead)
    return f"{text}({''.join(DIGITS[d] for d in period)})" if period else text


def order(base: int, q: int) -> int:
    """The multiplicative order of ``base`` modulo ``q``."""
    if math.gcd(base, q) != 1:
        raise ValueError("base and modulus share a factor")
    n, power = 1, base % q
    while power != 1 % q:
        power = power * base % q
        n += 1
    return n


def best_rational(x: float, most: int) -> tuple[int, int, int]:
    """Numerator, denominator (at most ``most``) and bits of the nearest fraction."""
    f = Fraction(x).limit_denominator(most)
    return f.numerator, f.denominator, max(1, abs(f.numerator).bit_length()) + f.denominator.bit_length()


def periodicity(digits: list[int], most_period: int = 2000, most_lead: int = 30) -> tuple[int, int] | None:
    """The least (period, preperiod) that the digits keep to, within the bounds."""
    for period in range(1, min(most_period, len(digits) // 2) + 1):
        lead = len(digits) - period
        while lead > 0 and digits[lead - 1] == digits[lead - 1 + period]:
            lead -= 1
        if lead <= most_lead and lead <= len(digits) - 2 * period:
            return period, lead
    return None


def family(k: int, bases=range(2, 11)) -> str | None:
    """The label b^L-1 of the least base of which k is a repunit family member."""
    for b in bases:
        length = round(math.log(k + 1, b)) if k > 0 else 0
        if length >= 1 and b**length - 1 == k:
            return f"{b}^{length}-1"
    return None
