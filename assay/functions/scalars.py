"""Scalar functions that rules and queries share, as SQL text for Spark (and for DuckDB, where a query has an oracle)."""

from __future__ import annotations


def luhn_sum(npi: str) -> str:
    """The CMS check sum of a ten-digit NPI: 24 for the prefix 80840, digit sums of doubled odd places, even places as
    they are. A valid number's sum is a multiple of ten."""
    digit = f"cast(substr({npi}, i, 1) as int)"
    # one fold over the places keeps the number's own expression from being repeated for each of them
    return f"aggregate(sequence(1, 10), 24, (a, i) -> a + (case when i % 2 = 1 then cast(substr('0246813579', {digit} + 1, 1) as int) else {digit} end)/*fold*/)"


def check_digit(base: str) -> str:
    """The tenth digit of a nine-digit base."""
    return f"cast((10 - {luhn_sum(f'({base} || chr(48))')} % 10) % 10 as string)"


def npi_check_digit(base: str) -> int:
    """The same for Python strings."""
    total = 24
    for place, c in enumerate(base, 1):
        d = int(c) * (2 if place % 2 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def folded(text: str) -> str:
    """Lower ASCII letters, without white space and ASCII punctuation; other letters stay as they are."""
    lowered = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_replace({lowered}, '[\\\\s\\\\p{{Punct}}]+', '')"


def overlaps(s1: str, e1: str, s2: str, e2: str) -> str:
    """Two half-open ranges share a day; a null end is open, an empty range shares nothing."""
    return f"({s1} < coalesce({e2}, date'9999-12-31') and {s2} < coalesce({e1}, date'9999-12-31') and ({e1} is null or {s1} < {e1}) and ({e2} is null or {s2} < {e2}))"


def covers(s: str, e: str, day: str) -> str:
    return f"({s} <= {day} and ({e} is null or {day} < {e}))"


def range_text(s: str, e: str) -> str:
    return f"('[' || cast({s} as string) || ',' || coalesce(cast({e} as string), '') || ')')"
