"""Driver-side settings: lags, months, columns, paths and names. Plain values in, plain values out."""

from __future__ import annotations

import fnmatch
import hashlib
import re
from datetime import date

# Fixed values.
LAGS = (4, 8, 12)
LEGACY_LAGS = {3, 6, 9}
WINDOW_MONTHS = 36
TRUE_WORDS = {"1", "true", "t", "yes", "y", "on"}
FALSE_WORDS = {"0", "false", "f", "no", "n", "off"}


def scope_to_lag(scope: int, lags: tuple = LAGS) -> int:
    """Scope 0 looks one month ahead, scope k the k-th lag."""
    if scope == 0:
        return 1
    if 1 <= scope <= len(lags):
        return lags[scope - 1]
    raise ValueError(f"no lag for scope {scope}")


def checked_lags(lags) -> tuple:
    """The lag schedule, if it is the supported one."""
    lags = tuple(int(x) for x in lags)
    if len(set(lags)) != len(lags):
        raise ValueError("lags repeat")
    if LEGACY_LAGS & set(lags):
        raise ValueError("lags of the old schedule")
    if lags != LAGS:
        raise ValueError(f"lags must be {LAGS}")
    return lags


def month_of(term) -> date:
    """``YYYY-MM``, a date or anything with year and month, as the first of the month."""
    if isinstance(term, str):
        m = re.fullmatch(r"(\d{4})-(\d{1,2})(?:-\d{1,2})?", term.strip())
        if not m:
            raise ValueError(f"not a month: {term!r}")
        return date(int(m[1]), int(m[2]), 1)
    return date(term.year, term.month, 1)


def months_between(start, end) -> list[date]:
    """All months from start to end, both included."""
    a, b = month_of(start), month_of(end)
    return [date(y, m, 1) for y in range(a.year, b.year + 1) for m in range(1, 13) if a <= date(y, m, 1) <= b]


def mapping_for_month(month: int, special: dict[int, str], general: str) -> str:
    """The map of a month that has its own, else the general one."""
    return special.get(month, general)


def flag(value: str | None, default: bool = False) -> bool:
    word = (value or "").strip().lower()
    return True if word in TRUE_WORDS else False if word in FALSE_WORDS else default


def columns_to_drop(columns: list[str], names: list[str], patterns: list[str], protected: list[str]) -> list[str]:
    """The columns that a name or pattern drops, in their order; protected ones stay."""
    return [c for c in columns if c not in protected and (c in names or any(fnmatch.fnmatchcase(c, p) for p in patterns))]


def aligned_columns(columns: list[str], reference: list[str]) -> list[str]:
    """The reference's columns in its order; an error if one is missing."""
    missing = [c for c in reference if c not in columns]
    if missing:
        raise ValueError(f"missing features: {missing}")
    return list(reference)


def result_name(kind: str, model: str, scope: int, start: int, end: int) -> str:
    """``kind_model_fsS_start_end.csv``."""
    return f"{kind}_{model}_fs{scope}_{start}_{end}.csv"


def file_sha256(path: str, block: int = 1 << 20) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while chunk := f.read(block):
            h.update(chunk)
    return h.hexdigest()


def cluster_count(asked: int | None, reported: int | None) -> int:
    """The number asked for if positive, else the reported one."""
    for n in (asked, reported):
        if n is not None and n > 0:
            return n
    raise ValueError("no number of clusters")


def best_depth(scores: list[tuple[int | None, float]]):
    """The depth with the first strictly largest score; the middle candidate if none is above 0."""
    if all(s <= 0 for _, s in scores):
        return scores[len(scores) // 2][0]
    best = scores[0]
    for x in scores[1:]:
        if x[1] > best[1]:
            best = x
    return best[0]
