"""Zone transition tables: for each IANA zone the instants at which its offset changes.

The tables carry the version of the zone data they were built from. The driver
records that version in the plan and every worker compares it with its own, so
a cluster with mixed zone data stops with an error instead of mixing instants.
"""

from __future__ import annotations

import functools
import os
import zoneinfo
from datetime import datetime, timedelta, timezone

import numpy as np

#: Offsets are tabulated between these years; instants outside have no zone reading.
FIRST_YEAR, LAST_YEAR = 1900, 2100
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


@functools.cache
def zone_data_version() -> str:
    """IANA release behind ``zoneinfo`` on this machine, as far as it says."""
    for folder in zoneinfo.TZPATH:
        for name in ("+VERSION", "tzdata.zi"):
            path = os.path.join(folder, name)
            if os.path.exists(path):
                with open(path, encoding="utf-8", errors="replace") as f:
                    return f.readline().strip().removeprefix("# version ")
        if os.path.isdir(folder) and os.path.exists(os.path.join(folder, "Europe")):
            return "system"
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "none"


def _offset(zone: zoneinfo.ZoneInfo, second: int) -> int:
    at = (_EPOCH + timedelta(seconds=second)).astimezone(zone)
    return int(at.utcoffset().total_seconds())


@functools.cache
def transitions(name: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(first second of each period, offset in seconds during it); None for an unknown zone."""
    try:
        zone = zoneinfo.ZoneInfo(name)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return None
    first = int(datetime(FIRST_YEAR, 1, 1, tzinfo=timezone.utc).timestamp())
    last = int(datetime(LAST_YEAR, 1, 1, tzinfo=timezone.utc).timestamp())
    starts, offsets = [np.iinfo(np.int64).min], [_offset(zone, first)]
    step = 7 * 86400
    at = first
    while at < last:
        nxt = min(at + step, last)
        if (there := _offset(zone, nxt)) != offsets[-1]:
            lo, hi = at, nxt
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if _offset(zone, mid) == offsets[-1] else (lo, mid)
            starts.append(hi)
            offsets.append(_offset(zone, hi))
            if offsets[-1] != there:  # two changes within a week: go on from the first
                nxt = hi
        at = nxt
    return np.array(starts, np.int64), np.array(offsets, np.int64)


def offset_at(name: str, seconds: np.ndarray) -> np.ndarray:
    starts, offsets = transitions(name)
    return offsets[np.searchsorted(starts, seconds, side="right") - 1]


def local_to_utc(name: str, local: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTC seconds of wall-clock seconds, and whether the reading is unique.

    A clock time that the zone skips or runs through twice has no unique reading.
    """
    if transitions(name) is None:
        return np.zeros_like(local), np.zeros(len(local), bool)
    before, after = offset_at(name, local - 86400), offset_at(name, local + 86400)
    a, b = local - before, local - after
    a_ok, b_ok = offset_at(name, a) == before, offset_at(name, b) == after
    unique = np.where(before == after, a_ok, a_ok ^ b_ok)
    return np.where(a_ok, a, b), unique
