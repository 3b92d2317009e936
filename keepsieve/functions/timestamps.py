"""Mixed timestamp spellings to one UTC instant in milliseconds.

Each text is reduced to a mask of character classes (digit runs keep their
length, letter runs collapse). A mask is mapped to a slot layout once per
worker process; all rows of one mask are then read column-wise from a code
point matrix, so the cost per row is a few array gathers. Clock times without
offset go through the zone transition tables of ``zones``.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsieve.functions import zones

#: Texts up to this length share one matrix of code points; longer ones have matrices of twice, four times … the width.
WIDTH = 64

# Month names (en, de, fr, es, nl, it, pt) and their usual abbreviations.
MONTHS = {
    1: "january jan januar jänner jän janvier janv enero ene januari gennaio gen janeiro",
    2: "february feb februar février févr fév fevrier febrero februari febbraio fevereiro fev",
    3: "march mar märz mär mrz maerz mars marzo maart mrt março marco",
    4: "april apr avril avr abril abr aprile",
    5: "may mai mayo mei maggio mag maio",
    6: "june jun juni juin junio giugno giu junho",
    7: "july jul juli juillet juil julio luglio lug julho",
    8: "august aug août aout agosto ago augustus",
    9: "september sep sept septembre septiembre settembre set setembro",
    10: "october oct oktober okt octobre octubre ottobre ott outubro out",
    11: "november nov novembre noviembre novembro",
    12: "december dec dezember dez décembre déc decembre diciembre dic dicembre dezembro",
}
MONTH_OF = {name: n for n, names in MONTHS.items() for name in names.split()}
# Weekday names of the same languages.
WEEKDAYS = frozenset(
    """monday mon tuesday tue tues wednesday wed thursday thu thur thurs friday fri saturday sat sunday sun
    montag mo dienstag di mittwoch mi donnerstag do freitag fr samstag sa sonnabend sonntag so
    lundi lun mardi mar mercredi mer jeudi jeu vendredi ven samedi sam dimanche dim
    lunes martes miércoles mié miercoles mie jueves jue viernes vie sábado sáb sabado sab domingo dom
    maandag ma dinsdag woensdag wo donderdag vrijdag vr zaterdag za zondag zo""".split()
)
# Zone abbreviations with one generally understood offset, in minutes.
# IST, and others that stand for several zones, are left out on purpose.
ZONE_MINUTES = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420,
    "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600, "wet": 0, "west": 60,
    "cet": 60, "cest": 120, "mez": 60, "mesz": 120, "eet": 120, "eest": 180, "bst": 60, "msk": 180,
    "jst": 540, "kst": 540, "npt": 345, "awst": 480, "acst": 570, "acdt": 630, "aest": 600, "aedt": 660,
    "nzst": 720, "nzdt": 780,
}
JOINERS = frozenset(("t", "at", "um", "à", "às", "om", "a"))
CLOCK_WORDS = frozenset(("uhr", "uur", "h", "hrs"))

_YMD = r"(?P<Y>9{4})(?P<sep>[-/.])(?P<M>99?)(?P=sep)(?P<D>99?)"
_DAY_FIRST = r"(?:(?P<wd>a)[.,]* )?(?P<D>99?)[.]?[ -](?:(?P<de>a) )?(?P<mon>a)[.]?,?[ -](?:(?P<de2>a) )?(?P<Y>9{4}|99)"
_MONTH_FIRST = r"(?:(?P<wd>a)[.,]* )?(?P<mon>a)[.]? (?P<D>99?)(?:(?P<th>a))?,? (?P<Y>9{4})"
_NUMBERS = r"(?P<N1>99?)(?P<sep>[-/.])(?P<N2>99?)(?P=sep)(?P<Y>9{4})"
_JOIN = r"(?:,? (?:(?P<at>a) )?|(?P<at2>a))"
_CLOCK = r"(?P<h>99?):(?P<m>99)(?::(?P<s>99)(?:[.,](?P<f>9+))?)?(?: ?(?P<ap>a)(?![/_+a-]))?"
_OFFSET = r"(?P<sign>[+\-−])(?P<oh>99)(?::?(?P<om>99))?"
_NAME = r"a(?:[/_-]a)*"
_TAIL = rf"(?:,? ?(?:(?P<zone>{_NAME})|\((?P<zone2>{_NAME})\)))?(?:,? ?{_OFFSET})?(?: ?[\[(](?P<note>{_NAME})[\])])?"
_PACKED = r"(?P<Y>9{4})(?P<M>99)(?P<D>99)(?:(?P<at>a)|[ ])?(?P<h>99)(?P<m>99)(?P<s>99)(?:[.,](?P<f>9+))?"
LAYOUTS = [
    ("count", re.compile(r"(?P<neg>-?)(?P<count>9{9,10}|9{12,13}|9{15,16}|9{18,19})")),
    ("count", re.compile(r"(?P<neg>-?)(?P<count>9{9,10})[.](?P<f>9+)")),
    ("clock", re.compile(_YMD + _JOIN + _CLOCK + _TAIL)),
    ("clock", re.compile(_PACKED + _TAIL)),
    ("clock", re.compile(_DAY_FIRST + _JOIN + _CLOCK + _TAIL)),
    ("clock", re.compile(_MONTH_FIRST + _JOIN + _CLOCK + _TAIL)),
    ("clock", re.compile(_NUMBERS + _JOIN + _CLOCK + _TAIL)),
    ("clock", re.compile(rf"(?P<wd>a),? (?P<mon>a) (?P<D>99?) {_CLOCK}(?: (?P<zone>{_NAME}))?(?: {_OFFSET})? (?P<Y>9{{4}})")),
]


@functools.lru_cache(8192)
def _layout(mask: str) -> tuple[str, dict[str, tuple[int, int]]] | None:
    """Kind and column spans of the slots for a mask with letter runs at full length."""
    short, at = [], []
    for i, c in enumerate(mask):
        if c == "a" and i and mask[i - 1] == "a":
            continue
        short.append(c)
        at.append(i)
    at.append(len(mask))
    text = "".join(short)
    for kind, pattern in LAYOUTS:
        if m := pattern.fullmatch(text):
            return kind, {k: (at[m.start(k)], at[m.end(k)]) for k, v in m.groupdict().items() if v}
    return None


def _classes(codes: np.ndarray) -> np.ndarray:
    out = codes.copy()
    out[(codes >= 48) & (codes <= 57)] = ord("9")
    out[((codes >= 65) & (codes <= 90)) | ((codes >= 97) & (codes <= 122))] = ord("a")
    for c in np.unique(codes[codes > 127]):
        if chr(c).isalpha():
            out[codes == c] = ord("a")
        elif chr(c).isspace():
            out[codes == c] = ord(" ")
    return out


def _number(codes: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    value = np.zeros(len(codes), np.int64)
    for c in range(*span):
        value = value * 10 + (codes[:, c].astype(np.int64) - 48)
    return value


def _words(codes: np.ndarray, span: tuple[int, int]) -> tuple[list[str], np.ndarray]:
    block = np.ascontiguousarray(codes[:, span[0] : span[1]])
    names, which = np.unique(block.view(f"U{span[1] - span[0]}").ravel(), return_inverse=True)
    return [str(n) for n in names], which


def _look(codes: np.ndarray, span: tuple[int, int], of) -> np.ndarray:
    names, which = _words(codes, span)
    return np.array([of(n) for n in names])[which]


def _counted(codes: np.ndarray, slots: dict) -> tuple[np.ndarray, np.ndarray]:
    a, b = slots["count"]
    digits = b - a
    # nine or ten digits are seconds, then milli-, micro- and nanoseconds
    value = _number(codes, (a, min(b, a + 18)))
    if digits == 19:
        value, digits = value, 18  # the last digit of nanoseconds is below a millisecond
        value = value // 10**5
    elif digits == 18:
        value = value // 10**6
    elif digits >= 15:
        value = value // 10**3
    elif digits <= 10:
        value = value * 1000
        if "f" in slots:
            value += _millis(codes, slots["f"])
    if "neg" in slots and slots["neg"][1] > slots["neg"][0]:
        value = -value
    return value, np.ones(len(codes), bool)


def _millis(codes: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    a, b = span
    kept = min(b, a + 3)
    return _number(codes, (a, kept)) * 10 ** (3 - (kept - a))


def _clocked(codes: np.ndarray, slots: dict, tz: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(codes)
    ok = np.ones(n, bool)
    year = _number(codes, slots["Y"])
    if slots["Y"][1] - slots["Y"][0] == 2:
        year = year + np.where(year < 69, 2000, 1900)
    if "mon" in slots:
        month = _look(codes, slots["mon"], lambda w: MONTH_OF.get(w.lower(), 0))
        day = _number(codes, slots["D"])
    elif "N1" in slots:
        one, two = _number(codes, slots["N1"]), _number(codes, slots["N2"])
        dmy = (order == "dmy") | ((order != "mdy") & (one > 12))
        mdy = (order == "mdy") | ((order != "dmy") & (two > 12))
        ok &= dmy ^ mdy
        day, month = np.where(dmy, one, two), np.where(dmy, two, one)
    else:
        month, day = _number(codes, slots["M"]), _number(codes, slots["D"])
    for slot, known in (("wd", WEEKDAYS), ("at", JOINERS), ("at2", JOINERS), ("de", ("de", "of")), ("de2", ("de", "of")), ("th", ("st", "nd", "rd", "th"))):
        if slot in slots:
            ok &= _look(codes, slots[slot], lambda w, known=known: w.lower() in known)
    hour, minute = _number(codes, slots["h"]), _number(codes, slots["m"])
    second = _number(codes, slots["s"]) if "s" in slots else np.zeros(n, np.int64)
    milli = _millis(codes, slots["f"]) if "f" in slots else np.zeros(n, np.int64)
    # offset in minutes where one is written; named zones go to `zone`
    fixed, has = np.zeros(n, np.int64), np.zeros(n, bool)
    zone = tz.copy()
    roles = []
    if "ap" in slots:
        roles.append("ap")
    roles += [s for s in ("zone", "zone2") if s in slots]
    halves = np.zeros(n, np.int8)
    for slot in roles:
        names, which = _words(codes, slots[slot])
        for i, name in enumerate(names):
            rows, low = which == i, name.lower()
            if low in ("am", "pm"):
                ok &= ~(rows & (halves > 0))
                halves[rows] = 1 if low == "am" else 2
            elif low in CLOCK_WORDS:
                pass
            elif low in ZONE_MINUTES:
                fixed[rows], has[rows] = ZONE_MINUTES[low], True
            elif "/" in name and zones.transitions(name) is not None:
                zone[rows] = name
            else:
                ok[rows] = False
    if "sign" in slots:
        away = _number(codes, slots["oh"]) * 60
        if "om" in slots:
            minutes = _number(codes, slots["om"])
            ok &= minutes < 60
            away = away + minutes
        ok &= away <= 18 * 60
        ok &= ~has | (fixed == 0)  # GMT+01:00 is an offset, EST+01:00 is not
        fixed, has = np.where(codes[:, slots["sign"][0]] == ord("+"), away, -away), np.ones(n, bool)
    elif "note" in slots:
        names, which = _words(codes, slots["note"])
        for i, name in enumerate(names):
            rows = which == i
            if name.lower() in ZONE_MINUTES:
                fixed[rows], has[rows] = ZONE_MINUTES[name.lower()], True
            elif "/" in name and zones.transitions(name) is not None:
                zone[rows] = name
            else:
                ok[rows] = False
    twelve = halves > 0
    ok &= ~twelve | ((hour >= 1) & (hour <= 12))
    hour = np.where(twelve, hour % 12 + np.where(halves == 2, 12, 0), hour)
    ok &= (hour < 24) & (minute < 60) & (second < 60) & (month >= 1) & (month <= 12) & (day >= 1) & (day <= 31) & (year >= zones.FIRST_YEAR) & (year < zones.LAST_YEAR)
    months = ((year - 1970) * 12 + np.clip(month, 1, 12) - 1).astype("datetime64[M]")
    days = months.astype("datetime64[D]") + (np.clip(day, 1, 31) - 1)
    ok &= days.astype("datetime64[M]") == months
    local = days.astype(np.int64) * 86400 + hour * 3600 + minute * 60 + second
    utc = local - fixed * 60
    for name in {z for z in zone[ok & ~has] if isinstance(z, str)}:
        rows = np.flatnonzero(ok & ~has & (zone == name))
        utc[rows], ok[rows] = zones.local_to_utc(name, local[rows])
    ok &= has | np.array([isinstance(z, str) for z in zone])
    return utc * 1000 + milli, ok


def instants(texts: pd.Series, tz: pd.Series, order: pd.Series) -> pd.Series:
    """Unix milliseconds for each text, null where it names no single instant."""
    out = np.zeros(len(texts), np.int64)
    found = np.zeros(len(texts), bool)
    trimmed = texts.fillna("").str.strip()
    lengths = trimmed.str.len().to_numpy()
    widths = np.where(lengths <= WIDTH, WIDTH, 2 ** np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
    for width in np.unique(widths[lengths > 0]):
        rows = np.flatnonzero((lengths > 0) & (widths == width))
        codes = np.array(trimmed.to_numpy()[rows], dtype=f"U{width}").view(np.uint32).reshape(len(rows), width)
        masks, which = np.unique(np.ascontiguousarray(_classes(codes)).view(f"U{width}").ravel(), return_inverse=True)
        zone_of, order_of = tz.to_numpy(object)[rows], order.to_numpy(object)[rows]
        for i, mask in enumerate(masks):
            if (layout := _layout(str(mask))) is None:
                continue
            own = np.flatnonzero(which == i)
            kind, slots = layout
            value, ok = _counted(codes[own], slots) if kind == "count" else _clocked(codes[own], slots, zone_of[own], order_of[own])
            out[rows[own]], found[rows[own]] = value, ok
    return pd.Series(pd.array(out, dtype="Int64")).where(pd.Series(found))


def instant_ms(text: Column, tz: Column, date_order: Column) -> Column:
    """Column form of :func:`instants`; the zone data version of the driver is checked by each worker."""
    version = zones.zone_data_version()

    @F.pandas_udf("long")
    def read(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        if zones.zone_data_version() != version:
            raise RuntimeError(f"zone data {zones.zone_data_version()} on a worker, {version} on the driver")
        for t, z, o in batches:
            yield instants(t, z, o)

    return read(text, tz, date_order)


def normalise_timestamps(items: DataFrame, origin: DataFrame, *, text: str = "created_at", collection: str = "collection", out: str = "created_ms") -> DataFrame:
    """Adds ``out``: the UTC instant of ``text`` in unix ms, or null where it names none.

    A clock time without zone or offset is read in the zone that ``origin``
    (one row per collection, columns collection, tz, date_order) gives the
    row's collection; all-number dates are read in its date order. Null or
    empty texts, relative dates, days alone, impossible dates, and clock times
    that their zone skips or repeats give null; texts of any length are read whole.
    Repeated rows stay, extra columns pass through whatever their names
    (those of ``origin`` are not added), an empty table gives an empty one.
    """
    zone = origin.groupBy(F.col("collection").alias("__collection")).agg(F.first("tz", True).alias("__tz"), F.first("date_order", True).alias("__order"))
    joined = items.join(zone, items[collection] == zone["__collection"], "left")
    return joined.select(*[items[c] for c in items.columns if c != out], instant_ms(items[text], zone["__tz"], zone["__order"]).alias(out))
