"""One consistent form for texts that look the same on screen.

Whole Arrow string columns are copied to numpy code-point arrays. A lookup
table (built once per worker by rules over the Unicode character database)
gives every code point its expansion; a gather and expansion offsets write the
expanded text, marks are put in canonical order and composed in vectorised
rounds, and the result goes back to Arrow buffers. No call is made per row.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepsieve.plans.runtime import cut_lineage, spread

#: Code points from here on expand to themselves.
TABLE_END = 0x30000
# Letters of other scripts drawn like the Latin letter beside them.
LOOKALIKES = {
    "a": "аɑ", "c": "сϲ", "d": "ԁ", "e": "е", "h": "һ", "i": "іⅰ", "j": "јϳ", "l": "ⅼӏ", "o": "оοօ", "p": "рρ",
    "q": "ԛ", "s": "ѕ", "v": "νѵⅴ", "w": "ԝ", "x": "хⅹ", "y": "уү", "A": "АΑ", "B": "ВΒ", "C": "СϹⅭ",
    "D": "Ⅾ", "E": "ЕΕ", "G": "Ԍ", "H": "НΗ", "I": "ІΙⅠӀ", "J": "ЈͿ", "K": "КΚ", "L": "Ⅼ", "M": "МΜⅯ", "N": "Ν",
    "O": "ОΟՕ", "P": "РΡ", "Q": "Ԛ", "S": "ЅՏ", "T": "ТΤ", "V": "ѴⅤ", "W": "Ԝ", "X": "ХΧⅩ", "Y": "ҮΥ", "Z": "Ζ",
}
# Signs drawn like another one.
SIGNS = {"-": "‐‑", "·": "·", ";": ";", ":": "꞉", "'": "ʹʹ"}
# Characters without any width on screen, besides those of category Cf.
INVISIBLE = frozenset("­͏ᅟᅠ឴឵᠋᠌᠍᠎᠏​⁠﻿ㅤﾠ")
#: Joiners and variation selectors are drawn only after these: emoji, and the joining scripts.
JOINER, NON_JOINER, TEXT_STYLE, EMOJI_STYLE = 0x200D, 0x200C, 0xFE0E, 0xFE0F


def _base(code: int, plain: dict[int, str]) -> str:
    """Expansion of one code point: visually equal, canonically decomposed, in Latin where drawn like it."""
    c = chr(code)
    if 0xD800 <= code < 0xE000:
        return c
    if c in plain:
        return plain[c]
    kind = unicodedata.category(c)
    if kind == "Zs":
        return " "
    if kind in ("Zl", "Zp"):
        return "\n"
    if c in INVISIBLE or (kind == "Cf" and code not in (JOINER, NON_JOINER) and not 0xE0020 <= code <= 0xE007F) or 0xFE00 <= code <= 0xFE0D:
        return ""
    if kind == "Cc" and c not in "\t\n":
        return ""
    if 0xAC00 <= code <= 0xD7A3:
        return c  # Hangul syllables stay composed
    how = unicodedata.decomposition(c)
    if not how:
        return c
    tag, _, rest = how.partition(" ") if how[0] == "<" else ("", "", how)
    if tag not in ("", "<wide>", "<narrow>") and not 0xFB00 <= code <= 0xFB06 and not 0x2160 <= code <= 0x217F:
        return c
    return "".join(_base(int(x, 16), plain) for x in rest.split())


@functools.cache
def _tables() -> dict[str, np.ndarray]:
    plain = {other: latin for latin, others in (LOOKALIKES | SIGNS).items() for other in others}
    starts, counts, pool = np.zeros(TABLE_END, np.int64), np.ones(TABLE_END, np.int64), []
    for code in range(TABLE_END):
        text = _base(code, plain)
        starts[code], counts[code] = len(pool), len(text)
        pool.extend(map(ord, text))
    classes = np.array([unicodedata.combining(chr(c)) for c in range(TABLE_END)], np.uint8)
    drawn = np.zeros(TABLE_END, bool)  # characters after which a joiner or selector shows
    for code in range(0x2190, TABLE_END):
        drawn[code] = unicodedata.category(chr(code)) in ("So", "Sk", "Sm")
    for first, last in ((0x23, 0x23), (0x2A, 0x2A), (0x30, 0x39), (0xA9, 0xAE), (0x600, 0x1CFF), (0x203C, 0x2049), (0x20E3, 0x20E3), (0x1F000, 0x1FAFF)):
        drawn[first : last + 1] = True
    joins = np.zeros(TABLE_END, bool)
    for first, last in ((0x600, 0x8FF), (0x900, 0xDFF), (0x1000, 0x109F), (0x1780, 0x18AF), (0x1F000, 0x1FAFF), (0x2190, 0x2BFF), (JOINER, JOINER), (EMOJI_STYLE, EMOJI_STYLE)):
        joins[first : last + 1] = True
    pairs = {}
    for code in range(TABLE_END):
        how = unicodedata.decomposition(chr(code)) if not 0xD800 <= code < 0xE000 else ""
        if how and how[0] != "<" and " " in how and len(unicodedata.normalize("NFC", chr(code))) == 1:
            a, b = (int(x, 16) for x in how.split())
            if unicodedata.normalize("NFC", chr(a) + chr(b)) == chr(code):
                pairs[a << 21 | b] = code
    keys = np.array(sorted(pairs), np.int64)
    return {"starts": starts, "counts": counts, "pool": np.array(pool, np.uint32), "classes": classes, "drawn": drawn, "joins": joins, "keys": keys, "composed": np.array([pairs[k] for k in keys.tolist()], np.uint32)}


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions start, start+1, … for each (start, count)."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def _compose(first: np.ndarray, second: np.ndarray, t: dict) -> np.ndarray:
    """Composition of each pair, 0 where there is none; conjoining Hangul by arithmetic."""
    a, b = first.astype(np.int64), second.astype(np.int64)
    key = a << 21 | b
    at = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
    out = np.where(t["keys"][at] == key, t["composed"][at], 0)
    lead = (a >= 0x1100) & (a < 0x1113) & (b >= 0x1161) & (b < 0x1176)
    out = np.where(lead, 0xAC00 + ((a - 0x1100) * 21 + (b - 0x1161)) * 28, out)
    tail = (a >= 0xAC00) & (a <= 0xD7A3) & ((a - 0xAC00) % 28 == 0) & (b > 0x11A7) & (b < 0x11C3)
    return np.where(tail, a + (b - 0x11A7), out).astype(np.uint32)


def _class_of(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    return np.where(codes < TABLE_END, table[np.minimum(codes, TABLE_END - 1)], 0)


def normalise_codes(codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Consistent form of concatenated texts: (code points, row of each code point), rows ascending."""
    t = _tables()
    low = np.minimum(codes, TABLE_END - 1)
    inside = codes < TABLE_END
    # carriage returns before a line feed vanish as control characters; alone they end a line
    n = len(codes)
    cr = codes == 13
    if cr.any():
        next_lf = np.zeros(n, bool)
        next_lf[:-1] = (codes[1:] == 10) & (rows[1:] == rows[:-1])
        codes = np.where(cr & ~next_lf, 10, codes).astype(np.uint32)
        low = np.minimum(codes, TABLE_END - 1)
    counts = np.where(inside, t["counts"][low], 1)
    joiner = (codes == JOINER) | (codes == NON_JOINER) | (codes == TEXT_STYLE) | (codes == EMOJI_STYLE)
    if joiner.any():
        at = np.flatnonzero(joiner)
        prev, nxt = np.maximum(at - 1, 0), np.minimum(at + 1, n - 1)
        same_prev, same_next = (rows[prev] == rows[at]) & (at > 0), (rows[nxt] == rows[at]) & (at < n - 1)
        style = codes[at] >= 0xFE00
        before, after = low[prev], low[nxt]
        keep = np.where(style, same_prev & t["drawn"][before], same_prev & same_next & t["joins"][before] & t["joins"][after])
        counts[at] = keep
    changed = inside & ~joiner & ((counts != 1) | (t["pool"][np.minimum(t["starts"][low], len(t["pool"]) - 1)] != codes))
    if changed.any():
        source = np.where(changed, t["starts"][low], 0)
        out = np.repeat(codes, counts)
        owner = np.repeat(np.arange(n), counts)
        touched = changed[owner]
        spots = _ragged(source, counts)
        out[touched] = t["pool"][spots[touched]]
        rows = rows[owner]
        codes = out
    elif (counts != 1).any():
        keep = counts > 0
        codes, rows = codes[keep], rows[keep]
    classes = _class_of(codes, t["classes"])
    marks = np.flatnonzero(classes > 0)
    jamo = (codes >= 0x1100) & (codes < 0x1200)
    if len(marks) == 0 and not jamo.any():
        return codes, rows
    codes = codes.copy()
    # the starter of each mark: the last character of class 0 in the same row
    starter_at = np.maximum.accumulate(np.where(classes == 0, np.arange(len(codes)), -1))
    live = np.ones(len(codes), bool)
    if len(marks):
        home = starter_at[marks]
        lost = (home < 0) | (rows[np.maximum(home, 0)] != rows[marks])  # a row that begins with marks
        group = np.where(lost, -1 - rows[marks], home)
        order = np.lexsort((np.arange(len(marks)), classes[marks], group))
        inner = np.lexsort((np.arange(len(marks)), group))
        # marks of a group stand side by side, so sorting within groups only permutes them
        moved = codes[marks[order]]
        codes[marks[inner]] = moved
        classes[marks[inner]] = _class_of(moved, t["classes"])
        real = marks[~lost]
        homes = starter_at[real]
        rank = real - homes  # 1 for the first mark after its starter
        last = np.zeros(len(codes), np.int16)
        by_rank = np.argsort(rank, kind="stable")
        edges = np.flatnonzero(np.diff(rank[by_rank])) + 1
        for part in np.split(by_rank, edges):
            m, h = real[part], homes[part]
            made = _compose(codes[h], codes[m], t)
            fits = (made > 0) & (last[h] < classes[m])
            codes[h[fits]] = made[fits]
            live[m[fits]] = False
            last[h[~fits]] = classes[m[~fits]]
    if jamo.any():
        for _ in range(2):  # leading with vowel, then with tail
            spots = np.flatnonzero(live)
            a, b = spots[:-1], spots[1:]
            made = np.where((rows[a] == rows[b]) & (codes[b] >= 0x1161) & (codes[b] < 0x11C3), _compose(codes[a], codes[b], t), 0)
            hit = made > 0
            codes[a[hit]] = made[hit]
            live[b[hit]] = False
    return codes[live], rows[live]


def _trim(codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without white space at the ends of a text and before line ends: it shows nowhere."""
    blank = (codes == 32) | (codes == 9) | (codes == 10)
    if not blank.any():
        return codes, rows
    n = len(codes)
    index = np.arange(n)
    edge = np.ones(n + 1, bool)
    edge[1:-1] = rows[1:] != rows[:-1]
    text = ~blank
    last_text = np.maximum.accumulate(np.where(text, index, -1))
    next_text = np.minimum.accumulate(np.where(text, index, n)[::-1])[::-1]
    lead = (last_text < 0) | (rows[np.maximum(last_text, 0)] != rows)
    trail = (next_text >= n) | (rows[np.minimum(next_text, n - 1)] != rows)
    next_stop = np.minimum.accumulate(np.where(text | (codes == 10), index, n)[::-1])[::-1]
    before_line_end = blank & (codes != 10) & (next_stop < n) & (codes[np.minimum(next_stop, n - 1)] == 10)
    keep = ~(blank & (lead | trail | before_line_end))
    return codes[keep], rows[keep]


def normalise_arrow(column: pa.Array) -> pa.Array:
    """The consistent form of an Arrow string column; null stays null."""
    column = column.cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return column.cast(pa.string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    codes = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    begins = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[offsets - offsets[0]]
    rows = np.repeat(np.arange(n), np.diff(begins))
    codes, rows = _trim(*normalise_codes(codes, rows))
    text = codes.astype(np.uint32).tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    sizes = np.bincount(rows, weights=width, minlength=n).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    made = pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(text))
    if column.null_count:
        made = pa.compute.if_else(column.is_valid(), made, pa.scalar(None, pa.large_string()))
    return made.cast(pa.string())


def consistent_form(texts: DataFrame, columns: list[str], suffix: str = "_form") -> DataFrame:
    """Adds for each of ``columns`` its consistent form under ``name + suffix``.

    Full-width and half-width forms, ligatures, composed and combining accents,
    kinds of blanks, invisible characters and letters of other scripts drawn
    like Latin ones become one form. Letter case, accents, superscripts, circled
    digits, fractions, ß and joiners that change an emoji stay. Null stays null,
    a text of invisible characters only becomes empty. Other columns, repeated
    rows and empty tables pass through; a column already named like a result is
    replaced.
    """
    results = [c + suffix for c in columns]
    kept = [c for c in texts.columns if c not in results]
    base = spread(texts.select(*[texts[c] for c in kept]))
    schema = T.StructType([*base.schema.fields, *[T.StructField(r, T.StringType()) for r in results]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            forms = [normalise_arrow(batch.column(batch.schema.get_field_index(c))) for c in columns]
            yield pa.RecordBatch.from_arrays([*batch.columns, *forms], names=[*batch.schema.names, *results])

    return base.mapInArrow(run, schema)


def _hashed_forms(texts: DataFrame, id: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """((id, field, f1, f2, raw), (field, f1, f2)): hashes of forms and texts, and the forms with several spellings."""
    formed = consistent_form(texts.select(id, *columns), columns)
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("raw"), F.col(c + "_form").alias("form")) for c in columns])).alias("x")
    hashed = cut_lineage(  # 30 bytes a text, read several times
        formed.select(F.col(id).alias("id"), stacked)
        .where("x.raw is not null and x.form <> ''")
        .select("id", "x.field", F.xxhash64("x.form").alias("f1"), F.hash("x.form").alias("f2"), F.xxhash64("x.raw", F.length("x.raw")).alias("raw"))
    )
    return hashed, hashed.groupBy("field", "f1", "f2").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("field", "f1", "f2")


def look_alike_classes(texts: DataFrame, *, id: str, columns: list[str]) -> DataFrame:
    """(id, field, class, spellings): each text that looks like one of other characters, with the smallest id of its class.

    One row a text however many look the same, unlike the pairs; spellings is
    the number of different texts in the class. Nulls and texts without visible
    characters take no part, repeated rows count once.
    """
    hashed, mixed = _hashed_forms(texts, id, columns)
    inside = hashed.join(mixed, ["field", "f1", "f2"], "left_semi")
    classes = inside.groupBy("field", "f1", "f2").agg(F.min("id").alias("class"), F.count_distinct("raw").alias("spellings"))
    return inside.join(classes, ["field", "f1", "f2"]).select("id", "field", "class", "spellings").distinct()


def look_alike_pairs(texts: DataFrame, *, id: str, columns: list[str]) -> DataFrame:
    """Pairs (id_a < id_b, field) whose non-empty texts look the same but differ in characters.

    Works on forms of 128 bits instead of texts; only ids in classes with two or
    more spellings reach the join. A repeated id with several spellings is
    compared with every other id, not with itself; nulls and texts without
    visible characters take no part.
    """
    hashed, mixed = _hashed_forms(texts, id, columns)
    inside = hashed.join(mixed, ["field", "f1", "f2"], "left_semi")
    a, b = inside.alias("a"), inside.alias("b")
    same = (F.col("a.field") == F.col("b.field")) & (F.col("a.f1") == F.col("b.f1")) & (F.col("a.f2") == F.col("b.f2"))
    return (
        a.join(b, same & (F.col("a.id") < F.col("b.id")) & (F.col("a.raw") != F.col("b.raw")))
        .select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), F.col("a.field").alias("field"))
        .distinct()
    )
