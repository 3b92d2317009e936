"""SimHash fingerprints, their bands, and near copies by Hamming distance."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def simhash64(tokens: Column) -> Column:
    """64-bit SimHash of an array of tokens: bit set iff more tokens have it than not; 0 without tokens.

    Bits come from the first eight bytes of the token's MD5, read big-endian.
    """
    return simhash_udf()(tokens)


def simhash_udf():
    """The function behind :func:`simhash64`, for registration."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in batches:
            sizes = np.array([0 if x is None else len(x) for x in lists])
            out = np.zeros(len(lists), np.int64)
            if sizes.any():
                flat = np.concatenate([x for x in lists if x is not None and len(x)])
                codes, names = pd.factorize(flat)
                digests = np.frombuffer(b"".join(hashlib.md5(w.encode()).digest()[:8] for w in names), np.uint8).reshape(-1, 8)
                bits = np.unpackbits(digests, axis=1).astype(np.int32) * 2 - 1
                full = np.flatnonzero(sizes)
                starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
                for lo in range(0, len(full), 2000):  # the bit matrix of a slice at a time
                    hi = min(lo + 2000, len(full))
                    first, last = starts[lo], starts[hi] if hi < len(full) else len(codes)
                    sums = np.add.reduceat(bits[codes[first:last]], starts[lo:hi] - first, axis=0)
                    out[full[lo:hi]] = np.packbits(sums > 0, axis=1).view(">i8").ravel()
            yield pd.Series(out)

    return of


def bands(fingerprint: Column, n: int = 4) -> Column:
    """The ``n`` equal slices of a fingerprint, as array of (band, key)."""
    width = 64 // n
    return F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(fingerprint, width * i).bitwiseAND(F.lit((1 << width) - 1)).alias("key")) for i in range(n)])


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def near_fingerprints(df: DataFrame, *, id: str, fingerprint: str, distance: int = 3) -> tuple[DataFrame, DataFrame]:
    """(members, links): ids by equal fingerprint, and links between different fingerprints within ``distance``.

    members (id, fingerprint). links (fp_a, fp_b, distance), fp_a < fp_b as
    signed numbers. Of distance + 3 blocks two fingerprints within ``distance``
    agree in at least three, so they meet under one choice of three blocks and
    no link is missed; a key holds about 32 bits, so chance meetings grow with
    N * N / 2**32 only. Copies meet once, as one fingerprint. Null and zero
    fingerprints (no tokens) take no part.
    """
    members = df.select(F.col(id).alias("id"), F.col(fingerprint).cast("bigint").alias("fingerprint")).where("fingerprint is not null and fingerprint <> 0").distinct()
    edges = [round(i * 64 / (distance + 3)) for i in range(distance + 4)]
    masks = [sum((1 << hi) - (1 << lo) for lo, hi in chosen) for chosen in combinations(list(pairwise(edges)), 3)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("band"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])
    each = members.select("fingerprint").distinct().select(F.col("fingerprint").alias("fp"), F.explode(keys).alias("x")).select("fp", "x.band", "x.key")
    a, b = each.alias("a"), each.alias("b")
    met = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")))
    close = met.select(F.col("a.fp").alias("fp_a"), F.col("b.fp").alias("fp_b"), hamming(F.col("a.fp"), F.col("b.fp")).alias("distance"))
    return members, close.where(F.col("distance") <= distance).distinct()
