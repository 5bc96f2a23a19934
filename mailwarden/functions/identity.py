"""Name and place signals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let
from .ngrams import letters


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table at a time in the bits of one integer."""
    full = (1 << len(a)) - 1
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    v = full
    for y in b:
        u = v & places.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def lcs_lengths(a: pd.Series, b: pd.Series) -> np.ndarray:
    """lcs_length for whole columns of texts of the letters a-z: a step for each letter place, not for each row. Null counts as empty.

    The shorter of two texts lies in the bits of a 64-bit word; pairs whose shorter one has over 64 letters go by themselves.
    """
    a, b = a.fillna("").to_numpy(dtype=object), b.fillna("").to_numpy(dtype=object)
    la, lb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    swap = la > lb
    a, b, la, lb = np.where(swap, b, a), np.where(swap, a, b), np.minimum(la, lb), np.maximum(la, lb)
    codes, starts = [], []
    for texts, sizes in ((a, la), (b, lb)):
        codes.append(np.frombuffer("".join(texts).encode("ascii") + b"a", dtype=np.uint8) - 97)
        starts.append(np.cumsum(sizes) - sizes)
    masks = np.zeros((len(a), 26), dtype=np.uint64)
    for i in range(min(int(la.max(initial=0)), 64)):
        rows = np.flatnonzero((la > i) & (la <= 64))
        masks[rows, codes[0][starts[0][rows] + i]] |= np.uint64(1 << i)
    v = np.full(len(a), ~np.uint64(0))
    for j in range(int(lb[la <= 64].max(initial=0))):
        rows = np.flatnonzero((lb > j) & (la > 0) & (la <= 64))
        u = v[rows] & masks[rows, codes[1][starts[1][rows] + j]]
        v[rows] = (v[rows] + u) | (v[rows] - u)
    out = np.bitwise_count(~v).astype(np.int32)  # bits above a text's length stay set
    for i in np.flatnonzero(la > 64):
        out[i] = lcs_length(a[i], b[i])
    return out


def longest_common_subsequence(a: Column, b: Column) -> Column:
    """Its length, of texts of the letters a-z; null counts as empty."""

    @F.pandas_udf(T.IntegerType())
    def lengths(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(lcs_lengths(x, y))

    # Not to be computed again where its value is used, nor inside other functions.
    return lengths.asNondeterministic()(a, b)


def name_tokens(name: Column) -> Column:
    return F.regexp_extract_all(F.lower(name), F.lit("[a-z]{2,}"), F.lit(0))


def identity(name: Column, local: Column, lcs: Column | None = None) -> Column:
    """Similarity, token_overlap, name_in_email of a name and a local part; zeros where either is missing.

    The subsequence length is the one part that Spark has no function for; rows without a name don't need it.
    """
    there = (F.length(name) > 0) & (F.length(local) > 0)
    joined = F.when(there, F.array_join(name_tokens(name), ""))
    lcs = longest_common_subsequence(joined, letters(local)) if lcs is None else lcs

    def rest(s: Column) -> Column:
        found = F.size(F.filter(s["t"], lambda t: s["l"].contains(t)))
        return F.struct(
            (F.coalesce(s["n"], F.lit(0)) / F.greatest(F.length(F.array_join(s["t"], "")), F.length(s["l"]), F.lit(1))).alias("similarity"),
            F.when(F.size(s["t"]) > 0, found / F.size(s["t"])).otherwise(0.0).alias("token_overlap"), (found > 0).alias("name_in_email"))

    zeros = F.struct(F.lit(0.0).alias("similarity"), F.lit(0.0).alias("token_overlap"), F.lit(False).alias("name_in_email"))
    return F.when(F.coalesce(there, F.lit(False)), let(F.struct(name_tokens(name).alias("t"), letters(local).alias("l"), lcs.alias("n")), rest)).otherwise(zeros)


def geo(ip_country: Column, accept_language: Column, client_tz: Column, edge_tz: Column) -> Column:
    """language_country, language_mismatch, timezone_mismatch, anomaly_score. A mismatch needs both sides."""
    first = F.trim(F.substring_index(accept_language, ",", 1))
    country = F.when(first.contains("-"), F.upper(F.substring_index(first, "-", -1)))
    own = F.nullif(F.upper(F.trim(ip_country)), F.lit(""))
    language = F.coalesce(own != F.nullif(country, F.lit("")), F.lit(False))
    zone = F.coalesce(F.nullif(edge_tz, F.lit("")) != F.nullif(client_tz, F.lit("")), F.lit(False))
    return F.struct(country.alias("language_country"), language.alias("language_mismatch"), zone.alias("timezone_mismatch"),
                    (F.when(language, 0.6).otherwise(0.0) + F.when(zone, 0.4).otherwise(0.0)).alias("anomaly_score"))
