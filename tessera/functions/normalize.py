"""Normalized views of names and addresses, as columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.wordlists import ADDRESS_ABBREVIATIONS, ADDRESS_STOPWORDS, LEGAL_SUFFIXES, MISSING, NAME_STOPWORDS

#: Word boundaries of Unicode text, which Java's \b gets wrong.
_LEFT, _RIGHT = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_SUFFIX = r"\b(" + "|".join(sorted(LEGAL_SUFFIXES, key=lambda s: (-len(s), s))) + r")\b"


def present(c: Column, missing_tokens: bool = False) -> Column:
    """Null as ''; with missing_tokens also the cells that stand for a missing value."""
    c = F.coalesce(c, F.lit(""))
    return F.when(c.isin(*MISSING), "").otherwise(c) if missing_tokens else c


def _collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: t != "")


def name_basic(name: Column) -> Column:
    return _collapsed(F.regexp_replace(F.regexp_replace(F.lower(name), "&", " and "), r"[^a-z0-9\s]", " "))


def alnum(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def without_suffixes(basic: Column) -> Column:
    bare = _collapsed(F.regexp_replace(basic, _SUFFIX, ""))
    return F.when(bare == "", basic).otherwise(bare)


def sorted_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(tokens(c)), " ")


def initials(c: Column) -> Column:
    return F.array_join(F.transform(tokens(c), lambda t: F.substring(t, 1, 1)), "")


def address_basic(address: Column) -> Column:
    return _collapsed(F.regexp_replace(F.lower(address), r"[^a-z0-9\s]", " "))


def digit_runs(c: Column, joint: str = "") -> Column:
    return F.array_join(F.regexp_extract_all(c, F.lit(r"\p{Nd}+"), F.lit(0)), joint)


def postal_code(address: Column, sizes: str = "5,6") -> Column:
    return F.regexp_extract(address, _LEFT + rf"\p{{Nd}}{{{sizes}}}" + _RIGHT, 0)


def house_number(address: Column) -> Column:
    return F.regexp_extract(F.lower(address), _LEFT + r"\p{Nd}+[a-z]?" + _RIGHT, 0)


def country(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"^\s+|\s+$", "")


def normalized(records: DataFrame, missing_tokens: bool = False) -> DataFrame:
    """The 16 views of records(entity_id, business_name, business_address, country); other columns follow."""
    known = set(records.columns)
    col = lambda c: present(F.col(c), missing_tokens) if c in known else F.lit("")
    own = {"entity_id", "business_name", "business_address", "country"}
    df = records.select("entity_id", col("business_name").alias("original_name"), col("business_address").alias("original_address"), country(col("country")).alias("country"), *[c for c in records.columns if c not in own])
    name, address = F.col("original_name"), F.col("original_address")
    df = df.withColumn("name_basic", name_basic(name)).withColumn("addr_basic", address_basic(address))
    df = df.withColumn("name_no_suf", without_suffixes(F.col("name_basic")))
    return df.withColumns(
        {
            "name_alnum": alnum(name),
            "name_sorted": sorted_tokens(F.col("name_basic")),
            "name_no_suf_sorted": sorted_tokens(F.col("name_no_suf")),
            "name_abbr": initials(F.col("name_no_suf")),
            "addr_alnum": alnum(address),
            "addr_sorted": sorted_tokens(F.col("addr_basic")),
            "addr_digits": digit_runs(address),
            "postal_code": postal_code(address),
            "house_num": house_number(address),
        }
    )


@F.pandas_udf(T.StringType())
def unicode_clean(c: pd.Series) -> pd.Series:
    """NFKD, ASCII, lower case, & as and; Spark has no Unicode normalization of its own."""
    return c.map(lambda s: unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().lower().replace("&", " and ").strip() if isinstance(s, str) else "")


def abbreviated(address: Column) -> Column:
    for word, short in ADDRESS_ABBREVIATIONS:
        address = F.regexp_replace(address, rf"\b{word}\b", short)
    return address


def extended_views(records: DataFrame) -> DataFrame:
    """The alternative views, on Unicode-cleaned text, with abbreviated addresses and six-digit postal codes first."""
    df = records.withColumn("n", unicode_clean("business_name")).withColumn("a", unicode_clean("business_address"))
    basic = _collapsed(F.regexp_replace(F.col("n"), r"[^a-z0-9\s]", " "))
    address = _collapsed(abbreviated(_collapsed(F.regexp_replace(F.col("a"), r"[^a-z0-9\s]", " "))))
    six = lambda size: F.nullif(postal_code(F.col("business_address"), size), F.lit(""))
    df = df.withColumn("name_basic", basic).withColumn("name_no_suf", without_suffixes(F.col("name_basic"))).withColumn("addr_basic", address)
    return df.select(
        "entity_id", "name_basic", "name_no_suf", alnum(F.col("n")).alias("name_alnum"), sorted_tokens(F.col("name_basic")).alias("name_sorted"), sorted_tokens(F.col("name_no_suf")).alias("name_no_suf_sorted"), initials(F.col("name_no_suf")).alias("name_abbr"),
        "addr_basic", F.coalesce(six("6"), six("5"), F.lit("")).alias("postal_code"), digit_runs(present(F.col("business_address"))).alias("addr_digits"), house_number(present(F.col("business_address"))).alias("house_num"),
    )


def address_codes(addr_basic: Column) -> Column:
    return F.filter(tokens(addr_basic), lambda t: F.length(t).between(2, 10) & t.rlike("^[a-z0-9]*[0-9][a-z0-9]*$") & ~t.isin(*ADDRESS_STOPWORDS))


def domain_stem(name: Column) -> Column:
    return F.regexp_extract(F.lower(name), _LEFT + r"([a-z0-9]+)\.(?:com|org|net|in|co|gov|edu)" + _RIGHT, 1)


def name_tokens(name_no_suf: Column) -> Column:
    return F.filter(tokens(name_no_suf), lambda t: ~t.isin(*NAME_STOPWORDS) & (F.length(t) >= 2))


def address_tokens(addr_basic: Column) -> Column:
    return F.filter(tokens(addr_basic), lambda t: (F.length(t) >= 3) & ~t.isin(*ADDRESS_STOPWORDS) & ~t.rlike("^[0-9]+$"))


def adjacent_pairs(ts: Column) -> Column:
    return F.filter(F.transform(ts, lambda t, i: F.when(i + 1 < F.size(ts), F.concat_ws("_", t, F.get(ts, i + 1)))), lambda p: p.isNotNull())


def sorted_combinations(c: Column, most: int = 10) -> Column:
    ts = F.slice(F.array_sort(F.array_distinct(F.filter(tokens(c), lambda t: F.length(t) >= 2))), 1, most)
    return F.flatten(F.transform(ts, lambda t, i: F.transform(F.filter(ts, lambda u, j: j > i), lambda u: F.concat_ws("_", t, u))))
