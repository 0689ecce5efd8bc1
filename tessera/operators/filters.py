"""Pair predicates over columns of both records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import normalize as N
from tessera.functions.similarity import address_similarities
from tessera.functions.wordlists import MODIFIERS, STREET_STOPWORDS


def country_agrees(a: Column, b: Column) -> Column:
    return (a == "") | (b == "") | (a == b)


def _words(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.lower(N.present(c)), F.lit(pattern), F.lit(0))


def modifiers_agree(name_a: Column, name_b: Column) -> Column:
    """Each discriminative modifier stands in both names or in neither."""
    own = lambda c: F.array_sort(F.array_distinct(F.filter(_words(c, "[a-z]+"), lambda t: t.isin(*MODIFIERS))))
    return own(name_a) == own(name_b)


def primary_number(address: Column) -> Column:
    address = N.present(address)
    return F.when(address == "nan", "").otherwise(N.house_number(address))


def numbers_agree(a: Column, b: Column) -> Column:
    """Either empty, equal, equal in digits, or one the other with one more character."""
    da, db = F.regexp_replace(a, "[^0-9]", ""), F.regexp_replace(b, "[^0-9]", "")
    near = (F.abs(F.length(a) - F.length(b)) == 1) & (a.startswith(b) | b.startswith(a))
    return (a == "") | (b == "") | (a == b) | ((da != "") & (da == db)) | near


def streets_agree(a: Column, b: Column) -> Column:
    own = lambda c: F.filter(_words(c, "[a-z]{4,}"), lambda t: ~t.isin(*STREET_STOPWORDS))
    return (F.size(own(a)) == 0) | (F.size(own(b)) == 0) | F.arrays_overlap(own(a), own(b))


def compatible(pairs: DataFrame) -> DataFrame:
    """Pairs (a_, b_ columns of both records) that pass the country, modifier, number and address filters."""
    c = F.col
    kept = pairs.where(country_agrees(c("a_country"), c("b_country")) & modifiers_agree(c("a_original_name"), c("b_original_name")) & numbers_agree(primary_number(c("a_original_address")), primary_number(c("b_original_address"))))
    kept = kept.withColumn("_sim", address_similarities(c("a_addr_basic"), c("b_addr_basic")))
    far = (c("a_addr_basic") != "") & (c("b_addr_basic") != "") & (c("_sim.sort") < 0.25) & (c("_sim.set") < 0.35)
    return kept.where(~far).drop("_sim")


def valid_pair(pairs: DataFrame) -> DataFrame:
    """The stricter street filter, with modifiers and numbers."""
    c = F.col
    return pairs.where(modifiers_agree(c("a_original_name"), c("b_original_name")) & numbers_agree(primary_number(c("a_original_address")), primary_number(c("b_original_address"))) & streets_agree(c("a_original_address"), c("b_original_address")))
