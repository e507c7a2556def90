"""Scoring features: each a column over a pair row with query side q_ and hit side c_.

A pair row has q_schema, q_properties, q_d, c_schema, c_properties and c_d (see `entities.derive`). Features
that Spark's functions can express are plain columns; the string kernels that they can't are computed by one
Arrow UDF for all of them, which `with_kernels` adds as the struct k.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.functions import kernels, validators
from lynceus.operators import schema as S
from lynceus.operators.entities import values

#: name -> function of the schema model to a column of the raw score
FEATURES: dict[str, Callable[[S.Model], Column]] = {}
#: features that read the kernel struct
KERNELS = ("jaro_name_parts", "person_name_jaro_winkler", "person_name_phonetic_match", "name_fingerprint_levenshtein", "longest_common_subsequence", "address_entity_match")


def feature(name: str):
    """Register a feature under a name; algorithms and weights refer to it."""

    def add(f: Callable[[S.Model], Column]) -> Callable[[S.Model], Column]:
        FEATURES[name] = f
        return f

    return add


def column(name: str, model: S.Model) -> Column:
    """A feature's raw score."""
    return FEATURES[name](model)


def q(name: str) -> Column:
    return F.col(f"q_d.{name}")


def c(name: str) -> Column:
    return F.col(f"c_d.{name}")


def score(condition: Column) -> Column:
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def disjoint(a: Column, b: Column) -> Column:
    """Both sides have values and none in common."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~overlap(a, b)


def value_pairs(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f of every value of one list with every value of the other."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: f(x, y))))


def simple_match(name: str, part: str) -> None:
    FEATURES[name] = lambda model: score(overlap(q(part), c(part)))


def simple_mismatch(name: str, part: str) -> None:
    FEATURES[name] = lambda model: score(disjoint(q(part), c(part)))


simple_match("identifier_match", "identifiers")
simple_match("country_match", "match_countries")
simple_match("name_literal_match", "literal")
simple_mismatch("country_mismatch", "match_countries")
simple_mismatch("country_mismatch_all", "countries")
simple_mismatch("country_disjoint", "country")
simple_mismatch("last_name_mismatch", "last_names")
simple_mismatch("gender_mismatch", "genders")
simple_mismatch("gender_disjoint", "genders")
simple_mismatch("identifier_mismatch", "identifiers")


@feature("weak_alias_match")
def weak_alias(model: S.Model) -> Column:
    return score(overlap(q("light"), c("weak")))


@feature("crypto_wallet_match")
def wallet(model: S.Model) -> Column:
    both = S.is_a(model, F.col("q_schema"), "CryptoWallet") & S.is_a(model, F.col("c_schema"), "CryptoWallet")
    return score(both & overlap(q("wallets"), c("wallets")))


@feature("soundex_name_parts")
def soundex(model: S.Model) -> Column:
    """Share of the query's name parts whose Soundex code some part of the hit has."""
    hits = F.size(F.filter(q("sounds"), lambda s: F.array_contains(c("sounds"), s)))
    return hits / F.greatest(F.size(q("sounds")), F.lit(1)).cast("double")


def _ascii(dates: Column) -> Column:
    return F.filter(dates, lambda d: ~d.rlike(r"[^\x00-\x7F]"))


def _years(dates: Column) -> Column:
    return F.transform(_ascii(dates), lambda d: F.substring(d, 1, 4))


@feature("dob_year_disjoint")
def dob_year(model: S.Model) -> Column:
    return score(disjoint(_years(q("births")), _years(c("births"))))


def _month_days(dates: Column) -> Column:
    long = F.filter(_ascii(dates), lambda d: F.length(d) >= 10)
    return F.transform(long, lambda d: F.concat(F.substring(d, 6, 2), d.substr(F.lit(9), F.length(d))))


@feature("dob_day_disjoint")
def dob_day(model: S.Model) -> Column:
    """1 if years or all days differ, a half if a query day equals a hit's with month and day swapped."""
    a, b = _month_days(q("births")), _month_days(c("births"))
    flipped = F.transform(F.filter(a, lambda d: F.length(d) == 4), lambda d: F.concat(F.substring(d, 3, 2), F.substring(d, 1, 2)))
    some = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(~some, 0.0).when(disjoint(_years(q("births")), _years(c("births"))), 1.0).when(overlap(a, b), 0.0).when(overlap(flipped, b), 0.5).otherwise(F.lit(1.0))


def _date(x: Column) -> Column:
    return F.try_to_timestamp(x, F.lit("yyyy-MM-dd")).cast("date")


def _pair_score(a: Column, b: Column) -> Column:
    """Agreement of two dates at their coarser precision; 0 if either can't be read."""
    la, lb = F.length(a), F.length(b)
    year = F.abs(F.substring(a, 1, 4).try_cast("int") - F.substring(b, 1, 4).try_cast("int"))
    month = lambda x: _date(F.concat(F.substring(x, 1, 4), F.lit("-"), F.substring(x, 6, 2), F.lit("-15")))
    day = lambda x: _date(F.concat(F.substring(x, 1, 4), F.lit("-"), F.substring(x, 6, 2), F.lit("-"), F.substring(x, 9, 2)))
    months = F.abs((F.year(month(a)) - F.year(month(b))) * 12 + F.month(month(a)) - F.month(month(b)))
    days = F.abs(F.datediff(day(a), day(b)))
    by_year = F.when(year == 0, 1.0).when(year == 1, 0.5).when(year > 1, -1.0)
    by_month = F.when(months >= 3, -1.0).otherwise(1 - months / F.lit(3.0))
    by_day = F.when(days <= 1, 1.0).when(days >= 60, -1.0).otherwise((60 - days) / F.lit(59.0))
    least, plain = F.least(la, lb), ~(a.rlike(r"[^\x00-\x7F]") | b.rlike(r"[^\x00-\x7F]"))
    out = F.when(least == 4, by_year).when(least == 7, by_month).when(least == 10, by_day)
    return F.coalesce(F.when(plain, out), F.lit(0.0))


@feature("dob_progressive_match")
def dob_progressive(model: S.Model) -> Column:
    """Best agreement over all pairs; the query's month and day swapped count half where that helps."""

    def swapped(a: Column, b: Column) -> Column:
        s = F.concat(F.substring(a, 1, 4), F.lit("-"), F.substring(a, 9, 2), F.lit("-"), F.substring(a, 6, 2))
        able = (F.length(a) == 10) & (F.substring(a, 6, 2) != F.substring(a, 9, 2)) & _date(s).isNotNull()
        got = _pair_score(s, b)
        return F.when(able & (got > 0), got * 0.5)

    both = F.flatten(F.transform(q("births"), lambda a: F.flatten(F.transform(c("births"), lambda b: F.array(_pair_score(a, b), swapped(a, b))))))
    return F.coalesce(F.array_max(both), F.lit(0.0))


@feature("orgid_disjoint")
def orgid(model: S.Model) -> Column:
    """Organisations without a common identifier: 1 less the likeness, if over 0.7, of the closest two.

    The hit's OGRN codes are not read: the rule this follows looks for them under a misspelled name.
    """
    a, b = q("org_ids_query"), c("org_ids_hit")
    both = S.is_a(model, F.col("q_schema"), "Organization") & S.is_a(model, F.col("c_schema"), "Organization")
    ratio = lambda x, y: 1 - F.levenshtein(x, y) / F.greatest(F.octet_length(x), F.octet_length(y))
    best = F.array_max(value_pairs(a, b, lambda x, y: F.when(ratio(x, y) > 0.7, ratio(x, y)).otherwise(0.0)))
    return F.when(both & disjoint(a, b), 1 - F.coalesce(best, F.lit(0.0))).otherwise(F.lit(0.0))


@feature("numbers_mismatch")
def numbers(model: S.Model) -> Column:
    """Numbers in the query's names (addresses: full) that the hit lacks, over the smaller count; may pass 1."""
    address = S.is_a(model, F.col("q_schema"), "Address")
    a, b = (F.when(address, f("full_numbers")).otherwise(f("numbers")) for f in (q, c))
    return F.size(F.array_except(a, b)) / F.greatest(F.least(F.size(a), F.size(b)), F.lit(1)).cast("double")


def identifier(name: str, properties: tuple[str, ...], valid: Callable[[Column], Column]) -> None:
    """Equal valid values of a property and of any one of its type in the same schema, both ways round.

    A side with one invalid value of the property is not looked up from.
    """

    def one_way(model: S.Model, p: str, a: str, b: str) -> Column:
        def same_type(schema: str) -> list[str]:
            own = model.properties(schema).get(p)
            return [] if own is None else sorted(x.name for x in model.properties(schema).values() if x.type == own.type)

        mine = values(F.array(F.lit(p)), F.col(f"{a}_properties"))
        targets = S.of(model, F.col(f"{a}_schema"), same_type)
        theirs = F.filter(values(targets, F.col(f"{b}_properties")), valid)
        return (F.size(mine) > 0) & F.forall(mine, valid) & overlap(mine, theirs)

    def build(model: S.Model) -> Column:
        found = F.lit(False)
        for p in properties:
            found = found | one_way(model, p, "q", "c") | one_way(model, p, "c", "q")
        return score(found)

    FEATURES[name] = build


identifier("isin_security_match", ("isin",), validators.isin)
identifier("lei_code_match", ("leiCode",), validators.lei)
identifier("ogrn_code_match", ("ogrnCode",), validators.ogrn)
identifier("vessel_imo_mmsi_match", ("imoNumber", "mmsi"), validators.imo_mmsi)
identifier("inn_code_match", ("innCode",), validators.inn)
identifier("bic_code_match", ("bicCode",), validators.bic)


def _kernel(name: str, gate: str | None = None, anyone: bool = False, neither: bool = False) -> None:
    def build(model: S.Model) -> Column:
        raw = F.col(f"k.{name}")
        if gate is None:
            return raw
        a, b = (S.is_a(model, F.col(f"{side}_schema"), gate) for side in "qc")
        ok = ~(a | b) if neither else (a | b) if anyone else (a & b)
        return F.when(ok, raw).otherwise(F.lit(0.0))

    FEATURES[name] = build


_kernel("jaro_name_parts")
_kernel("person_name_jaro_winkler", "Person", anyone=True)
_kernel("person_name_phonetic_match", "Person", anyone=True)
_kernel("name_fingerprint_levenshtein", "Person", neither=True)
_kernel("longest_common_subsequence")
_kernel("address_entity_match", "Address")

_INPUT = {"jaro_name_parts": "flat", "person_name_jaro_winkler": "parts", "person_name_phonetic_match": "clean", "name_fingerprint_levenshtein": "clean", "longest_common_subsequence": "keys", "address_entity_match": "addresses"}
_CALL = {
    "jaro_name_parts": kernels.jaro_parts,
    "person_name_jaro_winkler": kernels.person_jaro,
    "person_name_phonetic_match": kernels.person_phonetic,
    "name_fingerprint_levenshtein": kernels.fingerprints,
    "longest_common_subsequence": kernels.subsequence,
    "address_entity_match": kernels.addresses,
}


def with_kernels(pairs: DataFrame, names: list[str], model: S.Model) -> DataFrame:
    """Add the struct k with the named kernels. Rows that a feature's schema rule zeroes are not computed."""
    names = [n for n in KERNELS if n in names]
    if not names:
        return pairs

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            out, memo = {}, {}
            for i, n in enumerate(names):
                call, got = _CALL[n], []
                for a, b in zip(columns[2 * i], columns[2 * i + 1], strict=True):
                    if a is None or b is None or not len(a) or not len(b):
                        got.append(0.0)
                        continue
                    a, b = ([list(x) if hasattr(x, "tolist") else x for x in v] for v in (a, b))
                    key = (n, str(a), str(b))
                    if key not in memo:
                        memo[key] = call(a, b)
                    got.append(memo[key])
                out[n] = got
            yield pd.DataFrame(out, dtype="float64")

    # not to be copied into a filter, where Spark could not run it
    udf = F.pandas_udf(run, ", ".join(f"{n} double" for n in names)).asNondeterministic()
    pairs_ = pairs.withColumns({f"__{s}_{n}": _argument(n, s, model) for n in names for s in "qc"})
    return pairs_.withColumn("k", udf(*[F.col(f"__{s}_{n}") for n in names for s in "qc"])).drop(*[f"__{s}_{n}" for n in names for s in "qc"])


def _argument(name: str, side: str, model: S.Model) -> Column:
    value = F.col(f"{side}_d.{_INPUT[name]}")
    if name == "person_name_phonetic_match":
        from lynceus.functions.text import tokenize_names

        value = tokenize_names(value)
    a, b = (S.is_a(model, F.col(f"{s}_schema"), "Person") for s in "qc")
    x, y = (S.is_a(model, F.col(f"{s}_schema"), "Address") for s in "qc")
    if name.startswith("person"):
        return F.when(a | b, value)
    if name == "name_fingerprint_levenshtein":
        return F.when(~(a | b), value)
    return F.when(x & y, value) if name == "address_entity_match" else value
