"""Entity frames: properties, property groups, and the derived values that scoring and retrieval read.

An entity row is (id, caption, schema, datasets, referents, target, first_seen, last_seen, last_change,
properties map<string, array<string>>). `derive` adds what features compare, once per entity and before any
join, so a pair costs only the comparison.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lynceus.functions import text
from lynceus.functions.dictionaries import COUNTRIES
from lynceus.operators.schema import Model, of
from lynceus.session import remembered

_LIST = T.ArrayType(T.StringType())
SCHEMA = T.StructType(
    [
        *(T.StructField(n, T.StringType()) for n in ("id", "caption", "schema")),
        *(T.StructField(n, _LIST) for n in ("datasets", "referents")),
        T.StructField("target", T.BooleanType()),
        *(T.StructField(n, T.TimestampNTZType()) for n in ("first_seen", "last_seen", "last_change")),
        T.StructField("properties", T.MapType(T.StringType(), _LIST)),
    ]
)
_NONE = "array<string>"


def values(names: Column, properties: Column) -> Column:
    """Values of the listed properties, one list after the other; nulls dropped."""
    got = F.transform(names, lambda n: F.coalesce(F.try_element_at(properties, n), F.array().cast(_NONE)))
    return F.filter(F.flatten(got), lambda x: x.isNotNull())


def props(*names: str, properties: str | Column = "properties") -> Column:
    column = F.col(properties) if isinstance(properties, str) else properties
    return values(F.array(*map(F.lit, names)), column)


def group(model: Model, kind: str, matchable: bool = False, schema: str | Column = "schema", properties: str | Column = "properties") -> Column:
    """Values of all properties of a type over a row's schema and its ancestors."""
    s, p = (F.col(x) if isinstance(x, str) else x for x in (schema, properties))
    return values(of(model, s, lambda n: model.group(n, kind, matchable)), p)


def caption(model: Model) -> Column:
    """The stored caption; else the first value of the first caption property that has one; else empty."""
    names = of(model, F.col("schema"), model.caption)
    return F.coalesce(F.nullif(F.col("caption"), F.lit("")), F.try_element_at(values(names, F.col("properties")), F.lit(1)), F.lit(""))


def complete(df: DataFrame) -> DataFrame:
    """A frame with any of the entity columns as one with all of them, absent ones null, empty or false."""
    out = []
    for f in SCHEMA.fields:
        c = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if isinstance(f.dataType, T.ArrayType):
            c = F.coalesce(c, F.array().cast(f.dataType))
        out.append(F.coalesce(c, F.lit(False)).alias(f.name) if f.name == "target" else c.alias(f.name))
    return df.select(*out)


def countries(codes: Column) -> Column:
    """Names and codes of countries as lower-case alpha-2; what can't be read is dropped."""
    table = {"".join(filter(str.isalpha, k)): v for v, n in COUNTRIES.items() for k in (n, v)}
    known = F.from_json(F.lit(json.dumps(table)), "map<string, string>")
    clean = F.transform(codes, lambda c: F.try_element_at(known, F.regexp_replace(F.lower(text.unaccent(c)), r"\P{IsAlphabetic}", "")))
    return F.filter(clean, lambda c: c.isNotNull())


def precompute(df: DataFrame, model: Model) -> DataFrame:
    """Query entities made ready, once: combined names join the aliases, country values become codes."""
    kinds = of(model, F.col("schema"), lambda n: model.group(n, "country"))
    more = text.combine_names(F.col("properties"), F.size(group(model, "name", True)))
    out = df.withColumn("__more", more).withColumn("__kinds", kinds)
    alias = F.concat(F.coalesce(F.try_element_at("properties", F.lit("alias")), F.array().cast(_NONE)), F.col("__more"))
    rest = F.map_filter("properties", lambda k, v: k != "alias")
    with_alias = F.when(F.size("__more") > 0, F.map_concat(rest, F.create_map(F.lit("alias"), alias))).otherwise(F.col("properties"))
    coded = F.transform_values(with_alias, lambda k, v: F.when(F.array_contains(F.col("__kinds"), k), countries(v)).otherwise(v))
    return out.withColumn("properties", coded).drop("__more", "__kinds")


def derive(df: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, schema, properties, the columns in keep, and a struct d of everything that features compare."""
    parts = remembered(_parts, model)
    base = df.withColumn("__names", remembered(group, model, "name"))
    out = base.select("id", "schema", "properties", *keep, *[c.alias(f"__{k}") for k, c in parts.items()])
    out = out.withColumn("__sounds", remembered(_sounds))
    names_ = [*parts, "sounds"]
    return out.select("id", "schema", "properties", *keep, F.struct(*[F.col(f"__{k}").alias(k) for k in names_]).alias("d"))


def _sounds() -> Column:
    return text.soundex_codes(F.col("__flat"))


def _parts(model: Model) -> dict[str, Column]:
    """What features compare, by name, over a row with its names as __names."""
    n = F.col("__names")
    return {
        "names": n,
        "literal": text.clean_literal_names(n),
        "clean": text.clean_names(n),
        "light": text.clean_names_light(n),
        "parts": text.name_parts(n),
        "flat": text.name_parts_flat(n),
        "keys": text.index_name_keys(n),
        "weak": text.clean_names_light(props("weakAlias", "abbreviation")),
        "numbers": text.extract_numbers(n),
        "full_numbers": text.extract_numbers(props("full")),
        "addresses": text.clean_address_parts(props("full")),
        "countries": group(model, "country"),
        "match_countries": group(model, "country", True),
        "country": props("country"),
        "identifiers": group(model, "identifier", True),
        "org_ids_query": text.normalize_identifiers(props("registrationNumber", "taxNumber", "leiCode", "innCode", "bicCode", "ogrnCode")),
        "org_ids_hit": text.normalize_identifiers(props("registrationNumber", "taxNumber", "leiCode", "innCode", "bicCode", "orgnCode")),
        "last_names": props("lastName"),
        "genders": props("gender"),
        "births": props("birthDate"),
        "wallets": F.filter(props("publicKey"), lambda x: F.octet_length(x) > 10),
    }
