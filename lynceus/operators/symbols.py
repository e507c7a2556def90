"""Symbols in names: ordinals, company classes, places and known names, as CATEGORY:id."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.functions import dictionaries as D
from lynceus.functions.kernels import Replacer
from lynceus.functions.text import tokenize_names, unaccent
from lynceus.operators import schema as S

# Boosts of categories; NAME and NICK have none.
BOOST = {"NUM": 1.4, "LOC": 1.1, "ORGCLS": 0.7, "SYMBOL": 0.8}


def _table(person: bool) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}

    def add(category: str, ident: object, form: str) -> None:
        out.setdefault(form.lower(), []).append(f"{category}:{ident}")

    for form, number in D.ORDINALS.items():
        add("NUM", number, form)
    for ident, forms in (D.PERSON_SYMBOLS if person else D.ORG_SYMBOLS).items():
        for f in forms:
            add("SYMBOL", ident.upper(), f)
    if person:
        for ident, forms in D.PERSON_NAMES.items():
            for f in forms:
                add("NAME", ident, f)
        for nick, full in D.PERSON_NICKS.items():
            add("NICK", full.upper(), nick)
    else:
        for ident, forms in D.ORG_CLASSES.items():
            for f in forms:
                add("ORGCLS", ident, f)
        for code, name in D.COUNTRIES.items():
            add("LOC", code, name.replace(" ", ""))
    return out


_TABLES = {True: _table(True), False: _table(False)}
_FINDERS = {k: Replacer({f: f for f in t}) for k, t in _TABLES.items()}


def find(text: str, person: bool) -> list[tuple[str, str, float]]:
    """(matched text, symbol, boost) of dictionary forms that white space or the ends delimit."""
    out = []
    for m in _FINDERS[person].pattern.finditer(text):
        a, b = m.span()
        if (a == 0 or text[a - 1].isspace()) and (b == len(text) or text[b].isspace()):
            out += [(m[0], s, BOOST.get(s.partition(":")[0], 0.0)) for s in _TABLES[person][m[0].lower()]]
    return out


def tag(df: DataFrame, names: Column, model: S.Model) -> DataFrame:
    """df with symbols: array<struct<part, symbol, boost>> of its names. Other schemas than people and organisations have none."""

    @F.pandas_udf("array<struct<part: string, symbol: string, boost: double>>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, person in batches:
            yield pd.Series([[dict(zip(("part", "symbol", "boost"), x, strict=True)) for t in ts for x in find(t, bool(p))] if p is not None else [] for ts, p in zip(texts, person, strict=True)], index=texts.index, dtype=object)

    joined = F.transform(tokenize_names(names), lambda t: unaccent(F.array_join(t, " ")))
    schema = F.col("schema")
    kind = F.when(schema == "Person", F.lit(True)).when(schema.isin("LegalEntity", "Organization", "Company", "PublicBody"), F.lit(False))
    none = F.array().cast("array<struct<part: string, symbol: string, boost: double>>")
    return df.withColumn("symbols", F.when(kind.isNotNull(), run.asNondeterministic()(joined, F.coalesce(kind, F.lit(False)))).otherwise(none))
