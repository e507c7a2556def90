"""Matching algorithms: ordered features with weights, folded into one score per pair."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.operators import schema as S
from lynceus.operators.features import column, with_kernels
from lynceus.session import remembered

Weighted = tuple[tuple[str, float], ...]


@dataclass(frozen=True)
class Algorithm:
    """highest: the greatest weighted feature counts; summed: all add up; penalties: added in order, and a
    negative one is left out where the score is already below the cutoff. gate: whether the hit's schema has
    to be one of the query's own kind, beyond being comparable."""

    name: str
    highest: Weighted = ()
    summed: Weighted = ()
    penalties: Weighted = ()
    gate: bool = False

    def weights(self, own: Mapping[str, float] | None = None) -> "Algorithm":
        """Weights overridden by name; features that end at exactly 0 are neither run nor reported."""
        own = own or {}
        part = lambda w: tuple((n, v) for n, x in w if (v := own.get(report(n), x)) != 0)
        return Algorithm(self.name, part(self.highest), part(self.summed), part(self.penalties), self.gate)


def report(feature: str) -> str:
    """The name a feature is reported and weighted under."""
    return "country_mismatch" if feature == "country_mismatch_all" else feature


# The names, features, order and weights of the published algorithms.
_NAMES: Weighted = (("name_literal_match", 1.0), ("person_name_jaro_winkler", 0.8), ("person_name_phonetic_match", 0.9), ("name_fingerprint_levenshtein", 0.9))
_IDS: Weighted = (
    ("address_entity_match", 0.98), ("crypto_wallet_match", 0.98), ("isin_security_match", 0.98), ("lei_code_match", 0.95), ("ogrn_code_match", 0.95),
    ("vessel_imo_mmsi_match", 0.95), ("inn_code_match", 0.95), ("bic_code_match", 0.95), ("identifier_match", 0.85), ("weak_alias_match", 0.8),
)
ALGORITHMS: dict[str, Algorithm] = {
    a.name: a
    for a in (
        Algorithm("name-based", summed=(("soundex_name_parts", 0.5), ("jaro_name_parts", 0.5)), gate=True),
        Algorithm("name-qualified", summed=(("soundex_name_parts", 0.5), ("jaro_name_parts", 0.5), ("country_disjoint", -0.1), ("dob_year_disjoint", -0.1), ("dob_day_disjoint", -0.15), ("gender_disjoint", -0.1), ("orgid_disjoint", -0.1)), gate=True),
        Algorithm("logic-v1", _NAMES + _IDS, (), (("country_mismatch", -0.2), ("last_name_mismatch", -0.2), ("dob_year_disjoint", -0.15), ("dob_day_disjoint", -0.2), ("gender_mismatch", -0.2), ("identifier_mismatch", 0.0), ("orgid_disjoint", -0.2), ("numbers_mismatch", -0.1))),
        Algorithm("marble-v0", (*_NAMES, ("longest_common_subsequence", 0.8), *_IDS), (("country_match", 0.1), ("dob_progressive_match", 0.15)), (("country_mismatch_all", -0.2), ("last_name_mismatch", -0.2), ("gender_mismatch", -0.2), ("identifier_mismatch", -0.3), ("orgid_disjoint", -0.2), ("numbers_mismatch", -0.1))),
    )
}
ALGORITHMS["best"] = ALGORITHMS["logic-v1"]


def listed() -> list[dict[str, object]]:
    """What a catalogue of algorithms shows: three names, the best and the default."""
    return [{"name": n, "best": n == "logic-v1", "default": n == "logic-v1"} for n in ("name-based", "name-qualified", "logic-v1")]


_ENTRY = "struct<name: string, score: double, weighted: double>"


def fold(algorithm: Algorithm, cutoff: float, raw: Mapping[str, Column]) -> Column:
    """struct<score, entries>: the unclamped score, and what ran, in order.

    Highest starts at 0; sums and penalties follow in order, each reading the score so far. The steps are an
    aggregate over an array, so the plan grows with the number of features and not with its powers.
    """
    entry = lambda n, w: F.struct(F.lit(report(n)).alias("name"), raw[n].cast("double").alias("score"), (raw[n] * F.lit(w)).alias("weighted"))
    array = lambda ws: F.array(*[entry(n, w) for n, w in ws]) if ws else F.array().cast(f"array<{_ENTRY}>")
    highest = F.greatest(F.lit(0.0), F.lit(0.0), *[raw[n] * F.lit(w) for n, w in algorithm.highest])
    first = F.struct(highest.alias("score"), array(algorithm.highest).alias("entries"))
    rest = F.concat(F.transform(array(algorithm.summed), lambda e: F.struct(e.alias("e"), F.lit(False).alias("skip"))), F.transform(array(algorithm.penalties), lambda e: F.struct(e.alias("e"), F.lit(True).alias("skip"))))
    sign = F.from_json(F.lit(json.dumps({report(n): w < 0 for n, w in algorithm.penalties})), "map<string, boolean>")

    def step(state: Column, x: Column) -> Column:
        left_out = x["skip"] & F.try_element_at(sign, x["e"]["name"]) & (state["score"] < F.lit(cutoff))
        return F.when(left_out, state).otherwise(F.struct((state["score"] + x["e"]["weighted"]).alias("score"), F.array_append(state["entries"], x["e"]).alias("entries")))

    return F.aggregate(rest, first, step)


def _able(model: S.Model, gate: bool) -> Column:
    able = S.can_match(model, F.col("q_schema"), F.col("c_schema"))
    return able & S.hit_is_a(model, F.col("q_schema"), F.col("c_schema")) if gate else able


def _fold(chosen: Algorithm, cutoff: float) -> Column:
    return fold(chosen, cutoff, {n: F.col(f"__f_{n}") for n, _ in (*chosen.highest, *chosen.summed, *chosen.penalties)})


def score_pairs(pairs: DataFrame, model: S.Model, algorithm: str = "logic-v1", cutoff: float = 0.5, weights: Mapping[str, float] | None = None, explain: bool = False) -> DataFrame:
    """pairs with score, features (name to non-zero raw score) and, with explain, explanations.

    The score is clamped to [0, 1]. Pairs whose schemas can't match score 0 without features.
    """
    chosen = ALGORITHMS[algorithm].weights(weights)
    names = list(dict.fromkeys(n for n, _ in (*chosen.highest, *chosen.summed, *chosen.penalties)))
    own = pairs.columns
    out = with_kernels(pairs, names, model)
    out = out.select(*own, remembered(_able, model, chosen.gate).alias("__able"), *[remembered(column, n, model).alias(f"__f_{n}") for n in names])
    out = out.select(*own, F.when(F.col("__able"), remembered(_fold, chosen, cutoff)).alias("__s"))
    entries = F.coalesce(F.col("__s.entries"), F.array().cast(f"array<{_ENTRY}>"))
    shown = F.map_from_entries(F.transform(F.filter(entries, lambda e: e["score"] != 0), lambda e: F.struct(e["name"], e["score"])))
    more = []
    if explain:
        note = lambda e: F.when(e["score"] == 0, F.lit("no effect")).when(e["weighted"] < 0, F.format_string("mismatch detected, %s", F.format_number(e["weighted"], 3))).otherwise(F.format_string("matched, %s", F.format_number(e["score"], 3)))
        more = [F.transform(entries, lambda e: F.struct(e["name"].alias("name"), e["score"].alias("score"), e["weighted"].alias("weighted"), note(e).alias("detail"))).alias("explanations")]
    score = F.least(F.greatest(F.coalesce(F.col("__s.score"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return out.select(*own, score.alias("score"), shown.alias("features"), *more)


def pair_up(queries: DataFrame, hits: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pair rows from derived queries and hits (see `entities.derive`) and a frame of (query_id, entity_id).

    Derived values are columns of their own in the joins and a struct after them, so that those that no
    feature of an algorithm reads are neither worked out nor sent.
    """

    def side(df: DataFrame, s: str, key: str) -> tuple[DataFrame, Column]:
        names = df.schema["d"].dataType.names
        flat = df.select(F.col("id").alias(key), *[F.col(x).alias(f"{s}_{x}") for x in ("schema", "properties")], *[F.col(f"d.{n}").alias(f"__{s}_{n}") for n in names])
        return flat, F.struct(*[F.col(f"__{s}_{n}").alias(n) for n in names]).alias(f"{s}_d")

    (left, q_d), (right, c_d) = side(queries, "q", "query_id"), side(hits, "c", "entity_id")
    joined = pairs.join(left, "query_id").join(right, "entity_id")
    return joined.select(*[c for c in joined.columns if not c.startswith(("__q_", "__c_"))], q_d, c_d)
