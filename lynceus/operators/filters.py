"""Filters on indexed entities, and the parameters of a match request."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.operators import schema as S


@dataclass(frozen=True)
class MatchParams:
    """Defaults are those of the request, not of an empty record."""

    scope: str = "default"
    limit: int = 5
    candidate_factor: int = 10
    threshold: float = 0.7
    cutoff: float = 0.5
    algorithm: str = "logic-v1"
    topics: Sequence[str] | None = None
    include_dataset: Sequence[str] = ()
    exclude_dataset: Sequence[str] = ()
    exclude_entity_ids: Sequence[str] = ()
    changed_since: datetime | None = None
    exclude_schema: Sequence[str] = ()
    partition: bool = False
    index_type: str = "main"
    match_candidates: int = 0
    name_sample_size: int = 10
    explain: bool = False
    weights: Mapping[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name, w in self.weights.items():
            if math.isnan(w) or not -1 <= w <= 1:
                raise ValueError(f"weight of {name} is outside [-1, 1]")
        if self.index_type not in ("main", "scoped"):
            raise ValueError(f"unknown index type {self.index_type}")

    def bound(self, body: Mapping[str, object] | None) -> "MatchParams":
        """A request body's params take the place of the URL's; its weights come before the others, one by one."""
        named = {"include_datasets": "include_dataset", "exclude_datasets": "exclude_dataset", "exclude_entity_ids": "exclude_entity_ids"}
        own = {named[k]: tuple(v) for k, v in (body or {}).items() if k in named and v is not None}
        weights = (body or {}).get("weights")
        return replace(self, **own, **({"weights": {**self.weights, **weights}} if weights else {}))

    def candidate_limit(self) -> int:
        return min(max(self.limit * self.candidate_factor, self.match_candidates, 20), 9999)


def environment_weights(env: Mapping[str, str]) -> dict[str, float]:
    """WEIGHT_<FEATURE> settings, clamped to [-1, 1]; what is no number is rejected."""
    out = {}
    for k, v in env.items():
        if k.startswith("WEIGHT_"):
            w = float(v)
            if math.isnan(w):
                raise ValueError(f"{k} is not a number")
            out[k.removeprefix("WEIGHT_").lower()] = min(1.0, max(-1.0, w))
    return out


def _any_of(column: str, wanted: Sequence[str]) -> Column:
    if not wanted:
        return F.lit(False)
    return F.coalesce(F.arrays_overlap(F.col(column), F.array(*map(F.lit, wanted))), F.lit(False))


def scope_datasets(catalog: Mapping[str, Sequence[str]], scope: str, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> list[str]:
    """Datasets to search: the scope's leaves, or those of include in it, without exclude; unknown scopes have none."""
    leaves = list(catalog.get(scope, ()))
    return [d for d in (include or leaves) if d in leaves and d not in exclude]


def query_datasets(catalog: Mapping[str, Sequence[str]] | None, params: MatchParams, include: Column, exclude: Column) -> tuple[Column, Column]:
    """(datasets that a query may search, datasets that it may not), arrays by its own lists; a null list of its
    own is the request's, another one replaces it. Without a catalogue, the first is null for any dataset."""
    texts = lambda names: F.array(*map(F.lit, names)).cast("array<string>")
    include, exclude = F.coalesce(include, texts(params.include_dataset)), F.coalesce(exclude, texts(params.exclude_dataset))
    if catalog is None:
        return F.when(F.size(include) > 0, F.array_except(include, exclude)), exclude
    leaves = texts(catalog.get(params.scope, ()))
    return F.array_except(F.when(F.size(include) > 0, F.array_intersect(include, leaves)).otherwise(leaves), exclude), exclude


def of_query(allowed: Column, barred: Column, datasets: str = "datasets") -> Column:
    """Whether an entity is in a dataset that the query may search."""
    held = F.coalesce(F.col(datasets), F.array().cast("array<string>"))
    anywhere = (F.size(barred) == 0) | (F.size(F.array_except(held, barred)) > 0)
    return F.when(allowed.isNull(), anywhere).otherwise(F.arrays_overlap(held, allowed))


def in_datasets(datasets: Sequence[str], column: str = "datasets") -> Column:
    """Entities of any of the datasets. No datasets: no entities."""
    return _any_of(column, list(datasets))


def with_topics(topics: Sequence[str] | None, own_filters: Column | None = None) -> Column:
    """Any of the topics; no topics, or topics among the query's own filters: everything."""
    if not topics:
        return F.lit(True)
    hit = F.coalesce(F.arrays_overlap(F.coalesce(F.try_element_at("properties", F.lit("topics")), F.array().cast("array<string>")), F.array(*map(F.lit, topics))), F.lit(False))
    return hit if own_filters is None else F.coalesce(F.map_contains_key(own_filters, "topics"), F.lit(False)) | hit


def field_values(name: str) -> Column:
    """An entity field as a list, whether it is a column or a property."""
    if name in ("id", "schema", "caption"):
        return F.array(F.col(name))
    if name in ("datasets", "referents"):
        return F.col(name)
    return F.coalesce(F.try_element_at("properties", F.lit(name)), F.array().cast("array<string>"))


def boolean(spec: Mapping[str, Sequence[Sequence[str]]]) -> Column:
    """field -> [[a, b], [c]]: (a or b) and c, and so for every field."""
    terms = [F.coalesce(F.arrays_overlap(field_values(k), F.array(*map(F.lit, any_of))), F.lit(False)) if any_of else F.lit(False) for k, all_of in spec.items() for any_of in all_of]
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def per_query(filters: Column) -> Column:
    """`boolean` with the query's own filters map<string, array<array<string>>>, on a pair row."""
    held = lambda k: F.coalesce(F.when(k.isin("id", "schema", "caption"), F.array(F.when(k == "id", F.col("id")).when(k == "schema", F.col("schema")).otherwise(F.col("caption")))).when(k == "datasets", F.col("datasets")).when(k == "referents", F.col("referents")).otherwise(F.try_element_at("properties", k)), F.array().cast("array<string>"))
    return F.coalesce(F.forall(F.map_entries(filters), lambda e: F.forall(e["value"], lambda v: F.coalesce(F.arrays_overlap(held(e["key"]), v), F.lit(False)))), F.lit(True))


def changed_since(since: datetime | None, column: str = "last_change") -> Column:
    return F.lit(True) if since is None else F.coalesce(F.col(column) > F.lit(since).cast("timestamp_ntz"), F.lit(False))


def not_schemas(names: Sequence[str]) -> Column:
    return ~F.col("schema").isin(*names) if names else F.lit(True)


def not_ids(ids: Sequence[str]) -> Column:
    """Neither the id nor any old id is listed."""
    return ~(F.col("id").isin(*ids) | _any_of("referents", ids)) if ids else F.lit(True)


def comparable(model: S.Model, query_schema: Column) -> Column:
    return S.can_match(model, query_schema, F.col("schema"))


def apply(entities: DataFrame, params: MatchParams, datasets: Sequence[str] | None) -> DataFrame:
    """Every filter of a request that is the same for all its queries. datasets None: any dataset."""
    rows = entities.filter(changed_since(params.changed_since) & not_schemas(params.exclude_schema) & not_ids(params.exclude_entity_ids))
    if params.partition and "dataset_scope" in rows.columns:
        rows = rows.filter(F.col("dataset_scope") == params.scope)
    return rows if datasets is None else rows.filter(in_datasets(datasets))
