"""The library's front: one engine over an entity store, a catalogue and a schema model."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from lynceus import __version__
from lynceus.operators import lookup
from lynceus.operators.algorithms import listed
from lynceus.operators.filters import MatchParams, environment_weights
from lynceus.plans.match import Index, match, respond
from lynceus.session import planned
from lynceus.sources import store
from lynceus.sources.catalog import Catalog


class EngineError(Exception):
    """Base of what an engine raises; status is what an HTTP layer would answer."""

    status = 500


class NotFound(EngineError):
    status = 404


class InvalidSchema(EngineError):
    status = 400


class Unavailable(EngineError):
    status = 503


@dataclass
class Metrics:
    """What an engine has done so far."""

    requests: int = 0
    queries: int = 0
    failures: int = 0
    refreshes: int = 0


@dataclass
class Engine:
    """weights: those of the environment (see `environment_weights`); requests override them one by one.
    source: where the catalogue comes from; without it the catalogue is what it was made with."""

    spark: SparkSession
    index: Index
    catalog_: Catalog | None = None
    weights: Mapping[str, float] = field(default_factory=lambda: environment_weights(os.environ))
    source: Callable[[], Catalog] | None = None
    metrics: Metrics = field(default_factory=Metrics)

    def __post_init__(self) -> None:
        planned(self.spark)

    def match(self, queries: Mapping[str, Mapping[str, Any]], params: MatchParams | None = None, body: Mapping[str, Any] | None = None) -> DataFrame:
        """Match named query entities {id: {schema, properties, filters?, params?}} as one batch.

        A query's own params come before the body's, and the body's before params; weights of the body before
        those of params, and these before the environment's. body: include_datasets, exclude_datasets,
        exclude_entity_ids and weights, as far as they are given.
        """
        self.metrics.requests += 1
        self.metrics.queries += len(queries)
        for name, q in queries.items():
            if q["schema"] not in self.index.model.schemas:
                self.metrics.failures += 1
                raise InvalidSchema(f"{name}: unknown schema {q['schema']}")
        params = params or MatchParams()
        params = replace(params, weights={**self.weights, **params.weights}).bound(body)
        rows = [(k, q["schema"], {p: list(v) if isinstance(v, (list, tuple)) else [v] for p, v in q.get("properties", {}).items()}) for k, q in queries.items()]
        frame = self.spark.createDataFrame(rows, "id string, schema string, properties map<string, array<string>>")
        own = [(k, q.get("filters"), (q.get("params") or {}).get("include_datasets"), (q.get("params") or {}).get("exclude_datasets")) for k, q in queries.items()]
        per = self.spark.createDataFrame(own, "query_id string, filters map<string, array<array<string>>>, include_datasets array<string>, exclude_datasets array<string>")
        if all(x is None and y is None for *_, x, y in own):
            per = per.drop("include_datasets", "exclude_datasets")  # the request's hold for all
        return respond(frame, match(frame, self.index, params, per), self.index)

    def entity(self, ident: str, nested: bool = True, rounds: int = 2, limit: int = 200) -> dict[str, Any]:
        """One entity, with what hangs under it; an old id gives {"redirect": id}."""
        if nested:
            got = lookup.nested(self.index.entities, self.index.model, ident, rounds, limit)
        else:
            row = lookup.get(self.index.entities, ident).first()
            got = None if row is None else {"redirect": row["id"]} if row["kind"] == "referent" else row.asDict(recursive=True)
        if got is None:
            raise NotFound(ident)
        return got

    def fields(self, names: Sequence[str], where: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
        """(field, value, count); where: field to accepted values, all of which must hold for an entity to count."""
        return store.field_counts(self.index.entities, names, None if where is None else store.scoped_filter(where))

    def catalog(self, force_refresh: bool = False) -> DataFrame:
        """The catalogue; fetched anew if asked for, and the search's scopes with it."""
        if self.source is not None and (force_refresh or self.catalog_ is None):
            self.metrics.refreshes += 1
            try:
                self.catalog_ = self.source()
            except Exception as error:
                self.metrics.failures += 1
                raise Unavailable("the catalogue could not be fetched") from error
            self.index.scopes = self.catalog_.scopes()
        return (self.catalog_ or Catalog()).frame(self.spark)

    def ready(self) -> tuple[bool, str]:
        """Whether entities can be read."""
        try:
            missing = {"id", "schema", "properties"} - set(self.index.entities.columns)
            self.index.entities.limit(1).collect()
        except Exception as error:  # a health check reports instead of raising
            return False, str(error).splitlines()[0]
        return not missing, f"missing {sorted(missing)}" if missing else "ok"

    def create_scoped(self, root: str, query: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
        store.create_scoped(self.index.entities, root, query)
        self.index.scoped = store.current_scoped(self.spark, root)
        return self.index.scoped

    @staticmethod
    def algorithms() -> list[dict[str, object]]:
        return listed()

    @staticmethod
    def version() -> str:
        return __version__
