"""Dataset catalogues: manifests, merging, freshness, and the leaves of collections."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from pathlib import Path
from typing import Any, Protocol
from urllib.request import Request, urlopen

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_MANIFEST: dict[str, Any] = {"catalogs": [], "datasets": []}


class Fetcher(Protocol):
    """Where catalogues come from: an address and an optional token to a parsed document."""

    def __call__(self, url: str, token: str | None = None) -> dict[str, Any]: ...


def _text(url: str, token: str | None) -> str:
    if url.startswith(("http://", "https://")):
        with urlopen(Request(url, headers={"Authorization": f"Token {os.path.expandvars(token)}"} if token else {}), timeout=10) as r:
            return r.read().decode()
    return Path(url.removeprefix("file://")).read_text()


def read_document(url: str, token: str | None = None) -> dict[str, Any]:
    """A manifest, JSON or YAML, from a local path or an http address; the ending decides. A token goes in the header."""
    kind = Path(url.split("?")[0]).suffix.lower()
    parse: dict[str, Callable[[str], Any]] = {".json": json.loads, ".yml": yaml.safe_load, ".yaml": yaml.safe_load}
    if kind not in parse:
        raise ValueError(f"unknown kind of manifest: {url}")
    return parse[kind](_text(url, token))


def read_catalog(url: str, token: str | None = None) -> dict[str, Any]:
    """A catalogue: JSON, whatever the address ends in."""
    return json.loads(_text(url, token))


def load(url: str | None, indices: Sequence[tuple[str, str]], now: datetime, grace: timedelta = timedelta(0), log: Callable[[str], None] = lambda m: None) -> "Catalog":
    """The catalogue of a manifest's address: its sources fetched and merged with what is indexed."""
    return build(manifest(url), read_catalog, indices, now, grace, log)


def manifest(url: str | None, fetch: Fetcher = read_document) -> dict[str, Any]:
    return DEFAULT_MANIFEST if not url else {**DEFAULT_MANIFEST, **fetch(url)}


@dataclass
class Dataset:
    name: str
    title: str = ""
    version: str | None = None
    type: str | None = None
    children: list[str] = field(default_factory=list)
    last_export: datetime | None = None
    entities_url: str | None = None
    load: bool = False
    index_version: str | None = None
    index_current: bool = False


@dataclass
class Catalog:
    datasets: list[Dataset] = field(default_factory=list)
    current: list[str] = field(default_factory=list)
    outdated: list[str] = field(default_factory=list)

    @property
    def index_stale(self) -> bool:
        return bool(self.outdated)

    def leaves(self, name: str) -> list[str]:
        """Datasets under a collection, in order and each once; others are their own. Unknown names have none."""
        by = {d.name: d for d in self.datasets}
        out: list[str] = []
        seen: set[str] = set()

        def walk(n: str) -> None:
            if n in seen or n not in by:
                return
            seen.add(n)
            if by[n].children:
                for child in by[n].children:
                    walk(child)
            elif n not in out:
                out.append(n)

        walk(name)
        return out

    def scopes(self) -> dict[str, list[str]]:
        return {d.name: self.leaves(d.name) if d.type == "collection" else [d.name] for d in self.datasets}

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(d.name, d.title, d.version, d.type, d.children, d.last_export, d.entities_url, d.load, d.index_version, d.index_current) for d in self.datasets]
        return spark.createDataFrame(rows, "name string, title string, version string, type string, children array<string>, last_export timestamp_ntz, entities_url string, load boolean, index_version string, index_current boolean")


def _time(x: object) -> datetime | None:
    if not x:
        return None
    return x.replace(tzinfo=None) if isinstance(x, datetime) else datetime.fromisoformat(str(x)).replace(tzinfo=None)


def _age(d: Dataset, grace: timedelta) -> str | None:
    """current, outdated, or None where the indexed version can't be read."""
    if d.index_version is None:
        return "outdated"
    if d.index_version == d.version:
        d.index_current = True
        return "current"
    try:
        indexed = datetime.strptime(d.index_version.split("-")[0], "%Y%m%d%H%M%S")
    except ValueError:
        return None
    return "current" if d.last_export is not None and d.last_export <= indexed + grace else "outdated"


def build(plan: Mapping[str, Any], fetch: Fetcher, indices: Sequence[tuple[str, str]], now: datetime, grace: timedelta = timedelta(0), log: Callable[[str], None] = lambda m: None) -> Catalog:
    """Merge a manifest's catalogues and bare datasets with what is indexed.

    A catalogue that can't be fetched is logged and left out. Of datasets with one name the last stays.
    Bare datasets are loaded, are collections if they have children, and take part in no freshness list.
    """
    have = dict(indices)
    by: dict[str, Dataset] = {}
    current, outdated = [], []
    for source in plan.get("catalogs", ()):
        try:
            got = fetch(source["url"], source.get("auth_token"))
        except Exception as error:  # one source must not take the others with it
            log(f"{source.get('url')}: {error}")
            continue
        scopes = source.get("scopes") or ([source["scope"]] if source.get("scope") else [])
        for x in got.get("datasets", ()):
            url = next((r.get("url") for r in x.get("resources") or () if r.get("name") == "entities.ftm.json"), None)
            d = Dataset(x["name"], x.get("title", ""), x.get("version"), x.get("type"), list(x.get("children") or ()), _time(x.get("last_export")), url, x["name"] in scopes, have.get(x["name"]))
            by.pop(d.name, None)
            by[d.name] = d
            if d.name in have:
                age = _age(d, grace)
                if age:
                    (current if age == "current" else outdated).append(d.name)
    for x in plan.get("datasets", ()):
        children = list(x.get("children") or ())
        by.pop(x["name"], None)
        by[x["name"]] = Dataset(x["name"], x.get("title", ""), x.get("version") or f"{now:%Y%m%d%H%M%S}-mot", "collection" if children else x.get("type"), children, None, x.get("entities_url"), True, have.get(x["name"]))
    return Catalog(list(by.values()), current, outdated)


def parse_indices(names: DataFrame, column: str = "name", prefix: str = "entities") -> DataFrame:
    """(dataset, version) of physical names <prefix>-<dataset>-<any>-<version...>; others and those without version are dropped."""
    parts = F.split(F.col(column), "-")
    version = F.array_join(F.slice(parts, 4, F.greatest(F.size(parts) - 3, F.lit(0))), "-")
    return names.filter((parts[0] == prefix) & (F.size(parts) > 3)).select(parts[1].alias("dataset"), version.alias("version")).filter("version <> ''")


def freshness(catalog: DataFrame, indices: DataFrame, grace: str = "INTERVAL '0' SECOND") -> DataFrame:
    """catalog (name, version, last_export) with index_version, index_current and status, by a left join on names.

    status: current, outdated, or null for datasets without an index or with an unreadable version.
    """
    out = catalog.join(indices.select(F.col("dataset").alias("name"), F.col("version").alias("index_version")), "name", "left")
    same = F.coalesce(F.col("version") == F.col("index_version"), F.lit(False))
    indexed = F.try_to_timestamp(F.split("index_version", "-")[0], F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")
    late: Column = F.when(F.coalesce(F.col("last_export") <= indexed + F.expr(grace), F.lit(False)), "current").otherwise("outdated")
    status = F.when(F.col("index_version").isNull(), None).when(same, "current").when(indexed.isNull(), None).otherwise(late)
    return out.withColumn("index_current", same).withColumn("status", status)


def leaves(datasets: DataFrame, depth: int = 16) -> DataFrame:
    """(root, leaf) for every dataset (name, children): a closure by self-joins, safe with cycles.

    Children that are no dataset are left out. Stops when nothing new is reached, or after `depth` levels.
    """
    edges = datasets.select("name", F.explode("children").alias("child")).join(datasets.select(F.col("name").alias("child")), "child")
    reach = datasets.select(F.col("name").alias("root"), F.col("name").alias("at"))
    front = reach
    for _ in range(depth):
        step = front.join(edges, front["at"] == edges["name"]).select("root", F.col("child").alias("at")).distinct()
        front = step.join(reach, ["root", "at"], "left_anti")
        if front.isEmpty():
            break
        reach = reach.unionByName(front)
    ends = datasets.filter(F.size("children") == 0).select(F.col("name").alias("at"))
    return reach.join(ends, "at", "left_semi").select("root", F.col("at").alias("leaf"))
