"""Entity schemas: a type hierarchy with typed properties, resolved on the driver into literal maps.

The hierarchy has tens of types, so its closures are Python tables; on rows they are map literals.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import cached_property
from pathlib import Path

import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Property:
    name: str
    type: str = ""
    matchable: bool = True
    reverse: str | None = None


@dataclass(frozen=True)
class Schema:
    name: str
    extends: tuple[str, ...] = ()
    matchable: bool = True
    properties: tuple[Property, ...] = ()
    caption: tuple[str, ...] = ()
    edge: tuple[str, str] | None = None


ROOT = "Thing"


@dataclass
class Model:
    """All schemas by name. Unknown names have no parents, descendants or properties."""

    schemas: dict[str, Schema] = field(default_factory=dict)

    def parents(self, name: str) -> list[str]:
        """The schema and its ancestors, depth first, each once."""
        out: list[str] = []

        def walk(n: str) -> None:
            if n in self.schemas and n not in out:
                out.append(n)
                for p in self.schemas[n].extends:
                    walk(p)

        walk(name)
        return out

    def matchable_chain(self, name: str) -> list[str] | None:
        """`parents`, or None if a schema on the way other than the root can't be matched."""
        chain = self.parents(name)
        return chain if all(self.schemas[n].matchable or n == ROOT for n in chain) and chain else None

    def descendants(self, name: str) -> list[str]:
        return sorted(n for n in self.schemas if n != name and name in self.parents(n))

    def is_a(self, name: str, other: str) -> bool:
        return other in self.schemas and other in self.parents(name)

    def matchable(self, name: str) -> list[str]:
        """Schemas that a query of this schema may match: itself, descendants, matchable ancestors."""
        if name not in self.schemas:
            return []
        above = [p for p in self.parents(name)[1:] if self.schemas[p].matchable]
        return sorted({name, *self.descendants(name), *above})

    def properties(self, name: str) -> dict[str, Property]:
        out: dict[str, Property] = {}
        for n in self.parents(name):
            for p in self.schemas[n].properties:
                out.setdefault(p.name, p)
        return out

    def group(self, name: str, kind: str, matchable: bool = False) -> list[str]:
        """Properties of a type over the schema and its ancestors, in order of name."""
        return sorted(p.name for p in self.properties(name).values() if p.type == kind and (p.matchable or not matchable))

    def caption(self, name: str) -> list[str]:
        return next((list(self.schemas[n].caption) for n in self.parents(name) if self.schemas[n].caption), [])

    @cached_property
    def edges(self) -> list[str]:
        return sorted(n for n in self.schemas if any(self.schemas[p].edge for p in self.parents(n)))

    def lists(self, rule) -> Column:
        """Map literal from each schema to the list that a rule gives for its name."""
        return F.from_json(F.lit(json.dumps({n: rule(n) for n in sorted(self.schemas)})), "map<string, array<string>>")


def of(model: Model, schema: Column, rule) -> Column:
    """The list that a rule gives for a row's schema; empty if unknown."""
    return F.coalesce(F.try_element_at(model.lists(rule), schema), F.array().cast("array<string>"))


def is_a(model: Model, schema: Column, name: str) -> Column:
    return F.coalesce(schema.isin(*[n for n in model.schemas if model.is_a(n, name)]), F.lit(False))


def can_match(model: Model, query: Column, hit: Column) -> Column:
    return F.array_contains(of(model, query, model.matchable), hit)


def hit_is_a(model: Model, query: Column, hit: Column) -> Column:
    return F.array_contains(of(model, hit, model.parents), query)


def _p(spec: str) -> tuple[Property, ...]:
    """'name:type' or 'name:type:reverse', a trailing - for not matchable."""
    out = []
    for word in spec.split():
        name, kind, reverse = (*word.rstrip("-").split(":"), "", "")[:3]
        out.append(Property(name, kind, not word.endswith("-"), reverse or None))
    return tuple(out)


def default_model() -> Model:
    """The schemas this package knows by itself: people, organisations, things and relations."""
    rows = [
        Schema(ROOT, (), True, _p("name:name alias:name weakAlias abbreviation- country:country topics:topic- address:address addressEntity:entity:addressEntities sourceUrl:url- website:url notes- modifiedAt:date-"), ("name",)),
        Schema("Interval", (), False, _p("startDate:date- endDate:date- date:date-")),
        Schema("Analyzable", (ROOT,), False, _p("detectedNames:name-")),
        Schema("LegalEntity", (ROOT,), True, _p("email phone legalForm jurisdiction:country registrationNumber:identifier taxNumber:identifier vatCode:identifier idNumber:identifier leiCode:identifier ogrnCode:identifier innCode:identifier bicCode:identifier incorporationDate:date parent:entity:subsidiaries"), ("name", "email", "registrationNumber")),
        Schema("Person", ("LegalEntity",), True, _p("firstName secondName middleName fatherName motherName lastName birthDate:date birthPlace gender nationality:country citizenship:country passportNumber:identifier socialSecurityNumber:identifier title- position-"), ("name", "lastName", "email")),
        Schema("Organization", ("LegalEntity",), True, _p("imoCompany:identifier"), ("name",)),
        Schema("Asset", (ROOT,), True, _p("currency-")),
        Schema("Company", ("Organization", "Asset"), True, _p("isin:identifier ticker:identifier"), ("name",)),
        Schema("PublicBody", ("Organization",), True),
        Schema("Vehicle", (ROOT,), True, _p("registrationNumber:identifier type model buildDate:date flag:country owner:entity:ownedVehicles"), ("name", "registrationNumber")),
        Schema("Vessel", ("Vehicle",), True, _p("pastName:name imoNumber:identifier mmsi:identifier callSign:identifier")),
        Schema("Airplane", ("Vehicle",), True, _p("serialNumber:identifier icaoCode:identifier")),
        Schema("Security", ("Asset",), True, _p("isin:identifier issuer:entity:securities")),
        Schema("Address", (ROOT,), True, _p("full:address city street postalCode"), ("full",)),
        Schema("CryptoWallet", (ROOT,), True, _p("publicKey:identifier currency- holder:entity:cryptoWallets"), ("publicKey",)),
        Schema("Document", ("Analyzable",), False, _p("title fileName")),
        Schema("Event", ("Interval", "Analyzable"), False, _p("summary")),
        Schema("Sanction", ("Interval",), False, _p("entity:entity:sanctions authority- program-")),
        Schema("Family", ("Interval",), False, _p("person:entity:familyPerson relative:entity:familyRelative relationship-"), edge=("person", "relative")),
        Schema("Ownership", ("Interval",), False, _p("owner:entity:ownershipOwner asset:entity:ownershipAsset share-"), edge=("owner", "asset")),
        Schema("Directorship", ("Interval",), False, _p("director:entity:directorshipDirector organization:entity:directorshipOrganization"), edge=("director", "organization")),
        Schema("Documentation", ("Interval",), False, _p("document:entity:relatedEntities entity:entity:documentedBy"), edge=("document", "entity")),
    ]
    return Model({s.name: s for s in rows})


def load(folder: str | Path, base: Model | None = None) -> Model:
    """Schemas from YAML or JSON files of a folder over those of base; a later file's definition wins."""
    out = dict((base or default_model()).schemas)
    for path in sorted(Path(folder).iterdir()):
        if path.suffix in (".yml", ".yaml", ".json"):
            read = json.loads if path.suffix == ".json" else yaml.safe_load
            for name, x in (read(path.read_text()) or {}).items():
                props = tuple(Property(k, v.get("type", ""), v.get("matchable", True), (v.get("reverse") or {}).get("name")) for k, v in (x.get("properties") or {}).items())
                edge = x.get("edge")
                out[name] = Schema(name, tuple(x.get("extends") or ()), x.get("matchable", True), props, tuple(x.get("caption") or ()), (edge["source"], edge["target"]) if edge else None)
    return Model(out)
