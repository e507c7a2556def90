"""Candidate retrieval: equi-joins on block keys, boosts summed, the best candidates of each query kept.

Keys are columns of both sides. Every key makes candidates, however many entities have it: `block` makes all
pairs, `best` the best of each query, for which entities that share only frequent keys need not be paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lynceus.functions import kernels, text
from lynceus.operators import schema as S
from lynceus.operators.entities import group, values
from lynceus.operators.symbols import tag
from lynceus.session import cut, remembered

# Boosts of the clauses.
FUZZY, KEY, PART, PHONETIC, TERM = 3.0, 4.0, 1.0, 0.8, 1.0
TIE = 0.2
#: entities of a key beyond which it is frequent, and ids of a list or a task's share of a key: both only tell how the work is dealt
FREQUENT, DEAL = 1000, 10_000
#: entities that follow one another for query after query of a block: so near that what is written of them repeats
#: within what compression looks back on
RUN = 256


def phonetic_names(tokens: Column) -> Column:
    """Metaphone codes of over two characters of ASCII tokens."""

    @F.pandas_udf("array<string>")
    def codes(lists: pd.Series) -> pd.Series:
        return lists.map(lambda ts: [c for t in ts if len(c := kernels.metaphone(t)) > 2] if ts is not None else [])

    return codes.asNondeterministic()(tokens)


def phonetic_tuples(tokens: Column) -> Column:
    """(token, code) of tokens of two bytes or more; codes of under three characters are null."""

    @F.pandas_udf("array<struct<token: string, code: string>>")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda ts: [{"token": t, "code": c} for t, c in kernels.coded(list(ts))] if ts is not None else [])

    return run.asNondeterministic()(tokens)


def phonetic_column(names: Column) -> Column:
    """Sound keys of names: tokens of three characters or more in a modern alphabet, made Latin."""
    long = F.filter(F.flatten(text.tokenize_names(names)), lambda t: text.is_modern(t) & (F.char_length(t) >= 3))
    return phonetic_names(F.transform(long, text.latinize))


def sampled(df: DataFrame, model: S.Model, size: int) -> DataFrame:
    """Queries with the column names: at most about `size` of their names, chosen to differ."""

    @F.pandas_udf("array<string>")
    def pick(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import unicodedata

        for names, cleaned in batches:
            yield pd.Series([[unicodedata.normalize("NFC", n) for n in kernels.pick_names(list(a), list(b), size)] for a, b in zip(names, cleaned, strict=True)], index=names.index, dtype=object)

    names = group(model, "name", True)
    return df.withColumn("__all", names).withColumn("names", pick.asNondeterministic()(F.col("__all"), text.clean_names(F.col("__all")))).drop("__all")


def _key(kind: str, values_: Column, boost: float) -> Column:
    return F.transform(values_, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("key"), F.lit(boost).alias("boost")))


#: kinds of property clauses: logical type -> kind of key
TYPED = {"country": "countries", "date": "dates", "identifier": "identifiers", "url": "urls"}


def typed_keys(model: S.Model, matchable: bool) -> list[Column]:
    """Exact keys of countries, dates, identifiers and links; words of addresses. Names are not among them."""
    out = [_key(kind, group(model, t, matchable), TERM) for t, kind in TYPED.items()]
    words = F.flatten(F.transform(group(model, "address", matchable), lambda a: F.split(F.trim(F.regexp_replace(F.lower(a), r"[^\p{IsAlphabetic}\p{N}]+", " ")), " ")))
    return [*out, _key("addresses", F.filter(words, lambda w: w != ""), TERM)]


def name_keys(names: Column, sounds: Column) -> list[Column]:
    return [_key("name_keys", text.index_name_keys(names), KEY), _key("name_parts", text.index_name_parts(names), PART), _key("name_phonetic", sounds, PHONETIC)]


def _sounds() -> Column:
    return phonetic_column(F.col("__names"))


def _keys(model: S.Model, matchable: bool, symbols: bool) -> Column:
    """All keys of a row with __names, __sounds and, if asked for, symbols."""
    keys = [*name_keys(F.col("__names"), F.col("__sounds")), *typed_keys(model, matchable)]
    if symbols:
        keys.append(F.transform(F.col("symbols"), lambda s: F.struct(F.lit("name_symbols").alias("kind"), s["symbol"].alias("key"), F.lit(1.0).alias("boost"))))
    return F.explode(F.array_distinct(F.flatten(F.array(*keys))))


def keyed(df: DataFrame, model: S.Model, names: Column, matchable: bool, symbols: bool = False) -> DataFrame:
    """(id, kind, key, boost) rows of entities or queries. With symbols, kind name_symbols too."""
    out = df.withColumn("__names", names).withColumn("__sounds", remembered(_sounds))
    if symbols:
        out = tag(out, F.col("__names"), model)
    return out.select("id", remembered(_keys, model, matchable, symbols).alias("k")).select("id", "k.*").filter("key is not null and key <> ''")


def deletions(word: Column, most: int) -> Column:
    """A word and its forms with up to `most` (1 or 2) characters deleted: words k edits apart share one."""
    one = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), w.substr(i + 1, F.length(w))))
    first = F.array_append(one(word), word)
    return F.array_distinct(first if most == 1 else F.concat(first, F.flatten(F.transform(one(word), lambda w: F.when(F.length(w) > 0, one(w)).otherwise(F.array(w))))))


def edits(word: Column) -> Column:
    """Edits allowed by length: none up to 2 characters, one up to 5, else two."""
    n = F.char_length(word)
    return F.when(n <= 2, 0).when(n <= 5, 1).otherwise(2)


def _words(names: Column) -> Column:
    clean = F.regexp_replace(F.lower(names), r"[^\p{IsAlphabetic}\p{N}]+", " ")
    return F.array_distinct(F.filter(F.split(F.trim(clean), " "), lambda w: w != ""))


def fuzzy(queries: DataFrame, entities: DataFrame, expansions: int = 200) -> DataFrame:
    """(query_id, entity_id, boost): names all of whose words an entity's names have, up to a few edits.

    queries and entities: (id, names array<string>). Distinct words meet on shared deletion forms and are
    verified; each query word expands to at most `expansions` entity words, the nearest first. Only words
    are compared, never names, so the work follows the vocabulary.
    """
    q = queries.select(F.col("id").alias("query_id"), F.explode("names").alias("name")).select("query_id", "name", F.explode(_words(F.col("name"))).alias("word"))
    e = entities.select(F.col("id").alias("entity_id"), F.explode("names").alias("name")).select("entity_id", F.explode(_words(F.col("name"))).alias("other")).distinct()
    forms = lambda w: F.when(edits(w) == 0, F.array(w)).when(edits(w) == 1, deletions(w, 1)).otherwise(deletions(w, 2))
    # an entity word may be longer or shorter than the query's, so both sides carry the forms of two edits
    left = q.select("word").distinct().select("word", F.explode(forms(F.col("word"))).alias("form"))
    right = e.select("other").distinct().select("other", F.explode(F.when(F.char_length("other") <= 2, deletions(F.col("other"), 1)).otherwise(deletions(F.col("other"), 2))).alias("form"))
    near = left.join(right, "form").select("word", "other").distinct()
    near = near.withColumn("distance", F.levenshtein("word", "other")).filter(F.col("distance") <= edits(F.col("word")))
    rank = F.row_number().over(Window.partitionBy("word").orderBy("distance", "other"))
    near = near.withColumn("n", rank).filter(F.col("n") <= expansions).select("word", "other")
    # equal names are met once, and only names all of whose words have a near one
    words = q.select("name", "word").distinct()
    need = words.groupBy("name").agg(F.count("*").alias("need"))
    have = words.join(near.select("word").distinct(), "word").groupBy("name").agg(F.count("*").alias("have"))
    live = words.join(need.join(have, "name").filter("have = need").select("name", "need"), "name")
    met = live.join(near, "word").join(e, "other").groupBy("name", "need", "entity_id").agg(F.count_distinct("word").alias("met"))
    found = q.select("query_id", "name").distinct().join(met.filter("met = need"), "name")
    return found.groupBy("query_id", "entity_id").agg((F.count("*") * FUZZY).alias("boost"))


def _shared(queries: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, clauses) and (entity_id, keys), sorted arrays: what of a row's keys the other side has too.

    queries: (query_id, part, kind, key, boost), entities: (entity_id, kind, key) without repeats. A key is
    a number k here. All are written as tables, as several steps read them.
    """
    on = ["kind", "key"]
    numbers = cut(queries.select(*on).distinct().join(entities.select(*on).distinct(), on).withColumn("k", F.monotonically_increasing_id()), "shared")
    q = queries.join(numbers, on).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("k", "part", "boost"))).alias("clauses"))
    e = entities.join(numbers, on).groupBy("entity_id").agg(F.array_sort(F.collect_list("k")).alias("keys"))
    return cut(q, "clauses"), cut(e, "keys")


def _clauses(queries: DataFrame) -> DataFrame:
    """Keys (id, kind, key, boost) as clauses without parts; a key with several boosts has their sum."""
    rows = queries.select(F.col("id").alias("query_id"), "kind", "key", "boost").distinct()
    return rows.groupBy("query_id", "kind", "key").agg(F.sum("boost").alias("boost")).withColumn("part", F.lit(""))


def _entity_keys(entities: DataFrame) -> DataFrame:
    return entities.select(F.col("id").alias("entity_id"), "kind", "key").distinct()


def _common() -> Column:
    """The clauses that meet a key of the entity, in the order of keys."""
    return F.filter("clauses", lambda x: F.array_contains(F.col("keys"), x["k"]))


def _sum() -> Column:
    """Boosts summed, for one clause a key; that of the key met where it is the only one in common."""
    return F.when(F.size(F.array_intersect("own", "keys")) == 1, F.col("clause.boost")).otherwise(F.aggregate(_common(), F.lit(0.0), lambda a, x: a + x["boost"]))


def _by_part() -> Column:
    """Each part counts its best clause, others a fifth; parts are summed."""
    parts = F.array_distinct(F.transform("common", lambda x: x["part"]))
    boosts = lambda p: F.transform(F.filter("common", lambda x: x["part"] == p), lambda x: x["boost"])
    best = lambda b: F.array_max(b) + TIE * (F.aggregate(b, F.lit(0.0), lambda a, x: a + x) - F.array_max(b))
    return F.aggregate(F.transform(parts, lambda p: best(boosts(p))), F.lit(0.0), lambda a, x: a + x)


def _meet(q: DataFrame, e: DataFrame, scored: Column, on: str = "keys", weight: Column | None = None) -> DataFrame:
    """Rows of q (with clauses) beside rows of e (with keys) that share a key of the column `on`, once, with boost.

    A pair is made at the first of its common keys alone, so that no later step has to bring its keys together.
    Keys of very many entities are dealt over several tasks, by the sum of weight.
    """
    n = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    right = e.withColumn("k", F.explode(on))
    deals = right.groupBy("k").agg(F.ceil(F.sum(F.lit(1) if weight is None else weight) / DEAL).alias("deals")).filter("deals > 1")
    right = right.join(deals, "k", "left").withColumn("deal", F.pmod(F.xxhash64(*e.columns), F.coalesce("deals", F.lit(1)))).drop("deals")
    left = q.withColumn("own", F.array_distinct(F.transform("clauses", lambda x: x["k"]))).withColumn("k", F.explode("own")).join(deals, "k", "left")
    left = left.withColumn("clause", F.filter("clauses", lambda x: x["k"] == F.col("k"))[0])
    left = left.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("deals", F.lit(1)) - 1))).drop("deals")
    met = right.repartition(n, "k", "deal").join(left.repartition(n, "k", "deal"), ["k", "deal"])
    met = met.filter(F.array_intersect("own", on)[0] == F.col("k"))
    return met.withColumn("common", _common()).withColumn("boost", scored).drop("k", "deal", "own", "clause", "common")


def _grouped(rows: DataFrame, by: str, ident: str, name: str, most: int) -> DataFrame:
    """(by, name): rows of equal `by` as lists of their ids, of about `most` at most."""
    many = rows.groupBy(by).agg(F.ceil(F.count("*") / most).alias("deals")).filter("deals > 1")
    dealt = rows.join(many, by, "left").withColumn("deal", F.pmod(F.xxhash64(ident), F.coalesce("deals", F.lit(1))))
    return dealt.groupBy(by, "deal").agg(F.collect_list(ident).alias(name)).drop("deal")


def block(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, entity_id, boost) from keys (id, kind, key, boost) of both sides, boosts summed.

    Rows whose keys meet the same ones are compared as one and told apart again where the pairs are made, which
    are neither sorted nor sent. Entities of a key come in short runs, each for query after query: a file of pairs is
    then a small part of what it is with all entities of a key for each query. A run that has no other key in common
    with a query has all its pairs without a look at any, others are compared list by list.
    """
    spark = queries.sparkSession
    q, e = _shared(_clauses(queries), _entity_keys(entities))
    many = e.select(F.explode("keys").alias("k")).groupBy("k").agg(F.ceil(F.count("*") / RUN).alias("runs"))
    q, e = _grouped(q, "clauses", "query_id", "queries", RUN), _grouped(e, "keys", "entity_id", "entities", RUN)
    run = F.pmod(F.xxhash64("keys", "entities"), F.col("runs")).alias("run")
    right = e.withColumn("k", F.explode("keys")).join(many, "k").groupBy("k", run).agg(F.collect_list(F.struct("keys", "entities")).alias("lists"))
    right = right.select(F.col("k").alias("of"), F.floor(F.col("run") * RUN / DEAL).alias("share"), "lists", F.flatten("lists.entities").alias("entities"), F.array_distinct(F.flatten("lists.keys")).alias("others"))
    left = q.withColumn("own", F.array_distinct(F.transform("clauses", lambda x: x["k"]))).withColumn("k", F.explode("own")).join(many, "k")
    left = left.withColumn("alone", F.filter("clauses", lambda x: x["k"] == F.col("k"))[0]["boost"])
    left = left.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("runs") - 1) * RUN / DEAL)))).drop("runs")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # exists, which always holds, has no generated code: with that, a join would hold all rows of a run, and hand them on then
    on = (F.col("of") == F.col("k")) & (F.col("share") == F.col("deal")) & F.exists("own", lambda x: x == F.col("of"))
    met = right.repartition(n, "of", "share").join(left.repartition(n, "k", "deal"), on)
    whole = F.array(F.struct("entities", F.col("alone").alias("boost")))
    boost = lambda keys: F.aggregate(F.filter("clauses", lambda x: F.array_contains(keys, x["k"])), F.lit(0.0), lambda a, x: a + x["boost"])
    made = F.filter("lists", lambda x: F.array_intersect("own", x["keys"])[0] == F.col("k"))
    parts = F.when(F.size(F.array_intersect("own", "others")) == 1, whole).otherwise(F.transform(made, lambda x: F.struct(x["entities"].alias("entities"), boost(x["keys"]).alias("boost"))))
    met = met.select("queries", F.explode(parts).alias("part")).select(F.explode("queries").alias("query_id"), "part")
    return met.select("query_id", F.explode("part.entities").alias("entity_id"), F.col("part.boost").alias("boost"))


def best(queries: DataFrame, entities: DataFrame, limit: int, gate: tuple[DataFrame, DataFrame, Column] | None = None) -> DataFrame:
    """What top(block(queries, entities), limit) returns, rank included, without making all pairs.

    gate: (query_id, q_gate), (entity_id, e_gate) and a condition on both; pairs that don't meet it don't count.
    """
    return _best(_clauses(queries), _entity_keys(entities), limit, _sum(), gate)


def _best(queries: DataFrame, entities: DataFrame, limit: int, scored: Column, gate: tuple[DataFrame, DataFrame, Column] | None = None) -> DataFrame:
    """The `limit` best entities of each query, exact for scores that no further common clause lowers.

    Entities that meet the same keys tie, so the first `limit` of each such class by id are enough. Pairs with a
    rare key in common are scored one by one. Others have only frequent keys in common: of entities with the same
    frequent keys the first `limit` by id are enough, for those that a rare key lifts only come earlier; these are
    scored by frequent keys, and count by their full score where a rare key found them too.
    """
    q, e = _shared(queries, entities)
    if gate is None:
        q, e, able = q.withColumn("q_gate", F.lit("")), e.withColumn("e_gate", F.lit("")), F.lit(True)
    else:
        q, e, able = q.join(gate[0], "query_id"), e.join(gate[1], "entity_id"), gate[2]
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("entity_id"))
    members = cut(e.withColumn("n", first("keys", "e_gate")).filter(F.col("n") <= limit), "members")
    of = q.groupBy("clauses", "q_gate").agg(F.min("query_id").alias("like"))
    own = cut(q.join(of, ["clauses", "q_gate"]).select("query_id", "like"), "like")
    frequent = e.select("entity_id", F.explode("keys").alias("k")).groupBy("k").count().filter(F.col("count") > FREQUENT).select("k").withColumn("often", F.lit(True))

    def split(rows: DataFrame, ident: str, column: str) -> DataFrame:
        """rows with what of a column of keys or clauses is rare, and what frequent."""
        k = rows.select(ident, F.explode(column).alias("x")).withColumn("k", F.col("x.k") if column == "clauses" else F.col("x")).join(frequent, "k", "left")
        lists = [F.array_sort(F.collect_list(F.when(F.col("often").isNotNull() == often, F.col("x")))).alias(name) for often, name in ((False, "rare"), (True, "known"))]
        return rows.join(k.groupBy(ident).agg(*lists), ident)

    qs = cut(split(of.withColumnRenamed("like", "query_id"), "query_id", "clauses"), "queries")
    es = cut(split(members, "entity_id", "keys"), "entities")
    # pairs with a rare key in common, by class
    some = _meet(qs.select("query_id", "clauses", "q_gate"), es.filter((F.col("n") == 1) & (F.size("rare") > 0)).select("entity_id", "keys", "e_gate", "rare"), scored, "rare")
    some = top(some.filter(able).select("query_id", "entity_id", "boost"), limit).drop("rank").withColumnRenamed("entity_id", "like")
    heads = members.filter("n = 1").select(F.col("entity_id").alias("like"), "keys", "e_gate")
    some = some.join(heads, "like").join(members, ["keys", "e_gate"]).select("query_id", "entity_id", "boost")
    # the first entities of each set of frequent keys
    firsts = es.filter(F.size("known") > 0).withColumn("m", first("known", "e_gate")).filter(F.col("m") <= limit)
    kinds = qs.filter(F.size("known") > 0).select(F.col("known").alias("clauses"), "q_gate").distinct()
    often = _meet(kinds, firsts.select("entity_id", F.col("known").alias("keys"), "e_gate"), scored).filter(able)
    order = Window.partitionBy("clauses", "q_gate").orderBy(F.desc("boost"), "entity_id")
    often = often.withColumn("m", F.row_number().over(order)).filter(F.col("m") <= limit).select("clauses", "q_gate", "entity_id", "boost")
    often = qs.select("query_id", F.col("known").alias("clauses"), "q_gate").join(often, ["clauses", "q_gate"]).select("query_id", "entity_id", "boost")
    found = top(some.unionByName(often).groupBy("query_id", "entity_id").agg(F.max("boost").alias("boost")), limit)
    return own.join(found.withColumnRenamed("query_id", "like"), "like").select("query_id", "entity_id", "boost", "rank")


def by_part(tagged: DataFrame) -> DataFrame:
    """(id, part, symbols): the distinct symbols of each part of names that `tag` has marked, sorted."""
    rows = tagged.select("id", F.explode("symbols").alias("s"))
    return rows.groupBy("id", F.col("s.part").alias("part")).agg(F.array_sort(F.collect_set("s.symbol")).alias("symbols"))


def symbol_clauses(queries: DataFrame, model: S.Model) -> DataFrame:
    """(query_id, part, kind, key, boost) of queries' name parts with symbols.

    A part's boost is the greatest of its symbols' categories, 1 without any; the part itself counts it
    whole, its sound half of it, and its symbols 0.7 of it each.
    """
    q = tag(queries.withColumn("__n", F.col("names")), F.col("__n"), model)
    marked = q.select(F.col("id").alias("query_id"), F.explode("symbols").alias("s")).select("query_id", F.col("s.part").alias("part"), "s.symbol", "s.boost")
    plain = q.select(F.col("id").alias("query_id"), F.explode(F.flatten(text.tokenize_names(F.col("names")))).alias("part")).filter("part <> ''").select("query_id", text.unaccent(F.col("part")).alias("part"))
    parts = plain.unionByName(marked.select("query_id", "part")).distinct()
    boosts = marked.groupBy("query_id", "part").agg(F.max("boost").alias("b"))
    parts = parts.join(boosts, ["query_id", "part"], "left").withColumn("b", F.when(F.coalesce("b", F.lit(0.0)) == 0, 1.0).otherwise(F.col("b")))
    one = F.array("part")
    parts = parts.withColumn("__sounds", phonetic_column(one))
    clauses = F.concat(F.transform(text.index_name_parts(one), lambda v: F.struct(F.lit("name_parts").alias("kind"), v.alias("key"), F.col("b").alias("boost"))), F.transform("__sounds", lambda v: F.struct(F.lit("name_phonetic").alias("kind"), v.alias("key"), (F.col("b") * 0.5).alias("boost"))))
    rows = parts.select("query_id", "part", F.explode(clauses).alias("c")).select("query_id", "part", "c.*")
    rows = rows.unionByName(marked.join(parts.select("query_id", "part", "b"), ["query_id", "part"]).select("query_id", "part", F.lit("name_symbols").alias("kind"), F.col("symbol").alias("key"), (F.col("b") * 0.7).alias("boost")).distinct())
    return rows


def symbol_scores(queries: DataFrame, entities: DataFrame, model: S.Model) -> DataFrame:
    """(query_id, entity_id, boost) by name parts with symbols: each part counts its best clause, others a fifth."""
    rows = symbol_clauses(queries, model)
    e = entities.select(F.col("id").alias("entity_id"), "kind", "key").distinct()
    per_part = rows.join(e, ["kind", "key"]).groupBy("query_id", "entity_id", "part").agg((F.max("boost") + TIE * (F.sum("boost") - F.max("boost"))).alias("boost"))
    return per_part.groupBy("query_id", "entity_id").agg(F.sum("boost").alias("boost"))


def best_symbols(queries: DataFrame, entities: DataFrame, model: S.Model, limit: int) -> DataFrame:
    """What top(symbol_scores(queries, entities, model), limit) returns, without making all pairs."""
    return _best(symbol_clauses(queries, model), _entity_keys(entities), limit, _by_part())


def top(candidates: DataFrame, limit: int) -> DataFrame:
    """The `limit` best candidates of each query: boost first, then id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("boost"), "entity_id")
    return candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


__all__ = ["best", "best_symbols", "block", "deletions", "fuzzy", "keyed", "phonetic_column", "sampled", "symbol_scores", "top", "typed_keys", "values"]
