"""Exact-key venue matching with matched / ambiguous / unmatched outcomes.

Keys are aggregated per (namespace, key) first, so that a candidate meets one row per
namespace: two left equi joins, no explode and no shuffle of the candidates where the
key tables are small enough to broadcast. Their size is counted before the hint is
given; beyond ``BROADCAST_KEYS`` Spark plans a shuffled join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import acronym_of_name, venue_acronym, venue_name
from ..scratch import drop, tasks, written

BROADCAST_KEYS = 200_000
#: Bytes of keys and owners that ``tell`` sends to every task at most.
BROADCAST_BYTES = 32 << 20
_ENTRY = "array<struct<venue_id:string,priority:int,pos:int,matched_by:string,matched_value:string>>"


def check_ids(venues: DataFrame) -> None:
    """Ids must be non-blank and distinct after trimming."""
    bad = (
        venues.groupBy(F.trim("id").alias("id")).agg(F.count("*").alias("n"))
        .where("n > 1 or id = '' or id is null").orderBy("id").limit(1).collect()
    )
    if bad:
        raise ValueError(f"Duplicate venue id: {bad[0]['id']}" if bad[0]["id"] else "Venue id must not be empty.")


def venue_keys(venues: DataFrame) -> DataFrame:
    """(namespace, key, venue_id, priority, pos, matched_by, matched_value), the best of each venue and key."""
    def source(names: Column, kind: str, priority: int, namespace: str) -> DataFrame:
        rows = venues.select(F.col("id").alias("venue_id"), "pos", F.posexplode(names).alias("nth", "matched_value"))
        return rows.select(F.lit(namespace).alias("namespace"), "venue_id", F.lit(priority).alias("priority"), "pos", F.lit(kind).alias("matched_by"), "matched_value", "nth")

    every = (
        source(F.array("canonical_name"), "canonicalName", 0, "name")
        .unionByName(source(F.col("aliases"), "alias", 1, "name"))
        .unionByName(source(F.coalesce("acronyms", F.array().cast("array<string>")), "acronym", 2, "acronym"))
    )
    # a small file is one task, and keys cost far more than its bytes: names are dealt first; exploded, so that no filter on keys makes them before that
    key = F.when(F.col("namespace") == "name", venue_name(F.col("matched_value"))).otherwise(venue_acronym(F.col("matched_value")))
    dealt = every.repartition(tasks(venues.sparkSession), "venue_id", "matched_value").select("*", F.explode(F.array(key)).alias("key"))
    best = F.min(F.struct("priority", "pos", "nth", "matched_by", "matched_value"))
    return dealt.where("key <> ''").groupBy("namespace", "key", "venue_id").agg(best.alias("b")).select(
        "namespace", "key", "venue_id", "b.priority", "b.pos", "b.matched_by", "b.matched_value")


class VenueIndex:
    """Key tables of a venue table (schema.VENUE; only id, names and pos are read)."""

    def __init__(self, venues: DataFrame, checked: bool = True) -> None:
        if checked:
            check_ids(venues)
        self.venues = venues
        self.keys = venue_keys(venues)
        entry = F.struct("venue_id", "priority", "pos", "matched_by", "matched_value")
        self.entries = self.keys.groupBy("namespace", "key").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
        self._small: bool | None = None
        self._owned: DataFrame | None = None
        self._sent = False

    def _table(self, namespace: str, key: str, entries: str) -> DataFrame:
        own = self.entries.where(F.col("namespace") == namespace).select(F.col("key").alias(key), F.col("entries").alias(entries))
        if self._small is None:
            self._small = self.keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
        return F.broadcast(own) if self._small else own

    def match(self, candidates: DataFrame, candidate: str = "candidate", truncated: str | None = None) -> DataFrame:
        """``candidates`` plus a struct ``match``: status, reason, matched_by, matched_value,
        confidence, normalized_candidate, venue_id, candidates (ids in ICU order)."""
        name = F.coalesce(venue_name(F.col(candidate)), F.lit(""))
        cut = F.coalesce(F.col(truncated), F.lit(False)) if truncated else F.lit(False)
        probed = candidates.withColumn("__name", name).withColumn("__acronym", acronym_of_name(F.col("__name"))).withColumn("__cut", cut)
        joined = probed.join(self._table("name", "__name", "__n"), "__name", "left").join(self._table("acronym", "__acronym", "__a"), "__acronym", "left")
        none = F.array().cast(_ENTRY)
        names, short = F.coalesce("__n", none), F.coalesce("__a", none)
        fresh = F.filter(short, lambda a: ~F.exists(names, lambda n: n["venue_id"] == a["venue_id"]))
        found = F.when((F.col("__name") == "") | F.col("__cut"), none).otherwise(F.concat(names, fresh))
        one, n = F.get(F.col("__hits"), F.lit(0)), F.size("__hits")
        status = F.when(n == 0, "unmatched").when(n == 1, "matched").otherwise("ambiguous")
        reason = (
            F.when(F.col("__name") == "", "missing-candidate").when(F.col("__cut"), "truncated-source")
            .when(n == 0, "no-exact-match").when(n > 1, "key-conflict")
        )
        ids = F.array_sort(F.transform("__hits", lambda e: F.collate(e["venue_id"], "UNICODE")))
        result = F.struct(
            status.alias("status"), reason.alias("reason"), F.when(n == 1, one["matched_by"]).alias("matched_by"),
            F.when(n == 1, one["matched_value"]).alias("matched_value"),
            F.when(n == 1, F.when(one["matched_by"] == "acronym", "medium").otherwise("high")).alias("confidence"),
            F.col("__name").alias("normalized_candidate"), F.when(n == 1, one["venue_id"]).alias("venue_id"),
            F.when(n > 1, F.transform(ids, lambda i: F.collate(i, "UTF8_BINARY"))).alias("candidates"),
        )
        return joined.withColumn("__hits", found).select(*[F.col(f"`{c}`") for c in candidates.columns], result.alias("match"))

    def _owners(self) -> DataFrame:
        """(namespace, key, n, one), written: how many venues own a key, and the least of them. A key of very many venues is one row of bounded size."""
        if self._owned is None:
            one = F.min(F.struct("venue_id", "matched_by", "matched_value")).alias("one")
            self._owned = written(self.keys.groupBy("namespace", "key").agg(F.count("*").alias("n"), one), "venue-owners")
            size = F.sum(F.length("key") * 4 + F.length("one.matched_value") * 4 + F.length("one.venue_id") * 4 + 64)
            self._sent = (self._owned.agg(F.coalesce(size, F.lit(0)).alias("b")).first()["b"]) <= BROADCAST_BYTES
        return F.broadcast(self._owned) if self._sent else self._owned

    def tell(self, candidates: DataFrame, candidate: str = "candidate", truncated: str | None = None) -> DataFrame:
        """``candidates`` plus a struct ``match`` as of ``match``, but without the list of candidates: it has keys to look them up by.

        Counts and one owner a key decide every outcome, so no list of a key's owners is
        made, and the candidates are not shuffled where the keys are few. ``owners_of`` has the lists, as rows.
        """
        name = F.coalesce(venue_name(F.col(candidate)), F.lit(""))
        cut = F.coalesce(F.col(truncated), F.lit(False)) if truncated else F.lit(False)
        probed = candidates.withColumn("__name", name).withColumn("__acronym", acronym_of_name(F.col("__name"))).withColumn("__cut", cut)
        own = lambda namespace, key, at: self._owners().where(F.col("namespace") == namespace).select(F.col("key").alias(key), F.struct("n", "one").alias(at))
        joined = probed.join(own("name", "__name", "__n"), "__name", "left").join(own("acronym", "__acronym", "__a"), "__acronym", "left")
        sought = (F.col("__name") != "") & ~F.col("__cut")
        n, a = F.when(sought, F.coalesce("__n.n", F.lit(0))).otherwise(0), F.when(sought, F.coalesce("__a.n", F.lit(0))).otherwise(0)
        alike = (n == 1) & (a == 1) & (F.col("__n.one.venue_id") == F.col("__a.one.venue_id"))
        single = alike | (n + a == 1)
        one = F.when(n > 0, F.col("__n.one")).otherwise(F.col("__a.one"))
        reason = (
            F.when(F.col("__name") == "", "missing-candidate").when(F.col("__cut"), "truncated-source")
            .when(n + a == 0, "no-exact-match").when(~single, "key-conflict")
        )
        result = F.struct(
            F.when(single, "matched").when(n + a == 0, "unmatched").otherwise("ambiguous").alias("status"), reason.alias("reason"),
            F.when(single, one["matched_by"]).alias("matched_by"), F.when(single, one["matched_value"]).alias("matched_value"),
            F.when(single, F.when(one["matched_by"] == "acronym", "medium").otherwise("high")).alias("confidence"),
            F.col("__name").alias("normalized_candidate"), F.col("__acronym").alias("acronym"), F.when(single, one["venue_id"]).alias("venue_id"),
        )
        return joined.select(*[F.col(f"`{c}`") for c in candidates.columns], result.alias("match"))

    def drop(self) -> None:
        """Delete what ``tell`` has written, once nothing still to run reads it."""
        if self._owned is not None:
            drop(self._owned)
            self._owned = None

    def owners_of(self, told: DataFrame, *row: str) -> DataFrame:
        """(row, venue_id): the venues of each ambiguous row of ``tell``, one row each; only keys that are ambiguous are looked up."""
        key = lambda namespace, at: F.struct(F.lit(namespace).alias("__namespace"), F.col(at).alias("__key"))
        asked = told.where("match.status = 'ambiguous'").select(*row, F.explode(F.array(key("name", "match.normalized_candidate"), key("acronym", "match.acronym"))).alias("__asked")).select(*row, "__asked.*")
        owned = self.keys.select(F.col("namespace").alias("__namespace"), F.col("key").alias("__key"), F.col("venue_id").alias("__venue"))
        return asked.join(owned, ["__namespace", "__key"]).select(*row, F.col("__venue").alias("venue_id")).distinct()

    def shared(self) -> DataFrame:
        """(namespace, key, venue_id): the owners of every key, a row each; in ``cross`` those of a name key that is also an acronym, of both kinds."""
        own = written(self.keys.select("namespace", "key", "venue_id"), "key-owners")
        names, short = own.where("namespace = 'name'"), own.where("namespace = 'acronym'").select(F.col("key").alias("short"), "venue_id")
        both = names.select("key").distinct().withColumn("short", acronym_of_name(F.col("key"))).join(short.select("short").distinct(), "short")
        cross = names.join(both.select("key"), "key").select("key", "venue_id").unionByName(both.join(short, "short").select("key", "venue_id"))
        return own.unionByName(cross.distinct().select(F.lit("cross").alias("namespace"), "key", "venue_id"))

    def conflicts(self) -> DataFrame:
        """(namespace, key, ids): keys that several venues own, within and across namespaces."""
        out = self.shared().groupBy("namespace", "key").agg(F.collect_set("venue_id").alias("ids")).where(F.size("ids") > 1)
        ordered = F.array_sort(F.transform("ids", lambda i: F.collate(i, "UNICODE")))
        return out.select("namespace", "key", F.transform(ordered, lambda i: F.collate(i, "UTF8_BINARY")).alias("ids"))


def cross_type(conflicts: DataFrame, venues: DataFrame) -> DataFrame:
    """``conflicts`` with all_types_differ: every venue has a type of its own."""
    each = conflicts.select("namespace", "key", F.explode("ids").alias("id")).join(venues.select("id", "type"), "id")
    told = each.groupBy("namespace", "key").agg((F.countDistinct("type") == F.count("*")).alias("all_types_differ"))
    return conflicts.join(told, ["namespace", "key"])
