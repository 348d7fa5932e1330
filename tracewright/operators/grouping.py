"""Structural grouping, compact lists, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.documents import round_columns


def profile_key(rows: DataFrame, *profile: str) -> Column:
    """The profile of a row as canonical JSON: fields and the keys of nested objects in order of name at any depth. A column of
    text that is a JSON object or list counts as one."""
    kinds = {f.name: f.dataType.typeName() for f in rows.schema.fields}

    def value(c: str) -> Column:
        whole = F.variant_get(F.parse_json(F.to_json(F.array(c), {"ignoreNullFields": "false"})), "$[0]", "variant")
        nested = F.when(F.trim(F.col(c)).rlike(r"^[\[{]"), F.try_parse_json(F.col(c))) if kinds[c] == "string" else F.lit(None)
        return F.coalesce(nested, whole).alias(c)

    return F.to_json(F.struct(*[value(c) for c in sorted(profile)]), {"ignoreNullFields": "false"})


def identical(rows: DataFrame, name: str, *profile: str) -> DataFrame:
    """(key, n, names): rows of equal profile, see ``profile_key``."""
    return rows.withColumn("key", profile_key(rows, *profile)).groupBy("key").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(name)).alias("names"))


def members(rows: DataFrame, name: str, *profile: str) -> DataFrame:
    """(key, name, n) of every row: as ``identical``, for groups too large for a row of their own."""
    keyed = rows.withColumn("key", profile_key(rows, *profile))
    return keyed.join(keyed.groupBy("key").agg(F.count("*").alias("n")), "key").select("key", name, "n")


def metric_block(items: DataFrame, scope: list[str], name: str, *value: str) -> DataFrame:
    """(scope, items_grouped, num_items, zero_items, dynamic_items): of the named items of each metric those with the same values
    together, as an array of structs names, value in order of the first name; the lists, in order, only where a metric has several
    items. Values are rounded first; ``signal`` among them tells the two lists."""
    own = round_columns(items.select(*scope, name, *value))
    same = own.withColumn("key", profile_key(own, *value)).groupBy(*scope, "key").agg(F.sort_array(F.collect_list(name)).alias("names"), F.first(F.struct(*value)).alias("value"))
    grouped = same.groupBy(*scope).agg(F.array_sort(F.collect_list(F.struct("names", "value"))).alias("items_grouped"))
    listed = lambda word: F.sort_array(F.collect_list(F.when(F.col("signal") == word, F.col(name))))
    counts = own.groupBy(*scope).agg(F.count("*").alias("num_items"), listed("zero").alias("zero_items"), listed("dynamic").alias("dynamic_items"))
    many = lambda c: F.when(F.col("num_items") > 1, F.col(c)).alias(c)
    return grouped.join(counts, scope).select(*scope, "items_grouped", "num_items", many("zero_items"), many("dynamic_items"))


def port_groups(entries: Column) -> Column:
    """Ports of one profile (structs port, protocol, name): one entry for each protocol and name, with its ports in order."""
    kinds = F.array_sort(F.array_distinct(F.transform(entries, lambda p: F.struct(p["protocol"], p["name"]))))
    same = lambda k: F.filter(entries, lambda p: p["protocol"].eqNullSafe(k["protocol"]) & p["name"].eqNullSafe(k["name"]))
    return F.transform(kinds, lambda k: F.struct(k["protocol"], k["name"], F.array_sort(F.array_distinct(F.transform(same(k), lambda p: p["port"]))).alias("ports")))


def normalized_profiles(rows: DataFrame, *port_columns: str) -> DataFrame:
    """System profiles with their lists of ports grouped, see ``port_groups``, and all numbers rounded, at any depth."""
    return round_columns(rows.withColumns({c: port_groups(F.col(c)) for c in port_columns}))


def ports(rows: DataFrame) -> DataFrame:
    return rows.groupBy("protocol", "name").agg(F.sort_array(F.collect_set("port")).alias("ports"))


def compact(items: Column, most: int = 10) -> Column:
    """A list cut to its first entries, with whether it was cut and how long it is; null counts as empty."""
    own = F.coalesce(items, F.array().cast("array<string>"))
    return F.struct(F.slice(own, 1, most).alias("items"), (F.size(own) > most).alias("truncated"), F.size(own).alias("total_count"))


def coverage(tuples: DataFrame) -> DataFrame:
    return tuples.groupBy("app", "task", "fault_family").agg(F.count("*").alias("n"))


def complexity(edges: DataFrame) -> DataFrame:
    """Services, edges and edges by criticality of a scenario, from edges with a column criticality."""
    n = lambda word: F.count_if(F.col("criticality") == word)
    return edges.groupBy("scenario_id").agg(F.count_distinct(F.col("dst")).alias("num_called"), F.count("*").alias("num_edges"), n("critical").alias("num_critical_edges"), n("important").alias("num_important_edges"))


def complexity_report(edges: DataFrame, services: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``complexity`` of every scenario with services (scenario_id, service) or edges: with all its services, called or
    not, and how many snapshots (scenario_id, snapshot) there are of it; several are a series."""
    known = services.select("scenario_id", "service").unionByName(edges.select("scenario_id", F.explode(F.array("src", "dst")).alias("service"))).where("service is not null")
    made = known.groupBy("scenario_id").agg(F.count_distinct(F.col("service")).alias("num_services")).join(complexity(edges).drop("num_called"), "scenario_id", "left")
    seen = snapshots.groupBy("scenario_id").agg(F.count_distinct(F.col("snapshot")).alias("num_snapshots"))
    return made.join(seen, "scenario_id", "left").fillna(0).withColumn("state_is_time_series", F.col("num_snapshots") > 1)
