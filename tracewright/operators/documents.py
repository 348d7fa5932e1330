"""Documents of any depth: canonical text, rounding, readable rendering, states as VARIANT objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions import rules

# fixed values: the keys of a state that a reader without labels may get
ALLOWED = ["scenario_id", "namespace", "task", "services", "metrics", "logs", "traces", "system", "workload", "graph", "sla", "service_health", "observability_metadata", "model_table", "clusters", "llm_view"]


def canonical(text: Column) -> Column:
    """JSON text with the keys of all objects in order, at any depth, and numbers by value; null where the text isn't JSON, or
    has a key twice in one object."""
    return F.to_json(F.try_parse_json(text))


def rounded_deep(c: Column, kind: T.DataType) -> Column:
    """A value of any type with all its floating-point numbers, at any depth, rounded to four digits; NaN and infinity
    become 0."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return rules.rounded(c.cast("double"))
    if isinstance(kind, T.StructType):
        made = F.struct(*[rounded_deep(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields])
        return F.when(c.isNotNull(), made)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: rounded_deep(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, x: rounded_deep(x, kind.valueType))
    return c


def round_columns(df: DataFrame) -> DataFrame:
    return df.select(*[rounded_deep(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def _scalar(c: Column) -> Column:
    one = F.to_json(F.array(c), {"ignoreNullFields": "false"})
    return F.coalesce(F.substring(one, F.lit(2), F.char_length(one) - 2), F.lit("null"))


def _simple(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.StructType, T.ArrayType, T.MapType))


def rendered(c: Column, kind: T.DataType, level: int = 0, indent: int = 2) -> Column:
    """A value as readable JSON: an object has a line for each key, a list of scalars is one line, any other list has a line
    for each entry. Keys of structs stand in their order, those of maps in order of name; null is null, characters beyond ASCII
    stay as they are."""
    pad, inner = " " * (indent * level), " " * (indent * (level + 1))

    def lines(each: Column, ends: str) -> Column:
        return F.when(F.size(each) == 0, ends).otherwise(F.concat(F.lit(ends[0] + "\n"), F.array_join(each, ",\n"), F.lit("\n" + pad + ends[1])))

    if isinstance(kind, T.StructType):
        each = [F.concat(F.lit(inner), _scalar(F.lit(f.name)), F.lit(": "), rendered(c.getField(f.name), f.dataType, level + 1, indent)) for f in kind.fields]
        made = lines(F.array(*each), "{}") if each else F.lit("{}")
    elif isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(c)) if _simple(kind.valueType) else F.transform(F.array_sort(F.map_keys(c)), lambda k: F.struct(k.alias("key"), F.element_at(c, k).alias("value")))
        made = lines(F.transform(entries, lambda e: F.concat(F.lit(inner), _scalar(e["key"].cast("string")), F.lit(": "), rendered(e["value"], kind.valueType, level + 1, indent))), "{}")
    elif isinstance(kind, T.ArrayType) and _simple(kind.elementType):
        made = F.concat(F.lit("["), F.array_join(F.transform(c, _scalar), ", "), F.lit("]"))
    elif isinstance(kind, T.ArrayType):
        made = lines(F.transform(c, lambda x: F.concat(F.lit(inner), rendered(x, kind.elementType, level + 1, indent))), "[]")
    else:
        return _scalar(c)
    return F.when(c.isNull(), "null").otherwise(made)


def render_rows(df: DataFrame, *columns: str) -> Column:
    """The columns of a table as one readable JSON object a row."""
    kind = T.StructType([f for f in df.schema.fields if f.name in columns])
    return rendered(F.struct(*[f.name for f in kind.fields]), kind)


def _object(d: DataFrame, key: str) -> DataFrame:
    """(scenario_id, v): the rows of a scenario as a JSON object with an entry for each value of ``key``."""
    value = F.to_json(F.struct(*[c for c in d.columns if c not in ("scenario_id", key)]), {"ignoreNullFields": "false"})
    entry = F.concat(F.to_json(F.array(key)).substr(F.lit(2), F.char_length(F.to_json(F.array(key))) - 2), F.lit(":"), value)
    return d.groupBy("scenario_id").agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(entry)), ","), F.lit("}")).alias("v"))


def _list(d: DataFrame) -> DataFrame:
    """The rows of a scenario as a JSON list in the order of their columns; rows of a single column as its values."""
    own = [c for c in d.columns if c != "scenario_id"]
    entry = F.to_json(F.struct(*own), {"ignoreNullFields": "false"}) if len(own) > 1 else F.to_json(F.array(own[0])).substr(F.lit(2), F.char_length(F.to_json(F.array(own[0]))) - 2)
    every = F.array_sort(F.collect_list(F.struct(*own, entry.alias("_entry"))))
    return d.groupBy("scenario_id").agg(F.concat(F.lit("["), F.array_join(F.transform(every, lambda e: e["_entry"]), ","), F.lit("]")).alias("v"))


def state(scenarios: DataFrame, keyed: dict[str, tuple[DataFrame, str]], listed: dict[str, DataFrame], single: dict[str, DataFrame], constants: dict[str, Column]) -> DataFrame:
    """(scenario_id, document): one VARIANT object a scenario.

    ``keyed`` parts are tables that become objects by a column, ``listed`` ones lists, ``single`` ones have one row a
    scenario; a part without rows is empty. Only what is summed up for a scenario comes here: its rows are those of services,
    edges and actions.
    """
    made = scenarios.select("scenario_id").distinct()
    texts = {}
    for name, (d, key) in keyed.items():
        made, texts[name] = made.join(_object(d, key).withColumnRenamed("v", f"_{name}"), "scenario_id", "left"), F.coalesce(f"_{name}", F.lit("{}"))
    for name, d in listed.items():
        made, texts[name] = made.join(_list(d).withColumnRenamed("v", f"_{name}"), "scenario_id", "left"), F.coalesce(f"_{name}", F.lit("[]"))
    for name, d in single.items():
        one = d.select("scenario_id", F.to_json(F.struct(*[c for c in d.columns if c != "scenario_id"]), {"ignoreNullFields": "false"}).alias(f"_{name}"))
        made, texts[name] = made.join(one, "scenario_id", "left"), F.coalesce(f"_{name}", F.lit("{}"))
    for name, c in {"scenario_id": F.col("scenario_id"), **constants}.items():
        texts[name] = _scalar(c)
    body = F.concat_ws(",", *[F.concat(F.lit(f'"{name}":'), text) for name, text in texts.items()])
    return made.select("scenario_id", F.parse_json(F.concat(F.lit("{"), body, F.lit("}"))).alias("document"))


def entries(document: Column) -> Column:
    """The keys of a document with their values, as map<string, variant>; values of any kind stay as they are."""
    return document.cast("map<string,variant>")


def of_entries(m: Column) -> Column:
    return F.call_function("to_variant_object", m)


def replaced(document: Column, **parts: Column) -> Column:
    """The document with other values, VARIANTs, under some keys; all other keys, known or not, stay."""
    kept = F.map_filter(entries(document), lambda k, _: ~k.isin(list(parts)))
    return of_entries(F.map_concat(kept, F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v)])))


def redacted(document: Column) -> Column:
    """Only the keys that a reader without labels may get."""
    return of_entries(F.map_filter(entries(document), lambda k, _: k.isin(ALLOWED)))


def summary(documents: DataFrame) -> DataFrame:
    """One row a scenario, read from its document by path: what it is about, the categories that hold anything, what is suspected
    and how its service levels are."""
    get = lambda path, kind="string": F.try_variant_get("document", path, kind)
    text = lambda path: F.to_json(F.try_variant_get("document", path, "variant"))
    full = lambda k: ~F.coalesce(text(f"$.{k}"), F.lit("{}")).isin("{}", "[]", "null")
    names = ["metrics", "logs", "traces", "system", "workload", "graph", "history"]
    present = F.filter(F.array(*[F.when(full(k), F.lit(k)) for k in names]), lambda k: k.isNotNull())
    services = F.coalesce(get("$.services", "array<string>"), F.array().cast("array<string>"))
    return documents.select(
        "scenario_id", F.lit(1).alias("num_snapshots"), services.alias("services"), F.size(services).alias("num_services"), get("$.fault_context.task").alias("task"), get("$.fault_context.fault_family").alias("fault_family"), get("$.fault_context.faulty_service").alias("faulty_service"),
        F.coalesce(get("$.fault_context.expected_faulty_services", "array<string>"), F.array().cast("array<string>")).alias("expected_faulty_services"), F.coalesce(get("$.fault_context.is_multifault", "boolean"), F.lit(False)).alias("is_multifault"),
        F.size(F.coalesce(get("$.fault_context.fault_instances", "array<variant>"), F.array().cast("array<variant>"))).alias("num_fault_instances"), get("$.fault_context.variant_name").alias("variant_name"), text("$.ground_truth.answer").alias("ground_truth_answer"), present.alias("categories_present"),
        get("$.rca_features.most_suspicious_service").alias("most_suspicious_service"), text("$.rca_features.hypotheses").alias("rca_hypotheses"), get("$.rca_features.confidence", "double").alias("rca_confidence"), get("$.rca_features.dominant_error_family").alias("dominant_error_family"),
        F.coalesce(get("$.rca_features.observability_gaps", "array<string>"), F.array().cast("array<string>")).alias("observability_gaps"), F.coalesce(get("$.sla.violated", "boolean"), F.lit(False)).alias("sla_violated"), F.coalesce(get("$.sla.global_sla.num_unhealthy_services", "bigint"), F.lit(0)).alias("num_unhealthy_services"),
        F.coalesce(get("$.observability_metadata.logs.files_parsed", "bigint"), F.lit(0)).alias("log_files_parsed"), F.coalesce(get("$.observability_metadata.metrics.files_seen", "bigint"), F.lit(0)).alias("metric_files_parsed"), F.coalesce(get("$.observability_metadata.traces.edges_found", "bigint"), F.lit(0)).alias("trace_edges_found"),
    )
