"""Service names from pod, file, class and store names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: endings of files, stores and classes that a name loses, suffixes of replicas, hints in outputs
FILE_ENDINGS = ["log", "stderr", "txt", "json", "csv"]
LOG_ENDING = r"\.(log|stderr|txt)$"
SHARED_REPLICA = r"-[a-f0-9]{6,12}-[a-z0-9]{4,6}$"
LOG_REPLICA = r"-[a-f0-9]{8,10}-[a-z0-9]{4,6}$"
METRIC_REPLICA = r"-[a-f0-9]{8,10}-[a-z0-9]{5}$"
REPLICA_SET = r"-[a-f0-9]{8,10}$"
SOURCE_ENDING = r"\.(cpp|cc|cxx|h|hpp|py|java|go|rs)$"
CLASS_ENDING = r"(Handler|Controller|Main)$"
STORE_ENDING = r"-(mongodb|mongo|redis|memcached|postgres|postgresql|mysql|db|database|cache)$"
OUTPUT_HINTS = {"prefix": r"^\[pod/[^/\]]+/([^/\]]+)\]", "source": r"\(([A-Za-z0-9_./-]+):\d+:[^)]+\)", "target": r"'([a-zA-Z0-9\-]+):\d+'"}


def _or_unknown(name: Column) -> Column:
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("unknown")).otherwise(name)


def _base(name: Column) -> Column:
    """Last part of a path, without a cluster node in front of it."""
    last = F.regexp_extract(F.trim(name), r"([^/]*)/*$", 1)
    return F.when(last.startswith("kind-") & last.contains("."), F.regexp_replace(last, r"^[^.]*\.", "")).otherwise(last)


def shared_service(name: Column) -> Column:
    """Every known extension in turn, then one replica suffix of 6 to 12 and 4 to 6 characters."""
    out = _base(name)
    for ending in FILE_ENDINGS:
        out = F.regexp_replace(out, rf"\.{ending}$", "")
    return _or_unknown(F.regexp_replace(out, SHARED_REPLICA, ""))


def log_service(name: Column) -> Column:
    """One log extension, then a replica suffix of 8 to 10 characters, then a lone replica-set hash."""
    out = F.regexp_replace(_base(name), LOG_ENDING, "")
    out = F.regexp_replace(out, LOG_REPLICA, "")
    return _or_unknown(F.regexp_replace(out, REPLICA_SET, ""))


def metric_service(name: Column) -> Column:
    """The part behind the first dot, without pod suffix and replica-set hash."""
    out = F.regexp_replace(F.trim(name), r"^[^.]*\.", "")
    out = F.regexp_replace(out, METRIC_REPLICA, "")
    return F.regexp_replace(out, REPLICA_SET, "")


def class_service(name: Column) -> Column:
    """A source file or class in camel case to a name with hyphens."""
    out = F.regexp_replace(F.regexp_extract(F.trim(name), r"([^/]*)/*$", 1), SOURCE_ENDING, "")
    out = F.regexp_replace(out, CLASS_ENDING, "")
    out = F.regexp_replace(F.regexp_replace(out, r"(.)([A-Z][a-z]+)", "$1-$2"), r"([a-z0-9])([A-Z])", "$1-$2")
    return _or_unknown(F.lower(out))


def client_of_store(target: Column) -> Column:
    """The service that uses a store, by the store's ending."""
    return F.regexp_replace(log_service(target), STORE_ENDING, "-service")


def file_service(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(name.startswith("step_") & name.contains("get_logs"), F.lit("unknown")).otherwise(log_service(name))


def line_hints(line: Column) -> Column:
    """What a line of a log query's output tells of its service, each null where it tells nothing: struct(prefix, source,
    host, target)."""
    part = lambda pattern: F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))
    field = lambda p: F.nullif(F.get_json_object(line, p), F.lit(""))
    host = F.when(F.trim(line).startswith("{"), F.coalesce(field("$.attr.host"), field("$.attr.doc.application.name")))
    return F.struct(part(OUTPUT_HINTS["prefix"]).alias("prefix"), part(OUTPUT_HINTS["source"]).alias("source"), host.alias("host"), part(OUTPUT_HINTS["target"]).alias("target"))


def hinted_service(hints: Column, path: Column) -> Column:
    """The service by the first hint there is, in this order: pod prefix, C++ source file, host, quoted target; else by the file's name."""
    h = hints
    return F.when(h["prefix"].isNotNull(), log_service(h["prefix"])).when(h["source"].isNotNull(), class_service(h["source"])).when(h["host"].isNotNull(), log_service(h["host"])).when(h["target"].isNotNull(), client_of_store(h["target"])).otherwise(file_service(path))


def service_of_output(content: Column, path: Column) -> Column:
    """The service whose lines the output of a log query holds, of each hint the first one in the text."""
    each = F.transform(F.split(content, r"\r?\n"), line_hints)
    first = lambda name: F.get(F.filter(F.transform(each, lambda h: h[name]), lambda x: x.isNotNull()), F.lit(0)).alias(name)
    return hinted_service(F.struct(*[first(n) for n in (*OUTPUT_HINTS, "host")]), path)
