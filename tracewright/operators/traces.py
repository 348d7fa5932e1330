"""Spans to call edges, service summaries, workload, fan-in and fan-out.

Spans have (scenario_id, path, row_no, trace_id, span_id, parent_span, service, operation, duration_us,
response, is_error). Every grouping and join has the scenario in its key, so many scenarios are one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import rules
from tracewright.functions.storage import stored

FILE = ["scenario_id", "path"]


def last_spans(spans: DataFrame) -> DataFrame:
    """Of spans with one (trace, span) id in a file the last row stays."""
    # a rank with a filter would sort all rows of a task ahead of the shuffle, too, where hardly one falls away
    later = F.lead(F.lit(True)).over(Window.partitionBy(*FILE, "trace_id", "span_id").orderBy("row_no"))
    return spans.withColumn("_later", later).where("_later is null").drop("_later")


def linked(spans: DataFrame) -> DataFrame:
    """Each span with the service of its parent as ``src``; without a parent in its file ``ROOT``."""
    named = spans.where("trace_id is not null and span_id is not null")
    parents = last_spans(named).select(*FILE, "trace_id", F.col("span_id").alias("parent_span"), F.col("service").alias("src"))
    return spans.join(parents, [*FILE, "trace_id", "parent_span"], "left").withColumn("src", F.coalesce("src", F.lit("ROOT"))).withColumnRenamed("service", "dst")


def quantiles(rows: DataFrame, keys: list[str], value: str, probs: list[float], accuracy: int = 2000) -> DataFrame:
    """(keys, q0, q1, ..): for each probability the exact percentile of the non-null values of a key, between neighbours
    linearly, as Spark's ``percentile`` gives it.

    First a mergeable sketch with a rank error of one in ``accuracy`` bounds each percentile from both sides, and then the
    values below the lower bound are counted and those between the bounds are told apart. So of a key with very
    many rows no more than a few thousandths are ever ordered, besides counts: no task holds all its values.
    """
    own = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    slack = 3.0 / accuracy
    marks = [x for p in probs for x in (max(0.0, p - slack), min(1.0, p + slack))]
    sketch = own.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), F.percentile_approx("_v", F.array(*[F.lit(m) for m in marks]), accuracy).alias("_m"))
    few = F.col("_n") <= accuracy  # then the bounds are the ends
    mark = lambda k, end: F.when(few, F.col(end)).otherwise(F.get("_m", F.lit(k)))
    spans = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(p)).alias("p"), mark(2 * k, "_least").alias("low"), mark(2 * k + 1, "_most").alias("high")) for k, p in enumerate(probs)])
    bounds = stored(sketch.select(*keys, "_n", spans.alias("_s")))
    near = own.join(bounds, keys)
    v = F.col("_v")
    sides = [f"_side{k}" for k in range(len(probs))]  # of a value: 0 below the lower bound, 1 between both, 2 above
    side = lambda x: F.when(v < x["low"], 0).when(v <= x["high"], 1).otherwise(2)
    near = near.select(*keys, "_v", *[side(F.col("_s")[k]).alias(s) for k, s in enumerate(sides)])
    between = F.when(F.least(*[F.abs(F.col(s) - 1) for s in [*sides, sides[0]]]) == 0, v)
    counted = near.groupBy(*keys, *sides, between.alias("_b")).agg(F.count("*").alias("_n"))
    each = F.array(*[F.when(F.col(s) < 2, F.struct(F.lit(k).alias("k"), F.when(F.col(s) == 1, F.col("_b")).alias("v"))) for k, s in enumerate(sides)])
    told = counted.select(*keys, "_n", F.explode(each).alias("_t")).where("_t is not null").groupBy(*keys, F.col("_t.k").alias("_q"), F.col("_t.v").alias("_v")).agg(F.sum("_n").alias("_c"))
    upto = Window.partitionBy(*keys, "_q").orderBy(F.col("_v").asc_nulls_first())  # values below the lower bound come first, as one
    wanted = bounds.select(*keys, "_n", F.explode("_s").alias("_x")).select(*keys, F.col("_x.k").alias("_q"), (F.col("_x.p") * (F.col("_n") - 1)).alias("_at"))
    ranked = told.withColumn("_last", F.sum("_c").over(upto) - 1).join(wanted, [*keys, "_q"])  # the number, from 0, of a value's last row
    value_at = lambda place: F.min(F.when(F.col("_last") >= place, F.col("_v")))
    found = ranked.groupBy(*keys, "_q").agg(F.max("_at").alias("_at"), value_at(F.floor("_at")).alias("_a"), value_at(F.ceil("_at")).alias("_b"))
    at = F.col("_at")
    between = F.col("_a") * (F.floor(at) + 1 - at) + F.col("_b") * (at - F.floor(at))
    exact = F.when(F.floor(at) == F.ceil(at), F.col("_a")).otherwise(between)
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_q") == k, exact)).alias(f"q{k}") for k in range(len(probs))])


def _features() -> list:
    ratio = F.avg(F.col("is_error").cast("double"))
    return [F.count("*").alias("num_requests"), F.count_if("is_error").alias("num_errors"), ratio.alias("error_ratio"), F.avg("duration_us").alias("latency_mean_us"), F.max("duration_us").alias("latency_max_us")]


def judged(edges: DataFrame) -> DataFrame:
    er, p95 = F.col("error_ratio"), F.col("latency_p95_us")
    return edges.withColumn("is_suspicious", rules.suspicious(er, p95)).withColumn("failure_type", rules.failure_class(er, p95)).withColumn("edge_score", rules.edge_score(er, p95))


WHOLE = 100_000  # calls of an edge whose durations one aggregate may hold


def call_edges(spans: DataFrame, by_file: bool = False, whole: int = WHOLE) -> DataFrame:
    """Exact edge statistics over all spans of a scenario, or of each file. The spans are linked once and written. An
    edge with more than ``whole`` calls gets its percentiles from ``quantiles``, so it costs a task no more memory than others."""
    keys = [*(FILE if by_file else FILE[:1]), "src", "dst"]
    own = stored(linked(spans).select(*FILE, "src", "dst", "trace_id", "duration_us", "is_error"))
    p, probs = F.percentile("duration_us", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))), [0.5, 0.95, 0.99]
    totals = stored(own.groupBy(*keys).agg(*_features()))
    hot = totals.where(F.col("num_requests") > whole).select(*keys)
    few = own.join(hot, keys, "left_anti").groupBy(*keys).agg(p.alias("_p"))
    if not hot.isEmpty():
        few = few.union(quantiles(own.join(hot, keys, "left_semi"), keys, "duration_us", probs).select(*keys, F.array("q0", "q1", "q2").alias("_p")))
    made = totals.join(few, keys, "left")
    if not by_file:
        made = made.join(own.groupBy(*keys, "trace_id").agg(F.lit(1).alias("one")).groupBy(*keys).agg(F.count("*").alias("num_traces")), keys)
    made = made.withColumns({f"latency_p{n}_us": F.coalesce(F.col("_p")[i], F.lit(0.0)) for i, n in enumerate((50, 95, 99))}).drop("_p")
    return judged(made)


def merged_edges(spans: DataFrame) -> DataFrame:
    """Edges merged from the per-file summaries, as percentiles of the files' five figures without zeros.

    Kept for results that must equal the summaries' merge; ``call_edges`` is the exact form.
    """
    files = call_edges(spans, by_file=True)
    five = F.explode(F.filter(F.array("latency_mean_us", "latency_p50_us", "latency_p95_us", "latency_p99_us", "latency_max_us"), lambda v: v != 0))
    keys = ["scenario_id", "src", "dst"]
    totals = files.groupBy(*keys).agg(F.sum("num_requests").alias("num_requests"), F.sum("num_errors").alias("num_errors"))
    figures = files.select(*keys, five.alias("v")).groupBy(*keys).agg(F.avg("v").alias("latency_mean_us"), F.percentile("v", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("_p"), F.max("v").alias("latency_max_us"))
    made = totals.join(figures, keys, "left").withColumn("error_ratio", F.col("num_errors") / F.col("num_requests"))
    return judged(made.withColumns({f"latency_p{n}_us": F.coalesce(F.col("_p")[i], F.lit(0.0)) for i, n in enumerate((50, 95, 99))}).drop("_p"))


def top_values(spans: DataFrame, keys: list[str], column: str, most: int = 10) -> DataFrame:
    """The most frequent values of a column of the linked spans for each key, with counts; ties by value."""
    return top_of(linked(spans), keys, column, most)


def top_of(rows: DataFrame, keys: list[str], column: str, most: int = 10) -> DataFrame:
    counted = rows.groupBy(*keys, column).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy(F.col("n").desc(), column)
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def edge_details(spans: DataFrame, most: int = 10, examples: int = 5) -> DataFrame:
    """(scenario_id, src, dst, top_operations, responses, example_error_spans): the most frequent values with counts, ties
    by value, and the first error spans in read order."""
    own, keys = linked(spans), ["scenario_id", "src", "dst"]
    each = own.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(F.col(k), F.lit("")).alias("value")) for k in ("operation", "response")])).alias("f"))
    order = Window.partitionBy(*keys, "kind").orderBy(F.desc("n"), "value")
    counted = each.groupBy(*keys, "f.kind", "f.value").agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    listed = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", "value", "n")))), lambda x: F.struct(x["value"], x["n"]))
    tops = counted.groupBy(*keys).agg(listed("operation").alias("top_operations"), listed("response").alias("responses"))
    first = Window.partitionBy(*keys).orderBy("path", "row_no")
    bad = own.where("is_error").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= examples)
    span = F.struct("_n", "trace_id", "span_id", F.col("dst").alias("service"), "operation", "response", "duration_us")
    return tops.join(bad.groupBy(*keys).agg(F.array_sort(F.collect_list(span)).alias("example_error_spans")), keys, "left")


def summary(edges: DataFrame, most: int = 10) -> DataFrame:
    """One row a scenario: edges with errors (by the ratio rounded to four digits), slow ones (p95 over 100 ms), and
    those with the highest scores; ties by name."""
    edge = F.concat_ws("->", "src", "dst")
    listed = lambda hit: F.sort_array(F.collect_list(F.when(hit, edge)))
    ranked = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.round("edge_score", 4)).alias("s"), edge.alias("e")))), 1, most), lambda x: x["e"])
    return edges.groupBy("scenario_id").agg(F.count("*").alias("num_edges"), listed((F.col("num_errors") > 0) | (F.round("error_ratio", 4) > 0)).alias("failed_edges"), listed(F.col("latency_p95_us") > 100000).alias("slow_edges"), ranked.alias("top_edges"))


def datasets(spans: DataFrame) -> DataFrame:
    """(scenario_id, path, rows_seen, num_traces, num_services) of each file."""
    return spans.groupBy(*FILE).agg(F.count("*").alias("rows_seen"), F.count_distinct("trace_id").alias("num_traces"), F.count_distinct("service").alias("num_services"))


def observed(spans: DataFrame) -> DataFrame:
    """(scenario_id, src, dst): the calls of all files, each once."""
    return linked(spans).select("scenario_id", "src", "dst").distinct()


def service_traces(spans: DataFrame) -> DataFrame:
    p95 = F.coalesce(F.percentile("duration_us", F.lit(0.95)), F.lit(0.0))
    return spans.groupBy("scenario_id", "service").agg(F.count("*").alias("num_spans"), F.count_if("is_error").alias("num_errors"), F.avg(F.col("is_error").cast("double")).alias("error_ratio"), F.avg("duration_us").alias("latency_mean_us"), p95.alias("latency_p95_us"), F.max("duration_us").alias("latency_max_us"))


def workload(edges: DataFrame) -> DataFrame:
    """Requests into and out of each service, and both together."""
    both = edges.select("scenario_id", F.col("dst").alias("service"), F.col("num_requests").alias("incoming"), F.lit(0).alias("outgoing")).union(edges.select("scenario_id", "src", F.lit(0), "num_requests"))
    made = both.groupBy("scenario_id", "service").agg(F.sum("incoming").alias("incoming"), F.sum("outgoing").alias("outgoing"))
    return made.withColumn("total", F.col("incoming") + F.col("outgoing"))


def top_edges(edges: DataFrame, most: int = 10) -> DataFrame:
    order = Window.partitionBy("scenario_id").orderBy(F.col("edge_score").desc(), "src", "dst")
    return edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def fan(edges: DataFrame) -> DataFrame:
    both = edges.select("scenario_id", F.col("dst").alias("service"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(edges.select("scenario_id", "src", F.lit(0), F.lit(1)))
    return both.groupBy("scenario_id", "service").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def adjacency(edges: DataFrame) -> DataFrame:
    known = edges.where("src is not null and dst is not null")
    out = known.groupBy("scenario_id", F.col("src").alias("service")).agg(F.sort_array(F.collect_list("dst")).alias("out_neighbours"))
    into = known.groupBy("scenario_id", F.col("dst").alias("service")).agg(F.sort_array(F.collect_list("src")).alias("in_neighbours"))
    return out.join(into, ["scenario_id", "service"], "full_outer")


def preferred_edges(observed: DataFrame, static: DataFrame, traced: DataFrame) -> DataFrame:
    """One row for each edge: observed before static before traced."""
    own = lambda d, k: d.select("scenario_id", "src", "dst").withColumn("priority", F.lit(k))
    made = own(observed, 1).union(own(static, 2)).union(own(traced, 3))
    return made.groupBy("scenario_id", "src", "dst").agg(F.min("priority").alias("priority"))
