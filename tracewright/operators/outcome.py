"""Rewards, group-relative advantages, symptom overlap, command results, batch figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rewards(pods: DataFrame, missing_pre_is_ready: bool = True) -> DataFrame:
    """From (scenario_id, pod, relevant, pre, post), pre and post null where a snapshot lacks the pod.

    Tracked are relevant pods of the later snapshot; without any pod marked relevant, in either snapshot, all
    pods of the later one give their ready share. Relevant pods that are all gone give 0. A null mark is none.
    """
    relevant = F.coalesce("relevant", F.lit(False))
    pre, post = F.coalesce("pre", F.lit(missing_pre_is_ready)), F.col("post")
    own = relevant & post.isNotNull()
    made = pods.groupBy("scenario_id").agg(
        F.max(relevant).alias("marked"), F.count_if(own).alias("tracked"), F.count_if(own & post).alias("ready"),
        F.count_if(own & post & ~pre).alias("recovered"), F.count_if(own & ~post & pre).alias("regressed"),
        F.avg(post.cast("double")).alias("share"),
    )
    part = F.least(F.lit(1.0), F.col("ready") / F.col("tracked") + F.col("recovered") * 0.1 / F.col("tracked"))
    reward = F.when(~F.col("marked"), F.coalesce("share", F.lit(0.0))).when(F.col("tracked") == 0, 0.0).when(F.col("ready") == F.col("tracked"), 1.0).otherwise(part)
    return made.select("scenario_id", "tracked", "ready", "recovered", "regressed", reward.alias("reward"))


def advantages(samples: DataFrame, least: float = 1e-6) -> DataFrame:
    """(reward - mean) / max(population deviation, least) in each group; 0 for a group of one."""
    w = Window.partitionBy("group_id")
    z = (F.col("reward") - F.avg("reward").over(w)) / F.greatest(F.stddev_pop("reward").over(w), F.lit(least))
    return samples.withColumn("advantage", F.when(F.count("*").over(w) > 1, z).otherwise(0.0))


def batch_normal(samples: DataFrame, least: float = 1e-6) -> DataFrame:
    """Advantages over the whole batch; figures come from one aggregate row, not from a window without a key."""
    figures = samples.agg(F.avg("advantage").alias("_m"), F.stddev_pop("advantage").alias("_s"))
    return samples.join(F.broadcast(figures)).withColumn("advantage", (F.col("advantage") - F.col("_m")) / F.greatest("_s", F.lit(least))).drop("_m", "_s")


def best_iteration(rows: DataFrame) -> DataFrame:
    """The iteration of highest reward above 0, the first of equals."""
    return rows.where("reward > 0").groupBy("scenario_id").agg(F.max_by("iteration", F.struct("reward", -F.col("iteration"))).alias("iteration"), F.max("reward").alias("reward"))


def overlap(original: DataFrame, observed: DataFrame, threshold: float = 0.5, causes: DataFrame | None = None) -> DataFrame:
    """One row a scenario: the share of the original unhealthy services met by an observed one of the same name or one that contains it
    or is contained in it, the missing and extra ones, and whether that, or the root cause (scenario_id, root_cause) being among the
    observed, verifies the diagnosis. Without original services the score is 1 if none is observed, else 0.5. An empty root
    cause is met by none. Names are few in a scenario, so the pairs inside one are."""
    alike = lambda a, b: a.contains(b) | b.contains(a)
    o, d = original.select("scenario_id", "service").distinct(), observed.select("scenario_id", F.col("service").alias("other")).where("other <> '' and other <> 'unknown'").distinct()
    met = o.join(d, (o["scenario_id"] == d["scenario_id"]) & alike(F.col("service"), F.col("other")), "left_semi").withColumn("met", F.lit(True))
    own = o.join(met, ["scenario_id", "service"], "left").groupBy("scenario_id").agg(F.count("*").alias("original"), F.count("met").alias("matched"), F.sort_array(F.collect_list(F.when(F.col("met").isNull(), F.col("service")))).alias("missing"))
    extra = d.withColumnRenamed("other", "service").join(met.select("scenario_id", "service"), ["scenario_id", "service"], "left_anti")
    seen = d.groupBy("scenario_id").agg(F.count("*").alias("observed")).join(extra.groupBy("scenario_id").agg(F.sort_array(F.collect_list("service")).alias("extra")), "scenario_id", "left")
    made = own.join(seen, "scenario_id", "full_outer").fillna({"original": 0, "matched": 0, "observed": 0})
    if causes is None:
        made = made.withColumn("root_cause_degraded", F.lit(False)).withColumn("root_cause", F.lit(""))
    else:
        r = causes.select("scenario_id", "root_cause").where("root_cause <> ''").distinct()
        hit = r.join(d, (r["scenario_id"] == d["scenario_id"]) & alike(F.col("root_cause"), F.col("other")), "left_semi").withColumn("_hit", F.lit(True))
        every = causes.select("scenario_id", "root_cause").distinct().join(hit, ["scenario_id", "root_cause"], "left")
        made = made.join(every, "scenario_id", "full_outer").fillna({"original": 0, "matched": 0, "observed": 0}).withColumn("root_cause_degraded", F.coalesce("_hit", F.lit(False))).drop("_hit")
    score = F.when(F.col("original") > 0, F.col("matched") / F.col("original")).otherwise(F.when(F.col("observed") == 0, 1.0).otherwise(0.5))
    none = F.array().cast("array<string>")
    return made.withColumns({"missing": F.coalesce("missing", none), "extra": F.coalesce("extra", none), "score": score}).withColumn("verified", F.col("root_cause_degraded") | (F.col("score") >= threshold))


def reasoning(verified: DataFrame, most: int = 5) -> DataFrame:
    """(scenario_id, reasoning): the result of ``overlap`` in words."""
    word = lambda c: F.when(F.col(c), "True").otherwise("False")
    names = lambda c: F.concat(F.lit("['"), F.array_join(c, "', '"), F.lit("']"))
    told = [
        F.concat(F.lit("Verified: "), word("verified")),
        F.concat(F.lit("Root cause service '"), F.coalesce("root_cause", F.lit("")), F.lit("' degraded in twin: "), word("root_cause_degraded")),
        F.format_string("Symptom overlap: %d/%d originally-unhealthy services appear degraded in twin (score=%.2f)", "matched", "original", "score"),
        F.when(F.size("missing") > 0, F.concat(F.lit("Missing from twin: "), names("missing"))),
        F.when(F.size("extra") > 0, F.concat(F.lit("Extra degraded in twin (not in original): "), names(F.slice("extra", 1, most)))),
    ]
    return verified.select("scenario_id", F.concat_ws("  |  ", *told).alias("reasoning"))


def execution(results: DataFrame, health: DataFrame | None = None) -> DataFrame:
    """Commands run and done well per scenario; with pod health (scenario_id, pre, post) also how many pods were ready."""
    made = results.groupBy("scenario_id").agg(F.count("*").alias("commands_run"), F.count_if(F.expr("returncode = 0")).alias("commands_ok"))
    if health is None:
        return made
    ready = health.groupBy("scenario_id").agg(F.count_if("pre").alias("pre_healthy"), F.count_if("post").alias("post_healthy"))
    return made.join(ready, "scenario_id", "full_outer").fillna(0)


def command_rows(results: DataFrame, most: int = 500, extra: tuple[str, ...] = ()) -> DataFrame:
    """Results of commands as they are kept: outputs cut, times rounded."""
    return results.select("scenario_id", *extra, "command", F.substring("stdout", 1, most).alias("stdout"), F.substring("stderr", 1, most).alias("stderr"), "returncode", F.round("elapsed_ms", 1).alias("elapsed_ms"), (F.col("returncode") == 0).alias("ok"))


def scenario_rows(iterations: DataFrame) -> DataFrame:
    """One row a scenario from (scenario_id, iteration, reward, passed, elapsed): how often, how well and how long."""
    return iterations.groupBy("scenario_id").agg(F.max("passed").alias("passed"), F.round(F.greatest(F.lit(0.0), F.max("reward")), 4).alias("best_reward"), F.count("*").alias("n_iterations"), F.round(F.sum("elapsed"), 2).alias("elapsed_seconds"))


def iteration_rows(iterations: DataFrame, results: DataFrame) -> DataFrame:
    """One row an iteration with its commands and their results in order of ``no``, from (scenario_id, iteration, reward, passed,
    elapsed) and results of commands (scenario_id, iteration, no, ..), see ``command_rows``. An iteration without commands has
    empty lists; results of an iteration that isn't there are left out. Lists are as long as one reply of a model."""
    keys = ["scenario_id", "iteration"]
    kept = command_rows(results, extra=("iteration", "no"))
    told = [c for c in kept.columns if c not in (*keys, "no")]
    listed = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("no", *told))).alias("_r"))
    made = iterations.join(listed, keys, "left").withColumn("_r", F.coalesce("_r", F.array().cast(listed.schema["_r"].dataType)))
    return made.select(*keys, F.transform("_r", lambda x: x["command"]).alias("commands"), F.round("reward", 4).alias("reward"), "passed", F.round("elapsed", 2).alias("elapsed_seconds"), F.transform("_r", lambda x: x.dropFields("no")).alias("command_results"))


def scenario_results(scenarios: DataFrame, rows: DataFrame, iterations: DataFrame, verified: DataFrame, errors: DataFrame) -> DataFrame:
    """The whole result of every scenario: how it ended, the commands of the iteration of highest reward above 0 (the first of
    equals), whether its diagnosis was verified, and all its iterations in order.

    ``rows`` are what ``iteration_rows`` makes of ``iterations``, whose unrounded rewards decide. A scenario with an error
    (scenario_id, error, elapsed) has no iterations and no reward, whatever else is known of it; one without anything has none either.
    """
    best = best_iteration(iterations).select("scenario_id", "iteration").join(rows.select("scenario_id", "iteration", F.col("commands").alias("best_commands")), ["scenario_id", "iteration"]).drop("iteration")
    own = [c for c in rows.columns if c not in ("scenario_id", "iteration")]
    every = rows.groupBy("scenario_id").agg(F.array_sort(F.collect_list(F.struct("iteration", *own))).alias("iterations"))
    made = scenarios.select("scenario_id").distinct()
    for d in (scenario_rows(iterations), best, every, verified.select("scenario_id", F.col("verified").alias("rca_verified")), errors.select("scenario_id", "error", F.col("elapsed").alias("_elapsed"))):
        made = made.join(d, "scenario_id", "left")
    failed = F.col("error").isNotNull()
    none = {"passed": F.lit(False), "best_reward": F.lit(0.0), "n_iterations": F.lit(0).cast("bigint"), "rca_verified": F.lit(False), "best_commands": F.array().cast("array<string>"), "iterations": F.array().cast(made.schema["iterations"].dataType)}
    told = [F.when(failed, zero).otherwise(F.coalesce(c, zero)).alias(c) for c, zero in none.items()]
    elapsed = F.coalesce(F.when(failed, F.round("_elapsed", 2)).otherwise(F.col("elapsed_seconds")), F.lit(0.0))
    return made.select("scenario_id", *told, elapsed.alias("elapsed_seconds"), F.coalesce("error", F.lit("")).alias("error"))


def verification_rows(found: DataFrame, original: DataFrame, observed: DataFrame, waits: DataFrame) -> DataFrame:
    """What is kept of ``overlap``'s result ``found``: the names on both sides and those that met, the score rounded, the seconds
    waited (scenario_id, wait_seconds; 0 if unknown), and the words of ``reasoning``."""
    names = lambda d, name: d.groupBy("scenario_id").agg(F.sort_array(F.collect_set("service")).alias(name))
    made = found.join(reasoning(found), "scenario_id").join(waits.select("scenario_id", "wait_seconds"), "scenario_id", "left")
    made = made.join(names(original, "original_unhealthy"), "scenario_id", "left").join(names(observed.where("service <> '' and service <> 'unknown'"), "twin_degraded_services"), "scenario_id", "left")
    listed = {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("original_unhealthy", "twin_degraded_services")}
    made = made.withColumns(listed).withColumn("overlap", F.array_except("original_unhealthy", "missing"))
    return made.select("scenario_id", "verified", F.round("score", 3).alias("match_score"), "root_cause_degraded", *listed, "overlap", F.coalesce("wait_seconds", F.lit(0.0)).alias("wait_seconds"), "reasoning")


def outcome_rows(scenarios: DataFrame, errors: DataFrame, tops: DataFrame, sla: DataFrame) -> DataFrame:
    """(scenario_id, ok, error, top_service, sla_violated) of every scenario, also of one that failed."""
    made = scenarios.select("scenario_id").distinct().join(errors.select("scenario_id", "error"), "scenario_id", "left").join(tops.select("scenario_id", "top_service"), "scenario_id", "left").join(sla.select("scenario_id", F.col("violated").alias("sla_violated")), "scenario_id", "left")
    ok = F.col("error").isNull()
    return made.select("scenario_id", ok.alias("ok"), "error", F.when(ok, F.col("top_service")).alias("top_service"), F.when(ok, F.coalesce("sla_violated", F.lit(False))).alias("sla_violated"))


def run_log(outcomes: DataFrame) -> DataFrame:
    """(total, passed, failed, lines): one row, with a line for each scenario."""
    line = F.when(F.col("ok"), F.format_string("[PASS] %s  rca=%s  sla_violated=%s", "scenario_id", F.coalesce("top_service", F.lit("None")), F.col("sla_violated").cast("string"))).otherwise(F.format_string("[FAIL] %s  error=%s", "scenario_id", F.substring("error", 1, 80)))
    return outcomes.agg(F.count("*").alias("total"), F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"), F.array_sort(F.collect_list(line)).alias("lines"))


def batch_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("total"), F.count_if(F.expr("reward >= 1")).alias("passed"), F.avg("reward").alias("mean_reward"))


def unfinished(scenarios: DataFrame, done: DataFrame, most: int | None = None) -> DataFrame:
    """Scenarios without a result; only the first of them by id where a number is given."""
    left = scenarios.join(done.select("scenario_id"), "scenario_id", "left_anti")
    return left if most is None else left.orderBy("scenario_id").limit(most)


def breakdown(pods: DataFrame) -> DataFrame:
    """Sorted pod names behind a reward, from the rows that ``rewards`` takes: the tracked ones (relevant and in the
    later snapshot), those ready before and after, newly recovered, regressed. Here a pod that the earlier
    snapshot lacks wasn't ready."""
    pre, post = F.coalesce("pre", F.lit(False)), F.col("post")
    rows = pods.where("relevant and post is not null")
    names = lambda cond, name: F.sort_array(F.collect_set(F.when(cond, F.col("pod")))).alias(name)
    return rows.groupBy("scenario_id").agg(names(F.lit(True), "tracked"), names(pre, "pre_ready"), names(post, "post_ready"), names(post & ~pre, "recovered"), names(pre & ~post, "regressed"), F.count("*").alias("n_tracked"), F.count_if(pre).alias("n_pre_ready"), F.count_if(post).alias("n_post_ready"), F.count_if(post & ~pre).alias("n_recovered"), F.count_if(pre & ~post).alias("n_regressed"))


def buffered(samples: DataFrame, least: int = 2, key_chars: int = 200) -> DataFrame:
    """Training samples (batch_id, group_id, prompt, ...) of batches with at least ``least`` rows. A sample without
    a group belongs to the group of its prompt's first characters."""
    keyed = samples.withColumn("group_id", F.coalesce("group_id", F.substring("prompt", 1, key_chars)))
    full = samples.groupBy("batch_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("batch_id")
    return keyed.join(full, "batch_id", "left_semi")
