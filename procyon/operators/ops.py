"""Operations analytics: runs, health, schedules, recovery, verification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import SCHEDULABLE
from ..sources.state import materialise
from .query import top_k_per_group

BACKOFF = {"HEALTHY": 1, "UNKNOWN": 1, "DEGRADED": 2, "FAILING": 4, "OFFLINE": 12}
LIVE = ("QUEUED", "RUNNING", "RETRYING")


def _at(as_of: str) -> Column:
    return F.to_timestamp_ntz(F.lit(as_of))


def _hours(n: float) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(int(n * 60)))


def health_of(failures: Column) -> Column:
    return F.when(failures >= 10, "OFFLINE").when(failures >= 4, "FAILING").when(failures >= 1, "DEGRADED").otherwise("HEALTHY")


def run_status(runs: DataFrame, errors: DataFrame) -> DataFrame:
    """(id, succeeded, n_errors, first_error): fatal errors fail a run, as do errors without any item."""
    e = errors.groupBy("run_id").agg(F.count("*").alias("n_errors"), F.bool_or(F.col("stage").isin("DISCOVERY", "UNKNOWN")).alias("fatal"), F.min_by(F.concat_ws(": ", "code", "message"), F.struct("created_at", "id")).alias("first_error"))
    out = runs.join(e, runs["id"] == e["run_id"], "left")
    return out.select("id", (~F.coalesce("fatal", F.lit(False)) & ((F.col("items_found") > 0) | F.col("n_errors").isNull())).alias("succeeded"), F.coalesce("n_errors", F.lit(0)).alias("n_errors"), "first_error")


def run_verdict(runs: DataFrame, errors: DataFrame) -> DataFrame:
    """(id, verdict, reason) as an operator reads a run."""
    text = F.concat_ws(": ", "code", "message")
    first = F.struct("created_at", F.col("id"))
    e = errors.groupBy("run_id").agg(F.min_by(text, first).alias("first"), F.min_by(F.when(F.col("stage").isin("DISCOVERY", "FETCH"), text), F.when(F.col("stage").isin("DISCOVERY", "FETCH"), first)).alias("fatal"))
    out = runs.join(e, runs["id"] == e["run_id"], "left")
    none, failed = F.col("items_found") == 0, F.col("status") == "FAILED"
    kept = F.col("items_created") + F.col("items_updated")
    verdict = F.when(F.col("status") == "RUNNING", "RUNNING").when(none & F.col("fatal").isNotNull(), "UNREACHABLE").when(none, "EMPTY").when(failed & (kept > 0), "PARTIAL").when(failed, "FAILED").when(F.col("items_failed") + F.col("items_skipped") > 0, "COMPLETED_WITH_ISSUES").otherwise("HEALTHY")
    reason = F.when(verdict == "UNREACHABLE", F.col("fatal")).when(verdict == "FAILED", F.col("first"))
    return out.select("id", verdict.alias("verdict"), reason.alias("reason"))


def never_run(sources: DataFrame, runs: DataFrame) -> DataFrame:
    return sources.join(runs.select(F.col("source_id").alias("id")), "id", "left_anti").select("id", F.lit("NEVER_RUN").alias("verdict"))


def run_report(runs: DataFrame, errors: DataFrame, last: int = 5, most_errors: int = 25) -> DataFrame:
    """The last runs of each source with at most 25 of their newest errors."""
    kept = top_k_per_group(runs, "source_id", [F.col("started_at").desc(), F.col("id").desc()], last)
    e = top_k_per_group(errors, "run_id", [F.col("created_at").desc(), F.col("id").desc()], most_errors).groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("position", "stage", "code", "message"))).alias("errors"))
    return kept.join(e, kept["id"] == e["run_id"], "left").drop("run_id")


def failed_runs(runs: DataFrame, sources: DataFrame, limit: int = 50) -> DataFrame:
    s = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    return runs.where("status = 'FAILED'").join(s, "source_id").orderBy(F.col("started_at").desc(), F.col("id").desc()).limit(limit)


def source_health(runs: DataFrame) -> DataFrame:
    """(source_id, runs, consecutive_failures, health, last_run_at, last_success_at): failures after the last success.

    Only combinable aggregates: the last success is found first, then failures after it are counted.
    """
    ok = F.col("status") != "FAILED"
    place = F.struct("started_at", "id")
    last = runs.where(ok).groupBy("source_id").agg(F.max(place).alias("last_ok"))
    joined = runs.join(last, "source_id", "left")
    after = F.col("last_ok").isNull() | (place > F.col("last_ok"))
    out = joined.groupBy("source_id").agg(F.count("*").alias("runs"), F.count_if(after & ~ok).alias("consecutive_failures"), F.max("started_at").alias("last_run_at"), F.max(F.when(ok, F.col("started_at"))).alias("last_success_at"))
    return out.withColumn("health", health_of(F.col("consecutive_failures")))


TAIL = 64


def response_time_ewma(runs: DataFrame, keep: float = 0.7, tail: int = TAIL) -> DataFrame:
    """(source_id, average_ms): the first duration, then round(0.7 previous + 0.3 next, 2) in the order of runs.

    The rounding makes the fold sequential, but a step never turns two averages round. So a source's last `tail` runs
    are folded twice, from the least and from the greatest duration that it ever had, between which every average lies:
    if both end alike, so does the fold of all its runs. For the sources where they don't, the tail is made longer;
    when it holds all their runs, its first is the fold's start. No array is longer than a source needs.
    """
    rows = runs.where("duration_ms IS NOT NULL").select("source_id", F.struct("started_at", "id", F.col("duration_ms").cast("double").alias("ms")).alias("run"))
    every = materialise(rows.groupBy("source_id").agg(F.count("*").alias("n"), F.min("run.ms").alias("low"), F.max("run.ms").alias("high")))
    done, left = [], every
    step = lambda acc, x: F.round(acc * keep + x["ms"] * (1 - keep), 2)
    fold = lambda runs, start: F.aggregate(runs, start.cast("double"), step)
    while True:
        place = F.row_number().over(W.partitionBy("source_id").orderBy(F.col("run").desc()))
        last = rows.join(left.select("source_id"), "source_id", "left_semi").withColumn("__n", place).where(F.col("__n") <= tail)  # each task keeps `tail` of a source
        held = last.groupBy("source_id").agg(F.array_sort(F.collect_list("run")).alias("a")).join(left, "source_id")
        exact = fold(F.slice("a", F.lit(2), F.greatest(F.size("a") - 1, F.lit(0))), F.get("a", F.lit(0))["ms"])
        whole = F.size("a") == F.col("n")
        ends = materialise(held.select("source_id", "n", "low", "high", F.when(whole, exact).otherwise(fold(F.col("a"), F.col("low"))).alias("one"), F.when(whole, exact).otherwise(fold(F.col("a"), F.col("high"))).alias("two")))
        done.append(ends.where("one = two").select("source_id", F.col("one").alias("average_ms")))
        left = ends.where("one != two").select("source_id", "n", "low", "high")
        if left.isEmpty():
            return reduce(DataFrame.union, done)
        tail *= 8


def unhealthy_sources(sources: DataFrame, least: int = 3, limit: int = 100) -> DataFrame:
    return sources.where(F.col("consecutive_failures") >= least).orderBy(F.col("consecutive_failures").desc(), "id").limit(limit)


def _interval(minutes: Column, health: Column) -> Column:
    factor = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in BACKOFF.items() for x in kv]), health), F.lit(1))
    return F.make_dt_interval(F.lit(0), F.lit(0), (minutes * factor).cast("int"))


def next_eligible_run(sources: DataFrame, as_of: str, from_last_run: bool = False) -> DataFrame:
    anchor = F.coalesce("last_run_at", _at(as_of)) if from_last_run else _at(as_of)
    return sources.withColumn("next_eligible_at", anchor + _interval(F.col("interval_minutes"), F.col("health")))


def due_sources(sources: DataFrame, as_of: str, limit: int = 25) -> DataFrame:
    """Due sources by priority, then the longest not run; filtered before the limit."""
    now = _at(as_of)
    free = F.coalesce(F.col("next_run_at") <= now, F.lit(True)) & F.coalesce(F.col("claim_expires_at") <= now, F.lit(True))
    rested = F.coalesce(F.col("last_run_at") + _interval(F.col("interval_minutes"), F.col("health")) <= now, F.lit(True))
    return sources.where(~F.col("paused") & F.col("lifecycle").isin(*SCHEDULABLE) & free & rested).orderBy("priority", F.col("last_run_at").asc_nulls_first(), "id").limit(limit)


def source_freshness(sources: DataFrame, as_of: str, aging: float = 36, stale: float = 96) -> DataFrame:
    now = _at(as_of)
    hours = F.round(F.timestamp_diff("SECOND", F.col("last_success_at"), now) / 3600, 2)
    state = F.when(~F.col("lifecycle").isin(*SCHEDULABLE), "NOT_ACTIVE").when(F.col("paused"), "PAUSED")
    state = state.when(F.col("last_success_at").isNull(), "NEVER_RUN").when(F.col("last_success_at") < now - _hours(stale), "STALE").when(F.col("last_success_at") < now - _hours(aging), "AGING").otherwise("FRESH")
    return sources.select("id", "slug", state.alias("freshness"), hours.alias("hours_since_success"))


def stuck_jobs(jobs: DataFrame, as_of: str, queued_s: int = 900, running_s: int = 3900) -> DataFrame:
    """(id, source_id, state, action): queued too long, running past timeout and grace, retries overdue."""
    now = _at(as_of)
    old = lambda c, s: c < now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(s))
    state = F.when((F.col("status") == "QUEUED") & old(F.col("created_at"), queued_s), "QUEUED_STALE").when((F.col("status") == "RUNNING") & old(F.coalesce("started_at", "created_at"), running_s), "RUNNING_STALE").when((F.col("status") == "RETRYING") & old(F.col("scheduled_for"), queued_s), "RETRY_OVERDUE")
    return jobs.withColumn("state", state).where("state IS NOT NULL").select("id", "source_id", "state", F.when(F.col("attempts") < F.col("max_attempts"), "REQUEUE").otherwise("FAIL").alias("action"))


def stuck_runs(runs: DataFrame, jobs: DataFrame, as_of: str, older_s: int = 3900, job_col: str = "id") -> DataFrame:
    """Runs still RUNNING, old, whose job is missing or finished."""
    j = jobs.select(F.col("id").alias("job_id"), F.col("status").alias("job_status"))
    old = F.col("started_at") < _at(as_of) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(older_s))
    out = runs.where((F.col("status") == "RUNNING") & old).join(j, F.col(job_col) == F.col("job_id"), "left")
    return out.where(F.col("job_id").isNull() | ~F.col("job_status").isin(*LIVE)).select("id", "source_id", F.coalesce("job_status", F.lit("MISSING")).alias("job_status"))


def expired_leases(sources: DataFrame, jobs: DataFrame, as_of: str) -> DataFrame:
    """Claims past their end without a live job of the source."""
    live = jobs.where(F.col("status").isin(*LIVE)).select(F.col("source_id").alias("id")).distinct()
    return sources.where(F.col("claim_expires_at") < _at(as_of)).join(live, "id", "left_anti").select("id", "claim_expires_at")


def duplicate_live_jobs(jobs: DataFrame) -> DataFrame:
    """Live jobs of a source besides its oldest one, which holds the claim."""
    live = jobs.where(F.col("status").isin(*LIVE))
    holder = live.groupBy("source_id").agg(F.min(F.struct("created_at", "id")).alias("h"))
    return live.join(holder, "source_id").where("id != h.id").select("id", "source_id", F.col("h.id").alias("holder_id"))


def reconcile_report(sources: DataFrame, runs: DataFrame, jobs: DataFrame, as_of: str) -> DataFrame:
    """(kind, action, n) of all repairs that are due."""
    stuck = stuck_jobs(jobs, as_of)
    rows = stuck.select(F.lit("stuck_job").alias("kind"), "action", "id")
    rows = rows.union(stuck_runs(runs, jobs, as_of).select(F.lit("stuck_run"), F.lit("FAIL"), "id")).union(expired_leases(sources, jobs, as_of).select(F.lit("expired_lease"), F.lit("RELEASE"), "id"))
    rows = rows.union(duplicate_live_jobs(jobs).join(stuck, "id", "left_anti").select(F.lit("duplicate_job"), F.lit("CANCEL"), "id"))
    return rows.groupBy("kind", "action").agg(F.count("*").alias("n"))


def failure_triage(runs: DataFrame, errors: DataFrame, attempts: Column, most: int = 3, base: float = 30, ceiling: float = 900) -> DataFrame:
    """(id, triage, delay_s): permanent without a retryable error, exhausted by attempts, else transient."""
    e = errors.groupBy("run_id").agg(F.bool_or("retryable").alias("retryable"))
    rows = runs.where("status = 'FAILED'").withColumn("__n", attempts).join(e, F.col("id") == F.col("run_id"), "left")
    triage = F.when(~F.coalesce("retryable", F.lit(True)), "PERMANENT").when(F.col("__n") >= most, "EXHAUSTED").otherwise("TRANSIENT")
    return rows.select("id", triage.alias("triage"), F.when(triage == "TRANSIENT", F.least(F.lit(ceiling), base * F.pow(F.lit(2.0), F.col("__n") - 1))).alias("delay_s"))


def verification_verdict(checks: DataFrame) -> DataFrame:
    """(source_id, verdict, failed, warned) over checks (source_id, name, required, outcome PASS/WARN/FAIL)."""
    failed, soft = F.col("outcome") == "FAIL", F.col("outcome") == "WARN"
    hard = failed & F.col("required")
    out = checks.groupBy("source_id").agg(F.bool_or(hard).alias("bad"), F.bool_or(soft | (failed & ~F.col("required"))).alias("warn"), F.sort_array(F.collect_set(F.when(failed, F.col("name")))).alias("failed"))
    return out.select("source_id", F.when(F.col("bad"), "FAILED").when(F.col("warn"), "PASSED_WITH_WARNINGS").otherwise("PASSED").alias("verdict"), F.array_join("failed", ",").alias("failed"))


def verify_captured(items: DataFrame, validated: DataFrame, sources: DataFrame, off_site: float = 0.5) -> DataFrame:
    """Check rows that tables allow: listing (share off the source's site), parse (usable rows), parser (rows that validate)."""
    from ..functions.urls import same_host

    s = sources.select(F.col("id").alias("source_id"), "base_url")
    a = items.join(s, "source_id").groupBy("source_id").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.length(F.trim(F.try_element_at("fields", F.lit("title")))) > 0, F.lit(False))).alias("usable"), F.count_if(~F.coalesce(same_host(F.col("source_url"), F.col("base_url")), F.lit(False))).alias("away"))
    v = validated.groupBy("source_id").agg(F.count_if(F.col("quality") != "INVALID").alias("good"))
    rows = a.join(v, "source_id", "left")
    out = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(r).alias("required"), o.alias("outcome")) for n, r, o in (("listing", False, F.when(F.col("away") > off_site * F.col("n"), "WARN").otherwise("PASS")), ("parse", True, F.when(F.col("usable") > 0, "PASS").otherwise("FAIL")), ("parser", True, F.when(F.coalesce("good", F.lit(0)) > 0, "PASS").otherwise("FAIL")))])
    return rows.select("source_id", F.explode(out).alias("c")).select("source_id", "c.*")


def verify_coverage(items: DataFrame, targets: DataFrame, sources: DataFrame) -> DataFrame:
    """Check rows (source_id, name, required, outcome) of what a source's items and listing targets cover.

    documents: WARN unless an item has a document with an address. pagination: PASS with several distinct target URLs,
    WARN with at most one though the source declares pages (max_pages or pagination), else SKIP. Sources without items
    or targets get both rows too; neither check is required, and SKIP counts for nothing in a verdict.
    """
    linked = items.groupBy("source_id").agg(F.bool_or(F.exists(F.coalesce("documents", F.array().cast(items.schema["documents"].dataType)), lambda d: d["url"].isNotNull())).alias("linked"))
    pages = targets.groupBy("source_id").agg(F.countDistinct("url").alias("pages"))
    declared = [F.coalesce(F.col(c).isNotNull(), F.lit(False)) for c in ("max_pages", "pagination") if c in sources.columns]
    rows = sources.select(F.col("id").alias("source_id"), reduce(lambda a, b: a | b, declared, F.lit(False)).alias("declared")).join(linked, "source_id", "left").join(pages, "source_id", "left")
    paged = F.when(F.coalesce("pages", F.lit(0)) > 1, "PASS").when(F.col("declared"), "WARN").otherwise("SKIP")
    checks = F.array(F.struct(F.lit("documents").alias("name"), F.when(F.coalesce("linked", F.lit(False)), "PASS").otherwise("WARN").alias("outcome")), F.struct(F.lit("pagination").alias("name"), paged.alias("outcome")))
    return rows.select("source_id", F.explode(checks).alias("c")).select("source_id", "c.name", F.lit(False).alias("required"), "c.outcome")


def lifecycle_transition(sources: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(id, lifecycle, next_lifecycle) after verification."""
    out = sources.join(verdicts.select(F.col("source_id").alias("id"), "verdict"), "id", "left")
    passed = F.col("verdict").isin("PASSED", "PASSED_WITH_WARNINGS")
    after = F.when(passed & F.col("lifecycle").isin("DISCOVERED", "PENDING_VERIFICATION"), "VERIFIED").when((F.col("verdict") == "FAILED") & (F.col("lifecycle") == "ACTIVE"), "DEGRADED").otherwise(F.col("lifecycle"))
    return out.select("id", "lifecycle", after.alias("next_lifecycle"))


def transition_refusals(requests: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Requests (source_id, action, reason, whatever else) that are refused, with the refusal: activation without a pass, a pause without a reason."""
    out = requests.join(verdicts.select("source_id", "verdict"), "source_id", "left")
    why = F.when((F.col("action") == "ACTIVATE") & ~F.coalesce(F.col("verdict").isin("PASSED", "PASSED_WITH_WARNINGS"), F.lit(False)), "NOT_VERIFIED").when((F.col("action") == "PAUSE") & (F.coalesce(F.trim("reason"), F.lit("")) == ""), "REASON_MISSING")
    return out.withColumn("refusal", why).where("refusal IS NOT NULL").select(*requests.columns, "refusal")


def run_gap_analysis(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, gaps, late, longest_s): gaps between runs against the source's interval."""
    w = W.partitionBy("source_id").orderBy("started_at", "id")
    gaps = runs.select("source_id", F.timestamp_diff("SECOND", F.lag("started_at").over(w), F.col("started_at")).alias("gap")).where("gap IS NOT NULL")
    s = sources.select(F.col("id").alias("source_id"), "interval_minutes")
    return gaps.join(s, "source_id").groupBy("source_id").agg(F.count("*").alias("gaps"), F.count_if(F.col("gap") > 60 * F.col("interval_minutes")).alias("late"), F.max("gap").alias("longest_s"))
