"""Health of sources, freshness, comparable runs and anomalies.

Outcomes are rows of one source in one run: ``run_id``, ``source_id``, ``settled_at``, ``status``, ``completed``, ``coverage``, ``stale``, ``trusted``, ``suspicious``,
``excluded``, ``inventory``, ``duration_ms``, ``rate_limits``, ``http_status``, ``fallbacks``, ``fallback_successes``, ``error``. Runs are rows ``run_id``, ``status``, ``started_at``,
``finished_at``, ``heartbeat_at``, ``cancelled``, ``requested``, ``settled``, ``completed``, ``discovered``, ``closed``, ``skipped``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import windows as win

# Statuses of outcomes that are no success.
NO_SUCCESS = ["partial", "rate_limited", "access_denied", "robots_disallowed", "authentication_required", "browser_error", "parse_error", "source_unavailable"]


@dataclass(frozen=True)
class Thresholds:
    """When an anomaly is reported."""

    stale_ms: int = 86_400_000
    failures: int = 3
    samples: int = 3
    low_yield: float = 0.25
    least_mean: float = 1.0
    slow_factor: float = 2.0
    slow_ms: int = 300_000
    closure_factor: float = 3.0
    closures: int = 5
    dedup_delta: float = 0.2
    dedup_factor: float = 2.0
    stuck_heartbeat_ms: int = 1_200_000
    stuck_duration_ms: int = 21_600_000
    history: int = 24


def succeeded() -> Column:
    """Whether an outcome is a success of its source."""
    c = F.col
    return c("completed") & c("coverage") & ~c("stale") & c("trusted") & ~c("suspicious") & ~F.coalesce(c("status").isin(NO_SUCCESS), F.lit(False))


def rate_limit_events() -> Column:
    """Rate-limited responses of an outcome: its count, or one that only its status tells of."""
    return F.greatest(F.coalesce("rate_limits", F.lit(0)), F.when((F.col("status") == "rate_limited") | (F.col("http_status") == 429), 1).otherwise(0))


def _ms(later: Column, earlier: Column) -> Column:
    return F.unix_millis(later.cast("timestamp")) - F.unix_millis(earlier.cast("timestamp"))


def health(outcomes: DataFrame, now: str, t: Thresholds = Thresholds()) -> DataFrame:
    """One row per source over its newest outcomes that are not excluded.

    Counts, sums and means are over the ``history`` newest; the latest success, failure and fallback and the streak of
    fallbacks without success look further back. One window and one aggregation by source.
    """
    by = W.partitionBy("source_id")
    rows = outcomes.filter(~F.col("excluded")).select("*", succeeded().alias("ok"), F.least("fallbacks", "fallback_successes").alias("useful"), rate_limit_events().alias("limits"))
    rows = rows.withColumn("rn", F.row_number().over(by.orderBy(F.desc("run_id"))))
    rows = rows.withColumn("helped", F.min(F.when(F.col("useful") > 0, F.col("rn"))).over(by))
    c, here, at = F.col, F.col("rn") <= t.history, F.lit(now).cast("timestamp_ntz")
    count = lambda test: agg.count_where(here & test)
    total = lambda x: F.coalesce(F.sum(F.when(here, F.col(x))), F.lit(0)).cast("bigint")
    newest = lambda x: F.max(F.when(c("rn") == 1, F.col(x)))
    latest = lambda test, x: F.min_by(F.when(test, F.col(x)), F.when(test, c("rn")))
    out = rows.groupBy("source_id").agg(
        count(F.lit(True)).alias("attempts"), count(c("ok")).alias("successes"), count(~c("ok")).alias("failures"), F.min(F.when(c("ok"), c("rn"))).alias("first_ok"), newest("settled_at").alias("last_attempt_at"), latest(c("ok"), "settled_at").alias("last_success_at"),
        latest(~c("ok"), "settled_at").alias("last_failure_at"), latest(c("fallbacks") > 0, "settled_at").alias("last_fallback_at"), F.coalesce(F.sum(F.when(c("helped").isNull() | (c("rn") < c("helped")), c("fallbacks"))), F.lit(0)).cast("bigint").alias("fallback_streak"),
        F.avg(F.when(here & c("ok"), c("inventory"))).alias("listing_yield"), F.avg(F.when(here & (c("duration_ms") >= 0), c("duration_ms"))).alias("latency_ms"), count(c("duration_ms") >= 0).alias("latency_samples"), total("limits").alias("rate_limit_count"),
        total("fallbacks").alias("fallback_count"), total("useful").alias("fallback_successes"), count(~c("ok") & ((c("status") == "partial") | (c("completed") & ~c("coverage")) | c("suspicious"))).alias("partial_count"), count(c("stale")).alias("stale_count"),
        count(c("suspicious")).alias("suspicious_count"), newest("inventory").alias("last_inventory"), latest(c("ok"), "inventory").alias("trusted_inventory"), newest("status").alias("last_status"), newest("http_status").alias("last_http_status"), newest("error").alias("last_error"), newest("stale").alias("last_stale"),
    )
    out = out.withColumn("consecutive_failures", F.least("attempts", F.coalesce(c("first_ok") - 1, c("attempts"))).cast("bigint"))
    out = out.withColumn("cooldown_ms", win.cooldown_ms(c("consecutive_failures"), t.failures))
    until = F.when(c("cooldown_ms") > 0, c("last_failure_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (c("cooldown_ms") / 1000).cast("decimal(18,6)")))
    old = F.when(c("last_success_at").isNotNull(), _ms(at, c("last_success_at")) > t.stale_ms).otherwise(c("attempts") > 0)
    ratios = {"success_rate": ("successes", "attempts"), "fallback_rate": ("fallback_count", "attempts"), "fallback_success_rate": ("fallback_successes", "fallback_count"), "partial_rate": ("partial_count", "attempts"), "stale_rate": ("stale_count", "attempts")}
    return out.select("*", until.alias("cooldown_until"), F.coalesce(at < until, F.lit(False)).alias("cooling_down"), (F.coalesce("last_stale", F.lit(False)) | old).alias("is_stale"), *[agg.ratio(c(a), c(b)).alias(n) for n, (a, b) in ratios.items()]).drop("first_ok", "last_stale")


def trusted_outcome() -> Column:
    """Whether an outcome counts for freshness, yields and durations."""
    c = F.col
    return c("completed") & c("coverage") & ~c("stale") & ~c("excluded") & c("trusted")


def freshness(runs: DataFrame, outcomes: DataFrame, configured: DataFrame, now: str, t: Thresholds = Thresholds()) -> DataFrame:
    """One row: state, last successful crawl, numbers of sources, the newest full run.

    A full run completed all that it asked for and has a trusted outcome of every configured source (``source_id``, distinct). stale beyond
    the limit; fresh with a full run and all sources trusted; partial with any; else unknown.
    """
    known = outcomes.filter(trusted_outcome()).join(configured, "source_id", "left_semi").groupBy("run_id", "source_id").agg(F.max("settled_at").alias("settled_at"))
    sources = known.groupBy("source_id").agg(F.max("settled_at").alias("at")).agg(F.count("*").alias("trusted_sources"), F.max("at").alias("source_at"))
    expected = configured.agg(F.count("*").alias("expected_sources"))
    ended = runs.filter((F.col("status") == "COMPLETED") & ~F.col("cancelled") & (F.col("requested") > 0) & (F.col("settled") >= F.col("requested")) & (F.col("completed") >= F.col("requested")))
    covered = known.groupBy("run_id").agg(F.count("*").alias("covered")).crossJoin(F.broadcast(expected)).filter("expected_sources > 0 and covered >= expected_sources")
    full = ended.join(covered, "run_id").agg(F.max("run_id").alias("full_run_id"), F.max_by(F.coalesce("finished_at", "started_at"), "run_id").alias("full_at"))
    row = sources.crossJoin(F.broadcast(expected)).crossJoin(F.broadcast(full)).withColumn("last_crawl_at", F.coalesce("full_at", "source_at"))  # three single rows
    age = _ms(F.lit(now).cast("timestamp_ntz"), F.col("last_crawl_at"))
    state = F.when(age > t.stale_ms, "stale").when(F.col("full_run_id").isNotNull() & (F.col("trusted_sources") >= F.col("expected_sources")), "fresh").when(F.col("trusted_sources") > 0, "partial").otherwise("unknown")
    return row.select(state.alias("state"), "last_crawl_at", age.alias("age_ms"), "expected_sources", "trusted_sources", "full_run_id")


def trend(latest: Column, median: Column, share: float = 0.1) -> Column:
    """up, down or steady: outside or inside a tenth round the median."""
    return F.when(median.isNull(), None).when(latest > median * (1 + share), "up").when(latest < median * (1 - share), "down").otherwise("steady")


def _fired(scope: str, code: str, test: Column, observed: Column, baseline: Column | None, threshold: Column | float | None, severity: Column | str = "warning") -> Column:
    number = lambda x: (F.lit(None) if x is None else x if isinstance(x, Column) else F.lit(x)).cast("double")
    value = F.struct(F.lit(scope).alias("scope"), F.lit(code).alias("code"), (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"), number(observed).alias("observed"), number(baseline).alias("baseline"), number(threshold).alias("threshold"))
    return F.when(test, value)


def _listed(df: DataFrame, run_id: Column, source_id: Column, *fired: Column) -> DataFrame:
    rows = df.select(run_id.cast("bigint").alias("run_id"), source_id.cast("bigint").alias("source_id"), F.explode(F.array_compact(F.array(*fired))).alias("a"))
    return rows.select("a.scope", "run_id", "source_id", "a.code", "a.severity", "a.observed", "a.baseline", "a.threshold")


def source_anomalies(outcomes: DataFrame, configured: DataFrame, now: str, t: Thresholds = Thresholds()) -> DataFrame:
    """Anomalies of the configured sources: stale, failing, without or with low yield, rate-limited, in need of a browser, slow.

    Yields are compared with the mean, durations with the median of the trusted outcomes but the newest. Events of transport are
    those of the newest outcome only.
    """
    c = F.col
    by = W.partitionBy("source_id")
    rows = outcomes.join(configured, "source_id", "left_semi").select("*", trusted_outcome().alias("good"), rate_limit_events().alias("limits"))
    rows = rows.withColumn("rn", F.row_number().over(by.orderBy(F.desc("run_id"))))
    rows = rows.withColumn("gn", F.when(c("good"), F.sum(c("good").cast("int")).over(by.orderBy(F.desc("run_id")).rowsBetween(W.unboundedPreceding, 0))))
    newest, rest = lambda x: F.max(F.when(c("rn") == 1, F.col(x))), lambda x: F.when((c("gn") > 1) & (F.col(x) >= 0), F.col(x))
    s = rows.groupBy("source_id").agg(
        newest("run_id").alias("run_id"), F.max(F.when(c("gn") == 1, c("settled_at"))).alias("last"), F.min(F.when(c("good"), c("rn"))).alias("first_good"), F.count("*").alias("n"), F.max(F.when(c("gn") == 1, c("inventory"))).alias("y"), F.avg(rest("inventory")).alias("ym"),
        F.count(rest("inventory")).alias("ys"), newest("duration_ms").alias("d"), F.percentile(rest("duration_ms"), 0.5).alias("dm"), F.count(rest("duration_ms")).alias("ds"), newest("limits").alias("limits"), newest("fallbacks").alias("fb"), F.max(F.when(c("rn") == 1, F.least("fallbacks", "fallback_successes"))).alias("fs"),
    )
    s = s.withColumn("age", _ms(F.lit(now).cast("timestamp_ntz"), c("last"))).withColumn("streak", F.coalesce(c("first_good") - 1, c("n")))
    based = (c("ys") >= t.samples) & (c("ym") >= t.least_mean)
    slow = F.greatest(c("dm") * t.slow_factor, F.lit(float(t.slow_ms)))
    return _listed(
        s, c("run_id"), c("source_id"),
        _fired("source", "STALE_SOURCE", F.coalesce(c("age") > t.stale_ms, F.lit(True)), c("age"), F.lit(t.stale_ms), t.stale_ms), _fired("source", "REPEATED_FAILURES", c("streak") >= t.failures, c("streak"), None, t.failures),
        _fired("source", "ZERO_YIELD", based & (c("y") == 0), c("y"), c("ym"), 0), _fired("source", "LOW_YIELD", based & (c("y") > 0) & (c("y") < c("ym") * t.low_yield), c("y"), c("ym"), c("ym") * t.low_yield),
        _fired("source", "RATE_LIMITED", c("limits") > 0, c("limits"), None, 1), _fired("source", "BROWSER_FALLBACK", c("fb") > 0, c("fb"), c("fs"), None, F.when(c("fs") > 0, "info").otherwise("warning")),
        _fired("source", "SLOW_SOURCE", (c("ds") >= t.samples) & (c("d") > slow), c("d"), c("dm"), slow),
    )


def run_anomalies(runs: DataFrame, outcomes: DataFrame, fresh: DataFrame, comparable: Column, now: str, t: Thresholds = Thresholds()) -> DataFrame:
    """Anomalies of the database and its runs: no data, warm-up, stale, a stuck run, and the newest comparable run against those before.

    ``fresh`` is the row of ``freshness``.
    """
    c, at = F.col, F.lit(now).cast("timestamp_ntz")
    runs = runs.withColumn("comparable", comparable).withColumn("duration", F.when(c("finished_at").isNotNull() & (c("finished_at") >= c("started_at")), _ms(c("finished_at"), c("started_at"))))
    runs = runs.withColumn("ratio", F.when(c("discovered") > 0, c("skipped") / c("discovered")).otherwise(0.0))
    latest = runs.agg(F.max(F.when(c("comparable"), c("run_id"))).alias("latest"), F.max("run_id").alias("newest"), F.count("*").alias("n_runs"), F.max_by(F.when(c("status") == "RUNNING", c("run_id")), F.when(c("status") == "RUNNING", c("run_id"))).alias("active"))
    df = runs.crossJoin(F.broadcast(latest))  # a single row
    old, new = c("comparable") & (c("run_id") < c("latest")), c("run_id") == c("latest")
    value = lambda test, x: F.max(F.when(test, F.col(x)))
    row = df.agg(
        F.count("*").alias("n_runs"), agg.count_where(c("comparable")).alias("n_comparable"), F.max("newest").alias("newest"), F.max("latest").alias("latest"), F.max("active").alias("active"), value(c("run_id") == c("active"), "heartbeat_at").alias("beat"), value(c("run_id") == c("active"), "started_at").alias("begun"),
        value(new, "duration").alias("d"), F.percentile(F.when(old, c("duration")), 0.5).alias("dm"), F.count(F.when(old, c("duration"))).alias("ds"), value(new, "closed").alias("closed"), F.avg(F.when(old, c("closed"))).alias("cm"), agg.count_where(old).alias("n_old"),
        value(new, "ratio").alias("ratio"), F.avg(F.when(old, c("ratio"))).alias("rm"), value(new, "skipped").alias("skipped"), F.avg(F.when(old, c("discovered"))).alias("gm"),
    )
    row = row.crossJoin(F.broadcast(outcomes.agg(F.count("*").alias("n_outcomes")))).crossJoin(F.broadcast(fresh.select("age_ms", "full_run_id")))  # single rows
    beat, lasting = _ms(at, c("beat")), _ms(at, c("begun"))
    slow, spike, drift = F.greatest(c("dm") * t.slow_factor, F.lit(float(t.slow_ms))), F.greatest(F.lit(float(t.closures)), c("cm") * t.closure_factor), F.greatest(c("rm") + t.dedup_delta, c("rm") * t.dedup_factor)
    none, based = F.lit(None), c("n_old") >= t.samples
    empty = (c("n_runs") == 0) & (c("n_outcomes") == 0)
    base = _listed(row, c("newest"), none, _fired("database", "NO_DATA", empty, none, None, None, "info"), _fired("database", "WARMUP", ~empty & (c("n_comparable") < t.samples), c("n_comparable"), F.lit(t.samples), t.samples, "info"))
    age = _listed(row, c("full_run_id"), none, _fired("database", "STALE_DATABASE", c("age_ms") > t.stale_ms, c("age_ms"), F.lit(t.stale_ms), t.stale_ms))
    stuck = _listed(row, c("active"), none, _fired("run", "STUCK_RUN", (F.coalesce(beat, lasting) > t.stuck_heartbeat_ms) | (lasting > t.stuck_duration_ms), F.greatest(F.coalesce(beat, lasting), lasting), None, max(t.stuck_heartbeat_ms, t.stuck_duration_ms), "critical"))
    against = _listed(
        row, c("latest"), none, _fired("run", "DURATION_REGRESSION", (c("ds") >= t.samples) & (c("d") > slow), c("d"), c("dm"), slow), _fired("run", "CLOSURE_SPIKE", based & (c("closed") >= spike) & (c("closed") > c("cm")), c("closed"), c("cm"), spike),
        _fired("run", "DEDUP_DRIFT", based & (c("ratio") > drift) & (c("skipped") > c("gm") * 0.1), c("ratio"), c("rm"), drift),
    )
    return base.unionByName(age).unionByName(stuck).unionByName(against)


def overall(found: DataFrame) -> DataFrame:
    """degraded with any warning, else healthy."""
    return found.agg(F.when(agg.count_where(F.col("severity").isin("warning", "critical")) > 0, "degraded").otherwise("healthy").alias("status"))
