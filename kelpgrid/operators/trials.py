"""Analytics over run histories keyed by (task_id, iter); smaller objectives are better."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpgrid.functions.expressions import bilog
from kelpgrid.functions.ordering import count_quantiles, join_keys, quantiles, with_group_stats, with_row_number, with_running
from kelpgrid.session import materialize

KEYS = ["task_id"]
# Fixed value: an objective that says "no value".
MAXINT = 2 ** 31 - 1


def objective_values(metrics: str, names: list[str]) -> dict[str, Column]:
    """Objectives by metric name: ``-name`` keeps the sign, ``name`` is negated; absent -> null."""
    out = {}
    for i, n in enumerate(names, 1):
        value = F.try_element_at(F.col(metrics), F.lit(n.strip().strip("-")))
        out[f"obj{i}"] = value if n.strip().startswith("-") else -value
    return out


_TOKEN = re.compile(r"\s*(?:([A-Za-z_]\w*)|(\d+(?:\.\d+)?)|([-+*/()]))")


def constraint_values(exprs: list[str], allowed: set[str]) -> list[Column]:
    """Arithmetic constraint expressions over allow-listed columns; <= 0 is feasible.

    Names outside the list and anything but + - * / ( ) and numbers is refused,
    so logged text can never run code.
    """
    for e in exprs:
        pos = 0
        while pos < len(e.rstrip()):
            m = _TOKEN.match(e, pos)
            if m is None or (m.group(1) and m.group(1) not in allowed):
                raise ValueError(f"constraint not allowed: {e}")
            pos = m.end()
    return [F.expr(e) for e in exprs]


def trial_status(state: str, objectives: list[str], constraints: list[str] = ()) -> Column:
    """success / failed / infeasible of one run; a missing objective (null or MAXINT) or constraint is a failure."""
    bad = F.col(state) != 0
    for c in (*objectives, *constraints):
        bad = bad | F.col(c).isNull()
    for c in objectives:
        bad = bad | (F.col(c) >= MAXINT)
    broken = F.lit(False)
    for c in constraints:
        broken = broken | (F.col(c) > 0)
    return F.when(bad, "failed").when(broken, "infeasible").otherwise("success")


def append_observation(history: DataFrame, new: DataFrame, info: str | None = None) -> DataFrame:
    """History with the new runs; ``info`` names a column in which all runs of a task have to agree (else the job ends)."""
    both = history.unionByName(new)
    if info is None:
        return both
    infos = both.groupBy(*KEYS).agg(F.min(info).alias("__low"), F.max(info).alias("__high"))
    return history.unionByName(join_keys(new, infos, KEYS).withColumn(info, _one_info(F.col("__low"), F.col("__high"), F.col(info))).drop("__low", "__high"))


def _one_info(low: Column, high: Column, value: Column) -> Column:
    return F.when(low < high, F.raise_error(F.concat(F.lit("runs disagree about info in task "), F.coalesce(F.col(KEYS[0]).cast("string"), F.lit("null"))))).otherwise(value)


STATE = ["n_success", "n_failed", "n_infeasible"]


def history_state(trials: DataFrame, y: str, status: Column, info: str | None = None) -> DataFrame:
    """What is kept of a history between appends: runs per task and objective value, by outcome, and the task's info.

    States of any two sets of runs add up (``merge_states``), in any order, so a new batch is aggregated alone and
    old runs are not read again.  The table has one row per value that occurs; all statistics come from it, exactly.
    """
    counts = [F.count_if(status == n.removeprefix("n_")).alias(n) for n in STATE]
    named = F.lit(None).cast("string") if info is None else F.col(info)
    return trials.groupBy(*KEYS, F.col(y).alias("y")).agg(*counts, F.min(named).alias("info"), F.max(named).alias("other_info"))


def merge_states(*states: DataFrame) -> DataFrame:
    """Sum of several states; equal to the state of all their runs together."""
    rows = states[0]
    for s in states[1:]:
        rows = rows.unionByName(s)
    return rows.groupBy(*KEYS, "y").agg(*[F.sum(n).alias(n) for n in STATE], F.min("info").alias("info"), F.max("other_info").alias("other_info"))


def state_summary(state: DataFrame) -> DataFrame:
    """``(task_id, info, n_trials, n_success, n_failed, n_infeasible, best, p5, min_y, max_y)`` of a state.

    ``best`` is the lowest objective of successful runs; the 5th percentile (linear), minimum and maximum are of all
    completed runs, infeasible ones included; a run without an objective only counts.  The job ends where runs of one task
    disagree about ``info``.
    """
    n_done = F.col("n_success") + F.col("n_infeasible")
    done = (F.col("y").isNotNull()) & (n_done > 0)
    total = state.groupBy(*KEYS).agg(
        F.min("info").alias("info"), F.max("other_info").alias("__other"), *[F.sum(n).alias(n) for n in STATE],
        F.min(F.when(F.col("n_success") > 0, F.col("y"))).alias("best"), F.min(F.when(done, F.col("y"))).alias("min_y"), F.max(F.when(done, F.col("y"))).alias("max_y"))
    p5 = count_quantiles(state.filter(done).withColumn("__done", n_done), KEYS, "y", "__done", {"p5": 0.05})
    out = join_keys(total.withColumn("info", _one_info(F.col("info"), F.col("__other"), F.col("info"))), p5, KEYS, "left")
    return out.select(*KEYS, "info", (F.col("n_success") + F.col("n_failed") + F.col("n_infeasible")).alias("n_trials"), *STATE, "best", "p5", "min_y", "max_y")


def history_summary(trials: DataFrame, y: str, status: Column) -> DataFrame:
    """Counts and best value per task."""
    ok = status == "success"
    return trials.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_trials"), F.count_if(ok).alias("n_success"), F.count_if(status == "failed").alias("n_failed"),
        F.min(F.when(ok, F.col(y))).alias("best"))


def fill_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Missing knobs take the catalogue default; knobs without a column are added."""
    return df.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in df.columns else F.lit(v) for k, v in defaults.items()})


def change_space(df: DataFrame, knobs: list[str], defaults: dict, keep: list[str]) -> DataFrame:
    """Project every run on another set of knobs."""
    return fill_defaults(df, {k: defaults[k] for k in knobs}).select(*keep, *knobs)


def impute_failed(trials: DataFrame, y: str, status: Column, out: str = "y") -> DataFrame:
    """Failed and infeasible objectives take the worst completed value of the task.

    An infeasible run did complete, so its value counts toward that maximum.
    """
    t = trials.withColumn("__s", status)
    done = F.when(F.col("__s") != "failed", F.col(y))
    t = with_group_stats(t, KEYS, __worst=F.max(done))
    return t.withColumn(out, F.when(F.col("__s") == "success", F.col(y)).otherwise(F.col("__worst"))).drop("__s", "__worst")


def impute_constraints(trials: DataFrame, c: str, status: Column, out: str = "c") -> DataFrame:
    """Failed rows take the largest constraint value of the task (1.0 if none), then bilog."""
    t = trials.withColumn("__ok", status != "failed")
    t = with_group_stats(t, KEYS, __max=F.max(F.col(c)))
    filled = F.when(F.col("__ok"), F.col(c)).otherwise(F.coalesce("__max", F.lit(1.0)))
    return t.withColumn(out, bilog(filled)).drop("__ok", "__max")


def history_stats(trials: DataFrame, y: str, status: Column) -> DataFrame:
    """5th percentile (linear), minimum and maximum of completed runs."""
    done = trials.filter(status != "failed")
    return join_keys(quantiles(done, KEYS, y, {"p5": 0.05}), done.groupBy(*KEYS).agg(F.min(y).alias("min_y"), F.max(y).alias("max_y")), KEYS)


def dedup_configs(trials: DataFrame, config: list[str]) -> DataFrame:
    """First run of every configuration (a grouped minimum, no sort)."""
    rest = [c for c in trials.columns if c not in (*KEYS, *config)]
    first = trials.groupBy(*KEYS, *config).agg(F.min_by(F.struct(*rest), "iter").alias("__f"))
    return first.select(*KEYS, *config, *[F.col(f"__f.{c}").alias(c) for c in rest])


def incumbents(trials: DataFrame, y: str, config: list[str], keys: list[str] = KEYS) -> DataFrame:
    """Configurations tied at the minimum, each at its first run."""
    firsts = dedup_configs(trials, config)
    best = firsts.groupBy(*keys).agg(F.min(y).alias("best"))
    return join_keys(firsts, best, keys).filter(F.col(y) == F.col("best")).drop("best")


def list_trials(trials: DataFrame, config: list[str], y: list[str], context: list[str] = ()) -> DataFrame:
    """Every run as its configuration, objectives and (if named) context, one array or struct each, in columns of that name."""
    parts = [F.struct(*config).alias("configuration"), F.array(*[F.col(c).cast("double") for c in y]).alias("objectives")]
    return trials.select(*KEYS, "iter", *parts, *([F.array(*[F.col(c).cast("double") for c in context]).alias("context")] if context else []))


def trial_lookup(trials: DataFrame, config: dict, cols: list[str]) -> DataFrame:
    cond = F.lit(True)
    for k, v in config.items():
        cond = cond & F.col(k).eqNullSafe(F.lit(v))
    return trials.filter(cond).select(*cols)


def incumbent_report(inc: DataFrame, y: str, config: list[str]) -> DataFrame:
    """Parameters as rows, incumbents numbered per task, with best value and their count."""
    t = with_row_number(inc, KEYS, ["iter"], "incumbent")
    t = with_group_stats(t, KEYS, n_incumbents=F.count(F.lit(1)))
    as_text = t.withColumns({c: F.col(c).cast("string") for c in config})
    return as_text.unpivot([*KEYS, "incumbent", "n_incumbents", y], config, "parameter", "value")


def convergence(trials: DataFrame, y: str) -> DataFrame:
    """Running minimum per iteration; objectives clipped at the largest running minimum."""
    run = with_running(trials, KEYS, ["iter"], {"running_min": ("min", y)})
    run = with_group_stats(run, KEYS, __top=F.max("running_min"))
    return run.withColumn("clipped", F.least(y, "__top")).drop("__top")


def default_perf(trials: DataFrame, y: str, default: dict) -> DataFrame:
    """Mean objective of runs with the default configuration, else of the first run."""
    is_default = F.lit(True)
    for k, v in default.items():
        is_default = is_default & (F.col(k) == F.lit(v))
    return trials.groupBy(*KEYS).agg(F.coalesce(F.avg(F.when(is_default, F.col(y))), F.min_by(y, "iter")).alias("default_perf"))


def promising_threshold(trials: DataFrame, y: str, default: dict, quantile: float = 0.0, respect: bool = False) -> DataFrame:
    """Objective value a run must reach: the default's, or a quantile counted from the worst run."""
    base = default_perf(trials, y, default)
    if quantile == 0:
        return base.withColumnRenamed("default_perf", "threshold")
    q = join_keys(quantiles(trials, KEYS, y, {"q": 1.0 - quantile}), base, KEYS)
    return q.select(*KEYS, (F.col("q") if respect else F.least("q", "default_perf")).alias("threshold"))


def promising_region(trials: DataFrame, y: str, threshold: DataFrame, numeric: list[str]) -> DataFrame:
    """Range of good values per numeric knob, widened to the nearest bad value on each side."""
    good = join_keys(trials, materialize(threshold), KEYS).withColumn("good", F.col(y) <= F.col("threshold"))
    long = good.select(*KEYS, "good", *[F.col(c).cast("double").alias(c) for c in numeric]).unpivot(
        [*KEYS, "good"], numeric, "knob", "v")
    values = long.groupBy(*KEYS, "knob", "v").agg(F.max("good").alias("any_good"), F.min("good").alias("all_good"))
    span = values.filter("any_good").groupBy(*KEYS, "knob").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    bad = join_keys(values.filter("not all_good"), span, [*KEYS, "knob"]).groupBy(*KEYS, "knob").agg(
        F.max(F.when(F.col("v") < F.col("lo"), F.col("v"))).alias("below"), F.min(F.when(F.col("v") > F.col("hi"), F.col("v"))).alias("above"))
    return join_keys(span, bad, [*KEYS, "knob"], "left").select(
        *KEYS, "knob", F.coalesce("below", "lo").alias("low"), F.coalesce("above", "hi").alias("high"))


def normalized_importance(region: DataFrame, importance: DataFrame, default: DataFrame) -> DataFrame:
    """``region`` with the importance of its knob over the absolute default performance of its task.

    ``importance(knob, importance)`` holds for all tasks, or has the task's keys
    too; ``default`` is ``default_perf``.  Knobs without an importance and tasks
    whose default performance is 0 or unknown get null.
    """
    on = [*(KEYS if KEYS[0] in importance.columns else []), "knob"]
    out = join_keys(join_keys(region, importance, on, "left"), default, KEYS, "left")
    return out.withColumn("importance", F.try_divide(F.col("importance"), F.abs("default_perf"))).drop("default_perf")


def promising_categories(trials: DataFrame, y: str, threshold: DataFrame, categorical: list[str]) -> DataFrame:
    """Distinct good values per categorical knob."""
    good = join_keys(trials, materialize(threshold), KEYS).filter(F.col(y) <= F.col("threshold"))
    return good.select(*KEYS, *categorical).unpivot(KEYS, categorical, "knob", "value").distinct()


def first_n_trials(trials: DataFrame, n: int) -> DataFrame:
    """The first n runs of each task (all if n = -1); ``iter`` need not be dense."""
    if n == -1:
        return trials
    return with_row_number(trials, KEYS, ["iter"], "__rn").filter(F.col("__rn") <= n).drop("__rn")


def exclude_seen(candidates: DataFrame, trials: DataFrame, config: list[str]) -> DataFrame:
    """Candidates whose configuration has not been run (null-safe comparison)."""
    seen = trials.select(*[F.col(c).alias(f"__s_{c}") for c in config]).distinct()
    cond = [F.col(c).eqNullSafe(F.col(f"__s_{c}")) for c in config]
    return candidates.join(seen, cond, "left_anti")
