"""Parsers of run logs, benchmark outputs and key-value files.

All take a text frame (column ``line``, and ``file`` / ``line_no`` where files
matter) and use built-in string and JSON functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpgrid.functions.ordering import quantiles, with_running

# Number of internal metrics of a full record, and its marker.
N_METRICS = 65
FULL_MARK = "65d"
# Line formats of the benchmark tools.
TPCC_PATTERN = r"trx: (\d+), 95%: (\d+.\d+), 99%: (\d+.\d+), max_rt:"
SYSBENCH_PATTERN = (r"tps: (\d+.\d+) qps: (\d+.\d+) \(r/w/o: (\d+.\d+)/(\d+.\d+)/(\d+.\d+)\)"
                    r" lat \(ms,95%\): (\d+.\d+) err/s: (\d+.\d+) reconn/s: (\d+.\d+)")
THROUGHPUT_PATTERN = r"Throughput.*?(\d+.\d+),"
LATENCY_PATTERN = r"95th.*?(\d+.\d+),"


def _json_knobs(text: Column) -> Column:
    """Python-style dict text -> map of strings; bare decimals are cut to integers, +5 and 007 normalized."""
    # Literals of Python that JSON spells differently; only as whole values.
    js = F.regexp_replace(text, "'", '"')
    for name, literal in (("True", "true"), ("False", "false"), ("None", "null")):
        js = F.regexp_replace(js, rf"(: *){name}(?=\s*[,}}])", f"$1{literal}")
    js = F.regexp_replace(js, r'(: *)(-?\d+)\.\d+(?=[,}\s])', "$1$2")
    knobs = F.from_json(js, "map<string,string>")
    return F.transform_values(knobs, lambda k, v: F.when(
        v.rlike(r"^\s*[-+]?\d+\s*$"), F.trim(v).try_cast("bigint").cast("string")).otherwise(v))


def last_wins(entries: Column) -> Column:
    """Map of (k, v) entries in order; a name that comes again replaces the one before."""
    later = F.transform(entries, lambda e, i: F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["k"] == e["k"]))
    return F.map_from_entries(F.filter(entries, lambda e, i: ~F.get(later, i) & e["k"].isNotNull()))


def parse_trial_log(lines: DataFrame, line: str = "line", valid_only: bool = False) -> DataFrame:
    """``{knobs}|name_value|...|[internal metrics]|65d`` -> knobs, metrics, internal."""
    body = F.when(F.instr(line, "{") > 0, F.expr(f"substr({line}, instr({line}, '{{'))")).otherwise(F.col(line))
    t = lines.withColumn("__t", F.split(body, r"\|"))
    n = F.size("__t")
    pairs = F.when(n > 3, F.slice("__t", F.lit(2), F.greatest(n - 3, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    metrics = last_wins(F.transform(pairs, lambda p: F.struct(
        F.get(F.split(p, "_"), 0).alias("k"), F.get(F.split(p, "_"), 1).try_cast("double").alias("v"))))
    tail = F.when(F.trim(F.get(F.col("__t"), n - 1)) == FULL_MARK, F.get(F.col("__t"), n - 2)).otherwise(F.get(F.col("__t"), n - 1))
    values = F.when(n > 2, F.from_json(F.trim(tail), "array<double>"))
    t = t.withColumns({"knobs": _json_knobs(F.get(F.col("__t"), 0)), "metrics": metrics, "__im": values}).drop("__t")
    has = F.coalesce(F.size("__im") > 0, F.lit(False))
    if valid_only:
        t = t.filter(has)
    nulls = F.array_repeat(F.lit(None).cast("double"), N_METRICS)
    return t.withColumn("internal", F.when(has, F.col("__im")).otherwise(nulls)).drop("__im")


def parse_trial_log_defaults(lines: DataFrame, defaults: dict[str, str], line: str = "line") -> DataFrame:
    """One column per default knob, filled when absent; other knobs are dropped."""
    t = parse_trial_log(lines, line)
    return t.withColumns({k: F.coalesce(F.try_element_at(F.col("knobs"), F.lit(k)), F.lit(v)) for k, v in defaults.items()}).drop("knobs", "internal")


def parse_trial_log_space(lines: DataFrame, space: dict[str, dict], metric: str, order: str, line: str = "line") -> DataFrame:
    """Knobs of the space with defaults, oversize ones in thousands, one metric; the last line of a configuration wins."""
    t = parse_trial_log(lines, line)
    cols = {}
    for k, d in space.items():
        v = F.coalesce(F.try_element_at(F.col("knobs"), F.lit(k)), F.lit(str(d["default"])))
        if d.get("max") is not None and d["max"] > 2 ** 63 - 1:
            v = F.when(v.try_cast("bigint").isNotNull(), F.floor(v.try_cast("bigint") / 1000).cast("string")).otherwise(v)
        cols[k] = v
    t = t.withColumns(cols | {"perf": F.try_element_at(F.col("metrics"), F.lit(metric))})
    return t.groupBy(*space).agg(F.max_by("perf", order).alias("perf"))


def parse_res_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """``knobstring|tps|lat|..|cpu|..|[metrics]`` -> numbers, knob names, tps, latency, cpu, metrics."""
    t = lines.withColumn("__t", F.split(F.trim(line), r"\|"))
    n = F.size("__t")
    knob = F.get(F.col("__t"), 0)
    names = F.regexp_extract_all(F.regexp_replace(knob, "[A-Z]+", "1"), F.lit(r"(\D+)"), F.lit(1))
    names = F.transform(F.filter(names, lambda x: x != "."), lambda x: F.trim(x, F.lit("_")))
    tail = F.when(F.get(F.col("__t"), n - 1) == FULL_MARK, F.get(F.col("__t"), n - 2)).otherwise(F.get(F.col("__t"), n - 1))
    return t.withColumns({
        "numbers": F.transform(F.regexp_extract_all(knob, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double")),
        "names": names, "tps": F.get(F.col("__t"), 1).try_cast("double"), "latency": F.get(F.col("__t"), 2).try_cast("double"),
        "cpu": F.get(F.col("__t"), 4).try_cast("double"), "internal": F.from_json(tail, "array<double>")}).drop("__t")


def _group(pattern: str, i: int, line: str = "line") -> Column:
    return F.regexp_extract(line, pattern, i).try_cast("double")


def bench_tpcc(lines: DataFrame) -> DataFrame:
    """Means over the matching lines of a file; a file without one has zeros."""
    return lines.groupBy("file").agg(*[F.coalesce(F.avg(_group(TPCC_PATTERN, i)), F.lit(0.0)).alias(c) for c, i in (("tps", 1), ("latency", 3))])


def bench_sysbench(lines: DataFrame) -> DataFrame:
    """Means and sample variances per file; -1 when a file has under 80 % of the last accepted file's samples.

    The accept rule is a fold over one small row per file, in file order.
    """
    hit = lines.filter(F.col("line").rlike(SYSBENCH_PATTERN))
    per = hit.groupBy("file").agg(
        F.count(F.lit(1)).alias("n"), F.avg(_group(SYSBENCH_PATTERN, 1)).alias("tps"), F.avg(_group(SYSBENCH_PATTERN, 6)).alias("latency"),
        F.avg(_group(SYSBENCH_PATTERN, 2)).alias("qps"), F.var_samp(_group(SYSBENCH_PATTERN, 1)).alias("tps_var"),
        F.var_samp(_group(SYSBENCH_PATTERN, 6)).alias("latency_var"), F.var_samp(_group(SYSBENCH_PATTERN, 2)).alias("qps_var"))
    files = lines.select("file").distinct().join(per.select("file", "n"), "file", "left").fillna(0, ["n"])
    items = files.agg(F.sort_array(F.collect_list(F.struct("file", "n"))).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("ref"), F.array().cast("array<struct<file:string,ok:boolean>>").alias("out"))

    def step(acc, f):
        ok = f["n"] >= acc["ref"] * 0.8
        return F.struct(F.when(ok, f["n"]).otherwise(acc["ref"]).alias("ref"),
                        F.concat(acc["out"], F.array(F.struct(f["file"].alias("file"), ok.alias("ok")))).alias("out"))

    accepted = items.select(F.explode(F.aggregate("items", start, step)["out"]).alias("o")).select("o.file", "o.ok")
    out = accepted.join(per, "file", "left")
    return out.select("file", *[F.when(F.col("ok"), F.col(c)).otherwise(F.lit(-1.0)).alias(c)
                                for c in ("tps", "latency", "qps", "tps_var", "latency_var", "qps_var")])


def bench_job(lines: DataFrame, n_queries: int, timeout: float) -> DataFrame:
    """Latency of every query (last tab field, ms), unfinished ones at the timeout: p95, throughput, variance."""
    body = lines.filter((F.col("line_no") > 0) & (F.trim("line") != ""))
    lat = body.select("file", (F.trim(F.element_at(F.split("line", "\t"), -1)).try_cast("double") / 1000).alias("v"))
    counts = lines.groupBy("file").agg(F.count_if((F.col("line_no") > 0) & (F.trim("line") != "")).alias("n"))
    pad = counts.filter(F.col("n") < n_queries).select("file", F.explode(F.sequence(F.col("n") + 1, F.lit(n_queries).cast("long"))).alias("i"))
    full = lat.unionByName(pad.select("file", F.lit(float(timeout)).alias("v")))
    stats = full.groupBy("file").agg(
        (F.count(F.lit(1)) * 60.0 / F.least(F.lit(float(timeout)), F.max("v"))).alias("tps"), F.var_samp("v").alias("latency_var"))
    return stats.join(quantiles(full, ["file"], "v", {"p95": 0.95}), "file")


def bench_cloud(lines: DataFrame) -> DataFrame:
    """Mean request rate of a file; null for a file without a rate."""
    value = F.get(F.split(F.get(F.split(F.trim("line"), r"\s+"), 6), ":"), 1).try_cast("double")
    return lines.groupBy("file").agg(F.avg(F.when(F.col("line").contains("Request/s"), value)).alias("qps"))


def bench_oltp(lines: DataFrame) -> DataFrame:
    """First throughput and first 95th percentile of a summary file."""
    t = lines.withColumns({"__a": F.nullif(F.regexp_extract("line", THROUGHPUT_PATTERN, 1), F.lit("")),
                           "__b": F.nullif(F.regexp_extract("line", LATENCY_PATTERN, 1), F.lit(""))})
    return t.groupBy("file").agg(
        F.min_by(F.col("__a").try_cast("double"), F.when(F.col("__a").isNotNull(), F.col("line_no"))).alias("tps"),
        F.min_by(F.col("__b").try_cast("double"), F.when(F.col("__b").isNotNull(), F.col("line_no"))).alias("latency"))


def parse_kv_config(lines: DataFrame, line: str = "line") -> DataFrame:
    """``key = value`` lines of exactly three words; sections, comments and blanks are skipped."""
    part = F.split(F.trim(line), r"\s+")
    keep = ~F.trim(line).rlike(r"^(\[|#|skip-external-locking|$)") & (F.size(part) == 3)
    return lines.filter(keep).withColumns({"key": F.get(part, 0), "value": F.get(part, 2)})


def parse_run_log(lines: DataFrame) -> DataFrame:
    """Iterations of optimizer logs: config map, result and running minimum per file.

    An ``[INFO]`` line opens an iteration, ``name, Value: v`` or ``name, Constant: v``
    lines belong to it, ``, result is: p`` closes it.
    """
    t = lines.withColumn("__open", F.col("line").startswith("[INFO]").cast("long"))
    t = with_running(t, ["file"], ["line_no"], {"iter": ("sum", "__open")})
    entry = r"(.*), (?:Value|Constant): (.*)"
    t = t.withColumns({"__k": F.nullif(F.regexp_extract("line", entry, 1), F.lit("")), "__v": F.regexp_extract("line", entry, 2),
                       "__p": F.nullif(F.regexp_extract("line", r"^, result is: (.*)", 1), F.lit(""))})
    it = t.filter("iter > 0").groupBy("file", "iter").agg(
        F.sort_array(F.collect_list(F.when(F.col("__k").isNotNull(), F.struct("line_no", F.col("__k").alias("k"), F.col("__v").alias("v"))))).alias("__e"),
        F.max(F.col("__p").try_cast("double")).alias("perf"))
    entries = F.transform("__e", lambda e: F.struct(e["k"].alias("k"), e["v"].alias("v")))
    it = it.select("file", "iter", last_wins(entries).alias("config"), "perf")
    return with_running(it, ["file"], ["iter"], {"lower_bound": ("min", "perf")})


