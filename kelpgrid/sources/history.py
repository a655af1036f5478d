"""Run tables, history documents and parameter catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kelpgrid.functions.ordering import with_row_number
from kelpgrid.session import materialize

INFO_SCHEMA = "objs array<string>, constraints array<string>"
RUN_SCHEMA = ("configuration map<string,string>, external_metrics map<string,double>, internal_metrics array<double>, "
              "resource map<string,double>, context array<double>, trial_state int, elapsed_time double, iter_time double")
HISTORY_SCHEMA = f"info struct<{INFO_SCHEMA}>, data array<struct<{RUN_SCHEMA}>>"
# Fixed value: a metric that says "no value".
NO_VALUE = float(2 ** 31 - 1)
KNOB_SCHEMA = "map<string,struct<type:string,min:double,max:double,`default`:string,enum_values:array<string>>>"
SPACE_SCHEMA = ("struct<parameters:map<string,struct<type:string,bound:array<double>,`default`:string,log:string,q:double,"
                "choice:array<string>,value:string>>>")
MAX_INT = 9.223372036854775807e18
# Type names a space description may use.
TYPE_ALIASES = {"float": "float", "real": "float", "int": "integer", "integer": "integer", "cat": "enum", "cate": "enum",
                "categorical": "enum", "const": "constant", "constant": "constant"}
# Tuner parameters of an application run, as (name, input column, factor).
WARM_START = [
    ("executor_cores", 8, 1.0), ("executor_num", 7, 1.0), ("mem_fraction", 12, 10.0), ("executor_mem", 9, 1.0),
    ("parallelism_vals", 3, 1.0), ("driver_cores", 4, 1.0), ("driver_mem", 5, 1.0), ("driver_max_result_size", 6, None),
    ("executor_memory_overhead", 10, 1 / 128), ("files_max_partition_bytes", 11, 1 / 64), ("mem_storage_fraction", 13, 10.0),
    ("reducer_max_size_in_flight", 14, 1 / 32), ("shuffle_compress", 15, 1.0), ("shuffle_file_buffer", 16, 1 / 32),
    ("shuffle_spill_compress", 17, 1.0), ("duration", 2, 1.0),
]
# Code of each allowed driver result size.
RESULT_SIZES = {0.2: 0, 0.5: 1, 1.0: 2, 2.0: 3, 4.0: 4}


def scan_trials_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def append_trials_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)


def read_history_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One JSON document per file -> ``(file, text)``."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def parse_history(docs: DataFrame, knobs: dict[str, str], first_n: int = -1) -> DataFrame:
    """History documents -> one row per run, with position in its file.

    Unknown knobs are dropped and missing ones take the default; ``iter_time``
    falls back to ``elapsed_time``; ``first_n`` keeps the first runs of a document;
    a metric of 2147483647 says "no value" and becomes null.
    """
    t = docs.withColumn("__d", F.from_json("text", HISTORY_SCHEMA))
    t = t.select(*[c for c in docs.columns if c != "text"], F.col("__d.info").alias("info"), F.posexplode("__d.data").alias("pos", "r"))
    if first_n >= 0:
        t = t.filter(F.col("pos") < first_n)
    return _run_columns(t, [c for c in docs.columns if c != "text"], knobs)


def _run_columns(t: DataFrame, keep: list[str], knobs: dict[str, str]) -> DataFrame:
    conf = F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(
        F.try_element_at(F.col("r.configuration"), F.lit(k)), F.lit(v)).alias("v")) for k, v in knobs.items()]))
    metrics = F.transform_values("r.external_metrics", lambda _, v: F.when(v != NO_VALUE, v))
    return t.select(*keep, "info", "pos", conf.alias("configuration"), metrics.alias("external_metrics"), "r.internal_metrics", "r.resource",
                    "r.context", "r.trial_state", "r.elapsed_time", F.coalesce("r.iter_time", "r.elapsed_time").alias("iter_time"))


def history_objectives(runs: DataFrame) -> DataFrame:
    """``objs`` and ``constraint_values`` in the order of the history's info.

    Metrics come from ``resource`` before ``external_metrics``; an objective ``-m``
    is the metric m, an objective ``m`` its negative, a constraint the metric as it
    is; absent metrics are null.
    """
    def value(name: Column) -> Column:
        return F.coalesce(F.try_element_at(F.col("resource"), name), F.try_element_at(F.col("external_metrics"), name))
    objs = F.transform("info.objs", lambda n: F.when(n.startswith("-"), value(F.substring(n, 2, 1 << 30))).otherwise(-value(n)))
    return runs.withColumns({"objs": objs, "constraint_values": F.transform("info.constraints", value)})


def write_history_documents(runs: DataFrame, path: str, history: str = "file", runs_per_file: int = 10_000, packed: bool = False) -> None:
    """History documents ``{"info": ..., "data": [...]}``, one folder per history, ``runs_per_file`` runs in each.

    ``packed``, for many small histories: a document is a line that also names its history and part, and a
    file holds all documents of a task, so that the number of files does not grow with that of histories.

    ``runs`` has the columns of ``parse_history``; ``pos`` counts the runs of a
    history from 0.  A history of any size is written by many tasks, each of which
    holds one document at a time; every document can be read on its own.  Missing
    values are written as null, so they come back as null.  Histories whose runs
    disagree about ``info`` end the job; a null or empty name is one history.
    """
    fields = ["configuration", "external_metrics", "internal_metrics", "resource", "context", "trial_state", "elapsed_time", "iter_time"]
    absent = {"ignoreNullFields": "false"}
    inner = F.regexp_replace(F.to_json(F.struct(*fields), absent), r"^\{|\}$", "")
    rows = runs.select(F.col(history).cast("string").alias("history"), F.floor(F.col("pos") / runs_per_file).alias("part"), F.col("pos").cast("long").alias("pos"),
                       F.to_json("info", absent).alias("info"), inner.alias("run"))
    docs = rows.groupBy("history", "part").agg(F.min("info").alias("info"), F.max("info").alias("other"), F.sort_array(F.collect_list(F.struct("pos", "run"))).alias("runs"))
    infos = rows.groupBy("history").agg(F.min("info").alias("first"), F.max("info").alias("last")).withColumnRenamed("history", "__history")
    docs = docs.join(infos, F.col("history").eqNullSafe(F.col("__history")))
    opens, ends = ("{", "}") if packed else ("\n    {\n      ", "\n    }")
    data = F.array_join(F.transform("runs", lambda x: F.concat(F.lit(opens), x["run"], F.lit(ends))), ",")
    info = F.coalesce("info", F.lit("null"))
    if packed:
        name = F.regexp_replace(F.to_json(F.struct("history", "part"), absent), r"\}$", "")
        text = F.concat(name, F.lit(',"info":'), info, F.lit(',"data":['), data, F.lit("]}"))
    else:
        text = F.concat(F.lit('{\n  "info": '), info, F.lit(',\n  "data": ['), data, F.lit("\n  ]\n}"))
    checked = F.when(F.col("first") == F.col("last"), text).when(F.col("first").isNull(), text).otherwise(
        F.raise_error(F.concat(F.lit("runs disagree about info: "), F.coalesce("history", F.lit("null")))))
    if packed:
        docs.select(checked.alias("value")).write.text(path)
    else:
        docs.select("history", "part", checked.alias("value")).write.partitionBy("history", "part").text(path)


def read_history_documents(spark: SparkSession, paths: str | list[str], knobs: dict[str, str], first_n: int = -1, written: bool = False,
                           packed: bool = False) -> DataFrame:
    """Documents of any size -> the rows of ``parse_history``, one per run, by ``file``.

    In a document indented by two spaces every run begins on a line of its own,
    ``    {``: Spark's text source splits the bytes there, so that many tasks read
    one document and none holds more than a run.  JSON text has no raw line
    break, so no value can look like that line.  Other layouts come as one record
    and are parsed whole.  ``written``: the folder is one that
    ``write_history_documents`` made; rows are then by ``history``, counted on over
    its documents.  ``packed``: it was written so.
    """
    written = written or packed
    source = spark.read if packed else spark.read.option("lineSep", "\n    {\n")
    if written and not packed:
        source = source.schema("value string, history string, part long")
    key, order = ("history", ["part", "__block", "__row"]) if written else ("file", ["__block", "__row"])
    text = source.text(paths)
    if packed:
        name = F.from_json("value", "history string, part long")
        text = text.withColumns({"history": F.nullif(name["history"], F.lit("")), "part": name["part"]})
    text = text.select(*([key, "part"] if written else [F.col("_metadata.file_path").alias("file")]), F.col("_metadata.file_path").alias("__file"),
                                     F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__row"), "value")
    text = materialize(text)
    if packed:
        whole = text.withColumn("__d", F.from_json("value", HISTORY_SCHEMA)).select(
            "history", "part", "__block", "__row", F.col("__d.info").alias("info"), F.posexplode("__d.data").alias("__at", "r"))
        return _numbered_runs(whole, key, order, knobs, first_n)
    is_head = F.ltrim("value").startswith("{")
    heads = text.filter(is_head).select(F.col("__file").alias("__of"), F.from_json(F.regexp_extract("value", r'(?s)^\s*\{\s*"info":\s*(\{.*\}),\s*"data":\s*\[\s*$', 1), INFO_SCHEMA).alias("info"))
    body = F.concat(F.lit("{"), F.regexp_replace("value", r"(?s)\n    \}(,|\s*\]\s*\}\s*)?$", ""), F.lit("}"))
    split = text.filter(~is_head).withColumn("r", F.from_json(body, RUN_SCHEMA)).withColumn("__at", F.lit(0))
    split = split.join(heads, F.col("__file") == F.col("__of")).drop("__of", "value")
    whole = text.filter(is_head).withColumn("__d", F.from_json("value", HISTORY_SCHEMA)).select(
        *[c for c in text.columns if c != "value"], F.col("__d.info").alias("info"), F.posexplode("__d.data").alias("__at", "r"))
    return _numbered_runs(split.unionByName(whole), key, order, knobs, first_n)


def _numbered_runs(t: DataFrame, key: str, order: list[str], knobs: dict[str, str], first_n: int) -> DataFrame:
    runs = with_row_number(t, [key], [*order, "__at"], "pos").withColumn("pos", F.col("pos") - 1)
    if first_n >= 0:
        runs = runs.filter(F.col("pos") < first_n)
    return _run_columns(runs, [key], knobs)


def write_history_json(trials: DataFrame, path: str) -> None:
    """One JSON line per run, a folder per task; a task of any size is written by many tasks."""
    trials.write.mode("overwrite").partitionBy("task_id").json(path)


def valid_histories(runs: DataFrame) -> DataFrame:
    """Files in which more than half of the runs succeeded."""
    return runs.groupBy("file").agg(F.avg((F.col("trial_state") == 0).cast("double")).alias("ok")).filter("ok > 0.5").select("file")


def _oversize(c: str, big: Column) -> Column:
    return F.when(big, F.floor(F.col(c).cast("double") / 1000).cast("double")).otherwise(F.col(c).cast("double"))


def load_knob_catalog(docs: DataFrame, first_n: int = -1) -> DataFrame:
    """JSON object name -> description: one row per knob; integers beyond 64 bits in thousands."""
    t = docs.withColumn("__m", F.from_json("text", KNOB_SCHEMA))
    t = t.select(*[c for c in docs.columns if c != "text"], F.posexplode("__m").alias("pos", "name", "k"))
    if first_n >= 0:
        t = t.filter(F.col("pos") < first_n)
    keep = [c for c in docs.columns if c != "text"]
    t = t.select(*keep, "pos", "name", "k.type", F.col("k.min").alias("min"), F.col("k.max").alias("max"),
                 F.col("k.default").alias("default"), F.col("k.enum_values").alias("choices"))
    big = (F.col("type") == "integer") & (F.col("max") > MAX_INT)
    default = F.when(big, _oversize("default", big).cast("string")).otherwise(F.col("default"))
    return t.select(*keep, "pos", "name", "type", _oversize("min", big).alias("min"), _oversize("max", big).alias("max"),
                    default.alias("default"), "choices")


def load_space_dict(docs: DataFrame) -> DataFrame:
    """``{"parameters": {name: {type, bound, default, log, q, choice, value}}}`` -> catalogue rows."""
    t = docs.withColumn("__m", F.from_json("text", SPACE_SCHEMA))
    keep = [c for c in docs.columns if c != "text"]
    t = t.select(*keep, F.explode("__m.parameters").alias("name", "p"))
    kind = F.try_element_at(F.create_map(*[F.lit(v) for kv in TYPE_ALIASES.items() for v in kv]), F.col("p.type"))
    return t.select(*keep, "name", kind.alias("type"), F.get("p.bound", 0).alias("min"), F.get("p.bound", 1).alias("max"),
                    F.coalesce("p.default", "p.value").alias("default"),
                    F.coalesce(F.lower("p.log") == "true", F.lit(False)).alias("log"), F.col("p.q").alias("q"), F.col("p.choice").alias("choices"))


def warm_start_rows(runs: DataFrame, app: str) -> DataFrame:
    """Runs of one application in tuner units; input columns c0 (application) to c17."""
    sizes = F.create_map(*[F.lit(float(v)) for kv in RESULT_SIZES.items() for v in kv])
    cols = [F.try_element_at(sizes, F.col(f"c{i}").cast("double")).alias(name) if factor is None
            else (F.col(f"c{i}").cast("double") * factor).alias(name) for name, i, factor in WARM_START]
    return runs.filter(F.col("c0") == app).select(*cols)
