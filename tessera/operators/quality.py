"""Fail-closed quality checks (DQ2, DQ4-DQ7, W14, A17, A20).

A check is a function returning a DataFrame ``(check, ok, message)``; checks
are registered per failure mode. ``check_table`` unions every check into one
lazy plan (each check is a small aggregate); ``gate_summary`` folds them per
mode and names the first failing mode in the declared order. ``enforce`` is the
fail-closed step: it runs the gate (one small result) and raises.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.session import checkpoint_dir

# The four failure modes in their declared order.
FAILURE_MODES = ["DATA_BREAKDOWN", "VALIDATION_BREACH", "COMPUTE_HALT", "SECURITY_FAILURE"]
MODE_DESCRIPTIONS = {
    "DATA_BREAKDOWN": "a required input is absent or incomplete",
    "VALIDATION_BREACH": "rows hold values outside their period of validity",
    "COMPUTE_HALT": "a job ended early or gave values that are not finite",
    "SECURITY_FAILURE": "the audit trail does not verify",
}

CHECK_SCHEMA = "mode string, check string, ok boolean, message string"


class GateFailed(Exception):
    def __init__(self, mode: str, reason: str):
        super().__init__(f"{mode}: {reason}")
        self.mode, self.reason = mode, reason


class CheckRegistry:
    """DQ6: pluggable checks per failure mode."""

    def __init__(self):
        self._checks: list[tuple[str, str, Callable[[], DataFrame]]] = []

    def register(self, mode: str, name: str, fn: Callable[[], DataFrame]) -> None:
        if mode not in FAILURE_MODES:
            raise ValueError(f"unknown failure mode {mode!r}")
        self._checks.append((mode, name, fn))

    def check_table(self, spark: SparkSession) -> DataFrame:
        """All check results in one frame. Each check runs once, here, and its rows go
        to the shared checkpoint folder; a check that fails to build or to run
        counts as failed with its error as the message."""
        checkpoint_dir(spark)
        parts = []
        for mode, name, fn in self._checks:
            try:
                df = fn().select(F.lit(mode).alias("mode"), F.lit(name).alias("check"),
                                 F.col("ok").cast("boolean").alias("ok"), F.col("message").cast("string")) \
                    .checkpoint(eager=True)
            except Exception as e:  # noqa: BLE001 - a broken check fails closed
                df = spark.createDataFrame([(mode, name, False, f"check could not run: {str(e).splitlines()[0] if str(e) else type(e).__name__}")], CHECK_SCHEMA)
            parts.append(df)
        if not parts:
            return spark.createDataFrame([], CHECK_SCHEMA)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def gate_summary(checks: DataFrame, modes: list[str] = FAILURE_MODES) -> DataFrame:
    """DQ7 + W14 + F4: per mode, ok when every check passed (a mode without
    checks passes), failure messages joined with '; ' in check order, and the
    first failing mode in the declared order."""
    spark = checks.sparkSession
    order = spark.createDataFrame([(m, i) for i, m in enumerate(modes)], "mode string, mode_order int")
    per = checks.groupBy("mode").agg(
        F.bool_and("ok").alias("ok"), F.count(F.lit(1)).alias("checks"),
        F.concat_ws("; ", F.transform(F.sort_array(F.collect_list(
            F.when(~F.col("ok"), F.struct("check", "message")))), lambda s: s["message"])).alias("failures"))
    full = F.broadcast(order).join(per, "mode", "left").select(
        "mode", "mode_order", F.coalesce("ok", F.lit(True)).alias("ok"),
        F.coalesce("checks", F.lit(0)).cast("long").alias("checks"),
        F.coalesce("failures", F.lit("")).alias("failures"))
    first = full.agg(F.min_by(F.when(~F.col("ok"), F.col("mode")),
                              F.when(~F.col("ok"), F.col("mode_order")))).scalar()
    return full.withColumn("first_failure", first).drop("mode_order")


def enforce(checks: DataFrame) -> None:
    """Fail closed: raise ``GateFailed`` for the first failing mode."""
    rows = gate_summary(checks).filter(~F.col("ok")).collect()  # <= 4 rows
    if rows:
        first = rows[0]["first_failure"]
        reason = next(r["failures"] for r in rows if r["mode"] == first)
        raise GateFailed(first, reason)


def termination_record(summary: DataFrame, run_id: str, as_of) -> DataFrame:
    """S8 + DQ11: one row per run describing how the gate ended it: status
    COMPLETED or TERMINATED, the first failing mode, its description and
    reason, and the trust flags every machine-written record carries. Write
    it with ``sources.io.write_json_rows`` (append)."""
    spark = summary.sparkSession
    desc = spark.createDataFrame(list(MODE_DESCRIPTIONS.items()), "mode string, description string")
    first = summary.agg(F.first("first_failure", ignorenulls=True).alias("failure_mode"))
    reasons = summary.filter(~F.col("ok")).select(F.col("mode").alias("failure_mode"), F.col("failures").alias("reason"))
    rec = (first.join(reasons, "failure_mode", "left")
                .join(F.broadcast(desc.withColumnRenamed("mode", "failure_mode")), "failure_mode", "left"))
    return rec.select(
        F.lit(run_id).alias("run_id"), F.lit(as_of).cast("timestamp").alias("timestamp"),
        F.when(F.col("failure_mode").isNull(), F.lit("COMPLETED")).otherwise(F.lit("TERMINATED")).alias("status"),
        "failure_mode", "description", "reason",
        F.lit(True).alias("machine_generated"), F.lit(False).alias("operator_editable"))


# ---------------------------------------------------------------- building blocks
def violation_check(violations: DataFrame, count_col: str = "violations",
                    label: str = "Temporal violations") -> DataFrame:
    """DQ4: fail when the summed violations are > 0. No result (NULL sum) is
    'pending' and passes, as in the original."""
    total = violations.agg(F.sum(count_col).alias("n"))
    return total.select(
        F.coalesce(F.col("n") == 0, F.lit(True)).alias("ok"),
        F.when(F.col("n").isNull(), F.lit(f"{label} pending"))
         .when(F.col("n") > 0, F.concat(F.lit(f"{label}: "), F.col("n").cast("string")))
         .otherwise(F.lit(f"{label} OK")).alias("message"))


def completeness_checks(df: DataFrame, table_name: str, columns: list[str],
                        max_null_share: float = 0.0) -> DataFrame:
    """DQ5 (re-aimed): the table has rows and each required column's null
    share is at most ``max_null_share``; one aggregate for all columns."""
    aggs = [F.count(F.lit(1)).alias("_rows")] + [F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    row = df.agg(*aggs)
    found = [F.struct(F.lit(f"{table_name}:rows").alias("check"), (F.col("_rows") > 0).alias("ok"),
                      F.concat(F.lit(f"{table_name} rows: "), F.col("_rows").cast("string")).alias("message"))]
    for c in columns:
        share = F.try_divide(F.col(c).cast("double"), F.col("_rows").cast("double"))
        found.append(F.struct(
            F.lit(f"{table_name}.{c}:nulls").alias("check"),
            (F.coalesce(share, F.lit(0.0)) <= max_null_share).alias("ok"),
            F.concat(F.lit(f"{table_name}.{c} nulls: "), F.col(c).cast("string")).alias("message")))
    return row.select(F.inline(F.array(*found)))


def null_zero_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """DQ2: per column, NULLs (no measurement) and zeros (measured zero)
    counted apart, in one aggregate."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c in columns:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}__n"), F.count_if(F.col(c) == 0).alias(f"{c}__z")]
    row = df.agg(*aggs)
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__n").alias("nulls"),
                                           F.col(f"{c}__z").alias("zeros")) for c in columns]))
    return row.select(F.col("_rows").alias("rows"), stacked.alias("s")).select("s.column", "rows", "s.nulls", "s.zeros")


def with_rows_checked(df: DataFrame, name: str = "rows_checked") -> tuple[DataFrame, Observation]:
    """Count the rows an action really processed (proof of work)."""
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows_checked")), obs


# ---------------------------------------------------------------- A17
def run_summary(log: DataFrame, run_id: Column, ts: str, success: Column, phase: Column) -> DataFrame:
    """Per run, phases done / total, start, end, duration and status;
    the failure reason is the first failed phase. Plain aggregates (the phase
    list itself stays the long input table)."""
    r = log.select(run_id.alias("run_id"), F.col(ts).alias("ts"), success.alias("success"), phase.alias("phase"))
    start, end = F.min("ts"), F.max("ts")
    first_fail = F.min(F.when(~F.col("success"), F.struct("ts", "phase")))
    agg = r.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("phases_total"), F.count_if("success").alias("phases_completed"),
        start.alias("start_time"), end.alias("end_time"), first_fail.alias("_ff"))
    dur = (F.unix_micros(F.col("end_time").cast("timestamp")) - F.unix_micros(F.col("start_time").cast("timestamp")))
    return agg.select(
        "run_id", F.when(F.col("_ff").isNull(), F.lit("COMPLETED")).otherwise(F.lit("TERMINATED")).alias("status"),
        "start_time", "end_time", (dur / F.lit(1000.0)).alias("duration_ms"),
        "phases_completed", "phases_total", F.col("_ff.phase").alias("failure_phase"))
