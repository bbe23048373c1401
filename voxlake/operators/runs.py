"""Run ledgers: append-only events, state by latest event, reports over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxlake import constants as K

_STAGE = "struct<status:string,count:long,inserted:long,skipped:long,error:struct<class:string,message:string>>"
_DIAGNOSTICS = (
    "struct<backend_requested:string,backend_used:string,fallback_activated:boolean,"
    "first_failing_stage:string,error_summary:string,stages:struct<"
    + ",".join(f"{s}:{_STAGE}" for s in K.RUN_STAGES)
    + ">>"
)


def run_state(events: DataFrame) -> DataFrame:
    """Current row of each run: its latest event."""
    columns = [c for c in events.columns if c != "run_id"]
    return (
        events.groupBy("run_id")
        .agg(F.max_by(F.struct(*columns), "event_seq").alias("s"))
        .select("run_id", "s.*")
    )


def metrics_by_platform(runs: DataFrame) -> DataFrame:
    return (
        runs.groupBy(F.col("source_name").alias("platform"))
        .agg(
            F.sum("records_fetched").alias("fetched"),
            F.sum("records_inserted").alias("inserted"),
            F.count_if(F.col("status") == "failed").alias("errors"),
            F.max("completed_at").alias("last_completed_at"),
        )
        .orderBy(F.desc_nulls_last("last_completed_at"), "platform")
    )


def recent_runs(runs: DataFrame, order: str = "run_id", n: int = K.RECENT_RUNS) -> DataFrame:
    return runs.orderBy(F.desc(order)).limit(n)


def parse_diagnostics(text: Column) -> Column:
    """Run diagnostics; NULL where the text is no JSON object or an empty one."""
    is_object = text.rlike(r"^\s*\{\s*[^}\s]") & F.try_parse_json(text).isNotNull()
    return F.when(is_object, F.from_json(text, _DIAGNOSTICS))


def stage_rows(runs: DataFrame) -> DataFrame:
    """One row per run and stage, for runs with readable diagnostics."""
    parsed = runs.select(
        "run_id", F.inline(F.array(F.struct(parse_diagnostics(F.col("error_message")).alias("d"))))
    ).where(F.col("d").isNotNull())
    stages = F.array(
        *[
            F.struct(
                F.lit(i).alias("stage_no"),
                F.lit(name).alias("stage"),
                F.coalesce(F.col(f"d.stages.{name}.status"), F.lit("unknown")).alias("status"),
                F.col(f"d.stages.{name}.count").alias("count"),
                F.col(f"d.stages.{name}.inserted").alias("inserted"),
                F.col(f"d.stages.{name}.skipped").alias("dedupe_skipped"),
                F.col(f"d.stages.{name}.error.class").alias("error_class"),
                F.col(f"d.stages.{name}.error.message").alias("error_message"),
            )
            for i, name in enumerate(K.RUN_STAGES, start=1)
        ]
    )
    return parsed.select("run_id", F.inline(stages))
