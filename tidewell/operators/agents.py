"""Scorecards of agent tasks: paths, rules on the tools called, outcomes, failure classes and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tools that decide a path, and words of tasks on time and weather.
RESEARCH, RECALL = "re_search", "recall_memory"
REALTIME = ("几点", "天气", "几号", "日期", "温度", "时间")
#: Classes of failed tasks in order of precedence.
FAILURES = ("arguments", "wrong tool", "missing tool", "detour", "missing points")


def subset(part: Column, whole: Column) -> Column:
    """Whether every element of an array is in another; the empty array is in all."""
    return F.size(F.array_except(part, whole)) == 0


def covered(actual: Column, expected: Column) -> Column:
    """Every expected tool was called, in any order."""
    return subset(expected, actual)


def no_extra(actual: Column, expected: Column) -> Column:
    """No tool was called that was not expected; searching again is always allowed."""
    return subset(actual, F.array_union(expected, F.array(F.lit(RESEARCH))))


def required_given(required: Column, given: Column) -> Column:
    """Whether a call's arguments (names) hold all that its tool requires; a tool without a schema requires none."""
    return subset(F.coalesce(required, F.array().cast("array<string>")), F.coalesce(given, F.array().cast("array<string>")))


def path_of(tools: Column, turns: Column, text: Column, realtime: tuple[str, ...] = REALTIME) -> Column:
    """reselect, memory, knowledge_multi, realtime, casual or knowledge_single, from the expected tools, the number of turns and the task's text."""
    timely = F.exists(F.array(*[F.lit(w) for w in realtime]), lambda w: F.contains(text, w))
    return (
        F.when(F.array_contains(tools, RESEARCH), "reselect").when(F.array_contains(tools, RECALL), "memory").when(turns > 1, "knowledge_multi")
        .when((F.size(tools) == 0) & timely, "realtime").when(F.size(tools) == 0, "casual").otherwise("knowledge_single")
    )


def path_coverage(tasks: DataFrame) -> DataFrame:
    """path, n."""
    return tasks.groupBy("path").agg(F.count("*").alias("n"))


def outcome(answer: Column, actual: Column, expected: Column, points: Column) -> Column:
    """The expected tools were called and the answer holds every point."""
    return covered(actual, expected) & F.forall(points, lambda p: F.contains(F.coalesce(answer, F.lit("")), p))


def failure_of(args_ok: Column, extra_ok: Column, cover_ok: Column, n_calls: Column, n_expected: Column) -> Column:
    wrong = lambda c: F.coalesce(~c, F.lit(False))
    arguments, tool, missing, detour, points = FAILURES
    return F.when(wrong(args_ok), arguments).when(wrong(extra_ok), tool).when(wrong(cover_ok), missing).when(n_calls > n_expected + 1, detour).otherwise(points)


def rate(flag: Column) -> Column:
    """The share of true among those known, 4 digits; null where none is."""
    return F.round(F.avg(flag.cast("int")), 4)


def scorecard(tasks: DataFrame) -> DataFrame:
    """One row over tasks (passed, tool_correct, no_extra, args_ok, grounding, tool_count, tokens, duration_ms): rates are over the tasks for which they are known."""
    p = lambda q: F.round(F.coalesce(F.percentile("duration_ms", q), F.lit(0.0)), 1)
    traced = F.col("tool_correct").isNotNull()
    return tasks.agg(
        F.count("*").alias("n"), F.coalesce(rate(F.col("passed")), F.lit(0.0)).alias("pass_rate"), rate(F.col("tool_correct")).alias("tool_correct_rate"),
        rate(F.when(traced, F.col("no_extra"))).alias("no_extra_rate"), rate(F.when(traced, F.col("args_ok"))).alias("args_rate"), F.round(F.avg("grounding"), 4).alias("grounding"),
        F.round(F.coalesce(F.avg("tool_count"), F.lit(0.0)), 2).alias("avg_tool_count"), F.round(F.avg("tokens"), 1).alias("avg_tokens"), p(0.5).alias("p50_ms"), p(0.95).alias("p95_ms"),
    )


def pass_by_path(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("path").agg(F.count("*").alias("n"), F.coalesce(rate(F.col("passed")), F.lit(0.0)).alias("pass_rate"))


def grounding(calls: DataFrame) -> DataFrame:
    """trace_id and the share of its calls (trace_id, result_ok) that succeeded; a trace without calls has no row."""
    return calls.groupBy("trace_id").agg(F.avg(F.coalesce(F.col("result_ok").cast("int"), F.lit(0))).alias("grounding"))


def calls_of_latest_trace(traces: DataFrame, calls: DataFrame) -> DataFrame:
    """The calls (trace_id, ...) of each session's latest trace (session, trace_id, created_at), the greater id on ties."""
    latest = traces.groupBy("session").agg(F.max_by("trace_id", F.struct("created_at", "trace_id")).alias("trace_id"))
    return latest.join(calls, "trace_id")
