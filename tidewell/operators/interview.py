"""Sessions, scores, reports and the rules of follow-up questions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import clamped, half_up
from ..functions.text import feedback_sentences
from ..session import small

#: The legal moves between states, and the limits of the rules.
TRANSITIONS = {
    "INIT": ("ASKING", "COMPLETED"),
    "ASKING": ("EVALUATING", "FOLLOW_UP", "COMPLETED"),
    "EVALUATING": ("ASKING", "FOLLOW_UP", "COMPLETED"),
    "FOLLOW_UP": ("EVALUATING", "ASKING", "COMPLETED"),
    "COMPLETED": (),
}
MOST_FOLLOW_UPS, LOW_SCORE = 2, 60


def page_of(rows: DataFrame, equal: Mapping[str, object], like: Mapping[str, str], order: Sequence[tuple[str, bool]], page: int, size: int) -> DataFrame:
    """A page of rows; conditions whose value is None are left out."""
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    for column, part in like.items():
        if part is not None:
            rows = rows.where(F.lower(column).contains(part.lower()))
    return rows.orderBy(*[F.col(c).asc() if up else F.col(c).desc() for c, up in order]).offset((page - 1) * size).limit(size)


def session_scores(turns: DataFrame) -> DataFrame:
    """session, mean of its main turns' clamped scores rounded half up (null without any), and how many."""
    main = F.col("score").isNotNull() & ~F.coalesce(F.col("is_follow_up"), F.lit(False))
    value = F.when(main, clamped(F.col("score")))
    return turns.groupBy("session").agg(half_up(F.avg(value)).alias("score"), F.count(value).alias("n_scored"))


def running_scores(turns: DataFrame) -> DataFrame:
    """The mean so far after each turn; follow-ups leave it as it is."""
    main = F.when(~F.coalesce(F.col("is_follow_up"), F.lit(False)), clamped(F.col("score")))
    w = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return turns.select("session", "seq", half_up(F.sum(main).over(w) / F.count(main).over(w)).alias("running"))


def weak_points(records: DataFrame, turns: DataFrame, threshold: int, since: Column, limit: int) -> DataFrame:
    """Main turns with a low score of sessions that ended since a time, latest sessions first, up to a limit."""
    done = records.where(F.col("status").isin("FINISHED", "EVALUATED") & (F.col("end_time") >= since))
    low = turns.where((F.col("score") < threshold) & ~F.coalesce(F.col("is_follow_up"), F.lit(False)))
    return low.join(done, "session").orderBy(F.desc("end_time"), "session", "seq").limit(limit)


def follow_up(ai: Column, completed: Column, count: Column, score: Column, missing: Column, most: int = MOST_FOLLOW_UPS) -> Column:
    """The reason of a follow-up question, or why there is none: guards first, then the first rule that fires."""
    return (
        F.when(completed, "INTERVIEW_COMPLETED").when(count >= most, "FOLLOW_UP_LIMIT_REACHED").when(F.coalesce(ai, F.lit(False)), "AI_SUGGESTED")
        .when(score < LOW_SCORE, "LOW_SCORE").when(F.coalesce(missing, F.lit(0)) > 0, "MISSING_POINTS").otherwise("NO_TRIGGER")
    )


def illegal_moves(states: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """Rows whose state may not follow the one before."""
    w = Window.partitionBy(key).orderBy(order)
    legal = F.create_map(*[x for s, to in TRANSITIONS.items() for x in (F.lit(s), F.array(*[F.lit(t) for t in to]).cast("array<string>"))])
    moved = states.withColumn("previous", F.lag(state).over(w))
    return moved.where(F.col("previous").isNotNull() & ~F.coalesce(F.array_contains(legal[F.col("previous")], F.col(state)), F.lit(False)))


def regressions(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value falls below an earlier one."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("highest", F.max(value).over(w)).where(F.col(value) < F.col("highest"))


def highlights(turns: DataFrame, low: int, high: int, most: int = 3) -> DataFrame:
    """The first distinct feedback sentences of turns with a score in low..high."""
    said = turns.where(F.col("score").between(low, high)).select("session", "seq", F.posexplode(feedback_sentences(F.col("feedback"))).alias("pos", "sentence"))
    once = said.groupBy("session", "sentence").agg(F.min(F.struct("seq", "pos")).alias("at"))
    w = Window.partitionBy("session").orderBy("at")
    return once.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("session", "sentence", "n")


def next_sequence(turns: DataFrame, stored: DataFrame) -> DataFrame:
    """New turns, each request once, numbered after those stored (session, last_seq)."""
    once = turns.groupBy("session", "request").agg(F.min("at").alias("at"))
    w = Window.partitionBy("session").orderBy("at", "request")
    return once.join(small(stored), "session", "left").select("session", "request", (F.coalesce("last_seq", F.lit(0)) + F.row_number().over(w)).alias("seq"))


def preferred_source(turns: DataFrame, order: Sequence[str]) -> DataFrame:
    """Per session the turns of the first source that has any."""
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("source"))
    ranked = turns.withColumn("__r", rank).where("__r > 0")
    return ranked.withColumn("__m", F.min("__r").over(Window.partitionBy("session"))).where("__r = __m").drop("__r", "__m")


def transcript(events: DataFrame) -> DataFrame:
    """Text of sessions from segment events (session, at, kind, id, low, high, text): `apd` sets a segment, `rpl` clears those of a range first."""
    cleared = events.where("kind = 'rpl'").select("session", F.col("at").alias("cleared_at"), "low", "high")
    pieces = events.select("session", "at", "id", "text").alias("p").join(cleared.alias("c"), (F.col("p.session") == F.col("c.session")) & (F.col("c.cleared_at") > F.col("p.at")) & F.col("p.id").between(F.col("c.low"), F.col("c.high")), "left_anti")
    last = pieces.groupBy("session", "id").agg(F.max_by("text", "at").alias("text"))
    return last.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), "").alias("text"))


def playback(turns: DataFrame) -> DataFrame:
    """Items of a session's turns (session, turns: an array in order): numbered from 1, a null turn keeps its number and gives none."""
    return turns.select("session", F.posexplode("turns").alias("pos", "turn")).where(F.col("turn").isNotNull()).select("session", (F.col("pos") + 1).alias("seq"), "turn")


#: Dimensions of a report in order of precedence, their names, and comments by band.
DIMENSIONS = {"resume_score": "resume fit", "interview_performance": "interview performance", "demeanor_evaluation": "demeanor", "professional_skills": "professional skills"}
COMMENTS = (
    (85, "Overall performance is strong and already competitive for interviews."),
    (70, "Overall performance is solid, with clear strengths and room for further polishing."),
    (60, "Overall performance meets the baseline, but answer structure and role-fit still need improvement."),
    (None, "Overall performance is below expectation; prioritize role-fit, depth of answers, and communication stability."),
)


def extreme_dimension(scores: Mapping[str, Column], strongest: bool = True) -> Column:
    """The name of the highest (or lowest) of several columns, the first on ties; a null score is 0."""
    value = lambda c: F.coalesce(c, F.lit(0))
    order = F.array_sort(F.array(*[F.struct((-value(c) if strongest else value(c)).alias("by"), F.lit(k).alias("at"), F.lit(name).alias("name")) for k, (name, c) in enumerate(scores.items())]))
    return F.get(order, 0)["name"]


def overall_comment(final: Column, strongest: Column, weakest: Column) -> Column:
    """The comment of the score's band, with the strongest and the weakest dimension where they differ and are known."""
    score = F.coalesce(final, F.lit(0))
    base = F.lit(COMMENTS[-1][1])
    for least, words in reversed(COMMENTS[:-1]):
        base = F.when(score >= least, words).otherwise(base)
    names = F.concat(base, F.lit(" Current strength is "), strongest, F.lit(", and prioritize improving "), weakest, F.lit("."))
    told = (F.trim(F.coalesce(strongest, F.lit(""))) != "") & (F.trim(F.coalesce(weakest, F.lit(""))) != "") & (strongest != weakest)
    return F.when(told, names).otherwise(base)


def next_actions(suggestions: Column, tips: Column, most: int = 3) -> Column:
    """The first distinct suggestions, then tips."""
    none = F.array().cast("array<string>")
    return F.slice(F.array_distinct(F.concat(F.coalesce(suggestions, none), F.coalesce(tips, none))), 1, most)


def follow_up_needed(told: Column, logic_ok: Column, missing: Column, question: Column) -> Column:
    """What the evaluation told, else whether logic fails, points are missing, or a question is given."""
    inferred = ~F.coalesce(logic_ok, F.lit(False)) | (F.coalesce(F.size(missing), F.lit(0)) > 0) | (F.trim(F.coalesce(question, F.lit(""))) != "")
    return F.coalesce(told, inferred)


def question_progress(answers: DataFrame) -> DataFrame:
    """session, seq, main, follow_ups of answers (session, seq, is_follow_up): the number of the main question, and of follow-ups since it began."""
    w = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mains = answers.withColumn("main", F.count_if(~F.col("is_follow_up")).over(w))
    own = Window.partitionBy("session", "main").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return mains.select("session", "seq", "main", F.count_if(F.col("is_follow_up")).over(own).alias("follow_ups"))


def flow_of_last_turn(turns: DataFrame, totals: DataFrame) -> DataFrame:
    """session, state, question from the last of turns (session, seq, question, next_question, finished) and the number of questions (session, total):
    COMPLETED if finished or the last question is answered, ASKING the next one named or following, the first where nothing is known; no row without questions."""
    last = turns.groupBy("session").agg(F.max_by(F.struct("question", "next_question", "finished"), "seq").alias("t")).select("session", "t.*")
    told = F.trim(F.coalesce("next_question", F.lit(""))) != ""
    number = F.regexp_extract("question", r"^\s*(\d+)", 1).try_cast("int")
    done = F.coalesce("finished", F.lit(False)) | (~told & F.coalesce((F.col("total") > 0) & (number >= F.col("total")), F.lit(False)))
    following = F.when(told, F.trim("next_question")).when(number.isNotNull(), (number + 1).cast("string")).when(F.col("total") > 0, "1")
    state = F.when(done, "COMPLETED").when(following.isNotNull(), "ASKING")
    return totals.join(last, "session", "left").select("session", state.alias("state"), F.when(~done, following).alias("question")).where(F.col("state").isNotNull())


def runtime_confidence(terminal: Column, n_questions: Column, has_flow: Column) -> Column:
    return F.when(F.coalesce(terminal, F.lit(False)), "TERMINAL").when((n_questions > 0) & has_flow, "EXACT").when(n_questions > 0, "DERIVED").otherwise("READ_ONLY")


def duration_seconds(start: Column, end: Column) -> Column:
    """Whole seconds; null if an end is unknown, 0 for none or less."""
    ms = F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))
    return F.when(ms.isNotNull(), F.greatest(F.lit(0), F.floor(ms / 1000)))


def first_told(*values: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values])


def rebuilt_aggregate(turns: DataFrame) -> DataFrame:
    """session, score_sum, score_count, total_score from all main turns (session, score, is_follow_up): scores are clamped, the mean is rounded half up, 0 without any."""
    score = F.when(F.col("score").isNotNull() & ~F.coalesce("is_follow_up", F.lit(False)), F.greatest(F.lit(0), F.least(F.lit(100), F.col("score"))))
    sums = turns.groupBy("session").agg(F.coalesce(F.sum(score), F.lit(0)).alias("score_sum"), F.count(score).alias("score_count"))
    mean = F.when(F.col("score_count") > 0, F.floor(F.try_divide(2 * F.col("score_sum") + F.col("score_count"), 2 * F.col("score_count")))).otherwise(0)
    return sums.withColumn("total_score", mean.cast("long"))


def sessions_by_time(rows: DataFrame, key: str, at: str) -> DataFrame:
    """Each key once, the latest first."""
    return rows.groupBy(key).agg(F.max(at).alias(at)).orderBy(F.desc(at), key)
