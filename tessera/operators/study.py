"""Study memory: quizzes, progress, chat, analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import json_text, revision_line, session_title


def graded(attempts: DataFrame, by: list[str]) -> DataFrame:
    """Answers (selected, correct) graded; a missing answer is wrong."""
    right = F.coalesce(F.col("selected") == F.col("correct"), F.lit(False)).cast("int")
    out = attempts.groupBy(*by).agg(F.sum(right).alias("correct_count"), F.count("*").alias("total"))
    return out.withColumn("score", F.coalesce(F.try_divide(F.col("correct_count"), F.col("total")), F.lit(0.0)))


def graded_quiz(questions, answers):
    """Marks of an array of questions against an array of answers by position."""
    return F.transform(questions, lambda q, i: F.coalesce(F.get(answers, i) == q["correct_index"], F.lit(False)))


def progressed(results: DataFrame) -> DataFrame:
    """A5/M2: the latest score is a concept's mastery, what it lacks its weakness; attempts add up."""
    return results.groupBy("concept_node_id").agg(
        F.max_by("score", F.struct("at", "score")).alias("mastery_score"), (1 - F.max_by("score", F.struct("at", "score"))).alias("weakness_score"),
        F.max("at").alias("last_reviewed_at"), F.count("*").alias("attempt_count"),
    )


def progress_merged(held: DataFrame, results: DataFrame) -> DataFrame:
    """M2: held progress after new results: their latest score stands, attempts add up, concepts
    without new results stay as they are."""
    new = progressed(results).select("concept_node_id", *[F.col(c).alias(f"__{c}") for c in ("mastery_score", "weakness_score", "last_reviewed_at", "attempt_count")])
    both = held.join(new, "concept_node_id", "full_outer")
    latest = [F.coalesce(f"__{c}", c).alias(c) for c in ("mastery_score", "weakness_score", "last_reviewed_at")]
    return both.select("concept_node_id", *latest, (F.coalesce("attempt_count", F.lit(0)) + F.coalesce("__attempt_count", F.lit(0))).alias("attempt_count"))


def topic_progress(quizzes: DataFrame, nodes: DataFrame, progress: DataFrame) -> DataFrame:
    """Quizzes (quiz_id, workspace_id, topic) with the concept of that label, whatever its case
    (the least id of several), and its progress, if any."""
    key = F.lower(F.trim(F.col("label")))
    concepts = nodes.groupBy("workspace_id", key.alias("__topic")).agg(F.min("node_id").alias("concept_node_id"))
    found = quizzes.withColumn("__topic", F.lower(F.trim("topic"))).join(concepts, ["workspace_id", "__topic"], "left").drop("__topic")
    return found.join(progress, "concept_node_id", "left")


def with_progress(nodes: DataFrame, progress: DataFrame) -> DataFrame:
    """Concepts with their progress, if any."""
    return nodes.join(progress, "concept_node_id", "left")


def revision_plan(requests: DataFrame, progress: DataFrame) -> DataFrame:
    """A line for each requested concept that has progress, in the order asked.

    ``requests``: plan_id, ids (array)."""
    asked = requests.select("plan_id", F.posexplode("ids").alias("pos", "concept_node_id")).join(progress, "concept_node_id")
    lines = F.array_sort(F.collect_list(F.struct("pos", revision_line(F.col("concept_node_id"), F.col("mastery_score"), F.col("weakness_score"), F.col("attempt_count").cast("int")).alias("line"))))
    return asked.groupBy("plan_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("plan"))


def sessions(messages: DataFrame) -> DataFrame:
    """Sessions of messages (session_id, at, role, content) with title and last change."""
    first = F.min_by("content", "at")
    return messages.groupBy("session_id").agg(session_title(first).alias("title"), F.max("at").alias("updated_at"), F.count("*").alias("n_messages"))


def sessions_bumped(held: DataFrame, messages: DataFrame) -> DataFrame:
    """M9: sessions (session_id, title, updated_at, n_messages) after appended messages; a held title stays."""
    new = sessions(messages).select("session_id", *[F.col(c).alias(f"__{c}") for c in ("title", "updated_at", "n_messages")])
    both = held.join(new, "session_id", "full_outer")
    count = F.coalesce("n_messages", F.lit(0)) + F.coalesce("__n_messages", F.lit(0))
    return both.select("session_id", F.coalesce("title", "__title").alias("title"), F.greatest("updated_at", "__updated_at").alias("updated_at"), count.alias("n_messages"))


def latest_first(held: DataFrame, by: list[str]) -> DataFrame:
    """Sessions of each group with their place, the last changed first."""
    return held.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("updated_at"), "session_id")))


def metrics(events: DataFrame, by: list[str], key: str, value: str) -> DataFrame:
    """Metrics of each workspace and period."""
    return events.groupBy(*by).agg(F.sum(value).alias("metric_value")).withColumn("metric_key", F.lit(key))


def latest_metrics(points: DataFrame) -> DataFrame:
    """M3: the last point of each workspace, metric and period."""
    order = Window.partitionBy("workspace_id", "metric_key", "period").orderBy(F.desc("computed_at"), F.desc("metric_value"))
    return points.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def revision_rows(plans: DataFrame) -> DataFrame:
    """History rows; their creation is their schedule."""
    return plans.withColumn("created_at", F.col("scheduled_at"))


def checked_questions(answers: DataFrame, raw: str) -> DataFrame:
    """The questions of a model's answers with pos, question, options, correct_index and reason (null: fit for use). An
    answer without JSON or without an array of questions is a row of its own, so nothing is lost in silence."""
    quiz = F.try_parse_json(json_text(F.col(raw)))
    held = answers.withColumn("__quiz", quiz).withColumn("__questions", F.try_variant_get("__quiz", "$.questions", "array<variant>"))
    each = held.select(*answers.columns, "__quiz", "__questions", F.posexplode_outer("__questions").alias("pos", "__q"))
    each = each.filter("__questions IS NULL OR pos IS NOT NULL")  # an empty quiz has no questions and no fault
    fields = {"question": "string", "options": "array<string>", "correct_index": "int"}
    each = each.withColumns({name: F.try_variant_get("__q", f"$.{name}", kind) for name, kind in fields.items()})
    n = F.coalesce(F.size("options"), F.lit(0))
    reason = (
        F.when(F.col("__quiz").isNull(), "no JSON")
        .when(F.col("__questions").isNull(), "no questions")
        .when(F.coalesce(F.trim("question"), F.lit("")) == "", "no question")
        .when(n <= 0, "no options")
        .when(~F.coalesce(F.col("correct_index").between(0, n - 1), F.lit(False)), "no correct option")
    )
    return each.withColumn("reason", reason).drop("__quiz", "__questions", "__q")
