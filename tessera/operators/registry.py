"""Models, settings and routing (J11, J12, A7, A9, A10, M5, M6, M14, P8, P9, layered settings)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import billions

#: Roles that a capability can serve.
ROLES = {"Vision": ("Vision",), "Embedding": ("Embedding",), "TextGeneration": ("Tutor", "Reasoning", "Planner"), "Tools": ()}
#: Roles that answer an intent, in order.
ROUTES = {
    "FactualLookup": ("Retriever", "Reranker", "Tutor"),
    "Tutoring": ("Retriever", "Reranker", "Tutor"),
    "Quiz": ("Retriever", "Reranker", "Reasoning"),
    "Research": ("Retriever", "Reranker", "Reasoning"),
    "Planning": ("Memory", "Planner"),
}
#: Settings layers, the last one wins.
LAYERS = ("default", "user", "workspace", "runtime")


def roles(capabilities: Column) -> Column:
    """Roles of an array of capabilities."""
    known = F.create_map(*chain.from_iterable((F.lit(k), F.array(*[F.lit(r) for r in v]).cast("array<string>")) for k, v in ROLES.items()))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.transform(capabilities, lambda c: F.coalesce(F.try_element_at(known, c), none))))


def candidates(models: DataFrame) -> DataFrame:
    """Models (pos, model_identifier, capabilities, ...) once for each role they can serve."""
    return models.withColumn("engine_role", F.explode(roles(F.col("capabilities"))))


def best_per_role(found: DataFrame) -> DataFrame:
    """A10: the best model of each role: by context length for Embedding, else by parameters, then
    context length; the first discovered wins ties."""
    size = F.coalesce(billions(F.col("parameter_size")), F.lit(0.0))
    first = F.when(F.col("engine_role") == "Embedding", F.col("context_length").cast("double")).otherwise(size)
    order = Window.partitionBy("engine_role").orderBy(F.desc("rank1"), F.desc("context_length"), "pos")
    return found.withColumn("rank1", first).withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n", "rank1")


def reconciled(registry: DataFrame, discovered: DataFrame) -> DataFrame:
    """Registry after a discovery: known models become available and keep their selection,
    new ones are unselected, missing ones are unselected and unavailable."""
    old = registry.select("model_identifier", "engine_role", F.col("is_selected_for_role").alias("was"))
    new = discovered.select("model_identifier", "engine_role").distinct().withColumn("__there", F.lit(True))
    both = old.join(new, ["model_identifier", "engine_role"], "full_outer")
    return both.select("model_identifier", "engine_role", F.when(F.col("__there"), "Available").otherwise("Unavailable").alias("status"), (F.coalesce("__there", F.lit(False)) & F.coalesce("was", F.lit(False))).alias("is_selected_for_role"))


def stale_selections(registry: DataFrame, discovered: DataFrame) -> DataFrame:
    """Selected models that were not discovered."""
    return registry.filter("is_selected_for_role").join(discovered.select("model_identifier"), "model_identifier", "left_anti")


def select_for_role(registry: DataFrame, choice: DataFrame) -> DataFrame:
    """M6: one selected model in each role of ``choice`` (engine_role, chosen); others keep theirs.

    A role whose chosen model is unknown keeps its selection and is marked in ``unknown_choice``."""
    known = registry.join(choice, (registry["engine_role"] == choice["engine_role"]) & (registry["model_identifier"] == choice["chosen"]), "left_semi").select("engine_role").distinct().withColumn("__known", F.lit(True))
    joined = registry.join(choice, "engine_role", "left").join(known, "engine_role", "left")
    selected = F.when(F.col("__known"), F.col("model_identifier") == F.col("chosen")).otherwise(F.col("is_selected_for_role"))
    return joined.withColumns({"is_selected_for_role": selected, "unknown_choice": F.col("chosen").isNotNull() & F.col("__known").isNull()}).drop("__known", "chosen")


def selected_model(registry: DataFrame) -> DataFrame:
    """The selected model of each role, the least id where several are."""
    return registry.filter("is_selected_for_role").groupBy("engine_role").agg(F.min_by("model_identifier", "id").alias("model_identifier"))


def by_role(registry: DataFrame) -> DataFrame:
    """Models of each role, one row each, with their number and whether one is selected.

    What is broadcast has a row for each role, a closed domain."""
    roles_held = registry.groupBy("engine_role").agg(F.count("*").alias("n_models"), F.bool_or("is_selected_for_role").alias("has_selection"))
    return registry.select("engine_role", "model_identifier").join(F.broadcast(roles_held), "engine_role")


#: Most keys that have a value for all workspaces: settings are a closed vocabulary.
MAX_KEYS = 10_000


def resolved_settings(entries: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Value of each key in each workspace: from the highest layer, its own entry before the global.

    ``entries``: layer, key, workspace_id (null: global), value. Values for all workspaces are at
    most ``MAX_KEYS`` and enter the plan as a literal; more are an error."""
    rank = F.array_position(F.array(*[F.lit(x) for x in LAYERS]), F.col("layer"))
    ranked = entries.withColumn("rank", rank)
    every = workspaces.select("workspace_id").distinct()
    own = ranked.filter("workspace_id IS NOT NULL").join(every, "workspace_id", "left_semi")
    best_own = _best(own, ["workspace_id", "key"]).select("workspace_id", "key", "value", "rank")
    shared = _best(ranked.filter("workspace_id IS NULL"), ["key"]).select("key", "value", "rank").limit(MAX_KEYS + 1).collect()
    if len(shared) > MAX_KEYS:
        raise ValueError("too many keys")
    listed = [F.struct(F.lit(r.key).alias("key"), F.lit(r.value).cast("string").alias("global_value"), F.lit(int(r["rank"])).alias("global_rank")) for r in shared]
    none = F.array().cast("array<struct<key:string,global_value:string,global_rank:int>>")
    given = every.select("workspace_id", F.inline(F.array(*listed) if listed else none))
    joined = given.join(best_own, ["workspace_id", "key"], "full_outer")
    value = F.when(F.col("rank").isNotNull() & (F.coalesce("global_rank", F.lit(0)) <= F.col("rank")), F.col("value")).otherwise(F.col("global_value"))
    return joined.select("workspace_id", "key", value.alias("value")).filter("value IS NOT NULL")


def _best(entries: DataFrame, by: list[str]) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("rank"))
    return entries.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def route(intent: Column) -> Column:
    """Roles that answer an intent; unknown intents are factual."""
    known = F.create_map(*chain.from_iterable((F.lit(k), F.array(*[F.lit(r) for r in v])) for k, v in ROUTES.items()))
    return F.coalesce(F.try_element_at(known, intent), F.array(*[F.lit(r) for r in ROUTES["FactualLookup"]]))


def terminal_role(roles_of_intent: Column) -> Column:
    """The last role that is not for retrieval."""
    return F.element_at(F.filter(roles_of_intent, lambda r: ~r.isin("Retriever", "Reranker", "Memory")), -1)
