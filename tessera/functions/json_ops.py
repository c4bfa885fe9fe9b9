"""JSON functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Schemas of model output (K3).
SHAPES = {
    "concept_graph": "concepts array<struct<label:string,description:string>>, relations array<struct<from:string,to:string,relation_type:string,weight:double>>",
    "quiz": "questions array<struct<question:string,options:array<string>,correct_index:int,explanation:string>>",
    "flashcards": "cards array<struct<front:string,back:string>>",
    "mind_map": "topic string, branches array<struct<label:string,children:array<string>>>",
    "formula_sheet": "formulas array<struct<name:string,expression:string,description:string>>",
    "study_guide": "summary string, key_points array<string>, questions array<string>",
}


def payload(**fields: Column) -> Column:
    """K1: a JSON object of the given columns."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def payload_long(text: Column, key: str) -> Column:
    """K2/P10: a whole number of a payload; null where missing or of another type."""
    return F.get_json_object(text, f"$.{key}").try_cast("long")


def payload_text(text: Column, key: str) -> Column:
    """K2: a text of a payload; null where missing."""
    return F.get_json_object(text, f"$.{key}")


def parsed(text: Column, shape: str) -> Column:
    """K3: model output of a named shape; null fields where it does not hold."""
    return F.from_json(text, SHAPES[shape])


def context_length(info: Column, default: int = 4096) -> Column:
    """K5: the value under the first key that ends in ``context_length``."""
    held = F.map_filter(F.from_json(info, "map<string,string>"), lambda k, v: k.endswith("context_length") & v.try_cast("long").isNotNull())
    return F.coalesce(F.get(F.map_values(held), F.lit(0)).try_cast("int"), F.lit(default))


def capabilities(reported: Column, families: Column) -> Column:
    """Capabilities of a model from what it reports, else from the names of its families."""
    said = F.transform(F.coalesce(reported, F.array().cast("array<string>")), F.lower)
    names = F.transform(F.coalesce(families, F.array().cast("array<string>")), F.lower)

    def family(*parts: str) -> Column:
        return F.exists(names, lambda n: n.rlike("|".join(parts)))

    sees = F.array_contains(said, "vision")
    embeds = F.array_contains(said, "embedding")
    return F.array_compact(
        F.array(
            F.lit("TextGeneration"),
            F.when(sees, F.lit("Vision")),
            F.when(embeds, F.lit("Embedding")),
            F.when(F.array_contains(said, "tools"), F.lit("Tools")),
            F.when(~sees & family("clip", "vit", "llava", "vision", "mllama"), F.lit("Vision")),
            F.when(~embeds & family("bert", "embed"), F.lit("Embedding")),
        )
    )


def valid_questions(questions: Column) -> Column:
    """Questions that have options and a correct one among them."""
    return F.filter(questions, lambda q: (F.size(q["options"]) > 0) & (q["correct_index"] >= 0) & (q["correct_index"] < F.size(q["options"])))


def valid_cards(cards: Column) -> Column:
    """Cards with both sides filled."""
    return F.filter(cards, lambda c: (F.length(F.trim(c["front"])) > 0) & (F.length(F.trim(c["back"])) > 0))
