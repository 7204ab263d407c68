"""Answers to prediction requests: the request's contract, the registry's names, and the review rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.review import ASK_TEXT, review_rule

# fixed values: what a request may hold, and the answers that come from no model
REQUEST_FIELDS, MOST_CHARACTERS = ("text", "model"), 500
NO_TEXT, NO_MODEL = "Invalid input", "Unknown model"


def require_fields(df: DataFrame, keys: tuple[str, ...] = ()) -> None:
    """Fail closed: a request has the known fields and no other, beside the keys that name it."""
    more = set(df.columns) - set(REQUEST_FIELDS) - set(keys)
    if more or "text" not in df.columns:
        raise ValueError(f"not a request: {sorted(more) or 'no text'}")


def parse_requests(df: DataFrame, body: str) -> DataFrame:
    """df with text, model and reason of each JSON body; reason is null where the request may be answered.

    A body is an object with the known fields and no other, a string text of 1 to 500 characters, and, if at all,
    a string model.  Every other body has the first reason that holds: not_json, not_an_object, extra_field, no_text,
    text_not_a_string, model_not_a_string, text_length.  The plan is row by row, so it holds for a stream as well.
    """
    b = F.col(body)
    keys = F.json_object_keys(b)
    raw = F.from_json(b, "struct<text:variant, model:variant>", {"mode": "PERMISSIVE"})
    kind = lambda c: F.schema_of_variant(raw[c])
    text, model = (F.try_variant_get(raw[c], "$", "string") for c in REQUEST_FIELDS)
    parsed = F.try_parse_json(b)
    reason = (
        F.when(b.isNull() | parsed.isNull(), "not_json")
        .when(~F.schema_of_variant(parsed).startswith("OBJECT"), "not_an_object")
        .when(F.size(F.array_except(keys, F.array(*map(F.lit, REQUEST_FIELDS)))) > 0, "extra_field")
        .when(~F.array_contains(keys, "text") | F.is_variant_null(raw["text"]), "no_text")
        .when(kind("text") != "STRING", "text_not_a_string")
        .when(F.array_contains(keys, "model") & ~F.is_variant_null(raw["model"]) & (kind("model") != "STRING"), "model_not_a_string")
        .when(~F.length(text).between(1, MOST_CHARACTERS), "text_length")
    )
    return df.withColumns({"text": text, "model": model, "reason": reason})


def split_requests(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests to answer, quarantine): fail closed, every row is in one of the two."""
    return parsed.where(F.col("reason").isNull()).drop("reason"), parsed.where(F.col("reason").isNotNull())


def answers(requests: DataFrame, registry: DataFrame, default: str, category: Column, confidence: Column, threshold: float) -> DataFrame:
    """requests with model, status, model_name, confidence_kind, category, confidence, needs_human_review and message.

    No model means the default one.  status is 422 for a text that is null, empty or too long,
    200 for a blank one, which is invalid whatever its model, 404 for a model that is not in the registry
    (id, name, confidence_kind), else 200.  Rows of another status than 200 have no answer.
    """
    rows = requests.withColumn("model", F.coalesce("model", F.lit(default))) if "model" in requests.columns else requests.withColumn("model", F.lit(default))
    names = registry.select(F.col("id").alias("model"), F.col("name").alias("_name"), F.col("confidence_kind").alias("_kind"))
    rows = rows.withColumns({"_category": category, "_confidence": confidence}).join(F.broadcast(names), "model", "left")  # a row a model
    size = F.length("text")
    blank = F.regexp_replace("text", r"(?U)^\s+|\s+$", "") == ""
    status = F.when(F.col("text").isNull() | (size < 1) | (size > MOST_CHARACTERS), 422).when(blank, 200).when(F.col("_name").isNull(), 404).otherwise(200)
    needs, message = review_rule(F.col("model"), F.lit(default), F.col("_confidence"), threshold)
    good = F.col("status") == 200
    told = lambda of_blank, of_text: F.when(good & blank, of_blank).when(good, of_text)
    rows = rows.withColumn("status", status)
    return rows.withColumns({"model_name": told(F.lit(NO_TEXT), F.col("_name")), "confidence_kind": told(F.lit("none"), F.col("_kind")), "category": told(F.lit("invalid"), F.col("_category")), "confidence": told(F.lit(0.0), F.bround("_confidence", 4)), "needs_human_review": told(F.lit(True), needs), "message": told(F.lit(ASK_TEXT), message).alias("message")}).drop("_name", "_kind", "_category", "_confidence")


def health(registry: DataFrame) -> DataFrame:
    """One row: ready, and how many models there are to choose from."""
    n = F.count("*")
    return registry.agg((n > 0).alias("ready"), F.concat(n.cast("string"), F.lit(" selectable models")).alias("model"))


def final_test_protected(history: DataFrame) -> DataFrame:
    """One row: no access to the protected fold was made for selection; true where there was no access."""
    return history.agg(F.coalesce(F.every(~F.col("selection_used_final_test")), F.lit(True)).alias("final_test_was_protected"))
