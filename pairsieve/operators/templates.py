"""Rendering conversations with a per-model template."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import render, role_maps

Template = Mapping[str, tuple[str, str]]

# Used for models without a template of their own.
DEFAULT_TEMPLATE: Template = {
    "system": ("System: ", "\n"),
    "user": ("User: ", "\n"),
    "assistant": ("Assistant: ", "\n"),
}


def template_table(spark, templates: Mapping[str, Template]) -> DataFrame:
    """The registry (model, before MAP, after MAP)."""
    rows = [
        (model, {r: p for r, (p, _) in t.items()}, {r: s for r, (_, s) in t.items()}) for model, t in templates.items()
    ]
    return spark.createDataFrame(rows, "model string, before map<string,string>, after map<string,string>")


def render_for_models(
    df: DataFrame, templates: DataFrame, conversation: str = "conversation", default: Template = DEFAULT_TEMPLATE, name: str = "text"
) -> DataFrame:
    """Render each row's conversation with its model's template, or the default where the model has none."""
    before, after = role_maps(default)
    return (
        df.join(templates, "model", "left")
        .withColumn(name, render(conversation, F.coalesce("before", before), F.coalesce("after", after)))
        .drop("before", "after")
    )
