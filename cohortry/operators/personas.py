"""Neutral persona and action rows for the registered reports; users bring tables of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortry.rules import ALBUM_COLLECTOR, BEGINNER, CHALLENGER, POCA_COLLECTOR, SHOPPER

LABELS = (CHALLENGER, ALBUM_COLLECTOR, POCA_COLLECTOR, SHOPPER, BEGINNER)

PERSONA_COLUMNS = ("dimension_label", "persona", "description", "trait_1", "trait_2", "trait_3")
PERSONAS = tuple(
    (label, f"Persona of {label}", f"Users labelled {label}", *(f"Trait {k} of {label}" for k in (1, 2, 3)))
    for label in LABELS
)

ACTION_COLUMNS = ("dimension_label", "action_no", "action", "action_description")
ACTIONS = tuple(
    (label, k, f"Action {k} for {label}", f"What action {k} does for {label}") for label in LABELS for k in (1, 2)
)


def _schema(columns: tuple[str, ...]) -> str:
    return ", ".join(f"{c} {'long' if c == 'action_no' else 'string'}" for c in columns)


def default_personas(spark: SparkSession) -> DataFrame:
    """A name, a text and three traits for each label."""
    return spark.createDataFrame(list(PERSONAS), _schema(PERSONA_COLUMNS))


def default_actions(spark: SparkSession) -> DataFrame:
    """Numbered actions for each label, with a title and a text."""
    return spark.createDataFrame(list(ACTIONS), _schema(ACTION_COLUMNS))
