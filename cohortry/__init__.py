"""Customer segmentation as Spark jobs: scores, purchase labels, customer table, reports."""

from cohortry.rules import Rules

__all__ = ["Rules"]
