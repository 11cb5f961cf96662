"""Whole jobs composed of operators, and the registered queries."""

from strandline.plans import checks, cube, evaluation, holdout, intake, queries, research  # noqa: F401  (the others register their queries in the same table)
