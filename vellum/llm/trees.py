"""Boosted trees of Spark ML as ordinary column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def margin(model, feature: Callable[[int], Column]) -> Column:
    """The ensemble's weighted sum of tree outputs; ``feature(i)`` is the i-th input.

    Read from the model's own description, whose lines nest by depth.
    """
    total = F.lit(0.0)
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        lines = [x.strip() for x in tree.toDebugString.split("\n")[1:] if x.strip()]

        def node() -> Column:
            line = lines.pop(0)
            if line.startswith("Predict:"):
                return F.lit(float(line.split(":")[1]))
            index, bound = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
            low = node()
            lines.pop(0)  # Else (...)
            high = node()
            return F.when(feature(int(index)) <= float(bound), low).otherwise(high)

        total = total + node() * float(weight)
    return total


def probability(model, feature: Callable[[int], Column]) -> Column:
    """Of label 1, by the logistic loss that the classifier is fitted with."""
    return 1 / (1 + F.exp(-2 * margin(model, feature)))
