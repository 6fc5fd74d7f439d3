"""Right-closed binning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Edges and labels of the weather categories.
WIND = ((0, 3, 6, 10, 50), ("Calm (0–3)", "Light (3–6)", "Moderate (6–10)", "Strong (>10)"))
TEMPERATURE = ((-20, 0, 5, 10, 15, 40), ("< 0°C", "0–5°C", "5–10°C", "10–15°C", "> 15°C"))
CLOUD = (
    (-1, 25, 50, 75, 101),
    ("Clear (0–25%)", "Partly (25–50%)", "Mostly (50–75%)", "Overcast (>75%)"),
)
RAIN = (
    (-0.1, 0, 1, 5, 200),
    ("Dry (0 mm)", "Light (0–1 mm)", "Moderate (1–5 mm)", "Heavy (>5 mm)"),
)


def cut(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the bin ``(edge, next edge]`` holding ``value``; null outside all bins."""
    if len(edges) != len(labels) + 1:
        raise ValueError("cut needs one more edge than labels")
    result = F.when(value.isNull() | (value <= edges[0]), None)
    for upper, label in zip(edges[1:], labels):
        result = result.when(value <= upper, label)
    return result


def grid_cell(value: Column, low: Column, high: Column, cells: int) -> Column:
    """Index 0..cells-1 of the equal-width cell of ``[low, high]``; the top edge joins the last."""
    width = (high - low) / cells
    index = F.when(width == 0, 0).otherwise(F.floor((value - low) / F.nullif(width, F.lit(0.0))))
    return F.least(index, F.lit(cells - 1)).cast("int")
