"""Feature vectors of graph nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bookweave.functions.vectors import pad_or_cut, vec_sum
from bookweave.schemas import PROP, PROPERTY_KEYS

# Defaults of missing node properties (all others are 0).
DEFAULTS = {"LocalRealizedVol": 0.01, "CancelHazard": 0.5, "FillHazard": 0.5}


def dense_node_features(properties: Column) -> Column:
    """17 properties in key order with defaults."""
    return F.array(
        *[
            F.coalesce(F.try_element_at(properties, F.lit(PROP[name])), F.lit(DEFAULTS.get(name, 0.0)))
            for name in PROPERTY_KEYS
        ]
    )


def edge_features(kind: Column, properties: Column) -> Column:
    """Scaled kind, property sum, property count and a coarse kind bucket."""
    bucket = F.when(kind <= 1, 0.0).when(kind <= 5, 0.5).otherwise(1.0)
    return F.array(
        kind / F.lit(11.0), vec_sum(F.map_values(properties)), F.size(properties).cast("double"), bucket
    )


def packed_features(kind: Column, properties: Column, scale: float) -> Column:
    """Scaled kind, then property values in key order, cut or zero-padded to 8."""
    keys = F.array_sort(F.map_keys(properties))
    values = F.transform(keys, lambda k: F.element_at(properties, k))
    return pad_or_cut(F.concat(F.array((kind / F.lit(scale)).cast("double")), values), 8)


def widen_features(packed: Column, size: int = 17) -> Column:
    return pad_or_cut(packed, size)
