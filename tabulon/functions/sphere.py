"""Great-circle geometry in numpy, used inside Arrow batches, and as Catalyst expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8


def unit(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """Unit vectors (n, 3) of degrees."""
    a, b = np.radians(lon), np.radians(lat)
    c = np.cos(b)
    return np.stack((c * np.cos(a), c * np.sin(a), np.sin(b)), axis=-1)


def haversine(lon1, lat1, lon2, lat2, radius: float = EARTH_M) -> np.ndarray:
    """Great-circle distance; all coordinates in radians."""
    h = np.sin((lat2 - lat1) * 0.5) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) * 0.5) ** 2
    return 2.0 * radius * np.arcsin(np.sqrt(np.minimum(h, 1.0)))


def sphere_xyz(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    a, b = F.radians(lon), F.radians(lat)
    return F.cos(b) * F.cos(a), F.cos(b) * F.sin(a), F.sin(b)
