"""Great-circle distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paceframe.config import EARTH_RADIUS_M


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in metres; NULL when any coordinate is NULL.

    The atan2 form is used because ``least``/``greatest`` skip NULLs: clamping the argument
    of asin would turn a missing previous point into half the circumference of the Earth.
    """
    phi1, phi2 = F.radians(lat1.cast("double")), F.radians(lat2.cast("double"))
    half_dphi = (phi2 - phi1) / 2
    half_dlam = (F.radians(lon2.cast("double")) - F.radians(lon1.cast("double"))) / 2
    h = F.sin(half_dphi) * F.sin(half_dphi) + F.cos(phi1) * F.cos(phi2) * F.sin(half_dlam) * F.sin(half_dlam)
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(0.0), 1 - h)))
