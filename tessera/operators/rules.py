"""Row rules as functions of columns: verdicts, tiers, labels, colours, solar position."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The text that each tier stands on.
BASIS = {
    "confirmed": "seen above the waterline and cross-checked",
    "likely": "reflects infrared, so a dry surface breaking the water",
    "unverified": "persistent in imagery; bottom is NOT visible on this lake, so its depth meaning is unproven",
}
#: Depth in feet and colour of the night ramp's stops and the chart's bands.
RAMP = [(0, 126, 196, 178), (3, 104, 178, 176), (6, 72, 148, 172), (10, 46, 118, 162), (15, 32, 94, 146), (25, 22, 72, 122), (40, 16, 54, 96), (60, 11, 40, 74), (80, 8, 30, 58)]
BANDS = [(6, 130, 189, 224), (12, 176, 214, 236), (18, 211, 232, 245), (None, 246, 251, 254)]


def tier(cls: Column, evidence: Column, dry_frac: Column, dry_least: float = 0.5) -> Column:
    """What the evidence allows to be claimed; null evidence counts as none."""
    sure = cls.isin("island", "exposed") | F.coalesce(evidence == "human_mapped", F.lit(False))
    dry = (F.coalesce(dry_frac, F.lit(0.0)) >= dry_least) | ((cls == "rock") & evidence.isin("naip_only", "both", "bright_only"))
    return F.when(sure, "confirmed").when(F.coalesce(dry, F.lit(False)), "likely").otherwise("unverified")


def basis(tier_: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in BASIS.items() for x in kv]), tier_)


def verify_verdict(land_frac: Column, sigma: Column) -> Column:
    return F.when(land_frac >= 0.03, "rock_confirmed").when(sigma >= 1.5, "shoal_confirmed").otherwise("open_water")


def signature_verdict(z_nir: Column, z_green: Column) -> Column:
    return F.when(z_nir >= 3, "dry").when(z_green >= 2, "bottom").otherwise("invisible")


def structure_kind(tags: Column) -> Column:
    """The first of building, pier, slipway, camp that a map of tags tells, else place."""
    has = lambda k: F.map_contains_key(tags, k)
    is_ = lambda k, v: F.coalesce(F.element_at(tags, k) == v, F.lit(False))
    return F.when(has("building"), "building").when(is_("man_made", "pier"), "pier").when(is_("leisure", "slipway"), "slipway").when(has("tourism"), "camp").otherwise("place")


def normal_label(text: Column) -> Column:
    """'Depth (ft):' becomes 'depth_ft'."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(F.trim(text), ":+$", "")), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def ramp_colour(feet: Column, channel: int) -> Column:
    """Channel 1 to 3 of the night ramp, linear between stops, the last stop beyond it."""
    out = F.lit(float(RAMP[-1][channel]))
    for (a, *low), (b, *high) in reversed(list(zip(RAMP[:-1], RAMP[1:], strict=True))):
        p, q = low[channel - 1], high[channel - 1]
        out = F.when(feet <= b, p + (q - p) * (feet - a) / F.lit(float(b - a))).otherwise(out)
    return out


def band_colour(feet: Column, channel: int) -> Column:
    out = F.lit(float(BANDS[-1][channel]))
    for edge, *colour in reversed(BANDS[:-1]):
        out = F.when(feet < edge, float(colour[channel - 1])).otherwise(out)
    return out


def solar_elevation(day: Column, hour: Column, lat: Column, lon: Column) -> Column:
    """Degrees above the horizon at a day of the year and hour (UTC), by NOAA's low-precision series."""
    f = 2 * F.pi() / 365 * (day - 1 + (hour - 12) / 24)
    series = lambda *k: sum((c * g(n * f) for c, g, n in k[1:]), F.lit(k[0]))
    # The coefficients of the equation of time (minutes) and the declination (radians).
    minutes = 229.18 * series(0.000075, (0.001868, F.cos, 1), (-0.032077, F.sin, 1), (-0.014615, F.cos, 2), (-0.040849, F.sin, 2))
    tilt = series(0.006918, (-0.399912, F.cos, 1), (0.070257, F.sin, 1), (-0.006758, F.cos, 2), (0.000907, F.sin, 2), (-0.002697, F.cos, 3), (0.00148, F.sin, 3))
    angle = F.radians((hour * 60 + minutes + 4 * lon) / 4 - 180)
    phi = F.radians(lat)
    return 90 - F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(phi) * F.sin(tilt) + F.cos(phi) * F.cos(tilt) * F.cos(angle)))))


def utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing in metres on WGS84, northern hemisphere, by the Krüger series to the third order."""
    # WGS84's axis and flattening, the scale on the central meridian.
    a, flat, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = flat / (2 - flat)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    e = 2 * n**0.5 / (1 + n)
    phi, turn = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    atanh = lambda x: F.log((1 + x) / (1 - x)) / 2
    t = F.sinh(atanh(F.sin(phi)) - e * atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(turn)), atanh(F.sin(turn) / F.sqrt(1 + t * t))
    east = eta + sum((c * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, c in enumerate(alpha, 1)), F.lit(0.0))
    north = xi + sum((c * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, c in enumerate(alpha, 1)), F.lit(0.0))
    return 500000 + k0 * radius * east, k0 * radius * north


def utm_inverse(east: Column, north: Column, zone: Column) -> tuple[Column, Column]:
    """Longitude and latitude of ``utm``'s metres."""
    # Fixed values, as above.
    a, flat, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = flat / (2 - flat)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    xi, eta = north / (k0 * radius), (east - 500000) / (k0 * radius)
    x = xi - sum((c * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, c in enumerate(beta, 1)), F.lit(0.0))
    y = eta - sum((c * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, c in enumerate(beta, 1)), F.lit(0.0))
    chi = F.asin(F.sin(x) / F.cosh(y))
    phi = chi + sum((c * F.sin(2 * j * chi) for j, c in enumerate(delta, 1)), F.lit(0.0))
    return zone * 6 - 183 + F.degrees(F.atan2(F.sinh(y), F.cos(x))), F.degrees(phi)
