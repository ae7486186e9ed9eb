"""Great-circle distance and safe distance bounds to a latitude / longitude box.

Written as SQL expressions over column names: a formula of twenty operators is one parsed
expression instead of twenty calls into the JVM, which counts in operators that loop.
"""

from __future__ import annotations

EARTH_RADIUS_KM = 6371.0
_SLACK = "1e-9D"


def haversine_km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    half_lat = f"sin(radians({lat2} - {lat1}) / 2)"
    half_lon = f"sin(radians({lon2} - {lon1}) / 2)"
    chord = (
        f"least({half_lat} * {half_lat} + cos(radians({lat1})) * cos(radians({lat2})) * ({half_lon} * {half_lon}), 1.0D)"
    )
    return f"({EARTH_RADIUS_KM}D * (2 * atan2(sqrt({chord}), sqrt(1 - {chord}))))"


def _lat_gaps(lat: str, box: str) -> tuple[str, str]:
    """Least and greatest difference in latitude to a point of the box."""
    least = f"greatest({box}lat_lo - {lat}, {lat} - {box}lat_hi, 0.0D)"
    return least, f"greatest(abs({box}lat_lo - {lat}), abs({box}lat_hi - {lat}))"


def _chord(lat: str, lat_gap: str, lon_gap: str, cos_there: str) -> str:
    half_lat, half_lon = f"sin(radians({lat_gap}) / 2)", f"sin(radians({lon_gap}) / 2)"
    return f"({half_lat} * {half_lat} + cos(radians({lat})) * {cos_there} * ({half_lon} * {half_lon}))"


def _at_most_km(chord: str) -> str:
    # near the antipode the arc follows from the chord too loosely, so half the globe's girth is taken
    return f"(CASE WHEN {chord} > 0.9D THEN pi() ELSE 2 * asin(sqrt({chord})) END * {EARTH_RADIUS_KM}D * (1 + {_SLACK}) + {_SLACK})"


def box_lower_bound_km(lat: str, lon: str, box: str = "") -> str:
    """No point of the box (lat_lo, lat_hi, lon_lo, lon_hi) is nearer than this.

    Each factor of the haversine formula at its least: the gap in latitude, the gap in longitude, which wraps around,
    and the cosine of the box's edge nearer to a pole. So a box off to a corner is as far as its corner.
    """
    to_lo = f"least(abs({box}lon_lo - {lon}), 360 - abs({box}lon_lo - {lon}))"
    to_hi = f"least(abs({box}lon_hi - {lon}), 360 - abs({box}lon_hi - {lon}))"
    lon_gap = f"CASE WHEN {lon} BETWEEN {box}lon_lo AND {box}lon_hi THEN 0.0D ELSE greatest(least({to_lo}, {to_hi}), 0.0D) END"
    cos_there = f"greatest(least(cos(radians({box}lat_lo)), cos(radians({box}lat_hi))), 0.0D)"
    chord = _chord(lat, _lat_gaps(lat, box)[0], lon_gap, cos_there)
    return f"(2 * asin(sqrt(least({chord}, 0.9D))) * {EARTH_RADIUS_KM}D * (1 - {_SLACK}) - {_SLACK})"


def _lon_gap_most(lon: str, box: str) -> str:
    return f"least(greatest(abs({box}lon_lo - {lon}), abs({box}lon_hi - {lon})), 180.0D)"


def _cos_most(box: str) -> str:
    return f"(CASE WHEN 0.0D BETWEEN {box}lat_lo AND {box}lat_hi THEN 1.0D ELSE greatest(cos(radians({box}lat_lo)), cos(radians({box}lat_hi))) END)"


def box_upper_bound_km(lat: str, lon: str, box: str = "") -> str:
    """Every point of the box is at most this far: each factor of the haversine formula at its greatest."""
    return _at_most_km(_chord(lat, _lat_gaps(lat, box)[1], _lon_gap_most(lon, box), _cos_most(box)))


def box_nearest_upper_bound_km(lat: str, lon: str, box: str = "") -> str:
    """The nearest of the points that a box bounds tightly is at most this far: every edge of the box holds a point."""
    lat_most, lon_most = _lat_gaps(lat, box)[1], _lon_gap_most(lon, box)
    by_lat = [_chord(lat, f"({box}{edge} - {lat})", lon_most, f"cos(radians({box}{edge}))") for edge in ("lat_lo", "lat_hi")]
    by_lon = [_chord(lat, lat_most, f"({box}{edge} - {lon})", _cos_most(box)) for edge in ("lon_lo", "lon_hi")]
    return _at_most_km(f"least({', '.join(by_lat + by_lon)})")
