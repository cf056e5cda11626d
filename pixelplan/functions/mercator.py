"""Web-Mercator tile arithmetic as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Half the projected width of the earth, its radius, pixels of a tile, the metres of a pixel at zoom 0.
EXTENT = 20037508.342789244
RADIUS = 6378137.0
TILE = 256
EQUATOR_CM = 15654303.0


def resolution(zoom: Column) -> Column:
    """Projected metres of a pixel."""
    return F.lit(2 * EXTENT) / (F.lit(float(TILE)) * F.pow(F.lit(2.0), zoom))


def _side(zoom: Column) -> Column:
    return F.lit(2 * EXTENT) / F.pow(F.lit(2.0), zoom)


def tile_column(mx: Column, zoom: Column) -> Column:
    return F.floor((mx + F.lit(EXTENT)) / _side(zoom)).cast("int")


def tile_row(my: Column, zoom: Column) -> Column:
    """Rows count downwards."""
    return F.floor((F.lit(EXTENT) - my) / _side(zoom)).cast("int")


def tile_left(col: Column, zoom: Column) -> Column:
    return col * _side(zoom) - F.lit(EXTENT)


def tile_top(row: Column, zoom: Column) -> Column:
    return F.lit(EXTENT) - row * _side(zoom)


def ground_resolution_cm(zoom: Column, latitude: float = 47.81) -> Column:
    return F.lit(EQUATOR_CM) * F.cos(F.radians(F.lit(latitude))) / F.pow(F.lit(2.0), zoom)


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * F.lit(RADIUS), F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2)) * F.lit(RADIUS)


def to_degrees(mx: Column, my: Column) -> tuple[Column, Column]:
    return F.degrees(mx / F.lit(RADIUS)), F.degrees(2 * F.atan(F.exp(my / F.lit(RADIUS))) - F.lit(1.5707963267948966))


def tile_url(base: str, service: Column, zoom: Column, row: Column, col: Column) -> Column:
    return F.concat_ws("/", F.lit(base), service, F.lit("MapServer/tile"), zoom.cast("string"), row.cast("string"), col.cast("string"))


def epsg(crs: Column) -> Column:
    return F.split_part(crs, F.lit(":"), F.lit(2)).cast("int")


def utm(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing by the Krueger series to the third order."""
    f, a = 1 / 298.257223563, 6378137.0
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    k = 2 * n**0.5 / (1 + n)
    sine = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(sine) - F.lit(k) * F.atanh(F.lit(k) * sine))
    turn = F.radians(lon - F.lit(zone * 6.0 - 183.0))
    xi, eta = F.atan2(t, F.cos(turn)), F.atanh(F.sin(turn) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(alpha, 1):
        east = east + F.lit(c) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + F.lit(c) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.lit(500000.0) + F.lit(0.9996 * big) * east, F.lit(0.9996 * big) * north


def reprojected(x: Column, y: Column, crs: Column, target: int) -> tuple[Column, Column]:
    """Places of a coordinate system (EPSG:4326 or EPSG:3857) in another: 4326, 3857 or 32601 to 32660 (zones of the north).

    Equal systems leave places as they are. A null or other system raises when a row is read.
    """
    code = F.coalesce(epsg(crs), F.raise_error(F.lit("a place has no coordinate system")))
    lon, lat = to_degrees(x, y)
    lon, lat = F.when(code == 3857, lon).when(code == 4326, x), F.when(code == 3857, lat).when(code == 4326, y)
    there = (lon, lat) if target == 4326 else to_mercator(lon, lat) if target == 3857 else utm(lon, lat, target - 32600) if 32601 <= target <= 32660 else None
    if there is None:
        raise ValueError(f"EPSG:{target} is not known")
    known = lambda there_, here: F.when(code == target, here).otherwise(F.coalesce(there_, F.when(code.isin(3857, 4326), F.lit(None).cast("double")).otherwise(F.raise_error(F.concat(F.lit("unknown coordinate system "), crs)).cast("double"))))
    return known(there[0], x), known(there[1], y)
