"""Web-Mercator tiles: of zoom z there are 2^z by 2^z, x from west to east and y from north to south."""

from math import atan, degrees, pi, sinh

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The latitude at which the square map ends.
EDGE = degrees(atan(sinh(pi)))
#: A tile is 2^8 pixels wide and high, so its pixels are the tiles of 8 zooms more.
PIXEL_BITS = 8


def _cell(share: Column, zoom: int) -> Column:
    """Number of the cell, of 2^zoom, that a share between 0 and 1 lies in."""
    return F.greatest(F.lit(0), F.least(F.lit(2**zoom - 1), F.floor(share * float(2**zoom)))).cast("long")


def tile_x(lon: Column, zoom: int) -> Column:
    """Column of a longitude in degrees; 180 is in the last. Null for what isn't from -180 to 180."""
    return F.when(lon.between(-180, 180), _cell((lon + 180.0) / 360.0, zoom))


def tile_y(lat: Column, zoom: int) -> Column:
    """Row of a latitude in degrees; what is beyond the map's edge is in the outermost row. Null for what isn't from -90 to 90."""
    s = F.sin(F.radians(F.greatest(F.lit(-EDGE), F.least(F.lit(EDGE), lat))))
    return F.when(lat.between(-90, 90), _cell(0.5 - F.log((1.0 + s) / (1.0 - s)) / (4 * pi), zoom))
