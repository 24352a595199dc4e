"""An equal-width grid on the sphere, as SQL expressions.

Latitude is cut in bands of ``step`` degrees.  Each band is cut in a whole
number of columns that are about as wide, in metres, as the band is high.  All
cell numbers are monotone in the coordinate they come from, so a point inside a
closed box always lies in one of the cells ``touching`` reports for that box.

The expressions are text because they are long: one parsed expression is built
much faster than hundreds of ``Column`` calls.
"""

from __future__ import annotations

from dataclasses import dataclass


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str, earth_radius_m: float) -> str:
    """Great-circle distance in metres."""
    return (
        f"2 * {earth_radius_m}D * asin(least(1D, sqrt("
        f"power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * power(sin(radians({lon2} - {lon1}) / 2), 2))))"
    )


def _number(band: str, column: str) -> str:
    """Band and column in one long, so that joins compare a single number."""
    return f"(shiftleft({band}, 24) + {column})"


def on_level(level: int | str, cell: str) -> str:
    """A cell of one of several grids, told apart from the cells of the others."""
    return f"(shiftleft(cast({level} as bigint), 52) + {cell})"


def level_of(cell: str) -> str:
    return f"cast(shiftright({cell}, 52) as int)"


@dataclass(frozen=True)
class Grid:
    """Grids down to a step of about 0.00003 degrees fit the cell numbers.

    The step is a number, or SQL text that names one, so that rows may differ in it.
    """

    step: float | str

    @property
    def _step(self) -> str:
        return self.step if isinstance(self.step, str) else f"{self.step!r}D"

    def band(self, lat: str) -> str:
        return f"floor(({lat} + 90D) / {self._step})"

    def band_columns(self, band: str) -> str:
        """Number of columns in a band; its edge nearest the pole decides."""
        low = f"({band} * {self._step} - 90D)"
        edge = f"least(greatest(abs({low}), abs({low} + {self._step})), 90D)"
        return f"greatest(floor(360D * cos(radians({edge})) / {self._step}), 1L)"

    def cell(self, lat: str, lon: str) -> str:
        """The one cell a point lies in, as a number."""
        band = self.band(lat)
        columns = self.band_columns(band)
        return _number(band, f"pmod(floor(({lon} + 180D) / 360D * {columns}), {columns})")

    def touching(self, lat: str, lon: str, dlat: str, dlon: str) -> str:
        """Array of all cells that the box ``lat±dlat, lon±dlon`` touches.

        A box wider than a band names each of its columns once.
        """
        top = f"(cast(180D / {self._step} as bigint) + 1L)"
        bands = (
            f"transform(sequence(greatest({self.band(f'{lat} - {dlat}')}, 0L), "
            f"least({self.band(f'{lat} + {dlat}')}, {top})), "
            f"b -> named_struct('b', b, 'n', {self.band_columns('b')}))"
        )
        first = f"floor(({lon} - {dlon} + 180D) / 360D * x.n)"
        last = f"least(floor(({lon} + {dlon} + 180D) / 360D * x.n), {first} + x.n - 1)"
        return (
            f"flatten(transform({bands}, x -> transform(sequence({first}, {last}), "
            f"c -> {_number('x.b', 'pmod(c, x.n)')})))"
        )


@dataclass(frozen=True)
class TileGrid:
    """Tiles of a plane of coordinates on several levels; a tile has four quarters one level down.

    Level 0 are cells as in ``Grid``, with longitudes taken as they are, so that a tile is one
    range of latitudes and one of longitudes.  Doubling a number is exact, so tiles nest
    without exception.  Numbers hold level, row and column.
    """

    step: float

    #: Keeps columns of longitudes below -180 positive.
    _SHIFT = 1 << 22

    def _pack(self, level: int, row: str, column: str) -> str:
        return on_level(level, _number(row, f"({column} + {self._SHIFT}L)"))

    def tile(self, lat: str, lon: str, level: int) -> str:
        """The tile a point lies in."""
        cells, fold = Grid(self.step), f"{float(1 << level)!r}D"
        columns = cells.band_columns(cells.band(lat))
        row = f"floor(({lat} + 90D) / {self.step!r}D * {fold})"
        return self._pack(level, row, f"floor(({lon} + 180D) / 360D * {columns} * {fold})")

    def cells(self, lat: str, lon: str, dlat: str, dlon: str) -> str:
        """Array of the tiles of level 0 that the box ``lat±dlat, lon±dlon`` touches.

        Longitudes more than a full turn away are none of them.
        """
        grid = Grid(self.step)
        bands = (
            f"transform(sequence({grid.band(f'{lat} - {dlat}')}, {grid.band(f'{lat} + {dlat}')}), "
            f"b -> named_struct('b', b, 'n', {grid.band_columns('b')}))"
        )
        first = f"floor(({lon} - least({dlon}, 360D) + 180D) / 360D * x.n)"
        last = f"floor(({lon} + least({dlon}, 360D) + 180D) / 360D * x.n)"
        return (
            f"flatten(transform({bands}, x -> transform(sequence({first}, {last}), "
            f"c -> {self._pack(0, 'x.b', 'c')})))"
        )

    def quarters(self, tile: str, level: int) -> list[str]:
        """The four tiles of the next level in a tile of ``level``."""
        row, column = self._row(tile), self._column(tile)
        return [
            self._pack(level + 1, f"({row} * 2 + {i})", f"({column} * 2 + {j})")
            for i in (0, 1) for j in (0, 1)
        ]

    def _row(self, tile: str) -> str:
        return f"(shiftright({tile}, 24) & {(1 << 28) - 1}L)"

    def _column(self, tile: str) -> str:
        return f"(({tile} & {(1 << 24) - 1}L) - {self._SHIFT}L)"

    def width(self, tile: str, level: int) -> str:
        """Degrees of longitude from one side of a tile to the other."""
        columns = Grid(self.step).band_columns(f"shiftright({self._row(tile)}, {level})")
        return f"(360D / ({columns} * {float(1 << level)!r}D))"

    def bounds(self, tile: str, width: str, level: int, slack: float) -> dict[str, str]:
        """``lat_lo``, ``lat_hi``, ``lon_lo``, ``lon_hi`` of a tile, wider by ``slack`` degrees."""
        row, column, height = self._row(tile), self._column(tile), f"{self.step / (1 << level)!r}D"
        return {
            "lat_lo": f"({row} * {height} - 90D - {slack!r}D)",
            "lat_hi": f"(({row} + 1) * {height} - 90D + {slack!r}D)",
            "lon_lo": f"({column} * {width} - 180D - {slack!r}D)",
            "lon_hi": f"(({column} + 1) * {width} - 180D + {slack!r}D)",
        }
