"""Fixed names and sizes of the domain."""

from __future__ import annotations

# Seasons, the warm season, the 12 km grid, the missing-value code.
SEASONS = {"DJF": (12, 1, 2), "MAM": (3, 4, 5), "JJA": (6, 7, 8), "SON": (9, 10, 11)}
WARM_SEASON = ("Apr-Sep", (4, 5, 6, 7, 8, 9))
GRID_ROWS, GRID_COLS = 299, 459
SENTINEL = -999.0
