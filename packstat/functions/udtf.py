"""Table functions for SQL users."""

from __future__ import annotations

from pyspark.sql.functions import udtf


@udtf(returnType="image_x int, image_y int, cx double, cy double")
class periodic_images_of:  # noqa: N801
    """Images of a disk whose circumscribed circle reaches the box, shifted by whole boxes."""

    def eval(self, cx: float, cy: float, lx: float, ly: float, reach: float):
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                x, y = cx + i * lx, cy + j * ly
                dx, dy = max(-x, x - lx, 0.0), max(-y, y - ly, 0.0)
                if (dx * dx + dy * dy) ** 0.5 <= reach:
                    yield i, j, x, y
