"""Components of rasters in tiles against those of one task."""

import numpy as np
import pytest

from folioqc.operators import raster, tiles

SCHEMA = "id long, height int, width int, mask binary"


def frame(spark, masks):
    return spark.createDataFrame([(i, *m.shape, m.astype(np.uint8).tobytes()) for i, m in enumerate(masks)], SCHEMA)


def got(df):
    found = {}
    for r in df.orderBy("id", "region_ord").collect():
        found.setdefault(r.id, []).append((r.x0, r.y0, r.x1, r.y1, r.area))
    return found


def spiral(n):
    m = np.zeros((n, n), bool)
    y, x, dy, dx, left = 0, 0, 0, 1, n
    while left > 2:
        for _ in range(4):
            for _ in range(left - 1):
                m[y, x] = True
                y, x = y + dy, x + dx
            dy, dx = dx, -dy
        m[y, x] = False
        y, x, left = y + 2, x + 2, left - 4
    return m


def test_runs_are_labelled_as_pixels_are():
    rng = np.random.default_rng(0)
    for density in (0.1, 0.4, 0.6):
        mask = rng.random((30, 41)) < density
        y, x0, x1 = tiles.runs(mask)
        label = tiles.labelled(y, x0, x1)
        boxes = [(int(x0[label == n].min()), int(y[label == n].min()), int(x1[label == n].max()), int(y[label == n].max()), int((x1 - x0 + 1)[label == n].sum())) for n in dict.fromkeys(label)]
        assert boxes == raster.label_components(mask)
    assert len(tiles.labelled(*tiles.runs(np.zeros((3, 3), bool)))) == 0


def test_tiles_give_what_one_task_gives(spark):
    rng = np.random.default_rng(1)
    masks = [rng.random((70, 53)) < 0.35, rng.random((33, 90)) < 0.5, spiral(61), np.zeros((20, 20), bool), np.eye(50, dtype=bool)[:, ::-1], np.ones((40, 17), bool)]
    want = {i: raster.label_components(m) for i, m in enumerate(masks) if m.any()}
    assert got(tiles.large_components(tiles.tiles_of(frame(spark, masks), 16), 16)) == want
    big = {i: [c for c in cs if c[4] >= 9] for i, cs in want.items()}
    assert got(tiles.large_components(tiles.tiles_of(frame(spark, masks), 16), 16, 9)) == {i: cs for i, cs in big.items() if cs}


def test_a_large_raster(spark):
    """Frames inside each other, bars across all tiles and blocks astride their corners."""
    m = np.zeros((4096, 4096), bool)
    want = []
    for k in range(0, 1200, 300):
        m[k, k : 4096 - k] = m[4095 - k, k : 4096 - k] = True
        m[k : 4096 - k, k] = m[k : 4096 - k, 4095 - k] = True
        side = 4096 - 2 * k
        want.append((k, k, 4095 - k, 4095 - k, 4 * side - 4))
    for y, x in ((1500, 1500), (1531, 2040), (2040, 2040)):
        m[y : y + 20, x : x + 20] = True
        want.append((x, y, x + 19, y + 19, 400))
    assert got(tiles.large_components(tiles.tiles_of(frame(spark, [m]))))[0] == want
