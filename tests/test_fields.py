"""Cells, arrival and colours against plain Python."""

import math
import random

import numpy as np
import pytest

from matchgrid.operators import colours, regions

SITES = "frame int, who int, x_pitch double, y_pitch double"


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(1)
    sites = [(f, i, rng.uniform(0, 105), rng.uniform(0, 68)) for f in range(6) for i in range(1 + 4 * f)]
    sites += [(9, 1, 50.0, 30.0), (9, 2, 50.0, 30.0), (9, 3, 60.0, 30.0), (9, 4, 55.0, 40.0)]  # two on one spot
    df = regions.cells(spark.createDataFrame(sites, SITES), "frame", "who").cache()
    return sites, df


def test_cells_sum_to_the_pitch_and_agree_with_a_raster(found):
    sites, df = found
    areas = {(r.frame, r.who): r.area for r in df.collect()}
    step = 0.5
    for frame in {s[0] for s in sites}:
        own = [s for s in sites if s[0] == frame]
        assert abs(sum(areas[frame, s[1]] for s in own) - 105 * 68) < 1e-6
        xs, ys = np.meshgrid(np.arange(step / 2, 105, step), np.arange(step / 2, 68, step))
        nearest = np.argmin([(xs - s[2]) ** 2 + (ys - s[3]) ** 2 for s in own], axis=0)
        for i, s in enumerate(own):
            # A raster cell counts wholly for one side: the error is along the cell's border.
            assert abs((nearest == i).sum() * step * step - areas[frame, s[1]]) < 0.5 * step * 400
    assert areas[9, 2] == 0 and areas[9, 1] > 0


def test_ridges_are_equally_far_from_both_and_from_no_one_nearer(found):
    sites, df = found
    place = {(s[0], s[1]): s[2:] for s in sites}
    rows = regions.ridges(df, "frame", "who").collect()
    assert rows and all(r.a_id < r.b_id for r in rows)
    for r in rows:
        for x, y in ((r.x1, r.y1), (r.x2, r.y2)):
            gaps = {k[1]: math.dist((x, y), p) for k, p in place.items() if k[0] == r.frame}
            assert abs(gaps[r.a_id] - gaps[r.b_id]) < 0.01 and gaps[r.a_id] < min(gaps.values()) + 0.01


def test_who_arrives_first(spark):
    sites = [(1, 1, 10.0, 34.0, 0.0, 0.0), (1, 2, 30.0, 34.0, 0.0, 0.0), (2, 1, 10.0, 34.0, 8.0, 0.0), (2, 2, 30.0, 34.0, 80.0, 0.0)]
    df = spark.createDataFrame(sites, SITES + ", vx double, vy double")
    found = {(r.frame, r.px, r.py): (r.site, r.seconds) for r in regions.first_to_arrive(df, "frame", "who", 105, 1).collect()}
    assert len(found) == 210
    for px in range(105):
        x = px + 0.5
        still = min((round(0.7 + abs(x - at) / 8, 6), who) for who, at in ((1, 10.0), (2, 30.0)))
        run = min((round(0.7 + abs(x - at) / 8, 6), who) for who, at in ((1, 15.6), (2, 35.6)))  # 8 m/s at most
        assert found[1, px, 0] == (still[1], still[0]) and found[2, px, 0] == (run[1], run[0])


def plain_lab(r, g, b):
    c = [v / 255 for v in (r, g, b)]
    c = [((v + 0.055) / 1.055) ** 2.4 if v > 0.04045 else v / 12.92 for v in c]
    x, y, z = (sum(k * v for k, v in zip(row, c)) / w for row, w in zip(colours.XYZ, colours.WHITE))
    f = lambda t: t ** (1 / 3) if t > 0.008856 else 7.787 * t + 16 / 116
    light = 116 * y ** (1 / 3) - 16 if y > 0.008856 else 903.3 * y
    return round(light * 2.55), round(500 * (f(x) - f(y)) + 128), round(200 * (f(y) - f(z)) + 128)


def plain_jersey(pixels):
    """Clusters of one crop, pixel by pixel."""
    points = [np.array(plain_lab(*p), float) for p in pixels]
    grass = np.array(colours.GRASS)
    centres = [max(points, key=lambda p: ((p - grass) ** 2).sum())]
    while len(centres) < min(3, len(points)):
        centres.append(max(points, key=lambda p: min(((p - c) ** 2).sum() for c in centres)))
    for _ in range(20):
        near = [min(range(len(centres)), key=lambda k: ((p - centres[k]) ** 2).sum()) for p in points]
        new = [np.mean([p for p, n in zip(points, near) if n == k], axis=0) if k in near else c for k, c in enumerate(centres)]
        moved = max(np.sqrt(((a - b) ** 2).sum()) for a, b in zip(new, centres))
        centres = new
        if moved <= 1.0:
            break
    scores = [np.sqrt(((c - grass) ** 2).sum()) * near.count(k) if k in near else -1 for k, c in enumerate(centres)]
    best = max(range(len(centres)), key=lambda k: scores[k])
    return centres[best], near.count(best), scores[best]


@pytest.fixture(scope="module")
def crops(spark):
    rng = random.Random(7)
    rows = []
    for i in range(60):
        kit = [rng.randrange(256) for _ in range(3)]
        count = rng.choice([0, 3, 7, 8, 20, 90])
        shades = [kit, (40, 140, 50), (200, 170, 140)]
        rows.append((i, [tuple(min(255, max(0, c + rng.randint(-9, 9))) for c in rng.choice(shades)) for _ in range(count)]))
    rows += [(100, None), (101, [(10, 10, 10)] * 12)]
    return rows, spark.createDataFrame(rows, "k int, px array<struct<r:int,g:int,b:int>>")


def test_dominant_colours_equal_plain_clusters(crops):
    rows, df = crops
    pixels = dict(rows)
    for r in colours.dominant_colour(df, "px").collect():
        if not pixels[r.k] or len(pixels[r.k]) < 8:
            assert r.jersey is None and r.jersey_score is None
            continue
        centre, count, score = plain_jersey(pixels[r.k])
        assert np.allclose([r.jersey.l, r.jersey.a, r.jersey.b], centre) and r.jersey_pixels == count and abs(r.jersey_score - score) < 1e-6


def test_colour_features_of_plain_crops(crops):
    rows, df = crops
    found = {r.k: r.feature for r in colours.colour_features(df, "px").collect()}
    assert found[100] is None and len(found[101]) == 42
    for k, pixels in rows:
        if not pixels or len(pixels) < 8:
            assert found[k] is None
            continue
        f = found[k]
        for part in (f[:12], f[12:18], f[18:24]):
            assert abs(sum(part) - 1) < 1e-9
        labs = np.array([plain_lab(*p) for p in pixels], float) / 255
        assert np.allclose(f[24:27], np.mean(pixels, 0) / 255) and np.allclose(f[27:30], np.std(pixels, 0) / 255)
        assert np.allclose(f[30:33], labs.mean(0)) and np.allclose(f[33:36], labs.std(0))
    dark = found[101]
    assert dark[37] == 1 and dark[38] == 0 and dark[39] == 0 and dark[0] == 1


def test_blur_equals_a_plain_convolution(spark):
    from matchgrid.operators import heat

    rng = random.Random(3)
    width, height, size = 40, 33, 31
    grid = np.zeros((height, width))
    for _ in range(25):
        grid[rng.randrange(height), rng.choice([0, 1, width - 1, rng.randrange(width)])] += 1
    weights, half = heat.kernel(size), size // 2
    padded = np.pad(grid, half, mode="reflect")
    plain = np.array([[sum(padded[y + i, x + j] * weights[i] * weights[j] for i in range(size) for j in range(size)) for x in range(width)] for y in range(height)])
    plain /= plain.max()
    rows = [(int(x), int(y), int(grid[y, x])) for y, x in zip(*grid.nonzero())]
    found = heat.heat_map(spark.createDataFrame(rows, "px int, py int, n long"), width, height, size).collect()
    assert {(r.px, r.py) for r in found} == {(x, y) for y in range(height) for x in range(width) if round(plain[y, x], 6) > 0.03}
    assert all(abs(r.heat - plain[r.py, r.px]) < 1e-5 and r.level == int(r.heat * 255) for r in found) and max(r.level for r in found) == 255


def test_no_pixel_is_in_two_objects(spark):
    from matchgrid.operators import masks

    rng = random.Random(4)
    runs = []
    for frame in range(5):
        for obj in range(6):
            for y in range(rng.randrange(3), 9):
                x = rng.randrange(30)
                runs.append((frame, obj, y, x, x + rng.randrange(-1, 12), rng.choice([-1.0, 0.0, 1.0, 2.0, 2.0, 3.5])))
    best = {}
    for frame, obj, y, x1, x2, logit in runs:
        for x in range(x1, x2 + 1):
            if logit > 0:
                best[frame, y, x] = max(best.get((frame, y, x), (0, 0)), (logit, -obj))
    want = {k: -v[1] for k, v in best.items()}
    found = masks.exclusive_runs(spark.createDataFrame(runs, "frame int, object int, y int, x1 int, x2 int, logit double"))
    got = [((r.frame, r.y, x), r.object) for r in found.collect() for x in range(r.x1, r.x2 + 1)]
    assert len(got) == len(dict(got)) and dict(got) == want
    boxes = {(r.frame, r.object): (r.x1, r.y1, r.x2, r.y2, r.pixels) for r in masks.mask_boxes(found).collect()}
    for frame in range(5):
        for obj in range(6):
            at = [k for k, o in want.items() if o == obj and k[0] == frame]
            assert ((frame, obj) in boxes) == (len(at) >= 10)
            if len(at) >= 10:
                assert boxes[frame, obj] == (min(k[2] for k in at), min(k[1] for k in at), max(k[2] for k in at), max(k[1] for k in at), len(at))


def test_components_of_many_small_graphs(spark):
    from matchgrid.operators import boxgroups

    rng = random.Random(5)
    edges = [(f, rng.randrange(20), rng.randrange(20)) for f in range(400) for _ in range(rng.randrange(14))]
    edges += [(1000, i, i + 1) for i in range(3000)]  # a long chain
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for f, a, b in edges:
        x, y = find((f, a)), find((f, b))
        root[max(x, y)] = min(x, y)
    found = boxgroups.components(spark.createDataFrame(edges, "frame int, a_id int, b_id int"), "frame").collect()
    assert {((r.frame, r.node), r.component) for r in found} == {(k, find(k)[1]) for k in root} and len(found) == len(root)
