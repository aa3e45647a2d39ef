import random

import numpy as np
import pytest

from glyphmill.operators import layout, pixels, providers

rng = np.random.default_rng(4)


def flood(mask, diagonal):
    h, w = mask.shape
    label = np.zeros((h, w), int)
    many = 0
    for y in range(h):
        for x in range(w):
            if mask[y, x] and not label[y, x]:
                many += 1
                todo = [(y, x)]
                label[y, x] = many
                while todo:
                    a, b = todo.pop()
                    for dy in (-1, 0, 1):
                        for dx in (-1, 0, 1):
                            if (dy or dx) and (diagonal or not (dy and dx)):
                                c, d = a + dy, b + dx
                                if 0 <= c < h and 0 <= d < w and mask[c, d] and not label[c, d]:
                                    label[c, d] = many
                                    todo.append((c, d))
    return label, many


@pytest.mark.parametrize("diagonal", [True, False])
@pytest.mark.parametrize("share", [0.2, 0.5, 0.7])
def test_components_equal_flood_fill(share, diagonal):
    for _ in range(10):
        mask = rng.random((13, 17)) < share
        label, many = pixels.components(mask, diagonal)
        other, n = flood(mask, diagonal)
        assert many == n and len({(a, b) for a, b in zip(label.ravel(), other.ravel())}) == n + (not mask.all())
        boxes = pixels.component_boxes(label, many)
        assert boxes[:, 4].sum() == mask.sum()
    assert pixels.components(np.zeros((3, 3), bool))[1] == 0


def test_holes_growth_and_runs():
    ring = np.zeros((9, 9), bool)
    ring[2:7, 2:7] = True
    ring[3:6, 3:6] = False
    assert pixels.enclosed(ring).sum() == 9 and pixels.filled(ring, 3).sum() == 25 and pixels.filled(ring, 2).sum() == ring.sum()
    dot = np.zeros((5, 5), bool)
    dot[2, 2] = True
    assert pixels.grown(dot, 1).sum() == 9 and pixels.grown(dot, 0).sum() == 1
    row = np.array([[1, 1, 0, 1, 1, 1, 0]], bool)
    assert pixels.run_lengths(row).tolist() == [[2, 2, 0, 3, 3, 3, 0]] and pixels.longest_runs(row).tolist() == [3] and pixels.band_span(row) == (3, 3)


def test_panels_are_cut_along_gutters():
    page = np.zeros((60, 60), bool)
    page[2:25, 2:25] = page[2:25, 35:58] = page[35:58, 2:58] = True
    assert pixels.panels(page) == [(2, 2, 23, 23), (35, 2, 23, 23), (2, 35, 56, 23)]
    assert pixels.panels(np.zeros((5, 5), bool)) == []


def test_cleaning_and_proofs():
    page = np.full((20, 20, 3), 200, np.uint8)
    mask = np.zeros((20, 20), np.uint8)
    mask[5:9, 5:9] = 255
    assert pixels.strategy(page, mask)[0] == "flat" and pixels.strategy(rng.integers(0, 255, (20, 20, 3)), mask)[0] == "inpaint"
    assert pixels.strategy(page, np.ones((20, 20)))[0] == "refuse"
    done = pixels.composite(page, np.zeros_like(page), mask)
    assert done[6, 6].tolist() == [0, 0, 0] and pixels.changed_outside(page, done, mask) == (0, 384, 0)
    assert pixels.changed_outside(page, done, mask * 0)[0] == 16
    grey = np.where(np.arange(20)[:, None] < 10, 10, 240) * np.ones((1, 20), int)
    assert 10 <= pixels.otsu(grey) < 240
    assert pixels.difference(pixels.appearance(grey.astype(np.uint8)), pixels.appearance(grey.astype(np.uint8))) == 0
    assert pixels.surviving_ink(grey, np.full_like(grey, 255), mask) == 0.0
    assert pixels.union_mask([mask, mask * 0])[1] == 16 / 400
    assert abs(pixels.tilt(np.eye(9))[0] - 45) < 1e-6


def test_bands_and_reading_places():
    # the third box joins the first row though a newer row is there
    assert layout.bands([(0, 0, 10, 100), (20, 70, 10, 100), (40, 60, 10, 10)]) == [0, 1, 0]
    grid = [(0, 0, 10, 10), (20, 1, 10, 10), (0, 30, 10, 10), (20, 29, 10, 10)]
    assert layout.reading_places(grid, False) == [1, 2, 3, 4] and layout.reading_places(grid, True) == [2, 1, 4, 3]
    assert layout.reading_places([], True) == []
    # the right panel is read first leftward; what has no panel comes last
    assert layout.page_places([(0, 0, 10, 10), (50, 0, 10, 10), (50, 30, 10, 10), (20, 0, 5, 5)], ["a", "b", "b", None], True) == [3, 1, 2, 4]


def test_suppression_keeps_the_surer(spark):
    assert layout.suppress([(0, 0, 10, 10), (1, 1, 10, 10), (2, 2, 3, 3), (50, 50, 5, 5)]) == [True, False, False, True]
    rows = [("p", 1, [0, 0, 10, 10], 0.2), ("p", 2, [1, 1, 10, 10], 0.9), ("q", 3, None, 0.5)]
    df = spark.createDataFrame(rows, "page string, k bigint, box array<int>, sure double")
    assert {r.k: r.kept for r in layout.suppressed(df, ["page"], "k", "box", "sure").collect()} == {1: False, 2: True, 3: True}


def test_clusters_equal_union_find(spark):
    made = random.Random(2)
    boxes = [[made.randrange(900), made.randrange(900), 12, made.randrange(5, 30)] for _ in range(80)]
    df = spark.createDataFrame([("p", i, b) for i, b in enumerate(boxes)], "page string, k bigint, box array<int>")
    got = {r.k: r.cluster for r in layout.clusters(df, ["page"], "k", "box").collect()}
    root = list(range(len(boxes)))

    def gap(a, b):
        dx = max(0, max(a[0], b[0]) - min(a[0] + a[2], b[0] + b[2]))
        dy = max(0, max(a[1], b[1]) - min(a[1] + a[3], b[1] + b[3]))
        return (dx * dx + dy * dy) ** 0.5

    for _ in boxes:
        for i, a in enumerate(boxes):
            for j, b in enumerate(boxes):
                if gap(a, b) <= 1.1 * max(a[2], a[3], b[2], b[3]):
                    root[i] = root[j] = min(root[i], root[j])
    assert got == dict(enumerate(root))


def test_providers(spark):
    p = providers.Providers()
    p.register("translation", "echo", providers.echo("> "))
    with pytest.raises(ValueError):
        p.register("cook", "x", print)
    with pytest.raises(LookupError):
        p.get("ocr", "echo")
    df = spark.createDataFrame([(1, "a"), (2, None)], "k bigint, text string").coalesce(1)
    rows = {r.k: r for r in providers.call(df, "k", ["text"], p.get("translation", "echo")).collect()}
    assert (rows[1].value, rows[1].status, rows[2].status) == ("> a", "ok", "empty")

    def broken(texts):
        raise RuntimeError("secret")

    assert {r.detail for r in providers.call(df, "k", ["text"], broken).collect()} == {"RuntimeError"}

    def slow(texts):
        import time

        time.sleep(3)

    assert {r.status for r in providers.call(df, "k", ["text"], slow, timeout=0.2).collect()} == {"timeout"}
    assert {r.status for r in providers.call(df, "k", ["text"], lambda t: [("x", 7)] * len(t)).collect()} == {"failed"}
