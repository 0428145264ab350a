"""The colour agent: clustering against all partitions, patches of painted images, summaries by hand."""

from itertools import product

import numpy as np
import pytest

from catalyte.functions import patches


def image(rgb, h=600, w=800):
    return np.broadcast_to(np.array(rgb, np.uint8), (h, w, 3)).copy()


def test_two_means_equals_the_best_partition():
    rng = np.random.default_rng(3)
    for n in (2, 3, 5, 8, 9):
        for _ in range(12):
            points, counts = rng.normal(size=(n, 3)) * 10, rng.integers(1, 11, n)
            best = np.inf
            for side in product((0, 1), repeat=n):
                side = np.array(side)
                if 0 < side.sum() < n:
                    best = min(best, sum((((points[side == k] - np.average(points[side == k], axis=0, weights=counts[side == k])) ** 2).sum(1) * counts[side == k]).sum() for k in (0, 1)))
            own, centre, cost = patches.two_means(points, counts)
            assert cost == pytest.approx(best) and own[0] == 0
            assert all(centre[k] == pytest.approx(np.average(points[own == k], axis=0, weights=counts[own == k])) for k in (0, 1))
    own, _, cost = patches.two_means(np.ones((40, 3)), np.ones(40, int))
    assert cost == 0 and (own == 0).all()


def test_sample():
    found = patches.sample(image((180, 60, 60)), "x")
    assert len(found) == 36 and {c for c, *_ in found} == set(range(36)) and all(w == 1 and g == 0 for *_, w, g in found)
    assert found == patches.sample(image((180, 60, 60)), "x")
    assert patches.sample(image((255, 255, 255)), "x") == [] and patches.sample(image((9, 9, 9), 60, 60), "x") == []
    half = image((60, 60, 60))
    half[:, :400] = 250  # glare
    assert {c % 6 for c, *_ in patches.sample(half, "x")} <= {2, 3, 4, 5}
    assert max(patches.cropped(image((1, 2, 3), 3000, 2000)).shape) == 800


def test_colours(spark):
    two = image((200, 200, 190))
    two[:, 400:] = (150, 50, 50)
    small = image((200, 200, 190))
    small[80:170, 80:170] = (20, 90, 20)  # one corner of the grid
    rows = [("one", 1, 1, image((90, 90, 200))), ("two", 2, 1, two), ("two", 3, 2, two), ("corner", 4, 1, small), ("white", 5, 1, image((255, 255, 255)))]
    rows += [("many", 10 + k, k, image((200, 30, 30) if k < 3 else (30, 200, 30))) for k in range(6)]
    rows = [(e, i, s, p.tobytes(), *p.shape[:2]) for e, i, s, p in rows] + [("broken", 6, 1, b"abc", 9, 9), ("broken", 7, 2, None, None, None), ("late", 8, 1, None, None, None)]
    rows += [("late", 9 + 100 * k, 2 + k, image((200, 30, 30)).tobytes(), 600, 800) for k in range(3)]
    df = spark.createDataFrame(rows, "item string, image long, seq long, pixels binary, height int, width int").repartition(3)
    got = {r["item"]: r for r in patches.colours(df, "item").collect()}
    assert got["two"].has_second and got["two"].second_share == pytest.approx(0.5, abs=0.1) and got["two"].delta_ab > 30 and got["two"].patch_count == 72
    assert not got["one"].has_second and got["one"].delta_ab == 0 and got["one"].patch_count == 36
    assert not got["corner"].has_second and got["corner"].second_cell_spread <= 4
    assert got["many"].patch_count == 108 and got["many"].main_a > 40 and not got["many"].has_second  # the first three only
    assert got["late"].patch_count == 72  # an image without patches is one of the first three
    for k in ("white", "broken"):
        assert got[k].patch_count == 0 and got[k].main_share == 1 and got[k].lightness_mean is None and not got[k].has_second
    assert len(got) == 7 and patches.colours(df.limit(0), "item").collect() == []


def test_summary_counts_any_cells_before_its_shuffle(spark):
    rows = [(e, c, 1.0 + c % 3, 50.0, (c // 7) % 2, *[float(e)] * 6) for e in (1, 2) for c in [*range(-70, 200, 3 + e), 5, 5, 63, 64, None] if c is not None]
    rows += [(3, None, None, None, None, *[None] * 6), (1, None, None, None, None, *[None] * 6)]
    df = spark.createDataFrame(rows, "item long, cell int, weight double, l double, label int, " + ", ".join(f"{c}{k} double" for k in (0, 1) for c in "lab"))
    got = patches.colour_summary(df, "item")
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()  # a distinct count would make a row for each cell
    found = {r["item"]: r for r in got.collect()}
    for e in (1, 2):
        own = [r for r in rows if r[0] == e and r[1] is not None]
        weights = [sum(r[2] for r in own if r[4] == k) for k in (0, 1)]
        second = 1 if weights[0] >= weights[1] else 0
        assert found[e].patch_count == len(own) and found[e].total_cells == len({r[1] for r in own})
        assert found[e].second_cell_spread == len({r[1] for r in own if r[4] == second}) and found[e].second_share == pytest.approx(min(weights) / sum(weights), abs=6e-4)
    assert (found[3].patch_count, found[3].total_cells, found[3].main_share) == (0, 0, 1.0)
