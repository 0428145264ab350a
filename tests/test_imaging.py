"""Image measurements on synthetic arrays."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalyte.functions import imaging, shapes


def striped(h=120, w=160):
    img = np.full((h, w, 3), 120, np.uint8)
    img[30::40] = img[31::40] = img[32::40] = 30
    return img


def test_lab():
    assert imaging.lab_of(np.array([[[255, 255, 255]]], np.uint8))[0, 0] == pytest.approx([100, 0, 0], abs=0.02)
    assert imaging.lab_of(np.array([[[255, 0, 0]]], np.uint8))[0, 0] == pytest.approx([53.24, 80.09, 67.20], abs=0.05)


def test_box_mean_and_blobs():
    x = np.arange(49.0).reshape(7, 7)
    assert imaging.box_mean(x, 3)[3, 3] == pytest.approx(x[2:5, 2:5].mean())
    mask = np.array([[1, 1, 0, 0, 1], [0, 1, 0, 0, 1], [1, 1, 0, 0, 0]], bool)
    assert sorted(np.bincount(shapes.regions(mask, diagonal=False)[0][mask])[1:].tolist()) == [2, 5]


def test_measured(spark):
    flat = np.full((60, 80, 3), 128, np.uint8)
    rows = [(1, flat.tobytes(), 60, 80), (2, striped().tobytes(), 120, 160), (3, b"short", 9, 9), (4, None, 1, 1), (5, b"\0" * 12, 2, 2)]
    df = spark.createDataFrame(rows, "id long, pixels binary, height int, width int")
    got = {r.id: r for r in imaging.measured(df).select("*", imaging.image_weight().alias("weight"), imaging.design().alias("d"), imaging.vein_traits().alias("v"), imaging.spot_distribution().alias("s")).collect()}
    assert got[1].error is None and got[1].d.design == "plain" and got[1].exposure_score == pytest.approx(1.0)
    assert got[2].vein_coverage > 0 and got[2].d.design == "veiny" and 0 < got[2].weight <= 1
    assert got[3].error and got[4].error and got[5].error is None and got[5].blur_score == 0


def test_colours_of_images(spark):
    green, half = np.zeros((100, 100, 3), np.uint8), np.full((100, 100, 3), (200, 200, 200), np.uint8)
    green[:] = (40, 110, 60)
    half[:, 50:] = (150, 60, 60)
    veined = np.full((200, 200, 3), 90, np.uint8)
    veined[40::40] = veined[41::40] = veined[42::40] = (230, 180, 60)
    rows = [(1, "a", green.tobytes(), 100, 100), (2, "b", half.tobytes(), 100, 100), (3, "c", veined.tobytes(), 200, 200), (4, "c", None, 1, 1)]
    m = imaging.measured(spark.createDataFrame(rows, "id long, item string, pixels binary, height int, width int"))
    got = {r.id: r for r in imaging.coloured(m).collect()}
    assert got[1].base_color == "green" and not got[1].is_exotic and got[2].is_exotic
    assert {r["item"]: r.vein_colour for r in imaging.vein_colours(m, "item").collect()} == {"a": "none", "b": "none", "c": "gold"}


def test_clusters_are_the_parts():
    rng = np.random.default_rng(1)
    centres = np.array([[30.0, 0, 0], [60, 40, 20], [85, -30, 10]])
    at = rng.permutation(np.repeat([0, 1, 2], [300, 500, 200]))
    share, centre, own = imaging.clusters(centres[at] + rng.normal(size=(1000, 3)), 3)
    assert share.tolist() == [0.5, 0.3, 0.2] and np.abs(centre - centres[[1, 0, 2]]).max() < 0.5
    assert (own == np.array([1, 0, 2])[at]).all()
    share, _, own = imaging.clusters(np.ones((250, 3)), 3)
    assert share[0] == 1.0 and (own == 0).all()


def test_dark_grounds():
    where = np.ones((40, 40), bool)
    grey = np.zeros((40, 40, 3))
    grey[..., 0] = np.linspace(10, 50, 1600).reshape(40, 40)
    m = imaging.ground_colour(grey, np.zeros((40, 40)), where)
    assert m["colour_l"] == pytest.approx(16, abs=0.1) and m["light_mean"] == pytest.approx(30) and m["light_var"] == pytest.approx(40**2 / 12, rel=0.01)
    grey[..., 1] = 30  # dark and red: its shadows do not decide
    assert imaging.ground_colour(grey, np.zeros((40, 40)), where)["colour_l"] == pytest.approx(30)
    none = imaging.ground_colour(grey, np.zeros((40, 40)), where & False)
    assert none["ground_pixels"] == 0 and none["top_share"] == 1 and not imaging.grounds(grey, where & False)["second_share"]


def test_gates_of_the_base_colour(spark):
    usual = dict.fromkeys((m for m in imaging.MEASURES), 0.0) | {"ground_pixels": 5000.0, "top_share": 1.0, "exposure_score": 1.0, "colour_sat": 0.3}

    def lab(l, a, b, **more):
        return {"colour_l": l, "colour_a": a, "colour_b": b} | more

    def two(first, second, a, b, **more):
        return {"top_share": first, "next_share": second} | dict(zip(("top_a", "top_b", "next_a", "next_b"), map(float, (*a, *b)))) | more

    exotic = {"second_share": 0.4, "delta_ab": 30.0, "second_cells": 8.0, "part1_share": 0.5, "part1_l": 90.0, "part2_share": 0.4, "part2_l": 45.0, "part2_a": 45.0, "part2_b": 20.0, "part3_share": 0.1, "part3_l": 15.0}
    red = (45.0, 45.0, 20.0)
    cases = {
        "few pixels": (lab(*red, ground_pixels=9.0), "grey", 0.30, "few_pixels"),
        "light and unsaturated is white, tint or not": (lab(75.0, 9.0, 9.0, colour_sat=0.10), "white", 0.85, "light_unsaturated"),
        "glare does not touch such a white": (lab(80.0, 0.0, 0.0, colour_sat=0.0, glare_ratio=0.6, exposure_score=0.2), "white", 0.85, "light_unsaturated"),
        "neutral white": (lab(75.1, 0.0, 0.0), "white", 0.75, "neutral"),
        "very light is surer": (lab(90.1, 0.0, 0.0), "white", 0.85, "neutral"),
        "neutral grey": (lab(75.0, 0.0, 0.0), "grey", 0.75, "neutral"),
        "neutral beige": (lab(74.0, 0.0, 8.1), "beige", 0.75, "neutral"),
        "neutral black": (lab(41.9, 0.0, 0.0), "black", 0.75, "neutral"),
        "very dark is surer": (lab(29.9, 0.0, 0.0), "black", 0.85, "neutral"),
        "the limit of chroma falls with lightness to 4": (lab(15.0, 4.0, 0.0), "black", 1 - 4 / 50, "nearest"),
        "just below it": (lab(15.0, 3.9, 0.0), "black", 0.85, "neutral"),
        "red": (lab(*red), "red", 0.95, "nearest"),
        "pale red is brown": (lab(*red, colour_sat=0.14), "brown", 0.60, "pale"),
        "unsure red is brown": (lab(45.0, 60.0, 20.0), "brown", 0.70, "unsure"),
        "red at the limit": (lab(45.0, 57.5, 20.0), "red", 0.75, "nearest"),
        "green": (lab(45.0, -25.0, 15.0), "green", 0.95, "nearest"),
        "pale green is grey": (lab(45.0, -25.0, 15.0, colour_sat=0.1), "grey", 0.60, "pale"),
        "unsure green is grey": (lab(45.0, -40.0, 15.0), "grey", 0.70, "unsure"),
        "never less than a half": (lab(45.0, -90.0, 90.0), "yellow", 0.5, "nearest"),
        "glare": (lab(60.0, 0.0, 0.0, glare_ratio=0.2), "grey", 0.75 * 0.7, "neutral"),
        "glare and exposure have floors": (lab(60.0, 0.0, 0.0, glare_ratio=0.9, exposure_score=0.1), "grey", 0.75 * 0.2 * 0.3, "neutral"),
        "multi by hue": (lab(*red, **two(0.45, 0.40, (40, 0), (-10, 40))), "multi", 0.80, "multi"),
        "multi, one neutral": (lab(*red, **two(0.45, 0.40, (40, 0), (7, 0))), "multi", 0.80, "multi"),
        "multi at most .9": (lab(*red, **two(0.35, 0.34, (40, 0), (7, 0))), "multi", 0.90, "multi"),
        "hues around zero are near": (lab(*red, **two(0.45, 0.40, (40, 10), (40, -10))), "red", 0.95, "nearest"),
        "not sure enough of multi": (lab(*red, **two(0.50, 0.40, (40, 0), (7, 0))), "red", 0.95, "nearest"),
        "the first is too large": (lab(*red, **two(0.60, 0.40, (40, 0), (7, 0))), "red", 0.95, "nearest"),
        "the second is too small": (lab(*red, **two(0.45, 0.30, (40, 0), (7, 0))), "red", 0.95, "nearest"),
        "exotic goes before multi": (lab(*red, **two(0.45, 0.40, (40, 0), (7, 0)), **exotic), "exotic", 0.80, "exotic"),
    }
    schema = "case string, " + ", ".join(f"{m} double" for m in imaging.MEASURES)
    df = spark.createDataFrame([(k, *(({**usual, **c[0]})[m] for m in imaging.MEASURES)) for k, c in cases.items()], schema)
    got = {r["case"]: r for r in imaging.coloured(df).collect()}
    for case, (_, name, confidence, rule) in cases.items():
        r = got[case]
        assert (r.base_color, r.base_color_rule) == (name, rule) and r.base_color_conf == pytest.approx(confidence), (case, r)
        assert r.colors_in_stone == (["white", "red"] if name == "exotic" else []) and r.colors_in_stone_conf == pytest.approx(0.8 if name == "exotic" else 0)
    light = [(39.9, 0.0, 50.0), (40.0, 100.0, 50.0), (70.0, 900.0, 50.0), (70.1, 500.0, 50.0), (90.0, 0.0, 5.0)]
    tones = [tuple(({**usual, **dict(zip(("light_mean", "light_var", "ground_pixels"), x))})[m] for m in imaging.MEASURES) for x in light]
    tones = spark.createDataFrame([("", *x) for x in tones], schema)
    assert [(r.tonality, r.tonality_conf) for r in imaging.coloured(tones).collect()] == [("dark", 1.0), ("medium", 0.9), ("medium", 0.5), ("light", 0.5), ("medium", 0.3)]


def test_multi_of_an_image(spark):
    thirds = np.zeros((120, 240, 3), np.uint8)
    for at, c in ((0, (170, 60, 60)), (97, (60, 120, 70)), (142, (70, 80, 160))):  # thirds of what the margins leave
        thirds[:, at:] = c
    m = imaging.measure(thirds)
    assert 0.3 < m["top_share"] < 0.5 and m["next_share"] > 0.3 and m["part3_share"] > 0.15
    df = imaging.measured(spark.createDataFrame([(1, thirds.tobytes(), 120, 240)], "id long, pixels binary, height int, width int"))
    r = imaging.coloured(df).first()
    assert r.is_exotic and r.base_color == "exotic" and set(r.colors_in_stone) >= {"red", "green"}
    assert imaging.coloured(df.withColumn("second_cells", F.lit(3.0))).first().base_color == "multi"


def test_methods_generated_for_colours_can_be_compiled(spark, capsys):
    from catalyte import queries

    queries.QUERIES["colour_gates"](spark, "/root/testdata/sf0.001").explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:\s*(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000  # the JVM's limit for a method
