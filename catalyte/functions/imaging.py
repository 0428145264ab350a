"""Per-image measurements: pixels are measured in an Arrow UDF, decisions are columns.

An image is raw RGB (height, width, bytes); decoding files is the caller's choice of library.
Pixel arrays never leave the task: what comes out is a small struct of numbers, from which
the rules below make labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .colors import nearest_centre, vein_colour
from .shapes import Shape, closed, distances, opened, ridge, shapes, smoothed

# --- fixed values: margins, thresholds, weights ----------------------------------------
MARGIN, INNER = 0.15, 0.10
GLARE = {"value": 0.92, "saturation": 0.08}
REFLECTION = {"offset": 12.0, "saturation": 0.12, "variance_pct": 70}
VEIN = {"delta_e": 10.0, "l_weight": 0.35, "edge_pct": 85, "chroma": 8.0}
PATTERN = {"area": 30, "long": 2.5, "round": 0.5, "compact": 2.0, "oblong": 1.5, "least": 50}
#: L* in these distances is on a scale of 255, as a* and b* are in steps of one.
L_SCALE = 2.55
EXOTIC = {"second": 0.30, "delta_ab": 10.0, "cells": 6, "named": 0.15, "most": 0.90}
COLOUR = {"least": 100, "few": 10, "clustered": 200, "dark": 50.0, "dark_share": 30}
WHITE = {"lightness": 75.0, "saturation": 0.10, "confidence": 0.85, "least": 0.80}
NEUTRAL = {"white": 75.0, "black": 42.0, "beige_b": 8.0, "light": 90.0, "dark": 30.0, "sure": 0.85, "usual": 0.75}
PALE = {"saturation": 0.15, "confidence": 0.60, "sure": 0.75}
MULTI = {"first": 0.60, "second": 0.30, "hue": 60.0, "sure": 0.75, "most": 0.90}
SHADE = {"glare": 1.5, "glare_least": 0.2, "exposure_least": 0.3, "most": 0.95}
TONE = {"dark": 40.0, "light": 70.0, "variance": 1000.0, "loss": 0.5}
#: What red and green become where they are pale or unsure.
PALE_NAMES = {"red": "brown", "green": "grey"}
NEUTRAL_CHROMA, NEUTRAL_LEAST, NEUTRAL_AT = 8.0, 4.0, 70.0
#: Named colours in L*a*b*, and those a colour of low chroma may get.
CENTRES = {
    "white": (92, 0, 0),
    "grey": (60, 0, 0),
    "black": (15, 0, 0),
    "beige": (80, 5, 15),
    "brown": (45, 10, 20),
    "yellow": (80, -5, 50),
    "red": (45, 45, 20),
    "rose": (70, 25, 10),
    "pink": (75, 20, 5),
    "green": (45, -25, 15),
}
NEUTRALS = ["white", "grey", "black", "beige"]
#: Hue ranges of veins, in degrees; pink wraps around.
HUES = {"gold": (25, 90), "green": (90, 165), "grey": (165, 250), "pink": (250, 385)}
MEASURES = [
    "blur_score", "exposure_score", "glare_ratio", "reflection_ratio", "stone_area_ratio", "median_l", "median_a", "median_b",
    "vein_coverage", "spot_coverage", "spot_count", "low_freq_energy", "dominant_angle", "coherence", "entropy", "rel_width", "vein_width", "spot_cv",
    "ground_pixels", "colour_l", "colour_a", "colour_b", "colour_sat", "light_mean", "light_var", "top_share", "top_a", "top_b", "next_share", "next_a", "next_b", "pixels", "vein_pixels", "hue_gold", "hue_green", "hue_grey", "hue_pink", "neutral_pixels", "neutral_l", "second_share", "delta_ab", "second_cells",
    "part1_share", "part1_l", "part1_a", "part1_b", "part2_share", "part2_l", "part2_a", "part2_b", "part3_share", "part3_l", "part3_a", "part3_b",
]


def lab_of(rgb: np.ndarray) -> np.ndarray:
    """CIE L*a*b* (D65) of 8-bit sRGB."""
    c = rgb.astype(np.float64) / 255
    c = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    xyz = c @ np.array([[0.4124564, 0.2126729, 0.0193339], [0.3575761, 0.7151522, 0.1191920], [0.1804375, 0.0721750, 0.9503041]]) / np.array([0.95047, 1.0, 1.08883])
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)


def box_mean(x: np.ndarray, size: int) -> np.ndarray:
    """Mean over a square around each pixel, edges reflected."""
    half = size // 2
    s = np.pad(np.cumsum(np.cumsum(np.pad(x, half, mode="reflect" if min(x.shape) > half else "edge"), 0), 1), ((1, 0), (1, 0)))
    return (s[size:, size:] - s[:-size, size:] - s[size:, :-size] + s[:-size, :-size]) / size**2


def gradients(gray: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = np.pad(gray, 1, mode="edge")
    smooth_y, smooth_x = p[:-2] + 2 * p[1:-1] + p[2:], p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    return smooth_y[:, 2:] - smooth_y[:, :-2], smooth_x[2:] - smooth_x[:-2]


def vein_or_spot(shape: Shape) -> str:
    """Long shapes are veins, round or compact ones spots."""
    if shape.aspect > PATTERN["long"]:
        return "vein"
    if shape.circularity > PATTERN["round"] and shape.aspect < PATTERN["compact"]:
        return "spot"
    return "vein" if shape.aspect > PATTERN["oblong"] else "spot"


def patterns(candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The masks of veins and of spots: gaps closed, specks opened away, then each outline by its shape, filled."""
    found = {"vein": np.zeros(candidates.shape, bool), "spot": np.zeros(candidates.shape, bool)}
    for shape in shapes(opened(closed(candidates)), PATTERN["area"]):
        found[vein_or_spot(shape)][shape.rows, shape.columns] |= shape.filled
    return found["vein"], found["spot"]


def clusters(points: np.ndarray, k: int, rounds: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(share, centre, own) of ``k`` clusters of L*a*b* points, the largest first; own is a point's cluster.

    The first centres are lightness quantiles, so the same points give the same clusters.
    """
    centre = points[np.argsort(points[:, 0], kind="stable")[[len(points) * (2 * j + 1) // (2 * k) for j in range(k)]]].copy()
    for _ in range(rounds):
        own = ((points[:, None] - centre[None]) ** 2).sum(-1).argmin(1)
        fresh = np.array([points[own == j].mean(0) if (own == j).any() else centre[j] for j in range(k)])
        if np.allclose(fresh, centre):
            break
        centre = fresh
    share = np.bincount(own, minlength=k) / len(points)
    order = np.argsort(-share, kind="stable")
    return share[order], centre[order], np.argsort(order)[own]


def grounds(lab: np.ndarray, where: np.ndarray, most: int = 5000) -> dict[str, float]:
    """Three clusters of the ground, the distance in a*b* of the first two, and the cells of a 4 x 4 grid that the second is in.

    Every n-th pixel is taken, none by chance; a ground of few pixels is one part.
    """
    y, x = np.nonzero(where)
    out = dict.fromkeys((m for m in MEASURES if m.startswith(("part", "second")) or m == "delta_ab"), 0.0)
    if len(y) < COLOUR["clustered"]:
        return out
    step = -(-len(y) // most)
    y, x = y[::step], x[::step]
    share, centre, own = clusters(lab[y, x], 3)
    cells = {(a * 4 // where.shape[0], b * 4 // where.shape[1]) for a, b in zip(y[own == 1].tolist(), x[own == 1].tolist())}
    for j in range(3):
        out |= {f"part{j + 1}_share": float(share[j])} | {f"part{j + 1}_{c}": float(v) for c, v in zip("lab", centre[j])}
    return out | {"second_share": float(share[1]), "delta_ab": float(np.hypot(*(centre[0] - centre[1])[1:])), "second_cells": float(len(cells))}


def ground_colour(lab: np.ndarray, saturation: np.ndarray, where: np.ndarray, most: int = 5000) -> dict[str, float]:
    """Mean colour, saturation and lightness of the ground, and its two largest clusters.

    Of a dark ground without colour the darkest pixels count alone, as haze lifts the rest; a dark
    ground with colour keeps all, as its darkest pixels are shadows.
    """
    names = ("ground_pixels", "colour_l", "colour_a", "colour_b", "colour_sat", "light_mean", "light_var", "top_share", "top_a", "top_b", "next_share", "next_a", "next_b")
    points = lab[where]
    out = dict.fromkeys(names, 0.0) | {"ground_pixels": float(len(points)), "top_share": 1.0}
    if len(points) < COLOUR["few"]:
        return out
    light = points[:, 0]
    middle = np.median(points, 0)
    out |= {"colour_sat": float(saturation[where].mean()), "light_mean": float(light.mean()), "light_var": float(light.var())}
    if middle[0] < COLOUR["dark"] and np.hypot(*middle[1:]) < max(NEUTRAL_LEAST, NEUTRAL_CHROMA * middle[0] / NEUTRAL_AT):
        dark = points[light <= np.percentile(light, COLOUR["dark_share"])]
        points = dark if len(dark) >= COLOUR["few"] else points
    out |= {f"colour_{c}": float(v) for c, v in zip("lab", points.mean(0))}
    some = points[:: -(-len(points) // most)]
    if out["ground_pixels"] >= COLOUR["clustered"] and len(some) >= 100:
        share, centre, _ = clusters(some, max(2, min(3, len(some) // 50)))
        for j, name in enumerate(("top", "next")):
            out |= {f"{name}_share": float(share[j]), f"{name}_a": float(centre[j][1]), f"{name}_b": float(centre[j][2])}
    return out


def measure(rgb: np.ndarray) -> dict[str, float]:
    """All measurements of one image; an image too small to have an inside gives zeros.

    ``rel_width`` is twice the median distance of vein pixels from their edge, as a share of the
    width; ``vein_width`` is the width in pixels along the middle lines of the veins.
    """
    h, w = rgb.shape[:2]
    my, mx = int(h * MARGIN), int(w * MARGIN)
    rgb_in = rgb[my : h - my, mx : w - mx]
    if min(rgb_in.shape[:2]) < 4:
        return dict.fromkeys(MEASURES, 0.0)
    lab = lab_of(rgb_in)
    value, least = rgb_in.max(-1) / 255.0, rgb_in.min(-1) / 255.0
    saturation = np.where(value > 0, (value - least) / np.maximum(value, 1e-9), 0.0)
    gray = rgb_in.astype(np.float64) @ np.array([0.299, 0.587, 0.114])
    sy, sx = int(gray.shape[0] * INNER), int(gray.shape[1] * INNER)
    inner = np.zeros(gray.shape, bool)
    inner[sy : gray.shape[0] - sy, sx : gray.shape[1] - sx] = True
    glare = (value > GLARE["value"]) & (saturation < GLARE["saturation"])
    variance = np.maximum(box_mean(gray * gray, 9) - box_mean(gray, 9) ** 2, 0)
    middle = np.median(lab[inner][:, 0])
    reflection = (lab[..., 0] > middle + REFLECTION["offset"] * 100 / 255) & (saturation < REFLECTION["saturation"]) & (variance > np.percentile(variance, REFLECTION["variance_pct"])) & ~glare
    clean = inner & ~glare & ~reflection
    ground = np.median(lab[clean], 0) if clean.sum() >= 50 else np.median(lab.reshape(-1, 3), 0)
    away = np.sqrt(VEIN["l_weight"] * (L_SCALE * (lab[..., 0] - ground[0])) ** 2 + (lab[..., 1] - ground[1]) ** 2 + (lab[..., 2] - ground[2]) ** 2)
    gx, gy = gradients(gray)
    edges = np.hypot(gx, gy)
    marks = (away > VEIN["delta_e"]) & (edges > np.percentile(edges, VEIN["edge_pct"])) & clean
    veins, spots = patterns(marks)
    seen = veins & ~glare & ~reflection
    bins = np.histogram((np.degrees(np.arctan2(gy, gx)) % 180)[seen], 18, (0, 180))[0].astype(float)
    share = bins / bins.sum() if bins.sum() else bins
    depth = distances(seen)
    middle_line = depth[ridge(depth)]
    plain_spots = spots & ~glare & ~reflection
    ch, cw = gray.shape[0] // 4, gray.shape[1] // 4
    cells = [plain_spots[i * ch : (i + 1) * ch, j * cw : (j + 1) * cw].mean() for i in range(4) for j in range(4)] if ch * cw > 100 else [0.0]
    back = clean & ~veins & ~spots
    ground_at = back if back.sum() >= COLOUR["least"] else inner & ~glare
    chroma, hue = np.hypot(lab[..., 1], lab[..., 2])[marks], np.degrees(np.arctan2(lab[..., 2], lab[..., 1]))[marks] % 360
    coloured = chroma >= VEIN["chroma"]
    counts = {n: float((coloured & ((hue >= a) & (hue < b) | (hue + 360 < b))).sum()) for n, (a, b) in HUES.items()}
    laplace = np.pad(gray, 1, mode="edge")
    laplace = laplace[:-2, 1:-1] + laplace[2:, 1:-1] + laplace[1:-1, :-2] + laplace[1:-1, 2:] - 4 * gray
    area = float(gray.size)
    return {
        "blur_score": min(laplace.var() / 500, 1.0),
        "exposure_score": max(0.0, 1 - abs(gray.mean() - 128) / 128),
        "glare_ratio": glare.sum() / area,
        "reflection_ratio": reflection.sum() / area,
        "stone_area_ratio": area / (h * w),
        "median_l": ground[0],
        "median_a": ground[1],
        "median_b": ground[2],
        "vein_coverage": veins.sum() / area,
        "spot_coverage": spots.sum() / area,
        "spot_count": float(len(shapes(spots))),
        "low_freq_energy": float(np.var(smoothed(gray, 51)[clean])) / 1000 if clean.any() else 0.0,
        "dominant_angle": (share.argmax() + 0.5) * 10.0 if bins.sum() else 0.0,
        "coherence": float(share.max()),
        "entropy": float(-(share[share > 0] * np.log2(share[share > 0])).sum()) if bins.sum() else 4.0,
        "rel_width": float(np.median(depth[seen])) * 2 / gray.shape[1] if seen.any() else 0.0,
        "vein_width": float(np.median(middle_line)) * 2 - 1 if len(middle_line) else 0.0,
        "spot_cv": float(np.std(cells) / (np.mean(cells) + 1e-6)),
        **ground_colour(lab, saturation, ground_at),
        "pixels": float(h * w),
        "vein_pixels": float(marks.sum()),
        **{f"hue_{n}": c for n, c in counts.items()},
        "neutral_pixels": float((~coloured).sum()),
        "neutral_l": float(lab[..., 0][marks][~coloured].mean()) if (~coloured).any() else 0.0,
        **grounds(lab, ground_at),
    }


def measured(images: DataFrame, *, pixels: str = "pixels", height: str = "height", width: str = "width") -> DataFrame:
    """``images`` without their pixels, with all measurements and ``error``; a broken image is a row with an error."""
    keep = [c for c in images.columns if c != pixels]
    schema = ", ".join([f"`{c}` {images.schema[c].dataType.simpleString()}" for c in keep] + [f"{m} double" for m in MEASURES] + ["error string"])

    def run(batches):
        for batch in batches:
            rows, errors = [], []
            for raw, h, w in zip(*(batch.column(c).to_pylist() for c in (pixels, height, width))):
                try:
                    rows.append(measure(np.frombuffer(raw, np.uint8).reshape(h, w, 3)))
                    errors.append(None)
                except (TypeError, ValueError) as e:
                    rows.append(dict.fromkeys(MEASURES))
                    errors.append(f"{type(e).__name__}: {e}"[:2000])
            cols = [pa.array([r[m] for r in rows], pa.float64()) for m in MEASURES]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *cols, pa.array(errors, pa.string())], names=[*keep, *MEASURES, "error"])

    return images.mapInArrow(run, schema)


# --- rules -----------------------------------------------------------------------------


def image_weight() -> Column:
    """How much an image counts in votes."""
    glare = 1 - F.least(F.col("glare_ratio") * 2, F.lit(1.0))
    w = 0.25 * (F.col("blur_score") + F.col("exposure_score") + glare + F.least(F.col("stone_area_ratio") / 0.5, F.lit(1.0)))
    w = w * F.greatest(1 - F.col("glare_ratio") * 1.5, F.lit(0.2)) * F.greatest(1 - F.col("reflection_ratio"), F.lit(0.3))
    return F.when(F.col("stone_area_ratio") < 0.25, w * 0.3).otherwise(w)


def design() -> Column:
    """struct(design, confidence): the best of four scores and its margin; nothing to see is plain."""
    veins, spots = F.col("vein_coverage"), F.col("spot_coverage")
    scores = {
        "veiny": veins * 10 + F.when(veins > 0.02, 1.0).otherwise(0.0),
        "spotty": spots * 10 + F.least(F.col("spot_count") * 0.05, F.lit(1.0)),
        "cloudy": F.greatest(F.col("low_freq_energy") - (veins + spots) * 2, F.lit(0.0)),
        "plain": F.greatest(1 - (veins + spots) * 5, F.lit(0.0)),
    }
    ranked = F.reverse(F.array_sort(F.array(*[F.struct(s.alias("s"), F.lit(n).alias("n")) for n, s in scores.items()])))
    total = sum(scores.values(), F.lit(1e-6))
    return F.when(ranked[0]["s"] < 0.1, F.struct(F.lit("plain").alias("design"), F.lit(0.8).alias("confidence"))).otherwise(F.struct(ranked[0]["n"].alias("design"), ((ranked[0]["s"] - ranked[1]["s"]) / total).alias("confidence")))


def vein_traits() -> Column:
    """struct(direction, distribution, thickness)."""
    angle = F.col("dominant_angle")
    direction = F.when((F.col("coherence") < 0.15) | (F.col("entropy") > 3.5), "spider").when((angle < 25) | (angle > 155), "horizontal").when((angle > 65) & (angle < 115), "vertical").otherwise("diagonal")
    cover = F.col("vein_coverage")
    amount = F.when(cover < 0.02, "light_vein").when(cover < 0.08, "medium_vein").otherwise("heavy_vein")
    width = F.when(F.col("rel_width") < 0.005, "light").when(F.col("rel_width") < 0.015, "normal").otherwise("heavy")
    return F.struct(direction.alias("direction"), amount.alias("distribution"), width.alias("thickness"))


def spot_distribution() -> Column:
    cover = F.col("spot_coverage")
    level = F.when(cover < 0.02, "light").when(cover < 0.08, "medium").otherwise("heavy")
    return F.when(F.col("spot_cv") > 0.8, "condensed").otherwise(F.concat(level, F.lit("_homogeneous")))


def faint(l: Column, a: Column, b: Column) -> Column:
    """Is the chroma too low for a colour? The darker, the lower is the limit."""
    return F.sqrt(a * a + b * b) < F.greatest(F.lit(NEUTRAL_LEAST), NEUTRAL_CHROMA * l / NEUTRAL_AT)


def named_colour(l: Column, a: Column, b: Column) -> Column:
    """struct(d, name) of the nearest named colour; one of low chroma gets a neutral name."""
    neutral, any_name = [nearest_centre(l, a, b, [(n, *c) for n, c in CENTRES.items() if n in only]) for only in (NEUTRALS, list(CENTRES))]
    return F.when(faint(l, a, b), neutral).otherwise(any_name)


def exotic() -> Column:
    """Two grounds of different colour that both cover much of the image."""
    return (F.col("second_share") >= EXOTIC["second"]) & (F.col("delta_ab") >= EXOTIC["delta_ab"]) & (F.col("second_cells") >= EXOTIC["cells"])


def _outcome(name, confidence, rule) -> Column:
    parts = (x if isinstance(x, Column) else F.lit(x) for x in (name, confidence, rule))
    return F.struct(*(p.alias(n) for p, n in zip(parts, ("name", "confidence", "rule"))))


def _many() -> Column:
    """struct(multi, confidence): do the two largest clusters differ and is neither much larger?"""
    hues = [F.pmod(F.degrees(F.atan2(F.col(f"{p}_b"), F.col(f"{p}_a"))), F.lit(360.0)) for p in ("top", "next")]
    around = F.abs(hues[0] - hues[1])
    plain = [F.sqrt(F.col(f"{p}_a") ** 2 + F.col(f"{p}_b") ** 2) < NEUTRAL_CHROMA for p in ("top", "next")]
    differ = (F.least(around, 360 - around) > MULTI["hue"]) | (plain[0] != plain[1])
    even = (F.col("top_share") < MULTI["first"]) & (F.col("next_share") > MULTI["second"])
    sure = F.least(0.5 + (MULTI["first"] - F.col("top_share")) * 2, F.lit(MULTI["most"]))
    return F.struct((even & differ & (sure >= MULTI["sure"])).alias("multi"), sure.alias("confidence"))


def coloured(measures: DataFrame) -> DataFrame:
    """``measures`` with base_color, base_color_conf, base_color_rule, is_exotic, colors_in_stone, colors_in_stone_conf, tonality, tonality_conf.

    The base colour is that of the ground beside veins and spots, by the first rule that holds: too few
    pixels are grey; a ground of two colours that both cover much is exotic; two large clusters of clearly
    different hue, or of which one is neutral, are multi if the first is not much larger; a light ground of low saturation is
    white whatever its tint; what has low chroma gets a neutral name by lightness and warmth; the rest
    has the nearest named colour, where red and green that are pale or unsure give way. Glare and bad exposure lower the
    confidence, except of a light ground of low saturation. The parts of an exotic ground are named, the largest first. The
    tonality is the mean lightness, the surer the less it varies. Steps are columns of their own, so that none is worked out twice.
    """
    l, a, b, sat = (F.col(f"colour_{c}") for c in ("l", "a", "b", "sat"))
    steps = measures.withColumns(
        {
            "__near": named_colour(l, a, b),
            **{f"__part{j}": named_colour(*(F.col(f"part{j}_{c}") for c in "lab")) for j in (1, 2, 3)},
            "__faint": faint(l, a, b),
            "__white": (l >= WHITE["lightness"]) & (sat <= WHITE["saturation"]),
            "__many": _many(),
            "is_exotic": exotic(),
        }
    )
    near, white, many, is_exotic = (F.col(c) for c in ("__near", "__white", "__many", "is_exotic"))
    near_sure = 1 - F.least(near["d"] / 50, F.lit(0.5))
    neutral = F.when(l > NEUTRAL["white"], "white").when(l < NEUTRAL["black"], "black").when(b > NEUTRAL["beige_b"], "beige").otherwise("grey")
    neutral_sure = F.when((l > NEUTRAL["light"]) | (l < NEUTRAL["dark"]), NEUTRAL["sure"]).otherwise(NEUTRAL["usual"])
    gives_way, instead = near["name"].isin(list(PALE_NAMES)), F.lit(None).cast("string")
    for name, other in PALE_NAMES.items():
        instead = F.when(near["name"] == name, other).otherwise(instead)
    single = (
        F.when(many["multi"], _outcome("multi", many["confidence"], "multi"))
        .when(white, _outcome("white", WHITE["confidence"], "light_unsaturated"))
        .when(F.col("__faint"), _outcome(neutral, neutral_sure, "neutral"))
        .when(gives_way & (sat < PALE["saturation"]), _outcome(instead, PALE["confidence"], "pale"))
        .when(gives_way & (near_sure < PALE["sure"]), _outcome(instead, near_sure, "unsure"))
        .otherwise(_outcome(near["name"], near_sure, "nearest"))
    )
    steps = steps.withColumns({"__one": single, "colors_in_stone_conf": F.when(is_exotic, F.least(F.col("second_share") * 2, F.lit(EXOTIC["most"]))).otherwise(0.0)})
    one, few = F.col("__one"), F.col("ground_pixels") < COLOUR["few"]
    shade = F.greatest(1 - F.col("glare_ratio") * SHADE["glare"], F.lit(SHADE["glare_least"])) * F.greatest("exposure_score", F.lit(SHADE["exposure_least"]))
    sure = F.least(F.when(white, F.greatest(one["confidence"], F.lit(WHITE["least"]))).otherwise(one["confidence"] * shade), F.lit(SHADE["most"]))
    parts = F.array_compact(F.array(*(F.when(F.col(f"part{j}_share") >= EXOTIC["named"], F.col(f"__part{j}")["name"]) for j in (1, 2, 3))))
    mean, tone_sure = F.col("light_mean"), 1 - F.least(F.col("light_var") / TONE["variance"], F.lit(TONE["loss"]))
    out = {
        "base_color": F.when(few, "grey").when(is_exotic, "exotic").otherwise(one["name"]),
        "base_color_conf": F.when(few, 0.30).when(is_exotic, F.col("colors_in_stone_conf")).otherwise(sure),
        "base_color_rule": F.when(few, "few_pixels").when(is_exotic, "exotic").otherwise(one["rule"]),
        "colors_in_stone": F.when(is_exotic, F.array_distinct(parts)).otherwise(F.array().cast("array<string>")),
        "tonality": F.when(few, "medium").when(mean < TONE["dark"], "dark").when(mean > TONE["light"], "light").otherwise("medium"),
        "tonality_conf": F.when(few, 0.30).otherwise(tone_sure),
    }
    return steps.withColumns(out).drop("__near", "__part1", "__part2", "__part3", "__faint", "__white", "__many", "__one")


def vein_colours(measures: DataFrame, entity: str, *, least: int = 200) -> DataFrame:
    """(entity, vein_colour): the images' vein pixels added up; images with few of them do not count."""
    seen = F.col("vein_pixels") >= least

    def total(c: str) -> Column:
        return F.sum(F.when(seen, F.col(c)).otherwise(0.0))

    hues = [f"hue_{n}" for n in HUES]
    per = measures.groupBy(entity).agg(F.sum("pixels").alias("pixels"), *[total(c).alias(c) for c in ("vein_pixels", "neutral_pixels", *hues)], F.sum(F.when(seen, F.col("neutral_l") * F.col("neutral_pixels"))).alias("l"))
    mean = F.col("l") / F.nullif(F.col("neutral_pixels"), F.lit(0.0))
    return per.select(entity, vein_colour(F.col("vein_pixels"), F.col("pixels"), {n: F.col(f"hue_{n}") for n in HUES}, F.col("neutral_pixels"), mean).alias("vein_colour"))
