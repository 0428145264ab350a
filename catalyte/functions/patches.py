"""The colour agent: patches of an item's images, two weighted clusters of them, and what the second one says.

Pixels stay in the task that holds the image: of each image at most 36 patch rows come out.
An item's patches, of its first images only and so bounded, meet in one grouped Arrow call for
the clustering; shares, spread and tests of the clusters are columns.
"""

from __future__ import annotations

from itertools import combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .imaging import lab_of

# --- fixed values: crops, grid, thresholds ---------------------------------------------
CROP = {"left": 0.10, "right": 0.10, "top": 0.10, "bottom": 0.20}
LARGEST, IMAGES, GRID, PATCH, LEAST_PATCH, INNER = 800, 3, 6, 64, 16, 0.10
GLARE = {"lightness": 92.0, "saturation": 0.08}
REFLECTION = {"above": 12.0, "saturation": 0.12, "texture_pct": 75}
VALID, GLARE_COST, LEAST_WEIGHT, LEAST_VALID = 0.3, 1.5, 0.1, 0.3
LEAST_PATCHES = 4
SECOND = {"share": 0.25, "cells": 6, "cell_share": 0.25}


def cropped(rgb: np.ndarray) -> np.ndarray:
    """Without the background at the sides and the label strip below, and no side longer than ``LARGEST``."""
    h, w = rgb.shape[:2]
    rgb = rgb[int(h * CROP["top"]) : h - int(h * CROP["bottom"]), int(w * CROP["left"]) : w - int(w * CROP["right"])]
    h, w = rgb.shape[:2]
    if max(h, w) <= LARGEST:
        return rgb
    scale = LARGEST / max(h, w)
    rows, columns = (np.minimum(((np.arange(round(n * scale)) + 0.5) / scale).astype(int), n - 1) for n in (h, w))
    return rgb[rows][:, columns]


def unfit(lab: np.ndarray, rgb: np.ndarray) -> np.ndarray:
    """Where glare or a reflection hides the colour."""
    value, least = rgb.max(-1).astype(float), rgb.min(-1).astype(float)
    saturation = np.where(value > 0, (value - least) / np.maximum(value, 1), 0.0)
    gray = np.pad(np.round(rgb @ np.array([0.299, 0.587, 0.114])), 1, mode="reflect" if min(rgb.shape[:2]) > 1 else "edge")
    texture = np.abs(gray[:-2, 1:-1] + gray[2:, 1:-1] + gray[1:-1, :-2] + gray[1:-1, 2:] - 4 * gray[1:-1, 1:-1])
    light = lab[..., 0]
    glare = (light > GLARE["lightness"]) & (saturation < GLARE["saturation"])
    shine = (light > np.median(light) + REFLECTION["above"]) & (saturation < REFLECTION["saturation"]) & (texture > np.percentile(texture, REFLECTION["texture_pct"]))
    return glare | shine


def sample(rgb: np.ndarray, name: str) -> list[tuple[int, float, float, float, float, float]]:
    """(cell, l, a, b, weight, glare) of a patch in each cell of the inner grid that shows enough.

    Where in its cell a patch lies follows from the image's name, so a repeated task gives the same rows.
    """
    rgb = cropped(rgb)
    h, w = rgb.shape[:2]
    left, top = int(w * INNER), int(h * INNER)
    wide, high = w - 2 * left, h - 2 * top
    if min(wide, high) < GRID * 10:
        return []
    lab = lab_of(rgb)
    hidden = unfit(lab, rgb)
    cw, ch = wide // GRID, high // GRID
    half = max(min(PATCH, cw // 2, ch // 2), LEAST_PATCH) // 2
    out = []
    for cell in range(GRID * GRID):
        y, x = top + cell // GRID * ch + half, left + cell % GRID * cw + half
        room_y, room_x = ch - 2 * half, cw - 2 * half
        if room_y <= 0 or room_x <= 0:
            continue
        place = crc32(f"{name}|{cell}".encode())
        y, x = y + (place >> 16) % room_y, x + (place & 0xFFFF) % room_x
        part = (slice(max(0, y - half), y + half), slice(max(0, x - half), x + half))
        seen = ~hidden[part]
        share = seen.mean()
        if share >= VALID:
            glare = 1 - share
            weight = max(LEAST_WEIGHT, 1 - GLARE_COST * glare) * max(LEAST_VALID, share)
            out.append((cell, *lab[part][seen].mean(0).tolist(), float(weight), float(glare)))
    return out


def image_patches(images: DataFrame, entity: str, *, image: str = "image", seq: str = "seq", pixels: str = "pixels", height: str = "height", width: str = "width") -> DataFrame:
    """(entity, image, seq, cell, l, a, b, weight, glare) of all images; an image without any patch, or broken, is one row of nulls."""
    kinds = [f"`{c}` {images.schema[c].dataType.simpleString()}" for c in (entity, image, seq)]
    schema = ", ".join([*kinds, "cell int, l double, a double, b double, weight double, glare double"])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):  # an image at a time: its pixels are the task's memory
                row = batch.slice(k, 1)
                name, raw, h, w = (row.column(c)[0].as_py() for c in (image, pixels, height, width))
                try:
                    found = sample(np.frombuffer(raw, np.uint8).reshape(h, w, 3), str(name))
                except (TypeError, ValueError):
                    found = []
                found = found or [(None,) * 6]
                same = pa.array([0] * len(found), pa.int32())
                made = [pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), *[pa.float64()] * 5))]
                yield pa.RecordBatch.from_arrays([*(row.column(c).take(same) for c in (entity, image, seq)), *made], names=[entity, image, seq, "cell", "l", "a", "b", "weight", "glare"])

    return images.select(entity, image, seq, pixels, height, width).mapInArrow(run, schema)


def two_means(points: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """(label of each point, both centres, cost) of the best of many starts of weighted 2-means.

    Starts are pairs of points, all of them if there are few, else those of a fixed draw and the
    two farthest; label 0 is that of the first point.
    """
    n = len(points)
    pairs = list(combinations(range(n), 2))
    if len(pairs) > 60:
        far = ((points[:, None] - points[None]) ** 2).sum(-1)
        pairs = [tuple(int(x) for x in divmod(int(far.argmax()), n)), *(tuple(rng_pair) for rng_pair in np.random.default_rng(42).integers(0, n, (30, 2)).tolist())]
    best = (np.zeros(n, int), np.stack([points.mean(0)] * 2) if n else np.zeros((2, 3)), np.inf)
    for pair in pairs:
        centre, own = points[list(pair)].astype(float), None
        for _ in range(rounds):
            away = ((points[:, None] - centre[None]) ** 2).sum(-1)
            fresh = away.argmin(1)
            if own is not None and (fresh == own).all():
                break
            own = fresh
            for k in range(2):
                if (own == k).any():
                    centre[k] = np.average(points[own == k], axis=0, weights=counts[own == k])
        cost = float((((points - centre[own]) ** 2).sum(1) * counts).sum())
        if cost < best[2] - 1e-9:
            best = (own, centre.copy(), cost)
    own, centre, cost = best
    return (1 - own, centre[::-1], cost) if n and own[0] else (own, centre, cost)


def clustered(patches: DataFrame, entity: str, *, image: str = "image", seq: str = "seq", images: int = IMAGES) -> DataFrame:
    """The patches of each entity's first ``images`` images (by seq) with ``label`` and the centres ``l0`` to ``b1``.

    An entity with fewer than ``LEAST_PATCHES`` patches keeps them without label and centres,
    one without any has a row of nulls. At most 36 patches an image meet in a group.
    """
    rank = F.dense_rank().over(Window.partitionBy(entity).orderBy(seq, image))
    first = patches.withColumn("__rank", rank).filter(F.col("__rank") <= images).drop("__rank")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in first.schema), "label int", *(f"{c}{k} double" for k in (0, 1) for c in "lab")])

    def run(table: pa.Table) -> pa.Table:
        some = table.filter(pa.compute.is_valid(table.column("cell")))
        table = some if some.num_rows else table.slice(0, 1)
        label, centres = [None] * table.num_rows, [None] * 6
        if some.num_rows >= LEAST_PATCHES:
            # tasks may deliver rows in any order
            table = table.sort_by([(seq, "ascending"), (image, "ascending"), ("cell", "ascending")])
            points = np.stack([table.column(c).to_numpy() for c in "lab"], 1)
            own, centre, _ = two_means(points, np.maximum(1, (table.column("weight").to_numpy() * 10).astype(int)))
            label, centres = own.tolist(), centre.ravel().tolist()
        table = table.append_column("label", pa.array(label, pa.int32()))
        for name, x in zip(("l0", "a0", "b0", "l1", "a1", "b1"), centres):
            table = table.append_column(name, pa.array([x] * table.num_rows, pa.float64()))
        return table

    return first.groupBy(entity).applyInArrow(run, schema)


def colour_summary(labelled: DataFrame, entity: str) -> DataFrame:
    """One row an entity: main and second colour with their shares, the second's spread over cells and whether it counts, mean lightness, the lighter cluster.

    Without labels the shares are those of a single unknown colour. Distinct cells (any integers) are bits of words
    of 64 cells, a row for each word that an item has: the sums are made before the shuffle, which distinct counts would
    fill with a row for each cell.
    """

    def of(k: int, value: Column) -> Column:
        return F.when(F.col("label") == k, value)

    weight = F.col("weight")
    bit = F.expr("shiftleft(1L, CAST(cell & 63 AS INT))")
    words = labelled.groupBy(entity, F.expr("shiftright(CAST(cell AS BIGINT), 6)").alias("__word")).agg(
        F.count("cell").alias("n"), F.bit_or(bit).alias("seen"), F.sum(weight).alias("w"), F.sum(weight * F.col("l")).alias("wl"),
        *(F.sum(of(k, weight)).alias(f"w{k}") for k in (0, 1)), *(F.bit_or(of(k, bit)).alias(f"seen{k}") for k in (0, 1)),
        *(F.max(f"{c}{k}").alias(f"{c}{k}") for k in (0, 1) for c in "lab"),
    )

    def cells(bits: str) -> Column:
        return F.coalesce(F.sum(F.bit_count(bits)), F.lit(0))

    per = words.groupBy(entity).agg(
        F.sum("n").alias("patch_count"), cells("seen").alias("total_cells"), F.sum("w").alias("w"), F.sum("wl").alias("wl"),
        *(F.coalesce(F.sum(f"w{k}"), F.lit(0.0)).alias(f"w{k}") for k in (0, 1)), *(cells(f"seen{k}").alias(f"cells{k}") for k in (0, 1)),
        *(F.max(f"{c}{k}").alias(f"{c}{k}") for k in (0, 1) for c in "lab"),
    )
    known, all_w = F.col("l0").isNotNull(), F.nullif(F.col("w0") + F.col("w1"), F.lit(0.0))
    parts = [F.struct(F.coalesce(F.col(f"w{k}") / all_w, F.lit(0.5)).alias("share"), F.col(f"cells{k}").alias("cells"), *(F.col(f"{c}{k}").alias(c) for c in "lab")) for k in (0, 1)]
    first = F.col("w0") >= F.col("w1")
    per = per.withColumns({"m": F.when(first, parts[0]).otherwise(parts[1]), "s": F.when(first, parts[1]).otherwise(parts[0]), "g": F.when(F.col("l0") >= F.col("l1"), parts[0]).otherwise(parts[1])})
    enough = F.greatest(F.lit(SECOND["cells"]), F.floor(F.col("total_cells") * SECOND["cell_share"]))
    second = F.coalesce(known & (F.col("s.share") >= SECOND["share"]) & (F.col("s.cells") >= enough), F.lit(False))
    apart = F.sqrt(F.pow(F.col("m.a") - F.col("s.a"), 2) + F.pow(F.col("m.b") - F.col("s.b"), 2))

    def told(value: Column, places: int, unknown: float = 0.0) -> Column:
        return F.round(F.when(known, value).otherwise(F.lit(unknown)), places)

    return per.select(
        entity,
        *(told(F.col(f"m.{c}"), 2).alias(f"main_{c}") for c in "lab"),
        told(F.col("m.share"), 3, 1.0).alias("main_share"),
        *(told(F.col(f"s.{c}"), 2).alias(f"second_{c}") for c in "lab"),
        told(F.col("s.share"), 3).alias("second_share"),
        F.round(F.when(second, apart).otherwise(0.0), 2).alias("delta_ab"),
        F.when(known, F.col("s.cells")).otherwise(0).cast("long").alias("second_cell_spread"),
        F.when(known, F.col("total_cells")).otherwise(0).cast("long").alias("total_cells"),
        second.alias("has_second"),
        F.round(F.when(known, F.col("wl") / F.nullif(F.col("w"), F.lit(0.0))), 1).alias("lightness_mean"),
        "patch_count",
        told(F.col("g.l"), 2).alias("lighter_l"),
        told(F.col("g.share"), 3).alias("lighter_share"),
        told(F.sqrt(F.pow(F.col("g.a"), 2) + F.pow(F.col("g.b"), 2)), 2).alias("lighter_chroma"),
    )


def colours(images: DataFrame, entity: str, **names) -> DataFrame:
    """The colour summary of every entity, from the pixels of its first images."""
    order = {k: v for k, v in names.items() if k in ("image", "seq")}
    return colour_summary(clustered(image_patches(images, entity, **names), entity, **order), entity)
