"""Box geometry as Column expressions. A box is ``struct<x1,y1,x2,y2>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALIGNMENT = 16


def _c(value: Column | str | float | int) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def clamp(value, low, high) -> Column:
    return F.least(F.greatest(_c(value), _c(low)), _c(high))


def bound(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times: keeps generated code small."""
    return F.transform(F.array(value), body)[0]


def decimal_round(value, digits: int) -> Column:
    """Half-even rounding of the exact binary value to ``digits`` decimals.

    ``bround`` works on the shortest decimal text of a double and so sees ties that are not there. The product with
    the power of ten is taken with its rounding error (split halves); the error decides what looks like a tie.
    """
    scale = float(10**digits)
    halves = lambda v: (134217729.0 * v - (134217729.0 * v - v), v - (134217729.0 * v - (134217729.0 * v - v)))
    scale_high, scale_low = halves(scale)

    def settle(product: Column, x: Column) -> Column:
        high, low = halves(x)
        error = ((high * scale_high - product) + high * scale_low + low * scale_high) + low * scale_low
        return F.when(error > 0, F.ceil(product)).when(error < 0, F.floor(product)).otherwise(F.rint(product))

    def body(x: Column) -> Column:
        product = x * F.lit(scale)
        tie = F.abs(product - F.floor(product) - F.lit(0.5)) == 0
        return F.when(tie, settle(product, x).cast("double")).otherwise(F.rint(product))

    return bound(_c(value).cast("double"), body) / F.lit(scale) + F.lit(0.0)


def make_box(x1, y1, x2, y2, kind: str = "double") -> Column:
    parts = zip(("x1", "y1", "x2", "y2"), (x1, y1, x2, y2))
    return F.struct(*(_c(v).cast(kind).alias(n) for n, v in parts))


def box_width(box: Column) -> Column:
    return F.greatest(box["x2"] - box["x1"], F.lit(0.0))


def box_height(box: Column) -> Column:
    return F.greatest(box["y2"] - box["y1"], F.lit(0.0))


def box_area(box: Column) -> Column:
    return box_width(box) * box_height(box)


def ordered_box(x1, y1, x2, y2) -> Column:
    return make_box(F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2))


def clip_box(box: Column, width, height, ordered: bool = False) -> Column:
    """Clamp into the image and order the corners. ``ordered``: the corners are in order, which clamping keeps."""
    w, h = _c(width).cast("double"), _c(height).cast("double")
    zero = F.lit(0.0)
    corners = (clamp(box["x1"], zero, w), clamp(box["y1"], zero, h), clamp(box["x2"], zero, w), clamp(box["y2"], zero, h))
    return make_box(*corners) if ordered else ordered_box(*corners)


def transform_box(box: Column, sx, sy, dx=0.0, dy=0.0) -> Column:
    sx, sy, dx, dy = map(_c, (sx, sy, dx, dy))
    return ordered_box(box["x1"] * sx + dx, box["y1"] * sy + dy, box["x2"] * sx + dx, box["y2"] * sy + dy)


def yolo_to_box(cx, cy, w, h, width, height) -> Column:
    """Normalised centre/size to clipped, ordered pixel corners.

    Clamping keeps order, so the absolute half size orders the corners at once; small expressions matter here, because
    filters on boxes are copied below the projection.
    """
    cx, cy, w, h, width, height = map(_c, (cx, cy, w, h, width, height))
    px, py, half = cx * width, cy * height, F.lit(0.5)
    hx, hy = F.abs(w * width * half), F.abs(h * height * half)
    right, bottom, zero = width.cast("double"), height.cast("double"), F.lit(0.0)
    return make_box(
        clamp(px - hx, zero, right), clamp(py - hy, zero, bottom), clamp(px + hx, zero, right), clamp(py + hy, zero, bottom)
    )


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union; an empty union scores 0."""
    zero = F.lit(0.0)
    iw = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), zero)
    ih = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), zero)
    union = box_area(a) + box_area(b) - iw * ih
    return F.when(union > 0, iw * ih / union).otherwise(zero)


def letterbox_shape(width, height, size: int, stride: int = 32) -> Column:
    w, h = _c(width), _c(height)
    scale = F.lit(float(size)) / F.greatest(w, h)
    rw = F.greatest(F.lit(1.0), F.rint(w * scale)).cast("long")
    rh = F.greatest(F.lit(1.0), F.rint(h * scale)).cast("long")
    pad = lambda v: (F.ceil(v / F.lit(stride)) * stride).cast("long")
    return F.struct(
        rw.alias("resized_width"), rh.alias("resized_height"),
        pad(rw).alias("padded_width"), pad(rh).alias("padded_height"),
        (rw / w).alias("scale_x"), (rh / h).alias("scale_y"),
    )


def roi_letterbox(width, height, target_width: int, target_height: int) -> Column:
    """Fit inside the target and centre; left and top padding take the floor half."""
    w, h, tw, th = _c(width), _c(height), F.lit(target_width), F.lit(target_height)
    scale = F.least(tw / w, th / h)
    rw = clamp(F.rint(w * scale), F.lit(1.0), tw.cast("double")).cast("long")
    rh = clamp(F.rint(h * scale), F.lit(1.0), th.cast("double")).cast("long")
    left, top = F.floor((tw - rw) / 2), F.floor((th - rh) / 2)
    return F.struct(
        rw.alias("resized_width"), rh.alias("resized_height"),
        left.alias("pad_left"), (tw - rw - left).alias("pad_right"),
        top.alias("pad_top"), (th - rh - top).alias("pad_bottom"),
    )


def align_dimension(value) -> Column:
    """Half-up to a multiple of 16, at least 16; a non-positive size is an error."""
    value = _c(value)
    aligned = F.greatest(F.floor(value / ALIGNMENT + 0.5) * ALIGNMENT, F.lit(ALIGNMENT)).cast("long")
    return F.when(value > 0, aligned).otherwise(F.raise_error(F.lit("an image side must stay above zero after scaling")))


def aligned_resize_size(width, height, scale) -> Column:
    w, h, s = _c(width), _c(height), _c(scale)
    bad = F.raise_error(F.lit("resize scale outside (0, 1]"))
    ok = (s > 0) & (s <= 1)
    return F.struct(
        F.when(ok, align_dimension(w * s)).otherwise(bad).alias("width"),
        F.when(ok, align_dimension(h * s)).otherwise(bad).alias("height"),
    )


def protection_geometry(boxes: Column, width, height, scale, min_short_edge: float) -> Column:
    """Standard size, and the smallest larger scale at which every box keeps ``min_short_edge``.

    Every bound is monotone in the box sides, so the narrowest and the lowest box decide alone.
    """
    w, h, s, need = _c(width), _c(height), _c(scale), F.lit(float(min_short_edge))
    mapped = lambda e, size: F.least(e["w"] * size["width"] / w, e["h"] * size["height"] / h)
    fit = lambda side, src: (F.ceil(need * src / side / ALIGNMENT) * ALIGNMENT - ALIGNMENT / 2) / src + F.lit(1e-12)

    def report(e: Column, standard: Column, short: Column) -> Column:
        enough = short.isNull() | (short >= need)
        raised = F.least(F.lit(1.0), F.greatest(s, fit(e["w"], w), fit(e["h"], h)))
        sized = lambda used: F.struct(used.alias("scale"), aligned_resize_size(w, h, used).alias("size"))
        return bound(
            bound(F.when(enough, s).otherwise(raised), sized),
            lambda p: F.struct(
                p["scale"].alias("scale"), standard.alias("standard"), p["size"].alias("protected"), short.alias("short_edge"),
                F.when(enough, F.lit(True)).otherwise(mapped(e, p["size"]) + F.lit(1e-6) >= need).alias("satisfied"),
            ),
        )

    edges = F.struct(
        F.array_min(F.transform(boxes, box_width)).alias("w"), F.array_min(F.transform(boxes, box_height)).alias("h"),
        aligned_resize_size(w, h, s).alias("standard"),
    )
    return bound(edges, lambda e: bound(mapped(e, e["standard"]), lambda short: report(e, e["standard"], short)))


def quad_points(points: Column, width, height) -> Column:
    """Clamp ``array<array<double>>`` polygon points to the last pixel; exactly four are required."""
    mx = F.greatest(_c(width) - 1, F.lit(0)).cast("double")
    my = F.greatest(_c(height) - 1, F.lit(0)).cast("double")
    fixed = F.transform(points, lambda p: F.array(clamp(p[0], F.lit(0.0), mx), clamp(p[1], F.lit(0.0), my)))
    return F.when(F.size(points) == 4, fixed).otherwise(
        F.raise_error(F.lit("a polygon needs four points"))
    )


def quad_to_bbox(points: Column, dx=0, dy=0) -> Column:
    xs, ys = F.transform(points, lambda p: p[0] + _c(dx)), F.transform(points, lambda p: p[1] + _c(dy))
    return make_box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def bbox_center(box: Column) -> Column:
    return F.struct(((box["x1"] + box["x2"]) / 2).alias("x"), ((box["y1"] + box["y2"]) / 2).alias("y"))


def bbox_to_yolo(box: Column, width, height, digits: int = 6) -> Column:
    w, h, c = _c(width), _c(height), bbox_center(box)
    return F.struct(
        decimal_round(c["x"] / w, digits).alias("cx"), decimal_round(c["y"] / h, digits).alias("cy"),
        decimal_round((box["x2"] - box["x1"]) / w, digits).alias("w"),
        decimal_round((box["y2"] - box["y1"]) / h, digits).alias("h"),
    )


def yolo_line(cx, cy, w, h, label="0") -> Column:
    """``class cx cy w h`` with six decimals, half-even."""
    six = [F.format_string("%.6f", decimal_round(_c(v), 6)) for v in (cx, cy, w, h)]
    return F.concat_ws(" ", _c(label) if isinstance(label, Column) else F.lit(label), *six)


def rect_to_yolo(x, y, width, height, image_width, image_height, label="0") -> Column:
    x, y, w, h, iw, ih = (_c(v) for v in (x, y, width, height, image_width, image_height))
    return yolo_line((x + w / 2) / iw, (y + h / 2) / ih, w / iw, h / ih, label)


def yolo_to_rect(cx, cy, w, h, width, height) -> Column:
    """Integer pixel rectangle, each part rounded on its own."""
    cx, cy, w, h, width, height = map(_c, (cx, cy, w, h, width, height))
    bw, bh = w * width, h * height
    i = lambda v: F.rint(v).cast("long")
    return F.struct(
        i(cx * width - bw / 2).alias("x"), i(cy * height - bh / 2).alias("y"), i(bw).alias("width"), i(bh).alias("height")
    )


def box_features(cx, cy, w, h, width, height) -> Column:
    cx, cy, w, h, width, height = map(_c, (cx, cy, w, h, width, height))
    bw, bh = w * width, h * height
    x, y = cx * width - bw / 2, cy * height - bh / 2
    return F.struct(
        decimal_round(x, 2).alias("x"), decimal_round(y, 2).alias("y"), decimal_round(bw, 2).alias("width"),
        decimal_round(bh, 2).alias("height"), decimal_round(y + bh / 2, 2).alias("center_y"),
        decimal_round(bw * bh, 2).alias("area"),
        F.when(bh != 0, decimal_round(bw / bh, 4)).otherwise(F.lit(0.0)).alias("aspect"),
    )


def label_to_pixel_box(cx, cy, w, h, width, height) -> Column:
    """Rounded, clamped, never inverted integer corners of the two-decimal rectangle."""
    width, height = _c(width).cast("double"), _c(height).cast("double")
    zero = F.lit(0.0)

    def corners(f: Column) -> Column:
        x1, y1 = clamp(F.rint(f["x"]), zero, width), clamp(F.rint(f["y"]), zero, height)
        x2 = F.greatest(x1, F.least(width, F.rint(f["x"] + f["width"])))
        y2 = F.greatest(y1, F.least(height, F.rint(f["y"] + f["height"])))
        return make_box(x1, y1, x2, y2, "long")

    return bound(box_features(cx, cy, w, h, width, height), corners)


def crop_window(width, height, roi_width, roi_height, anchor_x, anchor_y) -> Column:
    """Fixed window around the anchor, moved inside the image; null when degenerate."""
    w, h, rw, rh, ax, ay = map(_c, (width, height, roi_width, roi_height, anchor_x, anchor_y))
    half = lambda v: F.floor(v / 2)
    x1 = F.greatest(F.lit(0), F.least(w - rw, ax - half(rw)))
    y1 = F.greatest(F.lit(0), F.least(h - rh, ay - half(rh)))
    x2, y2 = F.least(w, x1 + rw), F.least(h, y1 + rh)
    return F.when((x2 > x1) & (y2 > y1), make_box(x1, y1, x2, y2, "long"))


def reproject_label(box: Column, crop: Column, roi_width, roi_height) -> Column:
    """Clip a pixel box into the crop and normalise; null when nothing is left."""
    rw, rh = _c(roi_width), _c(roi_height)

    def normalise(b: Column) -> Column:
        x1, x2 = (clamp(b[k] - crop["x1"], F.lit(0), rw) for k in ("x1", "x2"))
        y1, y2 = (clamp(b[k] - crop["y1"], F.lit(0), rh) for k in ("y1", "y2"))
        out = F.struct(
            ((x1 + x2) / 2 / rw).alias("cx"), ((y1 + y2) / 2 / rh).alias("cy"),
            ((x2 - x1) / rw).alias("w"), ((y2 - y1) / rh).alias("h"),
        )
        return F.when((x2 > x1) & (y2 > y1), out)

    return bound(box, normalise)


def crop_boxes(boxes: Column, crop: Column) -> Column:
    """Keep the parts of the boxes inside the crop, in crop coordinates."""
    cut = F.transform(
        boxes,
        lambda b: F.struct(
            F.greatest(b["x1"], crop["x1"]).alias("x1"), F.greatest(b["y1"], crop["y1"]).alias("y1"),
            F.least(b["x2"], crop["x2"]).alias("x2"), F.least(b["y2"], crop["y2"]).alias("y2"),
        ),
    )
    alive = F.filter(cut, lambda b: (b["x2"] > b["x1"]) & (b["y2"] > b["y1"]))
    return F.transform(
        alive,
        lambda b: make_box(b["x1"] - crop["x1"], b["y1"] - crop["y1"], b["x2"] - crop["x1"], b["y2"] - crop["y1"]),
    )


def scale_boxes(boxes: Column, sx, sy, width, height) -> Column:
    return F.transform(boxes, lambda b: clip_box(transform_box(b, sx, sy), width, height, ordered=True))


def clamp_edit_rect(x, y, width, height, image_width, image_height) -> Column:
    """Edited rectangle forced inside the image with sides of at least one pixel."""
    x, y, w, h, iw, ih = (_c(v).cast("double") for v in (x, y, width, height, image_width, image_height))
    cx, cy = clamp(x, F.lit(0.0), iw - 1), clamp(y, F.lit(0.0), ih - 1)
    cw = F.greatest(F.lit(1.0), F.least(w, iw - cx))
    ch = F.greatest(F.lit(1.0), F.least(h, ih - cy))
    return F.struct(cx.alias("x"), cy.alias("y"), cw.alias("width"), ch.alias("height"))


def sample_stem(video, frame) -> Column:
    return F.format_string("%s_f%08d", _c(video), _c(frame))


def parse_video_frame(sample_id) -> Column:
    sid = _c(sample_id)
    pattern = r"^(.+)_f(\d+)$"
    hit = sid.rlike(pattern)
    return F.struct(
        F.when(hit, F.regexp_extract(sid, pattern, 1)).alias("video_id"),
        F.when(hit, F.regexp_extract(sid, pattern, 2).try_cast("long")).alias("frame_index"),
    )


def intersects_region(box: Column, region: tuple[int, int, int, int] | None) -> Column:
    """Inclusive intersection; no region keeps everything."""
    if region is None:
        return F.lit(True)
    x1, y1, x2, y2 = region
    return (box["x1"] <= x2) & (box["x2"] >= x1) & (box["y1"] <= y2) & (box["y2"] >= y1)


def sigmoid(logit) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(logit)))


def importance_weight(target: Column, sampled_prior: Column, target_prior: Column) -> Column:
    """Class weight that undoes a sampler's prior shift; null when there is nothing to undo."""
    usable = (
        (sampled_prior > 0) & (sampled_prior < 1) & (target_prior > 0) & (target_prior < 1)
        & (F.abs(sampled_prior - target_prior) >= 1e-9)
    )
    weight = F.when(target, target_prior / sampled_prior).otherwise((1 - target_prior) / (1 - sampled_prior))
    return F.when(usable, weight)
