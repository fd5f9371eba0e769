"""Scores of image quality, metadata and tampering from what was measured on an image.

The measures are columns: reading pixels is outside.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sharpness from which an image is sharp, acceptable or blurry, and what each class takes.
BLUR = ((200, "sharp", 0), (80, "acceptable", 10), (30, "blurry", 35), (None, "unusable", 60))
#: Quality from which a grade is given.
GRADES = ((80, "EXCELLENT"), (65, "GOOD"), (45, "ACCEPTABLE"), (25, "POOR"), (None, "UNUSABLE"))
#: Signatures of software, the first that occurs counts.
EDITORS = ("photoshop", "lightroom", "gimp", "paint", "snagit", "canva", "picsart", "pixlr", "facetune", "snapseed", "affinity", "inkscape", "paint.net", "corel")
SCREENSHOTS = ("screencapture", "screenshot", "snipping", "grab", "scrot", "import", "prnt scr")
#: Sides of screens, in the order in which they are looked for, and the proportion of a card.
SCREENS, CARD = (1920, 2160, 2400, 2560, 1080, 720), 85.6 / 54.0


def _ladder(x: Column, steps) -> Column:
    out = None
    for least, name, *_ in steps:
        out = F.when(x >= least, name) if out is None else out.when(x >= least, name) if least is not None else out.otherwise(name)
    return out


def quality_flags(sharpness: Column, brightness: Column, contrast: Column, noise: Column, edges: Column, entropy: Column, width: Column, height: Column, glare: Column) -> Column:
    """What lowers the quality, in a fixed order; ``glare`` is the share of blown pixels."""
    rules = (
        (sharpness < 30, "unusable"),
        ((sharpness >= 30) & (sharpness < 80), "blurry"),
        (brightness < 40, "dark"),
        (brightness > 220, "overexposed"),
        (contrast < 20, "low_contrast"),
        (noise > 0.12, "high_noise"),
        (edges < 0.03, "low_edge_density"),
        (entropy < 5.5, "low_entropy"),
        ((width < 300) | (height < 150), "very_low_resolution"),
        (((width < 600) | (height < 300)) & (width >= 300) & (height >= 150), "low_resolution"),
        (glare > 0.05, "glare_detected"),
    )
    return F.array_compact(F.array(*[F.when(c, f) for c, f in rules]))


#: What each flag takes from 100; an image that is merely acceptable loses 10.
QUALITY_POINTS = {"unusable": 60, "blurry": 35, "dark": 20, "overexposed": 15, "low_contrast": 10, "high_noise": 15, "low_edge_density": 10, "low_entropy": 10, "very_low_resolution": 20, "low_resolution": 10, "glare_detected": 8}


def blur_class(sharpness: Column) -> Column:
    return _ladder(sharpness, BLUR)


def quality_score(flags: Column, sharpness: Column) -> Column:
    lost = sum((F.when(F.array_contains(flags, f), p).otherwise(0) for f, p in QUALITY_POINTS.items()), F.lit(0))
    lost = lost + F.when((sharpness >= 80) & (sharpness < 200), 10).otherwise(0)
    return F.greatest(F.lit(0), F.lit(100) - lost)


def quality_grade(score: Column) -> Column:
    return _ladder(score, GRADES)


def metadata_flags(has_exif: Column, software: Column, camera: Column, taken: Column, as_of: Column, image_format: Column, jfif: Column, dpi: Column, width: Column, height: Column) -> Column:
    """Flags of an image's metadata: editing and screenshot software, camera, date, resampling, screen sizes and proportion."""
    low = F.lower(F.coalesce(software, F.lit("")))
    edited = F.coalesce(*[F.when(F.contains(low, F.lit(s)), f"edited_with_{s}") for s in EDITORS])
    shot = edited.isNull() & reduce(lambda a, b: a | b, [F.contains(low, F.lit(s)) for s in SCREENSHOTS])
    jpeg = image_format == "JPEG"
    sized = (width > 0) & (height > 0)
    screen = F.coalesce(*[F.when((height == s) | (width == s), f"screen_resolution_dimension_{s}p") for s in SCREENS])
    ratio = F.greatest(width, height) / F.greatest(F.least(width, height), F.lit(1))
    rules = (
        F.when(has_exif, edited),
        F.when(has_exif & shot, "screenshot_software_detected"),
        F.when(~has_exif, "no_exif_data").when(~camera, "missing_camera_metadata"),
        F.when(has_exif & (taken > as_of), "future_timestamp").when(has_exif & (F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(taken)) / 86400) > 365 * 5), "very_old_document_timestamp"),
        F.when(jpeg & jfif, "jfif_header_present"),
        F.when(jpeg & dpi.isin(72, 96), "low_dpi_resampled_possibly_whatsapp"),
        F.when(sized, screen),
        F.when(sized & (F.abs(ratio - CARD) > 0.4), "non_standard_card_aspect_ratio"),
    )
    return F.array_compact(F.array(*rules))


def looks_like_screenshot(flags: Column) -> Column:
    """At least two of: screenshot software, no metadata, no camera, a screen's size."""
    signs = [F.array_contains(flags, f) for f in ("screenshot_software_detected", "no_exif_data", "missing_camera_metadata")]
    signs.append(F.exists(flags, lambda x: F.contains(x, F.lit("screen_resolution"))))
    return sum((s.cast("int") for s in signs), F.lit(0)) >= 2


def metadata_score(flags: Column) -> Column:
    """50 for editing software, 40 for a screenshot's, 30 for a date to come, 20 for no metadata at all, 10 for resampling; 100 at most."""
    has = lambda f: F.array_contains(flags, f)
    points = (
        (F.exists(flags, lambda x: F.contains(x, F.lit("edited_with"))), 50),
        (has("screenshot_software_detected"), 40),
        (has("future_timestamp"), 30),
        (has("no_exif_data") & ~has("jfif_header_present"), 20),
        (has("low_dpi_resampled_possibly_whatsapp"), 10),
    )
    return F.least(F.lit(100), sum((F.when(c, p).otherwise(0) for c, p in points), F.lit(0)))


def screenshot_flags(width: Column, height: Column, top_spread: Column, bottom_spread: Column) -> Column:
    """Signs of a screenshot by proportion, height and even bands at the edges."""
    shape = width / F.greatest(height, F.lit(1))
    sides = ((16 / 9, "16_9"), (9 / 16, "9_16"), (4 / 3, "4_3"), (3 / 4, "3_4"))
    rules = [(F.abs(shape - x) < 0.02, f"screenshot_aspect_ratio_{name}") for x, name in sides]
    rules += [(height > width * 1.7, "possible_phone_screenshot"), ((top_spread < 5) | (bottom_spread < 5), "uniform_border_band")]
    return F.array_compact(F.array(*[F.when(c, f) for c, f in rules]))


def tamper_flags(ela_share: Column, ela_spread: Column, contrast_share: Column, flat_blocks: Column, flat_share: Column, edge_ratio: Column, screenshot_flags: Column) -> Column:
    """Signs of tampering: recompressed blocks, contrast islands, flat blocks, odd edges, and those of a screenshot."""
    rules = (
        ((ela_share > 0.10) & (ela_spread > 5), "ela_anomaly_detected"),
        (contrast_share > 0.08, "local_contrast_anomaly"),
        ((flat_share > 0.08) & (flat_blocks >= 3), "suspicious_uniform_regions"),
        ((edge_ratio > 3.5) | (edge_ratio < 0.4), "edge_inconsistency"),
    )
    return F.concat(F.array_compact(F.array(*[F.when(c, f) for c, f in rules])), screenshot_flags)


#: What each sign of tampering adds; any sign of a screenshot adds 15 once.
TAMPER_POINTS = {"ela_anomaly_detected": 30, "local_contrast_anomaly": 20, "suspicious_uniform_regions": 25, "edge_inconsistency": 15}


def tamper_score(flags: Column) -> Column:
    points = sum((F.when(F.array_contains(flags, f), p).otherwise(0) for f, p in TAMPER_POINTS.items()), F.lit(0))
    shots = F.size(F.array_except(flags, F.array(*[F.lit(f) for f in TAMPER_POINTS]))) > 0
    return F.least(F.lit(100), points + F.when(shots, 15).otherwise(0))


def tampered(score: Column, flags: Column) -> Column:
    return (score >= 25) | (F.size(flags) >= 2)
