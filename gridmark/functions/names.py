"""File and directory names: roles, stems, affixes, parents."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: extensions, directory hints and mask affixes that decide roles and pairing ----
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".pgm")
MASK_DIR_HINTS = ("mask", "masks", "label", "labels", "annotation", "annotations", "gt", "ground_truth", "groundtruth",
                  "seg", "segmentation", "target", "targets", "class", "classes")
IMAGE_DIR_HINTS = ("image", "images", "img", "imgs", "raw", "micrograph", "micrographs", "input", "inputs", "original",
                   "originals", "data", "photo", "photos")
AFFIXES = ("_ground_truth", "_groundtruth", "_segmentation", "_annotation", "_labels", "_label", "_masks", "_mask",
           "_seg", "_gt", "_anno", "_target", "_class", "-ground_truth", "-mask", "-label", "-gt", "-seg", ".mask",
           ".label")
# ---- end of fixed values ----


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def stem(path: Column) -> Column:
    """Name without its last extension; a leading dot is no extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^.]+)$", 1))


def is_image(path: Column) -> Column:
    return extension(path).isin(*IMAGE_EXTENSIONS)


def _any(low: Column, hints: Sequence[str]) -> Column:
    """Does the text hold any of the hints?  One alternation, so the text is evaluated once."""
    return F.rlike(low, F.lit("|".join(re.escape(h) for h in hints)))


def dir_role(name: Column) -> Column:
    """'mask', 'image' or null: whole-token matches first, then substrings, mask before image."""
    low = F.trim(F.lower(name), F.lit("_- "))
    tokens = F.concat(F.array(low), F.split(low, "_"), F.split(low, "-"))

    def token(hints: Sequence[str]) -> Column:
        return F.arrays_overlap(tokens, F.array(*[F.lit(h) for h in hints]))

    return (F.when(token(MASK_DIR_HINTS), "mask").when(token(IMAGE_DIR_HINTS), "image")
            .when(_any(low, MASK_DIR_HINTS), "mask").when(_any(low, IMAGE_DIR_HINTS), "image"))


def has_affix(stem_col: Column) -> Column:
    """A stem that contains any known mask affix."""
    return _any(F.lower(stem_col), AFFIXES)


def strip_affix(stem_col: Column, affix: Column) -> Column:
    """Remove the affix from the end, else from the start, else leave the stem alone."""
    n = F.length(affix)
    return (F.when(affix == "", stem_col)
            .when(F.endswith(stem_col, affix), F.substring(stem_col, F.lit(1), F.length(stem_col) - n))
            .when(F.startswith(stem_col, affix), F.substring(stem_col, n + 1, F.length(stem_col)))
            .otherwise(stem_col))


def parent_id(dataset: Column, stem_col: Column, rules: Mapping[str, str]) -> Column:
    """Scene a file belongs to: the dataset's pattern removed from the stem, or the stem itself."""
    out = stem_col
    for name, pattern in rules.items():
        out = F.when(dataset == name, F.regexp_replace(stem_col, pattern, "")).otherwise(out)
    return out


def tile_id(dataset: Column, stem_col: Column, x: Column, y: Column) -> Column:
    return F.format_string("%s/%s/x%d_y%d", dataset, stem_col, x, y)
