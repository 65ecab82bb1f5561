"""Labels that name the same thing, and boxes and votes beside them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A label and the words that stand for it.
SYNONYMS = {
    "cabinet": ("cupboard", "storage", "drawer"),
    "appliance": ("refrigerator", "oven", "stove", "dishwasher", "microwave"),
    "lighting": ("light", "lamp", "fixture", "chandelier"),
    "flooring": ("floor", "tile", "carpet", "hardwood", "vinyl"),
    "countertop": ("counter", "surface", "worktop"),
}
AGREEMENT = 0.67


def same_thing(a: Column, b: Column) -> Column:
    """One label contains the other, or both are words of one set, in any case; false if one is null."""
    a, b = F.lower(a), F.lower(b)
    found = a.contains(b) | b.contains(a)
    for label, words in SYNONYMS.items():
        found = found | (a.isin(label, *words) & b.isin(label, *words))
    return F.coalesce(found, F.lit(False))


def relative_box(x0: Column, y0: Column, x1: Column, y1: Column, width: int = 640, height: int = 480) -> Column:
    """A box in [0, 1]; one with a coordinate over 1 is taken to be in pixels of a width x height image."""
    pixels = F.greatest(x0, y0, x1, y1) > 1
    part = lambda v, size: F.when(pixels, v / size).otherwise(v)
    return F.struct(part(x0, width).alias("x_min"), part(y0, height).alias("y_min"), part(x1, width).alias("x_max"), part(y1, height).alias("y_max"))


def voted(label: Column, vote: Column, agreement: Column) -> Column:
    """(label, agreed): the vote's label where enough passes agree, else the label as it was."""
    agreed = F.coalesce(agreement >= AGREEMENT, F.lit(False))
    return F.struct(F.when(agreed, vote).otherwise(label).alias("label"), agreed.alias("agreed"))


def valid_date(text: Column) -> Column:
    """Whether a date can be read in one of four formats."""
    read = [F.try_to_timestamp(text, F.lit(f)) for f in ("M/d/yyyy", "M-d-yyyy", "yyyy-M-d", "d/M/yyyy")]
    return F.coalesce(*read).isNotNull()


#: Categories of labels and the words that a label of the category contains.
CATEGORIES = {
    "cabinet": ("cabinet", "cupboard", "storage", "drawer", "shelf"),
    "appliance": ("appliance", "refrigerator", "fridge", "oven", "stove", "range", "dishwasher", "microwave", "washer", "dryer"),
    "lighting": ("light", "lighting", "lamp", "fixture", "chandelier", "sconce", "recessed"),
    "flooring": ("floor", "flooring", "tile", "carpet", "hardwood", "vinyl", "laminate"),
    "countertop": ("counter", "countertop", "surface", "worktop", "granite", "quartz"),
    "sink": ("sink", "basin", "faucet"),
    "toilet": ("toilet", "commode"),
    "tub": ("tub", "bathtub", "shower"),
    "window": ("window", "glass", "pane"),
    "door": ("door", "entry", "entrance"),
    "hvac": ("hvac", "ac", "air conditioner", "vent", "duct", "furnace"),
    "electrical": ("electrical", "outlet", "switch", "panel", "breaker"),
    "plumbing": ("plumbing", "pipe", "valve", "water heater"),
}


def related(a: Column, b: Column) -> Column:
    """One label contains the other, or both contain a word of one category, in any case; false if one is null."""
    a, b = F.lower(a), F.lower(b)
    found = a.contains(b) | b.contains(a)
    for words in CATEGORIES.values():
        found = found | (a.rlike("|".join(words)) & b.rlike("|".join(words)))
    return F.coalesce(found, F.lit(False))
