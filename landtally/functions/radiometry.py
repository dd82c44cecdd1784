"""Quality bits, unit scaling and class rules for satellite values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Product name -> (scale, offset).
SCALES = {
    "surface_reflectance": (2.75e-5, -0.2),
    "surface_temperature": (0.00341802, 149.0),
    "lai": (0.1, 0.0),
    "gpp": (0.01, 0.0),
    "albedo": (0.001, 0.0),
    "et": (0.01, 0.0),
}
# Scene-classification codes rejected as cloud, shadow, saturation or no data.
SCENE_CODES_REJECTED = (0, 1, 3, 8, 9, 10)
# Land-cover class order of the nine class probabilities.
COVER_CLASSES = ("water", "trees", "grass", "flooded_vegetation", "crops",
                 "shrub_and_scrub", "built", "bare", "snow_and_ice")
# IGBP land-cover code -> accepted cover class numbers.
IGBP_CLASSES = {
    "ENF": (1,), "EBF": (1,), "DNF": (1,), "DBF": (1,), "MF": (1,), "CSH": (5,), "OSH": (5,),
    "WSA": (1, 2, 5), "SAV": (1, 2, 5), "GRA": (2,), "WET": (3,), "CRO": (4,), "WAT": (0,),
    "SNO": (8,), "BSV": (7,), "URB": (6,),
}


def power_of_db(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 10)


def db_of_power(power: Column) -> Column:
    return F.when(power > 0, F.log10(power) * 10)


def apply_scale(dn: Column, product: str) -> Column:
    scale, offset = SCALES[product]
    return dn * F.lit(scale) + F.lit(offset)


def scale_toa(dn: Column, add_offset: Column, quantification: Column) -> Column:
    return F.greatest(F.lit(0.0), (dn + add_offset) * F.lit(1e4) / quantification)


def landsat_clear(qa: Column, saturation: Column) -> Column:
    return (qa.bitwiseAND(31) == 0) & (saturation == 0)


def scene_class_clear(code: Column) -> Column:
    return ~code.isin(*SCENE_CODES_REJECTED)


def bits(value: Column, shift: int, width: int) -> Column:
    return F.shiftright(value, shift).bitwiseAND((1 << width) - 1)


def normalize_pretrained(value: Column, mean: Column, std: Column, valid: Column) -> Column:
    return F.when(valid, (value - mean) / (std * 4) + F.lit(0.5)).otherwise(F.lit(0.0))


def normalize_toa(value: Column, offset: Column, divisor: Column, valid: Column) -> Column:
    return F.when(valid, (value - offset) / divisor + F.lit(0.5)).otherwise(F.lit(0.0))


def representativeness(terrain_std: Column) -> Column:
    return F.coalesce(F.lit(1.0) / (F.lit(1.0) + F.pow(terrain_std / 100, F.lit(2))), F.lit(1.0))


def argmax_class(probabilities: Column) -> Column:
    """Zero-based winner; the first of equal maxima."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def cover_state(p: Column, water_min: float = 0.35, ice_min: float = 0.60, land_min: float = 0.85,
                other_max: float = 0.10) -> dict[str, Column]:
    """Water needs to win, ice its threshold; land needs a high summed probability and little of the other two."""
    winner = argmax_class(p)
    water_p, ice_p = F.element_at(p, 1), F.element_at(p, 9)
    land_p = F.aggregate(F.slice(p, 2, 7), F.lit(0.0), lambda a, x: a + x)
    water = (winner == 0) & (water_p >= water_min)
    ice = ice_p >= ice_min
    land = (land_p >= land_min) & (water_p < other_max) & (ice_p < other_max)
    return dict(water=water, snow_ice=ice, land=land, known=water | ice | land)


def igbp_classes(codes: Column) -> Column:
    """Union of accepted classes over a ``;``-separated code list."""
    table = F.create_map(*[x for k, v in IGBP_CLASSES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    found = F.transform(F.split(codes, ";"), lambda c: F.coalesce(table[c], F.array().cast("array<int>")))
    return F.array_sort(F.array_distinct(F.flatten(found)))
