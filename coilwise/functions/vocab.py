"""Class vocabularies and severity constants.

Fixed values: names, tiers, anchors and cut-offs have to equal those used by existing reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values -------------------------------------------------------------------------------
CLASSES = ("crazing", "inclusion", "patches", "pitted_surface", "rolled-in_scale", "scratches")
EXTRA_CLASSES = ("severstal_1", "severstal_2", "severstal_3", "severstal_4")
TIERS = {
    "crazing": "high", "inclusion": "critical", "patches": "medium",
    "pitted_surface": "high", "rolled-in_scale": "high", "scratches": "medium",
    "severstal_1": "medium", "severstal_2": "medium", "severstal_3": "medium", "severstal_4": "medium",
}
UNKNOWN_TIER = "medium"
TIER_SCORE = {"low": 22.0, "medium": 42.0, "high": 64.0, "critical": 84.0}
BANDS = ("low", "medium", "high", "critical")
BAND_CUTS = (30.0, 55.0, 80.0)
AREA_SATURATION = 0.25
AREA_GAIN = 0.55
RANK_DECAY = 0.6
NO_LABEL_NAME = "(no labelled defect)"
NO_DETECTION = "(no detection)"
DEFAULT_CAUSE = "No knowledge-base entry for this class."
DEFAULT_ACTION = "Refer to the quality department."
# --------------------------------------------------------------------------------------------

# Short operator guidance, worded for this package; a mill replaces it with its own table.
GUIDANCE = {
    "crazing": ("fine crack network from low hot ductility", "check soak time and tramp elements; hold for grinding"),
    "inclusion": ("non-metallic particle exposed by rolling", "trace the heat; crop or downgrade"),
    "patches": ("uneven descaling or cooling", "check descaler nozzles and burner balance"),
    "pitted_surface": ("oxide nodules spalled off the surface", "shorten furnace time; audit pickling"),
    "rolled-in_scale": ("scale pressed in by the work rolls", "restore descaler pressure; inspect rolls"),
    "scratches": ("contact with damaged plant", "inspect rollers and side guides"),
}


def class_rows(names=CLASSES) -> list[tuple]:
    return [
        (i, n, TIERS.get(n, UNKNOWN_TIER), *GUIDANCE.get(n, (DEFAULT_CAUSE, DEFAULT_ACTION)))
        for i, n in enumerate(names)
    ]


def dim_class(spark: SparkSession, names=CLASSES) -> DataFrame:
    """Class dimension: one row per class of the head, a handful of rows by construction."""
    return spark.createDataFrame(
        class_rows(names), "class_id int, class_name string, tier string, cause string, action string"
    )


def dim_class_sql(names=CLASSES) -> str:
    """The same dimension as a SQL relation body."""
    rows = ", ".join("(%d, '%s', '%s', '%s', '%s')" % r for r in class_rows(names))
    return f"SELECT * FROM (VALUES {rows}) AS t(class_id, class_name, tier, cause, action)"
