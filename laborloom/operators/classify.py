"""Industry classification by location and by NAICS code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laborloom.functions.labels import in_us
from laborloom.operators.skew import spread_join

# The broad industry labels and the NAICS codes of each. Codes
# that fit several industries are pinned to one of them here.
NAICS_BY_INDUSTRY = {
    "Food, Drink, & Dining": """
        111998 312120 312130 312140 492210 722320 722330 722410 722511 722513 722515
    """,
    "Retail": """
        327110 423910 441110 442110 443142 444130 445110 445120 445310 446110 446130
        448120 448210 448310 451110 451120 451140 451211 452319 453110 453210 453310
        453910 453991 453998 455230 532282
    """,
    "Entertainment": """
        441228 512131 611620 711110 711130 711190 711310 711320 712110 712130 712190
        713110 713940 713950 713990 721120
    """,
    "Beauty & Wellness": "611610 621399 812112 812113 812199",
    "Home & Repair": """
        113310 213111 221310 236115 236118 238140 238160 238170 238190 238210 238220
        238310 238320 238330 238340 238350 238390 238910 238990 311212 332312 332313
        333415 333921 423830 488410 541310 541350 541370 561622 561710 561720 561730
        561740 561790 562119 562991 811211 811310 811412 811420
    """,
    "Medical / Veterinary": """
        325412 541940 621111 621112 621210 621310 621320 621330 621340 621391 621492
        621512 622110 622210
    """,
    "Professional Services": """
        211111 511130 512110 523930 524210 531130 531210 531311 541110 541199 541211
        541330 541410 541413 541430 541511 541611 541613 541618 541960 551114 561320
        561422 561510 561611 561612 561920 711510 925110
    """,
    "Hospitality": "483112 721110 721211 721214",
    "Caregiving": "624120 624410 812910",
    "Education": "611110 611691",
    "Public or Nonprofit Organization": """
        519120 541320 541720 562920 621910 624110 813110 813312 813410 813910 813940
        921110 921190 922110 922120 922140 922160 922190 928120
    """,
    "Personal Services": """
        323111 491110 524125 541921 763101 811111 811192 811490 812210 812320 812930
    """,
    "Transportation & Logistics": """
        484210 485112 485113 485310 485320 485999 488119 488510 492110 493110 532111
    """,
}
# Fixed value: label of every other code.
UNMAPPED_INDUSTRY = "Other / Unknown"

INDUSTRIES = tuple(sorted(NAICS_BY_INDUSTRY))


def naics_rules(spark: SparkSession) -> DataFrame:
    """(naics_code, broad_industry) rules as a small relation."""
    groups = [
        F.struct(F.lit(label).alias("broad_industry"), F.lit(" ".join(codes.split())).alias("codes"))
        for label, codes in NAICS_BY_INDUSTRY.items()
    ]
    rows = spark.range(1).select(F.inline(F.array(*groups)))
    return rows.select(F.explode(F.split("codes", " ")).alias("naics_code"), "broad_industry")


def by_naics(df: DataFrame, code: str = "naics_code", rules: DataFrame | None = None) -> DataFrame:
    """Label rows by NAICS code; for tables that carry no location id.

    The rules are a literal relation of a few kilobytes, so Catalyst's own size
    check turns this into a broadcast hash join.
    """
    rules = naics_rules(df.sparkSession) if rules is None else rules
    rules = rules.select(F.col("naics_code").alias("_code"), F.col("broad_industry").alias("_label"))
    return (
        df.join(rules, F.trim(F.col(code).cast("string")) == F.col("_code"), "left")
        .withColumn("broad_industry", F.coalesce("_label", F.lit(UNMAPPED_INDUSTRY)))
        .drop("_code", "_label")
    )


def by_location(df: DataFrame, locations: DataFrame, spread: str | None = None) -> DataFrame:
    """Canonical industry and subcategory of US locations; the preferred method.

    Name a well-distributed column as ``spread`` when ``df`` has many rows per
    location, so that a very large location is split over tasks.
    """
    labels = locations.filter(in_us("state_cleaned")).select(
        "location_id",
        F.col("business_type_new").alias("broad_industry"),
        F.col("business_category_new").alias("industry_subcategory"),
    )
    if spread is None:
        return df.join(labels, "location_id")
    return spread_join(df, labels, "location_id", spread)


def hierarchy(locations: DataFrame) -> DataFrame:
    """Distinct industry, subcategory and code triples present in the data."""
    return locations.select(
        F.col("business_category_new").alias("industry_subcategory"),
        F.col("business_type_new").alias("broad_industry"),
        "naics_code",
    ).distinct()


def ambiguous_codes(locations: DataFrame) -> DataFrame:
    """NAICS codes found under more than one subcategory."""
    triples = hierarchy(locations).filter(F.col("naics_code").isNotNull())
    return triples.groupBy("naics_code").agg(F.count(F.lit(1)).alias("placements")).filter(F.col("placements") > 1)


def employees_by_industry(timeclock: DataFrame, locations: DataFrame) -> DataFrame:
    """Distinct workers with a clock-in per day, industry and subcategory."""
    clocked = timeclock.filter((F.col("has_clock_in") == 1) & F.col("user_id").isNotNull())
    # One row per worker, location and day is all the count needs downstream.
    days = clocked.select("event_date", "location_id", "user_id").distinct()
    labelled = by_location(days, locations, spread="user_id").filter(F.col("broad_industry").isNotNull())
    return labelled.groupBy("event_date", "broad_industry", "industry_subcategory").agg(
        F.countDistinct("user_id").alias("employees_working")
    )
