"""Dataset and file versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortspark.operators.ordered import row_numbers


def version_order(version: Column) -> Column:
    """A sortable value of a semantic version such as ``v0.0.10`` or ``1.2.0-rc.1``.

    Numbers compare as numbers, a pre-release sorts before its release, numeric pre-release parts
    sort before texts. Build information after ``+`` does not count.
    """
    core = F.regexp_replace(F.regexp_replace(version, r"\+.*$", ""), r"^[=v\s]+", "")
    release = F.substring_index(core, "-", 1)
    numbers = F.transform(F.split(release, r"\."), lambda p: F.coalesce(p.try_cast("long"), F.lit(-1)))
    extra = F.regexp_extract(core, r"^[^-]*-(.*)$", 1)
    parts = F.transform(
        F.split(extra, r"\."),
        lambda p: F.struct(
            p.rlike(r"\D").cast("int").alias("is_text"),
            F.coalesce(F.when(~p.rlike(r"\D"), p.try_cast("long")), F.lit(0)).alias("number"),
            p.alias("text"),
        ),
    )
    return F.struct(numbers.alias("numbers"), (extra == "").cast("int").alias("released"), parts.alias("parts"))


def latest(catalog: DataFrame, key: str = "key", version: str = "version") -> DataFrame:
    """The row of the highest version per key.

    Aggregated before the shuffle, so a key with very many versions costs no more than another.
    """
    best = F.max_by(F.struct(*catalog.columns), version_order(F.col(version)))
    return catalog.groupBy(F.col(key).alias("_key")).agg(best.alias("_row")).select("_row.*")


def resolve(
    catalog: DataFrame, requests: DataFrame, key: str = "key", version: str = "version"
) -> DataFrame:
    """Per request (key, version) the requested version if it exists, else the latest of the key.

    Requests without any version of their key drop out. ``requested`` keeps the asked version.
    """
    keep = [c for c in catalog.columns if c != key]
    asked = requests.select(F.col(key).alias("_key"), F.col(version).alias("requested")).distinct()
    # the latest row of a key is one, and a key and version name one too, so no join multiplies versions and requests
    newest = latest(catalog, key, version).select(F.col(key).alias("_newest_key"), F.struct(*keep).alias("_newest"))
    exact = catalog.groupBy(F.col(key).alias("_exact_key"), F.col(version).alias("_exact_version")).agg(
        F.min(F.struct(*keep)).alias("_exact"))
    rows = asked.join(newest, asked["_key"] == newest["_newest_key"]).join(
        exact, (asked["_key"] == exact["_exact_key"]) & (asked["requested"] == exact["_exact_version"]), "left")
    best = F.coalesce("_exact", "_newest").alias("_row")
    return rows.select(F.col("_key").alias(key), "requested", best).select(key, "requested", "_row.*")


def history(files: DataFrame, **limits: int) -> DataFrame:
    """Files with their place in the history of their base id: 1 is the newest version.

    Also tells the size of the history and whether the row is its latest version.
    """
    ranked = row_numbers(
        files, ["baseid"], [("version", True), ("updated_at", True), ("guid", False)], "recency", **limits
    )
    return ranked.withColumn("is_latest", F.col("recency") == 1)
