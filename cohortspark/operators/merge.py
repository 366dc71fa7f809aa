"""Merging sample metadata with measurement tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

HOW = ("inner", "left", "right", "outer")


def merge(left: DataFrame, right: DataFrame, left_on: str, right_on: str, how: str = "inner") -> DataFrame:
    """Merge two tables on one key each; null keys match, clashing columns take the right value.

    The matched rows are one inner join, in which adaptive execution can split a hot key on either
    side; an outer join could not be split on both. Unmatched rows come from anti joins against the
    distinct keys of the other side, and the shuffled input is shared with the inner join.
    """
    if how not in HOW:
        raise ValueError(f"how must be one of {HOW}")
    l = left.select(*[F.col(c).alias(f"_l_{c}") for c in left.columns])
    r = right.select(*[F.col(c).alias(f"_r_{c}") for c in right.columns])
    on = F.col(f"_l_{left_on}").eqNullSafe(F.col(f"_r_{right_on}"))
    columns = [*left.columns, *[c for c in right.columns if c not in left.columns]]

    def source(name: str) -> str:
        return f"_r_{name}" if name in right.columns else f"_l_{name}"

    merged = l.join(r, on, "inner").select(*[F.col(source(c)).alias(c) for c in columns])
    types = dict(merged.dtypes)

    def alone(side: DataFrame, names: Sequence[str], prefix: str) -> DataFrame:
        return side.select(
            *[
                (F.col(f"{prefix}{c}") if c in names else F.lit(None)).cast(types[c]).alias(c)
                for c in columns
            ]
        )

    if how in ("left", "outer"):
        keys = r.select(f"_r_{right_on}").distinct()
        merged = merged.unionByName(alone(l.join(keys, on, "left_anti"), left.columns, "_l_"))
    if how in ("right", "outer"):
        keys = l.select(f"_l_{left_on}").distinct()
        merged = merged.unionByName(alone(r.join(keys, on, "left_anti"), right.columns, "_r_"))
    return merged


def with_metadata(
    datafile: DataFrame, metadata: DataFrame, id_column: str, sample_id: str = "sample_id"
) -> DataFrame:
    """Datafile rows with the metadata of their sample; metadata columns win on a name clash.

    Metadata has one row per sample, so the plain left join is safe: Spark broadcasts the metadata
    when it is small and otherwise splits hot samples of the datafile side.
    """
    keys = metadata.select(*[F.col(c).alias(f"_m_{c}") for c in metadata.columns], F.lit(True).alias("_hit"))
    joined = datafile.join(keys, datafile[id_column].eqNullSafe(keys[f"_m_{sample_id}"]), "left")
    columns = []
    for name in datafile.columns:
        if name in metadata.columns:
            own = F.when(F.col("_hit"), F.col(f"_m_{name}")).otherwise(datafile[name])
            columns.append(own.alias(name))
        else:
            columns.append(datafile[name])
    columns += [F.col(f"_m_{c}").alias(c) for c in metadata.columns if c not in datafile.columns]
    return joined.select(*columns)


def of_samples(
    datafile: DataFrame, samples: DataFrame, id_column: str, sample_id: str = "sample_id"
) -> DataFrame:
    """Datafile rows whose id is among the selected metadata rows."""
    ids = samples.select(F.col(sample_id).alias("_id")).distinct()
    return datafile.join(ids, datafile[id_column] == ids["_id"], "left_semi")


def merge_clinical(samples: DataFrame, patients: DataFrame, key: str = "patient_id") -> DataFrame:
    """Sample rows with the columns of their patient; sample columns win on a name clash."""
    extra = [c for c in patients.columns if c not in samples.columns]
    side = patients.select(F.col(key).alias("_patient"), *extra)
    joined = samples.join(side, samples[key] == side["_patient"], "left")
    return joined.select(*[samples[c] for c in samples.columns], *extra)


def enrich_tags(
    studies: DataFrame, lookup: DataFrame, code: str = "type_of_cancer", organization: str | None = None
) -> DataFrame:
    """Add ``tags`` with the disease and organ of an upper-cased code, and the organization.

    ``lookup`` has one row per (code, name, tissue); codes it lacks add no tag.
    """
    table = lookup.select(F.col("code").alias("_code"), F.col("name").alias("_name"), F.col("tissue").alias("_tissue"))
    joined = studies.join(table, F.upper(studies[code]) == table["_code"], "left")

    def tag(space: str, column: str):
        return F.when(F.col(column) != "", F.concat(F.lit(f"{space}:"), F.col(column)))

    tags = F.array_compact(
        F.array(tag("disease", "_name"), tag("organ", "_tissue"), F.lit(f"org:{organization or 'Unassigned'}"))
    )
    return joined.select(*[studies[c] for c in studies.columns if c != "tags"], tags.alias("tags"))
