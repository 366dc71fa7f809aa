"""A whole raw study folder to a bundle in one call."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortspark.functions import scalars
from cohortspark.operators.registry import Registry
from cohortspark.sources import registry_tsv, study
from cohortspark.sources.bundle import list_files
from cohortspark.sources.file_digests import file_digests
from cohortspark.sources.sinks import write_dictionary

# The study file, its key field, and the two clinical tables by extension.
STUDY_FILE, STUDY_KEY = "meta_study.txt", "cancer_study_identifier"
SAMPLES, PATIENTS = "data_clinical_sample", "data_clinical_patient"
# Schemas of registry tables that a converted study fills or leaves empty.
URLS = "id long, url string, created_at long, status string, uploader string, file string"
ALIASES = "id long, name string, file string"
TAGS = "id long, field_name string, field_value string, file string"


def study_file_registry(spark: SparkSession, folder: str, prefix: str, uploader: str, now: int) -> Registry:
    """The raw files of a study as registered files: guid from the content's sha1, base id and digest from its md5.

    Contents are digested block by block, so files may be of any size.
    """
    files = file_digests(spark, folder, digests="md5,sha1").select(
        F.element_at(F.split("path", "/"), -1).alias("filename"), "size", "md5",
        scalars.make_guid(prefix, scalars.uuid5(F.col("sha1"))).alias("guid"))
    files = files.groupBy("guid").agg(F.min("filename").alias("filename"), F.min("size").alias("size"), F.min("md5").alias("md5"))
    stamp = F.lit(now).cast("long")
    file = files.select(
        "guid", "filename", "size", stamp.alias("created_at"), stamp.alias("updated_at"), F.lit("pending").alias("status"),
        scalars.uuid5(F.col("md5")).alias("baseid"), F.substring(scalars.guid_uuid(F.col("guid")), 1, 8).alias("rev"),
        F.lit(1).alias("version"), F.lit(uploader).alias("uploader"), F.lit(None).cast("string").alias("acl"))
    digest = files.select(F.lit(None).cast("long").alias("id"), F.col("md5").alias("hash"), F.lit("md5").alias("hash_type"),
                          F.col("guid").alias("file"))
    empty = {name: spark.createDataFrame([], schema) for name, schema in (("url", URLS), ("alias", ALIASES), ("tag", TAGS))}
    return Registry(file=file, hash=digest, **empty)


def _clinical(spark: SparkSession, names: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    def path(stem: str) -> str | None:
        return next((names[stem + end] for end in (".txt", ".tsv") if stem + end in names), None)

    samples, patients = path(SAMPLES), path(PATIENTS)
    if samples and patients:
        return study.convert_clinical(study.read_annotated(spark, samples), study.read_annotated(spark, patients))
    if not (samples or patients):
        raise ValueError("a study needs a table of samples or of patients")
    return study.convert_annotated(spark, samples or patients)


def convert_study(spark: SparkSession, folder: str, output: str, version: str = "v0.0.1", organization: str = "",
                  prefix: str = "study", uploader: str = "", now: int = 0) -> str:
    """Write ``<output>/<key>/<version>/`` from a study folder and return its path.

    The bundle has ``dataset.json``, ``metadata_table.parquet``, ``metadata_dictionary.json``, a table bundle below
    ``datafiles/`` for every omics file that has a description, and ``datafile.tsv`` with the raw files. The key must be
    the name of the folder. The table is written once, and its dictionary and size come from what was written.
    """
    folder = folder.rstrip("/")
    name = folder.rsplit("/", 1)[-1]
    # a file of the study may be a folder of parts, so its name is the first one below the study's folder
    parts = F.split(F.regexp_replace("path", r"/part-[^/]*$", ""), "/")
    listed = list_files(spark, f"{folder}/*").select(F.element_at(parts, -1).alias("name")).distinct()
    names = {row["name"]: f"{folder}/{row['name']}" for row in listed.collect()}
    if STUDY_FILE not in names:
        raise ValueError(f"{folder} has no {STUDY_FILE}")
    pairs = study.key_values(study.read_lines(spark, names[STUDY_FILE]))
    pairs = pairs.withColumn("key", F.when(F.col("key") == STUDY_KEY, "key").otherwise(F.col("key")))
    record = study.study_records(pairs).first()
    if record["key"] != name:
        raise ValueError(f"the key of the study ({record['key']}) is not its folder's name ({name})")
    path = f"{output.rstrip('/')}/{name}/{version}"
    table, fields = _clinical(spark, names)
    table.write.parquet(f"{path}/metadata_table.parquet")
    stored = spark.read.parquet(f"{path}/metadata_table.parquet")
    total = stored.count()
    write_dictionary(stored, f"{path}/metadata_dictionary.json", fields)
    tags = [*record["tags"], f"org:{organization or 'Unassigned'}"]
    row = {**record.asDict(), "tags": tags, "total": total, "is_filebased": False, "version": version, "license": ""}
    row.pop("file")
    schema = ("key string, name string, description string, citation string, pmid string, groups array<string>, "
              "tags array<string>, total long, is_filebased boolean, version string, license string")
    dataset = spark.createDataFrame([row], schema)
    dataset.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.text(f"{path}/dataset.json")
    for omics in study.OMICS_PREFIXES:
        data = next((names[f"data_{omics}{end}"] for end in (".txt", ".tsv") if f"data_{omics}{end}" in names), None)
        meta = names.get(f"meta_{omics}.txt")
        if data and meta:
            study.convert_omics(spark, data, meta, f"{path}/datafiles", omics)
    registry_tsv.write_flat(study_file_registry(spark, folder, prefix, uploader, now), f"{path}/datafile.tsv")
    return path
