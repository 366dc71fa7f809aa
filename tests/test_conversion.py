import json

import pytest

from cohortspark.operators import profile, reshape, validation
from cohortspark.operators.ranking import rank_by_similarity, search_catalog
from cohortspark.functions.similarity import is_similar, similarity, trim_query
from cohortspark.sources import bundle, sinks, study
from cohortspark.sources.lines import numbered_lines
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    ("cells", "want"),
    [
        ([], "STRING"), ([None, None], "STRING"), (["1", "2.5", "abc", "3"], "STRING"), (["True", "False", "true", "false"], "BOOLEAN"),
        (["1", "2", "3.14", "0"], "NUMBER"), (["0", "1", None], "NUMBER"), (["0", "True"], "BOOLEAN"), (["1d"], "STRING"), (["nan"], "STRING"),
        (["1e5", "-.5", "+3.", " 7 "], "NUMBER"), (["inf", "1"], "NUMBER"),
    ],
)
def test_infer_types(spark, cells, want):
    df = spark.createDataFrame([(c,) for c in cells], "v string")
    assert profile.types_of(df) == {"v": want}


def test_infer_types_of_wide_tables(spark, monkeypatch):
    df = spark.createDataFrame([("1", "a", "True"), ("2", None, "0")], "n string, s string, b string")
    narrow = profile.types_of(df)
    monkeypatch.setattr(profile, "MEASURED_COLUMNS", 1)
    assert profile.types_of(df) == narrow == {"n": "NUMBER", "s": "STRING", "b": "BOOLEAN"}


def test_casts(spark):
    df = spark.createDataFrame([("1", "True", "x", "NA"), (" 2.5 ", "0", None, "3")], "n string, b string, s string, m string")
    typed = profile.cast_to(df, profile.types_of(df))
    assert typed.dtypes == [("n", "double"), ("b", "boolean"), ("s", "string"), ("m", "string")]
    assert [tuple(r) for r in typed.collect()] == [(1.0, True, "x", "NA"), (2.5, False, None, "3")]
    typed, types = profile.cast_declared(df, {"n": "STRING", "b": "BOOLEAN", "m": "NUMBER"})
    assert types == {"n": "NUMBER", "b": "BOOLEAN", "s": "STRING", "m": "NUMBER"}
    assert [r["m"] for r in typed.collect()] == [None, 3.0]


def test_dictionary(spark):
    df = spark.createDataFrame([("a", "1", None), ("b", "10", None), ("a", "2", None)], "s string, n string, e string")
    header = spark.createDataFrame([("s", "Text", "a text", 3)], "key string, name string, description string, `order` int")
    found = {r["key"]: r for r in profile.dictionary(df, header).collect()}
    assert found["s"]["value_count"] == 2 and found["s"]["name"] == "Text" and found["s"]["order"] == 3
    assert (found["n"]["minimum"], found["n"]["maximum"], found["n"]["value_count"]) == (1.0, 10.0, 3)
    values = profile.dictionary_values(df, profile.dictionary(df))
    assert sorted(map(tuple, values.collect())) == [("s", 1, "a"), ("s", 2, "b")]
    assert found["e"]["data_type"] == "STRING" and found["e"]["value_count"] == 0
    many = spark.range(700).selectExpr("concat('v', id) AS s")
    plain = sorted(map(tuple, profile.dictionary_values(many, profile.dictionary(many)).collect()))
    assert plain == sorted(("s", i, v) for i, v in enumerate(sorted(f"v{i}" for i in range(700)), 1))
    assert sorted(map(tuple, profile.dictionary_values(many, profile.dictionary(many), 50).collect())) == plain
    plan = profile.dictionary(many)._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan
    assert {tuple(r) for r in profile.field_values(df).filter("key = 's'").collect()} == {("s", "a", 2), ("s", "b", 1)}


def test_dictionary_of_many_parts(spark, tmp_path):
    """A field of many values goes on over rows, and rows over parts that are arrays of their own."""
    table = spark.range(1000).selectExpr("concat('v', id) AS many", "cast(id % 2 = 0 AS boolean) AS flag", "id * 1.5 AS n", "cast(null AS string) AS none")
    table.write.parquet(str(tmp_path / "t.parquet"))
    stored = spark.read.parquet(str(tmp_path / "t.parquet"))
    path = str(tmp_path / "b" / "v1" / "t_dictionary.json")
    sinks.write_dictionary(stored, path, per_row=30)
    fields = bundle.read_dictionaries(spark, path).collect()
    assert sorted((r.bundle, r.table, r.key, r.data_type) for r in fields) == [
        ("b/v1", "t", "flag", "BOOLEAN"), ("b/v1", "t", "many", "STRING"), ("b/v1", "t", "n", "NUMBER"), ("b/v1", "t", "none", "STRING")]
    values = {}
    for r in bundle.read_allowed_values(spark, path).collect():
        values.setdefault(r.key, []).append(r.value)
    assert sorted(values.pop("many")) == sorted(f"v{i}" for i in range(1000))
    assert sorted(map(float, values.pop("n"))) == [0.0, 1498.5] and {k: sorted(v) for k, v in values.items()} == {"flag": ["false", "true"]}
    assert max(len(json.loads(r.allowed_values)) for r in spark.read.schema(bundle.FIELD_SCHEMA).json(path, multiLine=True).collect()) == 30


def test_json_arrays_of_many_tasks(spark, tmp_path):
    rows = spark.range(100).selectExpr("id AS a", "concat('t\"', id) AS b", "if(id % 3 = 0, null, id) AS c").repartition(4)
    sinks.write_json_array(rows, str(tmp_path / "many"))
    parts = [json.loads(p.read_text()) for p in (tmp_path / "many").glob("part-*")]
    assert len(parts) == 4 and sum(map(len, parts)) == 100
    back = spark.read.schema("a long, b string, c long").json(str(tmp_path / "many"), multiLine=True)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    sinks.write_json_array(rows, str(tmp_path / "one"), by="a")
    found = [r["b"] for p in sorted((tmp_path / "one").glob("part-*")) for r in json.loads(p.read_text())]
    assert found == [f't"{i}' for i in range(100)]
    sinks.write_json_array(rows.limit(0), str(tmp_path / "none"))
    assert spark.read.schema("a long").json(str(tmp_path / "none"), multiLine=True).collect() == []


def test_recommendations(spark):
    kinds = [("STRING", 6), ("STRING", 7), ("STRING", 26), ("STRING", 900), ("STRING", 501), ("NUMBER", 50), ("NUMBER", 51), ("BOOLEAN", 2), ("DATE", 1)]
    df = spark.createDataFrame([(f"k{i}", t, n) for i, (t, n) in enumerate(kinds)] + [("os_months", "NUMBER", 90), ("__summary", "STRING", 1)], "key string, data_type string, value_count long")
    views = [r["view"] for r in profile.recommend_view(df, F.lit(1000), ["os_months", "os_status"]).collect()]
    assert views == ["pie", "bar", "table", "id", "unsupported", "linechart", "histogram", "pie", "unsupported", "kaplan_meier", "summary"]


def matrix(spark, *rows):
    return spark.createDataFrame(list(rows), "Hugo_Symbol string, Entrez_Gene_Id string, s1 string, s2 string, s3 string")


def test_matrix(spark, rows):
    df = matrix(spark, ("A", "1", "1", "2", "3"), ("B", "2", None, "5", "6"), ("A", "9", "7", "8", "9"), (None, "3", "0", "0", "0")).coalesce(1)
    long = reshape.matrix_long(df)
    assert rows(long) == [("s1", "A", "1"), ("s1", "B", None), ("s2", "A", "2"), ("s2", "B", "5"), ("s3", "A", "3"), ("s3", "B", "6")]
    assert reshape.matrix_long(df, drop_missing_gene=False).count() == 9
    wide = reshape.matrix_wide(long, ["B", "A", "Z"])
    assert wide.columns == ["sample_id", "B", "A", "Z"]
    assert rows(wide) == [("s1", None, "1", None), ("s2", "5", "2", None), ("s3", "6", "3", None)]


def test_hierarchy(spark, rows):
    tree = {"code": "TISSUE", "name": "Tissue", "children": {
        "X": {"code": "X", "name": "Ex", "tissue": "Organ", "children": {"Y": {"code": "Y", "name": "Why", "tissue": "Organ"}}},
        "Z": {"code": "Z", "name": "", "tissue": "Organ", "children": {}}}}
    df = spark.createDataFrame([(json.dumps(tree),)], "value string")
    assert rows(reshape.flatten_hierarchy(df)) == [("X", "Ex", "Organ"), ("Y", "Why", "Organ")]
    deep = {"code": "c60", "name": "n", "tissue": "t"}
    for i in range(59, -1, -1):
        deep = {"code": f"c{i}", "name": "n", "tissue": "t", "children": {"x": deep}}
    found = reshape.flatten_hierarchy(spark.createDataFrame([(json.dumps(deep),)], "value string"))
    assert found.count() == 61
    edges = spark.createDataFrame([("a", "r"), ("b", "a"), ("c", "x")], "code string, parent string")
    roots = spark.createDataFrame([("r",)], "code string")
    assert rows(reshape.flatten_edges(edges, roots)) == [("a", 1), ("b", 2), ("r", 0)]
    loop = spark.createDataFrame([("r", "a"), ("a", "r")], "code string, parent string")
    with pytest.raises(ValueError):
        reshape.flatten_edges(loop, roots)


# ------------------------------------------------------------------ similarity


def trigram_set(text):
    words, word = set(), ""
    for c in text.lower() + " ":
        if c.isalnum():
            word += c
        elif word:
            words.add(word)
            word = ""
    return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}


@pytest.mark.parametrize(("a", "b"), [("word", "two words"), ("", ""), ("...", "a"), ("Élan vital", "elan VITAL élan"), ("a a a", "a"), ("x\ny-z", "y z"), ("same", "same")])
def test_similarity_against_sets(spark, a, b):
    x, y = trigram_set(a), trigram_set(b)
    want = len(x & y) / len(x | y) if x | y else 0.0
    assert spark.range(1).select(similarity(F.lit(a), F.lit(b))).first()[0] == pytest.approx(want)


def test_ranking(spark):
    df = spark.createDataFrame([(1, "alice"), (2, "alicia"), (3, "bob"), (4, None)], "id int, name string")
    assert [r["id"] for r in rank_by_similarity(df, [("name", " alice ")], tie=["id"]).collect()] == [1, 2, 3, 4]
    assert [r["id"] for r in rank_by_similarity(df, [("name", "~bob~"), ("name", "x")], first_pairs=1, limit=1).collect()] == [3]
    assert [r["id"] for r in df.filter(is_similar(F.col("name"), F.lit("alice"))).collect()] == [1, 2]
    assert (trim_query(" alice "), trim_query("~good~"), trim_query("a-b!")) == ("alice", "good", "a-b")


# ------------------------------------------------------------------ bundles

RECORD = {"key": "k1", "name": "First", "description": "", "citation": "", "pmid": "", "groups": ["PUBLIC"], "tags": ["disease:X"], "total": 3, "is_filebased": False, "version": "v0.0.1", "license": ""}
FIELDS = [
    {"key": "sample_id", "name": "Sample", "description": "", "data_type": "STRING", "notes": "", "allowed_values": ["a"], "order": 1},
    {"key": "Bad Key", "name": "x", "description": "", "data_type": "STRING", "notes": "", "allowed_values": [], "order": 9},
    {"key": "age", "name": "Age", "description": "", "data_type": "INTEGER", "notes": "", "allowed_values": [1, 2], "order": 2},
]


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("datasets")
    for key, version in (("k1", "v0.0.1"), ("k1", "v0.0.2"), ("k2", "v1.0.0"), ("k3", "v1.0.0")):
        folder = root / key / version
        (folder / "datafiles").mkdir(parents=True)
        record = {**RECORD, "key": key if key != "k2" else "other", "version": version}
        (folder / "dataset.json").write_text(json.dumps(record) if key != "k3" else "{broken")
        if key != "k3":
            fields = FIELDS if key == "k1" else FIELDS[2:]
            (folder / "metadata_dictionary.json").write_text(json.dumps(fields))
            spark.createDataFrame([("a", 1), ("b", 2)], "sample_id string, age int").write.parquet(str(folder / "metadata_table.parquet"))
            (folder / "datafile.tsv").write_text("guid\nr/1\n")
    tables = root / "k1" / "v0.0.1" / "datafiles"
    spark.createDataFrame([("a", 0.5), ("z", 0.1)], "Sample_Id string, score double").write.parquet(str(tables / "sv.parquet"))
    (tables / "sv_dictionary.json").write_text(json.dumps(FIELDS[:1]))
    (tables / "sv_metadata.json").write_text(json.dumps({"title": "SV", "description": "d", "id_column_name": "Sample_Id"}))
    (tables / "lone_dictionary.json").write_text("[]")
    (root / "index.json").write_text(json.dumps([RECORD, {**RECORD, "version": "v0.0.2"}]))
    return str(root)


def test_catalog(spark, base, rows, tmp_path):
    assert rows(bundle.read_catalog(spark, base), "key", "version", "total") == [("k1", "v0.0.1", 3), ("k1", "v0.0.2", 3)]
    assert rows(bundle.scan_datasets(spark, base), "bundle", "key") == [("k1/v0.0.1", "k1"), ("k1/v0.0.2", "k1"), ("k2/v1.0.0", "other"), ("k3/v1.0.0", None)]
    built = bundle.build_catalog(spark, base, str(tmp_path / "index"))
    assert rows(built, "key", "version", "tags") == [("k1", "v0.0.1", ["disease:X"]), ("k1", "v0.0.2", ["disease:X"]), ("other", "v1.0.0", ["disease:X"])]
    assert rows(bundle.read_catalog(spark, str(tmp_path / "index"))) == rows(built) and built.count() == 3
    assert [r["version"] for r in search_catalog(built, "FIRST", "disease:X", "name").collect()][:2] == ["v0.0.1", "v0.0.2"]
    assert search_catalog(built, tag="No tags").count() == 0


def test_dataset_tables(spark, base):
    data = bundle.Dataset(spark, base, "k1", "v0.0.1")
    assert data.metadata().data.count() == 2 and data.metadata().id_column == "sample_id"
    table = data.table("sv")
    assert (table.id_column, table.title, table.data.count()) == ("Sample_Id", "SV", 2)
    assert data.dictionary().count() == 3 and data.dictionary("sv").count() == 1
    assert set(data.tables(["sv", "metadata_table"])) == {"sv", "metadata_table"}


def test_discovery(spark, base, rows):
    listing = bundle.bundle_listing(spark, base)
    files = {tuple(r) for r in listing.collect()}
    assert ("k1/v0.0.1", "datafiles/sv_metadata.json") in files and ("k3/v1.0.0", "dataset.json") in files
    paths = listing.select(F.concat_ws("/", "bundle", "file").alias("path"))
    assert rows(bundle.file_groups(paths), "prefix", "parquet") == [("sv", "k1/v0.0.1/datafiles/sv.parquet")]


def test_bundle_checks(spark, base, rows):
    dictionaries = bundle.read_dictionaries(spark, f"{base}/*/*/metadata_dictionary.json")
    assert rows(validation.missing_fields(dictionaries)) == [("k2/v1.0.0", "sample_id")]
    assert rows(validation.rule_violations(dictionaries), "bundle", "key", "problem") == [
        ("k1/v0.0.1", "Bad Key", "invalid key"), ("k1/v0.0.1", "age", "invalid data_type"), ("k1/v0.0.2", "Bad Key", "invalid key"),
        ("k1/v0.0.2", "age", "invalid data_type"), ("k2/v1.0.0", "age", "invalid data_type"),
    ]
    files = bundle.list_files(spark, f"{base}/*/*/metadata_table.parquet/*.parquet").select("path", F.regexp_extract("path", r"([^/]+/[^/]+)/metadata_table", 1).alias("bundle"))
    columns = bundle.parquet_columns(files)
    assert rows(columns) == [(b, c) for b in ("k1/v0.0.1", "k1/v0.0.2", "k2/v1.0.0") for c in ("age", "sample_id")]
    assert rows(validation.missing_columns(dictionaries, columns)) == [("k1/v0.0.1", "Bad Key"), ("k1/v0.0.2", "Bad Key")]
    listing = bundle.bundle_listing(spark, base).withColumn("file", F.regexp_replace("file", r"(\.parquet)/.*$", "$1"))
    problems = validation.incomplete_bundles(listing, bundle.scan_datasets(spark, base))
    found = rows(problems)
    assert ("k2/v1.0.0", "key does not match directory") in found and ("k1/v0.0.2", "no datafile table") in found
    assert ("k3/v1.0.0", "missing datafile.tsv") in found and not any(b == "k1/v0.0.1" for b, _ in found)


def test_row_checks(spark):
    df = spark.createDataFrame([(1, "a"), (-1, None), (None, "b")], "n int, s string")
    checked = validation.check_rows(df, {"positive": F.col("n") > 0, "named": F.col("s").isNotNull()})
    assert [r["reasons"] for r in checked.collect()] == [[], ["positive", "named"], ["positive"]]
    assert validation.accepted(checked).count() == 1 and validation.rejected(checked).count() == 2


def test_line_report(spark, tmp_path):
    lines = ["size,name"] + [f"{i},n{i}" for i in range(2, 50)]
    lines[7], lines[20], lines[30] = "x,bad", "-5,", ""
    (tmp_path / "rows.csv").write_text("\n".join(lines) + "\n")
    rules = {"size must be positive": F.col("size") > 0, "name is missing": F.col("name").isNotNull()}
    for limits in ({}, {"group_rows": 0, "ranges": 4}):
        numbered = numbered_lines(spark, str(tmp_path / "rows.csv"), **limits)
        assert [r["value"] for r in numbered.orderBy("line").collect()] == lines
        found = validation.check_lines(numbered, "size int, name string", rules).orderBy("line").collect()
        assert [(r["line"], r["reasons"]) for r in found] == [
            (8, ["cannot be parsed", "size must be positive"]), (21, ["size must be positive", "name is missing"])
        ]


def test_lines_of_a_file_read_in_blocks(spark, tmp_path):
    lines = [f"line {i}" for i in range(3000)]
    (tmp_path / "long.txt").write_text("\n".join(lines))
    (tmp_path / "short.txt").write_text("a\nb")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = numbered_lines(spark, str(tmp_path / "*.txt"), group_rows=0, ranges=4).orderBy("file", "line").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["value"] for r in found] == lines + ["a", "b"]
    assert [r["line"] for r in found] == [*range(1, 3001), 1, 2]


# ------------------------------------------------------------------ studies

ANNOTATED = (
    "#Patient Identifier\tDiagnosis Age\tSex\tTime (months)\tNote\n"
    "#The patient\tAge\tSex\tTime\tFree text\n"
    "#STRING\tNUMBER\tSTRING\tNUMBER\tSTRING\n"
    "#1\t1\t9\t1\t2\n"
    "PATIENT_ID\tAGE\tSEX\tTIME-TO-MET\tNOTE\n"
    "p1\t40\tF\tNA\t\"quoted\" text\n"
    "p2\t[Not Available]\tM\t1d\tN/A\n"
    "\n"
    "p3\t51.5\tF\t3\t\n"
)


def test_annotated_table(spark, rows, tmp_path):
    (tmp_path / "metadata_table.tsv").write_text(ANNOTATED)
    path = str(tmp_path / "metadata_table.tsv")
    raw, header = study.read_annotated(spark, path)
    assert raw.columns == ["patient_id", "age", "sex", "time_to_met", "note"]
    assert raw.count() == 3
    assert rows(header) == [
        ("age", "Diagnosis Age", "Age", "NUMBER", 1), ("note", "Note", "Free text", "STRING", 2), ("patient_id", "Patient Identifier", "The patient", "STRING", 1),
        ("sex", "Sex", "Sex", "STRING", 9), ("time_to_met", "Time (months)", "Time", "NUMBER", 1),
    ]
    typed, fields = study.convert_annotated(spark, path)
    assert dict(typed.dtypes) == {"patient_id": "string", "age": "double", "sex": "string", "time_to_met": "string", "note": "string"}
    assert rows(typed) == [("p1", 40.0, "F", None, '"quoted" text'), ("p2", None, "M", "1d", None), ("p3", 51.5, "F", "3", None)]
    found = {r["key"]: r for r in fields.collect()}
    assert (found["age"]["minimum"], found["age"]["maximum"]) == (40.0, 51.5)
    values = profile.dictionary_values(typed, fields).filter("key = 'sex'")
    assert sorted(r["value"] for r in values.collect()) == ["F", "M"]
    with pytest.raises(ValueError):
        (tmp_path / "plain.tsv").write_text("a\tb\n1\t2\n")
        study.read_annotated(spark, str(tmp_path / "plain.tsv"))


def test_clinical_tables(spark, rows, tmp_path):
    def header(*names):
        return "".join("#" + "\t".join(cells) + "\n" for cells in (names, names, ["NUMBER" if n == "AGE" else "STRING" for n in names], ["1"] * len(names)))

    (tmp_path / "s.txt").write_text(header("SAMPLE_ID", "PATIENT_ID") + "SAMPLE_ID\tPATIENT_ID\ns1\tp2\ns2\tp1\ns3\tp2\n")
    (tmp_path / "p.txt").write_text(header("PATIENT_ID", "AGE", "GRADE") + "PATIENT_ID\tAGE\tGRADE\np1\t[Discrepancy]\t1\np2\t7\t2\n")
    typed, fields = study.convert_clinical(study.read_annotated(spark, str(tmp_path / "s.txt")), study.read_annotated(spark, str(tmp_path / "p.txt")))
    assert dict(typed.dtypes) == {"sample_id": "string", "patient_id": "string", "age": "double", "grade": "double"}
    assert rows(typed) == [("s1", "p2", 7.0, 2.0), ("s2", "p1", None, 1.0), ("s3", "p2", 7.0, 2.0)]
    assert {r["key"]: r["data_type"] for r in fields.collect()} == {"sample_id": "STRING", "patient_id": "STRING", "age": "NUMBER", "grade": "NUMBER"}


def test_key_value_files(spark, tmp_path):
    (tmp_path / "dataset.txt").write_text("key: acbc\nname: A: B study\ngroups: PUBLIC; ACYC ;\ntags: org:x;disease:y\nis_filebased: true\njunk\nkey: acbc2\n")
    pairs = study.key_values(study.read_lines(spark, str(tmp_path / "dataset.txt")))
    record = study.study_records(pairs).first()
    assert (record["key"], record["name"], record["groups"], record["tags"]) == ("acbc2", "A: B study", ["PUBLIC", "ACYC"], ["org:x", "disease:y"])
    assert record["is_filebased"] is True and record["version"] == "v0.0.1" and record["total"] == 0


def test_omics_discovery(spark, rows):
    names = ["data_cna.txt", "meta_cna.txt", "data_mutations_x.txt", "meta_mutations_x.txt", "data_clinical.txt", "meta_clinical.txt", "data_sv.txt", "meta_cna.txt.bak"]
    listing = spark.createDataFrame([(f"/s/{n}",) for n in names], "path string")
    assert rows(study.omics_pairs(listing), "prefix", "data_path") == [("cna", "/s/data_cna.txt"), ("mutations_x", "/s/data_mutations_x.txt")]


def test_convert_events(spark, rows, tmp_path):
    (tmp_path / "data_sv.txt").write_text("Sample_Id\tSite1 Symbol\tCount\tFlag\tsite1_symbol\ns1\tTP53\t3\tTrue\tx\ns2\tNA\t4.5\tfalse\ty\n")
    (tmp_path / "meta_sv.txt").write_text("genetic_alteration_type: STRUCTURAL_VARIANT\nstable_id: sv\nprofile_description: Variants\ndatatype: SV\n")
    out = str(tmp_path / "out")
    table = study.convert_omics(spark, str(tmp_path / "data_sv.txt"), str(tmp_path / "meta_sv.txt"), out, "sv")
    assert table.dtypes == [("Sample_Id", "string"), ("Site1_Symbol", "string"), ("Count", "double"), ("Flag", "boolean"), ("site1_symbol_4", "string")]
    assert rows(table)[1] == ("s2", None, 4.5, False, "y")
    fields = {r["key"]: r for r in spark.read.schema(bundle.FIELD_SCHEMA).json(f"{out}/sv_dictionary.json", multiLine=True).collect()}
    assert json.loads(fields["Count"]["allowed_values"]) == [3.0, 4.5] and json.loads(fields["Site1_Symbol"]["allowed_values"]) == ["TP53"]
    about = spark.read.schema(bundle.TABLE_SCHEMA).json(f"{out}/sv_metadata.json", multiLine=True).first()
    assert (about["title"], about["id_column_name"]) == ("SV", "Sample_Id")
    assert spark.read.csv(f"{out}/sv.tsv", sep="\t", header=True).count() == 2


def test_convert_matrix(spark, rows, tmp_path):
    (tmp_path / "data_cna.txt").write_text("Hugo_Symbol\tEntrez_Gene_Id\tS-1\tS2\nA\t1\t-2\tNA\nB\t2\t0\t1\nA\t3\t9\t9\n\t4\t5\t5\n")
    (tmp_path / "meta_cna.txt").write_text("genetic_alteration_type: COPY_NUMBER_ALTERATION\nstable_id: gistic\n")
    args = (spark, str(tmp_path / "data_cna.txt"), str(tmp_path / "meta_cna.txt"))
    long = study.convert_omics(*args, str(tmp_path / "long"), "cna")
    assert rows(long) == [("S-1", "A", -2.0), ("S-1", "B", 0.0), ("S2", "A", None), ("S2", "B", 1.0)]
    wide = study.convert_omics(*args, str(tmp_path / "wide"), "cna", genes=["B", "A"])
    assert rows(wide) == [("S-1", 0.0, -2.0), ("S2", 1.0, None)] and wide.columns == ["sample_id", "B", "A"]


def test_json_rows(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert sinks.rows_as_json(df).first()["json"] == '{"a":1,"b":null}'


def test_file_fingerprints(spark, tmp_path):
    import hashlib

    from cohortspark.functions.scalars import fingerprints

    (tmp_path / "f.bin").write_bytes(b"\x00\x01data")
    found = spark.read.format("binaryFile").load(str(tmp_path / "f.bin")).select(fingerprints(F.col("content")).alias("f")).first()["f"]
    assert found["sha256"] == hashlib.sha256(b"\x00\x01data").hexdigest()


# ------------------------------------------------------------------ whole studies


def test_study_to_bundle(spark, tmp_path):
    from cohortspark.sources import convert, registry_tsv

    raw = tmp_path / "raw" / "my_study"
    raw.mkdir(parents=True)
    (raw / "meta_study.txt").write_text("cancer_study_identifier: my_study\nname: A: study\ngroups: a;b\n")
    (raw / "data_clinical_patient.txt").write_text(
        "#Patient\tAge\n#Id\tYears\n#STRING\tNUMBER\n#1\t1\nPATIENT_ID\tAGE\np1\t50\np2\tNA\n")
    (raw / "data_clinical_sample.txt").write_text(
        "#Patient\tSample\n#Id\tId\n#STRING\tSTRING\n#1\t1\nPATIENT_ID\tSAMPLE_ID\np1\ts1\np1\ts2\np2\ts3\n")
    (raw / "data_sv.txt").write_text("Sample_Id\tSite1_Hugo_Symbol\tCount\ns1\tTP53\t3\ns2\tKRAS\t4\n")
    (raw / "meta_sv.txt").write_text("stable_id: sv\ngenetic_alteration_type: STRUCTURAL_VARIANT\nprofile_description: d\n")
    out = str(tmp_path / "out")
    path = convert.convert_study(spark, str(raw), out, "v0.0.2", "lab", prefix="r", uploader="u", now=7)
    assert path == f"{out}/my_study/v0.0.2"
    data = bundle.Dataset(spark, out, "my_study", "v0.0.2")
    assert sorted(r["sample_id"] for r in data.metadata().data.collect()) == ["s1", "s2", "s3"]
    assert {r["key"]: r["data_type"] for r in data.dictionary().collect()} == {"patient_id": "STRING", "sample_id": "STRING", "age": "NUMBER"}
    assert data.table("sv").id_column == "Sample_Id" and data.table("sv").data.count() == 2
    record = bundle.scan_datasets(spark, out).first()
    assert (record["key"], record["total"], record["version"], record["tags"]) == ("my_study", 3, "v0.0.2", ["org:lab"])
    files = registry_tsv.parse_flat(registry_tsv.read_flat(spark, f"{path}/datafile.tsv"), 0)
    assert files.file.count() == 5 and files.hash.count() == 5
    flat = registry_tsv.read_flat(spark, f"{path}/datafile.tsv").withColumn("bundle", F.lit("b"))
    assert validation.unreadable_datafiles(flat).count() == 0
    assert validation.unreadable_datafiles(flat.withColumn("size", F.lit("x"))).count() == 5
    (raw.parent / "other").mkdir()
    (raw.parent / "other" / "meta_study.txt").write_text("cancer_study_identifier: my_study\n")
    with pytest.raises(ValueError, match="folder's name"):
        convert.convert_study(spark, str(raw.parent / "other"), out)


def test_table_problems(spark, rows):
    tables = spark.createDataFrame(
        [("b", "ok", "id", ["id", "x"]), ("b", "noid", "s", ["x"]), ("b", "gone", "id", None), ("b", "bare", "id", ["id"])],
        "bundle string, table string, id_column string, columns array<string>")
    fields = spark.createDataFrame(
        [("b", "ok", "id"), ("b", "ok", "x"), ("b", "noid", "x"), ("b", "noid", "y"), ("b", "gone", "id")],
        "bundle string, table string, key string")
    assert rows(validation.table_problems(tables, fields)) == [
        ("b", "bare", "missing dictionary"), ("b", "gone", "missing data"), ("b", "noid", "dictionary field not in data"),
        ("b", "noid", "id column not in dictionary")]


# ------------------------------------------------------------------ files of any size


def test_file_digests(spark, tmp_path):
    import hashlib

    from cohortspark.sources.file_digests import DIGESTS, digests_of, file_digests, planned

    contents = {"a.bin": b"", "b.bin": b"x" * 5000, "sub/c.bin": bytes(range(256)) * 40, "sub/d.txt": b"d"}
    for name, content in {**contents, "_hidden": b"h", ".part.crc": b"c"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    found = file_digests(spark, str(tmp_path), block_bytes="100", task_bytes="3000").collect()
    assert {r.path[len(str(tmp_path)) + 1:]: (r["size"], r.md5, r.sha1, r.sha256, r.sha512) for r in found} == {
        n: (len(c), *(hashlib.new(d, c).hexdigest() for d in DIGESTS)) for n, c in contents.items()}
    some = file_digests(spark, f"{tmp_path}/sub/*.bin", digests="sha1").collect()
    assert [(r["size"], r.md5, r.sha1) for r in some] == [(10240, None, hashlib.sha1(contents["sub/c.bin"]).hexdigest())]
    assert file_digests(spark, f"{tmp_path}/*.none").collect() == []
    assert planned([("a", 5), ("b", 9), ("c", 4), ("d", 1)], 2) == [["b", "d"], ["a", "c"]]

    class Endless:
        """Three gigabytes of zeros, read a block at a time."""

        left, largest = 3 << 30, 0

        def read(self, n):
            n = min(n, self.left)
            self.left, self.largest = self.left - n, max(self.largest, n)
            return memoryview(zeros)[:n]

    zeros, handle = bytes(4 << 20), Endless()
    size, _ = digests_of(handle, ("md5",))
    assert size == 3 << 30 and handle.largest <= 4 << 20  # more than a cell may hold, and never more than a block at once


def test_large_file_needs_no_large_memory(tmp_path):
    """A file of 300 MB in a process that may take less than that."""
    import subprocess
    import sys

    with open(tmp_path / "large", "wb") as out:
        out.truncate(300 << 20)
    code = ("import resource, sys; sys.path.insert(0, '.'); from cohortspark.sources.file_digests import FileDigestReader as R; "
            "r = R({'path': sys.argv[1], 'digests': 'md5'}); before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; "
            "rows = [x for p in r.partitions() for b in r.read(p) for x in b.to_pylist()]; "
            "print(rows[0]['size'], resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)")
    out = subprocess.run([sys.executable, "-c", code, str(tmp_path)], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) == 300 << 20 and int(out[1]) < 100_000


# ------------------------------------------------------------------ deep trees


def test_deep_trees_take_few_steps(spark, rows, monkeypatch):
    n, steps = 300, []
    edges = spark.createDataFrame([(i, i - 1) for i in range(1, n)] + [(1000 + i, 0) for i in range(200)], "code long, parent long")
    real = reshape.written
    monkeypatch.setattr(reshape, "written", lambda df, name: steps.append(name) or real(df, name))
    found = {r.code: r.depth for r in reshape.flatten_edges(edges, spark.createDataFrame([(0,)], "code long")).collect()}
    assert found == {**{i: i for i in range(n)}, **{1000 + i: 1 for i in range(200)}}
    assert steps.count("walk-step") <= 11
    # two ways to a node give it twice; a cycle out of reach does no harm
    edges = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("x", "y"), ("y", "x"), ("e", None)], "code string, parent string")
    assert rows(reshape.flatten_edges(edges, spark.createDataFrame([("a",)], "code string"))) == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("d", 2)]


def test_dictionary_query_lists_every_value(spark):
    """The registered query: all values of all fields, those of over 500 as well, and over 10 000 in more rows."""
    import os

    from workloads import QUERIES
    from workloads.conversion import _texts

    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("driver tables are not here")
    rows = QUERIES["dictionary"](spark, sf).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.key, r.part or 0)):
        got.setdefault(r.key, []).extend(r.allowed_values.split(";") if r.allowed_values is not None else [])
    texts = _texts(spark, sf)
    for key, kind in profile.types_of(texts).items():
        values = sorted({r[0] for r in texts.select(key).collect()} - {None}) if kind != "NUMBER" else []
        assert got[key] == values
    assert len(got["c_name"]) == 15000 and {r.part for r in rows if r.key == "c_name"} == {None, 1}
