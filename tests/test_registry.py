import hashlib
import uuid

import pytest

from cohortspark.functions import scalars
from cohortspark.operators import registry as reg
from cohortspark.operators import versions
from cohortspark.sources import registry_tsv as tsv
from pyspark.sql import functions as F

FILE = "guid string, filename string, size long, created_at long, updated_at long, status string, baseid string, rev string, version int, uploader string, acl string"
URL = "id long, url string, created_at long, status string, uploader string, file string"
HASH = "id long, hash string, hash_type string, file string"
ALIAS = "id long, name string, file string"
TAG = "id long, field_name string, field_value string, file string"


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def registry(spark):
    return reg.Registry(
        file=spark.createDataFrame(
            [
                ("r/1", "Reads_R1.fq", 10, 0, 1748632413000, "validated", "b1", "a", 1, "ann", None),
                ("r/2", "reads_R2.fq", 20, 0, 1748632413000 - 86400000, "pending", "b1", "b", 2, "bob", "x, lab"),
                ("r/3", "other.bam", 30, 0, 5, "pending", "b2", "c", 1, "ann", "admin"),
            ],
            FILE,
        ),
        url=spark.createDataFrame(
            [
                (1, "node://a@x.org/OEP1/OEX1/OES1/OER1/OED1", 0, "pending", "ann", "r/1"),
                (2, "s3://bucket/one", 0, "validated", "ann", "r/1"),
                (3, "gsa://a@x.org/HRA1/HRS1/HRX1/HRR1/HRR1_f1.fastq.gz", 0, "pending", "bob", "r/2"),
            ],
            URL,
        ),
        hash=spark.createDataFrame([(1, md5("1"), "md5", "r/1"), (2, md5("2"), "md5", "r/2")], HASH),
        alias=spark.createDataFrame([(1, "doi://1", "r/1"), (2, "doi://2", "r/1")], ALIAS),
        tag=spark.createDataFrame([(1, "project", "P", "r/1"), (2, "project", "Q", "r/2"), (3, "kind", "P", "r/3")], TAG),
    )


def guids(df):
    return sorted(r["guid"] for r in df.collect())


@pytest.mark.parametrize(
    ("conditions", "want"),
    [
        ({}, ["r/1", "r/2", "r/3"]),
        ({"filename": "READS_"}, ["r/1", "r/2"]),
        ({"uploader": "ann", "status": "pending"}, ["r/3"]),
        ({"hash": md5("2")}, ["r/2"]),
        ({"alias": "doi://2"}, ["r/1"]),
        ({"url": "s3://bucket/one", "baseid": "b1"}, ["r/1"]),
        ({"field_name": "project", "field_value": "P"}, ["r/1"]),
        ({"field_name": "project"}, ["r/1", "r/2", "r/3"]),
        ({"guid": "r/9"}, []),
    ],
)
def test_search(registry, conditions, want):
    assert guids(reg.search(registry, **conditions)) == want


def test_access(registry):
    assert guids(reg.visible_to(registry.file, ["lab"])) == ["r/1", "r/2"]
    assert guids(reg.visible_to(registry.file, ["x", "x"])) == ["r/1", "r/2"]
    assert guids(reg.visible_to(registry.file, [])) == ["r/1"]


def test_children(registry):
    found = {r["guid"]: r for r in reg.with_children(registry.file, registry).collect()}
    assert [u["url"][:4] for u in found["r/1"]["urls"]] == ["node", "s3:/"]
    assert found["r/3"]["urls"] is None and found["r/3"]["hashes"] is None and len(found["r/3"]["tags"]) == 1
    assert found["r/2"]["access"] == "private" and found["r/1"]["access"] == "public"
    only = reg.with_children(registry.file, registry, ["alias"])
    assert "urls" not in only.columns and only.count() == 3


def test_hot_file_is_one_row_with_all_children(spark, registry):
    urls = spark.range(1000).selectExpr("id", "concat('s3://b/', id) AS url", "0L AS created_at", "'pending' AS status", "'u' AS uploader", "IF(id < 900, 'r/1', 'r/2') AS file")
    grown = reg.replace(registry, url=urls)
    found = {r["guid"]: r for r in reg.with_children(registry.file, grown, ["url"]).collect()}
    assert len(found) == 3 and [u["id"] for u in found["r/1"]["urls"]] == list(range(900))
    assert reg.long_children(grown, ["url"]).groupBy("guid").count().orderBy("guid").collect() == [("r/1", 900), ("r/2", 100)]


def test_search_page(registry):
    rows = reg.search_page(registry, 2, 1).collect()
    assert [r["guid"] for r in rows] == ["r/2"] and len(rows[0]["hashes"]) == 1


def test_by_hash(spark, registry):
    wanted = spark.createDataFrame([(md5("1"),), (md5("x"),)], "hash string")
    assert [(r["hash"], r["guid"]) for r in reg.by_hash(registry, wanted).collect()] == [(md5("1"), "r/1")]


def test_statistics(registry):
    assert tuple(reg.statistics(registry.file).first()) == (60, 3, 2, "v20250530")
    assert tuple(reg.statistics(registry.file.limit(0)).first()) == (0, 0, 0, "")
    assert sorted(r[0] for r in reg.tag_names(registry.tag).collect()) == ["kind", "project"]


def test_history(registry):
    found = {r["guid"]: (r["recency"], r["is_latest"]) for r in versions.history(registry.file).collect()}
    assert found == {"r/1": (2, False), "r/2": (1, True), "r/3": (1, True)}


@pytest.fixture(scope="module")
def repos(spark):
    return spark.createDataFrame(
        [
            (1, "node", "OEP1", "https://node/dl", "m1", None), (2, "node", "OEP1", "https://late/", "m2", None),
            (1, "gsa", "HRA1", "https://gsa/", None, "share"), (1, "s3", "bucket", None, None, None),
        ],
        "position int, protocol string, identity string, download_url string, member_id string, shared_id string",
    )


def links(registry, repos, repo, groups=None):
    rows = reg.download_links(registry.file, registry.url, repos, repo, groups, administrator=groups is None)
    return {r["guid"]: r for r in rows.collect()}


def test_links(registry, repos):
    node = links(registry, repos, "node")
    assert node["r/1"]["method"] == "POST" and node["r/1"]["baseurl"] == "https://node/dl"
    assert node["r/1"]["data"] == ["dataNo=OED1", "memberId=m1"]
    assert node["r/3"]["reason"] == "not released on this repository" and node["r/3"]["method"] is None
    gsa = links(registry, repos, "gsa", ["lab"])
    assert gsa["r/2"]["baseurl"] == "https://gsa/share/HRA1/HRR1/HRR1_f1.fastq.gz"
    assert gsa["r/3"]["reason"] == "no permission"
    assert links(registry, repos, "gsa", [])["r/2"]["reason"] == "no permission"
    everything = reg.download_links(registry.file, registry.url, repos, "gsa", administrator=True).filter("guid = 'r/2'").first()
    assert everything["method"] == "GET"
    digests = reg.download_links(registry.file, registry.url, repos, "node", hashes=registry.hash)
    by_guid = {r["guid"]: r for r in digests.collect()}
    assert by_guid["r/1"]["hashes"] and by_guid["r/3"]["reason"] in ("no digest", "no permission")
    assert links(registry, repos, "s3")["r/1"]["reason"] == "signing is not supported for this protocol"
    assert links(registry, repos.filter("protocol <> 'node'"), "node")["r/1"]["reason"] == "not released"


def test_http_links_need_no_identity(spark, registry):
    urls = spark.createDataFrame([(1, "http://x/y", 0, "pending", "u", "r/1")], URL)
    repos = spark.createDataFrame([(1, "http", "any", None, None, None)], "position int, protocol string, identity string, download_url string, member_id string, shared_id string")
    found = links(reg.replace(registry, url=urls), repos, "http")
    assert found["r/1"]["baseurl"] == "http://x/y" and found["r/1"]["method"] == "GET"


def test_missing_objects(spark, rows):
    table = spark.createDataFrame([("s3://b/1 ", "minio://b/2", 1), ("s3://b/1", "x", 2), ("http://n", "s3://b/3", 3)], "a string, b string, n int")
    listing = spark.createDataFrame([("s3://b/3",)], "url string")
    assert rows(reg.missing_objects(table, listing)) == [("a", "s3://b/1"), ("b", "minio://b/2")]


# ------------------------------------------------------------------ changes

BATCH = "size string, filename string, uploader string, md5sum string, url string, alias string"


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), BATCH)


def test_register(spark, registry):
    rows = batch(
        spark,
        ("5", "new.txt", "u", md5("n"), "s3://new/1", "doi://1"),
        ("6", "zz_same_digest.txt", "u", md5("n"), "s3://new/9", None),
        ("7", "known.txt", "u", md5("1"), None, None),
        ("8", "taken_url.txt", "u", md5("t"), "s3://bucket/one", "doi://new"),
        ("x", "bad size", "u", md5("b"), None, None),
        ("9", "bad hash", "u", "123", None, None),
        ("9", "bad url", "u", md5("u"), "ftp://x", None),
        ("9", None, "u", md5("f"), None, None),
        ("1d", "float", "u", md5("g"), None, None),
    )
    after = reg.register(registry, rows, "p.reg", 7)
    new = {r["filename"]: r for r in after.file.filter("created_at = 7").collect()}
    assert set(new) == {"new.txt", "taken_url.txt"}
    assert new["new.txt"]["guid"].startswith("p.reg/") and new["new.txt"]["rev"] == new["new.txt"]["guid"][6:14]
    assert new["new.txt"]["size"] == 5 and new["new.txt"]["version"] == 1
    assert after.hash.count() == 4 and after.url.count() == 5 and after.alias.count() == 3
    assert {r["hash_type"] for r in after.hash.collect()} == {"md5"}
    again = reg.register(after, rows, "p.reg", 8)
    assert again.file.count() == after.file.count()
    _, bad = reg.check_registrations(rows)
    assert {(r["filename"], r["reason"]) for r in bad.collect()} == {
        ("bad size", "size is not a whole number"), ("float", "size is not a whole number"), ("bad hash", "invalid hash value"),
        ("bad url", "invalid url protocol"), (None, "filename is missing"),
    }


def test_insert_ignore(spark, registry, rows):
    new = spark.createDataFrame([("doi://1", "r/2"), ("doi://3", "r/3"), ("doi://3", "r/2"), ("doi://4", "r/9")], "name string, file string")
    after = reg.insert_ignore(registry.alias, new, ["name"], registry.file)
    assert rows(after, "name", "file") == [("doi://1", "r/1"), ("doi://2", "r/1"), ("doi://3", "r/2")]


def test_upsert(spark, registry, rows):
    changes = spark.createDataFrame(
        [("r/1", "s3://bucket/one", "nonsense", "z", 1), ("r/2", "s3://new", "failed", "a", 1), ("r/2", "s3://new", "processing", "b", 2), ("r/9", "s3://no", "failed", "a", 1)],
        "file string, url string, status string, uploader string, seq int",
    )
    after = reg.upsert_urls(registry, changes, order="seq").url
    assert rows(after.filter("file <> 'r/1' OR url LIKE 's3%'"), "file", "url", "status", "uploader") == [
        ("r/1", "s3://bucket/one", "pending", "z"),
        ("r/2", "gsa://a@x.org/HRA1/HRS1/HRX1/HRR1/HRR1_f1.fastq.gz", "pending", "bob"),
        ("r/2", "s3://new", "processing", "b"),
    ]
    assert after.columns == registry.url.columns and after.count() == 4
    assert [r["file"] for r in reg.of_unknown_files(changes, registry.file).collect()] == ["r/9"]
    tags = spark.createDataFrame([("r/1", "project", "Z"), ("r/3", "new", "N")], "file string, field_name string, field_value string")
    assert rows(reg.upsert_tags(registry, tags).tag, "file", "field_name", "field_value") == [
        ("r/1", "project", "Z"), ("r/2", "project", "Q"), ("r/3", "kind", "P"), ("r/3", "new", "N"),
    ]


def test_delete(spark, registry):
    left = reg.delete_files(registry, spark.createDataFrame([("r/1",)], "guid string"))
    assert [getattr(left, t).count() for t in ("file", "url", "hash", "alias", "tag")] == [2, 1, 1, 0, 2]
    keys = spark.createDataFrame([("r/1", "doi://2")], "file string, name string")
    assert [r["name"] for r in reg.delete_children(registry.alias, keys).collect()] == ["doi://1"]
    assert reg.delete_children(registry.url, keys.select("file")).count() == 1


def test_uniqueness(spark, registry, rows):
    assert reg.unique_violations(registry).count() == 0
    broken = reg.replace(registry, tag=registry.tag.union(registry.tag))
    assert {r["rule"] for r in reg.unique_violations(broken).collect()} == {"tag.field_name+file"}


# ------------------------------------------------------------------ flattened files


@pytest.mark.parametrize("by_lines", [False, True])
def test_parse_flat(spark, rows, tmp_path, by_lines):
    path = tmp_path / "files.tsv"
    path.write_text(
        "guid\tfilename\tsize\tupdated_at\tstatus\tversion\tacl\turl_0_url\turl_0_status\turl_1_url\turl_1_created_at\thash_0_hash_type\thash_0_hash\talias_0_name\ttag_0_field_name\ttag_0_field_value\n"
        "r/1\t\"a\" b.txt\t12\t99\tvalidated\t3\tlab\ts3://a/1\tvalidated\ts3://a/2\t5\tmd5\tabc\tname1\tk\tv\n"
        "r/2\tb\tx\t\t\t\t\ts3://b/1\t\t\t\t\t\t\t\t\n"
        "r/3\tc\n"
    )
    tables = tsv.read_flat_registry(spark, str(path), 7) if by_lines else tsv.parse_flat(tsv.read_flat(spark, str(path)), now=7)
    assert rows(tables.file, "guid", "filename", "size", "updated_at", "status", "version", "access", "acl") == [
        ("r/1", '"a" b.txt', 12, 99, "validated", 3, "private", "lab"),
        ("r/2", "b", 0, 7, "", 1, "private", None),
        ("r/3", "c", 0, 7, "", 1, "private", None),
    ]
    assert rows(tables.url, "file", "position", "url", "status", "created_at") == [
        ("r/1", 0, "s3://a/1", "validated", 7), ("r/1", 1, "s3://a/2", "pending", 7), ("r/2", 0, "s3://b/1", "pending", 7),
    ]
    assert rows(tables.hash, "file", "hash_type", "hash") == [("r/1", "md5", "abc")]
    assert rows(tables.alias, "file", "name") == [("r/1", "name1")]
    assert rows(tables.tag, "file", "field_name", "field_value") == [("r/1", "k", "v")]


def test_flat_round_trip(spark, registry, rows, tmp_path):
    tsv.write_flat(registry, str(tmp_path / "flat.tsv"))
    flat = tsv.read_flat(spark, str(tmp_path / "flat.tsv"))
    assert "url_1_uploader" in flat.columns and "url_2_url" not in flat.columns
    for back in (tsv.parse_flat(flat, now=0), tsv.read_flat_registry(spark, str(tmp_path / "flat.tsv"), now=0)):
        for kind in ("url", "hash", "alias", "tag"):
            columns = ["file", *tsv.SUB_COLUMNS[kind]]
            assert rows(getattr(back, kind), *columns) == rows(getattr(registry, kind), *columns)
        columns = ["guid", "filename", "size", "created_at", "updated_at", "status", "baseid", "rev", "version", "uploader", "acl"]
        assert rows(back.file, *columns) == rows(registry.file, *columns)


def test_flat_file_in_shares(spark, registry, rows, tmp_path, monkeypatch):
    """Share by share, packed, the same file comes back; a share leaves no shuffle behind."""
    monkeypatch.setattr(tsv, "MOVED_ROWS", 3)
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    spark.sparkContext._jvm.System.gc()
    before = {int(i) for i in tracker.shuffleStatuses().keys().mkString(",").split(",") if i}
    path = tmp_path / "flat"
    tsv.write_flat(registry, str(path), compression="gzip")
    assert not {int(i) for i in tracker.shuffleStatuses().keys().mkString(",").split(",") if i} - before
    assert {f.suffix for f in path.glob("part-*")} == {".gz"}
    tsv.write_flat(registry, str(tmp_path / "plain"))
    back, plain = tsv.read_flat_registry(spark, str(path), now=0), tsv.read_flat_registry(spark, str(tmp_path / "plain"), now=0)
    for kind in ("file", "url", "hash", "alias", "tag"):
        assert rows(getattr(back, kind)) == rows(getattr(plain, kind))
    assert back.url.count() == registry.url.count() and back.file.count() == registry.file.count()


def test_flat_lines_of_many_children(spark, tmp_path):
    """The plan of a file with 3000 links is as large as that of one with two; cells keep blanks but no tabs."""
    def of(n):
        url = spark.range(n).select(F.lit("g").alias("file"), F.concat(F.lit("s3://b/"), "id").alias("url"), F.lit("pending").alias("status"),
                                    F.lit("").alias("uploader"), F.lit(0).cast("long").alias("created_at"))
        file = spark.createDataFrame([("g", " a\tb ", 1, 2, 3, "", "", "", 1, "", None)], "guid string, filename string, size long, created_at long, "
                                     "updated_at long, status string, baseid string, rev string, version int, uploader string, acl string")
        no = {"hash": "file string, hash_type string, hash string", "alias": "file string, name string",
              "tag": "file string, field_name string, field_value string"}
        return reg.Registry(file=file, url=url, **{k: spark.createDataFrame([], s) for k, s in no.items()})

    sizes = {}
    for n in (2, 3000):
        tsv.write_flat(of(n), str(tmp_path / f"f{n}"))
        back = tsv.read_flat_registry(spark, str(tmp_path / f"f{n}"), 0)
        assert back.url.count() == n and {r.url for r in back.url.collect()} == {f"s3://b/{i}" for i in range(n)}
        assert [tuple(r) for r in back.file.select("guid", "filename", "access", "acl").collect()] == [("g", " a b ", "public", None)]
        sizes[n] = len(tsv.flat_lines(of(n))[1]._jdf.queryExecution().analyzed().toString())
    assert sizes[3000] < sizes[2] + 100


def test_no_children_at_all(spark, registry):
    bare = reg.Registry(file=registry.file, **{k: getattr(registry, k).limit(0) for k in reg.CHILDREN})
    assert tsv.flatten(bare).columns == list(tsv.FILE_COLUMNS)


def test_separators():
    assert [tsv.separator(p) for p in ("a.csv", "b/x.tsv", "y.txt")] == [",", "\t", " "]
    for bad in ("a.json", "plain", "dir.csv/plain"):
        with pytest.raises(ValueError):
            tsv.separator(bad)


def test_registration_files(spark, tmp_path):
    (tmp_path / "in.csv").write_text(f"size,filename,uploader,md5sum\n1,a,u,{md5('a')}\nx,b,u,{md5('b')}\n")
    good, bad = reg.check_registrations(tsv.read_registrations(spark, str(tmp_path / "in.csv")))
    assert [r["filename"] for r in good.collect()] == ["a"] and [r["reason"] for r in bad.collect()] == ["size is not a whole number"]
    (tmp_path / "in.json").write_text('[{"size": 3, "filename": "j", "uploader": "u", "md5sum": "%s", "url": "s3://a/b"}]' % md5("j"))
    good, _ = reg.check_registrations(tsv.read_registrations(spark, str(tmp_path / "in.json")))
    assert [(r["size"], r["url"]) for r in good.collect()] == [(3, "s3://a/b")]


# ------------------------------------------------------------------ scalars


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text", ["", "a", "content of a file", "ünïcode"])
def test_uuid5_equals_the_standard(spark, text):
    assert one(spark, scalars.uuid5(F.lit(text))) == str(uuid.uuid5(uuid.NAMESPACE_URL, text))
    sha1 = hashlib.sha1(text.encode()).hexdigest()
    assert one(spark, scalars.content_guid(F.lit(text), "p")) == f"p/{uuid.uuid5(uuid.NAMESPACE_URL, sha1)}"


def test_fingerprints(spark):
    found = one(spark, scalars.fingerprints(F.lit("abc")))
    assert found.asDict() == {n: getattr(hashlib, n)(b"abc").hexdigest() for n in ("md5", "sha1", "sha256", "sha512")}


@pytest.mark.parametrize(
    ("value", "want"),
    [(3.0, "3"), (-2.0, "-2"), (1.005, "1"), (1.5, "1.5"), (0.125, "0.13"), (-0.125, "-0.13"), (2.675, "2.67"), (1e15, "1000000000000000"), (0.001, "0"), (99.999, "100")],
)
def test_display_number(spark, value, want):
    assert one(spark, scalars.display_number(F.lit(value))) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("a" * 32, "md5"), ("b" * 40, "sha1"), ("0" * 64, "sha256"), ("1" * 128, "sha512"), ("12345678", "crc32"), ("f" * 16, "crc64"), ("a" * 32 + "-12", "etag"), ("A" * 32, None), ("xyz", None), (None, None)],
)
def test_hash_type(spark, text, want):
    assert one(spark, scalars.hash_type(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(
    ("url", "protocol", "identity"),
    [
        ("node://a@b.c/OEP1/OEX2/OES3/OER4/OED5", "node", "OEP1"), ("node://a/OEP1/x", None, "OEP1"), ("s3://bucket/k/e/y", "s3", "bucket"),
        ("oss://b/", "oss", "b"), ("minio://b/x", "minio", "b"), ("gsa://a@b.c/HRA1/HRS2/HRX3/HRR4/HRR5.gz", "gsa", "HRA1"), ("http://x/y", None, ""),
    ],
)
def test_urls(spark, url, protocol, identity):
    assert one(spark, scalars.url_protocol(F.lit(url))) == protocol
    assert one(spark, scalars.url_identity(F.lit(url))) == identity


def test_event_codes(spark):
    df = spark.createDataFrame([("1", 1.0, True), ("1:DEAD", 2.0, False), ("0:ALIVE", 0.0, None), ("x", None, True), (None, 10.0, False)], "s string, n double, b boolean")
    found = df.select(*[scalars.event_code(F.col(c), df.schema[c].dataType).alias(c) for c in df.columns]).collect()
    assert [r["s"] for r in found] == [1, 1, 0, 0, None]
    assert [r["n"] for r in found] == [1, 0, 0, None, 0]
    assert [r["b"] for r in found] == [1, 0, None, 1, 0]


def test_semantic_versions(spark):
    order = ["v0.0.1-alpha", "v0.0.1-alpha.1", "v0.0.1-alpha.beta", "v0.0.1-beta.2", "v0.0.1-beta.11", "v0.0.1-rc.1", "v0.0.1", "v0.0.9", "0.0.10", "v0.2.0", "v1.0.0+build.5", "v10.0.0"]
    df = spark.createDataFrame([(v,) for v in reversed(order)], "v string")
    assert [r["v"] for r in df.orderBy(versions.version_order(F.col("v"))).collect()] == order


def test_versions(spark, rows):
    catalog = spark.createDataFrame([("a", "v0.0.9", 1), ("a", "v0.0.10", 2), ("b", "v1.0.0", 3)], "key string, version string, total int")
    assert rows(versions.latest(catalog)) == [("a", "v0.0.10", 2), ("b", "v1.0.0", 3)]
    asked = spark.createDataFrame([("a", "v0.0.9"), ("a", None), ("b", "v9"), ("c", "v1")], "key string, version string")
    assert rows(versions.resolve(catalog, asked), "key", "requested", "version") == [("a", None, "v0.0.10"), ("a", "v0.0.9", "v0.0.9"), ("b", "v9", "v1.0.0")]


def test_repeated_and_known_digests_keep_their_links(spark, registry):
    again = md5("new file")
    batch = spark.createDataFrame(
        [("1", "b", "u", again, "s3://a/1", "x1"), ("1", "a", "u", again, "s3://a/2", "x2"), ("1", "c", "u", again, "s3://a/2", None)], BATCH)
    once = reg.register(registry, batch, "r", 5)
    guid = once.hash.filter(F.col("hash") == again).first()["file"]
    assert once.file.filter(F.col("guid") == guid).first()["filename"] == "a"
    assert sorted(r["url"] for r in once.url.filter(F.col("file") == guid).collect()) == ["s3://a/1", "s3://a/2"]
    assert sorted(r["name"] for r in once.alias.filter(F.col("file") == guid).collect()) == ["x1", "x2"]
    later = spark.createDataFrame([("1", "z", "u", again, "s3://a/3", "x1"), ("n", "z", "u", again, None, None)], BATCH)
    twice = reg.register(once, later, "r", 6)
    assert twice.file.count() == once.file.count()
    assert twice.url.filter((F.col("file") == guid) & (F.col("url") == "s3://a/3")).count() == 1
    outcome = {r["size"]: (r["guid"], r["ignored"]) for r in reg.registration_outcome(once, later, "r").collect()}
    assert outcome == {"1": (guid, ["known digest", "known alias"]), "n": (None, ["size is not a whole number"])}
