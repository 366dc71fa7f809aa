"""The registry as a store of commits: co-located plans, versions, repeated and killed batches, conflicts."""

import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from cohortspark.operators import registry as reg
from cohortspark.sources import registry_store as rs
from cohortspark.sources import registry_tsv

N = 120


@pytest.fixture(scope="module")
def tables(spark):
    def rows(kind, values):
        return spark.createDataFrame(values, rs.COLUMNS[kind])

    return reg.Registry(
        file=rows("file", [(f"r/{i}", f"f{i}.dat", i, 0, i, "pending", f"b{i % 7}", "a", 1, "ann", None) for i in range(N)]),
        url=rows("url", [(i, f"s3://b/{i}", 5, "pending", "ann", f"r/{i % 40}") for i in range(N)]),
        hash=rows("hash", [(i, f"{i:032x}", "md5", f"r/{i}") for i in range(N)]),
        alias=rows("alias", [(i, f"doi://{i}", f"r/{i}") for i in range(0, N, 2)]),
        tag=rows("tag", [(i, f"k{i % 3}", f"v{i}", f"r/{i // 3}") for i in range(N)]),
    )


@pytest.fixture
def store(spark, tables, tmp_path):
    return rs.create(spark, str(tmp_path / "store"), tables, buckets=4)


def content(registry):
    return {kind: sorted(map(tuple, getattr(registry, kind).select(*rs._names(kind)).collect()), key=str) for kind in rs.KINDS}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def test_reads_back(store, tables):
    assert content(store.read()) == content(tables)


def test_children_and_flattening_move_no_table(store, no_broadcast):
    found = store.read()
    children = reg.with_children(found.file, found)
    assert "Bucketed: true" in plan(children) and "Exchange" not in plan(children)
    assert "Exchange" not in plan(registry_tsv.flatten(found))


def test_large_store_in_shares(spark, tables, tmp_path, monkeypatch):
    """Buckets grow with the rows, a table moves share by share, and stored files are packed tightly."""
    monkeypatch.setattr(rs, "BUCKET_ROWS", 20)
    monkeypatch.setattr(rs, "MOVED_ROWS", 50)
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    rows = sum(getattr(tables, kind).count() for kind in rs.KINDS)
    made = rs.create(spark, str(tmp_path / "store"), tables)
    assert made.state().buckets == -(-rows // 20) > rs.BUCKETS
    assert content(made.read()) == content(tables)
    files = [f.name for f in (tmp_path / "store" / "url").rglob("*.parquet")]
    assert files and all(f.endswith(".zstd.parquet") for f in files) and len(files) <= made.state().buckets
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before
    flat = registry_tsv.flatten(made.read())
    assert flat.count() == N and flat.where("url_2_url IS NOT NULL").count() == 40


def url_batch(spark, status="validated"):
    return spark.createDataFrame(
        [("s3://b/1", "r/1", status, "x"), ("s3://new/1", "r/2", "lost", "y"), ("s3://no/1", "r/none", "failed", "z")],
        "url string, file string, status string, uploader string")


def test_changes_equal_those_of_plain_tables(spark, store, tables, no_broadcast):
    batch = url_batch(spark)
    assert store.apply(lambda t: rs.url_rows(t, batch)) == 2
    found = store.read()
    assert "Exchange" not in plan(found.url) and "Bucketed: true" in plan(found.url)
    assert content(found) == content(reg.upsert_urls(tables, batch))
    tags = spark.createDataFrame([("r/1", "k1", "late", 2), ("r/1", "k1", "early", 1), ("r/5", "fresh", "f", 1), ("r/none", "k", "v", 1)],
                                 "file string, field_name string, field_value string, at int")
    store.apply(lambda t: rs.tag_rows(t, tags, "at"))
    found = store.read()
    assert "Exchange" not in plan(found.tag)
    assert content(found) == content(reg.upsert_tags(reg.upsert_urls(tables, batch), tags, "at"))
    gone = spark.createDataFrame([("r/1",), ("r/7",), ("r/none",)], "guid string")
    store.apply(lambda t: rs.deleted_files(t, gone))
    want = content(reg.delete_files(reg.upsert_tags(reg.upsert_urls(tables, batch), tags, "at"), gone))
    assert content(store.read()) == want
    version = store.state().version
    store.compact()
    assert content(store.read()) == want and content(store.read(version)) == want
    assert all(len(tokens) == 1 for tokens in store.state().tokens.values())
    assert content(store.read(1)) == content(tables)


def test_a_deleted_link_that_comes_back_is_new(spark, store):
    batch = url_batch(spark)
    key = batch.where("url = 's3://b/1'").select("url", "file")
    store.apply(lambda t: rs.deleted_children(t, "url", key))
    assert store.read().url.where("url = 's3://b/1'").count() == 0
    store.apply(lambda t: rs.url_rows(t, batch))
    row = store.read().url.where("url = 's3://b/1'").first()
    assert (row.id, row.created_at, row.status, row.uploader) == (None, None, "validated", "x")


def test_one_commit_of_several_changes(spark, store):
    """The later change of one commit counts."""
    batch = url_batch(spark)
    key = batch.select("url", "file")
    store.apply(lambda t: rs.together(rs.url_rows(t, batch), rs.deleted_children(t, "url", key)))
    left = {r.url for r in store.read().url.collect()}
    assert "s3://b/1" not in left and "s3://b/2" in left


def test_repeated_batch_changes_nothing(spark, store):
    assert store.apply(lambda t: rs.url_rows(t, url_batch(spark)), "links", 3) == 2
    before = content(store.read())
    assert store.apply(lambda t: pytest.fail("computed again"), "links", 3) == 0
    assert store.commit(rs.url_rows(store.read(), url_batch(spark, "failed")), "links", 2) == 0
    assert content(store.read()) == before and store.state().version == 2
    assert store.apply(lambda t: rs.url_rows(t, url_batch(spark, "failed")), "links", 4) == 3


def test_killed_attempt_is_not_seen(spark, store, monkeypatch):
    before = content(store.read())
    monkeypatch.setattr(rs.Store, "_publish", lambda self, state: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        store.apply(lambda t: rs.url_rows(t, url_batch(spark)))
    monkeypatch.undo()
    assert content(store.read()) == before and content(rs.Store(spark, store.root).read()) == before
    store.apply(lambda t: rs.url_rows(t, url_batch(spark)))
    assert store.read().url.where("url = 's3://new/1'").count() == 1


def test_two_writers_cannot_publish_one_version(store):
    state = store.state()
    with pytest.raises(rs.CommitConflict):
        store._publish(state)
    assert store.state() == state
    with pytest.raises(ValueError):
        rs.create(store.spark, store.root, store.read())


def test_stream_equals_one_batch(spark, store, tmp_path):
    rng = random.Random(1)
    columns = "size string, filename string, uploader string, md5sum string, url string, alias string"
    rows = [(str(i), f"g{i:03}", "u", f"{1000 + i:032x}", f"s3://q/{i}", f"doi://q{i}" if i % 4 else None) for i in range(90)]
    rows += [("x", "bad", "u", "no digest", None, None), ("5", "known", "u", f"{7:032x}", "s3://q/known", None)]
    rng.shuffle(rows)
    folder = str(tmp_path / "in")
    for part in range(3):
        spark.createDataFrame(rows[part::3], columns).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).parquet(folder)
    checkpoint, seen = str(tmp_path / "checkpoint"), []

    def dies(batch, number):
        store.apply(lambda t: rs.registration_rows(t, batch, "p", 9), "orders", number)
        seen.append(number)
        if number == 1:
            raise InterruptedError

    query = stream.writeStream.foreachBatch(dies).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    with pytest.raises(StreamingQueryException):
        query.awaitTermination()
    store.follow(stream, lambda t, batch: rs.registration_rows(t, batch, "p", 9), "orders", checkpoint).awaitTermination()
    assert seen == [0, 1] and store.state().batches == {"orders": 2} and store.state().version == 4
    once = reg.register(store.read(1), spark.createDataFrame(rows, columns), "p", 9)
    assert content(store.read()) == content(once)
    assert store.read().file.count() == N + 90


def test_another_session_reads_the_same(spark, store):
    store.apply(lambda t: rs.url_rows(t, url_batch(spark)))
    other = rs.Store(spark.newSession(), store.root)
    for kind in rs.KINDS:
        spark.sql(f"DROP TABLE {store._table(kind, store.state())}")  # as where the catalogue does not know it yet
    assert content(other.read()) == content(store.read()) and other.read().url.where(F.col("url") == "s3://new/1").count() == 1
