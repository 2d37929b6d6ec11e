import contextlib
import io
import re
import uuid

import pytest
from pyspark.sql import functions as F

from ticketloom.operators import index as ix
from ticketloom.session import scratch_dir
from ticketloom.sources.bucketed_index import BucketedIndex
from ticketloom.sources.logs import IndexLog

BUCKETS = 16


def rows(spark, keys, seq=0, text="first"):
    df = spark.createDataFrame([(f"k{k}", text, seq) for k in keys], "case_key string, resolution string, seq bigint")
    rest = {c: F.lit("x") for c in ix.INDEX_COLUMNS if c not in ("case_key", "resolution", "embedding", "timestamp")}
    return df.withColumns({
        **rest, "timestamp": F.lit("2024-01-01").cast("timestamp"), "embedding": F.array(F.lit(1.0), F.lit(0.0))})


def make(spark, df):
    return BucketedIndex.create(df, f"cases_{uuid.uuid4().hex}", scratch_dir(spark, "bucketed"), BUCKETS)


def found(df):
    return sorted((r["case_key"], r["resolution"]) for r in df.select("case_key", "resolution").collect())


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_upserts_equal_the_plain_ones(spark):
    first, second = rows(spark, range(200)), rows(spark, range(150, 260), 2, "second")
    again = rows(spark, [7, 7, 155], 1, "older").unionByName(rows(spark, [7], 5, "latest"))
    index = make(spark, first)
    plain = ix.upsert(None, first)
    for batch in (second, again, again):
        index.upsert(batch)
        plain = ix.upsert(plain, batch)
        assert found(index.table()) == found(plain)
    assert ("k7", "latest") in found(index.table())


def test_only_touched_buckets_are_rewritten(spark):
    index = make(spark, rows(spark, range(300)))
    before = {(r[0], r[1]) for r in spark.table(index.name).select("bucket", F.input_file_name()).distinct().collect()}
    touched = index.upsert(rows(spark, [3], 1, "second"))
    after = {(r[0], r[1]) for r in spark.table(index.name).select("bucket", F.input_file_name()).distinct().collect()}
    assert len(touched) == 1 and len(before) == len(after) == BUCKETS
    assert {b for b, _ in before - after} == {b for b, _ in after - before} == set(touched)


def test_index_side_is_not_shuffled(spark, no_broadcast):
    index = make(spark, rows(spark, range(300)))
    new = rows(spark, range(290, 310)).drop("seq")
    assert len(re.findall(r"Exchange hashpartitioning", plan(index.missing(new)))) == 1
    assert len(re.findall(r"Exchange hashpartitioning", plan(index.merged(new, [1, 2])))) == 1
    assert found(index.missing(new)) == [(f"k{k}", "first") for k in range(300, 310)]


def test_buckets_are_those_of_spark(spark):
    index = make(spark, rows(spark, range(300)))
    files = spark.table(index.name).select("bucket", F.regexp_extract(F.input_file_name(), r"_(\d+)\.c000", 1).cast("int").alias("own"))
    assert files.where("bucket <> own").count() == 0


def test_empty_index_and_empty_write(spark):
    index = make(spark, rows(spark, [1]).limit(0))
    assert found(index.table()) == [] and index.upsert(rows(spark, [1]).limit(0)) == []
    assert found(index.missing(rows(spark, [1, 2]))) == [("k1", "first"), ("k2", "first")]
    index.upsert(rows(spark, [1, 2]))
    assert found(index.table()) == [("k1", "first"), ("k2", "first")]


def test_a_log_over_a_bucketed_base_leaves_it_in_place(spark, no_broadcast):
    index = make(spark, rows(spark, range(50)))
    log = IndexLog(index.table(), scratch_dir(spark, "log"))
    log.add(rows(spark, [3, 60], 4, "second"), 0)
    assert plan(log.current()).count("Bucketed: true") == 2
    assert found(log.current()) == sorted(
        [(f"k{k}", "first") for k in range(50) if k != 3] + [("k3", "second"), ("k60", "second")])


def test_other_tables_are_refused(spark):
    spark.range(1).createOrReplaceTempView("plain_view")
    with pytest.raises(ValueError):
        BucketedIndex(spark, "plain_view")
