import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ticketloom.operators import hygiene as hy
from ticketloom.operators import labelling as lb
from ticketloom.operators import profiling as pf
from ticketloom.sources import tables as tb

RAW = ("ticket_id bigint, ticket_description string, product_purchased string, ticket_type string, "
       "ticket_subject string, ticket_priority string, ticket_status string, resolution string")


def raw(spark):
    return spark.createDataFrame([
        (3, "same text", "TV", "t", "s", "High", "Closed", "done"),
        (1, "same  text", "TV", "t", "s", "Low", " Open ", "ignored"),
        (2, "  \n", "TV", "t", "s", "Low", "Closed", "done"),
        (4, "other", None, None, "s", None, "Closed", " \n "),
        (5, "third", "TV", "t", "s", "Low", "Closed", "fix\n\nit"),
    ], RAW)


def test_clean_tickets_keeps_the_first_of_equal_texts(spark):
    rows = {r["ticket_id"]: r for r in hy.clean_tickets(raw(spark)).collect()}
    assert set(rows) == {1, 4, 5}
    assert rows[1]["ticket_status"] == "Open" and rows[1]["is_solved"] is False
    assert rows[4]["product"] == "" and rows[4]["is_solved"] is False
    assert rows[5]["is_solved"] is True and rows[5]["resolution"] == "fix it"


def test_dedupe_is_cut_below_the_shuffle(spark):
    plan = hy.clean_tickets(raw(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


def test_hot_text_survives_once(spark):
    many = spark.range(3000).select(
        F.col("id").alias("ticket_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("ticket_text"))
    out = hy.keep_first(many)
    assert out.count() == 2001
    assert out.where("ticket_text = 'hot'").first()["ticket_id"] == 0


def test_row_gate(spark):
    df = spark.range(5)
    assert hy.require_min_rows(df, 5).count() == 5
    with pytest.raises(PySparkException):
        hy.require_min_rows(df, 6).count()
    assert hy.row_gate(df, 6).first()["passed"] is False


def test_default_ticket_id(spark):
    df = spark.createDataFrame([("a", "q"), (None, "q"), ("", "q")], "t string, q string")
    got = [r[0] for r in df.select(hy.default_ticket_id(F.col("t"), F.col("q"))).collect()]
    assert got == ["a", "ticket_7694f4a6", "ticket_7694f4a6"]


def test_csv_scan(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        'Ticket ID,Ticket Description,Product Purchased,Ticket Type,Ticket Subject,Ticket Priority,Ticket Status,Resolution\n'
        '1,"two\nlines, ""quoted""",TV,a,b,Low,Open,\n'
        'x,plain,TV,a,b,Low,Closed,done\n')
    rows = tb.read_raw_csv(spark, str(tmp_path / "t.csv")).collect()
    assert rows[0]["ticket_id"] == 1 and rows[0]["ticket_description"] == 'two\nlines, "quoted"'
    assert rows[0]["resolution"] is None and rows[1]["ticket_id"] is None


def test_taxonomy_sources(spark, tmp_path):
    missing = str(tmp_path / "none.json")
    assert tb.taxonomy_or_message(spark, missing, missing).first()["message"] == "Taxonomy not generated yet."
    path = tmp_path / "p.json"
    path.write_text('{"merged_intents": [{"name": "a", "source_cluster_ids": [1, 2], "risk_level": "low"}]}')
    row = tb.taxonomy_or_message(spark, missing, str(path)).first()
    assert row["name"] == "a" and row["source_cluster_ids"] == [1, 2] and row["message"] is None


def test_describe_and_distribution(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 4)], "v int")
    row = pf.describe(df, {"v": F.col("v")}).first()
    assert (row["count"], row["mean"], row["p25"], row["p50"], row["p75"]) == (4, 2.5, 1.75, 2.5, 3.25)
    assert row["std"] == pytest.approx(1.290994)
    dist = pf.distribution(spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "x string"), "x").collect()
    assert [(r["x"], r["share_pct"]) for r in dist] == [("c", 50.0), ("a", 25.0), ("b", 25.0)]


def test_quality_report(spark):
    df = spark.createDataFrame([(1, "a"), (1, None)], "id int, t string")
    rep = {r["rule"]: (r["violations"], r["passed"]) for r in pf.quality_report(
        df, not_null=("t",), unique=("id",), required=("id", "nope"), rules={"pos": F.col("id") > 0}).collect()}
    assert rep == {"null:t": (1, False), "unique:id": (1, False), "columns": (1, False), "rule:pos": (0, True)}


def test_ordinal_is_global_and_gap_free(spark):
    ids = [7, -5, 10**12, 3, 8, 9, 10**12 + 1, 4]
    df = spark.createDataFrame([(i,) for i in ids], "k bigint")
    got = {r["k"]: r["position"] for r in lb.ordinal(df, "k", rows_per_task=2).collect()}
    assert got == {k: n for n, k in enumerate(sorted(ids))}


def test_csv_read_by_blocks_equals_the_whole_reader(spark, tmp_path):
    from ticketloom.sources import tables as tb

    names = list(tb.RAW_COLUMNS)
    values = ['plain', 'two\nlines', 'say ""hi""', 'a,b\r\nc', '""', 'x\n\n""y""\nz', "", 'line one\n"" tail']
    for n in range(3):
        rows = [",".join(f'"{v}"' for v in names)]
        for i in range(80):
            fields = [str(i + 1000 * n)] + [f'"{values[(i * 7 + j * 3 + n) % len(values)]}"' for j in range(1, len(names))]
            rows.append(",".join(fields))
        (tmp_path / f"part{n}.csv").write_bytes(("\n".join(rows) + "\n").encode())
    want = tb.read_raw_csv(spark, str(tmp_path)).collect()
    for size in (300, 5000, 1 << 20):
        got = tb.read_raw_csv_blocks(spark, str(tmp_path), size)
        assert sorted(map(str, got.collect())) == sorted(map(str, want)) and len(want) == 240


def test_stages_are_counted_as_they_are_written(spark):
    from ticketloom.operators import profiling as pf

    stored, n = pf.counted(spark.range(17).where("id < 9"), "some")
    none, zero = pf.counted(stored.where("id > 100"), "none")
    assert (n, stored.count(), zero, none.count()) == (9, 9, 0, 0)
    assert [tuple(r) for r in pf.funnel_of(spark, [("a", 9), ("b", 0)]).collect()] == [(1, "a", 9), (2, "b", 0)]


def test_daily_sketches_merge_to_the_whole(spark):
    from pyspark.sql import functions as F

    from ticketloom.operators import profiling as pf

    df = spark.range(30_000).select((F.col("id") * 7919 % 30_000).alias("v"), (F.col("id") % 9).alias("day"))
    days = pf.daily_sketches(df, {"v": F.col("v"), "w": F.when(F.col("v") < 100, F.lit(5))}, F.col("day"))
    got = {r["measure"]: r for r in pf.merged_quantiles(days).collect()}
    assert got["v"]["count"] == 30_000 and all(abs(q / 30_000 - s) < 0.01 for q, s in zip(got["v"]["quantiles"], (0.25, 0.5, 0.75)))
    assert (got["w"]["count"], list(got["w"]["quantiles"])) == (100, [5, 5, 5]) and days.count() > 9
