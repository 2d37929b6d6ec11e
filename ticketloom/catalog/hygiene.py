"""Registered queries: sources, text hygiene and profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketloom import constants as K
from ticketloom.catalog import sql as S
from ticketloom.catalog.registry import Family
from ticketloom.functions import text as tx
from ticketloom.operators import hygiene as hy
from ticketloom.operators import profiling as pf
from ticketloom.session import materialise, scratch_dir
from ticketloom.sources import fixtures as fx
from ticketloom.sources import tables as tb

FAMILY = Family()
register = FAMILY.register


def clean_tickets(spark, d, extra=()):
    return hy.clean_tickets(fx.tickets_raw(spark, d), extra=extra)


def solved(spark, d):
    return hy.solved_only(clean_tickets(spark, d))


CLEAN = (
    "ticket_id, ticket_text, product, ticket_type, ticket_subject, ticket_priority, "
    "ticket_status, resolution, is_solved"
)


@register("s1_raw_scan", S.with_ctes(
    "SELECT ticket_id, ticket_description, product_purchased, ticket_type, ticket_subject, "
    "ticket_priority, ticket_status, resolution FROM tickets_raw"))
def s1_raw_scan(spark, d):
    """Raw tickets written as quoted CSV and scanned back."""
    return tb.read_raw_csv(spark, _raw_csv(spark, fx.tickets_raw(spark, d)))


@register("s1_split_scan", S.with_ctes(
    "SELECT ticket_id, ticket_description, product_purchased, ticket_type, ticket_subject, "
    "ticket_priority, ticket_status, resolution FROM tickets_raw"))
def s1_split_scan(spark, d):
    """The same files read by blocks, several tasks a file."""
    return tb.read_raw_csv_blocks(spark, _raw_csv(spark, fx.tickets_raw(spark, d)), block_bytes=1 << 20)


def _raw_csv(spark, tickets):
    path = scratch_dir(spark, "raw-csv")
    raw = tickets.drop("created_at")
    header = {v: k for k, v in tb.RAW_COLUMNS.items()}
    named = raw.select(*[F.col(c).alias(header[c]) for c in raw.columns])
    (named.write.option("header", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path))
    return path


@register("s2_s3_table_round_trip", S.with_ctes(f"SELECT {CLEAN} FROM tickets"))
def s2_s3_table_round_trip(spark, d):
    path = tb.write_table(clean_tickets(spark, d), scratch_dir(spark, "clean"))
    return tb.read_table(spark, path)


@register("s6_report_sink", S.with_ctes(
    "SELECT ticket_priority, count(*) AS row_count, count_if(is_solved) AS solved FROM tickets GROUP BY 1"))
def s6_report_sink(spark, d):
    rep = clean_tickets(spark, d).groupBy("ticket_priority").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if("is_solved").alias("solved"))
    path = tb.write_report(rep, scratch_dir(spark, "report"))
    return spark.read.schema(rep.schema).json(path)


@register("p1_clean_text", S.with_ctes("SELECT ticket_id, ticket_text FROM tickets_all"))
def p1_clean_text(spark, d):
    return hy.to_clean_schema(fx.tickets_raw(spark, d)).select("ticket_id", "ticket_text")


def _step(name, make, sql_expr, base="ticket_description"):
    def run(spark, d):
        return fx.tickets_raw(spark, d).select(
            "ticket_id", make(F.col(base)).alias("ticket_text"))

    register(name, S.with_ctes(f"SELECT ticket_id, {sql_expr} AS ticket_text FROM tickets_raw"))(run)


def _id_codes(x):
    """DuckDB's word border is ASCII; the Unicode one is spelt out, hence two passes."""
    edge = r"[^\p{L}\p{N}_]"
    return S.sub(x, rf"(^|{edge})[A-Z0-9]{{8,15}}($|{edge})", r"\1[ID]\2")


_step("p2_placeholders", lambda c: tx.fill_placeholders(c, F.col("product_purchased")),
      S.fill("ticket_description", "product_purchased"))
_step("p3_email", tx.redact_email, S.email("ticket_description"))
_step("p4_phone", tx.redact_phone, S.phone("ticket_description"))
_step("p5_billing_zip", tx.redact_billing_zip, S.billing_zip("ticket_description"))
_step("p6_handle", lambda c: tx.redact_handle(tx.redact_email(c)), S.handle(S.email("ticket_description")))
_step("p7_newlines", tx.join_lines, S.lines("ticket_description"))
_step("p8_blanks", tx.squeeze, S.squeeze("ticket_description"))
_step("p9_strip", tx.strip, S.strip("ticket_description"))
_step("p10_id_codes", tx.redact_id_code, _id_codes(_id_codes("ticket_description")))


@register("p11_resolution_text", S.with_ctes("SELECT ticket_id, resolution FROM tickets_all"))
def p11_resolution_text(spark, d):
    return fx.tickets_raw(spark, d).select(
        "ticket_id", tx.clean_resolution_text(F.col("resolution")).alias("resolution"))


@register("p12_p13_clean_schema", S.with_ctes(
    f"SELECT {CLEAN} FROM (SELECT *, ticket_status = 'Closed' AND length(resolution) > 0 AS is_solved "
    "FROM tickets_all)"))
def p12_p13_clean_schema(spark, d):
    return hy.to_clean_schema(fx.tickets_raw(spark, d))


@register("p14_drop_blank", S.with_ctes(
    "SELECT ticket_id, length(ticket_text) AS chars FROM tickets_all WHERE length(ticket_text) > 0"))
def p14_drop_blank(spark, d):
    return hy.drop_blank(hy.to_clean_schema(fx.tickets_raw(spark, d))).select(
        "ticket_id", F.length("ticket_text").cast("bigint").alias("chars"))


@register("p15_keep_first", S.with_ctes(f"SELECT {CLEAN} FROM tickets"))
def p15_keep_first(spark, d):
    return clean_tickets(spark, d)


@register("p16_solved", S.with_ctes("SELECT ticket_id, resolution FROM tickets WHERE is_solved"))
def p16_solved(spark, d):
    return solved(spark, d).select("ticket_id", "resolution")


@register("p17_row_gate", S.with_ctes(
    "SELECT count(*) AS row_count, 1000::BIGINT AS minimum, count(*) >= 1000 AS passed "
    "FROM tickets WHERE is_solved"))
def p17_row_gate(spark, d):
    return hy.row_gate(solved(spark, d), 1000)


@register("p18_truncate", S.with_ctes(
    "SELECT ticket_id, " + ", ".join(
        f"substr(ticket_text, 1, {n}) AS first_{n}" for n in (250, 150, 120, 100, 80, 50)
    ) + " FROM tickets"))
def p18_truncate(spark, d):
    return clean_tickets(spark, d).select(
        "ticket_id",
        *[tx.truncate(F.col("ticket_text"), n).alias(f"first_{n}") for n in (250, 150, 120, 100, 80, 50)])


@register("p19_reject_blank", S.with_ctes(
    f"SELECT ticket_id, CASE WHEN length({S.strip('ticket_description')}) = 0 "
    "THEN 'Query cannot be empty.' END AS reason FROM tickets_raw"))
def p19_reject_blank(spark, d):
    good, bad = hy.split_blank(fx.tickets_raw(spark, d), "ticket_description", "Query cannot be empty.")
    return good.select("ticket_id", F.lit(None).cast("string").alias("reason")).unionByName(
        bad.select("ticket_id", "reason"))


@register("p20_default_id", S.with_ctes(
    "SELECT ticket_id, CASE WHEN ticket_id % 3 = 0 THEN 'ticket_' || substr(md5(ticket_text), 1, 8) "
    "ELSE ticket_id::VARCHAR END AS public_id FROM tickets"))
def p20_default_id(spark, d):
    given = F.when(F.col("ticket_id") % 3 == 0, None).otherwise(F.col("ticket_id").cast("string"))
    return clean_tickets(spark, d).select(
        "ticket_id", hy.default_ticket_id(given, F.col("ticket_text")).alias("public_id"))


# Raw classifier answers built from the tickets: well formed, partly filled, out of range,
# null, wrongly typed and broken ones.
_RAW_JSON = """
CASE ticket_id % 8
  WHEN 0 THEN '{"intent": " Other ", "confidence": 1.7, "sentiment": "NEGATIVE", "urgency": "High", "urgency_reason": " late ", "is_high_risk": true}'
  WHEN 1 THEN '{"intent": null, "confidence": 0.25}'
  WHEN 2 THEN '{"intent": "data_loss_recovery", "confidence": null}'
  WHEN 3 THEN '{"is_high_risk": "false", "urgency": "critical"}'
  WHEN 4 THEN 'no json at all'
  WHEN 5 THEN '{"confidence": "0.75", "is_high_risk": 0}'
  WHEN 6 THEN '{"confidence": -3, "intent": "Warranty_Claim"}'
  ELSE '[1, 2]' END"""


# The rules of the parser on DuckDB's own JSON: a missing key has a default, a JSON null is "None"
# or an error, any other value is its text.
def _json_word(key: str, default: str) -> str:
    return (f"CASE json_type(j, '$.{key}') WHEN 'NULL' THEN 'None' ELSE coalesce({S.strip(f"json_extract_string(j, '$.{key}')")}, '{default}') END")


@register("p22_p23_parse_classification", S.with_ctes(f"""
SELECT ticket_id,
       CASE WHEN good THEN lower({_json_word('intent', 'other')}) ELSE 'other' END AS intent,
       CASE WHEN good THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, number)) ELSE 0.5::DOUBLE END AS confidence,
       CASE WHEN good THEN lower({_json_word('sentiment', 'neutral')}) ELSE 'neutral' END AS sentiment,
       CASE WHEN good THEN lower({_json_word('urgency', 'medium')}) ELSE 'high' END AS urgency,
       CASE WHEN good THEN {_json_word('urgency_reason', 'Standard classification')}
            ELSE 'Classification fallback due to error: invalid classification' END AS urgency_reason,
       CASE WHEN NOT good THEN true ELSE coalesce(CASE json_type(j, '$.is_high_risk')
            WHEN 'BOOLEAN' THEN json_extract_string(j, '$.is_high_risk') = 'true'
            WHEN 'VARCHAR' THEN length(json_extract_string(j, '$.is_high_risk')) > 0
            WHEN 'OBJECT' THEN json_extract_string(j, '$.is_high_risk') <> '{{}}'
            WHEN 'ARRAY' THEN json_extract_string(j, '$.is_high_risk') <> '[]'
            WHEN 'NULL' THEN false
            ELSE TRY_CAST(json_extract_string(j, '$.is_high_risk') AS DOUBLE) <> 0 END, false) END AS is_high_risk
FROM (SELECT *, coalesce(json_type(j) = 'OBJECT' AND number IS NOT NULL, false) AS good FROM (
  SELECT *, CASE WHEN json_type(j, '$.confidence') IS NULL THEN 0.8::DOUBLE
                 ELSE TRY_CAST(json_extract_string(j, '$.confidence') AS DOUBLE) END AS number
  FROM (SELECT ticket_id, CASE WHEN json_valid(raw) THEN raw::JSON END AS j FROM (SELECT ticket_id, {_RAW_JSON} AS raw FROM tickets))))"""))
def p22_p23_parse_classification(spark, d):
    raw = clean_tickets(spark, d).select("ticket_id", F.expr(_RAW_JSON).alias("raw"))
    return raw.select("ticket_id", hy.parse_classification(F.col("raw")).alias("c")).select("ticket_id", "c.*")


@register("p24_lookup_by_id", S.with_ctes("""
SELECT l.doc_id AS ticket_id, t.ticket_id IS NOT NULL AS found, t.product
FROM labels l LEFT JOIN tickets t ON t.ticket_id = l.doc_id"""))
def p24_lookup_by_id(spark, d):
    wanted = fx.table(spark, d, "labels").select(F.col("doc_id").alias("ticket_id"))
    found, missing = hy.lookup_by_id(wanted, clean_tickets(spark, d).select("ticket_id", "product"), "ticket_id")
    return found.select("ticket_id", F.lit(True).alias("found"), "product").unionByName(
        missing.select("ticket_id", F.lit(False).alias("found"), F.lit(None).cast("string").alias("product")))


@register("a1_row_counts", S.with_ctes(
    "SELECT (SELECT count(*) FROM tickets_raw) AS raw_rows, count(*) AS unique_rows, "
    "count_if(is_solved) AS solved_rows, count_if(NOT is_solved) AS unsolved_rows FROM tickets"))
def a1_row_counts(spark, d):
    return pf.row_counts(fx.tickets_raw(spark, d), clean_tickets(spark, d))


def _describe_sql(measures: dict[str, str]) -> str:
    return S.with_ctes(" UNION ALL ".join(
        f"SELECT '{n}' AS measure, count(v) AS count, round(avg(v), 6) AS mean, "
        f"round(stddev_samp(v), 6) AS std, min(v) AS min, quantile_cont(v, 0.25) AS p25, "
        f"quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75, max(v) AS max "
        f"FROM (SELECT ({e})::DOUBLE AS v FROM tickets)" for n, e in measures.items()))


def _sql_words(x):
    return rf"len(list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> ''))"


@register("a2_length_profile", _describe_sql({
    "ticket_chars": "length(ticket_text)",
    "resolution_chars": "CASE WHEN is_solved THEN length(resolution) END"}))
def a2_length_profile(spark, d):
    df = clean_tickets(spark, d)
    return pf.describe(df, pf.length_profile(df))


@register("a2_merged_sketches", S.with_ctes("""
SELECT measure, count(v) AS count, count(DISTINCT day) AS days, true AS within FROM (
  SELECT 'ticket_chars' AS measure, length(ticket_text) AS v, created_at::DATE AS day FROM tickets
  UNION ALL SELECT 'resolution_chars', CASE WHEN is_solved THEN length(resolution) END, created_at::DATE FROM tickets)
WHERE v IS NOT NULL GROUP BY measure"""))
def a2_merged_sketches(spark, d):
    """Sketches of single days, merged: the rows they have seen, and whether the rank of each quartile
    among all rows is within a hundredth of what was asked for."""
    df = materialise(clean_tickets(spark, d, extra=("created_at",)).select(
        "ticket_text", "resolution", "is_solved", "created_at"), "dated-texts")
    measures = pf.length_profile(df)
    sketches = materialise(pf.daily_sketches(df, measures, F.to_date("created_at")), "daily-sketches")
    found = pf.merged_quantiles(sketches).join(
        sketches.groupBy("measure").agg(F.count_distinct("day").alias("days")), "measure")
    lengths = df.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("measure"), v.cast("bigint").alias("v")) for n, v in measures.items()])).alias("m")).select("m.*")
    met = lengths.where("v IS NOT NULL").join(F.broadcast(found), "measure")  # a row per measure
    shares = (0.25, 0.5, 0.75)
    # A value that many rows share covers a range of ranks: the share must lie in it.
    below = [F.avg((F.col("v") < F.col("quantiles")[i]).cast("double")) <= s + 0.01 for i, s in enumerate(shares)]
    upto = [F.avg((F.col("v") <= F.col("quantiles")[i]).cast("double")) >= s - 0.01 for i, s in enumerate(shares)]
    within = below[0] & below[1] & below[2] & upto[0] & upto[1] & upto[2]
    return met.groupBy("measure", "count", "days").agg(within.alias("within"))


@register("a3_word_profile", _describe_sql({
    "ticket_words": _sql_words("ticket_text"),
    "resolution_words": f"CASE WHEN is_solved THEN {_sql_words('resolution')} END"}))
def a3_word_profile(spark, d):
    df = clean_tickets(spark, d)
    return pf.describe(df, pf.word_profile(df))


def distribution_sql(table: str, column: str) -> str:
    return S.with_ctes(
        f"SELECT {column}, count(*) AS row_count, "
        f"round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 4) AS share_pct FROM {table} GROUP BY {column}")


@register("a8_priority_audit", distribution_sql("tickets_raw", "ticket_priority"))
def a8_priority_audit(spark, d):
    return pf.distribution(fx.tickets_raw(spark, d), "ticket_priority")


@register("a7_quality_report", S.with_ctes("""
SELECT 'null:ticket_text' AS rule, count_if(ticket_text IS NULL) AS violations, count_if(ticket_text IS NULL) = 0 AS passed FROM tickets
UNION ALL SELECT 'rule:raw_has_resolution', count_if(resolution IS NULL OR resolution = ''), count_if(resolution IS NULL OR resolution = '') = 0 FROM tickets
UNION ALL SELECT 'unique:ticket_id', count(*) - count(DISTINCT ticket_id), count(*) = count(DISTINCT ticket_id) FROM tickets
UNION ALL SELECT 'unique:product', count(*) - count(DISTINCT product), count(*) = count(DISTINCT product) FROM tickets
UNION ALL SELECT 'columns', 0, true"""))
def a7_quality_report(spark, d):
    df = clean_tickets(spark, d)
    return pf.quality_report(
        df, not_null=("ticket_text",), unique=("ticket_id", "product"),
        required=tuple(c.strip() for c in CLEAN.split(",")),
        rules={"raw_has_resolution": F.length("resolution") > 0})
