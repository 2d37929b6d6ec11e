"""Registered queries: embedding, clustering, taxonomy and labels."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ticketloom import constants as K
from ticketloom.catalog import sql as S
from ticketloom.catalog.hygiene import clean_tickets, distribution_sql
from ticketloom.catalog.registry import Family
from ticketloom.config import TriageConfig
from ticketloom.functions import vectors as vx
from ticketloom.operators import clustering as cl
from ticketloom.operators import hygiene as hy
from ticketloom.operators import labelling as lb
from ticketloom.operators import profiling as pf
from ticketloom.operators import search as se
from ticketloom.session import materialise, scratch_dir
from ticketloom.sources import fixtures as fx
from ticketloom.sources import tables as tb

FAMILY = Family()
register = FAMILY.register
CFG = TriageConfig()

# Two clusters more than the taxonomy knows, so that some tickets stay ``other``.
N_CLUSTERS = 26


def centroids(spark, d):
    return se.centroid_vectors(fx.seed_clusters(spark, d, N_CLUSTERS), "cluster_id", "embedding")


def stored_tickets(spark, d):
    return materialise(clean_tickets(spark, d), "tickets")


def clustered(spark, d):
    v = fx.ticket_vectors(spark, d).select("ticket_id", "embedding")
    return cl.assign_nearest(clean_tickets(spark, d).join(v, "ticket_id"), centroids(spark, d))


def stored_clusters(spark, d):
    """Clustered tickets as a written table, for reports that read them several times."""
    return materialise(clustered(spark, d), "clustered")


def labelled(spark, d):
    return lb.label_by_cluster(clustered(spark, d), fx.taxonomy(spark), centroids(spark, d))


S.CTES["seed_centroids"] = f"""
SELECT cluster_id, list(m ORDER BY i) AS centroid FROM (
  SELECT vec_id % {N_CLUSTERS} AS cluster_id, i, avg(embedding[i]::DOUBLE) AS m
  FROM embeddings, range(1, 65) r(i) GROUP BY ALL) GROUP BY cluster_id"""
S.CTES["clustered"] = """
SELECT t.*, v.embedding, n.cluster_id, n.centroid FROM tickets t JOIN vectors v USING (ticket_id)
JOIN (SELECT ticket_id, arg_min(cluster_id, list_distance(embedding, centroid)) AS cluster_id
      FROM vectors CROSS JOIN seed_centroids GROUP BY ticket_id) a USING (ticket_id)
JOIN seed_centroids n ON n.cluster_id = a.cluster_id"""
S.CTES["cluster_intents"] = "SELECT unnest(source_cluster_ids) AS cluster_id, name AS intent FROM taxonomy"
_refund = S.any_of("lower(ticket_text)", K.REFUND_TERMS)
_cancel = S.any_of("lower(ticket_text)", K.CANCEL_TERMS)
S.CTES["labelled"] = f"""
SELECT c.*, CASE WHEN {_refund} THEN '{K.REFUND_INTENT}' WHEN {_cancel} THEN '{K.CANCEL_INTENT}'
            ELSE coalesce(m.intent, 'other') END AS assigned_intent,
       round(CASE WHEN {_refund} THEN 0.92::DOUBLE WHEN {_cancel} THEN 0.90::DOUBLE
             ELSE least(0.98::DOUBLE, greatest(0.5::DOUBLE, 0.5 + 0.5 * list_dot_product(embedding, centroid))) END, 3) AS intent_confidence
FROM clustered c LEFT JOIN cluster_intents m USING (cluster_id)"""


@register("c1_embed_text", S.with_ctes(r"""
SELECT ticket_id, 384::BIGINT AS dims, CASE WHEN regexp_matches(ticket_text, '[\p{L}\p{N}]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS length
FROM tickets"""))
def c1_embed_text(spark, d):
    """Hashed tf-idf vectors of all tickets: size and length of each."""
    out = cl.embed_text(stored_tickets(spark, d).select("ticket_id", "ticket_text"), dims=384)
    return out.select("ticket_id", F.size("embedding").cast("bigint").alias("dims"),
                      F.round(vx.norm(F.col("embedding")), 4).alias("length"))


@register("c2_normalise", """
SELECT vec_id, round(v[1] / n, 6) + 0.0 AS first, round(v[64] / n, 6) + 0.0 AS last,
       round(sqrt(list_sum(list_transform(v, lambda x: (x / n) * (x / n)))), 6) AS length
FROM (SELECT vec_id, v, greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-12) AS n
      FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (vec_id % 5)) AS v FROM embeddings))""")
def c2_normalise(spark, d):
    scaled = fx.table(spark, d, "embeddings").withColumn(
        "v", F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 5)))
    unit = scaled.withColumn("u", vx.l2_normalise(F.col("v")))
    return unit.select("vec_id", F.round(F.col("u")[0], 6).alias("first"), F.round(F.col("u")[63], 6).alias("last"),
                       F.round(vx.norm(F.col("u")), 6).alias("length"))


@register("c3_kmeans", S.with_ctes("SELECT count(*) AS assigned, 10::BIGINT AS clusters, 0::BIGINT AS not_nearest FROM vectors"))
def c3_kmeans(spark, d):
    """Best of five seeds: rows assigned, clusters, and rows that another centre is nearer to."""
    features = materialise(
        cl.with_features(fx.ticket_vectors(spark, d)).select("ticket_id", "features"), "features")
    model = cl.fit_kmeans(features, 10)
    out = cl.assign(features.withColumn("v", vector_to_array("features")), model)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    far = F.transform(centres, lambda c: vx.euclidean(F.col("v"), c))
    missed = F.get(far, F.col("cluster_id")) > F.array_min(far) + 1e-9
    return out.agg(
        F.count(F.lit(1)).alias("assigned"), F.count_distinct("cluster_id").alias("clusters"),
        F.count_if(missed).alias("not_nearest"))


@register("c3_fixed_centroids", S.with_ctes("SELECT ticket_id, cluster_id FROM clustered"))
def c3_fixed_centroids(spark, d):
    return clustered(spark, d).select("ticket_id", F.col("cluster_id").cast("bigint").alias("cluster_id"))


def _silhouette_sql(distance: str, rows: str = "vectors") -> str:
    return S.with_ctes(f"""
SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 5) AS silhouette FROM (
  SELECT id, max(CASE WHEN own AND n > 1 THEN total / (n - 1) END) AS a, min(CASE WHEN NOT own THEN total / n END) AS b
  FROM (SELECT x.ticket_id AS id, x.label = y.label AS own, y.label, count(*) AS n, sum({distance}) AS total
        FROM {rows} x CROSS JOIN {rows} y GROUP BY ALL) GROUP BY id)""")


@register("c4_silhouette_cosine", _silhouette_sql(
    "CASE WHEN x.ticket_id = y.ticket_id THEN 0 ELSE 1 - list_cosine_similarity(x.embedding, y.embedding) END"))
def c4_silhouette_cosine(spark, d):
    out = cl.silhouette_cosine(fx.ticket_vectors(spark, d), "label")
    return out.select(F.round("silhouette", 5).alias("silhouette"))


@register("c4_silhouette_euclidean", _silhouette_sql(
    "CASE WHEN x.ticket_id = y.ticket_id THEN 0 ELSE list_distance(x.embedding, y.embedding) ^ 2 END"))
def c4_silhouette_euclidean(spark, d):
    out = cl.silhouette_euclidean(fx.ticket_vectors(spark, d), "label")
    return out.select(F.round("silhouette", 5).alias("silhouette"))


@register("c5_sweep_k", "SELECT unnest([12, 16, 20, 24]) AS k, true AS in_range, true AS one_best_and_highest FROM (SELECT count(*) FROM documents)")
def c5_sweep_k(spark, d):
    """Four candidates; scores are silhouettes, and the first of the highest is the one best."""
    out = cl.sweep_k(fx.ticket_vectors(spark, d))
    everything = Window.partitionBy()
    top = out.withColumn("top", F.max("silhouette").over(everything))
    lead = top.withColumn("lead", F.min(F.when(F.col("silhouette") == F.col("top"), F.col("k"))).over(everything))
    return lead.select(
        "k", F.col("silhouette").between(-1.0, 1.0).alias("in_range"),
        (F.col("is_best") == (F.col("k") == F.col("lead"))).alias("one_best_and_highest"))


S.CTES["nearest_rows"] = """
SELECT ticket_id, cluster_id, ticket_text,
       row_number() OVER (PARTITION BY cluster_id ORDER BY round(list_distance(embedding, centroid), 12), ticket_id) AS position
FROM clustered"""


@register("c6_nearest_rows", S.with_ctes("SELECT ticket_id, cluster_id, position FROM nearest_rows WHERE position <= 10"))
def c6_nearest_rows(spark, d):
    out = cl.nearest_rows(clustered(spark, d), centroids(spark, d), "ticket_id", 10)
    return out.select("ticket_id", F.col("cluster_id").cast("bigint").alias("cluster_id"), "position")


@register("c7_cluster_sample", S.with_ctes("""
SELECT ticket_id, cluster_id, position, 'near' AS kind FROM nearest_rows WHERE position <= 10
UNION ALL SELECT * FROM (
  SELECT ticket_id, cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY md5(ticket_id || '/42'), ticket_id) AS position, 'random' AS kind
  FROM nearest_rows WHERE position > 10) WHERE position <= 10"""))
def c7_cluster_sample(spark, d):
    out = cl.cluster_sample(stored_clusters(spark, d).select("ticket_id", "cluster_id", "embedding"), centroids(spark, d), "ticket_id")
    return out.select("ticket_id", F.col("cluster_id").cast("bigint").alias("cluster_id"), "position", "kind")


S.CTES["term_hits"] = "SELECT cluster_id, ticket_id, unnest(regexp_extract_all(lower(ticket_text), '[a-z]{4,}')) AS term FROM clustered"
S.CTES["term_scores"] = """
SELECT cluster_id, term, round(tf * ln(((SELECT count(*) FROM clustered) + 1) / (df + 1)), 6) AS weight
FROM (SELECT cluster_id, term, count(*) AS tf FROM term_hits GROUP BY ALL)
JOIN (SELECT term, count(DISTINCT ticket_id) AS df FROM term_hits GROUP BY term) USING (term)"""
S.CTES["top_words"] = """
SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY weight DESC, term) AS position, term, weight
FROM term_scores"""


@register("c11_top_terms", S.with_ctes("SELECT cluster_id, position, term, weight FROM top_words WHERE position <= 10"))
def c11_top_terms(spark, d):
    out = cl.top_terms(stored_clusters(spark, d).select("cluster_id", "ticket_text"))
    return out.withColumn("cluster_id", F.col("cluster_id").cast("bigint"))


@register("c8_cluster_summary", S.with_ctes(f"""
SELECT s.*, w.name, e.examples, CASE WHEN risk_share >= 0.2 THEN 'high' ELSE 'low' END AS risk_level
FROM (SELECT cluster_id, count(*) AS cluster_size,
             round(avg({S.any_of('lower(ticket_text)', cl.RISK_TERMS)}::INT::DOUBLE), 4) AS risk_share
      FROM clustered GROUP BY cluster_id) s
JOIN (SELECT cluster_id, string_agg(term, '_' ORDER BY position) AS name FROM top_words WHERE position <= 3 GROUP BY 1) w USING (cluster_id)
JOIN (SELECT cluster_id, string_agg(ticket_text, ' || ' ORDER BY position) AS examples FROM nearest_rows WHERE position <= 3 GROUP BY 1) e USING (cluster_id)"""))
def c8_cluster_summary(spark, d):
    df = stored_clusters(spark, d).select("ticket_id", "ticket_text", "cluster_id", "embedding")
    out = cl.summarise(df, centroids(spark, d))
    return out.select(F.col("cluster_id").cast("bigint").alias("cluster_id"), "cluster_size", "risk_share", "name",
                      F.array_join("example_queries", " || ").alias("examples"), "risk_level")


@register("c9_merge_clusters", S.with_ctes(
    "SELECT ticket_id, coalesce(m.intent, 'other') AS intent FROM clustered LEFT JOIN cluster_intents m USING (cluster_id)"))
def c9_merge_clusters(spark, d):
    return lb.intent_of_cluster(clustered(spark, d), fx.taxonomy(spark)).select("ticket_id", "intent")


_CLOSE = 0.25
S.CTES["centroid_links"] = f"""
SELECT a.cluster_id AS a, b.cluster_id AS b FROM seed_centroids a JOIN seed_centroids b ON a.cluster_id <> b.cluster_id
WHERE round(list_cosine_similarity(a.centroid, b.centroid), 12) >= {_CLOSE}"""
S.CTES["centroid_reach"] = """
SELECT cluster_id AS a, cluster_id AS b FROM seed_centroids
UNION /* recursive step */
SELECT r.a, l.b FROM centroid_reach r JOIN centroid_links l ON l.a = r.b"""


@register("c9_auto_plan", S.with_ctes("""
SELECT 'cluster_' || root AS name, string_agg(a, ',' ORDER BY a) AS clusters
FROM (SELECT a, min(b) AS root FROM centroid_reach GROUP BY a) GROUP BY root"""))
def c9_auto_plan(spark, d):
    """A merge plan from the centroids alone: linked ones become one intent."""
    plan = cl.merge_plan(centroids(spark, d), _CLOSE)
    return plan.select("name", F.array_join("source_cluster_ids", ",").alias("clusters"))


@register("c10_merge_issues", S.with_ctes("""
SELECT DISTINCT cluster_id, 'not mapped' AS issue FROM clustered WHERE cluster_id NOT IN (SELECT cluster_id FROM cluster_intents)
UNION ALL SELECT DISTINCT cluster_id::BIGINT, 'unknown cluster' FROM cluster_intents WHERE cluster_id NOT IN (SELECT cluster_id FROM clustered)
UNION ALL SELECT cluster_id::BIGINT, 'mapped more than once' FROM (
  SELECT cluster_id FROM cluster_intents UNION ALL SELECT cluster_id FROM cluster_intents WHERE cluster_id = 3)
GROUP BY cluster_id HAVING count(*) > 1"""))
def c10_merge_issues(spark, d):
    plan = fx.taxonomy(spark).select("source_cluster_ids")
    twice = plan.where(F.array_contains("source_cluster_ids", 3)).select(F.array(F.lit(3)).alias("source_cluster_ids"))
    return cl.merge_issues(stored_clusters(spark, d), plan.unionByName(twice)).select(
        F.col("cluster_id").cast("bigint").alias("cluster_id"), "issue")


@register("c12_resume", S.with_ctes("""
SELECT ticket_id, CASE WHEN ticket_status = 'Open' THEN 'cached' ELSE 'new' END AS origin FROM tickets"""))
def c12_resume(spark, d):
    """The open tickets are done already (written table); the rest is added."""
    t = clean_tickets(spark, d).select("ticket_id", "ticket_status")
    path = tb.write_table(t.where("ticket_status = 'Open'").select("ticket_id"), scratch_dir(spark, "labels-cache"))
    cache = tb.read_table(spark, path)
    fresh = hy.skip_cached(t, cache, "ticket_id").select("ticket_id", F.lit("new").alias("origin"))
    return cache.withColumn("origin", F.lit("cached")).unionByName(fresh)


@register("c13_taxonomy_checks", S.with_ctes("""
SELECT rule, violations, violations = 0 AS passed FROM (
  SELECT 'rule:known_name' AS rule, count_if(name IS NULL) AS violations FROM checked
  UNION ALL SELECT 'rule:risk_level', count_if(coalesce(risk_level, '') NOT IN ('low', 'high')) FROM checked
  UNION ALL SELECT 'rule:has_definition', count_if(NOT coalesce(length(definition) > 0, false)) FROM checked
  UNION ALL SELECT 'unique:ticket_id', count(*) - count(DISTINCT ticket_id) FROM checked)""",
    checked="SELECT l.ticket_id, t.* FROM labelled l LEFT JOIN taxonomy t ON t.name = l.assigned_intent"))
def c13_taxonomy_checks(spark, d):
    t = labelled(spark, d).join(fx.taxonomy(spark), F.col("assigned_intent") == F.col("name"), "left")
    t = materialise(t.select("ticket_id", "name", "risk_level", "definition"), "checked")
    rules = cl.taxonomy_checks(t, tuple(n for n, _, _ in K.TAXONOMY))
    return pf.quality_report(t, unique=("ticket_id",), rules=rules)


@register("s4_taxonomy_json", S.with_ctes("""
SELECT name, definition, risk_level, array_to_string(source_cluster_ids, ',') AS clusters,
       (SELECT count(*) FROM classifications c WHERE c.intent = t.name) AS tickets FROM taxonomy t"""))
def s4_taxonomy_json(spark, d):
    """Taxonomy written as one nested document, read back, and counted against all tickets."""
    path = scratch_dir(spark, "taxonomy")
    rows = fx.taxonomy(spark).agg(F.collect_list(F.struct("*")).alias("intents"))
    rows.select(F.to_json(F.struct("intents")).alias("value")).coalesce(1).write.text(path)
    tax = tb.read_taxonomy(spark, path)
    counts = fx.classifications(spark, d).groupBy(F.col("intent").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return tax.join(counts, "name", "left").select(
        "name", "definition", "risk_level", F.array_join("source_cluster_ids", ",").alias("clusters"),
        F.coalesce("n", F.lit(0)).alias("tickets"))


@register("s5_taxonomy_fallback", S.with_ctes("""
SELECT name, risk_level, (SELECT count(*) FROM labelled l WHERE l.assigned_intent = t.name) AS tickets FROM taxonomy t"""))
def s5_taxonomy_fallback(spark, d):
    """No approved file: the proposed one is read; counted against all labelled tickets."""
    path = scratch_dir(spark, "proposed")
    rows = fx.taxonomy(spark).agg(F.collect_list(F.struct("*")).alias("merged_intents"))
    rows.select(F.to_json(F.struct("merged_intents")).alias("value")).coalesce(1).write.text(path)
    tax = tb.taxonomy_or_message(spark, path + "-missing", path)
    counts = labelled(spark, d).groupBy(F.col("assigned_intent").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return tax.join(counts, "name", "left").select("name", "risk_level", F.coalesce("n", F.lit(0)).alias("tickets"))


@register("l1_l2_l3_label_by_cluster", S.with_ctes("SELECT ticket_id, assigned_intent, intent_confidence FROM labelled"))
def l1_l2_l3_label_by_cluster(spark, d):
    return labelled(spark, d).select("ticket_id", "assigned_intent", "intent_confidence")


@register("l2_centroid_confidence", S.with_ctes("""
SELECT ticket_id, round(least(0.98::DOUBLE, greatest(0.5::DOUBLE, 0.5 + 0.5 * list_dot_product(embedding, centroid))), 3) AS confidence
FROM clustered"""))
def l2_centroid_confidence(spark, d):
    from ticketloom.operators.blocks import small_side

    joined = clustered(spark, d).join(small_side(centroids(spark, d)), "cluster_id")
    return joined.select("ticket_id", F.round(lb.centroid_confidence(F.col("embedding"), F.col("centroid")), 3).alias("confidence"))


S.CTES["batched"] = """
SELECT *, (row_number() OVER (ORDER BY ticket_id) - 1) // 25 AS batch_id FROM tickets"""


@register("l4_micro_batches", S.with_ctes("SELECT ticket_id, batch_id, batch_id // 20 AS batch_group FROM batched"))
def l4_micro_batches(spark, d):
    return lb.micro_batches(stored_tickets(spark, d), "ticket_id", CFG).select("ticket_id", "batch_id", "batch_group")


@register("l5_batch_payloads", S.with_ctes("""
SELECT batch_id, count(*) AS batch_rows,
       (SELECT string_agg('- ' || name || ': ' || definition, chr(10) ORDER BY name) FROM taxonomy) AS tax_summary,
       to_json(list({'ticket_id': ticket_id, 'ticket_text': ticket_text} ORDER BY ticket_id))::VARCHAR AS payload
FROM batched GROUP BY batch_id"""))
def l5_batch_payloads(spark, d):
    """What a labeller is handed per batch: the taxonomy lines and the tickets."""
    lines = lb.taxonomy_lines(fx.taxonomy(spark)).scalar()
    batches = lb.batch_payloads(lb.micro_batches(stored_tickets(spark, d), "ticket_id", CFG))
    return batches.withColumn("tax_summary", lines)


_OFFLINE = f"""
SELECT ticket_id, CASE WHEN {_refund} THEN '{K.REFUND_INTENT}' WHEN {_cancel} THEN '{K.CANCEL_INTENT}' ELSE 'other' END AS intent,
       CASE WHEN {_refund} THEN 0.92::DOUBLE WHEN {_cancel} THEN 0.90::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM tickets"""


@register("l6_external_labeller", S.with_ctes(_OFFLINE))
def l6_external_labeller(spark, d):
    return lb.label_externally(clean_tickets(spark, d))


@register("l6_offline_labeller", S.with_ctes(
    "SELECT ticket_id, assigned_intent AS intent, intent_confidence AS confidence, NULL::VARCHAR AS failure FROM labelled"))
def l6_offline_labeller(spark, d):
    """Keyword rules and nearest centroid as one plug-in, with the failure channel."""
    v = fx.ticket_vectors(spark, d).select("ticket_id", "embedding")
    labeller = lb.centroid_labeller(centroids(spark, d), fx.taxonomy(spark))
    rows = lb.label_externally(
        clean_tickets(spark, d).join(v, "ticket_id"), labeller, columns=("ticket_id", "ticket_text", "embedding"), with_failures=True)
    return rows.withColumn("confidence", F.round("confidence", 3))


@register("l7_fold_labels", S.with_ctes(f"""
SELECT t.ticket_id, CASE WHEN t.ticket_status = 'Open' THEN 'other' WHEN t.ticket_status = 'Closed' THEN 'relabelled' ELSE o.intent END AS assigned_intent,
       CASE WHEN t.ticket_status = 'Open' THEN 0.5::DOUBLE WHEN t.ticket_status = 'Closed' THEN 0.7::DOUBLE ELSE o.confidence END AS intent_confidence
FROM tickets t JOIN ({_OFFLINE}) o USING (ticket_id)"""))
def l7_fold_labels(spark, d):
    """Open tickets have no result, closed ones two; the later one counts."""
    t = clean_tickets(spark, d)
    first = lb.label_externally(t.where("ticket_status <> 'Open'")).withColumn("seq", F.lit(1))
    again = t.where("ticket_status = 'Closed'").select(
        "ticket_id", F.lit("relabelled").alias("intent"), F.lit(0.7).alias("confidence"), F.lit(2).alias("seq"))
    return lb.fold_labels(t, first.unionByName(again)).select("ticket_id", "assigned_intent", "intent_confidence")


@register("l8_encode_by_count", S.with_ctes("""
SELECT l.ticket_id, c.code FROM labelled l JOIN (
  SELECT assigned_intent, row_number() OVER (ORDER BY count(*) DESC, assigned_intent) - 1 AS code FROM labelled GROUP BY 1) c USING (assigned_intent)"""))
def l8_encode_by_count(spark, d):
    return lb.encode_by_count(labelled(spark, d).select("ticket_id", "assigned_intent"), "assigned_intent").select("ticket_id", "code")


@register("l8_encode_by_appearance", S.with_ctes("""
SELECT l.ticket_id, c.code FROM labelled l JOIN (
  SELECT assigned_intent, row_number() OVER (ORDER BY min(ticket_id)) - 1 AS code FROM labelled GROUP BY 1) c USING (assigned_intent)"""))
def l8_encode_by_appearance(spark, d):
    return lb.encode_by_appearance(labelled(spark, d).select("ticket_id", "assigned_intent"), "assigned_intent", "ticket_id").select("ticket_id", "code")


def rule_sql(text: str) -> str:
    low = f"lower({text})"
    refund, cancel = S.any_of(low, K.REFUND_TERMS), S.any_of(low, K.CANCEL_TERMS)
    levels = " ".join(f"WHEN {S.any_of(low, terms)} THEN '{lv}'" for lv, terms in lb.URGENCY_TERMS)
    return f"""
CASE WHEN {refund} THEN '{K.REFUND_INTENT}' WHEN {cancel} THEN '{K.CANCEL_INTENT}' ELSE 'other' END AS intent,
CASE WHEN {refund} THEN 0.92::DOUBLE WHEN {cancel} THEN 0.90::DOUBLE ELSE 0.5::DOUBLE END AS confidence,
CASE WHEN {S.any_of(low, K.REPEAT_TERMS)} THEN 'strongly_negative' ELSE 'neutral' END AS sentiment,
CASE {levels} ELSE 'low' END AS urgency,
{refund} OR {cancel} AS is_high_risk"""


S.CTES["rule_classified"] = f"SELECT ticket_id, ticket_text, {rule_sql('ticket_text')} FROM tickets"


@register("l9_rule_classifier", S.with_ctes("""
SELECT ticket_id, intent, confidence, sentiment, urgency,
       CASE WHEN urgency = 'low' THEN 'Standard classification' ELSE urgency || ' wording' END AS urgency_reason, is_high_risk
FROM rule_classified"""))
def l9_rule_classifier(spark, d):
    out = lb.classify_by_rules(clean_tickets(spark, d).select("ticket_id", "ticket_text"), "ticket_text")
    return out.drop("ticket_text")


@register("l10_risk_flag", S.with_ctes("""
SELECT l.ticket_id, c.is_high_risk AS model, coalesce(t.risk_level = 'high', false) AS taxonomy,
       c.is_high_risk OR coalesce(t.risk_level = 'high', false) AS either
FROM labelled l JOIN classifications c USING (ticket_id) LEFT JOIN taxonomy t ON t.name = l.assigned_intent"""))
def l10_risk_flag(spark, d):
    tax = fx.taxonomy(spark)
    said = fx.classifications(spark, d).select("ticket_id", "is_high_risk")
    df = labelled(spark, d).select("ticket_id", F.col("assigned_intent").alias("intent")).join(said, "ticket_id")
    out = df.withColumn("said", F.col("is_high_risk"))
    out = lb.risk_flag(out, tax, "taxonomy").withColumnRenamed("is_high_risk", "taxonomy")
    out = lb.risk_flag(out.withColumn("is_high_risk", F.col("said")), tax, "either").withColumnRenamed("is_high_risk", "either")
    return out.select("ticket_id", F.col("said").alias("model"), "taxonomy", "either")


@register("a4_intent_distribution", distribution_sql("labelled", "assigned_intent"))
def a4_intent_distribution(spark, d):
    return pf.distribution(labelled(spark, d), "assigned_intent")


@register("a5_noise_share", S.with_ctes("""
SELECT count(*) AS row_count, count_if(assigned_intent = 'other' OR intent_confidence < 0.6) AS noise_count,
       round(100.0::DOUBLE * count_if(assigned_intent = 'other' OR intent_confidence < 0.6) / count(*), 4) AS noise_pct FROM labelled"""))
def a5_noise_share(spark, d):
    return pf.noise_share(labelled(spark, d))


@register("a6_cluster_sizes", distribution_sql("clustered", "cluster_id"))
def a6_cluster_sizes(spark, d):
    return pf.distribution(clustered(spark, d).withColumn("cluster_id", F.col("cluster_id").cast("bigint")), "cluster_id")
