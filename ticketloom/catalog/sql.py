"""SQL building blocks (common table expressions) shared by the oracle queries."""

from __future__ import annotations

import re

from ticketloom import constants as K
from ticketloom.sources import fixtures as fx


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def fill(x: str, product: str) -> str:
    name = f"coalesce(nullif({strip(product)}, ''), 'product')"
    return (
        f"replace(replace(replace({x}, '{{product_purchased}}', {name}), "
        f"'product_purchased}}', {name}), '{{error_message}}', '[ERROR_CODE]')"
    )


def sub(x: str, pattern: str, token: str, flags: str = "g") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(token)}, {lit(flags)})"


def email(x: str) -> str:
    return sub(x, K.EMAIL_PATTERN, K.EMAIL_TOKEN)


def phone(x: str) -> str:
    return sub(x, K.PHONE_PATTERN, K.PHONE_TOKEN)


def billing_zip(x: str) -> str:
    return sub(x, K.BILLING_ZIP_PATTERN, K.BILLING_ZIP_TOKEN, "gi")


def handle(x: str) -> str:
    return sub(x, K.HANDLE_PATTERN, K.HANDLE_TOKEN)


def lines(x: str) -> str:
    return sub(x, r"[\r\n]+", " ")


def squeeze(x: str) -> str:
    return sub(x, r"\s{2,}", " ")


def space(x: str) -> str:
    return strip(squeeze(lines(x)))


def clean(x: str, product: str) -> str:
    return space(handle(billing_zip(phone(email(fill(f"coalesce({x}, '')", product))))))


def any_of(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(t)})" for t in terms) + ")"


def intent_at(expr: str) -> str:
    names = "[" + ", ".join(lit(n) for n in fx.INTENTS) + "]"
    return f"{names}[({expr}) % {len(fx.INTENTS)} + 1]"


def unit(v: str) -> str:
    size = f"greatest(sqrt(list_sum(list_transform({v}, lambda x: x * x))), 1e-12)"
    return f"list_transform({v}, lambda x: x / {size})"


HIGH_RISK = [n for n, risk, _ in K.TAXONOMY if risk == "high"]

CTES: dict[str, str] = {}

CTES["sizes"] = """
SELECT (SELECT max(vec_id) + 1 FROM embeddings) AS n_vec,
       (SELECT max(item_id) + 1 FROM benchmark) AS n_item,
       (SELECT max(p_partkey) + 1 FROM part) AS n_part"""

CTES["tickets_raw"] = f"""
SELECT d.doc_id AS ticket_id, {fx.DESCRIPTION_SQL} AS ticket_description,
       p.p_name AS product_purchased, d.source AS ticket_type, d.lang AS ticket_subject,
       {fx.PRIORITY_SQL} AS ticket_priority, {fx.STATUS_SQL} AS ticket_status,
       CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE b.text END AS resolution, e.ts AS created_at
FROM documents d CROSS JOIN sizes z
JOIN part p ON p.p_partkey = d.n_chars % z.n_part
JOIN orders o ON o.o_orderkey = d.doc_id
JOIN events e ON e.event_id = d.doc_id
LEFT JOIN benchmark b ON b.item_id = d.doc_id % z.n_item"""

CTES["tickets_all"] = f"""
SELECT ticket_id, {clean('ticket_description', 'product_purchased')} AS ticket_text,
       {strip("coalesce(product_purchased, '')")} AS product,
       {strip("coalesce(ticket_type, '')")} AS ticket_type,
       {strip("coalesce(ticket_subject, '')")} AS ticket_subject,
       {strip("coalesce(ticket_priority, '')")} AS ticket_priority,
       {strip("coalesce(ticket_status, '')")} AS ticket_status,
       {space("coalesce(resolution, '')")} AS resolution,
       created_at
FROM tickets_raw"""

CTES["tickets"] = """
SELECT *, ticket_status = 'Closed' AND length(resolution) > 0 AS is_solved
FROM tickets_all WHERE length(ticket_text) > 0
QUALIFY row_number() OVER (PARTITION BY ticket_text ORDER BY ticket_id) = 1"""

CTES["vectors"] = f"""
SELECT ticket_id, label, {unit('blend')} AS embedding FROM (
  SELECT d.doc_id AS ticket_id, a.label,
         list_transform(list_zip(a.embedding, b.embedding),
           lambda s: s[1]::DOUBLE + ((d.doc_id % 7)::DOUBLE / 2) * s[2]::DOUBLE) AS blend
  FROM documents d CROSS JOIN sizes z
  JOIN embeddings a ON a.vec_id = d.doc_id % z.n_vec
  JOIN embeddings b ON b.vec_id = (d.doc_id * 7 + 3) % z.n_vec)"""

CTES["classifications"] = f"""
SELECT *, intent IN {words(HIGH_RISK)} AS is_high_risk FROM (
  SELECT d.doc_id AS ticket_id,
         CASE WHEN d.doc_id % 23 = 0 THEN {lit(fx.UNKNOWN_INTENT)}
              WHEN d.doc_id % 9 = 0 THEN {intent_at('v.label + 1')}
              ELSE {intent_at('v.label')} END AS intent,
         ((d.doc_id * 37) % 100)::DOUBLE / 100.0::DOUBLE AS confidence,
         CASE WHEN d.doc_id % 11 = 0 THEN 'strongly_negative' ELSE 'neutral' END AS sentiment,
         {fx.URGENCY_SQL.format('d.doc_id')} AS urgency, 'rule based' AS urgency_reason
  FROM documents d CROSS JOIN sizes z JOIN embeddings v ON v.vec_id = d.doc_id % z.n_vec)"""

CTES["cases"] = f"""
SELECT 'case_' || v.vec_id AS case_id, b1.text AS ticket_text, {intent_at('v.label')} AS intent,
       CASE WHEN v.vec_id % 3 = 0 THEN '{K.AGENT}' ELSE '{K.HUMAN}' END AS source,
       b2.text AS resolution, p.p_name AS product, e.ts AS "timestamp", v.embedding AS embedding
FROM embeddings v CROSS JOIN sizes z
JOIN benchmark b1 ON b1.item_id = v.vec_id % z.n_item
JOIN benchmark b2 ON b2.item_id = (v.vec_id + 1) % z.n_item
JOIN part p ON p.p_partkey = v.vec_id % z.n_part
JOIN events e ON e.event_id = v.vec_id"""

CTES["precedents"] = f"""
SELECT case_id || '_' || substr(md5({strip('ticket_text')}), 1, 8) AS case_key,
       {strip('ticket_text')} AS document, case_id, intent, source, resolution, product,
       "timestamp", embedding
FROM cases"""

CTES["taxonomy"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({lit(n)}, {lit('Tickets about ' + n.replace('_', ' ') + '.')}, {list(c)}::INTEGER[], {lit(r)})"
    for n, r, c in K.TAXONOMY
) + ") t(name, definition, source_cluster_ids, risk_level)"


def with_ctes(final: str, **extra: str) -> str:
    """Prefix a query with the tables it names, in dependency order."""
    known = {**CTES, **extra}
    order: list[str] = []

    def visit(body: str) -> None:
        for name in known:
            if name not in order and re.search(rf"(?<![\w.]){name}(?!\w)", body):
                if known[name] is body:
                    continue
                visit(known[name])
                if name not in order:
                    order.append(name)

    visit(final)
    if not order:
        return final
    kind = "WITH RECURSIVE " if any("recursive step" in known[n] for n in order) else "WITH "
    return kind + ",\n".join(f"{n} AS ({known[n]})" for n in order) + "\n" + final
