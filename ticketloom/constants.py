"""Word lists, patterns, texts and lookup tables.

These decide results, so they are stated once, in plain text, in their natural order.
"""

# --- fixed values: whitespace --------------------------------------------------
# Java's Unicode \s leaves out U+001C..U+001F, which count as blanks here.
BLANK = r"[\s\x1c-\x1f]"
BLANK_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- fixed values: redaction patterns -------------------------------------------
EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,7}\b"
PHONE_PATTERN = r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
BILLING_ZIP_PATTERN = r"\b(?:billing\s+zip\s+code\s+is:\s*)(\d{5}(?:-\d{4})?)\b"
HANDLE_PATTERN = r"@[\w'-]+"
ID_CODE_PATTERN = r"\b[A-Z0-9]{8,15}\b"

EMAIL_TOKEN = "[EMAIL]"
PHONE_TOKEN = "[PHONE]"
BILLING_ZIP_TOKEN = "billing zip code is: [ZIP]"
HANDLE_TOKEN = "[USER_HANDLE]"
ID_CODE_TOKEN = "[ID]"
ERROR_TOKEN = "[ERROR_CODE]"

# --- fixed values: placeholders, in order of replacement -------------------------
PRODUCT_PLACEHOLDERS = ("{product_purchased}", "product_purchased}")
ERROR_PLACEHOLDER = "{error_message}"
DEFAULT_PRODUCT = "product"

# --- fixed values: keyword overrides of the labeller -----------------------------
REFUND_TERMS = ("refund", "billing zip", "double charge", "charged", "credit card", "payment")
REFUND_INTENT, REFUND_CONFIDENCE = "billing_and_refund_dispute", 0.92
CANCEL_TERMS = ("cancel my", "cancellation request", "terminate subscription")
CANCEL_INTENT, CANCEL_CONFIDENCE = "order_and_cancellation_inquiry", 0.90

# --- fixed values: gate ----------------------------------------------------------
REPEAT_TERMS = ("multiple times", "contacted", "again", "unresolved")
URGENT_LEVELS = ("high", "critical")
REASON_HIGH_RISK = "High-risk intent detected (payment/security/legal/account)"
REASON_REPEAT = "Strongly negative sentiment or repeated complaint signal"
REASON_NO_MATCH = (
    "No sufficiently similar historical resolution found in database (< 0.55 similarity)"
)
NOTICE_HEAD = (
    "Thank you for contacting support. Your request has been prioritized and routed to "
    "a human specialist due to: "
)
NOTICE_TAIL = ". A support agent will review your issue and respond shortly."

# --- fixed values: queue order ---------------------------------------------------
URGENCY_RANK = {"critical": 1, "high": 2, "medium": 3, "low": 4}
URGENCY_RANK_ELSE = 5

# --- fixed values: provenance ----------------------------------------------------
HUMAN = "human_resolved"
AGENT = "agent_generated_approved"

# --- fixed values: groundedness audit --------------------------------------------
PROMISE_TERMS = ("guarantee", "refund within 24 hours")
NOTE_GROUNDED = "Grounded in retrieved scenarios"
NOTE_PROMISE = "Made outside financial promise not found in retrieved case"
DEFAULT_FEEDBACK_NOTE = "Customer marked Not Okay"

OTHER_INTENT = "other"

# --- fixed values: intent taxonomy (name, risk level, source clusters) -----------
TAXONOMY = (
    ("device_technical_issue_general", "low", (1, 3, 4, 8, 9, 13, 15, 19, 22, 23)),
    ("hardware_failure_specific", "low", (7, 10, 12, 14, 18, 21)),
    ("device_wifi_connectivity", "low", (16,)),
    ("product_technical_issue_general", "low", (5,)),
    ("account_login_failure", "high", (11,)),
    ("device_security_and_account", "high", (0, 6, 17, 20)),
    ("data_loss_recovery", "high", (2,)),
    ("billing_and_refund_dispute", "high", ()),
    ("order_and_cancellation_inquiry", "high", ()),
    ("other", "low", ()),
)
