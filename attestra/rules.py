"""Rule data: ladders, vocabularies and policies.

Everything here is a fixed value that results depend on. Operators take these
as default arguments, so a caller can pass other rules.
"""

from __future__ import annotations

# Materiality ladder, most severe first.
MATERIALITY = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFORMATIONAL"]

# Evidence ladder, higher is stronger public evidence.
STATUS_RANK = {"SELF_REPORTED": 1, "ASSESSED": 1, "CORROBORATED": 2, "VERIFIED_PRIMARY": 3}

# Relationship predicates that carry ownership or statutory power.
OWNERSHIP_PREDICATES = [
    "OWNS",
    "OWNERSHIP",
    "SHAREHOLDER_OF",
    "ACQUIRED",
    "STATUTORY_REPRESENTATIVE_OF",
]

# Change classes for added objects as
# (object type, change type, materiality, impact). Types whose class depends on
# the payload are handled in operators/classify.py.
ADDED_RULES = [
    ("claim", "CLAIM_ADDED", "LOW", None),
    ("source", "SOURCE_ADDED", None, None),
    ("relationship", "RELATIONSHIP_ADDED", None, None),
    ("shareholding", "OWNERSHIP_CHANGED", "HIGH", "STRENGTHENED"),
    ("transaction", "OWNERSHIP_CHANGED", "HIGH", "STRENGTHENED"),
    ("statutory_role", "ROLE_CHANGED", "HIGH", "STRENGTHENED"),
    ("financial_fact", "FINANCIAL_PERIOD_ADDED", "MEDIUM", None),
    ("contradiction", "CONTRADICTION_OPENED", "MEDIUM", "CONTRADICTED"),
    ("open_question", "GAP_OPENED", "LOW", "NO_EPISTEMIC_CHANGE"),
    ("resolved_question", "GAP_RESOLVED", "MEDIUM", "RESOLVED"),
    ("identity_field", "OBJECT_ENRICHED", "LOW", None),
    ("entity", "OBJECT_ADDED", "LOW", "NO_EPISTEMIC_CHANGE"),
    ("timeline_event", "OBJECT_ADDED", "LOW", "NO_EPISTEMIC_CHANGE"),
    ("executive_finding", "REASONING_ADDED", "MEDIUM", "NO_EPISTEMIC_CHANGE"),
    ("reasoning_inference", "REASONING_ADDED", "LOW", "NO_EPISTEMIC_CHANGE"),
    ("reasoning_assumption", "REASONING_ADDED", "INFORMATIONAL", "NO_EPISTEMIC_CHANGE"),
    ("conflict_resolution", "REASONING_ADDED", "INFORMATIONAL", "NO_EPISTEMIC_CHANGE"),
]

# Change classes for changed objects, first match per type wins:
# (object type, trigger, change type, materiality, impact). A trigger is a set
# of field names of which one changed, or a named condition in angle brackets;
# None matches always. Impact "<status>" means the status transition decides.
CHANGED_RULES = [
    ("claim", "<superseded>", "CLAIM_SUPERSEDED", "MEDIUM", "CORRECTED"),
    ("claim", {"status"}, "STATUS_CHANGED", "MEDIUM", "<status>"),
    ("claim", {"text"}, "CLAIM_CORRECTED", "MEDIUM", "CORRECTED"),
    ("claim", "<sources only added>", "EVIDENCE_ADDED", "LOW", "STRENGTHENED"),
    ("claim", None, "OBJECT_ENRICHED", "INFORMATIONAL", "NO_EPISTEMIC_CHANGE"),
    ("source", {"availability", "url"}, "SOURCE_AVAILABILITY_CHANGED", "MEDIUM", "NO_EPISTEMIC_CHANGE"),
    ("identity_field", {"value"}, "OBJECT_CORRECTED", "MEDIUM", "CORRECTED"),
    ("identity_field", {"status"}, "STATUS_CHANGED", "MEDIUM", "<status>"),
    ("contradiction", "<settled>", "CONTRADICTION_RESOLVED", "MEDIUM", "RESOLVED"),
    ("shareholding", {"vklad"}, "OWNERSHIP_CHANGED", "HIGH", "CORRECTED"),
    ("statutory_role", {"until"}, "VALIDITY_ENDED", "HIGH", "NO_EPISTEMIC_CHANGE"),
    ("statutory_role", {"role"}, "ROLE_CHANGED", "HIGH", "CORRECTED"),
    ("relationship", {"source", "target"}, "OBJECT_CORRECTED", "HIGH", "CORRECTED"),
    ("relationship", {"status"}, "STATUS_CHANGED", "MEDIUM", "<status>"),
    ("financial_fact", {"display"}, "FINANCIAL_VALUE_CORRECTED", "HIGH", "CORRECTED"),
    ("case_meta", None, "PUBLICATION_METADATA_CHANGED", "INFORMATIONAL", "NO_EPISTEMIC_CHANGE"),
    ("timeline_event", None, "OBJECT_CORRECTED", "MEDIUM", "CORRECTED"),
    ("transaction", None, "OBJECT_CORRECTED", "MEDIUM", "CORRECTED"),
    ("reasoning_inference", None, "REASONING_CHANGED", "MEDIUM", "CORRECTED"),
    ("executive_finding", None, "REASONING_CHANGED", "MEDIUM", "CORRECTED"),
    ("reasoning_assumption", None, "REASONING_CHANGED", "LOW", "NO_EPISTEMIC_CHANGE"),
    ("conflict_resolution", None, "REASONING_CHANGED", "LOW", "NO_EPISTEMIC_CHANGE"),
]

# Change types by category.
PUBLICATION_CHANGES = ["PUBLICATION_METADATA_CHANGED", "OBJECT_REMOVED_FROM_PUBLICATION"]
CORRECTIONS = ["OBJECT_CORRECTED", "CLAIM_CORRECTED", "CLAIM_SUPERSEDED", "FINANCIAL_VALUE_CORRECTED"]
REVALIDATING_CHANGES = [
    "SOURCE_AVAILABILITY_CHANGED",
    "CONTRADICTION_OPENED",
    "OBJECT_REMOVED_FROM_PUBLICATION",
]

# Record types whose ids come from their text, so that a
# rewording shows up as a removal plus an addition.
SUCCESSION_TYPES = ["open_question", "timeline_event", "financial_fact"]
SUCCESSION_THRESHOLD = 0.35

# Freshness policies as
# (policy, interval days, due-soon days, provider).
FRESHNESS_POLICIES = [
    ("ownership-statutory", 30, 7, "commercial register"),
    ("corporate-identity", 90, 14, "commercial register"),
    ("financial-filings", 90, 30, "collection of deeds"),
    ("insolvency", 7, 2, "insolvency register"),
    ("dns-tls", 30, 7, "dns and certificate log"),
    ("contracts-register", 90, 14, "contracts register"),
    ("web-media", 180, 30, "web and archive"),
    ("historical-immutable", None, None, None),
]
HIGH_POLICIES = ["ownership-statutory", "insolvency"]
MEDIUM_POLICIES = ["financial-filings", "corporate-identity"]
MATERIALITY_WEIGHT = {"HIGH": 40, "MEDIUM": 20, "LOW": 5}
STATE_WEIGHT = {"BLOCKED": 35, "STALE": 30, "DUE": 25, "DUE_SOON": 10}
MAX_DEPENDENT_WEIGHT = 15
STOP_CONDITION = "a preserved answer, or three failed attempts"

# Edge roles that carry support in the reasoning graph.
SUPPORT_ROLES = [
    "supports",
    "produces",
    "preserved_in",
    "extracted_from",
    "cited_by_claim",
    "reasoned_by",
    "observed_via",
    "contextualizes",
]

# Text vocabularies (matched case-insensitively).
HIGH_MATERIALITY_WORDS = (
    "revenue|financ|net result|assets|equity|liabilit|acquir|shareholder|ownership|exekuc|insolven|jednatel|owner"
)
MODERATE_MATERIALITY_WORDS = "client|contract|tender|role|director|board|invest"
SOURCE_CLASS_WORDS = [
    ("official", "register|registr|official|government|primary"),
    ("company", "company|legal notice|marketing"),
    ("media", "media|profile|forbes|crunch|aggregator"),
]
PRIMARY_FILED_WORDS = "primary registry document|official register|government"

# Coverage dimensions as (dimension, record kind, categories).
COVERAGE_DIMENSIONS = [
    ("identity", "identity", []),
    ("ownership", "edge", ["ownership"]),
    ("management", "edge", ["governance", "people"]),
    ("financials", "financials", []),
    ("transactions", "edge", ["transactions"]),
    ("legal", "edge", ["legal"]),
    ("technical", "edge", ["technical"]),
    ("commercial", "edge", ["client"]),
    ("media", "media", []),
    ("procurement", "none", []),
]

# Filed-metric label patterns in priority order as
# (pattern, concept, point in time).
FINANCE_CONCEPTS = [
    ("registered capital", "registered_capital", True),
    ("revenue from sale", "revenue_products_services", False),
    ("net turnover", "net_turnover", False),
    ("net result", "net_result", False),
    ("total assets", "total_assets", False),
    ("^equity", "total_equity", False),
    ("^liabilities \\(", "total_liabilities", False),
    ("personnel costs", "personnel_costs", False),
    ("purchased services", "purchased_services", False),
    ("stakes in controlled", "investments_controlled_entities", False),
    ("liabilities to shareholders", "liabilities_to_shareholders", False),
]

# Derived metrics as
# (metric, numerator concept, denominator concept, unit, current period only).
FINANCE_METRICS = [
    ("net_margin", "net_result", "net_turnover", "percent", False),
    ("equity_ratio", "total_equity", "total_assets", "percent", True),
    ("leverage", "total_liabilities", "total_equity", "ratio", True),
    ("related_party_share", "liabilities_to_shareholders", "total_liabilities", "percent", True),
    ("services_share", "purchased_services", "net_turnover", "percent", True),
    ("personnel_share", "personnel_costs", "net_turnover", "percent", True),
]

# Page audit limits and vocabularies.
TITLE_MAX = 60
DESCRIPTION_MIN = 50
DESCRIPTION_MAX = 160
PLACEHOLDER = "\\b(TODO|FIXME|XXX|lorem ipsum|coming soon|placeholder)\\b"
NON_PRODUCTION_HOSTS = "(localhost|127\\.0\\.0\\.1|0\\.0\\.0\\.0|:8000|staging\\.|\\.github\\.io)"
SCHEMA_TYPES = ["WebSite", "WebPage", "Report", "Article", "CollectionPage"]
EVIDENCE_TYPES = ["Report"]

# Privacy patterns.
BIRTH_NUMBER = "\\b\\d{6}/\\d{3,4}\\b"
LOCAL_PATH = "/Users/|/home/|[A-Z]:\\\\\\\\"
FULL_BIRTH_DATE = '"born"\\s*:\\s*"\\d{4}-\\d{2}-\\d{2}"'

# Monitoring limits and the field policy of candidates.
MAX_PROVIDER_CALLS = 4
MATERIAL_FIELDS = ["legalName", "ico", "statutoryBody", "owners", "address", "status"]
REVIEW_FIELDS = ["statutoryBody", "owners"]
CADENCE_DAYS = 30
PUBLISHABLE = ["APPROVED", "AUTO_APPROVED", "PUBLISHED"]

# States allowed by the gates.
HYPOTHESIS_STATES = [
    "proposed",
    "plausible",
    "supported",
    "strongly_supported",
    "contradicted",
    "rejected",
    "unresolved",
]
OPEN_HYPOTHESES = ["unresolved", "plausible"]
GAP_STATES = [
    "NOT_COLLECTED",
    "NOT_FOUND",
    "BLOCKED",
    "NOT_PUBLIC",
    "REQUIRES_DATAROOM",
    "REQUIRES_MANAGEMENT_CONFIRMATION",
]
INFORMATION_GAIN = ["very_low", "low", "moderate", "high", "very_high"]
PUBLIC_ADDRESS_CLASSES = ["public", "public_with_context"]
