"""Policy values of the jobs. They are fixed values: bands, tiers, points, lists and patterns that results depend on."""

from __future__ import annotations

STRENGTHS = ("WEAK", "MEDIUM", "STRONG", "DIRECT")  # by rank
FAMILIES = ("first_party_statement", "vendor_case_study", "ats_hiring", "engineering_footprint", "network_footprint", "edge_delivery", "corporate_identity", "encyclopedic", "policy")
SCOPES = ("workload", "storage", "edge", "saas_dependency", "unknown")
FRESHNESS = ("current", "historical", "unknown")
HOSTING = ("first_party_statement", "vendor_case_study")
EDGE = "edge_delivery"
CLOUD_BEARING = FAMILIES[:6]
INHERENT = ("ats_hiring", "engineering_footprint", "edge_delivery")
CLOUD_CHANNELS = ("ats", "footprint", "github", "trust_pages", "vendor")
#: Band: (employees, least, most).
BANDS = {"1-10": (5, 1, 10), "11-50": (30, 11, 50), "51-200": (120, 51, 200), "201-1000": (500, 201, 1000), "1000+": (3000, 1000, 10_000_000)}
#: Scale points below each headcount; the last tier is open.
TIERS = ((10, 3), (50, 10), (200, 18), (1000, 25), (10_000, 30), (None, 24))
UNKNOWN_SCALE_POINTS = 3
STATE_POINTS = {"CONFIRMED": 40, "LIKELY": 30, "POSSIBLE": 18, "EDGE_ONLY": 5, "UNKNOWN": 0}
CLOUD_CAP, WORKLOAD_POINTS, WORKLOAD_CAP, COMPLEXITY_POINTS, COMPLEXITY_CAP, MAX_SCORE, THRESHOLD = 55, 5, 15, 5, 15, 100, 60
WORKLOADS = {
    "gpu/ai/ml workload": ("gpu", "ai workload", "ml workload", "machine learning workload", "gpu cluster"),
    "large-scale data": ("petabyte", "terabyte", "large-scale data", "big data"),
    "multi-region/multi-cloud": ("multi-region", "multi-cloud", "multiregion", "multicloud"),
    "kubernetes/iac at scale": ("kubernetes", "terraform", "k8s"),
    "sre/platform hiring signal": ("sre", "site reliability", "platform engineer", "cloud engineer"),
}
#: Field, whether all or any of the phrases are needed, phrases.
COMPLEXITY = (
    ("text", "any", ("multiple products", "product suite", "product portfolio", "multiple markets", "international markets")),
    ("industry", "any", ("fintech", "financial", "health", "healthcare", "medical", "bank", "insurance")),
    ("text", "any", ("international offices", "offices in", "global offices", "worldwide offices", "offices across")),
    ("text", "all", ("on-prem", "cloud")),
)
SPEND_PER_EMPLOYEE = {"infra-heavy": 60, "neutral": 15, "low-infra": 3}
SPEND_EDGES = ((1000, "LOW"), (100_000, "MEDIUM"), (1_000_000, "HIGH"))
SPEND_ABOVE = "VERY_HIGH"
HIGH_SPEND = ("software", "saas", "fintech", "e-commerce", "ecommerce", "marketplace", "media", "streaming", "gaming", "adtech", "data", "analytics", "ai", "machine learning", "telecom", "internet", "cloud", "platform", "logistics tech", "mobility", "ride-hailing", "ride hailing", "on-demand", "delivery", "app", "transportation network")
LOW_SPEND = ("restaurant", "bakery", "retail store", "construction", "law firm", "dental", "hair", "salon", "real estate agency", "farm", "consulting (individual)")
JURISDICTIONS = ("Cuba", "Iran", "North Korea", "Syria", "Russia", "Belarus", "Crimea", "Donetsk", "Luhansk", "Venezuela", "Myanmar")
MARKERS = ("Tehran", "Moscow", "Pyongyang", "Damascus", "Havana", "Minsk", "Caracas", "Naypyidaw")
RESTRICTED_TLDS = {"ir": "Iran", "cu": "Cuba", "kp": "North Korea", "sy": "Syria", "ru": "Russia", "by": "Belarus"}
NAME_FLOOR, DOMAIN_FLOOR, CANDIDATE_FLOOR, WEAK_CAP, KEEP_FLOOR = 95, 90, 85, 89, 70
#: Authority of a headquarters source.
AUTHORITY = {"gleif": "registry", "wikidata": "enrichment", "llm": "inference", "website_tld": "hint"}
