"""Patterns, word lists, lookup tables and thresholds.

Everything in this module must equal the published definitions for results to
agree, so each value is stated once, plainly, in its natural order.
"""

# --- fixed values: entity patterns (``\b`` is written here as in ASCII dialects) ---
EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE_PATTERN = r"\b(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"
CARD_PATTERN = r"\b(?:\d[ -]*?){13,16}\b"
PASSPORT_PATTERN = r"\b[A-PR-WYa-pr-wy]\d{7}\b"
LABELLED_NAME_PATTERN = r"(?i)(?:NAME|PASSENGER|USER|PERSON):\s*([A-Z][a-z]+\s+[A-Z][a-z]+)"
KNOWN_NAMES = ("John Smith", "Jane Doe", "Alice Johnson", "Bob Williams")
SECRET_PATTERN = r"(?i)\b(?:pass123!|secret123|password:?\s*\S+)\b"
TOKEN_PATTERN = r"[A-Z]+#[A-F0-9]+"

# --- fixed values: masks ---
BULLETS8 = "•" * 8
CARD_MASK = "••••-••••-••••-"

# --- fixed values: (type, confidence, sensitivity, default necessity, default treatment) ---
TEXT_ENTITY_SPECS = {
    "EMAIL": (0.97, "HIGH", "HIGH", "TOKENIZE"),
    "PHONE": (0.93, "HIGH", "MEDIUM", "TOKENIZE"),
    "CREDIT_CARD": (0.98, "CRITICAL", "NONE", "REMOVE"),
    "GOVT_ID": (0.95, "CRITICAL", "NONE", "REMOVE"),
    "NAME": (0.91, "MEDIUM", "HIGH", "TOKENIZE"),
    "PASSWORD": (0.98, "CRITICAL", "NONE", "REMOVE"),
}
REGION_CONFIDENCE = {
    "EMAIL": 0.95,
    "CREDIT_CARD": 0.96,
    "GOVT_ID": 0.94,
    "PHONE": 0.92,
    "NAME": 0.91,
    "PASSWORD": 0.98,
}
REGION_SKIP_MARKS = ("PERSON#", "EMAIL#", "PHONE#", "[REDACTED]")
ATTRIBUTE_CONFIDENCE = {"PASSWORD": 0.99, "GOVT_ID": 0.98, "CREDIT_CARD": 0.95}
UNVERIFIED_TYPE = "UNVERIFIED_VISUAL_REGION"
UNVERIFIED_CONFIDENCE = 0.50

# --- fixed values: disclosure policy ---
CONFIDENCE_THRESHOLD = 0.80
FAIL_CLOSED_TREATMENT = "REMOVE"
SENSITIVITY_WEIGHTS = {"CRITICAL": 1.0, "HIGH": 0.8, "MEDIUM": 0.5, "LOW": 0.2}
POLICY_MATRIX = [
    ("CRITICAL", "HIGH", "LOCAL_ONLY"),
    ("CRITICAL", "MEDIUM", "REMOVE"),
    ("CRITICAL", "LOW", "REMOVE"),
    ("CRITICAL", "NONE", "REMOVE"),
    ("HIGH", "HIGH", "TOKENIZE"),
    ("HIGH", "MEDIUM", "TOKENIZE"),
    ("HIGH", "LOW", "REMOVE"),
    ("HIGH", "NONE", "REMOVE"),
    ("MEDIUM", "HIGH", "TOKENIZE"),
    ("MEDIUM", "MEDIUM", "ABSTRACT"),
    ("MEDIUM", "LOW", "MASK"),
    ("MEDIUM", "NONE", "MASK"),
    ("LOW", "HIGH", "KEEP"),
    ("LOW", "MEDIUM", "KEEP"),
    ("LOW", "LOW", "MASK"),
    ("LOW", "NONE", "MASK"),
]
VAULT_TTL_MINUTES = 15
TOKEN_PREFIXES = {"NAME": "PERSON", "EMAIL": "EMAIL"}
TOKEN_DEFAULT_PREFIX = "TOKEN"

# --- fixed values: intent rules ---
BOOKING_WORDS = ("flight", "book", "ticket", "airline")
CHECKOUT_WORDS = ("buy", "checkout", "shop")
FORBIDDEN_CLASSES = (
    "password",
    "credit_card",
    "cvv",
    "passport",
    "bank_account",
    "exfiltrate",
    "delete_account",
)
BOOKING_CLASSES = ("origin_city", "destination_city", "passenger_name", "passenger_email")
CHECKOUT_CLASSES = ("shipping_address", "item_quantity")
PERMITTED_ACTIONS = ("CLICK", "TYPE", "SELECT", "SCROLL", "NAVIGATE", "HOVER", "WAIT")
MAX_STEPS = 12

# --- fixed values: character look-alikes, mapped before lower-casing ---
HOMOGLYPHS = {
    "е": "e", "а": "a", "о": "o", "р": "p", "с": "c", "х": "x",
    "у": "y", "і": "i", "ј": "j", "к": "k", "в": "b", "м": "m",
    "н": "h", "т": "t",
    "Ε": "E", "Α": "A", "Ο": "O", "Ρ": "P", "С": "C", "Х": "X",
    "Υ": "Y", "Ι": "I", "Ј": "J", "К": "K", "В": "B", "М": "M",
    "Н": "H", "Т": "T",
    "0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "8": "b",
}

# --- fixed values: threat terms ---
INJECTION_TERMS = (
    "ignore previous", "system override", "transfer", "delete account", "exfiltrate",
    "evil.com", "override targetgoal", "phishing", "token vault", "eval(", "raw passport",
    "malicious", "system command", "roleplay", "hidden css", "image alt", "attacker",
    "mde_bypass", "origin_spoof", "stale node", "phishing_alert", "token_dump",
    "window.fetch", "auto_submit", "webhook", "destructive", "firewall_bypass",
    "attestation_bypass", "svg comment", "attacker location", "sql injection",
    "action_chaining", "anchor_task_mutation", "anchor_origin_mutation", "token_replay",
    "account_reset", "cvv_harvesting", "document_write", "clickjacking",
    "placeholder_injection", "capability_escalation", "top_frame_hijack", "silent_payment",
    "validator_spoof",
)
PROMPT_SCREEN_TERMS = (
    "ignore previous", "system override", "transfer", "delete account", "exfiltrate",
    "evil.com", "override targetgoal", "phishing", "reveal local token", "eval(",
    "send raw passport", "malicious.xyz", "exfiltrate_data", "developer mode ai",
    "hidden css", "image alt injection", "attacker@evil.org", "bypassing minimum disclosure",
    "banking-phish", "stale node", "phishing alert", "dump token vault", "window.fetch",
    "instruction override", "webhook.site", "delete local storage", "bypass action firewall",
    "force network egress", "secret instruction in svg", "subtle prompt injection",
    "badactor@attacker", "phish-bank.com", "sql injection", "action chaining exploit",
    "task_override_999", "unauthorized-domain", "token_replay_attack", "reset security questions",
    "cvv_harvesting", "document.write", "clickjacking_overlay", "placeholder_injection",
    "policy_bypass", "capability_escalation", "vault_dict_leak", "top_frame_hijack",
    "hidden_input_injection", "silent_payment_exploit", "visual_canvas_exfiltration",
    "validator_spoof", "helper@service.com", "social engineering:", "chain_exfiltrate",
    "target_swap", "visual_ocr_injection", "vault_export", "domain_wildcard", "data_purge",
    "svg_xss", "canvas_exfiltration", "mde_matrix_override", "slot_payload", "card_chain",
    "fake_modal", "css_content", "cross_tab_eavesdrop", "encoded_risk", "zero_opacity",
    "hash_tampering", "worker_script", "subtle_email", "account_suspension",
    "phish_chain", "offscreen_bounds", "ocr_token", "fail_closed_bypass",
    "shell_capability", "clear_cookies", "mathml_xss", "sanitized_dom_exfiltrate",
    "threshold_zero", "destination_script", "unauthorized_pay", "extension_update",
    "attribute_title", "content_fetch", "subdomain_origin", "canvas_overlay",
    "goal_unrestricted", "service_worker_injection", "name_alias", "passport_update",
    "passport_post", "root_target", "visual_script", "password_remove",
    "dataclass_wildcard", "revoke_permissions", "srcdoc_xss", "ledger_exfiltration",
    "relocate", "export", "dump", "transmit", "mirror", "offload", "sync", "vault export",
    "data:", "javascript:", "blob:", "file:", "base64",
)
GOAL_REASONING_TERMS = {
    "flight_booking": (
        "delete account", "transfer", "exfiltrate", "evil.com", "phishing", "token vault",
        "sql", "script", "drop table", "eval",
    ),
}
GOAL_VALUE_TERMS = {
    "flight_booking": (
        "@attacker", "http://", "https://", "eval(", "document.cookie", "window.fetch",
    ),
}
SYNONYM_CLUSTERS = {
    "transfer": (
        "relocate", "export", "dump", "transmit", "mirror", "offload", "sync",
        "dispatch payload", "vault export", "credential extraction", "reallocate",
        "asset move", "transfer $",
    ),
    "delete": (
        "purge", "wipe", "destroy", "erase", "clear all", "reset credentials", "terminate",
    ),
    "exfiltrate": ("harvest", "leak", "extract", "steal", "send to remote", "webhook"),
}
# Not a published value: clusters reached by the class they are meant for (unless compat).
CLUSTERS_OF_CLASS = {"delete_account": ("delete",), "exfiltrate": ("exfiltrate", "transfer")}
FORBIDDEN_SCHEMES = ("data:", "javascript:", "blob:", "file:")
FORBIDDEN_NAV_MARKS = ("data:text/html", "base64")

# --- fixed values: tokens, captures, grounding ---
AUTH_TTL_SECONDS = 30
CAPTURE_MAX_AGE_MS = 5000
GROUNDING_MAX_AGE_MS = 10000
GROUNDING_MAX_SHIFT = 35
SIGNATURE_PREFIX = "sha256_hmac_"

# --- fixed values: which region types an action may bind to ---
ACTION_COMPATIBILITY = {
    "CLICK": (
        "VISUAL_BUTTON", "VISUAL_INPUT", "VISUAL_CHECKBOX_RADIO", "VISUAL_CARD",
        "VISUAL_NAVIGATION", "VISUAL_IMAGE", "VISUAL_ICON", "VISUAL_INTERACTIVE",
    ),
    "TYPE": ("VISUAL_INPUT",),
    "SELECT": ("VISUAL_CHECKBOX_RADIO", "VISUAL_INPUT", "VISUAL_INTERACTIVE"),
    "HOVER": (
        "VISUAL_BUTTON", "VISUAL_INPUT", "VISUAL_CHECKBOX_RADIO", "VISUAL_CARD",
        "VISUAL_NAVIGATION", "VISUAL_IMAGE", "VISUAL_ICON", "VISUAL_INTERACTIVE",
    ),
}

# --- fixed values: detector classes and evaluation constants ---
UI_CLASSES = (
    "button", "input", "checkbox", "radio", "select", "link", "navigation", "card", "image",
    "icon", "text_block",
)
REGION_TYPE_OF_CLASS = {
    "button": "VISUAL_BUTTON",
    "input": "VISUAL_INPUT",
    "checkbox": "VISUAL_CHECKBOX_RADIO",
    "radio": "VISUAL_CHECKBOX_RADIO",
    "card": "VISUAL_CARD",
    "navigation": "VISUAL_NAVIGATION",
}
MATCH_IOU = 0.30
NMS_IOU = 0.40
SWEEP_THRESHOLDS = (
    0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.60, 0.70, 0.80, 0.90,
)
CALIBRATION_THRESHOLDS = (
    0.01, 0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90, 0.95,
)
