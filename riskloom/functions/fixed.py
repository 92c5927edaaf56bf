"""Word lists, patterns and constants whose values the results depend on."""

# Top-level domains that raise a URL's risk.
SUSPECT_TLDS = (
    "live xyz tk ml cf gq ga buzz click link shop online site top club work vip win loan bid stream download review racing "
    "accountant science party trade webcam zip mov"
).split()

# Brands that pages imitate.
BRANDS = (
    "microsoft outlook onedrive sharepoint office365 hotmail skype azure teams google gmail googleplay googledrive apple icloud itunes appstore "
    "facebook instagram whatsapp messenger twitter linkedin snapchat tiktok telegram paypal cashapp venmo zelle stripe "
    "chase wellsfargo bankofamerica capitalone americanexpress amex citibank barclays hsbc mastercard visa amazon ebay walmart "
    "dhl fedex ups usps royalmail dropbox adobe docusign zoom webex netflix spotify disneyplus coinbase binance metamask ledger kraken irs hmrc"
).split()

# Phrases of credential requests, threats, recovery and file lures.
ACTIONS = (
    r"\bsign[\s\-]?in\b",
    r"\blog[\s\-]?in\b",
    r"\bsign[\s\-]?up\b",
    r"\bauthenticat\w+",
    r"\bcredential\w*",
    r"\bverif(?:y|ied|ication)\b(?:\s+(?:your\s+)?(?:account|identity|email|details?|information|now))?",
    r"\bconfirm(?:ation)?\b(?:\s+(?:your\s+)?(?:account|identity|email|details?|information|now))?",
    r"\bvalidat(?:e|ion|ing)\b(?:\s+(?:your\s+)?(?:account|identity|information))?",
    r"\baccount\s+(?:suspended|disabled|locked|limited|restricted|compromised|violated)\b",
    r"\bunusual\s+(?:activity|sign[\s\-]?in|login|access)\b",
    r"\bsuspicious\s+(?:activity|login|sign[\s\-]?in|access)\b",
    r"\baction\s+required\b",
    r"\bunauthori[sz]ed\s+(?:access|activity|login)\b",
    r"\byour\s+account\s+(?:has been|will be|is)\s+(?:suspended|closed|disabled|locked)\b",
    r"\bpassword\s+(?:reset|expir\w+|recovery)\b",
    r"\brecover\s+(?:your\s+)?(?:account|password)\b",
    r"\bforgot\s+(?:your\s+)?password\b",
    r"\bshared?\s+(?:document|file|folder|link)\b",
    r"\bclick\s+(?:here\s+)?to\s+(?:verify|confirm|access|view|download|validate)\b",
)

# Words of addresses that ask for credentials.
SENSITIVE = "login signin sign-in secure verify confirm update account password credential auth banking payment pay wallet recover reset webscr".split()

# Script and style elements with their content.
SCRIPT_STYLE = r"<(script|style)[^>]*?>.*?</(script|style)>"

# Elements whose number is a feature.
COUNTED_TAGS = "a img script iframe form input link meta button svg".split()

# What challenge pages (as written) and parked pages (in any case) say.
CHALLENGES = [
    "cf-browser-verification",
    "Checking if the site connection is secure",
    "cf_chl_opt",
    "jschl_vc",
    "Please Wait... | Cloudflare",
    "DDoS protection by Cloudflare",
    "cf-mitigated",
]
PARKED = ["This domain is for sale", "domain has expired", "This domain is parked", "GoDaddy", "Namecheap parking"]

# Verdict thresholds.
PHISHING_FROM, SUSPICIOUS_FROM = 0.50, 0.25

# Order of the numeric features.
FEATURES = ["raw_len", "shannon_entropy", *(f"count_tag__{t}" for t in COUNTED_TAGS), "num_unique_tags", "max_dom_depth", "visible_len", "count_external_links", "count_internal_links"]
