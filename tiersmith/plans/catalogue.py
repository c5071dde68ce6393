"""The game-catalogue preset: column names and fixed values for the generic operators.

Every constant below is a fixed value of the data model.
"""

# Ownership range -> tier.
OWNER_TIERS = {
    "0 .. 20,000": 0,
    "20,000 .. 50,000": 1,
    "50,000 .. 100,000": 1,
    "100,000 .. 200,000": 2,
    "200,000 .. 500,000": 2,
    "500,000 .. 1,000,000": 3,
    "1,000,000 .. 2,000,000": 3,
    "2,000,000 .. 5,000,000": 4,
    "5,000,000 .. 10,000,000": 4,
    "10,000,000 .. 20,000,000": 4,
    "20,000,000 .. 50,000,000": 4,
    "50,000,000 .. 100,000,000": 4,
    "100,000,000 .. 200,000,000": 4,
}
TARGET = "target_owners"

TIER_LABELS = {
    0: "Class 0: The Indie Long-Tail (Low Adoption)",
    1: "Class 1: Healthy Niche (Sustainable Indie)",
    2: "Class 2: Mid-Market Success (Breakout Hits)",
    3: "Class 3: Major Success (AA Level / Viral Hits)",
    4: "Class 4: Mega-Hit / Blockbuster (AAA Status)",
}

# CJK ideographs, kana, Hangul, Cyrillic.
FORBIDDEN_SCRIPTS = r"\u4e00-\u9fff\u3040-\u30ff\uac00-\ud7af\u0400-\u04ff"

HARDWARE_PATTERNS = {
    "req_high_end_gpu": r"rtx\s*\d{4}|rx\s*\d{4}|radeon\s*vii",
    "req_dedicated_gpu": r"gtx|geforce|radeon\s*r|nvidia|amd",
    "req_high_cpu": r"i7|i9|ryzen\s*5|ryzen\s*7",
    "req_mid_cpu": r"i5|ryzen\s*3|fx-",
}
REQUIREMENT_COLUMNS = ["pc_requirements", "mac_requirements", "linux_requirements"]
MEMORY_LEVELS = {"minimum": "min_ram_gb", "recommended": "rec_ram_gb"}

PLATFORM_FLAGS = {
    "platforms": {"windows": "platform_windows", "mac": "platform_mac", "linux": "platform_linux"}
}
NESTED_NUMBERS = {"metacritic": ("score", "metacritic_score"), "achievements": ("total", "num_achievements")}
PRESENCE = {
    "controller_support": "is_controller_supported",
    "drm_notice": "has_third_party_drm",
    "ext_user_account_notice": "requires_ext_account",
}
TEXT_COLUMNS = ["name_store", "name", "detailed_description", "short_description"]
REQUIRED_TEXT = ["name_store", "short_description", "detailed_description"]
LIST_COLUMNS = ["categories", "genres", "tags", "publishers", "developers", "languages"]
COERCED_INTS = ["required_age", "average_2weeks", "median_2weeks", "median_forever", "average_forever"]
BINARY_FLAGS = [
    "is_controller_supported",
    "has_third_party_drm",
    "requires_ext_account",
    "platform_windows",
    "platform_mac",
    "platform_linux",
    "req_high_end_gpu",
    "req_dedicated_gpu",
    "req_high_cpu",
    "req_mid_cpu",
]
COLUMN_ORDER = [
    "name", "required_age", "developers", "publishers", "release_year", "release_month",
    "categories", "genres", "tags", "detailed_description", "short_description", "num_dlc", "num_achievements",
    "languages", "num_languages_supported", "metacritic_score", "review_ratio", "is_free", "price", "discount",
]
# The numeric id stays as the row key; everything here leaves before export.
DROPPED = [
    "appid", "name_spy", "type", "fullgame", "score_rank", "userscore",
    "movies", "screenshots", "header_image", "background", "website",
    "pc_requirements", "mac_requirements", "linux_requirements", "reviews", "platforms",
    "owners", "owners_lower_bound", "release_date", "initialprice", "achievements",
    "developer", "publisher", "supported_languages", "metacritic", "price_overview", "about_the_game",
    "packages", "package_groups", "demos", "content_descriptors", "recommendations", "genre", "is_free",
    "ccu", "positive", "negative", "legal_notice", "support_info",
]

NUMERIC_FEATURES = [
    "price", "release_year", "min_ram_gb", "rec_ram_gb", "required_age", "num_dlc", "num_achievements",
    "num_languages_supported", "metacritic_score", "review_ratio", "discount",
    "average_forever", "average_2weeks", "median_forever", "median_2weeks",
]
CATEGORICAL_FEATURES = ["release_month"]
MULTI_HOT = {"categories": "cat", "genres": "genre", "tags": "tag", "languages": "lang"}
CREATORS = {"publishers": "pub", "developers": "dev"}

# Known only after launch; the last four occur in scoring payloads only.
POST_RELEASE = [
    "num_achievements", "metacritic_score", "review_ratio", "num_dlc", "discount",
    "average_forever", "average_2weeks", "median_forever", "median_2weeks",
    "ccu", "positive", "negative", "average_playtime_forever",
]

# Scoring payload: column -> (type, default).
PAYLOAD = {
    "required_age": ("int", 0),
    "developers": ("array<string>", []),
    "publishers": ("array<string>", []),
    "release_year": ("int", 2026),
    "release_month": ("int", 1),
    "categories": ("array<string>", []),
    "genres": ("array<string>", []),
    "tags": ("array<string>", []),
    "detailed_description": ("string", ""),
    "short_description": ("string", ""),
    "num_dlc": ("int", 0),
    "num_achievements": ("int", 0),
    "languages": ("array<string>", []),
    "num_languages_supported": ("int", 0),
    "metacritic_score": ("int", 0),
    "review_ratio": ("double", 0.0),
    "price": ("double", 0.0),
    "discount": ("double", 0.0),
    "average_forever": ("int", 0),
    "average_2weeks": ("int", 0),
    "median_forever": ("int", 0),
    "median_2weeks": ("int", 0),
    "is_controller_supported": ("int", 0),
    "platform_windows": ("int", 1),
    "platform_mac": ("int", 0),
    "platform_linux": ("int", 0),
    "min_ram_gb": ("double", 0.0),
    "rec_ram_gb": ("double", 0.0),
    "req_high_end_gpu": ("int", 0),
    "req_dedicated_gpu": ("int", 0),
    "req_high_cpu": ("int", 0),
    "req_mid_cpu": ("int", 0),
    "has_third_party_drm": ("int", 0),
    "requires_ext_account": ("int", 0),
}

STORE_COLUMNS = [
    "type", "name", "steam_appid", "required_age", "is_free", "controller_support", "dlc",
    "detailed_description", "about_the_game", "short_description", "fullgame", "supported_languages",
    "header_image", "website", "pc_requirements", "mac_requirements", "linux_requirements", "legal_notice",
    "drm_notice", "ext_user_account_notice", "developers", "publishers", "demos", "price_overview", "packages",
    "package_groups", "platforms", "metacritic", "reviews", "categories", "genres", "screenshots", "movies",
    "recommendations", "achievements", "release_date", "support_info", "background", "content_descriptors",
]
USAGE_COLUMNS = [
    "appid", "name", "developer", "publisher", "score_rank", "positive", "negative", "userscore", "owners",
    "average_forever", "average_2weeks", "median_forever", "median_2weeks", "price", "initialprice", "discount",
    "languages", "genre", "ccu", "tags",
]

# Boosting settings per scope.
BOOSTING = {
    "pre": {"trees": 397, "depth": 5, "rate": 0.1074709860640873, "min_rows": 5, "subsample": 0.9652105402477317},
    "post": {"trees": 236, "depth": 7, "rate": 0.14685290784404992, "min_rows": 2, "subsample": 0.9675284682571256},
}
