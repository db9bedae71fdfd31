"""Word lists, code tables, labels and thresholds.

Every value below is part of the data contract (results depend on it) and is
stated as plain data.  Operators take these as default parameters, so another
domain can pass its own lists.
"""

from __future__ import annotations

# -- fixed values: placeholder strings, compared after strip + lower ----------
PLACEHOLDERS: dict[str, tuple[str, ...]] = {
    "fill": ("", "tbd", "unknown", "n/a", "na", "not known", "not available"),
    "write": ("", "tbd", "unknown", "n/a", "null", "pending", "none"),
    "resolve": ("", "unknown", "tbd", "n/a", "null", "pending"),
    "report": ("", "tbd", "unknown", "n/a"),
    "documented": (
        "", "tbd", "unknown", "n/a", "na", "not known", "not available", "not provided",
        "not applicable", "none", "null", "pending", "coming soon", "--", "---", "tba",
        "to be announced", "to be determined",
    ),
    "blocked": ("tbd", "unknown", "n/a", "-", "null"),
}

# -- fixed values: region name -> code ---------------------------------------
US_STATES: dict[str, str] = {
    "Alabama": "AL", "Alaska": "AK", "Arizona": "AZ", "Arkansas": "AR", "California": "CA",
    "Colorado": "CO", "Connecticut": "CT", "Delaware": "DE", "District of Columbia": "DC",
    "Florida": "FL", "Georgia": "GA", "Hawaii": "HI", "Idaho": "ID", "Illinois": "IL",
    "Indiana": "IN", "Iowa": "IA", "Kansas": "KS", "Kentucky": "KY", "Louisiana": "LA",
    "Maine": "ME", "Maryland": "MD", "Massachusetts": "MA", "Michigan": "MI",
    "Minnesota": "MN", "Mississippi": "MS", "Missouri": "MO", "Montana": "MT",
    "Nebraska": "NE", "Nevada": "NV", "New Hampshire": "NH", "New Jersey": "NJ",
    "New Mexico": "NM", "New York": "NY", "North Carolina": "NC", "North Dakota": "ND",
    "Ohio": "OH", "Oklahoma": "OK", "Oregon": "OR", "Pennsylvania": "PA",
    "Rhode Island": "RI", "South Carolina": "SC", "South Dakota": "SD", "Tennessee": "TN",
    "Texas": "TX", "Utah": "UT", "Vermont": "VT", "Virginia": "VA", "Washington": "WA",
    "West Virginia": "WV", "Wisconsin": "WI", "Wyoming": "WY",
}
FOREIGN_CODE = "ZZ"
FOREIGN_NAME = "International"
# A city equal to one of these is a mis-parsed address (the district is a real city name).
STATE_NAMES: tuple[str, ...] = tuple(n for n in US_STATES if n != "District of Columbia")

# -- fixed values: city tiers, derivation variant (lists, then population) ----
TIER_1_CITIES: tuple[str, ...] = (
    "New York", "Los Angeles", "Chicago", "Houston", "Phoenix", "Philadelphia", "San Antonio",
    "San Diego", "Dallas", "San Jose", "Austin", "Jacksonville", "Fort Worth", "Columbus",
    "Charlotte", "San Francisco", "Indianapolis", "Seattle", "Denver", "Washington", "Boston",
    "Detroit", "Nashville", "Portland", "Las Vegas", "Memphis", "Louisville", "Baltimore",
    "Milwaukee", "Albuquerque", "Tucson", "Fresno", "Sacramento", "Kansas City", "Atlanta",
    "Miami", "Minneapolis", "Cleveland", "New Orleans", "Oakland", "Tampa", "Honolulu", "Omaha",
    "Wichita", "Arlington", "Raleigh", "Virginia Beach", "Long Beach", "Colorado Springs",
    "Tulsa", "Oklahoma City", "Santa Fe", "Williamsburg", "Cambridge", "Berkeley", "Ann Arbor",
    "Sarasota", "Palm Beach", "Pasadena", "Santa Barbara", "Savannah", "Charleston", "Newport",
    "Providence", "New Haven", "Pittsburgh", "St. Louis", "Cincinnati", "Buffalo", "Richmond",
    "Hartford",
)
TIER_2_CITIES: tuple[str, ...] = (
    "Boise", "Salt Lake City", "Des Moines", "Madison", "Little Rock", "Jackson", "Montgomery",
    "Tallahassee", "Springfield", "Lansing", "Harrisburg", "Trenton", "Albany", "Concord",
    "Montpelier", "Augusta", "Olympia", "Salem", "Carson City", "Helena", "Bismarck", "Pierre",
    "Cheyenne", "Topeka", "Lincoln", "Jefferson City", "Frankfort", "Ithaca", "Chapel Hill",
    "Charlottesville", "Princeton", "Amherst", "Hanover", "Oberlin", "Bloomington", "Eugene",
    "Boulder", "Durham", "Bentonville", "Marfa", "Taos", "Sedona", "Asheville", "Woodstock",
    "Ogunquit", "Provincetown", "Carmel", "Laguna Beach", "St. Petersburg",
)
# -- fixed values: city tiers, index variant (lists only) ---------------------
INDEX_TIER_1_CITIES: tuple[str, ...] = (
    "New York", "Los Angeles", "Chicago", "Houston", "Phoenix", "Philadelphia", "San Antonio",
    "San Diego", "Dallas", "San Jose", "Austin", "Jacksonville", "Fort Worth", "Columbus",
    "Charlotte", "San Francisco", "Indianapolis", "Seattle", "Denver", "Washington", "Boston",
    "Detroit", "Nashville", "Portland", "Las Vegas", "Memphis", "Louisville", "Baltimore",
    "Milwaukee", "Albuquerque", "Tucson", "Fresno", "Sacramento", "Kansas City", "Atlanta",
    "Miami", "Minneapolis", "Cleveland", "New Orleans", "Oakland", "Tampa", "Honolulu", "Omaha",
    "Wichita", "Arlington",
)
INDEX_TIER_2_CITIES: tuple[str, ...] = (
    "Santa Fe", "Williamsburg", "Annapolis", "Cambridge", "Berkeley", "Ann Arbor", "Asheville",
    "Savannah", "Charleston",
)
TIER_POPULATION = (500_000, 50_000)

# -- fixed values: visit length ----------------------------------------------
QUICK, HALF, FULL = "Quick stop (<1 hr)", "Half day", "Full day"
VISIT_KEYWORDS: tuple[tuple[str, tuple[str, ...]], ...] = (
    (FULL, ("encyclopedic", "natural history", "science center", "large complex",
            "museum campus", "smithsonian", "metropolitan", "national gallery")),
    (QUICK, ("historic house", "historic site", "house museum", "small gallery",
             "local history", "heritage center", "memorial", "monument")),
)
VISIT_SYNONYMS: dict[str, str] = {
    "quick stop (<1 hr)": QUICK, "half day": HALF, "full day": FULL,
    "quick stop": QUICK, "quick stop (1-2 hours)": QUICK, "1-2 hours": QUICK, "<1 hr": QUICK,
    "half day (2-4 hours)": HALF, "2-4 hours": HALF, "half-day": HALF,
    "full day (4+ hours)": FULL, "4+ hours": FULL,
}
DOMAINS: tuple[str, ...] = ("Art", "History", "Science", "Culture", "Specialty", "Mixed")

# -- fixed values: type names; order matters for the containment fallback -----
TYPE_MAP: tuple[tuple[str, str], ...] = (
    ("art museum", "Art Museum"), ("art", "Art Museum"), ("fine art", "Fine Art"),
    ("contemporary art", "Contemporary Art"), ("modern art", "Modern Art"),
    ("art center", "Art Center"), ("art gallery", "Art Gallery"),
    ("university art museum", "University Art Museum"),
    ("university museum", "University Art Museum"),
    ("college art museum", "University Art Museum"),
    ("art (encyclopedic)", "Encyclopedic Art Museum"),
    ("art (modern/contemporary)", "Contemporary Art"),
    ("history museum", "History Museum"), ("history", "History Museum"),
    ("historic house", "Historic House"), ("historic site", "Historic Site"),
    ("historic preservation", "Historic Preservation"),
    ("heritage museum", "Heritage Museum"), ("heritage center", "Heritage Center"),
    ("science museum", "Science Museum"), ("science center", "Science Center"),
    ("science & technology museum or planetarium", "Science Museum"),
    ("natural history", "Natural History Museum"),
    ("natural history museum", "Natural History Museum"),
    ("children's museum", "Children's Museum"), ("childrens museum", "Children's Museum"),
    ("kids museum", "Children's Museum"),
    ("arboretum, botanical garden, or nature center", "Botanical Garden"),
    ("botanical garden", "Botanical Garden"), ("nature center", "Nature Center"),
    ("zoo, aquarium, or wildlife conservation", "Zoo/Aquarium"), ("zoo", "Zoo/Aquarium"),
    ("aquarium", "Zoo/Aquarium"), ("cultural center", "Cultural Center"),
    ("cultural museum", "Cultural Center"), ("ethnic museum", "Cultural Center"),
    ("general museum", "General Museum"), ("general", "General Museum"),
    ("specialty museum", "Specialty Museum"), ("specialty", "Specialty Museum"),
    ("memorial", "Memorial"), ("hall of fame", "Hall of Fame"), ("unknown", "Unknown"),
)
SCOREABLE_TYPES: tuple[str, ...] = (
    "Fine Art", "Contemporary Art", "Modern Art", "University Art Museum",
    "Encyclopedic Art Museum", "Art Museum", "Art Center", "Art Gallery",
)
ART_KEYWORDS: tuple[str, ...] = ("art", "arte", "kunst", "gallery", "contemporary")

# -- fixed values: words dropped before fuzzy name comparison -----------------
NAME_STOP_WORDS: tuple[str, ...] = (
    "museum", "center", "centre", "gallery", "galleries", "institute", "foundation", "inc",
    "incorporated", "society", "association", "the", "of", "and", "for",
)

# -- fixed values: ordinal labels --------------------------------------------
REPUTATION_LABELS = {0: "International", 1: "National", 2: "Regional", 3: "Local"}
COLLECTION_LABELS = {
    5: "Canon-Defining", 4: "Major Scholarly", 3: "Strong Regional", 2: "Modest", 1: "Limited",
    0: "None",
}
ECA_LABELS = {
    5: "Field-Shaping", 4: "Nationally Recognized", 3: "Strong Regional", 2: "Competent",
    1: "Minimal", 0: "None",
}
CONTEXT_COLLECTION_LABELS = {**COLLECTION_LABELS, 0: "No Collection"}
REPUTATION_ORDER = {"Local": 1, "Regional": 2, "National": 3, "International": 4}
COLLECTION_TIER_ORDER = {"Small": 1, "Moderate": 2, "Strong": 3, "Flagship": 4}

# -- fixed values: dimension scores shown as "top scores", in tie order -------
DIMENSIONS: tuple[tuple[str, str], ...] = (
    ("contemporary_score", "Contemporary"), ("modern_score", "Modern"),
    ("impressionist_score", "Impressionist"), ("expressionist_score", "Expressionist"),
    ("classical_score", "Classical"), ("american_art_score", "American Art"),
    ("european_art_score", "European Art"), ("asian_art_score", "Asian Art"),
    ("african_art_score", "African Art"), ("painting_score", "Painting"),
    ("sculpture_score", "Sculpture"), ("decorative_arts_score", "Decorative Arts"),
    ("photography_score", "Photography"),
)
EXPERIENCE_DIMENSIONS: tuple[str, ...] = (
    "collection_depth", "collection_quality", "exhibition_frequency", "family_friendly_score",
    "educational_value_score", "architecture_score",
)
SUMMARY_FIELDS: tuple[str, ...] = (
    "summary_short", "summary_long", "collection_highlights", "signature_artists",
    "visitor_tips", "best_for",
)

# -- fixed values: trust ladder ----------------------------------------------
TRUST_LEVELS = {
    "unknown": 0, "llm_guess": 1, "llm_extracted": 2, "wikipedia": 3, "wikidata": 4,
    "official_extract": 5, "official_json_ld": 6, "manual_override": 10,
}

# -- fixed values: completeness profiles -------------------------------------
SCHEMA_FIELDS: tuple[str, ...] = (
    "museum_id", "country", "state_province", "city", "museum_name", "website", "museum_type",
    "street_address", "postal_code",
)
PROGRESS_FIELDS: tuple[str, ...] = (
    "city_tier", "museum_type", "status", "reputation", "collection_tier", "time_needed",
    "nearby_museum_count", "notes", "data_sources", "confidence",
)
ART_FIELDS: tuple[str, ...] = (
    "impressionist_strength", "modern_contemporary_strength", "primary_art",
    "historical_context_score", "priority_score", "is_scored",
)
REPORT_FIELDS: tuple[str, ...] = (
    "primary_domain", "status", "reputation", "collection_tier", "notes", "data_sources",
    "confidence",
)

# -- fixed values: curated sheet headers -> field, (field is an integer) ------
SHEET_HEADERS: tuple[tuple[str, str, bool], ...] = (
    ("Museum Name", "museum_name", False), ("Priority Score", "priority_score", True),
    ("Outcome Tier", "outcome_tier", False), ("Consider Label", "consider_label", False),
    ("Historical Context", "historical_context", True),
    ("Impressionist Strength", "impressionist_strength", True),
    ("Modern/ Contemporary Strength", "modern_contemporary_strength", True),
    ("Traditional / Pre‑Modern Art Strength", "traditional_strength", True),
    ("Exhibition-Centric Advantage (ECA)", "exhibition_advantage", True),
    ("Collection-Based PAS", "collection_pas", True), ("Effective PAS", "effective_pas", True),
    ("Reputation Level", "reputation_level", False),
    ("Collection Level", "collection_level", False), ("Notes", "notes", False),
)

# -- fixed values: export columns and headers --------------------------------
EXPORT_COLUMNS: tuple[tuple[str, str], ...] = (
    ("state_province", "State"), ("city", "City"), ("museum_name", "Museum Name"),
    ("museum_type", "Type"), ("primary_domain", "Domain"), ("time_needed", "Time Needed"),
    ("reputation", "Reputation"), ("collection_based_strength", "Collection Strength"),
    ("eca_score", "ECA Score"), ("overall_quality_score", "Quality Score"),
    ("priority_score", "Priority Score"), ("nearby_museum_count", "Nearby Museums"),
    ("impressionist_strength", "Impressionist Strength"),
    ("modern_contemporary_strength", "Modern/Contemporary Strength"),
    ("historical_context_score", "Historical Context"),
    ("must_see_candidate", "Must-See Candidate"), ("website", "Website"),
    ("street_address", "Address"), ("postal_code", "Postal Code"), ("latitude", "Latitude"),
    ("longitude", "Longitude"), ("phone", "Phone"),
)
EXPORT_COLUMNS_SHORT: tuple[tuple[str, str], ...] = (
    ("state_province", "State"), ("city", "City"), ("museum_name", "Museum Name"),
    ("museum_type", "Type"), ("primary_domain", "Domain"), ("time_needed", "Time Needed"),
    ("reputation", "Reputation"), ("collection_tier", "Collection Tier"),
    ("priority_score", "Priority Score"), ("website", "Website"), ("street_address", "Address"),
    ("postal_code", "Postal Code"), ("latitude", "Latitude"), ("longitude", "Longitude"),
    ("phone", "Phone"), ("status", "Status"),
    ("estimated_visit_minutes", "Visit Duration (min)"),
)
EXPORT_LABELS = {
    "reputation": REPUTATION_LABELS,
    "collection_based_strength": COLLECTION_LABELS,
    "eca_score": ECA_LABELS,
}

# -- fixed values: web page keywords -----------------------------------------
VISITOR_LINKS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "hours": (("hours", "visit", "plan your visit", "plan visit"), ("/visit", "/hours", "/plan")),
    "tickets": (("tickets", "admission", "pricing", "membership"),
                ("/tickets", "/admission", "/visit")),
    "accessibility": (("accessibility", "accessible", "ada"), ("/accessibility", "/accessible")),
}
SECTION_KEYWORDS: dict[str, tuple[str, ...]] = {
    "hours": ("hours", "open", "schedule", "when to visit"),
    "admission": ("admission", "tickets", "pricing", "fees", "cost"),
    "accessibility": ("accessibility", "accessible", "ada", "wheelchair"),
    "collections": ("collection", "exhibitions", "galleries", "permanent"),
}

# -- fixed values: city types of address components, by preference ------------
CITY_COMPONENTS: tuple[str, ...] = (
    "locality", "sublocality_level_1", "postal_town", "administrative_area_level_3",
)

# -- fixed values: rollout order (region codes per wave) ----------------------
ROLLOUT_WAVES: tuple[tuple[str, ...], ...] = (
    ("IL",), ("MA", "NY", "PA", "CT"), ("CA",),
)
