"""Fixed values that results depend on.

Everything in this module is a plain value: column names of the data model,
numeric constants and small lookup tables.  Continent membership is *not* kept
here because it is larger than a constant should be; it is an input table, see
``placerank.operators.coverage``.
"""

# --- fixed values: geography -------------------------------------------------
RADIUS_M = 1000.0
EARTH_RADIUS_M = 6371000.0
METRES_PER_DEGREE = 111000.0

EUROPE_CODES = [
    "AD", "AL", "AM", "AT", "AX", "AZ", "BA", "BE", "BG", "BY", "CH", "CY", "CZ",
    "DE", "DK", "DZ", "EE", "ES", "FI", "FO", "FR", "GB", "GE", "GG", "GI", "GR",
    "HR", "HU", "IE", "IM", "IQ", "IR", "IS", "IT", "JE", "LI", "LT", "LU", "LV",
    "MC", "MD", "ME", "MK", "MT", "NL", "NO", "PL", "PT", "RO", "RS", "RU", "SE",
    "SI", "SJ", "SK", "SM", "SY", "TN", "TR", "UA", "VA", "XK",
]

TARGET_COUNTRIES = ["FR", "IT", "ES", "GB", "DE"]

CANONICAL_CONTINENTS = {
    "africa": "africa",
    "antarctica": "antarctica",
    "asia": "asia",
    "europe": "europe",
    "north_america": "north_america",
    "south_america": "south_america",
    "oceania": "oceania",
    "central_america": "north_america",
    "australia": "oceania",
    "australia_oceania": "oceania",
    "australia__oceania": "oceania",
}

# Display names of the canonical continents, as the coverage report shows them.
CONTINENT_TITLES = {
    "africa": "Africa",
    "antarctica": "Antarctica",
    "asia": "Asia",
    "europe": "Europe",
    "north_america": "North America",
    "south_america": "South America",
    "oceania": "Oceania",
}

# --- fixed values: points of interest ----------------------------------------
ENV_GROUPS = [
    "culture", "family", "food", "health", "leisure", "nature", "nightlife",
    "services", "shopping", "sightseeing", "supplies", "transport",
]
ENV_COLUMNS = [f"env_{group}" for group in ENV_GROUPS]

# (tag key, tag value) -> (class, group)
POI_CLASSES = {
    ("amenity", "restaurant"): ("restaurant", "Food"),
    ("amenity", "fast_food"): ("fast_food", "Food"),
    ("amenity", "cafe"): ("cafe", "Food"),
    ("amenity", "food_court"): ("food_court", "Food"),
    ("amenity", "ice_cream"): ("ice_cream", "Food"),
    ("amenity", "biergarten"): ("biergarten", "Food"),
    ("amenity", "bar"): ("bar", "Nightlife"),
    ("amenity", "pub"): ("pub", "Nightlife"),
    ("amenity", "nightclub"): ("nightclub", "Nightlife"),
    ("amenity", "casino"): ("casino", "Nightlife"),
    ("tourism", "museum"): ("museum", "Culture"),
    ("amenity", "arts_centre"): ("arts_centre", "Culture"),
    ("amenity", "theatre"): ("theatre", "Culture"),
    ("amenity", "cinema"): ("cinema", "Culture"),
    ("tourism", "gallery"): ("gallery", "Culture"),
    ("amenity", "library"): ("library", "Culture"),
    ("tourism", "attraction"): ("attraction", "Sightseeing"),
    ("tourism", "viewpoint"): ("viewpoint", "Sightseeing"),
    ("tourism", "artwork"): ("artwork", "Sightseeing"),
    ("historic", "monument"): ("monument", "Sightseeing"),
    ("historic", "memorial"): ("memorial", "Sightseeing"),
    ("historic", "castle"): ("castle", "Sightseeing"),
    ("historic", "ruins"): ("ruins", "Sightseeing"),
    ("historic", "archaeological_site"): ("archaeological", "Sightseeing"),
    ("historic", "fort"): ("fort", "Sightseeing"),
    ("amenity", "place_of_worship"): ("place_of_worship", "Sightseeing"),
    ("natural", "beach"): ("beach", "Nature"),
    ("natural", "peak"): ("peak", "Nature"),
    ("natural", "volcano"): ("volcano", "Nature"),
    ("natural", "cave_entrance"): ("cave_entrance", "Nature"),
    ("natural", "glacier"): ("glacier", "Nature"),
    ("leisure", "park"): ("park", "Nature"),
    ("leisure", "garden"): ("garden", "Nature"),
    ("leisure", "nature_reserve"): ("nature_reserve", "Nature"),
    ("leisure", "playground"): ("playground", "Family"),
    ("tourism", "zoo"): ("zoo", "Family"),
    ("leisure", "water_park"): ("water_park", "Family"),
    ("leisure", "swimming_pool"): ("swimming_pool", "Family"),
    ("leisure", "stadium"): ("stadium", "Leisure"),
    ("leisure", "sports_centre"): ("sports_centre", "Leisure"),
    ("leisure", "marina"): ("marina", "Leisure"),
    ("tourism", "picnic_site"): ("picnic_site", "Leisure"),
    ("shop", "supermarket"): ("supermarket", "Supplies"),
    ("shop", "convenience"): ("convenience", "Supplies"),
    ("shop", "bakery"): ("bakery", "Supplies"),
    ("shop", "greengrocer"): ("greengrocer", "Supplies"),
    ("shop", "general"): ("general_store", "Supplies"),
    ("shop", "mall"): ("mall", "Shopping"),
    ("shop", "department_store"): ("department_store", "Shopping"),
    ("shop", "clothes"): ("clothes", "Shopping"),
    ("shop", "gift"): ("gift_shop", "Shopping"),
    ("shop", "books"): ("bookshop", "Shopping"),
    ("tourism", "information"): ("tourist_info", "Services"),
    ("amenity", "toilets"): ("toilets", "Services"),
    ("amenity", "bank"): ("bank", "Services"),
    ("amenity", "atm"): ("atm", "Services"),
    ("amenity", "post_office"): ("post_office", "Services"),
    ("shop", "laundry"): ("laundry", "Services"),
    ("amenity", "car_rental"): ("car_rental", "Services"),
    ("amenity", "bicycle_rental"): ("bicycle_rental", "Services"),
    ("amenity", "travel_agent"): ("travel_agent", "Services"),
    ("amenity", "pharmacy"): ("pharmacy", "Health"),
    ("amenity", "hospital"): ("hospital", "Health"),
    ("amenity", "clinic"): ("clinic", "Health"),
    ("amenity", "doctors"): ("doctors", "Health"),
    ("amenity", "police"): ("police", "Health"),
    ("railway", "station"): ("train_station", "Transport"),
    ("railway", "subway_entrance"): ("subway_entrance", "Transport"),
    ("amenity", "bus_station"): ("bus_station", "Transport"),
    ("amenity", "taxi"): ("taxi", "Transport"),
    ("amenity", "ferry_terminal"): ("ferry_terminal", "Transport"),
    ("amenity", "airport"): ("airport", "Transport"),
}

# Lower number wins when the tags of one element match several groups.
GROUP_PRIORITY = {
    "Accommodation": 1,
    "Sightseeing": 2,
    "Culture": 3,
    "Family": 4,
    "Nightlife": 5,
    "Food": 6,
    "Nature": 7,
    "Transport": 8,
    "Leisure": 9,
    "Shopping": 10,
    "Supplies": 11,
    "Services": 12,
    "Health": 13,
}
ELEMENT_KINDS = ["node", "way", "relation"]
SAMPLE_STEP = 10

# --- fixed values: listing columns -------------------------------------------
RAW_COLUMNS = [
    "property_id", "listing_name", "listing_title", "lat", "long",
    "ratings", "reviews", "property_number_of_reviews",
    "host_rating", "host_number_of_reviews", "host_response_rate",
    "hosts_year", "is_supperhost", "is_guest_favorite",
    "guests", "category", "category_rating",
    "amenities", "description", "description_items", "details",
    "pricing_details", "total_price", "currency",
    "availability", "final_url",
]
REQUIRED_COLUMNS = [
    "property_id", "listing_name", "listing_title", "ratings",
    "is_guest_favorite", "guests", "amenities", "details", "description_items",
]
SIMPLE_DEFAULTS = {
    "property_number_of_reviews": 0,
    "host_number_of_reviews": 0,
    "is_supperhost": 0,
    "is_available": 0,
    "cleaning_fee": 0.0,
    "airbnb_service_fee": 0.0,
    "num_of_nights": 1,
    "taxes": 0.0,
    "special_offer": 0.0,
}
NO_DESCRIPTION = "No description provided"
FINAL_COLUMNS = [
    "property_id", "listing_name", "listing_title",
    "lat", "long", "addr_name", "addr_admin1", "addr_cc",
    "ratings", "property_number_of_reviews",
    "host_rating", "host_number_of_reviews", "host_response_rate",
    "hosts_year", "is_supperhost", "is_guest_favorite",
    "category", "rating_cleanliness", "rating_accuracy", "rating_checkin",
    "rating_communication", "rating_location", "rating_value",
    "amenities", "description", "description_items", "details",
    "price_per_night", "num_of_nights", "guests",
    "is_available", "final_url",
    "room_type_text", "n_beds", "n_baths", "n_bedrooms",
    "amenities_has_text", "amenities_no_text", "amenities_text",
    "custom_text_blob",
]
# category name in the raw JSON -> output column
RATING_COLUMNS = {
    "Cleanliness": "rating_cleanliness",
    "Accuracy": "rating_accuracy",
    "Check-in": "rating_checkin",
    "Communication": "rating_communication",
    "Location": "rating_location",
    "Value": "rating_value",
}
IMPUTED_COLUMNS = [
    "host_rating", "host_response_rate", "hosts_year",
    "rating_cleanliness", "rating_accuracy", "rating_checkin",
    "rating_communication", "rating_location", "rating_value",
    "price_per_night",
]
LOGGED_COLUMNS = [
    "price_per_night", "property_number_of_reviews", "host_number_of_reviews",
]
USD_RATES = {"EUR": 1.08}
PRICE_CAP = 1000.0
PIPELINE_PRICE_CAP = 1300.0

# --- fixed values: listing feature text --------------------------------------
AMENITY_LIMIT = 40
TEXT_ITEM_LIMIT = 10
NOT_INCLUDED_GROUP = "not included"
BEDS_PATTERN = r"(\d+(?:[.,]\d+)?)\s*(?:bed|beds|betten)\b"
BATHS_PATTERN = (
    r"(\d+(?:[.,]\d+)?)\s*"
    r"(?:bath|baths|bathroom|bathrooms|badezimmer|bäder|baeder)\b"
)
BEDROOMS_PATTERN = r"(\d+(?:[.,]\d+)?)\s*(?:bedroom|bedrooms|schlafzimmer)\b"
STUDIO_PATTERN = r"\bstudio\b"

# --- fixed values: scoring, ranking and retrieval ----------------------------
BUDGET_RANKS = {"Budget": 1, "Mid-range": 2, "Luxury": 3}
# The browsing form's shorter vocabulary for the same three levels.
BUDGET_ALIASES = {"low": "Budget", "mid": "Mid-range", "high": "Luxury"}
TEMPERATURE_TOLERANCE = 25.0
TEXT_COLUMNS = ["listing_title", "amenities_text", "room_type_text", "description"]
SCORE_COLUMNS = ["price_score", "property_quality", "host_quality"]
TEMPERATURE_COLUMNS = [f"temp_avg_m{month:02d}" for month in range(1, 13)]
TEXT_BUCKETS = 1 << 18
LSH_BUCKET_LENGTH = 0.5
LSH_TABLES = 3
N_CANDIDATES = 50
SAMPLE_SIZE = 500
SUITE_PICKS = 10
SUITE_MIN_ROWS = 50
BROWSE_LIMIT = 300

PICKER_COLUMNS = [
    "property_id", "addr_cc", "listing_title", "room_type_text",
    "addr_name", "price_per_night", "ratings",
]
DISPLAY_COLUMNS = [
    "listing_title", "room_type_text", "addr_name", "price_per_night",
    "ratings", "final_url",
]
RESULT_COLUMNS = [
    "listing_title", "addr_cc", "addr_name", "room_type_text",
    "price_per_night", "ratings", "final_url",
]
SUITE_REPORT_COLUMNS = [
    "property_id", "addr_cc", "lat", "long", "listing_title", "room_type_text",
    "addr_name", "price_per_night", "ratings", "l2_dist", "cosine_similarity",
    "final_url",
]
DISPLAY_HEADERS = {
    "listing_title": "Listing",
    "addr_cc": "Country",
    "addr_name": "City",
    "room_type_text": "Room Type",
    "price_per_night": "Price ($ / night)",
    "ratings": "Rating",
    "final_score": "Match Score",
    "final_url": "Link",
}

# The English stop words of Spark, in their order.
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these those
am is are was were be been being have has had having do does did doing a an the and but if or because
as until while of at by for with about against between into through during before after above below to
from up down in out on off over under again further then once here there when where why how all any
both each few more most other some such no nor not only own same so than too very s t can will just don
should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's
she's it's we're they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't
don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's
let's ought that's there's what's when's where's who's why's would
""".split()
