"""Fixed values.

Every list, lookup and pattern below decides a result, so it has to hold exactly these entries.
They are plain data: the code that uses them lives in the other modules, and every function that
reads one of them takes it as a parameter with the value here as default.
"""

# --- Fixed values: calendar -------------------------------------------------------------------

MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

MONTH_ALIASES = {
    "Sept": "Sep",
    "January": "Jan", "February": "Feb", "March": "Mar", "April": "Apr", "May": "May",
    "June": "Jun", "July": "Jul", "August": "Aug", "September": "Sep", "October": "Oct",
    "November": "Nov", "December": "Dec",
}

# File name shapes, tried in this order; groups are month, year, extension.
FILE_NAME_PATTERNS = [
    r"^([A-Za-z]{3,9})-(\d{4})\.(xlsx|csv)$",
    r"^.+\s+([A-Za-z]{3,9})\s+(\d{4})\.(xlsx|csv)$",
    r"^([A-Za-z]{3,9})\s+(\d{4})\.(xlsx|csv)$",
]

VOLUME_YEARS = [2023, 2024, 2025]

# --- Fixed values: feed columns ---------------------------------------------------------------

REQUIRED_COLUMNS = ["Title", "Brand", "Availability", "Price range max.", "Popularity rank"]

TITLE_ALIASES = ["Product Title", "Title"]

CSV_ENCODINGS = ["utf-16", "utf-8", "utf-16-le", "utf-16-be", "latin-1", "cp1252"]
CSV_DELIMITERS = ["\t", ",", ";", "|"]
CSV_SKIP_ROWS = [0, 1, 2]
CSV_EXPECTED_COLUMNS = ["popularity rank", "title", "brand", "availability", "price range max"]
CSV_MATCH_WEIGHT = 1000
CSV_COLUMN_WEIGHT = 10

# Cells that mean "no value" in a feed file.
EMPTY_CELLS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
               "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# What issues and reasons say; reports are compared by these texts.
BAD_NAME = "Invalid filename format: "
SECOND_OF_MONTH = "Duplicate file for month: "
UNREADABLE = "Error reading "
MISSING_COLUMN = "Missing required column: "
NO_FILES = "No valid files found in archive"
NO_DECEMBER = "December file is required but missing"
NO_ENTITIES = "No entities extracted for: "
NO_CANDIDATES = "No candidates generated for: "

NO_PRICE = "N/A"
NO_AVAILABILITY = "Potential Gap"
NO_CATEGORY = "Other"
NO_LEVEL1 = "Uncategorized"
NO_BRAND = "Unbranded"

# --- Fixed values: product types --------------------------------------------------------------

PRODUCT_TYPE_ALIASES = {"BWS": "Alcoholic Beverages"}

PRODUCT_TYPES = [
    "F&F (Later)", "Alcoholic Beverages", "Party & Celebration", "Toys", "Baby & Toddler",
    "Health & Beauty", "Sporting Goods", "Home & Garden", "Luggage & Bags", "Furniture",
    "Cameras & Optics", "Hardware", "Pets", "Electronics",
]

DEFAULT_LEVEL1 = {
    "Alcoholic Beverages": "Alcoholic Beverages",
    "BWS": "Alcoholic Beverages",
    "Pets": "Pet Supplies",
    "Electronics": "Electronics",
    "F&F (Later)": "Food & Beverages",
    "Party & Celebration": "Party Supplies",
    "Toys": "Toys & Games",
    "Baby & Toddler": "Baby Products",
    "Health & Beauty": "Health & Beauty",
    "Sporting Goods": "Sports & Fitness",
    "Home & Garden": "Home & Living",
    "Luggage & Bags": "Luggage & Bags",
    "Furniture": "Furniture",
    "Cameras & Optics": "Cameras & Photography",
    "Hardware": "Hardware & Tools",
}

# Top level of a text taxonomy -> product type.
TOP_LEVEL_TYPES = {
    "Animals & Pet Supplies": "Pets",
    "Baby & Toddler": "Baby & Toddler",
    "Electronics": "Electronics",
    "Cameras & Optics": "Cameras & Optics",
    "Sporting Goods": "Sporting Goods",
    "Toys & Games": "Toys",
    "Home & Garden": "Home & Garden",
    "Furniture": "Furniture",
    "Hardware": "Hardware",
    "Luggage & Bags": "Luggage & Bags",
    "Health & Beauty": "Health & Beauty",
    "Food, Beverages & Tobacco": "Alcoholic Beverages",
    "Arts & Entertainment": "Party & Celebration",
}

# --- Fixed values: accessory detection (substrings of the folded title) -----------------------

PHONE_ACCESSORY_TERMS = ["case", "cover", "charger", "cable", "screen protector", "protector",
                         "adapter", "holder", "stand", "mount", "bag"]
PHONE_BRANDS = ["iphone", "galaxy", "pixel", "oneplus", "xiaomi", "oppo", "vivo", "nokia"]
CONTROLLER_TERMS = ["controller", "gamepad", "joystick"]
CAMERA_ACCESSORY_TERMS = ["camera bag", "camera case", "tripod", "filter", "strap", "lens cap",
                          "memory card"]
CAMERA_BRANDS = ["canon", "nikon", "sony", "fujifilm", "panasonic", "olympus"]
PET_FOOD_TERMS = ["food", "treats", "kibble", "wet food", "dry food"]
PET_ACCESSORY_TERMS = ["collar", "leash", "lead", "harness", "bed", "bowl", "toy"]

# Substrings of a category path that each flag asks for.
PHONE_PATHS = ["Phone Accessories", "Phone Cases"]
CONTROLLER_PATHS = ["Controller", "Gamepad"]
CAMERA_ACCESSORY_PATHS = ["Accessories", "Bags", "Tripod"]
PET_FOOD_PATHS = ["Food", "Treats"]
FOOD_PATHS = ["Food"]

# --- Fixed values: keyword index --------------------------------------------------------------

# Words too general to stand alone as a category keyword.
GENERIC_INDEX_WORDS = [
    "rum", "wine", "beer", "whisky", "vodka", "gin", "tequila", "brandy", "cognac", "liqueur",
    "spirits", "champagne", "cider", "food", "supplies", "accessories", "toys", "furniture",
    "clothing", "camera", "lenses", "bag", "bags", "bottle", "bottles", "premium", "classic",
    "special", "original", "traditional", "standard", "basic", "regular", "flavoured", "mixed",
    "dry", "wet", "fresh", "frozen", "canned", "bottled", "organic", "american", "european",
    "asian", "french", "italian", "spanish", "german", "irish", "scottish", "english", "japanese",
    "chinese", "mexican", "and", "for", "the", "with", "&", "baby", "dog", "cat", "pet",
    "samsung", "sony", "lg", "apple", "pro", "max", "ultra",
]

# Path words that are never a taxonomy keyword of their own.
TAXONOMY_STOP_WORDS = ["with", "and", "the", "for"]
TAXONOMY_MIN_WORD = 4
FUZZY_WEIGHT = 0.5
FUZZY_THRESHOLD = 20

# --- Fixed values: accents --------------------------------------------------------------------

ACCENTED = "éèêëáàâäãóòôöõúùûüíìîïñçÉÈÊËÁÀÂÄÃÓÒÔÖÕÚÙÛÜÍÌÎÏÑÇ"
UNACCENTED = "eeeeaaaaaooooouuuuiiiincEEEEAAAAAOOOOOUUUUIIIINC"

# --- Fixed values: shared text patterns -------------------------------------------------------

AGE_PATTERNS = [
    (r"(\d+)\s*[-]?\s*years?\s*[-]?\s*old", "$1yr"),
    (r"(\d+)\s*yo\b", "$1yr"),
]
YEAR_PATTERN = r"\b(19|20)\d{2}\b"

# --- Fixed values: phrase keyword rules -------------------------------------------------------

PHRASE_STOP_WORDS = [
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by",
    "from", "as", "is", "was", "are", "were", "been", "be", "have", "has", "had", "do", "does",
    "did", "will", "would", "could", "should", "may", "might", "must", "shall", "can", "need",
    "this", "that", "these", "those", "it", "its", "up", "out", "if", "about", "into", "through",
    "during", "before", "after", "above", "below", "between", "under", "again", "further", "then",
    "once", "here", "there", "when", "where", "why", "how", "all", "each", "few", "more", "most",
    "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too",
    "very", "just", "also",
    "pack", "packs", "bottle", "bottles", "can", "cans", "box", "boxes", "unit", "units", "piece",
    "pieces", "ml", "cl", "l", "ltr", "litre", "litres", "liter", "liters", "g", "kg", "gram",
    "grams", "kilogram", "oz", "lb", "lbs", "x", "vol", "proof", "s",
]

PHRASE_PROMO_WORDS = [
    "offer", "deal", "discount", "save", "buy", "shop", "bestseller", "welcome", "sale",
    "special", "exclusive", "black", "friday", "cyber", "monday", "free", "delivery", "shipping",
    "stock",
]
PHRASE_GIFT_WORDS = [
    "gift", "gifts", "hamper", "hampers", "present", "presents", "personalised", "personalized",
    "customised", "customized", "engraved", "engraving", "custom", "bespoke",
]
PHRASE_MULTIPACK_WORDS = [
    "case", "cases", "set", "sets", "mixed", "selection", "variety", "multipack", "multi",
    "tasting", "assortment", "pack", "packs", "bundle", "combo", "collection",
]
PHRASE_RETAILER_WORDS = [
    "laithwaites", "waitrose", "tesco", "sainsburys", "asda", "morrisons", "aldi", "lidl",
    "ocado", "amazon", "majestic", "virgin", "wines", "threshers", "nicolas", "oddbins", "berry",
    "bros", "rudd", "cellar", "direct", "online",
]
PHRASE_DESCRIPTOR_WORDS = [
    "tennessee", "kentucky", "scottish", "scotch", "irish", "japanese", "french", "italian",
    "spanish", "german", "australian", "american", "english", "british", "canadian", "mexican",
    "russian", "polish", "dutch", "belgian", "swiss", "new", "zealand", "south", "african",
    "bordeaux", "burgundy", "champagne", "provence", "napa", "sonoma", "highland", "lowland",
    "speyside", "islay", "cornish", "welsh",
    "premium", "classic", "original", "special", "reserve", "select", "finest", "superior",
    "deluxe", "exclusive", "limited", "edition", "old", "aged", "vintage", "rare", "extra",
    "ultra", "super", "blend", "blended", "pure", "natural", "organic", "craft", "small", "batch",
    "handcrafted", "artisan", "traditional",
    "cuvee", "cuvée", "brut", "imperial", "royal", "grand", "cru", "single", "malt", "grain",
    "pot", "still",
]

PHRASE_REMOVE_PATTERNS = [
    r"\d+\s*ml\b", r"\d+\s*cl\b", r"\d+\s*l\b", r"\d+\s*ltr?\b", r"\d+\s*g\b", r"\d+\s*kg\b",
    r"\d+\s*oz\b", r"\d+\s*litre?s?\b", r"\d+\s*miniature",
    r"\d+\s*pack", r"\d+\s*x\s*\d+\s*\w+", r"x\s*\d+", r"\d+\s*bottles?", r"\d+\s*cans?",
    r"\d+\s*%\s*abv", r"\d+\s*%\s*vol", r"\d+\s*%", r"\d+\s*proof", r"\d+\.\d+\s*%",
    r"\b(19|20)\d{2}\b",
    r"\|\s*.*$", r"\(\d+.*?\)", r"\[.*?\]", r"\d{5,}",
]
PHRASE_MAX_WORDS = 4

# --- Fixed values: hybrid keyword rules -------------------------------------------------------

HYBRID_SIZE_PATTERNS = [
    r"\d+\s*ml\b", r"\d+\s*cl\b", r"\d+\s*l\b", r"\d+\s*ltr?\b", r"\d+\s*litre?s?\b",
    r"\d+\s*g\b", r"\d+\s*kg\b", r"\d+\s*oz\b", r"\d+\s*lb\b", r"\d+\s*miniature\b",
    r"\d+\s*pack\b", r"\d+\s*x\s*\d+\s*\w*", r"\d+x\b", r"x\s*\d+", r"\d+\s*bottles?\b",
    r"\d+\s*cans?\b", r"case\s*of\s*\d+",
]
HYBRID_ABV_PATTERNS = [r"\d+\.?\d*\s*%\s*abv", r"\d+\.?\d*\s*%\s*vol", r"\d+\.?\d*\s*%",
                       r"\d+\s*proof"]
HYBRID_MISC_PATTERNS = [r"\|.*$", r"\(.*?\)", r"\[.*?\]", r"\d{5,}"]

HYBRID_GIFT_WORDS = [
    "gift", "gifts", "hamper", "hampers", "present", "presents", "personalised", "personalized",
    "customised", "customized", "engraved", "engraving", "custom", "bespoke", "giftset",
    "gift set", "gift box", "gift pack", "giftbox", "giftpack",
]
HYBRID_MULTIPACK_WORDS = [
    "case", "cases", "mixed", "selection", "variety", "assortment", "multipack", "multi",
    "tasting", "sampler", "bundle", "combo", "collection", "set", "sets", "duo", "trio", "pack",
    "packs",
]
HYBRID_PROMO_WORDS = [
    "offer", "deal", "discount", "save", "buy", "shop", "bestseller", "welcome", "sale",
    "special", "exclusive", "limited", "edition", "black friday", "cyber monday", "free",
    "delivery", "shipping", "stock", "clearance", "reduced", "promo", "promotion", "new",
]
HYBRID_DESCRIPTOR_WORDS = [
    "premium", "classic", "original", "reserve", "select", "finest", "superior", "deluxe",
    "ultra", "super", "blend", "blended", "pure", "natural", "organic", "craft", "artisan",
    "traditional", "handcrafted", "small batch", "smallbatch", "single", "malt", "grain",
    "pot still", "cask", "strength", "cuvee", "cuvée", "brut", "imperial", "royal", "grand",
    "cru", "luxury", "the", "barrel", "sweet", "toast", "american", "oak",
]
HYBRID_RETAILER_NAMES = [
    "laithwaites", "waitrose", "tesco", "sainsburys", "asda", "morrisons", "aldi", "lidl",
    "ocado", "amazon", "majestic", "virgin", "wines", "threshers", "nicolas", "oddbins",
    "berry bros", "rudd", "cellar", "direct", "online", "greene king", "shop", "store", "buy",
    "whisky exchange", "master of malt", "thewhiskyexchange", "masterofmalt", "wine society",
    "winesociety", "personalised gifts shop",
]
HYBRID_TYPE_WORDS = [
    "whisky", "whiskey", "vodka", "gin", "rum", "brandy", "cognac", "tequila", "mezcal",
    "bourbon", "scotch", "liqueur", "liquor",
    "wine", "champagne", "prosecco", "cava", "rose", "rosé", "red", "white", "sparkling", "port",
    "sherry", "vermouth",
    "beer", "lager", "ale", "stout", "ipa", "porter", "pilsner", "cider", "sour",
    "cocktail", "mixer", "tonic", "bitters",
]
HYBRID_BRAND_STOP_WORDS = ["the", "and", "of"]
HYBRID_TITLE_STOP_WORDS = ["the", "and", "for", "with"]

# --- Fixed values: entity keyword rules -------------------------------------------------------

ENTITY_FIELDS = ["brand", "product_name", "vintage", "age_statement", "product_type", "region",
                 "varietal", "pack_format", "collection"]
ENTITY_NOISE_WORDS = [
    "premium", "classic", "original", "reserve", "select", "finest", "superior", "deluxe",
    "ultra", "super", "limited", "edition", "exclusive", "rare", "vintage", "nv", "brut", "sec",
    "demi-sec", "extra", "grand", "cru", "single", "malt", "blend", "blended", "cask",
    "strength", "barrel", "aged", "old", "year", "years", "yo", "gift", "hamper", "selection",
    "collection", "bundle", "miniature", "mini",
]
ENTITY_RETAILER_BRANDS = [
    "majestic", "chosen by majestic", "waitrose", "tesco", "sainsburys", "asda", "lidl", "aldi",
    "morrisons", "co-op", "marks and spencer", "m&s", "laithwaites", "virgin wines",
    "sunday times wine club",
]
TITLE_SEPARATORS = [r"\s+\|\s+", r"\s+-\s+", r"\s+–\s+", r"\s+•\s+"]
PROMO_PART_TERMS = ["mix any", "save", "offer", "deal", "delivery"]
ENTITY_AGE_PATTERN = r"\b(\d+)\s*-?\s*(year|yr|yo)s?\s*(old)?\b"
ENTITY_MAX_WORDS = 5

# Candidate weights.
W_PRODUCT = 5
W_VINTAGE = 4
W_BRAND = 4
W_RETAILER_BRAND = -2
W_BRAND_AGE = 8
W_BRAND_TYPE = 6
W_BRAND_PRODUCT_TYPE = 6
W_CASE = 3
W_LOST_TOKEN = -6
W_VERBOSE_AGE = -5
W_GENERIC = -5

# --- Fixed values: batched answers ------------------------------------------------------------

KEYWORD_BATCH = 20
BACKFILL_BATCH = 30
MAX_ATTEMPTS = 3
MISSING_BRANDS = ["", "nan", "none", "null"]
REFUSED_KEYWORDS = ["blocked", "error"]
CATEGORY_LIST_LIMIT = 100
CATEGORY_LIST_SHOWN = 50
PROMPT_FIELD_CHARS = 100
NO_CATEGORIES_TEXT = "No categories available"
