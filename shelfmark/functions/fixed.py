"""Fixed values.

Word lists, enumerations and lookup tables that are part of the catalogue's contract: results are only
right if they are exactly these. Everything here is plain data; the logic that uses it lives elsewhere.
"""

# --- statuses and field names -------------------------------------------------------------------------
STATUSES = ["Approved", "Ready_For_Review", "Pending", "Blocked", "Skipped", "Deferred"]

# Provenance-tracked fields: each has a Raw_, a Source_ and a Tier_ column.
PROVENANCE_FIELDS = [
    "Title", "Subtitle", "MRP_Scraped",
    "Spec_Capacity", "Spec_Output", "Spec_Ports", "Spec_Weight", "Spec_Warranty",
    "Bullet_1", "Bullet_2", "Bullet_3", "Bullet_4",
]
OVERRIDE_FIELDS = [
    "Title", "Subtitle", "DP", "MRP",
    "Spec_Capacity", "Spec_Output", "Spec_Ports", "Spec_Weight", "Spec_Warranty",
    "Bullet_1", "Bullet_2", "Bullet_3", "Bullet_4", "Image_Path",
]
SPEC_FIELDS = ["Spec_Capacity", "Spec_Output", "Spec_Ports", "Spec_Weight", "Spec_Warranty"]
BULLETS = ["Bullet_1", "Bullet_2", "Bullet_3", "Bullet_4"]

# --- matching -----------------------------------------------------------------------------------------
DEFAULT_QUALIFIERS = ["Max", "Ultra", "Plus", "Pro", "Mini", "Lite", "Go"]
MATCH_STOP_WORDS = [
    "pb", "powerbank", "power", "bank", "portable", "charger", "fast", "charging", "series", "the", "with",
    "and", "in", "for", "customized", "custom", "suction",
]
NEAR_MISS_GENERIC = [
    "pb", "powerbank", "power", "bank", "portable", "charger", "earbuds", "headphones", "tws", "wireless",
]
CATEGORY_DESCRIPTORS = {
    "powerbank": ["powerbank", "powerbanks", "power", "bank", "banks", "pb"],
    "tws": ["buds", "bud", "tws", "earbuds", "earbud", "earphones", "earphone", "headphones", "headphone",
            "airbuds", "airbud", "truly"],
    "audio": ["audio", "headphones", "headphone", "earphones", "earphone", "speaker", "speakers", "soundbar",
              "soundbars", "buds", "earbuds"],
    "smartwatch": ["smartwatch", "smartwatches", "watch", "watches", "band", "bands", "wearable"],
    "generic": [],
}
LISTING_NOISE = [
    "black", "white", "blue", "grey", "gray", "green", "pink", "red", "silver", "gold", "purple", "yellow",
    "orange", "beige", "cream", "navy", "teal", "maroon", "brown", "by",
]
LISTING_NOISE_SOUND = ["bluetooth", "wireless", "mic", "true", "ear"]
KNOWN_BRANDS = [
    "stuffcool", "pebble", "portronics", "urbn", "evm", "ambrane", "glow gadget", "wangari", "jbl", "boat",
    "boult audio", "boult", "goboult", "noise", "ptron", "mivi", "crossbeats", "zebronics", "realme", "redmi",
    "xiaomi", "oneplus", "oppo", "vivo", "apple", "samsung", "sony", "anker", "belkin", "hammer", "wings",
    "truke", "skullcandy", "marshall", "sennheiser", "bose", "soundcore", "philips", "panasonic", "jabra",
    "infinity", "fire-boltt", "beatxp", "unix", "ubon", "syska", "mi", "nothing", "cmf", "honor", "motorola",
    "lenovo",
]
COMPATIBILITY_BEFORE = r"\b(?:for|with|compatible with|compatible|supports|suitable for|designed for)$"
DEVICE_AFTER = r"^(?:watch|iphone|ipad|macbook|airpods|galaxy|pixel|phone|devices|cables?)\b"

# Where a product name stops and its specification begins.
LEADING_FIGURES = r"^(?:\s*(?:\d+(?:,\d+)?\s*mah|\d+k\b|\d+(?:\.\d+)?\s*w\b))+\s*"
NAME_STOP = (
    r"\b(?:\d+(?:,\d+)?\s*mah|\d+k\b|\d+(?:\.\d+)?\s*w\b|qi\d*(?:\.\d+)?|certified|power\s*bank|powerbank|charger|"
    r"with\s+built|with\s+type|with\s+stand|made\s+in)\b"
)
DISPLAY_STOP = (
    r"\b(?:true\s+wireless|wireless|earbuds?|earphones?|headphones?|neckband|tws|anc|in\s+ear|over\s+ear|on\s+ear|"
    r"noise\s+cancell?(?:ing|ation)|adaptive|spatial|smart\s+ambient|hi\s*[- ]?res|bluetooth|\d+(?:,\d+)?\s*mah|"
    r"\d+k\b|\d+(?:\.\d+)?\s*w\b|qi\d*|power\s*bank|powerbank|charger|with\s+built|with\s+type|with\s+stand|"
    r"made\s+in|premium)\b"
)
DISPLAY_DROPPABLE = [
    "buds", "bud", "earbuds", "earbud", "tws", "earphones", "earphone", "headphones", "headphone", "neckband",
    "wireless", "true", "truly", "power", "bank", "powerbank", "charger", "speaker", "black", "white", "blue",
    "grey", "gray", "green", "pink", "red", "silver", "gold", "purple",
]
QUALIFIER_EXCLUDED = [
    "powerbank", "power", "bank", "charger", "portable", "battery", "mah", "cable", "watt", "watts", "volt",
    "volts", "black", "white", "blue", "grey", "gray", "green", "red", "purple", "metallic", "with", "and",
    "for", "the", "type", "inr", "rs", "series", "edition", "pack",
]

# --- copy ---------------------------------------------------------------------------------------------
BOILERPLATE = [
    "free shipping", "leading indian brand", "homegrown", "reliable and durable", "top quality",
    "extensive product portfolio", "wide range", "made in india with love", "pan india",
    "hassle free warranty", "customer support", "add to cart", "subscribe to our newsletter",
    "all rights reserved", "terms of service", "privacy policy",
]
BANNED_ADJECTIVES = [
    "premium", "amazing", "ultimate", "perfect", "revolutionary", "cutting-?edge", "seamless(?:ly)?",
    "incredible", "exceptional", "best", "unbeatable", "stunning", "game-?changing", "top-?notch",
    "state-?of-?the-?art", "superior", "flawless", "miraculous", "breathtaking", "unrivaled",
]
DANGLING_WORDS = [
    "to", "in", "on", "at", "for", "with", "and", "or", "the", "a", "an", "by", "of", "from", "up", "into", "as",
]

# --- categories and specifications --------------------------------------------------------------------
CATEGORY_KEYWORDS = [
    ("tws", ["tws", "earbud", "earphone", "airbud", "headphone"]),
    ("audio", ["speaker", "soundbar", "audio"]),
    ("smartwatch", ["smartwatch", "watch", "band", "wearable"]),
    ("powerbank", ["powerbank", "power bank", "battery pack"]),
]
CATEGORY_PREFIXES = {
    "POWERBANK": "PB", "POWERBANKS": "PB", "TWS": "TWS", "EARBUDS": "TWS", "SMARTWATCH": "SW",
    "SMARTWATCHES": "SW", "CHARGER": "CH", "CHARGERS": "CH", "CABLE": "CB", "CABLES": "CB", "SPEAKER": "SPK",
    "SPEAKERS": "SPK", "AUDIO": "AUD", "ACCESSORY": "ACC", "ACCESSORIES": "ACC",
}
PRIMARY_SPECS = {
    "powerbank": ["capacity", "output", "ports", "weight"],
    "generic": ["capacity", "output", "ports", "weight"],
    "tws": ["playtime", "drivers", "noise_cancellation", "bluetooth", "ports"],
    "audio": ["playtime", "drivers", "output_power", "bluetooth", "ports"],
    "smartwatch": ["display", "battery", "calling", "water_resistance"],
}
MIN_SPECS = {"powerbank": 2, "generic": 1, "tws": 1, "audio": 1, "smartwatch": 1}
CAPACITIES_IN_TEXT = "5000|10000|10,000|15000|20000|20,000|25000|27000|30000"
CAPACITIES_IN_NAME = "5000|10000|15000|20000|25000|30000"
PORT_WORDS = ["type-c", "type c", "usb-c", "usb c", "usb-a", "usb a", "wireless", "lightning", "micro", "port"]

# --- collection tiers, in precedence order ------------------------------------------------------------
TIERS = ["0", "0-vision", "1", "1-vision", "2", "2-vision", "3", "3-vision"]
DEFAULT_RETAIL_ORDER = ["reliance", "croma"]
SHORTLIST_SIZE = 4
REJECTIONS_KEPT = 40
MAX_ATTEMPTS = 3
MAX_REVIEW_RERUNS = 2
BRAND_IMAGES_TRIED = 6

# --- recorded web pages -------------------------------------------------------------------------------
NOISE_TAGS = ["script", "style", "nav", "footer", "header", "aside", "noscript", "svg"]
NOISE_CLASSES = (
    r"site-footer|footer|site-header|header|announcement-bar|cookie|newsletter|related-products|related|"
    r"product-recommendations|recommend|you-may-like|you-may-also-like|also-viewed|recently-viewed|"
    r"trending-products|similar-products|upsell|cross-?sell|also-bought|frequently-bought|bought-together|"
    r"more-from|pairs-well|complete-the-look|bundle-offer|product-carousel|product-card|testimonial|\breview\b"
)
IMAGE_WORDS_DROPPED = ["logo", "icon", "badge", "payment", "arrow", "rating", "avatar", "sprite"]
SRCSET_WORDS_DROPPED = ["logo", "icon", "badge"]
PARKED_SIGNATURES = [
    "buy this domain", "domain for sale", "hugedomains", "godaddy", "dan.com", "sedo", "namecheap",
    "is parked", "domain parking", "this web page is parked",
]
STOREFRONT_WORDS = ["official", "store", "shop", "products", "warranty", "sound", "audio", "cart"]
COMMERCE_INDICATORS = [
    "cart", "checkout", "product", "shop", "price", "add to cart", "catalog", "collection", "inr", "₹", "rs.",
]
SHEET_DOMAIN_PARKED = [
    'window.location.href="/lander"', "window.location.href='/lander'", "buy this domain", "is parked free",
    "this domain is for sale", "domain may be for sale", "registered at namecheap", "parked domain",
    "renew now", "inquire about this domain",
]
GENERIC_MODEL_WORDS = [
    "live", "go", "pro", "tour", "plus", "max", "mini", "lite", "play", "air", "buds", "beam", "free", "one",
    "tune", "flex", "ace", "neo", "ultra", "flow",
]
SITEMAP_MARKS = ["/product/", "/p/", "-power-bank", "-powerbank", "/item/", "/evm-products/"]
AGGREGATOR_DOMAINS = [
    "amazon.in", "amazon.com", "flipkart.com", "reliancedigital.in", "croma.com", "indiamart.com",
    "wikipedia.org", "en.wikipedia.org", "youtube.com", "facebook.com", "instagram.com", "twitter.com",
    "linkedin.com", "tatacliq.com", "myntra.com", "gadgets360.com", "91mobiles.com", "smartprix.com",
    "mysmartprice.com", "eci.gov.in",
]

#: Address parts of product pictures, and of page furniture.
PRODUCT_IMAGE_MARKS = ["media/catalog/product", "cdn/shop", "cdn.shopify", "wp-content/uploads", "assets", "product", "images"]
FURNITURE_IMAGE_MARKS = ["logo", "icon", "banner", "payment", "badge"]
