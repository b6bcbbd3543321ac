"""Fixed values that must equal the original application's for equal results.

Stated plainly, in natural order, in one place.
"""

# --- fixed values -----------------------------------------------------------

# Price segment upper bounds (right-closed): <=745 juta, <=1.3 miliar, <=2.645 miliar, above.
SEGMENT_BOUNDS = (745_000_000, 1_300_000_000, 2_645_000_000)

# Segment id -> short name (analytics view); default for unknown ids is "Menengah".
SEGMENT_NAMES = {0: "Murah", 1: "Menengah", 2: "Atas", 3: "Mewah"}
SEGMENT_DEFAULT = "Menengah"

# Segment id -> long label (model metadata / classifier output).
SEGMENT_LABELS = {
    0: "Murah (≤ 745 juta)",
    1: "Menengah (745 juta – 1.3 miliar)",
    2: "Atas (1.3 – 2.645 miliar)",
    3: "Mewah (> 2.645 miliar)",
}

# Cluster rank (0 = lowest median price) -> label written at training time.
CLUSTER_LABELS = {
    0: "Budget",
    1: "Affordable",
    2: "Mid-Market",
    3: "Premium",
    4: "Luxury",
    5: "Ultra-Luxury",
    6: "Tier-7",
    7: "Tier-8",
}
N_CLUSTERS = 6

# Keywords that mark a text as a property-market question (lower-case substring match).
MARKET_KEYWORDS = [
    "harga", "price", "estimasi", "lokasi", "segmen", "cluster",
    "rumah", "properti", "property", "beli", "invest", "mahal", "murah",
]

# Constant note attached to each area-analytics row.
AREA_NOTE = "The data is analyzed dynamically based on the classification model"

# Cleaning thresholds.
REG_SANITY = dict(lb_min=10, lt_min=10, big_lt=400, small_lb=150, lb_max=600, lt_max=1000,
                  kt_max=8, km_max=8, garasi_max=6, price_min=200_000_000)
CLUSTER_PRICE_RANGE = (50_000_000, 10_000_000_000)

# Request validation bounds (prediction requests, feedback corrections).
REQUEST_BOUNDS = dict(room_min=1, room_max=10, garasi_min=0, garasi_max=5, name_min=2, top_k_min=1, top_k_max=20)
FEEDBACK_BOUNDS = dict(room_min=1, room_max=20, garasi_min=0, garasi_max=10, name_min=2,
                       price_min=10_000_000, price_max=500_000_000_000)

# Target encoder (smoothing, minimum samples per leaf).
TARGET_SMOOTHING = 10.0
TARGET_MIN_SAMPLES_LEAF = 20

# Retrain trigger threshold (unprocessed corrections) and cache ttl (seconds).
RETRAIN_THRESHOLD = 100
CACHE_TTL_SECONDS = 3600

# Blending zone around the segment threshold for the two price models.
BLEND_MARGIN = 0.05

# Default segment threshold (median of the cleaned rows of the original data set).
DEFAULT_SEGMENT_THRESHOLD = 1_200_000_000.0

# Stored holdout errors (MAPE %) of the two price models, reported when routing.
STORED_MAPE_LOW = 10.0824
STORED_MAPE_HIGH = 10.6653

# Text formats ({name} = a column value).
LISTING_TEXT = ("Properti di {lokasi}, Depok. {kamar_tidur} kamar tidur, {kamar_mandi} kamar mandi, "
                "garasi {garasi} mobil. Luas tanah {luas_tanah}m², luas bangunan {luas_bangunan}m². "
                "Harga: Rp {harga}. Segmen: {segment}.")
QUERY_TEXT = "Property in {lokasi}, {kamar_tidur}BR {kamar_mandi}BA, LT {luas_tanah}m² LB {luas_bangunan}m², Rp {harga}"
PRICE_TEXT_MILIAR = "Rp {whole}.{hundredths} Miliar"
PRICE_TEXT_JUTA = "Rp {whole}.{tenth} Juta"
PRICE_TEXT_PLAIN = "Rp {grouped}"
TREND_TEXT = "±{whole}.{tenth}%"
BRIEF_PREDICTION = ["## ML Prediction Result", "- Estimated Price: {price}", "- Model Used: {model}",
                    "- MAPE: {mape}%", "- Segment: {segment}", "- Cluster: {cluster}"]
BRIEF_STATS = ("\n## Live Market Statistics — {lokasi}\n- Average price: Rp {avg}\n"
               "- Price range: Rp {min} – Rp {max}\n- Dominant segment: {segment}\n- Data points: {n} properties")
BRIEF_COMPARABLE = "{rank}. {lokasi} | {kamar_tidur}BR | LT {luas_tanah}m² | Rp {harga} | {segment} | sim: {sim}"
BRIEF_COMPARABLES_HEADER = "\n## Comparable Properties\n"
BRIEF_KNOWLEDGE_HEADER = "\n## Area & Market Knowledge\n"
BRIEF_KNOWLEDGE_ITEM = "### {title}\n{content}"

# Chunking of knowledge documents.
CHUNK_SIZE = 500
CHUNK_OVERLAP = 50
PREVIEW_CHARS = 300

# Knowledge folder -> document type.
DOC_TYPES = {"area_profiles": "area_profile", "market_rules": "market_rule", "faqs": "faq"}
