"""Keyword routing of customer and staff questions as Column expressions.

Matching is lower-case *substring* and first-match-wins in table order (so
"coffee" contains "off", "steak" contains "tea"); no word boundaries. Every
rule table below is an ordered list shared by the Spark expression and the
SQL oracle text (:func:`sql_first_match`), so both engines apply one order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Keyword tables (order matters: first match wins).
# ---------------------------------------------------------------------------
STORE_KEYWORDS = ["store", "location", "near", "address", "hours", "open", "close", "phone", "where"]
DEAL_KEYWORDS = ["deal", "bogo", "sale", "discount", "off", "save", "coupon", "weekly", "daily", "free"]
CATEGORY_KEYWORDS = ["baby", "beverage", "drink", "household", "cleaning", "fresh", "fruit", "vegetable",
                     "meat", "seafood", "chicken", "beef", "deli", "cheese"]

CUSTOMER_CATEGORY_MAP = [
    ("baby", "Baby"), ("diaper", "Baby"), ("formula", "Baby"), ("wipes", "Baby"),
    ("beverage", "Beverages"), ("drink", "Beverages"), ("water", "Beverages"), ("soda", "Beverages"),
    ("coffee", "Beverages"), ("juice", "Beverages"), ("tea", "Beverages"),
    ("household", "Household"), ("cleaning", "Household"), ("paper towel", "Household"), ("laundry", "Household"),
    ("fresh", "Fresh"), ("fruit", "Fresh"), ("vegetable", "Fresh"), ("organic", "Fresh"),
    ("meat", "Meat & Seafood"), ("seafood", "Meat & Seafood"), ("chicken", "Meat & Seafood"),
    ("beef", "Meat & Seafood"), ("fish", "Meat & Seafood"), ("pork", "Meat & Seafood"),
    ("shrimp", "Meat & Seafood"),
    ("deli", "Deli"), ("cheese", "Deli"), ("sandwich", "Deli"), ("rotisserie", "Deli"),
]

STAFF_CATEGORY_MAP = [
    ("baby", "Baby"), ("diaper", "Baby"), ("formula", "Baby"),
    ("beverage", "Beverages"), ("drink", "Beverages"), ("water", "Beverages"), ("coffee", "Beverages"),
    ("household", "Household"), ("cleaning", "Household"), ("laundry", "Household"),
    ("fresh", "Fresh"), ("fruit", "Fresh"), ("vegetable", "Fresh"), ("produce", "Fresh"),
    ("meat", "Meat & Seafood"), ("seafood", "Meat & Seafood"), ("chicken", "Meat & Seafood"),
    ("fish", "Meat & Seafood"),
    ("deli", "Deli"), ("cheese", "Deli"), ("sandwich", "Deli"),
]

DEAL_TYPE_RULES = [(["bogo", "buy one"], "BOGO"), (["weekly"], "WeeklyDeal"), (["daily", "today"], "DailyDeal")]
COUNT_DEAL_TYPE_RULES = [(["bogo", "buy one"], "BOGO"), (["weekly"], "WeeklyDeal"), (["daily"], "DailyDeal")]

KNOWN_BRANDS = ["pampers", "huggies", "greenwise", "boar's head", "cal-organic",
                "crystal clear", "nature's best", "sabra", "smithfield"]

COUNT_PATTERN = r"(?:how many|count|total|number of)\s+(.+?)(?:\s+do we|\s+are there|\s+in|\?|$)"
PRICE_UNDER_PATTERN = r"(?:under|below|less than|cheaper than)\s*\$?(\d+(?:\.\d+)?)"
COUNT_DEAL_WORDS = ["deal", "bogo", "sale", "discount"]

# Staff rules after the count rule, in order: (action, any-of keywords).
STAFF_RULES = [
    ("expiring_deals", ["expir", "ending soon", "ends today", "about to end"]),
    ("list_categories", ["list categor", "show categor", "what categor", "all categor"]),
    ("cheapest_products", ["cheapest", "lowest price"]),
    ("most_expensive_products", ["most expensive", "highest price", "priciest"]),
    ("store_brand_products", ["store brand", "greenwise", "private label"]),
]
BRAND_QUESTION_WORDS = ["what", "which", "list", "show", "carry", "do we"]
DEAL_SUMMARY_WORDS = ["deal summary", "deal breakdown", "active deals", "deal stats"]
ACTION_LIMITS = {"cheapest_products": 5, "most_expensive_products": 5, "store_brand_products": 10,
                 "products_under_price": 10}

# Customer scenarios, in order: (name, keywords, skip_rag, message).
NOT_CARRIED_BRANDS = ["whole foods", "trader joe", "aldi", "costco", "kirkland", "walmart", "great value",
                      "sam's choice", "kroger", "365 by whole"]
DIET_KEYWORDS = ["allergy", "allergic", "gluten free", "gluten-free", "nut free", "dairy free", "vegan",
                 "vegetarian", "keto", "halal", "kosher"]
DIET_LABELS = [("gluten", "gluten-free options"), ("vegan", "vegan products"), ("keto", "keto-friendly items"),
               ("dairy", "dairy-free alternatives")]
DIET_DEFAULT = "dietary needs"
DIET_MESSAGE = (
    "I understand how important {diet} are! "
    "While our product labels include basic tags like 'organic', "
    "detailed allergen information is something we're actively working on adding "
    "to every product listing.\n\n"
    "In the meantime, I can help you search for products tagged as organic "
    "or from specific brands known for {diet}. "
    "What specifically are you looking for?"
)
SCENARIOS = [
    ("order_tracking", ["track my order", "order status", "order history", "where is my order", "my orders",
                        "track order"], True,
     "I appreciate your interest in tracking your order! "
     "Order tracking is currently being developed as part of our 'customer-first' commitment. "
     "In the meantime, please check your email for order confirmation details, "
     "or visit our store directly for assistance.\n\n"
     "Is there anything else I can help you with? I'm great at finding products, deals, and store info!"),
    ("brand_not_carried", NOT_CARRIED_BRANDS, False,
     "I'm sorry, we don't currently carry that brand in our stores. "
     "However, I'd love to help you find a great alternative! "
     "We carry over 3,300 products including our premium GreenWise store brand "
     "and popular national brands.\n\n"
     "Would you like me to suggest similar products from the brands we do carry?"),
    ("delivery_area", ["deliver to", "delivery area", "delivery zone", "do you deliver", "ship to"], True,
     "We currently deliver to the greater Lakeland, Florida area, "
     "covering 9 store locations: Lakeland South, Lakeland North, Winter Haven, "
     "Plant City, Bartow, Auburndale, Haines City, Mulberry, and Davenport.\n\n"
     "Free delivery on orders over $35! Standard delivery fee is $5.99 for smaller orders.\n\n"
     "Would you like to see our store locations or start shopping?"),
    ("payment", ["payment", "pay with", "credit card", "debit card", "apple pay", "how to pay", "accept"], True,
     "We're currently in demo mode, so no real payments are processed. "
     "In our production version, we would accept all major credit/debit cards, "
     "Apple Pay, Google Pay, and EBT/SNAP benefits — because grocery access matters.\n\n"
     "Feel free to explore the full shopping experience including cart and checkout!"),
    ("returns", ["return", "refund", "exchange", "money back", "damaged", "wrong item"], True,
     "Customer satisfaction is our top priority! "
     "Our return and refund system is currently under development as part of our "
     "'customer-first' philosophy.\n\n"
     "In a production environment, we would offer:\n"
     "- Full refunds for damaged or incorrect items\n"
     "- Easy returns within 7 days of delivery\n"
     "- Instant credit for missing items\n\n"
     "Is there anything else I can help you find today?"),
    ("coupons", ["coupon", "promo code", "discount code", "voucher", "promotion code"], False,
     "We don't use promo codes — instead, our deals are applied automatically! "
     "Here's what's always available:\n\n"
     "- **BOGO**: 200+ Buy One Get One Free products\n"
     "- **Weekly Deals**: 150+ products at 20-40% off\n"
     "- **Daily Deals**: 15 products at 25-50% off (changes daily!)\n\n"
     "Would you like me to show you what's on sale right now?"),
    ("dietary", DIET_KEYWORDS, False, DIET_MESSAGE),
    ("off_topic", ["weather", "sports", "news", "politics", "movie", "music", "game score", "stock market",
                   "bitcoin", "crypto", "joke", "tell me a joke", "who are you", "what are you",
                   "how old are you"], True,
     "That's a great question, but I'm a grocery shopping specialist! "
     "I know everything about our 3,300+ products, 365 active deals, "
     "and 9 store locations — but that's where my expertise ends.\n\n"
     "Here are some things I can help with:\n"
     "- Find products by name, brand, or category\n"
     "- Show you BOGO, weekly, or daily deals\n"
     "- Store locations and hours\n"
     "- Meal ingredient suggestions\n\n"
     "What can I help you find?"),
    ("complaint", ["complaint", "complain", "bad experience", "terrible", "worst", "horrible", "disgusting",
                   "rude"], True,
     "I'm truly sorry to hear about your experience. "
     "Customer satisfaction is at the heart of everything we do, "
     "and we take every concern seriously.\n\n"
     "While our feedback system is being built out, "
     "please know that your input helps us improve. "
     "For immediate assistance, you can contact any of our 9 store locations directly.\n\n"
     "Is there anything I can help you with right now to make things better?"),
    ("bulk_order", ["bulk order", "catering", "party platter", "large order", "wholesale", "event", "party"], False,
     "Great choice for planning an event! "
     "Our Deli department offers party platters starting at $14.99, "
     "and we have bulk options across many product categories.\n\n"
     "Bulk ordering and catering services are being expanded — "
     "for large orders (50+ items), we recommend contacting your nearest store directly "
     "for personalized assistance and potential volume discounts.\n\n"
     "Want me to show you our Deli platters and party food options?"),
]

# Retrieval depth per route: (products, deals, stores).
CUSTOMER_PLAN = {"store_info": (3, 0, 5), "deal_inquiry": (5, 8, 0), "other": (10, 3, 0)}
STAFF_PLAN = {"store_info": (10, 5, 3), "other": (10, 5, 0)}


# ---------------------------------------------------------------------------
# Spark expressions. ``*_q`` variants take text that is already lower-cased;
# the ``with_*`` DataFrame helpers lower it once into a column first, so the
# dozens of ``contains`` tests share one lower-cased copy of each whole text.
# ---------------------------------------------------------------------------
def _lower(text) -> Column:
    return F.lower(F.col(text) if isinstance(text, str) else text)


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def any_contains(q: Column, words: list[str]) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | q.contains(F.lit(w))
    return cond


def first_index(q: Column, rules: list[list[str]]) -> Column:
    """1-based index of the first rule whose keywords occur in ``q``, else null."""
    out = F.lit(None).cast("int")
    for i, words in reversed(list(enumerate(rules, start=1))):
        out = F.when(any_contains(q, words), F.lit(i)).otherwise(out)
    return out


def first_match(q: Column, rules: list[tuple[list[str], str]], default=None) -> Column:
    """Value of the first rule whose keywords occur in ``q`` (ordered CASE on
    an index, then one array lookup)."""
    idx = first_index(q, [ws for ws, _ in rules])
    # guarded: element_at with a null index does not yield null in every mode
    val = F.when(idx.isNotNull(), F.element_at(F.array(*[F.lit(v) for _, v in rules]), idx))
    return val if default is None else F.coalesce(val, F.lit(default))


def intent_q(q: Column) -> Column:
    return first_match(q, [(STORE_KEYWORDS, "store_info"), (DEAL_KEYWORDS, "deal_inquiry"),
                           (CATEGORY_KEYWORDS, "product_search")], "general")


def category_q(q: Column, staff: bool = False) -> Column:
    m = STAFF_CATEGORY_MAP if staff else CUSTOMER_CATEGORY_MAP
    return first_match(q, [([k], v) for k, v in m])


def deal_type_q(q: Column) -> Column:
    return first_match(q, DEAL_TYPE_RULES)


def classify_intent(text) -> Column:
    """G1: store_info > deal_inquiry > product_search > general."""
    return intent_q(_lower(text))


def detect_category(text) -> Column:
    """Customer keyword map -> category or null."""
    return category_q(_lower(text))


def detect_staff_category(text) -> Column:
    """The shorter staff keyword map."""
    return category_q(_lower(text), staff=True)


def detect_deal_type(text) -> Column:
    """Bogo / 'buy one' > weekly > daily / today."""
    return deal_type_q(_lower(text))


def with_intent(df: DataFrame, text: str, *, staff_category: bool = False) -> DataFrame:
    """G1-G3 (+ G6) as columns intent, category, deal_type (, staff_category)."""
    d = df.withColumn("_q", _lower(text))
    q = F.col("_q")
    d = d.withColumn("intent", intent_q(q)).withColumn("category", category_q(q)) \
        .withColumn("deal_type", deal_type_q(q))
    if staff_category:
        d = d.withColumn("staff_category", category_q(q, staff=True))
    return d.drop("_q")


_STAFF_ACTIONS = [a for a, _ in STAFF_RULES] + ["list_brands", "deal_summary", "products_under_price",
                                                 "list_subcategories"]
_USES_CATEGORY = ["count_products", "cheapest_products", "most_expensive_products", "store_brand_products",
                  "list_brands", "products_under_price", "list_subcategories"]
STAFF_FIELDS = ["type", "action", "category", "brand", "organic_only", "deal_type", "max_price", "limit"]


def with_staff_route(df: DataFrame, text: str) -> DataFrame:
    """G4 + G5 + G6 as columns (type, action, category, brand, organic_only,
    deal_type, max_price, limit). The count regex is tried first, then the
    ordered rules; anything else is 'rag'. Staged projections keep each
    whole text lower-cased once and each rule evaluated once."""
    d = df.withColumn("_q", _strip(_lower(text)))
    q = F.col("_q")
    # (?d): only \n ends a line, as in Python's re
    d = d.withColumn("_subj", F.when(q.rlike("(?d)" + COUNT_PATTERN),
                                     _strip(F.regexp_extract(q, "(?d)" + COUNT_PATTERN, 1))))
    subj = F.col("_subj")
    rules = [ws for _, ws in STAFF_RULES]
    idx = first_index(q, rules)
    n = len(rules)
    brand_q = q.contains("brand") & any_contains(q, BRAND_QUESTION_WORDS)
    idx = (F.when(idx.isNotNull(), idx).when(brand_q, F.lit(n + 1))
           .when(any_contains(q, DEAL_SUMMARY_WORDS), F.lit(n + 2))
           .when(q.rlike("(?d)" + PRICE_UNDER_PATTERN), F.lit(n + 3))
           .when(q.contains("subcategor"), F.lit(n + 4)))
    action = F.when(subj.isNotNull(), F.when(any_contains(subj, COUNT_DEAL_WORDS), F.lit("count_deals"))
                    .otherwise(F.lit("count_products"))) \
        .when(idx.isNotNull(), F.element_at(F.array(*[F.lit(a) for a in _STAFF_ACTIONS]), idx))
    d = d.withColumn("action", action)
    a = F.col("action")
    limit = F.lit(None).cast("int")
    for act, k in ACTION_LIMITS.items():
        limit = F.when(a == act, F.lit(k)).otherwise(limit)
    d = (d.withColumn("type", F.when(a.isNull(), F.lit("rag")).otherwise(F.lit("db_query")))
         .withColumn("category", F.when(a.isin(*_USES_CATEGORY), category_q(q, staff=True)))
         .withColumn("brand", F.when(a == "count_products", first_match(subj, [([b], b) for b in KNOWN_BRANDS])))
         .withColumn("organic_only", F.when(a == "count_products", subj.contains("organic")))
         .withColumn("deal_type", F.when(a == "count_deals", first_match(subj, COUNT_DEAL_TYPE_RULES)))
         .withColumn("max_price", F.when(a == "products_under_price",
                                         F.regexp_extract(q, "(?d)" + PRICE_UNDER_PATTERN, 1).cast("double")))
         .withColumn("limit", limit))
    return d.drop("_q", "_subj")


def classify_staff_query(text) -> Column:
    """G4 as one struct column (convenience form of :func:`with_staff_route`
    for single expressions; prefer the DataFrame helper on large batches)."""
    q = _strip(_lower(text))
    subj = F.when(q.rlike("(?d)" + COUNT_PATTERN), _strip(F.regexp_extract(q, "(?d)" + COUNT_PATTERN, 1)))
    rules = [ws for _, ws in STAFF_RULES]
    n = len(rules)
    idx = first_index(q, rules)
    idx = (F.when(idx.isNotNull(), idx)
           .when(q.contains("brand") & any_contains(q, BRAND_QUESTION_WORDS), F.lit(n + 1))
           .when(any_contains(q, DEAL_SUMMARY_WORDS), F.lit(n + 2))
           .when(q.rlike("(?d)" + PRICE_UNDER_PATTERN), F.lit(n + 3))
           .when(q.contains("subcategor"), F.lit(n + 4)))
    a = F.when(subj.isNotNull(), F.when(any_contains(subj, COUNT_DEAL_WORDS), F.lit("count_deals"))
               .otherwise(F.lit("count_products"))) \
        .when(idx.isNotNull(), F.element_at(F.array(*[F.lit(x) for x in _STAFF_ACTIONS]), idx))
    limit = F.lit(None).cast("int")
    for act, k in ACTION_LIMITS.items():
        limit = F.when(a == act, F.lit(k)).otherwise(limit)
    return F.struct(
        F.when(a.isNull(), F.lit("rag")).otherwise(F.lit("db_query")).alias("type"), a.alias("action"),
        F.when(a.isin(*_USES_CATEGORY), category_q(q, staff=True)).alias("category"),
        F.when(a == "count_products", first_match(subj, [([b], b) for b in KNOWN_BRANDS])).alias("brand"),
        F.when(a == "count_products", subj.contains("organic")).alias("organic_only"),
        F.when(a == "count_deals", first_match(subj, COUNT_DEAL_TYPE_RULES)).alias("deal_type"),
        F.when(a == "products_under_price",
               F.regexp_extract(q, "(?d)" + PRICE_UNDER_PATTERN, 1).cast("double")).alias("max_price"),
        limit.alias("limit"))


def scenario_q(q: Column) -> Column:
    """G7 on lower-cased, stripped text: struct(name, skip_rag, message) or null."""
    idx = first_index(q, [ws for _, ws, _, _ in SCENARIOS])
    names = F.array(*[F.lit(n) for n, _, _, _ in SCENARIOS])
    skips = F.array(*[F.lit(sk) for _, _, sk, _ in SCENARIOS])
    msgs = F.array(*[F.lit(m) for _, _, _, m in SCENARIOS])
    name = F.when(idx.isNotNull(), F.element_at(names, idx))
    diet = first_match(q, [([k], v) for k, v in DIET_LABELS], DIET_DEFAULT)
    msg = F.when(name == "dietary", F.replace(F.lit(DIET_MESSAGE), F.lit("{diet}"), diet)) \
        .when(idx.isNotNull(), F.element_at(msgs, idx))
    return F.when(idx.isNotNull(), F.struct(name.alias("name"),
                                            F.when(idx.isNotNull(), F.element_at(skips, idx)).alias("skip_rag"),
                                            msg.alias("message")))


def custom_scenario(text) -> Column:
    """struct(name, skip_rag, message) of the first matching scenario, or null."""
    return scenario_q(_strip(_lower(text)))


def with_scenario(df: DataFrame, text: str) -> DataFrame:
    """G7 as columns scenario, skip_rag, message (text lower-cased once)."""
    d = df.withColumn("_q", _strip(_lower(text)))
    # the index is a column of its own, so its rule chain is generated once
    d = d.withColumn("_i", first_index(F.col("_q"), [ws for _, ws, _, _ in SCENARIOS]))
    at = lambda values: F.when(F.col("_i").isNotNull(), F.element_at(F.array(*[F.lit(v) for v in values]), F.col("_i")))
    d = (d.withColumn("scenario", at([n for n, _, _, _ in SCENARIOS])).withColumn("skip_rag", at([sk for _, _, sk, _ in SCENARIOS]))
         .withColumn("_m", at([m for _, _, _, m in SCENARIOS])))
    diet = first_match(F.col("_q"), [([k], v) for k, v in DIET_LABELS], DIET_DEFAULT)
    return (d.withColumn("message", F.when(F.col("scenario") == "dietary", F.replace(F.lit(DIET_MESSAGE), F.lit("{diet}"), diet))
                         .otherwise(F.col("_m"))).drop("_q", "_i", "_m"))


def retrieval_plan(intent, audience: str = "customer") -> Column:
    """struct(k_products, k_deals, k_stores) for an intent."""
    i = F.col(intent) if isinstance(intent, str) else intent
    plan = CUSTOMER_PLAN if audience == "customer" else STAFF_PLAN
    other = plan["other"]

    def pick(idx):
        out = F.lit(other[idx])
        for name, ks in plan.items():
            if name != "other":
                out = F.when(i == F.lit(name), F.lit(ks[idx])).otherwise(out)
        return out
    return F.struct(pick(0).alias("k_products"), pick(1).alias("k_deals"), pick(2).alias("k_stores"))


# ---------------------------------------------------------------------------
# Same rule tables as SQL text (oracle side)
# ---------------------------------------------------------------------------
def _sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_any(q: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({q}, {_sq(w)})" for w in words) + ")"


def sql_first_match(q: str, rules: list[tuple[list[str], str]], default: str | None = None) -> str:
    whens = " ".join(f"WHEN {sql_any(q, ws)} THEN {_sq(v)}" for ws, v in rules)
    return f"CASE {whens} ELSE {_sq(default) if default is not None else 'NULL'} END"


def sql_classify_intent(q: str) -> str:
    return sql_first_match(q, [(STORE_KEYWORDS, "store_info"), (DEAL_KEYWORDS, "deal_inquiry"),
                               (CATEGORY_KEYWORDS, "product_search")], "general")


def sql_detect_category(q: str, staff: bool = False) -> str:
    m = STAFF_CATEGORY_MAP if staff else CUSTOMER_CATEGORY_MAP
    return sql_first_match(q, [([k], v) for k, v in m])


def sql_scenario_name(q: str) -> str:
    return sql_first_match(q, [(ws, n) for n, ws, _, _ in SCENARIOS])


def sql_scenario_message(q: str) -> str:
    diet = sql_first_match(q, [([k], v) for k, v in DIET_LABELS], DIET_DEFAULT)
    whens = []
    for name, ws, _, msg in SCENARIOS:
        m = f"replace({_sq(DIET_MESSAGE)}, '{{diet}}', {diet})" if name == "dietary" else _sq(msg)
        whens.append(f"WHEN {sql_any(q, ws)} THEN {m}")
    return "CASE " + " ".join(whens) + " ELSE NULL END"


def sql_scenario_skip(q: str) -> str:
    whens = " ".join(f"WHEN {sql_any(q, ws)} THEN {str(skip).upper()}" for _, ws, skip, _ in SCENARIOS)
    return f"CASE {whens} ELSE NULL END"
