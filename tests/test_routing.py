"""Keyword routing: reference-style examples plus a property test against a
plain-Python twin that reads the same ordered rule tables."""

import re
import json
from datetime import datetime


from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from larder.functions import routing as R

INTENT_CASES = [
    ("What's on sale today?", "deal_inquiry"), ("Show me BOGO deals", "deal_inquiry"),
    ("Any discounts on meat?", "deal_inquiry"), ("Where is the nearest store?", "store_info"),
    ("What are your hours?", "store_info"), ("Store address in Lakeland", "store_info"),
    ("I need baby diapers", "product_search"), ("Show me fresh fruit", "product_search"),
    ("Do you have chicken breast?", "product_search"), ("Something for dinner", "general"),
    ("What do you recommend?", "general"), ("BOGO DEALS NOW", "deal_inquiry"), ("STORE HOURS", "store_info"),
    ("coffee", "deal_inquiry"),  # substring rule: coffee contains "off"
]
CATEGORY_CASES = [("organic fruit", "Fresh"), ("I need vegetables", "Fresh"), ("chicken breast", "Meat & Seafood"),
                  ("shrimp cocktail", "Meat & Seafood"), ("coffee brands", "Beverages"), ("steak", "Beverages"),
                  ("nothing relevant", None)]
DEAL_CASES = [("any bogo?", "BOGO"), ("buy one get one", "BOGO"), ("weekly specials", "WeeklyDeal"),
              ("today's deals", "DailyDeal"), ("deals", None)]

STAFF_CASES = [
    ("How many products do we carry?", dict(action="count_products", category=None, brand=None, organic_only=False)),
    ("How many baby products do we have?", dict(action="count_products", category="Baby")),
    ("How many organic products are there?", dict(action="count_products", organic_only=True)),
    ("How many Pampers products do we have?", dict(action="count_products", brand="pampers")),
    ("How many BOGO deals are active?", dict(action="count_deals", deal_type="BOGO")),
    ("Total weekly deals?", dict(action="count_deals", deal_type="WeeklyDeal")),
    ("What deals are expiring today?", dict(action="expiring_deals")),
    ("Which deals are ending soon?", dict(action="expiring_deals")),
    ("Show me all categories", dict(action="list_categories")),
    ("What are the cheapest fresh products?", dict(action="cheapest_products", category="Fresh", limit=5)),
    ("Most expensive meat products?", dict(action="most_expensive_products", category="Meat & Seafood", limit=5)),
    ("Show products under $5 in beverages", dict(action="products_under_price", max_price=5.0,
                                                 category="Beverages", limit=10)),
    ("What brands do we carry in deli?", dict(action="list_brands", category="Deli")),
    ("Show me our private label products", dict(action="store_brand_products", category=None, limit=10)),
    ("List all GreenWise items in fresh", dict(action="store_brand_products", category="Fresh")),
    ("Give me a deal summary", dict(action="deal_summary")),
    ("How are active deals looking?", dict(action="deal_summary")),
    ("What subcategories do we have in baby?", dict(action="list_subcategories", category="Baby")),
    ("A customer is asking about meal planning suggestions", dict(type="rag", action=None)),
    ("Why are we seeing low sales on organic produce this week?", dict(type="rag", action=None)),
    ("What should I recommend to someone with a nut allergy?", dict(type="rag", action=None)),
]

SCENARIO_CASES = [
    ("track my order", "order_tracking", True), ("What is my order status?", "order_tracking", True),
    ("Do you have Great Value bread?", "brand_not_carried", False), ("I want Kirkland water", "brand_not_carried", False),
    ("Do you carry Trader Joe items?", "brand_not_carried", False), ("Do you deliver to Tampa?", "delivery_area", True),
    ("What payment methods do you accept?", "payment", True), ("I want to return an item", "returns", True),
    ("Can I get a refund?", "returns", True), ("Do you have a promo code?", "coupons", False),
    ("Do you have vegan products?", "dietary", False), ("I need gluten-free bread", "dietary", False),
    ("What's the weather like?", "off_topic", True), ("Who won the sports game?", "off_topic", True),
    ("Tell me a joke", "off_topic", True), ("I had a terrible experience", "complaint", True),
    ("I need catering for a party", "bulk_order", False),
    ("What organic apples do you have?", None, None), ("Show me BOGO deals on meat", None, None),
    ("What's good for dinner tonight?", None, None), ("hello", None, None),
]


def _df(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")


def test_intent_category_deal_examples(spark):
    texts = [t for t, _ in INTENT_CASES] + [t for t, _ in CATEGORY_CASES] + [t for t, _ in DEAL_CASES]
    rows = {r.text: r for r in R.with_intent(_df(spark, texts), "text").collect()}
    for t, want in INTENT_CASES:
        assert rows[t].intent == want, t
    for t, want in CATEGORY_CASES:
        assert rows[t].category == want, t
    for t, want in DEAL_CASES:
        assert rows[t].deal_type == want, t


def test_staff_examples(spark):
    rows = {r.text: r for r in R.with_staff_route(_df(spark, [t for t, _ in STAFF_CASES]), "text").collect()}
    for t, want in STAFF_CASES:
        for k, v in want.items():
            assert getattr(rows[t], k) == v, (t, k, getattr(rows[t], k))
        assert rows[t].type == ("rag" if want.get("action", "x") is None else "db_query")


def test_scenario_examples(spark):
    rows = {r.text: r for r in R.with_scenario(_df(spark, [t for t, _, _ in SCENARIO_CASES]), "text").collect()}
    for t, name, skip in SCENARIO_CASES:
        assert rows[t].scenario == name, t
        assert rows[t].skip_rag == skip, t
    assert "vegan products are" in rows["Do you have vegan products?"].message
    assert "gluten-free options" in rows["I need gluten-free bread"].message


# --- plain-Python twin over the same tables -------------------------------
def _first(q, rules, default=None):
    for words, v in rules:
        if any(w in q for w in words):
            return v
    return default


def twin_intent(text):
    return _first(text.lower(), [(R.STORE_KEYWORDS, "store_info"), (R.DEAL_KEYWORDS, "deal_inquiry"),
                                 (R.CATEGORY_KEYWORDS, "product_search")], "general")


def twin_staff_action(text):
    q = text.lower().strip()
    m = re.search(R.COUNT_PATTERN, q)
    if m:
        s = m.group(1).strip()
        return "count_deals" if any(w in s for w in R.COUNT_DEAL_WORDS) else "count_products"
    for a, ws in R.STAFF_RULES:
        if any(w in q for w in ws):
            return a
    if "brand" in q and any(w in q for w in R.BRAND_QUESTION_WORDS):
        return "list_brands"
    if any(w in q for w in R.DEAL_SUMMARY_WORDS):
        return "deal_summary"
    if re.search(R.PRICE_UNDER_PATTERN, q):
        return "products_under_price"
    if "subcategor" in q:
        return "list_subcategories"
    return None


WORDS = sorted({w for ws in (R.STORE_KEYWORDS, R.DEAL_KEYWORDS, R.CATEGORY_KEYWORDS) for w in ws}
               | {k for k, _ in R.CUSTOMER_CATEGORY_MAP} | {"how many", "count", "total", "under $12", "brand",
                                                          "what", "deal summary", "cheapest", "in", "?", "x", "are there"})


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(WORDS), min_size=0, max_size=6).map(" ".join), min_size=1, max_size=8))
def test_routing_matches_python_twin(spark, texts):
    rows = R.with_staff_route(R.with_intent(_df(spark, texts), "text"), "text").orderBy("id").collect()
    for t, r in zip(texts, rows):
        assert r.intent == twin_intent(t), t
        assert r.action == twin_staff_action(t), t


def test_staff_answers_on_fixture(spark):
    from decimal import Decimal
    from datetime import timedelta
    from larder.operators.answers import staff_answer
    as_of = datetime(2026, 4, 12, 12)
    cat = spark.createDataFrame([("Fresh", "fresh", 1, True), ("Beverages", "beverages", 2, True)],
                                "category string, slug string, display_order int, is_active boolean")
    prod = spark.createDataFrame([
        (1, "Fresh", "Organic Fuji Apple", "Nature's Best", Decimal("1.99"), "FRE-0001", True, True, False, "fruit,apple"),
        (2, "Fresh", "Banana Bundle", None, Decimal("2.49"), "FRE-0002", True, False, False, None),
        (3, "Beverages", "Spring Water", "Crystal Clear", Decimal("4.99"), "BEV-0001", True, False, True, None),
    ], "product_id long, category string, name string, brand string, price decimal(10,2), sku string, "
       "is_available boolean, is_organic boolean, is_store_brand boolean, tags string")
    deals = spark.createDataFrame([(10, 1, "DailyDeal", Decimal("25.00"), as_of, as_of + timedelta(hours=3), True)],
                                  "deal_id long, product_id long, deal_type string, discount_percent decimal(5,2), "
                                  "start_date timestamp, end_date timestamp, is_active boolean")
    qs = spark.createDataFrame([(1, "How many products do we carry?"), (2, "How many organic products are there?"),
                                (3, "What deals are expiring today?"), (4, "Show products under $3"),
                                (5, "Give me a deal summary"), (6, "hello there"),
                                (7, "Show me all categories"), (8, "What are the cheapest fresh products?"),
                                (9, "What brands do we carry?"), (10, "Show me our private label products"),
                                (11, "How many weekly deals are there?"), (12, "What subcategories do we have?")],
                               "question_id long, text string")
    rows = {r.question_id: r for r in staff_answer(qs, prod, cat, deals, as_of=as_of).collect()}
    out = {k: r.answer for k, r in rows.items()}
    assert rows[2].data == '[{"count":1}]' and rows[6].data is None
    assert json.loads(rows[8].data)[1] == {"name": "Banana Bundle", "sku": "FRE-0002", "price": 2.49, "unit": "each",
                                           "category": "Fresh", "brand": None}
    assert json.loads(rows[7].data) == [{"category": "Fresh", "slug": "fresh", "product_count": 2},
                                        {"category": "Beverages", "slug": "beverages", "product_count": 1}]
    assert out[1] == "We carry **3** total products."
    assert out[2] == "We carry **1** organic products."
    assert out[3].startswith("**1 deals expiring today:**\n- Organic Fuji Apple (FRE-0001) — Today Only: 25% Off")
    assert out[4].startswith("**2 products under $3.00 (showing 2):**\n- Organic Fuji Apple (Nature's Best) — $1.99")
    assert out[5] == "**Active deals: 1 total**\n- DailyDeal: 1 deals, avg 25.0% off"
    assert out[6] is None
    assert out[7] == "**Categories:**\n- Fresh — 2 products\n- Beverages — 1 products"
    assert out[8] == ("**Cheapest products in Fresh:**\n- Organic Fuji Apple (Nature's Best) — $1.99/each [FRE-0001]\n"
                      "- Banana Bundle — $2.49/each [FRE-0002]")
    assert out[9] == "**2 brands:**\n- Crystal Clear — 1 products\n- Nature's Best — 1 products"
    assert out[10] == "**Store brand products (1 total, showing 1):**\n- Spring Water — $4.99/each [BEV-0001]"
    assert out[11] == "We have **0** WeeklyDeal deals right now."
    assert out[12] == "**Top product tags:**\n- fruit,apple — 1 products"
