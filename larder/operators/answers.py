"""Answer building for batches of questions.

Everything is keyed by ``query_id``; every per-query group is bounded by a
retrieval depth (<= 10 hits) or the history window (<= 10 turns), so the
``collect_list`` calls below never gather an unbounded group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions import routing as R
from larder.functions.text import deal_title, end_of_day
from larder.session import ensure_checkpoint_dir

# Prompts and context layout.
SYSTEM_PROMPT_TEMPLATE = """You are a helpful AI shopping assistant for {shop}, a grocery delivery service with 9 store locations in the Lakeland, Florida area.

Your capabilities:
- Search and recommend products from our catalog of 3,000+ items across 6 categories
- Inform customers about current deals (BOGO, Weekly Deals, Daily Deals)
- Provide store locations, hours, and contact information
- Help build shopping lists and suggest meal ideas
- Answer questions about product availability and pricing

Rules:
1. Only recommend products that appear in the provided context.
2. Always mention current deals when they apply to recommended products.
3. Include prices in your recommendations.
4. If asked about something outside grocery shopping, politely redirect.
5. Format product recommendations clearly with name, price, and any active deals.
6. If you don't have information about a specific product, say so honestly.
7. Be friendly, concise, and helpful — like a knowledgeable grocery store associate.
8. When listing multiple products, use a numbered list for clarity."""

STAFF_SYSTEM_PROMPT_TEMPLATE = """You are an internal AI assistant for {shop} store associates and managers.
You help staff with:
- Product lookups (stock, pricing, SKUs, brands)
- Deal status and performance
- Category and subcategory information
- Customer question preparation (helping staff answer customer questions)

Rules:
1. Be concise and data-driven. Staff want facts, not marketing copy.
2. Always include SKUs and exact prices when referencing products.
3. When showing deals, include the deal type, discount, and expiry date.
4. If you don't have data, say so — don't guess inventory or pricing.
5. For managers: include aggregate data (counts, averages) when relevant.
6. Format responses for quick scanning — use bullet points and bold for key numbers."""

# The shop's display name is deployment data, passed in by the caller.
DEFAULT_SHOP = "our grocery shop"
SYSTEM_PROMPT = SYSTEM_PROMPT_TEMPLATE.replace("{shop}", DEFAULT_SHOP)
STAFF_SYSTEM_PROMPT = STAFF_SYSTEM_PROMPT_TEMPLATE.replace("{shop}", DEFAULT_SHOP)


def system_prompt(shop: str = DEFAULT_SHOP, *, staff: bool = False) -> str:
    return (STAFF_SYSTEM_PROMPT_TEMPLATE if staff else SYSTEM_PROMPT_TEMPLATE).replace("{shop}", shop)


PRODUCTS_HEADING = "=== Available Products ==="
DEALS_HEADING = "\n=== Current Deals ==="
STORES_HEADING = "\n=== Store Locations ==="
NO_CONTEXT = "No relevant products found in our catalog."
CONTEXT_LIMITS = (8, 5, 3)
HISTORY_TURNS = 10
REF_PRODUCTS = 5
STAFF_ROLES = ("associate", "manager")


def _num_text(c: Column) -> Column:
    """Whole numbers without decimals (25), others as plain decimals."""
    d = c.cast("double")
    return F.when(d == F.floor(d), F.floor(d).cast("bigint").cast("string")).otherwise(d.cast("string"))


def _lines(df: DataFrame, line: Column, limit: int, name: str) -> DataFrame:
    """Per query: the first ``limit`` lines by rank, joined with newlines."""
    top = df.filter(F.col("rank") <= limit).select("query_id", "rank", line.alias("_line"))
    return (top.groupBy("query_id")
            .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "_line"))),
                                          lambda s: s["_line"]), "\n").alias(name)))


def build_context(queries: DataFrame, product_hits: DataFrame, deal_hits: DataFrame,
                  store_hits: DataFrame) -> DataFrame:
    """Per query, the context text: <= 8 products, <= 5 deals, <= 3
    stores under fixed headings; nothing retrieved -> fallback sentence."""
    kp, kd, ks = CONTEXT_LIMITS
    pl = F.concat(F.lit("- "), F.col("name"), F.lit(" | "), F.format_string("$%.2f", F.col("price").cast("double")),
                  F.lit("/"), F.col("unit"), F.lit(" | "), F.col("category"),
                  F.when(F.col("is_organic"), F.lit(" | Organic")).otherwise(F.lit("")),
                  F.when(F.coalesce(F.col("brand"), F.lit("")) != "", F.concat(F.lit(" | "), F.col("brand")))
                  .otherwise(F.lit("")))
    dl = F.concat(F.lit("- "), F.col("title"), F.lit(": "), F.col("product_name"), F.lit(" ("), F.col("deal_type"),
                  F.lit(")"),
                  F.when(F.coalesce(F.col("discount_percent").cast("double"), F.lit(0.0)) != 0,
                         F.concat(F.lit(" — "), _num_text(F.col("discount_percent")), F.lit("% off")))
                  .otherwise(F.lit("")))
    sl = F.concat(F.lit("- "), F.col("name"), F.lit(": "), F.col("address"), F.lit(", "), F.col("city"), F.lit(", "),
                  F.col("state"), F.lit(" "), F.col("zip_code"), F.lit(" | Phone: "), F.col("phone"))
    p = _lines(product_hits, pl, kp, "_p")
    d = _lines(deal_hits, dl, kd, "_d")
    s = _lines(store_hits, sl, ks, "_s")
    j = queries.select("query_id").join(p, "query_id", "left").join(d, "query_id", "left").join(s, "query_id", "left")
    parts = F.concat_ws("\n",
                        F.when(F.col("_p").isNotNull(), F.concat(F.lit(PRODUCTS_HEADING + "\n"), F.col("_p"))),
                        F.when(F.col("_d").isNotNull(), F.concat(F.lit(DEALS_HEADING + "\n"), F.col("_d"))),
                        F.when(F.col("_s").isNotNull(), F.concat(F.lit(STORES_HEADING + "\n"), F.col("_s"))))
    return j.select("query_id", F.when(parts == "", F.lit(NO_CONTEXT)).otherwise(parts).alias("context"))


def history_window(turns: DataFrame, *, key: str = "conv_id", n: int = HISTORY_TURNS) -> DataFrame:
    """For every user or assistant turn, the (role, content) of the up to ``n``
    turns before it in its session, oldest first. System turns are not stored,
    and a session that expired (I3) leaves no history.

    No conversation-wide window: positions come from the two-level running
    count, each turn is copied to the ``n`` positions that follow it (bounded
    replication), and each position collects at most ``n`` entries."""
    from larder.operators.orders import running_count
    from larder.operators.sessions import chat_session_state
    said = chat_session_state(turns.filter(F.col("role").isin("user", "assistant")), key=key)
    said = said.withColumn("_s", F.concat_ws(":", key, "session_no"))
    pos = running_count(said, part="_s", ts="turn", tie="turn", flag=F.lit(True), name="_pos",
                        bucket=F.floor(F.col("turn") / F.lit(10_000)))
    src = pos.select("_s", "_pos", F.struct(F.col("role").alias("role"), F.col("text").alias("content")).alias("_m"))
    fan = src.withColumn("_target", F.explode(F.sequence(F.col("_pos") + 1, F.col("_pos") + n)))
    hist = (fan.groupBy("_s", "_target")
            .agg(F.sort_array(F.collect_list(F.struct("_pos", "_m"))).alias("_h"))
            .select("_s", F.col("_target").alias("_pos"), F.transform("_h", lambda e: e["_m"]).alias("history")))
    empty = F.array().cast("array<struct<role:string,content:string>>")
    return (pos.join(hist, ["_s", "_pos"], "left")
            .withColumn("history", F.coalesce("history", empty)).drop("_pos", "_s"))


def build_messages(questions: DataFrame, *, prompt: str = SYSTEM_PROMPT, staff_role: str | None = None) -> DataFrame:
    """System prompt + last 10 history turns + the augmented user turn.

    ``questions``: query_id, text, context, history (array<struct<role, content>>).
    With ``staff_role`` the staff wording and the manager suffix are used."""
    if staff_role is None:
        aug = F.concat(F.lit("Based on the following product information:\n\n"), F.col("context"),
                       F.lit("\n\nCustomer question: "), F.col("text"))
    else:
        suffix = " You are speaking to a store manager." if staff_role == "manager" else ""
        aug = F.concat(F.lit("Based on the following product data:\n\n"), F.col("context"),
                       F.lit(f"\n\nStaff question ({staff_role}): "), F.col("text"), F.lit(suffix))
    # last HISTORY_TURNS entries; slice() with a negative start longer than the
    # array would return an empty array, so the start is computed explicitly
    h = F.col("history")
    hist = F.coalesce(F.slice(h, F.greatest(F.lit(1), F.size(h) - (HISTORY_TURNS - 1)), F.lit(HISTORY_TURNS)),
                      F.array().cast("array<struct<role:string,content:string>>"))
    sys_msg = F.array(F.struct(F.lit("system").alias("role"), F.lit(prompt).alias("content")))
    user_msg = F.array(F.struct(F.lit("user").alias("role"), aug.alias("content")))
    return questions.withColumn("messages", F.concat(sys_msg, hist, user_msg))


def hit_deal_type(product_hits: DataFrame, deal_hits: DataFrame, *, k: int = REF_PRODUCTS) -> DataFrame:
    """For the first k product hits of a query, the type of the first
    (best ranked) retrieved deal on the same sku, or null."""
    p = product_hits.filter(F.col("rank") <= k).select("query_id", "rank", "sku", "name", "price", "category")
    d = deal_hits.select("query_id", F.col("product_sku").alias("sku"), F.col("rank").alias("_dr"), "deal_type")
    best = d.groupBy("query_id", "sku").agg(F.min_by("deal_type", "_dr").alias("deal_type"))
    return p.join(best, ["query_id", "sku"], "left")


def template_generator(pdf: pd.DataFrame) -> pd.Series:
    """Default offline generator: the first context line after the heading,
    so batch runs stay deterministic without a model service."""
    def one(ctx: str) -> str:
        lines = [ln for ln in (ctx or "").split("\n") if ln.startswith("- ")]
        return ("Here is what I found:\n" + "\n".join(lines[:3])) if lines else (ctx or "")
    return pdf["context"].map(one)


def generate(df: DataFrame, generator: Callable[[pd.DataFrame], pd.Series] | None = None) -> DataFrame:
    """Apply a pluggable generator (pandas in, answer Series out) in Arrow
    batches; the default is :func:`template_generator`."""
    gen = generator or template_generator
    schema = T.StructType(df.schema.fields + [T.StructField("response", T.StringType())])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf.assign(response=list(gen(pdf)))
    return df.mapInPandas(run, schema)


def chat_batch(questions: DataFrame, turns: DataFrame, product_hits: DataFrame, deal_hits: DataFrame,
               store_hits: DataFrame, *, generator=None) -> DataFrame:
    """The whole customer flow for a batch of questions.

    ``questions``: query_id, conv_id, turn, text. Scenario (G7) answers that
    skip retrieval are returned as is; others get the retrieval plan (G8)
    applied to the hits, the context (G9), the messages with history (G10),
    the generated answer (scenario text prepended when it asks for
    retrieval too) and up to 5 product references with deal types (C12)."""
    q = R.with_scenario(questions, "text").withColumn(
        "scenario", F.when(F.col("scenario").isNotNull(),
                           F.struct(F.col("scenario").alias("name"), "skip_rag", "message"))).drop("skip_rag", "message")
    ensure_checkpoint_dir(questions.sparkSession)
    # routed once, read by five branches; in two stages, which keeps each one's generated code small
    q = q.checkpoint(eager=True)
    q = q.withColumn("intent", R.classify_intent("text")).withColumn("plan", R.retrieval_plan("intent")).checkpoint(eager=True)
    plan = q.select("query_id", "plan")
    ph = product_hits.join(plan, "query_id").filter(F.col("rank") <= F.col("plan.k_products")).drop("plan")
    dh = deal_hits.join(plan, "query_id").filter(F.col("rank") <= F.col("plan.k_deals")).drop("plan")
    sh = store_hits.join(plan, "query_id").filter(F.col("rank") <= F.col("plan.k_stores")).drop("plan")
    ph, dh = ph.checkpoint(eager=True), dh.checkpoint(eager=True)  # read by the context and by the references
    ctx = build_context(q, ph, dh, sh)
    hist = history_window(turns).select("conv_id", "turn", "history")
    full = q.join(ctx, "query_id", "left").join(hist, ["conv_id", "turn"], "left")
    msgs = build_messages(full).checkpoint(eager=True)  # read by the generated and by the canned answers
    skip = F.coalesce(F.col("scenario.skip_rag"), F.lit(False))
    rag = generate(msgs.filter(~skip))
    rag = rag.withColumn("response", F.when(F.col("scenario").isNotNull(),
                                            F.concat(F.col("scenario.message"), F.lit("\n\n"), F.col("response")))
                         .otherwise(F.col("response"))).withColumn("model", F.lit("template"))
    canned = (msgs.filter(skip).withColumn("response", F.col("scenario.message"))
              .withColumn("model", F.lit("custom")))
    refs = (hit_deal_type(ph, dh)
            .groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "sku", "name", "price",
                                                                            "category", "deal_type"))).alias("products")))
    out = rag.unionByName(canned).join(refs, "query_id", "left")
    return out.select("query_id", "conv_id", "turn", "intent", F.col("scenario.name").alias("scenario"), "response",
                      "model", F.when(skip, F.array()).otherwise(F.coalesce("products", F.array())).alias("products"),
                      F.size("messages").alias("message_count"))


def staff_chat_batch(questions: DataFrame, turns: DataFrame, product_hits: DataFrame, deal_hits: DataFrame, store_hits: DataFrame,
                     prod: DataFrame, cat: DataFrame, deals: DataFrame, *, as_of: datetime, staff_role: str, generator=None) -> DataFrame:
    """G12, staff form: the whole staff flow for a batch of questions.

    ``questions``: query_id, conv_id, turn, text. A question that routes to an action (G4) is
    answered from the catalogue (G11, model ``db_direct``, no products, latency 0). The others
    get ten products, five deals and, where they ask for a store, three stores, the staff
    prompt with the role's wording and the history, a generated answer and up to 5 product
    references. ``prompt`` is the user message sent; ``message_count`` is 0 without one.
    Roles other than STAFF_ROLES are refused."""
    role = (staff_role or "").lower()
    if role not in STAFF_ROLES:
        raise PermissionError(f"the staff role must be one of {', '.join(STAFF_ROLES)}")
    ensure_checkpoint_dir(questions.sparkSession)
    routed = R.with_staff_route(questions.select(F.col("query_id").alias("question_id"), "text"), "text").drop("text").checkpoint(eager=True)
    known = (staff_answer_calls(routed.filter("type = 'db_query'"), prod, cat, deals, as_of=as_of)
             .select(F.col("question_id").alias("query_id"), "action", F.col("answer").alias("response")))
    direct = (questions.join(known, "query_id").withColumn("model", F.lit("db_direct")).withColumn("latency_ms", F.lit(0.0))
              .withColumn("message_count", F.lit(0)))
    q = (questions.join(routed.filter("type = 'rag'").select(F.col("question_id").alias("query_id")), "query_id", "left_semi")
         .withColumn("action", F.lit("rag")).withColumn("intent", R.classify_intent("text"))
         .withColumn("plan", R.retrieval_plan("intent", audience="staff")).checkpoint(eager=True))
    ph, dh, sh = (hits.join(q.select("query_id", "plan"), "query_id").filter(F.col("rank") <= F.col(f"plan.{k}")).drop("plan")
                  for hits, k in ((product_hits, "k_products"), (deal_hits, "k_deals"), (store_hits, "k_stores")))
    ph, dh = ph.checkpoint(eager=True), dh.checkpoint(eager=True)  # read by the context and by the references
    hist = history_window(turns).select("conv_id", "turn", "history")
    full = q.join(build_context(q, ph, dh, sh), "query_id", "left").join(hist, ["conv_id", "turn"], "left")
    asked = generate(build_messages(full, prompt=STAFF_SYSTEM_PROMPT, staff_role=role), generator)
    refs = (hit_deal_type(ph, dh)
            .groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "sku", "name", "price", "category", "deal_type"))).alias("products")))
    asked = (asked.join(refs, "query_id", "left").withColumn("model", F.lit("template"))
             .withColumn("prompt", F.element_at("messages", -1)["content"]).withColumn("message_count", F.size("messages")))
    columns = ["query_id", "conv_id", "turn", "action", "intent", "response", "model", "products", "prompt", "message_count", "latency_ms"]
    out = asked.unionByName(direct, allowMissingColumns=True)
    return out.select(*[F.coalesce("products", F.array()).alias(c) if c == "products" else F.col(c) for c in columns])


# --------------------------------------------------------------------------- G11
def _money(c: str) -> Column:
    return F.format_string("$%.2f", F.col(c).cast("double"))


def _brand_part(c: str = "brand") -> Column:
    return F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(" ("), F.col(c), F.lit(")"))).otherwise("")


def _in_cat(c: str = "category") -> Column:
    return F.when(F.col(c).isNotNull(), F.concat(F.lit(" in "), F.col(c))).otherwise(F.lit(""))


ALL = "all"


def _cat_key(category: Column) -> Column:
    return F.when(category.isNull(), F.lit(ALL)).otherwise(F.concat(F.lit("c:"), category))


def _per_key(df: DataFrame) -> DataFrame:
    """Each row under the key of its category and under the key of all categories."""
    return df.withColumn("_key", F.explode(F.array(_cat_key(F.col("category")), F.lit(ALL))))


def _top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of each key; Spark cuts to k rows a task before the shuffle."""
    w = Window.partitionBy("_key").orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)


def _listing(top: DataFrame, keys: list[str], line: Column, data: list[Column]) -> DataFrame:
    """Lines and data rows of each key in rank order (at most an action's limit)."""
    s = F.sort_array(F.collect_list(F.struct(F.col("_r").alias("o"), line.alias("l"), F.struct(*data).alias("d"))))
    return (top.groupBy(*keys).agg(s.alias("_s"))
            .select(*keys, F.array_join(F.transform("_s", lambda x: x["l"]), "\n").alias("lines"),
                    F.to_json(F.transform("_s", lambda x: x["d"]), {"ignoreNullFields": "false"}).alias("data"),
                    F.size("_s").cast("bigint").alias("shown")))


def _rows_json(order: Column, row: Column) -> Column:
    """``data`` of a group: its rows as JSON, in order (one row per distinct name of a key)."""
    s = F.sort_array(F.collect_list(F.struct(order.alias("o"), row.alias("d"))))
    return F.to_json(F.transform(s, lambda x: x["d"]), {"ignoreNullFields": "false"}).alias("data")


def _asked_brands(brands: DataFrame, asked: DataFrame) -> DataFrame:
    """(lbrand, _b): catalogue brands that contain an asked brand. Both sides are
    distinct names; they meet on the first three letters of the asked one."""
    name = F.col("lbrand")

    def grams(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(name) - (n - 1))
        return F.when(F.length(name) >= n, F.transform(starts, lambda i: F.substring(name, i, F.lit(n)))).otherwise(
            F.array().cast("array<string>"))
    all_grams = F.array_distinct(F.concat(grams(1), grams(2), grams(3)))
    g = brands.select("lbrand", F.explode(all_grams).alias("_g"))
    a = asked.withColumn("_g", F.substring("_b", 1, 3))
    return g.join(a, "_g").filter(name.contains(F.col("_b"))).select("lbrand", "_b").distinct()


def _count_lookup(avail: DataFrame, calls: DataFrame) -> DataFrame:
    """Totals per category key, organic flag and asked brand."""
    asked = calls.filter((F.col("action") == "count_products") & (F.col("_brand") != "")).select(F.col("_brand").alias("_b")).distinct()
    per = avail.groupBy("category", F.lower("brand").alias("lbrand"), "is_organic").agg(F.count(F.lit(1)).alias("n"))
    names = _asked_brands(per.select("lbrand").filter("lbrand is not null").distinct(), asked)
    facts = (per.withColumn("_b", F.lit("")).select("category", "is_organic", "n", "_b")
             .unionByName(per.join(names, "lbrand").select("category", "is_organic", "n", "_b")))
    flag = F.explode(F.when(F.col("is_organic"), F.array(F.lit("false"), F.lit("true"))).otherwise(F.array(F.lit("false"))))
    return (_per_key(facts).withColumn("_o", flag).groupBy("_key", "_o", "_b").agg(F.sum("n").alias("total"))
            .select(F.lit("count_products").alias("action"), "_key", F.concat_ws(":", "_o", "_b").alias("_arg"), "total"))


def _under_price_lookup(cheap: DataFrame, avail: DataFrame, calls: DataFrame, line: Column, data: list[Column]) -> DataFrame:
    """Per asked (category key, limit): total by prefix sums over the sorted prices, and
    the listed rows from the ten cheapest of the key."""
    from larder.operators.orders import running_count
    asks = calls.filter(F.col("action") == "products_under_price").select("_key", "max_price").distinct()
    prices = _per_key(avail.groupBy("category", "price").agg(F.count(F.lit(1)).alias("n"))).groupBy("_key", "price").agg(F.sum("n").alias("n"))
    both = (prices.select("_key", F.col("price").cast("double").alias("_p"), F.lit(1).alias("_kind"), "n")
            .unionByName(asks.select("_key", F.col("max_price").alias("_p"), F.lit(0).alias("_kind"), F.lit(0).cast("bigint").alias("n"))))
    total = (running_count(both, part="_key", ts="_p", tie="_kind", flag=F.col("n"), bucket=F.floor("_p"), name="total")
             .filter("_kind = 0").select("_key", F.col("_p").alias("max_price"), "total"))
    hits = asks.join(cheap, "_key").filter(F.col("price").cast("double") < F.col("max_price"))
    lines = _listing(hits, ["_key", "max_price"], line, data)
    return (total.join(lines, ["_key", "max_price"], "left")
            .select(F.lit("products_under_price").alias("action"), "_key", F.col("max_price").cast("string").alias("_arg"),
                    "total", "shown", "lines", "data"))


def staff_answer(questions: DataFrame, prod: DataFrame, cat: DataFrame, deals: DataFrame, *,
                 as_of: datetime) -> DataFrame:
    """Route every staff question (G4) to its action and answer it from
    the catalogue; 'rag' questions get a null answer (they need a language model).

    Texts are routed once into the shared checkpoint folder: the calls are read three
    times, and the rules inlined into the answer's expressions would outgrow a method."""
    ensure_checkpoint_dir(questions.sparkSession)
    routed = R.with_staff_route(questions.select("question_id", "text"), "text").drop("text").checkpoint(eager=True)
    return staff_answer_calls(routed, prod, cat, deals, as_of=as_of)


def staff_answer_calls(routed: DataFrame, prod: DataFrame, cat: DataFrame, deals: DataFrame, *,
                       as_of: datetime) -> DataFrame:
    """G11 on routed calls (question_id, action, category, brand, organic_only,
    deal_type, max_price; null where an action takes none): answer text and
    ``data``, the listed rows as JSON.

    The answers of all actions form one small table keyed by (action, category
    key, argument), built from catalogue aggregates and top lists; the calls meet
    it in one equi-join, so they are not split by action. Ties are cut by id or
    name. ``data`` of list_brands holds all brands, of which the text lists 15."""
    if "unit" not in prod.columns:
        prod = prod.withColumn("unit", F.lit("each"))
    act = F.col("action")
    calls = (routed.withColumn("_key", _cat_key(F.col("category"))).withColumn("_brand", F.coalesce(F.lower("brand"), F.lit(""))))
    avail = prod.join(cat.select("category"), "category", "inner").filter(F.col("is_available"))
    live = deals.filter(F.col("is_active") & (F.col("end_date") > F.lit(as_of)))
    found = []

    def add(action: str, df: DataFrame) -> None:
        found.append(df.withColumn("action", F.lit(action)))

    priced = F.concat(F.lit(" — "), _money("price"), F.lit("/"), F.col("unit"), F.lit(" ["), F.col("sku"), F.lit("]"))
    line = F.concat(F.lit("- "), F.col("name"), _brand_part(), priced)
    data = [F.col(c) for c in ("name", "sku", "price", "unit", "category", "brand")]
    keyed = _per_key(avail.select("product_id", "is_store_brand", *data))
    cheap = _top(keyed, 10, F.asc("price"), F.asc("product_id"))
    add("cheapest_products", _listing(cheap.filter("_r <= 5"), ["_key"], line, data))
    add("most_expensive_products", _listing(_top(keyed, 5, F.desc("price"), F.asc("product_id")), ["_key"], line, data))
    add("store_brand_products", _listing(_top(keyed.filter("is_store_brand"), 10, F.asc("name"), F.asc("product_id")), ["_key"],
                                         F.concat(F.lit("- "), F.col("name"), priced), data))
    found.append(_under_price_lookup(cheap, avail, calls, line, data))
    found.append(_count_lookup(avail, calls))

    for action, col in (("list_brands", "brand"), ("list_subcategories", "tags")):
        n = (_per_key(avail.filter(F.col(col).isNotNull()).groupBy("category", col).agg(F.count(F.lit(1)).alias("n")))
             .groupBy("_key", col).agg(F.sum("n").alias("product_count")))
        rows = _listing(_top(n, 15, F.desc("product_count"), F.asc(col)), ["_key"],
                        F.concat(F.lit("- "), F.col(col), F.lit(" — "), F.col("product_count").cast("string"), F.lit(" products")),
                        [F.col(col), F.col("product_count")])
        every = n.groupBy("_key").agg(F.count(F.lit(1)).alias("total"), *([_rows_json(F.struct((-F.col("product_count")).alias("o"), F.col(col).alias("t")),
                                                                                  F.struct(col, "product_count"))] if action == "list_brands" else []))
        add(action, (rows.drop("data") if action == "list_brands" else rows).join(every, "_key"))  # the text stops at 15 brands, the data does not

    add("count_deals", live.withColumn("_arg", F.explode(F.array(F.lit(""), F.col("deal_type")))).groupBy("_arg")
        .agg(F.count(F.lit(1)).alias("total")).withColumn("_key", F.lit(ALL)))

    exp = (deals.filter(F.col("is_active") & F.col("end_date").between(F.lit(as_of), end_of_day(F.lit(as_of))))
           .join(prod.select("product_id", F.col("name").alias("product_name"), "sku"), "product_id")
           .withColumn("title", deal_title("deal_type", "discount_percent")).withColumn("_key", F.lit(ALL)))
    add("expiring_deals", _listing(_top(exp, 20, F.asc("end_date"), F.asc("deal_id")), ["_key"],
                                   F.concat(F.lit("- "), F.col("product_name"), F.lit(" ("), F.col("sku"), F.lit(") — "),
                                            F.col("title"), F.lit(" ("), F.col("deal_type"), F.lit(")")),
                                   [F.col(c) for c in ("title", "deal_type", "end_date", "product_name", "sku")]))

    lc = (cat.filter("is_active").join(avail.groupBy("category").agg(F.count(F.lit(1)).alias("n")), "category", "left")
          .withColumn("product_count", F.coalesce("n", F.lit(0))).withColumn("_r", F.struct("display_order", "category")).withColumn("_key", F.lit(ALL)))
    add("list_categories", _listing(lc, ["_key"], F.concat(F.lit("- "), F.col("category"), F.lit(" — "),
                                                           F.col("product_count").cast("string"), F.lit(" products")),
                                    [F.col("category"), F.col("slug"), F.col("product_count")]))

    ds = (live.groupBy("deal_type").agg(F.count(F.lit(1)).alias("cnt"), F.round(F.avg("discount_percent"), 1).alias("avg_discount"))
          .withColumn("_key", F.lit(ALL)).withColumn("_r", F.struct((-F.col("cnt")).alias("c"), "deal_type")))
    ds_line = F.concat(F.lit("- "), F.col("deal_type"), F.lit(": "), F.col("cnt").cast("string"), F.lit(" deals"),
                       F.when(F.coalesce(F.col("avg_discount"), F.lit(0)) != 0,
                              F.concat(F.lit(", avg "), F.col("avg_discount").cast("string"), F.lit("% off"))).otherwise(F.lit("")))
    add("deal_summary", _listing(ds, ["_key"], ds_line, [F.col(c) for c in ("deal_type", "cnt", "avg_discount")])
        .join(ds.groupBy("_key").agg(F.sum("cnt").alias("total")), "_key"))

    lookup = found[0]
    for f in found[1:]:
        lookup = lookup.unionByName(f, allowMissingColumns=True)
    lookup = lookup.withColumn("_arg", F.coalesce("_arg", F.lit("")))
    arg = (F.when(act == "count_products", F.concat_ws(":", F.coalesce("organic_only", F.lit(False)).cast("string"), F.col("_brand")))
           .when(act == "count_deals", F.coalesce("deal_type", F.lit("")))
           .when(act == "products_under_price", F.col("max_price").cast("string")).otherwise(F.lit("")))
    j = calls.withColumn("_arg", F.coalesce(arg, F.lit(""))).join(lookup, ["action", "_key", "_arg"], "left")

    total, shown = (F.coalesce(c, F.lit(0)).cast("string") for c in ("total", "shown"))
    own = prod.filter(F.col("is_available") & F.col("is_store_brand")).agg(F.count(F.lit(1))).scalar()
    desc = F.concat_ws(" ", F.when(F.col("organic_only"), F.lit("organic")),
                       F.when(F.col("category").isNotNull(), F.concat(F.lit("in "), F.col("category"))),
                       F.when(F.col("_brand") != "", F.concat(F.lit("from "), F.col("brand"))))
    say = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    under = lambda head, *rest: F.concat_ws("\n", head, F.col("lines"), *rest)
    more = F.when(F.col("total") > 15, say("  ...and ", (F.col("total") - 15).cast("string"), " more"))
    texts = {
        "count_products": say("We carry **", total, "** ", F.when(desc == "", F.lit("total")).otherwise(desc), " products."),
        "count_deals": say("We have **", total, "** ", F.coalesce("deal_type", F.lit("active")), " deals right now."),
        "expiring_deals": F.when(F.col("shown").isNull(), F.lit("No deals expiring today.")).otherwise(
            under(say("**", shown, " deals expiring today:**"))),
        "list_categories": under(F.lit("**Categories:**")),
        "cheapest_products": under(say("**Cheapest products", _in_cat(), ":**")),
        "most_expensive_products": under(say("**Most Expensive products", _in_cat(), ":**")),
        "store_brand_products": under(say("**Store brand products", _in_cat(), " (", own.cast("string"), " total, showing ", shown, "):**")),
        "list_brands": under(say("**", total, " brands", _in_cat(), ":**"), more),
        "deal_summary": under(say("**Active deals: ", total, " total**")),
        "products_under_price": under(say("**", total, " products under ", F.format_string("$%.2f", F.col("max_price")), _in_cat(),
                                          " (showing ", shown, "):**")),
        "list_subcategories": under(say("**Top product tags", _in_cat(), ":**")),
    }
    answer, rows = F.lit(None).cast("string"), F.coalesce("data", F.lit("[]"))
    for name, text in texts.items():
        answer = F.when(act == name, text).otherwise(answer)
    count = F.to_json(F.array(F.struct(F.coalesce("total", F.lit(0)).alias("count"))))
    rows = F.when(act.isin("count_products", "count_deals"), count).when(act.isNotNull(), rows)
    return j.select("question_id", F.coalesce("action", F.lit("rag")).alias("action"), answer.alias("answer"), rows.alias("data"))


__all__ = ["build_context", "build_messages", "chat_batch", "generate", "hit_deal_type", "history_window",
           "staff_answer", "staff_answer_calls", "staff_chat_batch", "SYSTEM_PROMPT", "STAFF_SYSTEM_PROMPT"]
