"""Deal listings, views and the deal maintenance jobs (B7-B8, B10, B15, C2,
C7, C13, I6-I8, I12 deals)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.text import deal_description, deal_title, end_of_day, next_day_at
from larder.operators.catalog import active_deal_filter


def with_deal_text(deals: DataFrame, prod: DataFrame) -> DataFrame:
    """Deals with their title and description texts (product name joined in)."""
    return (deals.join(prod.select("product_id", F.col("name").alias("product_name")), "product_id", "left")
            .withColumn("title", deal_title("deal_type", "discount_percent"))
            .withColumn("description", deal_description("deal_type", "discount_percent", "product_name"))
            .drop("product_name"))


def active_deals(deals: DataFrame, *, as_of: datetime, deal_type: str | None = None) -> DataFrame:
    """Live deals, optionally of one type (page with ``paginate`` by
    end_date, deal_id)."""
    d = deals.filter(active_deal_filter(as_of))
    if deal_type:
        d = d.filter(F.col("deal_type") == F.lit(deal_type))
    return d


def active_deal_order():
    return [F.asc("end_date"), F.asc("deal_id")]


def deals_by_type(deals: DataFrame, *, as_of: datetime, deal_type: str) -> DataFrame:
    """Unpaged list of live deals of one type, by end date."""
    return active_deals(deals, as_of=as_of, deal_type=deal_type).orderBy(*active_deal_order())


def deal_view(deals: DataFrame, prod: DataFrame, cat: DataFrame) -> DataFrame:
    """Deal + product name, price + category name."""
    return (deals.join(prod.select("product_id", F.col("name").alias("product_name"),
                                   F.col("price").alias("product_price"), "category"),
                       "product_id", "inner")
            .join(cat.select("category"), "category", "inner"))


def expiring_deals(deals: DataFrame, prod: DataFrame, *, as_of: datetime, k: int = 20) -> DataFrame:
    """Live deals ending between ``as_of`` and the same day
    23:59:59 (inclusive), with product name and sku, soonest first, top k."""
    lo = F.lit(as_of)
    hi = end_of_day(F.lit(as_of))
    d = (deals.filter(F.col("is_active") & F.col("end_date").between(lo, hi))
         .join(prod.select("product_id", F.col("name").alias("product_name"), "sku"), "product_id", "inner")
         .withColumn("title", deal_title("deal_type", "discount_percent")))
    return (d.select("deal_id", "title", "deal_type", "end_date", "product_name", "sku")
            .orderBy(F.asc("end_date"), F.asc("deal_id")).limit(k))


def deal_text_join(deals: DataFrame, prod: DataFrame) -> DataFrame:
    """Deal rows with the product fields their text needs; unknown
    products read 'Unknown' and price 0."""
    return (deals.join(prod.select("product_id", F.col("name").alias("product_name"),
                                   "category", "price"), "product_id", "left")
            .withColumn("product_name", F.coalesce("product_name", F.lit("Unknown")))
            .withColumn("category", F.coalesce("category", F.lit("Unknown")))
            .withColumn("price", F.coalesce("price", F.lit(0).cast("decimal(10,2)"))))


def deal_expire(deals: DataFrame, *, as_of: datetime) -> DataFrame:
    """Daily deals that ended before ``as_of`` and are still flagged
    active become inactive; ``updated_at`` is stamped on those rows only (I13)."""
    hit = (F.col("deal_type") == "DailyDeal") & (F.col("end_date") < F.lit(as_of)) & F.col("is_active")
    return (deals.withColumn("_hit", hit)
            .withColumn("is_active", F.when(F.col("_hit"), F.lit(False)).otherwise(F.col("is_active")))
            .withColumn("updated_at", F.when(F.col("_hit"), F.lit(as_of)).otherwise(
                F.col("updated_at") if "updated_at" in deals.columns else F.lit(None).cast("timestamp")))
            .drop("_hit"))


# Daily-deal percentages of the rotation job, in order.
ROTATION_PCTS = [25, 30, 35, 40, 50]


def deal_rotation(deals: DataFrame, prod: DataFrame, *, as_of: datetime, seed: int,
                  k: int = 15) -> DataFrame:
    """Expire daily deals (I6), then pick k available products without a
    live deal in a seeded order and create daily deals for them ending the
    next day at 05:00 UTC. Returns the new deal rows."""
    expired = deal_expire(deals, as_of=as_of)
    eligible = (prod.filter(F.col("is_available"))
                .join(expired.filter(active_deal_filter(as_of)).select("product_id"),
                      "product_id", "left_anti"))
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col("product_id").cast("string")))
    picked = (eligible.withColumn("_h", h).orderBy("_h", "product_id").limit(k))
    pct_arr = F.array(*[F.lit(p) for p in ROTATION_PCTS])
    pct = F.element_at(pct_arr, (F.pmod(F.conv(F.substring("_h", 1, 8), 16, 10).cast("bigint"),
                                        F.lit(len(ROTATION_PCTS))) + 1).cast("int"))
    return (picked.withColumn("discount_percent", pct.cast("decimal(5,2)"))
            .select(F.col("product_id"), F.lit("DailyDeal").alias("deal_type"),
                    deal_title(F.lit("DailyDeal"), "discount_percent").alias("title"),
                    deal_description(F.lit("DailyDeal"), "discount_percent", "name").alias("description"),
                    "discount_percent",
                    F.lit(as_of).alias("start_date"),
                    next_day_at(F.lit(as_of), 5).alias("end_date"),
                    F.lit(True).alias("is_active")))


def deal_assignment(prod: DataFrame, *, as_of: datetime, seed: int,
                    counts: tuple[int, int, int] = (200, 150, 15)) -> DataFrame:
    """I8: disjoint seeded sample of products for BOGO / weekly / daily deals.

    Products are ranked once by a seeded hash; ranks 1..b are BOGO, the next
    w weekly (20-40 %), the next d daily (25-50 %). Windows: BOGO -2/+12 days,
    weekly -1/+6 days, daily today 00:00 to tomorrow 00:00 (UTC).
    The rank is a global row_number over a hash: Spark range-partitions the
    hash for it, which is the only way to give exact disjoint slices.
    """
    b, w, d = counts
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col("product_id").cast("string")))
    ranked = (prod.select("product_id", "sku", "name").withColumn("_h", h)
              .orderBy("_h", "product_id").limit(b + w + d)
              .withColumn("rank", F.row_number().over(Window.orderBy("_h", "product_id"))))
    r = F.col("rank")
    return _assigned(ranked, r <= b, r <= b + w, as_of, "rank")


def _assigned(rows: DataFrame, bogo: Column, weekly: Column, as_of: datetime, *extra: str) -> DataFrame:
    """Deal rows of assigned products: the first condition that holds gives the type, the rest are daily."""
    deal_type = F.when(bogo, "BOGO").when(weekly, "WeeklyDeal").otherwise("DailyDeal")
    pick = F.pmod(F.conv(F.substring("_h", 9, 8), 16, 10).cast("bigint"), F.lit(1000))
    weekly_pct = F.element_at(F.array(*[F.lit(x) for x in (20, 25, 30, 35, 40)]),
                              (F.pmod(pick, F.lit(5)) + 1).cast("int"))
    daily_pct = F.element_at(F.array(*[F.lit(x) for x in (25, 30, 35, 40, 45, 50)]),
                             (F.pmod(pick, F.lit(6)) + 1).cast("int"))
    pct = F.when(bogo, F.lit(None)).when(weekly, weekly_pct).otherwise(daily_pct)
    day0 = F.date_trunc("day", F.lit(as_of))
    now = F.lit(as_of)
    start = (F.when(bogo, now - F.make_interval(days=F.lit(2)))
             .when(weekly, now - F.make_interval(days=F.lit(1))).otherwise(day0))
    end = (F.when(bogo, now + F.make_interval(days=F.lit(12)))
           .when(weekly, now + F.make_interval(days=F.lit(6)))
           .otherwise(day0 + F.make_interval(days=F.lit(1))))
    return (rows.select("product_id", F.col("sku").alias("product_sku"), "name", *extra,
                        deal_type.alias("deal_type"), pct.cast("decimal(5,2)").alias("discount_percent"),
                        start.alias("start_date"), end.alias("end_date"),
                        F.lit(True).alias("is_active"))
            .withColumn("title", deal_title("deal_type", "discount_percent"))
            .withColumn("buy_quantity", F.when(F.col("deal_type") == "BOGO", F.lit(1)))
            .withColumn("get_quantity", F.when(F.col("deal_type") == "BOGO", F.lit(1))))


#: Hash digits (hexadecimal) told apart in one pass of hash_cuts.
CUT_DIGITS = 4


def hash_cuts(rows: DataFrame, ranks: list[int], *, passes: int = 2) -> list[str]:
    """Hash (column ``_h``, hexadecimal) of the row of each rank in hash order ('' for rank 0).

    Each pass counts the rows by the next CUT_DIGITS digits, only inside the slices that
    hold a wanted rank: at most 65,536 counts a rank reach the driver, whatever the
    table's size. After ``passes`` of them a slice holds n / 16^8 different hashes, which
    are counted one by one. No sort and no global window."""
    at = {r: ("", r) for r in ranks if r > 0}
    for depth in [*(CUT_DIGITS * (i + 1) for i in range(passes)), 32]:
        if not at:
            break
        done = len(next(iter(at.values()))[0])
        inside = rows if not done else rows.filter(F.substring("_h", 1, done).isin(sorted({p for p, _ in at.values()})))
        counts = sorted(tuple(x) for x in inside.groupBy(F.substring("_h", 1, depth).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
        for r, (prefix, left) in at.items():
            last = None
            for p, n in counts:
                if p.startswith(prefix):
                    last = p
                    if n >= left:
                        break
                    left -= n
            if last is not None:
                at[r] = (last, left)
    return [at[r][0] if r > 0 else "" for r in ranks]


def deal_assignment_shares(prod: DataFrame, *, as_of: datetime, seed: int,
                           shares: tuple[int, int, int] = (606, 455, 45)) -> DataFrame:
    """I8 for catalogues of any size: shares of all products, in ten-thousandths, get
    BOGO / weekly / daily deals; sizes are rounded down, slices are disjoint and exact to
    the row. Same hash order, types, percentages and windows as :func:`deal_assignment`.
    Products are cut by hash values found from histograms, not ranked. Rows of equal
    product_id share a hash and stay in one slice; null ids take no part."""
    rows = prod.select("product_id", "sku", "name").filter(F.col("product_id").isNotNull()).withColumn(
        "_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("product_id").cast("string"))))
    n = rows.count()
    b, w, d = (n * x // 10_000 for x in shares)
    cut_b, cut_w, cut_d = hash_cuts(rows, [b, b + w, b + w + d])
    return _assigned(rows.filter(F.col("_h") <= cut_d), F.col("_h") <= cut_b, F.col("_h") <= cut_w, as_of)


def deal_upsert(target: DataFrame, changes: DataFrame, *, as_of: datetime) -> DataFrame:
    """I12 (deals): apply change rows (op create / update / delete) keyed by
    deal_id. Updates overwrite all given fields, deletes clear the active flag
    (soft delete), creates insert unknown ids; changes to missing ids other
    than creates are ignored. The last change per id wins. ``updated_at`` is
    set on modified rows only (I13)."""
    fields = ["product_id", "deal_type", "discount_percent", "start_date", "end_date", "is_active"]
    w = Window.partitionBy("deal_id").orderBy(F.desc("change_seq"))
    last = changes.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    ch = last.select("deal_id", "op", *[F.col(c).alias(f"_n_{c}") for c in fields])
    j = target.withColumn("_known", F.lit(True)).join(ch, "deal_id", "full_outer")
    exists = F.col("_known").isNotNull()
    upd = exists & (F.col("op") == "update")
    dele = exists & (F.col("op") == "delete")
    ins = ~exists & (F.col("op") == "create")
    new = {c: F.when(upd | ins, F.col(f"_n_{c}")).otherwise(F.col(c)) for c in fields}
    new["is_active"] = F.when(dele, F.lit(False)).otherwise(new["is_active"])
    before = F.col("updated_at") if "updated_at" in target.columns else F.lit(None).cast("timestamp")
    new["updated_at"] = F.when(upd | dele | ins, F.lit(as_of)).otherwise(before)
    rest = [c for c in target.columns if c not in ("deal_id", *fields, "updated_at")]
    return j.filter(exists | ins).select("deal_id", *[new[c].alias(c) for c in fields], *rest, new["updated_at"].alias("updated_at"))
