"""Catalogue filters, search, paging, top-k and lookups (B, C, E families).

Top-k and pages are ``orderBy(...).offset(o).limit(n)``, which Spark plans as
one ``TakeOrderedAndProject``: every partition keeps only its best ``o + n``
rows, so no full sort or shuffle of the catalogue happens. Deep pages should
use :func:`keyset_page` (a predicate on the last seen sort key) instead of a
large offset. Totals are attached as scalar subqueries.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.operators.analytics import products_in_categories
from larder.operators.skew import hottest, salted_join
from larder.operators.text_index import matching, write_index


#: Distances held at a time by nearest_stores_batch (8 MB).
CELL_DISTANCES = 1 << 20
#: Cell sizes of nearest_stores_cells: from the whole extent down to 2^-LEVELS of it.
LEVELS = 16


def active_deal_filter(as_of: datetime) -> Column:
    """A deal is live when flagged active and not yet ended (start not checked)."""
    return F.col("is_active") & (F.col("end_date") > F.lit(as_of))


def find_products(prod: DataFrame, cat: DataFrame, deals: DataFrame, *, as_of: datetime,
                  category: str | None = None, brand: str | None = None,
                  organic: bool | None = None, deals_only: bool | None = None, index: str | None = None) -> DataFrame:
    """Available products with the optional filters of the list
    endpoint. ``deals_only`` is an EXISTS on live deals (left-semi join). With
    ``index`` (see :func:`index_products_text`) the brand is looked up there first."""
    if brand and index:
        prod = matching(prod, index, key="product_id", fields=["brand"], term=brand)
    p = products_in_categories(prod, cat).filter(F.col("is_available"))
    if category is not None:
        p = p.filter(F.col("category") == F.lit(category))
    if brand:
        p = p.filter(F.col("brand").isNotNull() &
                     F.lower("brand").contains(F.lit(brand.lower())))
    if organic is True:
        p = p.filter(F.col("is_organic"))
    if deals_only is True:
        p = products_with_any_deal(p, deals, as_of=as_of)
    return p


def product_sort(sort: str | None) -> list[Column]:
    """price_asc / price_desc / name; anything else sorts by name. The
    product id breaks ties so pages are stable."""
    s = (sort or "").lower()
    if s == "price_asc":
        return [F.asc("price"), F.asc("product_id")]
    if s == "price_desc":
        return [F.desc("price"), F.asc("product_id")]
    return [F.asc("name"), F.asc("product_id")]


def paginate(df: DataFrame, *, order: list[Column], page: int, size: int) -> DataFrame:
    """One page plus TotalCount, TotalPages (ceil), HasNext, HasPrevious."""
    if page < 1 or size < 1:
        raise ValueError("page and size start at 1")
    total = df.agg(F.count(F.lit(1))).scalar()
    rows = df.orderBy(*order).offset((page - 1) * size).limit(size)
    total_pages = F.ceil(total / F.lit(size)).cast("bigint")
    return (rows.withColumn("total_count", total)
            .withColumn("page", F.lit(page)).withColumn("page_size", F.lit(size))
            .withColumn("total_pages", total_pages)
            .withColumn("has_next", F.lit(page) < total_pages)
            .withColumn("has_previous", F.lit(page > 1)))


def keyset_page(df: DataFrame, *, key: str, after=None, size: int, descending: bool = False) -> DataFrame:
    """Deep-page form of E2: rows after the last seen (unique) key value."""
    if after is not None:
        df = df.filter(F.col(key) < F.lit(after) if descending else F.col(key) > F.lit(after))
    return df.orderBy(F.desc(key) if descending else F.asc(key)).limit(size)


SEARCH_FIELDS = ["name", "description", "brand", "tags"]


def index_products_text(prod: DataFrame, path: str) -> None:
    """Trigram index of the searched product fields, written once per catalogue version."""
    write_index(prod, path, key="product_id", fields=SEARCH_FIELDS)


def product_search(prod: DataFrame, *, term: str, index: str | None = None) -> DataFrame:
    """Case-insensitive substring over name, description, brand, tags
    (available only); ordered by name. A blank term is rejected. With ``index`` only
    the index's candidates are read and verified."""
    if term is None or not term.strip():
        raise ValueError("search term is required")
    if index:
        return matching(prod, index, key="product_id", fields=SEARCH_FIELDS, term=term).filter(F.col("is_available"))
    q = F.lit(term.lower())
    hit = (F.lower("name").contains(q) | F.lower("description").contains(q) |
           (F.col("brand").isNotNull() & F.lower("brand").contains(q)) |
           (F.col("tags").isNotNull() & F.lower("tags").contains(q)))
    return prod.filter(F.col("is_available") & hit)


def product_search_ranked(prod: DataFrame, cat: DataFrame, *, term: str, index: str | None = None) -> DataFrame:
    """LIKE '%term%' over the four text columns (user % and _ stay
    wildcards); ``name_rank`` 0 for name hits sorts them first. With ``index`` only
    the index's candidates are read and verified."""
    if index:
        prod = matching(prod, index, key="product_id", fields=SEARCH_FIELDS, term=term, like=True)
    pat = f"%{term.lower()}%"
    hit = (F.lower("name").like(pat) | F.lower("description").like(pat) |
           F.lower(F.coalesce("brand", F.lit(""))).like(pat) |
           F.lower(F.coalesce("tags", F.lit(""))).like(pat))
    return (products_in_categories(prod, cat)
            .filter(F.col("is_available") & hit)
            .withColumn("name_rank", F.when(F.lower("name").like(pat), 0).otherwise(1)))


def ranked_order():
    return [F.asc("name_rank"), F.asc("name"), F.asc("product_id")]


def products_by_slug(prod: DataFrame, cat: DataFrame, *, slug: str) -> DataFrame:
    """Products of the category with this slug (available); unknown -> empty."""
    c = cat.filter(F.col("slug") == F.lit(slug)).select("category")
    return prod.filter(F.col("is_available")).join(c, "category", "left_semi")


def lookup_by_id(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """B12 batch form: rows whose key is in ``keys`` (semi join; no match -> empty)."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def first_active_deal(deals: DataFrame, *, as_of: datetime) -> DataFrame:
    """C11: one live deal per product: earliest end date, then lowest deal id."""
    w = Window.partitionBy("product_id").orderBy(F.asc("end_date"), F.asc("deal_id"))
    return (deals.filter(active_deal_filter(as_of))
            .withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") == 1).drop("_rn"))


def products_with_any_deal(prod: DataFrame, deals: DataFrame, *, as_of: datetime) -> DataFrame:
    """EXISTS a live deal (left-semi)."""
    return prod.join(deals.filter(active_deal_filter(as_of)).select("product_id"),
                     "product_id", "left_semi")


def products_without_deal(prod: DataFrame, deals: DataFrame, *, as_of: datetime) -> DataFrame:
    """Available products with no live deal (left-anti; no NOT IN null trap)."""
    return (prod.filter(F.col("is_available"))
            .join(deals.filter(active_deal_filter(as_of)).select("product_id"),
                  "product_id", "left_anti"))


def product_view(prod: DataFrame, cat: DataFrame, deals: DataFrame, *, as_of: datetime,
                 nested: bool = True) -> DataFrame:
    """Product row with its first live deal as a nested struct (or null).
    ``nested=False`` gives the flattened columns ``deal_*``."""
    from larder.functions.text import deal_title
    fd = first_active_deal(deals, as_of=as_of).select(
        "product_id", F.col("deal_id").alias("deal_deal_id"),
        F.col("deal_type").alias("deal_deal_type"),
        deal_title("deal_type", "discount_percent").alias("deal_title"),
        F.col("discount_percent").alias("deal_discount_percent"),
        F.col("end_date").alias("deal_end_date"))
    p = products_in_categories(prod, cat).join(fd, "product_id", "left")
    if not nested:
        return p
    deal_cols = ["deal_deal_id", "deal_deal_type", "deal_title", "deal_discount_percent", "deal_end_date"]
    active = F.when(F.col("deal_deal_id").isNull(), F.lit(None)).otherwise(F.struct(
        F.col("deal_deal_id").alias("id"), F.col("deal_deal_type").alias("deal_type"),
        F.col("deal_title").alias("title"), F.col("deal_discount_percent").alias("discount_percent"),
        F.col("deal_end_date").alias("end_date")))
    return p.withColumn("active_deal", active).drop(*deal_cols)


def _price_sorted(prod: DataFrame, cat: DataFrame, *, category: str | None, k: int,
                  descending: bool) -> DataFrame:
    p = products_in_categories(prod, cat).filter(F.col("is_available"))
    if category is not None:
        p = p.filter(F.col("category") == F.lit(category))
    order = [F.desc("price") if descending else F.asc("price"), F.asc("product_id")]
    return p.select("product_id", "name", "sku", "price", "category", "brand").orderBy(*order).limit(k)


def cheapest_products(prod: DataFrame, cat: DataFrame, *, category: str | None = None,
                      k: int = 5) -> DataFrame:
    """Available products by price ascending, top k."""
    return _price_sorted(prod, cat, category=category, k=k, descending=False)


def most_expensive_products(prod: DataFrame, cat: DataFrame, *, category: str | None = None,
                            k: int = 5) -> DataFrame:
    """Available products by price descending, top k."""
    return _price_sorted(prod, cat, category=category, k=k, descending=True)


def products_under_price(prod: DataFrame, cat: DataFrame, *, max_price: float,
                         category: str | None = None, k: int = 10) -> DataFrame:
    """Price < max, cheapest first, top k, with the full match count."""
    p = products_in_categories(prod, cat).filter(
        F.col("is_available") & (F.col("price") < F.lit(max_price)))
    if category is not None:
        p = p.filter(F.col("category") == F.lit(category))
    total = p.agg(F.count(F.lit(1))).scalar()
    return (p.select("product_id", "name", "sku", "price", "brand", "category")
            .orderBy(F.asc("price"), F.asc("product_id")).limit(k)
            .withColumn("total", total))


def store_brand_products(prod: DataFrame, cat: DataFrame, *, category: str | None = None,
                         k: int = 10) -> DataFrame:
    """Available store-brand products by name, top k. The total counts
    all available store-brand products and ignores the category."""
    base = prod.filter(F.col("is_available") & F.col("is_store_brand"))
    total = base.agg(F.count(F.lit(1))).scalar()
    p = products_in_categories(base, cat)
    if category is not None:
        p = p.filter(F.col("category") == F.lit(category))
    return (p.select("product_id", "name", "sku", "price", "brand", "category")
            .orderBy(F.asc("name"), F.asc("product_id")).limit(k)
            .withColumn("total", total))


def random_sample_k(df: DataFrame, *, key: str, seed: int, k: int) -> DataFrame:
    """E5: k rows in a seeded, repeatable pseudo-random order (md5 of seed:key);
    a top-k, so no full sort."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return df.withColumn("_h", h).orderBy("_h", key).limit(k).drop("_h")


def name_dedupe(prod: DataFrame) -> DataFrame:
    """first product per (category, lower(trim(name))), by product id."""
    w = Window.partitionBy("category", F.lower(F.trim("name"))).orderBy("product_id")
    return prod.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def nearest_stores(stores: DataFrame, *, lat: float, lng: float, k: int | None = None) -> DataFrame:
    """Open stores ordered by |dlat| + |dlng| from one point, nearest first
    (store id breaks ties). With ``k`` it is a top-k, otherwise a full sort."""
    d = (stores.filter(F.col("is_open"))
         .withColumn("distance", F.abs(F.col("latitude") - F.lit(lat).cast("decimal(10,7)")) +
                     F.abs(F.col("longitude") - F.lit(lng).cast("decimal(10,7)"))))
    d = d.orderBy(F.asc("distance"), F.asc("store_id"))
    return d.limit(k) if k is not None else d


def bulk_insert_products(target: DataFrame, incoming: DataFrame, cat: DataFrame, *,
                         skip_above: int | None = None) -> DataFrame:
    """A4: incoming catalogue rows -> rows to insert. Category slugs map to
    categories (unknown slugs dropped); within the batch the first row per
    sku wins; skus already in the target are skipped (ON CONFLICT DO NOTHING).
    ``skip_above``: insert nothing when the target already has more rows."""
    mapped = incoming.join(cat.select(F.col("slug").alias("category_slug"), "category"),
                           "category_slug", "inner")
    w = Window.partitionBy("sku").orderBy("seq")
    first = mapped.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    new = first.join(target.select("sku"), "sku", "left_anti")
    if skip_above is not None:
        n = target.agg(F.count(F.lit(1))).scalar()
        new = new.filter(n <= F.lit(skip_above))
    return new


def bulk_insert_deals(target: DataFrame, incoming: DataFrame, prod: DataFrame, *,
                      skip_above: int | None = None) -> DataFrame:
    """A5: incoming deals keyed by product sku -> rows to insert (unmatched
    skus dropped)."""
    new = incoming.join(prod.select(F.col("sku").alias("product_sku"), "product_id"),
                        "product_sku", "inner")
    if skip_above is not None:
        n = target.agg(F.count(F.lit(1))).scalar()
        new = new.filter(n <= F.lit(skip_above))
    return new


def store_hours_expand(stores: DataFrame, *, open_minutes: int = 7 * 60,
                       close_minutes: int = 22 * 60) -> DataFrame:
    """A10: one row per store and weekday 0-6 with default hours (generated
    per store row by ``sequence``; no join)."""
    return (stores.select("store_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("day_of_week"))
            .withColumn("open_minutes", F.lit(open_minutes))
            .withColumn("close_minutes", F.lit(close_minutes)))


def open_stores(stores: DataFrame, hours: DataFrame) -> DataFrame:
    """Open stores by store number, each with its hours nested and
    sorted by day (a per-store collect of at most 7 rows)."""
    from larder.functions.text import clock_time, day_name
    h = (hours.groupBy("store_id")
         .agg(F.sort_array(F.collect_list(F.struct(
             F.col("day_of_week"), day_name("day_of_week").alias("day"),
             clock_time("open_minutes").alias("open_time"),
             clock_time("close_minutes").alias("close_time")))).alias("hours")))
    return (stores.filter(F.col("is_open")).join(h, "store_id", "left")
            .orderBy("store_number"))


def nearest_stores_batch(points: DataFrame, stores: DataFrame, *, k: int, block_rows: int = 4096,
                         chunk_rows: int = 4096) -> DataFrame:
    """E6 batch form for few stores: the k nearest open stores (|dlat| + |dlng|, store id
    breaks ties) for every point of ``points`` (point_id, lat, lng); all pairs are compared
    (:func:`nearest_stores_cells` avoids that).

    Points are hashed into blocks and stores into chunks; each (block, chunk)
    cell keeps its k best stores per point, and a window over these few ranks
    them. Neither side passes through the driver and distances are held for
    CELL_DISTANCES pairs at a time. Coordinates are DECIMAL(10,7) and are compared as
    exact integers (units of 1e-7)."""
    import numpy as np
    import pandas as pd
    from pyspark.sql import types as T

    e7 = lambda c: F.round(F.col(c).cast("double") * 1e7).cast("long")
    open_s = stores.filter(F.col("is_open")).select("store_id", e7("latitude").alias("_la"), e7("longitude").alias("_lo"))
    pts = points.select("point_id", e7("lat").alias("_la"), e7("lng").alias("_lo"))
    n_p, n_s = pts.count(), open_s.count()
    nb = max(1, -(-n_p // block_rows))
    nc = max(1, -(-n_s // chunk_rows))
    copies = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = pts.withColumn("_b", F.pmod(F.xxhash64("point_id"), F.lit(nb))).withColumn("_c", copies(nc))
    right = open_s.withColumn("_c", F.pmod(F.xxhash64("store_id"), F.lit(nc))).withColumn("_b", copies(nb))
    schema = T.StructType([T.StructField("point_id", points.schema["point_id"].dataType),
                           T.StructField("store_id", stores.schema["store_id"].dataType), T.StructField("distance_e7", T.LongType())])

    def cell(pp: pd.DataFrame, ss: pd.DataFrame) -> pd.DataFrame:
        ss = ss.sort_values("store_id")
        sid, kk = ss["store_id"].to_numpy(), min(k, len(ss))
        step = max(1, CELL_DISTANCES // max(1, len(ss)))
        out = [pd.DataFrame({"point_id": [], "store_id": [], "distance_e7": []})]
        for i in range(0, len(pp) if kk else 0, step):
            p = pp.iloc[i:i + step]
            d = (np.abs(p["_la"].to_numpy()[:, None] - ss["_la"].to_numpy()[None]) +
                 np.abs(p["_lo"].to_numpy()[:, None] - ss["_lo"].to_numpy()[None]))
            order = np.argsort(d, axis=1, kind="stable")[:, :kk]  # distance, then store id
            out.append(pd.DataFrame({"point_id": np.repeat(p["point_id"].to_numpy(), kk), "store_id": sid[order].ravel(),
                                     "distance_e7": np.take_along_axis(d, order, axis=1).ravel()}))
        return pd.concat(out[1:] or out)
    cand = left.groupBy("_b", "_c").cogroup(right.groupBy("_b", "_c")).applyInPandas(cell, schema)
    w = Window.partitionBy("point_id").orderBy("distance_e7", "store_id")
    return cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _cells(level, around: bool) -> Column:
    """Cell (level, x, y) of a row's coordinates, or its 3 x 3 neighbourhood."""
    x, y = F.expr("shiftright(_la, level)"), F.expr("shiftright(_lo, level)")
    steps = (-1, 0, 1) if around else (0,)
    return F.explode(F.array(*[F.struct(level.alias("level"), (x + i).alias("x"), (y + j).alias("y")) for i in steps for j in steps]))


def nearest_stores_cells(points: DataFrame, stores: DataFrame, *, k: int) -> DataFrame:
    """E6 batch form without all pairs: the k nearest open stores (|dlat| + |dlng|, store id
    breaks ties) for every point of ``points`` (point_id, lat, lng; unique ids).

    Stores lie in square cells of every size, halved LEVELS times from the whole
    extent. A point starts at the smallest cell whose 3 x 3 neighbourhood holds k
    stores; the k-th distance found there bounds the answer, so the point widens once
    to the smallest cells at least that wide, whose neighbourhood holds every store
    within the bound. Cells are met by two equi-joins (hot cells salted), candidates
    are cut to k per point before they are shuffled, and no point meets all stores
    unless they are all within its bound. Coordinates are DECIMAL(10,7), compared as exact
    integers (units of 1e-7). Points or stores without coordinates are not matched."""
    from larder.session import ensure_checkpoint_dir

    e7 = lambda c: F.round(F.col(c).cast("double") * 1e7).cast("long")
    known = F.col("_la").isNotNull() & F.col("_lo").isNotNull()
    open_s = stores.filter(F.col("is_open")).select("store_id", e7("latitude").alias("_la"), e7("longitude").alias("_lo")).filter(known)
    pts = points.select("point_id", e7("lat").alias("_la"), e7("lng").alias("_lo")).filter(known)
    # of stores in one place only the k lowest ids can be answers
    place = Window.partitionBy("_la", "_lo").orderBy("store_id")
    open_s = open_s.withColumn("_rn", F.row_number().over(place)).filter(F.col("_rn") <= k).drop("_rn")
    ensure_checkpoint_dir(stores.sparkSession)
    open_s = open_s.checkpoint(eager=True)
    box = pts.select("_la", "_lo").unionByName(open_s.select("_la", "_lo")).agg(
        F.max("_la") - F.min("_la"), F.max("_lo") - F.min("_lo")).first()
    n, extent = open_s.count(), max(x or 0 for x in box)
    top = max(1, extent.bit_length() + 1)  # neighbourhoods at this level hold everything
    levels = list(range(max(0, top - LEVELS), top + 1))
    want = min(k, n)

    every_level = F.explode(F.array(*[F.lit(x) for x in levels])).alias("level")
    leveled = open_s.select("*", every_level)
    cells = leveled.select("store_id", F.col("_la").alias("_sla"), F.col("_lo").alias("_slo"), _cells(F.col("level"), False).alias("c")).select("store_id", "_sla", "_slo", "c.*")
    count = cells.groupBy("level", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    around = F.explode(F.array(*[F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    enough = (count.select("level", "n", around.alias("c")).groupBy("level", "c.x", "c.y").agg(F.sum("n").alias("n")).filter(F.col("n") >= want)
              .select("level", "x", "y"))
    tried = pts.select("*", every_level).withColumn("x", F.expr("shiftright(_la, level)")).withColumn("y", F.expr("shiftright(_lo, level)"))
    start = tried.join(enough, ["level", "x", "y"]).groupBy("point_id", "_la", "_lo").agg(F.min("level").alias("level"))

    def meet(p: DataFrame) -> DataFrame:
        p = p.checkpoint(eager=True)
        near = p.select("point_id", "_la", "_lo", _cells(F.col("level"), True).alias("c")).select("point_id", "_la", "_lo", "c.*")
        hot = hottest(near.groupBy("level", "x", "y").agg(F.count(F.lit(1)).alias("uses")), ["level", "x", "y"], "uses")
        d = F.abs(F.col("_la") - F.col("_sla")) + F.abs(F.col("_lo") - F.col("_slo"))
        w = Window.partitionBy("point_id").orderBy("distance_e7", "store_id")
        return (salted_join(near, cells, ["level", "x", "y"], hot, "point_id").select("point_id", "_la", "_lo", "store_id", d.alias("distance_e7"))
                .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k))
    bound = meet(start).groupBy("point_id", "_la", "_lo").agg(F.max("distance_e7").alias("_d"))
    # smallest level whose cells are wider than the bound (the next power of two), within the levels
    wide = F.length(F.regexp_replace(F.bin("_d"), "^0+", ""))
    second = bound.select("point_id", "_la", "_lo", F.least(F.greatest(wide, F.lit(levels[0])), F.lit(levels[-1])).cast("int").alias("level"))
    return meet(second).select("point_id", "store_id", "distance_e7", "rank")
