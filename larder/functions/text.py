"""Scalar Column -> Column functions (slugs, SKUs, formats, text builders).

All are built from JVM-side ``pyspark.sql.functions`` so they stay inside
whole-stage codegen; none is a Python UDF.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lit_ts(ts: datetime | Column) -> Column:
    return ts if isinstance(ts, Column) else F.lit(ts)


# Day names indexed by DayOfWeek (0 = Sunday).
DAY_NAMES = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]

# Deal badge labels, and title / description texts per deal type.
DEAL_BADGES = {"BOGO": "BOGO", "WeeklyDeal": "Weekly Deal", "DailyDeal": "Daily Deal"}
BOGO_TITLE = "Buy One Get One Free"
WEEKLY_TITLE = "{pct}% Off This Week"
DAILY_TITLE = "Today Only: {pct}% Off"
BOGO_DESCRIPTION = "Buy one {name} and get one free!"
WEEKLY_DESCRIPTION = "Save {pct}% on {name} this week only!"
DAILY_DESCRIPTION = "Flash deal! Save {pct}% on {name} today only."

# Text-builder sentences.
ORGANIC_SENTENCE = "This is an organic product."
STORE_BRAND_SENTENCE = "This is a GreenWise store brand product."
STORE_BRAND_FACTOR = "0.85"


def _replace(c: Column, search: str, repl: str) -> Column:
    return F.replace(c, F.lit(search), F.lit(repl))


def slug_api(name: ColumnOrName) -> Column:
    """lower, '&' -> 'and', drop apostrophes, space -> '-', one pass of
    '--' -> '-', trim '-' at both ends (plain replaces, not regex)."""
    s = F.lower(_c(name))
    s = _replace(s, "&", "and")
    s = _replace(s, "'", "")
    s = _replace(s, " ", "-")
    s = _replace(s, "--", "-")
    return F.trim(s, F.lit("-"))


def slug_pipeline(name: ColumnOrName) -> Column:
    """catalogue-generator slug: also drops ( ) , and maps / to -,
    double spaces to one before spaces become dashes."""
    s = F.lower(_c(name))
    for a, b in (("&", "and"), ("'", ""), ("(", ""), (")", ""), ("/", "-"), (",", ""),
                 ("  ", " "), (" ", "-"), ("--", "-")):
        s = _replace(s, a, b)
    return F.trim(s, F.lit("-"))


def sku_generate(slug: ColumnOrName, n: ColumnOrName) -> Column:
    """first three slug letters upper-cased, '-', number padded to 4 digits
    (wider numbers keep all digits); unknown category -> 'GEN'."""
    prefix = F.coalesce(F.upper(F.substring(_c(slug), 1, 3)), F.lit("GEN"))
    return F.concat(prefix, F.lit("-"), F.format_string("%04d", _c(n).cast("bigint")))


def money_format(amount: ColumnOrName) -> Column:
    """'$' + two decimals, no thousands separator."""
    return F.format_string("$%.2f", _c(amount).cast("double"))


def deal_badge(deal_type: ColumnOrName) -> Column:
    """display label of a deal type; unknown types show as themselves."""
    c = _c(deal_type)
    out = c
    for k, v in reversed(DEAL_BADGES.items()):
        out = F.when(c == F.lit(k), F.lit(v)).otherwise(out)
    return out


def time_until(end: ColumnOrName, as_of: datetime | Column) -> Column:
    """'Expired', 'Dd Hh' beyond 24 whole hours, else 'Hh Mm'."""
    ms = F.floor((F.unix_micros(_c(end)) - F.unix_micros(_lit_ts(as_of))) / F.lit(1000))
    hours = F.floor(ms / F.lit(3600000))
    minutes = F.floor(F.pmod(ms, F.lit(3600000)) / F.lit(60000))
    return (F.when(ms <= 0, F.lit("Expired"))
            .when(hours > 24, F.format_string("%dd %dh", F.floor(hours / 24), F.pmod(hours, F.lit(24))))
            .otherwise(F.format_string("%dh %dm", hours, minutes)))


def order_number(ts: ColumnOrName, key: ColumnOrName) -> Column:
    """ORD-yyyyMMdd-XXXX; the suffix is the first 4 hex digits of md5(key),
    upper-cased, so re-runs give the same number."""
    return F.concat(F.lit("ORD-"), F.date_format(_c(ts), "yyyyMMdd"), F.lit("-"),
                    F.upper(F.substring(F.md5(_c(key).cast("string")), 1, 4)))


def day_name(day_of_week: ColumnOrName) -> Column:
    """F8: 0 = Sunday ... 6 = Saturday."""
    return F.element_at(F.array(*[F.lit(d) for d in DAY_NAMES]), _c(day_of_week).cast("int") + 1)


def clock_time(minutes_after_midnight: ColumnOrName) -> Column:
    """F8: minutes after midnight as 'h:mm AM' (e.g. 420 -> '7:00 AM')."""
    m = _c(minutes_after_midnight).cast("int")
    h = F.floor(m / 60).cast("int")
    h12 = F.when(F.pmod(h, F.lit(12)) == 0, F.lit(12)).otherwise(F.pmod(h, F.lit(12)))
    return F.format_string("%d:%02d %s", h12, F.pmod(m, F.lit(60)),
                           F.when(F.pmod(h, F.lit(24)) < 12, F.lit("AM")).otherwise(F.lit("PM")))


def plus_minutes(ts: ColumnOrName, minutes: int) -> Column:
    """e.g. estimated delivery = created + 45 minutes."""
    return _c(ts) + F.make_interval(mins=F.lit(minutes))


def next_day_at(ts: ColumnOrName, hour: int) -> Column:
    """the next calendar day (UTC) at ``hour``:00."""
    return F.date_trunc("day", _c(ts)) + F.make_interval(days=F.lit(1), hours=F.lit(hour))


def end_of_day(ts: ColumnOrName) -> Column:
    """same day 23:59:59, keeping the sub-second part (as a replace() of
    hour/minute/second does)."""
    c = _c(ts)
    frac = F.unix_micros(c) - F.unix_micros(F.date_trunc("second", c))
    return F.timestamp_micros(F.unix_micros(F.date_trunc("day", c)) + F.lit(86399 * 1000000) + frac)


def iso_timestamp(ts: ColumnOrName) -> Column:
    """ISO-8601 with UTC offset; fractional seconds only when non-zero."""
    c = _c(ts)
    has_frac = (F.unix_micros(c) % F.lit(1000000)) != 0
    return F.when(c.isNull(), F.lit(None).cast("string")).otherwise(
        F.when(has_frac, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))
         .otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssxxx")))


def product_text_pipeline(name, category, subcategory, brand, price, description, tags,
                          is_organic, is_store_brand) -> Column:
    """F11 (catalogue pipeline variant): labelled lines, '$' price, optional
    tags / organic / store-brand lines."""
    lines = [
        F.concat(F.lit("Product: "), _c(name)),
        F.concat(F.lit("Category: "), _c(category)),
        F.concat(F.lit("Subcategory: "), F.coalesce(_c(subcategory), F.lit(""))),
        F.concat(F.lit("Brand: "), F.coalesce(_c(brand), F.lit("Unknown"))),
        F.concat(F.lit("Price: "), money_format(price)),
        F.concat(F.lit("Description: "), _c(description)),
        F.when(F.coalesce(_c(tags), F.lit("")) != "", F.concat(F.lit("Tags: "), _c(tags))),
        F.when(_c(is_organic), F.lit(ORGANIC_SENTENCE)),
        F.when(_c(is_store_brand), F.lit(STORE_BRAND_SENTENCE)),
    ]
    return F.concat_ws("\n", *lines)


def product_text_notebook(name, category, brand, price, description, is_organic) -> Column:
    """F11 (notebook variant): ``concat_ws`` of 'Label: value' parts, number
    formatted with grouping, and an empty last line when not organic."""
    def part(label, v):
        return F.concat_ws(": ", F.lit(label), v)
    return F.concat_ws(
        "\n",
        part("Product", _c(name)),
        part("Category", _c(category)),
        part("Brand", F.coalesce(_c(brand), F.lit("Unknown"))),
        part("Price", F.format_number(_c(price), 2)),
        part("Description", _c(description)),
        F.when(_c(is_organic), F.lit(ORGANIC_SENTENCE)).otherwise(F.lit("")),
    )


def store_text(name, address, city, state, zip_code, phone, store_number) -> Column:
    """store document text."""
    return F.concat(F.lit("Store: "), _c(name), F.lit("\nAddress: "), _c(address), F.lit(", "),
                    _c(city), F.lit(", "), _c(state), F.lit(" "), _c(zip_code),
                    F.lit("\nPhone: "), _c(phone), F.lit("\nStore Number: "), _c(store_number))


def deal_text(title, deal_type, product_name, category, price, description) -> Column:
    """deal document text; a deal whose product is unknown reads
    'Unknown' / '$0.00'."""
    return F.concat(F.lit("Deal: "), _c(title), F.lit("\nType: "), _c(deal_type),
                    F.lit("\nProduct: "), F.coalesce(_c(product_name), F.lit("Unknown")),
                    F.lit("\nCategory: "), F.coalesce(_c(category), F.lit("Unknown")),
                    F.lit("\nPrice: "), money_format(F.coalesce(_c(price).cast("decimal(20,2)"),
                                                               F.lit(0).cast("decimal(20,2)"))),
                    F.lit("\nDescription: "), F.coalesce(_c(description), F.lit("")))


def deal_title(deal_type: ColumnOrName, pct: ColumnOrName) -> Column:
    """Deal title by type (BOGO has no percentage)."""
    t, p = _c(deal_type), _c(pct).cast("int").cast("string")
    return (F.when(t == "BOGO", F.lit(BOGO_TITLE))
            .when(t == "WeeklyDeal", F.concat(p, F.lit("% Off This Week")))
            .otherwise(F.concat(F.lit("Today Only: "), p, F.lit("% Off"))))


def deal_description(deal_type: ColumnOrName, pct: ColumnOrName, product_name: ColumnOrName) -> Column:
    t, p, n = _c(deal_type), _c(pct).cast("int").cast("string"), _c(product_name)
    return (F.when(t == "BOGO", F.concat(F.lit("Buy one "), n, F.lit(" and get one free!")))
            .when(t == "WeeklyDeal", F.concat(F.lit("Save "), p, F.lit("% on "), n, F.lit(" this week only!")))
            .otherwise(F.concat(F.lit("Flash deal! Save "), p, F.lit("% on "), n, F.lit(" today only."))))


def tags_build(category, subcategory, is_organic, is_store_brand) -> Column:
    """category, subcategory (' & ' -> ',', space -> '-'), then the
    organic and store-brand tags when set."""
    sub = _replace(_replace(F.lower(_c(subcategory)), " & ", ","), " ", "-")
    return F.concat_ws(",", F.lower(_c(category)), sub,
                       F.when(_c(is_organic), F.lit("organic")),
                       F.when(_c(is_store_brand), F.lit("store-brand")))


def unit_weight_from_name(name: ColumnOrName) -> Column:
    """struct(unit, weight) parsed from a product name. Rule order:
    'lb' -> 'oz' -> 'gal' (any case) -> 'ct' / 'pk' / 'Roll' -> each."""
    n = _c(name)

    def num(unit_rx: str, default: str) -> Column:
        v = F.regexp_extract(n, rf"(\d+(?:\.\d+)?)\s*(?:{unit_rx})", 1)
        return F.when(v == "", F.lit(default)).otherwise(v)

    unit = (F.when(n.contains("lb") | F.lower(n).contains("per lb"), F.lit("lb"))
            .when(n.contains("oz"), F.lit("oz"))
            .when(F.lower(n).contains("gal"), F.lit("gallon"))
            .when(n.contains("ct") | n.contains("pk") | n.contains("Roll"), F.lit("each"))
            .otherwise(F.lit("each")))
    weight = (F.when(n.contains("lb") | F.lower(n).contains("per lb"), F.concat(num("lb", "1"), F.lit(" lb")))
              .when(n.contains("oz"), F.concat(num("oz", "12"), F.lit(" oz")))
              .when(F.lower(n).contains("gal"), F.lit("1 gallon"))
              .when(n.contains("ct") | n.contains("pk") | n.contains("Roll"),
                    F.concat(num("ct|pk|Roll", "1"), F.lit(" ct")))
              .otherwise(F.lit("1 each")))
    return F.struct(unit.alias("unit"), weight.alias("weight"))


def store_brand_price(price: ColumnOrName, is_store_brand: ColumnOrName) -> Column:
    """F16: store-brand price x 0.85, rounded half-up to cents."""
    p = _c(price)
    return F.when(_c(is_store_brand), F.round(p * F.lit(STORE_BRAND_FACTOR).cast("decimal(3,2)"), 2)
                  .cast("decimal(10,2)")).otherwise(p.cast("decimal(10,2)"))


def title_case(s: ColumnOrName) -> Column:
    """'most expensive' -> 'Most Expensive'."""
    return F.initcap(_c(s))


def null_default(c: ColumnOrName, default) -> Column:
    """payload / brand defaults."""
    return F.coalesce(_c(c), F.lit(default))


CART_JSON_SCHEMA = "array<struct<ProductId:bigint,Quantity:bigint>>"
SESSION_JSON_SCHEMA = "struct<messages:array<struct<role:string,content:string,timestamp:string>>,created_at:string>"


def cart_to_json(items: ColumnOrName) -> Column:
    """cart lines (array<struct<product_id, quantity>>) as the stored
    JSON list ``[{"ProductId":..,"Quantity":..}]``."""
    return F.to_json(F.transform(_c(items), lambda s: F.struct(s["product_id"].alias("ProductId"),
                                                               s["quantity"].alias("Quantity"))))


def cart_from_json(text: ColumnOrName) -> Column:
    """stored cart JSON back to array<struct<product_id, quantity>>."""
    parsed = F.from_json(_c(text), CART_JSON_SCHEMA)
    return F.transform(parsed, lambda s: F.struct(s["ProductId"].alias("product_id"), s["Quantity"].alias("quantity")))


def sku_list_json(skus: ColumnOrName) -> Column:
    """retrieved product skus stored as a JSON text list."""
    return F.to_json(_c(skus))
