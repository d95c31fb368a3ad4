"""Driver tables read as panel products, forecasts and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidepanel.functions.values import INFINITY
from tidepanel.functions.dates import DayLike
from tidepanel.operators.joins import join_domains
from tidepanel.operators.select import before
from tidepanel.specs import DAY, PRODUCTS, SITE, SNAPSHOT, VINTAGE, WEATHER_METRICS, ProductSpec

TIE = ("record_key",)
#: Fixed value: the first day that is no history in the event tables.
EVENT_AS_OF = "2024-01-20"


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; its footer is read for the schema only once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def nation_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region")
    nation = table(spark, sf_dir, "nation")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias(SITE), F.col("n_name").alias("name"), F.col("r_name").alias("sector")
    )


def supplier_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry that grows with the data: one sampling point per supplier."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.cast("string").alias(SITE),
        F.col("s_name").alias("name"),
        F.col("s_nationkey").cast("string").alias("coastal_sector"),
        (F.lit(5.0) + (key % 70) / 10).alias("lat_land"),
        (F.lit(78.0) + (key % 50) / 10).alias("lon_land"),
        (F.lit(5.0) + (key % 60) / 10).alias("lat_sea"),
        F.when(key % 9 != 0, F.lit(78.0) + (key % 40) / 10).alias("lon_sea"),
    )


def _key(*columns: str) -> Column:
    return F.concat_ws("-", *[F.col(c).cast("string") for c in columns])


def _snapshot() -> Column:
    month = F.lpad((F.lit(1) + F.col("l_orderkey") % 12).cast("string"), 2, "0")
    day = F.lpad((F.lit(1) + F.col("l_partkey") % 28).cast("string"), 2, "0")
    return F.when(F.col("l_returnflag") == "N", F.lit("historical")).otherwise(
        F.concat(F.lit("2020-"), month, F.lit("-"), day)
    )


def _line_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias(SITE))
    lineitem = table(spark, sf_dir, "lineitem")
    return lineitem.join(supplier, lineitem.l_suppkey == supplier.s_suppkey)


def weather_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_sites(spark, sf_dir).select(
        SITE,
        F.col("l_shipdate").cast("date").alias(DAY),
        F.when(F.col("l_linestatus") == "F", "weather_reanalysis").otherwise("weather_recent").alias("product"),
        F.when(F.col("l_linestatus") == "F", "era5").otherwise("ecmwf_ifs025").alias("model"),
        _snapshot().alias(SNAPSHOT),
        F.col("l_quantity").alias("precipitation_sum"),
        F.when(F.col("l_tax") != 0, F.col("l_quantity") * 0.4).alias("wind_speed_10m_max"),
        (F.col("l_partkey") % 361).cast("double").alias("wind_direction_10m_dominant"),
        (F.col("l_tax") != 0).alias("complete_core"),
        _key("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("record_key"),
        F.lit(False).alias("is_synthetic"),
    )


def marine_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias(SITE))
    orders = table(spark, sf_dir, "orders")
    complete = F.col("o_orderpriority") != "5-LOW"
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        SITE,
        F.col("o_orderdate").cast("date").alias(DAY),
        F.when(F.col("o_orderstatus") == "F", "marine_reanalysis").otherwise("marine_recent").alias("product"),
        F.when(F.col("o_orderstatus") == "F", "era5_ocean").otherwise("ecmwf_wam").alias("model"),
        F.lit("historical").alias(SNAPSHOT),
        F.when(complete, F.col("o_totalprice") / 100000).alias("wave_height_max"),
        complete.alias("complete_core"),
        F.col("o_orderkey").cast("string").alias("record_key"),
        F.lit(False).alias("is_synthetic"),
    )


def _metrics(spec: ProductSpec, amount: Column) -> list[Column]:
    """Every metric of a product inside its bounds, minima below means below maxima."""

    def level(name: str) -> int:
        return 1000 if name.startswith("pressure") else 12 if name.endswith("_max") else 4 if name.endswith("_min") else 8

    return [(F.lit(float(level(m))) + amount).alias(m) for m in spec.metrics]


def bundle_products(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The six raw products out of line items and orders; forecasts are recent rows moved ahead by 400 days."""
    keys = [F.col(SITE).cast("string").alias(SITE), F.col(DAY), F.col("model"), F.col(SNAPSHOT)]
    amounts = {"weather": (weather_raw(spark, sf_dir), "precipitation_sum"), "marine": (marine_raw(spark, sf_dir), "wave_height_max")}
    out = {}
    for name, spec in PRODUCTS.items():
        raw, metric = amounts[spec.domain]
        rows = raw.where(F.col("model") == spec.model).groupBy(*keys).agg((F.coalesce(F.max(metric), F.lit(0.0)) / 100).alias("_amount"))
        if spec.kind == "forecasts":
            rows = rows.withColumn(DAY, F.date_add(DAY, 400))
        out[name] = rows.select(SITE, DAY, "model", SNAPSHOT, *_metrics(spec, F.col("_amount")))
    return out


def bundle_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry of all nations as it stands in a CSV."""
    key = F.col(SITE)
    places = {"lat_land": 5 + key / 10, "lon_land": 78 + key / 10, "lat_sea": 5.5 + key / 10, "lon_sea": 78.5 + key / 10}
    sites = nation_sites(spark, sf_dir).select(key, "name", F.col("sector").alias("coastal_sector"), *[c.alias(n) for n, c in places.items()])
    return sites.withColumn(SITE, key.cast("string"))


def catch(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("species"))
    lines = _line_sites(spark, sf_dir)
    species = F.col("species")
    category = (
        F.when(species.isin("ECONOMY", "SMALL"), "small_pelagic")
        .when(species.isin("LARGE", "PROMO"), "large_pelagic")
        .when(species == "MEDIUM", "demersal")
        .otherwise("other")
    )
    return (
        lines.join(part, lines.l_partkey == part.p_partkey)
        .groupBy(SITE, F.col("l_shipdate").cast("date").alias(DAY), "species")
        .agg(F.sum("l_quantity").alias("catch_weight_kg"))
        .withColumn("fish_category", category)
    )


def ocean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ocean record per customer and order day."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias(SITE), F.col("o_orderdate").cast("date").alias(DAY))
        .agg(
            (F.max("o_totalprice") / 10000).alias("sea_surface_temperature"),
            (F.min("o_totalprice") / 1000).alias("salinity"),
            F.max("o_orderstatus").alias("measurement_kind"),
            F.max("o_orderpriority").alias("source"),
        )
    )


def customer_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias(SITE), F.col("c_name").alias("name"))


def _event_days(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...]) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .where(F.col("event_type").isin(*kinds))
        .select(F.col("user_id").alias(SITE), F.col("ts").cast("date").alias(DAY), "event_id", "value")
    )


def event_history_days(spark: SparkSession, sf_dir: str, as_of: DayLike = EVENT_AS_OF) -> DataFrame:
    """Days that count as history: those before ``as_of``."""
    return before(_event_days(spark, sf_dir, ("view",)), as_of)


def event_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_history_days(spark, sf_dir).groupBy(SITE, DAY).agg(
        F.max("value").alias("wind_speed_10m_max"), F.min("value").alias("wave_height_max")
    )


FORECAST_KINDS = ("click", "signup", "purchase", "error")


def event_forecast_days(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = FORECAST_KINDS) -> DataFrame:
    return _event_days(spark, sf_dir, kinds)


def _event_forecast(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...], metric: str, domain: str) -> DataFrame:
    days = event_forecast_days(spark, sf_dir, kinds)
    vintage = F.concat(F.lit("v"), (F.col("event_id") % 3).cast("string"))
    return (
        days.groupBy(SITE, DAY, vintage.alias(SNAPSHOT))
        .agg(F.max("value").alias(metric))
        .withColumns(
            {
                "model": F.lit("ecmwf"),
                "product": F.lit(f"{domain}_forecasts"),
                "complete_core": F.lit(True),
                "is_synthetic": F.lit(False),
            }
        )
    )


def event_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_forecast(spark, sf_dir, FORECAST_KINDS[:2], "wind_speed_10m_max", "weather")


def event_marine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_forecast(spark, sf_dir, FORECAST_KINDS[2:], "wave_height_max", "marine")


def event_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joined forecasts reduced to what the timeline and the map need."""
    from tidepanel.operators.joins import join_domains

    joined = join_domains(event_weather(spark, sf_dir), event_marine(spark, sf_dir), forecast=True)
    return joined.select(SITE, DAY, VINTAGE, "wind_speed_10m_max", "wave_height_max")


def dirty_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather product whose rows break every product rule somewhere."""
    quantity, discount, tax = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    mean = discount * 1000 - 30
    odd_date = (F.col("l_linenumber") == 7) & (F.col("l_returnflag") == "R")
    day = F.col("l_shipdate").cast("date").cast("string")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias(SITE),
        F.when(odd_date, F.replace(day, F.lit("-"), F.lit("/"))).otherwise(day).alias(DAY),
        F.when(F.col("l_linestatus") == "F", "era5").otherwise("other").alias("model"),
        F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).alias(SNAPSHOT),
        F.when(discount == 0.1, "trace").otherwise((quantity - 3).cast("string")).alias("precipitation_sum"),
        (quantity / 2).alias("precipitation_hours"),
        F.when(tax != 0, quantity * 0.4).alias("wind_speed_10m_max"),
        F.when((tax == 0.08) & (discount == 0), F.lit(INFINITY))
        .otherwise(quantity * 0.2)
        .alias("wind_speed_10m_mean"),
        (F.col("l_partkey") % 365).cast("double").alias("wind_direction_10m_dominant"),
        mean.alias("temperature_2m_mean"),
        (mean + tax * 100).alias("temperature_2m_max"),
        (mean - tax * 100 + 2).alias("temperature_2m_min"),
        (quantity * 2.1).alias("relative_humidity_2m_mean"),
        (F.lit(750.0) + F.col("l_partkey") % 400).alias("pressure_msl_mean"),
    )


DIRTY_SPEC = ProductSpec(
    "weather",
    "reanalysis",
    WEATHER_METRICS,
    "era5",
    ("temperature_2m_min", "temperature_2m_mean", "temperature_2m_max"),
)


def registered_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "supplier")
        .where("s_acctbal >= 0")
        .select(F.col("s_suppkey").cast("string").alias(SITE))
    )


def dirty_catch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catch records with empty weights, odd categories, repeats and unknown harbours."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        F.col("l_suppkey").cast("string").alias(SITE),
        F.col("l_shipdate").cast("date").cast("string").alias(DAY),
        (F.col("l_partkey") % 7).cast("string").alias("species"),
        F.when(F.col("l_linenumber") == 1, "shellfish").otherwise("other").alias("fish_category"),
        F.when(F.col("l_tax") != 0, (F.col("l_quantity") - 2).cast("string")).alias("catch_weight_kg"),
        F.when(F.col("l_returnflag") != "R", "ledger").alias("source"),
        F.lit("https://example.org").alias("source_url"),
    )


def dirty_ocean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ocean records by customer and day, one row per order."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_custkey").cast("string").alias(SITE),
        F.col("o_orderdate").cast("date").alias(DAY),
        (F.col("o_totalprice") / 10000).alias("sea_surface_temperature"),
        (F.col("o_totalprice") / 1000 - 10).alias("salinity"),
        F.when(F.col("o_orderstatus") == "F", "observation")
        .when(F.col("o_orderstatus") == "O", "model_estimate")
        .otherwise("guess")
        .alias("measurement_kind"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("source"),
        F.lit("https://example.org").alias("source_url"),
    )


def registered_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "customer")
        .where("c_acctbal >= 0")
        .select(F.col("c_custkey").cast("string").alias(SITE))
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A species catalogue with one entry per part."""
    return table(spark, sf_dir, "part").select(
        F.concat_ws(" ", "p_brand", "p_name", F.col("p_size").cast("string")).alias("species"),
        F.col("p_name").alias("common_name"),
        F.lower("p_type").alias("fish_category"),
        F.when(F.col("p_size") > 5, F.concat(F.col("p_size").cast("string"), F.lit(" m"))).alias("depth_zone"),
        F.lit("Not supplied").alias("seasonal_note"),
        F.col("p_brand").alias("source"),
        F.lit("https://example.org").alias("source_url"),
    )
