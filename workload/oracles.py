"""SQL partners of the registered queries, for DuckDB on the same tables."""

from __future__ import annotations

SITES = """
sites as (
  select n_nationkey as site_id, n_name as name, r_name as sector
  from nation join region on n_regionkey = r_regionkey
)"""

WEATHER = """
weather as (
  select s_nationkey as site_id, cast(l_shipdate as date) as date_local,
    case when l_linestatus = 'F' then 'weather_reanalysis' else 'weather_recent' end as product,
    case when l_linestatus = 'F' then 'era5' else 'ecmwf_ifs025' end as model,
    case when l_returnflag = 'N' then 'historical'
         else concat('2020-', lpad(cast(1 + l_orderkey % 12 as varchar), 2, '0'), '-',
                              lpad(cast(1 + l_partkey % 28 as varchar), 2, '0')) end as snapshot_id,
    l_quantity as precipitation_sum,
    case when l_tax <> 0 then l_quantity * 0.4 end as wind_speed_10m_max,
    cast(l_partkey % 361 as double) as wind_direction_10m_dominant,
    l_tax <> 0 as complete_core,
    concat_ws('-', cast(l_orderkey as varchar), cast(l_linenumber as varchar),
                   cast(l_partkey as varchar), cast(l_suppkey as varchar)) as record_key
  from lineitem join supplier on l_suppkey = s_suppkey
)"""

MARINE = """
marine as (
  select c_nationkey as site_id, cast(o_orderdate as date) as date_local,
    case when o_orderstatus = 'F' then 'marine_reanalysis' else 'marine_recent' end as product,
    case when o_orderstatus = 'F' then 'era5_ocean' else 'ecmwf_wam' end as model,
    'historical' as snapshot_id,
    case when o_orderpriority <> '5-LOW' then o_totalprice / 100000 end as wave_height_max,
    o_orderpriority <> '5-LOW' as complete_core,
    cast(o_orderkey as varchar) as record_key
  from orders join customer on o_custkey = c_custkey
)"""


def _best(name: str, source: str, where: str = "true") -> str:
    return f"""
{name} as (
  select * from {source} where {where}
  qualify row_number() over (
    partition by site_id, date_local
    order by 2 * cast(complete_core as int) + cast(product like '%reanalysis' as int) desc,
             try_cast(snapshot_id as timestamp) desc nulls last, snapshot_id desc, record_key desc) = 1
)"""


BEST_WEATHER = f"{WEATHER},{_best('best_weather', 'weather')}"
BEST_MARINE = f"{MARINE},{_best('best_marine', 'marine')}"
_PAST_REANALYSIS = "product like '%reanalysis' and date_local < date '2000-01-01'"

DAILY = f"""{BEST_WEATHER},{BEST_MARINE},
daily as (
  select *, case when weather_product = 'weather_recent' or marine_product = 'marine_recent'
                 then 'provisional_recent' else 'reanalysis' end as source_kind
  from (
    select coalesce(w.site_id, m.site_id) as site_id, coalesce(w.date_local, m.date_local) as date_local,
      case when w.record_key is not null and m.record_key is not null then 'both'
           when w.record_key is not null then 'left_only' else 'right_only' end as domain_match,
      w.record_key as weather_record_key, m.record_key as marine_record_key,
      w.product as weather_product, m.product as marine_product,
      coalesce(w.complete_core, false) as weather_complete, coalesce(m.complete_core, false) as marine_complete,
      coalesce(w.complete_core, false) and coalesce(m.complete_core, false) as complete_pair,
      precipitation_sum, wind_speed_10m_max, wave_height_max, false as is_synthetic
    from best_weather w full outer join best_marine m
      on w.site_id = m.site_id and w.date_local = m.date_local)
)"""

STATUS = """case
    when wave_height_max is null or wind_speed_10m_max is null then 'Missing indicators'
    when wave_height_max >= {wave} * 1.5 or wind_speed_10m_max >= {wind} * 1.5 then 'Higher values'
    when wave_height_max >= {wave} or wind_speed_10m_max >= {wind} then 'Elevated values'
    else 'Below display thresholds' end"""
DAILY_STATUS = STATUS.format(wave=2.0, wind=10.0)
EVENT_STATUS = STATUS.format(wave=10.0, wind=10.0)

EXPLORED = f"""{DAILY},
explored as (
  select * from (select *, {DAILY_STATUS} as indicator_status from daily)
  where date_local between date '1996-01-01' and date '1999-12-31'
    and indicator_status in ('Higher values', 'Elevated values')
)"""

CATCH = """
catch as (
  select s_nationkey as site_id, cast(l_shipdate as date) as date_local, p_type as species,
    sum(l_quantity) as catch_weight_kg,
    case when p_type in ('ECONOMY', 'SMALL') then 'small_pelagic'
         when p_type in ('LARGE', 'PROMO') then 'large_pelagic'
         when p_type = 'MEDIUM' then 'demersal' else 'other' end as fish_category
  from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
  group by 1, 2, 3
)"""

OCEAN = """
ocean as (
  select o_custkey as site_id, cast(o_orderdate as date) as date_local,
    max(o_totalprice) / 10000 as sea_surface_temperature, min(o_totalprice) / 1000 as salinity,
    max(o_orderstatus) as measurement_kind, max(o_orderpriority) as source
  from orders group by 1, 2
)"""

EVENTS = """
history as (
  select user_id as site_id, cast(ts as date) as date_local,
    max(value) as wind_speed_10m_max, min(value) as wave_height_max
  from events where event_type = 'view' and cast(ts as date) < date '2024-01-20' group by 1, 2
),
fc_weather as (
  select user_id as site_id, cast(ts as date) as date_local,
    concat('v', cast(event_id % 3 as varchar)) as forecast_vintage, max(value) as wind_speed_10m_max
  from events where event_type in ('click', 'signup') group by 1, 2, 3
),
fc_marine as (
  select user_id as site_id, cast(ts as date) as date_local,
    concat('v', cast(event_id % 3 as varchar)) as forecast_vintage, max(value) as wave_height_max
  from events where event_type in ('purchase', 'error') group by 1, 2, 3
),
forecasts as (
  select site_id, date_local, forecast_vintage, wind_speed_10m_max, wave_height_max,
    case when w.wind_speed_10m_max is not null and m.wave_height_max is not null then 'both'
         when w.wind_speed_10m_max is not null then 'left_only' else 'right_only' end as domain_match
  from fc_weather w full outer join fc_marine m using (site_id, date_local, forecast_vintage)
),
latest as (
  select * from forecasts
  qualify row_number() over (partition by site_id, date_local order by forecast_vintage desc) = 1
)"""

COVERAGE = f"""{SITES},{DAILY},
coverage as (
  select s.site_id, y.year, y.expected_days,
    coalesce(c.available_rows, 0) as available_rows, coalesce(c.weather_days, 0) as weather_days,
    coalesce(c.marine_days, 0) as marine_days, coalesce(c.paired_days, 0) as paired_days,
    y.expected_days - coalesce(c.paired_days, 0) as missing_pair_days,
    round_even(100.0::double * coalesce(c.paired_days, 0) / y.expected_days, 2) as coverage_pct
  from sites s cross join (
    select cast(year(d) as int) as year, cast(count(*) as int) as expected_days
    from (select unnest(generate_series(date '1995-03-15', date '2001-12-31', interval 1 day)) as d) group by 1) y
  left join (
    select site_id, year(date_local) as year, count(*) as available_rows,
      count(*) filter (weather_complete) as weather_days, count(*) filter (marine_complete) as marine_days,
      count(*) filter (complete_pair) as paired_days
    from daily where date_local between date '1995-03-15' and date '2001-12-31' group by 1, 2) c
  on c.site_id = s.site_id and c.year = y.year
)"""

DAY = "cast(date_local as varchar) as date_local"
DAILY_OUT = f"""site_id, {DAY}, domain_match, weather_record_key, marine_record_key, weather_product, marine_product,
  weather_complete, marine_complete, complete_pair, precipitation_sum, wind_speed_10m_max, wave_height_max,
  source_kind, is_synthetic"""

DIRTY_WEATHER = """
dirty as (
  select cast(l_suppkey as varchar) as site_id,
    case when not (l_linenumber = 7 and l_returnflag = 'R') then cast(l_shipdate as date) end as good_day,
    case when l_linestatus = 'F' then 'era5' else 'other' end as model,
    case when l_returnflag <> 'A' then l_returnflag end as snapshot_id,
    l_discount = 0.1 as rain_unreadable,
    case when l_discount = 0.1 then null else l_quantity - 3 end as rain,
    l_quantity / 2 as hours,
    case when l_tax <> 0 then l_quantity * 0.4 end as wind_max,
    case when l_tax = 0.08 and l_discount = 0 then null else l_quantity * 0.2 end as wind_mean_finite,
    l_tax = 0.08 and l_discount = 0 as wind_infinite,
    l_partkey % 365 as direction,
    l_discount * 1000 - 30 as t_mean,
    l_discount * 1000 - 30 + l_tax * 100 as t_max,
    l_discount * 1000 - 30 - l_tax * 100 + 2 as t_min,
    l_quantity * 2.1 as humidity, 750.0::double + l_partkey % 400 as pressure
  from lineitem
),
known as (select cast(s_suppkey as varchar) as site_id from supplier where s_acctbal >= 0)"""


def _lines(dataset: str, source: str, rules: list[tuple[str, str, str]]) -> str:
    """One counted line per (rule, column, condition)."""
    return " union all ".join(
        f"select '{dataset}' as dataset, '{code}' as rule, '{column}' as \"column\", "
        f"cast(count(*) filter ({condition}) as bigint) as violations from {source}"
        for code, column, condition in rules
    )


def _surplus(dataset: str, source: str, code: str, keys: str, column: str | None = None) -> str:
    return (
        f"select '{dataset}' as dataset, '{code}' as rule, '{column or keys}' as \"column\", "
        f"cast(coalesce(sum(n - 1), 0) as bigint) as violations from (select count(*) as n from {source} group by {keys})"
    )


def _unknown(dataset: str, source: str, code: str, column: str = "site_id") -> str:
    return (
        f"select '{dataset}' as dataset, '{code}' as rule, '{column}' as \"column\", "
        f"count(*) as violations from {source} where site_id is not null and site_id not in (select site_id from known)"
    )


_METRICS = (
    "precipitation_sum",
    "precipitation_hours",
    "wind_speed_10m_max",
    "wind_speed_10m_mean",
    "wind_direction_10m_dominant",
    "temperature_2m_mean",
    "temperature_2m_max",
    "temperature_2m_min",
    "relative_humidity_2m_mean",
    "pressure_msl_mean",
)
_PRODUCT_RULES = [
    ("V2", "site_id", "site_id is null"),
    ("V2", "date_local", "false"),
    ("V2", "model", "model is null"),
    ("V2", "snapshot_id", "snapshot_id is null"),
    ("V3", "date_local", "good_day is null"),
    ("V5", "model", "model <> 'era5'"),
    *[("V7", m, "rain_unreadable" if m == "precipitation_sum" else "false") for m in _METRICS],
    *[("V8", m, "wind_infinite" if m == "wind_speed_10m_mean" else "false") for m in _METRICS],
    ("V9", "wind_direction_10m_dominant", "direction > 360"),
    ("V10", "precipitation_sum", "rain < 0"),
    ("V10", "precipitation_hours", "hours < 0"),
    ("V10", "wind_speed_10m_max", "wind_max < 0"),
    ("V10", "wind_speed_10m_mean", "wind_mean_finite < 0"),
    ("V11", "temperature_2m_mean", "t_mean not between -90 and 60"),
    ("V11", "temperature_2m_max", "t_max not between -90 and 60"),
    ("V11", "temperature_2m_min", "t_min not between -90 and 60"),
    ("V12", "relative_humidity_2m_mean", "humidity not between 0 and 100"),
    ("V13", "precipitation_hours", "hours not between 0 and 24"),
    ("V14", "pressure_msl_mean", "pressure not between 800 and 1100"),
    (
        "V15",
        "temperature_2m_mean",
        "rain is not null and wind_max is not null and not (t_min <= t_mean and t_mean <= t_max)",
    ),
]

_CATCH_RULES = [
    *[("V22", c, f"{c} is null") for c in ("site_id", "date_local", "species", "fish_category", "source", "source_url")],
    ("V25", "date_local", "false"),
    ("V28", "catch_weight_kg", "catch_weight_kg < 0"),
    ("V30", "fish_category", "fish_category not in ('small_pelagic', 'large_pelagic', 'demersal', 'other')"),
    ("V31", "catch_weight_kg", "catch_weight_kg is null"),
]
_OCEAN_RULES = [
    *[("V22", c, f"{c} is null") for c in ("site_id", "date_local", "measurement_kind", "source", "source_url")],
    ("V25", "date_local", "false"),
    ("V28", "sea_surface_temperature", "false"),
    ("V29", "sea_surface_temperature", "sst not between -5 and 45"),
    ("V28", "salinity", "salinity < 0"),
    ("V32", "measurement_kind", "measurement_kind not in ('observation', 'model_estimate', 'satellite_estimate')"),
]
_REGISTRY_RULES = [
    (code, column, condition)
    for column, low, high in (
        ("lat_land", 5, 11),
        ("lon_land", 78, 83),
        ("lat_sea", 5, 11),
        ("lon_sea", 78, 83),
    )
    for code, condition in (("V18", f"{column} is null"), ("V19", f"{column} not between {low} and {high}"))
]
_PROFILE_COLUMNS = ("species", "common_name", "fish_category", "depth_zone", "seasonal_note", "source", "source_url")

PROFILES = """
profiles as (
  select concat_ws(' ', p_brand, p_name, cast(p_size as varchar)) as species, p_name as common_name,
    lower(p_type) as fish_category, case when p_size > 5 then concat(cast(p_size as varchar), ' m') end as depth_zone,
    'Not supplied' as seasonal_note, p_brand as source, 'https://example.org' as source_url
  from part
)"""

CARDS = f"""{EVENTS},
cards as (
  select site_id, date_local, forecast_vintage, wind_speed_10m_max, wave_height_max from latest
  union all
  select site_id, date_local, null, wind_speed_10m_max, wave_height_max from history h
  where not exists (select 1 from latest l where l.site_id = h.site_id and l.date_local = h.date_local)
)"""


def _lag(days: int) -> str:
    return (
        f"(select p.wave_height_max from best_marine p where p.site_id = b.site_id "
        f"and p.date_local = b.date_local - {days}) as wave_height_max_lag_{days}"
    )


BEST_WEATHER_OUT = f"""with {BEST_WEATHER} select site_id, {DAY}, product, snapshot_id, complete_core,
  precipitation_sum, wind_speed_10m_max, record_key from best_weather"""

ORACLES: dict[str, str] = {
    "best_record_weather": BEST_WEATHER_OUT,
    "best_record_marine": f"with {BEST_MARINE} select site_id, {DAY}, product, complete_core, wave_height_max, record_key from best_marine",
    "reanalysis_only": f"""with {WEATHER},{_best('best', 'weather', _PAST_REANALYSIS)}
        select site_id, {DAY}, snapshot_id, complete_core, record_key from best""",
    "latest_vintage": f"with {EVENTS} select site_id, {DAY}, forecast_vintage, wind_speed_10m_max, wave_height_max from latest",
    "asof_vintage": f"""with {WEATHER}
        select site_id, {DAY}, snapshot_id as forecast_vintage, precipitation_sum, record_key from weather
        where try_cast(snapshot_id as timestamp) <= timestamp '2020-06-15'
        qualify row_number() over (partition by site_id, date_local
          order by try_cast(snapshot_id as timestamp) desc, snapshot_id desc, record_key desc) = 1""",
    "asof_origins": f"""with {WEATHER},
        issued as (
          select site_id, date_local, try_cast(snapshot_id as timestamp) as issued_at, snapshot_id, precipitation_sum, record_key from weather
          where try_cast(snapshot_id as timestamp) is not null
          qualify row_number() over (partition by site_id, date_local, issued_at order by snapshot_id desc, record_key desc) = 1),
        asked as (
          select c_nationkey as site_id, cast(o_orderdate as date) as date_local, o_orderkey,
            make_date(2020, month(o_orderdate), least(day(o_orderdate), 28)) as origin
          from orders join customer on o_custkey = c_custkey)
        select o_orderkey, a.site_id, cast(a.date_local as varchar) as date_local, cast(origin as varchar) as origin,
          snapshot_id as forecast_vintage, precipitation_sum, record_key
        from asked a asof left join issued i
          on a.site_id = i.site_id and a.date_local = i.date_local and cast(a.origin as timestamp) >= i.issued_at""",
    "daily_outer_join": f"with {DAILY} select {DAILY_OUT} from daily",
    "registry_enriched": f"with {SITES},{DAILY} select {DAILY_OUT}, name, sector from daily left join sites using (site_id)",
    "domain_match_counts": f"with {DAILY} select domain_match, count(*) as site_days from daily group by 1",
    "source_kind_mix": f"with {DAILY} select source_kind, complete_pair, count(*) as site_days from daily group by 1, 2",
    "forecast_outer_join": f"""with {EVENTS}
        select site_id, {DAY}, forecast_vintage, domain_match, wind_speed_10m_max, wave_height_max,
          domain_match = 'both' as complete_pair, 'forecast' as source_kind, c_name as name
        from forecasts left join customer on c_custkey = site_id""",
    "simple_inner_loader": f"""with {SITES},{WEATHER},{MARINE},{_best('w', 'weather', _PAST_REANALYSIS)},{_best('m', 'marine', _PAST_REANALYSIS)}
        select w.site_id, cast(w.date_local as varchar) as date_local, w.model, w.snapshot_id, precipitation_sum,
          wave_height_max, name, sector
        from w join m on w.site_id = m.site_id and w.date_local = m.date_local left join sites on sites.site_id = w.site_id""",
    "dense_calendar": f"""with {SITES},{BEST_MARINE},
        days as (select cast(unnest(generate_series(date '1995-03-15', date '2001-12-31', interval 1 day)) as date) as date_local)
        select sites.site_id, cast(days.date_local as varchar) as date_local, name, wave_height_max, record_key is null as gap
        from sites cross join days
        left join best_marine b on b.site_id = sites.site_id and b.date_local = days.date_local""",
    "combined_timeline": f"""with {EVENTS}
        select site_id, {DAY}, null as forecast_vintage, wind_speed_10m_max, wave_height_max from history
        union all
        select site_id, {DAY}, forecast_vintage, wind_speed_10m_max, wave_height_max from latest
        where date_local not in (select date_local from history)""",
    "timeline_per_site": f"""with {EVENTS}
        select site_id, {DAY}, null as forecast_vintage, wind_speed_10m_max, wave_height_max from history
        union all
        select site_id, {DAY}, forecast_vintage, wind_speed_10m_max, wave_height_max from latest l
        where date_local >= date '2024-01-18'
          and not exists (select 1 from history h where h.site_id = l.site_id and h.date_local = l.date_local)""",
    "day_map_status": f"""with {EVENTS},
        chosen as (
          select site_id, date_local, wind_speed_10m_max, wave_height_max from latest
          union all
          select site_id, date_local, wind_speed_10m_max, wave_height_max from history
          where date_local not in (select date_local from forecasts)),
        days as (select cast(unnest(generate_series(date '2024-01-01', date '2024-01-30', interval 1 day)) as date) as date_local),
        points as (
          select c_custkey as site_id, days.date_local, c_name as name,
            coalesce({EVENT_STATUS}, 'Missing indicators') as status
          from customer cross join days
          left join chosen on chosen.site_id = c_custkey and chosen.date_local = days.date_local)
        select site_id, {DAY}, name, status,
          case status when 'Higher values' then '203,69,60,230' when 'Elevated values' then '221,161,54,230'
            when 'Below display thresholds' then '0,127,122,230' else '148,163,184,210' end as color
        from points""",
    "site_day_card": f"""with {CARDS}
        select site_id, {DAY}, forecast_vintage, wind_speed_10m_max, wave_height_max, {EVENT_STATUS} as indicator_status
        from cards""",
    "ocean_cards": f"""with {OCEAN}
        select site_id, cast(o.date_local as varchar) as date_local, last_order, sea_surface_temperature, salinity,
          measurement_kind, source as ocean_source
        from (select o_custkey as site_id, cast(o_orderdate as date) as date_local, max(o_orderkey) as last_order
              from orders group by 1, 2) o
        left join ocean using (site_id, date_local)""",
    "series_bridge": f"""with {EVENTS},
        past as (select site_id, date_local, wind_speed_10m_max as value from history
                 where date_local between date '2024-01-01' and date '2024-01-17'),
        last_point as (select * from past where value is not null
                 qualify row_number() over (partition by site_id order by date_local desc) = 1),
        first_day as (select site_id, min(date_local) as first_day from forecasts group by 1)
        select site_id, {DAY}, value, 'history' as series from past
        union all select site_id, {DAY}, wind_speed_10m_max, 'forecast' from latest
        union all select site_id, {DAY}, value, 'forecast' from last_point join first_day using (site_id)
                  where date_local < first_day""",
    "coverage_by_year": f"with {COVERAGE} select * from coverage",
    "coverage_year_rollup": f"""with {COVERAGE}
        select year, cast(sum(expected_days) as bigint) as expected_days, cast(sum(paired_days) as bigint) as paired_days,
          cast(sum(missing_pair_days) as bigint) as missing_pair_days from coverage group by 1""",
    "coverage_pivot": f"""with {COVERAGE}
        select site_id, {', '.join(f"max(coverage_pct) filter (year = {y}) as y{y}" for y in range(1995, 2002))}
        from coverage group by 1""",
    "indicator_mix": f"""with {DAILY} select {DAILY_STATUS} as status, source_kind, count(*) as site_days
        from daily group by 1, 2""",
    "explorer_filter": f"""with {EXPLORED} select site_id, {DAY}, source_kind, precipitation_sum, wind_speed_10m_max,
          wave_height_max, indicator_status from explored where site_id in (3, 7, 12, 18, 24)""",
    "explorer_page": f"""with {DAILY} select site_id, {DAY}, domain_match, precipitation_sum
        from daily order by daily.site_id, daily.date_local limit 100 offset 200""",
    "explorer_deep_page": f"""with {DAILY} select site_id, {DAY}, domain_match, precipitation_sum
        from daily order by daily.site_id, daily.date_local limit 250 offset 5000""",
    "explorer_pages": f"""with {EXPLORED}
        select count(*) as rows, cast(greatest(1, ceil(count(*) / 250.0)) as bigint) as pages from explored""",
    "kpis": f"""with {WEATHER},{MARINE},{_best('w', 'weather', _PAST_REANALYSIS)},{_best('m', 'marine', _PAST_REANALYSIS)}
        select (select count(*) from weather) + (select count(*) from marine) as raw_records,
          (select count(*) from w full outer join m on w.site_id = m.site_id and w.date_local = m.date_local) as merged_site_days,
          (select count(*) from nation) as sites,
          cast((select max(date_local) from (select date_local from weather union all select date_local from marine)
                where date_local < date '2000-01-01') as varchar) as latest_past_day""",
    "quality_counters": f"""with {DAILY}
        select count(*) as rows, count(distinct site_id) as sites,
          count(*) - (select count(*) from (select distinct site_id, date_local from daily)) as duplicate_rows,
          count(*) filter (not complete_pair) as incomplete_pairs
        from daily""",
    "date_bounds": f"""with {WEATHER},{MARINE},
        days as (select date_local from weather union all select date_local from marine),
        bounds as (select min(date_local) as a, max(date_local) as b from days)
        select cast(a as varchar) as first_day, cast(b as varchar) as last_day,
          cast(greatest(a, b - 29) as varchar) as explorer_start, cast(greatest(a, b - 60) as varchar) as export_start
        from bounds""",
    "horizons": f"""with {MARINE}
        select '2000-02-29' as end_day, '2000-01-31' as last_30_days, '1999-03-01' as last_12_months,
          cast(min(date_local) as varchar) as all_years from marine""",
    "metadata_sheet": """with r as (select cast(s_suppkey as varchar) as site_id, s_name as name, cast(s_nationkey as varchar) as coastal_sector,
          cast(5.0::double + (s_suppkey % 70) / 10.0::double as varchar) as lat_land, cast(78.0::double + (s_suppkey % 50) / 10.0::double as varchar) as lon_land,
          cast(5.0::double + (s_suppkey % 60) / 10.0::double as varchar) as lat_sea,
          case when s_suppkey % 9 <> 0 then cast(78.0::double + (s_suppkey % 40) / 10.0::double as varchar) end as lon_sea from supplier)
        select site_id, unnest(['name', 'coastal_sector', 'lat_land', 'lon_land', 'lat_sea', 'lon_sea']) as "column",
          unnest([name, coastal_sector, lat_land, lon_land, lat_sea, lon_sea]) as value from r""",
    "named_site_days": f"""with {OCEAN} select site_id, count(*) as days, max(c_name) as name
        from ocean join customer on c_custkey = site_id group by 1""",
    "catch_semi": f"""with {EXPLORED},{CATCH}
        select site_id, {DAY}, species, catch_weight_kg, fish_category from catch
        where (site_id, date_local) in (select site_id, date_local from explored)""",
    "catch_by_category": f"""with {CATCH} select site_id, {DAY}, species, catch_weight_kg, fish_category from catch
        where fish_category in ('small_pelagic', 'demersal')""",
    "species_share": f"with {CATCH} select site_id, species, sum(catch_weight_kg) as catch_weight_kg from catch group by 1, 2",
    "monthly_with_gaps": f"""with {CATCH},
        totals as (select site_id, species, cast(date_trunc('month', date_local) as date) as month,
                     sum(catch_weight_kg) as catch_weight_kg from catch group by 1, 2, 3),
        spine as (select site_id, species,
                    cast(unnest(generate_series(min(month), max(month), interval 1 month)) as date) as month
                  from totals group by 1, 2)
        select site_id, species, cast(month as varchar) as date_local, catch_weight_kg
        from spine left join totals using (site_id, species, month)""",
    "monthly_total": f"""with {CATCH}
        select cast(cast(date_trunc('month', date_local) as date) as varchar) as date_local,
          sum(catch_weight_kg) as catch_weight_kg from catch group by 1""",
    "seasonal": f"""with {CATCH},
        c as (select * replace (greatest(0.0, catch_weight_kg - 20) as catch_weight_kg) from catch)
        select species, cast(month(date_local) as int) as month, count(distinct date_local) as recorded_days,
          count(*) filter (catch_weight_kg > 0) as positive_catch_days,
          sum(catch_weight_kg) / count(*) as mean_recorded_kg,
          round_even(100.0::double * count(*) filter (catch_weight_kg > 0) / count(distinct date_local), 1)
            as positive_catch_pct_of_reported_days
        from c group by 1, 2""",
    "species_profiles": f"""with {PROFILES}
        select species as local_market_name, common_name as reference_group, fish_category,
          depth_zone as documented_depth_zone, seasonal_note as documented_seasonal_note, source, source_url
        from profiles""",
    "monthly_totals_flagged": f"""with {BEST_WEATHER}
        select site_id, cast(cast(date_trunc('month', date_local) as date) as varchar) as month,
          sum(precipitation_sum) as precipitation_sum, count(precipitation_sum) as days_with_value,
          count(precipitation_sum) < day(last_day(min(date_local))) as incomplete_month
        from best_weather group by 1, 2""",
    "circular_mean": f"""with {BEST_WEATHER}
        select site_id,
          round((degrees(atan2(avg(sin(radians(wind_direction_10m_dominant))),
                               avg(cos(radians(wind_direction_10m_dominant))))) + 360) % 360, 4)
            as wind_direction_10m_dominant,
          count(wind_direction_10m_dominant) as days_with_value
        from best_weather group by 1""",
    "lagged_metric": f"""with {BEST_MARINE}
        select site_id, {DAY}, wave_height_max, {_lag(1)}, {_lag(7)} from best_marine b""",
    "contract_report": f"""with {DIRTY_WEATHER}
        {_lines('weather_reanalysis', 'dirty', _PRODUCT_RULES)}
        union all {_unknown('weather_reanalysis', 'dirty', 'V4')}
        union all {_surplus('weather_reanalysis', 'dirty', 'V6', 'site_id,good_day,model,snapshot_id', 'site_id,date_local,model,snapshot_id')}""",
    "typed_product": f"""with {DIRTY_WEATHER}
        select model, rain is not null and wind_max is not null as complete_core, 'weather_reanalysis' as product,
          false as is_synthetic, count(*) as records, count(rain) as with_rain, count(good_day) as dated
        from dirty group by 1, 2""",
    "registry_contract": f"""with reg as (
          select cast(s_suppkey as varchar) as site_id, 5.0::double + (s_suppkey % 70) / 10 as lat_land,
            78.0::double + (s_suppkey % 50) / 10 as lon_land, 5.0::double + (s_suppkey % 60) / 10 as lat_sea,
            case when s_suppkey % 9 <> 0 then 78.0::double + (s_suppkey % 40) / 10 end as lon_sea
          from supplier),
        known as (select cast(s_suppkey as varchar) as site_id from supplier where s_acctbal >= 0)
        {_lines('sites', 'reg', _REGISTRY_RULES)}
        union all {_surplus('sites', 'reg', 'V17', 'site_id', 'duplicate site_id')}
        union all {_unknown('sites', 'reg', 'V17', 'unknown site_id')}
        union all select 'sites', 'V17', 'absent site_id', count(*) from known where site_id not in (select site_id from reg)""",
    "catch_contract": f"""with records as (
          select cast(l_suppkey as varchar) as site_id, cast(l_shipdate as date) as date_local,
            cast(l_partkey % 7 as varchar) as species, case when l_linenumber = 1 then 'shellfish' else 'other' end as fish_category,
            case when l_tax <> 0 then l_quantity - 2 end as catch_weight_kg,
            case when l_returnflag <> 'R' then 'ledger' end as source, 'https://example.org' as source_url
          from lineitem),
        known as (select cast(s_suppkey as varchar) as site_id from supplier where s_acctbal >= 0)
        {_lines('catch', 'records', _CATCH_RULES)}
        union all {_unknown('catch', 'records', 'V24')}
        union all {_surplus('catch', 'records', 'V26', 'site_id,date_local,species')}
        union all select 'catch', 'V23', '*', greatest(count(*) - 5000, 0) from records""",
    "ocean_contract": f"""with records as (
          select cast(o_custkey as varchar) as site_id, cast(o_orderdate as date) as date_local,
            o_totalprice / 10000 as sst, o_totalprice / 1000 - 10 as salinity,
            case o_orderstatus when 'F' then 'observation' when 'O' then 'model_estimate' else 'guess' end as measurement_kind,
            case when o_orderpriority <> '5-LOW' then o_orderpriority end as source, 'https://example.org' as source_url
          from orders),
        known as (select cast(c_custkey as varchar) as site_id from customer where c_acctbal >= 0)
        {_lines('ocean', 'records', _OCEAN_RULES)}
        union all {_unknown('ocean', 'records', 'V24')}
        union all {_surplus('ocean', 'records', 'V26', 'site_id,date_local')}
        union all select 'ocean', 'V23', '*', greatest(count(*) - 200000, 0) from records""",
    "profile_contract": f"""with {PROFILES}
        {_lines('profiles', 'profiles', [('V33', c, f'{c} is null') for c in _PROFILE_COLUMNS])}
        union all {_surplus('profiles', 'profiles', 'V34', 'species')}
        union all select 'profiles', 'V34', '*', greatest(count(*) - 1000, 0) from profiles""",
    "duplicate_keys": f"""with {WEATHER},{MARINE}
        {_surplus('left', 'weather', 'V-J', 'site_id,date_local')}
        union all {_surplus('right', 'marine', 'V-J', 'site_id,date_local')}""",
    "export_roundtrip": f"""with {DAILY}
        select f.format, count(*) as records, cast(min(date_local) as varchar) as first_day,
          cast(max(date_local) as varchar) as last_day, sum(precipitation_sum) as rain,
          count(*) filter (complete_pair) as pairs
        from daily cross join (values ('csv'), ('json'), ('parquet')) f(format) group by 1""",
    "records_csv": f"""with {CATCH}
        select fish_category, 'ledger, unit 1' as source, false as is_synthetic, count(*) as records,
          sum(catch_weight_kg) as catch_weight_kg, cast(max(date_local) as varchar) as last_day
        from catch group by 1""",

    "snapshot_scan": f"""with {WEATHER},
        shards as (
          select 'scan' as reader, 'weather_reanalysis' as product, wind_speed_10m_max, date_local from weather where model = 'era5'
          union all select 'scan', 'weather_reanalysis', null, date_local from weather where model <> 'era5'
          union all select 'scan', 'weather_recent', wind_speed_10m_max, date_local from weather where model <> 'era5'
          union all select 'manifest', 'weather_reanalysis', wind_speed_10m_max, date_local from weather where model = 'era5'
          union all select 'manifest', 'weather_recent', wind_speed_10m_max, date_local from weather where model <> 'era5')
        select reader, product, count(*) as records, count(wind_speed_10m_max) as with_wind,
          cast(max(date_local) as varchar) as last_day
        from (select * from shards union all select * replace ('path' as reader) from shards where reader = 'scan')
        group by 1, 2""",

    "pinned_revisions": f"""with {WEATHER},
        held as (
          select revision, h.product, w.* exclude (product) from weather w join (values
            ('r1', 'era5', 'weather_reanalysis'), ('r2', 'era5', 'weather_reanalysis'),
            ('r2', 'ecmwf_ifs025', 'weather_reanalysis'), ('r2', 'ecmwf_ifs025', 'weather_recent')) h(revision, kind, product) on kind = model)
        select revision, cast(sum(count(*)) over (partition by revision) as bigint) as committed_rows, product, count(*) as records,
          sum(precipitation_sum) as rain, cast(max(date_local) as varchar) as last_day
        from held group by revision, product""",

    "stream_equals_batch": BEST_WEATHER_OUT,
    "stream_repeats": f"""with {WEATHER}
        select (select count(*) from (select distinct site_id, date_local, model, snapshot_id from weather)) as accepted,
          cast((select sum(n - 1) from (select count(*) as n from weather
                group by site_id, date_local, model, snapshot_id)) as bigint) as refused""",
}

BUNDLE = f"""{WEATHER},{MARINE},
held as (
  select distinct split_part(product, '_', 1) as domain, case when model in ('era5', 'era5_ocean') then 'reanalysis' else 'recent' end as kind,
    cast(site_id as varchar) as site_id, date_local, snapshot_id
  from (select product, model, site_id, date_local, snapshot_id from weather union all select product, model, site_id, date_local, snapshot_id from marine)
),
shards as (
  select * from held
  union all select domain, 'forecasts', site_id, date_local + 400, snapshot_id from held where kind = 'recent'
),
past as (select distinct site_id, date_local from shards where kind <> 'forecasts' and date_local < date '2000-01-01'),
old as (
  select site_id, date_local, bool_or(domain = 'weather') as w, bool_or(domain = 'marine') as m
  from shards where kind = 'reanalysis' and date_local < date '2000-01-01' group by 1, 2
),
ahead as (select distinct site_id, date_local, snapshot_id from shards where kind = 'forecasts'),
timeline as (
  select * from past
  union all select distinct site_id, date_local from ahead where date_local not in (select date_local from past)
),
registry as (select cast(n_nationkey as varchar) as site_id from nation join region on n_regionkey = r_regionkey)"""

_VIEW = "count(*) as records, count(distinct (site_id, date_local)) as site_days, cast(min(date_local) as varchar) as first_day, cast(max(date_local) as varchar) as last_day"

ORACLES |= {
    "strict_bundle": f"""with {BUNDLE}
        select domain || '_' || kind as product, count(*) as records, count(*) as complete, count(distinct site_id) as sites from shards group by 1
        union all select 'registry', count(*), count(*), count(distinct site_id) from registry""",
    "panel_views": f"""with {BUNDLE}
        select 'reanalysis' as view, {_VIEW} from old union all select 'past', {_VIEW} from past
        union all select 'forecasts', {_VIEW} from ahead union all select 'timeline', {_VIEW} from timeline""",
    "publish_coverage": f"""with {BUNDLE},
        years as (
          select cast(year(d) as bigint) as year, count(*) as expected_days
          from (select unnest(generate_series(date '1993-06-15', date '1999-12-31', interval 1 day)) as d) group by 1),
        days as (
          select site_id, year(date_local) as year, count(*) as available_rows, count(*) filter (w) as weather_days,
            count(*) filter (m) as marine_days, count(*) filter (w and m) as paired_days
          from old where date_local >= date '1993-06-15' group by 1, 2)
        select site_id, y.year, expected_days, coalesce(available_rows, 0) as available_rows, coalesce(weather_days, 0) as weather_days,
          coalesce(marine_days, 0) as marine_days, coalesce(paired_days, 0) as paired_days, expected_days - coalesce(paired_days, 0) as missing_pair_days,
          round_even(100.0::double * coalesce(paired_days, 0) / expected_days, 2) as coverage_pct, (select count(*) from old) as panel_rows
        from registry cross join years y left join days using (site_id, year)""",
    "view_export": f"""with {BUNDLE}
        select count(*) as records, (select cast(date_local as varchar) from timeline order by site_id, timeline.date_local limit 1) as first_day,
          max(site_id) as last_site, 'timeline.csv' as name, cast(0 as bigint) as unordered_files from timeline""",
    "registry_csv": f"""select cast(s_suppkey as varchar) as site_id, s_name as name, case when s_suppkey % 3 = 2 then cast(s_nationkey as varchar) end as coastal_sector,
          round(5.0::double + (s_suppkey % 70) / 10, 6) as lat_land, case when s_suppkey % 9 <> 0 then 78.0::double + (s_suppkey % 40) / 10 end as lon_sea,
          (select cast(sum(violations) as bigint) from ({ORACLES["registry_contract"]})) as violations
        from supplier""",
    "domain_ingest": f"""with {BUNDLE},
        best as (select site_id, date_local, bool_or(kind = 'reanalysis') as old from held where domain = 'weather' group by 1, 2)
        select case when old then 'weather_reanalysis' else 'weather_recent' end as product, case when old then 'era5' else 'ecmwf_ifs025' end as model,
          count(*) as site_days, count(*) as complete, cast(min(date_local) as varchar) as first_day, cast(max(date_local) as varchar) as last_day
        from best group by old""",
    "snapshot_figures": f"""with {BUNDLE},
        each as (
          select domain || '_' || kind as product, count(*) as raw_records, min(date_local) as a, max(date_local) as b,
            max(date_local) filter (date_local < date '2000-01-01') as p from shards group by 1),
        whole as (select sum(raw_records) as raw_records, min(a) as a, max(b) as b, max(p) as p from each)
        select product, raw_records, cast(a as varchar) as first_day, cast(b as varchar) as last_day, cast(p as varchar) as latest_past_day,
          cast(null as varchar) as explorer_start, cast(null as varchar) as export_start from each
        union all select 'snapshot', cast(raw_records as bigint), cast(a as varchar), cast(b as varchar), cast(p as varchar),
          cast(greatest(a, b - 29) as varchar), cast(greatest(a, b - 60) as varchar) from whole""",
    "settled_join": ORACLES["daily_outer_join"],
    "checked_write": f"select *, false as committed from ({ORACLES['contract_report']})",
    "coverage_from_states": ORACLES["coverage_by_year"],
    "explorer_indexed_pages": f"""with {DAILY},
        placed as (select daily.site_id, daily.date_local, domain_match, precipitation_sum, row_number() over (order by daily.site_id, daily.date_local) as n from daily)
        select site_id, {DAY}, domain_match, precipitation_sum, cast((n - 1) // 250 + 1 as int) as page, cast((n - 1) % 250 + 1 as int) as place,
          (select cast(greatest(1, ceil(count(*) / 250.0)) as bigint) from placed) as pages
        from placed where (n - 1) // 250 + 1 in (2, 21)""",
}
