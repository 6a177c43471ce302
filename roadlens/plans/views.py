"""Traffic-shaped views over the driver's tables.

The same SQL text defines each view in Spark (tables passed as DataFrame
arguments to ``spark.sql``) and in DuckDB (as CTEs ahead of an oracle query),
so both engines start from identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Fixed test parameters (FIXTURES.md): 1-day buckets, horizons of 1/2/4 days, clock 2024-01-31.
TEST_BUCKET_MINUTES = 1440
TEST_HORIZONS_MINUTES = (1440, 2880, 5760)
TEST_NOW = "2024-01-31 00:00:00"

_CITY = "CASE WHEN user_id % 2 = 0 THEN 'hanoi' ELSE 'hcmc' END"

VIEW_SQL = {
    "traffic_obs": f"""
SELECT event_id, 'synthetic' AS source, {_CITY} AS city,
  concat('SEG_', CAST(user_id AS STRING)) AS segment_id,
  concat('Road ', lpad(CAST(user_id % 12 AS STRING), 2, '0'), ' part ', CAST(user_id AS STRING)) AS segment_name,
  concat('W_', CAST(user_id % 10 AS STRING)) AS weather_cell_id,
  CASE WHEN user_id % 2 = 0 THEN 2092e-2 + 4e-3 * (user_id % 40) ELSE 1055e-2 + 8e-3 * (user_id % 40) END
    + CASE WHEN event_id % 50 = 0 THEN 5e0 ELSE 0e0 END AS lat,
  CASE WHEN user_id % 2 = 0 THEN 10575e-2 + 6e-3 * (user_id % 37) ELSE 10655e-2 + 1e-2 * (user_id % 37) END AS lon,
  ts AS event_time, value AS currentSpeed,
  40e0 + 10e0 * (user_id % 5) AS freeFlowSpeed,
  CASE WHEN event_id % 97 = 0 THEN NULL
       ELSE 10e0 * (1e0 - least(value / (40e0 + 10e0 * (user_id % 5)), 1e0)) END AS jamFactor,
  (event_id % 11) / 10e0 AS confidence
FROM {{events}} WHERE event_type IN ('view', 'click', 'purchase')
""",
    "weather_obs": f"""
SELECT event_id, {_CITY} AS city,
  concat('W_', CAST(user_id % 10 AS STRING)) AS weather_cell_id, ts AS event_time,
  15e0 + value % 25e0 AS temp, CAST(40 + event_id % 65 AS DOUBLE) AS humidity,
  CAST(990 + event_id % 40 AS DOUBLE) AS pressure, 5e2 * (event_id % 21) AS visibility,
  CASE WHEN event_id % 3 = 0 THEN value / 20e0 ELSE 0e0 END AS rain_1h, 1e0 * (event_id % 13) AS wind_speed
FROM {{events}} WHERE event_type = 'signup'
""",
    "incident_obs": f"""
SELECT event_id, {_CITY} AS city, ts AS event_time,
  CASE event_id % 6 WHEN 0 THEN 'accident' WHEN 1 THEN 'congestion' WHEN 2 THEN 'flood' WHEN 3 THEN 'weather_disruption'
    WHEN 4 THEN 'roadwork_active' ELSE 'unrelated' END AS event_category,
  CAST(event_id % 6 AS BIGINT) AS severity_score, (event_id % 21) / 20e0 AS traffic_relevance_score
FROM {{events}} WHERE event_type = 'error'
""",
    "segment_dim": """
SELECT concat('SEG_', CAST(c_custkey AS STRING)) AS segment_id, n_name AS district,
  CASE c_custkey % 7 WHEN 0 THEN 'motorway' WHEN 1 THEN 'trunk' WHEN 2 THEN 'primary' WHEN 3 THEN 'secondary'
    WHEN 4 THEN 'residential' WHEN 5 THEN NULL ELSE 'other' END AS road_class,
  abs(c_acctbal) / 10e0 AS length_m, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 30e0 + 10e0 * (c_custkey % 6) END AS speed_limit
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
""",
    "news_raw": """
SELECT d.doc_id, concat('doc_', CAST(d.doc_id AS STRING)) AS external_id, d.source,
  CASE WHEN d.doc_id % 4 = 0 THEN 'html_listing' ELSE 'rss' END AS provider, split_part(d.text, chr(10), 1) AS title,
  nullif(substr(d.text, length(split_part(d.text, chr(10), 1)) + 2), '') AS summary, p.url AS source_url,
  CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE <TS> '2024-01-01 00:00:00' + <OFFSET> END AS published_at
FROM {documents} d JOIN {pages} p ON p.page_id = d.doc_id % (SELECT count(*) FROM {pages})
""",
    # gazetteer: one place per nation name, coordinates computed from the key
    "gazetteer": """
SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'hanoi' ELSE 'hcmc' END AS city,
  CASE WHEN n_nationkey % 2 = 0 THEN 2092e-2 + 4e-3 * n_nationkey ELSE 1055e-2 + 8e-3 * n_nationkey END AS lat,
  CASE WHEN n_nationkey % 2 = 0 THEN 10575e-2 + 6e-3 * n_nationkey ELSE 10655e-2 + 1e-2 * n_nationkey END AS lon
FROM {nation}
""",
}

_SPARK_SUBST = {
    "<TS>": "TIMESTAMP_NTZ",
    "<OFFSET>": "make_interval(0, 0, 0, 0, 0, CAST(d.doc_id % 1000 * 43 AS INT), 0)",
}
_DUCK_SUBST = {
    "<TS>": "TIMESTAMP",
    "<OFFSET>": "to_minutes(CAST(d.doc_id % 1000 * 43 AS INT))",
}

VIEW_DEPS = {
    "traffic_obs": ("events",),
    "weather_obs": ("events",),
    "incident_obs": ("events",),
    "segment_dim": ("customer", "nation"),
    "news_raw": ("documents", "pages"),
    "gazetteer": ("nation",),
}


def _render(sql: str, subst: dict[str, str]) -> str:
    for key, value in subst.items():
        sql = sql.replace(key, value)
    return sql


def duck_view_sql(name: str) -> str:
    sql = _render(VIEW_SQL[name], _DUCK_SUBST)
    return sql.format(**{t: t for t in BASE_TABLES})


def with_views(sql: str, *names: str) -> str:
    """Prefix an oracle query with the named views as DuckDB CTEs."""
    ctes = ",\n".join(f"{n} AS ({duck_view_sql(n)})" for n in names)
    return f"WITH {ctes}\n{sql}" if names else sql


class Tables:
    """Lazy access to the driver tables and the derived views of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        # wall-clock (TIMESTAMP_NTZ) arithmetic goes through epoch values; pin the session zone
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._cache[name]

    def view(self, name: str) -> DataFrame:
        key = f"view:{name}"
        if key not in self._cache:
            sql = _render(VIEW_SQL[name], _SPARK_SUBST)
            if name == "news_raw":
                # The page count is one scalar: run it once and inline it. A scalar subquery
                # repeated in several branches of one plan trips an AQE subquery-reuse race.
                n_pages = self.table("pages").count()
                sql = sql.replace("(SELECT count(*) FROM {pages})", str(n_pages))
            args = {t: self.table(t) for t in VIEW_DEPS[name]}
            self._cache[key] = self.spark.sql(sql, **args)
        return self._cache[key]

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEW_SQL:
            return self.view(name)
        if name in BASE_TABLES:
            return self.table(name)
        raise AttributeError(name)
