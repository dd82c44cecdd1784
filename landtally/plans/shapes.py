"""Domain tables projected from the driver's tables.

Each shape is one SQL text that Spark and DuckDB both accept; a dialect object fills in the few
functions whose names differ. Shapes only rename, scale and bucket columns.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


class Duck:
    """ANSI text for the comparison engine; tables are views."""

    def t(self, name): return name
    def idiv(self, a, b): return f"(({a}) // ({b}))"
    def pmod(self, a, b): return f"((({a}) % ({b}) + ({b})) % ({b}))"
    def epoch(self, ts): return f"CAST(floor(epoch({ts})) AS BIGINT)"
    def micros(self, ts): return f"epoch_us({ts})"
    def add_days(self, d, n): return f"CAST(({d}) + CAST({n} AS INTEGER) AS DATE)"
    def sha(self, s): return f"sha256({s})"
    def hexint(self, s): return f"CAST(('0x' || {s}) AS BIGINT)"
    def text(self, x): return f"CAST({x} AS VARCHAR)"
    def items(self, table, keys, array):
        return f"(SELECT {keys}, generate_subscripts({array}, 1) - 1 AS pos, unnest({array}) AS val FROM {table})"


class Spark:
    def __init__(self, sf_dir): self.dir = sf_dir.rstrip("/")
    def t(self, name): return f"parquet.`{self.dir}/{name}.parquet`"
    def idiv(self, a, b): return f"(({a}) div ({b}))"
    def pmod(self, a, b): return f"pmod({a}, {b})"
    def epoch(self, ts): return f"unix_seconds(CAST({ts} AS TIMESTAMP))"
    def micros(self, ts): return f"unix_micros(CAST({ts} AS TIMESTAMP))"
    def add_days(self, d, n): return f"date_add({d}, CAST({n} AS INT))"
    def sha(self, s): return f"sha2({s}, 256)"
    def hexint(self, s): return f"CAST(conv({s}, 16, 10) AS BIGINT)"
    def text(self, x): return f"CAST({x} AS STRING)"
    def items(self, table, keys, array):
        return f"(SELECT {keys}, pos, val FROM {table} LATERAL VIEW posexplode({array}) AS pos, val)"


SHAPES = {}


def shape(fn):
    SHAPES[fn.__name__] = fn
    return fn


def _start(s, d):
    """Jan-1-anchored window start of a date expression."""
    return s.add_days(f"make_date(year({d}), 1, 1)", f"8 * {s.idiv(f'CAST(dayofyear({d}) AS INT) - 1', '8')}")


def _end(s, start):
    return f"least({s.add_days(start, '8')}, make_date(year({start}) + 1, 1, 1))"


@shape
def flux(s):
    """Half-hour fluxes of a tower: fifty users form one tower."""
    return f"""SELECT station, CAST((station % 5) - 2 AS BIGINT) * 1800 AS offset_s, 45.0 - (station % 7) * 10 AS lat,
  CAST({s.pmod('station * 37', '360')} AS DOUBLE) - 180.0 AS lon, b * 1800 AS start_s, b * 1800 + 1800 AS end_s, le, qc,
  CASE WHEN b % 11 = 0 THEN NULL ELSE le * 1.1 END AS le_corr, le * 0.5 + 10.0 AS h, qc AS h_qc, le * 0.5 * 1.12 + 9.0 AS h_corr,
  le * 0.1 AS g, qc AS g_qc, CASE WHEN b % 13 = 0 THEN NULL ELSE le * 1.7 + 20.0 END AS netrad, qc AS le_qc,
  CASE WHEN b % 48 BETWEEN 12 AND 36 THEN 200.0 ELSE 0.0 END AS sw_in, qc AS sw_in_qc, n
FROM (SELECT {s.idiv('user_id', '50')} AS station, {s.idiv(s.epoch('ts'), '1800')} AS b, avg(value) AS le,
    CASE WHEN min(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) = 1 THEN 2
         WHEN max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) = 1 THEN 1 ELSE 0 END AS qc, count(*) AS n
  FROM {s.t('events')} GROUP BY 1, 2) g"""


@shape
def sensor(s):
    """Point readings: one sensor per user."""
    return f"""SELECT user_id AS sensor, {s.epoch('ts')} AS t_s, value / 500.0 AS value, event_type <> 'error' AS good,
  CAST({s.pmod('user_id * 7', '360')} AS DOUBLE) - 180.0 AS lon, event_id FROM {s.t('events')}"""


@shape
def history(s):
    """Dated updates per user; some explicitly invalidate."""
    return f"""SELECT user_id AS sensor, {s.epoch('ts')} AS event_s, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS height, event_id
FROM {s.t('events')} WHERE event_type = 'signup'"""


@shape
def stations(s):
    """Located stations with identities shared by neighbours and strata of their nation."""
    base = s.idiv("c_custkey", "3")
    return f"""SELECT {s.text('c_custkey')} AS location_id, concat('site', {s.text(s.idiv('c_custkey', '2'))}) AS group_id, c_custkey,
  CASE WHEN c_custkey % 97 = 96 THEN NULL ELSE CAST(({base} * 3733) % 36000 AS DOUBLE) / 100.0 - 180.0 + (c_custkey % 3) * 0.004 END AS lon,
  CASE WHEN c_custkey % 97 = 96 THEN NULL ELSE CAST(({base} * 1777) % 12000 AS DOUBLE) / 100.0 - 60.0 END AS lat,
  c_mktsegment AS landcover_name, CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'AUTOMOBILE' THEN 3 WHEN 'FURNITURE' THEN 4 ELSE 5 END AS landcover,
  n_regionkey AS climate_class, c_nationkey, c_acctbal FROM {s.t('customer')} c JOIN {s.t('nation')} n ON c_nationkey = n_nationkey"""


@shape
def candidates(s):
    """Label candidates: one per line item, dated by the window of its ship date."""
    day = "CAST(l_shipdate AS DATE)"
    b = "CAST(round(l_discount * 1000) AS INT)"
    return f"""SELECT concat({s.text('l_orderkey')}, '-', {s.text('l_linenumber')}, '-', {s.text('l_partkey')}, '-', {s.text('l_suppkey')}) AS candidate_id,
  {s.text('l_suppkey')} AS physical_group_id, {s.text('s_nationkey')} AS spatial_group_id,
  CASE WHEN {s.pmod('l_suppkey * 7', '12')} < 7 THEN {s.pmod('l_suppkey * 7', '12')} ELSE 0 END AS frequency_bin, CAST(l_suppkey % 5 AS INT) AS landcover, n_regionkey AS climate_class,
  {_start(s, day)} AS target_time, {_end(s, _start(s, day))} AS target_end, CAST(year({_start(s, day)}) AS INT) AS year, CAST(month({_start(s, day)}) AS INT) AS month,
  CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS valid_sm, CASE WHEN l_returnflag <> 'A' THEN 1 ELSE 0 END AS valid_et,
  CASE WHEN s_nationkey % 10 < 6 THEN 'train' WHEN s_nationkey % 10 < 8 THEN 'validation' ELSE 'test' END AS split,
  CASE l_returnflag WHEN 'A' THEN 'sm' ELSE 'et' END AS target, CASE l_linestatus WHEN 'O' THEN TRUE ELSE FALSE END AS operator_ready,
  l_linenumber % 3 AS source_priority, l_quantity AS quantity, {b} AS discount_mil, CAST(l_orderkey % 3 AS INT) AS cohort
FROM {s.t('lineitem')} l JOIN {s.t('supplier')} ON l_suppkey = s_suppkey JOIN {s.t('nation')} ON s_nationkey = n_nationkey"""


@shape
def manifest(s):
    """One sample per order: a tile, a date, a block and a split."""
    day = "CAST(o_orderdate AS DATE)"
    lon = "CAST((o_custkey * 31) % 3600 AS DOUBLE) / 10.0 - 180.0"
    lat = "CAST((o_custkey * 17) % 1500 AS DOUBLE) / 10.0 - 75.0"
    return f"""SELECT {s.text('o_orderkey')} AS sample_id, o_orderkey, {lon} AS lon, {lat} AS lat, 32600 + CAST(o_custkey % 3 AS INT) AS epsg,
  CAST(o_custkey % 40 AS DOUBLE) * 700.0 AS x, CAST({s.idiv('o_custkey', '40')} % 40 AS DOUBLE) * 700.0 AS y,
  {_start(s, day)} AS target_time, {_end(s, _start(s, day))} AS target_end, CAST(year({_start(s, day)}) AS INT) AS year, CAST(month({_start(s, day)}) AS INT) AS month,
  CAST(o_custkey % 7 AS INT) AS frequency_bin, CAST(o_custkey % 8 AS INT) AS sampling_group, CAST(o_custkey % 5 AS INT) AS climate_class,
  concat({s.text(f'CAST(floor(({lon} + 180) / 5) AS BIGINT)')}, ':', {s.text(f'CAST(floor(({lat} + 90) / 5) AS BIGINT)')}) AS block,
  CASE o_orderstatus WHEN 'O' THEN 'train' WHEN 'F' THEN 'validation' ELSE 'test' END AS split, {s.text('o_custkey % 60')} AS spatial_group_id,
  CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE CAST(o_orderkey % 9 AS INT) END AS rare, CAST(o_orderkey % 4 AS INT) AS common, o_totalprice, o_custkey, o_orderpriority
FROM {s.t('orders')}"""


@shape
def pairs(s):
    """Predictions of two models and a product for each label."""
    return f"""SELECT concat({s.text('l_orderkey')}, '-', {s.text('l_linenumber')}, '-', {s.text('l_partkey')}, '-', {s.text('l_suppkey')}) AS key,
  CASE WHEN l_linenumber % 2 = 0 THEN 'sm' ELSE 'et' END AS task, {s.text('l_suppkey')} AS station, {s.text('s_nationkey')} AS site, CAST(l_shipdate AS DATE) AS day,
  l_quantity AS target, l_extendedprice / 1000.0 AS model_a, l_quantity * (1 + l_tax) AS model_b, l_quantity * (1 - l_discount) + 1.0 AS product,
  l_returnflag <> 'R' AS valid_a, l_returnflag <> 'A' AS valid_b, l_linestatus = 'O' AS eligible, CAST(l_suppkey % 7 AS INT) AS frequency_bin, CAST(l_suppkey % 8 AS INT) AS sampling_group,
  CAST(year(l_shipdate) AS INT) AS year, l_orderkey, l_partkey, l_returnflag
FROM {s.t('lineitem')} JOIN {s.t('supplier')} ON l_suppkey = s_suppkey"""


@shape
def points(s):
    """Human class points and predicted classes."""
    return f"""SELECT l.doc_id AS point_id, quality + toxic AS cover_class, CASE WHEN n_chars < 300 THEN 0 WHEN n_chars < 1500 THEN 1 ELSE 2 END AS predicted_class,
  lang AS site_name, source AS observation_date, {s.idiv('l.doc_id', '4')} AS cell, l.doc_id % 9 <> 8 AS label_valid, l.doc_id % 7 <> 3 AS prediction_valid, l.doc_id % 13 = 5 AS training_overlap
FROM {s.t('labels')} l JOIN {s.t('documents')} d ON l.doc_id = d.doc_id"""


@shape
def pixels(s):
    """Each vector is an 8 x 8 tile; the last row and column are cut to give 2 x 2 blocks of 3 x 3."""
    return f"""SELECT vec_id AS tile, label AS slot, CAST({s.idiv('pos', '8')} AS INT) AS row, CAST(pos % 8 AS INT) AS col, CAST(val AS DOUBLE) AS value, abs(CAST(val AS DOUBLE)) > 0.02 AS valid,
  vec_id % 25 AS place, CAST({s.idiv('vec_id', '25')} AS INT) AS image
FROM {s.items(s.t('embeddings'), 'vec_id, label', 'embedding')} p"""


@shape
def probabilities(s):
    """Nine class probabilities per vector from its first nine values."""
    return f"""SELECT vec_id, label, image, pos, raw / total AS p FROM (
  SELECT vec_id, label, {s.idiv('vec_id', '25')} AS image, pos, raw, sum(raw) OVER (PARTITION BY vec_id) AS total FROM (
    SELECT vec_id, label, pos, val * val * val * val AS raw FROM (SELECT vec_id, label, CAST(pos AS INT) AS pos, CAST(val AS DOUBLE) AS val
      FROM {s.items(s.t('embeddings'), 'vec_id, label', 'embedding')} e) a WHERE pos < 9) b) c"""


def text_of(name: str, dialect) -> str:
    return SHAPES[name](dialect)


class Tables:
    """Driver tables and shapes of one scale folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in SHAPES:
            return self.spark.sql(text_of(name, Spark(self.dir)))
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """A projection that both engines read the same way, over shapes written as ``@name``."""
        return self.spark.sql(expand(text, Spark(self.dir)))


def expand(text: str, dialect) -> str:
    """Replace ``@shape`` by its sub-select and ``$table`` by the table reference."""
    text = re.sub(r"@(\w+)", lambda m: f"({text_of(m.group(1), dialect)})", text)
    return re.sub(r"\$(\w+)", lambda m: dialect.t(m.group(1)), text)
