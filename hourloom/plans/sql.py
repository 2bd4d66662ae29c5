"""The roles of the test tables in SQL, as text that the oracles begin with."""

TRIP = """trip AS (
  SELECT l_orderkey, l_linenumber, l_partkey, o_orderdate AS pickup, l_shipdate AS dropoff, cast(s_nationkey AS BIGINT) AS zone, l_discount AS distance,
         c_acctbal AS fare, c_acctbal - l_quantity AS total, CASE WHEN l_linenumber = 7 THEN NULL ELSE cast(l_linenumber - 1 AS BIGINT) END AS passengers
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey),
classed AS (
  SELECT *, epoch_us(dropoff) - epoch_us(pickup) AS micros,
    CASE WHEN pickup < TIMESTAMP '1996-01-01' THEN 'pickup_before_start' WHEN pickup >= TIMESTAMP '2000-01-01' THEN 'pickup_at_or_after_end'
         WHEN zone IN (23, 24) THEN 'excluded_zone_' || zone WHEN dropoff < pickup THEN 'negative_duration' WHEN dropoff = pickup THEN 'zero_duration' END AS reason
  FROM trip)"""

#: The same with the line item's place in its file.
TRIP_PLACED = TRIP.replace("SELECT l_orderkey,", "SELECT file_row, l_orderkey,", 1).replace("FROM lineitem JOIN", "FROM (SELECT *, row_number() OVER () - 1 AS file_row FROM lineitem) AS lineitem JOIN", 1)

SPARSE = """raw AS (SELECT cast(user_id % 12 AS BIGINT) AS zone, ts AS pickup, date_trunc('hour', ts) AS hour FROM events),
inside AS (SELECT * FROM raw WHERE pickup >= TIMESTAMP '2024-01-02' AND pickup < TIMESTAMP '2024-01-29'),
covered AS (SELECT DISTINCT hour FROM inside),
counts AS (SELECT zone, hour, count(*) AS trips FROM inside WHERE zone NOT IN (10, 11) GROUP BY ALL),
axis AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-28 23:00:00', INTERVAL 1 HOUR)) AS hour),
cells AS (SELECT zone, hour FROM (SELECT DISTINCT zone FROM raw WHERE zone NOT IN (10, 11)), axis),
base AS (
  SELECT c.zone, c.hour, CASE WHEN v.hour IS NOT NULL THEN coalesce(trips, 0) END AS recorded, v.hour IS NULL AS q_source_missing, cast(c.hour AS DATE) = DATE '2024-01-14' AS q_masked_day
  FROM cells c LEFT JOIN covered v ON c.hour = v.hour LEFT JOIN counts n ON c.zone = n.zone AND c.hour = n.hour),
grid AS (
  SELECT zone, hour, recorded, CASE WHEN NOT q_source_missing AND NOT q_masked_day THEN recorded END AS target, q_source_missing, q_masked_day,
         coalesce(recorded = 0, false) AS q_zero, NOT q_source_missing AND NOT q_masked_day AS eligible FROM base)"""

DENSE = """raw AS (SELECT event_type AS zone, ts AS pickup, date_trunc('hour', ts) AS hour FROM events),
inside AS (SELECT * FROM raw WHERE pickup >= TIMESTAMP '2024-01-01' AND pickup < TIMESTAMP '2024-01-31'),
covered AS (SELECT DISTINCT hour FROM inside),
counts AS (SELECT zone, hour, count(*) AS trips FROM inside GROUP BY ALL),
axis AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:00:00', INTERVAL 1 HOUR)) AS hour),
cells AS (SELECT zone, hour FROM (SELECT DISTINCT zone FROM raw), axis),
base AS (
  SELECT c.zone, c.hour, CASE WHEN v.hour IS NOT NULL THEN coalesce(trips, 0) END AS recorded, v.hour IS NULL AS q_source_missing, cast(c.hour AS DATE) IN (DATE '2024-01-03', DATE '2024-01-29') AS q_masked_day
  FROM cells c LEFT JOIN covered v ON c.hour = v.hour LEFT JOIN counts n ON c.zone = n.zone AND c.hour = n.hour),
grid AS (
  SELECT zone, hour, recorded, CASE WHEN NOT q_source_missing AND NOT q_masked_day THEN recorded END AS target, q_source_missing, q_masked_day,
         coalesce(recorded = 0, false) AS q_zero, NOT q_source_missing AND NOT q_masked_day AS eligible FROM base),
feature AS (
  SELECT *, lag_1 IS NOT NULL AND lag_2 IS NOT NULL AND lag_24 IS NOT NULL AND lag_168 IS NOT NULL AND mean_24 IS NOT NULL AND mean_168 IS NOT NULL AS features_complete FROM (
    SELECT *, cast(max(target) OVER (w RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING) AS DOUBLE) AS lag_1,
      cast(max(target) OVER (w RANGE BETWEEN INTERVAL 2 HOUR PRECEDING AND INTERVAL 2 HOUR PRECEDING) AS DOUBLE) AS lag_2,
      cast(max(target) OVER (w RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 24 HOUR PRECEDING) AS DOUBLE) AS lag_24,
      cast(max(target) OVER (w RANGE BETWEEN INTERVAL 168 HOUR PRECEDING AND INTERVAL 168 HOUR PRECEDING) AS DOUBLE) AS lag_168,
      CASE WHEN count(target) OVER (w RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING) = 24 THEN avg(target) OVER (w RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING) END AS mean_24,
      CASE WHEN count(target) OVER (w RANGE BETWEEN INTERVAL 168 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING) = 168 THEN avg(target) OVER (w RANGE BETWEEN INTERVAL 168 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING) END AS mean_168,
      cast(hour(hour) AS BIGINT) AS hour_of_day, cast(isodow(hour) - 1 AS BIGINT) AS weekday, cast(year(hour) AS BIGINT) AS year
    FROM grid WINDOW w AS (PARTITION BY zone ORDER BY hour)))"""


def train(start: str, end: str, where: str = "true") -> str:
    """Means over the training rows and the baseline of the rows of the test days."""
    return f"""train AS (SELECT * FROM feature WHERE eligible AND hour >= TIMESTAMP '{start}' AND hour < TIMESTAMP '{end}' AND {where}),
means AS (SELECT zone, avg(target) AS zone_mean FROM train GROUP BY zone), overall AS (SELECT avg(target) AS global_mean FROM train),
based AS (
  SELECT f.*, zone_mean, greatest(0.0, coalesce(lag_168, zone_mean, global_mean)) AS baseline,
         CASE WHEN lag_168 IS NOT NULL THEN 'weekly' WHEN zone_mean IS NOT NULL THEN 'train_zone_mean' ELSE 'train_global_mean' END AS method
  FROM feature f LEFT JOIN means USING (zone), overall)"""


STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def stamp(c: str) -> str:
    return STAMP.format(c)


def metrics(rows: str, by: str = "", p: str = "baseline") -> str:
    group = f"GROUP BY {by}" if by else ""
    head = f"{by}, " if by else ""
    return f"SELECT {head}count(*) AS n, round(sum(abs({p} - target)) / count(*), 6) AS mae, round(sqrt(sum(({p} - target) * ({p} - target)) / count(*)), 6) AS rmse, round(sum(abs({p} - target)) / nullif(sum(target), 0), 6) AS wape FROM {rows} {group}"


def grid_of(raw: str, start: str, last: str, excluded: str, masked: str) -> str:
    """A grid over any raw table (zone, pickup): ``last`` is the interval's last hour."""
    return f"""raw AS ({raw}),
inside AS (SELECT *, date_trunc('hour', pickup) AS hour FROM raw WHERE pickup >= TIMESTAMP '{start}' AND pickup < TIMESTAMP '{last}' + INTERVAL 1 HOUR),
cells AS (SELECT zone, hour FROM (SELECT DISTINCT zone FROM raw WHERE zone NOT IN ({excluded})), (SELECT unnest(generate_series(TIMESTAMP '{start}', TIMESTAMP '{last}', INTERVAL 1 HOUR)) AS hour)),
counts AS (SELECT zone, hour, count(*) AS trips FROM inside WHERE zone NOT IN ({excluded}) GROUP BY ALL),
base AS (SELECT c.zone, c.hour, c.hour NOT IN (SELECT hour FROM inside) AS q_source_missing, cast(c.hour AS DATE) IN ({masked}) AS q_masked_day, coalesce(trips, 0) AS trips FROM cells c LEFT JOIN counts n ON c.zone = n.zone AND c.hour = n.hour),
grid AS (
  SELECT zone, hour, CASE WHEN NOT q_source_missing THEN trips END AS recorded, CASE WHEN NOT q_source_missing AND NOT q_masked_day THEN trips END AS target, q_source_missing, q_masked_day,
         NOT q_source_missing AND trips = 0 AS q_zero, NOT q_source_missing AND NOT q_masked_day AS eligible FROM base)"""


GAPPED = grid_of("SELECT cast(c_nationkey AS BIGINT) AS zone, cast(o_orderdate AS TIMESTAMP) AS pickup FROM orders JOIN customer ON o_custkey = c_custkey", "1997-03-01 00:00:00", "1997-03-31 23:00:00", "23, 24", "DATE '1997-03-10'")
