"""Sensor-style views over the test tables, in Spark and as SQL text.

Each view exists twice: as a Spark function and as a SQL common table
expression, so that a registered query and its SQL check start from the same
rows. Thresholds are scaled to the sparse test events (about 67 rows per user
over 30 days).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sensorloom.functions.scalars import floor_div
from sensorloom.functions.timefn import DAY, HOUR, micros
from sensorloom.operators.models import loso_centroids

N_FEATURES = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("device"),
        "event_type",
        micros(F.col("ts")).alias("us"),
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        "props",
    )


def sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        ev(spark, sf_dir)
        .filter(F.col("event_type").isin("view", "click", "signup"))
        .select(
            "event_id",
            "device",
            F.col("event_type").alias("sensor"),
            "us",
            F.col("value").alias("dv0"),
            F.col("k").cast("double").alias("dv1"),
            (F.col("value") - F.col("k")).alias("dv2"),
            F.col("value").alias("accuracy"),
        )
    )


def one_sensor(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sensor(spark, sf_dir).filter(F.col("sensor") == name)


def esm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        ev(spark, sf_dir)
        .filter(F.col("event_type") == "purchase")
        .select(
            "event_id",
            "device",
            F.col("us").alias("event_us"),
            F.concat(F.lit("c"), (F.col("k") % 4).cast("string")).alias("label"),
            "k",
            "value",
        )
    )


def screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        ev(spark, sf_dir)
        .filter(F.col("event_type") == "error")
        .select("event_id", "device", "us", (F.col("k") % 4).alias("status"))
    )


def _gps_columns(frame: DataFrame) -> DataFrame:
    frac = F.col("value") - F.floor("value")
    return frame.select(
        "event_id",
        "device",
        "us",
        F.col("value").alias("accuracy"),
        (F.lit(50.0) + floor_div(F.col("k"), 10) * F.lit(0.01) + frac * F.lit(0.003)).alias("lat"),
        (F.lit(8.0) + (F.col("k") % 10) * F.lit(0.01) + frac * F.lit(0.002)).alias("lon"),
        "k",
    )


def gps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gps_columns(ev(spark, sf_dir))


def place_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gps(spark, sf_dir).withColumns(
        {"place": floor_div(F.col("k"), 25), "chunk": F.col("k") % 3}
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    new_id = floor_div(F.col("device"), 2)
    return (
        ev(spark, sf_dir)
        .select("device")
        .distinct()
        .select(
            "device",
            new_id.alias("new_id"),
            F.when(new_id % 3 == 0, "Europe/Berlin")
            .when(new_id % 3 == 1, "America/New_York")
            .otherwise("Asia/Tokyo")
            .alias("timezone"),
            F.when(new_id % 3 == 0, "Berlin").when(new_id % 3 == 1, "New York").otherwise("Tokyo").alias("city"),
        )
    )


# Sensor frequencies in Hz; 0 marks an irregular sensor.
SENSOR_HZ = {"view": 0.00001, "click": 0.00002, "signup": 0.00001, "purchase": 0.00001, "error": 0.0}


def sensors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SENSOR_HZ.items()), "sensor string, hz double")


def wifi(spark: SparkSession, sf_dir: str) -> DataFrame:
    bssid = F.when(F.col("k") % 10 != 0, F.concat(F.lit("ap"), floor_div(F.col("k"), 5).cast("string")))
    return (
        ev(spark, sf_dir)
        .filter(F.col("event_type") == "view")
        .select("event_id", "device", "us", bssid.alias("bssid"))
    )


def lab_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session per day present in the data, 08:00 to 20:00."""
    day = floor_div(F.col("us"), DAY)
    return (
        ev(spark, sf_dir)
        .select(day.alias("day"))
        .distinct()
        .select(
            F.col("day").alias("priority"),
            F.concat(
                F.lit("0"), (F.col("day") % 3).cast("string"), F.lit("_x"), (F.col("day") % 4).cast("string")
            ).alias("label"),
            (F.col("day") * DAY + 8 * HOUR).alias("start_us"),
            (F.col("day") * DAY + 20 * HOUR).alias("end_us"),
        )
    )


def questionnaire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("event"),
        F.col("turn").alias("answer_order"),
        F.col("role").alias("question"),
        F.concat(F.lit('["'), F.col("text"), F.lit('"]')).alias("answer"),
    )


def feature_matrix(spark: SparkSession, sf_dir: str, n: int = N_FEATURES) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        (F.col("vec_id") % 6).alias("device"),
        F.col("label").cast("long").alias("label"),
        *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(n)],
    )


CLASSES = ["c0", "c1", "c2", "c3"]


def prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each subject predicted from the class centroids of the others; probabilities fall with the distance."""
    labelled = feature_matrix(spark, sf_dir).withColumn("y_test", F.concat(F.lit("c"), (F.col("label") % 4).cast("string")))
    return loso_centroids(labelled, [f"f{i}" for i in range(N_FEATURES)], "y_test", "device", CLASSES, ["vec_id"]).withColumnRenamed("device", "subject")


_CTE = {
    "ev": """ev AS (SELECT event_id, user_id AS device, event_type, epoch_us(ts) AS us, value,
      CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, props FROM events)""",
    "sensor": """sensor AS (SELECT event_id, device, event_type AS sensor, us, value AS dv0, CAST(k AS DOUBLE) AS dv1,
      value - k AS dv2, value AS accuracy FROM ev WHERE event_type IN ('view', 'click', 'signup'))""",
    "esm": """esm AS (SELECT event_id, device, us AS event_us, 'c' || CAST(k % 4 AS VARCHAR) AS label, k, value
      FROM ev WHERE event_type = 'purchase')""",
    "screen": """screen AS (SELECT event_id, device, us, k % 4 AS status FROM ev WHERE event_type = 'error')""",
    "gps": """gps AS (SELECT event_id, device, us, value AS accuracy,
      50.0::DOUBLE + (k // 10) * 0.01::DOUBLE + (value - floor(value)) * 0.003::DOUBLE AS lat,
      8.0::DOUBLE + (k % 10) * 0.01::DOUBLE + (value - floor(value)) * 0.002::DOUBLE AS lon, k FROM ev)""",
    "place_series": """place_series AS (SELECT *, k // 25 AS place, k % 3 AS chunk FROM gps)""",
    "users": """users AS (SELECT device, device // 2 AS new_id,
      CASE (device // 2) % 3 WHEN 0 THEN 'Europe/Berlin' WHEN 1 THEN 'America/New_York' ELSE 'Asia/Tokyo' END AS timezone,
      CASE (device // 2) % 3 WHEN 0 THEN 'Berlin' WHEN 1 THEN 'New York' ELSE 'Tokyo' END AS city
      FROM (SELECT DISTINCT device FROM ev))""",
    "sensors": """sensors AS (SELECT * FROM (VALUES ('view', 0.00001::DOUBLE), ('click', 0.00002::DOUBLE),
      ('signup', 0.00001::DOUBLE), ('purchase', 0.00001::DOUBLE), ('error', 0.0::DOUBLE)) t(sensor, hz))""",
    "wifi": """wifi AS (SELECT event_id, device, us, CASE WHEN k % 10 <> 0 THEN 'ap' || CAST(k // 5 AS VARCHAR) END AS bssid
      FROM ev WHERE event_type = 'view')""",
    "lab_session": """lab_session AS (SELECT day AS priority, '0' || CAST(day % 3 AS VARCHAR) || '_x' || CAST(day % 4 AS VARCHAR) AS label,
      day * 86400000000 + 8 * 3600000000 AS start_us, day * 86400000000 + 20 * 3600000000 AS end_us
      FROM (SELECT DISTINCT us // 86400000000 AS day FROM ev))""",
    "questionnaire": """questionnaire AS (SELECT conv_id AS event, turn AS answer_order, role AS question,
      '["' || text || '"]' AS answer FROM conversations)""",
    "fm": "fm AS (SELECT vec_id, vec_id % 6 AS device, CAST(label AS BIGINT) AS label, "
    + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS f{i}" for i in range(N_FEATURES))
    + " FROM embeddings)",
    "prediction": """cells AS (SELECT vec_id, vec_id % 6 AS subject, 'c' || CAST(label % 4 AS VARCHAR) AS y_test, unnest(embedding)::DOUBLE AS x,
      unnest(range(len(embedding))) AS j FROM embeddings),
      sums AS (SELECT subject, y_test, j, sum(x) AS s, count(*) AS n FROM cells GROUP BY ALL),
      centroids AS (SELECT o.subject, t.y_test AS class, t.j, (t.s - coalesce(u.s, 0)) / (t.n - coalesce(u.n, 0)) AS mean
        FROM (SELECT DISTINCT subject FROM sums) o CROSS JOIN (SELECT y_test, j, sum(s) AS s, sum(n) AS n FROM sums GROUP BY ALL) t
        LEFT JOIN sums u ON u.subject = o.subject AND u.y_test = t.y_test AND u.j = t.j WHERE t.n > coalesce(u.n, 0)),
      apart AS (SELECT vec_id, c.subject, c.y_test, class, sqrt(sum((x - mean) * (x - mean))) AS d FROM cells c JOIN centroids m USING (subject, j) GROUP BY ALL),
      shares AS (SELECT vec_id, subject, y_test, class, (1 / (d + 1e-9::DOUBLE)) / sum(1 / (d + 1e-9::DOUBLE)) OVER (PARTITION BY vec_id) AS p FROM apart),
      prediction AS (SELECT vec_id, y_test, subject, c0, c1, c2, c3, CASE greatest(c0, c1, c2, c3) WHEN c0 THEN 'c0' WHEN c1 THEN 'c1' WHEN c2 THEN 'c2' ELSE 'c3' END AS y_pred
        FROM (SELECT vec_id, subject, y_test, coalesce(max(p) FILTER (class = 'c0'), 0) AS c0, coalesce(max(p) FILTER (class = 'c1'), 0) AS c1,
          coalesce(max(p) FILTER (class = 'c2'), 0) AS c2, coalesce(max(p) FILTER (class = 'c3'), 0) AS c3 FROM shares GROUP BY ALL))""",
}
_NEEDS = {
    "sensor": ["ev"], "esm": ["ev"], "screen": ["ev"], "gps": ["ev"], "place_series": ["ev", "gps"], "users": ["ev"],
    "wifi": ["ev"], "lab_session": ["ev"],
}


def sql_with(names: str, body: str, *extra: str) -> str:
    """SQL text: the named views, optional further CTE text, then ``body``."""
    wanted: list[str] = []
    for name in names.split():
        for part in [*_NEEDS.get(name, []), name]:
            if part not in wanted:
                wanted.append(part)
    ctes = [_CTE[n] for n in wanted] + [e for e in extra if e]
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


def sql_haversine_m(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"(1000.0::DOUBLE * 12742.0 * asin(sqrt(least(power(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) "
        f"* cos(radians({lat2})) * power(sin(radians(({lon2}) - ({lon1})) / 2), 2), 1.0))))"
    )
