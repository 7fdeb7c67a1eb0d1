"""Queries: place clustering, place features and named locations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.functions.geo import mean_position
from sensorloom.operators import clustering, geogrid, places
from sensorloom.plans import views as v
from sensorloom.plans.q_features import rounded
from sensorloom.plans.q_windows import STAY_SQL, stay_rows
from sensorloom.plans.registry import query
from sensorloom.plans.views import sql_haversine_m, sql_with
from sensorloom.session import materialize

# Means of short decimals fall on rounding ties; both sides shift by this before rounding.
NUDGE = 3.31e-8

_KM = sql_haversine_m("a.lat", "a.lon", "b.lat", "b.lon") + " / 1000"


# Sums of unit vectors, and the position of such a sum.
_UNIT_SQL = "sum(cos(radians(lat)) * cos(radians(lon))) AS ux, sum(cos(radians(lat)) * sin(radians(lon))) AS uy, sum(sin(radians(lat))) AS uz"
_LAT_SQL, _LON_SQL = "degrees(atan2(uz, sqrt(ux * ux + uy * uy)))", "degrees(atan2(uy, ux))"


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _closure(name: str, edges: str) -> str:
    """Table expressions: every node of ``edges(device, s, t)`` with the smallest node it reaches."""
    return f"""{name}_e AS (SELECT device, s, t FROM {edges} UNION SELECT device, t, s FROM {edges}),
    {name}_r AS (SELECT device, s, t FROM {name}_e UNION SELECT r.device, r.s, e.t FROM {name}_r r JOIN {name}_e e ON e.device = r.device AND e.s = r.t),
    {name} AS (SELECT device, s AS id, least(min(t), s) AS root FROM {name}_r GROUP BY device, s)"""


@query(
    "haversine_pairs",
    sql_with(
        "gps",
        f"""SELECT * FROM (SELECT a.device, round(a.lat, 8) AS lat_a, round(a.lon, 8) AS lon_a, round(b.lat, 8) AS lat_b, round(b.lon, 8) AS lon_b, round({_KM}, 6) AS km
        FROM p a JOIN p b ON a.device = b.device AND (a.lat < b.lat OR (a.lat = b.lat AND a.lon < b.lon)) WHERE {_KM} < 1)""",
        "p AS (SELECT DISTINCT device, lat, lon FROM gps)",
    ),
)
def _haversine_pairs(spark, d):
    out = geogrid.haversine_pairs(v.gps(spark, d), 1.0)
    return rounded(out.withColumn("km", F.round("km", 6)), 8)


@query("place_clusters")
def _place_clusters(spark, d):
    out = clustering.place_clusters(v.gps(spark, d), 1.5)
    return out.select("event_id", "device", "cluster_label", F.round("cluster_lat", 6).alias("cluster_lat"), F.round("cluster_lon", 6).alias("cluster_lon"))


@query("place_cluster_summary")
def _place_cluster_summary(spark, d):
    return rounded(clustering.place_cluster_summary(clustering.place_clusters(v.gps(spark, d), 1.5)))


@query(
    "place_cluster_facts",
    sql_with(
        "gps",
        """SELECT device, count(*) AS n_rows, count(DISTINCT (lat, lon)) AS n_points, true AS within, true AS apart, true AS means_agree, true AS dense
        FROM gps GROUP BY device""",
    ),
)
def _place_cluster_facts(spark, d):
    """What complete linkage with a limit promises: members within it, no two clusters that could still merge."""
    rows = materialize(clustering.place_clusters(v.gps(spark, d), 1.5), "clustered")
    key = ["device", "cluster_label"]
    mean_lat, mean_lon = mean_position(F.col("lat"), F.col("lon"))
    means = rows.groupBy(*key).agg(mean_lat.alias("m_lat"), mean_lon.alias("m_lon"), F.first("cluster_lat").alias("lat"), F.first("cluster_lon").alias("lon"))
    agree = (F.abs(F.col("m_lat") - F.col("lat")) < 1e-9) & (F.abs(F.col("m_lon") - F.col("lon")) < 1e-9)
    shapes = materialize(geogrid.hulls(rows.select(*key, "lat", "lon").distinct(), key).withColumns({"lat": F.col("hull")[0]["lat"], "lon": F.col("hull")[0]["lon"]}), "shapes")
    near = geogrid.candidate_pairs(shapes, ["device"], "cluster_label", 1.5).filter(geogrid.farthest_km(F.col("a.hull"), F.col("b.hull")) < 1.5)
    mergeable = near.groupBy("device").agg(F.count("*").alias("n"))
    inside = shapes.groupBy("device").agg(F.bool_and(geogrid.farthest_km(F.col("hull"), F.col("hull")) < 1.5).alias("within"), F.count("*").alias("c"), F.max("cluster_label").alias("top"))
    whole = rows.groupBy("device").agg(F.count("*").alias("n_rows"), F.count_distinct("lat", "lon").alias("n_points"))
    told = whole.join(inside, "device").join(means.groupBy("device").agg(F.bool_and(agree).alias("means_agree")), "device").join(mergeable, "device", "left")
    return told.select("device", "n_rows", "n_points", "within", F.col("n").isNull().alias("apart"), "means_agree", (F.col("top") + 1 == F.col("c")).alias("dense"))


_CHUNK_SQL = f"""ps AS (SELECT *, k % 3 AS ch, k // 5 AS lab FROM gps),
  cc AS (SELECT device, ch, lab, {_LAT_SQL} AS lat, {_LON_SQL} AS lon FROM (SELECT device, ch, lab, {_UNIT_SQL} FROM ps GROUP BY ALL)),
  cp AS (SELECT a.device, a.ch AS ac, a.lab AS al, b.ch AS bc, b.lab AS bl, {_KM} AS centroid_km FROM cc a JOIN cc b ON a.device = b.device
    AND (a.ch, a.lab) < (b.ch, b.lab) AND a.ch <> b.ch WHERE {_KM} < 1.5),
  cf AS (SELECT cp.device, ac, al, bc, bl, centroid_km, max({_KM}) AS farthest_km FROM cp JOIN ps a ON a.device = cp.device AND a.ch = ac AND a.lab = al
    JOIN ps b ON b.device = cp.device AND b.ch = bc AND b.lab = bl GROUP BY ALL),
  ce AS (SELECT device, ac * 1000 + al AS s, bc * 1000 + bl AS t FROM cf WHERE farthest_km <= 2.5)"""


def _chunked(spark, d):
    return v.gps(spark, d).withColumns({"chunk": F.col("k") % 3, "cluster_label": F.expr("k div 5")})


@query(
    "chunk_cluster_pairs",
    sql_with(
        "gps",
        """SELECT device, ac AS chunk_a, al AS label_a, bc AS chunk_b, bl AS label_b, round(centroid_km, 6) AS centroid_km,
        round(farthest_km, 6) AS farthest_km, farthest_km <= 2.5 AS merged FROM cf""",
        _CHUNK_SQL,
    ),
)
def _chunk_cluster_pairs(spark, d):
    out = clustering.chunk_cluster_pairs(_chunked(spark, d), 1.5, 2.5)
    return out.select(
        "device", F.col("id_a.chunk").alias("chunk_a"), F.col("id_a.label").alias("label_a"), F.col("id_b.chunk").alias("chunk_b"),
        F.col("id_b.label").alias("label_b"), F.round("centroid_km", 6).alias("centroid_km"), F.round("farthest_km", 6).alias("farthest_km"), "merged",
    )


@query(
    "merge_chunk_clusters",
    _recursive(
        sql_with(
            "gps",
            f"""SELECT event_id, chunk, cluster_label, round({_LAT_SQL}, 6) AS cluster_lat, round({_LON_SQL}, 6) AS cluster_lon
            FROM moved JOIN (SELECT device, chunk, cluster_label, {_UNIT_SQL} FROM moved GROUP BY ALL) USING (device, chunk, cluster_label)""",
            _CHUNK_SQL + ", " + _closure("comp", "ce")
            + """, moved AS (SELECT ps.event_id, ps.device, ps.lat, ps.lon, coalesce(root, ch * 1000 + lab) // 1000 AS chunk, coalesce(root, ch * 1000 + lab) % 1000 AS cluster_label
             FROM ps LEFT JOIN comp ON comp.device = ps.device AND comp.id = ch * 1000 + lab)""",
        )
    ),
)
def _merge_chunk_clusters(spark, d):
    out = clustering.merge_chunk_clusters(_chunked(spark, d), 1.5, 2.5)
    return rounded(out.select("event_id", "chunk", "cluster_label", "cluster_lat", "cluster_lon"))


@query(
    "relabel_clusters",
    sql_with(
        "gps",
        "SELECT event_id, device, dense_rank() OVER (PARTITION BY device ORDER BY k % 3, k // 5) - 1 AS new_label FROM gps",
    ),
)
def _relabel_clusters(spark, d):
    return clustering.relabel_clusters(_chunked(spark, d)).select("event_id", "device", "new_label")


def _sql_pass(i: int, state: str) -> str:
    """One merge pass over ``state(device, id, ux, uy, uz)``."""
    return f"""pl{i} AS (SELECT device, id, {_LAT_SQL} AS lat, {_LON_SQL} AS lon FROM {state}),
    pe{i} AS (SELECT a.device, a.id AS s, b.id AS t FROM pl{i} a JOIN pl{i} b ON a.device = b.device AND a.id < b.id WHERE {_KM} < 0.6),
    {_closure(f"pc{i}", f"pe{i}")},
    st{i} AS (SELECT s.device, coalesce(root, s.id) AS id, sum(ux) AS ux, sum(uy) AS uy, sum(uz) AS uz FROM {state} s
      LEFT JOIN pc{i} c ON c.device = s.device AND c.id = s.id GROUP BY 1, 2)"""


@query(
    "merge_close_places",
    _recursive(
        sql_with(
            "gps",
            f"""SELECT event_id, coalesce(b.root, a.root, g.k) AS cluster_label, round({_LAT_SQL}, 6) AS cluster_lat, round({_LON_SQL}, 6) AS cluster_lon FROM gps g
            LEFT JOIN pc1 a ON a.device = g.device AND a.id = g.k LEFT JOIN pc2 b ON b.device = g.device AND b.id = coalesce(a.root, g.k)
            JOIN st2 ON st2.device = g.device AND st2.id = coalesce(b.root, a.root, g.k)""",
            f"st0 AS (SELECT device, k AS id, {_UNIT_SQL} FROM gps GROUP BY ALL), "
            + _sql_pass(1, "st0") + ", " + _sql_pass(2, "st1"),
        )
    ),
)
def _merge_close_places(spark, d):
    rows = v.gps(spark, d).withColumn("cluster_label", F.col("k"))
    out = clustering.merge_close_places(rows, 0.6)
    return rounded(out.select("event_id", "cluster_label", "cluster_lat", "cluster_lon"))


@query(
    "topn_places",
    sql_with(
        "place_series",
        """SELECT event_id, device, records_total FROM (SELECT p.event_id, p.device, c.rk, t.records_total FROM place_series p JOIN
          (SELECT *, row_number() OVER (PARTITION BY device, chunk ORDER BY n DESC, pl) AS rk FROM
            (SELECT device, chunk, k // 10 AS pl, count(*) AS n FROM place_series GROUP BY ALL)) c ON c.device = p.device AND c.chunk = p.chunk AND c.pl = p.k // 10
          JOIN (SELECT device, count(*) AS records_total FROM place_series GROUP BY device) t ON t.device = p.device) WHERE rk <= 3""",
    ),
)
def _topn_places(spark, d):
    rows = v.place_series(spark, d).withColumn("place", F.expr("k div 10"))
    return places.topn_places(rows, 3, within=["chunk"]).select("event_id", "device", "records_total")


# --- place features ---------------------------------------------------------------------------

_FEAT_SQL = STAY_SQL + ", nd AS (SELECT device, count(DISTINCT us // 86400000000)::DOUBLE AS nd FROM sr GROUP BY device)"


@query(
    "place_visits",
    sql_with(
        "place_series",
        """SELECT device, place, round(f / nd, 6) AS visits_per_day, round(ft / nd, 6) AS visits_per_day_trusted,
        CASE WHEN sum(f) OVER w = 0 THEN 0 ELSE round(f / (sum(f) OVER w)::DOUBLE, 6) END AS visits_fraction,
        CASE WHEN sum(ft) OVER w = 0 THEN 0 ELSE round(ft / (sum(ft) OVER w)::DOUBLE, 6) END AS visits_fraction_trusted
        FROM (SELECT device, place, sum(stay_first) AS f, sum(stay_first_trusted) AS ft FROM sr GROUP BY ALL) JOIN nd USING (device) WINDOW w AS (PARTITION BY device)""",
        _FEAT_SQL,
    ),
)
def _place_visits(spark, d):
    return rounded(places.place_visits(stay_rows(spark, d)))


_TIME_SQL = (
    _FEAT_SQL
    + """, pt0 AS (SELECT device, place, count(*) AS n, coalesce(sum(stay_s), 0) AS s, coalesce(sum(stay_s_trusted), 0) AS st, max(stay_s) AS mx, max(stay_s_trusted) AS mxt,
    avg(stay_s) AS mean, avg(stay_s_trusted) AS meant FROM sr GROUP BY ALL),
  pt AS (SELECT device, place, n AS total_records, n / (sum(n) OVER w)::DOUBLE AS total_records_fraction, n / (sum(n) OVER w)::DOUBLE AS biggest_places_fraction,
    s / nd AS time_per_day, st / nd AS time_per_day_trusted, mx AS stay_duration_max, mxt AS stay_duration_max_trusted, mean AS stay_duration_mean, meant AS stay_duration_mean_trusted,
    CASE WHEN sum(s) OVER w = 0 THEN 0 ELSE s / sum(s) OVER w END AS time_fraction, CASE WHEN sum(st) OVER w = 0 THEN 0 ELSE st / sum(st) OVER w END AS time_fraction_trusted
    FROM pt0 JOIN nd USING (device) WINDOW w AS (PARTITION BY device))"""
)
_PT = "device, place, total_records, " + ", ".join(
    f"round({c} + 3.31e-8, 6) AS {c}"
    for c in (
        "total_records_fraction biggest_places_fraction time_per_day time_per_day_trusted stay_duration_max stay_duration_max_trusted "
        "stay_duration_mean stay_duration_mean_trusted time_fraction time_fraction_trusted"
    ).split()
)


@query("place_time", sql_with("place_series", f"SELECT {_PT} FROM pt", _TIME_SQL))
def _place_time(spark, d):
    return rounded(places.place_time(stay_rows(spark, d)), nudge=NUDGE)


@query("places_with_stay", sql_with("place_series", f"SELECT {_PT} FROM pt WHERE stay_duration_mean > 0", _TIME_SQL))
def _places_with_stay(spark, d):
    return rounded(places.places_with_stay(places.place_time(stay_rows(spark, d))), nudge=NUDGE)


_RANKED = ["total_records", "time_per_day", "stay_duration_max_trusted"]


@query(
    "place_feature_ranks",
    sql_with(
        "place_series",
        "SELECT device, place, " + ", ".join(
            f"CASE WHEN {f} IS NOT NULL THEN rank() OVER (PARTITION BY device ORDER BY {f} {o} NULLS LAST) + (count(*) OVER (PARTITION BY device, {f}) - 1) / 2.0::DOUBLE END AS {f}_rank_{n}"
            for f in _RANKED for o, n in (("DESC", "ascent"), ("ASC", "descent"))
        ) + " FROM (SELECT device, place, total_records, round(time_per_day, 6) AS time_per_day, round(stay_duration_max_trusted, 6) AS stay_duration_max_trusted FROM pt)",
        _TIME_SQL,
    ),
)
def _place_feature_ranks(spark, d):
    table = rounded(places.place_time(stay_rows(spark, d))).select("device", "place", *_RANKED)
    return places.place_feature_ranks(table, _RANKED).drop(*_RANKED)


_SLOT_SQL = (
    _FEAT_SQL
    + """, sl0 AS (SELECT *, CAST(date_part('hour', make_timestamp(us)) AS INTEGER) AS h, CAST(date_part('isodow', make_timestamp(us)) - 1 AS INTEGER) AS wd FROM sr),
  sl AS (SELECT *, 'hour' AS slot_type, CAST(h AS VARCHAR) AS slot FROM sl0
    UNION ALL SELECT *, 'time_of_day', CASE WHEN h < 6 THEN 'night' WHEN h < 12 THEN 'morning' WHEN h < 18 THEN 'afternoon' ELSE 'evening' END FROM sl0
    UNION ALL SELECT *, 'weekday', CAST(wd AS VARCHAR) FROM sl0 UNION ALL SELECT *, 'day_kind', CASE WHEN wd >= 5 THEN 'weekend' ELSE 'weekday' END FROM sl0),
  al AS (SELECT device, place, sum(stay_first) AS f, sum(stay_first_trusted) AS ft, sum(stay_last) AS l, sum(stay_last_trusted) AS lt, count(DISTINCT stay) AS s,
    count(DISTINCT stay_trusted) AS st, count(stay) AS r, count(stay_trusted) AS rt FROM sr GROUP BY ALL),
  sg AS (SELECT device, place, slot_type, slot, sum(stay_first) AS f, sum(stay_first_trusted) AS ft, sum(stay_last) AS l, sum(stay_last_trusted) AS lt, count(DISTINCT stay) AS s,
    count(DISTINCT stay_trusted) AS st, count(stay) AS r, count(stay_trusted) AS rt FROM sl GROUP BY ALL),
  slots AS (SELECT sg.device, sg.place, slot_type, slot, """
    + ", ".join(
        f"CASE WHEN al.{c} = 0 THEN 0 ELSE round(sg.{c} / al.{c}::DOUBLE, 6) END AS {n}"
        for n, c in (
            ("arrive", "f"), ("arrive_trusted", "ft"), ("leave", "l"), ("leave_trusted", "lt"), ("intersecting", "s"),
            ("intersecting_trusted", "st"), ("time_fraction", "r"), ("time_fraction_trusted", "rt"),
        )
    )
    + """, round(sg.r * 43200 / nd, 4) AS time_per_day, round(sg.rt * 43200 / nd, 4) AS time_per_day_trusted
    FROM sg JOIN al ON al.device = sg.device AND al.place = sg.place JOIN nd ON nd.device = sg.device)"""
)


def _slots(spark, d):
    out = places.place_timeslots(stay_rows(spark, d), 1 / 43200)
    return rounded(out.withColumns({c: F.round(c, 4) for c in ("time_per_day", "time_per_day_trusted")}))


@query("place_timeslots", sql_with("place_series", "SELECT * FROM slots", _SLOT_SQL))
def _place_timeslots(spark, d):
    return _slots(spark, d)


_WIDE = [
    (kind, slot, f"{f}{t}") for kind, values in places.SLOTS.items() for slot in values for f in places.SLOT_FEATURES for t in ("", "_trusted")
]


@query(
    "place_timeslots_wide",
    sql_with(
        "place_series",
        "SELECT device, place, " + ", ".join(
            f"coalesce(max({n}) FILTER (slot_type = '{kind}' AND slot = '{slot}'), 0) AS \"{kind}_{slot}_{n}\"" for kind, slot, n in _WIDE
        ) + " FROM slots GROUP BY device, place",
        _SLOT_SQL,
    ),
)
def _place_timeslots_wide(spark, d):
    return places.place_timeslots_wide(_slots(spark, d))


# --- frequent places --------------------------------------------------------------------------


@query("kmeans_k_sweep")
def _kmeans_k_sweep(spark, d):
    return rounded(places.kmeans_k_sweep(v.gps(spark, d), 9, 18, min_rows=10, near_m=1500))


@query(
    "kmeans_facts",
    sql_with(
        "gps",
        """SELECT device, count(*) AS n_rows, true AS all_members, true AS near_are_members, true AS near_add_up, true AS silhouettes, true AS places
        FROM gps WHERE date_part('hour', make_timestamp(us)) >= 9 AND date_part('hour', make_timestamp(us)) < 18 GROUP BY device HAVING count(*) >= 10""",
    ),
)
def _kmeans_facts(spark, d):
    """Per participant: rows of the day part, members and near rows that add up, and one silhouette from -1 to 1."""
    found = materialize(places.kmeans_k_sweep(v.gps(spark, d), 9, 18, min_rows=10, near_m=1500), "frequent")
    near = F.sum("entries_near") == F.max("n_rows_near")
    one = (F.min("silhouette") == F.max("silhouette")) & (F.abs(F.min("silhouette")) <= 1) & (F.max("silhouette_error") == 0)
    return found.groupBy("device").agg(
        F.max("n_rows").alias("n_rows"), (F.sum("n_members") == F.max("n_rows")).alias("all_members"), F.bool_and(F.col("entries_near") <= F.col("n_members")).alias("near_are_members"),
        near.alias("near_add_up"), one.alias("silhouettes"), ((F.count("*") <= F.max("n_places")) & F.max("n_places").isin(1, 2, 3, 4, 5, 6)).alias("places"),
    )


def _frequent(spark, d, hours: str = "true"):
    return (
        v.gps(spark, d)
        .filter(hours)
        .groupBy("device", F.expr("k div 10").alias("place"))
        .agg(
            F.avg("lat").alias("lat"),
            F.avg("lon").alias("lon"),
            F.count(F.when(F.col("k") % 10 < 6, 1)).alias("entries_near"),
            F.count("*").alias("entries"),
        )
    )


def _freq_sql(name: str, hours: str = "true") -> str:
    return (
        f"{name} AS (SELECT device, k // 10 AS place, avg(lat) AS lat, avg(lon) AS lon, count(*) FILTER (k % 10 < 6) AS entries_near, count(*) AS entries "
        f"FROM gps WHERE {hours} GROUP BY ALL)"
    )


@query(
    "merge_frequent_places",
    _recursive(
        sql_with(
            "gps",
            """SELECT f.device, coalesce(root, place) AS place, round(avg(lat) + 3.31e-8, 6) AS lat, round(avg(lon) + 3.31e-8, 6) AS lon, CAST(sum(entries_near) AS BIGINT) AS entries_near,
            CAST(sum(entries) AS BIGINT) AS entries FROM fq f LEFT JOIN fc ON fc.device = f.device AND fc.id = place GROUP BY 1, 2""",
            _freq_sql("fq")
            + f", fe AS (SELECT a.device, a.place AS s, b.place AS t FROM fq a JOIN fq b ON a.device = b.device AND a.place < b.place WHERE {_KM} < 1.3), "
            + _closure("fc", "fe"),
        )
    ),
)
def _merge_frequent_places(spark, d):
    return rounded(places.merge_frequent_places(_frequent(spark, d), 1300), nudge=NUDGE)


_DROP_SQL = """{o} AS (SELECT *, entries_near / (sum(entries) OVER (PARTITION BY device))::DOUBLE AS share_near FROM {i}
  QUALIFY entries_near >= sum(entries) OVER (PARTITION BY device) / (count(*) OVER (PARTITION BY device))::DOUBLE + 1
    OR row_number() OVER (PARTITION BY device ORDER BY entries_near DESC, place DESC) = 1)"""


@query(
    "drop_infrequent_places",
    sql_with(
        "gps",
        "SELECT device, place, entries_near, entries, round(share_near, 6) AS share_near FROM dq",
        _freq_sql("fq") + ", " + _DROP_SQL.format(o="dq", i="fq"),
    ),
)
def _drop_infrequent_places(spark, d):
    return rounded(places.drop_infrequent_places(_frequent(spark, d)).drop("lat", "lon"))


_H = "date_part('hour', make_timestamp(us))"


@query(
    "classify_frequent_places",
    sql_with(
        "gps",
        """SELECT device, round(lat + 3.31e-8, 6) AS lat, round(lon + 3.31e-8, 6) AS lon, CASE WHEN row_number() OVER (PARTITION BY device ORDER BY share_near DESC, place) = 1 THEN 'home'
          ELSE 'other sleep place' END AS location_name FROM nd UNION ALL
        SELECT device, round(lat + 3.31e-8, 6), round(lon + 3.31e-8, 6), CASE WHEN row_number() OVER (PARTITION BY device ORDER BY share_near DESC, place) = 1 THEN 'work'
          ELSE 'other frequent place' END FROM free""",
        ", ".join(
            [
                _freq_sql("nf", f"{_H} < 6"), _freq_sql("df", f"{_H} >= 9 AND {_H} < 18"),
                _DROP_SQL.format(o="nd", i="nf"), _DROP_SQL.format(o="dd", i="df"),
                f"free AS (SELECT * FROM dd a WHERE NOT EXISTS (SELECT 1 FROM nd b WHERE b.device = a.device AND {_KM} < 2))",
            ]
        ),
    ),
)
def _classify_frequent_places(spark, d):
    hour = "hour(timestamp_micros(us))"
    night = places.drop_infrequent_places(_frequent(spark, d, f"{hour} < 6"))
    day = places.drop_infrequent_places(_frequent(spark, d, f"{hour} >= 9 AND {hour} < 18"))
    return rounded(places.classify_frequent_places(day, night, 2000), nudge=NUDGE)


# --- named locations --------------------------------------------------------------------------

_NAMES = {"0": places.HOME, "1": places.OFFICE, "2": "elsewhere"}
_CLASS_SQL = f"""cl AS (SELECT device, CASE k % 4 WHEN 0 THEN '{places.HOME}' WHEN 1 THEN '{places.OFFICE}' ELSE 'elsewhere' END AS label, k // 25 AS cluster_label,
    count(*) AS n_rows, avg(lat) AS lat, avg(lon) AS lon FROM gps WHERE k % 4 < 3 GROUP BY ALL),
  cm AS (SELECT device, CASE WHEN rn = 2 THEN label || ' 2' ELSE label END AS place, lat, lon, n_rows AS n FROM
    (SELECT *, row_number() OVER (PARTITION BY device, label ORDER BY n_rows DESC, cluster_label) AS rn FROM cl) WHERE rn = 1 OR (rn = 2 AND label = '{places.HOME}'))"""


def _class_map(spark, d):
    label = F.create_map(*[F.lit(x) for kv in _NAMES.items() for x in kv])[(F.col("k") % 4).cast("string")]
    clusters = (
        v.gps(spark, d)
        .withColumn("label", label)
        .filter(F.col("label").isNotNull())
        .groupBy("device", "label", F.expr("k div 25").alias("cluster_label"))
        .agg(F.count("*").alias("n_rows"), F.avg("lat").alias("cluster_lat"), F.avg("lon").alias("cluster_lon"))
    )
    return places.class_location_map(clusters)


@query(
    "class_location_map",
    sql_with("gps", "SELECT device, place, round(lat + 3.31e-8, 6) AS lat, round(lon + 3.31e-8, 6) AS lon, n FROM cm", _CLASS_SQL),
)
def _class_location_map(spark, d):
    return rounded(_class_map(spark, d), nudge=NUDGE)


@query("class_location_map_clustered")
def _class_location_map_clustered(spark, d):
    label = F.create_map(*[F.lit(x) for kv in _NAMES.items() for x in kv])[(F.col("k") % 4).cast("string")]
    fixes = v.gps(spark, d).withColumn("label", label).filter(F.col("label").isNotNull())
    clustered = clustering.place_clusters(fixes, 3.0, ("device", "label"))
    return rounded(places.class_location_map(clustering.place_cluster_summary(clustered, ("device", "label"))))


@query(
    "resolve_close_classes",
    sql_with(
        "gps",
        f"""SELECT cm.device, place, round(lat + 3.31e-8, 6) AS lat, round(lon + 3.31e-8, 6) AS lon, n + CASE WHEN place = '{places.HOME}' AND ho THEN onn WHEN place = '{places.OFFICE}' AND h2o THEN h2n ELSE 0 END AS n
        FROM cm JOIN fl USING (device) WHERE NOT (place = '{places.OFFICE}' AND ho) AND NOT (place = '{places.HOME_2}' AND h2o)""",
        _CLASS_SQL
        + f""", fl AS (SELECT d.device, coalesce(hd < 3, false) AS ho, NOT coalesce(hd < 3, false) AND coalesce(h2d < 3, false) AS h2o, onn, h2n FROM (SELECT DISTINCT device FROM cm) d
          LEFT JOIN (SELECT a.device, {_KM} AS hd FROM cm a JOIN cm b ON a.device = b.device AND a.place = '{places.HOME}' AND b.place = '{places.OFFICE}') USING (device)
          LEFT JOIN (SELECT a.device, {_KM} AS h2d FROM cm a JOIN cm b ON a.device = b.device AND a.place = '{places.HOME_2}' AND b.place = '{places.OFFICE}') USING (device)
          LEFT JOIN (SELECT device, n AS onn FROM cm WHERE place = '{places.OFFICE}') USING (device)
          LEFT JOIN (SELECT device, n AS h2n FROM cm WHERE place = '{places.HOME_2}') USING (device))""",
    ),
)
def _resolve_close_classes(spark, d):
    return rounded(places.resolve_close_classes(_class_map(spark, d), 3000), nudge=NUDGE)


