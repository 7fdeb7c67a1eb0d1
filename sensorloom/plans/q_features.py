"""Queries: segment features, feature selection and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.functions.timefn import DAY
from sensorloom.operators import features, selection, segments, spectrum
from sensorloom.plans import views as v
from sensorloom.plans.q_sources import joined
from sensorloom.plans.q_windows import MOVE_SQL, movement, segment_rows, segment_sql
from sensorloom.plans.registry import query
from sensorloom.plans.views import sql_with
from sensorloom.session import materialize

_AXES = ["dv0", "dv1", "dv2"]
_STATS = ["maximum", "minimum", "mean", "median", "standard_deviation", "root_mean_square"]


def rounded(df, digits: int = 6, skip: tuple[str, ...] = (), nudge: float = 0.0):
    """Round every DOUBLE column, so that summation order cannot show.

    ``nudge`` shifts values first where means of short decimals fall on a rounding tie.
    """
    return df.withColumns({c: F.round(F.col(c) + F.lit(nudge), digits) for c, t in df.dtypes if t == "double" and c not in skip})


def _sql_stats(c: str) -> str:
    return (
        f"round(max({c}), 6) AS {c}__maximum, round(min({c}), 6) AS {c}__minimum, round(avg({c}), 6) AS {c}__mean, "
        f"round(quantile_cont({c}, 0.5), 6) AS {c}__median, round(stddev_pop({c}), 6) AS {c}__standard_deviation, "
        f"round(sqrt(avg({c} * {c})), 6) AS {c}__root_mean_square"
    )


@query(
    "segment_features",
    sql_with(
        "sensor esm",
        "SELECT device, event_us, segment, min(us) AS first_us, count(*) AS n_rows, "
        + ", ".join(_sql_stats(c) for c in _AXES)
        + " FROM seg GROUP BY device, event_us, segment",
        segment_sql(),
    ),
)
def _segment_features(spark, d):
    return rounded(features.segment_features(segment_rows(spark, d), _AXES))


_FFT_SQL = """ix AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY device, event_us, segment) AS n FROM seg
    WINDOW w AS (PARTITION BY device, event_us, segment ORDER BY us, event_id)),
  ax AS (SELECT device, event_us, segment, n, i, unnest(['dv0', 'dv1', 'dv2']) AS "column", unnest([dv0, dv1, dv2]) AS x, unnest([range(0, n // 2 + 1), range(0, n // 2 + 1), range(0, n // 2 + 1)]) AS ks FROM ix),
  fft AS (SELECT device, event_us, segment, n AS n_rows, "column", k, sqrt(power(sum(x * cos(2 * pi() * ((k * i) % n) / n)), 2)
    + power(sum(x * sin(2 * pi() * ((k * i) % n) / n)), 2)) AS fft_abs FROM (SELECT device, event_us, segment, n, i, "column", x, unnest(ks) AS k FROM ax) GROUP BY ALL)"""


def _spectrum(spark, d):
    return spectrum.segment_fft(segment_rows(spark, d), _AXES, tie=["event_id"])


@query(
    "segment_fft",
    sql_with(
        "sensor esm",
        "SELECT device, event_us, segment, n_rows, \"column\", k, round(fft_abs, 5) AS fft_abs FROM fft",
        segment_sql() + ", " + _FFT_SQL,
    ),
)
def _segment_fft(spark, d):
    return rounded(_spectrum(spark, d), 5)


@query(
    "dominant_frequency",
    sql_with(
        "sensor esm",
        """SELECT device, event_us, segment, "column", round(min(k) * 10.0::DOUBLE / n_rows, 6) AS dominant_hz
        FROM (SELECT *, max(fft_abs) OVER (PARTITION BY device, event_us, segment, "column") AS most FROM fft) WHERE fft_abs >= most * (1 - 1e-9::DOUBLE)
        GROUP BY device, event_us, segment, "column", n_rows""",
        segment_sql() + ", " + _FFT_SQL,
    ),
)
def _dominant_frequency(spark, d):
    return rounded(spectrum.dominant_frequency(_spectrum(spark, d), 10))


@query(
    "gps_segment_features",
    sql_with(
        "gps esm",
        "SELECT device, event_us, segment, min(us) AS first_us, count(*) AS n_rows, "
        + ", ".join(
            f"round({fn}, 6) AS {c}__{name}"
            for c in ("speed_kmh", "accel_kmhs")
            for name, fn in (("mean", f"avg({c})"), ("median", f"quantile_cont({c}, 0.5)"), ("maximum", f"max({c})"))
        )
        + " FROM gseg WHERE speed_kmh IS NOT NULL AND accel_kmhs IS NOT NULL GROUP BY device, event_us, segment",
        MOVE_SQL
        + """, gb AS (SELECT device, event_us, min(us) AS t0, max(us) AS t1 FROM mv GROUP BY ALL),
        gp AS (SELECT mv.*, (us - t0) // 86400000000 AS segment FROM mv JOIN gb USING (device, event_us)
          WHERE t0 + ((us - t0) // 86400000000 + 1) * 86400000000 < t1),
        gseg AS (SELECT * FROM gp QUALIFY count(*) OVER (PARTITION BY device, event_us, segment) > 1)""",
    ),
)
def _gps_segment_features(spark, d):
    moves = materialize(movement(spark, d), "moves")
    return rounded(features.gps_segment_features(materialize(segments.tumbling_segments(moves, DAY, 1), "segments")))


_EXT_SQL = """xa AS (SELECT device, event_us, segment, us, event_id, unnest(['dv0', 'dv1', 'dv2']) AS "column", unnest([dv0, dv1, dv2]) AS x FROM seg),
  x0 AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER p AS n, avg(x) OVER p AS mu, max(x) OVER p AS mx, min(x) OVER p AS mn,
    var_pop(x) OVER p AS vp, lag(x) OVER w AS px FROM xa
    WINDOW p AS (PARTITION BY device, event_us, segment, "column"), w AS (PARTITION BY device, event_us, segment, "column" ORDER BY us, event_id)),
  x1 AS (SELECT *, x > mu AS ab, CASE WHEN px IS NOT NULL AND (px > mu) <> (x > mu) THEN 1 ELSE 0 END AS fl FROM x0),
  x2 AS (SELECT *, sum(fl) OVER (PARTITION BY device, event_us, segment, "column" ORDER BY i) AS run FROM x1),
  sk AS (SELECT device, event_us, segment, "column", max(l) AS longest FROM (SELECT device, event_us, segment, "column", run, count(*) AS l FROM x2 WHERE ab GROUP BY ALL) GROUP BY ALL)"""


@query(
    "segment_features_ext",
    sql_with(
        "sensor esm",
        """SELECT device, event_us, segment, "column", round(var_pop(x), 6) AS variance, round(sum(x * x), 5) AS abs_energy,
        round(avg(abs(x - px)), 6) AS mean_abs_change, round(coalesce(sum(abs(x - px)), 0.0), 6) AS absolute_sum_of_changes,
        count(*) FILTER (ab) AS count_above_mean, count(*) FILTER (x < mu) AS count_below_mean,
        round(min(i) FILTER (x = mx) / count(*)::DOUBLE, 6) AS first_location_of_maximum, round((max(i) FILTER (x = mx) + 1) / count(*)::DOUBLE, 6) AS last_location_of_maximum,
        round(min(i) FILTER (x = mn) / count(*)::DOUBLE, 6) AS first_location_of_minimum, round((max(i) FILTER (x = mn) + 1) / count(*)::DOUBLE, 6) AS last_location_of_minimum,
        CAST(sum(fl) AS BIGINT) AS number_crossing_mean,
        CASE WHEN max(vp) > 0 THEN round(sum((x - mu) * (px - mu)) / ((count(*) - 1) * max(vp)), 6) END AS autocorrelation_lag_1,
        round(regr_slope(x, i), 6) AS linear_trend_slope, count(*) AS n_rows,
        round(skewness(x), 5) AS skewness, round(kurtosis(x), 5) AS kurtosis,
        coalesce(max(longest), 0) AS longest_strike_above_mean, """
        + ", ".join(f"round(quantile_cont(x, 0.{q}), 6) AS quantile_0_{q}" for q in range(1, 10))
        + ' FROM x2 LEFT JOIN sk USING (device, event_us, segment, "column") GROUP BY device, event_us, segment, "column"',
        segment_sql() + ", " + _EXT_SQL,
    ),
)
def _segment_features_ext(spark, d):
    out = features.segment_features_ext(segment_rows(spark, d), _AXES, tie=["event_id"])
    out = out.withColumns({"abs_energy": F.round("abs_energy", 5), "skewness": F.round("skewness", 5), "kurtosis": F.round("kurtosis", 5)})
    return rounded(out)


_WIDE = [f"{s}_double_values_{a}__{f}" for s in ("lin", "rot") for a in (0, 1, 2) for f in [*_STATS, *(f"quantile__q_0.{q}" for q in range(1, 6))]][: v.N_FEATURES]


def _wide(spark, d):
    """A wide feature frame in the naming of the extractor, from all components of the test vectors."""
    fm = v.feature_matrix(spark, d)
    return fm.select("vec_id", "device", "label", *[F.col(f"f{i}").alias(n) for i, n in enumerate(_WIDE)])


@query(
    "feature_inventory",
    sql_with(
        "fm",
        """SELECT s AS sensor, a AS axis, CASE WHEN s = 'gravity' THEN 0 WHEN s = 'rotation' AND a = 'double_values_2' THEN 9 ELSE 11 END::BIGINT AS number_features, (SELECT count(*) FROM fm) AS number_records
        FROM (VALUES ('linear_accelerometer'), ('rotation'), ('gravity')) t(s), (VALUES ('double_values_0'), ('double_values_1'), ('double_values_2')) u(a)""",
    ),
)
def _feature_inventory(spark, d):
    return features.feature_inventory(
        _wide(spark, d), ["linear_accelerometer", "rotation", "gravity"], [f"double_values_{i}" for i in range(3)]
    )


@query(
    "select_features_by_name",
    sql_with(
        "fm",
        "SELECT vec_id, device, " + ", ".join(
            f'f{i} AS "{n}"' for i, n in enumerate(_WIDE) if n in [f"lin_double_values_{a}__mean" for a in range(3)] or n.startswith("rot_") and ("__max" in n or "quantile" in n)
        ) + " FROM fm",
    ),
)
def _select_features_by_name(spark, d):
    exact = [f"lin_double_values_{i}__mean" for i in range(3)]
    return features.select_features_by_name(
        _wide(spark, d), exact, [f"rot_double_values_{i}__{f}" for i in range(3) for f in ("max", "quantile")], ["vec_id", "device"]
    )


# --- cleaning and selection -------------------------------------------------------------------


def _gappy(spark, d):
    """All features: f4 constant, f5 mostly NULL, some infinities in f6, NULL labels for class 9."""
    fm = v.feature_matrix(spark, d)
    return fm.withColumns(
        {
            "f4": F.lit(1.0),
            "f5": F.when(F.col("vec_id") % 20 == 0, F.col("f5")),
            "f6": F.when(F.col("vec_id") % 10 == 0, float("inf")).when(F.col("vec_id") % 10 == 1, float("-inf"))
            .when(F.col("vec_id") % 10 == 2, None).otherwise(F.col("f6")),
            "label": F.when(F.col("label") != 9, F.col("label")),
        }
    )


_GAPPY_SQL = """gappy AS (SELECT vec_id, device, CASE WHEN label <> 9 THEN label END AS label, f0, f1, f2, f3, 1.0::DOUBLE AS f4,
  CASE WHEN vec_id % 20 = 0 THEN f5 END AS f5, CASE vec_id % 10 WHEN 0 THEN 'inf'::DOUBLE WHEN 1 THEN '-inf'::DOUBLE WHEN 2 THEN NULL ELSE f6 END AS f6, """ + ", ".join(f"f{i}" for i in range(7, v.N_FEATURES)) + " FROM fm)"
_COLS = [f"f{i}" for i in range(v.N_FEATURES)]


@query(
    "constant_null_columns",
    sql_with(
        "fm",
        " UNION ALL ".join(
            f"SELECT 'f{i}' AS \"column\", count(f{i}) AS n_values, min(f{i}) = max(f{i}) AS is_constant, round(1 - count(f{i}) / count(*)::DOUBLE, 6) AS null_share "
            f"FROM gappy HAVING min(f{i}) = max(f{i}) OR 1 - count(f{i}) / count(*)::DOUBLE > 0.9"
            for i in range(v.N_FEATURES)
        ),
        _GAPPY_SQL,
    ),
)
def _constant_null_columns(spark, d):
    return rounded(selection.constant_null_columns(_gappy(spark, d), _COLS))


@query(
    "feature_selection_report",
    sql_with(
        "fm",
        """SELECT s AS step_no, CASE s WHEN 0 THEN 'constant columns' WHEN 1 THEN 'columns above 0.9 NULL' ELSE 'rows without label' END AS step,
        n AS rows_before, CASE WHEN s = 2 THEN l ELSE n END AS rows_after, CASE s WHEN 0 THEN 67 WHEN 1 THEN 66 ELSE 65 END::BIGINT AS columns_before,
        CASE s WHEN 0 THEN 66 ELSE 65 END::BIGINT AS columns_after, CASE WHEN s = 2 THEN n - l ELSE 0 END AS rows_deleted,
        CASE WHEN s = 2 THEN 0 ELSE 1 END::BIGINT AS columns_deleted
        FROM (SELECT count(*) AS n, count(label) AS l FROM gappy), (SELECT unnest(range(0, 3)) AS s)""",
        _GAPPY_SQL,
    ),
)
def _feature_selection_report(spark, d):
    return selection.select_usable(_gappy(spark, d), _COLS, "label")[1]


@query(
    "select_usable",
    sql_with("fm", "SELECT * EXCLUDE (f4, f5) FROM gappy WHERE label IS NOT NULL", _GAPPY_SQL),
)
def _select_usable(spark, d):
    return selection.select_usable(_gappy(spark, d), _COLS, "label")[0]


def _sql_impute(clip: bool) -> str:
    fin = "FILTER (isfinite({c}))"
    cells = []
    for c in _COLS:
        med = f"(SELECT quantile_cont({c}, 0.5) {fin.format(c=c)} FROM gappy)"
        hi = f"(SELECT max({c}) {fin.format(c=c)} FROM gappy)" if clip else med
        lo = f"(SELECT min({c}) {fin.format(c=c)} FROM gappy)" if clip else med
        cells.append(
            f"round(CASE WHEN {c} IS NULL THEN {med} WHEN {c} = 'inf'::DOUBLE THEN {hi} WHEN {c} = '-inf'::DOUBLE THEN {lo} ELSE {c} END, 6) AS {c}"
        )
    return sql_with("fm", f"SELECT vec_id, {', '.join(cells)} FROM gappy", _GAPPY_SQL)


@query("impute_columns", _sql_impute(True))
def _impute_columns(spark, d):
    return rounded(selection.impute_columns(_gappy(spark, d).select("vec_id", *_COLS), _COLS))


@query("impute_columns_median", _sql_impute(False))
def _impute_columns_median(spark, d):
    return rounded(selection.impute_columns(_gappy(spark, d).select("vec_id", *_COLS), _COLS, clip_infinite=False))


@query(
    "mann_whitney_u",
    sql_with(
        "fm",
        """SELECT feature, class, n1 AS n_class, n AS n_rows, round(r, 6) AS rank_sum, round(u, 6) AS u,
        round(greatest(abs(u - n1 * (n - n1) / 2.0::DOUBLE) - 0.5, 0) / sqrt(n1 * (n - n1) / 12.0::DOUBLE * (n + 1 - t / (n * (n - 1.0::DOUBLE)))), 6) AS z FROM (
        SELECT feature, class, count(*) AS n1, max(n) AS n, sum(rk) AS r, sum(rk) - count(*) * (count(*) + 1) / 2.0::DOUBLE AS u, max(t) AS t FROM (
          SELECT feature, class, n, sum(c * c - 1.0::DOUBLE) OVER (PARTITION BY feature) AS t, rank() OVER (PARTITION BY feature ORDER BY x) + (c - 1) / 2.0::DOUBLE AS rk FROM (
            SELECT *, count(*) OVER (PARTITION BY feature, x) AS c, count(*) OVER (PARTITION BY feature) AS n FROM long)) GROUP BY feature, class)""",
        "long AS ("
        + " UNION ALL ".join(f"SELECT '{c}' AS feature, label AS class, {c} AS x FROM fm" for c in _COLS)
        + ")",
    ),
)
def _mann_whitney_u(spark, d):
    return rounded(selection.mann_whitney_u(v.feature_matrix(spark, d), _COLS, "label"))


def _sql_relevant(columns: list[str], fdr: float = 0.05) -> str:
    series, fraction = "1.0::DOUBLE", "z"
    for n in range(selection.TAIL_TERMS, 0, -1):
        series, fraction = f"(1 + z * z / {2 * n + 1} * {series})", f"(z + {n} / {fraction})"
    density = "exp(-z * z / 2) * sqrt(2 / pi())"
    harmonic = sum(1 / i for i in range(1, len(columns) + 1))
    return sql_with(
        "fm",
        f"""SELECT feature, round(min(p), 10) AS min_p_value, count(*) FILTER (i <= cut) AS n_relevant_classes, count(*) FILTER (i <= cut) > 0 AS is_relevant
        FROM (SELECT *, max(CASE WHEN p <= i * {fdr}::DOUBLE / {len(columns) * harmonic!r}::DOUBLE THEN i END) OVER (PARTITION BY class) AS cut FROM ordered) GROUP BY feature""",
        "long AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, label AS class, {c} AS x FROM fm" for c in columns) + ")",
        "counted AS (SELECT *, count(*) OVER (PARTITION BY feature, x) AS c, count(*) OVER (PARTITION BY feature) AS n FROM long)",
        """ranked AS (SELECT feature, class, n, sum(c * c - 1.0::DOUBLE) OVER (PARTITION BY feature) AS t,
          rank() OVER (PARTITION BY feature ORDER BY x) + (c - 1) / 2.0::DOUBLE AS rk FROM counted)""",
        """tested AS (SELECT feature, class, count(*) AS n1, max(n) AS n, max(t) AS t, sum(rk) - count(*) * (count(*) + 1) / 2.0::DOUBLE AS u
          FROM ranked GROUP BY feature, class)""",
        """scored AS (SELECT feature, class, greatest(abs(u - n1 * (n - n1) / 2.0::DOUBLE) - 0.5, 0)
          / sqrt(n1 * (n - n1) / 12.0::DOUBLE * (n + 1 - t / (n * (n - 1.0::DOUBLE)))) AS z FROM tested)""",
        f"valued AS (SELECT feature, class, coalesce(CASE WHEN z < 3.5 THEN greatest(1 - {density} * z * {series}, 0) ELSE {density} / {fraction} END, 1) AS p FROM scored)",
        "ordered AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY p, feature) AS i FROM valued)",
    )


@query("relevant_features", _sql_relevant([f"f{i}" for i in range(v.N_FEATURES)]))
def _relevant_features(spark, d):
    cols = [f"f{i}" for i in range(v.N_FEATURES)]
    return rounded(selection.relevant_features(v.feature_matrix(spark, d), cols, "label"), 10)


@query(
    "minmax_scale",
    sql_with(
        "fm",
        "SELECT vec_id, " + ", ".join(
            f"round(({c} - (SELECT min({c}) FROM fm WHERE device <> 0)) / (SELECT max({c}) - min({c}) FROM fm WHERE device <> 0), 6) AS {c}" for c in _COLS
        ) + " FROM fm",
    ),
)
def _minmax_scale(spark, d):
    fm = v.feature_matrix(spark, d)
    return rounded(selection.minmax_scale(fm.filter("device <> 0"), fm.select("vec_id", *_COLS), _COLS))


@query(
    "robust_scale",
    sql_with(
        "fm",
        "SELECT vec_id, " + ", ".join(
            f"round(({c} - (SELECT quantile_cont({c}, 0.5) FROM fm WHERE device <> 0)) / (SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) "
            f"FROM fm WHERE device <> 0), 6) AS {c}" for c in _COLS
        ) + " FROM fm",
    ),
)
def _robust_scale(spark, d):
    fm = v.feature_matrix(spark, d)
    return rounded(selection.robust_scale(fm.filter("device <> 0"), fm.select("vec_id", *_COLS), _COLS))


@query(
    "class_weights",
    sql_with(
        "fm",
        """SELECT label, n_class, round(sum(n_class) OVER () / (count(*) OVER () * n_class)::DOUBLE, 6) AS weight
        FROM (SELECT label, count(*) AS n_class FROM fm GROUP BY label)""",
    ),
)
def _class_weights(spark, d):
    return rounded(selection.class_weights(v.feature_matrix(spark, d, 1), "label"))


__all__ = ["joined", "rounded"]
