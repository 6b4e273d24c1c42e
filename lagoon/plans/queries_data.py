"""Queries on names, dates, hashes, sources, stored tables, plans and archive operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagoon.functions import arrays as A
from lagoon.functions import geo, hashing, names, times
from lagoon.functions.core import tidy
from lagoon.operators import correlate
from lagoon.plans import correlation
from lagoon.plans import fixtures as X
from lagoon.plans.queries_basic import _STATION
from lagoon.plans.register import GRID, VECTORS, Registry
from lagoon.sources import operations, store, waveforms

Q = Registry()
N, DELTA = X.HOURS, X.HOUR

# ---- names

_IDS = ["IM.H10N1..EDH", "IU.RAR.10.BHZ", "IU.RAR.10.BHR", "IU.RAR.10.BHT", "iu.rar.10.bhz", "IU.RAR.BHZ", "I*.RA?.*.BH?", "IM.H10N12345..EDH", ""]
_IDS_SQL = "ids AS (SELECT unnest([" + ", ".join(f"'{i}'" for i in _IDS) + "]) AS receiver)"


def _ids(spark):
    return spark.createDataFrame([(i,) for i in _IDS], "receiver string")


@Q(rf"WITH {_IDS_SQL} SELECT receiver, regexp_full_match(receiver, '[A-Z0-9]{{1,2}}\.[A-Z0-9]{{3,5}}\.[A-Z0-9]{{0,2}}\.[A-Z0-9]{{3}}') AS exact, regexp_full_match(receiver, '[A-Z0-9?*]{{1,2}}\.[A-Z0-9?*]{{1,5}}\.[A-Z0-9?*]{{0,2}}\.[A-Z0-9?*]{{1,3}}') AS wild FROM ids")
def check_receiver(spark, d):
    r = F.col("receiver")
    return _ids(spark).select("receiver", names.is_receiver(r).alias("exact"), names.is_receiver(r, True).alias("wild"))


@Q(f"WITH {_IDS_SQL} SELECT receiver, split_part(receiver, '.', 1) AS network, split_part(receiver, '.', 2) AS station, split_part(receiver, '.', 3) AS location, split_part(receiver, '.', 4) AS channel FROM ids WHERE len(string_split(receiver, '.')) = 4")
def receiver_struct(spark, d):
    return _ids(spark).withColumn("s", names.receiver_struct(F.col("receiver"))).where("s is not null").select("receiver", "s.*")


@Q("SELECT n_name || '-' || r_name AS pair, n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey")
def split_pair(spark, d):
    n, r = X.table(spark, d, "nation"), X.table(spark, d, "region")
    p = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(names.pair(F.col("n_name"), F.col("r_name")).alias("pair"))  # regions: five rows
    return p.select("pair", names.split_pair(F.col("pair"))[0].alias("a"), names.split_pair(F.col("pair"))[1].alias("b"))


@Q(f"""WITH {_IDS_SQL}, p AS (SELECT a.receiver || '-' || b.receiver AS pair, a.receiver AS a, b.receiver AS b FROM ids a JOIN ids b ON a.receiver < b.receiver WHERE a.receiver LIKE 'I_.___%.%.B__' AND b.receiver LIKE 'I_.___%.%.B__'),
c AS (SELECT pair, unnest([a, b]) AS r FROM p)
SELECT DISTINCT pair, CASE WHEN right(r, 1) IN ('R', 'T') THEN left(r, -1) || s ELSE r END AS receiver FROM c, (SELECT unnest(['1', '2', 'Z']) AS s)""")
def split_pair_substitute(spark, d):
    i = _ids(spark).where("receiver like 'I_.___%.%.B__'")
    p = i.select(F.col("receiver").alias("a")).join(i.select(F.col("receiver").alias("b")), F.col("a") < F.col("b"))
    name = names.pair(F.col("a"), F.col("b"))
    return p.select(name.alias("pair"), F.explode(names.split_pair_substitute(name)).alias("receiver"))


@Q(f"WITH {GRID} SELECT a.receiver || '-' || b.receiver AS pair FROM r a JOIN r b ON a.receiver < b.receiver WHERE regexp_matches(a.receiver || '-' || b.receiver, '^(click|error)-.*w$')")
def pair_filter_regex(spark, d):
    r = X.cells(spark, d).select("receiver").distinct()
    p = r.withColumnRenamed("receiver", "a").join(r.withColumnRenamed("receiver", "b"), F.col("a") < F.col("b")).select(names.pair(F.col("a"), F.col("b")).alias("pair"))
    return p.where(F.col("pair").rlike("^(click|error)-.*w$"))


@Q("SELECT DISTINCT o_orderstatus || '-' || o_orderpriority AS pair, strftime(o_orderdate, '%Y') || '/' || o_orderstatus || '-' || o_orderpriority || '/' || o_orderstatus || '-' || o_orderpriority || '.' || strftime(o_orderdate, '%Y.%j') AS path FROM orders")
def pair_path(spark, d):
    name = names.pair(F.col("o_orderstatus"), F.col("o_orderpriority"))
    return X.table(spark, d, "orders").select(name.alias("pair"), names.archive_path(name, F.col("o_orderdate")).alias("path")).distinct()


# ---- dates

_SPANS = "sp AS (SELECT l_returnflag AS flag, min(l_shipdate) AS a, max(l_shipdate) AS b FROM lineitem GROUP BY 1)"


def _spans(spark, d):
    return X.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))


@Q(f"WITH {_SPANS} SELECT flag, CAST(unnest(generate_series(CAST(a AS DATE), CAST(b AS DATE), INTERVAL 1 DAY)) AS DATE) AS day FROM sp")
def dates(spark, d):
    return _spans(spark, d).select("flag", F.explode(times.days(F.col("a"), F.col("b"))).alias("day"))


@Q(f"WITH {_SPANS} SELECT flag, round(date_diff('microsecond', a, b) / 1000000, 6) AS seconds FROM sp")
def to_seconds(spark, d):
    return _spans(spark, d).select("flag", F.round(times.seconds(F.col("a"), F.col("b")), 6).alias("seconds"))


@Q("""SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(day(last_day(o_orderdate)) AS INTEGER) AS days,
CAST(date_diff('day', make_date(year(o_orderdate), 1, 1), make_date(year(o_orderdate) + 1, 1, 1)) AS INTEGER) AS days_of_year FROM orders""")
def days_per_month(spark, d):
    t = F.col("o_orderdate")
    return X.table(spark, d, "orders").select(F.year(t).alias("year"), F.month(t).alias("month"), times.days_of_month(t).alias("days"), times.days_of_year(F.year(t)).alias("days_of_year")).distinct()


@Q("SELECT CAST(i AS BIGINT) AS year, (i % 4 = 0 AND i % 100 <> 0) OR i % 400 = 0 AS leap FROM range(1890, 2110) t(i)")
def leap_year(spark, d):
    return spark.range(1890, 2110).select(F.col("id").alias("year"), times.is_leap(F.col("id")).alias("leap"))


# ---- hashes

@Q(f"WITH {VECTORS} SELECT vec_id, sha256(concat_ws('|', CAST(vec_id AS VARCHAR), string_agg(CAST(CAST(round(v * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY k))) AS hash FROM v GROUP BY 1")
def series_hash(spark, d):
    return X.vectors(spark, d).select("vec_id", hashing.hash_text_series([F.col("vec_id").cast("string")], F.col("x")).alias("hash"))


@Q()
def series_hash_bytes(spark, d):
    return X.vectors(spark, d).select("vec_id", hashing.hash_bytes(F.col("x")).alias("hash"))


_OPS = {"BHZ": [["merge", {}], ["detrend", {"type": "linear"}], ["filter", {"frequency": 3.0, "type": "highpass"}]], "sha256_hash": "stale"}


@Q(f"SELECT CAST(len('{hashing.canonical(_OPS)}') AS INTEGER) AS n, sha256('{hashing.canonical(_OPS)}') AS hash")
def ops_hash(spark, d):
    return spark.range(1).select(F.lit(len(hashing.canonical(_OPS))).alias("n"), F.lit(hashing.hash_object(_OPS)).alias("hash"))


# ---- stored tables

@Q("""WITH f AS (SELECT 'p' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS path, o_orderstatus AS hash FROM orders WHERE o_totalprice > 100000)
SELECT path FROM f WHERE hash = (SELECT arg_min(hash, path) FROM f)""")
def validate_list(spark, d):
    o = X.table(spark, d, "orders")
    f = o.select(F.concat(F.lit("p"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("path"), F.col("o_orderstatus").alias("hash"), (F.col("o_totalprice") > 100000).alias("valid"))
    return store.validate_list(f).select("path")


_TWO = GRID + """, a AS (SELECT receiver AS pair, h AS time, CASE WHEN h % 3 = 0 THEN 1 ELSE -1 END AS status, v FROM g WHERE h < 500),
b AS (SELECT receiver AS pair, h AS time, CASE WHEN h % 2 = 0 THEN 1 ELSE -1 END AS status, v + 1 AS v FROM g WHERE h >= 400)"""


def _two(spark, d):
    g = X.grid(spark, d).withColumnRenamed("receiver", "pair").withColumnRenamed("h", "time")
    s = lambda k: F.when(F.col("time") % k == 0, 1).otherwise(-1).alias("status")
    return g.where("time < 500").select("pair", "time", s(3), "v"), g.where("time >= 400").select("pair", "time", s(2), (F.col("v") + 1).alias("v"))


@Q(f"""WITH {_TWO}, u AS (SELECT *, 0 AS i FROM a UNION ALL SELECT *, 1 AS i FROM b), k AS (SELECT *, row_number() OVER (PARTITION BY pair, time ORDER BY (status = 1) DESC, i) AS n FROM u)
SELECT pair, time, status, round(v, 2) AS v FROM k WHERE n = 1""")
def merge_outer(spark, d):
    return store.merge(list(_two(spark, d))).select("pair", "time", "status", F.round("v", 2).alias("v"))


@Q(f"WITH {_TWO} SELECT pair, time, coalesce(a.status, b.status) AS status, round(coalesce(a.v, b.v), 2) AS v FROM a FULL JOIN b USING (pair, time)")
def combine_first(spark, d):
    a, b = _two(spark, d)
    return store.combine_first(a, b, ["pair", "time"]).withColumn("v", F.round("v", 2))


@Q(f"WITH {_TWO} SELECT pair, time, CASE WHEN status = 1 THEN round(v, 2) END AS v FROM a")
def mask_status(spark, d):
    return _two(spark, d)[0].select("pair", "time", F.when(F.col("status") == 1, F.round("v", 2)).alias("v"))


# ---- sources

_RUNS = GRID + """, rn AS (SELECT receiver, h, v, h - row_number() OVER (PARTITION BY receiver ORDER BY h) AS gr FROM e),
tr AS (SELECT receiver, min(h) AS h0, max(h) AS h1, count(*) AS npts FROM rn GROUP BY receiver, gr)"""


@Q(f"WITH {_RUNS} SELECT receiver, TIMESTAMP '2024-01-01' + to_hours(CAST(h0 AS BIGINT)) AS starttime, CAST(npts AS INTEGER) AS npts FROM tr")
def traces(spark, d):
    return X.traces(spark, d).select("receiver", "starttime", "npts")


@Q(f"""WITH {_RUNS} SELECT receiver, CAST(sum(npts) AS BIGINT) AS npts, CAST(sum(npts) * 3600 AS DOUBLE) AS seconds, count(*) - 1 AS gaps, CAST(0 AS BIGINT) AS overlaps FROM tr GROUP BY 1""")
def duration(spark, d):
    return waveforms.duration(X.traces(spark, d)).select("receiver", "npts", "seconds", "gaps", "overlaps")


@Q(f"WITH {_RUNS} SELECT receiver FROM tr GROUP BY 1 HAVING sum(npts) * 3600 >= 720 * 3600 - 300000")
def max_gap_filter(spark, d):
    return waveforms.check_duration(waveforms.duration(X.traces(spark, d)), N * DELTA, 300_000.0).select("receiver")


@Q(f"""WITH {_RUNS}, s AS (SELECT receiver, gr, CAST(floor(h / 24) AS INTEGER) AS dd, min(h) AS h0, count(*) AS n, sum(v) AS v FROM rn GROUP BY ALL)
SELECT receiver, CAST(DATE '2024-01-01' + dd AS DATE) AS day, CAST(n AS INTEGER) AS npts, round(v, 2) AS total FROM s WHERE n * 3600 >= 7200""")
def slice_days(spark, d):
    return waveforms.slice_days(X.traces(spark, d), 7200.0).select("receiver", "day", "npts", F.round(A.total(F.col("data")), 2).alias("total"))


@Q(f"""WITH {GRID} SELECT receiver, count(*) AS n, round(sum(v), 2) AS total FROM e WHERE h BETWEEN 108 AND 252 GROUP BY 1""")
def get_waveforms(spark, d):
    at = lambda h: F.expr(f"timestamp_ntz'2024-01-{1 + h // 24:02d} {h % 24:02d}:00:00'")
    w = waveforms.get_waveforms(X.traces(spark, d), "%", at(120), at(240), buffer=0.1)
    return w.groupBy("receiver").agg(F.sum("npts").alias("n"), F.round(F.sum(A.total(F.col("data"))), 2).alias("total"))


_DAYS = GRID + ", dy AS (SELECT receiver, CAST(floor(h / 24) AS INTEGER) AS day, count(*) AS n FROM e GROUP BY 1, 2)"
_STATUS = _DAYS + ", av AS (SELECT r.receiver, CAST(t.i AS INTEGER) AS day, CASE WHEN n >= 20 THEN 1 WHEN n > 0 THEN 0 ELSE -1 END AS status FROM r CROSS JOIN range(30) t(i) LEFT JOIN dy ON dy.receiver = r.receiver AND dy.day = t.i)"


def _status(spark, d):
    c = X.cells(spark, d).withColumn("day", F.floor(F.col("h") / 24).cast("int")).withColumn("one", F.lit(1))
    return waveforms.availability(c, c, "receiver", "day", 0, 29, 20, "one")


@Q(f"WITH {_STATUS} SELECT receiver, day, status FROM av")
def availability(spark, d):
    return _status(spark, d)


@Q(f"WITH {_STATUS} SELECT receiver, round(avg(CASE WHEN status = 1 THEN 1.0 ELSE 0.0 END), 6) AS available, count(*) AS n FROM av GROUP BY ROLLUP (receiver)")
def availability_rollup(spark, d):
    return waveforms.availability_rollup(_status(spark, d), "receiver").withColumn("available", F.round("available", 6))


@Q(f"""WITH {_STATUS}, ok AS (SELECT day FROM av WHERE status = 1 GROUP BY 1 HAVING count(DISTINCT receiver) = 5)
SELECT CAST(t.i AS BIGINT) AS time FROM range(30) t(i) WHERE EXISTS (SELECT 1 FROM ok WHERE day BETWEEN t.i - 1 AND t.i + 1)""")
def gating_semi_join(spark, d):
    return waveforms.gating(spark.range(30).withColumnRenamed("id", "time"), _status(spark, d), "day", "receiver", 5, 1, 1)


@Q(f"""WITH {_DAYS}, s AS (SELECT receiver, day, n, 0 AS source FROM dy WHERE day % 2 = 0 UNION ALL SELECT receiver, day, n + 100, 1 FROM dy WHERE day % 3 <> 0 UNION ALL SELECT receiver, day, n + 200, 2 FROM dy),
k AS (SELECT *, coalesce(min(CASE WHEN n % 5 <> 0 THEN source END) OVER (PARTITION BY receiver, day), max(source) OVER (PARTITION BY receiver, day)) AS pick FROM s)
SELECT receiver, day, CAST(n AS BIGINT) AS n, source FROM k WHERE source = pick""")
def source_waterfall(spark, d):
    y = X.cells(spark, d).groupBy("receiver", F.floor(F.col("h") / 24).cast("int").alias("day")).agg(F.count("*").alias("n"))
    sources = [y.where("day % 2 = 0"), y.where("day % 3 <> 0").withColumn("n", F.col("n") + 100), y.withColumn("n", F.col("n") + 200)]
    return waveforms.waterfall(sources, ["receiver", "day"], F.col("n") % 5 != 0).select("receiver", "day", "n", "source")


@Q(f"""WITH {GRID}, s AS (SELECT receiver, h * 7 AS t, v FROM e), gr AS (SELECT r.receiver, CAST(i AS INTEGER) AS step FROM r CROSS JOIN range(500) t(i)),
c AS (SELECT gr.receiver, step, s.v, row_number() OVER (PARTITION BY gr.receiver, step ORDER BY abs(t - step * 10), t) AS i FROM gr JOIN s ON s.receiver = gr.receiver AND abs(s.t - step * 10) * 2 <= 10)
SELECT gr.receiver, gr.step, c.v FROM gr LEFT JOIN c ON c.receiver = gr.receiver AND c.step = gr.step AND c.i = 1""")
def nearest_resample(spark, d):
    s = X.cells(spark, d).select("receiver", (F.col("h") * 7).alias("t"), "v")
    return waveforms.resample_nearest(s, "receiver", "t", "v", 500, 10)


@Q(f"WITH {_STATION} SELECT pair, round(km, 5) AS km FROM sp")
def pair_distance_haversine(spark, d):
    return X.station_pairs(spark, d).select("pair", F.round(geo.haversine_km(*[F.col(c) for c in ("lat_a", "lon_a", "lat_b", "lon_b")]), 5).alias("km"))


@Q()
def pair_distance_geodesic(spark, d):
    return X.station_pairs(spark, d).select("pair", F.round(geo.geodesic_km(*[F.col(c) for c in ("lat_a", "lon_a", "lat_b", "lon_b")]), 5).alias("km"))


@Q(f"""WITH {_STATION}, poi AS (SELECT receiver, 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(lat + 25.887) / 2), 2) + cos(radians(-25.887)) * cos(radians(lat)) * pow(sin(radians(lon + 177.188) / 2), 2)))) AS km FROM st)
SELECT a.receiver || '-' || b.receiver AS pair, round(a.km - b.km, 5) + 0.0 AS km FROM poi a JOIN poi b ON a.receiver < b.receiver""")
def pair_distance_poi(spark, d):
    p = X.station_pairs(spark, d)
    to = lambda a, b: geo.haversine_km(F.lit(-25.887), F.lit(-177.188), F.col(a), F.col(b))
    return p.select("pair", tidy(to("lat_a", "lon_a") - to("lat_b", "lon_b"), 5).alias("km"))


@Q("""WITH st AS (SELECT n_name AS receiver, radians(n_nationkey * 5.0 - 60) AS p, radians(n_nationkey * 13.0 - 150) AS l FROM nation), o AS (SELECT radians(avg(n_nationkey * 5.0 - 60)) AS p0, radians(avg(n_nationkey * 13.0 - 150)) AS l0 FROM nation),
c AS (SELECT *, acos(greatest(-1, least(1, sin(p0) * sin(p) + cos(p0) * cos(p) * cos(l - l0)))) AS c FROM st, o), k AS (SELECT *, CASE WHEN abs(c) < 1e-12 THEN 1.0 ELSE c / sin(c) END AS k FROM c)
SELECT receiver, round(6371.0 * k * cos(p) * sin(l - l0), 4) + 0.0 AS x, round(6371.0 * k * (cos(p0) * sin(p) - sin(p0) * cos(p) * cos(l - l0)), 4) + 0.0 AS y FROM k""")
def station_xy(spark, d):
    s = X.stations(spark, d)
    o = s.agg(F.avg("latitude").alias("lat0"), F.avg("longitude").alias("lon0"))
    x, y = geo.local_xy_km(*[F.col(c) for c in ("latitude", "longitude", "lat0", "lon0")])
    return s.crossJoin(F.broadcast(o)).select("receiver", tidy(x, 4).alias("x"), tidy(y, 4).alias("y"))  # o: one row


# ---- plans

_PLAN = GRID + """, pl AS (SELECT a.receiver || '-' || b.receiver AS pair, a.receiver AS rx_a, b.receiver AS rx_b, CAST(t.i * 24 AS INTEGER) AS start, t.i * 24 + 60e0 AS time FROM r a JOIN r b ON a.receiver < b.receiver CROSS JOIN range(26) t(i)),
wn AS (SELECT receiver, CAST(t.i * 24 AS INTEGER) AS start, count(*) >= 113 AS complete FROM e JOIN range(26) t(i) ON e.h >= t.i * 24 AND e.h < t.i * 24 + 120 GROUP BY 1, 2),
ps AS (SELECT pl.*, CASE WHEN a.complete AND b.complete THEN 1 ELSE -1 END AS status FROM pl LEFT JOIN wn a ON a.receiver = rx_a AND a.start = pl.start LEFT JOIN wn b ON b.receiver = rx_b AND b.start = pl.start)"""


def _plan(spark, d):
    return correlation.init(X.cells(spark, d), "receiver", 0, N, 120, 24)


def _windows(spark, d):
    """Windows of 120 h each 24 h; complete with events in 113 of its hours, absent hours are 0."""
    g = X.grid(spark, d, None)
    w = correlation.windows(g, "receiver", "h", "v", 0, N, 120, 24)
    return w.withColumn("complete", F.size(F.filter("x", lambda v: v.isNotNull())) >= 113).withColumn("x", F.transform("x", lambda v: F.coalesce(v, F.lit(0.0))))


def _processed(spark, d):
    return correlation.process(_plan(spark, d), _windows(spark, d), "receiver", 120, (-24, 24))


@Q(f"WITH {_PLAN} SELECT pair, start, CAST(time AS DOUBLE) AS time, 0 AS status FROM pl")
def init_plan(spark, d):
    return _plan(spark, d).select("pair", "start", F.col("time").cast("double").alias("time"), "status")


@Q(f"""WITH {_PLAN} SELECT pair, ps.start, a.h - b.h AS lag, round(sum(a.v * b.v), 4) + 0.0 AS cc FROM ps JOIN g a ON a.receiver = rx_a AND a.h >= ps.start AND a.h < ps.start + 120
JOIN g b ON b.receiver = rx_b AND b.h >= ps.start AND b.h < ps.start + 120 AND abs(a.h - b.h) <= 24 WHERE status = 1 GROUP BY ALL""")
def process_windows(spark, d):
    p = _processed(spark, d).where("status = 1")
    return correlate.to_long(p, ["pair", "start"], "cc", "lag", "cc", -24).withColumn("cc", tidy(F.col("cc"), 4))


@Q(f"WITH {_PLAN} SELECT pair, start, status FROM ps")
def process_status(spark, d):
    return _processed(spark, d).select("pair", "start", "status")


@Q(f"WITH {_PLAN} SELECT pair, start FROM ps WHERE status <> 1")
def retry_missing(spark, d):
    return correlation.retry(_processed(spark, d), _plan(spark, d), True).select("pair", "start")


@Q(f"WITH {_PLAN} SELECT pair, start FROM pl WHERE start >= 240")
def resume_anti_join(spark, d):
    p = _plan(spark, d)
    return correlation.retry(p.where("start < 240").withColumn("status", F.lit(1)), p).select("pair", "start")


@Q(f"""WITH {_PLAN}, f AS (SELECT receiver, CAST(t.i * 24 AS INTEGER) AS start, min(h) AS h0 FROM e JOIN range(26) t(i) ON e.h >= t.i * 24 AND e.h < t.i * 24 + 120 GROUP BY 1, 2)
SELECT pair, pl.start, (a.h0 - b.h0) * 3600e0 AS pair_offset, a.h0 * 3600e0 + 216000 - time * 3600 AS time_offset, -((a.h0 - b.h0) * 3600e0 + a.h0 * 3600e0 + 216000 - time * 3600) + 0.0 AS delay
FROM pl JOIN f a ON a.receiver = rx_a AND a.start = pl.start JOIN f b ON b.receiver = rx_b AND b.start = pl.start""")
def pair_offsets(spark, d):
    c = X.cells(spark, d)
    sent = c.select("receiver", "h", F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col("h") - 119) / 24).cast("int")), F.least(F.lit(25), F.floor(F.col("h") / 24).cast("int")))).alias("i"))
    f = sent.groupBy("receiver", (F.col("i") * 24).alias("start")).agg((F.min("h") * DELTA).alias("t0"))
    a = f.select(F.col("receiver").alias("rx_a"), "start", F.col("t0").alias("ta"))
    b = f.select(F.col("receiver").alias("rx_b"), "start", F.col("t0").alias("tb"))
    j = _plan(spark, d).join(a, ["rx_a", "start"]).join(b, ["rx_b", "start"])
    o = correlation.offsets(F.col("ta"), F.col("tb"), 120 * DELTA, F.col("time") * DELTA)
    return j.select("pair", "start", o.alias("o")).select("pair", "start", "o.pair_offset", "o.time_offset", (F.col("o.delay") + 0.0).alias("delay"))


@Q(f"WITH {GRID} SELECT receiver, CAST(floor(h / 12) * 12 + 6 AS DOUBLE) AS centre, 'V' AS band, round(sqrt(avg(v * v)), 5) AS rms FROM g GROUP BY ALL")
def running_rms(spark, d):
    w = waveforms.running_rms(X.grid(spark, d), "receiver", "h", "v", 12)
    return w.select("receiver", F.col("centre").cast("double").alias("centre"), "band", F.round("rms", 5).alias("rms"))


# ---- waveform operations

@Q(f"""WITH {GRID}, k AS (SELECT *, lead(h) OVER w AS h2, lead(v) OVER w AS v2 FROM e WINDOW w AS (PARTITION BY receiver ORDER BY h)), x AS (SELECT *, unnest(range(0, coalesce(h2 - h, 1))) AS i FROM k)
SELECT receiver, CAST(h + i AS INTEGER) AS h, round(CASE WHEN i = 0 THEN v ELSE v + (v2 - v) * i / (h2 - h) END, 5) AS v FROM x""")
def op_merge(spark, d):
    c = X.cells(spark, d).select("receiver", "h", "v")
    return waveforms.merge(c.unionByName(c.where("h % 2 = 0")), "receiver", "h", "v").select("receiver", "h", F.round("v", 5).alias("v"))


@Q(f"WITH {VECTORS} SELECT vec_id, k - 8 AS k, round(v, 6) + 0.0 AS v FROM v WHERE k >= 8 AND k < 40")
def op_trim(spark, d):
    x = X.vectors(spark, d).select("vec_id", waveforms.trim(F.col("x"), 8, 32).alias("x"))
    return correlate.to_long(x, ["vec_id"], "x").select("vec_id", "k", tidy(F.col("v"), 6).alias("v"))


@Q(f"WITH {_IDS_SQL} SELECT receiver FROM ids WHERE receiver LIKE '%.BH_'")
def op_select(spark, d):
    return _ids(spark).where(F.col("receiver").like("%.BH_"))


@Q(f"""WITH {VECTORS}, n AS (SELECT vec_id, k, v AS n FROM v), p AS (SELECT vec_id, label, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS nx FROM (SELECT DISTINCT vec_id, label FROM v))
SELECT p.vec_id, a.k, round(-a.n * cos(radians(30.0)) - b.n * sin(radians(30.0)), 6) + 0.0 AS r, round(a.n * sin(radians(30.0)) - b.n * cos(radians(30.0)), 6) + 0.0 AS t FROM p JOIN n a ON a.vec_id = p.vec_id JOIN n b ON b.vec_id = p.nx AND b.k = a.k""")
def op_rotate(spark, d):
    r, t = waveforms.rotate(F.col("x"), F.col("y"), F.lit(30.0))
    p = X.vector_pairs(spark, d).select("vec_id", F.posexplode(F.arrays_zip(r.alias("r"), t.alias("t"))).alias("k", "p"))
    return p.select("vec_id", "k", tidy(F.col("p.r"), 6).alias("r"), tidy(F.col("p.t"), 6).alias("t"))


@Q(f"WITH {VECTORS} SELECT vec_id, k // 4 AS k, round(v, 6) + 0.0 AS v FROM v WHERE k % 4 = 0")
def op_decimate(spark, d):
    x = waveforms.apply_operations(X.vectors(spark, d).select("vec_id", "x"), "x", [("decimate", {"factor": 4, "lowpass": False}), ("unknown", {})])
    return correlate.to_long(x, ["vec_id"], "x").select("vec_id", F.col("k").cast("long").alias("k"), tidy(F.col("v"), 6).alias("v"))


@Q()
def op_decimate_lowpass(spark, d):
    x = waveforms.apply_operations(X.vectors(spark, d).select("vec_id", "x"), "x", [("decimate", {"factor": 4})])
    return correlate.to_long(x, ["vec_id"], "x").select("vec_id", F.col("k").cast("long").alias("k"), tidy(F.col("v"), 6).alias("v"))


@Q(f"""WITH {VECTORS}, w AS (SELECT *, lead(v) OVER (PARTITION BY vec_id ORDER BY k) AS nv FROM v)
SELECT vec_id, CAST(k * 4 + i AS INTEGER) AS k, round(v + (coalesce(nv, v) - v) * i / 4, 6) + 0.0 AS v FROM w, range(4) t(i) WHERE k < 63 OR i = 0""")
def op_interpolate(spark, d):
    x = waveforms.apply_operations(X.vectors(spark, d).select("vec_id", "x"), "x", [("interpolate", {"factor": 4})])
    return correlate.to_long(x, ["vec_id"], "x").select("vec_id", "k", tidy(F.col("v"), 6).alias("v"))


@Q()
def op_interpolate_lanczos(spark, d):
    op = ("interpolate", {"sampling_rate": 4 / DELTA, "delta": DELTA, "method": "lanczos", "a": 20})
    x = waveforms.apply_operations(X.vectors(spark, d).select("vec_id", "x"), "x", [op])
    return correlate.to_long(x, ["vec_id"], "x").select("vec_id", "k", tidy(F.col("v"), 6).alias("v"))


@Q(f"WITH {VECTORS}, c AS (SELECT vec_id, k, 2 * (v - avg(v) OVER (PARTITION BY vec_id)) AS v FROM v) SELECT vec_id, k, round(v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)), 6) + 0.0 AS v FROM c")
def op_chain_callable(spark, d):
    ops = [("demean", {}), lambda x: F.transform(x, lambda v: v * 2), ("normalize", {})]
    x = waveforms.apply_operations(X.vectors(spark, d).select("vec_id", "x"), "x", ops, strict=True)
    return correlate.to_long(x, ["vec_id"], "x").select("vec_id", "k", tidy(F.col("v"), 6).alias("v"))


@Q()
def op_resample(spark, d):
    x = waveforms.apply_operations(X.vectors(spark, d).select("vec_id", "x"), "x", [("resample", {"n": 32})])
    return correlate.to_long(x, ["vec_id"], "x").select("vec_id", "k", tidy(F.col("v"), 6).alias("v"))


@Q()
def op_remove_response(spark, d):
    x = waveforms.spectral_division(F.col("x"), DELTA, [0.0], [-1e-4 + 1e-4j, -1e-4 - 1e-4j], 2.0)
    return correlate.to_long(X.series(spark, d).select("receiver", x.alias("x")), ["receiver"], "x", "h").select("receiver", "h", tidy(F.col("v"), 3).alias("v"))


@Q(f"WITH {VECTORS} SELECT vec_id, k, round(v / 4, 6) + 0.0 AS v FROM v")
def op_remove_sensitivity(spark, d):
    x = waveforms.apply_operations(X.vectors(spark, d).select("vec_id", "x"), "x", [("remove_sensitivity", {"gain": 4})])
    return correlate.to_long(x, ["vec_id"], "x").select("vec_id", "k", tidy(F.col("v"), 6).alias("v"))


# ---- operations on streams

def _station(spark, d, gaps: bool = False):
    """Clicks, views and errors as the components 1, 2 and Z of a station; whole, or in runs with gaps."""
    channel = F.create_map(*[F.lit(v) for k in (("click", "BH1"), ("view", "BH2"), ("error", "BHZ")) for v in k])[F.col("receiver")]
    named = F.concat(F.lit("XX.STA.00."), channel)
    rows = X.traces(spark, d) if gaps else _whole(spark, d)
    return rows.withColumn("receiver", named).where("receiver is not null")


def _whole(spark, d):
    start = F.expr(f"timestamp_ntz'{X.ORIGIN}'")
    return X.series(spark, d).select("receiver", start.alias("starttime"), F.lit(DELTA).alias("delta"), F.size("x").alias("npts"), F.col("x").alias("data"))


def _inventory(spark):
    rows = [("XX.STA.00.BH1", 30.0, 0.0), ("XX.STA.00.BH2", 120.0, 0.0), ("XX.STA.00.BHZ", 0.0, -90.0)]
    return spark.createDataFrame(rows, "receiver string, azimuth double, dip double")


def _trace_long(t, digits, step="h"):
    hour = F.floor(times.seconds(F.expr(f"timestamp_ntz'{X.ORIGIN}'"), F.col("starttime")) / F.col("delta")).cast("int")
    x = t.select("receiver", hour.alias("_0"), F.posexplode("data").alias("_k", "v"))
    return x.select("receiver", (F.col("_0") + F.col("_k")).alias(step), tidy(F.col("v"), digits).alias("v"))


@Q()
def op_stream_merge(spark, d):
    return _trace_long(operations.process(X.traces(spark, d), [("merge", {"method": 1, "fill_value": "interpolate"})]), 5)


@Q()
def op_stream_running_rms(spark, d):
    t = operations.process(_whole(spark, d), [("running_rms", {"window": 7 * DELTA})])
    x = t.select("receiver", "starttime", "delta", F.posexplode("data").alias("k", "v"))
    return x.select("receiver", "k", waveforms.after(F.col("starttime"), F.col("k") * F.col("delta")).alias("time"), F.round("v", 5).alias("rms"))


@Q()
def op_stream_rotate(spark, d):
    ops = [("rotate", {"method": "->ZNE"}), ("rotate", {"method": "NE->RT", "back_azimuth": 250.39}), ("select", {"channel": "BH?"})]
    return _trace_long(operations.process(_station(spark, d), ops, inventory=_inventory(spark)), 5)


@Q()
def op_stream_response(spark, d):
    t = _whole(spark, d)
    inventory = t.select("receiver", F.array(F.lit(0.0), F.lit(0.0)).alias("zeros"), F.array(*[F.lit(v) for v in (-1e-4, 1e-4, -1e-4, -1e-4)]).alias("poles"), F.lit(2.0).alias("gain"))
    return _trace_long(operations.process(t, [("attach_response", {}), ("remove_response", {"output": "VEL"})], inventory=inventory), 3)


@Q()
def op_process_recipe(spark, d):
    """A recipe as correlation runs use it: merged, filtered, rotated, resampled, trimmed and tapered."""
    ops = [
        ("merge", {"method": 1, "fill_value": "interpolate", "interpolation_samples": 0}), ("detrend", {"type": "demean"}), ("trim", {}),
        ("filter", {"type": "highpass", "freq": 0.05 / DELTA}), ("rotate", {"method": "->ZNE"}), ("rotate", {"method": "NE->RT", "back_azimuth": 250.39}),
        ("select", {"channel": "BHR"}), ("interpolate", {"sampling_rate": 2 / DELTA, "method": "lanczos", "a": 20}), ("filter", {"type": "lowpass", "freq": 0.4 / DELTA}),
        ("detrend", {"type": "demean"}), ("taper", {"type": "cosine", "max_percentage": 0.05, "max_length": 30.0 * DELTA}),
    ]
    at = lambda h: waveforms.after(F.expr(f"timestamp_ntz'{X.ORIGIN}'"), F.lit(h * DELTA))
    t = operations.process(_station(spark, d, True), ops, starttime=at(24), endtime=at(695), inventory=_inventory(spark), strict=True)
    return t.select("receiver", F.posexplode("data").alias("k", "v")).select("receiver", "k", tidy(F.col("v"), 4).alias("v"))


@Q()
def window_types(spark, d):
    kinds = list(A.RAMPS)
    one = spark.range(1).select(F.posexplode(F.arrays_zip(*[A.window(F.lit(64), kind=c, max_length=6.0).alias(c) for c in kinds])).alias("k", "w"))
    return one.select("k", *[tidy(F.col(f"w.{c}"), 8).alias(c) for c in kinds])
