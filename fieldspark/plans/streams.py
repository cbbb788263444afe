"""Queries of the streaming operators: the event and part tables read as streams, results written and read back."""

from pyspark.sql import functions as F

from ..operators.common import scratch
from ..streaming import streams
from . import spatial  # noqa: F401  the SQL of its queries
from .base import ORACLES, query
from .meshes import parts_mesh
from .views import table, view, with_views


def _stream(spark, d, name):
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parquet*")


def _base(spark):
    return scratch(spark, "stream")


def _drain(spark, df, mode="append", path=None):
    """Run a stream over what is there into a Parquet table and read that in the caller's session."""
    path = path or _base(spark)
    df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", path + "/log").option("path", path + "/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(path + "/out")


def _drain_batches(spark, events, enrich):
    """As _drain, for an enrichment that is run on micro-batches."""
    path = _base(spark)
    streams.enrich_batches(events, enrich, path + "/out", path + "/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path + "/out").drop("batch")


@query(with_views(["pts2", "boxes2"], "SELECT id, box_id FROM pts2 JOIN boxes2 ON x >= x_lo AND x <= x_hi AND y >= y_lo AND y <= y_hi"))
def str1_stream_boxes(spark, d):
    pts = _stream(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), (F.round(F.col("p_retailprice") * 10) - 9000).alias("y"))
    boxes = view(spark, d, "boxes2")

    def enrich(batch):
        got = streams.enrich_with_boxes(batch, ["x", "y"], boxes, ["x_lo", "y_lo"], ["x_hi", "y_hi"], [5.0, 60.0])
        return got.select(F.col("l_id").alias("id"), F.col("r_box_id").alias("box_id"))

    return _drain_batches(spark, pts, enrich)


def _part_places(spark, d):
    return _stream(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), (F.round(F.col("p_retailprice") * 10) - 9000).alias("y"))


@query(ORACLES["jns5_points_in_ellipsoids"])
def str1_stream_ellipsoids(spark, d):
    ellipsoids = view(spark, d, "ell2")

    def enrich(batch):
        got = streams.enrich_with_ellipsoids(batch, ["x", "y"], ellipsoids, ["mx", "my"], [["sxx", "sxy"], ["sxy", "syy"]], 2.0)
        return got.select(F.col("l_id").alias("id"), F.col("r_ell_id").alias("ell_id"))

    return _drain_batches(spark, _part_places(spark, d), enrich)


@query(ORACLES["loc1_locate"])
def str1_stream_cells(spark, d):
    """The mesh cell of each part, as in the batch form."""
    _, _, maps = parts_mesh(spark)
    places = _part_places(spark, d).withColumn("x", F.col("x") + F.when(F.col("id") % 7 == 0, 40.0).otherwise(0.0))
    got = streams.enrich_with_cells(places, ["x", "y"], maps, [3.0, 60.0], 1e-12)
    return _drain(spark, got.select("id", "cell_id"))


def _events(spark, d):
    return _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT CAST(floor(epoch(ts)/21600)*21600 AS BIGINT) AS start, count(*) AS n, min(value) AS lo_value, max(value) AS hi_value FROM events GROUP BY 1 HAVING start + 21600 <= (SELECT max(epoch(ts)) - 3600 FROM events)")
def str2_windowed_boxes(spark, d):
    got = streams.windowed_boxes(_events(spark, d), ["value"], "6 hours", "1 hour")
    return _drain(spark, got).select(F.unix_timestamp("w.start").alias("start"), "n", "lo_value", "hi_value")


@query("""WITH e AS (SELECT epoch(ts) AS t, value FROM events), w AS (SELECT CAST(floor(t/7200)*7200 - 7200*k AS BIGINT) AS start, value FROM e, range(3) r(k))
    SELECT start, count(*) AS n, min(value) AS lo_value, max(value) AS hi_value FROM w GROUP BY 1 HAVING start + 21600 <= (SELECT max(t) - 3600 FROM e)""")
def str2_sliding_boxes(spark, d):
    """Windows of six hours that start every two."""
    got = streams.windowed_boxes(_events(spark, d), ["value"], "6 hours", "1 hour", slide="2 hours")
    return _drain(spark, got).select(F.unix_timestamp("w.start").alias("start"), "n", "lo_value", "hi_value")


@query("""WITH e AS (SELECT user_id, ts, value, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 43200 THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM e)
    SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n, min(value) AS lo_value, max(value) AS hi_value FROM s GROUP BY user_id, no
    HAVING epoch(max(ts)) + 43200 <= (SELECT max(epoch(ts)) - 3600 FROM events)""")
def str2_session_boxes(spark, d):
    """Sessions of a user: events less than twelve hours apart."""
    got = streams.session_boxes(_events(spark, d), ["value"], "12 hours", "1 hour", "user_id")
    return _drain(spark, got).select("user_id", F.unix_timestamp("w.start").alias("start"), "n", "lo_value", "hi_value")


def _with_timers(spark):
    """A session of its own with the state store that keyed state and timers need; the caller's stays as it is."""
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.adaptive.enabled"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


@query(with_views(["series"], "SELECT series_id, min(k) AS first FROM series WHERE y < 500 GROUP BY 1"))
def str3_first_crossings(spark, d):
    """The series are numbered by the batch view; the stream is that table, written once."""
    path = _base(spark)
    view(spark, d, "series").select("series_id", F.col("k").cast("long").alias("k"), "y").write.parquet(path)
    stream = _with_timers(spark).readStream.schema("series_id " + dict(view(spark, d, "series").dtypes)["series_id"] + ", k long, y double").parquet(path)
    return _drain(spark, streams.first_crossings(stream, 500.0), path=_base(spark))


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS t, value FROM events),
    f AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < 43200000000 THEN 0 ELSE 1 END AS fresh FROM e),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS no FROM f)
    SELECT user_id, min(t) AS start, max(t) AS "end", coalesce(min(t) FILTER (WHERE value < 5), -1) AS first FROM s GROUP BY user_id, no
    HAVING (max(t) + 43200000000)//1000 < (SELECT max(t)//1000 - 3600000 FROM e)""")
def str3_crossing_episodes(spark, d):
    """The first value under 5 (-1: none) in each episode of a user: events less than twelve hours apart."""
    got = streams.crossing_episodes(_events(_with_timers(spark), d), 5.0, 43200, "1 hour", key="user_id", y="value")
    return _drain(spark, got, path=_base(spark)).withColumn("first", F.coalesce("first", F.lit(-1)))


@query(with_views(["pts2", "balls2"], """SELECT q, id, dsq, CAST(rank AS INT) AS rank FROM (SELECT p.id AS q, ball_id AS id, (x-cx)**2+(y-cy)**2 AS dsq,
    row_number() OVER (PARTITION BY p.id ORDER BY (x-cx)**2+(y-cy)**2, ball_id) AS rank FROM pts2 p, balls2) WHERE rank <= 2"""))
def str4_nearest_sites(spark, d):
    pts = _stream(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), (F.round(F.col("p_retailprice") * 10) - 9000).alias("y"))
    sites = view(spark, d, "balls2").select(F.col("ball_id").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    path = _base(spark)
    streams.nearest_sites(pts, sites, ["x", "y"], 2, path + "/out", path + "/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path + "/out").drop("batch")
