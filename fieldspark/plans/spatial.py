"""Queries of the spatial joins, nearest neighbours, aggregations and orderings."""

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators import aggregates, clusters, knn, ordering, spatial
from .base import query
from .views import recursive, table, view, with_views

LO, HI = ["x_lo", "y_lo"], ["x_hi", "y_hi"]


def _tree(size):
    """A table expression t: every point in every cluster (c, of n points) that halving along the widest axis makes."""
    return f""", t AS (SELECT id, x, y, CAST(1 AS BIGINT) AS c, (SELECT count(*) FROM pts2) AS n FROM pts2 UNION ALL
        SELECT id, x, y, 2*c + CAST(r > n//2 AS BIGINT), CASE WHEN r > n//2 THEN n - n//2 ELSE n//2 END FROM
        (SELECT *, row_number() OVER (PARTITION BY c ORDER BY CASE WHEN dx >= dy THEN x ELSE y END, id) AS r FROM
        (SELECT *, max(x) OVER (PARTITION BY c) - min(x) OVER (PARTITION BY c) AS dx, max(y) OVER (PARTITION BY c) - min(y) OVER (PARTITION BY c) AS dy FROM t WHERE n > {size})))"""


@query(with_views(["pts2"], "SELECT id, x, y FROM pts2 WHERE x BETWEEN 10 AND 30 AND y BETWEEN 100 AND 600"))
def prj1_points_in_box(spark, d):
    return view(spark, d, "pts2").where(geo.in_box([F.col("x"), F.col("y")], [10.0, 100.0], [30.0, 600.0]))


_ELL = "SELECT id FROM pts2 WHERE (x-25)*(x-25)/50.0 + (y-500)*(y-500)/20000.0 {op} 1.99*1.99"


@query(with_views(["pts2"], _ELL.format(op="<=")))
def prj2_points_in_ellipsoid(spark, d):
    return view(spark, d, "pts2").where(geo.in_ellipsoid([F.col("x"), F.col("y")], [25.0, 500.0], [[50.0, 0.0], [0.0, 20000.0]], 1.99)).select("id")


@query(with_views(["pts2"], _ELL.format(op="<")))
def prj3_points_strictly_in_ellipsoid(spark, d):
    return view(spark, d, "pts2").where(geo.in_ellipsoid([F.col("x"), F.col("y")], [25.0, 500.0], [[50.0, 0.0], [0.0, 20000.0]], 1.99, inclusive=False)).select("id")


@query(with_views(["ell2"], "SELECT ell_id, mx-2*sqrt(sxx) AS x_lo, mx+2*sqrt(sxx) AS x_hi, my-2*sqrt(syy) AS y_lo, my+2*sqrt(syy) AS y_hi FROM ell2"))
def prj4_ellipsoid_boxes(spark, d):
    lo, hi = geo.ellipsoid_box(F.array("mx", "my"), F.array("sxx", "syy"), 2.0)
    return view(spark, d, "ell2").select("ell_id", lo[0].alias("x_lo"), hi[0].alias("x_hi"), lo[1].alias("y_lo"), hi[1].alias("y_hi"))


@query(with_views(["boxes2"], """SELECT box_id, floor((x_lo-0.5)/2)*2+0.5 AS a0, ceil((x_hi-0.5)/2)*2+0.5 AS b0, floor((y_lo-0.25)/4)*4+0.25 AS a1, ceil((y_hi-0.25)/4)*4+0.25 AS b1,
    CAST(ceil((x_hi-0.5)/2)-floor((x_lo-0.5)/2)+1 AS BIGINT) AS n0, CAST(ceil((y_hi-0.25)/4)-floor((y_lo-0.25)/4)+1 AS BIGINT) AS n1 FROM boxes2"""))
def prj5_conforming_boxes(spark, d):
    c = F.col
    lo, hi, n = geo.conforming_box([c("x_lo"), c("y_lo")], [c("x_hi"), c("y_hi")], [0.5, 0.25], [2.0, 4.0])
    return view(spark, d, "boxes2").select("box_id", *(x.alias(f"{k}{i}") for k, xs in (("a", lo), ("b", hi), ("n", n)) for i, x in enumerate(xs)))


@query(with_views(["boxes2"], """SELECT box_id, sqrt((x_hi-x_lo-3*round((x_hi-x_lo)/3))**2 + (y_hi-y_lo-10*round((y_hi-y_lo)/10))**2) < 1e-10 AS divisible,
    sqrt((x_hi-x_lo-4)**2 + (y_hi-y_lo-60)**2) < 1e-10 AS same_spacing, sqrt((x_lo-2*round(x_lo/2))**2 + (y_lo-5*round(y_lo/5))**2) < 1e-10 AS unshifted FROM boxes2"""))
def prj6_conformity(spark, d):
    c = F.col
    w = [c("x_hi") - c("x_lo"), c("y_hi") - c("y_lo")]
    return view(spark, d, "boxes2").select("box_id", geo.divisible(w, [3.0, 10.0]).alias("divisible"), geo.same_spacing(w, [4.0, 60.0]).alias("same_spacing"), geo.unshifted([c("x_lo"), c("y_lo")], [0.0, 0.0], [2.0, 5.0]).alias("unshifted"))


@query(with_views(["pts2"], "SELECT CAST(round_even(x/4, 0) AS BIGINT) AS i, CAST(round_even(y/40, 0) AS BIGINT) AS j, count(*) AS n FROM pts2 GROUP BY 1, 2"))
def prj7_heat_map(spark, d):
    return view(spark, d, "pts2").groupBy(geo.nearest_index(F.col("x"), 0.0, 4.0).alias("i"), geo.nearest_index(F.col("y"), 0.0, 40.0).alias("j")).agg(F.count(F.lit(1)).alias("n"))


@query(with_views(["boxes2"], """SELECT box_id, CASE WHEN x_hi-x_lo >= y_hi-y_lo THEN 0 ELSE 1 END AS widest, CASE WHEN x_hi-x_lo <= y_hi-y_lo THEN 0 ELSE 1 END AS narrowest,
    round(sqrt((x_hi-x_lo)**2+(y_hi-y_lo)**2), 9) AS diameter, round(sqrt(greatest(x_lo-20, 10-x_hi, 0)**2 + greatest(y_lo-300, 200-y_hi, 0)**2), 9) AS distance FROM boxes2"""))
def prj8_box_attributes(spark, d):
    lo, hi = F.array("x_lo", "y_lo"), F.array("x_hi", "y_hi")
    a, b = F.array(F.lit(10.0), F.lit(200.0)), F.array(F.lit(20.0), F.lit(300.0))
    return view(spark, d, "boxes2").select("box_id", geo.widest_axis(lo, hi).alias("widest"), geo.narrowest_axis(lo, hi).alias("narrowest"), F.round(geo.diameter(lo, hi), 9).alias("diameter"), F.round(geo.box_distance(lo, hi, a, b), 9).alias("distance"))


@query("SELECT p_partkey, p_size >= 20 AND p_size+10 <= 40 AS subset, greatest(p_size, 20) < least(p_size+10, 40) AS meets, 25 >= p_size AND 25 < p_size+10 AS has25, CAST(10 AS INT) AS size FROM part")
def prj9_index_ranges(spark, d):
    a, b = F.col("p_size"), F.col("p_size") + 10
    return table(spark, d, "part").select("p_partkey", geo.range_subset(a, b, F.lit(20), F.lit(40)).alias("subset"), geo.ranges_meet(a, b, F.lit(20), F.lit(40)).alias("meets"), geo.range_contains(a, b, F.lit(25)).alias("has25"), geo.range_size(a, b).alias("size"))


@query(with_views(["pts2", "boxes2"], "SELECT id, box_id FROM pts2 JOIN boxes2 ON x >= x_lo AND x <= x_hi AND y >= y_lo AND y <= y_hi"))
def jns1_points_in_boxes(spark, d):
    return spatial.points_in_boxes(view(spark, d, "pts2"), ["x", "y"], view(spark, d, "boxes2"), LO, HI).select(F.col("l_id").alias("id"), F.col("r_box_id").alias("box_id"))


@query(with_views(["pts2", "boxes2"], "SELECT box_id, id FROM pts2 JOIN boxes2 ON x >= x_lo AND x < x_hi AND y >= y_lo AND y < y_hi"))
def jns2_boxes_half_open(spark, d):
    return spatial.points_in_boxes(view(spark, d, "pts2"), ["x", "y"], view(spark, d, "boxes2"), LO, HI, closed="left").select(F.col("r_box_id").alias("box_id"), F.col("l_id").alias("id"))


@query(with_views(["boxes2"], "SELECT a.box_id AS a, b.box_id AS b FROM boxes2 a JOIN boxes2 b ON a.box_id < b.box_id AND a.x_lo <= b.x_hi AND b.x_lo <= a.x_hi AND a.y_lo <= b.y_hi AND b.y_lo <= a.y_hi"))
def jns3_box_overlaps(spark, d):
    b = view(spark, d, "boxes2")
    return spatial.boxes_overlap(b, b, LO, HI).where("l_box_id < r_box_id").select(F.col("l_box_id").alias("a"), F.col("r_box_id").alias("b"))


@query(with_views(["balls2", "boxes2"], """SELECT ball_id, box_id FROM balls2 JOIN boxes2 ON
    (cx-greatest(least(cx,x_hi),x_lo))**2 + (cy-greatest(least(cy,y_hi),y_lo))**2 <= r*r"""))
def jns4_balls_meet_boxes(spark, d):
    return spatial.balls_meet_boxes(view(spark, d, "balls2"), ["cx", "cy"], "r", view(spark, d, "boxes2"), LO, HI).select(F.col("l_ball_id").alias("ball_id"), F.col("r_box_id").alias("box_id"))


@query(with_views(["pts2", "ell2"], "SELECT id, ell_id FROM pts2 JOIN ell2 ON (x-mx)**2*syy - 2*(x-mx)*(y-my)*sxy + (y-my)**2*sxx <= 4*(sxx*syy-sxy*sxy)"))
def jns5_points_in_ellipsoids(spark, d):
    got = spatial.points_in_ellipsoids(view(spark, d, "pts2"), ["x", "y"], view(spark, d, "ell2"), ["mx", "my"], [["sxx", "sxy"], ["sxy", "syy"]], 2.0)
    return got.select(F.col("l_id").alias("id"), F.col("r_ell_id").alias("ell_id"))


@query(with_views(["pts2"], """SELECT q, id, dsq, CAST(rank AS INT) AS rank FROM (SELECT a.id AS q, b.id AS id, (a.x-b.x)**2+(a.y-b.y)**2 AS dsq,
    row_number() OVER (PARTITION BY a.id ORDER BY (a.x-b.x)**2+(a.y-b.y)**2, b.id) AS rank FROM pts2 a, pts2 b) WHERE rank <= 3"""))
def jns7_nearest_points(spark, d):
    p = view(spark, d, "pts2")
    return knn.nearest(p, p, ["x", "y"], 3)


@query(with_views(["vecs"], """, n AS (SELECT a.id AS q, b.id AS id, list_distance(CAST(a.p AS DOUBLE[]), CAST(b.p AS DOUBLE[]))**2 AS dsq
    FROM vecs a, vecs b WHERE a.id % 50 = 0) SELECT q, id, round(dsq, 6) AS dsq, CAST(rank AS INT) AS rank FROM
    (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dsq, id) AS rank FROM n) WHERE rank <= 10"""))
def jns7_nearest_vectors(spark, d):
    v = view(spark, d, "vecs")
    return knn.nearest_vectors(v, v.where("id % 50 = 0"), 10).withColumn("dsq", F.round("dsq", 6))


@query("""WITH r AS (SELECT DISTINCT s_nationkey AS p, l_partkey AS i FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
    SELECT a.p AS a, b.p AS b, count(*) AS n, min(a.i) AS first FROM r a JOIN r b ON a.i = b.i AND a.p < b.p GROUP BY 1, 2""")
def jns9_patch_overlaps(spark, d):
    from ..operators.matrix import patch_overlaps

    rows = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("patch_id"), F.col("l_partkey").alias("i")).distinct()
    return patch_overlaps(rows).select("a", "b", F.size("shared").cast("long").alias("n"), F.get("shared", F.lit(0)).alias("first"))


@query(with_views(["ell2"], """, p AS (SELECT a.ell_id AS a, b.ell_id AS b, a.mx-b.mx AS dx, a.my-b.my AS dy, a.sxx AS axx, a.sxy AS axy, a.syy AS ayy, b.sxx AS bxx, b.sxy AS bxy, b.syy AS byy
        FROM ell2 a JOIN ell2 b ON a.ell_id < b.ell_id AND abs(a.mx-b.mx) <= 2*(sqrt(a.sxx)+sqrt(b.sxx)) AND abs(a.my-b.my) <= 2*(sqrt(a.syy)+sqrt(b.syy))),
    m AS (SELECT a, b, dx, dy, s, (1-s)*axx+s*bxx AS xx, (1-s)*axy+s*bxy AS xy, (1-s)*ayy+s*byy AS yy FROM p, (SELECT unnest(range(1001))/1000.0::DOUBLE AS s))
    SELECT a, b FROM m GROUP BY 1, 2 HAVING min(1 - s*(1-s)/4*(dx*dx*yy - 2*dx*dy*xy + dy*dy*xx)/(xx*yy-xy*xy)) >= 0"""))
def jns8_ellipsoid_pairs(spark, d):
    e = view(spark, d, "ell2").select("ell_id", F.array("mx", "my").alias("mu"), F.array(F.array("sxx", "sxy"), F.array("sxy", "syy")).alias("sigma"))
    return clusters.ellipsoid_pairs(e, 2.0)


@query(recursive(["pts2"], _tree(128) + """, k AS (SELECT c, n <= 128 AS leaf, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM t GROUP BY c, n),
    p AS (SELECT CAST(1 AS BIGINT) AS row, CAST(1 AS BIGINT) AS col, CAST(NULL AS VARCHAR) AS kind, 0 AS step UNION ALL
        SELECT r, c, CASE WHEN step = 0 THEN kind END, 1 - step FROM (
            SELECT p.row AS r, p.col AS c, 0 AS step, CASE WHEN sqrt(greatest(a.x0-b.x1, b.x0-a.x1, 0)**2 + greatest(a.y0-b.y1, b.y0-a.y1, 0)**2)
                >= least(sqrt((a.x1-a.x0)**2+(a.y1-a.y0)**2), sqrt((b.x1-b.x0)**2+(b.y1-b.y0)**2)) THEN 'far' WHEN a.leaf AND b.leaf THEN 'near' ELSE 'open' END AS kind
                FROM p JOIN k a ON a.c = p.row JOIN k b ON b.c = p.col WHERE p.step = 0
            UNION ALL SELECT CASE WHEN a.leaf THEN p.row ELSE 2*p.row + e END, CASE WHEN b.leaf THEN p.col ELSE 2*p.col + f END, 1, NULL
                FROM p JOIN k a ON a.c = p.row JOIN k b ON b.c = p.col, range(2) u(e), range(2) w(f) WHERE p.step = 1 AND p.kind = 'open' AND (e = 0 OR NOT a.leaf) AND (f = 0 OR NOT b.leaf)))
    SELECT row, col, kind FROM p WHERE step = 1 AND kind <> 'open'"""))
def jns10_block_pairs(spark, d):
    tree, _ = clusters.cluster_tree(view(spark, d, "pts2"), ["x", "y"], min_size=128)
    return clusters.block_pairs(tree)


@query(with_views(["pts2", "balls2"], """SELECT ball_id, id, round(exp(-((x-cx)**2+(y-cy)**2)/32.0), 9) AS g, round(sqrt(1+0.25*((x-cx)**2+(y-cy)**2)), 9) AS m
    FROM balls2 JOIN pts2 ON (x-cx)**2+(y-cy)**2 <= 144"""))
def jns11_kernel_values(spark, d):
    c = view(spark, d, "balls2").select("ball_id", F.col("cx").alias("x"), F.col("cy").alias("y"))
    values = {"g": F.round("phi", 9), "m": F.round(F.sqrt(1 + 0.25 * F.col("dsq")), 9)}
    got = spatial.kernel_values(view(spark, d, "pts2"), c, ["x", "y"], 12.0, "gaussian", 4.0, values)
    return got.select(F.col("l_ball_id").alias("ball_id"), F.col("r_id").alias("id"), "g", "m")


@query(with_views(["ell2", "pts2"], "SELECT ell_id, id, round(2*exp(-((x-mx)**2)/8.0), 9) AS value FROM ell2 JOIN pts2 ON abs(x-mx) <= 6"))
def jns12_gaussian_block(spark, d):
    rows = view(spark, d, "ell2").select("ell_id", F.col("mx").alias("mu"), F.col("sxx").alias("var"), F.lit(2.0).alias("v"))
    got = spatial.gaussian_block(rows, view(spark, d, "pts2").select("id", F.col("x").alias("t")), cut=3.0, digits=9)
    return got.select(F.col("l_ell_id").alias("ell_id"), F.col("r_id").alias("id"), "value")


@query(with_views(["pts2"], "SELECT a.id AS id, count(*) AS n, round(sum(exp(-((a.x-b.x)**2+(a.y-b.y)**2)/50.0)*b.x), 6) AS avg FROM pts2 a JOIN pts2 b ON (a.x-b.x)**2+(a.y-b.y)**2 <= 100 GROUP BY 1"))
def jns13_within_radius(spark, d):
    p = view(spark, d, "pts2")
    return spatial.kernel_average(p, p, ["x", "y"], 10.0, 5.0, "x").select("id", "n", F.round("avg", 6).alias("avg"))


@query("SELECT p_brand, min(CAST(p_size AS DOUBLE)) AS lo_0, min(round(p_retailprice*10)-9000) AS lo_1, max(CAST(p_size AS DOUBLE)) AS hi_0, max(round(p_retailprice*10)-9000) AS hi_1 FROM part GROUP BY 1")
def agg1_bounding_boxes(spark, d):
    p = table(spark, d, "part").select("p_brand", F.col("p_size").cast("double").alias("x"), (F.round(F.col("p_retailprice") * 10) - 9000).alias("y"))
    return aggregates.bounding_box(p, ["x", "y"], by=["p_brand"])


@query(with_views(["grid2"], "SELECT min(i) AS lo_0, min(j) AS lo_1, max(i) AS hi_0, max(j) AS hi_1 FROM grid2, (SELECT max(abs(v)) AS m FROM grid2) WHERE abs(v)/m > 0.5 AND abs(v) > 1"))
def agg2_support_box(spark, d):
    return aggregates.support_box(view(spark, d, "grid2"), ["i", "j"], "v", rtol=0.5, atol=1.0)


@query(with_views(["pts2"], "SELECT min(sqrt((a.x-b.x)**2+(a.y-b.y)**2)) AS spacing FROM pts2 a, pts2 b WHERE a.id <> b.id AND a.x BETWEEN 10 AND 40 AND b.x BETWEEN 10 AND 40 AND a.y BETWEEN 100 AND 900 AND b.y BETWEEN 100 AND 900"))
def agg3_smallest_spacing(spark, d):
    return knn.smallest_spacing(view(spark, d, "pts2"), ["x", "y"], geo.in_box([F.col("x"), F.col("y")], [10.0, 100.0], [40.0, 900.0]))


@query("SELECT l_returnflag, round(sum((l_extendedprice-1000*l_quantity)**2)/sum(l_extendedprice**2), 6) AS relative, round(sum((l_extendedprice-1000*l_quantity)**2)/2/1e6, 2) AS misfit FROM lineitem GROUP BY 1")
def agg8_relative_errors(spark, d):
    rows = table(spark, d, "lineitem").withColumn("got", 1000 * F.col("l_quantity"))
    return aggregates.relative_errors(rows, ["l_returnflag"], "l_extendedprice", "got").select("l_returnflag", F.round("relative", 6).alias("relative"), F.round(F.col("misfit") / 1e6, 2).alias("misfit"))


@query("SELECT l_returnflag, bool_and(l_quantity >= 1) AS all_a, bool_and(l_discount > 0.05) AS all_b, bool_or(l_quantity >= 1) AS any_a, bool_or(l_discount > 0.05) AS any_b, FALSE AS bad FROM lineitem GROUP BY 1")
def agg11_truth(spark, d):
    rows = table(spark, d, "lineitem").withColumns({"a": F.col("l_quantity") >= 1, "b": F.col("l_discount") > 0.05})
    return aggregates.truth(rows, ["a", "b"], ["l_returnflag"]).join(F.broadcast(aggregates.bad_values(rows, ["l_quantity", "l_tax"])), F.lit(True))


@query(with_views(["series"], ", t AS (SELECT unnest([0.0, 500.0, 100.0, 9000.0]::DOUBLE[]) AS threshold) SELECT series_id, threshold, coalesce(min(k) FILTER (y < threshold), -1) AS first FROM series, t GROUP BY 1, 2"))
def win1_threshold_crossings(spark, d):
    return ordering.threshold_crossings(view(spark, d, "series"), [0.0, 500.0, 100.0, 9000.0])


_STARTS = "s AS (SELECT batch, length, sum(length) OVER (ORDER BY batch) - length AS start FROM batches)"


@query(with_views(["batches"], "," + _STARTS + """, q AS (SELECT o_orderkey*3 AS ind FROM orders)
    SELECT ind, batch, CAST(ind - start AS BIGINT) AS \"offset\" FROM q LEFT JOIN s ON ind >= start AND ind < start + length"""))
def win2_index_to_batch(spark, d):
    starts = ordering.offsets(view(spark, d, "batches"))
    return ordering.to_batch(table(spark, d, "orders").select((F.col("o_orderkey") * 3).alias("ind")), starts)


@query(with_views(["batches"], "," + _STARTS + " SELECT batch, CAST(length - 1 AS BIGINT) AS \"offset\", CAST(start + length - 1 AS BIGINT) AS ind FROM s"))
def win3_batch_to_index(spark, d):
    b = view(spark, d, "batches")
    return ordering.to_global(b.select("batch", (F.col("length") - 1).alias("offset")), ordering.offsets(b))


@query(with_views(["pts2"], "SELECT id, x, y, row_number() OVER (ORDER BY x, y, id) - 1 AS rank FROM pts2"))
def win4_lexsort(spark, d):
    return ordering.lexsort(view(spark, d, "pts2"), ["x", "y"])


@query(recursive(["pts2"], """, t AS (SELECT id, x, y, CAST(0 AS BIGINT) AS lo, (SELECT count(*) FROM pts2) AS n, 0 AS depth FROM pts2 UNION ALL
        SELECT id, x, y, CASE WHEN r < n//2 THEN lo ELSE lo + n//2 END, CASE WHEN r < n//2 THEN n//2 ELSE n - n//2 END, depth + 1 FROM
        (SELECT *, row_number() OVER (PARTITION BY lo ORDER BY CASE WHEN depth%2 = 0 THEN x ELSE y END DESC, id) - 1 AS r FROM t WHERE n > 1))
    SELECT id, lo AS place FROM t WHERE n = 1"""))
def win5_geometric_sort(spark, d):
    return clusters.geometric_sort(view(spark, d, "pts2"), ["x", "y"], finish=1024)


@query(recursive(["pts2"], _tree(64) + " SELECT id, c AS cluster FROM t WHERE n <= 64"))
def win6_cluster_members(spark, d):
    return clusters.cluster_tree(view(spark, d, "pts2"), ["x", "y"], min_size=64)[1]


@query()
def win7_ellipsoid_batches(spark, d):
    e = view(spark, d, "ell2").select("ell_id", F.array("mx", "my").alias("mu"), F.array(F.array("sxx", "sxy"), F.array("sxy", "syy")).alias("sigma"))
    return clusters.ellipsoid_batches(e, 2.0)


@query(with_views(["pts2"], "SELECT rank AS pos, id AS idx, TRUE AS bijection FROM (SELECT id, row_number() OVER (ORDER BY y, x, id) - 1 AS rank FROM pts2)"))
def win8_inverse_permutation(spark, d):
    perm = ordering.ranked(view(spark, d, "pts2"), [F.col("y"), F.col("x"), F.col("id")]).select(F.col("id").alias("pos"), F.col("rank").alias("idx"))
    return ordering.invert_permutation(perm).join(F.broadcast(ordering.check_permutation(perm)), F.lit(True))


@query(with_views(["series"], """SELECT a.series_id, a.k, round(sum(exp(-0.5*((a.k-b.k)/1.5)**2)*b.y)/sum(exp(-0.5*((a.k-b.k)/1.5)**2)), 6) AS y
    FROM series a JOIN series b ON a.series_id = b.series_id AND abs(a.k-b.k) <= 6 GROUP BY 1, 2"""))
def win9_gaussian_smooth(spark, d):
    return ordering.gaussian_smooth(view(spark, d, "series"), 1.5).withColumn("y", F.round("y", 6))


@query("SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)")
def set1_intersection(spark, d):
    return ordering.intersect_all(table(spark, d, "lineitem"), "l_returnflag", "l_partkey")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def set2_invert(spark, d):
    return ordering.invert_pairs(table(spark, d, "orders"), "o_orderkey", "o_custkey", "o_orderkey")


@query("""SELECT p_partkey, m AS mask, concat_ws('-', CASE WHEN m&1>0 THEN p_brand END, CASE WHEN m&2>0 THEN p_type END, CASE WHEN m&4>0 THEN CAST(p_size AS VARCHAR) END) AS subset
    FROM part, (SELECT CAST(unnest(range(8)) AS INT) AS m)""")
def set3_powerset(spark, d):
    sets = ordering.powerset(F.array("p_brand", "p_type", F.col("p_size").cast("string")))
    return table(spark, d, "part").select("p_partkey", F.posexplode(sets).alias("mask", "s")).select("p_partkey", "mask", F.array_join("s", "-").alias("subset"))
