"""Queries of the nested, complex and curve functions."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import complexes as cx
from ..functions import curves, nested
from .base import query
from .views import table, view, with_views

TREE = T.StructType([T.StructField("a", T.ArrayType(T.DoubleType())), T.StructField("b", T.StructType([T.StructField("c", T.DoubleType()), T.StructField("d", T.ArrayType(T.DoubleType()))]))])


def _trees(spark, d):
    """Two trees a row: whole numbers from the order lines."""
    q, n, s = F.col("l_quantity"), F.col("l_linenumber").cast("double"), (F.col("l_suppkey") % 7).cast("double")
    tree = lambda a, b, c, e: F.struct(F.array(a, b).alias("a"), F.struct(c.alias("c"), F.array(e).alias("d")).alias("b"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", tree(q, n, s, q - n).alias("u"), tree(n, s, q, s + 1).alias("v"))


_SQL = "WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, CAST(l_linenumber AS DOUBLE) AS n, CAST(l_suppkey % 7 AS DOUBLE) AS s FROM lineitem) SELECT l_orderkey, l_linenumber, {} FROM t"


def _flat(name, e):
    """The four leaves of a tree as columns."""
    return [e["a"][0].alias(name + "0"), e["a"][1].alias(name + "1"), e["b"]["c"].alias(name + "2"), e["b"]["d"][0].alias(name + "3")]


def _leaves(op):
    """SQL of an operation on the leaves of u and v."""
    u, v = ("q", "n", "s", "(q-n)"), ("n", "s", "q", "(s+1)")
    return [op(x, y) for x, y in zip(u, v)]


def _named(name, parts):
    return ", ".join(f"{p} AS {name}{i}" for i, p in enumerate(parts))


def _register(key, sql, make):
    def run(spark, d, make=make):
        return _trees(spark, d).select("l_orderkey", "l_linenumber", *make(F.col("u"), F.col("v")))

    query(_SQL.format(sql), key)(run)


_register("nst1_binary", _named("r", _leaves(lambda x, y: f"{x}*2+{y}")), lambda u, v: _flat("r", nested.binary(lambda x, y: x * 2 + y, u, v, TREE)))
_register("nst2_elementwise", _named("r", _leaves(lambda x, y: f"{x}*{x}+1")), lambda u, v: _flat("r", nested.elementwise(lambda x: x * x + 1, u, TREE)))
_register("nst3_reduce", "greatest(q,n,s,q-n) AS m", lambda u, v: [nested.reduce(lambda x: x, lambda a, b: F.greatest(a, b), u, TREE).alias("m")])
_register(
    "nst4_arithmetic",
    ", ".join(_named(k, _leaves(f)) for k, f in (("add", lambda x, y: f"{x}+{y}"), ("sub", lambda x, y: f"{x}-{y}"), ("mul", lambda x, y: f"{x}*{y}"), ("div", lambda x, y: f"coalesce(round({x}/nullif({y},0), 9), CASE WHEN {x}>0 THEN 1e300 WHEN {x}<0 THEN -1e300 ELSE 0 END)"))),
    lambda u, v: [*_flat("add", nested.add(u, v, TREE)), *_flat("sub", nested.sub(u, v, TREE)), *_flat("mul", nested.mult(u, v, TREE)), *_flat("div", nested.elementwise(lambda x: F.when(F.isnan(x), 0.0).when(F.abs(x) == float("inf"), F.signum(x) * 1e300).otherwise(F.round(x, 9)), nested.div(u, v, TREE), TREE))],
)
_register("nst5_scale", _named("r", _leaves(lambda x, y: f"{x}*3")), lambda u, v: _flat("r", nested.scale(u, 3.0, TREE)))
_register(
    "nst6_powers",
    ", ".join([_named("p", _leaves(lambda x, y: f"pow({x},2)")), _named("a", _leaves(lambda x, y: f"abs({x})")), _named("s", _leaves(lambda x, y: f"round(sqrt(abs({x})),9)")), _named("i", _leaves(lambda x, y: f"coalesce(round(1/nullif({x},0),9),0)"))]),
    lambda u, v: [*_flat("p", nested.power(u, 2, TREE)), *_flat("a", nested.absolute(u, TREE)), *_flat("s", nested.elementwise(lambda x: F.round(x, 9), nested.sqrt(nested.absolute(u, TREE), TREE), TREE)), *_flat("i", nested.elementwise(lambda x: F.when(F.abs(x) == float("inf"), 0.0).otherwise(F.round(x, 9)), nested.inverse(u, TREE), TREE))],
)


def _three(name, e):
    return [e["a"].alias(name + "a"), e["b"]["c"].alias(name + "c"), e["b"]["d"].alias(name + "d")]


_register(
    "nst7_leaf_sums",
    "q+n AS sa, s AS sc, q-n AS sd, q*n+n*s AS da, s*q AS dc, (q-n)*(s+1) AS dd, q*q+n*n AS na, s*s AS nc, (q-n)**2 AS nd, round(sqrt(q*q+n*n),9) AS ra, round(sqrt(s*s),9) AS rc, round(abs(q-n),9) AS rd",
    lambda u, v: [*_three("s", nested.leaf_sum(u, TREE)), *_three("d", nested.leaf_dot(u, v, TREE)), *_three("n", nested.leaf_normsquared(u, TREE)), *(F.round(x, 9).alias("r" + k) for x, k in zip((nested.leaf_norm(u, TREE)["a"], nested.leaf_norm(u, TREE)["b"]["c"], nested.leaf_norm(u, TREE)["b"]["d"]), "acd"))],
)
_register(
    "nst8_totals",
    "q+n+s+(q-n) AS total, q*n+n*s+s*q+(q-n)*(s+1) AS dot, q*q+n*n+s*s+(q-n)**2 AS n2, round(sqrt(q*q+n*n+s*s+(q-n)**2),9) AS norm",
    lambda u, v: [nested.total(u, TREE).alias("total"), nested.dot(u, v, TREE).alias("dot"), nested.normsquared(u, TREE).alias("n2"), F.round(nested.norm(u, TREE), 9).alias("norm")],
)
_register(
    "nst9_truth",
    "q<>0 AND n<>0 AND s<>0 AND q<>n AS every, TRUE AS some, FALSE AS bad, FALSE AS nan0, FALSE AS inf0",
    lambda u, v: [nested.every(u, TREE).alias("every"), nested.some(u, TREE).alias("some"), nested.isbad(u, TREE).alias("bad"), nested.isnan(u, TREE)["a"][0].alias("nan0"), nested.isinf(u, TREE)["a"][0].alias("inf0")],
)
_register(
    "nst10_logic",
    ", ".join([_named("o", _leaves(lambda x, y: f"{x}<>0 OR {y}<>0")), _named("a", _leaves(lambda x, y: f"{x}<>0 AND {y}<>0")), _named("n", _leaves(lambda x, y: f"{x}=0"))]),
    lambda u, v: [*_flat("o", nested.logical_or(u, v, TREE)), *_flat("a", nested.logical_and(u, v, TREE)), *_flat("n", nested.logical_not(u, TREE))],
)
_OPS = {"eq": "=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
_register(
    "nst11_comparisons",
    ", ".join([_named(k, _leaves(lambda x, y, o=o: f"{x}{o}{y}")) for k, o in _OPS.items()] + [_named("s" + k, _leaves(lambda x, y, o=o: f"{x}{o}3")) for k, o in _OPS.items()]),
    lambda u, v: [c for k in _OPS for c in _flat(k, nested.compare(k, u, v, TREE))] + [c for k in _OPS for c in _flat("s" + k, nested.compare_scalar(k, u, 3.0, TREE))],
)


_register(
    "nst12_ones_zeros",
    ", ".join([_named("o", _leaves(lambda x, y: "CAST(1 AS DOUBLE)")), _named("z", _leaves(lambda x, y: "CAST(0 AS DOUBLE)"))]),
    lambda u, v: [*_flat("o", nested.ones(u, TREE)), *_flat("z", nested.zeros(v, TREE))],
)


@query()
def nst12_like(spark, d):
    rows = _trees(spark, d)
    row, u = F.struct("l_orderkey", "l_linenumber"), F.col("u")
    return rows.select("l_orderkey", "l_linenumber", nested.ones(u, TREE).alias("ones"), nested.zeros(u, TREE).alias("zeros"), nested.rand(u, TREE, row).alias("rand"), nested.randn(u, TREE, row).alias("randn"))


@query(with_views(["pts2"], "SELECT id, x-25 AS re, y-500 AS im, round(sqrt((x-25)**2+(y-500)**2),9) AS modulus, round(atan2(y-500,x-25),9) AS angle, 500-y AS conj_im, round((x-25)**2-(y-500)**2,9) AS square_re, round(2*(x-25)*(y-500),9) AS square_im FROM pts2"))
def cpx1_complex(spark, d):
    z = cx.complex_of(F.col("x") - 25, F.col("y") - 500)
    p = view(spark, d, "pts2").withColumn("z", z).withColumn("w", cx.sqrt_cut(F.col("z")))
    z, w = F.col("z"), F.col("w")
    square = cx.times(w, w)
    return p.select("id", cx.real(z).alias("re"), cx.imag(z).alias("im"), F.round(cx.modulus(z), 9).alias("modulus"), F.round(cx.angle(z), 9).alias("angle"), cx.imag(cx.conj(z)).alias("conj_im"), F.round(cx.real(cx.times(z, z)), 9).alias("square_re"), F.round(cx.imag(cx.times(z, z)), 9).alias("square_im")).where(square["re"].isNotNull())


@query("SELECT l_partkey%500 AS entity, count(*) AS n, CAST(0 AS DOUBLE) AS r0, CAST(0 AS DOUBLE) AS r1, CAST(0 AS DOUBLE) AS r2 FROM lineitem GROUP BY 1")
def crv1_fit(spark, d):
    """The normal equations at each fit: mean products of its residual with the powers of the variable (zero)."""
    rows = table(spark, d, "lineitem").select((F.col("l_partkey") % 500).alias("entity"), (F.col("l_quantity") / 50).cast("double").alias("t"), (F.col("l_extendedprice") / 100000).cast("double").alias("y"))
    e = F.col("y") - curves.evaluate(F.col("c"), F.col("t"))
    products = [(F.round(F.abs(F.avg(e * F.pow("t", F.lit(k)))), 6) + 0.0).alias(f"r{k}") for k in range(3)]
    return rows.join(curves.fit(rows, 2), "entity").groupBy("entity").agg(F.count(F.lit(1)).alias("n"), *products)


@query("""WITH c AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS a0, CAST(p_partkey%5 AS DOUBLE) AS a1, 2.0::DOUBLE AS a2 FROM part)
    SELECT p_partkey, a0+a1*3+a2*9 AS at3, a1+2*a2*3 AS d3, 2*(a0+a1*3+a2*9) AS twice3, a0+1+(a1+1)*3+a2*9 AS sum3, (a0+a1*3+a2*9)*(1+3) AS prod3 FROM c""")
def crv2_polynomials(spark, d):
    a, b, t = F.array(F.col("p_size").cast("double"), (F.col("p_partkey") % 5).cast("double"), F.lit(2.0)), F.array(F.lit(1.0), F.lit(1.0)), F.lit(3.0)
    e = curves.evaluate
    return table(spark, d, "part").select("p_partkey", e(a, t).alias("at3"), e(curves.derivative(a), t).alias("d3"), e(curves.scaled(a, F.lit(2.0)), t).alias("twice3"), e(curves.plus(a, b), t).alias("sum3"), e(curves.product(a, b), t).alias("prod3"))


@query("SELECT p_partkey, round(sqrt(p_size*p_size+(p_partkey%5)**2)*2, 6) AS length FROM part")
def crv3_arc_length(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.array(F.lit(1.0), F.col("p_size").cast("double")).alias("x"), F.array(F.lit(0.0), (F.col("p_partkey") % 5).cast("double")).alias("y"))
    return curves.arc_length(rows, 1.0, 3.0, ["x", "y"]).select("p_partkey", F.round("length", 6).alias("length"))


@query("SELECT p_partkey, p_size/1.0 AS t0, p_size/1.0 AS t1, p_size/2.0 AS t2, p_size/6.0 AS t3, p_size*2.0 AS r0, -(p_size+2.0) AS r1, 1.0::DOUBLE AS r2 FROM part".replace("p_size/6.0", "round(p_size/6.0, 9)").replace("p_size", "CAST(p_size AS DOUBLE)"))
def crv4_coefficients(spark, d):
    x = F.col("p_size").cast("double")
    rows = table(spark, d, "part").select("p_partkey", curves.taylor(F.array(x, x, x, x)).alias("t"), curves.from_roots(F.array(x, F.lit(2.0))).alias("r"))
    return rows.select("p_partkey", *(F.col("t")[i].alias(f"t{i}") for i in range(3)), F.round(F.col("t")[3], 9).alias("t3"), *(F.col("r")[i].alias(f"r{i}") for i in range(3)))
