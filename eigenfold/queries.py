"""Registered queries: each applies one operator to the given tables or to a model problem made by Spark, with
the SQL that says the same. Model problems are ones whose spectra are known in closed form."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dense, frame_queries
from .functions import order, scalar
from .functions.region import Ellipse, Interval, Polygon, Region, Ring
from .matrix import Matrix, bse, checkpointed, combined, joined_block, joined_sum, matmul, tiled, transposed
from .operators import basis, processes, singular
from .operators.action import funm_multiply, solve_equation
from .operators.eigen import eigs
from .operators.nonlinear import chebyshev_nodes, nleigs
from .operators.polynomial import polyeigs
from .operators.singular import gsvds, hsvds, svds
from .operators.transform import Transform
from .sources import matrices as src

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

FLOW = """flow AS (
  SELECT CAST(c_nationkey AS BIGINT) AS i, CAST(s_nationkey AS BIGINT) AS j, CAST(sum(l_quantity) AS DOUBLE) AS v
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""
POINTS = """points AS (SELECT CAST(n_nationkey AS BIGINT) AS id, (n_nationkey - 12) / 3.0 + 0.01 * n_nationkey AS re, ((n_nationkey * 7) % 11 - 5) / 2.0 AS im FROM nation)"""
SAMPLES = """samples AS (SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_retailprice AS DOUBLE) / 997.0 AS x FROM part)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        _queries[name] = fn
        if sql is not None:
            _sql[name] = sql
        return fn

    return add


def entry_of(spark: SparkSession, a: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(a)], "i long, j long, v double")


def value_frame(spark: SparkSession, values, digits: int = 6) -> DataFrame:
    rows = [(k, round(float(np.real(v)), digits) + 0.0) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "k int, value double")


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    for n in names:
        df = df.withColumn(n, F.round(n, digits) + F.lit(0.0))
    return df


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return src.table(spark, sf_dir, "nation").select(n.cast("long").alias("id"), ((n - 12) / 3.0 + 0.01 * n).cast("double").alias("re"), ((n * 7 % 11 - 5) / 2.0).cast("double").alias("im"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), (F.col("p_retailprice").cast("double") / 997.0).alias("x"))


# --- sources and kernels -------------------------------------------------------------------------------

query("source_flow", f"WITH {FLOW} SELECT i, j, v FROM flow")(src.flow)
query("source_part_supplier", "SELECT CAST(l_partkey AS BIGINT) AS i, CAST(l_suppkey AS BIGINT) AS j, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2")(src.part_supplier)

@query("source_terms", r"SELECT doc_id AS i, CAST(len(regexp_split_to_array(text, '\s+')) AS DOUBLE) AS total FROM documents WHERE text IS NOT NULL")
def _(spark, sf):
    """Words of each document by the hashed term matrix's row sums."""
    return src.terms(spark, sf).groupBy("i").agg(F.sum("v").alias("total"))


@query("order_every_value", f"WITH {POINTS} SELECT id, CAST(row_number() OVER (ORDER BY -sqrt(re*re+im*im), re, abs(im), im DESC) - 1 AS BIGINT) AS k FROM points")
def _(spark, sf):
    """Ranks of all rows, by ranges."""
    return order.ranked(points(spark, sf), "largest_magnitude").select("id", "k")


TRANSITIONS = """names AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS k FROM (SELECT DISTINCT event_type FROM events)),
follows AS (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events),
transitions AS (SELECT b.k AS i, a.k AS j, CAST(count(*) AS DOUBLE) AS v FROM follows JOIN names a ON a.event_type = follows.event_type JOIN names b ON b.event_type = next GROUP BY 1, 2)"""
query("source_transitions", f"WITH {TRANSITIONS} SELECT i, j, v FROM transitions")(src.transitions)


@query("source_stochastic", f"WITH {TRANSITIONS} SELECT i, j, round(v / sum(v) OVER (PARTITION BY j), 6) + 0.0 AS v FROM transitions")
def _(spark, sf):
    return rounded(src.stochastic(src.transitions(spark, sf)), "v")


def grid_sql(shape: tuple[int, ...]) -> str:
    total = int(np.prod(shape))
    parts, stride = [f"SELECT i, i AS j, {2.0 * len(shape)} AS v FROM cells"], 1
    for s in shape:
        parts.append(f"SELECT i, i - {stride} AS j, -1.0 AS v FROM cells WHERE (i // {stride}) % {s} > 0")
        parts.append(f"SELECT i, i + {stride} AS j, -1.0 AS v FROM cells WHERE (i // {stride}) % {s} < {s - 1}")
        stride *= s
    return f"WITH cells AS (SELECT unnest(range({total})) AS i) SELECT i, j, CAST(v AS DOUBLE) AS v FROM ({' UNION ALL '.join(parts)})"


for label, shape in (("1d", (30,)), ("2d", (12, 9)), ("3d", (6, 5, 4))):
    query(f"source_laplacian_{label}", grid_sql(shape))(lambda spark, sf, shape=shape: src.stencil(spark, shape))
query("source_grcar", "SELECT i, i + d AS j, CASE WHEN d = -1 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS v FROM (SELECT unnest(range(30)) AS i), (SELECT unnest(range(-1, 4)) AS d) WHERE i + d BETWEEN 0 AND 29")(lambda spark, sf: src.grcar(spark, 30))
query("source_lauchli", "SELECT 0::BIGINT AS i, unnest(range(100)) AS j, 1.0::DOUBLE AS v UNION ALL SELECT j + 1, j, 0.5::DOUBLE FROM (SELECT unnest(range(100)) AS j)")(lambda spark, sf: src.lauchli(spark, 100, 0.5))


@query("source_random_walk", "WITH g AS (SELECT x, y FROM (SELECT unnest(range(15)) AS x), (SELECT unnest(range(15)) AS y) WHERE x + y < 15), p AS (SELECT *, 0.5/14*(x+y+1) AS a, 0.5-0.5/14*(x+y-1) AS b, CAST(x*15 - x*(x-1)/2 + y AS BIGINT) AS i FROM g), m AS (SELECT i, x, y+1 AS tx, (CASE WHEN x=0 THEN 2*a ELSE a END) AS v, 0 AS d FROM p WHERE x+y<14 UNION ALL SELECT i, x+1, y, (CASE WHEN y=0 THEN 2*a ELSE a END), 1 FROM p WHERE x+y<14 UNION ALL SELECT i, x, y-1, b, 0 FROM p WHERE y>0 UNION ALL SELECT i, x-1, y, b, 1 FROM p WHERE x>0) SELECT i, CAST(x*15 - x*(x-1)/2 + tx AS BIGINT) AS j, round(CAST(v AS DOUBLE), 6) + 0.0 AS v FROM m")
def _(spark, sf):
    return rounded(src.random_walk(spark, 15), "v")


@query("source_graph_laplacian", "WITH e AS (SELECT CAST(n_nationkey AS BIGINT) AS i, CAST(25 + n_regionkey AS BIGINT) AS j FROM nation), s AS (SELECT i, j FROM e UNION ALL SELECT j, i FROM e) SELECT i, i AS j, CAST(count(*) AS DOUBLE) AS v FROM s GROUP BY i UNION ALL SELECT i, j, -1.0::DOUBLE FROM s")
def _(spark, sf):
    return src.graph_laplacian(bipartite(spark, sf))


def bipartite(spark, sf) -> DataFrame:
    e = src.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("i"), (25 + F.col("n_regionkey")).cast("long").alias("j"), F.lit(1.0).alias("v"))
    return e.unionByName(transposed(e))


@query("kernel_spmv", f"WITH {FLOW} SELECT i, round(sum(v * (j + 1)), 6) + 0.0 AS x FROM flow GROUP BY i")
def _(spark, sf):
    x = spark.range(25).select(F.col("id").alias("i"), (F.col("id") + 1).cast("double").alias("x"))
    return rounded(joined_sum(src.flow(spark, sf), x), "x")


@query("kernel_spmv_transpose", f"WITH {FLOW} SELECT j AS i, round(sum(v * (i + 1)), 6) + 0.0 AS x FROM flow GROUP BY j")
def _(spark, sf):
    x = spark.range(25).select(F.col("id").alias("i"), (F.col("id") + 1).cast("double").alias("x"))
    return rounded(joined_sum(transposed(src.flow(spark, sf)), x), "x")


@query("kernel_spmm", f"WITH {FLOW} SELECT i, round(sum(v), 6) + 0.0 AS a, round(sum(v * j), 6) + 0.0 AS b FROM flow GROUP BY i")
def _(spark, sf):
    x = spark.range(25).select(F.col("id").alias("i"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("x"))
    y = joined_block(src.flow(spark, sf), x, 2)
    return rounded(y.select("i", F.col("x")[0].alias("a"), F.col("x")[1].alias("b")), "a", "b")


@query("kernel_spmv_broadcast", f"WITH {FLOW} SELECT i, round(sum(v * (j + 1)), 6) + 0.0 AS x FROM flow GROUP BY i")
def _(spark, sf):
    m = Matrix(src.flow(spark, sf), 25, 25)
    y = m.apply(np.arange(1.0, 26.0))
    m.unpersist()
    return rounded(spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "i long, x double"), "x")


@query("kernel_matmul", f"WITH {FLOW} SELECT a.i, b.j, round(sum(a.v * b.v), 3) + 0.0 AS v FROM flow a JOIN flow b ON a.j = b.i GROUP BY 1, 2")
def _(spark, sf):
    f = src.flow(spark, sf)
    return rounded(matmul(f, f), "v", digits=3)


@query("kernel_combination", f"WITH {FLOW}, u AS (SELECT i, j, 2 * v AS v FROM flow UNION ALL SELECT j, i, -v FROM flow) SELECT i, j, round(sum(v), 6) + 0.0 AS v FROM u GROUP BY 1, 2")
def _(spark, sf):
    f = src.flow(spark, sf)
    return rounded(combined([(2.0, f), (-1.0, transposed(f))]), "v")


@query("kernel_tile", f"WITH {FLOW} SELECT i, j, v FROM flow UNION ALL SELECT i, j + 25, -v FROM flow UNION ALL SELECT i + 25, j + 25, 2 * v FROM flow")
def _(spark, sf):
    f = src.flow(spark, sf)
    return tiled(spark, [[(1.0, f), (-1.0, f)], [None, (2.0, f)]], 25, 25)


@query("kernel_bse", f"WITH {FLOW} SELECT i, j, v FROM flow UNION ALL SELECT i, j + 25, v FROM flow UNION ALL SELECT j + 25, i, -v FROM flow UNION ALL SELECT j + 25, i + 25, -v FROM flow")
def _(spark, sf):
    f = src.flow(spark, sf)
    return bse(f, f, 25)


@query("kernel_norms", f"WITH {FLOW} SELECT round(sqrt(sum(v * v)), 4) AS frobenius, round((SELECT max(s) FROM (SELECT sum(abs(v)) AS s FROM flow GROUP BY i)), 4) AS inf, round((SELECT max(s) FROM (SELECT sum(abs(v)) AS s FROM flow GROUP BY j)), 4) AS one FROM flow")
def _(spark, sf):
    m = Matrix(src.flow(spark, sf), 25, 25)
    return spark.createDataFrame([tuple(round(x, 4) for x in m.norms("frobenius", "inf", "one").values())], "frobenius double, inf double, one double")


EMBEDDED = "e AS (SELECT vec_id AS i, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS c FROM embeddings)"


@query("kernel_gram", f"WITH {EMBEDDED} SELECT a.c AS i, b.c AS j, round(sum(a.v * b.v), 6) + 0.0 AS v FROM e a JOIN e b ON a.i = b.i GROUP BY 1, 2")
def _(spark, sf):
    g = basis.gram(src.embedding_rows(spark, sf))
    return rounded(entry_of(spark, g), "v")


@query("kernel_column_norms", f"WITH {EMBEDDED} SELECT CAST(c AS INTEGER) AS k, round(sqrt(sum(v * v)), 6) + 0.0 AS value FROM e GROUP BY c")
def _(spark, sf):
    return value_frame(spark, basis.column_norms(src.embedding_rows(spark, sf)))


@query("kernel_multiply", f"WITH {EMBEDDED} SELECT i, round(sum(v), 5) + 0.0 AS a, round(sum(v * c), 4) + 0.0 AS b FROM e GROUP BY i")
def _(spark, sf):
    q = np.stack([np.ones(64), np.arange(64.0)], 1)
    y = basis.multiply(src.embedding_rows(spark, sf).select("i", "x"), q)
    return y.select("i", (F.round(F.col("x")[0], 5) + F.lit(0.0)).alias("a"), (F.round(F.col("x")[1], 4) + F.lit(0.0)).alias("b"))


@query("kernel_basis_norms", f"WITH {EMBEDDED} SELECT round(sqrt(sum(v * v)), 6) AS frobenius, round(max(abs(v)), 6) AS top, round((SELECT max(s) FROM (SELECT sum(abs(v)) AS s FROM e GROUP BY i)), 6) AS inf FROM e")
def _(spark, sf):
    x = src.embedding_rows(spark, sf)
    found = basis.norms(x)
    return spark.createDataFrame([tuple(round(float(found[k]), 6) for k in ("frobenius", "max", "inf"))], "frobenius double, top double, inf double")


for method in ("tsqr", "chol", "svqb", "gs", "tsqrchol"):

    @query(f"kernel_orthogonalise_{method}", "SELECT CAST(i AS INTEGER) AS k, CASE WHEN i = 0 THEN 64.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM (SELECT unnest(range(2)) AS i)")
    def _(spark, sf, method=method):
        """The trace of Q'Q, and its distance from the identity."""
        q, _ = basis.orthogonalised(src.embedding_rows(spark, sf).select("i", "x"), method)
        g = basis.gram(q)
        return value_frame(spark, [np.trace(g), np.abs(g - np.eye(64)).max()], 5)


# --- order, regions, functions, transformations --------------------------------------------------------------

KEYS = {
    "largest_magnitude": "-sqrt(re*re+im*im)", "smallest_magnitude": "sqrt(re*re+im*im)", "largest_real": "-re", "smallest_real": "re", "largest_imaginary": "-im", "smallest_imaginary": "im",
    "target_magnitude": "sqrt((re-1)*(re-1)+(im-0.5)*(im-0.5))", "target_real": "abs(re-1)", "target_imaginary": "abs(im-0.5)", "smallest_positive_real": "CASE WHEN re > 0 THEN sqrt(re*re+im*im) ELSE 1e300 END",
}
for which, key in KEYS.items():
    query(f"order_{which}", f"WITH {POINTS} SELECT id, CAST(row_number() OVER (ORDER BY {key}, re, abs(im), im DESC) - 1 AS INTEGER) AS k FROM points ORDER BY k LIMIT 12")(
        lambda spark, sf, which=which: order.ranked(points(spark, sf), which, 1 + 0.5j, nev=12).select("id", F.col("k").cast("int").alias("k"))
    )

REGIONS: dict[str, tuple[Region, str]] = {
    "interval": (Interval(a=-2, b=1.5, c=-1, d=1), "CASE WHEN re < -2 OR re > 1.5 OR im < -1 OR im > 1 THEN -1 WHEN re = -2 OR re = 1.5 OR im = -1 OR im = 1 THEN 0 ELSE 1 END"),
    "ellipse": (Ellipse(centre=0.5, radius=2.0, vscale=0.5), "CAST(sign(1 - ((re-0.5)/2)**2 - (im/2)**2/0.25) AS INTEGER)"),
    "ellipse_complement": (Ellipse(complement=True, centre=0.5, radius=2.0, vscale=0.5), "-CAST(sign(1 - ((re-0.5)/2)**2 - (im/2)**2/0.25) AS INTEGER)"),
    "ring": (Ring(centre=0.0, radius=2.5, vscale=1.0, start=0.0, end=0.5, width=1.0), "CASE WHEN (CASE WHEN atan2(im, re) < 0 THEN atan2(im, re)/(2*pi()) + 1 ELSE atan2(im, re)/(2*pi()) END) BETWEEN 0 AND 0.5 THEN least(CAST(sign(1 - (re*re+im*im)/6.25) AS INTEGER), -CAST(sign(1 - (re*re+im*im)/2.25) AS INTEGER)) ELSE -1 END"),
    "polygon": (Polygon(vertices=[-2 - 1.2j, 2 - 1.2j, 0.1 + 2.2j]), "CASE WHEN im >= -1.2 AND 3.4*(re+2) - 2.1*(im+1.2) >= 0 AND 3.4*(2-re) - 1.9*(im+1.2) >= 0 THEN 1 ELSE -1 END"),
}
for label, (region, test) in REGIONS.items():
    query(f"region_{label}", f"WITH {POINTS} SELECT id, CAST({test} AS INTEGER) AS inside FROM points")(
        lambda spark, sf, region=region: points(spark, sf).select("id", region.column("re", "im").cast("int").alias("inside"))
    )


@query("region_contour", "SELECT CAST(k AS INTEGER) AS k, round(0.5 + 2*cos(2*pi()*(k+0.5)/16), 6) + 0.0 AS re, round(sin(2*pi()*(k+0.5)/16), 6) + 0.0 AS im FROM (SELECT unnest(range(16)) AS k)")
def _(spark, sf):
    return rounded(REGIONS["ellipse"][0].contour_frame(spark, 16), "re", "im")


@query("region_quadrature", "SELECT CAST(k AS INTEGER) AS k, round(0.5*cos(2*pi()*(k+0.5)/16)*2/16, 6) + 0.0 AS re, round(2*sin(2*pi()*(k+0.5)/16)/16, 6) + 0.0 AS im FROM (SELECT unnest(range(16)) AS k)")
def _(spark, sf):
    w = REGIONS["ellipse"][0].quadrature(16)[2]
    return rounded(spark.createDataFrame([(k, float(z.real), float(z.imag)) for k, z in enumerate(w)], "k int, re double, im double"), "re", "im")


@query("region_bounding_box", "SELECT -1.5::DOUBLE AS a, 2.5::DOUBLE AS b, -1.0::DOUBLE AS c, 1.0::DOUBLE AS d")
def _(spark, sf):
    return spark.createDataFrame([tuple(map(float, REGIONS["ellipse"][0].box()))], "a double, b double, c double, d double")


FUNCTIONS: dict[str, tuple[scalar.Function, str, str]] = {
    "exp": (scalar.Exp(alpha=0.5, beta=2.0), "2*exp(0.5*x)", "exp(0.5*x)"),
    "log": (scalar.Log(), "ln(x)", "1/x"),
    "sqrt": (scalar.Sqrt(beta=3.0), "3*sqrt(x)", "1.5/sqrt(x)"),
    "invsqrt": (scalar.InvSqrt(), "1/sqrt(x)", "-0.5/(x*sqrt(x))"),
    "phi1": (scalar.Phi(k=1), "(exp(x)-1)/x", "(exp(x)*(x-1)+1)/(x*x)"),
    "phi2": (scalar.Phi(k=2), "((exp(x)-1)/x-1)/x", "(exp(x)*(x-2)+x+2)/(x*x*x)"),
    "rational": (scalar.Rational(p=[1.0, -2.0, 3.0], q=[1.0, 1.0]), "(x*x-2*x+3)/(x+1)", "((2*x-2)*(x+1)-(x*x-2*x+3))/((x+1)*(x+1))"),
    "combine_add": (scalar.Combined(how="add", first=scalar.Exp(), second=scalar.Sqrt()), "exp(x)+sqrt(x)", "exp(x)+0.5/sqrt(x)"),
    "combine_multiply": (scalar.Combined(how="multiply", first=scalar.Exp(), second=scalar.Sqrt()), "exp(x)*sqrt(x)", "exp(x)*sqrt(x)+exp(x)*0.5/sqrt(x)"),
    "combine_divide": (scalar.Combined(how="divide", first=scalar.Exp(), second=scalar.Sqrt()), "exp(x)/sqrt(x)", "(exp(x)*sqrt(x)-exp(x)*0.5/sqrt(x))/x"),
    "combine_compose": (scalar.Combined(how="compose", first=scalar.Log(), second=scalar.Exp(alpha=2.0)), "exp(2*ln(x))", "2*x"),
}
for label, (fn, value, slope) in FUNCTIONS.items():
    query(f"function_{label}", f"WITH {SAMPLES} SELECT id, round({value}, 6) + 0.0 AS y, round({slope}, 6) + 0.0 AS dy FROM samples")(
        lambda spark, sf, fn=fn: rounded(samples(spark, sf).select("id", fn.column(F.col("x")).alias("y"), fn.derivative_column(F.col("x")).alias("dy")), "y", "dy")
    )

BASIS_SQL = {
    "monomial": ["1.0", "x", "x*x", "x*x*x"], "chebyshev1": ["1.0", "x", "2*x*x-1", "4*x*x*x-3*x"], "chebyshev2": ["1.0", "2*x", "4*x*x-1", "8*x*x*x-4*x"],
    "legendre": ["1.0", "x", "(3*x*x-1)/2", "(5*x*x*x-3*x)/2"], "laguerre": ["1.0", "1-x", "(x*x-4*x+2)/2", "(-x*x*x+9*x*x-18*x+6)/6"], "hermite": ["1.0", "2*x", "4*x*x-2", "8*x*x*x-12*x"],
}


def basis_columns(name: str, degree: int, x) -> list:
    a, b, g = dense.recurrence(name, degree)
    p = [F.lit(1.0)]
    for j in range(degree):
        p.append(((x - float(b[j])) * p[j] - (float(g[j]) * p[j - 1] if j else F.lit(0.0))) / float(a[j]))
    return p


for name, forms in BASIS_SQL.items():
    query(f"basis_{name}", f"WITH {SAMPLES} SELECT id, " + ", ".join(f"round(CAST({f} AS DOUBLE), 6) + 0.0 AS p{k}" for k, f in enumerate(forms)) + " FROM samples")(
        lambda spark, sf, name=name: rounded(samples(spark, sf).select("id", *[c.alias(f"p{k}") for k, c in enumerate(basis_columns(name, 3, F.col("x")))]), "p0", "p1", "p2", "p3")
    )

BACK = {
    "shift": (Transform("shift", 0.3), "re + 0.3", "im"),
    "sinvert": (Transform("sinvert", 0.3), "re/(re*re+im*im) + 0.3", "-im/(re*re+im*im)"),
    "cayley": (Transform("cayley", 0.3, nu=0.7), "((0.7+0.3*re)*(re-1) + 0.3*im*im)/((re-1)*(re-1)+im*im)", "(0.3*im*(re-1) - (0.7+0.3*re)*im)/((re-1)*(re-1)+im*im)"),
}
for label, (t, re_sql, im_sql) in BACK.items():
    query(f"transform_{label}_back", f"WITH {POINTS} SELECT id, round({re_sql}, 6) + 0.0 AS re, round({im_sql}, 6) + 0.0 AS im FROM points WHERE re*re+im*im > 0")(
        lambda spark, sf, t=t: rounded(points(spark, sf).where("re*re+im*im > 0").select("id", t.columns()[0].alias("re"), t.columns()[1].alias("im")), "re", "im")
    )


@query("chebyshev_nodes", "SELECT CAST(k AS INTEGER) AS k, round(1 + 2*cos(pi()*(k+0.5)/12), 6) + 0.0 AS value FROM (SELECT unnest(range(12)) AS k)")
def _(spark, sf):
    return value_frame(spark, chebyshev_nodes(12, -1.0, 3.0))


# --- solvers on problems with known answers ------------------------------------------------------------------

LINE = "w AS (SELECT unnest(range(1, 31)) AS m), l AS (SELECT 2 - 2*cos(pi()*m/31) AS a FROM w)"
GRID = "p AS (SELECT unnest(range(1, 11)) AS m), l AS (SELECT 4 - 2*cos(pi()*x.m/11) - 2*cos(pi()*y.m/11) AS a FROM p x, p y)"


def answer(known: str, value: str, by: str, limit: int, where: str = "TRUE", digits: int = 6) -> str:
    return f"WITH {known}, v AS (SELECT {value} AS b FROM l) SELECT CAST(row_number() OVER (ORDER BY {by}) - 1 AS INTEGER) AS k, round(b, {digits}) + 0.0 AS value FROM v WHERE {where} ORDER BY {by} LIMIT {limit}"


def sine_sum(f: str) -> str:
    return f"WITH w AS (SELECT unnest(range(1, 31)) AS m), p AS (SELECT unnest(range(30)) AS i) SELECT CAST(i AS INTEGER) AS k, round(sum(2.0/31*sin(pi()*m*(i+1)/31)*sin(pi()*m/31)*{f}), 6) + 0.0 AS value FROM w, p GROUP BY i"


def line(spark) -> Matrix:
    return Matrix(src.stencil(spark, (30,)), 30, 30)


def grid(spark) -> Matrix:
    return Matrix(src.stencil(spark, (10, 10)), 100, 100)


for solver in ("krylovschur", "arnoldi", "lanczos", "subspace", "power", "lapack", "gd", "jd", "lobpcg", "rqcg"):
    nev = 1 if solver == "power" else 4
    query(f"eps_{solver}", answer(LINE, "a", "b DESC", nev))(
        lambda spark, sf, solver=solver, nev=nev: value_frame(spark, eigs(line(spark), nev=nev, which="largest_real" if solver in ("gd", "jd", "lobpcg", "rqcg") else "largest_magnitude", solver=solver, tol=1e-10, max_it=20000 if solver == "power" else None).values)
    )
for how in processes.REORTHOGONALISATIONS:
    query(f"eps_lanczos_{how}", answer(LINE, "a", "b DESC", 3))(
        lambda spark, sf, how=how: value_frame(spark, eigs(line(spark), nev=3, solver="lanczos", reorthogonalise=how, tol=1e-10, max_it=1000).values)
    )
query("eps_arnoldi_delayed", answer(LINE, "a", "b DESC", 3))(lambda spark, sf: value_frame(spark, eigs(line(spark), nev=3, solver="arnoldi", delayed=True, problem="nhep", tol=1e-10, max_it=1000).values.real))
query("eps_transform_adjoint", answer(LINE, "1/(a - 0.3)", "abs(b) DESC", 3))(
    lambda spark, sf: value_frame(spark, sorted(eigs(Transform("sinvert", 0.3).shell(line(spark).operator(), None), nev=3, problem="nhep", tol=1e-10).values.real, key=lambda v: -abs(v)))
)


@query("kernel_split_phase", f"WITH {EMBEDDED}, f AS (SELECT i, max(v) FILTER (c = 0) AS p, max(v) FILTER (c = 1) AS q FROM e GROUP BY i) SELECT round(sum(p * q), 6) + 0.0 AS dot, round(sum(p * p), 6) + 0.0 AS pp, round(sum(q * q), 6) + 0.0 AS qq FROM f")
def _(spark, sf):
    """A product and two norms, asked for one after another, from one pass."""
    phase = basis.Phase(src.embedding_rows(spark, sf).select("x"))
    phase.dot([0], [1])
    phase.norm([0, 1])
    dot, squares = phase.end()
    return spark.createDataFrame([tuple(round(float(x), 6) + 0.0 for x in (dot[0, 0], *squares[0]))], "dot double, pp double, qq double")


for method in ("higham", "pade", "subdiagonal"):
    query(f"function_expm_{method}", sine_sum("exp(-(2-2*cos(pi()*m/31)))"))(lambda spark, sf, method=method: value_frame(spark, dense.expm(-1.0 * line(spark).dense(), method)[:, 0]))
for solver in ("krylovschur", "gd", "jd", "lobpcg"):
    query(f"eps_ghep_{solver}", answer(GRID, "a/4", "b", 4))(
        lambda spark, sf, solver=solver: value_frame(spark, eigs(grid(spark), 4 * np.eye(100), nev=4, which="smallest_magnitude", solver=solver, tol=1e-10).values[:4])
    )
for kind in ("sinvert", "cayley"):
    query(f"eps_{kind}", answer(GRID, "a", "abs(b - 0.3), b", 4))(
        lambda spark, sf, kind=kind: value_frame(spark, sorted(eigs(grid(spark), nev=4, target=0.3, transform=Transform(kind, 0.3, nu=0.5 if kind == "cayley" else None), tol=1e-10).values[:4], key=lambda v: (round(abs(v - 0.3), 9), v)))
    )
for label, options in {"slicing": {}, "filter": {"transform": "filter", "degree": 80}}.items():
    query(f"eps_{label}", answer(GRID, "a", "b", 100, "b BETWEEN 0.4 AND 1.3"))(
        lambda spark, sf, options=options: value_frame(spark, np.sort(eigs(grid(spark), interval=(0.4, 1.3), which="all", **options).values))
    )
for extraction in ("ritz", "hankel"):
    query(f"eps_ciss_{extraction}", answer(GRID, "a", "b", 100, "abs(b - 0.5) <= 0.2"))(
        lambda spark, sf, extraction=extraction: value_frame(spark, np.sort(eigs(grid(spark), solver="ciss", region=Ellipse(centre=0.5, radius=0.2), which="all", extraction=extraction).values.real))
    )


# beyond DENSE_ROWS: a grid of 72 x 72, whose products are Spark jobs in the first four and whose entries are gathered in the rest
BROAD = "p AS (SELECT unnest(range(1, 73)) AS m), l AS (SELECT 4 - 2*cos(pi()*x.m/73) - 2*cos(pi()*y.m/73) AS a FROM p x, p y)"


def broad(spark, gathered: int = 0) -> Matrix:
    return Matrix(src.stencil(spark, (72, 72)), 5184, 5184, gathered=gathered)


query("large_krylovschur", answer(BROAD, "a", "b DESC", 1))(lambda spark, sf: value_frame(spark, eigs(broad(spark), nev=1, which="largest_real", ncv=48, tol=1e-7).values))
query("large_lobpcg", answer(BROAD, "a", "b DESC", 1, digits=4))(lambda spark, sf: value_frame(spark, eigs(broad(spark), nev=1, which="largest_real", solver="lobpcg", block=4, tol=1e-4).values, 4))
query("large_svd", answer(BROAD, "a", "b DESC", 1, digits=5))(lambda spark, sf: value_frame(spark, svds(broad(spark), nsv=1, solver="trlanczos", ncv=40, tol=1e-5).values, 5))
query("large_mfn", "WITH p AS (SELECT unnest(range(1, 73)) AS m), s AS (SELECT sum(2.0/73*sin(pi()*m/73)*sin(pi()*m/73)*exp(-(2-2*cos(pi()*m/73)))) AS a FROM p) SELECT CAST(0 AS INTEGER) AS k, round(a * a, 6) AS value FROM s")(
    lambda spark, sf: value_frame(spark, funm_multiply(broad(spark), scalar.Exp(alpha=-1.0), np.eye(1, 5184)[0], tol=1e-10).y[:1])
)
for label, options in {"filter": {"transform": "filter", "degree": 160}, "slicing": {"solver": "slice"}}.items():
    query(f"large_{label}", answer(BROAD, "a", "b", 1000, "b BETWEEN 0.05 AND 0.15"))(
        lambda spark, sf, options=options: value_frame(spark, np.sort(eigs(broad(spark, 10**6), interval=(0.05, 0.15), which="all", **options).values))
    )
query("large_multiple", answer(BROAD, "a", "b", 4))(lambda spark, sf: value_frame(spark, eigs(broad(spark, 10**6), nev=4, target=0.0, transform="sinvert", sigma=0.0, tol=1e-9).values))


@query("eps_random_walk")
def _(spark, sf):
    m = Matrix(transposed(src.random_walk(spark, 15)), 120, 120)
    return value_frame(spark, eigs(m, nev=4, which="largest_real").values[:4])


@query("eps_two_sided", "SELECT CAST(k AS INTEGER) AS k, 1.0::DOUBLE AS value FROM (SELECT unnest(range(2)) AS k)")
def _(spark, sf):
    r = eigs(Matrix(transposed(src.random_walk(spark, 15)), 120, 120), nev=2, which="largest_real", two_sided=True)
    return value_frame(spark, np.abs(np.einsum("ij,ij->j", r.left.conj(), r.vectors)))


FLIP = "w AS (SELECT unnest(range(1, 61)) AS m), l AS (SELECT (CASE WHEN m % 2 = 1 THEN 1 ELSE -1 END) * (2 - 2*cos(pi()*m/61)) AS a FROM w)"
for label, options in {"": {"which": "largest_magnitude"}, "_sinvert": {"target": 1.0, "transform": "sinvert"}}.items():

    @query(f"eps_indefinite{label}", answer(FLIP, "a", "abs(b - 1)" if label else "abs(b) DESC", 4))
    def _(spark, sf, options=options):
        """A line's stiffness against the reversal of its points, which is symmetric and indefinite: values +-(2 - 2c)."""
        n = 60
        flip = spark.range(n).select(F.col("id").alias("i"), (n - 1 - F.col("id")).alias("j"), F.lit(1.0).alias("v"))
        r = eigs(Matrix(src.stencil(spark, (n,)), n, n), Matrix(flip, n, n), nev=4, problem="ghiep", tol=1e-10, **options)
        return value_frame(spark, r.values[:4])


@query("eps_two_sided_drift", "WITH w AS (SELECT unnest(range(1, 61)) AS m), v AS (SELECT 2 + 2*sqrt(1.1*0.9)*cos(pi()*m/61) AS b FROM w) SELECT CAST(row_number() OVER (ORDER BY b DESC) - 1 AS INTEGER) AS k, round(b, 6) AS value, 0.0::DOUBLE AS error FROM v ORDER BY b DESC LIMIT 4")
def _(spark, sf):
    """A drift and diffusion on a line, and how far the left vectors are from y' A = k y'."""
    n = 60
    m = Matrix(src.banded(spark, n, {-1: 0.9, 0: 2.0, 1: 1.1}), n, n)
    r = eigs(m, nev=4, which="largest_real", two_sided=True, tol=1e-10)
    off = np.abs(m.adjoint(r.left) - r.left * np.conj(r.values)).max(0) / np.abs(r.left).max(0)
    return spark.createDataFrame([(k, round(float(v.real), 6), round(float(e), 6)) for k, (v, e) in enumerate(zip(r.values[:4], off))], "k int, value double, error double")


@query("eps_power_two_sided", "SELECT CAST(0 AS INTEGER) AS k, round(3 + 2*sqrt(4.0*1.0)*cos(pi()/9), 6) AS value")
def _(spark, sf):
    return value_frame(spark, eigs(Matrix(src.banded(spark, 8, {-1: 1.0, 0: 3.0, 1: 4.0}), 8, 8), nev=1, solver="power", two_sided=True, tol=1e-10, max_it=200).values)


@query("eps_bse", "WITH w AS (SELECT unnest(range(1, 25)) AS m), l AS (SELECT sqrt(2.5 * (6.5 + 4*cos(pi()*m/25))) AS a FROM w), v AS (SELECT a * s AS b FROM l, (SELECT unnest([1, -1]) AS s)) SELECT CAST(row_number() OVER (ORDER BY round(abs(b), 9), b DESC) - 1 AS INTEGER) AS k, round(b, 6) AS value FROM v ORDER BY round(abs(b), 9), b DESC LIMIT 4")
def _(spark, sf):
    """Both blocks have the same vectors, with values 4.5 + 2c and 2 + 2c: pairs +-sqrt of the difference of squares."""
    n = 24
    r, c = src.banded(spark, n, {-1: 1.0, 0: 4.5, 1: 1.0}), src.banded(spark, n, {-1: 1.0, 0: 2.0, 1: 1.0})
    found = eigs(Matrix(bse(r, c, n), 2 * n, 2 * n), nev=4, which="smallest_magnitude", problem="bse").values[:4]
    return value_frame(spark, sorted(found, key=lambda v: (round(abs(v), 9), -v)))


@query("eps_bse_gruning", _sql["eps_bse"])
def _(spark, sf):
    """The same by the product of R - C and R + C, without entries."""
    n = 24
    r, c = src.banded(spark, n, {-1: 1.0, 0: 4.5, 1: 1.0}), src.banded(spark, n, {-1: 1.0, 0: 2.0, 1: 1.0})
    found = eigs(Matrix(bse(r, c, n), 2 * n, 2 * n), nev=4, which="smallest_magnitude", problem="bse", bse="gruning", tol=1e-10).values[:4]
    return value_frame(spark, sorted(found, key=lambda v: (round(abs(v), 9), -v)))


@query("eps_deflation", answer(LINE, "a", "b", 3, "b > (SELECT min(a) FROM l) + 1e-9"))
def _(spark, sf):
    low = np.sin(np.pi * np.arange(1, 31) / 31)
    return value_frame(spark, eigs(line(spark), nev=3, which="smallest_real", deflation=low[:, None], tol=1e-10).values)


@query("eps_graph_fiedler", "WITH r AS (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1), v AS (SELECT 0.0 AS b FROM r UNION ALL SELECT 1.0 FROM r, (SELECT unnest(range(1, 100)) AS i) WHERE i < n UNION ALL SELECT n + 1.0 FROM r) SELECT CAST(row_number() OVER (ORDER BY b) - 1 AS INTEGER) AS k, CAST(b AS DOUBLE) AS value FROM v ORDER BY b LIMIT 8")
def _(spark, sf):
    """Smallest values of the nation and region graph's Laplacian; each region is a star of its own, with 0, 1 and its size."""
    n = 30
    return value_frame(spark, eigs(Matrix(src.graph_laplacian(bipartite(spark, sf)), n, n), nev=8, which="smallest_real", solver="lapack").values)


@query(
    "eps_power_flow",
    f"""WITH RECURSIVE {FLOW}, step(n, x) AS (
  SELECT 0, list_transform(range(25), lambda q: 1.0::DOUBLE)
  UNION ALL SELECT n + 1, (SELECT list(y / t ORDER BY i) FROM (SELECT i, y, sqrt(sum(y * y) OVER ()) AS t FROM (SELECT i, sum(v * x[j + 1]) AS y FROM flow GROUP BY i))) FROM step WHERE n < 60)
SELECT CAST(0 AS INTEGER) AS k, round((SELECT sqrt(sum(y * y)) FROM (SELECT sum(v * x[j + 1]) AS y FROM flow, (SELECT x FROM step WHERE n = 60) GROUP BY i)), 4) AS value""",
)
def _(spark, sf):
    return value_frame(spark, eigs(Matrix(src.flow(spark, sf), 25, 25), nev=1, solver="power", tol=1e-12).values, 4)


@query(
    "eps_stationary",
    f"""WITH RECURSIVE {TRANSITIONS}, p AS (SELECT i, j, v / sum(v) OVER (PARTITION BY j) AS v FROM transitions), step(n, x) AS (
  SELECT 0, list_transform(range((SELECT count(*) FROM names)), lambda q: 1.0::DOUBLE)
  UNION ALL SELECT n + 1, (SELECT list(y / t ORDER BY i) FROM (SELECT i, y, sum(y) OVER () AS t FROM (SELECT i, sum(v * x[j + 1]) AS y FROM p GROUP BY i))) FROM step WHERE n < 60)
SELECT CAST(q - 1 AS INTEGER) AS k, round(x[q], 6) + 0.0 AS value FROM step, (SELECT unnest(range(1, (SELECT count(*) FROM names) + 1)) AS q) WHERE n = 60""",
)
def _(spark, sf):
    p = src.stochastic(src.transitions(spark, sf))
    n = src.table(spark, sf, "events").select("event_type").distinct().count()
    x = eigs(Matrix(p, n, n), nev=1, which="largest_real", tol=1e-12).vectors[:, 0].real
    return value_frame(spark, x / x.sum())


for solver in ("cross", "cyclic", "lanczos", "trlanczos", "lapack"):
    query(f"svd_{solver}", answer(LINE, "a", "b DESC", 4))(lambda spark, sf, solver=solver: value_frame(spark, svds(line(spark), nsv=4, solver=solver, tol=1e-10).values))
    query(f"svd_{solver}_smallest", answer(LINE, "a", "b", 2))(lambda spark, sf, solver=solver: value_frame(spark, svds(line(spark), nsv=2, solver=solver, which="smallest", tol=1e-8).values))
query("svd_randomized", answer(LINE, "a", "b DESC", 2))(lambda spark, sf: value_frame(spark, svds(line(spark), nsv=2, solver="randomized", tol=1e-9).values))
query("svd_lauchli", "SELECT CAST(0 AS INTEGER) AS k, round(sqrt(100.25), 6) AS value")(lambda spark, sf: value_frame(spark, svds(Matrix(src.lauchli(spark, 100, 0.5), 101, 100), solver="trlanczos").values))

SQUARES = f"WITH {EMBEDDED} SELECT CAST(0 AS INTEGER) AS k, round(sum(v * v), 6) AS value FROM e"
query("svd_frame_cross_squares", SQUARES)(lambda spark, sf: value_frame(spark, [(singular.frame_svd(src.embedding_rows(spark, sf))[0] ** 2).sum()]))
query("svd_frame_tsqr_squares", SQUARES)(lambda spark, sf: value_frame(spark, [(singular.frame_svd(src.embedding_rows(spark, sf), method="tsqr")[0] ** 2).sum()]))


@query("svd_embeddings")
def svd_embeddings(spark, sf):
    """The five largest singular values of the embeddings, from one pass."""
    return value_frame(spark, singular.frame_svd(src.embedding_rows(spark, sf), 5)[0])


@query("svd_embeddings_randomized")
def _(spark, sf):
    return value_frame(spark, singular.frame_randomized(src.embedding_rows(spark, sf), 64, 5, extra=40, power=8)[0], 3)


@query("svd_frame_moments", f"WITH {EMBEDDED}, g AS (SELECT a.c AS i, b.c AS j, sum(a.v * b.v) AS v FROM e a JOIN e b ON a.i = b.i GROUP BY 1, 2) SELECT CAST(0 AS INTEGER) AS k, round(sum(v) FILTER (i = j), 5) AS value FROM g UNION ALL SELECT 1, round(sqrt(sum(v * v)), 4) FROM g")
def _(spark, sf):
    """Sums of the second and, under a root, the fourth powers of all singular values: the Gram matrix's trace and norm."""
    s = singular.frame_svd(src.embedding_rows(spark, sf))[0]
    return spark.createDataFrame([(0, round(float((s**2).sum()), 5)), (1, round(float(np.sqrt((s**4).sum())), 4))], "k int, value double")


def halves(spark, sf) -> list[DataFrame]:
    """The rows with even and with odd labels."""
    rows = src.embedding_rows(spark, sf)
    return [rows.where(F.col("label") % 2 == k).select("i", "x") for k in (0, 1)]


@query("svd_gsvd")
def _(spark, sf):
    return value_frame(spark, singular.frame_gsvd(*halves(spark, sf), 5).values)


@query("svd_hsvd")
def _(spark, sf):
    """Rows signed by their label's parity."""
    return value_frame(spark, singular.frame_hsvd(*halves(spark, sf), 5).values)


#: Gram matrices of both halves, in SQL.
PAIR = f"""{EMBEDDED}, f AS (SELECT e.*, label % 2 AS h FROM e JOIN embeddings ON vec_id = i), g AS MATERIALIZED (SELECT a.c AS p, b.c AS q, sum(a.v * b.v) FILTER (a.h = 0) AS a, sum(a.v * b.v) FILTER (a.h = 1) AS b FROM f a JOIN f b ON a.i = b.i GROUP BY 1, 2)"""


@query("svd_gsvd_identities", f"WITH {PAIR} SELECT 64.0::DOUBLE AS ones, 0.0::DOUBLE AS off, round(sum(a) FILTER (p = q), 5) AS first, round(sum(b) FILTER (p = q), 5) AS second, round(sum(a * a), 3) AS square, round(sum(a * b), 3) AS crossed FROM g")
def _(spark, sf):
    """Of the joint factor: the sum of c^2 + s^2 and the largest deviation of one from 1, traces of both Gram matrices, and of their products."""
    f = singular.joint_factor(*halves(spark, sf))
    a, b, one = f.product(f.c**2), f.product(f.s**2), f.c**2 + f.s**2
    found = (one.sum(), np.abs(one - 1).max(), np.trace(a), np.trace(b), (a * a).sum(), (a * b).sum())
    return spark.createDataFrame([tuple(round(float(x), d) + 0.0 for x, d in zip(found, (6, 6, 5, 5, 3, 3)))], "ones double, off double, first double, second double, square double, crossed double")


@query("svd_hsvd_moments", f"WITH {PAIR} SELECT round(sum(a - b) FILTER (p = q), 5) AS second, round(sum((a - b) * (a - b)), 3) AS fourth FROM g")
def _(spark, sf):
    """The signed second and the fourth moments of all hyperbolic values."""
    r = singular.frame_hsvd(*halves(spark, sf))
    return spark.createDataFrame([(round(float((r.signature * r.values**2).sum()), 5), round(float((r.values**4).sum()), 3))], "second double, fourth double")


LINES = "w AS (SELECT unnest(range(1, 61)) AS m), l AS (SELECT 2 - 2*cos(pi()*m/61) AS a FROM w)"
for label in ("upper", "single", "lower"):

    @query(f"svd_gsvd_{label}", answer(LINES, "a / (2 + a)", "b DESC", 3))
    def _(spark, sf, label=label):
        """A line's stiffness T against 2 + T, which have the same vectors."""
        a, b = (Matrix(src.banded(spark, 60, {-1: -1.0, 0: d, 1: -1.0}), 60, 60) for d in (2.0, 4.0))
        return value_frame(spark, gsvds(a, b, 3, solver="trlanczos", bidiagonalisation=label, tol=1e-9).values)


for solver in ("trlanczos", "cross"):

    @query(f"svd_hsvd_{solver}", answer(LINES, "sqrt(abs(a*a - 1))", "b DESC", 4))
    def _(spark, sf, solver=solver):
        """T above the identity, whose rows count negative: values sqrt |a^2 - 1|."""
        n = 60
        a = src.stencil(spark, (n,)).unionAll(src.identity(spark, n).withColumn("i", F.col("i") + n))
        return value_frame(spark, hsvds(Matrix(a, 2 * n, n), np.r_[np.ones(n), -np.ones(n)], 4, solver=solver, tol=1e-10).values)


@query("eps_lda")
def _(spark, sf):
    """Directions that part the labels: between-class against within-class scatter, from one pass of grouped sums."""
    rows = src.embedding_rows(spark, sf)
    total = basis.gram(rows)
    groups = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("x")[c]).alias(f"s{c}") for c in range(64)]).limit(10_001).collect()  # one row a label
    if len(groups) > 10_000:
        raise ValueError("more than 10000 labels are no classes")
    n = np.array([r["n"] for r in groups], float)
    s = np.array([[r[f"s{c}"] for c in range(64)] for r in groups])
    between = (s / n[:, None]).T @ s - np.outer(s.sum(0), s.sum(0)) / n.sum()
    within = total - (s / n[:, None]).T @ s
    return value_frame(spark, eigs(between, within, nev=5, which="largest_real", problem="ghep").values)


@query("svd_part_supplier")
def _(spark, sf):
    """Leading singular values of quantities by part and supplier, through the product of both sides on the short one, which is not made."""
    ps = checkpointed(src.part_supplier(spark, sf))
    dims = ps.agg(F.max("i"), F.max("j")).first()
    return value_frame(spark, singular.tall_svd(ps, dims[0] + 1, dims[1] + 1, nsv=3).values, 4)


@query("svd_graph_embedding")
def _(spark, sf):
    """Katz proximities of the nations' flow graph: its spectral radius, then the generalised values of the pair."""
    edges = src.stochastic(src.flow(spark, sf))
    rho = abs(eigs(Matrix(edges, 25, 25), nev=1).values[0])
    a, b = src.proximity_pair(edges, 25, 0.8 / rho)
    return value_frame(spark, gsvds(Matrix(a, 25, 25), Matrix(b, 25, 25), 4).values)


SPRING = "w AS (SELECT unnest(range(1, 25)) AS m), l AS (SELECT 3 - 2*cos(pi()*m/25) AS a FROM w)"
ROOT = "(-10*a + sqrt(100*a*a - 20*a))/2"
for solver in ("toar", "qarnoldi", "linear", "stoar", "lapack", "jd"):

    @query(f"pep_{solver}", answer(SPRING, ROOT, "abs(b + 0.5)", 4))
    def _(spark, sf, solver=solver):
        """k^2 I + 10 T k + 5 T with a tridiagonal T."""
        k, c = src.banded(spark, 24, {-1: -5, 0: 15, 1: -5}), src.banded(spark, 24, {-1: -10, 0: 30, 1: -10})
        r = polyeigs([Matrix(k, 24, 24), Matrix(c, 24, 24), Matrix(src.identity(spark, 24), 24, 24)], nev=4, target=-0.5, solver=solver, tol=1e-10)
        return value_frame(spark, r.values)


@query("pep_interval", answer(SPRING, ROOT, "b", 100, "b BETWEEN -0.508 AND -0.5055"))
def _(spark, sf):
    t = 3 * np.eye(24) - np.eye(24, k=1) - np.eye(24, k=-1)
    return value_frame(spark, np.sort(polyeigs([5 * t, 10 * t, np.eye(24)], interval=(-0.508, -0.5055), solver="stoar", which="all").values))


for solver in ("toar", "stoar"):

    @query(f"pep_interval_{solver}", answer(SPRING, ROOT, "b", 100, "b BETWEEN -0.508 AND -0.5055"))
    def _(spark, sf, solver=solver):
        """The same by a sweep of shifted Krylov solves, without the dense form."""
        k, c = src.banded(spark, 24, {-1: -5, 0: 15, 1: -5}), src.banded(spark, 24, {-1: -10, 0: 30, 1: -10})
        r = polyeigs([Matrix(k, 24, 24), Matrix(c, 24, 24), Matrix(src.identity(spark, 24), 24, 24)], interval=(-0.508, -0.5055), solver=solver, which="all", krylov=True, tol=1e-10)
        return value_frame(spark, np.sort(r.values))


@query("pep_ciss", answer(SPRING, ROOT, "b", 100, "abs(b + 0.506) <= 0.001"))
def _(spark, sf):
    t = 3 * np.eye(24) - np.eye(24, k=1) - np.eye(24, k=-1)
    return value_frame(spark, np.sort(polyeigs([5 * t, 10 * t, np.eye(24)], solver="ciss", region=Ellipse(centre=-0.506, radius=0.001)).values.real))


#: 5 a p0 + 10 a p1 + p2 in powers of x: the factors of x^2, x and 1.
IN_POWERS = {"monomial": ("1", "10*a", "5*a"), "chebyshev1": ("2", "10*a", "5*a - 1"), "chebyshev2": ("4", "20*a", "5*a - 1"), "legendre": ("1.5", "10*a", "5*a - 0.5"), "laguerre": ("0.5", "-10*a - 2", "15*a + 1"), "hermite": ("4", "20*a", "5*a - 2")}


def nearest_roots(two: str, one: str, none: str) -> str:
    return f"""WITH w AS (SELECT unnest(range(1, 13)) AS m), l AS (SELECT 3 - 2*cos(pi()*m/13) AS a FROM w), c AS (SELECT CAST({two} AS DOUBLE) AS x, CAST({one} AS DOUBLE) AS y, CAST({none} AS DOUBLE) AS z FROM l),
d AS (SELECT x, y, y*y - 4*x*z AS q, s FROM c, (SELECT unnest([1, -1]) AS s)), r AS (SELECT CASE WHEN q >= 0 THEN (-y + s*sqrt(q))/(2*x) ELSE -y/(2*x) END AS re, CASE WHEN q >= 0 THEN 0 ELSE s*sqrt(-q)/(2*x) END AS im FROM d)
SELECT CAST(row_number() OVER (ORDER BY k, b) - 1 AS INTEGER) AS k, round(b, 6) AS value FROM (SELECT round((re+0.5)*(re+0.5) + im*im, 12) AS k, sqrt(re*re + im*im) AS b FROM r) ORDER BY k, b LIMIT 2"""


for name in dense.BASES:

    @query(f"pep_basis_{name}", nearest_roots(*IN_POWERS[name]))
    def _(spark, sf, name=name):
        t = 3 * np.eye(12) - np.eye(12, k=1) - np.eye(12, k=-1)
        return value_frame(spark, [np.abs(v) for v in polyeigs([5 * t, 10 * t, np.eye(12)], basis=name, nev=2, target=-0.5).values])


for solver in ("rii", "slp", "narnoldi"):

    @query(f"nep_{solver}", answer(LINE, "ln(a)", "abs(b - 1.36)", 1))
    def _(spark, sf, solver=solver):
        """A x = exp(k) x: the logarithms of A's eigenvalues."""
        r = nleigs([(line(spark), scalar.Rational(p=[1.0])), (np.eye(30), scalar.Exp(beta=-1.0))], target=1.36, solver=solver, tol=1e-10)
        return value_frame(spark, r.values)


for solver in ("nleigs", "interpol", "ciss"):

    @query(f"nep_{solver}", answer(LINE, "ln(a)", "abs(b - 1.2)", 3))
    def _(spark, sf, solver=solver):
        region = Ellipse(centre=1.15, radius=0.28, vscale=0.3) if solver == "ciss" else Interval(a=0.9, b=1.4, c=-0.2, d=0.2)
        r = nleigs([(line(spark), scalar.Rational(p=[1.0])), (np.eye(30), scalar.Exp(beta=-1.0))], nev=3, target=1.2, solver=solver, region=region)
        return value_frame(spark, r.values)


for label, options in {"krylov": {"krylov": True}, "krylov_poles": {"krylov": True, "poles": "aaa"}, "full_basis": {"full_basis": True}}.items():

    @query(f"nep_nleigs_{label}", answer(LINE, "ln(a)", "abs(b - 1.2)", 3))
    def _(spark, sf, options=options):
        r = nleigs([(line(spark), scalar.Rational(p=[1.0])), (np.eye(30), scalar.Exp(beta=-1.0))], nev=3, target=1.2, solver="nleigs", region=Interval(a=0.9, b=1.4, c=-0.2, d=0.2), **options)
        return value_frame(spark, r.values)


@query("nep_slp_two_sided", answer(LINE, "ln(a)", "abs(b - 1.36)", 1).replace("AS value FROM", "AS value, 0.0::DOUBLE AS error FROM"))
def _(spark, sf):
    """A x = exp(k) x from both sides, and how far the left vector is from y' A = exp(k) y'."""
    a = line(spark)
    r = nleigs([(a, scalar.Rational(p=[1.0])), (np.eye(30), scalar.Exp(beta=-1.0))], target=1.36, solver="slp", tol=1e-10, two_sided=True)
    off = np.linalg.norm(a.adjoint(r.left) - r.left * np.conj(np.exp(r.values)))
    return value_frame(spark, r.values).withColumn("error", F.round(F.lit(float(off)), 6))


FIRST = np.eye(30)[:, 0]
for label, fn, f in (("exp", scalar.Exp(alpha=-1.0), "exp(-(2-2*cos(pi()*m/31)))"), ("sqrt", scalar.Sqrt(), "sqrt(2-2*cos(pi()*m/31))"), ("invsqrt", scalar.InvSqrt(), "1/sqrt(2-2*cos(pi()*m/31))"), ("phi1", scalar.Phi(k=1), "(exp(2-2*cos(pi()*m/31))-1)/(2-2*cos(pi()*m/31))"), ("log", scalar.Log(), "ln(2-2*cos(pi()*m/31))")):
    query(f"mfn_krylov_{label}", sine_sum(f))(lambda spark, sf, fn=fn: value_frame(spark, funm_multiply(line(spark), fn, FIRST, tol=1e-12).y))
query("mfn_expokit", sine_sum("exp(-(2-2*cos(pi()*m/31)))"))(lambda spark, sf: value_frame(spark, funm_multiply(line(spark), scalar.Exp(alpha=-1.0), FIRST, ncv=12, tol=1e-10, solver="expokit").y))
query(
    "lme_lyapunov",
    "WITH w AS (SELECT unnest(range(1, 31)) AS m), s AS (SELECT m, 2-2*cos(pi()*m/31) AS a, sqrt(2.0/31)*sin(pi()*m/31) AS c FROM w) SELECT CAST(0 AS INTEGER) AS k, round(sum(c*c/(2*a)), 6) AS value FROM s",
)(lambda spark, sf: value_frame(spark, [(solve_equation(-1.0 * line(spark).dense(), FIRST[:, None], tol=1e-12).factor ** 2).sum()]))


def queries() -> dict[str, Query]:
    return _queries | frame_queries.queries


def oracle_sql() -> dict[str, str]:
    return _sql | frame_queries.sql
