"""Where matrices come from: tables, files, and model problems made by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..matrix import checkpointed, combined


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- files ----------------------------------------------------------------------------------


COORDINATES = {"term": "int", "i": "long", "j": "long", "v": "double", "vi": "double"}


def read_coordinates(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """(i, j, v[, vi]) or (term, i, j, v[, vi]) from Parquet, ORC, CSV with a header or JSON. Columns go by name; one that a
    matrix has no use for, or the lack of i, j or v, is an error, and so is a value that is no number."""
    raw = spark.read.format(fmt).option("header", True).option("primitivesAsString", True).load(path)
    unknown, missing = set(raw.columns) - set(COORDINATES), {"i", "j", "v"} - set(raw.columns)
    if unknown or missing:
        raise ValueError(f"coordinates of {path}: unknown columns {sorted(unknown)}, missing columns {sorted(missing)}")
    return raw.select(*[F.col(c).cast(t).alias(c) for c, t in COORDINATES.items() if c in raw.columns])


def read_terms(spark: SparkSession, path: str, fmt: str = "parquet") -> list[DataFrame]:
    """The coefficient matrices of a polynomial, one for each term from 0, of one frame of coordinates with a term."""
    every = read_coordinates(spark, path, fmt)
    top = every.agg(F.max("term")).first()[0]
    return [every.where(F.col("term") == k).drop("term") for k in range(0 if top is None else top + 1)]


MARKET = ("%%matrixmarket", "matrix", "coordinate")
FIELDS, SYMMETRIES = ("real", "integer", "pattern", "complex"), ("general", "symmetric", "skew-symmetric", "hermitian")


def read_matrix_market(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """(i, j, v[, vi]) from 0, with the numbers of rows and columns, of a text in coordinate form: a file, or a folder of which one file has the header. Spark splits it by
    bytes. Symmetric, skew and Hermitian matrices get their other half. A missing or unknown header, an entry with too few or too many numbers or outside
    of the matrix, or another number of entries than announced is an error."""
    lines = spark.read.text(path).select(F.trim("value").alias("value"), F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")).alias("at"))
    heads = lines.where(F.lower("value").startswith(MARKET[0])).limit(2).collect()
    words = heads[0]["value"].lower().split() if len(heads) == 1 else []
    if len(words) != 5 or tuple(words[:3]) != MARKET or words[3] not in FIELDS or words[4] not in SYMMETRIES:
        raise ValueError(f"no coordinate header in {path}: {[r['value'] for r in heads]}")
    said = lines.where(~F.col("value").startswith("%") & (F.col("value") != ""))
    first = said.where(F.col("file") == heads[0]["file"]).agg(F.min(F.struct("at", "value")).alias("m")).first()["m"]
    size = first["value"].split() if first is not None else []
    if len(size) != 3 or not all(w.isdigit() for w in size):
        raise ValueError(f"no line of sizes behind the header of {path}")
    rows, cols, entries = map(int, size)
    wide = 2 + {"pattern": 0, "complex": 2}.get(words[3], 1)
    w = F.split("value", r"\s+")
    i, j = F.try_element_at(w, F.lit(1)).try_cast("long") - 1, F.try_element_at(w, F.lit(2)).try_cast("long") - 1
    values = [F.lit(1.0)] if wide == 2 else [F.try_element_at(w, F.lit(k)).try_cast("double") for k in range(3, wide + 1)]
    fits = (F.size(w) == wide) & (i >= 0) & (i < rows) & (j >= 0) & (j < cols)
    for v in values:
        fits = fits & v.isNotNull()
    entry = F.when(F.coalesce(fits, F.lit(False)), F.struct(i.alias("i"), j.alias("j"), *[v.alias(n) for v, n in zip(values, ("v", "vi"))]))
    checked = F.coalesce(entry, F.raise_error(F.concat(F.lit("no entry: "), "value")).cast(_entry_type(len(values))))
    found = said.where((F.col("file") != heads[0]["file"]) | (F.col("at") != F.struct(F.lit(first["at"]["block"]).alias("block"), F.lit(first["at"]["id"]).alias("id")))).select(checked.alias("e")).select("e.*")
    if (n := found.count()) != entries:
        raise ValueError(f"{n} entries in {path} instead of {entries}")
    if words[4] != "general":
        sign = {"v": -1.0 if words[4] == "skew-symmetric" else 1.0, "vi": 1.0 if words[4] == "symmetric" else -1.0}
        found = found.unionByName(found.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), *[(sign[c] * F.col(c)).alias(c) for c in found.columns[2:]]))
    return found, rows, cols


def _entry_type(values: int) -> str:
    return "struct<i: long, j: long, v: double" + (", vi: double>" if values > 1 else ">")


def write_matrix_market(df: DataFrame, rows: int, cols: int, path: str) -> None:
    """Coordinates as a folder of text files, of which the first has the header; entries at one place stay as they are."""
    df = checkpointed(df.select("i", "j", *[c for c in ("v", "vi") if c in df.columns]))
    head = [f"%%MatrixMarket matrix coordinate {'complex' if 'vi' in df.columns else 'real'} general", f"{rows} {cols} {df.count()}"]
    first = df.sparkSession.createDataFrame([("\n".join(head),)], "value string").coalesce(1)
    entries = df.select(F.concat_ws(" ", (F.col("i") + 1).cast("string"), (F.col("j") + 1).cast("string"), *[F.col(c).cast("string") for c in df.columns[2:]]).alias("value"))
    first.unionByName(entries).write.mode("overwrite").text(path)


def write_frame(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Values, vectors, errors or coordinates to a folder."""
    df.write.mode("overwrite").format(fmt).option("header", True).save(path)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Coordinates from a text edge list, one edge a line numbered from 1, comment lines starting with %. Repeated edges
    count once, a third column is the weight, and every vertex up to the largest number counts."""
    lines = spark.read.text(path).where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    at = F.split(F.trim("value"), r"\s+")
    edges = lines.select((at[0].cast("long") - 1).alias("i"), (at[1].cast("long") - 1).alias("j"), F.coalesce(F.try_element_at(at, F.lit(3)).cast("double"), F.lit(1.0)).alias("v"))
    edges = edges.groupBy("i", "j").agg(F.max("v").alias("v"))
    top = edges.agg(F.max(F.greatest("i", "j"))).first()[0]
    return edges, 0 if top is None else top + 1


# --- tables ---------------------------------------------------------------------------------


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity from suppliers' nations (j) to customers' (i)."""
    lineitem = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("i"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("j"))
    # quantities by order and supplier's nation first: fewer rows meet the orders
    by_order = lineitem.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey", "j").agg(F.sum("l_quantity").alias("q"))
    joined = by_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("i", "j").agg(F.sum("q").cast("double").alias("v"))


def part_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("long").alias("i"), F.col("l_suppkey").cast("long").alias("j"), "l_quantity")
    return q.groupBy("i", "j").agg(F.sum("l_quantity").cast("double").alias("v"))


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of one event type (j) followed by another (i) for the same user, types numbered by name. A user's events are put in order
    day by day, and the last of a day is followed by the first of the user's next day, so that a busy user is many tasks' work."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    events = events.withColumn("day", F.date_trunc("day", "ts"))
    follows = F.lead("event_type").over(W.partitionBy("user_id", "day").orderBy("ts", "event_id"))
    within = events.select("event_type", follows.alias("next"))
    ends = events.groupBy("user_id", "day").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("head"), F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))
    across = ends.select("event_type", F.lead("head").over(W.partitionBy("user_id").orderBy("day")).alias("next"))
    pairs = within.unionByName(across).where(F.col("next").isNotNull()).groupBy("event_type", "next").count()
    names = events.select("event_type").distinct()
    numbered = names.select("event_type", (F.row_number().over(W.orderBy("event_type")) - 1).cast("long").alias("k"))  # one row a type
    a = pairs.join(numbered.withColumnRenamed("k", "j"), "event_type")
    b = a.join(numbered.select(F.col("event_type").alias("next"), F.col("k").alias("i")), "next")
    return b.select("i", "j", F.col("count").cast("double").alias("v"))


def stochastic(df: DataFrame) -> DataFrame:
    """Columns scaled to sum 1."""
    total = df.groupBy("j").agg(F.sum("v").alias("t"))
    return df.join(total, "j").select("i", "j", (F.col("v") / F.col("t")).alias("v"))


def embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, x array<double>, label) of the vectors without nulls; those of different lengths are refused where they are used."""
    rows = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL AND NOT exists(embedding, c -> c IS NULL)")
    return rows.select(F.col("vec_id").cast("long").alias("i"), F.col("embedding").cast("array<double>").alias("x"), "label")


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of words (hashed to 2^20 columns) by document."""
    words = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"), F.explode(F.split(F.lower("text"), r"\s+")).alias("w"))
    return words.groupBy("i", F.pmod(F.xxhash64("w"), F.lit(1 << 20)).alias("j")).agg(F.count(F.lit(1)).cast("double").alias("v"))


# --- model problems ---------------------------------------------------------------------------


def stencil(spark: SparkSession, shape: tuple[int, ...]) -> DataFrame:
    """The Laplacian of a grid: twice the dimensions on the diagonal, -1 for each neighbour."""
    total = 1
    for s in shape:
        total *= s
    entries: list[Column] = [F.struct(F.col("id").alias("j"), F.lit(2.0 * len(shape)).alias("v"))]
    stride = 1
    for s in shape:
        place = F.floor(F.col("id") / stride) % s
        entries.append(F.when(place > 0, F.struct((F.col("id") - stride).alias("j"), F.lit(-1.0).alias("v"))))
        entries.append(F.when(place < s - 1, F.struct((F.col("id") + stride).alias("j"), F.lit(-1.0).alias("v"))))
        stride *= s
    cells = spark.range(total).select(F.col("id").alias("i"), F.explode(F.array_compact(F.array(*entries))).alias("e"))
    return cells.select("i", "e.j", "e.v")


def banded(spark: SparkSession, n: int, bands: dict[int, float], cols: int | None = None) -> DataFrame:
    """Constant diagonals: v at (i, i + offset)."""
    m = n if cols is None else cols
    entries = [F.struct((F.col("id") + k).alias("j"), F.lit(float(v)).alias("v")) for k, v in bands.items()]
    cells = spark.range(n).select(F.col("id").alias("i"), F.explode(F.array(*entries)).alias("e")).select("i", "e.j", "e.v")
    return cells.where((F.col("j") >= 0) & (F.col("j") < m))


def grcar(spark: SparkSession, n: int) -> DataFrame:
    return banded(spark, n, {-1: -1, 0: 1, 1: 1, 2: 1, 3: 1})


def lauchli(spark: SparkSession, n: int, mu: float) -> DataFrame:
    """A row of ones over mu times the identity, (n + 1) x n."""
    top = spark.range(n).select(F.lit(0).cast("long").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))
    return top.unionByName(spark.range(n).select((F.col("id") + 1).alias("i"), F.col("id").alias("j"), F.lit(float(mu)).alias("v")))


def random_walk(spark: SparkSession, m: int) -> DataFrame:
    """Steps of a random walk on a triangular grid with m points a side: v is the probability of going from i to j. Points (x, y),
    x + y < m, are numbered along y first. Toward the origin the chance is high near it; what is left is dealt evenly outward, doubled on the axes."""
    grid = spark.range(m).select(F.col("id").alias("x")).select("x", F.explode(F.sequence(F.lit(0).cast("long"), m - 1 - F.col("x"))).alias("y"))
    number = lambda x, y: x * m - (x * (x - 1) / 2).cast("long") + y
    x, y = F.col("x"), F.col("y")
    out = 0.5 / (m - 1) * (x + y + 1)
    back = 0.5 - 0.5 / (m - 1) * (x + y - 1)
    inside = x + y < m - 1
    step = lambda test, a, b, p: F.when(test, F.struct(number(a, b).cast("long").alias("j"), p.alias("v")))
    moves = F.array_compact(
        F.array(
            step(inside, x, y + 1, F.when(x == 0, 2 * out).otherwise(out)), step(inside, x + 1, y, F.when(y == 0, 2 * out).otherwise(out)),
            step(y > 0, x, y - 1, back), step(x > 0, x - 1, y, back),
        )
    )
    return grid.select(number(x, y).cast("long").alias("i"), F.explode(moves).alias("e")).select("i", "e.j", "e.v")


def graph_laplacian(edges: DataFrame) -> DataFrame:
    """Degrees less adjacency of symmetric coordinates."""
    degree = edges.groupBy("i").agg(F.sum("v").alias("v")).select("i", F.col("i").alias("j"), "v")
    return combined([(1.0, degree), (-1.0, edges.select("i", "j", "v"))])


def laplacian_entries(half: DataFrame) -> DataFrame:
    """The Laplacian of edges that are each given once, as entries that add up by place: neither joined nor shuffled."""
    i, j, v = F.col("i"), F.col("j"), F.col("v")
    entry = lambda a, b, x: F.struct(a.alias("i"), b.alias("j"), x.alias("v"))
    return half.select(F.inline(F.array(entry(i, j, -v), entry(j, i, -v), entry(i, i, v), entry(j, j, v))))


def identity(spark: SparkSession, n: int, scale: float = 1.0) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(float(scale)).alias("v"))


def proximity_pair(edges: DataFrame, n: int, beta: float) -> tuple[DataFrame, DataFrame]:
    """I - beta A and beta A, of which the generalised singular values embed a directed graph."""
    spark = edges.sparkSession
    return combined([(1.0, identity(spark, n)), (-beta, edges)]), combined([(beta, edges)])
