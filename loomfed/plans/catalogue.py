"""The registered queries over the fixture tables and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import elementwise as E
from ..operators import codec, coo, coordination, exchange, federated, health, models, peers, timers, vector_index
from ..operators.coo import Coo
from ..operators.joins import dealt_join
from ..sources.tables import events, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def keep(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


# --- element-wise operators and activations over lineitem -------------------------------------------------

KEY = ("l_orderkey", "l_linenumber")


class _Line:
    """The columns that the element-wise queries use; made when a session is there."""

    def __init__(self) -> None:
        self.qty, self.price, self.disc, self.tax = (F.col(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
        self.unit = (self.qty - F.lit(25.0)) / F.lit(10.0)


UNIT_SQL = "((l_quantity - 25.0) / 10.0)"

#: Name -> (expression, SQL, decimals or None for exact results)
ELEMENTWISE: dict[str, tuple[Callable[[_Line], Column], str, int | None]] = {
    "add": (lambda t: E.add(t.price, t.qty), "l_extendedprice + l_quantity", None),
    "sub": (lambda t: E.sub(t.price, t.qty), "l_extendedprice - l_quantity", None),
    "mul": (lambda t: E.mul(t.price, t.tax) + 0.0, "l_extendedprice * l_tax + 0.0", None),
    "div": (lambda t: E.div(t.qty, E.abs(t.disc)), "CASE WHEN l_discount = 0 THEN 'inf'::DOUBLE ELSE l_quantity / abs(l_discount) END", None),
    "pow": (lambda t: E.pow(t.disc + 0.5, t.tax + 1.5), "pow(l_discount + 0.5, l_tax + 1.5)", 9),
    "neg": (lambda t: E.neg(t.price), "-l_extendedprice", None),
    "abs": (lambda t: E.abs(t.unit), f"abs({UNIT_SQL})", None),
    "sqrt": (lambda t: E.sqrt(t.price), "sqrt(l_extendedprice)", None),
    "exp": (lambda t: E.exp(t.disc), "exp(l_discount)", 9),
    "log": (lambda t: E.log(t.qty - 1), "CASE WHEN l_quantity = 1 THEN '-inf'::DOUBLE ELSE ln(l_quantity - 1) END", 9),
    "identity": (lambda t: E.identity(t.price), "l_extendedprice", None),
    "equal": (lambda t: E.equal(t.disc + 0.0, t.tax + 0.0), "(l_discount + 0.0 = l_tax + 0.0)::INT::DOUBLE", None),
    "greater": (lambda t: E.greater(t.disc, t.tax), "(l_discount > l_tax)::INT::DOUBLE", None),
    "less": (lambda t: E.less(t.disc, t.tax), "(l_discount < l_tax)::INT::DOUBLE", None),
    "where": (lambda t: E.where(E.greater(t.qty, F.lit(25.0)), t.price, E.neg(t.price)), "CASE WHEN l_quantity > 25 THEN l_extendedprice ELSE -l_extendedprice END", None),
    "relu": (lambda t: E.relu(t.unit), f"greatest({UNIT_SQL}, 0.0)", None),
    "sigmoid": (lambda t: E.sigmoid(t.unit), f"1 / (1 + exp(-{UNIT_SQL}))", 9),
    "tanh": (lambda t: E.tanh(t.unit), f"(exp(2*{UNIT_SQL}) - 1) / (exp(2*{UNIT_SQL}) + 1)", 9),
    "gelu": (lambda t: E.gelu(t.unit), f"0.5*{UNIT_SQL}*(1 + (1 - 2/(exp(2*0.7978845608028654*({UNIT_SQL} + 0.044715*pow({UNIT_SQL}, 3))) + 1)))", 9),
    "leaky_relu": (lambda t: E.leaky_relu(t.unit), f"CASE WHEN {UNIT_SQL} >= 0 THEN {UNIT_SQL} ELSE 0.01 * {UNIT_SQL} END", None),
}


def _elementwise(name: str, expr: Callable[[_Line], Column], sql: str, places: int | None) -> None:
    out_sql = f"({sql})" if places is None else f"round({sql}, {places})"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = expr(_Line())
        return table(spark, sf_dir, "lineitem").select(*KEY, ((out if places is None else F.round(out, places)) + F.lit(0.0)).alias("v"))

    QUERIES[name] = run
    SQL[name] = f"SELECT l_orderkey, l_linenumber, {out_sql} + 0.0 AS v FROM lineitem"


for _name, (_expr, _sql, _places) in ELEMENTWISE.items():
    _elementwise(_name, _expr, _sql, _places)


@query(
    "array_ops",
    """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS dot,
              round(list_sum(list_transform(embedding, lambda x: greatest(x::DOUBLE + 1.0, 0))), 6) AS shifted, 64 AS n FROM embeddings""",
)
def array_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    shifted = E.over_array(E.relu, E.over_arrays(E.add, v, E.ones_array(1)))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(E.dot_arrays(v, v), 6).alias("dot"), F.round(F.aggregate(shifted, F.lit(0.0), lambda s, x: s + x), 6).alias("shifted"), F.size(E.zeros_array(64)).alias("n"))


# --- long-form tensors over embeddings --------------------------------------------------------------------

#: The embeddings as elements (i0 = place by id, i1 = component).
FLAT_SQL = """m AS (SELECT i0, generate_subscripts(embedding, 1) - 1 AS i1, unnest(embedding)::DOUBLE AS v
     FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i0, embedding FROM embeddings))"""


def _matrix(spark: SparkSession, sf_dir: str) -> Coo:
    numbered, rows = models.BatchSource(table(spark, sf_dir, "embeddings"), ["vec_id"], 1).numbered()
    return coo.from_arrays(numbered, "embedding", "position", rows, 64)


def _tensor_query(name: str, sql: str, fn: Callable[[Coo], Coo], places: int = 6) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = fn(_matrix(spark, sf_dir))
        return out.df.select(*out.index, (F.round("v", places) + F.lit(0.0)).alias("v"))

    QUERIES[name] = run
    SQL[name] = f"WITH {FLAT_SQL} {sql}"


def _gram(m: Coo) -> Coo:
    return coo.matmul(coo.transpose(m), m)


GRAM_SQL = "SELECT a.i1 AS i0, b.i1 AS i1, sum(a.v * b.v) AS v FROM m a JOIN m b ON a.i0 = b.i0 GROUP BY ALL"
ROUND = "round(v, 6) + 0.0 AS v"

_tensor_query("matmul", f"SELECT i0, i1, {ROUND} FROM ({GRAM_SQL})", _gram)
_tensor_query(
    "gemm",
    f""", g AS ({GRAM_SQL}), c AS (SELECT i1, avg(v) AS c FROM m GROUP BY i1)
    SELECT g.i0, g.i1, round(0.5 * g.v + 2.0 * c.c, 6) + 0.0 AS v FROM g JOIN c ON g.i1 = c.i1""",
    lambda m: coo.gemm(m, m, coo.reduce_mean(m, [0]), alpha=0.5, beta=2.0, trans_a=True),
)
_tensor_query("dot", "SELECT i0, round(sum(v * v), 6) AS v FROM m GROUP BY i0", lambda m: coo.dot(m, m))
_tensor_query("reduce_sum", "SELECT i0, round(sum(v), 6) + 0.0 AS v FROM m GROUP BY i0", lambda m: coo.reduce_sum(m, [1]))
_tensor_query("reduce_mean", "SELECT 0 AS i0, i1, round(avg(v), 6) + 0.0 AS v FROM m GROUP BY i1", lambda m: coo.reduce_mean(m, [0], keepdims=True))
_tensor_query("reduce_max", "SELECT i1 AS i0, round(max(v), 6) + 0.0 AS v FROM m GROUP BY i1", lambda m: coo.reduce_max(m, [0]))
_tensor_query("reduce_min", "SELECT round(min(v), 6) + 0.0 AS v FROM m", coo.reduce_min)
_tensor_query(
    "global_average_pool",
    "SELECT i0, i1 // 16 AS i1, 0 AS i2, 0 AS i3, round(avg(v), 6) + 0.0 AS v FROM m GROUP BY ALL",
    lambda m: coo.global_average_pool(coo.reshape(m, (-1, 4, 4, 4))),
)
_tensor_query("softmax", "SELECT i0, i1, round(exp(v) / sum(exp(v)) OVER (PARTITION BY i0), 9) AS v FROM m", lambda m: coo.softmax(m, -1), 9)
_tensor_query("reshape", f"SELECT i0 * 8 + i1 // 8 AS i0, i1 % 8 AS i1, {ROUND} FROM m", lambda m: coo.reshape(m, (-1, 8)))
_tensor_query("transpose", f"SELECT i1 AS i0, i0 AS i1, {ROUND} FROM m", coo.transpose)
_tensor_query("concat", f"SELECT i0, i1, {ROUND} FROM m UNION ALL SELECT i0, i1 + 64, round(v * 2, 6) + 0.0 FROM m", lambda m: coo.concat([m, coo.unary(m, lambda v: v * 2)], 1))
_tensor_query("slice", f"SELECT i0, (i1 - 8) // 3 AS i1, {ROUND} FROM m WHERE i1 >= 8 AND i1 < 60 AND (i1 - 8) % 3 = 0", lambda m: coo.slice(m, [8], [-4], axes=[1], steps=[3]))
_tensor_query("split", f"SELECT i0, i1 - 16 AS i1, {ROUND} FROM m WHERE i1 >= 16 AND i1 < 40", lambda m: coo.split(m, [16, 24, 24], 1)[1])
_tensor_query("squeeze", "SELECT i0, round(sum(v), 6) + 0.0 AS v FROM m GROUP BY i0", lambda m: coo.squeeze(coo.reduce_sum(m, [1], keepdims=True)))
_tensor_query("unsqueeze", f"SELECT i0, 0 AS i1, i1 AS i2, {ROUND} FROM m", lambda m: coo.unsqueeze(m, [1]))
_tensor_query("cast", "SELECT i0, i1, trunc(v * 100) + 0.0 AS v FROM m", lambda m: coo.cast(coo.unary(m, lambda v: v * 100), "int"))
_tensor_query("batch_normalization", "SELECT i0, i1, round((v - avg(v) OVER w) / sqrt(var_pop(v) OVER w + 1e-5) * 2.0 + 0.5, 6) + 0.0 AS v FROM m WINDOW w AS (PARTITION BY i1)", lambda m: _batch_norm(m))
_tensor_query("layer_normalization", "SELECT i0, i1, round((v - avg(v) OVER w) / sqrt(var_pop(v) OVER w + 1e-5), 6) + 0.0 AS v FROM m WINDOW w AS (PARTITION BY i0)", coo.layer_normalization)
_tensor_query("max_pool", "SELECT i0, p AS i1, round(max(v), 6) + 0.0 AS v FROM m, range(31) t(p) WHERE i1 BETWEEN 2 * p AND 2 * p + 3 GROUP BY i0, p", lambda m: coo.max_pool(m, 4, 2))
_tensor_query("average_pool", "SELECT i0, i1 // 4 AS i1, round(avg(v), 6) + 0.0 AS v FROM m GROUP BY ALL", lambda m: coo.average_pool(m, 4))
#: The first eight columns, negated, go to the columns 0, 3, ... 21, and in odd rows to the last one, the fourth last and so on.
_tensor_query(
    "scatter",
    """, u AS (SELECT i0, CASE WHEN i0 % 2 = 1 THEN 63 - 3 * i1 ELSE 3 * i1 END AS to_i, -v AS w FROM m WHERE i1 < 8)
    SELECT m.i0, i1, round(coalesce(w, v), 6) + 0.0 AS v FROM m LEFT JOIN u ON m.i0 = u.i0 AND i1 = to_i""",
    lambda m: _scattered(m),
)
_tensor_query(
    "layer_normalization_scaled",
    "SELECT i0, i1, round((v - avg(v) OVER w) / sqrt(var_pop(v) OVER w + 1e-5) * (1 + i1 / 64) + (i1 - 32), 6) + 0.0 AS v FROM m WINDOW w AS (PARTITION BY i0)",
    lambda m: _layer_norm(m),
)
_tensor_query(
    "max_pool_2d",
    """SELECT i0, 0 AS i1, p AS i2, q AS i3, round(max(v), 6) + 0.0 AS v FROM m, range(4) a(p), range(5) b(q)
    WHERE i1 // 8 + 1 BETWEEN 2 * p AND 2 * p + 2 AND i1 % 8 + 1 BETWEEN 2 * q AND 2 * q + 1 GROUP BY i0, p, q""",
    lambda m: coo.max_pool(coo.reshape(m, (-1, 1, 8, 8)), (3, 2), (2, 2), (1, 1, 0, 1)),
)
_tensor_query(
    "average_pool_2d",
    """SELECT i0, 0 AS i1, p AS i2, q AS i3, round(sum(v) / 9, 6) + 0.0 AS v FROM m, range(8) a(p), range(4) b(q)
    WHERE abs(i1 // 8 - p) <= 1 AND abs(i1 % 8 - 2 * q) <= 1 GROUP BY i0, p, q""",
    lambda m: coo.average_pool(coo.reshape(m, (-1, 1, 8, 8)), (3, 3), (1, 2), (1, 1, 1, 1), count_include_pad=True),
)
_tensor_query(
    "conv",
    """, x AS (SELECT i0, i1 // 16 AS c, (i1 % 16) // 4 AS y, i1 % 4 AS z, v FROM m),
    w AS (SELECT o, lc, a, b, (o - lc + 2.0 * a - b) AS w, o // 3 AS g FROM range(6) t1(o), range(2) t2(lc), range(2) t3(a), range(2) t4(b)),
    k AS (SELECT i0, o, y + 1 - 2 * a AS p, z + 1 - b AS q, v * w AS v FROM x JOIN w ON c // 2 = g AND c % 2 = lc)
    SELECT i0, o AS i1, p AS i2, q // 2 AS i3, round(sum(v) + o * 0.5, 6) + 0.0 AS v FROM k WHERE p BETWEEN 0 AND 3 AND q >= 0 AND q % 2 = 0 AND q < 6 GROUP BY i0, o, p, q // 2""",
    lambda m: _conv_2d(m),
)


def _scattered(m: Coo) -> Coo:
    few = coo.slice(m, [0], [8], axes=[1])
    odd = F.col("i0") % 2 == 1
    places = Coo(few.df.withColumn("v", F.when(odd, -1.0 - 3 * F.col("i1")).otherwise(3.0 * F.col("i1"))), few.dims)
    return coo.scatter(m, places, coo.unary(few, lambda v: -v), axis=1)


def _layer_norm(m: Coo) -> Coo:
    spark = m.df.sparkSession
    return coo.layer_normalization(m, coo.constant(spark, [1 + k / 64 for k in range(64)], (64,)), coo.constant(spark, [k - 32 for k in range(64)], (64,)))


def _conv_2d(m: Coo) -> Coo:
    """Four channels of 4 x 4 in two groups, three kernels of 2 x 2 a group."""
    spark = m.df.sparkSession
    kernel = [o - c + 2.0 * a - b for o in range(6) for c in range(2) for a in range(2) for b in range(2)]
    bias = coo.constant(spark, [o * 0.5 for o in range(6)], (6,))
    return coo.conv(coo.reshape(m, (-1, 4, 4, 4)), coo.constant(spark, kernel, (6, 2, 2, 2)), bias, strides=(1, 2), pads=(1, 1, 1, 1), dilations=(2, 1), group=2)


def _batch_norm(m: Coo) -> Coo:
    params = m.df.groupBy(F.col("i1").alias("c")).agg(F.avg("v").alias("mean"), F.var_pop("v").alias("var")).withColumns({"scale": F.lit(2.0), "bias": F.lit(0.5)})
    return coo.batch_normalization(m, params)


@query("gather", f"WITH {FLAT_SQL}, p AS (SELECT * FROM (VALUES (0, 3), (1, 3), (2, 60), (3, 0)) t(pos, idx)) SELECT i0, p.pos AS i1, {ROUND} FROM m JOIN p ON m.i1 = p.idx")
def gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    picks = spark.createDataFrame([(0, 3), (1, 3), (2, 60), (3, 0)], "pos int, idx int")
    out = coo.gather(_matrix(spark, sf_dir), picks, 4, axis=1)
    return out.df.select("i0", "i1", (F.round("v", 6) + 0.0).alias("v"))


@query(
    "conv1d",
    f"""WITH {FLAT_SQL} SELECT i0, 0 AS i1, (i1 + 1 - k) // 2 AS i2, round(sum(v * (k - 1.0)), 6) + 0.0 AS v
    FROM m, range(3) t(k) WHERE i1 + 1 - k >= 0 AND (i1 + 1 - k) % 2 = 0 AND i1 + 1 - k < 64 GROUP BY ALL""",
)
def conv1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    kernel = coo.constant(spark, [-1.0, 0.0, 1.0], (1, 1, 3))
    out = coo.conv(coo.unsqueeze(_matrix(spark, sf_dir), [1]), kernel, strides=2, pads=1)
    return out.df.select("i0", "i1", "i2", (F.round("v", 6) + 0.0).alias("v"))


@query("constants", "SELECT i AS i0, j AS i1, (CASE WHEN i = 0 THEN 0.0 WHEN i = 1 THEN 1.0 ELSE j + 1.0 END)::DOUBLE AS v FROM range(3) a(i), range(4) b(j)")
def constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [coo.zeros(spark, (1, 4)), coo.ones(spark, (1, 4)), coo.constant(spark, [1, 2, 3, 4], (1, 4))]
    return coo.concat(rows, 0).df


@query("if_loop", f"WITH {FLAT_SQL} SELECT i1 AS i0, round(sum(v) * 8, 6) + 0.0 AS v FROM m GROUP BY i1")
def if_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = coo.reduce_sum(_matrix(spark, sf_dir), [0])
    out = coo.loop(10, start, lambda k, t: coo.if_(k < 3, lambda: coo.unary(t, lambda v: v * 2), lambda: t), lambda k, t: k < 9)
    return out.df.select("i0", (F.round("v", 6) + 0.0).alias("v"))


# --- federated averaging ----------------------------------------------------------------------------------

@query("fedavg", "SELECT 0 AS round, i, round(sum(v * n) / sum(n), 9) AS v, sum(n)::BIGINT AS num_samples FROM (SELECT label, i, avg(v) AS v, count(*) AS n FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY ALL) GROUP BY i")
def fedavg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label is a peer that contributes the mean of its vectors, weighted by their number."""
    flat = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    local = flat.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("v"), F.count(F.lit(1)).alias("num_samples"))
    rows = local.select(F.lit(0).alias("round"), F.col("label").cast("string").alias("peer"), F.lit(0).alias("seq"), "i", "v", "num_samples")
    return federated.fedavg(rows).withColumn("v", F.round("v", 9))


def _contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers contribute their orders' prices by year; some contribute again, some have no samples."""
    return table(spark, sf_dir, "orders").select(
        F.year("o_orderdate").alias("round"), F.col("o_custkey").alias("peer"), F.col("o_orderkey").alias("seq"), F.lit(0).alias("i"),
        F.col("o_totalprice").alias("v"), F.pmod("o_orderkey", F.lit(4)).alias("num_samples"),
    )


CONTRIBUTIONS_SQL = """c AS (SELECT year(o_orderdate) AS round, o_custkey AS peer, o_orderkey AS seq, 0 AS i, o_totalprice AS v, o_orderkey % 4 AS num_samples FROM orders),
 good AS (SELECT * FROM c WHERE num_samples > 0 QUALIFY row_number() OVER (PARTITION BY round, peer ORDER BY seq DESC) = 1)"""


@query("fedavg_rounds", f"WITH {CONTRIBUTIONS_SQL} SELECT round, i, round(sum(v * num_samples) / sum(num_samples), 4) AS v, sum(num_samples)::BIGINT AS num_samples FROM good GROUP BY ALL")
def fedavg_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return federated.fedavg(_contributions(spark, sf_dir)).withColumn("v", F.round("v", 4))


@query("fedavg_rejected", f"WITH {CONTRIBUTIONS_SQL} SELECT round, count(*) AS n, 'BadInput' AS reason FROM c WHERE num_samples <= 0 GROUP BY round")
def fedavg_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return federated.contribute(_contributions(spark, sf_dir))[1].groupBy("round", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("fedavg_hierarchical", f"WITH {CONTRIBUTIONS_SQL} SELECT round, i, round(sum(v * num_samples) / sum(num_samples), 4) AS v, sum(num_samples)::BIGINT AS num_samples FROM good GROUP BY ALL")
def fedavg_hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = federated.contribute(_contributions(spark, sf_dir))[0].withColumn("group", F.pmod("peer", F.lit(7)))
    return federated.hierarchical(good, "group").withColumn("v", F.round("v", 4))


@query("fedavg_nan", "WITH c AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS round, o_custkey AS peer, o_orderkey AS seq, CASE WHEN o_orderkey % 97 = 0 THEN 'nan'::DOUBLE WHEN o_orderkey % 89 = 0 THEN 'inf'::DOUBLE ELSE o_totalprice END AS v FROM orders), g AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY round, peer ORDER BY seq DESC) = 1) SELECT round, isnan(sum(v)) AS is_nan, isinf(sum(v)) AS is_inf, count(*) AS num_samples FROM g GROUP BY round")
def fedavg_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NaN and infinity poison the rounds that they come in, and no others."""
    price = F.when(F.col("o_orderkey") % 97 == 0, float("nan")).when(F.col("o_orderkey") % 89 == 0, float("inf")).otherwise(F.col("o_totalprice"))
    rows = table(spark, sf_dir, "orders").select(
        (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("round"), F.col("o_custkey").alias("peer"), F.col("o_orderkey").alias("seq"), F.lit(0).alias("i"), price.alias("v"), F.lit(1).alias("num_samples"),
    )
    return federated.fedavg(rows).select("round", F.isnan("v").alias("is_nan"), (F.abs("v") == float("inf")).alias("is_inf"), "num_samples")


# --- vector index, codec, model, batches ------------------------------------------------------------------

def _distance_sql(a: str, b: str) -> str:
    return f"sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda p: pow(p[1]::DOUBLE - p[2]::DOUBLE, 2))))"


def _knn_sql(index: str) -> str:
    return f"""WITH ix AS ({index}), d AS (SELECT q.vec_id AS query_id, v.vec_id, {_distance_sql('v.embedding', 'q.embedding')} AS distance FROM embeddings q, ix v WHERE q.vec_id % 50 = 0)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank, vec_id, round(distance, 6) AS distance FROM d
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= 5"""


def _queries(v: DataFrame) -> DataFrame:
    return v.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")


@query("index_search", _knn_sql("SELECT * FROM embeddings"))
def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return vector_index.search(v, _queries(v), 5).withColumn("distance", F.round("distance", 6))


@query("index_remove", _knn_sql("SELECT * FROM embeddings WHERE label <> 3"))
def index_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return vector_index.search(vector_index.remove(v, v.filter("label = 3")), _queries(v), 5).withColumn("distance", F.round("distance", 6))


@query("index_add", "SELECT vec_id, label, 64 AS dim FROM embeddings UNION ALL SELECT vec_id + 1000000, label, 64 FROM embeddings WHERE label = 1")
def index_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    new = v.filter("label = 1").withColumn("vec_id", F.col("vec_id") + 1000000).unionByName(v.filter("label = 2"))
    return vector_index.add(v, new).select("vec_id", "label", F.size("embedding").alias("dim"))


@query("index_ivf", _knn_sql("SELECT * FROM embeddings"))
def index_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return vector_index.search_ivf(v, _queries(v), vector_index.train(v, 8), 5, probes=4).withColumn("distance", F.round("distance", 6))


CODEC_SQL = f"""WITH {FLAT_SQL.replace('SELECT i0, generate', 'SELECT i0, vec_id, generate').replace('AS i0, embedding FROM', 'AS i0, vec_id, embedding FROM')},
 c AS (SELECT i1, min(v) AS lo, (max(v) - min(v)) / 255 AS scale FROM m GROUP BY i1),
 e AS (SELECT vec_id, m.i1, lo, scale, CASE WHEN scale = 0 THEN 0 ELSE least(greatest(floor((v - lo) / scale + 0.5), 0), 255) END::INT AS q FROM m JOIN c ON m.i1 = c.i1)"""


@query("codec_encode", CODEC_SQL + " SELECT vec_id, i1 AS i, q FROM e")
def codec_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return codec.encode(v, codec.train(v)).select("vec_id", F.posexplode("code").alias("i", "q"))


@query("codec_decode", CODEC_SQL + " SELECT vec_id, i1 AS i, round(lo + q * scale, 6) + 0.0 AS v FROM e")
def codec_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    c = codec.train(v)
    return codec.decode(codec.encode(v, c), c).select("vec_id", F.posexplode("decoded").alias("i", "x")).select("vec_id", "i", (F.round("x", 6) + 0.0).alias("v"))


MODEL = models.LinearModel({"l_quantity": 1500.0, "l_discount": -2000.0}, 100.0)
MODEL_SQL = "(100.0 + 1500.0 * l_quantity + -2000.0 * l_discount)"


@query("model_forward", f"SELECT l_orderkey, l_linenumber, round({MODEL_SQL}, 4) AS prediction FROM lineitem")
def model_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MODEL.forward(table(spark, sf_dir, "lineitem")).select(*KEY, F.round("prediction", 4).alias("prediction"))


@query("model_loss", f"SELECT round(avg(pow({MODEL_SQL} - l_extendedprice, 2)) / 1e6, 4) AS loss FROM lineitem")
def model_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MODEL.compute_loss(table(spark, sf_dir, "lineitem"), "l_extendedprice").select(F.round(F.col("loss") / 1e6, 4).alias("loss"))


@query("model_backward", f"SELECT round(2 * avg({MODEL_SQL} - l_extendedprice), 3) AS bias, round(2 * avg(({MODEL_SQL} - l_extendedprice) * l_quantity), 3) AS l_quantity, round(2 * avg(({MODEL_SQL} - l_extendedprice) * l_discount), 3) AS l_discount FROM lineitem")
def model_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    grad = MODEL.backward(table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return grad.select(*[F.round(c, 3).alias(c) for c in grad.columns])


@query("model_apply_delta", "SELECT l_orderkey, l_linenumber, round(150.0 + 1510.0 * l_quantity - 2000.0 * l_discount, 4) AS prediction FROM lineitem")
def model_apply_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = MODEL.apply_delta({"bias": 50.0, "l_quantity": 10.0})
    same = models.LinearModel({}).load_parameters(moved.params())
    return same.forward(table(spark, sf_dir, "lineitem")).select(*KEY, F.round("prediction", 4).alias("prediction"))


@query("model_fit", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem")
def model_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = models.fit_line(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")
    return line.select(F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query("next_batch", "SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS batch_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS position, o_orderkey FROM orders")
def next_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.BatchSource(table(spark, sf_dir, "orders"), ["o_orderkey"], 1000).batches().select("batch_id", "position", "o_orderkey")


@query("data_loaded", "SELECT count(*) AS rows, ceil(count(*) / 1000)::BIGINT AS batches FROM orders")
def data_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.BatchSource(table(spark, sf_dir, "orders"), ["o_orderkey"], 1000).reset().on_data_loaded()


# --- peers ------------------------------------------------------------------------------------------------

EV_SQL = "ev AS (SELECT event_id AS id, epoch_us(ts) * 1000 AS ts_ns, user_id AS peer, event_type, value, event_type <> 'error' AS ok FROM events)"
HOUR_NS = 3_600_000_000_000
NOW_NS = 1_706_400_000_000_000_000  # 2024-01-28 00:00 UTC


@query("select_random", "SELECT peer FROM (SELECT DISTINCT user_id AS peer, md5('7|' || user_id) AS h FROM events ORDER BY h LIMIT 20)")
def select_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peers.select_random(events(spark, sf_dir), 20, 7)


@query("select_near", "SELECT peer FROM (SELECT DISTINCT user_id AS peer FROM events) ORDER BY xor(peer, 37), peer LIMIT 10")
def select_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peers.select_near(events(spark, sf_dir), 37, 10)


@query("current_view", "SELECT DISTINCT user_id AS peer FROM events")
def current_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peers.current_view(events(spark, sf_dir))


def _announces(spark: SparkSession, sf_dir: str) -> DataFrame:
    address = F.array(F.concat(F.lit("/p2p/"), F.col("peer")))
    return events(spark, sf_dir).withColumn("addresses", F.when(F.col("event_type") == "error", F.array().cast("array<string>")).otherwise(address))


REGISTRY_SQL = f"{EV_SQL}, reg AS (SELECT peer, max(ts_ns) AS last_ns, max(ts_ns) + {24 * HOUR_NS} AS expires_ns FROM ev WHERE ok GROUP BY peer)"


@query("registry", f"WITH {REGISTRY_SQL} SELECT * FROM reg WHERE expires_ns > {NOW_NS}")
def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peers.live(peers.register(_announces(spark, sf_dir), 24 * HOUR_NS)[0], NOW_NS)


@query("registry_rejected", f"WITH {EV_SQL} SELECT id, peer, 'BadInput' AS reason FROM ev WHERE NOT ok")
def registry_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peers.register(_announces(spark, sf_dir))[1].select("id", "peer", "reason")


@query("registry_sample", f"WITH {REGISTRY_SQL} SELECT peer FROM reg WHERE expires_ns > {NOW_NS} ORDER BY md5('3|' || peer), peer LIMIT 15")
def registry_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peers.registry_sample(peers.register(_announces(spark, sf_dir), 24 * HOUR_NS)[0], NOW_NS, 15, 3)


@query(
    "constant_view",
    """WITH v AS (SELECT DISTINCT unnest([5, 3, 3, 9, 12, 7])::BIGINT AS peer)
    SELECT 'random' AS kind, peer FROM (SELECT peer FROM v ORDER BY md5('11|' || peer), peer LIMIT 3)
    UNION ALL SELECT 'near', peer FROM (SELECT peer FROM v ORDER BY xor(peer, 13), peer LIMIT 2) UNION ALL SELECT 'all', peer FROM v""",
)
def constant_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = peers.ConstantView(spark, [5, 3, 3, 9, 12, 7])
    parts = [("random", view.random(3, 11)), ("near", view.near(13, 2)), ("all", view.current())]
    return reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("kind"), "peer") for kind, df in parts])


@query("handshake", "SELECT DISTINCT user_id AS peer, 90000000000 AS ttl_ns, 30000000000 AS heartbeat_ns, 'server' AS server, '/a,/b' AS addresses FROM events")
def handshake(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = peers.handshake(peers.current_view(events(spark, sf_dir)), addresses=["/a", "/b"])
    return answers.withColumn("addresses", F.array_join("addresses", ","))


@query(
    "handshake_merge",
    """WITH b AS (SELECT s_nationkey AS client, 'p' || (s_suppkey % 3) AS peer, list_sort(list_distinct(list('/p2p/' || (s_suppkey % 10)))) AS addresses, count(*) AS refs FROM supplier WHERE s_nationkey < 20 GROUP BY ALL),
    a AS (SELECT n_nationkey AS client, 'p0' AS peer, ['/p2p/3', '/srv'] AS new FROM nation WHERE n_nationkey % 2 = 0)
    SELECT coalesce(a.client, b.client) AS client, coalesce(a.peer, b.peer) AS peer, coalesce(refs, 0) + (new IS NOT NULL)::INT AS refs,
           array_to_string(list_concat(coalesce(addresses, []), list_filter(coalesce(new, []), lambda x: NOT list_contains(coalesce(addresses, []), x))), ',') AS addresses
    FROM b FULL JOIN a ON a.client = b.client AND a.peer = b.peer""",
)
def handshake_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second nation hears from the server ``p0``; the others get an answer without addresses."""
    rows = table(spark, sf_dir, "supplier").filter("s_nationkey < 20").select(F.col("s_nationkey").alias("client"), F.concat(F.lit("p"), F.col("s_suppkey") % 3).alias("peer"), F.concat(F.lit("/p2p/"), F.col("s_suppkey") % 10).alias("address"))
    books = rows.groupBy("client", "peer").agg(F.sort_array(F.collect_set("address")).alias("addresses"), F.count(F.lit(1)).alias("refs"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("peer"))
    answers = peers.handshake(nations.filter("peer % 2 = 0"), server="p0", addresses=["/p2p/3", "/srv"]).unionByName(peers.handshake(nations.filter("peer % 2 = 1"), server="p0"))
    return peers.merge_handshakes(books, answers).withColumn("addresses", F.array_join("addresses", ","))


@query(
    "announce_throttle",
    f"""WITH RECURSIVE {EV_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY peer ORDER BY ts_ns, id) AS rn FROM ev),
    f AS (SELECT peer, rn, id, ts_ns AS last, true AS sent FROM o WHERE rn = 1 UNION ALL
      SELECT o.peer, o.rn, o.id, CASE WHEN o.ts_ns - f.last >= {24 * HOUR_NS} THEN o.ts_ns ELSE f.last END, o.ts_ns - f.last >= {24 * HOUR_NS} FROM f JOIN o ON o.peer = f.peer AND o.rn = f.rn + 1)
    SELECT id, peer, sent FROM f""",
)
def announce_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peers.throttle_announces(events(spark, sf_dir), 24 * HOUR_NS).select("id", "peer", "sent")


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("peer"), F.col("s_suppkey").alias("pos"), F.concat(F.lit("/p2p/"), F.pmod("s_suppkey", F.lit(10))).alias("address"))


BOOK_SQL = """b AS (SELECT peer, list(address ORDER BY pos) AS addresses FROM (SELECT s_nationkey AS peer, '/p2p/' || (s_suppkey % 10) AS address, min(s_suppkey) AS pos FROM supplier GROUP BY ALL) GROUP BY peer)"""


@query("address_book_insert", f"WITH {BOOK_SQL} SELECT peer, array_to_string(addresses, ',') AS addresses FROM b")
def address_book_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peers.insert_addresses(_addresses(spark, sf_dir)).select("peer", F.array_join("addresses", ",").alias("addresses"))


@query("address_book_insert_many", f"WITH {BOOK_SQL} SELECT peer, array_to_string(addresses, ',') AS addresses FROM b")
def address_book_insert_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = _addresses(spark, sf_dir).select("peer", F.col("pos").alias("seq"), F.array("address", "address").alias("addresses"))
    return peers.insert_many(batches)[0].select("peer", F.array_join("addresses", ",").alias("addresses"))


@query("address_book_lookup", f"WITH {BOOK_SQL} SELECT n_nationkey AS peer, coalesce(len(addresses), 0) AS n, CASE WHEN len(addresses) > 0 THEN 'ok' ELSE 'NotRegistered' END AS status FROM nation LEFT JOIN b ON n_nationkey = peer")
def address_book_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = peers.insert_addresses(_addresses(spark, sf_dir))
    wanted = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("peer"))
    return peers.lookup(wanted, book).select("peer", F.coalesce(F.size("addresses"), F.lit(0)).alias("n"), "status")


def _book_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions on 25 books that hold four peers each; some come without addresses, some for unknown peers."""
    kind = F.col("event_type")
    action = F.when(kind.isin("view", "purchase"), "add").when(kind == "click", "drop").when(kind == "signup", "register").otherwise("forget")
    given = F.when(F.col("id") % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("/p2p/"), F.col("id") % 5)))
    return events(spark, sf_dir).select(F.pmod("peer", F.lit(25)).alias("book"), F.col("ts_ns").alias("ts"), "id", "peer", action.alias("action"), given.alias("given"))


MACHINE_SQL = f"""WITH RECURSIVE {EV_SQL}, a AS (SELECT peer % 25 AS book, ts_ns, id, peer,
      CASE WHEN event_type IN ('view', 'purchase') THEN 'add' WHEN event_type = 'click' THEN 'drop' WHEN event_type = 'signup' THEN 'register' ELSE 'forget' END AS action,
      CASE WHEN id % 11 = 0 THEN []::VARCHAR[] ELSE ['/p2p/' || (id % 5)] END AS given FROM ev),
    o AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY ts_ns, id) AS rn FROM a),
    f AS (SELECT book, 0::BIGINT AS rn, 0::BIGINT AS id, 0::BIGINT AS peer, '' AS status, []::STRUCT(peer BIGINT, refs BIGINT, a VARCHAR[])[] AS q FROM (SELECT DISTINCT book FROM o)
      UNION ALL SELECT book, rn, id, peer, status,
        CASE WHEN status <> 'ok' THEN q
             WHEN action = 'drop' AND e.refs = 1 THEN others
             WHEN action = 'drop' THEN list_append(others, {{'peer': peer, 'refs': e.refs - 1, 'a': e.a}})
             WHEN action = 'add' THEN list_append(others, {{'peer': peer, 'refs': coalesce(e.refs, 0) + 1, 'a': list_concat(coalesce(e.a, []), list_filter(given, lambda x: NOT list_contains(coalesce(e.a, []), x)))}})
             WHEN action = 'register' THEN list_append(others, {{'peer': peer, 'refs': e.refs, 'a': list_concat(e.a, list_filter(given, lambda x: NOT list_contains(e.a, x)))}})
             ELSE list_append(others, {{'peer': peer, 'refs': e.refs, 'a': list_filter(e.a, lambda x: NOT list_contains(given, x))}}) END
      FROM (SELECT *, CASE WHEN action = 'add' AND len(given) = 0 THEN 'EmptyAddressList' WHEN action = 'add' AND e IS NULL AND len(q) >= 4 THEN 'Full' WHEN action <> 'add' AND e IS NULL THEN 'UnknownPeer' ELSE 'ok' END AS status
        FROM (SELECT o.book, o.rn, o.id, o.peer, o.action, o.given, f.q, list_filter(f.q, lambda x: x.peer = o.peer)[1] AS e, list_filter(f.q, lambda x: x.peer <> o.peer) AS others FROM f JOIN o ON o.book = f.book AND o.rn = f.rn + 1))),
    r AS (SELECT *, list_filter(q, lambda x: x.peer = f.peer)[1] AS e FROM f WHERE rn > 0)"""


@query("address_book", MACHINE_SQL + " SELECT id, status, coalesce(e.refs, 0) AS refs, array_to_string(coalesce(e.a, []), ',') AS addresses FROM r")
def address_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peers.address_book(_book_events(spark, sf_dir), 4).select("id", "status", "refs", F.array_join("addresses", ",").alias("addresses"))


@query("address_book_references", MACHINE_SQL + " SELECT book, peer, e.refs AS refs, array_to_string(e.a, ',') AS addresses FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY book, peer ORDER BY rn DESC) = 1) WHERE e IS NOT NULL")
def address_book_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peers.reference_counts(peers.address_book(_book_events(spark, sf_dir), 4)).withColumn("addresses", F.array_join("addresses", ","))


# --- exchange and composites ------------------------------------------------------------------------------

def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("req_id"), F.col("o_orderpriority").alias("payload"), F.array("o_custkey", F.col("o_custkey") + 1).alias("peers"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey") * 1000).alias("deadline_ns"))


def _book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("peer"), F.array(F.concat(F.lit("/p2p/"), "c_custkey")).alias("addresses"))


SEND_SQL = """s AS (SELECT o_orderkey AS req_id, unnest([o_custkey, o_custkey + 1]) AS peer, CASE WHEN o_orderstatus = 'F' THEN o_orderkey * 1000 ELSE 100000000 END AS deadline_ns FROM orders),
 b AS (SELECT c_custkey AS peer, '/p2p/' || c_custkey AS address FROM customer WHERE c_acctbal > 0)"""


@query("wire_send", f"WITH {SEND_SQL} SELECT req_id, s.peer, deadline_ns, address FROM s JOIN b ON s.peer = b.peer")
def wire_send(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchange.send(_messages(spark, sf_dir), _book(spark, sf_dir))[0].select("req_id", "peer", "deadline_ns", F.get("addresses", F.lit(0)).alias("address"))


@query("wire_send_rejected", f"WITH {SEND_SQL} SELECT req_id, peer, 'NotRegistered' AS reason FROM s WHERE peer NOT IN (SELECT peer FROM b)")
def wire_send_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchange.send(_messages(spark, sf_dir), _book(spark, sf_dir))[1].select("req_id", "peer", "reason")


@query("wire_recv", f"WITH {SEND_SQL} SELECT req_id, s.peer FROM s JOIN b ON s.peer = b.peer WHERE s.peer = 7")
def wire_recv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchange.recv(exchange.send(_messages(spark, sf_dir), _book(spark, sf_dir))[0], 7).select("req_id", "peer")


@query("collect_fills", "SELECT c_custkey, d AS dest, CASE WHEN d = 'balance' THEN c_mktsegment END AS payload, d = 'go' AS trigger_only, CASE WHEN d = 'go' THEN 'TypeMismatch' END AS reason FROM customer, (VALUES ('balance'), ('go')) t(d)")
def collect_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    fills = exchange.collect_fills([("balance", segment, False), ("go", F.lit(1), True)])
    envelopes = table(spark, sf_dir, "customer").select("c_custkey", fills.alias("fills"))
    expected = spark.range(1).select(F.explode(F.array(F.lit("balance"), F.lit("go"))).alias("dest"), F.xxhash64(F.lit("string")).alias("type_hash"))
    ok, bad = exchange.deliver(envelopes, expected)
    both = ok.withColumn("reason", F.lit(None).cast("string")).unionByName(bad)
    return both.select("c_custkey", "dest", F.decode("payload", "UTF-8").alias("payload"), "trigger_only", "reason")


@query("bundle_unbundle", "SELECT c_custkey, c_name, c_acctbal AS balance, 'v1' AS version FROM customer")
def bundle_unbundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, _ = exchange.tee(table(spark, sf_dir, "customer"))
    packed = exchange.bundle(one, "b", ["c_custkey", "c_name", "c_acctbal"]).select("b")
    out = exchange.constant(exchange.unbundle(packed, "b", 3), "version", "v1")
    return out.select("c_custkey", "c_name", exchange.pass_through(F.col("c_acctbal"), "balance"), "version")


@query("learn_addresses", "SELECT peer, list(address ORDER BY k, ts) AS addresses FROM (SELECT peer, address, min(k) AS k, min(ts) AS ts FROM (SELECT s_nationkey AS peer, 's' || (s_suppkey % 5) AS address, 0 AS k, s_suppkey AS ts FROM supplier UNION ALL SELECT c_nationkey, 's' || (c_custkey % 7), 1, c_custkey FROM customer) GROUP BY peer, address) GROUP BY peer".replace("list(address ORDER BY k, ts) AS", "array_to_string(list(address ORDER BY k, ts), ',') AS").replace("min(k) AS k, min(ts) AS ts", "min(k) AS k, arg_min(ts, (k, ts)) AS ts"))
def learn_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    claimed = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("peer"), F.concat(F.lit("s"), F.col("s_suppkey") % 5).alias("address"), F.col("s_suppkey").alias("ts"))
    seen = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("peer"), F.concat(F.lit("s"), F.col("c_custkey") % 7).alias("address"), F.col("c_custkey").alias("ts"))
    return exchange.learn_addresses(claimed, seen).select("peer", F.array_join("addresses", ",").alias("addresses"))


# --- timers -----------------------------------------------------------------------------------------------

@query("interval", "SELECT i AS tick, 100 + i * 50 AS ts_ns FROM range(18) t(i)")
def interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timers.interval(spark, 100, 1000, 50)


@query("interval_per", f"WITH {EV_SQL}, b AS (SELECT peer, min(ts_ns) AS a, max(ts_ns) AS z FROM ev GROUP BY peer) SELECT peer, i AS tick, a + i * {24 * HOUR_NS} AS ts_ns FROM b, range(40) t(i) WHERE a + i * {24 * HOUR_NS} < z")
def interval_per(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = events(spark, sf_dir).groupBy("peer").agg(F.min("ts_ns").alias("a"), F.max("ts_ns").alias("z"))
    return timers.interval_per(bounds, "a", "z", 24 * HOUR_NS).select("peer", "tick", "ts_ns")


@query("after", f"WITH {EV_SQL} SELECT id, ts_ns + 5000 AS fires_ns FROM ev WHERE event_type = 'signup'")
def after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timers.on_trigger(timers.event_source(events(spark, sf_dir), "signup")).select("id", timers.after(F.col("ts_ns"), 5000).alias("fires_ns"))


@query("event_source", f"WITH {EV_SQL} SELECT id, peer, value FROM ev WHERE event_type = 'purchase'")
def event_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timers.event_source(events(spark, sf_dir), "purchase").select("id", "peer", "value")


@query("pulse", "SELECT true AS trigger")
def pulse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timers.pulse(spark)


@query("clock_rng", f"WITH {EV_SQL}, u AS (SELECT id, ('0x' || substr(md5('5|' || id), 1, 16))::UBIGINT::HUGEINT AS u FROM ev) SELECT id, (CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END)::BIGINT AS r, true AS ticking FROM u")
def clock_rng(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("id", timers.rng_u64(5, F.col("id")).alias("r"), (timers.clock() > 0).alias("ticking"))


@query("lifecycle", "SELECT p_type AS step, p_brand AS phase, count(*) AS n FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) GROUP BY ALL")
def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "part").select(F.col("p_type").alias("step"), F.col("p_brand").alias("phase"))
    return timers.lifecycle_phase(steps, steps.agg(F.min("phase")).first()[0]).groupBy("step", "phase").agg(F.count(F.lit(1)).alias("n"))


@query("bootstrap", "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linestatus = 'O'")
def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    commands = timers.bootstrap_dispatch(table(spark, sf_dir, "orders").select("o_orderkey"))
    done = timers.bootstrap_dispatch(table(spark, sf_dir, "lineitem").filter("l_linestatus = 'O'").select(F.col("l_orderkey").alias("o_orderkey"))).select("cmd")
    lines = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'O'").select("l_linenumber", F.col("l_orderkey").alias("o_orderkey"))
    with_cmd = lines.withColumn("cmd", F.md5(F.to_json(F.struct("o_orderkey")))).select("cmd", "l_linenumber")
    return timers.bootstrap_output(commands.join(done.distinct(), "cmd", "left_semi"), with_cmd).select("o_orderkey", "l_linenumber")


@query(
    "scheduler",
    f"""WITH RECURSIVE {EV_SQL}, o AS (SELECT peer % 30 AS node, id, ts_ns, event_type IN ('purchase', 'signup') AS poll, ts_ns + (id % 5) * {12 * HOUR_NS} AS m, row_number() OVER (PARTITION BY peer % 30 ORDER BY ts_ns, id) AS rn FROM ev),
    f AS (SELECT node, 0::BIGINT AS rn, 0::BIGINT AS id, []::BIGINT[] AS fired, false AS dropped, []::STRUCT(m BIGINT, t BIGINT)[] AS q FROM (SELECT DISTINCT node FROM o)
      UNION ALL SELECT o.node, o.rn, o.id,
        CASE WHEN poll THEN list_transform(list_sort(list_filter(q, lambda x: x.m <= o.ts_ns)), lambda x: x.t) ELSE [] END,
        NOT poll AND len(q) >= 6,
        CASE WHEN poll THEN list_filter(q, lambda x: x.m > o.ts_ns) WHEN len(q) >= 6 THEN q ELSE list_append(q, {{'m': o.m, 't': o.id}}) END
      FROM f JOIN o ON o.node = f.node AND o.rn = f.rn + 1)
    SELECT id, array_to_string(fired, ',') AS fired, dropped FROM f WHERE rn > 0""",
)
def scheduler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty nodes whose heaps hold six timers; some events poll, the others schedule."""
    action = F.when(F.col("event_type").isin("purchase", "signup"), "poll").otherwise("schedule")
    own = events(spark, sf_dir).withColumns({"node": F.pmod("peer", F.lit(30)), "action": action, "maturity_ns": F.col("ts_ns") + F.col("id") % 5 * F.lit(12 * HOUR_NS)})
    return timers.scheduler(own, 6).select("id", F.array_join("fired", ",").alias("fired"), "dropped")


# --- coordination -----------------------------------------------------------------------------------------

ORDERED_SQL = f"{EV_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY peer ORDER BY ts_ns, id) AS rn FROM ev)"


def _acts(spark: SparkSession, sf_dir: str, one: tuple[str, ...], first: str, second: str) -> DataFrame:
    action = F.when(F.col("event_type").isin(*one), first).otherwise(second)
    return events(spark, sf_dir).select(F.col("ts_ns").alias("ts"), "id", F.col("peer").alias("name"), action.alias("action"), F.col("id").alias("payload"))


@query(
    "limit",
    f"""WITH RECURSIVE {ORDERED_SQL}, f AS (
      SELECT peer, rn, id, event_type IN ('click', 'view', 'signup') AS acq, CASE WHEN event_type IN ('click', 'view', 'signup') THEN 1 ELSE 0 END AS n, true AS granted FROM o WHERE rn = 1
      UNION ALL SELECT o.peer, o.rn, o.id, event_type IN ('click', 'view', 'signup'),
        CASE WHEN event_type IN ('click', 'view', 'signup') THEN least(f.n + 1, 2) ELSE greatest(f.n - 1, 0) END, f.n < 2 FROM f JOIN o ON o.peer = f.peer AND o.rn = f.rn + 1)
    SELECT id, granted, n AS inflight FROM f WHERE acq""",
)
def limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coordination.limit(_acts(spark, sf_dir, ("click", "view", "signup"), "acquire", "release"), 2).select("id", "granted", "inflight")


@query("any_latch", f"WITH {EV_SQL} SELECT id, peer, event_type FROM ev QUALIFY row_number() OVER (PARTITION BY peer, event_type ORDER BY ts_ns, id) = 1")
def any_latch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coordination.first_arrival(events(spark, sf_dir), ["peer", "event_type"], ["ts_ns", "id"]).select("id", "peer", "event_type")


@query("gate", f"WITH {EV_SQL} SELECT id, peer, value FROM ev WHERE event_type = 'purchase' AND peer IN (SELECT peer FROM ev WHERE event_type = 'signup')")
def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return coordination.gate(e.filter("event_type = 'purchase'"), e.filter("event_type = 'signup'"), "peer").select("id", "peer", "value")


@query("gate_dispatch", f"WITH {EV_SQL} SELECT peer, max(t) AS ready_ts FROM (SELECT peer, event_type, min(ts_ns) AS t FROM ev GROUP BY ALL) GROUP BY peer HAVING count(*) = 5")
def gate_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coordination.gate_dispatch(events(spark, sf_dir), 5, "peer", "event_type", "ts_ns")


@query(
    "serialize_queue",
    f"""WITH RECURSIVE {ORDERED_SQL}, f AS (
      SELECT peer, rn, id, CASE WHEN event_type IN ('click', 'view', 'error') THEN [id] ELSE []::BIGINT[] END AS q, NULL::BIGINT AS taken, false AS dropped FROM o WHERE rn = 1
      UNION ALL SELECT o.peer, o.rn, o.id,
        CASE WHEN event_type IN ('click', 'view', 'error') THEN CASE WHEN len(q) >= 3 THEN list_append(q[2:], o.id) ELSE list_append(q, o.id) END ELSE q[2:] END,
        CASE WHEN event_type IN ('click', 'view', 'error') THEN NULL ELSE q[1] END, event_type IN ('click', 'view', 'error') AND len(q) >= 3 FROM f JOIN o ON o.peer = f.peer AND o.rn = f.rn + 1)
    SELECT id, coalesce(taken, -1) AS taken, dropped, len(q)::INT AS depth FROM f""",
)
def serialize_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    acts = _acts(spark, sf_dir, ("click", "view", "error"), "enqueue", "dequeue").withColumnRenamed("name", "queue")
    return coordination.serialize(acts, 3).select("id", F.coalesce("taken", F.lit(-1)).alias("taken"), "dropped", "depth")


@query(
    "hold",
    f"""WITH {EV_SQL}, f AS (SELECT *, event_type IN ('purchase', 'signup') AS flush FROM ev),
    g AS (SELECT *, sum(flush::INT) OVER (PARTITION BY peer ORDER BY ts_ns, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM f)
    SELECT id, coalesce(last_value(CASE WHEN NOT flush THEN id END IGNORE NULLS) OVER (PARTITION BY peer, coalesce(k, 0) ORDER BY ts_ns, id), -1) AS taken FROM g QUALIFY flush""",
)
def hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    acts = _acts(spark, sf_dir, ("purchase", "signup"), "flush", "stash").withColumnRenamed("name", "slot")
    return coordination.hold(acts).select("id", F.coalesce("taken", F.lit(-1)).alias("taken"))


@query(
    "hold_table",
    f"""WITH RECURSIVE {EV_SQL}, o AS (SELECT peer % 30 AS node, peer AS slot, id, event_type IN ('purchase', 'signup') AS flush, row_number() OVER (PARTITION BY peer % 30 ORDER BY ts_ns, id) AS rn FROM ev),
    f AS (SELECT node, 0::BIGINT AS rn, 0::BIGINT AS id, -1::BIGINT AS taken, false AS dropped, []::STRUCT(slot BIGINT, item BIGINT)[] AS q FROM (SELECT DISTINCT node FROM o)
      UNION ALL SELECT node, rn, id, CASE WHEN flush THEN coalesce(e.item, -1) ELSE -1 END, NOT flush AND e IS NULL AND len(q) >= 2,
        CASE WHEN flush THEN others WHEN e IS NULL AND len(q) >= 2 THEN q ELSE list_append(others, {{'slot': slot, 'item': id}}) END
      FROM (SELECT o.node, o.rn, o.id, o.slot, o.flush, f.q, list_filter(f.q, lambda x: x.slot = o.slot)[1] AS e, list_filter(f.q, lambda x: x.slot <> o.slot) AS others FROM f JOIN o ON o.node = f.node AND o.rn = f.rn + 1))
    SELECT id, taken, dropped FROM f WHERE rn > 0""",
)
def hold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty nodes with two slots each: a new slot beyond them is dropped."""
    acts = _acts(spark, sf_dir, ("purchase", "signup"), "flush", "stash").withColumnRenamed("name", "slot").withColumn("node", F.pmod("slot", F.lit(30)))
    return coordination.hold_table(acts, 2).select("id", F.coalesce("taken", F.lit(-1)).alias("taken"), "dropped")


@query("correlate_tag", f"WITH {EV_SQL} SELECT id, md5(peer || '|' || id) AS token FROM ev")
def correlate_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coordination.correlate_tag(events(spark, sf_dir), "peer", "id").select("id", "token")


@query("deadline_check", "SELECT l_orderkey, l_linenumber, CASE WHEN l_shipdate < o_orderdate + INTERVAL 60 DAY THEN NULL ELSE 'Timeout' END AS reason FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def deadline_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(*KEY, "l_shipdate")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    reason = coordination.deadline_reason(F.col("l_shipdate"), F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS"))
    return dealt_join(lines, orders, ["l_orderkey"]).select(*KEY, reason.alias("reason"))


@query(
    "deadline_match",
    f"""WITH {EV_SQL}, a AS (SELECT peer, min(ts_ns) AS t FROM ev WHERE event_type = 'purchase' GROUP BY peer), b AS (SELECT peer, min(ts_ns) AS u FROM ev WHERE event_type = 'error' GROUP BY peer)
    SELECT coalesce(a.peer, b.peer) AS peer, CASE WHEN u IS NULL OR t <= u THEN 'then' ELSE 'timeout' END AS winner, least(t, u) AS ts FROM a FULL JOIN b ON a.peer = b.peer""",
)
def deadline_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("ts", F.col("ts_ns"))
    return coordination.deadline_match(e.filter("event_type = 'purchase'"), e.filter("event_type = 'error'"), "peer")


@query("app_emit", "SELECT 'nation.seen' AS name, '{\"n_nationkey\":' || n_nationkey || '}' AS payload FROM nation")
def app_emit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coordination.app_emit(table(spark, sf_dir, "nation").select("n_nationkey"), "nation.seen")


@query("record_ring", f"WITH {EV_SQL} SELECT id, peer FROM ev QUALIFY row_number() OVER (PARTITION BY peer ORDER BY ts_ns DESC, id DESC) <= 5")
def record_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coordination.record(events(spark, sf_dir), 5, "peer", ["ts_ns", "id"]).select("id", "peer")


@query("record_names", f"WITH {EV_SQL}, n AS (SELECT peer FROM ev GROUP BY peer ORDER BY min((ts_ns, id)) LIMIT 20) SELECT id, peer FROM ev WHERE peer IN (SELECT peer FROM n) QUALIFY row_number() OVER (PARTITION BY peer ORDER BY ts_ns DESC, id DESC) <= 5")
def record_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coordination.record(events(spark, sf_dir), 5, "peer", ["ts_ns", "id"], names=20).select("id", "peer")


@query("incr_metric", "SELECT event_type AS name, count(*) AS total FROM events GROUP BY ALL")
def incr_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coordination.incr_metric(events(spark, sf_dir).withColumnRenamed("event_type", "name"))


# --- gates and link health --------------------------------------------------------------------------------

@query("dedup_gate", "SELECT min(doc_id) AS id, source AS src_peer FROM documents GROUP BY source, text")
def dedup_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ts"), F.col("source").alias("src_peer"), F.col("text").alias("payload"))
    return health.dedup_gate(d).select("id", "src_peer")


@query(
    "dedup_count_window",
    f"""WITH RECURSIVE {ORDERED_SQL}, f AS (SELECT peer, rn, id, event_type, [event_type] AS q, true AS new FROM o WHERE rn = 1
      UNION ALL SELECT o.peer, o.rn, o.id, o.event_type,
        CASE WHEN list_contains(q, o.event_type) THEN q WHEN len(q) >= 3 THEN list_append(q[2:], o.event_type) ELSE list_append(q, o.event_type) END, NOT list_contains(q, o.event_type)
      FROM f JOIN o ON o.peer = f.peer AND o.rn = f.rn + 1)
    SELECT id, peer, event_type FROM f WHERE new""",
)
def dedup_count_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of three of the five kinds, so that it fills."""
    return health.dedup_count_window(events(spark, sf_dir).withColumn("ts", F.col("ts_ns")), "peer", "event_type", 3).select("id", "peer", "event_type")


def _backoff_state(e: DataFrame, hours: int) -> DataFrame:
    """An error bars its peer for some hours, a purchase clears it."""
    next_retry = F.when(~F.col("ok"), F.col("ts_ns") + hours * HOUR_NS)
    return e.filter("event_type in ('error', 'purchase')").select("peer", "ts_ns", next_retry.alias("next_retry_ns"))


def _as_of_sql(hours: int) -> str:
    return f"""WITH {EV_SQL}, st AS (SELECT peer, ts_ns, CASE WHEN NOT ok THEN ts_ns + {hours * HOUR_NS} END AS next FROM ev WHERE event_type IN ('error', 'purchase')),
    t AS (SELECT ev.*, (SELECT s.next FROM st s WHERE s.peer = ev.peer AND s.ts_ns <= ev.ts_ns ORDER BY s.ts_ns DESC, s.next DESC NULLS LAST LIMIT 1) AS next FROM ev)"""


@query(
    "peer_health_gate",
    _as_of_sql(100) + """ SELECT id, reason, coalesce(CASE WHEN reason = 'Cooldown' THEN next END, -1) AS retry_ns FROM (
      SELECT id, next, CASE WHEN peer % 11 = 0 THEN 'Blocked' WHEN peer % 5 = 4 THEN 'NotAllowed' WHEN ts_ns < next THEN 'Cooldown' END AS reason FROM t)""",
)
def peer_health_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    out = health.peer_health_gate(e, e.filter("peer % 11 = 0").select("peer"), e.filter("peer % 5 <> 4").select("peer"), _backoff_state(e, 100))
    return out.select("id", "reason", F.coalesce("retry_ns", F.lit(-1)).alias("retry_ns"))


STREAK_SQL = f"""{EV_SQL}, isl AS (SELECT *, sum(ok::INT) OVER (PARTITION BY peer ORDER BY ts_ns, id) AS g FROM ev),
 st AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY peer, g ORDER BY ts_ns, id)::INT AS streak FROM isl)"""


@query("backoff", f"WITH {STREAK_SQL} SELECT id, streak, d AS delay_ns, ts_ns + d AS next_retry_ns FROM (SELECT *, CASE WHEN streak = 0 THEN 0 ELSE least(10000000 * pow(2, streak - 1), 60000000000)::BIGINT END AS d FROM st)")
def backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.backoff(events(spark, sf_dir)).select("id", "streak", "delay_ns", "next_retry_ns")


@query("backoff_gate", _as_of_sql(20) + " SELECT id, peer FROM t WHERE next IS NULL OR ts_ns >= next")
def backoff_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return health.backoff_gate(e, _backoff_state(e, 20)).select("id", "peer")


@query("governor", f"WITH {STREAK_SQL} SELECT peer, id, state FROM (SELECT *, lag(state, 1, 'up') OVER (PARTITION BY peer ORDER BY ts_ns, id) AS was FROM (SELECT *, CASE WHEN streak >= 3 THEN 'down' ELSE 'up' END AS state FROM st)) WHERE state <> was")
def governor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.governor(events(spark, sf_dir), 3).select("peer", "id", "state")


GAPS_SQL = f"{EV_SQL}, gp AS (SELECT *, ts_ns - lag(ts_ns) OVER (PARTITION BY peer ORDER BY ts_ns, id) AS gap FROM ev)"


@query(
    "rtt_ema",
    f"""WITH RECURSIVE {GAPS_SQL}, o AS (SELECT peer, id, (gap // 1000000)::BIGINT AS s, row_number() OVER (PARTITION BY peer ORDER BY ts_ns, id) AS rn FROM gp WHERE gap IS NOT NULL),
    f AS (SELECT peer, rn, id, s AS srtt, s // 2 AS v FROM o WHERE rn = 1 UNION ALL
      SELECT o.peer, o.rn, o.id, srtt - (srtt >> 3) + (s >> 3), v - (v >> 2) + (abs(s - srtt) >> 2) FROM f JOIN o ON o.peer = f.peer AND o.rn = f.rn + 1)
    SELECT id, srtt, v AS rttvar, srtt + 4 * v AS budget_ns, rn >= 3 AS warm FROM f""",
)
def rtt_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = health.phi_accrual(events(spark, sf_dir)).filter("gap is not null").withColumn("sample_ns", F.floor(F.col("gap") / 1000000))
    return health.rtt_ema(gaps, "peer", "sample_ns", ["ts_ns", "id"]).select("id", "srtt", "rttvar", "budget_ns", "warm")


PHI_SQL = f"{GAPS_SQL}, ph AS (SELECT *, gap / (avg(gap) OVER (PARTITION BY peer ORDER BY ts_ns, id ROWS BETWEEN 1000 PRECEDING AND 1 PRECEDING) * ln(10)) AS phi FROM gp)"


@query("phi_accrual", f"WITH {PHI_SQL} SELECT id, coalesce(gap, -1)::BIGINT AS gap, round(coalesce(phi, 0), 6) AS phi FROM ph")
def phi_accrual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.phi_accrual(events(spark, sf_dir)).select("id", F.coalesce("gap", F.lit(-1)).alias("gap"), F.round("phi", 6).alias("phi"))


@query("scan_phi", f"WITH {PHI_SQL}, s AS (SELECT *, CASE WHEN coalesce(phi, 0) > 16 THEN 'down' WHEN coalesce(phi, 0) > 8 THEN 'suspect' ELSE 'up' END AS state FROM ph) SELECT id, peer, state FROM (SELECT *, lag(state, 1, 'up') OVER (PARTITION BY peer ORDER BY ts_ns, id) AS was FROM s) WHERE state <> was")
def scan_phi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.scan_phi(health.phi_accrual(events(spark, sf_dir))).select("id", "peer", "state")


@query("estimate_budget", "SELECT o_orderkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 10 END, CASE WHEN n_nationkey < 12 THEN n_nationkey * 1000 END, 5) AS budget_ns FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def estimate_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    requests = table(spark, sf_dir, "orders").join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
    edge = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") * 10).alias("budget_ns"))
    site = table(spark, sf_dir, "nation").filter("n_nationkey < 12").select(F.col("n_nationkey").alias("key"), (F.col("n_nationkey") * 1000).cast("long").alias("budget_ns"))
    return health.estimate_budget(requests, [("o_custkey", edge), ("c_nationkey", site)], 5).select("o_orderkey", "budget_ns")


@query(
    "backpressure",
    f"""WITH RECURSIVE {EV_SQL}, o AS (SELECT peer, id, ts_ns, floor(value)::INT * 100 >= 100 * 75 AS over, event_type = 'signup' AS back, row_number() OVER (PARTITION BY peer ORDER BY ts_ns, id) AS rn FROM ev),
    f AS (SELECT peer, 0::BIGINT AS rn, 0::BIGINT AS id, NULL::BIGINT AS last, 0 AS sent, '' AS verdict FROM (SELECT DISTINCT peer FROM o)
      UNION ALL SELECT peer, rn, id, CASE WHEN verdict = 'notice' THEN ts_ns ELSE last END, CASE WHEN verdict = 'notice' THEN sent + 1 ELSE sent END, verdict
      FROM (SELECT *, CASE WHEN NOT over THEN 'pass' WHEN sent >= 3 THEN 'drop' WHEN ts_ns < last + {HOUR_NS} THEN 'suppress' ELSE 'notice' END AS verdict
        FROM (SELECT o.peer, o.rn, o.id, o.ts_ns, o.over, CASE WHEN NOT back THEN f.last END AS last, CASE WHEN back THEN 0 ELSE f.sent END AS sent FROM f JOIN o ON o.peer = f.peer AND o.rn = f.rn + 1)))
    SELECT id, verdict FROM f WHERE rn > 0""",
)
def backpressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    depth = events(spark, sf_dir).withColumns({"depth": F.floor("value").cast("int"), "back": F.col("event_type") == "signup"})
    return health.backpressure(depth, 100, HOUR_NS, recovered="back").select("id", "verdict")


@query(
    "request_tracker",
    """SELECT o_orderkey AS req_id, coalesce(a - o_orderkey, -1) AS rtt_ns, CASE WHEN a IS NOT NULL THEN 'done' WHEN 20000 - o_orderkey >= 10000 THEN 'stale' ELSE 'inflight' END AS status
    FROM orders LEFT JOIN (SELECT l_orderkey, min(l_orderkey + l_linenumber) AS a FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL) ON o_orderkey = l_orderkey""",
)
def request_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("req_id"), F.col("o_orderkey").alias("ts_ns"))
    responses = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("req_id"), (F.col("l_orderkey") + F.col("l_linenumber")).alias("ts_ns"))
    return health.request_tracker(requests, responses, 20_000, 10_000).select("req_id", F.coalesce("rtt_ns", F.lit(-1)).alias("rtt_ns"), "status")


@query(
    "outbound_queue",
    f"""WITH {EV_SQL}, d AS (SELECT *, event_type = 'signup' AS drain FROM ev),
    n AS (SELECT *, (SELECT arg_min(z.id, (z.ts_ns, z.id)) FROM d z WHERE z.drain AND z.peer = d.peer AND (z.ts_ns, z.id) > (d.ts_ns, d.id)) AS by_id FROM d WHERE NOT drain),
    r AS (SELECT *, row_number() OVER (PARTITION BY peer, by_id ORDER BY ts_ns DESC, id DESC) AS r FROM n)
    SELECT id, CASE WHEN r > 3 THEN 'dropped' WHEN by_id IS NULL THEN 'queued' ELSE 'shipped' END AS status, CASE WHEN r <= 3 THEN coalesce(by_id, -1) ELSE -1 END AS drained_by FROM r""",
)
def outbound_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    acts = events(spark, sf_dir).withColumn("action", F.when(F.col("event_type") == "signup", "drain").otherwise("push"))
    return health.outbound_queue(acts, 3).select("id", "status", F.coalesce("drained_by", F.lit(-1)).alias("drained_by"))
