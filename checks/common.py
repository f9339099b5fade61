"""The driver's tables bound to business roles, for Spark and for SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

ROLES = {
    "pedido": "Pedido_ID", "data": "Data", "cliente_id": "Cliente_ID", "cliente": "Cliente",
    "produto_id": "Produto_ID", "produto": "Produto", "categoria": "Categoria", "regiao": "Regiao",
    "quantidade": "Quantidade", "faturamento": "Faturamento", "valor_total": "Valor_Total",
    "valor_com_desconto": "Valor_Com_Desconto", "custo": "Custo", "lucro": "Lucro",
    "margem_bruta": "Margem_Bruta",
}

SALES = """
sales AS (
  SELECT l_orderkey AS pedido, o_orderdate AS data, o_custkey AS cliente_id, c_name AS cliente,
         l_partkey AS produto_id, p_name AS produto, p_type AS categoria, r_name AS regiao,
         l_quantity AS quantidade, l_extendedprice * (1 - l_discount) AS faturamento,
         l_extendedprice AS valor_total, l_extendedprice * (1 - l_discount) AS valor_com_desconto,
         l_quantity * p_retailprice AS custo,
         l_extendedprice * (1 - l_discount) - l_quantity * p_retailprice AS lucro,
         l_extendedprice * (1 - l_discount) - 2 * l_quantity * p_retailprice AS margem_bruta,
         (year(o_orderdate) * 12 + month(o_orderdate) - 1) AS ord,
         strftime(o_orderdate, '%Y-%m') AS period
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey
)"""


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sales(spark: SparkSession, d: str, spread: bool = False, parts_first: bool = False) -> DataFrame:
    """Order lines joined to their dimensions; unused joins' columns are pruned by Catalyst.

    ``spread``: orders, customers and parts are shuffled and not broadcast, whatever size their files have.
    ``parts_first``: the same, and lines meet their parts before their orders, so that net and cost are all that is shuffled
    of a line the second time, and no text is shuffled once a line.
    """
    li, o, c, p = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "part"))
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    cost = F.col("l_quantity") * F.col("p_retailprice")
    of_order, of_customer, of_part = F.col("l_orderkey") == F.col("o_orderkey"), F.col("o_custkey") == F.col("c_custkey"), F.col("l_partkey") == F.col("p_partkey")
    placed = lambda df: df.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    if parts_first:
        costed = li.withColumn("_net", net).join(p.hint("merge"), of_part).withColumn("_cost", cost)
        net, cost = F.col("_net"), F.col("_cost")
        joined = costed.join(o.join(placed(c).hint("merge"), of_customer).hint("merge"), of_order)
    elif spread:
        joined = li.join(placed(o.join(c.hint("merge"), of_customer)).hint("merge"), of_order).join(p.hint("merge"), of_part)
    else:
        joined = placed(li.join(o, of_order).join(c, of_customer)).join(p, of_part)
    return (
        joined.select(
            F.col("l_orderkey").alias("Pedido_ID"), F.col("o_orderdate").alias("Data"),
            F.col("o_custkey").alias("Cliente_ID"), F.col("c_name").alias("Cliente"),
            F.col("l_partkey").alias("Produto_ID"), F.col("p_name").alias("Produto"),
            F.col("p_type").alias("Categoria"), F.col("r_name").alias("Regiao"),
            F.col("l_quantity").alias("Quantidade"), net.alias("Faturamento"),
            F.col("l_extendedprice").alias("Valor_Total"), net.alias("Valor_Com_Desconto"),
            cost.alias("Custo"), (net - cost).alias("Lucro"), (net - 2 * cost).alias("Margem_Bruta"),
        )
    )


def check(name: str, sql: str | None = None):
    """Register a query and, where it can be said in SQL, its oracle."""
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return wrap


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded for comparison; integers widened."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.round(c, digits) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        cols.append(c.alias(name))
    return df.select(*cols)


def once(build):
    """One build per session and folder: the frames are checkpoints that the queries below share."""
    made = {}

    def get(spark, d):
        key = (spark.sparkContext.applicationId, d)
        if key not in made:
            made[key] = build(spark, d)
        return made[key]

    return get
