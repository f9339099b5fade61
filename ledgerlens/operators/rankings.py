"""Customer, product and dimension rankings over per-entity totals.

One aggregation reduces rows to entities (partial aggregation absorbs hot
entities). Top-k lists are ``row_number() <= k`` windows partitioned by metric,
which Spark runs as a per-partition group limit, so only k rows per metric and
partition reach the final sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import not_nan
from ..functions.text import display_entity, fixed2
from ..session import cut_lineage
from .metrics import Roles

# Metric order, list lengths, messages.
CUSTOMER_METRICS = {
    "faturamento": "Faturamento",
    "valor_total": "Valor Total",
    "valor_com_desconto": "Valor com Desconto",
    "margem_bruta": "Margem Bruta",
    "lucro": "Lucro",
}
PRIMARY_METRICS = ("faturamento", "valor_total", "valor_com_desconto")
TOP_CUSTOMERS = 10
TOP_PRODUCTS = 5
TOP_VALUES = 5
MSG_TOP5 = "Os cinco maiores clientes representam {}% de {}."
MSG_TOP1 = "O maior cliente representa {}% de {}."
MSG_LEADERS_DIFFER = "O cliente com maior faturamento difere do cliente com maior lucro."
MSG_NEGATIVE_ONE = "{} cliente apresenta {} {}."
MSG_NEGATIVE_MANY = "{} clientes apresentam {} {}."

DIMENSIONS = {
    "produto": ("produto_id", "produto"),
    "categoria": (None, "categoria"),
    "loja": ("loja_id", "loja"),
    "regiao": (None, "regiao"),
    "cidade_cliente": (None, "cidade_cliente"),
    "cidade_loja": (None, "cidade_loja"),
    "colaborador": ("colaborador_id", "colaborador"),
    "canal_venda": (None, "canal_venda"),
    "canal_compra": (None, "canal_compra"),
    "tipo_loja": (None, "tipo_loja"),
    "funcao_colaborador": (None, "funcao_colaborador"),
    "genero_cliente": (None, "genero_cliente"),
    "cor_produto": (None, "cor_produto"),
    "tamanho_produto": (None, "tamanho_produto"),
}


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def entity_columns(roles: Roles, kind: str) -> tuple[str | None, str | None]:
    """(grouping column, label column): the id groups when there is one."""
    ident, label = roles.get(f"{kind}_id"), roles.get(kind)
    return (ident, label) if ident else (label, None)


def labelled_groups(
    df: DataFrame, keys: dict[str, Column], label: Column | None, row_no: Column | None, aggs: list[tuple],
) -> DataFrame:
    """Groups by ``keys`` with one label each: the first in source order, or the smallest.

    ``aggs`` are (name, aggregate, merge). The label is part of the first
    grouping, because a text minimum has no hash aggregation and would sort all
    rows; the second grouping only sees one row per key and label.
    """
    if label is None:
        plain = df.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(*[a.alias(n) for n, a, _ in aggs])
        return plain.withColumn("label", F.lit(None).cast("string"))
    seen = [F.min(row_no).alias("_seen")] if row_no is not None else []
    fine = df.groupBy(*[c.alias(n) for n, c in keys.items()], label.cast("string").alias("_label")).agg(
        *[a.alias(n) for n, a, _ in aggs], *seen)
    known = F.col("_label").isNotNull()
    first = F.min_by("_label", F.when(known, F.col("_seen"))) if seen else F.min("_label")
    return fine.groupBy(*keys).agg(first.alias("label"), *[m(n).alias(n) for n, _, m in aggs])


def entity_totals(
    df: DataFrame, key: str, label: str | None, metrics: dict[str, str], row_no: str | None = None
) -> DataFrame:
    """Per entity: rows and, per metric, sum, valid rows and negative rows.

    Rows without identity form the NULL entity, so totals over all rows are
    sums over this frame and the rows are never scanned twice.
    """
    aggs = [("records", F.count(F.lit(1)), F.sum)]
    for m, c in metrics.items():
        v = not_nan(_q(c).try_cast("double"))
        aggs += [(m, F.sum(v), F.sum), (f"{m}_valid", F.count(v), F.sum), (f"{m}_neg_rows", F.count_if(v < 0), F.sum)]
    return labelled_groups(df, {"entity": _q(key)}, _q(label) if label else None, _q(row_no) if row_no else None, aggs)


def metric_values(totals: DataFrame, metrics: list[str], fill_zero: bool = False) -> DataFrame:
    """(concept, entity, label, value) of identified entities that have the metric."""
    value = (lambda m: F.coalesce(F.col(m), F.lit(0.0))) if fill_zero else F.col
    entries = F.array(*[F.struct(F.lit(m).alias("concept"), value(m).alias("value")) for m in metrics])
    return (
        totals.where(F.col("entity").isNotNull())
        .select("entity", "label", F.inline(entries))
        .where(F.col("value").isNotNull())
    )


def top_entities(values: DataFrame, k: int, group: list[str] | None = None) -> DataFrame:
    """The k largest values of each group with their position; the key breaks ties."""
    group = ["concept"] if group is None else group
    w = Window.partitionBy(*group).orderBy(F.col("value").desc(), F.col("entity").asc())
    return values.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def customer_ranking(totals: DataFrame, metrics: list[str], with_id: bool, k: int = TOP_CUSTOMERS) -> DataFrame:
    ranked = top_entities(metric_values(totals, metrics), k)
    return ranked.select(
        "concept",
        F.col("position").cast("bigint").alias("position"),
        display_entity(F.col("entity"), F.col("label")).alias("customer"),
        (F.col("entity").cast("string") if with_id else F.lit(None).cast("string")).alias("customer_id"),
        F.col("value").alias("value"),
    )


def paired_ranking(totals: DataFrame, by: str, other: str, k: int = TOP_CUSTOMERS) -> DataFrame:
    """Ranking by one metric that carries another metric of the same entity."""
    known = totals.where(F.col("entity").isNotNull() & F.col(by).isNotNull())
    w = Window.partitionBy(F.lit(by)).orderBy(F.col(by).desc(), F.col("entity"))
    return known.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k).select(
        F.col("position").cast("bigint").alias("position"),
        display_entity(F.col("entity"), F.col("label")).alias("customer"),
        F.col("entity").cast("string").alias("customer_id"),
        F.col(by).alias(by),
        F.col(other).alias(other),
    )


def leaders(totals: DataFrame, metrics: list[str], with_id: bool) -> DataFrame:
    return customer_ranking(totals, metrics, with_id, k=1).drop("position")


def negative_entities(totals: DataFrame, metric: str) -> DataFrame:
    return totals.where(F.col("entity").isNotNull() & (F.col(metric) < 0)).select(
        F.col("entity").cast("string").alias("entity_id"),
        display_entity(F.col("entity"), F.col("label")).alias("entity"),
        F.col(metric).alias(metric),
    )


def evidence_stats(totals: DataFrame, metrics: list[str]) -> DataFrame:
    """Per metric: coverage, population, negatives, magnitudes and the top of the ranking."""
    entries = F.array(
        *[F.struct(F.lit(m).alias("concept"), F.col(m).alias("value"), F.col(f"{m}_valid").alias("valid"),
                   F.col(f"{m}_neg_rows").alias("neg_rows")) for m in metrics]
    )
    long = totals.select("entity", "records", F.inline(entries))
    known = F.col("entity").isNotNull()
    v = F.when(known, F.col("value"))
    stats = long.groupBy("concept").agg(
        F.sum("records").alias("registros"),
        F.sum(F.when(known, F.col("valid")).otherwise(0)).alias("registros_validos"),
        F.count(v).alias("populacao"),
        F.count_if(v < 0).alias("negativos"),
        F.coalesce(F.sum(F.when(v < 0, v)), F.lit(0.0)).alias("soma_negativos"),
        F.sum(F.abs(v)).alias("soma_absoluta"),
        F.sum("value").alias("total_metrica"),
        F.sum("neg_rows").alias("registros_negativos"),
    )
    top = top_entities(metric_values(totals, metrics), 5).groupBy("concept").agg(
        F.max("value").alias("top1_valor"), F.sum("value").alias("top5_valor")
    )
    return stats.where(F.col("populacao") > 0).join(top, "concept")


def primary_metric(roles: Roles) -> str | None:
    return next((m for m in PRIMARY_METRICS if m in roles), None)


def concentration(stats: DataFrame, metric: str) -> DataFrame:
    """Share of the largest customer and of the five largest in the total of all rows."""
    share = lambda c: F.try_divide(F.col(c), F.col("total_metrica")) * 100
    return stats.where((F.col("concept") == metric) & (F.col("total_metrica") != 0)).select(
        "concept", share("top1_valor").alias("participacao_maior_cliente"), share("top5_valor").alias("concentracao_top_5")
    )


def entity_count(totals: DataFrame) -> DataFrame:
    return totals.agg(F.count("entity").alias("entities"))


def customer_messages(totals: DataFrame, metrics: list[str]) -> DataFrame:
    """The four customer sentences that apply, in order."""
    stats = evidence_stats(totals, metrics)
    primary = next((m for m in PRIMARY_METRICS if m in metrics), None)
    parts: list[DataFrame] = []

    def text(template: str, *args: Column) -> Column:
        pieces = template.split("{}")
        out = [F.lit(pieces[0])]
        for a, p in zip(args, pieces[1:]):
            out += [a, F.lit(p)]
        return F.concat(*out)

    if primary:
        label = F.lit(CUSTOMER_METRICS[primary])
        shares = concentration(stats, primary)
        parts.append(shares.select(F.lit(1).alias("position"), text(MSG_TOP5, fixed2(F.col("concentracao_top_5")), label).alias("message")))
        parts.append(shares.select(F.lit(2).alias("position"), text(MSG_TOP1, fixed2(F.col("participacao_maior_cliente")), label).alias("message")))
    if {"faturamento", "lucro"} <= set(metrics):
        heads = leaders(totals, ["faturamento", "lucro"], True)
        parts.append(
            heads.agg(F.count_distinct("customer_id").alias("n")).where(F.col("n") > 1)
            .select(F.lit(3).alias("position"), F.lit(MSG_LEADERS_DIFFER).alias("message"))
        )
    negative = next((m for m in ("lucro", "margem_bruta") if m in metrics), None)
    if negative:
        adjective = F.lit("negativa" if negative == "margem_bruta" else "negativo")
        n = F.col("negativos")
        label = F.lit(CUSTOMER_METRICS[negative])
        message = F.when(n == 1, text(MSG_NEGATIVE_ONE, n.cast("string"), label, adjective)).otherwise(
            text(MSG_NEGATIVE_MANY, n.cast("string"), label, adjective))
        parts.append(
            stats.where((F.col("concept") == negative) & (n > 0))
            .select(F.lit(4).alias("position"), message.alias("message"))
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- products

def product_rankings(totals: DataFrame, metrics: list[str], k: int = TOP_PRODUCTS) -> DataFrame:
    return top_entities(metric_values(totals, metrics, fill_zero=True), k).select(
        "concept", F.col("position").cast("bigint").alias("position"),
        F.col("entity").cast("string").alias("product_id"),
        display_entity(F.col("entity"), F.col("label")).alias("product"),
        F.col("value").alias("value"),
    )


def growth_candidates(totals: DataFrame, k: int = TOP_PRODUCTS) -> DataFrame:
    """Products with profit above and revenue below the mean of all products."""
    known = totals.where(F.col("entity").isNotNull()).select(
        "entity", "label",
        F.coalesce("faturamento", F.lit(0.0)).alias("faturamento"), F.coalesce("lucro", F.lit(0.0)).alias("lucro"),
    )
    known = cut_lineage(known)  # one row per product, read for the means and for the products
    means = known.agg(F.struct(F.avg("faturamento").alias("mr"), F.avg("lucro").alias("mp"), F.count("label").alias("n"))).scalar()
    picked = known.where((F.col("lucro") > means["mp"]) & (F.col("faturamento") < means["mr"]))
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("lucro").desc(), F.col("entity"))
    return picked.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k).select(
        F.col("position").cast("bigint").alias("position"),
        F.col("entity").cast("string").alias("product_id"),
        display_entity(F.col("entity"), F.col("label")).alias("product"),
        F.col("faturamento").alias("faturamento"), F.col("lucro").alias("lucro"),
    )


# ---------------------------------------------------------------- dimensions

def available_dimensions(roles: Roles) -> dict[str, tuple[str, str | None]]:
    """Dimension name to (grouping column, label column) for those the table has."""
    found = {}
    for name, (ident, label) in DIMENSIONS.items():
        if ident and ident in roles:
            found[name] = (roles[ident], roles.get(label))
        elif label in roles:
            found[name] = (roles[label], None)
    return found


def dimension_totals(df: DataFrame, roles: Roles, row_no: str | None = None) -> DataFrame:
    """(dimension, entity, label, faturamento, quantidade, lucro) of every dimension in one pass.

    Each row is fanned out to its dimension values and reduced by map-side
    aggregation before the only shuffle.
    """
    dims = available_dimensions(roles)
    measures = [m for m in ("faturamento", "quantidade", "lucro") if m in roles]
    entries = F.array(
        *[F.struct(F.lit(n).alias("dimension"), _q(c).cast("string").alias("entity"),
                   (_q(l).cast("string") if l else F.lit(None).cast("string")).alias("label"))
          for n, (c, l) in dims.items()]
    )
    order = [_q(row_no).alias("_row")] if row_no else []
    fan = df.select(
        *[not_nan(_q(roles[m]).try_cast("double")).alias(m) for m in measures], *order, F.inline(entries)
    ).where(F.col("entity").isNotNull())
    keys = {"dimension": F.col("dimension"), "entity": F.col("entity")}
    return labelled_groups(fan, keys, F.col("label"), F.col("_row") if row_no else None,
                           [(m, F.coalesce(F.sum(m), F.lit(0.0)), F.sum) for m in measures])


def dimension_sizes(totals: DataFrame) -> DataFrame:
    return totals.groupBy("dimension").agg(F.count(F.lit(1)).alias("distinct_values"))


def dimension_top(totals: DataFrame, measure: str, k: int = TOP_VALUES) -> DataFrame:
    """Top values of every dimension with their share of the dimension total."""
    values = cut_lineage(totals.select("dimension", "entity", "label", F.col(measure).alias("value")))  # read for the sums and for the top values
    sums = values.groupBy("dimension").agg(F.sum("value").alias("total"))
    return top_entities(values, k, ["dimension"]).join(sums, "dimension").select(
        "dimension", F.col("position").cast("bigint").alias("position"), F.col("entity").alias("value_id"),
        display_entity(F.col("entity"), F.col("label")).alias("value_label"),
        F.col("value").alias(measure),
        F.when(F.col("total") != 0, F.try_divide(F.col("value"), F.col("total")) * 100).alias("share"),
    )


def dimension_unit_value(totals: DataFrame, k: int = TOP_VALUES) -> DataFrame:
    """Mean revenue per unit, 0 where no unit was sold."""
    unit = F.when(F.col("quantidade") > 0, F.try_divide(F.col("faturamento"), F.col("quantidade"))).otherwise(0.0)
    values = totals.select("dimension", "entity", "label", unit.alias("value"))
    return top_entities(values, k, ["dimension"]).select(
        "dimension", F.col("position").cast("bigint").alias("position"), F.col("entity").alias("value_id"),
        display_entity(F.col("entity"), F.col("label")).alias("value_label"),
        F.col("value").alias("unit_value"),
    )


def dimension_losses(totals: DataFrame) -> DataFrame:
    return totals.where(F.col("lucro") < 0).select(
        "dimension", F.col("entity").alias("value_id"),
        display_entity(F.col("entity"), F.col("label")).alias("value_label"), F.col("lucro").alias("lucro"),
    )
