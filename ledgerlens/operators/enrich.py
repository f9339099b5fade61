"""Ratings, stock and returns joined onto the fact, each aggregated per product first."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import not_nan
from ..session import cut_lineage

# Accepted table and column names, output columns, reasons.
PRODUCT = "Produto_ID"
PRODUCT_NAMES = ("Produto_ID", "Produto ID", "ID Produto")
RATING_TABLES = ("Avaliacoes", "Avaliacao")
RATING_NAMES = ("Avaliacao", "Nota", "Rating")
STOCK_TABLES = ("Stock", "Estoque")
STOCK_NOW = ("Estoque Atual", "Stock Atual", "Quantidade Atual", "Quantidade em stock", "Quantidade em estoque", "Stock", "Estoque")
STOCK_MIN = ("Estoque Minimo", "Stock Minimo", "Nivel Minimo", "Minimo")
STOCK_MAX = ("Estoque Maximo", "Stock Maximo", "Nivel Maximo", "Maximo")
STOCK_LEAD = ("Tempo Medio de Entrega (dias)", "Tempo Medio Entrega")
RETURN_TABLES = ("Devolucoes", "Devolucao")
RETURN_QUANTITY = ("Quantidade", "Quantidade Devolvida", "Qtd Devolvida", "Qtd")
RETURN_REASON = ("Motivo", "Motivo da Devolucao", "Motivo Devolucao")
SOLD_QUANTITY = "Quantidade"
NO_TABLE = {
    "avaliacoes": "Tabela de avaliações não encontrada.",
    "stock": "Tabela de stock não encontrada.",
    "devolucoes": "Tabela de devoluções não encontrada.",
}
NO_COLUMNS = {
    "avaliacoes": "Não foi possível identificar Produto_ID e avaliação.",
    "stock": "Não foi possível identificar Produto_ID e estoque atual.",
    "devolucoes": "Não foi possível identificar Produto_ID.",
}
NO_PRODUCT = "Produto_ID não existe no dataset principal."
NO_RATING = "Nenhuma avaliação corresponde aos produtos da base principal."


def plain_name(text: str) -> str:
    """Names compare without case, accents and separators."""
    folded = unicodedata.normalize("NFKD", str(text).lower().strip())
    kept = "".join(ch for ch in folded if not unicodedata.combining(ch))
    return " ".join(kept.replace("_", " ").replace("-", " ").split())


def find_table(tables: dict[str, DataFrame], names: tuple[str, ...]) -> str | None:
    wanted = {plain_name(n) for n in names}
    return next((t for t in tables if plain_name(t) in wanted), None)


def find_column(df: DataFrame, names: tuple[str, ...]) -> str | None:
    present = {plain_name(c): c for c in df.columns}
    return next((present[plain_name(n)] for n in names if plain_name(n) in present), None)


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _num(name: str) -> Column:
    return not_nan(_c(name).try_cast("double"))


def _sized(df: DataFrame, spread: bool) -> DataFrame:
    return df.hint("merge") if spread else df


def only_known(data: DataFrame, column: str, base: DataFrame, base_column: str, spread: bool = False) -> DataFrame:
    """Rows whose id occurs in the base; the base is reduced to its ids first."""
    ids = base.select(_c(base_column).alias("_known")).where("_known is not null").distinct()
    return data.join(_sized(ids, spread), _c(column) == F.col("_known"), "left_semi")


def attach(base: DataFrame, per_key: DataFrame, base_column: str, key: str, spread: bool = False) -> DataFrame:
    """Left join of a per-key aggregate; unique by construction, so rows are preserved."""
    right = per_key.withColumnRenamed(key, "_key")
    return base.join(_sized(right, spread), _c(base_column) == F.col("_key"), "left").drop("_key")


def rating_summary(ratings: DataFrame, product: str, rating: str) -> DataFrame:
    return ratings.select(_c(product).alias("_p"), _num(rating).alias("_r")).dropna().groupBy("_p").agg(
        F.avg("_r").alias("Avaliacao_Media"), F.count("_r").alias("Quantidade_Avaliacoes"))


def stock_summary(stock: DataFrame, product: str, now: str, low: str | None, high: str | None, lead: str | None,
                  order: str | None = None) -> DataFrame:
    """Latest known levels per product in source order, mean lead time and the two alerts.

    Without a source-order column the largest level counts as latest.
    """
    def latest(name: str, alias: str) -> Column:
        v = _num(name)
        return F.max_by(v, F.when(v.isNotNull(), _c(order) if order else v)).alias(alias)

    aggs = [latest(now, "Estoque_Atual")]
    aggs += [latest(low, "Estoque_Minimo")] if low else []
    aggs += [latest(high, "Estoque_Maximo")] if high else []
    aggs += [F.avg(_num(lead)).alias("Tempo_Medio_Entrega_Dias")] if lead else []
    out = stock.where(_c(product).isNotNull()).groupBy(_c(product).alias("_p")).agg(*aggs)
    if low:
        out = out.withColumn("Risco_Ruptura", F.coalesce(F.col("Estoque_Atual") <= F.col("Estoque_Minimo"), F.lit(False)))
    if high:
        out = out.withColumn("Estoque_Excessivo", F.coalesce(F.col("Estoque_Atual") >= F.col("Estoque_Maximo"), F.lit(False)))
    return out


def return_summary(returns: DataFrame, product: str, quantity: str | None, reason: str | None) -> DataFrame:
    """Quantity, number and main reason per product.

    Reasons are counted per (product, reason) first, so a product with very
    many returns is reduced before it meets one task; the lowest reason wins a tie.
    """
    amount = F.coalesce(_num(quantity), F.lit(0.0)) if quantity else F.lit(1.0)
    why = _c(reason) if reason else F.lit(None).cast("string")
    fine = returns.where(_c(product).isNotNull()).groupBy(_c(product).alias("_p"), why.alias("_why")).agg(
        F.sum(amount).alias("_q"), F.count(F.lit(1)).alias("_n"))
    aggs = [F.sum("_q").alias("Quantidade_Devolvida"), F.sum("_n").alias("Numero_Devolucoes")]
    if reason:
        ranked = F.when(F.col("_why").isNotNull(), F.struct((-F.col("_n")).alias("n"), F.col("_why").alias("why")))
        aggs.append(F.min(ranked)["why"].alias("Principal_Motivo_Devolucao"))
    return fine.groupBy("_p").agg(*aggs)


@dataclass
class Enriched:
    """``products``: the base's products and quantities sold, which no module changes. ``spread``: see :func:`enrich`."""
    frame: DataFrame
    log: list[tuple[str, str, str | None]] = field(default_factory=list)
    products: DataFrame | None = None
    spread: bool = False

    def per_product(self) -> DataFrame:
        """(_p, _sold): every product of the base, with the quantity sold where the base has one; reduced once and written."""
        if self.products is None:
            sold = F.sum(_num(SOLD_QUANTITY)) if SOLD_QUANTITY in self.frame.columns else F.lit(None).cast("double")
            self.products = cut_lineage(self.frame.where(_c(PRODUCT).isNotNull()).groupBy(_c(PRODUCT).alias("_p")).agg(sold.alias("_sold")))
        return self.products

    def known(self, per_key: DataFrame) -> DataFrame:
        return only_known(per_key, "_p", self.per_product(), "_p", self.spread)

    def then(self, frame: DataFrame, module: str, status: str, why: str | None) -> Enriched:
        return replace(self, frame=frame, log=self.log + [(module, status, why)])

    def log_frame(self) -> DataFrame:
        return self.frame.sparkSession.createDataFrame(self.log, "modulo string, status string, motivo string")


def _skip(state: Enriched, module: str, why: str) -> Enriched:
    return state.then(state.frame, module, "ignorado", why)


def add_ratings(state: Enriched, tables: dict[str, DataFrame]) -> Enriched:
    module, base = "avaliacoes", state.frame
    name = find_table(tables, RATING_TABLES)
    if name is None:
        return _skip(state, module, NO_TABLE[module])
    product, rating = find_column(tables[name], PRODUCT_NAMES), find_column(tables[name], RATING_NAMES)
    if not product or not rating:
        return _skip(state, module, NO_COLUMNS[module])
    if PRODUCT not in base.columns:
        return _skip(state, module, NO_PRODUCT)
    usable = tables[name].where(_num(rating).isNotNull())
    per = cut_lineage(state.known(rating_summary(usable, product, rating)).withColumn("Avaliacao_Media", F.round("Avaliacao_Media", 2)))
    if per.isEmpty():
        return _skip(state, module, NO_RATING)
    out = attach(base, per, PRODUCT, "_p", state.spread).withColumn("Quantidade_Avaliacoes", F.coalesce("Quantidade_Avaliacoes", F.lit(0)))
    return state.then(out, module, "sucesso", None)


def add_stock(state: Enriched, tables: dict[str, DataFrame], order: str | None = None) -> Enriched:
    module, base = "stock", state.frame
    name = find_table(tables, STOCK_TABLES)
    if name is None:
        return _skip(state, module, NO_TABLE[module])
    df = tables[name]
    product, now = find_column(df, PRODUCT_NAMES), find_column(df, STOCK_NOW)
    if not product or not now:
        return _skip(state, module, NO_COLUMNS[module])
    if PRODUCT not in base.columns:
        return _skip(state, module, NO_PRODUCT)
    order = order if order in df.columns else None
    per = stock_summary(df, product, now, find_column(df, STOCK_MIN), find_column(df, STOCK_MAX), find_column(df, STOCK_LEAD), order)
    per = cut_lineage(state.known(per))
    return state.then(attach(base, per, PRODUCT, "_p", state.spread), module, "sucesso", None)


def add_returns(state: Enriched, tables: dict[str, DataFrame]) -> Enriched:
    module, base = "devolucoes", state.frame
    name = find_table(tables, RETURN_TABLES)
    if name is None:
        return _skip(state, module, NO_TABLE[module])
    df = tables[name]
    product = find_column(df, PRODUCT_NAMES)
    if not product:
        return _skip(state, module, NO_COLUMNS[module])
    if PRODUCT not in base.columns:
        return _skip(state, module, NO_PRODUCT)
    per = state.known(return_summary(df, product, find_column(df, RETURN_QUANTITY), find_column(df, RETURN_REASON)))
    if SOLD_QUANTITY in base.columns:
        # The rate needs the sold quantity of the product: one small aggregate
        # joined together with the returns instead of a window over all rows.
        per = state.per_product().join(_sized(per, state.spread), "_p", "left")
    per = cut_lineage(per)
    out = attach(base, per, PRODUCT, "_p", state.spread).withColumn(
        "Quantidade_Devolvida", F.coalesce("Quantidade_Devolvida", F.lit(0.0))
    ).withColumn("Numero_Devolucoes", F.coalesce("Numero_Devolucoes", F.lit(0)))
    if SOLD_QUANTITY in base.columns:
        rate = F.when(F.col("_sold") > 0, F.col("Quantidade_Devolvida") / F.col("_sold") * 100).otherwise(0.0)
        out = out.withColumn("Taxa_Devolucao", F.round(rate, 2)).drop("_sold")
    return state.then(out, module, "sucesso", None)


def enrich(base: DataFrame, tables: dict[str, DataFrame], stock_order: str | None = None, spread: bool = False) -> Enriched:
    """All three modules; a module that cannot run is logged and leaves the rest alone.

    Each module's values per product are written before they join the chain, so that an error in the side table's data
    shows there and not when the enriched frame is read. Where products are so many that they shouldn't pass through the
    driver, ``spread`` joins them by shuffles; a written table of short rows may look small enough to be broadcast.
    """
    state = Enriched(base, spread=spread)
    steps = (("avaliacoes", add_ratings), ("stock", lambda s, t: add_stock(s, t, stock_order)), ("devolucoes", add_returns))
    for module, step in steps:
        try:
            state = step(state, tables)
        except Exception as error:  # a broken side table must not stop the others
            state = state.then(state.frame, module, "erro", str(error))
    return state
