"""Derived columns and global indicators."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import not_nan

# Names of derived columns, indicator keys and non-identifiers.
DERIVED_REVENUE = "Faturamento_Calculado"
DERIVED_COST = "Custo_Total_Calculado"
DERIVED_PROFIT = "Lucro_Calculado"
DERIVED_MARGIN = "Margem_Lucro_Calculada"
KPI_KEYS = (
    "faturamento_total", "valor_total", "valor_com_desconto", "margem_bruta",
    "margem_bruta_percentual", "quantidade_registros", "custo_total", "lucro_total",
    "quantidade_vendida", "quantidade_pedidos", "ticket_medio", "margem_lucro",
)
NOT_AN_ORDER = ("pedido", "total", "subtotal", "meta", "nan", "none")
WEIGHTED_METHOD = "media_ponderada_pela_base_semantica_unica"
FORMULA_METHOD = "ponderada_por_soma_da_margem_e_base_referenciada_em_formula"

Roles = dict[str, str]


@dataclass
class Derivation:
    """A frame with its extended role map and what was created."""

    frame: DataFrame
    roles: Roles
    log: list[dict[str, str]] = field(default_factory=list)

    def add(self, role: str, column: str, formula: str, value: Column) -> "Derivation":
        return Derivation(
            self.frame.withColumn(column, value),
            {**self.roles, role: column},
            self.log + [{"metrica": role, "coluna_criada": column, "formula": formula, "origem": "derivada"}],
        )


def _product(d: Derivation, target: str, unit: str, column: str) -> Derivation:
    quantity, price = d.roles.get("quantidade"), d.roles.get(unit)
    if target in d.roles or not quantity or not price:
        return d
    return d.add(target, column, f"{quantity} * {price}", F.col(f"`{quantity}`") * F.col(f"`{price}`"))


def derive_revenue(d: Derivation) -> Derivation:
    return _product(d, "faturamento", "preco_unitario", DERIVED_REVENUE)


def derive_cost(d: Derivation) -> Derivation:
    return _product(d, "custo", "custo_unitario", DERIVED_COST)


def derive_profit(d: Derivation) -> Derivation:
    revenue, cost = d.roles.get("faturamento"), d.roles.get("custo")
    if "lucro" in d.roles or not revenue or not cost:
        return d
    return d.add("lucro", DERIVED_PROFIT, f"{revenue} - {cost}", F.col(f"`{revenue}`") - F.col(f"`{cost}`"))


def derive_margin(d: Derivation) -> Derivation:
    """Row margin in percent; zero revenue gives 0, unknown revenue stays unknown."""
    revenue, profit = d.roles.get("faturamento"), d.roles.get("lucro")
    if "margem_lucro" in d.roles or not revenue or not profit:
        return d
    rev, pro = F.col(f"`{revenue}`"), F.col(f"`{profit}`")
    value = F.when(rev == 0, F.lit(0.0)).otherwise(F.try_divide(pro, rev) * 100)
    return d.add("margem_lucro", DERIVED_MARGIN, f"{profit} / {revenue} * 100", value)


def derive_metrics(df: DataFrame, roles: Roles) -> Derivation:
    return derive_margin(derive_profit(derive_cost(derive_revenue(Derivation(df, dict(roles))))))


def order_identifier(df: DataFrame, column: str) -> Column:
    """The identifier as counted: blanks and header/total words are no orders."""
    c = F.col(f"`{column}`")
    if dict(df.dtypes)[column] != "string":
        return c
    text = F.trim(c)
    return F.when((text != "") & ~F.lower(text).isin(*NOT_AN_ORDER), text)


def kpis(df: DataFrame, roles: Roles) -> DataFrame:
    """One wide row of indicators; an indicator that cannot be computed is NULL."""

    def num(role: str) -> Column:
        return not_nan(F.col(f"`{roles[role]}`").try_cast("double"))

    aggs: list[Column] = [F.count(F.lit(1)).alias("quantidade_registros")]
    for role in ("faturamento", "custo", "lucro", "quantidade"):
        if role in roles:
            aggs.append(F.coalesce(F.sum(num(role)), F.lit(0.0)).alias(f"_{role}"))
    for role in ("valor_total", "valor_com_desconto", "margem_bruta"):
        if role in roles:
            aggs.append(F.sum(num(role)).alias(f"_{role}"))
    bases = [r for r in ("valor_total", "valor_com_desconto") if r in roles]
    weighted = "margem_bruta_percentual" in roles and len(bases) == 1
    if weighted:
        rate, base = num("margem_bruta_percentual"), num(bases[0])
        usable = rate.isNotNull() & (base != 0)
        aggs += [F.sum(F.when(usable, rate * base)).alias("_wnum"), F.sum(F.when(usable, base)).alias("_wden")]
    order = roles.get("venda_id") or roles.get("pedido")
    if order:
        aggs.append(F.countDistinct(order_identifier(df, order)).alias("_orders"))

    agg = df.agg(*aggs)

    def have(role: str) -> bool:
        return role in roles

    absent = F.lit(None).cast("double")
    revenue, profit = F.col("_faturamento"), F.col("_lucro")
    out = {
        "faturamento_total": revenue if have("faturamento") else absent,
        "valor_total": F.col("_valor_total") if have("valor_total") else absent,
        "valor_com_desconto": F.col("_valor_com_desconto") if have("valor_com_desconto") else absent,
        "margem_bruta": F.col("_margem_bruta") if have("margem_bruta") else absent,
        "margem_bruta_percentual": F.try_divide(F.col("_wnum"), F.col("_wden")) if weighted else absent,
        "quantidade_registros": F.col("quantidade_registros").cast("double"),
        "custo_total": F.col("_custo") if have("custo") else absent,
        "lucro_total": profit if have("lucro") else absent,
        "quantidade_vendida": F.col("_quantidade") if have("quantidade") else absent,
        "quantidade_pedidos": F.col("_orders").cast("double") if order else absent,
        "ticket_medio": F.try_divide(revenue, F.col("_orders")) if order and have("faturamento") else absent,
        "margem_lucro": F.try_divide(profit, revenue) * 100 if have("lucro") and have("faturamento") else absent,
    }
    return agg.select(*[out[k].alias(k) for k in KPI_KEYS])


def kpis_long(wide: DataFrame) -> DataFrame:
    """(indicator, value) rows, absent indicators dropped."""
    keys = [k for k in KPI_KEYS if k in wide.columns]
    return wide.unpivot([], keys, "indicador", "valor").where(F.col("valor").isNotNull())


def _column_number(letters: Column) -> Column:
    """Spreadsheet column letters as a 1-based position."""
    up = F.upper(letters)
    digits = F.transform(F.split(up, ""), lambda ch: F.ascii(ch) - 64)
    return F.aggregate(digits, F.lit(0), lambda acc, d: acc * 26 + d)


def formula_margin(
    rows: DataFrame,
    formulas: DataFrame,
    concepts: DataFrame,
    roles: Roles,
    keys: tuple[str, ...] = ("sheet", "row_no"),
) -> DataFrame:
    """Margin percentage proven by cell formulas of the form ``=margin/base``.

    ``concepts`` is the (position, concept) list of the sheet. The ratio of sums
    is returned only if all proving formulas divide by one and the same base.
    """
    cell = r"^=\s*\$?([A-Za-z]{1,3})\$?\d+\s*/\s*\$?([A-Za-z]{1,3})\$?\d+$"
    text = F.trim(F.col("formula"))
    parsed = formulas.where(text.rlike(cell)).select(
        *keys,
        F.col("col_no").alias("target"),
        _column_number(F.regexp_extract(text, cell, 1)).alias("top"),
        _column_number(F.regexp_extract(text, cell, 2)).alias("bottom"),
    )

    def named(alias: str, out: str) -> DataFrame:
        return F.broadcast(concepts.select(F.col("position").alias(alias), F.col("concept").alias(out)))  # one row per column of the sheet

    proven = (
        parsed.join(named("target", "t"), "target").where(F.col("t") == "margem_bruta_percentual")
        .join(named("top", "n"), "top").where(F.col("n") == "margem_bruta")
        .join(named("bottom", "base"), "bottom")
        .where(F.col("base").isin("valor_total", "valor_com_desconto"))
        .select(*keys, "base").distinct()
    )
    hit = rows.join(proven, list(keys))
    numerator = not_nan(F.col(f"`{roles['margem_bruta']}`").try_cast("double"))
    denominator = F.lit(None).cast("double")
    for base in ("valor_total", "valor_com_desconto"):
        if base in roles:
            value = not_nan(F.col(f"`{roles[base]}`").try_cast("double"))
            denominator = F.when(F.col("base") == base, value).otherwise(denominator)
    usable = numerator.isNotNull() & denominator.isNotNull() & (denominator != 0)
    total = hit.agg(
        F.sum(F.when(usable, numerator)).alias("n"),
        F.sum(F.when(usable, denominator)).alias("d"),
        F.count_if(usable).alias("linhas_base"),
        F.min("base").alias("b1"),
        F.max("base").alias("b2"),
    )
    return total.where((F.col("b1") == F.col("b2")) & (F.col("linhas_base") > 0) & (F.col("d") != 0)).select(
        (F.col("n") / F.col("d") * 100).alias("margem_bruta_percentual"),
        F.col("linhas_base"),
        F.lit(FORMULA_METHOD).alias("metodo"),
    )
