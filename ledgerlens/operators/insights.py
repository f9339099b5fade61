"""Product detail, opportunity and insight rules, status and summary.

Every rule is a filter over an aggregate frame (a handful of rows) that yields
message rows; the rules are united and then ranked. Lists are short by
definition, so the ordered windows below see a few dozen rows. Pass the
aggregate frames materialised (``session.cut_lineage``): a rule filters on
computed fields, and the filter would otherwise be pushed into their definition
once per rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import not_nan
from ..functions.text import display_entity, number_text
from .findings import filled
from .metrics import KPI_KEYS, Roles
from .rankings import labelled_groups, top_entities

# Order of priorities and kinds, list lengths, public type names.
PRIORITY_RANK = {"alta": 3, "media": 2, "baixa": 1}
KIND = {"atencao": "risco", "revisao": "risco", "positivo": "destaque"}
PRECEDENCE = {"risco": 2, "oportunidade": 1, "destaque": 0, "informativo": 0}
PUBLIC_TYPE = {"risco": "atencao", "destaque": "positivo"}
MAX_RISKS, MAX_OPPORTUNITIES, MAX_INSIGHTS = 5, 5, 8
TOP_DETAIL = 5
LOW_CONCENTRATION = 20
BUSINESS_KPIS = ("faturamento_total", "lucro_total", "custo_total", "margem_lucro")
COUNT_KPIS = ("quantidade_registros", "quantidade_pedidos")
# Messages.
O_REVENUE_DOWN = "O faturamento diminuiu entre o primeiro e o último período observado ({}%). Vale investigar os períodos e dimensões que mais contribuíram para essa redução."
O_RUN = "Foi identificada uma sequência de quedas no faturamento nos períodos: {}."
O_PROFIT_DOWN = "O lucro diminuiu entre o primeiro e o último período observado ({}%). Vale revisar custos, margens e fontes de receita."
O_LOSSES = "Foram encontrados {} registros com resultado negativo, totalizando {}. Esses registros podem ser investigados para identificar fontes de perda."
O_GROWTH = "O produto '{}' apresenta lucro acima da média e faturamento abaixo da média, indicando possível espaço para crescimento."
O_STOCKOUT = "O produto '{}' está em risco de ruptura de estoque, com estoque atual de {} e mínimo de {}."
O_STOCKOUT_PLAIN = "O produto '{}' está em risco de ruptura de estoque."
O_EXCESS = "O produto '{}' apresenta estoque elevado em relação ao limite definido. Vale avaliar giro, compras futuras ou ações comerciais."
O_RETURNS = "O produto '{}' possui taxa de devolução de {}%, acima da média de {}%. Vale investigar motivos de devolução e qualidade do produto."
O_RATING = "O produto '{}' possui avaliação média de {}, abaixo da média geral de {}. Vale investigar possíveis problemas de qualidade ou expectativa do cliente."
O_SPREAD = "Os 5 maiores clientes representam {}% do faturamento. A receita apresenta baixa concentração entre os principais clientes."
I_BEST = "O período {} apresentou o maior valor de {}, totalizando {}."
I_DROP = "A maior queda mensal ocorreu em {}, com redução de {}%."
I_RISE = "O maior crescimento mensal ocorreu em {}, com aumento de {}%."
I_REVENUE_DOWN = "Entre o primeiro e o último período observado, o faturamento apresentou redução {}%."
I_LOSSES = "Foram identificados {} registros com resultado negativo, totalizando {}."
I_VOLUME = "O produto '{}' apresentou o maior volume de vendas, com {} unidades."
I_REVENUE = "O produto '{}' apresentou o maior faturamento, totalizando {}."
I_DIFFER = "O produto com maior volume ('{}') é diferente do produto com maior faturamento ('{}')."
I_STOCKOUT = "O produto '{}' está entre os produtos com risco de ruptura e possui volume relevante de vendas."
I_EXCESS = "Foram identificados {} produtos com estoque acima do nível máximo definido."
I_RETURNS = "O produto '{}' apresentou uma das maiores taxas de devolução, com {}%."
I_RATED_BEST = "O produto '{}' está entre os melhores avaliados, com nota média de {}."
I_RATED_WORST = "O produto '{}' está entre os produtos com menor avaliação média, com nota {}."
I_GROWTH = "O produto '{}' apresenta lucro acima da média e faturamento abaixo da média, sendo um possível candidato para investigação de crescimento."
I_TOP5 = "Os 5 maiores clientes representam {}% do faturamento total."
I_LEADER = "O cliente '{}' apresentou o maior faturamento da carteira, totalizando {}."
I_DIMENSION = "O destaque de faturamento na dimensão {} foi '{}', totalizando {}."
LEADING_DIMENSIONS = (
    ("canal_venda", "canal_desempenho", "canal"), ("loja", "loja_desempenho", "loja"),
    ("colaborador", "colaborador_desempenho", "colaborador"),
)
S_REVENUE_DOWN = "Faturamento apresenta tendência de queda."
S_PROFIT_DOWN = "Lucro apresenta tendência de queda."
S_LOSSES = "Existem registros com resultado negativo."


# ---------------------------------------------------------------- product detail

def product_detail(df: DataFrame, roles: Roles, row_no: str | None = None) -> DataFrame:
    """One row per product: sums, alerts, stock levels, best rating and worst return rate."""
    key, label = (roles["produto_id"], roles.get("produto")) if "produto_id" in roles else (roles["produto"], None)
    q = lambda r: F.col(f"`{roles[r]}`")
    num = lambda r: not_nan(q(r).try_cast("double")) if r in roles else F.lit(None).cast("double")
    flag = lambda r: F.coalesce(F.bool_or(q(r)), F.lit(False)) if r in roles else F.bool_or(F.lit(False))
    aggs = [(r, F.coalesce(F.sum(num(r)), F.lit(0.0)), F.sum) for r in ("quantidade", "faturamento", "lucro")]
    levels = ("avaliacao_media", "estoque_atual", "estoque_minimo", "estoque_maximo", "taxa_devolucao")
    aggs += [(r, F.max(num(r)), F.max) for r in levels]
    aggs += [(r, flag(r), F.bool_or) for r in ("risco_ruptura", "estoque_excessivo")]
    known = df.where(F.col(f"`{key}`").isNotNull())
    grouped = labelled_groups(known, {"entity": F.col(f"`{key}`")}, F.col(f"`{label}`") if label else None,
                              F.col(f"`{row_no}`") if row_no else None, aggs)
    return grouped.withColumn("product", display_entity(F.col("entity"), F.col("label")))


def product_means(detail: DataFrame) -> DataFrame:
    """One row: mean rating and return rate over products that have one, number of alerts."""
    return detail.agg(
        F.avg("avaliacao_media").alias("avaliacao_media_geral"), F.avg("taxa_devolucao").alias("taxa_devolucao_media"),
        F.count_if("risco_ruptura").alias("produtos_risco_ruptura"), F.count_if("estoque_excessivo").alias("produtos_estoque_excessivo"),
        F.count(F.lit(1)).alias("quantidade_produtos"),
    )


def product_extremes(detail: DataFrame, k: int = TOP_DETAIL) -> DataFrame:
    """(concept, position, …) for stock-out and excess risk, return rates, best and worst ratings."""
    entries = F.array(
        F.struct(F.lit("risco_ruptura").alias("concept"), F.when(F.col("risco_ruptura"), F.col("quantidade")).alias("value")),
        F.struct(F.lit("estoque_excessivo").alias("concept"), F.when(F.col("estoque_excessivo"), -F.col("quantidade")).alias("value")),
        F.struct(F.lit("maior_devolucao").alias("concept"), F.col("taxa_devolucao").alias("value")),
        F.struct(F.lit("melhor_avaliado").alias("concept"), F.col("avaliacao_media").alias("value")),
        F.struct(F.lit("pior_avaliado").alias("concept"), (-F.col("avaliacao_media")).alias("value")),
    )
    carried = ["entity", "product", "quantidade", "estoque_atual", "estoque_minimo", "taxa_devolucao", "avaliacao_media"]
    long = detail.select(*carried, F.inline(entries)).where(F.col("value").isNotNull())
    return top_entities(long, k).drop("value")


def product_ranking(detail: DataFrame, k: int = 10) -> DataFrame:
    """Ten products by revenue with everything known about them."""
    values = detail.select("*", F.lit("faturamento").alias("concept"), F.col("faturamento").alias("value"))
    return top_entities(values, k).select(
        F.col("position").cast("bigint").alias("position"), F.col("entity").cast("string").alias("product_id"), "product",
        "quantidade", "faturamento", "lucro", "avaliacao_media", "estoque_atual", "taxa_devolucao")


def merged_product_ranking(rankings: DataFrame, k: int = 10) -> DataFrame:
    """The same list built from the three top-five rankings when there is no detail."""
    one = lambda c: F.max(F.when(F.col("concept") == c, F.col("value"))).alias(c)
    merged = rankings.groupBy("product_id", "product").agg(one("quantidade"), one("faturamento"), one("lucro"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.coalesce("faturamento", F.lit(0.0)).desc(), "product_id")
    return merged.withColumn("position", F.row_number().over(w).cast("bigint")).where(F.col("position") <= k)


# ---------------------------------------------------------------- rules

def _message(df: DataFrame, seq: Column | int, category: str, kind: Column | str, priority: str, text: Column,
             value: Column | None = None, metric: Column | None = None, period: Column | None = None,
             origin: str = "insights") -> DataFrame:
    none = F.lit(None)
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select(
        lit(seq).cast("int").alias("seq"), F.lit(category).alias("category"), lit(kind).alias("type"), F.lit(priority).alias("priority"),
        text.alias("message"), (none if value is None else value).cast("double").alias("value"),
        (none if metric is None else metric).cast("string").alias("metric"),
        (none if period is None else period).cast("string").alias("period"), F.lit(origin).alias("origin"),
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def opportunities(growth: DataFrame, runs: DataFrame, performance: DataFrame, candidates: DataFrame, extremes: DataFrame,
                  means: DataFrame, concentration: DataFrame) -> DataFrame:
    """Opportunity rows in rule order (``seq``)."""
    def falling(metric: str) -> DataFrame:
        return growth.where((F.col("metric") == metric) & (F.col("trend") == "queda"))

    made = "oportunidades"
    rate, rating = means.select("taxa_devolucao_media").scalar(), means.select("avaliacao_media_geral").scalar()
    of = lambda concept, n: extremes.where((F.col("concept") == concept) & (F.col("position") <= n))
    longest = runs.where(F.col("metric") == "faturamento").orderBy(F.desc("length"), "start_ord").limit(1)
    evo = F.col("evolution")
    return _union([
        _message(falling("faturamento"), 100, "tendencia_faturamento", "atencao", "alta", filled(O_REVENUE_DOWN, number_text(evo)), evo, origin=made),
        _message(longest, 200, "sequencia_quedas_faturamento", "atencao", "alta", filled(O_RUN, F.array_join("periods", " -> ")),
                 period=F.array_join("periods", ", "), origin=made),
        _message(falling("lucro"), 300, "tendencia_lucro", "atencao", "alta", filled(O_PROFIT_DOWN, number_text(evo)), evo, origin=made),
        _message(performance.where("registros_prejuizo > 0"), 400, "resultado_negativo", "revisao", "media",
                 filled(O_LOSSES, F.col("registros_prejuizo").cast("string"), number_text(F.col("prejuizo_total"))),
                 F.col("registros_prejuizo"), origin=made),
        _message(candidates.where("position <= 3"), F.col("position") + 500, "produto_crescimento", "oportunidade", "media",
                 filled(O_GROWTH, F.col("product")), F.col("lucro"), origin=made),
        _message(of("risco_ruptura", 3), F.col("position") + 600, "estoque_ruptura", "atencao", "alta",
                 F.coalesce(filled(O_STOCKOUT, F.col("product"), number_text(F.col("estoque_atual")), number_text(F.col("estoque_minimo"))),
                            filled(O_STOCKOUT_PLAIN, F.col("product"))),
                 F.col("estoque_atual"), origin=made),
        _message(of("estoque_excessivo", 2), F.col("position") + 700, "estoque_excessivo", "revisao", "media",
                 filled(O_EXCESS, F.col("product")), F.col("estoque_atual"), origin=made),
        _message(of("maior_devolucao", 3).where(F.col("taxa_devolucao") > rate), F.col("position") + 800, "produto_devolucao", "atencao", "media",
                 filled(O_RETURNS, F.col("product"), number_text(F.col("taxa_devolucao")), number_text(rate)), F.col("taxa_devolucao"), origin=made),
        _message(of("pior_avaliado", 3).where(F.col("avaliacao_media") < rating), F.col("position") + 900, "produto_avaliacao_negativa", "revisao",
                 "media", filled(O_RATING, F.col("product"), number_text(F.col("avaliacao_media")), number_text(rating)),
                 F.col("avaliacao_media"), origin=made),
        _message(concentration.where(F.col("concentracao_top_5") < LOW_CONCENTRATION), 1000, "cliente_concentracao", "informativo", "baixa",
                 filled(O_SPREAD, number_text(F.col("concentracao_top_5"))), F.col("concentracao_top_5"), origin=made),
    ])


def run_periods(changes: DataFrame) -> DataFrame:
    """Decline runs with the list of their months (bounded by the calendar)."""
    w = Window.partitionBy("metric").orderBy("ord")
    falling = F.coalesce(F.col("percentage_change") < 0, F.lit(False))
    marked = changes.select("metric", "ord", "current_period", falling.alias("f"),
                            F.sum(F.when(falling, 0).otherwise(1)).over(w).alias("run"))
    return marked.where("f").groupBy("metric", "run").agg(
        F.count(F.lit(1)).alias("length"), F.min("ord").alias("start_ord"), F.sort_array(F.collect_list("current_period")).alias("periods"),
    ).where("length >= 2").drop("run")


def insights(metric_name: str, series_extremes: DataFrame, growth: DataFrame, performance: DataFrame, product_top: DataFrame,
             extremes: DataFrame, means: DataFrame, candidates: DataFrame, concentration: DataFrame, leader: DataFrame,
             dimension_top: DataFrame, metric_label: str) -> DataFrame:
    """Insight rows in rule order."""
    judged = metric_name != "custo"
    good, bad = ("positivo", "atencao") if judged else ("informativo", "informativo")
    best = series_extremes.where(F.col("metric") == metric_name)
    main = growth.where(F.col("metric") == metric_name)
    top = lambda c: product_top.where((F.col("concept") == c) & (F.col("position") == 1))
    first = lambda concept: extremes.where((F.col("concept") == concept) & (F.col("position") == 1))
    differ = top("quantidade").select(F.col("product").alias("p1"), F.col("product_id").alias("id1"), F.lit(1).alias("j")).join(
        top("faturamento").select(F.col("product").alias("p2"), F.col("product_id").alias("id2"), F.lit(1).alias("j")), "j").where("id1 <> id2")
    parts = [
        _message(best, 100, "melhor_periodo", good, "media",
                 filled(I_BEST, F.col("best_period"), F.lit(metric_label), number_text(F.col("best_value"))),
                 F.col("best_value"), F.lit(metric_name), F.col("best_period")),
        _message(main.where("drop_percent < 0"), 200, "maior_queda", bad, "alta",
                 filled(I_DROP, F.col("drop_period"), number_text(F.abs("drop_percent"))), F.col("drop_percent"), None, F.col("drop_period")),
        _message(main.where("growth_percent > 0"), 300, "maior_crescimento", good, "media",
                 filled(I_RISE, F.col("growth_period"), number_text(F.col("growth_percent"))), F.col("growth_percent"), None, F.col("growth_period")),
        _message(growth.where("metric = 'faturamento' AND trend = 'queda'"), 400, "tendencia_faturamento", "atencao", "alta",
                 filled(I_REVENUE_DOWN, number_text(F.abs("evolution"))), F.col("evolution")),
        _message(performance.where("registros_prejuizo > 0"), 500, "resultado_negativo", "atencao", "alta",
                 filled(I_LOSSES, F.col("registros_prejuizo").cast("string"), number_text(F.col("prejuizo_total"))), F.col("registros_prejuizo")),
        _message(top("quantidade"), 600, "produto_volume", "informativo", "media",
                 filled(I_VOLUME, F.col("product"), number_text(F.col("value"))), F.col("value")),
        _message(top("faturamento"), 700, "produto_faturamento", "positivo", "media",
                 filled(I_REVENUE, F.col("product"), number_text(F.col("value"))), F.col("value")),
        _message(differ, 800, "produto_rentabilidade", "informativo", "media", filled(I_DIFFER, F.col("p1"), F.col("p2")), origin="produtos"),
        _message(first("risco_ruptura"), 900, "estoque_ruptura", "atencao", "alta", filled(I_STOCKOUT, F.col("product")), origin="produtos"),
        _message(means.where("produtos_estoque_excessivo > 0"), 1000, "estoque_excessivo", "informativo", "media",
                 filled(I_EXCESS, F.col("produtos_estoque_excessivo").cast("string")), F.col("produtos_estoque_excessivo")),
        _message(first("maior_devolucao"), 1100, "produto_devolucao", "atencao", "media",
                 filled(I_RETURNS, F.col("product"), number_text(F.col("taxa_devolucao"))), F.col("taxa_devolucao")),
        _message(first("melhor_avaliado"), 1200, "produto_avaliacao_positiva", "positivo", "media",
                 filled(I_RATED_BEST, F.col("product"), number_text(F.col("avaliacao_media"))), F.col("avaliacao_media")),
        _message(first("pior_avaliado"), 1300, "produto_avaliacao_negativa", "informativo", "media",
                 filled(I_RATED_WORST, F.col("product"), number_text(F.col("avaliacao_media"))), F.col("avaliacao_media")),
        _message(candidates.where("position = 1"), 1400, "produto_crescimento", "oportunidade", "media",
                 filled(I_GROWTH, F.col("product")), F.col("lucro")),
        _message(concentration, 1500, "cliente_concentracao", "informativo", "baixa",
                 filled(I_TOP5, number_text(F.col("concentracao_top_5"))), F.col("concentracao_top_5")),
        _message(leader.where("concept = 'faturamento'"), 1600, "cliente_destaque", "positivo", "media",
                 filled(I_LEADER, F.col("customer"), number_text(F.col("value"))), F.col("value"), origin="clientes"),
    ]
    for i, (dimension, category, name) in enumerate(LEADING_DIMENSIONS):
        two = dimension_top.where((F.col("dimension") == dimension) & (F.col("position") <= 2)).groupBy("dimension").agg(
            F.max(F.when(F.col("position") == 1, F.col("value_label"))).alias("who"),
            F.max(F.when(F.col("position") == 1, F.col("faturamento"))).alias("lead"),
            F.max(F.when(F.col("position") == 2, F.col("faturamento"))).alias("second"))
        parts.append(_message(two.where("lead > second"), 1700 + i, category, "positivo", "baixa",
                              filled(I_DIMENSION, F.lit(name), F.col("who"), number_text(F.col("lead"))), F.col("lead"),
                              F.lit("faturamento"), origin="dimensoes"))
    return _union(parts)


def by_priority(rows: DataFrame) -> DataFrame:
    """Most urgent first, rule order inside a priority."""
    return rows.orderBy(_rank(F.col("priority"), PRIORITY_RANK).desc(), "seq")


# ---------------------------------------------------------------- lists

def _rank(c: Column, table: dict[str, int]) -> Column:
    out = F.lit(0)
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def _scored(rows: DataFrame) -> DataFrame:
    kind = F.col("type")
    for t, k in KIND.items():
        kind = F.when(F.col("type") == t, k).otherwise(kind)
    context = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in ("value", "metric", "period")), F.lit(0))
    return rows.where(F.trim("message") != "").withColumn("type", kind).withColumn("rel", F.struct(
        _rank(F.col("priority"), PRIORITY_RANK).alias("p"), context.alias("c"),
        F.when(F.col("message").rlike(r"\d"), 1).otherwise(0).alias("d"), F.length("message").alias("l"))
    ).withColumn("prec", _rank(F.col("type"), PRECEDENCE))


def one_per_category(rows: DataFrame) -> DataFrame:
    """Strongest row of each category; ``seq`` becomes the first place the category was seen."""
    scored = _scored(rows)
    w = Window.partitionBy("category").orderBy(F.col("prec").desc(), F.col("rel").desc(), "seq")
    first_seen = F.min("seq").over(Window.partitionBy("category"))
    return scored.withColumn("seen", first_seen).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "seq").withColumnRenamed("seen", "seq")


def subject(category: Column) -> Column:
    starts = lambda *ps: reduce(lambda a, b: a | b, [F.startswith(category, F.lit(p)) for p in ps])
    return (
        F.when(starts("cliente_", "produto_", "estoque_"), F.element_at(F.split(category, "_"), 1))
        .when(starts("tendencia_", "maior_", "melhor_periodo", "sequencia_"), "temporal").otherwise(category)
    )


def organise(opportunity_rows: DataFrame, insight_rows: DataFrame) -> DataFrame:
    """(list, position, category, priority, type, message): risks, opportunities and insights of the summary."""
    shift = insight_rows.withColumn("seq", F.col("seq") + 10_000)
    kept = one_per_category(opportunity_rows.unionByName(shift))
    text = F.lower(F.trim(F.regexp_replace("message", r"\s+", " ")))
    strongest = [F.col("prec").desc(), F.col("rel").desc(), F.col("seq")]
    unique = kept.withColumn("t", F.row_number().over(Window.partitionBy(text).orderBy(*strongest))).where("t = 1")
    unique = unique.withColumn("seq", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*strongest)))
    listed = unique.withColumn("list", F.when(F.col("type") == "risco", "principais_riscos").when(
        F.col("type") == "oportunidade", "oportunidades").otherwise("principais_insights"))
    in_list = Window.partitionBy("list").orderBy(F.col("rel").desc(), "seq")
    in_subject = Window.partitionBy("list", subject(F.col("category"))).orderBy(F.col("rel").desc(), "seq")
    diverse = listed.withColumn("rank", F.row_number().over(in_list)).withColumn("turn", F.row_number().over(in_subject))
    later = (F.col("list") == "principais_insights") & (F.col("turn") > 1)
    admitted = diverse.withColumn("later", later).withColumn(
        "slot", F.row_number().over(Window.partitionBy("list").orderBy("later", "rank")))
    limit = F.when(F.col("list") == "principais_riscos", MAX_RISKS).when(F.col("list") == "oportunidades", MAX_OPPORTUNITIES).otherwise(MAX_INSIGHTS)
    final = Window.partitionBy("list").orderBy(F.col("rel").desc(), "slot")
    public = F.col("type")
    for k, v in PUBLIC_TYPE.items():
        public = F.when(F.col("type") == k, v).otherwise(public)
    return admitted.where(F.col("slot") <= limit).select(
        "list", F.row_number().over(final).cast("bigint").alias("position"), "category", "priority", public.alias("type"), "message")


# ---------------------------------------------------------------- status and summary

def status(growth: DataFrame, performance: DataFrame, opportunity_rows: DataFrame) -> DataFrame:
    """Score, class and reasons; one row."""
    falls = lambda m: F.coalesce(F.bool_or((F.col("metric") == m) & (F.col("trend") == "queda")), F.lit(False))
    trends = growth.agg(falls("faturamento").alias("r"), falls("lucro").alias("p"))
    alerts = opportunity_rows.where((F.col("priority") == "alta") & F.col("type").isin("atencao", "revisao")).agg(F.count(F.lit(1)).alias("n")).scalar()
    losses = performance.select("registros_prejuizo").scalar() > 0
    r, p = F.col("r"), F.col("p")
    points = lambda c, n: F.when(c, n).otherwise(0)
    score = F.greatest(F.lit(0), F.lit(100) - points(r, 20) - points(p, 20) - points(losses, 10) - F.least(alerts * 5, F.lit(20)))
    return trends.select(
        score.cast("bigint").alias("score"),
        F.when(score >= 80, "saudavel").when(score >= 60, "atencao").otherwise("critico").alias("status"),
        F.array_compact(F.array(F.when(r, S_REVENUE_DOWN), F.when(p, S_PROFIT_DOWN), F.when(losses, S_LOSSES))).alias("reasons"),
    )


def sufficiency(kpi_row: DataFrame) -> DataFrame:
    """Is there enough to judge? Without a business indicator the status score is withheld."""
    known = lambda keys: F.coalesce(*[F.col(k) for k in keys]).isNotNull()
    useful = [k for k in KPI_KEYS if k not in COUNT_KPIS and k in kpi_row.columns]
    business = known(BUSINESS_KPIS)
    return kpi_row.select(
        F.when(business, "suficiente").when(known(useful), "parcial").otherwise("insuficiente").alias("sufficiency"),
        business.alias("score_shown"))


def mapping_provenance(automatic: DataFrame, confirmed: DataFrame) -> DataFrame:
    """(column, origin, confidence): a user's choice outranks a header, a header outranks content.

    ``automatic`` is (column, header_origin, header_confidence), ``confirmed`` is (column).
    """
    auto = automatic.select(
        "column", F.coalesce("header_origin", F.lit("conteudo")).alias("a_origin"), F.col("header_confidence").alias("a_conf"))
    chosen = confirmed.select("column", F.lit(True).alias("by_user"))
    return auto.join(chosen, "column", "full").select(
        "column", F.when(F.col("by_user"), "usuario").otherwise(F.col("a_origin")).alias("origin"),
        F.when(F.col("by_user"), 1.0).otherwise(F.round("a_conf", 2)).alias("confidence"))


def executive_summary(**parts: DataFrame) -> DataFrame:
    """One nested row; each part is a short frame and becomes an array of its rows."""
    columns = []
    base = None
    for name, frame in parts.items():
        row = frame.agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in frame.columns])).alias(name))
        if base is None:
            base = row
        else:
            columns.append(row.scalar().alias(name))
    return base.select("*", *columns)
