"""Assisted mapping: what a column structurally is, what it may mean, and applying the choice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import parse_date_text
from ..functions.numeric import not_nan
from ..functions.ordered import last_known
from .quality import column_kinds, null_profile, value_frequencies
from .roles import CATALOGUE, UNKNOWN, classify_columns, column_frame

# Structural types, concepts that fit each, labels, target names, thresholds.
EMPTY, DATE, IDENTIFIER, MONEY, NUMBER, PAYMENT, TEXT = (
    "vazio", "data", "identificador_provavel", "valor_monetario", "valor_numerico", "categoria_pagamento", "texto")
MEASURES = ("faturamento", "custo", "lucro", "valor_total", "valor_com_desconto", "margem_bruta", "margem_bruta_percentual",
            "quantidade", "preco_unitario", "custo_unitario", "margem_lucro", "estoque_atual", "taxa_devolucao", "outro", "ignorar")
COMPATIBLE = {
    DATE: ("data", "ignorar"),
    NUMBER: MEASURES,
    MONEY: MEASURES,
    IDENTIFIER: ("identificador", "pedido", "venda_id", "cliente_id", "produto_id", "loja_id", "colaborador_id", "outro", "ignorar"),
    PAYMENT: ("forma_pagamento", "pagamento", "status", "categoria", "outro", "ignorar"),
    TEXT: ("cliente", "produto", "categoria", "status", "pagamento", "forma_pagamento", "loja", "colaborador", "canal_venda",
           "regiao", "cidade", "outro", "ignorar"),
    EMPTY: ("ignorar",),
}
PAYMENT_WORDS = ("dinheiro", "credito", "debito", "pix", "cheque", "transferencia", "transferencia bancaria")
EXTRA_CONCEPTS = ("forma_pagamento", "identificador", "outro", "ignorar")
CONCEPT_LABELS = {
    "margem_lucro": "Margem de lucro", "preco_unitario": "Preço unitário", "custo_unitario": "Custo unitário",
    "pagamento": "Forma de pagamento", "forma_pagamento": "Forma de pagamento", "identificador": "Identificador provável",
    "outro": "Outro / dimensão genérica", "ignorar": "Ignorar",
}
TARGET_NAMES = {
    "venda_id": "Venda_ID", "cliente_id": "Cliente_ID", "produto_id": "Produto_ID", "loja_id": "Loja_ID", "custo": "Custo_Total",
}
BUSINESS = ("faturamento", "custo", "lucro", "valor_total", "valor_com_desconto", "margem_bruta", "quantidade", "preco_unitario")
REPEATABLE = ("outro", "ignorar", "identificador")
SURE, TYPE_SHARE, PAYMENT_SHARE, ID_UNIQUE, ID_STEPS = 80, 0.95, 0.8, 0.95, 0.35
RELEVANT_MIN, RELEVANT_SHARE, MANY_TEXTS, EXAMPLES = 3, 0.02, 30, 3
MASK_ID = ("Identificadores preservados", "Valores ocultados por privacidade")
MASK_TEXT = ("Exemplo textual ocultado", "Valores com alta cardinalidade", "Conteúdo preservado")
TXT_DROPPED = "Coluna excluída somente do dataset analítico por confirmação do usuário."
TXT_MAPPED = "Mapeamento confirmado pelo usuário: {} → {}."
TXT_AUTOMATIC = "Conceito identificado automaticamente: {}."
TXT_DATES = ("Conversão de data com alta confiança; {} valores não parseáveis ficaram nulos no dataset analítico. "
             "O arquivo enviado permanece preservado.")
BY_USER, AUTOMATIC, PARTIAL_DATE = (
    "mapeamento_semantico_usuario", "mapeamento_semantico_automatico", "conversao_data_com_valores_invalidos")


def concepts(spark: SparkSession) -> DataFrame:
    """(id, label) of every concept a column can be given."""
    names = list(dict.fromkeys([r for r, *_ in CATALOGUE] + list(EXTRA_CONCEPTS)))
    return spark.createDataFrame([(n, CONCEPT_LABELS.get(n, n.replace("_", " ").capitalize())) for n in names], "id string, label string")


def compatible_concepts(role: Column) -> Column:
    table = F.create_map(*[x for k, v in COMPATIBLE.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))])
    return F.coalesce(F.try_element_at(table, role), F.array(F.lit("ignorar")))


def _value_facts(df: DataFrame) -> DataFrame:
    """Ratios per column from distinct values and their frequencies."""
    freq = value_frequencies(df)
    number = not_nan(F.col("value").try_cast("double"))
    text = F.lower(F.trim(F.col("value")))
    pays = reduce(lambda a, b: a | b, [(text == w) | F.startswith(text, F.lit(w + " ")) for w in PAYMENT_WORDS])
    known = F.col("value").isNotNull()
    weigh = lambda cond: F.sum(F.when(known & cond, F.col("n")).otherwise(0))
    return freq.groupBy("column").agg(
        F.sum("n").alias("rows"), weigh(F.lit(True)).alias("filled"), F.count("value").alias("cardinality"),
        weigh(parse_date_text(F.col("value")).isNotNull()).alias("dates"), weigh(number.isNotNull()).alias("numbers"),
        F.count_distinct(number).alias("distinct_numbers"), weigh((number.isNotNull()) & (number % 1 != 0)).alias("fractions"),
        weigh(pays).alias("payments"))


def step_shares(df: DataFrame, columns: list[str], row_no: str | None) -> DataFrame:
    """(column, step_share): how often a value follows its predecessor by exactly one.

    Predecessors are taken in source order, or in value order when the table has
    none; the lag is computed in chunks of consecutive rows.
    """
    parts = []
    for c in columns:
        v = not_nan(F.col(f"`{c}`").try_cast("double"))
        order = F.col(f"`{row_no}`") if row_no else v
        slim = df.select(F.lit(c).alias("column"), order.alias("o"), v.alias("v")).where(v.isNotNull())
        gaps = last_known(slim, ["column"], "o", {"p": F.col("v")}, before=True).where("p is not null")
        parts.append(gaps.groupBy("column").agg(F.avg(F.when(F.abs(F.col("v") - F.col("p")) == 1, 1.0).otherwise(0.0)).alias("step_share")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def structural_types(df: DataFrame, row_no: str | None = None) -> DataFrame:
    """(column, position, role, role_confidence, …) per column."""
    data = df.drop(row_no) if row_no else df
    facts = column_kinds(data).join(_value_facts(data), "column").drop("dtype")
    share = lambda c: F.try_divide(F.col(c), F.col("filled"))
    facts = facts.withColumns({"date_share": share("dates"), "number_share": share("numbers"), "payment_share": share("payments"),
                               "unique_share": F.try_divide(F.col("distinct_numbers"), F.col("numbers"))})
    likely = (F.col("kind") != "date") & (F.col("date_share") < TYPE_SHARE) & (F.col("number_share") >= TYPE_SHARE) & \
        (F.col("unique_share") >= ID_UNIQUE) & (F.col("fractions") == 0)
    keys = [r["column"] for r in facts.where(likely).select("column").collect()]
    if keys:
        facts = facts.join(step_shares(df, keys, row_no), "column", "left")
    else:
        facts = facts.withColumn("step_share", F.lit(None).cast("double"))
    numeric = F.col("number_share") >= TYPE_SHARE
    role = (
        F.when(F.col("filled") == 0, EMPTY).when((F.col("kind") == "date") | (F.col("date_share") >= TYPE_SHARE), DATE)
        .when(numeric & (F.col("step_share") >= ID_STEPS), IDENTIFIER).when(numeric & (F.col("fractions") > 0), MONEY)
        .when(numeric, NUMBER).when(F.col("payment_share") >= PAYMENT_SHARE, PAYMENT).otherwise(TEXT)
    )
    sure = (
        F.when(F.col("filled") == 0, 0.0).when(F.col("kind") == "date", 1.0).when(F.col("date_share") >= TYPE_SHARE, F.col("date_share"))
        .when(numeric, F.col("number_share")).when(F.col("payment_share") >= PAYMENT_SHARE, F.col("payment_share"))
        .otherwise(1 - F.col("number_share"))
    )
    return facts.select("column", "position", role.alias("role"), sure.alias("role_confidence"), "rows", "filled", "cardinality")


#: Letters of an example that are shown.
SHOWN = 80


def _examples(df: DataFrame, row_no: str | None) -> DataFrame:
    """(column, examples): the first three values in source order, or the smallest."""
    data = df.drop(row_no) if row_no else df
    types = dict(data.dtypes)
    order = F.col(f"`{row_no}`") if row_no else F.lit(0)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in types])
    first = df.select(order.alias("_o"), F.inline(cells)).where("value is not null").groupBy("column", "value").agg(F.min("_o").alias("_o"))
    w = Window.partitionBy("column").orderBy("_o", "value")
    top = first.withColumn("i", F.row_number().over(w)).where(F.col("i") <= EXAMPLES)
    return top.groupBy("column").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "value"))), lambda s: F.substring(s["value"], 1, SHOWN)).alias("seen"))


def profile_columns(df: DataFrame, row_no: str | None = None, headers: DataFrame | None = None) -> DataFrame:
    """One row per column: structure, suggested concept, confidence, state, masked examples, relevance.

    ``headers`` optionally carries evidence of a later header row:
    (column, label, suggestion, header_confidence, header_origin, validated, allowed).
    """
    data = df.drop(row_no) if row_no else df
    types = structural_types(df, row_no)
    named = classify_columns(column_frame({"t": data})).select("column", F.col("role").alias("named_role"), F.col("confidence").alias("named_conf"))
    nulls = null_profile(data).select("column", "null_percent")
    rows = types.join(named, "column").join(nulls, "column").join(_examples(df, row_no), "column", "left")
    if headers is None:
        none = {"suggestion": "string", "header_confidence": "double", "header_origin": "string", "validated": "boolean", "allowed": "boolean"}
        rows = rows.withColumns({k: F.lit(None).cast(t) for k, t in none.items()})
    else:
        rows = rows.join(headers.drop("label"), "column", "left")
    rows = rows.withColumn("compatible", compatible_concepts(F.col("role")))
    fits = F.array_contains("compatible", F.col("suggestion")) | ((F.col("role") == EMPTY) & (F.col("suggestion") == "margem_bruta_percentual"))
    by_header = F.coalesce(F.col("validated") & F.col("allowed") & fits & (F.col("header_confidence") >= 95), F.lit(False))
    by_name = (F.col("named_conf") >= SURE) & (F.col("named_role") != UNKNOWN)
    concept = (
        F.when(by_header, F.col("suggestion")).when(by_name, F.col("named_role"))
        .when((F.col("role") == DATE) & (F.col("role_confidence") >= TYPE_SHARE), "data")
        .when((F.col("role") == PAYMENT) & (F.col("role_confidence") >= PAYMENT_SHARE), "forma_pagamento")
        .when(F.col("role") == IDENTIFIER, "identificador")
    )
    sure = (
        F.when(by_header, F.col("header_confidence") / 100).when(by_name, F.col("named_conf") / 100)
        .when(F.col("role").isin(DATE, PAYMENT, IDENTIFIER), F.col("role_confidence")).otherwise(F.col("named_conf") / 100)
    )
    rows = rows.withColumn("concept", concept).withColumn("concept_confidence", F.round(sure, 2))
    masked = (
        F.when(F.col("role") == IDENTIFIER, F.array(*[F.lit(m) for m in MASK_ID]))
        .when((F.col("role") == TEXT) & (F.col("cardinality") > MANY_TEXTS), F.array(*[F.lit(m) for m in MASK_TEXT])).otherwise(F.col("seen"))
    )
    floor = F.greatest(F.lit(RELEVANT_MIN), F.floor(F.col("rows") * RELEVANT_SHARE))
    relevant = F.col("filled") >= floor
    known, guess = F.col("concept").isNotNull(), F.col("concept") == "identificador"
    asked = relevant & (~known | ((F.col("role") == IDENTIFIER) & guess)) & F.col("role").isin(NUMBER, MONEY, IDENTIFIER, PAYMENT, TEXT)
    return rows.select(
        "column", "position", "role", F.round("role_confidence", 2).alias("role_confidence"), "concept", "concept_confidence",
        F.when(guess | (F.col("role") == PAYMENT), "provavel").when(known, "confirmado").otherwise("desconhecido").alias("state"),
        masked.alias("examples"), F.round("null_percent", 2).alias("null_percent"), "cardinality", relevant.alias("relevant"),
        "compatible", "suggestion", F.coalesce(asked, F.lit(False)).alias("required"), "named_role", "named_conf",
    )


def needs_confirmation(profile: DataFrame, from_report: bool) -> DataFrame:
    """One row: must the user confirm the mapping? Only tables recovered from a report are asked about."""
    business = ((F.col("named_conf") >= SURE) & F.col("named_role").isin(*BUSINESS)) | F.coalesce(F.col("concept").isin(*BUSINESS), F.lit(False))
    unsure = F.col("required") & F.col("suggestion").isNotNull() & F.col("concept").isNull()
    ask = F.bool_or("required") & (~F.bool_or(business) | F.bool_or(unsure))
    return profile.agg((F.lit(from_report) & F.coalesce(ask, F.lit(False))).alias("ask"), F.count_if("required").alias("required_columns"))


def mapping_errors(profile: DataFrame, chosen: dict[str, str]) -> DataFrame:
    """(column, concept, error) for every choice that cannot be accepted and every column left open."""
    spark = profile.sparkSession
    picks = spark.createDataFrame(list(chosen.items()) or [("", "")], "column string, concept string").where("column <> ''")
    required = profile.where("required").select("column", "compatible")
    missing = required.join(picks, "column", "left_anti").select("column", F.lit(None).cast("string").alias("concept"), F.lit("missing").alias("error"))
    exists = profile.select("column", F.lit(True).alias("exists"))
    known = concepts(spark).select(F.col("id").alias("concept"), F.lit(True).alias("known"))
    w = Window.partitionBy("concept")
    twice = (F.count(F.lit(1)).over(w) > 1) & ~F.col("concept").isin(*REPEATABLE)
    judged = picks.withColumn("twice", twice).join(exists, "column", "left").join(known, "concept", "left").join(required, "column", "left")
    error = (
        F.when(F.col("exists").isNull(), "unknown_column").when(F.col("known").isNull(), "unknown_concept")
        .when(F.col("compatible").isNull() | ~F.array_contains("compatible", F.col("concept")), "incompatible").when(F.col("twice"), "used_twice")
    )
    return missing.unionByName(judged.select("column", "concept", error.alias("error")).where("error is not null"))


def target_name(concept: str) -> str:
    return TARGET_NAMES.get(concept, "_".join(p.capitalize() for p in concept.split("_")))


def apply_mapping(df: DataFrame, automatic: dict[str, str], confirmed: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Frame with columns dropped, renamed and dates converted, and the audit of it.

    A confirmed choice replaces an automatic one; a column named as date must
    parse for at least 95 % of its values.
    """
    combined = {**automatic, **confirmed}
    unknown = [c for c in combined if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns: {unknown}")
    out, audit, generic = df, [], 1
    dates = [c for c, k in combined.items() if k == "data" and dict(df.dtypes)[c] == "string"]
    counts = df.agg(F.count(F.lit(1)), *[F.count(F.col(f"`{c}`")).alias(f"f{i}") for i, c in enumerate(dates)],
                    *[F.count(parse_date_text(F.col(f"`{c}`"))).alias(f"p{i}") for i, c in enumerate(dates)]).first() if dates else None
    for column, concept in combined.items():
        kind = BY_USER if column in confirmed else AUTOMATIC
        if concept == "ignorar":
            out = out.drop(column)
            audit.append((kind, column, concept, TXT_DROPPED if kind == BY_USER else TXT_AUTOMATIC.format(concept)))
            continue
        target = target_name(concept)
        if concept in ("outro", "identificador"):
            target = f"Dimensao_Generica_{generic}" if concept == "outro" else f"Identificador_{generic}"
            generic += 1
        audit.append((kind, column, concept, TXT_MAPPED.format(column, concept) if kind == BY_USER else TXT_AUTOMATIC.format(concept)))
        if column in dates:
            filled, parsed = counts[f"f{dates.index(column)}"], counts[f"p{dates.index(column)}"]
            if parsed / max(1, filled) < TYPE_SHARE:
                raise ValueError(f"column {column} is no date column")
            out = out.withColumn(column, parse_date_text(F.col(f"`{column}`")))
            if filled > parsed:
                audit.append((PARTIAL_DATE, column, "data", TXT_DATES.format(filled - parsed)))
        out = out.withColumnRenamed(column, target)
    return out, df.sparkSession.createDataFrame(audit, "tipo string, coluna string, conceito string, descricao string")
