"""Key relationships between tables and the star built from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..functions.text import header_name
from .roles import classify_columns, column_frame

# Thresholds and names.
KEY_UNIQUENESS = 0.98
MIN_COVERAGE = 60.0
MIN_CONFIDENCE = 70.0
ONE_TO_MANY, ONE_TO_ONE = "um_para_muitos", "um_para_um"
TRANSACTIONAL = (
    "venda", "vendas", "historico_vendas", "devolucao", "devolucoes", "pedido", "pedidos", "pedidos_compra",
    "campanha", "campanhas", "custo_operacional", "custos_operacionais", "satisfacao", "avaliacao", "avaliacoes",
)
SALES_NAMES = ("vendas", "sales", "transacoes", "transactions")
FK_WEIGHT, SALES_WEIGHT, HISTORY_WEIGHT = 10_000, 20_000, -5_000
NAME_BONUS, TRANSACTION_PENALTY = 50, -100
TXT_TRANSACTIONAL = "Tabela classificada como transacional/auxiliar."
TXT_NOT_UNIQUE = "{}.{} não é uma PK única."


def singular(name: Column) -> Column:
    """Portuguese plural endings removed from a normalised name."""
    return (
        F.when(F.endswith(name, F.lit("oes")), F.regexp_replace(name, "oes$", "ao"))
        .otherwise(F.regexp_replace(name, "s$", ""))
    )


def key_entity(name: Column) -> Column:
    """What a key column identifies: its words without ``id``."""
    return F.array_join(F.filter(F.split(name, "_"), lambda w: w != "id"), "_")


def key_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """Key-like columns of all tables with entity and type family."""
    mapped = classify_columns(column_frame(tables))
    name = F.col("name")
    looks = (
        (name == "id") | F.endswith(name, F.lit("_id")) | F.startswith(name, F.lit("id_"))
        | F.col("role_kind").isin("identificador", "identificador_dimensao")
    )
    family = F.when(F.col("kind").isin("numeric", "text"), F.col("kind")).otherwise(F.col("dtype"))
    return mapped.where(looks).select(
        "table", "table_pos", "column", "position", singular(key_entity(name)).alias("entity"), family.alias("family"))


def _key_text(df: DataFrame, column: str) -> Column:
    """Key as text, equal numbers of different types alike."""
    c, t = F.col(f"`{column}`"), dict(df.dtypes)[column]
    if t in ("double", "float"):
        whole = c == F.floor(c)
        return F.when(F.isnan(c), None).when(whole & (F.abs(c) < 9e15), c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def key_values(tables: dict[str, DataFrame], wanted: dict[str, list[str]]) -> DataFrame:
    """(table, column, value, n) of the key columns, one aggregated pass per table."""
    out = None
    for table, columns in wanted.items():
        df = tables[table]
        cells = F.array(*[F.struct(F.lit(c).alias("column"), _key_text(df, c).alias("value")) for c in columns])
        part = (
            df.select(F.inline(cells)).where(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
            .select(F.lit(table).alias("table"), "column", "value", "n")
        )
        out = part if out is None else out.unionByName(part)
    return out


def uniqueness(values: DataFrame) -> DataFrame:
    """(table, column, filled, distinct_values, rate)."""
    return values.groupBy("table", "column").agg(F.sum("n").alias("filled"), F.count(F.lit(1)).alias("distinct_values")).select(
        "*", F.round(F.col("distinct_values") / F.col("filled"), 4).alias("rate"))


def table_affinity(table: Column, column: Column) -> Column:
    """How well a table name fits the entity of its key: 100, 70, 60 or 0."""
    t, e = singular(header_name(table)), singular(key_entity(header_name(column)))
    return (
        F.when(e == "", 0.0).when(t == e, 100.0).when(F.contains(t, e), 70.0).when(F.contains(e, t), 60.0).otherwise(0.0)
    )


def detect_relationships(tables: dict[str, DataFrame]) -> DataFrame:
    """Relationships found between key-like columns of the same entity.

    Candidate pairs are a self-join of the column frame on the entity name; the
    overlap of all pairs is one aggregation of the distinct key values, so no
    column is a join key.
    """
    keys = key_columns(tables)
    found = keys.select("table", "column", "entity", "family", "table_pos", "position").collect()
    shared = {}
    for k in found:
        shared.setdefault((k["entity"], k["family"]), set()).add(k["table"])
    wanted: dict[str, list[str]] = {}
    for k in found:
        if k["entity"] and len(shared[(k["entity"], k["family"])]) > 1:
            wanted.setdefault(k["table"], []).append(k["column"])
    spark = keys.sparkSession
    schema = ("tabela_a string, coluna_a string, tabela_b string, coluna_b string, tipo_relacionamento string, "
              "tabela_pk string, coluna_pk string, tabela_fk string, coluna_fk string, cobertura double, confianca double, "
              "afinidade_pk double, unicidade_a double, unicidade_b double")
    if not wanted:
        return spark.createDataFrame([], schema)
    values = cut_lineage(key_values(tables, wanted))
    catalogue = spark.createDataFrame(
        [tuple(k) for k in found if k["column"] in wanted.get(k["table"], [])],
        "table string, column string, entity string, family string, table_pos int, position int")
    rated = catalogue.join(uniqueness(values), ["table", "column"])
    side = lambda s: rated.select(*[F.col(c).alias(f"{c}_{s}") for c in rated.columns])
    pairs = side("a").join(
        side("b"),
        (F.col("entity_a") == F.col("entity_b")) & (F.col("family_a") == F.col("family_b")) & (F.col("table_pos_a") < F.col("table_pos_b")),
    )
    unique_a, unique_b = F.col("rate_a") >= KEY_UNIQUENESS, F.col("rate_b") >= KEY_UNIQUENESS
    pairs = pairs.where(unique_a | unique_b)

    # One row per value and kind of key with the columns that hold it: a set as small as the schema, from which pairs are counted.
    held = values.join(F.broadcast(catalogue), ["table", "column"]).groupBy("entity", "family", "value").agg(
        F.collect_set(F.struct("table_pos", "table", "column")).alias("columns")).where(F.size("columns") > 1)
    names = ["table_a", "column_a", "table_b", "column_b"]
    met = held.select("columns", F.explode("columns").alias("x")).select("x", F.explode("columns").alias("y")).where("x.table_pos < y.table_pos")
    overlap = met.select(F.col("x.table").alias("table_a"), F.col("x.column").alias("column_a"), F.col("y.table").alias("table_b"), F.col("y.column").alias("column_b")).groupBy(
        *names).agg(F.count(F.lit(1)).alias("common"))
    both = unique_a & unique_b
    joined = pairs.join(overlap, names, "left").withColumn("common", F.coalesce("common", F.lit(0)))
    base_count = (
        F.when(both, F.least("distinct_values_a", "distinct_values_b"))
        .when(unique_a, F.col("distinct_values_b")).otherwise(F.col("distinct_values_a"))
    )
    coverage = F.round(F.col("common") / base_count * 100, 2)
    pick = lambda x, y: F.when(~both, F.when(unique_a, F.col(x)).otherwise(F.col(y)))
    enriched = joined.select(
        "*", both.alias("both"), coverage.alias("cobertura"),
        pick("table_a", "table_b").alias("tabela_pk"), pick("column_a", "column_b").alias("coluna_pk"),
        pick("table_b", "table_a").alias("tabela_fk"), pick("column_b", "column_a").alias("coluna_fk"),
    ).withColumn("afinidade_pk", F.when(~F.col("both"), table_affinity(F.col("tabela_pk"), F.col("coluna_pk"))))
    confidence = F.when(F.col("both"), 90.0).otherwise(
        F.round(F.least(30 + F.col("cobertura") * 0.4 + F.col("afinidade_pk") * 0.3, F.lit(100.0)), 2))
    return (
        enriched.withColumn("confianca", confidence)
        .where((F.col("cobertura") >= MIN_COVERAGE) & (F.col("both") | (F.col("confianca") >= MIN_CONFIDENCE)))
        .select(
            F.col("table_a").alias("tabela_a"), F.col("column_a").alias("coluna_a"),
            F.col("table_b").alias("tabela_b"), F.col("column_b").alias("coluna_b"),
            F.when(F.col("both"), ONE_TO_ONE).otherwise(ONE_TO_MANY).alias("tipo_relacionamento"),
            "tabela_pk", "coluna_pk", "tabela_fk", "coluna_fk", "cobertura", "confianca", "afinidade_pk",
            F.col("rate_a").alias("unicidade_a"), F.col("rate_b").alias("unicidade_b"),
        )
    )


def transactional(table: Column) -> Column:
    name = header_name(table)
    hit = F.lit(False)
    for term in TRANSACTIONAL:
        hit = hit | F.contains(name, F.lit(term))
    return hit


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, position, rows); parquet answers the counts from file footers."""
    out = None
    for i, (name, df) in enumerate(tables.items()):
        part = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), F.lit(i).alias("position"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


def fact_scores(sizes: DataFrame, relations: DataFrame) -> DataFrame:
    """(table, score): rows, foreign keys and name decide which table is the fact."""
    fks = relations.where(F.col("tipo_relacionamento") == ONE_TO_MANY).groupBy(F.col("tabela_fk").alias("table")).agg(
        F.count(F.lit(1)).alias("fks"))
    name = header_name(F.col("table"))
    return sizes.join(fks, "table", "left").select(
        "table", "position",
        (F.col("rows") + F.coalesce("fks", F.lit(0)) * FK_WEIGHT
         + F.when(name.isin(*SALES_NAMES), SALES_WEIGHT).otherwise(0)
         + F.when(F.contains(name, F.lit("historico")), HISTORY_WEIGHT).otherwise(0)).alias("score"))


def dimension_candidates(relations: DataFrame, fact: str) -> DataFrame:
    """Best dimension for each foreign key of the fact, with its score."""
    entity = F.regexp_replace(key_entity(header_name(F.col("coluna_pk"))), "s$", "")
    fits = (entity != "") & F.contains(header_name(F.col("tabela_pk")), entity)
    score = (
        F.col("confianca") + F.when(fits, NAME_BONUS).otherwise(0)
        + F.when(transactional(F.col("tabela_pk")), TRANSACTION_PENALTY).otherwise(0)
    )
    scored = relations.where((F.col("tipo_relacionamento") == ONE_TO_MANY) & (F.col("tabela_fk") == fact)).withColumn("score", score)
    row = F.struct("tabela_pk", "coluna_pk", "cobertura", "confianca", "score")
    best = scored.groupBy("coluna_fk").agg(
        F.max_by(row, F.struct(F.col("score"), F.col("confianca"), F.col("tabela_pk"))).alias("d"))
    return best.select("coluna_fk", "d.*", transactional(F.col("d.tabela_pk")).alias("transactional"))


def unique_key(df: DataFrame, column: str) -> DataFrame:
    """One row: is the column a key (filled values all different, at least one)?"""
    value = _key_text(df, column)
    per_value = df.where(value.isNotNull()).groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return per_value.agg((F.coalesce(F.max("n"), F.lit(0)) == 1).alias("is_key"))


def join_dimension(fact: DataFrame, dimension: DataFrame, fk: str, pk: str, table: str) -> DataFrame:
    """Left many-to-one join; dimension columns get the table name as prefix.

    No hint: Spark broadcasts the dimension only when its measured size allows
    it, and otherwise sort-merges with skew splitting.
    """
    renamed = dimension.where(F.col(f"`{pk}`").isNotNull()).select(
        F.col(f"`{pk}`").alias("_pk"), *[F.col(f"`{c}`").alias(f"{table}__{c}") for c in dimension.columns if c != pk])
    return fact.join(renamed, F.col(f"`{fk}`") == F.col("_pk"), "left").drop("_pk")


@dataclass
class Star:
    frame: DataFrame
    fact: str
    log: list[tuple]

    def log_frame(self) -> DataFrame:
        return self.frame.sparkSession.createDataFrame(
            self.log, "status string, tabela_base string, tabela_adicionada string, coluna_fk string, coluna_pk string, "
                      "score_dimensao double, colunas_adicionadas int, motivo string")


def build_star(tables: dict[str, DataFrame], relations: DataFrame, fact: str | None = None) -> Star:
    """Fact table with its best dimensions joined on, and a log of each decision."""
    if fact is None:
        fact = fact_scores(table_sizes(tables), relations).agg(
            F.max_by("table", F.struct(F.col("score"), -F.col("position"))).alias("t")).first()["t"]
    if fact not in tables:
        raise ValueError(f"unknown fact table {fact!r}")
    picks = dimension_candidates(relations, fact).orderBy(F.desc("score"), "coluna_fk").collect()
    out, used, log = tables[fact], set(), []
    for p in picks:
        dim, fk, pk = p["tabela_pk"], p["coluna_fk"], p["coluna_pk"]
        if p["transactional"]:
            log.append(("ignorado", fact, dim, fk, pk, float(p["score"]), 0, TXT_TRANSACTIONAL))
        elif dim not in used:
            if not unique_key(tables[dim], pk).first()["is_key"]:
                log.append(("ignorado", fact, dim, fk, pk, float(p["score"]), 0, TXT_NOT_UNIQUE.format(dim, pk)))
                continue
            out = join_dimension(out, tables[dim], fk, pk, dim)
            used.add(dim)
            log.append(("sucesso", fact, dim, fk, pk, float(p["score"]), len(tables[dim].columns) - 1, None))
    return Star(out, fact, log)
