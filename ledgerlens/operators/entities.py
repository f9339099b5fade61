"""Near-duplicate entity names: candidates, decisions, aliases.

All steps work on distinct labels. Similar names are found by a join on
segments: names within ``k`` edits of each other share one of ``k + 1`` pieces of
the shorter one, at nearly the same place. No pair is lost, and names are only
compared with those that share a piece. Pieces that very many names share are
joined together with the piece that follows, which then differs by one edit at
most. The sorted neighbourhood, which looks at a few followers of each name, can
be had instead; it is built on a global order cut into rank chunks that overlap by
the neighbourhood size, so a prefix shared by most labels is spread over tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import not_nan
from ..functions.text import digest24, entity_key, json_text, squeeze
from ..session import cut_lineage
from .metrics import Roles
from .rankings import CUSTOMER_METRICS

# Fixed values. Similarity is one minus the edit distance over the longer length, the form that runs as a column;
# a letter or two in a long name stay above the threshold as they do with a ratio of matching blocks.
MIN_SIMILARITY, HIGH_SIMILARITY = 0.9, 0.97
MIN_LENGTH, MAX_LENGTH_GAP = 10, 0.12
NEIGHBOURS, PREFIX = 20, 3
UNITS = ("mm", "cm", "m", "km", "g", "kg", "ml", "l")
COMPANY_SUFFIXES = ("ltda", "me", "sa", "eireli")
ENTITY_TYPES = ("cliente", "produto", "categoria", "loja", "colaborador")
SPACING, CASE, ACCENT, SPELLING = (
    "diferenca_espacamento", "diferenca_caixa", "diferenca_acentuacao", "grafia_muito_semelhante")
MERGED, KEPT, PENDING = "merged", "kept_separate", "pending"
ERR_DECISION = "Decisão inválida. Escolha unir ou manter separadas."
ERR_UNKNOWN = "O candidato não pertence a esta análise."
ERR_LABEL = "O label deve ser a variante recomendada deste candidato."
ERR_REVERSAL = "Alterar uma decisão confirmada ainda não é suportado."
ERR_OVERLAP = "Uma variante já participa de outra união. Uniões sobrepostas não são suportadas nesta etapa."
CHUNK = 65_536
#: Names that share one piece above which the following piece is joined on as well.
CROWDED = 4096


def resolvable_types(columns: list[str], roles: Roles) -> tuple[dict[str, str], list[str]]:
    """({type: text column}, types skipped because a stable id exists)."""
    plain = {"_".join(c.lower().split()) for c in columns}
    open_types, stable = {}, []
    for kind in ENTITY_TYPES:
        if kind in roles:
            if f"{kind}_id" in roles or plain & {f"{kind}_id", f"id_{kind}"}:
                stable.append(kind)
            else:
                open_types[kind] = roles[kind]
    return open_types, stable


def label_context(df: DataFrame, column: str, metric: str | None, order: str | None, row_no: str | None = None) -> DataFrame:
    """(value, key, first_seen, records, orders, metric_value) per distinct label."""
    value = F.col(f"`{column}`")
    amount = not_nan(F.col(f"`{metric}`").try_cast("double")) if metric else F.lit(None).cast("double")
    number = F.col(f"`{order}`") if order else F.lit(None).cast("string")
    seen = F.col(f"`{row_no}`").cast("bigint") if row_no else F.lit(None).cast("bigint")
    fine = df.where(F.trim(value) != "").groupBy(value.alias("value"), number.alias("_o")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(amount).alias("a"), F.min(seen).alias("f"))
    return fine.groupBy("value").agg(
        F.sum("n").alias("records"), F.count("_o").alias("orders"), F.sum("a").alias("metric_value"), F.min("f").alias("first_seen")
    ).withColumn("orders", F.when(F.lit(order is not None), F.col("orders"))).withColumn("key", entity_key(F.col("value")))


def difference_reasons(left: Column, right: Column) -> Column:
    a, b = squeeze(left), squeeze(right)
    found = F.array_compact(F.array(
        F.when((left != a) | (right != b), SPACING),
        F.when((a != b) & (F.lower(a) == F.lower(b)), CASE),
        F.when(F.lower(a) != F.lower(b), ACCENT),
    ))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(SPELLING)))


def _leads(labels: DataFrame) -> DataFrame:
    """First variant of every normalised name."""
    order = F.struct(F.coalesce("first_seen", F.lit(0)), F.col("value"))
    return labels.where(F.col("key") != "").groupBy("key").agg(F.min_by("value", order).alias("lead"), F.count(F.lit(1)).alias("variants"))


def exact_variant_pairs(labels: DataFrame) -> DataFrame:
    """Every further variant of a normalised name against the first one."""
    several = _leads(labels).where(F.col("variants") > 1).select("key", "lead")
    pairs = labels.select("key", "value").join(several, "key").where(F.col("value") != F.col("lead"))
    return pairs.select(
        F.col("lead").alias("left"), F.col("value").alias("right"), F.lit(1.0).alias("similarity"),
        difference_reasons(F.col("lead"), F.col("value")).alias("reasons"))


def ranked_keys(keys: DataFrame) -> DataFrame:
    """(key, rank): dense 0-based rank in global order.

    The sorted keys are written once with their place inside the partition; the
    offsets of the partitions are a list as long as the number of partitions.
    """
    place = F.monotonically_increasing_id()
    stored = cut_lineage(keys.select("key").orderBy("key").select("key", place.alias("_id")))
    part = F.shiftright("_id", 33)
    sized = stored.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sized.select("_p", F.coalesce(
        F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    inside = F.col("_id") - F.shiftleft(part, 33)
    return stored.withColumn("_p", part).join(F.broadcast(offsets), "_p").select("key", (F.col("_off") + inside).alias("rank"))


def _described(keys: DataFrame) -> DataFrame:
    """``keys`` with what two names must have in common: digits, units of measure, company suffix."""
    key = F.col("key")
    tokens = F.split(key, " ")
    marks = F.transform(tokens, lambda t: F.regexp_replace(t, r"^[.,]+|[.,]+$", ""))
    return keys.withColumns({
        "n": F.length(key), "digits": F.regexp_extract_all(key, F.lit(r"(\d+)"), F.lit(1)),
        "units": F.array_sort(F.array_distinct(F.filter(marks, lambda t: t.isin(*UNITS)))), "tail": F.element_at(tokens, -1)})


def neighbour_pairs(ranked: DataFrame, chunk: int = CHUNK, neighbours: int = NEIGHBOURS, prefix: int = PREFIX) -> DataFrame:
    """(left_key, right_key): each key with up to ``neighbours`` followers of the same ``prefix`` letters that pass the guards.

    Both limits are the method (a sorted neighbourhood); :func:`blocking_statistics` tells how many pairs they leave out.
    """
    described = _described(ranked)
    own = F.floor(F.col("rank") / chunk)
    near_start = (F.col("rank") % chunk < neighbours) & (own > 0)
    copies = F.when(near_start, F.array(own, own - 1)).otherwise(F.array(own))
    item = F.struct("key", "n", "digits", "units", "tail")
    spread = described.select("rank", own.alias("own"), item.alias("item"), F.explode(copies).alias("chunk"))
    w = Window.partitionBy("chunk").orderBy("rank").rowsBetween(1, neighbours)
    seen = spread.withColumn("next", F.collect_list("item").over(w)).where(F.col("chunk") == F.col("own"))

    def admissible(r: Column) -> Column:
        l = F.col("item")
        gap = F.abs(l["n"] - r["n"]) <= F.greatest(l["n"], r["n"]) * MAX_LENGTH_GAP
        suffix = ~(l["tail"].isin(*COMPANY_SUFFIXES) | r["tail"].isin(*COMPANY_SUFFIXES)) | (l["tail"] == r["tail"])
        same_block = F.substring(l["key"], 1, prefix) == F.substring(r["key"], 1, prefix)
        return same_block & gap & (l["digits"] == r["digits"]) & (l["units"] == r["units"]) & suffix

    kept = seen.select("item", F.explode(F.filter("next", admissible)).alias("other"))
    return kept.select(F.col("item.key").alias("left_key"), F.col("other.key").alias("right_key"))


def similarity(left: Column, right: Column) -> Column:
    """One minus the edit distance over the longer length."""
    return 1.0 - F.levenshtein(left, right) / F.greatest(F.length(left), F.length(right))


def _variants(text: Column) -> Column:
    """``text`` without each of its letters in turn."""
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(
        text.substr(F.lit(1), i - 1), text.substr(i + 1, F.length(text))))


def shared_pieces(keys: DataFrame, least: float = MIN_SIMILARITY, crowded: int = CROWDED) -> DataFrame:
    """(left_key, right_key, edits): pairs of names that share a piece, the guards' marks and a length within reach, once per shared piece.

    ``edits`` is how many edits their longer length allows. Of the pieces of the shorter name one is unchanged in the
    longer one, moved by no more than the edits around it; and there is one such piece whose follower (the first
    follows the last) has one edit at most, which is what crowded pieces are joined on.
    """
    suffix = F.when(F.col("tail").isin(*COMPANY_SUFFIXES), F.col("tail"))
    named = cut_lineage(_described(keys).select("key", "n", F.xxhash64("digits", "units", suffix).alias("marks")))
    allowed = lambda length: F.floor((1 - least) * length + 1e-9).cast("int")
    pieces, i = F.col("edits") + 1, F.col("i")
    begin = lambda x: F.floor(x * F.col("short") / pieces).cast("int")
    cut = {"begin": begin(i), "size": begin(i + 1) - begin(i)}
    after = (i + 1) % pieces
    follower = {"after_begin": begin(after), "after_size": begin(after + 1) - begin(after)}

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("h", F.xxhash64("marks", "long", "short", "i", F.col("key").substr(F.col("at") + 1, F.col("size"))))

    # each name as the shorter one, for every length of the longer one that can be near
    held = named.select("key", "marks", F.col("n").alias("short"), F.explode(F.sequence(F.col("n"), F.floor(F.col("n") / least + 1e-9).cast("int"))).alias("long"))
    held = held.withColumn("edits", allowed(F.col("long"))).where(F.col("long") - F.col("short") <= F.col("edits"))
    held = keyed(held.select("*", F.explode(F.sequence(F.lit(0), F.col("edits"))).alias("i")).withColumns(cut).withColumn("at", F.col("begin")))
    # each name as the longer one, with every place at which a piece can stand
    asked = named.select("key", "marks", F.col("n").alias("long"), allowed(F.col("n")).alias("edits"))
    asked = asked.select("*", F.explode(F.sequence(F.greatest(F.col("long") - F.col("edits"), F.lit(1)), F.col("long"))).alias("short"))
    asked = asked.select("*", F.explode(F.sequence(F.lit(0), F.col("edits"))).alias("i")).withColumns(cut)
    asked = asked.select("*", F.explode(F.sequence(-F.col("edits"), F.col("edits"))).alias("moved")).where(
        (F.abs("moved") + F.abs(F.col("long") - F.col("short") - F.col("moved")) <= F.col("edits"))
        & (F.col("begin") + F.col("moved") >= 0) & (F.col("begin") + F.col("moved") + F.col("size") <= F.col("long")))
    asked = keyed(asked.withColumn("at", F.col("begin") + F.col("moved")))

    many = cut_lineage(held.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > crowded).select("h"))
    pair = (F.col("x.h") == F.col("y.h")) & ((F.col("x.long") > F.col("x.short")) | (F.col("x.key") > F.col("y.key")))
    shown = [F.least("x.key", "y.key").alias("left_key"), F.greatest("x.key", "y.key").alias("right_key"), F.col("x.edits").alias("edits")]
    narrow = lambda df: df.select("h", "key", "long", "short", "edits")
    if many.isEmpty():
        return narrow(asked).alias("x").join(narrow(held).alias("y"), pair).select(*shown)
    few = narrow(asked).join(many, "h", "left_anti").alias("x").join(narrow(held).join(many, "h", "left_anti").alias("y"), pair)

    text = F.col("key").substr(F.col("after_begin") + 1, F.col("after_size"))
    with_next = lambda df, forms: df.select("h", "key", "long", "short", "edits", F.explode(F.array_distinct(forms)).alias("form")).select(
        F.xxhash64("h", "form").alias("h"), "key", "long", "short", "edits")
    refined_held = with_next(held.join(many, "h", "left_semi").withColumns(follower), F.concat(F.array(text), _variants(text)))
    start = F.when(after == 0, F.lit(0)).otherwise(F.col("at") + F.col("size"))
    read = lambda size: F.col("key").substr(start + 1, size)
    fits = lambda size: (size >= 1) & (start + size <= F.col("long"))
    none = F.array().cast("array<string>")
    n = F.col("after_size")
    forms = F.concat(
        F.when(fits(n), F.concat(F.array(read(n)), _variants(read(n)))).otherwise(none),
        F.when(fits(n + 1), _variants(read(n + 1))).otherwise(none),
        F.when(fits(n - 1), F.array(read(n - 1))).otherwise(F.when(n == 1, F.array(F.lit(""))).otherwise(none)))
    refined_asked = with_next(asked.join(many, "h", "left_semi").withColumns(follower), forms)
    return few.select(*shown).unionAll(refined_asked.alias("x").join(refined_held.alias("y"), pair).select(*shown))


def similar_keys(keys: DataFrame, least: float = MIN_SIMILARITY, crowded: int = CROWDED) -> DataFrame:
    """(left_key, right_key, similarity): all pairs of names that pass the guards and are at least this similar."""
    found = shared_pieces(keys, least, crowded)
    near = F.expr("levenshtein(left_key, right_key, edits)")  # ends early: -1 beyond the edits
    longer = F.greatest(F.length("left_key"), F.length("right_key"))
    gap = F.abs(F.length("left_key") - F.length("right_key")) <= longer * MAX_LENGTH_GAP
    close = found.where(gap).withColumn("d", near).where(F.col("d") >= 0).withColumn("similarity", 1.0 - F.col("d") / longer)
    return close.where(F.col("similarity") >= least).select("left_key", "right_key", "similarity").distinct()


def fuzzy_pairs(labels: DataFrame, least: float = MIN_SIMILARITY, neighbours: int | None = None, prefix: int = PREFIX) -> DataFrame:
    """Different normalised names that read almost alike: all of them, or those of a sorted neighbourhood."""
    leads = cut_lineage(_leads(labels).select("key", "lead"))
    long_keys = leads.where(F.length("key") >= MIN_LENGTH).select("key")
    if neighbours is None:
        close = similar_keys(long_keys, least)
    else:
        compared = neighbour_pairs(ranked_keys(long_keys), neighbours=neighbours, prefix=prefix)
        close = compared.withColumn("similarity", similarity(F.col("left_key"), F.col("right_key"))).where(F.col("similarity") >= least)
    side = lambda s: leads.select(F.col("key").alias(f"{s}_key"), F.col("lead").alias(s))
    return close.join(side("left"), "left_key").join(side("right"), "right_key").select(
        "left", "right", "similarity", F.array(F.lit(SPELLING)).alias("reasons"))


def blocking_statistics(labels: DataFrame) -> DataFrame:
    """One row: labels, theoretical pairs, pairs that a sorted neighbourhood compares and pairs that it leaves out."""
    leads = _leads(labels)
    exact = leads.agg(F.coalesce(F.sum(F.col("variants") - 1), F.lit(0)).alias("n")).scalar()
    fuzzy = neighbour_pairs(ranked_keys(leads.where(F.length("key") >= MIN_LENGTH))).agg(F.count(F.lit(1)).alias("n")).scalar()
    n = F.col("unique_entities")
    return labels.agg(F.count(F.lit(1)).alias("unique_entities")).select(
        n, (F.floor(n * (n - 1) / 2)).alias("theoretical_pairs"), (exact + fuzzy).alias("blocked_pairs"), fuzzy.alias("fuzzy_comparisons"),
        (F.floor(n * (n - 1) / 2) - exact - fuzzy).alias("pairs_left_out"))


def similarity_statistics(labels: DataFrame, least: float = MIN_SIMILARITY, neighbours: int = NEIGHBOURS, prefix: int = PREFIX) -> DataFrame:
    """One row: names, pairs of them, similar pairs, similar pairs that the join finds and those that a sorted neighbourhood would lose."""
    keys = cut_lineage(_leads(labels).where(F.length("key") >= MIN_LENGTH).select("key"))
    close = similar_keys(keys, least).select("left_key", "right_key").withColumn("all", F.lit(1))
    beside = neighbour_pairs(ranked_keys(keys), neighbours=neighbours, prefix=prefix)
    met = close.join(beside.withColumn("beside", F.lit(1)), ["left_key", "right_key"], "left")
    found = met.agg(F.count("all").alias("similar_pairs"), F.count_if(F.col("beside").isNull()).alias("lost_by_neighbourhood"))
    n = F.col("names")
    return keys.agg(F.count(F.lit(1)).alias("names")).join(found, F.lit(True)).select(
        n, F.floor(n * (n - 1) / 2).alias("theoretical_pairs"), "similar_pairs", "lost_by_neighbourhood")


def entity_candidates(df: DataFrame, roles: Roles, analysis: str | None = None, row_no: str | None = None) -> DataFrame:
    """All candidate pairs of all text-identified entity types with both sides' context.

    Distinct labels are paired first; the context is kept for those in a pair.
    """
    open_types, _ = resolvable_types(df.columns, roles)
    metric = next((roles[m] for m in CUSTOMER_METRICS if m in roles), None)
    parts = []
    for i, (kind, column) in enumerate(open_types.items()):
        labels = cut_lineage(label_context(df, column, metric, roles.get("pedido"), row_no))
        pairs = exact_variant_pairs(labels).withColumn("step", F.lit(0)).unionByName(fuzzy_pairs(labels).withColumn("step", F.lit(1)))
        side = lambda s: labels.select(
            F.col("value").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("records", "orders", "metric_value", "first_seen")])
        parts.append(pairs.join(side("left"), "left").join(side("right"), "right").select(
            F.lit(i).alias("type_no"), F.lit(kind).alias("entity_type"), F.lit(column).alias("column"), "step", "left", "right",
            F.round("similarity", 2).alias("similarity"),
            F.when(F.col("similarity") >= HIGH_SIMILARITY, "alta").otherwise("media").alias("confidence"), "reasons",
            *[f"{s}_{c}" for s in ("left", "right") for c in ("records", "orders", "metric_value", "first_seen")],
            (F.col("left_metric_value") + F.col("right_metric_value")).alias("combined_preview")))
    if not parts:
        raise ValueError("no entity type is identified by text only")
    pairs = reduce(lambda a, b: a.unionByName(b), parts)
    low = F.least("left", "right")
    payload = F.concat(
        F.lit("["), json_text(F.lit(analysis).cast("string")), F.lit(", "), json_text(F.col("entity_type")), F.lit(", "), json_text(F.col("column")),
        F.lit(", ["), json_text(low), F.lit(", "), json_text(F.greatest("left", "right")), F.lit("]]"))
    prefer_right = (F.col("right_records") > F.col("left_records")) | (
        (F.col("right_records") == F.col("left_records")) & F.coalesce(F.col("right_first_seen") < F.col("left_first_seen"), F.lit(False)))
    return pairs.withColumn("candidate_id", digest24(payload)).withColumn(
        "recommended_value", F.when(prefer_right, F.col("right")).otherwise(F.col("left"))
    ).withColumn("status", F.lit(PENDING))


def review_order(candidates: DataFrame) -> DataFrame:
    """Candidates in review order; how many a page shows is the caller's choice."""
    return candidates.orderBy("type_no", "step", "left", "right")


def candidate_counts(candidates: DataFrame) -> DataFrame:
    """(entity_type, total, pending, merged, kept_separate)."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return candidates.groupBy("entity_type").agg(F.count(F.lit(1)).alias("total"), n(PENDING), n(MERGED), n(KEPT))


def validate_decisions(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """``decisions`` (candidate_id, decision, canonical_value) with an ``error`` for each that cannot be applied."""
    known = candidates.select("candidate_id", "column", "left", "right", "recommended_value", "status")
    taken = candidates.where(F.col("status") == MERGED).select(
        "column", F.col("candidate_id").alias("other"), F.explode(F.array("left", "right")).alias("value"))
    joined = decisions.join(known, "candidate_id", "left")
    sides = joined.where(F.col("column").isNotNull()).select("candidate_id", "column", "decision", F.explode(F.array("left", "right")).alias("value"))
    # of several unions of one value that are decided together, the first stands
    first = sides.where(F.col("decision") == "merge").groupBy("column", "value").agg(F.min("candidate_id").alias("other"))
    clash = sides.join(taken.unionByName(first), ["column", "value"]).where(F.col("other") != F.col("candidate_id")).select("candidate_id").distinct().withColumn("clash", F.lit(True))
    expected = F.when(F.col("decision") == "merge", MERGED).otherwise(KEPT)
    error = (
        F.when(F.col("decision").isNull() | ~F.col("decision").isin("merge", "keep_separate"), ERR_DECISION)
        .when(F.col("column").isNull(), ERR_UNKNOWN)
        .when(F.col("canonical_value") != F.col("recommended_value"), ERR_LABEL)
        .when(~F.col("status").isin(PENDING) & (F.col("status") != expected), ERR_REVERSAL)
        .when((F.col("status") == PENDING) & (expected == MERGED) & F.coalesce("clash", F.lit(False)), ERR_OVERLAP)
    )
    return joined.join(clash, "candidate_id", "left").select("candidate_id", "decision", "canonical_value", error.alias("error"))


def record_decisions(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates with the status and canonical value of the valid decisions."""
    good = validate_decisions(candidates, decisions).where(F.col("error").isNull()).select("candidate_id", F.col("decision").alias("_d"))
    status = F.when(F.col("_d") == "merge", MERGED).when(F.col("_d") == "keep_separate", KEPT).otherwise(F.col("status"))
    base = candidates.drop("canonical_value") if "canonical_value" in candidates.columns else candidates
    return base.join(good, "candidate_id", "left").withColumn("status", status).drop("_d").withColumn(
        "canonical_value", F.when(F.col("status") == MERGED, F.col("recommended_value")))


def alias_map(candidates: DataFrame) -> DataFrame:
    """(column, value, canonical_value) of the confirmed merges."""
    merged = candidates.where(F.col("status") == MERGED)
    return merged.select("column", F.explode(F.array("left", "right")).alias("value"), "canonical_value").where(
        F.col("value") != F.col("canonical_value")).distinct()


def apply_aliases(df: DataFrame, aliases: DataFrame, columns: list[str]) -> DataFrame:
    """Variants replaced by their canonical value; rows and amounts stay as they are."""
    out = df
    for c in columns:
        names = aliases.where(F.col("column") == c).select(F.col("value").alias("_v"), F.col("canonical_value").alias("_c"))
        out = out.join(names, F.col(f"`{c}`") == F.col("_v"), "left").withColumn(c, F.coalesce("_c", F.col(f"`{c}`"))).drop("_v", "_c")
    return out


def unchanged(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """One row: do two aggregate frames agree (the check after a merge)?"""
    values = [c for c in before.columns if c not in keys]
    left = before.select(*keys, *[F.col(c).cast("double").alias(f"a_{c}") for c in values]).withColumn("in_a", F.lit(True))
    right = after.select(*keys, *[F.col(c).cast("double").alias(f"b_{c}") for c in values]).withColumn("in_b", F.lit(True))
    both = left.join(right, keys, "full")
    close = lambda c: F.coalesce(
        F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= F.greatest(F.abs(F.col(f"a_{c}")) * 1e-9, F.lit(1e-6)),
        F.col(f"a_{c}").isNull() & F.col(f"b_{c}").isNull())
    fine = reduce(lambda a, b: a & b, [close(c) for c in values], F.col("in_a").isNotNull() & F.col("in_b").isNotNull())
    return both.agg(F.coalesce(F.bool_and(fine), F.lit(True)).alias("unchanged"), F.count(F.lit(1)).alias("compared"))
