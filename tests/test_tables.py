"""Cleaning, quality, rankings, mapping and entities on small tables."""

import random

from pyspark.sql import functions as F

from ledgerlens.functions.ordered import last_known, next_known, running_sums
from ledgerlens.operators import clean, entities, metrics, quality, rankings, roles


def test_guarded_number_conversion(spark):
    good = spark.createDataFrame([(str(i),) for i in range(99)] + [("texto",)], "amount string")
    state = clean.convert_numbers(clean.Cleaned(good), ["amount"])
    assert state.frame.where("amount is null").count() == 1 and state.log[0][1] == "conversao_numerica_parcial"
    mixed = spark.createDataFrame([("1",), ("2",), ("texto",), ("outro",)], "amount string")
    state = clean.convert_numbers(clean.Cleaned(mixed), ["amount"])
    assert dict(state.frame.dtypes)["amount"] == "string" and state.log[0][1] == "conversao_numerica_cancelada"


def test_coherence_with_nulls(spark):
    df = spark.createDataFrame([(100.0, 90.0, 20.0), (100.0, None, 10.0), (200.0, 150.0, None)], "f double, c double, l double")
    a = quality.coherence_audit(df, {"faturamento": "f", "custo": "c", "lucro": "l"}).first()
    assert (a["complete_rows"], a["reconciled_percent"], a["median_abs_error"], a["status"]) == (1, 0.0, 10.0, "inconsistente")
    k = metrics.kpis(df, {"faturamento": "f", "custo": "c", "lucro": "l"}).first()
    assert (k["faturamento_total"], k["custo_total"], k["lucro_total"]) == (400.0, 240.0, 30.0)


def test_order_words_are_no_orders(spark):
    df = spark.createDataFrame([("A1", 10.0), (" A1 ", 5.0), ("TOTAL", 1.0), ("", 1.0), ("B", 3.0)], "p string, v double")
    k = metrics.kpis(df, {"pedido": "p", "faturamento": "v"}).first()
    assert k["quantidade_pedidos"] == 2.0 and k["ticket_medio"] == 10.0


def test_customers_by_id(spark):
    df = spark.createDataFrame([(123, "A", 300.0, -100.0), (123, "A", 100.0, 200.0), (456, "B", 200.0, 200.0), (789, "C", 100.0, -20.0)],
                               "id long, n string, f double, l double")
    t = rankings.entity_totals(df, "id", "n", {"faturamento": "f", "lucro": "l"})
    ranked = rankings.customer_ranking(t, ["faturamento", "lucro"], True)
    order = lambda c: [r["customer_id"] for r in ranked.where(f"concept = '{c}'").orderBy("position").collect()]
    assert order("faturamento") == ["123", "456", "789"] and order("lucro") == ["456", "123", "789"]
    share = rankings.concentration(rankings.evidence_stats(t, ["faturamento"]), "faturamento").first()
    assert round(share["participacao_maior_cliente"], 2) == 57.14 and share["concentracao_top_5"] == 100.0


def test_roles_of_named_columns(spark):
    df = spark.createDataFrame([(1, "x", 2.0, 3.0)], "Pedido_ID long, Cliente string, Faturamento double, Quantidade double")
    assert roles.detect_roles(df) == {"pedido": "Pedido_ID", "cliente": "Cliente", "faturamento": "Faturamento", "quantidade": "Quantidade"}


def test_chunked_scans_equal_plain_ones(spark):
    rng = random.Random(7)
    rows = [("a", i, rng.choice([None, rng.randint(0, 9)])) for i in range(1, 400)]
    df = spark.createDataFrame(rows, "k string, o long, v int")
    got = running_sums(df, ["k"], "o", {"s": F.coalesce("v", F.lit(0))}, rows=16)
    got = last_known(got, ["k"], "o", {"l": F.col("v"), }, rows=16)
    got = last_known(got, ["k"], "o", {"b": F.col("v")}, rows=16, before=True)
    got = next_known(got, ["k"], "o", {"n": F.col("v")}, rows=16)
    total, last = 0, None
    after = [next((r[2] for r in rows[i + 1:] if r[2] is not None), None) for i in range(len(rows))]
    for r, (_, _, v), nxt in zip(got.orderBy("o").collect(), rows, after):
        assert r["b"] == last
        total, last = total + (v or 0), v if v is not None else last
        assert (r["s"], r["l"], r["n"]) == (total, last, nxt)


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def _brute(texts, least=0.9):
    """All pairs that are alike, whatever they begin with; no digits, units or company suffixes in them."""
    out = set()
    texts = sorted(texts)
    for i, a in enumerate(texts):
        for b in texts[i + 1:]:
            longer = max(len(a), len(b))
            if abs(len(a) - len(b)) <= longer * 0.12 and 1 - _edits(a, b) / longer >= least:
                out.add((a, b))
    return out


def test_shared_pieces_lose_no_pair(spark):
    rng = random.Random(5)
    names = set()
    for _ in range(16):
        base = "".join(rng.choices("abcd ", k=rng.randint(10, 30)))
        for _ in range(12):
            name = list(base)
            for _ in range(rng.randint(0, 4)):
                i = rng.randrange(len(name))
                name[i:i + rng.randint(0, 1)] = rng.choices("abx ", k=rng.randint(0, 1))
            names.add("".join(name).strip())
    names = {n for n in names if len(n) >= 10}
    df = spark.createDataFrame([(n,) for n in names], "key string")
    for least, crowded in ((0.9, 4096), (0.9, 1), (0.85, 8)):
        got = [(r["left_key"], r["right_key"]) for r in entities.similar_keys(df, least, crowded).collect()]
        assert set(got) == _brute(names, least) and len(got) == len(set(got)) and len(got) > 50
    assert entities.similar_keys(df.limit(0)).count() == 0


def test_fuzzy_pairs_against_brute_force(spark):
    rng = random.Random(3)
    words = ["distribuidora", "comercio", "oliveira", "silveira", "santos", "pereira", "almeida"]
    names = {" ".join(rng.sample(words, 2)) for _ in range(40)}
    names |= {n.replace("ei", "ie", 1) for n in list(names)[:20]} | {n.replace("r", "rr", 1) for n in list(names)[:15]}
    df = spark.createDataFrame([(n, n, i, 1) for i, n in enumerate(sorted(names))], "value string, key string, first_seen long, records long")
    got = {tuple(sorted((r["left"], r["right"]))) for r in entities.fuzzy_pairs(df).collect()}
    assert got == _brute(names)
    ranked = entities.ranked_keys(df.select("key"))
    small = {tuple(r) for r in entities.neighbour_pairs(ranked, chunk=25).collect()}
    large = {tuple(r) for r in entities.neighbour_pairs(ranked).collect()}
    assert small == large
    near = {tuple(sorted((r["left"], r["right"]))) for r in entities.fuzzy_pairs(df, neighbours=20).collect()}
    assert near <= got


def test_names_that_must_not_match(spark):
    names = ["ALFA", "BETA", "JOAO SILVA", "JOSE SILVA", "PRODUTO LONGO 100", "PRODUTO LONGO 101", "MERCADO CENTRAL LTDA", "MERCADO CENTRAL SA"]
    df = spark.createDataFrame([(n,) for n in names], "Cliente string")
    labels = entities.label_context(df, "Cliente", None, None)
    assert entities.exact_variant_pairs(labels).count() == 0 and entities.fuzzy_pairs(labels).count() == 0


def test_letters_that_change_places_match(spark):
    df = spark.createDataFrame([("Distribuidora Oliveira",), ("Distribuidora Oliviera",)], "Cliente string")
    assert entities.fuzzy_pairs(entities.label_context(df, "Cliente", None, None)).count() == 1


def test_unions_that_share_a_name(spark):
    rows = [("Armazem Central", 3), ("Armazém Central", 2), ("ARMAZEM CENTRAL", 1)]
    df = spark.createDataFrame([(n,) for n, k in rows for _ in range(k)], "Cliente string")
    c = entities.entity_candidates(df, {"cliente": "Cliente"}).cache()
    asked = c.selectExpr("candidate_id", "'merge' AS decision", "CAST(NULL AS STRING) AS canonical_value")
    errors = [r["error"] for r in entities.validate_decisions(c, asked).collect()]
    assert len(errors) == 2 and errors.count(None) == 1


def test_name_variants(spark):
    df = spark.createDataFrame([("José Silva", 100.0, 1), ("JOSÉ  SILVA", 50.0, 2), ("José Silva", 10.0, 3)], "Cliente string, Valor_Total double, n long")
    c = entities.entity_candidates(df, {"cliente": "Cliente", "valor_total": "Valor_Total"}, row_no="n").collect()
    assert len(c) == 1 and c[0]["left"] == "José Silva" and c[0]["combined_preview"] == 160.0
    assert set(c[0]["reasons"]) == {"diferenca_espacamento", "diferenca_caixa"}


def test_header_concepts_by_group(spark):
    """Net value is read beside its group's own labels; however many groups there are, no label is sent to every task."""
    rows = [("Valor Líquido", 1), ("Valor Total", 1), ("Desconto", 1), ("Valor Líquido", 2), ("Valor Total", 2), ("Cliente", 2), ("Cliente", None)]
    df = spark.createDataFrame(rows, "label string, g int")
    got = roles.concept_of_label(df, "label", "g")
    assert got.columns == ["label", "g", "concept"]
    assert {(r["label"], r["g"]): r["concept"] for r in got.collect()} == {
        ("Valor Líquido", 1): "valor_com_desconto", ("Valor Total", 1): "valor_total", ("Desconto", 1): None,
        ("Valor Líquido", 2): None, ("Valor Total", 2): "valor_total", ("Cliente", 2): "cliente"}
    one = roles.concept_of_label(df.drop("g")).where("label = 'Valor Líquido'").select("concept").distinct()
    assert [r["concept"] for r in one.collect()] == ["valor_com_desconto"]
    many = spark.range(1000).select("id", F.explode(F.array(*[F.lit(x) for x, _ in rows])).alias("label"))
    plan = roles.concept_of_label(many, "label", "id")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") == 1  # the words that are known beforehand


def test_formula_margin_joins_column_concepts_whole(spark):
    """The few concepts go to the formulas; no formula meets all of them in one task."""
    rows = spark.range(1000).select(F.lit("s").alias("sheet"), F.col("id").alias("row_no"), (F.col("id") * 1.0).alias("m"), F.lit(2.0).alias("v"))
    formulas = rows.select("sheet", "row_no", F.lit(4).alias("col_no"), F.lit("=B7/$C$7").alias("formula"))
    concepts = spark.createDataFrame([(2, "margem_bruta"), (3, "valor_total"), (4, "margem_bruta_percentual")], "position int, concept string")
    got = metrics.formula_margin(rows, formulas, concepts, {"margem_bruta": "m", "valor_total": "v"})
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" not in plan and plan.count("BroadcastHashJoin") + plan.count("BroadcastNestedLoopJoin") >= 3
    row = got.first()
    assert (row["margem_bruta_percentual"], row["linhas_base"]) == (24975.0, 1000)
