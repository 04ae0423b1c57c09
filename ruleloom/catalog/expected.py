"""The SQL that each registered query is checked against."""

from __future__ import annotations

from ruleloom.catalog import datasets as D
from ruleloom.catalog.oracle import (
    AUC_COLUMNS,
    auc,
    cut,
    drawn,
    examples,
    fuzzified,
    labels_of,
    match,
    matrix,
    model,
    peak,
    scored,
    sql,
    supports,
)
from ruleloom.catalog.queries import FOLDS, GA_CHUNKS, GA_POP, GA_SEARCH, GA_SEED, GA_TINY
from ruleloom.catalog.search import HISTORY, LAST, PRUNED, pruned_rules, recursive, search

RULES = "SELECT rule_key, cls AS class_idx, round(weight, 6) AS weight FROM rules"
PREDICTIONS = "SELECT row_id, actual, predicted, round(degree, 6) AS degree FROM pred"
MATRIX = "SELECT actual, predicted, n FROM cm"
CLASS_LABEL = {ds.name: "CASE cls " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(ds.classes)) + " END" for ds in (D.EVENTS, D.ORDERS, D.DOCUMENTS)}


def rules_of(ds, **kw):
    return sql(model(ds, **kw), RULES)


def predictions_of(ds, inference="winning_rule", **kw):
    return sql(model(ds, **kw) + scored(ds, inference), PREDICTIONS)


def matrix_of(ds, inference="winning_rule", **kw):
    return model(ds, **kw) + scored_rows(ds, inference) + matrix(ds)


def scored_rows(ds, inference="winning_rule"):
    """Predictions of tables without a row id need a number of their own."""
    if ds.row_id is not None:
        return scored(ds, inference)
    return [("fzn", "SELECT *, row_number() OVER () AS rid0 FROM fz")] + scored(ds, inference, fz="fzn", rid="rid0")


def class_profile_sql(ds):
    return sql(
        [
            ("ex", f"SELECT * FROM ({ds.sql}) WHERE cls >= 0"),
            ("c", f"SELECT {CLASS_LABEL[ds.name]} AS label, count(*) AS n FROM ex GROUP BY 1"),
        ],
        """SELECT CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS class_idx, label,
           CAST(n AS BIGINT) AS n, round((SELECT min(n) FROM c) / n::DOUBLE, 6) AS cost,
           round((SELECT max(n) FROM c) / n::DOUBLE, 6) AS imbalance_ratio FROM c""",
    )


def ranges_sql(ds):
    parts = " UNION ALL ".join(
        f"SELECT {j} AS var_idx, '{ds.features[i]}' AS name, min(x{i}) AS lower, max(x{i}) AS upper FROM ex"
        for j, i in enumerate(ds.numeric)
    )
    return [("ex", f"SELECT * FROM ({ds.sql}) WHERE cls >= 0"), ("r", parts)]


def fuzzy_sets_sql(ds, n_labels):
    last = n_labels - 1
    g = "(SELECT var_idx, name, lower AS lo0, upper AS hi0 FROM r)"
    rows = []
    for k in range(n_labels):
        left = peak(0, k if k == 0 else k - 1, n_labels)
        right = peak(0, k if k == last else k + 1, n_labels)
        up = f"round({cut(0, k, n_labels)}, 6)" if k < last else "NULL"
        rows.append(
            f"SELECT var_idx, name, {k} AS label, round({left}, 6) AS left_pt, round({peak(0, k, n_labels)}, 6) AS mid_pt,"
            f" round({right}, 6) AS right_pt, {up} AS upper_cut FROM {g} g"
        )
    return sql(ranges_sql(ds), " UNION ALL ".join(rows))


def fuzzify_sql(ds, n_labels):
    return sql(examples(ds) + fuzzified(ds, n_labels), "SELECT row_id, chunk_id, cls AS class_idx, rule_key FROM fz")


def membership_sql():
    parts = " UNION ALL ".join(
        f"SELECT row_id, {i} AS var_idx, {k} AS label, round(mu{i}[{k + 1}], 6) AS mu FROM fz"
        for i in range(3)
        for k in range(3)
    )
    return sql(examples(D.EVENTS) + fuzzified(D.EVENTS), parts)


def support_sql(ds, **kw):
    return sql(
        examples(ds) + fuzzified(ds) + supports(ds, **kw),
        "SELECT rule_key, cls AS class_idx, round(support, 5) AS support FROM sup",
    )


def unseen_sql(default, inference="winning_rule"):
    """All documents, with the ranges and values of the labelled ones."""
    ds = D.DOCUMENTS
    everything = "SELECT doc_id AS row_id, CAST(n_chars AS DOUBLE) AS x0, lang AS x1, source AS x2, -1 AS cls FROM documents"
    ctes = model(ds) + [("every", everything)] + fuzzified(ds, source="every", name="fza")
    d = "(SELECT arg_max(cls, n * 10 - cls) FROM cls)" if default == "most_frequent" else "0"
    ctes += scored(ds, inference, default=d, fz="fza")
    return sql(ctes, "SELECT row_id, predicted, round(degree, 6) AS degree FROM pred")


# Cross-validation: every row once per model that does not leave its fold out.


def fold_models(chunks=1, weight="cf", by_digest=False):
    ds = D.EVENTS
    chunk = drawn(GA_SEED, "chunk", chunks) if by_digest else None
    fold = drawn(GA_SEED, "fold", FOLDS) if by_digest else f"row_id % {FOLDS}"
    ctes = examples(ds) + fuzzified(ds, chunks=chunks, chunk=chunk)
    ctes += [
        ("fzf", f"SELECT e.*, CAST({fold} AS INTEGER) AS fold FROM fz e"),
        (
            "fzm",
            f"SELECT f.* REPLACE (CAST(m.i * 100 + f.chunk_id AS INTEGER) AS chunk_id) FROM fzf f"
            f" JOIN range({FOLDS}) m(i) ON m.i <> f.fold",
        ),
    ]
    ctes += supports(ds, fz="fzm")
    from ruleloom.catalog.oracle import chunk_rules

    ctes += chunk_rules(ds, weight)
    labels = ", ".join(f"CAST(split_part(rule_key, '|', {i + 1}) AS INTEGER) AS a{i}" for i in range(3))
    ctes += [
        (
            "fmean",
            "SELECT chunk_id // 100 AS model, rule_key, cls, round(avg(weight), 12) AS weight FROM crules"
            " GROUP BY chunk_id // 100, rule_key, cls",
        ),
        (
            "frank",
            "SELECT *, row_number() OVER (PARTITION BY model, rule_key ORDER BY weight DESC, cls) AS rn FROM fmean",
        ),
        ("frules", f"SELECT CAST(model AS INTEGER) AS model, rule_key, cls, weight, {labels} FROM frank WHERE rn = 1"),
    ]
    return ctes


def fold_predictions(which, **kw):
    ds = D.EVENTS
    if which == "test":
        ctes = fold_models(**kw)
        return ctes + scored(ds, fz="fzf", rules="frules", on="r.model = f.fold", carry="fold")
    ctes = fold_models(**kw)
    ctes.append(("fzt", f"SELECT f.* REPLACE (CAST(m.i AS INTEGER) AS fold) FROM fzf f JOIN range({FOLDS}) m(i) ON m.i <> f.fold"))
    return ctes + scored(ds, fz="fzt", rules="frules", on="r.model = f.fold", carry="fold")


def fold_metrics(which, **kw):
    return fold_predictions(which, **kw) + matrix(D.EVENTS, by="fold") + auc(by="fold")


def validated(part):
    return sql(fold_metrics(part), f"SELECT fold, '{part}' AS part, {AUC_COLUMNS} FROM rates")


# Rule selection: two chunks, a population of ten.


def draw(*parts):
    return f"md5(concat_ws('|', {', '.join(str(p) for p in parts)}))"


def population(generation=0, source="crules", name="pop"):
    bit = draw(GA_SEED, generation, "r.chunk_id", "c.i", "r.rule_key")
    return [
        (
            name,
            f"SELECT r.chunk_id, CAST(c.i AS INTEGER) AS chrom_id, r.rule_key,"
            f" CASE WHEN c.i = 0 THEN 1 WHEN {bit} < '8' THEN 1 ELSE 0 END AS active"
            f" FROM {source} r CROSS JOIN range({GA_POP}) c(i)",
        )
    ]


def ga_base():
    return model(D.EVENTS, chunks=GA_CHUNKS) + population()


def ga_pairing():
    order = draw(GA_SEED, 1, "'pair'", "chunk_id", "chrom_id")
    return [
        (
            "ord",
            f"SELECT chunk_id, chrom_id, row_number() OVER (PARTITION BY chunk_id ORDER BY {order}, chrom_id) - 1 AS ix"
            f" FROM (SELECT DISTINCT chunk_id, chrom_id FROM pop)",
        ),
        ("pairs", "SELECT chunk_id, chrom_id, CAST(ix // 2 AS INTEGER) AS pair, CAST(ix % 2 AS INTEGER) AS side FROM ord"),
    ]


def ga_children():
    digest = draw(GA_SEED, 1, "'hux'", "chunk_id", "pair", "rule_key")
    return ga_pairing() + [
        (
            "sides",
            "SELECT p.chunk_id, q.pair, p.rule_key, max(CASE WHEN side = 0 THEN active END) AS mom,"
            " max(CASE WHEN side = 1 THEN active END) AS dad FROM pop p JOIN pairs q USING (chunk_id, chrom_id)"
            " GROUP BY p.chunk_id, q.pair, p.rule_key",
        ),
        (
            "diffs",
            f"SELECT *, row_number() OVER (PARTITION BY chunk_id, pair ORDER BY {digest}, rule_key) AS place,"
            f" count(*) OVER (PARTITION BY chunk_id, pair) AS size FROM sides WHERE mom <> dad",
        ),
        (
            "swaps",
            "SELECT s.*, coalesce(d.place <= greatest(1, d.size // 2), FALSE) AS swap FROM sides s"
            " LEFT JOIN diffs d USING (chunk_id, pair, rule_key)",
        ),
        (
            "kids",
            f"SELECT chunk_id, CAST({GA_POP} + 2 * pair AS INTEGER) AS chrom_id, rule_key,"
            f" CASE WHEN swap THEN dad ELSE mom END AS active FROM swaps UNION ALL"
            f" SELECT chunk_id, CAST({GA_POP + 1} + 2 * pair AS INTEGER), rule_key,"
            f" CASE WHEN swap THEN mom ELSE dad END FROM swaps",
        ),
    ]


def ga_fitness(source="pop"):
    ds = D.EVENTS
    return [
        (
            "lr",
            f"SELECT r.*, {', '.join(f'k.a{i}' for i in range(3))} FROM crules r JOIN cand k USING (chunk_id, rule_key)",
        ),
        (
            "hits",
            f"SELECT f.chunk_id, f.row_id, f.cls AS actual, r.rule_key, r.cls AS rc, {match(ds)} * r.weight AS assoc"
            f" FROM fz f JOIN lr r ON f.chunk_id = r.chunk_id",
        ),
        (
            "used",
            f"SELECT h.*, p.chrom_id, row_number() OVER (PARTITION BY h.chunk_id, h.row_id, p.chrom_id"
            f" ORDER BY assoc DESC, rc) AS rn FROM hits h JOIN {source} p"
            f" ON p.chunk_id = h.chunk_id AND p.rule_key = h.rule_key AND p.active = 1 WHERE h.assoc > 0",
        ),
        ("chroms", f"SELECT chunk_id, chrom_id, sum(active) AS n_selected, count(*) AS n_rules FROM {source} GROUP BY ALL"),
        (
            "said",
            "SELECT c.chunk_id, c.chrom_id, f.cls AS actual, coalesce(u.rc, 0) AS predicted FROM chroms c"
            " JOIN fz f ON f.chunk_id = c.chunk_id LEFT JOIN used u ON u.chunk_id = c.chunk_id"
            " AND u.chrom_id = c.chrom_id AND u.row_id = f.row_id AND u.rn = 1",
        ),
        (
            "tally",
            "SELECT chunk_id, chrom_id, count(*) FILTER (actual = 0 AND predicted = 0) AS tp,"
            " count(*) FILTER (actual = 0 AND predicted <> 0) AS fn, count(*) FILTER (actual <> 0 AND predicted = 0) AS fp,"
            " count(*) FILTER (actual <> 0 AND predicted <> 0) AS tn,"
            " avg(CAST(actual = predicted AS INTEGER)) AS accuracy FROM said GROUP BY chunk_id, chrom_id",
        ),
        (
            "fita",
            "SELECT *, (1.0::DOUBLE + coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) - coalesce(fp / nullif(fp + tn, 0)::DOUBLE, 0)) / 2 AS auc0"
            " FROM tally JOIN chroms USING (chunk_id, chrom_id)",
        ),
        (
            "fit",
            "SELECT *, round(auc0, 12) AS auc, round(auc0 * 0.7::DOUBLE + (n_rules - n_selected) / n_rules::DOUBLE * (1.0::DOUBLE - 0.7::DOUBLE), 12) AS fitness"
            " FROM fita",
        ),
        (
            "top",
            "SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY fitness DESC, chrom_id) AS place FROM fit",
        ),
    ]


BEST = "SELECT chunk_id, chrom_id FROM top WHERE place = 1"
KEPT = (
    "kept",
    f"SELECT r.* FROM crules r JOIN (SELECT p.chunk_id, p.rule_key FROM pop p JOIN ({BEST}) b USING (chunk_id, chrom_id)"
    f" WHERE p.active = 1) k USING (chunk_id, rule_key)",
)


def searched_rules(evaluations):
    return recursive(search(D.EVENTS, GA_POP, GA_SEED, evaluations, GA_CHUNKS) + pruned_rules(GA_CHUNKS), PRUNED)


def rule_text_sql():
    ds = D.DOCUMENTS
    terms = []
    for i, kind in enumerate(ds.kinds):
        value = f"'L_' || a{i}" if kind == "numeric" else f"g.v{i}[a{i} + 1]"
        terms.append(f"'{ds.features[i]} IS ' || {value}")
    body = " || ' AND ' || ".join(terms)
    text = f"'IF ' || {body} || ' THEN CLASS = ' || CASE cls WHEN 0 THEN '1' ELSE '0' END || ' WITH RW = ' || printf('%.6f', round(weight, 6))"
    number = f"CAST(row_number() OVER (ORDER BY {labels_of(ds)}) - 1 AS BIGINT)"
    return sql(model(ds), f"SELECT {number} AS rule_no, {text} AS rule FROM rules CROSS JOIN rng g")


def four(x: str) -> str:
    return f"printf('%.4f', round({x}, 4))"


def rule_lines_sql() -> str:
    """``at``, ``line``, ``numbers`` of the rules of the events."""
    ds = D.EVENTS
    body = " || ' AND ' || ".join(f"'{n} IS L_' || a{i}" for i, n in enumerate(ds.features))
    number = f"CAST(row_number() OVER (ORDER BY {labels_of(ds)}) - 1 AS BIGINT)"
    return f"""SELECT {number} AS at, 'Rule (' || {number} || '): IF ' || {body} || ' THEN CLASS = '
        || CASE cls WHEN 0 THEN 'error' ELSE 'other' END || ' WITH RW = #' AS line, {four("weight")} AS numbers FROM rules"""


def rule_base_text_sql():
    head = "SELECT CAST(-1 AS BIGINT) AS at, 'RULE BASE: (' || count(*) || ')' AS line, '' AS numbers FROM rules"
    return sql(model(D.EVENTS), f"{head} UNION ALL {rule_lines_sql()}")


def triangle_lines_sql(ds, at: bool) -> str:
    """Name and triangles of the numeric variables."""
    out = []
    for i in ds.numeric:
        first = f"CAST({i} AS BIGINT) AS at, " if at else ""
        out.append(f"SELECT {first}'{ds.features[i]}:' AS line, '' AS numbers")
        for k in range(3):
            points = [peak(i, max(k - 1, 0), 3), peak(i, k, 3), peak(i, min(k + 1, 2), 3)]
            out.append(f"SELECT {first}'L_{k}: (#,#,#)' AS line, {' || chr(32) || '.join(map(four, points))} AS numbers FROM rng g")
    return " UNION ALL ".join(out)


def knowledge_text_sql():
    head = "SELECT 'DATABASE' AS line, '' AS numbers"
    lines = triangle_lines_sql(D.EVENTS, False)
    return sql(model(D.EVENTS), f"{head} UNION ALL {lines} UNION ALL SELECT line, numbers FROM ({rule_lines_sql()})")


def confusion_text_sql():
    tab = "chr(9)"
    return sql(
        matrix_of(D.EVENTS),
        f"""SELECT CAST(-1 AS BIGINT) AS at, {tab} || 'Prediction error' || {tab} || 'Prediction other' AS value
        UNION ALL SELECT CAST(actual AS BIGINT), 'Class ' || CASE actual WHEN 0 THEN 'error' ELSE 'other' END || {tab}
        || string_agg(CAST(n AS VARCHAR), {tab} ORDER BY predicted) FROM cm GROUP BY actual""",
    )


MEANS = """SELECT CAST(k.i AS INTEGER) AS class_idx, 4 AS n_chunks, coalesce(c.n, 0) / 4.0::DOUBLE AS mean_rules
FROM range(2) k(i) LEFT JOIN (SELECT cls, count(*) AS n FROM crules GROUP BY cls) c ON c.cls = k.i"""


def variables_text_sql():
    return sql(
        examples(D.DOCUMENTS) + [("c", "SELECT cls, count(*)::DOUBLE AS n FROM ex GROUP BY cls")],
        f"""{triangle_lines_sql(D.DOCUMENTS, True)}
        UNION ALL SELECT 1, 'lang (nominal variable):', '' UNION ALL SELECT 1, 'Nominal values: ' || array_to_string(v1, ', '), '' FROM rng
        UNION ALL SELECT 2, 'source (nominal variable):', '' UNION ALL SELECT 2, 'Nominal values: ' || array_to_string(v2, ', '), '' FROM rng
        UNION ALL SELECT 3, 'Class:', '' UNION ALL SELECT 3, '1, 0', '' UNION ALL SELECT 3, 'IR:', ''
        UNION ALL SELECT 3, '#, #', string_agg({four("(SELECT max(n) FROM c) / n")}, ' ' ORDER BY cls) FROM c""",
    )


def folds_text_sql():
    m = "SELECT (1.0 + tp / nullif(tp + fn, 0)::DOUBLE - fp / nullif(fp + tn, 0)::DOUBLE) / 2.0 AS auc FROM rates"
    return sql(
        fold_metrics("test") + [("m", m)],
        f"""SELECT CAST(0 AS BIGINT) AS at, 'Number of iterations = {FOLDS}' AS line, '' AS numbers
        UNION ALL SELECT 0, 'Average AUC = #', {four("avg(auc)")} FROM m""",
    )


def wide_sql(inference="winning_rule"):
    log = "round(log10(CASE WHEN degree > 0 THEN degree END), 6)"
    return sql(model(D.EMBEDDINGS_64) + scored(D.EMBEDDINGS_64, inference), f"SELECT actual, predicted, {log} AS log_degree FROM pred")


def bad_rows_sql():
    """Ranges and class sizes of all events, rules of those with readable numbers."""
    m = model(D.EVENTS)
    kept = fuzzified(D.EVENTS, source="(SELECT * FROM ex WHERE x1 NOT IN (3, 4, 5))")
    return sql(m[:2] + kept + m[3:], RULES)


def unknown_values_sql():
    ds = D.DOCUMENTS
    all_rows = f"(SELECT * REPLACE (CASE WHEN x2 = 'src1' THEN -1 ELSE cls END AS cls) FROM ({ds.sql}))"
    m = examples(ds, "cls >= 0 AND x1 <> 'fr'")
    ctes = m + fuzzified(ds) + supports(ds) + chunk_rules_of(ds)
    ctes += fuzzified(ds, source=f"(SELECT * FROM {all_rows} WHERE cls >= 0)", name="fza")
    return sql(ctes + scored(ds, fz="fza"), PREDICTIONS)


def chunk_rules_of(ds):
    from ruleloom.catalog.oracle import chunk_rules, merged_rules

    return chunk_rules(ds) + merged_rules(ds)


HEADER_SCHEMA = """WITH d AS (SELECT d.n_chars, d.lang, d.source, l.toxic FROM documents d JOIN labels l USING (doc_id))
SELECT 'n_chars' AS name, 'numeric' AS kind, min(n_chars)::DOUBLE AS lower, max(n_chars)::DOUBLE AS upper, '' AS entries FROM d
UNION ALL SELECT 'lang', 'nominal', NULL, NULL, string_agg(DISTINCT lang, '|' ORDER BY lang) FROM d
UNION ALL SELECT 'source', 'nominal', NULL, NULL, string_agg(DISTINCT source, '|' ORDER BY source) FROM d
UNION ALL SELECT 'y', 'class', NULL, NULL, string_agg(toxic || ' ' || n, '|' ORDER BY toxic)
FROM (SELECT toxic, count(*) AS n FROM d WHERE toxic IS NOT NULL GROUP BY toxic)"""


TEXT_ROWS = D.EVENTS.sql + " WHERE event_type <> 'click'"


def text_rules_sql():
    ds = D.EVENTS
    kept = fuzzified(ds, source=f"({TEXT_ROWS})")
    return sql(model(ds)[:2] + kept + model(ds)[3:], RULES)


HEADER = """WITH d AS (SELECT d.n_chars, d.lang, d.source, CAST(l.toxic AS VARCHAR) AS y FROM documents d JOIN labels l USING (doc_id)),
v AS (SELECT 'lang' AS name, lang AS v FROM d UNION SELECT 'source', source FROM d UNION SELECT 'y', y FROM d)
SELECT 'attribute' AS item, 'n_chars' AS name, 'integer' AS kind, min(n_chars) || '|' || max(n_chars) AS items FROM d
UNION ALL SELECT 'attribute', name, 'nominal', string_agg(v, '|' ORDER BY v) FROM v WHERE v IS NOT NULL GROUP BY name
UNION ALL SELECT 'counts', '', '', string_agg(CAST(n AS VARCHAR), '|' ORDER BY y)
FROM (SELECT y, count(*) AS n FROM d WHERE y IS NOT NULL GROUP BY y)"""


EXPECTED = {
    "class_profile": class_profile_sql(D.EVENTS),
    "class_profile_multiclass": class_profile_sql(D.ORDERS),
    "most_frequent_class": sql(
        [("ex", D.ORDERS.sql), ("c", "SELECT cls, count(*) AS n FROM ex WHERE cls >= 0 GROUP BY cls")],
        "SELECT CAST(cls AS INTEGER) AS most_frequent_class FROM c ORDER BY n DESC, cls LIMIT 1",
    ),
    "feature_profile": sql(ranges_sql(D.EVENTS), "SELECT var_idx, name, lower, upper FROM r"),
    "nominal_values": """SELECT 'lang' AS name, lang AS value FROM documents JOIN labels USING (doc_id) WHERE lang IS NOT NULL
        UNION SELECT 'source', source FROM documents JOIN labels USING (doc_id) WHERE source IS NOT NULL""",
    "fuzzy_sets": fuzzy_sets_sql(D.EVENTS, 3),
    "fuzzy_sets_seven": fuzzy_sets_sql(D.LINEITEM, 7),
    "fuzzify_labels": fuzzify_sql(D.EVENTS, 3),
    "fuzzify_nominal": fuzzify_sql(D.ORDERS, 5),
    "membership": membership_sql(),
    "class_index": sql(
        [("ex", D.ORDERS.sql)],
        f"SELECT CAST(cls AS INTEGER) AS class_idx, {CLASS_LABEL['orders']} AS label, count(*) AS n FROM ex GROUP BY 1, 2",
    ),
    "candidate_rules": sql(
        examples(D.EVENTS) + fuzzified(D.EVENTS),
        "SELECT rule_key, cls AS class_idx, min(row_id) AS first_row FROM fz GROUP BY 1, 2",
    ),
    "candidate_rules_documents": sql(
        examples(D.DOCUMENTS) + fuzzified(D.DOCUMENTS, 5),
        "SELECT rule_key, cls AS class_idx, min(row_id) AS first_row FROM fz GROUP BY 1, 2",
    ),
    "candidate_rules_lineitem": sql(
        examples(D.LINEITEM) + fuzzified(D.LINEITEM),
        "SELECT rule_key, cls AS class_idx, count(*) AS n FROM fz GROUP BY 1, 2",
    ),
    "rule_support": support_sql(D.EVENTS),
    "rule_support_all_but_last": support_sql(D.EVENTS, all_but_last=True),
    "rule_support_nominal": support_sql(D.DOCUMENTS),
    "rule_support_nominal_last_skipped": support_sql(D.DOCUMENTS, all_but_last=True),
    "class_weights": sql(
        model(D.EVENTS, weight="pcf"), "SELECT rule_key, cls AS class_idx, round(weight, 6) AS weight FROM wts"
    ),
    "rules_cf": rules_of(D.EVENTS),
    "rules_pcf": rules_of(D.EVENTS, weight="pcf"),
    "rules_none": rules_of(D.EVENTS, weight="none"),
    "rules_no_cost": rules_of(D.EVENTS, cost=False),
    "rules_all_but_last": rules_of(D.EVENTS, all_but_last=True),
    "rules_five_labels": rules_of(D.EVENTS, n_labels=5, weight="pcf"),
    "rules_documents": rules_of(D.DOCUMENTS, weight="pcf"),
    "rules_chunked": rules_of(D.EVENTS, chunks=4),
    "rules_chunked_pcf": rules_of(D.EVENTS, chunks=4, weight="pcf"),
    "rules_chunked_none": rules_of(D.EVENTS, chunks=4, weight="none"),
    "chunk_rules": sql(
        model(D.EVENTS, chunks=4),
        "SELECT chunk_id, rule_key, cls AS class_idx, round(weight, 6) AS weight FROM crules",
    ),
    "chunk_rule_counts": sql(
        model(D.EVENTS, chunks=4), "SELECT chunk_id, cls AS class_idx, count(*) AS n_rules FROM crules GROUP BY 1, 2"
    ),
    "mean_rule_counts": sql(model(D.EVENTS, chunks=4), MEANS),
    "rules_per_class": sql(model(D.EVENTS), "SELECT cls AS class_idx, count(*) AS n_rules FROM rules GROUP BY 1"),
    "rule_base_size": sql(model(D.EVENTS, n_labels=5), "SELECT count(*) AS n_rules FROM rules"),
    "chunk_class_counts": sql(
        examples(D.EVENTS),
        "SELECT CAST(row_id % 4 AS INTEGER) AS chunk_id, cls AS class_idx, count(*) AS n_rows FROM ex GROUP BY 1, 2",
    ),
    "multiclass_rules": rules_of(D.ORDERS, n_labels=5),
    "lineitem_rules": rules_of(D.LINEITEM),
    "lineitem_rules_five_labels": rules_of(D.LINEITEM, n_labels=5, weight="pcf"),
    "embedding_rules_8": rules_of(D.EMBEDDINGS_8),
    "embedding_rules_64": rules_of(D.EMBEDDINGS_64),
    "predict_wr": predictions_of(D.EVENTS),
    "predict_ac": predictions_of(D.EVENTS, "additive"),
    "predict_multiclass": predictions_of(D.ORDERS, "additive", n_labels=5),
    "predict_default_first": unseen_sql("first"),
    "predict_default_mode": unseen_sql("most_frequent"),
    "predict_default_mode_additive": unseen_sql("most_frequent", "additive"),
    "customer_rules": rules_of(D.CUSTOMERS),
    "predict_customers": predictions_of(D.CUSTOMERS),
    "predict_embeddings_8": predictions_of(D.EMBEDDINGS_8),
    "predict_embeddings_8_additive": predictions_of(D.EMBEDDINGS_8, "additive"),
    "predict_embeddings_64": wide_sql(),
    "predict_embeddings_64_additive": wide_sql("additive"),
    "rules_bad_rows_dropped": bad_rows_sql(),
    "predict_unknown_values": unknown_values_sql(),
    "order_line_rules": rules_of(D.ORDER_LINES),
    "line_number_rules": rules_of(D.LINE_NUMBERS, n_labels=7),
    "fired_rules": sql(
        model(D.EVENTS) + scored(D.EVENTS)[:1] + [("p2", f"SELECT r.rule_key, r.cls, {match(D.EVENTS)} * r.weight AS assoc FROM fz f CROSS JOIN rules r")],
        "SELECT rule_key, cls AS rule_class, count(*) AS n_rows, round(sum(assoc), 4) AS total FROM p2 WHERE assoc > 0 GROUP BY 1, 2",
    ),
    "confusion_matrix": sql(matrix_of(D.EVENTS), MATRIX),
    "confusion_matrix_pcf": sql(matrix_of(D.EVENTS, weight="pcf"), MATRIX),
    "confusion_matrix_chunked": sql(matrix_of(D.EVENTS, chunks=4), MATRIX),
    "confusion_matrix_multiclass": sql(matrix_of(D.ORDERS, n_labels=5), MATRIX),
    "order_line_confusion": sql(matrix_of(D.ORDER_LINES), MATRIX),
    "order_line_confusion_additive": sql(matrix_of(D.ORDER_LINES, "additive"), MATRIX),
    "confusion_matrix_embeddings_64": sql(matrix_of(D.EMBEDDINGS_64), MATRIX),
    "lineitem_confusion": sql(matrix_of(D.LINEITEM), MATRIX),
    "confusion_pivot": sql(
        matrix_of(D.EVENTS),
        """SELECT actual, CAST(sum(n) FILTER (predicted = 0) AS BIGINT) AS pred_0,
        CAST(sum(n) FILTER (predicted = 1) AS BIGINT) AS pred_1 FROM cm GROUP BY actual""",
    ),
    "binary_auc": sql(matrix_of(D.EVENTS) + auc(), f"SELECT {AUC_COLUMNS} FROM rates"),
    "binary_auc_documents": sql(matrix_of(D.DOCUMENTS, weight="pcf") + auc(), f"SELECT {AUC_COLUMNS} FROM rates"),
    "one_vs_rest_auc": sql(matrix_of(D.ORDERS, n_labels=5) + auc(positive=2), f"SELECT {AUC_COLUMNS} FROM rates"),
    "accuracy": sql(
        matrix_of(D.EVENTS, weight="pcf"),
        """SELECT CAST(sum(CASE WHEN actual = predicted THEN n ELSE 0 END) AS BIGINT) AS hits, CAST(sum(n) AS BIGINT) AS total,
        round(sum(CASE WHEN actual = predicted THEN n ELSE 0 END) / sum(n)::DOUBLE, 6) AS accuracy FROM cm""",
    ),
    "fold_rules": sql(fold_models(), "SELECT model AS fold, rule_key, cls AS class_idx, round(weight, 6) AS weight FROM frules"),
    "cross_validate": sql(fold_metrics("test"), f"SELECT fold, {AUC_COLUMNS} FROM rates"),
    "cross_validate_train": sql(fold_metrics("train"), f"SELECT fold, {AUC_COLUMNS} FROM rates"),
    "cross_validate_chunked": sql(fold_metrics("test", chunks=2, weight="pcf"), f"SELECT fold, {AUC_COLUMNS} FROM rates"),
    "cross_validate_drawn": sql(
        fold_metrics("test", chunks=FOLDS, by_digest=True), f"SELECT fold, {AUC_COLUMNS} FROM rates"
    ),
    "cross_validate_drawn_train": sql(
        fold_metrics("train", chunks=FOLDS, by_digest=True), f"SELECT fold, {AUC_COLUMNS} FROM rates"
    ),
    "assigned_sizes": f"""SELECT CAST({drawn(GA_SEED, "fold", FOLDS)} AS INTEGER) AS fold,
        CAST({drawn(GA_SEED, "chunk", FOLDS)} AS INTEGER) AS chunk_id, count(*) AS n
        FROM (SELECT event_id AS row_id FROM events) e GROUP BY ALL""",
    "cross_validate_mean": sql(
        fold_metrics("test")
        + [("m", "SELECT (1.0 + tp / nullif(tp + fn, 0)::DOUBLE - fp / nullif(fp + tn, 0)::DOUBLE) / 2.0 AS auc FROM rates")],
        "SELECT count(*) AS n_folds, round(avg(auc), 6) AS mean_auc FROM m",
    ),
    "folds_text": folds_text_sql(),
    "validate_files": f"SELECT * FROM ({validated('test')}) UNION ALL SELECT * FROM ({validated('train')})",
    "ga_init": sql(ga_base(), "SELECT chunk_id, chrom_id, rule_key, active FROM pop"),
    "ga_pairs": sql(ga_base() + ga_pairing(), "SELECT chunk_id, chrom_id, pair, side FROM pairs"),
    "ga_hux": sql(ga_base() + ga_children(), "SELECT chunk_id, chrom_id, rule_key, active FROM kids"),
    "ga_fitness": sql(
        ga_base() + ga_fitness(),
        """SELECT chunk_id, chrom_id, tp, fn, fp, tn, CAST(n_selected AS BIGINT) AS n_selected, round(auc, 6) AS auc,
        round(accuracy, 6) AS accuracy, round(fitness, 6) AS fitness FROM fit""",
    ),
    "ga_select": sql(
        ga_base()
        + ga_children()
        + [("everyone", "SELECT * FROM pop UNION ALL SELECT * FROM kids")]
        + ga_fitness("everyone"),
        f"SELECT chunk_id, chrom_id, CAST(place - 1 AS INTEGER) AS rank, round(fitness, 6) AS fitness FROM top WHERE place <= {GA_POP}",
    ),
    "ga_best": sql(
        ga_base() + ga_fitness(), "SELECT chunk_id, chrom_id, round(fitness, 6) AS fitness FROM top WHERE place = 1"
    ),
    "ga_restart": sql(
        ga_base() + ga_fitness() + population(7, name="fresh"),
        f"""SELECT p.chunk_id, 0 AS chrom_id, p.rule_key, p.active FROM pop p JOIN ({BEST}) b USING (chunk_id, chrom_id)
        UNION ALL SELECT chunk_id, chrom_id, rule_key, active FROM fresh WHERE chrom_id > 0""",
    ),
    "ga_search": searched_rules(GA_SEARCH),
    "ga_search_one": searched_rules(GA_POP + 1),
    "ga_population": recursive(
        search(D.EVENTS, GA_POP, GA_SEED, GA_SEARCH, GA_CHUNKS),
        f"SELECT chunk_id, chrom_id, array_to_string(act, ' ') AS rules, round(fitness, 6) AS fitness FROM ({LAST})",
    ),
    "ga_history": recursive(search(D.EVENTS, GA_POP, GA_SEED, GA_SEARCH, GA_CHUNKS), HISTORY),
    "ga_history_restarts": recursive(search(D.HOURS, GA_TINY["pop_size"], GA_SEED, GA_TINY["n_evaluations"]), HISTORY),
    "prune_rules": sql(
        ga_base() + ga_fitness() + [KEPT],
        "SELECT chunk_id, rule_key, cls AS class_idx, round(weight, 6) AS weight FROM kept",
    ),
    "pruned_rule_counts": sql(
        ga_base() + ga_fitness() + [KEPT],
        "SELECT chunk_id, cls AS class_idx, count(*) AS n_rules FROM kept GROUP BY 1, 2",
    ),
    "rule_text": rule_text_sql(),
    "compact_rules": sql(
        model(D.EVENTS),
        "SELECT replace(rule_key, '|', ' ') || ' ' || cls || ' ' || printf('%.6f', round(weight, 6)) AS value FROM rules",
    ),
    "compact_reload": rules_of(D.EVENTS),
    "rule_base_text": rule_base_text_sql(),
    "knowledge_text": knowledge_text_sql(),
    "confusion_text": confusion_text_sql(),
    "counters_text": sql(
        model(D.EVENTS, chunks=4) + [("means", MEANS)],
        """SELECT CAST(-1 AS BIGINT) AS at, ' Average of RB in each Map with total Map = 4' AS value UNION ALL
        SELECT CAST(class_idx AS BIGINT), ' Class ' || CASE class_idx WHEN 0 THEN 'error' ELSE 'other' END || ' = '
        || CAST(mean_rules AS VARCHAR) FROM means""",
    ),
    "variables_text": variables_text_sql(),
    "text_scan": sql(
        [("t", TEXT_ROWS)],
        """SELECT CASE cls WHEN 0 THEN 'error' ELSE 'other' END AS y, count(*) AS n, round(sum(x0), 4) AS sum_f0,
        CAST(sum(x1) AS BIGINT) AS sum_f1, CAST(sum(x2) AS BIGINT) AS sum_f2 FROM t GROUP BY 1""",
    ),
    "text_rules": text_rules_sql(),
    "drop_counts": """SELECT CASE WHEN event_type = 'click' THEN 'fields' WHEN event_type NOT IN ('error', 'view') THEN 'class'
        WHEN hour(ts) IN (3, 4, 5) THEN 'number' WHEN hour(ts) >= 20 THEN 'value' ELSE 'kept' END AS reason, count(*) AS n
        FROM events GROUP BY 1""",
    "header_items": HEADER,
    "header_schema": HEADER_SCHEMA,
}
