"""The registered queries: one per operator or result, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.catalog import datasets as D
from ruleloom.functions import rendering as R
from ruleloom.functions.membership import class_index, pick
from ruleloom.operators import counters, selection
from ruleloom.operators.dictionary import coded, dictionary
from ruleloom.operators.encode import CHUNK, CLASS, chunk_of, encode, fuzzify, own_labels, rule_key
from ruleloom.operators.evaluate import accuracy, binary_auc, confusion_matrix, confusion_pivot, mean_auc
from ruleloom.operators.faults import line_drop_counts
from ruleloom.operators.grid import GRID_FEATURES
from ruleloom.operators.profile import class_profile, feature_ranges, most_frequent_class, nominal_values, profile
from ruleloom.operators.ranking import numbered
from ruleloom.operators.score import fired_rules, score
from ruleloom.operators.support import candidate_rules, rule_support
from ruleloom.operators.weights import class_weights, keep_rules
from ruleloom.params import Params
from ruleloom.plans.crossval import cross_validate, validate_folds
from ruleloom.plans.learn import Model, learn, learn_chunks
from ruleloom.schema import NOMINAL, RuleSchema, Variable, fuzzy_sets
from ruleloom.session import cut_lineage, ensure_checkpoint_dir
from ruleloom.sinks import text
from ruleloom.sources.examples import split_examples
from ruleloom.sources.folds import TEST_FILE, TRAIN_FILE, fold_of, read_folds
from ruleloom.sources.header import header_items, schema_from_items
from ruleloom.sources.rulefiles import parse_compact

GA_POP = 10
GA_SEED = 10000
GA_CHUNKS = 2
GA_SEARCH = 3 * GA_POP
GA_TINY = {"pop_size": 4, "n_evaluations": 60}
FOLDS = 5


def setup(spark: SparkSession, sf_dir: str, ds: D.Dataset, n_labels: int = 3) -> tuple[DataFrame, RuleSchema]:
    df = ds.table(spark, sf_dir)
    return df, profile(df, ds.features, ds.label, n_labels, ds.classes)


def trained(spark, sf_dir, ds=D.EVENTS, **kw) -> tuple[DataFrame, Model]:
    if len(ds.numeric) > GRID_FEATURES:
        # One small file with much work per row: use all cores for the pairs.
        kw["row_partitions"] = spark.sparkContext.defaultParallelism
    params = Params(**{"rule_weight": "cf", **kw})
    df, schema = setup(spark, sf_dir, ds, params.n_labels)
    return df, learn(df, schema, params, ds.row_id)


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)


def rule_rows(rules: DataFrame, *by: str) -> DataFrame:
    return rules.select(*by, "rule_key", CLASS, r6("weight"))


# Schema facts and fuzzy scalars


def q_class_profile(ds):
    def run(spark, sf_dir):
        c = class_profile(ds.table(spark, sf_dir), ds.label)
        return c.select("class_idx", "label", "n", r6("cost"), r6("imbalance_ratio"))

    return run


def q_most_frequent_class(spark, sf_dir):
    return most_frequent_class(class_profile(D.orders(spark, sf_dir), "y"))


def q_feature_profile(spark, sf_dir):
    return feature_ranges(D.events(spark, sf_dir), D.EVENTS.features)


def q_nominal_values(spark, sf_dir):
    return nominal_values(D.labelled_documents(spark, sf_dir), ["lang", "source"])


def q_fuzzy_sets(ds, n_labels):
    def run(spark, sf_dir):
        names = [ds.features[i] for i in ds.numeric]
        sets = fuzzy_sets(feature_ranges(ds.table(spark, sf_dir), names), n_labels)
        cols = ["left_pt", "mid_pt", "right_pt", "upper_cut"]
        return sets.select("var_idx", "name", "label", *[r6(c) for c in cols])

    return run


def q_fuzzify(ds, n_labels):
    def run(spark, sf_dir):
        df, schema = setup(spark, sf_dir, ds, n_labels)
        return fuzzify(df, schema, "row_id").select("row_id", CHUNK, CLASS, "rule_key")

    return run


def q_membership(spark, sf_dir):
    df, schema = setup(spark, sf_dir, D.EVENTS)
    wide = fuzzify(df, schema, "row_id").select("row_id", F.posexplode("mu").alias("var_idx", "m"))
    return wide.select("row_id", "var_idx", F.posexplode("m").alias("label", "mu")).withColumn(
        "mu", F.round("mu", 6)
    )


def q_class_index(spark, sf_dir):
    o = D.orders(spark, sf_dir)
    idx = class_index(F.col("y"), D.ORDERS.classes)
    return o.groupBy(idx.alias(CLASS), pick(D.ORDERS.classes, idx).alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )


# Learning


def q_candidates(ds, n_labels):
    def run(spark, sf_dir):
        df, schema = setup(spark, sf_dir, ds, n_labels)
        return candidate_rules(fuzzify(df, schema, "row_id")).select("rule_key", CLASS, "first_row")

    return run


def q_lineitem_candidates(spark, sf_dir):
    df, schema = setup(spark, sf_dir, D.LINEITEM)
    rows = encode(df, schema)
    return rows.groupBy(rule_key(own_labels(schema)).alias("rule_key"), CLASS).agg(F.count(F.lit(1)).alias("n"))


def q_support(ds, **kw):
    def run(spark, sf_dir):
        params = Params(**{"rule_weight": "cf", **kw})
        df, schema = setup(spark, sf_dir, ds, params.n_labels)
        out = rule_support(df, schema, params)
        return out.select("rule_key", CLASS, F.round("support", 5).alias("support"))

    return run


def q_class_weights(spark, sf_dir):
    df, schema = setup(spark, sf_dir, D.EVENTS)
    return class_weights(rule_support(df, schema, Params()), "pcf").select("rule_key", CLASS, r6("weight"))


def q_rules(ds, **kw):
    def run(spark, sf_dir):
        _, model = trained(spark, sf_dir, ds, **kw)
        return rule_rows(model.rules)

    return run


def q_chunk_rules(spark, sf_dir):
    _, model = trained(spark, sf_dir, n_chunks=4)
    return rule_rows(model.chunk_rules, CHUNK)


def q_chunk_rule_counts(spark, sf_dir):
    _, model = trained(spark, sf_dir, n_chunks=4)
    return counters.chunk_rule_counts(model.chunk_rules)


def q_mean_rule_counts(spark, sf_dir):
    _, model = trained(spark, sf_dir, n_chunks=4)
    return counters.mean_rule_counts(model.chunk_rules, model.schema, 4)


def q_rules_per_class(spark, sf_dir):
    _, model = trained(spark, sf_dir)
    return counters.rules_per_class(model.rules)


def q_rule_base_size(spark, sf_dir):
    _, model = trained(spark, sf_dir, n_labels=5)
    return counters.rule_base_size(model.rules)


def q_chunk_class_counts(spark, sf_dir):
    df, schema = setup(spark, sf_dir, D.EVENTS)
    return counters.chunk_class_counts(df, schema, "row_id", 4)


# Scoring and evaluation


def q_predict(ds, **kw):
    def run(spark, sf_dir):
        df, model = trained(spark, sf_dir, ds, **kw)
        return model.predict(df, "row_id").select("row_id", "actual", "predicted", r6("degree"))

    return run


def coded_customers(spark, sf_dir):
    """Orders with every customer as a value of its own, learned by codes."""
    ds = D.CUSTOMERS
    df = ds.table(spark, sf_dir)
    values = dictionary(df, "customer")
    table = coded(df, [values])
    schema = profile(table, ds.features, ds.label, 3, ds.classes, dictionaries=[values])
    return table, learn(table, schema, Params(rule_weight="cf"), ds.row_id)


def q_customer_rules(spark, sf_dir):
    return rule_rows(coded_customers(spark, sf_dir)[1].rules)


def q_predict_customers(spark, sf_dir):
    table, model = coded_customers(spark, sf_dir)
    return model.predict(table, "row_id").select("row_id", "actual", "predicted", r6("degree"))


def q_predict_wide(**kw):
    """Degrees are products of 64 factors, so their logarithms are compared."""

    def run(spark, sf_dir):
        df, model = trained(spark, sf_dir, D.EMBEDDINGS_64, **kw)
        log = F.round(F.log10(F.when(F.col("degree") > 0, F.col("degree"))), 6)
        return model.predict(df).select("actual", "predicted", log.alias("log_degree"))

    return run


def q_bad_rows(spark, sf_dir):
    """Rows with unreadable numbers are left out of learning."""
    clean, schema = setup(spark, sf_dir, D.EVENTS)
    rules = learn(D.events_with_bad_numbers(spark, sf_dir), schema, Params(rule_weight="cf", bad_rows="drop")).rules
    return rule_rows(rules)


def q_unknown_values(spark, sf_dir):
    """Rules of the labelled documents that are not French, on all of them: one
    source has no class, and the French ones match no rule."""
    docs = D.labelled_documents(spark, sf_dir)
    known = docs.filter("lang <> 'fr'")
    schema = profile(known, D.DOCUMENTS.features, "y", 3, D.DOCUMENTS.classes)
    model = learn(known, schema, Params(rule_weight="cf"), "row_id")
    unclear = docs.withColumn("y", F.when(F.col("source") == "src1", "?").otherwise(F.col("y")))
    return model.predict(unclear, "row_id").select("row_id", "actual", "predicted", r6("degree"))


def q_predict_unseen(default_class, inference="winning_rule"):
    """Rules from the labelled documents, applied to all of them."""

    def run(spark, sf_dir):
        _, model = trained(spark, sf_dir, D.DOCUMENTS, default_class=default_class, inference=inference)
        out = model.predict(D.all_documents(spark, sf_dir), "row_id", with_actual=False)
        return out.select("row_id", "predicted", r6("degree"))

    return run


def q_fired(spark, sf_dir):
    df, model = trained(spark, sf_dir)
    rows = encode(df, model.schema, ["row_id"], learning=False)
    pairs = fired_rules(rows, model.schema, model.rules, model.params, "row_id")
    return pairs.groupBy("rule_key", "rule_class").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("assoc"), 4).alias("total")
    )


def q_matrix(ds, **kw):
    def run(spark, sf_dir):
        df, model = trained(spark, sf_dir, ds, **kw)
        return confusion_matrix(model.predict(df), model.schema)

    return run


def q_pivot(ds, **kw):
    def run(spark, sf_dir):
        return confusion_pivot(q_matrix(ds, **kw)(spark, sf_dir), setup(spark, sf_dir, ds)[1])

    return run


def q_auc(ds, positive=0, **kw):
    def run(spark, sf_dir):
        return binary_auc(q_matrix(ds, **kw)(spark, sf_dir), positive).select("tp", "fn", "fp", "tn", r6("auc"))

    return run


def q_accuracy(ds, **kw):
    def run(spark, sf_dir):
        return accuracy(q_matrix(ds, **kw)(spark, sf_dir)).select("hits", "total", r6("accuracy"))

    return run


def q_embedding_matrix(ds, n_labels):
    def run(spark, sf_dir):
        df, model = trained(spark, sf_dir, ds, n_labels=n_labels)
        model = model.cache()
        return confusion_matrix(model.predict(df, "row_id"), model.schema)

    return run


# Cross-validation


def folds(spark, sf_dir, **kw):
    params = Params(**{"rule_weight": "cf", "n_folds": FOLDS, **kw})
    df, schema = setup(spark, sf_dir, D.EVENTS)
    return cross_validate(df, schema, params, "row_id")


def q_fold_rules(spark, sf_dir):
    return rule_rows(folds(spark, sf_dir).rules, "fold")


def q_fold_metrics(which, **kw):
    def run(spark, sf_dir):
        m = folds(spark, sf_dir, **kw).metrics(which)
        return m.select("fold", "tp", "fn", "fp", "tn", r6("auc"))

    return run


def q_assigned_sizes(spark, sf_dir):
    """Rows of every fold and chunk, as many chunks as folds."""
    df, params = D.events(spark, sf_dir), Params(n_chunks=FOLDS, n_folds=FOLDS, assign="digest", seed=GA_SEED)
    fold, chunk = fold_of(df, "row_id", FOLDS, params), chunk_of(df, "row_id", FOLDS, params)
    return df.groupBy(fold.alias("fold"), chunk.alias(CHUNK)).agg(F.count(F.lit(1)).alias("n"))


def q_folds_text(spark, sf_dir):
    return numbers_apart(text.folds_text(folds(spark, sf_dir).metrics("test")))


def q_fold_average(spark, sf_dir):
    return mean_auc(folds(spark, sf_dir).metrics("test")).select("n_folds", r6("mean_auc"))


def q_validate_files(spark, sf_dir):
    """Pairs of fold files written from the events and read back in one scan."""
    df, schema = setup(spark, sf_dir, D.EVENTS)
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in schema.file_columns]).alias("value")
    name = f"{ensure_checkpoint_dir(spark)}/folds-{uuid.uuid4().hex}/events"
    for i in range(FOLDS):
        here = F.pmod("row_id", F.lit(FOLDS)) == i
        df.filter(~here).select(line).write.text(TRAIN_FILE.format(name=name, fold=i + 1))
        df.filter(here).select(line).write.text(TEST_FILE.format(name=name, fold=i + 1, suffix="tst.dat"))
    rows = read_folds(spark, name, "tst.dat", FOLDS, schema)
    m = validate_folds(rows, schema, Params(rule_weight="cf", n_folds=FOLDS))
    return m.select("fold", "part", "tp", "fn", "fp", "tn", r6("auc"))


# Rule selection


def ga_rules(spark, sf_dir):
    params = Params(rule_weight="cf", n_chunks=GA_CHUNKS, pop_size=GA_POP, seed=GA_SEED)
    df, schema = setup(spark, sf_dir, D.EVENTS)
    rules = cut_lineage(learn_chunks(df, schema, params, "row_id"))
    return df, schema, params, rules


def q_ga_init(spark, sf_dir):
    *_, rules = ga_rules(spark, sf_dir)
    return selection.init_population(rules, GA_POP, GA_SEED)


def ga_children(rules):
    pop = selection.init_population(rules, GA_POP, GA_SEED)
    pairs = selection.pair_chromosomes(pop.select(CHUNK, "chrom_id").distinct(), GA_SEED, 1)
    return pop, selection.hux(pop, pairs, GA_SEED, 1, GA_POP)


def q_ga_pairs(spark, sf_dir):
    *_, rules = ga_rules(spark, sf_dir)
    pop = selection.init_population(rules, GA_POP, GA_SEED)
    return selection.pair_chromosomes(pop.select(CHUNK, "chrom_id").distinct(), GA_SEED, 1)


def q_ga_hux(spark, sf_dir):
    *_, rules = ga_rules(spark, sf_dir)
    return ga_children(rules)[1]


def ga_fit(spark, sf_dir, with_children=False):
    df, schema, params, rules = ga_rules(spark, sf_dir)
    evidence = selection.gather_evidence(df, schema, rules, params, "row_id")
    pop, children = ga_children(rules)
    both = pop.unionByName(children) if with_children else pop
    return rules, both, selection.fitness(evidence, both, schema, params)


def q_ga_fitness(spark, sf_dir):
    _, _, fit = ga_fit(spark, sf_dir)
    return fit.select(
        CHUNK, "chrom_id", "tp", "fn", "fp", "tn", "n_selected", r6("auc"), r6("accuracy"), r6("fitness")
    )


def q_ga_select(spark, sf_dir):
    _, _, fit = ga_fit(spark, sf_dir, with_children=True)
    return selection.truncate(fit, GA_POP).select(CHUNK, "chrom_id", "rank", r6("fitness"))


def q_ga_best(spark, sf_dir):
    _, _, fit = ga_fit(spark, sf_dir)
    return selection.best_chromosome(fit).select(CHUNK, "chrom_id", r6("fitness"))


def q_prune_rules(spark, sf_dir):
    rules, pop, fit = ga_fit(spark, sf_dir)
    return rule_rows(selection.apply_best(rules, pop, fit), CHUNK)


def q_pruned_counts(spark, sf_dir):
    rules, pop, fit = ga_fit(spark, sf_dir)
    return counters.chunk_rule_counts(selection.apply_best(rules, pop, fit))


def q_ga_restart(spark, sf_dir):
    _, pop, fit = ga_fit(spark, sf_dir)
    return selection.restart(pop, fit, GA_POP, GA_SEED, 7)


def searched(spark, sf_dir, ds=D.EVENTS, **kw):
    params = Params(**{"rule_weight": "cf", "pop_size": GA_POP, "seed": GA_SEED, **kw})
    df, schema = setup(spark, sf_dir, ds)
    rules = cut_lineage(learn_chunks(df, schema, params, "row_id"))
    return selection.select_rules(df, schema, rules, params, "row_id")


def q_ga_search(n_evaluations):
    def run(spark, sf_dir):
        _, model = trained(spark, sf_dir, n_chunks=GA_CHUNKS, pop_size=GA_POP, n_evaluations=n_evaluations)
        return rule_rows(model.rules)

    return run


def q_ga_history(ds, **kw):
    """Best fitness, new children, budget and restarts of every chunk after every generation."""

    def run(spark, sf_dir):
        log = searched(spark, sf_dir, ds, **kw).history
        rows = [(h["generation"], h["chunk_id"], round(h["best"], 6), h["new"], h["budget"], h["resets"]) for h in log]
        return spark.createDataFrame(rows, "generation int, chunk_id int, best double, new int, budget int, resets int")

    return run


def q_ga_population(spark, sf_dir):
    """The chromosomes that a search ends with."""
    found = searched(spark, sf_dir, n_chunks=GA_CHUNKS, n_evaluations=GA_SEARCH)
    on = F.array_sort(F.collect_list(F.when(F.col("active") == 1, F.col("rule_key"))))
    sets = found.population.groupBy(CHUNK, "chrom_id").agg(F.array_join(on, " ").alias("rules"))
    return sets.join(found.fitness, [CHUNK, "chrom_id"]).select(CHUNK, "chrom_id", "rules", r6("fitness"))


# Text outputs and inputs


NUMBER = r"-?[0-9]+\.[0-9]+(E-?[0-9]+)?"


def numbers_apart(lines):
    """Text lines with their decimal numbers taken out and given with four places."""
    each = lines.select("at", F.posexplode(F.split("value", "\n")).alias("line_no", "line")).filter("trim(line) <> ''")
    found = F.transform(F.regexp_extract_all("line", F.lit(NUMBER), F.lit(0)), lambda x: F.format_string("%.4f", F.round(x.cast("double"), 4)))
    return each.select("at", F.regexp_replace(F.trim("line"), NUMBER, "#").alias("line"), F.array_join(found, " ").alias("numbers"))


def q_rule_text(spark, sf_dir):
    df, model = trained(spark, sf_dir, D.DOCUMENTS)
    cls, w = F.col(CLASS), F.round("weight", 6)
    rendered = R.rule_text(model.schema, F.col("antecedents"), cls, F.format_string("%.6f", w))
    return numbered(model.rules, ["antecedents"], "rule_no").select("rule_no", rendered.alias("rule"))


def q_compact_rules(spark, sf_dir):
    _, model = trained(spark, sf_dir)
    w = F.format_string("%.6f", F.round("weight", 6))
    return model.rules.select(R.compact_rule(F.col("antecedents"), F.col(CLASS), w).alias("value"))


def q_compact_reload(spark, sf_dir):
    _, model = trained(spark, sf_dir)
    return rule_rows(parse_compact(R.compact_lines(model.rules), model.schema))


def q_rule_base_text(spark, sf_dir):
    _, model = trained(spark, sf_dir)
    return numbers_apart(text.rule_base_text(model.rules, model.schema))


def q_knowledge_text(spark, sf_dir):
    """The knowledge base file: variables, then rules."""
    _, model = trained(spark, sf_dir)
    return numbers_apart(text.knowledge_text(model, spark)).drop("at")


def q_confusion_text(spark, sf_dir):
    df, model = trained(spark, sf_dir)
    pivot = confusion_pivot(confusion_matrix(model.predict(df), model.schema), model.schema)
    return text.confusion_text(pivot, model.schema)


def q_counters_text(spark, sf_dir):
    _, model = trained(spark, sf_dir, n_chunks=4)
    return text.counters_text(counters.mean_rule_counts(model.chunk_rules, model.schema, 4), model.schema)


def q_variables_text(spark, sf_dir):
    _, schema = setup(spark, sf_dir, D.DOCUMENTS)
    return numbers_apart(text.variables_text(schema, spark))


def example_lines(spark, sf_dir):
    """Example lines written from the events: some have a trailing empty field,
    some a field too many."""
    e = D.read(spark, sf_dir, "events")
    tail = F.when(F.col("event_type") == "view", ",").when(F.col("event_type") == "click", ",x").otherwise("")
    label = F.when(F.col("event_type") == "error", "error").otherwise("other")
    k = F.get_json_object("props", "$.k")
    fields = F.concat_ws(", ", F.col("value").cast("string"), F.hour("ts").cast("string"), k, label)
    return e.select(F.concat(fields, tail).alias("value"))


def q_text_scan(spark, sf_dir):
    _, schema = setup(spark, sf_dir, D.EVENTS)
    rows = split_examples(example_lines(spark, sf_dir), schema)
    return rows.groupBy("y").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum(F.col("f0").try_cast("double")), 4).alias("sum_f0"),
        F.sum(F.col("f1").try_cast("bigint")).alias("sum_f1"),
        F.sum(F.col("f2").try_cast("bigint")).alias("sum_f2"),
    )


def q_text_rules(spark, sf_dir):
    """Learning straight from example lines."""
    _, schema = setup(spark, sf_dir, D.EVENTS)
    rows = split_examples(example_lines(spark, sf_dir), schema)
    return rule_rows(learn(rows, schema, Params(rule_weight="cf")).rules)


def q_drop_counts(spark, sf_dir):
    """Why lines are left out: a field too many, a class, number or hour that the schema doesn't know."""
    _, s = setup(spark, sf_dir, D.EVENTS)
    hours = Variable("f1", NOMINAL, values=tuple(str(h) for h in range(20)))
    schema = RuleSchema((s.variables[0], hours, s.variables[2]), "y", ("error", "view"), (1, 1), 3)
    bad = D.events_with_bad_numbers(spark, sf_dir).drop("y")
    kind = D.read(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), "event_type")
    tail = F.when(F.col("event_type") == "view", ",").when(F.col("event_type") == "click", ",x").otherwise("")
    fields = F.concat_ws(", ", "f0", F.col("f1").cast("string"), F.col("f2").cast("string"), "event_type")
    return line_drop_counts(bad.join(kind, "row_id").select(F.concat(fields, tail).alias("value")), schema)


def header_lines(spark, sf_dir):
    """A dataset header written from the labelled documents."""
    docs = D.labelled_documents(spark, sf_dir)
    ranges = feature_ranges(docs, ["n_chars"]).select(
        F.lit(0).alias("at"),
        F.concat(
            F.lit("@attribute n_chars integer["),
            F.col("lower").cast("bigint").cast("string"),
            F.lit(", "),
            F.col("upper").cast("bigint").cast("string"),
            F.lit("]"),
        ).alias("value"),
    )
    values = (
        nominal_values(docs, ["lang", "source", "y"])
        .groupBy("name")
        .agg(F.array_sort(F.collect_list("value")).alias("v"))
        .select(
            F.lit(1).alias("at"),
            F.concat(F.lit("@attribute "), F.col("name"), F.lit(" {"), F.array_join("v", ", "), F.lit("}")).alias("value"),
        )
    )
    counts = class_profile(docs, "y").agg(
        F.concat(
            F.lit("@numInstancesByClass "),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("class_idx", "n"))), lambda e: e["n"].cast("string")), ","),
        ).alias("value")
    )
    return ranges.unionByName(values).unionByName(counts.select(F.lit(2).alias("at"), "value")).select("value")


def q_header_items(spark, sf_dir):
    items = header_items(header_lines(spark, sf_dir))
    return items.select("item", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("kind", F.lit("")).alias("kind"), F.array_join("items", "|").alias("items"))


def q_header_schema(spark, sf_dir):
    """The variables that a header declares, its class sizes beside them."""
    lines = header_lines(spark, sf_dir).union(spark.createDataFrame([("@output y",)], "value string"))
    s = schema_from_items(header_items(lines).collect(), 3)
    rows = [(v.name, v.kind, v.lower, v.upper, "|".join(v.values or ())) for v in s.variables]
    rows.append((s.label, "class", None, None, "|".join(f"{c} {n}" for c, n in zip(s.classes, s.class_counts))))
    return spark.createDataFrame(rows, "name string, kind string, lower double, upper double, entries string")


QUERIES = {
    "class_profile": q_class_profile(D.EVENTS),
    "class_profile_multiclass": q_class_profile(D.ORDERS),
    "most_frequent_class": q_most_frequent_class,
    "feature_profile": q_feature_profile,
    "nominal_values": q_nominal_values,
    "fuzzy_sets": q_fuzzy_sets(D.EVENTS, 3),
    "fuzzy_sets_seven": q_fuzzy_sets(D.LINEITEM, 7),
    "fuzzify_labels": q_fuzzify(D.EVENTS, 3),
    "fuzzify_nominal": q_fuzzify(D.ORDERS, 5),
    "membership": q_membership,
    "class_index": q_class_index,
    "candidate_rules": q_candidates(D.EVENTS, 3),
    "candidate_rules_documents": q_candidates(D.DOCUMENTS, 5),
    "candidate_rules_lineitem": q_lineitem_candidates,
    "rule_support": q_support(D.EVENTS),
    "rule_support_all_but_last": q_support(D.EVENTS, weight_features="all_but_last"),
    "rule_support_nominal": q_support(D.DOCUMENTS),
    "rule_support_nominal_last_skipped": q_support(D.DOCUMENTS, weight_features="all_but_last"),
    "class_weights": q_class_weights,
    "rules_cf": q_rules(D.EVENTS),
    "rules_pcf": q_rules(D.EVENTS, rule_weight="pcf"),
    "rules_none": q_rules(D.EVENTS, rule_weight="none"),
    "rules_no_cost": q_rules(D.EVENTS, cost_sensitive=False),
    "rules_all_but_last": q_rules(D.EVENTS, weight_features="all_but_last"),
    "rules_five_labels": q_rules(D.EVENTS, n_labels=5, rule_weight="pcf"),
    "rules_documents": q_rules(D.DOCUMENTS, rule_weight="pcf"),
    "rules_chunked": q_rules(D.EVENTS, n_chunks=4),
    "rules_chunked_pcf": q_rules(D.EVENTS, n_chunks=4, rule_weight="pcf"),
    "rules_chunked_none": q_rules(D.EVENTS, n_chunks=4, rule_weight="none"),
    "chunk_rules": q_chunk_rules,
    "chunk_rule_counts": q_chunk_rule_counts,
    "mean_rule_counts": q_mean_rule_counts,
    "rules_per_class": q_rules_per_class,
    "rule_base_size": q_rule_base_size,
    "chunk_class_counts": q_chunk_class_counts,
    "multiclass_rules": q_rules(D.ORDERS, n_labels=5),
    "lineitem_rules": q_rules(D.LINEITEM),
    "lineitem_rules_five_labels": q_rules(D.LINEITEM, n_labels=5, rule_weight="pcf"),
    "embedding_rules_8": q_rules(D.EMBEDDINGS_8),
    "embedding_rules_64": q_rules(D.EMBEDDINGS_64),
    "predict_wr": q_predict(D.EVENTS),
    "predict_ac": q_predict(D.EVENTS, inference="additive"),
    "predict_multiclass": q_predict(D.ORDERS, n_labels=5, inference="additive"),
    "predict_default_first": q_predict_unseen("first"),
    "predict_default_mode": q_predict_unseen("most_frequent"),
    "predict_default_mode_additive": q_predict_unseen("most_frequent", "additive"),
    "customer_rules": q_customer_rules,
    "predict_customers": q_predict_customers,
    "predict_embeddings_8": q_predict(D.EMBEDDINGS_8),
    "predict_embeddings_8_additive": q_predict(D.EMBEDDINGS_8, inference="additive"),
    "predict_embeddings_64": q_predict_wide(),
    "predict_embeddings_64_additive": q_predict_wide(inference="additive"),
    "rules_bad_rows_dropped": q_bad_rows,
    "predict_unknown_values": q_unknown_values,
    "order_line_rules": q_rules(D.ORDER_LINES),
    "line_number_rules": q_rules(D.LINE_NUMBERS, n_labels=7),
    "fired_rules": q_fired,
    "confusion_matrix": q_matrix(D.EVENTS),
    "confusion_matrix_pcf": q_matrix(D.EVENTS, rule_weight="pcf"),
    "confusion_matrix_chunked": q_matrix(D.EVENTS, n_chunks=4),
    "confusion_matrix_multiclass": q_matrix(D.ORDERS, n_labels=5),
    "confusion_matrix_embeddings_64": q_embedding_matrix(D.EMBEDDINGS_64, 3),
    "lineitem_confusion": q_matrix(D.LINEITEM),
    "order_line_confusion": q_matrix(D.ORDER_LINES),
    "order_line_confusion_additive": q_matrix(D.ORDER_LINES, inference="additive"),
    "confusion_pivot": q_pivot(D.EVENTS),
    "binary_auc": q_auc(D.EVENTS),
    "binary_auc_documents": q_auc(D.DOCUMENTS, rule_weight="pcf"),
    "one_vs_rest_auc": q_auc(D.ORDERS, positive=2, n_labels=5),
    "accuracy": q_accuracy(D.EVENTS, rule_weight="pcf"),
    "fold_rules": q_fold_rules,
    "cross_validate": q_fold_metrics("test"),
    "cross_validate_train": q_fold_metrics("train"),
    "cross_validate_chunked": q_fold_metrics("test", n_chunks=2, rule_weight="pcf"),
    "cross_validate_drawn": q_fold_metrics("test", n_chunks=FOLDS, assign="digest", seed=GA_SEED),
    "cross_validate_drawn_train": q_fold_metrics("train", n_chunks=FOLDS, assign="digest", seed=GA_SEED),
    "assigned_sizes": q_assigned_sizes,
    "cross_validate_mean": q_fold_average,
    "folds_text": q_folds_text,
    "validate_files": q_validate_files,
    "ga_init": q_ga_init,
    "ga_pairs": q_ga_pairs,
    "ga_hux": q_ga_hux,
    "ga_fitness": q_ga_fitness,
    "ga_select": q_ga_select,
    "ga_best": q_ga_best,
    "ga_restart": q_ga_restart,
    "ga_search": q_ga_search(GA_SEARCH),
    "ga_search_one": q_ga_search(GA_POP + 1),
    "ga_population": q_ga_population,
    "ga_history": q_ga_history(D.EVENTS, n_chunks=GA_CHUNKS, n_evaluations=GA_SEARCH),
    "ga_history_restarts": q_ga_history(D.HOURS, **GA_TINY),
    "prune_rules": q_prune_rules,
    "pruned_rule_counts": q_pruned_counts,
    "rule_text": q_rule_text,
    "compact_rules": q_compact_rules,
    "compact_reload": q_compact_reload,
    "rule_base_text": q_rule_base_text,
    "knowledge_text": q_knowledge_text,
    "confusion_text": q_confusion_text,
    "counters_text": q_counters_text,
    "variables_text": q_variables_text,
    "text_scan": q_text_scan,
    "text_rules": q_text_rules,
    "drop_counts": q_drop_counts,
    "header_items": q_header_items,
    "header_schema": q_header_schema,
}
