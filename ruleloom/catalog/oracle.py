"""SQL counterparts of the registered queries.

Everything is spelled out the plain way: rows times candidate rules, then
aggregates. Each builder returns a list of named CTEs; ``sql`` strings them
together with a final SELECT.
"""

from __future__ import annotations

from ruleloom.catalog.datasets import Dataset


def sql(ctes, final: str) -> str:
    named = ",\n".join(f"{name} AS (\n{body}\n)" for name, body in ctes)
    return f"WITH {named}\n{final}"


def peak(i: int, k: int, n_labels: int) -> str:
    return f"(g.lo{i} + ((g.hi{i} - g.lo{i}) / {float(n_labels - 1)}) * {float(k)})"


def cut(i: int, k: int, n_labels: int) -> str:
    up, down = peak(i, k + 1, n_labels), peak(i, k, n_labels)
    return f"({up} - ({up} - {down}) / 2)"


def label(i: int, n_labels: int) -> str:
    whens = " ".join(f"WHEN e.x{i} < {cut(i, k, n_labels)} THEN {k}" for k in range(n_labels - 1))
    return f"CASE {whens} ELSE {n_labels - 1} END"


def degree(i: int, k: int, n_labels: int) -> str:
    x, mid = f"e.x{i}", peak(i, k, n_labels)
    left = mid if k == 0 else peak(i, k - 1, n_labels)
    right = mid if k == n_labels - 1 else peak(i, k + 1, n_labels)
    return (
        f"CASE WHEN {left} <= {x} AND {x} <= {mid} THEN"
        f" CASE WHEN {left} = {x} AND {mid} = {x} THEN 1.0::DOUBLE ELSE ({x} - {left}) / nullif({mid} - {left}, 0) END"
        f" WHEN {mid} <= {x} AND {x} <= {right} THEN"
        f" CASE WHEN {mid} = {x} AND {right} = {x} THEN 1.0::DOUBLE ELSE ({right} - {x}) / nullif({right} - {mid}, 0) END"
        f" ELSE 0.0::DOUBLE END"
    )


def examples(ds: Dataset, where: str = "cls >= 0"):
    """``ex`` the rows and ``rng`` ranges, value lists and nothing else."""
    facts = []
    for i, kind in enumerate(ds.kinds):
        if kind == "numeric":
            facts += [f"min(x{i}) AS lo{i}", f"max(x{i}) AS hi{i}"]
        else:
            facts.append(f"list_sort(list(DISTINCT x{i})) AS v{i}")
    return [("ex", f"SELECT * FROM ({ds.sql}) WHERE {where}"), ("rng", f"SELECT {', '.join(facts)} FROM ex")]


def drawn(seed: int, purpose: str, n: int) -> str:
    """A number below ``n`` from a digest of seed, purpose and row id."""
    return f"('0x' || substr(md5('{seed}|{purpose}|' || e.row_id), 1, 8))::BIGINT % {n}"


def fuzzified(ds: Dataset, n_labels: int = 3, chunks: int = 1, source: str = "ex", name: str = "fz", chunk: str | None = None):
    """Labels ``a*``, degree lists ``mu*`` and the rule key of every row."""
    cols = []
    for i, kind in enumerate(ds.kinds):
        if kind == "numeric":
            cols.append(f"{label(i, n_labels)} AS a{i}")
            degrees = ", ".join(degree(i, k, n_labels) for k in range(n_labels))
            cols.append(f"[{degrees}] AS mu{i}")
        else:
            cols.append(f"coalesce(list_position(g.v{i}, e.x{i}), 0) - 1 AS a{i}")
    chunk = chunk or (f"e.row_id % {chunks}" if chunks > 1 else "0")
    key = " || '|' || ".join(f"CAST(a{i} AS VARCHAR)" for i in range(len(ds.kinds)))
    inner = f"SELECT e.*, CAST({chunk} AS INTEGER) AS chunk_id, {', '.join(cols)} FROM {source} e CROSS JOIN rng g"
    return [(name, f"SELECT *, {key} AS rule_key FROM ({inner})")]


def match(ds: Dataset, upto: int | None = None, rule: str = "r", row: str = "f") -> str:
    """Degree of a row in a rule: product over the first ``upto`` features."""
    terms = []
    for i, kind in enumerate(ds.kinds[:upto]):
        if kind == "numeric":
            terms.append(f"{row}.mu{i}[{rule}.a{i} + 1]")
        else:
            terms.append(f"(CASE WHEN {rule}.a{i} = {row}.a{i} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)")
    return " * ".join(terms)


def labels_of(ds: Dataset, alias: str = "") -> str:
    return ", ".join(f"{alias}a{i}" for i in range(len(ds.kinds)))


def supports(ds: Dataset, cost: bool = True, all_but_last: bool = False, fz: str = "fz", tag: str = ""):
    """``seen`` consequents with ``support``, per chunk."""
    upto = len(ds.kinds) - 1 if all_but_last else None
    price = "(SELECT min(n) FROM cls) / n::DOUBLE" if cost else "1.0::DOUBLE"
    group = "chunk_id, rule_key, cls"
    return [
        ("cls", "SELECT cls, count(*) AS n FROM ex GROUP BY cls"),
        ("cost", f"SELECT cls, {price} AS cost FROM cls"),
        (f"seen{tag}", f"SELECT {group}, min(row_id) AS first_row FROM {fz} GROUP BY {group}"),
        (f"cand{tag}", f"SELECT DISTINCT chunk_id, rule_key, {labels_of(ds)} FROM {fz}"),
        (
            f"sums{tag}",
            f"SELECT r.chunk_id, r.rule_key, f.cls, sum({match(ds, upto)}) AS deg FROM cand{tag} r"
            f" JOIN {fz} f ON r.chunk_id = f.chunk_id GROUP BY r.chunk_id, r.rule_key, f.cls",
        ),
        (
            f"sup{tag}",
            f"SELECT s.chunk_id, s.rule_key, s.cls, s.first_row, m.deg * c.cost AS support FROM seen{tag} s"
            f" JOIN sums{tag} m USING (chunk_id, rule_key, cls) JOIN cost c USING (cls)",
        ),
    ]


def chunk_rules(ds: Dataset, weight: str = "cf", tag: str = ""):
    """``crules``: one rule per chunk and antecedent, from ``sup``."""
    if weight == "none":
        return [
            (
                f"crules{tag}",
                f"SELECT chunk_id, rule_key, arg_min(cls, first_row) AS cls, 1.0::DOUBLE AS weight"
                f" FROM seen{tag} GROUP BY chunk_id, rule_key",
            )
        ]
    w = "support / t" if weight == "cf" else "(support - (t - support)) / t"
    return [
        (f"tot{tag}", f"SELECT *, sum(support) OVER (PARTITION BY chunk_id, rule_key) AS t FROM sup{tag}"),
        (f"wts{tag}", f"SELECT chunk_id, rule_key, cls, round({w}, 12) AS weight FROM tot{tag} WHERE t > 0"),
        (
            f"best{tag}",
            f"SELECT *, row_number() OVER (PARTITION BY chunk_id, rule_key ORDER BY weight DESC, cls) AS rn"
            f" FROM wts{tag}",
        ),
        (f"crules{tag}", f"SELECT chunk_id, rule_key, cls, weight FROM best{tag} WHERE rn = 1 AND weight > 0"),
    ]


def merged_rules(ds: Dataset, chunks: int = 1, tag: str = ""):
    """``rules``: chunk rule bases merged by mean weight, with labels back."""
    parts = ", ".join(
        f"CAST(split_part(rule_key, '|', {i + 1}) AS INTEGER) AS a{i}" for i in range(len(ds.kinds))
    )
    if chunks == 1:
        return [(f"rules{tag}", f"SELECT rule_key, cls, weight, {parts} FROM crules{tag}")]
    return [
        (f"mean{tag}", f"SELECT rule_key, cls, round(avg(weight), 12) AS weight FROM crules{tag} GROUP BY rule_key, cls"),
        (
            f"mrank{tag}",
            f"SELECT *, row_number() OVER (PARTITION BY rule_key ORDER BY weight DESC, cls) AS rn FROM mean{tag}",
        ),
        (f"rules{tag}", f"SELECT rule_key, cls, weight, {parts} FROM mrank{tag} WHERE rn = 1 AND weight > 0"),
    ]


def model(ds, n_labels=3, weight="cf", cost=True, all_but_last=False, chunks=1):
    return (
        examples(ds)
        + fuzzified(ds, n_labels, chunks)
        + supports(ds, cost, all_but_last)
        + chunk_rules(ds, weight)
        + merged_rules(ds, chunks)
    )


def scored(ds: Dataset, inference: str = "winning_rule", default: str = "0", fz: str = "fz", rules: str = "rules", on: str = "TRUE", rid: str = "row_id", name: str = "pred", carry: str = ""):
    """``pred(row_id, actual, predicted, degree)``."""
    extra = "".join(f", f.{c}" for c in carry.split())
    plain = "".join(f", {c}" for c in carry.split())
    pairs = (
        f"SELECT f.{rid} AS rid{extra}, r.cls AS rc, {match(ds)} * r.weight AS assoc FROM {fz} f JOIN {rules} r ON {on}"
    )
    if inference == "winning_rule":
        votes = f"SELECT rid{plain}, rc, max(assoc) AS v, max(assoc) AS t FROM {name}_pairs GROUP BY rid{plain}, rc"
    else:
        votes = (
            f"SELECT *, floor(v / nullif(max(v) OVER (PARTITION BY rid{plain}), 0) * 1e12::DOUBLE + 0.5::DOUBLE) AS t FROM"
            f" (SELECT rid{plain}, rc, sum(assoc) AS v FROM {name}_pairs GROUP BY rid{plain}, rc)"
        )
    join = "".join(f" AND b.{c} = f.{c}" for c in carry.split())
    return [
        (f"{name}_pairs", pairs),
        (f"{name}_votes", votes),
        (
            f"{name}_best",
            f"SELECT *, row_number() OVER (PARTITION BY rid{plain} ORDER BY t DESC, rc) AS rn"
            f" FROM {name}_votes WHERE t > 0",
        ),
        (
            name,
            f"SELECT f.{rid} AS row_id{extra}, f.cls AS actual, CAST(coalesce(b.rc, {default}) AS INTEGER) AS predicted,"
            f" coalesce(b.v, 0.0) AS degree FROM {fz} f LEFT JOIN {name}_best b ON b.rid = f.{rid}{join} AND b.rn = 1",
        ),
    ]


def matrix(ds: Dataset, by: str = "", source: str = "pred", name: str = "cm"):
    """Dense ``cm(actual, predicted, n)``."""
    cols = "".join(f"{c}, " for c in by.split())
    groups = f"CROSS JOIN (SELECT DISTINCT {cols.rstrip(', ')} FROM {source}) k" if by else ""
    picked = "".join(f"k.{c}, " for c in by.split())
    same = "".join(f" AND p.{c} = k.{c}" for c in by.split())
    k = len(ds.classes)
    return [
        (f"{name}_n", f"SELECT {cols}actual, predicted, count(*) AS n FROM {source} GROUP BY {cols}actual, predicted"),
        (
            name,
            f"SELECT {picked}CAST(a.i AS INTEGER) AS actual, CAST(b.i AS INTEGER) AS predicted,"
            f" CAST(coalesce(p.n, 0) AS BIGINT) AS n FROM range({k}) a(i) CROSS JOIN range({k}) b(i) {groups}"
            f" LEFT JOIN {name}_n p ON p.actual = a.i AND p.predicted = b.i{same}",
        ),
    ]


AUC_COLUMNS = """CAST(tp AS BIGINT) AS tp, CAST(fn AS BIGINT) AS fn, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn,
round((1.0 + tp / nullif(tp + fn, 0)::DOUBLE - fp / nullif(fp + tn, 0)::DOUBLE) / 2.0, 6) AS auc"""


def auc(by: str = "", positive: int = 0, source: str = "cm", name: str = "rates"):
    cols = "".join(f"{c}, " for c in by.split())
    group = f" GROUP BY {', '.join(by.split())}" if by else ""

    def total(cond):
        return f"sum(CASE WHEN {cond} THEN n ELSE 0 END)"

    a, p = f"actual = {positive}", f"predicted = {positive}"
    na, np_ = f"actual <> {positive}", f"predicted <> {positive}"
    return [
        (
            name,
            f"SELECT {cols}{total(f'{a} AND {p}')} AS tp, {total(f'{a} AND {np_}')} AS fn,"
            f" {total(f'{na} AND {p}')} AS fp, {total(f'{na} AND {np_}')} AS tn FROM {source}{group}",
        )
    ]
