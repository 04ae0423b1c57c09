"""The whole rule selection in SQL: one recursive relation of populations.

A row is a chromosome of a chunk in a generation: its active rules as a sorted list, its fitness, and beside it what
the chunk's search keeps: budget, best fitness, threshold and restarts. A step takes the running chunks one generation
on. Everything is spelled out the plain way.
"""

from __future__ import annotations

from ruleloom.catalog.datasets import Dataset
from ruleloom.catalog.oracle import labels_of, match, model, sql
from ruleloom.operators.selection import BITS_PER_GENE, MAX_RESETS


def _digest(seed: int, generation: str, *parts: str) -> str:
    return f"md5(concat_ws('|', {', '.join([str(seed), f'CAST({generation} AS VARCHAR)', *parts])}))"


def _fit(candidates: str, alpha: float) -> str:
    """Fitness of candidates (chunk_id, chrom_id, act) by the first active rule of every ranking."""
    return f"""
      SELECT t.chunk_id, t.chrom_id, t.act,
        round((1.0::DOUBLE + coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) - coalesce(fp / nullif(fp + tn, 0)::DOUBLE, 0)) / 2 * {alpha}::DOUBLE
          + (n_rules - len(act)) / n_rules::DOUBLE * (1.0::DOUBLE - {alpha}::DOUBLE), 12) AS fitness
      FROM (
        SELECT chunk_id, chrom_id, act,
          coalesce(sum(n) FILTER (actual = 0 AND said = 0), 0) AS tp, coalesce(sum(n) FILTER (actual = 0 AND said <> 0), 0) AS fn,
          coalesce(sum(n) FILTER (actual <> 0 AND said = 0), 0) AS fp, coalesce(sum(n) FILTER (actual <> 0 AND said <> 0), 0) AS tn
        FROM (
          SELECT c.chunk_id, c.chrom_id, c.act, k.actual, k.n,
            coalesce(list_filter(k.ranking, lambda r: list_contains(c.act, r.rule_key))[1].rc, 0) AS said
          FROM ({candidates}) c JOIN ranked k ON k.chunk_id = c.chunk_id
        ) GROUP BY chunk_id, chrom_id, act
      ) t JOIN sizes z ON z.chunk_id = t.chunk_id"""


def search(ds: Dataset, pop: int, seed: int, evaluations: int, chunks: int = 1, alpha: float = 0.7):
    """CTEs up to ``states``: every chromosome of every generation."""
    base = model(ds, chunks=chunks) + [
        ("lr", f"SELECT r.*, {labels_of(ds, 'k.')} FROM crules r JOIN cand k USING (chunk_id, rule_key)"),
        (
            "hits",
            f"SELECT f.chunk_id, f.row_id, f.cls AS actual, r.rule_key, r.cls AS rc, {match(ds)} * r.weight AS assoc"
            f" FROM fz f LEFT JOIN lr r ON f.chunk_id = r.chunk_id",
        ),
        (
            "ranked",
            "SELECT chunk_id, actual, ranking, count(*) AS n FROM (SELECT chunk_id, row_id, actual,"
            " coalesce(list({'rc': rc, 'rule_key': rule_key} ORDER BY assoc DESC, rc, rule_key) FILTER (assoc > 0), []) AS ranking"
            " FROM hits GROUP BY chunk_id, row_id, actual) GROUP BY ALL",
        ),
        ("sizes", "SELECT chunk_id, count(*) AS n_rules FROM crules GROUP BY chunk_id"),
    ]
    coin = f"c.i = 0 OR {_digest(seed, '0', 'r.chunk_id', 'c.i', 'r.rule_key')} < '8'"
    first = f"""SELECT r.chunk_id, CAST(c.i AS INTEGER) AS chrom_id,
      coalesce(list(r.rule_key ORDER BY r.rule_key) FILTER ({coin}), []) AS act
      FROM crules r CROSS JOIN range({pop}) c(i) GROUP BY 1, 2"""
    start = f"""SELECT 0 AS gen, f.chunk_id, f.chrom_id, f.act, f.fitness, {evaluations - pop} AS budget,
      max(f.fitness) OVER (PARTITION BY f.chunk_id) AS best, z.n_rules * {BITS_PER_GENE} / 4.0::DOUBLE AS threshold, 0 AS resets, {pop} AS fresh
      FROM ({_fit(first, alpha)}) f JOIN sizes z USING (chunk_id)"""
    gen = "s.gen + 1"
    # Parents in pairs, pairs with their rules, children as lists.
    step = f"""
    WITH s AS (SELECT * FROM states WHERE budget > 0 AND best < 1.0 AND resets < {MAX_RESETS}),
    o AS (
      SELECT s.*, row_number() OVER (PARTITION BY chunk_id ORDER BY {_digest(seed, gen, "'pair'", 'chunk_id', 'chrom_id')}, chrom_id) - 1 AS ix,
        count(*) OVER (PARTITION BY chunk_id) AS m FROM s
    ),
    pairs AS (
      SELECT a.chunk_id, a.gen, a.ix // 2 AS pair, a.act AS mom, b.act AS dad FROM o a JOIN o b ON a.chunk_id = b.chunk_id AND b.ix = a.ix + 1
      WHERE a.ix % 2 = 0
    ),
    genes AS (
      SELECT s.chunk_id, s.pair, r.rule_key, list_contains(s.mom, r.rule_key) AS mom, list_contains(s.dad, r.rule_key) AS dad,
        {_digest(seed, gen, "'hux'", 's.chunk_id', 's.pair', 'r.rule_key')} AS digest
      FROM pairs s JOIN crules r ON r.chunk_id = s.chunk_id
    ),
    swaps AS (
      SELECT *, mom <> dad AND row_number() OVER (PARTITION BY chunk_id, pair, mom <> dad ORDER BY digest, rule_key)
        <= greatest(1, count(*) OVER (PARTITION BY chunk_id, pair, mom <> dad) // 2) AS swap FROM genes
    ),
    kids AS (
      SELECT chunk_id, CAST({pop} + 2 * pair + k.i AS INTEGER) AS chrom_id,
        coalesce(list(rule_key ORDER BY rule_key) FILTER (CASE WHEN (k.i = 0) = swap THEN dad ELSE mom END), []) AS act
      FROM swaps CROSS JOIN range(2) k(i) GROUP BY 1, 2
    ),
    fresh AS (
      SELECT chunk_id, min(chrom_id) AS chrom_id, act FROM kids
      WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.chunk_id = kids.chunk_id AND s.act = kids.act) GROUP BY chunk_id, act
    ),
    facts AS (
      SELECT s.chunk_id, any_value(s.gen) AS gen, any_value(s.budget) AS budget, any_value(s.best) AS best, any_value(s.threshold) AS threshold,
        any_value(s.resets) AS resets, count(DISTINCT s.act) AS kinds, (SELECT count(*) FROM fresh f WHERE f.chunk_id = s.chunk_id) AS n
      FROM s GROUP BY s.chunk_id
    ),
    turn AS (
      SELECT *, n = 0 AND (kinds = 1 OR threshold - {BITS_PER_GENE} < 0) AS again FROM facts
    ),
    drawn AS (
      SELECT s.chunk_id, CAST(c.i AS INTEGER) AS chrom_id,
        coalesce(list(r.rule_key ORDER BY r.rule_key) FILTER ({_digest(seed, gen, 'r.chunk_id', 'c.i', 'r.rule_key')} < '8'), []) AS act
      FROM turn s JOIN crules r ON r.chunk_id = s.chunk_id CROSS JOIN range(1, {pop}) c(i) WHERE s.again GROUP BY 1, 2
    ),
    scored AS ({_fit("SELECT * FROM fresh UNION ALL SELECT * FROM drawn", alpha)}),
    old AS (
      SELECT s.chunk_id, s.chrom_id, s.act, s.fitness, t.again,
        row_number() OVER (PARTITION BY s.chunk_id ORDER BY s.fitness DESC, s.chrom_id) AS place FROM s JOIN turn t USING (chunk_id)
    ),
    every AS (
      SELECT chunk_id, CASE WHEN again THEN 0 ELSE chrom_id END AS chrom_id, act, fitness FROM old WHERE NOT again OR place = 1
      UNION ALL SELECT chunk_id, chrom_id, act, fitness FROM scored
    ),
    placed AS (
      SELECT e.*, t.again, row_number() OVER (PARTITION BY e.chunk_id ORDER BY e.fitness DESC, e.chrom_id) - 1 AS place
      FROM every e JOIN turn t USING (chunk_id)
    ),
    gained AS (SELECT chunk_id, max(fitness) AS f, count(*) AS tried FROM scored GROUP BY chunk_id)
    SELECT t.gen + 1, p.chunk_id, CAST(CASE WHEN t.n = 0 THEN p.chrom_id ELSE p.place END AS INTEGER), p.act, p.fitness,
      t.budget - coalesce(g.tried, 0),
      greatest(t.best, coalesce(g.f, t.best)),
      CASE WHEN t.again THEN z.n_rules * {BITS_PER_GENE} / 4.0::DOUBLE WHEN t.n = 0 THEN t.threshold - {BITS_PER_GENE} ELSE t.threshold END,
      CASE WHEN coalesce(g.f > t.best, FALSE) THEN 0 WHEN t.again THEN t.resets + 1 ELSE t.resets END,
      t.n
    FROM placed p JOIN turn t USING (chunk_id) JOIN sizes z USING (chunk_id) LEFT JOIN gained g USING (chunk_id)
    WHERE t.again OR p.place < {pop}"""
    return base + [("states", f"{start}\nUNION ALL (\n{step}\n)")]


def recursive(ctes, final: str) -> str:
    return sql(ctes, final).replace("WITH ", "WITH RECURSIVE ", 1)


LAST = "SELECT s.* FROM states s JOIN (SELECT chunk_id, max(gen) AS gen FROM states GROUP BY chunk_id) USING (chunk_id, gen)"
HISTORY = """SELECT CAST(gen AS INTEGER) AS generation, chunk_id, round(any_value(best), 6) AS best, CAST(any_value(fresh) AS INTEGER) AS new,
CAST(any_value(budget) AS INTEGER) AS budget, CAST(any_value(resets) AS INTEGER) AS resets FROM states GROUP BY gen, chunk_id"""


def pruned_rules(chunks: int):
    """CTEs behind ``states``: the rules of every chunk's best chromosome, merged over the chunks."""
    kept = [
        ("last", LAST),
        ("best1", "SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY fitness DESC, chrom_id) AS place FROM last"),
        (
            "kept",
            "SELECT r.* FROM crules r JOIN best1 b ON b.chunk_id = r.chunk_id AND b.place = 1 AND list_contains(b.act, r.rule_key)",
        ),
    ]
    if chunks == 1:
        return kept + [("pruned", "SELECT rule_key, cls, weight FROM kept")]
    return kept + [
        ("kmean", "SELECT rule_key, cls, round(avg(weight), 12) AS weight FROM kept GROUP BY rule_key, cls"),
        ("krank", "SELECT *, row_number() OVER (PARTITION BY rule_key ORDER BY weight DESC, cls) AS rn FROM kmean"),
        ("pruned", "SELECT rule_key, cls, weight FROM krank WHERE rn = 1 AND weight > 0"),
    ]


PRUNED = "SELECT rule_key, cls AS class_idx, round(weight, 6) AS weight FROM pruned"
