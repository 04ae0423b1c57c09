"""Learning, inference and selection parameters, checked when they are built."""

from __future__ import annotations

from dataclasses import dataclass

# The spellings of the two choices that parameter files use.
INFERENCE_NAMES = {
    "wr": "winning_rule",
    "winningrule": "winning_rule",
    "winning_rule": "winning_rule",
    "additive": "additive",
    "additive_combination": "additive",
}
RULE_WEIGHT_NAMES = {
    "none": "none",
    "noweights": "none",
    "no_weights": "none",
    "cf": "cf",
    "certaintyfactor": "cf",
    "certainty_factor": "cf",
    "pcf": "pcf",
}


def _choice(name, value, allowed):
    if value not in allowed:
        raise ValueError(f"{name} must be one of {sorted(allowed)}, got {value!r}")
    return value


@dataclass(frozen=True)
class Params:
    """Everything a learning or scoring run can be told.

    The defaults are the documented ones: three labels, cost-sensitive
    weights, a population of 50 and rule selection switched off.

    ``broadcast_bytes`` bounds every broadcast table; beyond it joins are
    shuffled with rows spread over ``salt_buckets``. ``row_partitions`` spreads
    the rows of tables with many numeric features (round robin) before they meet
    the rules, for inputs with fewer splits than cores. ``assign`` says how row
    ids give chunks and folds, see :func:`ruleloom.operators.encode.assigned`.
    """

    n_labels: int = 3
    rule_weight: str = "pcf"
    inference: str = "winning_rule"
    cost_sensitive: bool = True
    weight_features: str = "all"
    default_class: str = "first"
    n_chunks: int = 1
    pop_size: int = 50
    n_evaluations: int = 0
    alpha: float = 0.7
    seed: int = 10000
    n_folds: int = 0
    bad_rows: str = "error"
    broadcast_bytes: int = 64 * 1024 * 1024
    salt_buckets: int = 16
    row_partitions: int | None = None
    assign: str = "id"

    def __post_init__(self):
        weight = RULE_WEIGHT_NAMES.get(str(self.rule_weight).lower())
        inference = INFERENCE_NAMES.get(str(self.inference).lower())
        if weight is None:
            raise ValueError(f"unknown rule_weight {self.rule_weight!r}")
        if inference is None:
            raise ValueError(f"unknown inference {self.inference!r}")
        object.__setattr__(self, "rule_weight", weight)
        object.__setattr__(self, "inference", inference)
        _choice("weight_features", self.weight_features, {"all", "all_but_last"})
        _choice("default_class", self.default_class, {"first", "most_frequent"})
        _choice("bad_rows", self.bad_rows, {"error", "drop"})
        _choice("assign", self.assign, {"id", "digest"})
        if self.n_labels < 2:
            raise ValueError("n_labels must be at least 2")
        if self.n_chunks < 1:
            raise ValueError("n_chunks must be at least 1")
        if self.pop_size < 2:
            raise ValueError("pop_size must be at least 2")
        if self.n_evaluations < 0:
            raise ValueError("n_evaluations must not be negative")
        if not 0.0 <= self.alpha <= 1.0:
            raise ValueError("alpha must lie in [0, 1]")
        if self.n_folds < 0 or self.n_folds == 1:
            raise ValueError("n_folds must be 0 (off) or at least 2")
        if self.salt_buckets < 1:
            raise ValueError("salt_buckets must be at least 1")
