"""Plain-Python learning and scoring: rows times rules, nothing clever."""


def sets(lo, hi, n):
    h = (hi - lo) / (n - 1)
    out = []
    for k in range(n):
        left, mid, right = lo + h * (k - 1), lo + h * k, lo + h * (k + 1)
        out.append((mid if k == 0 else left, mid, mid if k == n - 1 else right))
    return out


def degree(x, tri):
    left, mid, right = tri
    if left <= x <= mid:
        return 1.0 if left == x == mid else (x - left) / (mid - left)
    if mid <= x <= right:
        return 1.0 if mid == x == right else (right - x) / (right - mid)
    return 0.0


def label(var, x, n):
    if not var.is_numeric:
        return var.values.index(x) if x in var.values else -1
    mids = [t[1] for t in sets(var.lower, var.upper, n)]
    for k in range(n - 1):
        if x < mids[k + 1] - (mids[k + 1] - mids[k]) / 2:
            return k
    return n - 1


def match(schema, row, rule, upto=None):
    out = 1.0
    for v, x, a in list(zip(schema.variables, row, rule))[:upto]:
        if v.is_numeric:
            out *= degree(x, sets(v.lower, v.upper, schema.n_labels)[a])
        else:
            out *= 1.0 if x in v.values and v.values.index(x) == a else 0.0
    return out


def learn(schema, rows, weight="cf", cost=True, all_but_last=False):
    """``rows``: (features, class index). Returns {rule: (class, weight)}."""
    n = schema.n_labels
    costs = schema.class_costs(cost)
    seen = {}
    for xs, c in rows:
        key = tuple(label(v, x, n) for v, x in zip(schema.variables, xs))
        classes = seen.setdefault(key, [])
        if c not in classes:
            classes.append(c)
    rules = {}
    for key, classes in seen.items():
        if weight == "none":
            rules[key] = (classes[0], 1.0)
            continue
        upto = len(key) - 1 if all_but_last else None
        m = {c: sum(match(schema, xs, key, upto) * costs[k] for xs, k in rows if k == c) for c in classes}
        total = sum(m.values())
        if not total > 0:
            continue
        w = {c: round((v if weight == "cf" else v - (total - v)) / total, 12) for c, v in m.items()}
        best = max(w, key=lambda c: (w[c], -c))
        if w[best] > 0:
            rules[key] = (best, w[best])
    return rules


def merge(bases):
    sums = {}
    for base in bases:
        for key, (c, w) in base.items():
            sums.setdefault(key, {}).setdefault(c, []).append(w)
    out = {}
    for key, by_class in sums.items():
        mean = {c: round(sum(ws) / len(ws), 12) for c, ws in by_class.items()}
        best = max(mean, key=lambda c: (mean[c], -c))
        out[key] = (best, mean[best])
    return out


def predict(schema, rules, xs, inference="winning_rule", default=0):
    votes = [0.0] * len(schema.classes)
    for key, (c, w) in rules.items():
        a = match(schema, xs, key) * w
        votes[c] = max(votes[c], a) if inference == "winning_rule" else votes[c] + a
    if inference == "additive":
        ticks = [int(v * 1e12 + 0.5) for v in votes]
        best = max(range(len(votes)), key=lambda c: (ticks[c], -c))
        return best if ticks[best] > 0 else default
    best = max(range(len(votes)), key=lambda c: (votes[c], -c))
    return best if votes[best] > 0 else default
