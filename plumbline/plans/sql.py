"""SQL text for what several queries compare themselves with."""

from __future__ import annotations

from plumbline.functions.draws import poisson_sql


def ridge_sql(name: str, rows: str, keys: str, features: list[str], y: str, alpha: float = 1.0, standardise: bool = True) -> str:
    """CTE ``name``: by keys the ridge model of y on the features: my, and for feature i its mean m{i} and weight w{i}.

    The normal equations are solved by elimination, one step a CTE.
    """
    p = range(len(features))
    sums = [f"avg({f}) AS m{i}" for i, f in enumerate(features)] + [f"avg({features[i]} * {features[j]}) AS p{i}_{j}" for i in p for j in p if j >= i]
    sums += [f"avg({f} * {y}) AS y{i}" for i, f in enumerate(features)]
    scale = [f"sqrt(greatest(p{i}_{i} - m{i} * m{i}, 0)) + 1e-8 AS s{i}" if standardise else f"1.0 AS s{i}" for i in p]
    pair = lambda i, j: f"p{min(i, j)}_{max(i, j)}"
    cells = [f"({pair(i, j)} - m{i} * m{j}) / (s{i} * s{j}) * n" + (f" + {alpha}" if i == j else "") + f" AS a{i}_{j}" for i in p for j in p]
    cells += [f"(y{i} - m{i} * my) / s{i} * n AS b{i}" for i in p]
    kept = ", ".join([keys, "my", *(f"m{i}" for i in p), *(f"s{i}" for i in p)])
    out = [
        f"{name}_s AS (SELECT {keys}, count(*) AS n, avg({y}) AS my, {', '.join(sums)} FROM {rows} GROUP BY ALL)",
        f"{name}_c AS (SELECT *, {', '.join(scale)} FROM {name}_s)",
        f"{name}_0 AS (SELECT {kept}, {', '.join(cells)} FROM {name}_c)",
    ]
    for k in p:
        step = [f"a{i}_{j} - a{i}_{k} * a{k}_{j} / a{k}_{k} AS a{i}_{j}" if i != k else f"a{k}_{j} / a{k}_{k} AS a{k}_{j}" for i in p for j in p]
        step += [f"b{i} - a{i}_{k} * b{k} / a{k}_{k} AS b{i}" if i != k else f"b{k} / a{k}_{k} AS b{k}" for i in p]
        out.append(f"{name}_{k + 1} AS (SELECT {kept}, {', '.join(step)} FROM {name}_{k})")
    out.append(f"{name} AS (SELECT {keys}, my, {', '.join([*(f'm{i}' for i in p), *(f'b{i} / s{i} AS w{i}' for i in p)])} FROM {name}_{len(features)})")
    return ", ".join(out)


def logistic_sql(name: str, rows: str, key: str, features: list[str], label: str, alpha: float, steps: int = 8, weight: str = "1.0") -> str:
    """CTE ``name``: the rows of ``rows`` that have a model, with pred, from the logistic model of the rows of the same key and another fold.

    Newton steps on sums, as in ``cross_fit_logistic``; each step's system is solved by elimination, one unknown a CTE.
    """
    p = range(len(features))
    dims = range(len(features) + 1)
    stats = ", ".join([f"sum({weight}) AS n", *(f"sum({weight} * {f}) / sum({weight}) AS m{i}, sum({weight} * {f} * {f}) / sum({weight}) AS e{i}" for i, f in enumerate(features))])
    held = ", ".join([*(f"m{i}" for i in p), *(f"s{i}" for i in p)])
    out = [
        f"{name}_k AS MATERIALIZED (SELECT DISTINCT {key}, fold AS f FROM {rows})",
        f"{name}_s AS MATERIALIZED (SELECT {key}, f, {stats} FROM {rows} JOIN {name}_k USING ({key}) WHERE fold <> f GROUP BY ALL)",
        f"{name}_t0 AS MATERIALIZED (SELECT {key}, f, {', '.join([*(f'm{i}' for i in p), *(f'sqrt(greatest(e{i} - m{i} * m{i}, 0)) + 1e-8 AS s{i}' for i in p), *(f'CAST(0 AS DOUBLE) AS t{i}' for i in dims)])} FROM {name}_s)",
    ]
    dot = " + ".join(["t0", *(f"t{i + 1} * (({f} - m{i}) / s{i})" for i, f in enumerate(features))])
    z = ["1.0", *(f"(({f} - m{i}) / s{i})" for i, f in enumerate(features))]
    for step in range(steps):
        own = f"{name}_{step}"
        sums = [f"sum(w * ({label} - pr) * {z[i]}) / sum(w)" + (f" - {alpha} * any_value(t{i})" if i else "") + f" AS b{i}" for i in dims]
        sums += [f"sum(w * pr * (1 - pr) * {z[i]} * {z[j]}) / sum(w)" + (f" + {alpha if i else 0.0} + 1e-9" if i == j else "") + f" AS a{i}_{j}" for i in dims for j in dims]
        thetas = ", ".join(f"any_value(t{i}) AS t{i}" for i in dims)
        out.append(f"{own}_p AS MATERIALIZED (SELECT r.*, {held}, f, {', '.join(f't{i}' for i in dims)}, CAST({weight} AS DOUBLE) AS w, 1 / (1 + exp(-({dot}))) AS pr FROM {rows} r JOIN {name}_t{step} USING ({key}) WHERE fold <> f)")
        out.append(f"{own}_0 AS MATERIALIZED (SELECT {key}, f, {', '.join(f'any_value({c}) AS {c}' for c in held.split(', '))}, {thetas}, {', '.join(sums)} FROM {own}_p GROUP BY {key}, f)")
        kept = f"{key}, f, {held}, " + ", ".join(f"t{i}" for i in dims)
        for k in dims:
            cells = [f"a{i}_{j} - a{i}_{k} * a{k}_{j} / a{k}_{k} AS a{i}_{j}" if i != k else f"a{k}_{j} / a{k}_{k} AS a{k}_{j}" for i in dims for j in dims]
            cells += [f"b{i} - a{i}_{k} * b{k} / a{k}_{k} AS b{i}" if i != k else f"b{k} / a{k}_{k} AS b{k}" for i in dims]
            out.append(f"{own}_{k + 1} AS MATERIALIZED (SELECT {kept}, {', '.join(cells)} FROM {own}_{k})")
        out.append(f"{name}_t{step + 1} AS MATERIALIZED (SELECT {key}, f, {held}, {', '.join(f't{i} + b{i} AS t{i}' for i in dims)} FROM {own}_{len(features) + 1})")
    out.append(f"{name} AS MATERIALIZED (SELECT r.*, 1 / (1 + exp(-({dot}))) AS pred FROM {rows} r JOIN {name}_t{steps} t ON r.{key} = t.{key} AND r.fold = t.f)")
    return ", ".join(out)


def auc_sql(rows: str, keys: str, label: str, score: str) -> str:
    """A query: keys and auc, ties counting half, of the groups that have both classes."""
    ranks = f"SELECT {keys}, {label} AS y, rank() OVER (PARTITION BY {keys} ORDER BY {score}) + (count(*) OVER (PARTITION BY {keys}, {score}) - 1) / 2.0 AS rk FROM {rows}"
    won = "sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0"
    return f"SELECT {keys}, ({won}) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0) AS auc FROM ({ranks}) GROUP BY ALL"


def median_interval_sql(name: str, rows: str, keys: str, unit: str, values: list[str], statistic: str, seed: int, replicates: int = 2000) -> str:
    """CTE ``name``: keys (may be empty), lo and hi of a statistic of the redrawn medians m0, m1, ...; as ``median_interval``."""
    k = f"{keys}, " if keys else ""
    count = poisson_sql("u", "b", seed)
    key = f"CAST('0x' || substr(md5(CAST({unit} AS VARCHAR)), 1, 12) AS BIGINT)"
    out = [f"{name}_d AS MATERIALIZED (SELECT *, {count} AS c FROM (SELECT {k}{key} AS u, {', '.join(values)}, unnest(range(1, {replicates + 1})) AS b FROM {rows}))"]
    for i, v in enumerate(values):
        over = f"PARTITION BY {k}b"
        out.append(f"{name}_c{i} AS (SELECT {k}b, {v} AS v, c, sum(c) OVER ({over} ORDER BY {v} ROWS UNBOUNDED PRECEDING) AS e, sum(c) OVER ({over}) AS t FROM {name}_d WHERE c > 0 AND {v} IS NOT NULL)")
        at = lambda h: f"max(v) FILTER (e - c <= {h}((t - 1) / 2) AND {h}((t - 1) / 2) < e)"
        out.append(f"{name}_m{i} AS (SELECT {k}b, ({at('floor')} + {at('ceil')}) / 2 AS m{i} FROM {name}_c{i} GROUP BY ALL)")
    joined = " ".join([f"{name}_m0", *(f"JOIN {name}_m{i} USING ({k}b)" for i in range(1, len(values)))])
    group = f"GROUP BY {keys}" if keys else ""
    out.append(f"{name} AS (SELECT {k}quantile_cont(s, 0.025) AS lo, quantile_cont(s, 0.975) AS hi FROM (SELECT {k}{statistic} AS s FROM {joined}) {group})")
    return ", ".join(out)
