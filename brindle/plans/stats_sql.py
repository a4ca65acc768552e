"""DuckDB SQL of p-values: distribution functions by Simpson's rule, exact tails by sums."""

from __future__ import annotations

from brindle.operators.resampling import POISSON


def _simpson(f: str, upper: str, n: int) -> str:
    """The integral of f (of x) from 0 to `upper`."""
    weight = f"CASE WHEN i = 0 OR i = {n} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"(list_sum([({weight}) * ({f.format(x=f'({upper} * i / {n}.0)')}) FOR i IN range({n + 1})]) * {upper} / {3 * n}.0)"


def normal_cdf(z: str) -> str:
    z = f"greatest(-39.0, least(39.0, {z}))"
    return f"(0.5 + sign({z}) * {_simpson('exp(-{x} * {x} / 2) / sqrt(2 * pi())', f'abs({z})', 400)})"


def t_tail(t: str, df: str) -> str:
    """P(T > |t|)."""
    return f"greatest(0.0, 0.5 - {_simpson(f'exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt({df} * pi()) * power(1 + {{x}} * {{x}} / {df}, -({df} + 1) / 2.0)', f'abs({t})', 1000)})"


def t_cdf(t: str, df: str) -> str:
    return f"(CASE WHEN {t} >= 0 THEN 1 - {t_tail(t, df)} ELSE {t_tail(t, df)} END)"


def half_tail(k: str, n: str) -> str:
    """P(X <= k) of n fair coins."""
    return f"list_sum([exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2)) FOR i IN range(CAST({k} AS BIGINT) + 1)])"


def mcnemar(b: str, c: str) -> str:
    x = f"(power(abs({b} - {c}) - 0.5, 2) / ({b} + {c}))"
    return f"CASE WHEN {b} + {c} = 0 THEN 1.0 WHEN {b} + {c} > 20 THEN 2 * (1 - {normal_cdf(f'sqrt({x})')}) ELSE 2 * {half_tail(f'least({b}, {c})', f'({b} + {c})')} END"


#: ways(n, w): how many subsets of the ranks 1 to n have the sum i - 1, at place i.
RANK_SUM_WAYS = "ways AS (SELECT 0 AS n, [CAST(1 AS DOUBLE)] AS w UNION ALL SELECT n + 1, [coalesce(w[i], 0) + CASE WHEN i - n - 1 >= 1 THEN coalesce(w[i - n - 1], 0) ELSE 0 END FOR i IN range(1, (n + 1) * (n + 2) // 2 + 2)] FROM ways WHERE n < 50)"


def signed_ranks(pairs: str, by: str) -> str:
    """CTEs ending in sr(by, n_pairs, n, w_plus, ties)."""
    return f"""sz AS (SELECT {by}, abs(d) AS s, count(*) AS c, count(*) FILTER (WHERE d > 0) AS plus FROM {pairs} WHERE d != 0 GROUP BY ALL),
rk AS (SELECT *, sum(c) OVER (PARTITION BY {by} ORDER BY s) - c + (c + 1) / 2.0 AS r FROM sz),
sr AS (SELECT {by}, a.n_pairs, coalesce(b.n, 0) AS n, coalesce(b.w_plus, 0) AS w_plus, coalesce(b.ties, 0) AS ties FROM (SELECT {by}, count(d) AS n_pairs FROM {pairs} GROUP BY ALL) a LEFT JOIN (SELECT {by}, sum(c) AS n, sum(plus * r) AS w_plus, sum(c * c * c - c) AS ties FROM rk GROUP BY ALL) b USING ({by}))"""


#: CTEs after sr: pw(by, p_wilcoxon).
def wilcoxon(by: str) -> str:
    z = "(least(w_plus, n * (n + 1) / 2.0 - w_plus) - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0)"
    return f"""pw AS (SELECT {by}, CASE WHEN n = 0 THEN 1.0 WHEN exact THEN least(1.0, 2 * list_sum(w[1 : CAST(floor(least(w_plus, n * (n + 1) / 2.0 - w_plus)) AS BIGINT) + 1]) / power(2.0, n)) ELSE least(1.0, 2 * {normal_cdf('z')}) END AS p_wilcoxon
FROM (SELECT {by}, sr.n, w_plus, n_pairs = sr.n AND ties = 0 AND sr.n <= 50 AS exact, ways.w, CASE WHEN sr.n > 0 THEN {z.replace('n *', 'sr.n *').replace('(n +', '(sr.n +').replace('* n +', '* sr.n +')} END AS z FROM sr LEFT JOIN ways ON ways.n = sr.n))"""


def poisson_bootstrap(pairs: str, by: str, item: str, draws: int, seed: int = 42) -> str:
    """CTEs ending in pb(by, n, ci_lo, ci_hi, p_boot)."""
    u = "CAST('0x' || substr(h, {0}, 8) AS BIGINT)"
    k = lambda j: " + ".join(f"CAST({u.format(1 + 8 * j)} >= {t} AS INT)" for t in POISSON)
    keys = ", '|', ".join(by.split(", "))
    four = " UNION ALL ".join(f"SELECT {by}, n, f * 4 + {j} AS r, s{j} / nullif(k{j}, 0) AS m FROM bs" for j in range(4))
    return f"""bh AS (SELECT {by}, d, f, md5(concat('{seed}|', f, '|', {keys}, '|', {item})) AS h FROM (SELECT {by}, {item}, d, unnest(range(0, {-(-draws // 4)})) AS f FROM {pairs} WHERE d IS NOT NULL)),
bw AS (SELECT {by}, f, d, {', '.join(f'{k(j)} AS w{j}' for j in range(4))} FROM bh),
bs AS (SELECT {by}, f, count(*) AS n, {', '.join(f'sum(w{j}) AS k{j}, sum(w{j} * d) AS s{j}' for j in range(4))} FROM bw GROUP BY ALL),
bm AS (SELECT * FROM ({four}) WHERE r < {draws}),
pb AS (SELECT {by}, max(n) AS n, CASE WHEN max(n) >= 3 THEN quantile_cont(m, 0.025) END AS ci_lo, CASE WHEN max(n) >= 3 THEN quantile_cont(m, 0.975) END AS ci_hi,
  CASE WHEN max(n) >= 3 THEN least(1.0, 2 * least(count(*) FILTER (WHERE m <= 0) / count(m), count(*) FILTER (WHERE m >= 0) / count(m))) END AS p_boot FROM bm GROUP BY {by})"""


#: 97.5 % points of Student's t with 1 to 10 degrees of freedom.
T_975 = [12.706204736179, 4.302652729750, 3.182446305284, 2.776445105198, 2.570581835636, 2.446911851145, 2.364624251593, 2.306004135204, 2.262157162798, 2.228138851986]

#: rouge_l and bleu4 of a table tp(r, pred, gold): CTEs ending in rl(r, rouge_l) and bl(r, bleu4).
TEXT_METRICS = r"""
rt AS (SELECT r, regexp_extract_all(lower(coalesce(pred, '')), '[a-z0-9]+') AS p, regexp_extract_all(lower(coalesce(gold, '')), '[a-z0-9]+') AS g FROM tp),
lc AS (SELECT r, 0 AS i, p, g, [0 FOR x IN g] AS row FROM rt UNION ALL
  SELECT r, i + 1, p, g, [list_max([CASE WHEN p[i + 1] = g[k] THEN 1 + CASE WHEN k > 1 THEN row[k - 1] ELSE 0 END ELSE row[k] END FOR k IN range(1, j + 1)]) FOR j IN range(1, len(g) + 1)] FROM lc WHERE i < len(p)),
rl AS (SELECT r, CASE WHEN len(p) = 0 OR len(g) = 0 THEN 0.0 ELSE 2.0 * row[len(g)] / (len(p) + len(g)) END AS rouge_l FROM lc WHERE i = len(p)),
bt AS (SELECT r, list_filter(regexp_split_to_array(coalesce(pred, ''), '\s+'), lambda x: x != '') AS p, list_filter(regexp_split_to_array(coalesce(gold, ''), '\s+'), lambda x: x != '') AS g FROM tp),
bg AS (SELECT r, n, [array_to_string(p[i : i + n - 1], ' ') FOR i IN range(1, len(p) - n + 2)] AS p, [array_to_string(g[i : i + n - 1], ' ') FOR i IN range(1, len(g) - n + 2)] AS g FROM bt, (SELECT unnest([1, 2, 3, 4]) AS n)),
bp AS (SELECT r, n, w, count(*) AS c FROM (SELECT r, n, unnest(p) AS w FROM bg) GROUP BY ALL), bq AS (SELECT r, n, w, count(*) AS c FROM (SELECT r, n, unnest(g) AS w FROM bg) GROUP BY ALL),
bc AS (SELECT r, n, sum(least(bp.c, bq.c)) AS hits FROM bp JOIN bq USING (r, n, w) GROUP BY r, n),
bl AS (SELECT r, CASE WHEN max(np) = 0 OR max(ng) = 0 OR max(hits) FILTER (WHERE n = 1) = 0 THEN 0.0
  ELSE exp(sum(ln(CASE WHEN hits > 0 THEN hits / total ELSE 0.1 / total END)) / 4 + CASE WHEN max(np) > max(ng) THEN 0 ELSE 1 - max(ng) / max(np) END) END AS bleu4
  FROM (SELECT r, n, coalesce(hits, 0) AS hits, greatest(1, len(bg.p)) AS total, len(bt.p) AS np, len(bt.g) AS ng FROM bg JOIN bt USING (r) LEFT JOIN bc USING (r, n)) GROUP BY r)
"""
