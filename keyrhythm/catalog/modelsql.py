"""SQL forms of the classifiers that SQL can state, for the checks of model queries.

All read a relation ``cases(held, key, label, test, x0, x1, ...)``: the rows of each round of holding
out, of which those with ``test`` are predicted by a model of those without. Each gives a relation
(held, key, label, class, score) whose highest score is the prediction, the smallest class on a tie.
"""

from __future__ import annotations

from collections.abc import Sequence


def cases(rows: str, key: str, columns: Sequence[str], how: str) -> str:
    """CTEs up to ``cases``. ``how``: ``all`` (train and test on all rows), ``blocks:k``, ``dealt:k`` or ``split:share``."""
    told = ", ".join(f"CAST({c} AS DOUBLE) AS x{i}" for i, c in enumerate(columns))
    base = f"_rows AS (SELECT {key} AS key, label, {told} FROM ({rows}))"
    kind, _, number = how.partition(":")
    if kind == "all":
        return f"{base}, cases AS (SELECT 0 AS held, *, t.test FROM _rows CROSS JOIN (VALUES (false), (true)) t(test))"
    if kind == "split":
        place = "row_number() OVER (PARTITION BY label ORDER BY md5('0:' || CAST(key AS VARCHAR)), key)"
        return f"{base}, cases AS (SELECT 0 AS held, *, {place} <= floor(count(*) OVER (PARTITION BY label) * {number} + 0.5) AS test FROM _rows)"
    if kind == "blocks":
        fold = (f"CASE WHEN place < longer * (n + 1) THEN place // (n + 1) ELSE longer + (place - longer * (n + 1)) // n END FROM "
                f"(SELECT *, row_number() OVER (ORDER BY key) - 1 AS place, count(*) OVER () // {number} AS n, count(*) OVER () % {number} AS longer FROM _rows)")
    else:
        fold = f"(row_number() OVER (PARTITION BY label ORDER BY key) - 1) % {number} FROM _rows"
    plain = ", ".join(f"x{i}" for i in range(len(columns)))
    return f"""{base}, _folds AS (SELECT key, label, {plain}, {fold.replace(' FROM ', ' AS fold FROM ', 1)}),
cases AS (SELECT h.held, key, label, {plain}, fold = h.held AS test FROM _folds CROSS JOIN (SELECT DISTINCT fold AS held FROM _folds) h)"""


def bayes(width: int) -> str:
    """Gaussian naive Bayes as the CTE ``bayes``."""
    unfolded = " UNION ALL ".join(f"SELECT held, key, label, test, {i} AS j, x{i} AS x FROM cases" for i in range(width))
    return f"""_u AS ({unfolded}),
_slack AS (SELECT held, max(v) * 1e-9 AS e FROM (SELECT held, j, var_pop(x) AS v FROM _u WHERE NOT test GROUP BY held, j) GROUP BY held),
_stats AS (SELECT held, label AS class, j, avg(x) AS m, var_pop(x) + any_value(e) AS v FROM _u JOIN _slack USING (held) WHERE NOT test GROUP BY held, label, j),
_prior AS (SELECT held, label AS class, ln(count(*) / sum(count(*)) OVER (PARTITION BY held)) AS p FROM cases WHERE NOT test GROUP BY held, label),
bayes AS (SELECT u.held, key, label, s.class, sum(-0.5 * ln(2 * pi() * v) - (x - m) * (x - m) / (2 * v)) + any_value(p) AS score
          FROM _u u JOIN _stats s ON u.held = s.held AND u.j = s.j JOIN _prior p ON p.held = s.held AND p.class = s.class
          WHERE test GROUP BY u.held, key, label, s.class)"""


def discriminant() -> str:
    """Quadratic discriminant on two features as the CTE ``discriminant``."""
    return """_s AS (SELECT held, label AS class, avg(x0) AS ma, avg(x1) AS mb, var_samp(x0) AS aa, var_samp(x1) AS bb, covar_samp(x0, x1) AS ab,
        count(*) / sum(count(*)) OVER (PARTITION BY held) AS share FROM cases WHERE NOT test GROUP BY held, label),
discriminant AS (SELECT c.held, key, label, class, ln(share) - 0.5 * ln(aa * bb - ab * ab)
        - 0.5 * (bb * (x0 - ma) * (x0 - ma) - 2 * ab * (x0 - ma) * (x1 - mb) + aa * (x1 - mb) * (x1 - mb)) / (aa * bb - ab * ab) AS score
        FROM cases c JOIN _s s USING (held) WHERE test)"""


def neighbours(width: int, k: int = 5) -> str:
    """k nearest neighbours as the CTE ``neighbours``; the score is the share of votes."""
    away = " + ".join(f"(q.x{i} - t.x{i}) * (q.x{i} - t.x{i})" for i in range(width))
    return f"""_near AS (SELECT q.held, q.key, q.label, t.label AS class, row_number() OVER (PARTITION BY q.held, q.key ORDER BY {away}, t.key) AS place
        FROM cases q JOIN cases t ON q.held = t.held AND q.test AND NOT t.test),
_classes AS (SELECT DISTINCT label AS class FROM cases),
neighbours AS (SELECT held, key, label, c.class, count(*) FILTER (WHERE n.class = c.class) / count(*) AS score
        FROM _near n CROSS JOIN _classes c WHERE place <= {k} GROUP BY held, key, label, c.class)"""


def probabilities(relation: str) -> str:
    """The scores of a log-likelihood relation as probabilities: (held, key, label, class, p)."""
    top = "PARTITION BY held, key"
    return f"""SELECT held, key, label, class, e / sum(e) OVER ({top}) AS p
FROM (SELECT *, exp(score - max(score) OVER ({top})) AS e FROM {relation})"""


def predicted(relation: str) -> str:
    """(held, key, label, prediction) of a relation with scores."""
    return f"""SELECT held, key, label, class AS prediction FROM {relation}
QUALIFY row_number() OVER (PARTITION BY held, key ORDER BY score DESC, class) = 1"""


def stumps(rounds: int, rate: float, width: int) -> str:
    """Boosted stumps of two classes on features with few values, trained and told on ``cases`` with ``all``: the CTE ``boosted``.

    A stump cuts between two neighbouring values, where the weighted Gini impurity falls most.
    """
    unfolded = " UNION ALL ".join(f"SELECT key, label, {i} AS j, x{i} AS x FROM cases WHERE NOT test" for i in range(width))
    out = f"""_v AS ({unfolded}),
_cuts AS (SELECT j, (x + lead(x) OVER (PARTITION BY j ORDER BY x)) / 2 AS cut FROM (SELECT DISTINCT j, x FROM _v)),
_w0 AS (SELECT key, label, 1.0 / count(*) OVER () AS w, 0.0 AS d FROM cases WHERE NOT test)"""
    least = "2.220446049250313e-16"
    for r in range(rounds):
        out += f""",
_c{r} AS (SELECT v.j, cut, sum(w) FILTER (WHERE x <= cut AND v.label = 0) AS l0, sum(w) FILTER (WHERE x <= cut AND v.label = 1) AS l1,
         sum(w) FILTER (WHERE x > cut AND v.label = 0) AS r0, sum(w) FILTER (WHERE x > cut AND v.label = 1) AS r1
         FROM _v v JOIN _cuts c ON v.j = c.j AND cut IS NOT NULL JOIN _w{r} w ON w.key = v.key GROUP BY v.j, cut),
_z{r} AS (SELECT j, cut, coalesce(l0, 0) AS l0, coalesce(l1, 0) AS l1, coalesce(r0, 0) AS r0, coalesce(r1, 0) AS r1 FROM _c{r}),
_b{r} AS (SELECT *, l1 / (l0 + l1) AS pl, r1 / (r0 + r1) AS pr FROM _z{r}
         ORDER BY round((l0 * l0 + l1 * l1) / (l0 + l1) + (r0 * r0 + r1 * r1) / (r0 + r1), 12) DESC, j, cut LIMIT 1),
_p{r} AS (SELECT key, CASE WHEN x <= cut THEN pl ELSE pr END AS p FROM _v JOIN _b{r} USING (j)),
_d{r} AS (SELECT key, label, w, d + ln(greatest(p, {least})) - ln(greatest(1 - p, {least})) AS d, ln(greatest(p, {least})) - ln(greatest(1 - p, {least})) AS own
         FROM _w{r} JOIN _p{r} USING (key)),
_w{r + 1} AS (SELECT key, label, w * f / sum(w * f) OVER () AS w, d FROM (SELECT *, exp(-{rate} * 0.5 * CASE WHEN label = 1 THEN own ELSE -own END) AS f FROM _d{r}))"""
    return out + f""",
boosted AS (SELECT 0 AS held, key, label, c.class, CASE WHEN c.class = 1 THEN d ELSE -d END AS score
           FROM _w{rounds} CROSS JOIN (VALUES (0), (1)) c(class))"""


def auc(relation: str, groups: str) -> str:
    """Area under the ROC curve of (groups, score, hit) rows by the mean rank of the hits."""
    return f"""SELECT {groups}, (sum(place) FILTER (WHERE hit) - count(*) FILTER (WHERE hit) * (count(*) FILTER (WHERE hit) + 1) / 2)
       / (count(*) FILTER (WHERE hit) * count(*) FILTER (WHERE NOT hit)) AS auc
FROM (SELECT *, rank() OVER (PARTITION BY {groups} ORDER BY score) + (count(*) OVER (PARTITION BY {groups}, score) - 1) / 2 AS place FROM {relation})
GROUP BY {groups}"""
