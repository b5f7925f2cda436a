"""Independent SQL (DuckDB dialect) for every SQL-checkable query.

These strings are written directly from the operator definitions, not
generated from the Spark plans, so a match is real evidence.  Shared input
recipes are CTE fragments; ``ols_ctes`` writes a Gauss-Jordan solve of the
normal equations as a recursive CTE over list-of-lists, so multi-feature
linear models are checkable in plain SQL too.
"""

from __future__ import annotations

from ..sources.fixtures import (COURSES, EXAM_COLUMNS, OUTCOME_THRESHOLD, PRIORITY_COLUMNS,
                                SCORE_COLUMNS)

T = float(OUTCOME_THRESHOLD)


def r(x: str, d: int = 6) -> str:
    return f"round({x}, {d})"


def rev(x: str, d: int) -> str:
    """numpy-style half-even rounding of the binary value."""
    return f"(round_even(({x}) * {10.0 ** d}, 0) / {10.0 ** d})"


def md5_bucket(key: str, modulus: int, salt: str | None = None) -> str:
    text = f"{key}::VARCHAR" if salt is None else f"('{salt}-' || {key}::VARCHAR)"
    return f"((('0x' || substr(md5({text}), 1, 8))::UBIGINT % {modulus})::INTEGER)"


def in_test(key: str = "entity_id", percent: int = 20) -> str:
    """Whether a row of the table at hand is in the test set: the first
    ``percent`` of its rows, rounded up, in digest order."""
    return f"(row_number() OVER (ORDER BY md5({key}::VARCHAR)) <= (count(*) OVER () * {percent} + 99) // 100)"


WIDE = "wide AS (SELECT o_custkey AS entity_id, " + ", ".join(
    f"avg(CASE WHEN o_orderpriority = '{p}' THEN o_totalprice / 5000.0 END) AS {c}"
    for p, c in PRIORITY_COLUMNS.items()) + " FROM orders GROUP BY o_custkey)"
NAMED = ("named AS (SELECT w.entity_id, c.c_name AS name, " + ", ".join(f"w.{c}" for c in SCORE_COLUMNS)
         + " FROM wide w LEFT JOIN customer c ON c.c_custkey = w.entity_id)")
OUTC = "outc AS (SELECT c_custkey AS entity_id, c_acctbal AS outcome FROM customer WHERE c_custkey % 6 <> 0)"
MERGED = "merged AS (SELECT n.*, o.outcome FROM named n JOIN outc o USING (entity_id))"
CUR = "cur AS (SELECT n.* FROM named n ANTI JOIN outc o USING (entity_id))"

_exam_aggs = []
for _c in COURSES:
    _exam_aggs.append(f"avg(CASE WHEN event_type = '{_c}' AND dayofmonth(ts) <= 15 THEN value END) AS {_c}_midterm")
    _exam_aggs.append(f"avg(CASE WHEN event_type = '{_c}' AND dayofmonth(ts) > 15 THEN value END) AS {_c}_final")
EXAMS = "exams AS (SELECT user_id AS entity_id, " + ", ".join(_exam_aggs) + " FROM events GROUP BY user_id)"
EXAMS_NAMED = ("exams_named AS (SELECT e.entity_id, c.c_name AS name, " + ", ".join(f"e.{c}" for c in EXAM_COLUMNS)
               + " FROM exams e LEFT JOIN customer c ON c.c_custkey = e.entity_id)")

ATTEMPTS = ("attempts AS (SELECT entity_id, attempt_no, attempt_date, score FROM ("
            "SELECT o_custkey AS entity_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INTEGER AS attempt_no, "
            "o_orderdate::DATE AS attempt_date, o_totalprice AS score FROM orders WHERE o_orderpriority = '1-URGENT'))")

GRADEBOOK = ("gradebook AS (SELECT c_name AS \"Student\", CASE WHEN c_custkey % 10 = 0 THEN c_name || ' - LOA' ELSE c_name END AS \"SIS Login ID\", "
             "CASE WHEN c_custkey % 7 = 0 THEN 'N/A' WHEN c_custkey % 11 = 0 THEN '' ELSE c_acctbal::VARCHAR END AS \"Final Exam Score\" FROM customer "
             "UNION ALL SELECT '    Points Possible', NULL, '100' UNION ALL SELECT 'Test Student', 'Test#000000999', '50')")

DOCFEATS = ("docfeats AS (SELECT d.doc_id AS entity_id, l.quality::INTEGER AS label, d.n_chars::DOUBLE AS n_chars, "
            "len(list_filter(regexp_split_to_array(coalesce(d.text, ''), '[ \\t\\n\\r]+'), lambda t: t <> ''))::DOUBLE AS n_words, "
            "len(string_split(coalesce(d.text, ''), chr(10)))::DOUBLE AS n_lines, "
            "CASE WHEN length(coalesce(d.text, '')) = 0 THEN NULL ELSE "
            "(length(coalesce(d.text, '')) - length(regexp_replace(coalesce(d.text, ''), '[0-9]', '', 'g')))::DOUBLE / length(coalesce(d.text, '')) END AS digit_share "
            "FROM labels l JOIN documents d ON d.doc_id = l.doc_id)")


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


def row_mean_sql(cols: list[str]) -> str:
    """Mean of the non-null values, summed left to right."""
    lst = "[" + ", ".join(f"{c}::DOUBLE" for c in cols) + "]"
    f = f"list_filter({lst}, lambda x: x IS NOT NULL)"
    return f"(CASE WHEN len({f}) = 0 THEN NULL ELSE list_reduce({f}, lambda a, x: a + x, 0.0) / len({f}) END)"


def row_var_sql(cols: list[str]) -> str:
    lst = "[" + ", ".join(f"{c}::DOUBLE" for c in cols) + "]"
    f = f"list_filter({lst}, lambda x: x IS NOT NULL)"
    m = row_mean_sql(cols)
    return (f"(CASE WHEN len({f}) < 2 THEN NULL ELSE "
            f"list_reduce(list_transform({f}, lambda x: (x - {m}) * (x - {m})), lambda a, x: a + x, 0.0) / (len({f}) - 1) END)")


def clip_sql(x: str, lo: float = 0.0, hi: float = 100.0) -> str:
    return f"(CASE WHEN {x} IS NULL THEN NULL ELSE least(greatest({x}, {lo}), {hi}) END)"


def ols_ctes(name: str, src: str, feats: list[str], target: str, group: list[str] | None = None,
             alpha: float = 0.0, scale_src: str | None = None, inverse: bool = False) -> list[str]:
    """CTEs ``{name}_coef(g..., n, ybar, xbar list, coef list (raw scale), intercept)``.

    Solves (Xc'Xc / s s' + alpha I) b = Xc'yc / s by Gauss-Jordan in a
    recursive CTE; ``scale_src`` (one row per group, columns ``sd_<i>``)
    supplies the standardisation (None: unit scale, i.e. plain OLS);
    ``inverse`` adds the matrix's inverse to ``{name}_sol``.
    """
    g = group or []
    gsel = "".join(f"{c}, " for c in g)
    gby = ("GROUP BY " + ", ".join(g)) if g else ""
    using = f"USING ({', '.join(g)})" if g else "ON TRUE"
    p = len(feats)
    means = ", ".join(f"avg({f}) AS m{i}" for i, f in enumerate(feats))
    ctes = [f"{name}_mean AS (SELECT {gsel}count(*) AS n, {means}, avg({target}) AS my FROM {src} {gby})"]
    sums = []
    for i in range(p):
        for j in range(p):
            sums.append(f"sum(({feats[i]} - m{i}) * ({feats[j]} - m{j})) AS a{i}_{j}")
        sums.append(f"sum(({feats[i]} - m{i}) * ({target} - my)) AS b{i}")
    ctes.append(f"{name}_mom AS (SELECT {gsel}{', '.join(sums)} FROM {src} JOIN {name}_mean {using} {gby})")
    sd = (lambda i: f"sd{i}") if scale_src else (lambda i: "1.0")
    rows = []
    for i in range(p):
        cells = [f"a{i}_{j} / ({sd(i)} * {sd(j)})" + (f" + {alpha}" if (i == j and alpha) else "") for j in range(p)]
        cells.append(f"b{i} / {sd(i)}")
        if inverse:
            cells += ["1.0" if i == j else "0.0" for j in range(p)]
        rows.append("[" + ", ".join(cells) + "]")
    src_scale = f" JOIN {scale_src} {using}" if scale_src else ""
    ctes.append(f"{name}_aug AS (SELECT {gsel}[{', '.join(rows)}]::DOUBLE[][] AS m FROM {name}_mom{src_scale})")
    gcols = "".join(f"{c}, " for c in g)
    ctes.append(
        f"{name}_ge({gcols}k, m) AS (SELECT {gcols}0, m FROM {name}_aug UNION ALL "
        f"SELECT {gcols}k + 1, list_transform(range(1, len(m) + 1), lambda i: CASE WHEN i = k + 1 "
        f"THEN list_transform(m[k + 1], lambda x: x / m[k + 1][k + 1]) "
        f"ELSE list_transform(range(1, len(m[1]) + 1), lambda j: m[i][j] - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END) "
        f"FROM {name}_ge WHERE k < len(m))")
    sdl = "[" + ", ".join(sd(i) for i in range(p)) + "]::DOUBLE[]"
    xbar = "[" + ", ".join(f"m{i}" for i in range(p)) + "]::DOUBLE[]"
    ctes.append(
        f"{name}_sol AS (SELECT {gsel}list_transform(m, lambda rr: rr[{p + 1}]) AS coef_std"
        + (f", list_transform(m, lambda rr: rr[{p + 2}:{2 * p + 1}]) AS inv" if inverse else "") + f" FROM {name}_ge WHERE k = {p})")
    ctes.append(
        f"{name}_coef AS (SELECT {''.join(f'x.{c}, ' for c in g)}x.n, x.my AS ybar, {xbar} AS xbar, "
        f"list_transform(range(1, {p + 1}), lambda i: s.coef_std[i] / ({sdl})[i]) AS coef, "
        f"x.my - list_sum(list_transform(range(1, {p + 1}), lambda i: s.coef_std[i] / ({sdl})[i] * ({xbar})[i])) AS intercept "
        f"FROM {name}_sol s JOIN {name}_mean x {using}"
        + (f" JOIN {scale_src} {using}" if scale_src else "") + ")")
    return ctes


def refined_ctes(name: str, src: str, feats: list[str], target: str, scale_src: str, steps: int = 2) -> list[str]:
    """``ols_ctes`` followed by refinement on the residuals of the rows: the
    normal equations give the squared condition number's share of the digits,
    each step ``b += inverse * X'(y - X b)`` adds as many again.  Gives
    ``{name}_sol(coef_std)`` and ``{name}_coef`` for one group."""
    p = len(feats)
    ctes = [*ols_ctes(f"{name}0", src, feats, target, scale_src=scale_src, inverse=True),
            f"{name}_b0 AS (SELECT coef_std AS b, inv FROM {name}0_sol)"]
    for k in range(1, steps + 1):
        res = f"{target} - my - (" + " + ".join(f"b[{i + 1}] * (({f} - m{i}) / sd{i})" for i, f in enumerate(feats)) + ")"
        g = ", ".join(f"sum(({f} - m{i}) / sd{i} * res)" for i, f in enumerate(feats))
        ctes.append(f"{name}_e{k} AS (SELECT [{g}] AS g FROM (SELECT *, {res} AS res FROM {src} CROSS JOIN {name}0_mean CROSS JOIN {scale_src} CROSS JOIN {name}_b{k - 1}))")
        ctes.append(f"{name}_b{k} AS (SELECT list_transform(range(1, {p + 1}), lambda i: b[i] + list_sum(list_transform(range(1, {p + 1}), lambda j: inv[i][j] * g[j]))) AS b, inv "
                    f"FROM {name}_b{k - 1} CROSS JOIN {name}_e{k})")
    ctes.append(f"{name}_sol AS (SELECT b AS coef_std FROM {name}_b{steps})")
    sd = "[" + ", ".join(f"sd{i}" for i in range(p)) + "]"
    xbar = "[" + ", ".join(f"m{i}" for i in range(p)) + "]"
    coef = f"list_transform(range(1, {p + 1}), lambda i: coef_std[i] / ({sd})[i])"
    ctes.append(f"{name}_coef AS (SELECT n, my AS ybar, {xbar} AS xbar, {coef} AS coef, "
                f"my - list_sum(list_transform(range(1, {p + 1}), lambda i: coef_std[i] / ({sd})[i] * ({xbar})[i])) AS intercept "
                f"FROM {name}_sol CROSS JOIN {name}0_mean CROSS JOIN {scale_src})")
    return ctes


NEWTON_STEPS = 10


def logistic_ctes(name: str, rows: str, feats: list[str], label: str, steps: int = NEWTON_STEPS) -> list[str]:
    """CTE ``{name}_beta(rep, hold, b)``: logistic fits by Newton steps, one
    per (rep, hold) of ``rows`` (their training rows), with half the sum of
    the squared weights as penalty; each step is a grouped sum and a
    Gauss-Jordan solve."""
    p = len(feats) + 1
    x = ["1.0", *feats]
    ctes = [f"{name}_b0 AS (SELECT DISTINCT rep, hold, [{', '.join(['0.0'] * p)}]::DOUBLE[] AS b FROM {rows})"]
    for t in range(steps):
        z = " + ".join(f"b[{i + 1}] * {c}" for i, c in enumerate(x))
        sums = [f"sum(({label} - mu) * {c}) AS g{i}" for i, c in enumerate(x)]
        sums += [f"sum(mu * (1.0 - mu) * {x[i]} * {x[j]}) AS h{i}_{j}" for i in range(p) for j in range(p)]
        matrix = ", ".join("[" + ", ".join([f"h{i}_{j}" + (" + 1.0" if i == j and i else "") for j in range(p)] + [f"g{i}" + (f" - b[{i + 1}]" if i else "")]) + "]" for i in range(p))
        ctes += [
            f"{name}_m{t} AS (SELECT r.*, b, 1.0 / (1.0 + exp(-({z}))) AS mu FROM {rows} r JOIN {name}_b{t} USING (rep, hold))",
            f"{name}_s{t} AS (SELECT rep, hold, any_value(b) AS b, {', '.join(sums)} FROM {name}_m{t} GROUP BY rep, hold)",
            f"{name}_g{t}(rep, hold, b, k, m) AS (SELECT rep, hold, b, 0, [{matrix}]::DOUBLE[][] FROM {name}_s{t} UNION ALL "
            f"SELECT rep, hold, b, k + 1, list_transform(range(1, len(m) + 1), lambda i: CASE WHEN i = k + 1 THEN list_transform(m[k + 1], lambda v: v / m[k + 1][k + 1]) "
            f"ELSE list_transform(range(1, len(m[1]) + 1), lambda j: m[i][j] - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END) FROM {name}_g{t} WHERE k < len(m))",
            f"{name}_b{t + 1} AS (SELECT rep, hold, list_transform(range(1, {p + 1}), lambda i: b[i] + m[i][{p + 1}]) AS b FROM {name}_g{t} WHERE k = {p})"]
    ctes.append(f"{name}_beta AS (SELECT rep, hold, b FROM {name}_b{steps})")
    return ctes


def logistic_cv_ctes(name: str, data: str, feats: list[str], label: str, reps: int = 10, k: int = 5, seed: int = 42) -> list[str]:
    """CTE ``{name}_ev(rep, fold, auc, n_pos, n_neg, accuracy)``: repeated
    k-fold CV of a logistic model on ``data(entity_id, feats, label)``,
    features standardised over all rows."""
    std = ", ".join(f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1.0 ELSE stddev_pop({c}) OVER () END AS {c}" for c in feats)
    z = " + ".join(f"b[{i + 1}] * {c}" for i, c in enumerate(["1.0", *feats]))
    return [
        f"{name}_d AS (SELECT entity_id, {label}, {std} FROM {data})",
        f"{name}_f AS (SELECT d.*, rep, (ntile({k}) OVER (PARTITION BY rep ORDER BY md5('{seed}-' || rep::VARCHAR || '-' || entity_id::VARCHAR)) - 1)::INTEGER AS fold FROM {name}_d d CROSS JOIN range(0, {reps}) rr(rep))",
        f"{name}_t AS (SELECT f.*, h.hold FROM {name}_f f CROSS JOIN range(0, {k}) h(hold) WHERE f.fold <> h.hold)",
        *logistic_ctes(name, f"{name}_t", feats, label),
        f"{name}_sc AS (SELECT f.*, 1.0 / (1.0 + exp(-({z}))) AS score FROM {name}_f f JOIN {name}_beta c ON c.rep = f.rep AND c.hold = f.fold)",
        f"{name}_rk AS (SELECT *, rank() OVER (PARTITION BY rep, fold ORDER BY score) + (count(*) OVER (PARTITION BY rep, fold, score) - 1) / 2.0 AS rnk FROM {name}_sc)",
        f"{name}_u AS (SELECT rep, fold, sum(rnk) FILTER (WHERE {label} = 1) AS rs, count(*) FILTER (WHERE {label} = 1) AS n_pos, count(*) FILTER (WHERE {label} = 0) AS n_neg, "
        f"avg(((score >= 0.5)::INTEGER = {label})::INTEGER) AS accuracy FROM {name}_rk GROUP BY rep, fold)",
        f"{name}_ev AS (SELECT rep::INTEGER AS rep, fold, CASE WHEN n_pos * n_neg = 0 THEN NULL ELSE (rs - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg) END AS auc, n_pos, n_neg, accuracy FROM {name}_u)"]


AUC_SUMMARY = ("count(*) AS n_folds, avg(auc) AS auc_mean, stddev_pop(auc) AS auc_std, avg(accuracy) AS accuracy_mean")


def auc_summary_sql(p6, src: str, extra: str = "") -> str:
    """SELECT of the summary of fold AUCs over CTE ``src``."""
    return (f"SELECT n_folds, {p6('auc_mean')} AS auc_mean, {p6('auc_std')} AS auc_std, {p6('accuracy_mean')} AS accuracy_mean, "
            f"{p6('auc_mean - 1.96 * auc_std / sqrt(n_folds)')} AS auc_ci_low, {p6('auc_mean + 1.96 * auc_std / sqrt(n_folds)')} AS auc_ci_high, "
            f"CASE WHEN auc_mean > 0.8 THEN 'GOOD' WHEN auc_mean > 0.7 THEN 'MODERATE' WHEN auc_mean IS NOT NULL THEN 'WEAK' END AS auc_class{extra} "
            f"FROM (SELECT {AUC_SUMMARY} FROM {src})")


def centred_sql(coef_alias: str, feats: list[str]) -> str:
    """Prediction from the centred form, which cancels less."""
    return f"({coef_alias}.ybar + (" + " + ".join(f"{coef_alias}.coef[{i + 1}] * ({f} - {coef_alias}.xbar[{i + 1}])" for i, f in enumerate(feats)) + "))"


def predict_sql(coef_alias: str, feats: list[str]) -> str:
    return f"({coef_alias}.intercept + " + " + ".join(
        f"{coef_alias}.coef[{i + 1}] * {f}" for i, f in enumerate(feats)) + ")"


def _simpson_sql(a: str, b: str, f) -> str:
    """Composite Simpson over [a, b] with the same steps and summation as
    ``functions.tails`` (f maps a SQL expression of the point to the integrand)."""
    h = f"(({b}) - ({a})) / 2000.0"
    w = "(CASE WHEN k = 0 OR k = 2000 THEN 1.0 WHEN k % 2 = 1 THEN 4.0 ELSE 2.0 END)"
    return (f"(list_reduce(list_transform(range(0, 2001), lambda k: {w} * {f(f'(({a}) + k::DOUBLE * {h})')}), "
            f"lambda acc, v: acc + v, 0.0) * {h} / 3.0)")


def t_p_sql(t: str, nu: str) -> str:
    """Two-sided Student-t p-value of column ``t`` with ``nu`` d.f."""
    th = f"atan(abs({t}) / sqrt({nu}::DOUBLE))"
    wd = f"(12.0 / sqrt(greatest({nu}::DOUBLE - 1.0, 1.0)))"
    hp = "(pi() / 2)"

    def f(u):
        return f"exp(({nu}::DOUBLE - 1.0) * ln(greatest(cos({u}), 1e-300)))"
    num = _simpson_sql(th, f"least({th} + {wd}, {hp})", f)
    den = _simpson_sql("0.0", f"least({wd}, {hp})", f)
    return f"(CASE WHEN {t} IS NULL OR {nu} IS NULL OR {nu} < 1 OR isnan({t}) THEN NULL ELSE least({num} / {den}, 1.0) END)"


def normal_p_sql(z: str) -> str:
    a = f"abs({z})"
    s = _simpson_sql(a, f"{a} + 12.0", lambda u: f"exp(-{u} * {u} / 2.0)")
    return f"(CASE WHEN {z} IS NULL THEN NULL ELSE 2.0 * ({s} / sqrt(2 * pi())) END)"


def stars_sql(p: str, ns: str = "ns") -> str:
    return (f"(CASE WHEN {p} < 0.001 THEN '***' WHEN {p} < 0.01 THEN '**' WHEN {p} < 0.05 THEN '*' "
            f"WHEN {p} IS NOT NULL THEN '{ns}' END)")


def cv_sql(name: str, data: str, feats: list[str], target: str, alpha: float, k: int = 5,
           seed: int = 42, reps: int | None = None, fold_sql: str | None = None) -> list[str]:
    """CTEs for K-fold (optionally repeated) CV of ridge/OLS on ``data``;
    the last CTE ``{name}_ev`` has (rep?, fold, n_train, n_test, r2, mae).
    Folds: equal parts in the order of md5 of 'seed-id' (or 'seed-rep-id');
    scaling on all rows."""
    rep = reps is not None
    fold_expr = (f"(ntile({k}) OVER (PARTITION BY rep ORDER BY md5('{seed}-' || rep::VARCHAR || '-' || entity_id::VARCHAR)) - 1)::INTEGER"
                 if rep else f"(ntile({k}) OVER (ORDER BY md5('{seed}-' || entity_id::VARCHAR)) - 1)::INTEGER")
    if fold_sql is not None:
        fold_expr = fold_sql
    reps_src = f" CROSS JOIN range(0, {reps}) rr(rep)" if rep else ""
    g = ["rep", "hold"] if rep else ["hold"]
    sds = ", ".join(f"CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS sd{i}" for i, c in enumerate(feats))
    ctes = [
        f"{name}_f AS (SELECT d.*{', rep' if rep else ''}, {fold_expr} AS fold FROM {data} d{reps_src})",
        f"{name}_sd0 AS (SELECT {sds} FROM {data})",
        f"{name}_sd AS (SELECT {'rr.rep, ' if rep else ''}h.hold, s.* FROM {name}_sd0 s CROSS JOIN range(0, {k}) h(hold)"
        + (f" CROSS JOIN range(0, {reps}) rr(rep)" if rep else "") + ")",
        f"{name}_tr AS (SELECT f.*, h.hold FROM {name}_f f CROSS JOIN range(0, {k}) h(hold) WHERE f.fold <> h.hold)",
        *ols_ctes(f"{name}_m", f"{name}_tr", feats, target, group=g, alpha=alpha, scale_src=f"{name}_sd"),
    ]
    pred = predict_sql("c", feats)
    on = "c.hold = f.fold" + (" AND c.rep = f.rep" if rep else "")
    ctes.append(
        f"{name}_ev AS (SELECT {'f.rep, ' if rep else ''}f.fold, max(c.n) AS n_train, count(*) AS n_test, "
        f"CASE WHEN var_pop(f.{target}) = 0 THEN NULL ELSE 1.0 - sum((f.{target} - {pred}) * (f.{target} - {pred})) / (var_pop(f.{target}) * count(*)) END AS r2, "
        f"avg(abs(f.{target} - {pred})) AS mae FROM {name}_f f JOIN {name}_m_coef c ON {on} GROUP BY {'f.rep, ' if rep else ''}f.fold)")
    return ctes
