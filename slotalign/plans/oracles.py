"""SQL counterparts of the registered queries, for a SQL engine on the same tables.

The texts are put together from named parts: a chain as rows ``e(sample_id, slot, p0, ..)`` of the
entries that are there, fits per label, scores, and the best assignment. The assignment is written
as an exhaustive comparison (up to three slots) or as dynamic programming over sets of used labels, a list per sample.
"""

from __future__ import annotations

from itertools import permutations

# Fixed values that results depend on.
EPS = "0.01"
THIN_SLOT = 8
LOG_TWO_PI = "ln(2 * pi())"
QUARTILE_OF_T = "0.7406970841126834"

CENTS = "CAST(round({0} * 100) AS BIGINT)"
PRICE = CENTS.format("l_extendedprice")

LINES = f"""
  SELECT l_orderkey AS sample_id, l_linenumber - 1 AS slot, sum(l_quantity) AS p0,
         CAST(sum({PRICE}) AS DOUBLE) / 100000 AS p1,
         CAST(sum({CENTS.format('l_discount')}) AS DOUBLE) / 100 AS p2
  FROM lineitem GROUP BY 1, 2"""

FLAGS = f"""
  SELECT l_orderkey AS sample_id, list_position(['A', 'N', 'R'], l_returnflag) - 1 AS slot,
         sum(l_quantity) AS p0, CAST(sum({PRICE}) AS DOUBLE) / 100000 AS p1
  FROM lineitem GROUP BY 1, 2"""

STATUS = f"""
  SELECT l_orderkey AS sample_id, list_position(['F', 'O'], l_linestatus) - 1 AS slot,
         sum(l_quantity) AS p0, CAST(sum({PRICE}) AS DOUBLE) / 100000 AS p1
  FROM lineitem GROUP BY 1, 2"""

DISCOUNTED = f"""
  SELECT l_orderkey AS sample_id, list_position(['A', 'N', 'R'], l_returnflag) - 1 AS slot,
         sum(l_quantity) AS p0,
         CAST(sum({PRICE}) FILTER (l_discount >= 0.05) AS DOUBLE) / 100000 AS p1
  FROM lineitem GROUP BY 1, 2"""

AMOUNTS = f"""
  SELECT sample_id, slot, CAST(sum(amount) AS DOUBLE) / 100 AS p0, CAST(sum(tax) AS DOUBLE) / 100 AS p1 FROM (
    SELECT l_orderkey AS sample_id, 0 AS slot, {CENTS.format('l_quantity')} AS amount, {CENTS.format('l_tax')} AS tax FROM lineitem
    UNION ALL SELECT l_orderkey, 1, {PRICE}, {CENTS.format('l_tax')} FROM lineitem
    UNION ALL SELECT l_orderkey, 2, l_linenumber * 100, {CENTS.format('l_tax')} FROM lineitem WHERE l_discount >= 0.05)
  GROUP BY 1, 2"""

EMBEDDED = ("\n  SELECT vec_id AS sample_id, label AS slot, "
            + ", ".join("(" + " + ".join(f"CAST(embedding[{8 * i + k + 1}] AS DOUBLE)" for k in range(8)) + f") / 8 AS p{i}"
                        for i in range(8))
            + "\n  FROM embeddings")

PARTS = f"""
  SELECT l_partkey AS sample_id, l_orderkey % 10 AS slot,
         sum(l_quantity) AS p0, CAST(sum({PRICE}) AS DOUBLE) / 100000 AS p1
  FROM lineitem GROUP BY 1, 2"""


def params(width: int, prefix: str = "") -> str:
    return ", ".join(f"{prefix}p{i}" for i in range(width))


def chain_parts(source: str, slots: int) -> list[str]:
    """``e``: entries that are there; ``n``: the number of samples; ``g``: every sample and slot."""
    return [
        f"e AS MATERIALIZED ({source})",
        "samples AS (SELECT DISTINCT sample_id FROM e)",
        "n AS (SELECT count(*) AS n FROM samples)",
        f"g AS (SELECT sample_id, CAST(range AS INTEGER) AS slot FROM samples CROSS JOIN range({slots}))",
    ]


def query(parts: list[str], select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


def full_rows(entries: str, width: int) -> str:
    return f"SELECT sample_id, slot, {params(width)} FROM g LEFT JOIN {entries} USING (sample_id, slot)"


def dense(parts: list[str]) -> list[str]:
    return [*parts, "ids AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS id FROM samples)"]


def dense_rows(width: int, where: str = "true", number: str = "id") -> str:
    return (f"SELECT {number} AS sample_id, slot, {params(width)} FROM g JOIN ids USING (sample_id) "
            f"LEFT JOIN e USING (sample_id, slot) WHERE {where}")


# ---- fits -----------------------------------------------------------------------------------


def mv_fit_part(name: str, entries: str, used: list[int], slots: int) -> str:
    """Mean, ddof-1 covariance and clipped probability per label; thin labels take the pool."""
    complete = " AND ".join(f"p{i} IS NOT NULL" for i in used)
    cells = [(f"m{a}", f"avg(p{i}) FILTER ({complete})") for a, i in enumerate(used)]
    cells += [(f"c{a}{b}", f"covar_samp(p{i}, p{j}) FILTER ({complete})")
              for a, i in enumerate(used) for b, j in enumerate(used) if a <= b]
    own = ", ".join(f"{expr} AS {cell}" for cell, expr in cells)
    chosen = ", ".join(f"CASE WHEN coalesce(o.valid, 0) < {THIN_SLOT} THEN a.{cell} ELSE o.{cell} END AS {cell}"
                       for cell, _ in cells)
    return f"""{name} AS MATERIALIZED (
  SELECT l.range AS label, {chosen},
         least(greatest(coalesce(o.present, 0) / n.n, {EPS}), 1 - {EPS}) AS prob
  FROM range({slots}) l
  LEFT JOIN (SELECT slot, count(*) FILTER ({complete}) AS valid, count(p0) AS present, {own}
             FROM {entries} GROUP BY slot) o ON o.slot = l.range
  CROSS JOIN (SELECT {own} FROM {entries}) a CROSS JOIN n)"""


def uni_fit_part(name: str, entries: str, used: int, slots: int, width: int) -> str:
    """Mean and ddof-0 variance of one parameter; thin labels take all values, with ddof 1."""
    pool = " UNION ALL ".join(f"SELECT p{i} AS v FROM {entries}" for i in range(width))
    return f"""{name} AS MATERIALIZED (
  SELECT l.range AS label,
         CASE WHEN coalesce(o.valid, 0) < {THIN_SLOT} THEN a.m ELSE o.m END AS m0,
         CASE WHEN coalesce(o.valid, 0) < {THIN_SLOT} THEN a.v ELSE o.v END AS c00,
         least(greatest(coalesce(o.present, 0) / n.n, {EPS}), 1 - {EPS}) AS prob
  FROM range({slots}) l
  LEFT JOIN (SELECT slot, count(p{used}) AS valid, count(p0) AS present, avg(p{used}) AS m, var_pop(p{used}) AS v
             FROM {entries} GROUP BY slot) o ON o.slot = l.range
  CROSS JOIN (SELECT avg(v) AS m, var_samp(v) AS v FROM ({pool})) a CROSS JOIN n)"""


def robust_fit_part(name: str, entries: str, used: list[int], slots: int) -> str:
    """Median and quartile scale per label and parameter, of values replaced by the middle of their sketch bucket.

    A bucket is the 128th part of a power of two; a quantile is the value whose rank is its share of the count, rounded up.
    """
    complete = " AND ".join(f"p{i} IS NOT NULL" for i in used)
    power = "pow(2, floor(log2(abs({0}))))"
    middle = (f"CASE WHEN {{0}} = 0 THEN 0 ELSE sign({{0}}) * {power} * (floor(abs({{0}}) / {power} * 128) + 0.5) / 128 END")

    def at(i: int, share: str) -> str:
        return f"list_sort(list(q{i}))[CAST(ceil({share}::DOUBLE * count(*)) AS BIGINT)]"

    cells = [cell for i in range(len(used)) for cell in (
        (f"m{i}", at(i, "0.5")), (f"s{i}", f"({at(i, '0.75')} - {at(i, '0.25')}) / 2 / {QUARTILE_OF_T}"))]
    own = ", ".join(f"{expr} AS {cell}" for cell, expr in cells)
    chosen = ", ".join(f"CASE WHEN coalesce(o.valid, 0) < {THIN_SLOT} THEN a.{cell} ELSE o.{cell} END AS {cell}" for cell, _ in cells)
    middles = ", ".join(f"{middle.format(f'p{i}')} AS q{a}" for a, i in enumerate(used))
    return f"""{name} AS MATERIALIZED (
  WITH q AS (SELECT slot, {middles} FROM {entries} WHERE {complete})
  SELECT l.range AS label, {chosen}, least(greatest(coalesce(k.present, 0) / n.n, {EPS}), 1 - {EPS}) AS prob
  FROM range({slots}) l
  LEFT JOIN (SELECT slot, count(*) AS valid, {own} FROM q GROUP BY slot) o ON o.slot = l.range
  LEFT JOIN (SELECT slot, count(p0) AS present FROM {entries} GROUP BY slot) k ON k.slot = l.range
  CROSS JOIN (SELECT {own} FROM q) a CROSS JOIN n)"""


def fit_columns(width: int) -> str:
    means = [f"round(m{i}, 6) AS m{i}" for i in range(width)]
    return ", ".join(means + [f"round(c{i}{j}, 6) AS c{i}{j}" for i in range(width) for j in range(i, width)])


# ---- densities and scores -------------------------------------------------------------------


def factor_part(name: str, fit: str, width: int) -> str:
    """The fit with its Cholesky factor ``l{row}{column}``, one column of it per nested select."""
    rows = fit
    for col in range(width):
        rest = ["".join(f" - l{row}{k} * l{col}{k}" for k in range(col)) for row in range(width)]
        rows = f"(SELECT *, sqrt(c{col}{col}{rest[col]}) AS l{col}{col} FROM {rows})"
        below = "".join(f", (c{col}{row}{rest[row]}) / l{col}{col} AS l{row}{col}" for row in range(col + 1, width))
        rows = f"(SELECT *{below} FROM {rows})"
    return f"{name} AS MATERIALIZED {rows}"


def density_part(name: str, entries: str, factor: str, used: list[int]) -> str:
    """``logpdf`` of every entry that is there under every label; NULL unless complete."""
    rows = f"(SELECT e.*, f.* FROM {entries} e CROSS JOIN {factor} f)"
    for row, i in enumerate(used):
        rest = "".join(f" - l{row}{k} * z{k}" for k in range(row))
        rows = f"(SELECT *, (p{i} - m{row}{rest}) / l{row}{row} AS z{row} FROM {rows})"
    squares = " + ".join(f"z{r} * z{r}" for r in range(len(used)))
    logs = " + ".join(f"ln(l{r}{r})" for r in range(len(used)))
    return f"""{name} AS (
  SELECT sample_id, slot, label, prob,
         -0.5 * ({len(used)} * {LOG_TWO_PI} + {squares}) - ({logs}) AS logpdf
  FROM {rows})"""


def scored(tag: str, entries: str, used: list[int], fit: str) -> list[str]:
    return [
        factor_part(f"factor{tag}", fit, len(used)),
        density_part(f"density{tag}", entries, f"factor{tag}", used),
        f"""score{tag} AS MATERIALIZED (SELECT sample_id, slot, label, ln(prob) + logpdf AS score
  FROM density{tag} WHERE logpdf IS NOT NULL)""",
    ]


def robust_scored(tag: str, entries: str, used: list[int], fit: str) -> list[str]:
    """As ``scored``, for independent Student distributions with four degrees of freedom."""
    constant = "(lgamma(2.5) - lgamma(2) - 0.5 * ln(4 * pi()))"
    terms = [f"{constant} - ln(s{a}) - 2.5 * ln(1 + ((p{i} - m{a}) / s{a}) * ((p{i} - m{a}) / s{a}) / 4)" for a, i in enumerate(used)]
    return [f"""density{tag} AS (SELECT sample_id, slot, label, prob, {' + '.join(terms)} AS logpdf FROM {entries} CROSS JOIN {fit})""",
            f"score{tag} AS MATERIALIZED (SELECT sample_id, slot, label, ln(prob) + logpdf AS score FROM density{tag} WHERE logpdf IS NOT NULL)"]


def density_query(source: str, slots: int, used: list[int], fit: str) -> str:
    parts = [*chain_parts(source, slots), fit, factor_part("factor", "fit", len(used)),
             density_part("density", "e", "factor", used)]
    return query(parts, "SELECT g.sample_id, factor.label, g.slot, round(density.logpdf, 6) AS logpdf "
                        "FROM g CROSS JOIN factor LEFT JOIN density USING (sample_id, slot, label)")


def cost_query(source: str, slots: int, used: list[int], fit: str) -> str:
    parts = [*chain_parts(source, slots), fit, *scored("", "e", used, "fit")]
    return query(parts, "SELECT g.sample_id, fit.label, g.slot, "
                        "round(coalesce(score.score, ln(1 - own.prob)), 6) AS score "
                        "FROM g CROSS JOIN fit JOIN fit own ON own.label = g.slot "
                        "LEFT JOIN score ON score.sample_id = g.sample_id AND score.slot = g.slot "
                        "AND score.label = fit.label")


# ---- assignment -----------------------------------------------------------------------------


def compared_orders(tag: str, slots: int) -> list[str]:
    """``best(sample_id, labels)``: all orders of a few slots compared; missing entries score 0."""
    cells = ", ".join(f"coalesce(max(score) FILTER (slot = {s} AND label = {k}), 0) AS c{s}{k}"
                      for s in range(slots) for k in range(slots))
    orders = list(permutations(range(slots)))
    totals = ", ".join(f"list_sum(list_sort([{', '.join(f'c{s}{order[s]}' for s in range(slots))}])) AS t{i}"
                       for i, order in enumerate(orders))
    top = f"greatest({', '.join(f't{i}' for i in range(len(orders)))})"
    choice = " ".join(f"WHEN t{i} = {top} THEN {list(order)}" for i, order in enumerate(orders))
    return [
        f"cells{tag} AS (SELECT sample_id, {cells} FROM score{tag} GROUP BY sample_id)",
        f"totals{tag} AS (SELECT *, {totals} FROM cells{tag})",
        f"best{tag} AS (SELECT sample_id, CASE {choice} END AS labels FROM totals{tag})",
    ]


def label_sets(tag: str, slots: int) -> list[str]:
    """``best(sample_id, labels)``: per sample one list with the best total of every set of used labels, folded entry by entry.

    The sets are bit patterns. The labels are read off the lists from the last entry back, the highest label first.
    """
    def without(label: int, total: str, used: str) -> str:
        return f"CASE WHEN ({used} >> {label}) & 1 = 1 THEN {total}[xor({used}, {1 << label}) + 1] + c{{0}}[{label + 1}] END"

    scores = ", ".join(f"list(score ORDER BY label) FILTER (slot = {s}) AS c{s}" for s in range(slots))
    rows = (f"(SELECT sample_id, {', '.join(f'c{s}' for s in range(slots))}, "
            f"list_transform(range({1 << slots}), lambda u: CASE WHEN u = 0 THEN 0.0::DOUBLE END) AS t0 "
            f"FROM samples LEFT JOIN (SELECT sample_id, {scores} FROM score{tag} GROUP BY sample_id) USING (sample_id))")
    for s in range(slots):
        best = ", ".join(without(label, f"t{s}", "u").format(s) for label in range(slots))
        rows = (f"(SELECT *, CASE WHEN c{s} IS NULL THEN t{s} ELSE "
                f"list_transform(range({1 << slots}), lambda u: greatest({best})) END AS t{s + 1} FROM {rows})")
    rows = f"(SELECT *, list_position(t{slots}, list_max(t{slots})) - 1 AS u{slots} FROM {rows})"
    for s in reversed(range(slots)):
        found = " ".join(f"WHEN {without(label, f't{s}', f'u{s + 1}').format(s)} = t{s + 1}[u{s + 1} + 1] THEN {label}"
                         for label in reversed(range(slots)))
        rows = f"(SELECT *, CASE WHEN c{s} IS NULL THEN -1 {found} END AS l{s} FROM {rows})"
        rows = f"(SELECT *, CASE WHEN l{s} < 0 THEN u{s + 1} ELSE xor(u{s + 1}, 1 << l{s}) END AS u{s} FROM {rows})"
    labels = ", ".join(f"l{s}" for s in range(slots))
    return [f"best{tag} AS MATERIALIZED (SELECT sample_id, [{labels}] AS labels FROM {rows})"]


def assignment_query(source: str, slots: int, used: list[int], fit: str, solve) -> str:
    parts = [*chain_parts(source, slots), fit, *scored("", "e", used, "fit"), *solve("", slots)]
    return query(parts, "SELECT sample_id, slot, label, round(score, 6) AS score FROM score "
                        "JOIN best USING (sample_id) WHERE labels[slot + 1] = label")


def moved(tag: str, entries: str, width: int) -> str:
    """The entries on the slots that the assignment gave them."""
    return (f"moved{tag} AS (SELECT sample_id, CAST(labels[slot + 1] AS INTEGER) AS slot, {params(width)} "
            f"FROM {entries} JOIN best{tag} USING (sample_id))")


def iterations(entries: str, steps: list[str], slots: int, width: int, solve, param: int = 1) -> tuple[list[str], str]:
    """Fits and assignments unrolled; ``steps`` are ``uni``, ``mv`` or ``robust``. Entries keep their start slots.

    Returns the parts and the name of the rows in the last layout.
    """
    parts, layout = [], entries
    for i, step in enumerate(steps):
        tag = f"_{i}"
        if step == "uni":
            used = [param]
            parts.append(uni_fit_part(f"fit{tag}", layout, param, slots, width))
        else:
            used = list(range(width))
            parts.append((robust_fit_part if step == "robust" else mv_fit_part)(f"fit{tag}", layout, used, slots))
        score = robust_scored if step == "robust" else scored
        parts += [*score(tag, entries, used, f"fit{tag}"), *solve(tag, slots), moved(tag, entries, width)]
        layout = f"moved{tag}"
    return parts, layout


def shuffled(slots: int, width: int, seed: int) -> str:
    """``s``: the entries on slots in the order of a digest of seed, sample and slot."""
    return f"""s AS (SELECT sample_id, CAST(place AS INTEGER) AS slot, {params(width)} FROM (
  SELECT sample_id, slot, row_number() OVER (
    PARTITION BY sample_id ORDER BY md5(concat_ws(':', {seed}, sample_id, slot))) - 1 AS place FROM g)
  JOIN e USING (sample_id, slot))"""


def cost_part(tag: str, before: str, slots: int) -> str:
    """Mean cost of one step: scores of the entries, and the filling by the slots they left empty."""
    return f"""cost{tag} AS (SELECT -(
    (SELECT sum(score) FROM score{tag} JOIN best{tag} USING (sample_id) WHERE labels[slot + 1] = label)
  + (SELECT sum((n.n - coalesce(k.count, 0)) * ln(1 - f.prob)) FROM fit{tag} f CROSS JOIN n
     LEFT JOIN (SELECT slot, count(*) AS count FROM {before} GROUP BY slot) k ON k.slot = f.label)
  ) / (SELECT n FROM n) AS cost)"""


def relabel_query(source: str, slots: int, width: int, steps: list[str], solve) -> str:
    parts, last = iterations("e", steps, slots, width, solve)
    return query([*chain_parts(source, slots), *parts], full_rows(last, width))


def trace_query() -> str:
    parts, _ = iterations("e", ["mv"] * 3, 3, 2, compared_orders)
    costs = [cost_part(f"_{i}", "e" if i == 0 else f"moved_{i - 1}", 3) for i in range(3)]
    probs = ", ".join(f"round(max(prob) FILTER (label = {s}), 6) AS prob{s}" for s in range(3))
    lines = " UNION ALL ".join(
        f"SELECT {i + 1} AS iteration, (SELECT round(cost, 6) FROM cost_{i}) AS cost, {probs} FROM fit_{i}"
        for i in range(3))
    return query([*chain_parts(FLAGS, 3), *parts, *costs], lines)


def catalog_query(select: str) -> str:
    """The three-slot catalog as ``moved_4``, and the fit of its last step as ``fit_4``."""
    parts, _ = iterations("s", ["uni"] * 2 + ["mv"] * 3, 3, 2, compared_orders)
    return query([*chain_parts(FLAGS, 3), shuffled(3, 2, 7), *parts], select)


def wide_catalog_query() -> str:
    parts, last = iterations("s", ["uni"] * 2 + ["mv"] * 3, 7, 3, label_sets)
    means = ", ".join(f"round(avg(p{i}), 6) AS mean_p{i}" for i in range(3))
    return query([*chain_parts(LINES, 7), shuffled(7, 3, 7), *parts],
                 f"SELECT slot, round(count(*) / max(n.n), 6) AS presence, {means} "
                 f"FROM {last} CROSS JOIN n GROUP BY slot")


# ---- the loop to its fixed point ------------------------------------------------------------


def settled_query(select: str) -> str:
    """The two-slot catalog until nothing moves, as a recursion whose state is one row.

    A row of ``loop`` holds the fits of a layout, its digest, and which fit the step uses (phase 1: one
    parameter, 2: both). The layout that the last row's fit gives is the layout it was fitted to.
    """
    def fits(x: str, y: str, k: int) -> str:
        return (f"avg({x}) AS m{k}, avg({y}) AS n{k}, var_pop({y}) AS u{k}, var_samp({x}) AS a{k}, "
                f"covar_samp({x}, {y}) AS b{k}, var_samp({y}) AS d{k}, "
                f"least(greatest(count({x}) / count(*), {EPS}), 1 - {EPS}) AS prob{k}")

    def score(s: int, k: int) -> str:
        dx, dy, det = f"(x{s} - m{k})", f"(y{s} - n{k})", f"(a{k} * d{k} - b{k} * b{k})"
        one = f"-0.5 * ({LOG_TWO_PI} + ln(u{k}) + {dy} * {dy} / u{k})"
        both = (f"-0.5 * (2 * {LOG_TWO_PI} + ln({det}) + (d{k} * {dx} * {dx} - 2 * b{k} * {dx} * {dy} "
                f"+ a{k} * {dy} * {dy}) / {det})")
        return f"coalesce(ln(prob{k}) + CASE phase WHEN 1 THEN {one} ELSE {both} END, 0)"

    swap = f"{score(0, 1)} + {score(1, 0)} > {score(0, 0)} + {score(1, 1)}"
    columns = ", ".join(f"{c}{k}" for k in (0, 1) for c in ("m", "n", "u", "a", "b", "d", "prob"))
    digest = "bit_xor(hash(sample_id, x0 IS NULL, x0, x1 IS NULL, x1, y0, y1))"
    placed = ", ".join(f"CASE WHEN swap THEN w.{c}{1 - k} ELSE w.{c}{k} END AS {c}{k}" for k in (0, 1) for c in ("x", "y"))
    parts = [
        *chain_parts(STATUS, 2), shuffled(2, 2, 7),
        "w AS MATERIALIZED (SELECT sample_id, " + ", ".join(
            f"max(p{p}) FILTER (slot = {k}) AS {c}{k}" for k in (0, 1) for p, c in enumerate("xy")) + " FROM s GROUP BY 1)",
        f"""loop AS (
  SELECT 1 AS phase, {digest} AS digest, {fits('x0', 'y0', 0)}, {fits('x1', 'y1', 1)} FROM w
  UNION ALL
  SELECT CASE WHEN digest = old THEN phase + 1 ELSE phase END, digest, {columns} FROM (
    SELECT phase, old, {digest} AS digest, {fits('x0', 'y0', 0)}, {fits('x1', 'y1', 1)} FROM (
      SELECT phase, old, sample_id, {placed} FROM (
        SELECT phase, digest AS old, w.*, {swap} AS swap FROM loop CROSS JOIN w WHERE phase < 3) w)
    GROUP BY phase, old))""",
        f"last AS (SELECT * REPLACE (2 AS phase) FROM loop WHERE phase = 3)",
        f"settled AS (SELECT sample_id, {placed} FROM (SELECT w.*, {swap} AS swap FROM last CROSS JOIN w) w)",
    ]
    return query(parts, select).replace("WITH ", "WITH RECURSIVE ", 1)


def settled_orders_query() -> str:
    """The three-slot catalog until nothing moves, as ``settled_query`` for two; all orders of a sample are compared."""
    slots, orders = range(3), list(permutations(range(3)))

    def fits(k: int) -> str:
        return (f"avg(x{k}) AS m{k}, avg(y{k}) AS n{k}, var_pop(x{k}) AS u{k}, var_samp(x{k}) AS a{k}, "
                f"covar_samp(x{k}, y{k}) AS b{k}, var_samp(y{k}) AS d{k}, "
                f"least(greatest(count(x{k}) / count(*), {EPS}), 1 - {EPS}) AS prob{k}")

    def score(s: int, k: int) -> str:
        dx, dy, det = f"(x{s} - m{k})", f"(y{s} - n{k})", f"(a{k} * d{k} - b{k} * b{k})"
        one = f"-0.5 * ({LOG_TWO_PI} + ln(u{k}) + {dx} * {dx} / u{k})"
        both = (f"-0.5 * (2 * {LOG_TWO_PI} + ln({det}) + (d{k} * {dx} * {dx} - 2 * b{k} * {dx} * {dy} "
                f"+ a{k} * {dy} * {dy}) / {det})")
        return f"coalesce(ln(prob{k}) + CASE phase WHEN 1 THEN {one} ELSE {both} END, 0)"

    def scored(fit: str, where: str) -> str:
        cells = ", ".join(f"{score(s, k)} AS c{s}{k}" for s in slots for k in slots)
        totals = ", ".join(f"list_sum(list_sort([{', '.join(f'c{s}{order[s]}' for s in slots)}]))" for order in orders)
        return (f"SELECT *, list_position(totals, list_max(totals)) AS best FROM (SELECT *, [{totals}] AS totals "
                f"FROM (SELECT *, {cells} FROM {fit} CROSS JOIN w WHERE {where}))")

    all_fits = ", ".join(map(fits, slots))
    values = ", ".join(f"{c}{k} IS NULL, {c}{k}" for k in slots for c in "xy")
    digest = f"bit_xor(hash(sample_id, {values}))"
    columns = ", ".join(f"{c}{k}" for k in slots for c in ("m", "n", "u", "a", "b", "d", "prob"))
    placed = ", ".join(f"CASE best {' '.join(f'WHEN {i + 1} THEN {c}{order.index(k)}' for i, order in enumerate(orders))} END AS {c}{k}"
                       for k in slots for c in "xy")
    parts = [
        *chain_parts(AMOUNTS, 3), shuffled(3, 2, 7),
        "w AS MATERIALIZED (SELECT sample_id, " + ", ".join(
            f"max(p{p}) FILTER (slot = {k}) AS {c}{k}" for k in slots for p, c in enumerate("xy")) + " FROM s GROUP BY 1)",
        f"""loop AS (
  SELECT 1 AS phase, {digest} AS digest, {all_fits} FROM w
  UNION ALL
  SELECT CASE WHEN digest = old THEN phase + 1 ELSE phase END, digest, {columns} FROM (
    SELECT phase, old, {digest} AS digest, {all_fits} FROM (
      SELECT phase, old, sample_id, {placed} FROM (
        {scored("(SELECT *, digest AS old FROM loop)", "phase < 3")}))
    GROUP BY phase, old))""",
        "last AS (SELECT * REPLACE (2 AS phase) FROM loop WHERE phase = 3)",
        f"settled AS (SELECT sample_id, {placed} FROM ({scored('last', 'true')}))",
        "long AS (" + " UNION ALL ".join(f"SELECT {k} AS slot, x{k} AS x, y{k} AS y FROM settled" for k in slots) + ")",
    ]
    return query(parts, """SELECT CAST(slot AS INTEGER) AS slot, round(count(x) / count(*), 6) AS presence,
       round(avg(x), 6) AS mean_p0, round(avg(y), 6) AS mean_p1,
       (SELECT count(*) FROM loop WHERE phase = 1) AS uni_steps, (SELECT count(*) FROM loop WHERE phase = 2) AS mv_steps
FROM long GROUP BY slot""").replace("WITH ", "WITH RECURSIVE ", 1)


# ---- files and index helpers ----------------------------------------------------------------

ORDER_VECTORS = """
  SELECT o_orderkey AS sample_id, round(o_totalprice * 100) / 100 AS price, CAST(o_custkey AS DOUBLE) AS customer,
         CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'F' THEN 2 ELSE 3 END AS sources,
         row_number() OVER (ORDER BY o_orderkey) - 1 AS id
  FROM orders"""

VECTOR_ENTRY = ("CASE r.range WHEN 0 THEN price WHEN 1 THEN price * 2 ELSE price * 4 END AS p0, "
                "CASE r.range WHEN 0 THEN customer WHEN 1 THEN customer + 1 ELSE customer + 2 END AS p1")


def vector_query(number: str, filled: bool, where: str = "true") -> str:
    rows = f"SELECT {number} AS sample_id, CAST(r.range AS INTEGER) AS slot, sources, id, {VECTOR_ENTRY} " \
           f"FROM ({ORDER_VECTORS}) CROSS JOIN range(3) r"
    show = "CASE WHEN slot < sources THEN {0} END AS {0}" if not filled else "{0}"
    return f"SELECT sample_id, slot, {show.format('p0')}, {show.format('p1')} FROM ({rows}) WHERE {where}"


DIMENSION_STACK = f"""
WITH e AS ({LINES}),
packed AS (SELECT sample_id, count(*) OVER (PARTITION BY sample_id) AS sources,
                  row_number() OVER (PARTITION BY sample_id ORDER BY slot) - 1 AS place, p0, p1, p2 FROM e),
stack AS (SELECT sample_id, row_number() OVER (ORDER BY sources, sample_id) - 1 AS id
          FROM (SELECT DISTINCT sample_id, sources FROM packed)),
kept AS (SELECT sample_id, (id - 5) // 2 AS id FROM stack WHERE id >= 5 AND (id - 5) % 2 = 0)
SELECT k.id AS sample_id, CAST(r.range AS INTEGER) AS slot, p0, p1, p2
FROM kept k CROSS JOIN range(7) r LEFT JOIN packed p ON p.sample_id = k.sample_id AND p.place = r.range"""

LINE_VALUES = [f"CAST({CENTS.format(c)} AS DOUBLE) / 100" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")] + [
    f"CAST({c} AS DOUBLE)" for c in ("l_linenumber", "l_suppkey", "l_orderkey", "l_partkey")]

DIMENSION_FOLDER = f"""
WITH lines AS (SELECT l_orderkey AS sample_id, [{', '.join(LINE_VALUES)}] AS v FROM lineitem),
packed AS (SELECT sample_id, v, count(*) OVER (PARTITION BY sample_id) AS sources,
                  row_number() OVER (PARTITION BY sample_id ORDER BY v) - 1 AS place FROM lines),
kept AS (SELECT sample_id, sources FROM (
           SELECT sample_id, sources, count(*) OVER (PARTITION BY sources) AS samples
           FROM (SELECT DISTINCT sample_id, sources FROM packed)) WHERE samples > 8),
stack AS (SELECT sample_id, row_number() OVER (ORDER BY sources, sample_id) - 1 AS id FROM kept),
width AS (SELECT max(sources) AS most FROM kept)
SELECT (s.id - 3) // 2 AS sample_id, CAST(r.range AS INTEGER) AS slot,
       {', '.join(f'coalesce(v[{i + 1}], -1) AS p{i}' for i in range(8))}
FROM stack s CROSS JOIN width w JOIN range(1000) r ON r.range < w.most
LEFT JOIN packed p ON p.sample_id = s.sample_id AND p.place = r.range
WHERE s.id >= 3 AND (s.id - 3) % 2 = 0"""

LINE_CHAIN = chain_parts(LINES, 7)
FLAG_UNI = uni_fit_part("fit", "e", 1, 3, 2)
FLAG_MV = mv_fit_part("fit", "e", [0, 1], 3)
LINE_MV = mv_fit_part("fit", "e", [0, 1, 2], 7)
EMBEDDED_MV = mv_fit_part("fit", "e", list(range(8)), 10)


def prob_query(slots: int) -> str:
    return query([*LINE_CHAIN, mv_fit_part("fit", "e", [0], slots)],
                 "SELECT label AS slot, round(prob, 6) AS prob FROM fit")


def uni_query(slots: int) -> str:
    return query([*LINE_CHAIN, uni_fit_part("fit", "e", 1, slots, 3)],
                 "SELECT label AS slot, round(m0, 6) AS mean, round(sqrt(c00), 6) AS std FROM fit")


def mv_query(source: str, fit: str, width: int, slots: int, extra: str = "") -> str:
    return query([*chain_parts(source, slots), fit], f"SELECT label AS slot, {fit_columns(width)}{extra} FROM fit")


ORACLES: dict[str, str] = {
    "chain_long": query(LINE_CHAIN, full_rows("e", 3)),
    "chain_wide_flat": query(LINE_CHAIN, "SELECT sample_id, " + ", ".join(
        f"max(p{p}) FILTER (slot = {s}) AS s{s}p{p}" for s in range(7) for p in range(3))
        + " FROM e GROUP BY sample_id"),
    "chain_shape": query(LINE_CHAIN, "SELECT (SELECT n FROM n) AS samples, "
                                     "(SELECT count(DISTINCT slot) FROM g) AS sources, 3 AS params"),
    "burn_thin": query(dense(LINE_CHAIN), dense_rows(3, "id >= 100 AND (id - 100) % 3 = 0", "(id - 100) // 3")),
    "expand_slots": query(chain_parts(LINES, 9), full_rows("e", 3)),
    "slot_projection": query(LINE_CHAIN, "SELECT sample_id, p1 AS value FROM g LEFT JOIN e "
                                         "USING (sample_id, slot) WHERE slot = 2"),
    "complete_rows": query(chain_parts(DISCOUNTED, 3),
                           "SELECT sample_id, slot, p0, p1 FROM e WHERE p0 IS NOT NULL AND p1 IS NOT NULL"),
    "parameter_rows": query(chain_parts(DISCOUNTED, 3), "SELECT sample_id, slot, p1 FROM e WHERE p1 IS NOT NULL"),
    "randomize_entries": query([*LINE_CHAIN, shuffled(7, 3, 7)], full_rows("s", 3)),
    "reorder_entries": query(LINE_CHAIN, "SELECT sample_id, 6 - slot AS slot, p0, p1, p2 FROM g "
                                         "LEFT JOIN e USING (sample_id, slot)"),
    "inclusion_prob": prob_query(7),
    "inclusion_prob_narrow": prob_query(3),
    "inclusion_prob_expanded": prob_query(9),
    "uni_fit": uni_query(7),
    "uni_fit_fallback": uni_query(9),
    "mv_fit": mv_query(LINES, LINE_MV, 3, 7),
    "mv_fit_fallback": mv_query(LINES, mv_fit_part("fit", "e", [0, 1, 2], 9), 3, 9),
    "mv_fit_partial": mv_query(DISCOUNTED, FLAG_MV, 2, 3),
    "mv_fit_wide": mv_query(EMBEDDED, EMBEDDED_MV, 8, 10),
    "fit_and_prob": mv_query(DISCOUNTED, FLAG_MV, 2, 3, ", round(prob, 6) AS prob"),
    "uni_logpdf": density_query(FLAGS, 3, [1], FLAG_UNI),
    "mv_logpdf": density_query(FLAGS, 3, [0, 1], FLAG_MV),
    "mv_logpdf_partial": density_query(DISCOUNTED, 3, [0, 1], FLAG_MV),
    "mv_logpdf_wide": density_query(EMBEDDED, 10, list(range(8)), EMBEDDED_MV),
    "uni_cost_matrix": cost_query(FLAGS, 3, [1], FLAG_UNI),
    "mv_cost_matrix": cost_query(FLAGS, 3, [0, 1], FLAG_MV),
    "mv_cost_matrix_s7": cost_query(LINES, 7, [0, 1, 2], LINE_MV),
    "assign_s2": assignment_query(STATUS, 2, [0, 1], mv_fit_part("fit", "e", [0, 1], 2), compared_orders),
    "assign_s3": assignment_query(FLAGS, 3, [0, 1], FLAG_MV, compared_orders),
    "assign_s3_uni": assignment_query(FLAGS, 3, [1], FLAG_UNI, compared_orders),
    "assign_s7": assignment_query(LINES, 7, [0, 1, 2], LINE_MV, label_sets),
    "assign_s10": assignment_query(PARTS, 10, [0, 1], mv_fit_part("fit", "e", [0, 1], 10), label_sets),
    "relabel_once": relabel_query(FLAGS, 3, 2, ["mv"], compared_orders),
    "mean_cost": query([*chain_parts(FLAGS, 3), *iterations("e", ["mv"], 3, 2, compared_orders)[0],
                        cost_part("_0", "e", 3)], "SELECT round(cost, 6) AS mean_cost FROM cost_0"),
    "relabel_uni_k3": relabel_query(FLAGS, 3, 2, ["uni"] * 3, compared_orders),
    "relabel_mv_k3": relabel_query(FLAGS, 3, 2, ["mv"] * 3, compared_orders),
    "relabel_mv_trace": trace_query(),
    "robust_fit": query([*LINE_CHAIN, robust_fit_part("fit", "e", [0, 1, 2], 9)], "SELECT label AS slot, " + ", ".join(
        f"round(m{i}, 6) AS m{i}, round(s{i}, 6) AS s{i}" for i in range(3)) + " FROM fit"),
    "assign_s7_robust": query([*LINE_CHAIN, robust_fit_part("fit", "e", [0, 1, 2], 7), *robust_scored("", "e", [0, 1, 2], "fit"),
                               *label_sets("", 7)],
                              "SELECT sample_id, slot, label, round(score, 6) AS score FROM score JOIN best USING (sample_id) "
                              "WHERE labels[slot + 1] = label"),
    "relabel_robust_k3": relabel_query(FLAGS, 3, 2, ["robust"] * 3, compared_orders),
    "flag_catalog_k5": catalog_query(full_rows("moved_4", 2)),
    "make_catalog": settled_query("SELECT sample_id, CAST(k AS INTEGER) AS slot, CASE k WHEN 0 THEN x0 ELSE x1 END AS p0, "
                                  "CASE k WHEN 0 THEN y0 ELSE y1 END AS p1 FROM settled CROSS JOIN range(2) r(k)"),
    "source_track": settled_query("SELECT sample_id, y1 AS value FROM settled"),
    "sources_by_presence": settled_query("SELECT row_number() OVER (ORDER BY prob DESC) - 1 AS place, round(prob, 6) AS prob "
                                         "FROM (SELECT unnest([prob0, prob1]) AS prob FROM last)"),
    "catalog_to_fixed_layout": settled_query("""
SELECT CAST(k AS INTEGER) AS slot, round(CASE k WHEN 0 THEN count(x0) ELSE count(x1) END / count(*), 6) AS presence,
       round(CASE k WHEN 0 THEN avg(x0) ELSE avg(x1) END, 6) AS mean_p0,
       round(CASE k WHEN 0 THEN avg(y0) ELSE avg(y1) END, 6) AS mean_p1,
       (SELECT count(*) FROM loop WHERE phase = 1) AS uni_steps, (SELECT count(*) FROM loop WHERE phase = 2) AS mv_steps
FROM settled CROSS JOIN range(2) r(k) GROUP BY k"""),
    "catalog_of_amounts": settled_orders_query(),
    "catalog_of_line_numbers": wide_catalog_query(),
    "product_space_decode": vector_query("sample_id", filled=False),
    "fixed_decode": vector_query("sample_id", filled=True),
    "product_space_text": vector_query("id", filled=False),
    "fixed_text": vector_query("(id - 10) // 4", filled=True, where="id >= 10 AND (id - 10) % 4 = 0"),
    "dimension_stack": DIMENSION_STACK,
    "load_product_space": f"SELECT * FROM ({vector_query('id', filled=False)})".replace(
        "CASE WHEN slot < sources THEN p0 END", "CASE WHEN slot < sources THEN p0 ELSE -1 END").replace(
        "CASE WHEN slot < sources THEN p1 END", "CASE WHEN slot < sources THEN p1 ELSE -1 END"),
    "load_fixed": f"""
WITH v AS ({ORDER_VECTORS})
SELECT (id - 10) // 4 AS sample_id, s.range::INTEGER AS slot, CASE s.range WHEN 0 THEN price ELSE customer + 1 END AS p0,
       CASE s.range WHEN 0 THEN customer ELSE price * 4 END AS p1, CASE s.range WHEN 0 THEN price * 2 ELSE customer + 2 END AS p2
FROM v CROSS JOIN range(2) s WHERE id >= 10 AND (id - 10) % 4 = 0""",
    "load_dimension_folder": DIMENSION_FOLDER,
    "relabel_chain_once": query(
        [*chain_parts(FLAGS, 3), *iterations("e", ["mv"], 3, 2, compared_orders)[0], cost_part("_0", "e", 3)],
        f"SELECT r.*, round(cost, 6) AS cost FROM ({full_rows('moved_0', 2)}) r CROSS JOIN cost_0"),
    "cost_matrix_narrow": query(
        [*chain_parts(DISCOUNTED, 3), FLAG_MV, *scored("", "e", [0, 1], "fit")],
        "SELECT g.sample_id, 0 AS label, g.slot, round(coalesce(score.score, ln(1 - own.prob)), 6) AS score "
        "FROM g CROSS JOIN (SELECT prob FROM fit WHERE label = 0) own LEFT JOIN score ON score.sample_id = g.sample_id "
        "AND score.slot = g.slot AND score.label = 0"),
    "feather_roundtrip": query(dense(LINE_CHAIN), dense_rows(3)),
    "parquet_roundtrip": query(LINE_CHAIN, full_rows("e", 3)),
    "fill_missing_indices": """
WITH given AS (SELECT l_orderkey AS sample_id, list_sort(list(DISTINCT l_linenumber - 1)) AS given
               FROM lineitem GROUP BY 1)
SELECT sample_id, array_to_string(list_concat(given, [i FOR i IN range(7) IF NOT list_contains(given, i)]), ',')
       AS filled FROM given""",
    "count_swaps": """
SELECT vec_id, len([z FOR z IN list_zip(embedding, list_sort(embedding)) IF z[1] <> z[2]]) // 2 AS swaps
FROM embeddings""",
    "sort_by_number": "SELECT 'chain.dat.' || p_partkey AS file, p_partkey AS number FROM part",
}
