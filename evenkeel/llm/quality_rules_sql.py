"""The quality rules in SQL: counts per document, and the robust estimate step by step."""

from __future__ import annotations

from evenkeel.llm import quality_rules as q

D, PAIRS = q.D, q.PAIRS
MOMENTS = [*q.MEANS, *q.COVARIANCES]
STEPS = 14  # more than the given tables need; a step that lowers no determinant changes nothing
GROUP = "lang, part, start"


def _same(a: str, b: str, start: bool = True) -> str:
    return f"{a}.lang IS NOT DISTINCT FROM {b}.lang AND {a}.part = {b}.part" + (f" AND {a}.start = {b}.start" if start else "")


SPACE = r"\x20\x09-\x0D"


def _core(name: str, rows: str, distance: str) -> str:
    """The closest half of every group and start of ``rows``, by whole bins of distance."""
    return f"""
{name}_b AS MATERIALIZED (SELECT *, floor(log2({distance} + 1e-6) * {q.OCTAVE})::BIGINT AS bin FROM {rows}),
{name}_n AS (SELECT {GROUP}, bin, count(*) AS n FROM {name}_b GROUP BY ALL),
{name}_w AS (SELECT {GROUP}, bin, sum(n) OVER (PARTITION BY {GROUP} ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {GROUP}) AS alln FROM {name}_n),
{name}_l AS (SELECT {GROUP}, min(bin) AS last FROM {name}_w WHERE upto >= least((alln + {len(q.STATS) + 1}) / 2.0, alln) GROUP BY ALL),
{name} AS MATERIALIZED (SELECT b.lang, b.part, b.start, {', '.join('b.' + s for s in q.STATS)} FROM {name}_b b JOIN {name}_l l ON {_same('b', 'l')} WHERE b.bin <= l.last),"""


def _factored(name: str, rows: str, keep: str) -> str:
    """``rows`` with the Cholesky factor of their covariances and the logarithm of the determinant."""
    out, last = "", rows
    for i, j in PAIRS:
        left = f"c{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        out += f"\n{name}_{i}{j} AS (SELECT *, {f'sqrt({left})' if i == j else f'({left}) / l{j}{j}'} AS l{i}{j} FROM {last}),"
        last = f"{name}_{i}{j}"
    log_det = " + ".join(f"2 * ln(l{i}{i})" for i in D)
    return out + f"\n{name} AS MATERIALIZED (SELECT {keep}, {', '.join([*MOMENTS, *q.FACTORS])}, {log_det} AS log_det FROM {last}),"


def _estimate(name: str, core: str) -> str:
    floors = [q.FLOORS[s] for s in q.STATS]
    sums = ", ".join([f"avg(x{i}) AS m{i}" for i in D] + [f"avg(x{i} * x{j}) AS s{i}{j}" for i, j in PAIRS])
    covs = ", ".join(f"{q.CONSISTENCY!r} * (s{i}{j} - m{i} * m{j}) + {floors[i] ** 2 if i == j else 0.0!r} AS c{i}{j}" for i, j in PAIRS)
    out = f"\n{name}_s AS (SELECT {GROUP}, {sums} FROM {core} GROUP BY ALL),\n{name}_c AS (SELECT *, {covs} FROM {name}_s),"
    return out + _factored(name, f"{name}_c", GROUP)


def _distance(name: str, rows: str, estimate: str, start: bool = True) -> str:
    """``rows`` with the squared distance to the estimate of their group."""
    used = ", ".join(f"e.{c}" for c in [*q.MEANS, *q.FACTORS])
    out = f"\n{name}_0 AS (SELECT r.*, {used} FROM {rows} r LEFT JOIN {estimate} e ON {_same('r', 'e', start)}),"
    for i in D:
        z = f"x{i} - m{i}" + "".join(f" - l{i}{k} * z{k}" for k in range(i))
        out += f"\n{name}_{i + 1} AS (SELECT *, ({z}) / l{i}{i} AS z{i} FROM {name}_{i}),"
    keep = ", ".join([*q.MEANS, *q.FACTORS, *(f"z{i}" for i in D)])
    return out + f"\n{name} AS MATERIALIZED (SELECT * EXCLUDE ({keep}), {' + '.join(f'z{i} * z{i}' for i in D)} AS distance FROM {name}_{len(D)}),"


def _median(name: str, rows: str, values: dict[str, str]) -> str:
    """One row per group: the median bin of each value."""
    out = ""
    for alias, value in values.items():
        out += f"""
{name}_{alias}_n AS (SELECT lang, part, floor({value} * {q.BINS})::BIGINT AS bin, count(*) AS n FROM {rows} GROUP BY ALL),
{name}_{alias}_w AS (SELECT *, sum(n) OVER (PARTITION BY lang, part ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY lang, part) AS alln FROM {name}_{alias}_n),
{name}_{alias} AS (SELECT lang, part, (min(bin) + 0.5) / {q.BINS} AS {alias} FROM {name}_{alias}_w WHERE upto * 2 >= alln GROUP BY ALL),"""
    first, *rest = values
    joins = " ".join(f"JOIN {name}_{a} t{a} ON t{first}.lang IS NOT DISTINCT FROM t{a}.lang AND t{first}.part IS NOT DISTINCT FROM t{a}.part" for a in rest)
    return out + f"\n{name} AS MATERIALIZED (SELECT t{first}.lang, t{first}.part, {', '.join(values)} FROM {name}_{first} t{first} {joins}),"


def with_verdicts(docs: str) -> str:
    """CTEs up to ``verdicts``: the columns of ``docs`` with counts, base_failed and kept. The
    documents' ids must be unique."""
    parts = [f"(pow(abs(x{k} - med{k}), 2) / (pow(mad{k} * 1.4826, 2) + {q.FLOORS[s] ** 2!r}))" for k, s in enumerate(q.STATS)]
    plain = [f"pow(abs(x{k} - med{k}) / {q.FLOORS[s]!r}, 2)" for k, s in enumerate(q.STATS)]
    begun = [" + ".join(parts), f"greatest({', '.join(parts)})", " + ".join(plain)]
    same = lambda a, b: _same(a, b, False)
    sql = f"""
split AS MATERIALIZED (SELECT *, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS lines FROM {docs}),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM split),
hits AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS times FROM windows),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM hits WHERE times > 1) GROUP BY doc_id),
counted AS (SELECT split.* EXCLUDE (t, w, lines), len(w)::BIGINT AS n_words, length(regexp_replace(t, '[{SPACE}]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(repeated.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines FROM split LEFT JOIN repeated USING (doc_id)),
measured AS MATERIALIZED (SELECT *, ln(greatest(word_chars, 1) / greatest(n_words, 1)::DOUBLE) AS x0, ln(1 + n_symbols / greatest(n_words, 1)::DOUBLE) AS x1,
  n_repeat_words / greatest(n_words, 1)::DOUBLE AS x2, n_dup_lines / greatest(n_lines, 1)::DOUBLE AS x3,
  n_words < {q.LEAST_WORDS} OR 100 * n_repeat_words > {q.MOST_REPEATED} * n_words AS base_failed FROM counted),
parted AS MATERIALIZED (SELECT *, coalesce('=' || source, '{q.NULL_SOURCE}') AS part FROM measured),
rows0 AS MATERIALIZED (SELECT lang, unnest(['{q.ALL}', part]) AS part, {', '.join(q.STATS)} FROM parted WHERE NOT base_failed),
sizes AS (SELECT lang, part, count(*) AS n FROM rows0 GROUP BY ALL),
starts AS (SELECT r.*, s.start FROM rows0 r, (SELECT unnest(range({q.STARTS})) AS start) s),"""
    sql += _median("med", "rows0", {f"med{k}": f"x{k}" for k in D})
    sql += f"\ncentred AS (SELECT r.*, {', '.join(f'med{k}' for k in D)} FROM rows0 r JOIN med ON {same('r', 'med')}),"
    sql += _median("mad", "centred", {f"mad{k}": f"abs(x{k} - med{k})" for k in D})
    sql += f"\nspread AS MATERIALIZED (SELECT c.*, {', '.join(f'mad{k}' for k in D)} FROM centred c JOIN mad ON {same('c', 'mad')}),"
    sql += "\nbegun AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT *, {i} AS start, {d} AS distance FROM spread" for i, d in enumerate(begun)) + "),"
    sql += _core("core0", "begun", "distance") + _estimate("est0", "core0")
    for step in range(STEPS):
        sql += _distance(f"dist{step}", "starts", f"est{step}")
        sql += _core(f"core{step + 1}", f"dist{step}", "distance") + _estimate(f"new{step + 1}", f"core{step + 1}")
        taken = ", ".join(f"CASE WHEN n.log_det < e.log_det - {q.FALL!r} THEN n.{c} ELSE e.{c} END AS {c}" for c in [*MOMENTS, *q.FACTORS, "log_det"])
        sql += f"\nest{step + 1} AS MATERIALIZED (SELECT e.lang, e.part, e.start, {taken} FROM est{step} e JOIN new{step + 1} n ON {_same('e', 'n')}),"
    sql += f"\nbest AS MATERIALIZED (SELECT * FROM est{STEPS} QUALIFY row_number() OVER (PARTITION BY lang, part ORDER BY log_det, start) = 1),"
    drawn = ", ".join(f"w * {c} + (1 - w) * whole_{c} AS {c}" for c in MOMENTS)
    sql += f"""
weighed AS (SELECT b.*, n / (n + {q.SHRINK})::DOUBLE AS w FROM best b JOIN sizes s ON {same('b', 's')} WHERE b.part <> '{q.ALL}'),
whole AS (SELECT lang AS whole_lang, {', '.join(f'{c} AS whole_{c}' for c in MOMENTS)} FROM best WHERE part = '{q.ALL}'),
drawn AS (SELECT lang, part, {drawn} FROM weighed JOIN whole ON lang IS NOT DISTINCT FROM whole_lang),"""
    sql += _factored("shrunk", "drawn", "lang, part") + _distance("final", "parted", "shrunk", False)
    return sql + f"\nverdicts AS (SELECT *, NOT base_failed AND NOT coalesce(distance > {q.LIMIT!r}, false) AS kept FROM final)"


SQL = f"WITH {with_verdicts('documents')}\nSELECT doc_id, {', '.join(q.COUNTS)}, base_failed, kept FROM verdicts"
