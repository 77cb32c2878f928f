"""SQL twins of the queries that SQL can express, for DuckDB."""

from __future__ import annotations

from . import fill_middle, filter_audit
from .quality_rules import EVENTS, LEAST, LEAST_WORDS, MEASURES, MOST_REPEATED, OCCURRENCES, SPREAD


def _quality_rules() -> str:
    """Sketches hold every value of groups of this size, so thresholds are those of sorted lists."""
    word = r"[^\x20\x09-\x0D]+"
    at = lambda m, q: f"list_sort(list({m}) FILTER (WHERE NOT base_failed))[greatest(1, ceil({q} * count(*) FILTER (WHERE NOT base_failed)))::INT]"
    quantiles = ", ".join(f"{at(m, inner)} AS {m}_q1, {at(m, outer)} AS {m}_q3" for m, (inner, outer) in MEASURES.items())
    groups = {"own": "lang, source", "of_lang": "lang", "of_all": ""}
    tables = ",\n".join(f"{name} AS (SELECT {keys + ', ' if keys else ''}count(*) FILTER (WHERE NOT base_failed) AS n, {quantiles} FROM rated {'GROUP BY ' + keys if keys else ''})" for name, keys in groups.items())
    pick = lambda c: f"CASE WHEN own.n >= {LEAST} THEN own.{c} WHEN of_lang.n >= {LEAST} THEN of_lang.{c} ELSE of_all.{c} END"
    limits = ", ".join(f"{pick(f'{m}_q1')} AS {m}_q1, {pick(f'{m}_q3')} AS {m}_q3" for m in MEASURES)
    rare = lambda m: f"{OCCURRENCES[m].replace('/', '/ 1.0 /')} <= {EVENTS} OR " if m in OCCURRENCES else ""
    inside = " AND ".join(f"coalesce({rare(m)}{m} <= {m}_q3 + {SPREAD} * ({m}_q3 - {m}_q1), true)" for m in MEASURES)
    m = "word_length"
    inside += f" AND coalesce({m} >= {m}_q1 - {SPREAD} * ({m}_q3 - {m}_q1), true)"
    return rf"""WITH texts AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
worded AS (SELECT doc_id, unnest(regexp_extract_all(text, '{word}')) AS w, generate_subscripts(regexp_extract_all(text, '{word}'), 1) AS i FROM texts),
grams AS (SELECT doc_id, i, w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c FROM worded WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM grams WHERE c IS NOT NULL) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT i) AS n_repeat_words FROM again GROUP BY 1),
lined AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '{word}') GROUP BY 1),
measured AS (SELECT doc_id, lang, source, len(regexp_extract_all(text, '{word}'))::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM texts LEFT JOIN lined USING (doc_id) LEFT JOIN repeats USING (doc_id)),
rated AS (SELECT *, (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AS base_failed, n_symbols * 100.0::DOUBLE / greatest(n_words, 1) AS symbol_rate, n_dup_lines * 100.0::DOUBLE / greatest(n_lines, 1) AS dup_line_rate,
  n_repeat_words * 100.0::DOUBLE / greatest(n_words, 1) AS repeat_rate, word_chars * 1.0::DOUBLE / greatest(n_words, 1) AS word_length FROM measured),
{tables},
limits AS (SELECT own.lang AS t_lang, own.source AS t_source, {limits} FROM own JOIN of_lang ON own.lang IS NOT DISTINCT FROM of_lang.lang CROSS JOIN of_all)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND {inside}) AS kept FROM rated JOIN limits ON lang IS NOT DISTINCT FROM t_lang AND source IS NOT DISTINCT FROM t_source"""


def _fill_middle() -> str:
    p, s, m = fill_middle.PREFIX, fill_middle.SUFFIX, fill_middle.MIDDLE
    numbers = ", ".join(f"('0x' || d[{8 * i + 1}:{8 * i + 8}])::UBIGINT::BIGINT AS h{i + 1}" for i in range(4))
    return rf"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{fill_middle.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
drawn AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, {numbers} FROM texts),
placed AS (SELECT *, len(units)::BIGINT AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS low, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS high,
  CASE WHEN text = '' OR contains(text, '{p}') OR contains(text, '{s}') OR contains(text, '{m}') OR h3 % 100 >= {fill_middle.RATE} THEN 'plain' WHEN h4 % 100 < {fill_middle.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
cut AS (SELECT *, array_to_string(units[1:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle, array_to_string(units[high + 1:], '') AS suffix FROM placed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{p}' || prefix || '{s}' || suffix || '{m}' || middle ELSE '{s}' || suffix || '{p}' || prefix || '{m}' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM cut"""


def _filter_audit() -> str:
    names = filter_audit.FILTERS
    space = filter_audit.SPACE
    bits = " + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate((
        f"n < {filter_audit.LEAST_WORDS}", f"100 * len(list_distinct(words)) < {filter_audit.LEAST_DISTINCT} * n", f"100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {filter_audit.MOST_CAPITALS} * length(text)",
        f"regexp_matches(text, '{filter_audit.SYMBOLS}')", "least < doc_id",
    )))
    tables = ", ".join(f"filters f{i}" for i in range(len(names)))
    distinct = " AND ".join(f"f{i}.f <> f{j}.f" for i in range(len(names)) for j in range(i))
    return rf"""WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
worded AS (SELECT *, regexp_extract_all(text, '[^{space}]+') AS words, len(regexp_extract_all(text, '[^{space}]+')) AS n, min(doc_id) OVER (PARTITION BY text) AS least FROM texts),
masked AS (SELECT doc_id, part, {bits} AS mask FROM worded),
marked AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
cells AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM masked LEFT JOIN marked USING (doc_id) GROUP BY 1, 2),
filters AS (SELECT f, (1 << f) AS bit, substr('{names}', f + 1, 1) AS name FROM (SELECT unnest(range({len(names)}))::INT AS f)),
orders AS (SELECT {" || ".join(f"f{i}.name" for i in range(len(names)))} AS filter_order FROM {tables} WHERE {distinct}),
steps AS (SELECT filter_order, step, bit, list_sum(list_transform(string_split(filter_order[1:step - 1], ''), lambda c: CASE WHEN c = '' THEN 0 ELSE 1 << (instr('{names}', c) - 1) END))::INT AS before
  FROM (SELECT filter_order, unnest(range(1, {len(names) + 1}))::INT AS step FROM orders) JOIN filters ON name = filter_order[step]),
counted AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (coalesce(before, 0) | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit > 0 AND mask & coalesce(before, 0) = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & bit > 0 AND mask & coalesce(before, 0) > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & bit > 0 AND mask & coalesce(before, 0) = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit > 0 AND mask & coalesce(before, 0) = 0 THEN toxic ELSE 0 END) AS toxic_lost FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM counted"""


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": _quality_rules(), "op11_fill_middle": _fill_middle(), "op12_filter_audit": _filter_audit()}
