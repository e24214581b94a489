"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from granary.llm.license_scan import ENDS, RULES, hint_pattern, known_sentences

_EXACT = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

_QUALITY = r"""
WITH split AS (
    SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS body,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents
), places AS (
    SELECT r, unnest(range(1, len(words) - 6)) AS p, words FROM split WHERE len(words) >= 8
), named AS (
    SELECT r, p, list_slice(words, p, p + 7) AS win FROM places
), again AS (
    SELECT r, p FROM named QUALIFY count(*) OVER (PARTITION BY r, win) > 1
), covered AS (
    SELECT r, count(DISTINCT p + k) AS n FROM again, range(0, 8) t(k) GROUP BY r
), counted AS (
    SELECT doc_id, len(words)::BIGINT AS n_words,
           length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
           length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
           (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
           coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
           len(lines) AS n_lines,
           len(list_filter(words, lambda w: strlen(w) > 1 AND regexp_matches(w, '[A-Z]') AND NOT regexp_matches(w, '[a-z]'))) AS n_upper,
           len(list_filter(range(2, len(words) + 1), lambda k: words[k] = words[k - 1])) AS n_echo
    FROM split LEFT JOIN covered USING (r)
), judged AS (
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed
            OR 10 * n_symbols > n_words
            OR 2 * n_upper > n_words
            OR word_chars < 2 * n_words OR word_chars > 12 * n_words
            OR (n_lines >= 4 AND 2 * n_dup_lines > n_lines)
            OR 10 * n_echo > 3 * n_words) AS kept
FROM judged
"""


_CONTAMINATION = r"""
WITH item AS (
    SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM benchmark
), sized AS (
    SELECT item_id, words, least(len(words), 10) AS size FROM item WHERE len(words) > 0
), placed AS (
    SELECT item_id, words, size, unnest(range(1, len(words) - size + 2)) AS p FROM sized
), wanted AS (
    SELECT DISTINCT item_id, size, list_slice(words, p, p + size - 1) AS win FROM placed
), doc AS (
    SELECT doc_id, row_number() OVER () AS r,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
), spots AS (
    SELECT r, words, size, unnest(range(1, len(words) - size + 2)) AS p
    FROM doc, (SELECT DISTINCT size FROM wanted) WHERE len(words) >= size
), met AS (
    SELECT r, p, size, item_id
    FROM (SELECT r, p, size, list_slice(words, p, p + size - 1) AS win FROM spots) JOIN wanted USING (size, win)
), hit AS (
    SELECT r, count(DISTINCT p + k) AS n
    FROM (SELECT DISTINCT r, p, size FROM met), range(0, 10) t(k) WHERE k < size GROUP BY r
), named AS (
    SELECT r, count(*) AS n, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS digest
    FROM (SELECT DISTINCT r, item_id FROM met) GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit,
       coalesce(named.n, 0)::BIGINT AS n_items, coalesce(digest, sha256('')) AS items_sha256,
       coalesce(hit.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

_AUDIT = r"""
WITH marks AS (
    SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
    FROM labels GROUP BY doc_id
), doc AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
           coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS e
    FROM documents
), judged AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
           len(words) < 50 AS a,
           100 * len(list_distinct(words)) < 65 * len(words) AS b,
           100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 5 * length(body) AS c,
           regexp_matches(body, '[#$%&*|]') AS d, e
    FROM doc LEFT JOIN marks USING (doc_id)
), counted AS (
    SELECT part, a, b, c, d, e, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic,
           concat(CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END,
                  CASE WHEN d THEN 'D' END, CASE WHEN e THEN 'E' END) AS fails
    FROM judged GROUP BY ALL
), letter AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
    SELECT p.x || q.x || r.x || s.x || t.x AS filter_order
    FROM letter p JOIN letter q ON q.x <> p.x JOIN letter r ON r.x NOT IN (p.x, q.x)
    JOIN letter s ON s.x NOT IN (p.x, q.x, r.x) JOIN letter t ON t.x NOT IN (p.x, q.x, r.x, s.x)
), steps AS (
    SELECT filter_order, unnest(range(1, 6))::INTEGER AS step FROM orders
), sums AS (
    SELECT part, filter_order, step, substr(filter_order, step, 1) AS x,
           translate(fails, substr(filter_order, 1, step), '') = fails AS passes,
           translate(fails, substr(filter_order, 1, step - 1), '') = fails AS reached, fails, n, n_good, n_toxic
    FROM counted, steps
), audit AS (
    SELECT part, filter_order, step, x,
           coalesce(sum(n) FILTER (passes), 0)::BIGINT AS kept,
           coalesce(sum(n) FILTER (reached AND NOT passes), 0)::BIGINT AS removed,
           coalesce(sum(n) FILTER (NOT reached AND contains(fails, x)), 0)::BIGINT AS redundant,
           coalesce(sum(n) FILTER (fails = x), 0)::BIGINT AS unique_fails,
           coalesce(sum(n_good) FILTER (reached AND NOT passes), 0)::BIGINT AS good_lost,
           coalesce(sum(n_toxic) FILTER (reached AND NOT passes), 0)::BIGINT AS toxic_lost
    FROM sums GROUP BY part, filter_order, step, x
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, x)::BIGINT AS shapley
FROM audit
"""


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _licenses() -> str:
    """One common table per rule cuts its sequence out, as the rules come in order."""
    known = ", ".join(f"({_text(k)}, {_text(v)})" for k, v in sorted(known_sentences().items()))
    steps, last = [], "joined"
    for k, (name, sequence) in enumerate(RULES):
        seq = _text("|" + "|".join(sequence) + "|")
        steps.append(
            f"s{k} AS MATERIALIZED (SELECT r, replace(replace(rest, {seq}, '|'), {seq}, '|') AS rest, CASE WHEN contains(rest, {seq}) "
            f"AND NOT list_contains(names, {_text(name)}) THEN list_append(names, {_text(name)}) ELSE names END AS names FROM {last})"
        )
        last = f"s{k}"
    norm = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
    return rf"""
WITH known(sentence, id) AS (VALUES {known}),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body FROM documents),
sentences AS (
    SELECT r, generate_subscripts(x, 1) AS k, unnest(x) AS sentence
    FROM (SELECT r, string_split(regexp_replace(body, {_text(ENDS)}, '\1' || chr(1), 'g'), chr(1)) AS x
          FROM docs WHERE regexp_matches(lower(body), {_text(hint_pattern(known_sentences()))}))
), whole AS (
    SELECT r, k, sentence, id FROM sentences LEFT JOIN known ON known.sentence = {norm.format("sentences.sentence")}
), lines AS (
    SELECT r, k, generate_subscripts(x, 1) AS l, unnest(x) AS line
    FROM (SELECT r, k, string_split(sentence, chr(10)) AS x FROM whole WHERE id IS NULL)
), found AS (
    SELECT r, k, 0 AS l, id FROM whole WHERE id IS NOT NULL
    UNION ALL
    SELECT r, k, l, id FROM lines JOIN known ON known.sentence = {norm.format("line")}
), listed AS (
    SELECT r, list(id ORDER BY k, l) AS ids FROM found GROUP BY r
), joined AS (
    SELECT r, '|' || array_to_string(list_transform(ids, lambda x: x || '|'), '') AS rest, []::VARCHAR[] AS names FROM listed
), {", ".join(steps)}
SELECT docs.doc_id, coalesce(array_to_string({last}.names, ','), '') AS licenses,
       coalesce(len(listed.ids), 0)::BIGINT AS n_sentences,
       coalesce(array_to_string(listed.ids, ','), '') AS sentences,
       coalesce(trim({last}.rest, '|'), '') AS unresolved
FROM docs LEFT JOIN listed USING (r) LEFT JOIN {last} USING (r)
""".replace(" sentence, id FROM sentences LEFT", " sentences.sentence, id FROM sentences LEFT")


ORACLES: dict[str, str] = {
    "op2_quality_rules": _QUALITY,
    "op4_exact_dedup": _EXACT,
    "op7_license_scan": _licenses(),
    "op11_contamination": _CONTAMINATION,
    "op12_filter_audit": _AUDIT,
}
