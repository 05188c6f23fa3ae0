"""DuckDB SQL for the operators' queries that SQL can express."""

from __future__ import annotations

from tidemark.llm import licenses
from tidemark.llm.quality import BOILERPLATE, WINDOW as REPEAT, Rules
from tidemark.llm.substrings import WINDOW

WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"


def embeddings() -> str:
    return """
    WITH RECURSIVE v AS (SELECT DISTINCT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
    reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    least AS (SELECT a, min(b) AS component FROM reach GROUP BY a), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT x.vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component, x.vec_id)::BIGINT AS component_id, coalesce(x.vec_id = coalesce(component, x.vec_id), true) AS kept,
      CASE WHEN x.label IN (SELECT label FROM links JOIN v ON v.vec_id = links.a WHERE a % 100 = 0) THEN 1.0::DOUBLE END AS audited_recall
    FROM embeddings x LEFT JOIN counts ON counts.a = x.vec_id LEFT JOIN least ON least.a = x.vec_id
    """


def quality(rules: Rules = Rules()) -> str:
    phrases = "|".join(p.replace("'", "''") for p in BOILERPLATE)
    count = lambda pattern, full=False: f"len(list_filter(w, lambda x: regexp_{'full_match' if full else 'matches'}(x, '{pattern}')))"
    marks = "[#*$%&<>]{2,}"
    marked = f"({count(marks + '$')} + {count('^' + marks)} - {count(marks, True)})"
    separators = r"[|>»›·•/\\]|--+"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), t AS (SELECT doc_id, text, {WORDS} AS w FROM d),
    base AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols FROM t),
    windows AS (SELECT doc_id, s, md5(array_to_string(list_slice(w, s, s + {REPEAT - 1}), ' ')) AS h FROM t, LATERAL (SELECT unnest(range(1, len(w) - {REPEAT - 2})) AS s) r),
    flags AS (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, h) > 1 AS f FROM windows),
    places AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS s FROM t),
    covered AS (SELECT doc_id, coalesce(bool_or(f) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN {REPEAT - 1} PRECEDING AND CURRENT ROW), false) AS c FROM places LEFT JOIN flags USING (doc_id, s)),
    repeats AS (SELECT doc_id, count(*) FILTER (c) AS n_repeat_words FROM covered GROUP BY doc_id),
    lines AS (SELECT doc_id, line, pos, {WORDS.replace("text", "line")} AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d)),
    judged AS (SELECT doc_id, line, pos, len(w) AS n, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS again,
      (len(w) >= {rules.min_line_words} AND ({marked} > {rules.max_marked}::DOUBLE * len(w) OR {count("[!?]{2,}$")} > {rules.max_shouted}::DOUBLE * len(w) OR {count(separators, True)} > {rules.max_separators}::DOUBLE * len(w)
        OR len(list_filter(range(2, len(w) + 1), lambda k: w[k] = w[k - 1])) > {rules.max_stuttered}::DOUBLE * len(w))) OR (len(w) <= {rules.furniture_words} AND regexp_matches(lower(line), '{phrases}')) AS failed FROM lines WHERE len(w) > 0),
    lost AS (SELECT doc_id, count(*) FILTER (again) AS n_dup_lines, count(*) FILTER (failed) AS n_failed_lines, coalesce(sum(n) FILTER (failed), 0)::BIGINT AS n_lost_words FROM judged GROUP BY doc_id),
    left_over AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY lines.pos) AS clean FROM lines LEFT JOIN (SELECT doc_id, pos, failed FROM judged) j USING (doc_id, pos) WHERE NOT coalesce(failed, false) GROUP BY doc_id),
    every AS (SELECT base.*, sha256(coalesce(clean, '')) AS clean_sha256, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_failed_lines, 0) AS n_failed_lines, coalesce(n_lost_words, 0) AS n_lost_words FROM base LEFT JOIN repeats USING (doc_id) LEFT JOIN lost USING (doc_id) LEFT JOIN left_over USING (doc_id)),
    verdict AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed FROM every)
    SELECT *, NOT base_failed AND n_lost_words <= {rules.max_lost}::DOUBLE * n_words AS kept FROM verdict
    """


def substrings() -> str:
    return f"""
    WITH t AS (SELECT doc_id, {WORDS.replace("text", "coalesce(text, '')")} AS w FROM documents),
    windows AS (SELECT doc_id, s, md5(array_to_string(list_slice(w, s, s + {WINDOW - 1}), ' ')) AS h FROM t, LATERAL (SELECT unnest(range(1, len(w) - {WINDOW - 2})) AS s) r),
    flags AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY h) < doc_id AS f FROM windows),
    places AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS s FROM t),
    covered AS (SELECT doc_id, s, word, coalesce(bool_or(f) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW), false) AS c FROM places LEFT JOIN flags USING (doc_id, s)),
    kept AS (SELECT doc_id, count(*) FILTER (c) AS n_removed, string_agg(word, ' ' ORDER BY s) FILTER (NOT c) AS kept FROM covered GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN kept USING (doc_id)
    """


def negatives() -> str:
    return """
    WITH known AS (SELECT vec_id, label::BIGINT AS label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR abs(x::DOUBLE * 256) >= 67108864)) = 0),
    r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, v FROM known QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, v) = 1),
    s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.id <> b.id WHERE a.id % 100 = 0),
    p AS (SELECT a, b AS p, score AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
    SELECT p.a AS anchor_id, p AS positive_id, row_number() OVER (PARTITION BY p.a, p ORDER BY score DESC, b)::INTEGER AS rank, b AS negative_id, ps AS positive_score, score AS negative_score
    FROM p JOIN s ON s.a = p.a WHERE NOT same AND 30 * ps <= 100 * score AND 100 * score <= 90 * ps QUALIFY row_number() OVER (PARTITION BY p.a, p ORDER BY score DESC, b) <= 10
    """


def phrases() -> str:
    return r"""
    WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text, row_number() OVER () AS row FROM documents),
    pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    words AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
    grams AS (SELECT lang, array_to_string(list_slice(w, s, s + m - 1), ' ') AS phrase, m, count(*) AS f FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS s FROM w) t, (VALUES (1), (2), (3), (4), (5)) k(m) WHERE s + m - 1 <= len(w) GROUP BY ALL),
    frequent AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE f >= 100),
    cand AS (SELECT * FROM frequent WHERE m > 1),
    cuts AS (SELECT lang, phrase, m, a, k, array_to_string(list_slice(w, 1, k), ' ') AS lp, array_to_string(list_slice(w, k + 1, m), ' ') AS rp FROM (SELECT *, unnest(range(1, m)) AS k FROM cand) t),
    scored AS (SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, n, ((1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score FROM cuts c JOIN frequent x ON x.lang = c.lang AND x.phrase = lp JOIN frequent y ON y.lang = c.lang AND y.phrase = rp JOIN words ON words.lang = c.lang),
    lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inner_ AS (SELECT lang, array_to_string(list_slice(w, s, s + z - 1), ' ') AS phrase, a FROM (SELECT *, unnest(range(1, m - z + 2)) AS s FROM (SELECT *, unnest(range(2, m)) AS z FROM cand) t) t),
    kept AS (SELECT l.* FROM lowest l WHERE NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.lang = l.lang AND i.phrase = l.phrase AND 100 * i.a >= 100 * l.a))
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
    """


ORACLES = {"op2_embeddings": embeddings(), "op5_quality": quality(), "op7_licenses": licenses.oracle_sql(), "op9_substrings": substrings(), "op11_negatives": negatives(), "op12_phrases": phrases()}
