"""Pieces of DuckDB SQL that several queries share."""

from __future__ import annotations

#: White space as Python sees it, as an RE2 character class body.
SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Letters and digits beyond ASCII, for which RE2's word edge is blind.
WIDE = r"[ªµºÀ-ÖØ-öø-ʯͰ-ҁҊ-՚ա-ևא-תء-يᴀ-᾿℀-⅏ⅰ-ↈⰀ-ⷿぁ-ヿ一-鿿가-힣①-⓿²³¹¼-¾٠-٩]"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '[{SPACE}]+'), lambda x: x <> '')"


def bm25(by: str, docs: str = "docs", queries: str = "q") -> str:
    """CTEs from docs(by.., id, w) and q(query_id, query) to scores(query_id, id, score)."""
    using = f"USING ({by})" if by else ""
    link = f"JOIN whole {using}" if by else "CROSS JOIN whole"
    low = f"JOIN low {using}" if by else "CROSS JOIN low"
    pre = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
 sizes AS (SELECT {pre}id, len(w) AS n FROM {docs}),
 tf AS (SELECT {pre}id, term, count(*) AS tf FROM (SELECT {pre}id, unnest(w) AS term FROM {docs}) GROUP BY ALL),
 df AS (SELECT {pre}term, count(*) AS df FROM tf GROUP BY ALL),
 whole AS (SELECT {pre}count(*) AS nd, avg(n) AS avgdl FROM sizes {group}),
 idf AS (SELECT df.*, avgdl, ln((nd - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS raw FROM df {link}),
 low AS (SELECT {pre}0.25::DOUBLE * avg(raw) AS low FROM idf {group}),
 weights AS (SELECT {'idf.' + by + ', ' if by else ''}term, avgdl, CASE WHEN raw < 0 THEN low ELSE raw END AS idf FROM idf {low}),
 asked AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest({words('lower(query)')}) AS term FROM {queries}) GROUP BY ALL),
 scores AS (SELECT {'tf.query_id' if by else 'asked.query_id'} AS query_id, tf.id, sum(qf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / avgdl))) AS score
   FROM tf JOIN weights ON tf.term = weights.term {'AND tf.query_id = weights.query_id' if by else ''} JOIN asked ON asked.term = tf.term {'AND asked.query_id = tf.query_id' if by else ''}
   JOIN sizes ON sizes.id = tf.id {'AND sizes.query_id = tf.query_id' if by else ''} GROUP BY ALL)"""


def chunks(key: str, table: str, max_chars: int = 1800, overlap: int = 200, least_words: int = 20) -> str:
    """WITH clause (recursive) to chunks(key, no from 1, chunk) of table(key, text): the rules of the chunker, one window a step."""
    blank, alnum, lead, dash = f"[{SPACE}]", r"[\p{L}\p{N}]", r"""["''`“”‘’.,;:!?)\-–—]""", "-–—"
    run = lambda at, pattern: f"length(regexp_extract(substr(p, {at} + 1), '^{pattern}+'))"
    char = lambda at: f"substr(p, {at} + 1, 1)"

    def resumed(at: str) -> str:
        """Behind the next sentence's gap before `reach`, for a lower-case start within a sentence."""
        inside = f"{at} < reach AND regexp_matches({char(at)}, '^\\p{{Ll}}') AND NOT regexp_matches({char(f'({at} - 1)')}, '^[\\n\\r.!?]')"
        gap = f"length(regexp_extract(substr(p, {at} + 1, reach - {at}), '(?s)^.*?(?:\\n|[.!?]{blank})'))"
        return f"CASE WHEN {inside} AND {gap} > 0 THEN {at} + {gap} + {run(f'({at} + {gap})', blank)} ELSE {at} END"

    return f"""WITH RECURSIVE t0 AS (SELECT {key}, {strip("replace(text, chr(13) || chr(10), chr(10))")} AS t FROM {table} WHERE text IS NOT NULL),
 pp AS (SELECT {key}, list_filter(list_transform(regexp_split_to_array(t, '\\n{blank}*\\n+'), lambda x: {strip('x')}), lambda x: x <> '') AS ps FROM t0),
 pk AS (SELECT {key}, ps, 0 AS i, 0 AS pack, 0 AS size, []::INT[] AS packs FROM pp UNION ALL
  SELECT {key}, ps, i + 1, pack + (NOT fits)::INT, CASE WHEN fits THEN size + length(x) + 2 ELSE length(x) END, list_append(packs, pack + (NOT fits)::INT)
  FROM (SELECT *, ps[i + 1] AS x, pack > 0 AND size + length(ps[i + 1]) + 2 <= {max_chars} AS fits FROM pk WHERE i < len(ps))),
 un AS (SELECT {key}, unnest(ps) AS x, unnest(packs) AS pack, unnest(range(len(ps))) AS i FROM pk WHERE i = len(ps)),
 wholes AS (SELECT {key}, pack, string_agg(x, chr(10) || chr(10) ORDER BY i) AS p FROM un GROUP BY {key}, pack),
 win AS (SELECT {key}, pack, p, 0::BIGINT AS step, 0::BIGINT AS pos, 0::BIGINT AS start, 0::BIGINT AS e3 FROM wholes WHERE length(p) > {max_chars} UNION ALL
  SELECT {key}, pack, p, step + 1, pos2, w6, CASE WHEN w6 >= length(p) THEN length(p) WHEN e0 >= length(p) THEN length(p) WHEN e2 > w6 + 50 THEN e2 ELSE least(length(p), w6 + {max_chars}) END
  FROM (SELECT *, CASE WHEN e1 > w6 + 1 AND contains('{dash}', substr(p, e1, 1)) AND regexp_matches({char('e1')}, '^\\p{{L}}') THEN greatest(w6 + 1, e1 - length(regexp_extract(left(p, e1), '[^{SPACE}]+$'))) ELSE e1 END AS e2
  FROM (SELECT *, greatest(w6, CASE WHEN regexp_matches(substr(p, e0, 2), '^{alnum}{alnum}$') THEN e0 - length(regexp_extract(left(p, e0), '{alnum}+$')) ELSE e0 END) AS e1
  FROM (SELECT *, CASE WHEN step = 0 THEN 0 ELSE {resumed('w5')} END AS w6, least(length(p), pos2 + {max_chars}) AS e0
  FROM (SELECT *, CASE WHEN w3 < reach THEN least(w3 + {run('w3', lead)}, reach) ELSE w3 END AS w4, w4 + {run('w4', blank)} AS w5
  FROM (SELECT *, {resumed('w2')} AS w3
  FROM (SELECT *, CASE WHEN pos2 > 0 AND regexp_matches(substr(p, pos2, 2), '^{alnum}{alnum}$') THEN pos2 + {run('pos2', alnum)} ELSE pos2 END AS w1, w1 + {run('w1', blank)} AS w2, least(length(p), w2 + {max(60, overlap)}) AS reach
  FROM (SELECT *, CASE WHEN step = 0 THEN 0 WHEN e3 - {overlap} > pos THEN e3 - {overlap} ELSE greatest(e3, pos + 1) END AS pos2 FROM win WHERE step = 0 OR e3 < length(p))))))))),
 raw AS (SELECT {key}, pack, 0 AS step, p AS chunk FROM wholes WHERE length(p) <= {max_chars} UNION ALL SELECT {key}, pack, step, {strip('substr(p, start + 1, e3 - start)')} FROM win WHERE step > 0 AND start < length(p)),
 sized AS (SELECT *, len({words('chunk')}) >= {least_words} AS big FROM raw WHERE chunk <> ''),
 chunks AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY pack, step) AS no, chunk FROM (SELECT *, bool_or(big) OVER (PARTITION BY {key}) AS any_big FROM sized) WHERE big OR NOT any_big)"""
