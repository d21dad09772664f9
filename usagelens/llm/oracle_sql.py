"""DuckDB SQL of the queries that SQL can express.

Written with SQL's own operators; only the character classes and the allow-list are shared.
"""

from __future__ import annotations

from .quality import BAD_ON_BAD, BAD_ON_GOOD, PRIOR, ROUNDS, RULES, SHARE
from .secrets import ALLOWED, CLASSES

MARK, STAND_IN = "chr(1)", "chr(2)"
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _matches(name: str, pattern: str) -> str:
    """Matches of a pattern with their places: texts are split at marks put around them."""
    marked = f"regexp_replace(t, {_quoted(f'({pattern})')}, {MARK} || '\\1' || {MARK}, 'g')"
    return f"""{name}_parts AS (
  SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS part
  FROM (SELECT doc_id, string_split({marked}, {MARK}) AS p FROM texts)
), {name}_found AS (
  SELECT doc_id, ends - length(part) AS start, ends AS stop, part AS body
  FROM (SELECT doc_id, i, part, CAST(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS ends
        FROM {name}_parts)
  WHERE i % 2 = 0
)"""


def _secrets_sql() -> str:
    allowed = _quoted(f"^({'|'.join(ALLOWED)})$")
    ctes = [
        f"texts AS (SELECT doc_id, replace(coalesce(text, ''), {MARK}, {STAND_IN}) AS t FROM documents)",
        _matches("assign", ASSIGN),
        _matches("access", "AKIA[A-Z0-9]+"),
        _matches("hex", "[0-9a-f]+"),
        f"""base AS (
  SELECT doc_id, start, 0 AS rank, 'assign' AS kind, stop FROM assign_found
  WHERE length(regexp_extract(body, {_quoted(ASSIGN)}, 2)) >= 8
  UNION ALL SELECT doc_id, start, 1, 'access', stop FROM access_found WHERE length(body) >= 16
  UNION ALL SELECT doc_id, start, 2, 'hex', stop FROM hex_found WHERE length(body) >= 32
)""",
    ]
    held = "base"
    for rank, (kind, of) in enumerate(CLASSES.items(), start=3):
        w = of.window
        ctes.append(_matches(kind, f"{of.pattern}{{{w},}}"))
        ctes.append(f"""{kind}_windows AS (
  SELECT *, unnest(range(1, length(body) - {w} + 2)) AS s FROM {kind}_found WHERE NOT regexp_matches(body, {allowed})
), {kind}_counts AS (
  SELECT doc_id, start, body, s, c, count(*) AS n
  FROM (SELECT *, unnest(string_split(substring(body, s, {w}), '')) AS c FROM {kind}_windows) GROUP BY ALL
), {kind}_high AS (
  SELECT doc_id, start, body, s FROM {kind}_counts GROUP BY ALL
  HAVING -sum(n / {w} * log2(n / {w})) >= {of.bits} - 1e-9
), {kind}_spans AS (
  SELECT doc_id, start + min(s) - 1 AS start, start + max(s) - 1 + {w} AS stop,
         substring(body, min(s), max(s) - min(s) + {w}) AS body
  FROM {kind}_high GROUP BY doc_id, {kind}_high.start, {kind}_high.body
), with_{kind} AS (
  SELECT * FROM {held} UNION ALL
  SELECT doc_id, start, {rank}, '{kind}', stop FROM {kind}_spans e
  WHERE NOT regexp_matches(body, {allowed})
    AND NOT EXISTS (SELECT 1 FROM {held} b WHERE b.doc_id = e.doc_id AND b.start < e.stop AND e.start < b.stop)
)""")
        held = f"with_{kind}"
    written = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank)"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("assign", "access", "hex"))
    return f"""WITH {", ".join(ctes)}
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d
     LEFT JOIN (SELECT doc_id, {counts}, {written} AS base_spans FROM base GROUP BY doc_id) b ON b.doc_id = d.doc_id
     LEFT JOIN (SELECT doc_id, {written} AS spans FROM {held} GROUP BY doc_id) s ON s.doc_id = d.doc_id
"""


def _quality_sql(rounds: int = ROUNDS) -> str:
    """Measures, votes, and the rounds of expectation-maximisation one after the other.

    ``g_`` and ``b_`` are the shares of bad votes among a rule's votes on good and on bad documents.
    """
    rules = list(RULES)
    votes = ", ".join(
        f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS v_{rule}" for rule, (bad, good) in RULES.items()
    )
    start = f"CAST({SHARE} AS DOUBLE) AS share, " + ", ".join(
        f"CAST({BAD_ON_GOOD} AS DOUBLE) AS g_{r}, CAST({BAD_ON_BAD} AS DOUBLE) AS b_{r}" for r in rules
    )
    odds = "ln(share / (1 - share)) + " + " + ".join(
        f"CASE v_{r} WHEN -1 THEN ln(g_{r} / b_{r}) WHEN 1 THEN ln((1 - g_{r}) / (1 - b_{r})) ELSE 0 END" for r in rules
    )
    good = f"1 / (1 + exp(-({odds})))"
    ctes = []
    for k in range(rounds):
        sums = ", ".join(
            f"coalesce(sum(n * good) FILTER (v_{r} = -1), 0) + {PRIOR * BAD_ON_GOOD} AS bad_good_{r}, "
            f"coalesce(sum(n * good) FILTER (v_{r} <> 0), 0) + {PRIOR} AS cast_good_{r}, "
            f"coalesce(sum(n * (1 - good)) FILTER (v_{r} = -1), 0) + {PRIOR * BAD_ON_BAD} AS bad_bad_{r}, "
            f"coalesce(sum(n * (1 - good)) FILTER (v_{r} <> 0), 0) + {PRIOR} AS cast_bad_{r}"
            for r in rules
        )
        rates = ", ".join(
            f"CASE WHEN bad_bad_{r} / cast_bad_{r} < bad_good_{r} / cast_good_{r} "
            f"THEN (bad_good_{r} + bad_bad_{r}) / (cast_good_{r} + cast_bad_{r}) ELSE {own} END AS {side}_{r}"
            for r in rules
            for side, own in (("g", f"bad_good_{r} / cast_good_{r}"), ("b", f"bad_bad_{r} / cast_bad_{r}"))
        )
        ctes.append(
            f"fit{k + 1} AS MATERIALIZED (SELECT share, {rates} FROM ("
            f"SELECT (coalesce(sum(n * good), 0) + {PRIOR * SHARE}) / (coalesce(sum(n), 0) + {PRIOR}) AS share, {sums} "
            f"FROM (SELECT p.*, {good} AS good FROM patterns p, fit{k})))"
        )
    names = ", ".join(f"v_{r}" for r in rules)
    return f"""WITH spelt AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, w[i:i + 2] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM spelt)
), often AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + d) AS n FROM often, (VALUES (0), (1), (2)) AS s(d) GROUP BY doc_id
), measured AS (
  SELECT s.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(lines) AS n_lines,
         length(regexp_replace(t, '[^\\p{{L}}\\p{{M}}]', '', 'g')) AS n_letters, length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) AS n_capitals,
         length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclamations
  FROM spelt s LEFT JOIN covered c ON c.doc_id = s.doc_id
), voted AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {votes} FROM measured
), patterns AS MATERIALIZED (
  SELECT {names}, count(*) AS n FROM voted WHERE NOT base_failed GROUP BY ALL
), fit0 AS (SELECT {start}), {", ".join(ctes)}
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND round({good}, 6) >= 0.5 AS kept, round({good}, 6) AS quality
FROM voted, fit{rounds}
"""


ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": _quality_sql(),
    "op4_circulant_minhash": r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingled AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
                                      WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                                      ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS shingle
  FROM worded
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingled a JOIN shingled b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
       JOIN sizes m ON m.doc_id = a.doc_id JOIN sizes n ON n.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, m.n, n.n
  HAVING 100 * count(*) >= 80 * (m.n + n.n - count(*))
), reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, min(r.other) AS component_id, d.doc_id = min(r.other) AS kept
FROM documents d JOIN reached r ON r.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
GROUP BY d.doc_id, s.n
""",
    "op6_suffix_groups": r"""
WITH bytes AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents
), strings AS (
  SELECT doc_id, s, b[s:s + 99] AS x
  FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 98)) AS s FROM bytes)
), repeated AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY x ORDER BY doc_id, s) AS n FROM strings) WHERE n > 1
), runs AS (
  SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS fresh FROM repeated)
), spans AS (
  SELECT doc_id, min(s) AS first, max(s) + 100 AS next FROM runs GROUP BY doc_id, run
), edges AS (
  SELECT doc_id, coalesce(lag(next) OVER (PARTITION BY doc_id ORDER BY first), 1) AS kept_from, first - 1 AS kept_to FROM spans
  UNION ALL
  SELECT doc_id, coalesce((SELECT max(next) FROM spans WHERE spans.doc_id = bytes.doc_id), 1), octet_length(b) FROM bytes
), kept AS (
  SELECT doc_id, string_agg(CASE WHEN kept_to >= kept_from THEN hex(b[kept_from:kept_to]) ELSE '' END, '' ORDER BY kept_from) AS h
  FROM edges JOIN bytes USING (doc_id) GROUP BY doc_id
)
SELECT b.doc_id, octet_length(b.b) AS n_bytes, coalesce(r.n_removed, 0)::BIGINT AS n_removed,
       coalesce(r.n_spans, 0) AS n_spans, sha256(unhex(k.h)) AS kept_sha256
FROM bytes b JOIN kept k ON k.doc_id = b.doc_id
     LEFT JOIN (SELECT doc_id, sum(next - first) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id) r ON r.doc_id = b.doc_id
""",
    "op8_digest_index": r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS kept,
       text_sha256
FROM rows
""",
    "op9_warc_segments": r"""
WITH rows AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), newest AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS newest FROM rows
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN newest END AS refers_to
FROM newest
""",
    "op7_entropy_secrets": _secrets_sql(),
}
