"""SQL with the same rows as the queries, for those that SQL can express.

Written from what the queries return: words are lists, windows are slices of them, and everything is
grouped by the words themselves instead of by hashes.
"""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FOLDED = f"translate(text, '{_UPPER}', '{_UPPER.lower()}')"


def _blank_words(text: str) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), '[^\\x20\\x09-\\x0D]+')"


def _mark_words(text: str) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


NEAR_DEDUP = f"""WITH RECURSIVE t AS (SELECT doc_id, {_blank_words(_FOLDED)} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared.n >= 75 * (x.n + y.n - shared.n)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id,
       d.doc_id = min(r.b) AS kept
FROM documents d JOIN reach r ON r.a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
GROUP BY d.doc_id"""

_SYMBOLS = "#*$%&|<>"
_N_SYMBOLS = " + ".join(f"length(body) - length(replace(body, '{c}', ''))" for c in _SYMBOLS)


def _shrunk(rule: str) -> str:
    """Lower bound of a rule's shrunk rate is above the limit. Those of the operator."""
    mean, chance = f"m_{rule}", f"(m_{rule} * (1 - m_{rule}))"
    spread = f"(coalesce(v_{rule}, 0) - {chance} * noise)"
    prior = f"(CASE WHEN {spread} > 0 THEN least(greatest({chance} / {spread} - 1, 2.0), 10000.0) ELSE 10000.0 END)"
    rate = f"(({rule} + {mean} * {prior}) / (n + {prior}))"
    return f"{rate} - 2.0 * sqrt({rate} * (1 - {rate}) / (n + {prior} + 1)) > 0.5"


_RULES = ("base", "symbols", "dup", "long")
HOST_QUALITY = f"""WITH t AS (
  SELECT doc_id, source, coalesce(text, '') AS body, {_blank_words('text')} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) >= 8)),
often AS (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM windows),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS spot FROM often WHERE n > 1),
hits AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id),
counted AS (
  SELECT t.doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         ({_N_SYMBOLS})::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(hits.n, 0)::BIGINT AS n_repeat_words FROM t LEFT JOIN hits USING (doc_id)),
ruled AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         word_chars / greatest(n_words, 1) AS mean_chars FROM counted),
hosts AS (
  SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (base_failed)::DOUBLE AS base,
         count(*) FILTER (n_symbols > 0.1 * n_words)::DOUBLE AS symbols,
         count(*) FILTER (n_dup_lines > 0.3 * n_lines)::DOUBLE AS dup,
         count(*) FILTER (mean_chars < 2 OR mean_chars > 20)::DOUBLE AS long FROM ruled GROUP BY source),
moments AS (
  SELECT {', '.join(f'avg({r} / n) AS m_{r}, var_samp({r} / n) AS v_{r}' for r in _RULES)},
         avg(1 / n) AS noise FROM hosts),
rejected AS (SELECT source AS host FROM hosts, moments WHERE {' OR '.join(map(_shrunk, _RULES))})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT EXISTS (
         SELECT 1 FROM rejected WHERE host IS NOT DISTINCT FROM source) AS kept FROM ruled"""

SUBSTRING_DEDUP = f"""WITH t AS (SELECT doc_id, {_blank_words('text')} AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM t WHERE len(w) >= 35)),
often AS (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS n FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS spot FROM often WHERE n > 1),
spots AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS spot FROM t),
marked AS (SELECT s.doc_id, s.word, s.spot, g.spot IS NULL AS kept FROM spots s LEFT JOIN gone g USING (doc_id, spot)),
left_over AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (NOT kept) AS n_removed,
         string_agg(word, ' ' ORDER BY spot) FILTER (kept) AS kept_text FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept_text, '')) AS kept_sha256 FROM t LEFT JOIN left_over USING (doc_id)"""

WARC = """WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id
              END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to FROM f"""

DECONTAMINATION = f"""WITH d AS (SELECT doc_id, {_mark_words(_FOLDED)} AS w FROM documents),
b AS (SELECT item_id, {_mark_words(_FOLDED)} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN lengths ON len(w) >= n)),
places AS (SELECT doc_id, i, n, item_id FROM grams JOIN windows USING (n, s)),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (
          SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS spot FROM places) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (
            SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM places) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""

HARD_NEGATIVES = """WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v,
         CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
             list_inner_product(a.v, b.v)::BIGINT AS score
      FROM e a JOIN e b ON len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM p WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN p USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10"""

ORACLES: dict[str, str] = {
    "op2_minhash_near_dedup": NEAR_DEDUP,
    "op3_host_quality": HOST_QUALITY,
    "op6_substring_dedup": SUBSTRING_DEDUP,
    "op9_warc_round_trip": WARC,
    "op10_benchmark_decontamination": DECONTAMINATION,
    "op12_hard_negatives": HARD_NEGATIVES,
}
