"""ANSI-style SQL that gives the same rows as ``queries.QUERIES`` from the same tables.

Written from the definition of each operator, not from the Spark plan: ranks
are plain ``row_number`` over whole groups, counters are unnested and summed,
trees are found by interval joins.
"""

from __future__ import annotations

from scribeprint.plans.queries import (CHAT_LENGTH, DATASET_CAP, DATASETS, DISPATCH,
                                       DOCUMENT_LENGTH, NODE_WORDS, REPETITION_CUT, SPLIT_CONFIG,
                                       TREE_LENGTH, VOCABULARY_SIZE)

# Fixed values, written out here so that a name lost from the package is noticed.
FEATURES = ("max_depth", "control_flow", "functions", "classes", "assignments", "imports",
            "data_structures", "n_chars", "open_parens", "spaces", "branching", "identifiers",
            "strings", "integers", "floats", "booleans", "nested_ifs", "nested_loops",
            "comments", "passes", "returns", "parameter_lists", "repetition")
NODE_GROUPS = {
    "control_flow": ("if_statement", "for_statement", "while_statement", "switch_statement",
                     "try_statement", "catch_clause", "except_clause", "finally_clause"),
    "functions": ("function_definition", "method_declaration", "method_invocation", "call",
                  "lambda", "constructor_declaration"),
    "classes": ("class_definition", "class_declaration", "interface_declaration",
                "field_declaration", "variable_declarator"),
    "assignments": ("assignment", "assignment_expression", "expression_statement",
                    "binary_expression", "unary_expression"),
    "imports": ("import_statement", "import_from_statement", "import_declaration"),
    "data_structures": ("list", "dictionary", "array_creation_expression", "array_access",
                        "list_comprehension", "dictionary_comprehension", "set_comprehension"),
}
LITERAL_NAMES = {
    "identifiers": ("identifier",),
    "strings": ("string",),
    "integers": ("integer",),
    "floats": ("float",),
    "booleans": ("true", "false"),
}
STYLE_NAMES = {
    "comments": ("comment",),
    "passes": ("pass_statement",),
    "returns": ("return_statement",),
    "parameter_lists": ("parameter_list",),
}
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
             "source", "track", "wbr")
KEYWORDS = {
    "python": ("False", "None", "True", "and", "as", "assert", "async", "await", "break",
               "class", "continue", "def", "del", "elif", "else", "except", "finally", "for",
               "from", "global", "if", "import", "in", "is", "lambda", "nonlocal", "not", "or",
               "pass", "raise", "return", "try", "while", "with", "yield"),
    "java": ("abstract", "assert", "boolean", "break", "byte", "case", "catch", "char", "class",
             "const", "continue", "default", "do", "double", "else", "enum", "extends", "false",
             "final", "finally", "float", "for", "goto", "if", "implements", "import",
             "instanceof", "int", "interface", "long", "native", "new", "null", "package",
             "private", "protected", "public", "return", "short", "static", "strictfp", "super",
             "switch", "synchronized", "this", "throw", "throws", "transient", "true", "try",
             "void", "volatile", "while"),
}
MARKUP = r"(?s)<!--.*?-->|<[^>]*>|[^<]+|<"
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"

# The characters between words, spelled out.
WHITESPACE = (r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
              r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+")


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(names) -> str:
    return ", ".join(quoted(n) for n in names)


def words(s: str) -> str:
    return f"list_filter(regexp_split_to_array({s}, {quoted(WHITESPACE)}), lambda x: x <> '')"


def count_of(s: str, needle: str) -> str:
    return f"((length({s}) - length(replace({s}, {quoted(needle)}, ''))) // {len(needle)})"


def count_all(s: str, needles) -> str:
    return "(" + " + ".join(count_of(s, n) for n in needles) + ")::INT"


def node_words(s: str) -> str:
    for word, name in NODE_WORDS:
        s = f"replace({s}, {quoted(word)}, {quoted(name)})"
    return s


SAMPLES = """samples AS (
  SELECT doc_id::VARCHAR AS sample_id, source AS dataset, lang AS language, 'unknown' AS ai,
         text AS code, (lang = 'en')::INT AS label FROM documents)"""

# --- trees ---------------------------------------------------------------------------------
# From tokens (sample_id, pos, step, is_node, type, txt) to nodes, with byte and text spans.
NODES = """summed AS (
  SELECT *, coalesce(sum(step) OVER (PARTITION BY sample_id ORDER BY pos), 0) AS s,
         sum(strlen(txt)) OVER (PARTITION BY sample_id ORDER BY pos) AS to_byte
  FROM tok),
levelled AS (
  SELECT *, s - least(0, min(s) OVER (PARTITION BY sample_id ORDER BY pos)) AS lvl FROM summed),
stepped AS (
  SELECT *, coalesce(lag(lvl) OVER (PARTITION BY sample_id ORDER BY pos), 0) AS prev FROM levelled),
ends AS (SELECT sample_id, max(pos) + 1 AS last_pos, max(to_byte) AS n_bytes FROM summed
         GROUP BY sample_id),
turns AS (
  SELECT sample_id, pos, type, to_byte - strlen(txt) AS start_byte, to_byte, step,
         CASE WHEN step = 1 THEN lvl ELSE prev END AS depth
  FROM stepped WHERE step = 1 OR (step = -1 AND prev > 0)),
nexts AS (
  SELECT *, lead(pos) OVER w AS next_pos, lead(to_byte) OVER w AS next_byte FROM turns
  WINDOW w AS (PARTITION BY sample_id, depth ORDER BY pos)),
closed AS (
  SELECT sample_id, pos, type, start_byte, depth, coalesce(next_pos, last_pos) AS close_pos,
         coalesce(next_byte, n_bytes) AS end_byte
  FROM nexts JOIN ends USING (sample_id) WHERE step = 1),
placed AS (
  SELECT sample_id, pos, type, start_byte, depth, close_pos, end_byte FROM closed
  UNION ALL
  SELECT sample_id, pos, type, to_byte - strlen(txt), lvl + 1, pos, to_byte
  FROM stepped WHERE is_node AND step = 0
  UNION ALL
  SELECT sample_id, -1, '@ROOT@', 0, 0, last_pos, n_bytes FROM ends),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY pos) - 1 AS pre,
         row_number() OVER (PARTITION BY sample_id ORDER BY close_pos, depth DESC) - 1 AS post
  FROM placed),
families AS (
  SELECT sample_id, depth AS lvl, pre, pre AS own FROM ranked
  UNION ALL SELECT sample_id, depth - 1, pre, NULL FROM ranked WHERE depth > 0),
parents AS (
  SELECT sample_id, own, last_value(own IGNORE NULLS) OVER (PARTITION BY sample_id, lvl ORDER BY pre
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pre FROM families),
kids AS (SELECT sample_id, pre, count(*) AS n FROM parents WHERE own IS NULL GROUP BY ALL),
nodes AS (
  SELECT r.sample_id, r.pre::INT AS node_id, r.pre::INT AS pre, r.post::INT AS post,
         r.depth::INT AS depth, coalesce(k.n, 0)::INT AS n_children, r.type,
         r.start_byte::INT AS start_byte, r.end_byte::INT AS end_byte
  FROM ranked r LEFT JOIN kids k USING (sample_id, pre))"""

_NAME = "lower(regexp_extract(txt, '^<([A-Za-z][A-Za-z0-9:-]*)', 1))"
MARKUP_TOKENS = f"""raw AS (
  SELECT page_id::VARCHAR AS sample_id, regexp_extract_all(html, {quoted(MARKUP)}) AS t FROM pages),
opened AS (SELECT sample_id, unnest(t) AS txt, generate_subscripts(t, 1) AS pos FROM raw),
tok AS (
  SELECT sample_id, pos, txt,
    CASE WHEN txt LIKE '</%' THEN -1 WHEN {_NAME} = '' OR txt LIKE '%/>'
           OR {_NAME} IN ({listed(VOID_TAGS)}) THEN 0 ELSE 1 END AS step,
    txt NOT LIKE '</%' AS is_node,
    CASE WHEN txt LIKE '</%' THEN NULL WHEN txt LIKE '<!--%' THEN 'comment'
         WHEN txt LIKE '<!%' OR txt LIKE '<?%' THEN 'declaration'
         WHEN {_NAME} = '' THEN 'text' ELSE {_NAME} END AS type
  FROM opened)"""
MARKUP_NODES = f"WITH {MARKUP_TOKENS}, {NODES.replace('@ROOT@', 'document')}"

_QUOTED = r'"[^"\\\n]*(?:\\.[^"\\\n]*)*"|' + r"'[^'\\\n]*(?:\\.[^'\\\n]*)*'"
_REST = _QUOTED + r"|\p{N}[\p{L}\p{N}_.]*|[\p{L}_$][\p{L}\p{N}_$]*|\s+|."
_CODE = {"python": r'(?s)#[^\n]*|""".*?"""|' + r"'''.*?'''|" + _REST,
         "java": r"(?s)//[^\n]*|/\*.*?\*/|" + _REST}


def code_tokens(language: str, remainder: int) -> str:
    """Pieces of the documents in one language; the language changes with the id."""
    return f"""SELECT doc_id::VARCHAR AS sample_id, '{language}' AS language,
         regexp_extract_all({node_words('text')}, {quoted(_CODE[language])}) AS t
  FROM documents WHERE doc_id % 2 = {remainder}"""


CODE_NODES = f"""WITH raw AS (
  {code_tokens('python', 0)}
  UNION ALL
  {code_tokens('java', 1)}),
pieces AS (SELECT sample_id, language, unnest(t) AS txt, generate_subscripts(t, 1) AS spot FROM raw),
tok AS (
  SELECT sample_id, 2 * spot AS pos, txt, 0 AS step, NOT regexp_matches(txt, '^\\s') AS is_node,
    CASE WHEN regexp_matches(txt, '^\\s') THEN NULL
         WHEN language = 'python' AND txt LIKE '#_%' THEN 'comment'
         WHEN language = 'java' AND (txt LIKE '//%' OR txt LIKE '/*%') THEN 'comment'
         WHEN txt LIKE '"%' OR txt LIKE '''%' THEN 'string'
         WHEN regexp_matches(txt, '^[0-9]+$') THEN 'integer'
         WHEN regexp_matches(txt, '^\\p{{N}}') THEN 'float'
         WHEN regexp_matches(txt, '^[\\p{{L}}_$]') AND NOT CASE language
              WHEN 'python' THEN txt IN ({listed(KEYWORDS["python"])})
              ELSE txt IN ({listed(KEYWORDS["java"])}) END THEN 'identifier'
         ELSE txt END AS type FROM pieces
  UNION ALL
  SELECT sample_id, 2 * spot - 1, '', 1, true, CASE txt WHEN '(' THEN 'parenthesized'
         WHEN '[' THEN 'bracketed' ELSE 'block' END FROM pieces WHERE txt IN ('(', '[', '{{')
  UNION ALL
  SELECT sample_id, 2 * spot + 1, '', -1, false, NULL FROM pieces WHERE txt IN (')', ']', '}}')),
{NODES.replace("'@ROOT@'", "CASE sample_id::BIGINT % 2 WHEN 0 THEN 'module' ELSE 'program' END")}"""

# Every node opens before what follows it and closes after all that is below it.
NODE_DIGEST = f"""{CODE_NODES}
SELECT sample_id, count(*) AS n_nodes, sha256(string_agg(concat_ws(':', node_id, pre, post, depth, n_children,
       coalesce(type, ''), start_byte, end_byte), chr(10) ORDER BY pre)) AS nodes_sha256
FROM nodes GROUP BY sample_id"""

TREE_EVENTS = """events AS (
  SELECT sample_id, 2 * pre - depth AS spot, CASE WHEN depth > 0 THEN ' ' ELSE '' END
         || CASE WHEN n_children > 0 THEN '(' ELSE '' END || type AS txt FROM nodes
  UNION ALL
  SELECT sample_id, 2 * post + depth + 1, ')' FROM nodes WHERE n_children > 0)"""



def token_events(texts: str, atomic: str) -> str:
    """Marks and texts of the nodes that no atomic node covers, from ``texts`` (sample_id, code)."""
    return f"""marked AS (
  SELECT *, n_children = 0 OR type IN ({atomic}) AS atomic FROM nodes),
shown AS (
  SELECT * FROM (
    SELECT *, max(CASE WHEN atomic THEN post + depth END) OVER (PARTITION BY sample_id ORDER BY pre
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered FROM marked)
  WHERE covered IS NULL OR pre > covered),
originals AS ({texts}),
events AS (
  SELECT sample_id, 2 * pre - depth AS spot, CASE WHEN atomic
         THEN decode(array_slice(encode(code), start_byte + 1, end_byte)) ELSE type || '::left' END AS txt
  FROM shown JOIN originals USING (sample_id)
  UNION ALL
  SELECT sample_id, 2 * post + depth + 1, type || '::right' FROM shown WHERE NOT atomic)
SELECT sample_id, string_agg(txt, ' ' ORDER BY spot) AS tree FROM events GROUP BY sample_id"""


# The texts of the tokens from the opening of a node to its end, put together again.
NODE_TEXT = f"""{MARKUP_NODES}
SELECT r.sample_id, r.pre::INT AS node_id,
       coalesce(string_agg(t.txt, '' ORDER BY t.pos), '') AS text
FROM ranked r LEFT JOIN tok t ON t.sample_id = r.sample_id AND t.pos BETWEEN r.pos AND r.close_pos
GROUP BY r.sample_id, r.pre"""
CODE_TREES = (CODE_NODES + ", " + token_events(
        f"SELECT doc_id::VARCHAR AS sample_id, {node_words('text')} AS code FROM documents",
        "'identifier', 'string_literal', 'number_literal'"))


def encode_sql(texts: str, length: int, kept: str = "") -> str:
    """Ids and masks of ``texts`` (sample_id, code, kept columns)."""
    return f"""coded AS ({texts}),
t AS (SELECT sample_id{kept}, regexp_extract_all(code, {quoted(TOKEN_PATTERN)}) AS t FROM coded),
vocabulary AS (
  SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) + 3 AS token_id
  FROM (SELECT unnest(t) AS token FROM t) GROUP BY token
  ORDER BY count(*) DESC, token LIMIT {VOCABULARY_SIZE}),
spread AS (SELECT sample_id, unnest(t) AS token, generate_subscripts(t, 1) AS spot FROM t),
ids AS (
  SELECT sample_id, list(coalesce(token_id, 3) ORDER BY spot) AS ids
  FROM spread LEFT JOIN vocabulary USING (token) WHERE spot <= {length - 2}
  GROUP BY sample_id),
bare AS (SELECT sample_id{kept}, coalesce(ids, []) AS ids FROM t LEFT JOIN ids USING (sample_id))
SELECT sample_id,
       array_to_string([0] || ids || [2] || list_transform(range({length - 2} - len(ids)),
                       lambda x: 1), ' ') AS input_ids,
       array_to_string(list_transform(range({length}), lambda x:
                       CASE WHEN x < len(ids) + 2 THEN 1 ELSE 0 END), ' ') AS attention_mask{kept}
FROM bare"""


# --- ranks ---------------------------------------------------------------------------------


def split_sql(source: str, strata: str, test: str, val: str, keep: str) -> str:
    """Sizes by formula, ranks by sorting whole strata."""
    return f"""sized AS (
  SELECT *, count(*) OVER (PARTITION BY {strata}) AS n,
         row_number() OVER (PARTITION BY {strata} ORDER BY md5('42|split|' || sample_id), sample_id)
           AS rn, ({test})::DOUBLE AS ts, ({val})::DOUBLE AS vs FROM {source}),
tested AS (SELECT *, CASE WHEN ts = 1 THEN n ELSE ceil(ts * n) END AS n_test FROM sized),
cut AS (
  SELECT *, CASE WHEN ts = 1 THEN 0
       ELSE ceil((vs / CASE WHEN ts = 1 THEN 1 ELSE 1::DOUBLE - ts END) * (n - n_test)) END AS n_val
  FROM tested),
split_rows AS (
  SELECT {keep}, CASE WHEN rn <= n_test THEN 'test' WHEN rn <= n_test + n_val THEN 'val'
         ELSE 'train' END AS split FROM cut)"""


def cap_sql(source: str, strata: str, cap: str) -> str:
    return f"""labelled AS (
  SELECT *, count(*) OVER (PARTITION BY {strata}) AS n,
         count(*) OVER (PARTITION BY {strata}, label) AS n_label, ({cap})::BIGINT AS cap,
         row_number() OVER (PARTITION BY {strata}, label
                            ORDER BY md5('42|cap|' || sample_id), sample_id) AS rn FROM {source}),
shares AS (
  SELECT {strata}, label, any_value(n) AS n, any_value(n_label) AS n_label,
         any_value(least(coalesce(cap, n), n)) AS size FROM labelled GROUP BY {strata}, label),
floors AS (SELECT *, size * n_label // n AS low, size * n_label % n AS rest FROM shares),
quotas AS (
  SELECT {strata}, label, low + CASE WHEN row_number() OVER (PARTITION BY {strata}
           ORDER BY rest DESC, label) <= size - sum(low) OVER (PARTITION BY {strata})
         THEN 1 ELSE 0 END AS quota FROM floors),
capped AS (SELECT l.* EXCLUDE (n, n_label, cap, rn) FROM labelled l JOIN quotas q
           USING ({strata}, label) WHERE l.rn <= q.quota)"""


def _nested(ctes: str, table: str) -> str:
    """The rows of ``table`` as a subquery of its own names."""
    return f"(WITH {ctes} SELECT * FROM {table})"


def setting(key: str, otherwise: str) -> str:
    cases = " ".join(f"WHEN '{n}' THEN {c[key]}" for n, c in SPLIT_CONFIG.items() if key in c)
    return f"CASE dataset {cases} ELSE {otherwise} END"


_SIZES = (setting("test_size", "0"), setting("val_size", "0"))
_CAP = setting("max_sample_count", "NULL")
_SPLIT = split_sql("samples", "dataset", "0.1", "0.1", "sample_id, dataset, code")

# Three runs over the labelled documents as programs; their sizes and filters are those of the queries.
_RUN_SAMPLES = f"""run_samples AS (
  SELECT doc_id::VARCHAR AS sample_id, source AS dataset, 'unknown' AS ai, quality AS label,
         CASE WHEN doc_id % 2 = 0 THEN 'python' ELSE 'java' END AS language, {node_words('text')} AS code
  FROM documents JOIN labels USING (doc_id))"""
_STRATA, _RUN_KEEP = "dataset, language, ai", "sample_id, dataset, language, ai, label, code"
_RUN_SPLITS = f"""{_RUN_SAMPLES}, java_samples AS (SELECT * FROM run_samples WHERE language = 'java'),
run_rows AS (
  SELECT 'all' AS config, * FROM {_nested(cap_sql('run_samples', _STRATA, str(DATASET_CAP)) + ', ' + split_sql(
      'capped', _STRATA, '0.1', '0.1', _RUN_KEEP), 'split_rows')}
  UNION ALL SELECT 'java', * FROM {_nested(split_sql('java_samples', _STRATA, '0.1', '0.1', _RUN_KEEP), 'split_rows')}
  UNION ALL SELECT 'unseen', * FROM {_nested(cap_sql('run_samples', _STRATA, _CAP) + ', ' + split_sql(
      'capped', _STRATA, *_SIZES, _RUN_KEEP), 'split_rows')})"""

# --- features ------------------------------------------------------------------------------
_COUNTED = {
    **{name: count_all("s", needles) for name, needles in NODE_GROUPS.items()},
    "n_chars": "length(s)::INT", "open_parens": count_all("s", "("), "spaces": count_all("s", " "),
    "branching": f"coalesce({count_of('s', ' ')}::DOUBLE / nullif({count_of('s', '(')}, 0), 0)",
    **{name: count_all("s", needles) for name, needles in {**LITERAL_NAMES, **STYLE_NAMES}.items()},
    "repetition": "CASE WHEN len(w) = 0 THEN 0.0::DOUBLE ELSE len(w)::DOUBLE / len(list_distinct(w)) END",
    "max_depth": "coalesce(d.max_depth, 0)::INT",
    "nested_ifs": "coalesce(c.nested_ifs, 0)::INT", "nested_loops": "coalesce(c.nested_loops, 0)::INT",
}
FEATURE_CTES = f"""named AS (
  SELECT doc_id, {node_words('text')} AS s FROM documents),
split_up AS (SELECT doc_id, s, {words('s')} AS w FROM named),
chars AS (
  SELECT doc_id, unnest(b) AS ch, generate_subscripts(b, 1) AS spot
  FROM (SELECT doc_id, string_split(regexp_replace(s, '[^()]', '', 'g'), '') AS b FROM named)),
depths AS (
  SELECT doc_id, greatest(0, max(lvl)) AS max_depth FROM (
    SELECT doc_id, sum(CASE ch WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END)
             OVER (PARTITION BY doc_id ORDER BY spot) AS lvl FROM chars) GROUP BY doc_id),
marks AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS spot FROM split_up),
walked AS (
  SELECT doc_id, t, sum(CASE t WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END)
           OVER (PARTITION BY doc_id ORDER BY spot) AS lvl,
         row_number() OVER (PARTITION BY doc_id, CASE
             WHEN t IN ('if_statement', 'elif_clause') THEN 1
             WHEN t IN ('for_statement', 'while_statement') THEN 2 ELSE 3 END ORDER BY spot) AS nth
  FROM marks),
control AS (
  SELECT doc_id,
         count(*) FILTER (t IN ('if_statement', 'elif_clause') AND lvl > 1 AND nth > 1)
           AS nested_ifs,
         count(*) FILTER (t IN ('for_statement', 'while_statement') AND lvl > 1 AND nth > 1)
           AS nested_loops
  FROM walked GROUP BY doc_id),
features AS (
  SELECT u.doc_id, {', '.join(f'{_COUNTED[f]} AS {f}' for f in FEATURES)}
  FROM split_up u LEFT JOIN depths d USING (doc_id) LEFT JOIN control c USING (doc_id))"""

# --- evaluation ----------------------------------------------------------------------------
STRUCTURAL = f"""WITH {FEATURE_CTES}
SELECT doc_id::VARCHAR AS sample_id, {', '.join(f'round({f}, 6) AS {f}' if f in ('branching', 'repetition')
                                                else f for f in FEATURES)} FROM features"""

PREDICTIONS = f"""rated AS (SELECT doc_id, lang, source, {words('text')} AS w FROM documents),
predictions AS (
  SELECT doc_id, lang, source, quality AS y_true,
         ((CASE WHEN len(w) = 0 THEN 0 ELSE len(w)::DOUBLE / len(list_distinct(w)) END)
           < {REPETITION_CUT})::INT AS y_pred
  FROM rated JOIN labels USING (doc_id))"""
CELLS = """count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn,
       count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp,
       count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn,
       count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp"""
RATES = """round((tp + tn)::DOUBLE / nullif(tp + tn + fp + fn, 0), 6) AS accuracy,
       round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS recall,
       round(fp::DOUBLE / nullif(fp + tn, 0), 6) AS false_positive_rate,
       round(fn::DOUBLE / nullif(fn + tp, 0), 6) AS false_negative_rate"""
EXACT_RATES = RATES.replace("round(", "(").replace(", 6)", ")")


RUN_PREDICTIONS = f"""{PREDICTIONS.replace('predictions AS', 'guessed AS')},
{_RUN_SPLITS},
predictions AS (
  SELECT config, 'rule' AS variant, 'rule' AS model, split, y_true, y_pred
  FROM guessed JOIN run_rows ON sample_id = doc_id::VARCHAR WHERE split <> 'train')"""


def report_sql(by: str = "", predictions: str = PREDICTIONS) -> str:
    """The class report, for each group of the columns in ``by`` (with a comma after each)."""
    return f"""WITH {predictions},
spine AS (SELECT unnest([0, 1]) AS class),
counted AS (
  SELECT {by}class, count(*) FILTER (y_true = class AND y_pred = class)::DOUBLE AS hit,
         count(*) FILTER (y_pred = class) AS said, count(*) FILTER (y_true = class) AS support
  FROM spine, predictions GROUP BY {by}class),
scored AS (
  SELECT {by}class, coalesce(hit / nullif(said, 0), 0) AS p, coalesce(hit / nullif(support, 0), 0) AS r,
         coalesce(2 * hit / nullif(said + support, 0), 0) AS f, support, hit FROM counted),
sums AS (
  SELECT {by}sum(hit) / sum(support) AS right_share, avg(p) AS mp, avg(r) AS mr, avg(f) AS mf,
         sum(p * support) / sum(support) AS wp, sum(r * support) / sum(support) AS wr,
         sum(f * support) / sum(support) AS wf, sum(support) AS n
  FROM scored {'GROUP BY ' + by.rstrip(', ') if by else ''}),
report AS (
  SELECT {by}CASE class WHEN 0 THEN 'Human' ELSE 'AI' END AS name, p, r, f, support FROM scored
  UNION ALL SELECT {by}'accuracy', NULL, NULL, right_share, n FROM sums
  UNION ALL SELECT {by}'macro avg', mp, mr, mf, n FROM sums
  UNION ALL SELECT {by}'weighted avg', wp, wr, wf, n FROM sums)
SELECT {by}name, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1,
       support::BIGINT AS support FROM report"""


LOG = """log AS (
  SELECT event_id AS seq, user_id::DOUBLE AS epoch,
         CASE WHEN event_type IN ('click', 'signup') THEN value END AS loss,
         CASE WHEN event_type IN ('click', 'signup') THEN value / 1000 END AS learning_rate,
         CASE WHEN event_type IN ('view', 'signup') THEN value + 1 END AS eval_loss FROM events)"""
_TOKENS = f"regexp_extract_all(text, {quoted(TOKEN_PATTERN)})"
_WEIGHTS = ", ".join(f"{(i % 7 - 3) / 10}::DOUBLE" for i in range(64))
_WORD = "CASE WHEN quality = 0 THEN 'human' WHEN toxic = 0 THEN 'lm' ELSE 'LM' END"
_SPELLED = ("CASE WHEN quality = 1 AND toxic = 0 THEN '1' WHEN quality = 1 THEN 'true' "
            "WHEN toxic = 0 THEN '0.0' ELSE '2' END")
_PREFIX = "(quality + toxic)::VARCHAR"

ORACLES: dict[str, str] = {
    "catalog_scan": """
SELECT 'documents/prose/unknown/' || doc_id AS sample_id, 'documents' AS dataset, lang AS language,
       'unknown' AS ai, length(text)::INT AS n_chars FROM documents
UNION ALL SELECT 'benchmark/prose/unknown/' || item_id, 'benchmark', 'prose', 'unknown',
       length(text)::INT FROM benchmark
UNION ALL SELECT 'pages/html/unknown/' || page_id, 'pages', 'html', 'unknown', length(html)::INT
FROM pages""",
    "folder_scan": """
SELECT page_id % 3 || '_' || page_id || '.html' AS sample_id,
       replace(replace(coalesce(html, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) || chr(10) AS code,
       CASE page_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END::INT AS label, 'html' AS language,
       CASE page_id % 3 WHEN 2 THEN 'label not known: 2' END AS reject FROM pages""",
    "config_table_lookup": f"""
WITH {SAMPLES}
SELECT sample_id, dataset, coalesce({_SIZES[0]}, 0)::DOUBLE AS test_size, coalesce({_SIZES[1]}, 0)::DOUBLE AS val_size,
       ({_CAP})::BIGINT AS max_sample_count
FROM samples WHERE dataset IN ({listed(DATASETS[:12])}) AND language = 'en'""",
    "split_refined": f"""
WITH {SAMPLES}, {cap_sql('samples', 'dataset', str(DATASET_CAP))},
{split_sql('capped', 'dataset', '0.1', '0.1', 'sample_id, dataset, label')}
SELECT * FROM split_rows""",
    "vocabulary_by_sketch": f"""
SELECT token, (row_number() OVER (ORDER BY count(*) DESC, token) + 3)::INT AS token_id
FROM (SELECT unnest({_TOKENS}) AS token FROM documents)
GROUP BY token ORDER BY count(*) DESC, token LIMIT 50""",
    "pool_tokens": f"""
WITH counted AS (
  SELECT doc_id, token, count(*) AS n, ('0x' || md5(token)[1:4])::INT AS number
  FROM (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents) GROUP BY ALL),
valued AS (
  SELECT doc_id, dim, round(sum(n * x) / sum(n), 5) AS value FROM (
    SELECT doc_id, n, unnest(embedding)::DOUBLE AS x, (generate_subscripts(embedding, 1) - 1)::INT AS dim
    FROM counted JOIN embeddings ON vec_id = number % 400 WHERE number % 8 > 0) GROUP BY doc_id, dim)
SELECT doc_id::VARCHAR AS sample_id, dim, value FROM documents LEFT JOIN valued USING (doc_id)""",
    "csv_scan": "SELECT text AS code, (role = 'assistant')::INT AS label FROM conversations",
    "jsonl_scan": """
SELECT text AS code,
       CASE role WHEN 'assistant' THEN 1 WHEN 'user' THEN 0 END AS label,
       CASE WHEN role NOT IN ('assistant', 'user') THEN 'label not known: none' END AS reject
FROM conversations""",
    "clean_text": r"""
SELECT doc_id, replace(replace(replace(text, ', ', ',    '), '. ', '.' || chr(13)), chr(9), '    ')
       AS code FROM documents""",
    "drop_null_text": """
SELECT conv_id, turn, text AS code FROM conversations WHERE role = 'assistant'""",
    "label_from_prefix": f"""
SELECT {_PREFIX} || '_' || doc_id || '.txt' AS sample_id,
       CASE {_PREFIX} WHEN '1' THEN 0 WHEN '0' THEN 1 END AS label,
       CASE WHEN {_PREFIX} NOT IN ('0', '1') THEN 'label not known: ' || {_PREFIX} END AS reject
FROM labels""",
    "label_from_word": f"""
SELECT doc_id, {_WORD} AS word, CASE {_WORD} WHEN 'lm' THEN 1 WHEN 'human' THEN 0 END AS label
FROM labels""",
    "label_from_number": f"""
SELECT doc_id, {_SPELLED} AS spelled,
       CASE WHEN {_SPELLED} IN ('1', 'true') THEN 1 WHEN {_SPELLED} = '0.0' THEN 0 END AS label
FROM labels""",
    "filter_datasets": f"""
SELECT doc_id::VARCHAR AS sample_id, source AS dataset, lang AS language FROM documents
WHERE source IN ({listed(DATASETS[:12])}) AND lang = 'en'""",
    "config_lookup": f"""WITH {SAMPLES}
SELECT sample_id, dataset, ({_SIZES[0]})::DOUBLE AS test_size, ({_SIZES[1]})::DOUBLE AS val_size,
       ({_CAP})::BIGINT AS max_sample_count FROM samples""",
    "language_dispatch": f"""
SELECT doc_id::VARCHAR AS sample_id, lang AS language, len(CASE lang
  {' '.join(f"WHEN '{k}' THEN regexp_extract_all(text, {quoted(p)})" for k, p in DISPATCH.items())}
  END)::INT AS n_tokens FROM documents""",
    "stratified_cap": f"""WITH {SAMPLES}, {cap_sql('samples', 'dataset', str(DATASET_CAP))}
SELECT sample_id, dataset, label FROM capped""",
    "split_three_way": f"WITH {SAMPLES}, {_SPLIT} SELECT sample_id, dataset, split FROM split_rows",
    "split_approximate": f"""WITH {SAMPLES},
shared AS (SELECT *, ('0x' || md5('42|split|' || sample_id)[1:8])::BIGINT / 4294967296 AS share
           FROM samples)
SELECT sample_id, dataset, CASE WHEN share < 0.1 THEN 'test' WHEN share < 0.2 THEN 'val'
       ELSE 'train' END AS split FROM shared""",
    "split_holdout": """
SELECT doc_id::VARCHAR AS sample_id, source AS dataset, 'test' AS split FROM documents""",
    "split_two_way": f"""
WITH {SAMPLES}, {split_sql('samples', 'dataset', '0', '0.2', 'sample_id, dataset')}
SELECT * FROM split_rows""",
    "split_by_config": f"""
WITH {SAMPLES}, {cap_sql('samples', 'dataset, language, ai', _CAP)},
{split_sql('capped', 'dataset, language, ai', *_SIZES, 'sample_id, dataset, language, ai, label')}
SELECT * FROM split_rows""",
    "union_splits": f"""
WITH {SAMPLES}, both_parts AS (
  SELECT sample_id, dataset, 0.1 AS t FROM samples UNION ALL
  SELECT conv_id || ':' || turn, 'conversations', 0.2 FROM conversations),
{split_sql('both_parts', 'dataset', 't', '0.1', 'sample_id, dataset')}
SELECT * FROM split_rows""",
    "split_summary": f"""
WITH {SAMPLES}, {cap_sql('samples', 'dataset, language, ai', '20')},
{split_sql('capped', 'dataset, language, ai', '0.1', '0.1', 'dataset, language, ai')}
SELECT CASE WHEN grouping(dataset) = 1 THEN 'Total' ELSE dataset END AS dataset, language, ai,
       count(*) AS total, count(*) FILTER (split = 'train') AS train,
       count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test
FROM split_rows GROUP BY GROUPING SETS ((dataset, language, ai), ())""",
    "run_splits": f"""
WITH {_RUN_SPLITS}
SELECT config, CASE WHEN grouping(dataset) = 1 THEN 'Total' ELSE dataset END AS dataset, language, ai,
       count(*) AS total, count(*) FILTER (split = 'train') AS train,
       count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test
FROM run_rows GROUP BY GROUPING SETS ((config, dataset, language, ai), (config))""",
    "run_truncated": f"""
WITH {_RUN_SPLITS}
SELECT config, split, count(*) AS n, count(*) FILTER (
  len(regexp_extract_all(code, {quoted(TOKEN_PATTERN)})) + 2 >= {DOCUMENT_LENGTH}) AS truncated
FROM run_rows GROUP BY config, split""",
    "run_classes": report_sql("config, variant, model, split, ", RUN_PREDICTIONS),
    "nodes_from_markup": f"{MARKUP_NODES} SELECT * FROM nodes",
    "nodes_from_markup_blocks": f"{MARKUP_NODES} SELECT * FROM nodes",
    "nodes_from_code": f"{CODE_NODES} SELECT * FROM nodes",
    "nodes_from_code_blocks": NODE_DIGEST,
    "node_types": f"""{MARKUP_NODES}
SELECT sample_id, string_agg(type, ',' ORDER BY pre) AS types FROM nodes GROUP BY sample_id""",
    "node_text": NODE_TEXT,
    "stored_node_text": NODE_TEXT,
    "serialise_tree": f"""{MARKUP_NODES}, {TREE_EVENTS}
SELECT sample_id, string_agg(txt, '' ORDER BY spot) AS tree FROM events GROUP BY sample_id""",
    "serialise_tokens": MARKUP_NODES + ", " + token_events(
        "SELECT page_id::VARCHAR AS sample_id, html AS code FROM pages",
        "'identifier', 'string_literal', 'number_literal', 'li', 'title'"),
    "serialise_code": f"""{CODE_NODES}, {TREE_EVENTS}
SELECT sample_id, string_agg(txt, '' ORDER BY spot) AS tree FROM events GROUP BY sample_id""",
    "serialise_code_tokens": CODE_TREES,
    "stored_serialise_tokens": CODE_TREES,
    "tree_stats": f"""{MARKUP_NODES}
SELECT sample_id, count(*) AS n_nodes, count(*) FILTER (n_children = 0) AS n_leaves,
       max(depth) AS max_depth, count(*) FILTER (type = 'a') AS n_links,
       count(*) FILTER (type IN ('p', 'div', 'article')) AS n_blocks,
       count(*) FILTER (type = 'text') AS n_texts FROM nodes GROUP BY sample_id""",
    "structural_features": STRUCTURAL,
    "structural_features_blocks": STRUCTURAL,
    "nested_control": f"""WITH {FEATURE_CTES}
SELECT doc_id::VARCHAR AS sample_id, nested_ifs, nested_loops FROM features""",
    "repetition_ratio": f"""
SELECT doc_id::VARCHAR AS sample_id, CASE WHEN len(w) = 0 THEN 0.0
       ELSE round(len(w)::DOUBLE / len(list_distinct(w)), 6) END AS ratio
FROM (SELECT doc_id, {words('text')} AS w FROM documents)""",
    "build_vocabulary": f"""
SELECT token, (row_number() OVER (ORDER BY count(*) DESC, token) + 3)::INT AS token_id
FROM (SELECT unnest({_TOKENS}) AS token FROM documents)
GROUP BY token ORDER BY count(*) DESC, token LIMIT 5000""",
    "encode_tokens": "WITH " + encode_sql(
        "SELECT conv_id || ':' || turn AS sample_id, text AS code, (role = 'assistant')::INT AS label "
        "FROM conversations", CHAT_LENGTH, ", label"),
    "encode_tree": f"{MARKUP_NODES}, {TREE_EVENTS}, " + encode_sql(
        "SELECT sample_id, string_agg(txt, '' ORDER BY spot) AS code FROM events GROUP BY sample_id",
        TREE_LENGTH),
    "truncated_count": f"""WITH {SAMPLES}, {_SPLIT}
SELECT split, count(*) AS n, count(*) FILTER (
  len(regexp_extract_all(code, {quoted(TOKEN_PATTERN)})) + 2 >= {DOCUMENT_LENGTH}) AS truncated
FROM split_rows GROUP BY split""",
    "mean_pool": """
SELECT label, (dim - 1)::INT AS dim, round(avg(x::DOUBLE), 6) AS mean FROM (
  SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings)
GROUP BY label, dim""",
    "embed_text": f"""
WITH t AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
counted AS (
  SELECT doc_id, ('0x' || md5(token)[1:2])::INT AS dim, count(*) AS c
  FROM (SELECT doc_id, unnest(t) AS token FROM t) GROUP BY ALL),
rarity AS (
  SELECT dim, ln(((SELECT count(*) FROM t) + 1)::DOUBLE / (count(*) + 1)) AS idf
  FROM counted GROUP BY dim),
valued AS (SELECT doc_id, dim, round(c * idf / len(t), 6) AS value
           FROM counted JOIN rarity USING (dim) JOIN t USING (doc_id) WHERE idf > 0)
SELECT doc_id::VARCHAR AS sample_id, dim, value FROM t LEFT JOIN valued USING (doc_id)""",
    "text_terms": f"""
WITH t AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
terms AS (
  SELECT doc_id, unnest(t) AS term FROM t
  UNION ALL
  SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM t),
counted AS (
  SELECT doc_id, ('0x' || md5(term)[1:3])::INT AS dim, count(*) AS c FROM terms GROUP BY ALL),
rarity AS (
  SELECT dim, ln(((SELECT count(*) FROM t) + 1)::DOUBLE / (count(*) + 1)) AS idf
  FROM counted GROUP BY dim),
rare AS (SELECT doc_id, dim, c * idf AS v FROM counted JOIN rarity USING (dim) WHERE idf > 0),
sizes AS (SELECT doc_id, sqrt(sum(v * v)) AS size FROM rare GROUP BY doc_id)
SELECT doc_id::VARCHAR AS sample_id, dim, round(v / size, 6) AS value
FROM t LEFT JOIN (rare JOIN sizes USING (doc_id)) USING (doc_id)""",
    "classifier_gradient": """
SELECT unnest(range(65))::INT AS dim, 0.0::DOUBLE AS gradient""",
    "assemble_features": f"""WITH {FEATURE_CTES},
vecs AS (
  SELECT vec_id, list_concat(embedding::FLOAT[], [{', '.join(f'{f}::FLOAT' for f in FEATURES)}])
         AS v FROM embeddings JOIN features ON vec_id = doc_id)
SELECT vec_id, (generate_subscripts(v, 1) - 1)::INT AS dim, unnest(v)::DOUBLE AS value
FROM vecs""",
    "standard_scale": """
WITH long AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1
              AS dim FROM embeddings),
stats AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS s FROM long GROUP BY dim)
SELECT vec_id, dim::INT AS dim, round((x - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 5) AS value
FROM long JOIN stats USING (dim)""",
    "class_weights": """
SELECT quality, count(*) AS n_class, round((SELECT count(*) FROM labels)::DOUBLE
       / ((SELECT count(DISTINCT quality) FROM labels) * count(*)), 6) AS weight
FROM labels GROUP BY quality""",
    "linear_score": f"""
WITH z AS (SELECT vec_id, list_dot_product(embedding::DOUBLE[], [{_WEIGHTS}]) + 0.25 AS z
           FROM embeddings)
SELECT vec_id, round(1 - 1 / (1 + exp(-z)), 6) AS p0, round(1 / (1 + exp(-z)), 6) AS p1 FROM z""",
    "softmax_argmax": """
WITH z AS (SELECT vec_id, embedding[1]::DOUBLE * 10 AS a, embedding[2]::DOUBLE * 10 AS b
           FROM embeddings)
SELECT vec_id, round(exp(a) / (exp(a) + exp(b)), 6) AS p0,
       round(exp(b) / (exp(a) + exp(b)), 6) AS p1, (b > a)::INT AS y_pred FROM z""",
    "weighted_blend": f"""
WITH w AS (SELECT doc_id, {words('text')} AS w, {count_of('text', ',')} AS commas FROM documents),
p AS (
  SELECT doc_id, 1 / (1 + exp(-(2 * CASE WHEN len(w) = 0 THEN 0 ELSE len(w)::DOUBLE
           / len(list_distinct(w)) END - {2 * REPETITION_CUT}))) AS a,
         least(1, commas * 4::DOUBLE / greatest(len(w), 1)) AS b FROM w),
blend AS (SELECT doc_id, (1 - a) * 0.6 + (1 - b) * 0.4 AS p0, a * 0.6 + b * 0.4 AS p1 FROM p)
SELECT doc_id::VARCHAR AS sample_id, round(p0, 6) AS p0, round(p1, 6) AS p1,
       (p1 > p0)::INT AS y_pred FROM blend""",
    "confusion_matrix": f"""WITH {PREDICTIONS},
spine AS (SELECT unnest([0, 1]) AS actual)
SELECT actual, count(*) FILTER (y_pred = 0) AS predicted_human,
       count(*) FILTER (y_pred = 1) AS predicted_ai
FROM spine LEFT JOIN predictions ON y_true = actual GROUP BY actual""",
    "binary_metrics": f"""WITH {PREDICTIONS},
cells AS (SELECT lang, {CELLS} FROM predictions GROUP BY lang)
SELECT *, {RATES} FROM cells""",
    "class_report": report_sql(),
    "class_report_by_language": report_sql("lang, "),
    "percent_display": f"""WITH {PREDICTIONS},
cells AS (SELECT lang, {CELLS} FROM predictions GROUP BY lang),
rates AS (SELECT lang, {EXACT_RATES} FROM cells)
SELECT lang, {', '.join(f"printf('%.2f', round_even({r} * 100, 2)) || '%' AS {r}"
                        for r in ('accuracy', 'recall', 'false_positive_rate', 'false_negative_rate'))}
FROM rates""",
    "metrics_by_group": f"""WITH {PREDICTIONS},
cells AS (SELECT lang, source, grouping(lang, source)::INT AS grouping_id, {CELLS}
          FROM predictions GROUP BY GROUPING SETS ((lang), (source), ()))
SELECT *, {RATES} FROM cells""",
    "epoch_pairs": f"""WITH {LOG},
paired AS (
  SELECT *, last_value(loss IGNORE NULLS) OVER w AS l, last_value(learning_rate IGNORE NULLS) OVER w
         AS r FROM log
  WINDOW w AS (PARTITION BY epoch ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT seq, epoch, l AS loss, eval_loss, round(r, 6) AS learning_rate FROM paired
WHERE eval_loss IS NOT NULL AND l IS NOT NULL""",
    "best_step": f"""WITH {LOG}
SELECT seq, epoch, eval_loss FROM log WHERE eval_loss IS NOT NULL ORDER BY eval_loss, seq LIMIT 1""",
}
