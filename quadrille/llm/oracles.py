"""DuckDB SQL for the corpus queries that SQL can express, made from the operators' own constants (lists of values, no logic)."""

from __future__ import annotations

from quadrille.llm import licenses, quality_rules

SPACES = r"[\x20\x09-\x0D]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def quoted(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


#: All pairs that share a shingle, and from each document all that it reaches.
NEAR_DUP = rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({LOWER}, '{SPACES}'), lambda x: x <> '') AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')) END) AS g FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
 e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
 r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id),
 c AS (SELECT doc_id, min(root) AS root FROM r GROUP BY 1)
 SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id, coalesce(root, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""


def license_sql() -> str:
    """Words of whole texts; templates by lines and by windows of twice their words, as the operator's docstring states."""
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    phrase = lambda p: f"list_filter(range(1, len(ws) + 1), lambda i: list_slice(ws, i, i + {len(p.split()) - 1}) = {quoted(p.split())})"
    marks = list(licenses.PHRASES.items())
    places = ", ".join(f"{phrase(p)} AS p{k}" for k, (p, _) in enumerate(marks))
    every = "list_concat(" * (len(marks) - 1) + "p0" + "".join(f", p{k})" for k in range(1, len(marks)))
    base = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(marks))
    found = []
    import re

    for name, text in licenses.TEMPLATES.items():
        known, n = licenses.words_in(text), len(re.findall(licenses.WORD + "+", text))
        label = name.split("-")[0] if name.startswith(("mit", "apache", "gpl")) else name
        share = f"list_max(list_concat(list_transform(lw, lambda b: len(list_intersect(list_distinct(b), {quoted(known)}))), list_transform(range(1, greatest(len(ws), 1) + 1, {n}), lambda i: len(list_intersect(list_distinct(list_slice(ws, i, i + {2 * n - 1})), {quoted(known)})))))"
        found.append(f"CASE WHEN {share} >= {-(-len(known) * 8 // 10)} THEN {{'label': '{label}', 'c': {share} / {len(known)}}} END")
    return rf"""WITH t AS (SELECT doc_id, regexp_extract_all({LOWER}, '{word}') AS ws, list_transform(string_split({LOWER}, chr(10)), lambda x: regexp_extract_all(x, '{word}')) AS lw FROM documents),
 p AS (SELECT doc_id, ws, {places}, list_filter([{", ".join(found)}], lambda x: x IS NOT NULL) AS found FROM t),
 q AS (SELECT *, {every} AS places, list_filter([{base}], lambda x: x IS NOT NULL) AS base FROM p)
 SELECT doc_id, len(ws) AS n_words, len(places) AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word, coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
 coalesce(array_to_string(list_sort(list_distinct(list_concat(base, list_transform(found, lambda x: x.label)))), ','), '') AS labels, CASE WHEN len(base) > 0 THEN 1.0 ELSE coalesce(list_max(list_transform(found, lambda x: x.c)), 0.0) END AS score FROM q"""


def rules_sql() -> str:
    """Counts, then the certified cutoffs of each stratum and rule by exact binomial tails, then verdicts."""
    text, solid = "coalesce(text, '')", f"length(regexp_replace(coalesce(text, ''), '{SPACES}', '', 'g'))"
    gone = lambda what: f"length({text}) - length(regexp_replace({text}, '{what}', '', 'g'))"
    values = {"symbol_share": ("n_symbols", "word_chars"), "upper_share": ("n_upper", "word_chars"), "shout_share": ("n_shouts", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words")}
    shares = ", ".join(f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0.0 END AS {r}" for r, (a, b) in values.items())
    rows = ", ".join(f"({i}, '{r}', {k}, {c})" for i, (r, cs) in enumerate(quality_rules.RULES.items()) for k, c in enumerate(cs))
    value = "CASE rule " + " ".join(f"WHEN '{r}' THEN {r}" for r in quality_rules.RULES) + " END"
    n_rules = len(quality_rules.RULES)
    return rf"""WITH w AS (SELECT doc_id, lang, text, list_filter(regexp_split_to_array({text}, '{SPACES}'), lambda x: x <> '') AS ws, list_filter(string_split({text}, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
 g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: list_slice(ws, i, i + 2))) AS t FROM w),
 h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM g),
 k AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM h, unnest([0, 1, 2]) u(o) WHERE n > 1 GROUP BY 1),
 m AS (SELECT w.doc_id, CASE WHEN lang IN ('en', 'de', 'fr', 'es') THEN lang ELSE 'other' END AS stratum, len(ws) AS n_words, {solid} AS word_chars, {gone(r"[#*$%&|<>]+")} AS n_symbols, {gone("[A-Z]+")} AS n_upper, {gone("!+")} AS n_shouts, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN k USING (doc_id)),
 v AS (SELECT *, {shares} FROM m),
 q AS (SELECT v.*, y.quality FROM v JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) y USING (doc_id)),
 c AS (SELECT * FROM (VALUES {rows}) t(r, rule, k, cutoff)),
 n AS (SELECT stratum, r, rule, k, cutoff, count(*) FILTER (WHERE quality = 1) AS clean, count(*) FILTER (WHERE quality = 1 AND {value} > cutoff) AS wrong, count(*) FILTER (WHERE quality = 0 AND {value} > cutoff) AS caught FROM q, c GROUP BY 1, 2, 3, 4, 5),
 z AS (SELECT {quality_rules.DELTA} / (greatest(count(DISTINCT stratum), 1) * {n_rules}) AS level, {quality_rules.RISK} / {n_rules} AS risk FROM n),
 b AS (SELECT n.*, wrong < clean AND (SELECT sum(exp(lgamma(clean + 1.0) - lgamma(i + 1.0) - lgamma(clean - i + 1.0) + i * ln(risk) + (clean - i) * ln(1 - risk))) FROM unnest(range(0, wrong + 1)) u(i)) <= level AS ok FROM n, z),
 f AS (SELECT *, bool_and(ok) OVER (PARTITION BY stratum, r ORDER BY cutoff DESC) AS passed FROM b),
 o AS (SELECT *, row_number() OVER (PARTITION BY stratum, r ORDER BY caught DESC, cutoff DESC) AS best FROM f WHERE passed),
 x AS (SELECT v.doc_id, arg_min(rule, r) AS rejected_by FROM v JOIN o ON o.stratum = v.stratum AND best = 1 AND caught > 0 WHERE {value} > cutoff GROUP BY 1)
 SELECT v.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND rejected_by IS NULL AS kept, rejected_by FROM v LEFT JOIN x USING (doc_id)"""


#: All phrases of up to five words are counted; parts of frequent ones are frequent.
COLLOCATIONS = r"""WITH pieces AS (SELECT row_number() OVER () AS p, lang, piece FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
words AS (SELECT p, lang, string_split_regex(trim(piece, ' ' || chr(9)), '[ \x09]+') AS w FROM pieces WHERE trim(piece, ' ' || chr(9)) <> ''),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
sized AS (SELECT lang, w, i, unnest(range(1, 6)) AS m FROM starts),
counts AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, m, count(*) AS f FROM sized WHERE i + m - 1 <= len(w) GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE m = 1 GROUP BY lang),
frequent AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE f >= 100),
covers AS (SELECT lang, array_to_string(w[1:m - 1], ' ') AS phrase, f FROM frequent WHERE m > 2 UNION ALL SELECT lang, array_to_string(w[2:m], ' ') AS phrase, f FROM frequent WHERE m > 2),
kept AS (SELECT c.* FROM frequent c WHERE m > 1 AND NOT EXISTS (SELECT 1 FROM covers v WHERE v.lang = c.lang AND v.phrase = c.phrase AND 100 * v.f >= 100 * c.f)),
cuts AS (SELECT lang, phrase, f AS a, w, m, unnest(range(1, m)) AS k FROM kept),
scores AS (SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, t.n, ((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN frequent x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ') JOIN frequent y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:c.m], ' ') JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000"""

#: Prefixes are digests of all turns up to a depth; crc32 is taken bit by bit.
PREFIX_TRIE = """WITH RECURSIVE ordered AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id FROM ordered),
crc AS (SELECT conv_id, conv_id::VARCHAR AS s, 0 AS bit, 4294967295::BIGINT AS c FROM ids
  UNION ALL SELECT conv_id, s, bit + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END
  FROM (SELECT conv_id, s, bit, CASE WHEN bit % 8 = 0 THEN xor(c, ascii(s[bit // 8 + 1])::BIGINT) ELSE c END AS x FROM crc WHERE bit < 8 * length(s))),
heads AS (SELECT conv_id, conv_id - conv_id % 5 AS root, xor(c, 4294967295::BIGINT) % 9 AS h FROM crc WHERE bit = 8 * length(s)),
turns AS (SELECT h.conv_id, 0 AS part, o.pos, o.role, o.text FROM heads h JOIN ordered o ON o.conv_id = h.root AND o.pos < h.h UNION ALL SELECT h.conv_id, 1, o.pos, o.role, o.text FROM heads h JOIN ordered o ON o.conv_id = h.conv_id AND o.pos >= h.h),
keyed AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth, sha256(length(role) || ':' || role || text) AS key, strlen(text) AS size FROM turns),
chained AS (SELECT conv_id, depth, size, sha256(string_agg(key, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS id FROM keyed
  UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
paths AS (SELECT *, lag(id) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, lead(id) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS ends FROM chained),
nodes AS (SELECT id, any_value(parent) AS parent, any_value(depth) AS depth, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM paths GROUP BY id),
children AS (SELECT parent AS id, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
owned AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.id = n.id),
-- A node adds to what is above it through its smallest member.
above AS (SELECT a.id, count(*) FILTER (WHERE o.n_children = 0) AS n_leaves, sum((o.n_convs - 1) * o.size) AS saved_tokens FROM owned o JOIN paths a ON a.conv_id = o.conv_id AND a.depth <= o.depth GROUP BY a.id)
SELECT o.conv_id, o.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, a.n_leaves, a.saved_tokens::BIGINT AS saved_tokens, o.ends_sha256 FROM owned o JOIN above a ON a.id = o.id LEFT JOIN owned p ON p.id = o.parent"""


ORACLE = {"op3_licenses": license_sql(), "op8_near_dup": NEAR_DUP, "op10_quality_rules": rules_sql(), "op12_collocations": COLLOCATIONS, "op13_prefix_trie": PREFIX_TRIE}
