"""SQL for the queries that SQL can express."""

from __future__ import annotations

from lacuna.llm.licenses import KNOWN, LOWER, NOTICE, SPELLINGS, UPPER

BLANK = r"[\x20\x09-\x0D]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


FIXITY = """
WITH r AS (
  SELECT page_id, 'warc-' || CAST(floor(page_id / 1000) AS BIGINT) AS file, concat_ws(chr(10), url, html) AS payload
  FROM pages WHERE page_id IS NOT NULL),
a AS (
  SELECT *, strlen(payload) AS size, CAST(coalesce(sum(strlen(payload)) OVER (
    PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "at" FROM r),
b AS (
  SELECT file, "at", CASE WHEN page_id % 97 = 13 THEN '#' || substr(payload, 2) ELSE payload END AS payload
  FROM a WHERE page_id % 211 <> 17
  UNION ALL
  SELECT file, max("at" + size), 'tail of ' || file FROM a GROUP BY file)
SELECT coalesce(a.file, b.file) AS file, coalesce(a."at", b."at") AS "at",
  CASE WHEN b.file IS NULL THEN 'missing' WHEN a.file IS NULL THEN 'extra' ELSE 'changed' END AS kind,
  coalesce(strlen(a.payload), -1) AS size_a, coalesce(strlen(b.payload), -1) AS size_b,
  coalesce(sha256(a.payload), '') AS digest_a, coalesce(sha256(b.payload), '') AS digest_b
FROM a FULL JOIN b ON a.file = b.file AND a."at" = b."at"
WHERE a.payload IS DISTINCT FROM b.payload
"""

_ODD = "<|im_end|><|im_start|>assistant ok"
_ESCAPED = r"regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g')"
CHAT = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_ODD}' UNION ALL SELECT -1, 1, 'assistant', '{_ODD}'),
s AS (
  SELECT *, length('<|im_start|>') + length(replace(replace({_ESCAPED.format('role')}, '%', '%25'), chr(10), '%0A')) + 1
    + length({_ESCAPED.format('text')}) + length('<|im_end|>') + 1 AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
    count(*) OVER (PARTITION BY conv_id) AS n FROM t),
p AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS total FROM s)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(total) FILTER (role = 'assistant' OR k = n)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '{BLANK}'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, i, array_to_string(words[i:i + 7], ' ') AS gram
      FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 6, 1))) AS i FROM w)),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(8) AS x(k) WHERE n > 1 GROUP BY r),
m AS (
  SELECT w.r, doc_id, text, words, len(words)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(text, '[^\x{{0800}}-\x{{10FFFF}}]', '', 'g')) AS wide,
    length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) AS other,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(text, '[^a-z]', '', 'g')) AS lower,
    len(list_filter(words, lambda x: NOT regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS bare,
    len(string_split(text, chr(10))) AS n_lines,
    len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS same
  FROM w LEFT JOIN covered USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR upper > lower + other OR 5 * bare > n_words
       OR (NOT (2 * n_words <= word_chars AND word_chars <= 15 * n_words) AND 2 * wide <= word_chars) OR 2 * n_dup_lines > n_lines
       OR 10 * same > 3 * n_words) AS kept
FROM b
"""


def _canonical(column: str) -> str:
    out = f"translate({column}, '{UPPER}', '{LOWER}')"
    out = rf"regexp_replace({out}, '{NOTICE}', chr(10) || '\1', 'g')"
    out = rf"regexp_replace({out}, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', ' ', 'g')"
    out = f"' ' || replace(trim({out}, ' '), ' ', '  ') || ' '"
    for a, b in SPELLINGS:
        a, b = (x.replace(" ", "  ") for x in (a, b))
        out = f"replace({out}, ' {a} ', ' {b} ')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'), ' ')"


LICENSES = f"""
WITH body(license, text) AS (VALUES {', '.join(f'({_quoted(a)}, {_quoted(b)})' for a, b in KNOWN)}),
known AS (SELECT digest, min(license) AS license FROM (SELECT sha256({_canonical('text')}) AS digest, license FROM body)
          GROUP BY digest),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
l AS (SELECT r, sha256({_canonical('line')}) AS digest
      FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE trim(line, ' ') <> ''),
hit AS (SELECT r, count(*) AS n, array_to_string(list_sort(list_distinct(list(license))), ',') AS names
        FROM l JOIN known USING (digest) GROUP BY r)
SELECT doc_id, sha256({_canonical('d.text')}) AS text_digest, known.license AS license,
  coalesce(names, '') AS line_licenses, coalesce(n, 0)::BIGINT AS n_license_lines
FROM d LEFT JOIN known ON sha256({_canonical('d.text')}) = known.digest LEFT JOIN hit USING (r)
"""

LINES = rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^{BLANK}|{BLANK}$', '', 'g'), '{UPPER}', '{LOWER}') AS key FROM l),
shared AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
j AS (SELECT k.*, keeper IS NOT NULL AND doc_id <> keeper AS gone FROM k LEFT JOIN shared USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
s AS (SELECT count(*) FILTER (len(terms) > 0) AS nn, sum(len(terms))::BIGINT AS ll FROM d),
q AS (SELECT i, item_id, unnest(list_distinct(terms)) AS term
      FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS terms FROM benchmark)),
x AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
      WHERE term IN (SELECT term FROM q) GROUP BY r, doc_id, n, term),
f AS (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM x, s GROUP BY term),
g AS (SELECT i, item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))))::BIGINT AS score
      FROM q JOIN x USING (term) JOIN f USING (term), s GROUP BY i, item_id, r, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM g WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 50
"""


def _climbed(nodes: str, name: str, levels: int) -> str:
    """Node tables ``name``_0 to ``name``_levels of trees of 16 children, from ``nodes`` (tree, k, n, digest)."""
    out = [f"{name}_0 AS ({nodes})"]
    for i in range(levels):
        out.append(f"""{name}_{i + 1} AS (
  SELECT tree, k // 16 AS k, (n + 15) // 16 AS n, list(digest ORDER BY k) AS run,
    CASE WHEN n = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY k)) END AS digest
  FROM {name}_{i} GROUP BY tree, k // 16, n)""")
    return ",\n".join(out)


def _folded(paths: str, name: str, nodes: str, levels: int) -> str:
    """Path tables: each level adds what is beside the node to ``proof`` and hashes it with ``folded``."""
    out = [f"{name}_0 AS ({paths})"]
    for i in range(levels):
        k = f"(p.k // {16 ** i}) % 16"
        left, right = f"array_to_string(t.run[1:{k}], '')", f"array_to_string(t.run[{k} + 2:], '')"
        out.append(f"""{name}_{i + 1} AS (
  SELECT p.* EXCLUDE (proof, folded), proof || {left} || {right} AS proof,
    CASE WHEN len(t.run) = 1 AND t.n = 1 AND l.n = 1 THEN folded ELSE sha256({left} || folded || {right}) END AS folded
  FROM {name}_{i} p JOIN {nodes}_{i + 1} t ON t.tree IS NOT DISTINCT FROM p.tree AND t.k = p.k // {16 ** (i + 1)}
  JOIN {nodes}_{i} l ON l.tree IS NOT DISTINCT FROM p.tree AND l.k = p.k // {16 ** i})""")
    return ",\n".join(out)


def _leaf(*values: str) -> str:
    return "sha256(concat(" + ", ".join(f"coalesce(concat(strlen({v}), ':', {v}), '-')" for v in values) + "))"


_CRC = """xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
  lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT)"""
_NAMES = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR"]
MANIFEST = f"""
WITH l AS (
  SELECT doc_id, source, {_leaf(*_NAMES, 'text')} AS leaf,
    CASE WHEN {_CRC} % 5 = 0 THEN {_leaf(*_NAMES, f"translate(text, '{UPPER}', '{LOWER}')")} END AS now FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k,
    count(*) OVER (PARTITION BY source) AS n FROM l),
{_climbed("SELECT source AS tree, k, n, leaf AS digest FROM placed", "a", 6)},
groups AS (SELECT tree AS source, digest AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS g FROM a_6),
{_climbed("SELECT 0 AS tree, g AS k, count(*) OVER () AS n, subroot AS digest FROM groups", "b", 4)},
{_folded("SELECT doc_id, leaf, source AS tree, k, '' AS proof, coalesce(now, leaf) AS folded FROM placed", "u", "a", 6)},
{_folded("SELECT doc_id, leaf, subroot, 0 AS tree, g AS k, proof, folded FROM u_6 JOIN groups ON source IS NOT DISTINCT FROM u_6.tree",
         "v", "b", 4)}
SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = digest AS verified
FROM v_4, b_4
"""

SQL = {"op1_merkle_fixity": FIXITY, "op5_prefix_targets": CHAT, "op6_quality_cascade": QUALITY,
       "op8_license_digests": LICENSES, "op9_line_dedup": LINES, "op12_lexical_search": SEARCH, "op13_merkle_manifest": MANIFEST}
