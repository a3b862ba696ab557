"""Reference SQL of the operators that SQL can express, for small tables."""

from __future__ import annotations

from busweave.llm.secrets import BASE_RULES, RULES

# Fixed values of the contracts: white space, and A-Z to a-z.
_SPACE = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE32 = _UPPER + "234567"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{_SPACE}'), lambda x: x <> '')"


MINHASH = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_words(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh
  FROM w),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY ALL),
l AS (
  SELECT u, v FROM p JOIN s a ON a.doc_id = u JOIN s b ON b.doc_id = v
  WHERE 100 * n >= 85 * (len(a.sh) + len(b.sh) - n)),
both_ways AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
reach AS (
  SELECT doc_id, doc_id AS seen FROM documents
  UNION SELECT r.doc_id, b.v FROM reach r JOIN both_ways b ON b.u = r.seen)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY 1) c USING (doc_id)"""

SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, {_words("coalesce(text, '')")} AS ws FROM documents),
t AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS first FROM w WHERE len(ws) >= 35),
h AS (SELECT doc_id, first, md5(array_to_string(ws[first:first + 34], ' ')) AS h FROM t),
r AS (SELECT doc_id, first FROM h QUALIFY count(*) OVER (PARTITION BY h) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(first, first + 35)) AS place FROM r),
each AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS place FROM w),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS body, count(*) AS n
  FROM each ANTI JOIN gone USING (doc_id, place) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(body, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""

WARC = f"""
SELECT page_id, octet_length(encode(body)) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('{_BASE32}', 1 + CAST(
    ((CAST('0x' || substr(sha1(body) || '0', CAST(5 * i // 4 AS INTEGER) + 1, 2) AS INTEGER)
      >> CAST(3 - 5 * i % 4 AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> newest THEN newest END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS body,
  max(page_id) OVER (PARTITION BY md5(coalesce(html, ''))) AS newest FROM pages)"""


def _spelled(pattern: str) -> str:
    """The pattern with its case-insensitive group as explicit letters."""
    head, mark, rest = pattern.partition("(?i:")
    if not mark:
        return pattern
    group, _, tail = rest.partition(")")
    letters = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in group)
    return f"{head}(?:{letters}){tail}"


def _secret_spans(order: int) -> str:
    rule = RULES[order]
    pattern = _spelled(rule.pattern).replace("'", "''")
    return f"""
SELECT doc_id, unnest(list_transform(range(1, len(hits) + 1), lambda i: {{
    'start': CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g)))
      + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS BIGINT),
    'ord': {order}, 'kind': '{rule.kind}', 'size': length(hits[i]), 'n': length(wanted[i])}})) AS m
FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}', 0) AS hits,
    regexp_extract_all(text, '{pattern}', {rule.group}) AS wanted, string_split_regex(text, '{pattern}') AS gaps
  FROM documents WHERE regexp_matches(text, '{pattern}')) WHERE len(hits) > 0"""


def _secrets() -> str:
    parts = " UNION ALL ".join(
        f"SELECT * FROM ({_secret_spans(i)}) WHERE m.n >= {rule.least}" for i, rule in enumerate(RULES)
    )
    text = "m.kind || ':' || m.start || ':' || (m.start + m.size)"
    base = f"m.ord < {len(BASE_RULES)}"
    joined = f"string_agg({text}, ',' ORDER BY m.start, m.ord)"
    count = lambda kind: f"count(*) FILTER (m.kind = '{kind}') AS n_{kind}"
    return f"""
WITH spans AS ({parts}),
summed AS (
  SELECT doc_id, {count('assign')}, {count('access')}, {count('hex')},
    {joined} FILTER ({base}) AS base, {joined} AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
  coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN summed USING (doc_id)"""


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _terms(text: str) -> str:
    return f"unnest(regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '{_TERM}'))"


RANKING = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
t AS (SELECT row, {_terms('text')} AS term FROM d),
p AS (SELECT row, term, count(*) AS tf FROM t GROUP BY ALL),
s AS (SELECT row, count(*) AS n FROM t GROUP BY 1),
c AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM s),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM f, c),
m AS (SELECT row, 10 + (90 * n * n_docs) // n_terms AS m FROM s, c),
i AS (SELECT row_number() OVER () AS item, item_id, text FROM benchmark),
q AS (SELECT DISTINCT item, item_id, {_terms('text')} AS term FROM i),
r AS (
  SELECT item, item_id, row, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (row) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank,
  doc_id, score
FROM r JOIN d USING (row) WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) <= 10"""


def _merkle(heights: int = 6) -> str:
    """Trees of up to 16 ** heights leaves, and as many sources."""
    value = lambda v: f"coalesce(octet_length(encode(CAST({v} AS VARCHAR))) || ':' || CAST({v} AS VARCHAR), '-')"
    leaf = lambda text: f"sha256({' || '.join(map(value, ('doc_id', 'source', 'lang', 'n_chars', text)))})"
    bits = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c), 0, 0, 0, 0, 0, 0, 0]))"
    step = "CASE WHEN xor(c, e) & 1 = 1 THEN xor(xor(c, e) >> 1, 3988292384) ELSE xor(c, e) >> 1 END"
    crc = f"xor(list_reduce(list_transform({bits}, lambda b: CAST(b AS BIGINT)), lambda c, e: {step}, CAST(4294967295 AS BIGINT)), 4294967295)"
    parts = [f"""
l AS (
  SELECT doc_id, {leaf('text')} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN {leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS other,
    dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree, source FROM documents),
f0 AS (
  SELECT row_number() OVER () AS id, *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
    count(*) OVER (PARTITION BY tree) AS n, coalesce(other, leaf) AS now, '' AS proof, '' AS subroot FROM l),
a0 AS (SELECT tree, place, n, leaf AS digest FROM f0)"""]

    def climb(nodes: str, paths: str, k: int) -> str:
        return f"""
{nodes}{k + 1} AS (
  SELECT tree, place // 16 AS place, (n + 15) // 16 AS n, sha256(string_agg(digest, '' ORDER BY place)) AS digest
  FROM {nodes}{k} WHERE n > 1 GROUP BY tree, place // 16, n UNION ALL SELECT * FROM {nodes}{k} WHERE n = 1),
{paths}{k + 1} AS (
  SELECT f.id, f.tree, f.place // 16 AS place, (f.n + 15) // 16 AS n,
    sha256(string_agg(CASE WHEN a.place = f.place THEN f.now ELSE a.digest END, '' ORDER BY a.place)) AS now,
    f.proof || coalesce(string_agg(a.digest, '' ORDER BY a.place) FILTER (a.place <> f.place), '') AS proof
  FROM {paths}{k} f JOIN {nodes}{k} a ON a.tree = f.tree AND a.place // 16 = f.place // 16 AND f.n > 1
  GROUP BY f.id, f.tree, f.place, f.n, f.now, f.proof
  UNION ALL SELECT id, tree, place, n, now, proof FROM {paths}{k} WHERE n = 1)"""

    parts += [climb("a", "f", k) for k in range(heights)]
    parts.append(f"""
b0 AS (SELECT 0 AS tree, tree AS place, (SELECT count(*) FROM a{heights}) AS n, digest FROM a{heights}),
g0 AS (SELECT id, 0 AS tree, tree AS place, (SELECT count(*) FROM a{heights}) AS n, now, proof FROM f{heights})""")
    parts += [climb("b", "g", k) for k in range(heights)]
    return f"""WITH {','.join(parts)}
SELECT f0.doc_id, f0.leaf, a{heights}.digest AS subroot, b{heights}.digest AS root, sha256(g.proof) AS proof_sha256,
  g.now AS folded_root, g.now = b{heights}.digest AS verified
FROM f0 JOIN g{heights} g USING (id) JOIN a{heights} ON a{heights}.tree = f0.tree CROSS JOIN b{heights}"""


ORACLE_SQL = {
    "op7_warc": WARC,
    "op8_substring_dedup": SUBSTRINGS,
    "op9_secret_scan": _secrets(),
    "op10_circulant_minhash": MINHASH,
    "op11_merkle_manifest": _merkle(),
    "op13_ranked_search": RANKING,
}
