"""SQL with the same rows as the registered queries, where SQL can express them.

The trained models (1, 5, 9) and the tokenizer (7) are beyond SQL: tests hold them to held-out rows and to a
plain best-fit version.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_ITEM_WORDS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op2_substring_dedup"] = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], chr(10))) AS k FROM p),
f AS (SELECT k, min(doc_id) AS first FROM k GROUP BY k),
h AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM k JOIN f USING (k) WHERE first < doc_id),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
r AS (SELECT x.doc_id, count(*) AS n_removed FROM h JOIN x USING (doc_id, j) GROUP BY ALL),
s AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept FROM x ANTI JOIN h USING (doc_id, j) GROUP BY ALL)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN s USING (doc_id)
"""


def _escaped(text: str, marks: str) -> str:
    """Length of a text once each of ``marks`` is preceded by a backslash."""
    return f"(2 * length({text}) - length(translate({text}, '{marks}', '')))"


_ROLE_MARKS, _TEXT_MARKS = "\\<#:", "\\<#"
ORACLES["op3_chat_format"] = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
l AS (SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(sum(length(loss)) AS BIGINT) AS loss_chars, sha256(string_agg(loss, '' ORDER BY turn, role, text)) AS loss_sha256,
CAST(sum(14 + {_escaped("role", _ROLE_MARKS)} + {_escaped("text", _TEXT_MARKS)}) AS BIGINT) AS formatted_chars
FROM l GROUP BY conv_id
"""

_STRENGTH = (
    "SELECT CASE WHEN coalesce(g, 0) < 2 THEN 1000.0 WHEN f <= 0 OR s - (g - 1) <= 0 THEN 1000.0 WHEN (s - (g - 1)) / f >= 1 THEN 0.5 "
    "ELSE least(1000.0, greatest(0.5, (1 - (s - (g - 1)) / f) / ((s - (g - 1)) / f))) END AS s FROM (SELECT s, g, n - q / n - (g - 1) AS f FROM "
    "(SELECT sum(n * pow(k / n - m, 2) / (m * (1 - m))) AS s, count(*) AS g, sum(n) AS n, sum(n * n) AS q FROM {0} WHERE m > 0 AND m < 1 AND n > 0))"
)
ORACLES["op4_url_filter"] = f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS h FROM u),
p AS (SELECT page_id, {_LOWER.format("h")} AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path,
TRY_CAST(regexp_extract(url, '/(\\d{{1,18}})(?:\\.html|/)?(?:[?#].*)?$', 1) AS BIGINT) AS doc_id FROM v),
g AS (SELECT doc_id, min(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1),
q AS (SELECT p.*, good, list_aggregate(string_split(host, '.')[-2:], 'string_agg', '.') AS domain, string_split(host, '.')[-1] AS suffix FROM p LEFT JOIN g USING (doc_id)),
h0 AS (SELECT host, domain, suffix, CAST(count(good) AS DOUBLE) AS n, CAST(coalesce(sum(good), 0) AS DOUBLE) AS k FROM q GROUP BY ALL),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h0 GROUP BY ALL),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d0 GROUP BY ALL),
w AS (SELECT CASE WHEN sum(n) > 0 THEN sum(k) / sum(n) ELSE 0.5 END AS m FROM s0),
s1 AS (SELECT s0.*, m FROM s0, w), ss AS ({_STRENGTH.format("s1")}),
s2 AS (SELECT suffix, (k + s * m) / (n + s) AS m FROM s1, ss),
d1 AS (SELECT d0.*, m FROM d0 JOIN s2 USING (suffix)), ds AS ({_STRENGTH.format("d1")}),
d2 AS (SELECT domain, suffix, (k + s * m) / (n + s) AS m FROM d1, ds),
h1 AS (SELECT h0.*, m FROM h0 JOIN d2 USING (domain, suffix)), hs AS ({_STRENGTH.format("h1")}),
h2 AS (SELECT host, k + s * m AS a, n - k + s * (1 - m) AS b FROM h1, hs),
h3 AS (SELECT host, least(1.0, a / (a + b) + 2.0 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1))) AS upper FROM h2),
r AS (SELECT q.*, CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM q)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN upper < 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM r LEFT JOIN h3 USING (host)
"""

ORACLES["op6_decontaminate"] = f"""
WITH i AS (SELECT item_id, {_ITEM_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM benchmark),
n AS (SELECT item_id, w, least(10, len(w)) AS n FROM i WHERE len(w) > 0),
y AS (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM n),
x AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM y),
d AS (SELECT doc_id, {_ITEM_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
c AS (SELECT doc_id, w, n FROM d, (SELECT DISTINCT n FROM x) WHERE len(w) >= n),
p AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM c),
h AS (SELECT doc_id, p.n, s, item_id FROM p JOIN x ON x.n = p.n AND x.k = array_to_string(w[s:s + p.n - 1], ' ')),
a AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS j FROM h) GROUP BY 1),
b AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)
"""

#: Smallest reachable id over undirected links ``e`` (a, b).
_REACHED = (
    "c(node, label) AS (SELECT a, a FROM e UNION SELECT e.b, c.label FROM c JOIN e ON e.a = c.node WHERE c.label < e.b), "
    "m AS (SELECT node, min(label) AS label FROM c GROUP BY 1)"
)
ORACLES["op8_embedding_dedup"] = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
g AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS r FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
e AS (SELECT s.vec_id AS a, t.vec_id AS b FROM g s JOIN g t ON s.vec_id <> t.vec_id AND len(s.x) = len(t.x) WHERE list_dot_product(s.x, t.x) / (s.r * t.r) >= 0.95),
{_REACHED},
l AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(label, vec_id)) AS component_id, least(vec_id, coalesce(label, vec_id)) = vec_id AS kept
FROM v LEFT JOIN l USING (vec_id) LEFT JOIN m ON m.node = vec_id
"""

ORACLES["op10_ngram_jaccard"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
t AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM t x JOIN t y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 90 * (p.n + q.n - shared)),
{_REACHED}
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce(label, doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.node = doc_id
"""


_CRC32 = (
    "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split({0}, ''), lambda x: CAST(ascii(x) AS UBIGINT))), "
    "lambda c, x: list_reduce(list_prepend(xor(c, x), [CAST(k AS UBIGINT) for k in range(8)]), "
    "lambda d, k: CASE WHEN d & 1 = 1 THEN xor(d >> 1, CAST(3988292384 AS UBIGINT)) ELSE d >> 1 END)))"
)


def _leaf(**other: str) -> str:
    texts = [f"CAST({other.get(c, c)} AS VARCHAR)" for c in ("doc_id", "source", "lang", "n_chars", "text")]
    return "sha256(" + " || ".join(f"coalesce(strlen({t}) || ':' || {t}, '-')" for t in texts) + ")"


def _tree(name: str, levels: int) -> str:
    """Tables name0.. of nodes (g, r, h, c = nodes of the level), and name0s.. of each node's siblings."""
    out = []
    for k in range(levels):
        out.append(
            f"{name}{k + 1} AS (SELECT g, r // 16 AS r, CASE WHEN max(c) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY r)) END AS h, "
            f"CASE WHEN max(c) = 1 THEN 1 ELSE (max(c) + 15) // 16 END AS c FROM {name}{k} GROUP BY g, r // 16)"
        )
        out.append(
            f"{name}{k}s AS (SELECT a.g, a.r, any_value(a.c) AS c, coalesce(string_agg(b.h, '' ORDER BY b.r) FILTER (b.r < a.r), '') AS p, "
            f"coalesce(string_agg(b.h, '' ORDER BY b.r) FILTER (b.r > a.r), '') AS q FROM {name}{k} a JOIN {name}{k} b ON a.g = b.g AND a.r // 16 = b.r // 16 GROUP BY a.g, a.r)"
        )
    return ",\n".join(out)


def _folds(name: str, levels: int, value: str, rank: str, group: str) -> tuple[str, str, str]:
    """The proof's text, the folded value and the joins of one tree."""
    proof, joins = "", ""
    for k in range(levels):
        at = f"{name}{k}j"
        joins += f" JOIN {name}{k}s {at} ON {at}.g = {group} AND {at}.r = {rank} // {16**k}"
        proof += f" || {at}.p || {at}.q"
        value = f"CASE WHEN {at}.c = 1 THEN {value} ELSE sha256({at}.p || {value} || {at}.q) END"
    return proof, value, joins


#: Levels enough for 65 536 documents a source and 256 sources.
_LOW, _TOP = 4, 2
_LOW_PROOF, _LOW_FOLD, _LOW_JOINS = _folds("n", _LOW, "v", "d.r", "d.g")
_TOP_PROOF, _TOP_FOLD, _TOP_JOINS = _folds("t", _TOP, "v", "g", "0")
ORACLES["op11_merkle_manifest"] = f"""
WITH b AS (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, {_leaf()} AS leaf,
CASE WHEN {_CRC32.format("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {_leaf(text=_LOWER.format("text"))} ELSE {_leaf()} END AS v FROM documents),
d AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM b),
n0 AS (SELECT g, r, leaf AS h, count(*) OVER (PARTITION BY g) AS c FROM d),
{_tree("n", _LOW)},
t0 AS (SELECT 0 AS g, g AS r, h, count(*) OVER () AS c FROM n{_LOW}),
{_tree("t", _TOP)},
e AS (SELECT d.doc_id, d.leaf, d.g, ''{_LOW_PROOF} AS proof, {_LOW_FOLD} AS v FROM d {_LOW_JOINS}),
f AS (SELECT doc_id, leaf, e.g, proof{_TOP_PROOF} AS proof, {_TOP_FOLD} AS folded FROM e {_TOP_JOINS.replace("= g //", "= e.g //")})
SELECT doc_id, leaf, n{_LOW}.h AS subroot, t{_TOP}.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = t{_TOP}.h AS verified
FROM f JOIN n{_LOW} ON n{_LOW}.g = f.g, t{_TOP}
"""

ORACLES["op12_collocations"] = f"""
WITH x AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM x),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
g AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS a FROM s, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
z AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY 1),
f AS (SELECT * FROM g WHERE a >= 100),
e AS (SELECT lang, a, unnest([array_to_string(string_split(phrase, ' ')[:-2], ' '), array_to_string(string_split(phrase, ' ')[2:], ' ')]) AS phrase FROM f WHERE k > 2),
m AS (SELECT lang, phrase, max(a) AS more FROM e GROUP BY ALL),
c AS (SELECT f.* FROM f LEFT JOIN m USING (lang, phrase) WHERE k > 1 AND coalesce(100 * more < 100 * f.a, true)),
u AS (SELECT *, unnest(range(1, k)) AS j FROM c),
v AS (SELECT u.*, l.a AS l, r.a AS r, n, CAST((CAST(1000 AS HUGEINT) * u.a * n) // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score FROM u JOIN z USING (lang)
JOIN f l ON l.lang = u.lang AND l.phrase = array_to_string(string_split(u.phrase, ' ')[1:j], ' ')
JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(string_split(u.phrase, ' ')[j + 1:], ' ')),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
