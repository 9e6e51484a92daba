"""SQL for the operators that SQL can express. The others are compared with brute force in tests/llm."""

SPACE = r"\x20\x09-\x0D"
_WORDS = f"list_filter(string_split_regex(t, '[{SPACE}]+'), lambda x: x <> '')"
_DOCS = "d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents)"

QUALITY = rf"""
WITH {_DOCS},
w AS (SELECT rid, {_WORDS} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS lines FROM d),
tok AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
tri AS (SELECT rid, i, word || ' ' || lead(word, 1) OVER p || ' ' || lead(word, 2) OVER p AS g FROM tok
        WINDOW p AS (PARTITION BY rid ORDER BY i)),
rep AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM tri WHERE g IS NOT NULL),
hit AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) AS v(k) WHERE c > 1 GROUP BY rid),
f AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
             len(lines) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS capitals,
             length(regexp_replace(t, '[^!]', '', 'g')) AS marks, length(regexp_replace(t, '[^0-9]', '', 'g')) AS digits
      FROM d JOIN w USING (rid) LEFT JOIN hit USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       CASE WHEN base_failed THEN false ELSE NOT (10 * n_symbols > 3 * n_words OR 2 * capitals > word_chars OR 2 * marks > n_words
            OR 10 * digits > 3 * word_chars OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words) END AS kept
FROM b"""

# The rules of quern.llm.secrets with letter classes instead of a case flag, which here would also fold letters beyond ASCII.
_RULES = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\x00-\x20/:@]{1,64}:[^\x00-\x20/@]{3,64}@", 0, 0),
)
_MATCHES = " UNION ALL ".join(
    f"SELECT rid, {i} AS rule, '{kind}' AS kind, {least} AS least, unnest(string_split_regex(t, '{p}')) AS gap, "
    f"unnest(list_append(regexp_extract_all(t, '{p}', 0), NULL)) AS m, unnest(list_append(regexp_extract_all(t, '{p}', {group}), NULL)) AS v, "
    f"unnest(range(1, len(regexp_extract_all(t, '{p}', 0)) + 2)) AS i FROM d" for i, (kind, p, group, least) in enumerate(_RULES))
SECRETS = f"""
WITH {_DOCS}, m AS ({_MATCHES}),
s AS (SELECT rid, rule, kind, least, v, sum(length(gap)) OVER p + coalesce(sum(length(m)) OVER q, 0) AS a, length(m) AS n FROM m
      WINDOW p AS (PARTITION BY rid, rule ORDER BY i),
             q AS (PARTITION BY rid, rule ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT rid, rule, kind, a, kind || ':' || a || ':' || (a + n) AS span FROM s WHERE n IS NOT NULL AND length(v) >= least)
SELECT doc_id, count(*) FILTER (kind = 'assign')::BIGINT AS n_assign, count(*) FILTER (kind = 'access')::BIGINT AS n_access,
       count(*) FILTER (kind = 'hex')::BIGINT AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY a, rule) FILTER (rule < 3), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY a, rule), '') AS spans
FROM d LEFT JOIN k USING (rid) GROUP BY rid, doc_id"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = f"list_filter(string_split_regex({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
CONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, l, array_to_string(list_slice(w, i, i + l - 1), ' ') AS g
       FROM (SELECT item_id, w, least(len(w), 10) AS l, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dt AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
dw AS (SELECT rid, i, 10 AS l, g FROM (SELECT rid, i, string_agg(word, ' ') OVER p AS g, count(*) OVER p AS n FROM dt
       WINDOW p AS (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)) WHERE n = 10
       UNION ALL
       SELECT rid, i, l, array_to_string(list_slice(w, i, i + l - 1), ' ')
       FROM (SELECT rid, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM bw WHERE l < 10))),
h AS (SELECT dw.rid, dw.i, dw.l, bw.item_id FROM dw JOIN bw ON dw.l = bw.l AND dw.g = bw.g),
p AS (SELECT rid, count(DISTINCT pos) AS n FROM (SELECT rid, unnest(range(i, i + l)) AS pos FROM h) GROUP BY rid),
i AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s
      FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM h WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(p.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(p.n, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (rid) LEFT JOIN i USING (rid)"""

_DECODED = "x"
for _name, _char in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "''"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
    _DECODED = f"replace({_DECODED}, '{_name}', '{_char}')"
MAIN_TEXT = rf"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS inner_html FROM pages),
b AS (SELECT rid, page_id, url, list_filter(list_transform(list_transform(string_split_regex(inner_html, '</?(?:p|h1)>'),
             lambda x: regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g')),
             lambda x: trim(regexp_replace({_DECODED}, '\s+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM p)
SELECT page_id, url, array_to_string(blocks, chr(10) || chr(10)) AS text, length(array_to_string(blocks, chr(10) || chr(10)))::BIGINT AS n_chars FROM b"""

REPEATS = f"""
WITH {_DOCS},
w AS (SELECT rid, {_WORDS} AS w FROM d),
tok AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
win AS (SELECT rid, i, word, string_agg(word, ' ') OVER p AS g, count(*) OVER p AS n FROM tok
        WINDOW p AS (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
c AS (SELECT g FROM win WHERE n = 35 GROUP BY g HAVING count(*) > 1),
f AS (SELECT rid, i, word, max(CASE WHEN n = 35 AND c.g IS NOT NULL THEN 1 ELSE 0 END)
             OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
      FROM win LEFT JOIN c ON win.g = c.g)
SELECT doc_id, count(i)::BIGINT AS n_words, coalesce(sum(gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (gone = 0), '')) AS kept_sha256
FROM d LEFT JOIN f USING (rid) GROUP BY rid, doc_id"""

_PIECES = r"[.,;:!?\x0A-\x0D]"
_LENGTHS = range(2, 6)
_CUTS = " UNION ALL ".join(
    f"SELECT lang, g, ids, {m} AS m, a, {k} AS k, list_slice(ids, 1, {k}) AS x, list_slice(ids, {k} + 1, {m}) AS y FROM left_ WHERE m = {m}"
    for m in _LENGTHS for k in range(1, m))
COLLOCATIONS = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, {_LOWER} AS t FROM documents),
p AS (SELECT rid, lang, unnest(string_split_regex(t, '{_PIECES}')) AS piece, generate_subscripts(string_split_regex(t, '{_PIECES}'), 1) AS j FROM t),
w AS (SELECT rid, lang, j, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, list_slice(w, i, i + m - 1) AS ids, m
      FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (VALUES (1), (2), (3), (4), (5)) AS v(m) WHERE len(w) >= m)),
c AS (SELECT lang, ids, m, array_to_string(ids, ' ') AS g, count(*)::BIGINT AS a FROM g GROUP BY lang, ids, m HAVING count(*) >= 100),
i AS (SELECT lang, list_slice(ids, s, s + m - 2) AS ids, a FROM c, (VALUES (1), (2)) AS v(s) WHERE m > 2),
left_ AS (SELECT c.* FROM c WHERE m > 1 AND NOT EXISTS (SELECT 1 FROM i WHERE i.lang = c.lang AND i.ids = c.ids AND 100 * i.a >= 100 * c.a)),
q AS ({_CUTS}),
s AS (SELECT q.lang, q.g, q.ids, q.a, q.k, x.a AS l, y.a AS r, n.n, ((1000::HUGEINT * q.a * n.n) // (x.a::HUGEINT * y.a))::BIGINT AS score
      FROM q JOIN n ON n.lang = q.lang JOIN c AS x ON x.lang = q.lang AND x.ids = q.x JOIN c AS y ON y.lang = q.lang AND y.ids = q.y),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, ids ORDER BY score, k) AS z FROM s),
f AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM b WHERE z = 1)
SELECT lang, rank, g AS phrase, a, l, r, n, score FROM f WHERE rank <= 2000"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_LEAF = lambda text: "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
_CRC_BIT = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
_CRC = (f"(SELECT list(v ORDER BY i) FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, b: {_CRC_BIT}) AS v FROM range(256) AS r(i)))")


def _tree(name: str, depth: int) -> str:
    """Levels of nodes named {name}0 to {name}{depth}, with the siblings left and right of each."""
    sides = ("coalesce(string_agg(h, '') OVER (PARTITION BY g, idx // 8 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, "
             "coalesce(string_agg(h, '') OVER (PARTITION BY g, idx // 8 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after")
    parts = [f"{name}0 AS (SELECT *, {sides} FROM {name})"]
    for k in range(1, depth + 1):
        parts.append(f"{name}{k} AS (SELECT *, {sides} FROM (SELECT g, idx // 8 AS idx, (size + 7) // 8 AS size, sha256(string_agg(h, '' ORDER BY idx)) AS h "
                     f"FROM {name}{k - 1} WHERE size > 1 GROUP BY g, idx // 8, size))")
    tops = " UNION ALL ".join(f"SELECT g, h FROM {name}{k} WHERE size = 1" for k in range(depth + 1))
    return ", ".join([*parts, f"{name}_top AS ({tops})"])


def _folds(name: str, depth: int, start: str, g: str, idx: str) -> tuple[str, str, str]:
    """(joins, folded digest, proof) along the levels of a tree."""
    joins, folded, proof = "", start, []
    for k in range(depth):
        joins += f" LEFT JOIN {name}{k} AS {name}_at{k} ON {name}_at{k}.g = {g} AND {name}_at{k}.idx = {idx} // {8 ** k} AND {name}_at{k}.size > 1"
        folded = f"CASE WHEN {name}_at{k}.h IS NULL THEN {folded} ELSE sha256({name}_at{k}.before || ({folded}) || {name}_at{k}.after) END"
        proof.append(f"coalesce({name}_at{k}.before || {name}_at{k}.after, '')")
    return joins, folded, " || ".join(proof)


_LOW_JOINS, _LOW_FOLD, _LOW_PROOF = _folds("leaf", 7, "d.tampered", "d.g", "d.idx")
_TOP_JOINS, _TOP_FOLD, _TOP_PROOF = _folds("lang", 3, "low.folded", "0", "low.g")
MANIFEST = f"""
WITH crc AS (SELECT {_CRC} AS t),
x AS (SELECT *, coalesce(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda b: ascii(b)::BIGINT)),
             lambda c, b: xor(c >> 8, crc.t[xor(c & 255, b) + 1])), 4294967295) % 3 = 0, false) AS struck FROM documents, crc),
y AS (SELECT doc_id, lang, {_LEAF("text")} AS h, CASE WHEN struck THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS text2, source, n_chars FROM x),
d AS (SELECT doc_id, h, {_LEAF("text2")} AS tampered, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
             row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS size FROM y),
leaf AS (SELECT g, idx, size, h FROM d), {_tree("leaf", 7)},
lang AS (SELECT 0 AS g, g AS idx, count(*) OVER () AS size, h FROM leaf_top), {_tree("lang", 3)},
low AS (SELECT d.doc_id, d.g, d.h, {_LOW_FOLD} AS folded, {_LOW_PROOF} AS proof FROM d{_LOW_JOINS}),
high AS (SELECT low.*, {_TOP_FOLD} AS up, low.proof || {_TOP_PROOF} AS whole FROM low{_TOP_JOINS})
SELECT doc_id, high.h AS leaf, leaf_top.h AS subroot, lang_top.h AS root, sha256(whole) AS proof_sha256, up AS folded_root, up = lang_top.h AS verified
FROM high JOIN leaf_top ON leaf_top.g = high.g, lang_top"""

URL_VERDICTS = """
WITH u AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT rid, page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT rid, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS v(rh, rp, v)),
m AS (SELECT rid, arg_max(rh || rp, length(rh || rp) * 1000 + length(rh)) AS rule, arg_max(v, length(rh || rp) * 1000 + length(rh)) AS v
      FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m USING (rid)"""

ORACLES: dict[str, str] = {
    "op2_quality": QUALITY, "op4_secrets": SECRETS, "op6_contamination": CONTAMINATION, "op8_main_text": MAIN_TEXT,
    "op10_repeated_passages": REPEATS, "op11_collocations": COLLOCATIONS, "op12_manifest": MANIFEST,
    "op13_url_verdicts": URL_VERDICTS,
}
