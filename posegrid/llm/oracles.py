"""DuckDB SQL for the queries that SQL can express. Tokens, fingerprints and trained models have tests instead."""

from . import line_rules as rules
from . import phrase_index as index
from . import url_reputation as urls


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_UPPER, _LOWER = urls.UPPER, urls.LOWER
_SUFFIXES = ", ".join(f"'{x}'" for x in urls.SUFFIXES)

OP1 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
t AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars FROM w),
g AS (SELECT doc_id, p, [w[p], w[p + 1], w[p + 2]] AS g FROM w, unnest(range(1, greatest(1, len(w) - 1))) AS u(p)),
r AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g),
rep AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM r, unnest([p, p + 1, p + 2]) AS u(q) WHERE c > 1 GROUP BY doc_id),
l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
l1 AS (SELECT doc_id, line, length(trim(line)) - length(replace(trim(line), ' ', '')) + 1 AS n,
         length(line) - length(translate(line, '{rules.SYMBOLS.replace("|", "")}', '')) + length(line) - length(replace(line, '!!', '')) AS marked,
         len(regexp_extract_all(line, '{rules.SEPARATOR_CHARS}')) AS bars,
         len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words
       FROM l0 WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
l2 AS (SELECT *, (marked * 100 > n * {rules.MARKED_PERCENT} AND marked >= 3) OR (n <= {rules.FRAGMENT_WORDS} AND NOT regexp_matches(line, {_quoted(rules.END_MARK)}))
         OR (bars >= {rules.SEPARATORS} AND bars * 100 >= n * {rules.SEPARATOR_PERCENT}) OR (n <= {rules.MENU_WORDS} AND regexp_matches(line, {_quoted(rules.MENU)}))
         OR (n <= {rules.NOTICE_WORDS} AND regexp_matches(line, {_quoted(rules.NOTICE)})) AS fails FROM l1),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (WHERE fails) AS n_lines_failed,
        coalesce(sum(words) FILTER (WHERE fails), 0) AS lost_words FROM l2 GROUP BY doc_id),
a AS (SELECT d.doc_id, n_words, word_chars, length(text) - length(translate(text, '{rules.SYMBOLS}', '')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines_failed, 0) AS n_lines_failed, coalesce(lost_words, 0) AS lost_words
      FROM d JOIN t USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN l USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, n_words < {rules.LEAST_WORDS} OR 100 * n_repeat_words > {rules.REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {rules.LEAST_WORDS} OR 100 * n_repeat_words > {rules.REPEAT_PERCENT} * n_words) AND 100 * lost_words <= {rules.LOST_PERCENT} * n_words AS kept,
  n_lines_failed::BIGINT AS n_lines_failed, lost_words::BIGINT AS lost_words
FROM a
"""

OP2 = """
WITH p AS (
  SELECT conv_id, turn, role, text,
    row_number() OVER o AS place,
    list({'r': role, 't': text}) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pre,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations
  WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
whole AS (SELECT n, pre, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE place = n GROUP BY n, pre),
kept AS (SELECT * FROM whole w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.place < p.n AND p.place = w.n AND p.pre = w.pre)),
shown AS (
  SELECT conv_id, string_agg('<|im_start|>' || replace(replace(coalesce(role, ''), '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') || chr(10)
    || replace(replace(coalesce(text, ''), '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') || '<|im_end|>' || chr(10), '' ORDER BY place) AS rendered
  FROM p GROUP BY conv_id)
SELECT kept.conv_id, n AS n_turns, n_copies, rendered FROM kept JOIN shown USING (conv_id)
"""

OP5 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, w[p : p + least(len(w), {index.WINDOW_WORDS}) - 1] AS ph
       FROM b, unnest(range(1, greatest(1, len(w) - {index.WINDOW_WORDS} + 1) + 1)) AS u(p) WHERE len(w) > 0),
ph AS (SELECT DISTINCT ph, len(ph) AS n FROM bw),
sizes AS (SELECT DISTINCT n FROM ph),
dw AS (SELECT doc_id, p, n, w[p : p + n - 1] AS ph FROM d, sizes, unnest(range(1, greatest(1, len(w) - n + 2))) AS u(p)),
hit AS (SELECT doc_id, p, n, ph FROM dw JOIN ph USING (ph, n)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM hit, unnest(range(p, p + n)) AS u(q) GROUP BY doc_id),
items AS (SELECT doc_id, list(DISTINCT item_id::VARCHAR) AS i FROM hit JOIN bw USING (ph) GROUP BY doc_id),
post AS (SELECT doc_id, w[p] AS word, p FROM d, unnest(range(1, len(w) + 1)) AS u(p)),
freq AS (SELECT word, count(*) AS f FROM post GROUP BY word),
pt AS (SELECT ph, n, o - 1 AS o, ph[o] AS word FROM ph, unnest(range(1, n + 1)) AS u(o)),
anchor AS (SELECT ph, n, o, word FROM (SELECT pt.*, row_number() OVER (PARTITION BY ph ORDER BY coalesce(f, 0), o) AS k FROM pt LEFT JOIN freq USING (word)) WHERE k = 1),
cand AS (SELECT doc_id, ph, n, post.p - anchor.o AS s FROM anchor JOIN post USING (word)),
near AS (SELECT c.doc_id, c.ph, c.s FROM cand c JOIN pt ON pt.ph = c.ph JOIN post ON post.doc_id = c.doc_id AND post.word = pt.word
           AND post.p BETWEEN c.s + pt.o - {index.SLOP} AND c.s + pt.o + {index.SLOP}
         GROUP BY c.doc_id, c.ph, c.s, c.n HAVING count(DISTINCT pt.o) = c.n),
nears AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM near JOIN bw USING (ph) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(i), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(list_sort(i), ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near_items
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN nears USING (doc_id)
"""


def _rule_case(value) -> str:
    ordered = sorted(urls.RULES, key=lambda r: (-len(r[1] + r[2]), r[1]))
    whens = " ".join(
        f"WHEN (host = '{of}' OR ends_with(host, '.{of}')) AND starts_with(path, '{start}') THEN '{value(kind, of, start)}'" for kind, of, start in ordered
    )
    return f"CASE {whens} END"


def _k(table: str) -> str:
    """Prior strength of a level, as in url_reputation._strength."""
    low, high = urls.STRENGTH
    return f"""(SELECT round(coalesce(greatest({low}, least({high}, CASE WHEN share > 0 THEN 1 / share - 1 ELSE {high} END)), {high}), 6) FROM (
      SELECT (sum(n * pow(bad / n - mean, 2)) - sum(mean * (1 - mean))) / nullif(sum(mean * (1 - mean) * (n - 1)), 0) AS share FROM {table} WHERE n > 1))"""


def _posterior(table: str, key: str) -> str:
    return f"SELECT {key}, k * mean + bad AS a, k * (1 - mean) + n - bad AS b FROM {table}, (SELECT {_k(table)} AS k)"


OP9 = f"""
WITH p0 AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p0),
o AS (SELECT host, CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END AS bad
      FROM p JOIN labels ON labels.doc_id = try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})', 1), '') AS BIGINT)),
h0 AS (SELECT host, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM (SELECT host, 1 AS n, bad FROM o UNION ALL SELECT host, 0, 0 FROM p) GROUP BY host),
nm AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '\\.?(:[0-9]*)?$', '') AS name FROM h0),
tw AS (SELECT *, array_to_string(string_split(name, '.')[-2:], '.') AS two, regexp_matches(name, '^[0-9]+(\\.[0-9]+){{3}}$|^\\[') AS is_address FROM nm),
h AS (SELECT host, n, bad, CASE WHEN is_address THEN name WHEN two IN ({_SUFFIXES}) THEN array_to_string(string_split(name, '.')[-3:], '.') ELSE two END AS domain,
       CASE WHEN is_address THEN '' WHEN two IN ({_SUFFIXES}) THEN two ELSE string_split(name, '.')[-1] END AS suffix FROM tw),
al AS (SELECT sum(bad) / sum(n) AS overall FROM h),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY domain, suffix),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d0 GROUP BY suffix),
s1 AS (SELECT s0.*, overall AS mean FROM s0, al),
s AS ({_posterior("s1", "suffix")}),
d1 AS (SELECT d0.*, a / (a + b) AS mean FROM d0 JOIN s USING (suffix)),
dd AS ({_posterior("d1", "domain, suffix")}),
h1 AS (SELECT h.*, a / (a + b) AS mean FROM h JOIN dd USING (domain, suffix)),
hh AS ({_posterior("h1", "host")}),
known AS (SELECT host, round(a / (a + b), 6) AS host_rate, round(greatest(0, a / (a + b) - {urls.Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))), 6) AS host_bound FROM hh)
SELECT page_id, host, path, {_rule_case(lambda kind, of, start: of + start)} AS rule,
  coalesce({_rule_case(lambda kind, of, start: kind)}, CASE WHEN host_bound > (SELECT round(least({urls.SURE}, {urls.ODDS} * overall / (1 + ({urls.ODDS} - 1) * overall)), 6) FROM al) THEN 'block' ELSE 'allow' END) AS verdict, host_rate, host_bound
FROM p LEFT JOIN known USING (host)
"""

#: The CRC-32 of a column's ASCII text, bit by bit.
def _crc32(text: str) -> str:
    bits = "list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    codes = f"list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT)"
    return f"xor(list_reduce([4294967295::BIGINT] || {codes}, lambda c, b: {bits}), 4294967295)"


def _told(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR, '-')"


def _leaf(size: str) -> str:
    return "sha256(" + " || ".join(_told(c) for c in ("doc_id", "source", "lang", size, "text")) + ")"


def _sides(nodes: str, n: str, pos: str, where: str) -> str:
    """Per leaf its siblings from the bottom up: L or R and the digest, or a dash where a node is alone in its run."""
    return f"""SELECT p.row, list(CASE WHEN s.h IS NULL THEN '-' WHEN s.i % 2 = 0 THEN 'L' || s.h ELSE 'R' || s.h END ORDER BY lv.level) AS sides
      FROM p JOIN (SELECT DISTINCT level, {n} FROM {nodes} WHERE n > 1) AS lv ON {where.format("lv")}
      LEFT JOIN {nodes} AS s ON {where.format("s")} AND s.level = lv.level AND s.i = xor({pos} >> lv.level, 1) GROUP BY p.row"""


OP13 = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_leaf("n_chars")} AS leaf,
    CASE WHEN {_crc32("doc_id::VARCHAR")} % 7 = 0 THEN {_leaf("(n_chars + 1)")} END AS other FROM documents),
p0 AS (SELECT doc_id, lang, leaf, coalesce(other, leaf) AS claim, row_number() OVER () AS row,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n,
    dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM d),
t AS (SELECT tree, 0 AS level, pos AS i, leaf AS h, n FROM p0
    UNION ALL SELECT tree, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY tree, level, i // 2, n),
u AS (SELECT 0 AS level, tree AS i, h, (SELECT count(DISTINCT tree) FROM p0) AS n FROM t WHERE n = 1
    UNION ALL SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY level, i // 2, n),
p AS (SELECT p0.*, t.h AS subroot, u.h AS root FROM p0 JOIN t ON t.tree = p0.tree AND t.n = 1 JOIN u ON u.n = 1),
low AS ({_sides("t", "tree", "p.pos", "{}.tree = p.tree")}),
high AS ({_sides("u", "0 AS z", "p.tree", "true")}),
f AS (SELECT p.*, coalesce(low.sides, []) || coalesce(high.sides, []) AS sides FROM p LEFT JOIN low USING (row) LEFT JOIN high USING (row)),
g AS (SELECT *, list_reduce([claim] || sides, lambda a, s: sha256(CASE s[1] WHEN 'L' THEN s[2:] || a WHEN 'R' THEN a || s[2:] ELSE a END)) AS folded_root FROM f)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(list_filter(sides, lambda s: s <> '-'), lambda s: s[2:]), '')) AS proof_sha256,
  folded_root, folded_root = root AS verified FROM g
"""

OP12 = """
WITH v AS (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.row, a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.row <> b.row)
SELECT query_id, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 5
"""

ORACLES: dict[str, str] = {
    "op1_quality_rules": OP1,
    "op2_chat_formatting": OP2,
    "op5_decontamination": OP5,
    "op9_url_reputation": OP9,
    "op12_top_vectors": OP12,
    "op13_merkle_manifest": OP13,
}
