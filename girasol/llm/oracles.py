"""DuckDB SQL with the same result, by other means, where SQL can say it. Texts of the tables have no
white space but spaces and newlines, and no script without spaces."""

from __future__ import annotations

#: All diagonals of equal words; a window's matches are counted where it ends.
OP3_SPACED_SEED_DECONTAMINATION = """
WITH d AS (SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') w FROM benchmark),
i AS (SELECT item_id, least(len(w), 20) size, unnest(w) word, generate_subscripts(w, 1) - 1 p FROM b),
x AS (SELECT doc_id, unnest(w) word, generate_subscripts(w, 1) - 1 q FROM d),
m AS (SELECT doc_id, item_id, size, q - p shift, p FROM x JOIN i USING (word)),
g AS (SELECT doc_id, item_id, size, shift FROM m GROUP BY ALL HAVING count(*) >= ceil(0.8 * size - 1e-9)),
c AS (SELECT m.*, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY p RANGE BETWEEN size - 1 PRECEDING AND CURRENT ROW) n FROM m JOIN g USING (doc_id, item_id, size, shift)),
o AS (SELECT doc_id, item_id, size, shift, max(n) n FROM c GROUP BY ALL)
SELECT doc_id, item_id, shift AS doc_word, n AS matched, size AS compared, n / size AS overlap FROM o WHERE n >= ceil(0.8 * size - 1e-9)
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n DESC, shift) = 1"""
#: Sets that share a gram, and their closure.
OP4_NGRAM_JACCARD = """
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END s FROM t),
c AS (SELECT s, min(doc_id) rep, len(s) n FROM s WHERE len(s) > 0 GROUP BY s),
g AS (SELECT rep, n, unnest(s) gram FROM c),
l AS (SELECT a.rep a, b.rep b FROM g a JOIN g b ON a.gram = b.gram AND a.rep <> b.rep AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r(node, root) AS (SELECT rep, rep FROM c UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node WHERE r.root < l.b),
k AS (SELECT node, min(root) root FROM r GROUP BY node), d AS (SELECT a, count(*) n FROM l GROUP BY a)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(k.root, s.doc_id) AS component_id, coalesce(d.n, 0) AS n_links
FROM s LEFT JOIN c ON c.s = s.s LEFT JOIN k ON k.node = c.rep LEFT JOIN d ON d.a = c.rep"""
#: Lines that share one of their rarest words.
OP9_LINE_DEDUP = """
WITH t AS (SELECT doc_id, text, string_split(text, chr(10)) v FROM documents),
l AS (SELECT doc_id, unnest(v) line, generate_subscripts(v, 1) pos FROM t WHERE text IS NOT NULL),
w AS (SELECT *, list_sort(list_distinct(list_filter(string_split(lower(line), ' '), lambda x: x <> ''))) s FROM l),
e AS (SELECT row_number() OVER () id, * FROM (SELECT s, len(s) n, min(struct_pack(d := doc_id, l := pos)) p FROM w WHERE len(s) > 0 GROUP BY s)),
u AS (SELECT id, n, unnest(s) t FROM e), f AS (SELECT t, count(*) f FROM u GROUP BY t),
x AS (SELECT id, n, t FROM u JOIN f USING (t) QUALIFY row_number() OVER (PARTITION BY id ORDER BY f, t) <= n - ceil(0.8 * n - 1e-9) + 1),
y AS (SELECT DISTINCT a.id i, b.id j FROM x a JOIN x b ON a.t = b.t AND a.id <> b.id AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9),
m AS (SELECT DISTINCT b.id FROM y JOIN e a ON a.id = i JOIN e b ON b.id = j WHERE a.p < b.p AND len(list_intersect(a.s, b.s)) >= 0.8 * (a.n + b.n - len(list_intersect(a.s, b.s))) - 1e-9),
k AS (SELECT w.doc_id, w.pos, w.line, len(w.s) > 0 AND (e.p <> struct_pack(d := w.doc_id, l := w.pos) OR m.id IS NOT NULL) gone FROM w LEFT JOIN e ON e.s = w.s LEFT JOIN m ON m.id = e.id),
g AS (SELECT doc_id, count(*) n_lines, count(*) FILTER (gone) n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT coalesce(gone, false)), '')) kept FROM k GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, kept AS kept_sha256 FROM t LEFT JOIN g USING (doc_id)"""

#: All pairs of an anchor and a row; each window by itself.
OP11_HARD_NEGATIVES = """
WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) x FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id a, b.vec_id b, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT s FROM e a, e b WHERE a.vec_id % 50 = 0),
p AS (SELECT a, b, s FROM s WHERE same AND a <> b QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
n AS (SELECT p.a, p.b, p.s, s.b nb, s.s ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) r FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * p.s <= 100 * s.s AND 100 * s.s <= 95 * p.s)
SELECT a AS anchor_id, b AS positive_id, r::INT AS rank, nb AS negative_id, s AS positive_score, ns AS negative_score FROM n WHERE r <= 3"""
#: The level from the order of caps over weights; each source's running sum.
OP13_SOURCE_MIX = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT size, ('0x' || md5(concat_ws(':', '13', doc_id::VARCHAR))[1:15])::BIGINT k FROM documents),
w AS (SELECT source, sum(size)::DOUBLE total, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE w FROM d GROUP BY source),
o AS (SELECT *, 1.5::DOUBLE * sum(total) OVER () - coalesce(2 * sum(total) OVER before, 0) rest, sum(w) OVER () - coalesce(sum(w) OVER before, 0) left_w, row_number() OVER (ORDER BY total / w, source NULLS LAST) i FROM w
    WINDOW before AS (ORDER BY total / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT min(i) i, arg_min(rest, i) rest, arg_min(left_w, i) left_w FROM o WHERE 2 * total * left_w > w * rest),
t AS (SELECT source, total::BIGINT total, CASE WHEN l.i IS NULL OR o.i < l.i THEN 2 * total ELSE least(2 * total, w * l.rest / l.left_w) END target FROM o, l),
c AS (SELECT d.*, total, target, floor(target)::BIGINT b, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id NULLS FIRST, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT p FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, CASE WHEN total = 0 THEN 0 ELSE b // total END e, CASE WHEN total = 0 THEN 0 ELSE b % total END r FROM c)
SELECT doc_id, size, total AS source_size, target, (e * size + greatest(0, least(size, r - p)))::BIGINT AS taken, greatest(0, least(size, r - p)) NOT IN (0, size) AS is_cut FROM r"""
