"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from screenfunnel.llm.mixing import CAP, WEIGHTS
from screenfunnel.llm.quality import QualityRules


def quality_sql(rules: QualityRules, docs: str = "documents") -> str:
    vocabulary = ", ".join(f"'{w}'" for w in rules.vocabulary)
    langs = ", ".join(f"'{x}'" for x in sorted(rules.common_words))
    gap = "(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END)"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM {docs}),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, regexp_replace(t, '[a-z\x20\x09-\x0D]+', '', 'g') AS o FROM d),
c AS (SELECT *, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) AS n,
    length(regexp_replace(o, '[^\p{{Lu}}]+', '', 'g')) AS c_upper, length(regexp_replace(o, '[^\p{{Nd}}]+', '', 'g')) AS c_digit,
    length(regexp_replace(o, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    length(regexp_replace(regexp_replace(o, '[#*%&]+', '', 'g'), '[^\p{{P}}]+', '', 'g')) AS c_punct,
    length(regexp_replace(o, '[\x00-\x7F\p{{Lu}}\p{{Nd}}\p{{P}}]+', '', 'g')) AS c_beyond FROM w),
h AS (SELECT *, [c_upper, c_digit, n_symbols, c_punct, c_beyond, n - word_chars,
    word_chars - c_upper - c_digit - n_symbols - c_punct - c_beyond] AS chars FROM c),
lines AS (SELECT rid, count(*) - count(DISTINCT l) AS n_dup FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d)
    WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
win AS (SELECT rid, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
dup AS (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt
    FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS k FROM win) WHERE k > 1),
rep AS (SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS n_rep FROM dup GROUP BY rid),
bins AS (SELECT rid, word, count(*) AS k FROM (SELECT rid, CASE WHEN x IN ({vocabulary}) THEN x ELSE '' END AS word
    FROM (SELECT rid, unnest(w) AS x FROM w)) GROUP BY rid, word),
refw AS (SELECT lang AS ref, word, sum(k) AS k FROM bins JOIN d USING (rid) WHERE lang IN ({langs}) GROUP BY ALL),
tot AS (SELECT ref, sum(k) AS total FROM refw GROUP BY ref HAVING sum(k) >= {rules.reference_words}),
qw AS (SELECT ref, word, k / total AS q FROM refw JOIN tot USING (ref)),
qc AS (SELECT lang AS ref, i, sum(chars[i]) AS k, sum(sum(chars[i])) OVER (PARTITION BY lang) AS total
    FROM h, range(1, 8) AS r(i) WHERE lang IN (SELECT ref FROM tot) GROUP BY lang, i),
jc AS (SELECT rid, ref, sqrt(greatest(sum({gap}) / 2, 0)) AS js FROM
    (SELECT rid, ref, chars[i] / n AS p, k / total AS q FROM h, qc WHERE n >= {rules.guard_chars}) GROUP BY rid, ref),
jw AS (SELECT rid, ref, sqrt(greatest((1 + sum({gap} - q)) / 2, 0)) AS js FROM
    (SELECT b.rid, tot.ref, b.k / c.n_words AS p, coalesce(qw.q, 0) AS q FROM bins b JOIN c USING (rid) CROSS JOIN tot
     LEFT JOIN qw ON qw.ref = tot.ref AND qw.word = b.word WHERE c.n_words >= {rules.guard_words}) GROUP BY rid, ref),
mc AS (SELECT rid, min(js) AS js FROM jc GROUP BY rid),
mw AS (SELECT rid, min(js) AS js FROM jw GROUP BY rid),
v AS (SELECT h.*, coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_rep, 0) AS n_repeat_words, mc.js AS cjs, mw.js AS wjs,
    n_words < {rules.min_words} OR 100 * coalesce(n_rep, 0) > {rules.max_repeat_percent} * n_words AS base_failed
    FROM h LEFT JOIN lines USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN mc USING (rid) LEFT JOIN mw USING (rid))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, round(cjs, 6) AS char_distance,
    round(wjs, 6) AS word_distance, base_failed, NOT base_failed AND coalesce(cjs, 0) <= {rules.max_char_distance}
    AND coalesce(wjs, 0) <= {rules.max_word_distance} AS kept FROM v"""


def exact_sql(docs: str = "documents") -> str:
    return rf"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, row_number() OVER () AS r,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS s FROM {docs}),
f AS (SELECT *, first_value(doc_id) OVER w AS keep_id, first_value(r) OVER w AS keep_row, count(*) OVER (PARTITION BY s) AS k
    FROM d WINDOW w AS (PARTITION BY s ORDER BY n DESC, doc_id NULLS LAST, r))
SELECT doc_id, keep_id, k AS group_size, r = keep_row AS kept, sha256(s) AS text_sha256 FROM f"""


def mixing_sql(docs: str = "documents", weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, seed: str = "mix") -> str:
    weight = f"[{', '.join(str(float(x)) for x in weights)}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} + 1]"
    key = f"md5(concat_ws('|', '{seed}', coalesce(doc_id::VARCHAR, ''), coalesce(source, ''), coalesce(text, '')))"
    return rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    (('0x' || substr({key}, 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM {docs}),
s AS (SELECT source, sum(size)::DOUBLE AS n, {weight} AS w FROM d GROUP BY source),
l AS (SELECT *, ((SELECT sum(n) FROM s) - coalesce(sum({cap} * n) OVER (ORDER BY {cap} * n / w, source NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY {cap} * n / w, source NULLS LAST
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS water FROM s),
t AS (SELECT source, n, least({cap} * n, w * (SELECT max(water) FROM l)) AS target FROM l),
e AS (SELECT d.*, t.n, t.target, CASE WHEN t.n > 0 THEN least(t.target / t.n, {cap}.0) ELSE 0 END AS e
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, floor(e) AS c, e - floor(e) AS p FROM e),
q AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM c),
r AS (SELECT *, sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY q NULLS LAST) AS upto,
    target - sum(c * size) OVER (PARTITION BY source) AS lack FROM q),
x AS (SELECT *, coalesce(max(CASE WHEN q IS NOT NULL AND upto <= lack THEN q END) OVER (PARTITION BY source), -1) AS q_cut,
    lack - coalesce(max(CASE WHEN q IS NOT NULL AND upto <= lack THEN upto END) OVER (PARTITION BY source), 0) AS gap FROM r),
f AS (SELECT source, min((abs(size - gap), u)) AS f FROM x WHERE q > q_cut AND abs(size - gap) < gap GROUP BY source)
SELECT doc_id, size::BIGINT AS size, n::BIGINT AS source_size, target, (CASE WHEN size > 0 THEN
    c + coalesce(q <= q_cut, false)::INT + coalesce(u = f.f[2], false)::INT ELSE 0 END * size)::BIGINT AS taken
FROM x LEFT JOIN f ON x.source IS NOT DISTINCT FROM f.source"""


def near_sql(words: int = 2, percent: int = 80, docs: str = "documents") -> str:
    """For small tables: every pair that shares a shingle is counted."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM {docs}),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + {words - 1}), ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {words - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {percent} * (x.n + y.n - k)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id,
    d.doc_id = least(d.doc_id, coalesce(c.m, d.doc_id)) AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id"""


def negatives_sql(rows: str = "embeddings", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> str:
    return f"""
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM {rows} WHERE vec_id IS NOT NULL AND label IS NOT NULL
    AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid, a.vec_id AS anchor_id, a.label AS own, b.rid AS other, b.vec_id, b.label, list_inner_product(a.q, b.q)::BIGINT AS score
    FROM v a, v b WHERE a.vec_id % 100 = 0),
p AS (SELECT rid, anchor_id, own, vec_id AS positive_id, score AS positive_score, row_number() OVER
    (PARTITION BY rid ORDER BY score DESC, vec_id) AS slot FROM s WHERE label = own AND vec_id <> anchor_id),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER
    (PARTITION BY p.rid, slot ORDER BY s.score DESC, s.vec_id) AS rank FROM p JOIN s ON s.rid = p.rid AND s.label <> p.own
    AND {low} * positive_score <= 100 * s.score AND 100 * s.score <= {high} * positive_score WHERE slot <= {positives})
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {negatives}"""


def merkle_sql(docs: str = "documents", fan: int = 8) -> str:
    def leaf(text: str) -> str:
        values = ("doc_id", "source", "lang", "n_chars", text)
        return "sha256(" + " || ".join(f"coalesce(strlen(({v})::VARCHAR)::VARCHAR || ':' || ({v})::VARCHAR, '-')" for v in values) + ")"

    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    bit = "CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END"
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: " + bit + ")"
    codes = "list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b: {byte}), 4294967295)"
    # level by level: the nodes of a group while it has more than one, then its root; the groups' roots go on as one group more
    step = f"""SELECT tree, k + 1, place // {fan}, sha256(string_agg(h, '' ORDER BY place)) FROM %s
        WHERE tree IN (SELECT tree FROM %s GROUP BY tree HAVING count(*) > 1) GROUP BY tree, k, place // {fan}"""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, row_number() OVER () AS rid, {leaf("text")} AS leaf, CASE WHEN {crc} % 3 = 0
    THEN {leaf(f"translate(text, '{letters}', '{letters.lower()}')")} END AS changed FROM {docs}),
p AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS place FROM d),
low AS (SELECT tree, 0 AS k, place, leaf AS h FROM p UNION ALL {step % ("low", "low")}),
roots AS (SELECT tree, max_by(h, k) AS h, max(k) AS k FROM low GROUP BY tree),
high AS (SELECT 0 AS tree, 0 AS k, tree - 1 AS place, h FROM roots UNION ALL {step % ("high", "high")}),
top AS (SELECT max_by(h, k) AS h FROM high),
walk AS (SELECT rid, 0 AS step, place AS at, tree AS t, 0 AS k, changed AS h, '' AS proof FROM p
    UNION ALL SELECT w.rid, w.step + 1, CASE WHEN n.up THEN w.t - 1 ELSE w.at // {fan} END, CASE WHEN n.up THEN 0 ELSE w.t END,
    CASE WHEN n.up THEN 0 ELSE w.k + 1 END, CASE WHEN n.up THEN w.h ELSE sha256(n.l || w.h || n.r) END,
    CASE WHEN n.up THEN w.proof ELSE w.proof || n.l || n.r END
    FROM (SELECT *, (SELECT count(*) FROM (SELECT tree, k FROM low UNION ALL SELECT tree, k FROM high) x WHERE x.tree = walk.t AND x.k = walk.k) AS wide FROM walk) w,
    LATERAL (SELECT w.wide = 1 AS up, coalesce(string_agg(h, '' ORDER BY place) FILTER (place < w.at), '') AS l,
    coalesce(string_agg(h, '' ORDER BY place) FILTER (place > w.at), '') AS r FROM (SELECT * FROM low UNION ALL SELECT * FROM high) x
    WHERE x.tree = w.t AND x.k = w.k AND x.place // {fan} = w.at // {fan}) n WHERE NOT (w.t = 0 AND w.wide = 1)),
f AS (SELECT rid, max_by(h, step) AS h, max_by(proof, step) AS proof FROM walk GROUP BY rid)
SELECT doc_id, leaf, roots.h AS subroot, top.h AS root, sha256(f.proof) AS proof_sha256,
    CASE WHEN changed IS NULL THEN top.h ELSE f.h END AS folded_root, changed IS NULL OR f.h = top.h AS verified
FROM p JOIN roots USING (tree) JOIN f USING (rid), top"""


NEAR = near_sql()
QUALITY = quality_sql(QualityRules())
EXACT = exact_sql()
MIXING = mixing_sql()
NEGATIVES = negatives_sql()
MERKLE = merkle_sql()
