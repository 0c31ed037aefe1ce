"""DuckDB statements for the operators of this folder that SQL can state."""

from __future__ import annotations

from . import mixing as mx
from . import quality_rules as qr

#: Words of a text; DuckDB's pattern for the same blanks.
WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '')"


def _list(items) -> str:
    return "[" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in items) + "]"


def quality_rules() -> str:
    common = "CASE lang " + " ".join(f"WHEN '{k}' THEN {_list(v)}" for k, v in qr.COMMON.items()) + " ELSE []::VARCHAR[] END"
    classes = ", ".join(f"length(regexp_replace(text, '[^{p[1:-1]}]+', '', 'g')) AS n_{k}" for k, p in qr.CLASSES.items())
    left = " - ".join(f"n_{k}" for k in list(qr.CLASSES)[1:])
    counts = ", ".join([*(f"n_{k}" for k in qr.CLASSES), "n - word_chars", f"word_chars - n_lower - ({left.replace(' - ', ' + ')})"])
    js = lambda p, q: f"sqrt(greatest(list_sum([CASE WHEN {p}[i] > 0 THEN {p}[i] * log2({p}[i] / (({p}[i] + {q}[i]) / 2)) ELSE 0 END + CASE WHEN {q}[i] > 0 THEN {q}[i] * log2({q}[i] / (({p}[i] + {q}[i]) / 2)) ELSE 0 END FOR i IN range(1, len({p}) + 1)]) / 2, 0))"
    n_class, n_word = len(qr.CLASSES) + 2, qr.N_COMMON + 1
    total = lambda c, n: "[" + ", ".join(f"sum({c}[{i + 1}])" for i in range(n)) + "]"
    others = lambda s, p: f"CASE WHEN {p} IS NOT NULL AND n_ref - teaches::INT >= {qr.MIN_REFERENCE} THEN [greatest({s}[i] - CASE WHEN teaches THEN {p}[i] ELSE 0 END, 0) / (n_ref - teaches::INT) FOR i IN range(1, len({p}) + 1)] END"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, lang, {common} AS common, {WORDS} AS w FROM documents),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
rep AS (SELECT rid, count(DISTINCT k) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS k FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c > 1) GROUP BY rid),
m AS (SELECT d.rid, doc_id, lang, common, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) AS n,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS lines,
  coalesce(rep.n, 0) AS n_repeat_words, list_filter(list_transform(w, lambda x: lower(x)), lambda x: list_contains(common, x)) AS hits, {classes}
  FROM d LEFT JOIN rep USING (rid)),
h AS (SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, list_transform([{counts}], lambda c: c::DOUBLE / greatest(n, 1)) AS class_p,
  list_concat(list_transform(common, lambda c: len(list_filter(hits, lambda y: y = c))::DOUBLE / greatest(n_words, 1)), [(n_words - len(hits))::DOUBLE / greatest(n_words, 1)]) AS word_p,
  n_words >= {qr.JUDGE_WORDS} AND word_chars >= {qr.JUDGE_CHARS} AS judged, n_words < {qr.MIN_WORDS} OR 100 * n_repeat_words > {qr.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
t AS (SELECT * EXCLUDE (word_p), CASE WHEN len(common) > 0 THEN word_p END AS word_p, judged AND NOT base_failed AS teaches FROM h),
ref AS (SELECT lang, count(*) AS n_ref, {total("class_p", n_class)} AS class_sum, {total("word_p", n_word)} AS word_sum FROM t WHERE teaches GROUP BY lang),
o AS (SELECT t.*, {others("class_sum", "class_p")} AS class_q, {others("word_sum", "word_p")} AS word_q FROM t LEFT JOIN ref ON t.lang IS NOT DISTINCT FROM ref.lang),
j AS (SELECT *, CASE WHEN class_q IS NOT NULL THEN {js("class_p", "class_q")} END AS class_js, CASE WHEN word_q IS NOT NULL THEN {js("word_p", "word_q")} END AS word_js FROM o),
v AS (SELECT *, coalesce(judged AND class_js IS NOT NULL AND greatest(class_js - {qr.MAX_CLASS_DISTANCE}, coalesce(word_js, 0) - {qr.MAX_WORD_DISTANCE}, class_js + coalesce(word_js, 0) - {qr.MAX_SUM}) > {qr.NOISE} / sqrt(greatest(n_words, 1)), false) AS far FROM j)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT far AS kept, round(class_js, 6) AS class_js, round(word_js, 6) AS word_js FROM v
"""


def source_mixing() -> str:
    weights = "[" + ", ".join(f"{w}.0::DOUBLE" for w in mx.WEIGHTS) + "]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, len({WORDS})::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, {weights}[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mx.WEIGHTS)}] AS weight, {mx.MAX_TIMES}.0::DOUBLE * source_size AS most FROM s),
l AS (SELECT *, ({mx.SHARE}::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS own,
  row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS k FROM w
  WINDOW b AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(own, k) AS level FROM l WHERE own * weight <= most),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN most ELSE least(level * weight, most) END AS target FROM l LEFT JOIN f ON true),
c AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS copies, ('0x' || substr(md5(coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS offs FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, place) AS k FROM d)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  (size * CASE WHEN size = 0 THEN 0 ELSE least(floor(k * copies + offs) - floor((k - 1) * copies + offs), {mx.MAX_TIMES}) END)::BIGINT AS taken
FROM r JOIN c ON r.source IS NOT DISTINCT FROM c.source
"""


def decontaminate() -> str:
    """All windows as long as an item, at every offset, of pairs with enough common shingles for any window to reach 0.75."""
    w = WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    s = "CASE WHEN len(w) >= 5 THEN [array_to_string(w[k:k + 4], ' ') FOR k IN range(1, len(w) - 3)] WHEN len(w) > 0 THEN ['whole ' || array_to_string(w, ' ')] ELSE [] END"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {s} AS s FROM (SELECT doc_id, {w} AS w FROM documents)),
b AS (SELECT row_number() OVER () AS bid, * FROM (SELECT DISTINCT item_id, {s} AS s FROM (SELECT item_id, {w} AS w FROM benchmark))),
dp AS (SELECT rid, unnest(range(1, len(s) + 1)) AS p, unnest(s) AS h FROM d),
bc AS (SELECT bid, h, len(any_value(s)) AS n, count(*) AS c FROM (SELECT bid, s, unnest(s) AS h FROM b) GROUP BY ALL),
hits AS (SELECT rid, bid, n, p, h, c FROM dp JOIN bc USING (h)),
pr AS (SELECT rid, bid, n FROM hits GROUP BY ALL HAVING 4 * count(*) >= 3 * n),
win AS (SELECT DISTINCT rid, bid, n, greatest(o, 0) AS lo, least(o + n, size) AS hi FROM (SELECT rid, bid, n, len(s) AS size, unnest(range(1 - n, len(s))) AS o FROM pr JOIN d USING (rid))),
wc AS (SELECT rid, bid, lo, hi, win.n, h, least(count(*), any_value(c)) AS common FROM win JOIN hits USING (rid, bid) WHERE p > lo AND p <= hi GROUP BY ALL),
v AS (SELECT rid, bid, sum(common)::DOUBLE / (hi - lo + n - sum(common)) AS similarity FROM wc GROUP BY rid, bid, lo, hi, n)
SELECT doc_id, item_id, round(max(similarity), 6) AS similarity FROM v JOIN d USING (rid) JOIN b USING (bid) WHERE similarity >= 0.75 GROUP BY ALL
"""


def quote_links() -> str:
    level = "length(regexp_replace(regexp_extract(x, '^[ \\t]*(?:>[ \\t]?)+'), '[^>]', '', 'g'))"
    norm = "trim(regexp_replace(lower(regexp_replace(x, '^[ \\t]*(?:>[ \\t]?)+', '')), '\\s+', ' ', 'g'))"
    known = " || ".join(f"CASE WHEN {c} IS NULL THEN '0' ELSE '1' END" for c in ("conv_id", "turn", "role"))
    return f"""
WITH RECURSIVE m AS (SELECT md5(concat_ws('|', {known}, coalesce(conv_id::VARCHAR, ''), coalesce(turn::VARCHAR, ''), coalesce(role, ''), text)) AS id, * FROM (SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text FROM conversations)),
l AS (SELECT id, conv_id, turn, k, x, {level} AS level, {norm} AS norm FROM (SELECT id, conv_id, turn, unnest(range(1, len(ls) + 1)) AS k, unnest(ls) AS x FROM (SELECT *, regexp_split_to_array(text, '\\r?\\n') AS ls FROM m))),
f AS (SELECT *, level = 0 AND regexp_matches(x, '(?i)^.*\\bwrote:[ \\t]*$') AND coalesce(lead(level) OVER (PARTITION BY id ORDER BY k) > 0, false) AS announces FROM l),
body AS (SELECT id, trim(regexp_replace(string_agg(x, chr(10) ORDER BY k), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10)) AS body FROM f WHERE level = 0 AND NOT announces GROUP BY id),
g AS (SELECT id, conv_id, turn, k, level, CASE WHEN announces THEN '' ELSE norm END AS norm FROM f),
s AS (SELECT *, sum(CASE WHEN norm <> '' AND coalesce(before, '') <> '' AND above = level THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY k) AS para FROM (SELECT *, lag(norm) OVER w AS before, lag(level) OVER w AS above FROM g WINDOW w AS (PARTITION BY id ORDER BY k))),
p1 AS (SELECT id, conv_id, turn, level, para, string_agg(norm, ' ' ORDER BY k) AS t FROM s WHERE norm <> '' GROUP BY ALL),
ps AS (SELECT id, conv_id, turn, level, unnest(string_split(regexp_replace(t, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1))) AS norm FROM p1),
asks AS (SELECT id, conv_id, turn, level, norm, count(*) AS n FROM ps WHERE level > 0 GROUP BY ALL),
nq AS (SELECT id, sum(n)::BIGINT AS n_quoted FROM asks GROUP BY id),
says AS (SELECT conv_id, turn, norm, max(id) AS id FROM ps WHERE level = 0 AND turn IS NOT NULL GROUP BY ALL),
found AS (SELECT a.id, a.level, a.norm, a.n, max(s.turn) AS said_turn, arg_max(s.id, s.turn) AS said_id FROM asks a JOIN says s ON a.conv_id IS NOT DISTINCT FROM s.conv_id AND a.norm = s.norm AND s.turn < a.turn GROUP BY ALL),
linked AS (SELECT id, sum(n)::BIGINT AS n_linked FROM found GROUP BY id),
best AS (SELECT id, said_id, said_turn FROM (SELECT id, said_id, said_turn, row_number() OVER (PARTITION BY id ORDER BY sum(n) DESC, said_turn DESC, said_id DESC) AS r FROM found WHERE level = 1 GROUP BY id, said_id, said_turn) WHERE r = 1),
p AS (SELECT m.id, m.conv_id, [(coalesce(turn, -9000000000000000000), m.id)] AS path FROM m WHERE id NOT IN (SELECT id FROM best)
  UNION ALL SELECT m.id, m.conv_id, list_append(p.path, (coalesce(m.turn, -9000000000000000000), m.id)) FROM p JOIN best ON best.said_id = p.id JOIN m ON m.id = best.id)
SELECT m.conv_id, m.turn, m.role, row_number() OVER (PARTITION BY m.conv_id ORDER BY path) AS position, best.said_turn AS parent_turn, len(path) - 1 AS depth,
  coalesce(n_quoted, 0) AS n_quoted, coalesce(n_linked, 0) AS n_linked, '<|' || coalesce(m.role, 'unknown') || '|>' || coalesce(body, '') AS formatted
FROM m JOIN p USING (id) LEFT JOIN body USING (id) LEFT JOIN nq USING (id) LEFT JOIN linked USING (id) LEFT JOIN best USING (id)
"""
