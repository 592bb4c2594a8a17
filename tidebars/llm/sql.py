"""Plain SQL of the operators that have some: the definitions, without anchors, cells or trees."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def component_ids(width: int, percent: int) -> str:
    """Every pair of documents with a common shingle, counted; components by a recursive closure."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i:i + {width - 1}], ' ')) END)) AS sh FROM d),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN c u ON u.doc_id = p.a JOIN c v ON v.doc_id = p.b WHERE 100 * k >= {percent} * (u.n + v.n - k)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT r.a AS doc_id, coalesce(any_value(c.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id FROM r LEFT JOIN c ON c.doc_id = r.a GROUP BY r.a"""


def removed_words(window: int) -> str:
    """Every window with the least document that holds it; the words of later ones go."""
    return f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
v AS (SELECT doc_id, unnest(range(1, len(w) - {window} + 2)) AS i, w FROM d WHERE len(w) >= {window}),
k AS (SELECT doc_id, i, array_to_string(w[i:i + {window - 1}], ' ') AS s FROM v),
f AS (SELECT s, min(doc_id) AS least FROM k GROUP BY 1),
g AS (SELECT DISTINCT k.doc_id, k.i + o.o AS i FROM k JOIN f USING (s), range({window}) o(o) WHERE f.least < k.doc_id),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
t AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS kept FROM x ANTI JOIN g ON g.doc_id = x.doc_id AND g.i = x.i GROUP BY 1),
n AS (SELECT doc_id, count(*) AS gone FROM g GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n.gone, 0)::BIGINT AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""


def removed_bytes(window: int) -> str:
    """Every byte window by digest; those that start twice are laid over the text, and what is left is put together."""
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
v AS (SELECT doc_id, h, unnest(range(0, n - {window} + 1)) AS i FROM d WHERE n >= {window}),
k AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, {2 * window})) AS s FROM v),
f AS (SELECT s FROM k GROUP BY 1 HAVING count(*) > 1),
o AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM k SEMI JOIN f USING (s)),
b AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + {window} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o),
g AS (SELECT doc_id, run, min(i) AS lo, max(i) + {window} AS hi FROM b GROUP BY 1, 2),
q AS (SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS lo, lo AS hi FROM g
      UNION ALL SELECT d.doc_id, coalesce(max(g.hi), 0), d.n FROM d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id, d.n),
t AS (SELECT q.doc_id, string_agg(substr(d.h, 2 * q.lo + 1, 2 * (q.hi - q.lo)), '' ORDER BY q.lo) AS kept FROM q JOIN d USING (doc_id) GROUP BY 1),
m AS (SELECT doc_id, sum(hi - lo) AS gone, count(*) AS spans FROM g GROUP BY 1)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(m.gone, 0)::BIGINT AS n_removed, coalesce(m.spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(t.kept, ''))) AS kept_sha256
FROM d LEFT JOIN m USING (doc_id) LEFT JOIN t USING (doc_id)"""


def contaminated(width: int) -> str:
    """Every window of every item against every run of as many words of a document."""
    words = rf"regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH b AS (SELECT item_id, {words} AS w, least(len({words}), {width}) AS n FROM benchmark WHERE len({words}) > 0),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
d AS (SELECT doc_id, {words} AS w FROM documents),
v AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) l WHERE len(w) >= l.n),
o AS (SELECT doc_id, i, n, item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM v) JOIN g USING (n, s)),
h AS (SELECT doc_id, count(DISTINCT p) AS hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM o) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item_id) AS items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM o GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.hit, 0)::BIGINT AS n_hit, coalesce(t.items, 0)::BIGINT AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""


def ranked(best: int) -> str:
    """Terms of documents and items counted and joined."""
    terms = "translate(unnest(regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {terms} AS term FROM documents) GROUP BY 1, 2),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM t GROUP BY 1),
a AS (SELECT count(*)::BIGINT AS total, sum(n)::BIGINT AS length FROM n),
w AS (SELECT term, floor(1000 * ln((2 * total + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t, a GROUP BY term, total),
m AS (SELECT doc_id, 75 + (25 * n * total) // length AS m FROM n, a),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {terms} AS term FROM benchmark) GROUP BY 1, 2),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN t USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY 1, 2),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= {best}"""


def manifest(fanout: int) -> str:
    """Levels by recursion, siblings by join, the fold by recursion again."""
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    levels = lambda name, of, key: f"""{name}({key}, lvl, i, h, n) AS (SELECT {key}, 0, i, h, n FROM {of} UNION ALL
  SELECT {key}, lvl + 1, i // {fanout}, sha256(string_agg(h, '' ORDER BY i)), any_value((n + {fanout - 1}) // {fanout}) FROM {name} WHERE n > 1 GROUP BY {key}, lvl, i // {fanout})"""
    beside = lambda nodes, key: f"""SELECT {key}lvl, x.i, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS l, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS r
  FROM {nodes} x JOIN {nodes} y USING ({key}lvl) WHERE x.n > 1 AND x.i // {fanout} = y.i // {fanout} GROUP BY {key}lvl, x.i"""
    return f"""
WITH RECURSIVE crc(doc_id, rest, c) AS (SELECT DISTINCT doc_id, doc_id::VARCHAR, 4294967295::BIGINT FROM documents WHERE doc_id IS NOT NULL UNION ALL
  SELECT doc_id, substr(rest, 2), list_reduce(list_prepend(xor(c, ascii(rest)::BIGINT), range(8)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) FROM crc WHERE rest <> ''),
even AS (SELECT doc_id FROM crc WHERE rest = '' AND xor(c, 4294967295) % 2 = 0),
lv AS (SELECT doc_id, source, {leaf('text')} AS h, CASE WHEN doc_id IN (SELECT doc_id FROM even) THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS given FROM documents),
place AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS s, n, count(*) OVER () AS total FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)),
l AS (SELECT p.s, p.n, row_number() OVER (PARTITION BY p.s ORDER BY doc_id, h) - 1 AS i, doc_id, h, given FROM lv JOIN place p ON lv.source IS NOT DISTINCT FROM p.source),
{levels('low', 'l', 's')},
sub AS (SELECT s AS i, h, 0 AS one, (SELECT any_value(total) FROM place) AS n FROM low WHERE low.n = 1),
{levels('high', 'sub', 'one')},
bs AS MATERIALIZED ({beside('low', 's, ')}),
bt AS MATERIALIZED ({beside('high', 'one, ')}),
hs AS (SELECT s, max(lvl) AS top FROM low GROUP BY 1),
steps AS MATERIALIZED (SELECT l.s, l.i AS leaf, bs.lvl, bs.l, bs.r FROM l JOIN bs ON bs.s = l.s AND bs.i = l.i // ({fanout} ** bs.lvl)::BIGINT
  UNION ALL SELECT l.s, l.i, hs.top + bt.lvl, bt.l, bt.r FROM l JOIN hs USING (s) JOIN bt ON bt.i = l.s // ({fanout} ** bt.lvl)::BIGINT),
proof AS (SELECT s, leaf, sha256(string_agg(l || r, '' ORDER BY lvl)) AS p FROM steps GROUP BY 1, 2),
fold(s, leaf, lvl, h) AS (SELECT s, i, 0, given FROM l UNION ALL SELECT f.s, f.leaf, f.lvl + 1, sha256(t.l || f.h || t.r) FROM fold f JOIN steps t ON t.s = f.s AND t.leaf = f.leaf AND t.lvl = f.lvl),
last AS (SELECT s, leaf, arg_max(h, lvl) AS h FROM fold GROUP BY 1, 2),
root AS (SELECT h FROM high WHERE n = 1)
SELECT l.doc_id, l.h AS leaf, sub.h AS subroot, root.h AS root, coalesce(proof.p, sha256('')) AS proof_sha256, last.h AS folded_root, last.h = root.h AS verified
FROM l JOIN sub ON sub.i = l.s JOIN last ON last.s = l.s AND last.leaf = l.i LEFT JOIN proof ON proof.s = l.s AND proof.leaf = l.i, root"""
