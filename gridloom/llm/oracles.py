"""SQL with the same results, for the text queries that SQL can express."""

from __future__ import annotations

from . import decontam, urls
from .license import TEMPLATES


def _values(rows: list[tuple]) -> str:
    text = lambda v: f"'{v}'" if isinstance(v, str) else str(v).lower()
    return "(VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + ")"


def license_sql() -> str:
    """Base places, base labels, all labels and the score of every document, by counting in blocks."""
    members, steps, names = [], [], []
    for tid, t in enumerate(TEMPLATES):
        words = t.words.split()
        names.append((tid, t.label, t.base, t.phrase, len(t.tokens), t.need, len(words), t.stride))
        members += [(tid, w, t.stride) for w in t.tokens]
        steps += [(tid, w, k) for k, w in enumerate(words)]
    return f"""
WITH l AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
d AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words FROM l),
e AS (SELECT doc_id, unnest(w) AS tok, CAST(generate_subscripts(w, 1) - 1 AS BIGINT) AS pos FROM l),
t AS (SELECT * FROM {_values(names)} x(tid, label, base, phrase, n, need, size, stride)),
m AS (SELECT e.doc_id, m.tid, e.tok, e.pos // m.stride - o AS block FROM e JOIN {_values(members)} m(tid, tok, stride) ON m.tok = e.tok, (VALUES (0), (1)) s(o)),
c AS (SELECT doc_id, tid, block, count(DISTINCT tok) AS overlap FROM m WHERE block >= 0 GROUP BY 1, 2, 3),
f AS (SELECT c.doc_id, c.tid, max(overlap / CAST(t.n AS DOUBLE)) AS share FROM c JOIN t ON t.tid = c.tid JOIN d ON d.doc_id = c.doc_id
  WHERE overlap >= t.need AND least(d.n_words - block * t.stride, 2 * t.stride) >= t.need GROUP BY 1, 2),
s AS (SELECT e.doc_id, p.tid, e.pos - p.k AS place, count(*) AS hit FROM e JOIN {_values(steps)} p(tid, tok, k) ON p.tok = e.tok GROUP BY 1, 2, 3),
h AS (SELECT s.doc_id, t.label, t.base, s.place, CAST(1 AS DOUBLE) AS share FROM s JOIN t ON t.tid = s.tid AND t.phrase AND s.hit = t.size
  UNION ALL SELECT f.doc_id, t.label, t.base, NULL, f.share FROM f JOIN t ON t.tid = f.tid AND NOT t.phrase),
g AS (SELECT doc_id, count(CASE WHEN base THEN place END) AS n_base, min(CASE WHEN base THEN place END) AS first_word, max(CASE WHEN base THEN place END) AS last_word, max(share) AS score FROM h GROUP BY doc_id),
b AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT doc_id, label FROM h WHERE base) GROUP BY doc_id),
a AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT doc_id, label FROM h) GROUP BY doc_id)
SELECT d.doc_id, d.n_words, CAST(coalesce(g.n_base, 0) AS BIGINT) AS n_base, g.first_word, g.last_word, coalesce(b.base_labels, '') AS base_labels, coalesce(a.labels, '') AS labels, coalesce(g.score, 0.0) AS score
FROM d LEFT JOIN g ON g.doc_id = d.doc_id LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN a ON a.doc_id = d.doc_id"""


#: Exact near-duplicate components: pairs by a prefix filter on the rarest shingles, counted in full, closed by recursion.
NEAR_DUPLICATES = r"""
WITH RECURSIVE l AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) WHEN len(w) = 1 THEN w ELSE [] END) AS s FROM l)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT s, count(*) AS f FROM s GROUP BY s),
p AS (SELECT s.doc_id, s.s, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY f.f, s.s) AS k FROM s JOIN f ON f.s = s.s JOIN n ON n.doc_id = s.doc_id),
q AS (SELECT doc_id, s, n FROM p WHERE k <= n - (80 * n + 99) // 100 + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM q a JOIN q b ON a.s = b.s AND a.doc_id < b.doc_id WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
o AS (SELECT c.a, c.b, c.na, c.nb, count(*) AS common FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b AND y.s = x.s GROUP BY 1, 2, 3, 4),
e AS (SELECT a, b FROM o WHERE 100 * common >= 80 * (na + nb - common)),
e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS doc_id, a AS root FROM e2 UNION SELECT e2.b, r.root FROM r JOIN e2 ON e2.a = r.doc_id),
m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id, coalesce(m.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id"""


#: Segments of a path that the SQL of the url filter has levels for; the operator has as many as the deepest path.
URL_DEPTH = 3


def url_sql(rules: list[tuple[str, str]]) -> str:
    """Host, path, rule, verdict, template and purity of every page, level by level."""
    fits = []
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        host, slash, path = rule.partition("/")
        fits.append((f"(host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '{slash}{path}')", rule))
    of_rule = "CASE " + " ".join(f"WHEN {test} THEN '{rule}'" for test, rule in fits) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in rules) + " END"
    segment = lambda k: f"regexp_replace(list_extract(parts, {k}), '{urls.VARIABLE}', '*', 'g')"
    general = [f"coalesce(CASE WHEN regexp_matches({segment(k)}, '{urls.WILD}') THEN '*' ELSE {segment(k)} END, '')" for k in range(1, URL_DEPTH + 1)]
    g = [f"g{k}" for k in range(URL_DEPTH)]
    m, names = f"CAST({urls.SMOOTHING} AS DOUBLE)", ", ".join(g)
    out = [
        "u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        f"h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)",
        f"r0 AS (SELECT page_id, host, path, {of_rule} AS rule, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM h)",
        f"r AS (SELECT page_id, host, path, rule, {verdict} AS by_rule, " + ", ".join(f"{e} AS {n}" for e, n in zip(general, g, strict=True)) + " FROM r0)",
        f"leaves AS (SELECT host, {names}, count(*) AS n, count(CASE WHEN by_rule = 'allow' THEN 1 END) AS a, count(CASE WHEN by_rule = 'block' THEN 1 END) AS b FROM r GROUP BY host, {names})",
        "total AS (SELECT (sum(b) + 1) / CAST(sum(a) + sum(b) + 2 AS DOUBLE) AS p FROM leaves)",
        f"hosts AS (SELECT host, (sum(b) + {m} * max(total.p)) / (sum(a) + sum(b) + {m}) AS purity FROM leaves, total GROUP BY host)",
        f"n0 AS (SELECT leaves.host, {names}, n, a, b, leaves.host AS key, purity FROM leaves JOIN hosts ON hosts.host = leaves.host)",
    ]
    for k in range(URL_DEPTH):
        noise = f"sqrt(up * (1 - up) / (a + b + {m}))"
        out += [
            f"c{k} AS (SELECT key, g{k} AS seg, sum(n) AS n, sum(a) AS a, sum(b) AS b, max(purity) AS up FROM n{k} GROUP BY 1, 2)",
            f"b{k} AS (SELECT *, CASE WHEN seg = '' THEN '' WHEN abs((b + {m} * up) / (a + b + {m}) - up) <= {urls.DEVIATIONS} * {noise} THEN '*' ELSE seg END AS branch FROM c{k})",
            f"p{k} AS (SELECT key, branch, (sum(b) + {m} * max(up)) / (sum(a) + sum(b) + {m}) AS next FROM b{k} GROUP BY 1, 2)",
            f"n{k + 1} AS (SELECT x.host, " + ", ".join(f"x.{c}" for c in g) + f", x.n, x.a, x.b, CASE WHEN v.branch = '' THEN x.key ELSE x.key || '/' || v.branch END AS key, CASE WHEN v.branch = '' THEN x.purity ELSE p{k}.next END AS purity "
            f"FROM n{k} x JOIN b{k} v ON v.key = x.key AND v.seg = x.g{k} JOIN p{k} ON p{k}.key = v.key AND p{k}.branch = v.branch)",
        ]
    last = f"n{URL_DEPTH}"
    on = " AND ".join(f"t.{c} = r.{c}" for c in ("host", *g))
    return "WITH " + ",\n".join(out) + f"""
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.by_rule, CASE WHEN t.purity > {urls.REJECT_AT} THEN 'block' ELSE 'allow' END) AS verdict, t.key AS template, round(t.purity, 9) AS purity
FROM r JOIN {last} t ON {on}"""


def overlap_sql() -> str:
    """Best overlap of every document and item on the diagonals of seed hits; seeds are the words themselves here."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
    plans = [(k, len(m), [i for i, c in enumerate(m) if c == "1"]) for k, m in enumerate(decontam.MASKS)]
    shortest = min(span for _, span, _ in plans)
    whole = [(100 + n, n, list(range(n))) for n in range(decontam.SHORTEST, shortest)]

    def seeds(source: str, ident: str, plan: list, test: str) -> str:
        one = "SELECT {id}, {m} AS m, p, concat_ws(' ', {w}) AS s FROM (SELECT {id}, w, unnest(range(len(w) - {n} + 1)) AS p FROM {source} WHERE len(w) {test} {n})"
        return " UNION ALL ".join(one.format(id=ident, m=m, w=", ".join(f"w[p + {o + 1}]" for o in at), n=n, source=source, test=test) for m, n, at in plan)

    key = "doc_id, item_id, shift"
    return f"""
WITH l AS (SELECT doc_id, {words} AS w FROM documents),
i AS (SELECT item_id, {words} AS w FROM benchmark),
sd AS ({seeds("l", "doc_id", plans + whole, ">=")}),
si AS ({seeds("i", "item_id", plans, ">=")} UNION ALL {seeds("i", "item_id", whole, "=")}),
k AS (SELECT DISTINCT sd.doc_id, si.item_id, sd.p - si.p AS shift FROM sd JOIN si ON sd.m = si.m AND sd.s = si.s),
a AS (SELECT k.doc_id, k.item_id, k.shift, l.w AS dw, i.w AS iw, unnest(range(greatest(0, -k.shift), least(len(i.w), len(l.w) - k.shift))) AS j FROM k JOIN l ON l.doc_id = k.doc_id JOIN i ON i.item_id = k.item_id),
e AS (SELECT {key}, len(iw) AS item_words, j, CASE WHEN dw[j + shift + 1] = iw[j + 1] THEN 1 ELSE 0 END AS same FROM a),
c AS (SELECT *, sum(CASE WHEN same = 1 THEN 1 ELSE -2 END) OVER (PARTITION BY {key} ORDER BY j) AS sc FROM e),
v AS (SELECT *, least(0, min(sc) OVER (PARTITION BY {key} ORDER BY j)) AS lo FROM c),
b AS (SELECT {key}, item_words, j AS last, lo FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY sc - lo DESC, j) AS r FROM v) WHERE r = 1 AND sc > lo),
f AS (SELECT b.doc_id, b.item_id, b.shift, b.item_words, b.last, coalesce(max(CASE WHEN v.sc = b.lo AND v.j < b.last THEN v.j + 1 END), min(v.j)) AS first FROM b JOIN v ON v.doc_id = b.doc_id AND v.item_id = b.item_id AND v.shift = b.shift GROUP BY 1, 2, 3, 4, 5),
g AS (SELECT f.doc_id, f.item_id, f.first + f.shift AS doc_word, f.first AS item_word, f.item_words, f.last - f.first + 1 AS n_words, CAST(sum(e.same) AS BIGINT) AS n_matches FROM f JOIN e ON e.doc_id = f.doc_id AND e.item_id = f.item_id AND e.shift = f.shift AND e.j BETWEEN f.first AND f.last GROUP BY 1, 2, 3, 4, 5, 6),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_matches DESC, n_words DESC, doc_word, item_word) AS r FROM g WHERE n_matches >= {decontam.IDENTITY} * n_words AND n_matches >= least({decontam.LEAST_MATCHES}, {decontam.IDENTITY} * item_words))
SELECT doc_id, item_id, CAST(doc_word AS BIGINT) AS doc_word, CAST(item_word AS BIGINT) AS item_word, CAST(n_words AS BIGINT) AS n_words, n_matches FROM o WHERE r = 1"""
