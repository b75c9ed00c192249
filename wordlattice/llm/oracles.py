"""DuckDB's SQL for the queries that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{pattern}')"


#: Base32 digits of a SHA-1, four from five hex digits at a time.
_DIGIT = "(instr('0123456789abcdef', substr(h, (5 * j + {k})::INT, 1)) - 1)"
_VALUE = " + ".join(f"{16 ** (5 - k)} * {_DIGIT.format(k=k)}" for k in range(1, 6))
_FOUR = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((({_VALUE}) >> {s}) & 31)::INT + 1, 1)" for s in (15, 10, 5, 0))

ARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, array_to_string(list_transform(range(8), lambda j: {_FOUR}), '') AS payload_digest, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d"""

#: After nodes(id) and links(a, b): the smallest id that links lead to.
_COMPONENTS = """both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT id, id AS other FROM nodes UNION SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a),
component AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""

EMBEDDINGS = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
usable AS (SELECT id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
links AS (SELECT x.id AS a, y.id AS b FROM usable x JOIN usable y ON x.id < y.id AND len(x.e) = len(y.e) WHERE list_dot_product(x.e, y.e) / (x.n * y.n) >= 0.95),
nodes AS (SELECT id FROM v), {_COMPONENTS},
degree AS (SELECT a AS id, count(*) AS n FROM both_ways GROUP BY a)
SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, id = component_id AS kept FROM v JOIN component USING (id) LEFT JOIN degree USING (id)"""

_BENCH_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
DECONTAMINATE = f"""WITH d AS (SELECT doc_id, {_words("text", _BENCH_WORD)} AS w FROM documents),
b AS (SELECT item_id, {_words("text", _BENCH_WORD)} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i + 1:i + k], ' ') AS s FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, i, array_to_string(w[i + 1:i + k], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(greatest(len(w) - k + 1, 0))) AS i FROM d, (SELECT DISTINCT k FROM bw))),
hits AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, s)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN items i USING (doc_id)"""

JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, {_words("text", "[^\\x20\\x09-\\x0D]+")} AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + least(5, len(w))], ' ') AS s FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
nodes AS (SELECT doc_id AS id FROM d), {_COMPONENTS}
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d JOIN component ON id = doc_id LEFT JOIN sizes USING (doc_id)"""
