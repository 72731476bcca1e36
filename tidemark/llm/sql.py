"""SQL over the same tables for the queries that SQL can express, stated from the definitions."""

from __future__ import annotations

NEAREST = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) AS score
  FROM v q JOIN v c ON len(q.e) = len(c.e) AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM pairs) WHERE place <= 5"""


def _url_model(order: int) -> str:
    """CTEs that add the probability of a trigram's last character given the ``order - 1`` before it."""
    before = "1.0::DOUBLE / 39" if order == 1 else "p"
    tail, context = f"substr(gram, {4 - order}, {order})", f"substr(gram, {4 - order}, {order - 1})"
    return f"""
tails{order} AS (SELECT side, {tail} AS tail, {context} AS context, SUM(n) AS n FROM learnt GROUP BY ALL),
contexts{order} AS (SELECT side, context, SUM(n) AS total, COUNT(*) AS kinds FROM tails{order} GROUP BY ALL),
level{order} AS (
  SELECT l.side, l.gram, CASE WHEN total IS NULL THEN {before} ELSE (COALESCE(n, 0) + kinds * ({before})) / (total + kinds) END AS p
  FROM {"sides" if order == 1 else f"level{order - 1}"} l
  LEFT JOIN tails{order} t ON t.side = l.side AND t.tail = {tail.replace("gram", "l.gram")}
  LEFT JOIN contexts{order} c ON c.side = l.side AND c.context = {context.replace("gram", "l.gram")}),"""


URL_FILTER = rf"""
WITH parts AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
named AS (
  SELECT page_id, url, rest,
    COALESCE(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    COALESCE(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts),
rules(verdict, rule, rule_host, rule_path) AS (
  VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
    ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
fitting AS (
  SELECT host, path, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
  FROM (SELECT DISTINCT host, path FROM named) JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY host, path),
judged AS (SELECT n.*, f.rule, f.verdict AS told FROM named n LEFT JOIN fitting f USING (host, path)),
dealt AS (
  SELECT url, COUNT(*) AS n, any_value(told) AS told, ('0x' || substr(md5(any_value(host)), 1, 8))::BIGINT % 5 AS fold,
    '^^' || regexp_replace(translate(lower(COALESCE(any_value(rest), url, '')), '123456789', '000000000'), '[^a-z0./_?=&:%#-]', '~', 'g') || '^' AS text
  FROM judged GROUP BY url),
kinds AS (SELECT COUNT(DISTINCT told) FILTER (fold > 0) = 2 AS apart FROM dealt),
urls AS (SELECT * REPLACE (CASE WHEN apart THEN fold ELSE 1 END AS fold) FROM dealt, kinds),
cut AS (SELECT url, n, told, fold, substr(text, k, 3) AS gram FROM (SELECT *, unnest(range(1, length(text) - 1)) AS k FROM urls)),
learnt AS (SELECT told AS side, gram, SUM(n) AS n FROM cut WHERE told IS NOT NULL AND fold > 0 GROUP BY told, gram),
sides AS (SELECT side, gram FROM (SELECT DISTINCT gram FROM cut), (VALUES ('allow'), ('block')) s(side)),{"".join(map(_url_model, (1, 2, 3)))}
weights AS (SELECT gram, ln(MAX(p) FILTER (side = 'allow')) - ln(MAX(p) FILTER (side = 'block')) AS weight FROM level3 GROUP BY gram),
modelled AS (SELECT COUNT(DISTINCT told) = 2 AS two_sided FROM urls WHERE fold > 0),
scores AS (
  SELECT url, n, told, fold, CASE WHEN (SELECT two_sided FROM modelled) THEN ROUND(AVG(weight), 9) END AS score
  FROM cut JOIN weights USING (gram) GROUP BY url, n, told, fold),
tested AS (SELECT n, told, floor(score * 100) AS bin FROM scores WHERE told IS NOT NULL AND fold = 0 AND score IS NOT NULL),
cuts AS (
  SELECT c.bin AS cut, SUM(n) FILTER (told = 'allow' AND t.bin >= c.bin) / SUM(n) FILTER (told = 'allow')
    + COALESCE(SUM(n) FILTER (told = 'block' AND t.bin < c.bin), 0) / SUM(n) FILTER (told = 'block') AS gain
  FROM (SELECT MIN(bin) AS bin FROM tested UNION SELECT bin + 1 FROM tested) c, tested t GROUP BY c.bin),
chosen AS (SELECT cut / 100 AS cut FROM cuts WHERE gain IS NOT NULL ORDER BY ROUND(gain, 12) DESC, cut LIMIT 1)
SELECT page_id, host, path, rule, score,
  COALESCE(j.told, CASE WHEN s.score IS NULL OR s.score >= COALESCE((SELECT cut FROM chosen), 0) THEN 'allow' ELSE 'block' END) AS verdict
FROM judged j LEFT JOIN scores s ON s.url IS NOT DISTINCT FROM j.url"""


def _base32(digits: str) -> str:
    letters = []
    for at in range(0, 40, 5):
        number = f"('0x' || substr({digits}, {at + 1}, 5))::INTEGER"
        letters += [f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({number} >> {shift}) & 31) + 1, 1)" for shift in (15, 10, 5, 0)]
    return " || ".join(letters)


REVISITS = f"""
WITH payloads AS (SELECT page_id, octet_length(encode(COALESCE(html, ''))) AS payload_bytes, sha1(COALESCE(html, '')) AS hex FROM pages),
ordered AS (
  SELECT *, MAX(page_id) OVER (PARTITION BY hex) AS kept, row_number() OVER (PARTITION BY hex ORDER BY page_id DESC NULLS LAST) AS place FROM payloads)
SELECT page_id, payload_bytes, {_base32("hex")} AS payload_digest, CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN kept END AS refers_to FROM ordered"""


# CRC-32 by its polynomial: a table of 256 remainders, then a step a byte.
_REMAINDERS = """SELECT list_transform(range(256), lambda b: list_reduce(range(8),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS remainders"""


def _crc32(text: str) -> str:
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    step = "lambda c, b: xor(c >> 8, remainders[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce({octets}, {step}, 4294967295::BIGINT), 4294967295)"


CONVERSATION_TRIE = f"""
WITH RECURSIVE crc AS ({_REMAINDERS}),
said AS (
  SELECT conv_id, COALESCE(role, '') AS role, COALESCE(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, COALESCE(role, ''), sha256(COALESCE(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc32("conv_id::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM said), crc),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, place, role, text FROM convs c JOIN said s ON s.conv_id = c.base AND place <= h
  UNION ALL SELECT c.conv_id, 1, place, role, text FROM convs c JOIN said s ON s.conv_id = c.conv_id AND place > h),
turns AS (SELECT conv_id, sha256(length(role) || ':' || role || text) AS turn, strlen(text) AS bytes, part, place FROM rebuilt),
paths AS (
  SELECT conv_id, COALESCE(list(turn ORDER BY part, place) FILTER (turn IS NOT NULL), []) AS path,
    COALESCE(list(bytes ORDER BY part, place) FILTER (turn IS NOT NULL), []) AS sizes FROM convs LEFT JOIN turns USING (conv_id) GROUP BY conv_id),
steps AS (SELECT conv_id, path, sizes, unnest(range(len(path) + 1)) AS depth FROM paths),
named AS (SELECT conv_id, depth, array_to_string(path[1:depth], '/') AS node, array_to_string(path[1:depth - 1], '/') AS parent,
    CASE WHEN depth > 0 THEN sizes[depth] ELSE 0 END AS bytes, depth = len(path) AS ends FROM steps),
nodes AS (
  SELECT node, any_value(CASE WHEN depth > 0 THEN parent END) AS parent, MIN(conv_id) AS conv_id, any_value(depth) AS depth, COUNT(*) AS n_convs,
    (COUNT(*) - 1) * any_value(bytes) AS saved,
    sha256(COALESCE(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM named GROUP BY node),
linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT COUNT(*) FROM nodes c WHERE c.parent = n.node) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.node = n.parent),
above AS (
  SELECT node AS top, node, parent FROM nodes
  UNION ALL SELECT n.node, a.node, n.parent FROM above a JOIN nodes n ON n.node = a.parent),
below AS (
  SELECT top, COUNT(*) FILTER (n_children = 0) AS n_leaves, SUM(saved) AS saved_tokens FROM above JOIN linked USING (node) GROUP BY top)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM linked JOIN below ON top = node"""


def _sharding(shards: int) -> str:
    """Capacity by binary search, then each cut near the share of what is left that heavy groups leave, between the earliest
    place that leaves room for the rest and the last one that the shard has room for. Places are bytes before them."""
    last = shards - 1
    earliest = [f"e{shards} AS (SELECT total AS mark FROM groups_list)"] + [
        f"e{k} AS (SELECT MIN(mark) AS mark FROM places WHERE mark >= (SELECT mark FROM e{k + 1}) - (SELECT capacity FROM least))" for k in range(last, 0, -1)
    ]
    cuts = ["c0 AS (SELECT 0::BIGINT AS mark)"]
    for k in range(1, shards):
        own = f"(SELECT mark FROM c{k - 1})"
        cuts += [
            f"""a{k} AS (SELECT {own} AS p, (SELECT total FROM groups_list) AS t, (SELECT capacity FROM least) AS capacity, {shards - k + 1} AS r,
          COUNT(*) AS h, COALESCE(SUM(total), 0) AS weight, MIN(before) AS next, MAX(total) FILTER (before = {own}) AS here FROM heavy WHERE before >= {own})""",
            f"""w{k} AS (SELECT p, capacity, CASE WHEN here IS NOT NULL THEN p + here
          WHEN r > h THEN least(p - (-(t - p - weight) // (r - h)), COALESCE(next, t)) ELSE least(p + capacity, COALESCE(next, t)) END AS x FROM a{k})""",
            f"""c{k} AS (SELECT least(greatest(
          COALESCE((SELECT NULLIF(MAX(mark), p) FROM places WHERE mark <= x), (SELECT MIN(mark) FROM places WHERE mark > p), p), (SELECT mark FROM e{k})),
          (SELECT MAX(mark) FROM places WHERE mark <= p + capacity))::BIGINT AS mark FROM w{k})""",
        ]
    shard = " + ".join(f"(before >= (SELECT mark FROM c{k}))::INTEGER" for k in range(1, shards))
    return f"""
WITH RECURSIVE crc AS ({_REMAINDERS}),
sized AS (
  SELECT doc_id, strlen(COALESCE(text, '')) + 1 AS size, {_crc32("COALESCE(text, '')")} AS text_crc32, substr(sha256(COALESCE(text, '')), 1, 32) AS digest
  FROM documents, crc),
summed AS (SELECT digest, SUM(size)::BIGINT AS total FROM sized GROUP BY digest),
ordered AS (SELECT digest, total, (SUM(total) OVER (ORDER BY digest) - total)::BIGINT AS before FROM summed),
groups_list AS (SELECT list(total ORDER BY digest) AS sizes, SUM(total)::BIGINT AS total, MAX(total) AS largest FROM ordered),
places AS (SELECT before AS mark FROM ordered UNION SELECT total FROM groups_list),
search AS (
  SELECT greatest(largest, -(-total // {shards}))::BIGINT AS low, total AS high FROM groups_list
  UNION ALL
  SELECT CASE WHEN fits THEN low ELSE middle + 1 END, CASE WHEN fits THEN middle ELSE high END FROM (
    SELECT low, high, (low + high) // 2 AS middle, list_reduce(sizes,
      lambda s, x: CASE WHEN s.used + x <= (low + high) // 2 THEN {{'used': s.used + x, 'shards': s.shards}} ELSE {{'used': x, 'shards': s.shards + 1}} END,
      {{'used': 0::BIGINT, 'shards': 1::BIGINT}}).shards <= {shards} AS fits
    FROM search, groups_list WHERE low < high)),
least AS (SELECT MIN(high) AS capacity FROM search),
heavy AS (SELECT before, total FROM ordered WHERE total * {shards} > (SELECT total FROM groups_list)),
{", ".join(earliest)},
{", ".join(cuts)},
sharded AS (SELECT doc_id, size, text_crc32, digest, {shard} AS shard FROM sized JOIN ordered USING (digest))
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5(COALESCE(doc_id::VARCHAR, '') || ':' || digest), doc_id) - 1 AS slot,
  NULL::INTEGER AS grown_shard FROM sharded"""


LEXICAL_SEARCH = r"""
WITH tokens AS (
  SELECT document, doc_id, unnest(regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS document, * FROM documents)),
asked AS (
  SELECT DISTINCT item, item_id, term FROM (
    SELECT item, item_id, unnest(regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS item, * FROM benchmark))),
lengths AS (SELECT document, any_value(doc_id) AS doc_id, COUNT(*) AS n FROM tokens GROUP BY document),
totals AS (SELECT COUNT(*) AS n_docs, SUM(n)::BIGINT AS n_terms FROM lengths),
counts AS (SELECT document, term, COUNT(*) AS tf FROM tokens GROUP BY document, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, COUNT(*) AS df FROM counts GROUP BY term), totals),
scores AS (
  SELECT item, item_id, document, doc_id, SUM(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (document), totals GROUP BY item, item_id, document, doc_id)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scores WHERE score > 0) WHERE place <= 10"""

SQL = {
    "op1_nearest_neighbours": NEAREST,
    "op5_url_filter": URL_FILTER,
    "op9_warc_revisits": REVISITS,
    "op11_conversation_trie": CONVERSATION_TRIE,
    "op12_sharding": _sharding(8),
    "op13_lexical_search": LEXICAL_SEARCH,
}
