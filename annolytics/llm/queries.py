"""The registered queries of this subpackage, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolytics.llm import (
    chat, divergence, filter_audit, merge_dropout, mixing, ngram_join, page_diff, partitions, pii, resample, ring, spotsigs, warc,
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_spotsigs(spark: SparkSession, folder: str) -> DataFrame:
    return spotsigs.fingerprint_neighbours(table(spark, folder, "documents"))


def op2_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.join(table(spark, folder, "documents"), words=3, percent=90)


def op3_warc_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"), least_bytes=0)


def op4_page_differencing(spark: SparkSession, folder: str) -> DataFrame:
    return page_diff.extract(table(spark, folder, "pages"), turn_back=True)


def op5_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resample.resample(table(spark, folder, "documents"), table(spark, folder, "labels"), seed=5)


def op6_candidate_boosting(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(table(spark, folder, "documents"))


#: Target weights of the mixture: the large source a quarter, the others alike.
WEIGHTS = {"src0": 0.24} | {f"src{i}": 0.04 for i in range(1, 20)}


def op7_pfair_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.schedule(table(spark, folder, "documents"), WEIGHTS)


def op8_learned_partitions(spark: SparkSession, folder: str) -> DataFrame:
    return partitions.search(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op9_perspective_rotation(spark: SparkSession, folder: str) -> DataFrame:
    return chat.rotate(table(spark, folder, "conversations"))


def op10_merge_dropout(spark: SparkSession, folder: str) -> DataFrame:
    return merge_dropout.encode(table(spark, folder, "documents"), seed=20)


def op11_divergence_stripes(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"), least_docs=30, top=50)


def op12_filter_diagrams(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op13_bounded_ring(spark: SparkSession, folder: str) -> DataFrame:
    return ring.place(table(spark, folder, "documents"), shards=24)


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_spotsigs, op2_ngram_join, op3_warc_dictionary, op4_page_differencing, op5_importance_resampling, op6_candidate_boosting,
    op7_pfair_mixing, op8_learned_partitions, op9_perspective_rotation, op10_merge_dropout, op11_divergence_stripes,
    op12_filter_diagrams, op13_bounded_ring,
)}

# The payloads as DuckDB sees them; base32 is written out, since SQL has no function for it.
OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first_id, row_number() OVER (PARTITION BY hex ORDER BY page_id) AS place FROM d),
b AS (
  SELECT hex, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (('0x' || substr(hex || '0', 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) % 32 + 1, 1)), 'string_agg', '') AS base32
  FROM (SELECT DISTINCT hex FROM d)
)
SELECT page_id, payload_bytes, base32 AS payload_digest, CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN first_id END AS refers_to
FROM r JOIN b USING (hex)
"""

# One period of 1,000 slots by recursion, then arithmetic. The weights are those above, with every source present.
OP7_SQL = """
WITH RECURSIVE s AS (SELECT * FROM (SELECT DISTINCT source AS stream, CASE WHEN source = 'src0' THEN 240 ELSE 40 END AS w FROM documents)),
l AS (SELECT list(stream ORDER BY stream) AS names, list(w ORDER BY stream) AS ws, count(*) AS n FROM s),
r AS (
  SELECT -1 AS t, -1 AS pick, list_transform(range(0, n), lambda i: 0::BIGINT) AS done FROM l
  UNION ALL
  SELECT t + 1, first, list_transform(done, lambda d, i: d + (i - 1 = first)::INT)
  FROM (
    SELECT t, done, list_sort(list_transform(range(0, n), lambda i: {
      'early': done[i + 1] * 1000 >= (t + 2) * ws[i + 1], 'due': ((done[i + 1] + 1) * 1000 + ws[i + 1] - 1) // ws[i + 1], 'i': i
    }))[1].i AS first
    FROM r, l WHERE t < 999
  )
),
p AS (SELECT names[pick + 1] AS stream, t AS place, row_number() OVER (PARTITION BY pick ORDER BY t) AS turn FROM r, l WHERE t >= 0),
d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS i FROM documents),
b AS (SELECT source AS stream, max(i // 16) + 1 AS blocks FROM d GROUP BY source),
z AS (
  SELECT max(((blocks - 1) // w) * 1000 + place) AS last FROM b JOIN s USING (stream) JOIN p USING (stream) WHERE turn = (blocks - 1) % w + 1
),
k AS (
  SELECT d.*, i // 16 AS block, w, blocks, unnest(range(i // 16, (last // 1000 + 1) * w, blocks)) AS k, last
  FROM d JOIN b ON d.source = b.stream JOIN s ON s.stream = b.stream, z
)
SELECT doc_id, source, source AS stream, block, k // blocks AS pass, (k // w) * 1000 + place AS slot, i % 16 AS within,
  k * 1000 // w AS release, ((k + 1) * 1000 + w - 1) // w AS deadline
FROM k JOIN p ON p.stream = k.source AND p.turn = k % w + 1
WHERE (k // w) * 1000 + place <= last
"""

OP9_SQL = """
WITH c AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS said,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS n
  FROM conversations
),
v AS (SELECT DISTINCT conv_id, role AS perspective FROM c WHERE role <> 'system'),
l AS (
  SELECT conv_id, perspective, n, ((n - 1) // 64)::INT AS part, role = perspective AS own, said || '<|im_end|>' AS body,
    '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = perspective THEN 'assistant'
      ELSE 'user name=' || replace(role, '<|', '< |') END || chr(10) AS head
  FROM c JOIN v USING (conv_id)
),
o AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, part ORDER BY n) AS ends FROM l
)
SELECT conv_id, perspective, part, count(*) AS n_turns, count(*) FILTER (own) AS n_masked,
  string_agg(head || body || chr(10), '' ORDER BY n) AS rendered,
  coalesce(string_agg((ends - 1 - length(body))::BIGINT || ':' || (ends - 1)::BIGINT, ',' ORDER BY n) FILTER (own), '') AS mask
FROM o GROUP BY conv_id, perspective, part
"""

OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words, row_number() OVER () AS row_id FROM documents),
t AS (SELECT row_id, lang, source, unnest(words) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT row_id) AS docs FROM t GROUP BY ALL),
k AS (SELECT lang, term FROM c GROUP BY ALL HAVING sum(docs) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
fp AS (SELECT *, 1 + ((1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v)) AS p FROM f JOIN v USING (lang)),
l AS (SELECT lang, term, any_value(v) AS v, sum(n) AS n FROM fp GROUP BY ALL),
lp AS (SELECT *, 1 + ((1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v)) AS p FROM l),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(any_value(x.value), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM fp x JOIN fp y USING (lang, term) GROUP BY ALL) x
    ON x.lang = a.lang AND x.source = a.source AND x.item = b.source GROUP BY 1, 2, 3
),
terms AS (SELECT fp.lang, fp.source, fp.term AS item, fp.p - lp.p AS value FROM fp JOIN lp USING (lang, term) WHERE fp.n > 0 AND fp.p > lp.p)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value,
  row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value::BIGINT, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM terms) WHERE rank <= 50
"""

# The filters are applied in each of the 120 orders, mask by mask; bit i of a mask is the i-th filter.
OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
m AS (
  SELECT doc_id, part, (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * (coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false))::INT AS mask
  FROM d
),
c AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS bad
  FROM m LEFT JOIN labels USING (doc_id) GROUP BY ALL
),
x AS (SELECT unnest(range(0, 5)) AS i),
o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS seq FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
),
s AS (
  SELECT seq, list_aggregate(list_transform(seq, lambda f: substr('ABCDE', f::INT + 1, 1)), 'string_agg', '') AS filter_order,
    unnest(range(1, 6)) AS step FROM o
),
b AS (
  SELECT filter_order, step, 1 << seq[step] AS bit, list_sum(list_transform(seq[1:step], lambda f: 1 << f)) - (1 << seq[step]) AS earlier FROM s
),
r AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & (earlier | bit) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (mask & earlier = 0 AND mask & bit > 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & earlier > 0 AND mask & bit > 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & earlier = 0 AND mask & bit > 0), 0) AS good_lost,
    coalesce(sum(bad) FILTER (mask & earlier = 0 AND mask & bit > 0), 0) AS toxic_lost
  FROM c, b GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""

# Arc by arc around the ring: each shard in clockwise order takes what it has room for. The checksum goes byte by byte.
OP13_SQL = """
WITH RECURSIVE crc_bits AS (
  SELECT b, 0 AS i, b::BIGINT AS c FROM range(0, 256) a(b)
  UNION ALL SELECT b, i + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_bits WHERE i < 8
),
crc_table AS (SELECT list(c ORDER BY b) AS crcs FROM crc_bits WHERE i = 8),
sums AS (
  SELECT text, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT),
    lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS crc
  FROM (SELECT DISTINCT coalesce(text, '') AS text FROM documents), crc_table
),
ring AS (
  SELECT s, pos, row_number() OVER (ORDER BY pos, s) - 1 AS arc FROM (
    SELECT s, ('0x' || substr(md5(s || ':' || v), 1, 15))::BIGINT AS pos FROM range(0, 24) a(s), range(0, 128) b(v))
),
d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, coalesce(text, '') AS text,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS pos FROM documents
),
k AS (SELECT d.*, coalesce(r.arc, 0) AS arc FROM d ASOF LEFT JOIN ring r ON r.pos >= d.pos),
n AS (SELECT *, row_number() OVER (PARTITION BY arc ORDER BY pos, doc_id, size) AS number FROM k),
near AS (
  SELECT arc, list(s ORDER BY away) AS shards FROM (
    SELECT a.arc, b.s, min((b.arc - a.arc + 3072) % 3072) AS away FROM (SELECT DISTINCT arc FROM n) a, ring b GROUP BY ALL) GROUP BY arc
),
q AS (SELECT arc, count(*) AS keys, any_value(shards) AS shards, row_number() OVER (ORDER BY arc) AS i FROM n JOIN near USING (arc) GROUP BY arc),
r AS (
  SELECT 0::BIGINT AS i, list_transform(range(0, 24), lambda s: total // 24 + (s < total % 24)::INT) AS room, range(0, 0) AS took
  FROM (SELECT count(*) AS total FROM n)
  UNION ALL
  SELECT i + 1, list_transform(room, lambda x, s: x - list_sum(list_transform(range(1, 25), lambda j: CASE WHEN shards[j] = s - 1 THEN took[j] ELSE 0 END))), took
  FROM (
    SELECT i, room, shards, list_transform(range(1, 25), lambda j: greatest(0, least(open[j], keys - coalesce(list_sum(open[1:j - 1]), 0)))) AS took
    FROM (SELECT r.i, room, keys, shards, list_transform(shards, lambda s: room[s + 1]) AS open FROM r JOIN q ON q.i = r.i + 1)
  )
),
t AS (SELECT arc, r.i, unnest(shards) AS shard, unnest(took) AS took, unnest(range(0, 24)) AS j FROM r JOIN q USING (i)),
spans AS (
  SELECT arc, shard, took, sum(took) OVER (PARTITION BY arc ORDER BY j) - took AS first,
    sum(took) OVER (PARTITION BY shard ORDER BY i) - took AS slot FROM t
)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, shard::INT AS shard, (slot + number - 1 - first)::BIGINT AS slot, NULL::INT AS grown_shard
FROM n JOIN sums USING (text) JOIN spans USING (arc) WHERE number > first AND number <= first + took
"""

ORACLE_SQL: dict[str, str] = {
    "op9_perspective_rotation": OP9_SQL, "op7_pfair_mixing": OP7_SQL, "op3_warc_dictionary": OP3_SQL,
    "op11_divergence_stripes": OP11_SQL, "op12_filter_diagrams": OP12_SQL, "op13_bounded_ring": OP13_SQL,
}
