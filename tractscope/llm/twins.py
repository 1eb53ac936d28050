"""DuckDB SQL for the queries that SQL can express plainly: runs by lag islands,
jump hashing by a recursive table, codebooks by all distances.

``crc32`` has no SQL function there: a table of 256 remainders is built from
the polynomial (a fixed value) and folded over the bytes."""

from __future__ import annotations

from .runs import MIN_LENGTH, MIN_PERIODS, WORD
from .sharding import MULTIPLIER, SCALE as JUMP_SCALE, SHARDS, SHIFT
from .vector_codes import ENTRIES, PARTS, ROUNDS, SCALE

_REMAINDERS = """(SELECT list(list_reduce([n] || range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
  ORDER BY n) AS tab FROM range(256) AS r(n))"""


def _crc(numbers: str) -> str:
    return f"xor(list_reduce([4294967295] || {numbers}, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


_ID_BYTES = "list_transform(range(length(CAST(doc_id AS VARCHAR))), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i + 1, 1)) AS BIGINT))"
_TEXT_BYTES = "list_transform(range(strlen(text)), lambda i: CAST('0x' || substr(hexed, 2 * i + 1, 2) AS BIGINT))"

RUNS = f"""
WITH tab AS {_REMAINDERS},
d AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
         CASE WHEN doc_id IS NULL THEN 1 ELSE {_crc(_ID_BYTES)} END AS h
  FROM documents, tab
), e AS (SELECT *, len(w) AS n, h // 10 AS g FROM d
), f AS (SELECT *, CASE WHEN n > 0 THEN g % n ELSE 0 END AS a FROM e
), x AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM f
), v AS (
  SELECT doc_id, rid, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w
  FROM x
), u AS (SELECT rid, n, unnest(range(n)) AS i, unnest(w) AS word FROM v
), m AS (
  SELECT r.rid, r.i, r.i - l.i AS lag, r.i - row_number() OVER (PARTITION BY r.rid, r.i - l.i ORDER BY r.i) AS island
  FROM u r JOIN u l ON r.rid = l.rid AND r.word = l.word AND l.i < r.i AND {MIN_PERIODS} * (r.i - l.i) <= r.n
), s AS (
  SELECT rid, min(i) - lag AS start, count(*) + lag AS length, lag FROM m GROUP BY rid, lag, island
  HAVING count(*) + lag >= greatest({MIN_LENGTH}, {MIN_PERIODS} * lag)
), q AS (SELECT rid, start, length, min(lag) AS period FROM s GROUP BY rid, start, length
), best AS (
  SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length // period DESC,
    CAST(length % period AS DOUBLE) / period DESC, start, period) = 1
), all_runs AS (
  SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM q GROUP BY rid
), gone AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM q
), stay AS (
  SELECT u.rid, string_agg(u.word, ' ' ORDER BY u.i) AS body FROM u ANTI JOIN gone ON u.rid = gone.rid AND u.i = gone.i GROUP BY u.rid
)
SELECT v.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length,
       CAST(period AS BIGINT) AS period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256, CAST(n AS BIGINT) AS n_words
FROM v LEFT JOIN best USING (rid) LEFT JOIN all_runs USING (rid) LEFT JOIN stay USING (rid)"""


def _jumps(name: str, shards: int) -> str:
    """Recursive table (key, state, shard, hop) whose rows of hop >= shards hold each key's shard."""
    return f"""{name}(k, state, shard, hop) AS (
  SELECT k, CAST(k AS HUGEINT) + CASE WHEN k < 0 THEN 18446744073709551616 ELSE 0 END, CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM keys
  UNION ALL
  SELECT k, nxt, hop, CAST(floor((hop + 1) * ({JUMP_SCALE}.0::DOUBLE / CAST(nxt // {1 << SHIFT} + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT *, CAST((CAST(state AS UHUGEINT) * {MULTIPLIER} + 1) % 18446744073709551616 AS HUGEINT) AS nxt FROM {name} WHERE hop < {shards}))"""


SHARDING = f"""
WITH RECURSIVE tab AS {_REMAINDERS},
d AS (SELECT doc_id, coalesce(doc_id, 0) AS k, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS hexed FROM documents),
keys AS (SELECT DISTINCT k FROM d),
{_jumps("j", SHARDS)},
{_jumps("grown", SHARDS + 1)},
r AS (SELECT doc_id, k, CAST(strlen(text) + 1 AS BIGINT) AS size, CAST({_crc(_TEXT_BYTES)} AS BIGINT) AS text_crc32 FROM d, tab)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(j.shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY j.shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(grown.shard AS INTEGER) AS grown_shard
FROM r JOIN j ON r.k = j.k AND j.hop >= {SHARDS} JOIN grown ON r.k = grown.k AND grown.hop >= {SHARDS + 1}"""


def _vector_codes() -> str:
    near = """SELECT v.rid, v.part, arg_min(e.entry, (d.s, e.entry)) AS entry, min(d.s) AS error
  FROM v JOIN {book} e USING (part), LATERAL (SELECT list_sum(list_transform(range(len(v.x)),
    lambda i: CAST((v.x[i + 1] - e.x[i + 1]) * (v.x[i + 1] - e.x[i + 1]) AS HUGEINT))) AS s) d GROUP BY ALL"""
    ctes = [f"""good AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS rid, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""", f"v AS (SELECT rid, part, x[part * (len(x) // {PARTS}) + 1 : (part + 1) * (len(x) // {PARTS})] AS x FROM good, range({PARTS}) AS r(part))",
            f"b0 AS (SELECT part, rid AS entry, x FROM v WHERE rid < {ENTRIES})"]
    for k in range(ROUNDS):
        ctes += [f"n{k} AS ({near.format(book=f'b{k}')})", f"""m{k} AS (
  SELECT part, entry, list(CAST(CASE WHEN s % c < 0 THEN s // c - 1 ELSE s // c END AS BIGINT) ORDER BY i) AS x FROM (
    SELECT part, entry, i, sum(x[i + 1]) AS s, count(*) AS c FROM n{k} JOIN v USING (rid, part), LATERAL (SELECT unnest(range(len(x))) AS i)
    GROUP BY ALL) GROUP BY ALL
)""", f"b{k + 1} AS (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m USING (part, entry))"]
    ctes += [f"last AS ({near.format(book=f'b{ROUNDS}')})",
             "coded AS (SELECT rid, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, CAST(sum(error) AS BIGINT) AS error FROM last GROUP BY rid)",
             f"digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})"]
    return "WITH " + ",\n".join(ctes) + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM good JOIN coded USING (rid), digest"""


VECTOR_CODES = _vector_codes()
