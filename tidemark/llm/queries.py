"""The registered queries of the corpus operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, html_text, mixing, quality, secrets, sharding, simhash, token_counts, topk
from .common import read


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(read(spark, sf_dir, "pages"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), each=True)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), columns=["doc_id"])
    return judged.select("row.doc_id", "verdict.*")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(read(spark, sf_dir, "documents"))


def op8_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.rotate(read(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("conv_id", "perspective", "part", "n_turns", "n_own", F.length("text").cast("long").alias("n_chars"), "text", spans.alias("mask"))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_byte_bpe, op2_html_text, op3_simhash, op4_mix, op5_quality, op6_top_k, op7_secrets, op8_perspectives, op9_shards, op10_token_counts)
    return {f.__name__: f for f in own}


#: op4: sources without a target take turns by their block numbers, the schedule is a recursion over slots for each kind of cycle; op6: every query against every row; op8: parts of 256 turns by their place, spans by running sums of lengths.
SQL = {
    "op4_mix": """
        WITH RECURSIVE p(target, parts) AS (VALUES ('src0', 6), ('src1', 3), ('src2', 3), ('src3', 2), ('src4', 2), ('', 14)),
             d AS (SELECT doc_id, coalesce('=' || source, '') AS own, CASE WHEN source IN ('src0', 'src1', 'src2', 'src3', 'src4') THEN source ELSE '' END AS target FROM documents),
             n AS (SELECT doc_id, target, own, parts, row_number() OVER (PARTITION BY target, own ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS nth FROM d JOIN p USING (target)),
             turns AS (SELECT target, own, k, row_number() OVER (PARTITION BY target ORDER BY k, own) - 1 AS block FROM (SELECT DISTINCT target, own, nth // 16 AS k FROM n)),
             r AS (SELECT doc_id, n.target, parts, block, nth % 16 AS place FROM n JOIN turns ON n.target = turns.target AND n.own = turns.own AND nth // 16 = k),
             s AS (SELECT target, parts, max(block) + 1 AS blocks FROM r GROUP BY target, parts),
             ends AS (SELECT DISTINCT unnest([0, blocks // parts, blocks // parts + 1]) AS first FROM s),
             kinds AS (SELECT first, lead(first) OVER (ORDER BY first) AS last FROM ends),
             m AS (SELECT first, last, target, CASE WHEN blocks // parts > first THEN parts WHEN blocks // parts = first THEN blocks % parts ELSE 0 END AS m FROM kinds, s WHERE last IS NOT NULL),
             q AS (SELECT first, last, CAST(sum(m) AS BIGINT) AS slots, list(target ORDER BY target) AS ts, list(CAST(m AS BIGINT) ORDER BY target) AS ms FROM m WHERE m > 0 GROUP BY first, last),
             starts AS (SELECT first, last, slots, CAST(sum((last - first) * slots) OVER (ORDER BY first) - (last - first) * slots AS BIGINT) AS start FROM q),
             edf AS (SELECT first, slots, ts, ms, list_transform(ms, lambda x: CAST(0 AS BIGINT)) AS done, CAST(-1 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS who FROM q
                     UNION ALL
                     SELECT first, slots, ts, ms, list_transform(range(1, len(ms) + 1), lambda j: done[j] + CASE WHEN j = pick THEN 1 ELSE 0 END), slot + 1, pick
                     FROM (SELECT *, list_min(list_transform(list_filter(range(1, len(ms) + 1), lambda i: done[i] < ms[i] AND done[i] * slots // ms[i] <= slot + 1),
                                                             lambda i: (((done[i] + 1) * slots + ms[i] - 1) // ms[i]) * 1000 + i)) % 1000 AS pick
                           FROM edf WHERE slot + 1 < slots)),
             taken AS (SELECT first, slot, ts[who] AS target, ms[who] AS m, row_number() OVER (PARTITION BY first, ts[who] ORDER BY slot) - 1 AS part FROM edf WHERE who > 0),
             b AS (SELECT doc_id, target, block, place, block // parts AS cycle, block % parts AS part FROM r)
        SELECT doc_id, nullif(b.target, '') AS target, block, start + (cycle - starts.first) * slots + slot AS slot, CAST(place AS INTEGER) AS place,
               start + (cycle - starts.first) * slots + part * slots // m AS release, start + (cycle - starts.first) * slots + ((part + 1) * slots + m - 1) // m AS deadline
        FROM b JOIN starts ON cycle >= starts.first AND cycle < starts.last JOIN taken USING (part, target) WHERE taken.first = starts.first
    """,
    "op6_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
                   FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
             r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op8_perspectives": r"""
        WITH rows_ AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
             said AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, text) - 1 AS nr FROM rows_),
             who AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
             p AS (SELECT w.conv_id, w.perspective, s.nr, s.nr // 256 AS part, s.speaker = w.perspective AS own,
                          CASE WHEN s.speaker = w.perspective THEN '<|assistant|>' WHEN s.speaker = 'system' THEN '<|system|>'
                               ELSE '<|user:' || replace(replace(replace(s.speaker, '<\', '<\\'), '<|', '<\|'), '|>', '|\>') || '|>' END
                          || chr(10) || replace(replace(s.text, '<\', '<\\'), '<|', '<\|') || '<|end|>' || chr(10) AS piece
                   FROM who w JOIN said s ON w.conv_id IS NOT DISTINCT FROM s.conv_id),
             a AS (SELECT *, sum(length(piece)) OVER (PARTITION BY conv_id, perspective, part ORDER BY nr ROWS UNBOUNDED PRECEDING) AS upto FROM p)
        SELECT conv_id, perspective, CAST(part AS BIGINT) AS part, CAST(count(*) AS INTEGER) AS n_turns, CAST(count(*) FILTER (own) AS INTEGER) AS n_own, CAST(sum(length(piece)) AS BIGINT) AS n_chars,
               string_agg(piece, '' ORDER BY nr) AS text,
               coalesce(string_agg(CAST(upto - length(piece) + 14 AS BIGINT) || ':' || CAST(upto AS BIGINT), ',' ORDER BY nr) FILTER (own), '') AS mask
        FROM a GROUP BY conv_id, perspective, part
    """,
}


def shards_sql() -> str:
    """op9: CRC-32 byte by byte from its table, the curve's automaton over five levels of three bits, ranks cut into runs."""
    digits, following = sharding.hilbert_steps(3)
    crc = lambda x: f"xor(list_reduce(regexp_extract_all(hex(encode({x})), '..'), lambda c, b: xor(c >> 8, crc[CAST(xor(c & 255, CAST('0x' || b AS BIGINT)) AS INTEGER) + 1]), 4294967295), 4294967295)"
    level = lambda b: f"((a >> {b}) & 1) + 2 * ((l >> {b}) & 1) + 4 * ((z >> {b}) & 1)"
    return f"""
        WITH RECURSIVE bits(i, c, k) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
             t AS (SELECT list(CAST(c AS BIGINT) ORDER BY i) AS crc FROM bits WHERE k = 8),
             d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex_crc AS text_crc32, source, lang, crc FROM (SELECT *, {crc("coalesce(text, '')")} AS hex_crc FROM documents, t)),
             c AS (SELECT doc_id, size, text_crc32, coalesce({crc("source")} % 32, 0) AS a, coalesce({crc("lang")} % 32, 0) AS l, least(length(bin(size)), 31) AS z FROM d),
             h AS (SELECT *, list_reduce([{", ".join(level(b) for b in range(4, -1, -1))}], lambda s, x: ((s // 24) * 8 + {digits}[CAST((s % 24) * 8 + x AS INTEGER) + 1]) * 24 + {following}[CAST((s % 24) * 8 + x AS INTEGER) + 1], CAST(0 AS BIGINT)) // 24 AS curve FROM c),
             r AS (SELECT *, row_number() OVER (ORDER BY curve, text_crc32, size, doc_id) - 1 AS rank, count(*) OVER () AS n FROM h)
        SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(rank * 16 // n AS INTEGER) AS shard,
               CAST(rank - ((rank * 16 // n) * n + 15) // 16 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, CAST(curve AS BIGINT) AS curve FROM r
    """


def oracle_sql() -> dict[str, str]:
    return SQL | {"op9_shards": shards_sql()}
