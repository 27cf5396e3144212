"""The registered queries: each operator over its whole table, and their SQL where it can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shortlist.llm.common import table, with_row_id


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shortlist.llm.substring import substring_dedup
    docs = table(spark, sf_dir, "documents")
    got = substring_dedup(docs, window=35, digest_only=True)
    return (with_row_id(docs.select("doc_id")).join(got, "rid")
            .select("doc_id", "n_words", "n_removed", "kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shortlist.llm.toxicity import held_out, score
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = score(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shortlist.llm.chat import rotate
    return rotate(table(spark, sf_dir, "conversations"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shortlist.llm.ann import nearest
    return nearest(table(spark, sf_dir, "embeddings"), k=20, query_every=20)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from shortlist.llm.tokencount import count_tokens
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op6_direct_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from shortlist.llm.dac import read_ids, write_ids
    files = write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_ids(files, digest=True).withColumnRenamed("id", "doc_id")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from shortlist.llm.bpe import encode
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("word_bpe_49k.json"), digest=True)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shortlist.llm.simhash import near_duplicates
    got = near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return got.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      "component_id")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shortlist.llm.decontam import decontaminate, digest
    docs = table(spark, sf_dir, "documents")
    got = digest(decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10))
    return with_row_id(docs.select("doc_id")).join(got, "rid").drop("rid")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shortlist.llm.common import store
    from shortlist.llm.warc import assemble, read_records, write_captures
    files = write_captures(table(spark, sf_dir, "pages"), min_bytes=0)
    pages = assemble(store(read_records(files, payloads=False), "records")).select(
        "record_id", F.element_at(F.col("metadata")[0]["fields"], "page-id").cast("bigint").alias("page_id"), "capture")
    named = pages.select("record_id", "page_id")
    return pages.join(named.select(F.col("record_id").alias("of"), F.col("page_id").alias("refers_to")),
                      F.coalesce("capture.refers_to", "record_id") == F.col("of"), "left").select(   # no null keys in one task
        "page_id", "capture.payload_bytes", "capture.payload_digest", F.col("capture.type").alias("record_type"),
        F.when(F.col("capture.type") == "revisit", F.col("refers_to")).alias("refers_to"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shortlist.llm.minhash import near_duplicates
    got = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)
    return got.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shortlist.llm.merkle import manifest
    got = manifest(table(spark, sf_dir, "documents"), tampered={"text": F.replace("text", F.lit("\n"), F.lit(""))},
                   when=F.crc32(F.col("doc_id").cast("string")) % 2 == 0)
    return got.withColumnRenamed("id", "doc_id")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shortlist.llm.periodic import periodic_runs
    got = periodic_runs(table(spark, sf_dir, "documents"), least=12, planted=True, texts=False)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    return got.withColumn("best", best).select(
        F.col("id").alias("doc_id"), F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.s")).alias("start"),
        F.col("best.n").alias("length"), (-F.col("best.q")).alias("period"),
        F.expr("best.n * 1000 div -best.q").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_toxicity, op3_chat, op4_ann, op5_token_counts, op6_direct_codes,
                                  op7_bpe, op8_simhash,
                                  op9_decontaminate, op10_warc, op11_minhash, op12_merkle, op13_periodic_runs)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

def _field_sql(name: str, value: str | None = None) -> str:
    text = f"({value or name})::VARCHAR"
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen({text})::VARCHAR || ':' || {text} END"


def _leaf_sql(text: str) -> str:
    parts = [_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars")] + [_field_sql("text", text)]
    return f"sha256({' || '.join(parts)})"


#: crc32 of a decimal number, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
    lambda crc, c: list_reduce(range(8), lambda a, i: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END), xor(crc, c)),
    4294967295::BIGINT))"""

ORACLE_SQL: dict[str, str] = {
    "op11_minhash": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                               'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
             s AS (SELECT DISTINCT doc_id, array_to_string(words[pos:pos + 2], ' ') AS gram
                   FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 1) + 1)) AS pos FROM w WHERE len(words) > 0)),
             n AS (SELECT doc_id, count(*) AS size, sha256(string_agg(gram, chr(10) ORDER BY gram)) AS whole FROM s GROUP BY doc_id),
             c AS (SELECT whole, any_value(size) AS size, min(doc_id) AS rep FROM n GROUP BY whole),
             g AS (SELECT s.doc_id AS rep, gram, size FROM s JOIN c ON s.doc_id = c.rep),
             b AS (SELECT x.rep AS l, y.rep AS r, count(*) AS common FROM g x JOIN g y ON x.gram = y.gram AND x.rep < y.rep
                   WHERE 100 * least(x.size, y.size) >= 85 * greatest(x.size, y.size) GROUP BY ALL),
             e AS (SELECT l, r FROM b JOIN c x ON l = x.rep JOIN c y ON r = y.rep WHERE 100 * common >= 85 * (x.size + y.size - common)),
             ways AS (SELECT l, r FROM e UNION SELECT r, l FROM e),
             walk AS (SELECT rep AS node, rep AS root FROM c
                      UNION
                      SELECT r, root FROM walk JOIN ways ON node = l WHERE root < r),
             least_of AS (SELECT node, min(root) AS root FROM walk GROUP BY node)
        SELECT w.doc_id, coalesce(n.size, 0) AS n_shingles, coalesce(m.root, w.doc_id) AS component_id,
               w.doc_id = coalesce(m.root, w.doc_id) AS kept
        FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN c ON n.whole = c.whole LEFT JOIN least_of m ON c.rep = m.node""",
    "op12_merkle": f"""
        WITH RECURSIVE leaves AS (
               SELECT doc_id, {_leaf_sql('text')} AS leaf,
                      CASE WHEN {_CRC32} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} END AS tampered,
                      dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t,
                      row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i,
                      count(*) OVER (PARTITION BY source) AS n FROM documents),
             low AS (SELECT t, 0 AS lev, i, leaf AS d, n FROM leaves
                     UNION ALL
                     SELECT t, lev + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (n + 2) // 3
                     FROM low WHERE n > 1 GROUP BY t, lev, i // 3, n),
             tops AS (SELECT t, d, lev FROM low WHERE n = 1),
             high AS (SELECT 0 AS lev, t AS i, d, (SELECT count(*) FROM tops) AS n FROM tops
                      UNION ALL
                      SELECT lev + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (n + 2) // 3
                      FROM high WHERE n > 1 GROUP BY lev, i // 3, n),
             low_by AS (SELECT a.t, a.lev, a.i, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
                               coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
                        FROM low a JOIN low b ON a.t = b.t AND a.lev = b.lev AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY ALL),
             high_by AS (SELECT a.lev, a.i, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
                                coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
                         FROM high a JOIN high b ON a.lev = b.lev AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY ALL),
             inner_fold AS (SELECT doc_id, t, i, 0 AS lev, coalesce(tampered, leaf) AS d, '' AS proof FROM leaves
                            UNION ALL
                            SELECT f.doc_id, f.t, f.i // 3, f.lev + 1, sha256(b.l || f.d || b.r), f.proof || b.l || b.r
                            FROM inner_fold f JOIN low_by b ON f.t = b.t AND f.lev = b.lev AND f.i = b.i),
             outer_fold AS (SELECT f.doc_id, f.t AS i, 0 AS lev, f.d, f.proof FROM inner_fold f JOIN tops USING (t, lev)
                            UNION ALL
                            SELECT f.doc_id, f.i // 3, f.lev + 1, sha256(b.l || f.d || b.r), f.proof || b.l || b.r
                            FROM outer_fold f JOIN high_by b ON f.lev = b.lev AND f.i = b.i),
             root AS (SELECT d, lev FROM high WHERE n = 1)
        SELECT doc_id, leaf, tops.d AS subroot, root.d AS root, sha256(proof) AS proof_sha256, f.d AS folded_root,
               f.d = root.d AS verified
        FROM outer_fold f JOIN root ON f.lev = root.lev JOIN leaves USING (doc_id) JOIN tops ON leaves.t = tops.t""",
    "op3_chat": r"""
        WITH r AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
             p AS (SELECT DISTINCT conv_id AS c, role AS perspective FROM r WHERE role <> 'system'),
             s AS (SELECT conv_id, perspective, turn, role, text,
                          CASE WHEN role = 'system' THEN 'system' WHEN role = perspective THEN 'assistant' ELSE 'user' END AS chat_role,
                          CASE WHEN role <> 'system' AND role <> perspective THEN role END AS name
                   FROM r JOIN p ON r.conv_id IS NOT DISTINCT FROM p.c),
             h AS (SELECT *, '<|im_start|>' || chat_role || coalesce(' name=' || name, '') || chr(10) AS head FROM s),
             t AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS rendered FROM h),
             o AS (SELECT *, row_number() OVER w AS seq,
                          (sum(length(rendered)) OVER (w ROWS UNBOUNDED PRECEDING))::BIGINT AS char_end FROM t
                   WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, text))
        SELECT conv_id, perspective, seq, chat_role, name, rendered, char_end - length(rendered) AS char_start, char_end,
               CASE WHEN chat_role = 'assistant' THEN char_end - length(rendered) + length(head) END AS loss_start,
               CASE WHEN chat_role = 'assistant' THEN char_end END AS loss_end
        FROM o""",
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
             d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hex,
                          row_number() OVER (PARTITION BY body ORDER BY page_id) AS nth,
                          first_value(page_id) OVER (PARTITION BY body ORDER BY page_id) AS first_id FROM p)
        SELECT page_id, payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   ((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)),
                   'string_agg', '') AS payload_digest,
               CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN nth > 1 THEN first_id END AS refers_to
        FROM d""",
    "op1_substring_dedup": f"""
        WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
             s AS (SELECT doc_id, unnest(range(1, len(words) - 33)) AS pos, words FROM w WHERE len(words) >= 35),
             k AS (SELECT doc_id, pos, array_to_string(words[pos:pos + 34], ' ') AS win FROM s),
             d AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY win) AS n FROM k),
             gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 35)) AS pos FROM d WHERE n > 1),
             marks AS (SELECT doc_id, list(pos) AS gone FROM gone GROUP BY doc_id)
        SELECT w.doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed,
               sha256(array_to_string(list_filter(words, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' ')) AS kept_sha256
        FROM w LEFT JOIN marks ON w.doc_id = marks.doc_id""",
    "op9_decontaminate": r"""
        WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
             bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
             bs AS (SELECT item_id, words, least(len(words), 10) AS size,
                           unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS pos FROM bw WHERE len(words) > 0),
             bwin AS (SELECT DISTINCT item_id::VARCHAR AS item, size, array_to_string(words[pos:pos + size - 1], ' ') AS win FROM bs),
             sizes AS (SELECT DISTINCT size FROM bwin),
             ds AS (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS pos
                    FROM dw, sizes WHERE len(words) >= size),
             dwin AS (SELECT doc_id, size, pos, array_to_string(words[pos:pos + size - 1], ' ') AS win FROM ds),
             hits AS (SELECT doc_id, pos, dwin.size, item FROM dwin JOIN bwin ON dwin.win = bwin.win AND dwin.size = bwin.size),
             n_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
                       FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS p FROM hits) GROUP BY doc_id),
             items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
                       FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
        SELECT dw.doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN n_hit ON dw.doc_id = n_hit.doc_id LEFT JOIN items ON dw.doc_id = items.doc_id""",
}
