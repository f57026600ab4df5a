"""The registered query of each operator over its whole table, and its DuckDB form where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, conversation_repair, decontamination, language_id, lexical_search, licence_scan, near_dedup, quality_classifier, secret_scan, source_mixing, warc_zip
from . import line_dedup as lines
from . import quality_rules as rules

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PLANTED = "\\### Assistant: </turn> ok"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisits say their payload's length and digest themselves; responses are measured and their digest is made anew."""
    records = warc_zip.read_records(warc_zip.write_archives(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """only_failure: the one rule of the policy that a document fails, if it is one: what an ablation of it would keep."""
    out = rules.apply_policy(rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))
    only = F.coalesce(*[F.when(F.col("failed") == rules.mask((r,)), F.lit(r)) for r in rules.POLICIES["v2"]])
    base = F.col("fail_bits").bitwiseAND(F.lit(rules.mask("base")).cast("long")) != 0
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "fail_bits", only.alias("only_failure"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    extra = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat_format.read_back(chat_format.format_conversations(rows, tokenizer))
    return out.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.near_classes(table(spark, sf_dir, "documents"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan.scan(table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shards: epoch:shard of each draw that takes the document."""
    out = source_mixing.mix_documents(table(spark, sf_dir, "documents"))
    shards = F.array_join(F.transform("draws", lambda d: F.concat_ws(":", d["epoch"], d["shard"])), ";")
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", shards.alias("shards"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", "kind", "value_sha256", "label", "score", "is_secret")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.evaluate(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversation_repair.damage(rows), rows)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_line_dedup": op2_line_dedup,
    "op3_warc": op3_warc,
    "op4_quality_rules": op4_quality_rules,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_near_dedup": op7_near_dedup,
    "op8_licence_scan": op8_licence_scan,
    "op9_source_mixing": op9_source_mixing,
    "op10_secret_scan": op10_secret_scan,
    "op11_language_id": op11_language_id,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_lexical_search": op13_lexical_search,
}

_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_ESC = "replace(replace({}, '\\', '\\\\'), '<|', '<\\|')"

ORACLES = {
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS sha FROM pages),
        f AS (SELECT sha, min(page_id) AS first FROM p GROUP BY sha)
        SELECT page_id, strlen(h) AS payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 ((('0x' || substr(p.sha, 5 * (i // 4) + 1, 5))::INT >> (15 - 5 * (i % 4)))::INT & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to, CASE WHEN page_id = first THEN true END AS digest_ok
        FROM p JOIN f USING (sha)""",
    "op5_chat_formatting": f"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\\### Assistant: </turn> ok')
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(23 + length({_ESC.format('role')}) + length({_ESC.format('text')}))::BIGINT AS formatted_chars
        FROM c GROUP BY conv_id""",
    "op7_near_dedup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS sh FROM (
          SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 80 * (a.n + b.n - i)),
        r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id)
        SELECT r.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(c) AS component_id, r.doc_id = min(c) AS kept
        FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id""",
    "op8_licence_scan": licence_scan.oracle(),
    "op12_conversation_repair": """
        WITH RECURSIVE named AS (
          SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
        coded AS (
          SELECT *, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, length(name) + 1), lambda i: ord(name[i]))),
                   lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS h FROM named),
        damaged AS (
          SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
                 CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
          FROM coded WHERE h <> 0),
        placed AS (
          SELECT *, row_number() OVER w AS i, lag(left(role, 1)) OVER w || left(role, 1) AS pair,
                 row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS times
          FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
        faulty AS (
          SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN times > 1 THEN 'd'
                         WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') THEN 't' ELSE '' END AS fault FROM placed),
        counted AS (
          SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
                 count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
          FROM faulty GROUP BY conv_id),
        inserts(p, q, paid, letters, lines) AS (VALUES
          (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 3, 'I', ['user:']), (1, 2, 3, 'I', ['user:']),
          (3, 2, 3, 'I', ['user:']), (2, 3, 3, 'I', ['assistant:']), (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 3, 6, 'II', ['user:', 'assistant:'])),
        moves(p, letter, c, q) AS (VALUES
          (0, 'D', '', 0), (1, 'D', '', 1), (2, 'D', '', 2), (3, 'D', '', 3), (0, 'K', 's', 1), (0, 'K', 'u', 2), (1, 'K', 'u', 2), (2, 'K', 'a', 3),
          (3, 'K', 'u', 2), (0, 'R', 'u', 2), (1, 'R', 'u', 2), (2, 'R', 'a', 3), (3, 'R', 'u', 2)),
        path AS (
          SELECT conv_id, 0::BIGINT AS i, 0 AS q, 0 AS cost, '' AS audit, []::VARCHAR[] AS lines FROM counted
          UNION ALL
          SELECT conv_id, i, q, cost, audit, lines FROM (
            SELECT p.conv_id, f.i, m.q, p.cost + n.paid + CASE WHEN letter = 'D' THEN 4 ELSE CASE letter WHEN 'R' THEN 3 ELSE 0 END + CASE fault WHEN 't' THEN 3 ELSE 0 END END AS cost,
                   p.audit || n.letters || m.letter AS audit,
                   list_concat(list_concat(p.lines, n.lines), CASE letter WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text]
                     ELSE [CASE m.c WHEN 'u' THEN 'user:' ELSE 'assistant:' END || f.text] END) AS lines
            FROM path p JOIN faulty f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = p.i + 1 JOIN inserts n ON n.p = p.q
              JOIN moves m ON m.p = n.q AND (letter = 'D' OR fault NOT IN ('b', 'd')) AND (letter <> 'K' OR m.c = left(f.role, 1)))
          QUALIFY row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) = 1),
        closed AS (
          SELECT c.conv_id, gaps, blank, duplicate, truncated, illegal, p.cost + n.paid AS cost, p.audit || n.letters AS audit,
                 sha256(array_to_string(list_concat(p.lines, n.lines), chr(10))) AS repaired_sha256
          FROM counted c JOIN path p ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.i = c.n JOIN inserts n ON n.p = p.q AND n.q IN (0, 3)
          QUALIFY row_number() OVER (PARTITION BY c.conv_id ORDER BY p.cost + n.paid, p.audit || n.letters) = 1)
        SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
               coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
               coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN closed b ON a.conv_id IS NOT DISTINCT FROM b.conv_id""",
    "op13_lexical_search": f"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_TERM}') AS ts FROM documents),
        g AS (SELECT count(*)::BIGINT AS docs, sum(len(ts))::BIGINT AS terms FROM d WHERE len(ts) > 0),
        p AS (SELECT row, doc_id, len(ts)::BIGINT AS n, unnest(ts) AS term FROM d),
        c AS (SELECT row, doc_id, n, term, count(*)::BIGINT AS tf FROM p GROUP BY ALL),
        w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM c, g GROUP BY term),
        q AS (SELECT item_id, text, unnest(regexp_extract_all({_LOW.format("text")}, '{_TERM}')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
        s AS (SELECT item_id, text, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms))))::BIGINT AS score
              FROM q JOIN c USING (term) JOIN w USING (term), g GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS FIRST, row)::INT AS rank FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20""",
    "op2_line_dedup": f"""
        WITH l AS (
          SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                 generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        k AS (SELECT *, trim({_LOW.format('line')}, {_WS}) AS key FROM l),
        o AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
        m AS (SELECT k.*, o.keeper IS NOT NULL AND o.keeper <> doc_id AS gone FROM k LEFT JOIN o USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op4_quality_rules": """
        WITH w AS (
          SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        g AS (
          SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: [ws[i], ws[i+1], ws[i+2]])) AS tri
          FROM w WHERE len(ws) >= 3),
        r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, tri) AS c FROM g) WHERE c > 1),
        n AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
        d AS (
          SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM w),
        m AS (
          SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
                 length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                 (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines
          FROM w JOIN d USING (doc_id) LEFT JOIN n USING (doc_id)),
        b AS (
          SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
                    + 8 * (word_chars < 3 * n_words OR word_chars > 15 * n_words)::BIGINT + 16 * (100 * n_dup_lines > 30 * n_lines)::BIGINT
                    + 32 * (n_words > 1000000)::BIGINT AS fail_bits FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 15) = 0 AS kept, fail_bits,
               CASE fail_bits & 15 WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_words' WHEN 4 THEN 'symbols' WHEN 8 THEN 'word_length' END AS only_failure FROM b""",
}
