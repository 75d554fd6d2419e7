"""The registered queries of the text operators, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystar.llm import (
    chat, exact_dedup, line_runs, mixing, packing, quality, ranked, repeats, simhash, suffix_tree, urls, variants, warc,
)
from tallystar.queries.tables import Query, table
from tallystar.session import scratch_path


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"), shingle=4, distance=4)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.plan(docs).select(
        F.col(f"c{docs.columns.index('doc_id')}").alias("doc_id"), "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"))


_OP2 = r"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
sources AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
    SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight FROM sources),
shared AS (
    SELECT *, ((SELECT sum(source_size) FROM sources)::BIGINT
               - coalesce(sum(3 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
              / (sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS share
    FROM weighed WINDOW w AS (ORDER BY 3 * source_size / weight::DOUBLE, source IS NULL, source)),
level AS (
    SELECT first(share ORDER BY 3 * source_size / weight::DOUBLE, share) AS share
    FROM shared WHERE 3 * source_size >= share * weight),
targets AS (
    SELECT source, source_size,
           coalesce(least((3 * source_size)::DOUBLE, (SELECT share FROM level) * weight), 0.0) AS target FROM shared),
rates AS (
    SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
           CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate
    FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       size * (floor(rate)::BIGINT + (('0x' || substr(md5('mix/' || coalesce(doc_id::VARCHAR, '') || '/' || coalesce(source, '')), 1, 12))::BIGINT
                             / 281474976710656.0 < rate - floor(rate))::BIGINT) AS taken
FROM rates
"""


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assign(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


_OP4 = r"""
WITH d AS (
    SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS content
    FROM documents),
g AS (
    SELECT content, count(*) AS group_size, first(doc_id ORDER BY n DESC, doc_id) AS keep_id FROM d GROUP BY content)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.content) AS text_sha256
FROM d JOIN g USING (content)
"""


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    trap = r"\### Assistant: </turn> ok"
    extra = spark.range(1).select(F.inline(F.array(*[F.struct(
        F.lit(-7).cast("long").alias("conv_id"), F.lit(turn).cast("long").alias("turn"), F.lit(role).alias("role"),
        F.lit(trap).alias("text")) for turn, role in enumerate(["user", "assistant"])])))
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    made = chat.format_examples(conversations)
    turns = F.array_join(F.transform(chat.read_turns(F.col("formatted")), lambda t: F.concat(
        F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = made.select(
        "conv_id", "turns", F.when(F.col("whole"), F.sha2(turns, 256)).alias("turns_sha256"),
        chat.loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("reply"),
        F.length("formatted").alias("chars"))
    replies = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turns", "reply"))), lambda r: r["reply"]), "")
    grouped = read.groupBy("conv_id").agg(
        F.max("turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), replies.alias("replies"),
        F.sum("chars").alias("formatted_chars"))
    return grouped.select("conv_id", "n_turns", "turns_sha256", F.length("replies").cast("long").alias("loss_chars"),
                          F.sha2("replies", 256).alias("loss_sha256"), "formatted_chars")


_OP5 = r"""
WITH rows AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text) AS pos,
           count(*) OVER (PARTITION BY conv_id) AS n,
           length(text) + len(regexp_extract_all(text, '[\\<>]')) + 15
           + coalesce(length(role) + len(regexp_extract_all(role, '[\\<>]')), 2) AS chars,
           coalesce(role = 'assistant', false) AS said
    FROM rows),
p AS (
    SELECT *, sum(CASE WHEN said OR pos = n THEN 1 ELSE 0 END) OVER (
        PARTITION BY conv_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS uses FROM t)
SELECT conv_id, max(n)::BIGINT AS n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       sum(CASE WHEN said THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (said), '')) AS loss_sha256,
       sum(uses * chars)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = urls.judge(pages, urls.labelled_urls(spark), RULES)
    return judged.select(F.col("c0").alias("page_id"), "host", "path", "rule", "verdict", "block_probability")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).drop("ids")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"))


def op9_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    removed = F.aggregate("runs", F.lit(0), lambda total, r: total + r["last"] - r["first"] + 1)
    return line_runs.mark(docs).select(
        F.col(f"c{docs.columns.index('doc_id')}").alias("doc_id"), "n_lines", F.size("runs").cast("long").alias("n_runs"),
        removed.cast("long").alias("n_removed"), F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


_OP9 = r"""
WITH every AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
spoken AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seq, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
    FROM every WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
windows AS (
    SELECT doc_id, seq, line, n, lead(line, 1) OVER w AS second, n + lead(n, 1) OVER w AS n_two, lead(line, 2) OVER w AS third
    FROM spoken WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
later AS (
    SELECT doc_id, seq, 1 AS lines FROM windows WHERE n > 50
    QUALIFY row_number() OVER (PARTITION BY line ORDER BY doc_id, seq) > 1
    UNION ALL
    SELECT doc_id, seq, 2 FROM windows WHERE second IS NOT NULL AND n_two > 50
    QUALIFY row_number() OVER (PARTITION BY line, second ORDER BY doc_id, seq) > 1
    UNION ALL
    SELECT doc_id, seq, 3 FROM windows WHERE third IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY line, second, third ORDER BY doc_id, seq) > 1),
covered AS (
    SELECT DISTINCT doc_id, seq + unnest(range(lines)) AS seq FROM later),
placed AS (
    SELECT e.doc_id, e.pos, e.line,
           last_value(s.seq IGNORE NULLS) OVER (PARTITION BY e.doc_id ORDER BY e.pos) AS before,
           first_value(s.seq IGNORE NULLS) OVER (PARTITION BY e.doc_id ORDER BY e.pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after
    FROM every e LEFT JOIN spoken s USING (doc_id, pos)),
flagged AS (
    SELECT p.*, a.seq IS NOT NULL AND b.seq IS NOT NULL AS gone FROM placed p
    LEFT JOIN covered a ON a.doc_id = p.doc_id AND a.seq = p.before LEFT JOIN covered b ON b.doc_id = p.doc_id AND b.seq = p.after),
edges AS (
    SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM flagged)
SELECT d.doc_id, count(e.pos) AS n_lines, count(*) FILTER (opens) AS n_runs, count(*) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM documents d LEFT JOIN edges e USING (doc_id) GROUP BY d.doc_id
"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = quality.judge(docs, table(spark, sf_dir, "labels"))
    return judged.select(F.col(f"c{docs.columns.index('doc_id')}").alias("doc_id"), *quality.NOTES)


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(table(spark, sf_dir, "documents")).select(
        "word", "form", "root", "n", "n_near", "form_n")


# The checksum folds the bytes of "<doc_id>:<run>" through a table that is made from the polynomial, bit by bit.
_OP11 = r"""
WITH RECURSIVE bits AS (
    SELECT range AS byte, range AS value, 0 AS step FROM range(256)
    UNION ALL
    SELECT byte, xor(value >> 1, CASE WHEN value & 1 = 1 THEN 3988292384 ELSE 0 END), step + 1 FROM bits WHERE step < 8),
folds AS (SELECT list(value ORDER BY byte) AS fold FROM bits WHERE step = 8),
runs AS (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
spelled AS (
    SELECT *, flatten(list_transform(list_transform(string_split(concat(doc_id, ':', run), ''), lambda c: unicode(c)::BIGINT),
        lambda u: CASE WHEN u < 128 THEN [u] ELSE [192 | (u >> 6), 128 | (u & 63)] END)) AS bytes FROM counted),
marked AS (
    SELECT run, n, xor(list_reduce(bytes, lambda crc, b: xor(crc >> 8, fold[xor(crc, b) % 256 + 1]), 4294967295), 4294967295) AS h
    FROM spelled, folds),
words AS (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2)
                ELSE run END AS word, sum(n)::BIGINT AS n
    FROM marked GROUP BY word HAVING length(word) >= 5 AND sum(n) >= 3),
cuts AS (
    SELECT DISTINCT word, n, place, substr(word, 1, place - 1) || substr(word, place + 1) AS rest
    FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS place FROM words)),
near AS (
    SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b USING (rest, place) WHERE a.word <> b.word
    UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.rest = w.word
    UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.rest = w.word),
best AS (
    SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS other, max(other_n) AS other_n
    FROM near GROUP BY word),
formed AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form,
           CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n
    FROM words w LEFT JOIN best USING (word)),
paths AS (
    SELECT word, word AS last, form AS next FROM formed
    UNION ALL
    SELECT p.word, f.word, f.form FROM paths p JOIN formed f ON p.next = f.word)
SELECT f.word, f.form, p.last AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN paths p ON p.word = f.word AND p.next IS NULL
"""


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_OP12 = r"""
WITH terms AS (
    SELECT doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
    FROM documents),
counted AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
sized AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counted GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM sized),
weighed AS (
    SELECT term, floor(1000 * ln((2 * max(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
    FROM counted, totals GROUP BY term),
asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
    FROM benchmark),
scored AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))))::BIGINT AS score
    FROM asked JOIN weighed USING (term) JOIN counted USING (term) JOIN sized USING (doc_id), totals
    GROUP BY item_id, doc_id HAVING score > 0)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scored QUALIFY rank <= 50
"""


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = scratch_path(spark, "archives")
    warc.write_archives(warc.page_records(pages), path)
    kind = pages.schema["page_id"].dataType
    return warc.read_archives(spark, path, payloads=False).select(
        F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))


_OP13 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""


QUERIES: dict[str, Query] = {
    "op1_simhash": Query(op1_simhash),
    "op2_mixing": Query(op2_mixing, _OP2),
    "op3_lm_score": Query(op3_lm_score),
    "op4_exact_dedup": Query(op4_exact_dedup, _OP4),
    "op5_chat_format": Query(op5_chat_format, _OP5),
    "op6_url_filter": Query(op6_url_filter),
    "op7_packing": Query(op7_packing),
    "op8_suffix_dedup": Query(op8_suffix_dedup),
    "op9_line_runs": Query(op9_line_runs, _OP9),
    "op10_quality": Query(op10_quality),
    "op11_variants": Query(op11_variants, _OP11),
    "op12_ranked_search": Query(op12_ranked_search, _OP12),
    "op13_warc": Query(op13_warc, _OP13),
}
