"""The registered queries of this subpackage: opN_<name>(spark, sf_dir) over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.llm import chat, codes, language_model, repair, toxicity, warc
from hearsay.llm.decontaminate import contamination
from hearsay.llm.fingerprint import edit_likeness
from hearsay.llm.html_text import extract_text
from hearsay.llm.line_dedup import LEAST, MARKS, WIDE, drop_repeated_lines
from hearsay.llm.mixing import mix_sources
from hearsay.llm.near_dup import near_duplicates
from hearsay.llm.ngram_join import similar_documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).taken().select("doc_id", "size", "source_size", "target", "taken")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], said.schema)
    return chat.read_back(chat.format_chats(said.union(extra)))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_likeness(_table(spark, sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "text", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))


def op8_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.page_records(_table(spark, sf_dir, "pages")))
    fields = [F.col("headers")[k].alias(k.replace("-", "_")) for k in ("cache-control", "content-type", "etag", "last-modified")]
    return found.select("record_id", "url_key", "verdict", "response_id", *fields, F.octet_length("payload").cast("long").alias("n_bytes"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_repeated_lines(docs, counts=("n_lines", "n_removed"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Fitted on labelled rows whose crc32(doc_id as text) mod 3 is not 1."""
    seen = labels.where("crc32(cast(doc_id as string)) % 3 <> 1")
    return toxicity.fit_sample(toxicity.labelled_sample(docs, seen))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_model(docs, _table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", F.expr("coalesce(crc32(cast(doc_id as string)) % 3 = 1, false)").alias("held_out"), toxicity.toxicity_score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.expr("coalesce(crc32(cast(doc_id as string)) % 7 = 2, false)").alias("held_out"))
    model, counts = language_model.fit(docs.where("not held_out"))
    return language_model.score(docs, model, counts)


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(_table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, book = codes.compress(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return codes.label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(codes.codebook_digest(book)).alias("codebooks_sha256"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans, turns = repair.repair(repair.damage(_table(spark, sf_dir, "conversations")))
    digest = repair.digests(turns).select(F.col("conv_id").alias("c"), "repaired_sha256")
    out = plans.join(digest, plans["conv_id"].eqNullSafe(F.col("c")), "left").drop("c")
    return out.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)))


QUERIES = {"op1_mix": op1_mix, "op2_chat": op2_chat, "op4_fingerprint": op4_fingerprint, "op7_html": op7_html, "op8_revisits": op8_revisits, "op9_line_dedup": op9_line_dedup, "op10_language_model": op10_language_model, "op3_decontaminate": op3_decontaminate, "op5_minhash": op5_minhash, "op6_toxicity": op6_toxicity, "op11_ngram_join": op11_ngram_join, "op12_vector_codes": op12_vector_codes, "op13_repair": op13_repair}

_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

_SPACE = "chr(9) || chr(13)"
_MARKED = "x"
for _m in (*(f"{m} " for m in MARKS), *WIDE):
    _MARKED = f"replace({_MARKED}, '{_m}', '{_m}' || chr(64976))"
_H = "CAST('0x' || substring(md5(concat_ws(':', {})), 1, 15) AS BIGINT)"


def _shuffled(rounds: int) -> str:
    """The swap-or-not rounds as nested selects from slot(shard, rank, blocks, pass, x)."""
    out = "slot"
    for r in range(rounds):
        y = _H.format(f"'0k{r}', rank, pass")
        bit = _H.format(f"'0b{r}', rank, pass, greatest(x, y)")
        out = f"(SELECT rank, blocks, pass, CASE WHEN {bit} % 2 = 1 THEN y ELSE x END AS x FROM (SELECT *, ({y} % blocks + blocks - x) % blocks AS y FROM {out}))"
    return out


#: CRC-32 of k, bit by bit over its characters (ASCII).
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(k, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295)"


def _rounds(rounds: int) -> str:
    """Nearest entries and new codebooks of so many rounds, then the last assignment as near."""
    near = "SELECT x.rid, x.part, x.v, min((x.q - 2 * CAST(list_inner_product(x.d, b.d) AS BIGINT) + b.q) * 256 + b.entry) AS m FROM x JOIN book{} b USING (part) GROUP BY ALL"
    out = ""
    for r in range(rounds):
        out += f"""near{r} AS MATERIALIZED ({near.format(r)}),
sum{r} AS (SELECT part, m % 256 AS entry, pos, CAST(sum(c) AS BIGINT) AS s, count(*) AS n FROM (SELECT part, m, unnest(v) AS c, generate_subscripts(v, 1) AS pos FROM near{r}) GROUP BY ALL),
new{r} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS v FROM sum{r} GROUP BY ALL),
book{r + 1} AS MATERIALIZED (SELECT part, entry, v, CAST(v AS DOUBLE[]) AS d, CAST(list_inner_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[])) AS BIGINT) AS q FROM (SELECT b.part, b.entry, coalesce(n.v, b.v) AS v FROM book{r} b LEFT JOIN new{r} n ON n.part = b.part AND n.entry = b.entry)),
"""
    return out + f"near AS ({near.format(rounds)})"


def _reached(percent: int) -> str:
    """Shingle sets as s, and all documents that a document reaches over links as reach."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM w),
one AS (SELECT doc_id, unnest(s) AS x FROM s),
shared AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n FROM one p JOIN one q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * n >= {percent} * (len(p.s) + len(q.s) - n)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN link ON a = r)
"""


ORACLE_SQL = {
    "op12_vector_codes": f"""
WITH k AS (SELECT *, row_number() OVER (ORDER BY vec_id) AS rid, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
p AS (SELECT rid, part, w[part * len(w) // 4 + 1 : (part + 1) * len(w) // 4] AS v FROM k, range(4) t(part)),
x AS MATERIALIZED (SELECT rid, part, v, CAST(v AS DOUBLE[]) AS d, CAST(list_inner_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[])) AS BIGINT) AS q FROM p),
book0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, v, d, q FROM x WHERE rid <= 256),
{_rounds(4)},
c AS (SELECT rid, string_agg(lpad(lower(to_hex(m % 256)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM near GROUP BY rid),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN c USING (rid), h
""",
    "op13_repair": f"""
WITH RECURSIVE own AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kind AS (SELECT *, {_CRC} % 20 AS kind FROM own),
rows_after AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM kind, range(CASE WHEN kind = 3 THEN 2 ELSE 1 END) WHERE kind <> 0),
n AS (SELECT *, substring(role, 1, 1) AS f, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS z, row_number() OVER o AS i, lag(substring(role, 1, 1)) OVER o AS above FROM rows_after WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text))),
fault AS (SELECT *, CASE WHEN z = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN z NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM n),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (above IS NOT NULL AND above || f NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM fault GROUP BY conv_id),
move(p, r, ins, t) AS (VALUES (0, 's', '', 1), (0, 'u', '', 2), (1, 'u', '', 2), (3, 'u', '', 2), (2, 'u', 'a', 2), (2, 'a', '', 3), (0, 'a', 'u', 3), (1, 'a', 'u', 3), (3, 'a', 'u', 3), (0, '', '', 0), (1, '', '', 1), (2, '', '', 2), (3, '', '', 3)),
edit AS (SELECT conv_id, i, p, t,
    CASE WHEN r = '' THEN 3 ELSE len(ins) * 2 + CASE WHEN r = f THEN 0 ELSE 2 END + CASE WHEN fault = 3 THEN 1 ELSE 0 END END AS cost,
    CASE WHEN r = '' THEN 'D' ELSE CASE WHEN ins <> '' THEN 'I' ELSE '' END || CASE WHEN r = f THEN 'K' ELSE 'R' END END AS code,
    CASE WHEN r = '' THEN '' ELSE CASE ins WHEN 'u' THEN chr(10) || 'user:' WHEN 'a' THEN chr(10) || 'assistant:' ELSE '' END || chr(10) || CASE WHEN r = f THEN role WHEN r = 'u' THEN 'user' ELSE 'assistant' END || ':' || text END AS said
  FROM fault, move WHERE r = '' OR (fault NOT IN (1, 2) AND (r <> 's' OR f = 's'))),
dp AS (SELECT conv_id, 0::BIGINT AS i, 0 AS st, 0 AS cost, '' AS audit, '' AS said FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, i, st, cost, audit, said FROM (
    SELECT dp.conv_id, edit.i, edit.t AS st, dp.cost + edit.cost AS cost, dp.audit || edit.code AS audit, dp.said || edit.said AS said, row_number() OVER (PARTITION BY dp.conv_id, edit.t ORDER BY dp.cost + edit.cost, dp.audit || edit.code) AS best
    FROM dp JOIN edit ON edit.conv_id IS NOT DISTINCT FROM dp.conv_id AND edit.i = dp.i + 1 AND edit.p = dp.st) WHERE best = 1),
ended AS (SELECT dp.conv_id, cost + CASE st WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END AS cost, audit || CASE st WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS audit,
    said || CASE st WHEN 1 THEN chr(10) || 'user:' || chr(10) || 'assistant:' WHEN 2 THEN chr(10) || 'assistant:' ELSE '' END AS said
  FROM dp LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM dp.conv_id WHERE i = coalesce(n, 0)),
best AS (SELECT * FROM ended QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1)
SELECT b.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
  CAST(cost AS BIGINT) AS cost, audit, sha256(substring(said, 2)) AS repaired_sha256
FROM best b LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM b.conv_id
""",
    "op1_mix": f"""
WITH size AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s1 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM size GROUP BY source),
s2 AS (SELECT *, (rank - 1) % 3 + 1 AS weight, source_size * 3 AS most, CAST(source_size * 3 AS DOUBLE) / ((rank - 1) % 3 + 1) AS full_at FROM s1),
s3 AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY full_at, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
  / CAST(sum(weight) OVER (ORDER BY full_at, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS l FROM s2),
s4 AS (SELECT *, max(CASE WHEN full_at > l THEN l END) OVER () AS level FROM s3),
s5 AS (SELECT source, rank, source_size, CASE WHEN full_at > level THEN weight * level ELSE CAST(most AS DOUBLE) END AS target, CAST(ceil(source_size / 128) AS BIGINT) AS blocks FROM s4),
src AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target * blocks / source_size + 0.5) AS BIGINT) ELSE 0 END AS slots FROM s5),
cum AS (SELECT *, CAST(sum(slots) OVER (ORDER BY rank) AS BIGINT) AS high, CAST(sum(slots) OVER () AS BIGINT) AS n, CAST(ceil(sum(slots) OVER () / 4096) AS BIGINT) AS shards FROM src),
draw AS (SELECT g // 4096 AS shard, {_H.format("'0', g // 4096, g % 4096")} % (SELECT max(n) FROM cum) AS u FROM range((SELECT max(n) FROM cum)) t(g)),
drawn AS (SELECT shard, rank, count(*) AS drawn FROM draw JOIN cum ON u >= high - slots AND u < high GROUP BY 1, 2),
g1 AS (SELECT rank, blocks, slots, shards, unnest(range(shards)) AS shard FROM cum WHERE slots > 0),
g2 AS (SELECT g1.*, coalesce(drawn, 0) AS drawn FROM g1 LEFT JOIN drawn USING (shard, rank)),
g3 AS (SELECT *, coalesce(sum(drawn) OVER (PARTITION BY rank ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen, greatest(0, slots - sum(drawn) OVER (PARTITION BY rank)) AS lack FROM g2),
g4 AS (SELECT *, CAST(greatest(0, least(drawn, slots - seen)) + (lack * (shard + 1)) // shards - (lack * shard) // shards AS BIGINT) AS take FROM g3),
g5 AS (SELECT *, CAST(coalesce(sum(take) OVER (PARTITION BY rank ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM g4),
g6 AS (SELECT rank, blocks, unnest(range(first, first + take)) AS k FROM g5),
slot AS (SELECT rank, blocks, k // blocks AS pass, k % blocks AS x FROM g6),
times AS (SELECT rank, x AS block, count(*) AS times FROM {_shuffled(6)} GROUP BY 1, 2),
d1 AS (SELECT size.*, rank, source_size, target, ((doc_id % parts) + parts) % parts AS part FROM (SELECT *, CAST(1021 * (1 + sum(size) OVER () // 8589934592) AS BIGINT) AS parts FROM size) size JOIN src ON size.source IS NOT DISTINCT FROM src.source),
d2 AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY rank ORDER BY part, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d1),
p AS (SELECT doc_id, rank, start, size, unnest(range(start // 128, (start + size - 1) // 128 + 1)) AS block FROM d2 WHERE size > 0),
t AS (SELECT doc_id, sum((least(start + size, (block + 1) * 128) - greatest(start, block * 128)) * times) AS taken FROM p JOIN times USING (rank, block) GROUP BY 1)
SELECT d2.doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM d2 LEFT JOIN t USING (doc_id)
""",
    "op2_chat": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
t AS (SELECT *, contains(text, '###') OR contains(text, '</turn>') AS esc FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
  CAST(sum(3 + length(role) + 3 + length(text) + 9 + CASE WHEN esc THEN 1 + 3 * length(text) - length(replace(text, '\', '')) - length(replace(text, '#', '')) - length(replace(text, '<', '')) ELSE 0 END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
""",
    "op8_revisits": """
WITH u AS (SELECT page_id, html, regexp_replace(trim(url), '#.*$', '') AS u FROM pages),
p AS (SELECT page_id, html, regexp_replace(regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), '^www[0-9]*[.]', ''), ':(80|443)$', '') AS host,
  regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', '') AS rest FROM u),
q AS (SELECT *, regexp_replace(regexp_replace(rest, '[?].*$', ''), '/+$', '') AS path,
  list_sort(list_filter(string_split(CASE WHEN contains(rest, '?') THEN regexp_replace(rest, '^[^?]*[?]', '') ELSE '' END, '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))) AS params FROM p),
k AS (SELECT page_id, html, host || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS url_key,
  '"' || substring(md5(coalesce(html, '')), 1, 16) || '"' AS tag, 'day ' || CAST(page_id // 100 AS VARCHAR) AS day FROM q),
r AS (SELECT k.page_id AS id, k.url_key, k.tag, k.day, max(o.page_id) AS stored FROM k LEFT JOIN k o ON o.url_key = k.url_key AND (o.page_id, o.page_id * 2) < (k.page_id + 500, k.page_id * 2 + 1) GROUP BY ALL),
v AS (SELECT r.*, o.tag AS otag, o.day AS oday, o.html AS body,
  CASE WHEN stored IS NULL THEN 'no response' WHEN CASE WHEN id % 5 = 0 THEN o.tag = '"other"' WHEN id % 7 = 0 THEN r.day = o.day ELSE r.tag = o.tag END THEN 'resolved' ELSE 'validators differ' END AS verdict
  FROM r LEFT JOIN k o ON o.page_id = stored)
SELECT id * 2 + 1 AS record_id, url_key, verdict, CASE WHEN verdict = 'resolved' THEN stored * 2 END AS response_id,
  CASE WHEN verdict = 'resolved' THEN 'max-age=120' END AS cache_control, CASE WHEN verdict = 'resolved' THEN 'text/html' END AS content_type,
  CASE WHEN verdict = 'resolved' THEN CASE WHEN id % 7 = 0 THEN otag ELSE 'W/' || tag END END AS etag,
  CASE WHEN verdict = 'resolved' THEN oday END AS last_modified, CASE WHEN verdict = 'resolved' THEN CAST(strlen(body) AS BIGINT) END AS n_bytes
FROM v
""",
    "op9_line_dedup": f"""
WITH x AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents),
y AS (SELECT doc_id, line, CASE WHEN x = '' THEN [''] ELSE list_filter(string_split({_MARKED}, chr(64976)), lambda y: y <> '') END AS y FROM x),
p AS (SELECT doc_id, line, unnest(y) AS p, generate_subscripts(y, 1) AS part FROM y),
n AS (SELECT doc_id, line, p, trim(translate(p, {_SPACE}, '  ')) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY line, part) AS i, count(*) OVER (PARTITION BY doc_id, line) > 1 AS cut FROM p),
w AS (SELECT doc_id, i, t AS t1, lead(t) OVER o AS t2, lead(t, 2) OVER o AS t3, cut OR lead(cut) OVER o OR lead(cut, 2) OVER o AS cut FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT doc_id, i, t1 || chr(10) || t2 || chr(10) || t3 AS k FROM w WHERE t3 IS NOT NULL AND (t1 <> '' OR t2 <> '' OR t3 <> '') AND (NOT cut OR strlen(t1) + strlen(t2) + strlen(t3) >= {LEAST})),
r AS (SELECT doc_id, i FROM k QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
c AS (SELECT DISTINCT doc_id, i + j AS i FROM r, (VALUES (0), (1), (2)) v(j)),
d AS (SELECT n.*, c.i IS NOT NULL AS gone FROM n LEFT JOIN c ON c.doc_id = n.doc_id AND c.i = n.i),
e AS (SELECT *, lag(line) OVER (PARTITION BY doc_id, gone ORDER BY i) AS above FROM d),
o AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(CASE WHEN line <> above THEN chr(10) ELSE '' END || p, '' ORDER BY i) FILTER (NOT gone), '') AS text FROM e GROUP BY doc_id)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5 FROM o
""",
    "op5_minhash": f"{_reached(75)}SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r) AS component_id, s.doc_id = min(r) AS kept\nFROM s JOIN reach USING (doc_id) GROUP BY s.doc_id, len(s.s)",
    "op11_ngram_join": f"{_reached(80)}SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r) AS component_id\nFROM s JOIN reach USING (doc_id) GROUP BY s.doc_id, len(s.s)",
}
