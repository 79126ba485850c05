"""Further registered queries; see queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hearsay.functions import models as md
from hearsay.functions import score as sc
from hearsay.functions import text as tx
from hearsay.functions import time as tm
from hearsay.operators import order as od
from hearsay.operators import queue as qu
from hearsay.plans import evidence as ev
from hearsay.plans import ingest
from hearsay.plans import reading as rd
from hearsay.queries import query, table


@query("""SELECT coalesce(o_orderstatus, '') AS status, count(*) AS n FROM orders GROUP BY 1""")
def a01_a09_status_counts(spark, sf):
    return table(spark, sf, "orders").groupBy(F.coalesce("o_orderstatus", F.lit("")).alias("status")).agg(F.count("*").alias("n"))


@query("""SELECT (SELECT count(*) FROM documents) AS posts, (SELECT count(*) FROM labels WHERE toxic = 1) AS toxic, (SELECT count(*) FROM events WHERE event_type = 'error') AS errors, (SELECT coalesce(max(o_orderkey), 0) FROM orders) AS last_order""")
def a02_a33_overview(spark, sf):
    d = table(spark, sf, "documents").agg(F.count("*").alias("posts"), F.max(F.lit(1)).alias("k"))
    t = table(spark, sf, "labels").agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.max(F.lit(1)).alias("k"))
    e = table(spark, sf, "events").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.max(F.lit(1)).alias("k"))
    o = table(spark, sf, "orders").agg(F.coalesce(F.max("o_orderkey"), F.lit(0)).alias("last_order"), F.max(F.lit(1)).alias("k"))
    return d.join(t, "k").join(e, "k").join(o, "k").drop("k")


@query("""SELECT p_brand, count(*) AS rows, list(p_retailprice ORDER BY p_retailprice)[count(*) // 2 + 1] AS median, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part GROUP BY 1""")
def a31_backfill_preview(spark, sf):
    price = "p_retailprice"
    return od.order_statistics(table(spark, sf, "part"), ["p_brand"], price, {"median": od.high_middle}, rows=F.sum("n"), low=F.min(price), high=F.max(price))


@query("""SELECT DISTINCT lower(c_mktsegment) AS word FROM customer WHERE length(c_mktsegment) BETWEEN 2 AND 9 AND NOT starts_with(c_mktsegment, 'A')""")
def a32_router_keywords(spark, sf):
    return table(spark, sf, "customer").where(F.length("c_mktsegment").between(2, 9) & ~F.startswith("c_mktsegment", F.lit("A"))).select(F.lower("c_mktsegment").alias("word")).distinct()


@query("""SELECT o_custkey AS run_id, CAST(sum(o_orderkey % 10) AS BIGINT) AS seen, CAST(sum(o_orderkey % 3) AS BIGINT) AS stored, arg_min(CASE WHEN o_orderstatus = 'F' THEN 'quota' END, CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS stop_reason, CASE WHEN count(*) FILTER (o_orderstatus = 'P') = 0 THEN 'success' WHEN sum(o_orderkey % 3) > 0 THEN 'partial' ELSE 'failed' END AS status FROM orders GROUP BY 1""")
def a34_a44_st05_run_totals(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_custkey run_id", "o_orderkey seq", "o_orderkey % 10 seen", "o_orderkey % 3 stored", "case when o_orderstatus = 'F' then 'quota' end reason", "int(o_orderstatus = 'P') failed")
    return qu.run_totals(o)


@query("""SELECT concern, count(*) AS n FROM (SELECT unnest(list_filter(['the', 'und', 'que'], lambda w: contains(text, w))) AS concern FROM documents) GROUP BY 1 ORDER BY n DESC, concern""")
def a40_concern_ranking(spark, sf):
    return table(spark, sf, "documents").select(F.explode(tx.word_hits(F.col("text"), ("the", "und", "que"))).alias("concern")).groupBy("concern").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "concern")


@query("""SELECT doc_id, array_to_string(list_filter(['Title: ' || trim(regexp_replace(substring(text, 1, 40), '\\s+', ' ', 'g')), 'Language: ' || lang, CASE WHEN source = 'src1' THEN NULL ELSE 'Source: ' || source END], lambda x: x IS NOT NULL), chr(10)) AS combined FROM documents""")
def p16_c18_combined_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.combined(("Title", F.substring("text", 1, 40)), ("Language", F.col("lang")), ("Source", F.when(F.col("source") != "src1", F.col("source")))).alias("combined"))


@query("""SELECT 'p' || row_number() OVER (ORDER BY n_chars DESC, doc_id)::VARCHAR AS cite_id, doc_id, substring(text, 1, 300) AS content FROM documents ORDER BY n_chars DESC, doc_id LIMIT 8""")
def p17_p18_p19_numbered_cards(spark, sf):
    d = table(spark, sf, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(8)
    return d.select(F.concat(F.lit("p"), F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")).cast("string")).alias("cite_id"), "doc_id", F.substring("text", 1, 300).alias("content"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice < 50000 THEN 0 WHEN o_orderstatus = 'F' THEN 1 WHEN o_totalprice < 50000 THEN 2 ELSE 3 END AS urgency FROM orders WHERE o_orderstatus = 'F' OR o_totalprice < 50000 ORDER BY urgency, o_orderkey LIMIT 50""")
def f16_candidate_priority(spark, sf):
    missing, late = F.col("o_orderstatus") == "F", F.col("o_totalprice") < 50000
    urgency = F.when(missing & late, 0).when(missing, 1).when(late, 2).otherwise(3)
    return table(spark, sf, "orders").where(missing | late).select("o_orderkey", urgency.alias("urgency")).orderBy("urgency", "o_orderkey").limit(50)


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('claimed', 'failed') OR (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')""")
def f17_reset_targets(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "failed").otherwise("done").alias("status"), F.col("o_orderpriority").alias("platform"))
    return qu.targets(o, claimed=True, failed=True, platform="1-URGENT").select("o_orderkey")


@query("""WITH l AS (SELECT max(ts) AS t FROM events) SELECT event_id FROM events, l WHERE event_type = 'view' AND (ts IS NULL OR ts >= t - INTERVAL 7 DAY)""")
def f20_f22_trailing_window(spark, sf):
    e = table(spark, sf, "events")
    last = e.agg(F.max("ts").alias("t"), F.first(F.lit(1)).alias("k"))
    own = e.where("event_type = 'view'").withColumn("k", F.lit(1)).join(F.broadcast(last), "k")
    return own.where("ts is null or ts >= t - interval 7 days").select("event_id")


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN TIMESTAMP '2024-03-10 12:00:00' WHEN 1 THEN TIMESTAMP '2024-03-10 11:55:00' WHEN 2 THEN TIMESTAMP '2024-03-07 12:00:00' WHEN 3 THEN TIMESTAMP '2024-03-09 08:05:00' WHEN 4 THEN TIMESTAMP '2023-12-24 00:00:00' END AS at FROM events""")
def c10_c55_relative_time(spark, sf):
    x = F.expr("CASE event_id % 6 WHEN 0 THEN '刚刚' WHEN 1 THEN '5分钟前' WHEN 2 THEN '3天前' WHEN 3 THEN '昨天 8:05' WHEN 4 THEN '12-24' ELSE 'soon' END")
    return table(spark, sf, "events").select("event_id", tm.relative_time(x, F.lit("2024-03-10 12:00:00").cast("timestamp")).cast("timestamp_ntz").alias("at"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN TIMESTAMP '2024-03-02 02:20:30' WHEN 1 THEN TIMESTAMP '2024-03-02 10:20:30' END AS mail, CASE event_id % 4 WHEN 0 THEN TIMESTAMP '2024-01-01 00:00:00' WHEN 1 THEN TIMESTAMP '2024-01-01 00:00:00' WHEN 2 THEN TIMESTAMP '2024-01-01 08:30:00' END AS published FROM events""")
def c08_c09_c12_parsed_times(spark, sf):
    mail = F.expr("CASE event_id % 3 WHEN 0 THEN 'Sat, 02 Mar 2024 10:20:30 +0800' WHEN 1 THEN 'Sat Mar 02 10:20:30 +0000 2024' ELSE 'x' END")
    pub = F.expr("CASE event_id % 4 WHEN 0 THEN '1704067200' WHEN 1 THEN '1704067200000' WHEN 2 THEN '2024/01/01 08:30' ELSE 'never' END")
    return table(spark, sf, "events").select("event_id", tm.mail_time(mail).cast("timestamp_ntz").alias("mail"), ingest.published_at(pub).cast("timestamp_ntz").alias("published"))


@query("""WITH a AS (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') AS d FROM orders) SELECT o_orderkey, CASE WHEN d <= 1 THEN 'day' WHEN d <= 7 THEN 'week' WHEN d <= 31 THEN 'month' WHEN d <= 92 THEN 'quarter' WHEN d <= 183 THEN 'half' WHEN d <= 366 THEN 'year' ELSE 'older' END AS bucket, CASE WHEN d < 1 THEN '今天' WHEN d < 30 THEN d::VARCHAR || '天前' WHEN d < 365 THEN (d // 30)::VARCHAR || '个月前' ELSE (d // 365)::VARCHAR || '年前' END AS shown FROM a""")
def c11_c52_c53_age_buckets(spark, sf):
    d = F.date_diff(F.lit("1998-08-02").cast("date"), F.to_date("o_orderdate"))
    return table(spark, sf, "orders").select("o_orderkey", tm.age_bucket(d).alias("bucket"), tm.shown_age(d).alias("shown"))


@query("""SELECT event_id, 'hot bath' AS clean, CASE WHEN event_id % 2 = 0 THEN '{"a": {"b": 1}}' END AS obj, CASE WHEN event_id % 2 = 0 THEN 'hot' ELSE 'uni cold' END AS word FROM events""")
def c17_c44_c47_noise_and_json(spark, sf):
    i = F.col("event_id")
    word = F.when(i % 2 == 0, "hot").otherwise("cold")
    return table(spark, sf, "events").select("event_id", tx.strip_noise(F.lit("#wash[话题]# hot @someone​ bath")).alias("clean"), tx.json_object(F.when(i % 2 == 0, 'so: {"a": {"b": 1}} end').otherwise("none")).alias("obj"), tx.keyword_with_topic(word, "uni", ["HOT"]).alias("word"))


@query("""SELECT page_id, CASE WHEN contains(url, 'page=') THEN '2' END AS page, CASE WHEN contains(html, '<article>') THEN 'parser_mismatch' ELSE 'other' END AS state FROM pages""")
def c49_c54_url_params_and_page_state(spark, sf):
    state = tx.search_page_state(F.col("html"), F.lit("zzzz"), "<article>", ["captcha"], ["nothing found"])
    return table(spark, sf, "pages").select("page_id", F.try_element_at(tx.url_params(F.col("url")), F.lit("page")).alias("page"), F.when(state == "parser_mismatch", state).otherwise("other").alias("state"))


@query("""SELECT event_id, least(greatest(0.5 + least(event_id % 20, 10) * 0.05, 0), 0.95)::DOUBLE AS confidence, CASE WHEN event_id % 3 = 0 THEN 'low' WHEN value >= 80 THEN 'high' WHEN value >= 50 THEN 'medium' ELSE 'low' END AS risk FROM events""")
def c36_c37_confidence_and_risk(spark, sf):
    i = F.col("event_id")
    return table(spark, sf, "events").select("event_id", sc.confidence(i % 20).cast("double").alias("confidence"), sc.stored_risk(F.when(i % 3 == 0, "low").otherwise(""), F.col("value")).alias("risk"))


@query("""SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, event_type AS label FROM events WHERE props LIKE '%k%'""")
def c32_z11_payload_getters(spark, sf):
    return table(spark, sf, "events").where(F.contains("props", F.lit("k"))).select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), F.coalesce(F.get_json_object("props", "$.label"), "event_type").alias("label"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'out_of_scope' WHEN 1 THEN 'needs_review' WHEN 2 THEN CASE WHEN url LIKE '%example.net%' THEN 'in_scope' ELSE 'needs_review' END ELSE CASE WHEN url LIKE '%example.net%' THEN 'in_scope' ELSE 'out_of_scope' END END AS scope FROM pages""")
def c24_z25_scope(spark, sf):
    policy = ev.Policy(["Some University"], "SU", ["example.net"], ["example.org"])
    i = F.col("page_id")
    kind = F.when(i % 4 == 1, "blog").otherwise("official_notice")
    quote = F.when(i % 4 == 0, " ").when(i % 4 == 2, "at Some University today").otherwise("our school")
    return table(spark, sf, "pages").select("page_id", ev.scope(kind, tx.host_of(F.col("url")), F.lit("t"), quote, policy).alias("scope"))


@query("""WITH t AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'claimed' END AS status, CAST(o_orderkey % 5 AS INT) AS priority, o_orderdate AS lease FROM orders), p AS (SELECT *, CASE WHEN status = 'claimed' AND lease < TIMESTAMP '1995-01-01' THEN 'pending' ELSE status END AS s FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY priority DESC, id) AS place FROM p) SELECT id, CASE WHEN s = 'pending' AND place <= 3 THEN 'claimed' ELSE s END AS status, CASE WHEN s = 'pending' AND place <= 3 THEN 'me' WHEN s = 'claimed' THEN 'old' END AS owner FROM r""")
def st03_o11_leased_queue(spark, sf):
    t = table(spark, sf, "orders").selectExpr("o_orderkey id", "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'claimed' END status", "int(o_orderkey % 5) priority", "cast(o_orderdate as timestamp) lease_until", "'old' owner")
    return qu.leased(t, F.lit("1995-01-01").cast("timestamp"), "me", 3).select("id", "status", "owner")


@query("""SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS fresh, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) = 0 AS caught_up""")
def st04_j15_caught_up(spark, sf):
    return qu.caught_up(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query()
def x01_s15_embedded(spark, sf):
    return table(spark, sf, "documents").select("doc_id", md.embedded(F.substring("text", 1, 256), md.hash_embedder()).alias("vector"))


@query("""SELECT doc_id, CASE WHEN contains(text, 'stupid') THEN 'negative' WHEN lang = 'en' THEN 'neutral' ELSE 'positive' END AS label FROM documents""")
def x02_classified_with_fallback(spark, sf):
    def classify(texts):
        return ["negative" if "stupid" in t else "nonsense" for t in texts]

    return table(spark, sf, "documents").select("doc_id", md.classified(F.col("text"), classify, ("positive", "neutral", "negative"), F.when(F.col("lang") == "en", "neutral").otherwise("positive")).alias("label"))


@query("""SELECT doc_id, CASE WHEN doc_id % 10 > 0 THEN source END AS answer, CASE WHEN doc_id % 10 = 0 THEN 'ValueError: no' END AS error FROM documents""")
def x09_calls_with_errors(spark, sf):
    def call(t):
        if t == "no":
            raise ValueError("no")
        return t

    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 0, "no").otherwise(F.col("source")).alias("t"))
    return md.mapped_calls(d, "doc_id", "t", call)


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'high' ELSE 'low' END AS level, CASE WHEN doc_id % 3 = 0 THEN 90.0 ELSE 5.0 END::DOUBLE AS score, CASE WHEN doc_id % 3 = 0 THEN 'model' ELSE 'rule' END AS source FROM documents""")
def x05_checked_risk(spark, sf):
    i = F.col("doc_id")
    level = F.when(i % 3 == 0, "high").when(i % 3 == 1, "huge")
    r = md.checked_risk(level, F.when(i % 3 == 2, 300.0).otherwise(90.0), F.array(F.lit("a")), F.lit("low"), F.lit(5.0))
    return table(spark, sf, "documents").select("doc_id", r.alias("r")).select("doc_id", "r.level", "r.score", "r.source")


@query("""SELECT doc_id AS id, CASE lang WHEN 'en' THEN 'publish' WHEN 'fr' THEN 'reject' ELSE 'hold' END AS answer FROM documents""")
def x11_prescreened(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang")
    told = d.where("lang <> 'es'").select("id", F.when(F.col("lang") == "en", "publish").when(F.col("lang") == "fr", "reject").otherwise("maybe").alias("answer"))
    return md.prescreened(told, d.select("id"))


@query("""SELECT user_id, list(strftime(ts, '%Y-%m-%d %H:%M:%S') ORDER BY ts) AS times FROM (SELECT DISTINCT user_id, date_trunc('hour', ts) AS ts FROM events) GROUP BY 1""")
def z01_member_times(spark, sf):
    own = table(spark, sf, "events").select("user_id", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("t")).distinct()
    return own.groupBy("user_id").agg(F.array_sort(F.collect_list(F.date_format("t", "yyyy-MM-dd HH:mm:ss"))).alias("times"))


@query("""WITH g AS (SELECT source, count(*) AS n, list_sort(list_distinct(list(lang))) AS l FROM documents GROUP BY 1) SELECT source, source || ': ' || n::VARCHAR || ' posts in ' || array_to_string(l[1:3], ', ') AS summary FROM g""")
def z02_event_summary(spark, sf):
    own = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("lang")).alias("l"))
    return own.select("source", F.concat("source", F.lit(": "), F.col("n").cast("string"), F.lit(" posts in "), F.array_join(F.slice("l", 1, 3), ", ")).alias("summary"))


@query("""SELECT count(*) AS matched, least(count(*), 300) AS analysed, greatest(count(*) - 300, 0) AS dropped FROM documents WHERE lang = 'en'""")
def z16_truncation_account(spark, sf):
    return rd.truncation(table(spark, sf, "documents").where("lang = 'en'"), 300)


@query("""SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0 AND o_orderkey % 2 = 0""")
def f15_z22_review_guard(spark, sf):
    """Items that may be delivered, in order: approved, in scope, and verified by their latest verification."""

    from hearsay.operators.relational import latest
    from hearsay.plans.evidence import eligible

    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("open").alias("review"), F.when(F.col("o_orderkey") % 3 == 0, "in_scope").otherwise("out_of_scope").alias("scope"))
    checks = o.select("id", F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.lit("verified").alias("verification")), F.struct(F.lit(2).alias("seq"), F.when(F.col("id") % 2 == 0, "verified").otherwise("rejected").alias("verification")))).alias("v")).select("id", "v.*")
    own = eligible(o.join(latest(checks, "id", "seq"), "id"))
    return od.global_places(own.select("id"), F.col("id"), [F.col("id")])


@query("""WITH m AS (SELECT d.source AS event_key, e.label AS target, count(*) AS n FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id WHERE e.vec_id % 3 = 0 GROUP BY ALL) SELECT target, arg_min(event_key, (-n, event_key)) AS event_key, max(n) AS shared FROM m GROUP BY 1""")
def z36_best_overlap(spark, sf):
    """For each set of target ids, the event that shares most of them."""
    members = table(spark, sf, "documents").select(F.col("source").alias("event_key"), F.col("doc_id").alias("note_id"))
    return rd.best_overlap(members, table(spark, sf, "embeddings").where("vec_id % 3 = 0").select(F.col("label").alias("target"), F.col("vec_id").alias("note_id")))


@query()
def c50_explored_selection(spark, sf):
    """Fifty documents, the longest first, of which every place is given to a random later one with a chance of a fifth."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return qu.explored(d, -F.col("n_chars"), [F.desc("n_chars"), F.col("doc_id")], 50, 0.2, 7)
