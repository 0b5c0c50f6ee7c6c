"""Conversations, feedback, document records."""
from pyspark.sql import functions as F

from docquarry.operators import apptables as A
from docquarry.registry.base import FILES, files, query, table

CONV = """cv AS (SELECT conv_id AS id, concat('u', conv_id % 5) AS user_id, text AS content, CAST(length(text) AS BIGINT) * 100000 + conv_id AS created_at FROM conversations WHERE turn = 0)"""


def conversations(spark, sf):
    return table(spark, sf, "conversations").filter("turn = 0").select(
        F.col("conv_id").alias("id"), F.concat(F.lit("u"), F.col("conv_id") % 5).alias("user_id"), F.col("text").alias("content"),
        (F.length("text").cast("long") * 100000 + F.col("conv_id")).alias("created_at"))


RECORDS = f"""{FILES}, dr AS (SELECT doc_id AS id, relative_path AS filename, source AS product_id, CASE WHEN doc_id % 10 = 0 THEN 'failed' WHEN doc_id % 3 = 0 THEN 'pending' ELSE 'completed' END AS status,
  n_chars * 100000 + doc_id AS created_at FROM files)"""


def records(spark, sf):
    return files(spark, sf).select(
        F.col("doc_id").alias("id"), F.col("relative_path").alias("filename"), F.col("source").alias("product_id"),
        F.expr("CASE WHEN doc_id % 10 = 0 THEN 'failed' WHEN doc_id % 3 = 0 THEN 'pending' ELSE 'completed' END").alias("status"),
        (F.col("n_chars") * 100000 + F.col("doc_id")).alias("created_at"))


@query("a01_recent_messages", """SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back BETWEEN 2 AND 7""")
def a01(spark, sf):
    return A.recent_messages(table(spark, sf, "conversations"))


@query("a02_conversation_list", f"""WITH {CONV} SELECT id, user_id, created_at, CASE WHEN length(content) > 50 THEN concat(left(content, 50), '...') ELSE content END AS title FROM cv ORDER BY created_at DESC, id""")
def a02(spark, sf):
    return A.conversation_list(conversations(spark, sf))


@query("a03_document_list", f"WITH {RECORDS} SELECT * FROM dr WHERE product_id = 'src3' AND status = 'completed' ORDER BY created_at DESC, id")
def a03(spark, sf):
    return A.document_list(records(spark, sf), "src3", "completed")


@query("a04_document_search", f"WITH {RECORDS} SELECT * FROM dr WHERE contains(lower(filename), 'policy') OR contains(lower(status), 'policy')")
def a04(spark, sf):
    return A.document_search(records(spark, sf), "POLICY")


FEEDBACK = """ms AS (SELECT conv_id * 1000 + turn AS message_id, conv_id AS conversation_id, role, text, turn AS created_at FROM conversations),
fb AS (SELECT event_id AS feedback_id, event_id % (SELECT max(message_id) + 5 FROM ms) AS message_id, concat('u', user_id % 5) AS user_id, event_type AS rating, props AS comment, ts AS created_at FROM events)"""
OWNED = """ow AS (SELECT message_id, concat('u', conversation_id % 5) AS user_id FROM ms)"""
LATEST = f"""{FEEDBACK}, {OWNED}, lf AS (SELECT message_id, rating, comment FROM (SELECT fb.*, row_number() OVER (PARTITION BY message_id ORDER BY created_at DESC, feedback_id DESC) AS rn
  FROM fb WHERE (message_id, user_id) IN (SELECT message_id, user_id FROM ow)) WHERE rn = 1)"""


def messages(spark, sf):
    return table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), F.col("conv_id").alias("conversation_id"), "role", "text", F.col("turn").alias("created_at"))


def latest(spark, sf):
    m = messages(spark, sf)
    top = m.agg((F.max("message_id") + 5).alias("n"))  # a single value
    fb = table(spark, sf, "events").join(F.broadcast(top), how="cross").select(
        F.col("event_id").alias("feedback_id"), (F.col("event_id") % F.col("n")).alias("message_id"), F.concat(F.lit("u"), F.col("user_id") % 5).alias("user_id"),
        F.col("event_type").alias("rating"), F.col("props").alias("comment"), F.col("ts").alias("created_at"))
    owner = conversations(spark, sf).select(F.col("id").alias("conversation_id"), "user_id")
    return A.latest_feedback(fb, m, owner)


@query("a05_latest_feedback", f"WITH {LATEST} SELECT * FROM lf")
def a05(spark, sf):
    return latest(spark, sf)


@query("a06_dashboard_counts", f"WITH {CONV}, {RECORDS} SELECT (SELECT count(*) FROM cv) AS chat_threads, (SELECT count(*) FROM dr) AS uploaded_documents, (SELECT count(DISTINCT source) FROM documents) AS knowledge_bases")
def a06(spark, sf):
    return A.dashboard_counts(conversations(spark, sf), records(spark, sf), table(spark, sf, "documents").select("source").distinct())


@query("a06_dashboard_recent", f"""WITH {CONV}, {RECORDS} SELECT * FROM (SELECT 'thread' AS kind, CASE WHEN length(content) > 50 THEN concat(left(content, 50), '...') ELSE content END AS label FROM cv ORDER BY created_at DESC, id LIMIT 8)
UNION ALL SELECT * FROM (SELECT 'document', filename FROM dr ORDER BY created_at DESC, id LIMIT 7)""")
def a06r(spark, sf):
    return A.dashboard_recent(conversations(spark, sf), records(spark, sf))


@query("a07_get_or_create_bases", """WITH ex AS (SELECT DISTINCT lang AS name, 'existing' AS description FROM documents WHERE lang != 'de'),
al AS (SELECT DISTINCT lang AS name FROM documents UNION SELECT DISTINCT source FROM documents)
SELECT name, description FROM ex UNION ALL SELECT name, concat('Documents associated with ', name, ' product segment.') FROM al WHERE name NOT IN (SELECT name FROM ex) ORDER BY name""")
def a07(spark, sf):
    d = table(spark, sf, "documents")
    existing = d.filter("lang != 'de'").select(F.col("lang").alias("name")).distinct().withColumn("description", F.lit("existing"))
    return A.get_or_create_bases(existing, d.select(F.explode(F.array("lang", "source")).alias("name")))


@query("a08_cascade_delete", f"""WITH {CONV}, {FEEDBACK}, gone AS (SELECT doc_id AS conv_id FROM labels WHERE toxic = 1)
SELECT message_id, conversation_id FROM ms WHERE conversation_id NOT IN (SELECT conv_id FROM gone)
UNION ALL SELECT NULL, id FROM cv WHERE id NOT IN (SELECT conv_id FROM gone)""")
def a08(spark, sf):
    gone = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    parents, children = A.cascade_delete(conversations(spark, sf), messages(spark, sf), gone, "id", "conversation_id")
    left = children.select("message_id", "conversation_id")
    return left.unionByName(parents.select(F.lit(None).cast(left.schema["message_id"].dataType).alias("message_id"), F.col("id").alias("conversation_id")))


@query("a09_transcript", f"""WITH {CONV}, {LATEST} SELECT ms.message_id, conversation_id, user_id, role, text, rating, comment FROM cv JOIN ms ON ms.conversation_id = cv.id LEFT JOIN lf USING (message_id)
ORDER BY conversation_id, ms.created_at, message_id""")
def a09(spark, sf):
    c = conversations(spark, sf).select(F.col("id").alias("conversation_id"), "user_id")
    return A.transcript(c, messages(spark, sf), latest(spark, sf)).drop("created_at")
