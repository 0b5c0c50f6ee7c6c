"""Conversations, messages, feedback, knowledge bases and document records."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry import fixed as V
from docquarry.operators.index import top_k


def recent_messages(messages: DataFrame, key: str = "conv_id", order: str = "turn", n: int = V.HISTORY_MESSAGES) -> DataFrame:
    """The newest messages but the current one, oldest first."""
    last = top_k(messages, n, [F.desc(order)], [key], "_back").filter(F.col("_back") > 1)
    w = Window.partitionBy(key).orderBy(F.desc("_back"))
    return last.withColumn("position", F.row_number().over(w)).drop("_back")


def conversation_list(conversations: DataFrame) -> DataFrame:
    """Title from the first message, newest conversation first."""
    c = F.col("content")
    title = F.when(F.length(c) > V.TITLE_CHARS, F.concat(F.left(c, F.lit(V.TITLE_CHARS)), F.lit("..."))).otherwise(c)
    return conversations.withColumn("title", title).drop("content").orderBy(F.desc("created_at"), "id")


def document_list(documents: DataFrame, product_id: str | None = None, status: str | None = None) -> DataFrame:
    if product_id is not None:
        documents = documents.filter(F.col("product_id") == product_id)
    if status is not None:
        documents = documents.filter(F.col("status") == status)
    return documents.orderBy(F.desc("created_at"), "id")


def document_search(documents: DataFrame, text: str) -> DataFrame:
    q = text.lower()
    return documents.filter(F.lower("filename").contains(q) | F.lower("status").contains(q))


def latest_feedback(feedback: DataFrame, messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """One feedback per message: the latest, for messages of known conversations
    of the same user."""
    owned = messages.join(conversations.select("conversation_id", "user_id"), "conversation_id")
    mine = feedback.join(owned.select("message_id", "user_id"), ["message_id", "user_id"], "left_semi")
    return mine.groupBy("message_id").agg(F.max_by(F.struct("rating", "comment"), F.struct("created_at", "feedback_id")).alias("_f")).select(
        "message_id", "_f.*")


def dashboard_counts(conversations: DataFrame, documents: DataFrame, bases: DataFrame) -> DataFrame:
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    # single-row tables
    return one(conversations, "chat_threads").join(F.broadcast(one(documents, "uploaded_documents")), how="cross").join(
        F.broadcast(one(bases, "knowledge_bases")), how="cross")


def dashboard_recent(conversations: DataFrame, documents: DataFrame) -> DataFrame:
    threads = conversation_list(conversations).limit(V.RECENT_THREADS).select(F.lit("thread").alias("kind"), F.col("title").alias("label"))
    docs = document_list(documents).limit(V.RECENT_DOCUMENTS).select(F.lit("document").alias("kind"), F.col("filename").alias("label"))
    return threads.unionByName(docs)


def get_or_create_bases(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """Knowledge bases plus the names that were missing, in order of name."""
    missing = wanted.select("name").distinct().join(existing, "name", "left_anti").withColumn(
        "description", F.concat(F.lit("Documents associated with "), "name", F.lit(" product segment.")))
    return existing.select("name", "description").unionByName(missing.select("name", "description")).orderBy("name")


def cascade_delete(parents: DataFrame, children: DataFrame, deleted: DataFrame, key: str, foreign: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children that are left when ``deleted`` parents go."""
    gone = deleted.select(key).distinct()
    return parents.join(gone, key, "left_anti"), children.join(
        gone.withColumnRenamed(key, foreign), foreign, "left_anti")


def transcript(conversations: DataFrame, messages: DataFrame, feedback: DataFrame) -> DataFrame:
    return conversations.join(messages, "conversation_id").join(feedback, "message_id", "left").orderBy(
        "conversation_id", "created_at", "message_id")
