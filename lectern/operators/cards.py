"""Study cards: reading a model's replies, and picking cards for chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import strip
from lectern.operators.scope import EMPTY_CARD, EMPTY_FACT, says_something

# The card types, and those of the artifact lane and of the key facts.
CARD_TYPES = ("summary", "definition", "formula", "question", "factoid", "example", "misconception", "objective")
ARTIFACT_TYPES = ("summary", "definition", "formula", "question", "factoid")
FACT_TYPES = ("definition", "factoid", "formula")


def unfenced(reply: Column) -> Column:
    """A reply without code fences and outer white space."""
    return strip(F.regexp_replace(reply, "```(?:json)?", ""))


def capitalised(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, F.length(x))))


def cards_from_replies(replies: DataFrame) -> DataFrame:
    """(chunk_id, card_type, ord, title, content, answer) from (chunk_id, card_type, reply).

    A question's reply is a list of question and answer, a factoid's a list of strings, a
    summary's is prose, and all others are one object of title and content. What can't be
    read, is null or says nothing gives no card; a missing title is the type's name.
    """
    r = replies.withColumn("reply", unfenced(F.col("reply"))).where("reply is not null")
    none = F.lit(None).cast("string")
    qa = r.where("card_type = 'question'").select("chunk_id", "card_type", F.posexplode(F.from_json("reply", "array<struct<question:string,answer:string>>")).alias("ord", "x")).where((strip(F.col("x.question")) != "") & (strip(F.col("x.answer")) != ""))
    qa = qa.select("chunk_id", "card_type", "ord", F.substring("x.question", 1, 120).alias("title"), F.col("x.question").alias("content"), F.col("x.answer").alias("answer"))
    facts = r.where("card_type = 'factoid'").select("chunk_id", "card_type", F.posexplode(F.from_json("reply", "array<string>")).alias("ord", "content")).where(says_something(F.col("content")))
    facts = facts.select("chunk_id", "card_type", "ord", F.lit("Factoid").alias("title"), "content", none.alias("answer"))
    prose = r.where("card_type = 'summary'").where(~F.lower("reply").isin("null", "")).select("chunk_id", "card_type", F.lit(0).alias("ord"), F.lit("Summary").alias("title"), F.col("reply").alias("content"), none.alias("answer"))
    one = r.where(~F.col("card_type").isin("question", "factoid", "summary")).withColumn("x", F.from_json("reply", "struct<title:string,content:string>")).where(says_something(F.col("x.content"), EMPTY_CARD))
    one = one.select("chunk_id", "card_type", F.lit(0).alias("ord"), F.coalesce(strip(F.col("x.title")), capitalised(F.col("card_type"))).alias("title"), strip(F.col("x.content")).alias("content"), none.alias("answer"))
    return qa.unionByName(facts).unionByName(prose).unionByName(one)


def first_of_content(cards: DataFrame, key: str, *order, length: int = 200) -> DataFrame:
    """cards without those whose content, in lower case, trimmed and cut to length, came before within key; order ranks them."""
    same = F.substring(F.lower(strip(F.col("content"))), 1, length)
    by = Window.partitionBy(key, "same").orderBy(*order)
    return cards.withColumn("same", same).withColumn("nth", F.row_number().over(by)).where("nth = 1").drop("same", "nth")


def key_facts(hits: DataFrame, cards: DataFrame, taken: int = 16, shown: int = 8) -> DataFrame:
    """(query_id, card_id, content, rank): up to shown cards of a query's chunks, without those that say nothing or repeat.

    hits: (query_id, id, rank); of each query the first taken cards in the order of hit and card_id are looked at.
    """
    c = cards.where(F.col("card_type").isin(*FACT_TYPES)).select("card_id", "chunk_id", "content")
    j = hits.join(c, F.col("id") == F.col("chunk_id"))
    j = j.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "card_id"))).where(F.col("n") <= taken).where(says_something(F.col("content"), EMPTY_FACT))
    k = first_of_content(j, "query_id", "n")
    return k.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("n"))).where(F.col("r") <= shown).select("query_id", "card_id", "content", F.col("r").alias("rank"))
