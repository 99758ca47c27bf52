"""Cutting documents into chunks and finding their pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import strip, token_count

CHUNK_TOKENS, OVERLAP, MIN_TOKENS, WINDOW_TOKENS = 512, 64, 32, 8192


def sentence_chunks(docs: DataFrame, size: int = CHUNK_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """(document_id, pos, text, token_count): sentences of (document_id, text) packed to at most size tokens.

    A chunk holds at least one sentence, however long; the next chunk begins with the last
    sentences of the one before as long as they have at most overlap tokens. Each document
    is folded on its own, sentence by sentence, each looking back at overlap tokens only. Blank and null texts give no rows.
    """
    sentences = F.filter(F.transform(F.split("text", r"(?<=[.!?])\s+"), strip), lambda s: F.length(s) > 0)
    sized = docs.where("text is not null").select("document_id", F.transform(sentences, lambda s: F.struct(s.alias("s"), token_count(s).alias("n"))).alias("a"))
    x = sized.select("document_id", F.posexplode("a").alias("i", "x")).select("document_id", "i", "x.s", "x.n")
    x = x.withColumn("upto", F.sum("n").over(Window.partitionBy("document_id").orderBy("i"))).withColumn("start", F.col("upto") - F.col("n"))
    # of the sentences before, those from which at most overlap tokens lie before this one, and with it at most size
    near = F.collect_list("start").over(Window.partitionBy("document_id").orderBy("start").rangeBetween(-overlap, -1))
    x = x.withColumn("back", F.size(F.filter(near, lambda t: F.col("upto") - t <= size)))
    ordered = x.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("i", "upto", "n", "back", "s"))).alias("a"))
    none = F.array().cast("array<struct<a:int,b:int>>")
    begin = F.struct(F.lit(0).alias("first"), F.lit(0).cast("bigint").alias("base"), none.alias("cuts"))

    def step(state, e):
        full = (e["upto"] - state["base"] > size) & (e["i"] > state["first"])
        first = e["i"] - F.least(e["back"], e["i"] - state["first"] - 1)
        base = F.when(first > 0, F.get("a", first - 1)["upto"]).otherwise(F.lit(0).cast("bigint"))
        cuts = F.concat(state["cuts"], F.array(F.struct(state["first"].alias("a"), (e["i"] - 1).alias("b"))))
        return F.when(full, F.struct(first.alias("first"), base.alias("base"), cuts.alias("cuts"))).otherwise(state)

    folded = ordered.select("document_id", "a", F.aggregate("a", begin, step).alias("st"))
    spans = F.concat("st.cuts", F.array(F.struct(F.col("st.first").alias("a"), (F.size("a") - 1).alias("b"))))
    out = folded.select("document_id", "a", F.posexplode(spans).alias("pos", "c"))
    part = F.slice("a", F.col("c.a") + 1, F.col("c.b") - F.col("c.a") + 1)
    return out.select("document_id", "pos", F.array_join(F.transform(part, lambda s: s["s"]), " ").alias("text"), F.aggregate(part, F.lit(0).cast("bigint"), lambda t, s: t + s["n"]).alias("token_count"))


def merge_micro(chunks: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(document_id, chunk_index, text, char_start, char_end, token_count): chunks under min_tokens joined to the one before.

    chunks: (document_id, pos, text, char_start, char_end, token_count). A small first
    chunk stays one of its own, and small ones after it join it. Blank chunks go first.
    """
    by = Window.partitionBy("document_id").orderBy("pos")
    x = chunks.where(F.length(strip(F.col("text"))) > 0).withColumn("n", F.row_number().over(by))
    x = x.withColumn("g", F.sum(F.when((F.col("n") == 1) | (F.col("token_count") >= min_tokens), 1).otherwise(0)).over(by))
    parts = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return x.groupBy("document_id", "g").agg(
        F.array_join(F.transform(parts, lambda s: strip(s["text"])), " ").alias("text"), F.min("char_start").alias("char_start"), F.max_by("char_end", "pos").alias("char_end"), F.sum("token_count").alias("token_count")
    ).select("document_id", (F.col("g") - 1).cast("int").alias("chunk_index"), "text", "char_start", "char_end", "token_count")


def page_offsets(docs: DataFrame, pages: DataFrame, prefix: int = 100) -> DataFrame:
    """(document_id, page_number, start): where each page's first characters lie in the document's text, 0-based.

    docs: (document_id, full_text); pages: (document_id, page_number, text). Pages are
    sought in their order from where the last one was found; empty and missing ones are
    passed over.
    """
    p = pages.where("text is not null and text != ''").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", F.substring("text", 1, prefix).alias("s")))).alias("pages"))
    none = F.array().cast("array<struct<page_number:int,start:int>>")

    def step(state, e):
        at = F.call_function("locate", e["s"], F.col("full_text"), state["cursor"] + 1)
        found = F.struct((at - 1 + F.length(e["s"])).alias("cursor"), F.concat(state["out"], F.array(F.struct(e["page_number"].alias("page_number"), (at - 1).alias("start")))).alias("out"))
        return F.when(at > 0, found).otherwise(state)

    folded = docs.join(p, "document_id").select("document_id", F.aggregate("pages", F.struct(F.lit(0).alias("cursor"), none.alias("out")), step)["out"].alias("o"))
    return folded.select("document_id", F.inline("o"))


def even_pages(docs: DataFrame) -> DataFrame:
    """(document_id, page_number, text): documents (document_id, text, page_count) without page marks, their lines split evenly.

    Each page gets lines // page_count lines; what is left over at the end is dropped, as
    are empty pages. A text of fewer lines than pages, or without page_count, is one page.
    """
    lines = F.split("text", "\n")
    whole = (F.coalesce("page_count", F.lit(0)) < 1) | (F.size(lines) < F.col("page_count"))
    of = F.when(whole, F.lit(1)).otherwise(F.col("page_count"))
    size = F.floor(F.size(lines) / of).cast("int")
    x = docs.where("text is not null").withColumn("l", lines).withColumn("size", size).withColumn("page_number", F.explode(F.sequence(F.lit(1), of)))
    text = F.array_join(F.slice("l", (F.col("page_number") - 1) * F.col("size") + 1, F.when(whole, F.size("l")).otherwise(F.col("size"))), "\n")
    return x.select("document_id", "page_number", text.alias("text")).where(F.length(strip(F.col("text"))) > 0)


def page_as_of(chunks: DataFrame, offsets: DataFrame) -> DataFrame:
    """chunks (chunk_id, document_id, char_start) with the page whose start is the last one not behind char_start.

    Union and running last value: each document is sorted once, and nothing multiplies.
    """
    marks = offsets.select("document_id", F.col("start").alias("at"), F.lit(0).alias("kind"), F.col("page_number").alias("page"), F.lit(None).cast("string").alias("chunk_id"))
    asked = chunks.select("document_id", F.col("char_start").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("page"), "chunk_id")
    by = Window.partitionBy("document_id").orderBy("at", "kind", "page")
    return marks.union(asked).withColumn("page", F.last("page", ignorenulls=True).over(by)).where("kind = 1").select("chunk_id", "document_id", F.col("at").alias("char_start"), F.col("page").alias("page_number"))


def context_windows(chunks: DataFrame, capacity: int = WINDOW_TOKENS) -> DataFrame:
    """(chunk_id, document_id, window): chunks (chunk_id, document_id, chunk_index, n tokens) of a document filled in order into windows."""
    x = chunks.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "n"))).alias("a"))
    none = F.array().cast("array<struct<chunk_id:string,window:int>>")

    def step(s, e):
        fits = (s["sum"] + e["n"] <= capacity) | (s["sum"] == 0)
        w = F.when(fits, s["w"]).otherwise(s["w"] + 1)
        return F.struct(w.alias("w"), F.when(fits, s["sum"] + e["n"]).otherwise(e["n"]).alias("sum"), F.concat(s["out"], F.array(F.struct(e["chunk_id"].alias("chunk_id"), w.alias("window")))).alias("out"))

    start = F.struct(F.lit(0).alias("w"), F.lit(0).cast("bigint").alias("sum"), none.alias("out"))
    return x.select("document_id", F.inline(F.aggregate("a", start, step)["out"])).select("chunk_id", "document_id", "window")


def ingest(docs: DataFrame, offsets: DataFrame) -> DataFrame:
    """(document_id, chunk_index, text, token_count, char_start, page_number): documents (document_id, text) as chunks on their pages.

    Sentences are packed, each chunk's first sentence is sought in the text from where the
    one before began, small chunks are joined and numbered, and the last page (offsets, see
    page_offsets) not behind a chunk's start is its own; null before the first page.
    """
    packed = sentence_chunks(docs)
    head = F.regexp_extract("text", r"^[\s\S]*?[.!?](?= |$)", 0)
    heads = packed.select("document_id", F.col("pos").alias("page_number"), F.when(head == "", F.col("text")).otherwise(head).alias("text"))
    starts = page_offsets(docs.withColumnRenamed("text", "full_text"), heads).withColumnRenamed("page_number", "pos")
    placed = packed.join(starts, ["document_id", "pos"], "left").withColumnRenamed("start", "char_start").withColumn("char_end", F.col("char_start"))
    merged = merge_micro(placed).drop("char_end").withColumn("chunk_id", F.concat_ws("-", "document_id", "chunk_index"))
    page = page_as_of(merged.where("char_start is not null"), offsets).select("chunk_id", "page_number")
    return merged.join(page, "chunk_id", "left").drop("chunk_id")
