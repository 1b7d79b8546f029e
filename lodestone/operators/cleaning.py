"""Cleaning of page texts: blocks, back matter, tables and bullet lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T

PER_SENTENCE = 5


def exploded(texts: DataFrame) -> DataFrame:
    """(id, pos, block) of (id, text)."""
    return texts.select("id", F.posexplode(T.blocks(F.col("text"))).alias("pos", "block"))


def flagged(blocks: DataFrame) -> DataFrame:
    b = F.col("block")
    return blocks.select("*", T.heading(b).alias("is_heading"), T.bullets(b).alias("is_bullet"), T.table_like(b).alias("is_table"), T.sentence_shaped(b).alias("is_sentence"))


def without_back_matter(blocks: DataFrame) -> DataFrame:
    """Blocks before the first one-line heading of back matter."""
    b = F.col("block")
    ends = (F.instr(b, "\n") == 0) & T.heading_key(b).isin(*T.BACK_MATTER)
    cut = F.min(F.when(ends, F.col("pos"))).over(Window.partitionBy("id"))
    return blocks.withColumn("_cut", cut).filter(F.col("_cut").isNull() | (F.col("pos") < F.col("_cut"))).drop("_cut")


def cleaned(blocks: DataFrame) -> DataFrame:
    """(id, n_blocks, text): bullet runs become sentences of five items, table runs go where they are long, follow a heading or precede prose.

    A block that is both bullet and table goes with the last block before it that is not both."""
    w = Window.partitionBy("id").orderBy("pos")
    kind = F.when(F.col("is_bullet") & F.col("is_table"), F.lit(None)).when(F.col("is_table"), "table").when(F.col("is_bullet"), "bullet").otherwise("prose")
    both = F.when(F.last(kind, ignorenulls=True).over(w) == "table", "table").otherwise("bullet")
    typed = flagged(blocks).withColumn("kind", F.when(F.col("is_bullet") & F.col("is_table"), both).otherwise(kind))
    starts = F.when((F.col("kind") != F.lag("kind").over(w)) | F.lag("kind").over(w).isNull() | (F.col("kind") == "prose"), 1).otherwise(0)
    typed = typed.withColumn("run", F.sum(starts).over(w))
    typed = typed.withColumn("before", F.lag(F.col("is_heading") & (F.col("kind") == "prose"), 1, False).over(w)).withColumn("after", F.lead(F.col("is_sentence"), 1, False).over(w))
    runs = typed.groupBy("id", "run").agg(
        F.min("kind").alias("kind"), F.count("*").alias("n"), F.min_by("before", "pos").alias("before"), F.max_by("after", "pos").alias("after"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "block"))), lambda x: x["block"]).alias("blocks"),
    )
    items = F.flatten(F.transform("blocks", lambda b: F.filter(F.transform(F.filter(F.split(b, "\n"), lambda x: F.trim(x).startswith("- ")), lambda x: F.trim(F.substring(F.trim(x), 3, 1_000_000))), lambda x: x != "")))
    runs = runs.withColumn("items", F.when(F.col("kind") == "bullet", items))
    last = F.floor((F.size("items") - 1) / PER_SENTENCE).cast("int")
    sentence = lambda i: F.concat(F.lit("The list also includes "), F.array_join(F.slice("items", i * PER_SENTENCE + 1, PER_SENTENCE), ", "), F.lit("."))
    listed = F.when(F.size("items") > 0, F.transform(F.sequence(F.lit(0), last), sentence)).otherwise(F.array().cast("array<string>"))
    gone = (F.col("kind") == "table") & ((F.col("n") >= 3) | F.col("before") | F.col("after"))
    runs = runs.withColumn("out", F.when(gone, F.array().cast("array<string>")).when(F.col("kind") == "bullet", listed).otherwise(F.col("blocks")))
    text = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("run", "out"))), lambda x: x["out"]))
    return runs.groupBy("id").agg(text.alias("out")).select("id", F.size("out").alias("n_blocks"), F.array_join("out", "\n\n").alias("text"))


def export_clean(texts: DataFrame, newline: str = "\r\n") -> DataFrame:
    """(id, text) of exported texts: the header's title, a blank line, and the body without 'edit' lines and trailing blanks,
    cut at the first line that is a heading of back matter other than 'see also'; what is empty is left out. Ends with a newline."""
    ends = [h for h in T.BACK_MATTER if h != "see also"]
    trimmed = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    parts = texts.select("id", trimmed(F.regexp_extract(T.header(F.col("text")), r"(?m)^Title:\s*(.+)$", 1)).alias("title"), T.body(F.col("text")).alias("body"))
    lines = F.filter(F.split("body", r"\r?\n"), lambda x: trimmed(x) != "edit")
    lines = F.transform(lines, lambda x: F.regexp_replace(x, r"\s+$", ""))
    cut = F.array_position(F.transform("lines", lambda x: F.lower(F.trim(x)).isin(*ends)), True)
    kept = F.when(cut > 0, F.slice("lines", F.lit(1), cut.cast("int") - 1)).otherwise(F.col("lines"))
    body = F.regexp_replace(trimmed(F.array_join(kept, "\n")), r"\n{3,}", "\n\n")
    out = parts.withColumn("lines", lines).select("id", F.filter(F.array("title", body), lambda x: x != "").alias("parts"))
    return out.select("id", F.replace(F.concat(F.array_join("parts", "\n\n"), F.lit("\n")), F.lit("\n"), F.lit(newline)).alias("text"))


def sentence_chunks(texts: DataFrame, size: int = 180) -> DataFrame:
    """(id, chunk, n_words, text): sentences one after the other, cut into chunks of at most `size` words, as many sentences
    as fit. Sentences are never cut: a longer one is a chunk of its own."""
    said = F.transform(T.sentences(F.col("text")), lambda s: F.struct(s.alias("s"), T.n_words(s).alias("n")))
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("used"), F.array().cast("array<struct<chunk:int,n:int,s:string>>").alias("out"))

    def put(a, x):
        new = (a["used"] > 0) & (a["used"] + x["n"] > size)
        chunk = F.when(new, a["chunk"] + 1).otherwise(a["chunk"])
        return F.struct(chunk.alias("chunk"), F.when(new, x["n"]).otherwise(a["used"] + x["n"]).alias("used"), F.concat(a["out"], F.array(F.struct(chunk.alias("chunk"), x["n"].alias("n"), x["s"].alias("s")))).alias("out"))

    rows = texts.select("id", F.posexplode(F.aggregate(said, start, put)["out"]).alias("pos", "x"))
    rows = rows.groupBy("id", F.col("x.chunk").alias("chunk")).agg(F.sum("x.n").alias("n_words"), F.array_sort(F.collect_list(F.struct("pos", "x.s"))).alias("said"))
    return rows.select("id", "chunk", "n_words", F.array_join(F.transform("said", lambda x: x["s"]), ". ").alias("text"))
