"""Structure-aware chunks of pages, their context, and whether they are worth reading.

Paragraphs are packed greedily, which is a fold over the paragraphs of one page; it runs as a higher-order aggregate, in the
JVM, and pages are independent.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import once, strip

CHUNK_SIZE, OVERLAP, MIN_SIZE = 1000, 200, 100
CONTEXT = 200
#: What tables of contents and the like hold.
CONTENTS_MARKS = ("table of contents", "sommaire", "appendix", "annexe", "page ", "   •", "........")
MIN_CHARS, MIN_SHARE, MAX_SECTIONS = 100, 0.5, 5
PROMPT_CHARS, PROMPT_NAMES = 2000, 20


def paragraphs(text: Column) -> Column:
    """Blank lines part paragraphs; their lines are stripped and joined by a space."""
    lines = F.transform(F.split(text, "\n", -1), strip)
    joined = F.array_join(F.transform(lines, lambda x: F.when(x == "", "\n").otherwise(x)), " ")
    return F.filter(F.transform(F.split(joined, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def lines_as_paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n", -1), strip), lambda x: x != "")


_STATE = "struct<chunks:array<struct<text:string,paragraphs:int>>,cur:array<string>,size:int>"


def sentence_chunks(paragraph: Column, size: int = CHUNK_SIZE) -> Column:
    """A long paragraph as chunks of whole sentences, packed greedily; sizes don't count the spaces between."""
    pieces = F.filter(F.transform(F.split(paragraph, r"\.", -1), strip), lambda x: x != "")
    sentences = F.transform(pieces, lambda x: F.concat(x, F.lit(".")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("size"))

    def step(acc: Column, s: Column) -> Column:
        over = (acc["size"] + F.length(s) > size) & (F.size(acc["cur"]) > 0)
        return F.struct(
            F.when(over, F.concat(acc["done"], F.array(F.array_join(acc["cur"], " ")))).otherwise(acc["done"]).alias("done"),
            F.when(over, F.array(s)).otherwise(F.concat(acc["cur"], F.array(s))).alias("cur"),
            F.when(over, F.length(s)).otherwise(acc["size"] + F.length(s)).alias("size"),
        )

    def finish(acc: Column) -> Column:
        return F.when(F.size(acc["cur"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["cur"], " ")))).otherwise(acc["done"])

    return F.aggregate(sentences, start, step, finish)


def page_chunks(paras: Column, size: int = CHUNK_SIZE, overlap: int = OVERLAP, least: int = MIN_SIZE) -> Column:
    """array<struct<text, paragraphs>> of a page's paragraphs. With an overlap, a chunk begins with the whole last paragraph
    of the one before; a paragraph beyond the size is cut by sentences; a rest below `least` is left out."""
    none, chunks = F.array().cast("array<string>"), F.array().cast("array<struct<text:string,paragraphs:int>>")
    start = F.struct(chunks.alias("chunks"), none.alias("cur"), F.lit(0).alias("size"))

    def chunk(cur: Column) -> Column:
        return F.array(F.struct(F.array_join(cur, "\n\n").alias("text"), F.size(cur).alias("paragraphs")))

    def step(acc: Column, p: Column) -> Column:
        n, full = F.length(p), F.size(acc["cur"]) > 0
        large, over = n > size, (acc["size"] + n > size) & full
        cut = F.transform(sentence_chunks(p, size), lambda x: F.struct(x.alias("text"), F.lit(1).alias("paragraphs")))
        flushed = F.when(full, F.concat(acc["chunks"], chunk(acc["cur"]))).otherwise(acc["chunks"])
        last = F.element_at(acc["cur"], -1)
        carry = F.array(last, p) if overlap > 0 else F.array(p)
        carried = F.length(last) + n if overlap > 0 else n
        return F.struct(
            F.when(large, F.concat(flushed, cut)).when(over, flushed).otherwise(acc["chunks"]).alias("chunks"),
            F.when(large, none).when(over, carry).otherwise(F.concat(acc["cur"], F.array(p))).alias("cur"),
            F.when(large, F.lit(0)).when(over, carried).otherwise(acc["size"] + n).alias("size"),
        )

    def finish(acc: Column) -> Column:
        return F.when((F.size(acc["cur"]) > 0) & (acc["size"] >= least), F.concat(acc["chunks"], chunk(acc["cur"]))).otherwise(acc["chunks"])

    # element_at(-1) of an empty list is only looked at where the list isn't empty
    return F.aggregate(paras, start, step, finish)


def chunked(pages: DataFrame, paras: Column, size: int = CHUNK_SIZE, overlap: int = OVERLAP, least: int = MIN_SIZE) -> DataFrame:
    """(doc_id, page_number, chunk_index, text, char_count, paragraph_count) from pages (doc_id, page_number, text)."""
    one = pages.select("doc_id", "page_number", F.posexplode(page_chunks(paras, size, overlap, least)).alias("in_page", "c"))
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number", "in_page")) - 1
    return one.select("doc_id", "page_number", index.alias("chunk_index"), F.col("c.text").alias("text"), F.length("c.text").alias("char_count"), F.col("c.paragraphs").alias("paragraph_count"))


def with_context(chunks: DataFrame, width: int = CONTEXT) -> DataFrame:
    """chunks with the end of the one before and the beginning of the one after, across pages."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    before, after = F.lag("text").over(w), F.lead("text").over(w)
    return chunks.withColumns({"before": F.coalesce(F.right(before, F.lit(width)), F.lit("")), "after": F.coalesce(F.left(after, F.lit(width)), F.lit(""))})


def mention_window(text: Column, name: Column, width: int = 100) -> Column:
    """The first place of a name with `width` characters to either side; null where it isn't."""
    at = F.locate(name, text) if isinstance(name, str) else F.instr(text, name)
    start = F.greatest(at - width, F.lit(1))
    return F.when(at > 0, F.substring(text, start, F.least(at + F.length(name) - 1 + width, F.length(text)) - start + 1))


def low_quality(text: Column) -> Column:
    """Short, like a table of contents, mostly marks, or full of section numbers."""
    plain = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))
    marks = once(F.lower(text), lambda low: reduce(lambda a, b: a | b, [low.contains(m) for m in CONTENTS_MARKS]))
    sections = sum(((text.contains(f"{i}.") | text.contains(f" {i} ")).cast("int") for i in range(1, 10)), (text.contains("0.") | text.contains(" 0 ")).cast("int"))
    return (F.length(text) < MIN_CHARS) | marks | (plain < F.length(text) * MIN_SHARE) | (sections > MAX_SECTIONS)


def prompt(text: Column, before: Column, after: Column, names: Column) -> Column:
    """What a relation provider is asked: the text's beginning, its context and the first names found in it."""
    def part(title: str, c: Column) -> Column:
        return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(title + "\n"), c, F.lit("\n\n"))).otherwise(F.lit(""))

    return F.concat(part("CONTEXT BEFORE:", before), part("TEXT:", F.left(text, F.lit(PROMPT_CHARS))), part("CONTEXT AFTER:", after), part("NAMES:", F.array_join(F.slice(names, 1, PROMPT_NAMES), ", ")))
