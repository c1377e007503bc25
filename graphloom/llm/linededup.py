"""Line dedup over levelled sorted runs of line keys (a log-structured merge of what was seen), DataFrame functions only.

Documents come in batches by descending doc_id. A batch's keys are merge-anti-joined with the runs: keys that no run has are new,
and the largest doc_id that holds one is known from then on; of the others only the number of documents is news. The batch then
adds its own run (key, documents, largest doc_id). Runs are written in buckets by key, sorted, so joins with them and merges of
them go bucket by bucket. When a level holds `fanout` runs they are merged into one run of the next level: a key is rewritten
once a level, not once a batch.

Defined results: a null or empty text is one empty line; a doc_id that occurs in several rows is one document; null doc_ids
together are one document, which counts as the smallest; a table without rows gives no rows; other columns, whatever they are
called, are kept, and what is added takes another name where a column has its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bucketed, checked_broadcast, documents, fresh, kept, scratch, written

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FANOUT = 3
WORD = 32
BLANK = " \t\n\v\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def bare(line: Column) -> Column:
    """The line without white space at its ends."""
    return F.btrim(line, F.lit(BLANK))


def key_of(line: Column) -> Column:
    """The bare line, A-Z in lower case."""
    stripped = bare(line)
    # of ASCII text, which is as long in bytes as in characters, lower() changes just A-Z, and much faster
    return F.when(F.octet_length(stripped) == F.char_length(stripped), F.lower(stripped)).otherwise(F.translate(stripped, UPPER, LOWER))


def keyed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_key, pos, key): one row a line; key is null for lines too short to count."""
    long = F.char_length(bare(F.col("line"))) >= min_chars
    return docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_key"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line")).select(
        "doc_id", "text_key", "pos", F.when(long, F.unhex(F.md5(key_of(F.col("line"))))).alias("key")
    )


class LineRuns:
    """The runs by levels: tables (key, n_docs, last_doc) in sorted buckets, in the folder that all executors share."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = []
        self.names: list[str] = []

    @property
    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def _add(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        table, name = bucketed(run, "key")
        self.levels[level].append(table)
        self.names.append(name)
        if len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = _merged(self.levels[level]), []
            self._add(merged, level + 1)

    def add(self, lines: DataFrame) -> None:
        """Adds a batch of keyed lines as a run. All rows of a document must be in one batch, and no later batch may hold a larger doc_id."""
        one = lines.where(F.col("key").isNotNull()).groupBy("key", "doc_id").agg(F.lit(1).alias("one"))
        batch = one.groupBy("key").agg(F.count("one").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        self._add(self._marked(batch).select("key", "n_docs", F.when(F.col("new"), F.col("last_doc")).alias("last_doc")), 0)

    def _marked(self, rows: DataFrame) -> DataFrame:
        """rows with `new`: whether no run has their key."""
        seen = [f"run_{i}" for i in range(len(self.runs))]
        out = rows
        for name, run in zip(seen, self.runs, strict=True):
            out = out.join(run.select("key", F.lit(True).alias(name)), "key", "left")
        return out.select(*rows.columns, F.coalesce(*seen, F.lit(False)).alias("seen")).withColumn("new", ~F.col("seen")).drop("seen")

    def unseen(self, lines: DataFrame) -> DataFrame:
        """The lines whose key no run has; lines without a key stay."""
        return self._marked(lines).where("new").select(*lines.columns)

    def statistics(self) -> DataFrame:
        """(key, n_docs, last_doc) over all batches so far."""
        return _merged(self.runs) if self.runs else self.spark.createDataFrame([], "key binary, n_docs long, last_doc long")

    def drop(self) -> None:
        """Forgets the runs' names; their files stay with the other written tables."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _merged(runs: list[DataFrame]) -> DataFrame:
    """One run of several: sorted buckets are merged by full outer joins, two runs at a time."""
    out = runs[0]
    for more in runs[1:]:
        a, b = out.alias("a"), more.alias("b")
        n = F.coalesce("a.n_docs", F.lit(0)) + F.coalesce("b.n_docs", F.lit(0))
        out = a.join(b, F.col("a.key") == F.col("b.key"), "full_outer").select(F.coalesce("a.key", "b.key").alias("key"), n.cast("long").alias("n_docs"), F.greatest("a.last_doc", "b.last_doc").alias("last_doc"))
    return out


def repeated_lines(docs: DataFrame, min_chars: int, min_docs: int, batches: int) -> DataFrame:
    """(doc_id, text_key, n_lines, n_dropped, dropped): dropped has a bit for each line, in words of WORD bits."""
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000).alias("c")).first()["c"] or []
    later = sum((F.coalesce(F.col("doc_id") <= c, F.lit(True)).cast("int") for c in cuts), F.lit(0))
    lines = written(keyed_lines(docs, min_chars).withColumn("batch", later), "lines", by=("batch",))
    runs = LineRuns(docs.sparkSession)
    for k in range(len(cuts) + 1):
        runs.add(lines.where(F.col("batch") == k))
    # a table of its own: Spark knows its size and broadcasts it if it is small, else the join can split a hot key's rows
    often = written(runs.statistics().where(F.col("n_docs") >= min_docs), "often")
    runs.drop()
    short = lines.where(F.col("key").isNull()).select("doc_id", "text_key", "pos", F.lit(0).alias("drop"))
    long = lines.where(F.col("key").isNotNull()).join(often, "key", "left").select(
        "doc_id", "text_key", "pos", (F.col("n_docs").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("last_doc"))).cast("int").alias("drop")
    )
    word = short.unionByName(long).groupBy("doc_id", "text_key", F.floor(F.col("pos") / WORD).alias("word")).agg(
        # a document's repeated rows give each line several times
        F.bit_or(F.when(F.col("drop") == 1, F.expr(f"shiftleft(1L, int(pos % {WORD}))")).otherwise(F.lit(0).cast("long"))).alias("bits"),
        F.max("pos").alias("last"),
    )
    return word.groupBy("doc_id", "text_key").agg(
        (F.max("last") + 1).cast("long").alias("n_lines"),
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"),
        F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("dropped"),
    )


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, counts: bool = True) -> DataFrame:
    """docs without the lines whose key at least min_docs documents hold, but in the largest doc_id; adds n_lines and n_dropped unless counts is false
    (under other names where docs has columns of these).

    text becomes the kept lines joined by newline; a text that loses nothing stays as it is (null stays null).
    """
    if counts:
        marks = repeated_lines(docs, min_chars, min_docs, batches)
    else:  # only texts that lose lines matter: few, as a rule, and counted before they are broadcast
        with scratch(docs.sparkSession):
            marks = kept(written(repeated_lines(docs, min_chars, min_docs, batches).where("n_dropped > 0"), "marks"))
        longest = marks.agg(F.max(F.size("dropped")).alias("n")).first()["n"] or 0
        marks = checked_broadcast(marks, 64 + 8 * longest)
    d, m = docs.alias("d"), marks.alias("m")
    both = d.join(m, F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.md5(F.coalesce(F.col("d.text"), F.lit(""))) == F.col("m.text_key")), "left")
    left = F.filter(lines_of(F.col("d.text")), lambda x, i: F.getbit(F.element_at(F.col("m.dropped"), (F.floor(i / WORD) + 1).cast("int")), i % WORD) == 0)
    text = F.when(F.coalesce("m.n_dropped", F.lit(0)) == 0, F.col("d.text")).otherwise(F.array_join(left, "\n"))
    return both.select(*[text.alias("text") if c == "text" else F.col(f"d.`{c}`") for c in docs.columns], *([F.col(f"m.{c}").alias(fresh(docs, c)) for c in ("n_lines", "n_dropped")] if counts else []))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


LINES_SQL = r"""
lines AS (
  SELECT doc_id, pos, string_split(coalesce(text, ''), chr(10))[pos] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos FROM docs)
), keyed AS (
  SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), often AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.pos, k.line, o.key IS NOT NULL AND k.doc_id <> o.last_doc AS dropped FROM keyed k LEFT JOIN often o ON k.key = o.key
)
"""
OP9_SQL = (
    "WITH docs AS (SELECT doc_id, text FROM documents), "
    + LINES_SQL
    + """
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
)
