"""Benchmark decontamination over a positional inverted index [native].

Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters. A window is WINDOW consecutive words of
a benchmark item; an item with fewer words is one window.

1. Index: postings (term, row key, position) of the corpus for the terms that the test windows hold, written to the
   shared folder. They stay in document order, so the write needs no shuffle. A last posting of each row, of the empty
   term, tells its number of words, so texts are cut into words once.
2. Corpus frequencies of those terms come from the index. In each window the terms are ranked from rarest to commonest.
3. The posting lists of the two rarest terms of each window, moved back by their offsets, are intersected: a start
   that both name is a candidate. Only these lists are shuffled.
4. The lists of the other terms are intersected at the candidates' starts. What all terms name is an exact phrase.
   Proximity matches (``proximity``) take the same lists with a slack instead of equality.

The test side (terms, windows) is broadcast where its measured rows are BROADCAST_ROWS at most, else it is joined by
shuffle. Hits of a common passage are counted per document; the join from windows to items is by window id.

Nulls: a null text or benchmark text has no words. A row's key is its doc_id with a hash of its text, so repeated rows
share their postings and each comes out with the full result; a null doc_id is a key like others. Empty tables give no
hits. Extra columns are ignored.

Terms, windows and texts of a document are told apart by 64-bit hashes: of a million test terms or windows two share
one with a probability of about 3 in 10 ** 8, of the texts of one doc_id hardly ever.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, stored, text_of

WINDOW, ANCHORS, BROADCAST_ROWS = 10, 2, 500_000
#: Stands behind the last word of a text; no word is empty.
END = ""


def words(text: str = "text") -> Column:
    return F.regexp_extract_all(ascii_lower(text_of(text)), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), 0)


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast if its counted rows are within the bound; else the join shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, text) of every row; (doc_id, mark) names a text of a document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of("text")).alias("mark"), text_of("text").alias("text"))


def windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(window, len, off, term) of every distinct window, and (window, item_id); window is the words joined by spaces."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words("text").alias("w")).where(F.size("w") > 0)
    grams = items.select("item_id", F.explode(F.expr(f"transform(sequence(0, greatest(size(w) - {WINDOW}, 0)), i -> slice(w, i + 1, {WINDOW}))")).alias("g"))
    grams = grams.select("item_id", "g", F.concat_ws(" ", "g").alias("text")).distinct()
    texts = grams.groupBy("text").agg(F.first("g").alias("g"))
    terms = texts.select(F.xxhash64("text").alias("window"), F.size("g").alias("len"), F.posexplode("g").alias("off", "term"))
    return terms, grams.select(F.xxhash64("text").alias("window"), "item_id").distinct()


def vocabulary_of(terms: DataFrame) -> DataFrame:
    """(term, tid) of all test terms and of END; stored."""
    end = terms.sparkSession.createDataFrame([(END,)], "term string")
    return stored(terms.select("term").unionByName(end).distinct().select("term", F.xxhash64("term").alias("tid")), "vocabulary")


def build_index(docs: DataFrame, vocabulary: DataFrame, n_terms: int) -> DataFrame:
    """Postings (term, doc_id, mark, pos) for the terms of ``vocabulary`` (tid, term), stored; term is its number tid."""
    tokens = keyed(docs).select("doc_id", "mark", F.posexplode(F.concat(words(), F.array(F.lit(END)))).alias("pos", "term"))
    found = tokens.join(_small(vocabulary, n_terms), "term").select("tid", "doc_id", "mark", "pos")
    return stored(found, "postings")


def _same_doc(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.mark") == F.col(f"{b}.mark"))


def occurrences(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, mark, window, start, len) of every occurrence of a window, stored; (window, item_id); and (doc_id, mark,
    n_words), one row for each row of ``docs``."""
    terms, items = windows(benchmark)
    terms = stored(terms, "test-terms")
    vocabulary = vocabulary_of(terms)
    n_terms, n_probes = vocabulary.count(), terms.count()
    index = build_index(docs, vocabulary, n_terms)
    # a row for each test term, stored, so that the windows of a common term need not meet in one task
    counts = stored(index.groupBy("tid").agg(F.count(F.lit(1)).alias("n")), "term-counts")
    ranked = terms.select("*", F.xxhash64("term").alias("tid")).join(_small(counts, n_terms), "tid", "left").selectExpr(
        "window", "len", "off", "tid", "coalesce(n, 0L) as n", "row_number() over (partition by window order by coalesce(n, 0L), off) as rank"
    )
    # a window with a term that the corpus lacks occurs nowhere
    ranked = stored(ranked.withColumn("least", F.expr("min(n) over (partition by window)")).where("least > 0"), "ranked-terms")
    anchors = ranked.where(F.col("rank") <= ANCHORS)
    starts = index.join(_small(anchors, n_probes), "tid").selectExpr("doc_id", "mark", "window", "len", "pos - off as start", "off")
    candidates = starts.groupBy("doc_id", "mark", "window", "len", "start").agg(F.count_distinct("off").alias("met")).where(F.col("met") == F.least(F.lit(ANCHORS), F.col("len"))).drop("met")
    candidates = stored(candidates, "candidates")
    rest = ranked.where(F.col("rank") > ANCHORS).select("window", "off", "tid")
    wanted = candidates.join(_small(rest, n_probes), "window").selectExpr("doc_id", "mark", "window", "len", "start", "off", "tid", "start + off as pos")
    suspects = candidates.select("doc_id", "mark").distinct()
    part = index.alias("i").join(_small(suspects, suspects.count()).alias("s"), _same_doc("i", "s"), "left_semi")
    met = wanted.alias("w").join(part.distinct().alias("p"), _same_doc("w", "p") & (F.col("w.pos") == F.col("p.pos")) & (F.col("w.tid") == F.col("p.tid")))
    full = met.groupBy("w.doc_id", "w.mark", "w.window", "w.len", "w.start").agg(F.count(F.lit(1)).alias("met")).where(F.col("met") == F.col("len") - ANCHORS).drop("met")
    short = candidates.where(F.col("len") <= ANCHORS)
    lengths = index.where(F.col("tid") == F.xxhash64(F.lit(END))).select("doc_id", "mark", F.col("pos").cast("long").alias("n_words"))
    return stored(full.unionByName(short), "occurrences"), items, lengths


def proximity(docs: DataFrame, benchmark: DataFrame, slack: int = 3) -> DataFrame:
    """(doc_id, mark, window, start): windows whose terms all occur within ``slack`` places of their offset from the
    start that their rarest term names."""
    terms, _ = windows(benchmark)
    terms = stored(terms, "test-terms")
    vocabulary = vocabulary_of(terms)
    index = build_index(docs, vocabulary, vocabulary.count())
    counts = index.groupBy("tid").agg(F.count(F.lit(1)).alias("n"))
    ranked = stored(terms.select("*", F.xxhash64("term").alias("tid")).join(counts, "tid").selectExpr("window", "len", "off", "tid", "row_number() over (partition by window order by n, off) as rank"), "ranked-terms")
    starts = stored(index.join(ranked.where("rank = 1"), "tid").selectExpr("doc_id", "mark", "window", "len", "pos - off as start").distinct(), "starts")
    rest = ranked.where("rank > 1").select("window", "off", "tid")
    near = F.explode(F.sequence(F.expr(f"start + off - {slack}"), F.expr(f"start + off + {slack}")))
    wanted = starts.join(rest, "window").select("doc_id", "mark", "window", "len", "start", "off", "tid", near.alias("pos"))
    met = wanted.alias("w").join(index.alias("p"), _same_doc("w", "p") & (F.col("w.pos") == F.col("p.pos")) & (F.col("w.tid") == F.col("p.tid")))
    full = met.groupBy("w.doc_id", "w.mark", "w.window", "w.len", "w.start").agg(F.count_distinct("w.off").alias("met")).where("met = len - 1")
    return full.drop("met", "len").unionByName(starts.where("len = 1").drop("len"))


def matches(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, n_hit, n_items, items_sha256) of every document text with an occurrence, and the third table of
    ``occurrences``."""
    found, items, lengths = occurrences(docs, benchmark)
    spans = found.select("doc_id", "mark", "start", (F.col("start") + F.col("len")).alias("end")).distinct()
    before = "max(end) over (partition by doc_id, mark order by start, end rows between unbounded preceding and 1 preceding)"
    hit = spans.selectExpr("doc_id", "mark", f"greatest(0, end - greatest(start, coalesce({before}, 0))) as fresh").groupBy("doc_id", "mark").agg(F.sum("fresh").cast("long").alias("n_hit"))
    n_items = items.count()
    named = found.select("doc_id", "mark", "window").distinct().join(_small(items, n_items), "window").select("doc_id", "mark", "item_id").distinct()
    listed = named.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item_id")), ",").cast("binary"), 256).alias("items_sha256"))
    return hit.alias("h").join(listed.alias("l"), _same_doc("h", "l")).select("h.doc_id", "h.mark", "n_hit", "n_items", "items_sha256"), lengths


EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def annotate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, mark, n_words, n_hit, n_items, items_sha256, contaminated), one row for each row of ``docs``; mark is the
    hash of its text."""
    found, lengths = matches(docs, benchmark)
    joined = lengths.alias("d").join(found.alias("f"), _same_doc("d", "f"), "left")
    return joined.select(
        "d.doc_id", "d.mark", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.lit(EMPTY_SHA256)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without an occurrence of a benchmark window, all their columns kept."""
    ident, mark = fresh(docs, "ident", "mark")
    found = matches(docs, benchmark)[0].select(F.col("doc_id").alias(ident), F.col("mark").alias(mark))
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found[ident]) & (F.xxhash64(text_of("text")) == found[mark]), "left_anti")


def op6_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return annotate(docs, benchmark).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
