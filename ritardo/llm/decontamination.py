"""Benchmark decontamination over a distributed positional inverted index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ritardo.llm.common import ascii_lower, row_key, stored

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DOC = " "  # a posting that stands for the document itself; never a word
SMALL = 1_000_000  # test words up to which the test side is broadcast; beyond it, joins shuffle


def words_of(text: Column) -> Column:
    """Words after A-Z are lowered; null has none. May begin or end with an empty string."""
    return F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS)


@dataclass
class PositionalIndex:
    """``postings``: (doc_id, key, term, pos), a stored table; ``documents``: one row per row."""

    postings: DataFrame
    documents: DataFrame


def test_positions(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, p, word, n): the words of each test item, numbered from 0, and how many there are.

    Rows that share an id are told apart by a hash of their text; equal rows are one.
    """
    w = F.filter(words_of(F.col(text_col)), lambda x: x != "")
    return items.select(F.col(id_col).alias("item_id"), row_key(id_col, text_col).alias("item"),
                        w.alias("w")).distinct().select(
        "item_id", "item", F.size("w").alias("n"), F.posexplode("w").alias("p", "word"))


def build_index(docs: DataFrame, terms: DataFrame, small: bool, id_col: str = "doc_id",
                text_col: str = "text") -> PositionalIndex:
    """Postings of the given terms (word, term) in all documents, stored in document order."""
    d = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"),
                    words_of(F.col(text_col)).alias("w"))
    blank = F.lit("")
    n = F.size("w") - (F.element_at("w", 1) == blank).cast("int") - (
        (F.element_at("w", -1) == blank) & (F.size("w") > 1)).cast("int")
    rows = d.select("doc_id", "key", n.alias("n_words"), F.posexplode(
        F.concat(F.array(F.lit(DOC)), F.col("w"))).alias("pos", "word"))
    own = terms.sparkSession.createDataFrame([(DOC, -1)], "word string, term bigint")
    t = terms.select("word", "term").unionByName(own)
    hit = rows.join(F.broadcast(t) if small else t, "word")
    every = stored(hit.select("doc_id", "key", "n_words", "term", "pos"), "postings")
    return PositionalIndex(every.where("term >= 0").select("doc_id", "key", "term", "pos"),
                           every.where("term < 0").select("doc_id", "key", "n_words"))


def phrase_matches(docs: DataFrame, items: DataFrame, window: int = 13, gap: int = 0,
                   id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
                   item_text: str = "text", small_limit: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """Occurrences of test windows in documents: (spans, documents).

    ``spans``: doc_id, key, item_id, item, ``lo``, ``hi`` (word positions, inclusive, counted in
    the index; only differences and sets of them matter), one row per stretch of a document that
    windows of an item cover. ``documents``: doc_id, key, n_words, one row per input row.

    1. The postings of all test terms are stored with their positions, and counted by term.
    2. In each window the two rarest places are chosen. Their lists, moved by the place's offset,
       are intersected: both must put the item at the same place of the document.
    3. For the places that remain, the lists of the other terms are intersected at their offsets.

    An item of fewer words than ``window``, but at least one, is a single window. ``gap`` > 0 gives
    proximity matches instead: a window then counts when both rarest terms stand within ``gap``
    words of their places, reported as the stretch it would cover. Null and empty texts have no
    words and no matches; repeated rows give the same spans once, and all their rows in
    ``documents``. Extra columns are ignored.
    """
    test = stored(test_positions(items, item_id, item_text), "test")
    n_test = test.count()
    small = n_test <= small_limit
    hint = F.broadcast if small else (lambda x: x)
    # numbers in place of words keep the postings small; stored, they no longer change
    terms = stored(test.select("word").distinct().withColumn(
        "term", F.monotonically_increasing_id()), "terms")
    test = test.join(hint(terms), "word")
    index = build_index(docs, terms, small, id_col, text_col)
    df = index.postings.groupBy("term").agg(F.count("*").alias("df"))
    test = stored(test.join(hint(df), "term").select(
        "item_id", "item", "n", "p", "term", "df"), "ranked")  # terms of no document drop out
    # windows whose terms all occur, with their two rarest places
    starts = test.select("item_id", "item", "n", "p", "term", "df", F.explode(F.sequence(
        F.greatest(F.col("p") - (window - 1), F.lit(0)),
        F.least(F.col("p"), F.greatest(F.col("n") - window, F.lit(0))))).alias("start"))
    rare = F.sort_array(F.collect_list(F.struct("df", "p", "term")))
    width = F.least(F.first("n"), F.lit(window))
    windows = starts.groupBy("item_id", "item", "start").agg(
        F.slice(rare, 1, 2).alias("rare"), F.count("*").alias("got"), width.alias("width"))
    windows = stored(windows.where("got = width").select(
        "item_id", "item", "start", "width", F.col("rare")[0]["p"].alias("p1"),
        F.col("rare")[0]["term"].alias("t1"),
        F.when(F.col("width") > 1, F.col("rare")[1]["p"]).alias("p2"),
        F.when(F.col("width") > 1, F.col("rare")[1]["term"]).alias("t2")), "windows")
    spots = windows.select("item", F.col("p1").alias("p"), F.col("t1").alias("term")).union(
        windows.where("p2 is not null").select("item", "p2", "t2")).distinct()
    moved = index.postings.join(hint(spots), "term").select(
        "doc_id", "key", "item", "p", (F.col("pos") - F.col("p")).alias("shift"))
    if gap:
        return _near(moved, windows, gap), index.documents
    # lists of the rarest places meet at one shift of (document, item)
    at = moved.groupBy("key", "item", "shift").agg(
        F.first("doc_id").alias("doc_id"), F.collect_set("p").alias("ps"))
    pairs = windows.groupBy("item").agg(F.first("item_id").alias("item_id"), F.collect_list(
        F.struct("start", "width", "p1", "p2")).alias("ws"))
    ok = F.filter("ws", lambda w: F.array_contains("ps", w["p1"]) & (
        w["p2"].isNull() | F.array_contains("ps", w["p2"])))
    open_ = at.join(hint(pairs), "item").select(
        "doc_id", "key", "item_id", "item", "shift", ok.alias("ws")).where(F.size("ws") > 0)
    need = F.array_sort(F.array_distinct(F.flatten(F.transform("ws", lambda w: F.sequence(
        w["start"], w["start"] + w["width"] - 1)))))
    open_ = stored(open_.select("*", need.alias("need")), "open")
    wanted = open_.select("key", "item", "shift", F.explode("need").alias("p")).join(
        hint(test.select("item", "p", "term")), ["item", "p"]).select(
        "key", "item", "shift", "p", "term", (F.col("p") + F.col("shift")).alias("pos"))
    held = wanted.join(index.postings.select("key", "term", "pos").distinct(),
                       ["key", "term", "pos"]).groupBy("key", "item", "shift").agg(
        F.collect_set("p").alias("held"))
    full = F.filter("ws", lambda w: F.size(F.array_except(F.sequence(
        w["start"], w["start"] + w["width"] - 1), "held")) == 0)
    spans = open_.join(held, ["key", "item", "shift"]).select(
        "doc_id", "key", "item_id", "item", "shift", F.explode(full).alias("w"))
    return spans.select("doc_id", "key", "item_id", "item", (F.col("w.start") + F.col(
        "shift")).alias("lo"), (F.col("w.start") + F.col("w.width") + F.col("shift") - 1).alias(
        "hi")), index.documents


def _near(moved: DataFrame, windows: DataFrame, gap: int) -> DataFrame:
    """Windows whose two rarest terms stand within ``gap`` words of their places.

    Shifts are met in cells of ``gap`` + 1, each also looked up in the next cell.
    """
    cell = F.floor(F.col("shift") / (gap + 1)).cast("bigint")
    a = moved.withColumn("cell", cell).join(windows.select("*", F.col("p1").alias("p")), ["item", "p"])
    b = moved.select("key", "item", F.col("p").alias("p2"), F.col("shift").alias("other"),
                     F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    both = a.where("p2 is not null").join(b, ["key", "item", "p2", "cell"]).where(
        F.abs(F.col("shift") - F.col("other")) <= gap)
    return both.unionByName(a.where("p2 is null").withColumn("other", F.col("shift"))).select(
        "doc_id", "key", "item_id", "item", (F.col("start") + F.least("shift", "other")).alias(
            "lo"), (F.col("start") + F.col("width") - 1 + F.greatest("shift", "other")).alias(
            "hi")).distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20,
                  id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """Per document row: doc_id, key, n_words, n_hit, n_items, item_ids, contaminated.

    A word inside any occurring window is hit; a document is contaminated when some word is hit
    and the hits times ``share`` reach its words. Documents without words are not.
    """
    spans, rows = phrase_matches(docs, items, window, id_col=id_col, text_col=text_col,
                                 item_id=item_id, item_text=item_text)
    s = spans.select("key", "item_id", "lo", "hi").distinct()
    hit = s.select("key", F.explode(F.sequence("lo", "hi")).alias("pos")).distinct().groupBy(
        "key").agg(F.count("*").alias("n_hit"))
    its = s.select("key", "item_id").distinct().groupBy("key").agg(
        F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("item_ids"),
        F.count("item_id").alias("n_items"))
    out = rows.join(hit, "key", "left").join(its, "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return out.select(
        "doc_id", "key", F.col("n_words").cast("bigint").alias("n_words"), n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"))
