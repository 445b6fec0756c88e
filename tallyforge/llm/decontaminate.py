"""Benchmark decontamination over a distributed positional inverted index, in DataFrame operations only.

Training postings (term, document, position) are made for the rarest terms of each test window; their offset-adjusted
positions give the only places where a window can begin, and the words there and around tell exact phrases and
proximity matches.  Rarity is counted over all training text.  The windows are broadcast only while their number is
under a limit; beyond it the same postings are joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm import _run as R

#: Fixed value: what stands between words, after A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_TERMS = 500_000
NEVER = ""  # no word is empty: it marks the row that stands for a document itself


def words(text: Column) -> Column:
    """Words of a whole text; none for null. Pure ASCII text takes the cheap lower(); splitting costs a fifteenth of
    extracting, and leaves an empty piece at either end at most."""
    ascii_only = F.octet_length(text) == F.length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.array_remove(F.split(lowered, BETWEEN), NEVER), F.array().cast("array<string>"))


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(window, length, items): each distinct run of ``size`` words, or a shorter item's whole words, and the items that hold it."""
    split = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where((F.size("w") > 0) & F.col("item").isNotNull())
    begins = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))).alias("at")
    cutout = split.select("item", "w", begins).select("item", F.slice("w", F.col("at"), size).alias("window"))
    return cutout.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumn("length", F.size("window"))


def _anchors(docs: DataFrame, grams: DataFrame, text_col: str, small: bool, anchors: int = 1) -> DataFrame:
    """(term, place): for each test window its ``anchors`` rarest terms in training, with their offsets in the window.
    One is enough for exact matches; near ones may lack it, so they are looked for around several."""
    hint = F.broadcast if small else (lambda df: df)
    vocabulary = grams.select(F.explode("window").alias("term")).distinct()
    tokens = docs.select(F.explode(words(F.col(text_col))).alias("term"))
    seen = tokens.join(hint(vocabulary), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    seen = R.cut(seen)
    terms = grams.select("window", "items", "length", F.posexplode("window").alias("offset", "term"))
    rated = terms.join(seen, "term", "left").withColumn("rated", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "offset")).groupBy("window", "items", "length")
    if anchors == 1:
        # a window with a term that training never holds cannot occur exactly
        rated = rated.agg(F.min("rated").alias("rarest")).where(F.col("rarest.n") > 0)
    else:
        known = F.filter(F.sort_array(F.collect_list("rated")), lambda x: x["n"] > 0)
        rated = rated.agg(known.alias("known")).select("window", "items", "length", F.explode(F.slice("known", 1, anchors)).alias("rarest"))
    place = F.struct(F.col("rarest.offset").alias("offset"), "length", "window", "items")
    return rated.select(F.col("rarest.term").alias("term"), place.alias("place"))


def postings(docs: DataFrame, places: DataFrame, id_col: str, text_col: str, small: bool, size: int = WINDOW, slack: int = 0, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """Offset-adjusted postings: (id, key, n_words, start, place, found, around) and a row of null place for each document.

    ``found`` are the words where the window would be, ``around`` those and ``slack`` more on either side. Only a
    document's own row has its number of words. While the windows are few they are sent to every task and looked up
    where the text is. Beyond that a posting carries its neighbourhood to its term's task; while the terms are few, only
    postings of terms that are sought leave the text, and the documents' own rows never do.
    """
    reach = size - 1 + slack
    spread = docs.select(F.col(id_col).alias("id"), R.doc_key(id_col, text_col).alias("key"), words(F.col(text_col)).alias("w"))
    if small:
        # a document's own row rides along, so that no second pass over the texts is needed
        tokens = spread.select("id", "key", F.concat("w", F.array(F.lit(NEVER))).alias("w")).select("id", "key", "w", F.posexplode("w").alias("pos", "term"))
        grouped = places.groupBy("term").agg(F.collect_list("place").alias("places"))
        met = tokens.join(F.broadcast(grouped), "term", "left").where(F.col("places").isNotNull() | (F.col("term") == NEVER))
        met = met.select("id", "key", "w", "pos", F.explode_outer("places").alias("place"), F.lit(0).alias("from"), (F.size("w") - 1).alias("last"))
        own = None
    else:
        tokens = spread.select("id", "key", "w", F.posexplode("w").alias("pos", "term"))
        terms = places.select("term").distinct()
        if terms.limit(broadcast_terms + 1).count() <= broadcast_terms:
            tokens = tokens.join(F.broadcast(terms), "term", "left_semi")
        first = F.greatest(F.col("pos") - reach, F.lit(0))
        narrow = tokens.select("id", "key", "pos", "term", F.slice("w", first + 1, 2 * reach + 1).alias("w"), first.alias("from"))
        met = narrow.join(places, "term").select("id", "key", "w", "pos", "place", "from", (F.col("from") + F.size("w")).alias("last"))
        own = spread.select("id", "key", F.size("w").alias("n_words"))
    start, length = F.col("pos") - F.col("place.offset"), F.col("place.length")
    at = start - F.col("from")
    found = F.when((start >= 0) & (start + length <= F.col("last")), F.slice("w", at + 1, length))
    low = F.greatest(at - slack, F.lit(0))
    around = F.slice("w", low + 1, F.greatest(F.least(at + length + slack, F.col("last") - F.col("from")) - low, F.lit(0))) if slack else found
    is_own = F.col("place").isNull()
    out = met.select("id", "key", F.when(is_own, F.col("pos")).alias("n_words"), F.when(~is_own, start).alias("start"), "place", found.alias("found"), around.alias("around"))
    if own is None:
        return out
    return out.unionByName(own, allowMissingColumns=True)


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = WINDOW, near_share: float = 1.0, near_anchors: int = 3, near_slack: int = 2, broadcast_windows: int = 200_000, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """(id, key, n_words, start, length, items, kind): one row for each match, and one with ``kind`` null for each document.

    ``kind`` is ``exact`` where all words of the window stand at their offsets. It is ``near`` where at least
    ``near_share`` of the window's distinct words stand in the place of the window or up to ``near_slack`` words beside
    it, in any order, one of the window's ``near_anchors`` rarest at its offset; so words may be changed, left out or put
    in. The default asks for exact ones alone. Null and empty texts have no match, null ids are ids like others, repeated
    rows have their matches each, ties among rare words go to the first by name and change no exact match, very long texts
    are searched whole, other columns are ignored, and an empty table of either kind gives no match.
    """
    grams = R.cut(windows(items, item_col, item_text, size))
    small = grams.count() <= broadcast_windows
    exact_only = near_share >= 1
    places = R.cut(_anchors(docs, grams, text_col, small, 1 if exact_only else near_anchors))
    met = postings(docs, places, id_col, text_col, small, size, 0 if exact_only else near_slack, broadcast_terms)
    exact = F.coalesce(F.col("found") == F.col("place.window"), F.lit(False))
    keep = exact
    if not exact_only:
        wanted = F.size(F.array_distinct("place.window"))
        keep = exact | (F.size(F.array_intersect("place.window", "around")) >= F.ceil(wanted * near_share))
    met = met.where(F.col("n_words").isNotNull() | keep)
    kind = F.when(F.col("n_words").isNull(), F.when(exact, "exact").otherwise("near"))
    out = met.select("id", "key", "n_words", "start", F.col("place.length").alias("length"), F.col("place.items").alias("items"), kind.alias("kind"))
    # several anchors of a window meet in one place; rows of documents have no kind and are all kept
    return out if exact_only else out.where("kind is null").unionByName(out.where("kind is not null").distinct())


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", **options) -> DataFrame:
    """One row for each document: id, n_words, n_hit, n_items, items_sha256, contaminated; ``key`` tells texts of one id apart.

    A document is contaminated when words inside exact window occurrences make up a twentieth of its words or more.
    Null and empty texts have no words and are clean; items without words or with a null id match nothing; repeated rows
    give equal rows, one each; a document of exactly a twentieth is contaminated; very long texts are searched whole; other
    columns are ignored; an empty table of either kind gives no hits. Matches are
    grouped by document only, so a passage or word of any frequency is spread over the documents that hold it.
    """
    met = matches(docs, items, id_col, text_col, item_col, item_text, **options)
    order = Window.partitionBy("id", "key").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    fresh = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(order), F.lit(0))))
    is_exact = F.coalesce(F.col("kind") == "exact", F.lit(False))
    runs = met.where(F.col("kind").isNull() | is_exact).withColumn("fresh", F.when(is_exact, fresh))
    out = runs.groupBy("id", "key").agg(
        F.max("n_words").cast("long").alias("n_words"), F.count("n_words").alias("copies"), F.coalesce(F.sum("fresh"), F.lit(0)).cast("long").alias("n_hit"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("found"),
    )
    # distinct windows may repeat across equal rows; fresh words are those of the first pass over the starts
    out = out.select(
        F.col("id").alias(id_col), "key", "n_words", "n_hit", F.size("found").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "found"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_"),
    )
    return out.drop("copy_")
