"""Benchmark decontamination by a positional inverted index, in DataFrame operations alone.

Index: (term, doc, pos) of every document word that a benchmark item holds, written sorted by term within each shard of
documents. Search: every window of an item is led by its two rarest terms; postings of the rarest are intersected with those
of the second at their distance, and the few places left are checked at all other offsets of the item. Found places are kept
as (doc, item, diagonal) with the item positions that match there, so a long passage is one row and not one a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as c

#: Positions take the low bits of a posting's key, terms the high ones.
POSITION_BITS = 31
TERM_SHARDS = 64
#: What stands between words, before capitals become small: what the class of word characters leaves out, less the capitals.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Stands in the word list of a document behind its last word; no word holds a space. Its posting has the number of words as position.
END, END_TERM = " ", -1


def cased_words(text: Column) -> Column:
    """Words of a text, with an empty one in front or behind where a separator stands there. Splitting at separators is several times faster than extracting words."""
    return F.split(F.coalesce(text, F.lit("")), SEPARATORS)


def small(word: Column) -> Column:
    """ASCII capitals of a word become small; most words have none, and lower() tells that cheaply."""
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, c.CAPITALS, c.SMALL))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """((key, id, text) with a key for each row, whether the key is another than the id)."""
    own, key = c.with_key(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), "id")
    return own.select(F.col(key).cast("long").alias("key"), "id", "text"), key != "id"


def item_words(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, item_id, ip, word, n): the words of each item; wordless items have none."""
    own = items.select(items[item_col].cast("string").alias("item_id"), F.array_remove(cased_words(items[text_col]), "").alias("w"))
    own = c.written(own.filter(F.size("w") > 0).select(F.monotonically_increasing_id().alias("item"), "item_id", "w"), "items")
    return own.select("item", "item_id", F.size("w").alias("n"), F.posexplode("w").alias("ip", "word")).withColumn("word", small(F.col("word")))


def vocabulary(words: DataFrame) -> DataFrame:
    """(word, term): small numbers for distinct words, given within shards."""
    shards = words.select("word").distinct().withColumn("shard", F.pmod(F.xxhash64("word"), F.lit(TERM_SHARDS)))
    number = F.row_number().over(Window.partitionBy("shard").orderBy("word"))
    return shards.select("word", ((number - 1) * TERM_SHARDS + F.col("shard")).cast("long").alias("term"))


def posting(term: Column, pos: Column) -> Column:
    return F.shiftleft(term.cast("long"), POSITION_BITS).bitwiseOR(pos.cast("long"))


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored index: (term, key, pos), and a row (END_TERM, key, number of words) for each document, from one pass over the texts. docs: (key, text)."""
    split = docs.select("key", cased_words(F.col("text")).alias("w"))
    before = (F.get("w", F.lit(0)) == "").cast("int")
    behind = ((F.size("w") > 1) & (F.get("w", F.size("w") - 1) == "")).cast("int")
    split = split.select("key", before.alias("before"), (F.size("w") - before - behind).alias("n"), F.concat("w", F.array(F.lit(END))).alias("w"))
    tokens = split.select("key", "before", "n", F.posexplode("w").alias("at", "word")).withColumn("word", small(F.col("word")))
    known = terms.select("word", "term").union(docs.sparkSession.range(1).select(F.lit(END).alias("word"), F.lit(END_TERM).cast("long").alias("term")))
    found = tokens.join(c.broadcast_if_small(known, 32), "word")
    found = found.select("term", "key", F.when(F.col("term") == END_TERM, F.col("n")).otherwise(F.col("at") - F.col("before")).alias("pos"))
    return c.written(found.sortWithinPartitions("term"), "postings")


def led_by(places: DataFrame, frequency: DataFrame, window: int) -> DataFrame:
    """(item, term1, ip1, term2, ip2, lo, hi): the two rarest terms of each window and the item positions of all windows that share them. A window with a term that no document holds leads nowhere."""
    f = places.join(c.broadcast_if_small(frequency, 32), "term", "left").withColumn("f", F.coalesce("f", F.lit(0)))
    last = F.greatest(F.lit(0), F.col("n") - window)
    starts = F.sequence(F.greatest(F.lit(0), F.col("ip") - (window - 1)), F.least(F.col("ip"), last))
    w = f.select("item", "n", F.explode(starts).alias("s"), F.struct("f", "ip", "term").alias("t")).groupBy("item", "n", "s").agg(F.sort_array(F.collect_list("t")).alias("t"))
    w = w.filter(F.col("t")[0]["f"] > 0)
    second = F.try_element_at("t", F.lit(2))
    w = w.select("item", "n", "s", F.col("t")[0]["term"].alias("term1"), F.col("t")[0]["ip"].alias("ip1"), second["term"].alias("term2"), second["ip"].alias("ip2"))
    return w.groupBy("item", "n", "term1", "ip1", "term2", "ip2").agg(F.min("s").alias("lo"), (F.max("s") + F.least(F.lit(window), F.col("n")) - 1).alias("hi"))


def places_found(index: DataFrame, places: DataFrame, frequency: DataFrame, window: int) -> DataFrame:
    """(key, item, n, diagonal, m): item positions m, rising, at which the document has the item's word on that diagonal, around places that the two rarest terms found."""
    leads = c.written(led_by(places, frequency, window), "leads")
    first = index.join(c.broadcast_if_small(leads, 64), index["term"] == leads["term1"])
    first = first.select("key", "item", "n", (F.col("pos") - F.col("ip1")).alias("diagonal"), "term2", "ip2", "lo", "hi")
    alone = first.filter("term2 is null")
    seconds = c.broadcast_if_small(leads.select(F.col("term2").alias("term")).distinct(), 16)
    with_second = index.join(seconds, "term", "left_semi").select("key", posting(F.col("term"), F.col("pos")).alias("p"))
    paired = first.filter("term2 is not null and diagonal + ip2 >= 0").withColumn("p", posting(F.col("term2"), F.col("diagonal") + F.col("ip2"))).join(with_second, ["key", "p"])
    cols = ["key", "item", "n", "diagonal", "lo", "hi"]
    near = c.written(paired.select(*cols).union(alone.select(*cols)), "near")
    hoped = near.select("key", "item", "n", "diagonal", F.explode(F.sequence("lo", "hi")).alias("ip")).distinct()
    hoped = hoped.filter("diagonal + ip >= 0").join(c.broadcast_if_small(places.select("item", "ip", "term"), 32), ["item", "ip"]).withColumn("p", posting(F.col("term"), F.col("diagonal") + F.col("ip")))
    asked = c.broadcast_if_small(near.select("key").distinct(), 16)  # postings of other documents don't move
    every = index.join(asked, "key", "left_semi").select("key", posting(F.col("term"), F.col("pos")).alias("p"))
    return hoped.join(every, ["key", "p"]).groupBy("key", "item", "n", "diagonal").agg(F.sort_array(F.collect_set("ip")).alias("m"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """One row per input row: id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is `window` consecutive words of an item, or all words of a shorter one. Null and wordless texts have no words;
    items without words have no window; rows of one item_id count as one item, a null item_id hits words but is no item.
    Repeated and null document ids are told apart by row. Other columns are not read. Empty tables give no rows, or no hits.
    """
    own, named = keyed(docs, id_col, text_col)
    words = item_words(benchmark, item_col, item_text_col)
    terms = c.written(vocabulary(words), "terms")
    places = c.written(words.join(terms, "word").select("item", "item_id", "n", "ip", "term"), "places")
    stored = build_index(own.select("key", "text"), terms)
    index = stored.filter(F.col("term") != END_TERM)
    frequency = c.written(index.groupBy("term").agg(F.count("*").alias("f")), "frequency")
    found = places_found(index, places, frequency, window)
    w = F.least(F.lit(window), F.col("n"))
    starts = F.filter(F.sequence(F.lit(0), F.size("m") - w), lambda i: F.get("m", i + w - 1) == F.get("m", i) + w - 1)
    full = found.filter(F.size("m") >= w).withColumn("starts", F.transform(starts, lambda i: F.get("m", i) + F.col("diagonal"))).filter(F.size("starts") > 0)
    full = c.written(full.select("key", "item", F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + w - 1)))).alias("hit")), "hits")
    n_hit = full.select("key", F.explode("hit").alias("pos")).distinct().groupBy("key").agg(F.count("*").alias("n_hit"))
    ids = places.select("item", "item_id").distinct()
    by_item = full.select("key", "item").distinct().join(c.broadcast_if_small(ids, 32), "item").filter("item_id is not null").groupBy("key").agg(F.sort_array(F.collect_set("item_id")).alias("hit_items"))
    counted = stored.filter(F.col("term") == END_TERM).select("key", F.col("pos").cast("long").alias("n_words"))
    counted = counted.join(own.select("key", "id"), "key") if named else counted.withColumn("id", F.col("key").cast(docs.schema[id_col].dataType))
    out = counted.join(n_hit.join(by_item, "key", "left"), "key", "left")
    items = F.coalesce("hit_items", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0))
    return out.select(F.col("id").alias(id_col), "n_words", hit.cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def proximity_matches(index: DataFrame, pairs: DataFrame, slop: int = 8) -> DataFrame:
    """(pair, key, pos1, pos2): places where both terms of a pair (pair, term1, term2) stand at most slop words apart.

    Positions go into bins of slop + 1 words; the rarer term's postings look into their own bin and its two neighbours, so
    equal keys meet and no list is multiplied by another.
    """
    width = slop + 1
    frequency = index.groupBy("term").agg(F.count("*").alias("f"))
    p = pairs.join(frequency.withColumnsRenamed({"term": "term1", "f": "f1"}), "term1").join(frequency.withColumnsRenamed({"term": "term2", "f": "f2"}), "term2")
    p = p.select("pair", F.when(F.col("f1") <= F.col("f2"), F.col("term1")).otherwise(F.col("term2")).alias("rare"), F.when(F.col("f1") <= F.col("f2"), F.col("term2")).otherwise(F.col("term1")).alias("other"), (F.col("f1") <= F.col("f2")).alias("kept"))
    led = index.withColumnRenamed("term", "rare").join(p, "rare").select("pair", "key", "other", "kept", F.col("pos").alias("a"), F.explode(F.array(*[F.floor(F.col("pos") / width) + d for d in (-1, 0, 1)])).alias("bin"))
    met = led.join(index.select(F.col("term").alias("other"), "key", F.col("pos").alias("b"), F.floor(F.col("pos") / width).alias("bin")), ["key", "other", "bin"]).filter((F.abs(F.col("a") - F.col("b")) <= slop) & (F.col("a") != F.col("b")))
    return met.select("pair", "key", F.when(F.col("kept"), F.col("a")).otherwise(F.col("b")).alias("pos1"), F.when(F.col("kept"), F.col("b")).otherwise(F.col("a")).alias("pos2"))
