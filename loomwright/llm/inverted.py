"""Benchmark passages in training texts by a positional inverted index, in DataFrame functions only.

The index holds a posting (term, row, place) for each word of the texts that is
a word of the benchmark at all, and counts of each term. A window of a
benchmark item is looked up from its two rarest words: their lists, moved by
the words' offsets, are intersected by (row, place); windows that share the
pair and its distance, as neighbours and copies do, share that work. Where the
pair meets, the lists of the window's other words are intersected the same way,
and a place at which all of them meet is an exact match. Windows with a word
that no text has are given up at once.

near_items() gives proximity matches from the same lists: rows in which every
word of an item stands within a number of words of its rarest one.

Each text ends with an empty term, which carries its id and length, so that
one table, written once, is the whole index, and rows have fixed numbers.

Small tables (counted: at most ROWS rows and BYTES bytes) are joined by
broadcast. Beyond, keys with over 1 / MANY of a list's rows are dealt out into
parts of about BUCKET rows, with the other side's rows of those keys for each.

Defined results: null and empty texts have no words and no hit; an item without
words is no window; equal windows are one, of several items; rows of one item
id are one item, a null id the item ''; each document row is judged for itself,
so repeated rows repeat their result, null ids too; other columns are ignored;
an empty table of documents gives none, an empty benchmark no hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.sources.shared import written

#: Fixed: what a word is, after A-Z became small.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
#: What is joined by broadcast at most.
ROWS = 200_000
BYTES = 32 << 20
#: Keys with more than 1 / MANY of a list's rows (and over BUCKET) are dealt out; they are fewer than MANY.
MANY = 10_000
BUCKET = 100_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), CAPITALS, SMALL), F.lit(WORD), F.lit(0))


def meet(many: DataFrame, few: DataFrame, key: str, width: Column | None = None) -> DataFrame:
    """Inner join on a key that may be hot in `many`; `few` may have several rows a key. width: bytes of a row of `few`, if they have no bound."""
    size = few.agg(F.count("*").alias("rows"), F.sum(width if width is not None else F.lit(1)).alias("bytes")).first()
    if size["rows"] <= ROWS and (size["bytes"] or 0) <= BYTES:
        return many.join(F.broadcast(few), key)
    counts = many.groupBy(key).agg(F.count("*").alias("_rows"))
    most = max(BUCKET, (counts.agg(F.sum("_rows")).first()[0] or 0) // MANY)
    hot = F.broadcast(counts.where(F.col("_rows") > most).select(key, F.ceil(F.col("_rows") / most).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = many.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(*many.columns), parts).cast("int")).drop("_parts")
    copied = few.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copied, [key, "_part"]).drop("_part")


class Index:
    """Postings of the texts' words that the benchmark has, and the benchmark in the same terms."""

    def __init__(self, docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str):
        asked = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words(F.col(item_text)).alias("words")).where(F.size("words") > 0)
        asked = written(asked.withColumn("number", F.monotonically_increasing_id()), "items")
        vocabulary = asked.select(F.explode("words").alias("word")).distinct().unionByName(docs.sparkSession.createDataFrame([("",)], "word string"))
        vocabulary = written(vocabulary.withColumn("term", F.monotonically_increasing_id()), "vocabulary")
        texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.concat(words(F.col(text)), F.array(F.lit(""))).alias("words"))
        places = texts.select("row", "doc_id", F.posexplode("words").alias("at", "word"))
        found = meet(places, vocabulary, "word", F.octet_length("word"))
        last = F.col("word") == ""
        self.all = written(found.select("row", "at", F.when(~last, F.col("term")).alias("term"), F.when(last, F.col("doc_id")).alias("doc_id")), "postings")
        #: doc_id and words of each text.
        self.texts = self.all.where("term IS NULL").select("row", "doc_id", F.col("at").cast("long").alias("n_words"))
        self.postings = self.all.where("term IS NOT NULL").select("term", "row", "at")
        counts = written(self.postings.groupBy("term").agg(F.count("*").alias("n")), "counts")
        counted = vocabulary.join(counts, "term", "left").select("word", "term", F.coalesce("n", F.lit(0)).alias("n"))
        spelled = meet(asked.select("number", F.posexplode("words").alias("at", "word")), counted, "word", F.octet_length("word"))
        spelled = spelled.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("at", "term", "n"))).alias("terms"))
        #: item and its terms in order, with their counts.
        self.items = asked.select("number", "item").join(spelled, "number").drop("number")

    def windows(self, width: int) -> tuple[DataFrame, DataFrame]:
        """Distinct windows (window, terms, pair, offset), given by their two rarest words (pair: first, second and the gap), and the items of each (window, item)."""
        cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size("terms") - width, F.lit(0))), lambda s: F.slice("terms", s + 1, F.lit(width)))
        every = self.items.select("item", F.explode(cut).alias("w")).where(F.forall("w", lambda t: t["n"] > 0)).select("item", F.transform("w", lambda t: t["term"]).alias("terms"), F.transform("w", lambda t: t["n"]).alias("n"))
        distinct = written(every.groupBy("terms").agg(F.first("n").alias("n")).withColumn("window", F.monotonically_increasing_id()), "windows")
        rare = F.slice(F.array_sort(F.transform("n", lambda n, i: F.struct(n.alias("n"), i.cast("int").alias("i")))), 1, 2)
        one, two = F.col("rare")[0]["i"], F.coalesce(F.get("rare", F.lit(1))["i"], F.col("rare")[0]["i"])
        term = lambda i: F.element_at("terms", i + 1)
        windows = distinct.withColumn("rare", rare).select("window", "terms", F.struct(term(one).alias("first"), term(two).alias("second"), (two - one).alias("gap")).alias("pair"), one.alias("offset"))
        return windows, meet(every.select("terms", "item"), distinct.select("terms", "window"), "terms", F.size("terms") * 8 + 32).select("window", "item").distinct()

    def phrases(self, windows: DataFrame) -> DataFrame:
        """row, place and window of each exact occurrence; a written table."""
        sides = F.array(F.struct(F.col("pair.first").alias("term"), F.lit(0).alias("shift"), F.lit(1).alias("side")), F.struct(F.col("pair.second").alias("term"), F.col("pair.gap").alias("shift"), F.lit(2).alias("side")))
        lists = windows.select("pair").distinct().select("pair", F.explode(sides).alias("s")).select("pair", "s.*")
        moved = meet(self.postings, lists, "term").select("row", (F.col("at") - F.col("shift")).alias("at"), "pair", "side")
        both = moved.groupBy("row", "at", "pair").agg(F.bit_or("side").alias("sides")).where("sides = 3").select("row", "at", "pair")
        near = meet(both, windows, "pair", F.size("terms") * 8 + 32)
        near = written(near.select("row", (F.col("at") - F.col("offset")).alias("at"), "window", "terms").where("at >= 0"), "near")
        wanted = near.select("row", "window", "at", F.size("terms").alias("size"), F.posexplode("terms").alias("k", "term")).select("row", "window", F.col("at").alias("start"), "size", "term", (F.col("at") + F.col("k")).alias("at"))
        met = wanted.join(self.postings, ["row", "at", "term"])
        return written(met.groupBy("row", "start", "window").agg(F.count("*").alias("n"), F.first("size").alias("size")).where("n = size").select("row", F.col("start").alias("at"), "size", "window"), "phrases")

    def near_items(self, within: int) -> DataFrame:
        """Proximity matches: row, item and place of the rarest word, where each word of the item stands at most `within` words from it."""
        block = lambda at: F.floor(at / within).cast("long")
        known = self.items.where(F.forall("terms", lambda t: t["n"] > 0)).withColumn("least", F.array_min(F.transform("terms", lambda t: F.struct(t["n"].alias("n"), t["term"].alias("term"))))["term"])
        known = known.select("item", "least", F.array_distinct(F.transform("terms", lambda t: t["term"])).alias("terms")).distinct()
        known = written(known.withColumn("number", F.monotonically_increasing_id()), "bags")
        spots = meet(self.postings, known.select(F.col("least").alias("term"), "number"), "term").select("row", "number", F.col("at").alias("spot"))
        others = known.select("number", "least", F.explode("terms").alias("term")).where("term <> least")
        asked = spots.select("row", "number", "spot", F.explode(F.sequence(block(F.col("spot") - within), block(F.col("spot") + within))).alias("block"))
        offered = meet(self.postings, others.select("term", "number"), "term").withColumn("block", block(F.col("at")))
        hits = asked.join(offered, ["row", "number", "block"]).where(F.abs(F.col("at") - F.col("spot")) <= within).groupBy("row", "number", "spot").agg(F.count_distinct("term").alias("n"))
        needed = known.select("number", "item", (F.size("terms") - 1).alias("needed"))
        single = meet(spots, needed.where("needed = 0"), "number")
        return meet(hits, needed, "number", F.octet_length("item")).where("n = needed").select("row", "item", F.col("spot").alias("at")).unionByName(single.select("row", "item", F.col("spot").alias("at")))


def build_index(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> Index:
    return Index(docs, items, doc_id, text, item_id, item_text)


def contamination(index: Index, width: int = WINDOW) -> DataFrame:
    """doc_id, n_words, hit words (in any occurrence of a window) and the items (sorted as strings) with occurring windows, of each text."""
    windows, members = index.windows(width)
    windows, members = written(windows, "windows"), written(members, "members")
    found = index.phrases(windows)
    spans = found.groupBy("row", "at").agg(F.max("size").alias("size")).select("row", F.col("at").cast("long").alias("a"), (F.col("at") + F.col("size")).cast("long").alias("b"))
    before = F.max("b").over(Window.partitionBy("row").orderBy("a").rowsBetween(Window.unboundedPreceding, -1))  # a text's own spans, one a place
    hit = spans.select("row", F.greatest(F.col("b") - F.greatest(F.col("a"), F.coalesce(before, F.lit(0))), F.lit(0)).alias("n")).groupBy("row").agg(F.sum("n").alias("n_hit"))
    items = meet(found.select("row", "window").distinct(), members, "window", F.octet_length("item")).groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    told = index.texts.join(hit, "row", "left").join(items, "row", "left")
    return told.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def digest(contaminated: DataFrame) -> DataFrame:
    return contaminated.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
