"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Numbers, names (capitalised words that begin no sentence) and units (a known unit after a number) become typed
slots, the other words are lower-cased and stripped of punctuation. Windows of eight tokens of the benchmark items and of
every whole text are joined on three hashes: of their templates, of their templates with names spelt out, and of their plain
words with all values. So a copy is looked up by its words however its surroundings or case let a name be read. Where enough windows of an item follow each
other in a text, the slots of the matched stretch are aligned: one value of the item must always stand for
the same value of the text. So a question is also found with other numbers, names or units in it, and two
texts that merely share a form are not.

A text holds an item if, on one alignment, ``run`` tokens in a row (of a shorter item: all but two, a window's at
least) match as templates, at least half of these are words that match literally or slots with equal values, and the slots are consistent.
A name and the same word read as no name are equal. The queries test every stretch of at least that many tokens (``stretches``), so an
edit that breaks the consistency of a long copy doesn't hide what is copied around it; without it only the longest run is tested.

Windows with fewer than three words outside slots are no evidence as templates: they are looked up with the values of their slots.
An item shorter than a window is looked up whole.

Edge cases: null and empty texts and items hold nothing; repeated rows are each reported alike; a null doc_id
is reported as null; other columns are ignored by ``leaks`` and kept by ``clean``; empty tables give empty results.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.shared import written

WINDOW = 8
RUN = 13
LITERALS = 3
NUMBER, UNIT, NAME, JOINT = "\u0001", "\u0002", "\u0003", "\u0004"
# Unit words, read after a number only.
UNITS = ("km", "m", "cm", "mm", "mi", "mile", "miles", "meter", "meters", "metre", "metres", "ft", "feet", "foot", "inch", "inches", "yard", "yards",
         "kg", "g", "mg", "lb", "lbs", "oz", "pound", "pounds", "gram", "grams", "ton", "tons", "l", "ml", "liter", "liters", "litre", "litres", "gallon", "gallons",
         "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
         "percent", "dollar", "dollars", "euro", "euros", "cent", "cents", "usd", "eur", "mph", "kmh", "degrees", "kb", "mb", "gb", "hz", "watts", "volts")


def tokens(text: Column) -> Column:
    """Words in order; a slot is its type's control character followed by its value.

    Passes that can change nothing are left out: text without a digit has no number and no unit. Patterns look behind a
    character only where that character itself fits.
    """
    t = F.coalesce(text.cast("string"), F.lit(""))
    t = F.when(t.rlike(f"[{NUMBER}-{JOINT}]"), F.translate(t, NUMBER + UNIT + NAME + JOINT, "    ")).otherwise(t)
    t = F.regexp_replace(t, r"[^\S ]\s*| \s+", " ")
    t = F.lower(F.regexp_replace(t, r"(?=\p{Lu})(?<=[\p{Ll}\p{N},;:] )(\p{Lu}\p{Ll}+)(?![\p{L}\p{N}])", NAME + "$1"))
    n = F.regexp_replace(t, r"[.,:/](?=[0-9])(?<=[0-9][.,:/])", JOINT)
    n = F.regexp_replace(n, rf"(?=[0-9])(?<![\p{{L}}\p{{N}}{JOINT}])([0-9][0-9{JOINT}]*)", f" {NUMBER}$1 ")
    n = F.regexp_replace(n, rf"({NUMBER}[0-9{JOINT}]+ +)({'|'.join(sorted(UNITS, key=len, reverse=True))})(?![\p{{L}}\p{{N}}])", f"$1{UNIT}$2")
    t = F.when(t.rlike("[0-9]"), n).otherwise(t)
    return F.array_remove(F.split(t, rf"[^\p{{L}}\p{{N}}{NUMBER}-{JOINT}]+"), "")


def value(word: Column) -> Column:
    """The plain word of a token, whatever slot it was read as."""
    return F.when(word < JOINT, F.substring(word, 2, 1 << 30)).otherwise(word)


def template_hashes(words: Column) -> Column:
    """One number a token: 1 to 3 for a slot's type, else a hash of the word."""
    return F.transform(words, lambda w: F.when(w < JOINT, F.ascii(w).cast("long")).otherwise(F.xxhash64(w)))


def named_hashes(words: Column) -> Column:
    """As ``template_hashes``, but a name is a word like any other."""
    return F.transform(words, lambda w: F.when(w < NAME, F.ascii(w).cast("long")).otherwise(F.xxhash64(value(w))))


def plain_hashes(words: Column) -> Column:
    """A hash of every token's plain word."""
    return F.transform(words, lambda w: F.xxhash64(value(w)))


FORMS = {"template": template_hashes, "named": named_hashes, "plain": plain_hashes}


def _windows_of_sizes(forms: dict[str, Column], sizes: list[int]) -> Column:
    """Every window's size, position and keys. A window has a key of its own as "named" if it holds a name, as "plain" if it holds a number or unit."""
    def key(name: str, size: int, i: Column) -> Column:
        return F.struct(F.lit(name).alias("form"), F.lit(size).alias("size"), (i - 1).cast("int").alias("pos"), F.xxhash64(F.slice(forms[name], i, size)).alias("key"))

    def of(name: str, size: int) -> Column:
        last = F.size(forms["template"]) - size + 1
        if name == "template":
            at = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        else:
            slots = F.filter(forms["slots"], lambda s: (s["kind"] == 3) if name == "named" else (s["kind"] < 3))
            at = F.array_distinct(F.flatten(F.transform(F.filter(slots, lambda s: last >= 1), lambda s: F.sequence(F.least(F.greatest(F.lit(1), s["at"] - size + 1), last), F.least(s["at"], last)))))
        return F.transform(at, lambda i: key(name, size, i))

    return F.flatten(F.array(*[of(name, size) for name in FORMS for size in sizes]))


def _items(benchmark: DataFrame, window: int) -> DataFrame:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), tokens(F.col("text")).alias("item_words")).where(F.size("item_words") > 0)
    return items.withColumn("size", F.least(F.lit(window), F.size("item_words")))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of id and text that tells rows with one id apart, and the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text).alias("row_key"), text.alias("text"))


def candidates(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """(doc_id, row_key, item_id, shift) with enough windows of the item on one alignment."""
    items = _items(benchmark, window)
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # at most `window` values
    if not sizes:
        sizes = [window]
    def keyed(words: DataFrame, *columns: str) -> DataFrame:
        # hashes of the further forms only where a slot makes them differ
        at = F.filter(F.transform("template", lambda h, k: F.struct((k + 1).alias("at"), h.alias("kind"))), lambda s: s["kind"].between(1, 3))
        forms = words.withColumn("template", template_hashes(F.col("words"))).withColumn("slots", at)
        for name in ("named", "plain"):
            forms = forms.withColumn(name, F.when(F.size("slots") > 0, FORMS[name](F.col("words"))).otherwise(F.col("template")))
        return forms.select(*columns, F.explode(_windows_of_sizes({name: F.col(name) for name in ("slots", *FORMS)}, sizes)).alias("w"))

    literals = F.size(F.filter(F.slice("words", F.col("w.pos") + 1, F.col("w.size")), lambda w: w >= JOINT))
    spelt = F.size(F.filter(F.slice("words", F.col("w.pos") + 1, F.col("w.size")), lambda w: w >= NAME))
    enough = F.least(F.lit(LITERALS), F.col("w.size"))
    index = keyed(items.withColumn("words", F.col("item_words")), "item_id", "words", F.col("size").alias("item_window")).where(F.col("w.size") == F.col("item_window")) \
        .where(F.when(F.col("w.form") == "template", literals >= enough).when(F.col("w.form") == "named", spelt >= enough).otherwise(True)) \
        .select("item_id", F.col("w.size").alias("size"), F.col("w.pos").alias("item_pos"), F.col("w.key").alias("key")).distinct()
    found = keyed(_keyed(docs).withColumn("words", tokens(F.col("text"))), "doc_id", "row_key") \
        .select("doc_id", "row_key", F.col("w.size").alias("size"), F.col("w.pos").alias("pos"), F.col("w.key").alias("key"))
    hits = found.join(index, ["size", "key"])
    # of 13 tokens in a row at least one window is whole; the exact run is counted later
    return hits.groupBy("doc_id", "row_key", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(F.count(F.lit(1)).alias("n")).drop("n")


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, run: int = RUN, stretches: bool = False) -> DataFrame:
    """One row per document row and item it holds: the longest matched run, the item's size and whether all slots are equal."""
    near = written(candidates(docs, benchmark, window, run))
    ids = near.select("doc_id", "row_key").distinct()
    texts = _keyed(docs).join(ids.withColumnRenamed("doc_id", "d").withColumnRenamed("row_key", "k"),
                              F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_key") == F.col("k")), "left_semi") \
        .select("doc_id", "row_key", tokens(F.col("text")).alias("doc_words"))
    near = near.select(F.col("doc_id").alias("d"), F.col("row_key").alias("k"), "item_id", "shift")
    both = texts.join(near, (F.col("row_key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d"))) \
        .join(_items(benchmark, window).select("item_id", "item_words"), "item_id")
    first = F.greatest(F.lit(0), -F.col("shift"))
    many = F.least(F.size("item_words"), F.size("doc_words") - F.col("shift")) - first
    # aligned tokens: the same word, the same slot with an equal value (2), a slot of the same type (1), or neither (0)
    pairs = F.arrays_zip(F.slice("item_words", first + 1, many).alias("i"), F.slice("doc_words", first + F.col("shift") + 1, many).alias("d"))
    aligned = both.withColumn("pairs", F.transform(pairs, lambda p: F.struct(p["i"].alias("i"), p["d"].alias("d"), F.when(value(p["i"]) == value(p["d"]), 2).when(
        (p["i"] < JOINT) & (F.substring(p["i"], 1, 1) == F.substring(p["d"], 1, 1)), 1).otherwise(0).alias("same"))))
    # the longest run without a 0: where it ends and how long it is
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("now"), F.lit(0).alias("best"), F.lit(0).alias("end"))

    def step(s, p):
        now = F.when(p["same"] > 0, s["now"] + 1).otherwise(0)
        return F.struct((s["at"] + 1).alias("at"), now.alias("now"), F.greatest(s["best"], now).alias("best"), F.when(now > s["best"], s["at"] + 1).otherwise(s["end"]).alias("end"))

    need = F.least(F.lit(run), F.greatest(F.size("item_words") - 2, F.least(F.lit(window), F.size("item_words"))))
    runs = aligned.withColumn("r", F.aggregate("pairs", start, step)).where(F.col("r.best") >= need)
    if stretches:
        held = _longest_stretch(runs.withColumn("need", need)).select("doc_id", "row_key", "item_id", F.col("s.run").alias("run"), F.size("item_words").alias("item_tokens"), F.col("s.verbatim").alias("verbatim"))
        return _per_item(held)
    runs = runs.withColumn("inside", F.slice("pairs", F.col("r.end") - F.col("r.best") + 1, F.col("r.best")))
    slots = F.filter("inside", lambda p: p["i"] < JOINT)
    same = F.size(F.filter("inside", lambda p: p["same"] == 2))
    consistent = F.size(F.array_distinct(F.transform(slots, lambda p: F.struct(p["i"], value(p["d"]))))) == F.size(F.array_distinct(F.transform(slots, lambda p: p["i"])))
    held = runs.where(consistent & (2 * same >= F.col("r.best"))).select("doc_id", "row_key", "item_id", F.col("r.best").alias("run"), F.size("item_words").alias("item_tokens"),
                                                                        (same == F.col("r.best")).alias("verbatim"))
    return _per_item(held)


def _per_item(held: DataFrame) -> DataFrame:
    return held.groupBy("doc_id", "row_key", "item_id").agg(F.max("run").alias("matched_tokens"), F.max("item_tokens").alias("item_tokens"), F.max("verbatim").alias("verbatim"))


def _longest_stretch(runs: DataFrame) -> DataFrame:
    """Rows with a stretch of at least ``need`` aligned tokens, none a 0, with consistent slots and half of it equal: s is the longest.

    For each end, a stretch may begin behind the last 0 and behind the last slot that contradicts one in it (``low``). With 1 for an
    equal token and -1 for another, half are equal where the sum doesn't fall. Sums move in steps of one, so the first start from
    which it doesn't is ``low`` itself or the first with just the end's sum.
    """
    marked = F.transform("pairs", lambda p, k: F.struct(k.alias("at"), p["i"].alias("i"), value(p["d"]).alias("d"), p["same"].alias("same")))
    slots = F.filter("marked", lambda p: (p["i"] < JOINT) & (p["same"] > 0))

    def low(p: Column) -> Column:
        against = F.filter("slots", lambda q: (q["at"] < p["at"]) & (q["i"] == p["i"]) & (q["d"] != p["d"]))
        return F.struct(p["same"].alias("same"), F.when(p["same"] == 0, p["at"] + 1).when(p["i"] < JOINT, F.coalesce(F.array_max(F.transform(against, lambda q: q["at"] + 1)), F.lit(0))).otherwise(0).alias("low"))

    def step(s: Column, p: Column) -> Column:
        end, total = s["end"] + 1, F.element_at(s["sums"], -1) + F.when(p["same"] == 2, 1).otherwise(-1)
        return F.struct(end.alias("end"), F.greatest(s["low"], p["low"]).alias("low"), F.concat(s["sums"], F.array(total)).alias("sums"), s["run"].alias("run"), s["verbatim"].alias("verbatim"))

    def found(s: Column) -> Column:
        first = s["low"] + F.when(F.element_at(s["sums"], s["low"] + 1) <= F.element_at(s["sums"], -1), 0).otherwise(
            F.array_position(F.slice(s["sums"], s["low"] + 1, s["end"] - s["low"] + 1), F.element_at(s["sums"], -1)).cast("int") - 1)
        return first

    def kept(s: Column, first: Column) -> Column:
        longer = s["end"] - first > s["run"]
        equal = F.element_at(s["sums"], -1) - F.element_at(s["sums"], first + 1) == s["end"] - first
        return F.struct(s["end"].alias("end"), s["low"].alias("low"), s["sums"].alias("sums"), F.when(longer, s["end"] - first).otherwise(s["run"]).alias("run"),
                        F.when(longer, equal).otherwise(s["verbatim"] | ((s["end"] - first == s["run"]) & equal)).alias("verbatim"))

    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("low"), F.array(F.lit(0)).alias("sums"), F.lit(0).alias("run"), F.lit(False).alias("verbatim"))
    return runs.withColumn("marked", marked).withColumn("slots", slots).withColumn("lows", F.transform("marked", low)) \
        .withColumn("s", F.aggregate("lows", start, lambda s, p: bound(step(s, p), lambda t: bound(F.struct(t.alias("t"), found(t).alias("first")), lambda x: kept(x["t"], x["first"]))))) \
        .where(F.col("s.run") >= F.col("need"))


def bound(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, that hold no benchmark item."""
    bad = written(leaks(docs, benchmark, stretches=True).select(F.col("doc_id").alias("leak_id"), F.col("row_key").alias("leak_key")).distinct())
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    doc_id = docs["doc_id"].cast("long")
    return docs.join(bad, doc_id.eqNullSafe(bad["leak_id"]) & (F.xxhash64(doc_id, text) == bad["leak_key"]), "left_anti")

