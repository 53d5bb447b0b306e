"""Benchmark decontamination by templates: typed placeholders, hash-joined windows, consistent slots.

A text is read as words. A number, also a decimal or grouped one, is typed ``<num>``, a unit word behind a number
``<unit>``, a word that begins with a capital ``<name>``; a run of names is one slot, whose value is its last word
(the first may only open a sentence).
Windows of five are taken twice: over the lower-cased words as they stand, and over the template, where typed words
are their placeholders. A template window counts only with at least two plain words, since
placeholders alone say nothing.

An item is leaked into a document when at least 80 % of its windows stand there word for word, or at least 80 % of its
template windows do and the values of its slots are replaced consistently: the occurrences of one
benchmark value have one counterpart for at least 80 % of the values, in the whole document or at one place of it.

The benchmark's window hashes are a table with their counts by item, and a bitmap of them, at most ``BITMAP`` words,
is a constant of the plan; a document's distinct window hashes that the bitmap may hold meet the table in one hash
join and are added up by document and item at once, so one template however often repeated is one row a document.
Only documents that reach the share by template alone are read again for their slots. DataFrame functions
only; nothing but the bitmap is sent without a counted size.

Cases: null and empty texts have no windows and leak nothing; items of three or four words are looked up as windows
of their length; an item of one or two words is met only by texts of as many words;
items without words are never found; equal items are all reported; document rows equal in id and text share
their decision and are reported once; a window that repeats counts as often as in the item; all
columns are kept by the filter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tarmetric.llm.common import few_rows, let, row_key, table
from tarmetric.session import materialize

WINDOW, SHARE, LEAST_PLAIN, SHORTEST = 5, 0.8, 2, 3
#: Most 64-bit words of the bitmap.
BITMAP = 1 << 17
# ASCII signs and spaces end a word; a point or comma between digits does not, so a decimal or grouped number is one
SEPARATOR = r"(?:[\x00-\x2B\x2D\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]|[.,](?![0-9])|(?<![0-9])[.,])+"
# Unit words.
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "mg", "g", "kg", "gram", "grams",
    "pound", "pounds", "ton", "tons", "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "second", "seconds", "minute",
    "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "cent", "cents",
    "euro", "euros", "percent", "degree", "degrees", "meter", "meters", "metre", "metres",
)


NUM, UNIT, NAME = 1, 2, 3


def word_types(words: Column) -> Column:
    """0 for a plain word, else ``NUM``, ``UNIT`` or ``NAME``."""
    units = F.array(*[F.lit(u) for u in UNITS])
    digits = "^[0-9]+([.,][0-9]+)*$"

    def kind(w: Column, i: Column) -> Column:
        before = F.get(words, i - 1)
        number = (before >= "0") & (before < ":")
        return (
            F.when((w >= "a") & (w < "{"), F.when(number & F.array_contains(units, w) & before.rlike(digits), UNIT))
            .when((w >= "0") & (w < ":"), F.when(w.rlike(digits), NUM))
            .when(w.rlike(r"^\p{Lu}\p{L}+$"), NAME)
        )

    return F.transform(words, lambda w, i: F.coalesce(kind(w, i), F.lit(0)))


def places(array: Column, width: int = WINDOW) -> Column:
    """Starts of the windows; an array shorter than a window is one."""
    return F.when(F.size(array) > 0, F.sequence(F.lit(0), F.greatest(F.size(array) - width, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def window_hash(hashes: Column, i: Column, width: int = WINDOW) -> Column:
    # a missing element leaves a hash as it is, so a short array hashes like a short window
    return F.xxhash64(*[F.get(hashes, i + k) for k in range(width)])


def word_sequences(text: Column, body, values: bool = True) -> Column:
    """``body`` of (hashes of the words; words, hashes and types of the template), each computed once.

    Without ``values`` the words of the template, which only its slots need, are left out.
    """
    # splitting at what is no word takes a sixth of the time of extracting the words
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATOR), "")

    def typed(s: Column) -> Column:
        ends = F.sequence(F.lit(0), F.size(s["w"]) - 1)
        kept = F.filter(ends, lambda i: (F.get(s["t"], i) != NAME) | (F.coalesce(F.get(s["t"], i + 1), F.lit(0)) != NAME))
        kept = F.when(F.size(s["w"]) > 0, kept).otherwise(F.array().cast("array<int>"))

        def slot(at: Column) -> list[Column]:
            return [F.transform(at, lambda i: F.lower(F.get(s["w"], i))).alias("slot")] if values else []

        return let(kept, lambda at: let(
            F.struct(
                s["h"].alias("h"), *slot(at), F.transform(at, lambda i: F.get(s["t"], i)).alias("type"),
                F.transform(at, lambda i: F.when(F.get(s["t"], i) == 0, F.get(s["h"], i)).otherwise(F.get(s["t"], i).cast("long"))).alias("shown"),
            ), body))

    return let(words, lambda w: let(F.struct(w.alias("w"), word_types(w).alias("t"), F.transform(w, lambda x: F.xxhash64(F.lower(x))).alias("h")), typed))


def slots_in(types: Column, i: Column) -> Column:
    return sum((F.coalesce((F.get(types, i + k) > 0).cast("int"), F.lit(0)) for k in range(1, WINDOW)), F.coalesce((F.get(types, i) > 0).cast("int"), F.lit(0)))


def template_places(s: Column, least: int) -> Column:
    """Starts of the template windows with at least ``least`` slots and enough plain words."""
    return F.filter(places(s["shown"]), lambda i: slots_in(s["type"], i).between(least, F.least(F.size(s["shown"]), F.lit(WINDOW)) - LEAST_PLAIN))


def slot_places(s: Column) -> Column:
    """:func:`template_places` with one slot at least, from the slots: most windows have none and are not looked at."""
    size = F.size(s["shown"])
    last = F.greatest(size - WINDOW, F.lit(0))
    slots = F.filter(F.sequence(F.lit(0), size - 1), lambda i: F.get(s["type"], i) > 0)
    starts = F.flatten(F.transform(slots, lambda i: F.sequence(F.greatest(i - (WINDOW - 1), F.lit(0)), F.least(i, last))))
    return F.filter(F.array_distinct(starts), lambda i: slots_in(s["type"], i) <= F.least(size, F.lit(WINDOW)) - LEAST_PLAIN)


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, _item, words, template, at, h, slots of the windows of the items; written.

    ``template`` tells the two kinds of windows apart.
    """
    items = benchmark.select("item_id", F.xxhash64("item_id", "text").alias("_item"), F.col("text").alias("_text")).distinct()

    def both(s: Column) -> Column:
        none = F.array().cast("array<string>")
        plain = F.transform(places(s["h"]), lambda i: F.struct(F.lit(False).alias("template"), i.alias("at"), window_hash(s["h"], i).alias("h"), none.alias("slots")))
        shown = F.transform(places(s["shown"]), lambda i: F.struct(F.lit(True).alias("template"), i.alias("at"), window_hash(s["shown"], i).alias("h"), _slots(s, i).alias("slots")))
        enough = F.filter(shown, lambda x: slots_in(s["type"], x["at"]) <= F.least(F.size(s["shown"]), F.lit(WINDOW)) - LEAST_PLAIN)
        return F.struct(F.size(s["h"]).alias("words"), F.size(shown).alias("templates"), F.concat(plain, enough).alias("windows"))

    found = items.select("item_id", "_item", word_sequences(F.col("_text"), both).alias("_f"))
    return materialize(found.select("item_id", "_item", "_f.words", "_f.templates", F.inline("_f.windows")), "item-windows")


def _slots(s: Column, i: Column) -> Column:
    """The values of a window's slots, in order."""
    at = F.filter(F.sequence(i, i + WINDOW - 1), lambda k: F.coalesce(F.get(s["type"], k) > 0, F.lit(False)))
    return F.transform(at, lambda k: F.get(s["slot"], k))


def bitmap_of(windows: DataFrame) -> tuple[Column, int]:
    """A bitmap of the window hashes as one value, and its number of words."""
    size = 1 << min(BITMAP.bit_length() - 1, max(4, windows.count().bit_length()))
    bit = F.shiftrightunsigned("h", 40).bitwiseAND(F.lit(63)).cast("int")
    held = windows.select(F.col("h").bitwiseAND(F.lit(size - 1)).alias("id"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("v"))
    held = held.groupBy("id").agg(F.bit_or("v").alias("v"))
    full = windows.sparkSession.range(size).join(held, "id", "left").select("id", F.coalesce("v", F.lit(0).cast("long")).alias("v"))
    # one row of at most BITMAP words; as text it folds into one constant of the plan
    words = F.transform(F.array_sort(F.collect_list(F.struct("id", "v"))), lambda x: x["v"].cast("string"))
    text = full.agg(F.array_join(words, ",").alias("bits")).head()["bits"]
    return F.split(F.lit(text), ",").cast("array<bigint>"), size


def may_hold(bits: Column, size: int, h: Column) -> Column:
    word = F.get(bits, h.bitwiseAND(F.lit(size - 1)).cast("int"))
    return F.call_function("shiftrightunsigned", word, F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def document_hashes(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """doc_id, _k1, _k2, h: the distinct window hashes of each document that an item may have."""
    bits, size = bitmap_of(windows)
    short = windows.where(F.col("words").between(SHORTEST, WINDOW - 1)).select("words").distinct().collect()  # two rows at most
    widths = [WINDOW, *sorted(r["words"] for r in short)]

    def hashes(s: Column, held: Column) -> Column:
        def of_width(n: int) -> Column:
            return F.transform(places(s["h"], n), lambda i: window_hash(s["h"], i, n))

        parts = list(map(of_width, widths))
        parts.append(F.transform(slot_places(s), lambda i: window_hash(s["shown"], i)))
        return F.concat(*[F.filter(p, lambda h: may_hold(held, size, h)) for p in parts])

    found = let(bits, lambda held: F.array_distinct(word_sequences(F.col("text"), lambda s: hashes(s, held), values=False)))
    rows = docs.select("doc_id", *row_key(), found.alias("_h"))
    # an inner explode would be given a filter on the array, which would make it twice
    return rows.select("doc_id", "_k1", "_k2", F.explode_outer("_h").alias("h")).where("h is not null")


def slot_scores(docs: DataFrame, pairs: DataFrame, windows: DataFrame, share: float) -> DataFrame:
    """_k1, _k2, _item, slot_consistency of the pairs of ``pairs`` that are met by template."""
    keys = materialize(pairs.select("_k1", "_k2").distinct(), "template-documents")
    rows = docs.select(*row_key(), "text").join(few_rows(keys), ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"])

    def found(s: Column) -> Column:
        return F.transform(template_places(s, 0), lambda i: F.struct(i.alias("at"), window_hash(s["shown"], i).alias("h"), _slots(s, i).alias("slots")))

    rows = rows.select("_k1", "_k2", F.inline(word_sequences(F.col("text"), found)))
    own = windows.where("template").select("_item", "templates", "h", F.col("at").alias("item_at"), F.col("slots").alias("item_slots"))
    pair = ["_k1", "_k2", "_item"]
    met = rows.join(pairs.select(*pair), ["_k1", "_k2"]).join(own, ["_item", "h"]).withColumn("place", F.col("at") - F.col("item_at"))
    held = met.groupBy(*pair, "place", "templates").agg(F.countDistinct("item_at").alias("n")).where(F.col("n") / F.col("templates") >= share).select(*pair, "place")
    slots = met.where(F.size("slots") > 0).select(*pair, "place", F.explode(F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b"))).alias("s"))
    values = slots.groupBy(*pair, "place", F.col("s.a").alias("value")).agg(F.min("s.b").alias("least"), F.max("s.b").alias("most"))
    same = (F.min("least") == F.max("most")).cast("int").alias("same")
    score = F.avg("same").alias("slot_consistency")
    # over the whole document, since a copy may be cut by added words, and at each place that holds the item
    whole = values.groupBy(*pair, "value").agg(same).groupBy(*pair).agg(score)
    placed = values.groupBy(*pair, "place", "value").agg(same).groupBy(*pair, "place").agg(score)
    placed = held.join(placed, [*pair, "place"], "left").select(*pair, F.coalesce("slot_consistency", F.lit(1.0)).alias("slot_consistency"))
    return whole.union(placed).groupBy(*pair).agg(F.max("slot_consistency").alias("slot_consistency"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """_k1, _k2, doc_id, item_id, shared_windows, item_windows, containment, slot_consistency of leaked pairs."""
    windows = item_windows(benchmark)
    # equal windows of an item are one row with their number
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    own = windows.groupBy("h", "_item").agg(count(~F.col("template")).alias("plain"), count(F.col("template")).alias("shown"))
    sizes = windows.groupBy("_item", "item_id", "templates").agg(count(~F.col("template")).alias("plains"))
    rows = document_hashes(docs, windows)
    met = rows.join(own, "h").groupBy("doc_id", "_k1", "_k2", "_item").agg(F.sum("plain").alias("plain"), F.sum("shown").alias("shown"))
    met = met.join(sizes, "_item")
    by_words, by_template = F.col("plain") / F.col("plains"), F.col("shown") / F.col("templates")
    met = materialize(met.where((by_words >= share) | (by_template >= share)).withColumn("literal", by_words >= share), "met-items")
    plain = met.where("literal").select("doc_id", "_k1", "_k2", "item_id", F.col("plain").alias("shared_windows"), F.col("plains").alias("item_windows"), by_words.alias("containment"), F.lit(1.0).alias("slot_consistency"))
    open_ = met.where("not literal")
    scores = slot_scores(docs, open_, windows, share)
    checked = open_.join(scores, ["_k1", "_k2", "_item"], "left").withColumn("slot_consistency", F.coalesce("slot_consistency", F.lit(1.0)))
    checked = checked.where(F.col("slot_consistency") >= share)
    return plain.union(checked.select(
        "doc_id", "_k1", "_k2", "item_id", F.col("shown").alias("shared_windows"), F.col("templates").cast("long").alias("item_windows"), by_template.alias("containment"), "slot_consistency"
    ))


def remove_leaked(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows into which no item leaked, with all their columns."""
    leaked = materialize(find_leaks(docs, benchmark, share).select("_k1", "_k2").distinct(), "leaked-rows")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *row_key())
    return rows.join(few_rows(leaked), ["_k1", "_k2"], "left_anti").select("_row.*")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_k1", "_k2")
