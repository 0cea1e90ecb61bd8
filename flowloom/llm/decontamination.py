"""Benchmark decontamination by template canonicalisation (operator 6), DataFrame functions only.

Numbers, names and units become typed placeholders; windows of ``size`` template words are hash-joined
between documents and benchmark, and a match counts only if its slots are filled consistently: in one unbroken
run of matched windows a benchmark value always stands for the same document value. Names are judged in two
views, and what leaves too few plain words for a template is joined word for word. Of an inconsistent run,
stretches of at least twice ``size`` words that are verbatim still count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.storage import Workspace, text_key

SIZE, LEAST_WORDS = 8, 5
#: Broadcast the benchmark's windows up to this many; beyond it they are joined by shuffle.
BROADCAST_WINDOWS = 200_000
# Unit words that may follow a number.
UNITS = ("mm|cm|m|km|miles?|feet|foot|inch(?:es)?|yards?|mg|g|kg|grams?|kilograms?|tons?|lbs?|pounds?|ounces?|oz|ml|l|litres?|liters?|"
         "gallons?|seconds?|secs?|minutes?|mins?|hours?|hrs?|days?|weeks?|months?|years?|dollars?|cents?|euros?|usd|eur|percent|kmh|mph|degrees?")
# Private-use marks that start a slot: number, name, unit; and one for a capitalised word that may only open a sentence.
_NUM, _NAME, _UNIT, _END, _OPEN, _LAST = "\uE001", "\uE002", "\uE003", "\uE004", "\uE005", "\uE006"
_NOT_WORD = (r"(?:[\x00-\x2B\x2D\x2F\x3A-\x60\x7B-\x7F\u00A0-\u00BF\u2000-\u206F\u3000-\u303F\uFF01-\uFF0F\uFF1A-\uFF20\uFF3B-\uFF40\uFF5B-\uFF65]"
             r"|[.,](?![0-9]))+")
# Scripts written without blanks: each character is a word. All begin at Thai, so one comparison spares other letters the look-up.
_UNSPACED = r"[\u0E00-\x{10FFFF}&&[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]]"
#: How a window is joined: names by their left neighbour, every capitalised word a name, or word for word.
NEAR, WIDE, EXACT = 1, 2, 4


def slotted(text):
    """Words of a text in lower case; a number, name or unit keeps its value behind a mark.

    A name is a capitalised word after a letter, digit or comma and one blank; any other capitalised word gets the mark
    of one that may only open a sentence. A unit is a known unit word after a number. Null gives null, a text without
    words an empty array.
    """
    spaced = F.regexp_replace(text, _UNSPACED, " $0 ")
    named = F.regexp_replace(spaced, r"\p{Lu}(?<=[\p{L}\p{N},] \p{Lu})(?=\p{Ll})", f"{_NAME}$0")
    opened = F.regexp_replace(named, rf"\p{{Lu}}(?<![\p{{L}}\p{{M}}\p{{N}}{_NAME}]\p{{Lu}})(?=\p{{Ll}})", f"{_OPEN}$0")
    numbered = F.regexp_replace(F.lower(opened), r"[0-9]+(?:[.,][0-9]+)*", f"{_NUM}$0")
    measured = F.regexp_replace(numbered, rf"(?<=[0-9])( ?)({UNITS})(?![\p{{L}}0-9])", f" {_UNIT}$2")
    return F.filter(F.split(measured, _NOT_WORD), lambda w: w != "")


def _plain(w):
    return (w < _NUM) | (w >= _END)


def view(words, wide: bool):
    """The words with every capitalised word a name, or with sentence openers plain."""
    rest = lambda w: F.substring(w, 2, 1 << 30)
    return F.transform(words, lambda w: F.when(w.startswith(_OPEN), F.concat(F.lit(_NAME), rest(w)) if wide else rest(w)).otherwise(w))


def template(words):
    """The words of a view with slot values taken out."""
    return F.transform(words, lambda w: F.when(_plain(w), w).otherwise(F.substring(w, 1, 1)))


def bare(words):
    """The words without marks."""
    return F.transform(words, lambda w: F.when((w >= _NUM) & (w < _LAST), F.substring(w, 2, 1 << 30)).otherwise(w))


def _hashed(words):
    return F.transform(words, lambda w: F.xxhash64(w))


def _window(hashes: str, at, size: int):
    """Hash of ``size`` word hashes from place ``at`` on; places behind the last word are passed over."""
    return F.xxhash64(*[F.get(hashes, at + i) for i in range(size)])


def _sides(hashes: dict[str, int]):
    """Word hashes side by side: for each column, its value at a place and at the ``n - 1`` places behind it."""
    return F.arrays_zip(*[F.slice(c, i + 1, 1 << 30).alias(f"{c}{i}") for c, n in hashes.items() for i in range(n)])


def _joined(column: str, size: int):
    """Hash of the window in ``h``, made of ``_sides``; null where the text ends before it does."""
    return F.when(F.col(f"h.{column}{size - 1}").isNotNull(), F.xxhash64(*[F.col(f"h.{column}{i}") for i in range(size)]))


def _runs(ats, length):
    """The windows by runs, in each of which one overlaps or adjoins the next."""
    starts = F.filter(ats, lambda a, i: (i == 0) | (a > F.get(ats, i - 1) + length))
    return F.transform(starts, lambda s, i: F.filter(ats, lambda a: (a >= s) & (a < F.coalesce(F.get(starts, i + 1), F.lit(2**31 - 1)))))


def _verbatim(ats, first, own, theirs, size: int):
    """The windows inside verbatim stretches of at least twice ``size`` words."""
    places = F.transform(F.arrays_zip(own, theirs), lambda p, i: F.when(p["own"] != p["theirs"], i))
    ends = F.concat(F.array(F.lit(-1)), F.filter(places, lambda i: i.isNotNull()), F.array(F.size(own)))

    def inside(at):
        before = F.array_max(F.filter(ends, lambda e: e < at - first))
        after = F.array_min(F.filter(ends, lambda e: e >= at - first))
        return (after >= at - first + size) & (after - before > 2 * size)

    return F.filter(ats, inside)


def _asked(items: DataFrame, size: int, least: int) -> DataFrame:
    """item_id, at, length, window, kinds of all windows to look for."""
    views = items.withColumns({"near": template(view("words", False)), "wide": template(view("words", True)), "bare": bare("words")})
    views = views.withColumns({c[0]: _hashed(F.col(c)) for c in ("near", "wide", "bare")})
    each = views.select("item_id", "near", "wide", F.posexplode(_sides({"n": size, "w": size, "b": size})).alias("at", "h")).where(
        F.col("at") <= F.size("near") - size)
    plain = lambda side: F.size(F.filter(F.slice(side, F.col("at") + 1, size), _plain))
    # The wide view has the fewest plain words.
    ways = F.array(F.struct(_joined("n", size).alias("window"), F.when(plain("near") >= least, NEAR).alias("kinds")),
                   F.struct(_joined("w", size).alias("window"), F.when(plain("wide") >= least, WIDE).alias("kinds")),
                   F.struct(_joined("b", size).alias("window"), F.when(plain("wide") < least, EXACT).alias("kinds")))
    long = each.select("item_id", "at", F.lit(size).alias("length"), F.inline(ways)).where("kinds is not null")
    short = views.where(F.size("words").between(1, size - 1)).select(
        "item_id", F.lit(0).alias("at"), F.size("words").alias("length"),
        _window("b", F.lit(0), size - 1).alias("window"), F.lit(EXACT).alias("kinds"))
    return long.unionByName(short).groupBy("item_id", "at", "length", "window").agg(F.bit_or("kinds").alias("kinds"))


def _given(docs: DataFrame, size: int, exact: list[int]) -> DataFrame:
    """doc_id, tk, place, window, kinds of all windows of the documents; word for word in the lengths ``exact``."""
    # Each step is a column of its own: inlined into a lambda it would be worked out again for every window.
    split = docs.select("doc_id", "tk", slotted(F.col("text")).alias("words"))
    views = split.select("doc_id", "tk", template(view("words", False)).alias("near"), template(view("words", True)).alias("wide"),
                         *([bare("words").alias("bare")] if exact else []))
    sides = {"n": size, "w": size} | ({"b": max(exact)} if exact else {})
    hashed = views.select("doc_id", "tk", *[_hashed(F.col(c)).alias(c[0]) for c in views.columns[2:]])
    each = hashed.select("doc_id", "tk", F.posexplode(_sides(sides)).alias("place", "h"))
    # The windows are hashed row by row, in generated code.
    each = each.select("doc_id", "tk", "place", _joined("n", size).alias("near"), _joined("w", size).alias("wide"),
                       *[_joined("b", n).alias(f"b{n}") for n in exact])
    as_way = lambda window, kinds: F.struct(window.alias("window"), F.lit(kinds).alias("kinds"))
    same = F.col("near") == F.col("wide")
    ways = F.array(as_way(F.col("near"), F.when(same, NEAR | WIDE).otherwise(NEAR)), as_way(F.when(~same, F.col("wide")), WIDE),
                   *[as_way(F.col(f"b{n}"), EXACT) for n in exact])
    return each.select("doc_id", "tk", "place", F.inline(ways)).where("window is not null")


def matches(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, least: int = LEAST_WORDS) -> DataFrame:
    """One row per document text, item and alignment: doc_id, tk, item_id, shift, n_windows, n_slots, first, last.

    Benchmark windows with at least ``least`` plain words are joined as templates, the others and whole items of
    fewer than ``size`` words word for word (in lower case). Null texts and ids, and texts without words, match nothing.
    Repeated rows give one set of matches. An empty table on either side gives an empty result.
    """
    work = Workspace(docs.sparkSession, "decontamination")
    items = benchmark.where("item_id is not null and text is not null").select("item_id", slotted(F.col("text")).alias("words"))
    items = work.save("items", items)
    asked = work.save("asked", _asked(items, size, least))
    exact = sorted(r.length for r in asked.where(F.col("kinds").bitwiseAND(EXACT) != 0).select("length").distinct().collect())
    usable = docs.where("doc_id is not null and text is not null").select("doc_id", text_key().alias("tk"), "text")
    bounded = asked.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    sought = asked.withColumnRenamed("kinds", "sought")
    met = _given(usable, size, exact).join(F.broadcast(sought) if bounded else sought, "window")
    common = F.col("kinds").bitwiseAND(F.col("sought"))
    kind = F.filter(F.array(*map(F.lit, (NEAR, WIDE, EXACT))), lambda k: common.bitwiseAND(k) != 0)
    aligned = met.where(common != 0).select("doc_id", "tk", "item_id", (F.col("place") - F.col("at")).alias("shift"), "at", "length", F.explode(kind).alias("kind"))
    aligned = work.save("aligned", aligned.groupBy("doc_id", "tk", "item_id", "shift", "kind").agg(
        F.sort_array(F.collect_set("at")).alias("ats"), F.max("length").alias("length")))
    aligned = aligned.select("doc_id", "tk", "item_id", "shift", "kind", "length", F.explode(_runs(F.col("ats"), F.col("length"))).alias("ats"))
    aligned = aligned.withColumns({"first": F.element_at("ats", 1), "end": F.element_at("ats", -1) + F.col("length")})
    per = aligned.groupBy("doc_id", "tk").agg(F.collect_list(F.struct("item_id", "shift", "kind", "ats", "first", "end")).alias("found"))
    words = usable.join(per, ["doc_id", "tk"]).select("doc_id", "tk", slotted(F.col("text")).alias("own"), F.explode("found").alias("f"))
    covered = words.select("doc_id", "tk", "f.*", F.slice("own", F.col("f.first") + F.col("f.shift") + 1, F.col("f.end") - F.col("f.first")).alias("own"))
    both = covered.join(items, "item_id").withColumn("theirs", F.slice("words", F.col("first") + 1, F.col("end") - F.col("first")))
    seen = lambda side: F.when(F.col("kind") == WIDE, view(side, True)).otherwise(view(side, False))
    both = both.withColumn("own", seen("own")).withColumn("theirs", seen("theirs"))
    # Slots of both sides side by side; only where both hold a slot of one type.
    is_slot = lambda p: (F.substring(p["own"], 1, 1) == F.substring(p["theirs"], 1, 1)) & (p["own"] >= _NUM) & (p["own"] < _END)
    pairs = F.array_distinct(F.filter(F.arrays_zip("own", "theirs"), is_slot))
    counted = both.withColumn("pairs", pairs)
    consistent = (F.col("kind") == EXACT) | (F.size(F.array_distinct(F.transform("pairs", lambda p: p["theirs"]))) == F.size("pairs"))
    verbatim = _verbatim(F.col("ats"), F.col("first"), F.col("own"), F.col("theirs"), size)
    judged = counted.withColumns({"ats": F.when(consistent, F.col("ats")).otherwise(verbatim),
                                  "pairs": F.when(consistent, F.col("pairs")).otherwise(F.filter("pairs", lambda p: p["own"] == p["theirs"]))})
    return judged.where(F.size("ats") > 0).groupBy("doc_id", "tk", "item_id", "shift").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).cast("long").alias("n_windows"), F.max(F.size("pairs")).alias("n_slots"),
        F.min(F.element_at("ats", 1)).alias("first"), F.max(F.element_at("ats", -1)).alias("last"))


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, item_id, n_windows, n_slots: matched windows and distinct slot pairs over all alignments."""
    return matches(docs, benchmark, size).groupBy("doc_id", "item_id").agg(
        F.sum("n_windows").alias("n_windows"), F.max("n_slots").alias("n_slots"))


def clean(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark window; null texts and null doc_ids stay."""
    found = matches(docs, benchmark, size).select(F.col("doc_id").alias("__doc"), F.col("tk").alias("__tk")).distinct()
    return docs.join(found, (F.col("doc_id") == F.col("__doc")) & (text_key() == F.col("__tk")), "left_anti")
