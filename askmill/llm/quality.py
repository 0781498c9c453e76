"""Quality rules by distribution divergence, with built-in functions only.

A document's histogram over character classes and over common words is compared with those of its language's
references, which are made from all documents, by the Jensen-Shannon distance (square root of the divergence
to base 2, so 0 to 1). Short documents have too few counts to judge and pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askmill.llm.common import WORD, cut

#: Common words of a language's reference: its most frequent ones that hold a letter.
COMMON = 30
#: The largest distance of a document's classes, if it is kept.
MOST_CLASSES = 0.285
#: The same for common words, as a share of the distance of a text that has none: at most the first, and the second and the third over the
#: square root of the words, as chance moves the shares of a short text further.
MOST_WORDS = (0.95, 0.6, 2.5)
#: The fewest characters (for classes) and words (for common words) of a document that is judged.
LEAST_CHARS, LEAST_WORDS = 100, 50
#: Words of a window that counts as repeated, and the base rules' limits.
SPAN, FEWEST_WORDS, MOST_REPEATED = 5, 10, 20

# The symbols of the base rule, and the classes of characters.
SYMBOLS = "#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "white", "mark", "other")
#: Letters that stand for no common word and for each of them, in their order.
PLACES = "".join(map(chr, range(ord("0"), ord("0") + COMMON + 1)))


def _left(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def class_counts(rows: DataFrame, text: str, words: str, out: str = "classes", symbols: str | None = None) -> DataFrame:
    """Adds counts of small ASCII letters, capitals, digits, white space, other ASCII, all else; and of the symbols.

    One pass takes small letters and white space away; the other classes are counted in the little that is left.
    White space is one byte a character, so it is what the text has in bytes over its words.
    """
    rows = rows.withColumn("__left", _left(F.col(text), r"[a-z\x20\x09-\x0D]+")).withColumn("__white", F.octet_length(text) - F.octet_length(F.array_join(words, "")))
    left, digits = F.col("__left"), "0123456789"
    no_upper = F.translate(left, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")
    rows = rows.withColumns({"__no_upper": F.length(no_upper), "__rest": F.translate(no_upper, digits, ""), "__size": F.length(left), "__lower": F.length(text) - F.col("__white") - F.length(left)})
    rows = rows.withColumn("__other", F.length(_left(F.col("__rest"), r"[\x00-\x7F]+")))
    size, rest, other = F.col("__size"), F.length("__rest"), F.col("__other")
    counts = [F.col("__lower"), size - F.col("__no_upper"), F.col("__no_upper") - rest, F.col("__white"), rest - other, other]
    rows = rows.withColumn(out, F.array(*[c.cast("long") for c in counts]))
    if symbols:
        rows = rows.withColumn(symbols, (rest - F.length(F.translate("__rest", SYMBOLS, ""))).cast("long"))
    return rows.drop("__left", "__white", "__no_upper", "__rest", "__size", "__lower", "__other")


def _features(rows: DataFrame) -> DataFrame:
    """Adds to row, t, ref_words what the rules need. Each select names what the next uses more than once, so that it is made once."""
    keep = [c for c in rows.columns if c != "t"]
    words = F.regexp_extract_all("t", F.lit(WORD), F.lit(0))
    rows = class_counts(rows.withColumn("words", words), "t", "words", symbols="n_symbols").withColumn("lines", F.split("t", "\n"))
    rows = rows.select(
        *keep, "classes", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.filter("lines", lambda x: x.rlike(WORD)).alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        common_places(F.col("words"), F.col("ref_words"), F.col("ref_longest")).alias("common"),
    )
    # Windows of five words by the hash of their words' hashes (64 bits: within one text no two windows meet by chance).
    shifted = [F.slice("hashes", F.lit(k + 1), F.greatest(F.lit(0), F.size("hashes") - SPAN + 1)) for k in range(SPAN)]
    rows = rows.withColumns({"spans": F.transform(F.arrays_zip(*shifted), lambda x: F.xxhash64(x)), "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")}).drop("lines", "hashes")
    return with_repeated_words(rows, "spans", "n_repeat_words")


def common_places(words: Column, common: Column, longest: Column) -> Column:
    """A letter for each word: which of the common words it is, or the first one for none of them. Small letters are never fewer than what they are made of, so a word longer than the longest common one is none of them."""
    place = lambda w: F.substring(F.lit(PLACES), F.array_position(common, F.lower(w)).cast("int") + 1, F.lit(1))
    return F.array_join(F.transform(words, lambda w: F.when(F.length(w) <= longest, place(w)).otherwise(F.lit(PLACES[0]))), "")


def common_counts(places: Column, common: Column) -> Column:
    """How often each common word stands in a text: by taking its letter away."""
    return F.transform(common, lambda w, k: (F.length(places) - F.length(F.replace(places, F.substring(F.lit(PLACES), k + 2, F.lit(1)), F.lit("")))).cast("double"))


def with_repeated_words(rows: DataFrame, spans: str, out: str) -> DataFrame:
    """Words covered by windows that occur twice or more. Windows are sorted, with their places, only where one repeats."""
    empty = F.expr("cast(array() as array<struct<h: bigint, i: int>>)")
    repeats = F.size(F.array_distinct(spans)) < F.size(spans)
    rows = rows.withColumn("placed", F.when(repeats, F.sort_array(F.transform(spans, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(empty)).drop(spans)
    pairs = F.zip_with(_but_last("placed"), _but_first("placed"), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    rows = rows.withColumn("at", F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))).drop("placed")
    gaps = F.zip_with(_but_last("at"), _but_first("at"), lambda a, b: F.least(F.lit(SPAN), b - a))
    return rows.withColumn(out, F.aggregate(gaps, F.when(F.size("at") > 0, SPAN).otherwise(0), lambda s, x: s + x).cast("long")).drop("at")


def _but_last(x: str) -> Column:
    return F.slice(x, F.lit(1), F.greatest(F.lit(0), F.size(x) - 1))


def _but_first(x: str) -> Column:
    return F.slice(x, F.lit(2), F.greatest(F.lit(0), F.size(x) - 1))


def references(docs: DataFrame, text: str = "text", lang: str = "lang", common: int = COMMON) -> DataFrame:
    """l (the language), ref_classes array<double>, ref_words array<string>, ref_shares array<double>, ref_longest int (characters of the longest), ref_none double (the distance of a text without common words): one row per language; documents of null language share one.

    All words of all documents are counted. Each task sums its own counts first, so that a language's distinct words alone are
    shuffled, with its number of characters under a name that holds a space. Classes are then counted in distinct words.
    """
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    pair = lambda w, c: F.struct(w.alias("w"), c.cast("long").alias("c"))
    words = F.transform(F.split("t", r"[\x20\x09-\x0D]+"), lambda w: pair(w, F.lit(1)))
    counted = rows.select("lang", F.inline(F.concat(words, F.array(pair(F.lit(" "), F.length("t")))))).groupBy("lang", "w").agg(F.sum("c").alias("c")).filter("w <> ''")
    counted = cut(counted, "word-counts", "zstd")
    sizes = class_counts(counted.filter("w <> ' '").withColumn("one", F.array("w")), "w", "one")
    sums = sizes.groupBy("lang").agg(F.sum("c").alias("n"), *[F.sum(F.col("classes")[k] * F.col("c")).alias(c) for k, c in enumerate(CLASSES)])
    every = counted.filter("w = ' '").select(F.col("lang").alias("l"), F.col("c").alias("chars"))
    of = lambda c: F.coalesce(c, F.lit(0))
    totals = every.join(sums, F.col("l").eqNullSafe(F.col("lang")), "left").withColumn("white", F.col("chars") - sum((of(c) for c in CLASSES if c != "white"), F.lit(0)))
    small = counted.filter(F.col("w").rlike(r"\p{L}")).groupBy("lang", F.lower("w").alias("w")).agg(F.sum("c").alias("c"))
    first = Window.partitionBy("lang").orderBy(F.desc("c"), "w")
    top = small.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= common)
    lists = top.groupBy(F.col("lang").alias("l2")).agg(F.sort_array(F.collect_list(F.struct("r", "w", "c"))).alias("top"))
    joined = totals.join(lists, F.col("l").eqNullSafe(F.col("l2")), "left")
    shares = joined.select(
        "l",
        F.array(*[of(c) / F.greatest(F.lit(1), "chars") for c in CLASSES]).alias("ref_classes"),
        F.coalesce(F.col("top.w"), F.expr("cast(array() as array<string>)")).alias("ref_words"),
        F.transform(F.coalesce(F.col("top.c"), F.expr("cast(array() as array<bigint>)")), lambda c: c / F.greatest(F.lit(1), F.col("n"))).alias("ref_shares"),
    )
    shares = shares.withColumn("ref_longest", F.coalesce(F.array_max(F.transform("ref_words", lambda w: F.length(w))), F.lit(0)))
    return shares.withColumn("ref_none", js_distance(_with_rest(F.transform("ref_shares", lambda c: F.lit(0.0))), _with_rest(F.col("ref_shares"))))


def _with_rest(x: Column) -> Column:
    return F.array_append(x, F.greatest(F.lit(0.0), 1 - F.aggregate(x, F.lit(0.0), lambda s, y: s + y)))


def js_distance(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance of two arrays of shares, each of which sums to 1."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    total = F.aggregate(F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(F.lit(0.0), total / 2))


def _judged(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """row (the document's own columns), and the verdict's. Texts are read twice, for the references and for the verdicts, and never shuffled."""
    refs = cut(references(docs, text, lang), "references")
    # One row of some kilobytes for each language; beyond so many, Spark joins by shuffle.
    small = F.broadcast(refs) if refs.limit(2_001).count() <= 2_000 else refs
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), F.col(lang).cast("string").alias("own"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(small, F.col("own").eqNullSafe(F.col("l")))
    rows = _features(rows.drop("own", "l"))
    n, chars = F.greatest(F.lit(1), F.col("n_words")), F.aggregate("classes", F.lit(0).cast("long"), lambda s, x: s + x)
    rows = rows.withColumn("chars", chars).withColumn("shares", F.transform(common_counts(F.col("common"), F.col("ref_words")), lambda c: c / n))
    class_shares = F.transform("classes", lambda c: c / F.greatest(F.lit(1), F.col("chars")))
    rows = rows.withColumns(
        {
            "class_distance": F.when(F.col("chars") >= LEAST_CHARS, js_distance(class_shares, F.col("ref_classes"))).otherwise(0.0),
            "word_distance": F.when(F.col("n_words") >= LEAST_WORDS, js_distance(_with_rest(F.col("shares")), _with_rest(F.col("ref_shares")))).otherwise(0.0),
        }
    )
    base = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    white = F.col("classes")[CLASSES.index("white")]
    rows = rows.withColumn("base_failed", base)
    most, least, chance = map(F.lit, MOST_WORDS)
    near = F.col("word_distance") <= F.col("ref_none") * F.least(most, least + chance / F.sqrt(n))
    kept = ~F.col("base_failed") & (F.col("class_distance") <= MOST_CLASSES) & near
    return rows.select("row", "n_words", (F.col("chars") - white).cast("long").alias("word_chars"), F.col("n_symbols").cast("long").alias("n_symbols"), "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", kept.alias("kept"))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per document: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance, kept.

    A null text has no words and fails the base rule. A document of a null language is compared with the documents
    of no language. Documents with too few characters or words for a histogram have distance 0 there. Repeated
    rows keep their rows; other columns are left out; an empty table gives an empty table.
    """
    rows = _judged(docs.select(key, text, lang), text, lang)
    return rows.select(F.col("row")[key].alias(key), *[c for c in rows.columns if c != "row"])


def select_kept(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose document is kept, with their own columns, row by row.

    Spark would put a filter on the verdict below the selects that it is made in, and so make each of their parts as often as the
    verdict uses it; a filter that needs a row number stays above them.
    """
    rows = _judged(docs, text, lang).withColumn("number", F.monotonically_increasing_id())
    return rows.filter(F.col("kept") & (F.col("number") >= 0)).select("row.*")
