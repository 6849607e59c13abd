"""Quality rules: Jensen-Shannon distance of a document's histograms to those of its language.

Two histograms are taken of each text: of character classes (upper-case letters, other letters and marks, digits, punctuation, symbols, white space) and of
the common words of its language (one bin for each, one for all others). A language's reference is the sum over all its documents. A
document is rejected if either distance (base 2, from 0 to 1) is over its threshold; texts under a minimum length aren't judged by that
histogram, nor are those of languages with under `min_reference` words in all. Everything runs in DataFrame functions.

Contract of judged(): whole texts (null: no words); the base columns are those of the module's names; base_failed documents aren't kept. One
row per input row; null ids and languages are allowed (a null language is one of its own); an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import settled
from .native import BLANK, join_small, let, whole, words_of

# Common words by language.
COMMON = {
    "en": "the of and to a in that is was he for it with as",
    "de": "der die und in den von zu das mit sich des auf für ist",
    "fr": "de la le et les des en un du une que est pour qui",
    "es": "de la que el en y a los se del las un por con",
}
#: A language without a list is held against all lists' words together.
OTHERS = "the of and der die und de la le les que el los en"
BINS = 14
CLASSES = ("upper", "digit", "mark", "symbol", "blank", "rest")
MAX_CLASS_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.30
MIN_CHARS = 200
MIN_WORDS = 100
MIN_REFERENCE = 1000
GRAM = 5


def count_of(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


UPPER, DIGIT, MARK, SYMBOL = r"\p{Lu}", "0-9", r".,;:!?'\"()\-", "#*$%&|<>"


def common_only(text: Column, words: str) -> Column:
    """The text without the words that aren't in the list."""
    return F.regexp_replace(text, rf"(?<![^ \t-\r])(?!(?:{'|'.join(words.split())})(?![^ \t-\r]))[^ \t-\r]++", "")


def measured(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """The table with __text, __lang, n_chars, class counts c_* and common-word counts w_*."""
    key = F.coalesce(F.concat(F.lit("="), F.col(lang).cast("string")), F.lit(""))
    df = docs.select("*", whole(text).alias("__text"), key.alias("__lang"))
    low = F.lower("__text")
    named = {**COMMON, None: OTHERS}
    lists, common = F.lit(OTHERS.replace(" ", ",")), common_only(low, OTHERS)
    for name, words in COMMON.items():
        lists = F.when(F.col("__lang") == f"={name}", F.lit(words.replace(" ", ","))).otherwise(lists)
        common = F.when(F.col("__lang") == f"={name}", common_only(low, named[name])).otherwise(common)
    # letters of the class "rest" go in one pass, so that the counts run over what is left
    special = F.regexp_replace("__text", rf"[^{UPPER}{DIGIT}{MARK}{SYMBOL} \t-\r]++", "")
    df = df.select("*", F.length("__text").alias("__chars"), special.alias("__special"), words_of(common).alias("__common"), lists.alias("__list"))
    codes = F.array_join(F.transform("__common", lambda w: F.chr(F.find_in_set(w, F.col("__list")) + 64)), "")
    classes = {"upper": f"[{UPPER}]+", "digit": f"[{DIGIT}]+", "mark": f"[{MARK}]+", "symbol": f"[{SYMBOL}]+", "blank": BLANK + "+"}
    df = df.select("*", codes.alias("__codes"), *(count_of(F.col("__special"), c).alias(f"c_{n}") for n, c in classes.items()), (F.col("__chars") - F.length("__special")).alias("c_rest"))
    return df.select("*", *((F.length("__codes") - F.length(F.replace(F.col("__codes"), F.lit(chr(65 + k)), F.lit("")))).alias(f"w_{k}") for k in range(BINS)))


def references(measures: DataFrame) -> DataFrame:
    names = [f"c_{c}" for c in CLASSES] + [f"w_{k}" for k in range(BINS + 1)]
    return measures.groupBy("__lang").agg(*(F.sum(n).alias(f"r{n}") for n in names), F.sum("n_words").alias("r_words"))


def distance(own: list[Column], reference: list[Column]) -> Column:
    """Jensen-Shannon distance of two histograms given as counts; 0 if either is empty."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)
    term = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    def divergence(x: Column) -> Column:
        shares = F.zip_with(x["p"], x["q"], lambda p, q: F.struct((p / x["n"]).alias("p"), (q / x["r"]).alias("q")))
        parts = F.transform(shares, lambda s: term(s["p"], (s["p"] + s["q"]) / 2) + term(s["q"], (s["p"] + s["q"]) / 2))
        return F.when((x["n"] > 0) & (x["r"] > 0), F.sqrt(F.greatest(F.lit(0.0), total(parts) / 2))).otherwise(0.0)

    p, q = F.array(*own).cast("array<double>"), F.coalesce(F.array(*reference).cast("array<double>"), F.array().cast("array<double>"))
    return let(F.struct(p.alias("p"), q.alias("q")), lambda x: let(F.struct(x["p"].alias("p"), x["q"].alias("q"), total(x["p"]).alias("n"), F.coalesce(total(x["q"]), F.lit(0.0)).alias("r")), divergence))


def repeated_words(words: Column, size: int = GRAM) -> Column:
    """Words that stand in windows of `size` words found twice or more in the text."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    n = F.size(words)
    grams = let(hashes, lambda h: F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(size)))))

    def covered(g: Column) -> Column:
        placed = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def at_places(s: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(s, a)["h"] == F.get(s, b)["h"], F.lit(False))
            k = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
            places = F.array_sort(F.transform(k, lambda k: F.get(s, k)["i"]))
            start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
            step = lambda acc, p: F.struct((p + size).alias("end"), (acc["n"] + p + size - F.greatest(acc["end"], p)).alias("n"))
            return F.aggregate(places, start, step)["n"]

        return F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(let(placed, at_places))

    return F.when(n < size, 0).otherwise(let(grams, covered)).cast("long")


def verdicts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_class_distance: float = MAX_CLASS_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, min_reference: int = MIN_REFERENCE, slim: bool = False) -> DataFrame:
    """The table (slim: its ids only) with the base columns, class_distance, word_distance, base_failed and kept beside its own (internal ones start with __)."""
    source = docs.select(*(F.col(f"`{c}`").alias(f"__in_{i}") for i, c in enumerate(docs.columns)))
    names = {c: f"__in_{i}" for i, c in enumerate(docs.columns)}
    counts = measured(source, names[text], names[lang]).withColumn("__words", words_of(F.col("__text"))).withColumn("n_words", F.size("__words").cast("long"))
    counts = counts.withColumn(f"w_{BINS}", F.col("n_words") - F.size("__common"))
    lines = F.filter(F.split("__text", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    rows = counts.select(
        *([names[doc_id]] if slim else names.values()), "__lang", "__chars", "n_words", *(f"c_{c}" for c in CLASSES), *(f"w_{k}" for k in range(BINS + 1)),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__words")).alias("n_repeat_words"),
    )
    # references need all rows first: rows without their texts are kept for that, those with texts are counted again, as a copy of all texts costs more than that
    if slim:
        rows = counts = settled(rows)
    df = join_small(rows, references(counts), ["__lang"], F.col(names[doc_id]))
    known = F.coalesce(F.col("r_words"), F.lit(0)) >= min_reference
    chars = distance([F.col(f"c_{c}") for c in CLASSES], [F.col(f"rc_{c}") for c in CLASSES])
    common = distance([F.col(f"w_{k}") for k in range(BINS + 1)], [F.col(f"rw_{k}") for k in range(BINS + 1)])
    df = df.select(
        "*", (F.col("__chars") - F.col("c_blank")).cast("long").alias("word_chars"), F.col("c_symbol").cast("long").alias("n_symbols"),
        F.when(known & (F.col("__chars") >= min_chars), chars).otherwise(0.0).alias("class_distance"),
        F.when(known & (F.col("n_words") >= min_words), common).otherwise(0.0).alias("word_distance"),
    )
    df = df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("class_distance") <= max_class_distance) & (F.col("word_distance") <= max_word_distance))


OUT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"]


def judged(docs: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and both distances."""
    df = verdicts(docs, doc_id=doc_id, slim=True, **options)
    return df.select(F.col(f"__in_{docs.columns.index(doc_id)}").alias("doc_id"), *OUT)


def keep(docs: DataFrame, **options) -> DataFrame:
    """The documents that the rules keep, with the table's own columns."""
    df = verdicts(docs, **options).where("kept")
    return df.select(*(F.col(f"__in_{i}").alias(c) for i, c in enumerate(docs.columns)))
