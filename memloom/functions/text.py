"""Text expressions: tokens, answer normalisation, overlap measures, dates.  All are JVM-side columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words of the sparse retrievers.
STOP_WORDS = (
    "a an and are as at be by did do does for from had has have he her hers him his how i in is it its me my of on or our s she "
    "that the their them they this to was we were what when where which who why with you your"
).split()

# The 32 ASCII punctuation characters that answers lose, and the articles.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = "a|an|the"

#: A word: letters, numbers and the underscore of any script.
WORD = r"[\p{L}\p{N}_]+"
#: White space as Python's ``str.split`` sees it.
SPACE = r"[\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def all_words(text: Column) -> Column:
    """``array<string>`` of the words as written; null gives none."""
    return F.regexp_extract_all(or_empty(text), F.lit(WORD), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-case words without stop words."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(all_words(F.lower(text)), lambda w: ~F.array_contains(stop, w))


def split_words(text: Column) -> Column:
    """Parts between white space, without empty ones."""
    return F.filter(F.split(or_empty(text), SPACE), lambda w: w != "")


def normalize_answer(text: Column) -> Column:
    """Lower case, punctuation deleted, articles and repeated white space removed; null counts as empty."""
    bare = F.translate(F.lower(or_empty(text)), PUNCTUATION, "")
    bare = F.regexp_replace(bare, rf"(?<![\p{{L}}\p{{N}}_])(?:{ARTICLES})(?![\p{{L}}\p{{N}}_])", " ")
    return F.array_join(split_words(bare), " ")


def exact_match(predicted: Column, gold: Column) -> Column:
    return (normalize_answer(predicted) == normalize_answer(gold)).cast("double")


def token_f1(predicted: Column, gold: Column) -> Column:
    """F1 of the two bags of normalised words; if one is empty, 1 if both are."""

    def measure(p: Column, g: Column) -> Column:
        def times(bag: Column, w: Column) -> Column:
            return F.size(F.filter(bag, lambda x: x == w))

        common = F.aggregate(F.array_distinct(p), F.lit(0), lambda acc, w: acc + F.least(times(p, w), times(g, w)))
        return (
            F.when((F.size(p) == 0) | (F.size(g) == 0), (F.size(p) == F.size(g)).cast("double"))
            .when(common == 0, F.lit(0.0))
            .otherwise(2.0 * common / (F.size(p) + F.size(g)))
        )

    # The bags are bound once, as the one element of an array; inside the lambdas they would be made for every word.
    bags = F.struct(split_words(normalize_answer(predicted)).alias("p"), split_words(normalize_answer(gold)).alias("g"))
    return F.transform(F.array(bags), lambda s: measure(s["p"], s["g"]))[0]


def parse_date(raw: Column) -> Column:
    """Date of the first ``day month year`` in a text (full or abbreviated English month), else null."""
    form = r"(\d{1,2})\s+([A-Za-z]+),?\s+(\d{4})"
    part = [F.regexp_extract(or_empty(raw), form, i) for i in (1, 2, 3)]
    plain = F.concat_ws(" ", *part)
    return F.coalesce(F.try_to_date(plain, "d MMMM yyyy"), F.try_to_date(plain, "d MMM yyyy"))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two ``array<double>``."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))
