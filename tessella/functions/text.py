"""Text measures, numbers, names and segmentation as Column expressions.

White space is Unicode's, as (?U) makes it in Java's patterns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import let, places_below, running_sums

BLANK = r"(?U)\s"
#: Non-blank characters that a full page of text has.
FULL_PAGE = 1800.0
#: Share of broken characters above which a text layer is garbled.
GARBLED_ABOVE = 0.2


def trim_all(t: Column) -> Column:
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def words(t: Column) -> Column:
    """Non-empty chunks between white space."""
    return F.filter(F.split(t, r"(?U)\s+"), lambda x: x != "")


def visible(t: Column) -> Column:
    return F.regexp_replace(t, BLANK, "")


def text_coverage(t: Column) -> Column:
    return F.least(F.length(visible(t)) / FULL_PAGE, F.lit(1.0))


def garble_ratio(t: Column) -> Column:
    v = visible(t)
    return F.when(F.length(v) > 0, F.regexp_count(v, F.lit(r"[\x{FFFD}\p{Cc}]")) / F.length(v)).otherwise(0.0)


def is_garbled(t: Column) -> Column:
    return garble_ratio(t) > GARBLED_ABOVE


def is_usable(t: Column) -> Column:
    return ~is_garbled(t) & (F.length(visible(t)) > 0)


def repetition_ratio(t: Column, n: int = 3) -> Column:
    """1 - distinct / all word n-grams; 0 with fewer than n words.

    An n-gram is its words with one blank between them (no word has one): strings are told apart
    by hashing, structs one by one.
    """
    if n == 0:
        return F.lit(0.0)

    def grams(w: Column) -> Column:
        out = w
        for k in range(1, n):
            out = F.zip_with(out, F.slice(w, k + 1, F.size(w)), lambda x, y: F.concat(x, F.lit(" "), y))
        return F.slice(out, F.lit(1), F.size(w) - (n - 1))

    return let(words(t), lambda w: F.when(F.size(w) >= n, 1.0 - F.size(F.array_distinct(grams(w))) / (F.size(w) - (n - 1))).otherwise(0.0))


def paragraphs(t: Column) -> Column:
    """(offset in UTF-8 bytes, text) of the parts between blank lines that are not blank."""

    def placed(parts: Column) -> Column:
        at = running_sums(F.transform(parts, lambda p: F.octet_length(p).cast("long") + 2))
        both = F.zip_with(at, parts, lambda a, p: F.struct(a.alias("offset"), p.alias("text")))
        return F.filter(both, lambda x: x["text"].rlike(r"(?U)\S"))

    return let(F.split(t, "\n\n", -1), placed)


def trimmed_paragraphs(t: Column) -> Column:
    return F.filter(F.transform(F.split(t, "\n\n", -1), trim_all), lambda p: p != "")


def number_strings(t: Column) -> Column:
    """Runs of digits, commas, dots and underscores that start with a digit, with a sign right before."""
    return F.regexp_extract_all(t, F.lit(r"([-+]?[0-9][0-9,._]*)"), F.lit(1))


def number_value(s: Column) -> Column:
    """Grouping marks dropped, one final dot cut; null with more than one dot."""
    bare = F.regexp_replace(s, "[,_]", "")
    return F.when(F.regexp_count(bare, F.lit(r"\.")) <= 1, F.regexp_replace(bare, r"\.$", "").try_cast("double"))


def numbers(t: Column) -> Column:
    return F.filter(F.transform(number_strings(t), number_value), lambda x: x.isNotNull())


def approx_equal(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= 1e-6 * F.greatest(F.abs(a), F.abs(b), F.lit(1.0))


def unmatched_numbers(generated: Column, known: Column) -> Column:
    """Numbers of one text that the other does not have.

    If any known number is near enough, the nearest one below or above is.
    """

    def missing(v: Column) -> Column:
        near = lambda x, i: F.coalesce(approx_equal(F.get(v["k"], i), x), F.lit(False))
        with_place = F.zip_with(v["g"], places_below(v["k"], v["g"]), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
        return F.transform(F.filter(with_place, lambda p: ~near(p["x"], p["i"]) & ~((p["i"] > 0) & near(p["x"], F.greatest(p["i"] - 1, F.lit(0))))), lambda p: p["x"])

    return let(F.struct(numbers(generated).alias("g"), F.array_sort(numbers(known)).alias("k")), missing)


def divergence(generated: Column, known: Column) -> Column:
    n = F.size(numbers(generated))
    return F.when(n > 0, F.size(unmatched_numbers(generated, known)) / n).otherwise(0.0)


#: Clitics in the order in which they are tried.
CLITICS = ("n't", "'s", "'re", "'ve", "'ll", "'d", "'m")
CLITIC = r"(?is)^(.+?)(" + "|".join(CLITICS) + ")$"


def split_clitic(token: Column) -> Column:
    """The token, or its (shortest) stem and its clitic."""
    tail = F.regexp_extract(token, CLITIC, 2)
    return F.when(tail != "", F.array(F.regexp_extract(token, CLITIC, 1), tail)).otherwise(F.array(token))


def apply_lemma_script(word: Column, script: Column) -> Column:
    """"case|strip|append": lower-case if case is not empty, drop strip characters, append; the word if malformed."""
    p = F.split(script, r"\|", 3)
    w = F.when(p[0] == "", word).otherwise(F.lower(word))
    n = F.coalesce(F.when(p[1].rlike(r"^\+?[0-9]+$"), p[1].try_cast("int")), F.lit(0))
    return F.when(F.size(p) < 3, word).otherwise(F.concat(F.substring(w, F.lit(1), F.greatest(F.length(w) - n, F.lit(0))), p[2]))


#: Words that do not count when names are compared.
FUNCTION_WORDS = (
    "the", "a", "an", "of", "and", "&", "'s", "’s", ",", ".", "-", "inc", "inc.", "ltd", "ltd.", "co", "co.", "corp", "corp.", "mr", "mr.", "mrs", "mrs.", "dr", "dr.",
)


def name_words(tokens: Column) -> Column:
    return F.filter(F.transform(tokens, F.lower), lambda t: ~t.isin(*FUNCTION_WORDS))


def is_acronym(short: Column, long: Column) -> Column:
    """Whether short, dots dropped, is the initials of long's capitalised content words (two or more)."""
    s = F.replace(F.array_join(short, ""), F.lit("."), F.lit(""))
    caps = F.filter(long, lambda t: t.rlike(r"^\p{Lu}") & ~F.lower(t).isin(*FUNCTION_WORDS))
    initials = F.array_join(F.transform(caps, lambda t: F.substring(t, 1, 1)), "")
    return (F.length(s) >= 2) & ~s.rlike(r"\p{Ll}") & s.rlike(r"\p{Lu}") & (F.size(caps) >= 2) & (s == initials)


def names_compatible(a: Column, b: Column) -> Column:
    """Equal content words, one's among the other's, or an acronym; never if a side has none."""
    x, y = name_words(a), name_words(b)
    a_short = F.size(x) <= F.size(y)
    within = F.when(a_short, F.size(F.array_except(x, y)) == 0).otherwise(F.size(F.array_except(y, x)) == 0)
    acronym = F.when(a_short, is_acronym(a, b)).otherwise(is_acronym(b, a))
    return (F.size(x) > 0) & (F.size(y) > 0) & ((x == y) | within | acronym)


def label_at(labels: Column, k: Column) -> Column:
    return F.coalesce(F.get(labels, k), F.concat(F.lit("UNK_"), k.cast("string")))


def labelled(kind: str, name: Column, description: Column) -> Column:
    """"kind: NAME" or "kind: NAME. DESCRIPTION"."""
    return F.concat(F.lit(f"{kind}: "), name, F.when(F.coalesce(description, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(". "), description)))


def rerank_prompt(system: str, instruction: Column, query: Column, doc: Column) -> Column:
    """Fixed format: a chat prompt that asks a causal model for yes or no, with an empty thought."""
    return F.concat(
        F.lit(f"<|im_start|>system\n{system}<|im_end|>\n<|im_start|>user\n<Instruct>: "), instruction, F.lit("\n\n<Query>: "), query, F.lit("\n\n<Document>: "), doc,
        F.lit("<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n"),
    )


def ocr_block_text(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x: F.length(trim_all(x)) > 0), "\n")


def needs_tokenizing(t: Column, most_tokens: int) -> Column:
    """Whether a text may be longer than most_tokens with its two markers: no token is shorter than a character."""
    return F.length(t) > most_tokens - 2


def plan_input(tokens: Column, most: int) -> Column:
    """Tokens if they fit, else the first most - 1 and the last one."""
    return F.when(F.size(tokens) <= most, tokens).otherwise(F.concat(F.slice(tokens, 1, most - 1), F.slice(tokens, -1, 1)))


def surface(text: Column, start: Column, end: Column, words: Column) -> Column:
    """The bytes [start, end) of a text, or the words with blanks between where there are no such bytes."""
    raw = text.cast("binary")
    inside = (start >= 0) & (start <= end) & (end <= F.octet_length(text))
    return F.coalesce(F.when(inside, F.substring(raw, start + 1, end - start).cast("string")), F.array_join(words, " "))


def space_class(classes: Column, dictionary: Column, use_space: bool | None = None) -> Column:
    """(has_space, error): whether a recogniser's last class is a space, by how many classes it has beside blank and dictionary."""
    has = F.lit(use_space) if use_space is not None else classes - 1 == dictionary + 1
    return F.struct(has.alias("has_space"), F.when(classes - 1 != dictionary + has.cast("int"), "classes do not fit the dictionary").alias("error"))


def safe_name(model: Column) -> Column:
    return F.regexp_replace(F.replace(model, F.lit("/"), F.lit("--")), r"[^\p{L}\p{N}\-_.]", "")


def redact_url(url: Column) -> Column:
    """url without what stands before its last @, its query and its fragment."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?://)", 1)
    rest = F.substring(url, F.length(scheme) + 1, F.length(url))
    rest = F.regexp_replace(F.regexp_replace(rest, r"(?s)^.*@", ""), r"^/+", "")
    return F.concat(scheme, F.regexp_replace(rest, r"(?s)[?#].*$", ""))
