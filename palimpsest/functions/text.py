"""Text functions as Column expressions: tokens, stop words, classes, matching, hashing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_STOP = "about been could from have just other should some that the their there this were what when where which will with would".split()
QUERY_STOP = (
    "a about above after again an are be been before being below between can could did do does during exist exists for from had has have into is know like "
    "may might must need shall should tell that the these think this those through under want was were what when where which who whom will with would you your"
).split()
EMBED_STOP = (
    "a above after again all an and are as at be because been before being below between but by can could dare did do does during each few for from further "
    "had has have here how if in into is just may might more most must need no nor not of on once only or other ought own same shall should so some such than "
    "that the then there these this those through to too under until used very was were what when where which while who whom why will with would"
).split()
PATTERN_STOP = "a an and at but for in is of on or the to which with".split()
WORD_BREAK = r"[^\p{IsAlphabetic}\p{N}_]+"
TRIM = r"^[^\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+$"


def words(text: Column) -> Column:
    """Parts between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def index_terms(text: Column) -> Column:
    """Terms of the inverted index: lower case, letters, digits and `_`, two bytes or more."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAK), lambda t: F.octet_length(t) >= 2)


def bloom_words(text: Column) -> Column:
    """Words for the Bloom filter: parts between white space, trimmed to letters and digits, of two bytes or more, in lower case."""
    trimmed = F.transform(words(F.lower(text)), lambda w: F.regexp_replace(w, TRIM, ""))
    return F.filter(trimmed, lambda w: F.octet_length(w) >= 2)


def embed_tokens(text: Column, stop: bool = True, apostrophe: bool = True) -> Column:
    """Tokens for embeddings: more than two bytes, by default without stop words and with inner apostrophes."""
    t = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{IsAlphabetic}\p{N}']+" if apostrophe else r"[^\p{IsAlphabetic}\p{N}]+")
    return F.filter(t, lambda w: (F.octet_length(w) > 2) & (~w.isin(EMBED_STOP) if stop else F.lit(True)))


def classify(text: Column) -> Column:
    """Procedural, Semantic or Episodic by phrases, in this order; the text is brought to lower case once a row, also where a filter evaluates this."""
    some = lambda t, *p: reduce(lambda a, b: a | b, [t.contains(x) for x in p])

    def kind(t: Column) -> Column:
        procedural = (t.contains("when ") & t.contains(" then ")) | some(t, "pattern:", "how to ", "always ", "never ")
        return F.when(procedural, "Procedural").when(some(t, " is ", " are ", " means ", "definition:", "fact:"), "Semantic").otherwise("Episodic")

    return F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), kind)[0]


def key_info(text: Column) -> Column:
    """The first five words of more than four bytes that are no stop words, trimmed and in lower case."""
    trimmed = F.transform(words(text), lambda w: F.regexp_replace(w, TRIM, ""))
    good = F.filter(trimmed, lambda w: (F.octet_length(w) > 4) & ~F.lower(w).isin(KEY_STOP))
    return F.slice(F.transform(good, lambda w: F.lower(w)), 1, 5)


def query_keywords(query: str) -> list[str]:
    """The words of a query that are worth a search."""
    trimmed = (w.strip("".join(c for c in w if not c.isalnum())) for w in query.split())
    return [w for w in trimmed if len(w.encode()) > 2 and w.lower() not in QUERY_STOP]


def fuzzy(text: Column, pattern: str) -> Column:
    """Whether the characters of the pattern occur in the text in this order, whatever the case."""
    # the gap before a character holds none of it, so that no text is searched in vain again and again
    chars = [f"\\x{{{ord(c):x}}}" for c in pattern.lower()]
    return F.lower(text).rlike(chars[0] + "".join(f"[^{c}]*{c}" for c in chars[1:])) if chars else F.lit(True)


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def djb2(token: Column) -> Column:
    """The 32-bit djb2 hash of the UTF-8 bytes."""
    h = F.hex(F.encode(token, "UTF-8"))
    at = F.when(F.length(h) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.length(h) - 1, F.lit(2)))
    return F.aggregate(at, F.lit(5381).cast("bigint"), lambda a, i: (a * 33 + F.conv(h.substr(i, F.lit(2)), 16, 10).cast("bigint")) % (1 << 32))


def relation(name: Column) -> Column:
    """The normal form of a relation's name; unknown names stay, in lower case."""
    low = F.lower(name)
    return F.when(low == "partof", "part_of").otherwise(low)


def bullets(text: Column, most: int = 5) -> Column:
    """Facts in the lines that begin with -, * or a bullet, of more than five bytes."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    items = F.filter(lines, lambda x: x.rlike(r"^[-*•]"))
    facts = F.transform(items, lambda x: F.trim(F.regexp_replace(x, r"^[-*•]+\s*", "")))
    return F.slice(F.filter(facts, lambda x: F.octet_length(x) > 5), 1, most)


def jaccard(a: Column, b: Column) -> Column:
    """Of the sets of lower-case words; 0 if both are empty."""
    x, y = F.array_distinct(words(F.lower(a))), F.array_distinct(words(F.lower(b)))
    n = F.size(F.array_union(x, y))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(n, F.lit(1)))


def tag_similarity(a: Column, b: Column) -> Column:
    """Members of a that b holds, by the size of the longer; 0 if both are empty."""
    n = F.greatest(F.size(a), F.size(b))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.filter(a, lambda t: F.array_contains(b, t))) / F.greatest(n, F.lit(1)))
