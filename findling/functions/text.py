"""Text functions as column expressions; all but the counts for an index stay in the JVM."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# English words that carry no meaning in search. Forms with an apostrophe are split by the tokenizer and so
# never match a token; they are listed as the set is defined with them.
STOPWORDS = tuple(
    """a about above after again against all am an and any are aren't as at be because been before being below between both but
    by can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't has
    hasn't have haven't having he he'd he'll he's her here here's hers herself him himself his how how's i i'd i'll i'm i've if
    in into is isn't it it's its itself let's me more most mustn't my myself no nor not of off on once only or other ought our
    ours ourselves out over own same shan't she she'd she'll she's should shouldn't so some such than that that's the their
    theirs them themselves then there there's these they they'd they'll they're they've this those through to too under until up
    very was wasn't we we'd we'll we're we've were weren't what what's when when's where where's which while who who's whom why
    why's with won't would wouldn't you you'd you'll you're you've your yours""".split()
)
MATCHING_STOPWORDS = tuple(w for w in STOPWORDS if "'" not in w)
# Openings that a derived query drops, and words it skips.
QUERY_OPENINGS = ("methods and systems are provided for", "a system for", "methods and systems for", "a method and apparatus for", "a method for", "an apparatus for", "method and system for")
QUERY_SKIPPED = ("the", "and", "for", "with", "that", "this")
# Headers that open and close a summary.
SUMMARY_OPEN = r"(?i)(?:SUMMARY OF THE INVENTION|BRIEF SUMMARY OF THE INVENTION|OBJECTS AND SUMMARY OF THE INVENTION|SUMMARY)\s*[\n\r]+"
SUMMARY_CLOSE = r"(?i)(?:BRIEF DESCRIPTION OF THE (?:DRAWINGS|FIGURES)|DETAILED DESCRIPTION)\s*[\n\r]+"


def present(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def words(c: Column) -> Column:
    """What stands between white space."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)\S+"))


def terms(c: Column, stopwords: bool = True) -> Column:
    """Search terms: lower-cased ASCII letters and digits, cut at all else; words with any other letter or with an underscore
    give none; stopwords go unless kept."""

    def good(x: Column) -> Column:
        own = x.rlike("^[a-z0-9]+$")
        return own & ~x.isin(*MATCHING_STOPWORDS) if stopwords else own

    return F.filter(F.split(F.lower(present(c)), r"[^\p{L}\p{N}_]+"), good)


def lower_words(c: Column) -> Column:
    return words(F.lower(present(c)))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once however often f uses it, also inside lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def term_counts(tokens: Column) -> Column:
    """Array of (term, tf), ordered by term. Counted in the row by a sort, so that no shuffle is needed."""

    def of_sorted(s: Column) -> Column:
        firsts = F.filter(F.transform(s, lambda _, i: i), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(firsts, lambda f: F.transform(f, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(f, k + 1), F.size(s)) - i).alias("tf"))))

    return let(F.array_sort(tokens), of_sorted)


COUNTED = "struct<dl:int,own:array<struct<term:string,tf:int>>>"
_PART = 256  # texts whose words are Python objects at once


def _counted(c: Column, find: Callable[[str], list[str]], good: Callable[[str], bool]) -> Column:
    def count(texts: pa.Array) -> pa.Array:
        parts = []
        for at in range(0, len(texts), _PART):
            sizes, ends, terms, counts = [], [0], [], []
            for text in texts.slice(at, _PART).to_pylist():
                own = sorted((t, n) for t, n in Counter(find(text)).items() if good(t))
                terms.extend(t for t, _ in own)
                counts.extend(n for _, n in own)
                sizes.append(sum(n for _, n in own))
                ends.append(len(terms))
            pairs = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(counts, pa.int32())], names=["term", "tf"])
            parts.append(pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], names=["dl", "own"]))
        empty = pa.array([], pa.struct([("dl", pa.int32()), ("own", pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())])))]))
        return pa.concat_arrays(parts) if parts else empty

    return F.arrow_udf(count, COUNTED)(c)


def counted_terms(c: Column) -> Column:
    """Number of terms() and term_counts() of them, counted by an Arrow function: expressions with lambdas run word by word.
    What a letter is, Java's version of Unicode says here too."""
    stop, parted = frozenset(MATCHING_STOPWORDS), F.regexp_replace(F.lower(present(c)), r"[^\p{L}\p{N}_ ]+", " ")
    return _counted(parted, str.split, lambda t: t.isascii() and "_" not in t and t not in stop)


def counted_words(c: Column) -> Column:
    """Number of lower_words() and term_counts() of them."""
    return _counted(F.lower(present(c)), re.compile(r"[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+").findall, lambda _: True)


def clean(c: Column) -> Column:
    """Single spaces, at most one empty line in a row, nothing at the ends."""
    return strip(F.regexp_replace(F.regexp_replace(present(c), "[ \t]{2,}|\t", " "), "\n{3,}", "\n\n"))


def unix_lines(c: Column) -> Column:
    return F.regexp_replace(present(c), "\r\n?", "\n")


def title_of(abstract: Column) -> Column:
    """First sentence of 15 to 200 characters, or else the first 150 characters up to a space; without leading numbering."""
    first = strip(F.split_part(abstract, F.lit("."), F.lit(1)))
    cut = F.concat(F.regexp_replace(F.substring(abstract, 1, 150), r" [^ ]*\z", ""), F.lit("..."))
    title = F.when(F.length(first).between(15, 200), first).otherwise(cut)
    return strip(F.regexp_replace(title, r"^(?:\[\d+\]|\d+\.|\([a-z]\))\s*", ""))


def summary_of(description: Column) -> Column:
    """What follows a summary header, or else the first two paragraphs of over 40 characters; 2000 characters at most."""
    after = F.get(F.split(description, SUMMARY_OPEN, 2), F.lit(1))
    closed = F.split(after, SUMMARY_CLOSE, 2)
    found = F.coalesce(F.when(F.size(closed) > 1, strip(F.get(closed, F.lit(0)))).otherwise(strip(F.substring(after, 1, 2500))), F.lit(""))
    blocks = F.filter(F.split(description, "\n\n"), lambda p: F.length(strip(p)) > 40)
    fallback = F.when(F.size(blocks) > 0, F.array_join(F.slice(blocks, 1, 2), "\n\n")).otherwise(F.substring(description, 1, 1500))
    return clean(F.substring(F.when(F.length(found) < 50, fallback).otherwise(found), 1, 2000))


def search_text(title: Column, abstract: Column, summary: Column) -> Column:
    return F.concat(F.lit("Title: "), title, F.lit("\n\nAbstract: "), abstract, F.lit("\n\nSummary: "), summary)


def pair_text(title: Column, abstract: Column) -> Column:
    """What a pair scorer reads of a document."""
    t, a = strip(present(title)), strip(present(abstract))
    return F.when(F.length(a) > 0, F.concat(t, F.lit(" — "), a)).otherwise(t)


def embed_text(title: Column, abstract: Column, most: int = 8000) -> Column:
    """What an encoder reads of a document of the corpus."""
    return F.substring(F.concat(F.lit("Title: "), present(title), F.lit("\nAbstract: "), present(abstract)), 1, most)


def ingest_text(title: Column, abstract: Column, most: int = 4000) -> Column:
    """What an encoder reads of an ingested document."""
    t, a = present(title), present(abstract)
    return F.substring(F.when(a != "", F.concat(t, F.lit(" — "), a)).otherwise(t), 1, most)


def query_of(title: Column) -> Column:
    """A query made of a title: up to eight words of over two letters, after a known opening."""
    low = F.lower(title)
    rest = low
    for opening in reversed(QUERY_OPENINGS):
        rest = F.when(low.startswith(opening), strip(F.substring(low, len(opening) + 1, 1 << 30))).otherwise(rest)
    kept = F.filter(words(rest), lambda w: (F.length(w) > 2) & ~w.isin(*QUERY_SKIPPED))
    return F.array_join(F.slice(kept, 1, 8), " ")


def without_fences(c: Column) -> Column:
    """A model's JSON answer without the code fences around it."""
    return F.regexp_replace(F.regexp_replace(strip(c), r"^```(?:json)?\s*", ""), r"\s*```\z", "")
