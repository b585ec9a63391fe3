"""Text features of instructions: built-in expressions, and Python's own splitting where every token counts."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ALGORITHMS, LEXICON, NESTING

#: Unicode white space as a regular expression class body.
WHITE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


#: Letters that fold to ASCII ones in a match that ignores case.
FOLDED = ("\u0130\u0131\u017f\u212a", "iisk")


def word_pattern(words: tuple[str, ...]) -> str:
    """Whole words in either case; ``U`` makes word boundaries Unicode-aware on every Java version.

    Where all words begin with ASCII letters, two tests of one character go in front: the first letter, and
    no ASCII letter, digit or underscore before it.  They fail only where the rest would fail too, and spare
    most places the costly Unicode boundary.
    """
    out = r"(?iU)\b(" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + r")\b"
    if not all(re.match("[A-Za-z]", w) for w in words):
        return out
    firsts = "".join(sorted({c for w in words for c in (w[0].lower(), w[0].upper())}))
    return f"(?=[{firsts}{FOLDED[0]}])(?<![A-Za-z0-9_])" + out


def word_count(text: Column, words: tuple[str, ...]) -> Column:
    """Whole-word matches of any of the words, in either case (Unicode)."""
    return F.coalesce(F.regexp_count(text, F.lit(word_pattern(words))), F.lit(0))


def word_counts(text: Column, lexicon: dict[str, tuple[str, ...]], other: Column, body) -> Column:
    """``body`` of the counts of each list and of another column, from one scan where no phrase holds another list's word."""
    words = tuple(dict.fromkeys(w for own in lexicon.values() for w in own))
    if any(x in words for w in words if " " in w for x in w.split()):
        return body({k: word_count(text, own) for k, own in lexicon.items()}, other)
    hits = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(word_pattern(words)), F.lit(1)), lambda w: F.lower(F.translate(w, *FOLDED)))
    among = lambda found, own: F.size(F.filter(found, lambda w: w.isin(*own)))
    # a transform over one element keeps the hits from being found anew for every list
    once = F.array(F.struct(hits.alias("hits"), other.alias("other")))
    return F.element_at(F.transform(once, lambda x: body({k: among(x["hits"], own) for k, own in lexicon.items()}, x["other"])), 1)


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WHITE}]+")), F.lit(0))


def token_facts(text: Column) -> Column:
    """Tokens, their characters and the different ones among them, in one pass; ``str.split`` knows the same
    white space as ``WHITE``."""

    def run(values: pd.Series) -> pd.DataFrame:
        rows = []
        for value in values:
            words = value.split() if value else []
            rows.append((len(words), sum(map(len, words)), len(set(words))))
        return pd.DataFrame(rows, columns=["n", "chars", "different"], dtype="int64")

    run.__annotations__ = {"values": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "struct<n:int,chars:long,different:int>")(text)


def mean_token_length(text: Column) -> Column:
    n = token_count(text)
    return F.when(n > 0, F.length(F.regexp_replace(text, f"[{WHITE}]", "")) / n).otherwise(0.0)


def instruction_features(text: Column, lexicon: dict[str, tuple[str, ...]] = LEXICON) -> Column:
    """Struct of the ten ``inst_`` features; all zero for null and blank text."""

    def body(count: dict[str, Column], facts: Column) -> Column:
        return F.struct(
            facts["n"].alias("inst_tokens"),
            *[count[k].alias(f"inst_{k}_count") for k in ("if", "conditional", "loop", "collection", "class", "func", "logic")],
            (count["if"] + count["loop"] + count["class"] + count["func"]).alias("inst_total_structural"),
            F.when(facts["n"] > 0, facts["chars"] / facts["n"]).otherwise(0.0).alias("inst_avg_word_len"),
        )

    return word_counts(text, lexicon, token_facts(text), body)


def patterns_present(text: Column, patterns: tuple[str, ...]) -> Column:
    """How many of the patterns occur at all, as substrings in either case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a + b, [F.contains(low, F.lit(p)).cast("int") for p in patterns])


def lexical_diversity(text: Column) -> Column:
    """Distinct lower-case tokens by ln(tokens + 1); 0 without tokens."""
    found = token_facts(F.lower(text))
    return F.when(found["n"] > 0, found["different"] / F.log(found["n"] + 1.0)).otherwise(0.0)


def intent_features(text: Column) -> Column:
    return F.struct(
        patterns_present(text, NESTING).alias("nesting_intent"),
        patterns_present(text, ALGORITHMS).alias("algo_intent"),
        lexical_diversity(text).alias("instruction_complexity_score"),
    )
