"""Ordered rewriting of short texts.

A rule is a pattern and a replacement (``\\1`` for groups), in the common subset of
Java's and Python's regular expressions.  Order matters.  Short tables become a chain
of ``regexp_replace``, which stays inside code generation with patterns compiled once;
long ones are run by an Arrow UDF with precompiled patterns, as a long chain outgrows
the limit of a generated method.  Both give the same text (tests hold them together).
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.rules import wordings
from quillon.rules.tables import NUMBER_WORDS

Rule = tuple[str, str]
#: Rules up to which a chain is used.
CHAIN = 40


def spelling_rules(words: Mapping[str, Sequence[str]]) -> list[Rule]:
    """A rule for each standard word; the longest spelling is tried first, words in it may be apart by any space."""
    spelled = lambda ws: "|".join(re.escape(w).replace(r"\ ", r"\s+") for w in sorted(ws, key=lambda w: (-len(w), w)))
    return [(rf"\b(?:{spelled(own)})\b(?!\s+{re.escape(word.split(' ')[-1])}\b)" if " " in word else rf"\b(?:{spelled(own)})\b", word) for word, own in words.items()]


@cache
def shipped_rules() -> dict[str, list[Rule]]:
    """The rules that have conditions of their own, and those for every text (``main``), in order."""
    main = [r for part in wordings.ORDER for r in (wordings.PATTERNS[part] if isinstance(part, str) else spelling_rules(part))]
    return {"contrast": list(wordings.PATTERNS["contrast"]), "breast": list(wordings.PATTERNS["breast"]), "main": main}


def main_rules() -> list[Rule]:
    """Number words, then the rules for every text."""
    return [(rf"\b{word}\b", str(n)) for n, word in enumerate(NUMBER_WORDS)] + shipped_rules()["main"]


def valid_rules(rules: Sequence[Rule]) -> list[Rule]:
    """User rules whose pattern compiles and whose groups exist; others are left out."""
    out = []
    for pattern, replacement in rules:
        try:
            found = re.compile(pattern)
        except (re.error, TypeError):
            continue
        if pattern and replacement is not None and all(int(g) <= found.groups for g in re.findall(r"\\(\d)", replacement)):
            out.append((pattern, replacement))
    return out


def java_replacement(replacement: str) -> str:
    """``\\1`` as ``$1``; other backslashes and dollars are literal."""
    return "".join(f"${part[1]}" if re.fullmatch(r"\\\d", part) else part.replace("\\", "\\\\").replace("$", "\\$") for part in re.split(r"(\\\d)", replacement))


def fold_rules(text: Column, rules: Sequence[Rule], impl: str = "auto", ignore_case: bool = False) -> Column:
    """Apply ``rules`` in order; ``impl``: ``chain``, ``fold`` (over an array of rules), ``arrow`` or ``auto``."""
    flag = "(?i)" if ignore_case else ""
    if impl == "auto":
        impl = "chain" if len(rules) <= CHAIN else "arrow"
    if impl == "chain":
        for p, r in rules:
            text = F.regexp_replace(text, flag + p, java_replacement(r))
        return text
    if impl == "fold":
        table = F.array(*[F.struct(F.lit(flag + p).alias("p"), F.lit(java_replacement(r)).alias("r")) for p, r in rules])
        return F.aggregate(table, text, lambda acc, x: F.regexp_replace(acc, x["p"], x["r"]))

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        compiled = [(re.compile(flag + p, re.ASCII), re.sub(r"\\(?!\d)", r"\\\\", r)) for p, r in rules]

        def one(t):
            if t is not None:
                for p, r in compiled:
                    t = p.sub(r, t)
            return t

        return texts.map(one)

    return run(text)


def contrast_text(text: Column) -> Column:
    """Upper-cased text with contrast wordings spelled out."""
    return fold_rules(F.upper(F.coalesce(text, F.lit(""))), shipped_rules()["contrast"], "chain")


def conditional_rewrite(text: Column, when: str = r"\b(?:MM|MG|MAMMO(?:GRAM|GRAPHY)?)\b", rules: Sequence[Rule] | None = None) -> Column:
    """``rules`` for texts that match ``when`` only."""
    rules = shipped_rules()["breast"] if rules is None else rules
    return F.when(text.rlike(when), fold_rules(text, rules, "chain")).otherwise(text)


def cleanup(text: Column) -> Column:
    """Only A-Z, 0-9 and single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^A-Z0-9 ]+", " "), r" {2,}", " "))


def normalize(text: Column, user_rules: Sequence[Rule] = (), rules: Sequence[Rule] | None = None, impl: str = "auto") -> Column:
    """The standard form of a description; null becomes empty.  Applying it again changes nothing."""
    text = conditional_rewrite(contrast_text(text))
    text = fold_rules(text, main_rules() if rules is None else rules, impl)
    if user_rules:
        text = fold_rules(text, valid_rules(user_rules), impl, ignore_case=True)
    return cleanup(F.upper(text))


def apply_user_rules(text: Column, rules: Sequence[Rule]) -> Column:
    """User rules on a raw text, whatever its case; bad ones are left out."""
    good = valid_rules(rules)
    return fold_rules(text, good, ignore_case=True) if good else text


def mapping_key(text: Column) -> Column:
    """Key of a verified mapping: line ends, tabs and commas are spaces; one case, single spaces."""
    return F.upper(F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "\r\n\t,", "    "), r"\s+", " ")))


def review_key(text: Column) -> Column:
    """Key of the review queue."""
    return F.upper(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def tokens(text: Column) -> Column:
    """Distinct words, in order of first use."""
    return F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def has_phrase(text: Column, phrase: str | Column) -> Column:
    """Whether a normalised text has the words of ``phrase`` next to each other."""
    phrase = F.lit(phrase) if isinstance(phrase, str) else phrase
    return F.concat(F.lit(" "), text, F.lit(" ")).contains(F.concat(F.lit(" "), phrase, F.lit(" ")))
