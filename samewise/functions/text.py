"""Cleaning and scalar functions as Column builders; blank results are null."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

SPACE = r"(?U)\s+"


def blank_to_null(c: Column) -> Column:
    return F.when(c.rlike(r"(?U)\S"), c)


def trim(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def collapse_spaces(c: Column) -> Column:
    return trim(F.regexp_replace(c, SPACE, " "))


def strip_punctuation(c: Column, keep: str = " ") -> Column:
    kept = "".join("\\" + k for k in keep if not k.isalnum())
    return F.regexp_replace(c, rf"[^\p{{L}}\p{{N}}{kept}]", "")


@pandas_udf(T.StringType())
def accent_fold(s: pd.Series) -> pd.Series:
    """NFKD without combining marks; letters that don't decompose stay."""
    return s.map(lambda t: None if t is None else "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x)))


def words(c: Column) -> Column:
    return F.filter(F.split(trim(c), SPACE), lambda w: w != "")


def sorted_tokens(c: Column) -> Column:
    return blank_to_null(F.array_join(F.array_sort(F.array_distinct(words(c))), " "))


def token_set(c: Column) -> Column:
    return blank_to_null(F.array_join(F.array_sort(F.array_distinct(words(c))), " | "))


def first_token(c: Column) -> Column:
    return F.get(words(c), F.lit(0))


def last_token(c: Column) -> Column:
    w = words(c)
    return F.get(w, F.size(w) - 1)


def initials(c: Column) -> Column:
    return blank_to_null(F.array_join(F.transform(words(c), lambda w: F.substring(w, 1, 1)), ""))


def fingerprint(c: Column) -> Column:
    return blank_to_null(F.array_join(F.array_sort(F.array_distinct(words(F.regexp_replace(F.upper(c), r"[^\p{L}\p{N}\s]", "")))), ""))


def person_name(c: Column) -> Column:
    """struct(forename, middle_names, surname, forename_initial): 'SURNAME, FORENAMES' or the last word as surname."""
    comma = c.contains(",")
    given = words(F.when(comma, F.regexp_replace(c, r"^[^,]*,", "")).otherwise(F.array_join(F.slice(words(c), 1, F.greatest(F.size(words(c)) - 1, F.lit(0))), " ")))
    surname = F.when(comma, blank_to_null(trim(F.regexp_extract(c, r"^([^,]*),", 1)))).otherwise(last_token(c))
    fore = F.get(given, F.lit(0))
    middle = blank_to_null(F.array_join(F.slice(given, F.lit(2), F.greatest(F.size(given), F.lit(1))), " "))
    return F.struct(fore.alias("forename"), middle.alias("middle_names"), surname.alias("surname"), F.substring(fore, 1, 1).alias("forename_initial"))


def postcode(c: Column) -> Column:
    """'OUT IN' of the shape letters-digits, or null."""
    s = F.upper(F.regexp_replace(c, r"[^A-Za-z0-9]", ""))
    spaced = F.concat(F.substring(s, F.lit(1), F.length(s) - 3), F.lit(" "), F.substring(s, F.length(s) - 2, F.lit(3)))
    return F.when(F.length(s).between(5, 7) & spaced.rlike(r"^[A-Z]{1,2}[0-9R][0-9A-Z]? [0-9][A-Z]{2}$"), spaced)


def postcode_district(c: Column) -> Column:
    """The district before the first space, whatever follows it; null without one."""
    return F.nullif(F.regexp_extract(F.upper(F.trim(c)), r"^([A-Z]{1,2}[0-9][A-Z0-9]?)\s", 1), F.lit(""))


def company_number(c: Column) -> Column:
    s = F.upper(F.regexp_replace(c, r"[^A-Za-z0-9]", ""))
    padded = F.when(s.rlike(r"^[0-9]{1,7}$"), F.lpad(s, 8, "0")).otherwise(s)
    return F.when((F.length(s) >= 2) & s.rlike("[0-9]"), padded)


def money_text(c: Column) -> Column:
    return F.regexp_replace(F.format_number(c, 2), r"\.00$", "")


def key_text(c: Column) -> Column:
    return blank_to_null(F.regexp_replace(F.upper(trim(c.cast("string"))), r"^(-?[0-9]+)\.0$", "$1"))


def nullify(c: Column, values: Sequence[str]) -> Column:
    return F.when(~F.coalesce(F.upper(collapse_spaces(c)).isin([v.upper() for v in values]), F.lit(False)), c)


def nullify_outside(c: Column, low: float | None = None, high: float | None = None) -> Column:
    n = c.cast("string").try_cast("double")
    ok = n.isNotNull()
    if low is not None:
        ok = ok & (n >= low)
    if high is not None:
        ok = ok & (n <= high)
    return F.when(F.coalesce(ok, F.lit(False)), c)


def lookup(c: Column, table: dict[str, str], fallback: str = "passthrough") -> Column:
    pairs = F.create_map(*[F.lit(x) for k, v in sorted(table.items()) for x in (k.upper(), v)])
    hit = F.try_element_at(pairs, F.upper(collapse_spaces(c)))
    return F.coalesce(hit, c) if fallback == "passthrough" else hit


def concat_keys(columns: Sequence[Column], separator: str = "|", require_all: bool = True) -> Column:
    parts = [blank_to_null(trim(c)) for c in columns]
    joined = F.concat_ws(separator, *parts)
    if require_all:
        missing = F.lit(False)
        for p in parts:
            missing = missing | p.isNull()
        return F.when(~missing, joined)
    return blank_to_null(joined)


def strip_tokens(c: Column, tokens: Sequence[str], position: str = "trailing", keep_one: bool = True) -> Column:
    """Remove listed words or phrases at one end, or anywhere, longest first, again and again; with keep_one the last word stays."""
    alternatives = "|".join(sorted((r"\Q" + t + r"\E" for t in tokens), key=len, reverse=True))
    s = collapse_spaces(c)
    if position == "trailing":
        out = F.regexp_replace(s, rf"(?i)(\s+(?:{alternatives}))+$" if keep_one else rf"(?i)((^|\s+)(?:{alternatives}))+$", "")
    elif position == "leading":
        out = F.regexp_replace(s, rf"(?i)^((?:{alternatives})\s+)+" if keep_one else rf"(?i)^((?:{alternatives})(\s+|$))+", "")
    else:
        out = collapse_spaces(F.regexp_replace(F.concat(F.lit(" "), s, F.lit(" ")), rf"(?i)(?<=\s)(?:{alternatives})(?=\s)", ""))
        out = F.when(out == "", s if keep_one else out).otherwise(out)
    return blank_to_null(out)


@pandas_udf(T.StructType([T.StructField("rest", T.StringType()), T.StructField("removed", T.StringType())]))
def _strip_and_keep(s: pd.Series, spec: pd.Series) -> pd.DataFrame:
    tokens, position, repeat, keep_one = json.loads(spec.iloc[0]) if len(spec) else ([], "leading", True, True)
    known = {" ".join(t.split()).upper() for t in tokens}
    longest = max((len(t.split()) for t in known), default=0)

    def length(words: list[str], at: int, back: bool) -> int:
        """How many words from `at` on (or up to it) are the longest listed phrase."""
        room = at if back else len(words) - at
        for n in range(min(longest, room), 0, -1):
            part = words[at - n : at] if back else words[at : at + n]
            if " ".join(part).upper() in known:
                return n
        return 0

    def one(text):
        if text is None:
            return None, None
        words, gone = text.split(), []
        at, back = (len(words), True) if position == "trailing" else (0, False)
        while 0 <= at <= len(words) and words:
            n = length(words, at, back)
            if n and not (keep_one and n == len(words)):
                start = at - n if back else at
                gone.append((len(gone), " ".join(words[start : start + n])))
                del words[start : start + n]
                at = start
                if not repeat:
                    break
            elif position == "anywhere" and at < len(words):
                at += 1
            else:
                break
        taken = [g for _, g in (reversed(gone) if back else gone)]
        return " ".join(words) or None, " ".join(taken) or None

    return pd.DataFrame([one(t) for t in s], columns=["rest", "removed"])


def strip_and_keep(c: Column, tokens: Sequence[str], position: str = "leading", repeat: bool = True, keep_one: bool = True) -> Column:
    """struct(rest, removed): listed words and phrases taken off at an end or anywhere, longest first, and what was taken, in order."""
    if position not in ("leading", "trailing", "anywhere"):
        raise ValueError(f"unknown position: {position}")
    return _strip_and_keep(c, F.lit(json.dumps([list(tokens), position, repeat, keep_one])))


def lookup_words(c: Column, table: dict[str, str | None], fallback: str = "passthrough") -> Column:
    """Each word by the table; words without a value go."""
    pairs = F.create_map(*[F.lit(x).cast("string") for k, v in sorted(table.items()) for x in (k.upper(), v)])
    keys = F.array(*[F.lit(k.upper()) for k in sorted(table)])
    other = (lambda w: w) if fallback == "passthrough" else (lambda w: F.lit(None).cast("string"))
    mapped = F.transform(words(c), lambda w: F.when(F.array_contains(keys, F.upper(w)), F.try_element_at(pairs, F.upper(w))).otherwise(other(w)))
    return blank_to_null(F.array_join(F.filter(mapped, lambda w: w.isNotNull() & (w != "")), " "))


def not_after_years_ago(c: Column, years: int, low: float | None = None) -> Column:
    """A year that is at least so many years ago and not below low; anything else is null."""
    n = c.cast("string").try_cast("double")
    ok = n <= F.year(F.current_date()) - years
    return F.when(F.coalesce(ok if low is None else ok & (n >= low), F.lit(False)), c)


def id_text(c: Column) -> Column:
    """An id trimmed, without the .0 that spreadsheets leave on whole numbers; words for nothing become empty."""
    t = F.coalesce(trim(c.cast("string")), F.lit(""))
    return F.when(F.lower(t).isin("", "nan", "nat", "none", "<na>"), "").otherwise(F.regexp_replace(t, r"^(\d+)\.0$", "$1"))


def is_true(c: Column) -> Column:
    return F.coalesce(F.lower(trim(c.cast("string"))).isin("true", "1", "yes", "y"), F.lit(False))


def house_number(c: Column) -> Column:
    """The digits, and a letter after them, that an address begins with."""
    return blank_to_null(F.upper(F.regexp_extract(trim(c), r"^(\d+[A-Za-z]?)\b", 1)))


VOWELS = set("AEIOU")


def metaphone_of(text: str) -> str:
    """Lawrence Philips' first metaphone of the letters of a word or phrase, word by word."""
    return " ".join(m for m in (_metaphone(w) for w in re.split(r"[^A-Z]+", text.upper())) if m)


def _metaphone(word: str) -> str:
    w = re.sub(r"([A-BD-Z])\1", r"\1", word)
    for start in ("KN", "GN", "PN", "AE", "WR"):
        if w.startswith(start):
            w = w[1:]
            break
    else:
        if w.startswith("X"):
            w = "S" + w[1:]
        elif w.startswith("WH"):
            w = "W" + w[2:]
    out = []
    for i, ch in enumerate(w):
        before, after, third = w[i - 1] if i else "", w[i + 1 : i + 2], w[i + 2 : i + 3]
        if ch in VOWELS:
            if i == 0:
                out.append(ch)
        elif ch == "B":
            if not (before == "M" and i == len(w) - 1):
                out.append("B")
        elif ch == "C":
            if after == "I" and third == "A" or after == "H":
                out.append("K" if before == "S" and after == "H" else "X")
            elif after and after in "IEY":
                if before != "S":
                    out.append("S")
            else:
                out.append("K")
        elif ch == "D":
            out.append("J" if after == "G" and third and third in "EYI" else "T")
        elif ch == "G":
            if after == "H" and third and third not in VOWELS or w[i:] in ("GN", "GNED"):
                continue
            if before == "D" and after and after in "EYI":
                continue
            out.append("J" if after and after in "IEY" and before != "G" else "K")
        elif ch == "H":
            if (not after or after in VOWELS) and before not in set("CSPTG") and (after or before not in VOWELS) and after:
                out.append("H")
        elif ch == "K":
            if before != "C":
                out.append("K")
        elif ch == "P":
            out.append("F" if after == "H" else "P")
        elif ch == "Q":
            out.append("K")
        elif ch == "S":
            out.append("X" if after == "H" or after == "I" and third and third in "OA" else "S")
        elif ch == "T":
            if after == "I" and third and third in "OA":
                out.append("X")
            elif after == "H":
                out.append("0")
            elif not (after == "C" and third == "H"):
                out.append("T")
        elif ch == "V":
            out.append("F")
        elif ch in "WY":
            if after and after in VOWELS:
                out.append(ch)
        elif ch == "X":
            out.append("KS")
        elif ch == "Z":
            out.append("S")
        elif ch in "FJLMNR":
            out.append(ch)
    return "".join(out)


@pandas_udf(T.StringType())
def metaphone(s: pd.Series) -> pd.Series:
    memo: dict[str, str | None] = {}
    return s.map(lambda t: None if t is None else memo[t] if t in memo else memo.setdefault(t, metaphone_of(t) or None))


STEPS = {
    "copy": lambda c: c,
    "upper": F.upper,
    "lower": F.lower,
    "trim": trim,
    "collapse_spaces": collapse_spaces,
    "accent_fold": accent_fold,
    "strip_punctuation": strip_punctuation,
    "regex_replace": lambda c, pattern, replacement="": F.regexp_replace(c, pattern, replacement),
    "strip_tokens": strip_tokens,
    "nullify": nullify,
    "nullify_outside_range": nullify_outside,
    "lookup": lookup,
    "sorted_tokens": sorted_tokens,
    "token_set": token_set,
    "first_token": first_token,
    "last_token": last_token,
    "initials": initials,
    "fingerprint": fingerprint,
    "soundex": F.soundex,
    "metaphone": metaphone,
    "lookup_words": lookup_words,
    "not_after_years_ago": not_after_years_ago,
    "strip_and_keep": lambda c, **a: strip_and_keep(c, **a)["rest"],
    "house_number": house_number,
    "normalise_postcode": postcode,
    "postcode_district": postcode_district,
    "normalise_company_number": company_number,
}


def step(name: str, c: Column, **args) -> Column:
    """One cleaning step; an unknown name raises; blanks become null."""
    if name not in STEPS:
        raise ValueError(f"unknown cleaning step: {name}")
    return blank_to_null(STEPS[name](c, **args))
