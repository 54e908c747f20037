"""Company names: legal forms and the words that tell companies apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from samewise.functions.text import collapse_spaces, words

#: Legal forms and what they are written as, applied in this order.
LEGAL_FORMS = [
    (r"\bLIMITED\b", "LTD"),
    (r"\bLIMTIED\b", "LTD"),
    (r"\bINCORPORATED\b", "INC"),
    (r"\bCORPORATION\b", "CORP"),
    (r"\bSOCIEDAD ANONIMA\b", "SA"),
    (r"\bS\.A\.\b", "SA"),
    (r"\bS\.P\.A\b", "SPA"),
    (r"\bSDN\s*BHD\b", "SDNBHD"),
    (r"\bSDN\.BHD\.\b", "SDNBHD"),
    (r"\bPTY\s*LTD\b", "PTY LTD"),
    (r"\bCO\s*LTD\b", "CO LTD"),
    (r"\bCOMPANY\b", "CO"),
]

#: Words that say what a company is, not which.
NO_CORE = [
    "LTD",
    "INC",
    "CORP",
    "CORPORATION",
    "SA",
    "SRL",
    "SPA",
    "BV",
    "SARL",
    "GMBH",
    "SDNBHD",
    "PTY",
    "CLG",
    "CO",
    "SPRL",
    "HOLDINGS",
    "HOLDING",
    "PROPERTIES",
    "PROPERTY",
    "INVESTMENTS",
    "INVESTMENT",
    "LIMITED",
    "INCORPORATED",
    "COMPANY",
    "SOCIEDAD",
    "ANONIMA",
]


def company_name(c: Column) -> Column:
    """Upper case, without what stands in brackets, legal forms spelled short, single spaces."""
    out = F.regexp_replace(F.upper(c), r"\s*\([^)]*\)\s*", " ")
    for pattern, short in LEGAL_FORMS:
        out = F.regexp_replace(out, pattern, short)
    return collapse_spaces(out)


def core_tokens(name: Column) -> Column:
    """The words of a company_name() that tell it apart, each once, in order of the alphabet."""
    return F.array_sort(F.array_except(F.array_distinct(words(name)), F.array(*[F.lit(w) for w in NO_CORE])))
