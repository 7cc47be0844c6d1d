"""Column expressions that clean residues and read record headers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The twenty standard residues, the ambiguity codes and the gap signs.
STANDARD = "ACDEFGHIKLMNPQRSTVWY"
AMBIGUOUS = "BZJXOU"
GAPS = "-.~"


def clean_sequence(raw: Column) -> Column:
    """Upper case without white space, digits and gap signs, then without one final ``*``; null stays null."""
    bare = F.regexp_replace(F.upper(raw), r"(?U)[\s\d.~-]+", "")
    return F.regexp_replace(bare, r"\*\z", "")


def accession(identifier: Column) -> Column:
    """The accession of a header or hit id.

    The first token before a space; if it holds two or more non-empty pieces between
    ``|``, the second of them. Null stays null, an empty id stays empty.
    """
    token = F.substring_index(F.ltrim(identifier), " ", 1)
    pieces = F.filter(F.split(token, r"\|"), lambda piece: piece != "")
    return F.when(token.contains("|") & (F.size(pieces) >= 2), F.get(pieces, F.lit(1))).otherwise(token)


def annotation_name(header: Column) -> Column:
    """The text after the first space (the whole header if there is none), up to the first `` OS=``."""
    at = F.instr(header, " ")
    rest = F.when(at > 0, F.substring(header, at + F.lit(1), F.length(header))).otherwise(header)
    return F.substring_index(rest, " OS=", 1)


def organism_name(header: Column) -> Column:
    """The text between `` OS=`` and the next of `` OX=``, `` GN=``, `` PE=``, `` SV=``; null without `` OS=``."""
    name = F.regexp_extract(header, r"(?s) OS=(.*?)(?= OX=| GN=| PE=| SV=|\z)", 1)
    return F.when(header.contains(" OS="), name)


def annotation_confidence(annotation: Column) -> Column:
    """How far an annotation is trusted; the first rule that holds counts. Null counts as a plain name."""
    low = F.lower(F.coalesce(annotation, F.lit("")))
    return (
        F.when(low.rlike("uncharacterized|hypothetical"), 0.10)
        .when(low.rlike("putative|probable"), 0.42)
        .when(low.rlike("domain-containing|duf"), 0.30)
        .otherwise(0.62)
    )


#: Words of a header that exclude a reference, and those of which one is needed.
EXCLUDED_WORDS = ("uncharacterized", "hypothetical", "fragment")
INFORMATIVE_WORDS = (
    "penicillin-binding", "transpeptidase", "carboxypeptidase", "polyketide", "synthase", "transferase", "hydrolase", "oxidase", "reductase", "dehydrogenase",
    "kinase", "phosphatase", "transport", "transporter", "permease", "channel", "ligase", "isomerase", "lyase", "enzyme",
)


def is_informative_reference(header: Column) -> Column:
    """Whether a header names a function and nothing that rules it out."""
    low = F.lower(header)
    return ~low.rlike("|".join(EXCLUDED_WORDS)) & low.rlike("|".join(INFORMATIVE_WORDS))


def cleaning_report(raw: Column) -> dict[str, Column]:
    """What cleaning did: ``residues``, ``gaps``, ``stop_trimmed``, ``ambiguous`` and ``problem``.

    ``problem`` is null for a usable sequence, else ``empty``, ``stop@n`` (an inner ``*``, n in the
    sequence without gaps) or ``letter@n`` (any other sign, n with gaps), whichever comes first.
    """
    dense = F.regexp_replace(F.upper(raw), r"(?U)[\s\d]+", "")
    bare = F.regexp_replace(dense, "[.~-]+", "")
    residues = F.regexp_replace(bare, r"\*\z", "")
    wrong = F.regexp_instr(dense, F.lit(f"[^{STANDARD}{AMBIGUOUS}.~*-]"))
    stop = F.locate("*", residues)
    return {
        "residues": residues,
        "gaps": F.length(dense) - F.length(bare),
        "stop_trimmed": bare.endswith("*"),
        "ambiguous": F.length(F.regexp_replace(residues, f"[^{AMBIGUOUS}]", "")),
        "problem": F.when(wrong > 0, F.concat(F.lit("letter@"), wrong.cast("string")))
        .when(stop > 0, F.concat(F.lit("stop@"), stop.cast("string")))
        .when(residues == "", F.lit("empty")),
    }


def looks_like_nucleotide(residues: Column, least: int = 40) -> Column:
    """At least ``least`` letters, 95 % of them in ACGTUN."""
    plain = F.length(F.regexp_replace(residues, "[^ACGTUN]", ""))
    return (F.length(residues) >= least) & (plain >= F.length(residues) * F.lit(0.95))


def digest(raw: Column) -> Column:
    """SHA-256 of a sequence without white space, in upper case."""
    return F.sha2(F.upper(F.regexp_replace(raw, r"(?U)\s+", "")), 256)


def safe_name(value: Column) -> Column:
    """A file name: runs of other signs become ``_``; at most 160 letters."""
    return F.substring(F.regexp_replace(value, r"[^A-Za-z0-9_.\-]+", "_"), 1, 160)


def percent(value: Column) -> Column:
    return F.concat(F.round(value * 100).cast("int").cast("string"), F.lit("%"))


def wrapped(sequence: Column, width: int = 60) -> Column:
    """Lines of ``width`` letters."""
    return F.regexp_replace(sequence, f"(.{{{width}}})(?=.)", "$1\n")


def _named(name: str):
    return lambda part: F.substring_index(part, "=", 1) == name


def approved_url(url: Column, host: str, path: str, allowed: list[str], most: int, exact: dict[str, Column] | None = None) -> Column:
    """Whether a page address keeps to the approved scheme, host, path, parameters and page size; ``exact`` names parameters that must occur once, with that value."""
    query = F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    names = F.transform(parts, lambda p: F.substring_index(p, "=", 1))
    size = F.regexp_extract(query, r"(?:^|&)size=(\d{1,9})(?:&|$)", 1).try_cast("int")
    good = (
        F.coalesce(url.rlike(f"^https://{host.replace('.', chr(92) + '.')}(:443)?{path}([?]|$)"), F.lit(False))
        & ~url.contains("#")
        & (F.size(F.array_except(names, F.array(*map(F.lit, allowed)))) == 0)
        & F.coalesce(size.between(1, most), F.lit(False))
        & (F.size(F.filter(names, lambda n: n == "cursor")) <= 1)
        & (F.size(F.filter(names, lambda n: n == "size")) == 1)
    )
    for name, value in (exact or {}).items():
        held = F.filter(parts, _named(name))
        good = good & (F.size(held) == 1) & F.coalesce(F.get(held, F.lit(0)) == F.concat(F.lit(f"{name}="), value), F.lit(False))
    return good


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _places(texts: pd.Series, patterns: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else [m.start() + 1 for m in re.finditer(p, t)] for t, p in zip(texts, patterns, strict=True)])


def pattern_places(text: Column, pattern: str) -> Column:
    """Where a pattern begins (1-based), hits not overlapping; null text gives null."""
    return _places(text, F.lit(pattern))


#: The pattern of a docking anchor and those that support it.
ANCHOR, SUPPORTING = "S..K", ("S.N", "KTG")


def docking_anchor(text: Column, offset: int = 0) -> dict[str, Column]:
    """The first anchor (1-based, moved by ``offset``; null if there is none), its letters, and the places of each supporting pattern."""
    place = F.regexp_instr(text, F.lit(ANCHOR))
    found = {"anchor": F.when(place > 0, (place + offset).cast("long")), "motif": F.when(place > 0, F.substring(text, place, F.lit(4)))}
    return found | {f"places_{p.replace('.', 'x')}": pattern_places(text, p) for p in SUPPORTING}
