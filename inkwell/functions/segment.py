"""Second rule set: sentence boundaries, decided by a table of rules for the stops of a paragraph.

Each rule is a pattern for a stop with what must stand around it; the first that fits a stop decides. All rules
together are one expression, which goes once through the paragraph. A stop that ends a sentence takes closing marks,
citations and the white space after it along.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import regex

#: Abbreviations (last word before the period) and beginnings that may be in lower case.
ABBREVIATIONS = "st syn sp spp fig figs dr prof eq eqs ref refs vs no mr mrs ms cf approx inc dept vol pp jan feb mar apr jun jul aug sep sept oct nov dec".split()
LOWER_STARTS = r"fNIRS|miR\d+[A-Za-z]*|mRNA|iPSC\w*|pH\b|eIF\w*|siRNA|ncRNA|lncRNA|COVID\w*"
#: In-band marks around bibliographic references and formulas.
REF_OPEN, REF_CLOSE, FORMULA = "", "", ""

GAP = regex.compile(r"\s+")
CITED = rf"\s*{REF_OPEN}[^{REF_CLOSE}]*{REF_CLOSE}"
CITATIONS = rf"{CITED}(?:[,–-]?{CITED})*"
BRACKETS = rf"\s*\[[\d,\s–{REF_OPEN}{REF_CLOSE}-]+\]"
RAISED = r"\d+(?:[–-]\d+)?(?:,\s*\d+(?:[–-]\d+)?)*"
#: What may stand between a stop and the next sentence, and how that begins.
CLOSED = r"(?>[\"”’')]*)"
TAIL = rf"{CLOSED}(?>{BRACKETS}(?:{CITATIONS})?|{CITATIONS}|(?:{RAISED})?)"
OPENER = r"[\p{Uppercase}\p{Nd}\p{Numeric_Type=Digit}\"“'(\[{]"
NAMED = r"\s+(?:[A-Z][a-z]+|[A-Z]\.\s+[A-Z][a-z]+|\([A-Z][a-z]+\))"


@dataclass(frozen=True)
class Rule:
    """A stop that fits the pattern ends a sentence or not, and is noted under the flag if there is one."""

    pattern: str
    ends: bool = False
    flag: str | None = None


RULES = (
    Rule(r"(?<=\d)\.(?=\d)"),
    Rule(r"(?<=(?<![\w\p{N}])(?i:et\s+al)\n?)\.(?=\s*(?:\(|\d{4}\b|[,;]|[a-z]))"),
    Rule(r"(?<=(?<![\w\p{N}])(?i:et\s+al)\n?)\.", flag="ambiguous_et_al_terminal"),
    Rule(rf"(?<=(?<![A-Za-z])(?i:{'|'.join(ABBREVIATIONS)})\n?)\."),
    Rule(r"(?<=[A-Za-z]\.[A-Za-z]\n?)\."),
    Rule(r"(?<=(?<![A-Za-z])[Pp]\n?)\.(?=\s+\d)"),
    Rule(rf"(?<=(?<![\p{{L}}\p{{N}}])[A-Za-z])\.(?={NAMED})"),
    Rule(rf"[.!?](?={CLOSED}(?>{BRACKETS})?+\s*{REF_OPEN}[^{REF_CLOSE}]*\Z)", flag="unclosed_xref_marker"),
    Rule(rf"[.!?]{TAIL}(?:\s*\Z|\s+(?={OPENER}))", ends=True),
    Rule(rf"[.!?]{TAIL}\s+(?={LOWER_STARTS})", ends=True, flag="lowercase_technical_start"),
    Rule(rf"[.!?](?={TAIL}\s)", flag="possible_lowercase_sentence_start"),
)
STOPS = regex.compile("|".join(f"(?P<r{k}>{rule.pattern})" for k, rule in enumerate(RULES)))


@dataclass
class Segments:
    """spans: (start, end) in the marked text; rest: where the remainder begins; flags: what was ambiguous."""

    spans: list[tuple[int, int]] = field(default_factory=list)
    rest: int = 0
    flags: list[str] = field(default_factory=list)


def plain(text: str) -> str:
    """The text without marks, white space collapsed."""
    return GAP.sub(" ", text.translate(dict.fromkeys(map(ord, (REF_OPEN, REF_CLOSE, FORMULA))))).strip()


def segment(text: str, limit: int | None = None) -> Segments:
    """The sentences of a paragraph, limit of them at most."""
    out = Segments()
    for stop in STOPS.finditer(text) if limit is None or limit > 0 else ():
        rule = RULES[int(stop.lastgroup[1:])]
        out.flags += [rule.flag] * (rule.flag is not None)
        if rule.ends:
            if plain(text[out.rest : stop.end()]):
                out.spans.append((out.rest, stop.end()))
            out.rest = stop.end()
            if len(out.spans) == limit:
                break
    return out
