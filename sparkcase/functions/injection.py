"""Instruction-like text: word rules on a text as it is and on a form without common disguises.

A rule is a sequence of word lists with a bounded number of words between them,
all within one sentence; most must stand where an order stands. Rules are compiled to regular expressions without
look-around, which the JVM and RE2 read alike.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_INNER = r"[\p{L}\p{N}_]"
_OUTER = r"[^\p{L}\p{N}_.!?\n]"


def _words(listed: str) -> str:
    """One of some words or phrases, listed with commas; blanks stand for whatever separates words."""
    return "(?:" + "|".join(f"{_OUTER}+".join(phrase.split()) for phrase in listed.split(",")) + ")"


def _chain(parts: tuple[str | int, ...]) -> str:
    """Word lists in this order; a number before a list is how many other words may come before it."""
    out, gap = "", 0
    for part in parts:
        if isinstance(part, int):
            gap = part
            continue
        if out:
            out += (f"(?:{_OUTER}+{_INNER}+){{0,{gap}}}" if gap else "") + f"{_OUTER}+"
        out, gap = out + _words(part), 0
    return out


class Rule(str):
    """A regular expression with what each text that meets it must hold: of one of its ways, one word of each list, in lower case."""

    ways: tuple[tuple[tuple[str, ...], ...], ...] = ()


def _with(pattern: str, *ways: tuple[tuple[str, ...], ...]) -> Rule:
    out = Rule(pattern)
    out.ways = ways
    return out


def _lists(parts: tuple[str | int, ...]) -> tuple[tuple[str, ...], ...]:
    """The longest word of each phrase of the lists of a chain."""
    return tuple(tuple({max(phrase.split(), key=len): None for phrase in part.split(",")}) for part in parts if isinstance(part, str))


_BEFORE, _AFTER = r"(?:^|[^\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|$)"


def _rule(*parts: str | int) -> Rule:
    """The chain anywhere in a text."""
    return _with(f"{_BEFORE}{_chain(parts)}{_AFTER}", _lists(parts))


def _command(*parts: str | int) -> Rule:
    """The chain as an order: first in a clause, or after a word that leads to one. "They did not ..." is none."""
    first = r"(?:^|[.!?:;,\n\r\"(>-])[^\p{L}\p{N}_]*"
    led = f"{_BEFORE}{_words('please,now,then,and,you should,you must,you can,simply,to')}{_OUTER}+"
    return _with(f"(?:{first}|{led}){_chain(parts)}{_AFTER}", _lists(parts))


def _any(*rules: Rule) -> Rule:
    return _with("|".join(rules), *(way for rule in rules for way in rule.ways))


# The lists hold what the labelled sentences of tests/test_injection.py need, and no more.
_SET_ASIDE = "ignore,disregard,bypass,override,skip"
_GIVEN = "instruction,instructions,rule,rules,prompt,guidance,policy"
_CHECKS = "check,checks,control,controls,review,evidence,alerts"
_REPORT = "flag,report,escalate,review,question,hold"

#: Names (fixed, in the order of the output) and rules of the eight kinds of instruction-like text.
PATTERNS = {
    "override_previous_instructions": _any(
        _rule("ignore,ignoring,disregard,forget", 2, "previous,prior,earlier,above", 2, _GIVEN),
        _command(_SET_ASIDE, 2, "all,your", 2, _GIVEN),
        _command("forget", "everything", 3, "above,before,earlier"),
    ),
    "override_verb_and_object": _any(_command(_SET_ASIDE, 3, f"{_GIVEN},{_CHECKS}"), _command("ignoring,bypassing,skipping", 3, f"{_GIVEN},{_CHECKS}")),
    "role_reassignment": _any(
        _rule("you are now,you are no longer", 2, "assistant,officer,auditor,approver,model,chatbot"), _command("act as,behave as", 2, "assistant,auditor,approver,model,chatbot"),
        _command("pretend to be,pretend you are"), _rule("from now on", "you must,you will,you should"), _rule("your new", 1, "role,task,instructions"),
    ),
    "fake_role_tags": _any(
        _with(r"<[ \t]*/?[ \t]*(?:system|assistant|user|developer)[ \t]*>", (("<",), ("system", "assistant", "user", "developer"))), _with(r"<\|[a-z_]+\|>", (("<|",), ("|>",))),
        _with(r"\[/?inst\]", (("inst]",),)), _with(r"<</?sys>>", (("sys>>",),)), _with(r"(?:^|\n)[ \t#>*]*(?:system|assistant|developer)[ \t]*:", ((":",), ("system", "assistant", "developer"))),
    ),
    "prompt_disclosure": _command("print,show,reveal,repeat", 3, "prompt,system message,instructions"),
    "forced_decision": _command("mark,treat,label,classify,rate", 4, "verified,cleared,approved,safe,harmless,low risk,false positive"),
    "suppress_reporting": _any(
        _command("do not,don't,never", _REPORT), _command("do not,don't,never", "ever,even", _REPORT), _rule("no need to", f"{_REPORT},check"),
        _rule("without", "further,any", "review,checks,questions"), _rule("exempt from", 1, "screening,checks,review"),
    ),
    "override_other_languages": _rule(
        "ignora,olvida,ignorez,oubliez,ignoriere,vergiss,negeer", 3, "instrucciones,reglas,r\u00e8gles,consignes,anweisungen,regeln,istruzioni,regels"),
}
#: Digits and signs that stand for letters (fixed values).
_STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
_TOKEN = re.compile(r"\s+|[^\s]+")
#: Signs that may stand between the letters of a spelled-out word.
_BETWEEN = frozenset("-._*~|")


def _joined(token: str) -> str:
    """A token whose letters are set apart by one and the same sign, without that sign."""
    begin, end = 0, len(token)
    while begin < end and not token[begin].isalnum():
        begin += 1
    while end > begin and not token[end - 1].isalnum():
        end -= 1
    core = token[begin:end]
    if len(core) >= 5 and core[1] in _BETWEEN and set(core[1::2]) == {core[1]} and all(c.isalnum() for c in core[::2]):
        return token[:begin] + core[::2] + token[end:]
    return token


def _lettered(token: str) -> str:
    """A token that mixes letters with stand-ins, as letters."""
    core = token.rstrip("!.,;:?")
    stands = sum(c in _STANDS_FOR for c in core)
    if stands and sum(c.isalpha() for c in core) >= stands:
        return "".join(_STANDS_FOR.get(c, c) for c in core) + token[len(core) :]
    return token


def plain_form(text: str) -> str:
    """A text in compatibility forms, without invisible characters, spelled-out words joined, stand-ins as letters."""
    seen = "".join(c for c in unicodedata.normalize("NFKC", text) if unicodedata.category(c) != "Cf")
    out: list[str] = []
    spelled: list[str] = []

    def flush() -> None:
        # Four letters or more with a blank between each two are a word.
        out.append(_lettered("".join(spelled)) if len(spelled) >= 4 else " ".join(spelled))
        spelled.clear()

    tokens = _TOKEN.findall(seen)
    for i, token in enumerate(tokens):
        if token.isspace():
            if not (spelled and token == " " and i + 1 < len(tokens) and len(tokens[i + 1]) == 1 and tokens[i + 1].isalnum()):
                flush()
                out.append(token)
        elif len(token) == 1 and token.isalnum():
            spelled.append(token)
        else:
            flush()
            out.append(_lettered(_joined(token)))
    flush()
    return "".join(out)


#: What a text must hold for its plain form to be another: a stand-in, or letters set apart. Texts beyond ASCII are always looked at.
_DISGUISED = re.compile(r"[^\x00-\x7f]|[0134578@$!]|\w[-._*~|]\w[-._*~|]\w|\w \w \w \w")


def _unlike(text: str | None) -> str | None:
    if text is None or not _DISGUISED.search(text):
        return None
    plain = plain_form(text)
    return None if plain == text else plain


@F.pandas_udf(StringType())
def _other_form(x: pd.Series) -> pd.Series:
    """The plain form of a text, null if it is the text itself."""
    return x.map(_unlike)


#: Letters beyond ASCII that regular expressions without case take for an ASCII letter.
_FOLDED = ("\u017f\u212a\u0131\u0130", "skii")


def _may_meet(low: Column, rule: Rule) -> Column:
    """Whether a text in lower case holds the words that the rule cannot do without."""
    one_of = lambda listed: reduce(or_, (F.contains(low, F.lit(w)) for w in listed))
    return reduce(or_, (reduce(and_, map(one_of, way)) for way in rule.ways))


def pattern_flags(text: Column) -> Column:
    """Names of the rules that a text meets as it is; JVM regular expressions only, and only where their words are."""

    def flags(x: Column) -> Column:
        return F.array_compact(F.array(*[F.when(_may_meet(x["low"], p) & x["text"].rlike(f"(?iu){p}"), F.lit(name)) for name, p in PATTERNS.items()]))

    # In an array of one, so that the lower case is made once.
    seen = F.array(F.struct(text.alias("text"), F.lower(F.translate(text, *_FOLDED)).alias("low")))
    return F.element_at(F.transform(seen, flags), 1)


def injection_flags(text: Column) -> Column:
    """Names of the rules that a text or its plain form meets, in their order."""
    both = F.concat(pattern_flags(text), pattern_flags(_other_form(text)))
    return F.array_intersect(F.array(*map(F.lit, PATTERNS)), both)
