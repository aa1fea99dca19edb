"""Names of sponsors typed by people, taken apart: what kind of sponsor, its own word, legal form, and a person's names."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F, types as T

# Words for a kind of business or house with their usual short forms, legal forms, and words that say nothing.
KINDS = {
    "therapeutics": "therapeutics therapeutic therap thera ther tx",
    "biotechnologies": "biotechnologies biotechnology biotech",
    "biosciences": "biosciences bioscience biosci",
    "biologics": "biologics biologic biol",
    "genomics": "genomics genomic genom gx",
    "diagnostics": "diagnostics diagnostic diag dx",
    "oncology": "oncology oncol onco onc",
    "vaccines": "vaccines vaccine vacc vax",
    "laboratories": "laboratories laboratory labs lab",
    "medicines": "medicines medicine meds",
    "pharmaceuticals": "pharmaceuticals pharmaceutical pharma pharms pharm",
    "immunotherapies": "immunotherapies immunotherapy immunother immuno imm",
}
HOUSES = {
    "institute": "institute inst",
    "hospital": "hospital hosp",
    "university": "university univ",
    "regional": "regional reg",
    "childrens": "childrens children",
    "medical": "medical",
}
LEGAL = {
    "inc": "inc incorporated", "corp": "corp corporation", "ltd": "ltd limited", "llc": "llc", "plc": "plc", "gmbh": "gmbh", "ag": "ag",
    "co": "co company", "lp": "lp", "sa": "sa", "bv": "bv", "nv": "nv", "ab": "ab", "spa": "spa", "aps": "aps a_s",
}
EMPTY = frozenset("the of for at and r d rd usa research res group holdings".split())
TITLES = frozenset("dr prof mr mrs ms md phd do mph msc bsc rn dsc pharmd jr sr ii iii".split())
# Given names and the short forms people use for them.
GIVEN = {
    "alexander": "alex sandy xander lex sasha al", "andrew": "andy drew", "anthony": "tony", "barbara": "barb babs", "benjamin": "ben benny",
    "catherine": "cathy", "charles": "charlie chuck", "christopher": "chris kit topher", "daniel": "dan danny", "david": "dave",
    "deborah": "deb debbie debby", "donald": "don", "dorothy": "dot dottie", "edward": "ed eddie ted ned", "elizabeth": "liz beth betty eliza lizzie libby bess",
    "frances": "fran", "francis": "frank", "gregory": "greg", "ignacio": "nacho", "james": "jim jimmy jamie", "jennifer": "jen jenny", "jessica": "jess",
    "john": "jack johnny", "jonathan": "jon", "joseph": "joe joey", "katherine": "kate kathy katie kat", "kenneth": "ken", "lawrence": "larry",
    "margaret": "maggie meg peggy marge", "matthew": "matt", "michael": "mike mick mickey", "nancy": "nan", "nicholas": "nick nico", "oluwaseun": "seun",
    "pamela": "pam", "patricia": "pat patty trish tricia", "patrick": "paddy", "peter": "pete", "philip": "phil", "rebecca": "becky", "richard": "rick dick rich",
    "robert": "bob rob bobby bert", "ronald": "ron", "samuel": "sam sammy", "sandra": "sandi", "stephen": "steve", "susan": "sue susie suzy",
    "theodore": "theo teddy", "thomas": "tom tommy", "timothy": "tim", "victoria": "vicky vicki tori", "walter": "walt", "william": "will bill billy liam",
    "yevgenia": "zhenya yev", "vladimir": "vova", "dmitri": "dima", "mikhail": "misha",
}

_KIND = {short: k for table in (KINDS, HOUSES) for k, shorts in table.items() for short in shorts.split()}
_LEGAL = {short: k for k, shorts in LEGAL.items() for short in shorts.split()}
_GIVEN = {short: k for k, shorts in GIVEN.items() for short in [k, *shorts.split()]}
#: Letters that an initial may stand for, by given name.
INITIALS = {k: frozenset(x[0] for x in [k, *shorts.split()]) for k, shorts in GIVEN.items()}
_DOTTED = [(re.compile(rf"\b{r'\.?\s?'.join(k)}\b\.?"), f" {k} ") for k in ("gmbh", "llc", "plc", "ag", "lp", "bv", "nv", "sa")]
_BIO = re.compile(r"\bbio[\s\-]+(?=scien|tech|logic)")
#: Filers carry their state behind the name: ``... INC /DE/``.
_STATE = re.compile(r"\s*/[a-z]{2,3}/?\s*$")
#: Two letters with a stroke between them are one word, as in ``A/S``.
_SLASHED = re.compile(r"(?<![a-z0-9])([a-z])/([a-z])(?![a-z0-9])")
_WORD = re.compile(r"[a-z0-9_]+")
def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours from a to b, or ``most + 1`` if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            now.append(v)
        if min(now) > most and min(row) + 1 > most:
            return most + 1
        before, row = row, now
    return min(row[-1], most + 1)


def _shortened(word: str) -> set[str]:
    """The word without up to two of its letters; words within two edits have one of these in common."""
    once = {word[:i] + word[i + 1 :] for i in range(len(word))}
    return {word} | once | {w[:i] + w[i + 1 :] for w in once for i in range(len(w))}


_NEAR: dict[str, set[str]] = {}
for _known in (k for k in _KIND if len(k) >= 7):
    for _v in _shortened(_known):
        _NEAR.setdefault(_v, set()).add(_known)


@lru_cache(maxsize=200_000)
def kind_of(word: str) -> str | None:
    """The kind a word stands for, with up to two typing errors in long words."""
    if word in _KIND:
        return _KIND[word]
    near = {known for v in _shortened(word) for known in _NEAR.get(v, ())} if len(word) >= 6 else ()
    for known in sorted(near):
        most = 1 if len(known) < 9 else 2
        if edits(known, word, most) <= most:
            return _KIND[known]
    return None


#: A word, an initial, or a legal form in a name that is written with care; kinds must be written out (see below).
_CAREFUL = re.compile(r"[A-Z][a-z]+(?:'s)?|[A-Z]\.|of")
#: Legal forms as they are written with care.
CAREFUL_LEGAL = frozenset("Inc Inc. Incorporated Corp Corp. Corporation Ltd Ltd. Limited LLC plc PLC GmbH AG Co. Company LP SA S.A. BV B.V. NV N.V. AB SpA A/S".split())


def well_written(name: str) -> bool:
    """Capitals at the head of words only, single spaces, kinds written out, a comma before a legal form at most: how people
    write who don't make haste. Typing errors in a name's own words don't show in this."""
    words = name.split(" ")
    last = words[-1] in CAREFUL_LEGAL and len(words) > 1
    own = words[:-1] if last else words
    if last:
        own = [*own[:-1], own[-1].removesuffix(",")]
    if own[0] in ("The", "of") or not all(map(_CAREFUL.fullmatch, own)):
        return False
    return all(w in KINDS or w in HOUSES for w in (w.lower().replace("'", "") for w in own) if kind_of(w))


def folded(name: str) -> str:
    """Lower case without marks over letters, with dotted legal forms written plainly."""
    t = "".join(ch for ch in unicodedata.normalize("NFKD", name) if not unicodedata.combining(ch)).lower()
    t = t.replace("'s", "s").replace("’s", "s").replace("'", "").replace("’", "").replace("&", "")
    t = _SLASHED.sub(r" \1_\2 ", _STATE.sub("", t))
    for pattern, plain in _DOTTED:
        t = pattern.sub(plain, t)
    return _BIO.sub("bio", t)


def parse(name: str | None) -> tuple[str, str, str, str, str, bool] | None:
    """``(class, core, legal, given, middle, clean)`` of one name, or None if it has no word of its own.

    class: ``person``, or the kinds and houses named, or empty. core: a person's surname, or an organisation's own words
    in sorted order. given: full given name or an initial. clean: well written and complete (a business with its kind and
    legal form, a house, a person with given name and middle initial).
    """
    if name is None:
        return None
    t = folded(name)
    tokens = _WORD.findall(t)
    kinds, legal, own = set(), "", []
    for i, w in enumerate(tokens):
        if w == "u" and tokens[i + 1 : i + 2] == ["of"]:
            kinds.add("university")
        elif w in _LEGAL and len(tokens) > 1:
            legal = _LEGAL[w]
        elif w == "med" and len(tokens) > 1:
            kinds.add("med")
        elif (k := kind_of(w)) and w not in _GIVEN:
            kinds.add(k)
        elif w not in EMPTY or (len(w) == 1 and not kinds and not legal):
            own.append(w)
    if "med" in kinds:
        kinds = (kinds - {"med"}) | {"medical" if "hospital" in kinds else "medicines"}
    plain = [w for w in own if w not in TITLES]
    careful = well_written(name)
    titled = len(plain) < len(own)
    if not kinds and not legal and 2 <= len(plain) <= 4 and (titled or any(w in _GIVEN or len(w) == 1 for w in plain)):
        person = _person(plain, "," in re.sub(r",\s*(?:md|phd|m\.d\.|ph\.d\.|jr|sr)\b.*", "", t))
        if person:
            return ("person", person[0], "", person[1], person[2], careful and len(person[1]) > 1 and person[2] != "")
    if not own:
        return None
    clean = careful and bool(kinds) and (legal != "" or not kinds.isdisjoint(HOUSES))
    return ("+".join(sorted(kinds)), " ".join(sorted(own)), legal, "", "", clean)


def _person(words: list[str], comma: bool) -> tuple[str, str, str] | None:
    """Surname, given name or its initial, middle initial; the order is told by a comma, by initials and by known names."""
    long = [i for i, w in enumerate(words) if len(w) > 1]
    if not long:
        return None
    known = [i for i in long if words[i] in _GIVEN]
    if comma or len(words[-1]) == 1:
        at = long[0]
    elif known and len(long) > 1:
        at = next((i for i in reversed(long) if i not in known), long[-1])
    else:
        at = long[-1]
    rest = [w for i, w in enumerate(words) if i != at]
    named = [w for w in rest if len(w) > 1]
    letters = [w for w in rest if len(w) == 1]
    given = _GIVEN.get(named[0], named[0]) if named else (letters.pop(0) if letters else "")
    return words[at], given, (letters[0] if letters else named[1][0] if len(named) > 1 else "")


PARSED = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("class", "core", "legal", "given", "middle")] + [T.StructField(n, T.BooleanType()) for n in ("clean", "careful")]
)


@F.pandas_udf(PARSED)
def parsed(name: pd.Series) -> pd.DataFrame:
    """``parse`` of each name; a name without a word of its own gives nulls."""
    return pd.DataFrame([(*p, well_written(x)) if (p := parse(x)) else (None,) * 7 for x in name], columns=PARSED.fieldNames())


#: Kept where it stands: a filter on its result must not be moved below the step that makes the names distinct.
parsed = parsed.asNondeterministic()


def given_agree(a: str, b: str) -> bool:
    """Equal given names, or an initial that a full name or one of its short forms begins with; a missing one agrees."""
    if a == b or not a or not b:
        return True
    if len(a) > 1 and len(b) > 1:
        return False
    short, full = sorted((a, b), key=len)
    return short in INITIALS.get(full, frozenset(full[0])) if len(full) > 1 else False
