"""Variant spellings of names typed by people: merge-and-rematch entity resolution.

Every distinct spelling is read into a profile (first names, initials, surname, kind of ensemble; or words and numbers of a piece). Profiles that
share a blocking key are compared once, exactly. What matches merges through the connected-components operator; a profile that leaves something
open (no first name, an initial, a short form of several names, no middle initial) joins an entity only if it fits no second one, judged by the
union of the entity's first names and initials. Merging makes richer profiles: a member that lacks a first name or middle initial takes the
entity's, a title the words that most members of its entity have at each place. Only these new profiles re-enter blocking and are compared with
all. Rounds go on until none is new and nothing merges; more than MAX_ROUNDS are an error.

Blocking meets every pair that the rules accept: keys are hashes of a text with up to two letters left out, which two texts within two edits always
share (a swap of neighbours is one edit). Texts of over LONG letters give the same for their two ends, which no edit touches both of: their keys are
both ends, with two letters left out of the one, of the other, or one of each. No key is of one end alone, as many pieces end with the same word. No
key depends on how often a word occurs or on the size of the corpus. Keys travel as two numbers; a key's profiles are paired as a sorted stream, and
those of a key with more than UNIT in pairs of blocks, all of them.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecstrand.functions.text import ARTIST_CUTS, fold, normal_artist, normal_title, without_edition
from vecstrand.llm.components import connected_components
from vecstrand.plans.durable import Scratch
from vecstrand.plans.skew import join_unique

#: Profiles of one key that are paired as they pass; a larger group is worked in pairs of blocks of that many.
UNIT = 256
#: Rounds are few, as each needs new profiles; this only stops a defect.
MAX_ROUNDS = 40
#: Texts of up to SHORT letters have keys of the whole; those of over LONG letters (two fewer, so that lengths may differ) have keys of their ends.
LONG, SHORT = 15, 17
#: Letters of an end and of a beginning; with two more each they do not overlap in a text of over LONG letters.
END, START = 6, 5
#: Of two first names that differ by a vowel at the end, one is a slip only if so many times fewer surnames have it; and a profile without middle
#: initial joins one of several entities only if that has so many times more spellings than the others together.
RARER, LARGER = 8, 4

# Short forms and the first names they stand for.
NICKNAMES = {
    "abby": "abigail", "al": "alan albert alexander alfred", "alec": "alexander", "alex": "alexander alexandra", "andy": "andrew", "ant": "anthony", "art": "arthur", "barb": "barbara", "bart": "bartholomew",
    "becky": "rebecca", "ben": "benjamin benedict", "benji": "benjamin", "benny": "benjamin", "bernie": "bernard", "bert": "albert herbert robert", "bess": "elizabeth", "beth": "elizabeth", "betsy": "elizabeth", "betty": "elizabeth", "bill": "william",
    "billy": "william", "bob": "robert", "bobby": "robert", "brad": "bradley", "carrie": "caroline", "cathy": "catherine", "chas": "charles", "charlie": "charles charlotte", "chris": "christopher christine christina", "chuck": "charles", "cindy": "cynthia",
    "clem": "clement", "connie": "constance", "dan": "daniel", "danny": "daniel", "dave": "david", "davy": "david", "deb": "deborah", "debbie": "deborah", "dick": "richard", "dodie": "dorothy", "dolly": "dorothy", "don": "donald",
    "dora": "dorothy", "dot": "dorothy", "dottie": "dorothy", "doug": "douglas", "drew": "andrew", "ed": "edward edmund edwin", "eddie": "edward edmund edwin", "eddy": "edward", "eliza": "elizabeth", "ellie": "eleanor", "fran": "francis frances",
    "frank": "francis franklin", "frankie": "francis", "fred": "frederick alfred", "freddie": "frederick", "freddy": "frederick", "gabby": "gabriela gabriel", "gabe": "gabriel", "gabi": "gabriela gabriel", "gene": "eugene", "geoff": "geoffrey", "ginny": "virginia", "greg": "gregory",
    "gus": "august gustav", "hal": "henry harold", "hank": "henry", "harry": "henry harold", "jack": "john", "jackie": "jacqueline", "jake": "jacob", "jamie": "james", "jeff": "jeffrey", "jen": "jennifer", "jenny": "jennifer", "jerry": "gerald jerome",
    "jess": "jessica", "jim": "james", "jimmy": "james", "jo": "joseph josephine joanna", "joe": "joseph", "joey": "joseph", "johnny": "john", "jon": "jonathan", "josh": "joshua", "josie": "josephine", "kat": "katherine", "kate": "katherine", "kath": "katherine",
    "kathy": "katherine", "katie": "katherine", "ken": "kenneth", "kit": "katherine christopher", "kitty": "katherine", "larry": "lawrence", "len": "leonard", "lenny": "leonard", "leo": "leonard leopold", "lex": "alexander", "lib": "elizabeth", "libby": "elizabeth", "liz": "elizabeth",
    "lizzie": "elizabeth", "lou": "louis louise", "maddie": "madeleine", "madge": "margaret", "maggie": "margaret", "mandy": "amanda", "marge": "margaret", "margie": "margaret", "matt": "matthew", "max": "maximilian", "meg": "margaret", "mel": "melanie melvin", "mick": "michael", "mickey": "michael",
    "mike": "michael", "mikey": "michael", "mitch": "mitchell", "molly": "mary", "nan": "nancy anne", "nat": "nathaniel natalie", "nate": "nathan nathaniel", "ned": "edward", "nell": "eleanor", "nick": "nicholas", "nicky": "nicholas nicole", "nico": "nicholas", "nora": "eleanor", "pam": "pamela", "pat": "patricia patrick",
    "patty": "patricia", "peg": "margaret", "peggy": "margaret", "penny": "penelope", "pete": "peter", "phil": "philip", "polly": "mary", "ray": "raymond", "rich": "richard", "richie": "richard", "rick": "richard", "ricky": "richard", "rob": "robert", "robbie": "robert",
    "ron": "ronald", "ronnie": "ronald veronica", "russ": "russell", "sally": "sarah", "sam": "samuel samantha", "sammy": "samuel samantha", "sandy": "alexander alexandra sandra", "sid": "sidney", "stan": "stanley", "steph": "stephanie", "steve": "stephen", "sue": "susannah susan", "susie": "susannah susan", "suzie": "susannah susan",
    "ted": "theodore edward", "teddy": "theodore edward", "terry": "terence theresa", "theo": "theodore", "tim": "timothy", "timmy": "timothy", "toby": "tobias", "tom": "thomas", "tommy": "thomas", "toni": "anthony antonia", "tony": "anthony", "tori": "victoria", "tricia": "patricia", "trish": "patricia",
    "val": "valerie", "vic": "victor victoria", "vicki": "victoria", "vicky": "victoria", "vince": "vincent", "wally": "walter wallace", "walt": "walter", "wes": "wesley", "will": "william", "willie": "william", "willy": "william", "zach": "zachary", "zack": "zachary",
}
_KNOWN = frozenset(NICKNAMES) | frozenset(n for v in NICKNAMES.values() for n in v.split())
# Kinds of ensemble and the ways to write them.
ENSEMBLES = {
    "trio": ("trio", "3o", "3tet", "tr"), "quartet": ("quartet", "quartett", "quartette", "qt", "qtet", "qrt", "4tet"), "quintet": ("quintet", "quintett", "quintette", "qnt", "5tet"), "sextet": ("sextet", "6tet"),
    "ensemble": ("ensemble", "ensembl", "ens"), "collective": ("collective", "coll", "collectiv"), "brothers": ("brothers", "bros", "brthrs"), "sisters": ("sisters",), "orchestra": ("orchestra", "orchestre", "orch", "orc"),
    "big band": ("big band", "bigband", "bb", "bg bnd", "big bnd", "b band"), "chamber group": ("chamber group", "chmbr grp", "chamber grp", "chmbr group", "ch grp", "chamb grp", "cg"),
}
# Titles that name no piece.
GENERIC = ("intro", "introduction", "outro", "interlude", "prelude", "untitled", "untitled track", "skit", "track", "bonus track", "hidden track", "theme", "finale", "opening", "ending", "no title", "unknown", "unknown title", "reprise", "coda", "overture", "epilogue", "prologue", "n a", "none", "null")
# Words that stand before a piece's number.
NUMBERED = frozenset(("pt", "prt", "part", "no", "nr", "vol", "volume", "number", "chapter", "movement", "mvt", "op", "opus"))

_KINDS = {tuple(w.split()): kind for kind, ways in ENSEMBLES.items() for w in ways}
_LEET = str.maketrans("0134578", "oleastb")
# Digits typed for words.
_SPOKEN = {"2": "to", "4": "for"}


def distance(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance (swapped neighbours cost 1), or most + 1 if it is greater."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], two[j - 2] + 1)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


def plain(word: str) -> str:
    """Digits typed for letters put back."""
    return word if word.isdigit() else word.translate(_LEET)


@lru_cache(200_000)
def sound(text: str) -> str:
    """One spelling for letters that are typed for each other: oo and u, y and i, ph and f, doubled letters."""
    return re.sub(r"(.)\1+", r"\1", text.replace("ph", "f").replace("ck", "k").replace("oo", "u").replace("y", "i"))


def near(a: str, b: str, most: int) -> int:
    """The lesser of the distances as typed and as it sounds."""
    d = distance(a, b, most)
    return d if d <= most and d < 2 else min(d, distance(sound(a), sound(b), most))


def _clean(text: str) -> str:
    text = unicodedata.normalize("NFKC", text)
    return "".join(c for c in text if unicodedata.category(c) not in ("Cf", "Cc") or c in "\t\n")


def _kind(tokens: list[str]) -> tuple[list[str], str]:
    """Tokens without the ensemble at their end, and its kind."""
    for n in (2, 1):
        if len(tokens) > n and (kind := _KINDS.get(tuple(tokens[-n:]))):
            return tokens[:-n], kind
    for n in (2, 1):
        if len(tokens) > n:
            last = " ".join(tokens[-n:])
            for ways, kind in _KINDS.items():
                way = " ".join(ways)
                if len(ways) == n and len(way) >= 6 and distance(last, way, 2 if len(way) > 8 else 1) <= (2 if len(way) > 8 else 1):
                    return tokens[:-n], kind
    return tokens, ""


def read_artist(raw: str | None) -> tuple[str, str, str, str] | None:
    """(given, middle initials, surname, ensemble) of the lead artist; given is a first name, several that a short form may stand for, one letter or
    nothing. None if nothing is named."""
    text = _clean(raw or "").strip()
    low = text.lower()
    at = min((i for cut in ARTIST_CUTS if cut != ", " and (i := low.find(cut)) > 0), default=len(text))
    text = text[:at]
    grouped = " ".join(re.findall(r"\(([^()]*)\)", text))
    text = re.sub(r"\([^()]*\)", " ", text)
    parts = [p.strip() for p in re.split(r",\s", text) if p.strip()]
    if len(parts) > 1:
        first, second = re.findall(r"\w+", parts[0]), re.findall(r"\w+", parts[1])
        if fold(parts[1]) == "the":
            text = parts[0]
        elif len(first) == 1 and 1 <= len(second) <= 3:
            text = f"{parts[1]} {parts[0]}"
        else:
            text = parts[0]
    if not text.isupper():
        text = re.sub(r"(?<=[^\W\d_])(?<=[^A-Z\W])(?=[A-Z][^\W\d_])|(?<=[a-z])(?=[A-Z]\.)", " ", text)
    tokens = [t for t in fold(f"{text} {grouped}").split()]
    tokens, kind = _kind(tokens)
    if len(tokens) > 1 and tokens[0] == "the":
        tokens = tokens[1:]
    if not tokens or tokens == ["the"]:
        return None
    if len(tokens) == 1:
        return "", "", plain(tokens[0]), kind
    given, middle = tokens[0], [t for t in tokens[1:-1]]
    initials = "".join(t for t in middle if len(t) == 1)
    rest = [t for t in middle if len(t) > 1]
    given = NICKNAMES.get(given) or (plain(given) if len(given) > 1 else given)
    return given, initials, "".join(plain(t) for t in [*rest, tokens[-1]]), kind


def is_full(given: str) -> bool:
    """One first name, rather than none, a letter or a short form of several."""
    return len(given) > 1 and " " not in given


def _kin(a: str, b: str) -> bool:
    """Two names of which one is the other with a vowel at its end, as Paul and Paula."""
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and b.startswith(a) and b[-1] in "aeio"


def given_cost(a: str, b: str, slip: bool = False) -> int:
    """0 equal or not told apart, n edits, 9 different. Names that differ by a vowel at the end are different unless that is known to be a slip."""
    if a == b:
        return 0
    if len(a) < 2 or len(b) < 2:
        return 0 if not a or not b or any(x[0] == y[0] for x in a.split() for y in b.split()) else 9
    if " " in a or " " in b:
        return min(given_cost(x, y, slip) for x in a.split() for y in b.split())
    if not slip and _kin(a, b):
        return 9
    d = near(a, b, 2)
    return d if d < 1 or d == 1 and min(len(a), len(b)) >= 4 or d == 2 and min(len(a), len(b)) >= 7 else 9


def surname_edits(length: int) -> int:
    return 2 if length >= 7 else 1 if length >= 4 else 0


def artist_match(a: tuple, b: tuple, slip: bool = False) -> str:
    """"same", "weak" (the same but for a first name or middle initial that one of them leaves open) or ""."""
    (g, m, s, k), (h, n, t, q) = a, b
    if k != q or m and n and m != n:
        return ""
    most = surname_edits(min(len(s), len(t)))
    d = near(s, t, most)
    if d <= most:
        if given_cost(g, h, slip) + d > 2:
            return ""
        return "same" if (is_full(g) and is_full(h) or g == h) and m == n else "weak"
    if (not g or not h) and len(g) + len(h) > 1 and " " not in g + h and min(len(g + s), len(h + t)) >= 9 and near(g + s, h + t, 1) <= 1:
        # "leonardtudibow": the first name run into the surname.
        return "same"
    # "Okafor Samuel": the parts typed the other way round, where only one order begins with a known first name.
    return "same" if g == t and s == h and len(g) > 1 and (g in _KNOWN) != (h in _KNOWN) and m == n else ""


def read_title(raw: str | None) -> tuple[str, str, str] | None:
    """(words, the same words in order, numbers) of the piece; None if no piece is named."""
    text = without_edition(_clean(raw or ""))
    tokens = fold(re.sub(r"['’`´]", "", text.replace("&", " and ").replace("+", " and "))).split()
    if not tokens or " ".join(t for t in tokens if not t.isdigit()) in GENERIC:
        return None
    numbers, words = [], []
    for i, t in enumerate(tokens):
        if t in _SPOKEN and 0 < i < len(tokens) - 1 and tokens[i - 1] not in NUMBERED and tokens[i + 1] not in NUMBERED and not tokens[i + 1].isdigit():
            words.append(_SPOKEN[t])
        elif t.isdigit():
            numbers.append(str(int(t)))
        elif not (t in NUMBERED and i + 1 < len(tokens) and tokens[i + 1].isdigit()):
            words.append(plain(t))
    if len(words) > 2 and len(words[0]) > 1 and words[0][0] in "th" and distance(words[0], "the", 1) <= 1:
        words = words[1:]
    if not words:
        return (" ".join(numbers), "", ".".join(numbers)) if len(numbers) > 1 else None
    return " ".join(words), " ".join(sorted(words)), ".".join(numbers)


def _heads(word: str) -> set[str]:
    """First letter and what an abbreviation goes on with: the second letter or the next consonant."""
    after = next((c for c in word[1:] if c not in "aeiou"), "")
    return {word[0] + word[1:2], word[0] + after}


def _shortened(a: str, b: str) -> bool:
    """One word abbreviates the other: its start, or its first letter and some later ones in order, mostly consonants."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < 2 or len(b) < len(a) + 2 or not _heads(a) & _heads(b):
        return False
    at = iter(b)
    return (b.startswith(a) or not set("aeiou") & set(a[1:])) and all(c in at for c in a)


def title_edits(length: int) -> int:
    return 2 if length >= 9 else 1 if length >= 5 else 0


def _run(words: str) -> str:
    return words.replace(" ", "").removeprefix("the")


def title_match(a: tuple, b: tuple, slip: bool = False) -> str:
    """"same" if the numbers are equal and the words are within two edits as they run on, or the same in any order but for one that has one edit
    or is abbreviated in its place."""
    (x, _, n), (y, _, m) = a, b
    if n != m:
        return ""
    u, v = _run(x), _run(y)
    most = title_edits(min(len(u), len(v)))
    if near(u, v, most) <= most:
        return "same"
    p, q = [sound(w) for w in x.split()], [sound(w) for w in y.split()]
    if len(p) != len(q) or len(p) < 2:
        return ""
    if sorted(p) == sorted(q):
        return "same"
    over, under = list((Counter(p) - Counter(q)).elements()), list((Counter(q) - Counter(p)).elements())
    if len(over) == 1:
        w, t = over[0], under[0]
        if min(len(w), len(t)) >= 5 and distance(w, t, 1) <= 1:
            return "same"
        if p.index(w) == q.index(t) and len(u) - len(w) >= 5 and len(v) - len(t) >= 5 and [k for k in p if k != w] == [k for k in q if k != t] and _shortened(w, t):
            return "same"
    return ""


@lru_cache(100_000)
def _read_artist(raw: str) -> tuple | None:
    return read_artist(raw)


def same_lead_artist(a: str | None, b: str | None) -> bool:
    """Whether two typed credits name one lead artist, as far as the two alone can tell."""
    if a is None or b is None:
        return False
    if a == b:
        return _read_artist(a) is not None
    x, y = _read_artist(a), _read_artist(b)
    return x is not None and y is not None and artist_match(x, y, slip=True) != ""


_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(4_096, _BASE)]), dtype=np.uint64)
_LETTERS = np.random.default_rng(3).integers(1, 2**63, 65_536).astype(np.uint64)


def _number(text: str) -> np.uint64:
    raw = text.encode("utf-8", "surrogatepass")
    return np.uint64(zlib.crc32(raw) << 32 | zlib.crc32(b"+" + raw[::-1]))


@lru_cache(256)
def _two(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def _less(c: np.ndarray, out: int) -> np.ndarray:
    """For texts of one length, a row of letters each: hashes of what is left without so many (0, 1, 2) letters, one column a choice."""
    n = c.shape[1]
    ahead = np.zeros((len(c), n + 1), np.uint64)  # hash of the first i letters
    for i in range(n):
        ahead[:, i + 1] = ahead[:, i] * _BASE + c[:, i]
    if out == 0:
        return ahead[:, -1:]
    back = np.zeros((len(c), n + 1), np.uint64)  # of the letters from i on
    for i in range(n - 1, -1, -1):
        back[:, i] = c[:, i] * _POWERS[n - 1 - i] + back[:, i + 1]
    if out == 1:
        i = np.arange(n)
        return ahead[:, i] * _POWERS[n - 1 - i] + back[:, i + 1]
    i, j = _two(n)
    between = ahead[:, j] - ahead[:, i + 1] * _POWERS[j - i - 1]
    return ahead[:, i] * _POWERS[n - 2 - i] + between * _POWERS[n - 1 - j] + back[:, j + 1]


def edit_keys(texts: list[str], edits: int) -> np.ndarray:
    """For texts of one length, a row each: numbers of which two texts within so many edits (at most 2) share at least one, if neither asks for
    fewer edits than are between them."""
    n = len(texts[0])
    if n > 4_000:
        return np.array([[_number(t)] for t in texts], np.uint64)  # longer than any name: only equal texts meet
    c = _LETTERS[np.array([[min(ord(x), 65_535) for x in t] for t in texts], np.int64).reshape(len(texts), n)]
    keys = []
    if n <= SHORT or edits < 2:
        keys += [_less(c, out) + np.uint64(0x51ED) * np.uint64(n - out) for out in range(min(edits, n) + 1)]
    if n > LONG and edits == 2:
        for out in range(3):
            start, end = _less(c[:, : START + out], out), _less(c[:, out - END - 2 :], 2 - out)
            # A factor for each way: else leaving two letters out here would meet leaving one out on either side.
            keys.append((start[:, :, None] * _POWERS[END + out + 1] + end[:, None, :] ^ np.uint64(0xA5A5 + out)).reshape(len(c), -1))
    return np.hstack(keys)


def _forms(text: str) -> set[str]:
    return {text, sound(text)}


@np.errstate(over="ignore")
def blocking_keys(field: str, nodes: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """(keys as numbers, whose they are): two profiles that match have at least one key in common."""
    texts: dict[tuple[int, int], list[tuple[int, str, int]]] = {}
    plain_keys: list[tuple[int, int]] = []

    def add(row: int, text: str, edits: int, kind: str) -> None:
        texts.setdefault((len(text), edits), []).append((row, text, int(_number(kind))))

    for row, node in enumerate(nodes):
        if field == "artist":
            g, _, s, kind = node
            for x in _forms(s):
                add(row, x, surname_edits(len(s)), "s" + kind)
            if len(g + s) >= 9 and " " not in g:
                for x in _forms(g + s):
                    add(row, x, 1, "w" + kind)
            if len(g) > 1:
                plain_keys.append((row, int(_number("o" + kind + "|".join(sorted((g, s)))))))
        else:
            x, _, numbers = node
            u = _run(x)
            for y in _forms(u):
                add(row, y, title_edits(len(u)), "t" + numbers)
            words = [sound(w) for w in x.split()]
            if len(words) > 1:
                ranked = sorted(words)
                plain_keys.append((row, int(_number(f"p{numbers}|" + " ".join(ranked)))))
                for i, w in enumerate(ranked):
                    if len(w) >= 5 and (i == 0 or ranked[i - 1] != w):
                        # One edit leaves the first two letters or the last two as they were.
                        rest = " ".join([*ranked[:i], *ranked[i + 1 :]])
                        plain_keys += [(row, int(_number(f"{end}{numbers}|{part}|{rest}"))) for end, part in (("b", w[:2]), ("e", w[-2:]))]
                for i, w in enumerate(words):
                    rest = " ".join([*words[:i], "*", *words[i + 1 :]])
                    plain_keys += [(row, int(_number(f"a{numbers}|{h}|{rest}"))) for h in _heads(w)]
    keys, rows = [np.array([k for _, k in plain_keys], np.uint64)], [np.array([r for r, _ in plain_keys], np.int64)]
    for (_, edits), some in texts.items():
        found = edit_keys([t for _, t, _ in some], edits) ^ np.array([k for _, _, k in some], np.uint64)[:, None]
        keys.append(found.ravel())
        rows.append(np.repeat([r for r, _, _ in some], found.shape[1]))
    return np.concatenate(keys).view(np.int64), np.concatenate(rows)


_READ = {"artist": read_artist, "title": read_title}
_MATCH = {"artist": artist_match, "title": title_match}
_FORM = {"artist": normal_artist, "title": normal_title}
_SEP = "\x1f"


def _profiles(names: DataFrame, field: str) -> DataFrame:
    """name -> (name, form, node): the stored string, its normalized form and its profile; strings that name nothing are gone."""
    read, form = _READ[field], _FORM[field]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(x, form(x), _SEP.join(p)) for x in b.column(0).to_pylist() if (p := read(x)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["name", "form", "node"])

    return names.mapInArrow(run, "name string, form string, node string")


def _keyed(nodes: DataFrame, field: str) -> DataFrame:
    """nodes(z, node, ...) -> (key, z)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2_000):
                part = b.slice(at, 2_000)
                keys, rows = blocking_keys(field, [tuple(n.split(_SEP)) for n in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part.column(0).to_numpy()[rows])], ["key", "z"])

    return nodes.select("z", "node").mapInArrow(run, "key long, z long")


def _candidates(posted: DataFrame, scratch: Scratch) -> DataFrame:
    """posted(key, z) -> (a, b), a < b: every two profiles with a common key, once."""

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by key. (a, b, hot): pairs of a group of up to UNIT; of a larger one its rows, as (key, z)."""
        # The last group so far: its rows, or its key alone once it is known to be large.
        ks = zs = np.zeros(0, np.int64)
        large = None

        def out(a: np.ndarray, b: np.ndarray, flag: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), flag))], ["a", "b", "hot"])

        def paired(starts: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
            for n in np.unique(sizes[sizes > 1]).tolist():
                at = starts[sizes == n]
                if n > UNIT:
                    for x in at.tolist():
                        yield out(ks[x : x + n], zs[x : x + n], True)
                    continue
                i, j = _two(n)
                step = max(1, 500_000 // len(i))
                for x in range(0, len(at), step):
                    rows = np.sort(zs[at[x : x + step, None] + np.arange(n)], axis=1)
                    a, b = rows[:, i].ravel(), rows[:, j].ravel()
                    # A row that is there twice is no pair.
                    yield out(a[a != b], b[a != b], False)

        for batch in batches:
            k, z = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if large is not None:
                n = int(np.searchsorted(k, large, "right"))
                yield out(k[:n], z[:n], True)
                k, z = k[n:], z[n:]
            if not len(k):
                continue
            large = None
            ks, zs = np.concatenate([ks, k]), np.concatenate([zs, z])
            starts = np.concatenate([[0], np.flatnonzero(ks[1:] != ks[:-1]) + 1])
            yield from paired(starts[:-1], np.diff(starts))
            last = int(starts[-1])
            ks, zs = ks[last:], zs[last:]
            if len(ks) > UNIT:
                yield out(ks, zs, True)
                large, ks, zs = int(ks[0]), ks[:0], zs[:0]
        if len(ks):
            yield from paired(np.zeros(1, np.int64), np.array([len(ks)]))

    met = scratch.save(posted.repartition("key").sortWithinPartitions("key").mapInArrow(pair, "a long, b long, hot boolean").distinct())
    pairs = met.filter("NOT hot").select("a", "b")
    hot = met.filter("hot").select(F.col("a").alias("key"), F.col("b").alias("z"))
    if not hot.isEmpty():
        sizes = hot.groupBy("key").agg(F.ceil(F.count("*") / UNIT).cast("int").alias("blocks"))
        laid = hot.join(sizes, "key").withColumn("at", F.pmod(F.xxhash64("z"), F.col("blocks").cast("long")).cast("int"))
        # Each row meets each block once, in the unit of the two blocks.
        units = laid.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.least("at", "to").alias("x"), F.greatest("at", "to").alias("y"), "z", "at")
        one, two = (units.select("key", "x", "y", F.col("z").alias(n), F.col("at").alias(f"at_{n}")) for n in "ab")
        crossed = one.join(two, ["key", "x", "y"]).filter((F.col("a") < F.col("b")) & ((F.col("at_a") != F.col("at_b")) | (F.col("x") == F.col("y"))))
        pairs = pairs.unionByName(crossed.select("a", "b")).distinct()
    return pairs


def _letters(texts: list[str]) -> np.ndarray:
    """How often each letter is in each text; letters may share a column."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) & 63
    rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return np.bincount(rows * 64 + codes, minlength=64 * len(texts)).reshape(-1, 64)


def titles_may_match(nodes: list[tuple], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """False only where title_match of the two is "": by their letters, each of two texts has at most as many that the other lacks as there are
    edits between them, and a short form has none."""
    runs = [_run(x) for x, _, _ in nodes]
    words = [[sound(w) for w in x.split()] for x, _, _ in nodes]
    count, size = np.array([len(w) for w in words]), np.array([len(u) for u in runs])

    def lacking(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        held = _letters(texts)
        apart = held[left] - held[right]
        return np.maximum(apart, 0).sum(axis=1), np.maximum(-apart, 0).sum(axis=1)

    least = np.minimum(size[left], size[right])
    most = np.where(least >= 9, 2, np.where(least >= 5, 1, 0))
    may = np.zeros(len(left), bool)
    for texts in (runs, [sound(u) for u in runs]):
        may |= np.maximum(*lacking(texts)) <= most
    over, under = lacking(["".join(w) for w in words])
    return may | (count[left] == count[right]) & (count[left] > 1) & ((np.maximum(over, under) <= 1) | (np.minimum(over, under) == 0))


def _compared(pairs: DataFrame, nodes: DataFrame, field: str) -> DataFrame:
    """(a, b, kind) of the pairs that match. Each pair is compared once."""
    match, artist = _MATCH[field], field == "artist"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, kinds = [], []
            one, two, n_one, n_two = (batch.column(c).to_pylist() for c in (2, 3, 4, 5))
            at = {x: i for i, x in enumerate(dict.fromkeys([*one, *two]))}
            read = [tuple(x.split(_SEP)) for x in at]
            left, right = (np.array([at[x] for x in side], np.int64) for side in (one, two))
            for i in range(len(one)) if artist else np.flatnonzero(titles_may_match(read, left, right)).tolist():
                n, m = n_one[i], n_two[i]
                slip = artist and max(n, m) >= RARER * min(n, m)
                if kind := match(read[left[i]], read[right[i]], slip):
                    keep.append(i)
                    kinds.append(kind)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(kinds, pa.string())], ["a", "b", "kind"])

    sides = [nodes.select(F.col("z").alias(x), F.col("node").alias(f"n{x}"), F.col("borne").alias(f"c{x}")) for x in "ab"]
    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "na", "nb", "ca", "cb").mapInArrow(run, "a long, b long, kind string")


def _part(node: Column, i: int) -> Column:
    return F.element_at(F.split(node, _SEP, -1), i)


def _borne(nodes: DataFrame, field: str) -> DataFrame:
    """nodes(z, node) with borne: how many surnames a first name is beside (1 for pieces)."""
    if field != "artist":
        return nodes.withColumn("borne", F.lit(1).cast("long"))
    counts = nodes.select(_part(F.col("node"), 1).alias("given"), _part(F.col("node"), 3).alias("surname")).distinct().groupBy("given").agg(F.count("*").alias("borne"))
    return join_unique(nodes.withColumn("given", _part(F.col("node"), 1)), counts, "given").select("z", "node", "borne")


def _entity_links(members: DataFrame, pairs: DataFrame, field: str, scratch: Scratch) -> DataFrame:
    """(left, right): entities to merge. members(z, node, entity), pairs(a, b, kind)."""
    one, two = (members.select(F.col("z").alias(x), F.col("entity").alias(f"e{x}")) for x in "ab")
    met = pairs.join(one, "a").join(two, "b").filter(F.col("ea") != F.col("eb")).select("ea", "eb", "kind").distinct()
    if field != "artist":
        return met.select(F.col("ea").alias("left"), F.col("eb").alias("right"))
    met = scratch.save(met)
    given, middle = _part(F.col("node"), 1), _part(F.col("node"), 2)
    full = (F.length(given) > 1) & (F.instr(given, " ") == 0)
    known = scratch.save(members.groupBy("entity").agg(F.max(full).alias("named"), F.max(middle != "").alias("lettered"), F.count("*").alias("spellings")))
    weak = met.filter("kind = 'weak'").select("ea", "eb")
    both = weak.unionByName(weak.select(F.col("eb").alias("ea"), F.col("ea").alias("eb"))).distinct()
    sides = [known.select(*[F.col(c).alias(f"{c}_{x}") for c in known.columns]) for x in "ab"]
    fits = scratch.save(both.join(sides[0], F.col("ea") == F.col("entity_a")).join(sides[1], F.col("eb") == F.col("entity_b")).drop("entity_a", "entity_b"))
    # Without a first name: to the one entity that has one and fits. Without a middle initial: to the one that has one, or has most spellings by far.
    poor = F.expr("NOT named_a AND named_b")
    bare = F.expr("named_a = named_b AND NOT lettered_a AND lettered_b")
    weight = F.when(bare, F.col("spellings_b"))
    open_ = fits.groupBy("ea").agg(
        F.count(F.when(poor, 1)).alias("named"), F.min(F.when(poor, F.col("eb"))).alias("name"),
        F.max_by(F.when(bare, F.col("eb")), F.when(bare, F.struct("spellings_b", -F.col("eb")))).alias("letter"), F.max(weight).alias("most"), F.sum(weight).alias("all"),
    )
    settled = scratch.save(open_)
    to = F.when(F.col("named") == 1, F.col("name")).when((F.col("named") == 0) & (F.col("most") >= LARGER * (F.col("all") - F.col("most"))), F.col("letter"))
    loose = fits.filter("NOT named_a AND NOT named_b AND lettered_a = lettered_b AND ea < eb").select("ea", "eb")
    found = settled.filter("named > 0").select("ea")
    alone = loose.join(found, "ea", "left_anti").join(found.withColumnRenamed("ea", "eb"), "eb", "left_anti")
    links = [met.filter("kind = 'same'").select("ea", "eb"), settled.select("ea", to.alias("eb")).filter("eb IS NOT NULL"), alone.select("ea", "eb")]
    return reduce(DataFrame.unionByName, links).select(F.col("ea").alias("left"), F.col("eb").alias("right"))


def _richer(members: DataFrame, changed: DataFrame, field: str) -> DataFrame:
    """(node, entity): the profiles that the changed entities' unions make, of which some may be there already."""
    own = members.join(changed, "entity", "left_semi")
    if field == "artist":
        given, middle = _part(F.col("node"), 1), _part(F.col("node"), 2)
        full = (F.length(given) > 1) & (F.instr(given, " ") == 0)
        names = own.filter(full).groupBy("entity", given.alias("given")).agg(F.count("*").alias("n")).groupBy("entity").agg(F.max_by("given", F.struct("n", "given")).alias("name"))
        letters = own.filter(middle != "").groupBy("entity").agg(F.collect_set(middle).alias("m")).filter(F.size("m") == 1).select("entity", F.col("m")[0].alias("letters"))
        open_ = own.filter(~full | (middle == "")).join(names, "entity").join(letters, "entity", "left")
        node = F.concat_ws(_SEP, F.when(full, given).otherwise(F.col("name")), F.when(middle == "", F.coalesce("letters", F.lit(""))).otherwise(middle), _part(F.col("node"), 3), _part(F.col("node"), 4))
        return open_.select(node.alias("node"), "entity").distinct()
    words = own.select("entity", _part(F.col("node"), 3).alias("numbers"), F.split(_part(F.col("node"), 1), " ").alias("words"))
    # Places are compared among the members whose words have the first letters, in order, that most of them have.
    words = words.withColumn("heads", F.array_join(F.transform("words", lambda w: F.substring(w, 1, 1)), ""))
    common = words.groupBy("entity", "heads").agg(F.count("*").alias("c")).groupBy("entity").agg(F.max_by("heads", F.struct("c", "heads")).alias("heads"))
    placed = words.join(common, ["entity", "heads"]).select("entity", "numbers", F.posexplode("words").alias("at", "word"))
    best = placed.groupBy("entity", "numbers", "at", "word").agg(F.count("*").alias("c")).groupBy("entity", "numbers", "at").agg(F.max_by("word", F.struct("c", F.length("word"), "word")).alias("word"))
    lists = best.groupBy("entity", "numbers").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]).alias("w"))
    node = F.concat_ws(_SEP, F.array_join("w", " "), F.array_join(F.array_sort("w"), " "), F.col("numbers"))
    return lists.select(node.alias("node"), "entity")


def resolve(spark: SparkSession, names: DataFrame, field: str, scratch: Scratch | None = None) -> DataFrame:
    """names(name) -> (name, form, entity) of every string that names an artist or a piece.

    field is "artist" or "title". Defined cases: null, empty and blank names, names without a letter or digit of the Latin script and generic
    titles name nothing and are absent; repeated names count once; a name that matches no other is an entity by itself; an empty table gives no
    rows. A profile that leaves something open joins an entity only if it fits no second one.
    """
    scratch = scratch or Scratch(spark, f"names-{field}")
    typed = scratch.save(_profiles(names.select("name").filter(F.col("name").isNotNull()).distinct(), field))
    numbered = scratch.save(typed.select("node").distinct().withColumn("z", F.monotonically_increasing_id()))
    nodes = scratch.save(_borne(numbered, field))
    members = scratch.save(nodes.select("z", "node", F.col("z").alias("entity")))
    pairs = scratch.save(_compared(_candidates(_keyed(nodes, field), scratch), nodes, field))
    for number in range(1, MAX_ROUNDS + 1):
        merged = scratch.save(connected_components(spark, _entity_links(members, pairs, field, scratch), scratch))
        if merged.isEmpty():
            break
        moved = members.join(merged.select(F.col("node").alias("entity"), "component"), "entity", "left")
        members = scratch.save(moved.select("z", "node", F.coalesce("component", "entity").alias("entity")))
        new = _richer(members, merged.select(F.col("component").alias("entity")).distinct(), field).join(members.select("node").distinct(), "node", "left_anti")
        # A profile that two entities come to share goes to the first; what it matches joins the other.
        new = new.groupBy("node").agg(F.min("entity").alias("entity")).withColumn("z", F.monotonically_increasing_id() + (number << 56))
        if field == "artist":
            borne = nodes.select(_part(F.col("node"), 1).alias("given"), "borne").distinct()
            new = new.withColumn("given", _part(F.col("node"), 1)).join(borne, "given", "left").drop("given")
        else:
            new = new.withColumn("borne", F.lit(1).cast("long"))
        new = scratch.save(new.select("z", "node", "entity", F.coalesce("borne", F.lit(1).cast("long")).alias("borne")))
        if new.isEmpty():
            continue
        asked = scratch.save(_keyed(new, field))
        # Of all others only what shares a key with a new profile; few new keys travel to the others' keys, many meet them in a shuffle.
        posted = _keyed(nodes, field).join(asked.select("key").distinct(), "key", "left_semi").unionByName(asked)
        nodes = scratch.save(nodes.unionByName(new.select("z", "node", "borne")))
        # Numbers of a round's new profiles lie above all before.
        found = _candidates(posted, scratch).filter(F.col("b") >= number << 56)
        pairs = scratch.save(pairs.unionByName(_compared(found, nodes, field)))
        members = scratch.save(members.unionByName(new.select("z", "node", "entity")))
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    return typed.join(members.select("node", "entity"), "node").select("name", "form", "entity")


def variant_pairs(spark: SparkSession, tracks: DataFrame) -> DataFrame:
    """(field, name_a, name_b): different stored strings of one lead artist or one piece whose normalized forms differ.

    Normalized forms are paired within their entity, then expanded to the strings of each, so the shuffle's key is the form, not the entity."""
    out = None
    for field in ("artist", "title"):
        scratch = Scratch(spark, f"variants-{field}")
        known = scratch.save(resolve(spark, tracks.select(F.col(field).alias("name")), field, scratch))
        forms = known.select("entity", "form").distinct()
        met = forms.withColumnRenamed("form", "fa").join(forms.withColumnRenamed("form", "fb"), "entity").filter(F.col("fa") < F.col("fb"))
        one, two = (known.select("entity", F.col("form").alias(f"f{x}"), F.col("name").alias(x)) for x in "ab")
        pairs = met.join(one, ["entity", "fa"]).join(two, ["entity", "fb"]).select(F.lit(field).alias("field"), F.least("a", "b").alias("name_a"), F.greatest("a", "b").alias("name_b"))
        out = pairs if out is None else out.unionByName(pairs)
    return out
