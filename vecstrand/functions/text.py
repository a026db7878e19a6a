"""Text folding and the normalized forms of titles and artists.

Two renderings of one definition: Python functions (exact Unicode, for Arrow kernels) and Catalyst columns (for plans that should stay in the
JVM). They differ only where a compatibility character decomposes into several ASCII ones, which the columns drop.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark an edition of a recording.
EDITION_WORDS = (
    "feat", "feats", "featuring", "ft", "with", "remaster", "remastered", "remastering", "live", "mono", "stereo", "take", "takes", "version", "versions",
    "edit", "edited", "mix", "mixes", "demo", "bonus", "from", "deluxe", "anniversary",
)
# From the first of these on, an artist credit names guests.
ARTIST_CUTS = (" feat", " featuring", " ft.", " ft ", " & ", ", ", " with ")

_GROUP = re.compile(r"\([^()]*\)|\[[^\[\]]*\]")
_YEAR = re.compile(r"\b(?:19|20)\d{2}\b")
_WORDS = frozenset(EDITION_WORDS)


def fold(text: str | None) -> str:
    """Lower case, accents off, every other run of characters one space. Characters without an ASCII base vanish."""
    plain = unicodedata.normalize("NFKD", (text or "").lower()).encode("ascii", "ignore").decode()
    return re.sub(r"[^a-z0-9]+", " ", plain).strip()


def names_edition(part: str) -> bool:
    return _YEAR.search(part) is not None or not _WORDS.isdisjoint(fold(part).split())


def without_edition(title: str | None) -> str:
    """Lower-case title without bracketed groups and trailing " - " segments that name an edition."""
    text = _GROUP.sub(lambda m: "" if names_edition(m[0][1:-1]) else m[0], (title or "").lower())
    while (dash := text.rfind(" - ")) >= 0 and names_edition(text[dash + 3 :]):
        text = text[:dash]
    return text


def normal_title(title: str | None) -> str:
    return fold(without_edition(title))


def lead_credit(artist: str | None) -> str:
    text = (artist or "").lower()
    return text[: min((at for cut in ARTIST_CUTS if (at := text.find(cut)) >= 0), default=len(text))]


def normal_artist(artist: str | None) -> str:
    return fold(lead_credit(artist))


def _bases() -> tuple[str, str]:
    """Letters and digits beyond ASCII with one ASCII base each, by the Unicode tables: Latin ranges, full-width forms, super- and subscripts."""
    ranges = [(0xA0, 0x250), (0x1E00, 0x1F00), (0x2070, 0x20A0), (0xFF01, 0xFF5F)]
    pairs = []
    for first, last in ranges:
        for point in range(first, last):
            base = unicodedata.normalize("NFKD", chr(point).lower()).encode("ascii", "ignore").decode()
            if len(base) == 1:
                pairs.append((chr(point), base))
    return "".join(p for p, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _bases()


def fold_column(c: Column) -> Column:
    plain = F.regexp_replace(F.translate(F.lower(F.translate(c, _FROM, _TO)), _FROM, _TO), r"[^\x00-\x7F]+", "")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def names_edition_column(c: Column) -> Column:
    return c.rlike(r"\b(?:19|20)\d{2}\b") | F.arrays_overlap(F.split(fold_column(c), " "), F.array(*[F.lit(w) for w in EDITION_WORDS]))


def normal_title_column(c: Column) -> Column:
    """The bracket rule as one alternation: a group goes if it holds a year or an edition word between non-word characters."""
    words = "|".join(EDITION_WORDS)
    inside = rf"(?:[^()\[\]]*(?:(?<![a-z0-9])(?:{words})(?![a-z0-9])|\b(?:19|20)[0-9]{{2}}\b)[^()\[\]]*)"
    text = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), rf"\({inside}\)|\[{inside}\]", "")
    parts = F.reverse(F.split(text, " - ", -1))
    first_kept = F.aggregate(parts, F.struct(F.lit(True).alias("peeling"), F.lit(0).alias("gone")), lambda s, p: F.struct((s["peeling"] & names_edition_column(p)).alias("peeling"), (s["gone"] + F.when(s["peeling"] & names_edition_column(p), 1).otherwise(0)).alias("gone")))["gone"]
    kept = F.slice(parts, F.least(first_kept + 1, F.size(parts)), F.size(parts))
    return fold_column(F.array_join(F.reverse(kept), " - "))


def normal_artist_column(c: Column) -> Column:
    cuts = "|".join(re.escape(x) for x in ARTIST_CUTS)
    return fold_column(F.element_at(F.split(F.lower(F.coalesce(c, F.lit(""))), cuts, 2), 1))


def dedupe_key_column(title: Column, artist: Column) -> Column:
    return F.concat_ws("|", normal_artist_column(artist), normal_title_column(title))
