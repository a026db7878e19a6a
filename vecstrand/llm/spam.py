"""Keyword-stuffed and link-list pages.

Measured over the whole text of every document: the share of its most frequent content word and of its most frequent word pair, the share of
repeated lines and of repeated runs of words, the share of link text, separators per word, and the share of function words. The threshold on each of these is calibrated per language
over all documents (quantiles of the corpus, one row a language); the language is read off the
function words themselves, since the stated one may be wrong or missing.

A page is stuffed if the words of its stuffed segments (lines, and sentences within lines) outweigh those of its sentences. A segment is stuffed
if it is link text, if it lacks function words while separators or missing ends mark it as a list, or if it turns on one of the words that
dominate the page. Where the top pair, the repeated runs or the repeated lines pass their threshold, the copies of a much repeated sentence or line are stuffed too, unless
prose stands beside them, as it does beside a refrain. Lists that go with writing (tracks with times, personnel, chords, bare sources) weigh on neither side.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecstrand.plans.durable import Scratch

# Articles, pronouns, prepositions, conjunctions, auxiliaries and adverbs of degree of each language.
FUNCTION_WORDS = {
    "en": "the a an and of in to is it that for with on as at by from this these those i you we they he she not no but was are be been or had has have do does did his her its their our your my me him us them one all there here then so than too very until after before while where when which who what if because though through into over under up out off about again once only just more most some any each both few other such own same s t d ll m re ve can could will would should may might must between against during above below down nobody nothing",
    "es": "de la el los las y e o u en que un una unos unas del al se por con para sin sobre entre hasta desde no ni si sí lo le les su sus mi tu es son era eran fue ha han había hay ser está como más menos pero porque cuando donde quien cual este esta estos estas ese esa eso esto otro otra todo toda todos nada nadie algo muy ya también después antes casi yo él ella nos me te",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber ist sind war waren wird werden hat haben hatte nicht kein keine nur auch noch schon mit von vom in im an am auf aus bei beim zu zum zur für über unter um vor nach ohne durch gegen bis wie als wenn weil dass so da dann dort hier es er sie wir ich ihr man sich sein seine mein uns ihm ihn was wer wo sehr mehr",
    "fr": "le la les l un une des de du d et ou mais ni est sont était être a ont avait en dans sur sous par pour avec sans entre vers chez au aux à ce cet cette ces c s se son sa ses leur leurs mon ma mes on il elle ils elles nous vous je j tu y ne n pas plus moins très trop presque rien tout tous toute que qu qui dont où quand comme si même aussi encore après avant deux",
    "pt": "o a os as um uma uns umas e ou de do da dos das em no na nos nas por pelo pela pelos pelas para com sem sob sobre entre até desde não nem se que quem qual quando onde como mais menos mas porque é são era eram foi ser está ao aos à às seu sua seus suas meu minha este esta esse essa isso isto ele ela eles elas eu nós me muito também já ainda só depois antes tem há tudo nada dois duas",
    "ru": "и в во на не ни с со по к ко из от до за о об у для без под над при про через между что как это этот эта эти тот та те он она оно они мы вы я его её их ему ей им нас вас мне меня был была было были есть быть же ли бы то но а или если когда где там здесь так уже ещё все всё весь вся раз только очень почти после перед каждый никто ничего больше",
}
_WORDS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_ANY = frozenset().union(*_WORDS.values())
_LANGS = tuple(_WORDS)
_OF = {w: tuple(k for k, v in enumerate(_WORDS.values()) if w in v) for w in _ANY}
_TOKEN = re.compile(r"[^\W_]+")
_LINK = re.compile(r"\[[^\]\n]*\]\(\s*[^)\s]*\s*\)|<a\s[^>]*>|(?:https?://|www\.)\S+|\b(?:[\w-]+\.)+(?:com|net|org|info|biz|example|invalid|test|io|co|ru|de|fr|es)/\S*", re.IGNORECASE)
_TAG = re.compile(r"#\w+")
_CAMEL = re.compile(r"[A-Z][a-zà-ÿ]+|\d+")
_TRACK = re.compile(r"^\s*(?:\d+[.)]?|[-*•])?\s*.{1,120}?[\s(\[–-]+\d{1,2}:\d\d[)\]]?\s*$")
_CREDIT = re.compile(r"^\s*[^\d\W][\w' -]{1,40}: *[^\W\d_][\w.' &ëâôïüñãàéè-]{1,80}$")
_CHORD = re.compile(r"^(?:[A-H][#b♯♭]?)?(?:m|maj|min|dim|aug|sus|add|M)?\d*(?:[b#]\d+)?(?:[/(]\S*)?$|^(?:flat|sharp)$|^[|%:x\d/.-]+$")
# Heads of lists that go with writing.
_HEAD = re.compile(r"^\s*(?:set ?list|track ?list(?:ing)?|tracks|personnel|line-?up|credits|sources)\b", re.IGNORECASE)
_SOURCE = re.compile(r"^\s*(?:[-*•]|\d+[.)]|\[\d+\])?\s*(?:https?://|www\.)\S+\s*$", re.IGNORECASE)
_SEPARATOR = re.compile(r"[,;|·•]|\s[-–—:/*~>»]\s")
_MARKUP = re.compile(r"</?(?!a\s)[a-zA-Z|][^<>]{0,200}>|[*_]{1,3}(?=\w)|(?<=\w)[*_]{1,3}")
_SENTENCE = re.compile(r"(?<=[.!?…。！？])[\"'”“»)]*\s+|(?<=[。！？])")
_KANA = re.compile(r"[぀-ヿ一-鿿]")
_END = re.compile(r"[.!?…。！？:,;][\"'”“»)\]*_]*\s*$|[\"”»]\s*$")
_GARBLED = re.compile(r"[\u0080-¿Â-ÃÐ-Ñâ-ã]")

#: Share of a language's middle document that a sentence must reach in function words.
FUNCTION_SHARE = 0.4
#: A page's dominating word: this many times the language's middle top-word share, this often at least.
TOP_TIMES, TOP_LEAST, TOP_COUNT = 2.2, 0.085, 4
#: No word rules a page that has this share of its language's middle in function words.
RULED = 0.8
#: A page repeats itself: its top pair has this many times its language's middle share, this at least; or its repeated lines or runs of RUN words
#: this share, or that of the language's most repeating documents (the quantile), up to a bound.
PAIR_TIMES, PAIR_LEAST = 4, 0.14
SAID_LEAST, SAID_QUANTILE, SAID_MOST, RUN = 0.6, 0.95, 0.8, 4
#: Share of words said less than TOP_COUNT times from which on repetition is a refrain of prose.
PROSE_BESIDE = 0.25
#: Separators a word of a list: this many times the language's middle document, within these bounds.
SEPARATOR_TIMES, SEPARATOR_LEAST, SEPARATOR_MOST = 3, 0.2, 0.25
#: A link weighs as so many words; text of this share of links is link text, or of so many times the share that the language's most linked documents
#: (the quantile) have.
LINK_WORDS, LINK_SHARE, LINK_QUANTILE, LINK_TIMES, LINK_MOST = 3, 0.1, 0.9, 2, 0.2
#: Share of stuffed words at which a page is stuffed, and how many there must be.
STUFFED_SHARE, STUFFED_WORDS = 0.5, 5


def language(words: list[str], text: str) -> str:
    if not words:
        return "und"
    if len(_KANA.findall(text)) * 3 > len(text):
        return "ja"
    hits = served(words)
    best = max(range(len(hits)), key=lambda k: (hits[k], _LANGS[k]))
    return _LANGS[best] if hits[best] else "und"


def served(words: list[str]) -> list[int]:
    """How many of the words each language's function words make, in the order of _LANGS."""
    hits = [0] * len(_LANGS)
    for w in words:
        if w in _OF:
            for k in _OF[w]:
                hits[k] += 1
    return hits


def shares(text: str) -> tuple[str, int, float, float, float, float, float, float, float]:
    """(language, words, top word, top pair, repeated lines, links, separators, function words, repeated runs): the page's figures."""
    linked = _links(text)
    bare = _LINK.sub(" ", text) if linked else text
    words = _TOKEN.findall(bare.lower())
    lang, n = language(words, bare), len(words)
    known = _WORDS.get(lang, _ANY)
    content = [w for w in words if w not in known and not w.isdigit() and len(w) > 1]
    top = Counter(content).most_common(1)[0][1] / n if content else 0.0
    pairs = Counter(zip(words, words[1:]))
    pair = 2 * pairs.most_common(1)[0][1] / n if pairs else 0.0
    lines = [x.strip().lower() for x in text.split("\n") if x.strip()]
    runs = list(zip(*(words[i:] for i in range(RUN))))
    return lang, n, top, pair, 1 - len(set(lines)) / len(lines) if lines else 0.0, len(linked) / max(1, n + len(linked)), len(_SEPARATOR.findall(bare)) / max(1, n), sum(w in known for w in words) / n if n else 0.0, 1 - len(set(runs)) / len(runs) if runs else 0.0


def _links(text: str) -> list[str]:
    return _LINK.findall(text) if "/" in text or "www." in text or "](" in text or "<" in text else []


def _beside(line: str) -> bool:
    """Whether a line is of a list that goes with writing: chords, a head, a bare source, a track with its time."""
    tokens = line.split()
    if len(tokens) > 2 and all(_CHORD.match(t) for t in tokens) or _HEAD.match(line) or _SOURCE.match(line):
        return True
    return line.rstrip()[-4:].strip(")]")[-2:].isdigit() and _TRACK.match(line) is not None and not _links(line)


def weigh(text: str, function_least: float, top_least: float, lang: str, repeating: bool = False, separators_most: float = SEPARATOR_LEAST, links_most: float = LINK_SHARE) -> tuple[float, float]:
    """(stuffed, sentence) words of a page; of one that is repeating, copies of sentences and lines are stuffed. A pair of Japanese characters counts as a word; a bare source line too."""
    text = html.unescape(text) if "&" in text else text
    text = _MARKUP.sub("", text) if "<" in text or "*" in text or "_" in text else text
    known = _WORDS.get(lang, _ANY)
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    sources = sum(_SOURCE.match(line) is not None for line in lines)
    # Lists that go with writing go before the page's ruling words are sought.
    lines = [line for line in lines if not _beside(line)]
    bare_words = _TOKEN.findall(_LINK.sub(" ", "\n".join(lines)).lower())
    n_all = max(1, len(bare_words))
    counts = Counter(w for w in bare_words if w not in known and not w.isdigit() and len(w) > 1)
    ruling = {w for w, c in counts.items() if c >= TOP_COUNT and c / n_all >= top_least}
    if sum(w in _ANY for w in bare_words) > RULED * function_least / FUNCTION_SHARE * n_all:
        ruling = set()
    stuffed, sentences = float(sources), 0.0
    said: dict[str, list[float]] = {}
    for paragraph in re.split(r"\n[^\S\n]*\n", "\n".join(lines)):
        kept = []
        for line in paragraph.split("\n"):
            if line.strip() and not (":" in line and len(line) < 130 and _CREDIT.match(line) and line.count(":") == 1 and not _SEPARATOR.search(line.split(":", 1)[1]) and not ruling.intersection(_TOKEN.findall(line.lower()))):
                kept.append(line.lstrip("> \t"))
        # Lines without an end run on: a wrapped sentence reads as one, and so does a list.
        for part in _SENTENCE.split("\n".join(kept)):
            links, tags = len(_links(part)), _TAG.findall(part) if "#" in part else []
            bare = _LINK.sub(" ", part) if links else part
            words = _TOKEN.findall(bare.lower())
            kana = 0 if bare.isascii() else len(_KANA.findall(bare))
            n = len(words) + kana / 2
            if not n and not links:
                continue
            before = sentences
            # A tag is several words run together.
            weight = n + LINK_WORDS * links + sum(max(len(_CAMEL.findall(t)), len(t) // 9 + 1) - 1 for t in tags)
            breaks = bare.strip().count("\n")
            separators = len(_SEPARATOR.findall(bare)) + (breaks if breaks > 4 and n <= 4.5 * (breaks + 1) else breaks / 2)
            if links and links >= links_most * (n + links) or len(tags) * 2 > len(words):
                stuffed += weight
            elif kana * 4 > len(bare) and separators * 6 < n:
                sentences += n
            elif not part.isascii() and len(_GARBLED.findall(part)) * 4 > len(part):
                continue
            elif ruling.intersection(words):
                stuffed += weight
            else:
                # Passages in another language are read by its words.
                serving, ended = max(served(words)), _END.search(bare) is not None
                least = max(1, function_least * n)
                if serving >= least and (ended or serving >= 1.5 * least or separators <= n / 20) and (separators <= separators_most * n or serving >= 1.6 * least):
                    sentences += n
                elif separators > separators_most * n or not ended or n > 14:
                    stuffed += weight
                else:
                    sentences += n / 2
            if repeating and sentences > before:
                for line in bare.split("\n"):
                    if (key := " ".join(_TOKEN.findall(line.lower()))):
                        said.setdefault(key, []).append((sentences - before) * len(line) / len(bare))
    copies = sum(sum(w[1:]) for w in said.values() if len(w) >= TOP_COUNT)
    beside = sum(sum(w) for w in said.values() if len(w) < TOP_COUNT)
    if beside < PROSE_BESIDE * (stuffed + sentences):
        stuffed, sentences = stuffed + copies, sentences - copies
    return stuffed, sentences


def stuffed_pages(df: DataFrame, id_column: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(id, language, top_word, top_pair, repeated_lines, links, separators, function_words, stuffed_share) of the stuffed pages.

    Defined cases: null, empty and blank texts, and texts of under STUFFED_WORDS words, are no case; repeated rows come out as often; null ids are kept; an empty
    table gives no rows; other columns are ignored.
    """
    scratch = scratch or Scratch(df.sparkSession, "spam")
    kind = df.schema[id_column].dataType.simpleString()
    names = ["language", "words", "top_word", "top_pair", "repeated_lines", "links", "separators", "function_words"]
    types = ["string", "int", *["double"] * 6]

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [shares(t) for t in b.column(0).to_pylist() if t]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in ((0, pa.string()), (1, pa.int32()), (2, pa.float64()), (3, pa.float64()), (4, pa.float64()), (5, pa.float64()), (6, pa.float64()), (7, pa.float64()), (8, pa.float64()))], ["language", "words", "top_word", "top_pair", "repeated_lines", "links", "separators", "function_words", "repeated_runs"])

    every = df.select(text).mapInArrow(figures, "language string, words int, top_word double, top_pair double, repeated_lines double, links double, separators double, function_words double, repeated_runs double")
    # Calibration over all documents: one row a language, seven at most.
    figured = [F.percentile_approx(c, q) for c, q in (("function_words", 0.5), ("top_word", 0.5), ("top_pair", 0.5), ("repeated_lines", SAID_QUANTILE), ("repeated_runs", SAID_QUANTILE), ("separators", 0.5), ("links", LINK_QUANTILE))]
    middle = {r[0]: r[1:] for r in every.filter("words >= 20").groupBy("language").agg(*figured).collect()}
    often = lambda share: max(SAID_LEAST, min(SAID_MOST, share))
    limits = {k: (FUNCTION_SHARE * f, max(TOP_LEAST, min(0.15, TOP_TIMES * t)), max(PAIR_LEAST, PAIR_TIMES * p), often(m), often(n), max(SEPARATOR_LEAST, min(SEPARATOR_MOST, SEPARATOR_TIMES * a)), max(LINK_SHARE, min(LINK_MOST, LINK_TIMES * b))) for k, (f, t, p, m, n, a, b) in middle.items()}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, rows = [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                if not t:
                    continue
                page = shares(t)
                least, top, pair, lines, runs, separators, links = limits.get(page[0], (0.1, TOP_LEAST, PAIR_LEAST, SAID_LEAST, SAID_LEAST, SEPARATOR_LEAST, LINK_SHARE))
                stuffed, sentences = weigh(t, least, top, page[0], page[3] >= pair or page[4] >= lines or page[8] >= runs, separators, links)
                if stuffed >= STUFFED_WORDS and stuffed >= STUFFED_SHARE * (stuffed + sentences):
                    keep.append(k)
                    rows.append((*page[:8], stuffed / (stuffed + sentences)))
            arrays = [pa.array([r[i] for r in rows], {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[k]) for i, k in enumerate([*types, "double"])]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), *arrays], ["i", *names, "stuffed_share"])

    out = df.select(F.col(id_column).alias("i"), F.col(text).alias("t")).mapInArrow(judge, f"i {kind}, " + ", ".join(f"{n} {k}" for n, k in zip([*names, "stuffed_share"], [*types, "double"])))
    return out.withColumnRenamed("i", id_column)
