"""Text kernel: kana, width, romaji, distance, conjugation.  Columns in, columns out.

Lengths and positions are code points.  White space is Unicode white space as scripts
understand it, which Java's \\s is not (it lacks U+3000), hence SPACE.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

SPACE_SET = r"\s   -     　﻿"
SPACE = f"[{SPACE_SET}]"
#: The same characters as a literal, for trim.
SPACE_CHARS = " \t\n\x0b\f\r\u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))
SOLID = f"[^{SPACE_SET}]"

KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))
HIRAGANA = "".join(map(chr, range(0x3041, 0x3097)))

# The syllables that the converter knows; deliberately without hu, dzu, bba, sshi, tcha.
ROMAJI = {
    "a": "あ", "i": "い", "u": "う", "e": "え", "o": "お",
    "ka": "か", "ki": "き", "ku": "く", "ke": "け", "ko": "こ",
    "sa": "さ", "shi": "し", "su": "す", "se": "せ", "so": "そ",
    "si": "し",
    "ta": "た", "chi": "ち", "tsu": "つ", "te": "て", "to": "と",
    "ti": "ち", "tu": "つ",
    "na": "な", "ni": "に", "nu": "ぬ", "ne": "ね", "no": "の",
    "ha": "は", "hi": "ひ", "fu": "ふ", "he": "へ", "ho": "ほ",
    "ma": "ま", "mi": "み", "mu": "む", "me": "め", "mo": "も",
    "ya": "や", "yu": "ゆ", "yo": "よ",
    "ra": "ら", "ri": "り", "ru": "る", "re": "れ", "ro": "ろ",
    "wa": "わ", "wi": "ゐ", "we": "ゑ", "wo": "を", "n": "ん",
    "ga": "が", "gi": "ぎ", "gu": "ぐ", "ge": "げ", "go": "ご",
    "za": "ざ", "ji": "じ", "zu": "ず", "ze": "ぜ", "zo": "ぞ",
    "zi": "じ",
    "da": "だ", "di": "ぢ", "du": "づ", "de": "で", "do": "ど",
    "ba": "ば", "bi": "び", "bu": "ぶ", "be": "べ", "bo": "ぼ",
    "pa": "ぱ", "pi": "ぴ", "pu": "ぷ", "pe": "ぺ", "po": "ぽ",
    "kya": "きゃ", "kyu": "きゅ", "kyo": "きょ",
    "sha": "しゃ", "shu": "しゅ", "sho": "しょ",
    "cha": "ちゃ", "chu": "ちゅ", "cho": "ちょ",
    "nya": "にゃ", "nyu": "にゅ", "nyo": "にょ",
    "hya": "ひゃ", "hyu": "ひゅ", "hyo": "ひょ",
    "mya": "みゃ", "myu": "みゅ", "myo": "みょ",
    "rya": "りゃ", "ryu": "りゅ", "ryo": "りょ",
    "gya": "ぎゃ", "gyu": "ぎゅ", "gyo": "ぎょ",
    "ja": "じゃ", "ju": "じゅ", "jo": "じょ",
    "bya": "びゃ", "byu": "びゅ", "byo": "びょ",
    "pya": "ぴゃ", "pyu": "ぴゅ", "pyo": "ぴょ",
    "kka": "っか", "kki": "っき", "kku": "っく", "kke": "っけ", "kko": "っこ",
    "ssa": "っさ", "ssi": "っし", "ssu": "っす", "sse": "っせ", "sso": "っそ",
    "tta": "った", "tte": "って", "tto": "っと",
    "tchi": "っち", "cchi": "っち",
    "ppa": "っぱ", "ppi": "っぴ", "ppu": "っぷ", "ppe": "っぺ", "ppo": "っぽ",
    "jji": "っじ", "ffu": "っふ",
}
_BY_LENGTH = sorted(ROMAJI, key=lambda k: (-len(k), k))
ROMAJI_TOKEN = f"(?s)({'|'.join(_BY_LENGTH)}|.)"


def let(value: Column, body) -> Column:
    """Bind a column to a name inside an expression, so that it is computed once a row."""
    return F.transform(F.array(value), body)[0]


#: Elements of a run in running_starts.
_RUN = 64


def running_starts(sizes: Column) -> Column:
    """For each element of an array of sizes the sum of those before it, in the row.  Each run of
    elements is added up once, and so are the sums of runs, so that a long array doesn't cost the
    square of its length."""
    none = F.array().cast("array<bigint>")
    empty = F.struct(none.alias("starts"), F.lit(0).cast("bigint").alias("sum"))

    def added(sizes: Column) -> Column:
        step = lambda so_far, x: F.struct(F.array_append(so_far["starts"], so_far["sum"]).alias("starts"), (so_far["sum"] + x).alias("sum"))
        return F.aggregate(sizes, empty, step)

    def joined(runs: Column) -> Column:
        bases = added(F.transform(runs, lambda run: run["sum"]))["starts"]
        return F.flatten(F.zip_with(runs, bases, lambda run, base: F.transform(run["starts"], lambda start: start + base)))

    def of_runs(sizes: Column) -> Column:
        first = F.sequence(F.lit(1), F.size(sizes), F.lit(_RUN))
        return let(F.transform(first, lambda i: added(F.slice(sizes, i, _RUN))), joined)

    def of_any(sizes: Column) -> Column:
        return F.when(F.size(sizes) == 0, none).when(F.size(sizes) <= _RUN, added(sizes)["starts"]).otherwise(of_runs(sizes))

    return let(sizes, of_any)


def to_hiragana(c: Column) -> Column:
    return F.translate(c, KATAKANA, HIRAGANA)


def to_katakana(c: Column) -> Column:
    return F.translate(c, HIRAGANA, KATAKANA)


def is_hiragana(c: Column) -> Column:
    return c.rlike("(?s)^[ぁ-ゖ]")


def is_katakana(c: Column) -> Column:
    return c.rlike("(?s)^[ァ-ヶ]")


def is_kanji(c: Column) -> Column:
    return c.rlike(r"(?s)^[一-龯㐀-䶿]")


def is_japanese(c: Column) -> Column:
    return c.rlike(r"[　-鿿＀-￯]")


def get_reading(c: Column) -> Column:
    return F.regexp_replace(c, "[^ぁ-ゖァ-ヶ]", "")


@F.pandas_udf(StringType())
def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def nfkc_all(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKC of every text of an array."""
    for s in batches:
        yield s.map(lambda xs: [None if x is None else unicodedata.normalize("NFKC", x) for x in xs], na_action="ignore")


def normalize_japanese(c: Column) -> Column:
    """Full-width ASCII and the ideographic space to ASCII, then NFKC, which contains both.
    Spark has no NFKC.  A text that is plain ASCII is its own normal form, so Python gets a
    null for it."""
    return F.coalesce(_nfkc(F.when(c.rlike(r"[^\x00-\x7f]"), c)), c)


def fold_width(c: Column) -> Column:
    """The part of the normalisation that needs no Python: full-width ASCII and space."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
    return F.translate(c, wide, "".join(map(chr, range(0x21, 0x7F))) + " ")


def romaji_to_hiragana(c: Column) -> Column:
    """Greedy longest match over the lower-cased text; what is no syllable is copied."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(ROMAJI_TOKEN), F.lit(1))
    pairs = [F.lit(x) for pair in ROMAJI.items() for x in pair]
    kana = F.create_map(*pairs)
    return F.array_join(F.transform(parts, lambda x: F.coalesce(F.element_at(kana, x), x)), "")


def romaji_to_hiragana_text(text: str) -> str:
    """The same for a text the driver holds (a query)."""
    import re

    return "".join(ROMAJI.get(x, x) for x in re.findall(ROMAJI_TOKEN, text.lower()))


def trim(c: Column) -> Column:
    """Without the white space (SPACE) at both ends; no regular expression, which would look at every space within."""
    return F.trim(c, F.lit(SPACE_CHARS))


def similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / F.when(longer == 0, F.lit(1)).otherwise(longer))


# ------------------------------------------------------------------ conjugation

ICHIDAN = ("ます", "ない", "て", "た", "れる", "られる", "よう", "ば")
GODAN = {
    "う": ("います", "わない", "って", "った", "えば"),
    "く": ("きます", "かない", "いて", "いた", "けば"),
    "ぐ": ("ぎます", "がない", "いで", "いだ", "げば"),
    "す": ("します", "さない", "して", "した", "せば"),
    "つ": ("ちます", "たない", "って", "った", "てば"),
    "ぬ": ("にます", "なない", "んで", "んだ", "ねば"),
    "ぶ": ("びます", "ばない", "んで", "んだ", "べば"),
    "む": ("みます", "まない", "んで", "んだ", "めば"),
    "る": ("ります", "らない", "って", "った", "れば"),
}
VERB_END = "".join(GODAN)
I_ADJECTIVE = ("い", "く", "くて", "くない", "かった", "くなかった", "ければ")
NA_ADJECTIVE = ("", "な", "に", "で", "だ", "だった", "ではない", "でない", "なら")


def _endings(stem: Column, endings) -> Column:
    return F.array(*[F.concat(stem, F.lit(e)) for e in endings])


def verb_forms(verb: Column) -> Column:
    """Conjugations of a dictionary form.  Every verb in る gets both the ichidan and the godan forms."""
    last, stem = F.right(verb, F.lit(1)), F.substring(verb, F.lit(1), F.length(verb) - 1)
    forms = F.array(verb)
    for end, endings in GODAN.items():
        more = (*ICHIDAN, *endings) if end == "る" else endings
        forms = F.when(last == end, F.concat(F.array(verb), _endings(stem, more))).otherwise(forms)
    return F.array_distinct(F.when(F.length(verb) == 0, F.array().cast("array<string>")).otherwise(forms))


def adjective_forms(adjective: Column) -> Column:
    stem = F.substring(adjective, F.lit(1), F.length(adjective) - 1)
    return F.when(adjective.endswith("い"), _endings(stem, I_ADJECTIVE)).otherwise(F.array(adjective))


def na_adjective_forms(adjective: Column) -> Column:
    return _endings(adjective, NA_ADJECTIVE)


def expand_search(query: Column) -> Column:
    """The query and its conjugations, in order, once each."""
    as_verb = F.when(query.rlike(rf"[{VERB_END}]\z"), verb_forms(query)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(query), adjective_forms(query), as_verb))


def expand_search_text(query: str) -> list[str]:
    """The same for a query the driver holds."""
    out = [query]
    if query.endswith("い"):
        out += [query[:-1] + e for e in I_ADJECTIVE]
    if query and query[-1] in GODAN:
        out += [query[:-1] + e for e in ((*ICHIDAN, *GODAN["る"]) if query[-1] == "る" else GODAN[query[-1]])]
    return list(dict.fromkeys(out))


def detect_pos(word: Column) -> Column:
    return (
        F.when(F.length(word) == 0, "その他")
        .when(word.rlike(rf"[{VERB_END}]\z"), "動詞")
        .when(word.endswith("い"), "い形容詞")
        .when(word.endswith("的") | word.endswith("な"), "な形容詞")
        .when(word.endswith("に") | word.endswith("と"), "副詞")
        .otherwise("名詞")
    )
