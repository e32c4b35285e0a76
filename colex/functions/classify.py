"""Phrase classifier: register, structure, domains, normal form, frequency, as columns.

The word lists and patterns are fixed values.  The structure decision list is data (STRUCTURES),
first match wins; each entry gives a test and five output columns, so order lives in one place.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as L
from .text import SOLID, VERB_END, trim

NOUN, VERB, ADJ_I, ADJ_NA, ADVERB, AUX, EXPRESSION, OTHER = "名詞", "動詞", "い形容詞", "な形容詞", "副詞", "助動詞", "表現", "その他"


def _any(words) -> str:
    return "|".join(re.escape(w) for w in dict.fromkeys(words))


def _has(c: Column, words) -> Column:
    return c.rlike(_any(words))


def _is(c: Column, pattern: str) -> Column:
    return c.rlike(pattern)


def colloquial(text: Column) -> Column:
    """The contractions found, each with its standard form, in fixed order."""
    tests = [
        (_is(text, "てる"), "てる→ている"),
        (_is(text, "(?s)[^出]でる") | text.startswith("でる"), "でる→でいる"),
        (_is(text, "ってた"), "ってた→と言っていた"),
        (_is(text, "てた") & ~_is(text, "ってた"), "てた→ていた"),
        (_is(text, "じゃ"), "じゃ→では"),
        (_is(text, "んだ"), "んだ→のだ"),
        (_is(text, "んです"), "んです→のです"),
        (_is(text, "っぽい"), "っぽい→らしい"),
        (_is(text, "やっぱ"), "やっぱ→やはり"),
    ]
    return F.filter(F.array(*[F.when(test, F.lit(note)) for test, note in tests]), lambda x: x.isNotNull())


def register(text: Column) -> Column:
    return (
        F.when(_has(text, L.SLANG), "俗語")
        .when(_has(text, L.DIALECT), "方言")
        .when(_has(text, L.HONORIFIC), "敬語")
        .when(_is(text, r"(です|ます|ました|ません|でした)\z"), "丁寧語")
        .when(_is(text, rf"([{VERB_END}]|だ|[いかけがきさしたちなにのはひふへほまみめもやゆよらりれろわ])\z"), "普通体")
    )


def word_pos(word: Column) -> Column:
    bare = F.regexp_replace(word, r"(?:だ|です|でした|だった)\z", "")
    return (
        F.when(F.length(word) == 0, OTHER)
        .when(bare.isin(*L.NA_ADJECTIVES) | bare.endswith("的"), ADJ_NA)
        .when(_is(word, rf"[{VERB_END}]\z"), VERB)
        .when(word.endswith("い"), ADJ_I)
        .when(_is(word, r"[にと]\z"), ADVERB)
        .otherwise(NOUN)
    )


def verb_base(text: Column) -> Column:
    """Four suffix rewrites, one after the other."""
    steps = [(r"[わかされ]れる?\z", "う"), (r"られる?\z", "る"), (r"れる?\z", "る"), (r"て\z", "")]
    return reduce(lambda c, s: F.regexp_replace(c, *s), steps, text)


def normalise(text: Column) -> Column:
    """Spoken to written forms: ordered, each over the result of those before."""
    return reduce(lambda c, s: F.regexp_replace(c, *s), L.COLLOQUIAL_FORMS, text)


_S = SOLID
SURU = rf"(?s)^({_any(L.SURU_VERBS)})(?:(?:する|した|して|しない|している|してる|した結果)\z|する)"
QUOTE = rf"^([^\n\r  ]+?)[とって]([思言見考感聞]{_S}*)\z"
PASSIVE = r"(?s)^(.+?)([わかされ]れて[るたいいた]*)\z"
TEITA = r"(?s)^(.+?)(てい?た|でい?た)\z"
TEITA_HEAD = rf"(?:[{VERB_END}]|んで|って|いて|いで)\z"
TE_V = r"(?s)^(.+?)(てい?(?:[るみあおい]|ある|いる|みる|おく|しまう|くる))"
NI = rf"^({_S}+?)に({_S}+)\z"
GA_ADJ = rf"^({_S}+?)が({_S}+[いなか](?:だ|です|った)?)\z"
ADV_V = rf"^({_S}+?り|{_S}+?と)({_S}+[{VERB_END}][^\n\r  ]*?)\z"
FALLBACK = r"(?s)^([一-龯ぁ-ゖァ-ヶ]{1,4})(.+)\z"


def _particle(p: str) -> str:
    return rf"^({_S}+?){p}({_S}+)\z"


def structure(text: Column) -> Column:
    """struct(headword, collocate, pattern, headword_pos, collocate_pos, confidence)."""

    def out(headword: Column, collocate: Column, pattern, head: str, col, confidence: int) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(
            headword.alias("headword"), collocate.alias("collocate"), lit(pattern).alias("pattern"), lit(head).alias("headword_pos"),
            lit(col).alias("collocate_pos"), F.lit(confidence).alias("confidence"),
        )

    part = lambda pattern, i: F.regexp_extract(text, pattern, i)
    both = lambda p: F.concat(F.lit(p), part(_particle(p), 2))
    suru = part(SURU, 1)
    rest = F.substring(text, F.length(suru) + 1, F.length(text))
    passive = F.regexp_replace(part(PASSIVE, 2), "^[わかされ]れ", "")
    stem = verb_base(F.concat(part(PASSIVE, 1), F.lit("れ")))
    causative = F.regexp_replace(text, r"させられ[^\n\r  ]*$", "")
    adjective = part(GA_ADJ, 2)
    adjective_pos = word_pos(adjective)
    na_head = part(NI, 1)
    adverb = part(ADV_V, 1)
    half = F.floor(F.length(text) / 2).cast("int")
    short = F.length(text) <= 3
    kana_head = _is(text, FALLBACK)
    headword = F.when(short, text).when(kana_head, part(FALLBACK, 1)).otherwise(F.substring(text, F.lit(1), half))
    collocate = F.when(short, "").when(kana_head, part(FALLBACK, 2)).otherwise(F.substring(text, half + 1, F.length(text)))
    pattern = F.when(short, "V").when(kana_head, "N+V").otherwise("phrase")
    return (
        F.when(
            _is(text, SURU),
            out(
                suru,
                F.concat(F.lit("する"), F.when(rest.startswith("する"), F.substring(rest, F.lit(3), F.length(rest))).otherwise(rest)),
                F.when(rest.contains("結果"), "N+する+N").otherwise("N+する"), NOUN, VERB, 30,
            ),
        )
        .when(_is(text, QUOTE), out(part(QUOTE, 1), F.concat(F.lit("と"), part(QUOTE, 2)), "Quote+と+V", EXPRESSION, VERB, 20))
        .when(
            _is(text, PASSIVE),
            out(
                F.when(stem == "", part(PASSIVE, 1)).otherwise(stem),
                F.concat(F.lit("passive"), F.when(passive.startswith("て"), F.concat(F.lit("+"), passive)).otherwise("")),
                F.when(passive.startswith("て"), F.concat(F.lit("V+passive+て"), F.substring(passive, F.lit(2), F.length(passive)))).otherwise("V+passive"),
                VERB, AUX, 25,
            ),
        )
        .when(text.contains("させられ"), out(F.when(causative == "", text).otherwise(causative), F.lit("させられる"), "V+causative+passive", VERB, AUX, 25))
        .when(_is(text, TEITA) & _is(part(TEITA, 1), TEITA_HEAD), out(part(TEITA, 1), part(TEITA, 2), "V+ていた", VERB, AUX, 20))
        .when(_is(text, TE_V), out(part(TE_V, 1), part(TE_V, 2), "V+て+V", VERB, VERB, 20))
        .when(
            _is(text, NI) & (na_head.isin(*L.NA_ADJECTIVES) | na_head.endswith("的")),
            out(na_head, both("に"), "naAdj+に+V", ADJ_NA, VERB, 30),
        )
        .when(
            _is(text, GA_ADJ) & ~_is(adjective, rf"[{VERB_END}]\z")
            & (adjective_pos.isin(ADJ_I, ADJ_NA) | adjective.isin(*L.NA_ADJECTIVES) | F.regexp_replace(adjective, r"(?:だ|です)\z", "").isin(*L.NA_ADJECTIVES)),
            out(part(GA_ADJ, 1), F.concat(F.lit("が"), adjective), "N+が+naAdj", NOUN, adjective_pos, 20),
        )
        .when(_is(text, ADV_V) & (F.length(adverb) >= 2) & _is(adverb, f"^(?:{_any(L.ADVERBS)})"), out(adverb, part(ADV_V, 2), "Adv+V", ADVERB, VERB, 20))
        .when(_is(text, _particle("の")), out(part(_particle("の"), 1), both("の"), "N+の+N", NOUN, NOUN, 15))
        .when(_is(text, _particle("を")), out(part(_particle("を"), 1), both("を"), "N+を+V", NOUN, VERB, 25))
        .when(_is(text, _particle("が")), out(part(_particle("が"), 1), both("が"), "N+が+V", NOUN, VERB, 25))
        .when(_is(text, NI), out(na_head, both("に"), "N+に+V", NOUN, VERB, 20))
        .otherwise(out(headword, collocate, pattern, NOUN, VERB, 10))
    )


def domains(text: Column, headword: Column, collocate: Column) -> Column:
    """Domain tags over the text and its parts; everyday if there is no other."""
    all_of = F.concat(text, headword, collocate)
    linguistic = _has(all_of, L.LINGUISTIC)
    tests = [
        (_has(all_of, L.ACADEMIC) | linguistic, "学術"),
        (linguistic, "言語学"),
        (_has(all_of, L.BODY), "身体"),
        (_has(all_of, L.EMOTION), "感情"),
        (_has(all_of, L.SLANG), "俗語"),
        (_has(all_of, L.DIALECT), "方言"),
        (all_of.contains("炎上") | (all_of.contains("消す") & all_of.contains("炎")), "比喩"),
    ]
    found = F.filter(F.array(*[F.when(test, F.lit(tag)) for test, tag in tests]), lambda x: x.isNotNull())
    return F.when(F.size(found) == 0, F.array(F.lit("日常"))).otherwise(found)


def frequency(text: Column, tags: Column, pattern: Column) -> Column:
    base = F.lit(50)
    for tag, value in (("俗語", 45), ("日常", 65), ("学術", 60), ("言語学", 55)):  # a later one wins
        base = F.when(F.array_contains(tags, tag), value).otherwise(base)
    base = F.when(pattern == "N+する", F.greatest(base, F.lit(70))).otherwise(base)
    base = F.when(pattern.contains("passive"), F.greatest(base, F.lit(60))).otherwise(base)
    base = F.when(F.length(text) <= 6, F.least(base + 10, F.lit(95))).otherwise(base)
    return F.least(F.greatest(base, F.lit(20)), F.lit(100))


def classify(df: DataFrame, column: str = "text") -> DataFrame:
    """Adds original_text, normalised_text, headword, collocate, full_phrase, headword_pos,
    collocate_pos, pattern, tags, notes, frequency and confidence."""
    # staged, so that each regular expression is evaluated in one place of the plan
    a = df.withColumn("original_text", trim(F.col(column)))
    text = F.col("original_text")
    a = a.withColumn("spoken", colloquial(text)).withColumn("register", register(text)).withColumn("parts", structure(text))
    spoken = F.size("spoken") > 0
    lead = F.array(F.when(spoken, F.lit("口語")), F.col("register"))
    found = domains(text, F.col("parts.headword"), F.col("parts.collocate"))
    a = a.withColumn("tags", F.array_distinct(F.concat(F.filter(lead, lambda x: x.isNotNull()), found)))
    return a.select(
        *df.columns,
        "original_text",
        normalise(text).alias("normalised_text"),
        "parts.headword",
        "parts.collocate",
        F.col("original_text").alias("full_phrase"),
        "parts.headword_pos",
        "parts.collocate_pos",
        "parts.pattern",
        "tags",
        F.when(spoken, F.concat(F.lit("口語形: "), F.array_join("spoken", ", "))).otherwise("").alias("notes"),
        frequency(text, F.col("tags"), F.col("parts.pattern")).cast("int").alias("frequency"),
        F.least(F.lit(95), F.lit(50) + F.col("parts.confidence")).alias("confidence"),
    )


def confidence_band(c: Column) -> Column:
    return F.when(c >= 70, "high").when(c >= 40, "medium").otherwise("low")
