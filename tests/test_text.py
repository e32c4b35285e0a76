"""Kernel vectors and properties, each against an independent statement in plain Python."""

import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colex.functions import text as T

WORDS = st.text(alphabet="かきくカキガ風吹 aАkshi　Ａ１ーッ𠮷\n", max_size=8)


def column(spark, values, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select(build(F.col("v")).alias("o"), "i").orderBy("i").collect()]


def greedy(text):
    out, rest = "", text.lower()
    while rest:
        for n in range(min(4, len(rest)), 0, -1):
            if rest[:n] in T.ROMAJI:
                out, rest = out + T.ROMAJI[rest[:n]], rest[n:]
                break
        else:
            out, rest = out + rest[0], rest[1:]
    return out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_the_table_has_132_syllables_and_its_gaps():
    assert len(T.ROMAJI) == 132
    assert not {"hu", "dzu", "bba", "sshi", "tcha"} & set(T.ROMAJI)


@settings(max_examples=8, deadline=None)
@given(st.lists(WORDS, min_size=1, max_size=20))
def test_kernel_against_plain_python(spark, values):
    assert column(spark, values, T.normalize_japanese) == [unicodedata.normalize("NFKC", v) for v in values]
    assert column(spark, values, T.romaji_to_hiragana) == [greedy(v) for v in values]
    assert column(spark, values, T.to_hiragana) == [v.translate({c: c - 0x60 for c in range(0x30A1, 0x30F7)}) for v in values]
    other = values[0]
    expected = [1.0 if not max(len(v), len(other)) else 1 - distance(v, other) / max(len(v), len(other)) for v in values]
    assert column(spark, values, lambda c: T.similarity(c, F.lit(other))) == expected


def test_vectors(spark):
    assert column(spark, ["ＡＢＣ　ｶﾞ①"], T.normalize_japanese) == ["ABC ガ1"]
    assert column(spark, ["shinbun", "hu", "zasshi", "matcha"], T.romaji_to_hiragana) == ["しんぶん", "hう", "ざsし", "まtちゃ"]
    assert column(spark, ["食べる"], T.verb_forms)[0] == "食べる 食べます 食べない 食べて 食べた 食べれる 食べられる 食べよう 食べば 食べります 食べらない 食べって 食べった 食べれば".split()
    assert column(spark, [None], T.to_hiragana) == [None]
    assert column(spark, ["　x 　"], T.trim) == ["x"]
    for q in ("高い", "書く", "食べる", "風", ""):
        assert T.expand_search_text(q) == column(spark, [q], T.expand_search)[0]


def test_running_starts_and_trim(spark):
    from itertools import accumulate

    rows = [[], None, [3], [0, 0, 5], list(range(64)), list(range(65)), list(range(1000))]
    out = spark.createDataFrame([(r,) for r in rows], "a array<int>").select("a", T.running_starts(F.col("a")).alias("s")).collect()
    for r in out:
        assert r.s == (None if r.a is None else [0, *accumulate(r.a)][: len(r.a)])
    texts = ["  a b　", "", "　﻿ ", "x", None, "\n\t a  \U0001f600 \r", "​ y"]
    found = spark.createDataFrame([(t,) for t in texts], "s string").select("s", T.trim(F.col("s")).alias("t")).collect()
    for r in found:
        assert r.t == (None if r.s is None else r.s.strip(T.SPACE_CHARS))
    assert [r.t for r in found] == ["a b", "", "", "x", None, "a  \U0001f600", "​ y"]
