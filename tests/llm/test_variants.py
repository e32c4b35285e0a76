"""Spelling variants against SQL and brute force, in rounds of small filters, on awkward rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from colex.llm import variants as V
from colex.llm.common import materialise

from ..oracle import connect, rows
from . import data


def documents():
    rng = random.Random(6)
    stems = ["".join(rng.choice("abcdeé") for _ in range(rng.choice([6, 7, 8, 9, 12]))) for _ in range(30)]
    texts = []
    for i in range(60):
        words = []
        for _ in range(rng.choice([3, 60, 150])):
            w = list(stems[min(int(rng.expovariate(0.2)), 29)])
            if rng.random() < 0.2:
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = rng.choice(["", "a", "ÿ", "É", "bb"])
            words.append("".join(w).upper() if rng.random() < 0.1 and "é" not in w else "".join(w))
        texts.append((i, rng.choice([" ", ", ", "1"]).join(words)))
    texts[7] = (7, None)
    texts[8] = (8, "")
    texts[9] = (9, " \t\n 12345 — 𠮷野家 ＡＢＣＤＥＦＧ ")
    texts[10] = (10, "x" * 3000 + " " + "x" * 3001 + " Ÿstanbul × ÷ İstanbul")
    texts[11] = (11, "x" * 3000 + " " + "x" * 3001 + " aaaaaaa aaaaaaa aaaaaaaa aaaaaaaa aaaaaab")
    texts += [texts[0], (0, texts[1][1]), (None, texts[2][1]), (None, None)]
    return [(i, t, "en", "s", 0) for i, t in texts]


def brute(some):
    counts = Counter()
    for doc_id, text, *_ in some:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            counts[run if h % 31 else run[:at] + run[at + 1 :]] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, form = [], {}
    for w in n:
        close = [x for x in n if x != w and near(w, x)]
        best = min(close, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
        out.append((w, len(close)))
    for w, close in out:
        root = w
        while form[root] is not None:
            root = form[root]
        yield (form[w], n.get(form[w]), n[w], close, root, w)


@pytest.fixture(scope="module")
def some():
    return documents()


def found(df):
    return rows(V.group(df).toPandas().astype({"form_n": "Int64"}))


def test_group_against_brute_force(spark, some):
    expected = sorted(brute(some), key=lambda r: [(v is None, str(v)) for v in r])
    df = data.clashing(spark.createDataFrame(some, data.SCHEMA).repartition(3))
    assert found(df) == expected
    assert sum(r[0] is not None for r in expected) > 10


def test_group_against_sql(spark, some):
    con = connect("/nowhere")
    con.register("documents", pd.DataFrame(some, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64"}))
    assert found(spark.createDataFrame(some, data.SCHEMA)) == rows(con.execute(V.OP13_SQL).df().astype({"form_n": "Int64"}))


def test_rounds_of_few_shards(spark, some):
    words = materialise(V.vocabulary(spark.createDataFrame(some, data.SCHEMA)), "words")
    whole = sorted(V.near_pairs(words).collect())
    assert sorted(V.near_pairs(words, size=3, round_bytes=400).collect()) == whole
    assert len(whole) > 20


def test_chains_end_at_their_last_form(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(18)]
    assert {r["root"] for r in V.roots(spark.createDataFrame(forms, "word string, form string")).collect()} == {"w18"}


def test_filters_know_all_words_and_few_others():
    rng = np.random.default_rng(1)
    words = np.unique(rng.choice(V.LETTERS, (20_000, 9)), axis=0)
    key = (V._LETTER[words] * V._powers(9)).sum(axis=1, dtype=np.uint64)
    blocks = V.blocks_of(len(words) // 2)
    block, mask = V.marks(key[::2][: len(words) // 2], blocks)
    bits = np.zeros(blocks, np.uint64)
    np.bitwise_or.at(bits, block, mask)
    known = V.Round({(9, 0): bits.tobytes()}, {9: len(words) // 2})
    assert len(known.known(key[::2][: len(words) // 2], 9)) == len(words) // 2
    assert len(known.known(key[1::2], 9)) < 0.005 * len(key)


def test_empty_table(spark):
    assert V.group(spark.createDataFrame([], data.SCHEMA)).collect() == []
