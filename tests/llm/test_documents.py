"""The operators over documents: brute force, awkward rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from colex.llm import classifier, common, components, jaccard, mixture, packing, recompress, rules, secrets, substring
from colex.llm.common import Rolling, hash_words

from ..oracle import connect, rows
from . import data


@pytest.fixture(scope="module")
def docs(spark):
    return data.clashing(spark.createDataFrame(data.documents(), data.SCHEMA).repartition(3)).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def sql_rows(sql, table_rows):
    import pandas as pd

    con = connect("/nowhere")
    frame = pd.DataFrame(table_rows, columns=["doc_id", "text", "lang", "source", "n_chars"])
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    con.register("documents", frame)
    return rows(con.execute(sql).df())


# ---------------------------------------------------------------- substring, jaccard


def test_substring_against_all_windows(docs):
    found = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.dedup(docs).collect()]
    assert sorted(found, key=str) == data.substring_dedup(data.documents())


@pytest.mark.parametrize("window", [1, 2, 5, 19])
def test_substring_other_windows(spark, window):
    some = data.documents(seed=3, n=40)[:36]
    df = spark.createDataFrame(some, data.SCHEMA)
    found = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.dedup(df, window).collect()]
    assert sorted(found, key=str) == data.substring_dedup(some, window)


def thue_morse(n, zero, one):
    out = [zero]
    while len(out) < n:
        out += [one if x == zero else zero for x in out]
    return out[:n]


def test_runs_are_told_apart_by_a_prime_modulus():
    """Polynomials modulo a power of two are equal for these, whatever the base."""
    rng = np.random.default_rng(2)
    for n in (1024, 2048, 4096):
        a, b = thue_morse(n, "x", "y"), thue_morse(n, "y", "x")
        one, two, counts = hash_words([" ".join(["p"] * 7 + a + ["q"] * 3 + b + ["r"] + a).encode()])
        for h in (one, two):
            first = np.array([7, 10 + n, 11 + 2 * n])
            found = Rolling(h).of(first, first + n)
            assert found[0] == found[2] != found[1]
        one, two, _ = hash_words(["".join(a).encode(), "".join(b).encode()])
        assert one[0] != one[1] and two[0] != two[1]
    a, b = (rng.integers(0, int(common.PRIME), 1000, dtype=np.uint64) for _ in "ab")
    assert [int(x) for x in common.times(a, b)] == [int(x) * int(y) % int(common.PRIME) for x, y in zip(a, b, strict=True)]


@pytest.fixture(scope="module")
def twins():
    """Texts that share no window, but words or runs that a polynomial modulo 2**64 takes for equal."""
    out, rng = [], random.Random(12)
    for n in (1024, 2048, 4096):
        a, b = "".join(thue_morse(n, "a", "b")), "".join(thue_morse(n, "b", "a"))
        common_words = [f"c{n}{i}" for i in range(12)]
        out += [" ".join([*common_words, a, *common_words]), " ".join([*common_words, b, *common_words])]
        out.append(" ".join([f"z{rng.random()}" for _ in range(5)] + thue_morse(n, f"u{n}", f"v{n}")))
        out.append(" ".join(thue_morse(n, f"v{n}", f"u{n}")))
    out.append(" ".join([f"k{i}" if i % 4 else "".join(thue_morse(1024, "a", "b")) for i in range(27)]))
    out.append(" ".join([f"k{i}" if i % 4 else "".join(thue_morse(1024, "b", "a")) for i in range(27)]))
    return [(i, text, "en", "s", 0) for i, text in enumerate(out)]


def test_twins_are_not_taken_for_each_other(spark, twins):
    df = spark.createDataFrame(twins, data.SCHEMA).repartition(3)
    found = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.dedup(df).collect()]
    assert sorted(found, key=str) == data.substring_dedup(twins)
    links = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join_components(df).collect()]
    assert sorted(links, key=str) == data.jaccard(twins)


def test_anchors_depend_on_the_window_alone():
    rng = np.random.default_rng(5)
    for vocabulary in (2, 3, 40):
        h, _, _ = hash_words([" ".join(map(str, rng.integers(0, vocabulary, 900))).encode()])
        other, _, _ = hash_words([" ".join(map(str, rng.integers(0, vocabulary, 77))).encode()])
        joined = np.concatenate([other, h[100:700], other])
        whole = dict(zip(*recompress.anchors(h, np.zeros(len(h), int), Rolling(h), 20)[:2], strict=True))
        again = dict(zip(*recompress.anchors(joined, np.zeros(len(joined), int), Rolling(joined), 20)[:2], strict=True))
        assert all(whole[i] == again[i - 100 + len(other)] for i in range(100, 681))


def test_jaccard_against_all_pairs(docs):
    found = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join_components(docs).collect()]
    assert sorted(found, key=str) == data.jaccard(data.documents())


def test_jaccard_of_a_dense_group(spark):
    """Many near copies, of which some link only through others, and common shingles."""
    rng = np.random.default_rng(2)
    base = [f"b{i}" for i in range(120)]
    some = []
    for i in range(90):
        words = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 6)):
            words[at] = f"r{rng.integers(0, 10**6)}"
        some.append((i, " ".join(words), "en", "s", 0))
    found = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join_components(spark.createDataFrame(some, data.SCHEMA).repartition(5)).collect()]
    assert sorted(found, key=str) == data.jaccard(some)


def test_jaccard_splits_hot_lists(spark, monkeypatch):
    """Many unlike texts around one common passage, with pairs at the threshold, by lists of the later orders."""
    monkeypatch.setattr(jaccard, "LIST_PAIRS", 3)
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(60)]
    some = []
    for i in range(120):
        own = [f"o{i // 2}_{j}" for j in range(rng.choice([4, 12, 40, 80]))]
        if i % 2:
            own[rng.randrange(len(own))] = f"x{i}"
        some.append((i, " ".join(own[:2] + passage + own[2:]), "en", "s", 0))
    found = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join_components(spark.createDataFrame(some, data.SCHEMA).repartition(3)).collect()]
    assert sorted(found, key=str) == data.jaccard(some)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = set(rng.integers(0, 3000, 900).tolist())
        b = set(rng.integers(0, 3000, 700).tolist())
        x, y = (jaccard.parity(np.array(sorted(s), dtype=np.uint64)) for s in (a, b))
        assert sum(int(v).bit_count() for v in (x ^ y).view(np.uint64)) <= len(a ^ b)


@pytest.mark.parametrize("many", [0, components.MANY])
def test_components(spark, monkeypatch, many):
    monkeypatch.setattr(components, "MANY", many)
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(200, 260)] + [(5, 5)]
    found = {r["node"]: r["component"] for r in components.connect(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {n: c for n, c in data.components({n for e in edges if e[0] != e[1] for n in e}, edges).items()}
    assert components.connect(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- rules, mixture


def test_rules_against_sql(docs):
    out = rules.ledger(docs).withColumn("base_failed", rules.rejects(rules.BASE_POLICY)).withColumn("kept", ~rules.rejects(rules.CURRENT) & ~rules.rejects(rules.BASE_POLICY))
    names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept failed".split()
    assert rows(out.select(names).toPandas()) == sql_rows(rules.OP2_SQL, data.documents())


def test_policies_and_ablations_read_the_ledger(docs):
    book = rules.ledger(docs).cache()
    applied = rules.apply_policies(book).toPandas()
    for p in rules.POLICIES:
        assert applied[f"kept_{p.version}"].sum() == book.where(f"(failed & {p.mask}) = 0").count()
    assert rows(rules.ablations(book).toPandas()) == sql_rows(rules.ABLATIONS_SQL, data.documents())
    for r in rules.ablations(book).collect():
        mask = next(p.mask for p in rules.POLICIES if p.version == r["policy"])
        assert r["fails"] == book.where(f"(failed & {rules.BIT[r['rule']]}) <> 0").count()
        assert r["only"] == book.where(f"(failed & {mask}) = {rules.BIT[r['rule']]}").count()


def test_mixture_against_sorting(docs):
    out = mixture.mix(docs).select("doc_id", "size", "source_size", "target", "taken")
    assert rows(out.toPandas()) == sql_rows(mixture.OP9_SQL, data.documents())


def test_mixture_splits_rows_of_one_id(spark):
    """Sources without ids, with one id and of one row over and over end within a document of their targets."""
    texts = lambda k: " ".join(f"w{k}x{i}" for i in range(20))
    rows_ = [(None, texts(k), "en", "a", 0) for k in range(30)] + [(7, texts(k), "en", "b", 0) for k in range(25)] + [(8, texts(0), "en", "c", 0)] * 40
    df = spark.createDataFrame(rows_, data.SCHEMA).repartition(3)
    out = mixture.mix(df).toPandas()
    for _, some in out.groupby("source"):
        assert abs(some["taken"].sum() - some["target"].iloc[0]) <= 20
        assert (some["taken"] <= 2 * some["size"]).all()
    expected = sql_rows(mixture.OP9_SQL, rows_)
    assert rows(mixture.mix(df).select("doc_id", "size", "source_size", "target", "taken").toPandas().astype({"doc_id": "Int64"})) == expected


def test_secrets_of_a_long_text_take_linear_time():
    import time

    def took(n):
        text = "password = " + "a1" * 20_000 + " " + " ".join(f"login: bob{i} key {i}aB{'x7' * 12} http://h{i}.example/x AKIA{'A1' * 10}{i}" for i in range(n))
        began = time.perf_counter()
        spans = secrets.spans_of(text)
        return len(text), len(spans), time.perf_counter() - began

    took(100)
    size, found, seconds = took(12_000)
    assert size > 1_000_000 and found > 12_000 and seconds < 3


def test_mixture_meets_its_targets(spark, sf_dir):
    out = mixture.op9_mixture(spark, sf_dir).toPandas()
    assert (out["taken"] <= 2 * out["size"]).all()
    assert abs(out.groupby("source_size")["target"].first().sum() - 1.5 * out["size"].sum()) < 1e-6 * out["size"].sum()


def test_budgets_are_nested(docs):
    small, large = (mixture.mix(docs, share=s, weights=(1,)).select("doc_id", "size", "times").collect() for s in (0.3, 0.6))
    taken = {(r["doc_id"], r["size"]): r["times"] for r in large}
    assert all(r["times"] <= taken[r["doc_id"], r["size"]] for r in small)


# ---------------------------------------------------------------- packing


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer
    import public_tokenizers

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = packing.pack(docs).toPandas()
    expected = []
    for doc_id, text, *_ in data.documents():
        ids = np.array([*slow.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for s in range(0, len(ids), 1024):
            expected.append((doc_id, s, min(1024, len(ids) - s), zlib.crc32(ids[s : s + 1024].tobytes()), len(ids)))
    found = [(None if np.isnan(r.doc_id) else int(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out.itertuples()]
    assert sorted(found, key=str) == sorted(expected, key=str)
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1].tolist()] and g["length"].sum() <= 1024


def test_a_text_the_fast_encoder_gives_up_on():
    text = "a" + " " * 2_000_000 + "b"
    ids = packing.encoder()(text)
    assert len(ids) >= 3 and ids[0] == packing.encoder()("a")[0]


def test_added_tokens_have_their_own_ids(spark):
    """The ids of the tokenizer as it is loaded."""
    from tokenizers import Tokenizer
    import public_tokenizers

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>  y", "<|endoftext|", "a <|ENDOFTEXT|> b", "<|endoftext|>" + " word" * 3000]
    assert packing.encoder()(texts[0]) == [64, 220, 50256, 275]
    assert [packing.encoder()(t) for t in texts] == [slow.encode(t, add_special_tokens=False).ids for t in texts]
    rows_ = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("start = 0").collect()
    for r in rows_:
        ids = np.array([*slow.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0], dtype="<u4")
        assert (r["doc_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids[:1024].tobytes()))


def test_patterns_fill_their_sequences():
    rng = np.random.default_rng(4)
    kinds = np.clip(np.exp(rng.normal(4, 0.9, 4000)).astype(int), 1, 255)
    histogram = {int(k): int(n) for k, n in zip(*np.unique(kinds, return_counts=True), strict=True)}
    slots = packing.plan(histogram)
    room = {}
    for s in slots:
        for i in range(s.low, s.high):
            at = s.base + (i - s.low) // s.each
            room[at] = room.get(at, 0) + s.kind
    assert sum(s.high - s.low for s in slots) == sum(histogram.values()) and max(room.values()) <= 256
    assert len(room) <= 1.01 * sum(k * n for k, n in histogram.items()) / 256 + 2
    assert packing.plan({}) == [] and packing.plan({256: 3})[0].high == 3


def test_padding_of_a_whole_table(spark):
    out = packing.op1_packing(spark, "/root/testdata/sf0.01").toPandas()
    used = out.groupby("sequence_id")["length"].sum()
    assert used.max() <= 1024 and 1024 * len(used) - used.sum() <= 0.005 * 1024 * len(used) + 2 * 1024


# ---------------------------------------------------------------- secrets


TEXTS = [
    "password=abcdefg", "PASSWORD : 'abc12345'", "secret=token: abcdefg", "token=abc", "api_key = \"x/y+z=1\" apikey:qwertyu", "AKIA" + "A" * 16, "AKIAB", "AKIAAKIA" + "Z1" * 9,
    "f" * 24 + " " + "0123456789abcdef01234567", "a" * 23, "ſecret=abcdefgh paſſword=abcdefgh", "pass word=abcdefg passwd=日本abcdef", "token = '" + "ab12" * 10 + "'", None, "",
    "AKIA" + "Q" * 16 + " then aB3" + "xY9z" * 9 + " end", "aB3" + "xY9z" * 9 + " alone", "login=someone password=hunter22 at 10.0.0.1:8080 and http://h.example/x",
    "login=someone at 10.0.0.1 and http://h.example/x", "😀" * 5 + "password=abcdefg",
]


def plain_spans(text):
    kinds = [
        (0, re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 6),
        (1, re.compile("AKIA[A-Z0-9]+"), 20),
        (2, re.compile("[0-9a-f]+"), 24),
    ]
    return sorted((m.start(), k, m.end()) for k, p, least in kinds for m in p.finditer(text or "") if len(m[2] if k == 0 else m[0]) >= least)


def test_base_spans_are_the_plain_matches(docs):
    for text in TEXTS + [r[1] for r in data.documents()[:40]]:
        assert secrets.base_spans(text or "") == plain_spans(text)
        assert [s for s in secrets.spans_of(text) if s[1] < secrets.BASE] == plain_spans(text)


def test_weak_parts_need_a_complement():
    kinds = lambda t: {secrets.KINDS[k] for _, k, _ in secrets.spans_of(t)}
    assert "linked_secret" in kinds(TEXTS[15]) and not kinds(TEXTS[16])
    assert {"linked_account", "linked_endpoint"} <= kinds(TEXTS[17]) and not kinds(TEXTS[18])
    assert "linked_endpoint" not in kinds("password=abcdefg " + "x " * 300 + "http://h.example/x")
    assert "hunter22" not in secrets.redact(TEXTS[17]) and secrets.redact("clean") == "clean" and secrets.redact(None) is None


def linked(text, scope):
    """The linking rules over all pairs and triples of parts."""
    base = plain_spans(text)
    near = lambda a, b: a[0] - scope <= b[1] and b[0] <= a[1] + scope
    cross = lambda a, b: a[0] < b[1] - 1 and b[0] < a[1] - 1
    weak = {
        kind: [m.span() for m in re.finditer(p, text, flags) if not any(cross(m.span(), (s, e)) for s, _, e in base)]
        for kind, p, flags in (
            ("endpoint", r"(?:[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]+|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?:\:\d{1,5})?(?![\d.]))", 0),
            ("account", r"(?<![A-Za-z0-9])(?:user(?:name)?|login|account)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@+-]{3,})", re.I | re.A),
            ("secret", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])", 0),
        )
    }
    weak["secret"] = [(s, e) for s, e in weak["secret"] if re.search("[0-9]", text[s:e]) and re.search("[a-z]", text[s:e])]
    assign, access, runs = ([(s, e) for s, k, e in base if k == kind] for kind in range(3))
    others = weak["endpoint"] + weak["account"]
    touch = lambda a, b: a[0] <= b[1] and b[0] <= a[1]
    apart = [t for t in weak["secret"] if not any(touch(t, o) for o in others)] + runs
    whole = [t for t in apart if any(near(t, a) for a in weak["account"]) and any(near(t, e) for e in weak["endpoint"])]
    beside = [t for t in weak["secret"] if any(near(t, a) for a in access)]
    out = [("linked_secret", t) for t in {*beside, *whole} - {*runs}]
    out += [("linked_endpoint", p) for p in weak["endpoint"] if any(near(p, t) for t in assign + beside + whole)]
    out += [("linked_account", p) for p in weak["account"] if any(near(p, t) for t in assign + whole)]
    return sorted((s, secrets.KINDS.index(kind), e) for kind, (s, e) in out)


def part_texts(n=400):
    rng = random.Random(5)
    token = lambda k: "".join(rng.choice("abcXYZ0189_-") for _ in range(k))
    parts = [
        lambda: f"login: {token(6)}", lambda: "user=bob", lambda: "AKIA" + "Q7" * 9, lambda: token(rng.choice([19, 20, 40, 300])), lambda: "0a1b" * rng.choice([5, 6, 16]), lambda: "https://h.example/" + token(30),
        lambda: f"10.2.3.{rng.randrange(99)}:5432", lambda: f"password={token(9)}", lambda: "account: " + token(25), lambda: "words " * rng.randrange(60), lambda: "é😀 " * 3,
    ]
    return [" ".join(rng.choice(parts)() for _ in range(rng.randrange(14))) for _ in range(n)]


def test_linked_spans_against_all_pairs():
    kinds = set()
    for text in TEXTS + part_texts():
        for scope in (0, 30, secrets.SCOPE):
            found = secrets.spans_of(text, scope)
            assert found == sorted(plain_spans(text) + linked(text or "", scope)), text
            kinds |= {k for _, k, _ in found}
    assert kinds == set(range(len(secrets.KINDS)))


def test_three_weak_parts_make_a_credential():
    text = "login: deploy_bot host 10.2.3.4:5432 key Zx81" + "aQ0" * 80
    assert [secrets.KINDS[k] for _, k, _ in secrets.spans_of(text)] == ["linked_account", "linked_endpoint", "linked_secret"]
    assert not secrets.spans_of(text.replace("login", "log")) and not secrets.spans_of(text.replace("10.2.3.4", "10.2.3"))
    commit = "user: bob at http://h.example/ has " + "0a" * 20
    assert {secrets.KINDS[k] for _, k, _ in secrets.spans_of(commit)} == {"hex", "linked_account", "linked_endpoint"}


def test_scan_columns(spark):
    texts = TEXTS + part_texts(60)
    df = data.clashing(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    names = "assign access hex linked_endpoint linked_account linked_secret".split()
    listed = lambda spans: ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)
    for r in secrets.scan(df).collect():
        base = plain_spans(texts[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in base) for i in range(3)]
        assert r["base_sha256"] == hashlib.sha256(listed(base).encode()).hexdigest()
        assert r["spans"] == listed(sorted(base + linked(texts[r["doc_id"]] or "", secrets.SCOPE)))


# ---------------------------------------------------------------- classifier


def test_classifier_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    out = classifier.op8_classifier(spark, folder).toPandas()
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas().merge(out, on="doc_id")
    assert [zlib.crc32(str(i).encode()) % 3 == 1 for i in out["doc_id"]] == out["held_out"].tolist()
    held = labels[labels["held_out"]]
    assert (held["quality"] == held["predicted"]).mean() > 0.97
    assert out["score"].between(0, 1).all() and ((out["score"] >= 0.5) == (out["predicted"] == 1)).all()


def test_scores_against_a_plain_discriminant(docs, spark):
    """Two Gaussians, from all training rows at once, by solving and determinants."""
    table_rows = data.documents()
    known = {i: i % 3 % 2 for i in range(55)}
    labels = spark.createDataFrame(list(known.items()), "doc_id long, quality int")
    x = np.array([classifier.statistics(r[1]) for r in table_rows])
    train = [(k, known[r[0]]) for k, r in enumerate(table_rows) if r[0] in known and zlib.crc32(str(r[0]).encode()) % 3 != 1]
    groups = [x[[k for k, q in train if q == label]] for label in (0, 1)]
    own = [np.cov(g.T, bias=True) for g in groups]
    both = sum(len(g) * c for g, c in zip(groups, own, strict=True)) / len(train)
    density = []
    for g, c in zip(groups, own, strict=True):
        cov = (1 - classifier.POOLED - classifier.RIDGE) * c + classifier.POOLED * both + classifier.RIDGE * np.eye(x.shape[1])
        z = x - g.mean(axis=0)
        density.append(np.log(len(g) / len(train)) - 0.5 * ((z * np.linalg.solve(cov, z.T).T).sum(axis=1) + np.linalg.slogdet(cov)[1]))
    expected = 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / classifier.TEMPERATURE, -700, 700)))
    found = [(str(r["doc_id"]), r["score"]) for r in classifier.classify(docs, labels).collect()]
    expected = [(str(r[0]), s) for r, s in zip(table_rows, expected, strict=True)]
    for (i, a), (j, b) in zip(sorted(found), sorted(expected), strict=True):
        assert i == j and abs(a - b) < 1e-9


def test_labels_outside_training_change_nothing(docs, spark):
    some = [(i, i % 2) for i in range(40)]
    more = [(i, 1 - q) if zlib.crc32(str(i).encode()) % 3 == 1 else (i, q) for i, q in some] + [(None, 1), (2, None), (999, 1)]
    a, b = (classifier.classify(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (some, more))
    key = lambda df: sorted((str(r["doc_id"]), round(r["score"], 9)) for r in df.collect())
    assert key(a) == key(b)


def test_classifier_without_labels(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in classifier.classify(docs, none).collect()} == {0.5}


# ---------------------------------------------------------------- empty tables


def test_empty_tables(empty, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for df in (
        substring.dedup(empty), jaccard.join_components(empty), rules.ledger(empty), mixture.mix(empty), packing.pack(empty), secrets.scan(empty), classifier.classify(empty, labels)
    ):
        assert df.count() == 0
