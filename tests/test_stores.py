"""Archives, the dictionary store, streams, deltas, posting blocks, the fuzzy index, places of rows in files."""

import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from colex.operators import fuzzy_index, postings
from colex.operators import search as S
from colex.operators import store as K
from colex.operators.dictionary_store import DictionaryStore
from colex.plans import fixtures as fx
from colex.plans import schemas as A
from colex.plans.commits import Commits, Conflict, children
from colex.plans.shared import shared_path
from colex.sources import archives
from colex.sources import dictionary_bank as Z
from colex.sources import lexicon as I
from colex.streaming import history
from colex.streaming.deltas import DeltaStore


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# ------------------------------------------------------------------ archives


def test_archive_rows_equal_those_of_whole_archives(spark, sf_dir):
    d = documents(spark, sf_dir)
    terms, dicts = A.terms_from_documents(d).where("dictionary IS NOT NULL"), A.dictionaries_from_documents(d)
    files = Z.bank_files(Z.term_cells(terms), "term", 50).unionByName(Z.index_files(dicts))
    path = shared_path(spark, "archives")
    assert archives.write_archives(files, path) == dicts.count()
    rows = archives.read_rows(spark, path, split=1)
    whole = Z.parse_terms(Z.read_archives(spark, path))
    found = Z.parse_terms(rows)
    key = ["dictionary", "term", "reading", "row_ord", F.to_json("definitions").alias("d")]
    assert sorted(map(tuple, found.select(*key).collect())) == sorted(map(tuple, whole.select(*key).collect()))
    assert rows.rdd.getNumPartitions() == files.count()  # a member a task
    assert archives.read_rows(spark, path).rdd.getNumPartitions() < files.count()  # small ones together


def test_members_of_every_kind(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("index.json", '{"title": "T"}')
        z.writestr("term_bank_1.json", json.dumps([["風", "かぜ", "n", "", 1, ["wind\n"], 1, ""], 5, None]), zipfile.ZIP_DEFLATED)
        z.writestr("note.txt", "no json")
        z.writestr("folder/", "")
        z.writestr("empty.json", "")
        z.writestr("list.json", "[]")
    found = {(r["name"], r["at"], r["row"]) for r in archives.read_rows(spark, str(tmp_path)).collect()}
    assert found == {("index.json", -1, '{"title": "T"}'), ("term_bank_1.json", 0, '["風","かぜ","n","",1,["wind\\n"],1,""]'), ("term_bank_1.json", 1, "5"), ("term_bank_1.json", 2, "null")}
    assert [r["term"] for r in Z.parse_terms(archives.read_rows(spark, str(tmp_path / "a.zip"))).collect()] == ["風"]
    (tmp_path / "none").mkdir()
    assert archives.read_rows(spark, str(tmp_path / "none")).collect() == []
    with zipfile.ZipFile(tmp_path / "b.zip", "w", zipfile.ZIP_BZIP2) as z:
        z.writestr("x.json", "[1]")
    with pytest.raises(ValueError, match="method"):
        archives.ArchiveReader(str(tmp_path / "b.zip")).partitions()


# ------------------------------------------------------------------ the dictionary store


@pytest.fixture
def store(spark, sf_dir):
    d = documents(spark, sf_dir)
    terms, titles = A.terms_from_documents(d), A.dictionaries_from_documents(d).select("title", F.lit(3).alias("format"), F.lit("1").alias("revision"))
    kanji = Z.parse_kanji(Z.from_map(spark, fx.BANKS))
    out = DictionaryStore(spark, shared_path(spark, "dictionaries"), rows_a_file=20)
    out.import_dictionaries(terms, kanji, titles, 1)
    return out, terms, titles


def counts(store):
    return {r["dictionary"]: r["count"] for r in store.table("terms").groupBy("dictionary").count().collect()}


def files_of(store):
    from pathlib import Path

    return {str(f): f.stat().st_mtime_ns for f in Path(store.path.removeprefix("file://")).rglob("*.parquet")}


def test_failed_import_leaves_the_old_title_whole(store):
    s, terms, titles = store
    before, files, dicts = counts(s), files_of(s), sorted(map(tuple, s.dictionaries().collect()))

    def lost():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        s.import_dictionaries(terms.limit(1), s.table("kanji"), titles, 2, lost)
    assert counts(s) == before and sorted(map(tuple, s.dictionaries().collect())) == dicts
    assert files.items() <= files_of(s).items()
    assert s.vacuum() == 1 and files_of(s) == files


def test_replace_and_delete_touch_one_title(store, spark):
    s, terms, titles = store
    before, files = counts(s), files_of(s)
    one, two = sorted(before)[:2]
    new = terms.where(F.col("dictionary") == one).limit(1)
    kanji = Z.parse_kanji(Z.from_map(spark, fx.BANKS)).withColumn("dictionary", F.lit(one))
    s.import_dictionaries(new, kanji, titles.where(F.col("title") == one), 7)
    assert counts(s) == before | {one: 1}
    assert files.items() <= files_of(s).items()
    assert s.lookup("kanji", "風").count() == 1
    s.import_dictionaries(new, kanji.limit(0), titles.where(F.col("title") == one), 8)
    assert s.lookup("kanji", "風").count() == 0  # kanji of the replaced title go with it
    s.delete(two, "none such")
    left = {k: v for k, v in (before | {one: 1}).items() if k != two}
    assert counts(s) == left and two not in {r["title"] for r in s.dictionaries().collect()}
    s.compact()
    assert counts(s) == left and s.vacuum() == 3
    assert {r["title"]: r["imported_at"] for r in s.dictionaries().collect()}[one] == 8
    s.clear()
    assert s.table("terms").count() == 0 == s.dictionaries().count() == s.prefix("terms", "a").count()


def test_lookups_open_few_files(store):
    s, terms, _ = store
    known = terms.where("dictionary IS NOT NULL")
    for kind, column, prefix in (("terms", "term", "Th"), ("readings", "reading", "an")):
        whole = sum(map(len, s.files(kind, "", "\U0010ffff").values()))
        met = sum(map(len, s.files(kind, prefix, prefix + "\U0010ffff").values()))
        assert 0 < met <= 2 + whole // 2 and whole >= 8
        expected = sorted(r["row_ord"] for r in known.where(F.col(column).startswith(prefix)).collect())
        assert sorted(r["row_ord"] for r in s.prefix(kind, prefix).collect()) == expected
    assert s.lookup("terms", "no such term").count() == 0


def test_commits_are_taken_once(spark):
    commits = Commits(spark, shared_path(spark, "commits"))
    assert commits.read() == (-1, {})
    commits.write(0, {"a": "é"})
    with pytest.raises(Conflict):
        commits.write(0, {"a": "b"})
    assert commits.read() == (0, {"a": "é"}) and commits.numbers() == [0]


# ------------------------------------------------------------------ streams


def test_an_import_works_its_rows_out_once(spark, store, monkeypatch):
    """Both orders, counts and ranges come from one evaluation of what is imported, and files are as fine as their bytes ask."""
    _, terms, titles = store
    terms, seen = terms.where("dictionary IS NOT NULL").localCheckpoint(), spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counting(x):
        seen.add(1)
        return x

    monkeypatch.setattr("colex.operators.dictionary_store.FILE_BYTES", 2_000)
    s = DictionaryStore(spark, shared_path(spark, "once"))
    s.import_dictionaries(terms.withColumn("term", counting("term")), spark.createDataFrame([], A.KANJI), titles, 1)
    assert seen.value == terms.count() == s.table("terms").count()
    assert len(s.files("terms", "", "\U0010ffff")[next(iter(s._live()))]) > 3
    version = next(iter(s._live()))
    assert "staged" not in children(spark, f"{s.path}/data/{version}")
    for kind in ("terms", "readings"):
        assert sorted(r[0] for r in s.table(kind).select("row_ord").collect()) == sorted(r[0] for r in terms.select("row_ord").collect())


def test_history_keeps_a_bounded_list_and_forgets(spark):
    source, target = shared_path(spark, "log"), shared_path(spark, "recent")
    schema = "query string, ts timestamp, ord long"
    stamp = lambda x: F.timestamp_seconds(F.lit(1_700_000_000) + x)

    def run(rows, **options):
        rows.write.mode("append").parquet(source)
        history.keep_history(history.most_recent(spark.readStream.schema(schema).parquet(source), limit=5, slots=2, **options), target, f"{target}-at").awaitTermination()
        return [r["query"] for r in history.recent(spark, target, 5).collect()]

    ids = spark.range(40)
    first = run(ids.select(F.concat(F.lit("q"), F.col("id") % 20).alias("query"), stamp(F.col("id")).alias("ts"), F.col("id").alias("ord")), retention="1 hour").copy()
    assert first == ["q19", "q18", "q17", "q16", "q15"]
    assert spark.read.parquet(target).where("query IS NOT NULL").count() <= 10  # two slots of five
    # an earlier event changes nothing, a blank one is none; a much later one lets the timers take out the rest
    assert run(spark.createDataFrame([("q15", 0, 0), (" ", 99, 0)], "query string, s long, ord long").select("query", stamp(F.col("s")).alias("ts"), "ord"), retention="1 hour") == first
    last = run(spark.createDataFrame([("new", 90_000, 100)], "query string, s long, ord long").select("query", stamp(F.col("s")).alias("ts"), "ord"), retention="1 hour")
    assert last[0] == "new" and len(last) < 5 or last == ["new"]
    history.clear_history(spark, target)
    assert history.recent(spark, target).collect() == []


def test_deltas_touch_their_buckets_only(spark):
    schema = "id string, v int, ord long"
    store = DeltaStore(spark, shared_path(spark, "deltas"), schema, buckets=8)
    rng, model, born = random.Random(5), {}, {}
    for n in range(6):
        rows = [(f"i{rng.randrange(30)}", n * 100 + k, k) for k in range(rng.choice([1, 3, 20]))]
        if n == 3:
            store.delete(spark.createDataFrame([(r[0],) for r in rows], "id string"), n)
            for r in rows:
                model.pop(r[0], None)
        else:
            store.upsert(spark.createDataFrame(rows, schema), n)
            fresh = [r for r in rows if r[0] not in model]
            born |= {i: (n, min(r[2] for r in fresh if r[0] == i)) for i in {r[0] for r in fresh}}
            model |= {r[0]: r[1] for r in rows}
        wanted = {r[0] for r in spark.createDataFrame([(r[0],) for r in rows], "id string").select(store._bucket()).collect()}
        assert set(store.touched(n)) == wanted
        if n in (2, 4):
            old = dict(store.state()["base"])
            folded = store.compact()
            assert {b: v for b, v in store.state()["base"].items() if int(b) not in folded} == {b: v for b, v in old.items() if int(b) not in folded}
            store.vacuum()
        found = store.read().orderBy("ord").collect()
        assert [(r["id"], r["v"]) for r in found] == [(i, model[i]) for i in sorted(model, key=lambda i: born[i])]
    some = spark.createDataFrame([("i3",), ("none",)], "id string")
    assert {r["id"] for r in store.read(some).collect()} == {"i3"} & set(model)
    assert DeltaStore(spark, shared_path(spark, "none"), schema).read().collect() == []


# ------------------------------------------------------------------ indexes


def test_postings_equal_a_rebuild(spark):
    rng = random.Random(9)
    schema = "id string, ord long, tags array<string>"
    rows = {f"i{n}": (f"i{n}", n, rng.sample("abcdefgh", rng.randrange(4)) + ["all"] * (n % 3 > 0)) for n in range(300)}
    blocks = postings.build(spark.createDataFrame(list(rows.values()), schema), "tags", 20)
    for _ in range(3):
        gone, changed = rng.sample(sorted(rows), 12), rng.sample(sorted(rows), 30)
        before = [rows[i] for i in {*gone, *changed}]
        after = [(i, rows[i][1], rng.sample("abcdefghij", 2)) for i in changed if i not in gone]
        rows = {i: r for i, r in rows.items() if i not in gone} | {r[0]: r for r in after}
        delta = postings.changes(spark.createDataFrame(before, schema), spark.createDataFrame(after, schema), "tags")
        new = spark.createDataFrame(postings.maintain(blocks, delta, 20).collect(), blocks.schema)
        whole = postings.build(spark.createDataFrame(list(rows.values()), schema), "tags", 20)
        assert sorted(map(str, new.collect())) == sorted(map(str, whole.collect()))
        assert new.agg(F.max(F.size("postings"))).first()[0] <= 20
        blocks = new
    assert [r["id"] for r in postings.lookup(blocks, "all").collect()] == [i for i, r in sorted(rows.items(), key=lambda x: x[1][1]) if "all" in r[2]]


def test_fuzzy_index_gives_the_same_rows_of_few_candidates(spark, sf_dir):
    lex = A.lexicon_from_part(spark.read.parquet(f"{sf_dir}/part.parquet")).unionByName(I.seed(spark)).cache()
    index = fuzzy_index.build(lex)
    for query in ("smal rong", "widgit", "ring", "gaskt", "風が吹く", "kaze ga", "blue bolt", "xyzw", "かぜ", "風を吹け", "ri", "ECONOMI", "Brand#1", "s*l", "", "x"):
        options = S.SearchOptions(query, max_results=None)
        found = fuzzy_index.search(lex, index, options)
        assert [(r["id"], r["score"]) for r in found.collect()] == [(r["id"], r["score"]) for r in S.search(lex, options).collect()], query
    n = lex.count()
    assert fuzzy_index.candidates(index, "smal rong").count() < n / 2  # a third of the names are small something
    assert fuzzy_index.candidates(index, "widgit").count() < n / 3


# ------------------------------------------------------------------ places in files


def test_place_in_the_file_whatever_the_splits(spark, tmp_path):
    lines = [json.dumps({"id": f"i{n}", "headword": "x" * (n % 50)}) for n in range(500)]
    (tmp_path / "a.json").write_text("\n".join(lines[:350]) + "\n\n")
    (tmp_path / "b.json").write_text("\n".join([*lines[350:400], "{broken", *lines[400:]]))
    expected = {f"i{n}": n for n in range(500)}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("900b", "5k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            assert {r["id"]: r["ord"] for r in I.read_lexicon(spark, str(tmp_path)).collect()} == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "array.json").write_text("[" + ",".join(lines) + "]")
    assert {r["id"]: r["ord"] for r in I.read_lexicon(spark, str(tmp_path / "one")).collect()} == expected


def test_word_lists(spark):
    df = spark.createDataFrame([(1, " 風, 夢 ,,風, 雨 降り , "), (2, ""), (3, None)], "n int, text string")
    assert [tuple(r) for r in K.word_lists(df, "n").collect()] == [(1, 0, "風"), (1, 1, "夢"), (1, 2, "雨 降り")]
    assert [tuple(r) for r in K.word_list(spark, " 風, 夢 ,,風").collect()] == [(0, "風"), (1, "夢")]


# ------------------------------------------------------------------ catalogues of any size


@pytest.mark.parametrize("most", [64_000_000, 20_000])
def test_catalogue_file_matches_as_the_built_in_one(spark, most):
    from colex.operators import patterns as Y
    from colex.queries import _CORPUS

    path = shared_path(spark, "catalogue")
    rows = [(i, s.family, s.expression, s.head, s.collocate, s.pattern, s.label, s.head_pos, s.collocate_pos, s.confidence) for i, s in enumerate(Y.SPECS)]
    spark.createDataFrame(rows, Y.SPEC_FILE).write.json(path)
    texts = _CORPUS.fixture.spark(spark).unionByName(spark.createDataFrame([(98, None), (99, "")], "n int, text string"))
    for best in (False, True):
        found = Y.extract_by_catalogue(texts, "n", Y.read_catalogue(spark, path), best_only=best, most=most)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, Y.extract_patterns(texts, "n", best_only=best).collect()))


def test_empty_catalogue(spark):
    from colex.operators import patterns as Y

    path = shared_path(spark, "catalogue")
    spark.createDataFrame([], Y.SPEC_FILE).write.json(path)
    assert Y.extract_by_catalogue(spark.createDataFrame([(1, "x")], "n int, text string"), "n", Y.read_catalogue(spark, path)).collect() == []


def test_paths_of_any_length_and_cycles(spark):
    from colex.operators import discourse as G

    edges = [("g", i, i, i + 1, f"t{i}") for i in range(14)] + [("g", 14, 9, 2, "back"), ("g", 15, 5, 5, "loop"), ("h", 0, 0, 1, "x"), ("h", 1, 1, 2, G.ADJACENT)]
    df = spark.createDataFrame(edges, "graph_id string, edge_ord int, src_idx int, dst_idx int, relationship_type string")

    def grown(paths):
        return [(p + (e[1],), n + (e[3],)) for p, n in paths for e in edges[:16] if e[2] == n[-1] and e[3] not in n]

    every, now = [], [((e[1],), (e[2], e[3])) for e in edges[:16] if e[2] != e[3]]
    while now:
        every += [p for p, _ in now if len(p) >= 3]
        now = grown(now)
    assert sorted(tuple(r["path"]) for r in G.cascades(df).collect()) == sorted(every) and max(map(len, every)) == 14
    assert sorted(tuple(r["path"]) for r in G.cascades(df, longest=4).collect()) == sorted(p for p in every if len(p) <= 4)


def test_one_array_in_one_file(spark, tmp_path):
    lex = I.seed(spark)
    for name, df in (("some", lex), ("none", lex.limit(0))):
        I.export_json(df.repartition(3), str(tmp_path / name))
        (file,) = [f for f in (tmp_path / name).iterdir() if f.name.startswith("part-")]
        assert [r["id"] for r in json.loads(file.read_text(encoding="utf-8"))] == [r["id"] for r in df.orderBy("ord").collect()]


def test_plain_texts_match_where_the_expression_does(spark, tmp_path):
    """Texts that overlap with themselves, in groups and bare, several at one place, beside wide characters, against Python's."""
    import re

    from colex.operators import patterns as Y

    expressions = ["(aa)", "aba", "(aab)", "風が", "(b)(a)"]
    fields = dict(family="f", head="", collocate="", label="", head_pos="", collocate_pos="", confidence=50)
    (tmp_path / "c.json").write_text("\n".join(json.dumps({"spec_id": i, "expression": x, "pattern": x, **fields}) for i, x in enumerate(expressions)))
    texts = ["aaaaa", "ababababa", "𝒳風が風風がaab", "", None, "baabaaabaa", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "n long, text string")
    catalogue = Y.read_catalogue(spark, str(tmp_path / "c.json"))
    found = sorted((r["n"], r["pattern"], r["start"], r["end"]) for r in Y.extract_by_catalogue(df, "n", catalogue).collect())
    marked = [r["pattern"] for r in catalogue.where("size(markers) > 0").collect()]
    assert {"(aa)", "aba", "(aab)", "風が"} <= set(marked)
    assert found == sorted((n, x, *m.span()) for n, t in enumerate(texts) for x in marked for m in re.finditer(x, t or ""))
    starts = Y._tried(df.select("n", F.col("text").alias("body")), "n", [r.asDict(recursive=True) for r in catalogue.where("pattern = '(aa)'").collect()])
    assert {r["n"]: r["starts"] for r in starts.collect()} == {0: [0, 2], 2: [6], 5: [1, 4, 8]}
