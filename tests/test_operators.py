"""Store, search, discourse and source behaviour beyond the SQL oracles; plans; edge cases."""

import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from colex import queries as Q
from colex.api import Workspace
from colex.operators import dictionary as D
from colex.operators import discourse as G
from colex.operators import library as B
from colex.operators import parse
from colex.operators import patterns as X
from colex.operators import search as S
from colex.operators import store as K
from colex.plans import fixtures as fx
from colex.sources import dictionary_bank as Z
from colex.sources import lexicon as I
from colex.sources import pages as P
from colex.streaming import ingest


def plan(df):
    return df._jdf.queryExecution().toString()


def test_filters_reach_the_scan_and_limits_are_top_k(spark, sf_dir):
    text = plan(S.search(Q.lexicon(spark, sf_dir), S.SearchOptions("ring", max_results=5)))
    assert "TakeOrderedAndProject" in text
    found = plan(D.lookup_term(spark.read.parquet(f"{sf_dir}/part.parquet").withColumnRenamed("p_name", "term"), "x"))
    assert "PushedFilters: [IsNotNull(p_name), EqualTo(p_name,x)]" in found


def test_scores_are_of_the_documented_set(spark, sf_dir):
    scores = {r[0] for r in S.search(Q.lexicon(spark, sf_dir), S.SearchOptions("smal rong", max_results=None)).select("score").distinct().collect()}
    assert all(0 < s <= 65 or s in (75, 80, 90, 100) for s in scores)


def test_wildcards_escape_other_characters(spark):
    assert S.search(I.seed(spark), S.SearchOptions("(*")).count() == 0
    assert S.query_terms("a.b*").wildcard == r"(?iu)\Aa\.b.*\z"


def test_blank_query_sorts_by_frequency(spark):
    assert [r["id"] for r in S.search(I.seed(spark), S.SearchOptions(" ")).collect()] == ["s002", "s001", "s004", "s010", "s011"]


def test_upsert_is_idempotent_and_keeps_places(spark):
    seed = I.seed(spark)
    once = K.upsert(seed, seed.where("id = 's010'").withColumn("frequency", F.lit(1)))
    assert [r["id"] for r in K.all_rows(once).collect()] == ["s001", "s002", "s004", "s010", "s011"]
    assert once.where("id = 's010'").first()["frequency"] == 1
    assert K.upsert(once, once).orderBy("ord").collect() == once.orderBy("ord").collect()
    assert K.upsert(seed.limit(0), seed).count() == 5 and K.upsert(seed, seed.limit(0)).count() == 5


def test_rules_registry_round_trip():
    rules = G.seed_rules()
    assert [r.type for r in rules.all()][:2] == ["interactional-pivot", "hedge-stance-softening"]
    text = rules.serialize()
    rules.deserialize(text.replace('"priority": 100', '"priority": 1'))
    assert rules.all()[-1].type == "interactional-pivot"
    assert rules.unregister("seed-interactional-pivot") and not rules.unregister("none")
    rules.register(G.Rule("mine", "my-type", 99, G.marker_rule("x", 0.5)))
    assert rules.relations.has("my-type") and rules.by_type("my-type")[0].id == "mine"


def test_cycles_end_and_long_edges(spark):
    bits = G.split_bits(fx.MARKED.spark(spark).where("graph_id = 'C'"))
    far = G.edges(bits).where(F.col("bit_distance") > 1)
    assert {(r["src_idx"], r["dst_idx"]) for r in far.collect()} == {(0, 2), (2, 0)}
    assert G.cascades(G.edges(bits)).count() == 0


def test_negative_examples_are_unlabelled(spark):
    rows = [(str(i), t) for i, t in enumerate(["っていうか", "ぽい", "の立場から", "続けながら", "だと思う", "かもな"])]
    labels = G.label_bits(G.split_bits(spark.createDataFrame(rows, "graph_id string, raw string"))).where(F.col("bit_type").isin("hedge-stance-softening", "perspective-framing", "epistemic-continuation-blend", "assertion-deflation"))
    assert labels.count() == 0


def test_zip_banks(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, body in fx.BANKS.items():
            z.writestr(name, body)
        z.writestr("broken.json", "{")
    (tmp_path / "d.zip").write_bytes(data.getvalue())
    files = Z.read_archives(spark, str(tmp_path))
    assert files.where("name = 'broken.json'").count() == 0
    assert [r["term"] for r in Z.parse_terms(files).orderBy("row_ord").collect()] == ["風", "夢", "雨"]
    assert D.flatten_content({"type": "structured-content", "content": ["a", {"tag": "b", "content": ["c", {"tag": "i", "content": "d"}], "text": "e"}, {"data": "f"}]}) == "acdef"


def test_dictionary_import_and_delete(spark):
    terms = Z.parse_terms(Z.from_map(spark, fx.BANKS))
    rows = spark.createDataFrame([("T1", 3)], "title string, term_count bigint")
    new_terms, new_dicts = D.import_dictionary(terms, rows, terms.limit(1), rows)
    assert new_terms.count() == 1 and new_dicts.count() == 1
    left, _, dicts = D.delete_dictionary(terms, Z.parse_kanji(Z.from_map(spark, fx.BANKS)), rows, "T1")
    assert left.count() == 0 and dicts.count() == 0


def test_scan_limit_of_old_searches(spark, sf_dir):
    terms, dicts = Q.dictionary_tables(spark, sf_dir)
    new = D.search(terms, dicts, D.DictionaryOptions("th", mode="bilingual", max_results=5))
    old = D.search(terms, dicts, D.DictionaryOptions("th", mode="bilingual", max_results=5, compat_scan_limit=True))
    assert old.count() <= new.count() == 5
    assert D.search(terms, dicts, D.DictionaryOptions("  ")).count() == 0


def test_history_keeps_a_hundred(spark):
    log = spark.createDataFrame([(q, i, i) for i, q in enumerate(["a", "b", "a", "  "] + [f"q{i}" for i in range(101)])], "query string, ts bigint, ord bigint")
    assert B.history(log).count() == 100
    assert [r["query"] for r in B.history(log.where("ts < 4")).collect()] == ["a", "b"]


def test_pattern_spans_point_at_the_text(spark):
    texts = spark.createDataFrame([(0, "走り始めた、走り始めた人"), (1, None)], "n int, text string")
    found = X.extract_patterns(texts, "n").where("collocate = '始めた'").collect()
    assert sorted((r["start"], r["end"]) for r in found) == [(0, 5), (6, 11)]
    assert X.extract_patterns(texts, "n", best_only=True).groupBy("n", "start").count().where("count > 1").count() == 0


def test_catalogue_files(tmp_path):
    path = str(tmp_path / "c.json")
    X.dump_catalogue(X.SPECS, path)
    assert X.load_catalogue(path) == X.SPECS


def test_pattern_matches_against_plain_expressions(spark):
    """Every specification with re.finditer, on texts made of heads and markers."""
    rng = random.Random(3)
    markers = [m for s in X.SPECS for m in s.markers]
    some = lambda: rng.choice([rng.choice("雨行書夢。、 \u3000𠮷"), "きらきら", rng.choice(markers), rng.choice(markers)])
    texts = ["".join(some() for _ in range(rng.randrange(2, 9))) for _ in range(150)]
    expected = set()
    for n, text in enumerate(texts):
        for i, spec in enumerate(X.SPECS):
            for m in re.finditer(spec.regex, text):
                head, collocate = (re.sub(r"\$(\d)", lambda g, m=m: m[int(g[1])] or "", t) for t in (spec.head, spec.collocate))
                expected.add((n, i, head, collocate, m.start(), m.end()))
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    found = {(r["n"], r["spec_id"], r["headword"], r["collocate"], r["start"], r["end"]) for r in X.extract_patterns(df, "n").collect()}
    assert found == expected and len(expected) > 100


def test_scraping_isolates_missing_pages(spark):
    words = spark.createDataFrame([(0, "風"), (1, " "), (2, "風"), (3, "無")], "ord long, word string")
    pages = fx.PAGES.spark(spark).withColumnRenamed("headword", "word").where("word = '風'")
    entries, missing = P.scrape(words, pages)
    assert [r["collocate"] for r in entries.collect()] == ["が吹く"] and [r["word"] for r in missing.collect()] == ["無"]


def test_files_stream_into_snapshots(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    I.write_json(I.seed(spark), source)
    ingest.upsert_into(ingest.read_entries(spark, source), target, str(tmp_path / "cp")).awaitTermination()
    assert ingest.latest_snapshot(spark, target).count() == 5
    I.seed(spark).where("id = 's001'").withColumn("frequency", F.lit(3)).write.mode("append").json(source)
    ingest.upsert_into(ingest.read_entries(spark, source), target, str(tmp_path / "cp")).awaitTermination()
    now = ingest.latest_snapshot(spark, target)
    assert now.count() == 5 and now.where("id = 's001'").first()["frequency"] == 3


def test_workspace_round_trip(spark, tmp_path):
    w = Workspace.open(spark)
    assert w.suggest("風").first()["id"] == "s001"
    w.delete(["s001", "nope"])
    assert w.totals(w.search("")).first()["n_all"] == 4
    w.save(str(tmp_path / "lex"), str(tmp_path / "chunks"))
    again = Workspace.open(spark, str(tmp_path / "lex"))
    assert {r["id"] for r in again.lexicon.collect()} == {"s002", "s004", "s010", "s011"}
    assert Workspace.open(spark, str(tmp_path / "missing"), on_error="seed").lexicon.count() == 5
    bits, edges, cascades = w.analyze(fx.MARKED.spark(spark))
    assert bits.count() > 10 and edges.count() > 5 and cascades.count() == 0


def test_files_of_either_naming(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"id": "a", "headword": "風", "headwordPOS": "名詞", "fullPhrase": "風が吹く", "tags": ["t"], "createdAt": 5},\n {"id": "b", "headword_pos": "動詞"}]', encoding="utf-8")
    rows = I.read_lexicon(spark, str(tmp_path / "x.json")).orderBy("ord").collect()
    assert [(r["id"], r["headword_pos"], r["full_phrase"], r["created_at"]) for r in rows] == [("a", "名詞", "風が吹く", 5), ("b", "動詞", None, None)]


def test_index_lists_in_parts(spark, sf_dir):
    lex = Q.lexicon(spark, sf_dir)
    whole = {r["key"]: r["ids"] for r in K.inverted_index(lex, "tags").collect()}
    parts = K.inverted_index(lex, "tags", span=50).orderBy("key", "part").collect()
    joined = {}
    for r in parts:
        assert len(r["ids"]) <= 50
        joined[r["key"]] = joined.get(r["key"], []) + r["ids"]
    assert joined == whole


def test_stored_fields_need_no_python(spark, sf_dir):
    from colex import queries as Q
    from colex.operators import search as S
    from colex.plans.shared import shared_path

    lexicon, path = Q.lexicon(spark, sf_dir), shared_path(spark, "fields")
    S.write_with_fields(lexicon, path)
    stored = spark.read.parquet(path)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for options in (S.SearchOptions("ring"), S.SearchOptions("*in?"), S.SearchOptions(""), S.SearchOptions("ポット", fuzzy=False)):
        fresh, kept = S.search(lexicon, options), S.search(stored, options)
        assert kept.columns == fresh.columns and kept.select("id", "score").collect() == fresh.select("id", "score").collect()
        assert "Python" not in plan(kept) and "Pandas" not in plan(kept)
    S.write_with_fields(lexicon.limit(0), path)
    assert S.quick_search(spark.read.parquet(path), "ring").collect() == []


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_entries_are_dealt_out_before_they_are_scored(spark, sf_dir):
    """A scan of one task doesn't score: the filter on the score stays behind the exchange."""
    lex = Q.lexicon(spark, sf_dir).coalesce(1)
    assert S.with_fields(lex).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    for query in ("widgit", "smal rong", "ring"):
        plan = plan_of(S.search(lex, S.SearchOptions(query, max_results=None)))
        assert max(i for i, line in enumerate(plan.splitlines()) if "levenshtein" in line) < max(i for i, line in enumerate(plan.splitlines()) if "RepartitionByExpression" in line)


def test_windows_without_a_piece_of_the_term_score_nothing(spark):
    """Against every window: only those with a piece of the term come over the threshold."""
    rng, n = random.Random(3), 300
    fields = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 14))) for _ in range(n)]
    for term in ("abcd", "abcdab", "abcdabcdab"):
        df = spark.createDataFrame([(f,) for f in fields], "norm string")
        windows = F.transform(F.sequence(F.lit(1), F.length("norm") - len(term) + 1), lambda i: 1 - F.levenshtein(F.substring("norm", i, F.lit(len(term))), F.lit(term)) / len(term))
        best = F.when(F.length("norm") >= len(term), F.array_max(windows)).otherwise(0.0)
        has = F.lit(False)
        for piece in S.pieces(term):
            has = has | F.col("norm").contains(piece)
        assert df.where((best > S.WINDOW_OVER) & ~has).count() == 0


def test_texts_are_dealt_out_before_they_are_matched(spark):
    df = spark.createDataFrame([(i, "雨が降る。風が吹く") for i in range(40)], "n long, text string").coalesce(1)
    out = parse.parse_collocations(df, "n")
    plan = plan_of(out).splitlines()
    assert max(i for i, line in enumerate(plan) if "regexp_extract_all" in line) < next(i for i, line in enumerate(plan) if "RepartitionByExpression" in line)
    one = parse.parse_collocations(df.limit(1), "n").drop("n").collect()
    assert out.count() == 40 * len(one) and all(r["headword"] + "が" + r["collocate"] == r["full_phrase"] for r in one if r["pattern"] == "N+V")


def test_an_array_with_an_element_a_line_is_read_in_splits(spark, sf_dir, tmp_path):
    lex, path = Q.lexicon(spark, sf_dir), str(tmp_path / "array")
    I.export_json(lex, path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = I.read_lexicon(spark, path)
        assert found.rdd.getNumPartitions() > 4
        assert sorted(map(str, found.collect())) == sorted(map(str, lex.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_arrays_of_any_layout(spark, tmp_path):
    """Elements over several lines, two in a line, in brackets of their own lines, without a place."""
    one, two, three = ('{"id": "%d", "headword": "[,]{}", "ord": %d}' % (i, i) for i in (1, 2, 3))
    layouts = (f"[{one}\n,{two}\n,{three}\n]\n", f"[{one}\n,{two},{three}\n]", f"[\n{one},\n{two},\n{three}\n]", f"[{one.replace(', ', ',' + chr(10))},{two}\n,{three}]", f"[{one},{two},{three}]")
    for i, text in enumerate(layouts):
        (tmp_path / f"{i}.json").write_text(text)
        found = I.read_lexicon(spark, str(tmp_path / f"{i}.json"))
        assert sorted((r["id"], r["headword"], r["ord"]) for r in found.collect()) == [(str(k), "[,]{}", k) for k in (1, 2, 3)]
    (tmp_path / "x.json").write_text('[{"id": "b"}\n,{"id": "a"}\n]\n')
    assert sorted((r["ord"], r["id"]) for r in I.read_lexicon(spark, str(tmp_path / "x.json")).collect()) == [(0, "b"), (1, "a")]
    (tmp_path / "none.json").write_text("[]")
    assert I.read_lexicon(spark, str(tmp_path / "none.json")).count() == 0


_EDGES = "graph_id string, edge_ord int, src_idx int, dst_idx int, relationship_type string"


def simple_paths(rows, least, longest):
    """Brute force: (graph_id, path, types)."""
    rows = [r for r in rows if r[4] not in (None, G.ADJACENT) and None not in r[2:4] and r[2] != r[3]]
    out, last = [], [(r,) for r in rows]
    for _ in range(longest):
        out += last
        last = [(*p, r) for p in last for r in rows if p[-1][0] is not None and r[0] == p[-1][0] and r[2] == p[-1][3] and r[3] not in {x[2] for x in p}]
    return sorted((str(p[0][0]), [r[1] for r in p], [r[4] for r in p]) for p in out if len(p) >= least)


@pytest.mark.parametrize(("bound", "least", "longest"), [(None, 3, None), (None, 1, 4), (None, 1, 1), (0, 2, 5), (200, 1, None)])
def test_cascades_of_small_and_large_graphs(spark, monkeypatch, bound, least, longest):
    """Cycles, loops, parallel steps, bits and graphs that are null, whether paths grow in a row or by joins."""
    if bound is not None:
        monkeypatch.setattr(G, "ROW_PATHS", bound)
    rows = [("chain", i, i, i + 1, "xyz"[i % 3]) for i in range(9)] + [("cycle", i, i, (i + 1) % 4, "x") for i in range(4)]
    rows += [("many", 10 * i + j, i, j, "x" if i < j else "y") for i in range(4) for j in range(4)] + [("twice", i, i // 2, i // 2 + 1, "z") for i in range(6)]
    rows += [("broken", 0, 0, 1, "x"), ("broken", 1, 1, 2, G.ADJACENT), ("broken", 2, 2, 3, "x"), ("broken", 3, 1, None, "x"), ("broken", 4, None, 1, "x"), ("broken", 5, 3, 3, "x"), ("broken", 6, 3, 1, None)]
    rows += [(None, 0, 0, 1, "x"), (None, 1, 1, 2, "x")]
    found = G.cascades(spark.createDataFrame(rows, _EDGES).repartition(3), least, longest).collect()
    assert sorted((str(r["graph_id"]), r["path"], r["types"]) for r in found) == simple_paths(rows, least, longest or 20)


def test_a_chain_of_many_steps_is_shuffled_once(spark):
    """No join for each step of a path."""
    rows = [(str(k), i, i, i + 1, "x") for k in range(5) for i in range(30)]
    context = spark.sparkContext
    context.setJobGroup("chains", "chains")
    try:
        assert G.cascades(spark.createDataFrame(rows, _EDGES)).count() == 5 * 28 * 29 // 2
        jobs = context.statusTracker().getJobIdsForGroup("chains")
    finally:
        context.setJobGroup("", "")
    assert len(jobs) < 15  # with a join each, 30 rounds and more
