"""Further registered queries: round trips through files, stores, registries, views and the facade."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .api import Workspace
from .functions import text as T
from .operators import dictionary as D
from .operators import discourse as G
from .operators import fuzzy_index as X
from .operators import library as B
from .operators import patterns as Y
from .operators import postings as N
from .operators import search as S
from .operators import store as K
from .operators.dictionary_store import DictionaryStore
from .plans import fixtures as fx
from .plans import schemas as A
from .plans.shared import shared_path, written
from .queries import SHOWN, _dict_sql, both_sql, kanji_files, scored_sql, _CATEGORY_SQL, _CHUNKS, _COLOUR_SQL, _EDGES_SQL, _SPLIT, _TERMS, _TURNS, LEX, _labels_sql, _rules_sql, chunks, dictionary_tables, lexicon, query, read
from .sources import dictionary_bank as Z
from .sources import lexicon as I
from .sources import pages as P
from .sources.archives import read_rows, write_archives
from .streaming import history, ingest
from .streaming.deltas import DeltaStore


def kinds(**finds: DataFrame) -> DataFrame:
    """The rows of several one-column finds, each under its name."""
    out = None
    for name, df in finds.items():
        some = df.select(F.lit(name).alias("kind"), F.col(df.columns[0]).cast("string").alias("id"))
        out = some if out is None else out.unionByName(some)
    return out


def finds_of(finds: dict[str, DataFrame], column: str) -> dict[str, DataFrame]:
    return {name: df.select(column) for name, df in finds.items()}


# ------------------------------------------------------------------ files


@query(f"WITH {LEX} SELECT id, headword, full_phrase, array_to_string(tags, ',') AS tags, frequency, updated_at, ord FROM lex")
def lexicon_json_round_trip(spark, sf_dir):
    path = shared_path(spark, "lexicon")
    I.write_json(lexicon(spark, sf_dir), path)
    return I.read_lexicon(spark, path).select("id", "headword", "full_phrase", F.array_join("tags", ",").alias("tags"), "frequency", "updated_at", "ord")


@query(f"WITH {LEX} SELECT id, headword, full_phrase, array_to_string(tags, ',') AS tags, frequency, updated_at, ord FROM lex")
def lexicon_array_round_trip(spark, sf_dir):
    """The lexicon as one JSON array, and back."""
    path = shared_path(spark, "array")
    I.export_json(lexicon(spark, sf_dir), path)
    return I.read_lexicon(spark, path).select("id", "headword", "full_phrase", F.array_join("tags", ",").alias("tags"), "frequency", "updated_at", "ord")


@query(f"WITH {_CHUNKS} SELECT id, surface, category, array_to_string(collocations, ',') AS collocations FROM ch")
def chunks_json_round_trip(spark, sf_dir):
    path = shared_path(spark, "chunks")
    I.write_json(chunks(spark, sf_dir), path)
    return I.read_chunks(spark, path).select("id", "surface", "category", F.array_join("collocations", ",").alias("collocations"))


@query(f"WITH {LEX} SELECT * FROM (VALUES ('lexicon', 's001'), ('lexicon', 's002'), ('lexicon', 's004'), ('lexicon', 's010'), ('lexicon', 's011')) AS t(kind, id) UNION ALL SELECT 'there', id FROM lex")
def missing_files_fall_back(spark, sf_dir):
    """The seed stands in where no lexicon is, and only there."""
    nowhere, there = shared_path(spark, "nowhere"), shared_path(spark, "lexicon")
    I.write_json(lexicon(spark, sf_dir), there)
    return kinds(there=I.read_lexicon(spark, there, "seed").select("id"), lexicon=I.read_lexicon(spark, nowhere, "seed").select("id"), chunks=I.read_chunks(spark, nowhere, "empty").select("id"))


#: The places of terms in banks of a hundred, which go by their names: bank 10 comes before bank 2.
_BANKED = f"""{_TERMS}, k AS (SELECT *, row_ord // 100 AS bank FROM terms WHERE dictionary IS NOT NULL), c AS (SELECT dictionary, bank, count(*) AS n FROM k GROUP BY 1, 2),
  f AS (SELECT dictionary, bank, coalesce(sum(n) OVER (PARTITION BY dictionary ORDER BY 'term_bank_' || bank || '.json' ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM c),
  banked AS (SELECT k.*, CAST(first + row_number() OVER (PARTITION BY dictionary, bank ORDER BY row_ord) - 1 AS BIGINT) AS place FROM k JOIN f USING (dictionary, bank))"""


def term_files(spark, sf_dir) -> DataFrame:
    """The banks and indexes of all documents' dictionaries."""
    terms, dicts = dictionary_tables(spark, sf_dir)
    return Z.bank_files(Z.term_cells(terms.where("dictionary IS NOT NULL")), "term", 100).unionByName(Z.index_files(dicts))


@query(f"WITH {_BANKED} SELECT dictionary, term, reading, place AS row_ord, md5(text) AS digest FROM banked")
def dictionary_archives(spark, sf_dir):
    """Dictionaries are written as zip archives and read back, a member a task."""
    path = shared_path(spark, "archives")
    write_archives(term_files(spark, sf_dir), path)
    terms = Z.parse_terms(read_rows(spark, path))
    return terms.select("dictionary", "term", "reading", "row_ord", F.md5(F.col("definitions")[0]["content"][0]["text"]).alias("digest"))


@query("SELECT CAST(event_id AS VARCHAR) AS id, event_type AS term, 'T' || user_id AS dictionary, event_id AS saved_at, '' AS folder FROM events UNION ALL SELECT 'event', query, '', last, '' FROM (SELECT event_type || ':' || user_id AS query, max(event_id) AS last FROM events GROUP BY 1)")
def library_json_round_trip(spark, sf_dir):
    kept_marks, log = shared_path(spark, "bookmarks"), shared_path(spark, "history")
    I.write_json(bookmarks(spark, sf_dir)[0], kept_marks)
    events = read(spark, sf_dir, "events").select(F.concat("event_type", F.lit(":"), F.col("user_id").cast("string")).alias("query"), F.col("event_id").alias("ts"), F.col("event_id").alias("ord"))
    I.write_json(events, log)
    kept = B.history(spark.read.schema("query string, ts bigint, ord bigint").json(log), limit=None)
    saved = spark.read.schema(fx.BOOKMARKS.columns).json(kept_marks)
    return saved.unionByName(kept.select(F.lit("event").alias("id"), F.col("query").alias("term"), F.lit("").alias("dictionary"), F.col("ts").alias("saved_at"), F.lit("").alias("folder")))


# ------------------------------------------------------------------ indexes


@query(scored_sql(both_sql("ring"), tail=""))
def search_stored(spark, sf_dir):
    """Every hit in a lexicon that was stored with its normal forms."""
    path = shared_path(spark, "fields")
    S.write_with_fields(lexicon(spark, sf_dir), path)
    return S.search(spark.read.parquet(path), S.SearchOptions("ring", max_results=None)).select(SHOWN)


def _indexed(query: str):
    def run(spark, sf_dir):
        lex = lexicon(spark, sf_dir)
        return X.search(lex, X.build(lex), S.SearchOptions(query, max_results=None)).select(SHOWN)

    return run


@query(scored_sql(both_sql("smal rong"), tail=""))
def search_fuzzy_whole_indexed(spark, sf_dir):
    """search_fuzzy_whole by way of the index."""
    return _indexed("smal rong")(spark, sf_dir)


@query(scored_sql(both_sql("widgit"), tail=""))
def search_fuzzy_window_indexed(spark, sf_dir):
    """search_fuzzy_window by way of the index."""
    return _indexed("widgit")(spark, sf_dir)


@query(
    f"""WITH {LEX}, n AS (SELECT id, ord, [headword, CAST(frequency AS VARCHAR)] AS tags FROM lex WHERE ord % 5 = 2 UNION ALL SELECT id, ord, tags FROM lex WHERE ord % 5 NOT IN (1, 2)),
    e AS (SELECT DISTINCT unnest(tags) AS key, id, ord FROM n) SELECT key, CAST(ord // 100 AS BIGINT) AS block, string_agg(id, ' ' ORDER BY ord) AS ids FROM e GROUP BY 1, 2"""
)
def postings_maintained(spark, sf_dir):
    """The index of all tags after a fifth of the entries changed theirs and a fifth is deleted, by the blocks that this touches."""
    lex = lexicon(spark, sf_dir)
    blocks = N.build(lex, "tags", 100)
    before, after = lex.where("ord % 5 IN (1, 2)"), lex.where("ord % 5 = 2").withColumn("tags", F.array("headword", F.col("frequency").cast("string")))
    now = N.maintain(blocks, N.changes(before, after, "tags"), 100)
    return now.select("key", "block", F.array_join(F.transform("postings", lambda p: p["id"]), " ").alias("ids"))


# ------------------------------------------------------------------ store


@query(f"WITH {LEX}, b AS (SELECT id, max_by(frequency, ord) AS frequency FROM {fx.LEXICON_BATCH.sql()} GROUP BY 1) SELECT id, coalesce(b.frequency, lex.frequency) AS frequency, CASE WHEN b.id IS NULL THEN updated_at ELSE 1800000000000 END AS updated_at FROM lex FULL JOIN b USING (id)")
def store_update(spark, sf_dir):
    lex = lexicon(spark, sf_dir).select("id", "frequency", "updated_at", "ord")
    batch = fx.LEXICON_BATCH.spark(spark).withColumn("updated_at", F.lit(0).cast("long"))
    return K.update(lex, batch, 1_800_000_000_000).select("id", "frequency", "updated_at")


@query(f"WITH {LEX} SELECT * FROM (VALUES ('seed', 5), ('cleared', 0)) AS t(state, n) UNION ALL SELECT 'lexicon', count(*) FROM lex UNION ALL SELECT 'hits', count(*) FROM lex WHERE contains(full_phrase, 'ring') OR contains(headword_pos, 'ring') OR contains(collocate_pos, 'ring')")
def workspace_states(spark, sf_dir):
    """Search, totals, reset and clear through the facade."""
    work = Workspace(spark, lexicon(spark, sf_dir), chunks(spark, sf_dir))
    totals = work.totals(work.search("ring", fuzzy=False, max_results=None))
    out = totals.select(F.explode(F.array(F.struct(F.lit("lexicon").alias("state"), F.col("n_all").alias("n")), F.struct(F.lit("hits").alias("state"), F.col("n_hits").alias("n")))).alias("x")).select("x.*")
    work.reset()
    out = out.unionByName(work.lexicon.agg(F.lit("seed").alias("state"), F.count(F.lit(1)).alias("n")))
    work.clear()
    return out.unionByName(work.lexicon.agg(F.lit("cleared").alias("state"), F.count(F.lit(1)).alias("n")))


@query(f"WITH {LEX}, {_CHUNKS} SELECT 'left' AS kind, id FROM lex WHERE id NOT IN ('1', '2') UNION ALL SELECT 'chunks', id FROM ch WHERE surface = 'The' UNION ALL SELECT 'suggested', id FROM (SELECT id FROM lex WHERE id NOT IN ('1', '2') AND list_max(list_transform(fields, lambda f: CASE WHEN contains(f, 'promo') THEN 1 ELSE 0 END)) = 1 ORDER BY frequency DESC, ord LIMIT 20)")
def workspace_calls(spark, sf_dir):
    work = Workspace(spark, lexicon(spark, sf_dir), chunks(spark, sf_dir))
    work.delete(["1", "2", "none such"])
    return kinds(left=work.lexicon.select("id"), chunks=work.query_chunks(marker="The").select("id"), suggested=work.search("promo", fuzzy=False, max_results=20).select("id"))


@query(f"WITH {LEX} SELECT 'all' AS kind, id FROM lex UNION ALL SELECT 'size', CAST(count(*) AS VARCHAR) FROM lex UNION ALL SELECT * FROM (VALUES ('import', 'true'), ('none such', 'false')) AS t(kind, id)")
def store_listing(spark, sf_dir):
    lex = lexicon(spark, sf_dir)
    flags = {name: spark.createDataFrame([(str(K.has_source(lex, name)).lower(),)], "id string") for name in ("import", "none such")}
    return kinds(all=K.all_rows(lex).select("id"), size=spark.createDataFrame([(str(K.size(lex)),)], "id string"), **flags)


@query(f"WITH {LEX} SELECT tag AS key, CAST(floor(ord / 1000) AS BIGINT) AS part, array_to_string(list(id ORDER BY ord), ' ') AS ids FROM (SELECT DISTINCT unnest(tags) AS tag, id, ord FROM lex) GROUP BY 1, 2")
def inverted_index_by_span(spark, sf_dir):
    return K.inverted_index(lexicon(spark, sf_dir), "tags", span=1000).select("key", "part", F.array_join("ids", " ").alias("ids"))


# ------------------------------------------------------------------ dictionaries


@query(
    f"""WITH {_TERMS}, z AS (SELECT min(title) AS title FROM dicts) SELECT dictionary, term, reading, row_ord FROM terms JOIN dicts ON title = dictionary WHERE dictionary <> (SELECT title FROM z)
    UNION ALL SELECT dictionary, term || '!', reading, -1 - row_ord FROM terms WHERE dictionary = (SELECT title FROM z) AND row_ord % 2 = 0"""
)
def dict_import_store(spark, sf_dir):
    """One dictionary is imported anew: half of its terms, changed.  Every row of the store afterwards."""
    terms, dicts = dictionary_tables(spark, sf_dir)
    row = dicts.orderBy("title").limit(1)
    old = terms.join(F.broadcast(row.select(F.col("title").alias("dictionary"))), "dictionary").where("row_ord % 2 = 0")
    new = old.withColumn("term", F.concat("term", F.lit("!"))).withColumn("row_ord", -1 - F.col("row_ord")).select(*terms.columns)
    after, titles = D.import_dictionary(terms, dicts, new, row)
    known = after.join(titles.select(F.col("title").alias("dictionary")), "dictionary")
    return known.select("dictionary", "term", "reading", "row_ord")


_STORED = f"""{_TERMS}, z AS (SELECT min(title) AS first, max(title) AS last FROM dicts), t AS (SELECT dictionary, term, reading, row_ord FROM terms JOIN dicts ON title = dictionary WHERE dictionary NOT IN (SELECT last FROM z) AND (dictionary <> (SELECT first FROM z) OR row_ord % 2 = 0)),
  ka AS (SELECT source AS dictionary, count(*) AS n_kanji FROM documents, z WHERE text IS NOT NULL AND source IS NOT NULL AND source <> last AND doc_id % 3 <> 1 AND (source <> first OR doc_id % 2 = 0) GROUP BY 1)"""


def stored(spark, sf_dir) -> tuple[DictionaryStore, list[str]]:
    """A store of all documents' dictionaries, in which one is imported anew with half of its rows, one is deleted, and an
    import fails between its tables and its commit."""

    def fail() -> None:
        raise RuntimeError("lost before the commit")

    terms, dicts = dictionary_tables(spark, sf_dir)
    kanji = written(Z.parse_kanji(kanji_files(spark, sf_dir)), "kanji")  # two imports read it
    named = dicts.select("title", F.lit(3).alias("format"), F.lit("1").alias("revision"))
    ends = dicts.agg(F.min("title").alias("first"), F.max("title").alias("last")).first()
    store = DictionaryStore(spark, shared_path(spark, "dictionary-store"))
    store.import_dictionaries(terms, kanji, named, 1)
    only = named.where(F.col("title") == ends["first"])
    store.import_dictionaries(terms.where("row_ord % 2 = 0"), kanji.where("CAST(stats['id'] AS BIGINT) % 2 = 0 OR character <> '風' AND row_ord % 2 = 0"), only, 2)
    try:
        store.import_dictionaries(terms.limit(0), kanji.limit(0), named, 3, fail)
    except RuntimeError:
        store.vacuum(keep=9)
    store.delete(ends["last"])
    return store, [ends["first"], ends["last"]]


@query(f"SELECT h.*, EXISTS (SELECT 1 FROM documents d WHERE d.doc_id % 2 = 0 AND d.source = h.dictionary AND regexp_extract(text, '^[\\x20\\x09-\\x0D]*([^\\x20\\x09-\\x0D]*)', 1) = h.term) AS bookmarked, 'th' AS asked FROM ({_dict_sql('th', 'true', 50)}) h")
def dictionary_view(spark, sf_dir):
    """Hits with whether they are bookmarked, and what the history has after three searches."""
    terms, dicts = dictionary_tables(spark, sf_dir)
    work = Workspace(spark, lexicon(spark, sf_dir), chunks(spark, sf_dir))
    for asked in ("th", " ", "th"):
        hits = work.dictionary_view(terms, dicts, terms.where("row_ord % 2 = 0").select("term", "dictionary"), D.DictionaryOptions("th" if asked == "th" else asked))
    return hits.select("dictionary", "term", "score", "bookmarked", F.lit(",".join(work.asked)).alias("asked"))


@query(f"WITH {_SPLIT}, {_labels_sql('bits')}, z AS (SELECT * FROM lab) SELECT sha256('chat' || chr(1) || graph_id || chr(1) || bit_idx) AS id, bit_type FROM z")
def workspace_contexts(spark, sf_dir):
    """Graphs are ingested twice; a record's id is that of its content, so it is there once."""
    work = Workspace(spark, lexicon(spark, sf_dir), chunks(spark, sf_dir))
    work.ingest(fx.marked_graphs(spark, sf_dir), "other")
    work.clear_contexts()
    for _ in range(2):
        work.ingest(fx.marked_graphs(spark, sf_dir), "chat")
    return work.contexts.select("id", "bit_type")


@query(f"WITH {_STORED} SELECT dictionary AS title, count(*) AS n_terms, min(row_ord) AS first_ord, CAST(CASE WHEN dictionary = (SELECT first FROM z) THEN 2 ELSE 1 END AS BIGINT) AS imported_at, '専門用語' AS category FROM t GROUP BY 1")
def dict_store_imports(spark, sf_dir):
    """Terms and metadata by title after imports, a failed one and a delete."""
    store, _ = stored(spark, sf_dir)
    counts = store.table("terms").groupBy(F.col("dictionary").alias("title")).agg(F.count(F.lit(1)).alias("n_terms"), F.min("row_ord").alias("first_ord"))
    return counts.join(store.dictionaries().select("title", "imported_at", "category"), "title")


@query(f"WITH {_STORED} SELECT 'term' AS kind, row_ord FROM t WHERE term = 'The' UNION ALL SELECT 'reading', row_ord FROM t WHERE reading = 'the' UNION ALL SELECT 'prefix', row_ord FROM (SELECT row_ord FROM t WHERE starts_with(term, 'Th') ORDER BY term, row_ord LIMIT 40) UNION ALL SELECT 'reading prefix', row_ord FROM t WHERE starts_with(reading, 'an')")
def dict_store_lookups(spark, sf_dir):
    """Lookups that open only the files whose key range they meet."""
    store, _ = stored(spark, sf_dir)
    finds = {"term": store.lookup("terms", "The"), "reading": store.lookup("readings", "the"), "prefix": store.prefix("terms", "Th", 40), "reading prefix": store.prefix("readings", "an")}
    return kinds(**finds_of(finds, "row_ord")).select("kind", F.col("id").cast("long").alias("row_ord"))


@query(f"WITH {_TERMS} SELECT 'terms' AS kind, dictionary AS id FROM terms WHERE dictionary <> (SELECT min(title) FROM dicts) UNION ALL SELECT 'titles', title FROM dicts WHERE title <> (SELECT min(title) FROM dicts)")
def dict_delete(spark, sf_dir):
    terms, dicts = dictionary_tables(spark, sf_dir)
    title = dicts.agg(F.min("title")).first()[0]
    left, _, titles = D.delete_dictionary(terms, spark.createDataFrame([], A.KANJI), dicts, title)
    return kinds(terms=left.select("dictionary"), titles=titles.select("title"))


@query(f"WITH {_TERMS} SELECT 'reading' AS kind, CAST(row_ord AS VARCHAR) AS id FROM terms WHERE reading = 'the' UNION ALL SELECT 'term', CAST(row_ord AS VARCHAR) FROM terms WHERE term = 'The' UNION ALL SELECT 'kanji', CAST(doc_id AS VARCHAR) FROM documents WHERE source IS NOT NULL AND text IS NOT NULL AND doc_id % 3 = 0")
def dict_lookups(spark, sf_dir):
    terms, _ = dictionary_tables(spark, sf_dir)
    kanji = Z.parse_kanji(kanji_files(spark, sf_dir))
    return kinds(reading=D.lookup_reading(terms, "the").select("row_ord"), term=D.lookup_term(terms, "The").select("row_ord"), kanji=D.lookup_kanji(kanji, "風").select(F.col("stats")["id"]))


_ABBREVIATIONS = fx.Derived(fx.Fixture("asked string", (("大辞林4",), ("g6",), ("readers",), ("none such",))), "supplier", "s_suppkey")


@query(f"SELECT n, asked, ja_title FROM {_ABBREVIATIONS.sql('d')} JOIN (VALUES (0, '大辞林 第四版'), (1, 'ジーニアス英和辞典 第6版'), (2, '研究社 リーダーズ英和辞典 第3版')) AS t(k, ja_title) ON t.k = d.k")
def meta_by_abbreviation(spark, sf_dir):
    """Metadata of the abbreviations that suppliers stand for; those that are unknown have none."""
    return D.meta_for_abbreviations(_ABBREVIATIONS.over(spark, sf_dir), D.meta_table(spark), "asked").select("n", "asked", "ja_title")


_CONTENT = fx.Derived(fx.Fixture(
    "n int, body string",
    tuple(
        enumerate(
            json.dumps(x, ensure_ascii=False)
            for x in (
                "plain", ["a", {"tag": "b", "content": "c"}, None, 5], {"type": "structured-content", "content": [{"tag": "li", "content": ["x", {"tag": "i", "text": "y"}]}, "z"]}, {"type": "text", "text": "own"},
                {"data": "spare"}, {"type": "image", "path": "p"}, {"tag": "ruby", "content": {"tag": "rt", "content": "lost"}},
            )
        )
    ),
), "documents", "doc_id")


@query(fx.over(_CONTENT, "SELECT * FROM (VALUES (0, 'plain'), (1, 'ac'), (2, 'xyz'), (3, 'own'), (4, 'spare'), (5, ''), (6, '')) AS t(n, text)"))
def structured_content(spark, sf_dir):
    return _CONTENT.over(spark, sf_dir).select("n", D.content_text("body").alias("text"))


@query(
    f"""WITH {_TERMS} SELECT dictionary, term, row_ord, 1 AS sense_no, '①' AS label, 'text' AS type, md5(text) AS digest, regexp_matches(text, '▶|e\\.g\\.|例:') AS is_example FROM terms"""
)
def sense_examples(spark, sf_dir):
    terms, _ = dictionary_tables(spark, sf_dir)
    return D.senses(terms).select("dictionary", "term", "row_ord", "sense_no", "label", "type", F.md5("text").alias("digest"), "is_example")


@query(
    f"""WITH {_TERMS}, o AS (SELECT min(title) AS title FROM dicts), t AS (SELECT terms.* FROM terms JOIN o ON dictionary = title), q AS (SELECT * FROM (VALUES ('The', 'the'), ('the', 'the')) AS v(query, w)),
    hits AS (SELECT query, w, t.*, CASE WHEN starts_with(term, query) THEN 1 ELSE 2 END AS rank FROM t, q WHERE starts_with(term, query) OR starts_with(reading, query)),
    once AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query, term, reading ORDER BY rank, row_ord) = 1)
    SELECT query, row_ord, term, reading, CAST(CASE WHEN lower(trim(term)) = w THEN 100 WHEN starts_with(lower(trim(term)), w) THEN 80 END AS INTEGER) AS score FROM once"""
)
def dict_search_one(spark, sf_dir):
    """Searches within one dictionary, by term, and by reading too: every hit."""
    terms, dicts = dictionary_tables(spark, sf_dir)
    only = dicts.agg(F.min("title")).first()[0]
    found = lambda q: D.search(terms, dicts, D.DictionaryOptions(q, dictionaries=(only,), max_results=1_000_000)).select(F.lit(q).alias("query"), "row_ord", "term", "reading", "score")
    return found("The").unionByName(found("the"))


@query(
    f"""WITH {_TERMS}, t AS (SELECT row_ord, lower(trim(term)) AS w, lower(trim(text)) AS d FROM terms)
    SELECT row_ord, CAST(CASE WHEN w = 'he' THEN 100 WHEN starts_with(w, 'he') THEN 80 WHEN contains(w, 'he') THEN 60 WHEN contains(d, 'he') THEN 40 ELSE 0 END AS INTEGER) AS score FROM t"""
)
def dict_score_levels(spark, sf_dir):
    """The score of every term, hits or not: equal, prefix, within, in the definition."""
    terms, _ = dictionary_tables(spark, sf_dir)
    return terms.select("row_ord", D.term_score("he").alias("score"))


_READ = fx.Derived(fx.Fixture("term string, reading string", (("かぜ", "x"), ("風", "かぜ"), ("かぜぐすり", "y"), ("風邪薬", "かぜぐすり"), ("はるかぜ", "z"), ("春風", "はるかぜ"), ("雨", "あめ"))), "documents", "doc_id")


@query(fx.over(_READ, "SELECT * FROM (VALUES (0, 100), (1, 95), (2, 80), (3, 75), (4, 60), (5, 55), (6, 0)) AS t(n, score)"))
def dict_score_readings(spark, sf_dir):
    return _READ.over(spark, sf_dir).select("n", D.term_score("かぜ").alias("score"))


_ASKED = fx.Derived(fx.texts("風", "wind", "wind 風", "カゼa", "x1", "123"))


@query(fx.over(_ASKED, "SELECT * FROM (VALUES (0, false), (1, true), (2, false), (3, false), (4, true), (5, false)) AS t(n, english)"))
def english_queries(spark, sf_dir):
    return _ASKED.over(spark, sf_dir).select("n", D.english_query(F.col("text")).alias("english"))


# ------------------------------------------------------------------ a catalogue from the data

#: Words of nine letters, as a catalogue of markers; one that could overlap with itself isn't taken.
_NINE = "(?<![a-z])[a-z]{9}(?![a-z])"


@query(
    """WITH w AS (SELECT DISTINCT unnest(string_split(regexp_replace(text, '[^a-z]+', ' ', 'g'), ' ')) AS word FROM documents),
    c AS (SELECT word FROM w WHERE length(word) = 9 AND len(list_filter(range(1, 9), lambda k: left(word, k) = right(word, k))) = 0),
    g AS (SELECT doc_id, unnest(range(1, length(text) - 7)) AS i, text FROM documents) SELECT doc_id, word AS pattern, CAST(i - 1 AS INTEGER) AS start, CAST(i + 8 AS INTEGER) AS "end" FROM (SELECT doc_id, i, substr(text, i, 9) AS gram FROM g) JOIN c ON gram = word"""
)
def catalogue_scan(spark, sf_dir):
    """Every place of every nine-letter word of the documents, by a catalogue file with a specification for each."""
    docs, path = read(spark, sf_dir, "documents"), shared_path(spark, "catalogue")
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(_NINE), F.lit(0))).alias("word")).distinct()
    free = words.where(~F.exists(F.array(*[F.left("word", F.lit(k)) == F.right("word", F.lit(k)) for k in range(1, 9)]), lambda x: x))
    same = [F.lit("").alias(c) for c in ("head", "collocate", "label", "head_pos", "collocate_pos")]
    rows = free.select(F.col("word").alias("pattern"), F.concat(F.lit("("), "word", F.lit(")")).alias("expression"), F.lit("words").alias("family"), *same, F.lit(50).alias("confidence"))
    rows.withColumn("spec_id", F.monotonically_increasing_id()).write.json(path)
    return Y.extract_by_catalogue(docs, "doc_id", Y.read_catalogue(spark, path)).select("doc_id", "pattern", "start", "end")


# ------------------------------------------------------------------ library, words

_MARKS = "m AS (SELECT CAST(event_id AS VARCHAR) AS id, event_type AS term, 'T' || user_id AS dictionary, event_id AS saved_at, '' AS folder FROM events)"
_SAVED = f"""{_MARKS}, old AS (SELECT * FROM m WHERE saved_at % 50 = 0 QUALIFY row_number() OVER (PARTITION BY term, dictionary ORDER BY saved_at) = 1),
  b AS (SELECT * FROM old UNION ALL SELECT * FROM m WHERE saved_at % 50 <> 0 AND (term, dictionary) NOT IN (SELECT (term, dictionary) FROM old) QUALIFY row_number() OVER (PARTITION BY term, dictionary ORDER BY saved_at) = 1)"""


def bookmarks(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All events as bookmarks, those that are there from the start, and those with what the rest adds."""
    event = F.col("event_id")
    marks = read(spark, sf_dir, "events").select(event.cast("string").alias("id"), F.col("event_type").alias("term"), F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("dictionary"), event.alias("saved_at"), F.lit("").alias("folder"))
    first = B.add_bookmarks(marks.limit(0), marks.where("saved_at % 50 = 0"))
    return marks, first, B.add_bookmarks(first, marks.where("saved_at % 50 <> 0"))


@query(f"WITH {_SAVED} SELECT id, term, dictionary FROM b")
def bookmarks_add_distinct(spark, sf_dir):
    return bookmarks(spark, sf_dir)[2].select("id", "term", "dictionary")


@query("SELECT a.p_partkey AS id, 1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name))::DOUBLE AS similarity FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def similarity_of_neighbours(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    other = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return part.join(other, "p_partkey").select(F.col("p_partkey").alias("id"), T.similarity(F.col("p_name"), F.col("other")).alias("similarity"))


@query(f"WITH {_SAVED} SELECT m.id, b.id IS NOT NULL AS bookmarked FROM m LEFT JOIN (SELECT * FROM b WHERE id <> '0') b USING (term, dictionary)")
def bookmark_flags(spark, sf_dir):
    """Bookmarks are added, one is removed, and hits are flagged."""
    hits, _, saved = bookmarks(spark, sf_dir)
    return B.with_bookmark_flag(hits, B.remove_bookmark(saved, "0")).select("id", "bookmarked")


@query(f"WITH {_SAVED} SELECT id, saved_at FROM b")
def bookmarks_newest_first(spark, sf_dir):
    return B.newest_bookmarks(bookmarks(spark, sf_dir)[2]).select("id", "saved_at")


@query("WITH w AS (SELECT p_partkey, unnest([p_name, p_brand, p_type]) AS word, unnest([0, 1, 2]) AS ord FROM part) SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY ord) - 1 AS INTEGER) AS ord, word FROM w")
def word_list_parse(spark, sf_dir):
    """A list for each part, with blanks and repetitions."""
    typed = F.concat(F.lit(" "), "p_name", F.lit(", "), "p_brand", F.lit(" ,,"), "p_name", F.lit(", "), "p_type", F.lit(" , "))
    return K.word_lists(read(spark, sf_dir, "part").select("p_partkey", typed.alias("text")), "p_partkey")


_WORDS = fx.Derived(fx.Fixture("word string", ((" 風 ",), ("",), ("none such",), ("風",), ("雨",))), "pages", "page_id")


@query(
    f"""WITH w AS (SELECT n, trim(word) || ':' || n % 7 AS word FROM {_WORDS.sql('d')} WHERE trim(word) <> ''), p AS (SELECT n, '風:' || n % 11 AS word, k FROM {fx.SCRAPED.sql('d')}), q AS (SELECT DISTINCT word FROM w),
    r AS (SELECT p.n, p.k, q.word FROM q JOIN p USING (word)) SELECT 'entry' AS kind, word || ':' || n || ':' || t.collocate AS id FROM r JOIN (VALUES (0, 'が吹く'), (1, 'の中'), (1, 'よく')) AS t(k, collocate) ON t.k = r.k
    UNION ALL SELECT 'missing', word FROM q WHERE word NOT IN (SELECT word FROM p)"""
)
def scrape_queue(spark, sf_dir):
    """Words with and without pages."""
    words = _WORDS.over(spark, sf_dir).select(F.col("n").alias("ord"), F.when(F.trim("word") != "", F.concat(F.trim("word"), F.lit(":"), (F.col("n") % 7).cast("string"), F.lit(" "))).otherwise(F.col("word")).alias("word"))
    pages = fx.SCRAPED.over(spark, sf_dir).select(F.concat(F.lit("風:"), (F.col("n") % 11).cast("string")).alias("word"), F.col("n").alias("page_id"), "html")
    entries, missing = P.scrape(words, pages)
    return kinds(entry=entries.select(F.concat_ws(":", "headword", "page_id", "collocate")), missing=missing.select("word"))


# ------------------------------------------------------------------ discourse

_LABELLED = f"{_SPLIT}, {_labels_sql('bits')}, z AS (SELECT *, {_CATEGORY_SQL} AS category FROM lab)"


def _marked(spark, sf_dir) -> DataFrame:
    return G.split_bits(fx.marked_graphs(spark, sf_dir))


@query(f"WITH {_TURNS}, {_rules_sql('turns')}, best AS (SELECT graph_id, bit_idx, arg_max(type, confidence * 1000 - rank) AS rule_id FROM hits GROUP BY 1, 2) SELECT rule_id, count(*) AS n FROM best GROUP BY 1")
def rule_hit_counts(spark, sf_dir):
    """Hits of each rule over all conversations; the seed rules are named after their types."""
    labelled = G.label_bits(fx.marked_turns(spark, sf_dir))
    types = {r.id: r.type for r in G.seed_rules().all()}
    named = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    return G.rule_hit_counts(labelled).select(F.element_at(named, F.col("rule_id")).alias("rule_id"), "n")


@query(f"WITH {_LABELLED} SELECT graph_id, bit_idx, text, {_COLOUR_SQL} AS colour, bit_type FROM z")
def coloured_tokens(spark, sf_dir):
    return G.coloured_tokens(G.label_bits(_marked(spark, sf_dir)))


@query(f"WITH {_LABELLED}, c AS (SELECT graph_id, bit_type, category, count(*) AS n FROM z GROUP BY 1, 2, 3) SELECT graph_id, bit_type, n, {_COLOUR_SQL} AS colour FROM c")
def summary_colours(spark, sf_dir):
    return G.summary_table(G.label_bits(_marked(spark, sf_dir))).select("graph_id", "bit_type", "n", "colour")


#: The evidence of each rule that names a target: what it found in the bit.
_EVIDENCE = f"""CASE relationship_type WHEN 'sequential-adjacency' THEN 'adjacent bits' WHEN 'discontinuous-parallel' THEN regexp_extract(text, '{G.LISTING}')
  WHEN 'epistemic-speculation-cascade' THEN trim(text) END"""


@query(f"WITH {_SPLIT}, {_rules_sql('bits')}, {_EDGES_SQL} SELECT graph_id, edge_ord, 'forward' AS direction, {_EVIDENCE} AS evidence FROM edges JOIN bits USING (graph_id) WHERE bit_idx = src_idx")
def edge_details(spark, sf_dir):
    return G.edges(_marked(spark, sf_dir)).select("graph_id", "edge_ord", "direction", F.array_join("evidence", ",").alias("evidence"))


@query(f"WITH {_LABELLED}, {_EDGES_SQL} SELECT 'bits' AS kind, graph_id || ':' || bit_idx || ':' || bit_type AS id FROM z UNION ALL SELECT 'edges', graph_id || ':' || edge_ord || ':' || dst_idx FROM edges")
def analyze_graphs(spark, sf_dir):
    """Bits, edges and cascades of whole graphs at once (these graphs have no cascade)."""
    labelled, found, cascades = G.analyze(fx.marked_graphs(spark, sf_dir))
    return kinds(bits=labelled.select(F.concat_ws(":", "graph_id", "bit_idx", "bit_type")), edges=found.select(F.concat_ws(":", "graph_id", "edge_ord", "dst_idx")), cascades=cascades.select("graph_id"))


@query(
    f"""WITH {_TURNS}, {_labels_sql('turns')}, z AS (SELECT lab.*, {_CATEGORY_SQL} AS category, speaker FROM lab JOIN turns USING (graph_id, bit_idx))
    SELECT 'structural' AS kind, graph_id || ':' || bit_idx AS id FROM z WHERE category = 'structural' UNION ALL SELECT 'speaker', graph_id || ':' || bit_idx FROM z WHERE speaker = 'user' AND category = 'hedging'
    UNION ALL SELECT 'group', graph_id || ':' || bit_idx FROM z"""
)
def context_lookups(spark, sf_dir):
    """Labelled turns as context records, by category, speaker, group and (never) function."""
    records = G.context_records(G.label_bits(fx.marked_turns(spark, sf_dir)), "chat", "all")
    name = F.concat_ws(":", "graph_id", "bit_idx")
    finds = {
        "structural": K.context_by(records, category="structural"), "speaker": K.context_by(records, speaker="user", category="hedging"), "group": K.context_by(records, group="all"), "function": K.context_by(records, function="x"),
    }
    return kinds(**{kind: df.select(name) for kind, df in finds.items()})


@query(f"WITH {_LABELLED} SELECT graph_id, bit_idx, category FROM z WHERE category IN ('hedging', 'epistemic', 'interactional', 'causal-logical', 'enumerative', 'referential', 'stance', 'structural')")
def contexts_by_category(spark, sf_dir):
    ordered = K.by_all_categories(G.context_records(G.label_bits(_marked(spark, sf_dir)), "fixture"))
    return ordered.select("graph_id", "bit_idx", "category")


@query(
    f"""WITH {_TURNS}, {_rules_sql('turns')}, best AS (SELECT graph_id, bit_idx, arg_max(type, confidence * 1000 - rank) AS type FROM hits GROUP BY 1, 2), n AS (SELECT type, count(*) AS n FROM best GROUP BY 1)
    SELECT 'seed-' || type AS id, type, CASE WHEN type = 'connector-compounding' THEN 'a new description' ELSE '' END AS description, CASE WHEN type = 'connector-compounding' THEN 'まあ,だから' ELSE '' END AS examples, CAST(n AS INTEGER) AS hit_count
    FROM n WHERE type <> 'perspective-framing' UNION ALL SELECT 'shout', 'own', '', '', 0"""
)
def rule_registry(spark, sf_dir):
    """The hits of all conversations are counted into the rules, which are registered, removed, saved and loaded."""
    none = lambda c: G.Hit(F.lit(None).cast("double"), F.array().cast("array<string>"))
    rules = G.seed_rules()
    rules.register(G.Rule("shout", "own", 5, none))
    rules.unregister("seed-perspective-framing")
    saved = [r | {"description": "a new description", "examples": ["まあ", "だから"]} if r["type"] == "connector-compounding" else r for r in json.loads(rules.serialize())]
    rules.deserialize(json.dumps([*saved, {"id": "unknown", "type": "own"}]))
    rules.count_hits(G.rule_hit_counts(G.label_bits(fx.marked_turns(spark, sf_dir))))
    rows = [(r.id, r.type, r.description, ",".join(r.examples), r.hit_count) for r in rules.all() if r.hit_count or r.id == "shout"]
    return spark.createDataFrame(rows, "id string, type string, description string, examples string, hit_count int")


@query(f"WITH {_TURNS} SELECT DISTINCT 'from ' || speaker AS name FROM turns UNION ALL SELECT * FROM (VALUES " + ", ".join(f"('{t}')" for t in G.CATEGORY if t not in (G.ADJACENT, G.UNKNOWN)) + ") AS u(type)")
def relation_registry(spark, sf_dir):
    """The built-in relation types, and one for each role that conversations have, registered twice."""
    relations = G.Relations()
    for _ in range(2):
        for r in fx.marked_turns(spark, sf_dir).select("speaker").distinct().collect():
            relations.register(f"from {r['speaker']}")
    return spark.createDataFrame([(n,) for n in relations.all() if relations.has(n)], "name string")


# ------------------------------------------------------------------ streams


@query(f"WITH {LEX} SELECT id, full_phrase, frequency FROM lex WHERE CAST(id AS BIGINT) % 2 = 1 UNION ALL SELECT id, full_phrase, frequency + 1000 FROM lex WHERE CAST(id AS BIGINT) % 2 = 0")
def stream_upserts(spark, sf_dir):
    """The lexicon arrives as a stream of files; half of the entries come again, changed."""
    source, target = shared_path(spark, "incoming"), shared_path(spark, "snapshots")
    lex = lexicon(spark, sf_dir)
    for step, rows in enumerate((lex, lex.where("CAST(id AS BIGINT) % 2 = 0").withColumn("frequency", F.col("frequency") + 1000))):
        rows.write.mode("append").json(source)
        ingest.upsert_into(ingest.read_entries(spark, source), target, f"{target}-checkpoint").awaitTermination()
    return ingest.latest_snapshot(spark, target).select("id", "full_phrase", "frequency")


@query(f"WITH {LEX} SELECT id, full_phrase, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN frequency + 1000 ELSE frequency END AS frequency, CAST(CASE WHEN CAST(id AS BIGINT) % 10 = 4 THEN 1 ELSE 0 END AS BIGINT) AS batch FROM lex WHERE CAST(id AS BIGINT) % 10 <> 6")
def stream_delta_upserts(spark, sf_dir):
    """The same by buckets, with a compaction between the batches; some ids are deleted, and some of these come again."""
    source = shared_path(spark, "incoming")
    store = DeltaStore(spark, shared_path(spark, "deltas"), buckets=8)
    lex = lexicon(spark, sf_dir)
    lex.write.mode("append").json(source)
    store.follow(ingest.read_entries(spark, source), f"{store.path}/checkpoint").awaitTermination()
    store.compact()
    store.delete(lex.where("CAST(id AS BIGINT) % 10 IN (4, 6)"), 1)
    store.upsert(lex.where("CAST(id AS BIGINT) % 2 = 0 AND CAST(id AS BIGINT) % 10 <> 6").withColumn("frequency", F.col("frequency") + 1000), 2)
    return store.read().select("id", "full_phrase", "frequency", F.when(F.shiftright("ord", 40) > 0, 1).otherwise(0).cast("long").alias("batch"))


@query("WITH h AS (SELECT event_type || ':' || user_id AS query, max(struct_pack(ts := ts, ord := event_id)) AS last FROM events GROUP BY 1) SELECT query, last.ord AS ord FROM h ORDER BY last.ts DESC, last.ord DESC LIMIT 100")
def history_stream(spark, sf_dir):
    """The most recent queries of all events, which arrive in two files, the later ones first."""
    source, target = shared_path(spark, "asked"), shared_path(spark, "recent")
    log = A.history_from_events(read(spark, sf_dir, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    for part in ("ord % 3 = 2", "ord % 3 <> 2"):
        log.where(part).write.mode("append").parquet(source)
        lists = history.most_recent(spark.readStream.schema(log.schema).parquet(source))
        history.keep_history(lists, target, f"{target}-checkpoint").awaitTermination()
    return history.recent(spark, target).select("query", "ord")
