"""Registered queries of the engine, by name, and the DuckDB SQL that must give the same rows.

Every query runs over its whole table; limits are those that belong to an operator (the
caps of a search).  Japanese semantics are checked on inline fixtures that both engines read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import classify as C
from .functions import text as T
from .functions import words as L
from .operators import dictionary as D
from .operators import discourse as G
from .operators import library as B
from .operators import parse as P
from .operators import patterns as X
from .operators import search as S
from .operators import store as K
from .plans import fixtures as fx
from .plans.fixtures import over
from .plans import schemas as A
from .sources import dictionary_bank as Z
from .sources import lexicon as I

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.lexicon_from_part(read(spark, sf_dir, "part"))


LEX = """lex AS (SELECT CAST(p_partkey AS VARCHAR) AS id, split_part(p_name, ' ', 1) AS headword, regexp_replace(p_name, '^[^ ]* ?', '') AS collocate,
  p_name AS full_phrase, p_type AS headword_pos, p_brand AS collocate_pos, p_type || '+' || p_brand AS pattern,
  CASE WHEN p_partkey % 3 = 0 THEN 'import' ELSE 'manual' END AS source, [p_brand, p_type] AS tags, CAST(p_size AS INTEGER) AS frequency,
  1700000000000 + p_partkey AS created_at, 1700000000000 + p_partkey * 7 % 1000 AS updated_at, p_partkey AS ord,
  list_filter([split_part(p_name, ' ', 1), regexp_replace(p_name, '^[^ ]* ?', ''), p_name, p_type || '+' || p_brand, p_brand, p_type], lambda f: len(f) > 0) AS fields
  FROM part)"""
SHOWN = ["id", "full_phrase", "frequency", "score"]
_PICK = "SELECT id, full_phrase, frequency, score FROM s"
_DEFAULT = "ORDER BY frequency DESC, score DESC, ord"


def direct_sql(term: str) -> str:
    return f"list_max(list_transform(fields, lambda f: CASE WHEN contains(f, '{term}') THEN CASE WHEN f = headword OR f = full_phrase THEN 100 ELSE 80 END ELSE 0 END))"


def fuzzy_sql(term: str) -> str:
    n = len(term)
    whole = f"1 - levenshtein(f, '{term}') / greatest(len(f), {n})::DOUBLE"
    near = f"list_transform(range(1, len(f) - {n} + 2), lambda i: 1 - levenshtein(substr(f, i, {n}), '{term}') / {n}::DOUBLE)"
    return f"""list_max(list_transform(fields, lambda f: greatest(CASE WHEN {whole} > 0.5 THEN CAST(floor(({whole}) * 60 + 0.5) AS INTEGER) ELSE 0 END,
      coalesce(list_max(list_transform({near}, lambda x: CASE WHEN x > 0.7 THEN CAST(floor(x * 65 + 0.5) AS INTEGER) ELSE 0 END)), 0))))"""


def scored_sql(score: str, where: str = "true", tail: str = f"{_DEFAULT} LIMIT 100") -> str:
    return f"WITH {LEX}, s AS (SELECT *, CAST({score} AS INTEGER) AS score FROM lex WHERE {where}) {_PICK} WHERE score > 0 {tail}"


def both_sql(term: str) -> str:
    return f"greatest({direct_sql(term)}, {fuzzy_sql(term)})"


# ------------------------------------------------------------------ search


@query(scored_sql(both_sql("ring"), tail=f"{_DEFAULT} LIMIT 20"))
def search_contains(spark, sf_dir):
    return S.quick_search(lexicon(spark, sf_dir), "ring").select(SHOWN)


@query(scored_sql(direct_sql("ring"), "(headword_pos IN ('PROMO') OR collocate_pos IN ('PROMO')) AND list_has_any(tags, ['Brand#1', 'Brand#2', 'PROMO']) AND source IN ('manual') AND contains(pattern, 'Brand')"))
def search_contains_filtered(spark, sf_dir):
    o = S.SearchOptions("ring", pos=("PROMO",), tags=("Brand#1", "Brand#2", "PROMO"), sources=("manual",), pattern="Brand", fuzzy=False)
    return S.search(lexicon(spark, sf_dir), o).select(SHOWN)


@query(f"WITH {LEX}, s AS (SELECT *, frequency AS score FROM lex) {_PICK} {_DEFAULT} LIMIT 100")
def search_blank_default_sort(spark, sf_dir):
    return S.search(lexicon(spark, sf_dir), S.SearchOptions("  ")).select(SHOWN)


@query(scored_sql("list_max(list_transform(fields, lambda f: CASE WHEN regexp_full_match(f, 's.*l.r.*', 'i') THEN 90 ELSE 0 END))", tail=""))
def search_wildcard(spark, sf_dir):
    return S.search(lexicon(spark, sf_dir), S.SearchOptions("S*l?r*", fuzzy=False, max_results=None)).select(SHOWN)


@query(scored_sql(both_sql("smal rong"), tail=""))
def search_fuzzy_whole(spark, sf_dir):
    return S.search(lexicon(spark, sf_dir), S.SearchOptions("smal rong", max_results=None)).select(SHOWN)


@query(scored_sql(both_sql("widgit"), tail=""))
def search_fuzzy_window(spark, sf_dir):
    return S.search(lexicon(spark, sf_dir), S.SearchOptions("widgit", max_results=None)).select(SHOWN)


@query(scored_sql(direct_sql("bolt"), tail="ORDER BY headword, score DESC, ord LIMIT 50"))
def search_sort_headword(spark, sf_dir):
    return S.search(lexicon(spark, sf_dir), S.SearchOptions("bolt", fuzzy=False, sort_by="headword", max_results=50)).select(SHOWN)


@query(scored_sql(direct_sql("bolt"), tail="ORDER BY updated_at DESC, score DESC, ord LIMIT 50"))
def search_sort_updated(spark, sf_dir):
    return S.search(lexicon(spark, sf_dir), S.SearchOptions("bolt", fuzzy=False, sort_by="updated_at", max_results=50)).select(SHOWN)


@query(scored_sql(direct_sql("bolt"), tail="ORDER BY frequency, score, ord LIMIT 50"))
def search_sort_asc(spark, sf_dir):
    return S.search(lexicon(spark, sf_dir), S.SearchOptions("bolt", fuzzy=False, sort_dir="asc", max_results=50)).select(SHOWN)


_SEEDS = fx.Derived(fx.Fixture("id string", tuple((row[0],) for row in I.SEED)))


@query(
    f"""SELECT q, CAST(n AS VARCHAR) AS id, CAST(score AS INTEGER) AS score FROM {_SEEDS.sql('d')} JOIN (VALUES ('風','s001',100), ('かぜ','s001',80), ('カゼ','s001',80), ('kaze','s001',80), ('風*','s001',90), ('目','s010',100), ('目','s011',100),
    ('風を吹く','s001',49)) AS t(q, seed, score) ON seed = d.id"""
)
def search_ja_fixture(spark, sf_dir):
    """Japanese queries over a lexicon in which every part has the words of a seed entry."""
    named = _SEEDS.over(spark, sf_dir).select("n", "id")
    lex = named.join(F.broadcast(I.seed(spark)), "id").withColumn("id", F.col("n").cast("string")).withColumn("ord", F.col("n")).drop("n")
    out = None
    for q in ("風", "かぜ", "カゼ", "kaze", "風*", "目", "風を吹く"):
        hits = S.search(lex, S.SearchOptions(q, max_results=None)).select(F.lit(q).alias("q"), "id", "score")
        out = hits if out is None else out.unionByName(hits)
    return out


# ------------------------------------------------------------------ store


@query(f"WITH {LEX} SELECT id, full_phrase FROM lex WHERE headword_pos IN ('PROMO', 'Brand#3') OR collocate_pos IN ('PROMO', 'Brand#3')")
def filter_pos(spark, sf_dir):
    return S.filtered(lexicon(spark, sf_dir), S.SearchOptions(pos=("PROMO", "Brand#3"))).select("id", "full_phrase")


@query(f"WITH {LEX} SELECT id, full_phrase FROM lex WHERE list_has_any(tags, ['Brand#3', 'LARGE'])")
def filter_tag(spark, sf_dir):
    return S.filtered(lexicon(spark, sf_dir), S.SearchOptions(tags=("Brand#3", "LARGE"))).select("id", "full_phrase")


@query(f"WITH {LEX} SELECT id, full_phrase FROM lex WHERE contains(pattern, 'ARD+')")
def filter_pattern(spark, sf_dir):
    return S.filtered(lexicon(spark, sf_dir), S.SearchOptions(pattern="ARD+")).select("id", "full_phrase")


@query(f"WITH {LEX} SELECT id, full_phrase FROM lex WHERE source IN ('import')")
def filter_source(spark, sf_dir):
    return S.filtered(lexicon(spark, sf_dir), S.SearchOptions(sources=("import",))).select("id", "full_phrase")


@query(f"WITH {LEX} SELECT 'headword' AS kind, id FROM lex WHERE headword = 'red' UNION ALL SELECT 'pos', id FROM lex WHERE headword_pos = 'PROMO' UNION ALL SELECT 'pattern', id FROM lex WHERE pattern = 'PROMO+Brand#1' UNION ALL SELECT 'tag', id FROM lex WHERE list_contains(tags, 'Brand#1') UNION ALL SELECT 'id', id FROM lex WHERE id = '7'")
def lookup_headword(spark, sf_dir):
    lex = lexicon(spark, sf_dir)
    finds = {"headword": K.by_headword(lex, "red"), "pos": K.by_pos(lex, "PROMO"), "pattern": K.by_pattern(lex, "PROMO+Brand#1"), "tag": K.by_tag(lex, "Brand#1"), "id": K.by_id(lex, "7")}
    out = [df.select(F.lit(k).alias("kind"), "id") for k, df in finds.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).unionByName(out[4])


@query(f"WITH {LEX} SELECT 'total' AS kind, '' AS key, count(*) AS n FROM lex UNION ALL SELECT 'pos', headword_pos, count(*) FROM lex GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM lex GROUP BY 2")
def store_stats_grouping_sets(spark, sf_dir):
    return K.stats(lexicon(spark, sf_dir))


@query(f"WITH {LEX} SELECT DISTINCT unnest(tags) AS tag FROM lex")
def tags_distinct(spark, sf_dir):
    return K.all_tags(lexicon(spark, sf_dir))


@query(f"WITH {LEX} SELECT DISTINCT pattern FROM lex")
def patterns_distinct(spark, sf_dir):
    return K.all_patterns(lexicon(spark, sf_dir))


@query(f"WITH {LEX}, e AS (SELECT DISTINCT unnest(tags) AS key, id, ord FROM lex) SELECT key, string_agg(id, ',' ORDER BY ord) AS ids FROM e GROUP BY key")
def inverted_index_tags(spark, sf_dir):
    return K.inverted_index(lexicon(spark, sf_dir), "tags").select("key", F.array_join("ids", ",").alias("ids"))


@query(f"WITH {LEX} SELECT headword AS key, string_agg(id, ',' ORDER BY ord) AS ids FROM lex GROUP BY headword")
def inverted_index_headword(spark, sf_dir):
    return K.inverted_index(lexicon(spark, sf_dir), "headword").select("key", F.array_join("ids", ",").alias("ids"))


@query(
    f"""WITH {LEX}, b AS (SELECT * FROM {fx.LEXICON_BATCH.sql()}), top AS (SELECT max(ord) AS t FROM lex),
    l AS (SELECT id, arg_max(frequency, ord) AS frequency, min(ord) AS first FROM b GROUP BY id)
    SELECT lex.id, coalesce(l.frequency, lex.frequency) AS frequency, lex.ord FROM lex LEFT JOIN l USING (id)
    UNION ALL SELECT l.id, l.frequency, t + 1 + first FROM l, top WHERE l.id NOT IN (SELECT id FROM lex)"""
)
def upsert_last_wins(spark, sf_dir):
    store = lexicon(spark, sf_dir).select("id", "frequency", "ord")
    return K.upsert(store, fx.LEXICON_BATCH.spark(spark))


@query(f"WITH {LEX} SELECT id, ord FROM lex WHERE id NOT IN (SELECT id FROM {fx.LEXICON_BATCH.sql()})")
def delete_by_id(spark, sf_dir):
    return K.delete(lexicon(spark, sf_dir).select("id", "ord"), fx.LEXICON_BATCH.spark(spark))


@query(f"WITH {LEX} SELECT count(*) + 2 AS n_rows, CAST(6 AS BIGINT) AS n_imported FROM lex")
def bulk_import_count(spark, sf_dir):
    store, n = K.bulk_import(lexicon(spark, sf_dir).select("id", "frequency", "ord"), fx.LEXICON_BATCH.spark(spark))
    return store.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_imported", F.lit(n).cast("long"))


_FORM = fx.Fixture("headword string, collocate string, full_phrase string, tags string, examples string", ((" 風 ", "が吹く", "", "自然, 天気 ,", "a\n\n b "), ("", "x", "y", "", ""), ("雨", "が降る", "雨降る", "", ""), ("雪", " ", "雪", "a", "b")))
_FORMS = fx.Derived(_FORM)


@query(f"SELECT v.* EXCLUDE (k), n AS p_partkey FROM {_FORMS.sql('d')} JOIN (VALUES (0,'風','が吹く','風が吹く','自然|天気','a|b'), (2,'雨','が降る','雨降る','','')) AS v(k, headword, collocate, full_phrase, tags, examples) ON v.k = d.k")
def form_entries(spark, sf_dir):
    return K.form_entry(_FORMS.over(spark, sf_dir).withColumnRenamed("n", "p_partkey"), "p_partkey").withColumn("tags", F.array_join("tags", "|")).withColumn("examples", F.array_join("examples", "|"))


# ------------------------------------------------------------------ text kernel


@query(f"SELECT n, translate(text, '{T.KATAKANA}', '{T.HIRAGANA}') AS hira, translate(text, '{T.HIRAGANA}', '{T.KATAKANA}') AS kata, regexp_replace(text, '[^ぁ-ゖァ-ヶ]', '', 'g') AS reading FROM {fx.KANA.sql()}")
def kana_convert(spark, sf_dir):
    c = F.col("text")
    return fx.KANA.over(spark, sf_dir).select("n", T.to_hiragana(c).alias("hira"), T.to_katakana(c).alias("kata"), T.get_reading(c).alias("reading"))


_ROMAJI_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in T.ROMAJI.items()) + "}"


def _romaji_sql(c: str) -> str:
    return f"list_reduce(list_prepend('', list_transform(regexp_extract_all(lower({c}), '{T.ROMAJI_TOKEN}'), lambda x: coalesce({_ROMAJI_MAP}[x], x))), lambda a, b: a || b)"


@query(f"SELECT n, {_romaji_sql('text')} AS kana FROM {fx.ROMAJI.sql()}")
def romaji_to_hiragana(spark, sf_dir):
    return fx.ROMAJI.over(spark, sf_dir).select("n", T.romaji_to_hiragana(F.col("text")).alias("kana"))


@query(f"SELECT p_partkey, {_romaji_sql('p_name')} AS kana FROM part")
def romaji_part_names(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.romaji_to_hiragana(F.col("p_name")).alias("kana"))


@query(
    f"""SELECT n, regexp_matches(text, '[\\x{{3000}}-\\x{{9fff}}\\x{{ff00}}-\\x{{ffef}}]') AS ja, regexp_matches(text, '^[ぁ-ゖ]') AS hira, regexp_matches(text, '^[ァ-ヶ]') AS kata,
    regexp_matches(text, '^[\\x{{4e00}}-\\x{{9faf}}\\x{{3400}}-\\x{{4dbf}}]') AS kanji FROM {fx.KANA.sql()}"""
)
def is_japanese(spark, sf_dir):
    c = F.col("text")
    return fx.KANA.over(spark, sf_dir).select("n", T.is_japanese(c).alias("ja"), T.is_hiragana(c).alias("hira"), T.is_katakana(c).alias("kata"), T.is_kanji(c).alias("kanji"))


@query(over(fx.WIDTH, "SELECT * FROM (VALUES (0, 'ABC 12', 'ABC 12'), (1, 'abc!', 'abc!'), (2, 'abc', 'abc'), (3, '~', '~')) AS t(n, folded, normal)"))
def width_normalise(spark, sf_dir):
    c = F.col("text")
    return fx.WIDTH.over(spark, sf_dir).select("n", T.fold_width(c).alias("folded"), T.normalize_japanese(c).alias("normal"))


@query("SELECT a.p_partkey, levenshtein(a.p_name, 'small ring') AS distance, 1 - levenshtein(a.p_name, 'small ring') / greatest(len(a.p_name), 10)::DOUBLE AS similarity FROM part a")
def levenshtein_similarity(spark, sf_dir):
    c, w = F.col("p_name"), F.lit("small ring")
    return read(spark, sf_dir, "part").select("p_partkey", F.levenshtein(c, w).cast("long").alias("distance"), T.similarity(c, w).alias("similarity"))


def _endings_sql(stem: str, endings) -> str:
    return "[" + ", ".join(f"{stem} || '{e}'" for e in endings) + "]"


_STEM = "substr(text, 1, len(text) - 1)"
_VERB_CASE = " ".join(f"WHEN right(text, 1) = '{k}' THEN list_concat([text], {_endings_sql(_STEM, (*T.ICHIDAN, *v) if k == 'る' else v)})" for k, v in T.GODAN.items())
_VERB_SQL = f"CASE WHEN text = '' THEN [] {_VERB_CASE} ELSE [text] END"
_ADJ_SQL = f"CASE WHEN right(text, 1) = 'い' THEN {_endings_sql(_STEM, T.I_ADJECTIVE)} ELSE [text] END"


def _unique_sql(array: str) -> str:
    """Distinct texts of an array in order, joined by spaces."""
    return f"array_to_string(list_filter({array}, lambda x, i: list_position({array}, x) = i), ' ')"


@query(f"SELECT n, {_unique_sql(_VERB_SQL)} AS forms FROM {fx.VERBS.sql()}")
def verb_forms(spark, sf_dir):
    return fx.VERBS.over(spark, sf_dir).select("n", F.array_join(T.verb_forms(F.col("text")), " ").alias("forms"))


@query(f"SELECT n, array_to_string({_ADJ_SQL}, ' ') AS forms FROM {fx.ADJECTIVES.sql()}")
def adjective_forms(spark, sf_dir):
    return fx.ADJECTIVES.over(spark, sf_dir).select("n", F.array_join(T.adjective_forms(F.col("text")), " ").alias("forms"))


@query(f"SELECT n, array_to_string({_endings_sql('text', T.NA_ADJECTIVE)}, ' ') AS forms FROM {fx.ADJECTIVES.sql()}")
def na_adjective_forms(spark, sf_dir):
    return fx.ADJECTIVES.over(spark, sf_dir).select("n", F.array_join(T.na_adjective_forms(F.col("text")), " ").alias("forms"))


_EXPAND_SQL = f"list_concat([text], {_ADJ_SQL}, CASE WHEN regexp_matches(text, '[{T.VERB_END}]$') THEN {_VERB_SQL} ELSE [] END)"


@query(f"SELECT n, {_unique_sql(_EXPAND_SQL)} AS forms FROM {fx.EXPAND.sql()}")
def expand_search(spark, sf_dir):
    return fx.EXPAND.over(spark, sf_dir).select("n", F.array_join(T.expand_search(F.col("text")), " ").alias("forms"))


@query(
    f"""SELECT n, CASE WHEN text = '' THEN 'その他' WHEN regexp_matches(text, '[{T.VERB_END}]$') THEN '動詞' WHEN suffix(text, 'い') THEN 'い形容詞'
    WHEN suffix(text, '的') OR suffix(text, 'な') THEN 'な形容詞' WHEN suffix(text, 'に') OR suffix(text, 'と') THEN '副詞' ELSE '名詞' END AS pos FROM {fx.POS.sql()}"""
)
def detect_pos(spark, sf_dir):
    return fx.POS.over(spark, sf_dir).select("n", T.detect_pos(F.col("text")).alias("pos"))


# ------------------------------------------------------------------ classifier

_TX = f"x AS (SELECT n, regexp_replace(text, '^[\\s　]+|[\\s　]+$', '', 'g') AS text FROM {fx.PHRASE_PAIRS.sql()})"


def _like_any(c: str, words) -> str:
    return f"regexp_matches({c}, '{C._any(words)}')"


@query(
    f"""WITH {_TX} SELECT n, CASE WHEN {_like_any('text', L.SLANG)} THEN '俗語' WHEN {_like_any('text', L.DIALECT)} THEN '方言' WHEN {_like_any('text', L.HONORIFIC)} THEN '敬語'
    WHEN regexp_matches(text, '(です|ます|ました|ません|でした)$') THEN '丁寧語'
    WHEN regexp_matches(text, '([{T.VERB_END}]|だ|[いかけがきさしたちなにのはひふへほまみめもやゆよらりれろわ])$') THEN '普通体' END AS register,
    array_to_string(list_filter([CASE WHEN contains(text, 'てる') THEN 'てる→ている' END, CASE WHEN regexp_matches(text, '[^出]でる') OR prefix(text, 'でる') THEN 'でる→でいる' END,
      CASE WHEN contains(text, 'ってた') THEN 'ってた→と言っていた' END, CASE WHEN contains(text, 'てた') AND NOT contains(text, 'ってた') THEN 'てた→ていた' END,
      CASE WHEN contains(text, 'じゃ') THEN 'じゃ→では' END, CASE WHEN contains(text, 'んだ') THEN 'んだ→のだ' END, CASE WHEN contains(text, 'んです') THEN 'んです→のです' END,
      CASE WHEN contains(text, 'っぽい') THEN 'っぽい→らしい' END, CASE WHEN contains(text, 'やっぱ') THEN 'やっぱ→やはり' END], lambda x: x IS NOT NULL), ', ') AS spoken FROM x"""
)
def classify_register(spark, sf_dir):
    t = T.trim(F.col("text"))
    return fx.PHRASE_PAIRS.over(spark, sf_dir).select("n", C.register(t).alias("register"), F.array_join(C.colloquial(t), ", ").alias("spoken"))


_NORM_SQL = "text"
for _p, _r in L.COLLOQUIAL_FORMS:
    if "(?!" not in _p:  # RE2 has no look-ahead: やっぱ(?!り) and やっぱり together are やっぱり?
        _NORM_SQL = f"regexp_replace({_NORM_SQL}, '{'やっぱり?' if _p == 'やっぱり' else _p}', '{_r.replace('$1', chr(92) + '1')}', 'g')"


@query(f"WITH {_TX} SELECT n, {_NORM_SQL} AS normal FROM x")
def classify_normalise(spark, sf_dir):
    return fx.PHRASE_PAIRS.over(spark, sf_dir).select("n", C.normalise(T.trim(F.col("text"))).alias("normal"))


#: Worked out by hand for every phrase, rule by rule.
@query(over(fx.PHRASES, """SELECT * FROM (VALUES (0,'勉強','する','N+する',80), (1,'研究','するした結果','N+する+N',80), (2,'そうだ','と思う','Quote+と+V',70), (3,'言る','passive+てる','V+passive+てる',75),
    (4,'食べ','させられる','V+causative+passive',75), (5,'読んで','た','N+V',60), (6,'割れ','てる','V+て+V',70), (7,'劇的','に変わった','naAdj+に+V',80), (8,'気','が重い','N+が+naAdj',70),
    (9,'じっくり','進む','Adv+V',70), (10,'時間','の無駄','N+の+N',65), (11,'手','を打つ','N+を+V',75), (12,'風','が吹く','N+が+V',75), (13,'気','に入る','N+に+V',70),
    (14,'ボロカス言る','passive+てる','V+passive+てる',75), (15,'abc','','V',60), (16,'すごく高','い山','N+V',60), (17,'言って','た','N+V',60), (18,'やばいで','す','N+V',60),
    (19,'文法','の分析','N+の+N',65), (20,'炎上','を消す','N+を+V',75), (21,'ご覧くだ','さい','N+V',60), (22,'でる','','V',60))
    AS t(n, headword, collocate, pattern, confidence)"""))
def classify_structure(spark, sf_dir):
    return C.classify(fx.PHRASES.over(spark, sf_dir)).select("n", "headword", "collocate", "pattern", F.col("confidence").cast("int").alias("confidence"))


@query(over(fx.PHRASES, """SELECT * FROM (VALUES (0,'勉強する','普通体,日常',80,'','動詞'), (1,'研究した結果','学術',70,'','動詞'), (2,'そうだと思う','普通体,日常',75,'','動詞'), (3,'言われてる','口語,普通体,日常',75,'口語形: てる→ている','助動詞'),
    (4,'食べさせられる','普通体,日常',65,'','助動詞'), (5,'読んでた','普通体,日常',75,'','動詞'), (6,'割れてる','口語,普通体,日常',75,'口語形: てる→ている','動詞'), (7,'劇的に変わった','普通体,日常',65,'','動詞'),
    (8,'気が重い','普通体,感情',60,'','い形容詞'), (9,'じっくり進む','普通体,日常',75,'','動詞'), (10,'時間の無駄','日常',75,'','名詞'), (11,'手を打つ','普通体,身体',60,'','動詞'), (12,'風が吹く','普通体,日常',75,'','動詞'),
    (13,'気に入る','普通体,感情',60,'','動詞'), (14,'ボロカス言われてる','口語,俗語',60,'口語形: てる→ている','助動詞'), (15,'abc','日常',75,'','動詞'), (16,'すごく高い山','日常',75,'','動詞'),
    (17,'言ってた','口語,普通体,日常',75,'口語形: ってた→と言っていた','動詞'), (18,'やばいです','俗語',55,'','動詞'), (19,'文法の分析','学術,言語学',65,'','名詞'), (20,'炎上を消す','普通体,比喩',60,'','動詞'),
    (21,'ご覧ください','敬語,日常',75,'','動詞'), (22,'でる','口語,普通体,日常',75,'口語形: でる→でいる','動詞')) AS t(n, full_phrase, tags, frequency, notes, collocate_pos)"""))
def classify_full(spark, sf_dir):
    return C.classify(fx.PHRASES.over(spark, sf_dir)).select("n", "full_phrase", F.array_join("tags", ",").alias("tags"), "frequency", "notes", "collocate_pos")


_LING, _ALLOF = _like_any("text", L.LINGUISTIC), "text"


@query(
    f"""WITH {_TX}, d AS (SELECT n, list_filter([CASE WHEN {_like_any('text', L.ACADEMIC)} OR {_LING} THEN '学術' END, CASE WHEN {_LING} THEN '言語学' END, CASE WHEN {_like_any('text', L.BODY)} THEN '身体' END,
    CASE WHEN {_like_any('text', L.EMOTION)} THEN '感情' END, CASE WHEN {_like_any('text', L.SLANG)} THEN '俗語' END, CASE WHEN {_like_any('text', L.DIALECT)} THEN '方言' END,
    CASE WHEN contains(text, '炎上') OR (contains(text, '消す') AND contains(text, '炎')) THEN '比喩' END], lambda x: x IS NOT NULL) AS t FROM x)
    SELECT n, CASE WHEN len(t) = 0 THEN '日常' ELSE array_to_string(t, ',') END AS domains FROM d"""
)
def classify_domains(spark, sf_dir):
    t = T.trim(F.col("text"))
    return fx.PHRASE_PAIRS.over(spark, sf_dir).select("n", F.array_join(C.domains(t, F.lit(""), F.lit("")), ",").alias("domains"))


@query(f"WITH {LEX} SELECT id, CASE WHEN frequency >= 70 THEN 'high' WHEN frequency >= 40 THEN 'medium' ELSE 'low' END AS band FROM lex")
def confidence_bands(spark, sf_dir):
    return lexicon(spark, sf_dir).select("id", C.confidence_band(F.col("frequency")).alias("band"))


# ------------------------------------------------------------------ parser, pages


def _candidates_sql(source: str) -> str:
    parts = []
    for rank, (name, regex, last) in enumerate(P.CANDIDATES):
        r = regex.replace(P.SPACE_SET, r"\s　")
        parts.append(
            f"SELECT n, {rank} AS rank, '{name}' AS pattern, unnest(range(len(regexp_extract_all(text, '{r}')))) AS pos, unnest(regexp_extract_all(text, '{r}', 1)) AS headword, "
            f"unnest(regexp_extract_all(text, '{r}', {last})) AS collocate, unnest(regexp_extract_all(text, '{r}', 0)) AS full_phrase FROM {source}"
        )
    return (
        f"WITH m AS ({' UNION ALL '.join(parts)}), k AS (SELECT *, row_number() OVER (PARTITION BY n, headword, collocate ORDER BY rank, pos) AS dup FROM m) "
        "SELECT n, CAST(row_number() OVER (PARTITION BY n ORDER BY rank, pos) AS INTEGER) AS nth, headword, collocate, full_phrase, pattern FROM k WHERE dup = 1"
    )


@query(_candidates_sql(fx.CANDIDATES.sql()))
def parse_collocations(spark, sf_dir):
    return P.parse_collocations(fx.CANDIDATES.over(spark, sf_dir), "n")


@query(r"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), '|') AS bits FROM documents")
def extract_bits(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(P.extract_bits(F.col("text"), "\n"), "|").alias("bits"))


@query(
    f"""SELECT d.n AS page_id, t.* EXCLUDE (k) FROM {fx.SCRAPED.sql('d')} JOIN (VALUES (0, 1, '風', 'が吹く', '風が吹く', '動詞', 'N+が+V', '風が吹く。'), (1, 0, '夢', 'の中', '夢の中', '名詞', 'N+の+Adj', 'a & b'),
    (1, 2, '夢', 'よく', '夢よく', '副詞', 'N+よ+Adj', '')) AS t(k, row_no, headword, collocate, full_phrase, collocate_pos, pattern, example) ON t.k = d.k"""
)
def html_rows(spark, sf_dir):
    rows = P.parse_pages(fx.SCRAPED.over(spark, sf_dir).select(F.col("n").alias("page_id"), "headword", "html"))
    return rows.select("page_id", "row_no", "headword", "collocate", "full_phrase", "collocate_pos", "pattern", F.array_join("example_sentences", "|").alias("example"))


_STRIP = "html"
for _ in range(3):
    _STRIP = f"regexp_replace({_STRIP}, '<[^>]*>', '', 'g')"
_STRIP = f"regexp_replace(replace(replace(replace(replace({_STRIP}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '^[\\s　]+|[\\s　]+$', '', 'g')"


@query(f"SELECT page_id, md5({_STRIP}) AS digest, length({_STRIP}) AS n FROM pages")
def strip_tags(spark, sf_dir):
    bare = P.strip_tags(F.col("html"))
    return read(spark, sf_dir, "pages").select("page_id", F.md5(bare).alias("digest"), F.length(bare).cast("long").alias("n"))


@query(
    f"""SELECT d.n AS page_id, t.* EXCLUDE (k) FROM {fx.SCRAPED.sql('d')} JOIN (VALUES (0, 0, '動詞', ''), (0, 1, '動詞', 'が吹く'), (0, 2, '動詞', 'x'), (1, 0, '名詞', 'の中'), (1, 1, '副詞', '副詞'), (1, 2, '副詞', 'よく'))
    AS t(k, row_no, section, cell) ON t.k = d.k"""
)
def sections_of_rows(spark, sf_dir):
    """A row without a label is in the section of the rows before it."""
    rows = P.page_rows(fx.SCRAPED.over(spark, sf_dir).select(F.col("n").alias("page_id"), "html"))
    return rows.select("page_id", "row_no", "section", F.coalesce(F.get("cells", F.lit(0)), F.lit("")).alias("cell"))


@query(
    """WITH r AS (SELECT page_id, regexp_extract_all(html, '<li[^>]*>.*?</li>') AS rows FROM pages), e AS (SELECT page_id, unnest(range(len(rows))) AS row_no, unnest(rows) AS row FROM r)
    SELECT page_id, CAST(row_no AS INTEGER) AS row_no, '名詞' AS section, regexp_replace(regexp_extract(row, '<a[^>]*>.*?</a>'), '<[^>]*>', '', 'g') AS cell FROM e"""
)
def section_carry_forward(spark, sf_dir):
    rows = P.page_rows(read(spark, sf_dir, "pages"), "li", "a")
    return rows.select("page_id", "row_no", "section", F.col("cells")[0].alias("cell"))


# ------------------------------------------------------------------ discourse

_SPLIT = f"""{fx.MARKED_GRAPHS}, p AS (SELECT graph_id, unnest(range(len(string_split(raw, '||')))) AS part, unnest(string_split(raw, '||')) AS text FROM graphs),
o AS (SELECT *, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY graph_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start_offset FROM p),
bits AS (SELECT graph_id, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY part) - 1 AS INTEGER) AS bit_idx, text, start_offset, CAST(start_offset + length(text) AS INTEGER) AS end_offset
  FROM o WHERE trim(text) <> '')"""


@query(f"WITH {_SPLIT} SELECT * FROM bits")
def bits_split_offsets(spark, sf_dir):
    return G.split_bits(fx.marked_graphs(spark, sf_dir))


@query(
    """WITH p AS (SELECT CAST(doc_id AS VARCHAR) AS graph_id, unnest(range(len(string_split(text, chr(10))))) AS part, unnest(string_split(text, chr(10))) AS t FROM documents),
    o AS (SELECT *, CAST(coalesce(sum(length(t) + 1) OVER (PARTITION BY graph_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start_offset FROM p)
    SELECT graph_id, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY part) - 1 AS INTEGER) AS bit_idx, start_offset, CAST(start_offset + length(t) AS INTEGER) AS end_offset FROM o WHERE trim(t) <> ''"""
)
def bits_of_documents(spark, sf_dir):
    return G.split_bits(A.bits_from_documents(read(spark, sf_dir, "documents")), "\n").drop("text")


#: A line of each kind, and what is read of it.
_LINES = fx.Fixture("line string, label string, said string", (("[00:05] %s", "[00:05]", "%s"), ("  [01:10]%s ", "[01:10]", "%s"), ("%s", None, "%s"), ("", None, None), ("[1:02:03] %s", None, "[1:02:03] %s")))


@query(
    f"""WITH {fx.MARKED_TURNS}, s AS (SELECT graph_id AS doc_id, bit_idx, label, replace(said, '%s', 'x' || text) AS raw FROM marked JOIN (VALUES (0, '[00:05]', '%s'), (1, '[01:10]', '%s'), (2, NULL, '%s'), (4, NULL, '[1:02:03] %s')) AS l(k, label, said) ON bit_idx % 5 = k)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY bit_idx) - 1 AS INTEGER) AS line_no, label AS ts_label, trim(raw) AS raw FROM s"""
)
def transcript_lines(spark, sf_dir):
    """Conversations as transcripts: a turn is a line, with a time or without, or a blank one."""
    lines = F.array(*[F.lit(row[0]) for row in _LINES.rows])
    turns = fx.marked_turns(spark, sf_dir).select("graph_id", "bit_idx", F.replace(F.element_at(lines, F.col("bit_idx") % 5 + 1), F.lit("%s"), F.concat(F.lit("x"), "text")).alias("line"))
    raw = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bit_idx", "line"))), lambda x: x["line"]), "\n")
    return G.transcript_lines(turns.groupBy(F.col("graph_id").alias("doc_id")).agg(raw.alias("raw")))


@query(f"WITH {_SPLIT} SELECT graph_id, bit_idx, array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '([{G.PARTICLES}])', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> ''), ' ') AS tokens FROM bits")
def tokenize_particles(spark, sf_dir):
    return G.split_bits(fx.marked_graphs(spark, sf_dir)).select("graph_id", "bit_idx", F.array_join(G.tokenize(F.col("text")), " ").alias("tokens"))


def _rules_sql(bits: str) -> str:
    """hits(graph_id, bit_idx, rank, type, confidence, target) of the seed rules."""
    end = lambda p: p.replace(r"\z", "$")
    pivots = ", ".join(f"'{w}'" for w in G.PIVOTS)
    tests = [
        ("interactional-pivot", f"CASE WHEN regexp_replace(t, '[。、！？…]', '', 'g') IN ({pivots}) THEN 0.95 END", "NULL"),
        ("hedge-stance-softening", f"CASE WHEN regexp_matches(text, '{G.HEDGES}') THEN 0.9 END", "NULL"),
        ("extended-reasoning-stance-cap", f"CASE WHEN regexp_matches(text, '{G.CAPS}') THEN 0.9 END", "NULL"),
        ("causal-concessive-cascade", "CASE WHEN regexp_matches(t, '(から|ので)$') AND regexp_matches(trim(nxt), 'けど|が$|のに$') THEN 0.85 WHEN regexp_matches(text, 'んだけど|なんだけど|けれど') THEN 0.75 END", "CASE WHEN regexp_matches(t, '(から|ので)$') AND regexp_matches(trim(nxt), 'けど|が$|のに$') THEN bit_idx + 1 END"),
        ("connector-compounding", f"CASE WHEN regexp_matches(t, '^({G.CONNECTORS})') THEN 0.9 END", "NULL"),
        ("epistemic-speculation-cascade", f"CASE WHEN regexp_matches(t, '{G.SPECULATES}') THEN CASE WHEN maybe IS NOT NULL THEN 0.9 ELSE 0.65 END WHEN regexp_matches(t, 'のかもしれない|かもしれない$') THEN 0.85 END", f"CASE WHEN regexp_matches(t, '{G.SPECULATES}') THEN maybe END"),
        ("perspective-framing", f"CASE WHEN regexp_matches(text, '{G.PERSPECTIVES}') THEN 0.85 END", "NULL"),
        ("assertion-deflation", r"CASE WHEN regexp_matches(prev, 'んじゃない') AND regexp_matches(text, '\?|みたいな|ような') THEN 0.9 WHEN regexp_matches(text, 'んじゃない|でしょ') THEN 0.8 END", "NULL"),
        ("epistemic-continuation-blend", f"CASE WHEN regexp_matches(text, '{G.BLENDS}') THEN 0.85 END", "NULL"),
        ("discontinuous-parallel", f"CASE WHEN regexp_matches(text, '{G.LISTING}') AND other IS NOT NULL THEN 0.9 END", "other"),
        ("fuzzy-reference-chain", f"CASE WHEN regexp_matches(text, '{G.FUZZY}') THEN 0.85 END", "NULL"),
        ("discourse-fade-trail-off", f"CASE WHEN regexp_matches(t, '{end(G.FADES)}') THEN 0.95 END", "NULL"),
        ("split-morpheme-co-construction", "CASE WHEN regexp_matches(trim(prev), '[んいきしちにびみり]$') AND regexp_matches(t, '^[でても]') THEN 0.8 WHEN regexp_matches(t, '[いきしちにびみり]$') THEN 0.6 END", "NULL"),
    ]
    union = " UNION ALL ".join(f"SELECT graph_id, bit_idx, last_idx, {i} AS rank, '{k}' AS type, CAST({c} AS DOUBLE) AS confidence, CAST({t} AS INTEGER) AS target FROM ctx" for i, (k, c, t) in enumerate(tests))
    listing = f"CASE WHEN regexp_matches(text, '{G.LISTING}') THEN bit_idx END"
    return f"""c0 AS (SELECT *, trim(text) AS t, coalesce(lag(text) OVER g, '') AS prev, coalesce(lead(text) OVER g, '') AS nxt, min(CASE WHEN regexp_matches(text, '{G.MAYBE}') THEN bit_idx END) OVER a AS maybe,
      min({listing}) OVER a AS l1, max(bit_idx) OVER a AS last_idx FROM {bits} WINDOW g AS (PARTITION BY graph_id ORDER BY bit_idx), a AS (PARTITION BY graph_id)),
    c1 AS (SELECT *, min(CASE WHEN bit_idx > l1 THEN {listing} END) OVER (PARTITION BY graph_id) AS l2 FROM c0),
    ctx AS (SELECT *, CASE WHEN l1 <> bit_idx THEN l1 ELSE l2 END AS other FROM c1), hits AS (SELECT * FROM ({union}) WHERE confidence IS NOT NULL)"""


_CATEGORY_SQL = "CASE " + " ".join(f"WHEN bit_type = '{k}' THEN '{v}'" for k, v in G.CATEGORY.items()) + " ELSE 'structural' END"


def _labels_sql(bits: str) -> str:
    return f"""{_rules_sql(bits)}, best AS (SELECT graph_id, bit_idx, arg_max(type, confidence * 1000 - rank) AS type, max(confidence) AS confidence FROM hits GROUP BY 1, 2),
    lab AS (SELECT b.graph_id, b.bit_idx, b.text, coalesce(best.type, 'unknown') AS bit_type, best.confidence FROM {bits} b LEFT JOIN best USING (graph_id, bit_idx))"""


_EDGES_SQL = """e0 AS (SELECT graph_id, bit_idx AS src_idx, -1 AS rank, 'sequential-adjacency' AS relationship_type, CAST(0.7 AS DOUBLE) AS confidence, bit_idx + 1 AS dst_idx FROM ctx WHERE bit_idx < last_idx
  UNION ALL SELECT graph_id, bit_idx, rank, type, confidence, target FROM hits WHERE abs(target - bit_idx) > 1 AND target <= last_idx),
edges AS (SELECT graph_id, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY src_idx, rank) - 1 AS INTEGER) AS edge_ord, CAST(src_idx AS INTEGER) AS src_idx, CAST(dst_idx AS INTEGER) AS dst_idx,
  relationship_type, confidence, CAST(abs(dst_idx - src_idx) AS INTEGER) AS bit_distance FROM e0)"""


@query(f"WITH {_SPLIT}, {_labels_sql('bits')} SELECT graph_id, bit_idx, bit_type, confidence, {_CATEGORY_SQL} AS category FROM lab")
def bit_labels(spark, sf_dir):
    return G.label_bits(G.split_bits(fx.marked_graphs(spark, sf_dir))).select("graph_id", "bit_idx", "bit_type", "confidence", "category")


_SAID = "turns AS (SELECT CAST(conv_id AS VARCHAR) AS graph_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS bit_idx, text FROM conversations)"


_TURNS = f"{fx.MARKED_TURNS}, turns AS (SELECT * FROM marked)"


@query(f"WITH {_TURNS}, {_labels_sql('turns')} SELECT bit_type, {_CATEGORY_SQL} AS category, count(*) AS n FROM lab GROUP BY 1, 2")
def label_counts(spark, sf_dir):
    bits = fx.marked_turns(spark, sf_dir)
    return G.label_bits(bits).groupBy("bit_type", "category").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_SPLIT}, {_labels_sql('bits')}, z AS (SELECT *, {_CATEGORY_SQL} AS category FROM lab) SELECT graph_id, bit_type, count(*) AS n, min(bit_idx) AS first_idx, category FROM z GROUP BY 1, 2, 5")
def category_counts(spark, sf_dir):
    return G.summary_table(G.label_bits(G.split_bits(fx.marked_graphs(spark, sf_dir)))).select("graph_id", "bit_type", "n", "first_idx", "category")


@query(f"WITH {_SAID} SELECT graph_id, bit_idx AS src_idx, CAST(bit_idx + 1 AS INTEGER) AS dst_idx FROM turns t WHERE bit_idx < (SELECT max(bit_idx) FROM turns u WHERE u.graph_id = t.graph_id)")
def edges_adjacent(spark, sf_dir):
    bits = A.bits_from_conversations(read(spark, sf_dir, "conversations"))
    return G.edges(bits).where(F.col("relationship_type") == G.ADJACENT).select("graph_id", "src_idx", "dst_idx")


@query(f"WITH {_SPLIT}, {_rules_sql('bits')}, {_EDGES_SQL} SELECT * FROM edges")
def edges_long_range(spark, sf_dir):
    return G.edges(G.split_bits(fx.marked_graphs(spark, sf_dir))).drop("direction", "evidence")


@query(
    f"""WITH {_SPLIT}, {_labels_sql('bits')}, {_EDGES_SQL}, z AS (SELECT *, {_CATEGORY_SQL} AS category FROM lab),
    lines AS (SELECT graph_id, bit_idx AS a, 0 AS b, -1 AS c, '[' || category || '] ' || trim(text) AS line FROM z
      UNION ALL SELECT e.graph_id, src_idx, 1, edge_ord, '  --[' || relationship_type || ' conf:' || printf('%.2f', e.confidence) || ']--> ' || substr(trim(z.text), 1, 40) FROM edges e JOIN z ON z.graph_id = e.graph_id AND z.bit_idx = e.dst_idx)
    SELECT graph_id, string_agg(line, chr(10) ORDER BY a, b, c) AS text FROM lines GROUP BY 1"""
)
def adjacency_list(spark, sf_dir):
    bits = G.split_bits(fx.marked_graphs(spark, sf_dir))
    return G.adjacency_list(G.label_bits(bits), G.edges(bits))


_COLOUR_SQL = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in G.COLOURS.items()) + " END"


@query(
    f"""WITH {_SPLIT}, {_labels_sql('bits')}, {_EDGES_SQL}, z AS (SELECT *, {_CATEGORY_SQL} AS category FROM lab), g AS (SELECT DISTINCT graph_id FROM z),
    lines AS (SELECT graph_id, -1 AS a, 0 AS b, 'digraph discourse {{' AS line FROM g UNION ALL SELECT graph_id, -1, 1, '  rankdir=LR;' FROM g
      UNION ALL SELECT graph_id, -1, 2, '  node [shape=box, style=filled, fontname=Helvetica];' FROM g UNION ALL SELECT graph_id, 2, 0, '}}' FROM g
      UNION ALL SELECT graph_id, 0, bit_idx, '  "b' || bit_idx || '" [label="' || substr(replace(text, '"', ''''), 1, 30) || '", fillcolor="' || {_COLOUR_SQL} || '", fontcolor="#ffffff"];' FROM z
      UNION ALL SELECT graph_id, 1, edge_ord, '  "b' || src_idx || '" -> "b' || dst_idx || '" [label="' || substr(relationship_type, 1, 20) || '", penwidth=' || printf('%.1f', confidence * 2) || '];' FROM edges)
    SELECT graph_id, string_agg(line, chr(10) ORDER BY a, b) AS text FROM lines GROUP BY 1"""
)
def dot_text(spark, sf_dir):
    bits = G.split_bits(fx.marked_graphs(spark, sf_dir))
    return G.dot_text(G.label_bits(bits), G.edges(bits))


#: Chains of twelve events each, whose every fourth chain also leads back into itself; every 29th edge is a plain neighbour.
_KINDS = ("causal-concessive-cascade", "connector-compounding", "x", "epistemic-speculation-cascade", "y")
_EVENT_EDGES = f"""e AS (SELECT CAST(event_id // 12 AS VARCHAR) AS graph_id, CAST(event_id % 12 AS INTEGER) AS edge_ord, CAST(event_id % 12 AS INTEGER) AS src_idx,
  CAST(CASE WHEN event_id % 48 = 40 THEN 2 ELSE event_id % 12 + 1 END AS INTEGER) AS dst_idx, CASE WHEN event_id % 29 = 0 THEN 'sequential-adjacency' ELSE [{', '.join(map(repr, _KINDS))}][event_id * 7 // 3 % 5 + 1] END AS relationship_type FROM events)"""
_PATHS = f"""{_EVENT_EDGES}, s AS (SELECT * FROM e WHERE relationship_type <> 'sequential-adjacency'), r AS (SELECT graph_id, [edge_ord] AS path, [relationship_type] AS types, [src_idx, dst_idx] AS nodes FROM s WHERE src_idx <> dst_idx
  UNION ALL SELECT r.graph_id, list_append(path, edge_ord), list_append(types, relationship_type), list_append(nodes, dst_idx) FROM r JOIN s ON s.graph_id = r.graph_id AND s.src_idx = nodes[-1] AND NOT list_contains(nodes, dst_idx))"""


def event_edges(spark, sf_dir) -> DataFrame:
    event = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.floor(event * 7 / 3) % 5 + 1).cast("int"))
    return read(spark, sf_dir, "events").select(
        F.floor(event / 12).cast("string").alias("graph_id"), (event % 12).cast("int").alias("edge_ord"), (event % 12).cast("int").alias("src_idx"),
        F.when(event % 48 == 40, 2).otherwise(event % 12 + 1).cast("int").alias("dst_idx"), F.when(event % 29 == 0, G.ADJACENT).otherwise(kind).alias("relationship_type"),
    )


@query(f"WITH RECURSIVE {_PATHS} SELECT graph_id, array_to_string(path, '-') AS path FROM r WHERE len(path) >= 3")
def cascades_simple_paths(spark, sf_dir):
    return G.cascades(event_edges(spark, sf_dir)).select("graph_id", F.array_join(F.col("path").cast("array<string>"), "-").alias("path"))


@query(
    f"""WITH RECURSIVE {_PATHS}, u AS (SELECT *, list_filter(types, lambda x, i: list_position(types, x) = i) AS once FROM r WHERE len(path) >= 3)
    SELECT graph_id, array_to_string(path, '-') AS path, CASE WHEN list_has_all(types, ['connector-compounding', 'causal-concessive-cascade']) THEN 'causal-connector-cascade' ELSE array_to_string(once[1:2], '-') || '-cascade' END AS cascade_type,
    CASE WHEN list_has_all(types, ['connector-compounding', 'causal-concessive-cascade']) THEN 'Stacked connectors navigate a causal-concessive argument while managing face' ELSE 'Emergent meaning from chained ' || array_to_string(once, ', ') || ' relationships' END AS overall_function FROM u"""
)
def cascade_types(spark, sf_dir):
    found = G.cascades(event_edges(spark, sf_dir))
    return found.select("graph_id", F.array_join(F.col("path").cast("array<string>"), "-").alias("path"), "cascade_type", "overall_function")


_CHUNKS = """ch AS (SELECT CAST(doc_id AS VARCHAR) AS id, split_part(text, ' ', 1) AS surface, lang AS category, [CAST(doc_id % 7 AS VARCHAR), CAST(doc_id % 11 AS VARCHAR)] AS collocations FROM documents)"""


def chunks(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("id"), F.substring_index("text", " ", 1).alias("surface"), F.col("lang").alias("category"),
        F.array((F.col("doc_id") % 7).cast("string"), (F.col("doc_id") % 11).cast("string")).alias("collocations"),
    )


@query(f"WITH {_CHUNKS}, {LEX}, p AS (SELECT id AS chunk_id, unnest(collocations) AS id FROM ch) SELECT chunk_id, id, full_phrase FROM p JOIN lex USING (id)")
def chunks_by_collocation(spark, sf_dir):
    return K.chunk_collocations(chunks(spark, sf_dir), lexicon(spark, sf_dir)).select("chunk_id", "id", "full_phrase")


@query(f"WITH {_CHUNKS} SELECT 'category' AS kind, id FROM ch WHERE category = 'fr' UNION ALL SELECT 'marker', id FROM ch WHERE surface = 'The' UNION ALL SELECT 'collocation', id FROM ch WHERE list_contains(collocations, '10')")
def query_chunks(spark, sf_dir):
    c = chunks(spark, sf_dir)
    finds = {"category": K.query_chunks(c, category="fr", marker="The"), "marker": K.query_chunks(c, marker="The", collocation="10"), "collocation": K.query_chunks(c, collocation="10")}
    a, b, d = (df.select(F.lit(k).alias("kind"), "id") for k, df in finds.items())
    return a.unionByName(b).unionByName(d)


@query(f"WITH {_CHUNKS} SELECT category, count(*) AS n FROM ch GROUP BY 1")
def chunk_category_counts(spark, sf_dir):
    return K.count_by_category(chunks(spark, sf_dir))


# ------------------------------------------------------------------ dictionaries

_TERMS = r"""terms AS (SELECT source AS dictionary, regexp_extract(text, '^[\x20\x09-\x0D]*([^\x20\x09-\x0D]*)', 1) AS term, lower(regexp_extract(text, '^[\x20\x09-\x0D]*([^\x20\x09-\x0D]*)', 1)) AS reading,
  text, doc_id AS row_ord FROM documents WHERE text IS NOT NULL),
dicts AS (SELECT source AS title, CASE CAST(regexp_extract(source, '(\d+)', 1) AS INTEGER) % 3 WHEN 0 THEN 'en-ja' WHEN 1 THEN 'ja' ELSE 'en' END AS language FROM documents WHERE source IS NOT NULL GROUP BY 1)"""


def dictionary_tables(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return A.terms_from_documents(d), A.dictionaries_from_documents(d)


@query(f"WITH {_TERMS} SELECT dictionary, term, row_ord FROM terms WHERE term = 'The'")
def dict_exact(spark, sf_dir):
    terms, _ = dictionary_tables(spark, sf_dir)
    return D.lookup_term(terms, "The").select("dictionary", "term", "row_ord")


@query(f"WITH {_TERMS} SELECT term, row_ord FROM terms WHERE starts_with(term, 'Th') ORDER BY term, row_ord LIMIT 40")
def dict_prefix(spark, sf_dir):
    terms, _ = dictionary_tables(spark, sf_dir)
    return D.prefix_search(terms, "Th", 40).select("term", "row_ord")


def _dict_sql(prefix: str, where: str, limit: int) -> str:
    low = prefix.lower()
    return f"""WITH {_TERMS}, h AS (SELECT t.*, language, CASE WHEN starts_with(term, '{prefix}') THEN 1 ELSE 2 END AS rank FROM terms t JOIN dicts ON title = dictionary WHERE (starts_with(term, '{prefix}') OR starts_with(reading, '{prefix}')) AND {where}),
    o AS (SELECT *, row_number() OVER (PARTITION BY dictionary, term, reading ORDER BY rank, row_ord) AS dup FROM h),
    s AS (SELECT *, CASE WHEN lower(term) = '{low}' THEN 100 WHEN starts_with(lower(term), '{low}') THEN 80 ELSE 75 END AS score FROM o WHERE dup = 1)
    SELECT dictionary, term, score FROM s ORDER BY language IN ('en-ja', 'ja-en'), score DESC, rank, CASE WHEN rank = 2 THEN reading ELSE term END, row_ord LIMIT {limit}"""


@query(_dict_sql("th", "true", 50))
def dict_search_all(spark, sf_dir):
    return D.search(*dictionary_tables(spark, sf_dir), D.DictionaryOptions("th")).select("dictionary", "term", "score")


@query(_dict_sql("On", "language NOT IN ('en-ja', 'ja-en')", 50))
def dict_search_mode(spark, sf_dir):
    return D.search(*dictionary_tables(spark, sf_dir), D.DictionaryOptions("On", mode="monolingual")).select("dictionary", "term", "score")


@query(_dict_sql("an", "true", 10))
def dict_suggest(spark, sf_dir):
    return D.suggest(*dictionary_tables(spark, sf_dir), "an").select("dictionary", "term", "score")


_TITLES = fx.Derived(fx.Fixture("title string", (("大辞林 第四版",), ("デジタル大辞泉",), ("知らない長い辞書名です",))), "supplier", "s_suppkey")


@query(
    f"""WITH d AS (SELECT title || CASE WHEN k = 2 THEN CAST(n AS VARCHAR) ELSE '' END AS title, k, min(n) AS n FROM {_TITLES.sql()} GROUP BY 1, 2)
    SELECT title, abbreviation, category, language FROM d JOIN (VALUES (0,'大辞林4','国語辞典','ja'), (1,'大辞泉','国語辞典','ja'), (2,'知らない長い辞書','専門用語','ja')) AS t(k, abbreviation, category, language) ON t.k = d.k"""
)
def dict_meta_lookup(spark, sf_dir):
    """A title for each supplier; those of the third kind are all different, and unknown."""
    title = F.concat("title", F.when(F.col("k") == 2, F.col("n").cast("string")).otherwise(""))
    return D.meta_for_titles(_TITLES.over(spark, sf_dir).select(title.alias("title")), D.meta_table(spark)).select("title", "abbreviation", "category", "language")


#: Bank rows of every kind, and what is read of them; %d is the document's number.
_BANK_ROWS = (
    ('["風%d","かぜ","n","",5,["wind",{"type":"image","path":"a"},{"type":"structured-content","content":"s"}],1,"common"]', "風%d", "かぜ", "n common", "text:wind|image:|structured-content:"),
    ('["夢%d","","n v","",1,["dream",null,7],3,"common rare"]', "夢%d", "", "n v common rare", "text:dream|text:null|text:7"),
    ('["雨%d",5,"n","",1,["rain"],2,""]', "雨%d", "雨%d", "n", "text:rain"),
    ('["短",1,"n","",5]', None, None, None, None),
    ('[5,"x","n","",5,[],1,""]', None, None, None, None),
    ('["空","そら","","",0,[],0,null]', "空", "そら", "", ""),
    ('{"no":"row"}', None, None, None, None),
)
_KANJI_ROWS = (
    ('["風","フウ フ","かぜ","jouyou",["wind","%d"],{"strokes":"9","id":"%d"}]', "風", "フウ フ", "かぜ", "jouyou", "wind %d", "9"),
    ('["short","a","b","c"]', None, None, None, None, None, None),
    ('["雨",1,"あめ",null,[],{}]', "雨", "", "あめ", "", "", None),
)


def _spread(rows: tuple) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "NULL" if x is None else f"'{x}'" for x in (i, *row[1:])) + ")" for i, row in enumerate(rows))


_OWN = "d AS (SELECT doc_id, source AS dictionary FROM documents WHERE source IS NOT NULL AND text IS NOT NULL)"


def _banked(spark, sf_dir, rows: tuple, kind: str) -> DataFrame:
    """A bank row for each document, in banks of a hundred, and the indexes."""
    docs = read(spark, sf_dir, "documents").where("source IS NOT NULL AND text IS NOT NULL")
    body = F.element_at(F.array(*[F.lit(r[0]) for r in rows]), (F.col("doc_id") % len(rows) + 1).cast("int"))
    cells = docs.select(F.col("source").alias("dictionary"), F.col("doc_id").alias("row_ord"), F.replace(body, F.lit("%d"), F.col("doc_id").cast("string")).alias("row"))
    return Z.bank_files(cells, kind, 100).unionByName(Z.index_files(A.dictionaries_from_documents(docs)))


def kanji_files(spark, sf_dir) -> DataFrame:
    return _banked(spark, sf_dir, _KANJI_ROWS, "kanji")


@query(
    f"""WITH {_OWN}, s AS (SELECT *, doc_id // 100 AS bank FROM d), c AS (SELECT dictionary, bank, count(*) AS n FROM s GROUP BY 1, 2),
    f AS (SELECT dictionary, bank, coalesce(sum(n) OVER (PARTITION BY dictionary ORDER BY 'term_bank_' || bank || '.json' ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM c),
    p AS (SELECT s.*, CAST(first + row_number() OVER (PARTITION BY dictionary, bank ORDER BY doc_id) - 1 AS BIGINT) AS row_ord FROM s JOIN f USING (dictionary, bank))
    SELECT dictionary, replace(term, '%d', CAST(doc_id AS VARCHAR)) AS term, replace(reading, '%d', CAST(doc_id AS VARCHAR)) AS reading, tags, row_ord, content FROM p JOIN (VALUES {_spread(_BANK_ROWS)}) AS t(k, term, reading, tags, content) ON k = doc_id % {len(_BANK_ROWS)} WHERE term IS NOT NULL"""
)
def dict_import_terms(spark, sf_dir):
    terms = Z.parse_terms(_banked(spark, sf_dir, _BANK_ROWS, "term"))
    d = F.col("definitions")[0]
    items = F.transform(d["content"], lambda c: F.concat(c["type"], F.lit(":"), F.coalesce(c["text"], F.lit(""))))
    return terms.select("dictionary", "term", "reading", F.array_join(d["tags"], " ").alias("tags"), "row_ord", F.array_join(items, "|").alias("content"))


@query(f"WITH {_OWN} SELECT dictionary, character, onyomi, kunyomi, tags, replace(meanings, '%d', CAST(doc_id AS VARCHAR)) AS meanings, strokes FROM d JOIN (VALUES {_spread(_KANJI_ROWS)}) AS t(k, character, onyomi, kunyomi, tags, meanings, strokes) ON k = doc_id % {len(_KANJI_ROWS)} WHERE character IS NOT NULL")
def dict_import_kanji(spark, sf_dir):
    k = Z.parse_kanji(kanji_files(spark, sf_dir))
    return k.select("dictionary", "character", *[F.array_join(c, " ").alias(c) for c in ("onyomi", "kunyomi", "tags", "meanings")], F.col("stats")["strokes"].alias("strokes"))


_SHELVED = fx.Derived(fx.DICTS, "supplier", "s_suppkey")


def _dictionaries(spark, sf_dir) -> DataFrame:
    return _SHELVED.over(spark, sf_dir).withColumn("title", F.concat("title", F.lit("-"), F.col("n").cast("string")))


@query(f"WITH d AS (SELECT category, title || '-' || n AS title FROM {_SHELVED.sql()}) SELECT category, CAST(list_position([{', '.join(repr(c) for c in D.CATEGORY_ORDER)}], category) AS INTEGER) AS shelf, string_agg(title, ',' ORDER BY title) AS titles FROM d WHERE list_contains([{', '.join(repr(c) for c in D.CATEGORY_ORDER)}], category) GROUP BY category")
def dict_shelf(spark, sf_dir):
    return D.shelf(_dictionaries(spark, sf_dir)).select("category", "shelf", F.array_join("titles", ",").alias("titles"))


@query(f"SELECT d.title || '-' || n AS title, badge, label FROM {_SHELVED.sql('d')} JOIN (VALUES ('T1','大','大辞林 第四版'), ('T2','NED','NED'), ('T3','と','とても長い題名の漢字辞…'), ('T4','そ','その他')) AS t(title, badge, label) USING (title)")
def dict_tiles(spark, sf_dir):
    return D.tile(_dictionaries(spark, sf_dir))


@query(f"WITH {_TERMS} SELECT dictionary, CAST(floor(row_ord / 10000) AS BIGINT) AS part, min(row_ord) AS first_rank, md5(string_agg(term, ' ' ORDER BY row_ord)) AS terms FROM terms GROUP BY 1, 2")
def results_grouped(spark, sf_dir):
    terms, _ = dictionary_tables(spark, sf_dir)
    return D.grouped_results(terms.withColumn("rank", F.col("row_ord")), span=10_000).select("dictionary", "part", "first_rank", F.md5(F.array_join("terms", " ")).alias("terms"))


@query(f"WITH {_TERMS}, h AS (SELECT dictionary, term, row_ord FROM terms WHERE term = 'The') SELECT dictionary, min(row_ord) AS first_rank, count(*) AS n FROM h GROUP BY 1")
def results_grouped_of_hits(spark, sf_dir):
    terms, _ = dictionary_tables(spark, sf_dir)
    hits = D.lookup_term(terms, "The").withColumn("rank", F.col("row_ord"))
    return D.grouped_results(hits).select("dictionary", "first_rank", F.size("terms").alias("n"))


@query(f"WITH {_OWN} SELECT dictionary, replace(term, '%d', CAST(doc_id AS VARCHAR)) AS term, sense_no, label, type FROM d JOIN (VALUES (0,'風%d',1,'①','text'), (0,'風%d',3,'③','structured-content'), (1,'夢%d',1,'①','text'), (1,'夢%d',2,'②','text'), (1,'夢%d',3,'③','text'), (2,'雨%d',1,'①','text')) AS t(k, term, sense_no, label, type) ON k = doc_id % {len(_BANK_ROWS)}")
def sense_numbers(spark, sf_dir):
    return D.senses(Z.parse_terms(_banked(spark, sf_dir, _BANK_ROWS, "term"))).select("dictionary", "term", "sense_no", "label", "type")


# ------------------------------------------------------------------ library


@query("WITH h AS (SELECT event_type || ':' || user_id AS query, max(struct_pack(ts := ts, ord := event_id)) AS last FROM events GROUP BY 1) SELECT query, last.ord AS ord FROM h ORDER BY last.ts DESC, last.ord DESC LIMIT 100")
def history_mru(spark, sf_dir):
    return B.history(A.history_from_events(read(spark, sf_dir, "events"))).select("query", "ord")


# ------------------------------------------------------------------ catalogue

_CORPUS = fx.Derived(fx.texts(
    "まるで夢かのような", "理想から遠い", "大雨について話す。雨についての話", "走り始めた、歩き始めた", "行かざるを得ない", "雨とはいえ", "書きやすい", "正しいと考えられる", "旅を機に", "夏に比べて", "海を目指して",
    "君から遠い人", "星がきらきらする", "胸が躍る", "行くとしたら", "虹と呼ばれる", "百人に及ぶ", "彼のせいで", "𠮷野家らしい", "plain text", "",
), "documents", "doc_id")
#: Results worked out by hand from the rows of the catalogue; a text for each family, and overlapping, repeated and wide ones.
_MATCHES = """(VALUES
  (0,'比喩照合型','まるで+N+かのような','直喩照合型','夢','かのような','名詞','表現',0,9,85),
  (1,'距離近接述語型','N+から+遠い(N)','距離述語型','理想','から遠い','名詞','い形容詞',0,6,80),
  (2,'複合後置詞型','N+について','主題後置詞型','大雨','について','名詞','表現',0,6,70),
  (2,'複合後置詞型','N+について','主題後置詞型','雨','について','名詞','表現',9,15,70),
  (2,'複合後置詞型','N+について+N','主題後置詞型(連体)','雨','についての話','名詞','表現',9,16,68),
  (3,'複合動詞型','V+始めた','開始アスペクト(過去)','走り','始めた','動詞','動詞',0,5,68),
  (3,'複合動詞型','V+始めた','開始アスペクト(過去)','歩き','始めた','動詞','動詞',6,11,68),
  (4,'否定制限型','V+ざるを得ない','強制不可避型','行か','ざるを得ない','動詞','表現',0,8,85),
  (5,'慣用複合型','N+とはいえ','譲歩逆接型','雨','とはいえ','名詞','表現',0,5,82),
  (6,'形容述語型','V+やすい','容易複合形容型','書き','やすい','動詞','い形容詞',0,5,75),
  (7,'様態推量型','V+と考えられる','論理推量型','正しい','と考えられる','表現','助動詞',0,9,75),
  (8,'時間因果型','N+を機に','機会型','旅','を機に','名詞','表現',0,4,80),
  (9,'対比関係型','N+に比べて','比較型','夏','に比べて','名詞','表現',0,5,80),
  (10,'空間方向型','N+を目指して','目標型','海','を目指して','名詞','動詞',0,6,80),
  (11,'距離近接述語型','N+から+遠い(N)','距離述語型','君','から遠い人','名詞','い形容詞',0,6,80),
  (11,'社会役割型','N+から+遠い+人N','距離人物型','君','から遠い人','名詞','い形容詞',0,6,85),
  (12,'擬態語述語型','OnomPred+する','擬態語述語型','きらきら','する','副詞','動詞',2,8,75),
  (13,'複合動詞型','胸が+V/Adj','胸イディオム型','胸','が躍る','名詞','動詞',0,4,85),
  (14,'条件仮定型','V+としたら','仮定型','行く','としたら','動詞','助動詞',0,6,70),
  (15,'引用照合型','N+と呼ばれる','名称引用型','虹','と呼ばれる','表現','動詞',0,6,72),
  (16,'数量程度型','N+に及ぶ','到達型','百人','に及ぶ','名詞','表現',0,5,70),
  (17,'目的原因型','N+のせいで','責任原因型','彼','のせいで','名詞','表現',0,5,72),
  (18,'比喩照合型','N+らしい','典型性述語型','𠮷野家','らしい','名詞','い形容詞',0,6,65)
  ) AS m(n, family, pattern, label, headword, collocate, headword_pos, collocate_pos, start, "end", confidence)"""


@query(fx.over(_CORPUS, f"SELECT * FROM {_MATCHES}"))
def extract_patterns(spark, sf_dir):
    return X.extract_patterns(_CORPUS.over(spark, sf_dir), "n").drop("spec_id")


@query(f"SELECT family, count(*) AS n FROM ({fx.over(_CORPUS, f'SELECT * FROM {_MATCHES}')}) GROUP BY family")
def extract_pattern_family_counts(spark, sf_dir):
    return X.extract_patterns(_CORPUS.over(spark, sf_dir), "n").groupBy("family").agg(F.count(F.lit(1)).alias("n"))


_BEST = f'SELECT n, pattern, start, "end", confidence FROM {_MATCHES} QUALIFY row_number() OVER (PARTITION BY n, start ORDER BY confidence DESC, "end" DESC) = 1'


@query(fx.over(_CORPUS, _BEST))
def extract_patterns_best(spark, sf_dir):
    return X.extract_patterns(_CORPUS.over(spark, sf_dir), "n", best_only=True).select("n", "pattern", "start", "end", "confidence")
