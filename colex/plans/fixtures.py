"""Small fixed tables that both engines read from the same VALUES text, and the given tables in terms of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return repr(x)
    return "'" + str(x).replace("'", "''") + "'"


@dataclass(frozen=True)
class Fixture:
    columns: str  # "name type, name type"
    rows: tuple

    def spark(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(r) for r in self.rows], self.columns)

    def sql(self) -> str:
        """A DuckDB FROM item with the same rows and column names."""
        names = [c.split()[0] for c in self.columns.split(", ")]
        rows = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in self.rows)
        return f"(VALUES {rows}) AS fx({', '.join(names)})"


@dataclass(frozen=True)
class Derived:
    """The rows of a given table as n (the key), k and the columns of the fixture's row k, where k is the key modulo
    the fixture's rows; with `pairs`, the text of row k and then that of the row that the next digit names."""

    fixture: Fixture
    table: str = "part"
    key: str = "p_partkey"
    pairs: bool = False

    def columns(self) -> list[str]:
        return [c for c in (c.split()[0] for c in self.fixture.columns.split(", ")) if c != "n"]

    def rows(self) -> list[tuple]:
        """The fixture's rows, numbered."""
        own = self.fixture.columns.startswith("n ")
        return [(k, *(r[1:] if own else r)) for k, r in enumerate(self.fixture.rows)]

    def over(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        size = len(self.fixture.rows)
        rows = spark.read.parquet(f"{sf_dir}/{self.table}.parquet").select(F.col(self.key).cast("long").alias("n"))
        rows = rows.withColumn("k", (F.col("n") % size).cast("int"))
        kinds = ", ".join(["k int", *(c for c in self.fixture.columns.split(", ") if not c.startswith("n "))])
        small = spark.createDataFrame(self.rows(), kinds)
        out = rows.join(F.broadcast(small), "k").select("n", "k", *self.columns())
        if not self.pairs:
            return out
        other = small.select(F.col("k").alias("k2"), F.col("text").alias("text2"))
        out = out.withColumn("k2", (F.floor(F.col("n") / size) % size).cast("int")).join(F.broadcast(other), "k2")
        return out.select("n", "k", F.concat("text", "text2").alias("text"))

    def sql(self, alias: str = "fx") -> str:
        """A DuckDB FROM item with the same rows and columns."""
        size, names = len(self.fixture.rows), self.columns()
        rows = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in self.rows())
        small = f"(VALUES {rows})"
        shown = ", ".join(f"a.{c}" for c in names)
        if not self.pairs:
            return f"(SELECT t.{self.key} AS n, a.k, {shown} FROM {self.table} t JOIN {small} AS a(k, {', '.join(names)}) ON a.k = t.{self.key} % {size}) AS {alias}"
        return f"(SELECT t.{self.key} AS n, a.k, a.text || b.text AS text FROM {self.table} t JOIN {small} AS a(k, text) ON a.k = t.{self.key} % {size} JOIN {small} AS b(k, text) ON b.k = t.{self.key} // {size} % {size}) AS {alias}"


def texts(*values: str) -> Fixture:
    return Fixture("n int, text string", tuple(enumerate(values)))


def over(derived: Derived, values: str) -> str:
    """DuckDB SQL: the expected rows (n, ..) of a fixture's rows, for every row of the given table."""
    return f"SELECT d.n, v.* EXCLUDE (n) FROM {derived.sql('d')} JOIN ({values}) AS v ON v.n = d.k"


KANA = Derived(texts("カゼガフク", "ラーメン", "かぜ", "abc", "風が吹く", "ヴァ", ""), pairs=True)
ROMAJI = Derived(texts("kaze", "shinbun", "gakkou", "kitte", "hu", "zasshi", "matcha", "konnichiwa", "Kaze shinbun", "tchizu", ""), pairs=True)
WIDTH = Derived(texts("ＡＢＣ　１２", "ａｂｃ！", "abc", "～"))
VERBS = Derived(texts("書く", "食べる", "泳ぐ", "話す", "待つ", "死ぬ", "遊ぶ", "読む", "買う", "風", ""), pairs=True)
ADJECTIVES = Derived(texts("高い", "静か", "い", ""), pairs=True)
POS = Derived(texts("風", "吹く", "高い", "静かな", "積極的", "ゆっくりと", "早くに", "", "するい"), pairs=True)
EXPAND = Derived(texts("高い", "書く", "風", "食べる"), pairs=True)
PHRASES = Derived(texts(
    "勉強する", "研究した結果", "そうだと思う", "言われてる", "食べさせられる", "読んでた", "割れてる", "劇的に変わった", "気が重い", "じっくり進む", "時間の無駄", "手を打つ", "風が吹く",
    "気に入る", "ボロカス言われてる", "abc", "すごく高い山", "言ってた", "やばいです", "  文法の分析  ", "炎上を消す", "ご覧ください", "でる",
))
PHRASE_PAIRS = Derived(PHRASES.fixture, pairs=True)
CANDIDATES = Derived(texts("雨が降る。風が吹く", "本を読む、山が高い", "空は青かった", "何もない", ""), pairs=True)
MARKED = Fixture(
    "graph_id string, raw string",
    (
        ("A", "あ||雨だから||行けないけど||ね。"),
        ("B", "きっと雨||うん||降るかもしれない"),
        ("C", "話したり||うん||旅したり"),
        ("D", " x || ||y||"),
        ("E", "ような感じ||わけだけど||まあ、だから||的には"),
        ("F", "寒いんじゃない||みたいな？||読み||ます||そういうの"),
    ),
)
#: Bits that meet every rule; a conversation's turns take them in turn, from a place of its own.
MARKERS = texts(
    "あ", "雨だから", "行けないけど", "ね。", "きっと雨", "うん", "降るかもしれない", "話したり", "うん", "旅したり", " x ", " ", "ような感じ", "わけだけど", "まあ、だから", "的には", "寒いんじゃない", "みたいな？",
    "読み", "ます", "そういうの", "たぶん雨だろう", "思いますけど", "plain \"text\" of more than forty characters, which views cut",
)


def marked_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_id, bit_idx, text, speaker: the turns of conversations, in order, with markers as their texts."""
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    k = F.pmod(F.col("conv_id") * 5 + F.col("nth"), F.lit(len(MARKERS.rows))).cast("int")
    rows = said.withColumn("nth", nth.cast("int")).withColumn("k", k).join(F.broadcast(MARKERS.spark(spark).toDF("k", "marker")), "k")
    return rows.select(F.col("conv_id").cast("string").alias("graph_id"), F.col("nth").alias("bit_idx"), F.col("marker").alias("text"), F.col("role").alias("speaker"))


#: The same in DuckDB.
MARKED_TURNS = f"""marked AS (SELECT CAST(conv_id AS VARCHAR) AS graph_id, CAST(nth AS INTEGER) AS bit_idx, m.text, role AS speaker FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS nth FROM conversations)
  JOIN {MARKERS.sql().replace("AS fx(n, text)", "AS m(n, text)")} ON m.n = (conv_id * 5 + nth) % {len(MARKERS.rows)})"""


def marked_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_id, raw: the marked turns of each conversation, joined."""
    turns = F.array_sort(F.collect_list(F.struct("bit_idx", "text")))
    return marked_turns(spark, sf_dir).groupBy("graph_id").agg(F.array_join(F.transform(turns, lambda x: x["text"]), "||").alias("raw"))


MARKED_GRAPHS = f"{MARKED_TURNS}, graphs AS (SELECT graph_id, string_agg(text, '||' ORDER BY bit_idx) AS raw FROM marked GROUP BY 1)"
TRANSCRIPT = Fixture("doc_id string, raw string", (("t1", "[00:05] あ||うん\n\n  [01:10]雨だから \nplain\n[1:02:03] x"), ("t2", "")))
PAGES = Fixture(
    "page_id bigint, headword string, html string",
    (
        (1, "風", "<table><tr><th>動詞</th></tr><tr><td>が吹く</td><td>風が吹く。</td></tr><tr><td>x</td></tr></table>"),
        (2, "夢", "<tr><td>の中</td><td>a &amp; b</td></tr><tr><td>副詞</td></tr><tr><td><b>よく</b></td><td></td></tr>"),
        (3, "無", "no rows"),
    ),
)
#: The pages' ids, each with one of these pages.
SCRAPED = Derived(Fixture("page string, headword string, html string", tuple((str(r[0]), *r[1:]) for r in PAGES.rows)), "pages", "page_id")
EDGES = Fixture(
    "graph_id string, edge_ord int, src_idx int, dst_idx int, relationship_type string",
    (
        ("g", 0, 0, 2, "causal-concessive-cascade"), ("g", 1, 2, 4, "connector-compounding"), ("g", 2, 4, 6, "x"), ("g", 3, 6, 8, "assertion-deflation"),
        ("g", 4, 0, 1, "sequential-adjacency"), ("h", 0, 0, 2, "x"), ("h", 1, 2, 0, "y"), ("h", 2, 0, 3, "z"), ("h", 3, 3, 5, "hedge-stance-softening"),
        ("h", 4, 5, 7, "epistemic-speculation-cascade"), *(("long", i, i, i + 1, f"t{i}") for i in range(8)), ("loop", 0, 3, 3, "x"), ("loop", 1, 3, 4, "y"),
    ),
)
BOOKMARKS = Fixture("id string, term string, dictionary string, saved_at bigint, folder string", (("b1", "風", "T1", 10, ""), ("b2", "雨", "T1", 11, "")))
NEW_BOOKMARKS = Fixture("id string, term string, dictionary string, saved_at bigint, folder string", (("n1", "風", "T1", 20, ""), ("n2", "風", "T2", 21, ""), ("n3", "風", "T2", 22, ""), ("n4", "夢", "T1", 23, "f")))
DICTS = Fixture(
    "title string, ja_title string, en_title string, abbreviation string, category string, language string",
    (
        ("T1", "大辞林 第四版", None, "大辞林4", "国語辞典", "ja"), ("T2", "新しい英和大辞典第二版です", "New Dictionary", "NED", "英和・和英", "en-ja"),
        ("T3", "とても長い題名の漢字辞典である", None, "漢", "漢字", "ja"), ("T4", "その他", None, "他", "雑", "ja"),
    ),
)
BANKS = {
    "index.json": '{"title":"T1","format":3,"revision":"1"}',
    "term_bank_2.json": '[["雨","あめ","n","",1,["rain"],2,""]]',
    "term_bank_10.json": '[["夢","","n v","",1,["dream",null,7],3,"common rare"]]',
    "term_bank_1.json": '[["風","かぜ","n","",5,["wind",{"type":"image","path":"a"},{"type":"structured-content","content":"s"}],1,"common"],["短",1,"n","",5],[5,"x","n","",5,[],1,""]]',
    "x/term_bank_1.json": '[["no","no","","",0,["no"],0,""]]',
    "kanji_bank_1.json": '[["風","フウ フ","かぜ","jouyou",["wind"],{"strokes":"9"}],["short","a","b","c"]]',
    "note.txt": "[]",
}
LEXICON_BATCH = Fixture("id string, frequency int, ord bigint", (("3", 77, 0), ("5", 1, 1), ("new1", 9, 2), ("5", 2, 3), ("new1", 10, 4), ("new2", 11, 5)))
