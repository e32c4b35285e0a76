"""Pattern extraction: a catalogue of regular expressions over running text.

The catalogue is a table of specifications: the rows of pattern_catalogue turned into expressions
by rule, extended or replaced by the caller's own.  Applying it is this engine's own semantics:
every left-to-right match of every specification is a row; nothing is suppressed unless best_only
is asked for.

Hundreds of expressions per text would be slow, so one scan of a text finds which markers (the
literal parts that a specification can't do without) occur in it, and only their specifications
are evaluated there.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import reduce

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import SPACE_SET
from . import pattern_catalogue as given

CONTENT_WORD = f"[^{SPACE_SET}。、！？「」（）『』【】…〜・]{{1,14}}"
OTHER = f"[^{SPACE_SET}。、！？「」（）]"
#: What {N}, {S}, {M} and {W} stand for in an expression.
ATOMS = {"{N}": CONTENT_WORD, "{S}": OTHER + "{2,12}", "{M}": OTHER + "{2,14}", "{W}": OTHER}
MOST_GROUPS = 4


@dataclass(frozen=True)
class Spec:
    """An expression with at most four groups, and what its matches are called.  $1 .. $4 in head
    and collocate are the groups, of which absent ones are empty."""

    family: str
    expression: str
    head: str
    collocate: str
    pattern: str
    label: str
    head_pos: str
    collocate_pos: str
    confidence: int

    @property
    def regex(self) -> str:
        out = self.expression
        for name, atom in ATOMS.items():
            out = out.replace(name, atom)
        return out

    @property
    def markers(self) -> list[str]:
        """Texts of which each match holds one: the first run of parts that are literal and not optional."""
        out: list[str] = []
        for group, optional, plain in re.findall(r"\(([^()]*)\)(\?)?|(\\\d|\{.\}|\[[^\]]*\](?:\{[^}]*\})?|[^()\\{\[])", self.expression):
            free = optional or re.search(r"[\[\\{]", group or plain)
            if free:
                if out:
                    break
                continue
            words = [re.sub(r".\?", "", w) for w in group.split("|")] if group else [plain]
            out = [a + b for a, b in itertools.product(out or [""], words)]
        return out


def built_in() -> tuple[Spec, ...]:
    """The specifications of the built-in rows."""
    out = [Spec(*row) for row in given.EXPRESSIONS]
    for marker, attributive, label, confidence in given.POSTPOSITIONS:
        common = (given.NOUN, given.EXPRESSION)
        out.append(Spec("複合後置詞型", f"({{N}}){marker}(の)?", "$1", marker, f"N+{marker}", label, *common, confidence))
        out.append(Spec("複合後置詞型", f"({{N}}){attributive}({{W}}{{1,10}})?", "$1", f"{attributive}$2", f"N+{marker}+N", f"{label}(連体)", *common, confidence - 2))
    for family, head, head_pos, collocate_pos, rows in given.MARKERS:
        out += [Spec(family, head + marker, "$1", marker, pattern, label, head_pos, collocate_pos, confidence) for marker, pattern, label, confidence in rows]
    for part, verbs, label in given.BODY_IDIOMS:
        out.append(Spec("複合動詞型", f"{part}が({'|'.join(verbs)})", part, "が$1", f"{part}が+V/Adj", label, given.NOUN, given.VERB, 85))
    return tuple(out)


SPECS = built_in()


def load_catalogue(path: str) -> tuple[Spec, ...]:
    """Specifications from a JSON list of objects with Spec's fields: the way to a larger catalogue."""
    with open(path, encoding="utf-8") as f:
        return tuple(Spec(**x) for x in json.load(f))


def dump_catalogue(specs: tuple[Spec, ...], path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump([asdict(x) for x in specs], f, ensure_ascii=False)


def any_of(words: list[str]) -> str:
    """An expression for the longest of some words at a place, as a tree of their characters."""
    kids: dict[str, list[str]] = {}
    for word in words:
        if word:
            kids.setdefault(word[0], []).append(word[1:])
    if not kids:
        return ""
    inner = "|".join(re.escape(c) + any_of(rest) for c, rest in kids.items())
    return f"(?:{inner})" + "?" * ("" in words)


def _templated(template: str, groups: Column) -> Column:
    """The text of a template column's parts (text, group)."""
    return F.array_join(F.transform(template, lambda p: F.when(p["group"] > 0, F.get(groups, p["group"] - 1)).otherwise(p["text"])), "")


def _parts(template: str) -> list[tuple[str, int]]:
    return [("", int(p[1:])) if re.fullmatch(r"\$\d", p) else (p, 0) for p in re.split(r"(\$\d)", template) if p]


CATALOGUE = (
    "spec_id int, family string, regex string, groups int, head array<struct<text string, group int>>, collocate_parts array<struct<text string, group int>>, "
    "pattern string, label string, headword_pos string, collocate_pos string, confidence int"
)
MATCH = ("spec_id", "family", "pattern", "label", "headword", "collocate", "headword_pos", "collocate_pos", "start", "end", "confidence")


def extract_patterns(df: DataFrame, key: str, column: str = "text", specs: tuple[Spec, ...] = SPECS, best_only: bool = False) -> DataFrame:
    """key and the columns MATCH for every match of every specification in the texts of `df`; start
    and end count code points, end exclusive.

    Null texts have no matches; equal and null keys are told apart by nothing, each row is read by
    itself.  The catalogue is a literal of the plan: its size is fixed by the caller, not by the data.
    """
    by_marker: dict[str, list[int]] = {}
    for i, spec in enumerate(specs):
        for marker in spec.markers:
            by_marker.setdefault(marker, []).append(i)
    # the scan finds the longest marker at each place; shorter ones that it begins with are there too
    by_found = {m: sorted({i for k in range(1, len(m) + 1) for i in by_marker.get(m[:k], ())}) for m in by_marker}
    which = F.map_from_arrays(F.array(*map(F.lit, by_found)), F.array(*[F.array(*map(F.lit, ids)) for ids in by_found.values()]))
    found = F.array_distinct(F.expr(f"regexp_extract_all(body, r'(?=({any_of(list(by_found))}))', 1)"))
    scanned = df.select(key, F.col(column).alias("body")).withColumn("found", found).where(F.size("found") > 0)
    ids = F.array_distinct(F.flatten(F.transform("found", lambda m: F.element_at(which, m))))
    rows = [
        (i, s.family, s.regex, re.compile(s.regex).groups, _parts(s.head), _parts(s.collocate), s.pattern, s.label, s.head_pos, s.collocate_pos, s.confidence)
        for i, s in enumerate(specs)
    ]
    catalogue = df.sparkSession.createDataFrame(rows, CATALOGUE)
    hit = scanned.select(key, "body", F.explode(ids).alias("spec_id")).join(catalogue, "spec_id")
    return _evaluated(hit, key, best_only)


def _evaluated(hit: DataFrame, key: str, best_only: bool) -> DataFrame:
    """The matches of (key, body and the columns of a specification that may match there)."""
    # a match starts behind the matches and the texts between matches before it
    matches, between = F.expr("regexp_extract_all(body, regex, 0)"), F.expr("split(body, regex, -1)")
    total = lambda texts: F.aggregate(texts, F.lit(0), lambda n, t: n + F.length(t))
    if "starts" in hit.columns:  # of a plain text they are known already
        matches, between = (F.when(F.col("starts").isNull(), x) for x in (matches, between))
    hit = hit.withColumn("matches", matches).withColumn("between", between)
    start = lambda i: total(F.slice("between", 1, i + 1)) + total(F.slice("matches", 1, i))
    found = F.transform("matches", lambda m, i: F.struct(m.alias("text"), start(i).alias("start")))
    if "starts" in hit.columns:
        found = F.coalesce(F.transform("starts", lambda at: F.struct(F.col("literal").alias("text"), at.alias("start"))), found)
    one = hit.withColumn("m", F.explode(found))
    group = lambda k: F.when(F.col("groups") >= k, F.expr(f"regexp_extract(m.text, regex, {k})")).otherwise("")
    one = one.withColumn("texts", F.array(*[group(k) for k in range(1, MOST_GROUPS + 1)]))
    one = one.withColumn("headword", _templated("head", F.col("texts"))).withColumn("collocate", _templated("collocate_parts", F.col("texts")))
    one = one.withColumn("start", F.col("m.start")).withColumn("end", F.col("m.start") + F.length("m.text"))
    if not best_only:
        return one.select(key, *MATCH)
    # the best of a text's matches that start at one place; the text tells rows with one key apart
    best = W.partitionBy(key, F.xxhash64("body"), "start").orderBy(F.desc("confidence"), F.desc("end"), "spec_id")
    return one.withColumn("nth", F.row_number().over(best)).where("nth = 1").select(key, *MATCH)


# ------------------------------------------------------------------ catalogues of any size

SPEC_FILE = "spec_id long, family string, expression string, head string, collocate string, pattern string, label string, head_pos string, collocate_pos string, confidence int"
#: Bytes of specifications that are broadcast at once.
ROUND_BYTES = 64_000_000
_LOADED = CATALOGUE.replace("spec_id int", "spec_id long")
_NAMES = ("spec_id", "family", "regex", "groups", "head", "collocate_parts", "pattern", "label", "headword_pos", "collocate_pos", "confidence")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Specifications from JSON lines (the fields of SPEC_FILE), ready to be applied, with their markers: the columns of
    CATALOGUE and `markers`.  A specification without a literal part has no marker and is never tried."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                spec_id = row.pop("spec_id")
                s = Spec(**row)
                parts = [[{"text": t, "group": g} for t, g in _parts(x)] for x in (s.head, s.collocate)]
                out.append((spec_id, s.family, s.regex, re.compile(s.regex).groups, *parts, s.pattern, s.label, s.head_pos, s.collocate_pos, s.confidence, [m for m in s.markers if m]))
            yield pd.DataFrame(out, columns=[*_NAMES, "markers"])

    return spark.read.schema(SPEC_FILE).json(path).mapInPandas(work, f"{_LOADED}, markers array<string>")


def _rounds(catalogue: DataFrame, most: int) -> Iterator[list[dict]]:
    """The specifications in parts of so many bytes at most (one at least)."""
    some, size = [], 0
    for r in catalogue.where(F.size("markers") > 0).toLocalIterator():
        row = r.asDict(recursive=True)
        n = len(json.dumps(row, ensure_ascii=False).encode())
        if some and size + n > most:
            yield some
            some, size = [], 0
        some.append(row)
        size += n
    if some:
        yield some


#: An expression that is a plain text, or one in a group.
_PLAIN = re.compile(r"(\()?([^\\.\[\]{}()*+?^$|]+)(?(1)\))")


def _literal(spec: dict) -> str | None:
    """The text that a specification is, if it is one and its marker."""
    plain = _PLAIN.fullmatch(spec["regex"])
    return plain[2] if plain and spec["markers"] == [plain[2]] else None


def _apart(ends: list[int], size: int) -> list[int]:
    """Where a text of this size stands, from left to right without overlaps, by where it ends (inclusive, rising)."""
    out, free = [], 0
    for end in ends:
        if end - size + 1 >= free:
            out.append(end - size + 1)
            free = end + 1
    return out


def _tried(texts: DataFrame, key: str, specs: list[dict]) -> DataFrame:
    """key, body and a specification, for the specifications of which some marker stands in the text: one walk
    over a text finds all of them, and they join it where it is.  Where a specification is a plain text, the walk
    gives its matches (`starts`, else null) and no expression is tried."""
    sent = texts.sparkSession.sparkContext.broadcast(specs)
    kind = texts.schema[key].dataType.simpleString()
    inner = texts.sparkSession.createDataFrame([], f"{_LOADED}, literal string, starts array<int>").schema
    schema = f"{key} {kind}, body string, specs array<{inner.simpleString()}>"
    listed = pa.list_(to_arrow_type(inner))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_marker: dict[str, list[int]] = {}
        for i, spec in enumerate(sent.value):
            for marker in spec["markers"]:
                by_marker.setdefault(marker, []).append(i)
        automaton = ahocorasick.Automaton()
        for marker, ids in by_marker.items():
            automaton.add_word(marker, ids)
        automaton.make_automaton()
        literals = [_literal(spec) for spec in sent.value]

        def listed_of(text: str | None) -> list[dict]:
            ends: dict[int, list[int]] = {}
            for end, ids in automaton.iter(text) if text else ():
                for i in ids:
                    ends.setdefault(i, []).append(end)
            plain = lambda i: {"literal": literals[i], "starts": None if literals[i] is None else _apart(ends[i], len(literals[i]))}
            return [{n: sent.value[i][n] for n in _NAMES} | plain(i) for i in sorted(ends)]

        for batch in batches:
            for begin in range(0, batch.num_rows, TEXTS):
                part = batch.slice(begin, TEXTS)
                found = [listed_of(t) for t in part.column(1).to_pylist()]
                some = pa.array([i for i, specs_ in enumerate(found) if specs_], pa.int64())
                lists = pa.array([specs_ for specs_ in found if specs_], listed)
                yield pa.RecordBatch.from_arrays([part.column(0).take(some), part.column(1).take(some), lists], names=[key, "body", "specs"])

    return texts.mapInArrow(work, schema).select(key, "body", F.explode("specs").alias("s")).select(key, "body", "s.*")


#: Texts whose specifications are listed at once.
TEXTS = 64


def extract_by_catalogue(df: DataFrame, key: str, catalogue: DataFrame, column: str = "text", best_only: bool = False, most: int = ROUND_BYTES) -> DataFrame:
    """extract_patterns for a catalogue table of any size (see read_catalogue).

    Specifications aren't part of the plan: they are broadcast, `most` bytes of them at a time, with an automaton of
    their markers, and no text is shuffled.  A larger catalogue is more walks over the texts.
    """
    texts = df.select(key, F.col(column).alias("body"))
    tried = [_tried(texts, key, some) for some in _rounds(catalogue, most)]
    if not tried:
        blank = df.sparkSession.createDataFrame([], f"{_LOADED}, literal string, starts array<int>")
        tried = [texts.limit(0).join(blank, F.lit(True))]
    return _evaluated(reduce(DataFrame.unionByName, tried), key, best_only)
