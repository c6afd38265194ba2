"""Line dedup by winnowing over line hashes, with DataFrame functions only.

Lines with at least one word count; lines without one are left where they are. A *window* of a line is the
shortest run of lines with ``min_words`` words that begins there, and the shortest that ends there.

1. Winnowing: of each window that begins at a line, the place of the least line hash (the first, if it recurs) is selected. A run of
   min_words words that occurs twice holds a whole window, so a selected place, at the same distance from its begin in both places.
   Only selected places leave the map side: a document of short lines sends a few in a hundred.
2. Positions are joined on the selected line's hash (128 bits). Each carries its surroundings: the lines that a window through
   it can reach, some 50 words to either side. Every later place is matched with the earliest place of its hash and the match is extended,
   line by line, in both directions. Where it has min_words words, its lines are later repeats.
3. A place whose surroundings the earliest place doesn't match whole may have more in common with another. What such
   places have in common with each other is settled by the hashes of the windows through them, so that no pairs are made of the
   places of a line that stands in many documents.

So a line goes if and only if it lies in a run of lines with min_words words or more that has begun
at an earlier place of the corpus as well, in the order of (doc_id, position). Runs that overlap their own earlier copy count too.
Documents that lose no line aren't shuffled, as far as a bitmap of those that do can tell (its size has a bound).

Defined results: null text stays null and has no lines; rows that agree in doc_id and text are one document and get
the same decision; a null doc_id comes first. An empty table gives an empty result; a very long text counts whole, as one row of its
places at a time. Ties can't occur: places are distinct.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runtime

MIN_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"


def _text_key(text: str) -> Column:
    """Tells apart the texts of one doc_id."""
    return F.coalesce(F.xxhash64(F.col(text)), F.lit(0))


def _words(line: Column, odd: Column) -> Column:
    """Words of a line. odd: whether its text has other white space than single spaces between words."""
    return F.when(odd, F.regexp_count(line, F.lit(WORD))).when(line == "", 0).otherwise(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1)


def _odd(text: Column) -> Column:
    return runtime.any_of([F.contains(text, F.lit(x)) for x in ("\t", "\x0b", "\x0c", "\r", "  ", "\n ", " \n")]) | F.startswith(text, F.lit(" ")) | F.endswith(text, F.lit(" "))


def _reach(counts: Column, least: int) -> Column:
    """How many of the first counts have ``least`` words; 0 if all don't."""

    def walk(few: Column) -> Column:
        # Words so far above 2^20 times the counts used: one long, as it is made anew for each count. Lines beyond ``least`` words end it.
        step = lambda a, x: F.when(F.shiftright(a, 20) < least, a + F.shiftleft(x.cast("long"), 20) + 1).otherwise(a)
        return F.aggregate(few, F.lit(0).cast("long"), step, lambda a: F.when(F.shiftright(a, 20) >= least, a % (1 << 20)).otherwise(0).cast("int"))

    return F.when(F.get(counts, F.lit(0)) >= least, 1).otherwise(_let(walk(F.slice(counts, 1, 4)), lambda r: F.when((r > 0) | (F.size(counts) <= 4), r).otherwise(walk(counts))))


def _ascending(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _lines(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, k, h, g: hashes of lines with a word, n: their words)."""
    whole = F.coalesce(F.col(text), F.lit(""))

    def split(text: Column, odd: Column) -> Column:
        lines = F.transform(F.split(text, "\n", -1), lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(7), x).alias("g"), _words(x, odd).alias("n")))
        return F.filter(lines, lambda x: x["n"] > 0)

    # _odd is taken once a text here; as a column of its own it would be moved to where lines are counted.
    lines = _let2(whole, _odd(whole), split)
    return df.select(F.col(doc_id).alias("doc_id"), _text_key(text).alias("k"), lines.alias("lines")).select("doc_id", "k", *(F.col(f"lines.{c}").alias(c) for c in "hgn"))


def selected(df: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(f, g: the line's hashes, place: (doc_id, k, pos), before, after: (h, n) of the surrounding lines from the nearest on, n)."""
    h, n, last = F.col("h"), F.col("n"), F.size("h")

    def least(i: Column) -> Column:
        """The place of the least hash of the window that begins at i; null if there is no such window."""
        place = lambda own: i + F.array_position(own, F.array_min(own)).cast("int") - 1
        # A line has a word at least, so a window has min_words lines at most.
        return _let(_let(F.slice(n, i + 1, min_words), lambda own: _reach(own, min_words)), lambda size: F.when(size == 1, i).when(size > 1, _let(F.slice(h, i + 1, size), place)))

    def side(words: Column, hashes: Column) -> Column:
        """The nearest lines: up to the first that ends min_words words, and one more, which a window may begin or end with."""
        keep = lambda many: F.struct(F.slice(hashes, 1, many).alias("h"), F.slice(words, 1, many).alias("n"))
        return _let(_reach(words, min_words), lambda need: keep(F.when(need > 0, need + 1).otherwise(F.size(words))))

    def around(pos: Column) -> Column:
        first = F.greatest(pos - min_words - 1, F.lit(0))
        back = lambda x: F.reverse(F.slice(x, first + 1, pos - first))
        on = lambda x: F.slice(x, pos + 2, min_words + 1)
        return F.struct(F.get(h, pos).alias("f"), F.get("g", pos).alias("g"), pos.alias("pos"), F.get(n, pos).alias("n"), _let2(back(n), back(h), side).alias("before"), _let2(on(n), on(h), side).alias("after"))

    places = F.array_distinct(F.array_compact(F.transform(_ascending(last), least)))
    rows = _lines(df, id_col, text_col).select("doc_id", "k", F.explode(F.transform(places, around)).alias("x"))
    return rows.select("x.f", "x.g", F.struct("doc_id", "k", "x.pos").alias("place"), "x.n", "x.before", "x.after")


def _agree(a: Column, b: Column) -> Column:
    """How many hashes agree from the first on."""
    both = F.least(F.size(a), F.size(b))
    differ = F.array_position(F.zip_with(F.slice(a, 1, both), F.slice(b, 1, both), lambda x, y: x != y), True)
    return F.when(differ > 0, differ - 1).otherwise(both).cast("int")


def _sum(n: Column) -> Column:
    return F.aggregate(n, F.lit(0), lambda s, x: s + x)


def removals(df: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, k, gone): for each document that loses lines, their 0-based places among its lines with a word."""
    places = runtime.cut(selected(df, min_words, id_col, text_col))
    # The earliest place of each hash; a line that many documents share is reduced before the shuffle.
    leaders = places.groupBy("f", "g").agg(F.min(F.struct("place", "before", "after")).alias("lead"), F.count("*").alias("times")).where("times > 1")
    met = places.join(leaders, ["f", "g"]).where(F.col("place") != F.col("lead.place"))
    met = met.select("*", _agree(F.col("before.h"), F.col("lead.before.h")).alias("up"), _agree(F.col("after.h"), F.col("lead.after.h")).alias("down"))
    words = F.col("n") + _sum(F.slice("before.n", 1, F.col("up"))) + _sum(F.slice("after.n", 1, F.col("down")))
    met = met.select("f", "g", "place", "n", "before", "after", "up", "down", (words >= min_words).alias("repeats"), ((F.col("times") > 2) & ((F.col("up") < F.size("before.h")) | (F.col("down") < F.size("after.h")))).alias("open"))
    met = runtime.cut(met.where("repeats OR open").select("*", F.xxhash64("f", "g").alias("line")))
    # Among places that the earliest doesn't match whole: the windows through them.
    own, at = F.concat(F.reverse("before.h"), F.array("f"), F.col("after.h")), F.size("before.h")
    counts = F.concat(F.reverse("before.n"), F.array("n"), F.col("after.n"))
    open_places = met.where("open").select("line", "place", "up", "down", own.alias("own"), at.alias("at"), F.explode(_windows(counts, at, min_words)).alias("w"))
    # What lies within the match with the earliest place is settled.
    open_places = open_places.where("w.start < at - up OR w.start + w.size - 1 > at + down")
    said = F.slice("own", F.col("w.start") + 1, F.col("w.size"))
    start, size = F.col("w.start") - F.col("at"), F.col("w.size")
    open_places = open_places.select("line", "place", start.alias("start"), size.alias("size"), F.xxhash64(said).alias("said"), F.xxhash64(F.lit(7), said).alias("too"))
    key = ["line", "start", "said", "too"]
    first = open_places.groupBy(*key).agg(F.min("place").alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    later = open_places.join(first, key).where(F.col("place") != F.col("first"))
    found = met.where("repeats").select("place.*", (-F.col("up")).alias("low"), F.col("down").alias("high"))
    found = found.union(later.select("place.*", F.col("start").alias("low"), (F.col("start") + F.col("size") - 1).alias("high")))
    runs = found.select("doc_id", "k", F.struct((F.col("pos") + F.col("low")).alias("low"), (F.col("pos") + F.col("high")).alias("high")).alias("run")).distinct()
    gone = runs.select("doc_id", "k", F.explode(F.sequence("run.low", "run.high")).alias("line"))
    return gone.groupBy("doc_id", "k").agg(F.sort_array(F.collect_set("line")).alias("gone"))


def _windows(n: Column, at: Column, min_words: int) -> Column:
    """Array of (start, size) of the windows, 0-based, that begin or end at a line and hold the line ``at``."""
    last = F.size(n)
    forward = F.transform(_ascending(at + 1), lambda i: F.struct(i.alias("start"), _reach(F.slice(n, i + 1, min_words), min_words).alias("size")))
    first = lambda i: F.greatest(i - (min_words - 1), F.lit(0))
    ends = F.transform(F.sequence(at, last - 1), lambda i: F.struct(i.alias("end"), _reach(F.reverse(F.slice(n, first(i) + 1, i - first(i) + 1)), min_words).alias("size")))
    back = F.transform(ends, lambda x: F.struct((x["end"] - x["size"] + 1).alias("start"), x["size"].alias("size")))
    return F.array_distinct(F.filter(F.concat(forward, back), lambda x: (x["size"] > 0) & (x["start"] <= at) & (x["start"] + x["size"] > at)))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _let2(x: Column, y: Column, use: Callable[[Column, Column], Column]) -> Column:
    return _let(F.struct(x.alias("x"), y.alias("y")), lambda v: use(v["x"], v["y"]))


def _without(text: Column, gone: Column) -> Column:
    """A text without some of its lines with a word: the runs of lines between those, put together again."""

    def runs(lines: Column, gaps: Column) -> Column:
        """gaps: the places of the lines that go, with one before the first line and one after the last."""
        kept = F.transform(F.sequence(F.lit(1), F.size(gaps) - 1), lambda j: F.slice(lines, F.get(gaps, j - 1) + 2, F.get(gaps, j) - F.get(gaps, j - 1) - 1))
        return F.array_join(F.flatten(kept), "\n")

    def cut(lines: Column) -> Column:
        places = F.array_compact(F.transform(lines, lambda x, i: F.when(x.rlike(WORD), i)))
        dropped = _let(places, lambda at: F.transform(gone, lambda g: F.get(at, g)))
        return _let(F.concat(F.array(F.lit(-1)), dropped, F.array(F.size(lines))), lambda gaps: runs(lines, gaps))

    return _let(F.split(text, "\n", -1), cut)


def dedup_lines(df: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with later repeats cut out of its texts, and with n_lines, n_removed."""
    runtime.prepare(df.sparkSession)
    own = runtime.prefix(df)
    removed = runtime.cut(removals(df, min_words, id_col, text_col).select(F.col("doc_id").alias(own + "id"), F.col("k").alias(own + "k"), F.col("gone").alias(own + "gone"), F.xxhash64("doc_id", "k").alias(own + "key")))
    keyed = df.withColumn(own + "text_key", _text_key(text_col))
    key = F.xxhash64(F.col(id_col), F.col(own + "text_key"))
    n_lines, n_removed = runtime.fresh(df, "n_lines"), runtime.fresh(df, "n_removed")
    real = F.coalesce(F.size(F.filter(F.split(text_col, "\n", -1), lambda x: x.rlike(WORD))), F.lit(0)).cast("long")
    paged, likely = runtime.marked(keyed, key, runtime.bitmap(removed, own + "key"))
    same = F.col(id_col).eqNullSafe(F.col(own + "id")) & (F.col(own + "text_key") == F.col(own + "k")) & (key == F.col(own + "key"))
    gone = F.col(own + "gone")
    text = F.when(gone.isNull(), F.col(text_col)).otherwise(_without(F.col(text_col), gone))
    some = paged.where(likely).select(*df.columns, own + "text_key").join(removed, same, "left")
    some = some.withColumns({n_lines: real, n_removed: F.coalesce(F.size(gone), F.lit(0)).cast("long"), text_col: text}).select(*df.columns, n_lines, n_removed)
    rest = paged.where(~likely).select(*df.columns, real.alias(n_lines), F.lit(0).cast("long").alias(n_removed))
    return rest.union(some)


SQL = r"""
WITH every AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents
), counted AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM every
), lines AS (
  SELECT doc_id, line, place, words, row_number() OVER d - 1 AS i, sum(words) OVER d AS upto, sum(words) OVER d - words AS before
  FROM counted WHERE words > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY place)
), bounds AS (
  SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM lines a JOIN lines b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.before >= 50 GROUP BY ALL
  UNION
  SELECT b.doc_id, max(a.i) AS s, b.i AS e FROM lines a JOIN lines b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.before >= 50 GROUP BY b.doc_id, b.i
), runs AS (
  SELECT w.doc_id, w.s, w.e, string_agg(l.line, chr(10) ORDER BY l.i) AS said FROM bounds w JOIN lines l ON l.doc_id = w.doc_id AND l.i BETWEEN w.s AND w.e GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY said ORDER BY doc_id, s) AS nth FROM runs
), gone AS (
  SELECT DISTINCT l.doc_id, l.place FROM ranked r JOIN lines l ON l.doc_id = r.doc_id AND l.i BETWEEN r.s AND r.e WHERE r.nth > 1
), kept AS (
  SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.place) AS text
  FROM every e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.place = e.place WHERE g.doc_id IS NULL GROUP BY e.doc_id
)
SELECT d.doc_id,
       (SELECT count(*) FROM lines l WHERE l.doc_id = d.doc_id) AS n_lines,
       (SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id) AS n_removed,
       md5(coalesce(k.text, '')) AS text_md5
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
