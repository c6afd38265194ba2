"""Licence scan by a positional rare-token index, with DataFrame functions only.

Templates are short licence statements with a key phrase that must stand whole. The index posts each template under the two words of its
key phrase with the highest inverse document frequency over the templates: word -> (template, place). Of a file, the words that have
postings are looked up; each posting gives a template's start in the file (place in the file minus place in the template). The starts
that a template's rarest and its second rarest word agree on are verified: every word of the key phrase must stand there. The
score is the share of the template's IDF that the file has at that start. Templates are rows of the index, not columns
of the plan, so that a longer list makes longer literals and no larger plan.

Defined results: a null or empty text has no words, no labels and score 0; an empty table gives an empty one. Repeated rows get a row
each, whatever their ids; other columns play no part. Long texts are scanned whole, in memory that grows with their words;
of several starts or templates all labels count, and the best score.
"""

from __future__ import annotations

from collections import Counter
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runtime

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: (label, statement, key phrase within it)
TEMPLATES = (
    ("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    ("artistic", "released under the artistic license 2 0", "artistic license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("bsd", "distributed under the bsd license", "bsd license"),
    ("bsl-1.0", "distributed under the boost software license version 1 0", "boost software license"),
    ("cc-by", "licensed under cc by 4 0", "cc by"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("epl", "made available under the terms of the eclipse public license", "eclipse public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "general public license"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "general public license version 2"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "general public license version 3"),
    ("isc", "distributed under the isc license", "isc license"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("public-domain", "released into the public domain", "public domain"),
    ("reserved", "all rights reserved", "all rights reserved"),
)
SCALE = 1000
#: A start is kept as template * STARTS + start + BEFORE, in one number, for a template may begin before the text does.
STARTS, BEFORE = 1 << 40, 1 << 16


def build_index(templates: tuple[tuple[str, str, str], ...] = TEMPLATES) -> list[dict]:
    """Per template: label, words, integer IDF of each word, place of the key phrase, its rarest and second rarest place."""
    have = Counter(w for _, text, _ in templates for w in set(text.split()))
    out = []
    for label, text, key in templates:
        words, phrase = text.split(), key.split()
        at = next(k for k in range(len(words)) if words[k : k + len(phrase)] == phrase)
        idf = [1 + round(SCALE * log(len(templates) / have[w])) for w in words]
        rare = sorted(range(at, at + len(phrase)), key=lambda k: (-idf[k], k))[:2]
        out.append({"label": label, "words": words, "idf": idf, "at": at, "phrase": phrase, "rare": (rare[0], rare[-1])})
    return out


INDEX = build_index()
#: Every key and base phrase holds one of these, so that other texts are done after a plain byte search.
ANCHORS = ("license", "cc", "reserved", "source", "creative", "granted", "domain")
assert all(any(a in p for a in ANCHORS) for p in [*(t[2] for t in TEMPLATES), *(b[0] for b in BASE)])


def _postings(index: list[dict], nth: int) -> dict[str, list[int]]:
    """Word -> what to add to its place in a file for the start of each template posted under it."""
    out: dict[str, list[int]] = {}
    for k, t in enumerate(index):
        place = t["rare"][nth]
        out.setdefault(t["words"][place], []).append(k * STARTS + BEFORE - place)
    return out


def _starts(postings: dict[str, list[int]]) -> Column:
    """The starts that the words of a file, at the places ``at``, give by these postings."""
    words = sorted(postings)
    table = F.create_map(*[x for w in words for x in (F.lit(w), F.array(*[F.lit(n).cast("long") for n in postings[w]]))])
    own = F.filter("at", lambda i: F.get("words", i).isin(words))
    return F.flatten(F.transform(own, lambda i: F.transform(F.try_element_at(table, F.get("words", i)), lambda n: n + i)))


def _rows(index: list[dict]) -> Column:
    """The templates as an array, one row each."""
    strings = lambda x: F.array(*[F.lit(w) for w in x])
    return F.array(
        *[
            F.struct(
                F.lit(t["label"]).alias("label"),
                strings(t["words"]).alias("words"),
                F.array(*[F.lit(n) for n in t["idf"]]).alias("idf"),
                F.lit(t["at"]).alias("at"),
                F.lit(len(t["phrase"])).alias("n"),
                F.lit(float(sum(t["idf"]))).alias("total"),
            )
            for t in index
        ]
    )


def _stands(words: Column, start: Column, phrase: list[str]) -> Column:
    out = F.lit(True)
    for k, w in enumerate(phrase):
        out = out & F.coalesce(F.get(words, start + k) == w, F.lit(False))
    return out


def _where(places: str | Column, words: Column, ahead: int, phrase: list[str]) -> Column:
    """Of places, those from which the phrase stands ``ahead`` words further on."""
    return F.filter(places, lambda i: _stands(words, i + ahead, phrase))


def _verified(index: list[dict]) -> Column:
    """(label, score) of the starts on which a template's two rare words agree and at which its key phrase stands."""
    words, rows = F.col("words"), _rows(index)
    agreed = F.array_intersect(_starts(_postings(index, 0)), _starts(_postings(index, 1)))

    def stands(t: Column, start: Column, k: Column) -> Column:
        return F.coalesce(F.get(words, start + k) == F.get(t["words"], k), F.lit(False))

    def judged(code: Column) -> Column:
        t, start = F.get(rows, F.shiftright(code, 40).cast("int")), (code.bitwiseAND(F.lit(STARTS - 1)) - BEFORE).cast("int")
        return F.struct(t.alias("t"), start.alias("start"))

    def whole(c: Column) -> Column:
        return F.forall(F.sequence(c["t"]["at"], c["t"]["at"] + c["t"]["n"] - 1), lambda k: stands(c["t"], c["start"], k))

    def scored(c: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(c["t"]["words"]) - 1)
        worth = F.aggregate(places, F.lit(0), lambda sum_, k: sum_ + F.when(stands(c["t"], c["start"], k), F.get(c["t"]["idf"], k)).otherwise(0))
        return F.struct(c["t"]["label"].alias("label"), (worth / c["t"]["total"]).alias("score"))

    return F.transform(F.filter(F.transform(agreed, judged), whole), scored)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: list[dict] = INDEX, anchors: tuple[str, ...] | None = ANCHORS) -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    index: of ``build_index``, for templates of one's own; ``anchors`` are then parts of which each key and base phrase holds one, or None.
    """
    runtime.prepare(df.sparkSession)
    words = F.col("words")
    step = df.select(F.col(id_col).alias("id"), F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER).alias("low"))
    step = step.select("id", "low", F.filter(F.split("low", BETWEEN, -1), lambda w: w != "").alias("words"))
    maybe = F.lit(True) if anchors is None else runtime.any_of([F.contains("low", F.lit(a)) for a in anchors])
    step = step.select("id", F.size("words").cast("long").alias("n_words"), F.when(maybe, words).alias("words"))
    none = F.array().cast("array<int>")
    # Places of the words that have postings or are of a base phrase; all that follows looks at these only.
    vocabulary = sorted({t["words"][k] for t in index for k in t["rare"]} | {w for p, _ in BASE for w in p.split()})
    at = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).isin(vocabulary))
    step = step.select("id", "n_words", "words", F.when(F.size("words") > 0, at).otherwise(none).alias("at"))
    base = [_where("at", words, 0, p.split()).alias(f"base_{label}") for p, label in BASE]
    found = F.when(F.size("at") > 0, _verified(index)).alias("found")
    step = step.select("id", "n_words", *base, found)
    starts = F.concat(*[f"base_{label}" for _, label in BASE])
    base_labels = F.array_compact(F.array(*[F.when(F.size(f"base_{label}") > 0, F.lit(label)) for _, label in BASE]))
    labels = F.coalesce(F.transform("found", lambda x: x["label"]), F.array().cast("array<string>"))
    score = F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0))
    return step.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, labels))), ",").alias("labels"),
        score.alias("score"),
    )


def sql() -> str:
    """The same as a join of every word with the index, for DuckDB."""
    rows = [f"({k}, '{t['label']}', {p}, '{w}', {t['idf'][p]}, {str(t['at'] <= p < t['at'] + len(t['phrase'])).lower()})" for k, t in enumerate(INDEX) for p, w in enumerate(t["words"])]
    base = [f"({k}, '{label}', {p}, '{w}')" for k, (phrase, label) in enumerate(BASE) for p, w in enumerate(phrase.split())]
    return f"""
WITH t(tid, label, p, word, idf, must) AS (VALUES {", ".join(rows)}),
b(bid, label, p, word) AS (VALUES {", ".join(base)}),
need AS (SELECT tid, any_value(label) AS label, count(*) FILTER (must) AS musts, sum(idf) AS total FROM t GROUP BY tid),
bneed AS (SELECT bid, any_value(label) AS label, count(*) AS n FROM b GROUP BY bid),
texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
), w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM texts),
hits AS (
  SELECT doc_id, tid, pos - p AS off, sum(idf) AS worth, count(*) FILTER (must) AS musts FROM w JOIN t USING (word) GROUP BY ALL
), found AS (SELECT h.doc_id, n.label, h.worth / n.total::DOUBLE AS score FROM hits h JOIN need n ON n.tid = h.tid AND n.musts = h.musts),
bhits AS (SELECT doc_id, bid, pos - p AS start, count(*) AS n FROM w JOIN b USING (word) GROUP BY ALL),
bfound AS (SELECT h.doc_id, n.label, h.start FROM bhits h JOIN bneed n ON n.bid = h.bid AND n.n = h.n),
bases AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM bfound GROUP BY doc_id),
alls AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
         FROM (SELECT doc_id, label, 0.0::DOUBLE AS score FROM bfound UNION ALL SELECT doc_id, label, score FROM found) GROUP BY doc_id)
SELECT x.doc_id, len(x.words)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM texts x LEFT JOIN bases ON bases.doc_id = x.doc_id LEFT JOIN alls ON alls.doc_id = x.doc_id
"""
