"""Adaptive thresholds of the quality rules against plain Python."""

from collections import defaultdict

from lodestone.llm import quality


def bucket(v: int) -> int:
    shift = max(max(v.bit_length(), 1) - 5, 0)
    return v >> shift << shift


def ranked(values: list[int], share: int) -> int:
    return sorted(values)[(len(values) * share + 3) // 4 - 1]


def test_verdicts(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality.metrics(df).withColumns(quality.rates()).withColumn("base_failed", quality.base_failed()).collect()
    groups = defaultdict(list)
    for r in rows:
        if not r["base_failed"]:
            for m, _, _ in quality.FENCED:
                groups[r["lang"], r["source"], m].append(bucket(r[m]))
                groups[r["lang"], m].append(bucket(r[m]))
    wanted = {}
    for r in rows:
        good = not r["base_failed"]
        for m, sides, least in quality.FENCED if good else ():
            values = groups[r["lang"], r["source"], m]
            values = values if len(values) >= quality.MIN_GROUP else groups[r["lang"], m]
            q1, q3 = ranked(values, 1), ranked(values, 3)
            reach = quality.SPREAD * max(q3 - q1, q3 // 4, least)
            good &= r[m] <= q3 + reach and (sides == "high" or r[m] >= q1 - reach)
        wanted[r["doc_id"]] = good
    assert {r["doc_id"]: r["kept"] for r in quality.verdicts(df).collect()} == wanted
    assert 0 < sum(wanted.values()) < len(wanted)
