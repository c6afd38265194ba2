"""Each operator's query against its contract, on hard rows and on whole driver tables."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
from lodestone.llm import byte_bpe, decontaminate, license_scan, line_dedup, near_dedup, quality, queries, sharding, url_filter, warc

from tests import oracle
from tests.llm import brute, tables

BASE = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
TOKENS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def docs_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.fixture(params=["plain", "extra", "empty"])
def documents(request, spark):
    if request.param == "empty":
        return tables.empty(spark)
    return tables.documents(spark, extra=request.param == "extra").cache()


@pytest.fixture(params=["tiny", "0.01"])
def folder(request):
    return "/root/testdata/sf0.001" if request.param == "tiny" else "/root/testdata/sf0.01"


# -- 2 ----------------------------------------------------------------------------------------------


def check_quality(got, docs):
    wanted = [(d, *brute.base_metrics(t)) for d, t in docs]
    assert tables.rows(got, *BASE) == ordered(wanted)
    assert not got.where("base_failed AND kept").count()


def test_quality_hard_rows(documents):
    check_quality(quality.verdicts(documents), docs_of(documents))


def test_quality_query(spark, folder):
    check_quality(queries.op2_quality_rules(spark, folder), docs_of(spark.read.parquet(f"{folder}/documents.parquet")))


def test_quality_filter_keeps_columns(documents):
    kept = quality.filter_documents(documents)
    assert kept.columns == documents.columns
    verdicts = quality.verdicts(documents)
    assert kept.count() == verdicts.where("kept").count()
    assert set(tables.rows(kept, "doc_id")) == set(tables.rows(verdicts.where("kept"), "doc_id"))


# -- 4 ----------------------------------------------------------------------------------------------


def check_licenses(got, docs):
    wanted = [(d, *brute.base_licenses(t)) for d, t in docs]
    assert tables.rows(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == ordered(wanted)
    for r in got.collect():
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1
        assert r["labels"].split(",") == sorted(set(r["labels"].split(",")))


def test_licenses_hard_rows(documents):
    check_licenses(license_scan.scan(documents), docs_of(documents))


def test_licenses_query(spark, folder):
    check_licenses(queries.op4_license_scan(spark, folder), docs_of(spark.read.parquet(f"{folder}/documents.parquet")))


def test_licenses_own_templates(spark):
    """Plain search for each template's key phrase, with templates of one word, of repeated words and of shared key phrases."""
    templates = (("x", "under the ab ab licence", "ab ab"), ("y", "ab ab", "ab ab"), ("z", "solo", "solo"), ("w", "a b c d e", "c d"))
    texts = [None, "", "ab ab", "ab ab ab solo", "under the AB-ab licence; d c d e", "c d", "a b c x d", "e " * 3000 + "c d e solo " + "ab " * 500]
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), index=license_scan.build_index(templates), anchors=None).collect()
    for row in rows:
        words = re.findall("[a-z0-9]+", (texts[row["doc_id"]] or "").lower())
        wanted, best = set(), 0.0
        for t in license_scan.build_index(templates):
            for start in range(-len(t["words"]), len(words)):
                here = [0 <= start + k < len(words) and words[start + k] == w for k, w in enumerate(t["words"])]
                if all(here[t["at"] : t["at"] + len(t["phrase"])]):
                    wanted.add(t["label"])
                    best = max(best, sum(n for n, h in zip(t["idf"], here, strict=True) if h) / sum(t["idf"]))
        assert row["labels"] == ",".join(sorted(wanted)), row
        assert abs(row["score"] - best) < 1e-12, row


def test_licenses_sql(spark, tiny):
    assert oracle.compare(spark, queries.op4_license_scan, license_scan.sql(), tiny)


# -- 5 ----------------------------------------------------------------------------------------------


def check_urls(got, pages):
    wanted = [(p, *brute.url_rule(u)) for p, u in pages]
    rows = {r["page_id"]: r for r in got.collect()}
    assert got.count() == len(pages)
    for p, host, path, rule, verdict in wanted:
        r = rows[p]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")


def test_urls_hard_rows(spark):
    df = tables.pages(spark)
    check_urls(url_filter.judge(df), [tuple(r) for r in df.select("page_id", "url").collect()])
    assert url_filter.judge(tables.empty(spark, tables.PAGES)).count() == 0


def test_urls_query(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url").collect()
    check_urls(queries.op5_url_filter(spark, folder), [tuple(r) for r in pages])


def test_urls_sql(spark, tiny):
    assert oracle.compare(spark, queries.op5_url_filter, url_filter.SQL, tiny)


# -- 6 ----------------------------------------------------------------------------------------------


def test_lines_hard_rows(spark):
    df = tables.with_clashes(tables.unique_documents(spark))
    out = line_dedup.dedup_lines(df)
    assert out.columns[: len(df.columns)] == df.columns
    wanted = brute.line_dedup(docs_of(df))
    assert dict(docs_of(out)) == wanted
    assert tables.rows(out.select(*[c for c in tables.CLASHES if c not in ("text",)]).distinct())  # as they were
    for r in out.collect():
        assert all(r[c] == f"kept {c}" for c in tables.CLASHES)


def test_lines_repeated_rows_share_a_decision(spark):
    df = tables.documents(spark)
    out = line_dedup.dedup_lines(df)
    assert out.count() == df.count()
    assert len({r for r in tables.rows(out, "doc_id", "text") if r[0] == 20}) == 1
    assert line_dedup.dedup_lines(tables.empty(spark)).count() == 0


def test_lines_query(spark, folder):
    got = queries.op6_line_dedup(spark, folder)
    wanted = brute.line_dedup(docs_of(spark.read.parquet(f"{folder}/documents.parquet")))
    assert tables.rows(got, "doc_id", "text_md5") == ordered([(d, hashlib.md5((t or "").encode()).hexdigest()) for d, t in wanted.items()])


def test_lines_sql(spark, tiny):
    assert oracle.compare(spark, queries.op6_line_dedup, line_dedup.SQL, tiny)


# -- 7 ----------------------------------------------------------------------------------------------

HITS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
ITEMS = [(1, "one two three four"), (2, "ONE, two. three four"), (None, "cc by"), (3, None), (4, ""), (5, tables.LINE + " " + tables.OTHER), (11, "w3 w4 w5 w6 w7 w8 w9 w10 w11"), (12, "漢字かな"), (12, "end"), (2, "a b c d e")]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_decontamination_hard_rows(spark, documents, limit):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.scan(documents, bench, max_broadcast_bytes=limit)
    assert tables.rows(got, *HITS) == ordered(brute.decontaminate(docs_of(documents), ITEMS))


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_decontamination_removes(spark, documents, limit):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    counts = brute.decontaminate(docs_of(documents), ITEMS)
    clean = decontaminate.scan(documents, bench, remove="documents", max_broadcast_bytes=limit)
    assert clean.columns == documents.columns
    assert clean.count() == sum(not c[-1] for c in counts)
    cut = decontaminate.scan(documents, bench, min_items=1, remove="spans", max_broadcast_bytes=limit)
    assert cut.columns == documents.columns and cut.count() == documents.count()
    for (d, t), (d2, t2) in zip(ordered(docs_of(cut.where("doc_id = 14"))), ordered(docs_of(documents.where("doc_id = 14"))), strict=True):
        assert t == "" and t2 == "one two three four"


def test_decontamination_empty_benchmark(spark):
    df = tables.documents(spark)
    for limit in (1 << 20, 0):
        got = decontaminate.scan(df, tables.empty(spark, "item_id long, text string"), max_broadcast_bytes=limit)
        assert got.where("n_hit > 0 OR n_items > 0 OR contaminated").count() == 0 and got.count() == df.count()


def test_decontamination_query(spark, folder):
    bench = spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()
    wanted = brute.decontaminate(docs_of(spark.read.parquet(f"{folder}/documents.parquet")), [tuple(r) for r in bench])
    assert tables.rows(queries.op7_benchmark_decontamination(spark, folder), *HITS) == ordered(wanted)


# -- 8 ----------------------------------------------------------------------------------------------


def check_tokens(got, docs):
    import numpy as np

    library = brute.reference_tokens(TOKENS, public_tokenizers.PATTERN)
    wanted = []
    for d, t in docs:
        ids = library.encode_ordinary(t or "")
        wanted.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert tables.rows(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == ordered(wanted)


def test_tokens_hard_rows(documents):
    check_tokens(byte_bpe.digests(documents, TOKENS, public_tokenizers.PATTERN), docs_of(documents))


def test_tokens_query(spark, folder):
    check_tokens(queries.op8_byte_bpe(spark, folder), docs_of(spark.read.parquet(f"{folder}/documents.parquet")))


def test_tokens_round_trip(documents):
    ids = byte_bpe.encode(documents, TOKENS, public_tokenizers.PATTERN)
    back = byte_bpe.decode(ids, TOKENS, public_tokenizers.PATTERN, ids_col=ids.columns[-1])
    assert back.columns[: len(documents.columns)] == documents.columns
    for r in back.select("text", back.columns[-1]).collect():
        assert bytes(r[1]) == (r[0] or "").encode()


def test_tokens_random_bytes():
    import random

    library = brute.reference_tokens(TOKENS, public_tokenizers.PATTERN)
    vocab = byte_bpe.vocabulary(TOKENS, public_tokenizers.PATTERN)
    r = random.Random(4)
    for alphabet in ("ab", "aab ", " \n\tx", "aàé漢🙂's 1", "the ing er "):
        for _ in range(60):
            text = "".join(r.choice(alphabet) for _ in range(r.randrange(300)))
            assert vocab.encode(text) == library.encode_ordinary(text)


# -- 9 ----------------------------------------------------------------------------------------------

NEAR = ("doc_id", "n_shingles", "component_id", "kept")


def test_near_hard_rows(documents):
    assert tables.rows(near_dedup.components(documents), *NEAR) == ordered(brute.near(docs_of(documents)))


def test_near_deduplicate(documents):
    kept = near_dedup.deduplicate(documents, 80)
    assert kept.columns == documents.columns
    wanted = [d for d, _, c, keep in brute.near(docs_of(documents), 80) if keep]
    assert tables.rows(kept, "doc_id") == ordered([(d,) for d in wanted])


def test_near_query(spark, folder):
    wanted = brute.near(docs_of(spark.read.parquet(f"{folder}/documents.parquet")))
    assert tables.rows(queries.op9_minhash_near_dedup(spark, folder), *NEAR) == ordered(wanted)


def test_near_chains_and_large_groups(spark):
    """A chain of texts, each near to the next only, and a group of some hundred near copies."""
    words = [f"v{k}" for k in range(400)]
    docs = [(k, " ".join(words[3 * k : 3 * k + 100])) for k in range(40)]
    docs += [(1000 + k, " ".join([*words[:150], f"end{k}"])) for k in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert tables.rows(near_dedup.components(df), *NEAR) == ordered(brute.near(docs))


def test_near_trees_reach_the_recall():
    """The equal values of a pair, Binomial(K, threshold), are the same in all trees; drawn, not by the formula's own sum."""
    rng = np.random.default_rng(5)
    for threshold, recall in ((0.85, 0.9999), (0.8, 0.9999), (0.85, 0.999)):
        trees = near_dedup.trees_for(threshold, recall)
        same = rng.binomial(near_dedup.K, threshold, 2_000_000)
        lost = np.zeros(near_dedup.K + 1)
        for n in range(near_dedup.K + 1):
            miss = 0.0
            for _ in range(near_dedup.LEVELS):
                one = 1 - n / near_dedup.K * (1 - miss)
                miss = (2 - 1 / threshold) * one + (1 / threshold - 1) * one * one
            lost[n] = miss**trees if n >= near_dedup.allowed(threshold) else 1
        assert lost[same].mean() <= 1.1 * (1 - recall)
        assert near_dedup.miss(threshold, trees) <= 1 - recall < near_dedup.miss(threshold, trees - 1)
    with pytest.raises(ValueError):
        near_dedup.trees_for(0.85, 1.0)


def test_near_pairs_in_a_group_below_the_threshold(spark):
    """1,600 texts with 169 common shingles of 185, all pairs at 0.841; two of each pair share one more: 170 of 200, at 0.85 exactly."""
    base = [f"v{k}" for k in range(173)]
    docs = [(2 * k + own, " ".join([*base, f"pair{k}", *(f"own{k}_{own}_{n}" for n in range(15))])) for k in range(800) for own in range(2)]
    sets = [brute.shingles(t) for _, t in docs]
    both = lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    assert all(both(a, a + 1) for a in range(0, 1600, 2)) and not any(both(0, b) for b in range(2, 1600))  # all pairs of pairs are alike
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert tables.rows(near_dedup.components(df), *NEAR) == ordered([(d, 185, d - d % 2, d % 2 == 0) for d, _ in docs])


# -- 10 ---------------------------------------------------------------------------------------------

RECORD = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_warc_hard_rows(spark):
    df = tables.pages(spark)
    wanted = brute.warc([tuple(r) for r in df.select("page_id", "html").collect()])
    assert tables.rows(warc.round_trip(tables.with_clashes(df)), *RECORD) == ordered(wanted)
    assert warc.round_trip(tables.empty(spark, tables.PAGES)).count() == 0


def test_warc_query(spark, folder):
    wanted = brute.warc([tuple(r) for r in spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "html").collect()])
    assert tables.rows(queries.op10_warc(spark, folder), *RECORD) == ordered(wanted)


def test_warc_archives_end_by_bytes(spark, tmp_path):
    """Long payloads that don't compress: no archive is longer than the bound and a record, and all come back, by a plain reader too."""
    rng = np.random.default_rng(3)
    pages = [(k, f"http://x/{k}", rng.bytes(rng.integers(1, 60_000)).hex()) for k in range(120)]
    pages += [(500 + k, "http://same/", pages[7][2]) for k in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    warc.write(df, str(tmp_path / "w"), archive_bytes=200_000)
    files = list((tmp_path / "w").glob("part-*"))
    plain = [warc.parse(r) for f in files for r in warc.frames(f.read_bytes())]
    assert len(files) > 10 and max(f.stat().st_size for f in files) < 200_000 + 130_000 + 8 * warc.RECORDS
    assert sorted(int(h["x-page-id"]) for h, _ in plain) == sorted(p[0] for p in pages)
    found = {r["page_id"]: r for r in warc.read(spark, str(tmp_path / "w")).collect()}
    for page_id, _, html in pages:
        same = html == pages[7][2]
        assert found[page_id]["refers_to"] == (539 if same and page_id != 539 else None)
        assert found[page_id]["payload"] == (None if same and page_id != 539 else html.encode())


def test_warc_sql(spark, tiny):
    assert oracle.compare(spark, queries.op10_warc, warc.SQL, tiny)


# -- 1 ----------------------------------------------------------------------------------------------


def check_shards(out, limit, names=("n_bytes", "shard")):
    """Every row has a shard, shards fit, no bucket is a prefix of another, and a bucket was split only for its size."""
    rows = out.selectExpr(f"`{names[0]}` AS bytes", f"`{names[1]}` AS shard").collect()
    total, count = {}, {}
    for r in rows:
        assert r["shard"] is not None
        total[r["shard"]] = total.get(r["shard"], 0) + r["bytes"]
        count[r["shard"]] = count.get(r["shard"], 0) + 1
    assert all(total[s] <= limit or count[s] == 1 for s in total)
    plain = sorted(s for s in total if "+" not in s)
    assert not any(b.startswith(a) for a, b in zip(plain, plain[1:], strict=False))
    for s in plain:
        if s:
            assert sum(r["bytes"] for r in rows if r["shard"].startswith(s[:-1])) > limit


@pytest.mark.parametrize("limit", [1, 100, 5000, 1 << 20])
def test_shards_hard_rows(spark, limit):
    df = tables.documents(spark)
    out = sharding.assign(df, limit)
    assert out.count() == df.count()
    check_shards(out, limit)


def test_shards_clashes_and_empty(spark):
    df = tables.documents(spark, extra=True)
    out = sharding.assign(df, 5000)
    assert out.columns[: len(df.columns)] == df.columns
    assert all(r[c] == f"kept {c}" for r in out.collect() for c in tables.CLASHES)
    check_shards(out, 5000, out.columns[-2:])
    assert sharding.assign(tables.empty(spark)).count() == 0


def test_shards_written(spark, tmp_path):
    df = tables.documents(spark)
    sharding.write_shards(df, str(tmp_path / "s"), 5000)
    assert spark.read.parquet(str(tmp_path / "s")).count() == df.count()


def test_shards_sql(spark, tiny):
    assert oracle.compare(spark, queries.op1_extendible_sharding, sharding.SQL, tiny)
