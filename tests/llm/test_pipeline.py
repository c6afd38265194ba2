"""The pipeline against its stages in plain Python."""

import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from lodestone.llm import quality

from tests.llm import brute, tables

TOKENS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def without_spans(text, items):
    windows = set()
    for _, item in items:
        words = brute.ALNUM.findall(brute.lower(item or ""))
        size = min(8, len(words))
        windows |= {tuple(words[k : k + size]) for k in range(len(words) - size + 1 if size else 0)}
    found = list(brute.ALNUM.finditer(brute.lower(text)))
    words, hit = [m[0] for m in found], set()
    for size in range(1, 9):
        for k in range(len(words) - size + 1):
            if tuple(words[k : k + size]) in windows:
                hit.update(range(k, k + size))
    out, last, k = [], 0, 0
    while k < len(words):
        if k in hit:
            end = k
            while end + 1 in hit:
                end += 1
            out.append(text[last : found[k].start()])
            last = found[end].end()
            k = end
        k += 1
    return "".join([*out, text[last:]])


def test_pipeline(spark, tiny):
    df = spark.read.parquet(f"{tiny}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    kept = {r[0] for r in quality.verdicts(df).where("kept").select("doc_id").collect()}
    docs = [(d, t) for d, t in texts.items() if d in kept]
    cut = brute.line_dedup(docs)
    docs = [(d, t) for d, t in cut.items() if t == texts[d] or brute.SPACED.search(t)]
    near = {d for d, _, _, keep in brute.near(docs, 80) if keep}
    items = [tuple(r) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").select("item_id", "text").collect()]
    library = brute.reference_tokens(TOKENS, public_tokenizers.PATTERN)
    wanted = []
    for d, t in docs:
        if d in near:
            t = without_spans(t, items)
            ids = library.encode_ordinary(t)
            wanted.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert tables.rows(corpus_pipeline.run(spark, tiny), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(wanted, key=repr)


def test_stages_on_hard_and_empty_rows(spark, tiny):
    for docs in (tables.documents(spark, extra=True), tables.empty(spark)):
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, tiny).cache()
            if k + 1 < len(corpus_pipeline.STAGES):
                assert docs.columns == columns
