"""The pipeline against a brute-force version of its stages."""

import base64
import hashlib

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
import corpus_pipeline  # noqa: E402
from quire.llm import langid  # noqa: E402

from .test_operators import ASCII_LOWER, brute_near, odd  # noqa: E402, F401


def brute_contaminated(text, items):
    """Aligns the items with the whole text, word by word."""
    import numpy as np

    words = lambda x: "".join(c if c.isalnum() or ord(c) > 127 else " " for c in x.lower()).split()
    w = words(text)
    names = {x: k for k, x in enumerate(dict.fromkeys(w))}
    row = np.array([names[x] for x in w])
    for item in items:
        own = words(item)
        if len(set(own) & set(names)) < 0.4 * len(set(own)):
            continue
        last, best, step = np.zeros(len(w), int), 0, np.arange(len(w))
        for x in own:
            now = np.where(row == names.get(x, -1), 1, -1)
            now[1:] += last[:-1]
            now = np.maximum(np.maximum(now, last - 1), 0)
            last = np.maximum.accumulate(now + step) - step
            best = max(best, last.max(initial=0))
        if len(own) >= 6 and ((best >= 0.4 * len(own) and best >= 6) or best >= 50):
            return True
    return False


def test_pipeline(spark, sf_dir):
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    known = {r["doc_id"] for r in langid.predict(docs, langid.train(docs)).filter("not rejected").collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    last = {}
    for i in sorted(known):
        last[texts[i].translate(ASCII_LOWER)] = i
    kept = sorted(last.values())
    kept = [r[0] for r in brute_near([(i, texts[i]) for i in kept], 5, 80) if r[3]]
    kept = [i for i in kept if not brute_contaminated(texts[i], items)]
    assert sorted(got) == sorted(kept)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i in kept:
        assert got[i]["ids"] == library.encode_ordinary(texts[i])
        assert got[i]["decoded_sha256"] == hashlib.sha256(texts[i].encode()).hexdigest()


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.count() == 0
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.STAGES[0][0]] == [5, "language_id"]


def test_stages_on_odd_rows(spark, sf_dir, odd):  # noqa: F811
    """Nulls, empty and long texts, repeated rows and columns whose names clash: every stage keeps the columns, and what it says it keeps."""
    n, columns = odd.count(), odd.columns
    ids = lambda df: sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.select("doc_id").collect())
    out = {name: function(spark, odd, sf_dir) for name, function in corpus_pipeline.STAGES}
    for name in list(out)[:-1]:
        assert out[name].columns == columns, name
    assert out["language_id"].filter("text is null or text in ('', '  \n\t ')").count() == 0
    assert set(ids(out["exact_dedup"])) == {(False, k) for k in (1, 2, 4, 5, 7, 9, 10, 99)} | {(True, 0)}
    assert out["minhash_forest"].filter("doc_id is null").count() == 1
    assert out["decontamination"].count() == n
    last = out["byte_bpe"].collect()
    assert len(last) == n and {r["n_tokens"] for r in last if r["doc_id"] in (0, 1)} == {0}
    for name, function in corpus_pipeline.STAGES:
        assert function(spark, odd.limit(0), sf_dir).count() == 0, name
