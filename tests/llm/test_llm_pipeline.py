"""The pipeline's stages, one after the other, against brute force over the same rows."""

import re
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline
from vellum.llm import secret_scan

SF = "/root/testdata/sf0.001"


def _shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return frozenset(tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def test_registered():
    names = set(E.queries())
    assert {"pipeline"} <= names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_stages_in_order(spark, tmp_dir):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        if k < 4:
            assert docs.columns == columns
        docs.write.parquet(f"{tmp_dir}/{k}")
        docs = spark.read.parquet(f"{tmp_dir}/{k}")
        rows.append(docs.collect())
    good, single, clean, masked, pieces = rows
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = [(r.doc_id in {g.doc_id for g in good}) == (labels[r.doc_id] == 1)
             for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.doc_id in labels]
    assert sum(right) / len(right) > 0.95
    sets = {r.doc_id: _shingles(r.text) for r in good}
    label = {d: d for d in sets}
    for _ in range(5):
        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert {r.doc_id for r in single} == {d for d in sets if label[d] == d}
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = _words(r.text)
        windows |= {tuple(w[i: i + 13]) for i in range(len(w) - 12)} or {tuple(w)}
    kept = set()
    for r in single:
        w, hit = _words(r.text), set()
        for size in {len(x) for x in windows if x}:
            for i in range(len(w) - size + 1):
                if tuple(w[i: i + size]) in windows:
                    hit |= set(range(i, i + size))
        if not (hit and 20 * len(hit) >= len(w)):
            kept.add(r.doc_id)
    assert {r.doc_id for r in clean} == kept == {r.doc_id for r in masked}
    before = {r.doc_id: r.text for r in clean}
    for r in masked:
        found = any(len(m[x.group]) >= x.least for x in secret_scan.BASE
                    for m in re.finditer(x.pattern, before[r.doc_id], (re.I | re.A) if x.any_case else 0))
        assert found or r.text == before[r.doc_id]
        assert not found or (r.text != before[r.doc_id] and r.n_chars == len(r.text))
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {r.doc_id: tok.encode(r.text, add_special_tokens=False).ids + [1] for r in masked}
    assert sum(r.length for r in pieces) == sum(map(len, ids.values()))
    for r in pieces:
        part = np.array(ids[r.doc_id][r.start: r.start + r.length], "<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
