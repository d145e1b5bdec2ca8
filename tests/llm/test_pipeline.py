import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece

import corpus_pipeline
from cropline.llm.mixing import mix_sources
from cropline.llm.queries import MODEL
from cropline.llm.toxicity import fit_severity, score_severity
from cropline.session import materialise
from tests.llm.rows import SCHEMA, documents, empty
from tests.llm.test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_stage_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id: r.text or "" for r in docs.collect()}
    bad = {r._id for r in score_severity(docs, fit_severity(docs, labels)).collect() if r.toxic_probability >= 0.5}
    expected = [{i: t for i, t in kept.items() if i not in bad}]
    last = {}
    for i, t in expected[-1].items():
        last[t] = max(i, last.get(t, i))
    expected.append({i: t for t, i in last.items()})
    ids = sorted(expected[-1])
    prints = {i: plain_fingerprint(expected[-1][i]) for i in ids}
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2]
    root = plain_components(links, ids)
    expected.append({i: t for i, t in expected[-1].items() if root[i] == i})
    table = docs
    for (_, stage), want in zip(corpus_pipeline.STAGES, expected):
        table = materialise(stage(spark, table, SF))
        assert table.columns == COLUMNS and {r.doc_id: r.text or "" for r in table.collect()} == want
        assert table.count() == len(want)
    copies = {r._id: r.copies for r in mix_sources(table).collect()}
    mixed = materialise(corpus_pipeline.STAGES[3][1](spark, table, SF))
    assert mixed.columns == COLUMNS
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in copies.items() if n})
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
    want = Counter()
    for i, n in copies.items():
        ids = library.encode(expected[-1][i], add_bos=True, add_eos=True)
        packed = b"".join(x.to_bytes(4, "little") for x in ids)
        if n:
            want[i, packed, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += n
    result = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, bytes(r.ids), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in result) == want


def test_stages_take_odd_documents(spark):
    for table in (documents(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            table = materialise(stage(spark, table, SF))
            assert name == "sentencepiece" or table.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        assert table.columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
