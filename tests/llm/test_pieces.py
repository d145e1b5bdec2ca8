import random

import public_tokenizers
import pytest
import sentencepiece

from cropline.llm.pieces import Codec, encode_texts, simulate
from cropline.llm.queries import MODEL, pieces_of
from tests.llm.rows import documents, empty

PATH = public_tokenizers.path(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as file:
        return Codec.load(file.read())


def test_random_texts_match_the_library(codec, library):
    rng = random.Random(5)
    letters = "ab_ the  \n\t.,²½é€😀　'$\\{}()▁xyz0129ｆ<>-+\x00ß"
    for _ in range(8000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert codec.encode(text) == ids, text
        assert codec.packed(text)[1].decode() == codec.decode(ids) == library.decode(ids), text


def test_random_ids_decode_as_the_library_does(codec, library):
    rng = random.Random(6)
    for _ in range(3000):
        ids = [rng.randrange(3, 259) if rng.random() < 0.4 else rng.randrange(1, 32_000) for _ in range(rng.randint(0, 12))]
        assert codec.decode(ids) == library.decode(ids), ids


def test_prefix_table_finds_what_merging_finds(codec):
    rng = random.Random(7)
    for _ in range(2000):
        text = "".join(rng.choice("▁theaninorst_é") for _ in range(rng.randint(1, 20)))
        assert codec.part(text) == simulate(text, codec.ranks)


def test_whole_documents_match_the_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for row in encode_texts(docs, PATH).collect():
        ids = library.encode(texts[row._id], add_bos=True, add_eos=True)
        assert bytes(row.ids) == b"".join(i.to_bytes(4, "little") for i in ids)
        assert bytes(row.decoded).decode() == library.decode(ids)


def test_odd_documents(spark, library):
    docs = documents(spark)
    rows = pieces_of(docs).collect()
    want = sorted((str(r.doc_id), len(library.encode(r.text or "")) + 2) for r in docs.collect())
    assert sorted((str(r.doc_id), r.n_tokens) for r in rows) == want
    assert pieces_of(empty(spark)).count() == 0
