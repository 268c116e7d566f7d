"""SentencePiece encoding and decoding against the library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from porelake.llm import pieces, queries

from .test_llm import SF, awkward, documents, empty, tables


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.piece_bpe_path())


@pytest.fixture(scope="module")
def own():
    return pieces.Pieces(pieces.piece_bpe_path())


def test_encoding_is_the_librarys(own, library):
    rng = random.Random(5)
    letters = "abc ▁  \n\t\x00éà́ß世界привет🙂<s>/[]'\".,²0123THEtheing   "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(5000)]
    texts += ["", " ", "▁", "▁▁", " " * 999, "x" * 3000, "the" * 2000, "世界" * 1500, "é" * 100, "a\n\n\nb", "</s><unk><0x41>", "m².", "the,the.\nThe", "\U0010ffff"]
    ids, same = own.encode(texts)
    assert ids == library.encode(texts) and all(same)
    assert [own.decode(i) for i in ids] == library.decode(ids)


def test_agendas_one_by_one_and_together(own):
    words = [f"▁{a}{b}{c}" for a in ("the", "naïve", "世界", "", "ing") for b in (".", "\n", "", "tion", "q") for c in ("x", "🙂", "ed", "")]
    fresh = pieces.Pieces(pieces.piece_bpe_path())
    fresh.agendas([w for w in words])
    assert {w: fresh.known[w] for w in words} == {w: own.ids_of(w) for w in words}


def test_decoding_of_any_ids(own, library):
    rng = random.Random(6)
    ids = [[rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(264) for _ in range(rng.randrange(12))] for _ in range(5000)]
    assert [own.decode(i) for i in ids] == library.decode(ids)


def _many(own, ids, whole=False):
    texts, same = own.decode_all(np.array([i for x in ids for i in x], np.int32), np.cumsum([0, *map(len, ids)]), whole)
    return texts, same.tolist()


def test_decoding_of_many_lists(own, library):
    rng = random.Random(7)
    ids = [[rng.choice((rng.randrange(32000), rng.randrange(3, 264), rng.choice([*own.lead]))) for _ in range(rng.randrange(9))] for _ in range(3000)]
    ids += [[rng.randrange(264) for _ in range(rng.randrange(5))] for _ in range(2000)] + [[], [13] * 60, []]
    for whole in (False, True):
        assert _many(own, ids, whole) == (library.decode(ids), [True] * len(ids))
    assert _many(own, []) == ([], []) and _many(own, [[], []]) == (["", ""], [True, True])


def test_the_library_decodes_what_is_new_alone(monkeypatch):
    fresh, asked = pieces.Pieces(pieces.piece_bpe_path()), []
    ids, _ = fresh.encode(["some of the words 世界\n\n that come again " * 50, "and others"])

    class Counted:
        def __init__(self, real):
            self.real = real

        def decode(self, x, **more):
            asked.append(sum(map(len, x)) if x and isinstance(x[0], list) else len(x))
            return self.real.decode(x, **more)

    monkeypatch.setattr(fresh, "library", Counted(fresh.library))
    monkeypatch.setattr(pieces, "pieces", lambda path: fresh)
    batch = pa.RecordBatch.from_pydict({"ids": pa.array(ids * 20, pa.list_(pa.int32()))})
    (out,) = pieces._decode("")(iter([batch]))
    assert all(out.column("text_as_library").to_pylist()) and 0 < sum(asked) < 10 * len({i for x in ids for i in x})


def test_a_decoding_that_disagrees_is_seen(library):
    ids = library.encode(["some words", "other words here", "é 🙂", "none"])
    other = pieces.Pieces(pieces.piece_bpe_path())
    other.said[ids[1][1]] = b"?"
    other.says = pa.array(other.said, pa.binary())
    wrong = [ids[1][1] in x for x in ids]
    for whole in (False, False, True):
        assert _many(other, ids, whole)[1] == [not w for w in wrong]
    other = pieces.Pieces(pieces.piece_bpe_path())
    other.lead, other.is_lead[:] = set(), False  # the prefix stays
    for whole in (False, False, True):
        assert not any(_many(other, ids, whole)[1])


def test_a_disagreement_is_seen():
    other = pieces.Pieces(pieces.piece_bpe_path())
    other.pair_cost *= -1  # the worst pair first
    texts = ["some of the words that come out otherwise", "a"]
    ids, same = other.encode(texts)
    assert same == [False, True] and other.encode(texts)[1] == [False, True] and other.encode(texts, whole=True)[1] == [False, True]
    assert ids[0] != other.library.encode(texts[0])


def test_what_is_known_is_bounded(own, monkeypatch, library):
    monkeypatch.setattr(pieces, "_HELD", 50)
    few = pieces.Pieces(pieces.piece_bpe_path())
    for i in range(30):
        text = f"word{i} and other{i} things"
        assert few.encode([text])[0] == [library.encode(text)]
        assert few.held < 100


def test_other_models_are_refused(tmp_path):
    with open(pieces.piece_bpe_path(), "rb") as f:
        raw = f.read()
    (tmp_path / "unigram.model").write_bytes(raw + bytes([0x12, 2, 0x18, 1]))  # a later trainer field: model type 1
    with pytest.raises(ValueError, match="only BPE models"):
        pieces.Pieces(str(tmp_path / "unigram.model"))


def test_awkward_rows(spark, library):
    docs = awkward(spark).withColumn("ids", F.lit("clash")).withColumn("key", F.lit(1))
    for whole in (False, True):
        done = pieces.decode(pieces.encode(docs, ["doc_id", "ids", "key", "text"], whole=whole)).collect()
        assert len(done) == docs.count()
        for r in done:
            assert r.ids == library.encode(r.key.text or "") and r.text == library.decode(r.ids) and r.as_library and r.text_as_library and r.key.ids == "clash"
    assert pieces.decode(pieces.encode(empty(spark), ["doc_id"])).collect() == []
    null = spark.createDataFrame([(1, None)], "n int, ids array<int>")
    assert pieces.decode(null).first().text == ""


@tables
def test_registered_query(spark, library):
    got = {r.doc_id: r for r in queries.QUERIES["op12_agenda_pieces"](spark, SF).collect()}
    docs = documents(spark).collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "")
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        assert r.as_library
