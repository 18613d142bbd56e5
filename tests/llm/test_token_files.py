import io
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import token_files

from .conftest import prose


@pytest.mark.parametrize("bits", [1, 2, 3, 7, 8, 11, 16, 17, 31])
def test_round_trip(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 10_001).astype(np.uint32)
    assert (token_files.unpack(token_files.pack(ids, bits), len(ids), bits) == ids).all()
    counts = np.array([0, 5000, 1, 5000])
    raw = b"".join(token_files.encode_file(np.arange(4), counts, ids, bits, block=64))
    f = token_files.TokenFile(io.BytesIO(raw))
    assert (f.tokens(0, len(ids)) == ids).all() and f.tokens(5, 5).size == 0
    for a, b in ((0, 1), (63, 65), (777, 4242), (10_000, 10_001)):
        assert (f.tokens(a, b) == ids[a:b]).all()
    assert (f.document(3) == ids[5001:]).all()
    assert len(raw) <= len(ids) * bits / 8 + 8 * (len(ids) / 64 + 60)
    with pytest.raises(ValueError):
        list(token_files.encode_file(np.arange(1), np.array([1]), np.array([1 << bits]), bits))
    with pytest.raises(ValueError):
        token_files.TokenFile(io.BytesIO(b"x" * 100))


def test_width():
    assert [token_files.width(n) for n in (1, 2, 3, 256, 257, 49_408)] == [1, 1, 2, 8, 9, 16]


def reference(rows):
    t = token_files._tokenizer(token_files.TOKENIZER)
    assert isinstance(t, Tokenizer)
    start, out = 0, []
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_files_equal_the_tokenizer(docs_of, odd_texts, spark):
    r = random.Random(4)
    texts = [*odd_texts, "é é ́x İstanbul ΑΣ", "<|endoftext|>hi <|endoftext|> x<|startoftext|>", "can't 'll don'T 12345", "\x1c\x1f a\x0bb\x0cc", "日本 語ab12!!..", "a\u00a0b c\u2003d\u0085e", *[prose(r, 50) for _ in range(20)]]
    got = token_files.write_and_read(docs_of(texts)).orderBy("doc_id").collect()
    assert [tuple(x) for x in got] == reference(list(enumerate(texts)))
    docs = docs_of(["a b", "c"])
    both = sorted((x["start"], x["n_tokens"]) for x in token_files.write_and_read(docs.union(docs)).collect())
    assert [a + n for a, n in both][:-1] == [a for a, _ in both][1:]
    assert token_files.write_and_read(docs.limit(0)).count() == 0


def test_null_and_negative_ids(docs_of):
    docs = docs_of(["a b", "c", None, "d e f"]).selectExpr("if(doc_id < 2, null, doc_id - 3) as doc_id", "text")
    got = token_files.write_and_read(docs).orderBy("start").collect()
    assert [x["doc_id"] for x in got] == [None, None, -1, 0] and [x["n_tokens"] for x in got][2:] == [1, 4]
    with pytest.raises(TypeError):
        token_files.write_and_read(docs.selectExpr("'x' as doc_id", "text"))


def test_other_tokenizers(docs_of):
    """A tokenizer that keeps case and white space gets whole texts."""
    texts = ["The  House\n\tof Über", "", "don't STOP 12", None]
    got = token_files.write_and_read(docs_of(texts), tokenizer="byte_bpe_50k.json").orderBy("doc_id").collect()
    t = token_files._tokenizer("byte_bpe_50k.json")
    ids = [np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for x in texts]
    assert [(x["n_tokens"], x["ids_crc32"]) for x in got] == [(len(x), zlib.crc32(x.tobytes())) for x in ids]


def test_a_file_that_is_there_already(tmp_path):
    store, top = token_files.opened(str(tmp_path))
    for name, body in (("one", b"whole"), ("two", b"whole")):
        (tmp_path / f"_{name}").write_bytes(body)
        token_files._publish(store, f"{top}/_{name}", f"{top}/tokens")
    assert [p.name for p in tmp_path.iterdir()] == ["tokens"] and (tmp_path / "tokens").read_bytes() == b"whole"


def test_small_files(docs_of):
    r = random.Random(5)
    texts = [prose(r, 30) for _ in range(50)]
    got = token_files.write_and_read(docs_of(texts), files=7).orderBy("doc_id").collect()
    assert [tuple(x) for x in got] == reference(list(enumerate(texts)))


def test_words_one_by_one():
    """Signs, cases and scripts where taking a word apart could differ from the tokenizer."""
    r = random.Random(8)
    pool = "abcXYZéÉüÜßẞŁłİıſŉÅÅKΣσςñ.,;:!?'\u0301\u2028\x85\u00ad-09日\U0001f600#"
    words = ["".join(r.choice(pool) for _ in range(r.randrange(1, 8))) for _ in range(4000)] + ["the", "The", "THE!!", "don't", "ŉ.", "x\u2028y", "<|endoftext|>", "ab<|endoftext|>."]
    t, enc = token_files._tokenizer(token_files.TOKENIZER), token_files.Encoder()
    for at in range(0, len(words), 100):
        part = words[at : at + 100]
        got = enc([w.encode() for w in part])
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [t.encode(w, add_special_tokens=False).ids for w in part]


def test_rows_without_ids_are_dealt_among_files(spark, tmp_path):
    """Null ids, or one id, don't make one file."""
    from tidemark.llm import token_files as tf

    for one in ("null", "7"):
        docs = spark.range(4_000).selectExpr(f"cast({one} as long) as doc_id", "concat('text number ', id) as text")
        manifest = tf.write(docs, f"file://{tmp_path}/{one}", files=8)
        sizes = sorted(r.n_docs for r in manifest.collect())
        assert len(sizes) == 8 and sum(sizes) == 4_000 and sizes[-1] < 1_500
        assert tf.read(spark, f"file://{tmp_path}/{one}", manifest).count() == 4_000
