import random
import string
import zlib

import numpy as np
import pytest
from fixtures import documents, empty

from plumbline.llm import records
from plumbline.llm.crc32c import crc32c, masked
from plumbline.llm.queries import END_ID, tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def slow_crc(data):
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_checksums():
    rng = np.random.default_rng(1)
    data = [rng.bytes(n) for n in (4, 5, 63, 64, 65, 127, 128, 129, 1000, 9, 64)]
    assert crc32c(data).tolist() == [slow_crc(d) for d in data]
    assert crc32c([b"123456789"])[0] == 0xE3069283
    crc = np.array([0xE3069283], np.uint32)
    assert int(masked(crc)[0]) == ((0xE3069283 >> 15 | 0xE3069283 << 17 & 0xFFFFFFFF) + 0xA282EAD8) % 2**32


def ids(encoder, texts):
    return [np.frombuffer(encoder.encode(t), encoder.dtype).tolist() for t in texts]


TEXTS = [
    "", "plain words here", "a  b", "a \n b", "a\n b", "\n\nx", "x ", " x", "it's we'll don't", "naïve été", "x²½", "日本語 text", "a\tb \t c", "1st 2nd_3",
    "<|endoftext|> x", "a <|endoftext|> b", "a<|endoftext|>", "<|endoftext", "é" * 50, "...!?\n...", "a\r\nb", "a\0b c", " ", "  ", "🙂 ok", "x\u00a0y \u2003z",
]


def test_encoder_equals_library(tokenizer):
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in TEXTS]
    assert [64, 220, 50256, 275] in want
    for cache in (2, 300_000):
        encoder = records.Encoder(tokenizer_path(), cache)
        assert encoder.plain
        for _ in range(2):
            assert ids(encoder, TEXTS) == want
    assert encoder.encode(None) == b""


def test_encoder_equals_library_on_random_text(tokenizer):
    rng = random.Random(3)
    kinds = [string.printable, string.ascii_letters + "  ", " \t\n\r\x0b\x1f\x85\xa0", "".join(map(chr, range(0x80, 0x250))), "".join(map(chr, range(0x250, 0x800))), "日本語🙂\u200d\u0301ſK", "'srtvemdl "]
    texts = ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randrange(60))) for _ in range(4000)]
    texts += [" ".join("".join(rng.choice(rng.choice(kinds[:2])) for _ in range(rng.randrange(9))) for _ in range(30)) for _ in range(500)]
    assert ids(records.Encoder(tokenizer_path(), 500), texts) == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_files_are_left_to_the_library(tmp_path):
    from tokenizers import Tokenizer, normalizers

    other = Tokenizer.from_file(tokenizer_path())
    other.normalizer = normalizers.Lowercase()
    other.save(f"{tmp_path}/lower.json")
    encoder = records.Encoder(f"{tmp_path}/lower.json")
    assert not encoder.plain and ids(encoder, ["Some Words"]) == [other.encode("some words", add_special_tokens=False).ids]


def test_encoder_equals_library_on_documents(spark, tokenizer):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    assert ids(records.Encoder(tokenizer_path()), texts) == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_round_trip(spark, tokenizer, tmp_path):
    docs = documents(spark, extra=True)
    index = records.write_records(docs, f"file://{tmp_path}/r", tokenizer_path(), END_ID, shards=3)
    got = sorted(records.read_records(index, 3).collect(), key=lambda r: r.start)
    want = [(r.doc_id, tokenizer.encode(r.text or "", add_special_tokens=False).ids + [END_ID]) for r in docs.collect()]
    assert [r.doc_id for r in got] == sorted((i for i, _ in want), key=lambda i: -1 if i is None else i)
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    crcs = sorted((-1 if i is None else i, len(t), zlib.crc32(np.array(t, "<u4").tobytes())) for i, t in want)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == crcs
    for seed in (1, 2):
        shuffled = records.read_shuffled(index, seed, 3).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, list(r.ids)) for r in shuffled) == sorted((-1 if i is None else i, t) for i, t in want)


def test_altered_file_is_an_error(spark, tmp_path):
    index = records.write_records(documents(spark), f"file://{tmp_path}/r", tokenizer_path(), END_ID, shards=1)
    path = index.select("path").first()[0].removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[40] ^= 1
    with open(path, "wb") as f:
        f.write(data)
    with pytest.raises(Exception, match="checksum"):
        records.read_records(index, 1).collect()


def test_empty_table(spark, tmp_path):
    index = records.write_records(empty(spark), f"file://{tmp_path}/r", tokenizer_path(), END_ID)
    assert records.read_records(index).count() == 0 and records.read_shuffled(index, 1).count() == 0
