import io
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hazardflow.llm import token_files as T
from hazardflow.llm.word_tokens import WordTokens
from tests.llm.helpers import SCHEMA, frame, rows

PATH = public_tokenizers.path("word_bpe_49k.json")


class Kept(io.BytesIO):
    def close(self):
        pass


@pytest.mark.parametrize("bits", [1, 2, 5, 8, 11, 16, 17, 24, 31, 32])
def test_pack_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 1000):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype("<u4")
        data = T.pack(ids, bits)
        assert len(data) == -(-n * bits // 8)
        assert (T.unpack(data, bits, n) == ids).all()


def test_bits():
    assert [T.bits_for(n) for n in (0, 1, 2, 3, 4, 5, 49_408, 65_536, 65_537)] == [1, 1, 1, 2, 2, 3, 16, 16, 17]
    with pytest.raises(ValueError):
        T.pack(np.array([4], "<u4"), 2)
    with pytest.raises(ValueError):
        T.bits_for((1 << 32) + 1)


@pytest.mark.parametrize("block", [1, 3, 64, 1000])
def test_file_round_trip_and_random_access(block):
    rng = random.Random(block)
    docs = [(None, [1, 2])] + [(i * 3 - 5, [rng.randrange(2000) for _ in range(rng.choice([0, 1, 5, 200]))]) for i in range(30)]
    out = Kept()
    w = T.Writer(out, 11, block)
    for i, ids in docs:
        w.add(i, np.array(ids, "<u4").tobytes())
    w.close()
    r = T.Reader(out)
    assert [(i, ids.tolist()) for i, ids in r] == docs
    flat = [x for _, ids in docs for x in ids]
    for _ in range(30):
        s = rng.randrange(len(flat) + 1)
        e = rng.randrange(s, len(flat) + 1)
        assert r.read(s, e).tolist() == flat[s:e]


def test_empty_file():
    out = Kept()
    T.Writer(out, 3).close()
    assert list(T.Reader(out)) == []
    with pytest.raises(ValueError):
        T.Reader(io.BytesIO(b"x" * 100))


def test_words_equal_the_library():
    ours, whole = WordTokens(PATH), Tokenizer.from_file(PATH)
    assert ours.by_word
    rng = random.Random(4)
    signs = "abzABZéÉßñ'stre 0²½.,!«¿×ªµº\n\t\r\xa0\x85İıΣσς中́€<|>endoftextŽžſŉ-~`^$_"
    made = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    made += [f"{p}{chr(c)}{s}" for c in range(0x250) for p, s in (("", ""), ("a", "b"), ("a ", "1"))]
    made += ["<|startoftext|> a <|endoftext|>", "it's we'll 'Till", "e\u0301 x", "\u0130stanbul \u03a3\u03a3"]
    for text in made:
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)
    assert ours.encode(None) == b""


def test_documents_round_trip(spark, tmp_path):
    whole = Tokenizer.from_file(PATH)
    data = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at = Counter(), 0
    for i, t, *_ in data:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[(i, at, len(ids), zlib.crc32(ids.tobytes()))] += 1
        at += len(ids)
    got = T.round_trip(frame(spark), PATH, 1, str(tmp_path / "ids"))
    assert Counter(tuple(r) for r in got.collect()) == want
    files = sorted((tmp_path / "ids").iterdir())
    assert sum(T.Reader(f.open("rb")).ids for f in files) == at


def test_empty_table(spark, tmp_path):
    assert T.round_trip(spark.createDataFrame([], SCHEMA), PATH, 1, str(tmp_path / "none")).collect() == []
