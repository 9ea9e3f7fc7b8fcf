import hashlib
import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from hazardflow.llm import piece_tokens as T
from tests.llm.helpers import SCHEMA, frame, rows, texts

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = "ab the  \n\t▁éß中€😀\x00\x7f\xa0<s></s><unk><0x41>ñ.,'"


@pytest.fixture(scope="module")
def pair():
    return T.PieceTokens(PATH), SentencePieceProcessor(model_file=PATH)


def made():
    rng = random.Random(3)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 16))) for _ in range(1500)] + texts() + [" ", "  ", "a ", " a", "a  b", "▁", "a▁ b"]


def test_ids_text_and_spans_equal_the_library(pair):
    ours, library = pair
    for text in made():
        decimals, ids, data = ours.encode(text)
        want = library.encode(text)
        assert ids.tolist() == want, repr(text)
        assert decimals == ",".join(map(str, want))
        assert data.decode() == ours.decode(want).decode() == library.decode(want), repr(text)
        begins, ends = ours.spans(text, ids)
        pieces = library.encode(text, return_type="proto").pieces
        places = [0]
        for c in text:
            places.append(places[-1] + len(c.encode()))
        exact = [(p.begin, p.end) for p in pieces]
        assert list(zip(begins.tolist(), ends.tolist(), strict=True)) in (exact, [(places[min(s, len(text))], places[min(e, len(text))]) for s, e in exact]), repr(text)


def test_full_cache_changes_nothing(pair, monkeypatch):
    monkeypatch.setattr(T, "CACHE_WORDS", 2)
    small = T.PieceTokens(PATH)
    for text in texts():
        assert small.encode(text)[1].tolist() == pair[1].encode(text)


def charsmap(table):
    """A compiled map: a double array over the keys' bytes, and the replacements."""
    targets, at = b"", {}
    for key, to in table.items():
        at[key.encode()] = len(targets)
        targets += to.encode() + b"\0"
    keys, units, used = sorted(at), {0: 0}, {0}

    def put(node, prefix):
        kids = sorted({k[len(prefix)] for k in keys if k.startswith(prefix) and len(k) > len(prefix)})
        labels = ([0] if prefix in at else []) + kids
        if not labels:
            return
        offset = next(o for o in range(1, 1 << 20) if all((node ^ o ^ c) not in used for c in labels))
        units[node] = units[node] & ~(0x3FFFFF << 10) & 0xFFFFFFFF | offset << 10 | (256 if prefix in at else 0)
        used.update(node ^ offset ^ c for c in labels)
        if prefix in at:
            units[node ^ offset] = at[prefix] | 1 << 31
        for c in kids:
            units[node ^ offset ^ c] = c
        for c in kids:
            put(node ^ offset ^ c, prefix + bytes([c]))

    put(0, b"")
    array = [units.get(k, 0) for k in range(max(units) + 256)]
    blob = b"".join(u.to_bytes(4, "little") for u in array)
    return len(blob).to_bytes(4, "little") + blob + targets


def test_longest_prefix_and_alignment():
    blob = charsmap({"ﬁ": "fi", "A": "a", "AB": "x", "é": "é", " ": " ", "​": ""})
    n = T.Normalizer(blob, add_blank=False, trim=False, escape=False)
    out, align = n("ABA ﬁée​z")
    assert out.decode() == "xa fiéez"
    source = "ABA ﬁée​z".encode()
    assert align == [0, 2, 3, 4, 4, 7, 7, 10, 14, len(source)]
    n = T.Normalizer(blob, add_blank=True, trim=True, escape=True)
    out, align = n("   A  B  ")
    assert out.decode() == "▁a▁B"
    assert align == [4, 4, 4, 4, 5, 5, 5, 7, 8]
    assert n("  ")[0] == b"" and n("")[0] == b""


def test_documents(spark, pair):
    got = T.digests(frame(spark), PATH).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t, *_ in rows():
        ids = pair[1].encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha(pair[1].decode(ids).encode())))
    assert sorted(map(str, [tuple(r)[:4] for r in got])) == sorted(map(str, want))
    by_id = {r.doc_id: r for r in T.encode(frame(spark), PATH).collect()}
    for i, t, *_ in rows():
        r = by_id[i]
        assert r.decoded == (t or "") and len(r.ids) == len(r.begins) == len(r.ends)
        assert not t or (r.begins[0] == 0 and r.ends[-1] == len(t.encode()))


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert T.digests(empty, PATH).collect() == [] and T.encode(empty, PATH).collect() == []
