"""SentencePiece encoding with source offsets, and decoding.

``Normalizer`` follows the compiled character map of a model file: at each
place the longest key of its trie is replaced, and for every byte of the
result the source byte it came from is kept.  The normalised text is cut into
pieces by the library (from a copy of the model whose own normaliser does
nothing), and every piece is projected to a span of the original UTF-8 bytes.

Where the map is empty and no piece holds a blank behind another character,
the ids of a blank and the word after it depend on nothing else; each task
keeps those of the words it has met.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

from pyspark.sql import DataFrame

from hazardflow.llm.common import texts_of

#: Most words in a task's cache; further ones are encoded anew each time.
CACHE_WORDS = 500_000
BLANK = "▁"
_BLANK = BLANK.encode()
_RUNS = re.compile(r" +[^ ]*")


class Normalizer:
    """Longest-prefix replacement by a compiled map, with the alignment to the source."""

    def __init__(self, charsmap: bytes, add_blank: bool, trim: bool, escape: bool):
        import numpy as np

        self.add_blank, self.trim, self.escape = add_blank, trim, escape
        self.units, self.targets = [], b""
        if charsmap:
            size = int.from_bytes(charsmap[:4], "little")
            self.units = np.frombuffer(charsmap[4:4 + size], "<u4").tolist()
            self.targets = charsmap[4 + size:]

    @staticmethod
    def _next(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def prefix(self, data: bytes, at: int) -> tuple[bytes, int]:
        """Replacement of the longest key at ``at`` (else of one character), and its source length."""
        units, found = self.units, None
        if units:
            node = self._next(units[0])
            for k in range(at, len(data)):
                node ^= data[k]
                if node >= len(units) or units[node] & 0x800000FF != data[k]:
                    break
                unit = units[node]
                node ^= self._next(unit)
                if unit >> 8 & 1:
                    found = (units[node] & 0x7FFFFFFF, k + 1 - at)
        if found:
            start, size = found
            return self.targets[start:self.targets.index(0, start)], size
        first = data[at]
        size = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return data[at:at + size], size

    def __call__(self, text: str) -> tuple[bytes, list[int]]:
        """Normalised bytes; the source byte of each of them, and the source's end."""
        data, out, align, at = text.encode(), bytearray(), [], 0
        if self.trim:
            while at < len(data):
                to, size = self.prefix(data, at)
                if to.strip(b" "):
                    break
                at += size
        if at == len(data):
            return b"", [at]
        blank = _BLANK if self.escape else b" "
        if self.add_blank:
            out += blank
            align += [at] * len(blank)
        after_blank = self.trim
        while at < len(data):
            to, size = self.prefix(data, at)
            if after_blank:
                to = to.lstrip(b" ")
            for part in re.findall(rb" |[^ ]+", to):
                part = blank if part == b" " else part
                out += part
                align += [at] * len(part)
            at += size
            if to:
                after_blank = self.trim and to.endswith(b" ")
        end = at
        while self.trim and out.endswith(blank) and len(out) > 0:
            end = align[len(out) - len(blank)]
            del out[-len(blank):], align[-len(blank):]
        return bytes(out), [*align, end]


class PieceTokens:
    """Encoder and decoder of the model file at ``path``."""

    def __init__(self, path: str):
        import numpy as np
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        with open(path, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        spec, kinds = model.normalizer_spec, [p.type for p in model.pieces]
        if 4 in kinds or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models with user-defined symbols or blanks as suffixes are not supported")
        self.normalise = Normalizer(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces,
                                    spec.escape_whitespaces)
        self.strips = spec.add_dummy_prefix or spec.remove_extra_whitespaces
        by_word = (not spec.precompiled_charsmap and spec.add_dummy_prefix and not spec.remove_extra_whitespaces
                   and spec.escape_whitespaces and model.trainer_spec.byte_fallback)
        self.by_word = by_word and not any(BLANK in p.piece.lstrip(BLANK) for p in model.pieces)
        self.is_byte = np.array([k == 6 for k in kinds])
        self.sizes = np.array([1 if k == 6 else len(p.piece.encode()) for p, k in zip(model.pieces, kinds, strict=True)])
        surface = {2: lambda p: model.trainer_spec.unk_surface.encode(), 3: lambda p: b"",
                   6: lambda p: bytes([int(p.piece[3:5], 16)])}
        self.surfaces = [surface.get(k, lambda p: p.piece.replace(BLANK, " ").encode())(p)
                         for p, k in zip(model.pieces, kinds, strict=True)]
        model.normalizer_spec.Clear()
        model.normalizer_spec.name = "identity"
        for flag in ("add_dummy_prefix", "remove_extra_whitespaces", "escape_whitespaces"):
            setattr(model.normalizer_spec, flag, False)
        self.cutter = SentencePieceProcessor(model_proto=model.SerializeToString())
        self._cache: dict[str, tuple[str, bytes, bytes]] = {}

    def _entry(self, ids: list[int]) -> tuple[str, bytes, bytes]:
        import numpy as np

        return ",".join(map(str, ids)), np.array(ids, "<i4").tobytes(), b"".join([self.surfaces[i] for i in ids])

    def _by_word(self, words: list[str], normal) -> list[tuple[str, bytes, bytes]]:
        """Entries of words; ``normal`` gives a word's normalised form."""
        cache = self._cache
        try:
            return [cache[w] for w in words]
        except KeyError:
            new = [w for w in dict.fromkeys(words) if w not in cache]
            made = dict(zip(new, map(self._entry, self.cutter.encode([normal(w) for w in new], num_threads=1)), strict=True))
            if len(cache) < CACHE_WORDS:
                cache.update(made)
            return [made.get(w) or cache[w] for w in words]

    def parts(self, text: str) -> list[tuple[str, bytes, bytes]] | None:
        """(ids as decimals, ids as 32-bit integers, decoded bytes) of stretches of the text.

        None if the text can't be put together from stretches.
        """
        if not self.by_word or BLANK in text:
            return None
        if "  " in text or text[0] == " " or text[-1] == " ":
            return self._by_word([r[1:] if r.count(" ") == 1 and len(r) > 1 else r for r in _RUNS.findall(" " + text)],
                                 lambda r: r.replace(" ", BLANK) if r[0] == " " else BLANK + r)
        return self._by_word(text.split(" "), BLANK.__add__)

    def decode(self, ids) -> bytes:
        """Text of ids, as UTF-8; bytes that form no character become the replacement character."""
        data = b"".join([self.surfaces[i] for i in ids])
        return self._decoded(data)

    def _decoded(self, data: bytes) -> bytes:
        if self.strips and data.startswith(b" "):
            data = data[1:]
        try:
            data.decode()
            return data
        except UnicodeDecodeError:
            return re.sub(b"[\x80-\xff]+", lambda m: _valid(m.group()), data)

    def encode(self, text: str | None):
        """(ids as decimals, ids, decoded UTF-8) of a whole text; a null is empty."""
        import numpy as np

        if not text:
            return "", np.empty(0, "<i4"), b""
        parts = self.parts(text)
        if parts is None:
            ids = self.cutter.encode(self.normalise(text)[0].decode(), num_threads=1)
            decimals, raw, data = self._entry(ids)
            return decimals, np.frombuffer(raw, "<i4"), self._decoded(data)
        decimals, raw, data = zip(*parts, strict=True)
        return ",".join(decimals), np.frombuffer(b"".join(raw), "<i4"), self._decoded(b"".join(data))

    def spans(self, text: str | None, ids):
        """(begins, ends) of every piece in the original UTF-8 bytes.

        A piece takes the source of its normalised bytes; of pieces that stand
        for single bytes of one character, the last one has its span.
        """
        import numpy as np

        if not text:
            return np.empty(0, "<i8"), np.empty(0, "<i8")
        if self.by_word:  # one source byte a byte, or one for the three of a blank
            source = np.frombuffer(text.encode(), np.uint8)
            place = np.arange(len(source))
            inner = (source & 0xC0) == 0x80
            place = np.maximum.accumulate(np.where(inner, 0, place))
            align = np.concatenate([[0, 0, 0], np.repeat(place, np.where(source == 32, 3, 1)), [len(source)]])
        else:
            align = np.array(self.normalise(text)[1])
        sizes = self.sizes[ids]
        if (ids == 0).any():  # an unknown stretch's length is in no table
            pieces = self.cutter.encode(self.normalise(text)[0].decode(), out_type=str)
            sizes = np.where(self.is_byte[ids], 1, [len(p.encode()) for p in pieces])
        stops = np.cumsum(sizes)
        return align[stops - sizes], align[stops]


def _valid(data: bytes) -> bytes:
    out, at = b"", 0
    while at < len(data):
        for size in (4, 3, 2):
            try:
                data[at:at + size].decode()
            except UnicodeDecodeError:
                continue
            if at + size <= len(data):
                out, at = out + data[at:at + size], at + size
                break
        else:
            out, at = out + "�".encode(), at + 1
    return out


@lru_cache(maxsize=4)
def loaded(path: str) -> PieceTokens:
    """One encoder per Python worker and file."""
    return PieceTokens(path)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, begins, ends, decoded) of every whole text; a null text is empty.

    ``begins`` and ``ends`` are byte offsets in the original text.  Repeated
    rows stay; an empty table gives an empty result.
    """
    def run(batches):
        import pyarrow as pa

        lists = pa.list_(pa.int32())
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                _, ids, data = loaded(model).encode(text)
                rows.append((ids, *loaded(model).spans(text, ids), data.decode()))
            ids, begins, ends, decoded = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, lists), pa.array(begins, lists), pa.array(ends, lists),
                                              pa.array(decoded, pa.string())], names=["doc_id", "ids", "begins", "ends", "decoded"])

    return texts_of(docs).mapInArrow(
        run, "doc_id long, ids array<int>, begins array<int>, ends array<int>, decoded string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """The output of ``encode`` as numbers: n_tokens, the SHA-256 of the ids and of the decoded text, the CRC of the spans."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                decimals, ids, data = loaded(model).encode(text)
                spans = np.concatenate(loaded(model).spans(text, ids)).astype("<i8")
                rows.append((len(ids), hashlib.sha256(decimals.encode()).hexdigest(), hashlib.sha256(data).hexdigest(),
                             zlib.crc32(spans.tobytes())))
            n, a, d, s = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string()),
                                              pa.array(s, pa.int64())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"])

    return texts_of(docs).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long")
