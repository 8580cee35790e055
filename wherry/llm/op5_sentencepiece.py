"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

For every prefix of a text there is exactly one *last token* that its encoding ends with. The table
of those tokens is filled left to right: an Aho-Corasick automaton names the pieces that end at a
position, and a piece is the last token there if it is compatible with the last token of the prefix
before it, that is, if the merges of the two pieces' text leave exactly those two pieces. The ids are
then read off backwards. Time is linear in the text for a bounded piece length; no merge queue is kept.

Merges never cross the start of a run of word marks (U+2581) and never touch a character that is in no
piece, so a text is first cut there. Both facts are verified on the vocabulary when it is loaded; the
cut is switched off for models of which they do not hold.

Defined cases: null text counts as empty; the empty text has the end id only; repeated rows give
repeated rows; columns besides ``doc_id`` and the text are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from wherry.llm.common import pieces, table

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Encoded chunks that a worker remembers; a bound on memory alone, results do not depend on it.
CACHE_CHUNKS = 260_000
#: Longer chunks are encoded anew each time.
CACHE_CHARS = 64
#: The table of a longer chunk is filled left to right, that of a shorter one from its end as far as it is asked for.
EAGER_CHARS = 64


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        c = b[i]
        i += 1
        value |= (c & 127) << shift
        if c < 128:
            return value, i
        shift += 7


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol buffer message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, i = b[i : i + n], i + n
        else:
            raise ValueError(f"wire type {kind} in a model file")
        yield key >> 3, value


class PieceModel:
    """Vocabulary of a BPE model file and its encoder and decoder."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        self.add_prefix, squeeze, charsmap, model_type = True, True, b"", 1
        for field, value in _fields(data):
            if field == 1:
                got = dict(_fields(value))
                self.pieces.append(got.get(1, b"").decode("utf-8"))
                scores.append(struct.unpack("<f", got[2])[0] if 2 in got else 0.0)
                self.kinds.append(got.get(3, NORMAL))
            elif field == 2:
                model_type = dict(_fields(value)).get(3, 1)
            elif field == 3:
                got = dict(_fields(value))
                charsmap, self.add_prefix, squeeze = got.get(2, b""), bool(got.get(3, 1)), bool(got.get(4, 1))
        if model_type != 2 or charsmap or squeeze or USER in self.kinds:
            raise ValueError("only BPE models with identity normalisation and no user-defined symbols are handled")
        self.eos = self.pieces.index("</s>")
        self.byte_ids = [-1] * 256
        for i, (p, kind) in enumerate(zip(self.pieces, self.kinds)):
            if kind == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
        if min(self.byte_ids) < 0:
            raise ValueError("the model has no byte fallback")
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.rank = {p: (-scores[i], i) for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        alphabet = set("".join(self.rank))
        self.known = alphabet
        inner = any(MARK in p.lstrip(MARK) for p in self.rank)
        self.newline_cut = "\n" not in alphabet
        if inner:
            self.cut = None
        else:
            self.cut = re.compile("\n| *[^ \n]+| +" if self.newline_cut else " *[^ ]+| +")
        self.compatible_memo: dict[tuple[str, str], bool] = {}
        self.chunk_memo: dict[str, tuple[str, str]] = {}
        self.older_memo: dict[str, tuple[str, str]] = {}
        self.unknown = re.compile("[^" + re.escape("".join(sorted(alphabet))) + "]")
        self.shown = [str(i) for i in range(len(self.pieces))]
        self.plain = [p.replace(MARK, " ") for p in self.pieces]
        # Only pieces that merging their own characters gives back can be anyone's last token.
        self.automaton = ahocorasick.Automaton()
        self.longest = 1
        for p in self.rank:
            if len(p) == 1 or self._merge(p) == [p]:
                self.automaton.add_word(p, p)
                self.longest = max(self.longest, len(p))
        self.automaton.make_automaton()
        # All pieces that end where a piece ends are its own suffixes, longest first.
        self.suffixes = {p: [p[i:] for i in range(len(p)) if p[i:] in self.automaton] for p in self.automaton}

    def _merge(self, s: str) -> list[str]:
        """Plain merging of a short string: best score first, leftmost among equals."""
        parts, rank = list(s), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r[0] < best):
                    best, at = r[0], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether the text of two adjacent pieces is encoded as just these two."""
        key = (left, right)
        known = self.compatible_memo.get(key)
        if known is None:
            if len(self.compatible_memo) > CACHE_CHUNKS:
                self.compatible_memo.clear()
            known = self.compatible_memo[key] = self._merge(left + right) == [left, right]
        return known

    def _pieces_of(self, s: str) -> list[str]:
        """Pieces of a string all of whose characters are known: prefix table, then backwards."""
        n = len(s)
        last: list[str] = [""] * (n + 1)
        if n > EAGER_CHARS:
            self._fill(s, last)
        else:
            longest: list[str] = [""] * n
            for end, piece in self.automaton.iter(s):  # the longest piece that ends at a place comes first
                if not longest[end]:
                    longest[end] = piece
            self._settle(n, longest, last)
        out = []
        while n:
            out.append(last[n])
            n -= len(last[n])
        out.reverse()
        return out

    def _settle(self, stop: int, longest: list[str], last: list[str]) -> str:
        """Fill the table's entry for the prefix that ends at ``stop``, and those that it asks for."""
        for piece in self.suffixes[longest[stop - 1]]:
            start = stop - len(piece)
            if start:
                before = last[start] or self._settle(start, longest, last)
                ok = self.compatible_memo.get((before, piece))
                if not (self.compatible(before, piece) if ok is None else ok):
                    continue
            last[stop] = piece
            return piece
        raise AssertionError("a prefix without a last token")

    def _fill(self, s: str, last: list[str]) -> None:
        """Fill the whole table left to right."""
        for end, piece in self.automaton.iter(s):
            stop = end + 1
            start = stop - len(piece)
            if not last[stop] and (not start or last[start] and self.compatible(last[start], piece)):
                last[stop] = piece
        if not all(last[1:]):
            raise AssertionError("a prefix without a last token")

    def _chunk_ids(self, chunk: str) -> list[int]:
        ids: list[int] = []
        known, rank, byte_ids = self.known, self.rank, self.byte_ids
        i, n = 0, len(chunk)
        while i < n:
            j = i
            while j < n and chunk[j] in known:
                j += 1
            if j > i:
                ids.extend(rank[p][1] for p in self._pieces_of(chunk[i:j]))
            while j < n and chunk[j] not in known:
                ids.extend(byte_ids[b] for b in chunk[j].encode("utf-8"))
                j += 1
            i = j
        return ids

    def _spaced(self, text: str) -> str:
        """The text with its prefix blank; a literal mark is a blank to the model."""
        s = text.replace(MARK, " ") if MARK in text else text
        return " " + s if self.add_prefix and s else s

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, without an end id."""
        s = self._spaced(text)
        chunks = self.cut.findall(s) if self.cut else [s]
        return [i for c in chunks for i in self._chunk_ids(c.replace(" ", MARK))]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: control ids are silent, the prefix mark is dropped, bad bytes become U+FFFD each."""
        out: list[str] = []
        raw = bytearray()
        started = not self.add_prefix
        for i in ids:
            kind = self.kinds[i]
            if kind == BYTE:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw.clear()
                started = True
            if kind == CONTROL:
                continue
            piece = " ⁇ " if kind == UNKNOWN else self.pieces[i]
            if not started and piece.startswith(MARK):
                piece = piece[1:]
            started = True
            out.append(piece.replace(MARK, " "))
        if raw:
            out.append(_utf8(bytes(raw)))
        return "".join(out)

    def _chunk(self, chunk: str) -> tuple[str, str]:
        """Ids of one chunk as decimal text, and what these ids decode to behind other text."""
        got = self.older_memo.get(chunk)
        if got is None:
            marked = chunk.replace(" ", MARK)
            if self.unknown.search(marked):
                ids = self._chunk_ids(marked)
                back = self.decode([self.rank["a"][1], *ids])[1:]
            else:
                rank, plain = self.rank, self.plain
                ids = [rank[p][1] for p in self._pieces_of(marked)]
                back = "".join([plain[i] for i in ids])
            shown = self.shown
            got = " ".join([shown[i] for i in ids]), chunk if back == chunk else back  # one object for equal texts
        if len(chunk) <= CACHE_CHARS:
            if len(self.chunk_memo) >= CACHE_CHUNKS // 2:  # two generations: what is used stays
                self.older_memo, self.chunk_memo = self.chunk_memo, {}
            self.chunk_memo[chunk] = got
        return got

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids with the end id, sha256 of the ids, sha256 of the decoded text)."""
        s = self._spaced(text)
        if self.cut is None:
            ids = [*self.encode(text), self.eos]
            return len(ids), _hex(" ".join(map(str, ids)).encode()), _hex(self.decode(ids).encode())
        known = self.chunk_memo.get
        parts = [known(c) or self._chunk(c) for c in self.cut.findall(s)]
        shown = " ".join([*[p[0] for p in parts], str(self.eos)])
        # A chunk's bytes are whole characters, so the text of all ids is the texts of the chunks' ids; the first mark is dropped.
        back = "".join([p[1] for p in parts])
        back = back[1:] if self.add_prefix and back.startswith(" ") else back
        return shown.count(" ") + 1, _hex(shown.encode()), _hex(back.encode("utf-8", "replace"))


def _utf8(raw: bytes) -> str:
    """Decode UTF-8; each byte that is not part of a valid sequence becomes one U+FFFD."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[i : i + n].decode("utf-8"))
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


def _hex(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


@lru_cache(maxsize=2)
def parsed(data: bytes) -> PieceModel:
    """The model in a file's bytes, parsed once in a process."""
    return PieceModel(data)


def model(path: str) -> PieceModel:
    with open(path, "rb") as f:
        return parsed(f.read())


def _sent(df: DataFrame, model_path: str):
    """The model's bytes for the executors, which need no file of their own; a vocabulary file of some hundred kB."""
    with open(model_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def encode_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, number of ids with the end id, digests of the ids and of the decoded text."""
    data = _sent(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = parsed(data.value)
        for batch in pieces(batches):
            got = [m.digest(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.int64()), *(pa.array([g[k] for g in got], pa.string()) for k in (1, 2))],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {_kind(docs, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and the id list with its end id."""
    data = _sent(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = parsed(data.value)
        for batch in pieces(batches):
            ids = [[*m.encode(t or ""), m.eos] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {_kind(docs, id_col)}, ids array<int>")


def decode_ids(encoded: DataFrame, model_path: str) -> DataFrame:
    """The text of each id list."""
    data = _sent(encoded, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = parsed(data.value)
        for batch in pieces(batches):
            texts = [m.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {_kind(encoded, 'doc_id')}, text string")


def default_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), default_model_path())
