"""Benchmark decontamination on a distributed positional inverted index.

``build_index`` stores the training corpus as an index in the shared folder, a row for each shard of about
``SHARD_WORDS`` words: the shard's terms, and for each term the sorted positions of all its occurrences.
Documents lie one after another with a gap, so a position names the document too. The index holds every
token of every document, knows nothing of the test set and can be searched any number of times.

``search`` cuts the test items into windows, in blocks of bounded size that are written to the shared folder
too: nothing is broadcast and the driver sees file names only. Each task reads its shards and goes through the
blocks. A window is answered from its rarest terms: the posting list of the rarest one in the shard, moved
back by its offset, gives the candidate starts; the lists of the next rarer terms, moved likewise, are
intersected one after another until nothing or an exact match is left. All windows of a block go through a
step together. With ``slop`` above zero the same lists are intersected within that distance, which gives
proximity matches.

Words are ``WORD`` runs of the text with A-Z lowered. A window is ``WINDOW`` consecutive words of an
item; an item with fewer words, but not none, is one window.

Defined cases: null texts have no words, so no hits; items without words never match; repeated rows of
documents give repeated rows; repeated item rows count once for each distinct id; null item ids are left
out of the list; empty tables give no rows or no hits; other columns are ignored.
"""

from __future__ import annotations

import pickle
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wherry.llm.common import materialize, pieces, shared_dir, table
from wherry.llm.zipstore import open_store

WINDOW = 8
CONTAMINATED_ITEMS = 2
#: Characters of test text in one block, about.
BLOCK_CHARS = 1 << 20
#: Words and documents of a shard, about; a longer document is a shard of its own.
SHARD_WORDS, SHARD_ROWS = 1 << 17, 512
#: Shards that a task holds while it goes through the blocks once.
SHARDS_AT_ONCE = 4
#: Positions that are intersected in one step.
STEP = 1 << 17
#: Places between two documents, more than a window and its slop can span.
GAP = 64

# Lower-cases A-Z and blanks every ASCII byte that no word holds; all other bytes are word bytes.
_TO_WORDS = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TO_WORDS).split() if text else []


def windows(items: list[tuple[str | None, str | None]], width: int = WINDOW) -> dict[tuple[bytes, ...], list]:
    """Distinct windows of all items, each with the ids of the items it comes from."""
    found: dict[tuple[bytes, ...], list] = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            ids = found.setdefault(tuple(w[i : i + width]), [])
            if not ids or ids[-1] != item:
                ids.append(item)
    return found


class Block:
    """Windows as rows of term numbers, padded with the number behind the last term."""

    def __init__(self, items: list[tuple[str | None, str | None]]):
        found = windows(items)
        terms: dict[bytes, int] = {}
        rows = [[terms.setdefault(t, len(terms)) for t in w] for w in found]
        self.terms, self.items = list(terms), list(found.values())
        self.size = np.array([len(r) for r in rows], np.int64)
        self.rows = np.full((len(rows), max((len(r) for r in rows), default=1)), len(terms), np.int64)
        for r, numbers in zip(self.rows, rows):
            r[: len(numbers)] = numbers


class Shard:
    """Positional postings of a run of documents."""

    def __init__(self, doc_ids: list, n_words: np.ndarray, terms: list[bytes], df: np.ndarray, positions: np.ndarray):
        self.doc_ids, self.n_words, self.terms, self.df, self.positions = doc_ids, n_words, terms, df, positions
        self.starts = np.concatenate([[0], np.cumsum(n_words + GAP)])

    @classmethod
    def of(cls, doc_ids: list, docs: list[list[bytes]]) -> Shard:
        number = defaultdict(count().__next__)
        ids = np.concatenate([np.fromiter(map(number.__getitem__, d), np.int32, len(d)) for d in docs])
        n_words = np.array([len(d) for d in docs], np.int64)
        starts = np.concatenate([[0], np.cumsum(n_words + GAP)])[:-1]
        at = np.arange(len(ids)) + np.repeat(starts - np.concatenate([[0], np.cumsum(n_words)])[:-1], n_words)
        order = np.argsort(ids.astype(np.uint16) if len(number) < 1 << 16 else ids, kind="stable")  # short numbers are sorted by their digits
        return cls(doc_ids, n_words, list(number), np.bincount(ids, minlength=len(number)), at[order])

    def match(self, block: Block, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of all occurrences; with slop, starts where every term is that near to its place."""
        number = dict(zip(self.terms, range(len(self.terms))))
        mine = np.array([*(number.get(t, -1) for t in block.terms), -1], np.int64)
        df = np.where(mine < 0, 0, self.df[mine]) if len(self.terms) else np.zeros(len(mine), np.int64)
        padded = np.arange(block.rows.shape[1]) >= block.size[:, None]
        often = np.where(padded, np.iinfo(np.int64).max, df[block.rows])
        alive = np.flatnonzero(often.min(axis=1) > 0) if len(often) else np.zeros(0, np.int64)
        order = np.argsort(often[alive], axis=1, kind="stable")
        # Postings as one sorted list of (term, position), so that the windows' lists are intersected together.
        keys = np.repeat(np.arange(len(self.df)) << 32, self.df) + self.positions
        cut = np.concatenate([[0], np.cumsum(self.df)])
        first = mine[block.rows[alive, order[:, 0]]] if len(alive) else alive
        sizes = self.df[first] if len(alive) else alive
        found = [(np.zeros(0, np.int64),) * 2]
        for part in np.split(np.arange(len(alive)), np.flatnonzero(np.diff(np.cumsum(sizes) // STEP)) + 1):
            n = sizes[part]
            row = np.repeat(part, n)
            start = self.positions[np.repeat(cut[first[part]] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())] - order[row, 0]
            for j in range(1, order.shape[1]):
                place = order[row, j]
                term = block.rows[alive[row], place]
                ended = term == len(block.terms)
                want = (mine[term] << 32) + np.maximum(start + place - slop, 0)
                i = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                near = (keys[i] >= want) & (keys[i] <= (mine[term] << 32) + start + place + slop)
                kept = ended | near
                row, start = row[kept], start[kept]
                if not len(row):
                    break
            found.append((alive[row], start))
        return tuple(np.concatenate(c) for c in zip(*found))


def _shards(ids: list, texts: list[str | None]) -> Iterator[Shard]:
    docs, at, size = [], 0, 0
    for i, t in enumerate(texts):
        docs.append(words(t))
        size += len(docs[-1])
        if size >= SHARD_WORDS:
            yield Shard.of(ids[at : i + 1], docs)
            docs, at, size = [], i + 1, 0
    if docs:
        yield Shard.of(ids[at:], docs)


def build_index(docs: DataFrame) -> DataFrame:
    """The index of documents (doc_id, text), stored in the shared folder: doc_ids, n_words, terms (one to a line), df, positions."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, SHARD_ROWS):
            at = 0
            for s in _shards(list(range(batch.num_rows)), batch.column(1).to_pylist()):
                n = len(s.doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch.column(0).slice(at, n)),
                        pa.array([s.n_words.tolist()], pa.list_(pa.int64())),
                        *(pa.array([b], pa.binary()) for b in (b"\n".join(s.terms), s.df.astype(np.int32).tobytes(), s.positions.astype(np.uint32).tobytes())),
                    ],
                    names=["doc_ids", "n_words", "terms", "df", "positions"],
                )
                at += n

    return materialize(docs.select("doc_id", "text").mapInArrow(run, f"doc_ids array<{kind}>, n_words array<bigint>, terms binary, df binary, positions binary"))


def _stored(batch: pa.RecordBatch, i: int) -> Shard:
    n_words, terms, df, positions = (batch.column(c)[i].as_py() for c in range(1, 5))
    return Shard(batch.column(0)[i].values, np.array(n_words, np.int64), terms.split(b"\n") if terms else [], np.frombuffer(df, np.int32).astype(np.int64), np.frombuffer(positions, np.uint32).astype(np.int64))


def _write_blocks(items: DataFrame) -> list[str]:
    """Names of the files that hold the test items' windows, in blocks of about BLOCK_CHARS characters."""
    folder = shared_dir(items.sparkSession)
    size = items.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, rows, chars = [], [], 0

        def flush():
            store, root = open_store(folder)
            store.create_dir(root, recursive=True)
            names.append(f"{folder}/block-{uuid.uuid4().hex}")
            with store.open_output_stream(f"{root}/{names[-1].rsplit('/', 1)[1]}", compression=None) as sink:
                sink.write(pickle.dumps(Block(rows)))

        for batch in pieces(batches):
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows.append((item, text))
                chars += len(text or "")
                if chars >= BLOCK_CHARS:
                    flush()
                    rows, chars = [], 0
        if rows:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

    dealt = items.select(F.col("item_id").cast("string"), "text").repartition(int(size // BLOCK_CHARS) + 1)
    return [r["name"] for r in dealt.mapInArrow(run, "name string").collect()]


@lru_cache(maxsize=4)
def _read_block(name: str) -> Block:
    store, path = open_store(name)
    with store.open_input_stream(path) as source:
        return pickle.loads(source.read())


def search(index: DataFrame, items: DataFrame, slop: int = 0) -> DataFrame:
    """Per document: words, words within matches, and the ids of the items that match, as sorted strings.

    ``index``: of ``build_index``; ``items``: item_id, text. ``slop`` 0: exact phrases; above, up to 24: proximity.
    """
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    names = _write_blocks(items)

    def answer(shards: list[Shard]) -> Iterator[pa.RecordBatch]:
        hits = [np.zeros(int(s.starts[-1]) + 1, np.int32) for s in shards]
        items: list[list[set]] = [[set() for _ in s.n_words] for s in shards]
        for name in names:
            block = _read_block(name)
            for s, hit, mine in zip(shards, hits, items):
                window, start = s.match(block, slop)
                if not len(window):
                    continue
                doc = np.searchsorted(s.starts, start + slop, side="right") - 1
                np.add.at(hit, np.maximum(start - slop, s.starts[doc]), 1)
                np.add.at(hit, np.minimum(start + block.size[window] + slop, s.starts[doc] + s.n_words[doc]), -1)
                for d, w in set(zip(doc.tolist(), window.tolist())):
                    mine[d].update(block.items[w])
        for s, hit, mine in zip(shards, hits, items):
            covered = np.concatenate([[0], np.cumsum(np.cumsum(hit[:-1]) > 0)])
            n_hit = covered[s.starts[:-1] + s.n_words] - covered[s.starts[:-1]]
            yield pa.RecordBatch.from_arrays(
                [s.doc_ids, pa.array(s.n_words), pa.array(n_hit.astype(np.int64)), pa.array([sorted(x for x in m if x is not None) for m in mine], pa.list_(pa.string()))],
                names=["doc_id", "n_words", "n_hit", "items"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, SHARDS_AT_ONCE):
            yield from answer([_stored(batch, i) for i in range(batch.num_rows)])

    return index.mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, items array<string>")


def postings(index: DataFrame) -> DataFrame:
    """The stored index as a table, one row for each shard and term: term, doc_ids and word positions side by side."""
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in (_stored(batch, i) for i in range(batch.num_rows)):
                doc = np.searchsorted(s.starts, s.positions, side="right") - 1
                cut = pa.array(np.concatenate([[0], np.cumsum(s.df)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([t.decode("utf-8", "replace") for t in s.terms], pa.string()),
                        pa.ListArray.from_arrays(cut, s.doc_ids.take(pa.array(doc))),
                        pa.ListArray.from_arrays(cut, pa.array((s.positions - s.starts[doc]).astype(np.int32))),
                    ],
                    names=["term", "doc_ids", "positions"],
                )

    return index.mapInArrow(run, f"term string, doc_ids array<{kind}>, positions array<int>")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The digest form: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = search(build_index(docs), items)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.size("items") >= CONTAMINATED_ITEMS).alias("contaminated"),
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), i AS (
  SELECT DISTINCT item_id, least(8, len(w)) AS k, array_to_string(w[s : s + 7], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS s FROM b WHERE len(w) > 0)
), p AS (
  SELECT d.r, x.k, d.w, unnest(range(1, len(d.w) - x.k + 2)) AS s FROM d CROSS JOIN (SELECT DISTINCT k FROM i) x WHERE len(d.w) >= x.k
), m AS (
  SELECT p.r, p.s, i.k, i.item_id FROM p JOIN i ON i.k = p.k AND i.win = array_to_string(p.w[p.s : p.s + p.k - 1], ' ')
), h AS (
  SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS q FROM m) GROUP BY r
), t AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM m WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN h ON h.r = d.r LEFT JOIN t ON t.r = d.r
"""
