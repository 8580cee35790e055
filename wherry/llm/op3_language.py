"""Language identification by prediction by partial matching (PPM).

Per language a byte context tree of order ``ORDER`` is frozen after training. A byte's probability
under a language comes from the longest context that has seen it; every longer context that was seen
but not with this byte pays its escape probability (method C: distinct / (total + distinct)); below
order zero all 256 bytes are equally likely. The code length of a text is the sum over its bytes, and
the language with the shortest code wins; ``score`` is its posterior share for code lengths a byte.

Escapes of one byte are a sum over the orders, so the whole chain depends on the last ORDER bytes and
the byte itself alone. Scoring is thus a table lookup for each byte: contexts of ORDER bytes that were
trained have a row of exact code lengths for each language, the others are followed down to the
longest trained suffix. The tables are exact, not an approximation of the tree.

Every language of the training rows is learned, in blocks of ``BLOCK_LANGUAGES`` that have tables of their own.

Training counts come from a bounded, documented sample of labelled training rows: about
``TRAIN_DOCS`` documents of each language (whole texts, chosen by a hash of the id). Counting is done on
the executors and summed by n-gram before anything reaches the driver.

Defined cases: a text that is null or has no letter is ``und`` with score 0.0; so is every text if no
labelled row can be learned from; ties go to the alphabetically first language; null ids count as not
held out; repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wherry.llm.common import id_bucket, pieces, table

ORDER = 3
FOLD, HELD = 4, 2
#: Expected number of documents of each language that the trees are trained on.
TRAIN_DOCS = 400
#: Languages whose trees are one table; more languages are more tables, and each text is scored under all of them.
BLOCK_LANGUAGES = 64
CHUNK = 1 << 19

_LETTER = regex.compile(r"\p{L}")


def normal_bytes(text: str) -> bytes:
    """Lower-cased letters; every run of other characters is one blank."""
    return " ".join(regex.findall(r"[\p{L}\p{M}]+", text.lower())).encode("utf-8", "replace")


def gram_numbers(b: bytes, n: int) -> np.ndarray:
    """Each byte with the n - 1 bytes before it as one number; blanks stand before the text."""
    a = np.frombuffer(b" " * (n - 1) + b, np.uint8)
    size = len(b)
    key = a[:size].astype(np.uint32)
    for j in range(1, n):
        key = (key << np.uint32(8)) | a[j : size + j]
    return key


class PpmModel:
    """Frozen statistics of all languages and the tables to score with.

    ``grams``: for each order k from 0 to ORDER, sorted numbers of k + 1 bytes; ``counts``: their counts
    by language (one column for each).
    """

    def __init__(self, languages: list[str], grams: list[np.ndarray], counts: list[np.ndarray]):
        self.languages, self.grams = languages, grams
        n = len(languages)
        self.contexts: list[np.ndarray] = []
        self.escape: list[np.ndarray] = []
        self.cost: list[np.ndarray] = []
        uniform = np.full(n, 8.0)
        for k, (g, c) in enumerate(zip(grams, counts)):
            ctx, at = np.unique(g >> np.uint32(8), return_inverse=True)
            total = np.zeros((len(ctx), n))
            distinct = np.zeros((len(ctx), n))
            np.add.at(total, at, c)
            np.add.at(distinct, at, (c > 0).astype(float))
            # A context that a language has not seen costs no escape.
            with np.errstate(divide="ignore", invalid="ignore"):
                esc = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
                seen = -np.log2(c / (total + distinct)[at])
            if k == 0:
                below = np.broadcast_to(uniform, c.shape)
            else:
                below = self._lookup(k - 1, g & np.uint32((1 << (8 * k)) - 1))
            self.contexts.append(ctx)
            self.escape.append(esc)
            self.cost.append(np.where(c > 0, seen, esc[at] + below))

    def _lookup(self, k: int, g: np.ndarray) -> np.ndarray:
        """Code lengths by language of numbers of k + 1 bytes, from order k downwards."""
        out = np.empty((len(g), len(self.languages)))
        grams = self.grams[k]
        if not len(grams):
            out[:] = 8.0
            return out
        i = np.searchsorted(grams, g)
        i[i == len(grams)] = 0
        hit = grams[i] == g
        out[hit] = self.cost[k][i[hit]]
        miss = np.flatnonzero(~hit)
        if len(miss):
            rest = g[miss]
            ctx, c = self.contexts[k], rest >> np.uint32(8)
            j = np.searchsorted(ctx, c)
            j[j == len(ctx)] = 0
            esc = np.where((ctx[j] == c)[:, None], self.escape[k][j], 0.0)
            if k == 0:
                out[miss] = esc + 8.0
            else:
                out[miss] = esc + self._lookup(k - 1, rest & np.uint32((1 << (8 * k)) - 1))
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        total = np.zeros((len(texts), len(self.languages)))
        parts, owners, size = [], [], 0
        for i, b in enumerate(texts):
            g = gram_numbers(b, ORDER + 1)
            for s in range(0, len(g), CHUNK):
                parts.append(g[s : s + CHUNK])
                owners.append(i)
                size += len(parts[-1])
                if size >= CHUNK:
                    self._add(total, parts, owners)
                    parts, owners, size = [], [], 0
        if parts:
            self._add(total, parts, owners)
        return total

    def _add(self, total: np.ndarray, parts: list[np.ndarray], owners: list[int]) -> None:
        g = np.concatenate(parts)
        doc = np.repeat(np.array(owners), [len(p) for p in parts])
        grams = self.grams[ORDER]
        i = self._find(g)
        hit = grams[i] == g if len(grams) else np.zeros(len(g), bool)
        cost = self.cost[ORDER]
        ih, dh = i[hit], doc[hit]
        for lang in range(len(self.languages)):
            total[:, lang] += np.bincount(dh, cost[ih, lang], len(total))
        miss = np.flatnonzero(~hit)
        if len(miss):
            rare, at = np.unique(g[miss], return_inverse=True)
            found = self._lookup(ORDER, rare)
            dm = doc[miss]
            for lang in range(len(self.languages)):
                total[:, lang] += np.bincount(dm, found[at, lang], len(total))

    BITS = 21

    def _find(self, g: np.ndarray) -> np.ndarray:
        """Positions in the sorted grams: a hash table of first tries, a binary search for the rest."""
        grams = self.grams[ORDER]
        if not hasattr(self, "table"):
            self.table = np.zeros(1 << self.BITS, np.int32)
            self.table[self._slot(grams)] = np.arange(len(grams), dtype=np.int32)
            # The loser of a collision is found by search.
            self.lost = np.zeros(1 << self.BITS, bool)
            slot = self._slot(grams)
            self.lost[slot[self.table[slot] != np.arange(len(grams))]] = True
        if not len(grams):
            return np.zeros(len(g), np.int64)
        slot = self._slot(g)
        i = self.table[slot]
        again = np.flatnonzero((grams[i] != g) & self.lost[slot])
        if len(again):
            j = np.searchsorted(grams, g[again])
            j[j == len(grams)] = 0
            i[again] = j
        return i

    def _slot(self, g: np.ndarray) -> np.ndarray:
        return (g * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.BITS)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        ok = [bool(t) and _LETTER.search(t) is not None for t in texts]
        raw = [normal_bytes(t) if good else b"" for t, good in zip(texts, ok)]
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        bits = self.lengths(raw)
        best = bits.argmin(axis=1)
        n = np.array([max(1, len(b)) for b in raw])
        # Posterior share; code lengths of at most 64 bytes count, for neighbouring bytes are not independent.
        gap = (bits - bits.min(axis=1, keepdims=True)) * (np.minimum(n, 64) / n)[:, None]
        share = 1 / np.exp2(-np.minimum(gap, 60)).sum(axis=1)
        return (
            [self.languages[j] if good else "und" for j, good in zip(best, ok)],
            np.where(ok, share, 0.0),
        )


class PpmBlocks(PpmModel):
    """Models of disjoint languages, in the languages' order, as one."""

    def __init__(self, models: list[PpmModel]):
        self.models = models
        self.languages = [x for m in models for x in m.languages]

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        return np.hstack([m.lengths(texts) for m in self.models])


def train(docs: DataFrame) -> PpmModel:
    """Frozen trees from documents(doc_id, text, lang); rows without text, language or letters teach nothing."""
    rows = docs.select("doc_id", "text", "lang").filter((id_bucket("doc_id", FOLD) != HELD) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").count().collect()
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return PpmModel([], [np.zeros(0, np.uint32)] * (ORDER + 1), [np.zeros((0, 0))] * (ORDER + 1))
    keep = {r["lang"]: (1 << 20) if r["count"] <= TRAIN_DOCS else max(1, (1 << 20) * TRAIN_DOCS // r["count"]) for r in sizes}
    blocks = [languages[i : i + BLOCK_LANGUAGES] for i in range(0, len(languages), BLOCK_LANGUAGES)]
    models = [_train_block(rows, b, keep) for b in blocks]
    return models[0] if len(models) == 1 else PpmBlocks(models)


def _train_block(rows: DataFrame, languages: list[str], keep: dict[str, int]) -> PpmModel:
    """Trees of some languages; ``keep``: the share of each language's rows to learn from, of 2^20."""
    limit = F.create_map(*[F.lit(x) for lang in languages for x in (lang, keep[lang])])[F.col("lang")]
    sample = rows.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) < limit)
    number = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[bytes]] = {}
        for batch in batches:
            for t, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                kept.setdefault(number[lang], []).append(normal_bytes(t))
        for lang, texts in kept.items():
            g, n = np.unique(np.concatenate([gram_numbers(b, ORDER + 1) for b in texts]), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(g), lang, np.int32)), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"]
            )

    counted = sample.select("text", "lang").mapInArrow(count, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    g, at = np.unique(counted["gram"].to_numpy().astype(np.uint32), return_inverse=True)
    c = np.zeros((len(g), len(languages)))
    c[at, counted["lang"].to_numpy()] = counted["n"].to_numpy()
    return from_counts(languages, g, c)


def from_counts(languages: list[str], g: np.ndarray, c: np.ndarray) -> PpmModel:
    """Trees from counts of ORDER + 1 bytes: counts of shorter contexts are sums of those of longer ones."""
    grams, counts = [g], [c]
    for k in range(ORDER, 0, -1):
        shorter, at = np.unique(grams[0] & np.uint32((1 << (8 * k)) - 1), return_inverse=True)
        s = np.zeros((len(shorter), len(languages)))
        np.add.at(s, at, counts[0])
        grams.insert(0, shorter)
        counts.insert(0, s)
    return PpmModel(languages, grams, counts)


def identify(docs: DataFrame, model: PpmModel) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by about TRAIN_DOCS whole texts of each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in pieces(batches):
            langs, score = m.predict(part.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", (id_bucket("doc_id", FOLD) == HELD).alias("held_out"), "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, lang_pred string, score double"
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
