"""Toxicity by non-negative positive-unlabelled learning.

Positives are confirmed toxic documents; the other class is never labelled: the unlabelled sample is
drawn from all documents. A linear classifier on the presence of word-bound byte 5-grams is trained in
numpy with the class-prior-corrected risk

    R = prior * R_pos(+1) + max(0, R_unl(-1) - prior * R_pos(-1))

whose negative part is held at zero or above (when it falls below, the step ascends on it instead).
The prior is the share of toxic rows among all labelled training rows.

The fit uses bounded samples (``MAX_POSITIVES``, ``MAX_UNLABELLED``: expected numbers of documents, whole
texts); the prior and the scores cover every row. Sampling is by a hash of the id, so it is repeatable.

Defined cases: null text counts as empty, and an empty text's score is that of a text without features;
null labels and label rows without a document are ignored; without any positive every score is 0.0;
documents without an id are scored and count as held out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wherry.llm.common import id_bucket, materialize, pieces, table

#: Expected sizes of the samples that the classifier is fitted on.
MAX_POSITIVES = 6_000
MAX_UNLABELLED = 15_000
#: Largest numbers of 5-grams that are looked at and kept as features.
MAX_CANDIDATES = 200_000
MAX_FEATURES = 8_192
#: Standard deviations by which a feature's positives exceed those of the unlabelled sample.
LEAST_SIGMAS = 6
GRAM = 5
SLICE = 1 << 20
FOLD, HELD = 5, 0

_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def _clean(text: str | None) -> bytes:
    return b" " + (text or "").lower().encode("utf-8", "replace").translate(_PLAIN) + b" "


def slices(texts: list[str | None], overlap: int = GRAM - 1) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Cleaned texts in buffers of about SLICE bytes: (buffer, document numbers, their ends).

    A document longer than a slice is dealt to several slices that overlap, so no gram is lost.
    """
    parts: list[bytes] = []
    owners: list[int] = []
    size = 0

    def out():
        return b"".join(parts), np.array(owners), np.cumsum([len(p) for p in parts])

    for i, t in enumerate(texts):
        b = _clean(t)
        for start in range(0, max(1, len(b) - overlap), SLICE):
            p = b[start : start + SLICE + overlap]
            parts.append(p)
            owners.append(i)
            size += len(p)
            if size >= SLICE:
                yield out()
                parts, owners, size = [], [], 0
    if parts:
        yield out()


def gram_keys(buffer: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(5 bytes as one number, position) of each gram that lies within one part and holds a word byte twice or more."""
    a = np.frombuffer(buffer, np.uint8)
    n = len(a) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key = a[:n].astype(np.uint64)
    for j in range(1, GRAM):
        key <<= np.uint64(8)
        key |= a[j : n + j]
    inside = np.ones(n, bool)
    for j in range(1, GRAM):  # grams that run over the end of a part
        at = ends[:-1] - j
        inside[at[(at >= 0) & (at < n)]] = False
    # No blank except in the first or last place: a gram belongs to one word.
    blank = a == 32
    for j in range(1, GRAM - 1):
        inside &= ~blank[j : n + j]
    at = np.flatnonzero(inside)
    return key[at], at


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


class GramTable:
    """Exact lookup of gram numbers: sorted keys behind a one-byte presence filter."""

    BITS = 22

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys.astype(np.uint64))
        self.filter = np.zeros(1 << self.BITS, np.bool_)
        self.filter[_slot(self.keys, self.BITS)] = True

    def hits(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Distinct (document number, gram number) pairs, slice by slice."""
        if not len(self.keys):
            return
        for buffer, owners, ends in slices(texts):
            key, at = gram_keys(buffer, ends)
            may = np.flatnonzero(self.filter[_slot(key, self.BITS)])
            key, at = key[may], at[may]
            i = np.searchsorted(self.keys, key)
            i[i == len(self.keys)] = 0
            ok = self.keys[i] == key
            doc = owners[np.searchsorted(ends, at[ok], side="right")]
            pair = np.unique(doc.astype(np.int64) * len(self.keys) + i[ok])
            yield pair // len(self.keys), pair % len(self.keys)

    def rows(self, texts: list[str | None]) -> list[np.ndarray]:
        """Distinct gram numbers of each text."""
        docs, grams = [], []
        for d, g in self.hits(texts):
            docs.append(d)
            grams.append(g)
        if not docs:
            return [np.zeros(0, np.int64)] * len(texts)
        pair = np.unique(np.concatenate(docs) * len(self.keys) + np.concatenate(grams))
        cuts = np.searchsorted(pair // len(self.keys), np.arange(1, len(texts)))
        return np.split(pair % len(self.keys), cuts)


def fit_nnpu(pos: list[np.ndarray], unl: list[np.ndarray], n_features: int, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-3):
    """(weights, bias) of a linear classifier under the non-negative risk with the logistic loss; rows are feature lists."""

    def flat(rows):
        return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), (np.concatenate(rows) if rows else np.zeros(0)).astype(np.int64), max(1, len(rows))

    (pi, pj, np_), (ui, uj, nu) = flat(pos), flat(unl)
    w, b = np.zeros(n_features), 0.0
    m, v, mb, vb = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0

    def margin(i, j, n):
        return np.bincount(i, w[j], n) + b

    def grad(i, j, dz):
        return np.bincount(j, dz[i], n_features), dz.sum()

    def sig(z):
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    for t in range(1, steps + 1):
        zp, zu = margin(pi, pj, np_), margin(ui, uj, nu)
        sp, su = sig(zp), sig(zu)
        # logistic loss: l(z,+1) = log(1+e^-z), l(z,-1) = log(1+e^z)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        neg_u, neg_p = grad(ui, uj, su / nu), grad(pi, pj, -prior * sp / np_)
        gneg, gnegb = neg_u[0] + neg_p[0], neg_u[1] + neg_p[1]
        if negative >= 0:
            gpos, gposb = grad(pi, pj, prior * (sp - 1) / np_)
            g, gb = gpos + gneg, gposb + gnegb
        else:
            g, gb = -gneg, -gnegb
        g = g + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w = np.maximum(w - rate * (m / c1) / (np.sqrt(v / c2) + 1e-8), 0.0)  # a feature chosen for toxicity never excuses a text
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w, b


def decision_margin(zp: np.ndarray, zu: np.ndarray, prior: float) -> float:
    """Margin with the least corrected zero-one risk: prior * misses + max(0, flagged share of the unlabelled - prior * hits).

    It lies in the middle between the lowest positive that is still flagged and the next lower unlabelled margin.
    """
    zp, zu = np.sort(zp), np.sort(zu)
    cuts = np.unique(zp)
    misses = np.searchsorted(zp, cuts, "left") / len(zp)
    flagged = 1 - np.searchsorted(zu, cuts, "left") / max(1, len(zu))
    risk = prior * misses + np.maximum(0, flagged - prior * (1 - misses))
    cut = cuts[len(cuts) - 1 - np.argmin(risk[::-1])]
    below = zu[zu < cut]
    return float((cut + below[-1]) / 2 if len(below) else cut - 1e-6)


class ToxicModel:
    """Frozen features, weights and bias."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float, trained: bool = True):
        self.table, self.weights, self.bias, self.trained = GramTable(keys), weights, bias, trained

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(texts))
        z = np.full(len(texts), self.bias)
        rows = self.table.rows(texts)
        for i, r in enumerate(rows):
            if len(r):
                z[i] += self.weights[r].sum()
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _share(total: int, wanted: int) -> int:
    """Threshold on a hash modulo 2^20 that keeps about ``wanted`` of ``total`` rows."""
    return (1 << 20) if total <= wanted else max(1, int((1 << 20) * wanted / total))


def _hash20(col: str):
    return F.pmod(F.xxhash64(F.col(col).cast("string")), F.lit(1 << 20))


def train(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    """Fit on documents(doc_id, text) and labels(doc_id, toxic) of the training fold."""
    rows = labels.select("doc_id", "toxic").filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (id_bucket("doc_id", FOLD) != HELD))
    one = rows.groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    n, k = one.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    untrained = ToxicModel(np.zeros(0, np.uint64), np.zeros(0), 0.0, trained=False)
    if not k:
        return untrained
    prior = min(max(k / n, 1e-4), 0.9)
    total = docs.count()
    # The ids of the positive sample: bounded by MAX_POSITIVES in expectation, so they can be broadcast.
    ids = one.filter((F.col("toxic") == 1) & (_hash20("doc_id") < _share(k, MAX_POSITIVES))).select("doc_id", F.lit(True).alias("is_positive"))
    sample = (
        docs.select("doc_id", "text")
        .join(F.broadcast(ids), "doc_id", "left")
        .withColumn("is_unlabelled", F.coalesce(_hash20("doc_id") < _share(total, MAX_UNLABELLED), F.lit(False)))
        .filter(F.col("is_positive").isNotNull() | F.col("is_unlabelled"))
        .select(F.coalesce("is_positive", F.lit(False)).alias("p"), F.col("is_unlabelled").alias("u"), "text")
    )
    sample = materialize(sample)

    def positive_grams(batches):
        counts: dict[int, int] = {}
        n_docs = 0
        for batch in pieces(batches):
            texts = batch.column(0).to_pylist()
            n_docs += len(texts)
            for t in texts:
                seen = [gram_keys(b, e)[0] for b, _, e in slices([t])]
                for g in np.unique(np.concatenate(seen)).tolist() if seen else ():
                    counts[g] = counts.get(g, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([*counts, -1], pa.int64()), pa.array([*counts.values(), n_docs], pa.int64())], names=["g", "n"])

    counted = sample.filter("p").select("text").mapInArrow(positive_grams, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    n_pos = counted.filter("g = -1").select("n").first()
    n_pos = n_pos[0] if n_pos else 0
    if not n_pos:
        return untrained
    least = max(2, n_pos // 200)
    got = counted.filter((F.col("g") >= 0) & (F.col("n") >= least)).orderBy(F.desc("n"), "g").limit(MAX_CANDIDATES).toPandas()
    order = np.argsort(got["g"].to_numpy().astype(np.uint64))
    keys, df_p = got["g"].to_numpy().astype(np.uint64)[order], got["n"].to_numpy()[order]

    def unlabelled_grams(batches):
        found, docs_seen, grams = np.zeros(len(keys), np.int64), 0, GramTable(keys)
        for batch in pieces(batches):
            texts = batch.column(0).to_pylist()
            docs_seen += len(texts)
            for r in grams.rows(texts):
                found[r] += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(found[at], docs_seen))], names=["g", "n"])

    seen = sample.filter("u").select("text").mapInArrow(unlabelled_grams, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toPandas()
    n_unl = int(seen.loc[seen["g"] == -1, "n"].sum())
    df_u = np.zeros(len(keys))
    real = seen["g"] >= 0
    df_u[seen.loc[real, "g"]] = seen.loc[real, "n"]
    # Share of the documents with the gram that the prior makes positive; a gram needs half at least.
    expected = n_pos * (df_u + 0.5) / max(1, n_unl)
    posterior = prior * df_p / expected
    keep = np.flatnonzero((posterior >= 0.5) & (df_p - expected >= LEAST_SIGMAS * np.sqrt(expected)))
    keep = np.sort(keep[np.argsort(-df_p[keep], kind="stable")][:MAX_FEATURES])
    features = keys[keep]

    def featured(batches):
        grams = GramTable(features)
        for batch in pieces(batches):
            rows = grams.rows(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tolist() for r in rows], pa.list_(pa.int32()))], names=["p", "u", "f"])

    data = sample.select("p", "u", "text").mapInArrow(featured, "p boolean, u boolean, f array<int>").toPandas()
    as_rows = lambda x: [np.asarray(r, np.int64) for r in x]
    pos, unl = as_rows(data.loc[data["p"], "f"]), as_rows(data.loc[data["u"], "f"])
    w, b = fit_nnpu(pos, unl, len(features), prior)
    margins = [np.array([w[r].sum() + b for r in rows]) for rows in (pos, unl)]
    return ToxicModel(features, w, float(b) - decision_margin(*margins, prior))


def score(docs: DataFrame, trained: ToxicModel) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    parts = (trained.table.keys, trained.weights, trained.bias, trained.trained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = ToxicModel(*parts)
        for batch in pieces(batches):
            s = m.score(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", (id_bucket("doc_id", FOLD) == HELD).alias("held_out"), "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int"
    )


def accepted(docs: DataFrame, trained: ToxicModel) -> DataFrame:
    """The rows of documents(text, ...) that are not predicted to be toxic, all columns as they are."""
    parts = (trained.table.keys, trained.weights, trained.bias, trained.trained)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = ToxicModel(*parts)
        for batch in pieces(batches):
            yield batch.filter(pa.array(m.score(batch.column(at).to_pylist()) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
