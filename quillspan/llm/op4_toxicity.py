"""Toxicity by compression distance: one zstandard dictionary for toxic text, one for ordinary text.

A window is a word behind a fixed carrier that both dictionaries hold, so that zstandard always writes a compressed block and its length
tells what the dictionary knows of the word. The distance of a window is its length under the ordinary dictionary less that under the
toxic one. Dictionaries are trained by contrast (prefixes of words whose document frequency differs between the classes), since training by
frequency alone fills both with the same everyday text. Thresholds and weights are calibrated on documents that trained no dictionary.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.llm.common import packed, released

FOLDS = 5
#: Bound of the training sample: toxic documents (twice as many ordinary ones), and bytes of each, longer ones being left out of it.
SAMPLE, SAMPLE_BYTES = 2500, 32_768
#: A term must occur in so many training texts, however many there are (in fewer where there are under 640); told by cross-validation on training rows.
MOST_FLOOR = 8
PREFIXES = (4, 5, 6, 7, 8)
#: Around every word: what both dictionaries hold. zstandard looks for no match in a block's last 8 bytes, so a word must not end one.
BEFORE, AFTER = bytes(range(1, 9)) + bytes(range(14, 22)), bytes(range(0xC0, 0xD0))
DICTIONARY_BYTES = 8192
_REMEMBER = 300_000


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def anchored(word: str) -> bytes:
    """The word's bytes, each shifted by its place, so that a match between words can only stand at the same place in both."""
    return bytes((b + 37 * i) & 255 for i, b in enumerate(word.encode("utf-8", "surrogatepass")))


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(content + BEFORE + AFTER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters(compression_level=3, min_match=5, strategy=zstandard.STRATEGY_GREEDY, window_log=17, write_content_size=False, write_dict_id=False, write_checksum=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    held.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=how)


@dataclass
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    #: Distances from which a window counts, ascending.
    thresholds: tuple[int, ...]
    weights: tuple[float, ...]

    def scorer(self):
        return _Scorer(self)


class _Scorer:
    def __init__(self, model: ToxicityModel) -> None:
        self.model = model
        self.known: dict[str, int] = {}
        self.pair = _compressor(model.ordinary), _compressor(model.toxic)

    def distance(self, word: str) -> int:
        data = BEFORE + b" " + anchored(word + " ") + AFTER
        return len(self.pair[0].compress(data)) - len(self.pair[1].compress(data))

    def features(self, text: str | None) -> list[float]:
        """The largest distance; for each threshold, the logarithm of the windows at or over it and whether there is any; 1."""
        words = words_of(text)
        if len(self.known) > _REMEMBER:
            self.known = {}
        known = self.known
        for w in set(words).difference(known):
            known[w] = self.distance(w)
        found = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        out = [float(found.max()) if len(words) else 0.0]
        for t in self.model.thresholds:
            n = int((found >= t).sum())
            out += [float(np.log1p(n)), float(n > 0)]
        return [*out, 1.0]

    def score(self, text: str | None) -> float:
        z = float(np.dot(self.features(text), self.model.weights))
        return float(1.0 / (1.0 + np.exp(-max(-30.0, min(30.0, z)))))


def _frequencies(texts: list[str]) -> Counter:
    out: Counter = Counter()
    for t in texts:
        found = set()
        for w in set(words_of(t)):
            found.update(w[:n] for n in PREFIXES if len(w) >= n)
            found.add(w + " ")
        out.update(found)
    return out


def _families(texts: list[str], bands: int = 6, rows: int = 4) -> list[str]:
    """One text of each family of near copies (equal in a band of minhashes of their words), so that copies don't count as evidence."""
    rng = np.random.default_rng(11)
    factor = rng.integers(1, 2**31, bands * rows, dtype=np.int64) * 2 + 1
    seen: set[tuple] = set()
    out = []
    for t in texts:
        words = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in set(words_of(t))), np.int64)
        if not len(words):
            continue
        least = ((words[:, None] * factor) & 0xFFFFFFFF).min(axis=0).reshape(bands, rows)
        keys = {(b, *r) for b, r in enumerate(least.tolist())}
        if not keys & seen:
            out.append(t)
        seen |= keys
    return out


def _contrast(own: Counter, n_own: int, other: Counter, n_other: int) -> list[str]:
    """Prefixes and whole words (with a space at the end) much more frequent in own, the shortest of those that begin alike, lengthened while they lose little."""
    floor = min(MOST_FLOOR, max(4, n_own // 80))
    good = {g for g, n in own.items() if n >= floor and n * (n_other + 1) > 12 * (other[g] + 0.4) * (n_own + 1)}
    roots = [g for g in good if not any(g[:k] in good for k in PREFIXES if k < len(g))]
    by_root: dict[str, list[str]] = {}
    for g in sorted(good):
        for r in {g[:k] for k in PREFIXES} & set(roots) | ({g} & set(roots)):
            by_root.setdefault(r, []).append(g)
    out = []
    for r in roots:
        out += sorted({g for g in by_root.get(r, [r]) if own[g] >= 0.25 * own[r]} | {r})
    return sorted(out, key=lambda g: (own[g], g))


def _content(segments: list[str], size: int) -> bytes:
    return b"".join(b" " + anchored(s) for s in segments)[-size:]


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 400, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps; classes weigh alike by half, so that rare toxic documents count."""
    w = np.zeros(x.shape[1])
    rate = max(1, int((y == 0).sum())) / max(1, int((y == 1).sum()))
    own = np.where(y == 1, rate**0.5, 1.0)
    for _ in range(min(rounds, 60)):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (own * (p - y)) + ridge * w
        hessian = (x * (own * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(toxic: list[str], ordinary: list[str]) -> ToxicityModel:
    """Three fifths of each class train the dictionaries, the rest calibrates. Without both classes the score is the rate of toxic documents."""
    if not toxic or not ordinary:
        return ToxicityModel(b"", b"", (1,), (0.0, 0.0, 0.0, 3.0 if toxic else -3.0))
    toxic, ordinary = _families(toxic) or toxic, _families(ordinary) or ordinary
    cut = lambda rows: (rows[: max(1, len(rows) * 3 // 5)], rows[len(rows) * 3 // 5 :] or rows)
    (ta, tb), (oa, ob) = cut(toxic), cut(ordinary)
    ft, fo = _frequencies(ta), _frequencies(oa)
    segments = _contrast(ft, len(ta), fo, len(oa))
    # What a toxic segment shares with ordinary words is in the ordinary dictionary too, so that only the rest of it tells.
    shared = sorted({s[:n] for s in segments for n in PREFIXES if n < len(s) and fo[s[:n]] * 12 * (len(ta) + 1) >= ft[s[:n]] * (len(oa) + 1)})
    known = {s[:4] for s in segments}
    everyday = [w for w, _ in sorted(fo.items(), key=lambda x: (x[1], x[0])) if len(w) >= 4 and w[:4] not in known]
    toxic_bytes = _content(segments, DICTIONARY_BYTES)
    ordinary_bytes = _content(_contrast(fo, len(oa), ft, len(ta)) + everyday[-2000:] + shared, max(len(toxic_bytes), sum(len(s) + 6 for s in shared), 64))
    model = ToxicityModel(toxic_bytes, ordinary_bytes, (1,), ())
    probe = model.scorer()
    most = lambda texts: np.array([max(map(probe.distance, set(words_of(t))), default=0) for t in texts])
    mt, mo = most(tb), most(ob)
    # Thresholds: where the share of toxic documents with such a window first exceeds that of ordinary ones by 1.5, 5 and 30 times.
    found = []
    for times in (1.5, 5, 30):
        for d in range(1, 1 + max(1, int(max(mt.max(), mo.max())))):
            if ((mt >= d).sum() + 0.1) * len(mo) > times * ((mo >= d).sum() + 0.1) * len(mt):
                found.append(d)
                break
    model.thresholds = tuple(sorted(set(found))) or (1,)
    probe = model.scorer()
    x = np.array([probe.features(t) for t in [*tb, *ob]])
    y = np.array([1] * len(tb) + [0] * len(ob))
    model.weights = tuple(float(w) for w in _fit(x, y))
    return model


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train_on(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """At most `sample` toxic and twice as many ordinary documents, those of least hash, from labelled rows outside the held-out fold. The ids (bounded) are sent to
    the documents; of rows that share an id the least text is taken, so the driver gets at most 3 * sample * SAMPLE_BYTES bytes. Conflicting labels of an id count as toxic."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64(F.col("doc_id"), F.lit(4))
    picked: dict[int, int] = {}
    for kind in (1, 0):
        picked |= {r[0]: kind for r in known.where(F.col("toxic") == kind).select("doc_id", order.alias("h")).orderBy("h", "doc_id").limit(sample if kind else 2 * sample).collect()}
    if not picked:
        return train([], [])
    ids = docs.sparkSession.createDataFrame([(int(i),) for i in picked], "doc_id long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES)
    rows = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).toLocalIterator(prefetchPartitions=True)
    texts = sorted((int(r[0]), r[1] or "") for r in rows)
    texts.sort(key=lambda r: (r[0] * 2654435761 % 2**32, r[1]))
    return train([t for i, t in texts if picked[i] == 1], [t for i, t in texts if picked[i] == 0])


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """-> _row (every row of docs as a struct, so that no name clashes), score (0 to 1) and predicted (score >= 0.5).

    Null and empty texts have no window and get the score that calibration gives to none. Every window of a text counts, however long.
    """
    base = packed(docs)
    row = base.schema["_row"]
    schema = T.StructType([row, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    at = [f.name.lower() for f in row.dataType.fields].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for b in batches:
            texts = pc.struct_field(b.column(0), at)
            # a text at a time, so that a batch's texts aren't all held twice
            scores = np.array([scorer.score(t.as_py()) for t in texts], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["_row", "score", "predicted"])

    return base.mapInArrow(released(run), schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """-> doc_id, held_out, score, predicted; one row per input row (null ids count as not held out). Tables without labels of both kinds give a constant score.

    Equal texts have equal scores, repeated rows theirs each; a score of just 0.5 counts as toxic. Other columns are ignored.
    """
    model = train_on(docs, labels)
    scored = score_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    return scored.select(F.col("_row.doc_id").alias("doc_id"), "score", "predicted").select("doc_id", held_out().alias("held_out"), "score", "predicted")
