"""A toxicity classifier regularised by counterfactuals.

Features are the presence of words and of word beginnings (hashed).  A logistic model is
fitted on a bounded sample of labelled rows (`max_rows`, those of least hash).  In every
sampled text that names a group, identity terms are swapped for another of their list, and
the squared change of the text's logit is added to the loss with weight `swap_penalty`:
a neutral mention of a group then moves no score, and no group is scored unlike another.

The fitted weights are a fixed-size vector.  Null and empty texts score as a text without
features does; repeated texts have equal scores, rows that repeat an id are one labelled text
(that of least hash, toxic where a label says so), and ties of features go to the least number.  Extra columns don't matter; an empty table gives no rows; texts are taken whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweft.llm import common as C
from panelweft.llm.language import held_out

#: Labelled rows that a fit may use.
MAX_ROWS = 12_000
#: Features that the model keeps: those whose log-odds differ most surely between the labels.
MAX_FEATURES = 6_000
PREFIXES = (4, 5, 6, 7, 8, 9)
#: Identity terms by kind; within a list any may stand for another.
IDENTITY_TERMS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "catholic", "atheist", "sikh"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "catholics", "atheists", "sikhs"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("women", "men"), ("woman", "man"), ("girls", "boys"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("old", "young"), ("deaf", "blind", "disabled"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("cristianos", "musulmanes", "ateos"),
    ("femmes", "hommes"), ("femme", "homme"), ("chrétiens", "musulmans", "juifs"),
    ("frauen", "männer"), ("frau", "mann"), ("christen", "muslime", "juden"),
)


def _features(w: C.Words) -> np.ndarray:
    """(words, 1 + prefixes) of 64-bit feature hashes; 0 is none."""
    return np.stack([w.hash, *w.prefix], axis=1) if len(w.hash) else np.zeros((0, 1 + len(PREFIXES)), np.uint64)


def _words(data: np.ndarray, offsets: np.ndarray) -> C.Words:
    return C.words_of(data, offsets, C.ALNUM, PREFIXES)


def _of_texts(texts: list[str]) -> list[np.ndarray]:
    """Distinct features of each text."""
    data, offsets = C.text_buffers(pa.array(texts, pa.large_string()))
    w = _words(data, offsets)
    f = _features(w)
    return [np.setdiff1d(f[a:b].ravel(), np.zeros(1, np.uint64)) for a, b in zip(w.bounds, w.bounds[1:], strict=False)]


def swaps() -> dict[int, np.ndarray]:
    """From an identity term's word hash to the features of it and of every other term of its list."""
    out = {}
    for terms in IDENTITY_TERMS:
        feats = _of_texts(list(terms))
        data, offsets = C.text_buffers(pa.array(terms, pa.large_string()))
        for i, h in enumerate(_words(data, offsets).hash.tolist()):
            out[h] = (feats[i], [f for j, f in enumerate(feats) if j != i])
    return out


class Model:
    """Weights of the kept features."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float) -> None:
        order = np.argsort(keys)
        self.keys, self.weights, self.bias = keys[order], weights[order], bias

    def logits(self, w: C.Words) -> np.ndarray:
        n = len(w.bounds) - 1
        z = np.full(n, self.bias)
        f = _features(w)
        if not len(self.keys) or not len(f):
            return z
        seen = np.zeros(1 << 16, bool)
        seen[self.keys >> np.uint64(48)] = True
        row, col = np.nonzero(seen[f >> np.uint64(48)])
        k = np.searchsorted(self.keys, f[row, col])
        k[k == len(self.keys)] = 0
        same = self.keys[k] == f[row, col]
        doc = np.searchsorted(w.bounds, row[same], side="right") - 1
        once = np.unique(doc * len(self.keys) + k[same])
        np.add.at(z, once // len(self.keys), self.weights[once % len(self.keys)])
        return z


def _descend(rows, cols, n: int, y: np.ndarray, pairs, swap_penalty: float, ridge: float, n_feat: int, turns: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the full sample; pairs: (row, feature, sign) of each counterfactual's change."""
    w, bias = np.zeros(n_feat), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    prow, pcol, psign, n_pairs = pairs
    m, v = np.zeros(n_feat + 1), np.zeros(n_feat + 1)
    for t in range(1, turns + 1):
        z = np.bincount(rows, w[cols], n) + bias
        e = 1 / (1 + np.exp(-z)) - y
        g = np.bincount(cols, e[rows], n_feat) / n + ridge * w
        if n_pairs:
            change = np.bincount(prow, psign * w[pcol], n_pairs)
            g += 2 * swap_penalty * np.bincount(pcol, psign * change[prow], n_feat) / n_pairs
        g = np.append(g, e.mean())
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        step = 0.1 * (1 - t / (turns + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w -= step[:-1]
        bias -= step[-1]
    return w, float(bias)


def fit_rows(kept: np.ndarray, texts: list[np.ndarray], y: np.ndarray, changes: list[tuple[int, np.ndarray, np.ndarray]], *, swap_penalty: float = 5.0, ridge: float = 2e-4) -> Model:
    """kept: sorted features of the model; texts: places in kept of each row's; changes: (row, places lost, places won) of each counterfactual."""
    if not len(y):
        return Model(np.zeros(0, np.uint64), np.zeros(0), -3.0)
    rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    cols = np.concatenate([*texts, np.zeros(0, np.int64)]).astype(np.int64)
    none = np.zeros(0, np.int64)
    prow = np.concatenate([none, *(np.full(len(lost) + len(won), i) for i, (_, lost, won) in enumerate(changes))])
    pcol = np.concatenate([none, *(np.concatenate([lost, won]) for _, lost, won in changes)]).astype(np.int64)
    psign = np.concatenate([np.zeros(0), *(np.repeat([-1.0, 1.0], [len(lost), len(won)]) for _, lost, won in changes)])
    w, bias = _descend(rows, cols, len(y), y.astype(float), (prow, pcol, psign, len(changes)), swap_penalty, ridge, len(kept))
    return Model(kept, w, bias)


def _sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int) -> DataFrame:
    """(text, _id, _y) of the sample, a row an id: of several texts the one of least hash."""
    sample = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    got = [tuple(r) for r in sample.orderBy(F.xxhash64("_id"), "_id").limit(max_rows).collect()]
    sample = docs.sparkSession.createDataFrame(got, "_id long, _y int")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(sample), F.col("id") == F.col("_id"))
    return rows.groupBy("_id", "_y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).repartition(C.width(docs.sparkSession))


def _selected(rows: DataFrame, n_pos: int, n_neg: int, max_features: int) -> np.ndarray:
    """The surest features of the sample, and those of identity terms; counted by tasks, so the driver gets max_features rows at most."""
    schema = pa.schema([("f", pa.int64()), ("pos", pa.int64()), ("neg", pa.int64())])

    def count(batches):
        held = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for batch in batches:
            for part in C.blocks(batch, "text"):
                w = _words(*C.text_buffers(C.column(part, "text")))
                f = _features(w)
                own = [np.setdiff1d(f[a:b].ravel(), np.zeros(1, np.uint64)) for a, b in zip(w.bounds, w.bounds[1:], strict=False)]
                y = np.repeat(C.column(part, "_y").to_numpy(), [len(x) for x in own]).astype(np.int64)
                keys, back = np.unique(np.concatenate(own), return_inverse=True)
                pos = np.bincount(back, y, len(keys)).astype(np.int64)
                held.append((keys, pos, np.bincount(back, minlength=len(keys)) - pos))
        keys, back = np.unique(np.concatenate([k for k, _, _ in held]), return_inverse=True)
        pos, neg = (np.bincount(back, np.concatenate([h[i] for h in held]), len(keys)).astype(np.int64) for i in (1, 2))
        for at in range(0, len(keys), 1 << 17):
            e = slice(at, at + (1 << 17))
            yield C.batch_of(schema, keys[e].view(np.int64), pos[e], neg[e])

    sums = rows.mapInArrow(C.tidy(count), "f long, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).filter("p + n >= 3")
    odds = f"ln((p + 0.5) / ({n_pos} - p + 0.5)) - ln((n + 0.5) / ({n_neg} - n + 0.5))"
    best = sums.select("f", F.expr(f"abs({odds}) / sqrt(1 / (p + 0.5) + 1 / (n + 0.5))").alias("sure")).filter("sure > 1.5").orderBy(F.desc("sure"), "f").limit(max_features)
    named = np.concatenate([np.concatenate([own, *others]) for own, others in swaps().values()])
    return np.union1d(np.array([r["f"] for r in best.select("f").collect()], np.int64).view(np.uint64), named)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES, swap_penalty: float = 5.0) -> Model:
    """A model from at most max_rows labelled rows; both frames must hold rows to learn from only."""
    C.ship(docs.sparkSession)
    folder = C.shared_dir(docs.sparkSession)
    rows = C.stored(_sampled(docs, labels, id_col, text_col, label_col, max_rows), f"{folder}/rows")
    n_pos, n_all = rows.agg(F.coalesce(F.sum("_y"), F.lit(0)), F.count("*")).first()
    kept = _selected(rows, n_pos, n_all - n_pos, max_features)
    known = swaps()

    def run(batches):
        def at(x: np.ndarray) -> bytes:
            if not len(kept):
                return b""
            k = np.minimum(np.searchsorted(kept, x), len(kept) - 1)
            return k[kept[k] == x].astype(np.int32).tobytes()

        for batch in batches:
            for part in C.blocks(batch, "text"):
                w = _words(*C.text_buffers(C.column(part, "text")))
                f = _features(w)
                feats, lost, won = [], [], []
                for a, b in zip(w.bounds, w.bounds[1:], strict=False):
                    own = np.setdiff1d(f[a:b].ravel(), np.zeros(1, np.uint64))
                    named = [known[h] for h in set(w.hash[a:b].tolist()) if h in known]
                    gone = np.unique(np.concatenate([x for x, _ in named])) if named else np.zeros(0, np.uint64)
                    came = np.unique(np.concatenate([x[int(own[0] % len(x))] for _, x in named])) if named else gone
                    feats.append(at(own)), lost.append(at(np.setdiff1d(gone, came))), won.append(at(np.setdiff1d(came, own)))
                yield pa.RecordBatch.from_arrays([C.column(part, "_id"), C.column(part, "_y"), *(pa.array(x, pa.binary()) for x in (feats, lost, won))], ["id", "y", "feats", "lost", "won"])

    # All tasks at once write the sample's features; the driver then reads them part by part.
    sample = C.stored(rows.mapInArrow(C.tidy(run), "id long, y int, feats binary, lost binary, won binary"), f"{folder}/features")
    got = sorted((r["id"], r["y"], bytes(r["feats"]), bytes(r["lost"]), bytes(r["won"])) for r in sample.toLocalIterator())
    C.remove(docs.sparkSession, folder)
    array = lambda b: np.frombuffer(b, np.int32)
    changes = [(i, array(x[3]), array(x[4])) for i, x in enumerate(got) if x[3] or x[4]]
    return fit_rows(kept, [array(x[2]) for x in got], np.array([x[1] for x in got], np.int64), changes, swap_penalty=swap_penalty)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) of every row."""
    C.ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in C.blocks(batch, text_col):
                z = model.logits(_words(*C.text_buffers(C.column(part, text_col))))
                yield pa.RecordBatch.from_arrays([C.column(part, id_col), pa.array(1 / (1 + np.exp(-z)))], [id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(C.tidy(run), f"`{id_col}` {kind}, score double")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Learns from the labels that aren't held out and scores every row of documents."""
    docs, labels = C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels")
    model = fit(docs.filter(~held_out()).select("doc_id", "text"), labels.filter(~held_out()).select("doc_id", "toxic"))
    return score(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
