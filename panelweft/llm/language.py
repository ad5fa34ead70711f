"""Language identification by a mixture of n-gram language models.

Training counts hashed byte trigrams (boundaries included) of every training text by its
label.  A document is a mixture of languages: each word comes from one of them with the
likelihood of its trigrams (where a script puts no spaces between words, four characters count
as a word).  Expectation-maximisation estimates the document's language
proportions; the language set is selected among the sets of the k largest proportions by
log-likelihood penalised by `penalty` * k * log(words) / 2.  The prediction is the largest
share of the selected mixture and the score that share, smoothed for short texts.

A text is accepted unless it is `und` or speaks against the languages selected for it: each
word, by the one of them that suits it best, is held against a background in which all trigrams
are alike.

A text that is null or has no letter is `und` with score 0, as is every text where nothing
could be learned (no labelled rows).  Repeated rows and ties: languages are in sorted order
and the first of equals wins, so equal texts have equal results.  Extra columns pass through
accepted() and don't matter elsewhere; an empty table gives no rows; texts are taken whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweft.llm import common as C

BUCKETS = 1 << 14
#: Counts that a training task holds before it sends them on.
HELD = 1 << 22
#: Characters of a script without spaces that count as a word.
UNSPACED_RUN = 4
SMOOTHING = 0.5
UNKNOWN = "und"
#: Share of the background in a language when the two are compared: what one trigram never seen can count.
FOREIGN = 0.1

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
#: First bytes of characters of Thai, Lao, Burmese, Khmer, kana and Han (some only with certain second bytes).
_UNSPACED = np.zeros(256, bool)
_UNSPACED[[0xE0, 0xE1, *range(0xE3, 0xEA), 0xF0]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[~_LETTER] = 32


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bucket of the trigram that ends at each byte; what isn't a letter is a boundary, as is a text's start."""
    b = _FOLD[data].astype(np.uint32)
    one, two = np.empty_like(b), np.empty_like(b)
    one[1:], two[2:] = b[:-1], b[:-2]
    begin = offsets[:-1][offsets[:-1] < len(b)]
    one[:1], two[:2] = 32, 32
    one[begin] = two[begin] = 32
    after = begin + 1
    two[after[after < len(b)]] = 32
    h = (two << np.uint32(16) | one << np.uint32(8) | b) * np.uint32(0x9E3779B1)
    return (h >> np.uint32(32 - 14)).astype(np.int64)


class Model:
    """Log-probabilities of trigram buckets by language."""

    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        self.languages = languages
        p = counts + SMOOTHING
        self.log = np.log(p / p.sum(axis=1, keepdims=True)).astype(np.float32) if len(languages) else np.zeros((0, BUCKETS), np.float32)


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from every labelled row of docs: BUCKETS numbers for each language, however many there are."""
    C.ship(docs.sparkSession)
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    languages = sorted(r[0] for r in rows.select("lang").distinct().collect())
    code = {x: i for i, x in enumerate(languages)}
    schema = pa.schema([("lang", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches):
        dense = len(code) * BUCKETS <= HELD
        sums, held, n_held = np.zeros(len(code) * BUCKETS if dense else 0, np.int64), [], 0

        def sent(keys, n):
            return C.batch_of(schema, (keys // BUCKETS).astype(np.int32), (keys % BUCKETS).astype(np.int32), n)

        def flush():
            keys, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return sent(keys, np.bincount(back, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64))

        for batch in batches:
            for part in C.blocks(batch, "text"):
                data, offsets = C.text_buffers(C.column(part, "text"))
                grams = _trigrams(data, offsets)
                own = np.array([code[x] for x in C.column(part, "lang").to_pylist()], np.int64)
                key = (grams + np.repeat(own * BUCKETS, np.diff(offsets)))[_LETTER[data]]
                if dense:
                    sums += np.bincount(key, minlength=len(sums))
                    continue
                held.append(np.unique(key, return_counts=True))
                n_held += len(held[-1][0])
                if n_held >= HELD:
                    yield flush()
                    held, n_held = [], 0
        if held:
            yield flush()
        if dense:
            some = np.flatnonzero(sums)
            yield sent(some, sums[some])

    counts = np.zeros((len(languages), BUCKETS))
    if languages:
        for r in rows.mapInArrow(C.tidy(count), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
            counts[r["lang"], r["bucket"]] = r["n"]
    return Model(languages, counts)


def _em(lik: np.ndarray, bounds: np.ndarray, share: np.ndarray, turns: int) -> np.ndarray:
    """Proportions (documents, languages) from word likelihoods (words, languages); languages of share 0 stay out."""
    counts = np.diff(bounds)
    n = np.maximum(counts, 1)[:, None]
    open_ = np.ones(len(counts), bool)
    for _ in range(turns):
        r = lik * np.repeat(share, counts, axis=0)
        r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-30)
        new = np.add.reduceat(r, bounds[:-1], axis=0) / n
        moved = np.abs(new - share).max(axis=1, initial=0)
        share = np.where(open_[:, None], new, share)  # a text stops by itself, whatever is next to it
        open_ &= moved >= 1e-3
        if not open_.any():
            break
    return share


def _loglik(lik: np.ndarray, bounds: np.ndarray, share: np.ndarray) -> np.ndarray:
    p = np.einsum("wl,wl->w", lik, np.repeat(share, np.diff(bounds), axis=0))
    return np.add.reduceat(np.log(np.maximum(p, 1e-30)), bounds[:-1])


def _starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes are letters, and where words begin; a word doesn't run on over a text's end."""
    letter = _LETTER[data]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    begin = offsets[:-1][offsets[:-1] < len(data)]
    first[begin] = letter[begin]
    _cut_unspaced(data, begin, letter, first)
    return letter, np.flatnonzero(first)


def _cut_unspaced(data: np.ndarray, begin: np.ndarray, letter: np.ndarray, first: np.ndarray) -> None:
    """Mark word beginnings in runs of scripts that put no spaces between words: every UNSPACED_RUN characters, and where such a run ends."""
    at = np.flatnonzero(_UNSPACED[data])
    at = at[at + 2 < len(data)]
    second = data[at + 1]
    # Thai and Lao share their first byte with Indic scripts, Burmese and Khmer theirs with Hangul letters, Georgian and others.
    own = np.where(data[at] == 0xE0, (second >= 0xB8) & (second <= 0xBB), np.where(data[at] == 0xE1, (second >= 0x80) & (second <= 0x82) | (second == 0x9E) | (second == 0x9F), (data[at] != 0xF0) | (second >= 0xA0) & (second <= 0xB3)))
    at = at[own]
    if not len(at):
        return
    size = np.where(data[at] == 0xF0, 4, 3)
    joined = np.zeros(len(at), bool)
    joined[1:] = (at[1:] == at[:-1] + size[:-1]) & ~np.isin(at[1:], begin)
    start = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
    first[at[(np.arange(len(at)) - start) % UNSPACED_RUN == 0]] = True
    after = at + size
    last = np.ones(len(at), bool)
    last[:-1] = ~joined[1:]
    after = after[last & (after < len(data))]
    first[after[letter[after]]] = True


def gains(model: Model) -> np.ndarray:
    """Log-odds of trigram buckets by language against the background."""
    return np.log((1 - FOREIGN) * BUCKETS * np.exp(model.log) + FOREIGN).astype(np.float32)


def evidence(gain: np.ndarray, share: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Log-odds against the background of each text, every word by that language of the text's selected mixture which suits it best; 0 without a mixture."""
    out = np.zeros(len(offsets) - 1)
    letter, start = _starts(data, offsets) if len(data) else (None, np.zeros(0, np.int64))
    if not len(start) or not len(gain):
        return out
    grams = _trigrams(data, offsets)
    bounds = np.searchsorted(start, offsets)
    best = np.full(len(start), -np.inf, np.float32)
    for k, g in enumerate(gain):
        if not (share[:, k] > 0).any():
            continue
        own = np.repeat(share[:, k] > 0, np.diff(bounds))
        np.maximum(best, np.add.reduceat(np.where(letter, g[grams], np.float32(0)), start), out=best, where=own)
    total = np.concatenate([[0.0], np.cumsum(np.where(np.isfinite(best), best, 0), dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def mixtures(model: Model, data: np.ndarray, offsets: np.ndarray, penalty: float = 2.0, turns: int = 25) -> np.ndarray:
    """The selected language proportions of each text; all zero where a text has no word."""
    n_docs, n_lang = len(offsets) - 1, len(model.languages)
    out = np.zeros((n_docs, n_lang))
    if not len(data) or not n_lang:
        return out, np.zeros(n_docs, np.int64)
    letter, start = _starts(data, offsets)
    if not len(start):
        return out, np.zeros(n_docs, np.int64)
    stop = np.append(start[1:], len(data))
    grams = _trigrams(data, offsets)
    ll = np.empty((len(start), n_lang))
    for k in range(n_lang):
        # A boundary byte adds nothing, so a word's sum may run to the next word's start.
        total = np.concatenate([[0.0], np.cumsum(np.where(letter, model.log[k][grams], 0), dtype=np.float64)])
        ll[:, k] = total[stop] - total[start]
    top = ll.max(axis=1, keepdims=True)
    lik = np.exp(ll - top)
    bounds = np.searchsorted(start, offsets)
    has = np.flatnonzero(np.diff(bounds))
    words = np.diff(bounds)[has]
    inner = np.concatenate([[0], np.cumsum(words)])  # texts without words have none in lik
    full = _em(lik, inner, np.full((len(has), n_lang), 1 / n_lang), turns)
    order = np.argsort(-full, axis=1, kind="stable")
    # One language is the baseline; its likelihood needs no iteration.
    alone = np.zeros_like(full)
    alone[np.arange(len(has)), order[:, 0]] = 1
    best_share, cost = alone, -2 * _loglik(lik, inner, alone) + penalty * np.log(words + 1)
    bound = -2 * _loglik(lik, inner, full)
    for k in range(2, n_lang + 1):
        open_ = np.flatnonzero(bound + penalty * k * np.log(words + 1) < cost)
        if not len(open_):
            break
        rows = np.concatenate([np.arange(inner[i], inner[i + 1]) for i in open_])
        sub = np.concatenate([[0], np.cumsum(words[open_])])
        mask = np.zeros((len(open_), n_lang))
        np.put_along_axis(mask, order[open_, :k], 1 / k, axis=1)
        share = _em(lik[rows], sub, mask, turns)
        c = -2 * _loglik(lik[rows], sub, share) + penalty * k * np.log(words[open_] + 1)
        better = c < cost[open_]
        best_share[open_[better]], cost[open_[better]] = share[better], c[better]
    out[has] = best_share
    return out, np.diff(bounds)


def _block(n_lang: int) -> int:
    """Bytes of text judged at once: fewer for more languages, as every word has a likelihood of each."""
    return max((1 << 23) // max(n_lang, 4), 1 << 12)


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def _mixed(part: pa.RecordBatch, text_col: str, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and offsets of a block's texts, their selected shares and numbers of words, and which texts have a language."""
    texts = C.column(part, text_col)
    data, offsets = C.text_buffers(texts)
    share, words = mixtures(model, data, offsets)
    plain = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_LETTER[data] & (data < 128), out=plain[1:])
    sure = plain[offsets[1:]] > plain[offsets[:-1]]
    some = (words > 0) & (len(model.languages) > 0)
    known = np.array([bool(n and (s or _has_letter(texts[i].as_py()))) for i, (n, s) in enumerate(zip(some, sure, strict=True))], bool)
    return data, offsets, share, words, known


def _judged(part: pa.RecordBatch, text_col: str, model: Model) -> tuple[list[str], list[float], list[list[tuple[str, float]]]]:
    """Prediction, score and selected shares of each row."""
    _, _, share, words, known = _mixed(part, text_col, model)
    langs, scores, maps = [], [], []
    for i in range(part.num_rows):
        n, s = int(words[i]), share[i]
        if not known[i]:
            langs.append(UNKNOWN), scores.append(0.0), maps.append([])
            continue
        k = int(np.argmax(s))
        langs.append(model.languages[k])
        scores.append(float((n * s[k] + 0.25) / (n + 0.25 * len(s))))
        maps.append([(model.languages[j], float(s[j])) for j in np.flatnonzero(s)])
    return langs, scores, maps


def accepted(docs: DataFrame, model: Model, *, text_col: str = "text", odds: float = 1000.0) -> DataFrame:
    """docs, with all its columns, without the rows of no known language: `und` by predict(), or odds against the selected mixture's languages of more than `odds` to one."""
    C.ship(docs.sparkSession)

    def keep(batches):
        gain = gains(model)
        for batch in batches:
            for part in C.blocks(batch, text_col, _block(len(model.languages))):
                data, offsets, share, _, known = _mixed(part, text_col, model)
                yield part.filter(pa.array(known & (evidence(gain, share, data, offsets) >= -np.log(odds)), pa.bool_()))

    return docs.mapInArrow(C.tidy(keep), docs.schema)


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the extra columns, lang_pred, score and languages (map of the selected set's shares)."""
    C.ship(docs.sparkSession)
    held = docs.select(id_col, text_col, *[c for c in extra if c not in (id_col, text_col)])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields) + ", lang_pred string, score double, languages map<string,double>"

    def run(batches):
        for batch in batches:
            for part in C.blocks(batch, text_col, _block(len(model.languages))):
                langs, scores, maps = _judged(part, text_col, model)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs), pa.array(scores), pa.array(maps, pa.map_(pa.string(), pa.float64()))], [*part.schema.names, "lang_pred", "score", "languages"])

    return held.mapInArrow(C.tidy(run), schema)


def held_out(id_col: str = "doc_id"):
    """The split of the query contracts."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2


def op6_language(spark, sf_dir: str) -> DataFrame:
    """Learns from the rows that aren't held out and predicts every row of documents."""
    docs = C.table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()))
    return predict(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
