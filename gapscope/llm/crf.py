"""Language identification by a linear-chain conditional random field over the words of a text.

Every word is labelled with one of the learned languages. Its scores are sums of learned weights
over prefixes, suffixes, inner character n-grams (of UTF-8 bytes, case folded) and, for words of the
training lexicon, over the word itself; learned transitions tie neighbouring words. Training splices
runs of words from different texts into code-switched chains and climbs the conditional likelihood,
with marginals from forward-backward. Prediction runs forward-backward over whole texts, in chains
of ``CHAIN`` words, and a text gets the language of the largest mean word marginal, its score.

The model is fitted on at most ``DOCS_PER_LANGUAGE`` labelled texts of each of at most ``LANGUAGES``
languages, chosen by hash; all rows are predicted, from their text alone. Null text, or one without
a letter, is ``und`` with score 0, and so is everything where no labelled text exists. Repeated rows
get equal predictions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, register, table
from .textops import LOWER, Words, word_slices

DOCS_PER_LANGUAGE = 150
LANGUAGES = 256
CHAIN = 64
BITS = 15
LEXICON_LEAST = 3
TRAIN_CHAIN = 32
EPOCHS = 4
RATE = 0.15


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # [hashed feature, language]
    lexicon: np.ndarray  # sorted word hashes
    lexicon_weights: np.ndarray
    transitions: np.ndarray
    first: np.ndarray


def folded(words: Words) -> Words:
    """Lower case for A-Z and for the two-byte capitals of Latin-1."""
    data = LOWER[words.data]
    high = np.zeros(len(data), dtype=bool)
    high[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    words.data = np.where(high, data + 0x20, data).astype(np.uint8)
    return words


def distinct_words(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words, an occurrence of each, and the distinct word of each word."""
    return np.unique(words.hashes(), return_index=True, return_inverse=True)


def features(words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word number, feature) pairs of the words at ``at``."""
    starts, lengths = words.starts[at], (words.ends - words.starts)[at]
    data = np.concatenate((words.data, np.zeros(8, np.uint8))).astype(np.uint64)
    number = np.arange(len(at))
    owners, codes = [], []

    def add(owner: np.ndarray, first: np.ndarray, n: int, kind: int) -> None:
        code = np.full(len(first), kind * 8 + n, dtype=np.uint64)
        for i in range(n):
            code = code * np.uint64(257) + data[first + i]
        code = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
        owners.append(owner)
        codes.append(code.astype(np.int64))

    for n in (1, 2, 3):
        ok = lengths >= n
        add(number[ok], starts[ok], n, 1)
    for n in (1, 2, 3, 4):
        ok = lengths >= n
        add(number[ok], starts[ok] + lengths[ok] - n, n, 2)
    for n in (2, 3, 4):
        room = np.maximum(lengths - n + 1, 0)
        stops = np.cumsum(room)
        inner = np.arange(stops[-1] if len(stops) else 0) - np.repeat(stops - room, room) + np.repeat(starts, room)
        add(np.repeat(number, room), inner, n, 3)
    return np.concatenate(owners), np.concatenate(codes)


def emissions(model: Model, hashes: np.ndarray, owners: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Scores [distinct word, language]."""
    n = len(hashes)
    out = np.stack([np.bincount(owners, weights=model.weights[codes, y], minlength=n) for y in range(len(model.languages))], axis=1)
    if len(model.lexicon):
        place = np.minimum(np.searchsorted(model.lexicon, hashes), len(model.lexicon) - 1)
        known = model.lexicon[place] == hashes
        out[known] += model.lexicon_weights[place[known]]
    return out


def marginals(model: Model, scores: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over chains [chain, step, language]: word marginals and pair marginals' sum."""
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    trans = np.exp(model.transitions)
    n, steps, k = e.shape
    ahead, back = np.empty_like(e), np.ones_like(e)
    a = np.exp(model.first) * e[:, 0]
    ahead[:, 0] = a / a.sum(axis=1, keepdims=True)
    for t in range(1, steps):
        a = (ahead[:, t - 1] @ trans) * e[:, t]
        ahead[:, t] = a / a.sum(axis=1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        b = (e[:, t + 1] * back[:, t + 1]) @ trans.T
        back[:, t] = np.where(mask[:, t + 1, None], b / b.sum(axis=1, keepdims=True), 1.0)
    gamma = ahead * back
    gamma /= gamma.sum(axis=2, keepdims=True)
    pairs = np.zeros((k, k))
    for t in range(steps - 1):
        xi = ahead[:, t, :, None] * trans * (e[:, t + 1] * back[:, t + 1])[:, None, :]
        xi /= xi.sum(axis=(1, 2), keepdims=True)
        pairs += xi[mask[:, t + 1]].sum(axis=0)
    return gamma, pairs


def fitted(texts: list[str], labels: list[str]) -> Model | None:
    """A model of whole labelled texts."""
    languages = sorted(set(labels))
    if not languages:
        return None
    k = len(languages)
    col = pa.array(texts, pa.large_string())
    words = next(iter(map(folded, word_slices(col, size=1 << 62))), None)
    hashes, at, inverse = distinct_words(words)
    owners, codes = features(words, at)
    count = np.bincount(inverse, minlength=len(hashes))
    lexicon_of = np.flatnonzero(count >= LEXICON_LEAST)
    model = Model(languages, np.zeros((1 << BITS, k)), hashes[lexicon_of], np.zeros((len(lexicon_of), k)), np.zeros((k, k)), np.zeros(k))
    rng = np.random.default_rng(1)
    label = np.searchsorted(languages, labels)[words.doc_of_word()]
    # runs of 4 to 24 words, shuffled: half of the neighbours in a chain come from other texts
    cuts = np.cumsum(rng.integers(4, 25, size=len(label) // 4 + 2))
    cuts = np.unique(np.concatenate(([0], cuts[cuts < len(label)], words.doc_words[:-1], [len(label)])))
    cuts = cuts[cuts <= len(label)]
    runs = np.stack((cuts[:-1], cuts[1:]), axis=1)
    if not len(label):
        return model
    squares = [np.full_like(x, 1e-2) for x in (model.weights, model.lexicon_weights, model.transitions, model.first)]
    lex_place = np.full(len(hashes), -1)
    lex_place[lexicon_of] = np.arange(len(lexicon_of))
    by_owner = np.argsort(owners, kind="stable")
    owner_start = np.searchsorted(owners[by_owner], np.arange(len(hashes) + 1))
    for _ in range(EPOCHS):
        order = rng.permutation(len(runs)) if len(runs) > 1 else np.arange(len(runs))
        flat = np.concatenate([np.arange(a, b) for a, b in runs[order]])
        pad = -len(flat) % TRAIN_CHAIN
        chains = np.concatenate((flat, np.full(pad, flat[0]))).reshape(-1, TRAIN_CHAIN)
        mask_all = (np.arange(chains.size) < len(flat)).reshape(chains.shape)
        for i in range(0, len(chains), 64):
            part, mask = chains[i : i + 64], mask_all[i : i + 64]
            used, local = np.unique(inverse[part], return_inverse=True)
            local = local.reshape(part.shape)
            sizes = owner_start[used + 1] - owner_start[used]
            stops = np.cumsum(sizes)
            pick = by_owner[np.arange(stops[-1]) + np.repeat(owner_start[used] - (stops - sizes), sizes)]
            own = np.repeat(np.arange(len(used)), sizes)
            scores = emissions(model, hashes[used], own, codes[pick])[local]
            gamma, pairs = marginals(model, scores, mask)
            truth = np.eye(k)[label[part]]
            diff = (truth - gamma) * mask[:, :, None]
            by_word = np.stack([np.bincount(local.ravel(), weights=diff[:, :, y].ravel(), minlength=len(used)) for y in range(k)], axis=1)
            g = np.stack([np.bincount(codes[pick], weights=by_word[own, y], minlength=1 << BITS) for y in range(k)], axis=1)
            lex = np.zeros_like(model.lexicon_weights)
            known = lex_place[used] >= 0
            lex[lex_place[used[known]]] = by_word[known]
            seen = np.zeros((k, k))
            ok = mask[:, 1:]
            np.add.at(seen, (label[part[:, :-1]][ok], label[part[:, 1:]][ok]), 1)
            grads = (g, lex, (seen - pairs), (truth - gamma)[:, 0].sum(axis=0))
            for square, value, grad in zip(squares, (model.weights, model.lexicon_weights, model.transitions, model.first), grads):
                grad = grad / len(part)
                square += grad * grad
                value += RATE * grad / np.sqrt(square)
    return model


def label_slice(model: Model, words: Words) -> np.ndarray:
    """Mean word marginals [document, language]."""
    counts = words.counts()
    hashes, at, inverse = distinct_words(words)
    by_word = emissions(model, hashes, *features(words, at))
    links = -(-counts // CHAIN)  # chains per document
    first = np.concatenate(([0], np.cumsum(links)))
    within = np.arange(len(inverse)) - np.repeat(words.doc_words[:-1], counts)
    chain = np.repeat(first[:-1], counts) + within // CHAIN
    scores = np.zeros((first[-1], CHAIN, len(model.languages)))
    mask = np.zeros(scores.shape[:2], dtype=bool)
    scores[chain, within % CHAIN], mask[chain, within % CHAIN] = by_word[inverse], True
    gamma = _words_only(model, scores, mask)[chain, within % CHAIN]
    total = np.concatenate((np.zeros((1, gamma.shape[1])), np.cumsum(gamma, axis=0)))
    return (total[words.doc_words[1:]] - total[words.doc_words[:-1]]) / np.maximum(counts, 1)[:, None]


def _words_only(model: Model, scores: np.ndarray, mask: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=2, keepdims=True)).transpose(1, 0, 2).copy()
    trans, back = np.exp(model.transitions), np.ones(e.shape[1:])
    ahead = np.empty_like(e)
    a = np.exp(model.first) * e[0]
    for t in range(len(e)):
        a = a if t == 0 else (ahead[t - 1] @ trans) * e[t]
        ahead[t] = a / a.sum(axis=1, keepdims=True)
    for t in range(len(e) - 2, -1, -1):
        b = (e[t + 1] * back) @ trans.T
        back = np.where(mask[:, t + 1, None], b / b.sum(axis=1, keepdims=True), 1.0)
        ahead[t] *= back
    gamma = ahead / ahead.sum(axis=2, keepdims=True)
    return gamma.transpose(1, 0, 2)


ASCII_LETTER = np.zeros(256, dtype=bool)
ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def has_letter(words: Words) -> np.ndarray:
    """Whether each document holds a letter of any script."""
    total = np.concatenate(([0], np.cumsum(ASCII_LETTER[words.data])))
    found = total[words.bounds[1:]] > total[words.bounds[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in words.data[words.bounds[i] : words.bounds[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def labelled_sample(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE, languages: int = LANGUAGES) -> DataFrame:
    """(text, lang): at most ``per_language`` texts of each of the ``languages`` most frequent languages."""
    usable = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    spread = 1 << 20
    drawn = usable.withColumn("u", F.pmod(F.xxhash64("doc_id", F.lit("crf")), F.lit(spread)))
    few = drawn.join(F.broadcast(counts), "lang").where(F.col("u") * F.col("n") < 3 * per_language * spread)
    best = Window.partitionBy("lang").orderBy("u", "doc_id", F.xxhash64("text"))
    return few.withColumn("r", F.row_number().over(best)).where(F.col("r") <= per_language).select("text", "lang", "doc_id")


def identified(docs: DataFrame, training: DataFrame) -> DataFrame:
    """``docs`` plus lang_pred and score, from a model fitted on a bounded sample of ``training``."""
    sample = labelled_sample(training).orderBy("lang", "doc_id").select("text", "lang").toPandas()
    model = fitted(sample["text"].tolist(), sample["lang"].tolist())
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    names = [*docs.columns, "lang_pred", "score"]

    def scan(batches):
        model = held.value
        for batch in batches:
            languages, scores = [], []
            for words in word_slices(batch.column(at), size=1 << 18):
                letters = has_letter(words)
                if model is None:
                    languages += ["und"] * words.docs
                    scores += [0.0] * words.docs
                    continue
                mean = label_slice(model, folded(words)) if len(words.starts) else np.zeros((words.docs, len(model.languages)))
                best = mean.argmax(axis=1)
                languages += [model.languages[b] if ok else "und" for b, ok in zip(best, letters)]
                scores += np.where(letters, np.clip(mean[np.arange(len(best)), best], 0, 1), 0.0).tolist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(languages, pa.string()), pa.array(scores, pa.float64())], names=names
            )

    schema = docs.select(*docs.columns, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    for f in schema.fields:
        f.nullable = True
    return docs.mapInArrow(scan, schema)


@register("op1_crf_language_id")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return identified(docs.select("doc_id", "text"), docs.where(fold() != 0)).select(
        "doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )
