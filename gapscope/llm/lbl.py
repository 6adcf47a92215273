"""Log-bilinear language model: noise-contrastive training and exactly normalised scoring in numpy.

Every token belongs to a *unit*: the most frequent words and the end of a text are units of their
own, all other words share a unit by their last two bytes (so unseen words have one too). A shared
unit is parted by hash into *leaves*, whose number grows with the root of the vocabulary. The model
is P(unit | the two units before) * P(leaf | unit, the two leaves before) * P(word | leaf). The
first two factors are log-bilinear, each with vectors of its own: the context vector is a sum of
unit (leaf) vectors scaled by position, its inner products with the output vectors plus a bias are
the scores, and a softmax over all units (over the unit's leaves) normalises them. The last factor
is the word's count plus 0.5 within its leaf, with one more 0.5 for words never seen there. So the
probabilities of all words seen, of "unseen" in each leaf and of the end sum to one.

Learning: word counts are one grouped sum over all training texts; then every partition runs
noise-contrastive gradient steps over its own whole texts from the same start, and the parameters
are averaged, weighted by tokens. Scoring: counts of the ``HEAD`` most frequent words are shipped
to the tasks (a bounded table), all other words get theirs by a join.

Null text is the empty text (one token, the end). Rows are scored one by one, so repeated rows get
equal scores; a row without doc_id is scored, but is neither learned from nor held out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, register, row_keyed, table, written
from .textops import Words, word_slices

FREQUENT = 80  # words that are units of their own
BUCKETS = 47  # units shared by last bytes
UNITS = 1 + FREQUENT + BUCKETS  # unit 0 is the end of a text; a unit and UNITS itself fit in a byte
CONTEXT = 2
DIM = 16
NOISE = 32
BATCH = 1024
RATE = 0.2
HEAD = 1 << 18
ALONE = 1 + FREQUENT  # units of one word, and leaves of one word, are below
LEAF_NOISE = 8
LEAF_BATCH = 4096
SUB_SHIFT = 40
BLOCK = 4096  # parameters averaged together


def buckets(words: Words) -> np.ndarray:
    """Shared unit of each word, from its last two bytes."""
    last = words.data[words.ends - 1].astype(np.int64)
    before = np.where(words.ends - words.starts > 1, words.data[words.ends - 2], 0).astype(np.int64)
    return 1 + FREQUENT + ((last * 256 + before) * 40503 % 65536) * BUCKETS // 65536


def lookup(keys: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    """Place of each key in the sorted array, -1 where it is missing."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def unit_stream(words: Words, hashes: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units of all tokens with an end after each document, and the place of each word in it."""
    at = lookup(hashes, frequent)
    own = np.where(at >= 0, 1 + at, buckets(words))
    place = np.arange(len(own)) + words.doc_of_word()
    stream = np.zeros(len(own) + words.docs, dtype=np.uint8)
    stream[place] = own
    return stream, place


def subunits_for(types: int) -> int:
    """Leaves of each shared unit: a power of two that grows with the root of the vocabulary."""
    return 1 << max(0, int(np.ceil(np.log2(max(types, 1) ** 0.5 / 16))))


def leaf_stream(stream: np.ndarray, place: np.ndarray, hashes: np.ndarray, subunits: int) -> np.ndarray:
    """Leaves of all tokens: the unit itself where it is one word, else one of its unit's ``subunits`` by hash."""
    kind = np.uint16 if ALONE + BUCKETS * subunits < 1 << 16 else np.int32  # short integers sort faster
    leaves = stream.astype(kind)
    unit = stream[place].astype(np.int32)
    sub = ((hashes >> np.uint64(SUB_SHIFT)) & np.uint64(subunits - 1)).astype(np.int32)
    leaves[place] = np.where(unit < ALONE, unit, ALONE + (unit - ALONE) * subunits + sub)
    return leaves


def contexts(stream: np.ndarray, words: Words, none: int = UNITS) -> np.ndarray:
    """[position, token] units before each token; ``none`` stands for "before the text"."""
    first = np.repeat(words.doc_words[:-1] + np.arange(words.docs), words.counts() + 1)
    age = np.arange(len(stream)) - first
    out = np.full((CONTEXT, len(stream)), none, dtype=stream.dtype)
    for c in range(CONTEXT):
        out[c, c + 1 :] = stream[: -c - 1]
        out[c, age <= c] = none
    return out


def start_parameters(unit_counts: np.ndarray) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(7)
    share = (unit_counts + 0.5) / (unit_counts.sum() + 0.5 * UNITS)
    return {
        "inp": (rng.standard_normal((UNITS + 1, DIM)) * 0.1).astype(np.float32),
        "out": (rng.standard_normal((UNITS, DIM)) * 0.1).astype(np.float32),
        "pos": np.full((CONTEXT, DIM), 0.7, dtype=np.float32),
        "bias": np.log(share).astype(np.float32),
    }


def context_vectors(p: dict[str, np.ndarray], ctx: np.ndarray) -> np.ndarray:
    q = (p["inp"] * p["pos"][0]).take(ctx[0], axis=0)
    for c in range(1, CONTEXT):
        q += (p["inp"] * p["pos"][c]).take(ctx[c], axis=0)
    return q


def _scatter(index: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    order = np.argsort(index, kind="stable")  # a radix sort, since units are bytes
    index = index[order]
    starts = np.flatnonzero(np.concatenate(([True], index[1:] != index[:-1])))
    out = np.zeros((size, rows.shape[1]), dtype=np.float32)
    out[index[starts]] = np.add.reduceat(rows[order], starts, axis=0)
    return out


class Trainer:
    """Noise-contrastive steps with shared noise and per-parameter step sizes."""

    def __init__(self, start: dict[str, np.ndarray], noise_share: np.ndarray, seed: int):
        self.p = {k: v.copy() for k, v in start.items()}
        self.squares = {k: np.full_like(v, 1e-3) for k, v in start.items()}
        self.cumulative = np.cumsum(noise_share)
        self.log_noise = np.log(noise_share * NOISE).astype(np.float32)
        self.rng = np.random.default_rng(seed)
        self.tokens = 0

    def step(self, target: np.ndarray, ctx: np.ndarray) -> None:
        p, b = self.p, len(target)
        q = context_vectors(p, ctx)
        noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE)), UNITS - 1)
        data_score = np.einsum("ij,ij->i", q, p["out"][target]) + p["bias"][target] - self.log_noise[target]
        noise_score = q @ p["out"][noise].T + p["bias"][noise] - self.log_noise[noise]
        d = 1 / (1 + np.exp(np.clip(data_score, -30, 30)))
        e = -1 / (1 + np.exp(np.clip(-noise_score, -30, 30)))
        dq = d[:, None] * p["out"][target] + e @ p["out"][noise]
        out = _scatter(target, d[:, None] * q, UNITS)
        np.add.at(out, noise, e.T @ q)
        bias = np.bincount(target, weights=d, minlength=UNITS).astype(np.float32)
        np.add.at(bias, noise, e.sum(axis=0))
        inp, pos = np.zeros_like(p["inp"]), np.zeros_like(p["pos"])
        for c in range(CONTEXT):
            inp += (sums := _scatter(ctx[c], dq, UNITS + 1)) * p["pos"][c]
            pos[c] = np.einsum("ij,ij->j", sums, p["inp"])
        for k, g in (("inp", inp), ("out", out), ("pos", pos), ("bias", bias)):
            g /= b
            self.squares[k] += g * g
            p[k] += RATE * g / np.sqrt(self.squares[k])
        self.tokens += b


def start_leaves(leaf_counts: np.ndarray) -> dict[str, np.ndarray]:
    """Starts as the shares of the leaves in their units; ``leaf_counts`` is [shared unit, leaf]."""
    rng = np.random.default_rng(9)
    share = (leaf_counts + 0.5) / (leaf_counts + 0.5).sum(axis=1)[:, None]
    return {
        "inp": (rng.standard_normal((ALONE + share.size + 1, DIM)) * 0.1).astype(np.float32),
        "out": np.zeros((share.size, DIM), dtype=np.float32),
        "pos": np.full((CONTEXT, DIM), 0.7, dtype=np.float32),
        "bias": np.log(share).ravel().astype(np.float32),
    }


class LeafTrainer:
    """Noise-contrastive steps for the leaf of a token in its shared unit; noise is drawn within the unit."""

    def __init__(self, start: dict[str, np.ndarray], seed: int):
        self.p = {k: v.copy() for k, v in start.items()}
        self.squares = {k: np.full_like(v, 1e-3) for k, v in start.items()}
        share = np.exp(start["bias"].astype(np.float64)).reshape(BUCKETS, -1)
        self.cumulative = np.cumsum(share / share.sum(axis=1)[:, None], axis=1)
        self.log_noise = start["bias"] + np.float32(np.log(LEAF_NOISE))
        self.rng = np.random.default_rng(seed)

    def step(self, leaves: np.ndarray, ctx: np.ndarray) -> None:
        p, b, size = self.p, len(leaves), self.cumulative.shape[1]
        target = leaves - leaves.dtype.type(ALONE)
        unit = (target // size).astype(np.uint8)
        order = np.argsort(unit, kind="stable")
        target, unit, ctx = target[order], unit[order], ctx[:, order]
        draws = self.rng.random((BUCKETS, LEAF_NOISE))
        sub = np.minimum((draws[:, :, None] > self.cumulative[:, None, :]).sum(axis=2), size - 1)
        noise = sub + np.arange(BUCKETS)[:, None] * size
        q = context_vectors(p, ctx)
        out_noise, own = p["out"][noise], p["out"][target]
        data_score = np.einsum("ij,ij->i", q, own) + p["bias"][target] - self.log_noise[target]
        noise_score = (p["bias"][noise] - self.log_noise[noise])[unit]
        cuts = np.searchsorted(unit, np.arange(BUCKETS + 1))
        spans = [(u, slice(a, z)) for u, (a, z) in enumerate(zip(cuts, cuts[1:])) if z > a]
        for u, part in spans:
            noise_score[part] += q[part] @ out_noise[u].T
        d = 1 / (1 + np.exp(np.clip(data_score, -30, 30)))
        e = -1 / (1 + np.exp(np.clip(-noise_score, -30, 30)))
        dq = d[:, None] * own
        out = _scatter(target, d[:, None] * q, len(p["out"]))
        bias = np.bincount(target, weights=d, minlength=len(p["out"])).astype(np.float32)
        for u, part in spans:
            dq[part] += e[part] @ out_noise[u]
            np.add.at(out, noise[u], e[part].T @ q[part])
            np.add.at(bias, noise[u], e[part].sum(axis=0))
        inp, pos = np.zeros_like(p["inp"]), np.zeros_like(p["pos"])
        for c in range(CONTEXT):
            inp += (sums := _scatter(ctx[c], dq, len(inp))) * p["pos"][c]
            pos[c] = np.einsum("ij,ij->j", sums, p["inp"])
        for k, g in (("inp", inp), ("out", out), ("pos", pos), ("bias", bias)):
            g /= b
            self.squares[k] += g * g
            g *= RATE
            g /= np.sqrt(self.squares[k])
            p[k] += g


class Pending:
    """Collects tokens with their contexts and hands them on in batches of one size."""

    def __init__(self, step, size: int):
        self.step, self.size, self.rest = step, size, None

    def add(self, stream: np.ndarray, ctx: np.ndarray) -> None:
        if self.rest is not None:
            stream, ctx = np.concatenate((self.rest[0], stream)), np.concatenate((self.rest[1], ctx), axis=1)
        full = len(stream) // self.size * self.size
        for i in range(0, full, self.size):
            self.step(stream[i : i + self.size], ctx[:, i : i + self.size])
        self.rest = (stream[full:], ctx[:, full:])

    def end(self) -> None:
        if self.rest is not None and len(self.rest[0]):
            self.step(*self.rest)


def word_counts(training: DataFrame) -> DataFrame:
    """(token, bucket, n) over all words of the texts."""

    def scan(batches):
        for batch in batches:
            tokens, units = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for words in word_slices(batch.column(0), lower=True):
                tokens.append(words.hashes())
                units.append(buckets(words))
            found, at, n = np.unique(np.concatenate(tokens), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.view(np.int64)), pa.array(np.concatenate(units)[at].astype(np.int32)), pa.array(n)],
                names=["token", "bucket", "n"],
            )

    rows = training.select("text").mapInArrow(scan, "token long, bucket int, n long")
    return rows.groupBy("token").agg(F.min("bucket").alias("bucket"), F.sum("n").alias("n"))


def _mean(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
    """The mean of one block over all partitions, weighted by tokens."""
    part = part.sort_by([("weight", "ascending"), ("part", "ascending")])
    values = part["v"].combine_chunks().flatten().to_numpy().reshape(len(part), -1).astype(np.float64)
    mean = np.average(values, axis=0, weights=part["weight"].to_numpy())
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([mean.astype(np.float32)], pa.list_(pa.float32()))})


def trained(
    training: DataFrame, frequent: np.ndarray, unit_counts: np.ndarray, leaf_counts: np.ndarray
) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Parameters of units and of leaves after every partition has learned from its whole texts, averaged by tokens."""
    start, start_leaf = start_parameters(unit_counts), start_leaves(leaf_counts)
    noise_share = (unit_counts + 0.5) / (unit_counts.sum() + 0.5 * UNITS)
    subunits = leaf_counts.shape[1]
    none = ALONE + leaf_counts.size
    pack = training.sparkSession.sparkContext.broadcast((start, start_leaf, noise_share, frequent))

    def scan(batches):
        first, first_leaf, share, top = pack.value
        trainer, leaf_trainer = Trainer(first, share, 11), LeafTrainer(first_leaf, 12)
        units, leaves = Pending(trainer.step, BATCH), Pending(leaf_trainer.step, LEAF_BATCH)
        for batch in batches:
            for words in word_slices(batch.column(0), lower=True):
                hashes = words.hashes()
                stream, place = unit_stream(words, hashes, top)
                units.add(stream, contexts(stream, words))
                if subunits > 1:
                    leaf = leaf_stream(stream, place, hashes, subunits)
                    shared = leaf >= ALONE
                    leaves.add(leaf[shared], contexts(leaf, words, none)[:, shared])
        units.end()
        leaves.end()
        if trainer.tokens:
            flat = np.concatenate([v.ravel() for p in (trainer.p, leaf_trainer.p) for v in p.values()])
            cuts = range(0, len(flat), BLOCK)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(len(cuts)), pa.int32()),
                    pa.array([float(trainer.tokens)] * len(cuts)),
                    pa.array([zlib.crc32(flat.tobytes())] * len(cuts), pa.int64()),
                    pa.array([flat[i : i + BLOCK] for i in cuts], pa.list_(pa.float32())),
                ],
                names=["block", "weight", "part", "v"],
            )

    rows = training.select("text").mapInArrow(scan, "block int, weight double, part long, v array<float>")
    mean = rows.groupBy("block").applyInArrow(_mean, "block int, v array<float>").toPandas()
    if not len(mean):
        return start, start_leaf
    flat, at = np.concatenate(mean.sort_values("block")["v"].to_list()).astype(np.float32), 0
    result = ({}, {})
    for p, like in zip(result, (start, start_leaf)):
        for k, v in like.items():
            p[k] = flat[at : at + v.size].reshape(v.shape)
            at += v.size
    return result


def log_leaves(p: dict[str, np.ndarray], leaves: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    """Natural log of P(leaf | unit, context), normalised over the unit's leaves, for every token; 0 for units of one word."""
    result = np.zeros(len(leaves))
    size = len(p["out"]) // BUCKETS
    shared = np.flatnonzero(leaves >= ALONE)
    if size == 1 or not len(shared):
        return result
    target = leaves[shared].astype(np.int64) - ALONE
    unit = (target // size).astype(np.uint8)
    order = np.argsort(unit, kind="stable")
    shared, target = shared[order], target[order]
    cuts = np.searchsorted(unit[order], np.arange(BUCKETS + 1))
    q, ones = context_vectors(p, ctx[:, shared]), np.ones(size, dtype=np.float32)
    for u, (a, z) in enumerate(zip(cuts, cuts[1:])):
        out, bias = p["out"][u * size : (u + 1) * size].T, p["bias"][u * size : (u + 1) * size]
        for i in range(a, z, 2048):
            part = slice(i, min(i + 2048, z))
            scores = q[part] @ out
            scores += bias
            scores -= scores.max(axis=1)[:, None]
            own = scores[np.arange(len(scores)), target[part] - u * size]
            np.exp(scores, out=scores)
            result[shared[part]] = own - np.log(scores @ ones)
    return result


def log_units(p: dict[str, np.ndarray], stream: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    """Natural log of P(unit | context), normalised over all units, for every token."""
    result, ones = np.empty(len(stream)), np.ones(UNITS, dtype=np.float32)
    for i in range(0, len(stream), 2048):
        part = slice(i, i + 2048)
        scores = context_vectors(p, ctx[:, part]) @ p["out"].T
        scores += p["bias"]
        scores -= scores.max(axis=1)[:, None]
        own = scores[np.arange(len(scores)), stream[part]]
        np.exp(scores, out=scores)
        result[part] = own - np.log(scores @ ones)
    return result


def model_scores(docs: DataFrame, training: DataFrame) -> DataFrame:
    """``docs`` (unique long ``_row``, text) scored by a model of the ``text`` of ``training``."""
    spark = docs.sparkSession
    counts = written(word_counts(training), "counts")
    texts = training.count()
    totals = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n_all, types = (totals["n"] or 0) + texts, totals["v"] + (texts > 0)
    head = counts.orderBy(F.desc("n"), "token").limit(HEAD).select("token", "bucket", "n").toPandas()
    top = np.sort(head["token"].to_numpy(np.int64)[:FREQUENT].view(np.uint64))
    head = head.assign(u=head["token"].to_numpy(np.int64).view(np.uint64)).sort_values("u")
    known, known_n = head["u"].to_numpy(), head["n"].to_numpy(np.float64)
    unit_n = np.zeros(UNITS)
    at = lookup(known, top)
    unit_n[1 + at[at >= 0]] += known_n[at >= 0]
    unit_n[0] = texts
    subunits = subunits_for(types)
    leaf_n, leaf_v = np.zeros((BUCKETS, subunits)), np.zeros((BUCKETS, subunits))
    sub = F.shiftrightunsigned("token", SUB_SHIFT).bitwiseAND(F.lit(subunits - 1))
    for r in counts.groupBy("bucket", sub.alias("sub")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        leaf_n[r["bucket"] - ALONE, r["sub"]] += r["n"]
        leaf_v[r["bucket"] - ALONE, r["sub"]] += r["v"]
    taken = head[lookup(known, top) >= 0]
    own_sub = (taken["u"].to_numpy() >> np.uint64(SUB_SHIFT)) & np.uint64(subunits - 1)
    for b, k, n in zip(taken["bucket"], own_sub.astype(int), taken["n"]):
        leaf_n[b - ALONE, k] -= n
        leaf_v[b - ALONE, k] -= 1
    unit_n[ALONE:] = leaf_n.sum(axis=1)
    parameters = trained(training, top, unit_n, leaf_n)
    # an own unit holds exactly its word, so that the unseen share belongs to the leaves of the shared units
    log_mass = np.log10(np.concatenate((unit_n[:ALONE] + 0.5, (leaf_n + 0.5 * (leaf_v + 1)).ravel())))
    none = len(log_mass)
    log_end = np.log10(texts + 0.5)
    shared_pack = spark.sparkContext.broadcast((known, np.log10(known_n + 0.5), top, parameters, log_mass))

    def scan(batches):
        keys, logs, frequent, (p, p_leaf), mass = shared_pack.value
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for words in word_slices(batch.column(1), lower=True):
                hashes = words.hashes()
                stream, place = unit_stream(words, hashes, frequent)
                leaf = leaf_stream(stream, place, hashes, subunits)
                logs_all = log_units(p, stream, contexts(stream, words)) + log_leaves(p_leaf, leaf, contexts(leaf, words, none))
                ends = words.doc_words[1:] + np.arange(words.docs) + 1
                firsts = words.doc_words[:-1] + np.arange(words.docs)
                terms = np.concatenate(([0.0], np.cumsum(logs_all / np.log(10) - mass[leaf])))
                model = terms[ends] - terms[firsts]
                at = lookup(hashes, keys)
                doc = words.doc_of_word()
                seen = at >= 0
                log_sum = np.bincount(doc[seen], weights=logs[at[seen]], minlength=words.docs) + log_end
                here = np.bincount(doc[seen], minlength=words.docs)
                owner = rows[words.first : words.first + words.docs]
                rare, m = hashes[~seen].view(np.int64), int((~seen).sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate((owner, owner[doc[~seen]]))),
                        pa.array(np.concatenate((np.zeros(words.docs, np.int64), rare)), mask=np.arange(words.docs + m) < words.docs),
                        pa.array(np.concatenate((words.counts() + 1, np.zeros(m, np.int64)))),
                        pa.array(np.concatenate((here, np.zeros(m, np.int64)))),
                        pa.array(np.concatenate((log_sum, np.zeros(m)))),
                        pa.array(np.concatenate((model, np.zeros(m)))),
                    ],
                    names=["_row", "token", "n_tokens", "here", "log_sum", "model"],
                )

    schema = "_row long, token long, n_tokens long, here long, log_sum double, model double"
    parts = written(docs.select("_row", "text").mapInArrow(scan, schema), "scored")
    rare = (
        parts.where("token is not null").select("_row", "token").join(counts.select("token", "n"), "token", "left")
        .groupBy("_row")
        .agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_sum"), F.count("n").alias("rare_known"))
    )
    log_all = float(np.log10(n_all + 0.5 * (types + 1)))
    total = F.col("log_sum") + F.coalesce("rare_sum", F.lit(0.0))
    return (
        parts.where("token is null").join(rare, "_row", "left")
        .select(
            "_row", "n_tokens",
            (F.col("here") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(texts > 0))).alias("n_known"),
            F.lit(int(n_all)).cast("long").alias("train_tokens"),
            (total - F.col("n_tokens") * F.lit(log_all)).alias("base_score"),
            (total + F.col("model")).alias("score"),
        )
    )


@register("op3_log_bilinear_scores")
def op3(spark, sf_dir):
    docs = row_keyed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    docs = docs.withColumn("held_out", F.coalesce(fold() == 1, F.lit(False)))
    scores = model_scores(docs, docs.where(fold() != 1))
    return docs.select("_row", "doc_id", "held_out").join(scores, "_row").drop("_row")
