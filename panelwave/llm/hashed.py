"""Hashed word features and the two linear models that use them (document level and sentence level)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from panelwave.llm.textvec import ALNUM, Texts, mix

BITS = 18
#: byte lengths of the word beginnings that count as features beside the whole word
PREFIXES = (4, 5, 6, 7)
_ENDS = np.array([c in b".!?\n" for c in range(256)])


@dataclass
class Bags:
    """Sentences of some texts as hashed features.

    features: feature numbers, one row for each word (whole word first, then its beginnings; -1 where too short).
    sentence: the sentence of each word, numbered over all texts. owner: the text of each sentence.
    start, end: byte range of each sentence's words in its text.
    """

    features: np.ndarray
    sentence: np.ndarray
    owner: np.ndarray
    start: np.ndarray
    end: np.ndarray
    n: int


def bags(texts: Texts, bits: int = BITS) -> Bags:
    """Words are runs of ``[0-9a-z]`` and bytes from 0x80; sentences end at ``. ! ?`` and line ends."""
    starts, ends, owner = texts.words(ALNUM)
    k = len(starts)
    features = np.full((k, 1 + len(PREFIXES)), -1, np.int32)
    if not k:
        none = np.zeros(0, np.int64)
        return Bags(features, none, none, none, none, texts.n)
    mask = np.uint64((1 << bits) - 1)
    features[:, 0] = (texts.hashes(starts, ends) & mask).astype(np.int32)
    for j, length in enumerate(PREFIXES, 1):
        long = np.flatnonzero(ends - starts > length)
        value = mix(texts.hashes(starts[long], starts[long] + length) + np.uint64(length))
        features[long, j] = (value & mask).astype(np.int32)
    passed = np.cumsum(_ENDS[texts.data])[starts]
    new = np.ones(k, bool)
    new[1:] = (passed[1:] != passed[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(new)
    tails = np.concatenate([heads[1:], [k]]) - 1
    base = texts.offsets[owner[heads]]
    return Bags(features, np.cumsum(new) - 1, owner[heads], starts[heads] - base, ends[tails] - base, texts.n)


def document_counts(b: Bags, labels: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """How many texts have each feature, and the sum of their labels."""
    size = 1 << bits
    owner = b.owner[b.sentence] if len(b.owner) else np.zeros(0, np.int64)
    every, marked = np.zeros(size), np.zeros(size)
    for j in range(b.features.shape[1]):
        used = b.features[:, j] >= 0
        pairs = np.unique(owner[used] * size + b.features[used, j])
        every += np.bincount(pairs % size, minlength=size)
        marked += np.bincount(pairs % size, weights=labels[pairs // size], minlength=size)
    return every, marked


def telling(every: np.ndarray, marked: np.ndarray, share: float, least: int = 5, deviations: float = 4.0) -> np.ndarray:
    """Features in at least so many texts whose label sum lies that many standard deviations over its expectation."""
    expected = every * share
    return (every >= least) & (marked - expected >= deviations * np.sqrt(np.maximum(expected * (1 - share), 1e-9)))


def only(b: Bags, keep: np.ndarray) -> Bags:
    """The bags with the kept features; words without any are left out, sentences stay."""
    features = np.where((b.features >= 0) & keep[b.features], b.features, -1)
    words = (features >= 0).any(axis=1)
    return Bags(features[words], b.sentence[words], b.owner, b.start, b.end, b.n)


def joined(parts: list[Bags]) -> Bags:
    texts, sentences = np.cumsum([0, *(p.n for p in parts)]), np.cumsum([0, *(len(p.owner) for p in parts)])
    return Bags(
        np.concatenate([p.features for p in parts]), np.concatenate([p.sentence + k for p, k in zip(parts, sentences)]),
        np.concatenate([p.owner + k for p, k in zip(parts, texts)]), np.concatenate([p.start for p in parts]),
        np.concatenate([p.end for p in parts]), int(texts[-1]))


def word_sums(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of the weights of each word's features."""
    padded = np.append(weights, 0.0)  # -1 reads the last place
    out = padded[features[:, 0]]
    for j in range(1, features.shape[1]):
        out = out + padded[features[:, j]]
    return out


def sentence_scores(b: Bags, weights: np.ndarray, bias: float) -> np.ndarray:
    """Probability of each sentence."""
    total = np.bincount(b.sentence, weights=word_sums(b.features, weights), minlength=len(b.owner))
    return 1.0 / (1.0 + np.exp(-np.clip(total + bias, -30, 30)))


def noisy_or(b: Bags, scores: np.ndarray) -> np.ndarray:
    """1 - product of (1 - score) over a text's sentences; 0 for a text without words."""
    if not len(b.owner):
        return np.zeros(b.n)
    return -np.expm1(np.bincount(b.owner, weights=np.log1p(-np.minimum(scores, 1 - 1e-12)), minlength=b.n))


class Adagrad:
    def __init__(self, size: int, rate: float):
        self.value, self.seen, self.rate = np.zeros(size), np.full(size, 1e-6), rate

    def step(self, gradient: np.ndarray) -> None:
        self.seen += gradient * gradient
        self.value -= self.rate * gradient / np.sqrt(self.seen)


def _batches(b: Bags, order: np.ndarray, size: int):
    """Word rows and sentences of groups of texts, in the given order of texts."""
    sentence_from = np.searchsorted(b.owner, np.arange(b.n + 1))
    word_from = np.searchsorted(b.sentence, np.arange(len(b.owner) + 1))
    for i in range(0, len(order), size):
        chosen = order[i : i + size]
        lo, hi = sentence_from[chosen], sentence_from[chosen + 1]
        sentences = np.concatenate([np.arange(x, y) for x, y in zip(lo, hi)] or [np.zeros(0, np.int64)])
        yield chosen, sentences, word_from[sentences], word_from[sentences + 1], np.repeat(np.arange(len(chosen)), hi - lo)


def train_instances(
    b: Bags, labels: np.ndarray, bits: int = BITS, epochs: int = 20, rate: float = 0.4, ridge: float = 1e-5,
    batch: int = 128, seed: int = 7,
) -> tuple[np.ndarray, float]:
    """Multiple-instance training: sentence probabilities joined by noisy-or, fitted to the labels of whole texts.

    The derivative of the log loss by a sentence's logit is s * (1 - y / p), s being the sentence's and p the text's
    probability, so a toxic text puts its weight on the sentences that explain it.
    """
    size = 1 << bits
    opt = Adagrad(size + 1, rate)
    opt.value[size] = -4.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for chosen, sentences, lo, hi, local in _batches(b, rng.permutation(b.n), batch):
            if not len(sentences):
                continue
            count = hi - lo
            words = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            rows = b.features[words]
            own = np.repeat(np.arange(len(sentences)), count)
            total = np.bincount(own, weights=word_sums(rows, opt.value[:size]), minlength=len(sentences))
            s = 1.0 / (1.0 + np.exp(-np.clip(total + opt.value[size], -30, 30)))
            p = -np.expm1(np.bincount(local, weights=np.log1p(-np.minimum(s, 1 - 1e-12)), minlength=len(chosen)))
            slope = s * (1.0 - labels[chosen][local] / np.maximum(p[local], 1e-9)) / len(chosen)
            gradient = np.zeros(size + 1)
            for j in range(rows.shape[1]):
                used = rows[:, j] >= 0
                gradient[:size] += np.bincount(rows[used, j], weights=slope[own[used]], minlength=size)
            gradient[:size] += ridge * opt.value[:size]
            gradient[size] = slope.sum()
            opt.step(gradient)
    return opt.value[:size].copy(), float(opt.value[size])


def document_means(b: Bags, weights: np.ndarray) -> np.ndarray:
    """Mean weight of a text's words; 0 for a text without words."""
    owner = b.owner[b.sentence] if len(b.owner) else np.zeros(0, np.int64)
    count = np.bincount(owner, minlength=b.n)
    return np.bincount(owner, weights=word_sums(b.features, weights), minlength=b.n) / np.maximum(count, 1)


def train_documents(
    b: Bags, extra: np.ndarray, target: np.ndarray, bits: int = BITS, epochs: int = 12, rate: float = 0.3,
    ridge: float = 1e-6, batch: int = 128, seed: int = 7,
) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression on mean hashed features and a few dense ones; targets may be probabilities.

    Returns the hashed weights and the dense ones (the last is the constant).
    """
    size, dense = 1 << bits, extra.shape[1]
    opt = Adagrad(size + dense + 1, rate)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for chosen, _, lo, hi, local in _batches(b, rng.permutation(b.n), batch):
            count = hi - lo
            words = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            rows = b.features[words] if len(words) else b.features[:0]
            own = np.repeat(local, count)
            length = np.maximum(np.bincount(own, minlength=len(chosen)), 1)
            total = np.bincount(own, weights=word_sums(rows, opt.value[:size]), minlength=len(chosen)) / length
            total = total + extra[chosen] @ opt.value[size:-1] + opt.value[-1]
            slope = (1.0 / (1.0 + np.exp(-np.clip(total, -30, 30))) - target[chosen]) / len(chosen)
            gradient = np.zeros(size + dense + 1)
            for j in range(rows.shape[1]):
                used = rows[:, j] >= 0
                gradient[:size] += np.bincount(
                    rows[used, j], weights=(slope / length)[own[used]], minlength=size)
            gradient[size:-1] = slope @ extra[chosen]
            gradient[:-1] += ridge * opt.value[:-1]
            gradient[-1] = slope.sum()
            opt.step(gradient)
    return opt.value[:size].copy(), opt.value[size:].copy()
