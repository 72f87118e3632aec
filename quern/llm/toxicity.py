"""Toxicity by weak supervision.

Many voters look at a text and say toxic, clean or nothing: lexicons in four languages, patterns, and words that a
sample of labelled training rows ties to the label. The label itself is one more voter. A generative model estimates
how often each voter says what in toxic and in clean texts, the label's accuracy among them, and the correlations
between voters beyond what the class explains, by expectation-maximisation; a linear classifier over hashed words and
votes is trained on its posterior labels, its threshold is set on a part of the sample kept from that training, and it
scores every text. Only the fit sees labels, and only of training rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import crc_mod, trim

FOLDS = 5
FIT_ROWS = 20_000
"""Most labelled training rows, about, that the fit reads (drawn by hash); every row is scored."""

FIT_CHARS = 60_000_000
"""Most characters of text, about, that the fit reads: long texts lower the share of rows drawn."""

HASH_BITS = 18
INDUCED = 256
"""Most words that the labelled sample adds as voters of their own."""

CLEAN_COST = 10
"""Toxic texts kept that a clean one lost costs."""

CALIBRATION = 5
"""One in so many rows of the sample sets the threshold instead of training."""

# Lexicons, one voter a line.
LEXICONS = {
    "insult_en": "idiot idiots moron morons stupid dumb loser losers clown clowns imbecile fool jerk",
    "contempt_en": "pathetic worthless disgusting scum trash garbage filth vermin useless ugly",
    "abuse_en": "bastard bitch asshole shit fuck fucking crap slut whore retard",
    "threat_en": "kill hurt destroy hang murder punch strangle",
    "insult_de": "idiot idioten dumm blöd trottel vollidiot depp versager arschloch dreckskerl abschaum wertlos widerlich",
    "insult_fr": "idiot idiote imbécile crétin stupide connard connasse salaud ordure minable pathétique déchet",
    "insult_es": "idiota imbécil estúpido estúpida tonto basura asqueroso inútil cabrón pendejo patético escoria",
}
PATTERNS = {
    "you_are": re.compile(r"\b(?:you|ur|you're|du|tu|ihr|vous) (?:are|r|bist|es|eres|seid|êtes)? ?(?:an?|so|such|ein|un|une|una)? ?(?:idiot|moron|loser|clown|stupid|dumb|trash|scum|pathetic|worthless|disgusting)"),
    "shut_up": re.compile(r"\b(?:shut up|go away|get lost|halt die klappe|ferme-la|cállate)\b"),
    "hate": re.compile(r"\b(?:i|we|ich|je|yo) (?:hate|hasse|déteste|odio) (?:you|your|dich|euch|toi|vous|te)\b"),
    "shouting": re.compile(r"!{3,}|\?!{2,}"),
}
CLEAN_LEXICONS = {
    "courtesy": "please thanks thank welcome sorry bitte danke gerne merci pardon bonjour gracias perdón saludos",
    "formal": "licensed license copyright warranty abstract references appendix lizenz urheberrecht licence derechos licencia",
}
WORD = re.compile(r"[^\W\d_]+")
_LEXICON = {name: frozenset(words.split()) for name, words in LEXICONS.items()}
_CLEAN = {name: frozenset(words.split()) for name, words in CLEAN_LEXICONS.items()}
FIXED = [*LEXICONS, *PATTERNS, *CLEAN_LEXICONS, "unmarked"]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashed words, and the fixed voters' votes (1: toxic, -1: clean, 0: abstains)."""
    low = (text or "").lower()
    words = set(WORD.findall(low))
    mask = (1 << HASH_BITS) - 1
    hashed = np.unique(np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) & mask for w in words), np.int32, len(words)))
    bad = [not lexicon.isdisjoint(words) for lexicon in _LEXICON.values()] + [bool(p.search(low)) for p in PATTERNS.values()]
    good = [not lexicon.isdisjoint(words) for lexicon in _CLEAN.values()] + [not any(bad)]
    return hashed, np.array([*bad, *(-int(g) for g in good)], np.int8)


@dataclass
class LabelModel:
    """Voters that say toxic, clean or nothing, independent given the class but for a discount on voters that agree."""

    prior: float
    rates: np.ndarray  # (2 classes, 3 votes: clean, none, toxic; voters)
    discount: np.ndarray  # (voters,): share of a voter's evidence that correlated voters don't repeat

    @classmethod
    def fit(cls, votes: np.ndarray, rounds: int = 25) -> LabelModel:
        """From the votes alone. It starts from the last voter (the label) and then estimates that one as all others;
        the correlations are taken from the start's classes, where no class has yet swallowed a group of voters."""
        n, m = votes.shape
        v = votes.astype(np.float64)
        says = [votes == k for k in (-1, 0, 1)]
        usual = np.stack([s.mean(axis=0) for s in says])
        post = np.where(votes[:, -1] > 0, 0.9, 0.1)
        discount = np.ones(m)
        for step in range(rounds):
            share = np.stack([1 - post, post])
            total = share.sum(axis=1)
            rates = np.stack([np.stack([share[y] @ s for s in says]) + 0.5 * usual for y in (0, 1)]) / (total[:, None, None] + 0.5)
            rates = np.maximum(rates, 1e-4)
            rates /= rates.sum(axis=1, keepdims=True)
            prior = float(np.clip(total[1] / n, 1e-3, 1 - 1e-3))
            if not step:
                cover = 0.0  # covariance given the class: how far two voters agree beyond it
                for y in (0, 1):
                    centred = (v - (rates[y, 2] - rates[y, 0])) * np.sqrt(share[y])[:, None]
                    cover = cover + centred.T @ centred
                spread = np.sqrt(np.maximum(np.diag(cover), 1e-9))
                corr = np.clip(cover / spread[:, None] / spread[None, :], 0, 1)
                corr[:, -1] = corr[-1, :] = 0
                discount = 1 / np.maximum(corr.sum(axis=1), 1.0)
            model = cls(prior, rates, discount)
            post = model.posterior(votes)
        return model

    def posterior(self, votes: np.ndarray, without: int | None = None) -> np.ndarray:
        """Chance of toxic for each row; without leaves one voter's evidence out."""
        tell = np.log(self.rates[1] / self.rates[0]) * self.discount
        if without is not None:
            tell[:, without] = 0.0
        odds = np.log(self.prior / (1 - self.prior)) + sum((votes == k) @ tell[k + 1] for k in (-1, 0, 1))
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    def accuracy(self, voter: int) -> tuple[float, float]:
        """How often the voter is right when it votes: on clean and on toxic texts."""
        r = self.rates[:, :, voter]
        return float(r[0, 0] / (r[0, 0] + r[0, 2])), float(r[1, 2] / (r[1, 0] + r[1, 2]))


@dataclass
class Classifier:
    """A linear score: hashed words (their sum over the root of their number), induced words and fixed votes."""

    words: np.ndarray
    induced: np.ndarray
    votes: np.ndarray
    bias: float
    label_accuracy: tuple[float, float] = (0.0, 0.0)

    def score(self, hashed: np.ndarray, votes: np.ndarray) -> float:
        odds = self.bias + float(self.words[hashed].sum()) / max(1.0, len(hashed)) ** 0.5 + float(self.induced[hashed].sum()) + float(votes @ self.votes)
        return float(1 / (1 + np.exp(-min(50.0, max(-50.0, odds)))))


def induce(rows: list[np.ndarray], labels: np.ndarray, most: int = INDUCED) -> np.ndarray:
    """Hashed words whose smoothed odds of a toxic label are at least eight times the usual, in five texts or more."""
    size = 1 << HASH_BITS
    both = [np.bincount(np.concatenate([r for r, y in zip(rows, labels) if y == k] or [np.array([], np.int32)]), minlength=size) for k in (0, 1)]
    n = [max(1, int((labels == k).sum())) for k in (0, 1)]
    lift = np.log((both[1] + 0.5) / (n[1] + 1)) - np.log((both[0] + 0.5) / (n[0] + 1))
    fit = np.flatnonzero((both[1] >= 5) & (lift >= np.log(8)))
    return fit[np.argsort(-both[1][fit] * lift[fit], kind="stable")][:most]


def cast_votes(rows: list[np.ndarray], fixed: np.ndarray, labels: np.ndarray, induced: np.ndarray) -> np.ndarray:
    """All votes of the sample: the fixed voters', the induced words', and last the label's."""
    place = np.full(1 << HASH_BITS, -1)
    place[induced] = np.arange(len(induced))
    votes = np.zeros((len(rows), len(FIXED) + len(induced) + 1), np.int8)
    votes[:, : len(FIXED)] = fixed
    for i, r in enumerate(rows):
        k = place[r]
        votes[i, len(FIXED) + k[k >= 0]] = 1
    votes[:, -1] = np.where(labels == 1, 1, -1)
    return votes


def threshold(odds: np.ndarray, labels: np.ndarray) -> float:
    """The odds that split the labels with the fewest errors, each label's errors weighed by its rarity and those on clean
    texts CLEAN_COST times: the middle of the best gap."""
    order = np.argsort(odds, kind="stable")
    y = labels[order] == 1
    if not y.any() or y.all():
        return 0.0
    missed = np.r_[0, np.cumsum(y)] / y.sum()
    alarms = np.r_[(~y).sum(), (~y).sum() - np.cumsum(~y)] / (~y).sum()
    loss = missed + alarms * CLEAN_COST
    best = np.flatnonzero(loss <= loss.min() + 1e-12)
    edge = np.r_[odds[order][0] - 2, odds[order], odds[order][-1] + 2]
    return float((edge[best[0]] + edge[best[-1] + 1]) / 2)


def train(rows: list[np.ndarray], fixed: np.ndarray, labels: np.ndarray, rounds: int = 150, label_votes: bool = True) -> Classifier:
    """From hashed words, fixed votes and labels of the sample. Without rows of both labels every text scores low.

    label_votes: the label's own vote enters the posterior that the classifier learns; without it the label only chooses the
    induced words, starts the label model and sets the threshold.
    """
    size = 1 << HASH_BITS
    if not len(rows) or len(set(labels.tolist())) < 2:
        return Classifier(np.zeros(size, np.float32), np.zeros(size, np.float32), np.zeros(len(FIXED)), -3.0)
    induced = induce(rows, labels)
    votes = cast_votes(rows, fixed, labels, induced)
    model = LabelModel.fit(votes)
    goal = model.posterior(votes, None if label_votes else votes.shape[1] - 1)
    lengths = np.array([len(r) for r in rows])
    flat = np.concatenate(rows) if lengths.sum() else np.array([], np.int32)
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), lengths)
    known = (np.bincount(flat, minlength=size) >= 3)[flat]  # rarer words carry no weight
    owner = owner[known]
    flat = flat[known]
    scale = 1 / np.sqrt(np.maximum(1, lengths))
    x = votes[:, :-1].astype(np.float64)
    on = (np.arange(len(rows)) % CALIBRATION != 0).astype(np.float64)
    mean = float(np.clip(np.average(goal, weights=on if on.any() else None), 1e-3, 1 - 1e-3))
    weight, vote, bias = np.zeros(size), np.zeros(x.shape[1]), float(np.log(mean / (1 - mean)))
    momentum = [np.zeros_like(weight), np.zeros_like(vote), 0.0]
    odds_of = lambda: bias + np.bincount(owner, weight[flat], len(rows)) * scale + x @ vote
    for _ in range(rounds):
        gap = (1 / (1 + np.exp(-np.clip(odds_of(), -50, 50))) - goal) * on / max(1.0, on.sum())
        slope = (np.bincount(flat, (gap * scale)[owner], size) + 1e-3 * weight, x.T @ gap + 1e-4 * vote, gap.sum())
        momentum = [0.9 * m + g for m, g in zip(momentum, slope)]
        weight -= 2.0 * momentum[0]
        vote -= 2.0 * momentum[1]
        bias -= 2.0 * momentum[2]
    odds = odds_of()
    apart = on == 0
    bias -= threshold(odds[apart], labels[apart])
    extra = np.zeros(size, np.float32)
    extra[induced] = vote[len(FIXED) :]
    return Classifier(weight.astype(np.float32), extra, vote[: len(FIXED)], bias, model.accuracy(votes.shape[1] - 1))


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS, chars: int = FIT_CHARS, label_votes: bool = True) -> Classifier:
    """The classifier from labelled training rows: crc32(doc_id) modulo FOLDS is not 0, label 0 or 1.

    A doc_id with several labels counts with its largest. About most rows and about chars characters at most are
    read, drawn by hash (a row brings 2**HASH_BITS distinct words at most). Texts that tie are trained on each.
    label_votes as in train.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & (crc_mod(F.col("doc_id"), FOLDS) != 0)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    n = known.count()
    size = texts.agg(F.count("doc_id").alias("rows"), F.sum(F.length("text").cast("double")).alias("chars")).first()
    rate = min(1.0, most / max(1, n), chars / max(1.0, (size["chars"] or 0.0) / max(1, size["rows"]) * n))
    if rate < 1:
        known = known.where(F.pmod(F.crc32(F.concat(F.lit("fit:"), F.col("doc_id").cast("string")).cast("binary")), F.lit(1 << 20)) < int((1 << 20) * rate))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([h for h, _ in got], pa.list_(pa.int32())), pa.array([v.tolist() for _, v in got], pa.list_(pa.int8()))], ["doc_id", "toxic", "words", "votes"])

    rows = texts.join(known, "doc_id").select("doc_id", F.col("toxic").cast("int"), "text")
    got = rows.mapInArrow(run, "doc_id long, toxic int, words array<int>, votes array<tinyint>").toArrow()
    words = [np.array(w, np.int32) for w in (x.values.to_numpy() if x.is_valid else [] for x in got["words"])]
    fixed = np.array(got["votes"].to_pylist(), np.int8).reshape(len(words), len(FIXED))
    toxic = got["toxic"].to_numpy().astype(int)
    ids = got["doc_id"].to_pylist()
    del got
    order = sorted(range(len(words)), key=lambda i: (ids[i], words[i].tobytes()))  # the same model whatever the order of arrival
    return train([words[i] for i in order], fixed[order], toxic[order], label_votes=label_votes)


def score(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """(doc_id, held_out, score, predicted): a row for each row of docs.

    A null text counts as empty; a null doc_id is not held out. Repeated rows are kept; other columns, language
    and source among them, are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [classifier.score(*features(t.as_py())) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(crc_mod(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long"), held, F.col("text").cast("string")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def reject(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """docs without the rows that the classifier predicts toxic; all columns as they are.

    A null text counts as empty; rows without a doc_id and rows that repeat are judged like any other.
    """
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([classifier.score(*features(t.as_py())) < 0.5 for t in b.column(at)], pa.bool_()))
        trim()

    return docs.mapInArrow(run, schema)
