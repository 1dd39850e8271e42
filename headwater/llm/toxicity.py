"""Toxicity by weak supervision.

Voters look for lexicon words and patterns and say toxic, clean or nothing. A generative label model (one hidden class, each
voter's chances given the class, by expectation maximisation) estimates their accuracies from the counts of vote patterns over
all documents; correlations of voters given the class reduce the weight of voters that repeat each other. A linear classifier
is trained on the model's posterior labels, and scores every document.

One lexicon is fixed, the others are mined: words and word beginnings that a bounded sample of labelled rows shows in toxic
documents alone or nearly so. Copies of a document count once there, by the least hash of their words.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

#: Words of abuse.
LEXICON = (
    "clown", "disgusting", "dumb", "filth", "filthy", "garbage", "idiot", "idiotic", "imbecile", "jerk", "loser", "moron",
    "moronic", "pathetic", "scum", "scumbag", "stupid", "trash", "vermin", "worthless",
)
#: Labelled rows that mining, the label model's anchor and the classifier see, at most; those with the least hash of the id.
SAMPLE_ROWS = 50_000
PREFIXES = (4, 5, 6)
#: A mined feature stands in so many toxic documents, and the log odds less Z standard errors reach the least.
MIN_SUPPORT, MIN_SHARE, MIN_LOG_ODDS, Z = 3, 0.004, 2.2, 1.9
FOLDS, HELD_OUT = 5, 0
ABSTAIN, TOXIC, CLEAN = 0, 1, 2
WORD_SHARDS, PREFIX_SHARDS = 3, 2
VOTERS = 3 + WORD_SHARDS + PREFIX_SHARDS
N_VALUES = 9


def fold(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % FOLDS, F.lit(1))


def parts(word: bytes) -> list[bytes]:
    """Feature names: the word, and beginnings of it that are shorter. Beginnings end in an asterisk, which no word holds."""
    text = word.decode("utf-8", "ignore")
    return [word, *(text[:k].encode() + b"*" for k in PREFIXES if len(text) > k)]


def sample_labels(labels: DataFrame, id_col: str, label_col: str, bound: int = SAMPLE_ROWS) -> dict:
    """Labels of the training folds, a bounded number; an id labelled twice has its largest label."""
    rows = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).filter("id is not null and y is not null").filter(fold(F.col("id")) != HELD_OUT)
    return {r[0]: int(r[1] > 0) for r in rows.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(bound).collect()}


def mine(docs: DataFrame, sample: dict) -> dict[bytes, float]:
    """Features and their log odds. docs: (id, text). What executors send is summed by feature first; what reaches the driver are features that a share of the sample's toxic documents hold, so at most the words of that many documents over the share."""
    if not any(sample.values()):
        return {}
    spark = docs.sparkSession
    ids = c.batch_of(pa.schema([("id", docs_type(docs)), ("y", pa.int32())]), [list(sample), list(sample.values())])
    held = F.broadcast(spark.createDataFrame(pa.Table.from_batches([ids]).to_pandas(), schema=f"id {docs.schema['id'].dataType.simpleString()}, y int"))  # at most SAMPLE_ROWS rows of two numbers
    labelled = docs.join(held, "id").select("y", "text")

    def seen(only: int, wanted: frozenset | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                names, groups = [], []
                n: Counter = Counter()
                for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if y != only:
                        continue
                    ws = set(c.words(text))
                    if wanted is None:
                        group = min(map(xxhash.xxh64_intdigest, ws), default=0) >> 1
                        own = {f for w in ws for f in parts(w)}
                        names += own
                        groups += [group] * len(own)
                        names.append(b"")
                        groups.append(group)
                    else:
                        n.update({f for w in ws for f in parts(w) if f in wanted})
                        n[b""] += 1
                if wanted is not None:
                    names, groups = list(n), list(n.values())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(groups, pa.int64())], names=["f", "n"])

        return c.map_arrow(labelled, run, "f binary, n long")

    found = seen(1, None).distinct().groupBy("f").count()
    total = (found.filter(F.length("f") == 0).first() or [b"", 0])[1]
    least = max(MIN_SUPPORT, int(MIN_SHARE * total))
    common_ones = found.filter((F.col("count") >= least) & (F.length("f") > 0))
    positive = {bytes(r[0]): r[1] for r in common_ones.collect()}
    if not positive:
        return {}
    negative = {bytes(r[0]): r[1] for r in seen(0, frozenset(positive)).groupBy("f").agg(F.sum("n")).collect()}
    clean = negative.get(b"", 0)
    odds = {f: float(np.log((k + 0.5) / (total + 1)) - np.log((negative.get(f, 0) + 0.5) / (clean + 1))) for f, k in positive.items()}
    sure = {f: v - Z * (1 / (positive[f] + 0.5) + 1 / (negative.get(f, 0) + 0.5)) ** 0.5 for f, v in odds.items()}
    return {f: odds[f] for f, v in sure.items() if v >= MIN_LOG_ODDS}


def docs_type(docs: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema["id"].dataType)


def values_of(text: str | None, hand: frozenset, words: dict[bytes, float], prefixes: dict[bytes, float], cache: dict) -> tuple[list[float], list[int]]:
    """(what the classifier sees, the votes) of a text."""
    ws = c.words(text)
    hits = [(w, h) for w in ws if (h := cache.get(w) if w in cache else look_up(w, hand, words, prefixes, cache))]
    n = max(1, len(ws))
    by_hand = [w for w, h in hits if h[0]]
    by_word = [w for w, h in hits if h[1]]
    by_prefix = [w for w, h in hits if h[2]]
    distinct = {w: h for w, h in hits}
    share = 100 * len(hits) / n
    evidence = sum(max(h[3], 2.0 * h[0]) for h in distinct.values())
    values = [min(10, 100 * len(by_hand) / n), min(10, 100 * len(by_word) / n), min(10, 100 * len(by_prefix) / n), np.log1p(len(set(by_hand))), np.log1p(len(set(by_word))), np.log1p(len(set(by_prefix))), float(bool(hits)), min(10, share), np.log1p(min(evidence, 1e6))]
    votes = [TOXIC if by_hand else ABSTAIN]
    votes += [TOXIC if any(h[1] and zlib.crc32(w) % WORD_SHARDS == k for w, h in distinct.items()) else ABSTAIN for k in range(WORD_SHARDS)]
    votes += [TOXIC if sum(bool(h[2]) and zlib.crc32(h[2]) % PREFIX_SHARDS == k for _, h in hits) > 1 else ABSTAIN for k in range(PREFIX_SHARDS)]
    votes += [TOXIC if share >= 1.5 else CLEAN if share < 0.3 else ABSTAIN, TOXIC if len(hits) > 1 else CLEAN if not hits else ABSTAIN]
    return values, votes


def look_up(w: bytes, hand: frozenset, words: dict, prefixes: dict, cache: dict):
    """(in the fixed lexicon, in the mined one, the mined beginning, log odds) or None."""
    first = next((p for p in parts(w)[1:] if p in prefixes), None) if prefixes else None
    found = (w in hand, w in words, first, max(words.get(w, 0.0), prefixes.get(first, 0.0) if first else 0.0))
    found = found if any(found[:3]) else None
    if len(cache) > 400_000:
        cache.clear()
    cache[w] = found
    return found


def featured(docs: DataFrame, odds: dict[bytes, float]) -> DataFrame:
    """(id, code, x): votes as a number in base 3, and the classifier's values."""
    hand = frozenset(x.encode() for x in LEXICON)
    words = {f: v for f, v in odds.items() if not f.endswith(b"*")}
    prefixes = {f: v for f, v in odds.items() if f.endswith(b"*")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for b in batches:
            codes, xs = [], []
            for text in b.column(1).to_pylist():
                x, votes = values_of(text, hand, words, prefixes, cache)
                codes.append(sum(v * 3**i for i, v in enumerate(votes)))
                xs.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.int32()), pa.array(xs, pa.list_(pa.float64()))], names=["id", "code", "x"])

    return c.map_arrow(docs.select("id", "text"), run, f"id {docs.schema['id'].dataType.simpleString()}, code int, x array<double>")


def votes_of(codes: np.ndarray) -> np.ndarray:
    return (codes[:, None] // 3 ** np.arange(VOTERS)) % 3


def label_model(codes: np.ndarray, counts: np.ndarray, known: np.ndarray, rounds: int = 100) -> dict:
    """Chances of each vote given the class, the class's share, and each voter's weight.

    known: (patterns, 2) counts of labelled rows by label; they hold the classes in place, the rest is unsupervised.
    """
    votes = votes_of(codes)
    free = np.maximum(counts - known.sum(1), 0).astype(float)
    toxic, clean = (votes == TOXIC).sum(1), (votes == CLEAN).sum(1)
    q = np.clip(0.5 + 0.2 * (toxic - clean), 0.02, 0.98)
    weight = np.ones(VOTERS)
    for k in range(rounds):
        mass = np.stack([free * (1 - q) + known[:, 0], free * q + known[:, 1]])
        chance = np.stack([[(mass[y] @ (votes == v)) for v in range(3)] for y in range(2)]) + 0.5
        chance /= chance.sum(1, keepdims=True)
        prior = (mass.sum(1) + 1) / (mass.sum() + 2)
        if k in (5, 20):
            weight = voter_weights(votes, mass)
        new = posterior(votes, {"chance": chance, "prior": prior, "weight": weight})
        if k > 25 and np.abs(new - q).max() < 1e-6:
            break
        q = new
    return {"chance": chance, "prior": prior, "weight": weight}


def voter_weights(votes: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """1 over the sum of a voter's squared correlations with all voters, given the class: two voters that always agree count as one."""
    signed = np.where(votes == TOXIC, 1.0, np.where(votes == CLEAN, -1.0, 0.0))
    total = np.zeros((VOTERS, VOTERS))
    for y in range(2):
        m = mass[y] / max(mass[y].sum(), 1e-9)
        d = signed - m @ signed
        cov = (d * m[:, None]).T @ d
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        total += mass[y].sum() / max(mass.sum(), 1e-9) * (cov / np.outer(sd, sd)) ** 2
    np.fill_diagonal(total, 1.0)
    return 1 / total.sum(1)


def posterior(votes: np.ndarray, model: dict) -> np.ndarray:
    log = np.log(model["chance"])
    score = sum(model["weight"][j] * (log[1, votes[:, j], j] - log[0, votes[:, j], j]) for j in range(VOTERS)) + np.log(model["prior"][1] / model["prior"][0])
    return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def train_linear(x: np.ndarray, q: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Logistic regression on soft labels, by Newton steps; the last coefficient is the intercept."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    total = max(weight.sum(), 1e-9)
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (p - q)) / total + keep * w
        h = (a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a / total + np.diag(keep)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    return w


def fit(own: DataFrame, labels: DataFrame, id_col: str, label_col: str, sample_rows: int) -> tuple[dict, np.ndarray, DataFrame]:
    """(mined features, coefficients, the table of what voters and classifier saw). own: (id, text)."""
    sample = sample_labels(labels, id_col, label_col, sample_rows)
    odds = mine(own, sample)
    seen = c.written(featured(own, odds), "toxicity")
    patterns = {r[0]: r[1] for r in seen.groupBy("code").count().collect()}  # at most 3 to the power of VOTERS rows
    train = None
    if sample:
        ids = own.sparkSession.createDataFrame(list(sample.items()), f"id {own.schema['id'].dataType.simpleString()}, y int")
        train = seen.join(F.broadcast(ids), "id").groupBy("id").agg(F.max("code").alias("code"), F.max("x").alias("x"), F.max("y").alias("y")).toPandas()  # at most SAMPLE_ROWS rows
    codes = np.array(sorted(patterns), dtype=np.int64)
    if not len(codes):
        return odds, np.zeros(N_VALUES + 1), seen
    counts = np.array([patterns[k] for k in codes.tolist()], dtype=float)
    known = np.zeros((len(codes), 2))
    if train is not None and len(train):
        np.add.at(known, (np.searchsorted(codes, train.code.to_numpy()), train.y.to_numpy()), 1)
        size = np.ones(len(train))
    else:  # one row for each pattern stands for all of them
        train = seen.groupBy("code").agg(F.max("x").alias("x")).toPandas()
        size = np.array([patterns[k] for k in train.code.tolist()], dtype=float)
    x, code = np.array(train.x.tolist()), train.code.to_numpy(dtype=np.int64)
    return odds, train_linear(x, posterior(votes_of(code), label_model(codes, counts, known)), size), seen


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per input row: id, held_out, score, predicted.

    Null texts count as empty and score low like them; a null id counts as fold 1. Without usable labels only the fixed
    lexicon votes. Repeated rows give repeated results; other columns are not read; an empty table gives no rows. All vote
    patterns are counted over all documents; mining and the classifier see at most sample_rows labelled rows.
    """
    own = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    _, w, seen = fit(own, labels, id_col, label_col, sample_rows)
    linear = sum((F.lit(float(v)) * F.col("x")[i] for i, v in enumerate(w[:-1])), F.lit(float(w[-1])))
    score = 1 / (1 + F.exp(-linear))
    return seen.select(F.col("id").alias(id_col), (fold(F.col("id")) == HELD_OUT).alias("held_out"), score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs, with all their columns, that score below a half. Rows are filtered where they are read; none moves."""
    odds, w, _ = fit(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), labels, id_col, label_col, sample_rows)
    hand = frozenset(x.encode() for x in LEXICON)
    words = {f: v for f, v in odds.items() if not f.endswith(b"*")}
    prefixes = {f: v for f, v in odds.items() if f.endswith(b"*")}
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for b in batches:
            keep = [bool(np.dot(values_of(t, hand, words, prefixes, cache)[0], w[:-1]) + w[-1] < 0) for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return c.map_arrow(docs, run, docs.schema)
