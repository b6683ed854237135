"""Toxicity by a weighted finite-state pattern grammar (op 1).

Tokens become classes (insult, threat, target, negation, report, other) with a weight. Small
deterministic transducers each rewrite one aspect: negation lowers what follows within three tokens,
reported speech lowers the rest of the clause, a target nearby raises, a threat counts fully only
with a target. They are composed once into a single table of states by classes, which runs over
each clause that holds an insult or a threat. A text's score is a logistic function of its clause
scores.

The grammar's function words are fixed values; the insult lexicon (words and word beginnings) and the
logistic function are learned from labelled rows: at most ``sample`` rows per label, those with the
least hash. Without labels of both kinds the fixed insults and a fixed function are used.

Null and empty texts score like a text without matches. Null doc_id: never a training row, held_out
null. Several labels of a doc_id: the greatest. Extra columns of ``labels`` are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm import common as C

# Words of the grammar in English, German, French and Spanish.
INSULTS = "clown disgusting idiot loser moron pathetic scum stupid trash worthless".split()
THREATS = "attack beat burn destroy hang hurt kill punch shoot stab töten umbringen tuer frapper matar golpear".split()
TARGETS = "you your yours they them he she du dich dein ihr euch sie tu toi vous vos tú te usted ustedes".split()
NEGATIONS = "not never no neither don't isn't aren't nicht kein keine nie non jamais nunca jamás tampoco".split()
REPORTS = "said says wrote quoted quote reported claimed alleged sagte schrieb behauptete dit écrit affirmé dijo escribió afirmó".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
LETTERS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
BEGINNINGS = (3, 4, 5, 6)
ENDS = (".", "!", "?", ";", ":")


class Machine:
    """A deterministic transducer: per state and class, the next state and a factor."""

    def __init__(self, states: int, step):
        self.states = states
        self.next = np.zeros((states, 6), np.int64)
        self.factor = np.ones((states, 6))
        for s, c in product(range(states), range(6)):
            self.next[s, c], self.factor[s, c] = step(s, c)

    def compose(self, other: Machine) -> Machine:
        """Both machines side by side on one input; factors multiply."""

        def step(s, c):
            a, b = divmod(s, other.states)
            return self.next[a, c] * other.states + other.next[b, c], self.factor[a, c] * other.factor[b, c]

        return Machine(self.states * other.states, step)


def grammar() -> Machine:
    hit = (INSULT, THREAT)
    negation = Machine(4, lambda s, c: (3 if c == NEGATION else max(s - 1, 0), 0.5 if s and c in hit else 1.0))
    report = Machine(2, lambda s, c: (int(s or c == REPORT), 0.6 if s and c in hit else 1.0))
    target = Machine(6, lambda s, c: (5 if c == TARGET else max(s - 1, 0), 1.3 if s and c in hit else 1.0))
    threat = Machine(2, lambda s, c: (int(s or c == TARGET), (1.0 if s else 0.2) if c == THREAT else 1.0))
    return negation.compose(report).compose(target).compose(threat)


class Scorer:
    """Clause scores of texts under a lexicon of words and word beginnings (ending in ``*``)."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.fixed = {w: c for c, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws}
        machine = grammar()
        self.next, self.factor = machine.next.tolist(), machine.factor.tolist()
        self.known: dict[str, tuple] = {}

    def look(self, token: str) -> tuple[int, float, bool]:
        """Class, weight, and whether the token ends a clause."""
        best = (OTHER, 0.0)
        for w in LETTERS.findall(token):
            keys = [w, *(w[:n] + "*" for n in BEGINNINGS if len(w) > n)]
            weight = max(self.lexicon.get(k, 0.0) for k in keys)
            if weight > best[1]:
                best = (INSULT, weight)
            elif best[0] == OTHER and w in self.fixed:
                best = (self.fixed[w], 1.5 if self.fixed[w] == THREAT else 0.0)
        if len(self.known) > 400_000:
            self.known.clear()
        found = self.known[token] = (*best, token.endswith(ENDS))
        return found

    def __call__(self, text: str) -> tuple[float, float, float]:
        """Sum and greatest of the clause scores, and the share of clauses' tokens that matched."""
        known, look = self.known, self.look
        tokens = [known.get(t) or look(t) for t in text.lower().split()]
        at = [i for i, t in enumerate(tokens) if t[1]]
        if not at:
            return 0.0, 0.0, 0.0
        scores, seen = [], -1
        for i in at:
            if i <= seen:
                continue
            a = i
            while a > seen + 1 and not tokens[a - 1][2]:  # to the clause's first token, as report and target hold for all of it; once per clause
                a -= 1
            state, score, k = 0, 0.0, a
            while k < len(tokens):
                c, w, end = tokens[k]
                if w:
                    score += w * self.factor[state][c]
                state = self.next[state][c]
                if end:
                    break
                k += 1
            seen = k
            scores.append(score)
        return sum(scores), max(scores), len(at) / math.sqrt(len(tokens) + 10)


def features(text: str) -> set[str]:
    out = set()
    for w in set(LETTERS.findall(text.lower())):
        out.add(w)
        out.update(w[:n] + "*" for n in BEGINNINGS if len(w) > n)
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the last one is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    keep = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w


def shape(v: np.ndarray) -> np.ndarray:
    return np.column_stack([np.log1p(v[:, 0]), v[:, 1], v[:, 2]])


def learn(docs: DataFrame, labels: DataFrame, sample: int = 6000, least_support: int = 3, entries: int = 20_000):
    """Lexicon and logistic weights from labelled rows outside the held-out fold."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    kept = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic is not null and doc_id is not null")
    kept = kept.filter(fold != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    few = kept.filter("toxic = 1").orderBy("h", "doc_id").limit(sample).unionByName(kept.filter("toxic = 0").orderBy("h", "doc_id").limit(sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(few.drop("h"), "doc_id")
    rows = C.stored(rows.select("text", "toxic").dropDuplicates(["text"]), "toxic-sample")

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            pos, neg, n = Counter(), Counter(), [0, 0]
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                (pos if toxic else neg).update(features(text))
                n[1 if toxic else 0] += 1
            keys = [*(k for k in pos), ""]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array([*(pos[k] for k in keys[:-1]), n[1]], pa.int64()), pa.array([*(neg[k] for k in keys[:-1]), n[0]], pa.int64())], ["key", "pos", "neg"]
            )
            rest = [k for k in neg if k not in pos]
            yield pa.RecordBatch.from_arrays([pa.array(rest, pa.string()), pa.array([0] * len(rest), pa.int64()), pa.array([neg[k] for k in rest], pa.int64())], ["key", "pos", "neg"])

    counts = C.stored(rows.mapInArrow(count, "key string, pos long, neg long").groupBy("key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "toxic-counts")
    total = counts.filter("key = ''").first()
    lexicon = {w: 4.0 for w in INSULTS}
    if not total or not total.pos or not total.neg:
        return lexicon, np.array([1.5, 0.2, 0.0, -3.0])
    odds = F.log((F.col("pos") + 0.5) / (total.pos + 1)) - F.log((F.col("neg") + 0.5) / (total.neg + 1))
    top = counts.filter((F.col("key") != "") & (F.col("pos") >= least_support)).withColumn("w", odds).filter("w >= 2.5")
    lexicon |= {r.key: min(6.0, r.w) for r in top.orderBy((F.col("w") * F.sqrt("pos")).desc(), "key").limit(entries).collect()}
    v = rows.mapInArrow(_clauses(lexicon), "a double, b double, c double, toxic int").toPandas().to_numpy()
    return lexicon, logistic(shape(v[:, :3]), v[:, 3])


def _clauses(lexicon):
    def run(batches):
        import pyarrow as pa

        score = Scorer(lexicon)
        for batch in batches:
            v = np.array([score(t) for t in batch.column("text").to_pylist()], np.float64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(pa.array(v[:, i]) for i in range(3)), batch.column("toxic")], ["a", "b", "c", "toxic"])

    return run


def score_toxicity(docs: DataFrame, lexicon: dict[str, float], weights: np.ndarray, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` and ``score``, ``clause_sum``, ``clause_max`` for each row of ``docs`` (text, ...)."""
    kept = docs.select(*carry, F.coalesce(F.col("text"), F.lit("")).alias("_body"))

    def run(batches):
        import pyarrow as pa

        score = Scorer(lexicon)
        for batch in batches:
            values = []
            column = batch.column(len(carry))
            for lo in range(0, batch.num_rows, 1000):
                values += [score(t) for t in column.slice(lo, 1000).to_pylist()]
            v = np.array(values, np.float64).reshape(-1, 3)
            p = 1 / (1 + np.exp(-np.clip(shape(v) @ weights[:-1] + weights[-1], -30, 30)))
            own = [batch.column(i) for i in range(len(carry))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(p), pa.array(v[:, 0]), pa.array(v[:, 1])], [*carry, "score", "clause_sum", "clause_max"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{fields}, score double, clause_sum double, clause_max double")
