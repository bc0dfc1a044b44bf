"""Op 10: toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult stems learned from labelled rows; targets,
threats, negation and reported speech from short fixed lists), and transducers
that each add one judgement are composed into one machine, which runs over
the clauses that hold an insult or a threat. A clause's weight depends on what the machine
found in it, not on the word alone; a document's clauses give the features of a small logistic model.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitscope.llm.common import map_arrow, save, text_groups

#: Labelled rows of each class that the model is fitted on at most, and insult stems it holds at most.
SAMPLE, STEMS = 4000, 2000
#: A stem needs this share of the toxic texts, at least STEM_LEAST of them, after as many different words (12 at most), and at most CLEAN_SHARE as many clean texts.
STEM_SHARE, STEM_LEAST, CLEAN_SHARE = 0.005, 4, 0.02
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3

# Words of English, German, French and Spanish.
_TARGETS = "you your yours yourself he him his she her they them their du dich dir dein deine ihr euch sie er tu toi te ton ta vous votre il elle ils elles ti usted ustedes vosotros él ella ellos"
_THREATS = "kill hurt destroy burn shoot stab beat punch töten umbringen schlagen verbrennen erschießen tuer frapper brûler détruire battre matar golpear quemar destruir pegar"
_NEGATIONS = "not no never neither nor isn't aren't wasn't don't doesn't didn't won't nicht kein keine nie niemals pas jamais aucun nunca jamás ningún tampoco"
_REPORTS = "said says say called calls wrote writes claimed quoted according sagte sagt schrieb nannte laut dit disait écrit appelé selon dijo dice escribió llamó según"
#: Symbols: insult, target, threat, negation, report, clause end, other.
INSULT, TARGET, THREAT, NEGATION, REPORT, END, OTHER = "ITHNRBO"
_WORDS = {w: s for s, words in ((TARGET, _TARGETS), (THREAT, _THREATS), (NEGATION, _NEGATIONS), (REPORT, _REPORTS)) for w in words.split()}
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.,;:!?]")
_CLAUSE = re.compile(r"[^B]*[IH][^B]*")


class Transducer:
    """A deterministic machine: step(state, symbol) -> (state, output), tabulated over its reachable states."""

    def __init__(self, start, step, symbols: str):
        self.start, self.table = start, {}
        todo = [start]
        while todo:
            s = todo.pop()
            if s in self.table:
                continue
            self.table[s] = {x: step(s, x) for x in symbols}
            todo += [t for t, _ in self.table[s].values()]

    def compose(self, other: "Transducer") -> "Transducer":
        """The machine that hands each output of this one to `other`; its outputs are other's."""

        def step(state, symbol):
            a, mid = self.table[state[0]][symbol]
            b, out = other.table[state[1]][mid]
            return (a, b), out

        return Transducer((self.start, other.start), step, "".join(next(iter(self.table.values()))))

    def run(self, symbols: str) -> list:
        s, out = self.start, []
        for x in symbols:
            s, y = self.table[s][x]
            out.append(y)
        return out


#: Reach of a negation and of a target, in words.
SCOPE, NEAR = 3, 4


def grammar() -> Transducer:
    """Negation, reported speech, then target: each marks the insults and threats that its machine reads.

    Lower case marks a negated one (i, h); digits a reported one; the last gives a
    letter of the clause pattern: A aimed insult, I plain insult, T aimed threat, H threat, n negated, q reported, - none.
    """
    all_symbols = INSULT + TARGET + THREAT + NEGATION + REPORT + OTHER

    def negation(left, x):
        if x == NEGATION:
            return SCOPE, OTHER
        out = x.lower() if left and x in (INSULT, THREAT) else x
        return max(0, left - 1), out

    def reported(seen, x):
        if x == REPORT:
            return True, OTHER
        return seen, "q" if seen and x in "IHih" else x

    def aimed(left, x):
        if x == TARGET:
            return NEAR, "-"
        if x in "ih":
            out = "n"
        elif x == "q":
            out = "q"
        elif x == INSULT:
            out = "A" if left else "I"
        elif x == THREAT:
            out = "T" if left else "H"
        else:
            out = "-"
        return max(0, left - 1), out

    a = Transducer(0, negation, all_symbols)
    b = Transducer(False, reported, all_symbols + "ih")
    c = Transducer(0, aimed, all_symbols + "ihq")
    return a.compose(b).compose(c)


#: Weights of what the grammar finds in a clause.
WEIGHTS = {"A": 1.0, "T": 0.4, "I": 0.8, "H": 0.0, "n": 0.4, "q": 0.5, "-": 0.0}


class Scorer:
    """Features of a text: weight of its heaviest clause, of all clauses, and of all clauses per hundred words."""

    def __init__(self, stems: list[str]):
        self.words = {s for s in stems if s.endswith("$")}
        self.prefixes = {s for s in stems if not s.endswith("$")}
        self.machine = grammar()
        self.held: dict[str, str] = {}

    def symbol(self, piece: str) -> str:
        out = ""
        for w in _TOKEN.findall(piece):
            if w in ".,;:!?":
                out += END
            elif w + "$" in self.words or any(w[:n] in self.prefixes for n in PREFIXES if len(w) >= n):
                out += INSULT
            else:
                out += _WORDS.get(w, OTHER)
        return out

    def features(self, text: str | None) -> tuple[float, float, float]:
        pieces = (text or "").lower().split()
        held = self.held
        if len(held) > 200_000:
            held.clear()
        for p in set(pieces).difference(held):
            held[p] = self.symbol(p)
        symbols = "".join(map(held.__getitem__, pieces))
        if INSULT not in symbols and THREAT not in symbols:
            return 0.0, 0.0, 0.0
        clauses = [sum(WEIGHTS[x] for x in self.machine.run(c[0])) for c in _CLAUSE.finditer(symbols)]
        total = sum(clauses)
        return min(2.0, max(clauses)), float(np.log1p(total)), min(1.0, 10 * total / max(1, len(pieces)))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, str]:
    """At most SAMPLE labelled training texts of each class, chosen by a hash of the id; equal texts once.

    An id with several labels, and a text with several ids, is toxic if one label says so; null ids and labels are left out.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for y in (0, 1)]
    ids = chosen[0].unionByName(chosen[1])
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most 2 * SAMPLE rows of two numbers
    return save(texts.where("text IS NOT NULL").groupBy("text").agg(F.max("toxic").alias("toxic")), "toxicity-sample")


def learn_stems(sample: DataFrame) -> list[str]:
    """Whole words (with a $) and word beginnings that mark toxic texts.

    Copies of one toxic text would lend weight to all of its words; a stem
    must therefore follow many different words, counted by a mask of 64 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, toxic in text_groups(batches, ("text", "toxic")):
            count: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])
            for text, y in zip(texts, toxic, strict=True):
                seen = set()
                before = ""
                for w in _TOKEN.findall(text.lower()):
                    if w not in ".,;:!?":
                        bit = 1 << (zlib.crc32(before.encode()) & 63)
                        for s in (w + "$", *(w[:n] for n in PREFIXES if len(w) >= n)):
                            c = count[s]
                            if s not in seen:
                                seen.add(s)
                                c[1 if y else 0] += 1
                            if y:
                                c[2] |= bit
                    before = w
            stems = [s for s in count if count[s][1] or count[s][0]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(stems, pa.string()),
                    pa.array([count[s][0] for s in stems], pa.int64()),
                    pa.array([count[s][1] for s in stems], pa.int64()),
                    pa.array([count[s][2] - (1 << 64 if count[s][2] >> 63 else 0) for s in stems], pa.int64()),
                ],
                ["stem", "clean", "toxic", "contexts"],
            )

    counts = map_arrow(sample, run, "stem string, clean long, toxic long, contexts long")
    by = counts.groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.bit_or("contexts").alias("contexts"))
    least = max(STEM_LEAST, int(STEM_SHARE * sample.where("toxic = 1").count()))
    by = by.where((F.col("toxic") >= least) & (F.bit_count("contexts") >= min(least, 12)) & (F.col("clean") <= CLEAN_SHARE * F.col("toxic")))
    found = [r[0] for r in by.orderBy(F.desc("toxic"), "stem").limit(STEMS).collect()]  # at most STEMS strings
    beginnings = {s for s in found if not s.endswith("$")}
    covered = lambda s: any(s[:n] in beginnings for n in PREFIXES if n < len(s.rstrip("$")) or s.endswith("$") and n == len(s) - 1)
    return sorted(s for s in found if not covered(s))


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's steps; classes count alike. Bias last."""
    x = np.c_[x, np.ones(len(x))]
    if not (y == 1).any() or not (y == 0).any():
        return np.array([3.0, 1.0, 1.0, -3.0])
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    b = np.zeros(x.shape[1])
    ridge = np.diag([1.0] * (x.shape[1] - 1) + [1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ b))
        g = x.T @ (weight * (p - y)) + ridge @ b
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(h, g)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return b


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text.

    Learns from labelled rows whose crc32(id) mod 4 isn't 2, at most SAMPLE of each class
    (a hash of the id chooses them); stems, counts and scores cover whole texts. Null or empty
    text: no clause, so the score of a text without a match. Null id: not held out. Rows repeated or with
    extra columns are scored alike. No label of one class: fixed weights take the model's place. The model
    (stems, four numbers) goes to the tasks with the code; its size is bounded.
    """
    sample, _ = labelled_sample(docs, labels)
    stems = learn_stems(sample)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(stems)
        for texts, toxic in text_groups(batches, ("text", "toxic")):
            f = [scorer.features(t) for t in texts]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.float64()) for c in zip(*f, strict=True)), pa.array(toxic, pa.int64())], ["a", "b", "c", "toxic"])

    fitted_on = map_arrow(sample, features, "a double, b double, c double, toxic long").toPandas()  # at most 2 * SAMPLE rows of numbers
    weights = fit(fitted_on[["a", "b", "c"]].to_numpy(float), fitted_on["toxic"].to_numpy(int))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(stems)
        for ids, held, texts in text_groups(batches, ("doc_id", "held_out", "text")):
            x = np.array([scorer.features(t) for t in texts])
            p = 1 / (1 + np.exp(-(x @ weights[:-1] + weights[-1])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32), pa.int32())],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return map_arrow(docs.select("doc_id", held_out().alias("held_out"), "text"), run, "doc_id long, held_out boolean, score double, predicted int")
