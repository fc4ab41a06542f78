"""Toxicity by a weighted finite-state pattern grammar.

A clause is read as symbols: L a word that holds an insult's letters, V a verb of harm, M a word of intent, T target, N negation, R
reported speech, O other. Five weighted transducers rewrite them one after another and are composed into one machine before any text is
read. *Insult* writes I for L. *Threat* writes H for a V within a few words of an M; a V alone is nothing. *Negation* turns an I or H within a few words after
an N into i or h. *Reported speech* turns what follows an R into q. *Target* turns an I or H after a T of its clause into its
directed form (J, K), and writes D for a T soon after one. Each arc has a weight, and a word's weight is that of its path, the sum of its
letters' arcs.

What is scored is the clause: of the patterns that it matches the one of most weight counts, once, however many words match. A document's
features are the summed weights of each pattern's clauses, their number and the weight of the best; they go into a logistic score. An insult
without a target is a pattern of its own, the weakest of those not negated, since labels mark such clauses.

The insult transducer's arcs are learned: words, their beginnings, and four- and five-grams of letters, by the documents of each label that have them (in 2^20 hash cells, so the tables are of fixed size).
A gram joins the lexicon with its log odds if the two labels' counts differ beyond chance. Lexicon and logistic weights are
fitted on at most ``sample`` of the labelled rows; every row is scored.

Only the text is an input. A row may be learned from if crc32 of its id as text is not divisible by five.

Edge cases: a null or empty text scores as one without a match; a null id is held out; null labels are not learned from; rows
that repeat an id are scored each; a very long text is scored whole, all its clauses; with no label to learn from, or labels of one kind, the lexicon is empty and the score constant;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import store
from weftline.llm.substring import ranges

CELLS, GRAMS, HEADS, BASE = 1 << 20, (4, 5), (4, 6), 0xC2B2AE3D27D4EB4F
CLAUSE = re.compile(r"[.!?;\n]+")
WORDS = {
    "V": "kill hurt destroy die shoot stab beat burn hang murder töten umbringen schlagen sterben verbrennen tuer frapper brûler mourir crever matar golpear quemar morir".split(),
    "M": "will i'll gonna going shall should must ought deserve deserves hope werde werden sollte soll muss vais va vas doit devrait mérite voy va vas debe debería merece ojalá".split(),
    "T": "you your yours u he she they him her them his their these those tu vous toi ils elles du ihr sie dich euch usted ustedes ellos".split(),
    "N": "not no never none nobody don't isn't aren't wasn't won't ne pas jamais nicht kein keine nie nunca jamás sin".split(),
    "R": "said says called calls wrote told quoted according dit disait sagte sagt laut dijo dice según".split(),
}
CLASS = {w: c for c, ws in WORDS.items() for w in ws}
INPUT, FINAL = "LVMTNRO", "IHJKihq"
NEGATED, REPORTED, DIRECTED, THREAT = -2.0, -1.5, 1.0, 4.0

Machine = dict[tuple, dict[str, tuple[tuple, str, float]]]


def _machine(start: tuple, alphabet: str, step) -> Machine:
    """All states reachable from ``start``; step(state, symbol) gives the next state, what is written, and the arc's weight."""
    out: Machine = {}
    todo = [start]
    while todo:
        s = todo.pop()
        if s in out:
            continue
        out[s] = {a: step(s, a) for a in alphabet}
        todo += [n for n, *_ in out[s].values()]
    return out


def insult() -> Machine:
    return _machine((0,), INPUT, lambda s, a: (s, "I" if a == "L" else a, 0.0))


def threat(reach: int = 4) -> Machine:
    def step(s, a):
        left = reach if a == "M" else max(0, s[0] - 1)
        return (left,), ("H" if s[0] else "O") if a == "V" else "O" if a == "M" else a, 0.0

    return _machine((0,), "IVMTNRO", step)


def negation(reach: int = 4) -> Machine:
    def step(s, a):
        if a == "N":
            return (reach,), "O", 0.0
        hit = s[0] and a in "IH"
        return (max(0, s[0] - 1),), a.lower() if hit else a, NEGATED if hit else 0.0

    return _machine((0,), "IHTNRO", step)


def reported() -> Machine:
    def step(s, a):
        if a == "R":
            return (1,), "O", 0.0
        hit = s[0] and a in "IHih"
        return s, "q" if hit else a, REPORTED if hit else 0.0

    return _machine((0,), "IHihTRO", step)


def target(reach: int = 4) -> Machine:
    """State: whether a target was read, and for how many more words one would still be that of the last insult or threat."""

    def step(s, a):
        if a == "T":
            return (1, 0), "D" if s[1] else "O", DIRECTED if s[1] else 0.0
        if a in "IH":
            return (s[0], 0 if s[0] else reach), {"I": "J", "H": "K"}[a] if s[0] else a, DIRECTED if s[0] else 0.0
        return (s[0], max(0, s[1] - 1)), a, 0.0

    return _machine((0, 0), "IHihqTO", step)


def compose(first: Machine, second: Machine) -> Machine:
    """The machine that feeds what ``first`` writes to ``second``; weights of both arcs add up."""
    out: Machine = {}
    todo = [(next(iter(first)), next(iter(second)))]
    while todo:
        s = todo.pop()
        if s in out:
            continue
        out[s] = {}
        for a, (n, b, v) in first[s[0]].items():
            m, c, w = second[s[1]][b]
            out[s][a] = ((n, m), c, v + w)
            todo.append((n, m))
    return out


@functools.cache
def grammar() -> tuple[tuple, Machine]:
    machine = functools.reduce(compose, (insult(), threat(), negation(), reported(), target()))
    return next(iter(machine)), machine


def match(symbols: list[tuple[str, float]]) -> tuple[str, float] | None:
    """(pattern, weight) of a clause's best match; symbols with the weights of their words."""
    state, machine = grammar()
    found: list[tuple[float, str]] = []
    for a, own in symbols:
        state, written, weight = machine[state][a]
        if written == "D" and found:
            w, c = found[-1]
            found[-1] = (w + weight, {"I": "J", "H": "K"}.get(c, c))
        elif written in FINAL:
            found.append((max(0.1, own + weight), written))
    if not found:
        return None
    weight, pattern = max(found)
    return pattern, weight


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(1 << 16)])


def cells(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(start, cell) of every word, word beginning and gram of letters in a lower-case text."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    ok = _letters()[np.minimum(code, 0xFFFF)]
    run = np.concatenate(([0], np.cumsum(ok)))
    wide = code.astype(np.uint64)
    edge = np.diff(np.concatenate(([0], ok.astype(np.int8), [0])))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    at, cell = [begins], [(ranges(wide + np.uint64(1), BASE, begins, ends) >> np.uint64(11)).astype(np.int64) & (CELLS - 1)]
    for n in HEADS:
        heads = begins[ends - begins > n]
        at.append(heads)
        cell.append((ranges(wide + np.uint64(1), BASE + 2 * n, heads, heads + n) >> np.uint64(13)).astype(np.int64) & (CELLS - 1))
    for n in GRAMS:
        if len(code) < n:
            continue
        starts = np.flatnonzero(run[n:] - run[:-n] == n)
        h = np.full(len(starts), n, np.uint64)
        for k in range(n):
            h = (h ^ wide[starts + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        at.append(starts)
        cell.append((h >> np.uint64(11)).astype(np.int64) & (CELLS - 1))
    return np.concatenate(at), np.concatenate(cell)


def features(text: str | None, weights: np.ndarray) -> list[float]:
    """Per pattern the weights of the clauses that it matches best, then the number of matched clauses and the weight of the best."""
    low = (text or "").lower()
    out = [0.0] * (len(FINAL) + 2)
    at, cell = cells(low)
    w = weights[cell]
    hot = np.flatnonzero(w)
    threats = any(x in low for x in WORDS["V"])
    if not len(hot) and not threats:
        return out
    hits = sorted(zip(at[hot].tolist(), w[hot].tolist()))
    k, start = 0, 0
    for m in [*CLAUSE.finditer(low), None]:
        stop = m.start() if m else len(low)
        first = k
        while k < len(hits) and hits[k][0] < stop:
            k += 1
        clause = low[start:stop]
        if k > first or threats and any(x in clause for x in WORDS["V"]):
            symbols, j = [], first
            for word in re.finditer(r"\S+", clause):
                b = start + word.end()
                path = 0.0
                while j < k and hits[j][0] < b:
                    path += hits[j][1]
                    j += 1
                symbols.append(("L", path) if path > 0 else (CLASS.get(word.group().strip("\"'()[]{}.,:|*%$&#"), "O"), THREAT))
            found = match(symbols)
            if found:
                out[FINAL.index(found[0])] += found[1]
                out[-2] += 1
                out[-1] = max(out[-1], found[1])
        start = m.end() if m else stop
    return out


def held_out(doc: Column) -> Column:
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def lexicon(train: DataFrame, chance: float = 25.0) -> np.ndarray:
    """A weight for each cell, 0 for those that don't tell the labels apart; from (toxic, text).

    Each task adds up its own counts, so at most one row a cell and task is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, CELLS), np.int64)
        docs = [0, 0]
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                docs[y] += 1
                counts[y][np.unique(cells((text.as_py() or "").lower())[1])] += 1
        live = np.flatnonzero(counts.any(0))
        for k in range(0, len(live), 100_000):
            part = live[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[0][part]), pa.array(counts[1][part])], names=["cell", "neg", "pos"])
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([docs[0]]), pa.array([docs[1]])], names=["cell", "neg", "pos"])

    sums = train.mapInArrow(run, "cell long, neg long, pos long").groupBy("cell").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    rows = sums.where("pos >= 3 or cell < 0").toPandas()  # at most one row a cell
    whole = rows[rows.cell < 0]
    out = np.zeros(CELLS)
    if not len(whole) or not whole.pos.iloc[0] or not whole.neg.iloc[0]:
        return out
    p, n = float(whole.pos.iloc[0]), float(whole.neg.iloc[0])
    rows = rows[rows.cell >= 0]
    a, b = rows.pos.to_numpy(float), rows.neg.to_numpy(float)
    rate = p / (p + n)
    odds = np.log((a + 0.5) / (b + 0.5)) - np.log(p / n)
    g = 2 * (a * np.log(a / ((a + b) * rate)) + np.where(b > 0, b * np.log(np.maximum(b, 1e-9) / ((a + b) * (1 - rate))), 0))
    keep = (odds > 3) & (g > chance)
    out[rows.cell.to_numpy()[keep]] = odds[keep]
    return out


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 100) -> np.ndarray:
    """Logistic weights, the last the constant, by Newton's method with steps halved until the penalized loss falls."""
    x = np.column_stack((np.log1p(x), np.ones(len(x))))
    w = np.zeros(x.shape[1])
    if not len(y):
        return w
    scale = np.maximum(1e-9, np.sqrt((x**2).mean(0)))
    x = x / scale
    penalty = np.full(len(w), ridge * max(1.0, len(y) / 1000))
    penalty[-1] = 1e-6

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + (penalty * w * w).sum() / 2)

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        before, now = now, loss(w)
        if before - now < 1e-8 * max(1.0, before):
            break
    return w / scale


def score(x: list[float], w: np.ndarray) -> float:
    z = float(np.log1p(np.array(x)) @ w[:-1] + w[-1])
    return 1 / (1 + np.exp(-min(max(z, -30), 30)))


def learn(docs: DataFrame, labels: DataFrame, sample: int = 40_000) -> tuple[np.ndarray, np.ndarray]:
    """(lexicon, logistic weights) fitted on the rows that may be learned from, or on ``sample`` of them, chosen by a hash
    of their ids, where there are more. So the label table that is broadcast has a bound, and no text of another row moves."""
    marks = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long"), (F.col("toxic") != 0).cast("int").alias("toxic"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    texts = docs.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    seen = store.write_once(texts.join(F.broadcast(chosen), "doc_id").select("toxic", "text").repartition(16), "toxicity-sample")
    table = lexicon(seen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py(), table) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "x"])

    rows = seen.mapInArrow(run, "toxic int, x array<double>").toPandas()
    store.drop(seen)
    if rows.toxic.nunique() < 2:
        return table, np.zeros(len(FINAL) + 3)
    return table, fit(np.array(rows.x.tolist()), rows.toxic.to_numpy(float))


def scores(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, held_out, score, predicted, features) of every row, in one pass."""
    table, w = model
    live = np.flatnonzero(table)
    packed = live, table[live]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(CELLS)
        weights[packed[0]] = packed[1]
        for batch in batches:
            rows = [features(t.as_py(), weights) for t in batch.column(2)]
            s = [score(x, w) for x in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array([int(v >= 0.5) for v in s], pa.int32()), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "held_out", "score", "predicted", "features"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, features array<double>")
