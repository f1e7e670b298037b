"""Sequential decoding of long histories by many tasks.

A history is cut into chunks of CHUNK grid places, one row each. Rows inside a chunk are folded in one
task; what a chunk does to the state it is entered with is summarised in a small table (forward filter)
or matrix (Viterbi), and the summaries of a key, one row for each chunk, are composed in order. With
the state at its entry known, every chunk is then decoded on its own. The results are those of one fold
over the whole history. A gap in the grid begins afresh, inside a chunk as between chunks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .runs import GRID_MIN, MAX_RUN, STAY_MAX, STAY_MIN, UNIFORM_MIX

CHUNK = 1_024


# --- one step of the forward filter -----------------------------------------------------------------------


class Model:
    """Transition rows by part of day and hazards by run length, from the JSON texts of one person."""

    def __init__(self, moves: str | None, ends: str | None):
        self.move: dict[str, dict[str, dict[str, float]]] = {}
        self.end: dict[tuple[str, int], float] = {}
        for r in json.loads(moves) if isinstance(moves, str) else []:
            self.move.setdefault(r["part"], {}).setdefault(r["a"], {})[r["b"]] = r["p"]
        for r in json.loads(ends) if isinstance(ends, str) else []:
            self.end[r["state"], r["d"]] = r["hazard"]

    def prior(self, part: str, prev: str, run: int) -> dict[str, float] | None:
        """Transition row of a state whose stay decays with the length of its run."""
        row = self.move.get(part, self.move.get("all", {})).get(prev)
        if row is None:
            return None
        hazard, off = self.end.get((prev, min(run, MAX_RUN))), sum(p for b, p in row.items() if b != prev)
        if hazard is None or off <= 0:
            return row
        stay = min(max(1 - hazard, STAY_MIN), STAY_MAX)
        return {b: stay if b == prev else (1 - stay) * p / off for b, p in row.items()}


def weigh(probs: dict[str, float], factor) -> dict[str, float]:
    moved = {c: factor(c, p) for c, p in probs.items()}
    total = sum(moved.values())
    return {c: p / total for c, p in moved.items()} if total > 0 else probs


def marked(probs: dict[str, float], prev: str, marker: dict, boost: float = 6.0, damp: float = 0.3) -> dict[str, float]:
    """A marker that fired lifts the state it announces and lowers the one it leaves."""
    s, to = max(0.0, min(1.0, marker["strength"])), marker["to_state"]
    if marker.get("from_state") not in (None, prev) or to not in probs or s <= 0:
        return probs
    return weigh(probs, lambda c, p: p * (1 + (boost - 1) * s) + 1e-6 if c == to else p * (1 - (1 - damp) * s) if c == prev else p)


def advance(model: Model, held: tuple[str, int] | None, part: str, gate: str | None, probs: dict[str, float] | None, fired: list[dict]):
    """(state, confidence, probabilities, run) of a window that follows a window in (state, run), or none."""
    if gate is not None:
        state, confidence, probs = gate, 1.0, {gate: 1.0}
    else:
        if held is not None:
            row, n = model.prior(part, *held), len(probs)
            if row is not None:
                probs = weigh(probs, lambda c, p: p * ((1 - UNIFORM_MIX) * row.get(c, 1.0 / n) + UNIFORM_MIX / n))
            for m in fired:
                probs = marked(probs, held[0], m)
        state = min(probs, key=lambda c: (-probs[c], c))
        confidence = probs[state]
    run = min(held[1] + 1, MAX_RUN) if held is not None and state == held[0] else 1
    return state, confidence, probs, run


def model_texts(matrices: DataFrame, hazards: DataFrame) -> DataFrame:
    """(person, moves, ends): the tables of a person as JSON; classes squared rows each."""
    text = lambda df, *cols: df.groupBy("person").agg(F.to_json(F.collect_list(F.struct(*cols))).alias("rows"))
    moves = text(matrices, "part", "a", "b", "p").withColumnRenamed("rows", "moves")
    return moves.join(text(hazards, "state", "d", "hazard").withColumnRenamed("rows", "ends"), "person", "full")


# --- chunks -----------------------------------------------------------------------------------------------


def chunks_of(rows: DataFrame, keys: list[str], fields: list[str], chunk: int) -> DataFrame:
    """One row for each key and chunk: its steps in order, and whether the neighbours continue without a gap."""
    place = F.floor(F.col("w") / (GRID_MIN * chunk)).alias("chunk")
    made = rows.groupBy(*keys, place).agg(F.array_sort(F.collect_list(F.struct("w", *fields))).alias("steps"))
    first, last = F.element_at("steps", 1)["w"], F.element_at("steps", -1)["w"]
    return made.withColumns({"first_w": first, "last_w": last})


def with_neighbours(summary: DataFrame, keys: list[str]) -> DataFrame:
    """Adds from_prev and to_next; the window runs over one row for each chunk."""
    w = Window.partitionBy(*keys).orderBy("chunk")
    joined = lambda a, b: F.coalesce(b - a == GRID_MIN, F.lit(False))
    return summary.withColumns({"from_prev": joined(F.lag("last_w").over(w), F.col("first_w")), "to_next": joined(F.col("last_w"), F.lead("first_w").over(w))})


def _schema(keys: list[str], rest: str) -> str:
    return ", ".join(f"`{k}` string" for k in keys) + ", " + rest


# --- forward filter ---------------------------------------------------------------------------------------


def _step(s) -> tuple:
    probs = json.loads(s["probs"]) if s["probs"] is not None else None
    return s["w"], s["part"], s["gate"], probs, json.loads(s["fired"]) if s["fired"] is not None else []


def exits(model: Model, steps: list[tuple], starts: list[tuple[str, int] | None]) -> list[tuple[str, int]]:
    """(state, run) after the steps for each (state, run) before them; equal ones go on as one."""
    now: dict[tuple[str, int] | None, list[int]] = {}
    for i, s in enumerate(starts):
        now.setdefault(s, []).append(i)
    last = None
    for w, part, gate, probs, fired in steps:
        after: dict[tuple[str, int], list[int]] = {}
        for held, who in now.items():
            got = advance(model, None if last is not None and w - last != GRID_MIN else held, part, gate, probs, fired)
            after.setdefault((got[0], got[3]), []).extend(who)
        now, last = after, w
    out = [None] * len(starts)
    for held, who in now.items():
        for i in who:
            out[i] = held
    return out


def filtered_states(rows: DataFrame, matrices: DataFrame, hazards: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """SEQ-10 · SEQ-11 · STA-27: the coarse state of every window, given the state before it.

    rows: (person, w, part, gate, probs, fired); matrices: (person, part, a, b, p) with part "all" as
    the fallback; hazards: (person, state, d, hazard). A gated window is its gate. Otherwise the
    probabilities are multiplied by the transition row of the previous window's state, whose stay
    decays with the length of its run, and by the markers that fired. A gap starts afresh. Gives
    (person, w, coarse, coarse_confidence, probs as filtered).

    The state carried on is (label, run up to MAX_RUN): a chunk that neighbours continue reports the exit
    for every label its predecessor can end in and every run.
    """
    keys = ["person"]
    texts = rows.select("person", "w", "part", "gate", F.to_json("probs").alias("probs"), F.to_json("fired").alias("fired"))
    made = materialise(chunks_of(texts, keys, ["part", "gate", "probs", "fired"], chunk), "filter-chunks")
    tail = F.element_at("steps", -1)
    labels = F.when(tail["gate"].isNotNull(), F.array(tail["gate"])).otherwise(F.json_object_keys(tail["probs"]))
    linked = with_neighbours(made.select("person", "chunk", "first_w", "last_w", labels.alias("labels")), keys)
    before = F.lag("labels").over(Window.partitionBy("person").orderBy("chunk"))
    linked = linked.withColumn("before", F.when(F.col("from_prev"), before)).drop("first_w", "last_w", "labels")
    whole = materialise(made.join(linked, ["person", "chunk"]).join(model_texts(matrices, hazards), "person", "left"), "filter-links")

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                starts = [(b, run) for b in r.before for run in range(1, MAX_RUN + 1)] if r.from_prev else [None]
                out.append((r.person, r.chunk, json.dumps(list(zip(starts, exits(Model(r.moves, r.ends), [_step(s) for s in r.steps], starts))))))
            yield pd.DataFrame(out, columns=["person", "chunk", "exits"])

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        out, held = [], None
        for r in pdf.sort_values("chunk").itertuples(index=False):
            held = held if r.from_prev else None
            out.append((r.person, r.chunk, *(held or (None, None))))
            if isinstance(r.exits, str):
                held = {tuple(a) if a is not None else None: tuple(b) for a, b in json.loads(r.exits)}[held]
        return pd.DataFrame(out, columns=["person", "chunk", "state", "run"]).astype({"run": "Int64"})

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                model, held, last = Model(r.moves, r.ends), (r.state, int(r.run)) if isinstance(r.state, str) else None, None
                for w, part, gate, probs, fired in map(_step, r.steps):
                    held = None if last is not None and w - last != GRID_MIN else held
                    state, confidence, probs, run = advance(model, held, part, gate, probs, fired)
                    held, last = (state, run), w
                    out.append((r.person, w, state, confidence, json.dumps(probs)))
            yield pd.DataFrame(out, columns=["person", "w", "coarse", "coarse_confidence", "probs"])

    found = whole.where("to_next").mapInPandas(tables, "person string, chunk long, exits string")
    summary = materialise(whole.select("person", "chunk", "from_prev").join(found, ["person", "chunk"], "left"), "filter-exits")
    entries = summary.groupBy("person").applyInPandas(compose, "person string, chunk long, state string, run long")
    got = whole.join(entries, ["person", "chunk"]).select("person", "steps", "moves", "ends", "state", "run").mapInPandas(fold, "person string, w long, coarse string, coarse_confidence double, probs string")
    return got.withColumn("probs", F.from_json("probs", "map<string,double>"))


# --- Viterbi ----------------------------------------------------------------------------------------------


def _emissions(steps) -> tuple[np.ndarray, np.ndarray]:
    w = np.array([s["w"] for s in steps], np.int64)
    return w, np.log(np.clip(np.array([s["p"] for s in steps], float), 1e-9, None))


def _stretches(w: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.diff(w) != GRID_MIN) + 1
    return list(zip(np.concatenate(([0], cut)).tolist(), np.concatenate((cut, [len(w)])).tolist()))


def _forward(step: np.ndarray, emit: np.ndarray, entry: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Best scores after the emissions and, for each of them, the best state before. entry: scores of the states before them."""
    back = np.zeros(emit.shape, int)
    score = None if entry is None else entry
    for t in range(len(emit)):
        if score is None:
            score = emit[t]
        else:
            cand = score[:, None] + step
            back[t], score = cand.argmax(axis=0), cand.max(axis=0) + emit[t]
    return score, back


def _through(step: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """(n, n) max-plus matrix: best score from each state before the emissions to each state after them."""
    best = None
    for e in emit:
        best = (step if best is None else (best[:, :, None] + step[None]).max(axis=1)) + e
    return best


def viterbi_relabel(rows: DataFrame, matrix: DataFrame, keys: list[str], classes: list[str], chunk: int = CHUNK) -> DataFrame:
    """SEQ-13: most likely path per contiguous stretch of a key, by the transition matrix of that key.

    rows: (keys, w, p_<class>); matrix: (keys, a, b, p). A pair without an entry counts as uniform.
    A chunk inside a stretch is a max-plus matrix; their products give the scores at every chunk's
    entry. A second pass gives the best state before a chunk for each state at its end, from which the
    states at the ends follow from right to left, and a third pass traces every chunk back.
    """
    n = len(classes)
    entry = F.struct(F.concat_ws("\u0001", "a", "b").alias("k"), F.col("p").alias("v"))
    # classes squared numbers per key travel with its chunks
    known = matrix.where(F.col("a").isin(classes) & F.col("b").isin(classes)).groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("_m"))
    cells = F.array(*[(1 - UNIFORM_MIX) * F.coalesce(F.element_at("_m", f"{a}\u0001{b}"), F.lit(1.0 / n)) + UNIFORM_MIX / n for a in classes for b in classes])
    steps = rows.select(*keys, "w", F.array(*[F.col(f"p_{c}").cast("double") for c in classes]).alias("p"))
    made = materialise(chunks_of(steps, keys, ["p"], chunk), "viterbi-chunks")
    linked = with_neighbours(made.select(*keys, "chunk", "first_w", "last_w"), keys).drop("first_w", "last_w")
    whole = materialise(made.join(linked, [*keys, "chunk"]).join(known, keys, "left").withColumn("prior", cells).drop("_m"), "viterbi-links")
    at = [*keys, "chunk"]

    def per_chunk(work, columns: list[str]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for r in pdf.to_dict("records"):
                    w, emit = _emissions(r["steps"])
                    out += [(*[r[k] for k in keys], *x) for x in work(r, w, emit, np.log(np.asarray(r["prior"], float)).reshape(n, n))]
                yield pd.DataFrame(out, columns=[*keys, *columns])

        return run

    def scores(r, w, emit, step):
        # the whole chunk inside one stretch: a matrix; else the scores of its last stretch
        spans = _stretches(w)
        if r["from_prev"] and len(spans) == 1:
            return [(r["chunk"], _through(step, emit).ravel().tolist())]
        return [(r["chunk"], _forward(step, emit[spans[-1][0] :], None)[0].tolist())]

    def entries(pdf: pd.DataFrame) -> pd.DataFrame:
        out, held = [], None
        for r in pdf.sort_values("chunk").to_dict("records"):
            held = held if r["from_prev"] else None
            out.append((*[r[k] for k in keys], r["chunk"], None if held is None else held.tolist()))
            if r["scores"] is not None:
                got = np.asarray(r["scores"], float)
                held = (held[:, None] + got.reshape(n, n)).max(axis=0) if len(got) > n or (n == 1 and held is not None) else got
                held = held - held.max()
        return pd.DataFrame(out, columns=[*at, "entry"])

    def backs(r, w, emit, step):
        spans = _stretches(w)
        a, b = spans[0]
        last = _forward(step, emit[spans[-1][0] :], None if r["entry"] is None or len(spans) > 1 else np.asarray(r["entry"], float))[0]
        before = None
        if r["entry"] is not None:
            score, back = _forward(step, emit[a:b], np.asarray(r["entry"], float))
            ends = list(range(n)) if len(spans) == 1 else [int(score.argmax())] * n
            for t in range(b - 1, a - 1, -1):
                ends = [int(back[t][e]) for e in ends]
            before = ends
        return [(r["chunk"], before, int(last.argmax()))]

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        out, wanted = [], None
        for r in pdf.sort_values("chunk", ascending=False).to_dict("records"):
            state = wanted if r["to_next"] else r["best"]
            out.append((*[r[k] for k in keys], r["chunk"], int(state)))
            wanted = int(r["before"][int(state)]) if r["before"] is not None else None
        return pd.DataFrame(out, columns=[*at, "exit"])

    def trace(r, w, emit, step):
        spans, out = _stretches(w), []
        for i, (a, b) in enumerate(spans):
            score, back = _forward(step, emit[a:b], np.asarray(r["entry"], float) if i == 0 and r["entry"] is not None else None)
            state = int(r["exit"]) if i == len(spans) - 1 else int(score.argmax())
            path = []
            for t in range(b - a - 1, -1, -1):
                path.append(state)
                state = int(back[t][state])
            out += [(int(x), classes[s]) for x, s in zip(w[a:b], reversed(path))]
        return out

    found = whole.where("to_next").mapInPandas(per_chunk(scores, ["chunk", "scores"]), _schema(keys, "chunk long, scores array<double>"))
    summary = materialise(whole.select(*at, "from_prev", "to_next").join(found, at, "left"), "viterbi-scores")
    entered = materialise(whole.join(summary.groupBy(*keys).applyInPandas(entries, _schema(keys, "chunk long, entry array<double>")), at), "viterbi-entries")
    back = entered.mapInPandas(per_chunk(backs, ["chunk", "before", "best"]), _schema(keys, "chunk long, before array<int>, best int"))
    ends = whole.select(*at, "to_next").join(materialise(back, "viterbi-backs"), at).groupBy(*keys).applyInPandas(final, _schema(keys, "chunk long, exit int"))
    return entered.join(ends, at).mapInPandas(per_chunk(trace, ["w", "label"]), _schema(keys, "w long, label string"))
