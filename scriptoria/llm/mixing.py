"""Mix sources to target shares of tokens: soft membership, projected gradient, exact rounding.

1. A naive Bayes classifier over hashed words, fitted on at most ``train_rows`` labelled rows (a documented bound),
   gives documents without a source a posterior over the sources. How far the words are trusted against the prior is
   chosen by the log loss on held-out rows of the sample, so that where texts say nothing about their source the posterior is
   the prior. A labelled document belongs to its source.
2. A projected gradient descent fits nonnegative rates whose expected tokens per source match the targets, in least
   squares. Labelled documents of one source share their rate, so they enter as one total per source; every document
   without a source has a rate of its own, which stays with its row: a round is one distributed pass that returns one
   number per source and mix, and every ``ROUNDS_KEPT`` rounds the rates are written to a table.
3. Rates become whole copies: the integer part, and one more for documents below a cut in a hash of the document. The
   cut of each labelled source is set from its own tokens by hash bin, so that the total is met within one bin.

``keep`` says what gives way when a source is too small even at its cap: 'size' keeps the other sources' target tokens
(their shares then lie above the target), 'shares' makes the whole mix smaller until all sources that have documents
fill their shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptoria.llm.sampling import hash_sample
from scriptoria.llm.tokens import encoder
from scriptoria.session import store

WIDTH = 1 << 15
ROUNDS_KEPT = 8
BINS = 1 << 14
_WORD = regex.compile(r"[\p{Han}]|[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+|\n+")


def _counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    import zlib

    ids = [zlib.crc32(w.lower().encode()) % WIDTH for w in _WORD.findall(text)]
    return np.unique(np.asarray(ids, dtype=np.int64), return_counts=True)


class Model(NamedTuple):
    """Sources in order, log probabilities (sources, WIDTH + 1; the last column is the prior), trust in the words."""

    names: list[str]
    log: np.ndarray
    trust: float


TRUSTS = (0.0, 0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0)


def _log_probabilities(rows: list[tuple[str, str]], names: list[str], prior: np.ndarray) -> np.ndarray:
    counts = np.ones((len(names), WIDTH))
    at = {x: i for i, x in enumerate(names)}
    for text, label in rows:
        ids, n = _counts(text)
        # Sublinear counts: a word that fills a table says little more than one seen a few times.
        counts[at[label], ids] += np.log1p(n)
    return np.c_[np.log(counts / counts.sum(axis=1, keepdims=True)), prior]


def fit_classifier(docs: DataFrame, key: str, text: str, label: str, train_rows: int) -> Model:
    """The classifier, from about ``train_rows`` labelled rows; a quarter of them chooses the trust before all are used."""
    known = docs.select(docs[key].alias("k"), docs[text].alias("t"), docs[label].alias("l")).where("l IS NOT NULL AND t IS NOT NULL")
    there = {r["l"]: r["n"] for r in docs.where(docs[label].isNotNull()).groupBy(docs[label].alias("l")).agg(F.count("*").alias("n")).collect()}
    names, total = sorted(there), sum(there.values()) or 1
    prior = np.array([np.log(there[x] / total) for x in names])
    rows = [(r["t"], r["l"]) for r in hash_sample(known, ["k"], train_rows, sum(there.values()), "mix").orderBy("k").select("t", "l").collect()]
    trust = 0.0
    if len(names) > 1 and len(rows) >= 8:
        part = Model(names, _log_probabilities([x for i, x in enumerate(rows) if i % 4], names, prior), 1.0)
        held = [(evidence(t, part), names.index(x)) for t, x in rows[::4]]
        loss = {w: -sum(float(np.log(max(_softmax(prior + w * e)[i], 1e-12))) for e, i in held) for w in TRUSTS}
        trust = min(TRUSTS, key=lambda w: (loss[w], w))
    return Model(names, _log_probabilities(rows, names, prior), trust)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def evidence(text: str, model: Model) -> np.ndarray:
    ids, n = _counts(text)
    return model.log[:, ids] @ np.log1p(n)


def posterior(text: str, model: Model) -> np.ndarray:
    return _softmax(model.log[:, -1] + model.trust * evidence(text, model))


def sized(docs: DataFrame, key: str, text: str, label: str, model: Model) -> DataFrame:
    """(key, n_tokens, source, member): member is the posterior of rows without a source, null for others.

    Null and empty texts have no tokens and are left out: no share depends on them.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder()
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                texts, labels = part.column(1).to_pylist(), part.column(2).to_pylist()
                n = [len(own.encode(t)) for t in texts]
                member = [posterior(t, model).tolist() if x is None and t and model.names else None for t, x in zip(texts, labels)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), part.column(2), pa.array(member, pa.list_(pa.float64()))], ["key", "n_tokens", "source", "member"])

    rows = docs.select(docs[key], docs[text], docs[label]).mapInArrow(run, f"key {kind}, n_tokens bigint, source string, member array<double>")
    return rows.where("n_tokens > 0")


class Plan:
    """Targets and caps of every mix, as arrays over the known sources."""

    def __init__(self, targets: list, names: list[str], tokens: np.ndarray, total: int, keep: str) -> None:
        self.names = names
        self.mixes = sorted({t["mix_name"] for t in targets})
        self.want = np.zeros((len(names), len(self.mixes)))
        self.cap = np.zeros((len(names), len(self.mixes)))
        for t in targets:
            if t["source_name"] in names:
                at = names.index(t["source_name"]), self.mixes.index(t["mix_name"])
                self.want[at] = t["target_share"] * t["size_ratio"] * total
                self.cap[at] = t["max_repeats"]
        # A document of uncertain source is repeated no oftener than every source of the mix allows.
        some = np.where(self.want > 0, self.cap, np.inf).min(axis=0, initial=np.inf)
        self.soft_cap = np.where(np.isfinite(some), some, 0.0)
        if keep == "shares":
            fill = np.where((self.want > 0) & (tokens[:, None] > 0), self.cap * tokens[:, None] / np.maximum(self.want, 1e-9), np.inf).min(axis=0, initial=np.inf)
            self.want *= np.minimum(1.0, fill)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, width)


def _after(rates: np.ndarray, member: np.ndarray, pushes: list[np.ndarray], cap: np.ndarray) -> np.ndarray:
    """Rates (rows, mixes) after further gradient steps, each projected to 0..cap."""
    for push in pushes:
        rates = np.clip(rates - member @ push, 0, cap)
    return rates


def fit_rates(soft: DataFrame, hard: np.ndarray, plan: Plan, rounds: int = 40, step: float = 0.8) -> tuple[np.ndarray, DataFrame]:
    """Rates of the labelled sources (sources, mixes), and ``soft`` (key, n_tokens, member) with a column ``rates``.

    ``hard`` holds the tokens of labelled documents per source.
    """
    s, m = plan.want.shape
    own = np.zeros((s, m))
    # Written once, so that a round reads these rows only; shuffled, so that few of them are few tasks.
    state = store(soft.repartition("key").withColumn("rates", F.array_repeat(F.lit(0.0), m)))
    kind = soft.schema["key"].dataType.simpleString()
    some = state.limit(1).count() > 0

    def advanced(state: DataFrame, pushes: list[np.ndarray]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rates = _after(_matrix(b.column(3), m), _matrix(b.column(2), s), pushes, plan.soft_cap)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(rates.tolist(), pa.list_(pa.float64()))], ["key", "n_tokens", "member", "rates"])

        return store(state.select("key", "n_tokens", "member", "rates").mapInArrow(run, f"key {kind}, n_tokens bigint, member array<double>, rates array<double>"))

    def totals(state: DataFrame, pushes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got, there = np.zeros((s, m)), np.zeros(s)
            for b in batches:
                if b.num_rows:
                    weighed = _matrix(b.column(1), s) * b.column(0).to_numpy()[:, None]
                    got += weighed.T @ _after(_matrix(b.column(2), m), _matrix(b.column(1), s), pushes, plan.soft_cap)
                    there += weighed.sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([np.r_[got.ravel(), there].tolist()])], ["x"])

        parts = state.select("n_tokens", "member", "rates").mapInArrow(run, "x array<double>").select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
        flat = np.zeros(s * m + s)
        for r in parts:
            flat[r["i"]] = r["x"]
        return flat[: s * m].reshape(s, m), flat[s * m :]

    pushes: list[np.ndarray] = []
    last = None
    for _ in range(rounds if s and m else 0):
        got, there = totals(state, pushes) if some else (np.zeros((s, m)), np.zeros(s))
        got, there = got + own * hard[:, None], there + hard
        # The gradient of the squared relative misses, scaled by what each source holds.
        push = step * np.where(there[:, None] > 0, (got - plan.want) / np.maximum(there, 1)[:, None], 0)
        own = np.clip(own - push, 0, plan.cap)
        pushes.append(push)
        if some and len(pushes) == ROUNDS_KEPT:
            state, pushes = advanced(state, pushes), []
        if np.abs(push).max() < 1e-4 or (last is not None and np.abs(push - last).max() < 1e-6):
            break
        last = push
    return own, advanced(state, pushes) if some and pushes else state


class Mixed(NamedTuple):
    """``selection``: mix_name, key, source, n_tokens, copies (1..max_repeats). ``report()`` works out what was reached."""

    selection: DataFrame
    chosen: DataFrame
    plan: Plan
    targets: list
    total: int

    def report(self) -> DataFrame:
        """One row per target with what was aimed at and reached: tokens of labelled documents, expected tokens with the
        unlabelled ones, shares of both, and most copies of one document."""
        names, size = self.plan.names, F.col("n_tokens") * F.col("copies")
        by_label = self.chosen.groupBy("mix_no", "source").agg(F.sum(size).alias("labelled_tokens"), F.max("copies").alias("most_copies"))
        by_member = self.chosen.where("source IS NULL").select("mix_no", size.alias("size"), F.posexplode("member").alias("source_no", "p")).groupBy("mix_no", "source_no").agg(F.sum(F.col("size") * F.col("p")).alias("x"))
        rows = {(r["mix_no"], r["source"]): r for r in by_label.collect()}
        expected = {(i, x): float(rows[i, x]["labelled_tokens"]) if (i, x) in rows else 0.0 for i in range(len(self.plan.mixes)) for x in names}
        for r in by_member.collect():
            expected[r["mix_no"], names[r["source_no"]]] += r["x"]
        lines = []
        for i, name in enumerate(self.plan.mixes):
            all_labelled = sum(r["labelled_tokens"] for (m, x), r in rows.items() if m == i and x is not None) or 1
            all_expected = sum(v for (m, _), v in expected.items() if m == i) or 1
            for t in sorted((t for t in self.targets if t["mix_name"] == name), key=lambda t: t["source_name"]):
                x = t["source_name"]
                r, soft = rows.get((i, x)), expected.get((i, x), 0.0)
                aim = float(self.plan.want[names.index(x), i]) if x in names else t["target_share"] * t["size_ratio"] * self.total
                got = int(r["labelled_tokens"]) if r else 0
                lines.append((name, x, t["target_share"], int(round(aim)), got, round(soft, 1), got / all_labelled, soft / all_expected, int(r["most_copies"] if r else 0), int(t["max_repeats"])))
        ddl = "mix_name string, source_name string, target_share double, target_tokens bigint, labelled_tokens bigint, expected_tokens double, labelled_share double, actual_share double, most_copies int, max_repeats int"
        return SparkSession.active().createDataFrame(lines, ddl)


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", label: str = "source", train_rows: int = 8000, keep: str = "size") -> Mixed:
    """Documents chosen for every mix of ``targets`` (mix_name, source_name, target_share, max_repeats, size_ratio).

    A source that is empty or too small even at its cap falls short, visibly; ``keep`` says what gives way. Documents
    without a source count by their posterior and are repeated at most as often as every source of the mix allows. Null
    texts have no tokens; empty tables give zero tokens. What reaches the driver is bounded by sources times mixes.
    """
    if keep not in ("size", "shares"):
        raise ValueError("keep must be 'size' or 'shares'")
    spark = docs.sparkSession
    model = fit_classifier(docs, key, text, label, train_rows)
    rows = store(sized(docs, key, text, label, model))
    sums = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    hard = np.array([float(sums.get(x, 0)) for x in model.names])
    total, wanted = sum(sums.values()), targets.collect()
    plan = Plan(wanted, model.names, hard, total, keep)
    own, soft = fit_rates(rows.where("source IS NULL AND member IS NOT NULL").select("key", "n_tokens", "member"), hard, plan)

    hard_rates = [(x, i, float(own[a, i])) for a, x in enumerate(model.names) for i in range(len(plan.mixes)) if own[a, i] > 0]
    rates = spark.createDataFrame(hard_rates, "source string, mix_no int, rate double")
    labelled = rows.where("source IS NOT NULL").join(F.broadcast(rates), "source")
    unsure = soft.select("key", F.lit(None).cast("string").alias("source"), "n_tokens", "member", F.posexplode("rates").alias("mix_no", "rate")).where("rate > 0")
    cols = ["key", "source", "n_tokens", "member", "mix_no", "rate"]
    drawn = labelled.select(*cols).unionByName(unsure.select(*cols)).withColumn("whole", F.floor(F.col("rate") + 1e-9).cast("int"))
    drawn = drawn.withColumn("part", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0))).withColumn("bin", F.pmod(F.xxhash64("key", "mix_no"), F.lit(BINS)).cast("int"))
    bins = drawn.where("source IS NOT NULL").groupBy("source", "mix_no", "bin").agg(F.sum("n_tokens").alias("n"), F.first("part").alias("part"))
    w = Window.partitionBy("source", "mix_no")
    so_far = F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n") / 2
    cuts = bins.withColumn("mid", so_far).withColumn("goal", F.sum("n").over(w) * F.col("part")).where("mid <= goal").groupBy("source", "mix_no").agg(F.max("bin").alias("cut_bin"))
    # At most one cut per source and mix.
    placed = drawn.join(F.broadcast(cuts), ["source", "mix_no"], "left")
    extra = F.when(F.col("source").isNull(), F.col("bin") < F.col("part") * BINS).otherwise((F.col("bin") <= F.coalesce("cut_bin", F.lit(-1))) & (F.col("part") > 0))
    chosen = store(placed.select("key", "source", "n_tokens", "member", "mix_no", (F.col("whole") + extra.cast("int")).alias("copies")).where("copies > 0"))
    mix_names = F.array(*[F.lit(x) for x in plan.mixes]) if plan.mixes else F.array().cast("array<string>")
    selection = chosen.select(F.get(mix_names, "mix_no").alias("mix_name"), F.col("key").alias(key), "source", "n_tokens", "copies")
    return Mixed(selection, chosen, plan, wanted, total)
