"""Language identification by interpolated Kneser-Ney models of characters, one per language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.common import crc_of_id, small, stored
from headway.llm.tokens import U, as_array, mix, pieces

ORDER = 4
#: Documents of each language that the fit draws (a quarter of them for calibration).
PER_LANGUAGE = 2_000
#: Share of a language's own calibration texts that may cost more than the rejection bound.
REJECT = 0.005
PAD, GAP = 0, 32
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _LETTERS[0]


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row and the text of each: lower case, other runs as one gap.

    Each text is led by ORDER - 1 pads, so that no n-gram reaches into its neighbour.
    """
    glue = "\0" * (ORDER - 1)
    joined = glue + glue.join(t.replace("\0", " ") for t in texts.to_pylist())
    points = np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    pad = points == PAD
    points = np.where(pad | letters()[points], points, np.uint32(GAP))
    gap = points == GAP
    keep = np.ones(len(points), bool)
    keep[1:] = ~(gap[1:] & (gap[:-1] | pad[:-1]))
    text = np.cumsum(pad) // (ORDER - 1) - 1
    return points[keep], text[keep]


def grams(points: np.ndarray) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each place, for n = 1 .. ORDER (index n - 1)."""
    p = points.astype(U)
    out = [mix(p + U(1))]
    for n in range(2, ORDER + 1):
        before = np.zeros_like(p)
        before[1:] = out[-1][:-1]
        out.append(mix(before * U(0x9E3779B97F4A7C15) + p + U(n)))
    return out


def shifted(x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    out[1:] = x[:-1]
    return out


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in a sorted hash array and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class LanguageModels:
    """For each order: sorted hashes of all languages' n-grams with a column of log probabilities per
    language, and sorted hashes of contexts with the log weight of the lower order."""

    languages: list[str]
    keys: list[np.ndarray] = field(default_factory=list)
    logs: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    floor: np.ndarray | None = None
    sharpness: float = 20.0
    bounds: np.ndarray | None = None

    def logp(self, order: int, gram: list[np.ndarray], ctx: list[np.ndarray]) -> np.ndarray:
        """Log probability (place, language) of grams of all orders that end at the same places."""
        if order == 0:
            return np.broadcast_to(self.floor, (len(gram[0]), len(self.languages)))
        at, hit = find(self.keys[order - 1], gram[order - 1])
        out = self.logs[order - 1][at] if len(self.keys[order - 1]) else np.zeros((len(hit), len(self.languages)), np.float32)
        miss = np.flatnonzero(~hit)
        if len(miss):
            c, known = find(self.contexts[order - 1], ctx[order - 1][miss])
            lower = self.logp(order - 1, [g[miss] for g in gram], [x[miss] for x in ctx])
            weight = self.weights[order - 1][c] * known[:, None] if len(self.contexts[order - 1]) else 0.0
            out[miss] = lower + weight
        return out

    def costs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character (text, language) and number of letters of each text."""
        points, text = characters(texts)
        gram = grams(points)
        ctx = [np.zeros_like(gram[0]), *[shifted(g) for g in gram[:-1]]]
        real = np.flatnonzero(points != PAD)
        of = text[real]
        n = len(texts)
        total = np.zeros((n, len(self.languages)))
        if len(real) and self.languages:
            log = self.logp(ORDER, [g[real] for g in gram], [c[real] for c in ctx])
            cuts = np.searchsorted(of, np.arange(n + 1))
            run = np.zeros((len(real) + 1, len(self.languages)))
            np.cumsum(log, axis=0, out=run[1:], dtype=np.float64)
            total = -(run[cuts[1:]] - run[cuts[:-1]])
        many = np.bincount(of, minlength=n)
        count = np.bincount(of[points[real] != GAP], minlength=n)
        return total / np.maximum(many, 1)[:, None], count

    def posterior(self, cost: np.ndarray) -> np.ndarray:
        x = np.exp(-self.sharpness * (cost - cost.min(1, keepdims=True)))
        return x / x.sum(1, keepdims=True)


def smooth(tables: dict[tuple[int, int], dict[str, np.ndarray]], languages: list[str]) -> LanguageModels:
    """Interpolated Kneser-Ney from n-gram tables by (language, order): gram, ctx, suffix, count.

    The highest order discounts counts, lower orders the number of different characters before.
    """
    model = LanguageModels(languages)
    k = len(languages)
    empty = {"gram": np.zeros(0, U), "ctx": np.zeros(0, U), "suffix": np.zeros(0, U), "count": np.zeros(0, np.int64)}
    get = lambda i, n: tables.get((i, n), empty)
    types = max(1, len(np.unique(np.concatenate([get(i, 1)["gram"] for i in range(k)]))) if k else 1)
    model.floor = np.full(k, -np.log(types + 1), np.float32)
    for n in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([get(i, n)["gram"] for i in range(k)])) if k else np.zeros(0, U)
        ctx_of, suffix_of = np.zeros(len(keys), U), np.zeros(len(keys), U)
        contexts = np.unique(np.concatenate([get(i, n)["ctx"] for i in range(k)])) if k else np.zeros(0, U)
        own = np.full((len(keys), k), 0.0)
        weight = np.zeros((len(contexts), k), np.float32)
        for i in range(k):
            t = get(i, n)
            if not len(t["gram"]):
                continue
            at, _ = find(keys, t["gram"])
            ctx_of[at], suffix_of[at] = t["ctx"], t["suffix"]
            c = t["count"].astype(float)
            if n < ORDER:
                up = get(i, n + 1)["suffix"]
                place, ok = find(np.sort(t["gram"]), up)
                c = np.bincount(place[ok], minlength=len(t["gram"])).astype(float)[np.argsort(np.argsort(t["gram"], kind="stable"), kind="stable")]
                c = np.maximum(c, 1.0)
            ones, twos = (c == 1).sum(), (c == 2).sum()
            d = ones / (ones + 2 * twos) if ones and twos else 0.5
            cat, _ = find(contexts, t["ctx"])
            mass = np.bincount(cat, weights=c, minlength=len(contexts))
            kinds = np.bincount(cat, minlength=len(contexts))
            own[at, i] = np.maximum(c - d, 0) / mass[cat]
            seen = mass > 0
            weight[seen, i] = np.log(d * kinds[seen] / mass[seen])
        if n == 1:
            lower = np.broadcast_to(model.floor, (len(keys), k))
        else:
            at, _ = find(model.keys[-1], suffix_of)
            lower = model.logs[-1][at]
        cat, _ = find(contexts, ctx_of)
        logs = np.log(own + np.exp(lower + weight[cat])) if len(keys) else np.zeros((0, k))
        model.keys.append(keys)
        model.logs.append(logs.astype(np.float32))
        model.contexts.append(contexts)
        model.weights.append(weight)
    return model


def drawn(ids: DataFrame, many: DataFrame, limit: int) -> DataFrame:
    """About ``limit`` rows of each language of ``ids`` (_id, _lang), by hash of the id: _id, _lang and hold.

    ``many`` has the number of rows of each language (_l, _n). The draw is compared in doubles, which
    no number of rows overflows.
    """
    draw = F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(1 << 40)).cast("double")
    ids = ids.join(small(many), F.col("_lang") == F.col("_l")).filter(draw * F.col("_n") < F.lit(float(limit << 40)))
    return ids.select("_id", "_lang", (F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(4)) == 0).alias("hold"))


def train(docs: DataFrame, limit: int = PER_LANGUAGE) -> LanguageModels:
    """Models of all languages of ``docs`` (doc_id, text, lang), from rows outside the held-out quarter.

    About ``limit`` documents of a language, drawn by hash (all of a rarer one), are counted in the tasks;
    the driver gets one row per different n-gram of that bounded sample, and bounded numbers of costs
    for calibration: the sharpness that gives the least log loss, and for each language the cost that
    all but ``REJECT`` of its own texts stay below.
    """
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").filter(crc_of_id() % 4 != 2)
    ids = known.select(F.col("doc_id").cast("long").alias("_id"), F.col("lang").cast("string").alias("_lang")).distinct()
    many = stored(ids.groupBy(F.col("_lang").alias("_l")).agg(F.count(F.lit(1)).alias("_n")), "language-counts")
    ids = stored(drawn(ids, many, limit), "language-ids")
    sample = stored(
        known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
        .join(small(ids), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")))
        .select("text", "lang", "hold"),
        "language-sample",
    )
    languages = sorted(r["lang"] for r in sample.select("lang").distinct().collect())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.array(batch.column(1).to_pylist(), object)
            for i, name in enumerate(languages):
                mine = batch.column(0).filter(pa.array(lang == name))
                if not len(mine):
                    continue
                for _, texts in pieces(as_array(mine), 1 << 23):
                    points, _ = characters(texts)
                    gram = grams(points)
                    real = points != PAD
                    for n in range(1, ORDER + 1):
                        g = gram[n - 1]
                        ctx = shifted(gram[n - 2]) if n > 1 else np.zeros_like(g)
                        suffix = gram[n - 2] if n > 1 else np.zeros_like(g)
                        key, first, many = np.unique(g[real], return_index=True, return_counts=True)
                        yield pa.record_batch(
                            [
                                pa.array(np.full(len(key), i * 16 + n, np.int32)),
                                pa.array(key.view(np.int64)),
                                pa.array(ctx[real][first].view(np.int64)),
                                pa.array(suffix[real][first].view(np.int64)),
                                pa.array(many.astype(np.int64)),
                            ],
                            ["part", "gram", "ctx", "suffix", "count"],
                        )

    rows = sample.filter("NOT hold").select("text", "lang").mapInArrow(count, "part int, gram bigint, ctx bigint, suffix bigint, count bigint")
    rows = rows.groupBy("part", "gram").agg(F.min("ctx").alias("ctx"), F.min("suffix").alias("suffix"), F.sum("count").alias("count"))
    got = rows.orderBy("part", "gram").toArrow()
    part = got.column("part").to_numpy()
    tables = {}
    for p in np.unique(part):
        mine = part == p
        tables[int(p) // 16, int(p) % 16] = {
            name: got.column(name).to_numpy()[mine].view(U) if name != "count" else got.column(name).to_numpy()[mine] for name in ("gram", "ctx", "suffix", "count")
        }
    model = smooth(tables, languages)
    if languages:
        calibrate(model, sample)
    return model


def calibrate(model: LanguageModels, sample: DataFrame) -> None:
    k = len(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in pieces(as_array(batch.column(0))):
                cost, letters_ = model.costs(texts)
                yield pa.record_batch(
                    [pa.array(cost.tolist(), pa.list_(pa.float64())), pa.array(letters_), batch.column(1).slice(start, len(texts))], ["cost", "n", "lang"]
                )

    got = sample.filter("hold").select("text", "lang").mapInArrow(run, "cost array<double>, n bigint, lang string").toArrow()
    model.bounds = np.full(k, np.inf)
    cost = np.array(got.column("cost").to_pylist(), float).reshape(-1, k)
    n = got.column("n").to_numpy()
    true = np.array([model.languages.index(x) for x in got.column("lang").to_pylist()], np.int64)
    use = n >= 20
    if not use.any():
        return
    cost, true = cost[use], true[use]
    best = np.inf
    for sharp in (2.0, 4.0, 8.0, 12.0, 16.0, 24.0, 32.0, 48.0, 64.0):
        model_sharp, model.sharpness = model.sharpness, sharp
        loss = -np.log(np.maximum(model.posterior(cost)[np.arange(len(true)), true], 1e-12)).mean()
        if loss < best:
            best = loss
        else:
            model.sharpness = model_sharp
    for i in range(k):
        mine = cost[true == i, i]
        if len(mine) >= 20:
            model.bounds[i] = np.quantile(mine, 1 - REJECT)


def identify(docs: DataFrame, model: LanguageModels) -> DataFrame:
    """doc_id, lang_pred, score and rejected of every document.

    The language with the lowest cross-entropy per character wins, ties go to the earlier name; score
    is its share under the calibrated sharpness. ``rejected`` marks texts that cost more than their
    language's bound; their score is halved. Null texts, texts without a letter, and all texts if no
    language was learned, give ``und``, score 0 and rejected. Rows are judged one by one, an empty
    table gives no rows, other columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in pieces(as_array(batch.column(1)), 1 << 20):
                cost, n = model.costs(texts)
                ok = (n > 0) & bool(model.languages)
                if model.languages:
                    best = cost.argmin(1)
                    share = model.posterior(cost)[np.arange(len(best)), best]
                    odd = cost[np.arange(len(best)), best] > model.bounds[best]
                    names = [model.languages[b] if o else "und" for b, o in zip(best, ok, strict=True)]
                    value = np.where(ok, np.where(odd, share / 2, share), 0.0)
                else:
                    names, value, odd = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
                yield pa.record_batch(
                    [batch.column(0).slice(start, len(texts)), pa.array(names, pa.string()), pa.array(value, pa.float64()), pa.array(odd | ~ok)],
                    ["doc_id", "lang_pred", "score", "rejected"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double, rejected boolean")
