"""Language-model scores from an n-gram trie in Elias-Fano levels, spread over shards."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.common import stored
from headway.llm.tokens import U, as_array, hashes, mix, pieces

#: Bytes of text of a chunk, which is scored in one task, and for each shard of the trie.
CHUNK, SHARD = 3 << 20, 12 << 20
#: Weight of the unigram level in a bigram probability, in tokens.
PULL = 2_000.0
#: Log10 probabilities are kept in steps of 1 / STEPS, down to -65535 / STEPS.
STEPS = 4096
#: Followers of a context are told apart by this many bits, relative to the context.
BITS = 40
MASK = U((1 << BITS) - 1)
START, END = U(0x5354415254), U(0x454E44)
#: The followers of a context are spread so that a part has at most about one in GRAIN of a shard's tokens.
GRAIN = 4


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary with a count of zeros for each 64 bits."""

    def __init__(self, low: np.ndarray, high: np.ndarray, zeros: np.ndarray, n: int, width: int) -> None:
        self.low, self.high, self.zeros, self.n, self.width = low, high, zeros, n, width

    @staticmethod
    def build(values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (max(top, 1) // max(n, 1)).bit_length() - 1)
        bits = np.zeros(-(-(n + (top >> width) + 2) // 64) * 64, np.uint8)
        bits[(values >> U(width)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(bits.reshape(-1, 64).sum(1, dtype=np.int64))])
        zeros = np.arange(len(ones)) * 64 - ones
        low = np.zeros(-(-n * width // 64) + 2, U)
        if width:
            part = values & U((1 << width) - 1)
            at = np.arange(n, dtype=np.int64) * width
            word, bit = at >> 6, (at & 63).astype(U)
            np.bitwise_or.at(low, word, part << bit)
            over = (bit + U(width)) > U(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (U(64) - bit[over]))
        return EliasFano(low, high, zeros, n, width)

    def lows(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), U)
        place = at * self.width
        word, bit = place >> 6, (place & 63).astype(U)
        out = self.low[word] >> bit
        over = (bit + U(self.width)) > U(64)
        out[over] |= self.low[word[over] + 1] << (U(64) - bit[over])
        return out & U((1 << self.width) - 1)

    def after(self, zero: np.ndarray) -> np.ndarray:
        """Number of values before the ``zero``-th zero of the high bits (from 0): those with smaller high bits."""
        word = np.searchsorted(self.zeros, zero, "right") - 1
        word = np.minimum(word, len(self.high) - 1)
        rest = zero - self.zeros[word]
        out = np.empty(len(zero), np.int64)
        for a in range(0, len(zero), 1 << 15):
            part = slice(a, a + (1 << 15))
            bits = np.unpackbits(self.high[word[part]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            count = np.cumsum(bits == 0, axis=1, dtype=np.int16)
            inside = (count > rest[part][:, None]).argmax(1)
            out[part] = word[part] * 64 + inside - zero[part]
        return out

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Place of each wanted value, -1 if it is not in the sequence."""
        out = np.full(len(wanted), -1, np.int64)
        if not self.n or not len(wanted):
            return out
        high = (wanted >> U(self.width)).astype(np.int64)
        ok = np.flatnonzero(high < self.zeros[-1])
        high, want = high[ok], wanted[ok] & U((1 << self.width) - 1)
        last = self.after(high)
        at = np.where(high > 0, self.after(np.maximum(high - 1, 0)), 0)
        end = last.copy()
        live = np.flatnonzero(at < end)
        while len(live):  # bisection among the values with these high bits
            middle = (at[live] + end[live]) >> 1
            less = self.lows(middle) < want[live]
            at[live] = np.where(less, middle + 1, at[live])
            end[live] = np.where(less, end[live], middle)
            live = live[at[live] < end[live]]
        there = np.flatnonzero(at < last)
        hit = there[self.lows(at[there]) == want[there]]
        out[ok[hit]] = at[hit]
        return out

    def arrays(self) -> dict[str, np.ndarray]:
        return {"low": self.low, "high": self.high, "zeros": self.zeros.astype(np.int64), "shape": np.array([self.n, self.width])}

    @staticmethod
    def of(a: dict[str, np.ndarray]) -> EliasFano:
        return EliasFano(a["low"], a["high"], a["zeros"], int(a["shape"][0]), int(a["shape"][1]))


def codes(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 * STEPS), 0, 65_535).astype(np.uint16)


def values(code: np.ndarray) -> np.ndarray:
    return code.astype(np.float64) / -STEPS


@dataclass
class Trie:
    """Two levels: contexts with pointers, and followers relative to their context, with coded log10 values.

    ``pointers`` is the number of followers before each context, a monotone sequence. Followers are
    held as context number x 2**BITS + follower, which is monotone over the whole level; a search goes
    to the part of its context by the high bits and compares low bits there.
    """

    contexts: EliasFano
    pointers: EliasFano
    followers: EliasFano
    code: np.ndarray

    @staticmethod
    def build(context: np.ndarray, follower: np.ndarray, log10: np.ndarray) -> Trie:
        """From rows sorted by context, then follower."""
        new = np.ones(len(context), bool)
        new[1:] = context[1:] != context[:-1]
        number = np.cumsum(new).astype(U) - U(1)
        starts = np.append(np.flatnonzero(new), len(context)).astype(U)
        return Trie(
            EliasFano.build(context[new]), EliasFano.build(starts), EliasFano.build(number << U(BITS) | follower), codes(log10)
        )

    def find(self, context: np.ndarray, follower: np.ndarray) -> np.ndarray:
        """Place of each (context, follower) in the second level, -1 if unseen."""
        number = self.contexts.find(context)
        out = np.full(len(context), -1, np.int64)
        known = np.flatnonzero(number >= 0)
        out[known] = self.followers.find(number[known].astype(U) << U(BITS) | follower[known])
        return out

    def save(self, folder: str) -> None:
        for name, level in (("contexts", self.contexts), ("pointers", self.pointers), ("followers", self.followers)):
            for part, a in level.arrays().items():
                np.save(f"{folder}/{name}-{part}.npy", a)
        np.save(f"{folder}/code.npy", self.code)

    @staticmethod
    def open(folder: str) -> Trie:
        """Levels mapped from files, so that a search reads only the pages that it meets."""
        read = lambda name: np.load(f"{folder}/{name}.npy", mmap_mode="r")
        levels = [EliasFano.of({p: read(f"{name}-{p}") for p in ("low", "high", "zeros", "shape")}) for name in ("contexts", "pointers", "followers")]
        return Trie(*levels, read("code"))


@dataclass
class Grams:
    """Words and bigrams of a chunk: distinct ones, and those of each token."""

    words: np.ndarray
    word_of: np.ndarray
    context: np.ndarray
    follower: np.ndarray
    gram_of: np.ndarray
    first: np.ndarray  # index in ``words`` of each token's context, len(words) for the start
    bounds: np.ndarray


def grams(texts: pa.Array) -> Grams:
    found, at = hashes(texts)
    word = np.insert(found, at[1:], END)
    bounds = at + np.arange(len(at))
    kinds, of = np.unique(word, return_inverse=True)
    first = np.empty(len(of), np.int64)
    first[1:] = of[:-1]
    first[bounds[:-1]] = len(kinds)
    pair, gram_of = np.unique(first * (len(kinds) + 1) + of, return_inverse=True)
    names = np.append(kinds, START)
    return Grams(kinds, of, names[pair // (len(kinds) + 1)], kinds[pair % (len(kinds) + 1)], gram_of, first, bounds)


def word_shard(word: np.ndarray, shards: int) -> np.ndarray:
    return (mix(word + U(5)) % U(shards)).astype(np.int64)


def gram_shard(context: np.ndarray, follower: np.ndarray, heavy: tuple[np.ndarray, np.ndarray], shards: int) -> np.ndarray:
    """Shard of each pair: contexts in ``heavy`` (sorted words, parts) have their followers in so many shards in a row."""
    names, parts = heavy
    at = np.minimum(np.searchsorted(names, context), len(names) - 1)
    spread = np.where(names[at] == context, parts[at], U(1))
    return ((mix(context) % U(shards) + mix(follower + U(9)) % spread) % U(shards)).astype(np.int64)


def _five(x: np.ndarray) -> bytes:
    """The low 40 bits of each value."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from_five(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel().astype(U)


def _gram_order(g: Grams, shard: np.ndarray) -> np.ndarray:
    return np.lexsort((g.follower & MASK, g.context & MASK, shard))


def statistics(rows: DataFrame, shard: int = SHARD) -> tuple[int, int, int, int, tuple[np.ndarray, np.ndarray]]:
    """Bytes of all texts; documents, tokens and distinct tokens of the training part; heavy contexts.

    Words are counted in the tasks per partition, then summed by word: exact, with one row per distinct
    word and partition in the shuffle. Heavy are the start and all words whose tokens, training part or
    not, fill more than one part; each has as many parts as its tokens fill. At most GRAIN words for
    each shard reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = docs = rest = 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def folded() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            w = np.concatenate([x[0] for x in held]) if held else np.zeros(0, U)
            kinds, of = np.unique(w, return_inverse=True)
            n, every = (np.concatenate([x[i] for x in held]) if held else np.zeros(0, np.int64) for i in (1, 2))
            return kinds, *(np.bincount(of, weights=x, minlength=len(kinds)).astype(np.int64) for x in (n, every))

        for batch in batches:
            train = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for start, texts in pieces(as_array(batch.column(0)), 1 << 22):
                size += texts.nbytes
                t = train[start : start + len(texts)]
                docs += int(t.sum())
                rest += int((~t).sum())
                found, at = hashes(texts)
                keep = np.repeat(t, np.diff(at))
                kinds, of = np.unique(found, return_inverse=True)
                held.append((kinds, np.bincount(of[keep], minlength=len(kinds)), np.bincount(of, minlength=len(kinds))))
                if len(held) > 8:
                    held[:] = [folded()]
        w, n, every = folded()
        names = ["kind", "word", "n", "every"]
        for a in range(0, len(w), 1 << 16):
            part = slice(a, a + (1 << 16))
            yield pa.record_batch([pa.array(np.zeros(len(w[part]), np.int32)), pa.array(w[part].view(np.int64)), pa.array(n[part]), pa.array(every[part])], names)
        yield pa.record_batch([pa.array([1, 2], pa.int32()), pa.array([None, None], pa.int64()), pa.array([size, docs]), pa.array([0, docs + rest])], names)

    counted = rows.select("text", "train").mapInArrow(run, "kind int, word bigint, n bigint, every bigint")
    counted = stored(counted.groupBy("kind", "word").agg(F.sum("n").alias("n"), F.sum("every").alias("every")), "lm-words")
    totals = counted.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("every").alias("every"), F.count_if(F.col("n") > 0).alias("rows"))
    total = {r["kind"]: (r["n"], r["every"], r["rows"]) for r in totals.collect()}
    none = (0, 0, 0)
    size, (docs, all_docs, _) = total.get(1, none)[0], total.get(2, none)
    tokens, all_tokens = total.get(0, none)[0] + docs, total.get(0, none)[1] + all_docs
    distinct = total.get(0, none)[2] + (docs > 0)
    part = max(1.0, all_tokens / (GRAIN * max(1, -(-size // shard))))
    heavy = counted.filter((F.col("kind") == 0) & (F.col("every") > part)).select("word", "every").collect()
    names = np.append(np.array([r["word"] for r in heavy], np.int64).view(U), START)
    parts = np.ceil(np.append(np.array([r["every"] for r in heavy], float), max(all_docs, 1)) / part).astype(U)
    order = np.argsort(names)
    return size, docs, tokens, distinct, (names[order], parts[order])


def score(docs: DataFrame, train: str, chunk: int = CHUNK, shard: int = SHARD, pull: float = PULL) -> DataFrame:
    """Log10 probability of every document under a bigram model of the documents where ``train`` holds.

    Returns doc_id, train, n_tokens, n_known, train_tokens, base_score (one-level add-one model) and
    score. Tokens are lower-cased words and one end; a null or empty text is its end alone. A bigram has
    (joint + pull x unigram / tokens) / (context + pull / tokens), with the unigram level smoothed by
    one, so all words and one unknown sum to 1.

    Documents are dealt by hash into chunks. Each chunk sends its distinct words and bigrams, with its
    training counts, to shards by hash; a shard adds up the counts, builds its part of the trie in mapped
    files and answers every chunk in the order it asked. So no task holds more than a chunk or a shard,
    both bounded, and what travels follows the corpus. Followers of the start and of frequent words are
    spread over as many shards as their tokens fill. Besides, a shard gets a row from each chunk, and a
    few bytes for each chunk that asks for one and the same pair.
    Rows that repeat are scored alike; ids play no part in the score; an empty table gives no rows.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.expr(train).alias("train")
    )
    size, n_docs, tokens, distinct, heavy = statistics(rows, shard)
    chunks, shards = max(1, -(-size // chunk)), max(1, -(-size // shard))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    scale = float(max(tokens, 1))

    def ask(table: pa.Table) -> pa.Table:
        g = grams(as_array(table.column("text")))
        learn = np.repeat(table.column("train").to_numpy().astype(bool), np.diff(g.bounds))
        words = np.bincount(g.word_of[learn], minlength=len(g.words)).astype(np.uint32)
        pairs = np.bincount(g.gram_of[learn], minlength=len(g.context)).astype(np.uint32)
        ws, gs = word_shard(g.words, shards), gram_shard(g.context, g.follower, heavy, shards)
        wo, go = np.argsort(ws, kind="stable"), _gram_order(g, gs)
        wc, gc = np.searchsorted(ws[wo], np.arange(shards + 1)), np.searchsorted(gs[go], np.arange(shards + 1))
        out: dict[str, list] = {k: [] for k in ("shard", "words", "word_n", "contexts", "runs", "followers", "pair_n")}
        for s in range(shards):
            w, p = wo[wc[s] : wc[s + 1]], go[gc[s] : gc[s + 1]]
            if not len(w) and not len(p):
                continue
            c = g.context[p] & MASK
            new = np.flatnonzero(np.diff(c, prepend=~c[:1]))
            out["shard"].append(s)
            out["words"].append(g.words[w].tobytes())
            out["word_n"].append(words[w].tobytes())
            out["contexts"].append(_five(c[new]))
            out["runs"].append(np.diff(np.append(new, len(c))).astype(np.uint32).tobytes())
            out["followers"].append(_five(g.follower[p]))
            out["pair_n"].append(pairs[p].tobytes())
        out["chunk"] = [table.column("chunk")[0].as_py()] * len(out["shard"])
        kinds = {"chunk": pa.int64(), "shard": pa.int64()}
        return pa.table({k: pa.array(out[k], kinds.get(k, pa.binary())) for k in ("chunk", *list(out)[:-1])})

    asked = "chunk bigint, shard bigint, words binary, word_n binary, contexts binary, runs binary, followers binary, pair_n binary"

    def answer(table: pa.Table) -> pa.Table:
        asks = table.to_pylist()
        words = [np.frombuffer(a["words"], U) for a in asks]
        word_n = [np.frombuffer(a["word_n"], np.uint32) for a in asks]
        kinds, of = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(of, weights=np.concatenate(word_n), minlength=len(kinds)).astype(np.int64)
        pairs = [(np.repeat(_from_five(a["contexts"]), np.frombuffer(a["runs"], np.uint32)), _from_five(a["followers"])) for a in asks]
        pair_n = [np.frombuffer(a["pair_n"], np.uint32) for a in asks]
        # Pairs of the training part, added up by sorted key.
        seen = [n > 0 for n in pair_n]
        c = np.concatenate([p[0][k] for p, k in zip(pairs, seen, strict=True)])
        f = np.concatenate([p[1][k] for p, k in zip(pairs, seen, strict=True)])
        n = np.concatenate([x[k] for x, k in zip(pair_n, seen, strict=True)]).astype(np.int64)
        order = np.lexsort((f, c))
        c, f, n = c[order], f[order], n[order]
        new = np.ones(len(c), bool)
        new[1:] = (c[1:] != c[:-1]) | (f[1:] != f[:-1])
        starts = np.flatnonzero(new)
        n = np.add.reduceat(n, starts) if len(starts) else n
        folder = tempfile.mkdtemp()
        try:
            Trie.build(c[new], f[new], np.log10(n / scale)).save(folder)
            trie = Trie.open(folder)
            at = 0
            out = []
            for a, w, p in zip(asks, words, pairs, strict=True):
                place = trie.find(*p)
                code = np.where(place >= 0, trie.code[np.maximum(place, 0)], 0xFFFF).astype(np.uint16) if len(trie.code) else np.full(len(place), 0xFFFF, np.uint16)
                out.append({"chunk": a["chunk"], "shard": a["shard"], "word_n": total[of[at : at + len(w)]].tobytes(), "code": code.tobytes()})
                at += len(w)
            del trie
        finally:
            shutil.rmtree(folder)
        return pa.Table.from_pylist(out, pa.schema([("chunk", pa.int64()), ("shard", pa.int64()), ("word_n", pa.binary()), ("code", pa.binary())]))

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        g = grams(as_array(table.column("text")))
        ws, gs = word_shard(g.words, shards), gram_shard(g.context, g.follower, heavy, shards)
        wo, go = np.argsort(ws, kind="stable"), _gram_order(g, gs)
        got = sorted(answers.to_pylist(), key=lambda a: a["shard"])
        count = np.empty(len(g.words), np.int64)
        count[wo] = np.frombuffer(b"".join(a["word_n"] for a in got), np.int64)
        code = np.empty(len(g.context), np.uint16)
        code[go] = np.frombuffer(b"".join(a["code"] for a in got), np.uint16)
        one = (count + 1) / (tokens + distinct + 1.0)
        joint = np.where(code == 0xFFFF, 0.0, 10.0 ** values(code) * scale)
        before = np.append(count, n_docs).astype(float)
        p = (joint[g.gram_of] + pull * one[g.word_of]) / (before[g.first] + pull)
        total = lambda x: np.add.reduceat(x, g.bounds[:-1])  # noqa: E731  every text has a token
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "train": table.column("train"),
                "n_tokens": np.diff(g.bounds),
                "n_known": total((count[g.word_of] > 0).astype(np.int64)),
                "train_tokens": np.full(table.num_rows, tokens, np.int64),
                "base_score": total(np.log10(one)[g.word_of]),
                "score": total(np.log10(p)),
            }
        )

    answers = dealt.groupBy("chunk").applyInArrow(ask, asked).groupBy("shard").applyInArrow(answer, "chunk bigint, shard bigint, word_n binary, code binary")
    schema = "doc_id bigint, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, schema)
